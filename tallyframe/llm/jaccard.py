"""N-gram Jaccard join by vertical partitioning.

The n-grams (64-bit hashes) are put in one global order and cut into fragments. A
fragment sees every set's part of its range, so it alone decides which n-grams are
shared by different sets and how often; a set of which under 80 % is shared can have
no partner. For the others the order is cut again, into more fragments than a linked
pair can have differences: so such a pair has equal parts in some of them, and the
rarest parts of a set fetch its candidates. A candidate pair's overlaps are counted in
each fragment by itself and summed for the pair. Sets already in one component are not
compared any more, so large groups of near copies cost a tree of pairs, not all.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .components import connected_components
from .shared import documents_of, give_back, mix, release, settle, slices, table, tidy, with_results, word_hashes

_PART, _PASSED, _SIZE, _MARK = range(4)  # kinds of rows that go to a fragment


def shingle_sets(texts: list[bytes], width: int = 5) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text: A-Z lower-cased, words split at ASCII space.

    A text with fewer than `width` words has its whole sequence as the one shingle; one without words has none.
    """
    buf, begins = documents_of(texts)
    words, at = word_hashes(buf.lower())
    bounds = np.searchsorted(at, begins)
    key = words.copy()
    for k in range(1, min(width, len(words))):
        key[: len(words) - k] = mix(key[: len(words) - k] * np.uint64(0xA0761D6478BD642F) + words[k:])  # in this order only
    out = []
    for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if j - i >= width:
            s = key[i : j - width + 1].copy()
            s.sort()
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif j > i:
            h = np.full(1, (j - i) * 0x9FB21C651E98DF25 % (1 << 64), np.uint64)
            for w in words[i:j]:
                h = mix(h + w)
            out.append(h)
        else:
            out.append(words[:0])
    return out


def set_keys(df: DataFrame, text: str, keep: list[str] | None = None, width: int = 5) -> DataFrame:
    """Add n_shingles and set_key, a hash of the whole set (null for an empty set)."""

    def compute(texts: list[bytes]) -> list[list]:
        sets = shingle_sets(texts, width)
        return [[len(s) for s in sets], [_key(s) if len(s) else None for s in sets]]

    return with_results(df, text, "n_shingles long, set_key long", compute, keep)


def _key(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def _fragment_rows(df: DataFrame, text: str, bits: int, width: int, hot: int, most: int = 500_000) -> DataFrame:
    """Each task's distinct sets, cut into fragments: rows (frag, kind, keys, counts, hashes).

    Parts have six bytes for each n-gram, the 48 bits behind those that name its fragment: 53 bits of the hash or more.
    """
    drop = np.uint64(max(0, 16 - bits))
    schema = "frag int, kind int, keys binary, counts binary, hashes binary"
    names = ["frag", "kind", "keys", "counts", "hashes"]
    types = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]

    def flush(keys: list[int], sets: list[np.ndarray], turn: int) -> pa.RecordBatch:
        rows: list[tuple] = []
        key, sizes = np.array(keys, np.int64), np.array([len(s) for s in sets], np.int32)
        rows.append((turn % (1 << bits), _SIZE, key.tobytes(), sizes.tobytes(), b""))
        h, doc = np.concatenate(sets) >> drop << drop, np.repeat(np.arange(len(sets), dtype=np.int32), sizes)
        ordered = np.sort(h)
        met = ordered[: max(0, len(ordered) - hot + 1)]
        many = np.unique(met[met == ordered[hot - 1 :]])  # met `hot` times or more
        if len(many):
            is_hot = many[np.minimum(np.searchsorted(many, h), len(many) - 1)] == h
            d = doc[is_hot]
            at = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
            rows.append(((turn + 1) % (1 << bits), _PASSED, key[d[at]].tobytes(), np.diff(np.append(at, len(d))).astype(np.int32).tobytes(), h[is_hot].tobytes()))
            to = (many >> np.uint64(64 - bits)).astype(np.int64)
            for f in np.unique(to).tolist():
                rows.append((f, _MARK, b"", b"", many[to == f].tobytes()))
            h, doc = h[~is_hot], doc[~is_hot]
        frag = (h >> np.uint64(64 - bits)).astype(np.uint16 if bits <= 16 else np.int64)  # two bytes sort by radix
        order = np.argsort(frag, kind="stable")
        h, doc, frag = h[order], doc[order], frag[order]
        six = (h >> drop).view(np.uint8).reshape(-1, 8)[:, :6]
        cuts = np.flatnonzero(np.concatenate([[True], frag[1:] != frag[:-1]])) if len(h) else np.zeros(0, np.int64)
        for i, j in zip(cuts.tolist(), [*cuts[1:].tolist(), len(h)], strict=True):
            d = doc[i:j]
            at = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
            rows.append((int(frag[i]), _PART, key[d[at]].tobytes(), np.diff(np.append(at, j - i)).astype(np.int32).tobytes(), np.ascontiguousarray(six[i:j]).tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        keys: list[int] = []
        sets: list[np.ndarray] = []
        held = turn = 0
        for _, texts in slices(batches, "text"):
            for s in shingle_sets(texts, width):
                if len(s) and (k := _key(s)) not in seen:
                    seen.add(k)
                    keys.append(k)
                    sets.append(s)
                    held += len(s)
            if held >= most:
                yield flush(keys, sets, turn := turn + (keys[0] & 1023))
                keys, sets, held = [], [], 0
        if keys:
            yield flush(keys, sets, turn + (keys[0] & 1023))

    return df.select(F.col(f"`{text}`").alias("text")).mapInArrow(tidy(run), schema)


def _share_in_fragment(group: pa.Table, bits: int) -> pa.Table:
    """Rows (key, n, shared, entries) for the sets of one fragment: entries are the hashes of its n-grams that other sets have too."""
    frag = group.column("frag")[0].as_py()
    kind = group.column("kind")

    def of(k: int, item: type = np.uint64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The numbers in the rows of one kind, all rows of a column as one array, without another copy."""
        rows = group.filter(pc.equal(kind, k))
        out = []
        for c, t in (("keys", np.int64), ("counts", np.int32), ("hashes", item)):
            x = pa.concat_arrays(rows.column(c).chunks) if rows.num_rows else pa.array([], pa.binary())
            ends = np.frombuffer(x.buffers()[1], np.int32, len(x) + 1, 4 * x.offset) if len(x) else np.zeros(1, np.int32)
            out.append(np.frombuffer(x.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(t) if ends[-1] > ends[0] else np.zeros(0, t))
        return tuple(out)

    key, size, _ = of(_SIZE)
    passed_key, passed_count, passed = of(_PASSED)
    marked = np.unique(of(_MARK)[2])
    keys, counts, six = of(_PART, np.uint8)
    h = np.zeros((len(six) // 6, 8), np.uint8)
    h[:, :6] = six.reshape(-1, 6)
    h = (h.view(np.uint64)[:, 0] << np.uint64(max(0, 16 - bits))) | np.uint64(frag << (64 - bits))
    del six
    doc = np.repeat(keys, counts)
    order = np.lexsort((doc, h))
    h, doc = h[order], doc[order]
    del order, keys, counts
    if len(h):
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])])
        h, doc = h[new], doc[new]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    count = np.diff(np.append(first, len(h)))
    shared = np.repeat(count > 1, count)
    if len(marked) and len(h):
        shared |= marked[np.minimum(np.searchsorted(marked, h), len(marked) - 1)] == h
    h = np.concatenate([h[shared], passed])
    doc = np.concatenate([doc[shared], np.repeat(passed_key, passed_count)])
    order = np.argsort(doc, kind="stable")
    h, doc = h[order], doc[order]
    at = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])) if len(doc) else np.zeros(0, np.int64)
    ends = np.append(at, len(doc))
    parts = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer((8 * ends).astype(np.int32)), pa.py_buffer(h)])
    del h, order
    give_back()
    return pa.table(
        {
            "key": pa.array(np.concatenate([key, doc[at]])),
            "n": pa.array(np.concatenate([size, np.zeros(len(at), np.int32)]).astype(np.int64)),
            "shared": pa.array(np.concatenate([np.zeros(len(key), np.int64), np.diff(ends)])),
            "entries": pa.concat_arrays([pa.nulls(len(key), pa.binary()), parts]),
        }
    )


_LOT = 1024  # sets of a part that meet its row in one place
_PLAIN = 16  # sets of at most so many n-grams take each n-gram for a part
_LEVEL, _EMPTY = 0xD1B54A32D192ED03, 0x8CB92BA72F3D8DD7


def parts_index(hashes: np.ndarray, size: int, percent: int) -> list[tuple[np.ndarray, int]]:
    """For each level of sizes: the parts of a set by which its candidates may be found, as hashes, and how many of the
    commonest ones it can do without. Sets that link share one of the others.

    hashes: the n-grams that other sets have too, sorted; size: of the whole set. Linked sets of sizes s and t differ in at
    most (s + t) * (100 - percent) / (100 + percent) n-grams, so of the fragments of the order, which are more, most have
    equal parts in both. If both sets take the first few of their parts in one global order (rare ones first, empty ones
    last), one more than the fragments that may differ, they meet. The number of fragments is that of a level (a power of
    two); a set whose partners may be of the next level is in both.
    """
    unshared = size - len(hashes)
    out = []
    level = max(_PLAIN, 1 << (size - 1).bit_length())
    while True:
        reach = (size + min(level, size * 100 // percent)) * (100 - percent) // (100 + percent) - unshared
        salt = mix(np.array([level * _LEVEL % (1 << 64)], np.uint64))[0]
        if reach >= 0 and len(hashes):
            if level == _PLAIN:
                part = mix(hashes ^ salt)
            else:
                n = 2 * level * (100 - percent) // (100 + percent) * 5 // 4 + 2
                frag = (hashes >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)
                at = np.flatnonzero(np.concatenate([[True], frag[1:] != frag[:-1]]))
                part = mix(np.add.reduceat(mix(hashes), at) ^ mix(frag[at] + salt))
                if len(at) <= reach:
                    empty = np.setdiff1d(np.arange(n), frag[at])[: reach + 1 - len(at)]
                    part = np.concatenate([part, mix(empty.astype(np.uint64) * np.uint64(_EMPTY) + salt)])
            out.append((part, max(0, len(part) - reach - 1)))
        if size * 100 // percent <= level:
            return out
        level *= 2


def _indexed(percent: int, fragments: int, stars: int):
    """Per set: its parts for the index, each with twice the number of parts of its level that may go, plus one for every second
    level; of each level the `stars` least parts by a hash; and its shared n-grams by fragment of the order. No row for sets
    that can have no partner."""
    borders = (np.arange(1, fragments) * ((1 << 64) // fragments)).astype(np.uint64) if fragments > 1 else np.zeros(0, np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b.slice(lo, 512) for b in batches for lo in range(0, b.num_rows, 512)):
            keys, sizes, index, spare, grams, g_ends, ends, least, least_ends = [], [], [], [], [], [], [], [], []
            for key, n, parts in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                h = np.unique(np.frombuffer(b"".join(parts), np.uint64))  # copies in two tasks may have passed the same n-gram on
                found = parts_index(h, n, percent)
                if found:
                    keys.append(key)
                    sizes.append(n)
                    index += [part.view(np.int64) for part, _ in found]
                    spare += [np.full(len(part), 2 * more + i % 2, np.int32) for i, (part, more) in enumerate(found)]
                    ends.append(sum(len(part) for part, _ in found))
                    first = [np.partition(mix(part), min(stars, len(part)) - 1)[:stars] for part, _ in found]
                    least += [x.view(np.int64) for x in first]
                    least_ends.append(sum(map(len, first)))
                    grams.append(h.view(np.int64))
                    g_ends.append(np.diff(np.concatenate([[0], np.searchsorted(h, borders), [len(h)]])))
            ends_of = lambda x: pa.array(np.concatenate([[0], np.cumsum(x)]).astype(np.int32))
            flat = lambda x, t=np.int64: pa.array(np.concatenate(x) if x else np.zeros(0, t))
            parts_of = pa.StructArray.from_arrays([flat(index), flat(spare, np.int32)], ["part", "spare"])
            by_fragment = pa.ListArray.from_arrays(ends_of(np.concatenate(g_ends) if g_ends else []), flat(grams))
            every = pa.array(np.arange(len(keys) + 1, dtype=np.int32) * fragments)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(ends_of(ends), parts_of), pa.ListArray.from_arrays(ends_of(least_ends), flat(least)), pa.ListArray.from_arrays(every, by_fragment)], ["key", "n", "index", "stars", "grams"])

    return run


def linked_pairs(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that link. Each fragment counts a pair's overlap in its range; the counts are summed for the pair.

    sets: (key, n, grams), grams an array for each fragment. A pair meets one fragment's part of both sets at a time, and a
    set in many pairs is spread by fragment.
    """
    parts = sets.select("key", "n", F.posexplode("grams").alias("fragment", "grams")).filter(F.size("grams") > 0)
    a = parts.select(F.col("key").alias("a"), F.col("n").alias("na"), "fragment", F.col("grams").alias("ga"))
    b = parts.select(F.col("key").alias("b"), F.col("n").alias("nb"), "fragment", F.col("grams").alias("gb"))
    partial = pairs.join(a, "a").join(b, ["b", "fragment"]).select("a", "b", "na", "nb", F.size(F.array_intersect("ga", "gb")).alias("overlap"))
    summed = partial.groupBy("a", "b", "na", "nb").agg(F.sum("overlap").alias("common"))
    return summed.filter(100 * F.col("common") >= percent * (F.col("na") + F.col("nb") - F.col("common"))).select("a", "b")


def linked(sets: list[np.ndarray], sizes: np.ndarray, percent: int, split: int | None = None, slice_width: int = 2048) -> np.ndarray:
    """Which pairs of sets link. Overlaps are counted for one slice of the global order after another, and summed.

    sets: the hashes that may be in more than one set; sizes: of the whole sets. split: only pairs across this border count.
    """
    n = len(sets)
    h, doc = np.concatenate(sets), np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(h, kind="stable")
    h, doc = h[order], doc[order]
    _, column, often = np.unique(h, return_inverse=True, return_counts=True)
    more = often[column] > 1
    doc, column = doc[more], (np.cumsum(often > 1) - 1)[column[more]]
    overlap = np.zeros((n, n), np.float32)
    width = int(column[-1]) + 1 if len(column) else 0
    for lo in range(0, width, slice_width):
        i, j = np.searchsorted(column, [lo, lo + slice_width])
        part = np.zeros((n, slice_width), np.float32)
        part[doc[i:j], column[i:j] - lo] = 1
        if split is None:
            overlap += part @ part.T
        else:
            overlap[:split, split:] += part[:split] @ part[split:].T
    common = overlap.astype(np.int64)
    links = 100 * common >= percent * (sizes[:, None] + sizes[None, :] - common)
    links &= common > 0
    np.fill_diagonal(links, False)
    return links | links.T


def spanning_roots(links: np.ndarray) -> np.ndarray:
    """The least member of each node's component."""
    root = np.arange(len(links))
    while True:
        near = np.where(links, root[None, :], len(links)).min(axis=1, initial=len(links))
        new = np.minimum(root, near)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _compare(percent: int):
    def run(group: pa.Table) -> pa.Table:
        side = group.column("side").to_numpy()
        order = np.argsort(side, kind="stable")
        key, sizes = group.column("key").to_numpy()[order], group.column("n").to_numpy()[order]
        grams = group.column("grams").combine_chunks()
        grams = grams.chunk(0) if isinstance(grams, pa.ChunkedArray) else grams
        ends, flat = grams.offsets.to_numpy(), grams.values.to_numpy().view(np.uint64)
        sets = [flat[ends[i] : ends[i + 1]] for i in order.tolist()]
        split = int((side == 0).sum())
        root = spanning_roots(linked(sets, sizes, percent, split if split < len(sets) else None))
        away = root != np.arange(len(root))
        return pa.table({"a": pa.array(key[away]), "b": pa.array(key[root[away]])})

    return run


def _blocks(groups: DataFrame, sets: DataFrame, percent: int, chunk: int) -> DataFrame:
    """Links (a, b) that join all linked sets of each group (node, root, members), by blocks of two chunks of it."""
    # Groups of up to `chunk` are one block; larger ones are cut into chunks, and every two chunks make a block.
    chunks = F.ceil(F.col("members") / F.greatest(F.lit(chunk), F.least(F.lit(16 * chunk), F.floor(F.col("members") / 32)))).cast("int")
    rows = sets.select("key", "n", F.flatten("grams").alias("grams")).join(groups.withColumnRenamed("node", "key"), "key").withColumn("chunks", chunks)
    rows = rows.withColumn("mine", F.pmod(F.xxhash64("key"), F.col("chunks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    rows = rows.select("root", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), (F.col("mine") > F.col("other")).cast("int").alias("side"), "key", "n", "grams")
    return rows.groupBy("root", "i", "j").applyInArrow(_compare(percent), "a long, b long")


def _star_pairs(sets: DataFrame) -> DataFrame:
    """(a, b): each set with one set, the same hub for all that share one of their least parts."""
    stars = sets.select("key", F.explode("stars").alias("part"))
    hubs = settle(stars.groupBy("part").agg(F.min("key").alias("hub"), F.count("*").alias("c")).filter("c > 1").drop("c"))
    choice = stars.join(hubs, "part").groupBy("key").agg(F.min("hub").alias("hub")).filter("key != hub")
    return choice.select(F.least("key", "hub").alias("a"), F.greatest("key", "hub").alias("b")).distinct()


def _open_parts(sets: DataFrame, links: DataFrame) -> DataFrame:
    """(key, part, c, comp) of the index: of each set and level the parts that sets of other components have too, without the
    commonest that may go; c: how many sets have the part."""
    known = connected_components(links, "a", "b").withColumnRenamed("node", "key")
    placed = settle(sets.select("key", "index").join(known, "key", "left").select("key", F.coalesce("root", "key").alias("comp"), "index"))
    rows = placed.select("key", "comp", F.inline("index"))
    often = rows.groupBy("part").agg(F.count("*").alias("c"), F.min("comp").alias("low"), F.max("comp").alias("high"))
    often = settle(often.filter("low != high").select("part", "c"))
    # Parts of one component alone are no one's candidates; among the others the commonest of a set and level go.
    common = F.row_number().over(W.partitionBy("key", "spare").orderBy(F.desc("c"), F.desc("part")))
    out = settle(rows.join(often, "part").withColumn("place", common).filter(F.col("place") > F.floor(F.col("spare") / 2)).select("key", "part", "c", "comp"))
    release(placed, often)
    return out


def _meet(rows: DataFrame, of_part: DataFrame) -> DataFrame:
    """rows (key, part, c) with the columns of their part's row (part, c); a part that many sets have is dealt out by set."""
    salts = F.ceil(F.col("c") / _LOT)
    left = rows.withColumn("salt", F.pmod(F.xxhash64("key"), salts))
    right = of_part.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1))).drop("c")
    return left.join(right, ["part", "salt"]).drop("salt")


def _marked(live: DataFrame, links: DataFrame) -> DataFrame:
    """(key, part, c, comp) of the parts whose sets are in two components or more."""
    known = connected_components(links, "a", "b").withColumnRenamed("node", "key")
    marked = settle(live.select("key", "part", "c").join(known, "key", "left").select("key", "part", "c", F.coalesce("root", "key").alias("comp")))
    open_ = marked.groupBy("part").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.max("c").alias("c")).filter("low != high").select("part", "c")
    out = settle(_meet(marked, open_))
    release(marked)
    return out


def _closure(live: DataFrame) -> DataFrame:
    """(node, root, members) of the groups of sets that share parts, directly or by others."""
    least = live.groupBy("part").agg(F.min("key").alias("least"), F.max("c").alias("c"))
    groups = connected_components(_meet(live, least).select("key", "least"), "key", "least")
    return groups.join(groups.groupBy("root").agg(F.count("*").alias("members")), "root")


def linked_sets(df: DataFrame, text: str, total: int, *, percent: int = 80, width: int = 5, fragment: int = 1_000_000, hot: int = 64, chunk: int = 128, fragments: int = 8, stars: int = 4, rounds: int = 1, small: int = 32) -> DataFrame:
    """(node, root) for each set that links with a different one; total: the number of shingles, for the number of fragments.

    Sets that share an index part are candidates. First each set is paired with the hub of one of its `stars` least parts, and
    the pairs are counted by fragment. In each of the `rounds` that follow, over the parts whose sets are still in different
    components, every set is paired with one candidate in another component, the same hub for all sets of a part. What is left
    is compared whole: sets that share parts form groups, compared in blocks that emit a tree of links; in groups of over 16
    chunks only parts of more than `small` sets hold a group together, and the pairs of smaller parts (at most `small` / 2 for
    each row of the index) are counted by fragment again.
    """
    bits = max(5, math.ceil(math.log2(max(1, total) / fragment)))
    cut = _fragment_rows(df, text, bits, width, hot, min(8_000_000, max(500_000, 4 << bits)))
    shared = cut.groupBy("frag").applyInArrow(lambda group: _share_in_fragment(group, bits), "key long, n long, shared long, entries binary")
    counts = shared.groupBy("key").agg(F.max("n").alias("n"), F.sum("shared").alias("shared"), F.collect_list("entries").alias("entries"))
    able = counts.filter(F.col("shared") * 100 >= F.col("n") * percent).select("key", "n", "entries")
    sets = settle(able.mapInArrow(tidy(_indexed(percent, fragments, stars)), "key long, n long, index array<struct<part: long, spare: int>>, stars array<long>, grams array<array<long>>"))

    found = [settle(linked_pairs(_star_pairs(sets), sets, percent))]
    live = _open_parts(sets, found[0])
    for turn in range(rounds):
        if live.isEmpty():
            break
        order = F.xxhash64("key", F.lit(turn))
        hubs = live.groupBy("part").agg(F.min(F.struct(order.alias("at"), "key", "comp")).alias("hub"), F.max("c").alias("c"))
        choice = _meet(live, hubs).filter("comp != hub.comp").groupBy("key").agg(F.min("hub").alias("hub"))
        pairs = choice.select(F.least("key", "hub.key").alias("a"), F.greatest("key", "hub.key").alias("b")).distinct()
        found.append(settle(linked_pairs(pairs, sets, percent)))
        before, live = live, _marked(live, reduce(DataFrame.union, found))
        release(before)
    if not live.isEmpty():
        groups = settle(_closure(live))
        large = 16 * chunk
        found.append(settle(_blocks(groups.filter(F.col("members") <= large), sets, percent, chunk)))
        rest = live.join(groups.filter(F.col("members") > large).select(F.col("node").alias("key")), "key", "left_semi")
        if not groups.filter(F.col("members") > large).isEmpty():
            rest = settle(rest)
            few = rest.filter(F.col("c") <= small)
            x, y = (few.select("part", F.col("key").alias(k), F.col("comp").alias(f"{k}_comp")) for k in "ab")
            pairs = x.join(y, "part").filter("a < b and a_comp != b_comp").select("a", "b").distinct()
            found.append(settle(linked_pairs(pairs, sets, percent)))
            found.append(settle(_blocks(_closure(rest.filter(F.col("c") > small)), sets, percent, chunk)))
    out = connected_components(reduce(DataFrame.union, found), "a", "b")
    release(live, sets, *found)
    return out


def jaccard_components(df: DataFrame, id_column: str = "doc_id", text: str = "text", *, percent: int = 80, width: int = 5, salts: int = 16) -> DataFrame:
    """(id, n_shingles, component_id) for each row: component_id is the least id reachable by links.

    Two texts link when 100 * intersection >= percent * union of their sets of distinct `width`-word shingles (A-Z
    lower-cased, split at ASCII space; fewer words: the whole sequence). Null or wordless texts: 0 shingles, linked with
    nothing. Repeated rows and ties share their component; a null id stays null, and counts for no minimum. Other columns
    are not returned. Shingles are compared by 53 bits or more of their hashes, sets by 64. All candidates are decided, none is capped: copies
    are one set, and sets already joined are not compared again. Ids are gathered per set before anything is joined, and
    rows find their set's component by set and one of `salts` numbers, so copies of one text go to many tasks.
    """
    keyed = settle(set_keys(df.select(F.col(f"`{id_column}`").alias("__id"), F.col(f"`{text}`").alias("text")), "text", ["__id"], width))
    total = keyed.agg(F.sum("n_shingles")).first()[0] or 0
    roots = linked_sets(df, text, total, percent=percent, width=width).withColumnRenamed("node", "set_key")
    sets = keyed.filter("set_key is not null").groupBy("set_key").agg(F.min("__id").alias("least"), F.count("*").alias("copies"))
    sets = sets.join(roots, "set_key", "left").filter("copies > 1 or root is not null").select("set_key", "least", F.coalesce("root", "set_key").alias("root"))
    sets = settle(sets)
    least = settle(sets.groupBy("root").agg(F.min("least").alias("component")))
    named = settle(sets.join(least, "root").select("set_key", "component", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt")))
    rows = keyed.withColumn("salt", F.pmod(F.xxhash64("__id", F.lit(1)), F.lit(salts)).cast("int"))
    joined = rows.join(named.withColumn("met", F.lit(True)), ["set_key", "salt"], "left")
    return joined.select(F.col("__id").alias(id_column), "n_shingles", F.when(F.col("met"), F.col("component")).otherwise(F.col("__id")).alias("component_id"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


#: The query as DuckDB SQL: all pairs that share a shingle, then reachability.
OP10_SQL = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
e AS MATERIALIZED (SELECT doc_id, unnest(s) AS g FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT c.a, c.b FROM c JOIN s x ON c.a = x.doc_id JOIN s y ON c.b = y.doc_id WHERE 100 * c.n >= 80 * (len(x.s) + len(y.s) - c.n)),
p AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS other FROM s UNION SELECT r.doc_id, p.b FROM r JOIN p ON r.other = p.a)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, m.component_id FROM s JOIN (SELECT doc_id, min(other) AS component_id FROM r GROUP BY 1) m ON s.doc_id = m.doc_id"""
