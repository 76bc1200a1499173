import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from tallyframe.llm import jaccard as J
from tallyframe.llm.components import connected_components


def shingles(text, width=5):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])


def brute(rows):
    """component_id by all pairs."""
    sets = [(i, shingles(t)) for i, t in rows]
    parent = list(range(len(sets)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    where = defaultdict(list)
    for k, (_, s) in enumerate(sets):
        for g in s:
            where[g].append(k)
    for k, (_, s) in enumerate(sets):
        for m, n in Counter(m for g in s for m in where[g] if m < k).items():
            if 100 * n >= 80 * (len(s) + len(sets[m][1]) - n):
                parent[find(k)] = find(m)
    least = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return [(i, len(s), least.get(find(k)) if s else i) for k, (i, s) in enumerate(sets)]


@pytest.fixture(scope="module")
def copies():
    """Chains and stars of near copies around the limit, exact copies, and a passage in many texts."""
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(3000)]
    passage = " ".join(rng.choices(vocabulary, k=60))
    rows = []
    for _ in range(6):
        base = rng.choices(vocabulary, k=rng.choice([6, 30, 120]))
        for _ in range(40):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 22))):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            rows.append(" ".join(w))
    for i in range(150):
        rows.append(" ".join(rng.choices(vocabulary, k=rng.randint(3, 80))) + (" " + passage if i % 2 else ""))
    rows += [passage] * 30 + [passage.upper()] * 5 + ["B a c d e", "a B c d e", "x", "X ", None, "", "  "]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("chunk,fragment,hot,rounds", [(128, 4_000_000, 64, 1), (8, 500, 4, 2), (1, 500, 4, 0)])
def test_components_equal_brute_force(spark, copies, chunk, fragment, hot, rounds):
    df = spark.createDataFrame(copies, "doc_id long, text string").repartition(5)
    if chunk == 128:
        got = J.jaccard_components(df)
        assert sorted(map(tuple, got.collect())) == sorted(brute(copies))
        return
    keys = {r.doc_id: r.set_key for r in J.set_keys(df, "text", ["doc_id"]).collect()}
    roots = {r.node: r.root for r in J.linked_sets(df, "text", 20_000, chunk=chunk, fragment=fragment, hot=hot, rounds=rounds, small=4).collect()}
    groups = defaultdict(set)
    for i, n, _ in brute(copies):
        if n:
            groups[roots.get(keys[i], keys[i])].add(i)
    want = defaultdict(set)
    for i, n, c in brute(copies):
        if n:
            want[c].add(i)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_edge_table(spark, edge, empty):
    got = J.jaccard_components(edge).collect()
    assert Counter(map(tuple, got)) == Counter(brute([(r.doc_id, r.text) for r in edge.collect()]))
    assert J.jaccard_components(empty).count() == 0
    assert J.jaccard_components(edge.filter("text is null")).count() == 2


def test_query(spark):
    from .conftest import SF

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert sorted(map(tuple, J.op10_jaccard_join(spark, SF).collect())) == sorted(brute(rows))


def test_linked_sets_share_a_part():
    """Random pairs at and above the limit always meet in the index; unlike sets hardly ever do."""
    rng = np.random.default_rng(6)
    met = unlike = 0
    for trial in range(600):
        n = int(rng.choice([1, 4, 5, 9, 14, 16, 17, 30, 33, 64, 65, 150, 400, 1100]))
        base = rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2)
        most = 2 * n * 20 // 180
        out = int(rng.integers(0, most // 2 + 1)) if trial % 2 else most // 2
        more = rng.integers(0, 1 << 63, max(0, most - 2 * out) if trial % 3 else out).astype(np.uint64)
        x, y = np.unique(base), np.unique(np.concatenate([base[out:], more]))
        common = len(np.intersect1d(x, y))
        if not common or 100 * common < 80 * (len(x) + len(y) - common):
            continue
        shared = np.intersect1d(x, y)
        parts = []
        for z in (x, y):
            kept = np.union1d(shared, z[rng.random(len(z)) < 0.5])  # what no other set has is left out
            parts.append(J.parts_index(np.intersect1d(kept, z), len(z), 80))
        chosen = [set(), set()]
        order = {p: (int(rng.integers(0, 3)), p) for i in parts for part, _ in i for p in part.tolist()}  # any global order will do
        for out_, index in zip(chosen, parts, strict=True):
            for part, more in index:
                mine = sorted(part.tolist(), key=order.get)
                out_ |= set(mine[: len(mine) - more])
        assert chosen[0] & chosen[1]
        met += 1
        if n > 16:
            other = np.sort(np.concatenate([base[: n // 10], rng.integers(0, 1 << 63, n - n // 10).astype(np.uint64)]))
            unlike += bool(chosen[0] & {p for part, _ in J.parts_index(other, n, 80) for p in part.tolist()})
    assert met > 300 and unlike < 0.4 * met


def test_texts_of_shared_passages_stay_apart(spark):
    """Texts put together from a pool of passages link with nothing: rows compared stay in proportion to the texts."""
    rng = random.Random(8)
    pool = [" ".join(rng.choices([f"v{i}" for i in range(2000)], k=40)) for _ in range(60)]
    rows = [(i, " ".join(rng.sample(pool, 10))) for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    seen = []
    real = J.linked_pairs
    blocks = J._blocks

    def counted(pairs, sets, percent):
        seen.append(pairs.count())
        return real(pairs, sets, percent)

    def counted_blocks(groups, sets, percent, chunk):
        seen.append(groups.count())
        return blocks(groups, sets, percent, chunk)

    J.linked_pairs, J._blocks = counted, counted_blocks
    try:
        got = J.jaccard_components(df).collect()
    finally:
        J.linked_pairs, J._blocks = real, blocks
    assert all(r.component_id == r.doc_id for r in got) and sum(seen) < 4 * len(rows)


def test_near_copies_cost_a_tree(spark):
    rng = random.Random(9)
    base = rng.choices([f"v{i}" for i in range(2000)], k=300)
    rows = []
    for i in range(1200):
        w = list(base)
        w[rng.randrange(300)] = f"x{i}"
        rows.append((i, " ".join(w)))
    got = J.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()
    assert len(got) == 1200 and {r.component_id for r in got} == {0}


def test_slices_and_roots():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, 40).astype(np.uint64)) for _ in range(20)]
    sizes = np.array([len(s) for s in sets])
    want = np.array([[i != j and 100 * len(np.intersect1d(a, b)) >= 36 * len(np.union1d(a, b)) for j, b in enumerate(sets)] for i, a in enumerate(sets)])
    assert want.any() and (J.linked(sets, sizes, 36, slice_width=7) == want).all()
    across = want.copy()
    across[:9, :9] = across[9:, 9:] = False
    assert (J.linked(sets, sizes, 36, split=9) == across).all()
    chain = np.zeros((50, 50), bool)
    chain[np.arange(49), np.arange(1, 50)] = chain[np.arange(1, 50), np.arange(49)] = True
    assert (J.spanning_roots(chain) == 0).all()


def test_connected_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 180)] + [(5, 5), (None, 3), (200, 201), (200, 201)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "x long, y long"), "x", "y").collect()}
    assert len({got[i] for i in range(61)}) == 1 and len({got[i] for i in range(100, 180)}) == 1
    assert len(set(got.values())) == 3 and len(got) == 61 + 80 + 2
    assert connected_components(spark.createDataFrame([], "x long, y long"), "x", "y").count() == 0
