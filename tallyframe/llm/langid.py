"""Language ID by language-bitmask n-gram filters.

A Bloom filter whose slots are bit masks, one bit for each language: the masks in an
n-gram's slots, and-ed, name all languages that may have it, in one look-up. A text's
counts of set bits by language, corrected for each filter's false positives, decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import mix, slices, table, tidy, with_results

_LETTERS: list[np.ndarray] = []


def _letters() -> tuple[np.ndarray, np.ndarray]:
    """For each code point its lower-case form (0 if it is no letter), and whether it is a letter."""
    if not _LETTERS:
        lower = np.zeros(0x110000, np.uint32)
        for c in range(0x110000):
            s = chr(c)
            if s.isalpha():
                low = s.lower()
                lower[c] = ord(low) if len(low) == 1 else c
        _LETTERS.extend((lower, lower > 0))
    return _LETTERS[0], _LETTERS[1]


def grams(texts: list[bytes], sizes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text number) of the n-grams of letters, each word with one blank at both sides; and the texts' letters."""
    lower, _ = _letters()
    strings = [t.decode("utf-8", "replace") for t in texts]
    points = np.frombuffer(("\n" + "\n".join(strings) + "\n").encode("utf-32-le", "replace"), np.uint32)
    owner = np.repeat(np.arange(len(texts) + 1), [1] + [len(s) + 1 for s in strings])
    owner[1:] -= 1
    code = lower[points]
    letters = np.bincount(owner[code > 0], minlength=len(texts))[: len(texts)]
    use = (code > 0) | np.concatenate([[False], (code[:-1] > 0)])  # letters, and the first other character after a word
    use[0] = True
    code, owner = code[use].astype(np.uint64), owner[use]
    hashes, owners = [], []
    for n in sizes:
        if len(code) < n:
            continue
        last = len(code) - n + 1
        h = np.full(last, n, np.uint64)
        inner = np.ones(last, bool)
        for k in range(n):
            part = code[k : k + last]
            h = h * np.uint64(0x5851F42D4C957F2D) + part + np.uint64(1)
            if 0 < k < n - 1:
                inner &= part > 0
        # A gram may begin or end with a blank but must not reach over one, and belongs to the text of its second character.
        hashes.append(mix(h[inner]))
        owners.append(owner[1 : last + 1][inner] if n > 1 else owner[:last][inner])
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), letters
    return np.concatenate(hashes), np.concatenate(owners), letters


@dataclass
class LanguageFilter:
    """languages: names, one bit each; slots: masks, as many rows of slots as the languages fill words of bits; false: each
    language's rate of false positives."""

    languages: list[str]
    slots: np.ndarray
    n_hash: int
    sizes: tuple[int, ...]
    false: np.ndarray

    @classmethod
    def build(cls, grams_of: dict[str, np.ndarray], bits: int = 18, n_hash: int = 3, sizes: tuple[int, ...] = (3, 4)) -> LanguageFilter:
        names = sorted(grams_of)
        kind = np.uint8 if len(names) <= 8 else np.uint64
        width = 8 * kind().itemsize
        slots = np.zeros((max(1, -(-len(names) // width)), 1 << bits), kind)
        self = cls(names, slots, n_hash, sizes, np.zeros(len(names)))
        for i, name in enumerate(names):
            for at in self._places(grams_of[name]):
                np.bitwise_or.at(slots[i // width], at, kind(1 << i % width))
        fill = np.array([((slots[i // width] >> kind(i % width)) & kind(1)).mean() for i in range(len(names))]) if names else np.zeros(0)
        self.false = fill**n_hash
        return self

    def _places(self, h: np.ndarray) -> Iterator[np.ndarray]:
        size = np.uint64(self.slots.shape[1] - 1)
        for k in range(self.n_hash):
            yield ((h >> np.uint64(20 * k)) & size).astype(np.int64)

    def masks(self, h: np.ndarray, word: int = 0) -> np.ndarray:
        """For each n-gram the languages that may have it, of those in this word of bits."""
        places = self._places(h)
        out = self.slots[word][next(places)]
        for at in places:
            out = out & self.slots[word][at]
        return out

    def predict(self, texts: list[bytes]) -> tuple[list[str], list[float]]:
        h, owner, letters = grams(texts, self.sizes)
        total = np.bincount(owner, minlength=len(texts))
        share = np.zeros((len(texts), len(self.languages)))
        kind = self.slots.dtype.type
        width = 8 * self.slots.dtype.itemsize
        for i in range(len(self.languages)):
            if i % width == 0:
                mask = self.masks(h, i // width)
            hits = np.bincount(owner[(mask >> kind(i % width)) & kind(1) > 0], minlength=len(texts))
            # hits = true + (total - true) * false
            share[:, i] = np.maximum(0, hits - total * self.false[i]) / (1 - self.false[i])
        share /= np.maximum(1, total)[:, None]
        if not self.languages:
            return ["und"] * len(texts), [0.0] * len(texts)
        best = share.argmax(axis=1)
        top = share[np.arange(len(texts)), best]
        score = top / np.maximum(share.sum(axis=1), 1e-12)
        return [self.languages[b] if n else "und" for b, n in zip(best, letters, strict=True)], [float(min(1.0, s)) if n else 0.0 for s, n in zip(score, letters, strict=True)]


def train_filter(df: DataFrame, text: str = "text", label: str = "lang", *, rows_per_label: int = 2000, grams_per_label: int = 12_000, sizes: tuple[int, ...] = (3, 4), bits: int = 18) -> LanguageFilter:
    """Learn a filter from rows with a label.

    A bounded sample: about `rows_per_label` texts of each label (all, if it has no more different ones), chosen by their hash. Of each
    label the `grams_per_label` commonest n-grams are kept, less those that are four times as common in another. The
    driver gathers that many counts for each label; any number of labels. Rows with a null text or label teach nothing, copies
    of a text count once, and without any labelled row the filter knows no language.
    """
    rows = df.filter(F.col(f"`{label}`").isNotNull() & F.col(f"`{text}`").isNotNull()).select(F.col(f"`{text}`").alias("text"), F.col(f"`{label}`").alias("label"))
    n = {r.label: r.n for r in rows.groupBy("label").agg(F.count_distinct(F.xxhash64("text")).alias("n")).collect()}
    if not n:
        return LanguageFilter.build({}, bits=bits, sizes=sizes)
    part = F.create_map(*[x for k, v in n.items() for x in (F.lit(k), F.lit(min(1.0, rows_per_label / v)))])
    rows = rows.filter(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < F.element_at(part, F.col("label")) * (1 << 20)).dropDuplicates(["text", "label"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, list] = {}
        for batch, texts in slices(batches, "text"):
            labels = batch.column(1).to_pylist()
            for name in set(labels):
                h, _, _ = grams([t for t, k in zip(texts, labels, strict=True) if k == name], sizes)
                seen.setdefault(name, []).append(np.unique(h, return_counts=True))
        for name, parts in seen.items():
            h, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            c = np.bincount(at, weights=np.concatenate([p[1] for p in parts]), minlength=len(h))
            yield pa.RecordBatch.from_pydict({"label": pa.array([name] * len(h), pa.string()), "gram": pa.array(h.view(np.int64)), "n": pa.array(c.astype(np.int64))})

    counts = rows.mapInArrow(tidy(count), "label string, gram long, n long").groupBy("label", "gram").agg(F.sum("n").alias("n"))
    from pyspark.sql import Window as W

    total = F.sum("n").over(W.partitionBy("label"))
    best = counts.withColumn("share", F.col("n") / total).withColumn("place", F.row_number().over(W.partitionBy("label").orderBy(F.desc("n"), "gram")))
    got = best.filter(F.col("place") <= 2 * grams_per_label).select("label", "gram", "share", "place").toPandas()
    top = got.groupby("gram")["share"].transform("max")
    got = got[(got["share"] * 4 >= top) & (got["place"] <= grams_per_label)]
    return LanguageFilter.build({k: g["gram"].to_numpy(np.int64).view(np.uint64) for k, g in got.groupby("label")}, bits=bits, sizes=sizes)


def identify(df: DataFrame, model: LanguageFilter, text: str = "text", *, keep: list[str] | None = None) -> DataFrame:
    """Add lang_pred and score (the decided language's share of the corrected counts, 0 to 1).

    Null texts, and texts without a letter, are `und` with score 0; so is any text if the model knows no language. Ties go
    to the first language by name. Other columns are kept, equal names replaced. No shuffle; the model (a fixed number of
    slots) goes along with the tasks.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    return with_results(df, text, "lang_pred string, score double", lambda texts: list(shared.value.predict(texts)), keep)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null doc_id has no remainder: such a row is not held out, and teaches nothing."""
    docs = table(spark, sf_dir, "documents").withColumn("remainder", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5)
    docs = docs.withColumn("held_out", F.coalesce(F.col("remainder") == 0, F.lit(False)))
    model = train_filter(docs.filter("remainder != 0").select("text", "lang"))
    return identify(docs.select("doc_id", "held_out", "text"), model, keep=["doc_id", "held_out"])
