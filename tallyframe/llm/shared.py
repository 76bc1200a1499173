"""Helpers shared by the operators: tables in the shared folder and batches of text."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: A-Z lower-cased only and these bytes between words, in every contract.
ASCII_SPACE = b" \t\n\x0b\x0c\r"
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(ASCII_SPACE)] = True

_own: list[str] = []
_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
_SPAN = 1 << 20  # bytes hashed at once
_LONG = 1 << 16  # longer words are hashed one by one
_BASE = 0x9E3779B97F4A7C15 | 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or the one given to SparkContext.setCheckpointDir.

    Without either, one process (master local or local[n], as in tests) gets a temporary folder; a cluster raises RuntimeError,
    for tables in machine-local folders would be incomplete.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.sparkContext.getCheckpointDir()
    if not named:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("Set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _own:
            _own.append("file://" + tempfile.mkdtemp(prefix="tallyframe-"))
        named = _own[0]
    return named.rstrip("/")


def settle(df: DataFrame) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back, which cuts its lineage.

    A lost executor costs nothing behind this point, and later branches do not compute df again. An application's tables
    are in one folder, which goes when its driver ends; `release` deletes one earlier.
    """
    spark = df.sparkSession
    home = f"{shared_dir(spark)}/tallyframe/{spark.sparkContext.applicationId}"
    path = f"{home}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    where, files = _files(spark, home)
    files.deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete settled tables that nothing reads any more; other frames are left alone."""
    for df in tables:
        if path := _paths.pop(df, None):
            where, files = _files(df.sparkSession, path)
            files.delete(where, True)


def _files(spark: SparkSession, path: str) -> tuple:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def free_name(df: DataFrame, name: str) -> str:
    """The name, or with underscores behind it, that no column of df has in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


_libc: list = []


def give_back() -> None:
    """Return freed memory to the system. Python workers live on between tasks, and their allocators keep what a task has freed."""
    if not _libc:
        _libc.append(getattr(ctypes.CDLL(None), "malloc_trim", None))
    pa.default_memory_pool().release_unused()
    if _libc[0] is not None:
        _libc[0](0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow that gives its memory back when a task is done."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return wrapped


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 2 << 20) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Cut batches so that each has about `most` bytes of text (one row at least); yields it with the texts, null as b""."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        col = col.cast(pa.large_binary())
        ends = np.cumsum(np.frombuffer(col.buffers()[1], np.int64, len(col) + 1, col.offset * 8)[1:] - np.frombuffer(col.buffers()[1], np.int64, len(col) + 1, col.offset * 8)[:-1])
        start, done = 0, 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, done + most, "right")))
            yield batch.slice(start, stop - start), [t or b"" for t in col.slice(start, stop - start).to_pylist()]
            start, done = stop, int(ends[stop - 1])


def with_results(df: DataFrame, text: str, results: str, compute: Callable[[list[bytes]], list], keep: list[str] | None = None) -> DataFrame:
    """df's columns (those in `keep`, or all) and the columns of the DDL `results`, computed from slices of texts.

    A result column takes the place of an input column of the same name. Null texts count as empty.
    """
    added = T.StructType.fromDDL(results)
    names = {f.name.lower() for f in added}
    kept = [f for f in df.schema if f.name.lower() not in names and (keep is None or f.name in keep)]
    body = free_name(df, "__text")
    source = df.select(F.col(f"`{text}`").alias(body), *[F.col(f"`{f.name}`") for f in kept])
    fields = [f.name for f in kept] + [f.name for f in added]
    types = to_arrow_schema(added).types

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, body):
            new = [c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(compute(texts), types, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *new], fields)

    return source.mapInArrow(tidy(run), T.StructType([*kept, *added]))


def _powers(base: int) -> np.ndarray:
    out = np.full(_SPAN + _LONG + 1, base, np.uint64)
    out[0] = 1
    np.multiply.accumulate(out, out=out)
    return out


_tables: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


def word_hashes(buf: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash, first byte) of every word of buf, split at ASCII space; equal words, equal hashes in any process.

    A word's hash is its polynomial modulo 2**64, taken from running sums over the bytes, then mixed.
    """
    if not _tables:
        _tables.extend((_powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))))
    power, inverse = _tables
    b = np.frombuffer(buf, np.uint8)
    gap = np.ones(len(b) + 2, np.int8)
    gap[1:-1] = _IS_SPACE[b]
    edge = np.diff(gap)
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    out = np.empty(len(starts), np.uint64)
    cuts = np.searchsorted(starts, np.arange(0, len(b) + _SPAN, _SPAN))
    for i, j in zip(cuts[:-1], cuts[1:], strict=True):
        if i == j:
            continue
        s, e = starts[i:j], ends[i:j]
        ok = e - s <= _LONG
        lo = s[0]
        hi = int(e[ok].max()) if ok.any() else lo
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum((b[lo:hi].astype(np.uint64) + np.uint64(1)) * power[: hi - lo], out=sums[1:])
        a, z = np.minimum(s - lo, hi - lo), np.minimum(e - lo, hi - lo)
        out[i:j] = mix((sums[z] - sums[a]) * inverse[a] + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        for k in np.flatnonzero(~ok):
            out[i + k] = xxhash.xxh3_64_intdigest(buf[s[k] : e[k]])
    return out, starts


def documents_of(texts: list[bytes]) -> tuple[bytes, np.ndarray]:
    """All texts in one buffer, a line feed after each, and where each starts (one more than there are texts)."""
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=starts[1:])
    return b"\n".join(texts) + b"\n", starts
