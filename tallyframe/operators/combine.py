"""Joins, binds and set operations of two frames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_frame, col, listed, need_columns

JOINS = {"inner": "inner", "left": "left", "right": "right", "full": "full", "semi": "left_semi", "anti": "left_anti"}
BINDS = ("bind_rows", "bind_cols")
SETS = ("intersect", "union", "setdiff")


def _equal(x: DataFrame, y: DataFrame, a: str, b: str) -> Column:
    """Keys of two kinds of numbers compare as the wider one; of otherwise different types, as strings. Nulls never match."""
    s, t = x.schema[a].dataType, y.schema[b].dataType
    left, right = F.col(f"x.`{a}`"), F.col(f"y.`{b}`")
    if s == t or (isinstance(s, T.NumericType) and isinstance(t, T.NumericType)):
        return left == right
    return left.cast("string") == right.cast("string")


def _join(x: DataFrame, y: DataFrame, left: list[str], right: list[str], how: str, suffix: str, coalesce: bool) -> DataFrame:
    x, y = x.alias("x"), y.alias("y")
    joined = x.join(y, reduce(lambda a, b: a & b, [_equal(x, y, a, b) for a, b in zip(left, right, strict=True)]), JOINS[how])
    if how in ("semi", "anti"):
        return joined
    pair = dict(zip(left, right, strict=True))
    out = []
    for c in x.columns:
        source = F.col(f"x.`{c}`")
        if c in pair and how == "right":
            source = F.col(f"y.`{pair[c]}`")
        elif c in pair and how == "full" and coalesce:
            source = F.coalesce(source, F.col(f"y.`{pair[c]}`"))
        out.append(source.alias(c))
    keep_keys = how == "full" and not coalesce
    for c in y.columns:
        if c in right and not keep_keys:
            continue
        out.append(F.col(f"y.`{c}`").alias(c + suffix if c in x.columns else c))
    return joined.select(*out)


def _among(cuts: list[Column], key: Column, first: int = 0) -> Column:
    """`first` and how many of the sorted cuts, nulls last, are under the key, by halving."""
    if not cuts:
        return F.lit(first)
    half = len(cuts) // 2
    return F.when(cuts[half] < key, _among(cuts[half + 1 :], key, first + half + 1)).otherwise(_among(cuts[:half], key, first))


def _nodes(spark: SparkSession, found, kinds: list[T.DataType], cuts: list[list[int | None]]) -> DataFrame:
    """__node from 0, and for each of `cuts` a column with the rows of `found`, an Arrow table, at these places, as structs, null for no place."""
    import pyarrow as pa

    columns, flat, width = [pa.array(range(len(cuts[0])), pa.int32())], {"__node": T.IntegerType()}, len(kinds)
    for j, at in enumerate(cuts):
        columns += found.take(pa.array(at, pa.int64())).columns
        flat |= {f"__cut{j}_{i}": kind for i, kind in enumerate(kinds)}
    local = pa.table(columns, list(flat))
    if any(isinstance(kind, T.StructType | T.ArrayType) for kind in kinds):  # tables with times inside of these are not taken
        local = [tuple(r.values()) for r in local.to_pylist()]
    structs = [F.when(F.col(f"__cut{j}_{width - 1}").isNotNull(), F.struct(*[F.col(f"__cut{j}_{i}").alias(f"k{i}") for i in range(width)])).alias(f"__cut{j}") for j in range(len(cuts))]
    return spark.createDataFrame(local, T.StructType([T.StructField(c, kind) for c, kind in flat.items()])).select("__node", *structs)


def in_ranges(df: DataFrame, order: list[str], lot: int = 50_000, near: int = 0) -> tuple[DataFrame, list[str], int]:
    """Cut the order, nulls first, into ranges of about `lot` rows, at most 4,096: the frame with __part, ascending in the order,
    and __tie, the row's hash; the columns that order a range; how many ranges there are.

    The cuts are keys of all order columns and the hash, from a sample of 16 rows for each range, and fixed once drawn. They
    are a tree of three levels with a few cuts in a node, so a row is compared with few of them, in generated code.

    With `near`, 1 to 16 (below 0: -16 to -1), and more than one range, __also is true for at least so many of the last (first)
    rows of each range that another range follows (comes before). It is true above (up to) the key that lies so many places
    before (after) the cut in the sample, and rows of the sample are rows.
    """
    hashed = [col(f.name) for f in df.schema if not isinstance(f.dataType, T.MapType | T.VariantType)]
    ranges = min(4096, df.count() // lot + 1)
    parted, by = df.withColumns({"__tie": F.xxhash64(*hashed), "__part": F.lit(0)}), [*order, "__tie"]
    if ranges == 1:
        return parted, by, 1
    parted = parted.withColumn("__key", F.struct(*[col(c).alias(f"k{i}") for i, c in enumerate(by)]))
    drawn = parted.select("__key", F.rand(7).alias("r")).orderBy("r").limit(16 * ranges).select("__key.*")
    kinds, found = [f.dataType for f in drawn.schema], drawn.orderBy(*drawn.columns).toArrow()
    hashes = found.column(len(by) - 1).to_pylist()
    found = found.take([i for i, h in enumerate(hashes) if i == 0 or h != hashes[i - 1]])  # equal rows are one cut
    borders = list(range(16, found.num_rows, 16))
    if not borders:
        return parted.drop("__key"), by, 1
    n = len(borders)
    width = next(w for w in range(2, 17) if w**3 > n)
    for step in (width**2, width, 1):
        at = [[(m * width + j) * step - 1 for m in range(width**3 // (step * width))] for j in range(1, width)]
        tree = _nodes(df.sparkSession, found, kinds, [[borders[k] if k < n else None for k in ks] for ks in at])
        under = _among([F.col(f"__cut{j}") for j in range(width - 1)], F.col("__key"))
        parted = parted.join(F.broadcast(tree), F.col("__part") == F.col("__node")).withColumn("__part", F.col("__part") * width + under).drop(*tree.columns)
    if near:
        ends = [b - near for b in borders]
        ends = _nodes(df.sparkSession, found, kinds, [[*ends, None] if near > 0 else [None, *[e if e < found.num_rows else None for e in ends]]])
        above = F.coalesce(F.col("__cut0") < F.col("__key"), F.lit(False))
        parted = parted.join(F.broadcast(ends), F.col("__part") == F.col("__node")).withColumn("__also", above if near > 0 else (F.col("__part") > 0) & ~above).drop(*ends.columns)
    return parted.drop("__key"), by, n + 1


def rows_before(parted: DataFrame, descending: bool = False) -> DataFrame:
    """(__of, __before, __n): for each range that has rows, the rows in the ranges before it (descending: after it), and its own."""
    order = F.desc("__part") if descending else F.asc("__part")
    before = F.coalesce(F.sum("__n").over(W.orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return parted.groupBy("__part").agg(F.count("*").alias("__n")).select(F.col("__part").alias("__of"), before.alias("__before"), "__n")


def numbered(df: DataFrame, order: list[str], name: str = "__row", lot: int = 50_000) -> DataFrame:
    """Add consecutive numbers from 1 in the order, nulls first.

    Rows are ranked inside each range of `in_ranges`, and the ranges' totals, one row each, give what comes before. No task
    sees all rows, also if one value of the first column has most of them.
    """
    parted, by, _ = in_ranges(df, order, lot)
    ranked = parted.withColumn(name, F.row_number().over(W.partitionBy("__part").orderBy(*map(col, by))))
    before = rows_before(parted).drop("__n")
    return ranked.join(F.broadcast(before), F.col("__part") == F.col("__of")).withColumn(name, F.col(name) + F.col("__before")).drop("__part", "__tie", "__of", "__before")


def combine(x, y, on=None, how: str = "inner", left_on=None, right_on=None, add=None, suffix: str = "_right", coalesce: bool = False, order_by=None) -> DataFrame:
    """Combine two frames.

    inner, left, right, full, semi, anti: equi-joins on `on` (or left_on, right_on); null keys never match; columns of y
    that x has too get the suffix; `add` takes only these columns of y. full keeps both keys unless `coalesce`.
    bind_rows: union by name, missing columns null. bind_cols: side by side by place in `order_by` (a column, or a pair:
    x's and y's), the shorter one padded with nulls; equal names raise. intersect, setdiff: rows of x with (without) an
    equal row in y; repeated rows stay, rows with a null are never equal. union: distinct rows of both.
    """
    x, y = as_frame(x), as_frame(y)
    if how not in {*JOINS, *BINDS, *SETS}:
        raise ValueError(f"Unknown way to combine: {how}; known: {', '.join([*JOINS, *BINDS, *SETS])}")
    if how in JOINS:
        left, right = listed(left_on) or listed(on), listed(right_on) or listed(on)
        if not left or len(left) != len(right):
            raise ValueError("A join needs `on`, or `left_on` and `right_on` of one length")
        need_columns(x, left)
        need_columns(y, right)
        if add is not None:
            need_columns(y, listed(add))
            y = y.select(*[col(c) for c in dict.fromkeys([*right, *listed(add)])])
        return _join(x, y, left, right, how, suffix, coalesce)
    if how == "bind_rows":
        return x.unionByName(y, allowMissingColumns=True)
    if how == "bind_cols":
        same = set(x.columns) & set(y.columns)
        if same:
            raise ValueError(f"Both frames have {', '.join(sorted(same))}")
        if order_by is None:
            raise ValueError("bind_cols needs order_by: rows have no order of their own")
        a, b = order_by if isinstance(order_by, tuple) else (order_by, order_by)
        x, y = numbered(x, listed(a), "__x"), numbered(y, listed(b), "__y")
        return x.join(y, F.col("__x") == F.col("__y"), "full").drop("__x", "__y")
    if how == "union":
        if x.columns != y.columns:
            raise ValueError("union needs the same columns in the same order")
        return x.union(y).distinct()
    need_columns(y, x.columns)
    return _join(x, y, x.columns, x.columns, "semi" if how == "intersect" else "anti", suffix, False)
