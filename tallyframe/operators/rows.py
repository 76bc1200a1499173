"""Operators on rows: samples, shuffles, training flags, lags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .combine import in_ranges, numbered, rows_before
from .common import as_frame, col, listed, need_columns

_LOT = 4096  # copies of a row that are listed at once
_EDGES = 100_000  # last rows of ranges that go to every task
_NEAR = 16  # rows of a shift that the sample of the ranges can tell


def sample_rows(data, n: int, key=None, seed: int = 1234) -> DataFrame:
    """Exactly n rows (all, if there are fewer), the same for a seed; `key`: columns that tell all rows apart.

    Without a key equal rows are counted and numbered, so that each copy is drawn on its own.
    """
    df = as_frame(data)
    keys = [col(c) for c in listed(key) or df.columns]
    if key is not None:
        return df.orderBy(F.xxhash64(F.lit(seed), *keys), *keys).limit(n)
    counts = df.groupBy(*keys).agg(F.count("*").alias("__n"))
    lots = counts.withColumn("__lot", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__n") - 1) / _LOT))))
    first = F.col("__lot") * _LOT
    copies = lots.withColumn("__copy", F.explode(F.sequence(first + 1, F.least(F.col("__n"), first + _LOT))))
    return copies.orderBy(F.xxhash64(F.lit(seed), *keys, F.col("__copy")), *keys, "__copy").limit(n).select(*keys)


def shuffle_column(data, name: str, key, seed: int = 1234) -> DataFrame:
    """Permute one column; `key` (unique) gives the rows their order, its hash the new one."""
    df, key = as_frame(data), listed(key)
    rows = numbered(df.drop(name), key, "__at")
    moved = df.select(col(name), F.xxhash64(F.lit(seed), *map(col, key)).alias("__h"), *[col(k).alias(f"__k{i}") for i, k in enumerate(key)])
    moved = numbered(moved, ["__h", *[f"__k{i}" for i in range(len(key))]], "__to").select(col(name), "__to")
    return rows.join(moved, F.col("__at") == F.col("__to")).select(*map(col, df.columns))


def make_train(data, key, strat_var=None, test_size: float = 0.3, seed: int = 1234, name: str = "training") -> DataFrame:
    """Add a 0/1 training flag. With strata exactly the rounded share of each is for the test; without, each row by its hash."""
    df, key, strata = as_frame(data), listed(key), listed(strat_var)
    need_columns(df, [*key, *strata])
    draw = F.xxhash64(F.lit(seed), *map(col, key))
    if not strata:
        return df.withColumn(name, (F.pmod(draw, F.lit(1_000_000)) >= int(test_size * 1_000_000)).cast("int"))
    # Ranks in sixty-four parts of each stratum by the draw, so that no stratum is one task.
    parted = df.withColumn("__draw", draw).withColumn("__part", F.shiftright("__draw", 58))
    groups = [col(s) for s in strata]
    totals = parted.groupBy(*groups, "__part").agg(F.count("*").alias("__n"))
    within = W.partitionBy(*groups)
    totals = totals.withColumn("__before", F.coalesce(F.sum("__n").over(within.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).withColumn("__all", F.sum("__n").over(within)).drop("__n")
    renamed = totals.select(*[g.alias(f"__s{i}") for i, g in enumerate(groups)], F.col("__part").alias("__p"), "__before", "__all")
    same = F.col("__part") == F.col("__p")
    for i, g in enumerate(groups):
        same = same & g.eqNullSafe(F.col(f"__s{i}"))
    rank = F.row_number().over(W.partitionBy(*groups, "__part").orderBy("__draw", *map(col, key)))
    out = parted.withColumn("__rank", rank).join(renamed, same)
    return out.withColumn(name, (F.col("__before") + F.col("__rank") > F.round(F.col("__all") * test_size)).cast("int")).select(*map(col, df.columns), name)


def shifted(data, x: str, order_by, num: int = 1, fill=None, name: str | None = None, lot: int = 50_000) -> DataFrame:
    """Add the value of `x` from `num` rows before in the order of the whole table (after, for a negative `num`), as `name`.

    lag and lead without `by` would order the whole table in one task; here each range of about `lot` rows is shifted by
    itself. For up to 16 rows each range also gets copies of the last rows of the range before it (the first ones of the range
    after it), so one shuffle does it all. For more rows the last rows of the ranges, a small table, are joined to the first rows
    of those that follow. Where that table would have over 100,000 rows, rows are numbered range by range and joined on the
    number instead. Rows without such a neighbour, and null values, get `fill`.
    """
    df = as_frame(data)
    need_columns(df, [x, *listed(order_by)])
    n, back = abs(num), num < 0
    near = num if 0 < n <= _NEAR else 0
    parted, by, ranges = in_ranges(df, listed(order_by), lot, near)
    if n * ranges > _EDGES:
        rows = numbered(df, listed(order_by), "__at", lot)
        other = rows.select((F.col("__at") + num).alias("__to"), col(x).alias("__x"))
        out = rows.join(other, F.col("__at") == F.col("__to"), "left")
    elif near and ranges > 1:
        part, beside = F.col("__part"), F.col("__part") + (-1 if back else 1)
        copied = parted.withColumn("__in", F.explode(F.when(F.col("__also"), F.array(part, beside)).otherwise(F.array(part))))
        shift = (F.lead if back else F.lag)(col(x), n).over(W.partitionBy("__in").orderBy(*map(col, by)))
        out = copied.withColumn("__x", shift).filter(F.col("__in") == part)
    else:
        up, down = (W.partitionBy("__part").orderBy(*keys) for keys in ([col(c).asc() for c in by], [col(c).desc() for c in by]))
        way, against = (down, up) if back else (up, down)
        before = F.broadcast(rows_before(parted, back))
        inside = parted.withColumns({"__near": F.lag(col(x), n).over(way), "__rank": F.row_number().over(way)})
        inside = inside.join(before.drop("__n"), F.col("__part") == F.col("__of")).withColumn("__need", F.when(F.col("__rank") <= n, F.col("__before") + F.col("__rank") - n))
        lasts = parted.select("__part", *[col(c) for c in by if c != x], col(x)).withColumn("__rank", F.row_number().over(against)).filter(F.col("__rank") <= n)
        edges = lasts.join(before, F.col("__part") == F.col("__of")).select((F.col("__before") + F.col("__n") + 1 - F.col("__rank")).alias("__at"), col(x).alias("__far"))
        out = inside.join(F.broadcast(edges), F.col("__need") == F.col("__at"), "left").withColumn("__x", F.when(F.col("__rank") <= n, F.col("__far")).otherwise(F.col("__near")))
    value = F.col("__x") if fill is None else F.coalesce("__x", F.lit(fill))
    return out.select(*map(col, df.columns), value.alias(name or f"{x}_{'lag' if num > 0 else 'lead'}"))


def lag(x: str | Column, order_by, num: int = 1, fill=None, by=None) -> Column:
    """The value `num` rows before in the order; `fill` replaces every null of the result. Without `by` one task orders the
    whole table: `shifted` does that for large ones."""
    c = F.lag(col(x) if isinstance(x, str) else x, num).over(W.partitionBy(*map(col, listed(by))).orderBy(*map(col, listed(order_by))))
    return c if fill is None else F.coalesce(c, F.lit(fill))


def lead(x: str | Column, order_by, num: int = 1, fill=None, by=None) -> Column:
    c = F.lead(col(x) if isinstance(x, str) else x, num).over(W.partitionBy(*map(col, listed(by))).orderBy(*map(col, listed(order_by))))
    return c if fill is None else F.coalesce(c, F.lit(fill))
