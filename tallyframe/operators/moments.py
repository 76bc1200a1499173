"""Means, variances and standardising, weighted or not: one aggregation each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_frame, col, listed, need_columns, numeric_columns, ratio


def group_moments(df: DataFrame, by, var: str) -> DataFrame:
    """(by, mean, n, n_missing, sd, se) of a column in each group."""
    by = listed(by)
    n = F.count(col(var))
    out = df.groupBy(*map(col, by)).agg(F.avg(col(var)).alias("mean"), n.alias("n"), F.count_if(col(var).isNull()).alias("n_missing"), F.stddev_samp(col(var)).alias("sd"))
    return out.withColumn("se", ratio(F.col("sd"), F.sqrt("n")))


def proportions(data, var: str) -> DataFrame:
    """One row for a 0/1 column: p, var p(1-p), sd, se."""
    df = as_frame(data)
    p = F.avg(col(var).cast("double"))
    out = df.agg(p.alias("p"), F.count(col(var)).alias("n"))
    spread = F.col("p") * (1 - F.col("p"))
    return out.select("p", "n", spread.alias("var"), F.sqrt(spread).alias("sd"), F.sqrt(ratio(spread, F.col("n"))).alias("se"))


def _weighted(x: Column, w: Column, n: int) -> tuple[Column, Column]:
    both = x.isNotNull() & w.isNotNull()
    w = F.when(both, w.cast("double"))
    return ratio(F.sum(x * w), F.sum(w)), F.sum(w)


def weighted_moments(data, weight: str, columns=None, ddof: int = 0) -> DataFrame:
    """(variable, mean, sd): sums of w x / sums of w, and the root of sums of w (x - mean)^2 / (sums of w - ddof).

    The second pass is over centred values, so large means cost no digits. Rows with a null value or weight are left out.
    """
    df = as_frame(data)
    cols = listed(columns) or [c for c in numeric_columns(df) if c != weight]
    need_columns(df, [*cols, weight])
    w = col(weight)
    means = df.agg(*[_weighted(col(c).cast("double"), w, 0)[0].alias(f"m{i}") for i, c in enumerate(cols)])
    joined = df.crossJoin(F.broadcast(means))  # one row
    spread = []
    for i, c in enumerate(cols):
        both = col(c).isNotNull() & w.isNotNull()
        d = col(c).cast("double") - F.col(f"m{i}")
        spread += [F.first(f"m{i}").alias(f"m{i}"), F.sqrt(ratio(F.sum(F.when(both, w * d * d)), F.sum(F.when(both, w)) - ddof)).alias(f"s{i}")]
    one = joined.agg(*spread)
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(f"m{i}").alias("mean"), F.col(f"s{i}").alias("sd")) for i, c in enumerate(cols)])))


def scale_df(data, weight: str | None = None, sf: float = 1, exclude=None, train: Column | str | None = None, ddof: int = 0, means: dict | None = None, sds: dict | None = None, stats: bool = False):
    """Standardise numeric columns: (x - mean) / (sf * sd), the scaled columns after the others.

    Columns with only the values 0 and 1 stay. Moments come from rows where `train` holds, or are given. With stats also
    (means, sds) are returned. Nulls stay null; a column without spread becomes null.
    """
    df = as_frame(data)
    cols = [c for c in numeric_columns(df) if c not in listed(exclude) and c != weight]
    train = F.lit(True) if train is None else F.expr(train) if isinstance(train, str) else train
    if means is None or sds is None:
        value = {c: F.when(train, col(c).cast("double")) for c in cols}
        kinds = df.agg(*[F.count_if(col(c).isNotNull() & ~col(c).isin(0, 1)).alias(str(i)) for i, c in enumerate(cols)]).first() if cols else []
        cols = [c for c, k in zip(cols, kinds, strict=True) if k]
        if weight:
            rows = weighted_moments(df.filter(train), weight, cols, ddof).collect() if cols else []
            means, sds = {r.variable: r["mean"] for r in rows}, {r.variable: r.sd for r in rows}
        else:
            sd = F.stddev_samp if ddof else F.stddev_pop
            row = df.agg(*[f(value[c]).alias(f"{k}{i}") for i, c in enumerate(cols) for k, f in (("m", F.avg), ("s", sd))]).first() if cols else []
            means, sds = {c: row[2 * i] for i, c in enumerate(cols)}, {c: row[2 * i + 1] for i, c in enumerate(cols)}
    else:
        cols = [c for c in cols if c in means]
    scaled = [F.try_divide(col(c) - F.lit(means[c]), F.lit(sf * (sds[c] or 0.0))).alias(c) for c in cols]
    out = df.select(*[col(c) for c in df.columns if c not in cols], *scaled)
    return (out, means, sds) if stats else out


def prop_calc(data, group: str, rvar: str, lev) -> DataFrame:
    """(group, rvar): the share of rows of each group whose rvar is lev; nulls are left out."""
    return as_frame(data).groupBy(col(group)).agg(F.avg((col(rvar) == F.lit(lev)).cast("int")).alias(rvar))
