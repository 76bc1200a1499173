"""The frames that charts are drawn from; drawing itself is left to others."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.bins import exact_quantiles, valid
from ..operators.common import as_frame, col, is_numeric, join_groups, listed, need_columns
from ..operators.distr import classify, value_counts
from ..operators.explore import AGGREGATES
from ..operators.hypothesis import crosstab_frame
from ..operators.moments import prop_calc
from ..operators.rows import sample_rows

GEOMS = ("dist", "hist", "density", "scatter", "bar", "line", "box", "violin")


def hist_data(data, x: str, bins: int = 30, by=None) -> DataFrame:
    """(by, bin, low, high, count): equal widths from the least to the largest value; empty bins have no row."""
    df, by = as_frame(data), listed(by)
    v = col(x).cast("double")
    df = df.filter(valid(v))
    ends = df.agg(F.min(v).alias("__lo"), F.max(v).alias("__hi"))
    width = (F.col("__hi") - F.col("__lo")) / bins
    at = F.when(width > 0, F.least(F.lit(bins - 1), F.floor((v - F.col("__lo")) / width))).otherwise(0).cast("int")
    out = df.crossJoin(F.broadcast(ends)).groupBy(*map(col, by), at.alias("bin"), "__lo", "__hi").agg(F.count("*").alias("count"))  # one row
    return out.select(*map(col, by), "bin", (F.col("__lo") + F.col("bin") * width).alias("low"), (F.col("__lo") + (F.col("bin") + 1) * width).alias("high"), "count")


def bar_data(data, x: str, y: str | None = None, agg: str = "mean", by=None) -> DataFrame:
    df = as_frame(data)
    value = F.count("*").alias("count") if y is None else AGGREGATES[agg](col(y)).alias(y)
    return df.groupBy(col(x), *map(col, listed(by))).agg(value)


def box_data(data, y: str, x=None) -> DataFrame:
    """(x, q1, median, q3, low, high): whiskers end at the last values within 1.5 ranges of the quartiles."""
    df, by = as_frame(data), listed(x)
    v = col(y).cast("double")
    df = df.filter(valid(v))
    joined = join_groups(df, exact_quantiles(df, y, [0.25, 0.5, 0.75], "__q", by), by)
    a, z = F.get("__q", F.lit(0)), F.get("__q", F.lit(2))
    out = joined.groupBy(*map(col, by), "__q").agg(F.min(F.when(v >= a - 1.5 * (z - a), v)).alias("low"), F.max(F.when(v <= z + 1.5 * (z - a), v)).alias("high"))
    return out.select(*map(col, by), a.alias("q1"), F.get("__q", F.lit(1)).alias("median"), z.alias("q3"), "low", "high")


def density_data(data, x: str, by=None, points: int = 128, bins: int = 1024) -> DataFrame:
    """(by, x, density): a Gaussian kernel over the counts of fine bins, so cost does not grow with rows after the first pass."""
    df, by = as_frame(data), listed(by)
    v = col(x).cast("double")
    df = df.filter(valid(v))
    moments = df.groupBy(*map(col, by)).agg(F.min(v).alias("lo"), F.max(v).alias("hi"), F.stddev_samp(v).alias("sd"), F.count("*").alias("n"))
    joined = df.join(moments, by) if by else df.crossJoin(F.broadcast(moments))  # one row
    width = F.greatest((F.col("hi") - F.col("lo")) / bins, F.lit(1e-12))
    cells = joined.groupBy(*map(col, by), "lo", "hi", "sd", "n", F.floor((v - F.col("lo")) / width).alias("cell")).agg(F.count("*").alias("c"))
    band = F.greatest(1.06 * F.coalesce("sd", F.lit(0.0)) * F.pow("n", F.lit(-0.2)), width)
    at = F.explode(F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.col("lo") - 3 * band + i * (F.col("hi") - F.col("lo") + 6 * band) / (points - 1)))
    spread = cells.select(*map(col, by), F.col("n"), "c", (F.col("lo") + (F.col("cell") + 0.5) * width).alias("mid"), band.alias("h"), at.alias("x"))
    weight = F.col("c") * F.exp(-F.pow((F.col("x") - F.col("mid")) / F.col("h"), F.lit(2.0)) / 2)
    return spread.groupBy(*map(col, by), "x").agg((F.sum(weight) / F.first("n") / F.first("h") / math.sqrt(2 * math.pi)).alias("density"))


def scatter_data(data, x: str, y: str, by=None, nobs: int = 1000, seed: int = 1234) -> DataFrame:
    """At most `nobs` rows, the same for a seed."""
    df = as_frame(data).select(*[col(c) for c in dict.fromkeys([x, y, *listed(by)])])
    return df if nobs is None or nobs < 0 else sample_rows(df, nobs, seed=seed)


def smooth_data(data, x: str, y: str, by=None) -> DataFrame:
    """(by, slope, intercept, n) of the straight line through all rows."""
    df = as_frame(data)
    return df.groupBy(*map(col, listed(by))).agg(F.regr_slope(col(y), col(x)).alias("slope"), F.regr_intercept(col(y), col(x)).alias("intercept"), F.regr_count(col(y), col(x)).alias("n"))


def visualize(data, x: str, y: str | None = None, geom: str | None = None, by=None, bins: int = 30, nobs: int = 1000, agg: str = "mean", nint: int = 20) -> DataFrame:
    """The frame for a chart; without `geom` a scatter if there is a y, else the distribution of x."""
    df = as_frame(data)
    need_columns(df, [x, *listed(y), *listed(by)])
    geom = geom or ("scatter" if y else "dist")
    if geom not in GEOMS:
        raise ValueError(f"Unknown chart: {geom}; known: {', '.join(GEOMS)}")
    if geom in ("scatter", "line", "box", "violin") and y is None:
        raise ValueError(f"A {geom} chart needs y")
    if geom == "dist":
        geom = "bar" if classify(df, [x], nint)[0] else "hist" if is_numeric(df, x) else "bar"
    if geom == "hist":
        return hist_data(df, x, bins, by)
    if geom == "density":
        return density_data(df, x, by)
    if geom == "bar":
        return bar_data(df, x, y, agg, by) if y or by else value_counts(df, x).select(col(x), "count")
    if geom == "box":
        return box_data(df, y, [x, *listed(by)])
    if geom == "violin":
        return density_data(df, y, [x, *listed(by)])
    if geom == "line":
        return df.select(*[col(c) for c in dict.fromkeys([x, y, *listed(by)])]).orderBy(col(x))
    return scatter_data(df, x, y, by, nobs)


def prop_plot_data(data, group: str, rvar: str, lev, break_even: float | None = None) -> DataFrame:
    """(group, rvar, break_even): shares of `lev` for bars, with the line to compare them with."""
    return prop_calc(data, group, rvar, lev).withColumn("break_even", F.lit(break_even).cast("double"))


def test_plot_data(spark, result) -> dict[str, DataFrame]:
    """The statistics and comparisons of a test as frames, for bars, intervals and tables."""
    frames = {"stats": result.stats, "comparisons": result.comparisons}
    tidy = lambda rows: [{k.replace("%", "pct").replace(".", "_"): float(v) if isinstance(v, float) else v for k, v in r.items()} for r in rows]
    return {k: spark.createDataFrame(tidy(rows)) for k, rows in frames.items() if rows}


def crosstab_plot_data(data, var1: str, var2: str, kind: str = "perc_col") -> DataFrame:
    """(var1, var2, value) for a kind: observed, expected, chisq, dev_std, perc_row, perc_col, perc."""
    if kind not in ("observed", "expected", "chisq", "dev_std", "perc_row", "perc_col", "perc"):
        raise ValueError(f"Unknown kind: {kind}")
    return crosstab_frame(as_frame(data), var1, var2).select(col(var1), col(var2), F.col(kind).cast("double").alias("value"))


def scatter_matrix_data(data, variables: list[str], nobs: int = 1000, seed: int = 1234) -> tuple[DataFrame, DataFrame]:
    """A sample of at most `nobs` rows of the variables, and (var_x, var_y, slope, intercept, n) of a line for each pair, from all rows."""
    df = as_frame(data).select(*map(col, variables))
    pairs = [(a, b) for i, a in enumerate(variables) for b in variables[:i]]
    one = df.agg(*[f(col(b), col(a)).alias(f"{k}{i}") for i, (a, b) in enumerate(pairs) for k, f in (("s", F.regr_slope), ("i", F.regr_intercept), ("n", F.regr_count))])
    lines = one.select(F.inline(F.array(*[F.struct(F.lit(a).alias("var_x"), F.lit(b).alias("var_y"), F.col(f"s{i}").alias("slope"), F.col(f"i{i}").alias("intercept"), F.col(f"n{i}").alias("n")) for i, (a, b) in enumerate(pairs)])))
    return sample_rows(df, nobs, seed=seed), lines
