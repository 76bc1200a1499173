"""Quantile bins and average ranks, the kernels of the evaluation and rank operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import as_frame, col, join_groups, listed, need_columns


def valid(x: Column) -> Column:
    """Neither null nor NaN."""
    return x.isNotNull() & ~F.isnan(x)


def range_of(x: Column, cuts: Column) -> Column:
    """How many of the sorted cuts are under x: first among every so many, then inside, so about 2 * sqrt(n) comparisons."""
    block = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(cuts))).cast("int"))
    whole = F.floor(F.size(cuts) / block).cast("int")
    before = F.when(whole > 0, F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), whole)), lambda k: F.element_at(cuts, k * block) < x))).otherwise(0)
    return F.element_at(F.transform(F.array(before), lambda k: k * block + F.size(F.filter(F.slice(cuts, k * block + 1, block), lambda c: c < x))), 1)


def running_sums(counts: DataFrame, value: str, sums: list[str], by=None, descending: bool = False, lot: int = 50_000) -> DataFrame:
    """Add {c}_upto for each of `sums`: the sum over the rows of the group up to this value. One row for each group and value.

    The values are cut into ranges of about `lot` rows (at most 4,096, in groups 512), rows are added up inside each, and the
    ranges' totals give what comes before; a window sees a range, or one row for each range.
    """
    by = listed(by)
    groups = [col(g) for g in by]
    most = 512 if by else 4096
    x = col(value).cast("double")
    cuts = counts.groupBy(*groups).agg(F.percentile_approx(x, [i / most for i in range(1, most)], 8 * most).alias("__cuts"), F.count("*").alias("__rows"))
    every = F.greatest(F.lit(1), F.floor(F.lit(float(most) * lot) / F.col("__rows"))).cast("int")
    cuts = cuts.select(*groups, F.array_distinct(F.filter("__cuts", lambda c, i: (i + 1) % every == 0)).alias("__cuts"))
    parted = join_groups(counts, cuts, by).withColumn("__part", range_of(x, F.col("__cuts"))).drop("__cuts")
    totals = parted.groupBy(*groups, "__part").agg(*[F.sum(c).alias(f"__t{i}") for i, c in enumerate(sums)])
    order = F.desc("__part") if descending else F.asc("__part")
    before = W.partitionBy(*groups).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select(*groups, "__part", *[F.coalesce(F.sum(f"__t{i}").over(before), F.lit(0)).alias(f"__b{i}") for i in range(len(sums))])
    inside = W.partitionBy(*groups, "__part").orderBy(F.desc(value) if descending else F.asc(value)).rowsBetween(W.unboundedPreceding, 0)
    joined = join_groups(parted, totals, [*by, "__part"])
    upto = {f"{c}_upto": F.col(f"__b{i}") + F.sum(c).over(inside) for i, c in enumerate(sums)}
    return joined.withColumns(upto).drop("__part", *[f"__b{i}" for i in range(len(sums))])


def place(x: Column, breaks: Column, right: bool = True, include_lowest: bool = True) -> Column:
    """The bin of x among sorted breaks, from 1; 0 outside of them (and at the border that is left out), null for null and NaN."""
    x = x.cast("double")
    first, last, m = F.element_at(breaks, 1), F.element_at(breaks, -1), F.size(breaks) - 1
    if right:
        raw = F.size(F.filter(breaks, lambda b: b < x))
        inside = (x >= first) if include_lowest else (x > first)
        bin_ = F.when(inside & (x <= last), F.greatest(F.lit(1), raw)).otherwise(0)
    else:
        raw = F.size(F.filter(breaks, lambda b: b <= x))
        inside = (x <= last) if include_lowest else (x < last)
        bin_ = F.when(inside & (x >= first), F.least(raw, m)).otherwise(0)
    return F.when(valid(x), bin_.cast("int"))


def exact_quantiles(df: DataFrame, var: str, points: list[float], name: str = "__breaks", by=None, nan: bool = False) -> DataFrame:
    """One row, or one for each group: the quantiles of a column at `points`, linear between order statistics.

    Unlike the percentile aggregate, no task holds all values: they are counted, ranked range by range, and only the two
    order statistics next to each point are picked. Nulls are left out, and NaN unless `nan`, which makes it the largest value;
    without values there is no row, or a null.
    """
    by = listed(by)
    groups = [col(g) for g in by]
    kept = df.select(*groups, col(var).cast("double").alias("__x")).filter(F.col("__x").isNotNull() if nan else valid(F.col("__x")))
    counts = kept.groupBy(*groups, "__x").agg(F.count("*").alias("__n"))
    spans = running_sums(counts, "__x", ["__n"], by)
    total = counts.groupBy(*groups).agg(F.sum("__n").alias("__all"))
    both = join_groups(spans, total, by)
    picks = []
    for i, p in enumerate(points):
        at = (F.col("__all") - 1) * p
        for k, place_ in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            inside = (F.col("__n_upto") - F.col("__n") <= place_) & (place_ < F.col("__n_upto"))
            picks.append(F.max(F.when(inside, F.col("__x"))).alias(f"__{k}{i}"))
    one = both.groupBy(*groups).agg(F.max("__all").alias("__all"), *picks)
    found = []
    for i, p in enumerate(points):
        at = (F.col("__all") - 1) * p
        found.append(F.col(f"__lo{i}") + (F.col(f"__hi{i}") - F.col(f"__lo{i}")) * (at - F.floor(at)))
    return one.select(*groups, F.when(F.col("__all").isNotNull(), F.array(*found)).alias(name))


def exact_breaks(df: DataFrame, var: str, n: int, name: str = "__breaks", by=None) -> DataFrame:
    """The n + 1 breaks of a column, of each group with `by`."""
    return exact_quantiles(df, var, [i / n for i in range(n + 1)], name, by)


def xtile(data, var: str, n: int = 5, rev: bool = False, by=None, name: str = "bin", accuracy: int | None = None) -> DataFrame:
    """Add the quantile bin of `var` (of its group, with `by`), 1 to n, right-closed; rev: the highest values get bin 1.

    Exact at every size; `accuracy` takes the approximate sketch instead. A null group is a group of its own, a null value has no bin.
    """
    df, by = as_frame(data), listed(by)
    need_columns(df, [var, *by])
    if accuracy:
        x = F.when(valid(col(var).cast("double")), col(var).cast("double"))
        breaks = df.groupBy(*map(col, by)).agg(F.percentile_approx(x, [i / n for i in range(n + 1)], accuracy).alias("__breaks"))
    else:
        breaks = exact_breaks(df, var, n, by=by)
    joined = join_groups(df, breaks, by, "left")
    b = place(col(var), F.col("__breaks"))
    return joined.withColumn(name, n + 1 - b if rev else b).drop("__breaks")


def bincode(data, var: str, breaks: list[float], right: bool = True, include_lowest: bool = True, name: str = "bin") -> DataFrame:
    """Add the bin of `var` among fixed breaks; ValueError if they are not sorted."""
    if list(breaks) != sorted(breaks):
        raise ValueError("breaks must be sorted")
    return as_frame(data).withColumn(name, place(col(var), F.array(*[F.lit(float(b)) for b in breaks]), right, include_lowest))


def average_ranks(df: DataFrame, value: str, by=None, weight: str | None = None) -> DataFrame:
    """(by, value, n, rank): one row for each distinct value; rank is the mean rank of its rows (weights count rows).

    Values are counted first; the running sum over them goes range by range, so no task sees all values.
    """
    by = listed(by)
    n = F.sum(col(weight)) if weight else F.count(F.lit(1))
    counts = df.filter(col(value).isNotNull()).groupBy(*map(col, by), col(value)).agg(n.cast("double").alias("n"))
    ranked = running_sums(counts, value, ["n"], by)
    return ranked.select(*map(col, by), col(value), "n", (F.col("n_upto") - (F.col("n") - 1) / 2).alias("rank"))
