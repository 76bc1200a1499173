"""Summary statistics by column and group."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bins import exact_quantiles
from .common import as_frame, col, join_groups, listed, need_columns, numeric_columns

#: The names of statistics and what each computes, nulls left out but for the counts of them.
AGGREGATES: dict[str, Callable[[Column], Column]] = {
    "mean": F.avg,
    "median": F.median,
    "sum": F.sum,
    "std": F.stddev_samp,
    "sd": F.stddev_samp,
    "var": F.var_samp,
    "min": F.min,
    "max": F.max,
    "count": F.count,
    "n": F.count,
    "n_unique": lambda c: F.count_distinct(c) + F.coalesce(F.max(c.isNull().cast("int")), F.lit(0)),
    "n_missing": lambda c: F.count_if(c.isNull()),
    "null_count": lambda c: F.count_if(c.isNull()),
}
DEFAULT = ("mean", "median", "min", "max", "sd")


def medians(df: DataFrame, cols: list[str], by: list[str]) -> DataFrame:
    """One row (for each group): {column}_median. The columns are put below each other and all medians found in one plan."""
    below = F.inline(F.array(*[F.struct(F.lit(i).alias("__i"), col(c).cast("double").alias("__v")) for i, c in enumerate(cols)]))
    found = exact_quantiles(df.select(*map(col, by), below), "__v", [0.5], "__m", [*by, "__i"], nan=True)
    return found.groupBy(*map(col, by)).agg(*[F.max(F.when(F.col("__i") == i, F.get("__m", F.lit(0)))).alias(f"{c}_median") for i, c in enumerate(cols)])


def explore(data, cols=None, agg=None, by=None) -> DataFrame:
    """With `by` one row for each group, columns {column}_{statistic}; without, one row for each statistic and a column of
    doubles for each variable. One aggregation, and one more plan for medians, in which no task holds all values of a column.
    A null is a value of its own for n_unique, and a null group a group of its own."""
    df = as_frame(data)
    names = listed(agg) or list(DEFAULT)
    unknown = [a for a in names if a not in AGGREGATES]
    if unknown:
        raise ValueError(f"Unknown statistics: {', '.join(unknown)}; known: {', '.join(AGGREGATES)}")
    by = listed(by)
    cols = listed(cols) or [c for c in numeric_columns(df) if c not in by]
    if not cols:
        raise ValueError("There are no numeric columns")
    need_columns(df, cols + by)
    plain = [a for a in names if a != "median"]
    one = df.groupBy(*map(col, by)).agg(F.count("*").alias("__rows"), *[AGGREGATES[a](col(c)).alias(f"{c}_{a}") for c in cols for a in plain])
    if "median" in names:
        one = join_groups(one, medians(df, cols, by), by, "left")
    if by:
        return one.select(*map(col, by), *[col(f"{c}_{a}") for c in cols for a in names])
    one = one.select(*[col(f"{c}_{a}").cast("double").alias(f"{i}_{j}") for i, c in enumerate(cols) for j, a in enumerate(names)])
    rows = F.array(*[F.struct(F.lit(a).alias("statistic"), *[F.col(f"{i}_{j}").alias(c) for i, c in enumerate(cols)]) for j, a in enumerate(names)])
    return one.select(F.inline(rows))
