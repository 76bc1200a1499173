"""Distribution summaries by kind of column."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_frame, col, is_integer, is_numeric, join_groups, listed, named, need_columns
from .explore import explore


def value_counts(data, var: str, by=None) -> DataFrame:
    """Counts of the values. Ungrouped: count, proportion, n_unique, mode and n_missing; with `by`: count and proportion in each group."""
    df, by = as_frame(data), listed(by)
    need_columns(df, [var, *by])
    counts = df.groupBy(*map(col, by), col(var)).agg(F.count("*").alias("count"))
    if by:
        return counts.withColumn("proportion", F.col("count") / F.sum("count").over(W.partitionBy(*map(col, by))))
    whole = counts.agg(
        F.sum("count").alias("__all"),
        F.count(F.lit(1)).alias("n_unique"),
        F.max(F.struct(F.col("count").alias("c"), col(var).alias("v")))["v"].alias("mode"),
        F.coalesce(F.sum(F.when(col(var).isNull(), F.col("count"))), F.lit(0)).alias("n_missing"),
    )
    values = counts.withColumnRenamed(var, "__value")
    out = join_groups(values, whole, []).withColumn("proportion", F.col("count") / F.col("__all"))
    return out.select(F.col("__value").alias(var), "count", "proportion", "n_unique", "mode", "n_missing")


def other_columns(data, columns) -> DataFrame:
    """(variable, dtype, n_unique, n_missing, min, max) with the ends as text, in one aggregation."""
    df, cols = as_frame(data), listed(columns)
    aggs = []
    for i, c in enumerate(cols):
        x = col(c)
        aggs += [(F.count_distinct(x) + F.coalesce(F.max(x.isNull().cast("int")), F.lit(0))).alias(f"u{i}"), F.count_if(x.isNull()).alias(f"m{i}"), F.min(x).cast("string").alias(f"a{i}"), F.max(x).cast("string").alias(f"z{i}")]
    one = df.agg(*aggs)
    rows = [F.struct(F.lit(c).alias("variable"), F.lit(df.schema[c].dataType.simpleString()).alias("dtype"), F.col(f"u{i}").alias("n_unique"), F.col(f"m{i}").alias("n_missing"), F.col(f"a{i}").alias("min"), F.col(f"z{i}").alias("max")) for i, c in enumerate(cols)]
    return one.select(F.inline(F.array(*rows)))


@dataclass(frozen=True)
class Distribution:
    """Frames of counts by categorical column, of statistics of the numeric ones, and of what else there is."""

    name: str
    categorical: dict[str, DataFrame]
    numeric: DataFrame | None
    other: DataFrame | None


def classify(df: DataFrame, cols: list[str], nint: int = 25) -> tuple[list[str], list[str], list[str]]:
    """(categorical, numeric, other): text, booleans, and integers with under `nint` values are categorical."""
    whole = [c for c in cols if is_integer(df, c)]
    unique = df.agg(*[F.count_distinct(col(c)).alias(str(i)) for i, c in enumerate(whole)]).first() if whole else []
    few = {c for c, n in zip(whole, unique, strict=True) if n < nint}
    cat = [c for c in cols if isinstance(df.schema[c].dataType, T.StringType | T.BooleanType) or c in few]
    num = [c for c in cols if is_numeric(df, c) and c not in cat]
    return cat, num, [c for c in cols if c not in cat and c not in num]


def distr(data, cols=None, by=None, nint: int = 25) -> Distribution:
    """Summaries of every column (or `cols`), whole or by group."""
    n = named(data)
    by = listed(by)
    cols = listed(cols) or [c for c in n.df.columns if c not in by]
    cat, num, other = classify(n.df, cols, nint)
    return Distribution(n.name, {c: value_counts(n.df, c, by) for c in cat}, explore(n.df, num, by=by) if num else None, other_columns(n.df, other) if other else None)
