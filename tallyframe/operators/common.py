"""What the operators share: frames at the edge, named datasets, column kinds and safe ratios."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Named:
    """A dataset and its label in reports."""

    name: str
    df: DataFrame


def as_frame(data: Any, spark: SparkSession | None = None, nan_as_null: bool = False) -> DataFrame:
    """A DataFrame from a DataFrame, a pandas frame, a dict of columns, a list of rows, or a one-entry dict {name: frame}."""
    if isinstance(data, DataFrame):
        df = data
    elif isinstance(data, dict) and data and isinstance(next(iter(data.values())), DataFrame):
        df = next(iter(data.values()))
    else:
        import pandas as pd

        spark = spark or SparkSession.active()
        df = spark.createDataFrame(pd.DataFrame(data) if isinstance(data, dict) else data)
    if nan_as_null:
        floats = [f.name for f in df.schema if isinstance(f.dataType, T.FloatType | T.DoubleType)]
        df = df.withColumns({c: F.when(F.isnan(col(c)), None).otherwise(col(c)) for c in floats})
    return df


def named(data: Any, default: str = "Not provided") -> Named:
    """The frame and its label: the key of a one-entry dict, or the default."""
    if isinstance(data, dict) and data and isinstance(next(iter(data.values())), DataFrame):
        name, df = next(iter(data.items()))
        return Named(name, df)
    return Named(default, as_frame(data))


def col(name: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def listed(x: Any) -> list:
    """None: empty; a string or other single value: a list of it."""
    if x is None:
        return []
    return list(x) if isinstance(x, list | tuple | set) else [x]


def is_numeric(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.NumericType)


def is_integer(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.ByteType | T.ShortType | T.IntegerType | T.LongType)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def need_columns(df: DataFrame, names: list[str]) -> None:
    missing = [c for c in names if c not in df.columns]
    if missing:
        raise ValueError(f"No such columns: {', '.join(missing)}")


def ratio(a: Column, b: Column) -> Column:
    """a / b in doubles, null for a zero b."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def join_groups(left: DataFrame, right: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """Rows of left with the columns of right's row for their group, a null being a group of its own; without groups, of its one row."""
    if not by:
        return left.crossJoin(F.broadcast(right))  # one row
    renamed = right.select(*[col(g).alias(f"__group{i}") for i, g in enumerate(by)], *[col(c) for c in right.columns if c not in by])
    same = reduce(lambda a, b: a & b, [col(g).eqNullSafe(F.col(f"__group{i}")) for i, g in enumerate(by)])
    return left.join(renamed, same, how).drop(*[f"__group{i}" for i in range(len(by))])


def levels_of(df: DataFrame, name: str, levels: list | None = None, most: int = 10_000) -> list:
    """Ordered levels: those given, those in the column's metadata, or the distinct values in ascending order.

    Levels come to the driver; more than `most` raise ValueError.
    """
    if levels is not None:
        return list(levels)
    meta = df.schema[name].metadata or {}
    if "levels" in meta:
        return list(meta["levels"])
    found = [r[0] for r in df.select(col(name)).filter(col(name).isNotNull()).distinct().orderBy(col(name)).limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"{name} has more than {most} levels")
    return found


def first_seen_levels(df: DataFrame, name: str, order_by: str) -> list:
    """Levels in the order in which they first occur by `order_by`; nulls are no level."""
    first = df.filter(col(name).isNotNull()).groupBy(col(name).alias("v")).agg(F.min(col(order_by)).alias("at"))
    return [r.v for r in first.orderBy("at", "v").collect()]


def with_levels(df: DataFrame, name: str, levels: list) -> DataFrame:
    """Put ordered levels into the column's metadata."""
    return df.withMetadata(name, {**(df.schema[name].metadata or {}), "levels": list(levels)})


def enforce_levels(df: DataFrame, levels: dict[str, list]) -> DataFrame:
    """Put the levels of training on columns to be scored; a value that training has not seen raises ValueError."""
    have = [c for c in levels if c in df.columns]
    if have:
        bad = df.agg(*[F.min(F.when(~col(c).cast("string").isin([str(x) for x in levels[c]]), col(c).cast("string"))).alias(str(i)) for i, c in enumerate(have)]).first()
        for c, value in zip(have, bad, strict=True):
            if value is not None:
                raise ValueError(f"Column {c} has a level not seen during training: {value}")
    for c in have:
        df = with_levels(df, c, levels[c])
    return df
