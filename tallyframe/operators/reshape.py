"""Long and wide forms, grids, dummies and repetitions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_frame, col, is_numeric, levels_of, listed, need_columns


def unpivot(data, on=None, id_vars=None, variable_name: str = "variable", value_name: str = "value") -> DataFrame:
    """Wide to long, nulls included. on: all columns that are no ids. Numbers of different types become doubles, else strings."""
    df, ids = as_frame(data), listed(id_vars)
    on = listed(on) or [c for c in df.columns if c not in ids]
    need_columns(df, on + ids)
    types = {df.schema[c].dataType for c in on}
    if len(types) > 1:
        kind = "double" if all(isinstance(t, T.NumericType) for t in types) else "string"
        df = df.withColumns({c: col(c).cast(kind) for c in on})
    return df.unpivot([col(c) for c in ids], [col(c) for c in on], variable_name, value_name)


def table2data(data, freq: str) -> DataFrame:
    """Repeat each row as often as `freq` says, and drop that column; zero, negative and null drop the row."""
    df = as_frame(data)
    need_columns(df, [freq])
    return df.filter(col(freq) > 0).withColumn("__i", F.explode(F.sequence(F.lit(1), col(freq).cast("int")))).drop("__i", freq)


def expand_grid(values: dict, schema: T.StructType | None = None, spark: SparkSession | None = None) -> DataFrame:
    """Every combination of the values, the last name varying fastest; cast to the types of `schema` by name."""
    spark = spark or SparkSession.active()
    out = spark.range(1).select()
    for name, xs in values.items():
        items = listed(xs)
        kind = spark.createDataFrame([(x,) for x in items]).schema[0].dataType
        out = out.withColumn(name, F.explode(F.array(*[F.lit(x).cast(kind) for x in items])))
    if schema is not None:
        out = out.withColumns({f.name: col(f.name).cast(f.dataType) for f in schema if f.name in values})
    return out


def get_dummies(data, drop_first: bool = True, categories: dict[str, list] | None = None, columns=None, drop_nonvarying: bool = False) -> DataFrame:
    """0/1 columns {column}_{level} for every text column, after the other columns; nulls stay null.

    The first level (of `categories`, the column's metadata, or the order of values) is the baseline that drop_first drops.
    drop_nonvarying leaves out the columns that have one value in all rows (levels that the data do not have, or only have);
    without it all levels of a fit stay, so that predictions meet the same columns. It costs one aggregation.
    """
    df, categories = as_frame(data), categories or {}
    columns = listed(columns) or [f.name for f in df.schema if isinstance(f.dataType, T.StringType) or f.name in categories]
    plain = [col(c) for c in df.columns if c not in columns]
    made = []
    for c in columns:
        levels = levels_of(df, c, categories.get(c))
        made += [F.when(col(c).isNull(), None).when(col(c) == F.lit(x), 1).otherwise(0).cast("byte").alias(f"{c}_{x}") for x in levels[bool(drop_first) :]]
    out = df.select(*plain, *made)
    if drop_nonvarying and made:
        names = out.columns[len(plain) :]
        ends = out.agg(*[f(col(c)).alias(f"{k}{i}") for i, c in enumerate(names) for k, f in (("a", F.min), ("z", F.max))]).first()
        out = out.drop(*[c for i, c in enumerate(names) if ends[f"a{i}"] == ends[f"z{i}"]])
    return out


def conditional_get_dummies(data, categories: dict[str, list] | None = None) -> DataFrame:
    """Columns of up to two levels lose the first, others keep all. Levels given (from a fit) decide, not the frame at hand."""
    df, categories = as_frame(data), dict(categories or {})
    text = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    for c in text:
        categories.setdefault(c, levels_of(df, c))
    few = [c for c in text if len(categories[c]) <= 2]
    out = get_dummies(df, True, categories, few) if few else df
    many = [c for c in text if c not in few]
    return get_dummies(out, False, categories, many) if many else out


def convert_binary(data, rvar: str, lev) -> DataFrame:
    """1 where rvar equals lev, else 0, nulls stay; ValueError if all values are alike. A 0/1 column with lev 1 is kept."""
    df = as_frame(data)
    need_columns(df, [rvar])
    same = (col(rvar) == F.lit(lev)) if is_numeric(df, rvar) and isinstance(lev, int | float) else (col(rvar).cast("string") == F.lit(str(lev)))
    out = df.withColumn(rvar, F.when(col(rvar).isNull(), None).when(same, 1).otherwise(0))
    low, high = out.agg(F.min(col(rvar)), F.max(col(rvar))).first()
    if low == high:
        raise ValueError(f"All values of {rvar} are {'not ' if low == 0 else ''}{lev}")
    return out


def is_binary(data, name: str) -> bool:
    """Whether the column has exactly two different values, nulls left out."""
    return as_frame(data).select(F.count_distinct(col(name))).first()[0] == 2


def levels_list(data, columns=None) -> dict[str, list]:
    """The distinct values of each column, in order."""
    df = as_frame(data)
    cols = listed(columns) or df.columns
    row = df.agg(*[F.sort_array(F.collect_set(col(c))).alias(str(i)) for i, c in enumerate(cols)]).first()
    return {c: row[i] for i, c in enumerate(cols)}


def ifelse(cond, a, b):
    """For a Column, a conditional Column; for lists a list; else one of two values."""
    from pyspark.sql import Column

    if isinstance(cond, Column):
        return F.when(cond, a).otherwise(b)
    if isinstance(cond, list | tuple):
        pick = lambda v, i: v[i] if isinstance(v, list | tuple) else v
        return [pick(a if c else b, i) for i, c in enumerate(cond)]
    return a if cond else b


def sum_horizontal(columns: list[str]):
    """Sum of the columns of a row, nulls as zero."""
    return reduce(lambda p, q: p + q, [F.coalesce(col(c), F.lit(0)) for c in columns])
