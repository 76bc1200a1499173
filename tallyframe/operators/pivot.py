"""Frequency tables and pivots with totals and shares."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bins import exact_quantiles
from .common import as_frame, col, join_groups, levels_of, listed, need_columns
from .explore import AGGREGATES

PIVOT_AGGREGATES = ("count", "sum", "mean", "median", "min", "max", "std", "var")


def _sum_of(columns: list[str]) -> Column:
    return reduce(lambda a, b: a + b, [F.coalesce(col(c).cast("double"), F.lit(0.0)) for c in columns])


def pivot(data, rows, cols=None, values=None, agg: str = "count", normalize: str | None = None, totals: bool = False, fill=None, levels: list | None = None) -> DataFrame:
    """Counts or an aggregate of `values` by `rows`, spread over the values of `cols`.

    Without `cols`: one row for each group; any `normalize` adds {name}_pct; totals add a row Total that sums the columns.
    With `cols`: a column of doubles for each of its values (`levels` spares the search for them; a null's column is named
    null). Totals are sums of cells, whatever the aggregate: a column Total, and a row. normalize row: shares of the
    row's cells in percent, Total 100. column, total: shares of the sums over all rows, the row Total included.
    values with agg count gives the mean. `fill` replaces nulls where `values` is None. One lazy plan.
    """
    df, rows, cols = as_frame(data), listed(rows), listed(cols)
    if agg not in PIVOT_AGGREGATES:
        raise ValueError(f"Unknown aggregate {agg}; known: {', '.join(PIVOT_AGGREGATES)}")
    if normalize not in (None, "none", "row", "column", "total"):
        raise ValueError("normalize is row, column or total")
    if values is not None and agg == "count":
        agg = "mean"
    if agg != "count" and values is None:
        raise ValueError("values are needed for this aggregate")
    need_columns(df, rows + cols + listed(values))
    normalize = None if normalize == "none" else normalize
    name = "count" if values is None else f"{values}_{agg}"
    if agg == "median":  # one row for each cell, from which first takes the value
        cells_ = exact_quantiles(df, values, [0.5], "__m", [*rows, *cols], nan=True)
        df = join_groups(df.groupBy(*map(col, [*rows, *cols])).agg(F.count("*").alias("__n")), cells_, [*rows, *cols], "left").withColumn(values, F.get("__m", F.lit(0)))
    value = F.count(F.lit(1)) if values is None else F.first(col(values)) if agg == "median" else AGGREGATES[agg](col(values))
    keys = [col(r) for r in rows]
    if not cols:
        out = df.groupBy(*keys).agg(value.alias(name))
        if normalize:
            all_ = out.agg(F.sum(col(name).cast("double")).alias("__all"))
            out = join_groups(out, all_, []).withColumn(f"{name}_pct", 100 * F.try_divide(col(name).cast("double"), F.col("__all"))).drop("__all")
        if totals:
            numbers = [c for c in out.columns if c not in rows]
            grouped = out.select(*[col(r).cast("string").alias(r) for r in rows], *[col(c).cast("double").alias(c) for c in numbers])
            last = grouped.agg(*[F.sum(col(c)).alias(c) for c in numbers]).select(*[F.lit("Total").alias(r) for r in rows], *map(col, numbers))
            out = grouped.unionByName(last)
        return out.fillna(fill) if fill is not None and values is None else out

    spread = F.concat_ws("_", *[F.coalesce(col(c).cast("string"), F.lit("null")) for c in cols]) if len(cols) > 1 else col(cols[0])
    if levels is None:
        levels = levels_of(df.select(spread.alias("x")), "x")
        if len(cols) == 1 and not df.filter(col(cols[0]).isNull()).isEmpty():
            levels = [*levels, None]
    cells = ["null" if x is None else str(x) for x in levels]
    # Spark aggregates by rows and level first and then spreads one value a cell, so this is two small shuffles.
    marked = df.withColumn("__spread", F.coalesce(spread.cast("string"), F.lit("null")))
    out = marked.groupBy(*keys).pivot("__spread", cells).agg(value.cast("double"))
    if totals:
        out = out.withColumn("Total", _sum_of(cells)).withColumns({r: col(r).cast("string") for r in rows})
        last = out.agg(*[F.sum(F.coalesce(col(c), F.lit(0.0))).alias(c) for c in [*cells, "Total"]])
        out = out.unionByName(last.select(*[F.lit("Total").alias(r) for r in rows], *[col(c) for c in [*cells, "Total"]]))
    if normalize == "row":
        total = _sum_of(cells)
        shares = {c: 100 * F.try_divide(col(c), total) for c in cells}
        out = out.withColumns(shares | ({"Total": F.lit(100.0)} if totals else {}))
    elif normalize:
        sums = {c: F.col(f"__s{i}") for i, c in enumerate(cells)}
        whole = reduce(lambda a, b: a + b, [F.coalesce(s, F.lit(0.0)) for s in sums.values()])
        out = join_groups(out, out.agg(*[F.sum(col(c)).alias(f"__s{i}") for i, c in enumerate(cells)]), [])
        out = out.withColumns({c: 100 * F.try_divide(col(c), sums[c] if normalize == "column" else whole) for c in cells}).drop(*[f"__s{i}" for i in range(len(cells))])
    return out.fillna(fill) if fill is not None and values is None else out
