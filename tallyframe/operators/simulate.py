"""Simulated data for predictions: typical values, with chosen columns varied."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_frame, col, is_integer, is_numeric, levels_of, listed
from .reshape import expand_grid


def sim_prediction(data, vary=None, columns=None, levels: dict[str, list] | None = None, nnv: int = 5, minq: float = 0.0, maxq: float = 1.0) -> DataFrame:
    """A grid: means of numbers and the commonest of other columns, but for `vary` (names, or a dict of values).

    A varied number takes `nnv` even steps between two quantiles (its two values if it has no more), another column all its
    levels. Values are cast to the column's type, so those of whole numbers are cut to whole numbers. One aggregation.
    """
    df = as_frame(data)
    cols = listed(columns) or df.columns
    fixed = vary if isinstance(vary, dict) else {}
    varied = [v for v in listed(None if isinstance(vary, dict) else vary) if v in cols]
    aggs = []
    for i, c in enumerate(cols):
        if is_numeric(df, c):
            x = col(c).cast("double")
            aggs += [F.avg(x).alias(f"a{i}"), F.percentile(x, F.array(F.lit(minq), F.lit(maxq))).alias(f"q{i}"), F.count_distinct(x).alias(f"u{i}")]
        else:
            aggs += [F.mode(col(c), True).alias(f"a{i}")]
    row = df.agg(*aggs).first()
    values: dict[str, list] = {}
    for i, c in enumerate(cols):
        if c in fixed:
            values[c] = listed(fixed[c])
        elif c not in varied:
            values[c] = [row[f"a{i}"]]
        elif is_numeric(df, c):
            low, high = row[f"q{i}"]
            steps = [low, high] if row[f"u{i}"] <= 2 else np.linspace(low, high, nnv).tolist()
            values[c] = list(dict.fromkeys(int(s) for s in steps)) if is_integer(df, c) else steps
        else:
            values[c] = (levels or {}).get(c) or levels_of(df, c)
    grid = expand_grid(values, spark=df.sparkSession)
    return grid.withColumns({c: F.expr(f"cast(`{c}` as {df.schema[c].dataType.simpleString()})") for c in cols})
