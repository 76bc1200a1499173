"""Formats, labels and list helpers; and distribution functions as columns."""

from __future__ import annotations

import calendar
import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import special


def sig_stars(p):
    """Stars for a p-value, a list of them, or a Column; NaN and null get none."""
    if isinstance(p, Column):
        x = F.coalesce(F.nanvl(p.cast("double"), F.lit(1.0)), F.lit(1.0))
        return F.when(x < 0.001, "***").when(x < 0.01, "**").when(x < 0.05, "*").when(x < 0.1, ".").otherwise(" ")
    if isinstance(p, list | tuple):
        return [sig_stars(x) for x in p]
    x = 1.0 if p is None or math.isnan(p) else p
    return "***" if x < 0.001 else "**" if x < 0.01 else "*" if x < 0.05 else "." if x < 0.1 else " "


def format_pval(p: float | None, dec: int = 3) -> str:
    return "" if p is None else "< .001" if p < 0.001 else f"{round(p, dec)}"


def format_nr(x, sym: str = "", dec: int = 2, perc: bool = False):
    """Thousands separators, a currency sign or percent; lists item by item; dec 0 cuts the fraction off."""
    if isinstance(x, list | tuple):
        return [format_nr(v, sym, dec, perc) for v in x]
    if perc:
        x = x * 100
    return f"{sym}{int(x):,}" + "%" * perc if dec == 0 else f"{sym}{x:,.{dec}f}" + "%" * perc


def ci_label(alt: str = "two-sided", conf: float = 0.95, dec: int = 3) -> list[str]:
    if alt == "two-sided":
        low = (1 - conf) / 2
        return [f"{round(100 * low, dec):g}%", f"{round(100 * (1 - low), dec):g}%"]
    return [f"{round(100 * (1 - conf), dec):g}%", "100%"] if alt == "greater" else ["0%", f"{round(100 * conf, dec):g}%"]


def months_abb(start: int = 1, nr: int = 12) -> list[str]:
    return [calendar.month_abbr[(start - 1 + i) % 12 + 1] for i in range(nr)]


def setdiff(x, y, sort: bool = False) -> list:
    out = [v for v in dict.fromkeys(x) if v not in set(y)]
    return sorted(out) if sort else out


def union(x, y) -> list:
    return sorted({*x, *y})


def intersect(x, y) -> list:
    return sorted({*x} & {*y})


def _vectorised(f):
    @F.pandas_udf("double")
    def run(s: pd.Series) -> pd.Series:
        return s.map(f, na_action="ignore").astype("float64")

    return run


def norm_cdf(x: Column, mean: float = 0, sd: float = 1) -> Column:
    return _vectorised(lambda v: special.norm_cdf(v, mean, sd))(x.cast("double"))


def t_cdf(x: Column, df: float) -> Column:
    return _vectorised(lambda v: special.t_cdf(v, df))(x.cast("double"))


def chisq_cdf(x: Column, df: float) -> Column:
    return _vectorised(lambda v: special.chisq_cdf(v, df))(x.cast("double"))


def f_cdf(x: Column, d1: float, d2: float) -> Column:
    return _vectorised(lambda v: special.f_cdf(v, d1, d2))(x.cast("double"))
