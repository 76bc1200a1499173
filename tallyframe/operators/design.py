"""Design columns of a model: treatment coding with fixed levels, interactions and small formulas, as Column expressions."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col, enforce_levels, levels_of, need_columns

_TERM = re.compile(r"^(?:I\((?P<base>[\w.]+)\s*\*\*\s*(?P<power>\d+)\)|C\((?P<cat>[\w.]+)\)|(?P<plain>[\w.]+))$")


def parse_formula(formula: str) -> tuple[str, list[str], bool]:
    """(response, terms, intercept) of `y ~ a + b + a:b + a*b + I(a**2) - 1`; anything else raises ValueError."""
    if formula.count("~") != 1:
        raise ValueError("A formula has one ~")
    left, right = (x.strip() for x in formula.split("~"))
    if not re.fullmatch(r"[\w.]+", left):
        raise ValueError(f"Not a response: {left}")
    terms, intercept = [], True
    right = re.sub(r"-\s*1\s*$", "+ 0", right)
    for part in (p.strip() for p in right.split("+")):
        if part in ("0", "1"):
            intercept = part == "1"
            continue
        if "*" in part and "**" not in part:
            a, b = (x.strip() for x in part.split("*", 1))
            found = [a, b, f"{a}:{b}"]
        else:
            found = [":".join(x.strip() for x in part.split(":"))]
        for t in found:
            if not all(_TERM.match(x) for x in t.split(":")):
                raise ValueError(f"Not a term: {t}")
            if t not in terms:
                terms.append(t)
    return left, terms, intercept


@dataclass
class Design:
    """Terms of a model and the levels of its categorical variables, frozen when it is fitted."""

    terms: list[str]
    levels: dict[str, list]
    intercept: bool = True

    @classmethod
    def of(cls, df: DataFrame, evar: list[str], ivar: list[str] | None = None, levels: dict[str, list] | None = None, intercept: bool = True) -> Design:
        terms = list(evar) + [":".join(x.strip() for x in i.split(":")) for i in ivar or []]
        names = {v for t in terms for v in cls._variables(t)}
        need_columns(df, sorted(names))
        levels = levels or {}
        text = [n for n in sorted(names) if isinstance(df.schema[n].dataType, T.StringType | T.BooleanType) or n in levels or any(f"C({n})" in t for t in terms)]
        return cls(terms, {n: levels_of(df, n, levels.get(n)) for n in text}, intercept)

    @staticmethod
    def _variables(term: str) -> list[str]:
        return [next(g for k, g in _TERM.match(x).groupdict().items() if g and k != "power") for x in term.split(":")]

    @property
    def variables(self) -> list[str]:
        return list(dict.fromkeys(v for t in self.terms for v in self._variables(t)))

    def _parts(self, item: str) -> list[tuple[str, Column]]:
        m = _TERM.match(item)
        name = m["base"] or m["cat"] or m["plain"]
        if name in self.levels:
            return [(f"{name}[{x}]", F.when(col(name).cast("string") == F.lit(str(x).lower() if isinstance(x, bool) else str(x)), 1.0).otherwise(0.0)) for x in self.levels[name][1:]]
        x = col(name).cast("double")
        return [(item, F.pow(x, F.lit(int(m["power"])))) if m["power"] else (item, x)]

    def columns(self) -> list[tuple[str, str, Column]]:
        """(name, term, expression) of each column, the intercept first."""
        out = [("Intercept", "Intercept", F.lit(1.0))] if self.intercept else []
        for t in self.terms:
            found: list[tuple[str, Column | None]] = [("", None)]
            for item in t.split(":"):
                found = [(f"{n}:{m}" if n else m, e if o is None else o * e) for n, o in found for m, e in self._parts(item)]
            out += [(n, t, e) for n, e in found]
        return out

    def complete(self, df: DataFrame, *more: str) -> DataFrame:
        """Rows without a null in any variable."""
        return df.dropna(subset=[*self.variables, *more])

    def check(self, df: DataFrame) -> DataFrame:
        return enforce_levels(df, self.levels)
