"""Hypothesis tests: one or two distributed aggregations, then formulas on what they return."""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import special as S
from ..functions.text import ci_label, format_pval, sig_stars
from .bins import average_ranks, running_sums
from .common import col, is_numeric, join_groups, levels_of, listed, named, need_columns, numeric_columns
from .moments import group_moments
from .reshape import unpivot
from .rows import sample_rows

ALTERNATIVES = ("two-sided", "greater", "less")


@dataclass
class Result:
    """Rows of descriptive and of comparative statistics, as dicts, with the settings."""

    test: str
    data: str
    settings: dict
    stats: list[dict] = field(default_factory=list)
    comparisons: list[dict] = field(default_factory=list)
    tables: dict = field(default_factory=dict)

    def report(self, dec: int = 3) -> str:
        lines = [self.test, f"Data     : {self.data}", *[f"{k:<9}: {v}" for k, v in self.settings.items()], ""]
        for rows in (self.stats, self.comparisons, *self.tables.values()):
            if rows:
                lines += _plain(rows, dec) + [""]
        return "\n".join(lines + ["Signif. codes: 0 '***' 0.001 '**' 0.01 '*' 0.05 '.' 0.1 ' ' 1"])


def _plain(rows: list[dict], dec: int) -> list[str]:
    cell = lambda k, v: format_pval(v, dec) if k == "p_value" else f"{v:,.{dec}f}" if isinstance(v, float) else str(v)
    text = [list(rows[0])] + [[cell(k, v) for k, v in r.items()] for r in rows]
    width = [max(map(len, c)) for c in zip(*text, strict=True)]
    return ["  ".join(x.rjust(w) for x, w in zip(r, width, strict=True)) for r in text]


def _check(alt: str, conf: float) -> None:
    if alt not in ALTERNATIVES:
        raise ValueError(f"The alternative is one of {', '.join(ALTERNATIVES)}")
    if not 0 < conf < 1:
        raise ValueError("The confidence level is between 0 and 1")


def _p(stat: float, alt: str, cdf) -> float:
    if math.isnan(stat):
        return math.nan
    return cdf(stat) if alt == "less" else cdf(-stat) if alt == "greater" else min(1.0, 2 * cdf(-abs(stat)))


def _over(a: float, b: float) -> float:
    return a / b if b else math.nan if a == 0 else math.copysign(math.inf, a)


def single_mean(data, var: str, alt_hyp: str = "two-sided", conf: float = 0.95, comp_value: float = 0) -> Result:
    """One-sample t-test; n counts all rows, the degrees of freedom those with a value."""
    _check(alt_hyp, conf)
    d = named(data)
    need_columns(d.df, [var])
    x = F.when(~F.isnan(col(var).cast("double")), col(var).cast("double"))
    r = d.df.agg(F.count("*").alias("n"), F.count(x).alias("k"), F.avg(x).alias("m"), F.stddev_samp(x).alias("s")).first()
    df = r.k - 1
    sd = r.s if r.s is not None else math.nan
    se = sd / math.sqrt(r.k) if r.k else math.nan
    mean = r.m if r.m is not None else math.nan
    diff = mean - comp_value
    t = _over(diff, se)
    ok = df > 0
    q = (S.t_ppf((1 + conf) / 2, df) if alt_hyp == "two-sided" else S.t_ppf(conf, df)) if ok else math.nan
    low = -math.inf if alt_hyp == "less" else mean - q * se
    high = math.inf if alt_hyp == "greater" else mean + q * se
    me = (S.t_ppf((1 + conf) / 2, df) if ok else math.nan) * se
    p = _p(t, alt_hyp, lambda v: S.t_cdf(v, df)) if ok else math.nan
    a, z = ci_label(alt_hyp, conf)
    return Result("Single mean test", d.name, {"Variable": var, "Alternative": alt_hyp, "Compare": comp_value, "Conf": conf}, [{"mean": mean, "n": r.n, "n_missing": r.n - r.k, "sd": sd, "se": se, "me": me}], [{"diff": diff, "se": se, "t_value": t, "p_value": p, "df": df, a: low, z: high, "stars": sig_stars(p)}])


def single_prop(data, var: str, lev, alt_hyp: str = "two-sided", conf: float = 0.95, comp_value: float = 0.5, test_type: str = "binomial") -> Result:
    """One proportion: exact binomial test with its exact interval, or a z-test with Wilson's."""
    _check(alt_hyp, conf)
    if not 0 < comp_value < 1:
        raise ValueError("The value to compare with is over 0 and under 1")
    if test_type not in ("binomial", "z-test"):
        raise ValueError("The test is binomial or z-test")
    d = named(data)
    need_columns(d.df, [var])
    r = d.df.agg(F.count(col(var)).alias("n"), F.count_if(col(var).cast("string") == str(lev)).alias("k"), F.count_if(col(var).isNull()).alias("miss")).first()
    n, k = r.n, r.k
    if not n:
        raise ValueError(f"{var} has no values")
    p = k / n
    sd = math.sqrt(p * (1 - p))
    se = sd / math.sqrt(n)
    tail = (1 - conf) / 2 if alt_hyp == "two-sided" else 1 - conf
    if test_type == "binomial":
        stat, pv = float(k), S.binom_test(k, n, comp_value, alt_hyp)
        low = S.beta_ppf(tail, k, n - k + 1) if k else 0.0
        high = S.beta_ppf(1 - tail, k + 1, n - k) if k < n else 1.0
    else:
        stat = (p - comp_value) / math.sqrt(comp_value * (1 - comp_value) / n)
        pv = _p(stat, alt_hyp, S.norm_cdf)
        z = S.norm_ppf(1 - tail)
        mid, half = (p + z * z / (2 * n)) / (1 + z * z / n), z / (1 + z * z / n) * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
        low, high = mid - half, mid + half
    low, high = (0.0 if alt_hyp == "less" else low), (1.0 if alt_hyp == "greater" else high)
    a, z = ci_label(alt_hyp, conf)
    me = S.norm_ppf((1 + conf) / 2) * se
    return Result("Single proportion test", d.name, {"Variable": var, "Level": lev, "Alternative": alt_hyp, "Compare": comp_value, "Test": test_type}, [{"p": p, "ns": k, "n": n, "n_missing": r.miss, "sd": sd, "se": se, "me": me}], [{"diff": p - comp_value, "statistic": stat, "p_value": pv, a: low, z: high, "stars": sig_stars(pv)}])


def _pairs(levels: list, comb) -> list[tuple]:
    """All pairs of levels, or those given as tuples or as "a:b"."""
    if not comb:
        return list(itertools.combinations(levels, 2))
    names = {str(x): x for x in levels}
    out = []
    for c in comb:
        if isinstance(c, str):
            found = [(a, b) for a in names for b in names if f"{a}:{b}" == c]
            if not found:
                raise ValueError(f"No such pair of levels: {c}")
            c = names[found[0][0]], names[found[0][1]]
        out.append(tuple(c))
    return out


def rank_sums(df: DataFrame, group: str, value: str, pairs: list[tuple]) -> list[tuple[float, int, int]]:
    """For each pair of groups (sum of the ranks of the first among both, its size, the other's), all pairs in one plan.

    Values are counted by group once; each count goes to the pairs that its group is in, where values are ranked.
    """
    if not pairs:
        return []
    counts = df.filter(col(value).isNotNull()).groupBy(col(group).alias("g"), col(value).cast("double").alias("v")).agg(F.count("*").alias("c"))
    member = F.array(*[F.struct(F.lit(i).alias("pair"), F.lit(g).alias("of"), F.lit(k).alias("side")) for i, p in enumerate(pairs) for k, g in enumerate(p)])
    mine = counts.withColumn("__in", F.explode(F.filter(member, lambda m: m["of"] == F.col("g"))))
    side = lambda k: F.sum(F.when(F.col("__in.side") == k, F.col("c")).otherwise(0))
    both = mine.groupBy(F.col("__in.pair").alias("pair"), "v").agg(F.sum("c").cast("double").alias("n"), side(0).alias("na"), side(1).alias("nb"))
    ranked = running_sums(both, "v", ["n"], ["pair"])
    rank = F.col("n_upto") - (F.col("n") - 1) / 2
    found = {r.pair: (r.w or 0.0, r.a or 0, r.b or 0) for r in ranked.groupBy("pair").agg(F.sum(rank * F.col("na")).alias("w"), F.sum("na").alias("a"), F.sum("nb").alias("b")).collect()}
    return [found.get(i, (0.0, 0, 0)) for i in range(len(pairs))]


def compare_means(data, var1: str, var2, comb=None, alt_hyp: str = "two-sided", conf: float = 0.95, sample_type: str = "independent", adjust: str | None = None, test_type: str = "t-test", pair_by=None, levels: list | None = None) -> Result:
    """Means of var2 by the levels of var1, pair by pair: Welch's t, paired t, rank sum or signed rank.

    A numeric var1 with several var2, named in `comb`, or with over ten values, is compared with them column by column.
    Paired samples need `pair_by`, the key that joins the two rows of a pair. One aggregation serves all t-tests.
    """
    _check(alt_hyp, conf)
    d = named(data)
    df, var2 = d.df, listed(var2)
    need_columns(df, [var1, *var2])
    comb = listed(comb)
    wide = is_numeric(df, var1) and (len(var2) > 1 or any(var1 in (c if isinstance(c, tuple) else c.split(":")) for c in comb) or df.select(F.count_distinct(col(var1))).first()[0] > 10)
    if wide:
        df = unpivot(df, [var1, *var2], pair_by, "variable", "value").withColumn("value", F.col("value").cast("double"))
        group, value, levels = "variable", "value", [var1, *var2]
    else:
        group, value = var1, var2[0]
        levels = levels_of(df, group, levels)
    df = df.filter(col(group).isNotNull())
    moments = {r[group]: r for r in group_moments(df, group, value).collect()}
    stats = []
    for g in levels:
        r = moments.get(g)
        n, sd = (r.n, r.sd) if r else (0, None)
        sd = math.nan if sd is None else sd
        se = sd / math.sqrt(n) if n else math.nan
        me = S.t_ppf((1 + conf) / 2, n - 1) * se if n > 1 else math.nan
        stats.append({group: g, "mean": r["mean"] if r else None, "n": n, "n_missing": r.n_missing if r else 0, "sd": sd, "se": se, "me": me})
    by = {s[group]: s for s in stats}
    rows = []
    pairs = _pairs(levels, comb)
    ranks = rank_sums(df, group, value, pairs) if sample_type != "paired" and test_type != "t-test" else [None] * len(pairs)
    for (a, b), ranked in zip(pairs, ranks, strict=True):
        x, y = by[a], by[b]
        mean_a, mean_b = (s["mean"] if s["mean"] is not None else math.nan for s in (x, y))
        diff = mean_a - mean_b
        va, vb = (s["sd"] ** 2 / s["n"] if s["n"] else math.nan for s in (x, y))
        spread = va + vb
        dof = spread**2 / (va**2 / (x["n"] - 1) + vb**2 / (y["n"] - 1)) if x["n"] > 1 and y["n"] > 1 and spread > 0 else math.nan
        if sample_type == "paired":
            stat, p = _paired(df, group, value, a, b, pair_by, alt_hyp, test_type, x["n"], y["n"])
        elif test_type == "t-test":
            stat = _over(diff, math.sqrt(spread)) if spread == spread else math.nan
            p = _p(stat, alt_hyp, lambda v, k=dof: S.t_cdf(v, k)) if dof == dof else math.nan
        else:
            total, n, m = ranked
            stat = (total - n * (n + m + 1) / 2) / math.sqrt(n * m * (n + m + 1) / 12) if n and m else math.nan
            p = _p(stat, alt_hyp, S.norm_cdf)
        row = {"null_hyp": f"{a} = {b}", "alt_hyp": f"{a} {'!=' if alt_hyp == 'two-sided' else '>' if alt_hyp == 'greater' else '<'} {b}", "diff": diff, "statistic": stat, "p_value": p}
        low, high = ci_label(alt_hyp, conf)
        if test_type == "t-test":
            se = diff / stat if stat and stat == stat and not math.isinf(stat) else math.nan
            q = S.t_ppf((1 + conf) / 2 if alt_hyp == "two-sided" else conf, dof) if dof == dof else math.nan
            row |= {"se": se, "df": dof, low: -math.inf if alt_hyp == "less" else diff - q * se, high: math.inf if alt_hyp == "greater" else diff + q * se}
        else:
            row |= {"se": None, "df": None, low: None, high: None}
        rows.append(row)
    for row, p in zip(rows, S.p_adjust([r["p_value"] for r in rows], adjust), strict=True):
        row["p_value"] = p
        row["stars"] = sig_stars(p)
    return Result("Pairwise mean comparisons", d.name, {"Variables": f"{var1}, {', '.join(var2)}", "Samples": sample_type, "Test": test_type, "Conf": conf, "Adjust": adjust}, stats, rows)


def _paired(df: DataFrame, group: str, value: str, a, b, pair_by, alt: str, test: str, n: int, m: int) -> tuple[float, float]:
    if n != m:
        raise ValueError("Paired samples must have the same size")
    if not listed(pair_by):
        raise ValueError("Paired samples need pair_by, the key of a pair")
    keys = listed(pair_by)
    x = df.filter(col(group) == F.lit(a)).select(*map(col, keys), col(value).alias("__x"))
    y = df.filter(col(group) == F.lit(b)).select(*map(col, keys), col(value).alias("__y"))
    diff = x.join(y, keys).select((F.col("__x") - F.col("__y")).alias("d")).filter("d is not null")
    if test == "t-test":
        r = diff.agg(F.count("*"), F.avg("d"), F.stddev_samp("d")).first()
        if r[0] < 2:
            return math.nan, math.nan
        stat = _over(r[1], r[2] / math.sqrt(r[0]))
        return stat, _p(stat, alt, lambda v: S.t_cdf(v, r[0] - 1))
    signed = diff.filter("d != 0").select(F.abs("d").alias("v"), (F.col("d") > 0).cast("int").alias("up"))
    ranks = average_ranks(signed, "v")
    up = signed.groupBy("v").agg(F.sum("up").alias("up"))
    r = ranks.join(up, "v").agg(F.sum(F.col("rank") * F.col("up")), F.sum("n"), F.sum(F.col("n") ** 3 - F.col("n"))).first()
    if not r[1]:
        return math.nan, math.nan
    k = r[1]
    off = r[0] - k * (k + 1) / 4
    shift = 0.5 if alt == "greater" else -0.5 if alt == "less" else math.copysign(0.5, off) if off else 0.0
    z = (off - shift) / math.sqrt(k * (k + 1) * (2 * k + 1) / 24 - r[2] / 48)
    return z, _p(z, alt, S.norm_cdf)


def compare_props(data, var1: str, var2: str, lev, comb=None, alt_hyp: str = "two-sided", conf: float = 0.95, adjust: str | None = None, levels: list | None = None) -> Result:
    """Shares of `lev` in var2 by the levels of var1, pair by pair: pooled z, given as chi-square with one degree."""
    _check(alt_hyp, conf)
    d = named(data)
    need_columns(d.df, [var1, var2])
    levels = levels_of(d.df, var1, levels)
    hit = F.count_if(col(var2).cast("string") == str(lev))
    found = {r[0]: r for r in d.df.groupBy(col(var1)).agg(hit.alias("ns"), F.count(col(var2)).alias("n"), F.count_if(col(var2).isNull()).alias("miss")).collect()}
    stats, by = [], {}
    for g in levels:
        r = found.get(g)
        ns, n, miss = (r.ns, r.n, r.miss) if r else (0, 0, 0)
        p = ns / n if n else math.nan
        sd = math.sqrt(p * (1 - p)) if n else math.nan
        se = sd / math.sqrt(n) if n else math.nan
        by[g] = {var1: g, str(lev): ns, "p": p, "n": n, "n_missing": miss, "sd": sd, "se": se, "me": S.norm_ppf((1 + conf) / 2) * se}
        stats.append(by[g])
    rows = []
    for a, b in _pairs(levels, comb):
        x, y = by[a], by[b]
        diff = x["p"] - y["p"]
        pooled = (x[str(lev)] + y[str(lev)]) / (x["n"] + y["n"]) if x["n"] + y["n"] else math.nan
        z = _over(diff, math.sqrt(pooled * (1 - pooled) * (1 / x["n"] + 1 / y["n"]))) if x["n"] and y["n"] else math.nan
        p = _p(z, alt_hyp, S.norm_cdf)
        se = math.sqrt(x["se"] ** 2 + y["se"] ** 2)
        q = S.norm_ppf((1 + conf) / 2 if alt_hyp == "two-sided" else conf)
        low, high = ci_label(alt_hyp, conf)
        rows.append({"null_hyp": f"{a} = {b}", "diff": diff, "p_value": p, "chisq_value": z * z, "df": 1, low: -1.0 if alt_hyp == "less" else diff - q * se, high: 1.0 if alt_hyp == "greater" else diff + q * se})
    for row, p in zip(rows, S.p_adjust([r["p_value"] for r in rows], adjust), strict=True):
        row["p_value"] = p
        row["stars"] = sig_stars(p)
    return Result("Pairwise proportion comparisons", d.name, {"Variables": f"{var1}, {var2}", "Level": lev, "Conf": conf, "Adjust": adjust}, stats, rows)


def spearman_frame(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row (r, n): the correlation of average ranks over rows with both values."""
    both = df.filter(col(a).isNotNull() & col(b).isNotNull()).select(col(a).alias("a"), col(b).alias("b"))
    ra = average_ranks(both, "a").select(F.col("a").alias("x"), F.col("rank").alias("ra"))
    rb = average_ranks(both, "b").select(F.col("b").alias("y"), F.col("rank").alias("rb"))
    cells = both.groupBy("a", "b").agg(F.count("*").cast("double").alias("w"))
    j = cells.join(ra, F.col("a") == F.col("x")).join(rb, F.col("b") == F.col("y"))
    s = j.agg(*[F.sum(F.col("w") * e).alias(k) for k, e in {"n": F.lit(1.0), "sa": F.col("ra"), "sb": F.col("rb")}.items()])
    centred = j.crossJoin(F.broadcast(s))  # one row
    da, db = F.col("ra") - F.col("sa") / F.col("n"), F.col("rb") - F.col("sb") / F.col("n")
    w = F.col("w")
    sums = centred.agg(F.sum(w * da * db).alias("ab"), F.sum(w * da * da).alias("aa"), F.sum(w * db * db).alias("bb"), F.first("n").alias("n"))
    return sums.select(F.try_divide(F.col("ab"), F.sqrt(F.col("aa") * F.col("bb"))).alias("r"), F.coalesce("n", F.lit(0.0)).cast("long").alias("n"))


def _balance(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> int:
    """Weight of the concordant less that of the discordant pairs of points, one bit of the rank of x after another."""
    x, y = np.unique(x, return_inverse=True)[1], np.unique(y, return_inverse=True)[1]
    order = np.argsort(y, kind="stable")
    x, y, w = x[order], y[order], w[order].astype(np.int64)
    wide = int(w.sum()) >= 1 << 31  # products may need more than 64 bits

    def runs(new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the run of each element begins and ends."""
        at = np.flatnonzero(np.concatenate([[True], new]))
        length = np.diff(np.append(at, len(x)))
        return np.repeat(at, length), np.repeat(at + length, length)

    out = 0
    for bit in range(int(x.max(initial=0)).bit_length()):
        node = x >> (bit + 1)
        order = np.argsort(node, kind="stable")  # by y in each node
        node, v, up = node[order], y[order], (x[order] >> bit) & 1
        left = np.concatenate([[0], np.cumsum(np.where(up == 0, w[order], 0))])
        inside = node[1:] != node[:-1]
        begin, end = runs(inside)
        tie, over = runs(inside | (v[1:] != v[:-1]))
        net, weight = (left[tie] - left[begin]) - (left[end] - left[over]), w[order] * up
        out += int(np.dot(weight.astype(object), net.astype(object))) if wide else int(np.dot(weight, net))
    return out


def kendall_tau(df: DataFrame, a: str, b: str, lot: int = 200_000) -> float:
    """tau-b of all rows with both values, exact at every size.

    Distinct pairs are counted, and each column is cut into parts at quantiles; a value that is a cut is a part of its own.
    Two points in different parts of both columns are compared by their parts, those in one part of b by their values, and
    those in one part of a only by a's value and b's part: so no task sees more than about `lot` pairs, or 1/512 of them
    and the counts of 1,025^2 parts.
    """
    both = df.filter(col(a).isNotNull() & col(b).isNotNull()).select(col(a).cast("double").alias("a"), col(b).cast("double").alias("b"))
    cells = both.groupBy("a", "b").agg(F.count("*").alias("w")).persist()
    exact = lambda c: c.cast("decimal(19,0)")
    tied = lambda d: int(d.agg(F.sum(exact(F.col("w")) * exact(F.col("w") - 1))).first()[0] or 0) // 2
    txy, tx, ty = tied(cells), *(tied(cells.groupBy(c).agg(F.sum("w").alias("w"))) for c in ("a", "b"))
    size, n = cells.agg(F.count("*"), F.sum("w")).first()
    total = (n or 0) * ((n or 0) - 1) // 2
    if total == tx or total == ty:
        cells.unpersist()
        return math.nan
    parts = min(512, max(1, -(-size // lot)))
    points = [i / parts for i in range(1, parts)]

    def part(c: str, cuts: list[float]) -> Column:
        array = F.array(*map(F.lit, cuts)).cast("array<double>")
        return (2 * F.size(F.filter(array, lambda x: x < F.col(c))) + F.array_contains(array, F.col(c)).cast("int")).cast("int")

    cuts = cells.agg(*[F.percentile_approx(c, points, 10_000) for c in ("a", "b")]).first() if points else ([], [])
    placed = cells.select("a", "b", "w", *[part(c, sorted(set(x))).alias(f"p{c}") for c, x in zip(("a", "b"), cuts, strict=True)])
    part_of = lambda kind, p, x, y: placed.groupBy(F.lit(kind).alias("kind"), p.alias("part"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).agg(F.sum("w").alias("w"))
    every = part_of(0, F.lit(0), "pa", "pb").union(part_of(1, F.col("pa"), "a", "pb").filter("part % 2 = 0")).union(part_of(2, F.col("pb"), "a", "b").filter("part % 2 = 0"))

    def count(group: pa.Table) -> pa.Table:
        return pa.table({"net": [str(_balance(*(group.column(c).to_numpy() for c in ("x", "y", "w"))))]})

    net = sum(int(r.net) for r in every.groupBy("kind", "part").applyInArrow(count, "net string").collect())
    cells.unpersist()
    return net / math.sqrt((total - tx) * (total - ty))


def correlation(data, vars=None, method: str = "pearson", sample: int | None = None) -> Result:
    """Pairwise correlations over rows with both values: rows (var_x, var_y, r, p_value, cov, n); matrices with a 0 diagonal.

    kendall counts all pairs of rows; only with `sample` it takes so many rows at most, and n and p_value are those of the sample.
    """
    d = named(data)
    df = d.df
    cols = listed(vars) or numeric_columns(df)
    need_columns(df, cols)
    if method not in ("pearson", "spearman", "kendall"):
        raise ValueError(f"Unknown method: {method}")
    num = {c: F.when(~F.isnan(col(c).cast("double")), col(c).cast("double")) for c in cols}
    df = df.select(*[num[c].alias(c) for c in cols])
    pairs = list(itertools.combinations(cols, 2))
    both = {p: col(p[0]).isNotNull() & col(p[1]).isNotNull() for p in pairs}
    aggs = []
    for i, p in enumerate(pairs):
        x, y = F.when(both[p], col(p[0])), F.when(both[p], col(p[1]))
        aggs += [F.count(x).alias(f"n{i}"), F.covar_samp(x, y).alias(f"c{i}"), F.corr(x, y).alias(f"r{i}")]
    row = df.agg(*aggs).first() if pairs else None
    rows = []
    by_rank: dict[int, float | None] = {}
    if method == "spearman" and pairs:  # one job for all pairs
        frames = [spearman_frame(df, a, b).select(F.lit(i).alias("i"), "r") for i, (a, b) in enumerate(pairs)]
        by_rank = {x.i: x.r for x in reduce(DataFrame.union, frames).collect()}
    for i, (a, b) in enumerate(pairs):
        n, cov, r = row[f"n{i}"], row[f"c{i}"], row[f"r{i}"]
        if method == "spearman":
            r = by_rank[i]
        elif method == "kendall":
            kept = df.filter(both[a, b]).select(col(a), col(b))
            if sample is not None and n > sample:
                kept, n = sample_rows(kept, sample), sample
            r = kendall_tau(kept, a, b)
        r = math.nan if r is None or n < 2 else r
        if method == "kendall":
            z = r / math.sqrt(2 * (2 * n + 5) / (9 * n * (n - 1))) if n > 1 else math.nan
            p = _p(z, "two-sided", S.norm_cdf)
        elif n > 2 and r == r:
            p = 0.0 if abs(r) >= 1 else _p(r * math.sqrt((n - 2) / (1 - r * r)), "two-sided", lambda v, k=n: S.t_cdf(v, k - 2))
        else:
            p = math.nan
        rows.append({"var_x": a, "var_y": b, "r": r, "p_value": p, "cov": cov, "n": n})
    at = {c: i for i, c in enumerate(cols)}
    matrices = {}
    for key in ("r", "p_value", "cov"):
        m = [[0.0] * len(cols) for _ in cols]
        for x in rows:
            m[at[x["var_x"]]][at[x["var_y"]]] = m[at[x["var_y"]]][at[x["var_x"]]] = x[key]
        matrices[key] = m
    out = Result("Correlation", d.name, {"Variables": ", ".join(cols), "Method": method}, [], rows)
    out.matrices = matrices
    return out


def crosstab_frame(df: DataFrame, var1: str, var2: str) -> DataFrame:
    """Long form, zeros included: observed, expected, chisq, deviation and shares of row, column and all, for every pair of levels."""
    kept = df.filter(col(var1).isNotNull() & col(var2).isNotNull())
    counts = kept.groupBy(col(var1).alias("v1"), col(var2).alias("v2")).agg(F.count("*").alias("observed"))
    rows = counts.groupBy("v1").agg(F.sum("observed").alias("row_total"))
    cols = counts.groupBy("v2").agg(F.sum("observed").alias("col_total"))
    cells = rows.crossJoin(cols).join(counts, ["v1", "v2"], "left").fillna(0, ["observed"])  # levels, not rows
    cells = join_groups(cells, counts.agg(F.sum("observed").alias("total")), []).withColumn("expected", F.col("row_total") * F.col("col_total") / F.col("total"))
    off = F.col("observed") - F.col("expected")
    return cells.select(
        F.col("v1").alias(var1),
        F.col("v2").alias(var2),
        "observed",
        "expected",
        (off**2 / F.col("expected")).alias("chisq"),
        (off / F.sqrt("expected")).alias("dev_std"),
        (F.col("observed") / F.col("row_total")).alias("perc_row"),
        (F.col("observed") / F.col("col_total")).alias("perc_col"),
        (F.col("observed") / F.col("total")).alias("perc"),
    )


def cross_tabs(data, var1: str, var2: str, most: int = 1000) -> Result:
    """Chi-square test of independence without continuity correction; rows with a null are left out and counted.

    All pairs of levels come to the driver; a variable with more than `most` levels raises ValueError.
    """
    d = named(data)
    need_columns(d.df, [var1, var2])
    for v in (var1, var2):
        levels_of(d.df.select(col(v).cast("string").alias(v)), v, most=most)
    cells = [r.asDict() for r in crosstab_frame(d.df, var1, var2).orderBy(col(var1), col(var2)).collect()]
    missing = d.df.filter(col(var1).isNull() | col(var2).isNull()).count()
    a, b = len({c[var1] for c in cells}), len({c[var2] for c in cells})
    chisq, dof = sum(c["chisq"] for c in cells), max(0, (a - 1) * (b - 1))
    p = S.chisq_sf(chisq, dof) if dof else math.nan
    low = sum(c["expected"] < 5 for c in cells)
    totals = {"row": {}, "col": {}, "all": sum(c["observed"] for c in cells)}
    for c in cells:
        totals["row"][c[var1]] = totals["row"].get(c[var1], 0) + c["observed"]
        totals["col"][c[var2]] = totals["col"].get(c[var2], 0) + c["observed"]
    out = Result("Cross-tabs", d.name, {"Variables": f"{var1}, {var2}"}, cells, [{"chisq": chisq, "df": dof, "p_value": p, "expected_under_5": 100 * low / len(cells) if cells else 0.0, "n_missing": missing, "stars": sig_stars(p)}])
    out.totals = totals
    return out


class ProbabilityError(IndexError, ValueError):
    """Too few probabilities."""


def goodness(data, var: str, probs: list[float] | None = None) -> Result:
    """Counts of the levels (in order) against probabilities, equal ones by default; parts are given exactly and rounded."""
    d = named(data)
    need_columns(d.df, [var])
    counts = d.df.filter(col(var).isNotNull()).groupBy(col(var)).agg(F.count("*").alias("n")).orderBy(col(var)).collect()
    k, n = len(counts), sum(r.n for r in counts)
    probs = list(probs) if probs is not None else [1 / k] * k if k else []
    if len(probs) < k:
        raise ProbabilityError(f"{k} probabilities are needed")
    if len(probs) > k or (k and abs(sum(probs) - 1) > 1e-3):
        raise ValueError("Probabilities must be one for each level and sum to 1")
    rows = []
    for r, p in zip(counts, probs, strict=True):
        e = n * p
        rows.append({var: r[0], "observed": r.n, "prob": p, "expected": e, "chisq": round(_over((r.n - e) ** 2, e), 2), "dev_std": round(_over(r.n - e, math.sqrt(e)), 2), "chisq_exact": _over((r.n - e) ** 2, e)})
    chisq = sum(r["chisq_exact"] for r in rows)
    p = S.chisq_sf(chisq, k - 1) if k > 1 else math.nan
    return Result("Goodness of fit", d.name, {"Variable": var}, rows, [{"chisq": chisq, "df": k - 1, "p_value": p, "expected_under_5": 100 * sum(r["expected"] < 5 for r in rows) / k if k else 0.0, "stars": sig_stars(p)}])


def central_limit_theorem(spark, dist: str, sample_size: int, num_samples: int, seed: int = 1234, **k) -> DataFrame:
    """(sample, mean, sd) of `num_samples` samples, drawn on the executors. dist: normal, binomial, uniform, exponential."""
    u = F.rand(seed)
    draws = {
        "normal": lambda: k.get("mean", 0) + k.get("sd", 1) * F.randn(seed),
        "uniform": lambda: k.get("min", 0) + (k.get("max", 1) - k.get("min", 0)) * u,
        "exponential": lambda: -k.get("rate", 1) * F.log1p(-u),
        "binomial": lambda: reduce(lambda a, b: a + b, [(F.rand(seed + i) < k.get("p", 0.5)).cast("int") for i in range(k.get("n", 1))]),
    }
    if dist not in draws:
        raise ValueError(f"Unknown distribution: {dist}")
    rows = spark.range(sample_size * num_samples).select(F.floor(F.col("id") / sample_size).alias("sample"), draws[dist]().cast("double").alias("x"))
    return rows.groupBy("sample").agg(F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd"))


def sample_size(type: str = "mean", err: float = 1.0, sd: float = 1.0, p: float = 0.5, conf: float = 0.95, pop_size: float | None = None, incidence: float = 1.0, response: float = 1.0) -> dict:
    """Respondents needed for a mean or a proportion within `err`, corrected for the population, and the contacts for them."""
    z = S.norm_ppf((1 + conf) / 2)
    n = (z * sd / err) ** 2 if type == "mean" else z * z * p * (1 - p) / (err * err)
    if pop_size:
        n = n * pop_size / (n - 1 + pop_size)
    n = math.ceil(n)
    return {"n": n, "contacts": math.ceil(n / incidence / response)}
