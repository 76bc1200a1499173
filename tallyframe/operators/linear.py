"""Linear and logistic regression: Gram matrices by distributed aggregation, small algebra on the driver."""

from __future__ import annotations

import math
import warnings
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import special as S
from ..functions.text import ci_label, sig_stars
from .common import as_frame, col, listed, named, need_columns
from .design import Design, parse_formula
from .evaluate import _auc_frame
from .simulate import sim_prediction


def gram(df: DataFrame, xs: list[Column], more: dict[str, Column] | None = None, weight: Column | None = None) -> tuple[np.ndarray, dict]:
    """X'WX in one aggregation, and other sums."""
    w = weight if weight is not None else F.lit(1.0)
    pairs = [(i, j) for i in range(len(xs)) for j in range(i, len(xs))]
    named_cols = df.select(*[x.alias(f"x{i}") for i, x in enumerate(xs)], w.alias("w"), *[c.alias(f"m_{k}") for k, c in (more or {}).items()])
    sums = [F.sum(F.col(f"x{i}") * F.col(f"x{j}") * F.col("w")).alias(f"g{i}_{j}") for i, j in pairs]
    sums += [F.sum(F.col(f"m_{k}")).alias(f"s_{k}") for k in more or {}]
    row = named_cols.agg(*sums, F.count("*").alias("n")).first()
    g = np.zeros((len(xs), len(xs)))
    for i, j in pairs:
        g[i, j] = g[j, i] = row[f"g{i}_{j}"] or 0.0
    return g, {"n": row.n, **{k: row[f"s_{k}"] or 0.0 for k in more or {}}}


def _dot(columns: list[Column], beta) -> Column:
    return reduce(lambda a, b: a + b, [c * F.lit(float(b)) for c, b in zip(columns, beta, strict=True)])


class Scale:
    """Centres and spreads of the design columns (of one earlier aggregation), in which all algebra is done.

    With an intercept a column is centred at its mean and divided by its standard deviation, without one divided by its
    root mean square; a constant column is left to the intercept. `back` takes coefficients to the raw columns.
    """

    def __init__(self, df: DataFrame, xs: list[Column], intercept: bool, extra: Column | None = None):
        at = range(int(intercept), len(xs))
        aggs = [a for i in at for a in (F.avg(xs[i]).alias(f"m{i}"), F.stddev_pop(xs[i]).alias(f"s{i}"), F.avg(xs[i] * xs[i]).alias(f"q{i}"))]
        row = df.agg(F.count("*").alias("n"), *([F.avg(extra).alias("extra")] if extra is not None else []), *aggs).first()
        self.n, self.extra = row.n, (row["extra"] or 0.0) if extra is not None else 0.0
        self.centre, self.spread = np.zeros(len(xs)), np.ones(len(xs))
        for i in at:
            m, s = row[f"m{i}"] or 0.0, row[f"s{i}"] or 0.0
            if intercept:
                constant = s <= 1e-13 * abs(m)
                self.centre[i], self.spread[i] = m, 1.0 if constant else s
            else:
                self.spread[i] = math.sqrt(row[f"q{i}"] or 0.0) or 1.0
        self.back = np.diag(1 / self.spread)
        if intercept:
            self.back[0, 1:] = -self.centre[1:] / self.spread[1:]

    def columns(self, xs: list[Column]) -> list[Column]:
        return [(x - F.lit(float(m))) / F.lit(float(s)) if m or s != 1 else x for x, m, s in zip(xs, self.centre, self.spread, strict=True)]


def _inverse(g: np.ndarray, names: list[str]) -> tuple[np.ndarray, int]:
    """Pseudo-inverse and rank of a scaled Gram matrix; warns of columns that others determine."""
    inv, rank = np.linalg.pinv(g, hermitian=True), int(np.linalg.matrix_rank(g, hermitian=True))
    if rank < len(g):
        warnings.warn(f"Only {rank} of {len(g)} design columns are independent: {', '.join(names)}", stacklevel=3)
    return inv, rank


class _Model:
    design: Design
    scale: Scale
    beta: np.ndarray
    cov: np.ndarray
    beta_z: np.ndarray
    cov_z: np.ndarray
    rvar: str

    def _setup(self, data, rvar, evar, ivar, formula, levels) -> DataFrame:
        d = named(data)
        self.name, intercept = d.name, True
        if formula:
            rvar, evar, intercept = parse_formula(formula)
            ivar = None
        self.rvar, self.evar = rvar, listed(evar)
        need_columns(d.df, [rvar])
        self.design = Design.of(d.df, self.evar, listed(ivar), levels, intercept)
        self.names = [n for n, _, _ in self.design.columns()]
        self.terms = [t for _, t, _ in self.design.columns()]
        return d.df

    def _coef(self, quantile, p_value, stat: str) -> list[dict]:
        se = np.sqrt(np.maximum(0, np.diag(self.cov)))
        out = []
        for n, b, s in zip(self.names, self.beta, se, strict=True):
            v = b / s if s else math.nan
            p = p_value(v)
            out.append({"index": n, "coefficient": float(b), "std_error": float(s), stat: float(v), "p_value": p, "stars": sig_stars(p)})
        return out

    def coef_ci(self, conf: float = 0.95) -> list[dict]:
        q = self._quantile((1 + conf) / 2)
        low, high = ci_label("two-sided", conf)
        return [{"index": c["index"], "coefficient": c["coefficient"], low: c["coefficient"] - q * c["std_error"], high: c["coefficient"] + q * c["std_error"]} for c in self.coef]

    def _wald(self, keep_out: list[str]) -> tuple[float, int, list[int]]:
        at = [i for i, t in enumerate(self.terms) if t != "Intercept" and any(v in keep_out for v in [t, *Design._variables(t)])]
        if not at:
            raise ValueError(f"No terms with {', '.join(keep_out)}")
        b = self.beta_z[at]
        return float(b @ np.linalg.pinv(self.cov_z[np.ix_(at, at)]) @ b), len(at), at

    def vif(self) -> list[dict]:
        """Variance inflation of each term: by determinants of correlations for terms of several columns, classic else."""
        at = [i for i, n in enumerate(self.names) if n != "Intercept"]
        if not self.design.intercept or len(at) < 2:
            return []
        g, n = self.gram_z, self.gram_z[0, 0]
        i0 = self.names.index("Intercept")
        c = g[np.ix_(at, at)] - np.outer(g[at, i0], g[i0, at]) / n
        sd = np.sqrt(np.diag(c))
        r = c / np.outer(sd, sd)
        out = []
        for t in dict.fromkeys(self.terms[i] for i in at):
            own = [k for k, i in enumerate(at) if self.terms[i] == t]
            rest = [k for k in range(len(at)) if k not in own]
            if not rest:
                continue
            v = np.linalg.det(r[np.ix_(own, own)]) * np.linalg.det(r[np.ix_(rest, rest)]) / np.linalg.det(r)
            out.append({"variable": t, "vif": float(v), "Rsq": float(1 - 1 / v)})
        return sorted(out, key=lambda x: -x["vif"])

    def _link_frame(self, data, cmd, data_cmd, conf) -> tuple[DataFrame, Column, Column]:
        df = as_frame(data) if data is not None else self.data
        if cmd is not None:
            df = sim_prediction(df, cmd, self.design.variables, self.design.levels)
        if data_cmd:
            df = df.withColumns({k: F.lit(v) for k, v in data_cmd.items()})
        df = self.design.check(df)
        xs = self.scale.columns([c for _, _, c in self.design.columns()])
        quad = reduce(lambda a, b: a + b, [xs[i] * xs[j] * F.lit(float(self.cov_z[i, j]) * (1 if i == j else 2)) for i in range(len(xs)) for j in range(i, len(xs))])
        return df, _dot(xs, self.beta_z), F.sqrt(F.greatest(quad, F.lit(0.0))) * F.lit(S.norm_ppf((1 + conf) / 2))


class regress(_Model):
    """Least squares by the normal equations of centred and scaled columns: one aggregation for centres and spreads, one
    for X'X and X'y, one for the residuals. Coefficients and covariances are those of the raw columns."""

    def __init__(self, data, rvar: str | None = None, evar=None, ivar=None, formula: str | None = None, levels: dict | None = None):
        df = self._setup(data, rvar, evar, ivar, formula, levels)
        self.data = df
        full = self.design.complete(df, self.rvar)
        raw = [c for _, _, c in self.design.columns()]
        y = col(self.rvar).cast("double")
        self.scale = Scale(full, raw, self.design.intercept, y)
        middle = self.scale.extra if self.design.intercept else 0.0
        xs, yc = self.scale.columns(raw), y - F.lit(float(middle))
        g, sums = gram(full, [*xs, yc], {"y": yc})
        k = len(xs)
        self.gram_z, xy, yy, n = g[:k, :k], g[:k, k], g[k, k], sums["n"]
        self.nobs, self.nobs_dropped = n, df.count() - n
        inv, rank = _inverse(self.gram_z, self.names)
        self.beta_z = inv @ xy
        e = yc - _dot(xs, self.beta_z)
        self.sse = full.agg(F.sum(e * e)).first()[0] or 0.0
        if self.design.intercept and k:
            self.beta_z[0] += middle
        self.beta = self.scale.back @ self.beta_z
        self.df_resid, self.df_model = n - rank, rank - bool(self.design.intercept)
        s2 = self.sse / self.df_resid if self.df_resid > 0 else math.nan
        self.cov_z = inv * s2
        self.cov = self.scale.back @ self.cov_z @ self.scale.back.T
        self.sst = yy - sums["y"] ** 2 / n if self.design.intercept and n else yy
        self.rsq = 1 - self.sse / self.sst if self.sst else math.nan
        self.rsq_adj = 1 - (1 - self.rsq) * (n - bool(self.design.intercept)) / self.df_resid if self.df_resid > 0 else math.nan
        self.rmse = math.sqrt(self.sse / n) if n else math.nan
        self.f = ((self.sst - self.sse) / self.df_model) / s2 if self.df_model and s2 else math.nan
        self.f_p = S.f_sf(self.f, self.df_model, self.df_resid) if self.f == self.f else math.nan
        self.coef = self._coef(None, lambda t: 2 * S.t_sf(abs(t), self.df_resid) if t == t and self.df_resid > 0 else math.nan, "t_value")

    def _quantile(self, p: float) -> float:
        return S.t_ppf(p, self.df_resid)

    def f_test(self, test) -> dict:
        """Drop the variables, with their interactions: F, its p-value, and R-squared without them."""
        w, k, _ = self._wald(listed(test))
        f = w / k
        return {"F": f, "df1": k, "df2": self.df_resid, "p_value": S.f_sf(f, k, self.df_resid), "rsq_reduced": 1 - self.sse * (1 + w / self.df_resid) / self.sst}

    def predict(self, data=None, cmd: dict | None = None, data_cmd: dict | None = None, ci: bool = False, conf: float = 0.95) -> DataFrame:
        """Add `prediction` (with ci also ci_low and ci_high): for data, a simulated grid (cmd), or with columns set (data_cmd)."""
        df, link, half = self._link_frame(data, cmd, data_cmd, conf)
        return df.withColumns({"prediction": link} | ({"ci_low": link - half, "ci_high": link + half} if ci else {}))

    def residuals(self) -> DataFrame:
        df, link, _ = self._link_frame(None, None, None, 0.95)
        return self.design.complete(df, self.rvar).withColumn("fitted", link).withColumn("residual", col(self.rvar) - F.col("fitted")).withColumn("std_residual", F.col("residual") / F.lit(math.sqrt(self.sse / max(1, self.df_resid)) or 1.0))

    def summary(self, dec: int = 3) -> str:
        rows = [f"{c['index']:<24} {c['coefficient']:>12.{dec}f} {c['std_error']:>10.{dec}f} {c['t_value']:>9.{dec}f} {c['p_value']:>8.{dec}f} {c['stars']}" for c in self.coef]
        return "\n".join(["Linear regression (OLS)", f"Data: {self.name}", f"Response variable: {self.rvar}", f"Explanatory variables: {', '.join(self.evar)}", "", *rows, "", f"R-squared: {self.rsq:.{dec}f}, adjusted: {self.rsq_adj:.{dec}f}", f"F-statistic: {self.f:.{dec}f} df({self.df_model}, {self.df_resid}), p.value {self.f_p:.{dec}f}", f"Nr obs: {self.nobs} ({self.nobs_dropped} dropped)"])


class logistic(_Model):
    """Binomial regression with frequency weights: each step of the iteration is one weighted Gram aggregation over centred
    and scaled columns. Coefficients and covariances are those of the raw columns."""

    def __init__(self, data, rvar: str | None = None, lev=None, evar=None, ivar=None, formula: str | None = None, weights: str | None = None, levels: dict | None = None, max_iter: int = 30, tol: float = 1e-10):
        df = self._setup(data, rvar, evar, ivar, formula, levels)
        self.lev, self.weights, self.data = lev, weights, df
        full = self.design.complete(df, self.rvar, *listed(weights))
        y = F.when(col(self.rvar).cast("string") == F.lit(str(lev)), 1.0).otherwise(0.0)
        xs = [c for _, _, c in self.design.columns()]
        k = len(xs)
        w = col(weights).cast("double") if weights else F.lit(1.0)
        self.scale = Scale(full, xs, self.design.intercept)
        full = full.select(*[x.alias(f"_x{i}") for i, x in enumerate(self.scale.columns(xs))], y.alias("_y"), w.alias("_w")).persist()
        xs, y, w = [F.col(f"_x{i}") for i in range(k)], F.col("_y"), F.col("_w")
        totals = full.agg(F.sum("_w"), F.sum(F.col("_w") * F.col("_y")), F.count("*")).first()
        n, ones = totals[0] or 0.0, totals[1] or 0.0
        if not 0 < ones < n:
            full.unpersist()
            raise ValueError(f"All values of {self.rvar} are alike")
        self.nobs, self.nobs_dropped = n, df.count() - totals[2]
        self.beta_z, before, self.converged = np.zeros(k), -math.inf, False
        for _ in range(max_iter):
            eta = _dot(xs, self.beta_z)
            p = 1 / (1 + F.exp(-eta))
            ll = w * (y * eta - F.when(eta > 30, eta).otherwise(F.log1p(F.exp(F.least(eta, F.lit(30.0))))))
            score = {f"u{i}": w * x * (y - p) for i, x in enumerate(xs)}
            g, sums = gram(full, xs, score | {"ll": ll}, w * p * (1 - p))
            self.llf = sums["ll"]
            self.cov_z = np.linalg.pinv(g, hermitian=True)
            if abs(self.llf - before) < tol * (abs(self.llf) + 0.1):
                self.converged = True
                break
            before = self.llf
            step = self.cov_z @ np.array([sums[f"u{i}"] for i in range(k)])
            largest = np.abs(step).max()
            self.beta_z = self.beta_z + step * min(1.0, 10 / largest if largest else 1.0)
        self.gram_z, _ = gram(full, xs, None, w)
        full.unpersist()
        _inverse(self.gram_z, self.names)
        if not self.converged:
            warnings.warn(f"Not converged after {max_iter} steps", stacklevel=2)
        self.beta, self.cov = self.scale.back @ self.beta_z, self.scale.back @ self.cov_z @ self.scale.back.T
        rate = ones / n
        self.ll_null = ones * math.log(rate) + (n - ones) * math.log(1 - rate)
        self.k = k
        self.rsq_mcf, self.rsq_mcf_adj = 1 - self.llf / self.ll_null, 1 - (self.llf - (k - 1)) / self.ll_null
        self.aic, self.bic = 2 * k - 2 * self.llf, math.log(n) * k - 2 * self.llf
        self.chisq, self.chisq_df = 2 * (self.llf - self.ll_null), k - 1
        self.chisq_p = S.chisq_sf(self.chisq, self.chisq_df) if self.chisq_df else math.nan
        self.coef = self._coef(None, lambda z: min(1.0, 2 * S.norm_cdf(-abs(z))), "z_value")
        for c in self.coef:
            c["OR"] = math.exp(min(700, c["coefficient"]))
            c["OR_pct"] = 100 * (c["OR"] - 1)

    def _quantile(self, p: float) -> float:
        return S.norm_ppf(p)

    def or_ci(self, conf: float = 0.95) -> list[dict]:
        low, high = ci_label("two-sided", conf)
        return [{"index": c["index"], "OR": math.exp(c["coefficient"]), low: math.exp(c[low]), high: math.exp(c[high])} for c in self.coef_ci(conf) if c["index"] != "Intercept"]

    def chisq_test(self, test) -> dict:
        """Likelihood-ratio test against the model without the variables and their interactions."""
        out = listed(test)
        terms = [t for t in self.design.terms if t not in out and not any(v in out for v in Design._variables(t))]
        plain, crossed = [t for t in terms if ":" not in t], [t for t in terms if ":" in t]
        if len(terms) == len(self.design.terms):
            raise ValueError(f"No terms with {', '.join(out)}")
        if terms:
            less = logistic(self.design.complete(self.data, self.rvar), self.rvar, self.lev, plain, crossed, None, self.weights, self.design.levels)
            ll, k = less.llf, less.k
        else:
            ll, k = self.ll_null, 1
        chisq, dof = 2 * (self.llf - ll), self.k - k
        return {"chisq": chisq, "df": dof, "p_value": S.chisq_sf(chisq, dof)}

    def predict(self, data=None, cmd: dict | None = None, data_cmd: dict | None = None, ci: bool = False, conf: float = 0.95) -> DataFrame:
        """Add the probability `prediction`, with ci also ci_low and ci_high (made on the link)."""
        df, link, half = self._link_frame(data, cmd, data_cmd, conf)
        expit = lambda c: 1 / (1 + F.exp(-c))
        return df.withColumns({"prediction": expit(link)} | ({"ci_low": expit(link - half), "ci_high": expit(link + half)} if ci else {}))

    def auc(self) -> float:
        scored = self.predict(self.design.complete(self.data, self.rvar))
        return _auc_frame(scored, col(self.rvar).cast("string") == F.lit(str(self.lev)), "prediction", [], self.weights).first()[0]

    def summary(self, dec: int = 3) -> str:
        rows = [f"{c['index']:<24} {c['OR']:>10.{dec}f} {c['OR_pct']:>9.1f}% {c['coefficient']:>10.{dec}f} {c['std_error']:>10.{dec}f} {c['z_value']:>9.{dec}f} {c['p_value']:>8.{dec}f} {c['stars']}" for c in self.coef]
        return "\n".join(["Logistic regression (GLM)", f"Data: {self.name}", f"Response variable: {self.rvar}", f"Level: {self.lev}", f"Explanatory variables: {', '.join(self.evar)}", "", *rows, "", f"Pseudo R-squared (McFadden): {self.rsq_mcf:.{dec}f}, adjusted: {self.rsq_mcf_adj:.{dec}f}", f"Log-likelihood: {self.llf:.{dec}f}, AIC: {self.aic:.{dec}f}, BIC: {self.bic:.{dec}f}", f"Chi-squared: {self.chisq:.{dec}f} df({self.chisq_df}), p.value {self.chisq_p:.{dec}f}", f"Nr obs: {self.nobs:,.0f} ({self.nobs_dropped} dropped)"])
