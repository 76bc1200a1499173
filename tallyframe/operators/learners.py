"""Forests, boosted trees and neural networks on fixed design columns, and cross-validation of their settings."""

from __future__ import annotations

import hashlib
import itertools
import json
import math
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .combine import numbered
from .common import col, listed, named, need_columns, numeric_columns
from .design import Design
from .evaluate import _auc_frame, evalreg
from .rows import sample_rows
from .simulate import sim_prediction


class Learner:
    """What the models share: levels and columns frozen at the fit, predictions for data or simulated grids, metrics.

    mod_type classification gives the probability of `lev`; regression the value. Rows with a null in any variable are left
    out of the fit and counted in nobs_dropped. Factors with two levels give one column, others one for each level.
    """

    title = "Model"

    def __init__(self, data, rvar: str, lev=None, evar=None, mod_type: str = "classification", levels: dict | None = None, seed: int = 1234, **settings):
        if mod_type not in ("classification", "regression"):
            raise ValueError("mod_type is classification or regression")
        d = named(data)
        self.name, self.data, self.rvar, self.lev, self.evar = d.name, d.df, rvar, lev, listed(evar)
        self.mod_type, self.seed, self.settings = mod_type, seed, settings
        need_columns(d.df, [rvar, *self.evar])
        self.design = Design.of(d.df, self.evar, None, levels, intercept=False)
        full = self.design.complete(d.df, rvar)
        counts = d.df.count(), full.count()
        self.nobs, self.nobs_dropped = counts[1], counts[0] - counts[1]
        self._prepare(full)
        self._fit(self._columns(full).withColumn("__label", self._label()).withColumn("__key", F.xxhash64(*map(col, full.columns))))

    def _label(self):
        return F.when(col(self.rvar).cast("string") == F.lit(str(self.lev)), 1.0).otherwise(0.0) if self.mod_type == "classification" else col(self.rvar).cast("double")

    def _prepare(self, full: DataFrame) -> None:
        self.columns = []
        for v in self.evar:
            if v in self.design.levels:
                levels = self.design.levels[v]
                for x in levels[1:] if len(levels) <= 2 else levels:
                    text = str(x).lower() if isinstance(x, bool) else str(x)
                    self.columns.append((f"{v}_{x}", F.when(col(v).cast("string") == F.lit(text), 1.0).otherwise(0.0)))
            else:
                self.columns.append((v, col(v).cast("double")))

    def _columns(self, df: DataFrame) -> DataFrame:
        from pyspark.ml.feature import VectorAssembler

        made = df.withColumns({f"__f{i}": c for i, (_, c) in enumerate(self.columns)})
        names = [f"__f{i}" for i in range(len(self.columns))]
        return VectorAssembler(inputCols=names, outputCol="__features", handleInvalid="keep").transform(made).drop(*names)

    def _fit(self, train: DataFrame) -> None:
        raise NotImplementedError

    def _score(self, df: DataFrame) -> DataFrame:
        out = self.model.transform(self._columns(df))
        if self.mod_type == "classification":
            from pyspark.ml.functions import vector_to_array

            out = out.withColumn("__p", F.get(vector_to_array("probability"), F.lit(1)))
        else:
            out = out.withColumn("__p", F.col("__prediction"))
        return out.select(*map(col, df.columns), F.col("__p").alias("prediction"))

    def predict(self, data=None, cmd=None, data_cmd: dict | None = None) -> DataFrame:
        """Add `prediction`. A level that training has not seen raises ValueError."""
        df = self.data if data is None else data
        if cmd is not None:
            df = sim_prediction(df, cmd, self.evar, self.design.levels)
        if data_cmd:
            df = df.withColumns({k: F.lit(v) for k, v in data_cmd.items()})
        return self._score(self.design.check(df.drop("prediction")))

    def metrics(self, data=None) -> dict:
        scored = self.predict(self.design.complete(self.data if data is None else data, self.rvar))
        if self.mod_type == "classification":
            return {"auc": _auc_frame(scored, col(self.rvar).cast("string") == F.lit(str(self.lev)), "prediction", []).first()[0]}
        return evalreg(scored, self.rvar, "prediction", 6).first().asDict()

    def summary(self, dec: int = 3) -> str:
        m = ", ".join(f"{k}: {round(v, dec) if isinstance(v, float) else v}" for k, v in self.metrics().items())
        return "\n".join([self.title, f"Data: {self.name}", f"Response variable: {self.rvar}", *([f"Level: {self.lev}"] if self.lev is not None else []), f"Explanatory variables: {', '.join(self.evar)}", f"Model type: {self.mod_type}", f"Nr obs: {self.nobs} ({self.nobs_dropped} dropped)", f"Nr features: {len(self.columns)}", *[f"{k}: {v}" for k, v in self.settings.items()], m])


class rforest(Learner):
    """Random forest. out_of_bag gives each row the mean prediction of the bags that have not drawn it; out_of_fold that of a
    forest fitted without its fold."""

    title = "Random forest"

    def _estimator(self):
        from pyspark.ml.classification import RandomForestClassifier
        from pyspark.ml.regression import RandomForestRegressor

        s = self.settings
        common = {"featuresCol": "__features", "labelCol": "__label", "predictionCol": "__prediction", "seed": self.seed, "numTrees": s.get("n_estimators", 100), "maxDepth": s.get("max_depth", 10), "minInstancesPerNode": s.get("min_samples_leaf", 1), "subsamplingRate": s.get("max_samples", 1.0), "featureSubsetStrategy": str(s.get("max_features", "auto"))}
        return (RandomForestClassifier if self.mod_type == "classification" else RandomForestRegressor)(**common)

    def _fit(self, train: DataFrame) -> None:
        self._train = train
        self.model = self._estimator().fit(train)

    def out_of_bag(self, bags: int = 10) -> DataFrame:
        """The rows with `prediction`: each of `bags` bags draws every row a Poisson number of times (by its hash) and grows its
        share of the trees; a row is predicted by the bags that drew it zero times. Null for a row that every bag drew."""
        total, parts, p = self.settings.get("n_estimators", 100), [], []
        chance = [math.exp(-1) / math.factorial(k) for k in range(8)]
        for b in range(bags):
            u = F.pmod(F.xxhash64(F.lit(self.seed), F.lit(b), "__key"), F.lit(1 << 30)) / float(1 << 30)
            drawn = reduce(lambda x, y: x + y, [(u >= sum(chance[: k + 1])).cast("double") for k in range(len(chance))])
            bag = self._train.withColumn("__drawn", drawn)
            n = total // bags + (b < total % bags)
            if not n:
                continue
            model = self._estimator().setNumTrees(n).setSeed(self.seed + b).setWeightCol("__drawn").fit(bag.filter("__drawn > 0"))
            keep, self.model = self.model, model
            try:
                parts.append(self._score(bag.filter("__drawn = 0").drop("__features", "__label", "__drawn")).select("__key", "prediction"))
            finally:
                self.model = keep
        mean = reduce(DataFrame.unionByName, parts).groupBy("__key").agg(F.avg("prediction").alias("prediction"))  # equal rows, equal keys
        return self._train.drop("__features", "__label").join(mean, "__key", "left").drop("__key")

    def oob_score(self, bags: int = 10) -> float | None:
        """AUC, or R-squared, of the out-of-bag predictions."""
        scored = self.out_of_bag(bags).filter("prediction is not null")
        if self.mod_type == "classification":
            return _auc_frame(scored, col(self.rvar).cast("string") == F.lit(str(self.lev)), "prediction", []).first()[0]
        return evalreg(scored, self.rvar, "prediction", 6).first().r2

    def out_of_fold(self, folds: int = 5) -> DataFrame:
        fold = F.pmod(F.xxhash64(F.lit(self.seed), "__key"), F.lit(folds))
        parts = []
        for k in range(folds):
            model = self._estimator().fit(self._train.filter(fold != k))
            keep, self.model = self.model, model
            try:
                parts.append(self._score(self._train.filter(fold == k).drop("__features", "__label")))
            finally:
                self.model = keep
        return reduce(DataFrame.unionByName, parts).drop("__key")

    def importance(self) -> dict[str, float]:
        return dict(zip([n for n, _ in self.columns], map(float, self.model.featureImportances.toArray()), strict=True))


class xgboost(Learner):
    """Gradient-boosted trees: logistic loss for a class, squared loss for a value.

    Settings and defaults: n_estimators 100, max_depth 6, learning_rate 0.3, min_child_weight 1, subsample 1,
    colsample_bytree 1 (a share of the columns; drawn anew for each node of a tree).
    """

    title = "Boosted trees"

    def _fit(self, train: DataFrame) -> None:
        from pyspark.ml.classification import GBTClassifier
        from pyspark.ml.regression import GBTRegressor

        s = self.settings
        common = {"featuresCol": "__features", "labelCol": "__label", "predictionCol": "__prediction", "seed": self.seed, "maxIter": s.get("n_estimators", 100), "maxDepth": s.get("max_depth", 6), "stepSize": s.get("learning_rate", 0.3), "subsamplingRate": s.get("subsample", 1.0), "minInstancesPerNode": max(1, int(s.get("min_child_weight", 1))), "featureSubsetStrategy": "all" if s.get("colsample_bytree", 1) >= 1 else str(float(s["colsample_bytree"]))}
        self.model = (GBTClassifier if self.mod_type == "classification" else GBTRegressor)(**common).fit(train)


_ACTIVATION = {"identity": (lambda z: z, lambda a: np.ones_like(a)), "logistic": (lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40))), lambda a: a * (1 - a)), "tanh": (np.tanh, lambda a: 1 - a * a), "relu": (lambda z: np.maximum(z, 0), lambda a: (a > 0).astype(float))}


class mlp(Learner):
    """Neural network on standardised columns (and response), fitted by full-batch L-BFGS on at most `max_rows` rows.

    The bound is a parameter; moments are of all rows, and predictions are made on the executors for all rows, as column
    expressions, so scoring stays in the JVM. activation: identity, logistic, tanh, relu; alpha: the squared penalty.
    """

    title = "Multi-layer perceptron"

    def _prepare(self, full: DataFrame) -> None:
        super()._prepare(full)
        raw = self.columns
        plain = {n for n in numeric_columns(full) if n in self.evar}
        y = self._label()
        aggs = [f(c).alias(f"{k}{i}") for i, (n, c) in enumerate(raw) if n in plain for k, f in (("m", F.avg), ("s", F.stddev_pop))]
        row = full.agg(F.avg(y).alias("my"), F.stddev_pop(y).alias("sy"), *aggs).first()
        self.moments = {n: (row[f"m{i}"], row[f"s{i}"] or 1.0) for i, (n, _) in enumerate(raw) if n in plain}
        self.y_moments = (row.my, row.sy or 1.0) if self.mod_type == "regression" else (0.0, 1.0)
        self.columns = [(n, (c - F.lit(self.moments[n][0])) / F.lit(self.moments[n][1]) if n in self.moments else c) for n, c in raw]

    def _fit(self, train: DataFrame) -> None:
        from pyspark.ml.functions import vector_to_array

        s = self.settings
        sample = sample_rows(train.select("__key", vector_to_array("__features").alias("x"), "__label"), s.get("max_rows", 50_000), seed=self.seed)
        got = sample.toPandas()
        x = np.array(got["x"].tolist(), float).reshape(len(got), len(self.columns))
        y = (got["__label"].to_numpy(float) - self.y_moments[0]) / self.y_moments[1]
        hidden = s.get("hidden_layer_sizes", (5,))
        hidden = (hidden,) if isinstance(hidden, int) else tuple(hidden)
        self.layers = [len(self.columns), *hidden, 1]
        shapes = [(a, b) for a, b in zip(self.layers, self.layers[1:], strict=False)]
        act, slope = _ACTIVATION[s.get("activation", "tanh")]
        alpha = s.get("alpha", 1e-4)
        classify = self.mod_type == "classification"
        rng = np.random.default_rng(self.seed)
        theta = np.concatenate([np.concatenate([rng.uniform(-1, 1, a * b) * math.sqrt(6 / (a + b)), np.zeros(b)]) for a, b in shapes])

        def unpack(t: np.ndarray) -> list:
            out, at = [], 0
            for a, b in shapes:
                out.append((t[at : at + a * b].reshape(a, b), t[at + a * b : at + a * b + b]))
                at += a * b + b
            return out

        def loss(t: np.ndarray) -> tuple[float, np.ndarray]:
            w = unpack(t)
            a = [x]
            for i, (m, b) in enumerate(w):
                z = a[-1] @ m + b
                a.append(z if i == len(w) - 1 else act(z))
            z = a[-1][:, 0]
            n = len(x)
            if classify:
                value = (np.logaddexp(0, z) - y * z).mean()
                d = ((1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) / n)[:, None]
            else:
                value = ((z - y) ** 2).mean() / 2
                d = ((z - y) / n)[:, None]
            grads: list[np.ndarray] = []
            for i in range(len(w) - 1, -1, -1):
                m = w[i][0]
                grads = [(a[i].T @ d + alpha * m / n).ravel(), d.sum(axis=0), *grads]
                if i:
                    d = (d @ m.T) * slope(a[i])
            return value + alpha / 2 / n * sum((m**2).sum() for m, _ in w), np.concatenate(grads)

        self.weights = unpack(_lbfgs(loss, theta, s.get("max_iter", 500)))
        self.n_weights = len(theta)

    def _score(self, df: DataFrame) -> DataFrame:
        kinds = {"identity": lambda z: z, "logistic": lambda z: 1 / (1 + F.exp(-z)), "tanh": F.tanh, "relu": lambda z: F.greatest(z, F.lit(0.0))}
        act = kinds[self.settings.get("activation", "tanh")]
        out = df.withColumns({f"__l0_{i}": c for i, (_, c) in enumerate(self.columns)})
        width = len(self.columns)
        for k, (m, b) in enumerate(self.weights):
            last = k == len(self.weights) - 1
            z = [reduce(lambda p, q: p + q, [F.col(f"__l{k}_{i}") * F.lit(float(m[i, j])) for i in range(width)] or [F.lit(0.0)]) + F.lit(float(b[j])) for j in range(m.shape[1])]
            out = out.withColumns({f"__l{k + 1}_{j}": c if last else act(c) for j, c in enumerate(z)})
            width = m.shape[1]
        z = F.col(f"__l{len(self.weights)}_0")
        p = 1 / (1 + F.exp(-z)) if self.mod_type == "classification" else z * F.lit(self.y_moments[1]) + F.lit(self.y_moments[0])
        return out.withColumn("prediction", p).select(*map(col, df.columns), "prediction")


def _lbfgs(f, x: np.ndarray, steps: int, memory: int = 10, tol: float = 1e-6) -> np.ndarray:
    value, g = f(x)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        if np.abs(g).max() < tol:
            break
        q, coefs = g.copy(), []
        for s, y in reversed(past):
            c = s @ q / (s @ y)
            coefs.append(c)
            q -= c * y
        if past:
            s, y = past[-1]
            q *= s @ y / (y @ y)
        for (s, y), c in zip(past, reversed(coefs), strict=True):
            q += s * (c - y @ q / (s @ y))
        t = 1.0 if past else min(1.0, 1 / np.abs(g).sum())
        while t > 1e-12:
            new = x - t * q
            v, h = f(new)
            if v <= value - 1e-4 * t * (g @ q):
                break
            t /= 2
        else:
            break
        s, y = new - x, h - g
        if s @ y > 1e-12:
            past = [*past, (s, y)][-memory:]
        x, value, g = new, v, h
    return x


SCORES = {"classification": ("auc", "accuracy"), "regression": ("r2", "rmse")}


def _scores(model: Learner, test: DataFrame, names: list[str]) -> dict[str, float | None]:
    """auc, accuracy (at one half), r2, rmse, mse and mae of a model on a frame, in one pass for all but auc."""
    scored = model.predict(model.design.complete(test, model.rvar))
    if model.mod_type == "classification":
        hit = col(model.rvar).cast("string") == F.lit(str(model.lev))
        known = {"auc": lambda: _auc_frame(scored, hit, "prediction", []).first()[0], "accuracy": lambda: scored.agg(F.avg((hit == (F.col("prediction") > 0.5)).cast("double"))).first()[0]}
    else:
        fit = evalreg(scored, model.rvar, "prediction", 9).first()
        fit = fit.asDict() if fit else {}
        known = {k: lambda k=k: fit.get(k) for k in ("r2", "mse", "mae")} | {"rmse": lambda: math.sqrt(fit["mse"]) if fit.get("mse") is not None else None}
    unknown = [n for n in names if n not in known]
    if unknown:
        raise ValueError(f"Unknown scores: {', '.join(unknown)}; known: {', '.join(known)}")
    return {n: known[n]() for n in names}


def cross_validation(kind: type, data, rvar: str, lev=None, evar=None, mod_type: str = "classification", param_grid: dict | None = None, scoring: list[str] | None = None, n_splits: int = 5, seed: int = 1234, cache: str | None = None, **settings) -> dict:
    """Mean scores of each combination of settings over folds; best_params are those of the best first score.

    scoring: auc and accuracy for a class, r2 and rmse for a value (the lower the better, as for mse and mae). For a class the
    folds have equal shares of each of its levels. results: params, mean (of the first score), scores (by fold) and all
    (mean and folds of every score). `cache`: a folder (of any file system Spark reaches) that keeps each result as JSON
    under a digest of the model, the variables, the grid, the folds and the settings, from which it is taken again.
    """
    d = named(data)
    spark = d.df.sparkSession
    names = listed(scoring) or list(SCORES[mod_type])
    if cache:
        asked = [kind.__name__, d.name, sorted(d.df.dtypes), rvar, lev, listed(evar), mod_type, param_grid, names, n_splits, seed, settings]
        cache = f"{cache}/{hashlib.sha256(json.dumps(asked, sort_keys=True, default=str).encode()).hexdigest()[:32]}"
        try:
            return json.loads(spark.read.text(cache).first()[0])
        except Exception as e:  # no such folder yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
    design = Design.of(d.df, listed(evar), intercept=False)
    draw = F.xxhash64(F.lit(seed), *map(col, d.df.columns))
    if mod_type == "classification":
        folded = numbered(d.df.withColumn("__draw", draw), [rvar, "__draw"], "__at").withColumn("__fold", F.col("__at") % n_splits).drop("__draw", "__at")
    else:
        folded = d.df.withColumn("__fold", F.pmod(draw, F.lit(n_splits)))
    folded = folded.persist()
    part = lambda same, k: folded.filter((F.col("__fold") == k) == same).drop("__fold")
    grid = [dict(zip(param_grid or {}, v, strict=True)) for v in itertools.product(*(param_grid or {}).values())]
    rows = []
    for g in grid:
        scores = [_scores(kind(part(False, k), rvar, lev, evar, mod_type, design.levels, seed, **settings, **g), part(True, k), names) for k in range(n_splits)]
        by = {n: [s[n] for s in scores if s[n] is not None] for n in names}
        every = {n: {"mean": sum(v) / len(v) if v else None, "folds": [s[n] for s in scores]} for n, v in by.items()}
        rows.append({"params": g, "mean": every[names[0]]["mean"], "scores": every[names[0]]["folds"], "all": every})
    folded.unpersist()
    sign = -1 if names[0] in ("rmse", "mse", "mae") else 1
    best = max(rows, key=lambda r: -math.inf if r["mean"] is None else sign * r["mean"])
    out = {"results": rows, "best_params": best["params"], "best_score": best["mean"], "scoring": names}
    if cache:
        spark.createDataFrame([(json.dumps(out),)], "value string").coalesce(1).write.text(cache)
    return out
