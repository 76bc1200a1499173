import json
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyframe.operators import evaluate as E
from tallyframe.operators import explain, learners
from tallyframe.operators.design import Design, parse_formula
from tallyframe.operators.linear import logistic, regress
from tallyframe.operators.simulate import sim_prediction
from tallyframe.sources import state


@pytest.fixture(scope="module")
def perf(spark):
    np.random.seed(1234)
    n = 100
    x1 = np.random.uniform(0, 1, n)
    prob = np.random.uniform(0, 1, n)
    rnd = np.random.choice(["yes", "no"], n)
    df = pd.DataFrame({"x1": x1, "response_prob": prob, "rnd_response": rnd, "x2": 1 - x1})
    df["training"] = [1.0] * 80 + [0.0] * 20
    df["response"] = np.where((df.x1 > 0.5) & (df.response_prob > 0.5), "yes", "no")
    return spark.createDataFrame(df)


def test_deciles_are_consistent(perf):
    q = E.calc_qnt(perf, "response", "yes", "x1").orderBy("bins").collect()
    local = perf.toPandas()
    hits = int((local.response == "yes").sum())
    assert q[-1].cum_obs == 100 and q[-1].cum_resp == hits and [r.bins for r in q] == list(range(1, 11))
    assert q[0].nr_resp == int((local.sort_values("x1", ascending=False).head(10).response == "yes").sum())
    down = E.calc_qnt(perf, "response", "yes", "x2").orderBy("bins").collect()
    assert [r.cum_resp for r in down] == [r.cum_resp for r in q]
    gains = E.gains_tab(perf, "response", "yes", "x1").orderBy("cum_prop").collect()
    assert (gains[0].cum_prop, gains[0].cum_gains, gains[-1].cum_gains) == (0, 0, 1)
    assert abs(E.lift_tab(perf, "response", "yes", "x1").orderBy("cum_prop").collect()[-1].cum_lift - 1) < 1e-12


def test_evalbin_and_auc(spark, perf):
    out = E.evalbin({"train": perf.filter("training = 1"), "test": perf.filter("training = 0")}, "response", "yes", ["x1", "x2"], cost=1, margin=2).collect()
    assert len(out) == 4 and len(out[0]) == 18
    assert {r.Type for r in out} == {"train", "test"} and all(any(r["index"] == 1 for r in out if r.Type == t) for t in ("train", "test"))
    pred, y = [0.1, 0.2, 0.2, 0.3, 0.3, 0.3, 0.4, 0.5], ["yes", "no"] * 4
    tied = spark.createDataFrame(list(zip(pred, y, [1, 2, 1, 1, 3, 1, 1, 1], strict=True)), "pred double, rvar string, w int")
    assert E.auc(tied, "rvar", "pred", "yes").first().auc == pytest.approx(0.65625)
    assert E.auc(tied, "rvar", "pred", "no").first().auc == pytest.approx(0.65625)
    repeated = tied.withColumn("i", F.explode(F.sequence(F.lit(1), "w")))
    assert E.auc(tied, "rvar", "pred", "yes", "w").first().auc == pytest.approx(E.auc(repeated, "rvar", "pred", "yes").first().auc)
    assert E.auc(tied.withColumn("pred", F.exp("pred")), "rvar", "pred", "yes").first().auc == pytest.approx(0.65625)
    assert E.confusion(tied, "rvar", "yes", "pred", 1, 4).first().asDict()["TP"] == 2
    with pytest.raises(ValueError):
        E.confusion(tied, "rvar", "yes", ["pred"])


def test_profit_and_curves(perf):
    last = E.profit_tab(perf, "response", "yes", "x1", cost=1, margin=3).orderBy("cum_prop").collect()[-1]
    hits = perf.filter("response = 'yes'").count()
    assert last.cum_profit == 3 * hits - 100
    assert E.curves("gains", {"a": perf, "b": perf}, "response", "yes", ["x1", "x2"]).select("label").distinct().count() == 4
    whole = E.expected_profit(perf, "x1", 1, 3).orderBy(F.desc("cum_n")).first()
    assert whole.cum_prop == 1 and whole.profit == pytest.approx(perf.agg(F.sum(F.col("x1") * 3 - 1)).first()[0])
    assert E.evalreg(perf, "x1", "x1").first().r2 == 1
    up = E.uplift_tab(perf, "response", "yes", "x1", "rnd_response", "yes").orderBy("bins").collect()
    assert up[-1].cum_T_n == perf.filter("rnd_response = 'yes'").count() and up[-1].cum_prop == 1
    assert E.inc_profit_tab(perf, "response", "yes", "x1", "rnd_response", "yes").count() == 11


def test_formula_and_design(spark):
    assert parse_formula("y ~ a + b*c + I(d**2) - 1") == ("y", ["a", "b", "c", "b:c", "I(d**2)"], False)
    for bad in ("y", "y ~ log(a)", "y ~ a ~ b"):
        with pytest.raises(ValueError):
            parse_formula(bad)
    df = spark.createDataFrame([(1.0, "p"), (2.0, "q"), (3.0, "r")], "x double, f string")
    d = Design.of(df, ["x", "f"], ["x:f"])
    assert [n for n, _, _ in d.columns()] == ["Intercept", "x", "f[q]", "f[r]", "x:f[q]", "x:f[r]"]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    n = 400
    x, z = rng.normal(5, 2, n), rng.normal(0, 1, n)
    f = rng.choice(["a", "b", "c"], n)
    y = 1 + 2 * x - z + 3 * (f == "b") + rng.normal(0, 1, n)
    b = np.where(1 / (1 + np.exp(-(x - 5 + 2 * (f == "c")))) > rng.uniform(size=n), "yes", "no")
    pdf = pd.DataFrame({"x": x, "z": z, "f": f, "y": y, "b": b, "k": np.arange(n)})
    pdf.loc[5, "x"] = None
    return spark.createDataFrame(pdf).withColumn("x", F.when(~F.isnan("x"), F.col("x")))


def test_regress(data):
    m = regress({"toy": data}, "y", ["x", "z", "f"])
    p = data.toPandas().dropna()
    x = np.column_stack([np.ones(len(p)), p.x, p.z, p.f == "b", p.f == "c"]).astype(float)
    beta, *_ = np.linalg.lstsq(x, p.y, rcond=None)
    e = p.y - x @ beta
    s2 = (e**2).sum() / (len(p) - 5)
    assert m.beta == pytest.approx(beta) and m.nobs == 399 and m.nobs_dropped == 1
    assert [c["std_error"] for c in m.coef] == pytest.approx(np.sqrt(np.diag(np.linalg.inv(x.T @ x) * s2)).tolist())
    assert m.rsq == pytest.approx(1 - (e**2).sum() / ((p.y - p.y.mean()) ** 2).sum())
    less, *_ = np.linalg.lstsq(x[:, :3], p.y, rcond=None)
    r2 = ((p.y - x[:, :3] @ less) ** 2).sum()
    f = m.f_test("f")
    assert f["F"] == pytest.approx((r2 - (e**2).sum()) / 2 / s2) and f["rsq_reduced"] == pytest.approx(1 - r2 / ((p.y - p.y.mean()) ** 2).sum())
    fitted = m.predict(ci=True).dropna().toPandas().sort_values("k")
    assert np.allclose(fitted.prediction, x @ beta) and (fitted.ci_low < fitted.prediction).all()
    xs = x[:, [1, 2]]
    assert {v["variable"] for v in m.vif()} == {"x", "z", "f"} and all(v["vif"] >= 1 - 1e-9 for v in m.vif()) and xs.shape
    assert m.residuals().agg(F.avg("residual")).first()[0] == pytest.approx(0, abs=1e-8)
    assert m.predict(cmd={"x": [1, 2, 3]}).count() == 3 and "Linear regression" in m.summary()
    assert regress(data, formula="y ~ x + x:f").beta.shape == (4,)
    with pytest.raises(ValueError, match="not seen"):
        m.predict(data.withColumn("f", F.lit("new")))


def test_logistic(data):
    m = logistic(data, "b", "yes", ["x", "f"])
    assert m.converged
    s = m.predict(m.design.complete(data)).select((F.when(F.col("b") == "yes", 1.0).otherwise(0.0) - F.col("prediction")).alias("e"), "x").agg(F.sum("e"), F.sum(F.col("e") * F.col("x"))).first()
    assert abs(s[0]) < 1e-5 and abs(s[1]) < 1e-4  # the score equations
    assert 0.6 < m.auc() < 1 and m.chisq_test("f")["df"] == 2 and 0 < m.rsq_mcf < 1
    assert all(r["2.5%"] < r["OR"] < r["97.5%"] for r in m.or_ci())
    weighted = logistic(data.withColumn("w", F.lit(2)), "b", "yes", ["x", "f"], weights="w")
    assert weighted.beta == pytest.approx(m.beta, rel=1e-5) and weighted.cov == pytest.approx(m.cov / 2, rel=1e-4)
    with pytest.raises(ValueError):
        logistic(data, "b", "nope", ["x"])


def test_learners(data):
    f = learners.rforest(data, "b", "yes", ["x", "f"], n_estimators=10)
    p = f.predict().dropna().agg(F.min("prediction"), F.max("prediction")).first()
    assert 0 <= p[0] <= p[1] <= 1 and f.metrics()["auc"] > 0.7 and f.out_of_fold(2).count() == 399
    g = learners.xgboost(data, "y", None, ["x", "f"], "regression", n_estimators=10)
    assert g.metrics()["r2"] > 0.6
    n = learners.mlp(data, "y", None, ["x", "z", "f"], "regression", hidden_layer_sizes=(3,))
    assert n.metrics()["r2"] > 0.9 and n.n_weights == 5 * 3 + 3 + 3 + 1
    c = learners.mlp(data, "b", "yes", ["x", "f"], hidden_layer_sizes=(2,), activation="relu")
    assert c.metrics()["auc"] > 0.7 and "perceptron" in c.summary()
    imp = explain.permutation_importance(n, rep=2, n_sample=300).collect()
    assert imp[0].variable == "x" and len(imp) == 3
    means, none = explain.partial_dependence(n, "x", grid=5, n_sample=100)
    same, curves = explain.partial_dependence(n, "x", grid=5, n_sample=100, ice=7)
    assert none is None and sorted(map(str, means.collect())) == sorted(map(str, same.collect())) and curves.count() == 35
    assert explain.plot_data(n, "dashboard", nobs=20).count() == 20
    with pytest.raises(ValueError):
        learners.rforest(data, "b", "yes", ["x"], "guess")


def test_cross_validation(data, tmp_path):
    where = f"file://{tmp_path}/cv"
    args = (learners.xgboost, data, "y", None, ["x"], "regression", {"max_depth": [1, 2]})
    out = learners.cross_validation(*args, n_splits=2, cache=where, n_estimators=3)
    assert out["best_params"]["max_depth"] in (1, 2) and len(out["results"]) == 2
    assert json.dumps(learners.cross_validation(*args, n_splits=2, cache=where, n_estimators=3)) == json.dumps(out)


def test_sim_prediction(spark):
    df = spark.createDataFrame([(1, 1.0, "a"), (2, 3.0, "b"), (4, 8.0, "b")], "i int, x double, f string")
    row = sim_prediction(df).first()
    assert (row.i, row.x, row.f) == (2, 4.0, "b")
    assert [r.x for r in sim_prediction(df, "x", nnv=3).orderBy("x").collect()] == [1, 4.5, 8]
    assert sorted(r.f for r in sim_prediction(df, "f").collect()) == ["a", "b"]
    assert sim_prediction(df, {"x": [1.0, 2.0], "f": ["a"]}).count() == 2


def test_state(spark, tmp_path):
    where = f"file://{tmp_path}/state"
    df = spark.createDataFrame([(1, " a ")], "i int, s string")
    assert state.save_state(spark, {"df": df, "n": 3, "f": math.sqrt, "_x": 1}, where) == ["df", "n"]
    back = state.load_state(spark, where)
    assert back["n"] == 3 and back["df"].collect() == df.collect()
    state.write_parquet(df, f"file://{tmp_path}/p", {"s": ["b", "a"]})
    got = state.read_parquet(spark, f"file://{tmp_path}/p")
    assert got.first().s == "a" and got.schema["s"].metadata["levels"] == ["b", "a"]
    assert state.describe(state.add_description(df, "Text")) == "Text" and state.describe(df).count() > 3


def test_importance_of_all_rows(spark):
    rows = [(x, "yes" if (i * 7919) % 10 < 2 + 6 * x else "no") for x in (0, 1) for i in range(6000)]
    m = logistic(spark.createDataFrame(rows, "x int, b string"), "b", "yes", ["x"])
    assert explain.permutation_importance(m, rep=2).first().importance == pytest.approx(0.3, abs=0.03)
    assert explain.permutation_importance(m, rep=2, n_sample=1000).first().importance == pytest.approx(0.3, abs=0.1)


@pytest.mark.parametrize("shift", [0.0, 1e4, 1e6, 1e8])
def test_regression_at_any_shift_and_scale(spark, shift):
    rng = np.random.default_rng(3)
    x, big, d = rng.normal(size=400), rng.normal(size=400), (rng.random(400) < 0.4) * 1.0
    y, b = 3 * x + 5 * d + rng.normal(size=400), (rng.random(400) < 1 / (1 + np.exp(-2 * x - d))) * 1
    df = spark.createDataFrame(pd.DataFrame({"x": x + shift, "d": d, "big": 1e8 * big, "y": y + shift, "b": b}))
    plain = spark.createDataFrame(pd.DataFrame({"x": x, "d": d, "big": big, "y": y, "b": b}))
    want = np.linalg.lstsq(np.c_[np.ones(400), x, d, big], y, rcond=None)[0]
    m, p = regress(df, "y", ["x", "d", "big"]), regress(plain, "y", ["x", "d", "big"])
    assert p.beta == pytest.approx(want, rel=1e-9)
    assert m.beta[1:] * [1, 1, 1e8] == pytest.approx(want[1:], rel=1e-6)
    assert (m.rsq, m.rmse, m.f_test("x")["F"]) == pytest.approx((p.rsq, p.rmse, p.f_test("x")["F"]), rel=1e-6)
    assert [v["vif"] for v in m.vif()] == pytest.approx([v["vif"] for v in p.vif()], rel=1e-6)
    a, c = (k.predict(ci=True).select(F.col("prediction") - F.lit(s), F.col("ci_high") - F.col("ci_low")).collect() for k, s in ((m, shift), (p, 0.0)))
    assert np.allclose(a, c, atol=1e-5)
    lm, lp = logistic(df, "b", 1, ["x", "d"]), logistic(plain, "b", 1, ["x", "d"])
    assert lm.converged and lm.beta[1:] == pytest.approx(lp.beta[1:], rel=1e-5) and lm.cov[1, 1] == pytest.approx(lp.cov[1, 1], rel=1e-5)
    flat = plain.withColumn("one", F.lit(7.0))
    with pytest.warns(UserWarning, match="independent"):
        assert regress(flat, "y", ["x", "one"]).beta[2] == 0
    assert regress(plain, formula="y ~ x + d - 1").beta == pytest.approx(np.linalg.lstsq(np.c_[x, d], y, rcond=None)[0])
