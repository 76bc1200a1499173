"""Options, limits and odd inputs of the verbs, the models and the sources."""

import json
import os
import time
import zipfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyframe.operators import bins, explain, learners, pivot, reshape, rows
from tallyframe.operators import evaluate as E
from tallyframe.operators.combine import numbered
from tallyframe.operators.common import levels_of
from tallyframe.operators.explore import explore
from tallyframe.operators.hypothesis import cross_tabs, rank_sums
from tallyframe.plans import plotdata
from tallyframe.sources import state

from .test_models import perf  # noqa: F401 - a fixture


def test_fixed_values_of_the_performance_frame(perf):  # noqa: F811
    # What users of such tables get for these rows.
    for x in ("x1", "x2"):
        assert [r.cum_resp for r in E.calc_qnt(perf, "response", "yes", x).orderBy("bins").collect()] == [6, 14, 20, 27, 29, 30, 30, 30, 30, 30]
    gains = E.gains_tab(perf, "response", "yes", "x1").orderBy("cum_prop").collect()
    assert [round(r.cum_gains, 3) for r in gains] == [0.0, 0.2, 0.467, 0.667, 0.9, 0.967, 1.0, 1.0, 1.0, 1.0, 1.0]
    lift = E.lift_tab(perf, "response", "yes", "x1").orderBy("cum_prop").collect()
    assert [round(r.cum_lift, 3) for r in lift] == [2.0, 2.333, 2.222, 2.25, 1.933, 1.667, 1.429, 1.25, 1.111, 1.0]
    out = {r.Type: r for r in E.evalbin({"train": perf.filter("training = 1"), "test": perf.filter("training = 0")}, "response", "yes", "x1", cost=1, margin=2, dec=3).collect()}
    keys = ("profit", "index", "ROME", "contact", "AUC")
    assert [out["train"][k] for k in keys] == [5, 1.0, 0.116, 0.538, 0.897]
    assert [out["test"][k] for k in keys] == [-2, 1.0, -0.143, 0.7, 0.845]


@pytest.fixture(scope="module")
def groups(spark):
    rng = np.random.default_rng(1)
    df = pd.DataFrame({"g": rng.choice(["a", "b", "c"], 3000), "x": rng.integers(0, 400, 3000) / 4, "y": rng.normal(size=3000)})
    df.loc[df.g == "c", "g"] = None
    df.loc[::7, "x"] = np.nan
    rows_ = [tuple(None if v is None or v != v else v for v in r) for r in df.astype(object).itertuples(index=False)]
    return df, spark.createDataFrame([(g, None if x is None else float(x), float(y)) for g, x, y in rows_], "g string, x double, y double")


def test_medians_and_quantiles_with_null_groups(groups):
    local, df = groups
    want = {g if isinstance(g, str) else None: d for g, d in local.groupby("g", dropna=False)}
    got = {r.g: r for r in explore(df, ["x", "y"], ["median", "count", "mean"], "g").collect()}
    assert set(got) == set(want) == {"a", "b", None}
    for g, d in want.items():
        assert got[g].x_median == pytest.approx(d.x.median()) and got[g].y_median == pytest.approx(d.y.median()) and got[g].x_count == d.x.count()
    assert explore(df, ["x"], ["median"]).first().x == pytest.approx(local.x.median())
    assert explore(df.filter("g = 'zz'"), ["x"], ["median", "count"]).orderBy("statistic").collect()[1].x is None
    boxes = {r.g: r for r in plotdata.box_data(df, "y", "g").collect()}
    for g, d in want.items():
        assert [boxes[g].q1, boxes[g].median, boxes[g].q3] == pytest.approx(np.quantile(d.y, [0.25, 0.5, 0.75]).tolist())
    binned = bins.xtile(df, "x", 4, by="g").groupBy("g", "bin").count().collect()
    assert sum(r["count"] for r in binned) == 3000 and all(r.bin in (1, 2, 3, 4, None) for r in binned)
    for g, d in want.items():
        cut = np.quantile(d.x.dropna(), [0, 0.25, 0.5, 0.75, 1])
        assert {r.bin: r["count"] for r in binned if r.g == g and r.bin} == {k: int(((d.x <= cut[k]) & ((d.x > cut[k - 1]) | (k == 1))).sum()) for k in (1, 2, 3, 4)}
    table = {r.g: r for r in pivot.pivot(df.withColumn("k", F.when(F.col("y") > 0, "up").otherwise("down")), "g", "k", "x", "median", levels=["up", "down"]).collect()}
    for g, d in want.items():
        assert table[g].up == pytest.approx(d[d.y > 0].x.median())


def test_running_sums_by_many_ranges(spark, groups):
    local, df = groups
    counts = df.filter("x is not null").groupBy("g", "x").agg(F.count("*").alias("n"))
    for lot in (1, 7, 50_000):
        got = bins.running_sums(counts, "x", ["n"], "g", lot=lot).collect()
        for r in got:
            same = local[local.g.isna()] if r.g is None else local[local.g == r.g]
            assert r.n_upto == (same.x <= r.x).sum()
    down = bins.running_sums(df.filter("x is not null").groupBy("x").agg(F.count("*").alias("n")), "x", ["n"], descending=True, lot=3).collect()
    assert all(r.n_upto == (local.x >= r.x).sum() for r in down)
    cuts = spark.range(1).select(F.array(*[F.lit(float(i)) for i in range(0, 200, 2)]).alias("c"))
    places = spark.range(-3, 205).crossJoin(cuts).select("id", bins.range_of(F.col("id").cast("double"), F.col("c")).alias("k")).collect()
    assert all(r.k == sum(c < r.id for c in range(0, 200, 2)) for r in places)
    assert spark.range(1).select(bins.range_of(F.lit(1.0), F.array().cast("array<double>"))).first()[0] == 0


def test_rank_sums_of_all_pairs(groups):
    local, df = groups
    pairs = [("a", "b"), ("b", "a"), ("a", "none")]
    named = df.fillna("none", ["g"])
    local = local.assign(g=local.g.fillna("none"))
    for (a, b), (w, n, m) in zip(pairs, rank_sums(named, "g", "x", pairs), strict=True):
        two = local[local.g.isin([a, b]) & local.x.notna()]
        assert (n, m) == ((two.g == a).sum(), (two.g == b).sum()) and w == pytest.approx(two.x.rank()[two.g == a].sum())
    assert rank_sums(named, "g", "x", []) == []


def test_numbers_with_a_hot_first_key(spark):
    df = spark.range(4000).select(F.lit("hot").alias("k"), (F.col("id") * 7919 % 4000).alias("v"), F.when(F.col("id") % 5 > 0, F.col("id")).alias("w"))
    for lot in (100, 50_000):
        got = numbered(df, ["k", "v"], lot=lot).collect()
        assert sorted((r["__row"], r.v) for r in got) == [(i + 1, i) for i in range(4000)]
    nulls = numbered(df, ["w", "v"], lot=100).orderBy("__row").collect()
    assert [r.w for r in nulls] == [None] * 800 + sorted(r.w for r in nulls if r.w is not None)
    same = spark.range(1000).select(F.lit(1).alias("a"))
    assert sorted(r["__row"] for r in numbered(same, ["a"], lot=50).collect()) == list(range(1, 1001))


def test_shifted(spark):
    df = spark.createDataFrame([(i, i * 10 if i != 3 else None) for i in range(6)], "t int, v int")
    assert [r.v_lag for r in rows.shifted(df, "v", "t", 2).orderBy("t").collect()] == [None, None, 0, 10, 20, None]
    assert [r.nxt for r in rows.shifted(df, "v", "t", -1, 7, "nxt").orderBy("t").collect()] == [10, 20, 7, 40, 50, 7]


def test_numbers_in_many_ranges_take_seconds(spark):
    # Each row used to carry all cuts and to make them distinct anew, pair by pair.
    df = spark.range(20_000).select("id", (F.col("id") * 7919 % 20_000).alias("t"))
    started = time.monotonic()
    got = sorted((r["__row"], r.t) for r in numbered(df, ["t"], lot=50).collect())
    assert time.monotonic() - started < 60 and got == [(i + 1, i) for i in range(20_000)]


@pytest.mark.parametrize("num", [3, -1, 25, -1000])
@pytest.mark.parametrize("edges", [100_000, 0])
def test_shifted_across_ranges(spark, monkeypatch, num, edges):
    monkeypatch.setattr(rows, "_EDGES", edges)
    data = [(i, (None, 1, 2, 2, 2, 3)[i * 7 % 6], None if i % 5 == 0 else float(i)) for i in range(300)]
    df = spark.createDataFrame(data, "id int, k int, v double").repartition(3)
    order = sorted(data, key=lambda r: (r[1] is not None, r[1] or 0, r[0]))
    want = {order[i][0]: order[i - num][2] if 0 <= i - num < 300 else None for i in range(300)}
    for lot in (10, 1000):
        assert {r.id: r.z for r in rows.shifted(df, "v", ["k", "id"], num, None, "z", lot).collect()} == want


def test_lead_joins_only_the_last_rows_of_ranges(spark):
    df = spark.range(1000).select(F.col("id").alias("t"), (F.col("id") * 2).alias("v"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = rows.shifted(df, "v", "t", -1, -1)
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan and "BroadcastHashJoin" in plan
    assert [r.v_lead for r in out.orderBy("t").collect()] == [2 * i for i in range(1, 1000)] + [-1]


def test_lead_of_many_ranges_takes_one_shuffle(spark):
    # Counts of the ranges and their last rows used to be two more passes over the table.
    df = spark.range(4000).select((F.col("id") * 7919 % 4000).alias("t"), F.col("id").alias("v"))
    want = {r.t: r.v for r in df.collect()}
    for num in (-1, 16):
        out = rows.shifted(df, "v", "t", num, name="z", lot=50)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "Exchange SinglePartition" not in plan
        assert {r.t: r.z for r in out.collect()} == {t: want.get(t - num) for t in want}


@pytest.mark.parametrize("num", [1, -1, 7, 16, -16])
def test_shifted_with_equal_rows_and_odd_keys(spark, num):
    a = F.when(F.col("id") % 9 == 0, F.lit(float("nan"))).when(F.col("id") % 7 > 0, F.col("id") % 5 - 0.0)
    at = F.when(F.col("id") % 11 > 0, F.timestamp_seconds(1_698_535_800 + F.col("id") % 13 * 600))  # a clock is set back here
    many = spark.range(600).select("id", a.alias("a"), F.struct(at.alias("t")).alias("s"), at.alias("t"), F.concat(F.lit("\u00e9"), F.col("id") % 3).alias("c"), F.col("id").alias("v"))
    df = many.unionAll(spark.range(300).select(F.lit(3).cast("long").alias("id"), *[F.lit(None).cast(many.schema[c].dataType).alias(c) for c in ("a", "s", "t", "c")], F.lit(7).cast("long").alias("v")))
    for order in (["a", "s", "c", "id"], ["t", "c", "a", "id"]):
        shift = F.lag("v", num) if num > 0 else F.lead("v", -num)
        want = df.select("id", "v", shift.over(Window.orderBy(*order, "v")).alias("z"))
        got = rows.shifted(df, "v", [*order, "v"], num, None, "z", 20).select("id", "v", "z")
        assert got.count() == 900 and sorted(got.collect(), key=str) == sorted(want.collect(), key=str)


def test_limits_of_levels(spark):
    df = spark.range(50).select(F.col("id").cast("string").alias("a"), (F.col("id") % 2).alias("b"))
    with pytest.raises(ValueError, match="more than 20 levels"):
        levels_of(df, "a", most=20)
    with pytest.raises(ValueError, match="more than 20 levels"):
        cross_tabs(df, "a", "b", most=20)


def test_dummies_without_constant_columns(spark):
    df = spark.createDataFrame([("p", 1), ("q", 2), (None, 3)], "f string, v int")
    levels = {"f": ["p", "q", "r"]}
    assert reshape.get_dummies(df, categories=levels).columns == ["v", "f_q", "f_r"]
    assert reshape.get_dummies(df, categories=levels, drop_nonvarying=True).columns == ["v", "f_q"]
    assert reshape.get_dummies(df.filter("f = 'q'"), categories=levels, drop_nonvarying=True).columns == ["v"]


@pytest.fixture(scope="module")
def learned(spark):
    rng = np.random.default_rng(5)
    x, z = rng.normal(size=600), rng.normal(size=600)
    df = pd.DataFrame({"x": x, "z": z, "y": 2 * x + 0.2 * rng.normal(size=600), "b": np.where(x + 0.3 * rng.normal(size=600) > 0.4, "yes", "no")})
    return spark.createDataFrame(df)


def test_out_of_bag(learned):
    f = learners.rforest(learned, "b", "yes", ["x", "z"], n_estimators=12, max_depth=4)
    out = f.out_of_bag(6).collect()
    assert len(out) == 600 and sum(r.prediction is None for r in out) < 80  # 0.63 ** 6 of them
    assert 0.9 < f.oob_score(6) <= f.metrics()["auc"] + 0.02
    r = learners.rforest(learned, "y", None, ["x", "z"], "regression", n_estimators=8, max_depth=5, max_features="all")
    assert r.oob_score(4) > 0.85


def test_boosted_trees_draw_columns(learned):
    g = learners.xgboost(learned, "y", None, ["x", "z"], "regression", n_estimators=5, max_depth=3, colsample_bytree=0.5)
    assert g.model.getFeatureSubsetStrategy() == "0.5" and g.model.getStepSize() == 0.3
    with pytest.raises(Exception, match="featureSubsetStrategy|invalid"):
        learners.xgboost(learned, "y", None, ["x", "z"], "regression", n_estimators=2, colsample_bytree=-1)


def test_cross_validation_scores_and_cache(learned, tmp_path):
    ask = lambda **k: learners.cross_validation(learners.rforest, learned, "b", "yes", ["x", "z"], param_grid={"max_depth": [1, 3]}, n_splits=2, n_estimators=3, cache=str(tmp_path / "cv"), **k)
    out = ask()
    assert out["scoring"] == ["auc", "accuracy"] and [r["params"] for r in out["results"]] == [{"max_depth": 1}, {"max_depth": 3}]
    assert all(0.7 < v["mean"] <= 1 and len(v["folds"]) == 2 for r in out["results"] for v in r["all"].values())
    assert json.dumps(ask()) == json.dumps(out) and len(os.listdir(tmp_path / "cv")) == 1
    other = ask(scoring="accuracy")  # other arguments, another result
    assert other["scoring"] == ["accuracy"] and len(os.listdir(tmp_path / "cv")) == 2
    fit = learners.cross_validation(learners.rforest, learned, "y", None, ["x", "z"], "regression", {"max_depth": [1, 4]}, ["rmse", "r2"], 2, n_estimators=3)
    assert fit["best_params"] == {"max_depth": 4} and fit["best_score"] == min(r["mean"] for r in fit["results"])
    with pytest.raises(ValueError, match="Unknown scores"):
        learners.cross_validation(learners.rforest, learned, "y", None, ["x"], "regression", None, ["auc"], 2, n_estimators=2)


def test_importance_of_any_estimator(learned):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    fitted = Pipeline(stages=[VectorAssembler(inputCols=["x", "z"], outputCol="v"), LinearRegression(featuresCol="v", labelCol="y")]).fit(learned)
    got = {r.variable: r.importance for r in explain.importance_of(fitted.transform, learned, "y", ["x", "z"], rep=2).collect()}
    assert got["x"] > 0.8 and abs(got["z"]) < 0.01


def xlsx(path, cells, shared=(), styles=""):
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="first" sheetId="1" r:id="rId1"/><sheet name="other" sheetId="2" r:id="rId2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Target="/xl/worksheets/sheet2.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {main}>" + "".join(f"<si><t>{s}</t></si>" for s in shared) + "</sst>")
        z.writestr("xl/styles.xml", f'<styleSheet {main}><numFmts><numFmt numFmtId="170" formatCode="0.00"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {main}><sheetData>{cells}</sheetData></worksheet>")
        z.writestr("xl/worksheets/sheet2.xml", f'<worksheet {main}><sheetData><row r="1"><c r="A1" t="inlineStr"><is><t>only</t></is></c></row><row r="2"><c r="A2"><v>5</v></c></row></sheetData></worksheet>')


def test_sheets(spark, tmp_path):
    path = str(tmp_path / "a.xlsx")
    head = '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c><c r="C1" t="s"><v>2</v></c><c r="D1" t="s"><v>3</v></c><c r="E1" t="s"><v>4</v></c></row>'
    body = "".join(f'<row r="{i + 2}"><c r="A{i + 2}"><v>{i + 1}</v></c><c r="B{i + 2}" t="s"><v>{5 + i}</v></c>' + (f'<c r="C{i + 2}" s="2"><v>{10.5 * i}</v></c>' if i else "") + f'<c r="D{i + 2}" s="1"><v>{44927 + i}</v></c><c r="E{i + 2}" t="b"><v>{i % 2}</v></c></row>' for i in range(3))
    xlsx(path, head + body, ["id", "name", "value", "day", "flag", "Alice", "Bob", "Charlie"])
    df = state.read_excel(spark, path)
    assert df.dtypes == [("id", "bigint"), ("name", "string"), ("value", "double"), ("day", "timestamp"), ("flag", "boolean")]
    got = df.orderBy("id").collect()
    assert [r.id for r in got] == [1, 2, 3] and [r.name for r in got] == ["Alice", "Bob", "Charlie"] and [r.value for r in got] == [None, 10.5, 21.0]
    assert [r.flag for r in got] == [False, True, False] and str(got[0].day.date()) == "2023-01-01"
    assert [r.only for r in state.read_excel(spark, path, "other").collect()] == [5]
    with pytest.raises(ValueError, match="No sheet"):
        state.read_excel(spark, path, "none")
    (tmp_path / "b.xls").write_bytes(b"\xd0\xcf\x11\xe0")
    with pytest.raises(ValueError, match="xlsx"):
        state.read_excel(spark, str(tmp_path / "b.xls"))
