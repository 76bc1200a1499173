import math

import pytest
from pyspark.sql import functions as F

from tallyframe.operators import bins, distr, moments, reshape, rows
from tallyframe.operators.combine import combine, numbered
from tallyframe.operators.common import as_frame, enforce_levels, levels_of, named, with_levels
from tallyframe.operators.explore import explore
from tallyframe.operators.pivot import pivot
from tallyframe.plans import plotdata


@pytest.fixture(scope="module")
def orders(spark):
    return spark.createDataFrame([(1, 101, 100.0), (2, 102, 200.0), (3, 101, 150.0), (4, 103, 300.0), (5, 104, 250.0)], "order_id long, customer_id long, amount double")


@pytest.fixture(scope="module")
def customers(spark):
    return spark.createDataFrame([(101, "Alice"), (102, "Bob"), (103, "Charlie"), (105, "Eve")], "customer_id long, name string")


def test_joins(orders, customers):
    assert combine(orders, customers, on="customer_id").count() == 4
    assert combine(orders, customers, on="customer_id", how="left").count() == 5
    assert 105 in [r.customer_id for r in combine(orders, customers, on="customer_id", how="right").collect()]
    full = combine(orders, customers, on="customer_id", how="full")
    assert full.columns == ["order_id", "customer_id", "amount", "customer_id_right", "name"] and full.count() == 6
    assert {r.customer_id for r in combine(orders, customers, on="customer_id", how="full", coalesce=True).collect()} == {101, 102, 103, 104, 105}
    assert combine(orders, customers, on="customer_id", how="anti").count() == 1
    assert combine(orders, customers, on="customer_id", how="semi").columns == orders.columns
    other = customers.select(F.col("customer_id").cast("string").alias("id"), F.col("name").alias("amount"))
    out = combine(orders, other, left_on="customer_id", right_on="id")
    assert out.count() == 4 and out.columns == ["order_id", "customer_id", "amount", "amount_right"]
    with pytest.raises(ValueError):
        combine(orders, customers, how="inner")
    with pytest.raises(ValueError):
        combine(orders, customers, on="customer_id", how="sideways")


def test_sets_and_binds(spark):
    a = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b"), (3, None)], "x long, y string")
    b = spark.createDataFrame([(2, "b"), (3, None), (4, "d")], "x long, y string")
    same, rest = combine(a, b, how="intersect").collect(), combine(a, b, how="setdiff").collect()
    assert sorted(map(tuple, same)) == [(2, "b"), (2, "b")] and len(same) + len(rest) == a.count()
    assert combine(a, b, how="union").count() == 4
    assert combine(a, b.withColumnRenamed("y", "z"), how="bind_rows").columns == ["x", "y", "z"]
    left = spark.createDataFrame([(3,), (1,), (2,)], "a long")
    right = spark.createDataFrame([(20,), (10,)], "b long")
    assert sorted(map(tuple, combine(left, right, how="bind_cols", order_by=("a", "b")).collect())) == [(1, 10), (2, 20), (3, None)]
    with pytest.raises(ValueError):
        combine(left, left, how="bind_cols", order_by="a")
    many = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k"))
    assert [(r.k, r["__row"]) for r in numbered(many, ["k"]).orderBy("k").collect()] == [(i, i + 1) for i in range(1000)]


def test_explore(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 3.0), (None, 5.0)], "g string, v double")
    out = {r.statistic: r.v for r in explore(df, "v", ["mean", "n", "n_unique", "n_missing", "median"]).collect()}
    assert out == {"mean": 3, "n": 3, "n_unique": 4, "n_missing": 1, "median": 3}
    assert {r.g: r.v_sum for r in explore(df, "v", "sum", "g").collect()} == {"a": 1, "b": 3, None: 5}
    with pytest.raises(ValueError):
        explore(df, "v", "nonsense")
    with pytest.raises(ValueError):
        explore(df.select("g"))


def test_pivot(spark):
    df = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 3.0), ("b", "x", 5.0), ("b", None, 7.0)], "r string, c string, v double")
    out = {r.r: r for r in pivot(df, "r", "c", "v", "mean", totals=True).collect()}
    assert out["a"].asDict() == {"r": "a", "x": 1, "y": 3, "null": None, "Total": 4} and out["Total"].Total == 16
    shares = pivot(df, "r", "c", normalize="row", fill=0).collect()
    assert all(abs(r.x + r.y + r["null"] - 100) < 1e-9 for r in shares)
    assert {r.r: r.count_pct for r in pivot(df, "r", normalize="total").collect()} == {"a": 50, "b": 50}
    assert pivot(df, "r", values="v").columns == ["r", "v_mean"]
    with pytest.raises(ValueError):
        pivot(df, "r", agg="mode")


def test_bins(spark):
    def tiles(xs, **k):
        df = spark.createDataFrame([(i, float(x) if x is not None else None) for i, x in enumerate(xs)], "i int, x double")
        return [r.bin for r in bins.xtile(df, "x", 5, **k).orderBy("i").collect()]

    assert tiles(range(10)) == [1, 1, 2, 2, 3, 3, 4, 4, 5, 5]
    assert tiles(range(10), rev=True) == [5, 5, 4, 4, 3, 3, 2, 2, 1, 1]
    assert tiles([*range(1, 10), math.nan, None]) == [1, 1, 2, 2, 3, 4, 4, 5, 5, None, None]
    df = spark.createDataFrame([(x,) for x in (0.0, 1.0, 2.0, 5.0, 6.0)], "x double")
    code = lambda **k: [r.bin for r in bins.bincode(df, "x", [0, 2, 5], **k).orderBy("x").collect()]
    assert code() == [1, 1, 1, 2, 0] and code(include_lowest=False) == [0, 1, 1, 2, 0] and code(right=False) == [1, 1, 2, 2, 0]
    with pytest.raises(ValueError):
        bins.bincode(df, "x", [2, 1])
    ranks = bins.average_ranks(spark.createDataFrame([(v,) for v in (3, 1, 3, 3, 2)], "v int"), "v").collect()
    assert {r.v: r["rank"] for r in ranks} == {1: 1, 2: 2, 3: 4}


def test_moments(spark):
    rows_ = list(zip([0, 1, 1, 1, 0, 0, 0], [2, 1, 1, 1, 6, 2, 10], [2, 1, 1, 1, 2, 2, 10], [1, 10, 1, 10, 1, 10, 1], strict=True))
    df = spark.createDataFrame(rows_, "x long, y long, z long, wt long")
    got = {r.variable: (round(r["mean"], 5), round(r.sd, 5)) for r in moments.weighted_moments(df, "wt").collect()}
    assert got == {"x": (0.61765, 0.48596), "y": (1.73529, 1.70309), "z": (1.61765, 1.53421)}
    scaled, means, sds = moments.scale_df(df, weight="wt", stats=True)
    assert set(means) == {"y", "z"} and scaled.columns == ["x", "wt", "y", "z"]  # 0/1 columns stay
    p = moments.proportions(spark.createDataFrame([(1,)] * 3 + [(0,)] * 3, "x int"), "x").first()
    assert p["var"] == 0.25 and abs(p.se - 0.2041241452319315) < 1e-12


def test_reshape(spark):
    table = spark.createDataFrame([("a", 1, 3), ("b", 2, 4), ("a", 1, 5), ("c", 1, 0)], "v1 string, v2 long, freq long")
    data = reshape.table2data(table, "freq")
    assert data.count() == 12 and data.filter("v1 = 'a'").count() == 8
    grid = [tuple(r) for r in reshape.expand_grid({"x": ["a", "b"], "y": [1, 2]}, spark=spark).collect()]
    assert grid == [("a", 1), ("a", 2), ("b", 1), ("b", 2)]
    df = spark.createDataFrame([(1, "q"), (2, "p"), (3, None)], "n int, f string")
    assert reshape.get_dummies(df).columns == ["n", "f_q"] and reshape.get_dummies(df, categories={"f": ["q", "p", "r"]}).columns == ["n", "f_p", "f_r"]
    assert [r.f_q for r in reshape.get_dummies(df).orderBy("n").collect()] == [1, 0, None]
    assert reshape.conditional_get_dummies(spark.createDataFrame([("a", "x"), ("b", "y"), ("a", "z")], "s string, t string")).columns == ["s_b", "t_x", "t_y", "t_z"]
    long = reshape.unpivot(df, id_vars=None).collect()
    assert len(long) == 6 and {r.variable for r in long} == {"n", "f"}
    assert [r.f for r in reshape.convert_binary(df, "f", "q").orderBy("n").collect()] == [1, 0, None]
    with pytest.raises(ValueError):
        reshape.convert_binary(df, "f", "zzz")
    assert reshape.is_binary(df, "f") and not reshape.is_binary(df, "n")


def test_rows(spark):
    df = spark.range(500).select("id", (F.col("id") % 3).alias("g"))
    sample = rows.sample_rows(df, 50)
    assert sample.count() == 50 and sorted(sample.collect()) == sorted(rows.sample_rows(df.repartition(7), 50).collect())
    moved = rows.shuffle_column(df, "g", "id").collect()
    assert sorted(r.id for r in moved) == list(range(500)) and sorted(r.g for r in moved) == sorted(i % 3 for i in range(500))
    assert any(r.g != r.id % 3 for r in moved)
    flags = rows.make_train(df, "id", "g", 0.3).groupBy("g").agg(F.sum("training").alias("t"), F.count("*").alias("n")).collect()
    assert all(r.t == r.n - round(r.n * 0.3) for r in flags)
    share = rows.make_train(df, "id").agg(F.avg("training")).first()[0]
    assert 0.6 < share < 0.8
    lagged = df.limit(5).select("id", rows.lag("id", "id", fill=0).alias("a"), rows.lead("id", "id").alias("b")).orderBy("id").collect()
    assert [r.a for r in lagged] == [0, 0, 1, 2, 3] and [r.b for r in lagged] == [1, 2, 3, 4, None]


def test_distr_and_levels(spark):
    df = spark.createDataFrame([("a", 1, 1.5), ("b", 1, 2.5), ("a", 2, None), (None, 2, 1.0)], "s string, k int, x double").withColumn("t", F.current_timestamp())
    d = distr.distr({"toy": df})
    assert d.name == "toy" and set(d.categorical) == {"s", "k"} and d.other.first().variable == "t"
    first = d.categorical["s"].filter("s = 'a'").first()
    assert (first["count"], first.proportion, first["mode"], first.n_unique, first.n_missing) == (2, 0.5, "a", 3, 1)
    levelled = with_levels(df, "s", ["b", "a"])
    assert levels_of(levelled, "s") == ["b", "a"] and levels_of(df, "s") == ["a", "b"]
    with pytest.raises(ValueError, match="not seen during training"):
        enforce_levels(df, {"s": ["a"]})
    assert named(df).name == "Not provided" and as_frame({"q": [1, 2]}, spark).count() == 2


def test_plotdata(spark):
    df = spark.createDataFrame([(float(i), "u" if i % 2 else "v") for i in range(101)], "x double, g string")
    hist = plotdata.hist_data(df, "x", 10).orderBy("bin").collect()
    assert [r["count"] for r in hist] == [10] * 9 + [11] and hist[-1].high == 100
    box = plotdata.box_data(df, "x").first()
    assert (box.q1, box.median, box.q3, box.low, box.high) == (25, 50, 75, 0, 100)
    density = plotdata.density_data(df, "x").orderBy("x").collect()
    step = density[1].x - density[0].x
    assert abs(sum(r.density for r in density) * step - 1) < 0.02
    with pytest.raises(ValueError):
        plotdata.visualize(df, "x", geom="box")
    assert plotdata.visualize(df, "g").count() == 2 and plotdata.visualize(df, "x", "x", nobs=7).count() == 7


def test_more_plotdata(spark):
    from tallyframe.operators.common import first_seen_levels
    from tallyframe.operators.hypothesis import compare_props

    df = spark.createDataFrame([("b", "y", 1, 2.0), ("a", "n", 2, 4.0), ("b", "n", 3, 6.0), (None, "y", 0, 9.0)], "g string, r string, i int, x double")
    assert first_seen_levels(df, "g", "i") == ["b", "a"]
    bars = {r.g: (r.r, r.break_even) for r in plotdata.prop_plot_data(df, "g", "r", "y", 0.3).collect()}
    assert bars == {"b": (0.5, 0.3), "a": (0.0, 0.3), None: (1.0, 0.3)}
    frames = plotdata.test_plot_data(spark, compare_props(df, "g", "r", "y"))
    assert frames["stats"].count() == 2 and "2_5pct" in frames["comparisons"].columns
    assert plotdata.crosstab_plot_data(df, "g", "r").count() == 4
    sample, lines = plotdata.scatter_matrix_data(df.select("i", "x"), ["i", "x"], 2)
    assert sample.count() == 2 and lines.first().n == 4


def test_sample_of_copies(spark):
    df = spark.range(30_000).select(F.when(F.col("id") < 10_000, -1).otherwise(F.col("id") % 4).alias("v"))
    drawn = rows.sample_rows(df, 3000)
    got = {r.v: r["count"] for r in drawn.groupBy("v").count().collect()}
    assert sum(got.values()) == 3000 and 850 < got[-1] < 1150 and all(400 < got[v] < 600 for v in range(4))
    assert sorted(drawn.collect()) == sorted(rows.sample_rows(df.repartition(7), 3000).collect())
    assert rows.sample_rows(df, 40_000).count() == 30_000
