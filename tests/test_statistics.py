import math
import random
from collections import Counter
from functools import reduce

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.functions import special as S
from tallyframe.functions import text as X
from tallyframe.operators import hypothesis as H
from tallyframe.operators.probcalc import curve, prob_calc


def test_special_functions():
    assert abs(S.norm_ppf(0.975) - 1.959963984540054) < 1e-12 and abs(S.norm_cdf(1.96) - 0.9750021048517795) < 1e-14
    assert abs(S.t_ppf(0.975, 10) - 2.2281388519649385) < 1e-9 and abs(S.t_cdf(2.0, 1) - (0.5 + math.atan(2) / math.pi)) < 1e-12
    assert abs(S.chisq_sf(5.0, 2) - math.exp(-2.5)) < 1e-14 and abs(S.chisq_sf(7.0, 4) - math.exp(-3.5) * 4.5) < 1e-14
    assert abs(S.f_cdf(1.0, 7, 7) - 0.5) < 1e-12 and abs(S.f_sf(S.f_ppf(0.9, 3, 11), 3, 11) - 0.1) < 1e-9
    for n, p in ((12, 0.3), (40, 0.77)):
        for k in range(n + 1):
            assert abs(S.binom_cdf(k, n, p) - sum(math.comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k + 1))) < 1e-11
            limit = math.comb(n, k) * p**k * (1 - p) ** (n - k) * (1 + 1e-7)
            two = sum(v for j in range(n + 1) if (v := math.comb(n, j) * p**j * (1 - p) ** (n - j)) <= limit)
            assert abs(S.binom_test(k, n, p) - min(1, two)) < 1e-10
    assert abs(S.pois_cdf(3, 2.5) - sum(math.exp(-2.5) * 2.5**j / math.factorial(j) for j in range(4))) < 1e-13
    assert S.binom_ppf(0.5, 10, 0.5) == 5 and S.pois_ppf(0.5, 2.5) == 2


def test_adjustments():
    p = [0.01, 0.04, 0.03]
    assert S.p_adjust(p, "bonferroni") == pytest.approx([0.03, 0.12, 0.09])
    assert S.p_adjust(p, "holm") == pytest.approx([0.03, 0.06, 0.06])
    assert S.p_adjust(p, "fdr_bh") == pytest.approx([0.03, 0.04, 0.04])
    assert S.p_adjust(p, None) == p
    with pytest.raises(ValueError):
        S.p_adjust(p, "guess")


def test_prob_calc():
    r = prob_calc("norm", lb=-1.96, ub=1.96)
    assert abs(r["p_between"] - 0.9500042) < 1e-6
    r = prob_calc("binom", lb=2, ub=3, n=5, p=0.5)
    assert abs(r["p_between"] - 20 / 32) < 1e-12 and abs(r["p_lt_lb"] - 6 / 32) < 1e-12 and abs(r["p_ge_ub"] - 16 / 32) < 1e-12
    assert prob_calc("disc", ub=2, v=[1, 2, 3], p=[0.2, 0.3, 0.5])["p_le_ub"] == 0.5
    assert prob_calc("unif", plb=0.25, min=0, max=8)["lb"] == 2
    for name, k in {"norm": {}, "lnorm": {}, "tdist": {"df": 5}, "chisq": {"df": 4}, "fdist": {"df1": 5, "df2": 9}, "expo": {"rate": 2}, "unif": {}, "binom": {"n": 9, "p": 0.4}, "pois": {"lamb": 3}}.items():
        assert curve(name, **k) and prob_calc(name, pub=0.9, **k)["ub"] is not None
    for bad in (lambda: prob_calc("norm", lb=2, ub=1), lambda: prob_calc("unif", min=3, max=1), lambda: prob_calc("pois", lamb=0), lambda: prob_calc("disc", v=[1, 2], p=[0.1, 0.1]), lambda: prob_calc("what")):
        with pytest.raises(ValueError):
            bad()


def test_single_mean(spark):
    r = H.single_mean(spark.createDataFrame([(float(i),) for i in range(1, 6)], "values double"), "values", comp_value=3)
    assert r.comparisons[0]["t_value"] == 0 and r.comparisons[0]["p_value"] == 1
    r = H.single_mean(spark.createDataFrame([(10.0,), (11.0,), (None,), (9.0,)], "v double"), "v", comp_value=10)
    assert (r.stats[0]["n"], r.stats[0]["n_missing"], r.comparisons[0]["df"]) == (4, 1, 2)
    r = H.single_mean(spark.createDataFrame([(float(i),) for i in range(5, 10)], "v double"), "v", "greater", comp_value=4)
    assert r.comparisons[0]["p_value"] < 0.05 and r.comparisons[0]["100%"] == math.inf and "Single mean" in r.report()


def test_single_prop(spark):
    df = spark.createDataFrame([("yes",)] * 60 + [("no",)] * 140 + [(None,)], "response string")
    for test in ("binomial", "z-test"):
        r = H.single_prop(df, "response", "yes", test_type=test)
        assert r.stats[0]["p"] == 0.3 and r.stats[0]["n_missing"] == 1
        c = r.comparisons[0]
        assert 0 <= c["p_value"] < 0.001 and c["2.5%"] < 0.3 < c["97.5%"]
    with pytest.raises(ValueError):
        H.single_prop(df, "response", "yes", comp_value=1)


def test_compare_means(spark):
    rng = random.Random(1)
    rows = [(g, rng.gauss(m, 2), i) for g, m in (("a", 0), ("b", 1), ("c", 3)) for i in range(40)]
    df = spark.createDataFrame(rows, "g string, v double, i int")
    r = H.compare_means(df, "g", "v", adjust="bonferroni")
    a, b = ([v for g, v, _ in rows if g == k] for k in "ab")
    ma, mb = sum(a) / 40, sum(b) / 40
    va, vb = sum((x - ma) ** 2 for x in a) / 39, sum((x - mb) ** 2 for x in b) / 39
    assert r.comparisons[0]["statistic"] == pytest.approx((ma - mb) / math.sqrt(va / 40 + vb / 40))
    assert [c["null_hyp"] for c in r.comparisons] == ["a = b", "a = c", "b = c"]
    assert len(H.compare_means(df, "g", "v", comb=["a:c"]).comparisons) == 1
    paired = H.compare_means(df, "g", "v", comb=[("a", "b")], sample_type="paired", pair_by="i").comparisons[0]
    d = [x - y for x, y in zip(a, b, strict=True)]
    md = sum(d) / 40
    assert paired["statistic"] == pytest.approx(md / math.sqrt(sum((x - md) ** 2 for x in d) / 39 / 40))
    signed = H.compare_means(df, "g", "v", comb=[("a", "c")], sample_type="paired", pair_by="i", test_type="wilcox").comparisons[0]
    assert signed["p_value"] < 0.01 and signed["se"] is None
    wide = spark.createDataFrame([(float(i), float(i + 2), float(i * 2)) for i in range(12)], "m double, s1 double, s2 double")
    assert len(H.compare_means(wide, "m", ["s1", "s2"]).comparisons) == 3
    with pytest.raises(ValueError):
        H.compare_means(spark.createDataFrame([("a", 1.0, 1), ("b", 2.0, 1), ("b", 3.0, 2)], "g string, v double, i int"), "g", "v", sample_type="paired", pair_by="i")


def test_compare_props(spark):
    rows = [(g, o) for g, k in (("A", 70), ("B", 50), ("C", 30)) for o in ["yes"] * k + ["no"] * (100 - k)]
    r = H.compare_props(spark.createDataFrame(rows, "group string, outcome string"), "group", "outcome", "yes", adjust="fdr_bh")
    assert [s["p"] for s in r.stats] == [0.7, 0.5, 0.3]
    assert r.comparisons[0]["chisq_value"] == pytest.approx(0.2**2 / (0.6 * 0.4 * 0.02)) and all(c["p_value"] < 0.01 for c in r.comparisons)


def test_correlation(spark):
    df = spark.createDataFrame(list(zip([0, 1, 1, 1, 0, 0, 0], [2, 1, 1, 1, 2, 2, 10], strict=True)), "x long, y long")
    r = H.correlation(df)
    assert round(r.comparisons[0]["r"], 3) == -0.493 and r.matrices["r"][0][0] == 0
    gap = spark.createDataFrame([(0, 2), (1, 1), (1, 1), (1, None), (0, 2), (0, 2), (0, 10)], "x long, y long")
    assert round(H.correlation(gap).comparisons[0]["r"], 4) == -0.4472 and H.correlation(gap).comparisons[0]["n"] == 6
    mono = spark.createDataFrame([(i, 10 * i * i) for i in range(1, 6)], "a long, b long")
    for m in ("spearman", "kendall"):
        assert H.correlation(mono, method=m).comparisons[0]["r"] == pytest.approx(1)
    ties = [(1, 3), (2, 1), (2, 2), (4, 2), (5, 5), (5, 4)]
    c = sum(((a - x) * (b - y) > 0) - ((a - x) * (b - y) < 0) for i, (a, b) in enumerate(ties) for x, y in ties[:i])
    tau = c / math.sqrt((15 - 2) * (15 - 1))
    assert H.correlation(spark.createDataFrame(ties, "a int, b int"), method="kendall").comparisons[0]["r"] == pytest.approx(tau)
    with pytest.raises(ValueError):
        H.correlation(df, method="guess")


def test_kendall_of_all_rows(spark):
    def brute(counts):
        points = list(counts.items())
        net = sum(v * w * (((a - x) * (b - y) > 0) - ((a - x) * (b - y) < 0)) for i, ((a, b), v) in enumerate(points) for (x, y), w in points[:i])
        n, pairs = sum(counts.values()), lambda c: sum(k * (k - 1) // 2 for k in c.values())
        tx, ty = Counter(), Counter()
        for (a, b), k in points:
            tx[a] += k
            ty[b] += k
        return net / math.sqrt((n * (n - 1) // 2 - pairs(tx)) * (n * (n - 1) // 2 - pairs(ty)))

    rng = random.Random(3)
    drawn = [(x, x // 3 + rng.randint(0, 9)) for x in (rng.choice([7, rng.randint(0, 60)]) for _ in range(1500))]
    df = spark.createDataFrame(drawn, "a int, b int").repartition(3)
    for lot in (20, 150, 10**6):
        assert H.kendall_tau(df, "a", "b", lot) == pytest.approx(brute(Counter(drawn)), abs=1e-12)
    tied = {(1, 1): 1_200_000, (2, 2): 300, (3, 1): 200, (4, 5): 500}
    pairs = reduce(DataFrame.unionByName, [spark.range(k).select(F.lit(a).alias("a"), F.lit(b).alias("b")) for (a, b), k in tied.items()])
    one = H.correlation(pairs, method="kendall").comparisons[0]
    assert one["n"] == 1_201_000 and one["r"] == pytest.approx(brute(tied), abs=1e-12)
    sampled = H.correlation(df, method="kendall", sample=1000).comparisons[0]
    z = sampled["r"] / math.sqrt(2 * 2005 / (9 * 1000 * 999))
    assert sampled["n"] == 1000 and sampled["p_value"] == pytest.approx(math.erfc(abs(z) / math.sqrt(2)), rel=1e-3)


def test_crosstabs_and_goodness(spark):
    df = spark.createDataFrame(list(zip([0, 1, 1, 1, 0, 0, 0, None], [2, 1, 1, 1, 2, 2, 10, 1], strict=True)), "x long, y long")
    r = H.cross_tabs(df, "x", "y")
    row = [c["expected"] for c in r.stats if c["x"] == 0]
    assert row == pytest.approx([4 * 3 / 7, 4 * 3 / 7, 4 / 7]) and r.comparisons[0]["n_missing"] == 1 and r.totals["all"] == 7
    g = spark.createDataFrame([(c,) for c, n in zip("ABCD", (40, 30, 20, 10), strict=True) for _ in range(n)], "category string")
    out = H.goodness(g, "category")
    assert out.comparisons[0]["chisq"] == pytest.approx(20) and out.comparisons[0]["df"] == 3
    assert H.goodness(g, "category", [0.4, 0.3, 0.2, 0.1]).comparisons[0]["chisq"] == pytest.approx(0)
    with pytest.raises(IndexError):
        H.goodness(g, "category", [0.5, 0.5])
    with pytest.raises(ValueError):
        H.goodness(g, "category", [0.5, 0.5, 0.5, 0.5])


def test_clt_and_size(spark):
    means = H.central_limit_theorem(spark, "normal", 50, 40, mean=3).collect()
    assert len(means) == 40 and abs(sum(r["mean"] for r in means) / 40 - 3) < 0.2
    assert H.sample_size("mean", err=0.5, sd=2)["n"] == 62 and H.sample_size("prop", err=0.05, incidence=0.5)["contacts"] == 770


def test_text(spark):
    assert X.sig_stars([0.0001, 0.005, 0.03, 0.08, 0.5, math.nan]) == ["***", "**", "*", ".", " ", " "]
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(0.0001,), (math.nan,), (None,), (0.08,)], "p double")
    assert [r[0] for r in df.select(X.sig_stars(F.col("p"))).collect()] == ["***", " ", " ", "."]
    assert [round(r[0], 6) for r in spark.createDataFrame([(1.96,), (0.0,)], "x double").select(X.norm_cdf(F.col("x"))).collect()] == [0.975002, 0.5]
    assert X.format_nr(1234.567, "$") == "$1,234.57" and X.format_nr(0.256, dec=1, perc=True) == "25.6%" and X.format_nr([1999.9], dec=0) == ["1,999"]
    assert X.format_pval(0.0001) == "< .001" and X.ci_label() == ["2.5%", "97.5%"] and X.months_abb(11, 3) == ["Nov", "Dec", "Jan"]
    assert X.setdiff([3, 1, 3, 2], [2]) == [3, 1] and X.union([2], [1]) == [1, 2] and X.intersect([1, 2], [2]) == [2]
