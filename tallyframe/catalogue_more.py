"""Further queries and their SQL: regression, tests, distributions, curves, and verbs with their options."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalogue import _BINS, _docs, _scored, frame, query, rounded, table
from .functions.text import norm_cdf, sig_stars
from .operators import bins, combine, evaluate, explain, hypothesis, linear, pivot, reshape, rows
from .operators.design import Design
from .operators.probcalc import prob_calc
from .plans import plotdata


def _erf(z: str) -> str:
    """The error function as SQL, by its power series (for |z| up to about 5)."""
    return f"(2 / sqrt(pi()) * list_sum(list_transform(range(0, 120), lambda n: (CASE WHEN n % 2 = 0 THEN 1 ELSE -1 END) * exp((2 * n + 1) * ln(abs({z}) + 1e-300) - lgamma(n + 1)) / (2 * n + 1))) * sign({z}))"


def _phi(z: str) -> str:
    return f"((1 + {_erf(f'(({z}) / sqrt(2))')}) / 2)"


# --- regression

_TWO = """m AS (SELECT avg(l_quantity) AS m1, avg(l_discount) AS m2, avg(l_extendedprice) AS my, var_pop(l_quantity) AS s11, var_pop(l_discount) AS s22, covar_pop(l_quantity, l_discount) AS s12,
covar_pop(l_quantity, l_extendedprice) AS s1y, covar_pop(l_discount, l_extendedprice) AS s2y, var_pop(l_extendedprice) AS syy, count(*) AS n FROM lineitem),
b AS (SELECT *, (s22 * s1y - s12 * s2y) / (s11 * s22 - s12 * s12) AS b1, (s11 * s2y - s12 * s1y) / (s11 * s22 - s12 * s12) AS b2 FROM m),
f AS (SELECT *, my - b1 * m1 - b2 * m2 AS b0, n * (syy - b1 * s1y - b2 * s2y) AS sse FROM b)"""


def _two(spark, d):
    return linear.regress(table(spark, d, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount"])


@query(f"""WITH {_TWO}, c AS (SELECT *, sse / (n - 3) AS s2, s11 * s22 - s12 * s12 AS det FROM f),
r AS (SELECT 'Intercept' AS term, b0 AS b, sqrt(s2 / n * (1 + (m1 * m1 * s22 + m2 * m2 * s11 - 2 * m1 * m2 * s12) / det)) AS se FROM c UNION ALL SELECT 'l_quantity', b1, sqrt(s2 / n * s22 / det) FROM c UNION ALL SELECT 'l_discount', b2, sqrt(s2 / n * s11 / det) FROM c)
SELECT term, round(b, 2) AS coefficient, round(se, 3) AS std_error FROM r""")
def ols_coefficients(spark, d):
    out = spark.createDataFrame([(c["index"], c["coefficient"], c["std_error"]) for c in _two(spark, d).coef], "term string, coefficient double, std_error double")
    return out.select("term", F.round("coefficient", 2).alias("coefficient"), F.round("std_error", 3).alias("std_error"))


@query(f"WITH {_TWO} SELECT round(1 - sse / (n * syy), 6) AS r2, round(1 - (sse / (n - 3)) / (n * syy / (n - 1)), 6) AS r2_adj, round(sqrt(sse / n), 3) AS rmse, round((n * syy - sse) / 2 / (sse / (n - 3)), 2) AS f, n AS nobs FROM f")
def ols_fit(spark, d):
    m = _two(spark, d)
    return spark.createDataFrame([(round(float(m.rsq), 6), round(float(m.rsq_adj), 6), round(float(m.rmse), 3), round(float(m.f), 2), int(m.nobs))], "r2 double, r2_adj double, rmse double, f double, nobs long")


@query(f"WITH {_TWO} SELECT round((n * (syy - s1y * s1y / s11) - sse) / (sse / (n - 3)), 4) AS f, 1 AS df1, n - 3 AS df2, round(s1y * s1y / s11 / syy, 6) AS rsq_reduced FROM f")
def ols_f_test(spark, d):
    t = _two(spark, d).f_test("l_discount")
    return spark.createDataFrame([(round(float(t["F"]), 4), t["df1"], int(t["df2"]), round(float(t["rsq_reduced"]), 6))], "f double, df1 int, df2 long, rsq_reduced double")


@query(f"WITH {_TWO}, v AS (SELECT unnest(['l_quantity', 'l_discount']) AS variable) SELECT variable, round(1 / (1 - s12 * s12 / (s11 * s22)), 6) AS vif FROM f, v")
def ols_vif(spark, d):
    return frame(spark, _two(spark, d).vif(), "variable string,vif double")


@query(f"WITH {_TWO} SELECT l_orderkey, l_linenumber, round(b0 + b1 * l_quantity + b2 * l_discount, 2) AS prediction FROM lineitem, f")
def ols_predict(spark, d):
    return _two(spark, d).predict().select("l_orderkey", "l_linenumber", F.round("prediction", 2).alias("prediction"))


@query(f"WITH {_TWO} SELECT l_orderkey, l_linenumber, round(b0 + b1 * l_quantity + b2 * 0.05, 2) AS prediction FROM lineitem, f")
def ols_predict_set(spark, d):
    return _two(spark, d).predict(data_cmd={"l_discount": 0.05}).select("l_orderkey", "l_linenumber", F.round("prediction", 2).alias("prediction"))


@query("SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem")
def ols_shifted(spark, d):
    """Columns far from zero give the slope and the fit of those near it."""
    df = table(spark, d, "lineitem").select((F.col("l_quantity") + 1e6).alias("x"), (F.col("l_extendedprice") + 1e8).alias("y"))
    m = linear.regress(df, "y", "x")
    return spark.createDataFrame([(round(float(m.beta[1]), 4), round(float(m.rsq), 6))], "slope double, r2 double")


_LG = "g AS (SELECT l_returnflag AS f, avg((l_linestatus = 'O')::INT) AS p, count(*) AS n FROM lineitem GROUP BY 1), a AS (SELECT * FROM g WHERE f = 'A')"


@query(f"""WITH {_LG}, r AS (SELECT 'Intercept' AS term, ln(p / (1 - p)) AS b, 1 / (n * p * (1 - p)) AS v FROM a
UNION ALL SELECT 'l_returnflag[' || g.f || ']', ln(g.p / (1 - g.p)) - ln(a.p / (1 - a.p)), 1 / (g.n * g.p * (1 - g.p)) + 1 / (a.n * a.p * (1 - a.p)) FROM g, a WHERE g.f <> 'A')
SELECT term, round(b, 5) AS coefficient, round(sqrt(v), 5) AS std_error, round(exp(b), 5) AS OR FROM r""")
def logistic_coefficients(spark, d):
    m = linear.logistic(table(spark, d, "lineitem"), "l_linestatus", "O", "l_returnflag")
    out = spark.createDataFrame([(c["index"], c["coefficient"], c["std_error"], c["OR"]) for c in m.coef], "term string, coefficient double, std_error double, OR double")
    return rounded(out, 5)


@query(f"WITH {_LG} SELECT l_orderkey, l_linenumber, round(p, 5) AS prediction FROM lineitem JOIN g ON l_returnflag = f")
def logistic_predict(spark, d):
    m = linear.logistic(table(spark, d, "lineitem"), "l_linestatus", "O", "l_returnflag")
    return m.predict().select("l_orderkey", "l_linenumber", F.round("prediction", 5).alias("prediction"))


@query(f"""WITH {_LG}, l AS (SELECT sum(n * (p * ln(p) + (1 - p) * ln(1 - p))) AS ll, sum(n * p) / sum(n) AS q, sum(n) AS n FROM g), t AS (SELECT *, n * (q * ln(q) + (1 - q) * ln(1 - q)) AS ll0 FROM l)
SELECT round(2 * (ll - ll0), 4) AS chisq, 2 AS df, round(exp(ll0 - ll), 5) AS p_value, round(1 - ll / ll0, 7) AS rsq_mcf FROM t""")
def logistic_chisq(spark, d):
    m = linear.logistic(table(spark, d, "lineitem"), "l_linestatus", "O", "l_returnflag")
    t = m.chisq_test("l_returnflag")
    return spark.createDataFrame([(round(float(t["chisq"]), 4), t["df"], round(float(t["p_value"]), 5), round(float(m.rsq_mcf), 7))], "chisq double, df int, p_value double, rsq_mcf double")


@query("SELECT unnest(['one', 'l_quantity', 'N', 'R']) AS term, 0.0 AS gradient")
def logistic_gradient(spark, d):
    """At the maximum of the likelihood the mean residual times each column is zero."""
    df = table(spark, d, "lineitem")
    m = linear.logistic(df, "l_linestatus", "O", ["l_quantity", "l_returnflag"])
    e = (F.col("l_linestatus") == "O").cast("double") - F.col("prediction")
    columns = {"one": F.lit(1.0), "l_quantity": F.col("l_quantity"), "N": (F.col("l_returnflag") == "N").cast("double"), "R": (F.col("l_returnflag") == "R").cast("double")}
    one = m.predict(df).agg(*[F.avg(e * c).alias(k) for k, c in columns.items()])
    out = one.select(F.inline(F.array(*[F.struct(F.lit(k).alias("term"), F.col(k).alias("gradient")) for k in columns])))
    return out.select("term", (F.round("gradient", 6) + F.lit(0.0)).alias("gradient"))


@query(f"""WITH {_TWO}, q AS (SELECT quantile_cont(l_quantity, 0.05) AS lo, quantile_cont(l_quantity, 0.95) AS hi FROM lineitem)
SELECT round(lo + (hi - lo) * i / 4, 4) AS value, round(b0 + b1 * (lo + (hi - lo) * i / 4) + b2 * m2, 2) AS prediction FROM f, q, (SELECT unnest(range(5)) AS i)""")
def pdp_linear(spark, d):
    """Partial dependence over all rows; on a linear model it is its line at the means of the other columns."""
    df = table(spark, d, "lineitem")
    m = linear.regress(df, "l_extendedprice", ["l_quantity", "l_discount"])
    out, _ = explain.partial_dependence(m, incl="l_quantity", grid=5, n_sample=2_000_000_000)
    return out.select(F.round(F.col("value").cast("double"), 4).alias("value"), F.round("prediction", 2).alias("prediction"))


# --- tests

@query("SELECT 'p_retailprice = p_size' AS null_hyp, round(avg(p_retailprice - p_size), 4) AS diff, round(avg(p_retailprice - p_size) / (stddev_samp(p_retailprice - p_size) / sqrt(count(*))), 4) AS statistic FROM part")
def means_paired(spark, d):
    r = hypothesis.compare_means(table(spark, d, "part"), "p_retailprice", ["p_size"], sample_type="paired", pair_by="p_partkey")
    return rounded(frame(spark, r.comparisons, "null_hyp string,diff double,statistic double"), 4)


@query("""WITH d AS (SELECT p_retailprice - 30 * p_size AS d FROM part), z AS (SELECT abs(d) AS a, d > 0 AS up FROM d WHERE d <> 0), r AS (SELECT up, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2 AS rk, count(*) OVER (PARTITION BY a) AS t FROM z),
s AS (SELECT sum(rk) FILTER (up) AS w, count(*) AS k, sum(t * t - 1) AS ties FROM r), o AS (SELECT *, w - k * (k + 1) / 4 AS off FROM s)
SELECT 'a = b' AS null_hyp, round((off - 0.5 * sign(off)) / sqrt(k * (k + 1) * (2 * k + 1) / 24 - ties / 48), 6) AS statistic FROM o""")
def signed_rank(spark, d):
    df = table(spark, d, "part").select("p_partkey", F.col("p_retailprice").alias("a"), (30.0 * F.col("p_size")).alias("b"))
    r = hypothesis.compare_means(df, "a", ["b"], sample_type="paired", test_type="wilcox", pair_by="p_partkey")
    return frame(spark, r.comparisons, "null_hyp string,statistic double")


_LONG = "v AS (SELECT variable, value FROM (SELECT l_quantity, l_discount * 100 AS d, l_tax * 100 AS t FROM lineitem) UNPIVOT (value FOR variable IN (l_quantity, d, t))), m AS (SELECT variable AS g, count(*) AS n, avg(value) AS a, var_samp(value) AS v FROM v GROUP BY 1)"


@query(f"WITH {_LONG}, o AS (SELECT *, CASE g WHEN 'l_quantity' THEN 0 WHEN 'd' THEN 1 ELSE 2 END AS i FROM m) SELECT x.g || ' = ' || y.g AS null_hyp, round(x.a - y.a, 6) AS diff, round((x.a - y.a) / sqrt(x.v / x.n + y.v / y.n), 3) AS statistic FROM o x JOIN o y ON x.i < y.i")
def means_columns(spark, d):
    df = table(spark, d, "lineitem").select("l_quantity", (F.col("l_discount") * 100).alias("d"), (F.col("l_tax") * 100).alias("t"))
    r = hypothesis.compare_means(df, "l_quantity", ["d", "t"])
    out = frame(spark, r.comparisons, "null_hyp string,diff double,statistic double")
    return out.withColumn("statistic", F.round("statistic", 3))


@query("""WITH c AS (SELECT count(*) AS n, count(*) FILTER (c_mktsegment = 'BUILDING') AS k FROM customer), p AS (SELECT n, k, unnest(range(n + 1)) AS i FROM c),
m AS (SELECT n, k, i, exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.2) + (n - i) * ln(0.8)) AS f FROM p), t AS (SELECT *, max(f) FILTER (i = k) OVER () AS here FROM m)
SELECT round(any_value(k) / any_value(n), 6) AS p, any_value(k) AS ns, any_value(n) AS n, round(least(1, sum(f) FILTER (f <= here * (1 + 1e-7))), 6) AS p_value FROM t""")
def single_prop_binomial(spark, d):
    r = hypothesis.single_prop(table(spark, d, "customer"), "c_mktsegment", "BUILDING", comp_value=0.2)
    return frame(spark, [r.stats[0] | r.comparisons[0]], "p double,ns long,n long,p_value double")


_PP = f"""m AS (SELECT l_returnflag AS g, count(*) AS n, sum((l_shipdate >= TIMESTAMP '1995-06-17')::INT) AS k FROM lineitem GROUP BY 1),
z AS (SELECT x.g || ' = ' || y.g AS null_hyp, (x.k / x.n - y.k / y.n) / sqrt((x.k + y.k) / (x.n + y.n) * (1 - (x.k + y.k) / (x.n + y.n)) * (1 / x.n + 1 / y.n)) AS z FROM m x JOIN m y ON x.g < y.g),
p AS (SELECT null_hyp, 1 - {_erf("(abs(z) / sqrt(2))")} AS p, row_number() OVER (ORDER BY abs(z) DESC) AS i, count(*) OVER () AS n FROM z)"""


def _props(spark, d, adjust):
    df = table(spark, d, "lineitem").withColumn("late", F.when(F.col("l_shipdate") >= F.to_timestamp(F.lit("1995-06-17")), "yes").otherwise("no"))
    return rounded(frame(spark, hypothesis.compare_props(df, "l_returnflag", "late", "yes", adjust=adjust).comparisons, "null_hyp string,p_value double"), 5)


@query(f"WITH {_PP} SELECT null_hyp, round(p, 5) AS p_value FROM p")
def props_p_values(spark, d):
    return _props(spark, d, None)


@query(f"WITH {_PP} SELECT null_hyp, round(least(1, p * n), 5) AS p_value FROM p")
def props_bonferroni(spark, d):
    return _props(spark, d, "bonferroni")


@query(f"WITH {_PP} SELECT null_hyp, round(max(least(1, p * (n - i + 1))) OVER (ORDER BY i), 5) AS p_value FROM p")
def props_holm(spark, d):
    return _props(spark, d, "holm")


@query(f"WITH {_PP} SELECT null_hyp, round(min(least(1, p * n / i)) OVER (ORDER BY i DESC), 5) AS p_value FROM p")
def props_fdr_bh(spark, d):
    return _props(spark, d, "fdr_bh")


@query("""WITH r AS (SELECT s_suppkey AS i, s_nationkey AS a, round(s_acctbal / 1000) AS b FROM supplier),
p AS (SELECT sign(x.a - y.a) * sign(x.b - y.b) AS s, x.a = y.a AS ta, x.b = y.b AS tb FROM r x JOIN r y ON x.i < y.i) SELECT round(sum(s) / sqrt((count(*) - sum(ta::INT)) * (count(*) - sum(tb::INT))), 6) AS r, (SELECT count(*) FROM r) AS n FROM p""")
def corr_kendall(spark, d):
    df = table(spark, d, "supplier").select(F.col("s_nationkey").alias("a"), F.round(F.col("s_acctbal") / 1000).alias("b"))
    return frame(spark, hypothesis.correlation(df, method="kendall").comparisons, "r double,n long")


@query("SELECT ceil((1.959963984540054 * 12 / 1.5) ** 2)::BIGINT AS n, ceil(ceil((1.959963984540054 * 12 / 1.5) ** 2) / 0.8 / 0.25)::BIGINT AS contacts")
def sample_size_mean(spark, d):
    r = hypothesis.sample_size("mean", err=1.5, sd=12, incidence=0.8, response=0.25)
    return spark.createDataFrame([(r["n"], r["contacts"])], "n long, contacts long")


# --- distributions

def _probabilities(name: str, sql: dict[str, str], bounds: dict, **parameters) -> None:
    """A query that holds a distribution's probabilities, rounded, against SQL expressions of them."""

    def run(spark, d):
        r = prob_calc(name, **bounds, **parameters)
        return spark.createDataFrame([(k, round(float(r[k]), 6)) for k in sql], "what string, value double")

    run.__name__ = f"prob_{name}"
    query(" UNION ALL ".join(f"SELECT '{k}' AS what, round(CAST({v} AS DOUBLE), 6) AS value" for k, v in sql.items()))(run)


def _sum(term: str, low: int, high: int) -> str:
    return f"list_sum(list_transform(range({low}, {high + 1}), lambda i: {term}))"


_PMF = "exp(lgamma(21) - lgamma(i + 1) - lgamma(21 - i) + i * ln(0.3) + (20 - i) * ln(0.7))"
_probabilities("binom", {"p_le_lb": _sum(_PMF, 0, 4), "p_at_lb": _sum(_PMF, 4, 4), "p_gt_ub": _sum(_PMF, 10, 20), "p_between": _sum(_PMF, 4, 9), "mean": "6"}, {"lb": 4, "ub": 9}, n=20, p=0.3)
_POIS = "exp(-2.5 + i * ln(2.5) - lgamma(i + 1))"
_probabilities("pois", {"p_lt_lb": _sum(_POIS, 0, 1), "p_le_ub": _sum(_POIS, 0, 5), "p_between": _sum(_POIS, 2, 5), "sd": "sqrt(2.5)"}, {"lb": 2, "ub": 5}, lamb=2.5)
_probabilities("norm", {"p_le_lb": _phi("(90 - 100) / 15.0"), "p_gt_ub": f"1 - {_phi('(120 - 100) / 15.0')}", "p_between": f"{_phi('(120 - 100) / 15.0')} - {_phi('(90 - 100) / 15.0')}"}, {"lb": 90, "ub": 120}, mean=100, stdev=15)
_probabilities("lnorm", {"p_le_lb": _phi("(ln(0.8) - 0.2) / 0.5"), "p_le_ub": _phi("(ln(3) - 0.2) / 0.5"), "mean": "exp(0.2 + 0.125)"}, {"lb": 0.8, "ub": 3}, meanlog=0.2, sdlog=0.5)
_probabilities("expo", {"p_le_lb": "1 - exp(-0.5)", "p_gt_ub": "exp(-2.0)", "mean": "4"}, {"lb": 2, "ub": 8}, rate=0.25)
_probabilities("unif", {"p_le_lb": "0.25", "p_between": "0.5", "mean": "5", "sd": "8 / sqrt(12)"}, {"lb": 3, "ub": 7}, min=1, max=9)
_probabilities("chisq", {"p_le_lb": "1 - exp(-1.0) * (1 + 1.0)", "p_gt_ub": "exp(-4.0) * (1 + 4.0)", "mean": "4", "sd": "sqrt(8)"}, {"lb": 2, "ub": 8}, df=4)
_probabilities("tdist", {"p_le_lb": "0.5 + atan(-1.5) / pi()", "p_gt_ub": "0.5 - atan(2.5) / pi()"}, {"lb": -1.5, "ub": 2.5}, df=1)
_probabilities("fdist", {"p_le_lb": "1 - (1 + 2 * 0.5 / 12) ** (-6)", "p_gt_ub": "(1 + 2 * 3.0 / 12) ** (-6)", "mean": "1.2"}, {"lb": 0.5, "ub": 3}, df1=2, df2=12)
_probabilities("disc", {"p_le_lb": "0.3", "p_at_ub": "0.3", "p_between": "0.9", "mean": "0.1 + 0.4 + 1.2 + 1.2", "sd": "sqrt(0.1 * 3.61 + 0.2 * 0.81 + 0.4 * 0.01 + 0.3 * 1.21)"}, {"lb": 2, "ub": 4}, v=[1, 2, 3, 4], p=[0.1, 0.2, 0.4, 0.3])


@query(f"SELECT c_custkey, round({_phi('(c_acctbal - 4500) / 3000')}, 6) AS p FROM customer")
def norm_cdf_column(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.round(norm_cdf(F.col("c_acctbal"), 4500, 3000), 6).alias("p"))


# --- evaluation

@query(f"WITH {_BINS}, t AS (SELECT unnest(['n_chars (All)', 'score (All)']) AS label), c AS (SELECT round(cum_obs / max(cum_obs) OVER (), 6) AS cum_prop, round(cum_resp / max(cum_resp) OVER (), 6) AS cum_gains FROM q UNION ALL SELECT 0.0, 0.0) SELECT cum_prop, cum_gains, label FROM c, t")
def curves_gains(spark, d):
    return rounded(evaluate.curves("gains", _scored(spark, d), "quality", 1, ["n_chars", "score"]))


_PR = "SELECT quality, n_chars / 10000 AS score FROM documents JOIN labels USING (doc_id)"


@query(f"WITH s AS ({_PR}), c AS (SELECT count(*) FILTER (quality = 1 AND score > 0.25) AS tp, count(*) FILTER (score > 0.25) AS m FROM s) SELECT (4 * tp - m)::DOUBLE AS profit FROM c")
def profit_at_break_even(spark, d):
    return evaluate.profit(_scored(spark, d), "quality", 1, "score", 1, 4).select(F.col("profit").cast("double").alias("profit"))


@query(f"WITH s AS ({_PR}), c AS (SELECT count(*) FILTER (quality = 1 AND score > 0.25) AS tp, count(*) FILTER (score > 0.25) AS m FROM s) SELECT round((4 * tp - m) / m, 6) AS ROME FROM c")
def rome_at_break_even(spark, d):
    return rounded(evaluate.rome(_scored(spark, d), "quality", 1, "score", 1, 4))


@query("WITH g AS (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1) SELECT o_orderstatus, t AS training, CASE t WHEN 0 THEN round(n * 0.3) ELSE n - round(n * 0.3) END::BIGINT AS count FROM g, (SELECT unnest([0, 1]) AS t)")
def training_shares(spark, d):
    return rows.make_train(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", "o_orderstatus").groupBy("o_orderstatus", "training").count()


# --- verbs

@query("SELECT o_orderkey, o_custkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def join_add(spark, d):
    return combine.combine(table(spark, d, "orders").select("o_orderkey", "o_custkey"), table(spark, d, "customer"), left_on="o_custkey", right_on="c_custkey", add="c_name")


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey::VARCHAR = c_custkey::VARCHAR")
def join_key_types(spark, d):
    x = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("k"))
    return combine.combine(x, table(spark, d, "customer").select(F.col("c_custkey").alias("k"), "c_name"), on="k").drop("k")


_SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY", "MISSING"]


@query("SELECT c_nationkey, " + ", ".join(f"count(*) FILTER (c_mktsegment = '{s}')::DOUBLE AS \"{s}\"" for s in _SEGMENTS) + " FROM customer GROUP BY 1")
def pivot_fill(spark, d):
    return pivot.pivot(table(spark, d, "customer"), "c_nationkey", "c_mktsegment", fill=0, levels=_SEGMENTS)


@query('SELECT lang, nullif(count(*) FILTER (quality = 0), 0)::DOUBLE AS "0", nullif(count(*) FILTER (quality = 1), 0)::DOUBLE AS "1", nullif(count(*) FILTER (quality IS NULL), 0)::DOUBLE AS "null" FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1')
def pivot_null_level(spark, d):
    return pivot.pivot(_docs(spark, d), "lang", "quality")


@query("SELECT l_returnflag, round(median(l_extendedprice) FILTER (l_linestatus = 'F'), 4) AS F, round(median(l_extendedprice) FILTER (l_linestatus = 'O'), 4) AS O FROM lineitem GROUP BY 1")
def pivot_median(spark, d):
    return rounded(pivot.pivot(table(spark, d, "lineitem"), "l_returnflag", "l_linestatus", "l_extendedprice", "median", levels=["F", "O"]), 4)


def _pivot_query(agg: str, sql: str):
    def run(spark, d):
        return rounded(pivot.pivot(table(spark, d, "lineitem"), "l_returnflag", "l_linestatus", "l_extendedprice", agg, levels=["F", "O"]), 2)

    run.__name__ = f"pivot_{agg}"
    query("SELECT l_returnflag, " + ", ".join(f"round({sql}(l_extendedprice) FILTER (l_linestatus = '{s}'), 2) AS {s}" for s in "FO") + " FROM lineitem GROUP BY 1")(run)


for _agg, _sql in (("sum", "sum"), ("min", "min"), ("max", "max"), ("std", "stddev_samp"), ("var", "var_samp")):
    _pivot_query(_agg, _sql)


@query("WITH q AS (SELECT p_type, quantile_cont(p_retailprice, [0, 0.25, 0.5, 0.75, 1]) AS b FROM part GROUP BY 1) SELECT p.p_type, (5 - greatest(1, len(list_filter(b, lambda e: e < p_retailprice))))::INT AS bin, count(*) AS count FROM part p JOIN q ON p.p_type = q.p_type GROUP BY 1, 2")
def xtile_by_group(spark, d):
    return bins.xtile(table(spark, d, "part"), "p_retailprice", 4, rev=True, by="p_type").groupBy("p_type", "bin").count()


@query("SELECT event_id, lag(value, 3) OVER (ORDER BY ts, event_id) AS value_lag FROM events")
def lag_whole(spark, d):
    return rows.shifted(table(spark, d, "events").select("event_id", "ts", "value"), "value", ["ts", "event_id"], 3).select("event_id", "value_lag")


@query("SELECT event_id, coalesce(lead(value) OVER (ORDER BY ts, event_id), -1) AS value_lead FROM events")
def lead_whole(spark, d):
    return rows.shifted(table(spark, d, "events").select("event_id", "ts", "value"), "value", ["ts", "event_id"], -1, -1.0).select("event_id", "value_lead")


@query("SELECT DISTINCT 'o_orderstatus' AS variable, o_orderstatus AS level FROM orders UNION ALL SELECT DISTINCT 'o_orderpriority', o_orderpriority FROM orders")
def levels_list(spark, d):
    found = reshape.levels_list(table(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"])
    return spark.createDataFrame([(k, x) for k, v in found.items() for x in v], "variable string, level string")


@query("SELECT c_custkey, (c_mktsegment = 'BUILDING')::TINYINT AS c_mktsegment_BUILDING, (c_mktsegment = 'AUTOMOBILE')::TINYINT AS c_mktsegment_AUTOMOBILE, (c_mktsegment NOT IN ('BUILDING', 'AUTOMOBILE'))::TINYINT AS c_mktsegment_other, (c_acctbal > 0)::TINYINT AS sign_up FROM customer")
def dummies_conditional(spark, d):
    seg = F.when(F.col("c_mktsegment").isin("BUILDING", "AUTOMOBILE"), F.col("c_mktsegment")).otherwise("other")
    df = table(spark, d, "customer").select("c_custkey", seg.alias("c_mktsegment"), F.when(F.col("c_acctbal") > 0, "up").otherwise("down").alias("sign"))
    return reshape.conditional_get_dummies(df, {"c_mktsegment": ["BUILDING", "AUTOMOBILE", "other"], "sign": ["down", "up"]}).select("c_custkey", "c_mktsegment_BUILDING", "c_mktsegment_AUTOMOBILE", "c_mktsegment_other", "sign_up")


@query("SELECT l_orderkey, l_linenumber, round(l_quantity + l_tax, 6) AS total, CASE WHEN l_discount > 0.05 THEN 'high' ELSE 'low' END AS kind FROM lineitem")
def row_functions(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(reshape.sum_horizontal(["l_quantity", "l_tax"]), 6).alias("total"), reshape.ifelse(F.col("l_discount") > 0.05, F.lit("high"), F.lit("low")).alias("kind"))


@query("SELECT p_partkey, CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' WHEN p < 0.1 THEN '.' ELSE ' ' END AS stars FROM (SELECT p_partkey, p_partkey % 997 / 2000.0 AS p FROM part)")
def stars(spark, d):
    return table(spark, d, "part").select("p_partkey", sig_stars(F.col("p_partkey") % 997 / 2000.0).alias("stars"))


@query("SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept, regr_count(l_extendedprice, l_quantity)::BIGINT AS n FROM lineitem GROUP BY 1")
def smooth_lines(spark, d):
    out = plotdata.smooth_data(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice", "l_returnflag")
    return out.select("l_returnflag", F.round("slope", 4).alias("slope"), F.round("intercept", 3).alias("intercept"), F.col("n").cast("long").alias("n"))


@query("SELECT 'Intercept' AS name, count(*) AS total FROM orders UNION ALL SELECT 'o_orderstatus[O]', count(*) FILTER (o_orderstatus = 'O') FROM orders UNION ALL SELECT 'o_orderstatus[P]', count(*) FILTER (o_orderstatus = 'P') FROM orders")
def design_columns(spark, d):
    df = table(spark, d, "orders")
    columns = Design.of(df, ["o_orderstatus"]).columns()
    one = df.agg(*[F.sum(c).alias(str(i)) for i, (_, _, c) in enumerate(columns)])
    return one.select(F.inline(F.array(*[F.struct(F.lit(n).alias("name"), F.col(str(i)).cast("long").alias("total")) for i, (n, _, _) in enumerate(columns)])))
