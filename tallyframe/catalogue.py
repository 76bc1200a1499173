"""Queries by name over the star-schema tables, and the SQL that each must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import bins, combine, distr, evaluate, explore, hypothesis, linear, moments, pivot, reshape, rows, simulate
from .plans import plotdata

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, dec: int = 6, skip: tuple[str, ...] = ()) -> DataFrame:
    return df.select(*[F.round(F.col(f"`{c}`"), dec).alias(c) if t in ("double", "float") and c not in skip else F.col(f"`{c}`") for c, t in df.dtypes])


def frame(spark: SparkSession, rows: list[dict], columns: str) -> DataFrame:
    """Result rows of a test as a frame of the named columns, doubles rounded."""
    names = [c.split()[0] for c in columns.split(",")]
    return rounded(spark.createDataFrame([tuple(float(r[n]) if "double" in c and r[n] is not None else r[n] for n, c in zip(names, columns.split(","), strict=True)) for r in rows], columns))


_STATS = {"mean": "avg({0})", "median": "quantile_cont({0}, 0.5)", "min": "min({0})", "max": "max({0})", "sd": "stddev_samp({0})"}


@query(" UNION ALL ".join(f"SELECT '{k}' AS statistic, " + ", ".join(f"round(CAST({v.format(c)} AS DOUBLE), 4) + 0.0::DOUBLE AS {c}" for c in ("l_quantity", "l_extendedprice", "l_discount")) + " FROM lineitem" for k, v in _STATS.items()))
def explore_all(spark, d):
    # Discounts hold both 0.0 and -0.0, of which either can be the minimum; adding 0.0 on both sides makes it 0.0.
    out = rounded(explore.explore(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"]), 4)
    return out.select("statistic", *[(F.col(c) + F.lit(0.0)).alias(c) for c in out.columns if c != "statistic"])


@query("SELECT l_returnflag, " + ", ".join(f"round(CAST({v.format('l_quantity')} AS DOUBLE), 6) AS l_quantity_{k}" for k, v in _STATS.items()) + " FROM lineitem GROUP BY l_returnflag")
def explore_grouped(spark, d):
    return rounded(explore.explore(table(spark, d, "lineitem"), "l_quantity", by="l_returnflag"))


def _docs(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")


@query("SELECT lang, count(DISTINCT quality) + max((quality IS NULL)::INT)::BIGINT AS quality_n_unique, sum((quality IS NULL)::INT)::BIGINT AS quality_n_missing, count(quality) AS quality_count FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang")
def explore_nulls(spark, d):
    return explore.explore(_docs(spark, d), "quality", ["n_unique", "n_missing", "count"], "lang")


@query("SELECT o_orderpriority, count(*) AS count FROM orders GROUP BY 1")
def pivot_freq(spark, d):
    return pivot.pivot(table(spark, d, "orders"), "o_orderpriority")


@query("WITH c AS (SELECT o_orderpriority, count(*)::DOUBLE AS count FROM orders GROUP BY 1), p AS (SELECT *, 100 * count / sum(count) OVER () AS count_pct FROM c) SELECT o_orderpriority, count, round(count_pct, 6) AS count_pct FROM p UNION ALL SELECT 'Total', sum(count), round(sum(count_pct), 6) FROM p")
def pivot_freq_pct_total(spark, d):
    return rounded(pivot.pivot(table(spark, d, "orders"), "o_orderpriority", normalize="total", totals=True))


_FO = "SELECT l_returnflag, {0} FILTER (l_linestatus = 'F') AS \"F\", {0} FILTER (l_linestatus = 'O') AS \"O\" FROM lineitem GROUP BY 1"
_CNT = _FO.format("count(*)")
_AVG = _FO.format("avg(l_extendedprice)")
_TOT = "t AS (SELECT l_returnflag, F::DOUBLE AS F, O::DOUBLE AS O, coalesce(F, 0)::DOUBLE + coalesce(O, 0)::DOUBLE AS Total FROM c), a AS (SELECT * FROM t UNION ALL SELECT 'Total', sum(F), sum(O), sum(Total) FROM t)"


@query(f"WITH c AS ({_CNT}) SELECT l_returnflag, nullif(F, 0)::DOUBLE AS F, nullif(O, 0)::DOUBLE AS O FROM c")
def pivot_crosstab(spark, d):
    return pivot.pivot(table(spark, d, "lineitem"), "l_returnflag", "l_linestatus", levels=["F", "O"])


@query(f"WITH c AS ({_AVG}), {_TOT} SELECT l_returnflag, round(F, 4) AS F, round(O, 4) AS O, round(Total, 4) AS Total FROM a")
def pivot_mean_totals(spark, d):
    return rounded(pivot.pivot(table(spark, d, "lineitem"), "l_returnflag", "l_linestatus", "l_extendedprice", "mean", totals=True, levels=["F", "O"]), 4)


@query(f"WITH c AS ({_CNT}), {_TOT} SELECT l_returnflag, round(100 * F / (F + O), 6) AS F, round(100 * O / (F + O), 6) AS O, 100.0::DOUBLE AS Total FROM a")
def pivot_norm_row(spark, d):
    return rounded(pivot.pivot(table(spark, d, "lineitem"), "l_returnflag", "l_linestatus", normalize="row", totals=True, levels=["F", "O"]))


@query(f"WITH c AS ({_CNT}), {_TOT} SELECT l_returnflag, round(100 * F / sum(F) OVER (), 6) AS F, round(100 * O / sum(O) OVER (), 6) AS O, Total FROM a")
def pivot_norm_column(spark, d):
    return rounded(pivot.pivot(table(spark, d, "lineitem"), "l_returnflag", "l_linestatus", normalize="column", totals=True, levels=["F", "O"]))


@query(f"WITH c AS ({_CNT}), {_TOT} SELECT l_returnflag, round(100 * F / sum(F + O) OVER (), 6) AS F, round(100 * O / sum(F + O) OVER (), 6) AS O, Total FROM a")
def pivot_norm_total(spark, d):
    return rounded(pivot.pivot(table(spark, d, "lineitem"), "l_returnflag", "l_linestatus", normalize="total", totals=True, levels=["F", "O"]))


@query("SELECT l_orderkey, l_linenumber, variable, value FROM lineitem UNPIVOT INCLUDE NULLS (value FOR variable IN (l_quantity, l_discount, l_tax))")
def unpivot_long(spark, d):
    return reshape.unpivot(table(spark, d, "lineitem"), ["l_quantity", "l_discount", "l_tax"], ["l_orderkey", "l_linenumber"])


def _join_inputs(spark, d):
    # All rows of both; the customers' keys are shifted, so that both sides have keys without a match.
    return table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), table(spark, d, "customer").select((F.col("c_custkey") + 100).alias("o_custkey"), F.col("c_acctbal").alias("o_totalprice"), "c_mktsegment")


_J = "FROM (SELECT o_orderkey, o_custkey, o_totalprice FROM orders) x {0} JOIN (SELECT c_custkey + 100 AS o_custkey, c_acctbal AS o_totalprice, c_mktsegment FROM customer) y ON x.o_custkey = y.o_custkey"
_JC = "SELECT o_orderkey, {key}, x.o_totalprice, y.o_totalprice AS o_totalprice_right, c_mktsegment "


def _join_query(how: str, sql: str):
    def run(spark, d):
        return combine.combine(*_join_inputs(spark, d), on="o_custkey", how=how)

    run.__name__ = f"join_{how}"
    query(sql)(run)


_join_query("inner", _JC.format(key="x.o_custkey") + _J.format("INNER"))
_join_query("left", _JC.format(key="x.o_custkey") + _J.format("LEFT"))
_join_query("right", _JC.format(key="y.o_custkey") + _J.format("RIGHT"))
_join_query("full", _JC.format(key="x.o_custkey, y.o_custkey AS o_custkey_right") + _J.format("FULL"))
_join_query("semi", "SELECT x.* " + _J.format("SEMI"))
_join_query("anti", "SELECT x.* " + _J.format("ANTI"))


@query("SELECT x.s_suppkey, x.s_name, y.c_name FROM supplier x JOIN customer y ON x.s_suppkey = y.c_custkey AND x.s_nationkey = y.c_nationkey")
def join_two_keys(spark, d):
    y = table(spark, d, "customer")
    return combine.combine(table(spark, d, "supplier").select("s_suppkey", "s_nationkey", "s_name"), y, left_on=["s_suppkey", "s_nationkey"], right_on=["c_custkey", "c_nationkey"], add="c_name").drop("s_nationkey")


@query("SELECT c_custkey, c_name, NULL::BIGINT AS s_suppkey FROM customer UNION ALL BY NAME SELECT s_suppkey, s_acctbal FROM supplier")
def bind_rows(spark, d):
    return combine.combine(table(spark, d, "customer").select("c_custkey", "c_name"), table(spark, d, "supplier").select("s_suppkey", "s_acctbal"), how="bind_rows")


@query("WITH x AS (SELECT c_custkey, c_name, row_number() OVER (ORDER BY c_custkey) AS i FROM customer), y AS (SELECT s_suppkey, s_name, row_number() OVER (ORDER BY s_suppkey) AS i FROM supplier) SELECT c_custkey, c_name, s_suppkey, s_name FROM x FULL JOIN y ON x.i = y.i")
def bind_cols(spark, d):
    return combine.combine(table(spark, d, "customer").select("c_custkey", "c_name"), table(spark, d, "supplier").select("s_suppkey", "s_name"), how="bind_cols", order_by=("c_custkey", "s_suppkey"))


def _set_inputs(spark, d):
    line = table(spark, d, "lineitem")
    x = line.select((F.col("l_partkey") % 50).alias("k"), F.when(F.col("l_returnflag") == "A", None).otherwise(F.col("l_returnflag")).alias("f"))
    return x, x.select((F.col("k") + 20).alias("k"), "f")  # all rows, shifted


_SX = "(SELECT l_partkey % 50 AS k, nullif(l_returnflag, 'A') AS f FROM lineitem)"
_SY = f"(SELECT k + 20 AS k, f FROM {_SX})"


@query(f"SELECT x.* FROM {_SX} x SEMI JOIN {_SY} y USING (k, f)")
def set_intersect(spark, d):
    return combine.combine(*_set_inputs(spark, d), how="intersect")


@query(f"SELECT x.* FROM {_SX} x ANTI JOIN {_SY} y USING (k, f)")
def set_setdiff(spark, d):
    return combine.combine(*_set_inputs(spark, d), how="setdiff")


@query(f"SELECT * FROM {_SX} UNION SELECT * FROM {_SY}")
def set_union(spark, d):
    return combine.combine(*_set_inputs(spark, d), how="union")


@query("WITH c AS (SELECT o_orderpriority, count(*) AS count FROM orders GROUP BY 1) SELECT o_orderpriority, count, round(count / sum(count) OVER (), 6) AS proportion, count(*) OVER () AS n_unique, (SELECT max({'c': count, 'v': o_orderpriority}).v FROM c) AS mode, 0::BIGINT AS n_missing FROM c")
def distr_cat(spark, d):
    return rounded(distr.value_counts(table(spark, d, "orders"), "o_orderpriority"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS count, round(count(*) / sum(count(*)) OVER (PARTITION BY o_orderstatus), 6) AS proportion FROM orders GROUP BY 1, 2")
def distr_cat_by(spark, d):
    return rounded(distr.value_counts(table(spark, d, "orders"), "o_orderpriority", "o_orderstatus"))


@query("SELECT 'o_orderdate' AS variable, count(DISTINCT o_orderdate) AS n_unique, 0::BIGINT AS n_missing, strftime(min(o_orderdate), '%Y-%m-%d') AS min, strftime(max(o_orderdate), '%Y-%m-%d') AS max FROM orders")
def distr_other(spark, d):
    out = distr.other_columns(table(spark, d, "orders"), "o_orderdate").drop("dtype")
    return out.withColumns({c: F.substring(c, 1, 10) for c in ("min", "max")})


@query("SELECT l_linestatus, round(avg((l_returnflag = 'R')::INT), 6) AS l_returnflag FROM lineitem GROUP BY 1")
def prop_by_group(spark, d):
    return rounded(moments.prop_calc(table(spark, d, "lineitem"), "l_linestatus", "l_returnflag", "R"))


@query("WITH m AS (SELECT sum(l_extendedprice * l_quantity) / sum(l_quantity) AS m FROM lineitem) SELECT 'l_extendedprice' AS variable, round(any_value(m), 4) AS mean, round(sqrt(sum(l_quantity * (l_extendedprice - m) ** 2) / sum(l_quantity)), 4) AS sd FROM lineitem, m")
def weighted_moments(spark, d):
    return rounded(moments.weighted_moments(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice"), 4)


@query("SELECT l_orderkey, l_linenumber, round((l_quantity - avg(l_quantity) OVER ()) / (2 * stddev_pop(l_quantity) OVER ()), 6) AS l_quantity FROM lineitem")
def scale_std(spark, d):
    return rounded(moments.scale_df(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), sf=2, exclude=["l_orderkey", "l_linenumber"]))


@query("SELECT round(avg(quality), 6) AS p, count(quality) AS n, round(avg(quality) * (1 - avg(quality)), 6) AS var, round(sqrt(avg(quality) * (1 - avg(quality))), 6) AS sd, round(sqrt(avg(quality) * (1 - avg(quality)) / count(quality)), 6) AS se FROM labels")
def varprop_seprop(spark, d):
    return rounded(moments.proportions(table(spark, d, "labels"), "quality"))


@query("SELECT event_id, coalesce(lag(value, 2) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0) AS before, lead(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS after FROM events")
def lag_lead(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", rows.lag("value", ["ts", "event_id"], 2, 0.0, "user_id").alias("before"), rows.lead("value", ["ts", "event_id"], 1, None, "user_id").alias("after"))


@query("WITH b AS (SELECT quantile_cont(o_totalprice, [0, 0.2, 0.4, 0.6, 0.8, 1]) AS b FROM orders) SELECT greatest(1, len(list_filter(b, lambda e: e < o_totalprice)))::INT AS bin, count(*) AS count FROM orders, b GROUP BY 1")
def xtile_counts(spark, d):
    return bins.xtile(table(spark, d, "orders"), "o_totalprice", 5).groupBy("bin").count()


@query("WITH b AS (SELECT [1, 10, 20, 40]::DOUBLE[] AS b) SELECT CASE WHEN l_quantity BETWEEN 1 AND 40 THEN greatest(1, len(list_filter(b, lambda e: e < l_quantity))) ELSE 0 END::INT AS bin, count(*) AS count FROM lineitem, b GROUP BY 1")
def bincode_counts(spark, d):
    return bins.bincode(table(spark, d, "lineitem"), "l_quantity", [1, 10, 20, 40]).groupBy("bin").count()


@query("SELECT r_name, l_returnflag FROM (SELECT r_name, unnest(range(r_regionkey)) AS i FROM region), (SELECT DISTINCT l_returnflag FROM lineitem)")
def table2data_grid(spark, d):
    repeated = reshape.table2data(table(spark, d, "region").select("r_name", "r_regionkey"), "r_regionkey")
    flags = reshape.expand_grid({"l_returnflag": reshape.levels_list(table(spark, d, "lineitem"), "l_returnflag")["l_returnflag"]}, spark=spark)
    return repeated.withColumn("l_returnflag", F.explode(F.lit([r[0] for r in flags.collect()])))


@query("SELECT a, b FROM (SELECT unnest(range(1, 8)) AS a), (SELECT unnest(['x', 'y']) AS b)")
def expand_grid(spark, d):
    return reshape.expand_grid({"a": list(range(1, 8)), "b": ["x", "y"]}, spark=spark)


@query("SELECT o_orderkey, (o_orderstatus = 'O')::TINYINT AS o_orderstatus_O, (o_orderstatus = 'P')::TINYINT AS o_orderstatus_P FROM orders")
def dummies(spark, d):
    return reshape.get_dummies(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), categories={"o_orderstatus": ["F", "O", "P"]})


@query("SELECT doc_id, (quality = 1)::INT AS quality FROM labels")
def binary_recode(spark, d):
    return reshape.convert_binary(table(spark, d, "labels").select("doc_id", "quality"), "quality", 1)


def _scored(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select("doc_id", "quality", "n_chars", (F.col("n_chars") / 10000).alias("score"))


_BINS = """s AS (SELECT doc_id, quality, n_chars, n_chars / 10000 AS score FROM documents JOIN labels USING (doc_id)),
br AS (SELECT quantile_cont(n_chars::DOUBLE, [0, .1, .2, .3, .4, .5, .6, .7, .8, .9, 1]) AS b FROM s),
g AS (SELECT greatest(1, len(list_filter(b, lambda e: e < n_chars))) AS bin, count(*) AS nr_obs, sum((quality = 1)::INT)::BIGINT AS nr_resp FROM s, br GROUP BY 1),
o AS (SELECT *, list(nr_resp ORDER BY bin) OVER (ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l FROM g),
q AS (SELECT row_number() OVER w AS bins, nr_obs, nr_resp, sum(nr_obs) OVER w AS cum_obs, sum(nr_resp) OVER w AS cum_resp FROM o WINDOW w AS (ORDER BY CASE WHEN l[2] < l[-1] THEN -bin ELSE bin END))"""


@query(f"WITH {_BINS} SELECT bins::INT AS bins, nr_obs, nr_resp, cum_obs::BIGINT AS cum_obs, cum_resp::BIGINT AS cum_resp, round(cum_resp / cum_obs, 6) AS cum_resp_rate, round(cum_obs / max(cum_obs) OVER (), 6) AS cum_prop FROM q")
def calc_qnt(spark, d):
    return rounded(evaluate.calc_qnt(_scored(spark, d), "quality", 1, "n_chars"))


@query(f"WITH {_BINS} SELECT round(cum_obs / max(cum_obs) OVER (), 6) AS cum_prop, round(cum_resp / max(cum_resp) OVER (), 6) AS cum_gains FROM q UNION ALL SELECT 0.0, 0.0")
def gains(spark, d):
    return rounded(evaluate.gains_tab(_scored(spark, d), "quality", 1, "n_chars"))


@query(f"WITH {_BINS} SELECT round(cum_obs / max(cum_obs) OVER (), 6) AS cum_prop, round(cum_resp / cum_obs / (max(cum_resp) OVER () / max(cum_obs) OVER ()), 6) AS cum_lift FROM q")
def lift(spark, d):
    return rounded(evaluate.lift_tab(_scored(spark, d), "quality", 1, "n_chars"))


@query(f"WITH {_BINS} SELECT round(cum_obs / max(cum_obs) OVER (), 6) AS cum_prop, (3 * cum_resp - 2 * cum_obs)::DOUBLE AS cum_profit FROM q UNION ALL SELECT 0.0, 0.0")
def profit(spark, d):
    return rounded(evaluate.profit_tab(_scored(spark, d), "quality", 1, "n_chars", cost=2, margin=3))


@query(f"WITH {_BINS} SELECT round(cum_obs / max(cum_obs) OVER (), 6) AS cum_prop, round((3 * cum_resp - 2 * cum_obs) / (2 * cum_obs), 6) AS cum_rome FROM q")
def rome(spark, d):
    return rounded(evaluate.rome_tab(_scored(spark, d), "quality", 1, "n_chars", cost=2, margin=3))


_CONF = "s AS (SELECT quality, n_chars / 10000 AS score FROM documents JOIN labels USING (doc_id)), c AS (SELECT sum((quality = 1 AND score > 0.2)::INT)::BIGINT AS TP, sum((quality <> 1 AND score > 0.2)::INT)::BIGINT AS FP, sum((quality <> 1 AND score <= 0.2)::INT)::BIGINT AS TN, sum((quality = 1 AND score <= 0.2)::INT)::BIGINT AS FN FROM s)"


@query(f"WITH {_CONF} SELECT TP, FP, TN, FN, round((TP + FP) / (TP + FP + TN + FN), 6) AS contact FROM c")
def confusion(spark, d):
    return rounded(evaluate.confusion(_scored(spark, d), "quality", 1, "score", 1, 5))


_AUC = "r AS (SELECT quality, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS rk FROM s), a AS (SELECT (sum(rk) FILTER (quality = 1) - count(*) FILTER (quality = 1) * (count(*) FILTER (quality = 1) + 1) / 2) / (count(*) FILTER (quality = 1) * count(*) FILTER (quality <> 1)) AS auc FROM r)"


@query(f"WITH {_CONF}, {_AUC} SELECT round(greatest(auc, 1 - auc), 6) AS auc FROM a")
def auc(spark, d):
    return rounded(evaluate.auc(_scored(spark, d), "quality", "score"))


@query(f"""WITH {_CONF}, {_AUC}, m AS (SELECT *, TP + FP + TN + FN AS total, TP / (TP + FN) AS TPR, TN / (TN + FP) AS TNR, TP / (TP + FP) AS precision, (TP + TN) / (TP + FP + TN + FN) AS accuracy,
((TP + FN) * (TP + FP) + (TN + FP) * (TN + FN)) / ((TP + FP + TN + FN) * (TP + FP + TN + FN)) AS ch FROM c)
SELECT 'All' AS Type, 'score' AS predictor, TP, FP, TN, FN, total, round(TPR, 6) AS TPR, round(TNR, 6) AS TNR, round(precision, 6) AS precision, round(2 * precision * TPR / (precision + TPR), 6) AS Fscore,
round(accuracy, 6) AS accuracy, round((accuracy - ch) / (1 - ch), 6) AS kappa, (5 * TP - (TP + FP))::DOUBLE AS profit, 1.0::DOUBLE AS index, round((5 * TP - (TP + FP)) / (TP + FP), 6) AS ROME, round((TP + FP) / total, 6) AS contact, round(auc, 6) AS AUC FROM m, a""")
def evalbin(spark, d):
    return evaluate.evalbin(_scored(spark, d), "quality", 1, "score", 1, 5, dec=6).withColumn("profit", F.col("profit").cast("double"))


@query("SELECT 'All' AS Type, 'pred' AS predictor, count(*) AS n, round(1 - sum((l_extendedprice - p) ** 2) / (var_pop(l_extendedprice) * count(*)), 6) AS r2, round(avg((l_extendedprice - p) ** 2), 2) AS mse, round(avg(abs(l_extendedprice - p)), 4) AS mae FROM (SELECT l_extendedprice, l_quantity * 1000 AS p FROM lineitem)")
def evalreg(spark, d):
    out = evaluate.evalreg(table(spark, d, "lineitem").withColumn("pred", F.col("l_quantity") * 1000), "l_extendedprice", "pred", dec=8)
    return out.select("Type", "predictor", "n", F.round("r2", 6).alias("r2"), F.round("mse", 2).alias("mse"), F.round("mae", 4).alias("mae"))


_UP = """br AS (SELECT quantile_cont(o_totalprice, [0, .1, .2, .3, .4, .5, .6, .7, .8, .9, 1]) FILTER (o_orderpriority = '1-URGENT') AS b FROM orders),
g AS (SELECT (10 - len(list_filter(b[2:10], lambda e: e < o_totalprice)))::INT AS bins, sum((o_orderpriority = '1-URGENT' AND o_orderstatus = 'F')::INT)::BIGINT AS T_resp, sum((o_orderpriority = '1-URGENT')::INT)::BIGINT AS T_n,
sum((o_orderpriority <> '1-URGENT' AND o_orderstatus = 'F')::INT)::BIGINT AS C_resp, sum((o_orderpriority <> '1-URGENT')::INT)::BIGINT AS C_n FROM orders, br GROUP BY 1),
u AS (SELECT *, T_resp / T_n - C_resp / C_n AS uplift, sum(T_resp) OVER w AS cum_T_resp, sum(T_n) OVER w AS cum_T_n, sum(C_resp) OVER w AS cum_C_resp, sum(C_n) OVER w AS cum_C_n, row_number() OVER w / 10.0 AS cum_prop FROM g WINDOW w AS (ORDER BY bins)),
i AS (SELECT *, cum_T_resp - cum_C_resp * cum_T_n / cum_C_n AS inc FROM u)"""


@query(f"WITH {_UP} SELECT bins, T_resp, T_n, C_resp, C_n, round(uplift, 6) AS uplift, cum_T_resp::BIGINT AS cum_T_resp, cum_T_n::BIGINT AS cum_T_n, cum_C_resp::BIGINT AS cum_C_resp, cum_C_n::BIGINT AS cum_C_n, round(inc, 6) AS incremental_resp, round(100 * inc / max(cum_T_n) OVER (), 6) AS inc_uplift, cum_prop::DOUBLE AS cum_prop FROM i")
def uplift(spark, d):
    return rounded(evaluate.uplift_tab(table(spark, d, "orders"), "o_orderstatus", "F", "o_totalprice", "o_orderpriority", "1-URGENT"))


@query(f"WITH {_UP} SELECT 'All' AS Type, 'o_totalprice' AS predictor, cum_prop::DOUBLE AS cum_prop, round(inc * 5 - cum_T_n * 1, 6) AS inc_profit FROM i UNION ALL SELECT 'All', 'o_totalprice', 0.0, 0.0")
def inc_profit(spark, d):
    return rounded(evaluate.inc_profit_tab(table(spark, d, "orders"), "o_orderstatus", "F", "o_totalprice", "o_orderpriority", "1-URGENT", 1, 5))


@query("WITH s AS (SELECT n_chars / 10000 AS pred, count(*) AS n FROM documents GROUP BY 1) SELECT pred, sum(n) OVER w::BIGINT AS cum_n, round(sum(n) OVER w / sum(n) OVER (), 6) AS cum_prop, round(sum(n * (pred * 5 - 1)) OVER w, 6) AS profit FROM s WINDOW w AS (ORDER BY pred DESC)")
def expected_profit(spark, d):
    df = table(spark, d, "documents").select((F.col("n_chars") / 10000).alias("score"))
    return rounded(evaluate.expected_profit(df, "score", 1, 5), skip=("pred",))


@query("SELECT round(avg(o_totalprice), 4) AS mean, count(*) AS n, round(stddev_samp(o_totalprice), 4) AS sd, round(stddev_samp(o_totalprice) / sqrt(count(*)), 4) AS se, round((avg(o_totalprice) - 100000) / (stddev_samp(o_totalprice) / sqrt(count(*))), 4) AS t_value FROM orders")
def single_mean(spark, d):
    r = hypothesis.single_mean(table(spark, d, "orders"), "o_totalprice", comp_value=100000)
    return rounded(frame(spark, [r.stats[0] | r.comparisons[0]], "mean double, n long, sd double, se double, t_value double"), 4)


@query("WITH p AS (SELECT avg((l_returnflag = 'R')::INT) AS p, count(*) AS n FROM lineitem) SELECT round(p, 6) AS p, n, round((p - 0.3) / sqrt(0.3 * 0.7 / n), 6) AS statistic FROM p")
def single_prop_z(spark, d):
    r = hypothesis.single_prop(table(spark, d, "lineitem"), "l_returnflag", "R", comp_value=0.3, test_type="z-test")
    return frame(spark, [r.stats[0] | r.comparisons[0]], "p double, n long, statistic double")


@query("WITH m AS (SELECT l_returnflag AS g, count(*) AS n, avg(l_extendedprice) AS a, var_samp(l_extendedprice) AS v FROM lineitem GROUP BY 1) SELECT x.g || ' = ' || y.g AS null_hyp, round(x.a - y.a, 4) AS diff, round((x.a - y.a) / sqrt(x.v / x.n + y.v / y.n), 4) AS statistic, round((x.v / x.n + y.v / y.n) ** 2 / ((x.v / x.n) ** 2 / (x.n - 1) + (y.v / y.n) ** 2 / (y.n - 1)), 2) AS df FROM m x JOIN m y ON x.g < y.g")
def means_welch(spark, d):
    r = hypothesis.compare_means(table(spark, d, "lineitem"), "l_returnflag", "l_extendedprice")
    out = spark.createDataFrame([(c["null_hyp"], c["diff"], c["statistic"], c["df"]) for c in r.comparisons], "null_hyp string, diff double, statistic double, df double")
    return out.select("null_hyp", F.round("diff", 4).alias("diff"), F.round("statistic", 4).alias("statistic"), F.round("df", 2).alias("df"))


@query("WITH k AS (SELECT DISTINCT event_type FROM events), e AS (SELECT a.event_type AS a, b.event_type AS b, e.event_type AS g, value FROM k a JOIN k b ON a.event_type < b.event_type JOIN events e ON e.event_type IN (a.event_type, b.event_type)), r AS (SELECT a, b, g, rank() OVER (PARTITION BY a, b ORDER BY value) + (count(*) OVER (PARTITION BY a, b, value) - 1) / 2 AS rk FROM e), s AS (SELECT a, b, sum(rk) FILTER (g = a) AS w, count(*) FILTER (g = a) AS n, count(*) FILTER (g = b) AS m FROM r GROUP BY 1, 2) SELECT a || ' = ' || b AS null_hyp, round((w - n * (n + m + 1) / 2) / sqrt(n * m * (n + m + 1) / 12), 6) AS statistic FROM s")
def ranksum_z(spark, d):
    r = hypothesis.compare_means(table(spark, d, "events"), "event_type", "value", test_type="wilcox")
    return frame(spark, r.comparisons, "null_hyp string,statistic double")


@query("WITH m AS (SELECT l_returnflag AS g, count(*) AS n, sum((l_linestatus = 'O')::INT) AS k FROM lineitem GROUP BY 1) SELECT x.g || ' = ' || y.g AS null_hyp, round(x.k / x.n - y.k / y.n, 6) AS diff, round((x.k / x.n - y.k / y.n) ** 2 / ((x.k + y.k) / (x.n + y.n) * (1 - (x.k + y.k) / (x.n + y.n)) * (1 / x.n + 1 / y.n)), 6) AS chisq_value FROM m x JOIN m y ON x.g < y.g")
def props_pairs(spark, d):
    r = hypothesis.compare_props(table(spark, d, "lineitem"), "l_returnflag", "l_linestatus", "O")
    return frame(spark, r.comparisons, "null_hyp string,diff double,chisq_value double")


_PAIRS = [("l_quantity", "l_extendedprice"), ("l_quantity", "l_discount"), ("l_extendedprice", "l_discount")]


@query(" UNION ALL ".join(f"SELECT '{a}' AS var_x, '{b}' AS var_y, round(corr({a}, {b}), 6) AS r, round(covar_samp({a}, {b}), 4) AS cov FROM lineitem" for a, b in _PAIRS))
def corr_pearson(spark, d):
    r = hypothesis.correlation(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])
    out = spark.createDataFrame([(c["var_x"], c["var_y"], c["r"], c["cov"]) for c in r.comparisons], "var_x string, var_y string, r double, cov double")
    return out.select("var_x", "var_y", F.round("r", 6).alias("r"), F.round("cov", 4).alias("cov"))


@query("WITH r AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2 AS a, rank() OVER (ORDER BY l_discount) + (count(*) OVER (PARTITION BY l_discount) - 1) / 2 AS b FROM lineitem) SELECT round(corr(a, b), 6) AS r, count(*) AS n FROM r")
def corr_spearman(spark, d):
    return rounded(hypothesis.spearman_frame(table(spark, d, "lineitem"), "l_quantity", "l_discount"))


_XT = "c AS (SELECT l_returnflag, l_linestatus, count(*) AS observed FROM lineitem GROUP BY 1, 2), t AS (SELECT *, sum(observed) OVER (PARTITION BY l_returnflag) AS r, sum(observed) OVER (PARTITION BY l_linestatus) AS k, sum(observed) OVER () AS n FROM c), x AS (SELECT *, r * k / n AS expected FROM t)"


@query(f"WITH {_XT} SELECT l_returnflag, l_linestatus, observed, round(expected, 4) AS expected, round((observed - expected) ** 2 / expected, 6) AS chisq, round((observed - expected) / sqrt(expected), 6) AS dev_std, round(observed / r, 6) AS perc_row, round(observed / k, 6) AS perc_col, round(observed / n, 6) AS perc FROM x")
def crosstab_cells(spark, d):
    out = hypothesis.crosstab_frame(table(spark, d, "lineitem"), "l_returnflag", "l_linestatus")
    return rounded(out.withColumn("expected", F.round("expected", 4)))


@query(f"WITH {_XT} SELECT round(sum((observed - expected) ** 2 / expected), 6) AS chisq, 2 AS df, round(exp(-sum((observed - expected) ** 2 / expected) / 2), 6) AS p_value FROM x")
def crosstab_chisq(spark, d):
    return frame(spark, hypothesis.cross_tabs(table(spark, d, "lineitem"), "l_returnflag", "l_linestatus").comparisons, "chisq double,df int,p_value double")


@query("WITH c AS (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1), s AS (SELECT sum((n - t / 5) ** 2 / (t / 5)) AS x FROM c, (SELECT count(*) AS t FROM orders)) SELECT round(x, 6) AS chisq, 4 AS df, round(exp(-x / 2) * (1 + x / 2), 6) AS p_value FROM s")
def goodness_chisq(spark, d):
    return frame(spark, hypothesis.goodness(table(spark, d, "orders"), "o_orderpriority").comparisons, "chisq double,df int,p_value double")


@query("SELECT round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2, round(sqrt(regr_syy(l_extendedprice, l_quantity) * (1 - regr_r2(l_extendedprice, l_quantity)) / count(*)), 3) AS rmse FROM lineitem")
def ols_simple(spark, d):
    m = linear.regress(table(spark, d, "lineitem"), "l_extendedprice", "l_quantity")
    return spark.createDataFrame([(round(float(m.beta[0]), 3), round(float(m.beta[1]), 4), round(float(m.rsq), 6), round(float(m.rmse), 3))], "intercept double, slope double, r2 double, rmse double")


@query("WITH m AS (SELECT avg(l_extendedprice) AS a, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem) SELECT round(lo + (hi - lo) * i / 4, 6) AS l_quantity, round(a, 4) AS l_extendedprice, (SELECT mode(l_returnflag) FROM lineitem) AS l_returnflag FROM m, (SELECT unnest(range(5)) AS i)")
def sim_grid(spark, d):
    out = simulate.sim_prediction(table(spark, d, "lineitem"), "l_quantity", ["l_quantity", "l_extendedprice", "l_returnflag"])
    return out.withColumns({"l_quantity": F.round("l_quantity", 6), "l_extendedprice": F.round("l_extendedprice", 4)})


@query("WITH q AS (SELECT p_type, quantile_cont(p_retailprice, [0.25, 0.5, 0.75]) AS q FROM part GROUP BY 1) SELECT p.p_type, round(q[1], 4) AS q1, round(q[2], 4) AS median, round(q[3], 4) AS q3, round(min(p_retailprice) FILTER (p_retailprice >= q[1] - 1.5 * (q[3] - q[1])), 4) AS low, round(max(p_retailprice) FILTER (p_retailprice <= q[3] + 1.5 * (q[3] - q[1])), 4) AS high FROM part p JOIN q ON p.p_type = q.p_type GROUP BY p.p_type, q")
def box_stats(spark, d):
    return rounded(plotdata.box_data(table(spark, d, "part"), "p_retailprice", "p_type"), 4)


@query("WITH m AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem) SELECT least(19, floor((l_extendedprice - lo) / ((hi - lo) / 20)))::INT AS bin, count(*) AS count FROM lineitem, m GROUP BY 1")
def hist_bins(spark, d):
    return plotdata.hist_data(table(spark, d, "lineitem"), "l_extendedprice", 20).select("bin", "count")


@query("SELECT p_type, round(avg(p_retailprice), 4) AS p_retailprice FROM part GROUP BY 1")
def bar_agg(spark, d):
    return rounded(plotdata.bar_data(table(spark, d, "part"), "p_type", "p_retailprice"), 4)


@query()
def logistic_scores(spark, d):
    m = linear.logistic(table(spark, d, "lineitem"), "l_linestatus", "O", ["l_quantity", "l_returnflag"])
    return m.predict(ci=True).select("l_orderkey", "l_linenumber", F.round("prediction", 6).alias("prediction"))


@query()
def training_flags(spark, d):
    return rows.make_train(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", "o_orderstatus")


from . import catalogue_more  # noqa: E402, F401 - adds its queries to the same tables
