"""Model evaluation: deciles, gains, lift, profit, confusion, AUC, regression fit and uplift."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bins import average_ranks, exact_breaks, running_sums, valid, xtile
from .common import as_frame, col, join_groups, listed, need_columns, ratio


def _datasets(data) -> dict[str, DataFrame]:
    return dict(data) if isinstance(data, dict) else {"All": as_frame(data)}


def _is(rvar: str, lev) -> Column:
    return col(rvar).cast("string") == F.lit(str(lev))


def calc_qnt(data, rvar: str, lev, pred: str, qnt: int = 10, drop_null_response: bool = False, accuracy: int | None = None) -> DataFrame:
    """(bins, nr_obs, nr_resp, cum_obs, cum_resp, cum_resp_rate, cum_prop) by quantile bin of the prediction, the best bins first.

    The direction is down if the second bin has fewer responses than the last one. nr_obs counts null responses too, unless
    told otherwise. Running sums go over at most `qnt` rows.
    """
    df = as_frame(data)
    need_columns(df, [rvar, pred])
    df = df.select(col(rvar), col(pred)).filter(valid(col(pred).cast("double")))
    if drop_null_response:
        df = df.filter(col(rvar).isNotNull())
    bins = xtile(df, pred, qnt, name="bins", accuracy=accuracy).groupBy("bins").agg(F.count("*").alias("nr_obs"), F.count_if(_is(rvar, lev)).alias("nr_resp"))
    every = W.partitionBy()
    order = F.sort_array(F.collect_list(F.struct("bins", "nr_resp")).over(every))
    down = F.when(F.size(order) > 1, F.get(order, F.lit(1))["nr_resp"] < F.element_at(order, -1)["nr_resp"]).otherwise(False)
    turned = bins.withColumn("place", F.when(down, -F.col("bins")).otherwise(F.col("bins")))
    upto = W.orderBy("place").rowsBetween(W.unboundedPreceding, 0)
    out = turned.select(F.row_number().over(W.orderBy("place")).alias("bins"), "nr_obs", "nr_resp", F.sum("nr_obs").over(upto).alias("cum_obs"), F.sum("nr_resp").over(upto).alias("cum_resp"))
    return out.withColumn("cum_resp_rate", ratio(F.col("cum_resp"), F.col("cum_obs"))).withColumn("cum_prop", F.col("cum_obs") / F.max("cum_obs").over(every))


def _with_origin(df: DataFrame, columns: list[str]) -> DataFrame:
    origin = df.sparkSession.range(1).select(*[F.lit(0.0).alias(c) for c in columns])
    return origin.unionByName(df.select(*[F.col(c).cast("double").alias(c) for c in columns]))


def gains_tab(data, rvar: str, lev, pred: str, qnt: int = 10) -> DataFrame:
    """(cum_prop, cum_gains): the share of all responses in the best bins, from the origin on."""
    q = calc_qnt(data, rvar, lev, pred, qnt)
    return _with_origin(q.select("cum_prop", ratio(F.col("cum_resp"), F.max("cum_resp").over(W.partitionBy())).alias("cum_gains")), ["cum_prop", "cum_gains"])


def lift_tab(data, rvar: str, lev, pred: str, qnt: int = 10) -> DataFrame:
    """(cum_prop, cum_lift): the response rate of the best bins against that of all."""
    q = calc_qnt(data, rvar, lev, pred, qnt)
    every = W.partitionBy()
    return q.select("cum_prop", ratio(F.col("cum_resp_rate"), F.max("cum_resp").over(every) / F.max("cum_obs").over(every)).alias("cum_lift"))


def profit_tab(data, rvar: str, lev, pred: str, qnt: int = 10, cost: float = 1, margin: float = 2, scale: float = 1) -> DataFrame:
    """(cum_prop, cum_profit) from the origin on."""
    q = calc_qnt(data, rvar, lev, pred, qnt)
    return _with_origin(q.select("cum_prop", (scale * (margin * F.col("cum_resp") - cost * F.col("cum_obs"))).alias("cum_profit")), ["cum_prop", "cum_profit"])


def rome_tab(data, rvar: str, lev, pred: str, qnt: int = 10, cost: float = 1, margin: float = 2) -> DataFrame:
    """(cum_prop, cum_rome): return on marketing expenditures."""
    q = calc_qnt(data, rvar, lev, pred, qnt)
    return q.select("cum_prop", ratio(margin * F.col("cum_resp") - cost * F.col("cum_obs"), cost * F.col("cum_obs")).alias("cum_rome"))


def _confusion(rvar: str, lev, pred: Column, cost: float, margin: float) -> dict[str, Column]:
    hit, contact = _is(rvar, lev), pred > F.lit(cost / margin)
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    return {"TP": count(hit & contact), "FP": count(~hit & contact), "TN": count(~hit & ~contact), "FN": count(hit & ~contact)}


def confusion(data, rvar: str, lev, pred: str, cost: float = 1, margin: float = 2) -> DataFrame:
    """One row (TP, FP, TN, FN, contact): who is contacted if the prediction is over cost / margin."""
    if not isinstance(pred, str):
        raise ValueError("confusion takes one prediction")
    one = as_frame(data).agg(*[c.alias(k) for k, c in _confusion(rvar, lev, col(pred), cost, margin).items()])
    return one.withColumn("contact", ratio(F.col("TP") + F.col("FP"), F.col("TP") + F.col("FP") + F.col("TN") + F.col("FN")))


def profit(data, rvar: str, lev, pred: str, cost: float = 1, margin: float = 2, scale: float = 1) -> DataFrame:
    return confusion(data, rvar, lev, pred, cost, margin).select((scale * (margin * F.col("TP") - cost * (F.col("TP") + F.col("FP")))).alias("profit"))


def rome(data, rvar: str, lev, pred: str, cost: float = 1, margin: float = 2) -> DataFrame:
    spent = cost * (F.col("TP") + F.col("FP"))
    return confusion(data, rvar, lev, pred, cost, margin).select(ratio(margin * F.col("TP") - spent, spent).alias("ROME"))


def _auc_frame(df: DataFrame, hit: Column, pred: str, by: list[str], weight: str | None = None) -> DataFrame:
    """(by, auc): from average ranks of distinct predictions."""
    w = F.coalesce(col(weight).cast("double"), F.lit(0.0)) if weight else F.lit(1.0)
    kept = df.filter(hit.isNotNull() & valid(col(pred).cast("double"))).select(*map(col, by), col(pred).cast("double").alias("__p"), w.alias("__w"), hit.cast("double").alias("__y"))
    ranks = average_ranks(kept, "__p", by, "__w")
    ups = kept.groupBy(*map(col, by), "__p").agg(F.sum(F.col("__w") * F.col("__y")).alias("__up"))
    n1, n = F.sum("__up"), F.sum("n")
    joined = ranks.join(ups, [*by, "__p"])
    return joined.groupBy(*map(col, by)).agg(F.try_divide(F.sum(F.col("rank") * F.col("__up")) - n1 * (n1 + 1) / 2, n1 * (n - n1)).alias("auc"))


def auc(data, rvar: str, pred: str, lev=1, weight: str | None = None) -> DataFrame:
    """One row (auc): the Mann-Whitney share with ties at their mean rank, turned to at least one half."""
    one = _auc_frame(as_frame(data), _is(rvar, lev), pred, [], weight)
    return one.select(F.greatest("auc", 1 - F.col("auc")).alias("auc"))


def _stacked(data, preds: list[str], rvar: str) -> DataFrame:
    """All datasets and predictions in long form: (Type, predictor, rvar, pred). One pass over each dataset."""
    parts = []
    for name, df in _datasets(data).items():
        need_columns(df, [rvar, *preds])
        each = F.array(*[F.struct(F.lit(p).alias("predictor"), col(p).cast("double").alias("pred")) for p in preds])
        parts.append(df.select(F.lit(name).alias("Type"), col(rvar), F.inline(each)))
    return reduce(DataFrame.unionByName, parts)


def evalbin(data, rvar: str, lev, pred, cost: float = 1, margin: float = 2, scale: float = 1, dec: int = 3) -> DataFrame:
    """A row of eighteen measures for each dataset and prediction; index is the profit against the best of its dataset."""
    long = _stacked(data, listed(pred), rvar)
    one = long.groupBy("Type", "predictor").agg(*[c.alias(k) for k, c in _confusion(rvar, lev, F.col("pred"), cost, margin).items()])
    aucs = _auc_frame(long, _is(rvar, lev), "pred", ["Type", "predictor"]).withColumnRenamed("auc", "AUC")
    tp, fp, tn, fn = (F.col(k) for k in ("TP", "FP", "TN", "FN"))
    total = tp + fp + tn + fn
    out = one.join(aucs, ["Type", "predictor"], "left").withColumns({"total": total, "TPR": ratio(tp, tp + fn), "TNR": ratio(tn, tn + fp), "precision": ratio(tp, tp + fp), "accuracy": ratio(tp + tn, total), "profit": F.lit(scale) * (margin * tp - cost * (tp + fp)), "ROME": ratio(margin * tp - cost * (tp + fp), cost * (tp + fp)), "contact": ratio(tp + fp, total)})
    chance = ratio((tp + fn) * (tp + fp) + (tn + fp) * (tn + fn), total * total)
    out = out.withColumns({"Fscore": ratio(2 * F.col("precision") * F.col("TPR"), F.col("precision") + F.col("TPR")), "kappa": ratio(F.col("accuracy") - chance, 1 - chance), "index": ratio(F.col("profit"), F.max("profit").over(W.partitionBy("Type")))})
    keep = ["Type", "predictor", "TP", "FP", "TN", "FN", "total"]
    rounded = ["TPR", "TNR", "precision", "Fscore", "accuracy", "kappa", "profit", "index", "ROME", "contact", "AUC"]
    return out.select(*keep, *[F.round(F.col(c), dec).alias(c) for c in rounded])


def evalreg(data, rvar: str, pred, dec: int = 3) -> DataFrame:
    """(Type, predictor, n, r2, mse, mae) for each dataset and prediction, over rows with both values, in one aggregation."""
    long = _stacked(data, listed(pred), rvar).filter(col(rvar).isNotNull() & valid(F.col("pred")))
    y, e = col(rvar).cast("double"), col(rvar) - F.col("pred")
    out = long.groupBy("Type", "predictor").agg(F.count("*").alias("n"), (1 - F.try_divide(F.sum(e * e), F.var_pop(y) * F.count("*"))).alias("r2"), F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"))
    return out.select("Type", "predictor", "n", *[F.round(c, dec).alias(c) for c in ("r2", "mse", "mae")])


def uplift_tab(data, rvar: str, lev, pred: str, tvar: str, tlev, scale: float = 1, qnt: int = 10) -> DataFrame:
    """By bin of the prediction (breaks from treated rows, outer bins open, the best bin first): responses and rows of treated
    and control, uplift, their running sums, incremental responses and incremental uplift in percent of the treated."""
    df = as_frame(data)
    need_columns(df, [rvar, pred, tvar])
    p, treated = col(pred).cast("double"), _is(tvar, tlev)
    df = df.filter(valid(p) & col(tvar).isNotNull())
    breaks = exact_breaks(df.filter(treated), pred, qnt, "__b")
    inner = F.slice("__b", 2, qnt - 1)
    binned = df.crossJoin(F.broadcast(breaks)).withColumn("bins", qnt - F.size(F.filter(inner, lambda b: b < p)))  # one row
    hit = _is(rvar, lev)
    one = binned.groupBy("bins").agg(F.count_if(treated & hit).alias("T_resp"), F.count_if(treated).alias("T_n"), F.count_if(~treated & hit).alias("C_resp"), F.count_if(~treated).alias("C_n"))
    upto, every = W.orderBy("bins").rowsBetween(W.unboundedPreceding, 0), W.partitionBy()
    sums = {f"cum_{c}": F.sum(c).over(upto) for c in ("T_resp", "T_n", "C_resp", "C_n")}
    out = one.withColumn("uplift", ratio(F.col("T_resp"), F.col("T_n")) - ratio(F.col("C_resp"), F.col("C_n"))).withColumns(sums)
    out = out.withColumn("incremental_resp", F.col("cum_T_resp") - F.coalesce(F.col("cum_C_resp") * ratio(F.col("cum_T_n"), F.col("cum_C_n")), F.lit(0.0)))
    out = out.withColumn("inc_uplift", 100 * ratio(F.col("incremental_resp"), F.max("cum_T_n").over(every)))
    return out.withColumn("cum_prop", F.row_number().over(W.orderBy("bins")) / F.lit(float(qnt))).withColumn("incremental_resp", scale * F.col("incremental_resp"))


def inc_profit_tab(data, rvar: str, lev, pred, tvar: str, tlev, cost: float = 1, margin: float = 2, scale: float = 1, qnt: int = 10) -> DataFrame:
    """(Type, predictor, cum_prop, inc_profit) from the origin on, for each dataset and prediction."""
    parts = []
    for name, df in _datasets(data).items():
        for p in listed(pred):
            t = uplift_tab(df, rvar, lev, p, tvar, tlev, 1, qnt)
            t = t.select("cum_prop", (scale * (F.col("incremental_resp") * margin - F.col("cum_T_n") * cost)).alias("inc_profit"))
            parts.append(_with_origin(t, ["cum_prop", "inc_profit"]).select(F.lit(name).alias("Type"), F.lit(p).alias("predictor"), "cum_prop", "inc_profit"))
    return reduce(DataFrame.unionByName, parts)


def expected_profit(data, pred: str, cost: float = 1, margin: float = 2) -> DataFrame:
    """(pred, cum_n, cum_prop, profit) by distinct prediction from the highest: running sums of pred * margin - cost.

    Rows are counted by prediction first; the running sum goes range by range over the distinct predictions.
    """
    df = as_frame(data)
    counts = df.filter(valid(col(pred).cast("double"))).groupBy(col(pred).cast("double").alias("pred")).agg(F.count("*").alias("n"))
    counts = counts.withColumn("gain", F.col("n") * (F.col("pred") * margin - cost))
    out = join_groups(running_sums(counts, "pred", ["n", "gain"], descending=True), counts.agg(F.sum("n").alias("all")), [])
    return out.select("pred", F.col("n_upto").alias("cum_n"), (F.col("n_upto") / F.col("all")).alias("cum_prop"), F.col("gain_upto").alias("profit"))


CURVES = {"gains": gains_tab, "lift": lift_tab, "profit": profit_tab, "rome": rome_tab, "uplift": uplift_tab, "inc_profit": None}


def curves(kind: str, data, rvar: str, lev, pred, qnt: int = 10, **more) -> DataFrame:
    """The table of a kind for every dataset and prediction in one frame, with a label `predictor (dataset)` for a chart."""
    if kind not in CURVES:
        raise ValueError(f"Unknown curve: {kind}")
    if kind == "inc_profit":
        return inc_profit_tab(data, rvar, lev, pred, qnt=qnt, **more).withColumn("label", F.format_string("%s (%s)", "predictor", "Type"))
    parts = []
    for name, df in _datasets(data).items():
        for p in listed(pred):
            parts.append(CURVES[kind](df, rvar, lev, p, qnt=qnt, **more).withColumn("label", F.lit(f"{p} ({name})")))
    return reduce(DataFrame.unionByName, parts)
