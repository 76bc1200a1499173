"""Token counts from an exact histogram of encoded lengths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bpe import bpe_encode, standard_vocabulary
from .shared import settle, table


def length_histogram(df: DataFrame, length: str) -> DataFrame:
    """One row for each encoded length that occurs, as a context limit: what the documents give up to it and under it.

    length, n_docs, n_tokens (of these documents); docs_from and tokens_from (of this length or more, suffix sums);
    docs_before (shorter); truncated_total: all tokens if each document is cut at this limit; rank: share of documents
    of at most this length, from which quantiles are read. Null lengths count as 0. An empty table gives no rows; ties
    and repeated rows only count. Suffix sums go by blocks of 1,024 lengths, then over the blocks' totals: no task
    sees more than 1,024 rows, or one row for each block (the longest text's tokens / 1,024).
    """
    rows = df.groupBy(F.coalesce(F.col(length), F.lit(0)).cast("long").alias("length")).agg(F.count("*").alias("n_docs"))
    rows = settle(rows.withColumn("n_tokens", F.col("length") * F.col("n_docs")).withColumn("block", F.floor(F.col("length") / 1024)))
    blocks = rows.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("n_tokens").alias("t"))
    later = W.orderBy(F.desc("block")).rowsBetween(W.unboundedPreceding, -1)
    every = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    blocks = blocks.select("block", *[F.coalesce(F.sum(c).over(later), F.lit(0)).alias(f"{c}_later") for c in "dt"], *[F.sum(c).over(every).alias(f"{c}_all") for c in "dt"])
    inside = W.partitionBy("block").orderBy(F.desc("length")).rowsBetween(W.unboundedPreceding, 0)
    out = rows.join(blocks, "block").select(
        "length",
        "n_docs",
        "n_tokens",
        (F.sum("n_docs").over(inside) + F.col("d_later")).alias("docs_from"),
        (F.sum("n_tokens").over(inside) + F.col("t_later")).alias("tokens_from"),
        "d_all",
        "t_all",
    )
    return out.select(
        "length",
        "n_docs",
        "n_tokens",
        "docs_from",
        "tokens_from",
        (F.col("d_all") - F.col("docs_from")).alias("docs_before"),
        (F.col("t_all") - F.col("tokens_from") + F.col("length") * F.col("docs_from")).alias("truncated_total"),
        ((F.col("d_all") - F.col("docs_from") + F.col("n_docs")) / F.col("d_all")).alias("rank"),
    )


def answers(histogram: DataFrame, limits: list[int], quantiles: list[float]) -> dict:
    """Totals of the whole, the total at any limits (also those no document has), and exact lower quantiles of the length."""
    q = [F.min(F.when(F.col("rank") >= p - 1e-12, F.col("length"))) for p in quantiles]
    cut = [F.sum(F.least("length", F.lit(x)) * F.col("n_docs")) for x in limits]
    row = histogram.agg(F.sum("n_docs"), F.sum("n_tokens"), *cut, *q).first()
    return {"docs": row[0] or 0, "tokens": row[1] or 0, "truncated": dict(zip(limits, (x or 0 for x in row[2 : 2 + len(limits)]), strict=True)), "quantiles": dict(zip(quantiles, row[2 + len(limits) :], strict=True))}


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = bpe_encode(table(spark, sf_dir, "documents"), *standard_vocabulary(), digests=False, keep=[])
    return length_histogram(encoded, "n_tokens")
