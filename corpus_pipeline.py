"""A corpus pipeline: quality rules, near-duplicate removal, secret redaction, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return
the columns of documents. Each is written as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm.bpe import bpe_encode, standard_vocabulary
from tallyframe.llm.jaccard import jaccard_components
from tallyframe.llm.mixing import fair_mix
from tallyframe.llm.quality import quality_rules
from tallyframe.llm.secrets import default_model, redact, scan_secrets
from tallyframe.llm.shared import settle

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; the others lose their failing lines.

    Null, empty and too short texts are rejected. Nulls in other columns stay, columns beyond those of documents go. Rows
    are judged one by one: repeated rows alike, ties play no part, an empty table stays empty.
    """
    judged = quality_rules(docs.select(*COLUMNS), clean_column="clean").filter("kept")
    return judged.select("doc_id", F.col("clean").alias("text"), "lang", "source", F.length("clean").cast("long").alias("n_chars"))


def _with_keys(docs: DataFrame) -> DataFrame:
    """The documents with a key for each row, settled so that it stays; ids may be null or repeated."""
    return settle(docs.select(*COLUMNS).withColumn("row", F.monotonically_increasing_id()))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the row with the least id stays; what is linked with nothing stays.

    Null ids come last, and among equal ids the first row stays (repeated rows are copies of each other). Null and wordless
    texts are linked with nothing and stay. Other columns of documents are untouched, further ones go; an empty table stays
    empty. Every row has a key of its own, so equal or null ids never take other rows with them.
    """
    rows = _with_keys(docs)
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row").alias("place")
    found = jaccard_components(rows.select(order, "text"), "place")
    away = found.filter("place != component_id").select("place.row")
    return rows.join(away, "row", "left_anti").select(*COLUMNS)


def remove_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span found is replaced by a mark, overlapping ones by one; no row goes.

    Null texts stay null, empty ones empty. Rows are independent: repeated rows change alike, an empty table stays empty.
    n_chars is counted anew (null for a null text); columns beyond those of documents go.
    """
    model = default_model(spark, sf_dir)
    found = scan_secrets(docs.select(*COLUMNS), model.weights, margin=model.margin)
    clean = redact(F.col("text"), F.col("secret_all"))
    return found.select("doc_id", clean.alias("text"), "lang", "source").withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, whole; one that it takes twice is there twice.

    Texts without words, null ones too, are never taken. Null sources are a source of their own, the last. Rows with null or
    equal ids are documents of their own; ties in finish time fall by source and running total. An empty table stays empty,
    and columns beyond those of documents go.
    """
    rows = _with_keys(docs)
    taken = fair_mix(rows, keep=["row"]).filter("taken > 0").select("row", F.ceil(F.col("taken") / F.col("size")).cast("int").alias("copies"))
    # One strategy at every size: texts are shuffled once and never sorted, the small side is the hash table.
    chosen = rows.join(settle(taken).hint("shuffle_hash"), "row")
    return chosen.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the whole text, with digests of the ids and of what they decode to.

    A null text counts as empty: no ids. Each row is encoded by itself, repeated rows alike, and keeps its id and source,
    null or not; an empty table gives no rows.
    """
    out = bpe_encode(docs, *standard_vocabulary(), ids_column="ids", keep=["doc_id", "source"])
    return out.select("doc_id", "source", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [("quality rules", quality), ("n-gram Jaccard join", deduplicate), ("secret scans", remove_secrets), ("mixing sources", mix), ("byte-level BPE", encode)]

#: SQL has neither the vocabulary's encoding nor the models' scores; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = settle(docs)
    return docs
