"""Mixing sources to target weights by weighted fair queueing.

Every source's documents are put in a seeded random order and given a virtual finish
time: the tokens of the source up to and with the document, divided by the source's
target. The second copies follow the first. In the global order of finish times the
mix takes documents until the budget is spent.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import settle, table

WORD = r"[^\x20\x09-\x0D]+"
_STEPS = 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(sizes: list[int], weights: list[float], budget: float, most: float) -> list[float]:
    """Share the budget by weight; what goes beyond `most` times a size is shared again among the others."""
    targets, full = [0.0] * len(sizes), set()
    while True:
        left = budget - sum(most * sizes[i] for i in full)
        total = sum(w for i, w in enumerate(weights) if i not in full)
        if not total:
            return targets
        for i, w in enumerate(weights):
            targets[i] = float(most * sizes[i]) if i in full else max(0.0, left) * w / total
        over = {i for i in range(len(sizes)) if i not in full and targets[i] > most * sizes[i]}
        if not over:
            return targets
        full |= over
        for i in over:
            targets[i] = float(most * sizes[i])


@dataclass
class _Step:
    """A step of virtual time: what is in it, what comes before it, the documents, and the least and largest finish times."""

    inside: Column
    before: int
    rows: int
    low: float
    high: float


def _ends_in(packets: DataFrame, step: Column, before: int, budget: int) -> _Step | None:
    """The first step by whose end `budget` words are taken; None if all steps have fewer."""
    steps = packets.groupBy(step.alias("step")).agg(F.sum("size").alias("n"), F.count("*").alias("rows"), F.min("turn.finish").alias("low"), F.max("turn.finish").alias("high"))
    steps = steps.withColumn("upto", before + F.sum("n").over(W.orderBy("step")))  # a few thousand steps, whatever the table's size
    r = steps.filter(F.col("upto") >= budget).orderBy("step").first()
    return r and _Step(step == r.step, r.upto - r.n, r.rows, r.low, r.high)


def fair_mix(df: DataFrame, id_column: str = "doc_id", text: str = "text", source: str = "source", *, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: int = 2, seed: int = 7, keep: list[str] | None = None, lot: int = 50_000) -> DataFrame:
    """(id, source, size, source_size, target, taken, finish) of each row, in the order of the mix (a global range sort), and the columns in `keep`
    (result columns take the place of equal names).

    size: words; null texts have none and are never taken. Sources by code point, null last, get `weights` in turn and
    share `share` times all words; no target is over `most` (1 or 2) times its source, the rest is shared again by weight.
    taken: words that the mix takes, a second copy counted; whole documents but for the one in which the budget ends.
    Repeated rows are separate documents. Ties fall by source, copy and running total, so reruns agree. An empty table
    gives no rows. Sources are a list that fits the driver (one row each is gathered); rows never are: running totals
    come from totals of slots of the random order in each source, of about `lot` documents at most, so a hot source is many
    window groups; the step of virtual time in which the budget ends is halved on until it has at most `lot` documents.
    """
    named = {id_column.lower(), source.lower(), "size", "source_size", "target", "taken", "finish"}
    names = [c for c in keep or [] if c.lower() not in named]
    kept = [F.col(f"`{c}`").alias(f"kept{i}") for i, c in enumerate(names)]
    base = df.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{source}`").alias("source"), word_count(F.col(f"`{text}`")).alias("size"), F.xxhash64(F.lit(seed), F.col(f"`{id_column}`"), F.col(f"`{text}`")).alias("key"), *kept)
    base, kept = settle(base), [f"kept{i}" for i in range(len(names))]
    spark = df.sparkSession
    totals = sorted((r.source is None, r.source or "", r.n, r.rows) for r in base.groupBy("source").agg(F.sum("size").alias("n"), F.count("*").alias("rows")).collect())
    sizes = [n for _, _, n, _ in totals]
    bits = min(32, max(12, (sum(r for *_, r in totals) // lot).bit_length()))
    budget = int(share * sum(sizes))
    targets = water_fill(sizes, [weights[i % len(weights)] for i in range(len(sizes))], share * sum(sizes), most)
    rows = [(None if null else name, i, n, t) for i, ((null, name, n, _), t) in enumerate(zip(totals, targets, strict=True))]
    known = spark.createDataFrame(rows, "source string, s int, source_size long, target double")
    docs = base.join(F.broadcast(known), base["source"].eqNullSafe(known["source"])).drop(known["source"]).withColumn("slot", F.shiftright("key", 64 - bits))

    slots = docs.groupBy("s", "slot").agg(F.sum("size").alias("n"))
    slots = slots.select("s", "slot", (F.sum("n").over(W.partitionBy("s").orderBy("slot")) - F.col("n")).alias("before"))
    within = F.sum("size").over(W.partitionBy("s", "slot").orderBy("key", "id").rowsBetween(W.unboundedPreceding, 0))
    docs = docs.join(slots, ["s", "slot"]).withColumn("upto", F.col("before") + within)
    served = (F.col("size") > 0) & (F.col("target") > 0)
    finish = lambda copy: F.when(served, (F.col("upto") + copy * F.col("source_size")) / F.col("target"))
    order = lambda copy: F.struct(finish(copy).alias("finish"), F.col("s").alias("s"), F.lit(copy).alias("copy"), F.col("upto").alias("upto"))
    docs = settle(docs.select("id", "source", "s", "size", "source_size", "target", "upto", *kept, *[order(c).alias(f"turn{c}") for c in range(most)]))

    # The step of virtual time in which the budget ends, then the document in it; up to two times all targets in equal steps, then in ever longer ones.
    t = F.col("turn.finish")
    packets = docs.select("size", F.explode(F.array(*[F.col(f"turn{c}") for c in range(most)])).alias("turn")).filter("turn.finish is not null")
    last = _ends_in(packets, F.when(t <= 2, F.floor(t * _STEPS)).otherwise(2 * _STEPS + F.floor(F.log2(t) * 64)).cast("long"), 0, budget)
    if last is None:
        taken = F.when(served, F.col("size") * most).otherwise(F.lit(0))
    else:
        inside = packets
        while True:
            inside = inside.filter(last.inside)
            if last.rows <= lot or not last.low < last.high:
                break
            part = F.least(F.lit(_STEPS - 1), F.floor((t - last.low) / (last.high - last.low) * _STEPS)).cast("long")
            last = _ends_in(inside, part, last.before, budget)
        inside = inside.withColumn("upto", last.before + F.sum("size").over(W.orderBy("turn").rowsBetween(W.unboundedPreceding, 0)))
        end = inside.filter(F.col("upto") >= budget).orderBy("turn").select("turn.*", (budget - F.col("upto") + F.col("size")).alias("part")).first()
        cut = F.struct(F.lit(end.finish).alias("finish"), F.lit(end.s).alias("s"), F.lit(end.copy).alias("copy"), F.lit(end.upto).alias("upto"))
        taken = F.lit(0).cast("long")
        for c in range(most):
            turn = F.col(f"turn{c}")
            taken = taken + F.when(turn["finish"].isNull(), 0).when(turn < cut, F.col("size")).when(turn == cut, F.lit(end.part)).otherwise(0)
    out = docs.withColumn("taken", taken.cast("long")).withColumn("finish", F.col("turn0.finish"))
    return out.orderBy("finish", "s", "upto").select(F.col("id").alias(id_column), F.col("source").alias(source), "size", "source_size", "target", "taken", "finish", *[F.col(f"kept{i}").alias(c) for i, c in enumerate(names)])


def op4_fair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fair_mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
