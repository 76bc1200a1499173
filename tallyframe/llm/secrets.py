"""Secret scans with DataFrame functions only: fixed patterns, and Markov models of random strings and identifiers."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import release, settle, table

#: The base patterns, in the order of their kinds, with the least length of what counts (of group 2 for assign).
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([a-z0-9+/_.=-]+))"""
ACCESS = "AKIA[A-Z0-9]{12,}"  # 16 characters or more; a shorter match cannot hide a longer one
HEX = "[0-9a-f]{32,}"
BASE_KINDS = ("assign", "access", "hex")

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=_-"
CANDIDATE = "[A-Za-z0-9+/=_-]{20,}"
IDENTIFIERS = "get set make read write open close load store count total index value buffer stream client server request response handler manager factory config option default user account address message session number result error status update delete create insert select table column record field string object array list queue stack node tree graph parse format encode decode render print check verify test build start stop wait retry cache local remote public private static final version release document language license national international performance information".split()


#: Names of things, which are no secrets although they look random.
UUID = "(?<![0-9A-Za-z])[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}(?![0-9A-Za-z])"
LEAST = 20  # characters of what the models may add


def labelled_samples(spark: SparkSession, texts: DataFrame, text: str = "text", n_random: int = 2000) -> DataFrame:
    """(sample, random): `n_random` strings in each of six random styles, and identifiers made of the words of `texts`.

    Random, 20 to 64 characters: hex, base 64, base 62, upper-case base 36, letters, and lower-case base 36, from hashes of
    running numbers. Identifiers: words of the (small) table and a fixed list, alone, and two together in snake, camel and
    kebab case, as a path and with a number; padded numbers, dates and rulers.
    """
    digest = F.sha2(F.concat(F.lit("sample"), F.col("id").cast("string")), 512)
    b64 = F.base64(F.unhex(digest))
    plain = F.regexp_replace(b64, "[^A-Za-z0-9]", "")
    styles = F.array(digest, b64, plain, F.upper(plain), F.regexp_replace(b64, "[^A-Za-z]", ""), F.lower(plain))
    length = F.lit(LEAST) + (F.col("id") % 45).cast("int")
    random = spark.range(n_random).select(F.explode(F.transform(styles, lambda s: F.substring(s, F.lit(1), length))).alias("sample"), F.lit(True).alias("random"))
    words = F.split(F.lower(F.coalesce(F.col(f"`{text}`"), F.lit(""))), "[^A-Za-z]+")
    listed = texts.select(F.filter(words, lambda w: F.length(w) >= 3).alias("w"))
    fixed = spark.range(1).select(F.split(F.lit(" ".join(IDENTIFIERS)), " ").alias("w"))
    listed = listed.union(fixed).filter(F.size("w") >= 3)
    joined = lambda a, b: F.array(a, F.concat(a, F.lit("_"), b), F.concat(a, F.initcap(b)), F.concat(F.initcap(a), F.initcap(b)), F.concat(a, F.lit("-"), b), F.concat(a, F.lit("/"), b), F.concat(F.upper(a), F.lit("_"), F.upper(b)), F.concat(a, F.lit("_"), F.length(b).cast("string")))
    pairs = F.zip_with(F.slice("w", 1, F.size("w") - 1), F.slice("w", 2, F.size("w") - 1), joined)
    day = F.date_add(F.to_date(F.lit("2000-01-01")), (F.col("id") * 7).cast("int"))
    numbers = F.array(F.lpad(F.col("id").cast("string"), 24, "0"), F.date_format(day, "yyyy-MM-dd"), F.date_format(day, "yyyyMMdd"), F.concat(F.lit("v"), F.col("id").cast("string")))
    rulers = F.array(*[F.repeat(F.lit(c), (F.col("id") + LEAST).cast("int")) for c in "-=_+/"])
    ordinary = listed.select(F.explode(F.flatten(pairs)).alias("sample")).union(spark.range(500).select(F.explode(numbers))).union(spark.range(20).select(F.explode(rulers)))
    return random.union(ordinary.withColumn("random", F.lit(False)))


def train_weights(samples: DataFrame, smoothing: float = 0.5) -> list[float]:
    """Log-likelihood ratio of each pair of neighbours, random against identifier, by ALPHABET's positions.

    samples: (sample string, random boolean), any size. What comes to the driver is one count for each pair and label.
    """
    chars = F.filter(F.split("sample", ""), lambda c: F.instr(F.lit(ALPHABET), c) > 0)
    pairs = samples.select("random", chars.alias("c")).filter(F.size("c") > 1)
    pairs = pairs.select("random", F.explode(F.zip_with(F.slice("c", 1, F.size("c") - 1), F.slice("c", 2, F.size("c") - 1), lambda a, b: F.concat(a, b))).alias("pair"))
    k = len(ALPHABET)
    counts = {True: [smoothing] * (k * k), False: [smoothing] * (k * k)}
    for random, pair, n in pairs.groupBy("random", "pair").count().collect():
        counts[random][ALPHABET.index(pair[0]) * k + ALPHABET.index(pair[1])] += n
    total = {x: [sum(c[i * k : i * k + k]) for i in range(k)] for x, c in counts.items()}
    return [math.log(counts[True][i] / total[True][i // k]) - math.log(counts[False][i] / total[False][i // k]) for i in range(k * k)]


def _let(x: Column, body: Callable[[Column], Column]) -> Column:
    """body(x) with x evaluated once, also inside functions over arrays."""
    return F.element_at(F.transform(F.array(x), body), 1)


def _running(xs: Column, start: Column, step: Callable[[Column, Column], Column]) -> Column:
    """For each element what `step` has gathered from `start` over all earlier ones, and then over all: one more element.

    Blocks of about the square root keep the copying of arrays small: n elements cost n ** 1.5 copied references.
    """

    def within(v: Column) -> Column:
        n = F.size(v)
        block = F.greatest(F.lit(1), F.ceil(F.sqrt(n)).cast("int"))
        numbers = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((n - 1) / block).cast("int")))
        part = lambda k: F.slice(v, k * block + 1, block)
        grown = lambda ys, first: F.aggregate(ys, F.array(first), lambda acc, y: F.concat(acc, F.array(step(F.element_at(acc, -1), y))))
        borders = F.aggregate(numbers, F.array(start), lambda acc, k: F.concat(acc, F.array(F.aggregate(part(k), F.element_at(acc, -1), step))))
        inside = lambda b: F.flatten(F.transform(numbers, lambda k: _let(part(k), lambda ys: F.slice(grown(ys, F.element_at(b, k + 1)), 1, F.size(ys)))))
        return _let(borders, lambda b: F.concat(inside(b), F.array(F.element_at(b, -1))))

    return _let(xs, within)


_END = 2147483647  # behind every text
SPANS = "array<struct<start:int,rank:int,end:int,kind:string,what:string>>"


def _matches(text: Column, pattern: str, kind: str, rank: int, group: int = 0) -> Column:
    """Array of (start, rank, end, kind, what) for the matches of the pattern, in code points, end exclusive."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    what = found if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    parts = F.arrays_zip(F.transform(found, F.length).alias("n"), F.transform(F.split(text, pattern, -1), F.length).alias("gap"), what.alias("what"))
    parts = F.filter(parts, lambda x: x["n"].isNotNull())  # there is one more gap

    def spans(v: Column) -> Column:
        before = _running(F.transform(v, lambda x: x["gap"] + x["n"]), F.lit(0), lambda a, b: a + b)
        return F.zip_with(v, F.slice(before, 2, F.size(v)), lambda x, end: F.struct((end - x["n"]).alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"), x["what"].alias("what")))

    return F.when(text.rlike(pattern), _let(parts, spans)).otherwise(F.array().cast(SPANS))


def _ratios(token: Column, weights: Column) -> Column:
    """The log-likelihood ratio of each pair of neighbours; no odds at all for one that is not of ALPHABET."""
    codes = F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    odds = lambda a, b: F.when((a > 0) & (b > 0), F.element_at(weights, (a - 1) * len(ALPHABET) + b)).otherwise(F.lit(-math.inf))
    return _let(codes, lambda c: F.zip_with(F.slice(c, 1, F.size(c) - 1), F.slice(c, 2, F.size(c) - 1), odds))


def _stretches(token: Column, weights: Column, margin: Column) -> Column:
    """(start, end) of the parts of a run that are likelier random than an identifier by at least `margin`, a log-likelihood ratio.

    Ratios of neighbours are added up from where the sum was last not above zero; a part ends at the sum's peak, once the
    sum is zero again or `margin` below the peak. It then takes in the rest of the words it begins and ends in, and leaves
    out symbols before its first word.
    """
    ratios = F.concat(_ratios(token, weights), F.array(F.lit(-math.inf)))  # the last one ends the last part
    zero, none = F.lit(0.0), F.array().cast("array<struct<start:int,end:int>>")
    state = F.struct(F.lit(0).alias("at"), zero.alias("sum"), F.lit(0).alias("from"), zero.alias("peak"), F.lit(0).alias("to"), none.alias("out"))

    def step(s: Column, w: Column) -> Column:
        total, at = s["sum"] + w, s["at"] + 1
        ends = (total <= 0) | (total < s["peak"] - margin)
        good = ends & (s["peak"] >= margin) & (s["to"] - s["from"] >= LEAST)
        return F.struct(
            at.alias("at"),
            F.when(ends, zero).otherwise(total).alias("sum"),
            F.when(ends, at).otherwise(s["from"]).alias("from"),
            F.when(ends, zero).otherwise(F.greatest(s["peak"], total)).alias("peak"),
            F.when(ends, at).when(total > s["peak"], at + 1).otherwise(s["to"]).alias("to"),
            F.when(good, F.concat(s["out"], F.array(F.struct(s["from"].alias("start"), s["to"].alias("end"))))).otherwise(s["out"]).alias("out"),
        )

    found = F.aggregate(ratios, state, step, lambda s: s["out"])
    word = "[A-Za-z0-9]*"
    head = lambda x: F.length(F.regexp_extract(F.substring(token, F.lit(1), x["start"]), word + "$", 0))
    tail = lambda x: F.length(F.regexp_extract(F.substring(token, x["end"] + 1, F.length(token)), "^" + word, 0))
    lead = lambda x: F.length(F.regexp_extract(F.substring(token, x["start"] + 1, x["end"] - x["start"]), "^[+/=_-]*", 0))
    return F.array_distinct(F.transform(found, lambda x: F.struct(F.when(lead(x) > 0, x["start"] + lead(x)).otherwise(x["start"] - head(x)).alias("start"), (x["end"] + tail(x)).alias("end"))))


def _score(token: Column, weights: Column) -> Column:
    """The highest log-likelihood ratio of any part of the token."""
    state = F.struct(F.lit(0.0).alias("sum"), F.lit(0.0).alias("peak"))
    step = lambda s, w: F.struct(F.greatest(F.lit(0.0), s["sum"] + w).alias("sum"), F.greatest(s["peak"], s["sum"] + w).alias("peak"))
    return F.aggregate(_ratios(token, weights), state, step, lambda s: s["peak"])


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _replace(text: Column, spans: Column, filler: Callable[[Column], Column]) -> Column:
    """The text with each stretch that spans (by start) cover, overlapping ones as one, replaced by filler(its length).

    The text is cut into blocks, so a piece is found without counting from the start of the text.
    """
    size = 4096

    def pieces(v: Column) -> Column:
        cover = _running(F.transform(v["spans"], lambda s: s["end"]), F.lit(0), lambda a, b: F.greatest(a, b))  # where the earlier spans end
        rows = F.zip_with(F.concat(F.transform(v["spans"], lambda s: s["start"]), F.array(F.lit(_END))), cover, lambda start, c: F.struct(c.alias("from"), start.alias("to")))
        kept = F.filter(rows, lambda x: x["to"] >= x["from"])  # text before a stretch; the last is the rest of the text

        def stitch(u: Column) -> Column:
            ends = F.concat(F.transform(F.slice(u, 2, F.size(u)), lambda x: x["from"]), F.array(F.lit(0)))
            return F.array_join(F.zip_with(u, ends, lambda x, end: F.concat(cut(x["from"], F.least(x["to"], v["n"])), F.when(x["to"] < _END, filler(end - x["to"])).otherwise(F.lit("")))), "")

        def cut(a: Column, b: Column) -> Column:
            part = lambda j: F.substring(F.element_at(v["blocks"], j + 1), F.greatest(F.lit(0), a - j * size) + 1, F.least(F.lit(size), b - j * size) - F.greatest(F.lit(0), a - j * size))
            whole = F.transform(F.sequence(F.floor(a / size).cast("int"), F.floor((b - 1) / size).cast("int")), part)
            return F.when(b > a, F.array_join(whole, "")).otherwise(F.lit(""))

        return _let(kept, stitch)

    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    return F.when(F.size(spans) > 0, _let(F.struct(spans.alias("spans"), blocks.alias("blocks"), F.length(text).alias("n")), pieces)).otherwise(text)


def scan_secrets(df: DataFrame, weights: list[float], text: str = "text", *, margin: float = 12.0) -> DataFrame:
    """Add secret_base and secret_all, arrays of (start, rank, end, kind, what) by start and kind, for the text of each row.

    Base spans: assignments of 8 characters or more to a secret's name, access keys, runs of 32 hex digits. The models add
    (kind markov) the stretches of 20 or more of ALPHABET, outside of base spans and of UUIDs, whose log-likelihood ratio,
    random against identifier, is at least `margin`; they end with their words. Positions are code points, ends exclusive.
    Null and empty texts: no spans. Texts of any length are scanned whole, in time linear in the matches but for the copying
    of references (n ** 1.5). Repeated rows get equal spans; spans at one start are in the order of the kinds. Other columns
    are kept; equal names are replaced. Rows are independent, no shuffle and no Python.
    """
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    w, least = F.lit(weights), F.lit(float(margin))
    df = df.drop("secret_base", "secret_all")
    assign = F.filter(_matches(t, ASSIGN, "assign", 0, 2), lambda s: F.length(s["what"]) >= 8)
    df = df.withColumn("secret_base", F.array_sort(F.concat(assign, _matches(t, ACCESS, "access", 1), _matches(t, HEX, "hex", 2))))

    def scored(run: Column) -> Column:
        unnamed = F.regexp_replace(run["what"], UUID, " " * 36)
        span = lambda x: F.struct((run["start"] + x["start"]).alias("start"), F.lit(3).alias("rank"), (run["start"] + x["end"]).alias("end"), F.lit("markov").alias("kind"), F.substring(run["what"], x["start"] + 1, x["end"] - x["start"]).alias("what"))
        return F.transform(_stretches(unnamed, w, least), span)

    free = _replace(t, F.col("secret_base"), lambda n: F.repeat(F.lit(" "), n))
    added = F.when(t.rlike(CANDIDATE), F.flatten(F.transform(_matches(free, CANDIDATE, "markov", 3), scored))).otherwise(F.array().cast(SPANS))
    both = _let(added, lambda more: F.when(F.size(more) > 0, F.array_sort(F.concat("secret_base", more))).otherwise(F.col("secret_base")))
    return df.withColumn("secret_all", both)


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with each stretch that spans (by start) cover, overlapping ones as one, replaced by the mark. Null spans: null."""
    return _replace(text, spans, lambda n: F.lit(mark))


@dataclass(frozen=True)
class SecretModel:
    """Ratios of ALPHABET's pairs, the margin chosen on held-out samples, and what it does to them."""

    weights: list[float]
    margin: float
    recall: float
    false_rate: float


def train_model(samples: DataFrame, *, false_rate: float = 0.0001, missed: float = 0.01) -> SecretModel:
    """Ratios from four fifths of the different samples (by their hash). The margin comes from the others: in the middle between
    the score that `false_rate` of the identifiers pass and the one that `missed` of the random strings fall short of; the
    former alone if it is higher. Four numbers come to the driver besides the pair counts."""
    samples = settle(samples.distinct().withColumn("held", F.pmod(F.xxhash64("sample"), F.lit(5)) == 0))
    weights = train_weights(samples.filter("not held").select("sample", "random"))
    scores = samples.filter("held").select("random", _score(F.col("sample"), F.lit(weights)).alias("score"))
    score = lambda random: F.when(F.col("random") == random, F.col("score"))
    high, low = scores.agg(F.percentile(score(False), F.lit(1 - false_rate)), F.percentile(score(True), F.lit(missed))).first()
    high = (high or 0.0) + 0.01
    margin = max(high, (high + (low or 0.0)) / 2)
    hit = F.avg((F.col("score") >= margin).cast("double"))
    rates = {r.random: r.rate for r in scores.groupBy("random").agg(hit.alias("rate")).collect()}
    release(samples)
    return SecretModel(weights, margin, rates.get(True, 0.0), rates.get(False, 0.0))


def default_model(spark: SparkSession, sf_dir: str) -> SecretModel:
    return train_model(labelled_samples(spark, table(spark, sf_dir, "benchmark")))


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = default_model(spark, sf_dir)
    found = scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"), model.weights, margin=model.margin)
    count = lambda kind: F.size(F.filter("secret_base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    extra = (F.size("secret_all") - F.size("secret_base")).cast("long").alias("n_markov")
    return found.select("doc_id", *map(count, BASE_KINDS), F.sha2(_joined(F.col("secret_base")), 256).alias("base_sha256"), _joined(F.col("secret_all")).alias("spans"), extra)
