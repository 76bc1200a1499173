"""Quality rules: line-first cleaning.

Every line is judged by itself (end punctuation, navigation, boilerplate, symbols, an
earlier equal line); failing lines are removed, and a document that loses too much of
its text is rejected. Counts of the whole text come from the unchanged text.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .shared import ASCII_SPACE, documents_of, mix, table, with_results, word_hashes

#: What ends a sentence (UTF-8), phrases of site furniture, and separators of menus.
SENTENCE_END = (b".", b"!", b"?", b":", b";", b'"', b"'", b")", "…".encode(), "”".encode(), "’".encode(), "»".encode(), "。".encode(), "！".encode(), "？".encode())
BOILERPLATE = re.compile(rb"(?i)lorem ipsum|cookie policy|privacy policy|terms of (?:use|service)|all rights reserved|enable javascript|click here|subscribe (?:now|to our)|sign up for|follow us on|share (?:this|on) |powered by|back to top")
MENU = re.compile(r"[\x20\x09-\x0D](?:\||>|»|·|•|→)[\x20\x09-\x0D]".encode())
SYMBOLS = b"#*$%&|<>"

RESULTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, n_lines long, n_bad_lines long, lost_share double, kept boolean"


def line_fails(line: bytes, n_words: int) -> str | None:
    """The first rule that a line with at least one word breaks, or None.

    navigation: up to 30 words with two menu separators, or with one in up to 8 words.
    boilerplate: up to 40 words and a phrase of site furniture.
    symbols: at least 3 symbols, and more than one for ten words.
    punctuation: over 4 words, no end of a sentence at its end, and no full stop with a blank behind it inside.
    """
    if n_words <= 30:
        menus = len(MENU.findall(line))
        if menus >= 2 or (menus and n_words <= 8):
            return "navigation"
    if n_words <= 40 and BOILERPLATE.search(line):
        return "boilerplate"
    symbols = len(line) - len(line.translate(None, SYMBOLS))
    if symbols >= 3 and 10 * symbols > n_words:
        return "symbols"
    if n_words > 4 and not line.rstrip(ASCII_SPACE).endswith(SENTENCE_END) and b". " not in line:
        return "punctuation"
    return None


def repeated_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For each text the number of words, and of words in a 3-word window that the text has twice or more."""
    buf, begins = documents_of(texts)
    words, at = word_hashes(buf)
    doc = np.searchsorted(begins, at, "right") - 1
    n_words = np.bincount(doc, minlength=len(texts))[: len(texts)]
    covered = np.zeros(len(words), bool)
    if len(words) >= 3:
        key = mix(words[:-2] + mix(words[1:-1] + mix(words[2:] + doc[2:].astype(np.uint64))))
        inside = np.flatnonzero(doc[:-2] == doc[2:])
        order = inside[np.argsort(key[inside], kind="stable")]
        same = key[order[1:]] == key[order[:-1]]
        again = np.zeros(len(words), bool)
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        covered |= again
        covered[1:] |= again[:-1]
        covered[2:] |= again[:-2]
    return n_words, np.bincount(doc[covered], minlength=len(texts))[: len(texts)]


def judge(texts: list[bytes], max_lost: float = 0.5, min_words: int = 50, max_repeat: float = 0.5, with_text: bool = False) -> list[list]:
    n_words, n_repeat = repeated_words(texts)
    rows = []
    for text, n, repeat in zip(texts, n_words.tolist(), n_repeat.tolist(), strict=True):
        bare = text.translate(None, ASCII_SPACE)
        seen, good = set(), []
        n_lines = n_bad = n_dup = total = lost = 0
        for line in text.split(b"\n"):
            words = len(line.split())
            if not words:
                good.append(line)
                continue
            n_lines += 1
            total += len(line)
            if twice := line in seen:
                n_dup += 1
            seen.add(line)
            if twice or line_fails(line, words):
                n_bad += 1
                lost += len(line)
            else:
                good.append(line)
        failed = n < min_words or repeat > max_repeat * n
        share = lost / total if total else 0.0
        chars = len(bare) if bare.isascii() else len(bare.decode("utf-8", "replace"))
        row = [n, chars, len(bare) - len(bare.translate(None, SYMBOLS)), n_dup, repeat, failed, n_lines, n_bad, share, not failed and share <= max_lost]
        if with_text:
            row.append(b"\n".join(good).decode("utf-8", "replace"))
        rows.append(row)
    return [list(c) for c in zip(*rows, strict=True)]


def quality_rules(df: DataFrame, text: str = "text", *, max_lost: float = 0.5, min_words: int = 50, max_repeat: float = 0.5, clean_column: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """Add counts, the verdict `kept`, and in `clean_column` the text without its failing lines.

    A line may fail for navigation, boilerplate, symbols or missing end punctuation, or as a repetition of an
    earlier line of its text. A text is rejected if it has under `min_words` words, more than `max_repeat` of its
    words in repeated 3-word windows, or loses more than `max_lost` of the bytes of its lines.
    Null and empty texts: all counts 0, rejected. Other input columns are kept; result columns replace equal names.
    Repeated rows are judged alike. Rows are independent: no shuffle, memory bounded by the longest text.
    """
    results = RESULTS + (f", `{clean_column}` string" if clean_column else "")
    return with_results(df, text, results, lambda texts: judge(texts, max_lost, min_words, max_repeat, bool(clean_column)), keep)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), keep=["doc_id"])


def _sql() -> str:
    """The query as DuckDB SQL: the same counts and line rules."""
    word = r"[^\x20\x09-\x0D]+"
    q = lambda s: "'" + s.replace("'", "''") + "'"
    ends = " OR ".join(f"ends_with(b, {q(e.decode())})" for e in SENTENCE_END)
    return rf"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{word}') AS w, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM t WHERE len(w) > 2),
h AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) AS n FROM g),
r AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM h WHERE n > 1) GROUP BY 1),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM t),
m AS (SELECT doc_id, line, len(regexp_extract_all(line, '{word}')) AS n, row_number() OVER (PARTITION BY doc_id, line ORDER BY pos) > 1 AS twice, regexp_replace(line, '[\x20\x09-\x0D]+$', '') AS b,
  len(regexp_extract_all(line, '[\x20\x09-\x0D](?:\||>|»|·|•|→)[\x20\x09-\x0D]')) AS menus, length(line) - length(regexp_replace(line, '[#*$%&|<>]', '', 'g')) AS syms FROM l),
k AS (SELECT *, twice OR (n <= 30 AND (menus >= 2 OR (menus > 0 AND n <= 8))) OR (n <= 40 AND regexp_matches(line, {q(BOILERPLATE.pattern.decode())})) OR (syms >= 3 AND 10 * syms > n) OR (n > 4 AND NOT ({ends}) AND NOT contains(line, '. ')) AS bad FROM m WHERE n > 0),
s AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (bad) AS n_bad_lines, count(*) FILTER (twice) AS n_dup_lines, coalesce(sum(strlen(line)) FILTER (bad), 0) / sum(strlen(line)) AS lost_share FROM k GROUP BY 1),
f AS (SELECT t.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
  coalesce(n_lines, 0) AS n_lines, coalesce(n_bad_lines, 0) AS n_bad_lines, coalesce(lost_share, 0)::DOUBLE AS lost_share FROM t LEFT JOIN r ON t.doc_id = r.doc_id LEFT JOIN s ON t.doc_id = s.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed, n_lines, n_bad_lines, lost_share, NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND lost_share <= 0.5 AS kept FROM f"""


OP9_SQL = _sql()
