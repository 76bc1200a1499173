import re
from collections import Counter

from tallyframe.llm.quality import line_fails, op9_quality_rules, quality_rules


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)
    failed = n < 50 or 100 * len(covered) > 50 * n
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def test_edge_table(spark, edge, empty):
    out = quality_rules(edge, clean_column="clean")
    assert out.columns[:5] == ["doc_id", "text", "lang", "source", "spans"]
    for r in out.collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(r.text)
        assert not (r.base_failed and r.kept) and 0 <= r.lost_share <= 1
        assert r.n_bad_lines or r.clean == (r.text or "")
    assert quality_rules(empty).count() == 0


def test_query(spark):
    from .conftest import SF

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = op9_quality_rules(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(texts[r.doc_id])


def test_lines():
    assert line_fails(b"Home | News | About | Contact", 7) == "navigation"
    assert line_fails(b"By using this site you accept our cookie policy.", 9) == "boilerplate"
    assert line_fails(b"a### b### c### d", 4) == "symbols"
    assert line_fails(b"there is no end to this line", 7) == "punctuation"
    assert line_fails("This is a sentence, and it ends…".encode(), 7) is None
    assert line_fails(b"Short title", 2) is None


def test_loss_rejects(spark):
    clean = "".join(" ".join(f"w{i}x{k}" for k in range(15)) + ".\n" for i in range(6))
    mixed = clean + "".join(f"menu{i} item{i} > and{i} so{i} > more{i} words{i} with{i} no{i} end{i} whatever{i}\n" for i in range(12))
    rows = quality_rules(spark.createDataFrame([(0, clean), (1, mixed)], "doc_id int, text string"), clean_column="clean").orderBy("doc_id").collect()
    assert rows[0].kept and rows[0].clean == clean
    assert not rows[1].base_failed and not rows[1].kept and rows[1].clean.strip() == clean.strip()
