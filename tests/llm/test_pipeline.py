import hashlib
from collections import Counter

import corpus_pipeline as P
from tallyframe.llm.quality import quality_rules
from tallyframe.llm.shared import settle

from .test_jaccard import brute
from .test_secrets import base


def test_stages_one_by_one(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    good = {r.doc_id for r in quality_rules(docs).collect() if r.kept}
    a = settle(P.quality(spark, docs, d))
    assert a.columns == docs.columns and {r.doc_id for r in a.collect()} == good
    b = settle(P.deduplicate(spark, a, d))
    rows = a.collect()
    assert b.columns == docs.columns
    assert {r.doc_id for r in b.collect()} == {i for i, _, c in brute([(r.doc_id, r.text) for r in rows]) if i == c}
    c = settle(P.remove_secrets(spark, b, d))
    before = {r.doc_id: r.text for r in b.collect()}
    after = {r.doc_id: r for r in c.collect()}
    assert c.columns == docs.columns and after.keys() == before.keys()
    for i, r in after.items():
        assert not base(r.text) and (base(before[i]) or "[SECRET]" in r.text or r.text == before[i])
        assert r.n_chars == len(r.text)
    m = settle(P.mix(spark, c, d))
    copies = Counter(r.doc_id for r in m.collect())
    assert m.columns == docs.columns and set(copies) <= set(before) and max(copies.values()) == 2
    out = P.encode(spark, m, d).collect()
    assert Counter(r.doc_id for r in out) == copies
    for r in out:
        assert r.decoded_sha256 == hashlib.sha256(after[r.doc_id].text.encode()).hexdigest() and len(r.ids) == r.n_tokens


def test_edges(spark, empty):
    rows = [(1, "good " + " ".join(f"word{i}" for i in range(80)) + ".", None, None, 5), (1, "good " + " ".join(f"word{i}" for i in range(80)) + ".", None, None, 5), (None, None, None, None, None)]
    d = "/root/testdata/sf0.001"
    docs = spark.createDataFrame(rows, empty.schema)
    for _, stage in P.STAGES:
        docs = settle(stage(spark, docs, d))
    assert {r.doc_id for r in docs.collect()} == {1}
    docs = empty
    for _, stage in P.STAGES:
        docs = settle(stage(spark, docs, d))
    assert docs.count() == 0
    assert [n for n, _ in P.STAGES] and P.ORACLE_SQL is None


def test_null_and_repeated_ids(spark, empty):
    text = lambda name: "good " + " ".join(f"{name}{i}" for i in range(80)) + "."
    a, b, c, e = map(text, "abce")
    near = a.replace("a79", "other")
    rows = [(None, a, None, "s", 5), (None, near, None, "s", 5), (1, b, None, "s", 5), (2, b, None, "s", 5), (2, c, None, "s", 5), (3, e, None, "s", 5), (3, text("f"), None, "s", 5), (None, text("g"), None, "s", 5), (None, text("h"), None, "s", 5)]
    d = "/root/testdata/sf0.001"
    kept = settle(P.deduplicate(spark, spark.createDataFrame(rows, empty.schema), d))
    got = Counter((r.doc_id, r.text[5]) for r in kept.collect())
    assert got == Counter([(None, "a"), (1, "b"), (2, "c"), (3, "e"), (3, "f"), (None, "g"), (None, "h")])
    mixed = Counter((r.doc_id, r.text) for r in P.mix(spark, spark.createDataFrame(rows, empty.schema), d).collect())
    assert set(mixed.values()) <= {1, 2} and sum(mixed.values()) == 14  # 1.5 times 9 documents of one size, the last one whole
    assert P.deduplicate(spark, spark.createDataFrame([(4, "", None, "s", 0), (4, "", None, "s", 0)], empty.schema), d).count() == 2
