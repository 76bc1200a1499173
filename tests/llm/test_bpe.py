import hashlib
import random

import pytest
import tiktoken

from tallyframe.llm.bpe import PrefixTable, TextTable, bpe_encode, encoder_of, op6_bpe_roundtrip, standard_vocabulary
from tallyframe.llm.lengths import answers, length_histogram, op8_token_counts


@pytest.fixture(scope="module")
def pair():
    content, pattern = standard_vocabulary()
    e = encoder_of(content, pattern)
    return e, tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=e.vocabulary.ranks, special_tokens={})


def test_equals_the_library(pair, texts):
    e, library = pair
    rng = random.Random(1)
    for alphabet, n in (("abcdeéß  \n\t'srtvmld,.#12345漢字😀 ", 800), ("aabbhetinor", 500), (" \n'", 200)):
        for _ in range(n):
            s = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60)))
            assert e.encode(s) == library.encode_ordinary(s)
            assert e.decode(e.encode(s)) == s.encode()
    for t in texts[:60]:
        assert e.encode(t or "") == library.encode_ordinary(t or "")


def test_long_piece_is_linear(pair):
    e, library = pair
    assert e.piece(b"abc" * 40_000) == library.encode_ordinary("abc" * 40_000)


def test_appends_and_edits(pair):
    e, library = pair
    rng = random.Random(2)
    for _ in range(20):
        table, s = TextTable(e), ""
        for _ in range(40):
            more = rng.choice(["'", " a", "re", "  ", "\n", "ll x", "é", "don't ", "1"])
            table.append(more)
            s += more
            assert table.ids() == library.encode_ordinary(s)
    for _ in range(60):
        data = bytes(rng.choice(b"theinorabc") for _ in range(400))
        table = PrefixTable(e.vocabulary, data)
        i = rng.randint(0, 400)
        j = rng.randint(i, min(400, i + 5))
        new = bytes(rng.choice(b"xyzthe") for _ in range(rng.randint(0, 5)))
        assert table.replace(i, j, new) <= 400
        fresh = PrefixTable(e.vocabulary, data[:i] + new + data[j:])
        assert table.data == fresh.data and table.last == fresh.last and table.tokens() == fresh.tokens()


def test_operator(spark, pair, edge, empty):
    _, library = pair
    out = bpe_encode(edge.withColumnRenamed("n_words", "N_Tokens"), *standard_vocabulary(), ids_column="ids")
    assert out.columns == ["doc_id", "text", "lang", "source", "spans", "taken", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]
    for r in out.collect():
        ids = library.encode_ordinary(r.text or "")
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    assert bpe_encode(empty, *standard_vocabulary()).count() == 0


def test_queries(spark, pair):
    from .conftest import SF

    _, library = pair
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    lengths = {i: len(library.encode_ordinary(t or "")) for i, t in texts.items()}
    assert {r.doc_id: r.n_tokens for r in op6_bpe_roundtrip(spark, SF).collect()} == lengths
    n = sorted(lengths.values())
    rows = op8_token_counts(spark, SF).collect()
    assert [r.length for r in sorted(rows)] == sorted(set(n))
    for r in rows:
        assert r.n_docs == n.count(r.length) and r.n_tokens == r.length * r.n_docs
        assert r.docs_from == sum(x >= r.length for x in n) and r.tokens_from == sum(x for x in n if x >= r.length)
        assert r.docs_before == sum(x < r.length for x in n) and r.truncated_total == sum(min(x, r.length) for x in n)
        assert r.rank == pytest.approx(sum(x <= r.length for x in n) / len(n))


def test_histogram_of_edges(spark):
    lengths = [None, 0, 0, 5, 5, 1023, 1024, 3000, 200_000]
    df = spark.createDataFrame([(x, "z") for x in lengths], "n long, block string")
    h = length_histogram(df, "n")
    got = answers(h, [1, 1000, 10**6], [0.0, 0.5, 1.0])
    n = sorted(x or 0 for x in lengths)
    assert got == {"docs": 9, "tokens": sum(n), "truncated": {m: sum(min(x, m) for x in n) for m in (1, 1000, 10**6)}, "quantiles": {0.0: 0, 0.5: n[4], 1.0: 200_000}}
    assert length_histogram(df.limit(0), "n").count() == 0
    assert answers(length_histogram(df.limit(0), "n"), [3], [0.5]) == {"docs": 0, "tokens": 0, "truncated": {3: 0}, "quantiles": {0.5: None}}
