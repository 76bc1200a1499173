import zlib

import numpy as np

from tallyframe.llm import langid as L


def test_held_out_accuracy_and_contract(spark):
    d = "/root/testdata/sf0.01"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    rows = L.op5_language_id(spark, d).collect()
    assert len(rows) == len(docs)
    held = [r for r in rows if r.held_out]
    assert held and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_edges(spark, edge, empty):
    model = L.train_filter(edge)
    for r in L.identify(edge, model).collect():
        want_und = not any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == want_und and r.lang_pred in ("en", "und")
        assert 0 <= r.score <= 1
    nothing = L.train_filter(empty)
    assert {r.lang_pred for r in L.identify(edge, nothing).collect()} == {"und"}
    assert L.identify(empty, model).count() == 0


def test_filter_masks_lose_nothing_and_rates_are_right():
    rng = np.random.default_rng(2)
    own = {k: rng.integers(0, 2**63, 4000).astype(np.uint64) for k in ("a", "b", "c")}
    own["b"] = np.concatenate([own["b"], own["a"][:100]])
    f = L.LanguageFilter.build(own, bits=14)
    for i, k in enumerate(f.languages):
        assert (f.masks(own[k]) >> np.uint8(i) & 1).all()
    assert (f.masks(own["a"][:100]) & 3 == 3).all()
    other = f.masks(rng.integers(0, 2**63, 50_000).astype(np.uint64))
    for i in range(3):
        assert abs(((other >> np.uint8(i)) & 1).mean() - f.false[i]) < 0.02


def test_grams_stay_in_their_text():
    texts = [b"ab cd", b"", b"x", "éa 12 bc".encode()]
    h, owner, letters = L.grams(texts, (3,))
    assert letters.tolist() == [4, 0, 1, 4]
    assert np.bincount(owner, minlength=4).tolist() == [4, 0, 1, 4]  # " ab" "ab " " cd" "cd ", " x ", ...
    alone = np.sort(np.concatenate([L.grams([t], (3,))[0] for t in texts]))
    assert (np.sort(h) == alone).all()


def test_labels_of_copies_are_learned(spark):
    texts = {"xx": [f"aba cede {w} fogi {w}{w}" for w in ("lomu", "pira", "suto")], "yy": [f"zwek {w} vrilk tronk" for w in ("plunk", "skrit", "dwarn")]}
    rows = [(t, k) for k, v in texts.items() for t in v] * 300
    model = L.train_filter(spark.createDataFrame(rows, "text string, lang string"), rows_per_label=3)
    assert model.predict([t.encode() for v in texts.values() for t in v])[0] == ["xx"] * 3 + ["yy"] * 3


def plain_grams(text, sizes):
    """Every n-gram of every word, cut out letter by letter."""
    out, word = [], ""
    for c in text + " ":
        if c.isalpha():
            word += c.lower() if len(c.lower()) == 1 else c
        elif word:
            out += [(" " + word + " ")[i : i + n] for n in sizes for i in range(len(word) + 3 - n) if len(word) + 2 >= n]
            word = ""
    return out


def test_predictions_equal_brute_force(spark):
    d = "/root/testdata/sf0.01"
    docs = [(r.text, r.lang) for r in spark.read.parquet(f"{d}/documents.parquet").select("text", "lang").filter("text is not null").collect()]
    own = {}
    for text, lang in docs[::3]:
        own.setdefault(lang, set()).update(plain_grams(text, (3, 4)))
    whole = {k: np.unique(L.grams([t.encode() for t, lang in docs[::3] if lang == k], (3, 4))[0]) for k in own}
    assert all(len(whole[k]) == len(v) for k, v in own.items())  # as many different n-grams as cut out by hand
    f = L.LanguageFilter.build(whole, bits=22)
    texts = [t for t, _ in docs[1:200]]
    names, scores = f.predict([t.encode() for t in texts])
    for t, name, score in zip(texts, names, scores, strict=True):
        g = plain_grams(t, (3, 4))
        share = {k: sum(x in own[k] for x in g) / max(1, len(g)) for k in f.languages}
        if not any(c.isalpha() for c in t):
            assert (name, score) == ("und", 0.0)
            continue
        assert share[name] >= max(share.values()) - 0.002
        assert abs(score - share[name] / sum(share.values())) < 0.01


def test_more_than_64_languages():
    rng = np.random.default_rng(4)
    own = {f"l{i:03}": rng.integers(0, 2**63, 300).astype(np.uint64) for i in range(150)}
    f = L.LanguageFilter.build(own, bits=16)
    assert f.slots.shape == (3, 1 << 16)
    for i, k in enumerate(f.languages):
        assert ((f.masks(own[k], i // 64) >> np.uint64(i % 64)) & np.uint64(1)).all()
    words = {"".join(chr(97 + int(c)) for c in rng.integers(0, 26, 12)): k for k in own}
    many = L.LanguageFilter.build({k: L.grams([w.encode()], (3, 4))[0] for w, k in words.items()}, bits=16)
    assert many.predict([w.encode() for w in words])[0] == list(words.values())


def test_null_ids(spark, tmp_path):
    rows = [(None, "aba cede fogi", "xx", None, 1), (3, "zwek vrilk tronk", "yy", None, 1), (5, None, "yy", None, 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    out = {r.doc_id: r for r in L.op5_language_id(spark, str(tmp_path)).collect()}
    assert [out[i].held_out for i in (None, 3, 5)] == [False] + [zlib.crc32(str(i).encode()) % 5 == 0 for i in (3, 5)]
    assert out[None].lang_pred in ("yy", "und") and out[5].lang_pred == "und"
