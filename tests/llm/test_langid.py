import zlib
from collections import Counter

import numpy as np

from vigilo.llm import langid

SCHEMA = "doc_id long, text string, lang string, key string, score int"


def test_held_out_accuracy(spark):
    docs = {r[0]: r[1] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").collect()}
    rows = langid.op5(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == len(docs)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["lang_pred"] == docs[r["doc_id"]] for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_edges(spark):
    rows = [(1, "the cat and the dog", "en", "x", 1), (2, "le chat et le chien", "fr", "x", 1), (3, None, "fr", "x", 1),
            (4, "123 --", "en", "x", 1), (5, "", None, "x", 1), (6, "the dog", None, "x", 1), (6, "the dog", None, "x", 1),
            (7, "Ω", None, "x", 1), (8, "chien " * 200000, None, "x", 1), (None, "LE CHAT", None, "x", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    model = langid.fit(df)
    got = {r["key"]: (r["lang_pred"], r["score"]) for r in langid.identify(df, model).collect()}
    assert langid.identify(df, model).count() == len(rows)
    assert [got[k][0] for k in (1, 2, 3, 4, 5, 6, 8, None)] == ["en", "fr", "und", "und", "und", "en", "fr", "fr"]
    assert got[7] in (("en", 0.0), ("fr", 0.0)) and got[3][1] == 0.0


def test_no_training_rows(spark):
    df = spark.createDataFrame([], SCHEMA)
    model = langid.fit(df)
    assert model.names == [] and langid.identify(df, model).count() == 0
    some = spark.createDataFrame([(1, "abc", None, "x", 1)], SCHEMA)
    assert langid.identify(some, model).first()["lang_pred"] == "und"


def test_pieces_and_many_languages(monkeypatch):
    text = "Der schnelle Fuchs, über den Zaun!" * 50
    whole = np.sort(np.concatenate(list(langid.cells(text))))
    monkeypatch.setattr(langid, "PIECE", 64)
    assert np.array_equal(whole, np.sort(np.concatenate(list(langid.cells(text)))))
    rng = np.random.default_rng(0)
    members = [rng.integers(-1 << 63, (1 << 63) - 1, 50) for _ in range(130)]
    decider = langid.Filters([f"l{i:03d}" for i in range(130)], members, [0]).decider()
    for i in (0, 62, 63, 129):
        assert np.all(decider.masks(members[i])[i // 63] >> (i % 63) & 1)
        assert decider.hits(decider.masks(members[i]))[i] == 50


def ngrams(text):
    line = "".join(c if c.isalpha() else " " for c in text.lower())
    line = f" {' '.join(line.split())} " if line.strip() else ""
    return [line[i:i + n] for n in langid.SIZES for i in range(len(line) - n + 1)]


def test_hits_and_scores_equal_brute_force(spark):
    """Sets of n-grams instead of hashes and filters."""
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang").collect()]
    n = {}
    for d, t, lang in docs:
        if lang is not None and t is not None and d % 2:
            n.setdefault(lang, Counter()).update(ngrams(t))
    share = {lang: {g: c / sum(of.values()) for g, c in of.items()} for lang, of in n.items()}
    top = Counter()
    for of in share.values():
        for g, x in of.items():
            top[g] = max(top[g], x)
    known = {lang: {g for g, x in of.items() if x >= langid.MIN_SHARE and x >= langid.REL_SHARE * top[g]} for lang, of in share.items()}
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    model = langid.fit(df.filter("doc_id % 2 = 1"))
    assert model.names == sorted(known)
    decider, got = model.decider(), {r["key"]: (r["lang_pred"], r["score"]) for r in langid.identify(df, model).collect()}
    for d, t, _ in docs:
        grams = ngrams(t or "")
        if not grams:
            assert got[d] == ("und", 0.0)
            continue
        hits = [sum(g in known[lang] for g in grams) for lang in model.names]
        masks = [decider.hits(decider.masks(c)) for c in langid.cells(t)]
        assert np.abs(np.sum(masks, axis=0) - hits).max() <= 2 + 1e-4 * len(grams)  # a filter's false positives
        fair = np.maximum(0, (np.array(hits) / len(grams) - model.false) / (1 - model.false))
        if fair.sum() > 0 and np.sort(fair)[-1] - np.sort(fair)[-2] > 1e-3:
            assert got[d][0] == model.names[int(np.argmax(fair))] and abs(got[d][1] - fair.max() / fair.sum()) < 1e-3


def test_unlearned_script_knows_no_ngram(spark):
    """Dozens of n-grams that no language was taught must hit none."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    decider = langid.fit(docs).decider()
    for text in ("ვეფხისტყაოსანი არის ქართული ეპიკური პოემა და მისი ავტორია შოთა რუსთაველი", "ᏣᎳᎩ ᎦᏬᏂᎯᏍᏗ ᎤᏂᏬᏂᎯᏍᏗ ᎠᏂᏣᎳᎩ ᏧᎾᏓᎴᏅᏛ " * 9):
        assert sum(map(len, langid.cells(text))) > 100
        assert decider.decide(text) == (decider.fallback, 0.0)
