import hashlib
import re

from tokenizers import Tokenizer

import corpus_pipeline as cp
from test_decontaminate import WORD, fold
from test_simhash import brute_components, brute_fp
from vigilo.llm import bpe, langid, pii


def chain(spark, docs, sf_dir):
    """Each stage's rows, as the stages hand them on."""
    out = []
    for _, stage in cp.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, sf_dir).collect(), stage(spark, docs, sf_dir).schema)
        out.append(docs)
    return out


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def test_stages_equal_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    first, second, third, fourth, last = map(rows_of, chain(spark, docs, sf))
    given = {r["doc_id"]: r for r in rows_of(docs)}
    assert all({**r, "lang": ""} == {**given[r["doc_id"]], "lang": ""} for r in first)
    assert {r["doc_id"] for r in first} == {d for d, r in given.items() if any(c.isalpha() for c in r["text"] or "")}
    comp = brute_components([r["doc_id"] for r in first], [brute_fp(r["text"]) for r in first])
    assert sorted(r["doc_id"] for r in second) == sorted(set(comp))
    wins = set()
    for (t,) in spark.read.parquet(f"{sf}/benchmark.parquet").select("text").collect():
        w = WORD.findall(fold(t))
        wins |= {" " + " ".join(w[i:i + 10]) + " " for i in range(max(1, len(w) - 9))} if w else set()
    clean = [r for r in second if not any(w in " " + " ".join(WORD.findall(fold(r["text"]))) + " " for w in wins)]
    assert sorted(r["doc_id"] for r in third) == sorted(r["doc_id"] for r in clean) and 0 < len(third) < len(second)
    texts = {r["doc_id"]: r["text"] for r in third}
    changed = [r for r in fourth if r["text"] != texts[r["doc_id"]]]
    assert len(fourth) == len(third) and changed and all(r["n_chars"] == len(r["text"]) for r in fourth)
    assert not any(re.search(r"[a-z]+\.\d+@|\+1 \(\d", r["text"]) for r in fourth)
    tk = Tokenizer.from_file(bpe.default_path())
    for r in last:
        ids = tk.encode(r["text"], add_special_tokens=False).ids
        assert r["ids"] == ids and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(tk.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert {r["doc_id"] for r in last} == {r["doc_id"] for r in fourth}
    ran = rows_of(cp.run(spark, sf))
    assert sorted(map(str, ran)) == sorted(map(str, last))


def test_edge_rows(spark):
    sf = "/root/testdata/sf0.001"
    text = "the cat sat on the mat and it was warm"
    rows = [(1, None, "en", None, None, "x"), (2, "", "en", "s", 0, "x"), (3, text, "en", "s", 1, "x"), (3, text, "en", "s", 1, "x"),
            (4, text.upper(), None, "s", 1, "x"), (None, "un autre texte en plus, pas le chat", "fr", "s", 1, "x"),
            (None, "etwas ganz anderes, nicht die Katze", "fr", "s", 1, "x"), (5, "word " * 40000, "en", "s", 1, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, hit string")
    last = rows_of(chain(spark, docs, sf)[-1])
    assert sorted(str(r["doc_id"]) for r in last) == ["3", "5", "None", "None"]
    assert set(last[0]) == {*cp.COLUMNS, "ids", "n_tokens", "ids_sha256", "decoded_sha256"}
    assert all(df.count() == 0 for df in chain(spark, docs.filter("false"), sf))


def test_languages_and_kinds_are_those_of_the_operators():
    assert [n for n, _ in cp.STAGES] == ["language", "near_duplicates", "decontaminate", "personal_data", "tokenize"]
    assert langid.UNKNOWN == "und" and [k.name for k in pii.KINDS][:4] == list(pii.BASE)
