import hashlib
import random

from tokenizers import Tokenizer

from vigilo.llm import bpe


def same(texts):
    tk = Tokenizer.from_file(bpe.default_path())
    got = bpe.Encoder(bpe.default_path()).encode(texts)
    for t, ids in zip(texts, got, strict=True):
        assert ids.tolist() == tk.encode(t or "", add_special_tokens=False).ids, t


def test_edge_texts():
    same([None, "", " \n\t", "a", "don't DON'T we'll 'S 's", "ΑΣ ΣΑΣ Σ", "İstanbul ǅ ŉ", "é Å ́x",
          "x\x1cy\x1f z \x1d", "a\u0085b c d　e", "1234 ¼ ² ٣ Ⅷ", "<|endoftext|>", "a<|startoftext|>B <|ENDOFTEXT|> <|",
          "!!!***&&& a.b,c|d", "日本語テキスト 한국어 😀👩‍👩‍👧", "\x00\x01 �", "'" * 50, "of" * 700, "é" * 500, "x" * 5000])


def test_random_texts():
    rnd = random.Random(3)
    pool = "aaeeiioothnrs     'tsldmv.,!123ÀéßΣσ́ \x1c日<|>" + "\n"
    same(["".join(rnd.choice(pool) for _ in range(rnd.randrange(400))) for _ in range(400)])


def test_long_word_tree_equals_lanes():
    v = bpe.Vocabulary(bpe.default_path())
    rnd = random.Random(4)
    words = ["".join(rnd.choice("etaonrish") for _ in range(rnd.randint(1, 64))).encode() for _ in range(300)]
    for w, a in zip(words, v.merge_lanes(words, 64), strict=True):
        assert a == v.merge_long(w).tobytes()


def test_cache_overflow(monkeypatch):
    monkeypatch.setattr(bpe.Encoder, "remembered", 3)
    tk = Tokenizer.from_file(bpe.default_path())
    enc = bpe.Encoder(bpe.default_path())
    for t in ("alpha beta gamma delta", "epsilon alpha", "beta zeta eta theta alpha"):
        assert enc.encode([t])[0].tolist() == tk.encode(t, add_special_tokens=False).ids


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    tk = Tokenizer.from_file(bpe.default_path())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for d, t in docs:
        ids = tk.encode(t or "", add_special_tokens=False).ids
        want.append((d, len(ids), sha(" ".join(map(str, ids))), sha(tk.decode(ids, skip_special_tokens=False))))
    assert sorted(map(tuple, bpe.op6(spark, "/root/testdata/sf0.01").collect())) == sorted(want)


def test_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, None, 7), (2, "", 7), (3, "The cat", 7), (3, "The cat", 7), (None, "x", 7)], "doc_id long, text string, ids int")
    path = bpe.default_path()
    out = sorted(((str(r["key"]), len(r["ids"]), r["text"]) for r in bpe.decode(bpe.encode(df, path), path).collect()))
    assert out == [("1", 0, ""), ("2", 0, ""), ("3", 2, "the</w> cat</w>"), ("3", 2, "the</w> cat</w>"), ("None", 1, "x</w>")]
    assert bpe.digest(bpe.decode(bpe.encode(df.filter("false"), path), path)).count() == 0
