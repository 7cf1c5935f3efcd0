import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from vigilo.llm import bpe
from vigilo.llm import token_file as tf


def brute(rows):
    tk, out, at = Tokenizer.from_file(bpe.default_path()), [], 0
    for d, t in rows:
        ids = [*tk.encode(t or "", add_special_tokens=False).ids, 1]
        out.append((d, at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        at += len(ids)
    return out


def test_documents(spark):
    sf = "/root/testdata/sf0.01"
    rows = sorted((r[0], r[1]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    assert sorted(map(tuple, tf.op10(spark, sf).collect())) == brute(rows)


def test_edges_long_texts_and_ties(spark, tmp_path):
    rows = [(3, "the cat"), (3, "the cat"), (1, None), (2, ""), (9, "word " * 30000), (7, "x" * 3000), (None, "no key"), (8, "<|endoftext|> Ä")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, part string, block int")
    path = tf.write(df, bpe.default_path(), str(tmp_path / "f"))
    key = lambda r: (r[0] is not None, r[0] or 0)
    want = brute(sorted(rows, key=key))
    assert sorted(map(tuple, tf.index(spark, path).collect()), key=lambda r: r[1]) == want
    texts = {}
    for r in tf.read(spark, path).orderBy("part", "ordinal", "piece").collect():
        texts.setdefault((r["part"], r["ordinal"]), []).extend(r["ids"])
    tk = Tokenizer.from_file(bpe.default_path())
    assert list(texts.values()) == [[*tk.encode(t or "", add_special_tokens=False).ids, 1] for _, t in sorted(rows, key=key)]
    assert spark.read.parquet(path).count() > 14  # the long text goes over many blocks


def test_empty_table(spark, tmp_path):
    path = tf.write(spark.createDataFrame([], "doc_id long, text string"), bpe.default_path(), str(tmp_path / "f"))
    assert tf.index(spark, path).count() == 0


def test_coder_round_trip():
    rnd = random.Random(1)
    lengths = np.array([1, 7, 500, 499, 300, 500])
    rows = [[0], [65535] * 7, [rnd.randrange(65536) for _ in range(500)], [rnd.randrange(4) for _ in range(499)],
            [(i * i) % 7 for i in range(300)], [1, 2, 3, 4, 5] * 100]
    ids = np.zeros((6, 500), dtype=np.uint32)
    for i, r in enumerate(rows):
        ids[i, :len(r)] = r
    alike = tf.Order0.of(65536)
    coded = tf.code(ids, lengths, alike)
    back = tf.decode(coded, lengths, alike)
    assert all(back[i, :n].tolist() == rows[i] for i, n in enumerate(lengths))
    # A block does not depend on the others of its group, and predictable ids take few bytes.
    assert tf.code(ids[5:], lengths[5:], alike)[0] == coded[5] and len(coded[5]) < 150 < 900 < len(coded[2])
    assert tf.decode([], np.zeros(0, int), tf.Order0.of(5)).size == 0
    for counts in (np.bincount(np.concatenate([np.array(r) for r in rows]), minlength=65536), np.eye(1, 65536, 3, dtype=np.int64)[0] * 10**12):
        order0 = tf.Order0.of(counts)
        assert tf.Order0.from_bytes(order0.to_bytes()).crc == order0.crc and order0.size.sum() == 1 << order0.bits
        back = tf.decode(tf.code(ids, lengths, order0), lengths, order0)
        assert all(back[i, :n].tolist() == rows[i] for i, n in enumerate(lengths))


def test_bits_an_id(spark, tmp_path):
    """The whole files, documents' tables and order 0 with them, against the
    entropy of the ids' frequencies."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    path = tf.write(docs, bpe.default_path(), str(tmp_path / "f"))
    n = tf.id_counts(tf.encoded(docs, bpe.default_path()), 49408)
    n = n[n > 0]
    entropy = -(n / n.sum() * np.log2(n / n.sum())).sum()
    rows = spark.read.parquet(path)
    bits = 8 * rows.selectExpr("sum(length(payload))").first()[0] / n.sum()
    print("bits an id", bits, "entropy", entropy)
    assert rows.selectExpr("sum(n_ids)").first()[0] == n.sum() and bits < entropy + 1


def test_damaged_blocks_are_found():
    docs = np.array([(5, tf.LAST_PIECE, 0, 0, 3)], dtype=tf._DOC)
    order0 = tf.Order0.of(10)
    value = tf.payload(docs, tf.code(np.array([[3, 4, 1]], dtype=np.uint32), np.array([3]), order0)[0], order0)
    assert tf.opened(value, order0)[0]["key"].tolist() == [5]
    with pytest.raises(ValueError, match="another order 0"):
        tf.opened(value, tf.Order0.of(11))
    for bad in (value[:-1], value[:9] + bytes([value[9] ^ 4]) + value[10:], b"", value[:20]):
        with pytest.raises(ValueError):
            tf.opened(bad, order0)


def test_crc_of_pieces():
    a, b = b"some bytes", bytes(range(256)) * 5
    assert tf.crc_combine(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)
    assert tf.crc_combine(0, zlib.crc32(b), len(b)) == zlib.crc32(b) and tf.crc_combine(zlib.crc32(a), 0, 0) == zlib.crc32(a)


def test_words_of_the_library_equal_whole_texts():
    rnd = random.Random(7)
    pool = "abc ABC'sdtrevml.,!_-12éÉß\n日Σ<|>"
    texts = ["".join(rnd.choice(pool) for _ in range(200)) for _ in range(200)] + ["'s'south ''s", "a_b __ _'ll"]
    tk = Tokenizer.from_file(bpe.default_path())
    for t, ids in zip(texts, tf.LibraryWords(bpe.default_path()).encode(texts), strict=True):
        assert ids.tolist() == tk.encode(t, add_special_tokens=False).ids, t


def test_documents_that_two_tasks_share(spark, tmp_path):
    """Files read in many splits: pieces meet again by their checksums."""
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(900))) for i in range(40)]
    path = tf.write(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), bpe.default_path(), str(tmp_path / "f"))
    again = str(tmp_path / "g")
    spark.read.parquet(path).repartition(16, "block").write.parquet(again)
    assert sorted(map(tuple, tf.index(spark, again).collect())) == brute(rows)
