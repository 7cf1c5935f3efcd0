import hashlib
import random

import numpy as np
import pyarrow as pa

import doubling

from vigilo.llm import suffix_dedup as sd


def brute(rows, length=50):
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - length + 1):
            w = b[i:i + length]
            first[w] = min(first.get(w, float("inf")), float("inf") if d is None else d)
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), dtype=bool)
        for i in range(len(b) - length + 1):
            if first[b[i:i + length]] < (float("inf") if d is None else d):
                gone[i:i + length] = True
        runs = int(np.count_nonzero(np.diff(np.concatenate([[0], gone.astype(int)])) == 1))
        kept = bytes(np.frombuffer(b, dtype=np.uint8)[~gone])
        out.append((d, len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def check(spark, rows, **how):
    df = spark.createDataFrame([(*r, "a", 1) for r in rows], "doc_id long, text string, key string, bucket int").repartition(5)
    got = sd.digest(sd.remove_repeats(df, **how)).collect()
    key = lambda x: tuple(map(str, x))
    assert sorted(map(tuple, got), key=key) == sorted(brute(rows, how.get("length", 50)), key=key)


def test_documents(spark):
    check(spark, [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()])


def test_overlaps_of_random_pieces(spark):
    rnd = random.Random(2)
    base = "".join(rnd.choice("abcdé ") for _ in range(3000))
    low = "".join(rnd.choice("ab") for _ in range(4000))  # many equal prefixes in different blocks
    rows = []
    for d in range(120):
        parts = []
        for _ in range(rnd.randrange(6)):
            src = rnd.choice((base, low))
            s = rnd.randrange(len(src))
            parts.append(src[s:s + rnd.choice((10, 45, 49, 50, 51, 60, 200, 700))])
            parts.append("".join(rnd.choice("xyz") for _ in range(rnd.choice((0, 1, 3, 30)))))
        rows.append((rnd.randrange(90), "".join(parts)))
    check(spark, rows)
    check(spark, rows, length=30, prefix=6)
    check(spark, rows, piece_bytes=150, chunk_bytes=2000, bucket_bytes=1500)
    # More buckets than one chunk deals its rows among: tasks deal them again; prefixes open early.
    check(spark, rows, chunk_bytes=2000, bucket_bytes=500, fan=5, hot=2, held_rows=300)
    check(spark, rows, length=30, prefix=6, bucket_bytes=500, fan=3, hot=3, held_rows=100)


def test_edges_and_periodic_texts(spark):
    x = "lorem ipsum dolor sit amet consectetur adipiscing elit sed"
    rows = [(1, None), (2, ""), (3, x[:49]), (4, x[:50]), (5, x), (5, x), (6, "a" * 300), (7, "b" + "a" * 120 + "c"), (7, x + x[::-1]),
            (None, x), (None, x + "!"), (8, "ab" * 100 + x + "ab" * 100), (9, "ab" * 60), (10, "é" * 80), (11, "x" + "é" * 80)]
    check(spark, rows)


def test_empty_table(spark):
    assert sd.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_pack_round_trip():
    keys, marks = np.array([5, -3, 2 ** 62]), np.array([1, 2 ** 31, 7], dtype=np.uint32)
    rows = {"kh": np.array([9, 2 ** 63 + 5, 3], dtype=np.uint64), "doc": np.array([2, 0, 2]), "at": np.array([7, 0, 2 ** 31]), "n": np.array([1, 255, 3])}
    got = sd.unpack(sd.pack(keys, marks, rows), ("kh", "doc", "at", "n"))
    assert got["key"].tolist() == [2 ** 62, 5, 2 ** 62] and got["mark"].tolist() == [7, 1, 7]
    assert got["kh"].tolist() == rows["kh"].tolist() and got["at"].tolist() == [7, 0, 2 ** 31] and got["n"].tolist() == [1, 255, 3]


def lines_with_neighbours(n, line, seed=5):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(60))
    return [(d, f"{word()} {line} {word()}") for d in range(n)]


LINE = "this line stands in every document, each time with other neighbours, so"


def test_frequent_line_with_other_neighbours(spark):
    rows = lines_with_neighbours(400, LINE)
    for how in ({}, {"chunk_bytes": 3000}, {"chunk_bytes": 3000, "bucket_bytes": 500, "fan": 4, "held_rows": 200}):
        check(spark, rows, **how)


def packed_rows(found, kind, names):
    """Rows of one kind by bucket, from record batches."""
    out = {}
    for batch in found:
        for b, k, v in zip(*(batch.column(c).to_pylist() for c in ("bucket", "kind", "value")), strict=True):
            if k == kind:
                out[b] = out.get(b, 0) + len(sd.unpack(v, names)["key"])
    return out


def text_batches(rows, size=500):
    return (pa.RecordBatch.from_arrays([pa.array([d for d, _ in rows[s:s + size]], pa.int64()), pa.array([t for _, t in rows[s:s + size]])], ["key", "text"])
            for s in range(0, len(rows), size))


def test_frequent_line_fills_no_bucket():
    rows = lines_with_neighbours(20000, LINE)
    n = 100
    first = list(sd._round_one(text_batches(rows), n, 50, 20, sd.PIECE, 1 << 20, sd.HOT))
    sizes = packed_rows(first, sd.ROWS, sd._BLOCK)
    assert max(sizes.values()) < 1.5 * np.median(list(sizes.values()))
    # Round 3: the strings of the line's blocks, dealt by their own hashes.
    blocks = [(d, 40, t.encode()[40:152]) for d, t in rows[:5000]]
    keys, marks = np.arange(5000), np.zeros(5000, dtype=np.uint32)
    parts = [sd._rows(sd._sifted_strings(keys, marks, sd.strings(blocks[s:s + 1000], 50), n, 50)) for s in range(0, 5000, 1000)]
    sizes = packed_rows(parts, sd.STRINGS, sd._STRING)
    assert len(sizes) == n and max(sizes.values()) < 1.5 * np.median(list(sizes.values()))


def test_rows_of_a_chunk_are_bounded():
    rnd = random.Random(3)
    rows = [(d, "".join(rnd.choice("abcdefghij ") for _ in range(1000))) for d in range(2000)]
    value = sum(b.num_rows for b in sd._round_one(text_batches(rows), sd.FAN, 50, 20, sd.PIECE, sd.CHUNK, sd.HOT))
    assert value <= 3 * sd.FAN


def test_equal_to_plain_prefix_doubling(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    gone = {}
    for d, p in doubling.starts(df.filter("doc_id % 3 > 0")).collect():
        gone.setdefault(d, set()).update(range(p, p + 50))
    for r in sd.remove_repeats(df.filter("doc_id % 3 > 0")).collect():
        spans = list(zip(r.spans[::2], r.spans[1::2], strict=True))
        assert {i for a, b in spans for i in range(a, b)} == gone.get(r.key, set())
