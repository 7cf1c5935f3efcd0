import random

import numpy as np
import pytest
import xxhash

from vigilo.llm import simhash


def brute_fp(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
             .replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    sh = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(ids, fps, bits=4):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    arr = np.array(fps, dtype=np.uint64)
    for i in range(len(arr)):
        for j in np.nonzero(np.bitwise_count(arr ^ arr[i]) <= bits)[0]:
            root[find(i)] = find(int(j))
    low = {}
    for i, d in enumerate(ids):
        r = find(i)
        low[r] = min(low.get(r, d), d)
    return [low[find(i)] for i in range(len(fps))]


def check(spark, rows, **how):
    df = spark.createDataFrame([(d, t, "x", "y", 1) for d, t in rows], "doc_id long, text string, key string, fp string, component int")
    got = sorted((r["key"], r["fp"] & (2 ** 64 - 1), r["component"]) for r in simhash.near_duplicates(df, **how).collect())
    fps = [brute_fp(t) for _, t in rows]
    want = sorted(zip([d for d, _ in rows], fps, brute_components([d for d, _ in rows], fps), strict=True))
    assert got == want


def test_documents_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    check(spark, [(r[0], r[1]) for r in docs])


def test_edge_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (4, "one"), (5, "One"), (6, "a b c"), (7, " x y z É w"),
            (8, "w " * 60000), (9, "W\x0bw\x0cw\rw")]
    check(spark, rows)


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_links_cover_all_pairs_and_hot_anchors(spark):
    rnd = random.Random(5)
    fps = set()
    for _ in range(150):
        x = rnd.getrandbits(64)
        fps.add(x)
        for _ in range(4):
            y = x
            for b in rnd.sample(range(64), rnd.randint(1, 6)):
                y ^= 1 << b
            fps.add(y)
    centre = rnd.getrandbits(64)  # a dense ball: many values at one anchor
    fps |= {centre ^ 1 << rnd.randrange(64) ^ 1 << rnd.randrange(64) ^ 1 << rnd.randrange(64) for _ in range(1500)}
    fps = sorted(fps)
    signed = np.array(fps, dtype=np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(x,) for x in signed], "fp long").repartition(4)
    for bits in (2, 4, 5):
        edges = simhash.links(df, bits, block_rows=200).collect()
        roots = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
        got = [roots.get(x, x) for x in signed]
        want = brute_components(signed, fps, bits)
        assert got == want


def test_thresholds_and_code():
    assert simhash.thresholds(4) == (1, 1, 0)
    for bits in range(0, 8):
        assert sum(t + 1 for t in simhash.thresholds(bits)) == bits + 1
    _, offsets, home = simhash.golay_offsets(3)
    assert offsets.shape[1] == 1 and len(set(home.tolist())) == 2048


def test_one_of_each_keeps_columns_of_any_name(spark):
    rows = [(1, "a b c d e", 5, 6, 7), (2, "a b c d e", 8, 9, 1), (2, "a b c d e", 8, 9, 1), (3, "x y z", 1, 2, 3)]
    for names in ("kept_key long, kept_mark long, kept_rows int", "__key long, __mark long, key int", "fp long, root long, component int"):
        df = spark.createDataFrame(rows, f"doc_id long, text string, {names}")
        assert sorted(map(tuple, simhash.one_of_each(df).collect())) == [rows[0], rows[3]]


def test_keys_are_integers_or_refused(spark):
    small = spark.createDataFrame([(1, "a b"), (2, "a b")], "doc_id int, text string")
    assert {r["component"] for r in simhash.near_duplicates(small).collect()} == {1}
    with pytest.raises(TypeError, match="has to be an integer"):
        simhash.near_duplicates(spark.createDataFrame([("x", "a b")], "doc_id string, text string"))
