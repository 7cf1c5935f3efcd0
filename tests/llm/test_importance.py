import hashlib
import math
import random
import re
from collections import Counter
from zlib import crc32

from pyspark.sql import functions as F

from vigilo.llm import importance as im

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def feats(t, runs):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    return w, [crc32(" ".join(w[i:i + n]).encode()) % 10000 for n in range(1, runs + 1) for i in range(len(w) - n + 1)]


def brute(docs, target, runs=1, least=20, percent=10):
    s, t = Counter(), Counter()
    for _, x in docs:
        s.update(feats(x, runs)[1])
    for x in target:
        t.update(feats(x, runs)[1])
    S, T = sum(s.values()) + 10000, sum(t.values()) + 10000
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * S / ((s[b] + 1) * T)))
    rows = []
    for d, x in docs:
        w, f = feats(x, runs)
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        rows.append([d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w)])
    order = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for i, r in enumerate(order[:percent * len(order) // 100]):
        r[4] = i + 1
    return [tuple(r[:5]) for r in rows]


def check(spark, docs, target, **how):
    df = spark.createDataFrame([(*d, "a", 1) for d in docs], "doc_id long, text string, score string, rank int").repartition(3)
    t = spark.createDataFrame([(x, 1) for x in target], "text string, score int")
    key = lambda x: tuple(map(str, x))
    got = im.resample(df, t, **how).select("key", "n_features", "weight", "score", "rank").collect()
    args = {"runs": how.get("runs", 1), "least": how.get("least_words", 20), "percent": how.get("percent", 10)}
    want = brute(docs, target, **args)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    return want


def test_documents(spark):
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    target = [r[0] for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").select("text").collect()]
    want = check(spark, docs, target)
    assert sum(r[4] is not None for r in want) == sum(len(feats(t, 1)[0]) >= 20 for _, t in docs) // 10
    check(spark, docs, target, runs=2, percent=35)


def test_edges_ties_and_repeated_rows(spark):
    rnd = random.Random(2)
    docs = [(None, None), (None, "a b"), (1, ""), (2, "--"), (3, "Word " * 70000), *[(5, "same words " * 15)] * 6,
            *[(d, " ".join(rnd.choice("abcdef") for _ in range(rnd.randint(15, 60)))) for d in range(6, 40)]]
    check(spark, docs, ["a b c", None, ""])
    check(spark, docs, [], least_words=1, percent=50)
    check(spark, docs, ["a"], least_words=0, percent=100)
    check(spark, docs, ["a"], percent=0)
    check(spark, [], ["a"])


def test_cutoff_by_counts_alone(spark):
    rnd = random.Random(5)
    rows = [(rnd.choice((-10**12, 0, 0, 0, 7)), rnd.choice((1, 1, 2**62)), i) for i in range(400)]
    df = spark.createDataFrame(rows, "a long, b long, c long").cache()
    order = [-F.col("a"), F.col("b"), F.col("c")]
    ranks = sorted(rows, key=lambda r: (-r[0], r[1], r[2]))
    for want in (1, 2, 57, 200, 399, 400):
        assert sorted(map(tuple, df.filter(im.cutoff(df, order, want)).collect())) == sorted(ranks[:want])
