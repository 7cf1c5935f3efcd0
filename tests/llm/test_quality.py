import random
import re

from vigilo.llm import quality as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def spans(w, least):
    """Words in a run of at least ``least`` words that stands twice, and the longest repeat."""
    n, hit, best = len(w), set(), 0
    for i in range(n):
        for j in range(i + 1, n):
            k = 0
            while j + k < n and w[i + k] == w[j + k]:
                k += 1
            if k >= least:
                hit |= {*range(i, i + k), *range(j, j + k)}
                best = max(best, k)
    return len(hit), best


def brute(doc, text):
    w = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    rep, (cov, best) = spans(w, 8)[0], spans(w, q.MIN_WORDS)
    failed = len(w) < 20 or 100 * rep > 30 * len(w)
    kept = not failed and cov <= q.MAX_COVERED * len(w) and best <= q.MAX_REPEAT
    return (doc, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, rep, failed, kept, best)


def check(spark, rows, **how):
    df = spark.createDataFrame([(*r, "a", 1) for r in rows], "doc_id long, text string, key string, kept int")
    got = q.judge(df, **how).select("key", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "longest_repeat").collect()
    key = lambda x: tuple(map(str, x))
    assert sorted(map(tuple, got), key=key) == sorted((brute(*r) for r in rows), key=key)


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    check(spark, [(d, t) for d, t in docs if len((t or "").split()) < 1500])


def test_random_repeats(spark):
    rnd = random.Random(6)
    rows = []
    for d in range(150):
        bits = [" ".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 30))) for _ in range(3)]
        rows.append((d % 100, rnd.choice((" ", "\n", "\x0b")).join(rnd.choice([*bits, rnd.choice("xyz") * 3]) for _ in range(rnd.randint(0, 9)))))
    check(spark, rows)


def test_edges(spark):
    check(spark, [(1, None), (2, ""), (3, " \n\t "), (4, "a" * 5000), (5, "a " * 150), (5, "a " * 150), (6, "a b c d"),
                  (None, "#*$%&|<> # x\nx\nx\n \n "), (7, " ".join(map(str, range(300))))])


def test_long_text_and_empty_table(spark):
    long = " ".join(map(str, range(60000)))
    df = spark.createDataFrame([(1, long), (2, long + " " + long), (3, "w " * 100000)], "doc_id long, text string")
    got = {r["key"]: (r["n_words"], r["n_repeat_words"], r["longest_repeat"], r["kept"]) for r in q.judge(df).collect()}
    assert got == {1: (60000, 0, 0, True), 2: (120000, 120000, 60000, False), 3: (100000, 100000, 99999, False)}
    assert q.judge(df.filter("false")).count() == 0


def test_judged_rows_follow_the_quality_labels(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r[0]: r[1] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in q.op2(spark, sf).collect() if not r["base_failed"]]
    assert all(r["kept"] for r in rows if labels.get(r["doc_id"]) == 1) and not all(r["kept"] for r in rows)
