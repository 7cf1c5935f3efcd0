import hashlib
import random
import re

from vigilo.llm import decontaminate as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def fold(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def brute(docs, items, size=10):
    wins = []
    for i, t in items:
        w = WORD.findall(fold(t))
        if w:
            wins += [(i, w[k:k + size]) for k in range(max(1, len(w) - size + 1))]
    out = []
    for d, t in docs:
        w = WORD.findall(fold(t))
        hit, of = set(), set()
        for i, win in wins:
            for k in range(len(w) - len(win) + 1):
                if w[k:k + len(win)] == win:
                    hit |= set(range(k, k + len(win)))
                    of |= {str(i)} if i is not None else set()
        out.append((d, len(w), len(hit), len(of), hashlib.sha256(",".join(sorted(of)).encode()).hexdigest(), bool(hit)))
    return out


def check(spark, docs, items, **how):
    d = spark.createDataFrame([(*x, "a", ["b"]) for x in docs], "doc_id long, text string, key string, items array<string>")
    b = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, doc_id int")
    found = dc.decontaminate(d, b, **how)
    texts = dict(docs)
    for r in found.collect():
        for s, e, ws, we in zip(r["spans"][::2], r["spans"][1::2], r["hit_words"][::2], r["hit_words"][1::2], strict=True):
            assert WORD.findall(fold(texts[r["key"]]))[ws:we] == WORD.findall(fold(texts[r["key"]][s:e]))
    key = lambda x: tuple(map(str, x))
    assert sorted(map(tuple, dc.digest(found).collect()), key=key) == sorted(brute(docs, items), key=key)


def test_documents(spark):
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").select("item_id", "text").collect()]
    check(spark, docs, items)


def test_edges_and_parts(spark):
    item = "Zero one two three four five six seven eight nine ten ELEVEN"
    docs = [(1, None), (2, ""), (3, "x " + item.upper() + ", y"), (4, "zero-one two\nthree four five six seven eight nine!"),
            (5, "zero one two three four five six seven eight"), (6, "Short Á item; short Á item short á item"),
            (7, "aa aa aa aa aa aa aa aa aa aa aa aa"), (8, "word " * 50000 + item), (8, "word " * 50000 + item)]
    items = [(1, item), (2, None), (3, "--"), (4, "short Á item"), (5, "aa " * 10), (5, "aa " * 10), (None, "word " * 11), (12, item)]
    check(spark, docs, items)
    check(spark, docs, items, automaton_bytes=40)


def test_empty_tables(spark):
    check(spark, [(1, "a b")], [])
    check(spark, [], [(1, "a b")])


def test_nodes_of_one_automaton(spark):
    """A part of ``AUTOMATON_BYTES`` stays within ten nodes a byte."""
    rng = random.Random(3)
    text = " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(12000))
    automaton = dc._automaton({w.decode(): [] for w in dc.windows(text)})
    assert automaton.get_stats()["nodes_count"] <= 10 * len(text)
    assert 10 * dc.AUTOMATON_BYTES * 50 < 300e6
