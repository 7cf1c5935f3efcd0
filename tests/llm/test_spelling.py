import random
import re
from collections import Counter
from zlib import crc32

from vigilo.llm import spelling as sp

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def fold(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def counted(docs):
    n = Counter()
    for d, t in docs:
        for r in RUN.findall(fold(t)):
            h = crc32(f"{'' if d is None else d}:{r}".encode())
            if h % 31 == 0:
                r = r[:h % len(r)] + r[h % len(r) + 1:]
            n[r] += 1
    return {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}


def brute(n):
    near = {w: [o for o in n if one_edit(w, o)] for w in n}
    best = {w: min(o, key=lambda x: (-n[x], x)) for w, o in near.items() if o}
    form = {w: best[w] if w in best and n[best[w]] >= 10 * n[w] else None for w in n}
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


def check(spark, docs, **how):
    df = spark.createDataFrame([(*d, "a", 1) for d in docs], "doc_id long, text string, word string, n int")
    key = lambda x: tuple(map(str, x))
    want = sorted(brute(counted(docs)), key=key)
    assert sorted(map(tuple, sp.variants(df, **how).collect()), key=key) == want
    return want


def test_random_words(spark):
    rnd = random.Random(3)
    base = ["".join(rnd.choice("abé") for _ in range(rnd.randint(6, 9))) for _ in range(120)]
    docs = []
    for d in range(60):
        out = []
        for w in base[:rnd.randint(1, 120)]:
            for _ in range(rnd.choice((0, 1, 1, 2, 12))):
                at = rnd.randrange(len(w))
                out.append(rnd.choice((w, w, w[:at] + w[at + 1:], w[:at] + rnd.choice("abÉ") + w[at:], w[:at] + "b" + w[at + 1:])))
        docs.append((d % 50, rnd.choice((" ", ", ", "1")).join(out)))
    want = check(spark, docs)
    assert sum(x[4] for x in want) > 500
    assert check(spark, docs, block_words=3) == want  # every larger group in a grid


def test_chains_of_forms(spark):
    text = lambda w, n: " ".join([w] * n)
    docs = [(7, text("abcdefgh", 2000)), (8, text("abcdefgx", 150)), (9, text("abcdefyx", 12)), (9, text("aabcdefyx", 2)), (10, text("abcdefgw", 150))]
    want = {x[0]: x for x in check(spark, docs)}
    assert max(len({want[w][2] for w in want}), 1) >= 1 and any(x[1] and want[x[1]][1] for x in want.values())


def test_equal_counts_of_words_that_differ_in_length(spark):
    # In the group of the middle piece the middles are "ab" and "abx": a prefix comes
    # first, but with the tail behind them "..abxzzz" stands before "..abzzz".
    text = lambda w, n: " ".join([w] * n)
    docs = [(None, text("mmaxzzz", 2)), (None, text("mmabzzz", 40)), (None, text("mmabxzzz", 40))]
    want = {x[0]: x for x in check(spark, docs)}
    assert want["mmaxzzz"][1] == "mmabxzzz" and want["mmaxzzz"][4] == 2


def test_edges(spark):
    check(spark, [(1, None), (2, ""), (3, "1 2 3"), (None, "Zeppelin zeppelin “zeppelin” zeppelîn"), (None, "Zeppelin zeppelin “zeppelin” zeppelîn"),
                  (4, "straße straßen STRASSEN ÀÉÎÕÜÿ×÷ ÀÉÎÕÜÿ×÷ naïveté naïvete 日本語zeppelin日本語"), (5, "aaaaaaa aaaaaaaa " * 3),
                  (6, "wordword " * 60000 + "wordwrd " * 2)])


def test_empty_table(spark):
    assert sp.variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_letter_runs_are_those_of_the_expression():
    rnd = random.Random(1)
    for _ in range(300):
        t = "".join(rnd.choice("aZ é×ÿĀ¿À–日😀¿Ā.") for _ in range(40))
        assert [r.decode() for r in sp.letter_runs(t)] == RUN.findall(fold(t))


def test_index_finds_one_edit_and_no_more():
    rnd = random.Random(4)
    mids = sorted({"".join(rnd.choice("ab") for _ in range(rnd.choice((3, 4)))) for _ in range(40)})
    index = sp.Index(mids, 3)
    for q in (m for m in mids if len(m) == 3):
        assert {mids[i] for i in index.near(q, True)} == {m for m in mids if one_edit(q, m)}
