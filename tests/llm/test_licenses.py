import random
import re

from vigilo.llm import licenses as li

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def fold(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, templates, phrases, threshold):
    made = li.prepared(templates, threshold)
    out = []
    for d, t in docs:
        w = fold(t)
        places, base = [], set()
        for p, label in phrases:
            p = fold(p)
            at = [i for i in range(len(w) - len(p) + 1) if w[i:i + len(p)] == p]
            places += at
            base |= {label} if at else set()
        pairs = []
        for x in made:
            size = 1 << x["k"]
            for b in range(0, len(w) // size + 1):
                held = len(set(w[b * size:(b + 2) * size]) & set(x["words"]))
                if held >= threshold * len(x["words"]) - 1e-9:
                    pairs.append((b * size, (b + 2) * size, x, held / len(x["words"])))
        own = [p for p in pairs if not any(o[0] < p[1] and p[0] < o[1] and set(p[2]["words"]) < set(o[2]["words"]) for o in pairs)]
        score = 1.0 if places else max((p[3] for p in own), default=0.0)
        out.append((d, len(w), len(places), min(places, default=None), max(places, default=None), tuple(sorted(base)),
                    tuple(sorted(base | {p[2]["label"] for p in own})), round(score, 9)))
    return out


def check(spark, docs, templates=li.TEMPLATES, phrases=li.PHRASES, threshold=li.THRESHOLD):
    df = spark.createDataFrame([(*d, "a", 1) for d in docs], "doc_id long, text string, labels string, share int").repartition(3)
    got = [(*r[:5], tuple(r[5]), tuple(r[6]), round(r[7], 9)) for r in li.scan(df, templates=templates, phrases=phrases, threshold=threshold).collect()]
    key = lambda x: tuple(map(str, x))
    want = brute(docs, templates, phrases, threshold)
    assert sorted(got, key=key) == sorted(want, key=key)
    return want


def test_documents(spark):
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    assert sum(bool(r[6]) for r in check(spark, [(d, t) for d, t in docs if len(t or "") < 20000])) > 3


def test_random_blocks_and_templates(spark):
    rnd = random.Random(8)
    templates = [(f"t{i % 5}", " ".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(1, 12)))) for i in range(12)]
    docs = [(d % 50, " ".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(0, 60)))) for d in range(80)]
    for threshold in (0.5, 0.75, 1.0):
        assert sum(len(r[6]) for r in check(spark, docs, templates, [("a b", "x"), ("a", "x"), ("c c c", "y")], threshold)) > 50


def test_notices(spark):
    rows = {1: "Licensed under CC BY-NC 4.0.", 2: "licensed under cc by 4.0", 3: "All rights\n reserved; Released under the\nMIT License",
            4: "the license of this work is not mit's", 5: "GNU Lesser General Public License, version 3",
            6: li.TEMPLATES[1][1].replace("modification", "changes").replace(" and ", "\n and "), 7: "cc by cc by"}
    got = {r[0]: r for r in check(spark, list(rows.items()))}
    assert {d: got[d][6] for d in got} == {1: ("cc-by", "cc-by-nc-4.0"), 2: ("cc-by", "cc-by-4.0"), 3: ("mit", "reserved"), 4: (),
                                           5: ("gpl", "lgpl-3.0"), 6: ("bsd",), 7: ("cc-by",)}
    assert got[7][2:5] == (2, 0, 2) and 0.9 <= got[6][7] < 1


def test_edges(spark):
    check(spark, [(None, None), (None, "All rights reserved"), (1, ""), (2, "--"), (3, "x " * 60000 + "licensed under the mit license"),
                  *[(4, "released under the mit license")] * 3, (4, "cc by"), (5, "ÄÖÜ all rights reserved 😀 all rights reserved")])


def test_empty_tables_and_templates(spark):
    check(spark, [])
    check(spark, [(1, "cc by 4.0")], [], [])
    check(spark, [(1, "cc by 4.0")], [("a", "cc")], [])
    try:
        li.prepared([("none", "--")])
    except ValueError:
        return
    raise AssertionError("a template without words is refused")
