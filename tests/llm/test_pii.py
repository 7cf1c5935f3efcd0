import hashlib
import random
import re

from vigilo.llm import pii

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def passes(kind, s):
    d = re.sub("[^0-9]", "", s)
    return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in s.split(".")),
            "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]


def brute(doc, text):
    spans = [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if passes(k, m[0])]
    n = [sum(s[0] == k for s in spans) for k in PATTERNS]
    return (doc, *n, hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest())


def check(spark, rows):
    df = spark.createDataFrame([(*r, "a", [1]) for r in rows], "doc_id long, text string, key string, spans array<int>")
    got = pii.digest(pii.find(df)).collect()
    key = lambda x: tuple(map(str, x))
    assert sorted((tuple(r)[:6] for r in got), key=key) == sorted((brute(*r) for r in rows), key=key)
    return {r["doc_id"]: r["spans"] for r in got}


def test_documents(spark):
    check(spark, [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()])


def test_random_texts(spark):
    rnd = random.Random(8)
    bits = ["a@b.c", "x_@d.e.f", "@", ".", "+", "-", " ", "1", "255", "256", "4111 1111 1111 1111", "12.3.4.5", "+1 (412) 555-1832",
            "é", "😀", "\n", "a", "Z9", "%", "(", ")", "00", "5500-0000-0000-0004", "\\", "x"]
    check(spark, [(i, "".join(rnd.choice(bits) for _ in range(rnd.randrange(60)))) for i in range(1500)])


def test_edges_and_long_texts(spark):
    rows = [(1, None), (2, ""), (3, "mail a@b.co, a@b.co"), (3, "mail a@b.co, a@b.co"), (4, "9" * 5000), (5, "a." * 2500),
            (6, "1.2.3.4 " * 3000), (7, "a@b" + ".c" * 2500), (8, "😀 +1 412 555 1832" * 300), (9, "+" * 5000 + "1" + " " * 5000), (None, "x@y.z")]
    check(spark, rows)


def test_very_long_texts_are_read_in_linear_time(spark):
    """Texts on which a careless expression takes the square of their length."""
    rows = [(1, "9" * 1000000), (2, "a." * 500000 + "@"), (3, "a@b" + ".c" * 400000), (4, "+1" + " " * 500000), (5, "x@y.z " * 60000),
            (6, "1." * 500000), (7, "AB12" + "A" * 500000)]
    got = {r["doc_id"]: tuple(r)[1:5] for r in pii.digest(pii.find(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert got == {1: (0, 0, 0, 0), 2: (0, 0, 0, 0), 3: (1, 0, 0, 0), 4: (0, 0, 0, 0), 5: (60000, 0, 0, 0), 6: (0, 125000, 0, 0), 7: (0, 0, 0, 0)}


def test_added_kinds(spark):
    got = check(spark, [(1, "Bank: DE89 3704 0044 0532 0130 00."), (2, "DE88 3704 0044 0532 0130 00"), (3, "amex 3782 822463 10005 ok"),
                        (4, "number 3782 822463 10005 ok"), (5, "my SSN is 123-45-6789"), (6, "part 123-45-6789"), (7, "GB82WEST12345698765432")])
    assert got[1] == "iban:6:33" and got[2] == "" and got[3] == "pan:5:22" and got[4] == ""
    assert got[5] == "ssn:10:21" and got[6] == "" and got[7] == "iban:0:22"


def test_redact(spark):
    rows = [(1, "to a@b.co or 4111 1111 1111 1111, 1.2.3.4 / 1.2.3.400, é +1 (412) 555-1832!", "k"), (2, None, "k"), (3, "", "k")]
    out = {r[0]: (r[1], r[2]) for r in pii.redact(spark.createDataFrame(rows, "doc_id long, text string, found_ string")).collect()}
    assert out == {1: ("to [EMAIL] or [CARD], [IP] / 1.2.3.400, é [PHONE]!", "k"), 2: (None, "k"), 3: ("", "k")}


def test_empty_table(spark):
    assert pii.find(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_iban_before_other_words(spark):
    """What follows an IBAN, or looks like the start of one before it, is not its part."""
    ibans = ["DE89 3704 0044 0532 0130 00", "DE89370400440532013000", "GB82 WEST 1234 5698 7654 32", "NO93 8601 1117 947",
             "FR14 2004 1010 0505 0001 3M02 606", "MT84MALT011000012345MTLCAST001S", "BE68 5390 0754 7034", "NL91ABNA0417164300"]
    after = [" BIC COBADEFF", " EUR", " 2024", " 12 EUR", ", EUR", " GB82 WEST 1234 5698 7654 33", "."]
    before = ["IBAN ", "BE12 IBAN ", "AB12 "]
    texts = [(b, i, a) for b in before for i in ibans for a in after]
    df = spark.createDataFrame([(n, "".join(t)) for n, t in enumerate(texts)], "doc_id long, text string")
    got = {r["key"]: [(s["start"], s["end"]) for s in r["spans"] if s["kind"] == "iban"] for r in pii.find(df).collect()}
    assert got == {n: [(len(b), len(b) + len(i))] for n, (b, i, _) in enumerate(texts)}
    two = [(1, f"{ibans[2]} {ibans[4]} BIC"), (2, "DE89 3704 0044 0532 0130 0"), (3, "DE88370400440532013000 EUR"), (4, "DE893704004405320130001")]
    out = dict(map(tuple, pii.redact(spark.createDataFrame(two, "doc_id long, text string")).collect()))
    assert out[1] == "[IBAN] [IBAN] BIC" and all("[IBAN]" not in out[n] for n in (2, 3, 4))
    codes = [c for table in (pii.IBAN_DIGITS, pii.IBAN_MIXED) for x in table.values() for c in x.split()]
    assert len(codes) == len(set(codes))
