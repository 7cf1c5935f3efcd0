"""Personal data: expressions propose, checksums confirm, context adjusts
(operator 7).  DataFrame functions only.

Every kind has an expression that proposes spans, leftmost and without
overlap within the kind; a check (digit count, Luhn, mod 97, parts of an
address) that drops what fails, without a second try; a score; and words that
raise the score when they stand within ``NEAR`` characters.  A span is kept
when its score reaches ``KEEP``.  The base kinds (email, ip, card, phone) start
at that score, so context only ranks them; ``iban`` has as many characters as
its country gives it, whatever follows, and is confirmed by mod 97;
``pan`` (12 to 15 digits passing Luhn) and ``ssn`` need a context word as well.

The expressions are written without nested backtracking: possessive repeats,
and a start only where a run of its characters begins or the match before
ended, so a text is read in linear time.  Texts without a candidate stop after
one scan per kind.  Positions are running sums of piece lengths, in blocks of
``BLOCK`` matches so that many matches in one long text stay cheap.  Nothing
is shuffled.

Null texts are empty: no spans.  Positions count code points, end exclusive.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilo.llm.common import documents, pick

NEAR, KEEP, BLOCK = 40, 0.5, 256
SPANS = "array<struct<kind:string,start:bigint,end:bigint,score:double>>"


def digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(s: Column) -> Column:
    """True when the digits of a short string pass Luhn's check."""
    each = F.transform(F.split(F.reverse(digits(s)), ""), lambda c, i: _luhn_digit(c.cast("int"), i))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def _luhn_digit(d: Column, i: Column) -> Column:
    twice = 2 * d
    return F.when(i % 2 == 0, d).when(twice > 9, twice - 9).otherwise(twice)


def mod97(s: Column) -> Column:
    """True when an account number (country, two check digits, the rest) passes mod 97."""
    plain = F.regexp_replace(s, " ", "")
    turned = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))
    value = lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.split(turned, ""), F.lit(0), lambda a, c: (F.when(c.rlike("[0-9]"), a * 10).otherwise(a * 100) + value(c)) % 97) == 1


def n_digits(s: Column, low: int, high: int) -> Column:
    return F.length(digits(s)).between(low, high)


@dataclass(frozen=True)
class Kind:
    name: str
    hint: str                       # a cheap test that a text may hold this kind
    pattern: str
    check: Callable[[Column], Column]
    score: float
    context: str


_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
_LOCAL = "[A-Za-z0-9._%+-]"
#: Length of an IBAN by country: of digits after the country code, and with letters.
IBAN_DIGITS = {15: "NO", 16: "BE", 18: "DK FI FO GL SD", 19: "SI", 20: "AT BA EE LT MN XK", 21: "HR", 22: "CR DE ME RS VA",
               23: "AE IL TL", 24: "CZ ES SE SK TN", 25: "LY PT ST", 26: "IS", 27: "BI MR", 28: "HU PL", 29: "EG"}
IBAN_MIXED = {18: "FK NL", 19: "MK", 20: "KZ LU", 21: "CH LI LV", 22: "BG BH GB GE IE", 23: "GI IQ OM SO", 24: "AD MD PK RO SA VG",
              25: "AO CV GW MZ", 26: "DZ IR TR", 27: "CF CG CM DJ FR GA GQ GR IT KM MC MG SM TD",
              28: "AL AZ BF BJ BY CI CY DO GT HN LB MA ML NE NI SN SV TG", 29: "BR PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU"}


def _iban() -> str:
    each = [rf"(?:{codes.replace(' ', '|')})[0-9]{{2}}(?: ?+{char}){{{size - 4}}}"
            for table, char in ((IBAN_DIGITS, "[0-9]"), (IBAN_MIXED, "[A-Z0-9]")) for size, codes in table.items()]
    return rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:{'|'.join(each)})(?![A-Za-z0-9])"


KINDS = (
    Kind("email", "@", rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
         lambda m: F.lit(True), 0.9, "mail|contact|courriel|correo"),
    Kind("ip", r"[0-9]\.[0-9]", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
         lambda m: m.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"), 0.7, "address|adresse|server|host|login"),
    Kind("card", "[0-9][ -]?[0-9]", "[0-9](?:[ -]?+[0-9])++",
         lambda m: F.when(n_digits(m, 16, 19), luhn(m)).otherwise(False), 0.8, "card|visa|karte|carte|tarjeta"),
    Kind("phone", r"\+[0-9]", r"\+[0-9][ ().0-9-]+[0-9]",
         lambda m: n_digits(m, 8, 15), 0.7, "phone|call|tel|mobil|anruf"),
    Kind("iban", "[A-Z]{2}[0-9]{2}", _iban(),
         lambda m: mod97(m), 0.6, "iban|bank|account|konto|compte|cuenta"),
    Kind("pan", "[0-9][ -]?[0-9]", "[0-9](?:[ -]?+[0-9])++",
         lambda m: F.when(n_digits(m, 12, 15), luhn(m)).otherwise(False), 0.3, "card|visa|amex|maestro|karte|carte|tarjeta"),
    Kind("ssn", "[0-9]-[0-9]", "(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
         lambda m: ~m.rlike("^(?:000|666|9)|-00-|-0000$"), 0.3, "ssn|social|security number"),
)
BASE = ("email", "ip", "card", "phone")
CONTEXT_BONUS = 0.2


def _matches(kind: Kind, text: Column) -> Column:
    return F.when(text.rlike(kind.hint), F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))) \
        .otherwise(F.array().cast("array<string>"))


def _gaps(kind: Kind, text: Column) -> Column:
    """What stands before, between and after the matches: one more than those."""
    return F.split(text, kind.pattern, -1)


def _score(kind: Kind, before: Column, after: Column) -> Column:
    near = F.lower(F.concat_ws(" ", F.right(before, F.lit(NEAR)), F.left(after, F.lit(NEAR)))).rlike(kind.context)
    return F.lit(kind.score) + F.when(near, CONTEXT_BONUS).otherwise(0.0)


def _kept(kind: Kind, match: Column, gaps: Column, i: Column) -> Column:
    return F.when(kind.check(match), _score(kind, F.get(gaps, i), F.get(gaps, i + 1)) >= KEEP).otherwise(False)


def _judged(kind: Kind, found: Column, gaps: Column) -> Column:
    """Lengths, verdict and score of each match."""
    return F.transform(found, lambda m, i: F.struct(
        F.length(F.get(gaps, i)).cast("long").alias("lead"), F.length(m).cast("long").alias("size"),
        _kept(kind, m, gaps, i).alias("kept"), _score(kind, F.get(gaps, i), F.get(gaps, i + 1)).alias("score")))


def _blocks(each: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(each) - 1) / BLOCK).cast("int")),
                       lambda b: F.slice(each, b * BLOCK + 1, BLOCK))


def _starts(blocks: Column) -> Column:
    """Where each block begins: the lengths of those before it."""
    size = lambda b: F.aggregate(b, F.lit(0).cast("long"), lambda a, x: a + x.lead + x.size)
    return F.aggregate(blocks, F.array(F.lit(0).cast("long")), lambda a, b: F.array_append(a, F.element_at(a, -1) + size(b)))


def _placed(kind: Kind, blocks: Column, starts: Column) -> Column:
    """Kept spans of one kind: each block counts on from where it begins."""
    shape = f"struct<at:bigint,out:{SPANS}>"

    def step(acc: Column, x: Column) -> Column:
        start, end = acc.at + x.lead, acc.at + x.lead + x.size
        span = F.array(F.struct(F.lit(kind.name).alias("kind"), start.alias("start"), end.alias("end"), x.score.alias("score"))).cast(SPANS)
        return F.struct(end.alias("at"), F.when(x.kept, F.concat(acc.out, span)).otherwise(acc.out).alias("out")).cast(shape)

    def block(b: Column, i: Column) -> Column:
        first = F.struct(F.get(starts, i).alias("at"), F.array().cast(SPANS).alias("out")).cast(shape)
        return F.aggregate(b, first, step, lambda acc: acc.out)

    return F.flatten(F.transform(blocks, block))


def find(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, spans): every kept span of every row, by kind and then start."""
    rows = pick(df, key, text).withColumn("text", F.coalesce("text", F.lit("")))
    rows = rows.withColumns({f"m_{k.name}": _matches(k, F.col("text")) for k in KINDS})
    # Only texts with a match that passes its check are cut into pieces.
    rows = rows.withColumns({f"g_{k.name}": F.when(F.exists(f"m_{k.name}", k.check), _gaps(k, F.col("text"))) for k in KINDS})
    # One projection for each step: what a lambda uses again and again is a column.
    for made, of, fn in (("e", ("m", "g"), None), ("b", ("e",), _blocks), ("s", ("b",), _starts), ("p", ("b", "s"), None)):
        new = {}
        for k in KINDS:
            args = [F.col(f"{x}_{k.name}") for x in of]
            value = fn(*args) if fn else (_judged if made == "e" else _placed)(k, *args)
            new[f"{made}_{k.name}"] = F.when(F.col(f"g_{k.name}").isNotNull(), value)
        rows = rows.withColumns(new)
    none = F.array().cast(SPANS)
    parts = [F.coalesce(F.col(f"p_{k.name}"), none) for k in KINDS]
    return rows.select("key", F.concat(*parts).alias("spans"))


def mask(text: Column, kind: Kind, found: Column, gaps: Column) -> Column:
    """``text`` with the kept spans of one kind replaced by its name in brackets."""
    pieces = F.transform(found, lambda m, i: F.concat(
        F.get(gaps, i), F.when(_kept(kind, m, gaps, i), F.lit(f"[{kind.name.upper()}]")).otherwise(m)))
    return F.when(gaps.isNull(), text).otherwise(F.concat(F.array_join(pieces, ""), F.element_at(gaps, -1)))


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with personal data in its text column masked, one kind after the
    other; all other columns stay.  Null texts stay null."""
    cols = df.columns
    name = lambda n: next(x for x in (n + "_" * i for i in range(1, 99)) if x not in cols)
    m, g = name("found"), name("gaps")
    for k in KINDS:
        df = df.withColumn(m, _matches(k, F.col(f"`{text}`")))
        df = df.withColumn(g, F.when(F.exists(m, k.check), _gaps(k, F.col(f"`{text}`"))))
        df = df.withColumn(text, mask(F.col(f"`{text}`"), k, F.col(m), F.col(g))).select(*[F.col(f"`{c}`") for c in cols])
    return df


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns of ``find``'s result."""
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
    of = lambda kind: F.filter("spans", lambda s: s.kind == kind)
    n = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE]
    base = F.filter("spans", lambda s: s.kind.isin(*BASE))
    return found.select(F.col("key").alias("doc_id"), *n, F.sha2(line(base).cast("binary"), 256).alias("base_sha256"),
                        line(F.col("spans")).alias("spans"))


def op7(spark, sf_dir: str) -> DataFrame:
    """``op7_pii``: personal data of every document."""
    return digest(find(documents(spark, sf_dir)))
