"""Benchmark decontamination by one Aho-Corasick automaton (operator 8).

Test items and documents are normalised alike: A-Z lower-cased, everything
below U+0080 that is no letter or digit separates words, words joined by one
space.  Every window of ``window`` consecutive item words (a shorter item is
one window) is a pattern, bounded by spaces on both sides, so a match is a run
of whole words.  Each document's normalised text is scanned once; only where
something matched are the offsets mapped back to words and to the characters
of the original text.

Scale: a document is scanned where it was read, so its text is never shuffled
and a hot source costs nothing.  The test set is the side that is sent to all
tasks; its size is measured first.  Up to ``automaton_bytes`` of normalised
test text make one automaton: ten nodes or less for each of their bytes, some
fifty bytes each, so 250 MB in a worker at most.  A larger test set is dealt by
item into parts of that size, one pass over the documents for each; what a pass
found is written before the next, so a worker never holds two automata.

Null or empty texts have no words; a very long text is scanned whole where it
lies.  Empty tables give empty results, an empty test set no hits; other columns
are not read (``clean`` keeps them).  An item without words matches nothing; an
item whose id is null marks words but is listed nowhere.  Repeated items and
rows count as they come (a repeated item id is listed once).
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilo.llm.common import by_batch_of, documents, pick, spare, with_columns, written
from vigilo.sources.tables import read_table

WINDOW = 10
AUTOMATON_BYTES = 1 << 19
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_WORD_ANY_CASE = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    """Normalised words as UTF-8 bytes."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def windows(text: str | None, size: int = WINDOW) -> list[bytes]:
    w = words(text)
    if not w:
        return []
    return [b" ".join(w[i:i + size]) for i in range(max(1, len(w) - size + 1))]


def _automaton(patterns: dict[str, list[str]]):
    import ahocorasick
    found = ahocorasick.Automaton()
    for line, items in patterns.items():
        found.add_word(f" {line} ", (line.count(" ") + 1, items))
    if patterns:
        found.make_automaton()
    return found


def scan(text: str | None, automaton) -> tuple[list[tuple[int, int]], set[str]]:
    """(hit runs of word places [start, end), items found)."""
    w = words(text)
    if not w or not len(automaton):
        return [], set()
    line = b" ".join([b"", *w, b""]).decode("utf-8", "surrogatepass")
    runs, items = [], set()
    place = seen = 0
    for at, (n, of) in automaton.iter(line):  # ascending ends: the blanks before an end count the words up to it
        place += line.count(" ", seen, at)
        seen = at
        runs.append((place - n, place))
        items.update(of)
    return united(runs), items


def united(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(runs):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def char_spans(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Code-point spans of word runs in the original text."""
    at = [m.span() for m in _WORD_ANY_CASE.finditer(text)]
    return [(at[s][0], at[e - 1][1]) for s, e in runs]


def _patterns(bench: DataFrame, size: int, parts: int, part: int) -> dict[str, list[str]]:
    """Windows of one part of the items: at most ``automaton_bytes`` of text by
    the caller's choice of ``parts``."""
    found: dict[str, set[str]] = {}
    for key, text in bench.filter(F.pmod(F.xxhash64("key", "text"), F.lit(parts)) == part).distinct().toLocalIterator():
        for line in windows(text, size):
            found.setdefault(line.decode("utf-8", "surrogatepass"), set()).update([] if key is None else [key])
    return {line: sorted(items) for line, items in found.items()}


def _tests(bench: DataFrame, item: str, item_text: str, automaton_bytes: int) -> tuple[DataFrame, int]:
    """Items under fixed names and the number of automata they need."""
    tests = bench.select(F.col(f"`{item}`").cast("string").alias("key"), F.col(f"`{item_text}`").alias("text"))
    held = tests.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return tests, max(1, -(-held // automaton_bytes))


def decontaminate(docs: DataFrame, bench: DataFrame, key: str = "doc_id", text: str = "text",
                  item: str = "item_id", item_text: str = "text", window: int = WINDOW,
                  automaton_bytes: int = AUTOMATON_BYTES) -> DataFrame:
    """(key, n_words, hit_words, items, spans): per input row the word count,
    the places of hit words as [start, end) pairs in ``hit_words``, the ids of
    the items found and the hit spans in code points of the original text."""
    spark = docs.sparkSession
    rows = pick(docs, key, text)
    tests, parts = _tests(bench, item, item_text, automaton_bytes)
    state = rows.withColumns({"runs": F.array().cast("array<int>"), "items": F.array().cast("array<string>")})
    for part in range(parts):
        state = _scanned(state, spark.sparkContext.broadcast(_patterns(tests, window, parts, part)))
        state = written(state, "test-hits") if part < parts - 1 else state

    def finish(keys: list, texts: list, runs: list, items: list) -> dict[str, list]:
        pairs = [list(zip(r[::2], r[1::2], strict=True)) for r in runs]
        return {"key": keys, "n_words": [len(words(t)) for t in texts], "hit_words": runs, "items": items,
                "spans": [[x for s in char_spans(t, p) for x in s] if p else [] for t, p in zip(texts, pairs, strict=True)]}

    return by_batch_of(state, finish, "key long, n_words long, hit_words array<int>, items array<string>, spans array<int>")


def _scanned(state: DataFrame, sent) -> DataFrame:
    """The hits so far united with those of one automaton."""
    made = []

    def run(keys: list, texts: list, runs: list, items: list) -> dict[str, list]:
        if not made:
            made.append(_automaton(sent.value))
        for i, t in enumerate(texts):
            more, of = scan(t, made[0])
            if more:
                runs[i] = [x for r in united([*zip(runs[i][::2], runs[i][1::2], strict=True), *more]) for x in r]
                items[i] = sorted({*items[i], *of})
        return {"key": keys, "text": texts, "runs": runs, "items": items}

    return by_batch_of(state, run, "key long, text string, runs array<int>, items array<string>")


def clean(docs: DataFrame, bench: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
          window: int = WINDOW, automaton_bytes: int = AUTOMATON_BYTES) -> DataFrame:
    """The rows of ``docs`` without any hit word, all columns as they are."""
    tests, parts = _tests(bench, item, item_text, automaton_bytes)
    for part in range(parts):
        docs = _unhit(docs, text, docs.sparkSession.sparkContext.broadcast(_patterns(tests, window, parts, part)))
        docs = written(docs, "test-free") if part < parts - 1 else docs
    return docs


def _unhit(docs: DataFrame, text: str, sent) -> DataFrame:
    made = []

    def run(texts: list) -> dict[str, list]:
        if not made:
            made.append(_automaton(sent.value))
        return {flag: [bool(scan(t, made[0])[0]) for t in texts]}

    flag, = spare(docs, "hit")
    return with_columns(docs, text, run, f"{flag} boolean").filter(~F.col(flag)).drop(flag)


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns of ``decontaminate``'s result."""
    hit = F.aggregate(F.sequence(F.lit(0), (F.size("hit_words") / 2).cast("int") - 1), F.lit(0).cast("long"),
                      lambda a, i: a + F.element_at("hit_words", 2 * i + 2) - F.element_at("hit_words", 2 * i + 1))
    n_hit = F.when(F.size("hit_words") == 0, F.lit(0).cast("long")).otherwise(hit)
    return found.select(
        F.col("key").alias("doc_id"), "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")).cast("binary"), 256).alias("items_sha256"),
        (F.size("hit_words") > 0).alias("contaminated"))


def op8(spark, sf_dir: str) -> DataFrame:
    """``op8_decontaminate``: hits of every document against the whole test set."""
    return digest(decontaminate(documents(spark, sf_dir), read_table(spark, sf_dir, "benchmark", ["item_id", "text"])))
