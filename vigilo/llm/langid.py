"""Language identification with bit-sliced n-gram Bloom filters (operator 5).

Learning: every labelled row is read.  Character n-grams (sizes ``SIZES``, over
lower-cased letters, each run of other characters being one blank) are hashed
to 64 bits and counted per language; partial counts are summed in
Spark.  An n-gram belongs to a language when its share of that language's n-grams
is at least ``MIN_SHARE`` and at least ``REL_SHARE`` of the largest share any
language has, so words quoted or labelled wrongly do not enter a filter.

The filters of all languages are stored bit-sliced: ``HASHES`` arrays of
``2^FILTER_BITS`` integers whose bit l belongs to language l.  Looking one
n-gram up is one gather per hash and an AND; the result is the bitmask of all
languages that contain the n-gram.

Deciding: per language, the popcount over a text's n-grams divided by their
number, corrected for the filter's false positives, ``(hits - f) / (1 - f)``
with ``f = fill^HASHES``; the largest wins, the score is its part of the sum.

The filters are of fixed size (``HASHES * 2^FILTER_BITS`` integers for every 63
languages, 25 MB) and broadcast as they are, at any input size; the learned
languages are the distinct labels.

Null texts and texts without a letter get ``und`` with score 0.  With letters
but no n-gram known, the language with most training n-grams is returned with
score 0.  With no training rows at all every text is ``und``.  Rows whose
label is null are never learned from; a row whose key is null counts as not
held out.  Ties go to the first label by name.  Repeated rows are learned from as
often as they stand there and predicted alike; very long texts are read piece by
piece; empty tables give empty results; columns other than those named are not
read (``label`` keeps them).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigilo.llm.common import by_batch_of, documents, pick, with_columns, written

UNKNOWN = "und"
SIZES = (2, 3, 4)
FILTER_BITS = 20
HASHES = 3
MIN_SHARE = 2e-6
REL_SHARE = 0.25
PER_MASK = 63
PIECE = 1 << 18
COUNTED = 1 << 20
FOLDS, HELD_OUT = 3, 1
_BLANK = 0
_letters: np.ndarray | None = None


def letter_table() -> np.ndarray:
    """True at every code point that is a letter."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)
    return _letters


def _points(text: str) -> np.ndarray:
    """Code points of the lower-cased letters; runs of anything else are one blank."""
    cp = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    is_letter = letter_table()[cp]
    cp = np.where(is_letter, cp, _BLANK)
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]
    cp = cp[keep]
    if not len(cp):
        return cp
    lead = [] if cp[0] == _BLANK else [_BLANK]
    tail = [] if cp[-1] == _BLANK else [_BLANK]
    return np.concatenate([lead, cp, tail]).astype(np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def cells(text: str) -> Iterator[np.ndarray]:
    """64-bit hashes of the n-grams of a text, piece by piece, so that a very
    long text needs no more memory than a piece; the n-gram size is hashed in."""
    cp = _points(text)
    for n in SIZES:
        for s in range(0, len(cp) - n + 1, PIECE):
            piece = cp[s:s + PIECE + n - 1]
            h = np.full(len(piece) - n + 1, n, dtype=np.uint64)
            for i in range(n):
                h = (h ^ piece[i:len(piece) - n + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
            yield _mix(h).view(np.int64)


def counts(df: DataFrame, lang: str, text: str) -> DataFrame:
    """(lang, cell, n): n-grams per language and hash over all rows."""
    def run(langs: list, texts: list) -> dict[str, list]:
        by: dict[str, list[str]] = {}
        for lang_, t in zip(langs, texts, strict=True):
            by.setdefault(lang_, []).append(t)
        names, at_cells, sums = [], [], []

        def add(lang_: str, held: list[np.ndarray]) -> None:
            at, n = np.unique(np.concatenate(held), return_counts=True)
            names.extend([lang_] * len(at))
            at_cells.append(at)
            sums.append(n.astype(np.int64))

        for lang_, some in by.items():
            held, size = [], 0
            for c in chain.from_iterable(cells(t) for t in some):
                held.append(c)
                size += len(c)
                if size >= COUNTED:
                    add(lang_, held)
                    held, size = [], 0
            if held:
                add(lang_, held)
        none = np.zeros(0, dtype=np.int64)
        return {"lang": names, "cell": pa.array(np.concatenate([none, *at_cells])), "n": pa.array(np.concatenate([none, *sums]))}

    labelled = df.select(F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{text}`").alias("text")) \
        .filter("lang is not null and text is not null")
    return by_batch_of(labelled, run, "lang string, cell long, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n"))


class Filters:
    """Bit-sliced Bloom filters of all languages."""

    def __init__(self, names: list[str], members: list[np.ndarray], order: list[int]):
        self.names, self.fallback = names, (names[order[0]] if names else UNKNOWN)
        self.slices = np.zeros((-(-max(1, len(names)) // PER_MASK), HASHES, 1 << FILTER_BITS), dtype=np.int64)
        for i, cells in enumerate(members):
            for h, at in enumerate(self.places(cells)):
                self.slices[i // PER_MASK, h, at] |= np.int64(1 << i % PER_MASK)
        self.false = np.array([np.prod([(self.slices[i // PER_MASK, h] >> (i % PER_MASK) & 1).mean() for h in range(HASHES)])
                               for i in range(len(names))])

    @staticmethod
    def places(cells: np.ndarray) -> list[np.ndarray]:
        out = []
        x = cells.astype(np.uint64) + np.uint64(1)
        for _ in range(HASHES):
            x = _mix(x * np.uint64(0x9E3779B97F4A7C15))
            out.append((x >> np.uint64(64 - FILTER_BITS)).astype(np.int64))
        return out

    def decider(self) -> Decider:
        return Decider(self.names, self.fallback, self.false, self.slices)


class Decider:
    """What tasks need of the filters."""

    def __init__(self, names: list[str], fallback: str, false: np.ndarray, slices: np.ndarray):
        self.names, self.fallback, self.false, self.slices = names, fallback, false, slices

    def masks(self, cells: np.ndarray) -> np.ndarray:
        """Masks of languages for every n-gram hash."""
        at = Filters.places(cells)
        return np.stack([np.bitwise_and.reduce([s[h][at[h]] for h in range(HASHES)]) for s in self.slices])

    def hits(self, masks: np.ndarray) -> np.ndarray:
        """Per language, how many of the n-gram masks have its bit."""
        out = np.zeros(len(self.names), dtype=np.int64)
        for w, mask in enumerate(masks):
            for i in range(w * PER_MASK, min(len(self.names), (w + 1) * PER_MASK)):
                out[i] = np.count_nonzero(mask & np.int64(1 << i % PER_MASK))
        return out

    def decide(self, text: str | None) -> tuple[str, float]:
        if not text or not self.names:
            return UNKNOWN, 0.0
        n, hits = 0, np.zeros(len(self.names), dtype=np.int64)
        for c in cells(text):
            n += len(c)
            hits += self.hits(self.masks(c))
        if not n:
            return UNKNOWN, 0.0
        rate = hits / n
        fair = np.maximum(0.0, (rate - self.false) / np.maximum(1e-9, 1 - self.false))
        best = int(np.argmax(fair))
        total = float(fair.sum())
        return (self.names[best], float(fair[best]) / total) if total > 0 else (self.fallback, 0.0)


def fit(df: DataFrame, lang: str = "lang", text: str = "text") -> Filters:
    """Learn the filters from all labelled rows of ``df``.  What reaches the
    driver is at most ``1 / MIN_SHARE`` n-grams a language."""
    n = written(counts(df, lang, text), "langid-counts")
    totals = n.groupBy("lang").agg(F.sum("n").alias("total"))  # a row for each language
    top = F.max("share").over(Window.partitionBy("cell"))  # over the languages that have an n-gram
    chosen = (n.join(totals, "lang").withColumn("share", F.col("n") / F.col("total")).filter(F.col("share") >= MIN_SHARE * REL_SHARE)
              .withColumn("top", top).filter((F.col("share") >= MIN_SHARE) & (F.col("share") >= REL_SHARE * F.col("top"))))
    rows = chosen.groupBy("lang", "total").agg(F.collect_list("cell").alias("cells")).orderBy("lang").collect()
    order = sorted(range(len(rows)), key=lambda i: (-rows[i]["total"], rows[i]["lang"]))
    return Filters([r["lang"] for r in rows], [np.array(sorted(r["cells"]), dtype=np.int64) for r in rows], order)


def label(df: DataFrame, model: Filters, text: str = "text", lang: str = "lang", score: str = "score") -> DataFrame:
    """``df`` with the predicted language and its score in two columns."""
    sent = df.sparkSession.sparkContext.broadcast(model.decider())

    def run(texts: list) -> dict[str, list]:
        found = [sent.value.decide(t) for t in texts]
        return {lang: [f[0] for f in found], score: [f[1] for f in found]}

    return with_columns(df, text, run, f"{lang} string, {score} double")


def identify(df: DataFrame, model: Filters, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score) for every row."""
    return label(pick(df, key, text), model, lang="lang_pred").select("key", "lang_pred", "score")


def held_out(key: str):
    """True for the rows that are never learned from."""
    return F.coalesce(F.crc32(F.col(f"`{key}`").cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def op5(spark, sf_dir: str) -> DataFrame:
    """``op5_langid``: prediction for every document, learned from the two
    training folds."""
    docs = documents(spark, sf_dir, "doc_id", "text", "lang")
    model = fit(docs.filter(~held_out("doc_id")))
    return identify(docs, model).select(F.col("key").alias("doc_id"), held_out("key").alias("held_out"), "lang_pred", "score")
