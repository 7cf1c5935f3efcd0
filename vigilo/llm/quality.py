"""Quality rules from suffix-array repetition (operator 2).

Words are runs of anything but blank, tab, line feed, vertical tab, form feed
and carriage return.  For each document the suffixes of its word sequence are
sorted by prefix doubling; neighbours in that order with a common prefix of at
least ``MIN_WORDS`` words are repeats, and their longest-common-prefix
intervals give the maximal repeated substrings.  Their spans are united.  A
document is kept when the base rules hold, at most ``MAX_COVERED`` of its words
lie in repeats, and no repeat is longer than ``MAX_REPEAT`` words.

Base rules: at least 20 words, and at most 30 in 100 words in 8-word windows
that occur twice or more (the first included) -- the same intervals, cut at
8 words.

The work is per row and never shuffled: a hot source or a group of copies has
no effect.  The documents of a slice are sorted together, with the document as
the first part of each rank, so short texts cost no calls of their own; a very
long text needs a few integers per word and doubling round.  Rounds go on only
for suffixes that are not yet unique.

Null texts have no words: all counts 0, base failed, not kept.  Rows that
repeat get equal results.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilo.llm.common import by_batch_of, documents, pick

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
LEAST_WORDS, WINDOW, MAX_WINDOW_PERCENT = 20, 8, 30
MIN_WORDS, MAX_COVERED, MAX_REPEAT = 4, 0.4, 200
GROUP_WORDS = 1 << 18
_LINE_WITH_WORD = re.compile(r"[^\x20\x09-\x0D]")


def suffix_ranks(words: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(suffix array, ranks by 1, 2, 4, ... words) of word codes; ``ends[i]`` is
    where the document of word i ends, so no suffix reaches into another one.
    Equal ranks of a level mean as many equal words in the same document."""
    n = len(words)
    _, rank, size = np.unique(ends.astype(np.int64) << 32 | words, return_inverse=True, return_counts=True)
    first = np.cumsum(size) - size
    levels = [first[rank].astype(np.int64)]
    open_ = np.nonzero(size[rank] > 1)[0]
    step = 1
    while len(open_):
        now = levels[-1]
        next_ = open_ + step
        inside = next_ < ends[open_]
        second = np.where(inside, now[np.minimum(next_, n - 1)] + 1, 0)
        order = np.lexsort((second, now[open_]))
        at, lead, follow = open_[order], now[open_][order], second[order]
        new_group = np.ones(len(at), dtype=bool)
        new_group[1:] = lead[1:] != lead[:-1]
        new = new_group.copy()
        new[1:] |= follow[1:] != follow[:-1]
        place = np.arange(len(at))
        start = np.maximum.accumulate(np.where(new_group, place, 0))
        own = np.maximum.accumulate(np.where(new, place, 0))
        after = now.copy()
        after[at] = lead + own - start
        levels.append(after)
        alone = new & np.append(new[1:], True)
        open_ = np.sort(at[~alone])
        step *= 2
    array = np.empty(n, dtype=np.int64)
    array[levels[-1]] = np.arange(n)
    return array, levels


def repeats(words: np.ndarray, ends: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, words) of every suffix's longest common prefix with a neighbour
    in the suffix array, of at least ``least`` words; together they are the
    spans of the maximal repeated substrings."""
    if len(words) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    array, levels = suffix_ranks(words, ends)
    a, b = array[:-1], array[1:]
    some = np.nonzero(levels[0][a] == levels[0][b])[0]
    a, b = a[some], b[some]
    size = np.zeros(len(a), dtype=np.int64)
    for k in range(len(levels) - 1, -1, -1):
        i, j = a + size, b + size
        inside = (i < ends[a]) & (j < ends[b])
        i, j = np.where(inside, i, 0), np.where(inside, j, 0)
        size += np.where(inside & (levels[k][i] == levels[k][j]) & (i != j), 1 << k, 0)
    keep = size >= least
    return np.concatenate([a[keep], b[keep]]), np.concatenate([size[keep], size[keep]])


def covered(start: np.ndarray, size: np.ndarray, n: int) -> np.ndarray:
    """True for the words inside any of the spans."""
    step = np.zeros(n + 1, dtype=np.int64)
    np.add.at(step, start, 1)
    np.add.at(step, start + size, -1)
    return np.cumsum(step[:-1]) > 0


def measures(texts: list[str | None], min_words: int = MIN_WORDS) -> dict[str, np.ndarray]:
    """Counts of each text."""
    out = {c: np.zeros(len(texts), dtype=np.int64) for c in
           ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered", "longest_repeat")}
    group, held = [], 0
    for i, text in enumerate(texts):
        if not text:
            continue
        out["word_chars"][i] = len(text) - sum(map(text.count, BLANKS))
        out["n_symbols"][i] = sum(map(text.count, SYMBOLS))
        lines = [x for x in text.split("\n") if _LINE_WITH_WORD.search(x)]
        out["n_dup_lines"][i] = len(lines) - len(set(lines))
        group.append((i, text.encode("utf-8", "surrogatepass").split()))
        held += len(group[-1][1])
        if held >= GROUP_WORDS:
            _repetition(group, min_words, out)
            group, held = [], 0
    _repetition(group, min_words, out)
    return out


def _repetition(group: list[tuple[int, list[bytes]]], min_words: int, out: dict[str, np.ndarray]) -> None:
    if not group:
        return
    rows = np.array([i for i, _ in group])
    sizes = np.array([len(w) for _, w in group])
    out["n_words"][rows] = sizes
    codes: dict[bytes, int] = {}
    words = np.array([codes.setdefault(w, len(codes)) for _, ws in group for w in ws], dtype=np.int64)
    ends = np.repeat(np.cumsum(sizes), sizes)
    doc = np.repeat(np.arange(len(group)), sizes)
    start, size = repeats(words, ends, min(min_words, WINDOW))
    per_doc = lambda at: np.bincount(doc[at], minlength=len(group))
    long_ = size >= WINDOW
    out["n_repeat_words"][rows] = per_doc(covered(start[long_], size[long_], len(words)))
    long_ = size >= min_words
    out["n_covered"][rows] = per_doc(covered(start[long_], size[long_], len(words)))
    longest = np.zeros(len(group), dtype=np.int64)
    np.maximum.at(longest, doc[start], size)
    out["longest_repeat"][rows] = np.where(longest >= min_words, longest, 0)


def judge(df: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS,
          max_covered: float = MAX_COVERED, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """(key, counts, covered, base_failed, kept) for every row."""
    def run(keys: list, texts: list) -> dict[str, list]:
        return {"key": keys} | {c: pa.array(v) for c, v in measures(texts, min_words).items()}

    counts = by_batch_of(pick(df, key, text), run, "key long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
                         "n_repeat_words long, n_covered long, longest_repeat long")
    base = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MAX_WINDOW_PERCENT * F.col("n_words"))
    share = F.when(F.col("n_words") > 0, F.col("n_covered") / F.col("n_words")).otherwise(0.0)
    return counts.withColumns({"covered": share, "base_failed": base}).withColumn(
        "kept", ~F.col("base_failed") & (F.col("covered") <= max_covered) & (F.col("longest_repeat") <= max_repeat))


def op2(spark, sf_dir: str) -> DataFrame:
    """``op2_quality``: counts and verdict for every document."""
    return judge(documents(spark, sf_dir)).withColumnRenamed("key", "doc_id").drop("n_covered", "longest_repeat")
