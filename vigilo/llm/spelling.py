"""Spelling variants by a bit-sliced position index (operator 11).

The vocabulary of a corpus is grouped by spelling: two words are *near* when one
inserted, deleted or replaced code point turns one into the other.  A word's
*form* is its most frequent near word when that one is ``factor`` times as
frequent; following forms to the last gives its *root*.

1. Words are counted where the texts are read; a task sends on its partial counts.
2. Near words are looked for in groups.  For a pair whose shorter word has m code
   points, the edit lies in one of ``PIECES`` pieces of it; the code points
   before and behind that piece agree.  Each word goes to the groups (m, piece,
   head, tail) it may be in as the shorter or as the longer one, with the middle
   that head and tail leave.  Every pair meets in one group only: the one whose
   piece holds the first place at which its words differ.
3. In a group the middles become a bit-sliced index: for each (position, letter)
   a bitset over the group's words.  A shorter word scans it once, letter by
   letter, with recurrences over whole bitsets: ``same`` (no error so far),
   ``changed`` (one replaced letter, same position) and ``longer`` (one letter
   more on the other side, positions shifted by one) advance together.
4. Each group sends on one row a word: how many near words and the best one.

Scale: groups share two thirds of a word, so they are small.  One of more than
``BLOCK_WORDS`` words (they are counted) is dealt in a grid: its shorter words
in blocks against all words in blocks, each pair of blocks a task of its own.
Nothing comes to the driver.  Chains of forms are followed by doubling, each
round a join of the words that have a form, written before the next.

Null texts have no words.  In drawing the typing errors a null key reads as an
empty text.  Repeated rows count as often as they stand there.  Of near words
with equal counts the first in code-point order is taken.  Very long texts are
counted whole; empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilo.llm.common import SLICE_ROWS, documents, in_arrow, pick, written

LEAST_CHARS, LEAST_COUNT, FACTOR, ERROR_EVERY = 7, 2, 10, 31
PIECES = 3
BLOCK_WORDS = 16384
#: Distinct words that a task holds before it sends its counts on.
HELD_WORDS = 200_000

# In UTF-8 the letters U+00C0 to U+00FF are C3 80 to C3 BF; every other character
# beyond ASCII begins with another byte and separates words.
_OTHER = re.compile(rb"[\xC2\xC4-\xF4][\x80-\xBF]+")
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 0x80 <= c <= 0xBF or c == 0xC3 else 32 for c in range(256))


def letter_runs(text: str | None) -> list[bytes]:
    """Maximal runs of letters (A-Z, a-z, U+00C0 to U+00FF), A-Z lower-cased."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return (raw if raw.isascii() else _OTHER.sub(b" ", raw)).translate(_LETTERS).split()


def mistyped(key: object, runs: list[bytes], every: int) -> list[bytes]:
    """``runs``, in which those drawn by the hash of key and run lose a code point."""
    if not runs:
        return runs
    base = crc32(f"{'' if key is None else key}:".encode())
    drawn = np.fromiter(map(crc32, runs, repeat(base)), dtype=np.int64, count=len(runs))
    for i in np.nonzero(drawn % every == 0)[0].tolist():
        run = runs[i].decode()
        at = int(drawn[i]) % len(run)
        runs[i] = (run[:at] + run[at + 1:]).encode()
    return runs


def vocabulary(df: DataFrame, key: str = "doc_id", text: str = "text", least_chars: int = LEAST_CHARS,
               least_count: int = LEAST_COUNT, error_every: int = ERROR_EVERY) -> DataFrame:
    """(word, n), written: words of at least ``least_chars`` code points that stand
    ``least_count`` times or more in all texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def flushed() -> pa.RecordBatch:
            long_enough = [(w, n) for w, n in held.items() if len(w) - w.count(b"\xc3") >= least_chars]
            return pa.RecordBatch.from_arrays([pa.array([w.decode() for w, _ in long_enough], pa.string()),
                                               pa.array([n for _, n in long_enough], pa.int64())], names=["word", "n"])

        for batch in batches:
            for s in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(s, SLICE_ROWS)
                for k, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    held.update(mistyped(k, letter_runs(t), error_every))
                if len(held) >= HELD_WORDS:
                    yield flushed()
                    held.clear()
        yield flushed()

    counts = in_arrow(pick(df, key, text, any_key=True), run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return written(counts.filter(F.col("n") >= least_count), "spelling-words")


def dealt(words: DataFrame, least_chars: int = LEAST_CHARS, pieces: int = PIECES, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(group, task, m, piece, head, tail, mid, n, asks, told): a row for each
    group of a word; ``asks`` rows are looked up among the ``told`` rows of their
    task.  group is a hash of m, piece, head and tail."""
    size = F.length("word")
    rows = words.select("word", "n", F.explode(F.array(size, size - 1)).alias("m")).filter(F.col("m") >= least_chars)
    rows = rows.select("word", "n", "m", F.explode(F.array(*map(F.lit, range(pieces)))).alias("piece"))
    start = F.floor(F.col("m") * F.col("piece") / pieces).cast("int")
    behind = F.col("m") - F.floor(F.col("m") * (F.col("piece") + 1) / pieces).cast("int")
    rows = rows.withColumns({"a": start, "z": behind}).select(
        "m", "piece", F.substring("word", F.lit(1), F.col("a")).alias("head"),
        F.substring("word", F.length("word") - F.col("z") + 1, F.col("z")).alias("tail"),
        F.substring("word", F.col("a") + 1, F.length("word") - F.col("a") - F.col("z")).alias("mid"), "n",
        (F.length("word") == F.col("m")).alias("asks"))
    rows = rows.withColumn("group", F.xxhash64("m", "piece", "head", "tail"))
    big = (rows.groupBy("group").agg(F.count("*").alias("size")).filter(F.col("size") > block_words)
           .select("group", F.ceil(F.col("size") / block_words).cast("int").alias("parts")))
    rows = rows.join(big, "group", "left")
    own = F.pmod(F.xxhash64("mid"), F.col("parts")).cast("int")
    every = F.sequence(F.lit(0), F.col("parts") - 1)
    # In the grid of a large group, row i asks in the tasks (i, j) of every j and is told in (j, i).
    places = F.when(F.col("parts").isNull(), F.array(F.struct(F.lit(0).alias("task"), F.col("asks").alias("asks"), F.lit(True).alias("told")))) \
        .otherwise(F.concat(
            F.when(F.col("asks"), F.transform(every, lambda j: F.struct((own * F.col("parts") + j).alias("task"), F.lit(True).alias("asks"), F.lit(False).alias("told"))))
            .otherwise(F.array().cast("array<struct<task:int,asks:boolean,told:boolean>>")),
            F.transform(every, lambda j: F.struct((j * F.col("parts") + own).alias("task"), F.lit(False).alias("asks"), F.lit(True).alias("told")))))
    return rows.withColumn("place", F.explode(places)).select(
        "group", F.col("place.task").alias("task"), "m", "piece", "head", "tail", "mid", "n",
        F.col("place.asks").alias("asks"), F.col("place.told").alias("told"))


def _bitset(of: list[int], size: int) -> int:
    held = bytearray((size >> 3) + 1)
    for i in of:
        held[i >> 3] |= 1 << (i & 7)
    return int.from_bytes(held, "little")


class Index:
    """Bit-sliced index of middles of ``width`` or ``width + 1`` letters: for
    every (position, letter) the set of middles with that letter there."""

    def __init__(self, middles: list[str], width: int):
        cells: dict[tuple[int, str], list[int]] = defaultdict(list)
        for i, mid in enumerate(middles):
            for cell in enumerate(mid):
                cells[cell].append(i)
        self.cells = {cell: _bitset(of, len(middles)) for cell, of in cells.items()}
        self.all = (1 << len(middles)) - 1
        self.equal = _bitset([i for i, mid in enumerate(middles) if len(mid) == width], len(middles))
        self.wider = self.all ^ self.equal

    def near(self, mid: str, last: bool) -> list[int]:
        """Places of the middles one edit from ``mid``.  Those that only append
        to it count in the last piece: elsewhere the next piece has them."""
        same, changed, longer = self.all, 0, 0
        cell = self.cells.get
        for i, letter in enumerate(mid):
            here = cell((i, letter), 0)
            longer = (longer | same) & cell((i + 1, letter), 0)
            changed = changed & here | same & ~here
            same &= here
        hits = changed & self.equal | (longer | same if last else longer & ~same) & self.wider
        out = []
        while hits:
            low = hits & -hits
            out.append(low.bit_length() - 1)
            hits ^= low
        return out


def near_in_group(rows: list[tuple], last: bool, width: int, tail: str = "") -> dict[str, list]:
    """{middle: [near words, count of the best, best middle]} of rows (mid, n,
    asks, told).  Equal counts: the first word in code-point order; middles differ
    in length, so they are compared with the group's ``tail`` behind them."""
    told = [(mid, n) for mid, n, _, t in rows if t]
    asking = [(mid, n) for mid, n, a, _ in rows if a]
    out: dict[str, list] = {}
    if not asking or not told:
        return out

    def note(mid: str, n: int, other: str) -> None:
        held = out.setdefault(mid, [0, 0, ""])
        held[0] += 1
        if n > held[1] or n == held[1] and other + tail < held[2] + tail:
            held[1], held[2] = n, other

    index = Index([mid for mid, _ in told], width)
    for mid, n in asking:
        for i in index.near(mid, last):
            other, other_n = told[i]
            note(mid, other_n, other)
            if len(other) > width:  # the longer word does not ask
                note(other, n, mid)
    return out


def near_words(words: DataFrame, least_chars: int = LEAST_CHARS, pieces: int = PIECES, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(word, n_near, best_n, best): for every word that has near words their
    number and the most frequent one."""
    rows = dealt(words, least_chars, pieces, block_words).repartition("group", "task").sortWithinPartitions("group", "task")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def groups(final: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held
            if not held:
                return
            table = pa.Table.from_batches(held).combine_chunks()
            group, task = table["group"].to_numpy(), table["task"].to_numpy()
            edge = np.nonzero((np.diff(group) != 0) | (np.diff(task) != 0))[0] + 1
            bounds = np.concatenate([[0], edge, [len(group)]])
            if final:
                held = []
            else:
                held = table.slice(int(bounds[-2])).to_batches()
                bounds = bounds[:-1]
            sizes = np.diff(bounds)
            keep = np.nonzero(np.repeat(sizes > 1, sizes))[0]  # a word alone has no near one here
            part = table.take(pa.array(keep)).to_pydict()
            out: dict[str, list] = {"word": [], "n_near": [], "best_n": [], "best": []}
            at = 0
            for size in sizes[sizes > 1].tolist():
                own: dict[tuple, list] = defaultdict(list)  # a hash may hold several groups
                for i in range(at, at + size):
                    own[part["m"][i], part["piece"][i], part["head"][i], part["tail"][i]].append(
                        (part["mid"][i], part["n"][i], part["asks"][i], part["told"][i]))
                at += size
                for (m, piece, head, tail), of in own.items():
                    if len(of) > 1:
                        for mid, (n, best_n, best) in near_in_group(of, piece == pieces - 1, m - len(head) - len(tail), tail).items():
                            for c, v in zip(out, (head + mid + tail, n, best_n, head + best + tail), strict=True):
                                out[c].append(v)
            if out["word"]:
                yield pa.RecordBatch.from_arrays([pa.array(out["word"], pa.string()), pa.array(out["n_near"], pa.int64()),
                                                  pa.array(out["best_n"], pa.int64()), pa.array(out["best"], pa.string())], names=list(out))

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= 1 << 16:
                yield from groups(False)
        yield from groups(True)

    found = in_arrow(rows, run, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("first")).select(
        "word", "n_near", (-F.col("first.n")).alias("best_n"), F.col("first.word").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): the end of each chain of forms.  Every round
    doubles the step; a form is at least ``factor`` times as frequent, so chains
    are short."""
    steps = written(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        nxt = steps.select(F.col("word").alias("via"), F.col("root").alias("further"))
        steps = written(steps.join(nxt, F.col("root") == F.col("via"), "left").select(
            "word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling-roots")
        if steps.filter("moved").isEmpty():
            return steps.select("word", "root")
        steps = steps.drop("moved")


def variants(df: DataFrame, key: str = "doc_id", text: str = "text", least_chars: int = LEAST_CHARS,
             least_count: int = LEAST_COUNT, factor: int = FACTOR, error_every: int = ERROR_EVERY,
             block_words: int = BLOCK_WORDS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of the vocabulary."""
    words = vocabulary(df, key, text, least_chars, least_count, error_every)
    near = words.join(near_words(words, least_chars, block_words=block_words), "word", "left")
    has = F.col("best_n") >= factor * F.col("n")
    judged = written(near.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                                 F.when(has, F.col("best")).alias("form"), F.when(has, F.col("best_n")).alias("form_n")), "spelling-forms")
    ends = roots(judged.filter("form IS NOT NULL").select("word", "form"))
    return judged.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11(spark, sf_dir: str) -> DataFrame:
    """``op11_spelling``: spelling variants in the words of all documents."""
    return variants(documents(spark, sf_dir))
