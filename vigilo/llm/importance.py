"""Target-distribution importance resampling (operator 12).

Documents are drawn towards a target text set without replacement: each gets
the mean log ratio of its features under the target's and the corpus's bucket
distributions (its *weight*) plus Gumbel noise hashed from its key (its
*score*), and the highest scores are drawn.

1. Features are all runs of 1 to ``runs`` words; a feature's bucket is its crc32
   modulo ``buckets``.  Every task counts its rows into one array and sends at
   most ``buckets`` rows on; the totals come to the driver as two arrays of
   ``buckets`` numbers, whatever the size of the corpus, and become the gains.
2. A document's weight is the mean of ``gains[its buckets]``.  Scores, keys and a
   row number are written as a table; nothing after this reads a text.
3. The cutoff is found by bisection on numbers: jobs count how many eligible
   rows lie at or below some thresholds of the order (score falling, key, text
   hash, row number), one column after the other, until exactly the wanted
   number is on one side.  Nothing is sorted for it, and rows that tie in one
   column, however many, are told apart by the next.
4. Only the drawn rows are range-partitioned and ranked: a row's rank is its
   place in its range plus the rows of all ranges before.

Null and empty texts have no features: weight 0, and too few words to be drawn.
A null key is hashed as an empty text and comes last among ties.  Repeated rows
are rows of their own: each is scored, drawn and ranked by itself.  A very long
text is one array of buckets in its task.  An empty corpus gives an empty
result, an empty target gains that only follow the corpus.  Columns other than
key and text are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilo.llm.common import SLICE_ROWS, by_batch_of, documents, in_arrow, pick, written
from vigilo.llm.decontaminate import words
from vigilo.sources.tables import read_table

RUNS, BUCKETS, SEED = 1, 10_000, 2024
LEAST_WORDS, PERCENT = 20, 10
#: Thresholds that one counting job tries.
WAYS = 16
LAST = (1 << 63) - 1


def features(w: list[bytes], runs: int) -> list[bytes]:
    """All runs of 1 to ``runs`` consecutive words."""
    return w if runs == 1 else [b" ".join(w[i:i + n]) for n in range(1, runs + 1) for i in range(len(w) - n + 1)]


def bucketed(text: str | None, runs: int = RUNS, buckets: int = BUCKETS) -> tuple[np.ndarray, int]:
    """(bucket of every feature, number of words)."""
    w = words(text)
    made = features(w, runs)
    return np.fromiter(map(crc32, made), dtype=np.int64, count=len(made)) % buckets, len(w)


def bucket_counts(df: DataFrame, text: str = "text", runs: int = RUNS, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all rows fall into each bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for s in range(0, batch.num_rows, SLICE_ROWS):
                for t in batch.column(0).slice(s, SLICE_ROWS).to_pylist():
                    held += np.bincount(bucketed(t, runs, buckets)[0], minlength=buckets)
        at = np.nonzero(held)[0]
        yield pa.RecordBatch.from_pydict({"bucket": at, "n": held[at]})

    rows = in_arrow(df.select(F.col(f"`{text}`").cast("string").alias("text")), run, "bucket long, n long")
    out = np.zeros(buckets, dtype=np.int64)
    for bucket, n in rows.groupBy("bucket").agg(F.sum("n")).collect():  # at most ``buckets`` rows
        out[bucket] = n
    return out


def gains(target: np.ndarray, corpus: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of both sides' smoothed bucket shares."""
    n = len(corpus)
    of_target, of_corpus = int(target.sum()) + n, int(corpus.sum()) + n
    return np.array([math.floor(1000 * math.log((t + 1) * float(of_corpus) / ((s + 1) * float(of_target))))
                     for t, s in zip(target.tolist(), corpus.tolist(), strict=True)], dtype=np.int64)


def noise(key: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, fixed by the key."""
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(hashed, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def scored(df: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text",
           runs: int = RUNS, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """(key, mark, n_words, n_features, weight, score, row), written: one row
    per input row; mark is a hash of the text, row a number of its own."""
    gain = gains(bucket_counts(target, target_text, runs, buckets), bucket_counts(df, text, runs, buckets))

    def run(texts: list) -> dict[str, list]:
        n_words, n_features, weight = [], [], []
        for t in texts:
            of, n = bucketed(t, runs, buckets)
            n_words.append(n)
            n_features.append(len(of))
            weight.append(int(gain[of].sum()) // len(of) if len(of) else 0)
        return {"n_words": n_words, "n_features": n_features, "weight": weight}

    rows = pick(df, key, text, any_key=True)
    rows = rows.withColumn("mark", F.xxhash64("text"))
    counted = by_batch_of(rows.select("key", "mark", "text"), lambda keys, marks, texts: {"key": keys, "mark": marks} | run(texts),
                          f"key {rows.schema['key'].dataType.simpleString().replace('bigint', 'long')}, mark long, "
                          "n_words long, n_features long, weight long")
    return written(counted.withColumns({"score": F.col("weight") + noise(F.col("key"), seed),
                                        "row": F.monotonically_increasing_id()}), "importance-scores")


def cutoff(rows: DataFrame, order: list[Column], want: int) -> Column:
    """Condition that holds for exactly the first ``want`` rows in ascending
    order of the long columns ``order``, whose last has no ties.

    Each job counts the rows at or below ``WAYS - 1`` thresholds that cut the
    open interval of one column into equal parts, and the interval shrinks to
    the part in which the wanted row lies."""
    chosen, tied = F.lit(False), F.lit(True)
    for value in order:
        here = rows.filter(tied)
        low, high, held = here.agg(F.min(value), F.max(value), F.count("*")).first()
        if held <= want:
            return chosen | tied
        while low < high:
            points = sorted({low + (high - low) * i // WAYS for i in range(WAYS)} - {high})
            counts = here.agg(*[F.count_if(value <= p) for p in points]).first()
            at = next((i for i, n in enumerate(counts) if n >= want), len(points))
            low, high = (points[at - 1] + 1 if at else low), (points[at] if at < len(points) else high)
        before, upto = here.agg(F.count_if(value < low), F.count_if(value <= low)).first()
        if upto == want:
            return chosen | (tied & (value <= low))
        chosen, tied, want = chosen | (tied & (value < low)), tied & (value == low), want - before
    return chosen


def ranked(rows: DataFrame, order: list[Column]) -> DataFrame:
    """``rows`` with ``rank`` (1, 2, 3 ... in ascending order): places inside
    range partitions plus the rows of the ranges before."""
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = written(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
                     .withColumn("place", F.monotonically_increasing_id()), "importance-ranges")
    part, nth = F.shiftright("place", 33), F.col("place").bitwiseAND((1 << 33) - 1)
    sizes = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n"))  # a row for each range
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return (placed.withColumn("part", part).join(F.broadcast(before), "part")
            .withColumn("rank", F.col("before") + nth + 1).drop("part", "before", "place"))


def resample(df: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text",
             runs: int = RUNS, buckets: int = BUCKETS, seed: int = SEED, least_words: int = LEAST_WORDS,
             percent: int = PERCENT) -> DataFrame:
    """(key, n_words, n_features, weight, score, rank) of every row; of the rows
    with at least ``least_words`` words the ``percent`` of a hundred with the
    highest scores are drawn, ties going to the smaller key (which has to be an
    integer).  rank is null for the others."""
    rows = scored(df, target, key, text, target_text, runs, buckets, seed)
    order = [-F.col("score"), F.coalesce(F.col("key").cast("long"), F.lit(LAST)), F.col("mark"), F.col("row")]
    eligible = rows.filter(F.col("n_words") >= least_words)
    want = percent * eligible.count() // 100
    drawn = (F.col("n_words") >= least_words) & (cutoff(eligible, order, want) if want else F.lit(False))
    out = ["key", "n_words", "n_features", "weight", "score", "rank"]
    left = rows.filter(~drawn).withColumn("rank", F.lit(None).cast("long"))
    return left.select(*out).unionAll(ranked(rows.filter(drawn), order).select(*out))


def op12(spark, sf_dir: str) -> DataFrame:
    """``op12_importance``: documents drawn towards the benchmark's words."""
    out = resample(documents(spark, sf_dir), read_table(spark, sf_dir, "benchmark", ["text"]))
    return out.withColumnRenamed("key", "doc_id").drop("n_words")
