"""Plain prefix doubling over every byte position, for comparison with
``suffix_dedup.remove_repeats``: (rank, rank at the offset) pairs are grouped
and ranked anew at offsets 8, 16 and 18 (8, 16, 32, 50 bytes); positions whose
pair is unique leave.  ``python tests/llm/doubling.py SF_DIR`` measures what it
shuffles (see the README)."""

import glob
import json
import sys
import tempfile
import time

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilo.llm.common import documents, in_arrow, pick, written

OFFSETS = (8, 16, 18)


def starts(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, pos): 50-byte strings that also start in a document with a smaller
    key.  Keys are distinct and not null."""
    def positions(batches):
        for batch in batches:
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text"), strict=True):
                x = np.frombuffer(text.as_buffer().to_pybytes() if text.is_valid else b"", dtype=np.uint8)
                n = len(x) - 7
                if n > 0:
                    rank = sum(x[i:i + n].astype(np.uint64) << np.uint64(8 * i) for i in range(8)).view(np.int64)
                    for s in range(0, n, 50000):
                        e = min(n, s + 50000)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(e - s, key)), pa.array(np.arange(s, e)), pa.array(rank[s:e])], ["key", "pos", "rank"])

    now = in_arrow(pick(df, key, text), positions, "key long, pos long, rank long")
    for offset in OFFSETS:
        then = now.select("key", (F.col("pos") - offset).alias("pos"), F.col("rank").alias("next"))
        pairs = written(now.select("key", "pos", "rank").join(then, ["key", "pos"]), "doubling-pairs")
        again = (pairs.groupBy("rank", "next").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("least")).filter("n > 1")
                 .withColumn("new", F.monotonically_increasing_id()))
        now = written(pairs.join(again, ["rank", "next"]).select("key", "pos", F.col("new").alias("rank"), "least"), "doubling-ranks")
    return now.filter("least < key").select("key", "pos")


if __name__ == "__main__":
    log = tempfile.mkdtemp(prefix="doubling-log-", dir="/tmp")
    spark = (SparkSession.builder.master("local[8]").config("spark.driver.memory", "12g").config("spark.ui.enabled", "false")
             .config("spark.sql.shuffle.partitions", "64").config("spark.eventLog.enabled", "true")
             .config("spark.eventLog.dir", f"file://{log}").config("spark.eventLog.compress", "false").getOrCreate())
    began = time.time()
    table = documents(spark, sys.argv[1])
    size = table.agg(F.sum(F.octet_length("text"))).first()[0]
    found = starts(table).count()
    took = time.time() - began
    spark.stop()
    shuffled = cpu = 0
    for file in glob.glob(f"{log}/**/events*", recursive=True) + glob.glob(f"{log}/local-*"):
        for line in open(file):
            if '"SparkListenerTaskEnd"' in line:
                m = json.loads(line).get("Task Metrics") or {}
                shuffled += m.get("Shuffle Write Metrics", {}).get("Shuffle Bytes Written", 0)
                cpu += m.get("Executor Run Time", 0) / 1000
    print(f"text {size / 1e6:.1f} MB, {found} strings removed, {took:.0f} s, {cpu:.0f} task seconds, {shuffled / 1e6:.0f} MB shuffled, {shuffled / size:.1f} x the text")
