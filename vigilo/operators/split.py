"""Reproducible train/test splits and skew-safe running totals.

Both splits order rows by a seeded hash of integer key columns that any
engine can compute: the first 15 hex digits of an MD5 over the keys and the
seed.  ``hash_split`` cuts that number; no shuffle, stable across reruns
and partitionings (unlike ``randomSplit``, whose result depends on the
partition layout).

``stratified_split`` puts exactly ``ceil(pct% of n_s)`` rows of every
stratum ``s`` in the train set: the first ones in hash order, i.e. a seeded
random choice.  It is a radix selection of each stratum's bound; no row is
shuffled, ranked or gathered:

1. one aggregation counts rows per (stratum, leading bits of the hash), which
   are even by construction whatever the keys look like; a running sum over
   the counts finds each stratum's *cut* bucket, in which the quota is reached;
2. the rows of the cut buckets alone are counted by their full order; the
   first place at which the quota is reached is the stratum's bound;
3. a map compares each row with the bound of its stratum (one row a stratum,
   joined as Spark sees fit: broadcast unless the strata are very many).

NULL strata are a stratum of their own, NULL keys hash like a value.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilo.session import scratch_path

HASH_BITS, MOST_BUCKET_BITS = 60, 20
SEGMENTS = 64
#: Rows that one task sorts in a window; the number of tasks follows from it.
TASK_ROWS = 100_000


def window_parts(spark, rows: int) -> int:
    """Tasks for windows over ``rows`` rows, so that the memory of one does not
    grow with the table.  Left to itself adaptive execution makes about one task
    a core of any shuffle, up to 64 MB of compressed rows."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // TASK_ROWS))


def portable_hash(keys: list[str], seed: int = 42) -> Column:
    """A 60-bit number per tuple of integer keys, the same on every engine:
    ``CAST('0x' || substr(md5(concat_ws('|', k1, ..., seed)), 1, 15) AS BIGINT)``."""
    text = F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def hash_split(df: DataFrame, keys: list[str], train_fraction: float = 0.8,
               seed: int = 42, name: str = "split") -> DataFrame:
    cut = int(round(train_fraction * 10_000))
    return df.withColumn(name, F.when(portable_hash(keys, seed) % 10_000 < cut, "train").otherwise("test"))


def _segments(df: DataFrame, lead: str) -> tuple[list[int], int, int]:
    """(quantiles of ``lead``, sub-buckets per segment, rows) from one aggregation.

    Segments between approximate quantiles hold like numbers of rows
    whatever the values are, so an outlier key only widens its own; cut
    evenly they make about sqrt(n) buckets in all."""
    at = [i / SEGMENTS for i in range(SEGMENTS + 1)]
    row = df.agg(F.percentile_approx(F.col(lead).cast("long"), at, 1000).alias("q"), F.count(F.lit(1)).alias("n")).first()
    return sorted(set(row["q"] or [])), max(1, math.isqrt(int(row["n"])) // SEGMENTS), int(row["n"])


def _bucket(lead: str, quantiles: list[int], parts: int) -> Column:
    """Order-preserving bucket of a row: its segment, found by a balanced
    CASE, then an equal part of the segment.  NULL keys come first."""
    x = F.col(lead)

    def place(lo: int, hi: int) -> Column:
        if hi - lo == 1:
            start, end = quantiles[lo], quantiles[hi]
            width = max(1, -(-(end - start) // parts))
            inner = F.least(F.lit(parts - 1), F.greatest(F.lit(0), F.floor((x - F.lit(start)) / F.lit(width))))
            return F.lit(lo * parts) + inner
        mid = (lo + hi) // 2
        return F.when(x < F.lit(quantiles[mid]), place(lo, mid)).otherwise(place(mid, hi))

    if len(quantiles) < 2:
        return F.when(x.isNull(), F.lit(-1)).otherwise(F.lit(0)).cast("long")
    return F.when(x.isNull(), F.lit(-1)).otherwise(place(0, len(quantiles) - 1)).cast("long")


def running_total(df: DataFrame, groups: list[str], order: list[str], value: Column,
                  name: str) -> DataFrame:
    """Running sum of ``value`` inside each group by ``order`` (total),
    without gathering a group into one task.

    ``order[0]`` must be numeric; it defines order-preserving buckets.  The
    total is the sum of the group's earlier buckets (a running sum over
    one-row-per-bucket aggregates) plus a running sum inside (group,
    bucket).  NULL groups are a group; a NULL ``order[0]`` comes first.
    """
    quantiles, parts, rows = _segments(df, order[0])
    tasks = window_parts(df.sparkSession, rows)
    bucketed = df.withColumn("__bucket", _bucket(order[0], quantiles, parts)).withColumn("__v", value)
    sums = bucketed.groupBy(*groups, "__bucket").agg(F.sum("__v").alias("__s"))
    earlier = Window.partitionBy(*groups).orderBy("__bucket") \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # One key of all columns: in a struct NULLs are equal, and the join and the
    # window behind it share its partitions.
    place = F.struct(*[F.col(g).alias(f"g{i}") for i, g in enumerate(groups)], F.col("__bucket").alias("b"))
    offsets = sums.select(place.alias("__place"), (F.sum("__s").over(earlier) - F.col("__s")).alias("__offset"),
                          F.sum("__s").over(Window.partitionBy(*groups)).alias("__group_total"))
    # ``offsets`` is an aggregate: AQE sees its real size after its shuffle
    # and broadcasts it when small, keeping the shuffle join when not.
    joined = bucketed.withColumn("__place", place).repartition(tasks, "__place").join(offsets.repartition(tasks, "__place"), "__place")
    inner = Window.partitionBy("__place").orderBy(*order) \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = joined.withColumn(name, F.col("__offset") + F.sum("__v").over(inner))
    return total.select(*df.columns, "__group_total", name)


def stratified_rank(df: DataFrame, strata: list[str], order: list[str], name: str = "rank") -> DataFrame:
    """1-based rank of each row inside its stratum by ``order`` (total):
    the running count.  Adds ``__group_total`` (rows in the stratum)."""
    return running_total(df, strata, order, F.lit(1).cast("long"), name)


def ranked(df: DataFrame, groups: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """``df`` with the 1-based rank of each row inside its group by ``order``
    (total), for orders that are no numbers.

    Rows are range-partitioned by (group, order) and written to the shared
    folder with their partition number; then the rank is the number of the
    group's rows in earlier partitions plus the place in its own, so a group
    of any size is spread over all partitions."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = scratch_path(spark, "ranked")
    df.repartitionByRange(parts, *groups, *order).withColumn("__part", F.spark_partition_id()).write.parquet(path)
    rows = spark.read.parquet(path)
    counts = rows.groupBy(*groups, "__part").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(*groups).orderBy("__part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n")
    offsets = counts.select(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(groups)], F.col("__part").alias("__p"), before.alias("__before"))
    on = F.col("__part") == F.col("__p")
    for i, g in enumerate(groups):
        on = on & F.col(g).eqNullSafe(F.col(f"__g{i}"))
    place = F.row_number().over(Window.partitionBy(*groups, "__part").orderBy(*order))
    return rows.join(offsets, on).withColumn(name, F.col("__before") + place).select(*df.columns, name)


def _bucket_bits(df: DataFrame) -> int:
    """Leading bits that make about sqrt(n) buckets, by the size of the largest
    table that is read; the split itself does not depend on them."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = max(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    return max(4, min(MOST_BUCKET_BITS, (size // 64).bit_length() // 2))


def _same(strata: list[str]) -> Column:
    on = F.lit(True)
    for i, c in enumerate(strata):
        on = on & F.col(c).eqNullSafe(F.col(f"__s{i}"))
    return on


def stratum_bounds(hashed: DataFrame, strata: list[str], order: list[str], train_pct: int, bits: int) -> DataFrame:
    """``(__s0 ..., __bound, __take, __tied)``: for every stratum the order value
    of its last train row, how many of the rows that equal it in all of
    ``order`` are train rows, and how many equal it.  ``order[0]`` is the hash."""
    spark = hashed.sparkSession
    named = [F.col(c).alias(f"__s{i}") for i, c in enumerate(strata)]
    leading = F.shiftright(F.col(order[0]), HASH_BITS - bits)
    per_bucket = hashed.groupBy(*strata, leading.alias("__b")).agg(F.count(F.lit(1)).alias("__n"))
    upto = F.sum("__n").over(Window.partitionBy(*strata).orderBy("__b").rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("__n").over(Window.partitionBy(*strata))
    # ceil(train_pct% of n) in integer arithmetic, identical on every engine.
    quota = F.floor((total * train_pct + 99) / 100)
    cuts = (per_bucket.withColumn("__upto", upto).withColumn("__quota", quota)
            .where((F.col("__upto") >= F.col("__quota")) & (F.col("__upto") - F.col("__n") < F.col("__quota")))
            .select(*named, F.col("__b").alias("__cut"), (F.col("__quota") - F.col("__upto") + F.col("__n")).alias("__left")))
    path = scratch_path(spark, "stratum-cuts")
    cuts.write.parquet(path)
    in_cut = hashed.join(spark.read.schema(cuts.schema).parquet(path), _same(strata) & (leading == F.col("__cut")))
    places = in_cut.groupBy(*[f"__s{i}" for i in range(len(strata))], *order).agg(
        F.count(F.lit(1)).alias("__n"), F.first("__left").alias("__left"))
    upto = F.sum("__n").over(Window.partitionBy(*[f"__s{i}" for i in range(len(strata))]).orderBy(*order)
                             .rowsBetween(Window.unboundedPreceding, 0))
    bounds = (places.withColumn("__upto", upto)
              .where((F.col("__upto") >= F.col("__left")) & (F.col("__upto") - F.col("__n") < F.col("__left")))
              .select(*[f"__s{i}" for i in range(len(strata))], F.struct(*order).alias("__bound"),
                      (F.col("__left") - F.col("__upto") + F.col("__n")).alias("__take"), F.col("__n").alias("__tied")))
    path = scratch_path(spark, "stratum-bounds")
    bounds.write.parquet(path)
    return spark.read.schema(bounds.schema).parquet(path)


def stratified_split(df: DataFrame, strata: list[str], keys: list[str], ties: list[str] | None = None,
                     train_pct: int = 80, seed: int = 42, name: str = "split", bits: int | None = None) -> DataFrame:
    """``df`` with train / test; ``keys`` are integer columns, ``ties`` order
    rows whose keys are equal.  With ``ties`` that order all rows nothing is
    ranked; only where rows that equal a bound in all of them have to be parted
    are those rows counted off, any of them first."""
    order = ["__h", *[c for c in (ties or keys)]]
    hashed = df.withColumn("__h", portable_hash(keys, seed))
    bounds = stratum_bounds(hashed, strata, order, train_pct, bits or _bucket_bits(df))
    placed = hashed.join(bounds, _same(strata), "left")
    here = F.struct(*order)
    train = F.coalesce(here <= F.col("__bound"), F.lit(False))
    if bounds.where("__take < __tied").isEmpty():
        return placed.select(*df.columns, F.when(train, "train").otherwise("test").alias(name))
    at_bound = F.coalesce((here == F.col("__bound")) & (F.col("__take") < F.col("__tied")), F.lit(False))
    clear = placed.where(~at_bound).select(*df.columns, F.when(train, "train").otherwise("test").alias(name))
    equal = placed.where(at_bound).withColumn("__rn", F.row_number().over(Window.partitionBy(*strata).orderBy(F.lit(0))))
    return clear.unionByName(equal.select(*df.columns, F.when(F.col("__rn") <= F.col("__take"), "train").otherwise("test").alias(name)))
