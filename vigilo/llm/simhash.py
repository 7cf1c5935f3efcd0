"""SimHash near-duplicates by anchor-point covering (operator 3).

A fingerprint has 64 bits.  They are cut into three blocks of 23, 23 and 18
bits.  On each 23-bit block the anchors are the 4096 words of the perfect
binary Golay code (covering radius 3: every block value has exactly one anchor
within 3 bits, its *home*); on the 18-bit block every value is an anchor
(radius 0).  Two fingerprints within ``max_bits`` are within ``t_b`` bits on at
least one block b when ``sum(t_b + 1) = max_bits + 1`` (for 4: 1, 1 and 0), so
one lies at its home anchor and the other within ``radius + t_b`` of that
anchor.  Each fingerprint is therefore sent to every anchor within
``radius + t_b``; only those at home are compared with all that came.

Scale: equal fingerprints collapse first (one row per distinct value, with its
smallest key), so copies cost nothing.  An anchor with more than ``block_rows``
rows is dealt in a grid of blocks, each pair of blocks a task of its own.  A
task emits a forest of links (at most one per row and block pair), never all
pairs.  Components come from alternating large-star and small-star rounds,
each written to the shared folder.

Null or blank texts have no words: fingerprint zero, linked like any other.
Repeated rows each get their own output row.  A null key never becomes a
component id unless its whole component has none.  A bit that exactly half of
the shingles set is 0.  Very long texts are hashed whole, some thousand shingles
at a time.  Empty tables give empty results; other columns are not read, and
``one_of_each`` keeps them whatever their names are.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigilo.llm.common import by_batch_of, documents, in_arrow, pick, spare, written

SHINGLE, MAX_BITS, SEED = 4, 4, 42
GOLAY_BITS, GOLAY_RADIUS, GOLAY_POLY = 23, 3, 0b101011100011
EXACT_BITS = 64 - 2 * GOLAY_BITS
BLOCK_ROWS = 16384
COMPARE_CELLS = 1 << 21


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint of one text as an unsigned integer."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    digest = xxhash.xxh64_digest
    if len(words) <= shingle:
        return int.from_bytes(digest(line, SEED), "big")
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[:-shingle]]
    raw = b"".join([digest(line[s:e - 1], SEED) for s, e in zip(starts, ends[shingle - 1:], strict=True)])
    ones = np.zeros(64, dtype=np.int64)
    cells = np.frombuffer(raw, dtype=np.uint8).reshape(-1, 8)
    for at in range(0, len(cells), 4096):
        ones += np.unpackbits(cells[at:at + 4096], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(cells)).tobytes(), "big")


def fingerprints(df: DataFrame, key: str, text: str, shingle: int = SHINGLE) -> DataFrame:
    """(key, mark, fp): one row per input row, fp the fingerprint as a signed
    long, mark Spark's xxhash64 of the text (rows that share a key differ by it)."""
    def run(keys: list, texts: list) -> dict[str, list]:
        fps = np.array([fingerprint(t, shingle) for t in texts], dtype=np.uint64).view(np.int64)
        marks = np.array([SEED if t is None else xxhash.xxh64_intdigest(t, SEED) for t in texts], dtype=np.uint64).view(np.int64)
        return {"key": keys, "mark": pa.array(marks), "fp": pa.array(fps)}
    return by_batch_of(pick(df, key, text), run, "key long, mark long, fp long")


def _syndromes(width: int) -> np.ndarray:
    """Remainder modulo the Golay generator polynomial of every byte at each
    byte position: [3, 256]."""
    def rem(x: int) -> int:
        for b in range(width - 1, 10, -1):
            if x >> b & 1:
                x ^= GOLAY_POLY << (b - 11)
        return x
    return np.array([[rem((v << 8 * i) & ((1 << width) - 1)) for v in range(256)] for i in range(3)], dtype=np.int64)


def golay_offsets(reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(syndrome tables, offsets [2048, k], home offset [2048]): ``block ^
    offset`` is each anchor within ``reach`` bits of a block with that
    syndrome; unused places repeat the home offset."""
    tables = _syndromes(GOLAY_BITS)
    found: list[list[int]] = [[] for _ in range(2048)]
    for weight in range(reach + 1):
        for bits in combinations(range(GOLAY_BITS), weight):
            e = sum(1 << b for b in bits)
            found[tables[0][e & 255] ^ tables[1][e >> 8 & 255] ^ tables[2][e >> 16]].append(e)
    most = max(map(len, found))
    home = np.array([f[0] for f in found], dtype=np.int64)
    return tables, np.array([f + [f[0]] * (most - len(f)) for f in found], dtype=np.int64), home


def thresholds(max_bits: int) -> tuple[int, int, int]:
    """Bits allowed on each block: of all blocks at least one is within its own."""
    share, rest = divmod(max_bits + 1, 3)
    return tuple(share + (i < rest) - 1 for i in range(3))


def anchors(fps: np.ndarray, max_bits: int, tables: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor key, row index, at home) of every anchor that each fingerprint visits."""
    rows, keys, homes = [], [], []
    u = fps.view(np.uint64)
    index = np.arange(len(u))
    for b, t in enumerate(thresholds(max_bits)):
        if t < 0:
            continue
        if b < 2:
            block = (u >> np.uint64(GOLAY_BITS * b)).astype(np.int64) & ((1 << GOLAY_BITS) - 1)
            rem, offsets, home = tables[b]
            syn = rem[0][block & 255] ^ rem[1][block >> 8 & 255] ^ rem[2][block >> 16]
            found, own = block[:, None] ^ offsets[syn], block ^ home[syn]
        else:
            block = (u >> np.uint64(2 * GOLAY_BITS)).astype(np.int64)
            near = [sum(1 << x for x in c) for w in range(t + 1) for c in combinations(range(EXACT_BITS), w)]
            found, own = block[:, None] ^ np.array(near, dtype=np.int64), block
        at_home = found == own[:, None]
        keep = ~at_home
        keep[:, 0] = True  # the first offset is the home anchor; repeats of it are padding
        r, c = np.nonzero(keep)
        rows.append(index[r])
        keys.append(found[r, c] << 2 | b)
        homes.append(at_home[r, c])
    return np.concatenate(keys), np.concatenate(rows), np.concatenate(homes)


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (i, smallest i of its component) that connect what the links a-b connect."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        while True:
            hop = new[new]
            if np.array_equal(hop, new):
                break
            new = hop
        if np.array_equal(new, label):
            break
        label = new
    moved = np.nonzero(label != np.arange(n))[0]
    return moved, label[moved]


def links_at_anchor(homes: np.ndarray, members: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect each home fingerprint with all members within
    ``max_bits``, reduced to a forest as they are found."""
    every, place = np.unique(np.concatenate([homes, members]), return_inverse=True)
    at_home, at = place[:len(homes)], place[len(homes):]
    u, m = homes.view(np.uint64), members.view(np.uint64)
    left, right, held = [], [], 0
    step = max(1, COMPARE_CELLS // max(1, len(m)))
    for s in range(0, len(u), step):
        i, j = np.nonzero(np.bitwise_count(u[s:s + step, None] ^ m[None, :]) <= max_bits)
        a, b = at_home[s + i], at[j]
        keep = a != b
        left.append(a[keep])
        right.append(b[keep])
        held += int(keep.sum())
        if held > 4 * len(every) + 4096:
            a, b = _forest(np.concatenate(left), np.concatenate(right), len(every))
            left, right, held = [a], [b], len(a)
    a, b = np.concatenate([*left, np.zeros(0, int)]).astype(int), np.concatenate([*right, np.zeros(0, int)]).astype(int)
    if len(a):
        a, b = _forest(a, b, len(every))
    return every[a], every[b]


def links(fps: DataFrame, max_bits: int = MAX_BITS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(a, b): links between distinct fingerprints (column ``fp``) that give the
    same components as all pairs within ``max_bits``."""
    spark = fps.sparkSession

    def visits(batches: Iterator[pa.RecordBatch], blocks: dict[int, int] | None):
        tables = [golay_offsets(GOLAY_RADIUS + t) if t >= 0 else None for t in thresholds(max_bits)[:2]]
        hot = np.array(sorted(blocks or ()), dtype=np.int64)
        cut = np.array([blocks[k] for k in hot.tolist()], dtype=np.int64) if blocks else hot
        for batch in batches:
            all_fp = batch.column("fp").to_numpy(zero_copy_only=False)
            for s in range(0, len(all_fp), 1 << 15):
                fp = all_fp[s:s + (1 << 15)]
                key, row, home = anchors(fp, max_bits, tables)
                fp = fp[row]
                if blocks is None:
                    yield pa.RecordBatch.from_pydict({"anchor": key})
                    continue
                n = np.ones(len(key), dtype=np.int64)
                if len(hot):
                    at = np.minimum(np.searchsorted(hot, key), len(hot) - 1)
                    n = np.where(hot[at] == key, cut[at], 1)
                own = (fp.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % n
                # As members, rows of block j go to the tasks (i, j) of every i; at
                # home, rows of block i to the tasks (i, j) of every j.
                for as_home in (False, True):
                    k = np.nonzero(home)[0] if as_home else np.arange(len(key))
                    many = n[k]
                    r = np.repeat(k, many)
                    other = np.arange(len(r)) - np.repeat(np.cumsum(many) - many, many)
                    task = own[r] * n[r] + other if as_home else other * n[r] + own[r]
                    yield pa.RecordBatch.from_pydict({
                        "anchor": key[r], "task": task, "home": np.full(len(r), as_home), "fp": fp[r]})

    sizes = in_arrow(fps, lambda it: visits(it, None), "anchor long").groupBy("anchor").count()
    # At most 2 * 4096 + 2^18 anchors exist; only those over the block size come here.
    blocks = {r["anchor"]: -(-r["count"] // block_rows) for r in sizes.filter(F.col("count") > block_rows).collect()}
    dealt = (in_arrow(fps, lambda it: visits(it, blocks), "anchor long, task long, home boolean, fp long")
             .repartition("anchor", "task").sortWithinPartitions("anchor", "task"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def groups(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held
            if not held:
                return
            anchor, task, home, fp = (np.concatenate(c) for c in zip(*held, strict=True))
            edge = np.nonzero((np.diff(anchor) != 0) | (np.diff(task) != 0))[0] + 1
            bounds = [0, *edge.tolist(), len(anchor)]
            if not last:
                held = [(anchor[bounds[-2]:], task[bounds[-2]:], home[bounds[-2]:], fp[bounds[-2]:])]
                bounds.pop()
            else:
                held = []
            left, right = [], []
            for s, e in zip(bounds, bounds[1:], strict=False):
                h = home[s:e]
                if e - s > 2 and h.any():
                    a, b = links_at_anchor(fp[s:e][h], fp[s:e][~h], max_bits)
                    left.append(a)
                    right.append(b)
            if left:
                yield pa.RecordBatch.from_pydict({"a": np.concatenate(left), "b": np.concatenate(right)})

        for batch in batches:
            held.append(tuple(batch.column(c).to_numpy(zero_copy_only=False) for c in ("anchor", "task", "home", "fp")))
            if sum(len(h[0]) for h in held) >= 1 << 17 or held[0][0][0] != held[-1][0][-1]:
                yield from groups(False)
        yield from groups(True)

    return in_arrow(dealt, compare, "a long, b long").filter("a <> b")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): root is the smallest node of the component, for every node
    that has a link.  Alternating large-star / small-star rounds; each round is
    two equi-joins on the node, whose hot sides the adaptive planner splits."""
    edges = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                    .filter("u <> v").distinct(), "simhash-links")
    seen = None
    while True:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        small_low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_low, "u")
        edges = written(small.select(F.col("v").alias("u"), F.col("m").alias("v"))
                        .unionAll(small_low.select("u", F.col("m").alias("v")))
                        .filter("u <> v").distinct(), "simhash-links")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = tuple(state)


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
                    max_bits: int = MAX_BITS) -> DataFrame:
    """(key, mark, fp, root, component): one row per input row; component is the
    smallest key reachable over links of at most ``max_bits`` differing bits,
    root names the component also where no key does."""
    rows = written(fingerprints(df, key, text, shingle), "simhash-fp")
    values = written(rows.groupBy("fp").agg(F.min("key").alias("low"), F.count("*").alias("n")), "simhash-values")
    roots = components(links(values.select("fp"), max_bits))
    placed = written(values.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
                     .select("fp", "low", F.coalesce("root", "fp").alias("root")), "simhash-placed")
    low = placed.groupBy("root").agg(F.min("low").alias("component"))
    of = placed.join(low, "root").select("fp", "root", "component")
    return rows.join(of, "fp").select("key", "mark", "fp", "root", "component")


def one_of_each(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
                max_bits: int = MAX_BITS) -> DataFrame:
    """One row of ``df`` for each component, all columns as they are: the one with
    the smallest key (none last), then the smallest text hash; of rows that
    share both, the first by its other columns."""
    cols = df.columns
    found = near_duplicates(df, key, text, shingle, max_bits)
    same = found.groupBy("root", "key", "mark").agg(F.count("*").alias("rows"))
    low = same.groupBy("root").agg(F.min(F.struct(F.col("key").isNull().alias("none"), "key", "mark", "rows")).alias("low"))
    k_key, k_mark, k_rows, k_nth = spare(df, "kept_key", "kept_mark", "kept_rows", "kept_nth")
    keep = low.select(*[F.col(f"low.{c}").alias(n) for c, n in (("key", k_key), ("mark", k_mark), ("rows", k_rows))])
    kept = df.join(keep, F.col(f"`{key}`").eqNullSafe(F.col(k_key)) & (F.xxhash64(F.col(f"`{text}`")) == F.col(k_mark)))
    # Equal rows are rare; only those are put in order.
    by = Window.partitionBy(k_key, k_mark).orderBy(*[F.col(f"`{c}`").asc_nulls_last() for c in cols if c not in (key, text)], F.lit(0))
    again = kept.filter(F.col(k_rows) > 1).withColumn(k_nth, F.row_number().over(by)).filter(F.col(k_nth) == 1)
    return kept.filter(F.col(k_rows) == 1).select(*[F.col(f"`{c}`") for c in cols]).unionAll(again.select(*[F.col(f"`{c}`") for c in cols]))


def op3(spark, sf_dir: str) -> DataFrame:
    """``op3_simhash``: fingerprint and component of every document."""
    out = near_duplicates(documents(spark, sf_dir))
    return out.select(F.col("key").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                      F.col("component").alias("component_id"))
