"""A regression forest over many rows, grown from histograms of binned columns.

The forest is the one that MLlib's ``RandomForestRegressor`` grows: the same
bins (at most ``maxBins``, placed by the same rule on as many sampled rows),
Poisson bootstrap weights of every row in every tree, the same choice of
features at a node, the same gain, limits and pruning, and it comes out as an
MLlib model.  Only the order of the work differs, so bootstrap draws do too.
MLlib takes each row to each tree one number at a time, in statistics that
hold all nodes of many trees; here

1. rows are binned once and written as chunks, one byte a column (columns that
   bin all rows alike are worked on once);
2. a pass over the chunks makes the histograms of one level of all trees, tree by
   tree within a chunk; they are added by (tree, block of nodes) and each block
   chooses its splits;
3. a deep forest goes on so only with nodes of more than ``LOCAL_ROWS`` rows.
   The rows of smaller nodes are shuffled, some nodes of one tree to a task,
   which grows the whole subtrees;
4. the parts of a tree are put together as rows of MLlib's saved form, and the
   model is loaded from there.

A row's weight follows from (seed, tree, chunk), so a pass that runs again sees
the same sample.  What a task holds is bounded: a chunk, the histograms of
``HISTOGRAM_BYTES``, or ``LOCAL_ROWS`` rows.  The driver holds the upper part
of the trees and, as with MLlib, the model.
"""

from __future__ import annotations

import json
import math
import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.ml.util import DefaultParamsWriter, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilo.session import scratch_path

CHUNK_ROWS, CHUNKS_A_FILE = 32_768, 64
#: Rows (with their weights) whose subtrees one task grows, nodes in a block of
#: histograms, bytes of histograms that a task holds and of rows dealt at once.
LOCAL_ROWS, BLOCK_NODES, HISTOGRAM_BYTES, DEAL_BYTES = 1_000_000, 32, 256 << 20, 8 << 30
#: Forests up to this depth are grown by passes alone; none deeper than the
#: second or with more bins than the third is grown here.
PASS_DEPTH, MOST_DEPTH, MOST_BINS = 10, 16, 62
#: Means that differ by less than this share of the labels' size are equal.
EQUAL_MEANS = 1e-9

#: What is known of a node; ``left`` is itself where it has no children (the
#: right child follows the left), ``mask`` has a bit for each bin that goes left.
NODE = np.dtype([(c, "<i8") for c in ("feature", "bin", "column", "mask", "left")]
                + [(c, "<f8") for c in ("n", "s", "q", "gain", "n_left")])
# Weights are Poisson(1): the number of these edges that a 32-bit draw reaches.
EDGES = [min(2**32 - 1, round(2**32 * sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)))) for k in range(12)]

SAVED = ("treeID int, nodeData struct<id int, prediction double, impurity double, impurityStats array<double>, rawCount long, "
         "gain double, leftChild int, rightChild int, split struct<featureIndex int, leftCategoriesOrThreshold array<double>, "
         "numCategories int>>")


def grows(forest: RandomForestRegressor) -> bool:
    """Whether :func:`grow` knows all of the forest's settings."""
    return (forest.getNumTrees() > 1 and forest.getBootstrap() and forest.getSubsamplingRate() == 1.0
            and forest.getImpurity() == "variance" and forest.getMaxBins() <= MOST_BINS and forest.getMaxDepth() <= MOST_DEPTH
            and forest.getMinWeightFractionPerNode() == 0.0 and not forest.isDefined("weightCol")
            and forest.getFeatureSubsetStrategy() in ("auto", "all", "onethird"))


def arities(schema, column: str) -> dict[int, int]:
    """Categories of the features that a vector column names as nominal."""
    named = schema[column].metadata.get("ml_attr", {}).get("attrs", {}).get("nominal", [])
    return {a["idx"]: int(a.get("num_vals") or len(a.get("vals", []))) for a in named if a.get("num_vals") or a.get("vals")}


def thresholds(values: np.ndarray, bins: int) -> np.ndarray:
    """MLlib's candidate splits of a continuous feature: between neighbours
    where they are few, else where the counts come nearest to equal parts."""
    held, counts = np.unique(values, return_counts=True)
    middle = (held[:-1] + held[1:]) / 2
    if len(middle) < bins:
        return middle
    upto, out = np.cumsum(counts), []
    stride = upto[-1] / bins
    target = stride
    for i in range(1, len(held)):
        if abs(upto[i - 1] - target) < abs(upto[i] - target):
            out.append(middle[i - 1])
            target += stride
    return np.array(out)


def weights(seed: int, tree: int, chunk: int, n: int) -> np.ndarray:
    drawn = np.random.Generator(np.random.SFC64([seed, tree, chunk])).integers(0, 2**32, n, dtype=np.uint32)
    out = np.zeros(n, np.uint8)
    for edge in EDGES:
        out += drawn >= np.uint32(edge)
    return out


def _matrix(column: pa.ListArray) -> np.ndarray:
    if column.null_count or column.flatten().null_count:
        raise ValueError("features must not be null")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def binned(edges: list, kinds: list[int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Chunks of binned rows: a byte a column, column by column, then the labels;
    ``twin`` is for each column the first one that bins the chunk's rows alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part, made, held, n = TaskContext.get().partitionId(), 0, [], 0

        def chunk() -> pa.RecordBatch:
            x, y = np.concatenate([a for a, _ in held]), np.concatenate([b for _, b in held])
            if not (np.isfinite(x).all() and np.isfinite(y).all()):
                raise ValueError("features and labels must be finite numbers")
            bins = np.empty((len(edges), len(y)), np.uint8)
            for f, cut in enumerate(edges):
                if kinds[f]:
                    if (x[:, f] != np.floor(x[:, f])).any() or x[:, f].min() < 0 or x[:, f].max() >= kinds[f]:
                        raise ValueError(f"feature {f} has {kinds[f]} categories, but others are met")
                    bins[f] = x[:, f]
                else:
                    bins[f] = np.searchsorted(cut, x[:, f], "left")
            twin = [next(g for g in range(f + 1) if kinds[g] == kinds[f] and np.array_equal(bins[g], bins[f])) for f in range(len(edges))]
            return pa.RecordBatch.from_pydict({
                "chunk": pa.array([part << 32 | made], pa.int64()), "n": pa.array([len(y)], pa.int64()),
                "bins": [bins.tobytes()], "labels": [y.tobytes()], "twin": pa.array([twin], pa.list_(pa.int32()))})

        for batch in batches:
            if batch.column(1).null_count:
                raise ValueError("labels must not be null")
            x, y = _matrix(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False).astype(np.float64)
            for at in range(0, len(y), CHUNK_ROWS):
                held.append((x[at:at + CHUNK_ROWS], y[at:at + CHUNK_ROWS]))
                n += len(held[-1][1])
                if n >= CHUNK_ROWS:
                    yield chunk()
                    held, n, made = [], 0, made + 1
        if n:
            yield chunk()

    return run


def place(tree: np.ndarray, bins: np.ndarray, depth: int) -> np.ndarray:
    """The node that each row has reached."""
    n = bins.shape[1]
    flat, rows, node = np.ascontiguousarray(bins).reshape(-1), np.arange(n), np.zeros(n, np.int64)
    column, mask, left = (np.ascontiguousarray(tree[c]) for c in ("column", "mask", "left"))
    column = column * n
    for _ in range(depth):
        node = left.take(node) + (~(mask.take(node) >> flat.take(column.take(node) + rows)) & 1)
    return node


def _chunks(batches: Iterator[pa.RecordBatch], columns: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for batch in batches:
        for chunk, n, bins, labels in zip(*(batch.column(c) for c in ("chunk", "n", "bins", "labels"))):
            rows = np.frombuffer(bins.as_buffer(), np.uint8).reshape(-1, n.as_py())
            yield chunk.as_py(), rows[columns], np.frombuffer(labels.as_buffer(), np.float64)


def _in_bag(seed: int, tree: int, chunk: int, bins: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    w = weights(seed, tree, chunk, len(labels))
    drawn = np.flatnonzero(w)
    return bins.take(drawn, axis=1), w.take(drawn), labels.take(drawn)


class Spec:
    """What the tasks have to know of the forest; columns that are alike are one."""

    def __init__(self, forest: RandomForestRegressor, twin: list[int], counts: list[int], kinds: list[int]) -> None:
        self.columns = sorted(set(twin))
        self.of = np.array([self.columns.index(t) for t in twin])
        self.counts, self.kinds = [counts[c] for c in self.columns], [kinds[c] for c in self.columns]
        self.width = max([*self.counts, 1])
        self.depth, self.least, self.least_gain = forest.getMaxDepth(), forest.getMinInstancesPerNode(), forest.getMinInfoGain()
        self.seed = forest.getSeed() & (2**63 - 1)
        self.shown = len(twin) if forest.getFeatureSubsetStrategy() == "all" else -(-len(twin) // 3)

    def totals(self, slot: np.ndarray, w: np.ndarray, wy: np.ndarray, y: np.ndarray, nodes: int) -> np.ndarray:
        return np.stack([np.bincount(slot, v, nodes) for v in (w, wy, wy * y)])

    def histogram(self, c: int, base: np.ndarray, bins: np.ndarray, w: np.ndarray, wy: np.ndarray, nodes: int) -> np.ndarray:
        at = base + bins[c]
        return np.stack([np.bincount(at, v, nodes * self.width) for v in (w, wy)])

    def choose(self, histogram: Callable[[int], np.ndarray], totals: np.ndarray, rng: list[int]) -> np.ndarray:
        """The best split of every node, if any; ``histogram(c)`` gives counts and
        label sums (2, nodes x bins) of a column."""
        n, s, q = totals
        nodes, features = len(n), len(self.of)
        out = _leaves(totals)
        gains, places = np.full((len(self.columns), nodes), -np.inf), np.zeros((len(self.columns), nodes), np.int64)
        lefts, masks, every = np.zeros_like(gains), np.zeros_like(places), np.arange(nodes)
        least, mean = max(1, self.least), (s / np.maximum(n, 1))[:, None]
        with np.errstate(divide="ignore", invalid="ignore"):
            for c, (count, kind) in enumerate(zip(self.counts, self.kinds)):
                if count < 2:
                    continue
                cn, cs = histogram(c).reshape(2, nodes, self.width)[:, :, :count]
                order = None
                if kind:   # categories in the order of their mean labels, those without rows last
                    order = np.argsort(np.where(cn > 0, cs / cn, np.inf), axis=1, kind="stable")
                    cn, cs = np.take_along_axis(cn, order, 1), np.take_along_axis(cs, order, 1)
                nl = cn.cumsum(1)[:, :-1]
                off = cs.cumsum(1)[:, :-1] - nl * mean   # what the left side is above the node's mean
                nr = n[:, None] - nl
                gain = np.where((nl >= least) & (nr >= least), off * off / (nl * nr), -np.inf)
                at = gain.argmax(1)
                gains[c], places[c], lefts[c] = gain[every, at], at, nl[every, at]
                masks[c] = np.where(np.arange(count) <= at[:, None], np.int64(1) << order, 0).sum(1) if kind else (np.int64(2) << at) - 1
        gains[gains < self.least_gain] = -np.inf
        wide = gains[self.of]
        if self.shown < features:
            shown = np.random.default_rng(rng).random((nodes, features)).argsort(1).argsort(1).T < self.shown
            wide = np.where(shown, wide, -np.inf)
        feature = wide.argmax(0)
        column = self.of[feature]
        split = np.flatnonzero(wide[feature, every] > EQUAL_MEANS**2 * q / np.maximum(n, 1))
        for name, value in (("feature", feature), ("column", column), ("bin", places[column, every]), ("mask", masks[column, every]),
                            ("gain", gains[column, every]), ("n_left", lefts[column, every])):
            out[name][split] = value[split]
        return out


def _added(tree: np.ndarray, at: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``tree`` with what was found for its nodes ``at``, and their children."""
    found = found.copy()
    split = found["feature"] >= 0
    found["left"] = np.where(split, len(tree) + 2 * (np.cumsum(split) - 1), at)
    tree[at] = found
    fresh = np.zeros(2 * int(split.sum()), NODE)
    fresh["feature"], fresh["mask"], fresh["left"] = -1, -1, len(tree) + np.arange(len(fresh))
    fresh["n"][0::2] = found["n_left"][split]
    fresh["n"][1::2] = (found["n"] - found["n_left"])[split]
    return np.concatenate([tree, fresh]), fresh["left"].copy()


def _root() -> np.ndarray:
    tree = np.zeros(1, NODE)
    tree["feature"], tree["mask"] = -1, -1
    return tree


def level_pass(chunks: DataFrame, spec: Spec, tops: dict[int, np.ndarray], open_: dict[int, np.ndarray], level: int) -> dict[int, np.ndarray]:
    """What one pass over all rows finds for the open nodes of some trees, all at
    the same level."""
    sc = chunks.sparkSession.sparkContext
    last, columns, seed = level == spec.depth, spec.columns, spec.seed
    shared = sc.broadcast((tops, open_))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, frontier = shared.value
        slots, sums, held = {}, {}, {}
        for t, nodes in frontier.items():
            slots[t] = np.full(len(trees[t]), len(nodes), np.int64)
            slots[t][nodes] = np.arange(len(nodes))
            sums[t] = np.zeros((3, len(nodes)))
            held[t] = None if last else np.zeros((len(columns), 2, len(nodes) * spec.width))
        met = False
        for chunk, bins, labels in _chunks(batches, columns):
            met = True
            for t, nodes in frontier.items():
                mine, w, y = _in_bag(seed, t, chunk, bins, labels)
                slot = slots[t].take(place(trees[t], mine, level))
                if len(nodes) < 1 << level:   # some rows are in nodes that are done
                    here = np.flatnonzero(slot < len(nodes))
                    mine, w, y, slot = mine.take(here, axis=1), w.take(here), y.take(here), slot.take(here)
                w = w.astype(np.float64)
                wy = w * y
                sums[t] += spec.totals(slot, w, wy, y, len(nodes))
                if not last:
                    base = slot * spec.width
                    for c in range(len(columns)):
                        held[t][c] += spec.histogram(c, base, mine, w, wy, len(nodes))
        for t, nodes in frontier.items() if met else ():
            blocks = range(0, len(nodes), BLOCK_NODES)
            wide = None if last else held.pop(t).reshape(len(columns), 2, len(nodes), spec.width)
            yield pa.RecordBatch.from_pydict({
                "tree": pa.array([t] * len(blocks), pa.int32()), "block": pa.array([b // BLOCK_NODES for b in blocks], pa.int32()),
                "sums": [sums[t][:, b:b + BLOCK_NODES].tobytes() for b in blocks],
                "held": [b"" if last else wide[:, :, b:b + BLOCK_NODES].tobytes() for b in blocks]})

    def best(table: pa.Table) -> pa.Table:
        totals = sum(np.frombuffer(x.as_buffer()) for x in table["sums"]).reshape(3, -1)
        t, block = table["tree"][0].as_py(), table["block"][0].as_py()
        if last:
            found = _leaves(totals)
        else:
            wide = sum(np.frombuffer(x.as_buffer()) for x in table["held"]).reshape(len(columns), 2, -1)
            found = spec.choose(lambda c: wide[c], totals, [seed, t, level, block])
        return pa.table({"tree": pa.array([t], pa.int32()), "block": pa.array([block], pa.int32()), "nodes": [found.tobytes()]})

    tasks = chunks.sparkSession.sparkContext.defaultParallelism
    counted = chunks.coalesce(tasks).mapInArrow(count, "tree int, block int, sums binary, held binary")
    rows = counted.groupBy("tree", "block").applyInArrow(best, "tree int, block int, nodes binary").collect()
    shared.unpersist()
    out: dict[int, list] = {}
    for r in sorted(rows, key=lambda r: (r["tree"], r["block"])):
        out.setdefault(r["tree"], []).append(np.frombuffer(bytes(r["nodes"]), NODE))
    return {t: np.concatenate(found) for t, found in out.items()}


def grow_subtrees(spec: Spec, bins: np.ndarray, w: np.ndarray, y: np.ndarray, root: np.ndarray, levels: np.ndarray, rng: list[int]) -> np.ndarray:
    """The whole subtrees of some nodes; ``root`` is each row's, from 0.  A
    level goes on with the rows of nodes that can still be split."""
    tree = np.zeros(len(levels), NODE)
    tree["feature"], tree["mask"], tree["left"] = -1, -1, np.arange(len(levels))
    open_, slot, w, level = np.arange(len(levels)), root, w.astype(np.float64), levels.copy()
    while len(open_):
        wy = w * y
        totals = spec.totals(slot, w, wy, y, len(open_))
        found = _leaves(totals)
        on = np.flatnonzero((level < spec.depth) & (totals[0] >= 2 * max(1, spec.least)))
        if not len(on):
            tree[open_] = found
            tree["left"][open_] = open_
            return tree
        nth = np.full(len(open_), -1)
        nth[on] = np.arange(len(on))
        to = nth.take(slot)
        if len(on) < len(open_):
            here = np.flatnonzero(to >= 0)
            bins, w, y, wy, slot, to = bins.take(here, axis=1), w.take(here), y.take(here), wy.take(here), slot.take(here), to.take(here)
        base = to * spec.width
        found[on] = spec.choose(lambda c: spec.histogram(c, base, bins, w, wy, len(on)), totals[:, on], [*rng, int(open_[0])])
        split = found["feature"] >= 0
        tree, fresh = _added(tree, open_, found)
        goes = (~(found["mask"].take(slot) >> bins.reshape(-1).take(found["column"].take(slot) * len(y) + np.arange(len(y))))) & 1
        slot = np.where(split, 2 * (np.cumsum(split) - 1), -1).take(slot)
        if split[on].all():
            slot += goes
        else:
            here = np.flatnonzero(slot >= 0)
            slot = slot.take(here) + goes.take(here)
            bins, w, y = bins.take(here, axis=1), w.take(here), y.take(here)
        level, open_ = np.repeat(level[split] + 1, 2), fresh
    return tree


def _attached(tree: np.ndarray, roots: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """``tree`` with the subtrees of its nodes ``roots``, which come first in ``nodes``."""
    number, nodes = np.concatenate([roots, len(tree) + np.arange(len(nodes) - len(roots))]), nodes.copy()
    nodes["left"] = number[nodes["left"]]
    tree[roots] = nodes[:len(roots)]
    return np.concatenate([tree, nodes[len(roots):]])


def _leaves(totals: np.ndarray) -> np.ndarray:
    out = np.zeros(totals.shape[1], NODE)
    out["feature"], out["mask"] = -1, -1
    out["n"], out["s"], out["q"] = totals
    return out


def dealt(chunks: DataFrame, spec: Spec, tops: dict[int, np.ndarray], groups: dict[int, np.ndarray], levels: dict[int, np.ndarray],
          parts: int) -> DataFrame:
    """``(tree, roots, nodes)``: the subtrees below the nodes that have a group."""
    columns, seed = spec.columns, spec.seed
    depth = max((int(x.max()) for x in levels.values() if len(x)), default=0)
    shared = chunks.sparkSession.sparkContext.broadcast((tops, groups, levels))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, grouped, _ = shared.value
        for chunk, bins, labels in _chunks(batches, columns):
            for t, group in grouped.items():
                mine, w, y = _in_bag(seed, t, chunk, bins, labels)
                node = place(trees[t], mine, depth)
                to = group.take(node)
                order = np.argsort(to.astype(np.int16), kind="stable")
                ends = np.searchsorted(to.take(order), np.arange(int(group.max()) + 2))
                out: dict[str, list] = {c: [] for c in ("tree", "part", "bins", "w", "y", "node")}
                for g, (a, b) in enumerate(zip(ends, ends[1:])):
                    if a < b:
                        at = order[a:b]
                        for c, v in zip(out, (t, g, mine.take(at, axis=1).tobytes(), w.take(at).tobytes(), y.take(at).tobytes(),
                                              node.take(at).astype(np.int32).tobytes())):
                            out[c].append(v)
                yield pa.RecordBatch.from_arrays([pa.array(out["tree"], pa.int32()), pa.array(out["part"], pa.int32()),
                                                  *(pa.array(out[c], pa.binary()) for c in ("bins", "w", "y", "node"))], names=list(out))

    def subtrees(table: pa.Table) -> pa.Table:
        _, grouped, deep = shared.value
        t, g = table["tree"][0].as_py(), table["part"][0].as_py()
        read = lambda c, kind: [np.frombuffer(x.as_buffer(), kind) for x in table[c]]
        bins = np.concatenate([x.reshape(len(columns), -1) for x in read("bins", np.uint8)], axis=1)
        w, y, node = (np.concatenate(read(c, kind)) for c, kind in (("w", np.uint8), ("y", np.float64), ("node", np.int32)))
        roots = np.flatnonzero(grouped[t] == g)
        at = np.zeros(len(grouped[t]), np.int64)
        at[roots] = np.arange(len(roots))
        grown = grow_subtrees(spec, bins, w, y, at.take(node), deep[t][roots], [seed, t, g])
        return pa.table({"tree": pa.array([t], pa.int32()), "roots": [roots.tobytes()], "nodes": [grown.tobytes()]})

    tasks = chunks.sparkSession.sparkContext.defaultParallelism
    rows = chunks.coalesce(tasks).mapInArrow(deal, "tree int, part int, bins binary, w binary, y binary, node binary")
    return rows.repartition(parts, "tree", "part").groupBy("tree", "part").applyInArrow(subtrees, "tree int, roots binary, nodes binary")


def pruned(tree: np.ndarray) -> np.ndarray:
    """Without siblings that predict the same, and numbered anew; a child always
    comes after its parent."""
    mean = tree["s"] / np.maximum(tree["n"], 1)
    while True:
        leaf = tree["feature"] < 0
        inner = np.flatnonzero(~leaf)
        left = tree["left"][inner]
        same = inner[leaf[left] & leaf[left + 1] & (mean[left] == mean[left + 1])]
        if not len(same):
            break
        tree["feature"][same], tree["left"][same] = -1, same
    kept = np.zeros(len(tree), bool)
    kept[0] = True
    for i in np.flatnonzero(tree["feature"] >= 0):   # parents first
        if kept[i]:
            kept[tree["left"][i]] = kept[tree["left"][i] + 1] = True
    number = np.cumsum(kept) - 1
    out = tree[kept]
    out["left"] = number[out["left"]]
    return out


def assemble(edges: list, kinds: list[int]) -> Callable[[pa.Table], pa.Table]:
    """The parts of one tree as rows of MLlib's saved form."""

    def run(table: pa.Table) -> pa.Table:
        parts = sorted(zip(*(table[c].to_pylist() for c in ("roots", "nodes"))), key=lambda p: (len(p[0]) > 0, p[0]))
        tree = np.frombuffer(parts[0][1], NODE).copy()
        for roots, nodes in parts[1:]:
            tree = _attached(tree, np.frombuffer(roots, np.int64), np.frombuffer(nodes, NODE))
        tree = pruned(tree)
        n, s, q = tree["n"], tree["s"], tree["q"]
        inner = tree["feature"] >= 0
        left = np.where(inner, tree["left"], -1)
        by = np.array([0] + [0 if not i else bin(int(m)).count("1") if kinds[f] else 1
                             for i, f, m in zip(inner, tree["feature"], tree["mask"])]).cumsum()
        values = [v for i, f, b, m in zip(inner, tree["feature"], tree["bin"], tree["mask"]) if i
                  for v in ([float(k) for k in range(kinds[f]) if m >> k & 1] if kinds[f] else [edges[f][b]])]
        i32 = lambda x: pa.array(np.asarray(x, np.int32))
        split = pa.StructArray.from_arrays(
            [i32(tree["feature"]), pa.ListArray.from_arrays(i32(by), pa.array(values, pa.float64())),
             i32([kinds[f] if i and kinds[f] else -1 for i, f in zip(inner, tree["feature"])])],
            names=["featureIndex", "leftCategoriesOrThreshold", "numCategories"])
        stats = pa.ListArray.from_arrays(i32(np.arange(len(n) + 1) * 3), pa.array(np.stack([n, s, q], 1).reshape(-1)))
        data = pa.StructArray.from_arrays(
            [i32(np.arange(len(n))), pa.array(s / np.maximum(n, 1)), pa.array(np.maximum(q / np.maximum(n, 1) - (s / np.maximum(n, 1)) ** 2, 0)),
             stats, pa.array(n.astype(np.int64)), pa.array(np.where(inner, tree["gain"], -1.0)), i32(left), i32(np.where(inner, left + 1, -1)), split],
            names=["id", "prediction", "impurity", "impurityStats", "rawCount", "gain", "leftChild", "rightChild", "split"])
        return pa.table({"treeID": pa.array([table["tree"][0].as_py()] * len(n), pa.int32()), "nodeData": data})

    return run


def _packed(sizes: np.ndarray) -> np.ndarray:
    """A group for each node, in their order, of at most ``LOCAL_ROWS`` rows."""
    out, group, rows = np.zeros(len(sizes), np.int64), 0, 0.0
    for i, n in enumerate(sizes):
        if rows and rows + n > LOCAL_ROWS:
            group, rows = group + 1, 0.0
        out[i], rows = group, rows + n
    return out


def flat(table: pa.Table) -> pa.Table:
    """A saved tree as plain arrays: feature, threshold (or a bit for each
    category that goes left), left child (itself at a leaf), prediction."""
    nodes = table["nodeData"].combine_chunks()
    nodes = nodes.take(pa.array(np.argsort(nodes.field("id").to_numpy(zero_copy_only=False))))
    number = lambda c, kind: nodes.field(c).to_numpy(zero_copy_only=False).astype(kind)
    left, split = number("leftChild", np.int64), nodes.field("split")
    inner = left >= 0
    feature = split.field("featureIndex").to_numpy(zero_copy_only=False)
    by, kinds = split.field("leftCategoriesOrThreshold"), split.field("numCategories").to_numpy(zero_copy_only=False)
    at, values = by.offsets.to_numpy(), by.values.to_numpy(zero_copy_only=False)
    cut, mask = np.full(len(left), np.inf), np.zeros(len(left), np.int64)
    plain = np.flatnonzero(inner & (kinds < 0))
    cut[plain] = values[at[plain]]
    for i in np.flatnonzero(inner & (kinds >= 0)):
        mask[i] = sum(1 << int(c) for c in values[at[i]:at[i + 1]])
    out = {"feature": np.where(inner, feature, 0).astype(np.int16), "cut": cut, "left": np.where(inner, left, np.arange(len(left))).astype(np.int32),
           "right": np.where(inner, number("rightChild", np.int64), np.arange(len(left))).astype(np.int32),
           "value": number("prediction", np.float64), "mask": mask if mask.any() else mask[:0]}
    depth, level = 0, np.zeros(1, np.int64)
    while len(level := np.concatenate([out["left"][level[inner[level]]], out["right"][level[inner[level]]]])):
        depth += 1
    return pa.table({"tree": pa.array([table["treeID"][0].as_py()], pa.int32()), "depth": pa.array([depth], pa.int32()),
                     **{c: [v.tobytes()] for c, v in out.items()}})


KINDS = {"feature": np.int16, "cut": np.float64, "left": np.int32, "right": np.int32, "value": np.float64, "mask": np.int64}


def predicted(trees: list[tuple[int, dict]], x: np.ndarray) -> np.ndarray:
    """The mean of the trees' predictions, tree by tree over all rows of ``x``."""
    n, width = x.shape
    values, rows, total = np.ascontiguousarray(x).reshape(-1), np.arange(n) * width, np.zeros(n)
    for depth, tree in trees:
        feature, children = tree["feature"].astype(np.int64), np.stack([tree["right"], tree["left"]], 1).astype(np.int64).reshape(-1)
        node = np.zeros(n, np.int64)
        for _ in range(depth):
            value = values.take(feature.take(node) + rows)
            goes = value <= tree["cut"].take(node)
            if len(tree["mask"]):
                mask = tree["mask"].take(node)
                goes = np.where(mask != 0, (mask >> np.clip(value, 0, 62).astype(np.int64)) & 1 == 1, goes)
            node = children.take(2 * node + goes)
        total += tree["value"].take(node)
    return total / len(trees)


class ForestModel(RandomForestRegressionModel):
    """MLlib's model, with its saved nodes at hand under ``path``.  It predicts
    tree by tree over batches of rows, from plain arrays, and is written from
    the saved nodes: MLlib takes each row through all trees, whose nodes no
    cache holds, and sends them as millions of objects."""

    def __init__(self, plain: RandomForestRegressionModel, path: str) -> None:
        super().__init__(plain._java_obj)
        self.plain, self.path = plain, path   # the JVM's model goes with its first wrapper
        self.shared = None
        self._resetUid(plain.uid)
        plain._copyValues(self)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        if self.getLeafCol() or not self.getPredictionCol():
            return super()._transform(dataset)
        if self.shared is None:
            spark = dataset.sparkSession
            saved = spark.read.schema(SAVED).parquet(f"{self.path}/data").groupBy("treeID").applyInArrow(
                flat, ", ".join(["tree int", "depth int", *(f"{c} binary" for c in KINDS)]))
            self.shared = spark.sparkContext.broadcast(
                [(r["depth"], {c: np.frombuffer(bytes(r[c]), kind) for c, kind in KINDS.items()})
                 for r in sorted(saved.collect(), key=lambda r: r["tree"])])
        shared, features = self.shared, self.numFeatures

        @F.arrow_udf("double")
        def predict(x: pa.Array) -> pa.Array:
            return pa.array(predicted(shared.value, x.flatten().to_numpy(zero_copy_only=False).reshape(-1, features)))

        return dataset.withColumn(self.getPredictionCol(), predict(vector_to_array(self.getFeaturesCol())))

    def write(self) -> MLWriter:
        return _ForestWriter(self)


class _ForestWriter(MLWriter):
    def __init__(self, model: ForestModel) -> None:
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        _describe(self.model, self.sparkSession, path, self.model.getNumTrees, self.model.numFeatures)
        self.sparkSession.read.schema(SAVED).parquet(f"{self.model.path}/data").write.parquet(f"{path}/data")


def _describe(held, spark, path: str, trees: int, features: int) -> None:
    """What MLlib saves beside the nodes: the parameters of forest and trees."""

    def about(kind: str, uid: str, **more) -> dict:
        said = json.loads(DefaultParamsWriter._get_metadata_to_save(held, spark, more))
        return said | {"class": f"org.apache.spark.ml.regression.{kind}", "uid": uid, "timestamp": int(time.time() * 1000)}

    of_forest = {"numTrees", "featureSubsetStrategy", "subsamplingRate", "bootstrap"}

    def tree(i: int) -> str:
        said = about("DecisionTreeRegressionModel", f"{held.uid}_{i}", numFeatures=features)
        for params in ("paramMap", "defaultParamMap"):
            said[params] = {k: v for k, v in said[params].items() if k not in of_forest}
        return json.dumps(said)

    forest = json.dumps(about("RandomForestRegressionModel", held.uid, numFeatures=features, numTrees=trees))
    spark.createDataFrame([(forest,)], "value string").coalesce(1).write.text(f"{path}/metadata")
    spark.createDataFrame([(i, tree(i), 1.0) for i in range(trees)], "_1 int, _2 string, _3 double").coalesce(1) \
        .write.parquet(f"{path}/treesMetadata")


def grow(forest: RandomForestRegressor, rows: DataFrame, n_rows: int) -> ForestModel:
    """The forest over the feature vectors and labels of ``rows``."""
    spark = rows.sparkSession
    features, label, seed = forest.getFeaturesCol(), forest.getLabelCol(), forest.getSeed()
    plain = rows.select(vector_to_array(features).alias("x"), F.col(label).cast("double").alias("y"))
    wanted = max(forest.getMaxBins() ** 2, 10_000)
    sample = rows if wanted >= n_rows else rows.sample(wanted / n_rows, seed % 2**31)
    seen = _matrix(sample.select(vector_to_array(features).alias("x")).toArrow()["x"].combine_chunks())
    nominal = arities(rows.schema, features)
    kinds = [nominal.get(f, 0) for f in range(seen.shape[1])]
    edges = [np.zeros(0) if kinds[f] else thresholds(seen[:, f], min(forest.getMaxBins(), n_rows)) for f in range(len(kinds))]
    if max(kinds) > forest.getMaxBins():
        raise ValueError(f"maxBins must be at least {max(kinds)}, the most categories of a feature")

    slots = max(1, spark.sparkContext.defaultParallelism)
    files = slots * max(1, -(-n_rows // (slots * CHUNKS_A_FILE * CHUNK_ROWS)))
    path = scratch_path(spark, "forest")
    schema = "chunk long, n long, bins binary, labels binary, twin array<int>"
    plain.mapInArrow(binned(edges, kinds), schema).repartition(files).write.parquet(f"{path}/chunks")
    chunks = spark.read.schema(schema).parquet(f"{path}/chunks")
    twins = np.array([r["twin"] for r in chunks.select("twin").distinct().collect()])
    # Columns are alike if the same column is the first of both in every chunk.
    twin = [next(g for g in range(f + 1) if (twins[:, g] == twins[:, f]).all()) for f in range(len(kinds))]
    spec = Spec(forest, twin, [kinds[f] or len(edges[f]) + 1 for f in range(len(kinds))], kinds)
    chunks = chunks.select("chunk", "n", "bins", "labels")

    every, deep = range(forest.getNumTrees()), spec.depth > PASS_DEPTH
    tops, levels = {t: _root() for t in every}, {t: np.zeros(1, np.int64) for t in every}
    small: dict[int, list] = {t: [] for t in every}
    open_ = {t: np.zeros(1, np.int64) for t in every}
    if deep and n_rows <= LOCAL_ROWS:
        small, open_ = {t: [0] for t in every}, {}
    for level in range(spec.depth + 1):
        open_ = {t: nodes for t, nodes in open_.items() if len(nodes)}
        found, part, held = {}, {}, 0
        for i, (t, nodes) in enumerate(open_.items(), 1):
            part[t], held = nodes, held + len(nodes) * len(spec.columns) * 2 * spec.width * 8
            if held >= HISTOGRAM_BYTES or i == len(open_):
                found |= level_pass(chunks, spec, {k: tops[k] for k in part}, part, level)
                part, held = {}, 0
        for t, nodes in open_.items():
            tops[t], fresh = _added(tops[t], nodes, found[t])
            levels[t] = np.concatenate([levels[t], np.full(len(fresh), level + 1)])
            local = tops[t]["n"][fresh] <= LOCAL_ROWS if deep else np.zeros(len(fresh), bool)
            small[t] += fresh[local].tolist()
            open_[t] = fresh[~local]
    groups = {}
    for t in every:
        if small[t]:
            groups[t] = np.full(len(tops[t]), -1, np.int64)
            groups[t][small[t]] = _packed(tops[t]["n"][small[t]])
    saved, together = f"{path}/data", max(1, int(DEAL_BYTES // (n_rows * (len(spec.columns) + 13))))
    for a in range(0, len(every), together) if groups else [0]:
        some = [t for t in every if not groups or a <= t < a + together]
        pieces = spark.createDataFrame([(t, bytearray(), bytearray(tops[t].tobytes())) for t in some], "tree int, roots binary, nodes binary")
        if any(t in groups for t in some):
            mine = {t: groups[t] for t in some if t in groups}
            parts = max(4 * slots, -(-n_rows * len(mine) * (len(spec.columns) + 13) // (64 << 20)))
            pieces = pieces.unionByName(dealt(chunks, spec, {t: tops[t] for t in mine}, mine, {t: levels[t] for t in mine}, parts))
        pieces.groupBy("tree").applyInArrow(assemble(edges, kinds), SAVED).write.mode("append").parquet(saved)
    _describe(forest, spark, path, forest.getNumTrees(), len(kinds))
    return ForestModel(RandomForestRegressionModel.load(path), path)
