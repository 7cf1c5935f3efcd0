"""Masked pseudo-likelihood of documents (operator 1).

Tokens are lower-cased words.  The most frequent words of the whole corpus have
ids of their own in the network, all others share its hash buckets; both grow
with the corpus (``sizes``).  A network looks at
``SIDE`` words on either side of a place (a boundary id stands beyond the ends),
adds one embedding per place and word, and predicts the word in the middle:
first its class, then the word in the class, so a prediction costs two small
softmaxes.  A word in a bucket has the bucket's probability times its part of
it, ``n(word) / (n(bucket) + 1)`` by the counts of all words; all words never
counted have the one left over.  A document's score is the sum of the
conditional log-probabilities of all its tokens, each given both sides.

Counts of the ``HEAD`` most frequent bucketed words (whole ranks of equal counts)
are broadcast.  Rarer words leave the scoring tasks as rows and are joined with
the table of counts; a word counted once adds log 1 and needs no join.

Training: word counts are gathered from all documents with Spark, then every
document is written as its word ids, with a shard and a round by the hash of its
key and text.  From a start fitted to the ``START_DOCS`` documents of the smallest
hashes, each round trains one AdaGrad pass over its part of every shard, in hash
order, side by side; weights and AdaGrad's sums, averaged by token counts, are
what the next round begins with.  Every token of the corpus is trained on once.
The number of shards follows the tokens alone, so the model does not depend on
how the table is partitioned.  A shard sends its state in blocks, which Spark
sums by block: no task or driver holds more than one model, and there are
``SHARDS`` shards at most, however large the corpus.  The model, whose vocabulary
doubles with ``GROWTH`` times the tokens, is broadcast for scoring.

Null or empty texts have no tokens: log-probability 0, mean null.  Very long
texts are trained on and scored in pieces that see their neighbours.  Repeated
rows are trained on as often as they stand there and get equal scores; words of
equal counts are ranked by their text.  Without any token (an empty table, too)
the untrained start is used.  Columns other than key and text are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilo.llm.common import by_batch_of, documents, in_arrow, pick, written

SIDE, HIDDEN = 2, 16
CLASSES, PER_CLASS = 32, 32
VOCABULARY = CLASSES * PER_CLASS
KNOWN = 640
LEAST, GROWTH = 1 << 20, 16
HEAD = 1 << 18
BATCH, SCORED, RATE = 1 << 13, 1 << 13, 0.15
START_DOCS, START_CHARS = 300, 20000
ROUNDS, SHARD_TOKENS, SHARDS = 2, 1 << 22, 1 << 14
COUNTED, REMEMBERED = 1 << 19, 1 << 18
BLOCK = 4096
PIECE = 1 << 17

Weights = dict[str, np.ndarray]


def sizes(n_tokens: int) -> tuple[int, int]:
    """(classes, words in a class): the vocabulary doubles at every ``GROWTH``
    times the tokens, so the cost of a prediction grows as their eighth root."""
    classes, per_class, limit = CLASSES, PER_CLASS, LEAST * GROWTH
    while n_tokens >= limit:
        classes, per_class, limit = per_class, 2 * classes, limit * GROWTH
    return min(classes, per_class), max(classes, per_class)


def shapes(classes: int = CLASSES, per_class: int = PER_CLASS) -> dict[str, tuple[int, ...]]:
    return {"embed": (2 * SIDE, classes * per_class, HIDDEN), "shift": (HIDDEN,), "to_class": (HIDDEN, classes), "class_bias": (classes,),
            "to_word": (classes, HIDDEN, per_class), "word_bias": (classes, per_class)}


SHAPES = shapes()


def tokens(text: str | None) -> list[str]:
    return text.lower().split() if text else []


def word_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """(word, n): occurrences over all rows, counted in each task first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def out() -> Iterator[pa.RecordBatch]:
            words, n = list(held), list(held.values())
            for s in range(0, len(words), 1 << 15):
                yield pa.RecordBatch.from_arrays([pa.array(words[s:s + (1 << 15)], pa.string()), pa.array(n[s:s + (1 << 15)], pa.int64())], ["word", "n"])
            held.clear()

        for batch in batches:
            for t in batch.column("text"):
                held.update(tokens(t.as_py()))
                if len(held) >= COUNTED:
                    yield from out()
        yield from out()

    rows = df.select(F.col(f"`{text}`").alias("text")).filter("text is not null")
    return in_arrow(rows, run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(counts: DataFrame, known: int = KNOWN) -> dict[str, int]:
    """Ids of the most frequent words; 0 is the boundary."""
    top = counts.orderBy(F.desc("n"), "word").limit(known).collect()
    return {r["word"]: i + 1 for i, r in enumerate(top)}


class Words(dict):
    """Word ids; a word without an id of its own gets that of its hash bucket,
    remembered up to a bound."""

    def __init__(self, known: dict[str, int], size: int = VOCABULARY):
        super().__init__(known)
        self.known, self.first, self.size = known, len(known) + 1, size

    def __missing__(self, word: str) -> int:
        i = self.first + zlib.crc32(word.encode("utf-8", "surrogatepass")) % (self.size - self.first)
        self[word] = i
        return i

    def of(self, text: str | None) -> list[int]:
        if len(self) > REMEMBERED:
            self.clear()
            self.update(self.known)
        return list(map(self.__getitem__, tokens(text)))


@dataclass(frozen=True)
class Shares:
    """Counts of the words in hash buckets."""
    head: list[str]
    n: np.ndarray
    buckets: np.ndarray             # tokens in each bucket, by id
    rest: DataFrame | None          # (word, n) of those neither in ``head`` nor counted once


def shares(counts: DataFrame, known: dict[str, int], size: int) -> Shares:
    """What is needed of ``word_counts`` to part the buckets of a vocabulary."""
    first, spark = len(known) + 1, counts.sparkSession
    own = spark.createDataFrame([(w,) for w in known], "word string")
    others = counts.join(F.broadcast(own), "word", "left_anti")
    at = (F.lit(first) + F.crc32(F.col("word").cast("binary")) % (size - first)).alias("at")
    buckets = np.zeros(size)
    for r in others.groupBy(at).agg(F.sum("n").alias("n")).collect():
        buckets[r["at"]] = r["n"]
    ranks = sorted(map(tuple, others.groupBy("n").agg(F.count("*")).collect()), reverse=True)
    fit_in = [n for (n, _), total in zip(ranks, np.cumsum([c for _, c in ranks]), strict=True) if total <= HEAD]
    low = max(2, min(fit_in, default=ranks[0][0] + 1 if ranks else 2))
    head = others.filter(F.col("n") >= low).collect()
    rest = others.filter((F.col("n") > 1) & (F.col("n") < low)) if any(1 < n < low for n, _ in ranks) else None
    return Shares([r["word"] for r in head], np.array([r["n"] for r in head], dtype=np.float64), buckets, rest)


class Codes(dict):
    """Codes of words: ids of the network, then words of ``head``, then other
    words as they are met, remembered up to a bound."""

    def __init__(self, known: dict[str, int], size: int, head: list[str], n: np.ndarray, buckets: np.ndarray):
        super().__init__(known)
        self.first, self.size, self.buckets, self.fixed = len(known) + 1, size, buckets, size + len(head)
        self.update(zip(head, range(size, self.fixed), strict=True))
        at = self.buckets_of(head)
        self.at = np.concatenate([np.arange(size, dtype=np.int32), at])
        self.own = np.concatenate([np.zeros(size), np.log(n) - np.log1p(buckets[at])])
        self.met: list[str] = []
        self.met_at = np.zeros(0, dtype=np.int32)

    def buckets_of(self, words: list[str]) -> np.ndarray:
        crc = zlib.crc32
        sums = np.array([crc(w.encode("utf-8", "surrogatepass")) for w in words], dtype=np.int64)
        return (self.first + sums % (self.size - self.first)).astype(np.int32)

    def __missing__(self, word: str) -> int:
        self[word] = code = self.fixed + len(self.met)
        self.met.append(word)
        return code

    def of(self, text: str | None) -> list[int]:
        return list(map(self.__getitem__, tokens(text)))

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """By code: (id in the network, log of the part of its bucket); a word
        that was met counts as one, its number of occurrences is joined."""
        self.met_at = met = np.concatenate([self.met_at, self.buckets_of(self.met[len(self.met_at):])])
        return np.concatenate([self.at, met]), np.concatenate([self.own, -np.log1p(self.buckets[met])])

    def forget(self) -> None:
        for w in self.met:
            del self[w]
        self.met, self.met_at = [], np.zeros(0, dtype=np.int32)


def id_pieces(ids: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(context ids [n, 2 * SIDE], target ids, text numbers) of all tokens of texts
    given as ids, ``PIECE`` at a time; boundaries stand around each text."""
    gap = np.zeros(SIDE, dtype=np.int32)
    x = np.concatenate([gap, *(p for own in ids for p in (gap, own, gap))])
    n = np.array([len(own) for own in ids], dtype=np.int64)
    starts = np.cumsum(n + 2 * SIDE) - n
    of = np.repeat(np.arange(len(ids)), n)
    at = np.arange(n.sum()) + (starts - (np.cumsum(n) - n))[of]
    for s in range(0, len(at), PIECE):
        own = at[s:s + PIECE]
        yield np.stack([x[own + d] for d in range(-SIDE, SIDE + 1) if d], axis=1), x[own], of[s:s + PIECE]


def pieces(words: Words | Codes, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``id_pieces`` of texts."""
    yield from id_pieces([np.array(words.of(t), dtype=np.int32) for t in texts])


def start(seed: int = 1, classes: int = CLASSES, per_class: int = PER_CLASS) -> Weights:
    rng = np.random.default_rng(seed)
    return {k: (rng.normal(scale=0.1, size=s) if k in ("embed", "to_class", "to_word") else np.zeros(s)).astype(np.float32)
            for k, s in shapes(classes, per_class).items()}


_ONES = np.ones(1 << 16, dtype=np.float32)


def _tame(weights: np.ndarray, bias: np.ndarray) -> bool:
    """Whether no logit can be too large for exp: hidden values are within 1."""
    return bool((np.abs(weights).sum(axis=-2) + np.abs(bias)).max() <= 60)


def _exp(x: np.ndarray, tame: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(exp, its row sums) of logits, which stay far below the bound."""
    if not tame:
        np.minimum(x, 60, out=x)
    np.exp(x, out=x)
    return x, x @ _ONES[:x.shape[1]]


def _hidden(w: Weights, context: np.ndarray) -> np.ndarray:
    h = w["shift"] + w["embed"][0][context[:, 0]]
    for s in range(1, 2 * SIDE):
        h += w["embed"][s][context[:, s]]
    return np.tanh(h, out=h)


def log_probabilities(w: Weights, context: np.ndarray, target: np.ndarray) -> np.ndarray:
    """log p(word | both sides) of each row."""
    out = np.empty(len(target))
    tame, tame_words = _tame(w["to_class"], w["class_bias"]), _tame(w["to_word"], w["word_bias"])
    for s in range(0, len(target), SCORED):
        c, y = context[s:s + SCORED], target[s:s + SCORED]
        group, order, ends = _by_class(w, y)
        h, y = _hidden(w, c[order]), y[order]
        e, total = _exp(h @ w["to_class"] + w["class_bias"], tame)
        p = e[np.arange(len(y)), group[order]] / total
        for k in range(len(ends) - 1):
            a, b = ends[k], ends[k + 1]
            if a < b:
                e, total = _exp(h[a:b] @ w["to_word"][k] + w["word_bias"][k], tame_words)
                p[a:b] *= e[np.arange(b - a), y[a:b] % e.shape[1]] / total
        out[s + order] = np.log(np.maximum(p, 1e-30))
    return out


def _by_class(w: Weights, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class of each row, rows by class, where each class starts)."""
    classes, per_class = w["word_bias"].shape
    group = (target // per_class).astype(np.int16)
    order = np.argsort(group, kind="stable")
    return group, order, np.searchsorted(group[order], np.arange(classes + 1))


def gradient(w: Weights, context: np.ndarray, target: np.ndarray) -> Weights:
    """Gradient of the mean negative log-probability."""
    g = {k: np.zeros_like(v) for k, v in w.items()}
    n = len(target)
    group, order, ends = _by_class(w, target)
    context, target, group = context[order], target[order], group[order]
    h = _hidden(w, context)
    # With a constant one as last hidden value the biases are rows of the matrices.
    h1 = np.concatenate([h, np.ones((n, 1), dtype=h.dtype)], axis=1)
    to_class = np.concatenate([w["to_class"], w["class_bias"][None]])
    to_word = np.concatenate([w["to_word"], w["word_bias"][:, None]], axis=1)
    tame, tame_words = _tame(w["to_class"], w["class_bias"]), _tame(w["to_word"], w["word_bias"])
    part = np.float32(1 / n)
    d, total = _exp(h1 @ to_class, tame)
    d *= (part / total)[:, None]
    d[np.arange(n), group] -= part
    own = h1.T @ d
    g["to_class"], g["class_bias"] = own[:-1], own[-1]
    dh = d @ w["to_class"].T
    for k in range(len(ends) - 1):
        a, b = ends[k], ends[k + 1]
        if a < b:
            q, total = _exp(h1[a:b] @ to_word[k], tame_words)
            q *= (part / total)[:, None]
            q[np.arange(b - a), target[a:b] % q.shape[1]] -= part
            own = h1[a:b].T @ q
            g["to_word"][k], g["word_bias"][k] = own[:-1], own[-1]
            dh[a:b] += q @ w["to_word"][k].T
    dh *= 1 - h * h
    g["shift"] = dh.sum(axis=0)
    for s in range(2 * SIDE):
        order = np.argsort(context[:, s].astype(np.uint16 if w["embed"].shape[1] <= 1 << 16 else np.int32), kind="stable")
        ids = context[order, s]
        first = np.nonzero(np.append(True, ids[1:] != ids[:-1]))[0]
        g["embed"][s][ids[first]] = np.add.reduceat(dh[order], first, axis=0)
    return g


class Trainer:
    """AdaGrad, batch by batch, from weights and (if given) sums of squares."""

    def __init__(self, w: Weights, seen: Weights | None = None):
        self.w = {k: v.copy() for k, v in w.items()}
        self.seen = {k: v.copy() for k, v in seen.items()} if seen else {k: np.full_like(v, 1e-8) for k, v in w.items()}
        self.n = 0

    def step(self, context: np.ndarray, target: np.ndarray) -> None:
        for s in range(0, len(target), BATCH):
            g = gradient(self.w, context[s:s + BATCH], target[s:s + BATCH])
            for k, v in g.items():
                self.seen[k] += v * v
                self.w[k] -= RATE * v / np.sqrt(self.seen[k])
        self.n += len(target)

    def texts(self, ids: list[np.ndarray]) -> None:
        for context, target, _ in id_pieces(ids):
            self.step(context, target)


def flat(w: Weights) -> np.ndarray:
    return np.concatenate([w[k].ravel() for k in SHAPES])


def shaped(x: np.ndarray, like: dict[str, tuple[int, ...]]) -> Weights:
    out, at = {}, 0
    for k, s in like.items():
        size = int(np.prod(s))
        out[k] = x[at:at + size].reshape(s).astype(np.float32)
        at += size
    return out


def _stored(size: int) -> str:
    """How ids of a vocabulary are stored."""
    return "<u2" if size <= 1 << 16 else "<i4"


def encoded(df: DataFrame, known: dict[str, int], size: int, words: Shares | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, key, hash, ids, n_tokens, part, rest) for every row: the word ids of
    its text, the sum of the logs of the parts that its words have of their
    buckets, and the words whose counts have to be joined for that."""
    few = (words.head, words.n, words.buckets) if words else ([], np.zeros(0), np.zeros(size))
    sent = df.sparkSession.sparkContext.broadcast((known, few))
    joined = words is not None and words.rest is not None
    made: list[Codes] = []

    def run(ids: list, keys: list, hashes: list, texts: list) -> dict[str, list]:
        known, own = sent.value
        if not made:
            made.append(Codes(known, size, *own))
        codes = made[0]
        if len(codes.met) > REMEMBERED:
            codes.forget()
        of_text = [codes.of(t) for t in texts]
        n = np.array([len(x) for x in of_text], dtype=np.int64)
        flat_ = np.fromiter(chain.from_iterable(of_text), dtype=np.int64, count=int(n.sum()))
        of = np.repeat(np.arange(len(texts)), n)
        at, part = codes.tables()
        raw = at[flat_].astype(_stored(size)).tobytes()
        ends = np.cumsum(n) * int(_stored(size)[-1])
        met = flat_ >= codes.fixed
        out = {"id": ids, "key": keys, "hash": hashes, "n_tokens": pa.array(n),
               "ids": [raw[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)],
               "part": pa.array(np.bincount(of, weights=part[flat_], minlength=len(texts)))}
        of_rest = np.bincount(of[met], minlength=len(texts)) if joined else np.zeros(len(texts), dtype=np.int64)
        held = pa.array(codes.met, pa.string()).take(pa.array(flat_[met] - codes.fixed if joined else flat_[:0]))
        return out | {"rest": pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(of_rest)), pa.int32()), held)}

    rows = pick(df, key, text)
    rows = rows.select(F.monotonically_increasing_id().alias("id"), "key", F.xxhash64(F.col("key").cast("string"), "text").alias("hash"), "text")
    return by_batch_of(rows, run, "id long, key long, hash long, n_tokens long, ids binary, part double, rest array<string>")


def start_texts(df: DataFrame, key: str = "doc_id", text: str = "text") -> list[str]:
    """The texts that the start is fitted to: the smallest hashes among those of
    at most ``START_CHARS``, whatever order the rows come in.  A bound on the
    hash that some four times as many meet keeps the others out of the sort."""
    by = F.pmod(F.xxhash64(F.lit("start"), F.col("key").cast("string"), "text"), F.lit(1 << 40))
    short = pick(df, key, text).filter(F.length("text") <= START_CHARS).withColumn("by", by)
    bound = (4 * START_DOCS << 40) // max(1, short.count())
    return [r["text"] for r in short.filter(F.col("by") < bound).orderBy("by", "text").limit(START_DOCS).select("text").collect()]


@dataclass(frozen=True)
class Corpus:
    """What counting leaves: number of tokens, vocabulary and its shape."""
    n_tokens: int
    known: dict[str, int]
    classes: int
    per_class: int

    @property
    def size(self) -> int:
        return self.classes * self.per_class


def counted(counts: DataFrame) -> Corpus:
    n_tokens = counts.agg(F.sum("n")).first()[0] or 0
    classes, per_class = sizes(n_tokens)
    return Corpus(n_tokens, vocabulary(counts, KNOWN * classes * per_class // VOCABULARY), classes, per_class)


def learned(corpus: Corpus, texts: list[str], ids: DataFrame) -> Weights:
    """The weights after the start, fitted to ``texts``, and all rounds over
    the written rows ``ids`` of ``encoded``."""
    first = Trainer(start(1, corpus.classes, corpus.per_class))
    for _ in range(3):
        for c, y, _ in pieces(Words(corpus.known, corpus.size), texts):
            first.step(c, y)
    shards = max(1, min(SHARDS, corpus.n_tokens // SHARD_TOKENS))
    spread = F.pmod(F.col("hash"), F.lit(shards * ROUNDS))
    state = first.w, first.seen
    for number in range(ROUNDS if corpus.n_tokens else 0):
        part = ids.filter((F.floor(spread / shards) == number) & (F.col("n_tokens") > 0))
        state = trained(part.select((spread % shards).alias("shard"), "hash", "ids"), state) or state
    return state[0]


def fit(df: DataFrame, key: str = "doc_id", text: str = "text", counts: DataFrame | None = None) -> tuple[dict[str, int], Weights]:
    """(vocabulary, weights) learned from all rows; ``counts`` are their
    ``word_counts`` if these are at hand."""
    corpus = counted(written(word_counts(df, text), "lm-words") if counts is None else counts)
    ids = written(encoded(df, corpus.known, corpus.size, key=key, text=text), "lm-ids")
    return corpus.known, learned(corpus, start_texts(df, key, text), ids)


def trained(ids: DataFrame, state: tuple[Weights, Weights]) -> tuple[Weights, Weights] | None:
    """Weights and sums of squares after one round over all shards (none if no
    text is in it)."""
    sent = ids.sparkSession.sparkContext.broadcast(state)
    like = {k: v.shape for k, v in state[0].items()}
    stored = _stored(like["embed"][1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, trainer, held, n = None, None, [], 0

        def train() -> None:
            nonlocal held, n
            if held:
                trainer.texts(held)
            held, n = [], 0

        def out() -> Iterator[pa.RecordBatch]:
            if trainer is not None:
                train()
                x = np.concatenate([flat(trainer.w), flat(trainer.seen)])
                parts = [x[s:s + BLOCK].astype("<f4").tobytes() for s in range(0, len(x), BLOCK)]
                yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary()),
                                                  pa.array([trainer.n] * len(parts), pa.int64())], ["block", "part", "n"])

        for batch in batches:
            for own, raw in zip(batch.column("shard").to_pylist(), batch.column("ids"), strict=True):
                if own != shard:
                    yield from out()
                    shard, trainer = own, Trainer(*sent.value)
                held.append(np.frombuffer(raw.as_buffer(), dtype=stored))
                n += len(held[-1])
                if n >= PIECE:
                    train()
        yield from out()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            for block, part, n in zip(*(batch.column(c).to_pylist() for c in ("block", "part", "n")), strict=True):
                own = sums.setdefault(block, [0.0, 0])
                own[0] = own[0] + n * np.frombuffer(part, dtype="<f4").astype(np.float64)
                own[1] += n
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([(s / n).tobytes() for s, n in sums.values()], pa.binary())],
                                         ["block", "part"])

    dealt = ids.repartition("shard").sortWithinPartitions("shard", "hash", "ids")
    of_shards = in_arrow(dealt.select("shard", "ids"), run, "block int, part binary, n long")
    total = sum(int(np.prod(s)) for s in like.values())
    mean = in_arrow(of_shards.repartition(-(-2 * total // BLOCK), "block"), add, "block int, part binary").orderBy("block").collect()
    if not mean:
        return None
    x = np.concatenate([np.frombuffer(r["part"], dtype=np.float64) for r in mean])
    return shaped(x[:total], like), shaped(x[total:], like)


def scored(ids: DataFrame, w: Weights, words: Shares | None = None) -> DataFrame:
    """(key, n_tokens, log_prob, mean_log_prob) of rows of ``encoded`` (written
    ones if ``words`` has counts to join)."""
    size = w["embed"].shape[1]
    sent, stored = ids.sparkSession.sparkContext.broadcast(w), _stored(size)

    def run(ids_: list, keys: list, n_tokens: list, parts: list, raw: list) -> dict[str, list]:
        total = np.array(parts)
        for c, y, of in id_pieces([np.frombuffer(x, dtype=stored) for x in raw]):
            total += np.bincount(of, weights=log_probabilities(sent.value, c, y), minlength=len(raw))
        return {"id": ids_, "key": keys, "n_tokens": n_tokens, "log_prob": pa.array(total)}

    out = by_batch_of(ids.select("id", "key", "n_tokens", "part", "ids"), run, "id long, key long, n_tokens long, log_prob double")
    if words is not None and words.rest is not None:
        more = ids.select("id", F.explode("rest").alias("word")).join(words.rest, "word").groupBy("id").agg(F.sum(F.log("n")).alias("more"))
        out = out.join(more, "id", "left").withColumn("log_prob", F.col("log_prob") + F.coalesce("more", F.lit(0.0)))
    return out.select("key", "n_tokens", "log_prob").withColumn("mean_log_prob", F.when(F.col("n_tokens") > 0, F.col("log_prob") / F.col("n_tokens")))


def score(df: DataFrame, model: tuple[dict[str, int], Weights], key: str = "doc_id", text: str = "text", words: Shares | None = None) -> DataFrame:
    """``scored`` of any texts.  Without ``words`` a word in a bucket counts as
    the bucket."""
    known, w = model
    ids = encoded(df, known, w["embed"].shape[1], words, key, text)
    return scored(written(ids, "lm-ids") if words is not None and words.rest is not None else ids, w, words)


def op1(spark, sf_dir: str) -> DataFrame:
    """``op1_lm``: pseudo-log-likelihood of every document.  Texts are split into
    words twice, for counting and for their ids; the rest works on ids."""
    docs = documents(spark, sf_dir)
    counts = written(word_counts(docs), "lm-words")
    corpus = counted(counts)
    words = shares(counts, corpus.known, corpus.size)
    ids = written(encoded(docs, corpus.known, corpus.size, words), "lm-ids")
    return scored(ids, learned(corpus, start_texts(docs), ids), words).withColumnRenamed("key", "doc_id")
