"""Token files by an adaptive context-mixing range coder (operator 10).

Documents are encoded with the tokenizers library, an end id is appended, and
their ids are put in ascending key order by a range partition; each partition
writes them as blocks of at most ``BLOCK_IDS`` ids.  A block starts from the file's
common model and carries its own documents and checksum, so any block is read
without other blocks.

Model: order 0 is a distribution over all ids, their counts in the whole corpus
(every id keeps a share); orders 1 and 2 predict, by the last one and two ids,
the id that followed them in the block, with a confidence.  For either order and
every confidence an adaptive probability tells how often it was right; the odds
of equal predictions add up, and the mixed distribution over {order 2's id, order
1's id, order 0} drives a 64-bit carry-less range coder.  What neither predicts
is coded with its share of order 0.

The coder works on many blocks at once: step t codes the t-th id of each block
of a group, as numpy operations over the blocks, in both directions.

File format: rows (part, block, n_ids, payload) in Parquet, part ascending with
the keys; the row of part -1 holds order 0, with a CRC-32 that all blocks name.  A
payload is a header (magic, ids, documents, coded bytes, ids in order 0, its
CRC-32), a table of documents (key, flags, ordinal in the part, piece, ids) and the coded bytes,
with a CRC-32 of all that.  A document longer than a block goes on in the next
as further pieces.

Scale: each text is encoded once and its ids are written; from there they are
counted (a row an id goes to the driver, the vocabulary bounds them) and shuffled
once, by ranges of the key (sampled by Spark); rows that share a key stay in one
range.  Positions come from the sums of the parts, one
row each.  Null keys come first, ties are ordered by the text's hash; equal rows
follow each other.  Null and empty texts hold just the end id; very long texts go
over many blocks; an empty table has no blocks.  Other columns are not read.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigilo.llm import bpe
from vigilo.llm.common import by_batch_of, documents, in_arrow, pick, written
from vigilo.session import scratch_path

END_ID = 1
BLOCK_IDS, LANES = 1024, 4096
SLOT_BITS, CONFIDENCE = 10, 8
MAGIC = b"TKF2"
_W = np.uint64
_SCALE = 14
_SETTLED, _LEAST = _W(1 << 48), _W(1 << 40)
#: Odds of a probability of 2^16, in steps of 2^6: what a mixed candidate weighs.
_ODDS = np.array([max(p, 0.5) / (1024 - max(p, 0.5)) for p in range(1024)], dtype=np.float32)


class Order0:
    """A distribution over the ids below a bound, in whole shares of 2^bits."""

    def __init__(self, shares: np.ndarray):
        self.size = shares.astype(_W)
        self.bits = int(shares.sum()).bit_length() - 1
        self.start = np.cumsum(self.size) - self.size
        self.id_at = np.repeat(np.arange(len(shares), dtype=np.uint32), shares)
        self.crc = zlib.crc32(self.to_bytes())

    @classmethod
    def of(cls, counts: np.ndarray | int) -> Order0:
        """From the ids' counts, or a bound below which all are alike."""
        counts = np.zeros(counts, dtype=np.int64) if isinstance(counts, int) else counts
        bits = max(20, (len(counts) - 1).bit_length() + 2)
        if bits > 24:
            raise ValueError(f"{len(counts)} ids are more than shares of 2^24 can tell apart")
        part = counts / counts.sum() if counts.any() else np.full(len(counts), 1 / len(counts))
        shares = 1 + (part * ((1 << bits) - len(counts))).astype(np.int64)
        shares[int(np.argmax(shares))] += (1 << bits) - int(shares.sum())
        return cls(shares)

    def to_bytes(self) -> bytes:
        return zlib.compress(self.size.astype("<u4").tobytes())

    @classmethod
    def from_bytes(cls, raw: bytes) -> Order0:
        return cls(np.frombuffer(zlib.decompress(raw), dtype="<u4").astype(np.int64))


class Mixer:
    """Predictions of orders 2 and 1 for the next id of each lane."""

    def __init__(self, lanes: int):
        self.rows = np.arange(lanes, dtype=np.int64) << SLOT_BITS
        self.at_conf = np.arange(lanes, dtype=np.int64) * CONFIDENCE
        self.slots = [np.zeros(lanes << SLOT_BITS, dtype=np.uint32) for _ in range(2)]
        first = np.array([(c + 1) * 6000 for c in range(CONFIDENCE)], dtype=np.int32)
        self.right = [np.tile(first, lanes) for _ in range(2)]
        self.last, self.before = np.zeros(lanes, dtype=np.uint32), np.zeros(lanes, dtype=np.uint32)

    def predict(self) -> tuple[np.ndarray, ...]:
        """(ids of the two candidates; where the shares of 2^14 end of the first
        and of both; the rest is order 0's).  Order 1's id, where it repeats
        order 2's, adds to that one's share and has none itself."""
        one = self.last * np.uint32(0x9E3779B1)
        two = (one ^ self.before) * np.uint32(0x85EBCA6B)
        self.places = [self.rows + (two >> np.uint32(32 - SLOT_BITS)), self.rows + (one >> np.uint32(32 - SLOT_BITS))]
        self.found = [s[p] for s, p in zip(self.slots, self.places, strict=True)]
        self.ids = [f >> np.uint32(3) for f in self.found]
        self.conf = [f & np.uint32(7) for f in self.found]
        self.prob_at = [self.at_conf + c for c in self.conf]
        self.prob = [r[p] for r, p in zip(self.right, self.prob_at, strict=True)]
        o2, o1 = (_ODDS[p >> 6] for p in self.prob)
        p2, p1 = self.ids
        same = p1 == p2
        o2 = o2 + o1 * same
        o1 = o1 * ~same
        # Single-precision sums and quotients are the same on every machine.
        unit = np.float32((1 << _SCALE) - 1) / (o2 + o1 + np.float32(1))
        f2, f1 = ((o * unit).astype(np.uint32) for o in (o2, o1))
        return p2, p1, f2, f2 + f1

    def update(self, ids: np.ndarray) -> None:
        for k in range(2):
            hit = ids == self.ids[k]
            p = self.prob[k]
            self.right[k][self.prob_at[k]] = p + (((hit << np.int32(16)) - p) >> 5)
            conf = self.conf[k]
            missed = np.where(conf > 0, self.ids[k] << np.uint32(3) | conf >> np.uint32(1), ids << np.uint32(3))
            self.slots[k][self.places[k]] = np.where(hit, self.found[k] + (conf < 7), missed)
        self.before, self.last = self.last, ids


class Lanes:
    """The interval of each lane: 64-bit ``low`` and ``wide``, at least 2^40 wide
    before each id, so a share of 2^14 and one of order 0 fit without a step
    between.  Settled leading 16-bit words leave at the top."""

    def __init__(self, lanes: int):
        self.low, self.wide = np.zeros(lanes, dtype=_W), np.full(lanes, (1 << 64) - 1, dtype=_W)

    def narrow(self, start: np.ndarray, size: np.ndarray, other: np.ndarray) -> None:
        """To a share of 2^14; from the last candidate's end to the top for order 0."""
        unit = self.wide >> _W(_SCALE)
        step = unit * start
        self.low += step
        self.wide = np.where(other, self.wide - step, unit * size)

    def words(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(lanes, their settled words) until all are wide enough."""
        low, wide = self.low, self.wide
        rows = np.nonzero(((low ^ (low + wide)) < _SETTLED) | (wide < _LEAST))[0]
        while len(rows):
            l, w = low[rows], wide[rows]
            # Narrow and unsettled: cut at the next boundary instead of carrying.
            w = np.where((l ^ (l + w)) < _SETTLED, w, (~l + _W(1)) & (_LEAST - _W(1)))
            yield rows, l >> _W(48)
            l, w = l << _W(16), w << _W(16)
            low[rows], wide[rows] = l, w
            rows = rows[((l ^ (l + w)) < _SETTLED) | (w < _LEAST)]


def code(ids: np.ndarray, lengths: np.ndarray, order0: Order0) -> list[bytes]:
    """Coded bytes of each row of ``ids`` [lanes, steps]; only the first
    ``lengths`` ids of a row matter."""
    lanes, steps = ids.shape
    mixer, interval = Mixer(lanes), Lanes(lanes)
    out, size = np.zeros((lanes, 3 * steps + 16), dtype=np.uint16), np.zeros(lanes, dtype=np.int64)
    ends = np.zeros(lanes, dtype=np.int64)
    columns = np.ascontiguousarray(ids.T).astype(np.uint32)
    for t in range(steps):
        x = columns[t]
        p2, p1, c2, c1 = mixer.predict()
        # 0, 1: the candidate with a share that is the id; 2: order 0.
        which = np.where((x == p2) & (c2 > 0), 0, np.where((x == p1) & (c1 > c2), 1, 2))
        start = np.choose(which, (0, c2, c1)).astype(_W)
        other = which == 2
        interval.narrow(start, np.choose(which, (c2, c1, 0)).astype(_W) - start, other)
        rows = np.nonzero(other)[0]
        own = x[rows]
        unit = interval.wide[rows] >> _W(order0.bits)
        interval.low[rows] += unit * order0.start[own]
        interval.wide[rows] = unit * order0.size[own]
        for rows, word in interval.words():
            out[rows, size[rows]] = word
            size[rows] += 1
        done = lengths == t + 1
        if done.any():  # what a finished lane goes on to write is past its end
            rows = np.nonzero(done)[0]
            for k in range(4):
                out[rows, size[rows] + k] = interval.low[rows] >> _W(48 - 16 * k) & _W(0xFFFF)
            size[rows] += 4
            ends[rows] = size[rows]
        mixer.update(x)
    return [out[i, :e].astype("<u2").tobytes() for i, e in enumerate(ends.tolist())]


def decode(coded: list[bytes], lengths: np.ndarray, order0: Order0) -> np.ndarray:
    """The ids [lanes, steps] that ``code`` was given."""
    lanes, steps = len(coded), int(lengths.max()) if len(coded) else 0
    mixer, interval = Mixer(lanes), Lanes(lanes)
    room = max(map(len, coded), default=0) // 2 + 4
    data = np.zeros((lanes, room), dtype=np.uint16)
    for i, c in enumerate(coded):
        data[i, :len(c) // 2] = np.frombuffer(c, dtype="<u2")
    value = np.zeros(lanes, dtype=_W)
    for k in range(4):
        value = value << _W(16) | data[:, k]
    at = np.full(lanes, 4, dtype=np.int64)
    out = np.zeros((steps, lanes), dtype=np.uint32)
    for t in range(steps):
        p2, p1, c2, c1 = mixer.predict()
        v = (value - interval.low) // (interval.wide >> _W(_SCALE))
        which = (v >= c2).astype(np.int8) + (v >= c1)
        start = np.choose(which, (0, c2, c1)).astype(_W)
        other = which == 2
        interval.narrow(start, np.choose(which, (c2, c1, 0)).astype(_W) - start, other)
        x = np.choose(which, (p2, p1, 0)).astype(np.uint32)
        rows = np.nonzero(other)[0]
        unit = interval.wide[rows] >> _W(order0.bits)
        own = order0.id_at[np.minimum((value[rows] - interval.low[rows]) // unit, _W((1 << order0.bits) - 1))]
        x[rows] = own
        interval.low[rows] += unit * order0.start[own]
        interval.wide[rows] = unit * order0.size[own]
        for rows, _ in interval.words():
            value[rows] = value[rows] << _W(16) | data[rows, np.minimum(at[rows], room - 1)]
            at[rows] += 1
        out[t] = x
        mixer.update(x)
    return out.T


_HEAD, _DOC = struct.Struct("<4sIIIII"), np.dtype([("key", "<i8"), ("flags", "<u4"), ("ordinal", "<u8"), ("piece", "<u4"), ("ids", "<u4")])
NO_KEY, LAST_PIECE = 1, 2


def payload(docs: np.ndarray, coded: bytes, order0: Order0) -> bytes:
    body = docs.tobytes() + coded
    head = _HEAD.pack(MAGIC, int(docs["ids"].sum()), len(docs), len(coded), len(order0.size), order0.crc)
    return head + body + struct.pack("<I", zlib.crc32(head + body))


def opened(value: bytes, order0: Order0) -> tuple[np.ndarray, bytes]:
    """(documents, coded bytes); a damaged block, or one of another order 0, is
    an error."""
    if len(value) < _HEAD.size + 4 or zlib.crc32(value[:-4]) != struct.unpack("<I", value[-4:])[0]:
        raise ValueError("damaged block: checksum")
    magic, ids, n, size, bound, crc = _HEAD.unpack_from(value)
    docs = np.frombuffer(value, dtype=_DOC, count=n, offset=_HEAD.size)
    if magic != MAGIC or _HEAD.size + docs.nbytes + size + 4 != len(value) or int(docs["ids"].sum()) != ids:
        raise ValueError("damaged block: header")
    if (bound, crc) != (len(order0.size), order0.crc):
        raise ValueError("block of another order 0")
    return docs, value[_HEAD.size + docs.nbytes:-4]


class LibraryWords(bpe.Encoder):
    """Encodes whole texts; words not met before go to the tokenizers library,
    many in one call: the end-of-word suffix tells where each one's ids end."""

    remembered = 1 << 19

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        super().__init__(path)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        suffix = self.vocabulary.suffix
        self.last = np.array([bool(suffix) and t.endswith(suffix) for t in self.vocabulary.tokens])
        self.merge = self._ask

    def _ask(self, words) -> dict[str, bytes]:
        words = list(words)
        out: dict[str, bytes] = {}
        for s in range(0, len(words), 1024):
            part = words[s:s + 1024]
            ids = np.array(self.library.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, dtype=np.int32)
            ends = 4 * (np.nonzero(self.last[ids])[0] + 1)
            if len(ends) == len(part):
                raw = ids.tobytes()
                out.update((w, raw[a:b]) for w, a, b in zip(part, [0, *ends[:-1].tolist()], ends.tolist(), strict=True))
            else:  # a vocabulary without such a suffix
                found = self.library.encode_batch_fast(part, add_special_tokens=False)
                out.update((w, np.array(f.ids, dtype=np.int32).tobytes()) for w, f in zip(part, found, strict=True))
        return out


_libraries: dict[str, LibraryWords] = {}


def _library(path: str) -> LibraryWords:
    if path not in _libraries:
        _libraries[path] = LibraryWords(path)
    return _libraries[path]


class Blocks:
    """Cuts the ids of documents into blocks and codes them by groups."""

    def __init__(self, part: int, order0: Order0, block_ids: int = BLOCK_IDS, lanes: int = LANES):
        self.part, self.order0, self.block_ids, self.lanes = part, order0, block_ids, lanes
        self.ids, self.docs, self.held, self.full, self.number, self.ordinal = [], [], 0, [], 0, 0

    def add(self, key: int | None, ids: np.ndarray) -> None:
        at, piece = 0, 0
        while at < len(ids):
            take = min(len(ids) - at, self.block_ids - self.held)
            flags = NO_KEY * (key is None) | LAST_PIECE * (at + take == len(ids))
            self.ids.append(ids[at:at + take])
            self.docs.append((key or 0, flags, self.ordinal, piece, take))
            self.held += take
            at, piece = at + take, piece + 1
            if self.held == self.block_ids:
                self._close()
        self.ordinal += 1

    def _close(self) -> None:
        if self.docs:
            self.full.append((np.array(self.docs, dtype=_DOC), np.concatenate(self.ids)))
            self.ids, self.docs, self.held = [], [], 0

    def rows(self, last: bool = False) -> Iterator[pa.RecordBatch]:
        """Coded blocks, once a group is full or at the end."""
        if last:
            self._close()
        while len(self.full) >= self.lanes or last and self.full:
            group, self.full = self.full[:self.lanes], self.full[self.lanes:]
            lengths = np.array([len(x) for _, x in group])
            ids = np.zeros((len(group), lengths.max()), dtype=np.uint32)
            for i, (_, x) in enumerate(group):
                ids[i, :len(x)] = x
            coded = code(ids, lengths, self.order0)
            values = [payload(d, c, self.order0) for (d, _), c in zip(group, coded, strict=True)]
            yield pa.RecordBatch.from_arrays([
                pa.array([self.part] * len(group), pa.int32()), pa.array(range(self.number, self.number + len(group)), pa.int32()),
                pa.array(lengths, pa.int64()), pa.array(values, pa.binary())], ["part", "block", "n_ids", "payload"])
            self.number += len(group)


FILE = "part int, block int, n_ids long, payload binary"


def _bound(tokenizer: str, end_id: int) -> int:
    return max(len(_library(tokenizer).vocabulary.tokens), end_id + 1)


def _stored(bound: int) -> str:
    """How ids below a bound are stored before they are coded."""
    return "<u2" if bound <= 1 << 16 else "<i4"


def encoded(df: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int = END_ID) -> DataFrame:
    """(key, tie, ids), written: each text's ids with the end id."""
    rows = pick(df, key, text).select("key", F.xxhash64("text").alias("tie"), "text")
    stored = _stored(_bound(tokenizer, end_id))
    end = np.array([end_id], dtype=stored).tobytes()

    def run(keys: list, ties: list, texts: list) -> dict[str, list]:
        ids = [x for part in bpe.in_parts(texts) for x in _library(tokenizer).encode(part)]
        return {"key": keys, "tie": ties, "ids": [x.astype(stored).tobytes() + end for x in ids]}

    return written(by_batch_of(rows, run, "key long, tie long, ids binary"), "token-ids")


def id_counts(ids: DataFrame, bound: int) -> np.ndarray:
    """How often each id below ``bound`` stands in all rows."""
    stored = _stored(bound)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(bound, dtype=np.int64)
        for batch in batches:
            for raw in batch.column(0):
                held += np.bincount(np.frombuffer(raw.as_buffer(), dtype=stored), minlength=bound)
        at = np.nonzero(held)[0]
        yield pa.RecordBatch.from_pydict({"id": at, "n": held[at]})

    out = np.zeros(bound, dtype=np.int64)
    for i, n in in_arrow(ids.select("ids"), run, "id long, n long").groupBy("id").agg(F.sum("n")).collect():
        out[i] = n
    return out


def write(df: DataFrame, tokenizer: str, path: str, key: str = "doc_id", text: str = "text", end_id: int = END_ID) -> str:
    """Write the ids of all rows, in ascending key order, as token files at ``path``."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = encoded(df, tokenizer, key, text, end_id)
    bound = _bound(tokenizer, end_id)
    stored, order0 = _stored(bound), Order0.of(id_counts(ids, bound))
    sent = spark.sparkContext.broadcast(order0.to_bytes())
    by = F.col("key").asc_nulls_first()
    ordered = ids.repartitionByRange(parts, by).sortWithinPartitions(by, "tie")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = Blocks(TaskContext.get().partitionId(), Order0.from_bytes(sent.value))
        for batch in batches:
            for k, raw in zip(batch.column("key").to_pylist(), batch.column("ids"), strict=True):
                blocks.add(k, np.frombuffer(raw.as_buffer(), dtype=stored))
                if len(blocks.full) >= blocks.lanes:
                    yield from blocks.rows()
        yield from blocks.rows(last=True)

    in_arrow(ordered.select("key", "ids"), run, FILE).write.parquet(path)
    spark.createDataFrame([(-1, -1, 0, order0.to_bytes())], FILE).coalesce(1).write.mode("append").parquet(path)
    return path


def _files(spark, path: str) -> tuple[DataFrame, object]:
    """(blocks, order 0 sent to the tasks) of the files at ``path``."""
    rows = spark.read.schema(FILE).parquet(path)
    raw = rows.filter("part = -1").first()["payload"]
    return rows.filter("part >= 0"), spark.sparkContext.broadcast(bytes(raw))


def crc_combine(first: int, second: int, size: int) -> int:
    """CRC-32 of two byte strings in a row from theirs and the second's size:
    the first is moved on by ``size`` zero bytes, a linear map over GF(2)."""
    def times(matrix: list[int], v: int) -> int:
        out = 0
        for i in range(32):
            if v >> i & 1:
                out ^= matrix[i]
        return out

    step = [0xEDB88320, *(1 << i for i in range(31))]  # one zero bit
    for _ in range(3):
        step = [times(step, x) for x in step]  # 2, 4, 8 bits: one byte
    while size:
        if size & 1:
            first = times(step, first)
        step = [times(step, x) for x in step]
        size >>= 1
    return first ^ second


def read(spark, path: str) -> DataFrame:
    """(part, block, at, key, ordinal, piece, last, ids): the pieces of all
    documents with their ids; ``at`` is the place in the block."""
    files, sent = _files(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, docs, ids in _decoded(batches, Order0.from_bytes(sent.value)):
            ends = np.cumsum([0, *docs["ids"].tolist()])
            n = len(docs)
            yield pa.RecordBatch.from_arrays([
                pa.array([row[0]] * n, pa.int32()), pa.array([row[1]] * n, pa.int32()), pa.array(ends[:-1], pa.int64()), _keys(docs),
                pa.array(docs["ordinal"].astype(np.int64)), pa.array(docs["piece"].astype(np.int64)),
                pa.array((docs["flags"] & LAST_PIECE) > 0), bpe.lists([ids[s:e].astype(np.int32) for s, e in zip(ends[:-1], ends[1:], strict=True)])],
                ["part", "block", "at", "key", "ordinal", "piece", "last", "ids"])

    return in_arrow(files.select("part", "block", "payload"), run,
                    "part int, block int, at long, key long, ordinal long, piece long, last boolean, ids array<int>")


def _keys(docs: np.ndarray) -> pa.Array:
    return pa.array(docs["key"], mask=(docs["flags"] & NO_KEY) > 0)


def _decoded(batches: Iterator[pa.RecordBatch], order0: Order0) -> Iterator[tuple[tuple[int, int], np.ndarray, np.ndarray]]:
    """((part, block), documents, ids) of each block, decoded by groups."""
    held: list[tuple[tuple[int, int], np.ndarray, bytes]] = []

    def out() -> Iterator[tuple[tuple[int, int], np.ndarray, np.ndarray]]:
        lengths = np.array([int(d["ids"].sum()) for _, d, _ in held], dtype=np.int64)
        ids = decode([c for _, _, c in held], lengths, order0)
        for i, (row, docs, _) in enumerate(held):
            yield row, docs, ids[i, :lengths[i]]
        held.clear()

    for batch in batches:
        for part, block, value in zip(batch.column("part").to_pylist(), batch.column("block").to_pylist(), batch.column("payload"), strict=True):
            held.append(((part, block), *opened(value.as_py(), order0)))
            if len(held) == LANES:
                yield from out()
    if held:
        yield from out()


class Runs:
    """Joins the pieces of documents that follow each other in one task."""

    def __init__(self):
        self.open: tuple | None = None
        self.done: list[tuple] = []

    def add(self, row: tuple[int, int], docs: np.ndarray, ids: np.ndarray) -> None:
        raw = ids.astype("<u4")
        part, block = row
        at = 0
        for key, flags, ordinal, piece, n in docs.tolist():
            data = raw[at:at + n].tobytes()
            last = bool(flags & LAST_PIECE)
            o = self.open
            if o and (o[0], o[4], o[9] + 1) == (part, ordinal, piece):
                self.open = (*o[:6], last, o[7] + n, zlib.crc32(data, o[8]), piece)
            else:
                self.close()
                self.open = (part, block, at, None if flags & NO_KEY else key, ordinal, piece, last, n, zlib.crc32(data), piece)
            if last:
                self.close()
            at += n

    def close(self) -> None:
        if self.open:
            self.done.append(self.open[:9])
            self.open = None

    def rows(self) -> pa.RecordBatch:
        names = ["part", "block", "at", "key", "ordinal", "piece", "last", "n", "crc"]
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64()]
        cols = list(zip(*self.done, strict=True)) if self.done else [[]] * len(names)
        self.done = []
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)


def index(spark, path: str) -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of every document, from the files alone."""
    files, sent = _files(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = Runs()
        for row, docs, ids in _decoded(batches, Order0.from_bytes(sent.value)):
            runs.add(row, docs, ids)
            if len(runs.done) >= 8192:
                yield runs.rows()
        runs.close()
        yield runs.rows()

    # Written, as it is read twice: whole documents and the few that two tasks share.
    found = written(in_arrow(files.select("part", "block", "payload"), run,
                             "part int, block int, at long, key long, ordinal long, piece long, last boolean, n long, crc long"), "token-index")
    sizes = files.select("part", "block", "n_ids")
    before = F.sum("n_ids").over(Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    # One row per part: their running sum is a small window.
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("held"))
    parts = parts.select("part", F.coalesce(F.sum("held").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("lead"))
    starts = sizes.withColumn("before", F.coalesce(before, F.lit(0))).join(parts, "part") \
        .select("part", "block", (F.col("lead") + F.col("before")).alias("lead"))
    placed = found.join(starts, ["part", "block"]).select("part", "ordinal", "piece", "last", "key", (F.col("lead") + F.col("at")).alias("start"), "n", "crc")
    whole = placed.filter("piece = 0 and last").select("key", "start", F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32"))

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("piece")
        crc = 0
        for n, own in zip(pdf["n"], pdf["crc"], strict=True):
            crc = crc_combine(crc, int(own), 4 * int(n))
        first = pdf.iloc[0]
        key = None if pd.isna(first["key"]) else int(first["key"])
        return pd.DataFrame({"key": pd.array([key], dtype="Int64"), "start": [int(pdf["start"].min())], "n_tokens": [int(pdf["n"].sum())], "ids_crc32": [crc]})

    cut = placed.filter("not (piece = 0 and last)").groupBy("part", "ordinal").applyInPandas(join, "key long, start long, n_tokens long, ids_crc32 long")
    return whole.unionAll(cut)


def op10(spark, sf_dir: str) -> DataFrame:
    """``op10_token_file``: the documents' ids, written and read back."""
    path = write(documents(spark, sf_dir), bpe.default_path(), scratch_path(spark, "token-files"))
    return index(spark, path).withColumnRenamed("key", "doc_id")
