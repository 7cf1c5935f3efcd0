"""Repeated byte strings across documents by sparse prefix ranking (operator 4).

Removes every byte covered by a string of ``length`` bytes that also starts in
a document with a smaller key.  Texts are UTF-8 bytes, matches never cross
documents, and strings are judged on the input.

Full prefix doubling ranks every byte position in every round.  That is about
sixty times the input in shuffled rank pairs, so positions are thinned first,
without losing a string: each string of ``length`` bytes is represented by its
smallest-hashed inner prefix of ``prefix`` bytes (its *anchor*), which depends
on the string alone, so equal strings have equal anchors at equal offsets.  The
strings of one anchor start at consecutive bytes; all of them together are one
block of at most ``2 * length - prefix`` bytes.  The rounds:

1. Anchors are ranked by their first ``prefix`` bytes: hash partitions over
   Spark, sorted within.  A prefix that is unique leaves, with all its strings.
   Equal blocks (prefix and block hash) are decided at once: all but those of
   the smallest document repeat.
2. What remains (equal prefixes in different blocks, a few per cent) is ranked at
   a larger length: its bytes are fetched by document, each block is halved,
   and a half is ranked by the bytes that all its strings share around the
   anchor (35 of 50).  Unique ones leave, equal halves are decided.
3. What is still open is ranked at ``length`` bytes: every string by its own
   hash, and again all but the smallest document's repeat.

Ranks are hashes (64 bits of the prefix and 64 of the block, 64 and 32 bits of
the string), not dense integers, so no global count is needed between rounds.

Scale: each task first decides what repeats within its own chunk of documents
and sends one row per distinct block and chunk on, so a very frequent string is
at most one row per chunk at its rank.  A prefix with many different blocks (a
frequent line with other neighbours each time) needs no ranking: its chunk sends
one marker for it and hands its blocks on, in the end to round 3, where strings
are dealt by their hashes.  Rows travel as compressed columns in one binary value per chunk
and bucket.  Buckets are sized from the input, but a chunk deals its rows among
at most ``FAN`` of them; a task of more input than that deals what it received
into finer buckets by itself, deciding once more what repeats in it, and judges
them one after the other.  So the rows of a chunk, the number of shuffle
partitions and the memory of a task are bounded at every size of the input.
Text is shuffled once, compressed, for the later rounds and the removal together.

Null texts are empty.  A null key is larger than all others.  Rows with equal
keys never remove from each other; rows are told apart by key and text.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilo.llm.common import documents, in_arrow, pick, written

LENGTH, PREFIX = 50, 20
PIECE = 1 << 19          # bytes hashed at once
CHUNK = 8 << 20          # bytes of text that one task decides on its own
BUCKET_BYTES = 6 << 20  # bytes of text per bucket
FAN = 8192               # buckets, and shuffle partitions, that one chunk deals its rows among
HOT = 8                  # different blocks of a prefix in one chunk that open it at once
STRINGS_HELD = 1 << 20   # strings that one task decides on its own
NULL_KEY = np.iinfo(np.int64).max
_BASE = 6364136223846793005
_U = np.uint64
_SUBSTITUTE = np.frombuffer(hashlib.shake_256(b"byte values").digest(2048), dtype=_U) | _U(1)
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2^64."""
    if not _powers or len(_powers[0]) <= n:
        ones = np.ones(1, dtype=_U)
        _powers[:] = [np.cumprod(np.concatenate([ones, np.full(n, b, dtype=_U)])) for b in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _powers[0], _powers[1]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


class Hashed:
    """Hashes of any ranges of some bytes, from one running sum."""

    def __init__(self, data: np.ndarray):
        up, self.down = powers(max(len(data), PIECE + 4 * LENGTH))
        self.sums = np.zeros(len(data) + 1, dtype=_U)
        np.cumsum(_SUBSTITUTE[data] * up[:len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.down[start]


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while span * 2 <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    rest = width - span
    return np.minimum(x[:len(x) - rest], x[rest:]) if rest else x


def anchors(data: bytes, bounds: np.ndarray, length: int, prefix: int) -> tuple[np.ndarray, ...]:
    """Blocks of some documents' bytes (document d is ``data[bounds[d]:bounds[d
    + 1]]``): (prefix hash, block hash, document, first string start in
    ``data``, number of strings)."""
    x = np.frombuffer(data, dtype=np.uint8)
    if len(x) < length:
        return tuple(np.zeros(0, t) for t in (_U, _U, np.int64, np.int64, np.int64))
    h = Hashed(x)
    n = len(x) - prefix + 1
    kh = (h.sums[prefix:] - h.sums[:-prefix]) * h.down[:n]
    order = _mix(kh)
    order &= _U((1 << 64) - (1 << 24))
    order |= np.arange(n, dtype=_U)
    at = (_sliding_min(order, length - prefix + 1) & _U((1 << 24) - 1)).astype(np.int64)
    valid = np.zeros(len(at), dtype=bool)
    for s, e in zip(bounds[:-1], bounds[1:], strict=True):
        if e - s >= length:
            valid[s:e - length + 1] = True
    start = np.nonzero(valid)[0]
    if not len(start):
        return anchors(b"", bounds, length, prefix)
    anchor = at[start]
    new = np.ones(len(start), dtype=bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)
    place = np.nonzero(new)[0]
    count = np.diff(np.append(place, len(start)))
    first, m = start[place], anchor[place]
    block = h.of(first, first + count - 1 + length)
    block = _mix(block * _U(31) + (m - first).astype(_U) * _U(1000003) + count.astype(_U))
    doc = np.searchsorted(bounds, first, side="right") - 1
    return kh[m], block, doc, first, count


_COLUMNS = {"kh": 8, "block": 8, "tag": 4, "doc": 4, "at": 4, "n": 1}


def pack(keys: np.ndarray, marks: np.ndarray, rows: dict[str, np.ndarray]) -> bytes:
    """Columns of rows, with the documents they name, as one compressed value."""
    out = []
    used, doc = np.unique(rows["doc"], return_inverse=True)
    rows = rows | {"doc": doc}
    cols = [("keys", keys[used].view(np.int64), 8), ("marks", marks[used], 4)]
    cols += [(c, v, _COLUMNS[c]) for c, v in rows.items()]
    for _, v, width in cols:
        raw = np.ascontiguousarray(v).astype({8: np.uint64, 4: np.uint32, 1: np.uint8}[width])
        if width > 1:
            raw = np.diff(raw, prepend=raw[:1] * 0)
        out.append(np.ascontiguousarray(raw.view(np.uint8).reshape(-1, width).T).tobytes())
    return zstandard.ZstdCompressor(level=1).compress(struct.pack("<II", len(used), len(doc)) + b"".join(out))


def unpack(value: bytes, names: tuple[str, ...]) -> dict[str, np.ndarray]:
    """Rows packed by ``pack``: key, mark and the named columns of each."""
    data = zstandard.ZstdDecompressor().decompress(value)
    n_docs, n = struct.unpack_from("<II", data)
    at = 8

    def column(size: int, width: int) -> np.ndarray:
        nonlocal at
        raw = np.frombuffer(data, dtype=np.uint8, count=size * width, offset=at).reshape(width, size).T
        at += size * width
        kind = {8: np.uint64, 4: np.uint32, 1: np.uint8}[width]
        out = np.ascontiguousarray(raw).view(kind).reshape(size)
        return np.cumsum(out, dtype=kind) if width > 1 else out

    keys, marks = column(n_docs, 8).view(np.int64), column(n_docs, 4)
    rows = {c: column(n, _COLUMNS[c]) for c in names}
    doc = rows.pop("doc").astype(np.int64)
    return {"key": keys[doc], "mark": marks[doc], **rows}


def merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of [start, end) per document number; touching ones join."""
    if not len(doc):
        return doc, start, end
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order].astype(np.int64), end[order].astype(np.int64)
    wide = int(end.max()) + 1
    reach = np.maximum.accumulate(doc.astype(np.int64) * wide + end) - doc.astype(np.int64) * wide
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (start[1:] > reach[:-1])
    first = np.nonzero(new)[0]
    return doc[first], start[first], reach[np.append(first[1:], len(doc)) - 1]


def _grouped(*columns: np.ndarray) -> np.ndarray:
    """Group number of each row of sorted columns."""
    new = np.zeros(len(columns[0]), dtype=np.int64)
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.cumsum(new)


def repeats(kh: np.ndarray, block: np.ndarray, key: np.ndarray, opened: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(rows whose whole block is in a smaller document, rows to be judged
    string by string).  Prefixes in ``opened`` are known to have other blocks
    elsewhere."""
    order = np.argsort(kh, kind="stable")
    same = np.zeros(len(kh), dtype=bool)
    same[1:] = kh[order[1:]] == kh[order[:-1]]
    same[:-1] |= same[1:]
    if opened is not None and len(opened):
        same |= np.isin(kh[order], opened)
    rows = order[same]
    none = np.zeros(0, dtype=np.int64)
    if not len(rows):
        return none, none
    rows = rows[np.lexsort((key[rows], block[rows], kh[rows]))]
    k, b, d = kh[rows], block[rows], key[rows]
    cls, grp = _grouped(k, b), _grouped(k)
    first = np.searchsorted(cls, np.arange(cls[-1] + 1))
    later = d > d[first][cls]
    classes = np.bincount(grp[first], minlength=grp[-1] + 1)
    lo, hi = np.full(grp[-1] + 1, NULL_KEY), np.full(grp[-1] + 1, np.iinfo(np.int64).min)
    np.minimum.at(lo, grp, d)
    np.maximum.at(hi, grp[~later], d[~later])
    still = (classes > 1) & (lo < hi)
    if opened is not None and len(opened):
        still |= np.isin(k[np.searchsorted(grp, np.arange(grp[-1] + 1))], opened)
    return rows[later], rows[~later & still[grp]]


def _buckets(hashes: np.ndarray, n: int) -> np.ndarray:
    return ((hashes >> _U(33)) * _U(n) >> _U(31)).astype(np.int64)


def _prefix_buckets(kh: np.ndarray, n: int) -> np.ndarray:
    """Even over anchors, which all have small values of the hash that chose them."""
    return _buckets(_mix((kh ^ _U(0xA0761D6478BD642F)) * _U(0xE7037ED1A0B428DB)), n)


def _mark(raw: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(raw, digest_size=4).digest(), "little")


def _by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(bucket, kind="stable")
    cut = np.nonzero(np.diff(bucket[order]))[0] + 1
    for part in np.split(order, cut):
        if len(part):
            yield int(bucket[part[0]]), part


def _rows(parts: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[0] for p in parts], pa.int32()), pa.array([p[1] for p in parts], pa.int32()),
                                       pa.array([p[2] for p in parts], pa.binary())], ["bucket", "kind", "value"])


ROWS, SPANS, OPEN, STRINGS = 0, 1, 2, 3
_SCHEMA = "bucket int, kind int, value binary"


def _doc_buckets(key: np.ndarray, mark: np.ndarray, n: int) -> np.ndarray:
    return _buckets(_mix(key.view(_U) + mark.astype(_U) * _U(0x9E3779B97F4A7C15)), n)


def _span_rows(keys: np.ndarray, marks: np.ndarray, doc: np.ndarray, start: np.ndarray, end: np.ndarray, n: int, width: int) -> list:
    """Spans of documents by number as packed rows, per bucket of documents; a
    long span is cut into runs of at most 255 starts."""
    start, end = start.astype(np.int64), end.astype(np.int64)
    runs = -(-(end - start - width + 1) // 255)
    row = np.repeat(np.arange(len(doc)), runs)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(runs) - runs, runs)
    at = start[row] + 255 * nth
    count = np.minimum(255, end[row] - width + 1 - at)
    doc = doc[row]
    out = []
    for b, part in _by_bucket(_doc_buckets(keys, marks, n)[doc]):
        part = part[np.lexsort((at[part], doc[part]))]
        out.append((b, SPANS, pack(keys, marks, {"doc": doc[part], "at": at[part], "n": count[part]})))
    return out


def _open_rows(keys: np.ndarray, marks: np.ndarray, doc: np.ndarray, at: np.ndarray, count: np.ndarray, n: int) -> list:
    """Blocks to be judged string by string as packed rows, per bucket of documents."""
    return [(b, OPEN, pack(keys, marks, {"doc": doc[p], "at": at[p], "n": count[p]})) for b, p in _by_bucket(_doc_buckets(keys, marks, n)[doc])]


def _sifted(keys: np.ndarray, marks: np.ndarray, r: dict[str, np.ndarray], n: int, length: int, hot: int) -> list:
    """What blocks of some documents decide among themselves (spans), the
    blocks of prefixes with at least ``hot`` different blocks (open, with one
    marker of no strings a prefix), and the distinct blocks of the others by
    prefix bucket."""
    marker = r["n"] == 0
    opened = np.unique(r["kh"][marker])
    real = np.nonzero(~marker)[0]
    kh, block, doc, at, count = (r[c][real] for c in ("kh", "block", "doc", "at", "n"))
    at, count = at.astype(np.int64), count.astype(np.int64)
    later, _ = repeats(kh, block, keys[doc])
    keep = np.ones(len(kh), dtype=bool)
    keep[later] = False
    out = _span_rows(keys, marks, *merged(doc[later], at[later], at[later] + count[later] - 1 + length), n, length)
    rest = np.nonzero(keep)[0]
    rest = rest[np.argsort(kh[rest], kind="stable")]
    values, first, size = np.unique(kh[rest], return_index=True, return_counts=True)
    many = np.repeat(size >= hot, size)
    opens = rest[many]
    if len(opens):
        out += _open_rows(keys, marks, doc[opens], at[opens], count[opens], n)
    new = ~np.isin(values[size >= hot], opened)
    marks_of = rest[first[size >= hot][new]]
    old = np.nonzero(marker)[0]
    old = old[np.unique(r["kh"][old], return_index=True)[1]]
    rest = rest[~many]
    zero = np.zeros(len(marks_of) + len(old), dtype=np.int64)
    send = {"kh": np.concatenate([kh[rest], kh[marks_of], r["kh"][old]]), "block": np.concatenate([block[rest], zero.view(_U)]),
            "doc": np.concatenate([doc[rest], doc[marks_of], r["doc"][old]]), "at": np.concatenate([at[rest], zero]),
            "n": np.concatenate([count[rest], zero])}
    by = np.argsort(send["kh"], kind="stable")
    send = {c: v[by] for c, v in send.items()}
    out += [(b, ROWS, pack(keys, marks, {c: v[p] for c, v in send.items()})) for b, p in _by_bucket(_prefix_buckets(send["kh"], n))]
    return out


def _round_one(batches: Iterator[pa.RecordBatch], n: int, length: int, prefix: int, piece_bytes: int, chunk_bytes: int, hot: int) -> Iterator[pa.RecordBatch]:
    """What a task decides on its own, and its distinct blocks by prefix bucket."""
    keys, marks, found, held = [], [], [], 0

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal keys, marks, found, held
        if found:
            rows = dict(zip(("kh", "block", "doc", "at", "n"), (np.concatenate(c) for c in zip(*found, strict=True)), strict=True))
            yield _rows(_sifted(np.array(keys, dtype=np.int64), np.array(marks, dtype=np.uint32), rows, n, length, hot))
        keys, marks, found, held = [], [], [], 0

    def gather(raws: list[tuple[int, int, bytes]]) -> None:
        """Anchors of (document number, offset, bytes) pieces."""
        bounds = np.cumsum([0, *(len(r) for _, _, r in raws)])
        kh, block, doc, at, count = anchors(b"".join(r for _, _, r in raws), bounds, length, prefix)
        number, offset = np.array([d for d, _, _ in raws]), np.array([o for _, o, _ in raws])
        found.append((kh, block, number[doc], at - bounds[doc] + offset[doc], count))

    for batch in batches:
        wait, size = [], 0
        for key, text in zip(batch.column("key").to_pylist(), batch.column("text"), strict=True):
            raw = text.as_buffer().to_pybytes() if text.is_valid else b""
            if len(raw) < length:
                continue
            keys.append(NULL_KEY if key is None else key)
            marks.append(_mark(raw))
            for s in range(0, len(raw) - length + 1, piece_bytes):  # pieces share length - 1 bytes: no string is lost
                piece = raw[s:s + piece_bytes + length - 1]
                wait.append((len(keys) - 1, s, piece))
                size += len(piece)
                held += len(piece)
                if size >= piece_bytes:
                    gather(wait)
                    wait, size = [], 0
            if held >= chunk_bytes:
                if wait:
                    gather(wait)
                    wait, size = [], 0
                yield from flush()
        if wait:
            gather(wait)
    yield from flush()


def _buckets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[int, bytes]]]]:
    """Values of each bucket in turn, from rows sorted by bucket."""
    now, held = None, []
    for batch in batches:
        for b, kind, value in zip(*(batch.column(c).to_pylist() for c in ("bucket", "kind", "value")), strict=True):
            if b != now and held:
                yield now, held
                held = []
            now = b
            held.append((kind, value))
    if held:
        yield now, held


def _joined(values: list[bytes], names: tuple[str, ...]) -> dict[str, np.ndarray]:
    parts = [unpack(v, names) for v in values]
    return {c: np.concatenate([p[c] for p in parts]) for c in parts[0]}


def _numbered(rows: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, marks, number of each row's document)."""
    order = np.lexsort((rows["mark"], rows["key"]))
    num = _grouped(rows["key"][order], rows["mark"][order])
    doc = np.empty(len(order), dtype=np.int64)
    doc[order] = num
    first = order[np.searchsorted(num, np.arange(num[-1] + 1))] if len(num) else order
    return rows["key"][first], rows["mark"][first], doc


_BLOCK, _RUN, _STRING = ("kh", "block", "doc", "at", "n"), ("doc", "at", "n"), ("kh", "tag", "doc", "at")


def _finer(batches: Iterator[pa.RecordBatch], n: int, parts: int, kind: int, length: int, hot: int, held_rows: int) -> Iterator[pa.RecordBatch]:
    """Rows of one kind from ``n`` buckets dealt into ``n * parts`` ones, in the
    task that holds them; other kinds go along."""
    names = {ROWS: _BLOCK, STRINGS: _STRING}.get(kind, _RUN)
    fine = n * parts
    values, held = [], 0

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal values, held
        if values:
            r = _joined(values, names)
            keys, marks, r["doc"] = _numbered(r)
            if kind == ROWS:
                out = _sifted(keys, marks, r, fine, length, hot)
            elif kind == STRINGS:
                out = _sifted_strings(keys, marks, r, fine, length)
            else:
                out = [(b, kind, pack(keys, marks, {c: r[c][p] for c in names})) for b, p in _by_bucket(_doc_buckets(keys, marks, fine)[r["doc"]])]
            yield _rows(out)
        values, held = [], 0

    for batch in batches:
        for b, k, value in zip(*(batch.column(c).to_pylist() for c in ("bucket", "kind", "value")), strict=True):
            if k != kind:
                yield _rows([(b * parts, k, value)])
                continue
            values.append(value)
            held += len(value)
            if held >= held_rows * 16:
                yield from flush()
    yield from flush()


def _judge(batches: Iterator[pa.RecordBatch], n: int, parts: int, length: int) -> Iterator[pa.RecordBatch]:
    """Rounds 1 and 2 at a bucket of ranks: decided spans and open blocks, by document bucket."""
    for own, values in _buckets_of(batches):
        # What was decided before came by the bucket of its documents and stays there.
        out = [(own // parts, k, v) for k, v in values if k != ROWS]
        rows = [v for k, v in values if k == ROWS]
        if rows:
            r = _joined(rows, _BLOCK)
            opened = np.unique(r["kh"][r["n"] == 0])
            r = {c: v[r["n"] > 0] for c, v in r.items()}
            later, still = repeats(r["kh"], r["block"], r["key"], opened)
            at, count = r["at"].astype(np.int64), r["n"].astype(np.int64)
            if len(later):
                keys, marks, doc = _numbered({c: v[later] for c, v in r.items()})
                out += _span_rows(keys, marks, doc, at[later], at[later] + count[later] - 1 + length, n, length)
            if len(still):
                keys, marks, doc = _numbered({c: v[still] for c, v in r.items()})
                out += _open_rows(keys, marks, doc, at[still], count[still], n)
        if out:
            yield _rows(out)


def _per_document(batches: Iterator[pa.RecordBatch], length: int, kind: int) -> Iterator[pa.RecordBatch]:
    """One row per document: its spans (united) or its open blocks."""
    for _, values in _buckets_of(batches):
        r = _joined([v for k, v in values if k == kind], _RUN)
        keys, marks, doc = _numbered(r)
        at, count = r["at"].astype(np.int64), r["n"].astype(np.int64)
        if kind == SPANS:
            doc, s, e = merged(doc, at, at + count - 1 + length)
            cols = np.stack([s, e], axis=1)
        else:
            order = np.lexsort((at, doc))
            doc = doc[order]
            cols = np.stack([at[order], count[order]], axis=1)
        cut = np.searchsorted(doc, np.arange(len(keys) + 1))
        for s in range(0, len(keys), 4096):
            e = min(len(keys), s + 4096)
            yield pa.RecordBatch.from_arrays([
                pa.array(keys[s:e]), pa.array(marks[s:e].astype(np.int64)),
                pa.array([cols[a:b].tobytes() for a, b in zip(cut[s:e], cut[s + 1:e + 1], strict=True)], pa.binary())],
                ["key", "mark", "list"])


def _packed_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    zip_ = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        for s in range(0, batch.num_rows, 256):
            part = batch.slice(s, 256)
            raws = [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in part.column("text")]
            keys = part.column("key").to_pylist()
            yield pa.RecordBatch.from_arrays([
                pa.array([NULL_KEY if k is None else k for k in keys], pa.int64()), pa.array([_mark(r) for r in raws], pa.int64()),
                pa.array([k is None for k in keys]), pa.array([zip_.compress(r) for r in raws], pa.binary())], ["key", "mark", "no_key", "zipped"])


def _sifted_strings(keys: np.ndarray, marks: np.ndarray, r: dict[str, np.ndarray], n: int, length: int) -> list:
    """What strings of some documents decide among themselves, and the distinct ones by bucket."""
    later, _ = repeats(r["kh"], r["tag"], keys[r["doc"]])
    out = _string_spans(keys, marks, r["doc"][later], r["at"][later], n, length)
    keep = np.ones(len(r["kh"]), dtype=bool)
    keep[later] = False
    rest = np.nonzero(keep)[0]
    rest = rest[np.argsort(r["kh"][rest], kind="stable")]
    out += [(b, STRINGS, pack(keys, marks, {c: r[c][rest[p]] for c in _STRING})) for b, p in _by_bucket(_buckets(r["kh"][rest], n))]
    return out


def _string_spans(keys: np.ndarray, marks: np.ndarray, doc: np.ndarray, at: np.ndarray, n: int, length: int) -> list:
    at = at.astype(np.int64)
    return _span_rows(keys, marks, *merged(doc, at, at + length), n, length)


def strings(blocks: list[tuple[int, int, bytes]], length: int) -> dict[str, np.ndarray]:
    """Every string of (document number, offset, bytes) blocks: its two hashes, document and offset."""
    size = np.array([len(b) for _, _, b in blocks], dtype=np.int64)
    base = np.cumsum(size) - size
    count = size - length + 1
    row = np.repeat(np.arange(len(blocks)), count)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    start = base[row] + nth
    h = Hashed(np.frombuffer(b"".join([b for _, _, b in blocks]), dtype=np.uint8))
    whole, half = h.of(start, start + length), h.of(start, start + length // 2)
    return {"kh": _mix(whole), "tag": (_mix(half ^ _U(0xA0761D6478BD642F)) >> _U(32)).astype(np.uint32),
            "doc": np.array([d for d, _, _ in blocks], dtype=np.int64)[row], "at": np.array([a for _, a, _ in blocks], dtype=np.int64)[row] + nth}


def halves(blocks: list[tuple[int, int, bytes]], length: int, prefix: int) -> dict[str, np.ndarray]:
    """The two halves of (document number, offset, bytes) blocks, by where their
    strings have the anchor: ranked by the bytes around it that all strings of
    the half share."""
    size = np.array([len(b) for _, _, b in blocks], dtype=np.int64)
    base = np.cumsum(size) - size
    count = size - length + 1
    doc, offset = (np.array([b[i] for b in blocks], dtype=np.int64) for i in (0, 1))
    h = Hashed(np.frombuffer(b"".join([b for _, _, b in blocks]), dtype=np.uint8))
    inner = base[:, None] + np.arange(length - prefix + 1)
    m = base + (_mix(h.of(inner, inner + prefix)) & _U((1 << 64) - (1 << 24))).argmin(axis=1)
    mid = (length - prefix) // 2
    left = np.clip(m - base - mid, 0, count)  # strings with more than mid bytes before the anchor
    out = []
    for first, n, lo, hi, side in ((base, left, m - mid - 1, m + prefix, 0xA0761D6478BD642F), (base + left, count - left, m, m + length - mid, 0xE7037ED1A0B428DB)):
        some = np.nonzero(n > 0)[0]
        first, n, lo, hi, at = first[some], n[some], lo[some], hi[some], m[some]
        whole = h.of(first, first + n - 1 + length)
        out.append({"kh": _mix(h.of(lo, hi) ^ _U(side)),
                    "block": _mix(whole * _U(31) + (at - first).astype(_U) * _U(1000003) + n.astype(_U)),
                    "doc": doc[some], "at": (offset - base)[some] + first, "n": n})
    return {c: np.concatenate([o[c] for o in out]) for c in _BLOCK}


def _of_blocks(batches: Iterator[pa.RecordBatch], rank: Callable, sift: Callable, length: int, held_rows: int) -> Iterator[pa.RecordBatch]:
    """Open blocks of documents ranked anew (``rank``): what a task decides on
    its own, and the rest by bucket (``sift``)."""
    unzip = zstandard.ZstdDecompressor()
    keys, marks, found, wait, size, held = [], [], [], [], 0, 0

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal keys, marks, found, held
        if found:
            r = {c: np.concatenate([f[c] for f in found]) for c in found[0]}
            yield _rows(sift(np.array(keys, dtype=np.int64), np.array(marks, dtype=np.uint32), r))
        keys, marks, found, held = [], [], [], 0

    def gather() -> None:
        nonlocal wait, size, held
        if wait:
            found.append(rank(wait))
            held += len(found[-1]["doc"])
        wait, size = [], 0

    for batch in batches:
        for key, mark, zipped, value in zip(*(batch.column(c).to_pylist() for c in ("key", "mark", "zipped", "list")), strict=True):
            if held >= held_rows:
                gather()
                yield from flush()
            raw = unzip.decompress(zipped)
            keys.append(key)
            marks.append(mark)
            for at, count in np.frombuffer(value, dtype=np.int64).reshape(-1, 2).tolist():
                wait.append((len(keys) - 1, at, raw[at:at + count - 1 + length]))
                size += count - 1 + length
                if size >= PIECE:
                    gather()
    gather()
    yield from flush()


def _judge_strings(batches: Iterator[pa.RecordBatch], n: int, parts: int, length: int) -> Iterator[pa.RecordBatch]:
    """Round 3 at a bucket of strings: those that are in a smaller document."""
    for own, values in _buckets_of(batches):
        out = [(own // parts, k, v) for k, v in values if k != STRINGS]
        some = [v for k, v in values if k == STRINGS]
        if some:
            r = _joined(some, _STRING)
            later, _ = repeats(r["kh"], r["tag"], r["key"])
            if len(later):
                keys, marks, doc = _numbered({c: v[later] for c, v in r.items()})
                out += _string_spans(keys, marks, doc, r["at"][later], n, length)
        if out:
            yield _rows(out)


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unzip = zstandard.ZstdDecompressor()
    for batch in batches:
        for s in range(0, batch.num_rows, 256):
            part = batch.slice(s, 256)
            keys, spans, sizes, kept = [], [], [], []
            for key, no_key, zipped, value in zip(*(part.column(c).to_pylist() for c in ("key", "no_key", "zipped", "list")), strict=True):
                raw = unzip.decompress(zipped)
                cut = np.frombuffer(value or b"", dtype=np.int64)
                ends = [0, *cut.tolist(), len(raw)]
                keys.append(None if no_key else key)
                spans.append(cut)
                sizes.append(len(raw))
                kept.append(b"".join([raw[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True)]))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()),
                                              pa.array(spans, pa.list_(pa.int64())), pa.array(kept, pa.binary())], ["key", "n_bytes", "spans", "kept"])


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, prefix: int = PREFIX,
                   bucket_bytes: int = BUCKET_BYTES, piece_bytes: int = PIECE, chunk_bytes: int = CHUNK, fan: int = FAN,
                   hot: int = HOT, held_rows: int = STRINGS_HELD) -> DataFrame:
    """(key, n_bytes, spans, kept): per input row its size, the removed byte
    spans [start, end) as a flat list, and the bytes that stay."""
    assert length - 255 < prefix < length
    spark = df.sparkSession
    rows = pick(df, key, text)
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    wanted = int(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // bucket_bytes)))
    n = min(wanted, fan)
    parts = -(-wanted // n)

    def in_buckets(some: DataFrame, kind: int) -> DataFrame:
        dealt = some.repartition(n, "bucket")
        if parts > 1:
            dealt = in_arrow(dealt, lambda it: _finer(it, n, parts, kind, length, hot, held_rows), _SCHEMA)
        return dealt.sortWithinPartitions("bucket")

    texts = in_arrow(rows, _packed_texts, "key long, mark long, no_key boolean, zipped binary")
    per_document = "key long, mark long, list binary"

    def judged(blocks: DataFrame, name: str) -> DataFrame:
        return written(in_arrow(in_buckets(blocks, ROWS), lambda it: _judge(it, n, parts, length), _SCHEMA), name)

    def ranked(open_blocks: DataFrame, rank: Callable, sift: Callable) -> DataFrame:
        still = in_arrow(in_buckets(open_blocks.filter(F.col("kind") == OPEN), OPEN), lambda it: _per_document(it, length, OPEN), per_document)
        return in_arrow(texts.join(still, ["key", "mark"]), lambda it: _of_blocks(it, rank, sift, length, held_rows), _SCHEMA)

    one = judged(in_arrow(rows, lambda it: _round_one(it, n, length, prefix, piece_bytes, chunk_bytes, hot), _SCHEMA), "repeats-prefixes")
    two = judged(ranked(one, lambda blocks: halves(blocks, length, prefix), lambda k, m, r: _sifted(k, m, r, n, length, hot)), "repeats-halves")
    three = ranked(two, lambda blocks: strings(blocks, length), lambda k, m, r: _sifted_strings(k, m, r, n, length))
    last = in_arrow(in_buckets(three, STRINGS), lambda it: _judge_strings(it, n, parts, length), _SCHEMA)
    decided = one.unionAll(two).filter(F.col("kind") == SPANS).unionAll(last)
    spans = in_arrow(in_buckets(decided, SPANS), lambda it: _per_document(it, length, SPANS), per_document)
    return in_arrow(texts.join(spans, ["key", "mark"], "left"), _removed, "key long, n_bytes long, spans array<long>, kept binary")


def digest(found: DataFrame) -> DataFrame:
    total = F.aggregate("spans", F.struct(F.lit(0).cast("long").alias("sum"), F.lit(-1).cast("long").alias("sign")),
                        lambda a, x: F.struct((a.sum + a.sign * x).alias("sum"), (-a.sign).alias("sign")), lambda a: a.sum)
    return found.select(F.col("key").alias("doc_id"), "n_bytes", total.alias("n_removed"),
                        F.floor(F.size("spans") / 2).cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op4(spark, sf_dir: str) -> DataFrame:
    """``op4_suffix_dedup``: what stays of every document."""
    return digest(remove_repeats(documents(spark, sf_dir)))
