"""BPE encoding and decoding by a segment tree over pair ranks (operator 6).

Each word (pre-token) is a row of symbols.  The leaves of its segment tree are
the merge ranks of adjacent symbols; inner nodes hold the minimum, so the root
tells the lowest rank and walking down, left child first, finds its leftmost
place.  A merge updates three leaves and their paths, in logarithmic time,
until the root holds no mergeable pair.  Words of up to ``LANE`` symbols are
merged side by side, one tree per row of a numpy array; longer ones by a tree
of their own in plain Python.

The ids of words are remembered in a bounded cache of each worker, so frequent
words are merged once.  The work is per row, without a shuffle; a hot source or a group
of copies only makes the cache hit more often.

The vocabulary is read from a tokenizers JSON file of the kind ``BPE`` with an
end-of-word suffix; its path is a parameter and must be readable on every
executor.  Handled: NFC, white space to one blank, lower case, the split
pattern, byte-level symbols, added tokens.  Null texts are empty: no ids.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilo.llm.common import by_batch_of, documents, pick, with_columns

LANE = 64
CACHE = 1 << 18
PART_CHARS = 1 << 20
NONE = np.iinfo(np.int32).max
# Texts without these are split by a plain character class, which is faster.
_BEYOND = re.compile("[\x1c-\x1f\xb2\xb3\xb9\xbc-\xbe\u0300-\U0010ffff]")
_LATIN = "".join(chr(c) for c in range(0x300) if chr(c).isalpha())


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Vocabulary:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        ids, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        self.suffix = suffix
        self.tokens: list[str] = [""] * (1 + max([*ids.values(), *(t["id"] for t in spec["added_tokens"])]))
        for token, i in ids.items():
            self.tokens[i] = token
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for token, i in self.added.items():
            self.tokens[i] = token
        self.token_array = np.array(self.tokens, dtype=object)
        self.id_names = np.array([str(i) for i in range(len(self.tokens))], dtype=object)
        symbols = byte_symbols()
        self.inner = np.array([ids[s] for s in symbols], dtype=np.int32)
        self.final = np.array([ids[s + suffix] for s in symbols], dtype=np.int32)
        merges = [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank = {(ids[a], ids[b]): r for r, (a, b) in reversed(list(enumerate(merges)))}
        self.merged = np.array([ids[a + b] for a, b in merges], dtype=np.int32)
        keys = sorted((a << 32 | b, r) for (a, b), r in self.rank.items())
        self.pairs = np.array([k for k, _ in keys], dtype=np.int64)
        self.ranks = np.array([r for _, r in keys], dtype=np.int32)
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        pattern = split["pattern"]["Regex"]
        self.split = regex.compile(pattern.replace(r"\s", r"\p{White_Space}"))
        self.latin = re.compile(pattern.replace(r"\p{L}", _LATIN).replace(r"\p{N}", "0-9"))
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair of symbols; NONE where it does not merge or a side is missing (-1)."""
        want = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.pairs, want), len(self.pairs) - 1)
        return np.where((self.pairs[at] == want) & (a >= 0) & (b >= 0), self.ranks[at], NONE)

    def merge_lanes(self, words: list[bytes], width: int) -> list[bytes]:
        """Ids of words of at most ``width`` bytes (a power of two), in lockstep."""
        n = len(words)
        size = np.array([len(w) for w in words])
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), dtype=np.uint8).reshape(n, width)
        place = np.arange(width)
        sym = np.where(place == (size - 1)[:, None], self.final[raw], self.inner[raw])
        sym[place >= size[:, None]] = -1
        sym = np.concatenate([sym, np.full((n, 1), -1, dtype=sym.dtype)], axis=1)  # the place after the last
        after = np.tile(np.minimum(place + 1, width), (n, 1))
        before = np.tile(place - 1, (n, 1))
        before = np.concatenate([before, np.full((n, 1), width - 1)], axis=1)
        tree = np.full((n, 2 * width), NONE, dtype=np.int32)
        tree[:, width:] = self.pair_ranks(sym[:, :-1].ravel(), sym[:, 1:].ravel()).reshape(n, width)
        level = width
        while level > 1:
            tree[:, level // 2:level] = np.minimum(tree[:, level:2 * level:2], tree[:, level + 1:2 * level:2])
            level //= 2
        live = np.nonzero(tree[:, 1] != NONE)[0]
        while len(live):
            node = np.ones(len(live), dtype=np.int64)
            lowest = tree[live, 1]
            while node[0] < width:  # the leftmost leaf with the root's rank
                node *= 2
                node += tree[live, node] != lowest
            i = node - width
            j = after[live, i]
            k = after[live, np.minimum(j, width - 1)]
            p = before[live, i]
            new = self.merged[lowest]
            sym[live, i] = new
            sym[live, j] = -1
            after[live, i] = k
            before[live, k] = i
            here = self.pair_ranks(new, sym[live, k])
            left = self.pair_ranks(np.where(p >= 0, sym[live, p], -1), new)
            for leaf, value in ((j, NONE), (i, here), (np.maximum(p, 0), np.where(p >= 0, left, here))):
                at = leaf + width
                tree[live, at] = value
                while at[0] > 1:
                    at = at >> 1
                    tree[live, at] = np.minimum(tree[live, 2 * at], tree[live, 2 * at + 1])
            live = live[tree[live, 1] != NONE]
        keep = sym[:, :-1] >= 0
        ids = sym[:, :-1][keep].astype(np.int32).tobytes()
        ends = np.cumsum(4 * keep.sum(axis=1)).tolist()
        return [ids[s:e] for s, e in zip([0, *ends[:-1]], ends, strict=True)]

    def merge_long(self, word: bytes) -> np.ndarray:
        """Ids of one word of any length: a segment tree in plain Python."""
        n = len(word)
        width = 1 << max(1, (n - 1).bit_length())
        raw = np.frombuffer(word, dtype=np.uint8)
        first = self.inner[raw]
        first[-1] = self.final[raw[-1]]
        sym = first.tolist()
        leaves = np.full(width, NONE, dtype=np.int32)
        leaves[:n - 1] = self.pair_ranks(first[:-1], first[1:])
        levels = [leaves]
        while len(levels[-1]) > 1:
            levels.append(np.minimum(levels[-1][::2], levels[-1][1::2]))
        tree = [NONE, *np.concatenate(levels[::-1]).tolist()]
        after, before, rank, merged = list(range(1, n + 1)), list(range(-1, n - 1)), self.rank, self.merged

        def put(leaf: int, value: int) -> None:
            at = leaf + width
            tree[at] = value
            while at > 1:
                at >>= 1
                low = min(tree[2 * at], tree[2 * at + 1])
                if tree[at] == low:
                    break
                tree[at] = low

        while tree[1] != NONE:
            lowest, node = tree[1], 1
            while node < width:
                node *= 2
                if tree[node] != lowest:
                    node += 1
            i = node - width
            j = after[i]
            k, p = after[j], before[i]
            new = int(merged[lowest])
            sym[i], sym[j], after[i] = new, -1, k
            put(j, NONE)
            if k < n:
                before[k] = i
            put(i, rank.get((new, sym[k]), NONE) if k < n else NONE)
            if p >= 0:
                put(p, rank.get((sym[p], new), NONE))
        return np.array([s for s in sym if s >= 0], dtype=np.int32)

    def merge(self, words: Iterable[str]) -> dict[str, bytes]:
        """Ids of each pre-token as little-endian 32-bit integers."""
        lanes: dict[int, list[str]] = {}
        out: dict[str, bytes] = {}
        for w in words:
            n = len(raw := w.encode())
            if n > LANE:
                out[w] = self.merge_long(raw).tobytes()
            else:
                lanes.setdefault(max(2, 1 << (n - 1).bit_length()), []).append(w)
        for width, some in lanes.items():
            for s in range(0, len(some), 8192):
                part = some[s:s + 8192]
                out.update(zip(part, self.merge_lanes([w.encode() for w in part], width), strict=True))
        return out


class Encoder:
    """Encodes texts; the ids of words met before are remembered up to a bound."""

    remembered = CACHE

    def __init__(self, path: str):
        self.vocabulary = v = Vocabulary(path)
        self.added = {token: np.int32(i).tobytes() for token, i in v.added.items()}
        self.known = dict(self.added)
        self.merge = v.merge

    def words(self, text: str | None) -> list[str]:
        """Pre-tokens of a text; added tokens stand as they are, which no pre-token can."""
        if not text:
            return []
        v, out, at = self.vocabulary, [], 0
        for m in v.special.finditer(text) if v.special and v.special.search(text) else ():
            out += self._split(text[at:m.start()])
            out.append(m[0])
            at = m.end()
        return out + self._split(text[at:]) if at else self._split(text)

    def _split(self, s: str) -> list[str]:
        if not s.isascii():
            # Character by character, the tokenizer knows no final sigma.
            s = unicodedata.normalize("NFC", s).replace("Σ", "σ")
        s = s.lower()
        return (self.vocabulary.split if _BEYOND.search(s) else self.vocabulary.latin).findall(s)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text."""
        cut = [self.words(t) for t in texts]
        new = set().union(*cut)
        if len(self.known) + len(new) > self.remembered:
            new -= self.added.keys()
            self.known = dict(self.added)
        else:
            new -= self.known.keys()
        self.known.update(self.merge(new))
        ids = self.known.__getitem__
        return [np.frombuffer(b"".join(map(ids, c)), dtype=np.int32) for c in cut]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This worker's encoder for a vocabulary file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def default_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def lists(values: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, values)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*values, np.zeros(0, np.int32)]), pa.int32()))


def in_parts(texts: list[str | None]) -> Iterable[list[str | None]]:
    """Runs of texts of about ``PART_CHARS`` characters, to bound what is split at once."""
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t or "")
        if size >= PART_CHARS:
            yield part
            part, size = [], 0
    if part:
        yield part


def encode(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids): token ids of every row's whole text."""
    def run(keys: list, texts: list) -> dict[str, list]:
        enc = encoder(path)
        return {"key": keys, "ids": lists([ids for part in in_parts(texts) for ids in enc.encode(part)])}
    return by_batch_of(pick(df, key, text), run, "key long, ids array<int>")


def decode(df: DataFrame, path: str, key: str = "key", ids: str = "ids") -> DataFrame:
    """(key, ids, text): the decoded text, special tokens included.  Null ids are empty."""
    def run(keys: pa.Array, rows: pa.ListArray) -> dict[str, list]:
        tokens = encoder(path).vocabulary.token_array
        ends, flat = rows.offsets.to_numpy(), rows.values.to_numpy(zero_copy_only=False)
        texts = [" ".join(tokens[flat[s:e]]) for s, e in zip(ends[:-1], ends[1:], strict=True)]
        return {"key": keys, "ids": rows, "text": texts}
    rows = df.select(F.col(key).alias("key"), F.coalesce(ids, F.array().cast("array<int>")).alias("ids"))
    return by_batch_of(rows, run, "key long, ids array<int>, text string", lists=False)


def tokenized(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``df`` with ``n_tokens``, ``ids`` and the digests of ids and decoded text."""
    def run(texts: list) -> dict[str, list]:
        enc = encoder(path)
        return {"ids": lists([ids for part in in_parts(texts) for ids in enc.encode(part)])}

    def back(rows: list) -> dict[str, list]:
        tokens = encoder(path).vocabulary.token_array
        names = encoder(path).vocabulary.id_names
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        return {"n_tokens": [len(r) for r in rows], "ids_sha256": [sha(" ".join(names[np.array(r, dtype=np.int32)])) for r in rows],
                "decoded_sha256": [sha(" ".join(tokens[np.array(r, dtype=np.int32)])) for r in rows]}

    return with_columns(with_columns(df, text, run, "ids array<int>"), "ids", back,
                        "n_tokens long, ids_sha256 string, decoded_sha256 string")


def digest(decoded: DataFrame) -> DataFrame:
    joined = F.array_join(F.col("ids").cast("array<string>"), " ")
    return decoded.select(
        F.col("key").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(joined.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


def op6(spark, sf_dir: str) -> DataFrame:
    """``op6_bpe``: ids and decoded text of every document, as digests."""
    path = default_path()
    return digest(decode(encode(documents(spark, sf_dir), path), path))
