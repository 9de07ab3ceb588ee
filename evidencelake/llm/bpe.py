"""Byte-level BPE encoding and decoding (operator 6): a two-tier lookup.

Tier one is a minimal perfect hash over the vocabulary, held as flat arrays: n keys in n slots, one displacement
per bucket of about two keys. Pre-tokens are looked up in it all at once, with one probe and one comparison of
bytes each; what is a vocabulary entry as a whole is done. Tier two encodes the misses: the bytes of a pre-token
form a linked list, a heap holds the mergeable neighbours by rank and position, and merges are taken lowest rank
first, leftmost first. Texts of a batch are first cut at spaces between two other characters, if the pattern cuts
there as well (tried when the codec is made), so that each distinct part of a batch is split only once; a worker
remembers the ids of two bounded generations of misses.

The vocabulary (bounded, some hundred KB) travels with the job, so executors need no file of it.

Edge cases: null and empty texts give no ids; characters outside the vocabulary's merges fall back to
bytes, so every text round-trips; very long pre-tokens cost O(n log n); rows are encoded independently,
so repeated rows, ties and an empty table need no care.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BYTE_VALUES, Rolling, chunks, mix

#: Pre-tokens outside the vocabulary in one of the two generations whose ids a worker remembers.
REMEMBERED = 400_000


def read_ranks(path: str) -> list[bytes]:
    """Tokens by rank, from a file with one base64 token and its rank a line."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    out = [b""] * len(pairs)
    for token, rank in pairs:
        out[int(rank)] = base64.b64decode(token)
    return out


#: Where white space meets a space; only single spaces between other characters are safe to cut at.
UNSAFE, SAFE = re.compile(r"\s | \s"), re.compile(r"(?<=\S) (?=\S)")


def parts(text: str) -> list[str]:
    """A text cut where a space stands between two other characters; each part but the first has that space before it."""
    return SAFE.split(text) if UNSAFE.search(text) else text.split(" ")


def cuts_at_spaces(split: Callable[[str], list[str]]) -> bool:
    """A pattern with which a space between two other characters begins a pre-token, tried on every kind of neighbour."""
    kinds = ["a", "É", "漢", "1", "९", ".", "'", "'s", "😀", "_", "\u0301"]
    return all(split(f"{a} {b}") == [*split(a), *split(f" {b}")] for a in kinds for b in kinds)


_BYTES = Rolling(0x9E3779B97F4A7C15)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mix(_BYTES.spans(_BYTES.prefix(BYTE_VALUES[data]), starts, ends) ^ (ends - starts).astype(np.uint64), 6)


class PerfectHash:
    """Minimal perfect hash of byte strings, held as flat arrays: n keys in n slots, one displacement a bucket."""

    def __init__(self, keys: list[bytes], load: int = 2):
        self.n, self.buckets = len(keys), max(1, len(keys) // load)
        self.data, size = np.frombuffer(b"".join(keys), np.uint8), np.array([len(k) for k in keys])
        self.ends = np.cumsum(size)
        self.starts = self.ends - size
        self.hashes = span_hashes(self.data, self.starts, self.ends)
        if len(np.unique(self.hashes)) < self.n:
            raise ValueError("two keys share a hash")
        members: list[list[int]] = [[] for _ in range(self.buckets)]
        hashes = self.hashes.tolist()
        for i, h in enumerate(hashes):
            members[h % self.buckets].append(i)
        shift, slots = [0] * self.buckets, [-1] * self.n
        for b in sorted(range(self.buckets), key=lambda x: -len(members[x])):
            if len(members[b]) < 2:
                break
            d, spots = 0, []
            while len(set(spots)) < len(members[b]) or any(slots[s] >= 0 for s in spots):
                d += 1
                spots = [self.place(hashes[i], d) % self.n for i in members[b]]
            shift[b] = d
            for i, s in zip(members[b], spots, strict=True):
                slots[s] = i
        empty = iter([s for s in range(self.n) if slots[s] < 0])
        for b, m in enumerate(members):
            if len(m) == 1:  # what is left over fits anywhere: the slot itself is stored
                s = next(empty)
                shift[b], slots[s] = -s - 1, m[0]
        self.shift, self.slots = np.array(shift), np.array(slots)

    @staticmethod
    def place(h, d):
        """A number for a hash and a displacement, below 2**63 for displacements below 2**30; arrays or plain numbers."""
        word = type(h) if isinstance(h, int) else np.uint64
        return (h >> word(32)) + d * ((h & word(0xFFFFFFFF)) | word(1)) + d * d * word(7919)

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of the key that each span of data is, or -1."""
        h = span_hashes(data, starts, ends)
        d = self.shift[(h % np.uint64(self.buckets)).astype(np.int64)]
        spot = self.place(h, np.maximum(d, 0).astype(np.uint64)) % np.uint64(self.n)
        at = self.slots[np.where(d < 0, -d - 1, spot.astype(np.int64))]
        near = np.flatnonzero((self.hashes[at] == h) & (self.ends[at] - self.starts[at] == ends - starts))
        out = np.full(len(h), -1)
        if len(near):  # the same hash: compare the bytes
            size = (ends - starts)[near]
            begin = np.cumsum(size) - size
            step = np.arange(size.sum()) - np.repeat(begin, size)
            equal = data[np.repeat(starts[near], size) + step] == self.data[np.repeat(self.starts[at[near]], size) + step]
            near = near[np.logical_and.reduceat(equal, begin)]
            out[near] = at[near]
        return out


def gathered(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of every span, one span after the other."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


class Codec:
    """Encoder and decoder of one vocabulary and one pre-token pattern."""

    def __init__(self, tokens: list[bytes], pattern: str):
        self.tokens, self.ranks = tokens, {t: i for i, t in enumerate(tokens)}
        self.split, self.whole = regex.compile(pattern).findall, PerfectHash(tokens)
        self.spaced = cuts_at_spaces(self.split)
        self.merged: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[1]

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(first id of every text, one more at the end; ids).

        A text is cut at its safe spaces; each distinct part of the texts is split into pre-tokens once.
        """
        index: dict[tuple[str] | str, int] = {}
        entries, sizes = [], []
        for text in texts:
            first, *rest = parts(text) if self.spaced else [text]
            entries.append(index.setdefault((first,), len(index)))  # a tuple: no space before it
            entries.extend([index.setdefault(u, len(index)) for u in rest])
            sizes.append(len(rest) + 1)
        plain = [u for u in index if type(u) is str and u and " " not in u and not u[0].isspace() and not u[-1].isspace()]
        pieces = self.split(f" {' '.join(plain)}") if plain else []
        begins = [k for k, p in enumerate(pieces) if p[0] == " "]
        if len(begins) != len(plain):
            raise ValueError("the pattern does not cut before a space")
        where = dict(zip(plain, begins, strict=True))
        ends = dict(zip(plain, [*begins[1:], len(pieces)][: len(plain)], strict=True))
        edges = np.zeros((len(index), 2), np.int64)
        for u, i in index.items():
            if type(u) is str and u in where:
                edges[i] = where[u], ends[u]
            else:
                some = self.split(u[0] if type(u) is tuple else f" {u}")
                edges[i] = len(pieces), len(pieces) + len(some)
                pieces.extend(some)
        ids, at = self.pretokens(pieces)
        entry = edges[np.array(entries, np.int64)]
        start, size = at[entry[:, 0]], at[entry[:, 1]] - at[entry[:, 0]]
        ends_at = np.r_[0, np.cumsum(size)]
        return ends_at[np.r_[0, np.cumsum(sizes, dtype=np.int64)]], ids[gathered(start, size)]

    def pretokens(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pre-tokens; first id of every pre-token, one more at the end)."""
        flat = "".join(pieces)
        data = flat.encode()
        length = np.fromiter(map(len, pieces) if len(data) == len(flat) else (len(p.encode()) for p in pieces), np.int64, len(pieces))
        end = np.cumsum(length)
        found = self.whole.find(np.frombuffer(data, np.uint8), end - length, end) if len(pieces) else np.zeros(0, np.int64)
        miss = np.flatnonzero(found < 0)
        if len(self.merged) > REMEMBERED:
            self.before, self.merged = self.merged, {}
        merged = [self.missed(data[a:b]) for a, b in zip((end - length)[miss].tolist(), end[miss].tolist(), strict=True)]
        count = np.ones(len(pieces), np.int64)
        count[miss] = [len(m) >> 2 for m in merged]
        at = np.r_[0, np.cumsum(count)]
        ids = np.empty(at[-1], np.uint32)
        whole = np.flatnonzero(found >= 0)
        ids[at[whole]] = found[whole]
        ids[gathered(at[miss], count[miss])] = np.frombuffer(b"".join(merged), np.uint32)
        return ids, at

    def missed(self, piece: bytes) -> bytes:
        """Ids, as bytes, of a pre-token outside the vocabulary; those of recent ones are remembered."""
        out = self.merged.get(piece)
        if out is None:
            out = self.merged[piece] = self.before.get(piece) or array("I", self.merge(piece)).tobytes()
        return out

    def merge(self, piece: bytes) -> list[int]:
        """Ids of a pre-token by merges, lowest rank first and leftmost first.

        Part i ends before end[i] and is followed by part after[i]; pair[i] is the rank of the two, and a
        heap entry (rank, i) counts only while it is.
        """
        n, rank, push = len(piece), self.ranks.get, heapq.heappush
        after, before, pair, heap = list(range(1, n + 1)), list(range(-1, n - 1)), [-1] * n, []
        end = after[:]
        for i in range(n - 1):
            r = rank(piece[i : i + 2])
            if r is not None:
                pair[i] = r
                heap.append(r << 32 | i)
        heapq.heapify(heap)
        while heap:
            top = heapq.heappop(heap)
            i = top & 0xFFFFFFFF
            if pair[i] != top >> 32:
                continue
            j = after[i]
            end[i] = stop = end[j]
            after[i] = k = after[j]
            pair[i] = pair[j] = -1
            if k < n:
                before[k] = i
                r = rank(piece[i : end[k]])
                if r is not None:
                    pair[i] = r
                    push(heap, r << 32 | i)
            p = before[i]
            if p >= 0:
                r = rank(piece[p:stop])
                pair[p] = -1 if r is None else r
                if r is not None:
                    push(heap, r << 32 | p)
        out, i = [], 0
        while i < n:
            out.append(self.ranks[piece[i : end[i]]])
            i = after[i]
        return out


_live: dict[str, Codec] = {}


def live(tokens: list[bytes], pattern: str) -> Codec:
    """This process's codec of a vocabulary."""
    key = hashlib.sha256(pattern.encode() + b"\0".join(tokens)).hexdigest()
    if key not in _live:
        _live[key] = Codec(tokens, pattern)
    return _live[key]


def encode(docs: DataFrame, tokens: list[bytes], pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, ids (array of int)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = live(tokens, pattern)
        for batch in batches:
            for chunk in chunks(batch):
                edges, ids = codec.encode_all(chunk.column("text").to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(ids.view(np.int32)))
                yield pa.RecordBatch.from_arrays([chunk.column("doc_id"), lists], names=["doc_id", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, tokens: list[bytes]) -> DataFrame:
    """Adds decoded (binary) to doc_id and ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, size = np.frombuffer(b"".join(tokens), np.uint8), np.array([len(t) for t in tokens])
        start = np.cumsum(size) - size
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.slice(at, 512)
                ids = part.column("ids").flatten().to_numpy()
                rows = np.r_[0, np.cumsum(part.column("ids").value_lengths().to_numpy(zero_copy_only=False))]
                edges = np.r_[0, np.cumsum(size[ids])][rows]
                text = data[gathered(start[ids], size[ids])]
                decoded = pa.Array.from_buffers(pa.large_binary(), len(part), [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(text)])
                yield pa.RecordBatch.from_arrays([*part.columns, decoded.cast(pa.binary())], names=["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, decoded binary")


def digests(decoded: DataFrame) -> DataFrame:
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
