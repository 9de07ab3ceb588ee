"""Packing (operator 9): shortest-pack-first over the length histogram.

Documents are tokenised and cut into pieces of at most `length` ids: full pieces, and one remainder.
Packing sees only the histogram of piece lengths (at most `length` numbers): lengths are placed longest
first, each into the open packs with the fewest ids so far that still fit it, and the counts of packing
patterns are updated. The patterns become intervals of ranks within each length; pieces get their rank
within their length from per-bucket row numbers and summed bucket counts, so that no task has to number
all pieces of one common length, and look their sequence and offset up by binary search.

Remainders are cut nowhere. A sequence is padded to `length`, except at a power of two.

Edge cases: null and empty texts are one piece holding only the closing id; texts of any length are cut;
rows that repeat a doc_id are packed as documents of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import cuts_at_spaces, parts
from .common import Scratch, chunks, documents, with_side

#: Units in one of the two generations that a worker remembers.
REMEMBERED = 300_000

_live: dict[str, TokenizerUnits] = {}


def byte_tokens(spec: str) -> list[bytes]:
    """Tokens by id of a byte-level `tokenizers` file, in which 256 printable characters stand for the bytes."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    model = json.loads(spec)
    special = {t["id"] for t in model["added_tokens"] if t["special"]}
    vocabulary = {i: bytes(byte[c] for c in t) for t, i in model["model"]["vocab"].items() if i not in special}
    if sorted(vocabulary) != list(range(len(vocabulary))):
        raise ValueError("the ids of the ordinary tokens must count from 0")
    return [vocabulary[i] for i in range(len(vocabulary))]


def added_tokens(spec: str, encode_special_tokens: bool) -> dict[str, int]:
    """Ids of the added tokens of a `tokenizers` file that are cut out of a text before it is split.

    With encode_special_tokens the special ones among them are ordinary text, as in `tokenizers`.
    """
    model = json.loads(spec)
    found = [t for t in model["added_tokens"] if t["content"] and not (t["special"] and encode_special_tokens)]
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] or (t["normalized"] and model["normalizer"]) for t in found):
        raise ValueError("added tokens must match as they stand")
    return {t["content"]: t["id"] for t in found}


class Units(dict):
    """Remembered ids (bytes of little-endian 32-bit numbers) of the units of texts, each unit but the first
    with the space before it.

    Holds for pre-token patterns in which a space between two other characters always begins a pre-token.
    Two generations of `most` units are kept, so frequent units stay when new ones crowd in.
    """

    def __init__(self, encode: Callable[[str], bytes], most: int = REMEMBERED):
        super().__init__()
        self.encode, self.old, self.most = encode, {}, most

    def parts(self, text: str) -> list[str]:
        if len(self) > self.most:
            self.old = dict(self)
            self.clear()
        return parts(text)

    def __missing__(self, unit: str) -> bytes:
        out = self.old.get(unit)
        if out is None:
            out = self.encode(f" {unit}")
        self[unit] = out
        return out


class TokenizerUnits:
    """Ids of a byte-level vocabulary whose ids are its merge ranks; added tokens in a text stand for themselves.

    New units of a batch are encoded in one string and told apart by the bytes of their tokens.
    """

    def __init__(self, tokens: list[bytes], pattern: str, added: dict[str, int]):
        import tiktoken

        self.added = {t: i.to_bytes(4, "little") for t, i in added.items()}
        self.cuts = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None

        self.encoding = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
        if not cuts_at_spaces(regex.compile(pattern).findall):
            raise ValueError("the pattern must cut before a space between two other characters")
        self.widths = np.array([len(t) for t in tokens])
        self.units = Units(self.encode)

    def encode(self, text: str) -> bytes:
        return np.array(self.encoding.encode_ordinary(text), "<u4").tobytes()

    def learn(self, new: list[str]) -> None:
        """Remembers the ids of units that neither begin nor end with white space."""
        if not new:
            return
        ids = np.array(self.encoding.encode_ordinary(" " + " ".join(new)), "<u4")
        ends = np.cumsum([len(u.encode()) + 1 for u in new])
        cut = np.r_[0, np.searchsorted(np.cumsum(self.widths[ids]), ends) + 1].tolist()
        data = ids.tobytes()
        self.units.update((u, data[4 * a : 4 * b]) for u, a, b in zip(new, cut[:-1], cut[1:], strict=True))

    def ids(self, texts: list[str]) -> list[bytes]:
        """Ids of every text; the stretches between added tokens are encoded on their own."""
        held = [i for i, t in enumerate(texts) if self.cuts and self.cuts.search(t)]
        if not held:
            return self.ordinary(texts)
        parts = {i: self.cuts.split(texts[i]) for i in held}  # stretches and added tokens by turns
        flat = [x for i, t in enumerate(texts) for x in (parts[i][::2] if i in parts else [t])]
        coded, out = iter(self.ordinary(flat)), []
        for i in range(len(texts)):
            tokens = [self.added[x] for x in parts[i][1::2]] if i in parts else []
            out.append(next(coded) + b"".join(t + next(coded) for t in tokens))
        return out

    def ordinary(self, texts: list[str]) -> list[bytes]:
        units = self.units
        cut = [units.parts(t) for t in texts]
        new = {u for p in cut for u in p[1:] if u not in units}
        self.learn([u for u in new if u and u not in units.old and not u[0].isspace() and not u[-1].isspace()])
        return [self.encode(p[0]) + b"".join(map(units.__getitem__, p[1:])) for p in cut]


def live(tokens: list[bytes], pattern: str, added: dict[str, int]) -> TokenizerUnits:
    """This process's encoder of a vocabulary."""
    key = hashlib.sha256(pattern.encode() + repr(sorted(added.items())).encode() + b"\0".join(tokens)).hexdigest()
    if key not in _live:
        _live[key] = TokenizerUnits(tokens, pattern, added)
    return _live[key]


def pieces(docs: DataFrame, tokens: list[bytes], pattern: str, added: dict[str, int], length: int = 1024, closing_id: int = 0) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, bucket key) of every piece."""

    closing = closing_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = live(tokens, pattern, added)
        for batch in batches:
            for chunk in chunks(batch, 1 << 20):
                row, start, size, crc, total = [], [], [], [], []
                for i, ids in enumerate(units.ids(chunk.column("text").to_pylist())):
                    data, n = ids + closing, len(ids) // 4 + 1
                    for s in range(0, n, length):
                        row.append(i)
                        start.append(s)
                        size.append(min(length, n - s))
                        crc.append(zlib.crc32(data[4 * s : 4 * (s + length)]))
                        total.append(n)
                cols = [chunk.column(k).take(pa.array(row, pa.int32())) for k in ("doc_id", "row_hash")]
                yield pa.RecordBatch.from_arrays(cols + [pa.array(x, pa.int64()) for x in (start, size, crc, total)], names=["doc_id", "row_hash", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.mapInArrow(run, "doc_id long, row_hash long, start long, length long, ids_crc32 long, doc_tokens long")


def pack(histogram: dict[int, int], length: int) -> list[tuple[tuple[int, ...], int]]:
    """Packing patterns (lengths, longest first) and how many sequences follow each."""
    open_packs: dict[int, list[list]] = defaultdict(list)  # by ids so far: [pattern, count]
    for size in sorted(histogram, reverse=True):
        left, placed = histogram[size], []
        for used in sorted(open_packs):
            if used + size > length or not left:
                break
            packs = open_packs[used]
            while packs and left:
                pattern, count = packs[-1]
                take = min(count, left)
                left -= take
                placed.append((used + size, [(*pattern, size), take]))
                if take == count:
                    packs.pop()
                else:
                    packs[-1][1] -= take
        if left:  # new packs, with as many of this length as fit
            each = max(1, length // size)
            if left >= each:
                placed.append((each * size, [(size,) * each, left // each]))
            if left % each:
                placed.append((left % each * size, [(size,) * (left % each), 1]))
        for used, entry in placed:
            open_packs[used].append(entry)
    return [(tuple(p), n) for used in sorted(open_packs, reverse=True) for p, n in open_packs[used]]


def intervals(patterns: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, ...]:
    """Sorted (length << 42 | first rank), first rank, first sequence, offset of every place in a pattern."""
    rank: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for pattern, count in patterns:
        offset = 0
        for size in pattern:
            rows.append((size << 42 | rank[size], rank[size], sequence, offset))
            rank[size] += count
            offset += size
        sequence += count
    return tuple(np.array(sorted(rows), np.int64).reshape(-1, 4).T)


def pack_documents(
    docs: DataFrame, tokenizer_json: str, pattern: str, length: int = 1024, closing_id: int = 0, id_col: str = "doc_id", text_col: str = "text", encode_special_tokens: bool = True
) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    tokenizer_json is the path of a byte-level `tokenizers` file, read by the driver; pattern is the one
    that its pre-tokenizer splits by. The ids are those that `tokenizers` gives with add_special_tokens=False.
    Added tokens in a text get their own ids; encode_special_tokens, named as in `tokenizers`, takes the special
    ones as ordinary text instead. The registered query and the pipeline set it to False, as `tokenizers` does.
    """
    with open(tokenizer_json, encoding="utf-8") as f:
        spec = f.read()
    tokens, added = byte_tokens(spec), added_tokens(spec, encode_special_tokens)
    scratch = Scratch(docs.sparkSession, "packing")
    rows = scratch.table(pieces(documents(docs, id_col, text_col), tokens, pattern, added, length, closing_id), "pieces")
    buckets = max(64, rows.count() // 200_000)
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "row_hash", "start"), F.lit(buckets)).cast("int"))
    counts = scratch.table(rows.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n")), "counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `length` rows
    code, first, sequence, offset = intervals(pack(histogram, length))

    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    begins = scratch.table(counts.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin")), "begins")
    ranked = rows.withColumn("nth", F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "row_hash", "start")))
    ranked = with_side(ranked, begins, ["length", "bucket"], F.lit(24), "inner").withColumn("rank", F.col("begin") + F.col("nth") - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, rank = (batch.column(k).to_numpy() for k in ("length", "rank"))
            at = np.searchsorted(code, size << 42 | rank, "right") - 1
            out = [batch.column(k) for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
            yield pa.RecordBatch.from_arrays(
                [*out, pa.array(sequence[at] + rank - first[at]), pa.array(offset[at])],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

    ranked = ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "rank")
    return ranked.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
