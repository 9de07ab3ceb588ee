"""SimHash near-dedup (operator 10): anchor-point covering.

Anchors are the codewords of the perfect binary Golay code of length 23, whose covering radius is 3:
every 23-bit word lies within 3 bits of exactly one anchor, its home. A fingerprint is cut into blocks
of 23, 23 and 18 bits. Two fingerprints that differ in 4 bits or fewer differ in at most 1 bit of some
block, so one of them lies within 3 + 1 bits of the other's home there. Each fingerprint is therefore
replicated to every anchor within 4 bits in each block (5.3 on average), and homes are compared with all
that came to their anchor. With `paired`, anchors are pairs of blocks (of which some
pair differs in at most 2 bits): 61 replicas a pair and 4096 times as many anchors, for the same links; it is
chosen by the caller, never by the size of the input.

Copies are counted once: only distinct fingerprints are compared. Within an anchor links are joined to
local groups at once, so a dense group of n sends n links on, not n * n; anchors with more than
`cell_rows` fingerprints are dealt over a triangle of cells that together hold every pair.

Edge cases: null and empty texts have fingerprint zero, linked like any other; texts of one to three
words are one shingle; rows that repeat a doc_id share its component; a null doc_id is never a
component_id unless the whole component has none (then null); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROW, Scratch, chunks, documents, row_name, text_bytes, with_side, without, word_spans
from .components import components

BITS, SHINGLE, SEED = 64, 4, 42
#: The generator polynomial of the Golay code, its length and covering radius.
GENERATOR, LENGTH, RADIUS = 0b110001110101, 23, 3
BLOCKS = ((0, 23), (23, 23), (46, 18))


def fingerprint_rows(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) of documents(): the majority of the XXH64 bits of the word shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch):
                prints = fingerprints(chunk.column("text"), shingle)
                yield pa.RecordBatch.from_arrays([chunk.column("doc_id"), pa.array(prints.view(np.int64))], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def named_fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(ROW, fp) of docs(name, text), where name is a struct of ROW."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch):
                prints = fingerprints(chunk.column("text"), shingle)
                yield pa.RecordBatch.from_arrays([*chunk.column("name").flatten(), pa.array(prints.view(np.int64))], names=[*ROW, "fp"])

    return docs.mapInArrow(run, "known boolean, doc long, row_digest binary, fp long")


def fingerprints(text: pa.Array, shingle: int = SHINGLE) -> np.ndarray:
    data, offsets = text_bytes(text)
    starts, ends, rows = word_spans(data, offsets)
    size = ends - starts + 1
    begin = np.cumsum(size) - size
    joined = data[np.minimum(np.repeat(starts - begin, size) + np.arange(size.sum()), max(len(data) - 1, 0))] if len(size) else data[:0]
    joined = np.where((joined >= 65) & (joined <= 90), joined + 32, joined).astype(np.uint8)
    joined[begin + size - 1] = 32
    words = np.diff(rows)
    n = np.where(words == 0, 0, np.maximum(words - shingle + 1, 1))
    row = np.repeat(np.arange(len(n)), n)
    first = rows[:-1][row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    last = np.minimum(first + shingle, rows[1:][row]) - 1
    view, digest = memoryview(joined), xxhash.xxh64_intdigest
    hashes = np.array([digest(view[a:b], SEED) for a, b in zip(begin[first].tolist(), (begin + size - 1)[last].tolist(), strict=True)], np.uint64)
    out = np.zeros(len(n), np.uint64)
    full = n > 0
    if full.any():
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1)
        counts = np.add.reduceat(bits, (np.cumsum(n) - n)[full], axis=0, dtype=np.int64)
        out[full] = np.packbits(2 * counts > n[full, None], axis=1).reshape(-1).view(np.uint64)
    return out


def _syndrome(word: int) -> int:
    for i in range(LENGTH - 1, 10, -1):
        if word >> i & 1:
            word ^= GENERATOR << (i - 11)
    return word


class Golay:
    """The anchors within a distance of any 23-bit word, by syndrome: patterns[d][s] are the error words
    of weight RADIUS + d (for d = 0: RADIUS or less) that lead from a word of syndrome s to an anchor."""

    def __init__(self, beyond: int):
        single = [_syndrome(1 << i) for i in range(LENGTH)]
        parts = [np.zeros(1 << 8, np.int64) for _ in range(3)]
        for k, table in enumerate(parts):
            for b in range(256):
                for i in range(8):
                    if b >> i & 1 and 8 * k + i < LENGTH:
                        table[b] ^= single[8 * k + i]
        self.parts = parts
        self.patterns: list[list[list[int]]] = [[[] for _ in range(1 << 11)] for _ in range(beyond + 1)]
        for weight in range(RADIUS + beyond + 1):
            for places in combinations(range(LENGTH), weight):
                s = 0
                for i in places:
                    s ^= single[i]
                self.patterns[max(0, weight - RADIUS)][s].append(sum(1 << i for i in places))
        self.sizes = [np.array([len(x) for x in p]) for p in self.patterns]
        self.begins = [np.cumsum(s) - s for s in self.sizes]
        self.flat = [np.array([y for x in p for y in x], np.int64) for p in self.patterns]

    def anchors(self, words: np.ndarray, d: int) -> tuple[np.ndarray, np.ndarray]:
        """(index into words, anchor) for every anchor at distance RADIUS + d (d = 0: the home)."""
        a, b, c = self.parts
        s = a[words & 255] ^ b[words >> 8 & 255] ^ c[words >> 16]
        n = self.sizes[d][s]
        at = np.repeat(np.arange(len(words)), n)
        pick = np.repeat(self.begins[d][s] - (np.cumsum(n) - n), n) + np.arange(len(at))
        return at, words[at] ^ self.flat[d][pick]


_codes: dict[int, Golay] = {}


def golay(beyond: int) -> Golay:
    if beyond not in _codes:
        _codes[beyond] = Golay(beyond)
    return _codes[beyond]


def _blocks(prints: np.ndarray) -> list[np.ndarray]:
    return [(prints >> np.uint64(at) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in BLOCKS]


def covering(prints: np.ndarray, paired: bool) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(index, anchor, is home): every anchor that a fingerprint is replicated to."""
    blocks = _blocks(prints)
    if not paired:
        code = golay(1)
        for k, words in enumerate(blocks):
            for d in (0, 1):
                at, anchor = code.anchors(words, d)
                yield at, anchor | k << 60, d == 0
        return
    code = golay(2)
    for k, (i, j) in enumerate(combinations(range(len(blocks)), 2)):
        for di, dj in ((0, 0), (0, 1), (1, 0), (1, 1), (0, 2), (2, 0)):
            at, left = code.anchors(blocks[i], di)
            again, right = code.anchors(blocks[j][at], dj)
            yield at[again], left[again] << 23 | right | k << 60, di + dj == 0


def replicas(prints: DataFrame, paired: bool) -> DataFrame:
    """(anchor, fp, home) of distinct fingerprints(fp)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("fp").to_numpy()
            for part in np.array_split(column, max(1, -(-len(column) // 4096))):
                for at, anchor, home in covering(part.view(np.uint64), paired):
                    yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(part[at]), pa.array(np.full(len(at), home))], names=["anchor", "fp", "home"])

    return prints.mapInArrow(run, "anchor long, fp long, home boolean")


def cell_links(prints: np.ndarray, home: np.ndarray, threshold: int, rows: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Links from each fingerprint to the smallest of its group, groups formed by homes within the threshold."""
    words, label = prints.view(np.uint64), np.arange(len(prints))
    homes = np.flatnonzero(home)
    for part in np.array_split(homes, max(1, -(-len(homes) // rows))):
        near = np.bitwise_count(words[part, None] ^ words[None, :]) <= threshold
        for i in np.flatnonzero(near.sum(axis=1) > 1):
            met = np.unique(label[near[i]])
            if len(met) > 1:
                label[np.isin(label, met)] = met[0]
    moved = np.flatnonzero(label != np.arange(len(label)))
    return prints[moved], prints[label[moved]]


def anchor_links(rows: DataFrame, threshold: int) -> DataFrame:
    """links(a, b) of rows(anchor, i, j, fp, home) that lie sorted by cell within their partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def cells(table: pa.Table) -> pa.RecordBatch:
            keys = [table.column(k).to_numpy() for k in ("anchor", "i", "j")]
            prints, home = table.column("fp").to_numpy(), table.column("home").to_numpy(zero_copy_only=False)
            edge = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
            a, b = [], []
            for s, e in zip([0, *edge], [*edge, len(prints)], strict=True):
                if e - s > 1 and home[s:e].any():
                    x, y = cell_links(prints[s:e], home[s:e], threshold)
                    a.append(x)
                    b.append(y)
            a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            table = pa.Table.from_batches([batch] if held is None else [*held, batch])
            last = [table.column(k)[-1].as_py() for k in ("anchor", "i", "j")] if len(table) else None
            if last is None:
                continue
            same = np.all([table.column(k).to_numpy() == v for k, v in zip(("anchor", "i", "j"), last, strict=True)], axis=0)
            cut = int(np.argmax(same))
            held = table.slice(cut).to_batches()
            if cut:
                yield cells(table.slice(0, cut))
        if held:
            yield cells(pa.Table.from_batches(held))

    return rows.mapInArrow(run, "a long, b long")


def near_links(prints: DataFrame, scratch: Scratch, threshold: int = 4, paired: bool = False, cell_rows: int = 8192) -> DataFrame:
    """Links between distinct fingerprints(fp) that connect all pairs within the threshold."""
    if threshold > 4:
        raise ValueError("the anchors cover thresholds up to 4 bits")
    rows = replicas(prints, paired)
    hot = rows.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > cell_rows)
    hot = scratch.table(hot.select("anchor", F.ceil(F.col("n") / cell_rows).cast("int").alias("g")), "hot")
    g = F.coalesce("g", F.lit(1))
    own = F.pmod(F.xxhash64("fp"), g).cast("int")
    rows = with_side(rows, hot, ["anchor"], F.lit(16)).select("anchor", "fp", "home", own.alias("own"), F.explode(F.sequence(F.lit(0), g - 1)).alias("other"))
    rows = rows.select("anchor", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp", "home")
    return anchor_links(rows.repartition("anchor", "i", "j").sortWithinPartitions("anchor", "i", "j", "fp"), threshold)


def grouped_prints(rows: DataFrame, scratch: Scratch, threshold: int, paired: bool) -> DataFrame:
    """(fp, root) of the distinct fingerprints of rows(fp), written."""
    prints = scratch.table(rows.select("fp").distinct(), "distinct")
    links = scratch.table(near_links(prints, scratch, threshold, paired), "links")
    roots = components(links, scratch)
    return scratch.table(prints.join(roots.select(F.col("node").alias("fp"), "root").hint("merge"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root")), "roots")


def simhash_dedup(docs: DataFrame, threshold: int = 4, paired: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable)."""
    scratch = Scratch(docs.sparkSession, "simhash")
    rows = scratch.table(fingerprint_rows(documents(docs, id_col, text_col)), "prints")
    roots = grouped_prints(rows, scratch, threshold, paired)
    least = scratch.table(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "least").join(roots.hint("merge"), "fp")
    least = scratch.table(least.groupBy("root").agg(F.min("least").alias("component_id")), "components")
    whole = scratch.table(roots.join(least.hint("merge"), "root").select("fp", "component_id"), "groups")
    return rows.join(whole.hint("merge"), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def simhash_filter(docs: DataFrame, threshold: int = 4, paired: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, unchanged, that stay: of each component the one with the smallest doc_id.

    Of several rows with that doc_id the one with the smallest digest of its text stays; a row without a doc_id
    stays only in a component that has none. Rows that repeat a doc_id and text are one document.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    named = docs.select(F.struct(*row_name(F.col(id_col), F.col(text_col))).alias("name"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = scratch.table(named_fingerprints(named), "prints")
    roots = grouped_prints(rows, scratch, threshold, paired)
    first = F.struct((~F.col("known")).alias("unknown"), *ROW[1:])
    best = scratch.table(rows.groupBy("fp").agg(F.min(first).alias("best")), "best").join(roots.hint("merge"), "fp")
    best = scratch.table(best.groupBy("root").agg(F.min("best").alias("best")), "winners")
    winner = scratch.table(roots.join(best.hint("merge"), "root").select("fp", "best"), "groups")
    gone = scratch.table(rows.join(winner.hint("merge"), "fp").where(first != F.col("best")).select(*ROW), "gone")
    return without(docs, gone, id_col, text_col)
