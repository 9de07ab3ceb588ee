"""Substring dedup (operator 4): difference-cover anchors.

A difference cover D modulo a period v holds, for any two residues, a shift below v that takes both into
D. So if two texts share `window` words, some shift below v reaches positions of both that lie in D
modulo v, and the v-shorter anchors there are equal. Only windows of `window - v + 1` words at cover
positions are hashed for all documents (|D| / v of them); anchors that occur in one document only prove
that no long match passes there. Around the others the match is extended: the full windows that hold a
shared anchor are hashed (128 bits), the smallest doc_id of each is found, and every window that also
starts in a document with a smaller doc_id marks its words.

Minima are written out before they are joined, as Spark splits a skewed key only where both sides of a
join come straight from a shuffle. The exchanges carry hashes, identifiers and positions; minima are combined before each shuffle, so a
passage that a third of all documents share reaches the next step as one row a task. Texts move only to
meet their own spans.

Edge cases: null and empty texts have no words, so nothing is removed; texts shorter than the window
stay whole; rows that share a doc_id never remove words from each other; a null doc_id is smaller than
none, so such rows neither remove nor lose words; an empty table gives an empty result. A task holds
the arrays of about 2 MB of text at once, or of one text where that is longer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import JoinedWords, Rolling, Scratch, chunks, documents, merged, mix, signed, text_bytes, with_side, word_spans

#: A perfect difference set; every residue modulo 31 is the difference of two of its members.
PERIOD, COVER = 31, (0, 1, 3, 8, 12, 18)

_FIRST, _SECOND = Rolling(0xD1342543DE82EF95), Rolling(0xAF251AF3B0F025B5)
KEY = ["doc_id", "row_hash"]


class Words:
    """The words of a chunk of rows: rows' first words, and hashes of any run of words.

    A word's values are XXH64 of its bytes, under a seed of their own for each hash of runs, so that the hashes of a
    window share nothing and words that were made to collide under a polynomial do not.
    """

    def __init__(self, text: pa.Array):
        words = JoinedWords(text)
        self.rows = words.rows
        self.codes, self.vocabulary = words.codes()

    def runs(self, rolling: Rolling, seed: int, at: np.ndarray, length: int) -> np.ndarray:
        values = np.array([xxhash.xxh64_intdigest(w, seed) for w in self.vocabulary], np.uint64)[self.codes]
        return mix(rolling.spans(rolling.prefix(values), at, at + length))

    def positions(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, word within the row) of every run of `length` words."""
        n = np.maximum(np.diff(self.rows) - length + 1, 0)
        row = np.repeat(np.arange(len(n)), n)
        return row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)


def _rows(chunk: pa.RecordBatch, row: np.ndarray, **more: np.ndarray) -> pa.RecordBatch:
    take = pa.array(row)
    return pa.RecordBatch.from_pydict({k: chunk.column(k).take(take) for k in KEY} | {k: pa.array(v) for k, v in more.items()})


def anchors(docs: DataFrame, window: int) -> DataFrame:
    """(doc_id, row_hash, at, anchor) for the word positions of the difference cover."""
    length, in_cover = window - PERIOD + 1, np.isin(np.arange(PERIOD), COVER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch):
                words = Words(chunk.column("text"))
                row, at = words.positions(length)
                long = np.diff(words.rows)[row] >= window
                keep = in_cover[at % PERIOD] & long
                row, at = row[keep], at[keep]
                yield _rows(chunk, row, at=at.astype(np.int32), anchor=signed(words.runs(_FIRST, 2, words.rows[row] + at, length)))

    return docs.mapInArrow(run, "doc_id long, row_hash long, at int, anchor long")


def shared(rows: DataFrame, by: list[str]) -> DataFrame:
    """Keys that occur under two doc_ids or more, with the smallest."""
    least = rows.groupBy(*by).agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))
    return least.where("first_id < last_id").drop("last_id")


def spans_of(rows: DataFrame, before: int, after: int, name: str) -> DataFrame:
    """Per document the union of [at - before, at + after): arrays <name>_from and <name>_to."""
    lists = rows.groupBy(*KEY).agg(F.collect_list("at").alias("at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for at in batch.column("at"):
                at = at.values.to_numpy()
                out.append(merged(np.maximum(at - before, 0), at + after))
            spans = [pa.array([x[i] for x in out], pa.list_(pa.int32())) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in KEY] + spans, names=[*KEY, f"{name}_from", f"{name}_to"])

    return lists.mapInArrow(run, f"doc_id long, row_hash long, {name}_from array<int>, {name}_to array<int>")


def side_bytes(name: str):
    return 64 + 8 * F.size(f"{name}_from")


def full_windows(zoned: DataFrame, window: int) -> DataFrame:
    """(doc_id, row_hash, at, h1, h2) of the windows that start in a document's zones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch):
                words = Words(chunk.column("text"))
                n = np.diff(words.rows)
                lists = [(f.values.to_numpy(), t.values.to_numpy()) for f, t in zip(chunk.column("zone_from"), chunk.column("zone_to"), strict=True)]
                row = np.repeat(np.arange(len(lists)), [len(f) for f, _ in lists])
                start = np.concatenate([f for f, _ in lists]).astype(np.int64)
                stop = np.minimum(np.concatenate([t for _, t in lists]), n[row] - window + 1)
                size = np.maximum(stop - start, 0)
                at = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())
                row = np.repeat(row, size)
                first = words.rows[row] + at
                h1, h2 = (signed(words.runs(r, seed, first, window)) for r, seed in ((_FIRST, 3), (_SECOND, 4)))
                yield _rows(chunk, row, at=at.astype(np.int32), h1=h1, h2=h2)

    return zoned.mapInArrow(run, "doc_id long, row_hash long, at int, h1 long, h2 long")


def removed_spans(docs: DataFrame, window: int, scratch: Scratch) -> DataFrame:
    """(doc_id, row_hash, cut_from, cut_to): word spans that lie in windows seen under a smaller doc_id."""
    known = docs.where(F.col("doc_id").isNotNull())
    rows = anchors(known, window)
    near = rows.join(scratch.table(shared(rows, ["anchor"]), "anchors").hint("merge"), "anchor")
    zones = scratch.table(spans_of(near, PERIOD - 1, 1, "zone"), "zones")
    zoned = with_side(known, zones, KEY, side_bytes("zone"), "inner")
    rows = full_windows(zoned, window)
    firsts = scratch.table(shared(rows, ["h1", "h2"]), "windows")
    later = rows.join(firsts.hint("merge"), ["h1", "h2"]).where("first_id < doc_id")
    cuts = scratch.table(spans_of(later, 0, window, "cut"), "cuts")
    for name in ("anchors", "windows", "zones"):
        scratch.drop(name)
    return cuts


def cut_words(marked: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and the kept words, joined by single spaces; a column `rest` is carried along."""
    rest = [f for f in marked.schema.fields if f.name == "rest"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch):
                data, offsets = text_bytes(chunk.column("text"))
                starts, ends, base = word_spans(data, offsets)
                edges = np.zeros(len(starts) + 1, np.int64)
                for i, (f, t) in enumerate(zip(chunk.column("cut_from"), chunk.column("cut_to"), strict=True)):
                    if f.is_valid:
                        np.add.at(edges, base[i] + f.values.to_numpy(), 1)
                        np.add.at(edges, base[i] + t.values.to_numpy(), -1)
                gone = np.cumsum(edges)[:-1] > 0
                kept = []
                view = memoryview(np.ascontiguousarray(data))
                for i in range(len(chunk)):
                    s, e = starts[base[i] : base[i + 1]], ends[base[i] : base[i + 1]]
                    stay = ~gone[base[i] : base[i + 1]]
                    kept.append(b" ".join([view[a:b] for a, b in zip(s[stay].tolist(), e[stay].tolist(), strict=True)]).decode())
                total = np.r_[0, np.cumsum(gone)]
                yield pa.RecordBatch.from_arrays(
                    [chunk.column("doc_id"), pa.array(np.diff(base)), pa.array(total[base[1:]] - total[base[:-1]]), pa.array(kept, pa.string()), *(chunk.column(f.name) for f in rest)],
                    names=["doc_id", "n_words", "n_removed", "kept_text", *(f.name for f in rest)],
                )

    schema = StructType([*StructType.fromDDL("doc_id long, n_words long, n_removed long, kept_text string").fields, *rest])
    return marked.mapInArrow(run, schema)


def substring_dedup(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_text. window: words of a match, PERIOD or more."""
    if window < PERIOD:
        raise ValueError(f"window must be {PERIOD} words or more")
    scratch = Scratch(docs.sparkSession, "substring")
    rows = documents(docs, id_col, text_col)
    cuts = removed_spans(rows, window, scratch)
    return cut_words(with_side(rows, cuts, KEY, side_bytes("cut")))


def without_repeats(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """docs with its own columns; the text of rows that lose words is what is left, joined by single spaces.

    length_col: a column that holds the text's length in characters and follows it.
    """
    scratch = Scratch(docs.sparkSession, "substring")
    cuts = removed_spans(documents(docs, id_col, text_col), window, scratch)
    rest = F.struct(*(docs[c] for c in docs.columns if c != text_col))
    text = F.coalesce(docs[text_col], F.lit(""))
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), F.xxhash64(text).alias("row_hash"), docs[text_col].alias("text"), rest.alias("rest"))
    marked = with_side(rows, cuts, KEY, side_bytes("cut"))
    same = marked.where("cut_from IS NULL").select("rest", "text", F.lit(False).alias("changed"))
    less = cut_words(marked.where("cut_from IS NOT NULL")).select("rest", F.col("kept_text").alias("text"), F.lit(True).alias("changed"))
    both = same.unionByName(less)
    own = lambda c: F.when(F.col("changed"), F.length("text").cast(docs.schema[c].dataType)).otherwise(F.col("rest")[c]) if c == length_col else F.col("rest")[c]
    return both.select(*(F.col("text") if c == text_col else own(c).alias(c) for c in docs.columns)).toDF(*docs.columns)


def digest(result: DataFrame) -> DataFrame:
    return result.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
