"""Suffix-array dedup (operator 8): prefix-free parsing of the corpus' bytes.

A string is looked for at every byte: the corpus suffixes that agree in their first `length` bytes form
one class, and all but the first of a class in corpus order (doc_id, then start) are repeats. Sorting
all suffixes is avoided as prefix-free parsing does:

- Triggers. A rolling hash of WIDTH bytes runs over each text; a position whose hash is below a bound (one in
  SPARSE) is a trigger. The trigger of a `length`-byte string is the first one inside it, or where it has none
  the position of its smallest hash. Equal strings have equal triggers at equal places, and every string has one.
- Phrases. Consecutive starts with one trigger form a phrase; it reaches `length - 1` bytes beyond its
  last start, so each string lies in exactly one phrase and phrases overlap as the method asks. By that overlap
  the first symbol of a suffix of the parse decides the order of its first `length` bytes.
- Dictionary and parse. Occurrences whose trigger's WIDTH-gram occurs once in the corpus cannot repeat
  and leave. The distinct phrases left are the dictionary, their occurrences the parse. In the parse only
  the first occurrence of a phrase can hold a first suffix; the others are repeats as a whole.
- Suffix arrays. A dictionary phrase that shares its trigger gram with another is open. Open phrases of one gram
  meet in a cell (of about `cell_phrases`; a gram with more has several cells), where the suffixes of the cell,
  cut at `length` bytes, are sorted by prefix doubling. Equal neighbours are one class; all but its first in
  corpus order are repeats. Where a gram has several cells, the firsts of each cell's classes meet once more.

For highly repetitive text the dictionary is small, and bytes are looked at once per distinct phrase. No task
ever holds the whole dictionary or parse. Minima are combined before shuffles, and are written out before they
are joined, so that Spark can split a skewed key of the join.

Edge cases: null and empty texts have no bytes; texts shorter than `length` stay whole; matches never
cross rows; rows that repeat a doc_id and text count as one document, other rows of one doc_id are
ordered by a hash of their text; a row without a doc_id loses what starts earlier in itself, and neither
loses nor removes bytes for another row's sake; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BYTE_VALUES, Rolling, Scratch, chunks, documents, merged, mix, signed, text_bytes, with_side

#: Bytes of the grams among which triggers are chosen, and how many of them there are to a trigger.
WIDTH, SPARSE = 32, 128
_FIRST, _SECOND = Rolling(0x9E3779B97F4A7C15), Rolling(0xD1342543DE82EF95)
_OTHER_VALUES = mix(np.arange(256, dtype=np.uint64), 2)
KEY = ["doc_id", "row_hash"]
AT = [*KEY, "at"]


class Bytes:
    """The bytes of a chunk of rows, with hashes of any span."""

    def __init__(self, text: pa.Array):
        self.data, self.offsets = text_bytes(text)

    @functools.cached_property
    def sums(self) -> np.ndarray:
        return _FIRST.prefix(BYTE_VALUES[self.data])

    def first(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return signed(mix(_FIRST.spans(self.sums, starts, ends), 3))

    def second(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        sums = _SECOND.prefix(_OTHER_VALUES[self.data])
        return signed(mix(_SECOND.spans(sums, starts, ends), 4))

    def row(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offsets, at, "right") - 1

    def phrases(self, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First start, last start and trigger of every phrase."""
        n, low = len(self.data), np.uint64(0xFFFFFFFF)
        if n < length:
            return (np.zeros(0, np.int64),) * 3
        grams = np.arange(n - WIDTH + 1)
        hashes = mix(_FIRST.spans(self.sums, grams, grams + WIDTH))
        hashes[hashes < np.uint64(2**64 // SPARSE)] = 0  # of several triggers the first counts
        least = (hashes & ~low) | grams.astype(np.uint64)
        reach, full = 1, length - WIDTH + 1
        while 2 * reach <= full:
            least = np.minimum(least[:-reach], least[reach:])
            reach *= 2
        if full > reach:
            least = np.minimum(least[: reach - full], least[full - reach :])
        edges = np.zeros(n + 1, np.int8)
        starts, ends = self.offsets[:-1], self.offsets[1:]
        long = ends - starts >= length
        edges[starts[long]] = 1
        edges[ends[long] - length + 1] -= 1
        at = np.flatnonzero(np.cumsum(edges, dtype=np.int8)[: len(least)])
        if not len(at):
            return (np.zeros(0, np.int64),) * 3
        trigger = (least[at] & low).astype(np.int64)
        cut = np.flatnonzero((trigger[1:] != trigger[:-1]) | (at[1:] != at[:-1] + 1)) + 1
        begin = np.r_[0, cut]
        return at[begin], at[np.r_[cut, len(at)] - 1], trigger[begin]


def _rows(chunk: pa.RecordBatch, row: np.ndarray, **more: np.ndarray) -> pa.RecordBatch:
    take = pa.array(row)
    return pa.RecordBatch.from_pydict({k: chunk.column(k).take(take) for k in KEY} | {k: pa.array(v) for k, v in more.items()})


def _lists(column: pa.Array) -> list[np.ndarray]:
    return [x.values.to_numpy() if x.is_valid else np.zeros(0, np.int32) for x in column]


def _inside(chunk: pa.RecordBatch, row: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which places (row and byte within it, in order) lie in their row's zones."""
    out, edge = np.zeros(len(at), bool), np.searchsorted(row, np.arange(len(chunk) + 1))
    for i, (f, t) in enumerate(zip(_lists(chunk.column("zone_from")), _lists(chunk.column("zone_to")), strict=True)):
        part = at[edge[i] : edge[i + 1]]
        k = np.searchsorted(f, part, "right") - 1
        out[edge[i] : edge[i + 1]] = (k >= 0) & (part < t[np.maximum(k, 0)]) if len(f) else False
    return out


def triggers(docs: DataFrame, length: int) -> DataFrame:
    """(doc_id, row_hash, at, gram) of every phrase's trigger."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch, 1 << 18):
                text = Bytes(chunk.column("text"))
                trigger = text.phrases(length)[2]
                row = text.row(trigger)
                yield _rows(chunk, row, at=(trigger - text.offsets[row]).astype(np.int32), gram=text.first(trigger, trigger + WIDTH))

    return docs.mapInArrow(run, "doc_id long, row_hash long, at int, gram long")


def entries(zoned: DataFrame, length: int) -> DataFrame:
    """(doc_id, row_hash, at, n, gram, p1, p2): the phrases whose triggers lie in a document's zones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch, 1 << 18):
                text = Bytes(chunk.column("text"))
                begin, last, trigger = text.phrases(length)
                row = text.row(trigger)
                keep = _inside(chunk, row, trigger - text.offsets[row])
                begin, last, trigger, row = begin[keep], last[keep], trigger[keep], row[keep]
                yield _rows(
                    chunk, row, at=(begin - text.offsets[row]).astype(np.int32), n=(last - begin + 1).astype(np.int32),
                    gram=text.first(trigger, trigger + WIDTH), p1=text.first(begin, last + length), p2=text.second(begin, last + length),
                )

    return zoned.mapInArrow(run, "doc_id long, row_hash long, at int, n int, gram long, p1 long, p2 long")


def open_phrases(zoned: DataFrame, length: int) -> DataFrame:
    """(doc_id, row_hash, at, n, gram, data): the phrases that start in a document's zones, with their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch, 1 << 18):
                text = Bytes(chunk.column("text"))
                begin, last, trigger = text.phrases(length)
                row = text.row(begin)
                keep = _inside(chunk, row, begin - text.offsets[row])
                begin, last, trigger, row = begin[keep], last[keep], trigger[keep], row[keep]
                view = memoryview(np.ascontiguousarray(text.data))
                data = pa.array([view[a:b] for a, b in zip(begin.tolist(), (last + length).tolist(), strict=True)], pa.binary())
                out = _rows(chunk, row, at=(begin - text.offsets[row]).astype(np.int32), n=(last - begin + 1).astype(np.int32), gram=text.first(trigger, trigger + WIDTH))
                yield pa.RecordBatch.from_arrays([*out.columns, data], names=[*out.schema.names, "data"])

    return zoned.mapInArrow(run, "doc_id long, row_hash long, at int, n int, gram long, data binary")


def cut_suffix_ranks(data: np.ndarray, length: int) -> np.ndarray:
    """Rank of the `length` bytes at every position, by prefix doubling; equal strings share a rank.

    The last `length - 1` positions have ranks of no meaning.
    """

    def ranks(keys: np.ndarray) -> np.ndarray:
        order = np.argsort(keys)
        out, keys = np.empty(len(keys), np.uint32), keys[order]
        out[order] = np.cumsum(np.r_[False, keys[1:] != keys[:-1]], dtype=np.uint32)
        return out

    padded, word, reach = np.r_[data, np.zeros(8, np.uint8)], np.zeros(len(data), np.uint64), 8
    for k in range(8):
        word = word << np.uint64(8) | padded[k : k + len(data)]
    if length < 8:
        return ranks(word >> np.uint64(8 * (8 - length)))
    rank = ranks(word)
    while reach < length:
        step = min(reach, length - reach)
        key = rank.astype(np.uint64) << np.uint64(32)
        key[: max(len(rank) - step, 0)] |= rank[step:]
        rank = ranks(key)
        reach += step
    return rank


def classes(table: pa.Table, length: int) -> tuple[Bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The phrases' bytes; row and first byte of every start, in corpus order; and which start begins its class."""
    text = Bytes(table.column("data").combine_chunks())
    n = table.column("n").to_numpy()
    row = np.repeat(np.arange(len(n)), n)
    begin = text.offsets[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    rank = cut_suffix_ranks(text.data, length)[begin].astype(np.uint64)
    order = np.argsort(rank << np.uint64(32) | np.arange(len(row), dtype=np.uint64))
    first = np.empty(len(row), bool)
    first[order] = np.r_[True, rank[order][1:] != rank[order][:-1]][: len(row)]
    return text, row, begin, first


def within_cells(rows: DataFrame, length: int) -> DataFrame:
    """Of open_phrases() that lie sorted by gram, cell and place: (doc_id, row_hash, at, size) of the spans covered by
    strings that an earlier phrase of the cell holds, and, where the gram has several cells, (doc_id, row_hash, at,
    h1, h2) of the first string of every class of the cell."""

    def solve(table: pa.Table) -> pa.RecordBatch:
        # several cells of a gram may have come together: corpus order throughout
        table = table.take(pa.array(np.lexsort([table.column(k).to_numpy() for k in reversed(AT)])))
        text, row, begin, first = classes(table, length)
        start = begin - text.offsets[row]
        later = np.flatnonzero(~first)
        r, s = row[later], start[later]
        cut = np.flatnonzero(np.r_[True, (r[1:] != r[:-1]) | (s[1:] != s[:-1] + 1)][: len(r)])
        size = s[np.r_[cut[1:] - 1, len(r) - 1][: len(cut)]] - s[cut] + length
        more = np.flatnonzero(first & (table.column("cells").to_numpy()[row] > 1))
        at = np.r_[later[cut], more]
        place = table.select([*KEY, "at"]).take(pa.array(row[at])).combine_chunks()
        none, end = np.zeros(len(more), bool), begin[more] + length
        is_first = np.r_[np.zeros(len(cut), bool), ~none]
        hashes = [pa.array(np.r_[np.zeros(len(cut), np.int64), h(begin[more], end)], mask=~is_first) for h in (text.first, text.second)]
        cols = [*(place.column(k).combine_chunks() for k in KEY), pa.array((place.column("at").to_numpy() + start[at]).astype(np.int32))]
        return pa.RecordBatch.from_arrays([*cols, pa.array(np.r_[size, none].astype(np.int32), mask=is_first), *hashes], names=[*AT, "size", "h1", "h2"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not len(batch):
                continue
            table = pa.Table.from_batches([*held, batch])
            gram, cell = table.column("gram").to_numpy(), table.column("cell").to_numpy()
            cut = int(np.argmax((gram == gram[-1]) & (cell == cell[-1])))
            if cut:
                yield solve(table.slice(0, cut))
            held = table.slice(cut).to_batches()
        if held:
            yield solve(pa.Table.from_batches(held))

    return rows.mapInArrow(run, "doc_id long, row_hash long, at int, size int, h1 long, h2 long")


def spans(rows: DataFrame, size: str, name: str) -> DataFrame:
    """Per document the union of [at, at + size): arrays <name>_from and <name>_to."""
    lists = rows.groupBy(*KEY).agg(F.collect_list(F.struct("at", F.expr(size).cast("int").alias("n"))).alias("s")).select(*KEY, "s.at", "s.n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [merged(a, a + n) for a, n in zip(_lists(batch.column("at")), _lists(batch.column("n")), strict=True)]
            two = [pa.array([x[i] for x in out], pa.list_(pa.int32())) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in KEY] + two, names=[*KEY, f"{name}_from", f"{name}_to"])

    return lists.mapInArrow(run, f"doc_id long, row_hash long, {name}_from array<int>, {name}_to array<int>")


def zoned(docs: DataFrame, zones: DataFrame) -> DataFrame:
    return docs.join(zones.hint("merge"), KEY)


def first_of(rows: DataFrame, by: list[str]) -> DataFrame:
    """The first place of each class that has several."""
    return rows.groupBy(*by).agg(F.min(F.struct(*AT)).alias("first"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")


def repeats(docs: DataFrame, length: int, scratch: Scratch, cell_phrases: int = 1 << 15) -> DataFrame:
    """(doc_id, row_hash, cut_from, cut_to): byte spans covered by strings that also start earlier."""
    grams = triggers(docs, length)
    often = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("gram")
    often = scratch.table(often, "often")
    zones = scratch.table(spans(grams.join(often.hint("merge"), "gram"), str(length - WIDTH + 1), "zone"), "zones")
    scratch.release()

    parse = scratch.table(entries(zoned(docs, zones), length), "parse")
    entry = ["p1", "p2"]
    here = F.struct(*AT)
    copies = parse.join(scratch.table(first_of(parse, entry), "entries").hint("merge"), entry).where(here > F.col("first"))
    copies = scratch.table(copies.select(*AT, (F.col("n") + (length - 1)).alias("size")), "copies")
    scratch.release()

    dictionary = parse.groupBy(*entry, "gram", "n").agg(F.min(here).alias("first")).select("gram", "n", "first.*")
    dictionary = scratch.table(dictionary, "dictionary")
    scratch.drop("parse")
    several = scratch.table(dictionary.groupBy("gram").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "several")
    zones = scratch.table(spans(dictionary.join(several.hint("merge"), "gram"), "n", "zone"), "open")
    scratch.release()

    hot = several.where(F.col("c") > cell_phrases).select("gram", F.ceil(F.col("c") / cell_phrases).cast("int").alias("cells"))
    phrases = with_side(open_phrases(zoned(docs, zones), length), hot, ["gram"], F.lit(16)).withColumn("cells", F.coalesce("cells", F.lit(1)))
    phrases = phrases.withColumn("cell", F.pmod(F.xxhash64(*AT), F.col("cells")).cast("int"))
    solved = scratch.table(within_cells(phrases.repartition("gram", "cell").sortWithinPartitions("gram", "cell", *AT), length), "solved")
    scratch.release()
    rows = solved.where("h1 IS NOT NULL").select(*AT, "h1", "h2")
    firsts = scratch.table(first_of(rows, ["h1", "h2"]), "firsts")
    later = rows.join(firsts.hint("merge"), ["h1", "h2"]).where(here > F.col("first")).select(*AT, F.lit(length).alias("size"))
    near = solved.where("size IS NOT NULL").select(*AT, "size")
    out = scratch.table(spans(copies.union(later).union(near), "size", "cut"), "cuts")
    for name in ("often", "entries", "several", "firsts", "solved", "copies", "dictionary", "zones", "open"):
        scratch.drop(name)
    scratch.release()
    return out


def own_repeats(rows: DataFrame, length: int) -> DataFrame:
    """rows with (cut_from, cut_to): byte spans covered by strings that also start earlier in the same row."""

    def cuts(row: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        text = Bytes(row.column("text"))
        begin, last, trigger = text.phrases(length)
        _, gram, c = np.unique(text.first(trigger, trigger + WIDTH), return_inverse=True, return_counts=True)
        begin, last = begin[c[gram] > 1], last[c[gram] > 1]  # of other grams no string comes again
        if not len(begin):
            return (np.zeros(0, np.int32),) * 2
        view = memoryview(np.ascontiguousarray(text.data))
        data = pa.array([view[a:b] for a, b in zip(begin.tolist(), (last + length).tolist(), strict=True)], pa.binary())
        text, phrase, at, first = classes(pa.table({"data": data, "n": last - begin + 1}), length)
        starts = (begin[phrase] + at - text.offsets[phrase])[~first]
        return merged(starts.astype(np.int32), (starts + length).astype(np.int32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [cuts(batch.slice(i, 1)) for i in range(len(batch))]
            two = [pa.array([x[i] for x in out], pa.list_(pa.int32())) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in (*KEY, "text")), *two], names=[*KEY, "text", "cut_from", "cut_to"])

    return rows.select(*KEY, "text").mapInArrow(run, "doc_id long, row_hash long, text string, cut_from array<int>, cut_to array<int>")


def cut_bytes(marked: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch):
                data, offsets = text_bytes(chunk.column("text"))
                view, kept, gone, cuts = memoryview(np.ascontiguousarray(data)), [], [], []
                for i, (f, t) in enumerate(zip(_lists(chunk.column("cut_from")), _lists(chunk.column("cut_to")), strict=True)):
                    begin, end = int(offsets[i]), int(offsets[i + 1])
                    edges = [begin, *(begin + np.stack([f, t], 1).reshape(-1)).tolist(), end]
                    kept.append(b"".join([view[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)]))
                    gone.append(int((t - f).sum()))
                    cuts.append(len(f))
                cols = [pa.array(np.diff(offsets)), pa.array(gone, pa.int64()), pa.array(cuts, pa.int64()), pa.array(kept, pa.binary())]
                yield pa.RecordBatch.from_arrays([chunk.column("doc_id"), *cols], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return marked.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def suffix_dedup(docs: DataFrame, length: int = 100, cell_phrases: int = 1 << 15, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept (binary).

    length: bytes of a match, over WIDTH. cell_phrases bounds the phrases that are sorted at once, not the result.
    """
    if length <= WIDTH:
        raise ValueError(f"length must be over {WIDTH} bytes")
    scratch = Scratch(docs.sparkSession, "suffix")
    rows = documents(docs, id_col, text_col)
    known = rows.where("doc_id IS NOT NULL")
    cuts = repeats(known, length, scratch, cell_phrases)
    marked = known.join(cuts.hint("merge"), KEY, "left").select(*KEY, "text", "cut_from", "cut_to")
    return cut_bytes(marked.union(own_repeats(rows.where("doc_id IS NULL"), length)))


def digest(result: DataFrame) -> DataFrame:
    return result.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
