"""MinHash near-dedup (operator 12): circulant MinHash, banding, exact Jaccard verification.

Two permutations make the whole signature: the first scatters the shingles of a document over 32 bits, the second
is applied to the values shifted round the circle by 0, 1, ..., COORDINATES - 1; coordinate k is the least value under
shift k. ROWS coordinates make a band. Documents with equal sets are one node from the start (128 bits of the set).

Nodes that share a band and agree in GATE of all coordinates (two bits of each) are candidates. A pair at the
threshold of 0.8 shares none of the 32 bands with probability 5e-8, and then fails the gate with 1e-10. Candidates
form groups; every pair within a group that the gate lets through is compared on its full sets, unless already connected, so
a dense group of n costs n comparisons, not n * n. Groups beyond `cell_rows` sets or CELL_WORDS shingles are dealt
over cells that all hold one common member; what that leaves unconnected meets the rest of its group once more. A
band that more than `cell_rows` nodes share makes one group of them without the gate, by links to one member, so no task
holds it. Nothing is capped: groups only ever become larger than need be.

Edge cases: null, empty and blank texts have no set and are linked with nothing (each is its own component); texts
with fewer words than a shingle are one shingle; different texts under one doc_id are documents of their own; a component whose
rows have no doc_id has component_id null and its rows are kept; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROW, JoinedWords, Scratch, chunks, fixed_bytes, mix, row_name, signed, with_side
from .components import components

COORDINATES, ROWS = 128, 4
#: Coordinates of a pair, two bits of each, that must agree: 85 % of 128 do at a similarity of 0.8, with deviation 4.
GATE = 82
LEAST_PERCENT = 80
#: Shingles of the sets that a cell holds, as far as it is not one set alone.
CELL_WORDS = 1 << 21
NODE = 16
_LOW = np.uint64(0x5555555555555555)


def shingle_sets(text: pa.Array, shingle: int) -> list[np.ndarray]:
    """Per row the sorted distinct 64-bit hashes of its shingles, lower-cased A-Z; a shorter text is one shingle."""
    words = JoinedWords(text, fold=True)
    codes, vocabulary = words.codes()
    hashes = np.array([xxhash.xxh64_intdigest(w) for w in vocabulary], np.uint64)[codes]
    n = len(hashes)
    whole = np.zeros(max(n - shingle + 1, 0), np.uint64)
    for k in range(shingle):
        whole = mix(whole, 7) ^ hashes[k : k + len(whole)]
    whole, out = mix(whole, 8), []
    for a, b in zip(words.rows[:-1].tolist(), words.rows[1:].tolist(), strict=True):
        if b - a >= shingle:
            out.append(np.unique(whole[a : b - shingle + 1]))
        else:
            short = np.zeros(min(b - a, 1), np.uint64)
            for k in range(a, b):
                short = mix(short, 9) ^ hashes[k]
            out.append(mix(short, 10 + b - a))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """COORDINATES 32-bit minima of each of the sets, none of which is empty."""
    out = np.empty((len(sets), COORDINATES), np.uint32)
    if not sets:
        return out
    sizes = np.array([len(s) for s in sets])
    begins = np.cumsum(sizes) - sizes
    scattered = (mix(np.concatenate(sets), 11) >> np.uint64(32)).astype(np.uint32)
    y, z = np.empty_like(scattered), np.empty_like(scattered)
    for k in range(COORDINATES):  # the second permutation, in place
        np.subtract(scattered, np.uint32(k), out=y)
        for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, None)):
            np.right_shift(y, np.uint32(shift), out=z)
            np.bitwise_xor(y, z, out=y)
            if factor:
                np.multiply(y, np.uint32(factor), out=y)
        out[:, k] = np.minimum.reduceat(y, begins)
    return out


def sketches(sigs: np.ndarray) -> np.ndarray:
    """Two bits of each coordinate."""
    parts = (sigs & 3).astype(np.uint64).reshape(len(sigs), -1, 32) << (2 * np.arange(32, dtype=np.uint64))
    return np.bitwise_or.reduce(parts, axis=2)


def agreeing(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Coordinates in which one sketch agrees with each of many."""
    x = many ^ one
    return COORDINATES - np.bitwise_count((x | x >> np.uint64(1)) & _LOW).sum(axis=1, dtype=np.int64)


def band_keys(sigs: np.ndarray) -> np.ndarray:
    """(rows, bands): 64 bits of the ROWS coordinates of each band."""
    parts = sigs.astype(np.uint64).reshape(len(sigs), -1, ROWS)
    keys = np.broadcast_to(np.arange(parts.shape[1], dtype=np.uint64), parts.shape[:2])
    for k in range(ROWS):
        keys = mix(keys, 20) ^ parts[:, :, k]
    return mix(keys, 21)


def _binary(data: np.ndarray) -> pa.Array:
    """Rows of bytes as a binary column."""
    data = np.ascontiguousarray(data).view(np.uint8).reshape(len(data), -1)
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(data.shape[1] if len(data) else 1), len(data), [None, pa.py_buffer(data.tobytes())]).cast(pa.binary())


def prints(docs: DataFrame, shingle: int) -> DataFrame:
    """(ROW, n_shingles, node, sig) of docs(name, text); node and sig are null without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch):
                sets = shingle_sets(chunk.column("text"), shingle)
                full = [s for s in sets if len(s)]
                sigs = iter(signatures(full).view(np.uint8).reshape(len(full), -1))
                nodes = [hashlib.blake2b(s.tobytes(), digest_size=NODE).digest() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [*chunk.column("name").flatten(), pa.array([len(s) for s in sets], pa.int64()), pa.array(nodes, pa.binary()), pa.array([next(sigs).tobytes() if len(s) else None for s in sets], pa.binary())],
                    names=[*ROW, "n_shingles", "node", "sig"],
                )

    return docs.mapInArrow(run, "known boolean, doc long, row_digest binary, n_shingles long, node binary, sig binary")


def banded(nodes: DataFrame) -> DataFrame:
    """(band, node, sketch) for every band of nodes(node, sig)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 4096):
                part = batch.slice(at, 4096)
                sigs = fixed_bytes(part.column("sig"), 4 * COORDINATES).view(np.uint32)
                keys, sketch, node = band_keys(sigs), _binary(sketches(sigs)), part.column("node")
                for b in range(keys.shape[1]):
                    yield pa.RecordBatch.from_arrays([pa.array(signed(keys[:, b].copy())), node, sketch], names=["band", "node", "sketch"])

    return nodes.select("node", "sig").mapInArrow(run, "band long, node binary, sketch binary")


def gated(sketch: np.ndarray) -> np.ndarray:
    """For each row the first of its group; groups are connected by the gate."""
    label = np.zeros(len(sketch), np.int64) + np.arange(len(sketch))
    for i in range(len(sketch)):
        others = np.flatnonzero(label != label[i])
        if not len(others):
            break
        met = np.unique(label[others[agreeing(sketch[i], sketch[others]) >= GATE]])
        if len(met):
            met = np.append(met, label[i])
            label[np.isin(label, met)] = met.min()
    return label


def grouped_stream(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of a sorted stream, one table for each run of equal keys."""
    held: list[pa.Table] = []
    for batch in batches:
        if not len(batch):
            continue
        table = pa.Table.from_batches([batch])
        columns = [table.column(k).combine_chunks() for k in keys]
        edge = np.zeros(len(table) - 1, bool)
        for c in columns:
            edge |= pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(edge) + 1).tolist(), len(table)]
        if held and any(held[0].column(k)[0] != c[0] for k, c in zip(keys, columns, strict=True)):
            yield pa.concat_tables(held)
            held = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            held.append(table.slice(a, b - a))
            if b < len(table):
                yield pa.concat_tables(held)
                held = []
    if held:
        yield pa.concat_tables(held)


LINKS = "a binary, b binary"


def _links(pairs: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.binary()) for i in (0, 1)], names=["a", "b"])


def band_links(rows: DataFrame) -> DataFrame:
    """Candidate links of rows(band, node, sketch) sorted by band within their partition: a link for each node that joins a group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch]).combine_chunks()
            if not len(table):
                continue
            band = table.column("band").to_numpy()
            cut = int(np.searchsorted(band, band[-1]))
            held = table.slice(cut)
            if cut:
                yield shared_bands(table.slice(0, cut), band[:cut])
        if held is not None and len(held):
            yield shared_bands(held, held.column("band").to_numpy())

    def shared_bands(table: pa.Table, band: np.ndarray) -> pa.RecordBatch:
        starts = np.flatnonzero(np.r_[True, band[1:] != band[:-1]])
        ends, pairs = np.r_[starts[1:], len(band)], []
        several = ends - starts > 1
        if several.any():
            sketch = fixed_bytes(table.column("sketch").combine_chunks(), COORDINATES // 4).view(np.uint64)
            node = table.column("node")
            for a, b in zip(starts[several].tolist(), ends[several].tolist(), strict=True):
                label = gated(sketch[a:b])
                for i in np.flatnonzero(label != np.arange(b - a)).tolist():
                    pairs.append((node[a + i].as_py(), node[a + int(label[i])].as_py()))
        return _links(pairs)

    return rows.mapInArrow(run, LINKS)


def candidate_links(nodes: DataFrame, scratch: Scratch, cell_rows: int) -> DataFrame:
    """Links whose groups hold every pair of nodes(node, sig) that shares a band and passes the gate."""
    rows = banded(nodes)
    hot = scratch.table(rows.groupBy("band").count().where(F.col("count") > cell_rows).select("band"), "hot")
    if not hot.limit(1).count():
        return band_links(rows.repartition("band").sortWithinPartitions("band"))
    hubs = with_side(rows, hot, ["band"], F.lit(8), "inner").groupBy("band").agg(F.min("node").alias("hub"))
    rows = with_side(rows, scratch.table(hubs, "hubs"), ["band"], F.lit(64))
    linked = rows.where("hub IS NOT NULL AND hub <> node").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    return linked.union(band_links(rows.where("hub IS NULL").drop("hub").repartition("band").sortWithinPartitions("band")))


class Cell:
    """Sets that are compared with each other: labels of what is connected, links that connected it."""

    def __init__(self, sets: list[np.ndarray], sketch: np.ndarray, left: np.ndarray, label: np.ndarray, percent: int):
        self.sizes = np.array([len(s) for s in sets])
        ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
        self.ids, self.begins = ids, np.cumsum(self.sizes) - self.sizes
        self.marks = np.zeros(int(ids.max()) + 1, bool)
        self.sketch, self.left, self.label, self.percent = sketch, left, label, percent

    def links(self) -> Iterator[tuple[int, int]]:
        one = False
        for i in np.flatnonzero(self.left).tolist():
            if one:
                return
            others = np.flatnonzero(self.label != self.label[i])
            one = not len(others)
            small, large = np.minimum(self.sizes[others], self.sizes[i]), np.maximum(self.sizes[others], self.sizes[i])
            others = others[(100 * small >= self.percent * large) & (agreeing(self.sketch[i], self.sketch[others]) >= GATE)]
            for part in np.array_split(others, max(1, -(-int(self.sizes[others].sum()) // (1 << 20)))) if len(others) else ():
                mine = self.ids[self.begins[i] : self.begins[i] + self.sizes[i]]
                self.marks[mine] = True
                size = self.sizes[part]
                at = np.repeat(self.begins[part] - (np.cumsum(size) - size), size) + np.arange(size.sum())
                both = np.add.reduceat(self.marks[self.ids[at]], np.cumsum(size) - size, dtype=np.int64)
                self.marks[mine] = False
                for j in part[100 * both >= self.percent * (self.sizes[i] + size - both)].tolist():
                    if self.label[i] != self.label[j]:
                        yield i, j
                        self.label[self.label == self.label[j]] = self.label[i]


def cell_links(rows: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Verified links of rows(root, part, node, known_root, left, sketch, text), sorted by root and part within their partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped_stream((c for b in batches for c in chunks(b)), ["root", "part"]):
            if len(table) < 2:
                continue
            sets = [s for b in table.to_batches() for s in shingle_sets(b.column("text"), shingle)]
            node = table.column("node").to_pylist()
            label = np.unique(np.array([r.hex() for r in table.column("known_root").to_pylist()]), return_inverse=True)[1]
            sketch = fixed_bytes(table.column("sketch").combine_chunks(), COORDINATES // 4).view(np.uint64)
            cell = Cell(sets, sketch, table.column("left").to_numpy(), label, percent)
            pairs = [(node[i], node[j]) for i, j in cell.links()]
            if pairs:
                yield _links(pairs)

    return rows.mapInArrow(run, LINKS)


def sketched(nodes: DataFrame) -> DataFrame:
    """nodes with the sketch in place of the signature."""
    kept = [c for c in nodes.columns if c != "sig"]
    schema = nodes.drop("sig").schema.add("sketch", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sigs = fixed_bytes(batch.column("sig"), 4 * COORDINATES).view(np.uint32)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), _binary(sketches(sigs)) if len(batch) else pa.array([], pa.binary())], names=[*kept, "sketch"])

    return nodes.mapInArrow(run, schema)


def verified_links(named: DataFrame, nodes: DataFrame, groups: DataFrame, scratch: Scratch, shingle: int, percent: int, cell_rows: int) -> DataFrame:
    """Links between nodes of one group (node, root) that connect all pairs with the similarity.

    named(name, text) are the rows; nodes(node, name, n_shingles, sig) names one row of each node.
    """
    members = scratch.table(sketched(nodes.join(groups.hint("merge"), "node").select("node", "name", "n_shingles", "root", "sig")), "members")
    sums = members.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("words"), F.min("node").alias("hub"))
    parts = F.ceil(F.greatest(F.col("n") / cell_rows, F.col("words") / CELL_WORDS)).cast("int")
    sums = scratch.table(sums.select("root", "hub", parts.alias("parts")), "sums")
    dealt = lambda name, parts: F.pmod(F.xxhash64("node", F.lit(name)), parts).cast("int")
    every = lambda n: F.sequence(F.lit(0), n - 1)

    def compared(cells: DataFrame, name: str) -> DataFrame:
        """cells(root, part, node, known_root, left, name, sketch) with their texts, a row each, compared."""
        side = scratch.table(cells, f"{name}-cells")
        keys = F.struct(*(F.col("name")[c].alias(c) for c in ROW))
        rows = named.select(keys.alias("name"), "text").join(side.hint("merge"), "name")
        rows = rows.groupBy("root", "part", "node", "left").agg(*(F.first(c).alias(c) for c in ("known_root", "sketch", "text")))
        return scratch.table(cell_links(rows.repartition("root", "part").sortWithinPartitions("root", "part", "node"), shingle, percent), name)

    joined = members.join(sums.hint("merge"), "root")
    own = F.when(F.col("node") == F.col("hub"), every(F.col("parts"))).otherwise(F.array(dealt("a", F.col("parts"))))
    first = compared(joined.select("root", F.explode(own).alias("part"), "node", F.col("node").alias("known_root"), F.lit(True).alias("left"), "name", "sketch"), "verified")
    large = joined.where("parts > 1")
    if not sums.where("parts > 1").limit(1).count():
        return first
    so_far = components(first, scratch, "first")
    large = large.join(so_far.select("node", F.col("root").alias("known_root")).hint("merge"), "node", "left").withColumn("known_root", F.coalesce("known_root", "node"))
    large = scratch.table(large, "large")
    main = large.groupBy("root", "known_root").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("words"))
    largest = F.max_by("known_root", F.struct("n", "known_root"))
    main = main.groupBy("root").agg(largest.alias("main"), (F.sum("n") - F.max("n")).alias("rest_n"), F.count(F.lit(1)).alias("pieces"), F.sum("words").alias("words"))
    main = scratch.table(main.where("pieces > 1").select("root", "main", F.ceil(F.greatest(F.col("rest_n") / cell_rows, F.col("words") / CELL_WORDS)).cast("int").alias("left_parts")), "main")
    if not main.limit(1).count():
        return first
    open_ = large.join(main.hint("merge"), "root")
    cell = lambda p, q: (p.cast("long") * (1 << 32) + q).alias("part")
    keep = ["root", "node", "known_root", "name", "sketch"]
    rest = open_.where("known_root <> main").select(*keep, dealt("b", F.col("left_parts")).alias("p"), F.explode(every(F.col("parts"))).alias("q")).select(*keep, cell(F.col("p"), F.col("q")), F.lit(True).alias("left"))
    whole = open_.select(*keep, dealt("c", F.col("parts")).alias("q"), F.explode(every(F.col("left_parts"))).alias("p")).select(*keep, cell(F.col("p"), F.col("q")), F.lit(False).alias("left"))
    return first.union(compared(rest.unionByName(whole), "rest"))


def minhash_dedup(docs: DataFrame, shingle: int = 5, percent: int = 80, cell_rows: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (the smallest doc_id reachable), kept (doc_id is component_id)."""
    if percent < LEAST_PERCENT:
        raise ValueError(f"the bands are made for a similarity of {LEAST_PERCENT} percent or more")
    scratch = Scratch(docs.sparkSession, "minhash")
    named = docs.select(F.struct(*row_name(F.col(id_col), F.col(text_col))).alias("name"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = scratch.table(prints(named, shingle), "prints")
    nodes = rows.where("node IS NOT NULL").groupBy("node").agg(F.min(F.struct(*ROW)).alias("name"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"), F.min(F.when(F.col("known"), F.col("doc"))).alias("least"))
    nodes = scratch.table(nodes, "nodes")
    groups = components(scratch.table(candidate_links(nodes, scratch, cell_rows), "candidates"), scratch, "groups")
    links = verified_links(named, nodes, groups, scratch, shingle, percent, cell_rows)
    roots = components(links, scratch, "final")
    whole = scratch.table(nodes.select("node", "least").join(roots.hint("merge"), "node", "left").select("node", "least", F.coalesce("root", "node").alias("root")), "roots")
    least = scratch.table(whole.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    whole = scratch.table(whole.join(least.hint("merge"), "root").select("node", "component_id"), "components")
    doc_id = F.when(F.col("known"), F.col("doc"))
    found = rows.select(doc_id.alias("doc_id"), "n_shingles", "node").join(whole.hint("merge"), "node", "left")
    found = found.select("doc_id", "n_shingles", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
