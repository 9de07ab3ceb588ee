"""What the operators of this subpackage share: scratch tables, checked broadcasts, text as bytes.

Every operator first narrows its input to the columns it needs under names of its own, so further
columns of the input, whatever they are called, never clash.
"""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of every word rule here: space and the five ASCII controls 0x09 to 0x0D.
WHITE = "\t\n\x0b\f\r "
#: A side table is broadcast only if its rows, written out and counted, hold no more bytes than this.
BROADCAST_BYTES = 16 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only in local mode, where one machine is all
    there is, an unset folder is replaced by a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="evidencelake-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


class Scratch:
    """Tables written below the shared folder: lineage is cut, and a lost executor costs no rerun of what went before."""

    def __init__(self, spark: SparkSession, name: str, patience: float = 0.0):
        """patience: seconds that release pauses for at most, twice; with 0 it does not."""
        self.spark, self.root = spark, f"{shared_folder(spark)}/llm-{name}-{uuid.uuid4().hex}"
        self.patience, self.since = patience, time.monotonic()

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Writes df and reads it back."""
        df.write.mode("overwrite").option("compression", "zstd").parquet(path := f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(path)

    def release(self) -> None:
        """Lets Spark delete the shuffle files of steps whose results are written: it does when their plans are collected.

        It deletes them in the background, and on a cluster they were seen to stay until a second collection. With
        patience there are two, each with a pause of a twentieth of the time since the last release: what took long left much,
        and must not be there still beside what the next step writes.
        """
        pause = min(self.patience, (time.monotonic() - self.since) / 20)
        for _ in range(2 if self.patience else 1):
            gc.collect()
            self.spark._jvm.System.gc()
            time.sleep(pause)
        self.since = time.monotonic()

    def drop(self, name: str) -> None:
        """Deletes a table that no later step reads."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def with_side(docs: DataFrame, side: DataFrame, on: list[str], size: F.Column, how: str = "left") -> DataFrame:
    """docs joined with a written side table of one row per key.

    size is the number of bytes of a side row. The side is broadcast if the sum is within
    BROADCAST_BYTES; beyond that both sides are shuffled on the key.
    """
    total = side.agg(F.coalesce(F.sum(size), F.lit(0)).cast("long")).first()[0]
    return docs.join(F.broadcast(side) if total <= BROADCAST_BYTES else side.hint("merge"), on, how)


def documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, row_hash, text): null texts are empty; row_hash (64 bits) tells rows apart that share a doc_id."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("row_hash"), text.alias("text"))


#: Columns that name a row: never null, and 128 bits of the text tell rows apart that share a doc_id or have none.
ROW = ["known", "doc", "row_digest"]


def row_name(doc_id: Column, text: Column) -> list[Column]:
    """The ROW columns of a row."""
    doc_id = doc_id.cast("long")
    return [doc_id.isNotNull().alias("known"), F.coalesce(doc_id, F.lit(0)).alias("doc"), F.unhex(F.md5(F.coalesce(text.cast("string"), F.lit("")))).alias("row_digest")]


def without(docs: DataFrame, dropped: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that dropped(ROW), a written table, names."""
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), *row_name(docs[id_col], docs[text_col]))
    return with_side(rows, dropped.select(*ROW).distinct(), ROW, F.lit(48), "left_anti").select("row.*")


def chunks(batch: pa.RecordBatch, most: int = 2 << 20):
    """Consecutive slices of a batch whose texts hold at most `most` bytes, or one row."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False), np.int64)
    ends, at = np.cumsum(sizes), 0
    while at < len(sizes):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, stop - at)
        at = stop


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column, and where each row's bytes begin (one more at the end)."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


IS_WHITE = np.zeros(256, bool)
IS_WHITE[[ord(c) for c in WHITE]] = True


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and where each row's words begin (one more at the end)."""
    solid = ~IS_WHITE[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = solid[:-1], solid[1:]
    inner = offsets[1:-1]
    before[inner[inner < len(data)]] = False
    after[inner[inner > 0] - 1] = False
    starts, ends = np.flatnonzero(solid & ~before), np.flatnonzero(solid & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


class JoinedWords:
    """The words of a chunk of rows one after the other, a space after each: where each begins, its size with the
    space, and where each row's words begin (one more at the end)."""

    def __init__(self, text: pa.Array, fold: bool = False):
        data, offsets = text_bytes(text)
        starts, ends, self.rows = word_spans(data, offsets)
        self.size = ends - starts + 1
        self.begin = np.cumsum(self.size) - self.size
        at = np.repeat(starts - self.begin, self.size) + np.arange(self.size.sum())
        joined = data[np.minimum(at, max(len(data) - 1, 0))] if len(at) else np.zeros(0, np.uint8)
        if fold:
            joined = np.where((joined >= 65) & (joined <= 90), joined + 32, joined).astype(np.uint8)
        joined[self.begin + self.size - 1] = 32
        self.data = joined

    def codes(self) -> tuple[np.ndarray, list[bytes]]:
        """A number for each word, equal for equal words, and the distinct words by number."""
        offsets = np.append(self.begin, len(self.data)).astype(np.int64)
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(self.begin), [None, pa.py_buffer(offsets), pa.py_buffer(self.data)]).dictionary_encode()
        return words.indices.to_numpy(), words.dictionary.to_pylist()


def fixed_bytes(column: pa.Array, width: int) -> np.ndarray:
    """(rows, width) bytes of a binary column without nulls."""
    column = column.cast(pa.binary(width))
    return np.frombuffer(column.buffers()[1], np.uint8)[column.offset * width : (column.offset + len(column)) * width].reshape(-1, width)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit numbers whose every output bit depends on every input bit (splitmix64's finish)."""
    x = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Polynomial hashes modulo 2**64 of any span of a sequence of 64-bit values, from prefix sums."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 2**64)
        self.powers = self.inverses = np.ones(1, np.uint64)

    def prefix(self, values: np.ndarray) -> np.ndarray:
        n = len(values)
        if len(self.powers) <= n:
            size = max(n + 1, 1 << 16)
            self.powers, self.inverses = (np.cumprod(np.r_[np.uint64(1), np.full(size, b, np.uint64)]) for b in (self.base, self.inverse))
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * self.powers[:n], out=sums[1:])
        return sums

    def spans(self, sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return (sums[ends] - sums[starts]) * self.inverses[starts]


BYTE_VALUES = mix(np.arange(256, dtype=np.uint64), 1)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unions of overlapping or touching spans, in order."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    first = np.r_[True, starts[1:] > reach[:-1]]
    return starts[first], reach[np.r_[np.flatnonzero(first)[1:] - 1, len(starts) - 1]]
