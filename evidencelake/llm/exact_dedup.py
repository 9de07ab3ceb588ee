"""Exact dedup (operator 7): a tree-merge of sorted digest runs.

Each input partition writes one run of (digest, identifier) rows, sorted by digest. Runs then meet in
binomial rounds, `fan_in` of them at a time: in each round the rows of `fan_in` runs come together, one range
slice of digests to a task, are brought into order and merged in one pass over the ordered stream, equal
neighbours becoming one row. The number of runs falls by `fan_in` a round while each run is cut into more
slices, so no task ever holds a whole run, and copies met so far travel on as one row. The kept identifier is
retained at every level together with a second hash and the length of the text; where these differ between
rows of one digest the job stops, as the digest would then stand for two texts.

Edge cases: null text counts as empty, empty texts are equal to each other; rows that repeat one doc_id
and text share their verdict; a null doc_id never wins over another identifier; an empty table gives an
empty result.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, with_side

#: A run: one row per digest, in the order of digests. check and n_bytes tell texts apart beside the digest.
RUN = "run int, slice int, digest binary, keep_id long, group_size long, check long, n_bytes long"


def normalised(text: Column) -> Column:
    """A-Z lower-cased, everything else unchanged; null is empty."""
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def digest_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest, check, n_bytes, run): a run a partition, sorted by digest."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), normalised(F.col(text_col)).alias("t"))
    rows = rows.select("doc_id", F.unhex(F.sha2("t", 256)).alias("digest"), F.xxhash64("t").alias("check"), F.octet_length("t").cast("long").alias("n_bytes"), F.spark_partition_id().alias("run"))
    return rows.sortWithinPartitions("digest")


def merged(rows: DataFrame, keep: str) -> DataFrame:
    """RUN rows that come in order of (run, slice, digest), equal neighbours made one: one pass, one open row."""
    pick, worst = {"min": (np.minimum, np.iinfo(np.int64).max), "max": (np.maximum, np.iinfo(np.int64).min)}[keep]

    def joined(table: pa.Table) -> pa.RecordBatch:
        table = table.combine_chunks()
        run, part, size, check, n_bytes = (table.column(k).to_numpy() for k in ("run", "slice", "group_size", "check", "n_bytes"))
        digests = table.column("digest").cast(pa.binary(32)).combine_chunks()
        digest = np.frombuffer(digests.buffers()[1], np.uint8).reshape(-1, 32)[digests.offset : digests.offset + len(digests)]
        same = (run[1:] == run[:-1]) & (digest[1:] == digest[:-1]).all(axis=1)
        if (same & ((check[1:] != check[:-1]) | (n_bytes[1:] != n_bytes[:-1]))).any():
            raise ValueError("two texts share a digest")
        first = np.flatnonzero(np.r_[True, ~same])
        known = table.column("keep_id").is_valid().to_numpy()
        ids = pick.reduceat(np.where(known, table.column("keep_id").fill_null(worst).to_numpy(), worst), first)
        cols = {"run": run[first], "slice": part[first], "digest": digests.take(pa.array(first)).cast(pa.binary()), "keep_id": pa.array(ids, mask=~np.logical_or.reduceat(known, first)), "group_size": np.add.reduceat(size, first), "check": check[first], "n_bytes": n_bytes[first]}
        return pa.RecordBatch.from_pydict({k: v if isinstance(v, pa.Array) else pa.array(v) for k, v in cols.items()})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            if len(batch):
                out = joined(pa.Table.from_batches([batch] if last is None else [last, batch.cast(last.schema)]))
                last = out.slice(len(out) - 1)
                if len(out) > 1:
                    yield out.slice(0, len(out) - 1)
        if last is not None:
            yield last

    return rows.mapInArrow(merge, RUN)


def merge_runs(runs: DataFrame, n_runs: int, fan_in: int = 8, keep: str = "max", slices: int = 64) -> DataFrame:
    """RUN rows of the one run that is left of n_runs digest_runs(), after ceil(log(n_runs) / log(fan_in)) rounds.

    keep is "min" or "max": which identifier of equal texts stays. slices: range slices of the last run.
    """
    level = runs.select("run", F.lit(0).alias("slice"), "digest", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "check", "n_bytes")
    level, left = merged(level, keep), n_runs  # a run's own copies, before anything is exchanged
    first_bytes = F.conv(F.hex(F.substring("digest", 1, 2)), 16, 10).cast("int")
    while True:
        left = -(-left // fan_in)
        cuts = max(1, slices // left)
        level = level.withColumn("run", F.floor(F.col("run") / fan_in).cast("int")).withColumn("slice", F.floor(first_bytes * cuts / 65536).cast("int"))
        level = merged(level.repartition(left * cuts, "run", "slice").sortWithinPartitions("run", "slice", "digest"), keep)
        if left == 1:
            return level


def groups_of(docs: DataFrame, scratch: Scratch, keep: str, fan_in: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(digest_runs(), their groups (digest, keep_id, group_size)), both written."""
    rows = scratch.table(digest_runs(docs, id_col, text_col), "runs")
    n_runs = (rows.agg(F.max("run")).first()[0] or 0) + 1
    groups = merge_runs(rows, n_runs, fan_in, keep, max(64, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return rows, scratch.table(groups.select("digest", "keep_id", "group_size"), "groups")  # written: Spark splits a skewed digest only then


def exact_dedup(docs: DataFrame, keep: str = "max", fan_in: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    rows, groups = groups_of(docs, Scratch(docs.sparkSession, "exact"), keep, fan_in, id_col, text_col)
    return rows.join(groups.hint("merge"), "digest").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def exact_filter(docs: DataFrame, keep: str = "max", fan_in: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, unchanged, that stay: one of each group of equal texts.

    Of rows that also share the kept identifier any one stays; a group without identifiers keeps one row too.
    """
    scratch = Scratch(docs.sparkSession, "exact")
    groups = groups_of(docs, scratch, keep, fan_in, id_col, text_col)[1]
    several = scratch.table(groups.where("group_size > 1"), "several")
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), docs[id_col].cast("long").alias("doc_id"), F.unhex(F.sha2(normalised(docs[text_col]), 256)).alias("digest"))
    rows = with_side(rows, several, ["digest"], F.lit(64))
    alone = rows.where("group_size IS NULL").select("row")
    chosen = rows.where("group_size IS NOT NULL AND doc_id <=> keep_id").dropDuplicates(["digest"]).select("row")
    return alone.union(chosen).select("row.*")
