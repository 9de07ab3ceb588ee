"""Token counts (operator 3): delta-maintained rollups.

A rollup is a folder of three tables. `ledger` holds signed rows per document: a batch of changes adds
the new counts of the documents it inserts or revises and takes away the counts that the ledger held
for them, so the sum over a document's rows is its state. `deltas` holds each batch's ledger summed by
source, language and tokenizer version; totals are sums of deltas and never reread documents. `commits` is
a numbered log of the batches that count. Every attempt at a batch is written to a folder of its own, made from the state
after the log's last number; it counts once its entry has become the next number. An entry is written under another
name first and then renamed, so none is ever half there, and of two writers one gets the number: the other works its
batch out again from the new state. An attempt that failed half-way, or lost, is never read; a batch that is in the log is
left alone. Renaming to a name that exists fails at once on HDFS; local and object-store file systems look
before they rename, so there writers of one rollup need a lock of their own.

The ledger is parted by a hash of doc_id; a batch reads the parts that it touches and no others.

Edge cases: null texts and removals have no tokens (a null text counts as an empty document); null
source or language form a group of their own; within a batch a removal wins over other rows of its
doc_id, and of several versions of one document the greatest (source, lang, counts) counts once; rows
without a doc_id are counted under the null doc_id, as one document; an empty batch commits nothing but
its name.
"""

from __future__ import annotations

import base64
import json
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, Scratch, chunks, with_side

LEDGER = "doc_id long, source string, lang string, tokenizer string, n_docs long, n_tokens long, n_chars long"
KEYS = ["source", "lang", "tokenizer"]
SUMS = ["n_docs", "n_tokens", "n_chars"]
#: Parts of the ledger, by doc_id.
PARTS = 64


def part() -> Column:
    return F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)).cast("int")


_live: dict[tuple[str, str], object] = {}


def _encoding(name: str, pattern: str, lines: bytes):
    """This process's encoder of a tokenizer version."""
    import tiktoken

    if (name, pattern) not in _live:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines.splitlines())}
        _live[name, pattern] = tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _live[name, pattern]


def count_tokens(docs: DataFrame, tokenizers: dict[str, str], pattern: str) -> DataFrame:
    """LEDGER rows of docs(doc_id, source, lang, text), one for each tokenizer version.

    tokenizers: version name to rank file; the files are read by the driver.
    """
    files = {}
    for name, path in tokenizers.items():
        with open(path, "rb") as f:
            files[name] = f.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch):
                texts = chunk.column("text").to_pylist()
                for name, lines in files.items():
                    encode = _encoding(name, pattern, lines).encode_ordinary
                    n = pa.array([len(encode(t)) for t in texts], pa.int64())
                    one = pa.array([1] * len(texts), pa.int64())
                    same = pa.array([name] * len(texts), pa.string())
                    chars = pa.array([len(t) for t in texts], pa.int64())
                    yield pa.RecordBatch.from_arrays([*(chunk.column(k) for k in ("doc_id", "source", "lang")), same, one, n, chars], names=["doc_id", *KEYS, *SUMS])

    return docs.select("doc_id", "source", "lang", "text").mapInArrow(run, LEDGER)


class TokenRollup:
    """Totals by source, lang and tokenizer version, kept in `folder` by batches of changes."""

    def __init__(self, spark: SparkSession, folder: str, tokenizers: dict[str, str], pattern: str):
        self.spark, self.folder, self.tokenizers, self.pattern = spark, folder.rstrip("/"), tokenizers, pattern
        for name in ("ledger", "deltas", "commits"):
            self._fs(name)[0].mkdirs(self._fs(name)[1])

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _fs(self, name: str):
        """(file system, path) of a part of the folder."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _read(self, name: str, schema: str, commits: DataFrame | None = None) -> DataFrame:
        rows = self.spark.read.schema(f"{schema}, batch string, attempt string").parquet(f"{self.folder}/{name}")
        commits = self.commits() if commits is None else commits
        return rows.join(commits.hint("broadcast" if commits.count() * 256 <= BROADCAST_BYTES else "merge"), ["batch", "attempt"], "left_semi")

    def commits(self) -> DataFrame:
        """(number, batch, attempt) of committed batches: one row a batch."""
        return self.spark.read.schema("number long, batch string, attempt string").json(f"{self.folder}/commits")

    def _claim(self, number: int, batch: str, attempt: str) -> bool:
        """Makes the attempt the log's entry of this number; False if there is one."""
        fs, path = self._fs(f"commits/{number:012d}.json")
        draft = self._path(f"commits/_{attempt}")
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps({"number": number, "batch": batch, "attempt": attempt}).encode()))
        out.close()
        if fs.exists(path):
            fs.delete(draft, False)
            return False
        try:  # as Spark writes its own logs: a rename that does not replace what is there
            how = getattr(self.spark._jvm.org.apache.hadoop.fs, "Options$Rename")
            rename = self.spark.sparkContext._gateway.new_array(how, 1)
            rename[0] = how.NONE
            self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), self.spark._jsc.hadoopConfiguration()).rename(draft, path, rename)
        except Exception:
            if fs.exists(path):
                return False
            raise
        return True

    def state(self, touched: DataFrame | None = None, commits: DataFrame | None = None) -> DataFrame:
        """LEDGER rows of the documents as they stand; touched(doc_id): of these alone, read from the parts that hold them
        and found before anything is summed."""
        rows = self._read("ledger", f"{LEDGER}, part int", commits)
        if touched is not None:
            parts = [r["part"] for r in touched.select(part().alias("part")).distinct().collect()]  # PARTS at most
            rows = rows.where(F.col("part").isin(parts)) if len(parts) < PARTS else rows
            rows = rows.join(touched.hint("merge"), rows.doc_id.eqNullSafe(touched.doc_id), "left_semi")
        return rows.groupBy("doc_id", *KEYS).agg(*(F.sum(c).alias(c) for c in SUMS)).where("n_docs <> 0")

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs, n_tokens, n_chars from the committed deltas alone."""
        rows = self._read("deltas", LEDGER.replace("doc_id long, ", "")).groupBy(*KEYS).agg(*(F.sum(c).alias(c) for c in SUMS))
        return rows.where("n_docs <> 0")

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Applies changes(op, doc_id, source, lang, text); op: insert, revise or delete. False: was committed before."""
        counted = None
        while True:
            commits = self.spark.createDataFrame(self.commits().collect(), "number long, batch string, attempt string")  # the log as it is now, a row a batch
            if commits.where(F.col("batch") == batch).count():
                return False
            number = (commits.agg(F.max("number")).first()[0] or 0) + 1
            counted = counted or self._counted(changes)
            attempt = self._attempt(batch, counted, commits)
            if self._claim(number, batch, attempt):
                return True

    def _counted(self, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(new LEDGER rows, touched doc_ids) of a batch, written: they are the same for every attempt."""
        docs = changes.select("op", F.col("doc_id").cast("long").alias("doc_id"), *(F.col(k).cast("string").alias(k) for k in ("source", "lang")), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
        new = count_tokens(docs.where("op <> 'delete'"), self.tokenizers, self.pattern)
        new = new.groupBy("doc_id", "tokenizer").agg(F.max(F.struct("source", "lang", *SUMS)).alias("v")).select("doc_id", "v.source", "v.lang", "tokenizer", *(f"v.{c}" for c in SUMS))
        gone = docs.where("op = 'delete'").select("doc_id").distinct()
        touched = docs.select("doc_id").distinct()
        new = new.join(gone.hint("merge"), new.doc_id.eqNullSafe(gone.doc_id), "left_anti")
        scratch = Scratch(self.spark, "batch")
        return scratch.table(new, "new"), scratch.table(touched, "touched")

    def _attempt(self, batch: str, counted: tuple[DataFrame, DataFrame], commits: DataFrame) -> str:
        """Writes the rows of a batch on top of these commits; its name."""
        new, touched = counted
        old = self.state(touched, commits).select("doc_id", *KEYS, *((-F.col(c)).alias(c) for c in SUMS))
        attempt = uuid.uuid4().hex
        place = f"batch={quote(batch, safe='')}/attempt={attempt}"
        ledger = new.unionByName(old).withColumn("part", part())
        ledger.repartition("part").write.partitionBy("part").parquet(f"{self.folder}/ledger/{place}")
        rows = self.spark.read.schema(f"{LEDGER}, part int").parquet(f"{self.folder}/ledger/{place}")
        rows.groupBy(*KEYS).agg(*(F.sum(c).alias(c) for c in SUMS)).write.parquet(f"{self.folder}/deltas/{place}")
        return attempt


def corpus_history(documents: DataFrame, labels: DataFrame) -> list[tuple[str, DataFrame]]:
    """The batches that a corpus of documents goes through: load, removal of toxic documents, and
    revision of low-quality ones, whose symbols are taken out. The second batch is delivered twice."""
    flags = labels.groupBy("doc_id").agg((F.max("toxic") == 1).alias("toxic"), (F.min("quality") == 0).alias("poor"))
    marked = with_side(documents, flags, ["doc_id"], F.lit(24), "inner")
    cols = ["doc_id", "source", "lang", "text"]
    load = documents.select(F.lit("insert").alias("op"), *cols)
    remove = marked.where("toxic").select(F.lit("delete").alias("op"), *cols)
    revise = marked.where("poor AND NOT toxic").withColumn("text", F.translate("text", "#*$%&|<>", "")).select(F.lit("revise").alias("op"), *cols)
    return [("load", load), ("toxic", remove), ("toxic", remove), ("cleaned", revise)]


def rolled_up(documents: DataFrame, labels: DataFrame, tokenizers: dict[str, str], pattern: str) -> DataFrame:
    """Totals after corpus_history()."""
    spark = documents.sparkSession
    rollup = TokenRollup(spark, Scratch(spark, "tokens").root, tokenizers, pattern)
    for batch, changes in corpus_history(documents, labels):
        rollup.commit(batch, changes)
    return rollup.totals()
