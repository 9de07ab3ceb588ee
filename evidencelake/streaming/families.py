"""Family-wise tests over a stream of matches (A6, A7): a batch recomputes the families that it touches, and no others.

Each batch leaves two folders named after it: the counts it adds, and the results of the families it touched, made from
all counts up to it. Sending a batch again writes the same two folders again, so nothing counts twice; a family's
results are those of the last batch that touched it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..operators.scoring import cell_counts, tested_cells


class FamilyTests:
    """compare_rates() of a stream of matches(family..., idx, label, matched), kept in a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str, by: list[str], alpha: float = 0.05):
        self.spark, self.folder, self.by, self.alpha = spark, folder.rstrip("/"), by, alpha

    def _read(self, name: str, schema: StructType) -> DataFrame:
        return self.spark.read.schema(StructType([*schema.fields, StructField("batch", LongType())])).parquet(f"{self.folder}/{name}")

    def apply(self, batch: DataFrame, number: int) -> None:
        """For foreachBatch."""
        counts = cell_counts(batch, self.by)
        counts.write.mode("overwrite").parquet(f"{self.folder}/counts/batch={number}")
        every = self._read("counts", counts.schema).where(F.col("batch") <= number)
        touched = every.where(F.col("batch") == number).select(*(F.col(c).alias(f"_{c}") for c in self.by)).distinct()
        on = [every[c].eqNullSafe(touched[f"_{c}"]) for c in self.by]
        some = every.join(touched.hint("merge"), on, "left_semi") if self.by else every
        sums = some.groupBy(*self.by, "idx").agg(*(F.sum(c).alias(c) for c in "abcd"))
        tested_cells(sums, self.by, self.alpha).write.mode("overwrite").parquet(f"{self.folder}/results/batch={number}")

    def results(self) -> DataFrame:
        """compare_rates() of all matches so far."""
        found = self.spark.read.option("basePath", f"{self.folder}/results").parquet(f"{self.folder}/results")
        found = found.withColumn("_last", F.col("batch") == self._latest(found)) if not self.by else found
        if not self.by:
            return found.where("_last").drop("_last", "batch")
        last = found.groupBy(*self.by).agg(F.max("batch").alias("_b")).select(*(F.col(c).alias(f"_{c}") for c in self.by), "_b")
        on = [found[c].eqNullSafe(last[f"_{c}"]) for c in self.by] + [found["batch"] == last["_b"]]
        return found.join(last.hint("merge"), on, "left_semi").drop("batch")

    def _latest(self, found: DataFrame) -> int:
        return found.agg(F.max("batch")).first()[0]
