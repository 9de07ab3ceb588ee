"""Range parts of any ordered column, and checked broadcasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Values that are looked at for each bound, and bytes of a table that is broadcast at most.
PER_BOUND, BROADCAST_BYTES = 32, 16 << 20


def bounds_of(rows: DataFrame, column: str, parts: int | None = None) -> list:
    """Upper bounds of at most `parts` (the session's shuffle partitions) ranges of about equal size.

    They are quantiles of the PER_BOUND * parts values with the smallest hashes, a bounded sample of the whole.
    """
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sample = rows.select(F.col(column).alias("v")).where("v IS NOT NULL").orderBy(F.xxhash64("v"), "v").limit(PER_BOUND * parts)
    values = sorted({r["v"] for r in sample.collect()})
    return values[PER_BOUND - 1 :: PER_BOUND][: parts - 1]


def part_of(value: Column, bounds: list) -> Column:
    """How many bounds are at most the value, by binary search."""
    if not bounds:
        return F.lit(0)
    array = F.array(*map(F.lit, bounds))
    steps = F.sequence(F.lit(1), F.lit(len(bounds).bit_length()))
    zero = F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        up = (s["lo"] < s["hi"]) & (F.get(array, mid) <= value)
        return F.struct(F.when(up, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(up | (s["lo"] >= s["hi"]), s["hi"]).otherwise(mid).alias("hi"))

    return F.aggregate(steps, zero, halve, lambda s: s["lo"])


def small(table: DataFrame, row_bytes: int = 128) -> DataFrame:
    """The table with the join hint that its counted size allows: broadcast within BROADCAST_BYTES, else sort-merge."""
    return table.hint("broadcast" if table.count() * row_bytes <= BROADCAST_BYTES else "merge")


def tiny(table: DataFrame, most: int = 10_000) -> DataFrame:
    """A configuration table that every row meets: broadcast; more than `most` rows are an error."""
    if table.limit(most + 1).count() > most:
        raise ValueError(f"a configuration table has more than {most} rows")
    return F.broadcast(table)


#: Rows that one task sorts, about.
PART_ROWS = 1 << 20


def parts_for(n_rows: int, spark: SparkSession, part_rows: int = PART_ROWS) -> int:
    """Parts of about part_rows rows; the session's shuffle partitions at least."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_rows // part_rows))


def dealt(rows: DataFrame, parts: int, *keys: str) -> DataFrame:
    """The rows by hash of the keys into this many parts. With the session's own number Spark deals them itself, and may split skewed keys."""
    return rows.repartition(parts, *keys) if parts > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else rows
