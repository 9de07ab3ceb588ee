"""Assignment of units, set listings and retention (D*)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.order import bounds_of, part_of, small
from .classify import KEY_ALPHABET, hash_mod


def ranked(units: DataFrame, unit: str, parts: int | None = None) -> DataFrame:
    """Adds rank (0-based, in the order of unit) without a window over all rows.

    Rows are dealt to ranges of about equal size, numbered within their range, and shifted by the sizes of the
    ranges before, of which there are as many as shuffle partitions.
    """
    rows = units.withColumn("_part", part_of(F.col(unit), bounds_of(units, unit, parts)))
    sizes = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_begin", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    nth = F.row_number().over(Window.partitionBy("_part").orderBy(unit))
    rows = rows.withColumn("_nth", nth).join(F.broadcast(sizes), "_part")  # a row a part
    return rows.withColumn("rank", F.col("_begin") + F.col("_nth") - 1).drop("_part", "_begin", "_nth")


#: Rounds of the permutation of key numbers; an even number, as two rounds bring a number's halves back to their places.
KEY_ROUNDS = 8


def permuted(number: Column, seed: str, low: int, high: int) -> tuple[Column, Column]:
    """(high part, low part) of the permutation of 0 .. low * high - 1 that belongs to the seed.

    A number is cut into a part below `high` and one below `low`; in turn one part is shifted by a hash of the other,
    modulo its own size, which can be undone. So no two numbers share a result, for whatever sizes, and none lies outside.
    Numbers count rows and lie below 2^53.
    """
    state = F.struct(F.floor(number / low).cast("long").alias("x"), F.pmod(number, F.lit(low)).cast("long").alias("y"))

    def turn(r: int) -> Callable[[Column], Column]:
        size = high if r % 2 == 0 else low
        shift = lambda y: hash_mod(F.concat(F.lit(f"{seed}:{r}:"), y.cast("string")), F.lit(size))
        return lambda s: F.struct(s["y"].alias("x"), F.pmod(s["x"] + shift(s["y"]), F.lit(size)).cast("long").alias("y"))

    for r in range(KEY_ROUNDS):
        state = F.get(F.transform(F.array(state), turn(r)), 0)
    return state["x"], state["y"]


def key_of(number: Column, seed: str, length: int, alphabet: str = KEY_ALPHABET) -> Column:
    """The key of a number below len(alphabet) ** length: the letters of its place in the seed's permutation."""
    letters, n = F.array(*map(F.lit, alphabet)), len(alphabet)
    sizes = length - length // 2, length // 2
    digit = lambda part, k: F.get(letters, F.pmod(F.floor(part / n**k), F.lit(n)).cast("int"))
    both = F.struct(*(c.alias(k) for k, c in zip("xy", permuted(number, seed, n ** sizes[1], n ** sizes[0]), strict=True)))
    return F.get(F.transform(F.array(both), lambda b: F.concat(*(digit(b[p], k) for p, size in zip("xy", sizes, strict=True) for k in reversed(range(size))))), 0)


def unit_keys(units: DataFrame, unit: str, seed: str, length: int = 8) -> DataFrame:
    """(unit, key) of the distinct units: different by construction, up to the last key that there is.

    Units are numbered in their order (by ranges, not in one task) and numbers go through a permutation of all keys,
    so nothing is tried twice and nothing compared. Keys belong to one set of units: another set numbers them anew.
    """
    if not 6 <= length <= 16:
        raise ValueError("keys have 6 to 16 letters")
    rows = ranked(units.select(unit).distinct(), unit)
    return rows.select(unit, key_of(F.col("rank").cast("long"), seed, length).alias("key"))


def assign_round_robin(units: DataFrame, members: DataFrame, unit: str) -> DataFrame:
    """unit, label, job_id: sorted units to sorted members in turn. members(label, job_id) is a small table."""
    labels = members.select("label", "job_id", (F.row_number().over(Window.orderBy("label")) - 1).alias("_i"))
    n = labels.count()
    return ranked(units.select(unit), unit).withColumn("_i", (F.col("rank") % n).cast("int")).join(small(labels), "_i").select(unit, "label", "job_id")


def assign_hash(units: DataFrame, members: DataFrame, unit: str, seed: str) -> DataFrame:
    """unit, label, job_id by the hash of seed and unit: row-local, stable when units come and go."""
    labels = members.select("label", "job_id", (F.row_number().over(Window.orderBy("label")) - 1).alias("_i"))
    n = labels.count()
    index = hash_mod(F.concat(F.lit(f"{seed}:"), F.col(unit).cast("string")), F.lit(n)).cast("int")
    return units.select(unit, index.alias("_i")).join(small(labels), "_i").select(unit, "label", "job_id")


def label_counts(assignments: DataFrame, members: DataFrame) -> DataFrame:
    """label, n with zeros kept."""
    return members.select("label").join(assignments.groupBy("label").agg(F.count(F.lit(1)).alias("n")), "label", "left").fillna(0, ["n"])


def expired(jobs: DataFrame, expires: str, now: Column) -> DataFrame:
    return jobs.where(F.col(expires) < now)


def cascade_keep(children: DataFrame, removed: DataFrame, key: str) -> DataFrame:
    """Rows of a child table whose parent stays."""
    return children.join(removed.select(key).distinct(), key, "left_anti")


def excess(rows: DataFrame, group: str, order: list[str], most: int) -> DataFrame:
    """Rows past the cap of their group, with their place."""
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("nth") > most)


def set_listing(members: DataFrame, jobs: DataFrame, key: str) -> DataFrame:
    """Members with their job's status and output hash; a missing job gives null and blank."""
    return members.join(jobs, key, "left").withColumn("output_sha256", F.coalesce("output_sha256", F.lit("")))
