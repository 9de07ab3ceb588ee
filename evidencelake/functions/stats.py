"""Exact tests: binomial tails and Fisher's 2x2 test as Arrow-batched columns, Holm's correction over ordered parts.

The tests walk outward from the likeliest outcome by the ratio of neighbouring terms, a block of STEP terms at a
time, until what is left cannot change the sum. Memory is one block whatever the margins, and no logarithm of a large
factorial, whose rounding would exceed the terms' differences, is needed. Spark has no expression for such a loop.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .order import bounds_of, part_of
from .scratch import written

STEP = 1 << 14
#: ln of what counts as nothing beside the largest term, and of what a double cannot hold.
NEGLIGIBLE, UNDERFLOW = -60.0, -745.0
#: Terms alike within this factor are ties.
TIE = 1e-7


def _walk(start: int, stop: int, log_ratio: Callable[[np.ndarray], np.ndarray], until: float):
    """Blocks of (outcomes, ln of their weight beside the start's) from the one after start to stop, while over until."""
    sign, at, log = (1 if stop >= start else -1), start, 0.0
    while at != stop and log > until:
        n = min(STEP, abs(stop - at))
        x = at + sign * np.arange(1, n + 1, dtype=np.int64)
        logs = log + np.cumsum(log_ratio(x))
        yield x, logs
        at, log = int(x[-1]), float(logs[-1])


def fisher_p(a: int, b: int, c: int, d: int) -> float:
    r1, r2, c1 = a + b, c + d, a + c
    low, high = max(0, c1 - r2), min(r1, c1)
    if low == high:
        return 1.0
    mode = min(max((r1 + 1) * (c1 + 1) // (r1 + r2 + 2), low), high)
    # ln of P(x) / P(x - 1), and of P(x) / P(x + 1) on the way down
    up = lambda x: np.log((r1 - x + 1.0) / x) + np.log((c1 - x + 1.0) / (r2 - c1 + x))
    down = lambda x: -up(x + 1)
    seen = 0.0
    if a != mode:
        for x, logs in _walk(mode, a, up if a > mode else down, UNDERFLOW):
            seen = float(logs[-1])
            if x[-1] != a and seen <= UNDERFLOW:
                return 0.0
    total, tail = 1.0, 1.0 if seen >= -TIE else 0.0
    for stop, ratio in ((high, up), (low, down)):
        for _, logs in _walk(mode, stop, ratio, min(seen, 0.0) + NEGLIGIBLE):
            weights = np.exp(logs)
            total += weights.sum()
            tail += weights[logs <= seen + TIE].sum()
    return min(1.0, tail / total)


def binomial_p(k: int, n: int, p0: float) -> float | None:
    if n <= 0:
        return None
    if k <= 0:
        return 1.0
    if k > n or p0 <= 0:
        return 0.0
    if p0 >= 1:
        return 1.0
    mode = min(int((n + 1) * p0), n)
    odds = math.log(p0) - math.log1p(-p0)
    up = lambda x: np.log((n - x + 1.0) / x) + odds
    down = lambda x: -up(x + 1)
    far = NEGLIGIBLE if k <= mode else UNDERFLOW + NEGLIGIBLE
    total, tail = 1.0, 1.0 if k <= mode else 0.0
    for stop, ratio in ((n, up), (0, down)):
        best = -math.inf  # the largest term of the tail: what is far below it cannot change the tail
        for x, logs in _walk(mode, stop, ratio, far):
            weights, inside = np.exp(logs), x >= k
            total += weights.sum()
            tail += weights[inside].sum()
            best = max(best, float(logs[inside].max())) if inside.any() else best
            if logs[-1] < best + NEGLIGIBLE:
                break
    return min(1.0, tail / total)


@F.pandas_udf(DoubleType())
def _fisher(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    known: dict[tuple, float] = {}
    out = []
    for row in zip(a, b, c, d, strict=True):
        if any(pd.isna(v) for v in row):
            out.append(None)
            continue
        row = tuple(map(int, row))
        if min(row) < 0:
            raise ValueError("cell counts must not be negative")
        if row not in known:
            known[row] = fisher_p(*row)
        out.append(known[row])
    return pd.Series(out, dtype="float64")


@F.pandas_udf(DoubleType())
def _binomial(k: pd.Series, n: pd.Series, p0: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(x) or pd.isna(y) or pd.isna(z) else binomial_p(int(x), int(y), float(z)) for x, y, z in zip(k, n, p0, strict=True)], dtype="float64")


def binomial_tail(k: Column, n: Column, p0: Column) -> Column:
    """P(X >= k) for X ~ Binomial(n, p0), null for n <= 0."""
    return _binomial(k.cast("long"), n.cast("long"), p0.cast("double"))


def fisher_exact(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Two-sided p of a 2x2 table: the share of tables with the same margins that are no likelier; negative counts raise."""
    return _fisher(*(x.cast("long") for x in (a, b, c, d)))


def holm(rows: DataFrame, family: list[str], p: str = "p", idx: str = "idx", alpha: float = 0.05) -> DataFrame:
    """Adds adjusted_p and significant: step-down within each family; null p stays out of the family.

    Rows of one p get one adjusted p whatever their order, so distinct p are ranked with their counts, in parts of
    the range of p, and parts are shifted by what lies before them: no task has to order a whole family. The rows are
    written first, as they are read for the counts, for the bounds and for the result.
    """
    rows = written(rows, "holm")
    live = rows.where(F.col(p).isNotNull())
    each = written(live.groupBy(*family, p).agg(F.count(F.lit(1)).alias("_n")), "holm")
    each = each.withColumn("_part", part_of(F.col(p), bounds_of(each, p)))
    order, every = Window.partitionBy(*family, "_part").orderBy(p), Window.partitionBy(*family)
    before = Window.partitionBy(*family).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = each.groupBy(*family, "_part").agg(F.sum("_n").alias("_s"))
    parts = parts.select(*family, "_part", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_begin"), F.sum("_s").over(every).alias("_m"))
    side = parts.select(*(F.col(f).alias(f"_f{i}") for i, f in enumerate(family)), F.col("_part").alias("_p"), "_begin", "_m")
    same = lambda frame, other: [frame[f].eqNullSafe(other[f"_f{i}"]) for i, f in enumerate(family)]
    within = F.coalesce(F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = each.join(side.hint("merge"), [*same(each, side), each["_part"] == side["_p"]]).withColumn("_raw", F.least(F.lit(1.0), F.col(p) * (F.col("_m") - F.col("_begin") - within)))
    tops = ranked.groupBy(*family, "_part").agg(F.max("_raw").alias("_t")).select(*(F.col(f).alias(f"_f{i}") for i, f in enumerate(family)), F.col("_part").alias("_p"), "_t")
    tops = tops.withColumn("_top", F.max("_t").over(Window.partitionBy(*(f"_f{i}" for i in range(len(family)))).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)))
    ranked = ranked.select(*family, p, "_part", "_raw")
    done = ranked.join(tops.hint("merge"), [*same(ranked, tops), ranked["_part"] == tops["_p"]])
    done = done.withColumn("adjusted_p", F.greatest(F.coalesce("_top", F.lit(0.0)), F.max("_raw").over(order)))
    done = done.select(*(F.col(f).alias(f"_f{i}") for i, f in enumerate(family)), F.col(p).alias("_q"), "adjusted_p")
    live = live.join(done.hint("merge"), [*same(live, done), live[p] == done["_q"]]).select(*(live[c] for c in rows.columns), "adjusted_p").withColumn("significant", F.col("adjusted_p") <= alpha)
    none = rows.where(F.col(p).isNull()).withColumn("adjusted_p", F.lit(None).cast("double")).withColumn("significant", F.lit(None).cast("boolean"))
    return live.unionByName(none)
