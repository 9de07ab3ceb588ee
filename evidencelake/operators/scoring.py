"""Scores, calibration and comparison of populations (A*), all as aggregates of one table of matches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.order import small
from ..functions.scratch import written
from ..functions.stats import binomial_tail, fisher_exact, holm
from .signals import GROUPS


def score_groups(matches: DataFrame, keys: list[str], weights: dict[str, float] | None = None) -> DataFrame:
    """keys, methodology, lexical, structural, combined, matched_count, total in one aggregation."""
    w = {"methodology": 1.0, "lexical": 1.0, "structural": 1.0} | (weights or {})
    group = F.lit(None)
    for kind, name in GROUPS.items():
        group = F.when(F.col("type") == kind, name).otherwise(group)
    rows = matches.withColumn("_g", group)
    agg = [F.count_if("matched").alias("matched_count"), F.count(F.lit(1)).alias("total")]
    for g in w:
        agg += [F.count_if(F.col("_g") == g).alias(f"_n_{g}"), F.count_if((F.col("_g") == g) & F.col("matched")).alias(f"_m_{g}")]
    rows = rows.groupBy(*keys).agg(*agg)
    share = {g: F.coalesce(F.try_divide(F.col(f"_m_{g}").cast("double"), F.col(f"_n_{g}").cast("double")), F.lit(0.0)) for g in w}
    top, under = F.lit(0.0), F.lit(0.0)
    for g, x in w.items():
        here = F.col(f"_n_{g}") > 0
        top, under = top + F.when(here, share[g] * x).otherwise(0.0), under + F.when(here, F.lit(x)).otherwise(0.0)
    return rows.select(*keys, *(share[g].alias(g) for g in w), F.coalesce(F.try_divide(top, under), F.lit(0.0)).alias("combined"), "matched_count", "total")


def signal_rates(matches: DataFrame, signals: DataFrame, by: list[str] | None = None) -> DataFrame:
    """by, idx, n, rate: each signal's share of matched texts; a signal without texts has rate null."""
    by = by or []
    rows = matches.groupBy(*by, "idx").agg(F.count(F.lit(1)).alias("n"), F.count_if("matched").alias("m"))
    if not by:
        rows = signals.select("idx").join(rows, "idx", "left").fillna(0, ["n", "m"])
    return rows.select(*by, "idx", "n", F.try_divide(F.col("m").cast("double"), F.col("n").cast("double")).alias("rate"))


def calibrate(scores: DataFrame, by: list[str]) -> DataFrame:
    """by, baseline_count, combined_mean, all_matched, false_positive_rate of scored baseline texts."""
    hit = (F.col("total") > 0) & (F.col("matched_count") == F.col("total"))
    rows = scores.groupBy(*by).agg(F.count(F.lit(1)).alias("baseline_count"), F.avg("combined").alias("combined_mean"), F.count_if(hit).alias("all_matched"), F.max("total").alias("_t"))
    return rows.withColumn("false_positive_rate", F.when(F.col("_t") > 0, F.col("all_matched") / F.col("baseline_count"))).drop("_t")


def evaluate(scores: DataFrame, calibration: DataFrame, by: list[str]) -> DataFrame:
    """scores with p_value and method: one trial (all matched or not) against the false-positive rate.

    A baseline row is judged by a calibration that it is part of itself; leave it out beforehand if unwanted.
    """
    rows = scores.join(small(calibration.select(*by, "baseline_count", "false_positive_rate")), by, "left")
    ready = (F.col("total") > 0) & (F.coalesce("baseline_count", F.lit(0)) > 0) & F.col("false_positive_rate").isNotNull()
    k = F.when(F.col("matched_count") == F.col("total"), 1).otherwise(0).cast("long")
    p = F.when(ready, binomial_tail(k, F.lit(1).cast("long"), F.col("false_positive_rate")))
    return rows.withColumn("p_value", p).withColumn("method", F.when(ready, "binomial_vs_baseline").otherwise("insufficient_baseline"))


def recompute(scores: DataFrame, by: list[str], unit: str, alpha: float = 0.05) -> DataFrame:
    """by, unit, p_value, adjusted_p, significant of candidates: calibrated on the baselines of their group, corrected over its
    candidates. The scores (score_groups() rows with a label) are written once: calibration and evaluation both read them."""
    scores = written(scores, "scores")
    rows = evaluate(scores.where("label = 'candidate'"), calibrate(scores.where("label = 'baseline'"), by), by).where("p_value IS NOT NULL")
    return holm(rows.select(unit, *by, "p_value"), by, "p_value", unit, alpha)


def cell_counts(matches: DataFrame, by: list[str]) -> DataFrame:
    """by, idx, a, b, c, d: candidates that match and do not, baselines that match and do not."""
    cand, base = F.col("label") == "candidate", F.col("label") == "baseline"
    return matches.groupBy(*by, "idx").agg(
        F.count_if(cand & F.col("matched")).alias("a"), F.count_if(cand & ~F.col("matched")).alias("b"),
        F.count_if(base & F.col("matched")).alias("c"), F.count_if(base & ~F.col("matched")).alias("d"),
    )


def tested_cells(counts: DataFrame, by: list[str], alpha: float = 0.05) -> DataFrame:
    """cell_counts() with rates, fisher_p, adjusted_p and significant."""
    rows, n1, n2 = counts, F.col("a") + F.col("b"), F.col("c") + F.col("d")
    rows = rows.select(
        *by, "idx", "a", "b", "c", "d",
        F.try_divide(F.col("a").cast("double"), n1.cast("double")).alias("candidate_rate"),
        F.try_divide(F.col("c").cast("double"), n2.cast("double")).alias("baseline_rate"),
        F.when((n1 > 0) & (n2 > 0), fisher_exact(*map(F.col, "abcd"))).alias("fisher_p"),
    )
    return holm(rows, by, "fisher_p", "idx", alpha)


def compare_rates(matches: DataFrame, by: list[str], alpha: float = 0.05) -> DataFrame:
    """by, idx, counts, rates, fisher_p, adjusted_p, significant of matches that carry a label (candidate or baseline)."""
    return tested_cells(cell_counts(matches, by), by, alpha)


def compare_all_matched(counts: DataFrame, by: list[str]) -> DataFrame:
    """by, counts, all-matched rates, fisher_p, delta_pp and notes of match_counts() rows that carry a label."""
    hit = (F.col("total") > 0) & (F.col("matched_count") == F.col("total"))
    cand, base = F.col("label") == "candidate", F.col("label") == "baseline"
    rows = counts.groupBy(*by).agg(
        F.count_if(cand).alias("candidate_count"), F.count_if(base).alias("baseline_count"), F.max("total").alias("_t"),
        F.count_if(cand & hit).alias("a"), F.count_if(base & hit).alias("c"),
    )
    n1, n2 = F.col("candidate_count"), F.col("baseline_count")
    r1 = F.when((F.col("_t") > 0) & (n1 > 0), F.col("a") / n1)
    r2 = F.when((F.col("_t") > 0) & (n2 > 0), F.col("c") / n2)
    notes = F.array_compact(F.array(F.when(n1 == 0, "no candidate texts"), F.when(n2 == 0, "no baseline texts"), F.when(F.col("_t") == 0, "no signals")))
    return rows.select(
        *by, "candidate_count", "baseline_count", r1.alias("candidate_all_rate"), r2.alias("baseline_all_rate"),
        F.when((n1 > 0) & (n2 > 0) & (F.col("_t") > 0), fisher_exact(F.col("a"), n1 - F.col("a"), F.col("c"), n2 - F.col("c"))).alias("fisher_p"),
        ((r1 - r2) * 100).alias("delta_pp"), F.array_join(notes, "; ").alias("notes"),
    )


#: The texts of a report, which readers of exports compare.
ALL_MATCHED, SOME_MATCHED, NONE_MATCHED = "Hidden instruction signal matched", "Behavioral canary detected", "No consistent signal"
NO_SIGNALS = "No expected signals are configured for this job, so no evidence could be evaluated."
MATCHED = "%d of %d configured deterministic evidence signal(s) matched in this submission's text."
NO_BASELINE = "No baseline submissions have been recorded for this job yet, so no false-positive rate is available — treat this result as unvalidated."
VALIDATED = 'Based on %d baseline submission(s), a false-positive rate of %s%% was observed for "all signals matched"; this is evidence, never a verdict.'


def interpretation(matched, total, baseline_count, rate) -> dict:
    """headline, text and uncertainty of a scored text; evidence for a reviewer, not a verdict."""
    headline = F.when((total > 0) & (matched == total), ALL_MATCHED).when(matched > 0, SOME_MATCHED).otherwise(NONE_MATCHED)
    text = F.when(total == 0, NO_SIGNALS).otherwise(F.format_string(MATCHED, matched, total))
    share = F.coalesce(F.format_string("%.1f", rate * 100), F.lit("n/a"))
    known = F.format_string(VALIDATED, baseline_count, share)
    uncertainty = F.when(F.coalesce(baseline_count, F.lit(0)) == 0, NO_BASELINE).otherwise(known)
    return {"headline": headline, "text": text, "uncertainty": uncertainty}


def unscorable(jobs: DataFrame, signals: DataFrame, key: str) -> DataFrame:
    """Jobs that have no signals, with the reason."""
    return jobs.join(signals.select(key).distinct(), key, "left_anti").withColumn("error", F.lit("no expected signals"))


__all__ = ["holm"]
