"""Quality rules (operator 2): a short-circuit cascade, ordered by rejection per cost.

Each rule is a Column that is true where a document fails. A sample of the documents is written out
once; every rule is timed on it and its failures are counted; rules are then put in descending order of
(rejected share / cost). The cascade is one CASE over the ordered rules, so a document pays for no rule
after the first that rejects it. The order changes the cost and the first reason, never the verdict.

Words are runs of characters other than space and 0x09-0x0D. Edge cases: null and empty texts have no
words, zero counts and fail the base rule; repeated rows are judged alike; an empty table gives an empty
result; a rule that fails on every or no sampled document is only ordered first or last.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, Scratch

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: Length in words of the windows whose repetition counts.
WINDOW = 8


def words(text: Column) -> Column:
    """Array of the words; white space of one kind first, so that the split needs no pattern."""
    return F.filter(F.split(F.translate(text, WHITE, " " * len(WHITE)), " "), lambda w: w != "")


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row, also inside lambdas."""
    return F.transform(F.array(value), body)[0]


def repeated_words(ws: Column, window: int = WINDOW) -> Column:
    """How many words lie in windows that occur at least twice in the text.

    Windows of one text are compared by the 64-bit hash of their words' 64-bit hashes. Only texts in which a window repeats pay
    for positions: these are sorted by window, kept where a neighbour is equal, and their union measured.
    """
    n = F.size(ws) - (window - 1)

    def windows(w: Column) -> Column:
        hashes = F.transform(w, lambda x: F.xxhash64(x))
        return let(hashes, lambda h: F.transform(F.sequence(F.lit(1), F.size(h) - (window - 1)), lambda i: F.xxhash64(F.slice(h, i, window))))

    def covered(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        last = F.size(h) - 1
        starts = let(
            pairs,
            lambda p: F.filter(
                p, lambda x, j: ((j > 0) & (F.get(p, j - 1)["h"] == x["h"])) | ((j < last) & (F.get(p, j + 1)["h"] == x["h"]))
            ),
        )
        ordered = F.sort_array(F.transform(starts, lambda x: x["i"]))
        zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        step = lambda acc, s: F.struct((acc["n"] + (s + window) - F.greatest(s, acc["end"])).alias("n"), (s + window).alias("end"))
        return F.aggregate(ordered, zero, step, lambda acc: acc["n"])

    return F.when(n < 2, 0).otherwise(
        let(windows(ws), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(covered(h)))
    ).cast("long")


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", whole: bool = False, repeats: bool = True) -> DataFrame:
    """doc_id, text, ws and the counts that the base rule and the report need; whole: the input row too, as `row`;
    repeats: with n_repeat_words, which costs more than all other counts."""
    row = [F.struct(*(docs[c] for c in docs.columns)).alias("row")] if whole else []
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *row)
    base = base.withColumn("ws", words(F.col("text")))
    lines = F.filter(F.split("text", "\n"), lambda x: F.translate(x, WHITE, "") != "")
    return base.select(
        "doc_id", "text", "ws",
        F.size("ws").cast("long").alias("n_words"),
        F.length(F.translate("text", WHITE, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        *([repeated_words(F.col("ws")).alias("n_repeat_words")] if repeats else []), *(["row"] if whole else []),
    )


#: A word without a letter of any script.
LETTERLESS = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D\p{L}]++(?![^\x20\x09-\x0D])"


@dataclass(frozen=True)
class Rule:
    """failed is true for a document that the rule rejects; it may use text, ws and the measures."""

    name: str
    failed: Column


#: The base rule: words that a text has at least, and the share of them in repeated windows, in percent, at most.
LEAST_WORDS, MOST_REPEAT_PERCENT = 20, 30


def too_short() -> Column:
    return F.col("n_words") < LEAST_WORDS


def repeats_too_much(n_repeat_words: Column) -> Column:
    return 100 * n_repeat_words > MOST_REPEAT_PERCENT * F.col("n_words")


def base_failed() -> Column:
    return too_short() | repeats_too_much(F.col("n_repeat_words"))


def share_over(part: Column, percent: int, whole: Column) -> Column:
    return 100 * part > percent * whole


def count_words(test) -> Column:
    return F.size(F.filter("ws", test))


def production_rules() -> list[Rule]:
    """Rules beyond the base: shares far outside what prose of any language reaches. Short words are told by their bytes, as
    one character is a word in some scripts."""
    n, chars = F.col("n_words"), F.col("word_chars")
    return [
        Rule("symbols", share_over(F.col("n_symbols"), 10, chars)),
        Rule("duplicate_lines", share_over(F.col("n_dup_lines"), 60, F.size(F.split("text", "\n")))),
        Rule("mean_word_length", (F.octet_length(F.translate("text", WHITE, "")) < 2 * n) | (chars > 20 * n)),
        Rule("shouting", share_over(count_words(lambda w: (F.length(w) > 1) & (F.upper(w) == w) & (F.lower(w) != w)), 40, n)),
        Rule("no_letters", share_over(F.regexp_count("text", F.lit(LETTERLESS)), 50, n)),
        Rule("stutter", share_over(F.size(F.filter("ws", lambda w, i: (i > 0) & (w == F.get("ws", i - 1)))), 30, n)),
        Rule("markup", share_over(count_words(lambda w: F.startswith(w, F.lit("<")) & F.endswith(w, F.lit(">"))), 20, n)),
    ]


def rule_statistics(sample: DataFrame, rules: list[Rule]) -> list[tuple[str, float, float]]:
    """(rule, seconds, rejected share) on a written sample of measured documents.

    The columns beside the rules come ready from the sample, so a rule's time is its own work less that
    of a rule that never looks at a document.
    """

    def timed(test: Column) -> tuple[float, float]:
        began = time.perf_counter()
        total, failed = sample.agg(F.count(F.lit(1)), F.count_if(test)).first()
        return time.perf_counter() - began, failed / max(total, 1)

    timed(F.lit(False))
    idle = min(timed(F.lit(False))[0] for _ in range(2))
    return [(r.name, max(seconds - idle, 1e-3), share) for r in rules for seconds, share in [timed(r.failed)]]


def ordered(rules: list[Rule], statistics: list[tuple[str, float, float]]) -> list[Rule]:
    """Highest rejected share per second first; ties keep their order."""
    rank = {name: share / seconds for name, seconds, share in statistics}
    return sorted(rules, key=lambda r: -rank[r.name])


def cascade(rules: list[Rule]) -> Column:
    """Name of the first rule that rejects, null if none does."""
    out = F
    for r in rules:
        out = out.when(r.failed, F.lit(r.name))
    return out.otherwise(F.lit(None).cast("string")) if rules else F.lit(None).cast("string")


def planned(docs: DataFrame, rules: list[Rule], sample_rows: int, id_col: str, text_col: str, repeats: bool = True) -> list[Rule]:
    """The rules in the order that a sample of expected size sample_rows suggests, judged on what the base rule leaves; without
    repeats, on what its number of words leaves."""
    total = docs.select(F.lit(1)).count()
    picked = docs.sample(min(1.0, sample_rows / max(total, 1)), seed=7)
    scratch = Scratch(docs.sparkSession, "rules")
    sample = scratch.table(measures(picked, id_col, text_col, repeats=repeats), "sample")
    out = ordered(rules, rule_statistics(sample.where(~(base_failed() if repeats else too_short())), rules))
    scratch.drop("sample")
    return out


def quality_rules(
    docs: DataFrame, rules: list[Rule] | None = None, sample_rows: int = 2000, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per row: doc_id, the measures, base_failed, first_rejection (null: none) and kept.

    sample_rows bounds the expected size of the sample on which costs and selectivities are estimated.
    """
    plan = planned(docs, production_rules() if rules is None else rules, sample_rows, id_col, text_col)
    reason = F.when(base_failed(), F.lit("base")).otherwise(cascade(plan))
    return measures(docs, id_col, text_col).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), reason.alias("first_rejection")
    ).withColumn("kept", F.col("first_rejection").isNull())


def quality_filter(
    docs: DataFrame, rules: list[Rule] | None = None, sample_rows: int = 2000, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The rows of docs, unchanged, that quality_rules() keeps.

    The base rule's repeated words are a rule like the others here: only documents that get to it in the cascade pay for it.
    """
    every = [*(production_rules() if rules is None else rules), Rule("repeats", repeats_too_much(repeated_words(F.col("ws"))))]
    plan = planned(docs, every, sample_rows, id_col, text_col, repeats=False)
    reason = F.when(too_short(), F.lit("base")).otherwise(cascade(plan))
    # a filter would be pushed below the measures and compute them once for every place that uses them
    kept = F.explode(F.when(reason.isNull(), F.array("row")))
    return measures(docs, id_col, text_col, whole=True, repeats=False).select(kept.alias("row")).select("row.*")
