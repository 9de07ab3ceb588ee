"""Reproducible perturbation of texts and survival of signals (T*)."""

from __future__ import annotations

import functools
import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..functions.edits import edit_distance
from ..functions.textsem import WS, WS_CHARS, norm_ws, trim_ws
from .classify import DRAW_STEP, draw, fnv1a
from .signals import match_counts, match_signals

#: Shares of sentences and words that the human edit drops.
DROP_SENTENCE, DROP_WORD = 0.1, 0.05
#: The synonym table.
SYNONYMS = {
    "analyze": "examine", "analyzed": "examined", "analyzes": "examines", "analyzing": "examining", "approach": "method", "method": "technique",
    "methods": "techniques", "methodology": "approach", "significant": "notable", "significantly": "notably", "indicate": "suggest", "indicates": "suggests",
    "indicated": "suggested", "demonstrate": "show", "demonstrates": "shows", "demonstrated": "showed", "evaluate": "assess", "evaluated": "assessed",
    "evaluates": "assesses", "evaluation": "assessment", "investigate": "explore", "investigated": "explored", "investigates": "explores", "utilize": "use",
    "utilized": "used", "utilizes": "uses", "comprehensive": "thorough", "extensive": "wide-ranging", "substantial": "considerable", "robust": "reliable",
    "framework": "structure", "dataset": "data set", "hypothesis": "premise", "findings": "results", "contribute": "add", "contribution": "addition",
    "novel": "new", "existing": "current", "prior": "earlier", "previous": "earlier", "subsequently": "afterward", "consequently": "as a result",
    "moreover": "furthermore", "additionally": "in addition", "however": "nonetheless", "therefore": "thus", "furthermore": "in addition", "crucial": "essential",
    "fundamental": "core", "underlying": "underpinning", "comprise": "consist of", "reveal": "show", "revealed": "showed", "establish": "confirm",
    "established": "confirmed", "validate": "verify", "validated": "verified", "compare": "contrast", "compared": "contrasted", "enhance": "improve",
    "enhanced": "improved", "facilitate": "enable", "facilitated": "enabled", "mitigate": "reduce", "address": "tackle", "addressed": "tackled",
    "outline": "summarize", "outlines": "summarizes", "highlight": "emphasize", "highlights": "emphasizes",
}


def _let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), 0)


def sentences(text: Column) -> Column:
    """Pieces between a sentence end and the white space after it, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(text, rf"(?<=[.!?]){WS}+"), trim_ws), lambda s: s != "")


def word_core(word: Column) -> Column:
    return F.lower(F.regexp_replace(word, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))


_SPACE = f"[{re.escape(WS_CHARS)}]"
_SENTENCE_END, _TOKENS = re.compile(f"(?<=[.!?]){_SPACE}+"), re.compile(f"{_SPACE}+|[^{_SPACE[1:]}+")
_AROUND = regex.compile(r"\A[^\p{L}\p{N}]+|[^\p{L}\p{N}]+\Z")


def draws(seed: int, first: int, n: int) -> np.ndarray:
    """classify.draw() of n numbers from the first on."""
    a = (np.uint64(seed) + np.arange(first, first + n, dtype=np.uint64) * np.uint64(DRAW_STEP)).astype(np.uint32)
    t = (a ^ (a >> np.uint32(15))) * (a | np.uint32(1))
    t ^= t + (t ^ (t >> np.uint32(7))) * (t | np.uint32(61))
    return (t ^ (t >> np.uint32(14))) / 4294967296.0


def edited(text: str, seed: int, protected: frozenset[str]) -> str:
    """human_edit() of one text."""
    all_ = [s for s in (p.strip(WS_CHARS) for p in _SENTENCE_END.split(text)) if s]
    if not all_:
        return text
    used = len(all_)
    kept = [s for s, x in zip(all_, draws(seed, 1, used), strict=True) if x >= DROP_SENTENCE] or all_[:1]
    if len(kept) >= 2:
        used += 1
        at = int(draws(seed, used, 1)[0] * (len(kept) - 1))
        kept[at], kept[at + 1] = kept[at + 1], kept[at]
    tokens = _TOKENS.findall(" ".join(kept))
    core = lambda w: (w if w[0].isalnum() and w[-1].isalnum() else _AROUND.sub("", w)).lower()
    turns = [i for i in range(0, len(tokens), 2) if not (protected and core(tokens[i]) in protected)]  # words and spaces alternate
    for i in np.flatnonzero(draws(seed, used + 1, len(turns)) < DROP_WORD).tolist():
        tokens[turns[i]] = ""
    return "".join(tokens)


@F.arrow_udf(StringType())
def _edited(text: pa.Array, seed: pa.Array, protected: pa.Array) -> pa.Array:
    rows = zip(text.to_pylist(), seed.to_pylist(), protected.to_pylist(), strict=True)
    return pa.array([None if t is None or s is None else edited(t, s, frozenset(p or ())) for t, s, p in rows], pa.string())


def human_edit(text: Column, seed: Column, protected: Column) -> Column:
    """Drops about a tenth of the sentences, swaps two neighbours, drops a twentieth of the unprotected words.

    Draws are taken in this order: one a sentence, one for the swap if two or more are kept, one for each
    unprotected word of the kept sentences; protected words take none. A helper of one text in Arrow batches: as nested
    array functions each word cost some fifteen microseconds.
    """
    return _edited(text, fnv1a(F.concat(F.lit("human_edit:"), seed)), protected)


def synonyms(text: Column) -> Column:
    """Table words replaced, keeping UPPER and Title case."""
    shortest = min(map(len, SYNONYMS))
    table = F.create_map(*(F.lit(x) for kv in SYNONYMS.items() for x in kv))
    parts = F.regexp_extract_all(text, F.lit(r"\p{L}[\p{L}'-]*|[^\p{L}]+"), F.lit(0))

    def swap(w: Column) -> Column:
        low = F.lower(w)
        new = F.element_at(table, low)
        title = (F.left(w, F.lit(1)) == F.upper(F.left(w, F.lit(1)))) & (F.substring(w, 2, 1 << 30) == F.substring(low, 2, 1 << 30))
        return (
            F.when((F.length(w) < shortest) | ~low.isin(*SYNONYMS), w)  # a hashed set, where the map is searched key by key
            .when((w == F.upper(w)) & (w != low), F.upper(new))
            .when(title, F.concat(F.upper(F.left(new, F.lit(1))), F.substring(new, 2, 1 << 30)))
            .otherwise(new)
        )

    return F.array_join(F.transform(parts, swap), "")


def clause_swap(sentence: Column, coin: Column) -> Column:
    """Clauses around the first ", " swapped and re-cased where coin is 0.5 or more; the terminator stays last."""
    at = F.instr(sentence, ", ")
    first, rest = F.substring(sentence, F.lit(1), at - 1), F.substring(sentence, at + 2, F.lit(1 << 30))
    ends = F.rlike(rest, F.lit("[.!?]$"))
    body = F.when(ends, F.left(rest, F.length(rest) - 1)).otherwise(rest)
    end = F.when(ends, F.right(rest, F.lit(1))).otherwise("")
    up, down = (lambda c: F.concat(F.upper(F.left(c, F.lit(1))), F.substring(c, 2, 1 << 30))), (lambda c: F.concat(F.lower(F.left(c, F.lit(1))), F.substring(c, 2, 1 << 30)))
    return F.when((at < 2) | (coin < 0.5) | (rest == ""), sentence).otherwise(F.concat(up(body), F.lit(", "), down(first), end))


def paraphrase(text: Column, seed: Column) -> Column:
    """Synonyms, then seeded clause swaps; sentences without a comma take no draw."""

    def run(s: Column) -> Column:
        zero = F.struct(F.lit(0).alias("i"), F.array().cast("array<string>").alias("out"))

        def step(acc: Column, x: Column) -> Column:
            i = acc["i"] + F.when(F.contains(x, F.lit(", ")), 1).otherwise(0)
            return F.struct(i.alias("i"), F.array_append(acc["out"], clause_swap(x, draw(s, i))).alias("out"))

        done = lambda all_: F.aggregate(F.transform(all_, synonyms), zero, step, lambda acc: F.array_join(acc["out"], " "))
        return _let(sentences(text), lambda all_: F.when(F.size(all_) == 0, synonyms(text)).otherwise(done(all_)))

    return _let(fnv1a(F.concat(F.lit("paraphrase:"), seed)), run)


@dataclass(frozen=True)
class Transform:
    """A transform of texts: a function of a DataFrame(SAMPLE) that changes its column text and may fill error.

    A seeded transform gets a row a text and repeat, each with a seed of its own; another gets a row a text, and its
    result counts for every repeat.
    """

    apply: Callable[[DataFrame], DataFrame]
    seeded: bool = True


#: What a transform gets, beside the key of the text: repeat (null if not seeded), seed, text and error (null).
SAMPLE = ["repeat", "seed", "text", "error"]


def column_transform(f: Callable[[Column, Column], Column], seeded: bool = True) -> Transform:
    """A transform from a function of the columns (text, seed)."""
    return Transform(lambda rows: rows.withColumn("text", f(F.col("text"), F.col("seed"))), seeded)


def python_transform(f: Callable[[str, str], str], seeded: bool = True) -> Transform:
    """A transform from a Python function of (text, seed), called in Arrow batches. What it raises for one text becomes
    that sample's error; the other texts of the batch have their results."""

    @F.arrow_udf("struct<text: string, error: string>")
    def run(text: pa.Array, seed: pa.Array) -> pa.Array:
        out = []
        for t, s in zip(text.to_pylist(), seed.to_pylist(), strict=True):
            try:
                out.append({"text": None if t is None else f(t, s), "error": None})
            except Exception as e:  # a plugged-in function may raise anything
                out.append({"text": None, "error": f"{type(e).__name__}: {e}"})
        return pa.array(out, pa.struct([("text", pa.string()), ("error", pa.string())]))

    return Transform(lambda rows: rows.withColumn("_r", run("text", "seed")).withColumns({"text": F.col("_r.text"), "error": F.col("_r.error")}).drop("_r"), seeded)


def transform_grid(texts: DataFrame, transforms: dict[str, Transform | Callable | None], repeats: int, key: str, text_col: str = "text") -> DataFrame:
    """key, transform, repeat, available, text, error: every text under every transform.

    transforms: name to Transform, to a function of the columns (text, seed), or to None for one that is not
    available here, which gives rows without text rather than none. Each transform reads the texts once; a text is
    repeated before a transform only where each repeat has a seed, else after it.
    """
    rows = texts.select(key, F.col(text_col).alias("text"), F.lit(None).cast("string").alias("error"))
    turns, out = F.explode(F.sequence(F.lit(1), F.lit(repeats))).alias("repeat"), []
    final = lambda frame, name, available, repeat="repeat": frame.select(key, F.lit(name).alias("transform"), repeat, F.lit(available).alias("available"), "text", "error")
    for name, t in transforms.items():
        if t is None:
            out.append(final(rows.withColumn("text", F.lit(None).cast("string")), name, False, turns))
            continue
        t = t if isinstance(t, Transform) else column_transform(t)
        seed = lambda *more: F.concat_ws(":", F.col(key).cast("string"), F.lit(name), *more).alias("seed")  # noqa: B023, E731
        if t.seeded:
            some = rows.select(key, turns, "text", "error")
            done = t.apply(some.select(key, "repeat", seed(F.col("repeat").cast("string")), "text", "error"))
            out.append(final(done, name, True))
        else:
            done = t.apply(rows.select(key, F.lit(None).cast("int").alias("repeat"), seed(), "text", "error")).drop("repeat")
            out.append(final(done, name, True, turns))
    return functools.reduce(DataFrame.union, out)


def survival(before: DataFrame, after: DataFrame, keys: list[str], more: list[str]) -> DataFrame:
    """keys + more, matched counts and all-matched flags of match_counts() rows before and after."""
    hit = lambda p: (F.col(f"{p}total") > 0) & (F.col(f"{p}matched_count") == F.col(f"{p}total"))
    b = before.select(*keys, F.col("matched_count").alias("b_matched_count"), F.col("total").alias("b_total"))
    rows = after.join(b.hint("merge"), keys)
    return rows.select(*keys, *more, F.col("b_matched_count").alias("matched_before"), F.col("matched_count").alias("matched_after"), hit("b_").alias("all_before"), hit("").alias("all_after"))


def survival_of(texts: DataFrame, transforms: dict, repeats: int, key: str, signals: DataFrame, before: DataFrame) -> DataFrame:
    """survival() of transform_grid(): texts of transforms without a seed are matched once, and count for each repeat."""
    keys = [key, "transform", "repeat"]
    seeded = {n: t for n, t in transforms.items() if t is not None and (not isinstance(t, Transform) or t.seeded)}
    once = {n: t for n, t in transforms.items() if isinstance(t, Transform) and not t.seeded}
    counts = []
    for some, n in ((seeded, repeats), (once, 1)):
        if some:
            grid = transform_grid(texts, some, n, key).where("error IS NULL")
            rows = match_counts(match_signals(grid, signals, keys), keys)
            counts.append(rows if n == repeats else rows.withColumn("repeat", F.explode(F.sequence(F.lit(1), F.lit(repeats)))))
    return survival(before, functools.reduce(DataFrame.unionByName, counts), [key], ["transform", "repeat"])


def survival_rate(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("samples"), F.avg(F.col("all_after").cast("double")).alias("survival_rate"))


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """NFKC; for rows beyond ASCII only, as Spark has no such function."""
    return text.str.normalize("NFKC")


@F.arrow_udf(StructType([StructField("characters", LongType()), StructField("words", LongType())]))
def distances(reference: pa.Array, hypothesis: pa.Array) -> pa.Array:
    """Edit distances over characters and over words; null where a text is. Spark's own takes time and memory of both lengths'
    product, and characters only."""
    out = []
    for r, h in zip(reference.to_pylist(), hypothesis.to_pylist(), strict=True):
        known = r is not None and h is not None
        out.append({"characters": edit_distance(r, h), "words": edit_distance(r.split(), h.split())} if known else None)
    return pa.array(out, pa.struct([("characters", pa.int64()), ("words", pa.int64())]))


def error_rates(rows: DataFrame, keys: list[str], reference: str, hypothesis: str, unicode_: bool = True) -> DataFrame:
    """keys, cer, wer: edit distances over characters and words of NFKC, white-space-normalised texts, by the reference's length."""
    clean = lambda c: norm_ws(nfkc(F.col(c)) if unicode_ else F.col(c))
    rows = rows.select(*keys, clean(reference).alias("r"), clean(hypothesis).alias("h"))
    rows = rows.withColumn("d", distances("r", "h"))
    n_words = F.size(F.filter(F.split("r", " "), lambda w: w != ""))
    n = lambda c: F.greatest(F.lit(1), c)
    return rows.select(*keys, (F.col("d.characters") / n(F.length("r"))).alias("cer"), (F.col("d.words") / n(n_words)).alias("wer"))


def survival_text(rates: DataFrame, run: str) -> DataFrame:
    """run, text: one line for all transforms of a run."""
    said = F.when(F.col("survival_rate").isNull(), F.concat("transform", F.lit(": not available"))).otherwise(F.concat("transform", F.lit(": "), F.format_string("%.0f", F.col("survival_rate") * 100), F.lit("% survived")))
    return rates.withColumn("_s", said).groupBy(run).agg(F.expr("listagg(_s, '; ') WITHIN GROUP (ORDER BY transform)").alias("text"))
