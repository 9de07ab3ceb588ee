"""Signal matching (M*): evidence of typed signals in texts, one row per text and signal.

Operators report evidence only, never a verdict about an author. The signal table is configuration (at most
MOST_SIGNALS rows): it is read on the driver, its patterns are translated and compiled there, and its values are
literals of one projection over the texts.
"""

from __future__ import annotations

import functools
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, StructField, StructType

from ..functions import matching, phrases
from ..functions.jsregex import LINEAR, NATIVE, TIMED, Unsupported, is_tame, java_pattern, linear_pattern, timed_pattern
from ..functions.order import bounds_of, dealt, part_of, parts_for, small
from ..functions.phrases import PhraseIndex
from ..functions.scratch import written
from ..functions.textsem import EDGE, WS, norm_ws, quoted, trim_ws
from .textops import strip_tags

MOST_SIGNALS = 1000
#: Characters of the runs by which needles of one or two words meet texts.
GRAM = 4
#: Limits on user patterns, and on regex signals and characters per call.
MOST_PATTERN, MOST_REGEX, MOST_CHARS, FLAGS = 500, 20, 1_000_000, "gimsu"
#: A group that holds a quantifier and is itself quantified.
NESTED = re.compile(r"\((?:\?:)?[^()]*(?:[+*?]|\{\d+,?\d*\})[^()]*\)(?:[+*?]|\{\d+,?\d*\})")
#: Which group each kind of signal counts for.
GROUPS = {"methodology_label": "methodology", "exact_phrase": "lexical", "regex": "lexical", "ordered_terms": "structural", "section_order": "structural"}

SCHEMA = "signal_set string, idx int, type string, value string, case_sensitive boolean, patterns array<string>, terms array<string>, error string, form string"


@dataclass(frozen=True)
class Signal:
    type: str
    value: str = ""
    case_sensitive: bool = True
    pattern: str = ""
    flags: str = ""
    aliases: tuple[str, ...] = field(default=())
    values: tuple[str, ...] = field(default=())


#: Why a pattern is refused.
TOO_LONG = f"Pattern exceeds the maximum length of {MOST_PATTERN} characters."
NESTED_QUANTIFIERS = "Pattern rejected: nested quantifiers can cause catastrophic backtracking."
DISALLOWED = 'Disallowed regex flag: "{}".'


def checked_pattern(spark: SparkSession, pattern: str, flags: str) -> tuple[matching.Compiled | None, str | None]:
    """(the pattern in the form that runs it, None), or (None, why the user pattern is refused).

    What Java is sure to match in linear time is a native pattern; else Arrow's linear matcher takes it if it can, and
    a matcher with a limit of time what is left. What is returned compiles in every task.
    """
    if len(pattern) > MOST_PATTERN:
        return None, TOO_LONG
    if NESTED.search(pattern):
        return None, NESTED_QUANTIFIERS
    for flag in flags:
        if flag not in FLAGS:
            return None, DISALLOWED.format(flag)
    if len(set(flags)) < len(flags):
        return None, f"Invalid flags: {flags}."
    why = None
    for form, translate in ((NATIVE, java_pattern), (LINEAR, linear_pattern), (TIMED, timed_pattern)):
        try:
            out = translate(pattern, flags)
            if form == NATIVE and not is_tame(pattern, flags):
                continue
            if form == NATIVE:
                spark._jvm.java.util.regex.Pattern.compile(out)
            elif wrong := matching.compiles(form, out):
                why = why or f"Invalid regular expression: {wrong.splitlines()[0]}."
                continue
            return matching.Compiled(form, out), None
        except Unsupported:
            continue
        except ValueError as e:
            return None, str(e)
        except (Py4JJavaError, IllegalArgumentException) as e:
            why = f"Invalid regular expression: {str(e).splitlines()[0]}."
    return None, why or "Invalid regular expression."


def label_pattern(term: str) -> str | None:
    """Whole-word pattern of a label in which spaces match any white space; None for a blank label."""
    parts = term.split()
    if not parts:
        return None
    first, last = parts[0][0], parts[-1][-1]
    # what the text must have next is looked at first, so that most places cost one comparison
    return f"(?iu)(?={quoted(first)}){_edge(first, '(?<!', '(?<=')}{f'{WS}+'.join(map(quoted, parts))}{_edge(last, '(?!', '(?=')}"


def _edge(c: str, apart: str, beside: str) -> str:
    """The word boundary beside a character that is known: beyond it stands no word character (apart), or one (beside)."""
    return f"{apart if c.isalnum() or c == '_' else beside}[A-Za-z0-9_])" if c.isascii() else EDGE


def signal_frame(spark: SparkSession, signals: list[Signal], signal_set: str = "default") -> DataFrame:
    """The signal table, checked and translated."""
    if len(signals) > MOST_SIGNALS:
        raise ValueError(f"more than {MOST_SIGNALS} signals; for many phrases, see disclosures()")
    rows, n_regex = [], 0
    for i, s in enumerate(signals):
        patterns, terms, error, form = [], list(s.values), None, None
        if s.type == "regex":
            n_regex += 1
            found, error = checked_pattern(spark, s.pattern, s.flags)
            error = error or (f"More than {MOST_REGEX} regex signals." if n_regex > MOST_REGEX else None)
            patterns, form = ([], None) if error else ([found.pattern], found.form)
        elif s.type == "methodology_label":
            labels = [(t, p) for t in (s.value, *s.aliases) if (p := label_pattern(t))]
            terms, patterns = [t for t, _ in labels], [p for _, p in labels]
        rows.append((signal_set, i, s.type, s.value, s.case_sensitive, patterns, terms, error, form))
    return spark.createDataFrame(rows, SCHEMA)


#: Numbers of a part of running_sums(), at least.
PART = 16
#: Characters that stand for a match; Unicode reserves both for no character. One in a text counts as the other.
MARK, OTHER = "\ufdd0", "\ufdd1"
NO_INTS = "array<int>"


def running_sums(numbers: Column) -> Column:
    """Sums of the first 1, 2, ... numbers. Parts are summed apart and then raised by what lies before them, as appending to one
    long array copies it each time; they grow with the cube root, so that neither parts nor their number make long copies."""
    return _let(numbers, lambda x: _let(F.greatest(F.lit(PART), F.cbrt(F.size(x)).cast("int")), lambda size: _sums(x, size)))


def _sums(numbers: Column, size: Column) -> Column:
    none = F.array().cast(NO_INTS)
    run = lambda xs: F.aggregate(xs, none, lambda a, x: F.array_append(a, F.coalesce(F.get(a, F.size(a) - 1), F.lit(0)) + x))
    last = lambda p: F.get(p, F.size(p) - 1)

    def raised(x: Column) -> Column:
        return F.flatten(F.transform(x["parts"], lambda p, i: F.when(i == 0, p).otherwise(_let(F.get(x["ends"], i - 1), lambda e: F.transform(p, lambda v: v + e)))))

    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(numbers) - 1) / size).cast("int")), lambda b: run(F.slice(numbers, b * size + 1, size)))
    every = _let(parts, lambda ps: _let(F.struct(ps.alias("parts"), run(F.transform(ps, last)).alias("ends")), raised))
    return F.when(F.size(numbers) > 0, every).otherwise(none)


def _starts(pieces: Column, lengths: Column) -> Column:
    """Where matches of these lengths begin that stand between the pieces of a text."""

    def of(x: Column) -> Column:
        steps = F.transform(x["n"], lambda n, i: F.length(F.get(x["p"], i)) + n)
        return F.transform(F.transform(F.array(running_sums(steps)), lambda ends: F.zip_with(ends, x["n"], lambda e, n: e - n))[0], lambda v: v)

    return F.transform(F.array(F.struct(pieces.alias("p"), lengths.alias("n"))), of)[0]


def positions(text: Column, needle: Column) -> Column:
    """0-based code-point offsets of all non-overlapping occurrences; none for an empty needle or text."""
    pieces = F.split(text, F.concat(F.lit("\\Q"), F.replace(needle, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")), F.lit(-1))
    found = _starts(pieces, F.array_repeat(F.length(needle), F.size(pieces) - 1))
    return F.when((F.length(needle) == 0) | (F.length(text) == 0), F.array().cast(NO_INTS)).otherwise(found)


def pattern_positions(text: Column, pattern: Column) -> Column:
    """0-based code-point offsets of all matches of a Java pattern, empty ones included."""
    safe = F.when(F.contains(text, F.lit(MARK)), F.translate(text, MARK, OTHER)).otherwise(text)
    pieces = F.split(F.regexp_replace(safe, pattern, F.lit(MARK)), MARK, -1)
    return _starts(pieces, F.transform(F.regexp_extract_all(safe, pattern, F.lit(0)), lambda m: F.length(m)))


def collapsed_positions(text: Column, value: Column) -> Column:
    """Offsets in text itself at which value occurs if runs of white space count as one space, in both."""
    words = F.filter(F.split(value, f"{WS}+"), lambda w: w != "")
    literal = F.transform(words, lambda w: F.concat(F.lit("\\Q"), F.replace(w, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")))
    return F.when(F.size(words) == 0, F.array().cast(NO_INTS)).otherwise(pattern_positions(text, F.array_join(literal, f"{WS}+")))


def exact_match(text: Column, value: Column, case_sensitive: Column) -> Column:
    """The literal occurs, as it is or with white space collapsed on both sides."""
    t, v = (F.when(case_sensitive, c).otherwise(F.lower(c)) for c in (text, value))
    plain = F.contains(t, v)
    # without white space in the value, white space in the text changes nothing
    return (F.length(value) > 0) & (F.length(text) > 0) & F.when(plain, True).otherwise(F.rlike(v, F.lit(WS)) & (norm_ws(v) != "") & F.contains(norm_ws(t), norm_ws(v)))


def exact_evidence(text: Column, value: Column, case_sensitive: Column) -> Column:
    """(positions, whitespace_normalized): as it is where it occurs so, else with white space collapsed."""
    t, v = (F.when(case_sensitive, c).otherwise(F.lower(c)) for c in (text, value))
    loose = lambda: F.transform(F.array(collapsed_positions(t, v)), lambda p: F.struct(p.alias("positions"), (F.size(p) > 0).alias("whitespace_normalized")))[0]
    none = F.struct(F.array().cast(NO_INTS).alias("positions"), F.lit(False).alias("whitespace_normalized"))
    return F.when((F.length(value) == 0) | (F.length(text) == 0), none).when(F.contains(t, v), F.struct(positions(t, v).alias("positions"), F.lit(False).alias("whitespace_normalized"))).when(~F.rlike(v, F.lit(WS)), none).otherwise(loose())


def ordered_match(text: Column, terms: Column) -> Column:
    """Array of 0-based positions, null where a term is missing after its predecessor."""
    low = F.lower(text)
    zero = F.struct(F.lit(1).alias("cur"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, term: Column) -> Column:
        t = F.lower(term)
        at = F.when(F.length(t) == 0, 0).otherwise(F.call_function("locate", t, low, acc["cur"]))
        hit = at > 0
        return F.struct(F.when(hit, at + F.length(t)).otherwise(acc["cur"]).alias("cur"), F.array_append(acc["out"], F.when(hit, at - 1)).alias("out"))

    return F.aggregate(terms, zero, step, lambda acc: acc["out"])


def all_found(found: Column) -> Column:
    return (F.size(found) > 0) & ~F.exists(found, lambda x: x.isNull())


def heading_text(line: Column) -> Column:
    """Heading in a line (`#`, numbered, ALL CAPS, trailing colon), null if there is none. A plain test comes before each
    pattern, as most lines are prose."""
    t = trim_ws(line)
    md, num, colon = rf"^#{{1,6}}{WS}+(.+)$", rf"^[0-9]+[.)]{WS}+(.+)$", rf"^(.{{1,120}}):{WS}*$"
    caps = (F.upper(line) == line) & F.length(t).between(1, 80) & F.rlike(t, F.lit("[A-Za-z]")) & (t == F.upper(t))
    out = (
        F.when(F.startswith(line, F.lit("#")) & F.rlike(line, F.lit(md)), trim_ws(F.regexp_extract(line, md, 1)))
        .when(F.left(line, F.lit(1)).between("0", "9") & F.rlike(line, F.lit(num)), trim_ws(F.regexp_extract(line, num, 1)))
        .when(caps, t)
        .when(F.contains(line, F.lit(":")) & F.rlike(line, F.lit(colon)), trim_ws(F.regexp_extract(line, colon, 1)))
    )
    return _let(out, lambda x: F.when(x != "", x))


def _unended(line: Column) -> Column:
    return F.when(F.contains(line, F.lit("\r")), F.regexp_replace(line, "\r$", "")).otherwise(line)


def headings(texts: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """(key, text, line_index, char_offset) of every heading: row-local, as a text's lines are put in place within it."""
    rows = texts.select(key, F.inline(heading_list(F.col(text_col))))
    return rows.select(key, "text", "line_index", F.col("char_offset").cast("long").alias("char_offset"))


def heading_list(text: Column) -> Column:
    """Array of (text, line_index, char_offset) of the headings of a text."""

    def placed(x: Column) -> Column:
        heads = F.transform(x["ls"], lambda l, i: F.struct(_let(_unended(l), heading_text).alias("text"), i.alias("line_index"), F.when(i == 0, 0).otherwise(F.get(x["ends"], i - 1)).alias("char_offset")))
        return F.filter(heads, lambda h: h["text"].isNotNull())

    return _let(F.split(text, "\n"), lambda lines: _let(F.struct(lines.alias("ls"), running_sums(F.transform(lines, lambda l: F.length(l) + 1)).alias("ends")), placed))


def section_positions(heads: Column, names: Column) -> Column:
    """Offsets of the headings (heading_list()) found in order for the section names, null where missing."""
    zero = F.struct(F.lit(0).alias("cur"), F.array().cast(NO_INTS).alias("out"))

    def step(acc: Column, name: Column) -> Column:
        needle = F.lower(trim_ws(name))
        hit = F.filter(F.transform(heads, lambda h, i: F.when((i >= acc["cur"]) & F.contains(F.lower(h["text"]), needle), i)), lambda i: i.isNotNull())
        at = F.get(hit, 0)
        return F.struct(F.coalesce(at + 1, acc["cur"]).alias("cur"), F.array_append(acc["out"], F.get(heads, at)["char_offset"]).alias("out"))

    return F.aggregate(names, zero, step, lambda acc: acc["out"])


def section_match(text: Column, names: Column) -> Column:
    """Array of heading offsets found in order for the section names, null where missing."""
    return F.transform(F.array(heading_list(text)), lambda heads: section_positions(heads, names))[0]


def arrow_matches(patterns: list[matching.Compiled], places: bool):
    """A column function: what each of the patterns finds in a text, as matching.FOUND."""

    @F.arrow_udf(matching.FOUND)
    def run(texts: pa.Array) -> pa.Array:
        return matching.found(texts, patterns, places)

    return run


EVIDENCE = "struct<positions: array<int>, whitespace_normalized: boolean, matched_term: string, headings: array<string>>"


def _once(s: Row, text: Column, heads: Column, found: Column | None, evidence: bool, bounded: bool) -> Column | None:
    """What _entry() names several times of one signal on a text, to be worked out once; None if there is no such thing."""
    terms = F.array(*map(F.lit, s["terms"] or [])).cast("array<string>")
    if s["error"] is not None:
        return None
    if s["type"] == "ordered_terms":
        return ordered_match(text, terms)
    if s["type"] == "section_order":
        return section_positions(heads, terms)
    if evidence and s["type"] == "exact_phrase":
        return exact_evidence(text, F.lit(s["value"] or ""), F.lit(bool(s["case_sensitive"])))
    if evidence and s["type"] == "regex" and found is None:
        fits, pattern = (F.length(text) <= MOST_CHARS if bounded else F.lit(True)), F.lit(s["patterns"][0])
        return F.when(fits & F.rlike(text, pattern), pattern_positions(text, pattern))
    if evidence and s["type"] == "methodology_label" and s["patterns"]:
        return F.coalesce(*(F.when(F.rlike(text, F.lit(p)), F.lit(i)) for i, p in enumerate(s["patterns"])))
    return None


def _entry(s: Row, text: Column, heads: Column, found: Column | None, evidence: bool, bounded: bool, once: Column | None) -> Column:
    """The result of one signal on a text, with the signal's values as literals; found: what Arrow's matchers gave it;
    once: what _once() gave."""
    none, no = F.lit(None), F.lit(False)
    where, spaced, term, said = none.cast(NO_INTS), none.cast("boolean"), none.cast("string"), none.cast("array<string>")
    value, case = F.lit(s["value"] or ""), F.lit(bool(s["case_sensitive"]))
    error = F.lit(s["error"]).cast("string")
    if s["error"] is not None:
        matched = no
    elif s["type"] == "exact_phrase":
        matched = exact_match(text, value, case)
        if evidence:
            where, spaced = once["positions"], once["whitespace_normalized"]
    elif s["type"] == "regex":
        long = F.length(text) > MOST_CHARS if bounded else no
        pattern = F.lit(s["patterns"][0])
        error = F.when(long, F.lit(f"Text exceeds {MOST_CHARS} characters."))
        if found is None and evidence:
            where, matched = once, once.isNotNull()
        elif found is None:
            matched = ~long & F.rlike(text, pattern)
        else:
            matched, where, error = ~long & found["matched"], F.when(~long, found["positions"]), F.coalesce(error, found["error"])
    elif s["type"] == "methodology_label":
        matched = functools.reduce(lambda a, b: a | b, [F.rlike(text, F.lit(p)) for p in s["patterns"]], no) if once is None else once.isNotNull()
        for i, (t, p) in enumerate(zip(s["terms"], s["patterns"], strict=True)) if once is not None else ():
            where, term = F.when(once == i, pattern_positions(text, F.lit(p))).otherwise(where), F.when(once == i, F.lit(t)).otherwise(term)
    elif s["type"] == "ordered_terms":
        where, matched = once, all_found(once)
    elif s["type"] == "section_order":
        where, matched, said = once, all_found(once), F.transform(heads, lambda h: h["text"])
    else:
        matched = no
    out = [F.lit(s["signal_set"]).alias("signal_set"), F.lit(s["idx"]).alias("idx"), F.lit(s["type"]).alias("type"), F.coalesce(matched, no).alias("matched"), error.alias("error")]
    if evidence:
        out.append(F.struct(F.coalesce(where, F.array().cast(NO_INTS)).alias("positions"), spaced.alias("whitespace_normalized"), term.alias("matched_term"), said.alias("headings")).cast(EVIDENCE).alias("evidence"))
    return F.struct(*out)


def match_signals(texts: DataFrame, signals: DataFrame, keys: list[str], text_col: str = "text", bounded: bool = False, evidence: bool = False) -> DataFrame:
    """keys, signal_set, idx, type, matched, error: every signal on every text; evidence adds the struct EVIDENCE.

    Evidence: positions are code-point offsets in the text (all matches of a phrase, pattern or the first label that
    matches; one a term or section name, null where it is missing); whitespace_normalized says that a phrase was only
    found with white space collapsed; matched_term is the label that matched; headings are those of the text.
    bounded: texts over MOST_CHARS give an error value for regex signals instead of a match.

    The signal table is bounded and read on the driver; a text meets all signals in one projection.
    """
    rows = signals.orderBy("signal_set", "idx").limit(MOST_SIGNALS + 1).collect()
    if len(rows) > MOST_SIGNALS:
        raise ValueError(f"more than {MOST_SIGNALS} signals")
    texts = texts.select(*keys, F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    sections = any(s["type"] == "section_order" for s in rows)
    texts = texts.withColumn("_heads", heading_list(F.col("_text")) if sections else F.lit(None))
    arrow = [s for s in rows if s["type"] == "regex" and s["error"] is None and s["form"] != NATIVE]
    if arrow:
        texts = texts.withColumn("_found", arrow_matches([matching.Compiled(s["form"], s["patterns"][0]) for s in arrow], evidence)(F.when(F.length("_text") <= MOST_CHARS, F.col("_text")).otherwise("") if bounded else F.col("_text")))
    found = {(s["signal_set"], s["idx"]): F.col("_found")[i] for i, s in enumerate(arrow)}
    seen = [(s, F.col("_text"), F.col("_heads"), found.get((s["signal_set"], s["idx"])), evidence, bounded) for s in rows]
    once = {f"_once{i}": c for i, x in enumerate(seen) if (c := _once(*x)) is not None}
    texts = texts.withColumns(once) if once else texts
    entries = F.array(*(_entry(*x, F.col(f"_once{i}") if f"_once{i}" in once else None) for i, x in enumerate(seen)))
    if not rows:
        return texts.where("false").select(*keys, *(F.lit(None).cast(t).alias(c) for c, t in [("signal_set", "string"), ("idx", "int"), ("type", "string"), ("matched", "boolean"), ("error", "string")]))
    return texts.select(*keys, F.inline(entries))


def match_counts(matches: DataFrame, keys: list[str]) -> DataFrame:
    """keys, matched_count, total."""
    return matches.groupBy(*keys).agg(F.count_if("matched").alias("matched_count"), F.count(F.lit(1)).alias("total"))


def winning_term(text: Column, terms: list[str]) -> Column:
    """First of the terms that occurs as whole words, null if none does."""
    out = F
    for t in terms:
        if p := label_pattern(t):
            out = out.when(F.rlike(text, F.lit(p)), F.lit(t))
    return out.otherwise(F.lit(None)) if out is not F else F.lit(None).cast("string")


#: Needles of one automaton, of which every Python worker holds one; automata that texts are passed through at most.
PART_NEEDLES, MOST_PARTS = 200_000, 16


def disclosures(instructions: DataFrame, texts: DataFrame, i_key: str, t_key: str, i_text: str = "text", t_text: str = "text", window: int = 12, part_needles: int = PART_NEEDLES) -> DataFrame:
    """Pairs (i_key, t_key) in which a text contains the whole instruction or any window of its words.

    A needle is a window, or an instruction of fewer words. Up to MOST_PARTS times part_needles needles are dealt over
    automata (functions.phrases), each broadcast, and each text goes through each automaton once: work is linear in
    the texts, and only what was found leaves the tasks. Beyond that needles meet texts by an equi-join, see joined_disclosures().
    """
    needles = _needles(instructions, i_key, i_text, window)
    txt = _bodies(texts, t_key, t_text)
    total = needles.count()
    parts = -(-total // part_needles)
    if parts > MOST_PARTS:
        return joined_disclosures(instructions, texts, i_key, t_key, i_text, t_text, window)
    kind = needles.schema[i_key].dataType
    schema = StructType([texts.schema[t_key], StructField(i_key, ArrayType(kind))])
    found = txt.limit(0).select(F.lit(None).cast(kind).alias(i_key), t_key)
    for p in range(parts):
        rows = needles.where(F.pmod(F.xxhash64("needle"), F.lit(parts)) == p).select("needle", i_key).collect()  # about part_needles, a configuration
        index = spark_index(needles.sparkSession, [(r[0], r[1]) for r in rows])

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            find = index().find
            for batch in batches:
                keys = [list(find(b)) if b else [] for b in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.list_(to_arrow_type(kind)))], names=[t_key, i_key])

        hits = txt.select(t_key, "body").mapInArrow(run, schema).where(F.size(i_key) > 0)
        found = found.union(hits.select(F.explode(i_key).alias(i_key), t_key))
    return found.distinct()


def spark_index(spark: SparkSession, pairs: list[tuple]):
    """A function that gives the PhraseIndex of the pairs in any task; a worker builds it once."""
    shared, name = spark.sparkContext.broadcast(pairs), uuid.uuid4().hex

    def index() -> PhraseIndex:
        known = phrases.__dict__.setdefault("_built", {})
        if name not in known:
            known.clear()  # a worker serves one search at a time
            known[name] = PhraseIndex(shared.value)
        return known[name]

    return index


def _needles(instructions: DataFrame, i_key: str, i_text: str, window: int) -> DataFrame:
    """(i_key, needle) of the instructions, each once."""
    ins = instructions.select(i_key, norm_ws(F.col(i_text), lower=True).alias("norm")).where("norm <> ''").withColumn("ws", F.split("norm", " "))
    return ins.select(i_key, F.explode(F.when(F.size("ws") >= window, _word_runs(F.col("ws"), window)).otherwise(F.array("norm"))).alias("needle")).distinct()


def _bodies(texts: DataFrame, t_key: str, t_text: str) -> DataFrame:
    return texts.select(t_key, norm_ws(strip_tags(F.col(t_text)), lower=True).alias("body"))


def _let(value: Column, body) -> Column:
    """body of a value that is worked out once, not again wherever the body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def _word_runs(ws: Column, n: int) -> Column:
    """All runs of n words, or all words where there are fewer; ws is bound outside the loop."""
    return _let(ws, lambda x: F.transform(F.sequence(F.lit(1), F.greatest(F.size(x) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(x, i, n), " ")))


def joined_disclosures(instructions: DataFrame, texts: DataFrame, i_key: str, t_key: str, i_text: str = "text", t_text: str = "text", window: int = 12) -> DataFrame:
    """disclosures() for any number of needles, by an equi-join.

    Needles meet texts on the hash of the words between their ends; needles of one or two words, which have none
    between, meet by the shortest run of characters that any text with them must hold: each distinct word of a text
    is cut into its runs of GRAM characters. What meets is verified. Needles shorter than that are compared with
    every text that has their first character.
    """
    txt = _bodies(texts, t_key, t_text)
    needles = _needles(instructions, i_key, i_text, window).withColumn("n", F.size(F.split("needle", " ")))
    inner = F.xxhash64("n", F.array_join(F.slice(F.split("needle", " "), 2, F.greatest(F.col("n") - 2, F.lit(0))), " "))
    tokens = lambda s: F.transform(F.sequence(F.lit(1), F.length(s) - GRAM + 1), lambda i: F.xxhash64(F.lit(0), F.substring(s, i, GRAM)))
    longest = lambda c: F.array_max(F.transform(F.split(c, " "), lambda w: F.struct(F.length(w).alias("l"), w.alias("w"))))["w"]
    part = F.when(F.col("n") > 2, inner).when(F.length(longest("needle")) >= GRAM, F.xxhash64(F.lit(0), F.left(longest("needle"), F.lit(GRAM))))
    needles = needles.select(i_key, "needle", "n", part.alias("h"))
    lengths = sorted(r[0] for r in needles.where("n > 2").select("n").distinct().collect())  # at most `window`
    few = needles.where("n <= 2 AND h IS NOT NULL").limit(1).count() > 0

    ws = F.split("body", " ")
    hashed = lambda n: F.transform(_word_runs(ws, n - 2), lambda r: F.xxhash64(F.lit(n), r))
    keys = [F.when(F.size(ws) >= n, hashed(n)).otherwise(F.array().cast("array<bigint>")) for n in lengths]
    grams = F.flatten(F.transform(F.filter(F.array_distinct(ws), lambda w: F.length(w) >= GRAM), tokens))
    keys += [grams] if few else []
    pairs = []
    if keys:
        met = txt.select(t_key, F.explode(F.array_distinct(F.concat(*keys))).alias("h"))
        pairs.append(met.join(needles.where("h IS NOT NULL").select(i_key, "needle", "h").hint("merge"), "h").select(i_key, t_key, "needle").distinct())
    tiny = needles.where("h IS NULL").select(i_key, "needle")
    letters = F.array_distinct(F.flatten(F.transform(F.array_distinct(ws), lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.substring(w, i, 1)))))
    if tiny.limit(1).count():
        pairs.append(txt.select(t_key, F.explode(letters).alias("c")).join(tiny.withColumn("c", F.left("needle", F.lit(1))).hint("merge"), "c").select(i_key, t_key, "needle").distinct())
    if not pairs:
        return txt.limit(0).select(F.lit(None).cast(needles.schema[i_key].dataType).alias(i_key), t_key)
    pairs = functools.reduce(DataFrame.union, pairs)
    return pairs.join(txt.hint("merge"), t_key).where(F.contains("body", "needle")).select(i_key, t_key).distinct()


def page_match(text: Column, expected: Column, client: bool = False) -> dict[str, Column]:
    """exact, normalised, folded and offset of expected in a page's text; client: the variant that folds on
    normalised text and reports an offset for a case-insensitive hit too."""
    exact = F.contains(text, expected) & (expected != "")
    normalised = (norm_ws(expected) != "") & F.contains(norm_ws(text), norm_ws(expected))
    if client:
        folded = (norm_ws(expected) != "") & F.contains(norm_ws(text, True), norm_ws(expected, True))
        offset = F.when(exact, F.call_function("locate", expected, text) - 1).when(F.contains(F.lower(text), F.lower(expected)), F.call_function("locate", F.lower(expected), F.lower(text)) - 1)
    else:
        folded = (expected != "") & F.contains(F.lower(text), F.lower(expected))
        offset = F.when(exact, F.call_function("locate", expected, text) - 1)
    return {"exact": exact, "normalised": normalised, "folded": folded, "offset": offset}


def notice_outcome(matched: Column, total: Column) -> Column:
    return F.when((total == 0) | (matched == 0), "not_surfaced").when(matched == total, "surfaced").otherwise("partial")


#: Words too common to carry a signal.
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "before", "but", "by", "do", "for", "from", "have", "he", "her", "his", "in", "is", "it", "its", "not",
    "of", "on", "or", "please", "she", "should", "that", "the", "their", "them", "then", "there", "they", "this", "to", "up", "use", "using", "was", "we", "were", "with", "you", "your",
)


def salient_terms(text: Column, most: int = 4) -> Column:
    """First distinct words of four letters or more that are not stop words, in order."""
    words = F.transform(F.split(F.lower(text), "[^a-z0-9'-]+"), lambda w: F.regexp_replace(w, "^['-]+|['-]+$", ""))
    stop = F.array(*map(F.lit, STOP_WORDS))
    return F.slice(F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 4) & ~F.array_contains(stop, w))), 1, most)


def derived_signals(rows: DataFrame, response: str, key: str, keep: list[str]) -> DataFrame:
    """keep, idx, type, value, case_sensitive, terms: signals of a notice's response sentence and key."""
    r, k = trim_ws(F.col(response)), trim_ws(F.coalesce(F.col(key), F.lit("")))
    terms = salient_terms(r)
    none = F.array().cast("array<string>")
    entry = lambda t, v, cs, ts: F.struct(F.lit(t).alias("type"), v.alias("value"), F.lit(cs).alias("case_sensitive"), ts.alias("terms"))
    wanted = F.array(
        F.when(r != "", entry("exact_phrase", r, False, none)),
        F.when((r != "") & (F.size(terms) >= 2), entry("ordered_terms", F.lit(""), False, terms)),
        F.when(k != "", entry("exact_phrase", k, True, none)),
    )
    return rows.select(*keep, F.posexplode(F.filter(wanted, lambda x: x.isNotNull())).alias("idx", "s")).select(*keep, "idx", "s.*")


def new_signals(have: DataFrame, more: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Rows of `more` whose type and normalised value are not in `have`, first of equal ones by idx."""
    fold = norm_ws(F.col(value), lower=True)
    fresh = more.withColumn("_k", fold).join(have.select(*keys, "type", fold.alias("_k")).distinct(), [*keys, "type", "_k"], "left_anti")
    first = Window.partitionBy(*keys, "type", "_k").orderBy("idx")
    return fresh.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n", "_k")


def _carried(rows: DataFrame, key: str, value: Column, name: str) -> DataFrame:
    """rows(key, _part) with `name`: value, an aggregate, of the parts of the key that lie before the row's own."""
    each = rows.groupBy(key, "_part").agg(value.alias("_v"))
    before = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    total = {"max": F.max, "sum": F.sum}["sum" if name == "_islands" else "max"]
    each = each.select(F.col(key).alias("_k"), F.col("_part").alias("_p"), total("_v").over(before).alias(name))  # a row a key and part
    return rows.join(each.hint("merge"), rows[key].eqNullSafe(each["_k"]) & (rows["_part"] == each["_p"])).drop("_k", "_p")


#: Spans of a key that one task puts in order; those of larger keys are many tasks' work.
MOST_OF_KEY = 100_000
#: Texts that one task sorts, about.
TEXT_ROWS = 1 << 16


def _by_size(rows: DataFrame, key: str, most: int) -> tuple[DataFrame, DataFrame | None]:
    """(rows of keys with at most `most` rows, the others or None), of a written table."""
    large = rows.groupBy(F.col(key).alias("_k")).count().where(F.col("count") > most).select("_k")
    n = large.count()
    if not n:
        return rows, None
    same, large = F.col(key).eqNullSafe(F.col("_k")), small(large)
    return rows.join(large, same, "left_anti"), rows.join(large, same, "left_semi")


def merge_spans(spans: DataFrame, key: str, limit: str | None = None, parts: int | None = None) -> DataFrame:
    """(key, start, end): spans clamped to [0, limit], invalid ones dropped, overlapping or touching ones merged.

    Keys are dealt over parts of bounded size and scanned. Keys of over MOST_OF_KEY spans take a scan in two passes over ranges
    of start, so that the spans of one key are many tasks' work: each part's reach is carried to the parts behind it, then spans that
    begin beyond all reach open an island, and the parts' numbers of islands are carried likewise.
    """
    start = F.greatest(F.col("start"), F.lit(0))
    end = F.least(F.col("end"), F.col(limit)) if limit else F.col("end")
    rows = spans.select(key, start.alias("start"), end.alias("end")).where("start < end")
    rows, large = _by_size(written(rows, "spans"), key, MOST_OF_KEY)
    order = Window.partitionBy(key).orderBy("start", "end")
    rows = dealt(rows, parts_for(rows.count(), rows.sparkSession), key)
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_new", F.when(reach.isNull() | (F.col("start") > reach), 1).otherwise(0))
    rows = rows.withColumn("island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = rows.groupBy(key, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")
    return merged if large is None else merged.union(_merge_large(large, key, parts))


def _merge_large(rows: DataFrame, key: str, parts: int | None) -> DataFrame:
    """merge_spans() of checked spans, by ranges of start."""
    rows = written(rows.groupBy(key, "start").agg(F.max("end").alias("end")), "spans")
    rows = rows.withColumn("_part", part_of(F.col("start"), bounds_of(rows, "start", parts)))
    within = Window.partitionBy(key, "_part").orderBy("start")
    rows = _carried(rows, key, F.max("end"), "_reach")
    reach = F.greatest("_reach", F.max("end").over(within.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("_new", F.when(reach.isNull() | (F.col("start") > reach), 1).otherwise(0))
    rows = _carried(written(rows.select(key, "start", "end", "_part", "_new"), "spans"), key, F.sum("_new"), "_islands")
    island = F.coalesce("_islands", F.lit(0)) + F.sum("_new").over(within.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("island", island).groupBy(key, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def segments(texts: DataFrame, merged: DataFrame, key: str, text_col: str = "text", parts: int | None = None) -> DataFrame:
    """(key, start, text, highlighted): the pieces of each text in and between its merged spans, which are put in order by key;
    those of keys with over MOST_OF_KEY spans within ranges of start, each range with the end of what lies before it."""
    merged = written(merged.select(key, "start", "end"), "spans")
    spark = merged.sparkSession
    n_parts = max(parts_for(merged.count(), spark), parts_for(texts.count(), spark, TEXT_ROWS))
    texts = dealt(texts, n_parts, key)
    n = texts.select(key, F.length(text_col).alias("n"))
    rows, large = _by_size(merged, key, MOST_OF_KEY)
    rows = dealt(rows, n_parts, key).withColumn("prev", F.coalesce(F.lag("end").over(Window.partitionBy(key).orderBy("start")), F.lit(0)))
    if large is not None:
        large = large.withColumn("_part", part_of(F.col("start"), bounds_of(large, "start", parts)))
        within = Window.partitionBy(key, "_part").orderBy("start")
        large = _carried(large, key, F.max("end"), "_reach").withColumn("prev", F.coalesce(F.lag("end").over(within), "_reach", F.lit(0)))
        rows = rows.unionByName(large.select(rows.columns))
    marked = rows.select(key, "start", "end", F.lit(True).alias("highlighted"))
    gaps = rows.select(key, F.col("prev").alias("start"), F.col("start").alias("end"), F.lit(False).alias("highlighted"))
    ends = merged.groupBy(key).agg(F.max("end").alias("start"))
    tail = n.join(ends.hint("merge"), key, "left").select(key, F.coalesce("start", F.lit(0)).alias("start"), F.col("n").alias("end"), F.lit(False).alias("highlighted"))
    cuts = dealt(marked.union(gaps).union(tail).where("start < end"), n_parts, key)
    return cuts.join(texts.select(key, F.col(text_col).alias("_t")).hint("merge"), key).select(key, "start", F.substring("_t", F.col("start") + 1, F.col("end") - F.col("start")).alias("text"), "highlighted")
