"""Work that must grow with the text, and results of the short cuts that keep it so."""

import random
import time

import pytest
from pyspark.sql import functions as F

from evidencelake.functions.edits import edit_distance
from evidencelake.functions.textsem import EDGE, WS, WS_CHARS, WS_RARE, quoted
from evidencelake.operators import perturb, signals


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_a_text_without_some_of_its_symbols_takes_one_pass():
    text = "".join(random.Random(1).choices("abcdefgh", k=400_000))
    left = text.replace("ab", "")
    began = time.perf_counter()
    assert edit_distance(text, left) == edit_distance(left, text) == len(text) - len(left)
    assert time.perf_counter() - began < 3  # a table of columns takes minutes


def test_running_sums_read_their_numbers_once(spark):
    @F.udf("array<int>")
    def ones(n):
        calls.add(1)
        return [1] * n

    calls = spark.sparkContext.accumulator(0)
    got = spark.range(1).select(F.lit(5000).alias("n")).repartition(1).select(signals.running_sums(ones("n")).alias("v")).first()["v"]
    assert got == list(range(1, 5001)) and calls.value == 1


@pytest.mark.parametrize("n", [1, 15, 16, 17, 256, 257, 5000])
def test_running_sums_at_the_parts_ends(spark, n):
    assert one(spark, signals.running_sums(F.sequence(F.lit(1), F.lit(n)))) == [i * (i + 1) // 2 for i in range(1, n + 1)]


def test_labels_of_any_edge_match_as_with_the_plain_boundary(spark):
    texts = ["shed", "a shed.", "washed", "shed_", "ſhed", "xſhed", "shedé", "éshed", "SHED", "(a)", "x(a)y", " (a) ", "ét", "xét", "aét b", "le \t la", "le la2", "le la", ""]
    for term in ("shed", "(a)", "ét", "le la", "_x", "la-"):
        plain = f"(?iu){EDGE}{f'{WS}+'.join(quoted(p) for p in term.split())}{EDGE}"
        rows = spark.createDataFrame([(t + s,) for t in texts for s in ("", " _x", "x la-", " la- b")], "t string")
        got = rows.select(F.rlike("t", F.lit(plain)).alias("a"), F.rlike("t", F.lit(signals.label_pattern(term))).alias("b")).collect()
        assert [r["a"] for r in got] == [r["b"] for r in got]


def test_white_space_written_in_three_ways_is_the_same(spark):
    chars = spark.createDataFrame([(chr(i),) for i in range(0x10000) if not 0xD800 <= i < 0xE000] + [("\U0001f600",)], "c string")
    rows = chars.where(~(F.rlike("c", F.lit(WS)).eqNullSafe(F.rlike("c", F.lit(WS_RARE))) & F.rlike("c", F.lit(WS)).eqNullSafe(F.contains(F.lit(WS_CHARS), "c"))))
    assert rows.count() == 0


def test_headings_and_synonyms_at_their_quick_tests_edges(spark):
    lines = ["# a", "#  ", "####### x", "1) b", "12. c", "x1. c", "ABC\r", "  A  ", "Aa", "7", "name:\r", ": ", "a:b", "n: \r\r", "", "ÄB"]
    heads = one(spark, signals.heading_list(F.lit("\n".join(lines))))
    assert [(h["text"], h["line_index"]) for h in heads] == [("a", 0), ("b", 3), ("c", 4), ("ABC", 6), ("A", 7), ("name", 10), ("n", 13), ("ÄB", 15)]
    assert one(spark, perturb.synonyms(F.lit("Novel, PRIOR Keen existing? Method"))) == "New, EARLIER Keen current? Technique"


@pytest.mark.parametrize("most, rows", [(100_000, 1 << 20), (3, 1 << 20), (100_000, 7), (3, 7)])
def test_spans_and_segments_in_bounded_parts(spark, monkeypatch, most, rows):
    """Small keys whole and large ones by ranges, in the session's parts and in more of them; null is a key as well."""
    r = random.Random(2)
    keys = ["a"] * 40 + ["b", "b", "c", None, None]
    spans = [(k, at := r.randrange(-3, 90), at + r.randrange(-1, 6), 80) for k in keys]
    monkeypatch.setattr(signals, "MOST_OF_KEY", most)
    monkeypatch.setattr(signals, "parts_for", lambda n, spark, part_rows=rows: max(4, -(-n // rows)))
    want = set()
    for k in set(keys):
        covered = sorted({i for key, s, e, n in spans if key == k for i in range(2 * max(s, 0), 2 * min(e, n) + 1) if max(s, 0) < min(e, n)})
        runs = [i for i in covered if i - 1 not in covered], [i for i in covered if i + 1 not in covered]
        want |= {(k, s // 2, e // 2) for s, e in zip(*runs, strict=True)}
    merged = signals.merge_spans(spark.createDataFrame(spans, "k string, start int, end int, n int"), "k", "n")
    assert {tuple(x) for x in merged.select("k", "start", "end").collect()} == want
    texts = {k: "".join(r.choices("xyz", k=85)) for k in "abcd"}
    out = signals.segments(spark.createDataFrame(list(texts.items()), "k string, text string"), merged.where("k IS NOT NULL"), "k").orderBy("k", "start").collect()
    assert {k: "".join(x["text"] for x in out if x["k"] == k) for k in texts} == texts
    assert {(x["k"], x["start"], x["start"] + len(x["text"])) for x in out if x["highlighted"]} == {x for x in want if x[0]}
