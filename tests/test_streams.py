"""Streams with late, repeated and revised rows, and batches that are sent again."""

from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import functions as F

from evidencelake.operators import scoring
from evidencelake.streaming import streams
from evidencelake.streaming.cells import CellState, cell_updates
from evidencelake.streaming.families import FamilyTests

T0 = datetime(2024, 5, 1, 12)
SCHEMA = "cell string, response_id string, at timestamp, incomplete boolean, new_tokens long, label string"


def row(cell, response, minutes, incomplete, tokens, label):
    return (cell, response, T0 + timedelta(minutes=minutes), incomplete, tokens, label)


def test_totals_follow_late_repeated_and_revised_rows(spark, tmp_path):
    batches = [
        [row("a", "1", 0, True, 5, "R0"), row("a", "2", 1, False, 7, "R1"), row("a", "2", 1, False, 7, "R1"), row(None, "9", 3, False, 1, None), row("a", None, 3, False, 1, "R0")],
        [row("a", "1", 30, False, 9, "R2"), row("a", "3", 90, False, 2, "R2"), row("b", "4", 0, None, None, "R0")],  # 1 is revised; the newest of a is 90 now
        [row("a", "5", 10, True, 100, "RX"), row("a", "2", 20, True, 100, "RX"), row("a", "3", 80, True, 50, "R0"), row("b", "4", -10, True, 3, "R1")],  # late, late, an older version, an older version
        [row("a", "3", 91, True, 4, "R1")],
    ]
    source, folder = tmp_path / "in", f"file://{tmp_path}/kept"
    seen = []
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(SCHEMA).parquet(str(source))
        out = streams.drain_cells(cell_updates(stream, ["cell"], label="label", delay=3600, buckets=1), ["cell"], folder)
        seen.append({r.cell: r for r in out.collect()})
    first, second, third, last = (s["a"] for s in seen)
    assert (first.responses, first.incomplete, first.tokens, first.received, first.late, first.labels) == (2, 1, 12, 3, 0, {"R0": 1, "R1": 1})
    assert (second.responses, second.incomplete, second.tokens, second.labels) == (3, 0, 18, {"R1": 1, "R2": 2})
    assert (third.responses, third.tokens, third.received, third.late) == (3, 18, 8, 2)
    assert (last.responses, last.incomplete, last.tokens, last.labels) == (3, 1, 20, {"R1": 2, "R2": 1})
    assert (seen[-1]["b"].responses, seen[-1]["b"].tokens, seen[-1]["b"].labels) == (1, 0, {"R0": 1})
    assert seen[0][None].responses == 1


def test_state_drops_what_nothing_can_replace():
    rows = pd.DataFrame({"response_id": ["x", "y"], "at": [1_000_000, 9_000_000], "incomplete": [False, True], "new_tokens": [1.0, None], "label": ["p", None]})
    held = CellState()
    held.take(rows, None)
    held.settle(5_000_000)
    assert list(held.versions) == ["y"] and held.totals["responses"] == 2
    again = CellState(held.stored())
    again.take(rows, again.bound(5_000_000))
    assert again.totals["late"] == 1 and again.totals["responses"] == 2 and again.labels == {"p": 1, "": 1}
    assert again.row(("c", 0), ["cell", "bucket"]).to_dict("records")[0]["received"] == 4


def matches(n, families):
    return [(families[i % len(families)], i % 4, "candidate" if i % 3 else "baseline", (i * 7 + i // 5) % (2 + i % 4) == 0) for i in range(n)]


def test_families_of_a_stream(spark, tmp_path):
    """What a batch touched equals the batch result over all rows so far; sending a batch again changes nothing."""
    schema, rows = "family string, idx int, label string, matched boolean", [matches(300, ["f", "g", None]), matches(90, ["g"]), matches(150, ["h", None])]
    tests, so_far = FamilyTests(spark, f"file://{tmp_path}/families", ["family"]), []
    plain = lambda df: sorted((str(r.family), r.idx, r.a, r.b, r.c, r.d, round(r.fisher_p or 0, 9), round(r.adjusted_p or 0, 9), r.significant) for r in df.collect())
    for n, part in enumerate(rows):
        batch = spark.createDataFrame(part, schema)
        so_far += part
        want = plain(scoring.compare_rates(spark.createDataFrame(so_far, schema), ["family"]))
        tests.apply(batch, n)
        assert plain(tests.results()) == want
        tests.apply(batch, n)
        assert plain(tests.results()) == want
    written = {r.batch: r.f for r in spark.read.parquet(f"{tmp_path}/families/results").groupBy("batch").agg(F.sort_array(F.collect_set(F.coalesce("family", F.lit("-")))).alias("f")).collect()}
    assert written == {0: ["-", "f", "g"], 1: ["g"], 2: ["-", "h"]}
    whole = FamilyTests(spark, f"file://{tmp_path}/whole", [])
    for n, part in enumerate(rows):
        whole.apply(spark.createDataFrame(part, schema), n)
    assert whole.results().count() == 4
