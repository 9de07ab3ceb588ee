"""Queries that run as streams over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.order import small
from ..operators import signals as M
from ..streaming import streams as Z
from ..streaming.cells import cell_updates
from ..streaming.families import FamilyTests
from .registry import query, read
from .signal_queries import _MATCHES, SIGNALS, _fisher, _holm


_COMPARE_LANG = f"""{_MATCHES}, ab AS (SELECT lang, idx, count(*) FILTER (label = 'candidate' AND m) AS a, count(*) FILTER (label = 'candidate' AND NOT m) AS b,
    count(*) FILTER (label = 'baseline' AND m) AS c, count(*) FILTER (label = 'baseline' AND NOT m) AS d FROM matches GROUP BY lang, idx),
    fp AS (SELECT *, CASE WHEN a + b > 0 AND c + d > 0 THEN {_fisher('a', 'b', 'c', 'd', 12)} END AS p FROM ab)"""


def _stream(spark, d, table):
    """The table's files as a stream; a glob, as a plain path must be a folder."""
    return spark.readStream.schema(read(spark, d, table).schema).parquet(f"{d}/{table}.parque[t]")


@query("""SELECT doc_id, 0 AS idx, contains(text, 'the') AS matched FROM documents UNION ALL SELECT doc_id, 1, regexp_matches(text, '[A-Z]{3,}|[#*$%&]{3}') FROM documents""")
def stream_match(spark, d):
    rows = Z.stream_match(_stream(spark, d, "documents"), M.signal_frame(spark, SIGNALS[:2]), ["doc_id"])
    return Z.drain(rows.select("doc_id", "idx", "matched"))


@query("SELECT event_type, count(*) AS responses, count(*) FILTER (value > 20) AS incomplete, sum(user_id)::BIGINT AS tokens FROM events GROUP BY event_type")
def stream_cells(spark, d):
    rows = _stream(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp")).withColumn("incomplete", F.col("value") > 20).withColumn("new_tokens", F.col("user_id"))
    return Z.drain_totals(Z.stream_cells(rows, ["event_type"], "event_id", "at", "400 days"))


@query("""WITH e AS (SELECT event_type, ts, event_id, value > 20 AS incomplete, user_id, (event_id % 3)::VARCHAR AS label FROM events WHERE event_id IS NOT NULL AND ts IS NOT NULL),
    l AS (SELECT event_type, string_agg(label || '=' || n, ',' ORDER BY label) AS labels FROM (SELECT event_type, label, count(*) AS n FROM e GROUP BY ALL) GROUP BY event_type)
    SELECT event_type, count(*) AS responses, count(*) FILTER (incomplete) AS incomplete, sum(user_id)::BIGINT AS tokens, 2 * count(*) AS received, 0 AS late, labels FROM e JOIN l USING (event_type) GROUP BY event_type, labels""")
def stream_revisions(spark, d):
    """Every event comes twice: first incomplete and without tokens, then as it is, a second later."""
    rows = _stream(spark, d, "events").select("event_type", "event_id", F.col("ts").cast("timestamp").alias("at"), (F.col("value") > 20).alias("incomplete"), F.col("user_id").alias("new_tokens"), (F.col("event_id") % 3).cast("string").alias("label"))
    draft = F.struct("event_type", "event_id", "at", F.lit(True).alias("incomplete"), F.lit(0).cast("long").alias("new_tokens"), F.lit("draft").alias("label"))
    final = F.struct("event_type", "event_id", (F.col("at") + F.expr("INTERVAL 1 SECOND")).alias("at"), "incomplete", "new_tokens", "label")
    both = rows.select(F.explode(F.array(final, draft)).alias("r")).select("r.*")
    totals = Z.drain_cells(cell_updates(both, ["event_type"], "event_id", "at", "label"), ["event_type"])
    labels = F.array_join(F.transform(F.sort_array(F.map_entries("labels")), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")
    return totals.withColumn("labels", labels)


@query(f"WITH {_COMPARE_LANG} SELECT lang, idx, a, b, c, d, round(p, 7) AS fisher_p, round(adjusted_p, 6) AS adjusted_p FROM ({_holm('(SELECT * FROM fp WHERE p IS NOT NULL)', 'lang', 'p')}) UNION ALL SELECT lang, idx, a, b, c, d, NULL, NULL FROM fp WHERE p IS NULL")
def stream_families(spark, d):
    """compare_rates() by language over documents that come as a stream."""
    marks = read(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 1, "baseline").otherwise("candidate").alias("label"))
    texts = _stream(spark, d, "documents").join(small(marks), "doc_id")
    tests = FamilyTests(spark, Z.shared_folder(spark, "families"), ["lang"])
    Z.drain_batches(M.match_signals(texts, M.signal_frame(spark, SIGNALS), ["doc_id", "lang", "label"]), tests.apply)
    return tests.results().select("lang", "idx", "a", "b", "c", "d", F.round("fisher_p", 7).alias("fisher_p"), F.round("adjusted_p", 6).alias("adjusted_p"))
