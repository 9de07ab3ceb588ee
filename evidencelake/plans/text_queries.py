"""Queries over texts: normalisation, tags, pages, lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.textsem import WS, norm_ws
from ..operators import textops as T
from .registry import query, read

_WS = WS


@query(f"SELECT doc_id, trim(regexp_replace(text, '{_WS}+', ' ', 'g')) AS norm, lower(trim(regexp_replace(text, '{_WS}+', ' ', 'g'))) AS folded FROM documents")
def norm_ws_texts(spark, d):
    return read(spark, d, "documents").select("doc_id", norm_ws(F.col("text")).alias("norm"), norm_ws(F.col("text"), True).alias("folded"))


@query(rf"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '(?m)[ \t]+$', '', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'),
    '^{_WS}+|{_WS}+$', '', 'g') AS prompt FROM documents""")
def norm_prompt(spark, d):
    return read(spark, d, "documents").select("doc_id", T.norm_prompt(F.col("text")).alias("prompt"))


def _tagged(spark, d):
    """Documents with a payload: the source's name as tags, framed for sources with an even length."""
    tags = "".join(chr(0xE0000 + i) for i in range(32, 127))
    hidden = F.translate("source", "".join(map(chr, range(32, 127))), tags)
    framed = F.concat(F.lit(T.TAG_BEGIN), hidden, F.lit(T.TAG_CANCEL))
    payload = F.when(F.col("lang") == "en", F.lit("")).when(F.length("source") % 2 == 0, framed).otherwise(hidden)
    return read(spark, d, "documents").select("doc_id", "source", "lang", F.concat(F.left("text", F.lit(20)), payload, F.substring("text", 21, 1 << 30)).alias("text"))


_TAGGED = f"""tagged AS (SELECT doc_id, source, lang, left(text, 20) ||
    CASE WHEN lang = 'en' THEN '' WHEN length(source) % 2 = 0 THEN chr({0xE0001}) || hid || chr({0xE007F}) ELSE hid END || substring(text, 21) AS text
    FROM (SELECT *, array_to_string(list_transform(string_split(source, ''), lambda c: chr({0xE0000} + unicode(c))), '') AS hid FROM documents))"""


@query(f"WITH {_TAGGED} SELECT doc_id, sha256(regexp_replace(text, '{T.TAG_BLOCK}', '', 'g')) AS stripped FROM tagged")
def tags_strip(spark, d):
    return _tagged(spark, d).select("doc_id", F.sha2(T.strip_tags(F.col("text")), 256).alias("stripped"))


@query(f"WITH {_TAGGED} SELECT doc_id, CASE WHEN lang = 'en' THEN '' ELSE source END AS decoded FROM tagged")
def tags_decode(spark, d):
    return _tagged(spark, d).select("doc_id", F.array_join(T.decode_tags(F.col("text")), "|").alias("decoded"))


@query(f"WITH {_TAGGED} SELECT doc_id, length(text) - length(regexp_replace(text, '{T.TAG_BLOCK}', '', 'g')) AS n_tags FROM tagged WHERE regexp_matches(text, '{T.TAG_PAYLOAD}')")
def tags_scan(spark, d):
    return T.scan_tags(_tagged(spark, d)).select("doc_id", "n_tags")


@query("""WITH r AS (SELECT doc_id, (n_chars // 1500)::INT AS n, CASE lang WHEN 'en' THEN 'all' WHEN 'fr' THEN 'last' WHEN 'de' THEN 'first' ELSE '3' END AS t FROM documents)
    SELECT doc_id, p::INT AS page_index, CASE WHEN p IS NULL THEN 'page out of range' END AS error
    FROM (SELECT doc_id, unnest(CASE WHEN n < 1 THEN [NULL] WHEN t = 'first' THEN [0] WHEN t = 'last' THEN [n - 1] WHEN t = 'all' THEN range(0, n) WHEN n >= 3 THEN [2] ELSE [NULL] END) AS p FROM r)""")
def page_targets(spark, d):
    target = F.when(F.col("lang") == "en", "all").when(F.col("lang") == "fr", "last").when(F.col("lang") == "de", "first").otherwise("3")
    rows = read(spark, d, "documents").select("doc_id", F.floor(F.col("n_chars") / 1500).cast("int").alias("n_pages"), target.alias("target"))
    return T.page_targets(rows).select("doc_id", "page_index", "error")


@query("SELECT user_id AS job_id, count(*) AS n, min(ts) AS first_ts, max_by(event_id, event_id) AS last_id FROM events GROUP BY user_id")
def by_job(spark, d):
    return read(spark, d, "events").groupBy(F.col("user_id").alias("job_id")).agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("event_id").alias("last_id"))


@query(f"""SELECT source, doc_id, nth FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS nth FROM documents
    WHERE regexp_replace(text, '{_WS}+', '', 'g') <> '') WHERE nth <= 20""")
def nonblank_cap(spark, d):
    return T.nonblank_top(read(spark, d, "documents"), "source", ["doc_id"], 20).select("source", "doc_id", "nth")


@query("""SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN trim(coalesce(v, '')) = '' WHEN p_partkey % 4 = 1 THEN trim(v) = '' ELSE len(list_filter([v, p_type], lambda x: trim(x) = '')) > 0 END AS blank
    FROM (SELECT *, CASE WHEN p_size % 7 = 0 THEN '  ' ELSE p_name END AS v FROM part)""")
def eligible_signals(spark, d):
    k = F.col("p_partkey") % 4
    type_ = F.when(k == 0, "exact_phrase").when(k == 1, "regex").otherwise("ordered_terms")
    v = F.when(F.col("p_size") % 7 == 0, "  ").otherwise(F.col("p_name"))
    return read(spark, d, "part").select("p_partkey", T.blank_signal(type_, v, v, F.array(v, F.col("p_type"))).alias("blank"))
