"""Queries of perturbation and survival, sources and sinks, and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scratch import shared_folder, written
from ..functions.textsem import WS
from ..operators import perturb as T
from ..operators import signals as M
from ..sources import io as S
from .registry import query, read
from .signal_queries import _MATCHES, SIGNALS, _matches, documents, labelled

_TRIM = lambda c: f"regexp_replace({c}, '^{WS}+|{WS}+$', '', 'g')"
_SENT = f"list_filter(list_transform(string_split(regexp_replace(text, '([.!?]){WS}+', '\\1' || chr(2), 'g'), chr(2)), lambda s: regexp_replace(s, '^{WS}+|{WS}+$', '', 'g')), lambda s: s <> '')"


@query(f"SELECT doc_id, len(s) AS n, sha256(array_to_string(s, chr(1))) AS digest FROM (SELECT doc_id, {_SENT} AS s FROM documents)")
def sentences(spark, d):
    rows = read(spark, d, "documents").select("doc_id", T.sentences(F.col("text")).alias("s"))
    return rows.select("doc_id", F.size("s").cast("long").alias("n"), F.sha2(F.array_join("s", "\x01"), 256).alias("digest"))


@query()
def human_edit(spark, d):
    edited = T.human_edit(F.col("text"), F.col("doc_id").cast("string"), F.array(F.lit("the"), F.lit("of")))
    rows = documents(spark, d).select("doc_id", edited.alias("edited"))
    return rows.select("doc_id", F.sha2("edited", 256).alias("digest"), F.length("edited").alias("n"))


_WORDS = "regexp_extract_all(text, '\\p{L}[\\p{L}''-]*|[^\\p{L}]+')"
_TABLE = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in T.SYNONYMS.items()) + "}"


@query(f"""WITH t AS (SELECT doc_id, 'However, the Method of ANALYZING ' || text || ' is robust' AS text FROM documents), m AS (SELECT {_TABLE} AS tab)
    SELECT doc_id, array_to_string(list_transform({_WORDS}, lambda w: CASE WHEN tab[lower(w)] IS NULL THEN w WHEN w = upper(w) AND w <> lower(w) THEN upper(tab[lower(w)])
      WHEN left(w, 1) = upper(left(w, 1)) AND substring(w, 2) = lower(substring(w, 2)) THEN upper(left(tab[lower(w)], 1)) || substring(tab[lower(w)], 2) ELSE tab[lower(w)] END), '') AS out FROM t, m""")
def synonyms(spark, d):
    text = F.concat(F.lit("However, the Method of ANALYZING "), F.col("text"), F.lit(" is robust"))
    return read(spark, d, "documents").select("doc_id", T.synonyms(text).alias("out"))


@query("""WITH s AS (SELECT item_id, text, strpos(text, ', ') AS p FROM benchmark), r AS (SELECT item_id, text, p, left(text, p - 1) AS a, substring(text, p + 2) AS b FROM s)
    SELECT item_id, CASE WHEN p < 2 OR b = '' OR item_id % 2 = 0 THEN text ELSE upper(left(x, 1)) || substring(x, 2) || ', ' || lower(left(a, 1)) || substring(a, 2) || e END AS out
    FROM (SELECT *, CASE WHEN regexp_matches(b, '[.!?]$') THEN b[:-2] ELSE b END AS x, CASE WHEN regexp_matches(b, '[.!?]$') THEN b[-1] ELSE '' END AS e FROM r)""")
def clause_swap(spark, d):
    coin = F.when(F.col("item_id") % 2 == 0, 0.1).otherwise(0.9)
    return read(spark, d, "benchmark").select("item_id", T.clause_swap(F.col("text"), coin).alias("out"))


@query()
def paraphrase(spark, d):
    return documents(spark, d).select("doc_id", F.sha2(T.paraphrase(F.col("text"), F.col("doc_id").cast("string")), 256).alias("digest"))


def _survival(spark, d):
    before = M.match_counts(_matches(spark, d), ["doc_id"])
    swap = {"swap": T.column_transform(lambda t, seed: F.replace(t, F.lit("of"), F.lit("fo")), seeded=False), "identity": T.column_transform(lambda t, seed: t, seeded=False), "translate": None}
    return T.survival_of(labelled(spark, d).select("doc_id", "text"), swap, 2, "doc_id", M.signal_frame(spark, SIGNALS), before)


_AFTER = f"""{_MATCHES}, swapped AS (SELECT doc_id, contains(replace(text, 'of', 'fo'), 'the')::INT + regexp_matches(replace(text, 'of', 'fo'), '[A-Z]{{3,}}|[#*$%&]{{3}}')::INT + regexp_matches(replace(text, 'of', 'fo'), '(?i)\\b(shed|thing|le{WS}+la)\\b')::INT
      + regexp_matches(lower(replace(text, 'of', 'fo')), '(?s)the.*of.*tion')::INT + coalesce(regexp_matches(hs, '(?s)die[^\\n]*\\n.*ung'), false)::INT AS n FROM texts LEFT JOIN joined USING (doc_id)),
    surv AS (SELECT doc_id, 'identity' AS transform, matched_count AS b, matched_count AS a FROM counts UNION ALL SELECT doc_id, 'swap', matched_count, n FROM counts JOIN swapped USING (doc_id))"""


@query(f"WITH {_AFTER} SELECT doc_id, transform, r AS repeat, b AS matched_before, a AS matched_after, b = 5 AS all_before, a = 5 AS all_after FROM surv, (VALUES (1), (2)) x(r)")
def survival(spark, d):
    return _survival(spark, d)


@query(f"WITH {_AFTER} SELECT transform, count(*) * 2 AS samples, avg((a = 5)::INT) AS survival_rate FROM surv GROUP BY transform")
def survival_rate(spark, d):
    return T.survival_rate(_survival(spark, d), ["transform"])


def title_words(text: str, seed: str) -> str:
    """A transform as a user would plug it in; it refuses texts of one word."""
    if len(text.split()) < 2:
        raise ValueError("one word")
    return text.title()


@query()
def transform_grid(spark, d):
    protected = F.array().cast("array<string>")
    grid = T.transform_grid(documents(spark, d), {"human_edit": lambda t, s: T.human_edit(t, s, protected), "paraphrase": T.paraphrase, "plugged": T.python_transform(title_words, seeded=False), "translate": None}, 3, "doc_id")
    return grid.select("doc_id", "transform", "repeat", "available", F.sha2("text", 256).alias("digest"), "error")


@query()
def error_rates(spark, d):
    rows = documents(spark, d).select("doc_id", "text", F.regexp_replace("text", "th|de ", "").alias("read"))
    return T.error_rates(rows, ["doc_id"], "text", "read")


@query(f"""WITH {_AFTER}, s AS (SELECT lang, transform, avg((a = 5)::INT) AS r FROM surv JOIN counts USING (doc_id) GROUP BY ALL), u AS (SELECT lang, transform, transform || ': ' || printf('%.0f', round(r * 100)) || '% survived' AS t FROM s UNION ALL SELECT DISTINCT lang, 'translate', 'translate: not available' FROM s)
    SELECT lang, string_agg(t, '; ' ORDER BY transform) AS text FROM u GROUP BY lang""")
def survival_text(spark, d):
    rows = _survival(spark, d).join(read(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    rates = written(T.survival_rate(rows, ["lang", "transform"]).drop("samples"), "rates")
    none = rates.select("lang").distinct().select("lang", F.lit("translate").alias("transform"), F.lit(None).cast("double").alias("survival_rate"))
    return T.survival_text(rates.unionByName(none), "lang")


@query("SELECT doc_id, coalesce(text, '') AS text, source FROM documents")
def src_submissions(spark, d):
    return read(spark, d, "documents").select("doc_id", F.decode(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), "UTF-8").alias("text"), "source")


@query("""SELECT page_id, CASE page_id % 4 WHEN 3 THEN 'text' WHEN 0 THEN 'pdf' WHEN 1 THEN 'png' END AS kind, CASE WHEN page_id % 4 = 2 THEN 'unknown extension' WHEN page_id % 4 < 2 AND NOT (page_id % 8 = 0) THEN 'content does not match extension' END AS error FROM pages""")
def src_sniff(spark, d):
    k = F.col("page_id") % 4
    ext = F.when(k == 0, "PDF").when(k == 1, "png").when(k == 2, "exe").otherwise("txt")
    body = F.encode(F.when(F.col("page_id") % 8 == 0, F.concat(F.lit("%PDF-1.7 "), "html")).otherwise(F.col("html")), "UTF-8")
    files = read(spark, d, "pages").select("page_id", F.concat(F.lit("/in/"), F.col("page_id"), F.lit("."), ext).alias("path"), body.alias("content"))
    return S.sniff(files).select("page_id", "kind", "error")


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 0 WHEN event_id % 3 = 1 THEN 2 ELSE 1 END AS n, CASE WHEN event_id % 3 = 0 THEN 'malformed' WHEN event_id % 3 = 1 AND event_id % 2 = 0 THEN 'duplicate label' WHEN event_id % 3 = 2 AND event_id % 5 = 0 THEN 'missing type' END AS error FROM events""")
def src_signals_json(spark, d):
    one = lambda label, kind: F.to_json(F.array(F.struct(F.lit(label).alias("label"), kind.alias("type"), F.col("props").alias("value"))))
    k, e = F.col("event_id") % 3, F.col("event_id")
    two = F.to_json(F.array(F.struct(F.lit("a").alias("label"), F.lit("regex").alias("type")), F.struct(F.when(e % 2 == 0, "a").otherwise("b").alias("label"), F.lit("regex").alias("type"))))
    text = F.when(k == 0, F.concat(F.lit("["), "props")).when(k == 1, two).otherwise(one("x", F.when(e % 5 != 0, F.col("event_type"))))
    return S.parse_signals(read(spark, d, "events").select("event_id", text.alias("j")), "event_id", "j")


@query(f"""SELECT doc_id, id, min(i) - 1 AS first_at, count(*) AS times FROM (SELECT doc_id, regexp_replace(l, '^{WS}+|{WS}+$', '', 'g') AS id, i FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '\\r?\\n')) AS l, generate_subscripts(regexp_split_to_array(text, '\\r?\\n'), 1) AS i FROM documents)) WHERE id <> '' GROUP BY doc_id, id""")
def src_id_list(spark, d):
    return S.id_list(read(spark, d, "documents"), "doc_id", "text")


@query(f"""WITH l AS (SELECT doc_id, {_TRIM("unnest(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)))")} AS id FROM documents), c AS (SELECT doc_id, id, count(*) AS n FROM l GROUP BY doc_id, id)
    SELECT doc_id, count(*) FILTER (id <> '') AS n_ids, count(*) FILTER (id <> '' AND n > 1) AS n_duplicates, coalesce(sum(n) FILTER (id = ''), 0)::BIGINT AS n_blank FROM c GROUP BY doc_id""")
def src_id_counts(spark, d):
    return S.id_counts(read(spark, d, "documents"), "doc_id", "text")


@query("""SELECT CASE WHEN doc_id % 7 > 1 THEN doc_id END AS doc_id, CASE WHEN doc_id % 7 > 1 THEN sha256(text) END AS digest, count(*) AS n, CASE WHEN doc_id % 7 < 2 THEN 'not a record of this schema' END AS error FROM documents GROUP BY ALL""")
def src_errors(spark, d):
    """Every seventh line is cut off, every seventh has text for a number."""
    record = F.to_json(F.struct("doc_id", "text"))
    spoilt = F.when(F.col("doc_id") % 7 == 0, F.expr("left(line, length(line) - 3)")).when(F.col("doc_id") % 7 == 1, F.replace("line", F.lit('{"doc_id":'), F.lit('{"doc_id":"x",'[:-1] + ',"was":'))).otherwise(F.col("line"))
    folder = shared_folder(spark)
    read(spark, d, "documents").select("doc_id", record.alias("line")).select(spoilt.alias("value")).write.text(folder)
    rows = S.read_records(spark, folder, "doc_id long, text string")
    return rows.groupBy("doc_id", F.sha2("text", 256).alias("digest"), "error").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT item_id::VARCHAR AS id, CASE item_id % 2 WHEN 0 THEN 'policy' ELSE 'benign' END AS kind, text AS prompt, 1 AS n_required FROM benchmark")
def src_prompt_matrix(spark, d):
    case = F.struct(F.col("item_id").cast("string").alias("id"), F.when(F.col("item_id") % 2 == 0, "policy").otherwise("benign").alias("kind"), F.col("text").alias("prompt"), F.lit(None).cast("string").alias("expected"), F.array(F.lit("[a-z]")).alias("required_regex"))
    folder = shared_folder(spark)
    # case lists are configuration: files of some hundred cases, each one JSON array
    lists = read(spark, d, "benchmark").groupBy(F.floor(F.col("item_id") / 200).alias("part")).agg(F.to_json(F.sort_array(F.collect_list(case))).alias("value"))
    lists.write.partitionBy("part").text(folder)
    return S.read_cases(spark, folder).select("id", "kind", "prompt", F.size("required_regex").alias("n_required"))


@query("""WITH n AS (SELECT conv_id, count(*) AS n FROM conversations WHERE turn <> 5 GROUP BY conv_id), m AS (SELECT conv_id, count(*) AS expected FROM conversations GROUP BY conv_id) SELECT conv_id, expected, coalesce(n, 0) AS n, coalesce(n, 0) = expected AS ok FROM m LEFT JOIN n USING (conv_id)""")
def src_jsonl(spark, d):
    folder, turns = shared_folder(spark), read(spark, d, "conversations")
    turns.where("turn <> 5").write.json(folder)  # results of which some are missing
    rows = spark.read.schema("conv_id long, turn long, role string, text string").json(folder)
    return S.check_rows(rows, turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("expected")), "conv_id")


_CSV = lambda c: f"CASE WHEN regexp_matches({c}, '[\",\\r\\n]') THEN '\"' || replace({c}, '\"', '\"\"') || '\"' ELSE {c} END"


@query(f"""SELECT conv_id, turn, concat_ws(',', {_CSV('role')}, 'm' || conv_id, CASE WHEN turn % 2 = 0 THEN 'original' ELSE '"a,b"' END, turn, '', sha256(role), '', sha256(text), contains(text, 'the') AND contains(text, 'of'), contains(text, 'the') OR contains(text, 'of'),
      '', '', turn + 0.5, length(text), '', contains(text, 'the')::INT + contains(text, 'of')::INT, 2, '', '', {_CSV('text')}) AS line FROM conversations""")
def sink_results_csv(spark, d):
    has = lambda w: F.contains("text", F.lit(w))
    none = F.lit(None).cast("string")
    rows = read(spark, d, "conversations").select(
        "conv_id", "turn", F.col("role").alias("provider"), F.concat(F.lit("m"), "conv_id").alias("model_id"), F.when(F.col("turn") % 2 == 0, "original").otherwise("a,b").alias("condition"), F.col("turn").alias("repeat"),
        F.lit(None).cast("timestamp").alias("executed_at"), F.sha2("role", 256).alias("outer_prompt_sha256"), none.alias("pdf_sha256"), F.sha2("text", 256).alias("response_sha256"), (has("the") & has("of")).alias("all_signals_matched"),
        (has("the") | has("of")).alias("any_signal_matched"), none.alias("disclosure"), none.alias("refusal"), (F.col("turn") + 0.5).cast("double").alias("latency_ms"), F.struct(F.length("text").alias("input_tokens"), none.alias("output_tokens")).alias("usage"),
        F.array(*(F.struct(has(w).alias("matched")) for w in ("the", "of"))).alias("signal_matches"), none.alias("error"), none.alias("ingestion"), F.col("text").alias("raw_response"),
    )
    return S.result_lines(rows, ["conv_id", "turn"], include_raw=True)


@query("""SELECT event_id, '{"event_id":' || event_id || ',"kind":"' || event_type || '","source":{"user":' || user_id || '}}' AS record FROM events""")
def sink_json(spark, d):
    record = F.to_json(F.struct("event_id", F.col("event_type").alias("kind"), F.struct(F.col("user_id").alias("user")).alias("source")))
    return read(spark, d, "events").select("event_id", record.alias("record"))


@query(f"SELECT c_custkey, {_CSV('c_name')} || ',' || {_CSV('x')} || ',job' || c_nationkey AS line FROM (SELECT *, c_mktsegment || CASE WHEN c_custkey % 2 = 0 THEN ', \"q\"' ELSE '' END AS x FROM customer)")
def sink_assignment_csv(spark, d):
    label = F.concat("c_mktsegment", F.when(F.col("c_custkey") % 2 == 0, ', "q"').otherwise(""))
    rows = read(spark, d, "customer").select("c_custkey", F.col("c_name").alias("studentId"), label.alias("label"), F.concat(F.lit("job"), "c_nationkey").alias("jobId"))
    return S.csv_lines(rows, ["studentId", "label", "jobId"], ["c_custkey"])


@query("""SELECT page_id, left(regexp_replace(regexp_replace(url, '\\.[^./\\\\]+$', ''), '[^A-Za-z0-9._-]', '_', 'g'), 100) AS stem, left(regexp_replace(regexp_replace(reverse(url), '[^A-Za-z0-9._-]', '_', 'g'), '^\\.+', '_'), 64) AS segment FROM pages""")
def safe_names(spark, d):
    return read(spark, d, "pages").select("page_id", S.safe_stem(F.col("url")).alias("stem"), S.safe_segment(F.reverse("url")).alias("segment"))


@query(f"""SELECT conv_id, regexp_replace(string_agg(text, chr(10) ORDER BY turn) FILTER (role = 'assistant' AND text <> ''), '^{WS}+|{WS}+$', '', 'g') AS text FROM conversations GROUP BY conv_id HAVING count(*) FILTER (role = 'assistant') > 0""")
def response_text(spark, d):
    part = F.struct("turn", F.struct(F.when(F.col("role") == "assistant", "message").otherwise("reasoning").alias("type"), F.array(F.struct(F.lit("output_text").alias("type"), F.col("text").alias("text"))).alias("content")).alias("item"))
    rows = read(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(part)).alias("p"), F.count_if(F.col("role") == "assistant").alias("n")).where("n > 0")
    body = F.to_json(F.struct(F.transform("p", lambda x: x["item"]).alias("output")))
    return rows.select("conv_id", S.response_text(body).alias("text"))
