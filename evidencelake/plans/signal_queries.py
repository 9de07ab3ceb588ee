"""Queries of signal matching, scores, calibration and comparisons over labelled documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import stats as X
from ..functions.order import dealt, parts_for, small
from ..functions.scratch import spread, written
from ..functions.textsem import WS, norm_ws
from ..operators import scoring as A
from ..operators import signals as M
from .registry import query, read

SIGNALS = [
    M.Signal("exact_phrase", value="the", case_sensitive=True),
    M.Signal("regex", pattern=r"[A-Z]{3,}|[#*$%&]{3}", flags=""),
    M.Signal("methodology_label", value="shed", aliases=("thing", "le la")),
    M.Signal("ordered_terms", values=("The", "of", "tion")),
    M.Signal("section_order", values=("die", "ung")),
]
_NW = lambda c: f"trim(regexp_replace({c}, '{WS}+', ' ', 'g'))"
_TRIM = lambda c: f"regexp_replace({c}, '^{WS}+|{WS}+$', '', 'g')"
_LABEL = rf"(?i)\b(shed|thing|le{WS}+la)\b"

_HEADS = rf"""lines AS (SELECT doc_id, i - 1 AS line_index, regexp_replace(l, '\r$', '') AS line, length(l) AS n
      FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)),
    heads AS (SELECT doc_id, line_index, char_offset, h AS text FROM (SELECT doc_id, line_index,
        coalesce(sum(n + 1) OVER (PARTITION BY doc_id ORDER BY line_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS char_offset,
        CASE WHEN regexp_matches(line, '^#{{1,6}}{WS}+(.+)$') THEN {_TRIM(f"regexp_extract(line, '^#{{1,6}}{WS}+(.+)$', 1)")}
             WHEN regexp_matches(line, '^[0-9]+[.)]{WS}+(.+)$') THEN {_TRIM(f"regexp_extract(line, '^[0-9]+[.)]{WS}+(.+)$', 1)")}
             WHEN length({_TRIM("line")}) BETWEEN 1 AND 80 AND regexp_matches(line, '[A-Za-z]') AND {_TRIM("line")} = upper({_TRIM("line")}) THEN {_TRIM("line")}
             WHEN regexp_matches(line, '^(.{{1,120}}):{WS}*$') THEN {_TRIM(f"regexp_extract(line, '^(.{{1,120}}):{WS}*$', 1)")} END AS h
        FROM lines) WHERE h <> '')"""
_MATCHES = rf"""{_HEADS},
    joined AS (SELECT doc_id, string_agg(lower(text), chr(10) ORDER BY line_index) AS hs FROM heads GROUP BY doc_id),
    texts AS (SELECT doc_id, text, lang, source, CASE quality WHEN 1 THEN 'baseline' ELSE 'candidate' END AS label FROM documents JOIN labels USING (doc_id)),
    matches AS (
      SELECT doc_id, label, lang, 0 AS idx, 'lexical' AS g, contains(text, 'the') AS m FROM texts
      UNION ALL SELECT doc_id, label, lang, 1, 'lexical', regexp_matches(text, '[A-Z]{{3,}}|[#*$%&]{{3}}') FROM texts
      UNION ALL SELECT doc_id, label, lang, 2, 'methodology', regexp_matches(text, '{_LABEL}') FROM texts
      UNION ALL SELECT doc_id, label, lang, 3, 'structural', regexp_matches(lower(text), '(?s)the.*of.*tion') FROM texts
      UNION ALL SELECT doc_id, label, lang, 4, 'structural', coalesce(regexp_matches(hs, '(?s)die[^\n]*\n.*ung'), false) FROM texts LEFT JOIN joined USING (doc_id)),
    counts AS (SELECT doc_id, label, lang, count(*) FILTER (m) AS matched_count, count(*) AS total FROM matches GROUP BY ALL),
    scores AS (SELECT doc_id, label, lang, avg(m::INT) FILTER (g = 'methodology') AS methodology, avg(m::INT) FILTER (g = 'lexical') AS lexical, avg(m::INT) FILTER (g = 'structural') AS structural,
        (avg(m::INT) FILTER (g = 'methodology') + avg(m::INT) FILTER (g = 'lexical') + avg(m::INT) FILTER (g = 'structural')) / 3 AS combined,
        count(*) FILTER (m) AS matched_count, count(*) AS total FROM matches GROUP BY ALL),
    calib AS (SELECT lang, count(*) AS baseline_count, avg(combined) AS combined_mean, count(*) FILTER (matched_count = total) AS all_matched,
        count(*) FILTER (matched_count = total) / count(*) AS false_positive_rate FROM scores WHERE label = 'baseline' GROUP BY lang)"""
_LF = lambda n: f"lgamma({n} + 1.0)"


def _fisher(a, b, c, d, digits=7):
    lp = lambda i: f"({_LF(f'({a}+{b})')} + {_LF(f'({c}+{d})')} + {_LF(f'({a}+{c})')} + {_LF(f'({b}+{d})')} - {_LF(f'({a}+{b}+{c}+{d})')} - {_LF(i)} - {_LF(f'({a}+{b}-{i})')} - {_LF(f'({a}+{c}-{i})')} - {_LF(f'({d}-{a}+{i})')})"
    return f"round(least(1.0, list_sum(list_transform(range(greatest(0, {a}-{d}), least({a}+{b}, {a}+{c}) + 1), lambda i: CASE WHEN {lp('i')} <= {lp(a)} + 1e-9 THEN exp({lp('i')}) ELSE 0.0 END))), {digits})"


def _holm(source, by, p):
    part = f"PARTITION BY {by}" if by else ""
    return f"""SELECT *, max(raw) OVER ({part} ORDER BY {p}, idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS adjusted_p
      FROM (SELECT *, least(1.0, {p} * (count(*) OVER ({part}) - row_number() OVER ({part} ORDER BY {p}, idx) + 1)) AS raw FROM {source})"""


def labelled(spark, d):
    label = F.when(F.col("quality") == 1, "baseline").otherwise("candidate")
    marks = read(spark, d, "labels").select("doc_id", label.alias("label"))
    return documents(spark, d).join(small(marks), "doc_id")


def documents(spark, d):
    return spread(read(spark, d, "documents"))


def _matches(spark, d):
    return M.match_signals(labelled(spark, d), M.signal_frame(spark, SIGNALS), ["doc_id", "label", "lang"])


def _scores(spark, d):
    return A.score_groups(_matches(spark, d), ["doc_id", "label", "lang"])


def _written_scores(spark, d):
    """Scores that calibration and what follows it both read: texts are matched once."""
    return written(_scores(spark, d), "scores")


def _calibration(scores):
    return A.calibrate(scores.where("label = 'baseline'"), ["lang"])


@query("SELECT doc_id, len(string_split(text, 'the')) - 1 AS n, CASE WHEN contains(text, 'the') THEN instr(text, 'the') - 1 END AS first_at FROM documents")
def sig_exact(spark, d):
    at = M.positions(F.col("text"), F.lit("the"))
    return read(spark, d, "documents").select("doc_id", at.alias("at")).select("doc_id", F.size("at").cast("long").alias("n"), F.get("at", 0).cast("long").alias("first_at"))


def _at(pattern, text="text"):
    """SQL for the offsets of all matches of a pattern, joined by commas."""
    p, h = f"string_split(regexp_replace({text}, {pattern}, chr(64976), 'g'), chr(64976))", f"regexp_extract_all({text}, {pattern})"
    return f"array_to_string(list_transform(range(1, len({h}) + 1), lambda k: (list_sum(list_transform(({p})[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(({h})[1:k - 1], lambda x: length(x))), 0))::BIGINT), ',')"


def _joined(c="evidence.positions"):
    return F.array_join(F.col(c).cast("array<string>"), ",", "-")


@query(f"""SELECT doc_id, direct OR loose <> '' AS matched, CASE WHEN direct THEN {_at("'the  th'")} ELSE loose END AS positions, NOT direct AND loose <> '' AS whitespace_normalized
    FROM (SELECT doc_id, text, contains(text, 'the  th') AS direct, {_at(f"'the{WS}+th'")} AS loose FROM documents)""")
def sig_exact_ws(spark, d):
    frame = M.signal_frame(spark, [M.Signal("exact_phrase", value="the  th")])
    rows = M.match_signals(documents(spark, d), frame, ["doc_id"], evidence=True)
    return rows.select("doc_id", "matched", _joined().alias("positions"), "evidence.whitespace_normalized")


_THE_OF = r"'(?i)\bthe\b.{0,20}\bof\b'"


@query(f"""SELECT doc_id, idx, err IS NULL AND pos <> '' AS matched, CASE WHEN err IS NULL THEN pos ELSE '' END AS positions, err IS NOT NULL AS has_error
    FROM (SELECT doc_id, idx, err, CASE idx WHEN 0 THEN {_at("'[A-Z]{3,}'")} WHEN 3 THEN {_at(_THE_OF)} WHEN 4 THEN {_at("'[^aeiou &]+&&?'")} END AS pos
      FROM documents, (VALUES (0, NULL), (1, 'nested'), (2, 'flag'), (3, NULL), (4, NULL), (5, 'group')) p(idx, err))""")
def sig_regex(spark, d):
    tried = [
        M.Signal("regex", pattern=r"[A-Z]{3,}"), M.Signal("regex", pattern="(a+)+"), M.Signal("regex", pattern="a", flags="y"), M.Signal("regex", pattern=r"\bthe\b.{0,20}\bof\b", flags="gi"),
        M.Signal("regex", pattern="[^aeiou &&]+&&?"), M.Signal("regex", pattern="(?P<y>a)"),
    ]
    rows = M.match_signals(documents(spark, d), M.signal_frame(spark, tried), ["doc_id"], bounded=True, evidence=True)
    return rows.select("doc_id", "idx", "matched", _joined().alias("positions"), F.col("error").isNotNull().alias("has_error"))


_LABELS = {"shed": r"'(?i)\bshed\b'", "thing": r"'(?i)\bthing\b'", "le la": rf"'(?i)\ble{WS}+la\b'"}
_FIRST_LABEL = " ".join(f"WHEN regexp_matches(text, {p}) THEN '{t}'" for t, p in _LABELS.items())
_LABEL_AT = " ".join(f"WHEN regexp_matches(text, {p}) THEN {_at(p)}" for p in _LABELS.values())


@query(f"SELECT doc_id, CASE {_FIRST_LABEL} END AS matched_term, CASE {_LABEL_AT} ELSE '' END AS positions FROM documents")
def sig_label(spark, d):
    frame = M.signal_frame(spark, [M.Signal("methodology_label", value="shed", aliases=("thing", "le la"))])
    rows = M.match_signals(documents(spark, d), frame, ["doc_id"], evidence=True)
    return rows.select("doc_id", "evidence.matched_term", _joined().alias("positions"))


@query("SELECT doc_id, regexp_matches(lower(text), '(?s)the.*of.*tion') AS matched FROM documents")
def sig_ordered(spark, d):
    found = M.ordered_match(F.col("text"), F.array(*map(F.lit, ("The", "of", "tion"))))
    return read(spark, d, "documents").select("doc_id", M.all_found(found).alias("matched"))


@query(f"WITH {_HEADS} SELECT doc_id, text, line_index, char_offset FROM heads")
def headings(spark, d):
    return M.headings(read(spark, d, "documents"), "doc_id").withColumn("line_index", F.col("line_index").cast("long"))


@query(f"WITH {_MATCHES} SELECT doc_id, m AS matched FROM matches WHERE idx = 4")
def sig_sections(spark, d):
    names = F.array(F.lit("die"), F.lit(" Ung "))
    return labelled(spark, d).select("doc_id", M.all_found(M.section_match(F.col("text"), names)).alias("matched"))


@query(rf"""WITH {_HEADS},
    f AS (SELECT doc_id, min(line_index) FILTER (contains(lower(text), 'die')) AS a, count(*) AS n FROM heads GROUP BY doc_id),
    g AS (SELECT doc_id, a, n, min(line_index) FILTER (contains(lower(text), 'ung') AND line_index > coalesce(a, -1)) AS b FROM heads JOIN f USING (doc_id) GROUP BY ALL),
    s AS (SELECT g.doc_id, n, coalesce(x.char_offset::VARCHAR, '-') || ',' || coalesce(y.char_offset::VARCHAR, '-') AS pos, a IS NOT NULL AND b IS NOT NULL AS m
      FROM g LEFT JOIN heads x ON x.doc_id = g.doc_id AND x.line_index = a LEFT JOIN heads y ON y.doc_id = g.doc_id AND y.line_index = b),
    o AS (SELECT doc_id, p1, CASE WHEN strpos(t[c2:], 'of') > 0 THEN strpos(t[c2:], 'of') + c2 - 1 ELSE 0 END AS p2, t, c2 FROM (SELECT doc_id, lower(text) AS t, strpos(lower(text), 'the') AS p1, CASE WHEN p1 > 0 THEN p1 + 3 ELSE 1 END AS c2 FROM documents)),
    q AS (SELECT doc_id, p1, p2, CASE WHEN strpos(t[c3:], 'tion') > 0 THEN strpos(t[c3:], 'tion') + c3 - 1 ELSE 0 END AS p3 FROM (SELECT *, CASE WHEN p2 > 0 THEN p2 + 2 ELSE c2 END AS c3 FROM o))
    SELECT doc_id, 0 AS idx, contains(text, 'the') AS matched, {_at("'the'")} AS positions, false AS whitespace_normalized, NULL AS matched_term, NULL::BIGINT AS n_headings FROM documents
    UNION ALL SELECT doc_id, 1, regexp_matches(text, '[A-Z]{{3,}}|[#*$%&]{{3}}'), {_at("'[A-Z]{3,}|[#*$%&]{3}'")}, NULL, NULL, NULL FROM documents
    UNION ALL SELECT doc_id, 2, regexp_matches(text, '{_LABEL}'), CASE {_LABEL_AT} ELSE '' END, NULL, CASE {_FIRST_LABEL} END, NULL FROM documents
    UNION ALL SELECT doc_id, 3, p1 > 0 AND p2 > 0 AND p3 > 0, concat_ws(',', CASE WHEN p1 > 0 THEN (p1 - 1)::VARCHAR ELSE '-' END, CASE WHEN p2 > 0 THEN (p2 - 1)::VARCHAR ELSE '-' END, CASE WHEN p3 > 0 THEN (p3 - 1)::VARCHAR ELSE '-' END), NULL, NULL, NULL FROM q
    UNION ALL SELECT doc_id, 4, coalesce(m, false), coalesce(pos, '-,-'), NULL, NULL, coalesce(n, 0) FROM documents LEFT JOIN s USING (doc_id)""")
def match_all(spark, d):
    rows = M.match_signals(documents(spark, d), M.signal_frame(spark, SIGNALS), ["doc_id"], evidence=True)
    return rows.select("doc_id", "idx", "matched", _joined().alias("positions"), "evidence.whitespace_normalized", "evidence.matched_term", F.size("evidence.headings").cast("long").alias("n_headings"))


@query(f"WITH {_MATCHES} SELECT doc_id, matched_count, total FROM counts")
def match_bounded(spark, d):
    rows = M.match_signals(labelled(spark, d), M.signal_frame(spark, SIGNALS), ["doc_id"], bounded=True)
    return M.match_counts(rows, ["doc_id"])


@query(f"""WITH i AS (SELECT item_id, string_split(lower({_NW('text')}), ' ') AS ws FROM benchmark),
    w AS (SELECT DISTINCT item_id, array_to_string(ws[k:k + 11], ' ') AS s FROM (SELECT item_id, ws, unnest(range(1, len(ws) - 10)) AS k FROM i)),
    t AS (SELECT doc_id, lower({_NW('text')}) AS body FROM documents),
    s AS (SELECT item_id, array_to_string(ws, ' ') AS s FROM i WHERE len(ws) < 12 AND ws <> [''])
    SELECT DISTINCT item_id, doc_id FROM (SELECT * FROM w UNION ALL SELECT * FROM s) x, t WHERE contains(body, x.s)""")
def disclosure(spark, d):
    return M.disclosures(read(spark, d, "benchmark"), documents(spark, d), "item_id", "doc_id")


_PAGE = f"""SELECT d.doc_id, contains(text, e) AS exact, contains({_NW('text')}, {_NW('e')}) AS normalised, contains(lower(text), lower(e)) AS folded,
    CASE WHEN contains(text, e) THEN instr(text, e) - 1 END AS first_at, source FROM (SELECT *, CASE lang WHEN 'en' THEN 'The  of' ELSE 'de la' END AS e FROM documents) d"""


def _pages(spark, d):
    e = F.when(F.col("lang") == "en", "The  of").otherwise("de la")
    m = M.page_match(F.col("text"), e)
    return read(spark, d, "documents").select("doc_id", "source", *(m[k].alias(k) for k in ("exact", "normalised", "folded")), m["offset"].cast("long").alias("first_at"))


@query(f"SELECT doc_id, exact, normalised, folded, first_at FROM ({_PAGE})")
def text_match_page(spark, d):
    return _pages(spark, d).drop("source")


@query(f"SELECT source, bool_and(normalised) FILTER (doc_id % 2 = 0) AS targets, bool_or(normalised) AS any_page FROM ({_PAGE}) GROUP BY source")
def text_match_doc(spark, d):
    target = F.col("doc_id") % 2 == 0
    return _pages(spark, d).groupBy("source").agg(F.bool_and(F.when(target, F.col("normalised"))).alias("targets"), F.bool_or("normalised").alias("any_page"))


@query(f"""SELECT doc_id, contains(m, t) OR contains({_NW('m')}, {_NW('t')}) OR contains(m, sha256(t)) AS found FROM
    (SELECT doc_id, left(text, 30) AS t, CASE lang WHEN 'en' THEN 'x' || text WHEN 'fr' THEN 'h ' || sha256(left(text, 30)) ELSE reverse(text) END AS m FROM documents)""")
def payload_found(spark, d):
    t, m = F.left("text", F.lit(30)), F.when(F.col("lang") == "en", F.concat(F.lit("x"), "text")).when(F.col("lang") == "fr", F.concat(F.lit("h "), F.sha2(F.left("text", F.lit(30)), 256))).otherwise(F.reverse("text"))
    rows = read(spark, d, "documents").select("doc_id", t.alias("t"), m.alias("m"))
    return rows.select("doc_id", (F.contains("m", "t") | F.contains(norm_ws(F.col("m")), norm_ws(F.col("t"))) | F.contains("m", F.sha2("t", 256))).alias("found"))


@query(f"WITH {_MATCHES} SELECT doc_id, CASE WHEN matched_count = 0 THEN 'not_surfaced' WHEN matched_count = total THEN 'surfaced' ELSE 'partial' END AS outcome FROM counts")
def notice_outcome(spark, d):
    rows = M.match_counts(_matches(spark, d), ["doc_id"])
    return rows.select("doc_id", M.notice_outcome(F.col("matched_count"), F.col("total")).alias("outcome"))


@query(f"""WITH m AS (SELECT c_nationkey AS k, c_custkey AS idx, lower({_NW('c_mktsegment')}) AS v, c_mktsegment AS value FROM customer),
    h AS (SELECT DISTINCT s_nationkey AS k, 'building' AS v FROM supplier)
    SELECT k, idx, value FROM (SELECT *, row_number() OVER (PARTITION BY k, v ORDER BY idx) AS n FROM m ANTI JOIN h USING (k, v)) WHERE n = 1""")
def sig_dedupe(spark, d):
    have = read(spark, d, "supplier").select(F.col("s_nationkey").alias("k"), F.lit("exact_phrase").alias("type"), F.lit(" Building ").alias("value"))
    more = read(spark, d, "customer").select(F.col("c_nationkey").alias("k"), F.lit("exact_phrase").alias("type"), F.col("c_custkey").alias("idx"), F.col("c_mktsegment").alias("value"))
    return M.new_signals(have, more, ["k"]).select("k", "idx", "value")


_STOP = "[" + ", ".join(f"'{w}'" for w in M.STOP_WORDS) + "]"
_TERMS = lambda c: (
    f"list_filter(list_transform(regexp_split_to_array(lower({c}), '[^a-z0-9''-]+'), lambda w: regexp_replace(w, '^[''-]+|[''-]+$', '', 'g')), lambda w: length(w) >= 4 AND NOT list_contains({_STOP}, w))"
)
_FIRST4 = lambda c: f"list_transform(list_filter(list_zip({_TERMS(c)}, range(1, len({_TERMS(c)}) + 1)), lambda z: list_position({_TERMS(c)}, z[1]) = z[2]), lambda z: z[1])[1:4]"


@query(f"SELECT item_id, array_to_string({_FIRST4('text')}, ' ') AS terms FROM benchmark")
def salient_terms(spark, d):
    return read(spark, d, "benchmark").select("item_id", F.array_join(M.salient_terms(F.col("text")), " ").alias("terms"))


@query(f"""WITH b AS (SELECT item_id, {_TRIM('text')} AS r, CASE WHEN item_id % 2 = 0 THEN 'KEY' || item_id END AS k, {_FIRST4('text')} AS ts FROM benchmark),
    s AS (SELECT item_id, 0 AS o, 'exact_phrase' AS type, r AS value FROM b WHERE r <> '' UNION ALL SELECT item_id, 1, 'ordered_terms', array_to_string(ts, ' ') FROM b WHERE len(ts) >= 2
          UNION ALL SELECT item_id, 2, 'exact_phrase', k FROM b WHERE k IS NOT NULL)
    SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY o) - 1 AS idx, type, value FROM s""")
def derive_signals(spark, d):
    rows = read(spark, d, "benchmark").withColumn("k", F.when(F.col("item_id") % 2 == 0, F.concat(F.lit("KEY"), "item_id")))
    out = M.derived_signals(rows, "text", "k", ["item_id"])
    return out.select("item_id", F.col("idx").cast("long").alias("idx"), "type", F.when(F.col("type") == "ordered_terms", F.array_join("terms", " ")).otherwise(F.col("value")).alias("value"))


_SPANS = """sp AS (SELECT doc_id, greatest(((l_orderkey * 7) % 400)::BIGINT - 20, 0) AS s, least(((l_orderkey * 7) % 400)::BIGINT - 20 + l_quantity::BIGINT, n_chars) AS e
    FROM lineitem JOIN documents ON doc_id = l_partkey % (SELECT count(*) FROM documents)),
    ok AS (SELECT * FROM sp WHERE s < e),
    isl AS (SELECT *, sum(CASE WHEN r IS NULL OR s > r THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g
      FROM (SELECT *, max(e) OVER (PARTITION BY doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM ok)),
    merged AS (SELECT doc_id, min(s) AS s, max(e) AS e FROM isl GROUP BY doc_id, g)"""


def _spans(spark, d):
    docs = read(spark, d, "documents")
    n = docs.count()
    start = (F.col("l_orderkey") * 7) % 400 - 20
    rows = read(spark, d, "lineitem").select((F.col("l_partkey") % n).alias("doc_id"), start.alias("start"), (start + F.col("l_quantity").cast("long")).alias("end"))
    parts = parts_for(rows.count(), spark)
    lengths = dealt(docs.select("doc_id", "n_chars"), parts, "doc_id").hint("merge")
    return M.merge_spans(dealt(rows, parts, "doc_id").join(lengths, "doc_id"), "doc_id", "n_chars")


@query(f"WITH {_SPANS} SELECT doc_id, s AS start_at, e AS end_at FROM merged")
def span_merge(spark, d):
    return _spans(spark, d).select("doc_id", F.col("start").alias("start_at"), F.col("end").alias("end_at"))


@query(f"""WITH {_SPANS}, e AS (SELECT doc_id, s AS p FROM merged UNION SELECT doc_id, e FROM merged UNION SELECT doc_id, 0 FROM documents UNION SELECT doc_id, n_chars FROM documents),
    c AS (SELECT doc_id, p AS s, lead(p) OVER (PARTITION BY doc_id ORDER BY p) AS e FROM e)
    SELECT c.doc_id, c.s AS start_at, substring(text, c.s + 1, c.e - c.s) AS piece, m.s IS NOT NULL AS highlighted FROM c JOIN documents d ON d.doc_id = c.doc_id
    LEFT JOIN merged m ON m.doc_id = c.doc_id AND m.s = c.s WHERE c.e IS NOT NULL""")
def text_segments(spark, d):
    rows = M.segments(read(spark, d, "documents"), _spans(spark, d).select("doc_id", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end")), "doc_id")
    return rows.select("doc_id", F.col("start").cast("long").alias("start_at"), F.col("text").alias("piece"), "highlighted")


@query("""SELECT conv_id, contains(lower(string_agg(text, chr(10) ORDER BY turn)), 'the') AS found, avg(CASE WHEN role = 'user' THEN length(text) END) AS mean_confidence FROM conversations GROUP BY conv_id""")
def joined_found(spark, d):
    joined = F.expr("listagg(text, '\n') WITHIN GROUP (ORDER BY turn)")
    rows = read(spark, d, "conversations").groupBy("conv_id").agg(joined.alias("t"), F.avg(F.when(F.col("role") == "user", F.length("text"))).alias("mean_confidence"))
    return rows.select("conv_id", F.contains(F.lower("t"), F.lit("the")).alias("found"), "mean_confidence")


@query(f"WITH {_MATCHES} SELECT doc_id, methodology, lexical, structural, combined, matched_count, total FROM scores")
def score_groups(spark, d):
    return _scores(spark, d).drop("label", "lang")


@query(f"WITH {_MATCHES} SELECT lang, baseline_count, combined_mean, all_matched, false_positive_rate FROM calib")
def calibrate(spark, d):
    return _calibration(_scores(spark, d))


@query(f"WITH {_MATCHES} SELECT lang, idx, count(*) AS n, avg(m::INT) AS rate FROM matches WHERE label = 'baseline' GROUP BY lang, idx")
def baseline_rates(spark, d):
    return A.signal_rates(_matches(spark, d).where("label = 'baseline'"), M.signal_frame(spark, SIGNALS), ["lang"])


_TAIL = f"round(least(1.0, list_sum(list_transform(range(k, n + 1), lambda i: exp({_LF('n')} - {_LF('i')} - {_LF('(n - i)')} + i * ln(p) + (n - i) * ln(1 - p))))), 7)"


@query(f"""SELECT o_custkey, CASE WHEN n <= 0 THEN NULL WHEN k <= 0 THEN 1.0 WHEN k > n THEN 0.0 ELSE {_TAIL} END AS p_value
    FROM (SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS k, count(*) AS n, 0.31415926::DOUBLE AS p FROM orders GROUP BY o_custkey)""")
def binom_tail(spark, d):
    rows = read(spark, d, "orders").groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "F").alias("k"), F.count(F.lit(1)).alias("n"))
    return rows.select("o_custkey", F.round(X.binomial_tail(F.col("k"), F.col("n"), F.lit(0.31415926)), 7).alias("p_value"))


@query(f"""WITH {_MATCHES} SELECT doc_id, CASE WHEN matched_count < total THEN 1.0 ELSE false_positive_rate END AS p_value, CASE WHEN baseline_count IS NULL THEN 'insufficient_baseline' ELSE 'binomial_vs_baseline' END AS method
    FROM scores LEFT JOIN calib USING (lang) WHERE label = 'candidate'""")
def evaluate(spark, d):
    scores = _written_scores(spark, d)
    return A.evaluate(scores.where("label = 'candidate'"), _calibration(scores), ["lang"]).select("doc_id", "p_value", "method")


_CELLS = """cells AS (SELECT l_suppkey AS idx, count(*) FILTER (l_returnflag = 'R' AND l_linestatus = 'F') AS a, count(*) FILTER (l_returnflag = 'R' AND l_linestatus <> 'F') AS b,
    count(*) FILTER (l_returnflag <> 'R' AND l_linestatus = 'F') AS c, count(*) FILTER (l_returnflag <> 'R' AND l_linestatus <> 'F') AS d FROM lineitem GROUP BY l_suppkey)"""


def _cells(spark, d):
    r, s = F.col("l_returnflag") == "R", F.col("l_linestatus") == "F"
    return read(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("idx")).agg(F.count_if(r & s).alias("a"), F.count_if(r & ~s).alias("b"), F.count_if(~r & s).alias("c"), F.count_if(~r & ~s).alias("d"))


@query(f"WITH {_CELLS} SELECT idx, {_fisher('a', 'b', 'c', 'd')} AS p FROM cells")
def fisher(spark, d):
    return _cells(spark, d).select("idx", F.round(X.fisher_exact(*map(F.col, "abcd")), 7).alias("p"))


@query(f"WITH {_CELLS}, ps AS (SELECT idx, idx % 5 AS f, {_fisher('a', 'b', 'c', 'd')} AS p FROM cells) SELECT idx, f, p, round(adjusted_p, 5) AS adjusted_p, adjusted_p <= 0.05 AS significant FROM ({_holm('ps', 'f', 'p')})")
def holm(spark, d):
    rows = _cells(spark, d).select("idx", (F.col("idx") % 5).alias("f"), F.round(X.fisher_exact(*map(F.col, "abcd")), 7).alias("p"))
    return X.holm(rows, ["f"]).withColumn("adjusted_p", F.round("adjusted_p", 5))


_COMPARE = f"""{_MATCHES}, ab AS (SELECT idx, count(*) FILTER (label = 'candidate' AND m) AS a, count(*) FILTER (label = 'candidate' AND NOT m) AS b,
    count(*) FILTER (label = 'baseline' AND m) AS c, count(*) FILTER (label = 'baseline' AND NOT m) AS d FROM matches GROUP BY idx),
    fp AS (SELECT *, {_fisher('a', 'b', 'c', 'd', 12)} AS p FROM ab)"""


@query(f"WITH {_COMPARE} SELECT idx, a, b, c, d, a / (a + b) AS candidate_rate, c / (c + d) AS baseline_rate, round(p, 7) AS fisher_p, round(adjusted_p, 6) AS adjusted_p, adjusted_p <= 0.05 AS significant FROM ({_holm('fp', '', 'p')})")
def compare_rates(spark, d):
    rows = A.compare_rates(_matches(spark, d), [])
    return rows.withColumns({"fisher_p": F.round("fisher_p", 7), "adjusted_p": F.round("adjusted_p", 6)})


@query(f"""WITH {_MATCHES}, h AS (SELECT lang, count(*) FILTER (label = 'candidate') AS n1, count(*) FILTER (label = 'baseline') AS n2, count(*) FILTER (label = 'candidate' AND matched_count = total) AS a,
      count(*) FILTER (label = 'baseline' AND matched_count = total) AS c FROM counts GROUP BY lang)
    SELECT lang, n1 AS candidate_count, n2 AS baseline_count, a / nullif(n1, 0) AS candidate_all_rate, c / nullif(n2, 0) AS baseline_all_rate,
      CASE WHEN n1 > 0 AND n2 > 0 THEN {_fisher('a', '(n1 - a)', 'c', '(n2 - c)')} END AS fisher_p, (a / nullif(n1, 0) - c / nullif(n2, 0)) * 100 AS delta_pp FROM h""")
def compare_all_matched(spark, d):
    counts = M.match_counts(_matches(spark, d), ["doc_id", "label", "lang"])
    return A.compare_all_matched(counts, ["lang"]).withColumn("fisher_p", F.round("fisher_p", 7)).drop("notes")


@query(f"""WITH {_MATCHES}, ev AS (SELECT doc_id AS idx, lang, CASE WHEN matched_count < total THEN 1.0 ELSE false_positive_rate END AS p FROM scores JOIN calib USING (lang) WHERE label = 'candidate')
    SELECT idx AS doc_id, lang, p AS p_value, round(adjusted_p, 7) AS adjusted_p FROM ({_holm('ev', 'lang', 'p')})""")
def recompute(spark, d):
    return A.recompute(_scores(spark, d), ["lang"], "doc_id").select("doc_id", "lang", "p_value", F.round("adjusted_p", 7).alias("adjusted_p"))


@query(f"""WITH {_MATCHES} SELECT lang, count(*) FILTER (label = 'candidate') AS n_candidate, count(*) FILTER (label = 'baseline') AS n_baseline,
    avg(combined) FILTER (label = 'candidate') AS mean_candidate, avg(combined) FILTER (label = 'baseline') AS mean_baseline FROM scores GROUP BY lang""")
def list_summary(spark, d):
    is_ = lambda x: F.col("label") == x
    return _scores(spark, d).groupBy("lang").agg(
        F.count_if(is_("candidate")).alias("n_candidate"), F.count_if(is_("baseline")).alias("n_baseline"),
        F.avg(F.when(is_("candidate"), F.col("combined"))).alias("mean_candidate"), F.avg(F.when(is_("baseline"), F.col("combined"))).alias("mean_baseline"),
    )


@query(f"""WITH {_MATCHES} SELECT doc_id, CASE WHEN matched_count = total THEN 'Hidden instruction signal matched' WHEN matched_count > 0 THEN 'Behavioral canary detected' ELSE 'No consistent signal' END AS headline,
    matched_count || ' of ' || total || ' configured deterministic evidence signal(s) matched in this submission''s text.' AS text,
    'Based on ' || baseline_count || ' baseline submission(s), a false-positive rate of ' || printf('%.1f', false_positive_rate * 100) || '% was observed for "all signals matched"; this is evidence, never a verdict.' AS uncertainty
    FROM scores JOIN calib USING (lang)""")
def interpret(spark, d):
    scores = _written_scores(spark, d)
    rows = scores.join(small(_calibration(scores)), "lang")
    said = A.interpretation(*(F.col(c) for c in ("matched_count", "total", "baseline_count", "false_positive_rate")))
    return rows.select("doc_id", *(v.alias(k) for k, v in said.items()))


@query("SELECT c_custkey, 'no expected signals' AS error FROM customer ANTI JOIN orders ON o_custkey = c_custkey")
def scorable(spark, d):
    return A.unscorable(read(spark, d, "customer").select("c_custkey"), read(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")
