"""Queries of experiment grids over response tables, and of assignment and retention over units and events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import assign as D
from ..operators import classify as C
from ..operators import grid as G
from .classify_queries import _RESP, _V2, _V3, _COUNTS, responses, v2
from .registry import query, read

_CONDS = ["original", "white_text", "visible_positive_control", "xmp_only"]
_RESULTS = """res AS (SELECT conv_id * 100 + turn AS ord, conv_id, turn, 'p' || (conv_id % 3) AS provider, ['original', 'white_text', 'visible_positive_control', 'xmp_only'][1 + (conv_id // 3) % 4] AS condition,
      conv_id // 12 % 5 AS run, length(text) * 1.5::DOUBLE AS latency, contains(text, 'the') AND contains(text, 'of') AS all_, contains(text, 'the') OR contains(text, 'of') AS any_, length(text) % 5 = 0 AS disclosure, length(text) % 7 = 0 AS refusal
      FROM conversations WHERE role = 'assistant'),
    cells AS (SELECT provider, condition, count(*) AS n, avg(all_::INT) AS all_rate, avg(any_::INT) AS any_rate, avg(disclosure::INT) AS disclosure_rate, avg(refusal::INT) AS refusal_rate, avg(latency) AS mean_latency_ms, min(ord) AS ord,
      CASE WHEN count(*) > 1 THEN (max(all_::INT) - min(all_::INT))::DOUBLE END AS spread FROM res GROUP BY ALL),
    deltas AS (SELECT c.*, CASE WHEN c.condition <> 'original' THEN (c.all_rate - o.all_rate) * 100 END AS delta_pp FROM cells c LEFT JOIN cells o ON o.provider = c.provider AND o.condition = 'original')"""


def results(spark, d):
    has = lambda w: F.contains("text", F.lit(w))
    n = F.length("text")
    return read(spark, d, "conversations").where("role = 'assistant'").select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("ord"), "conv_id", "turn", "text", F.concat(F.lit("p"), F.col("conv_id") % 3).alias("provider"),
        F.get(F.array(*map(F.lit, _CONDS)), (F.floor(F.col("conv_id") / 3) % 4).cast("int")).alias("condition"), (F.floor(F.col("conv_id") / 12) % 5).alias("run"), (n * 1.5).cast("double").alias("latency"),
        (has("the") & has("of")).alias("all"), (has("the") | has("of")).alias("any"), (n % 5 == 0).alias("disclosure"), (n % 7 == 0).alias("refusal"),
    )


def deltas(spark, d):
    rows = results(spark, d)
    cells = G.cell_rates(rows, ["provider", "condition"], ["all", "any", "disclosure", "refusal"], "latency")
    more = rows.groupBy("provider", "condition").agg(F.min("ord").alias("ord"), F.when(F.count(F.lit(1)) > 1, F.max(F.col("all").cast("double")) - F.min(F.col("all").cast("double"))).alias("spread"))
    return G.with_deltas(cells.join(more, ["provider", "condition"]), "provider", "condition", "all_rate")


@query("""SELECT provider, condition, repeat::INT AS repeat FROM (SELECT DISTINCT c_mktsegment AS provider FROM customer), (SELECT unnest(['original','white_text','render_mode_3','visible_positive_control','xmp_only','unicode_tags','image_only','freetext_annot','acroform_field','info_dict','actual_text']) AS condition), (SELECT unnest(range(1, 4)) AS repeat)""")
def grid(spark, d):
    conds = spark.createDataFrame([(c,) for c in G.CONDITIONS], "condition string")
    return G.grid(read(spark, d, "customer").select(F.col("c_mktsegment").alias("provider")).distinct(), conds, 3)


@query("""SELECT c_custkey, array_to_string(list_filter([CASE WHEN c_custkey % 5 = 0 THEN 'no providers' END, CASE WHEN c_custkey % 5 = 1 THEN 'duplicate provider' END, CASE WHEN c_nationkey % 4 = 1 THEN 'unknown condition' END,
    CASE WHEN c_nationkey % 4 = 2 THEN 'duplicate condition' END, CASE WHEN c_custkey % 13 NOT BETWEEN 1 AND 10 THEN 'repeats out of range' END], lambda x: x IS NOT NULL), ',') AS errors FROM customer""")
def grid_config(spark, d):
    k, n = F.col("c_custkey") % 5, F.col("c_nationkey") % 4
    s = F.col("c_mktsegment")
    providers = F.when(k == 0, F.array().cast("array<string>")).when(k == 1, F.array(s, s)).otherwise(F.array(s, F.lit("x")))
    conditions = F.when(n == 1, F.array(F.lit("all"), F.lit("sideways"))).when(n == 2, F.array(F.lit("xmp_only"), F.lit("xmp_only"))).otherwise(F.array(F.lit("all")))
    text = F.to_json(F.struct(providers.alias("providers"), conditions.alias("conditions"), (F.col("c_custkey") % 13).alias("repeats")))
    rows = read(spark, d, "customer").select("c_custkey", F.from_json(text, "providers array<string>, conditions array<string>, repeats int").alias("c"))
    return rows.select("c_custkey", F.array_join(G.config_errors(F.col("c.providers"), F.col("c.conditions"), F.col("c.repeats")), ",").alias("errors"))


@query(f"WITH {_RESULTS} SELECT conv_id, turn, all_ AS all_matched, any_ AS any_matched, disclosure, refusal FROM res")
def result_flags(spark, d):
    return results(spark, d).select("conv_id", "turn", F.col("all").alias("all_matched"), F.col("any").alias("any_matched"), "disclosure", "refusal")


@query(f"WITH {_RESULTS} SELECT provider, condition, n, all_rate, any_rate, disclosure_rate, refusal_rate, mean_latency_ms, delta_pp FROM deltas")
def grid_aggs(spark, d):
    return deltas(spark, d).drop("ord", "spread")


@query(f"WITH {_RESULTS} SELECT provider, condition, count(*) AS n, avg(all_::INT) AS all_rate FROM res GROUP BY ROLLUP (provider, condition)")
def grid_rollup(spark, d):
    return results(spark, d).rollup("provider", "condition").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("all").cast("double")).alias("all_rate"))


_BEST = "max_by({}, (delta_pp, -ord)) FILTER (delta_pp IS NOT NULL AND condition NOT IN ('original', 'visible_positive_control'))"
_GATE = f"""gate AS (SELECT {_BEST.format('provider')} AS best_provider, {_BEST.format('condition')} AS best_condition, {_BEST.format('delta_pp')} AS best_delta_pp,
    sum(all_rate * n) FILTER (condition = 'visible_positive_control') / sum(n) FILTER (condition = 'visible_positive_control') AS control_rate, sum(all_rate * n) FILTER (condition = 'original') / sum(n) FILTER (condition = 'original') AS original_rate,
    sum(disclosure_rate * n) FILTER (condition NOT IN ('original', 'visible_positive_control')) / sum(n) FILTER (condition NOT IN ('original', 'visible_positive_control')) AS disclosure_injected, max(spread) AS variation FROM deltas)"""


@query(f"WITH {_RESULTS}, {_GATE} SELECT *, best_delta_pp >= 50 AS passed FROM gate")
def gate(spark, d):
    return G.gate(deltas(spark, d), [])


@query(f"""WITH {_RESULTS} SELECT provider, condition, printf('%.1f%%', round(all_rate * 100, 1)) AS rate, CASE WHEN delta_pp IS NULL THEN '-' ELSE printf('%+.1f pp', round(delta_pp, 1)) END AS delta, printf('%.0f ms', round(mean_latency_ms)) AS latency,
    CASE WHEN delta_pp IS NULL THEN 'No provider/condition pair produced a comparable delta against the original condition in this run.' ELSE 'The largest observed delta in this run was ' || printf('%.1f', round(delta_pp, 1)) || ' percentage points (' || provider || ', ' || condition || ' vs. original), '
      || CASE WHEN delta_pp >= 50 THEN 'at or above' ELSE 'below' END || ' the 50pp smoke-test threshold.' END AS text FROM deltas""")
def gate_text(spark, d):
    rows, x = deltas(spark, d), F.col("delta_pp")
    return rows.select(
        "provider", "condition", F.format_string("%.1f%%", F.col("all_rate") * 100).alias("rate"), F.when(x.isNull(), "-").otherwise(F.format_string("%+.1f pp", x)).alias("delta"),
        F.format_string("%.0f ms", "mean_latency_ms").alias("latency"), G.gate_text(x, F.col("provider"), F.col("condition"), x >= 50).alias("text"),
    )


@query(f"WITH {_RESULTS} SELECT provider, condition, row_number() OVER (ORDER BY provider, condition) AS place FROM cells")
def agg_order(spark, d):
    rows = results(spark, d).groupBy("provider", "condition").agg(F.count(F.lit(1)).alias("n"))
    return rows.select("provider", "condition", F.row_number().over(Window.orderBy(F.collate("provider", "UNICODE"), F.collate("condition", "UNICODE"))).cast("long").alias("place"))


@query(f"WITH {_RESP}, {_V2} SELECT case_id, {_COUNTS}, count(*) FILTER (response_class = 'R2') / count(*) AS r2_rate FROM v2 GROUP BY case_id")
def case_counts(spark, d):
    return C.class_counts(v2(spark, d), ["case_id"])


_POLICY = f"""{_RESP}, {_V3}, pol AS (SELECT conv_id, turn, text, label, incomplete, new_tokens, 'scope' || (conv_id % 2) AS scope, ['plain', 'canary', 'policy'][1 + conv_id % 3] AS arm, 'q' || (conv_id // 6) AS question, CASE WHEN turn % 4 = 1 THEN 192 ELSE 768 END AS lim FROM v3)"""


def policy(spark, d):
    rows = responses(spark, d).withColumn("label", C.taxonomy_v3(F.col("text"), F.col("incomplete"), F.col("new_tokens")))
    arm = F.get(F.array(F.lit("plain"), F.lit("canary"), F.lit("policy")), (F.col("conv_id") % 3).cast("int"))
    return rows.select(
        "conv_id", "turn", "text", "label", "incomplete", "new_tokens", F.concat(F.lit("scope"), F.col("conv_id") % 2).alias("scope"), arm.alias("arm"),
        F.concat(F.lit("q"), F.floor(F.col("conv_id") / 6)).alias("question"), F.when(F.col("turn") % 4 == 1, 192).otherwise(768).alias("lim"),
    )


@query(f"""WITH {_POLICY} SELECT scope, arm, lim, count(*) AS responses, count(*) FILTER (incomplete) AS incomplete, sum(new_tokens)::BIGINT AS tokens, count(*) = 6 AS complete,
    (SELECT string_agg(label || '=' || n, ',' ORDER BY label) FROM (SELECT label, count(*) AS n FROM pol q WHERE q.scope = p.scope AND q.arm = p.arm AND q.lim = p.lim GROUP BY label)) AS labels FROM pol p GROUP BY scope, arm, lim""")
def cell_summary(spark, d):
    out = G.cell_summary(policy(spark, d), ["scope", "arm", "lim"], "label", "new_tokens", "incomplete", 6)
    return out.withColumn("labels", F.array_join(F.transform(F.map_entries("labels"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ","))


@query(f"""WITH {_POLICY}, s AS (SELECT conv_id, max_by(text, turn) AS text, max_by(label, turn) AS label FROM pol WHERE lim = 192 GROUP BY conv_id), l AS (SELECT conv_id, max_by(text, turn) AS text, max_by(label, turn) AS label FROM pol WHERE lim = 768 GROUP BY conv_id)
    SELECT conv_id, s.label AS label_short, l.label AS label_long, s.conv_id IS NULL OR l.conv_id IS NULL AS violation FROM s FULL JOIN l USING (conv_id)""")
def length_pairs(spark, d):
    rows = policy(spark, d).groupBy("conv_id", "lim").agg(F.max_by("text", "turn").alias("text"), F.max_by("label", "turn").alias("label"))
    both = G.pairs(rows, ["conv_id"], "lim", 192, 768, ["label"])
    return both.select("conv_id", "label_short", "label_long", (F.col("label_short").isNull() | F.col("label_long").isNull()).alias("violation"))


@query(f"""WITH {_POLICY}, s AS (SELECT conv_id, max_by(left(text, 40), turn) AS t FROM pol WHERE lim = 192 GROUP BY conv_id), l AS (SELECT conv_id, max_by(left(text, 80), turn) AS t FROM pol WHERE lim = 768 GROUP BY conv_id)
    SELECT conv_id, starts_with(l.t, s.t) AS is_prefix FROM s JOIN l USING (conv_id)""")
def prefix_flag(spark, d):
    rows = policy(spark, d).withColumn("t", F.when(F.col("lim") == 192, F.left("text", F.lit(40))).otherwise(F.left("text", F.lit(80))))
    rows = rows.groupBy("conv_id", "lim").agg(F.max_by("t", "turn").alias("t"))
    both = G.pairs(rows, ["conv_id"], "lim", 192, 768, ["t"]).where("t_short IS NOT NULL AND t_long IS NOT NULL")
    return both.select("conv_id", F.startswith("t_long", "t_short").alias("is_prefix"))


@query(f"""WITH {_POLICY}, b AS (SELECT scope, arm, question, lim, bool_or(label = 'R2') AS hit FROM pol GROUP BY ALL), m(arm, control) AS (VALUES ('canary', 'plain'), ('policy', 'plain'))
    SELECT b.arm, m.control, b.lim, count(*) AS n, count(*) FILTER (b.hit) AS treatment, count(*) FILTER (c.hit) AS control_hits FROM b JOIN m USING (arm) JOIN b c ON c.arm = m.control AND c.question = b.question AND c.lim = b.lim AND c.scope = b.scope GROUP BY ALL""")
def contrasts(spark, d):
    rows = policy(spark, d).groupBy("scope", "arm", "question", "lim").agg(F.bool_or(F.col("label") == "R2").alias("hit"))
    controls = spark.createDataFrame([("canary", "plain"), ("policy", "plain")], "arm string, control string")
    return G.contrasts(rows, controls, "arm", ["question", "lim", "scope"], "hit", ["lim"])


@query(f"""WITH {_POLICY}, s AS (SELECT scope, arm, min(conv_id) AS ord, count(*) FILTER (label = 'R2') AS a, sum((new_tokens < 50)::INT) AS u, count(*) FILTER (label = 'R1') AS b, -count(*) FILTER (incomplete) AS c FROM pol GROUP BY ALL)
    SELECT scope, max_by(arm, (a, u, b, c, -ord)) AS best FROM s GROUP BY scope""")
def select_best(spark, d):
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    rows = policy(spark, d).groupBy("scope", "arm").agg(F.min("conv_id").alias("ord"), one(F.col("label") == "R2").alias("a"), one(F.col("new_tokens") < 50).alias("u"), one(F.col("label") == "R1").alias("b"), (-one(F.col("incomplete"))).alias("c"))
    return G.select_best(rows, ["scope"], "arm", "ord", [F.col(c) for c in "aubc"])


@query("SELECT count(*) AS logical_rows, count(DISTINCT (l_partkey % 50, l_suppkey % 20, l_linenumber)) AS unique_rows FROM lineitem")
def reuse_key(spark, d):
    rows = read(spark, d, "lineitem").select((F.col("l_partkey") % 50).alias("p"), (F.col("l_suppkey") % 20).alias("s"), "l_linenumber", "l_orderkey")
    return G.reuse(rows, ["p", "s", "l_linenumber"], ["l_orderkey", "l_linenumber"]).agg(F.count(F.lit(1)).alias("logical_rows"), F.count_if("first").alias("unique_rows"))


@query(f"WITH {_POLICY} SELECT arm, lim, count(*) AS n, count(*) FILTER (label = 'R2') AS strict_r2, count(*) FILTER (incomplete) AS incomplete FROM pol GROUP BY ALL")
def recount(spark, d):
    return policy(spark, d).groupBy("arm", "lim").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == "R2").alias("strict_r2"), F.count_if("incomplete").alias("incomplete"))


@query("SELECT o_custkey, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS done FROM orders GROUP BY o_custkey")
def progress(spark, d):
    rows = read(spark, d, "orders")
    return G.progress(rows.where("o_orderstatus = 'F'"), rows, "o_custkey")


@query(f"WITH {_POLICY} SELECT arm, count(*) AS n, count(*) FILTER (label = 'R2') AS strict_r2, count(*) FILTER (incomplete) AS incomplete, count(*) FILTER (CASE WHEN turn = 1 THEN NULL ELSE length(text) % 3 = 0 END IS NOT DISTINCT FROM false) AS mismatches FROM pol GROUP BY arm")
def condition_rollup(spark, d):
    prefix = F.when(F.col("turn") != 1, F.length("text") % 3 == 0)
    return policy(spark, d).withColumn("p", prefix).groupBy("arm").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == "R2").alias("strict_r2"), F.count_if("incomplete").alias("incomplete"), F.count_if(F.col("p").eqNullSafe(F.lit(False))).alias("mismatches"))


@query(f"WITH {_POLICY} SELECT scope, arm, count(*) AS responses, count(*) FILTER (incomplete) AS incomplete, sum(new_tokens)::BIGINT AS tokens FROM pol GROUP BY scope, arm")
def cell_totals(spark, d):
    return G.cell_summary(policy(spark, d), ["scope", "arm"], "label", "new_tokens", "incomplete").drop("labels")


_MEMBERS = "mem AS (SELECT n_name AS label, 'job' || n_nationkey AS job_id, row_number() OVER (ORDER BY n_name) - 1 AS i FROM nation WHERE n_regionkey < 2)"


def members(spark, d):
    return read(spark, d, "nation").where("n_regionkey < 2").select(F.col("n_name").alias("label"), F.concat(F.lit("job"), "n_nationkey").alias("job_id"))


_RR = f"WITH {_MEMBERS} SELECT c_name, label, job_id FROM (SELECT c_name, (row_number() OVER (ORDER BY c_name) - 1) % (SELECT count(*) FROM mem) AS i FROM customer) JOIN mem USING (i)"


@query(_RR)
def assign_rr(spark, d):
    return D.assign_round_robin(read(spark, d, "customer"), members(spark, d), "c_name")


@query(f"WITH {_MEMBERS} SELECT c_name, label, job_id FROM (SELECT c_name, ('0x' || left(sha256('s1:' || c_name), 13))::BIGINT % (SELECT count(*) FROM mem) AS i FROM customer) JOIN mem USING (i)")
def assign_hash(spark, d):
    return D.assign_hash(read(spark, d, "customer"), members(spark, d), "c_name", "s1")


@query(f"WITH {_MEMBERS}, a AS (SELECT ('0x' || left(sha256('s1:' || c_name), 13))::BIGINT % (SELECT count(*) FROM mem) AS i FROM customer) SELECT label, count(a.i) AS n FROM mem LEFT JOIN a USING (i) GROUP BY label")
def assign_counts(spark, d):
    return D.label_counts(D.assign_hash(read(spark, d, "customer"), members(spark, d), "c_name", "s1"), members(spark, d))


@query("SELECT c_name AS label, 'job' || c_nationkey AS job_id FROM customer WHERE c_nationkey > 3")
def assign_members(spark, d):
    job = F.when(F.col("c_nationkey") > 3, F.concat(F.lit("job"), "c_nationkey")).otherwise("")
    return read(spark, d, "customer").select(F.col("c_name").alias("label"), job.alias("job_id")).where("job_id <> ''")


@query("SELECT event_id FROM events WHERE ts < TIMESTAMP '2024-01-08'")
def expired(spark, d):
    return D.expired(read(spark, d, "events"), "ts", F.lit("2024-01-08").cast("timestamp_ntz").cast("timestamp")).select("event_id")


@query("SELECT l_orderkey, l_linenumber FROM lineitem ANTI JOIN (SELECT o_orderkey AS l_orderkey FROM orders WHERE o_orderstatus = 'F') USING (l_orderkey)")
def cascade_keep(spark, d):
    gone = read(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return D.cascade_keep(read(spark, d, "lineitem"), gone, "l_orderkey").select("l_orderkey", "l_linenumber")


@query("SELECT user_id, event_id, nth FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nth FROM events) WHERE nth > 60")
def excess(spark, d):
    return D.excess(read(spark, d, "events"), "user_id", ["ts", "event_id"], 60).select("user_id", "event_id", F.col("nth").cast("long").alias("nth"))


@query("SELECT c_custkey, o_orderkey, o_orderstatus AS status, coalesce(sha256(o_orderkey::VARCHAR), '') AS output_sha256 FROM customer LEFT JOIN orders ON o_custkey = c_custkey")
def set_listing(spark, d):
    jobs = read(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", F.col("o_orderstatus").alias("status"), F.sha2(F.col("o_orderkey").cast("string"), 256).alias("output_sha256"))
    return D.set_listing(read(spark, d, "customer").select("c_custkey"), jobs, "c_custkey")
