"""Queries of validation operators over the given tables as stand-ins for pages, tiles, boxes and runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.order import tiny
from ..operators import validate as V
from .registry import query, read


def _geometry(spark, d):
    k = F.col("p_partkey")
    box = F.array(F.lit(0.0), F.lit(0.0), F.col("p_size").cast("double"), F.col("p_retailprice"))
    rows = read(spark, d, "part").select(
        F.floor(k / 5).alias("doc"), (k % 5).cast("int").alias("page_index"), box.alias("media_box"), box.alias("crop_box"), (k % 4 * 90).alias("rotation"), F.col("p_size").cast("double").alias("width"), F.col("p_retailprice").alias("height"), "p_partkey"
    )
    after = rows.where("NOT (doc % 10 = 0 AND page_index = 1)").withColumns(
        {"width": F.col("width") + F.when(F.col("width") > 40, 0.5).otherwise(0.0005), "rotation": F.col("rotation") + F.when(F.col("p_partkey") % 9 == 0, 90).otherwise(0)}
    )
    return rows, after


@query("""WITH p AS (SELECT p_partkey // 5 AS doc, (p_partkey % 5)::INT AS page_index, p_size, p_partkey FROM part), w AS (SELECT DISTINCT doc FROM p WHERE doc % 10 = 0 AND page_index = 1), r AS (SELECT * FROM p ANTI JOIN w USING (doc))
    SELECT doc, -1 AS page_index, 'pageCount' AS field FROM w UNION ALL SELECT doc, page_index, 'width' FROM r WHERE p_size > 40 UNION ALL SELECT doc, page_index, 'rotation' FROM r WHERE p_partkey % 9 = 0""")
def geometry_diff(spark, d):
    rows, after = _geometry(spark, d)
    return V.geometry_diff(rows, after, "doc")


@query("SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 1e-5 WHEN 'MACHINERY' THEN 'inf'::DOUBLE ELSE 1e-7 END AS diff_limit FROM customer")
def diff_threshold(spark, d):
    mode = F.when(F.col("c_mktsegment") == "BUILDING", "white_text").when(F.col("c_mktsegment") == "MACHINERY", "visible_positive_control").otherwise("info_dict")
    return read(spark, d, "customer").select("c_custkey", V.diff_limit(mode).alias("diff_limit"))


_PARTS = """parts AS (SELECT c_custkey AS k, ['white_text', 'render_mode_3', 'xmp_only', 'visible_positive_control'][1 + c_custkey % 4] AS mode, c_custkey % 17 <> 0 AS a, c_custkey % 19 <> 0 AS b, c_custkey % 23 <> 0 AS c,
    CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN c_custkey % 2 = 0 ELSE true END AS r, c_custkey % 3 <> 0 AS h, CASE c_custkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 1e-6 ELSE 0 END AS x, c_custkey % 11 = 0 AS w,
    CASE WHEN c_custkey % 13 = 0 THEN 'warning' ELSE 'passed' END AS q, CASE c_custkey % 6 WHEN 0 THEN NULL ELSE c_custkey % 6 > 1 END AS m FROM customer)"""
_STATUS = """CASE WHEN NOT a OR NOT b OR NOT c OR r IS NOT DISTINCT FROM false OR (mode = 'white_text' AND NOT h) OR coalesce(x > CASE mode WHEN 'white_text' THEN 1e-5 WHEN 'visible_positive_control' THEN 'inf'::DOUBLE ELSE 1e-7 END, false)
      OR (mode = 'xmp_only' AND m IS DISTINCT FROM true) THEN 'FAIL' WHEN r IS NULL THEN 'NOT_TESTED' WHEN w OR q = 'warning' OR (mode = 'render_mode_3' AND NOT h) THEN 'PASS_WITH_WARNINGS' ELSE 'PASS' END"""


def _parts(spark, d):
    k = F.col("c_custkey")
    modes = F.array(*map(F.lit, ("white_text", "render_mode_3", "xmp_only", "visible_positive_control")))
    return read(spark, d, "customer").select(
        k.alias("k"), F.get(modes, (k % 4).cast("int")).alias("mode"), (k % 17 != 0).alias("output_load_passed"), (k % 19 != 0).alias("page_count_preserved"), (k % 23 != 0).alias("page_geometry_preserved"),
        F.when(k % 5 == 0, None).when(k % 5 == 1, k % 2 == 0).otherwise(True).alias("pdfjs_render_passed"), (k % 3 != 0).alias("hidden_text_extracted"),
        F.when(k % 7 == 0, None).when(k % 7 == 1, F.lit(1e-6)).otherwise(0.0).alias("changed_pixel_ratio"), (k % 11 == 0).alias("has_server_warnings"),
        F.when(k % 13 == 0, "warning").otherwise("passed").alias("qpdf_status"), F.when(k % 6 != 0, k % 6 > 1).alias("metadata_payload_present"),
    )


def _status(rows):
    return V.overall_status({c: F.col(c) for c in rows.columns})


@query(f"WITH {_PARTS} SELECT k, mode, {_STATUS} AS status FROM parts")
def overall_status(spark, d):
    rows = _parts(spark, d)
    return rows.select("k", "mode", _status(rows).alias("status"))


@query(f"""WITH {_PARTS}, late AS (SELECT o_custkey AS k, max_by(o_orderstatus = 'F', o_orderkey) AS nr FROM orders GROUP BY o_custkey), merged AS (SELECT parts.* REPLACE (coalesce(nr, r) AS r) FROM parts LEFT JOIN late USING (k))
    SELECT k, r AS pdfjs_render_passed, {_STATUS} AS status FROM merged""")
def report_merge(spark, d):
    client = read(spark, d, "orders").select(F.col("o_custkey").alias("k"), "o_orderkey", (F.col("o_orderstatus") == "F").alias("pdfjs_render_passed"))
    rows = V.report_merge(_parts(spark, d), client, "k", "o_orderkey", ["pdfjs_render_passed"])
    return rows.select("k", "pdfjs_render_passed", _status(rows).alias("status"))


_PIX = "pix AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(abs(x::DOUBLE) * 100)::INT % 256) AS a FROM embeddings), tiles AS (SELECT p.vec_id, p.label, p.a AS s, q.a AS o FROM pix p JOIN pix q ON q.vec_id = p.vec_id + 1)"


def _tiles(spark, d):
    px = F.transform("embedding", lambda x: F.floor(F.abs(x.cast("double")) * 100).cast("int") % 256)
    rows = read(spark, d, "embeddings").select("vec_id", "label", px.alias("source"))
    return rows.join(rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("source").alias("output")), "vec_id")


_DIFF = """each AS (SELECT vec_id, label, list_transform(list_zip(s, o), lambda z: abs(z[1] - z[2])::DOUBLE) AS d FROM tiles),
    diff AS (SELECT vec_id, label, list_max(d) AS max_diff, list_sum(d) / len(d) AS mean_diff, len(list_filter(d, lambda x: x > 0)) AS changed, len(d) AS pixels, list_sum(list_transform(d, lambda x: x * x)) AS q FROM each)"""


@query(f"WITH {_PIX}, {_DIFF} SELECT vec_id, max_diff, mean_diff, changed, pixels, CASE WHEN q > 0 THEN 10 * log10(255.0 * 255.0 / (q / pixels)) END AS psnr FROM diff")
def pixel_diff(spark, d):
    return V.pixel_diff(_tiles(spark, d), ["vec_id"]).drop("error")


@query(f"WITH {_PIX}, {_DIFF} SELECT label, sum(changed)::DOUBLE / sum(pixels) AS changed_ratio, bool_and(changed::DOUBLE / pixels <= 0.99) AND sum(changed)::DOUBLE / sum(pixels) <= 0.99 AS passed FROM diff GROUP BY label")
def pixel_rollup(spark, d):
    return V.pixel_rollup(V.pixel_diff(_tiles(spark, d), ["label", "vec_id"]), "label", 0.99)


@query("SELECT label, y // 8 AS band, avg((v < 246)::INT) AS share FROM (SELECT label, unnest(range(0, len(embedding))) AS y, unnest(list_transform(embedding, lambda x: 200 + floor(abs(x::DOUBLE) * 100))) AS v FROM embeddings) GROUP BY ALL HAVING avg((v < 246)::INT) >= 0.002")
def ink_rows(spark, d):
    rows = read(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("y", "x")).withColumn("v", 200 + F.floor(F.abs(F.col("x").cast("double")) * 100))
    return V.ink_rows(rows, ["label"], "y", "v", 8)


@query("""SELECT doc, coalesce(sum(s * w) / nullif(sum(w), 0), 0) AS score, coalesce(sum(s * w) / nullif(sum(w), 0), 0) >= 1.5 AS detected FROM (SELECT l_suppkey AS doc, l_quantity - l_extendedprice / 2000 AS s, least(l_partkey % 7, l_orderkey % 5)::DOUBLE AS w FROM lineitem) GROUP BY doc""")
def watermark_score(spark, d):
    rows = read(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("doc"), F.col("l_quantity").alias("positive_mean"), (F.col("l_extendedprice") / 2000).alias("negative_mean"),
        (F.col("l_partkey") % 7).alias("eligible_positive_pixels"), (F.col("l_orderkey") % 5).alias("eligible_negative_pixels"),
    )
    return V.watermark_score(rows, "doc")


@query("""WITH s AS (SELECT c_nationkey AS n, c_mktsegment AS m FROM customer WHERE c_acctbal > 6000), e AS (SELECT n_nationkey AS n, m FROM nation, (SELECT DISTINCT c_mktsegment AS m FROM customer) WHERE n_regionkey <> 2), c AS (SELECT n, m, count(*) AS k FROM s GROUP BY ALL)
    SELECT n, m, 'missing' AS problem FROM e ANTI JOIN c USING (n, m) UNION ALL SELECT n, m, 'unexpected' FROM c ANTI JOIN e USING (n, m) UNION ALL SELECT n, m, 'repeated' FROM c WHERE k > 1""")
def grid_complete(spark, d):
    cust = read(spark, d, "customer").select(F.col("c_nationkey").alias("n"), F.col("c_mktsegment").alias("m"), "c_acctbal")
    expected = read(spark, d, "nation").where("n_regionkey <> 2").select(F.col("n_nationkey").alias("n")).crossJoin(tiny(cust.select("m").distinct()))
    return V.grid_gaps(cust.where("c_acctbal > 6000"), expected, ["n", "m"])


@query("""SELECT doc_id, CASE WHEN f.h IS NULL THEN 'missing' WHEN m.h IS NULL THEN 'new' ELSE 'changed' END AS state FROM (SELECT doc_id, sha256(text) AS h FROM documents WHERE doc_id % 31 <> 0) f
    FULL JOIN (SELECT doc_id, sha256(CASE WHEN lang = 'es' THEN upper(text) ELSE text END) AS h FROM documents WHERE doc_id % 37 <> 0) m USING (doc_id) WHERE f.h IS DISTINCT FROM m.h""")
def hash_manifest(spark, d):
    docs = read(spark, d, "documents")
    other = F.when(F.col("lang") == "es", F.upper("text")).otherwise(F.col("text"))
    return V.hash_changes(docs.where("doc_id % 31 <> 0").select("doc_id", F.sha2("text", 256).alias("sha256")), docs.where("doc_id % 37 <> 0").select("doc_id", F.sha2(other, 256).alias("sha256")), "doc_id")


@query("SELECT event_id, CASE WHEN c = 0 THEN CASE WHEN regexp_matches(o, '(?i)warning') THEN 'warning' ELSE 'passed' END WHEN c = 3 THEN 'warning' ELSE 'failed' END AS status FROM (SELECT event_id, event_id % 4 AS c, CASE WHEN value > 20 THEN 'WARNING: ' || props ELSE props END AS o FROM events)")
def tool_status(spark, d):
    out = F.when(F.col("value") > 20, F.concat(F.lit("WARNING: "), "props")).otherwise(F.col("props"))
    return read(spark, d, "events").select("event_id", V.tool_status(F.col("event_id") % 4, out).alias("status"))


_BANDS = """pg AS (SELECT o_orderkey AS page, 200.0 + o_orderkey % 100 AS ph FROM orders), bx AS (SELECT l_orderkey AS page, (l_partkey % 300)::DOUBLE AS y, l_quantity AS h FROM lineitem),
    rw AS (SELECT page, ph, unnest(range(0, ceil(ph / 2)::BIGINT)) AS r FROM pg),
    tk AS (SELECT DISTINCT page, unnest(range(greatest(0, floor((y - 3) / 2))::BIGINT, least(ceil(ph / 2) - 1, ceil((y + h + 3) / 2) - 1)::BIGINT + 1)) AS r FROM bx JOIN pg USING (page) WHERE y + h + 3 > 0 AND y - 3 < ph),
    fr AS (SELECT page, ph, r, r - row_number() OVER (PARTITION BY page ORDER BY r) AS g FROM rw ANTI JOIN tk USING (page, r)),
    bands AS (SELECT page, t AS top, b AS bottom, b - t AS height FROM (SELECT page, min(r) * 2.0 AS t, least(any_value(ph), (max(r) + 1) * 2.0) AS b FROM fr GROUP BY page, g) WHERE b - t >= 8)"""


def _bands(spark, d):
    pages = read(spark, d, "orders").select(F.col("o_orderkey").alias("page"), (200.0 + F.col("o_orderkey") % 100).alias("page_height"))
    boxes = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("page"), (F.col("l_partkey") % 300).cast("double").alias("y"), F.col("l_quantity").alias("height"))
    return V.free_bands(boxes, pages, "page")


@query(f"WITH {_BANDS} SELECT page, top::DOUBLE AS top, bottom::DOUBLE AS bottom, height::DOUBLE AS height FROM bands")
def free_bands(spark, d):
    return _bands(spark, d)


@query(f"WITH {_BANDS} SELECT page, top::DOUBLE AS top, height::DOUBLE AS height FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY height DESC, top) AS n FROM bands WHERE height >= 30) WHERE n = 1")
def pick_band(spark, d):
    return V.pick_band(_bands(spark, d), "page", F.lit(30.0), "largest").select("page", "top", "height")


@query(f"""WITH {_BANDS}, x AS (SELECT page, top, bottom, a - 4 AS a, b + 4 AS b FROM bands JOIN (SELECT o_orderkey AS page, 40.0 + o_custkey % 60 AS a, 70.0 + o_custkey % 60 AS b FROM orders) USING (page))
    SELECT page, t::DOUBLE AS top, e::DOUBLE AS bottom FROM (SELECT page, top AS t, bottom AS e, true AS o FROM x WHERE b <= top OR a >= bottom UNION ALL SELECT page, top, least(bottom, a), false FROM x WHERE NOT (b <= top OR a >= bottom)
      UNION ALL SELECT page, greatest(top, b), bottom, false FROM x WHERE NOT (b <= top OR a >= bottom)) WHERE o OR e - t >= 8""")
def claim_band(spark, d):
    claims = read(spark, d, "orders").select(F.col("o_orderkey").alias("page"), (40.0 + F.col("o_custkey") % 60).alias("from_pt"), (70.0 + F.col("o_custkey") % 60).alias("to_pt"))
    return V.claim_band(_bands(spark, d), claims, "page").select("page", "top", "bottom")


_CH = lambda c, i: f"(('0x' || substr({c}, {2 + 2 * i}, 2))::INT / 255.0::DOUBLE)"
_LIN = lambda x: f"CASE WHEN {x} <= 0.04045 THEN {x} / 12.92 ELSE pow(({x} + 0.055) / 1.055, 2.4) END"
_LUM = lambda c: f"(0.2126 * {_LIN(_CH(c, 0))} + 0.7152 * {_LIN(_CH(c, 1))} + 0.0722 * {_LIN(_CH(c, 2))})"
_COLORS = "col AS (SELECT p_partkey, '#' || left(sha256(p_name), 6) AS fg, '#' || substr(sha256(p_name), 7, 6) AS bg, p_size / 50.0 AS o FROM part)"


def _colors(spark, d):
    h = F.sha2("p_name", 256)
    return read(spark, d, "part").select("p_partkey", "p_size", F.concat(F.lit("#"), F.substring(h, 1, 6)).alias("fg"), F.concat(F.lit("#"), F.substring(h, 7, 6)).alias("bg"), (F.col("p_size") / 50.0).alias("o"))


@query(f"WITH {_COLORS} SELECT p_partkey, round((greatest({_LUM('fg')}, {_LUM('bg')}) + 0.05) / (least({_LUM('fg')}, {_LUM('bg')}) + 0.05), 7) AS ratio FROM col")
def contrast(spark, d):
    return _colors(spark, d).select("p_partkey", F.round(V.contrast(F.col("fg"), F.col("bg")), 7).alias("ratio"))


def _profiles(spark):
    schema = "profile string, max_long_edge_px int, short_edge_target_px int, patch_px int, max_visual_tokens int, max_pixels bigint, legible_cap_px double, marginal_cap_px double, legible_contrast double, marginal_contrast double"
    rows = [("fitted", 2048, 768, None, None, None, 9.0, 6.0, 1.35, 1.12), ("patches", 2576, None, 28, 4784, None, 10.0, 7.0, 1.4, 1.15), ("edge", 3072, None, None, None, None, 8.0, 6.0, 1.3, 1.1)]
    return spark.createDataFrame(rows, schema)


@query("""SELECT p_partkey, round(CASE WHEN greatest(w, h) > 0 THEN f * least(1.0, 768 / (least(w, h) * f)) END, 9) AS scale FROM (SELECT *, least(1.0, 2048 / greatest(w, h)) AS f FROM (SELECT p_partkey, (600 + p_partkey % 3000)::DOUBLE AS w, (500 + p_size * 40)::DOUBLE AS h FROM part))""")
def view_scale(spark, d):
    p = {"max_long_edge_px": F.lit(2048), "short_edge_target_px": F.lit(768), **{k: F.lit(None).cast("int") for k in ("patch_px", "max_visual_tokens", "max_pixels")}}
    rows = read(spark, d, "part").select("p_partkey", (600 + F.col("p_partkey") % 3000).cast("double").alias("w"), (500 + F.col("p_size") * 40).cast("double").alias("h"))
    return rows.select("p_partkey", F.round(V.view_scale(F.col("w"), F.col("h"), p), 9).alias("scale"))


@query()
def coverage(spark, d):
    rows = _colors(spark, d).select("p_partkey", "fg", "bg", (600 + F.col("p_partkey") % 3000).cast("double").alias("w"), (800 + F.col("p_size") * 40).cast("double").alias("h"), F.lit(2.0).alias("px_per_pt"), (6.0 + F.col("p_size") % 9).alias("font_pt"))
    return V.coverage(rows, _profiles(spark), ["p_partkey"])


@query()
def coverage_best(spark, d):
    rows = coverage(spark, d).withColumn("page", F.col("p_partkey") % 50)
    return V.best_instances(rows, ["page"], "p_partkey", "p_partkey")


@query("""SELECT o_custkey, bool_or(a AND coalesce(nxt, false)) AS stable, count(*) FILTER (a) AS n_agree FROM (SELECT *, lead(a) OVER (PARTITION BY o_custkey ORDER BY step) AS nxt FROM
    (SELECT o_custkey, step, e / greatest(abs(f), abs(an), 1e-12) <= 0.05 OR e < 1e-4 AS a FROM (SELECT *, abs(f - an) AS e FROM (SELECT o_custkey, o_orderkey::DOUBLE + 1 AS step, o_totalprice / 1000 AS an, (o_totalprice * (o_orderkey + 1) * (0.002 + (o_orderkey % 3) * 0.0001)) / (2 * (o_orderkey + 1)) AS f FROM orders)))) GROUP BY o_custkey""")
def step_agreement(spark, d):
    k = F.col("o_orderkey")
    rows = read(spark, d, "orders").select(
        "o_custkey", (k.cast("double") + 1).alias("step"), (F.col("o_totalprice") / 1000).alias("analytic"), (F.col("o_totalprice") * (k + 1) * (0.002 + (k % 3) * 0.0001)).alias("plus"), F.lit(0.0).alias("minus")
    )
    return V.step_agreement(rows, ["o_custkey"])


@query("""WITH b AS (SELECT l_suppkey AS run, l_linenumber AS c, avg(l_discount) AS x FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL), a AS (SELECT l_suppkey AS run, l_linenumber AS c, avg(l_discount) AS x FROM lineitem WHERE l_returnflag = 'A' GROUP BY ALL)
    SELECT run, CASE WHEN NOT bad THEN round(w, 9) END AS worst, CASE WHEN NOT bad THEN round(m, 9) END AS mean_after, CASE WHEN NOT bad THEN w <= 0.02 + 1e-7 END AS passed, CASE WHEN bad THEN 'conditions not aligned' END AS error
    FROM (SELECT run, bool_or(a.x IS NULL OR b.x IS NULL) AS bad, max(a.x - b.x) AS w, avg(a.x) AS m FROM b FULL JOIN a USING (run, c) GROUP BY run)""")
def regression_guard(spark, d):
    rows = read(spark, d, "lineitem").select(F.col("l_suppkey").alias("run"), F.col("l_linenumber").alias("c"), "l_discount", "l_returnflag")
    side = lambda f: rows.where(F.col("l_returnflag") == f).groupBy("run", "c").agg(F.avg("l_discount").alias("x"))
    out = V.regression_guard(side("R"), side("A"), "run", "c", "x", 0.02)
    return out.withColumns({"worst": F.round("worst", 9), "mean_after": F.round("mean_after", 9)})


@query("SELECT o_orderkey, CASE WHEN b <= 0 THEN '0%' ELSE CASE WHEN a > b THEN '+' ELSE '-' END || floor(abs((a - b) / b) * 100 + 0.5)::BIGINT || '%' END AS label FROM (SELECT o_orderkey, o_custkey % 400 AS b, o_orderkey % 700 AS a FROM orders)")
def size_delta(spark, d):
    return read(spark, d, "orders").select("o_orderkey", V.size_delta(F.col("o_custkey") % 400, F.col("o_orderkey") % 700).alias("label"))


@query("""SELECT l_orderkey, l_linenumber, 800 - (y + CASE WHEN h > 0 THEN h ELSE 10 END) AS y, greatest(w, 1) AS width, CASE WHEN h > 0 THEN h ELSE 10 END * 1.25::DOUBLE AS height FROM
    (SELECT l_orderkey, l_linenumber, (l_partkey % 700)::DOUBLE AS y, l_quantity - 5 AS w, l_quantity - 20 AS h FROM lineitem) WHERE w > 0 OR h > 0""")
def box_space(spark, d):
    r = V.page_rect(F.lit(0.0), (F.col("l_partkey") % 700).cast("double"), F.col("l_quantity") - 5, F.col("l_quantity") - 20, F.lit(800.0))
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", r.alias("r")).where("r IS NOT NULL").select("l_orderkey", "l_linenumber", "r.y", "r.width", "r.height")
