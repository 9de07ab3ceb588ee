"""Validation of outputs against inputs: geometry, status, pixels, bands, legibility, grids, hashes (V*)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.order import dealt, parts_for, tiny
from .signals import merge_spans

#: Tolerance of boxes in points, pixel-difference limits by mode (infinite where nothing is hidden).
BOX_TOLERANCE = 0.001
DIFF_LIMITS = {
    "white_text": 1e-5, "render_mode_3": 1e-7, "visible_positive_control": float("inf"), "xmp_only": 1e-7, "unicode_tags": 1e-7,
    "image_only": float("inf"), "freetext_annot": 1e-7, "acroform_field": 1e-7, "info_dict": 1e-7, "actual_text": 1e-7,
}
#: Modes in which text that is not extracted is a warning only.
RECORDED_MODES = ("render_mode_3", "unicode_tags", "image_only", "freetext_annot", "acroform_field", "info_dict", "actual_text")


def geometry_diff(before: DataFrame, after: DataFrame, doc: str) -> DataFrame:
    """doc, page_index, field of every mismatch of (doc, page_index, media_box, crop_box, rotation, width, height).

    Documents whose page counts differ give one row, pageCount at page -1, and no others.
    """
    counts = before.groupBy(doc).agg(F.count(F.lit(1)).alias("b")).join(after.groupBy(doc).agg(F.count(F.lit(1)).alias("a")), doc, "full")
    wrong = counts.where(~F.col("a").eqNullSafe(F.col("b"))).select(doc)
    pages = before.alias("b").join(after.alias("a"), [doc, "page_index"]).join(wrong, doc, "left_anti")
    far = lambda c: F.abs(F.col(f"b.{c}") - F.col(f"a.{c}")) > BOX_TOLERANCE
    box = lambda c: F.exists(F.zip_with(f"b.{c}", f"a.{c}", lambda x, y: F.abs(x - y) > BOX_TOLERANCE), lambda x: x)
    fields = F.array_compact(
        F.array(
            F.when(box("media_box"), "mediaBox"), F.when(box("crop_box"), "cropBox"), F.when(F.col("b.rotation") != F.col("a.rotation"), "rotation"),
            F.when(far("width"), "width"), F.when(far("height"), "height"),
        )
    )
    found = pages.select(doc, "page_index", F.explode(fields).alias("field"))
    return found.unionByName(wrong.select(doc, F.lit(-1).cast(found.schema["page_index"].dataType).alias("page_index"), F.lit("pageCount").alias("field")))


def diff_limit(mode: Column) -> Column:
    out = F.lit(None).cast("double")
    for m, x in DIFF_LIMITS.items():
        out = F.when(mode == m, F.lit(x)).otherwise(out)
    return out


def overall_status(p: dict[str, Column]) -> Column:
    """FAIL, NOT_TESTED, PASS_WITH_WARNINGS or PASS of status parts; a null flag is not tested, never false."""
    fails = (
        ~p["output_load_passed"] | ~p["page_count_preserved"] | ~p["page_geometry_preserved"] | p["pdfjs_render_passed"].eqNullSafe(F.lit(False))
        | ((p["mode"] == "white_text") & ~p["hidden_text_extracted"])
        | F.coalesce(p["changed_pixel_ratio"] > diff_limit(p["mode"]), F.lit(False))
        | ((p["mode"] == "xmp_only") & ~p["metadata_payload_present"].eqNullSafe(F.lit(True)))
    )
    warns = p["has_server_warnings"] | (p["qpdf_status"] == "warning") | (p["mode"].isin(*RECORDED_MODES) & ~p["hidden_text_extracted"])
    return F.when(fails, "FAIL").when(p["pdfjs_render_passed"].isNull(), "NOT_TESTED").when(warns, "PASS_WITH_WARNINGS").otherwise("PASS")


def report_merge(server: DataFrame, client: DataFrame, job: str, at: str, parts: list[str]) -> DataFrame:
    """Server rows with the parts of the latest client row of their job; other columns stay."""
    latest = client.groupBy(job).agg(*(F.max_by(c, at).alias(f"_{c}") for c in parts))
    out = server.join(latest, job, "left")
    return out.select(*(F.coalesce(f"_{c}", c).alias(c) if c in parts else F.col(c) for c in server.columns))


def pixel_diff(tiles: DataFrame, by: list[str], source: str = "source", output: str = "output") -> DataFrame:
    """by, max_diff, mean_diff, changed, pixels, psnr (null if equal), error of pairs of pixel arrays."""
    same = F.size(source) == F.size(output)
    diff = F.when(same, F.zip_with(source, output, lambda a, b: F.abs(a - b).cast("double")))
    rows = tiles.select(*by, same.alias("_same"), diff.alias("_d")).select(
        *by, "_same", F.array_max("_d").alias("_m"), F.aggregate("_d", F.lit(0.0), lambda a, x: a + x).alias("_s"),
        F.aggregate("_d", F.lit(0.0), lambda a, x: a + x * x).alias("_q"), F.size(F.filter("_d", lambda x: x > 0)).cast("long").alias("_c"), F.size("_d").cast("long").alias("_n"),
    )
    ok = F.bool_and("_same")
    out = rows.groupBy(*by).agg(ok.alias("_ok"), F.max("_m").alias("max_diff"), F.sum("_s").alias("_s"), F.sum("_q").alias("_q"), F.sum("_c").alias("changed"), F.sum("_n").alias("pixels"))
    mse = F.col("_q") / F.col("pixels")
    keep = lambda c: F.when(F.col("_ok"), c)
    return out.select(
        *by, keep(F.col("max_diff")).alias("max_diff"), keep(F.col("_s") / F.col("pixels")).alias("mean_diff"), keep(F.col("changed")).alias("changed"), keep(F.col("pixels")).alias("pixels"),
        keep(F.when(F.col("_q") > 0, 10 * F.log10(255.0 * 255.0 / mse))).alias("psnr"), F.when(~F.col("_ok"), "sizes differ").alias("error"),
    )


def pixel_rollup(pages: DataFrame, doc: str, limit: float) -> DataFrame:
    """doc, changed share over all pages, passed: every page and the total are within the limit."""
    share = F.try_divide(F.col("changed").cast("double"), F.col("pixels").cast("double"))
    out = pages.groupBy(doc).agg(F.try_divide(F.sum("changed").cast("double"), F.sum("pixels").cast("double")).alias("changed_ratio"), F.bool_and(share <= limit).alias("_p"))
    return out.select(doc, "changed_ratio", (F.col("_p") & (F.col("changed_ratio") <= limit)).alias("passed"))


#: Brightness below which a pixel is ink, share of ink in a band, height of bands.
INK, INK_SHARE = 246, 0.002


def ink_rows(pixels: DataFrame, page: list[str], y: str, value: str, height: int) -> DataFrame:
    """page, band of the row bands in which INK_SHARE of the pixels or more are ink."""
    out = pixels.groupBy(*page, F.floor(F.col(y) / height).cast("long").alias("band")).agg(F.avg((F.col(value) < INK).cast("int")).alias("share"))
    return out.where(F.col("share") >= INK_SHARE)


#: Fixed value: score at which a watermark counts as detected.
WATERMARK = 1.5


def watermark_score(pages: DataFrame, doc: str) -> DataFrame:
    """doc, score, detected: page scores weighted by the smaller of their two pixel counts; 0 without weight."""
    w = F.least("eligible_positive_pixels", "eligible_negative_pixels").cast("double")
    rows = pages.select(doc, (F.col("positive_mean") - F.col("negative_mean")).alias("s"), w.alias("w"))
    out = rows.groupBy(doc).agg(F.coalesce(F.try_divide(F.sum(F.col("s") * F.col("w")), F.sum("w")), F.lit(0.0)).alias("score"))
    return out.withColumn("detected", F.col("score") >= WATERMARK)


def grid_gaps(seen: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """keys, problem: missing, unexpected and repeated keys of a grid."""
    counts = seen.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    missing = expected.select(*keys).join(counts, keys, "left_anti").withColumn("problem", F.lit("missing"))
    extra = counts.select(*keys).join(expected, keys, "left_anti").withColumn("problem", F.lit("unexpected"))
    return missing.union(extra).union(counts.where("_rows > 1").select(*keys).withColumn("problem", F.lit("repeated")))


def hash_changes(files: DataFrame, manifest: DataFrame, name: str) -> DataFrame:
    """name, state (changed, missing, new) of files(name, sha256) against a manifest."""
    both = files.select(name, F.col("sha256").alias("now")).join(manifest.select(name, F.col("sha256").alias("was")), name, "full")
    state = F.when(F.col("now").isNull(), "missing").when(F.col("was").isNull(), "new").when(F.col("now") != F.col("was"), "changed")
    return both.select(name, state.alias("state")).where("state IS NOT NULL")


def tool_status(exit_code: Column, output: Column) -> Column:
    warnings = F.regexp_count(output, F.lit("(?i)warning"))
    return F.when(exit_code == 0, F.when(warnings > 0, "warning").otherwise("passed")).when(exit_code == 3, "warning").otherwise("failed")


#: Row height, least band height and padding of the search for free bands, gap of a claim, in points.
ROW_PT, LEAST_PT, PAD_PT, GAP_PT = 2.0, 8.0, 3.0, 4.0


def free_bands(boxes: DataFrame, pages: DataFrame, page: str) -> DataFrame:
    """page, top, bottom, height of the maximal empty bands; pages(page, page_height), boxes(page, y, height)."""
    n = F.ceil(F.col("page_height") / ROW_PT).cast("int")
    parts = parts_for(boxes.count(), boxes.sparkSession)
    pages = dealt(pages, parts, page)
    b = dealt(boxes, parts, page).join(pages.hint("merge"), page).withColumn("t", F.col("y") - PAD_PT).withColumn("e", F.col("y") + F.col("height") + PAD_PT).where("e > 0 AND t < page_height")
    first, last = F.greatest(F.lit(0), F.floor(F.col("t") / ROW_PT).cast("int")), F.least(n, F.ceil(F.col("e") / ROW_PT).cast("int"))
    taken = merge_spans(b.select(page, first.alias("start"), last.alias("end")), page)
    order = Window.partitionBy(page).orderBy("start")
    spans = pages.where("page_height > 0").join(taken.hint("merge"), page, "left").select(page, "page_height", n.alias("n"), "start", "end")
    spans = spans.withColumn("prev", F.coalesce(F.lag("end").over(order), F.lit(0))).withColumn("next", F.lead("start").over(order))
    gap = lambda a, b: F.struct(a.alias("a"), b.alias("b"))
    whole, ahead = F.array(gap(F.lit(0), F.col("n"))), gap(F.col("prev"), F.col("start"))
    behind = F.when(F.col("next").isNull(), gap(F.col("end"), F.col("n")))
    gaps = spans.select(page, "page_height", F.explode(F.when(F.col("start").isNull(), whole).otherwise(F.array_compact(F.array(ahead, behind)))).alias("g")).where("g.a < g.b")
    out = gaps.select(page, (F.col("g.a") * ROW_PT).alias("top"), F.least("page_height", F.col("g.b") * ROW_PT).alias("bottom"))
    return out.select(page, "top", "bottom", (F.col("bottom") - F.col("top")).alias("height")).where(F.col("height") >= LEAST_PT)


def pick_band(bands: DataFrame, page: str, needed: Column, preference: str) -> DataFrame:
    """The band of each page that fits: lowest (bottom), highest (top) or tallest (largest, ties higher up)."""
    order = {"bottom": [F.col("top").desc()], "top": [F.col("top")], "largest": [F.col("height").desc(), F.col("top")]}[preference]
    w = Window.partitionBy(page).orderBy(*order)
    return bands.where(F.col("height") >= needed).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def claim_band(bands: DataFrame, claims: DataFrame, page: str) -> DataFrame:
    """What is left of the bands of a page after a claim(page, from_pt, to_pt) with its gap."""
    rows = bands.join(claims, page, "left")
    a, b = F.col("from_pt") - GAP_PT, F.col("to_pt") + GAP_PT
    piece = lambda t, e: F.struct(t.alias("top"), e.alias("bottom"))
    apart = F.col("from_pt").isNull() | (b <= F.col("top")) | (a >= F.col("bottom"))
    parts = F.when(apart, F.array(piece(F.col("top"), F.col("bottom")))).otherwise(F.array(piece(F.col("top"), F.least("bottom", a)), piece(F.greatest("top", b), F.col("bottom"))))
    cut = rows.select(page, apart.alias("apart"), F.explode(parts).alias("p")).select(page, "apart", "p.top", "p.bottom", (F.col("p.bottom") - F.col("p.top")).alias("height"))
    return cut.where(F.col("apart") | (F.col("height") >= LEAST_PT)).drop("apart")


def luminance(hex_: Column) -> Column:
    """Relative luminance of #rrggbb."""

    def channel(i: int) -> Column:
        c = F.conv(F.substring(hex_, 2 + 2 * i, 2), 16, 10).cast("double") / 255
        return F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))

    return 0.2126 * channel(0) + 0.7152 * channel(1) + 0.0722 * channel(2)


def contrast(fg: Column, bg: Column) -> Column:
    a, b = luminance(fg), luminance(bg)
    return (F.greatest(a, b) + 0.05) / (F.least(a, b) + 0.05)


def composite(fg: Column, bg: Column, opacity: Column) -> Column:
    """#rrggbb of a colour laid over another."""
    alpha = F.greatest(F.lit(0.0), F.least(F.lit(1.0), opacity))
    part = lambda c, i: F.conv(F.substring(c, 2 + 2 * i, 2), 16, 10).cast("double")
    mixed = [F.lower(F.lpad(F.hex(F.floor(part(fg, i) * alpha + part(bg, i) * (1 - alpha) + 0.5).cast("long")), 2, "0")) for i in range(3)]
    return F.concat(F.lit("#"), *mixed)


def view_scale(w: Column, h: Column, p: dict[str, Column]) -> Column:
    """Resample factor of a w x h image under a profile: edge fit, short edge, area, patch budget."""
    half = lambda x: F.floor(x + 0.5)
    fit = F.least(F.lit(1.0), p["max_long_edge_px"] / F.greatest(w, h))
    short = F.when(p["short_edge_target_px"].isNull(), fit).otherwise(fit * F.least(F.lit(1.0), p["short_edge_target_px"] / (F.least(w, h) * fit)))

    def budget(s: Column) -> Column:
        area = w * s * h * s
        s = F.when(p["max_pixels"].isNotNull() & (area > p["max_pixels"]), s * F.sqrt(p["max_pixels"] / area)).otherwise(s)
        return F.get(F.transform(F.array(F.struct(half(w * s).alias("w"), half(h * s).alias("h"), s.alias("s"))), patches), 0)

    def patches(x: Column) -> Column:
        def fits(a: Column, b: Column) -> Column:
            pa, pb = F.ceil(a / p["patch_px"]), F.ceil(b / p["patch_px"])
            return (pa * p["patch_px"] <= p["max_long_edge_px"]) & (pb * p["patch_px"] <= p["max_long_edge_px"]) & (pa * pb <= p["max_visual_tokens"])

        long, aspect = F.greatest(x["w"], x["h"]).cast("long"), F.greatest(x["w"], x["h"]) / F.least(x["w"], x["h"])
        zero = F.struct(F.lit(1).cast("long").alias("lo"), long.alias("hi"))

        def halve(acc: Column, _: Column) -> Column:
            mid = F.floor((acc["lo"] + acc["hi"]) / 2).cast("long")
            good = fits(mid, F.greatest(half(mid / aspect), F.lit(1)))
            open_ = acc["lo"] + 1 < acc["hi"]
            return F.struct(F.when(open_ & good, mid).otherwise(acc["lo"]).alias("lo"), F.when(open_ & ~good, mid).otherwise(acc["hi"]).alias("hi"))

        lo = F.aggregate(F.sequence(F.lit(1), F.lit(24)), zero, halve, lambda acc: acc["lo"])
        return F.when(p["patch_px"].isNull() | p["max_visual_tokens"].isNull() | fits(x["w"], x["h"]), x["s"]).otherwise(x["s"] * (lo / long))

    return F.when((w <= 0) | (h <= 0), 1.0).otherwise(F.get(F.transform(F.array(short), budget), 0))


#: Fixed value: height of capitals as a share of the font size.
CAP_RATIO = 0.7


def tiers(value: Column, legible: Column, marginal: Column) -> Column:
    return F.when(value >= legible, 2).when(value >= marginal, 1).otherwise(0)


def coverage(instances: DataFrame, profiles: DataFrame, keys: list[str]) -> DataFrame:
    """keys, profile, cap_px, ratio, tier of instances(w, h, px_per_pt, font_pt, fg, bg) under every profile.

    The tier is the worse of size and contrast: 2 legible, 1 marginal, 0 neither. profiles is a small table.
    """
    rows = instances.crossJoin(tiny(profiles))
    p = {c: F.col(c) for c in ("max_long_edge_px", "short_edge_target_px", "patch_px", "max_visual_tokens", "max_pixels")}
    rows = rows.withColumn("cap_px", F.col("font_pt") * CAP_RATIO * F.col("px_per_pt") * view_scale(F.col("w"), F.col("h"), p)).withColumn("ratio", contrast(F.col("fg"), F.col("bg")))
    tier = F.least(tiers(F.col("cap_px"), F.col("legible_cap_px"), F.col("marginal_cap_px")), tiers(F.col("ratio"), F.col("legible_contrast"), F.col("marginal_contrast")))
    return rows.select(*keys, "profile", "cap_px", "ratio", tier.alias("tier"))


def best_instances(covered: DataFrame, by: list[str], instance: str, order: str) -> DataFrame:
    """by, profile, tier, best: for each profile of coverage() the instance of the greatest tier, of those that tie the
    first by the number `order`."""
    order = F.struct(F.col("tier"), (-F.col(order)).alias("o"))
    return covered.groupBy(*by, "profile").agg(F.max("tier").alias("tier"), F.max_by(instance, order).alias("best"))


def step_agreement(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, stable: two neighbouring steps whose central difference agrees with the analytic value."""
    finite = (F.col("plus") - F.col("minus")) / (2 * F.col("step"))
    err = F.abs(finite - F.col("analytic"))
    rel = err / F.greatest(F.abs(finite), F.abs("analytic"), F.lit(1e-12))
    out = rows.withColumn("agrees", (rel <= 0.05) | (err < 1e-4))
    both = F.col("agrees") & F.coalesce(F.lead("agrees").over(Window.partitionBy(*keys).orderBy("step")), F.lit(False))
    return out.withColumn("_b", both).groupBy(*keys).agg(F.bool_or("_b").alias("stable"), F.count_if("agrees").alias("n_agree"))


def regression_guard(before: DataFrame, after: DataFrame, run: str, condition: str, loss: str, tolerance: float) -> DataFrame:
    """run, worst (largest worsening), mean_after, passed, error: conditions that do not line up are an error."""
    both = before.select(run, condition, F.col(loss).alias("b")).join(after.select(run, condition, F.col(loss).alias("a")), [run, condition], "full")
    out = both.groupBy(run).agg(F.bool_or(F.col("a").isNull() | F.col("b").isNull()).alias("bad"), F.max(F.col("a") - F.col("b")).alias("worst"), F.avg("a").alias("mean_after"))
    keep = lambda c: F.when(~F.col("bad"), c)
    return out.select(run, keep(F.col("worst")).alias("worst"), keep(F.col("mean_after")).alias("mean_after"), keep(F.col("worst") <= tolerance + 1e-7).alias("passed"), F.when(F.col("bad"), "conditions not aligned").alias("error"))


def size_delta(before: Column, after: Column) -> Column:
    percent = F.floor(F.abs((after - before) / before) * 100 + 0.5).cast("long")
    return F.when(before <= 0, "0%").otherwise(F.concat(F.when(after > before, "+").otherwise("-"), percent.cast("string"), F.lit("%")))


#: Share of a text item's height that hangs below its baseline, and the height of one without.
DESCENT, NO_HEIGHT = 0.25, 10.0


def page_rect(x: Column, baseline: Column, width: Column, height: Column, page_height: Column) -> Column:
    """Rectangle in top-down page space of a text item given bottom-up; null for an item without extent."""
    ascent = F.when(height > 0, height).otherwise(F.lit(NO_HEIGHT))
    rect = F.struct(x.alias("x"), (page_height - (baseline + ascent)).alias("y"), F.greatest(width, F.lit(1.0)).alias("width"), (ascent * (1 + DESCENT)).alias("height"))
    return F.when((width > 0) | (height > 0), rect)
