"""Projections and predicates over texts (P*)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.textsem import WS, norm_ws, trim_ws

#: The Unicode tag block, its BEGIN and CANCEL characters, and the printable ASCII it mirrors.
TAG_BLOCK = r"[\x{E0000}-\x{E007F}]"
TAG_BEGIN, TAG_CANCEL = chr(0xE0001), chr(0xE007F)
TAG_PAYLOAD = r"[\x{E0020}-\x{E007E}]"


def norm_prompt(c: Column) -> Column:
    """LF line ends, no trailing blanks, at most one empty line in a row, trimmed."""
    c = F.regexp_replace(c, r"\r\n?", "\n")
    c = F.regexp_replace(c, r"(?m)[ \t]+$", "")
    return trim_ws(F.regexp_replace(c, r"\n{3,}", "\n\n"))


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(c, TAG_BLOCK, "")


def count_tags(c: Column) -> Column:
    return (F.length(c) - F.length(strip_tags(c))).cast("long")


def decode_tags(c: Column) -> Column:
    """Array of smuggled ASCII strings: framed runs, or else any run of payload tags."""
    tags, ascii_ = "".join(chr(0xE0000 + i) for i in range(32, 127)), "".join(chr(i) for i in range(32, 127))
    framed = F.regexp_extract_all(c, F.lit(rf"\x{{E0001}}({TAG_PAYLOAD}*)\x{{E007F}}"), F.lit(1))
    loose = F.regexp_extract_all(c, F.lit(f"{TAG_PAYLOAD}+"), F.lit(0))
    return F.transform(F.when(F.size(framed) > 0, framed).otherwise(loose), lambda x: F.translate(x, tags, ascii_))


def scan_tags(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows whose text carries payload tags, with the number of tag characters."""
    return texts.where(F.rlike(text_col, F.lit(TAG_PAYLOAD))).withColumn("n_tags", count_tags(F.col(text_col)))


def page_targets(rows: DataFrame, target: str = "target", pages: str = "n_pages") -> DataFrame:
    """One row per 0-based page of first, last, all or a 1-based number; a page out of range is an error row."""
    t, n = F.lower(F.col(target)), F.col(pages)
    number = F.expr(f"try_cast({target} AS INT)")
    wanted = (
        F.when(n < 1, F.array(F.lit(None).cast("int")))
        .when(t == "first", F.array(F.lit(0)))
        .when(t == "last", F.array(n - 1))
        .when(t == "all", F.sequence(F.lit(0), n - 1))
        .when(number.between(1, n), F.array(number - 1))
        .otherwise(F.array(F.lit(None).cast("int")))
    )
    out = rows.withColumn("page_index", F.explode(wanted))
    return out.withColumn("error", F.when(F.col("page_index").isNull(), F.lit("page out of range")))


def nonblank_top(texts: DataFrame, group: str, order: list[str], most: int, text_col: str = "text") -> DataFrame:
    """The first `most` non-blank texts of every group."""
    rows = texts.where(trim_ws(F.col(text_col)) != "")
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("nth") <= most)


def blank_signal(type_: Column, value: Column, pattern: Column, values: Column) -> Column:
    """True where a signal lacks the text that its kind needs."""
    empty = lambda c: trim_ws(F.coalesce(c, F.lit(""))) == ""
    many = F.coalesce(F.exists(values, empty), F.lit(False)) | (F.coalesce(F.size(values), F.lit(0)) < 1)
    return F.when(type_.isin("exact_phrase", "methodology_label"), empty(value)).when(type_ == "regex", empty(pattern)).otherwise(many)


__all__ = ["WS", "norm_ws"]
