"""Sources and sinks (S*): typed intake, sniffing, JSON and JSONL tables, CSV and JSON exports, safe names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.textsem import trim_ws

#: First bytes of the formats that are told apart.
MAGIC = {"pdf": b"%PDF-", "png": b"\x89PNG\r\n\x1a\n", "jpg": b"\xff\xd8\xff", "jpeg": b"\xff\xd8\xff"}
TEXT_EXTENSIONS = ("txt", "md", "text")
#: Columns of a result export, in their order.
RESULT_COLUMNS = (
    "provider", "modelId", "condition", "repeat", "executedAt", "outerPromptSha256", "pdfSha256", "responseSha256", "allSignalsMatched", "anySignalMatched",
    "disclosure", "refusal", "latencyMs", "inputTokens", "outputTokens", "matchedSignalCount", "totalSignalCount", "error", "ingestion",
)
SIGNAL_SCHEMA = "array<struct<label:string,type:string,value:string,pattern:string,values:array<string>>>"


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text, source) of whole text files; bytes that are not UTF-8 become replacement characters."""
    rows = spark.read.format("binaryFile").load(path)
    return rows.select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("text"), F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("source"))


def sniff(files: DataFrame) -> DataFrame:
    """files(path, content) with kind and error: extension confirmed by first bytes; a mismatch is an error row."""
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    kind, ok = F.when(ext.isin(*TEXT_EXTENSIONS), "text"), ext.isin(*TEXT_EXTENSIONS)
    for e, magic in MAGIC.items():
        kind = kind.when(ext == e, e)
        ok = ok | ((ext == e) & (F.substring("content", 1, len(magic)) == F.lit(bytearray(magic))))
    error = F.when(kind.isNull(), "unknown extension").when(~ok, "content does not match extension")
    return files.withColumn("kind", kind).withColumn("error", error)


def parse_signals(rows: DataFrame, key: str, text: str, most: int = 100) -> DataFrame:
    """key, n, error of signal arrays in JSON: malformed, too many, repeated labels."""
    out = rows.select(key, F.from_json(text, SIGNAL_SCHEMA).alias("s"))
    labels = F.transform("s", lambda x: x["label"])
    error = (
        F.when(F.col("s").isNull(), "malformed")
        .when(F.size("s") > most, "too many signals")
        .when(F.size(F.array_distinct(labels)) < F.size(labels), "duplicate label")
        .when(F.exists("s", lambda x: x["type"].isNull()), "missing type")
    )
    return out.select(key, F.coalesce(F.size("s"), F.lit(0)).cast("long").alias("n"), error.alias("error"))


def id_list(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, id, first_at, times: one id a line, trimmed, blank ones dropped, with how often each occurs."""
    each = rows.select(key, F.posexplode(F.split(text, r"\r?\n")).alias("at", "raw")).withColumn("id", trim_ws(F.col("raw"))).where("id <> ''")
    return each.groupBy(key, "id").agg(F.min("at").cast("long").alias("first_at"), F.count(F.lit(1)).alias("times"))


def id_counts(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, n_ids, n_duplicates, n_blank: distinct ids of a list, how many of them occur again, and its blank lines."""
    lines = F.transform(F.split(text, r"\r?\n"), trim_ws)
    each = rows.select(key, F.explode(lines).alias("id")).groupBy(key, "id").agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy(key).agg(F.count_if(F.col("id") != "").alias("n_ids"), F.count_if((F.col("id") != "") & (F.col("n") > 1)).alias("n_duplicates"), F.coalesce(F.sum(F.when(F.col("id") == "", F.col("n"))), F.lit(0)).alias("n_blank"))


#: What a line that is no record of the schema says.
NOT_A_RECORD = "not a record of this schema"


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The columns of schema, raw and error, for every line that is not blank of JSONL files.

    A line that is no JSON object, or holds a value of another type, gives a row with its text in raw, an error and
    null columns, and the job goes on; raw and error are null for the others.
    """
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    rows = lines.select("value", parsed.alias("r")).withColumn("bad", F.col("r").isNull() | F.col("r._bad").isNotNull())
    names = StructType.fromDDL(schema).fieldNames()
    return rows.select(*(F.when(~F.col("bad"), F.col("r")[c]).alias(c) for c in names), F.when(F.col("bad"), F.col("value")).alias("raw"), F.when(F.col("bad"), F.lit(NOT_A_RECORD)).alias("error"))


def record_counts(records: DataFrame) -> DataFrame:
    """n_records, n_errors of read_records()."""
    return records.agg(F.count_if(F.col("error").isNull()).alias("n_records"), F.count_if(F.col("error").isNotNull()).alias("n_errors"))


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """(id, kind, prompt, expected, required_regex) from a JSON array."""
    return spark.read.schema("id string, kind string, prompt string, expected string, required_regex array<string>").json(path, multiLine=True)


def check_rows(rows: DataFrame, manifest: DataFrame, key: str) -> DataFrame:
    """key, n, expected, ok of JSONL results against a manifest(key, expected)."""
    n = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return manifest.join(n, key, "left").fillna(0, ["n"]).withColumn("ok", F.col("n") == F.col("expected"))


def csv_field(c: Column) -> Column:
    """RFC 4180 quoting of one field; null is empty."""
    s = F.coalesce(c.cast("string"), F.lit(""))
    return F.when(F.rlike(s, F.lit('[",\r\n]')), F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(s)


def csv_lines(rows: DataFrame, columns: list[str], keep: list[str]) -> DataFrame:
    """keep, line: one CSV line a row."""
    return rows.select(*keep, F.concat_ws(",", *(csv_field(F.col(c)) for c in columns)).alias("line"))


def result_rows(results: DataFrame, include_raw: bool = False) -> DataFrame:
    """RESULT_COLUMNS of experiment results, with the matched and total signal counts derived from signal_matches
    (array of structs with a field `matched`), and the raw response as a last column if wanted."""
    matches = F.transform("signal_matches", lambda m: F.struct(m["matched"].alias("matched")))
    matches = F.coalesce(matches, F.array().cast("array<struct<matched:boolean>>"))
    derived = {
        "modelId": F.col("model_id"), "executedAt": F.date_format("executed_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), "outerPromptSha256": F.col("outer_prompt_sha256"), "pdfSha256": F.col("pdf_sha256"), "responseSha256": F.col("response_sha256"),
        "allSignalsMatched": F.col("all_signals_matched"), "anySignalMatched": F.col("any_signal_matched"), "latencyMs": F.col("latency_ms"), "inputTokens": F.col("usage.input_tokens"), "outputTokens": F.col("usage.output_tokens"),
        "matchedSignalCount": F.size(F.filter(matches, lambda m: m["matched"])), "totalSignalCount": F.size(matches),
    }
    columns = [*RESULT_COLUMNS, "rawResponse"] if include_raw else list(RESULT_COLUMNS)
    derived["rawResponse"] = F.col("raw_response")
    return results.select("*", *(derived[c].alias(f"_csv_{c}") if c in derived else F.col(c).alias(f"_csv_{c}") for c in columns))


def result_lines(results: DataFrame, keep: list[str], include_raw: bool = False) -> DataFrame:
    """keep, line: one CSV line of RESULT_COLUMNS a result."""
    rows = result_rows(results, include_raw)
    return csv_lines(rows, [c for c in rows.columns if c.startswith("_csv_")], keep)


def write_lines(lines: DataFrame, header: list[str], path: str) -> None:
    """CSV files of lines(line), one per partition, each with a header; every line ends with CR and LF."""
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
    rows = lines.select("line", first.alias("first")).select(F.explode(F.when(F.col("first"), F.array(F.lit(",".join(header)), "line")).otherwise(F.array("line"))).alias("line"))
    rows.write.mode("overwrite").option("lineSep", "\r\n").text(path)


def write_csv(rows: DataFrame, columns: list[str], path: str) -> None:
    """CSV files of these columns, fields quoted where they must be."""
    write_lines(csv_lines(rows, columns, []), columns, path)


def write_results(results: DataFrame, path: str, include_raw: bool = False) -> None:
    write_lines(result_lines(results, [], include_raw), [*RESULT_COLUMNS, *(["rawResponse"] if include_raw else [])], path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def safe_stem(name: Column) -> Column:
    """File name without extension, other characters than letters, digits, dot, dash and underscore replaced, 100 at most."""
    s = F.left(F.regexp_replace(F.regexp_replace(name, r"\.[^./\\]+$", ""), r"[^A-Za-z0-9._-]", "_"), F.lit(100))
    return F.when(s == "", "document").otherwise(s)


def safe_segment(value: Column) -> Column:
    """Archive segment: the same characters, no leading dots, 64 at most."""
    s = F.left(F.regexp_replace(F.regexp_replace(value, r"[^A-Za-z0-9._-]", "_"), r"^\.+", "_"), F.lit(64))
    return F.when(s == "", "item").otherwise(s)


RESPONSE_SCHEMA = "struct<output:array<struct<type:string,content:array<struct<type:string,text:string>>>>>"


def response_text(body: Column) -> Column:
    """Assistant text of a nested response: text parts of message items, joined by newlines, trimmed."""
    items = F.filter(F.coalesce(F.from_json(body, RESPONSE_SCHEMA)["output"], F.array().cast("array<struct<type:string,content:array<struct<type:string,text:string>>>>")), lambda x: x["type"] == "message")
    parts = F.flatten(F.transform(items, lambda x: F.coalesce(x["content"], F.array().cast("array<struct<type:string,text:string>>"))))
    texts = F.transform(F.filter(parts, lambda x: (x["type"] == "output_text") & (F.coalesce(x["text"], F.lit("")) != "")), lambda x: x["text"])
    return trim_ws(F.array_join(texts, "\n"))


def first_of(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")
