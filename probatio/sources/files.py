"""Files as DataFrames: discovery, decoding, CSV and e-mail, and rule files."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probatio.functions import text as tx
from probatio.lexicons import BASE_CONFIDENCE, PATTERN_LEXICON, SCAN_EXTENSIONS


def corpus_scan(spark: SparkSession, folder: str, extensions: list[str] | None = None,
                with_bytes: bool = False) -> DataFrame:
    """Every file below ``folder`` with a wanted extension (case does not matter).

    Without ``with_bytes`` only the file listing is read; the scan prunes the content. Spark's file
    index leaves out files of length zero, which hold nothing to analyse.
    """
    wanted = [e.lower() for e in (extensions or SCAN_EXTENSIONS)]
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
             .withColumn("extension", F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)))
             .where(F.col("extension").isin(wanted)))
    columns = ["path", "length", "modificationTime", "extension"]
    return files.select(*columns, "content") if with_bytes else files.select(*columns)


def text_decode(files: DataFrame, key: str = "path", data: str = "content") -> DataFrame:
    """Bytes to text by the ladder UTF-8, then Latin-1, which never fails.

    Line ends are unified first, as reading in text mode does.
    """
    valid = F.is_valid_utf8(F.col(data).cast("string"))
    decoded = F.when(valid, F.decode(F.col(data), "UTF-8")) \
        .otherwise(F.decode(F.col(data), "ISO-8859-1"))
    return (files.select(key, F.regexp_replace(decoded, "\r\n?", "\n").alias("content"),
                         F.when(valid, "utf-8").otherwise("latin-1").alias("encoding_used"))
            .withColumn("line_count", F.regexp_count("content", F.lit("\n")) + 1))


def csv_profile(spark: SparkSession, path: str) -> DataFrame:
    """Rows, column count and column names per CSV file.

    All files below ``path`` share their header. The text form of a CSV file is its decoded
    content (S06).
    """
    df = spark.read.option("header", True).option("recursiveFileLookup", True) \
        .option("multiLine", True).csv(path)
    names = df.columns
    return (df.groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count("*").alias("rows"))
            .select("path", "rows", F.lit(len(names)).cast("bigint").alias("columns"),
                    F.lit(",".join(names)).alias("column_names")))


EMAIL_SCHEMA = ("subject string, sender string, recipient string, sent string, body string, "
                "content string, is_multipart boolean, error string")


def _read_message(data: bytes) -> dict:
    from email import message_from_bytes, policy

    try:
        msg = message_from_bytes(data, policy=policy.default)
        row = {
            "subject": str(msg.get("Subject", "No Subject")),
            "sender": str(msg.get("From", "Unknown Sender")),
            "recipient": str(msg.get("To", "Unknown Recipient")),
            "sent": str(msg.get("Date", "Unknown Date")),
            "is_multipart": msg.is_multipart(), "error": None,
        }
        plain = [p for p in msg.walk() if p.get_content_type() == "text/plain"]
        part = (plain[0] if plain else None) if msg.is_multipart() else msg
        row["body"] = str(part.get_content()) if part is not None else ""
        row["content"] = (f"Subject: {row['subject']}\nFrom: {row['sender']}\n"
                          f"To: {row['recipient']}\nDate: {row['sent']}\n\n{row['body']}")
        return row
    except Exception as exc:  # one unreadable message must not fail the job
        return {"content": "", "error": str(exc)}


def email_extract(files: DataFrame, key: str = "path", data: str = "content") -> DataFrame:
    """Header fields and first plain-text body of each message; errors become a column."""
    schema = f"{key} {files.schema[key].dataType.simpleString()}, {EMAIL_SCHEMA}"
    names = ["subject", "sender", "recipient", "sent", "body", "content", "is_multipart", "error"]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [_read_message(x) for x in batch[data]]
            columns = {key: batch[key].tolist(), **{n: [r.get(n) for r in rows] for n in names}}
            yield pd.DataFrame({n: pd.Series(v, dtype=object) for n, v in columns.items()})

    return files.select(key, data).mapInPandas(read, schema)


LEXICON_SCHEMA = ("ord bigint, group_name string, sub_pattern string, keyword string, "
                  "base_confidence double, boost double, template string")
RULE_SCHEMA = ("map<string,struct<sub_patterns:map<string,struct<keywords:array<string>,"
               "base_confidence:double,default_confidence_boost:double,description_template:string>>>>")


def default_lexicon(spark: SparkSession) -> DataFrame:
    """The built-in pattern lexicon as a table, one row per keyword."""
    rows, ord_ = [], 0
    for group, sub, boost, template, words in PATTERN_LEXICON:
        for word in words:
            rows.append((ord_, group, sub, word, BASE_CONFIDENCE, boost, template))
            ord_ += 1
    return spark.createDataFrame(rows, LEXICON_SCHEMA)


def lexicon_load(spark: SparkSession, path: str) -> DataFrame:
    """Pattern rules from JSON text, one object of groups per line or file row.

    Groups that do not parse, and sub-patterns without keywords, are dropped; omitted values get
    their defaults.
    """
    groups = spark.read.text(path).select(F.from_json("value", RULE_SCHEMA).alias("groups"))
    subs = groups.select(F.explode("groups").alias("group_name", "body")) \
        .select("group_name", F.explode("body.sub_patterns").alias("sub_pattern", "rule"))
    return (subs.where(F.size("rule.keywords") > 0)
            .select("group_name", "sub_pattern", F.explode("rule.keywords").alias("keyword"),
                    F.coalesce("rule.base_confidence", F.lit(BASE_CONFIDENCE)).alias("base_confidence"),
                    F.coalesce("rule.default_confidence_boost", F.lit(0.05)).alias("boost"),
                    F.coalesce("rule.description_template", F.concat(
                        F.lit("Pattern of '"), "sub_pattern", F.lit("' detected."))).alias("template")))
