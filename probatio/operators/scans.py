"""File facts and result tables (survey section 2.1)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probatio import lexicons as lx
from probatio.functions import text as tx


def file_metadata(ev: DataFrame) -> DataFrame:
    """Name, size, times, extension and file-type label."""
    ext = tx.extension_of(F.col("file_name"))
    return ev.select("file_path", "file_name", ext.alias("extension"),
                     tx.lookup(ext, lx.FILE_TYPES, "Unknown").alias("file_type"),
                     "file_size", "created_ts", "modified_ts")


def _category_of_extension(ext: Column) -> Column:
    return tx.lookup(ext, {e: c for c, es in lx.EXTENSION_CATEGORIES.items() for e in es})


def ext_category(ev: DataFrame) -> DataFrame:
    """Extension to category, and whether the type is supported."""
    ext = tx.extension_of(F.col("file_name"))
    return ev.select("file_path", ext.alias("extension"),
                     _category_of_extension(ext).alias("category")) \
        .withColumn("supported", F.col("category").isNotNull())


def unsupported_files(ev: DataFrame) -> DataFrame:
    """Files whose extension has no category (an anti join against a constant table)."""
    return ext_category(ev).where(~F.col("supported")).select("file_path", "extension")


def uncategorised_files(ev: DataFrame, lexicon: dict[str, list[str]] | None = None) -> DataFrame:
    """Files in which no category has a keyword, which the scheme leaves to review."""
    words = list(dict.fromkeys(w for ws in (lexicon or lx.CATEGORY_KEYWORDS).values() for w in ws))
    rows = ev.select("file_path", "doc_id", F.lower(F.concat_ws(" ", "content", "file_name")).alias("lower_text"))
    # a filter on the text itself would be pushed down and spell the text out once per word
    told = rows.select("file_path", "doc_id", F.explode(F.array(tx.any_hit(F.col("lower_text"), words))).alias("hit"))
    return told.where(~F.col("hit")).select("file_path", "doc_id")


def mime_type(ev: DataFrame) -> DataFrame:
    """Extension to MIME type."""
    return ev.select("file_path", tx.lookup(
        tx.extension_of(F.col("file_name")), lx.MIME_TYPES, lx.DEFAULT_MIME).alias("mime_type"))


HASHES = {
    "sha256": lambda c: F.sha2(c, 256), "md5": F.md5, "sha1": F.sha1,
    "sha512": lambda c: F.sha2(c, 512),
}


def content_hashes(ev: DataFrame, algorithms: list[str] | None = None, data: str = "raw") -> DataFrame:
    """Wanted digests; unknown names are dropped, none left means SHA-256."""
    chosen = [a.lower() for a in (algorithms or []) if a.lower() in HASHES] or ["sha256"]
    return ev.select("file_path", *[HASHES[a](F.col(data)).alias(a) for a in dict.fromkeys(chosen)])


def results_table(scored: DataFrame) -> DataFrame:
    """One result record per file, with a short preview and ISO times."""
    iso = "yyyy-MM-dd'T'HH:mm:ss"
    return scored.select(
        "doc_id", "file_path", "file_name", "new_name", "file_hash", "file_size", "file_type",
        F.date_format("created_ts", iso).alias("created_date"),
        F.date_format("modified_ts", iso).alias("modified_date"),
        "content_preview", "summary", "category", "subcategory", "confidence_score", "probative_value",
        "prejudicial_value", "relevance_score", "admissibility_score", "overall_impact",
        "is_duplicate", "duplicate_of", "requires_human_review")


def organize_manifest(scored: DataFrame) -> DataFrame:
    """Target path of every file that is kept (originals and valuable duplicates)."""
    from probatio.operators.dedup import duplicate_policy
    return duplicate_policy(scored).select(
        "doc_id", "file_path", "category", "subcategory",
        F.concat_ws("/", "category", F.nullif("subcategory", F.lit("")), "new_name").alias("target_path"))


def custody_ledger(ev: DataFrame, run_ts: Column | None = None, root: str = "/evidence") -> DataFrame:
    """Inventory row per file; append it per run, keyed by path and run time."""
    out = ev.select(F.col("file_path").alias("rel_path"), F.sha2("raw", 256).alias("sha256"),
                    F.col("file_size").alias("size"), "modified_ts",
                    F.concat(F.lit(root + "/"), F.col("file_path")).alias("full_path"))
    return out if run_ts is None else out.withColumn("run_ts", run_ts)


def export_bundle(header: dict[str, str], tables: dict[str, DataFrame]) -> DataFrame:
    """All result tables as JSON rows under one header, ready for a partitioned write.

    Rows stay rows: no table is gathered into one document.
    """
    head = F.to_json(F.struct(*[F.lit(v).alias(k) for k, v in header.items()]))
    parts = [df.select(F.lit(name).alias("table_name"), head.alias("header"),
                       F.to_json(F.struct("*")).alias("record")) for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)
