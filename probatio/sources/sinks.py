"""Where results go: JSON records, partitioned manifests, an append-only ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession

from probatio.operators import scans


def write_results(scored: DataFrame, path: str) -> None:
    """One JSON object per file, written in parallel."""
    scans.results_table(scored).write.mode("overwrite").json(path)


def write_organized(scored: DataFrame, path: str) -> None:
    """The manifest of kept files, laid out by category and subcategory."""
    scans.organize_manifest(scored).write.mode("overwrite").partitionBy("category", "subcategory").parquet(path)


def append_custody(ev: DataFrame, run_ts: Column, path: str) -> None:
    """This run's inventory. Earlier runs stay as they are, and a run that is repeated replaces itself only."""
    scans.custody_ledger(ev, run_ts.cast("string")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic") \
        .partitionBy("run_ts").parquet(path)


def read_custody(spark: SparkSession, path: str) -> DataFrame:
    """The ledger of all runs; a filter on ``run_ts`` reads those runs alone."""
    return spark.read.schema("rel_path string, sha256 string, size long, modified_ts timestamp, full_path string, run_ts string").parquet(path)


def write_bundle(header: dict[str, str], tables: dict[str, DataFrame], path: str) -> None:
    """All result tables as JSON lines, one folder per table."""
    scans.export_bundle(header, tables).write.mode("overwrite").partitionBy("table_name").json(path)
