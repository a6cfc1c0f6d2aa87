"""Summary tables (survey section 2.10)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from probatio import lexicons as lx


def corpus_summary(scored: DataFrame, review: str = lx.REVIEW_FOLDER) -> DataFrame:
    """Totals and means; an empty corpus gives NULL means."""
    return scored.agg(
        F.count("*").alias("total"), F.count_if(F.col("category") != review).alias("categorised"),
        F.count_if(F.col("category") == review).alias("for_review"),
        F.avg("relevance_score").alias("avg_relevance"), F.avg("overall_impact").alias("avg_impact"))


def category_distribution(scored: DataFrame) -> DataFrame:
    """Files per category, by name."""
    return scored.groupBy("category").agg(F.count("*").alias("files")).orderBy("category")


def folder_strength(scored: DataFrame, with_ai: bool = False) -> DataFrame:
    """How well each argument is supported, ranked.

    ``with_ai`` uses the four-part blend and needs a boolean ``has_ai``. The ranking window runs
    over one row per category.
    """
    high = F.count_if(F.col("overall_impact") > 0.7)
    measures = [F.count("*").alias("files"), F.avg("overall_impact").alias("avg_impact"),
                F.avg("relevance_score").alias("avg_relevance"), high.alias("high_impact_files")]
    if with_ai:
        measures.append(F.count_if("has_ai").alias("ai_files"))
    stats = scored.groupBy("category").agg(*measures)
    ratio = F.col("high_impact_files") / F.col("files")
    if with_ai:
        value = F.col("avg_impact") * 0.4 + F.col("avg_relevance") * 0.3 + ratio * 0.2 \
            + F.col("ai_files") / F.col("files") * 0.1
    else:
        value = F.col("avg_impact") * 0.5 + F.col("avg_relevance") * 0.3 + ratio * 0.2
    ranked = stats.withColumn("high_impact_ratio", ratio).withColumn("strength", F.round(value, 9))
    return ranked.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("strength"), F.asc("category"))))


def argument_bands(strength: DataFrame) -> DataFrame:
    """Strong above 0.7, weak below 0.5."""
    return strength.select("category", F.when(F.col("strength") > 0.7, "strong")
                           .when(F.col("strength") < 0.5, "weak").otherwise("adequate").alias("band"))


def folder_index(scored: DataFrame) -> DataFrame:
    """Size and mean scores per folder."""
    return scored.groupBy(F.col("category").alias("folder")).agg(
        F.count("*").alias("files"), (F.sum("file_size") / (1024.0 * 1024.0)).alias("total_mb"),
        F.avg("relevance_score").alias("avg_relevance"), F.avg("probative_value").alias("avg_probative"))


def folder_entries(scored: DataFrame) -> DataFrame:
    """The entry of each file in its folder's index."""
    return scored.select(
        F.col("category").alias("folder"), "doc_id", "new_name", "file_name", "file_type",
        F.concat(F.substring(F.coalesce("summary", F.lit("")), 1, 200), F.lit("...")).alias("summary"),
        "relevance_score", "probative_value", "admissibility_score", "overall_impact")


def run_summary(runs: DataFrame) -> DataFrame:
    """Stages, successes and files; ``files_processed`` counts before ``total_files``."""
    return runs.agg(F.count("*").alias("stages"), F.count_if(F.col("status") == "success").alias("successful"),
                    F.sum(F.coalesce("files_processed", "total_files", F.lit(0))).alias("total_files"))


def file_360(ev: DataFrame, parts: dict[str, DataFrame], n: int | None = 20) -> DataFrame:
    """One wide row per file, joined from per-file tables; the first ``n`` by path as report.

    With ``n`` the page is chosen first, so each join has ``n`` rows on one side.
    """
    out = ev.orderBy("file_path", "doc_id").limit(n) if n else ev
    for part in parts.values():
        out = out.join(part, "doc_id", "left")
    return out


def image_rollup(images: DataFrame) -> DataFrame:
    """Findings of all pictures of a file. The pictures of one file are one document."""
    def merged(name: str):
        return F.array_sort(F.array_distinct(F.flatten(F.collect_list(name)))).alias(name)

    pages = F.array_sort(F.collect_list(F.struct("image_no", "ocr_text", "evidence_type")))
    return images.groupBy("doc_id").agg(
        F.count("*").alias("total_images"),
        F.array_join(F.transform(pages, lambda p: p["ocr_text"]), "\n").alias("combined_text"),
        merged("abuse_indicators"), merged("financial_evidence"), merged("communication_evidence"),
        merged("timestamps"), F.transform(pages, lambda p: p["evidence_type"]).alias("evidence_types"))


def extraction_summary(ev: DataFrame) -> DataFrame:
    """Files with and without extracted text."""
    good = F.coalesce("content", F.lit("")) != ""
    return ev.agg(F.count("*").alias("total"), F.count_if(good).alias("extracted"), F.count_if(~good).alias("failed"))


def theory_top5(theories: DataFrame, n: int = 5) -> DataFrame:
    """The first theories in their order."""
    return theories.orderBy("ord").limit(n)


def status_latest(log: DataFrame) -> DataFrame:
    """Latest status of each file and agent, and of each file (agent ``*``).

    ``max_by`` combines before the shuffle, so a long log of one file is no problem.
    """
    order = F.struct("ts", "agent")
    per_agent = log.groupBy("doc_id", "agent").agg(F.max_by("status", order).alias("status"), F.max("ts").alias("ts"))
    per_file = per_agent.groupBy("doc_id").agg(F.max_by("status", order).alias("status"), F.max("ts").alias("ts")) \
        .withColumn("agent", F.lit("*"))
    return per_agent.unionByName(per_file).select("doc_id", "agent", "status", "ts")


def ai_run_stats(files: DataFrame) -> DataFrame:
    """Over files with has_ai, ai_seconds, cost, requires_human_review."""
    return files.agg(F.count_if("has_ai").alias("ai_files"), F.avg(F.coalesce("ai_seconds", F.lit(0.0))).alias("avg_ai_seconds"),
                     F.sum(F.coalesce("cost", F.lit(0.0))).alias("total_cost"),
                     F.count_if("requires_human_review").alias("for_review"))
