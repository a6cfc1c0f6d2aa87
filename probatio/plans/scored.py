"""The rule-based run over a corpus as one plan: categorise, score, find copies.

Everything but the duplicate search is a chain of column expressions over one scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probatio import lexicons as lx
from probatio.config import ScoringConfig
from probatio.functions import text as tx
from probatio.operators import categorize as ca
from probatio.operators import dedup as dd
from probatio.operators import patterns as pt
from probatio.operators import projections as pj
from probatio.operators import scoring as sc
from probatio.operators import timeline as tl
from probatio.operators.entities import names_in
from probatio.session import written


def categorised(ev: DataFrame) -> DataFrame:
    """Adds confidence_score and folder (the predicted category)."""
    base = ev.withColumn("_lt", F.lower(F.concat_ws(" ", "content", "file_name"))) \
        .withColumn("_best", ca.best_category(F.col("_lt"))).drop("_lt")
    return base.withColumn("confidence_score", F.col("_best.score")) \
        .withColumn("folder", ca.folder_of(F.col("_best"))).drop("_best")


def scored(ev: DataFrame, cfg: ScoringConfig = ScoringConfig(), rules: list | None = None) -> DataFrame:
    """All stateless columns of a processed file (also usable on a stream)."""
    df = categorised(ev).withColumn("summary", pj.lead_summary(F.col("content"))) \
        .withColumn("_lower", F.lower("content"))
    df = (df.withColumn("predicted_category", F.col("folder"))
          .withColumn("subcategory", ca.subcategory_col(F.col("folder"), F.col("content"), rules or []))
          .withColumn("new_name", pj.standard_name(
              F.col("created_ts"), F.col("folder"), F.col("summary"), F.col("file_name")))
          .withColumn("probative_value", sc.share_of_hits(
              F.col("_lower"), lx.PROBATIVE_WORDS, cfg.hits_for_full_score))
          .withColumn("prejudicial_value", sc.share_of_hits(
              F.col("_lower"), lx.PREJUDICIAL_WORDS, cfg.hits_for_full_score))
          .withColumn("relevance_score", F.col("confidence_score"))
          .withColumn("admissibility_score", sc.admissibility_col(F.col("file_type"), F.col("_lower")))
          .withColumn("overall_impact", sc.impact_col(
              F.col("probative_value"), F.col("relevance_score"), F.col("admissibility_score"),
              F.col("prejudicial_value"), cfg)))
    review = (F.col("confidence_score") < cfg.min_relevance) | (F.col("overall_impact") < cfg.min_impact)
    if "processing_errors" in df.columns:
        review = review | (F.size("processing_errors") > 0)
    return (df.withColumn("requires_human_review", review)
            .withColumn("category", F.when(review, lx.REVIEW_FOLDER).otherwise(F.col("folder"))).drop("_lower"))


def scored_with_duplicates(ev: DataFrame, cfg: ScoringConfig = ScoringConfig(), rules: list | None = None,
                           preview: int = 500) -> DataFrame:
    """The same with is_duplicate / duplicate_of, and a preview in place of the text.

    One pass over the texts writes the records; the duplicate search reads their ids and hashes, and a
    report the columns it shows, so a summary is only shuffled where it is asked for.
    """
    records = scored(ev, cfg, rules).withColumn("content_preview", F.substring("content", 1, preview)).drop("content", "raw")
    records = written(records, "records")
    return records.join(dd.duplicate_marks(records).drop("file_hash"), "doc_id")


def text_facts(ev: DataFrame) -> DataFrame:
    """What the detectors of a corpus ask of each text, found in one pass and stored without it: folder, names,
    lexicon hits, and dated mentions with what is around them. Null where there is no text."""
    text, lower = F.col("content"), F.col("lower_text")
    hits = F.filter(pt.lexicon_rules(text, lower), lambda r: F.exists(r["counts"], lambda c: c > 0))
    return written(categorised(ev).withColumn("lower_text", F.lower("content")).select(
        "doc_id", "file_path", "file_name", "file_type", "created_ts", "modified_ts", "folder",
        names_in(text).alias("names"), hits.alias("hits"), tl.mentions_in(text).alias("mentions")), "facts")
