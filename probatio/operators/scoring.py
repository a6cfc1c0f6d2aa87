"""Legal scores (survey section 2.5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probatio import lexicons as lx
from probatio.config import ScoringConfig
from probatio.functions import text as tx


# ---- column functions ------------------------------------------------------------
def share_of_hits(lower_text: Column, words: list[str], divisor: float = 5.0) -> Column:
    return F.least(tx.hits(lower_text, words) / F.lit(divisor), F.lit(1.0))


def admissibility_col(file_type: Column, lower_text: Column) -> Column:
    base = (F.when(file_type.isin("PDF Document", "Word Document"), 0.8)
            .when(file_type.isin("Email", "Text File"), 0.6)
            .when(file_type == "Image", 0.4).otherwise(0.5))
    return base * F.when(tx.any_hit(lower_text, lx.PRIVILEGE_WORDS), 0.7).otherwise(1.0)


def impact_col(probative: Column, relevance: Column, admissibility: Column, prejudicial: Column,
               cfg: ScoringConfig = ScoringConfig()) -> Column:
    return tx.clamp01(probative * cfg.probative_weight + relevance * cfg.relevance_weight
                      + admissibility * cfg.admissibility_weight - prejudicial * cfg.prejudice_penalty)


def strength_col(context: Column, event_type: Column) -> Column:
    lower = F.lower(context)
    raised = F.lit(0)
    for kind, words in lx.STRENGTH_INDICATORS.items():
        raised = F.when(event_type == kind, tx.hits(lower, words)).otherwise(raised)
    value = 0.5 + 0.1 * raised - 0.1 * tx.hits(lower, lx.UNCERTAINTY_WORDS)
    return F.greatest(F.lit(0.1), F.least(F.lit(1.0), value))


def event_confidence_col(context: Column) -> Column:
    return F.least(0.5 + 0.1 * tx.hits(F.lower(context), lx.EVENT_CONFIDENCE_WORDS), F.lit(1.0))


# ---- operators -------------------------------------------------------------------
def probative(ev: DataFrame, extra_words: list[str] | None = None, divisor: float | None = None) -> DataFrame:
    """How much a text proves; with fact words the divisor is 10."""
    words = lx.PROBATIVE_WORDS + [w.lower() for w in (extra_words or [])]
    return ev.select("doc_id", share_of_hits(
        F.lower("content"), words, divisor or (10.0 if extra_words else 5.0)).alias("probative_value"))


def prejudicial(ev: DataFrame) -> DataFrame:
    """How unfairly a text may influence."""
    return ev.select("doc_id", share_of_hits(F.lower("content"), lx.PREJUDICIAL_WORDS).alias("prejudicial_value"))


def admissibility(ev: DataFrame) -> DataFrame:
    """By file type, lowered for privileged content."""
    return ev.select("doc_id", admissibility_col(
        F.col("file_type"), F.lower("content")).alias("admissibility_score"))


def overall_impact(scored: DataFrame) -> DataFrame:
    """Weighted sum of the scores, clamped to [0, 1]."""
    return scored.select("doc_id", "relevance_score", "overall_impact")


def human_review(scored: DataFrame) -> DataFrame:
    """Low confidence, low impact or an error sends a file to review."""
    return scored.select("doc_id", "requires_human_review", "category", "predicted_category")


def image_boost(scored: DataFrame, rollup: DataFrame) -> DataFrame:
    """Raise probative value where indicators in pictures fit the category."""
    cat = F.col("predicted_category")

    def boost(value: Column, indicators: str, part: str, by: float) -> Column:
        hit = (F.coalesce(F.size(indicators), F.lit(0)) > 0) & F.contains(cat, F.lit(part))
        return F.when(hit, F.least(F.lit(1.0), value + by)).otherwise(value)

    value = F.col("probative_value")
    for indicators, part, by in [
            ("abuse_indicators", "FRAUD_ON_THE_COURT", 0.3), ("abuse_indicators", "ELECTRONIC_ABUSE", 0.2),
            ("financial_evidence", "NON_DISCLOSURE", 0.4), ("communication_evidence", "TEXT_MESSAGES", 0.2)]:
        value = boost(value, indicators, part, by)
    return scored.select("doc_id", "predicted_category", "probative_value") \
        .join(rollup, "doc_id", "left").select("doc_id", value.alias("probative_value"))


def evidence_strength(contexts: DataFrame) -> DataFrame:
    """Strength of an event by indicator and uncertainty words of its context."""
    return contexts.select("doc_id", "position", "format", "event_type", strength_col(
        F.col("context"), F.col("event_type")).alias("evidence_strength"))


def event_confidence(mentions: DataFrame) -> DataFrame:
    """Confidence by court words; and the form by context length."""
    return mentions.select("doc_id", "position", "format", event_confidence_col(F.col("context")).alias("confidence"),
                           F.when(F.length("context") > 50, 0.7).otherwise(0.5).alias("confidence_by_length"))


def score_table(answers: DataFrame) -> DataFrame:
    """Score rows of model answers: first object in the text, clamped to [0, 1].

    ``answers`` has doc_id, score_type, raw_response, success. A failed call scores -1, an answer
    without object 0, both with an error; a value that is not a number scores 0 without one.
    """
    raw = F.col("raw_response")
    body = F.regexp_extract(raw, r"(?s)\{.*?\}", 0)
    parsed = F.from_json(body, "score string, justification string, _bad string",
                         {"columnNameOfCorruptRecord": "_bad"})
    out = answers.withColumn("body", body).withColumn("p", parsed)
    # a JSON number has no quotes around it
    number = F.regexp_extract("body", r'"score"\s*:\s*(-?[0-9.]+(?:[eE][+-]?[0-9]+)?)\s*[,}]', 1).try_cast("double")
    head = F.substring(raw, 1, 100)
    kind = (F.when(~F.col("success"), "failed").when(F.col("body") == "", "none")
            .when(F.col("p._bad").isNotNull(), "broken").otherwise("ok"))
    return (out.withColumn("kind", kind).select(
        "doc_id", "score_type",
        F.when(F.col("kind") == "failed", -1.0).when(F.col("kind") == "ok", F.coalesce(tx.clamp01(number), F.lit(0.0)))
        .otherwise(0.0).alias("score"),
        F.when(F.col("kind") == "failed", "AI task failed")
        .when(F.col("kind") == "none", F.concat(F.lit("AI response not valid JSON: "), head))
        .when(F.col("kind") == "broken", F.concat(F.lit("AI response parsing error: "), head))
        .otherwise(F.coalesce("p.justification", F.lit("No justification from AI."))).alias("justification"),
        F.when(F.col("kind") == "failed", "AI task failed").when(F.col("kind") == "none", "AI response not valid JSON")
        .when(F.col("kind") == "broken", "JSON parsing error").alias("error")))


def scoring_summary(scores: DataFrame) -> DataFrame:
    """Files considered, files with a good score, errors."""
    per_file = scores.groupBy("doc_id").agg(
        F.max(F.col("error").isNull().cast("int")).alias("good"),
        F.count_if(F.col("error").isNotNull()).alias("errors"))
    return per_file.agg(F.count("*").alias("files_considered"), F.sum("good").alias("files_scored"),
                        F.sum("errors").alias("errors"))
