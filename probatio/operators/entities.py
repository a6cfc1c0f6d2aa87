"""Mentions and entities by regular expression (survey section 2.3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probatio import lexicons as lx
from probatio.functions import text as tx
from probatio.operators.skew import top_per_key


def all_matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def entities_typed(ev: DataFrame) -> DataFrame:
    """Every date, e-mail, phone and money mention with its fixed confidence."""
    def tagged(kind: str, pattern: str, conf: float) -> Column:
        return F.transform(all_matches(F.col("content"), pattern), lambda v: F.struct(
            F.lit(kind).alias("type"), v.alias("value"), F.lit(conf).alias("confidence")))

    found = [tagged(*p) for p in lx.TYPED_ENTITY_PATTERNS]
    return ev.select("doc_id", F.explode(F.concat(*found)).alias("e")).select("doc_id", "e.*")


def names_in(text: Column) -> Column:
    return F.array_distinct(F.concat(*[all_matches(text, p) for p in lx.NAME_PATTERNS]))


def entities_sets(ev: DataFrame, terms: list[str] | None = None) -> DataFrame:
    """Distinct names, phones, e-mails and legal terms of each file, sorted."""
    c = F.col("content")
    return ev.select(
        "doc_id", F.sort_array(names_in(c)).alias("names"),
        F.sort_array(F.array_distinct(F.concat(*[all_matches(c, p) for p in lx.PHONE_PATTERNS]))).alias("phones"),
        F.sort_array(F.array_distinct(all_matches(c, lx.EMAIL_PATTERN))).alias("emails"),
        F.sort_array(tx.matched_words(F.lower(c), terms or lx.LEGAL_TERMS)).alias("legal_terms"))


def entity_index(sets: DataFrame) -> DataFrame:
    """(type, value, file), already distinct within a file, so no shuffle is needed."""
    parts = {"names": "names", "phone_numbers": "phones", "emails": "emails", "legal_terms": "legal_terms"}

    def tagged(kind: str, col: str) -> Column:
        return F.transform(F.col(col), lambda v: F.struct(F.lit(kind).alias("entity_type"), v.alias("value")))

    rows = [tagged(kind, col) for kind, col in parts.items()]
    return sets.select("doc_id", F.explode(F.concat(*rows)).alias("e")).select("e.*", "doc_id")


def entity_summary(index: DataFrame) -> DataFrame:
    """(value, file) pairs and unique values per type.

    Counts per value first, so no task has to hold the files of a common value.
    """
    per_value = index.groupBy("entity_type", "value").agg(F.count("*").alias("files"))
    return per_value.groupBy("entity_type").agg(
        F.sum("files").alias("mentions"), F.count("*").alias("unique_values"))


def participants_in(text: Column, limit: int = 5) -> Column:
    found = F.array_distinct(F.transform(
        F.concat(*[all_matches(text, p) for p in lx.PARTICIPANT_PATTERNS]), tx.strip))
    stop = F.array(*[F.lit(w) for w in lx.PARTICIPANT_STOP_WORDS])
    kept = F.filter(found, lambda p: ~F.array_contains(stop, F.lower(p)))
    return F.slice(F.sort_array(kept), 1, limit)


def participants(texts: DataFrame) -> DataFrame:
    """People and legal roles named in a text, sorted, first five."""
    return texts.select("doc_id", participants_in(F.col("text")).alias("participants"))


def _labelled(words: Column, before: str, after: str = "") -> Column:
    return F.transform(words, lambda w: F.concat(F.lit(before), w, F.lit(after)))


def _if(condition: Column, label: str) -> Column:
    return F.when(condition, F.array(F.lit(label))).otherwise(F.array().cast("array<string>"))


def timestamps_col(text: Column) -> Column:
    return F.concat(
        *[_labelled(all_matches(text, p), "Date found: ") for p in lx.FOUND_DATE_PATTERNS],
        *[_labelled(all_matches(text, p), "Time found: ") for p in lx.FOUND_TIME_PATTERNS])


def financial_col(text: Column) -> Column:
    amounts = all_matches(text, lx.MONEY_PATTERN)
    return F.concat(
        _labelled(tx.matched_words(F.lower(text), lx.FINANCIAL_WORDS), "Financial keyword detected: '", "'"),
        F.when(F.size(amounts) > 0, F.array(F.concat(
            F.lit("Dollar amounts found: "), F.array_join(F.slice(amounts, 1, 5), ", "))))
        .otherwise(F.array().cast("array<string>")),
        _if(F.rlike(text, F.lit(lx.ACCOUNT_PATTERN)), "Potential account numbers detected"))


def communication_col(text: Column, description: Column) -> Column:
    desc = F.lower(description)
    return F.concat(
        _labelled(tx.matched_words(F.lower(text), lx.PLATFORM_WORDS), "Communication platform: "),
        _if(F.rlike(text, F.lit(lx.SHORT_PHONE_PATTERN)), "Phone numbers detected"),
        _if(F.rlike(text, F.lit(lx.EMAIL_PATTERN)), "Email addresses detected"),
        _if(tx.any_hit(desc, ["screenshot"]) & tx.any_hit(desc, ["message", "chat"]),
            "AI detected message screenshot"))


def abuse_col(text: Column, description: Column) -> Column:
    lower, desc = F.lower(text), F.lower(description)
    return F.concat(
        _labelled(tx.matched_words(lower, lx.ABUSE_WORDS), "Contains abuse-related language: '", "'"),
        _labelled(tx.matched_words(lower, lx.FINANCIAL_CONTROL_WORDS), "Financial control indicator: '", "'"),
        _if(tx.any_hit(desc, ["threatening", "intimidating"]), "AI detected threatening content"),
        _if(tx.any_hit(desc, ["surveillance", "monitoring"]), "AI detected surveillance/monitoring evidence"))


def timestamps_found(images: DataFrame) -> DataFrame:
    """Labelled dates and times in the text of a picture."""
    return images.select("doc_id", "image_no", timestamps_col(F.col("ocr_text")).alias("timestamps"))


def financial_evidence(images: DataFrame) -> DataFrame:
    """Money words, amounts and account numbers."""
    return images.select("doc_id", "image_no", financial_col(F.col("ocr_text")).alias("financial_evidence"))


def communication_evidence(images: DataFrame) -> DataFrame:
    """Platforms, phones, addresses and screenshots of messages."""
    return images.select("doc_id", "image_no", communication_col(
        F.col("ocr_text"), F.col("description")).alias("communication_evidence"))


def abuse_indicators(images: DataFrame) -> DataFrame:
    """Abuse and control words, and what the description says."""
    return images.select("doc_id", "image_no", abuse_col(
        F.col("ocr_text"), F.col("description")).alias("abuse_indicators"))


def top_entities(index: DataFrame, folders: DataFrame, n: int = 10) -> DataFrame:
    """Most mentioned values per folder; ``folders`` has doc_id, folder.

    Counts come from a partial aggregate; ranking then sees one row per value and splits a
    folder with very many values.
    """
    counts = index.join(folders, "doc_id").groupBy("folder", "value").agg(F.count("*").alias("mentions"))
    return top_per_key(counts, ["folder"], [F.desc("mentions"), F.asc("value")], n, "value")
