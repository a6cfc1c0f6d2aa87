"""Small helpers shared by the corpus operators: reading tables, picking columns, fixed spellings."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII letters; the operators lower-case these alone, whatever the locale.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: Column) -> DataFrame:
    """The two columns an operator reads, under fixed names; a null text is empty. Whatever else
    the table holds, also columns named like an operator's own, stays out of the plan."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"),
                       F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"), *more)


def packed(docs: DataFrame, *helpers: Column) -> DataFrame:
    """The caller's rows as one column ``row`` beside an operator's own columns, whose names then cannot clash."""
    return docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), *helpers)


def unpacked(rows: DataFrame, columns: list[str], **changed: Column) -> DataFrame:
    """The caller's columns again, some of them ``changed``."""
    return rows.select(*[changed.get(c, F.col("row")[c]).alias(c) for c in columns])


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often ``body`` mentions it.

    Catalyst merges neighbouring projections, so an array made in one and indexed in the next may
    be built anew for every element; a lambda's variable never is.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def package_path(name: str) -> str:
    """Place of a public vocabulary file; the files are never part of this repository."""
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.lru_cache(maxsize=2)
def sentencepiece_model(path: str):
    """The library's model, loaded once per Python worker."""
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)
