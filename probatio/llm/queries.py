"""The registered queries of the corpus operators, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probatio.llm import (benchmark_windows, jaccard_join, jump_shards, language_families, lattice_scores, packed_ids, piece_chunks, quality_lines,
                          ranked_search, repeated_bytes, secret_ledger, spelling_groups, subword_quality)
from probatio.llm.common import table
from probatio.llm.oracles import SQL

QUERIES, ORACLES = {}, SQL


def query(name: str):
    def add(fn):
        QUERIES[name] = fn
        return fn
    return add


@query("op1_blob_ledger")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return secret_ledger.digest(secret_ledger.scan_history(table(spark, folder, "documents"))[1])


@query("op2_subword_lattice")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    scored = lattice_scores.score_documents(
        table(spark, folder, "documents"), "crc32(encode(coalesce(cast(doc_id AS string), ''), 'UTF-8')) % 7 != 2")
    return scored.select("doc_id", (~F.col("training")).alias("held_out"), "n_tokens", "n_known", "train_tokens",
                         "base_score", "score")


@query("op3_sentencepiece_chunks")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    decoded = piece_chunks.round_trip(table(spark, folder, "documents"))
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                          F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                          F.sha2("text", 256).alias("decoded_sha256"))


@query("op4_subword_embeddings")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = subword_quality.train(docs, table(spark, folder, "labels"))
    return subword_quality.score(docs, model).select(
        "doc_id", (subword_quality.fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query("op5_cross_document_lines")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return quality_lines.quality_rules(table(spark, folder, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "removed_words",
        "base_failed", "kept")


@query("op6_prefix_free_parsing")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    found = repeated_bytes.repeated_spans(table(spark, folder, "documents"))
    return found.select("doc_id", "n_bytes", F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"]).alias("n_removed"),
                        F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


@query("op7_set_relations")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, folder, "documents")).drop("key")


@query("op8_prefix_windows")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return benchmark_windows.decontaminate(table(spark, folder, "documents"), table(spark, folder, "benchmark")).select(
        "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@query("op9_jump_shards")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return jump_shards.shard_documents(table(spark, folder, "documents"))


@query("op10_packed_ids")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return packed_ids.checksums(spark, *packed_ids.write_ids(table(spark, folder, "documents")))


@query("op11_range_maxima")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return ranked_search.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op12_prefix_suffix_tiles")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return spelling_groups.spelling_groups(table(spark, folder, "documents"), delete_every=199)


@query("op13_language_families")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return language_families.identify(docs, language_families.train(docs)).select(
        "doc_id", (language_families.fold(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score")
