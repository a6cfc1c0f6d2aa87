"""Duplicates, copies and name conflicts (survey section 2.6, first half)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probatio.functions import text as tx
from probatio.session import written
from probatio.operators.skew import attach_by_key, blocked_row_number


def exact_duplicates(ev: DataFrame) -> DataFrame:
    """The file with the smallest id of each hash is the original, later ones are copies.

    The original per hash is a partial aggregate, so a hash held by a third of all files is reduced
    before the shuffle; it comes back by a join that serves the heaviest hashes by broadcast.
    Files without hash (unreadable) are never copies of each other. Hashes are written first, so the
    texts behind them are read once.
    """
    return duplicate_marks(written(ev.select("doc_id", "file_path", "file_hash"), "hashes"))


def duplicate_marks(hashes: DataFrame) -> DataFrame:
    """The same for hashes that are stored already; only ids, paths and hashes are read."""
    slim = hashes.select("doc_id", "file_path", F.nullif("file_hash", F.lit("")).alias("file_hash"))
    first = (slim.where(F.col("file_hash").isNotNull()).groupBy("file_hash")
             .agg(F.count("*").alias("copies"), F.min(F.struct("doc_id", "file_path")).alias("original"))
             .where("copies > 1"))
    return attach_by_key(slim, first, "file_hash", "copies", "doc_id").select(
        "doc_id", F.coalesce("file_hash", F.lit("")).alias("file_hash"),
        F.coalesce(F.col("original.doc_id") != F.col("doc_id"), F.lit(False)).alias("is_duplicate"),
        F.when(F.col("original.doc_id") != F.col("doc_id"), F.col("original.file_path")).alias("duplicate_of"))


def duplicate_policy(scored: DataFrame) -> DataFrame:
    """Originals stay, copies only with high impact or probative value."""
    return scored.where(~F.col("is_duplicate") | (F.col("overall_impact") > 0.7)
                        | (F.col("probative_value") > 0.8))


def duplicate_report(scored: DataFrame) -> DataFrame:
    """The copies, their original and what happened to them."""
    return scored.where("is_duplicate").select(
        "doc_id", "file_name", F.substring("file_hash", 1, 16).alias("hash16"), "duplicate_of", "overall_impact",
        F.when(F.col("overall_impact") > 0.7, "Kept (high value)").otherwise("Removed").alias("action"))


def copy_verify(ev: DataFrame, backup: DataFrame) -> DataFrame:
    """State of each copied file by comparing hashes; paths are unique on both sides."""
    src = ev.select(F.col("file_path").alias("rel_path"), F.col("file_hash").alias("original_hash"))
    both = src.join(backup.withColumn("_copied", F.lit(True)), "rel_path", "left")
    empty = (F.coalesce("original_hash", F.lit("")) == "") | (F.coalesce("backup_hash", F.lit("")) == "")
    return both.select(
        "rel_path", "original_hash", "backup_hash",
        F.when(F.col("_copied").isNull(), "error_copying").when(empty, "copy_error_hash_calculation")
        .when(F.col("original_hash") == F.col("backup_hash"), "copied_verified")
        .otherwise("hash_mismatch").alias("status"))


def ingest_summary(verified: DataFrame) -> DataFrame:
    """Totals of a copy run; a copy without hash counts as copied and as failed."""
    def n(*states: str) -> Column:
        return F.count_if(F.col("status").isin(*states))

    return verified.agg(
        F.count("*").alias("scanned"),
        n("copied_verified", "copy_error_hash_calculation").alias("copied"),
        n("copied_verified").alias("verified"), n("hash_mismatch").alias("mismatched"),
        n("error_copying", "copy_error_hash_calculation").alias("failed"))


def integrity_check(custody: DataFrame, now: DataFrame) -> DataFrame:
    """Recorded against present hashes: unchanged, modified, missing, added."""
    old = custody.select("rel_path", F.col("sha256").alias("old_hash"))
    new = now.select(F.col("file_path").alias("rel_path"), F.col("file_hash").alias("new_hash"))
    return old.join(new, "rel_path", "full").select(
        "rel_path", F.when(F.col("old_hash").isNull(), "added").when(F.col("new_hash").isNull(), "missing")
        .when(F.col("old_hash") == F.col("new_hash"), "unchanged").otherwise("modified").alias("change"))


def name_conflicts(targets: DataFrame, block_size: int = 100_000) -> DataFrame:
    """Each file gets a name no other file of its folder has.

    The first file of a name keeps it; the others get the smallest numbers ``_n`` before the extension
    that no file of the folder bears. The j-th of them has to pass the taken numbers that lie before
    the j-th free one, so files and taken numbers are ordered together, by free numbers before them.
    Numbering runs per block with offsets, so one popular name is no single task.
    """
    name, keys = F.col("file_name"), ["folder", "stem", "suffix"]
    names = written(targets.select("doc_id", "folder", "file_name"), "names")  # what made them is not done again
    numbered = blocked_row_number(names, ["folder", "file_name"], "doc_id", F.floor(F.col("doc_id") / block_size))
    split = written(numbered.withColumn("stem", tx.stem_of(name)).withColumn("suffix", tx.suffix_of(name)), "names")
    others = split.where("row_no > 1").select("doc_id", *keys, (F.col("row_no") - 1).alias("place"))
    number = F.regexp_extract("stem", r"_([1-9][0-9]{0,17})$", 1)
    taken = split.where("row_no = 1").withColumn("n", number).where("n <> ''").select(
        F.lit(None).cast("long").alias("doc_id"), "folder", F.regexp_replace("stem", r"_[0-9]+$", "").alias("stem"), "suffix",
        F.col("n").cast("long").alias("n")).join(others.select(*keys).distinct(), keys, "left_semi")
    ranked = blocked_row_number(taken, keys, "n", F.floor(F.col("n") / block_size))
    # numbers free before it, plus a half: a taken number comes before the file with one place more
    both = ranked.select("doc_id", *keys, (F.col("n") - F.col("row_no") + 0.5).alias("at")).unionByName(
        others.select("doc_id", *keys, F.col("place").cast("double").alias("at")))
    placed = blocked_row_number(both, keys, "at", F.floor(F.col("at") / block_size), "n").where("doc_id IS NOT NULL").select("doc_id", "n")
    return split.join(placed, "doc_id", "left").select("doc_id", "folder", F.when(F.col("row_no") == 1, name).otherwise(
        F.concat("stem", F.lit("_"), F.col("n").cast("string"), "suffix")).alias("unique_name"))


def theory_assignment(categories: DataFrame, theories: DataFrame, root: str = "GENERAL_EVIDENCE") -> DataFrame:
    """Folder by the first theory that lists a file, else the general one.

    ``theories`` has ord, theory_name, doc_id (the exploded evidence lists).
    """
    from probatio.operators.projections import safe_folder_name
    first = theories.groupBy("doc_id").agg(F.min_by("theory_name", "ord").alias("theory"))
    folder = F.when(F.col("theory").isNotNull(), F.concat(F.lit("THEORY_"), safe_folder_name(F.col("theory")))) \
        .otherwise(root)
    return categories.join(first, "doc_id", "left").select(
        "doc_id", F.coalesce("theory", F.lit("")).alias("theory"), folder.alias("folder"),
        F.concat_ws("/", folder, safe_folder_name(F.col("category_folder")), "file_name").alias("target_path"))


def stage_merge(master: DataFrame, stage: DataFrame, key: str) -> DataFrame:
    """A stage's values replace those of the master, new keys and columns are added.

    Map columns are merged entry by entry, the stage's entries winning.
    """
    left, right = master.alias("m"), stage.withColumn("_in", F.lit(True)).alias("s")
    joined = left.join(right, key, "full")
    names = list(dict.fromkeys([*master.columns, *stage.columns]))
    out: list[Column] = []
    for name in names:
        if name == key:
            out.append(F.col(key))
        elif name not in stage.columns:
            out.append(F.col(f"m.{name}").alias(name))
        elif name not in master.columns:
            out.append(F.col(f"s.{name}").alias(name))
        elif master.schema[name].dataType.typeName() == "map":
            merged = F.map_zip_with(F.col(f"m.{name}"), F.col(f"s.{name}"), lambda _k, a, b: F.coalesce(b, a))
            out.append(F.coalesce(merged, F.col(f"s.{name}"), F.col(f"m.{name}")).alias(name))
        else:
            out.append(F.when(F.col("s._in"), F.col(f"s.{name}")).otherwise(F.col(f"m.{name}")).alias(name))
    return joined.select(*out)
