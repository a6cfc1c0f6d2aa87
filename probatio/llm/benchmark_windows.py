"""Benchmark decontamination: a prefix-filtered join of document words with item windows.

A window is ten consecutive words of an item (an item of fewer words is one window). A document
holds a window only if it holds each of its words, so a prefix of one word, the rarest in the
corpus, is all that must be joined. A joined pair fixes where the window would start; it stays if
the window fits into the document, and is verified word by word. Column functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probatio.llm.common import ascii_lower, bind, id_and_text, packed, unpacked
from probatio.session import written

WINDOW = 10
#: What separates words once A-Z are lower-cased, and once a text is upper-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BETWEEN_UPPER = r"[\x00-\x2F\x3A-\x40\x5B-\x7F]+"
#: Most rows of a side that is broadcast: about 100 bytes each, so some 50 MB.
BROADCAST_ROWS = 500_000


def words(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(text), BETWEEN), lambda w: w != "")


def rough_words(text: Column) -> Column:
    """The same words, position by position, in upper case: much quicker to make. Words that are
    equal with A-Z lowered are equal here, not the other way round, so these only find candidates."""
    return F.filter(F.split(F.upper(text), BETWEEN_UPPER), lambda w: w != "")


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A written table, broadcast if its row count is within the bound; else Spark joins by shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def item_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text", size: int = WINDOW) -> DataFrame:
    """(window, item): each window of each item as its words joined by blanks; ids as strings."""
    plain = items.select(F.coalesce(items[id_col].cast("string"), F.lit("")).alias("item"),
                         words(F.coalesce(items[text_col].cast("string"), F.lit(""))).alias("w"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1)))
    return plain.where(F.size("w") > 0).select("item", F.explode(F.transform(
        starts, lambda i: F.array_join(F.slice("w", i, size), " "))).alias("window")).distinct()


def anchors(windows: DataFrame, docs: DataFrame) -> DataFrame:
    """(word, offset, n, window): the word of each window that is rarest in ``docs``, and its place.
    Occurrences are counted for the windows' words alone, and summed before the shuffle."""
    parts = windows.select("window", F.posexplode(rough_words(F.col("window"))).alias("offset", "word"))
    vocabulary = written(parts.select("word").distinct(), "item-words")
    counts = docs.select(F.explode(rough_words(F.col("text"))).alias("word")) \
        .join(small_side(vocabulary), "word").groupBy("word").agg(F.count("*").alias("times"))
    counts = written(counts, "item-word-counts")  # a word the corpus lacks keeps its windows out
    rarest = F.min(F.struct(F.coalesce("times", F.lit(0)).alias("times"), "word", "offset"))
    return parts.join(counts, "word", "left").groupBy("window").agg(rarest.alias("r"), F.count("*").cast("int").alias("n")) \
        .where("r.times > 0").select("r.word", "r.offset", "n", "window")


def _covered(spans: Column) -> Column:
    """Positions inside any of the (start, n) spans, which are sorted."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("total"))
    return F.aggregate(spans, start, lambda a, s: F.struct(
        F.greatest(a["end"], s["start"] + s["n"]).alias("end"),
        (a["total"] + F.greatest(F.lit(0), s["start"] + s["n"] - F.greatest(a["end"], s["start"]))).alias("total")))["total"]


def find_windows(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """(row_key, doc_id, text_key, n_words, found): ``found`` holds the verified (start, n, window) of a row.

    ``docs``: (doc_id, text). The rows of equal id and text share a key. Only candidates and, once,
    the texts are shuffled, by that key, which no two different texts share.
    """
    keyed = docs.withColumn("row_key", F.md5(F.concat_ws("\0", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text")))
    exact = written(anchors(windows, docs), "item-anchors")
    placed = keyed.select("row_key", bind(rough_words(F.col("text")), lambda w: F.struct(
        F.size(w).alias("n_words"), w.alias("w"))).alias("d")) \
        .select("row_key", "d.n_words", F.posexplode("d.w").alias("at", "word"))
    candidates = placed.join(small_side(exact), "word").select(
        "row_key", (F.col("at") - F.col("offset")).alias("start"), "n", "window", "n_words") \
        .where((F.col("start") >= 0) & (F.col("start") + F.col("n") <= F.col("n_words")))
    listed = candidates.groupBy("row_key").agg(F.sort_array(F.collect_set(F.struct("start", "n", "window"))).alias("candidates"))

    def verified(w: Column) -> Column:
        return F.filter("candidates", lambda c: F.array_join(F.slice(w, c["start"] + 1, c["n"]), " ") == c["window"])

    found = F.when(F.col("candidates").isNotNull(), bind(words(F.col("text")), verified))
    return keyed.join(listed, "row_key", "left").select(
        "row_key", "doc_id", F.size(rough_words(F.col("text"))).cast("long").alias("n_words"), found.alias("found"))


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, items, contaminated, row_key), one row per
    input row. Null and empty texts have no words; without items nothing is hit."""
    windows = written(item_windows(items, item_col, item_text_col), "item-windows")
    rows = written(find_windows(id_and_text(docs, id_col, text_col), windows.select("window").distinct()), "found-windows")
    hit = rows.where(F.size("found") > 0)
    of_rows = hit.select("row_key", F.explode(F.array_distinct(F.transform("found", lambda f: f["window"]))).alias("window")) \
        .distinct().join(windows, "window").groupBy("row_key").agg(F.sort_array(F.collect_set("item")).alias("items"))
    items_ = F.coalesce("items", F.array().cast("array<string>"))
    return rows.join(of_rows, "row_key", "left").select(
        "doc_id", "n_words", F.coalesce(_covered(F.col("found")), F.lit(0)).cast("long").alias("n_hit"),
        F.size(items_).cast("long").alias("n_items"), F.sha2(F.array_join(items_, ","), 256).alias("items_sha256"),
        items_.alias("items"), F.coalesce(F.size("found") > 0, F.lit(False)).alias("contaminated"), "row_key")


def keep_clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no window, with all their columns."""
    dirty = decontaminate(docs, items, id_col, text_col).where("contaminated").select("row_key").distinct()
    keyed = packed(docs, F.md5(F.concat_ws("\0", F.coalesce(docs[id_col].cast("long").cast("string"), F.lit("")),
                                           F.coalesce(docs[text_col].cast("string"), F.lit("")))).alias("row_key"))
    return unpacked(keyed.join(dirty, "row_key", "left_anti"), docs.columns)
