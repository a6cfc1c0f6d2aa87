"""Quality rules over documents and over lines that many documents of one host share.

Per document: words, symbols, repeated lines, words in repeated three-word windows. Across
documents: normalised lines are hashed and counted once per document within each host; lines above
the limit are taken out, and a document left with too little is rejected. All in column functions;
what is shuffled is a hash per distinct line of a document.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probatio.llm.common import ascii_lower, bind, id_and_text, packed, unpacked
from probatio.operators.skew import attach_by_key
from probatio.session import written

SPACE = r"[\x20\x09-\x0D]+"
NO_SYMBOL = r"[^#*$%&|<>]"


@dataclass(frozen=True)
class LineRules:
    """A line is boilerplate of its host if more than ``min_documents`` different documents hold it,
    and more than ``host_percent`` of the host's different documents. Copies count once, so that a
    much copied document is left to deduplication. ``min_words``, ``repeat_percent``: the rules on a
    document alone. ``min_left_words``, ``min_left_percent``: what must be left of a document."""

    min_documents: int = 20
    host_percent: int = 5
    min_words: int = 50
    repeat_percent: int = 50
    min_left_words: int = 20
    min_left_percent: int = 20


def words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def repeat_words(found: Column) -> Column:
    """Words covered by three-word windows that occur twice or more in the array of words.

    Windows are compared as 64-bit hashes. After sorting, equal windows are neighbours; their
    positions, in order, cover three words each, less what the previous one covers already.
    """
    def marked(ordered: Column) -> Column:
        last = F.size(ordered)
        twin = F.transform(ordered, lambda x, i: F.when(
            ((i > 0) & (F.get(ordered, i - 1)["h"] == x["h"]))
            | ((i < last - 1) & (F.get(ordered, i + 1)["h"] == x["h"])), x["i"]))
        return F.sort_array(F.filter(twin, lambda x: x.isNotNull()))

    def covered(places: Column) -> Column:
        gaps = F.transform(places, lambda x, i: F.when(i == 0, F.lit(3)).otherwise(
            F.least(F.lit(3), x - F.get(places, i - 1))))
        return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)

    windows = F.transform(F.sequence(F.lit(0), F.size(found) - 3), lambda i: F.struct(
        F.xxhash64(F.get(found, i), F.get(found, i + 1), F.get(found, i + 2)).alias("h"), i.alias("i")))
    count = bind(F.array_sort(windows), lambda o: bind(marked(o), covered))
    return F.when(F.size(found) < 4, F.lit(0)).otherwise(count).cast("long")


def _lines(text: Column) -> Column:
    """Lines with a word, as (hash of the exact line, hash of the normalised line, words)."""
    def one(line: Column) -> Column:
        return bind(words(line), lambda w: F.struct(
            F.size(w).cast("long").alias("n"), F.xxhash64(line).alias("exact"),
            F.xxhash64(ascii_lower(F.array_join(w, " "))).alias("h")))
    return F.filter(F.transform(F.split(text, "\n"), one), lambda x: x["n"] > 0)


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """One row per input row: doc_id, host, text_key (equal for copies within a host), n_words,
    word_chars, n_symbols, n_dup_lines, n_repeat_words, and ``lines``, an (h, n) for each line with
    a word. A narrow plan; null texts have no words, null hosts are one host of their own."""
    base = id_and_text(docs, id_col, text_col, F.coalesce(docs[host_col].cast("string"), F.lit("\0")).alias("host"))
    by_word = bind(words(F.col("text")), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"), repeat_words(w).alias("n_repeat_words")))
    by_line = bind(_lines(F.col("text")), lambda ls: F.struct(
        (F.size(ls) - F.size(F.array_distinct(F.transform(ls, lambda x: x["exact"])))).cast("long").alias("n_dup_lines"),
        F.transform(ls, lambda x: F.struct(x["h"].alias("h"), x["n"].alias("n"))).alias("lines")))
    return base.select(
        "doc_id", "host", F.md5(F.concat_ws("\0", "host", "text")).alias("text_key"), by_word.alias("w"),
        F.length(F.regexp_replace("text", SPACE, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", NO_SYMBOL, "")).cast("long").alias("n_symbols"), by_line.alias("l"),
    ).select("doc_id", "host", "text_key", "w.*", "word_chars", "n_symbols", "l.*")


def boilerplate(measured: DataFrame, rules: LineRules) -> DataFrame:
    """(text_key, copies, removed_words, common): words in boilerplate lines of each text, and the hashes
    of those lines, null if there are none; no more than the text has lines.

    Lines are counted once per different text of a host, with sums formed before the shuffle; a
    line that half a host shares is one row per map task there, and comes back to its texts by
    :func:`attach_by_key`, which never meets in one task.
    """
    texts = measured.groupBy("text_key").agg(F.first("host").alias("host"), F.count("*").alias("copies"))
    hosts = texts.groupBy("host").agg(F.count("*").alias("weight"), F.count("*").alias("host_documents"))
    held = measured.select("text_key", "host", F.explode("lines").alias("x")).groupBy(
        "text_key", "host", F.xxhash64("host", "x.h").alias("line")).agg(
        # every copy of a text brings its lines again; a maximum over one copy is told by count / copies
        F.max("x.n").alias("n"), F.count("*").alias("times"), F.max("x.h").alias("h"))
    counted = held.groupBy("line").agg(F.first("host").alias("host"), F.count("*").alias("documents")) \
        .where(F.col("documents") > rules.min_documents)
    small = attach_by_key(counted.withColumn("_id", F.col("line")), hosts, "host", "weight", "_id") \
        .where(F.col("documents") * 100 > F.col("host_documents") * rules.host_percent)
    common = small.select("line", "documents", F.lit(True).alias("common"))
    hit = attach_by_key(held, common, "line", "documents", "text_key").where("common")
    removed = hit.groupBy("text_key").agg(F.sum(F.col("n") * F.col("times")).alias("words_of_copies"), F.collect_set("h").alias("common"))
    return texts.join(removed, "text_key", "left").select(
        "text_key", "copies", F.coalesce(F.expr("words_of_copies div copies"), F.lit(0)).alias("removed_words"), "common")


def judge(measured: DataFrame, rules: LineRules = LineRules()) -> DataFrame:
    """``measured`` without its lines, plus removed_words, common, base_failed and kept. ``measured`` is read
    several times and should be a written table; it holds no text."""
    removed = boilerplate(measured, rules)
    rows = measured.drop("lines").withColumn("_row", F.xxhash64("doc_id", "text_key"))
    out = attach_by_key(rows, removed, "text_key", "copies", "_row")
    left = F.col("n_words") - F.col("removed_words")
    return out.withColumn("removed_words", F.coalesce("removed_words", F.lit(0)).cast("long")).withColumn(
        "base_failed", (F.col("n_words") < rules.min_words)
        | (100 * F.col("n_repeat_words") > rules.repeat_percent * F.col("n_words"))).withColumn(
        "kept", ~F.col("base_failed") & (left >= rules.min_left_words)
        & (100 * left >= rules.min_left_percent * F.col("n_words"))).drop("_row")


def quality_rules(docs: DataFrame, rules: LineRules = LineRules(), id_col: str = "doc_id",
                  text_col: str = "text", host_col: str = "source") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, removed_words,
    base_failed, kept, host, text_key), one row per input row. The text is read once; its figures
    are written to the shared folder. An empty table gives none; an empty text fails."""
    return judge(written(measure(docs, id_col, text_col, host_col), "quality"), rules).drop("common")


def _named(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """(row, id, text_key): the caller's rows with the names that :func:`measure` gives them."""
    return packed(docs, docs[id_col].cast("long").alias("id"), F.md5(F.concat_ws(
        "\0", F.coalesce(docs[host_col].cast("string"), F.lit("\0")), F.coalesce(docs[text_col].cast("string"), F.lit("")))).alias("text_key"))


def keep_good(docs: DataFrame, rules: LineRules = LineRules(), id_col: str = "doc_id",
              text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns as they are.

    Rejected rows are found by id and hash of host and text, so neither repeated ids nor copies
    make a hot key.
    """
    judged = quality_rules(docs, rules, id_col, text_col, host_col)
    bad = judged.where(~F.col("kept")).select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_bad")).distinct()
    keyed = _named(docs, id_col, text_col, host_col)
    return unpacked(keyed.join(bad, F.col("id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_bad")), "left_anti"), docs.columns)


def without_lines(text: Column, common: Column) -> Column:
    """``text`` without the lines whose normalised form has a hash in ``common``."""
    def stays(line: Column) -> Column:
        w = words(line)
        return (F.size(w) == 0) | ~F.array_contains(common, F.xxhash64(ascii_lower(F.array_join(w, " "))))
    return F.array_join(F.filter(F.split(text, "\n"), stays), "\n")


def clean_good(docs: DataFrame, rules: LineRules = LineRules(), id_col: str = "doc_id",
               text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The rows of ``docs`` that pass, their texts without boilerplate lines; all other columns, and texts
    without such lines, stay as they are. Rows meet their verdict by id and hash of host and text."""
    judged = judge(written(measure(docs, id_col, text_col, host_col), "quality"), rules)
    # equal rows have equal verdicts; only what changes a row is kept
    verdicts = written(judged.where(~F.col("kept") | F.col("common").isNotNull()).select(
        F.col("doc_id").alias("_id"), F.col("text_key").alias("_told"), F.col("kept").alias("_kept"),
        F.array_sort("common").alias("_common")).distinct(), "verdicts")
    keyed = _named(docs, id_col, text_col, host_col)
    left = keyed.join(verdicts, F.col("id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_told")), "left") \
        .where(F.coalesce("_kept", F.lit(True)))
    text = F.col("row")[text_col]
    cleaned = F.when(F.col("_common").isNull(), text).otherwise(without_lines(text.cast("string"), F.col("_common")))
    return unpacked(left, docs.columns, **{text_col: cleaned})
