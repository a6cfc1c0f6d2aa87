"""Text projections and string scalars (survey section 2.2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probatio import lexicons as lx
from probatio.functions import text as tx


# ---- column functions, shared with the streaming jobs ----------------------------
def lead_summary(content: Column, n: int = 3) -> Column:
    return tx.strip(F.array_join(F.slice(F.split(content, r"\.", -1), 1, n), ". "))


def short_summary(content: Column, max_sentences: int = 3) -> Column:
    flat = F.regexp_replace(content, "\n", " ")
    sentences = F.filter(F.transform(F.split(flat, r"\.", -1), tx.strip), lambda s: s != "")
    joined = F.array_join(F.slice(sentences, 1, max_sentences), ". ")
    return (F.when(F.coalesce(content, F.lit("")) == "", "")
            .when(F.size(sentences) == 0, prefix(content, 200))
            .when(F.length(joined) > 500, F.concat(F.substring(joined, 1, 497), F.lit("...")))
            .otherwise(joined))


def prefix(content: Column, n: int) -> Column:
    return F.when(F.length(content) > n, F.concat(F.substring(content, 1, n), F.lit("..."))) \
        .otherwise(content)


def standard_name(created: Column, folder: Column, summary: Column, file_name: Column) -> Column:
    words = F.transform(F.slice(tx.words_of(summary), 1, 5),
                        lambda w: F.regexp_replace(w, r"^[.,!?]+|[.,!?]+$", ""))
    title = F.when(F.coalesce(summary, F.lit("")) != "", F.array_join(words, "_")) \
        .otherwise(tx.stem_of(file_name))
    title = F.substring(F.regexp_replace(title, r"[^\p{L}\p{N}_-]", ""), 1, 30)
    return F.concat_ws("-", F.date_format(created, "yyMMdd"), tx.lookup(folder, lx.FOLDER_CODES, "UNK"),
                       F.concat(title, tx.suffix_of(file_name)))


def code_of_folder(folder: Column) -> Column:
    words = F.filter(F.split(folder, "_"), lambda w: F.rlike(w, F.lit(r"^\p{L}+$")))
    return F.upper(F.substring(F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), ""), 1, 4))


def safe_file_name(name: Column, limit: int = 255) -> Column:
    clean = F.regexp_replace(name, r'[<>:"/\\|?*]', "_")
    ext = F.regexp_extract(clean, r"\.([^.]*)$", 1)
    stem = F.regexp_replace(clean, r"\.[^.]*$", "")
    cut = F.when(ext != "", F.concat(
        F.substring(stem, F.lit(1), F.lit(limit - 1) - F.length(ext)), F.lit("."), ext)) \
        .otherwise(F.substring(stem, 1, limit))
    return F.when(F.length(clean) > limit, cut).otherwise(clean)


def safe_folder_name(name: Column) -> Column:
    clean = F.regexp_replace(F.regexp_replace(name, r"[^a-zA-Z0-9_\-\s]", ""), r"\s+", "_")
    return F.when(F.coalesce(name, F.lit("")) == "", "Unnamed_Folder").otherwise(F.substring(clean, 1, 100))


def size_label(size: Column) -> Column:
    units = ["B", "KB", "MB", "GB", "TB"]
    expr = F.when(size == 0, "0 B")
    for i, unit in enumerate(units):
        # ties go to the even digit; they are exact, as divisors are powers of two
        label = F.format_string(f"%.1f {unit}", F.bround(size.cast("double") / (1024.0 ** i), 1))
        if i < len(units) - 1:
            expr = expr.when(size < 1024 ** (i + 1), label)
        else:
            expr = expr.otherwise(label)
    return expr


# ---- operators -------------------------------------------------------------------
def content_truncate(ev: DataFrame, n: int = 5000) -> DataFrame:
    """First ``n`` characters."""
    return ev.select("doc_id", F.substring("content", 1, n).alias("content"))


def lead3_summary(ev: DataFrame, n: int = 3) -> DataFrame:
    """First pieces of a split at full stops, joined by ``'. '``."""
    return ev.select("doc_id", lead_summary(F.col("content"), n).alias("summary"))


def basic_summary(ev: DataFrame, max_sentences: int = 3) -> DataFrame:
    """First non-empty sentences, at most 500 characters."""
    return ev.select("doc_id", short_summary(F.col("content"), max_sentences).alias("summary"))


def prefix_summary(ev: DataFrame, n: int = 500) -> DataFrame:
    """First ``n`` characters and ``...`` if there are more."""
    return ev.select("doc_id", prefix(F.col("content"), n).alias("summary_auto"))


def text_counts(ev: DataFrame) -> DataFrame:
    """Words, characters, lines."""
    c = F.col("content")
    return ev.select("doc_id", F.size(tx.words_of(c)).alias("word_count"),
                     F.length(c).alias("character_count"),
                     (F.regexp_count(c, F.lit("\n")) + 1).alias("line_count"))


def standardized_name(categorised: DataFrame) -> DataFrame:
    """``yymmdd-CODE-title.ext`` from date, category and summary."""
    return categorised.select("doc_id", standard_name(
        F.col("created_ts"), F.col("category"), F.col("summary"), F.col("file_name")).alias("new_name"))


def category_code(folders: DataFrame) -> DataFrame:
    """Initials of the alphabetic parts of a folder name."""
    return folders.select("folder", code_of_folder(F.col("folder")).alias("code"))


def sanitize_filename(names: DataFrame) -> DataFrame:
    """Replace characters a file system refuses; cut long names before the extension."""
    return names.select("name", safe_file_name(F.col("name")).alias("sanitized"))


def sanitize_folder(names: DataFrame) -> DataFrame:
    """Folder name from free text."""
    return names.select("name", safe_folder_name(F.col("name")).alias("folder_name"))


def format_size(ev: DataFrame) -> DataFrame:
    """P10: bytes as a readable size."""
    return ev.select("doc_id", size_label(F.col("file_size")).alias("size_label"))


def keyword_snippets(texts: DataFrame, keywords: list[str], window: int = 50) -> DataFrame:
    """Each whole-word match with its surroundings; ``texts`` has doc_id, source, text.

    One narrow pass: a text is searched by regular expression only for keywords it contains.
    """
    text, lower = F.col("text"), F.col("lower_text")
    empty = F.array().cast("array<struct<keyword:string,start_pos:int,end_pos:int>>")

    def found(keyword: str) -> Column:
        matches = F.transform(
            tx.match_positions(text, tx.whole_word(keyword)),
            lambda m: F.struct(F.lit(keyword.lower()).alias("keyword"), m["start"].alias("start_pos"),
                               (m["start"] + F.length(m["raw"])).cast("int").alias("end_pos")))
        return F.when(F.contains(lower, F.lit(keyword.lower())), matches).otherwise(empty)

    def cut(matches: Column) -> Column:
        # snippets are cut out before the matches become rows, so no row carries the text
        known = F.struct(tx.segments(text).alias("parts"), F.length(text).alias("size"))
        return tx.bound(known, lambda t: F.transform(matches, lambda m: F.struct(
            m["keyword"].alias("keyword"), m["start_pos"].alias("start_pos"), m["end_pos"].alias("end_pos"),
            F.concat(F.when(m["start_pos"] > window, "...").otherwise(""),
                     tx.around(t["parts"], m["start_pos"], m["end_pos"] - m["start_pos"], window),
                     F.when(m["end_pos"] + window < t["size"], "...").otherwise("")).alias("snippet"))))

    all_found = tx.bound(F.concat(*[found(k) for k in keywords]), lambda ms: F.when(F.size(ms) > 0, cut(ms)))
    return (texts.withColumn("lower_text", F.lower("text"))
            .select("doc_id", "source", F.explode(all_found).alias("m")).select("doc_id", "source", "m.*"))


def required_fields(df: DataFrame, key: str, required: list[str]) -> DataFrame:
    """Names of fields that are absent, NULL, empty, zero or false, per record."""
    checks = []
    for name in required:
        if name not in df.columns:
            checks.append(F.lit(name))
            continue
        col, kind = F.col(name), df.schema[name].dataType.typeName()
        empty = col.isNull()
        if kind == "string":
            empty = empty | (col == "")
        elif kind in ("array", "map"):
            empty = empty | (F.size(col) == 0)
        elif kind in ("integer", "long", "double", "float", "short"):
            empty = empty | (col == 0)
        elif kind == "boolean":
            empty = empty | ~col
        checks.append(F.when(empty, F.lit(name)))
    return df.select(key, F.array_compact(F.array(*checks)).alias("missing"))


TEXT_SOURCES = ["content", "summary", "ai_summary", "ocr_text"]


def text_sources(ev: DataFrame, sources: list[str] | None = None) -> DataFrame:
    """One row per non-empty text of a document."""
    names = [s for s in (sources or TEXT_SOURCES) if s in ev.columns]
    rows = ev.select("doc_id", F.explode(F.array(*[
        F.struct(F.lit(n).alias("source"), F.col(n).alias("text")) for n in names])).alias("t"))
    return rows.select("doc_id", "t.source", "t.text").where(F.coalesce("text", F.lit("")) != "")


def best_text(ev: DataFrame) -> DataFrame:
    """First non-empty text of a document, if any."""
    return ev.select("doc_id", F.coalesce(*[F.nullif(s, F.lit("")) for s in TEXT_SOURCES]).alias("text"))


def searchable_text(ev: DataFrame) -> DataFrame:
    """All non-empty texts in lower case, one below the other."""
    return ev.select("doc_id", F.lower(F.concat_ws(
        "\n", *[F.nullif(s, F.lit("")) for s in TEXT_SOURCES])).alias("search_text"))


def truncate_marked(ev: DataFrame, n: int = 50_000) -> DataFrame:
    """Cap the text for a model and mark the cut."""
    c = F.col("content")
    return ev.select("doc_id", F.when(F.length(c) > n, F.concat(
        F.substring(c, 1, n), F.lit(lx.TRUNCATION_MARK))).otherwise(c).alias("llm_input"),
        (F.length(c) > n).alias("truncated"))


def preserved_path(ev: DataFrame, case_id: Column) -> DataFrame:
    """Content-addressed place of the original; without a case id only an error."""
    out = ev.withColumn("case_id", F.nullif(case_id, F.lit("")))
    name = F.concat_ws("_", "file_hash", "file_name")
    ok = F.col("case_id").isNotNull()
    return out.select(
        "doc_id", F.when(ok, name).alias("preserved_filename"),
        F.when(ok, F.concat_ws("/", F.lit("cases"), "case_id", F.lit("preserved_files"),
                               "file_hash", name)).alias("preserved_path"),
        F.when(~ok, F.lit("Case ID not found")).alias("error"))
