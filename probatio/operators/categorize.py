"""Categories, tags and event labels (survey section 2.4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from probatio import lexicons as lx
from probatio.functions import text as tx


# ---- column functions ------------------------------------------------------------
def category_structs(lower_text: Column, lexicon: dict[str, list[str]] | None = None) -> Column:
    """One struct (category, ord, hits, score) per category, in lexicon order."""
    return F.array(*[
        F.struct(F.lit(name).alias("category"), F.lit(i).alias("ord"),
                 tx.hits(lower_text, words).alias("hits"),
                 (tx.hits(lower_text, words) / float(len(words))).alias("score"))
        for i, (name, words) in enumerate((lexicon or lx.CATEGORY_KEYWORDS).items())])


def best_category(lower_text: Column, lexicon: dict[str, list[str]] | None = None) -> Column:
    """Struct (score, neg_ord, category): highest score, the earlier category on ties.

    ``lower_text`` must be a column of its own, so that lower-casing happens once; the whole
    expression is generated code (no lambda).
    """
    return F.array_max(F.array(*[
        F.struct((tx.hits(lower_text, words) / float(len(words))).alias("score"), F.lit(-i).alias("neg_ord"),
                 F.lit(name).alias("category"))
        for i, (name, words) in enumerate((lexicon or lx.CATEGORY_KEYWORDS).items())]))


def folder_of(best: Column) -> Column:
    return F.when(best["score"] > 0, tx.lookup(best["category"], lx.CATEGORY_FOLDERS, lx.REVIEW_FOLDER)) \
        .otherwise(lx.REVIEW_FOLDER)


def subcategory_col(folder: Column, content: Column, rules: list[tuple[str, str, str]],
                    within: str = "08_TEXT_MESSAGES") -> Column:
    lower = F.lower(content)
    return tx.first_rule(
        [((folder == within) & F.contains(lower, F.lit(a.lower())) & F.contains(lower, F.lit(b.lower())),
          F.lit(label)) for a, b, label in rules], "")


def event_type_col(file_name: Column, context: Column) -> Column:
    where = {"name": F.lower(file_name), "context": F.lower(context)}
    return tx.first_rule([(tx.any_hit(where[place], words), F.lit(label))
                          for label, place, words in lx.EVENT_TYPE_RULES], "general")


def event_type_simple_col(context: Column) -> Column:
    """Four-label form; the last rule is ``incident or (report and police)``."""
    c = F.lower(context)
    return tx.first_rule([
        (tx.any_hit(c, ["meeting", "call"]), F.lit("communication")),
        (tx.any_hit(c, ["payment", "invoice", "transfer"]), F.lit("financial")),
        (tx.any_hit(c, ["incident"]) | (tx.any_hit(c, ["report"]) & tx.any_hit(c, ["police"])),
         F.lit("legal_incident"))], "general_mention")


def argument_col(category: Column) -> Column:
    return tx.first_rule([(F.contains(category, F.lit(part)), F.lit(name))
                          for part, name in lx.ARGUMENT_OF_CATEGORY], lx.DEFAULT_ARGUMENT)


# ---- operators -------------------------------------------------------------------
def _lower_text(ev: DataFrame) -> DataFrame:
    return ev.withColumn("lower_text", F.lower(F.concat_ws(" ", "content", "file_name")))


def category_scores(ev: DataFrame, lexicon: dict[str, list[str]] | None = None) -> DataFrame:
    """Share of each category's keywords that occur in content or name (narrow)."""
    return _lower_text(ev).select("doc_id", F.explode(category_structs(F.col("lower_text"), lexicon)).alias("c")) \
        .select("doc_id", "c.category", "c.hits", "c.score")


def categorize(ev: DataFrame, lexicon: dict[str, list[str]] | None = None) -> DataFrame:
    """Best category as its folder; no hit at all goes to review. Narrow: no ranking shuffle."""
    best = _lower_text(ev).select("doc_id", best_category(F.col("lower_text"), lexicon).alias("b"))
    return best.select("doc_id", F.when(F.col("b.score") > 0, F.col("b.category")).alias("category"),
                       folder_of(F.col("b")).alias("folder"), F.col("b.score").alias("confidence_score"))


def subcategory_rules(categorised: DataFrame, rules: list[tuple[str, str, str]],
                      within: str = "08_TEXT_MESSAGES") -> DataFrame:
    """Within one folder, the first rule whose two parties are both mentioned."""
    return categorised.select("doc_id", subcategory_col(
        F.col("folder"), F.col("content"), rules, within).alias("subcategory"))


def fact_lexicon(facts: DataFrame, strict: bool = True) -> DataFrame:
    """Facts (fact_id, fact) as lexicon groups: words of more than three letters.

    ``strict`` also wants letters only; the scorer's form does not.
    """
    words = F.filter(tx.words_of(F.col("fact")), lambda w: F.length(w) > 3)
    if strict:
        words = F.filter(words, lambda w: F.rlike(w, F.lit(r"^\p{L}+$")))
    return facts.select(F.concat(F.lit("USER_FACT_"), F.col("fact_id").cast("string")).alias("group_name"),
                        F.explode(words).alias("keyword")).select("group_name", F.lower("keyword").alias("keyword"))


def case_type_folders(spark: SparkSession) -> DataFrame:
    """Folder dimension by case type; a folder without parts has one row with an empty part."""
    rows = [(case, i, folder, sub) for case, tree in lx.CASE_TYPE_FOLDERS.items()
            for i, (folder, subs) in enumerate(tree.items()) for sub in (subs or [""])]
    return spark.createDataFrame(rows, "case_type string, ord int, folder string, subfolder string")


def case_type_lexicon(case_type: str) -> dict[str, list[str]]:
    """Category keywords of a case type; unknown types have none."""
    return lx.CASE_TYPE_KEYWORDS.get(case_type, {})


def case_type_dims(ev: DataFrame, case_type: str) -> DataFrame:
    """C05 applied: hits per document and group of the case type's lexicon (groups with hits)."""
    return category_scores(ev, case_type_lexicon(case_type)).where("hits > 0")


def case_type_hits(ev: DataFrame) -> DataFrame:
    """C05 for every case type: files and hits of each keyword group and of each indicator list, those
    without hits with zero."""
    lower = F.col("lower_text")

    def rule(case: str, kind: str, name: str, words: list[str]) -> Column:
        hits = [F.contains(lower, F.lit(w.lower())).cast("int") for w in words]
        return F.struct(F.lit(case).alias("case_type"), F.lit(kind).alias("kind"), F.lit(name).alias("name"), sum(hits[1:], hits[0]).alias("hits"))

    rules = [rule(c, "keywords", g, w) for c, groups in lx.CASE_TYPE_KEYWORDS.items() for g, w in groups.items()]
    rules += [rule(c, "indicators", g, w) for c, groups in lx.CASE_TYPE_INDICATORS.items() for g, w in groups.items()]
    rows = _lower_text(ev).select(F.explode(F.array(*rules)).alias("r")).select("r.*")
    return rows.groupBy("case_type", "kind", "name").agg(F.sum((F.col("hits") > 0).cast("long")).alias("files"), F.sum("hits").alias("hits"))


def case_type_folder(categories: DataFrame, review: str = lx.REVIEW_FOLDER) -> DataFrame:
    """The folder each case type has for a category, else review."""
    def of(case: str, folders: list[str]) -> Column:
        rules = [(F.contains(F.lit(f.upper()), F.upper("category")), F.lit(f)) for f in folders]
        return F.struct(F.lit(case).alias("case_type"), tx.first_rule(rules, review).alias("folder"))

    return categories.select("*", F.explode(F.array(*[of(c, list(t)) for c, t in lx.CASE_TYPE_FOLDERS.items()])).alias("x")) \
        .select(*categories.columns, "x.*")


def map_category(categories: DataFrame, folders: list[str], review: str = lx.REVIEW_FOLDER) -> DataFrame:
    """First folder whose name contains the category, else review."""
    rules = [(F.contains(F.lit(f.upper()), F.upper("category")), F.lit(f)) for f in folders]
    return categories.select("*", tx.first_rule(rules, review).alias("folder"))


def filename_categorize(ev: DataFrame) -> DataFrame:
    """First folder with a keyword in the file name, else review."""
    name = F.lower("file_name")
    return ev.select("doc_id", tx.first_rule(
        [(tx.any_hit(name, words), F.lit(folder)) for folder, words in lx.FILENAME_KEYWORDS.items()],
        "FOR_HUMAN_REVIEW").alias("folder"))


def scheme_categorize(ev: DataFrame, scheme: list[dict]) -> DataFrame:
    """Folders by priority; first match of tag, whole-word content keyword, file-name part.

    ``ev`` has doc_id, file_name, search_text, tags; the scheme is a short list of rules and
    becomes one conditional expression.
    """
    name, text = F.lower("file_name"), F.lower("search_text")
    tags = F.transform(F.coalesce("tags", F.array().cast("array<string>")), F.lower)
    rules: list[tuple[Column, Column]] = []

    def result(folder: str, label: str, matched: Column) -> Column:
        return F.struct(F.lit(folder).alias("folder"),
                        F.concat(F.lit(f"Matched {label}: "), F.array_join(matched, ", ")).alias("reason"))

    for item in sorted(scheme, key=lambda s: s.get("priority", 99)):
        wanted_tags = [t.lower() for t in item.get("ai_tags", [])]
        content, names = item.get("content_keywords", []), item.get("filename_keywords", [])
        if wanted_tags:
            want = F.array(*[F.lit(t) for t in wanted_tags])
            rules.append((F.arrays_overlap(want, tags), result(
                item["folder"], "AI tag(s)", F.filter(want, lambda t: F.array_contains(tags, t)))))
        if content:
            found = F.array_compact(F.array(*[
                F.when(F.contains(text, F.lit(k.lower())) & F.rlike(text, F.lit(tx.whole_word(k))), F.lit(k))
                for k in content]))
            rules.append((F.size(found) > 0, result(item["folder"], "content keyword(s)", found)))
        if names:
            found = F.array_compact(F.array(*[F.when(F.contains(name, F.lit(k.lower())), F.lit(k))
                                              for k in names]))
            rules.append((F.size(found) > 0, result(item["folder"], "filename keyword(s)", found)))
    chosen = F.lit(None).cast("struct<folder:string,reason:string>")
    for condition, value in reversed(rules):
        chosen = F.when(condition, value).otherwise(chosen)
    return ev.select("doc_id", chosen.alias("r")).select(
        "doc_id", F.coalesce("r.folder", F.lit("FOR_HUMAN_REVIEW")).alias("folder"),
        F.coalesce("r.reason", F.lit("Sent to human review (no criteria matched)")).alias("reason"))


def tags_col(content: Column) -> Column:
    lower = F.lower(content)
    return F.array_compact(F.array(*[F.when(tx.any_hit(lower, words), F.lit(tag))
                                     for tag, words in lx.CONCEPT_KEYWORDS.items()]))


def concept_tags(ev: DataFrame) -> DataFrame:
    """Concept tags of the text, and of a model's findings where given."""
    tags = tags_col(F.col("content"))
    if "legal_significance" in ev.columns:
        tags = F.concat(tags, F.when(F.coalesce("legal_significance", F.lit("")) != "", F.array(F.lit("legally_significant")))
                        .otherwise(F.array().cast("array<string>")))
    if "ai_confidence" in ev.columns:
        tags = F.concat(tags, F.when(F.coalesce("ai_confidence", F.lit(0.0)) > 0.8, F.array(F.lit("high_confidence")))
                        .otherwise(F.array().cast("array<string>")))
    return ev.select("doc_id", F.array_sort(F.array_distinct(tags)).alias("tags"))


def tag_semi(tagged: DataFrame, wanted: list[str]) -> DataFrame:
    """Files with any wanted tag (a semi join against a constant list)."""
    return tagged.where(F.arrays_overlap("tags", F.array(*[F.lit(t) for t in wanted])))


def event_type(mentions: DataFrame) -> DataFrame:
    """Label of a dated mention by file name, then context; and the four-label form."""
    return mentions.select(
        "doc_id", "position", "format", event_type_col(F.col("file_name"), F.col("context")).alias("event_type"),
        event_type_simple_col(F.col("context")).alias("event_type_simple"))


def argument_of(categorised: DataFrame) -> DataFrame:
    """C11: legal argument an event or file belongs to."""
    return categorised.select("doc_id", argument_col(F.col("folder")).alias("argument"))


def categorize_summary(assigned: DataFrame, folders: DataFrame, review: str = "FOR_HUMAN_REVIEW") -> DataFrame:
    """Files per folder (empty folders stay) and whether they still need review."""
    counts = assigned.groupBy("folder").agg(F.count("*").alias("files"))
    review_row = counts.sparkSession.range(1).select(F.lit(review).alias("folder"))
    dim = folders.select("folder").unionByName(review_row).distinct()
    # one row per folder on both sides
    return dim.join(counts, "folder", "left").select(
        "folder", F.coalesce("files", F.lit(0)).alias("files"),
        F.when(F.col("folder") != review, F.coalesce("files", F.lit(0))).otherwise(0).alias("categorised"),
        F.when(F.col("folder") == review, F.coalesce("files", F.lit(0))).otherwise(0).alias("for_review"))
