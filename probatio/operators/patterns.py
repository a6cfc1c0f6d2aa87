"""Patterns and theories (survey section 2.8).

A pattern is one row (pattern_id, pattern_type, title, confidence, ...); the files behind it are
rows of a bridge table (pattern_id, doc_id).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from probatio import lexicons as lx
from probatio.functions import text as tx
from probatio.operators.prefix import running
from probatio.operators.skew import top_per_key
from probatio.session import written

LEXICON_ROWS = [(g, s, boost, template, lx.BASE_CONFIDENCE, words) for g, s, boost, template, words in lx.PATTERN_LEXICON]


def pattern_id(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("#", *parts), 256)


def title_case(text: Column) -> Column:
    return F.initcap(F.replace(text, F.lit("_"), F.lit(" ")))


def lexicon_patterns(texts: DataFrame, lexicon: list[tuple] | None = None) -> DataFrame:
    """Per text and sub-pattern, distinct keywords, all matches, and a confidence.

    ``texts`` has doc_id, source, text. Keywords are matched as whole words in one narrow pass; the
    regular expression runs only where the plain words occur.
    """
    rules = lexicon_rules(F.col("text"), F.col("lower_text"), lexicon)
    return rule_patterns(texts.withColumn("lower_text", F.lower("text")).select("doc_id", "source", F.explode(rules).alias("r")))


def lexicon_rules(text: Column, lower: Column, lexicon: list[tuple] | None = None) -> Column:
    """Each sub-pattern of the lexicon with the matches of its keywords in one text."""
    def rule(group: str, sub: str, boost: float, base: float, words: list[str]) -> Column:
        counts = [F.when(F.contains(lower, F.lit(w.lower())),
                         F.regexp_count(text, F.lit(tx.whole_word(w)))).otherwise(0) for w in words]
        return F.struct(F.lit(group).alias("group_name"), F.lit(sub).alias("sub_pattern"),
                        F.lit(base).alias("base"), F.lit(boost).alias("boost"), F.array(*counts).alias("counts"))

    return F.array(*[rule(g, s, b, base, w) for g, s, b, _t, base, w in (lexicon or LEXICON_ROWS)])


def rule_patterns(rows: DataFrame) -> DataFrame:
    """The rows of H01 from (doc_id, source, r), ``r`` being an entry of :func:`lexicon_rules`."""
    out = rows.select("doc_id", "source", "r.group_name", "r.sub_pattern", "r.base", "r.boost",
                      F.size(F.filter("r.counts", lambda c: c > 0)).alias("distinct_keywords"),
                      F.aggregate("r.counts", F.lit(0), lambda a, c: a + c).alias("total_matches"))
    return out.where("total_matches > 0").select(
        "doc_id", "source", "group_name", "sub_pattern", "distinct_keywords", "total_matches",
        F.least(F.lit(1.0), F.col("base") + F.col("boost") * F.col("distinct_keywords")).alias("confidence"),
        F.concat(title_case(F.col("group_name")), F.lit(": "), title_case(F.col("sub_pattern"))).alias("title"))


def pattern_descriptions(ev: DataFrame, lexicon: list[tuple] | None = None, shown: int = 3) -> DataFrame:
    """The sentence of each hit: the sub-pattern's template, the file, and the first keywords found
    in the lexicon's order."""
    text, lower = F.col("content"), F.col("lower_text")

    def rule(group: str, sub: str, template: str, words: list[str]) -> Column:
        found = F.array_compact(F.array(*[F.when(F.contains(lower, F.lit(w.lower())) & F.rlike(text, F.lit(tx.whole_word(w))), F.lit(w)) for w in words]))
        sentence = template.replace("{sub_pattern_name}", sub.replace("_", " "))
        return F.struct(F.lit(group).alias("group_name"), F.lit(sub).alias("sub_pattern"), F.lit(sentence).alias("sentence"), found.alias("found"))

    rules = F.array(*[rule(g, s, t, w) for g, s, _b, t, _base, w in (lexicon or LEXICON_ROWS)])
    rows = ev.withColumn("lower_text", F.lower("content")).select("doc_id", "file_name", F.explode(rules).alias("r")).where(F.size("r.found") > 0)
    return rows.select("doc_id", "r.group_name", "r.sub_pattern", F.concat(
        "r.sentence", F.lit(" Identified in '"), "file_name", F.lit("' based on keywords like '"),
        F.array_join(F.slice("r.found", 1, shown), ", "), F.lit("'.")).alias("description"))


#: Keywords up to which each is a test of its own within the expression, up to which their first words become a set there, and up to which the lexicon is
#: broadcast; beyond, runs of words and keywords meet by a shuffle.
WORD_KEYWORDS, SET_KEYWORDS, BROADCAST_KEYWORDS = 200, 5_000, 200_000
_WORD, _OTHER = r"[\p{L}\p{N}_]", r"[^\p{L}\p{N}_]"
#: What texts and keywords are read as: whole words, and every other character by itself.
_UNIT = f"(?:{_WORD}++|{_OTHER})"


def _openings(text: Column, most: int, first: list[str] | None) -> Column:
    """Every unit after a word boundary (of those in ``first``, if given): its number, and up to ``most`` units from it on."""
    units = F.regexp_extract_all(text, F.lit(_UNIT), F.lit(0))
    runs = F.regexp_extract_all(text, F.lit(f"(?:(?<!{_WORD})(?=({_UNIT}{{1,{most}}}+))|){_UNIT}"), F.lit(1))
    placed = F.transform(F.arrays_zip(units.alias("unit"), runs.alias("run")), lambda z, at: F.struct(
        at.alias("at"), F.lower(z["unit"]).alias("first"), z["run"].alias("run")))
    return F.filter(placed, lambda p: (p["run"] != "") & (F.lit(True) if first is None else p["first"].isin(first)))


def _starts(run: Column, sizes: list[int]) -> Column:
    """The first units of ``run`` as text, for each of ``sizes`` after which a word ends."""
    units = F.regexp_extract_all(run, F.lit(_UNIT), F.lit(0))
    return tx.bound(units, lambda u: F.filter(F.array(*[F.when(
        (F.size(u) == n) | ((F.size(u) > n) & ~F.rlike(F.get(u, F.lit(n)), F.lit(_WORD))),
        F.struct(F.lower(F.array_join(F.slice(u, 1, n), "")).alias("keyword"), F.lit(n).alias("size"))) for n in sizes]), lambda k: k.isNotNull()))


def _word_counts(texts: DataFrame, words: list[str], labels: tuple) -> DataFrame:
    """:func:`keyword_counts` of a few ASCII words: a plain test of each, and its pattern only where the plain word occurs.
    In patterns case is that of ASCII letters and the Kelvin sign, the only other character whose lower case is ASCII."""
    def pattern(word: str) -> str:
        literal = tx.regex_literal(word).replace("k", r"[k\u212A]")
        return f"(?i){literal}(?<!{_WORD}{literal})(?!{_WORD})"

    counts = F.filter(F.array(*[F.struct(F.lit(w).alias("keyword"), F.when(F.contains("lower_text", F.lit(w)), F.regexp_count(
        F.col("text"), F.lit(pattern(w)))).otherwise(0).alias("n")) for w in words]), lambda k: k["n"] > 0)
    return texts.select(F.monotonically_increasing_id().alias("row"), *labels, "text", F.lower("text").alias("lower_text")) \
        .select("row", *labels, F.explode(counts).alias("k")).select("row", *labels, "k.keyword", "k.n")


def keyword_counts(texts: DataFrame, lexicon: DataFrame, broadcast_keywords: int = BROADCAST_KEYWORDS, labels: tuple = ("doc_id", "source")) -> DataFrame:
    """(row, labels, keyword, n): whole-word matches of each lower-cased keyword in each row of ``texts``.

    For a lexicon too large for expressions. Texts are read once, as runs of as many words and
    other characters as some keyword has; a run that is no keyword goes at the join, and the text stays
    behind. Matches of one keyword do not overlap, the leftmost counts; case is compared as lower
    case. ``row`` numbers the input rows, so equal ids stay apart. Null and empty keywords match nothing.
    """
    units = F.regexp_extract_all("keyword", F.lit(_UNIT), F.lit(0))
    keys = lexicon.where("keyword <> ''").select(F.lower("keyword").alias("keyword"), F.size(units).alias("size"), F.lower(units[0]).alias("first")).distinct()
    n_keys = keys.limit(broadcast_keywords + 1).count()
    if n_keys <= min(WORD_KEYWORDS, broadcast_keywords):
        words = sorted(r["keyword"] for r in keys.collect())  # at most WORD_KEYWORDS
        if all(w.isascii() for w in words):
            return _word_counts(texts, words, labels)
    sizes = sorted(r["size"] for r in keys.select("size").distinct().collect()) or [1]
    first = [r["first"] for r in keys.select("first").distinct().collect()] if n_keys <= min(SET_KEYWORDS, broadcast_keywords) else None
    # explode_outer: Spark would put a filter on the size of the array before explode and so read each text twice
    found = texts.select(F.monotonically_increasing_id().alias("row"), *labels, "text") \
        .select("row", *labels, F.explode_outer(_openings(F.col("text"), sizes[-1] + 1, first)).alias("open")) \
        .select("row", *labels, "open.at", F.explode_outer(_starts(F.col("open.run"), sizes)).alias("start")) \
        .select("row", *labels, "at", "start.keyword", "start.size")
    short = keys.select("keyword", "size")
    found = found.join(F.broadcast(short) if n_keys <= broadcast_keywords else short, ["keyword", "size"], "left_semi")
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("free"))
    count = F.aggregate(F.sort_array(F.collect_list("at")), start, lambda acc, at: F.when(at >= acc["free"], F.struct(
        (acc["n"] + 1).alias("n"), (at + F.col("size")).alias("free"))).otherwise(acc), lambda acc: acc["n"])
    return found.groupBy("row", *labels, "keyword", "size").agg(count.alias("n")).drop("size")


def lexicon_patterns_joined(texts: DataFrame, lexicon: DataFrame, broadcast_keywords: int = BROADCAST_KEYWORDS) -> DataFrame:
    """H01 for a lexicon too large for expressions, from :func:`keyword_counts`."""
    rules = lexicon.select(F.lower("keyword").alias("keyword"), "group_name", "sub_pattern", "base_confidence", "boost")
    if lexicon.limit(broadcast_keywords + 1).count() <= broadcast_keywords:
        rules = F.broadcast(rules)
    return keyword_counts(texts, lexicon, broadcast_keywords).join(rules, "keyword").groupBy("row", "doc_id", "source", "group_name", "sub_pattern").agg(
        F.count("*").alias("distinct_keywords"), F.sum("n").alias("total_matches"),
        F.least(F.lit(1.0), F.max("base_confidence") + F.max("boost") * F.count("*")).alias("confidence")).drop("row")


def top_key_phrases(counts: DataFrame, n: int = 10) -> DataFrame:
    """The keywords that occur most often in the texts of each folder; ``counts`` has folder, keyword, n."""
    found = counts.groupBy("folder", F.col("keyword").alias("phrase")).agg(F.sum("n").alias("occurrences"))
    return top_per_key(found, ["folder"], [F.desc("occurrences"), F.asc("phrase")], n, "phrase")


def top_legal_arguments(counts: DataFrame, lexicon: DataFrame, n: int = 5) -> DataFrame:
    """The sub-patterns that most files of each folder support by a keyword; ``counts`` has doc_id, folder, keyword."""
    rules = lexicon.select(F.lower("keyword").alias("keyword"), "group_name", "sub_pattern").distinct()
    files = counts.join(rules, "keyword").select("folder", "group_name", "sub_pattern", "doc_id").distinct()
    found = files.groupBy("folder", "group_name", "sub_pattern").agg(F.count("*").alias("files"))
    return top_per_key(found, ["folder"], [F.desc("files"), F.asc("group_name"), F.asc("sub_pattern")], n, "sub_pattern")


def _recurring(events: DataFrame, at_least: int) -> DataFrame:
    """Counts per (timeline, type); files are counted from per-file rows."""
    per_file = events.groupBy("argument", "event_type", "doc_id").agg(
        F.count("*").alias("n"), F.sum(F.coalesce("evidence_strength", F.lit(0.5))).alias("s"),
        F.min("event_date").alias("first_date"), F.max("event_date").alias("last_date"))
    return per_file.groupBy(F.col("argument").alias("timeline"), "event_type").agg(
        F.sum("n").alias("n"), (F.sum("s") / F.sum("n")).alias("avg_strength"), F.count("*").alias("files"),
        F.min("first_date").alias("first_date"), F.max("last_date").alias("last_date")) \
        .where(F.col("n") >= at_least)


_FIRST = ["event_date", "doc_id", "position", "title"]


def _slim(events: DataFrame) -> DataFrame:
    return written(events.select("argument", "event_type", *_FIRST, "format", "evidence_strength"), "events")


def _first_by_type(events: DataFrame, n: int) -> DataFrame:
    """The ``n`` earliest events of each (argument, type), numbered by ``rank``."""
    order = [F.asc("event_date"), F.asc("doc_id"), F.asc("position"), F.asc("format")]
    return top_per_key(events, ["argument", "event_type"], order, n, "doc_id")


def recurrence_patterns(events: DataFrame, at_least: int = 3, first: int = 5) -> DataFrame:
    """Event types that recur within a timeline; both confidence rules, and the ``first`` events of each in
    order (0: without this column). The events are written before, so that the texts behind them are read once."""
    rows = _slim(events) if first else events
    found = _recurring(rows, at_least).withColumn("confidence", F.least(
        F.lit(1.0), 0.6 + F.col("n") * 0.05 + F.col("avg_strength") * 0.1)) \
        .withColumn("confidence_by_count", 0.6 + F.least(F.lit(0.4), F.col("n") * 0.05)) \
        .withColumn("title", F.concat(F.lit("Recurrence of '"), "event_type", F.lit("' Events in "), "timeline"))
    if not first:
        return found
    # at most ``first`` rows of a group are put into its array
    lists = _first_by_type(rows, first).groupBy(F.col("argument").alias("_timeline"), F.col("event_type").alias("_type")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", *_FIRST))), lambda e: F.struct(*[e[c].alias(c) for c in _FIRST])).alias("first_events"))
    same = F.col("timeline").eqNullSafe(F.col("_timeline")) & F.col("event_type").eqNullSafe(F.col("_type"))
    return found.join(lists, same, "left").drop("_timeline", "_type")


def recurrence_first_events(events: DataFrame, at_least: int = 3, n: int = 5) -> DataFrame:
    """The first events of each recurring type. The events are written first, so that the texts behind them are read once."""
    slim = _slim(events)
    kept = _recurring(slim, at_least).select(F.col("timeline").alias("argument"), "event_type")
    return _first_by_type(slim.join(kept, ["argument", "event_type"], "left_semi"), n) \
        .select("argument", "event_type", "rank", "event_date", "doc_id", "position", "title")


def pattern_merge(patterns: DataFrame, boost: float = 0.05, block_size: int = 100_000) -> DataFrame:
    """One row per (type, title): highest confidence, number of files; and the boosted form.

    ``merged`` counts files: a file in which several texts or sub-patterns show a pattern is one. In the boosted
    form each further pattern raises the running maximum by ``boost``, capped at 1, in order of file and
    confidence. Capped addition and maximum commute with the cap, so the value after n patterns is
    ``min(1, max_i(c_i + boost * (n - max(i, 1))))`` with i counted from 1: an aggregate once the patterns are
    numbered, which a running total over range partitions of about ``block_size`` rows does, however many a title has.
    The rows are written first, so that the texts behind them are read once.
    """
    rows = written(patterns.select("pattern_type", "title", "doc_id", "confidence"), "found-patterns")
    numbered = running(rows, ["pattern_type", "title"], ["doc_id", "confidence"], {"before": ("sum", F.lit(1))}, "patterns",
                       parts=1 + rows.count() // block_size)
    lead = F.col("confidence") - boost * F.greatest(F.col("before"), F.lit(1))
    # by file first: sums over few rows per file, and files counted without a set of them
    per_file = numbered.groupBy("pattern_type", "title", "doc_id").agg(
        F.max("confidence").alias("confidence"), F.count("*").alias("patterns"), F.max(lead).alias("lead"))
    return per_file.groupBy("pattern_type", "title").agg(
        F.max("confidence").alias("confidence"), F.count("*").alias("merged"), F.min("doc_id").alias("first_file"),
        F.least(F.lit(1.0), F.max("lead") + boost * F.sum("patterns")).alias("boosted_confidence")) \
        .withColumn("pattern_id", pattern_id(F.col("pattern_type"), F.col("title")))


def pattern_files(patterns: DataFrame) -> DataFrame:
    """H03, the union of files: one row per merged pattern and file, with what the file adds to it."""
    return patterns.groupBy(pattern_id(F.col("pattern_type"), F.col("title")).alias("pattern_id"), "doc_id").agg(
        F.count("*").alias("patterns"), F.max("confidence").alias("confidence"))


def pattern_matches(texts: DataFrame, lexicon: list[tuple] | None = None) -> DataFrame:
    """H03, the matches of all files one after the other: one row per merged pattern, text and keyword, with the number of
    matches and the place of the first in the text. Nothing is gathered into a list."""
    text, lower = F.col("text"), F.col("lower_text")

    def of(group: str, sub: str, words: list[str]) -> Column:
        def one(w: str) -> Column:
            pattern = F.lit(tx.whole_word(w))
            return F.when(F.contains(lower, F.lit(w.lower())) & F.rlike(text, pattern), F.struct(
                F.lit(group).alias("group_name"), F.lit(sub).alias("sub_pattern"), F.lit(w).alias("keyword"),
                F.regexp_count(text, pattern).alias("matches"),
                (F.length(F.element_at(F.split(text, tx.whole_word(w), 2), 1)) + 1).alias("first_place")))
        return F.array_compact(F.array(*[one(w) for w in words]))

    hits = F.concat(*[of(g, s, w) for g, s, _b, _t, _base, w in (lexicon or LEXICON_ROWS)])
    rows = texts.withColumn("lower_text", F.lower("text")).select("doc_id", "source", F.explode(hits).alias("h")).select("doc_id", "source", "h.*")
    title = F.concat(title_case(F.col("group_name")), F.lit(": "), title_case(F.col("sub_pattern")))
    return rows.select(pattern_id(F.col("group_name"), title).alias("pattern_id"), "doc_id", "source", "keyword", "matches", "first_place")


def pattern_events(patterns: DataFrame, events: DataFrame) -> DataFrame:
    """H03, the distinct events of a merged pattern: those of its files, each date and type once, with the number of
    files that tell it. Events are put together per file first, so a file with many patterns meets few rows."""
    files = patterns.select(pattern_id(F.col("pattern_type"), F.col("title")).alias("pattern_id"), "doc_id").distinct()
    per_file = events.select("doc_id", "event_date", "event_type").distinct()
    return files.join(per_file, "doc_id").groupBy("pattern_id", "event_date", "event_type").agg(
        F.count("*").alias("files"), F.min("doc_id").alias("first_file"))


def theory_support_rows(patterns: DataFrame, rules: list[tuple] | None = None) -> DataFrame:
    """(theory_name, pattern_id, confidence) for each pattern a rule accepts.

    Titles are compared with ``_`` and blanks made equal. A rule fires if it accepts anything.
    """
    title = F.replace(F.lower("title"), F.lit(" "), F.lit("_"))
    names = F.array_compact(F.array(*[
        F.when(F.col("pattern_type").isin(types) & (tx.any_hit(title, terms) if terms else F.lit(True)), F.lit(name))
        for name, types, terms in (rules or lx.THEORY_RULES)]))
    return patterns.select(F.explode(names).alias("theory_name"), "pattern_id", "confidence")


def theory_rules(patterns: DataFrame) -> DataFrame:
    """Theories with support and mean confidence."""
    return theory_support_rows(patterns).groupBy("theory_name").agg(
        F.count("*").alias("supporting_patterns"), F.avg("confidence").alias("evidence_strength"))


def financial_theories(patterns: DataFrame, above: float = 0.6) -> DataFrame:
    """H04, per pattern: one theory for each confident financial pattern."""
    return patterns.where(F.lower("pattern_type").contains("financial") & (F.col("confidence") > above)).select(
        F.concat(F.lit("Potential Financial Misconduct related to "), "title").alias("theory_name"), "pattern_id",
        F.col("confidence").alias("evidence_strength"))


def theory_dedup(theories: DataFrame) -> DataFrame:
    """One theory per name whatever its case; the first by ``ord`` wins (partial aggregate)."""
    cols = [c for c in theories.columns if c != "ord"]
    return theories.groupBy(F.lower(F.trim("theory_name")).alias("_k")).agg(
        F.min(F.struct("ord", *cols)).alias("t")).select("t.*")


def ai_theory_ingest(answers: DataFrame) -> DataFrame:
    """Theories from model answers: the JSON array in the text, valid entries only."""
    schema = "array<struct<theory_name:string,supporting_pattern_ids:array<string>,evidence_strength_assessment:string>>"
    body = F.regexp_extract("raw_response", r"(?s)\[.*\]", 0)
    rows = answers.select("doc_id", F.posexplode(F.from_json(body, schema)).alias("pos", "t")).where(
        F.col("t.theory_name").isNotNull() & F.col("t.supporting_pattern_ids").isNotNull())
    label = F.lower(F.coalesce("t.evidence_strength_assessment", F.lit("Low")))
    return rows.select("doc_id", "pos", "t.theory_name", "t.supporting_pattern_ids",
                       tx.lookup(label, lx.STRENGTH_LABELS, lx.OTHER_STRENGTH).alias("evidence_strength"))


def confidence_blend(patterns: DataFrame, ai: DataFrame) -> DataFrame:
    """Mean of rule and model confidence where the model gave one. ``ai``: pattern_id, ai_confidence."""
    blended = F.least(F.lit(1.0), (F.col("confidence") + F.col("ai_confidence")) / 2)
    return patterns.join(ai, "pattern_id", "left").select("pattern_id", F.when(
        F.col("ai_confidence") > 0, blended).otherwise(F.col("confidence")).alias("confidence"))


def pattern_union(*tables: DataFrame) -> DataFrame:
    """Rows of all detectors; order by confidence when writing or limiting."""
    return reduce(DataFrame.unionByName, tables)


def pattern_top(patterns: DataFrame, n: int = 20) -> DataFrame:
    """The most confident patterns (a top-k, no full sort)."""
    return patterns.orderBy(F.desc("confidence"), "pattern_id", "title").limit(n)


def pattern_top_files(patterns: DataFrame, files: DataFrame, n: int = 10, shown: int = 5) -> DataFrame:
    """The first ``n`` patterns of at least one file with their first ``shown`` files, a row each. The other side of
    the join has ``n`` rows by construction."""
    top = pattern_top(patterns, n).withColumn("place", F.row_number().over(Window.orderBy(F.desc("confidence"), "pattern_id", "title")))
    rows = files.select("pattern_id", "doc_id").join(F.broadcast(top.select("pattern_id", "place", "title", "confidence")), "pattern_id")
    return top_per_key(rows, ["pattern_id"], [F.asc("doc_id")], shown, "doc_id", "file_no").select(
        "place", "pattern_id", "title", "confidence", "file_no", "doc_id")


def theories_by_strength(patterns: DataFrame, at_least: float = 0.0, n: int | None = None) -> DataFrame:
    """All theories, strongest first: mean confidence of the patterns behind each, how many there are, and the
    strongest of them. The table has a row per rule, so ranks are given in one partition."""
    rows = theory_support_rows(patterns).groupBy("theory_name").agg(
        F.avg("confidence").alias("evidence_strength"), F.count("*").alias("supporting_patterns"),
        F.min(F.struct((-F.col("confidence")).alias("c"), "pattern_id"))["pattern_id"].alias("strongest_pattern"))
    rows = rows.where(F.col("evidence_strength") >= at_least).withColumn("rank", F.row_number().over(
        Window.orderBy(F.desc(F.round("evidence_strength", 9)), F.desc("supporting_patterns"), "theory_name")))
    return rows if n is None else rows.where(F.col("rank") <= n)


def pattern_type_counts(patterns: DataFrame) -> DataFrame:
    """Patterns per type."""
    return patterns.groupBy("pattern_type").agg(F.count("*").alias("patterns"))


def confident_patterns(patterns: DataFrame, at_least: float = 0.6, n: int = 10) -> DataFrame:
    """The first confident patterns by type and title."""
    return patterns.where(F.col("confidence") >= at_least).orderBy("pattern_type", "title").limit(n)

