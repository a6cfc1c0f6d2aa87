"""Registered queries for survey section 2.8."""

from pyspark.sql import functions as F

from probatio import lexicons as lx
from probatio.operators import pairs as pr
from probatio.operators import patterns as pt
from probatio.operators import projections as pj
from probatio.operators import timeline as tl
from probatio.plans import scored as plan
from probatio.plans.q_timeline import day, events
from probatio.plans.registry import COMMON, any_sql, lit_list, q, query, r6
from probatio.session import written
from probatio.sources import files as fs
from probatio.sources.evidence import evidence, table


def _title(text: str) -> str:
    """Oracle text for words with capitals."""
    return f"array_to_string(list_transform(string_split({text}, '_'), lambda w: concat(upper(w[1]), w[2:])), ' ')"


_TEXT_AT_WORDS = "regexp_replace(content, '[À-ÖØ-öø-ɏ]', '_', 'g')"


def _lex_sql(texts: str = "lex_text") -> str:
    parts = []
    for group, sub, boost, _t, words in lx.PATTERN_LEXICON:
        counts = ["len(regexp_extract_all(txt, " + q(r"(?i)\b" + w.replace("-", "\\-") + r"\b") + "))" for w in words]
        kinds = " + ".join(f"CAST({c} > 0 AS INT)" for c in counts)
        parts.append(f"SELECT doc_id, {"'content' AS source" if texts == "lex_text" else "source"}, '{group}' AS group_name, '{sub}' AS sub_pattern, CAST({kinds} AS BIGINT) AS distinct_keywords, "
                     f"CAST({' + '.join(counts)} AS BIGINT) AS total_matches, {lx.BASE_CONFIDENCE} AS base, {boost} AS boost, "
                     f"concat({_title(q(group))}, ': ', {_title(q(sub))}) AS title FROM {texts}")
    return "SELECT *, least(1.0, base + boost * distinct_keywords)::DOUBLE AS confidence FROM (" + " UNION ALL ".join(parts) + ") l WHERE total_matches > 0"


COMMON["lex_text"] = f"SELECT doc_id, {_TEXT_AT_WORDS} AS txt FROM ev"
COMMON["lexpat"] = _lex_sql()


def lexicon_patterns(spark, d):
    return pt.lexicon_patterns(pj.text_sources(evidence(spark, d), ["content"]))


@query("lexicon_patterns", f"SELECT doc_id, source, group_name, sub_pattern, distinct_keywords, total_matches, {r6('confidence')} AS confidence, title FROM lexpat")
def _(spark, d):
    return lexicon_patterns(spark, d)


def _described() -> str:
    parts = []
    for group, sub, _b, template, words in lx.PATTERN_LEXICON:
        found = "list_filter([" + ", ".join("CASE WHEN regexp_matches(txt, " + q(r"(?i)\b" + w.replace("-", "\\-") + r"\b") + f") THEN {q(w)} END" for w in words) + "], lambda x: x IS NOT NULL)"
        parts.append(f"SELECT doc_id, '{group}' AS group_name, '{sub}' AS sub_pattern, {q(template.replace('{sub_pattern_name}', sub.replace('_', ' ')))} AS t, {found} AS f FROM lex_text")
    return " UNION ALL ".join(parts)


@query("pattern_descriptions", f"SELECT doc_id, group_name, sub_pattern, concat(t, ' Identified in \'\'', file_name, '\'\' based on keywords like \'\'', array_to_string(f[1:3], ', '), '\'\'.') AS description FROM ({_described()}) x JOIN ev USING (doc_id) WHERE len(f) > 0".replace("\\'", "'"))
def _(spark, d):
    return pt.pattern_descriptions(evidence(spark, d))


@query("lexicon_patterns_joined", f"SELECT doc_id, source, group_name, sub_pattern, distinct_keywords, total_matches, {r6('confidence')} AS confidence FROM lexpat")
def _(spark, d):
    return pt.lexicon_patterns_joined(pj.text_sources(evidence(spark, d), ["content"]), fs.default_lexicon(spark))


def _phrases_sql() -> str:
    counts = {}
    for _group, _sub, _b, _t, words in lx.PATTERN_LEXICON:
        for w in words:
            counts[w.lower()] = "len(regexp_extract_all(txt, " + q(r"(?i)\b" + w.replace("-", "\\-") + r"\b") + "))"
    return " UNION ALL ".join(f"SELECT doc_id, folder, {q(w)} AS keyword, {c} AS n FROM lex_text JOIN cat_best USING (doc_id)" for w, c in counts.items())


def _keyword_rules_sql() -> str:
    rows = sorted({(w.lower(), g, s) for g, s, _b, _t, words in lx.PATTERN_LEXICON for w in words})
    return "SELECT * FROM (VALUES " + ", ".join(f"({q(w)}, {q(g)}, {q(s)})" for w, g, s in rows) + ") v(keyword, group_name, sub_pattern)"


COMMON["phrase_counts"] = f"SELECT * FROM ({_phrases_sql()}) p WHERE n > 0"


def _folder_counts(spark, d):
    texts = plan.categorised(evidence(spark, d)).select("doc_id", "folder", F.col("content").alias("text"))
    return pt.keyword_counts(texts, fs.default_lexicon(spark), labels=("doc_id", "folder"))


@query("top_key_phrases", "SELECT folder, phrase, CAST(occurrences AS BIGINT) AS occurrences, CAST(rn AS BIGINT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY folder ORDER BY occurrences DESC, phrase) AS rn FROM ("
       "SELECT folder, keyword AS phrase, sum(n) AS occurrences FROM phrase_counts GROUP BY ALL) a) b WHERE rn <= 10")
def _(spark, d):
    return pt.top_key_phrases(_folder_counts(spark, d))


@query("top_legal_arguments", "SELECT folder, group_name, sub_pattern, files, CAST(rn AS BIGINT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY folder ORDER BY files DESC, group_name, sub_pattern) AS rn FROM ("
       f"SELECT folder, group_name, sub_pattern, count(DISTINCT doc_id) AS files FROM phrase_counts JOIN ({_keyword_rules_sql()}) r USING (keyword) GROUP BY ALL) a) b WHERE rn <= 5")
def _(spark, d):
    return pt.top_legal_arguments(_folder_counts(spark, d), fs.default_lexicon(spark))


COMMON["recur"] = ("SELECT argument AS timeline, event_type, count(*) AS n, avg(evidence_strength) AS avg_strength, count(DISTINCT doc_id) AS files, min(event_date) AS first_date, max(event_date) AS last_date "
                   "FROM events_all GROUP BY argument, event_type HAVING count(*) >= 3")


@query("recurrence_patterns", f"SELECT timeline, event_type, n, {r6('avg_strength')} AS avg_strength, files, {day('first_date')}, {day('last_date')}, {r6('least(1.0, 0.6 + n * 0.05 + avg_strength * 0.1)')} AS confidence, "
       f"{r6('0.6 + least(0.4, n * 0.05)')} AS confidence_by_count, concat('Recurrence of ''', event_type, ''' Events in ', timeline) AS title, first_events FROM recur JOIN ("
       "SELECT argument AS timeline, event_type, string_agg(concat('{', strftime(event_date, '%Y-%m-%d'), ', ', doc_id, ', ', position, ', ', title, '}'), '|' ORDER BY rank) AS first_events FROM ("
       "SELECT *, row_number() OVER (PARTITION BY argument, event_type ORDER BY event_date, doc_id, position, format) AS rank FROM events_all) x WHERE rank <= 5 GROUP BY argument, event_type) f USING (timeline, event_type)")
def _(spark, d):
    return pt.recurrence_patterns(events(spark, d))


@query("recurrence_first_events", f"SELECT argument, event_type, rank, {day('event_date')}, doc_id, position, title FROM (SELECT e.*, row_number() OVER (PARTITION BY argument, e.event_type ORDER BY event_date, doc_id, position, format) AS rank "
       "FROM events_all e JOIN recur r ON r.timeline = e.argument AND r.event_type = e.event_type) x WHERE rank <= 5")
def _(spark, d):
    return pt.recurrence_first_events(events(spark, d))


# found patterns: one row per file and sub-pattern
def found_patterns(spark, d):
    return lexicon_patterns(spark, d).select("doc_id", F.col("group_name").alias("pattern_type"), "title", "confidence")


def _merged_sql(rows: str) -> str:
    return ("SELECT sha256(concat(group_name, '#', title)) AS pattern_id, group_name AS pattern_type, title, max(confidence) AS confidence, count(DISTINCT doc_id) AS merged, min(doc_id) AS first_file, "
            "least(1.0, max(confidence - 0.05 * greatest(i - 1, 1)) + 0.05 * count(*)) AS boosted_confidence FROM ("
            f"SELECT *, row_number() OVER (PARTITION BY group_name, title ORDER BY doc_id, confidence) AS i FROM {rows}) p GROUP BY group_name, title")


COMMON["merged"] = _merged_sql("lexpat")


def merged(spark, d):
    return pt.pattern_merge(found_patterns(spark, d))


@query("pattern_merge", f"SELECT pattern_id, pattern_type, title, {r6('confidence')} AS confidence, merged, first_file, {r6('boosted_confidence')} AS boosted_confidence FROM merged")
def _(spark, d):
    return merged(spark, d)


# several texts of a file: its content and, of two files in three, the second half of it
COMMON["lex_several"] = (f"SELECT doc_id, 'content' AS source, {_TEXT_AT_WORDS} AS txt FROM ev UNION ALL "
                         f"SELECT doc_id, 'ocr_text', substring({_TEXT_AT_WORDS}, 1 + CAST(length(content) // 2 AS BIGINT)) FROM ev WHERE length(content) > 1 AND doc_id % 3 <> 0")
COMMON["lexpat_several"] = _lex_sql("lex_several")


def several_texts(spark, d):
    """The content of each file and, of two in three, a second text of it."""
    half = F.expr("substring(content, 1 + length(content) div 2)")
    ev = evidence(spark, d).withColumn("ocr_text", F.when((F.col("doc_id") % 3 != 0) & (F.length("content") > 1), half))
    return pj.text_sources(ev, ["content", "ocr_text"])


def several_patterns(spark, d):
    return pt.lexicon_patterns(several_texts(spark, d)).select("doc_id", F.col("group_name").alias("pattern_type"), "title", "confidence")


@query("pattern_merge_texts", f"SELECT pattern_id, pattern_type, title, {r6('confidence')} AS confidence, merged, first_file, {r6('boosted_confidence')} AS boosted_confidence FROM ({_merged_sql('lexpat_several')}) m")
def _(spark, d):
    return pt.pattern_merge(several_patterns(spark, d))


@query("pattern_merge_files", f"SELECT sha256(concat(group_name, '#', title)) AS pattern_id, doc_id, count(*) AS patterns, {r6('max(confidence)')} AS confidence FROM lexpat_several GROUP BY group_name, title, doc_id")
def _(spark, d):
    return pt.pattern_files(several_patterns(spark, d))


def _matches_sql() -> str:
    parts = []
    for group, sub, _b, _t, words in lx.PATTERN_LEXICON:
        for w in words:
            p = q(r"(?i)\b" + w.replace("-", "\\-") + r"\b")
            parts.append(f"SELECT sha256(concat('{group}#', {_title(q(group))}, ': ', {_title(q(sub))})) AS pattern_id, doc_id, source, {q(w)} AS keyword, len(regexp_extract_all(txt, {p})) AS matches, "
                         f"length(string_split_regex(txt, {p})[1]) + 1 AS first_place FROM lex_several WHERE regexp_matches(txt, {p})")
    return " UNION ALL ".join(parts)


@query("pattern_merge_matches", _matches_sql())
def _(spark, d):
    return pt.pattern_matches(several_texts(spark, d))


@query("pattern_merge_events", f"SELECT pattern_id, {day('event_date')}, event_type, count(*) AS files, min(doc_id) AS first_file FROM (SELECT DISTINCT sha256(concat(group_name, '#', title)) AS pattern_id, doc_id FROM lexpat) f "
       "JOIN (SELECT DISTINCT doc_id, event_date, event_type FROM events_all) e USING (doc_id) GROUP BY pattern_id, event_date, event_type")
def _(spark, d):
    return pt.pattern_events(found_patterns(spark, d), events(spark, d))


_RULES = " UNION ALL ".join(
    f"SELECT {q(name)} AS theory_name, pattern_id, confidence FROM merged WHERE pattern_type IN ({', '.join(q(t) for t in types)})"
    + (f" AND {any_sql(q('') + ' || replace(lower(title), ' + q(' ') + ', ' + q('_') + ')', terms)}" if terms else "")
    for name, types, terms in lx.THEORY_RULES)
COMMON["trows"] = _RULES


@query("theory_rules", f"SELECT theory_name, count(*) AS supporting_patterns, {r6('avg(confidence)')} AS evidence_strength FROM trows GROUP BY theory_name")
def _(spark, d):
    return pt.theory_rules(merged(spark, d))


@query("theory_support_rows", f"SELECT theory_name, pattern_id, {r6('confidence')} AS confidence FROM trows")
def _(spark, d):
    return pt.theory_support_rows(merged(spark, d))


@query("financial_theories", f"SELECT concat('Potential Financial Misconduct related to ', title) AS theory_name, pattern_id, {r6('confidence')} AS evidence_strength FROM merged WHERE contains(lower(pattern_type), 'financial') AND confidence > 0.6")
def _(spark, d):
    return pt.financial_theories(merged(spark, d))


_THEO = "SELECT doc_id AS ord, CASE WHEN doc_id % 3 = 0 THEN upper(concat('theory ', source)) ELSE concat(' Theory ', source) END AS theory_name, n_chars FROM documents"


@query("theory_dedup", f"SELECT ord, theory_name, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY lower(trim(theory_name)) ORDER BY ord) AS rn FROM ({_THEO}) t) x WHERE rn = 1")
def _(spark, d):
    docs = table(spark, d, "documents")
    name = F.when(F.col("doc_id") % 3 == 0, F.upper(F.concat(F.lit("theory "), "source"))).otherwise(F.concat(F.lit(" Theory "), "source"))
    return pt.theory_dedup(docs.select(F.col("doc_id").alias("ord"), name.alias("theory_name"), "n_chars"))


# answers with theories, by document: prose and array, empty array, missing keys, no array
COMMON["theory_answers"] = (
    "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN concat('I suggest [{\"theory_name\": \"T', CAST(doc_id % 30 AS VARCHAR), '\", \"supporting_pattern_ids\": [\"p', CAST(doc_id AS VARCHAR), '\", \"q\"], \"evidence_strength_assessment\": \"', "
    "CASE doc_id % 5 WHEN 0 THEN 'High' WHEN 1 THEN 'medium' WHEN 2 THEN 'Low' ELSE 'unsure' END, '\"}, {\"theory_name\": \"no ids\"}] as theories.') WHEN 1 THEN '[]' WHEN 2 THEN 'nothing' "
    "ELSE concat('[{\"theory_name\": \"U', CAST(doc_id % 9 AS VARCHAR), '\", \"supporting_pattern_ids\": [\"z\"]}]') END AS raw_response FROM documents")


@query("ai_theory_ingest", f"SELECT doc_id, CAST(0 AS BIGINT) AS pos, json_extract_string(b, '$[0].theory_name') AS theory_name, array_to_string(json_extract_string(b, '$[0].supporting_pattern_ids[*]'), '|') AS supporting_pattern_ids, "
       "CASE lower(coalesce(json_extract_string(b, '$[0].evidence_strength_assessment'), 'low')) WHEN 'high' THEN 0.8 WHEN 'medium' THEN 0.5 WHEN 'low' THEN 0.2 ELSE 0.3 END::DOUBLE AS evidence_strength FROM ("
       r"SELECT doc_id, regexp_extract(raw_response, '(?s)\[.*\]', 0) AS b FROM theory_answers WHERE doc_id % 4 IN (0, 3)) x")
def _(spark, d):
    doc = F.col("doc_id")
    label = F.element_at(F.array(*map(F.lit, ["High", "medium", "Low", "unsure", "unsure"])), (doc % 5 + 1).cast("int"))
    texts = [F.concat(F.lit('I suggest [{"theory_name": "T'), (doc % 30).cast("string"), F.lit('", "supporting_pattern_ids": ["p'), doc.cast("string"),
                      F.lit('", "q"], "evidence_strength_assessment": "'), label, F.lit('"}, {"theory_name": "no ids"}] as theories.')),
             F.lit("[]"), F.lit("nothing"),
             F.concat(F.lit('[{"theory_name": "U'), (doc % 9).cast("string"), F.lit('", "supporting_pattern_ids": ["z"]}]'))]
    answers = table(spark, d, "documents").select("doc_id", F.element_at(F.array(*texts), (doc % 4 + 1).cast("int")).alias("raw_response"))
    return pt.ai_theory_ingest(answers)


@query("confidence_blend", f"SELECT pattern_id, {r6('CASE WHEN merged % 2 = 0 THEN least(1.0, (confidence + 0.4) / 2) ELSE confidence END')} AS confidence FROM merged")
def _(spark, d):
    m = merged(spark, d)
    return pt.confidence_blend(m, m.where("merged % 2 = 0 OR merged % 3 = 0").select(
        "pattern_id", F.when(F.col("merged") % 2 == 0, 0.4).otherwise(0.0).alias("ai_confidence")))


# ---- all patterns of a corpus ------------------------------------------------------------------
COMMON["allpat"] = (
    "SELECT pattern_type, title, CAST(confidence AS DOUBLE) AS confidence, n_files FROM (SELECT pattern_type, title, confidence, merged AS n_files FROM merged "
    "UNION ALL SELECT 'name_cooccurrence', concat(name1, ' / ', name2), confidence, n_files FROM name_pairs "
    "UNION ALL SELECT 'temporal', concat('Recurrence of ''', event_type, ''' Events in ', timeline), least(1.0, 0.6 + n * 0.05 + avg_strength * 0.1), files FROM recur) u")
COMMON["allpat_id"] = "SELECT sha256(concat(pattern_type, '#', title)) AS pattern_id, * FROM allpat"


def all_patterns(spark, d):
    """All detectors over facts that one pass over the texts has stored."""
    facts = plan.text_facts(evidence(spark, d))
    return fact_patterns(facts)


def fact_patterns(facts):
    cols = ["pattern_type", "title", "confidence", "n_files"]
    names = pr.name_cooccurrence(facts, names=F.col("names")).withColumn("pattern_type", F.lit("name_cooccurrence")).withColumn("title", F.concat_ws(" / ", "name1", "name2"))
    times = pt.recurrence_patterns(tl.fact_events(facts), first=0).withColumn("pattern_type", F.lit("temporal")).withColumn("n_files", F.col("files"))
    hits = pt.rule_patterns(facts.select("doc_id", F.lit("content").alias("source"), F.explode("hits").alias("r")))
    found = pt.pattern_merge(hits.select("doc_id", F.col("group_name").alias("pattern_type"), "title", "confidence")).withColumn("n_files", F.col("merged"))
    return pt.pattern_union(found.select(*cols), names.select(*cols), times.select(*cols)).withColumn(
        "pattern_id", pt.pattern_id(F.col("pattern_type"), F.col("title")))


@query("pattern_union", f"SELECT pattern_id, pattern_type, title, {r6('confidence')} AS confidence, n_files FROM allpat_id")
def _(spark, d):
    return all_patterns(spark, d)


@query("pattern_top20", f"SELECT pattern_id, pattern_type, title, {r6('confidence')} AS confidence, n_files FROM (SELECT *, row_number() OVER (ORDER BY round(confidence, 9) DESC, pattern_id, title) AS rn FROM allpat_id) x WHERE rn <= 20")
def _(spark, d):
    return pt.pattern_top(all_patterns(spark, d).withColumn("confidence", F.round("confidence", 9)))


@query("pattern_top_files", f"SELECT place, pattern_id, title, {r6('confidence')} AS confidence, file_no, doc_id FROM (SELECT place, t.pattern_id, title, t.confidence, doc_id, row_number() OVER (PARTITION BY t.pattern_id ORDER BY doc_id) AS file_no FROM ("
       "SELECT *, row_number() OVER (ORDER BY round(confidence, 9) DESC, pattern_id, title) AS place FROM merged) t JOIN (SELECT DISTINCT sha256(concat(group_name, '#', title)) AS pattern_id, doc_id FROM lexpat) f ON f.pattern_id = t.pattern_id WHERE place <= 10) x WHERE file_no <= 5")
def _(spark, d):
    found = written(found_patterns(spark, d), "patterns")
    return pt.pattern_top_files(pt.pattern_merge(found).withColumn("confidence", F.round("confidence", 9)), pt.pattern_files(found))


@query("theories_by_strength", f"SELECT theory_name, {r6('evidence_strength')} AS evidence_strength, supporting_patterns, strongest_pattern, row_number() OVER (ORDER BY round(evidence_strength, 9) DESC, supporting_patterns DESC, theory_name) AS rank FROM ("
       "SELECT theory_name, avg(confidence) AS evidence_strength, count(*) AS supporting_patterns, arg_min(pattern_id, (-confidence, pattern_id)) AS strongest_pattern FROM trows GROUP BY theory_name) x")
def _(spark, d):
    return pt.theories_by_strength(merged(spark, d))


@query("pattern_type_counts", "SELECT pattern_type, count(*) AS patterns FROM allpat GROUP BY pattern_type")
def _(spark, d):
    return pt.pattern_type_counts(all_patterns(spark, d))


@query("confident_patterns", f"SELECT pattern_id, pattern_type, title, {r6('confidence')} AS confidence, n_files FROM allpat_id WHERE round(confidence, 9) >= 0.6 ORDER BY pattern_type, title LIMIT 10")
def _(spark, d):
    return pt.confident_patterns(all_patterns(spark, d).withColumn("confidence", F.round("confidence", 9)))
