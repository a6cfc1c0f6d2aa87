"""Registered queries for survey sections 2.3 to 2.5."""

from pyspark.sql import functions as F

from probatio import lexicons as lx
from probatio.operators import categorize as ca
from probatio.operators import entities as en
from probatio.operators import projections as pj
from probatio.operators import reports as rp
from probatio.operators import scoring as sc
from probatio.operators import timeline as tl
from probatio.plans import q_scan_text as base
from probatio.plans import scored as plan
from probatio.plans.registry import COMMON, any_sql, hits_sql, lit_list, positions_sql, q, query, r6
from probatio.sources.evidence import ai_results, evidence, table


def rx(text: str, pattern: str) -> str:
    return f"regexp_extract_all({text}, {q(pattern)})"


# the oracle's engine sees a word end before a letter with accent; these letters become "_", a
# word character no pattern asks for
UNI = r"regexp_replace(content, '[À-ÖØ-öø-ɏ]', '_', 'g')"


def joined(expr: str) -> str:
    return f"coalesce(array_to_string({expr}, '|'), '')"


# ---- 2.3 ----------------------------------------------------------------------------------
# page text gives more e-mail addresses and phones than the documents alone
@query("entities_typed", " UNION ALL ".join(
    f"SELECT doc_id, '{kind}' AS type, unnest({rx('content', pattern)}) AS value, {conf}::DOUBLE AS confidence FROM ev"
    for kind, pattern, conf in lx.TYPED_ENTITY_PATTERNS))
def _(spark, d):
    return en.entities_typed(evidence(spark, d))


@query("page_entities", " UNION ALL ".join(
    f"SELECT page_id AS doc_id, '{kind}' AS type, unnest({rx('html', pattern)}) AS value, {conf}::DOUBLE AS confidence FROM pages"
    for kind, pattern, conf in lx.TYPED_ENTITY_PATTERNS))
def _(spark, d):
    return en.entities_typed(table(spark, d, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("content")))


_NAMES = "list_distinct(list_concat(" + ", ".join(rx(UNI, p) for p in lx.NAME_PATTERNS) + "))"
_PHONES = "list_distinct(list_concat(" + ", ".join(rx("content", p) for p in lx.PHONE_PATTERNS) + "))"
_TERMS = f"list_filter({lit_list(lx.LEGAL_TERMS)}, lambda w: contains(lower(content), w))"
COMMON["esets"] = (f"SELECT doc_id, list_sort({_NAMES}) AS names, list_sort({_PHONES}) AS phones, "
                   f"list_sort(list_distinct({rx('content', lx.EMAIL_PATTERN)})) AS emails, list_sort({_TERMS}) AS legal_terms FROM ev")
COMMON["eindex"] = ("SELECT 'names' AS entity_type, unnest(names) AS value, doc_id FROM esets UNION ALL SELECT 'phone_numbers', unnest(phones), doc_id FROM esets "
                    "UNION ALL SELECT 'emails', unnest(emails), doc_id FROM esets UNION ALL SELECT 'legal_terms', unnest(legal_terms), doc_id FROM esets")


@query("entities_sets", f"SELECT doc_id, {joined('names')} AS names, {joined('phones')} AS phones, {joined('emails')} AS emails, {joined('legal_terms')} AS legal_terms FROM esets")
def _(spark, d):
    return en.entities_sets(evidence(spark, d))


@query("entity_index", "SELECT DISTINCT entity_type, value, doc_id FROM eindex")
def _(spark, d):
    return en.entity_index(en.entities_sets(evidence(spark, d)))


@query("entity_summary", "SELECT entity_type, count(*) AS mentions, count(DISTINCT value) AS unique_values FROM eindex GROUP BY entity_type")
def _(spark, d):
    return en.entity_summary(en.entity_index(en.entities_sets(evidence(spark, d))))


def _participants_sql(text: str) -> str:
    found = "list_concat(" + ", ".join(rx(text, p) for p in lx.PARTICIPANT_PATTERNS) + ")"
    return (f"list_sort(list_distinct(list_filter({found}, lambda p: NOT list_contains({lit_list(lx.PARTICIPANT_STOP_WORDS)}, lower(p)))))[1:5]")


@query("participants", f"SELECT doc_id, {joined(_participants_sql(UNI))} AS participants FROM ev")
def _(spark, d):
    return en.participants(evidence(spark, d).select("doc_id", F.col("content").alias("text")))


# pictures: one or two per document, text recognised = its content or only the start of it
_IMG = ("SELECT doc_id, 1 AS image_no, content AS ocr_text, CASE doc_id % 4 WHEN 0 THEN 'Screenshot of a chat' WHEN 1 THEN 'Threatening note' "
        "WHEN 2 THEN 'Picture of surveillance gear' ELSE 'A page' END AS description, CASE WHEN doc_id % 2 = 0 THEN 'photo' ELSE 'scan' END AS evidence_type FROM ev "
        "UNION ALL SELECT doc_id, 2, substring(content, 1, 120), 'cropped', 'detail' FROM ev WHERE doc_id % 2 = 0")
COMMON["images"] = _IMG


def images(spark, d):
    ev = evidence(spark, d)
    first = ev.select("doc_id", F.lit(1).alias("image_no"), F.col("content").alias("ocr_text"),
                      F.element_at(F.array(*map(F.lit, ["Screenshot of a chat", "Threatening note", "Picture of surveillance gear", "A page"])),
                                   (F.col("doc_id") % 4 + 1).cast("int")).alias("description"),
                      F.when(F.col("doc_id") % 2 == 0, "photo").otherwise("scan").alias("evidence_type"))
    second = F.array(F.struct(*[F.col(c) for c in first.columns]), F.struct(
        "doc_id", F.lit(2).alias("image_no"), F.substring("ocr_text", 1, 120).alias("ocr_text"),
        F.lit("cropped").alias("description"), F.lit("detail").alias("evidence_type")))
    pictures = F.when(F.col("doc_id") % 2 == 0, second).otherwise(F.slice(second, 1, 1))
    return first.select(F.explode(pictures).alias("p")).select("p.*")


def _label(lst: str, before: str, after: str = "") -> str:
    return f"list_transform({lst}, lambda w: concat({q(before)}, w, {q(after)}))"


def _found(text: str, words) -> str:
    return f"list_filter({lit_list(words)}, lambda w: contains({text}, w))"


def _flag(cond: str, label: str) -> str:
    return f"CASE WHEN {cond} THEN [{q(label)}] ELSE [] END"


_low, _desc = "lower(ocr_text)", "lower(description)"
IMG_SQL = {
    "timestamps": "list_concat(" + ", ".join(
        [_label(rx("ocr_text", p), "Date found: ") for p in lx.FOUND_DATE_PATTERNS]
        + [_label(rx("ocr_text", p), "Time found: ") for p in lx.FOUND_TIME_PATTERNS]) + ")",
    "financial_evidence": "list_concat(" + _label(_found(_low, lx.FINANCIAL_WORDS), "Financial keyword detected: '", "'") + ", "
        + f"CASE WHEN len({rx('ocr_text', lx.MONEY_PATTERN)}) > 0 THEN [concat('Dollar amounts found: ', array_to_string({rx('ocr_text', lx.MONEY_PATTERN)}[1:5], ', '))] ELSE [] END, "
        + _flag(f"regexp_matches(ocr_text, {q(lx.ACCOUNT_PATTERN)})", "Potential account numbers detected") + ")",
    "communication_evidence": "list_concat(" + _label(_found(_low, lx.PLATFORM_WORDS), "Communication platform: ") + ", "
        + _flag(f"regexp_matches(ocr_text, {q(lx.SHORT_PHONE_PATTERN)})", "Phone numbers detected") + ", "
        + _flag(f"regexp_matches(ocr_text, {q(lx.EMAIL_PATTERN)})", "Email addresses detected") + ", "
        + _flag(f"contains({_desc}, 'screenshot') AND (contains({_desc}, 'message') OR contains({_desc}, 'chat'))", "AI detected message screenshot") + ")",
    "abuse_indicators": "list_concat(" + _label(_found(_low, lx.ABUSE_WORDS), "Contains abuse-related language: '", "'") + ", "
        + _label(_found(_low, lx.FINANCIAL_CONTROL_WORDS), "Financial control indicator: '", "'") + ", "
        + _flag(any_sql(_desc, ["threatening", "intimidating"]), "AI detected threatening content") + ", "
        + _flag(any_sql(_desc, ["surveillance", "monitoring"]), "AI detected surveillance/monitoring evidence") + ")",
}
COMMON["imgfind"] = "SELECT *, " + ", ".join(f"{v} AS {k}" for k, v in IMG_SQL.items()) + " FROM images"


def _image_query(name, column, op):
    @query(name, f"SELECT doc_id, CAST(image_no AS BIGINT) AS image_no, {joined(column)} AS {column} FROM imgfind")
    def _(spark, d):
        return op(images(spark, d))


_image_query("timestamps_found", "timestamps", en.timestamps_found)
_image_query("financial_evidence", "financial_evidence", en.financial_evidence)
_image_query("communication_evidence", "communication_evidence", en.communication_evidence)
_image_query("abuse_indicators", "abuse_indicators", en.abuse_indicators)


@query("top_entities", "SELECT folder, value, mentions, CAST(rn AS BIGINT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY folder ORDER BY mentions DESC, value) AS rn FROM ("
       "SELECT folder, value, count(*) AS mentions FROM eindex JOIN cat_best USING (doc_id) GROUP BY folder, value) a) b WHERE rn <= 10")
def _(spark, d):
    ev = evidence(spark, d)
    return en.top_entities(en.entity_index(en.entities_sets(ev)), ca.categorize(ev).select("doc_id", "folder"))


# ---- 2.4 ----------------------------------------------------------------------------------
@query("category_scores", f"SELECT doc_id, category, CAST(hits AS BIGINT) AS hits, {r6('score')} AS score FROM cat_long")
def _(spark, d):
    return ca.category_scores(evidence(spark, d))


@query("categorize", f"SELECT doc_id, category, folder, {r6('confidence_score')} AS confidence_score FROM cat_best")
def _(spark, d):
    return ca.categorize(evidence(spark, d))


@query("subcategory_rules", "SELECT doc_id, subcategory FROM scored0")
def _(spark, d):
    return ca.subcategory_rules(plan.categorised(evidence(spark, d)), base.PARTY_RULES)


@query("fact_lexicon", r"""SELECT concat('USER_FACT_', CAST(item_id AS VARCHAR)) AS group_name, lower(w) AS keyword FROM (
  SELECT item_id, unnest(string_split_regex(text, '\s+')) AS w FROM benchmark) WHERE length(w) > 3 AND regexp_full_match(w, '\p{L}+')""")
def _(spark, d):
    return ca.fact_lexicon(table(spark, d, "benchmark").select(F.col("item_id").alias("fact_id"), F.col("text").alias("fact")))


_FAM = lx.CASE_TYPE_KEYWORDS["family_law"]


@query("case_type_dims", " UNION ALL ".join(
    f"SELECT doc_id, '{g}' AS category, CAST({hits_sql('lt', w)} AS BIGINT) AS hits, {r6(hits_sql('lt', w) + f' / {float(len(w))}')} AS score FROM cat_text WHERE {hits_sql('lt', w)} > 0"
    for g, w in _FAM.items()))
def _(spark, d):
    return ca.case_type_dims(evidence(spark, d), "family_law")


_FOLDERS = list(lx.CASE_TYPE_FOLDERS["family_law"])


@query("map_category", "SELECT doc_id, category, CASE " + " ".join(f"WHEN contains({q(f)}, upper(category)) THEN {q(f)}" for f in _FOLDERS)
       + f" ELSE {q(lx.REVIEW_FOLDER)} END AS folder FROM (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'communications' WHEN 1 THEN 'financial' WHEN 2 THEN 'Court_Records' WHEN 3 THEN 'reports' ELSE 'unheard of' END AS category FROM documents)")
def _(spark, d):
    cats = F.array(*map(F.lit, ["communications", "financial", "Court_Records", "reports", "unheard of"]))
    docs = table(spark, d, "documents").select("doc_id", F.element_at(cats, (F.col("doc_id") % 5 + 1).cast("int")).alias("category"))
    return ca.map_category(docs, _FOLDERS)


_FNCAT = "CASE " + " ".join(f"WHEN {any_sql('lower(file_name)', w)} THEN {q(f)}" for f, w in lx.FILENAME_KEYWORDS.items()) + " ELSE 'FOR_HUMAN_REVIEW' END"
COMMON["fncat"] = f"SELECT doc_id, {_FNCAT} AS folder FROM ev"


_HITS = [(c, k, g, w) for k, table_ in (("keywords", lx.CASE_TYPE_KEYWORDS), ("indicators", lx.CASE_TYPE_INDICATORS)) for c, gs in table_.items() for g, w in gs.items()]


@query("case_type_hits", " UNION ALL ".join(
    f"SELECT '{c}' AS case_type, '{k}' AS kind, '{g}' AS name, CAST(sum(CASE WHEN {hits_sql('lt', w)} > 0 THEN 1 ELSE 0 END) AS BIGINT) AS files, CAST(sum({hits_sql('lt', w)}) AS BIGINT) AS hits FROM cat_text"
    for c, k, g, w in _HITS))
def _(spark, d):
    return ca.case_type_hits(evidence(spark, d))


@query("case_type_folder", " UNION ALL ".join(
    f"SELECT doc_id, category, {q(c)} AS case_type, CASE " + " ".join(f"WHEN contains({q(f.upper())}, upper(category)) THEN {q(f)}" for f in tree)
    + f" ELSE {q(lx.REVIEW_FOLDER)} END AS folder FROM (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'communications' WHEN 1 THEN 'financial' WHEN 2 THEN 'Medical' WHEN 3 THEN 'reports' ELSE 'unheard of' END AS category FROM documents) x"
    for c, tree in lx.CASE_TYPE_FOLDERS.items()))
def _(spark, d):
    cats = F.array(*map(F.lit, ["communications", "financial", "Medical", "reports", "unheard of"]))
    return ca.case_type_folder(table(spark, d, "documents").select("doc_id", F.element_at(cats, (F.col("doc_id") % 5 + 1).cast("int")).alias("category")))


@query("filename_categorize", "SELECT doc_id, folder FROM fncat")
def _(spark, d):
    return ca.filename_categorize(evidence(spark, d))


# a user's scheme; priorities decide the order of folders
SCHEME = [
    {"folder": "MONEY", "priority": 20, "ai_tags": ["financial"], "content_keywords": ["receipt", "offshore"], "filename_keywords": ["bank"]},
    {"folder": "SAFETY", "priority": 10, "content_keywords": ["hit", "stalkerware", "lie"]},
    {"folder": "COURT", "priority": 30, "ai_tags": ["evidence"], "content_keywords": ["motion", "custody"], "filename_keywords": ["motion"]},
    {"folder": "LETTERS", "filename_keywords": ["letter", "message"]},
]


def _scheme_sql() -> str:
    whens = []
    for s in sorted(SCHEME, key=lambda s: s.get("priority", 99)):
        f = s["folder"]
        if s.get("ai_tags"):
            m = f"list_filter({lit_list(s['ai_tags'])}, lambda t: list_contains(tags, t))"
            whens.append((f"len({m}) > 0", f, "AI tag(s)", m))
        if s.get("content_keywords"):
            m = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(st, '\\b{k}\\b') THEN '{k}' END" for k in s["content_keywords"]) + "], lambda x: x IS NOT NULL)"
            whens.append((f"len({m}) > 0", f, "content keyword(s)", m))
        if s.get("filename_keywords"):
            m = f"list_filter({lit_list(s['filename_keywords'])}, lambda t: contains(lower(file_name), t))"
            whens.append((f"len({m}) > 0", f, "filename keyword(s)", m))
    folder = "CASE " + " ".join(f"WHEN {c} THEN '{f}'" for c, f, _, _ in whens) + " ELSE 'FOR_HUMAN_REVIEW' END"
    reason = "CASE " + " ".join(f"WHEN {c} THEN concat('Matched {lab}: ', array_to_string({m}, ', '))" for c, _, lab, m in whens) \
        + " ELSE 'Sent to human review (no criteria matched)' END"
    return f"SELECT doc_id, {folder} AS folder, {reason} AS reason FROM (SELECT doc_id, file_name, lower(content) AS st, CASE WHEN doc_id % 9 = 0 THEN tags ELSE [] END AS tags FROM ev JOIN ctags USING (doc_id))"


_TAGS = "list_sort(list_filter([" + ", ".join(f"CASE WHEN {any_sql('lower(content)', w)} THEN {q(t)} END" for t, w in lx.CONCEPT_KEYWORDS.items()) + "], lambda x: x IS NOT NULL))"
COMMON["ctags"] = f"SELECT doc_id, {_TAGS} AS tags FROM ev"


@query("scheme_categorize", _scheme_sql())
def _(spark, d):
    ev = evidence(spark, d).withColumn("tags", F.when(F.col("doc_id") % 9 == 0, F.array_sort(ca.tags_col(F.col("content")))))
    return ca.scheme_categorize(ev.withColumn("search_text", F.col("content")), SCHEME)


@query("concept_tags", "SELECT doc_id, array_to_string(list_sort(list_concat(tags, CASE WHEN doc_id % 3 = 0 THEN ['legally_significant'] ELSE [] END, CASE WHEN doc_id % 5 > 3 THEN ['high_confidence'] ELSE [] END)), '|') AS tags FROM ctags")
def _(spark, d):
    ev = evidence(spark, d).withColumn("legal_significance", F.when(F.col("doc_id") % 3 == 0, "yes")) \
        .withColumn("ai_confidence", F.when(F.col("doc_id") % 5 > 3, 0.9).otherwise(0.8))
    return ca.concept_tags(ev)


@query("tag_semi", "SELECT doc_id, array_to_string(tags, '|') AS tags FROM ctags WHERE list_has_any(tags, ['contract', 'misconduct'])")
def _(spark, d):
    return ca.tag_semi(ca.concept_tags(evidence(spark, d)), ["contract", "misconduct"])


# ---- dated mentions in SQL (shared with the timeline queries) -------------------------------
def _mdate(y, m, d):
    return f"TRY_CAST(concat(lpad(CAST({y} AS VARCHAR), 4, '0'), '-', lpad(CAST({m} AS VARCHAR), 2, '0'), '-', lpad(CAST({d} AS VARCHAR), 2, '0')) AS DATE)"


def _mention(fmt, pattern, conf):
    named = fmt in ("Month DD, YYYY", "DD Month YYYY")
    g = [f"regexp_extract(raw_match, {q(pattern)}, {i})" for i in (1, 2, 3)]
    if named:
        mon = g[0] if fmt.startswith("Month") else g[1]
        day = g[1] if fmt.startswith("Month") else g[0]
        date = _mdate(g[2], f"list_position({lit_list(lx.MONTHS)}, lower(substring({mon}, 1, 3)))", day)
    elif fmt == "YYYY-MM-DD":
        date = _mdate(*g)
    else:
        year = g[2] if fmt.endswith("YYYY") else f"(CAST({g[2]} AS INT) + CASE WHEN CAST({g[2]} AS INT) < 70 THEN 2000 ELSE 1900 END)"
        date = f"coalesce({_mdate(year, g[0], g[1])}, {_mdate(year, g[1], g[0])})"
    return (f"SELECT doc_id, file_name, file_path, start AS position, raw_match AS raw_date, {q(fmt)} AS format, {conf}::DOUBLE AS confidence, "
            f"substring(txt, greatest(0, start - 100) + 1, start + length(raw_match) + 100 - greatest(0, start - 100)) AS context, txt AS content, {date} AS event_date FROM ("
            + positions_sql("ev", "content", pattern, "doc_id, file_name, file_path") + ") p")


COMMON["mentions"] = " UNION ALL ".join(_mention(*p) for p in lx.DATE_PATTERNS)
COMMON["parsed"] = "SELECT * FROM mentions WHERE event_date IS NOT NULL"


def mentions(spark, d):
    return tl.date_mentions(evidence(spark, d).select("doc_id", "file_name", "file_path", "content"))


_ETYPE = "CASE " + " ".join(f"WHEN {any_sql('lower(file_name)' if place == 'name' else 'lower(context)', w)} THEN {q(label)}" for label, place, w in lx.EVENT_TYPE_RULES) + " ELSE 'general' END"
_LC = "lower(context)"


@query("event_type", f"SELECT doc_id, position, format, {_ETYPE} AS event_type, CASE WHEN {any_sql(_LC, ['meeting', 'call'])} THEN 'communication' WHEN {any_sql(_LC, ['payment', 'invoice', 'transfer'])} THEN 'financial' "
       f"WHEN contains({_LC}, 'incident') OR (contains({_LC}, 'report') AND contains({_LC}, 'police')) THEN 'legal_incident' ELSE 'general_mention' END AS event_type_simple FROM parsed")
def _(spark, d):
    return ca.event_type(tl.date_parse(mentions(spark, d)))


ARG_SQL = "CASE " + " ".join(f"WHEN contains(folder, {q(p)}) THEN {q(n)}" for p, n in lx.ARGUMENT_OF_CATEGORY) + f" ELSE {q(lx.DEFAULT_ARGUMENT)} END"


@query("argument_of", f"SELECT doc_id, {ARG_SQL} AS argument FROM cat_best")
def _(spark, d):
    return ca.argument_of(ca.categorize(evidence(spark, d)))


_DIM = " UNION ALL ".join(f"SELECT {q(f)} AS folder" for f in [*lx.FILENAME_KEYWORDS, "NEVER_USED", "FOR_HUMAN_REVIEW"])


@query("categorize_summary", f"SELECT folder, n AS files, CASE WHEN folder <> 'FOR_HUMAN_REVIEW' THEN n ELSE 0 END AS categorised, CASE WHEN folder = 'FOR_HUMAN_REVIEW' THEN n ELSE 0 END AS for_review FROM ("
       f"SELECT d.folder, count(c.doc_id) AS n FROM ({_DIM}) d LEFT JOIN fncat c ON c.folder = d.folder GROUP BY d.folder) s")
def _(spark, d):
    dim = spark.createDataFrame([(f,) for f in [*lx.FILENAME_KEYWORDS, "NEVER_USED"]], "folder string")
    return ca.categorize_summary(ca.filename_categorize(evidence(spark, d)), dim)


# ---- 2.5 ----------------------------------------------------------------------------------
@query("probative", f"SELECT doc_id, {r6('probative_value')} AS probative_value FROM scored0")
def _(spark, d):
    return sc.probative(evidence(spark, d))


_FACT_WORDS = ["custody", "account", "surveillance"]


@query("probative_with_facts", f"SELECT doc_id, {r6('least(' + hits_sql('lower(content)', lx.PROBATIVE_WORDS + _FACT_WORDS) + ' / 10.0, 1.0)')} AS probative_value FROM ev")
def _(spark, d):
    return sc.probative(evidence(spark, d), _FACT_WORDS)


@query("prejudicial", f"SELECT doc_id, {r6('prejudicial_value')} AS prejudicial_value FROM scored0")
def _(spark, d):
    return sc.prejudicial(evidence(spark, d))


@query("admissibility", f"SELECT doc_id, {r6('admissibility_score')} AS admissibility_score FROM scored0")
def _(spark, d):
    return sc.admissibility(evidence(spark, d))


@query("overall_impact", f"SELECT doc_id, {r6('relevance_score')} AS relevance_score, {r6('overall_impact')} AS overall_impact FROM scored")
def _(spark, d):
    return sc.overall_impact(base.run(spark, d))


@query("human_review", "SELECT doc_id, requires_human_review, category, predicted_category FROM scored")
def _(spark, d):
    return sc.human_review(base.run(spark, d))


COMMON["imgroll"] = ("SELECT doc_id, count(*) AS total_images, string_agg(ocr_text, chr(10) ORDER BY image_no) AS combined_text, "
                     + ", ".join(f"list_sort(list_distinct(flatten(list({c})))) AS {c}" for c in IMG_SQL)
                     + ", list(evidence_type ORDER BY image_no) AS evidence_types FROM imgfind GROUP BY doc_id")


def image_rollup(spark, d):
    img = images(spark, d)
    text, desc = F.col("ocr_text"), F.col("description")
    found = img.select("doc_id", "image_no", "ocr_text", "evidence_type", en.timestamps_col(text).alias("timestamps"),
                       en.financial_col(text).alias("financial_evidence"), en.communication_col(text, desc).alias("communication_evidence"),
                       en.abuse_col(text, desc).alias("abuse_indicators"))
    return rp.image_rollup(found)


@query("image_rollup", f"SELECT doc_id, total_images, combined_text, {joined('abuse_indicators')} AS abuse_indicators, {joined('financial_evidence')} AS financial_evidence, "
       f"{joined('communication_evidence')} AS communication_evidence, {joined('timestamps')} AS timestamps, {joined('evidence_types')} AS evidence_types FROM imgroll")
def _(spark, d):
    return image_rollup(spark, d)


@query("image_boost", f"""SELECT doc_id, {r6('least(1.0, p3 + CASE WHEN contains(folder, ' + q('TEXT_MESSAGES') + ') AND len(communication_evidence) > 0 THEN 0.2 ELSE 0 END)')} AS probative_value FROM (
  SELECT *, least(1.0, p2 + CASE WHEN contains(folder, 'NON_DISCLOSURE') AND len(financial_evidence) > 0 THEN 0.4 ELSE 0 END) AS p3 FROM (
  SELECT *, least(1.0, p1 + CASE WHEN contains(folder, 'ELECTRONIC_ABUSE') AND len(abuse_indicators) > 0 THEN 0.2 ELSE 0 END) AS p2 FROM (
  SELECT *, least(1.0, probative_value + CASE WHEN contains(folder, 'FRAUD_ON_THE_COURT') AND len(abuse_indicators) > 0 THEN 0.3 ELSE 0 END) AS p1 FROM scored0 JOIN imgroll USING (doc_id))))""")
def _(spark, d):
    return sc.image_boost(base.run(spark, d), image_rollup(spark, d))


STRENGTH_SQL = ("greatest(0.1, least(1.0, 0.5 + 0.1 * CASE event_type " + " ".join(
    f"WHEN '{k}' THEN {hits_sql('lower(description)', w)}" for k, w in lx.STRENGTH_INDICATORS.items())
    + f" ELSE 0 END - 0.1 * {hits_sql('lower(description)', lx.UNCERTAINTY_WORDS)}))::DOUBLE")
_EV_TYPE_PART = "unnest(list_filter([" + ", ".join(
    f"CASE WHEN regexp_matches(lower(context), {q('|'.join(ps))}) THEN '{k}' END" for k, ps in lx.EVENT_PATTERNS.items()) + "], lambda x: x IS NOT NULL))"
COMMON["pevents"] = (
    f"SELECT *, {STRENGTH_SQL} AS evidence_strength FROM (SELECT parsed.*, folder, {_EV_TYPE_PART} AS event_type, "
    r"regexp_replace(substring(content, greatest(0, position - 200) + 1, position + 200 - greatest(0, position - 200)), '^\s+|\s+$', '', 'g') AS description "
    "FROM parsed JOIN cat_best USING (doc_id)) x")


@query("evidence_strength", f"SELECT doc_id, position, format, event_type, {r6('evidence_strength')} AS evidence_strength FROM pevents")
def _(spark, d):
    ev = plan.categorised(evidence(spark, d)).select("doc_id", "file_path", "folder", "content")
    events = tl.pattern_events(tl.date_parse(tl.date_mentions(ev)))
    return sc.evidence_strength(events.withColumn("context", F.col("description")))


@query("event_confidence", f"SELECT doc_id, position, format, {r6('least(1.0, 0.5 + 0.1 * ' + hits_sql(_LC, lx.EVENT_CONFIDENCE_WORDS) + ')')} AS confidence, "
       "CASE WHEN length(context) > 50 THEN 0.7 ELSE 0.5 END::DOUBLE AS confidence_by_length FROM parsed")
def _(spark, d):
    return sc.event_confidence(tl.date_parse(mentions(spark, d)))


# answers about a score: prose around an object, bare, none, broken, a word for a number
_SCORE = ("SELECT doc_id, score_type, doc_id % 11 <> 0 AS success, CASE doc_id % 6 WHEN 0 THEN concat('Sure: {\"score\": 0.', CAST(doc_id % 10 AS VARCHAR(9)), ', \"justification\": \"', score_type, ' fits\"} {more}') "
          "WHEN 1 THEN '{\"score\": 1.7, \"justification\": \"too high\"}' WHEN 2 THEN concat('no object for ', CAST(doc_id AS VARCHAR(20))) WHEN 3 THEN '{\"score\": }' "
          "WHEN 4 THEN '{\"score\": \"high\", \"justification\": \"a word\"}' ELSE '{\"score\": -2}' END AS raw_response FROM {{documents}} d "
          "CROSS JOIN (SELECT 'relevance' AS score_type UNION ALL SELECT 'admissibility_concern') t").replace("{{documents}}", "{documents}")
COMMON["score_answers"] = _SCORE.replace("{documents}", "documents")
_OBJ = r"regexp_extract(raw_response, '(?s)\{.*?\}', 0)"
COMMON["scores"] = (
    "SELECT doc_id, score_type, CASE kind WHEN 'failed' THEN -1.0 WHEN 'ok' THEN coalesce(greatest(0.0, least(1.0, CASE WHEN json_type(o, '$.score') IN ('DOUBLE', 'UBIGINT', 'BIGINT') THEN CAST(json_extract_string(o, '$.score') AS DOUBLE) END)), 0.0) ELSE 0.0 END AS score, "
    "CASE kind WHEN 'failed' THEN 'AI task failed' WHEN 'none' THEN concat('AI response not valid JSON: ', substring(raw_response, 1, 100)) WHEN 'broken' THEN concat('AI response parsing error: ', substring(raw_response, 1, 100)) "
    "ELSE coalesce(json_extract_string(o, '$.justification'), 'No justification from AI.') END AS justification, "
    "CASE kind WHEN 'failed' THEN 'AI task failed' WHEN 'none' THEN 'AI response not valid JSON' WHEN 'broken' THEN 'JSON parsing error' END AS error FROM ("
    f"SELECT *, CASE WHEN json_valid({_OBJ}) THEN {_OBJ} END AS o, CASE WHEN NOT success THEN 'failed' WHEN {_OBJ} = '' THEN 'none' WHEN NOT json_valid({_OBJ}) THEN 'broken' ELSE 'ok' END AS kind FROM score_answers) k")


def score_answers(spark, d):
    n, doc = F.col("doc_id") % 6, F.col("doc_id")
    texts = [
        F.concat(F.lit('Sure: {"score": 0.'), (doc % 10).cast("string"), F.lit(', "justification": "'), "score_type", F.lit(' fits"} {more}')),
        F.lit('{"score": 1.7, "justification": "too high"}'), F.concat(F.lit("no object for "), doc.cast("string")),
        F.lit('{"score": }'), F.lit('{"score": "high", "justification": "a word"}'), F.lit('{"score": -2}')]
    docs = table(spark, d, "documents").select("doc_id", F.explode(F.array(F.lit("relevance"), F.lit("admissibility_concern"))).alias("score_type"))
    return docs.select("doc_id", "score_type", (doc % 11 != 0).alias("success"), F.element_at(F.array(*texts), (n + 1).cast("int")).alias("raw_response"))


@query("score_table", f"SELECT doc_id, score_type, {r6('score')} AS score, justification, error FROM scores")
def _(spark, d):
    return sc.score_table(score_answers(spark, d))


@query("scoring_summary", "SELECT count(DISTINCT doc_id) AS files_considered, count(DISTINCT CASE WHEN error IS NULL THEN doc_id END) AS files_scored, count(error) AS errors FROM scores")
def _(spark, d):
    return sc.scoring_summary(sc.score_table(score_answers(spark, d)))
