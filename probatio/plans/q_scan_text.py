"""Registered queries for survey sections 2.1 and 2.2."""

from pyspark.sql import functions as F

from probatio import lexicons as lx
from probatio.config import ScoringConfig
from probatio.operators import custody
from probatio.operators import projections as pj
from probatio.operators import scans as sn
from probatio.plans import scored as plan
from probatio.plans.registry import COMMON, lit_list, positions_sql, q, query, r6
from probatio.plans.registry import any_sql, hits_sql
from probatio.session import fresh_path, written
from probatio.sources import files as fs
from probatio.sources import sinks
from probatio.sources.sinks import write_bundle
from probatio.sources.evidence import evidence, table

# thresholds under which a fair share of the sample stays out of review
RUN = ScoringConfig(min_relevance=0.2, min_impact=0.2)
# parties whose co-mention decides the subcategory (a parameter of the rule)
PARTY_RULES = [("alder", "gale", "ALDER_TO_GALE"), ("birch", "hazel", "BIRCH_TO_HAZEL"),
               ("whatsapp", "screenshot", "CHAT_SCREENSHOTS")]


# ---- oracle tables of the rule-based run ---------------------------------------------------
def _folder_case(expr: str) -> str:
    whens = " ".join(f"WHEN {q(c)} THEN {q(f)}" for c, f in lx.CATEGORY_FOLDERS.items())
    return f"CASE {expr} {whens} ELSE {q(lx.REVIEW_FOLDER)} END"


COMMON["cat_long"] = " UNION ALL ".join(
    f"SELECT doc_id, {q(c)} AS category, {i} AS ord, {hits_sql('lt', words)} AS hits, "
    f"{hits_sql('lt', words)} / {float(len(words))} AS score FROM cat_text"
    for i, (c, words) in enumerate(lx.CATEGORY_KEYWORDS.items()))
COMMON["cat_text"] = "SELECT doc_id, lower(concat(content, ' ', file_name)) AS lt FROM ev"
COMMON["cat_best"] = (
    "SELECT doc_id, CASE WHEN score > 0 THEN category END AS category, CASE WHEN score > 0 THEN "
    + _folder_case("category") + f" ELSE {q(lx.REVIEW_FOLDER)} END AS folder, score AS confidence_score FROM ("
    "SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, ord) AS rn FROM cat_long) c WHERE rn = 1")
_SUB = "CASE WHEN folder <> '08_TEXT_MESSAGES' THEN '' " + " ".join(
    f"WHEN contains(lc, {q(a)}) AND contains(lc, {q(b)}) THEN {q(label)}" for a, b, label in PARTY_RULES) + " ELSE '' END"
_SUMMARY = r"regexp_replace(array_to_string(string_split(content, '.')[1:3], '. '), '^\s+|\s+$', '', 'g')"
_WORDS5 = r"list_filter(string_split_regex(summary, '\s+'), lambda w: w <> '')[1:5]"
_EXT = r"regexp_extract(file_name, '(\.[^./]+)$', 1)"
_NAME = (
    "concat(strftime(created_ts, '%y%m%d'), '-', CASE folder "
    + " ".join(f"WHEN {q(f)} THEN {q(c)}" for f, c in lx.FOLDER_CODES.items())
    + r" ELSE 'UNK' END, '-', substring(regexp_replace(CASE WHEN summary <> '' THEN array_to_string(list_transform("
    + _WORDS5 + r", lambda w: trim(w, '.,!?')), '_') ELSE regexp_replace(file_name, '\.[^./]+$', '') END, '[^\p{L}\p{N}_-]', '', 'g'), 1, 30), "
    + _EXT + ")")
COMMON["scored0"] = (
    f"SELECT *, {_SUB} AS subcategory, {_NAME} AS new_name, least({hits_sql('lc', lx.PROBATIVE_WORDS)} / 5.0, 1.0) AS probative_value, "
    f"least({hits_sql('lc', lx.PREJUDICIAL_WORDS)} / 5.0, 1.0) AS prejudicial_value, confidence_score AS relevance_score, "
    "CASE WHEN file_type IN ('PDF Document', 'Word Document') THEN 0.8 WHEN file_type IN ('Email', 'Text File') THEN 0.6 "
    f"WHEN file_type = 'Image' THEN 0.4 ELSE 0.5 END::DOUBLE * CASE WHEN {any_sql('lc', lx.PRIVILEGE_WORDS)} THEN 0.7 ELSE 1.0 END::DOUBLE AS admissibility_score "
    f"FROM (SELECT ev.*, lower(content) AS lc, {_SUMMARY} AS summary, folder, confidence_score FROM ev JOIN cat_best USING (doc_id)) s0")
COMMON["scored"] = (
    "SELECT *, CASE WHEN requires_human_review THEN '09_FOR_HUMAN_REVIEW' ELSE folder END AS category, folder AS predicted_category FROM ("
    f"SELECT *, confidence_score < {RUN.min_relevance} OR overall_impact < {RUN.min_impact} AS requires_human_review FROM ("
    "SELECT *, greatest(0.0, least(1.0, 0.4 * probative_value + 0.3 * relevance_score + 0.3 * admissibility_score - 0.1 * prejudicial_value)) AS overall_impact "
    "FROM scored0) s1) s2")
COMMON["dups"] = (
    "SELECT doc_id, file_hash, rn > 1 AS is_duplicate, CASE WHEN rn > 1 THEN first_path END AS duplicate_of FROM (SELECT doc_id, file_hash, "
    "row_number() OVER w AS rn, first_value(file_path) OVER w AS first_path FROM ev WINDOW w AS (PARTITION BY file_hash ORDER BY doc_id)) d0")
COMMON["scored_dup"] = "SELECT scored.*, is_duplicate, duplicate_of FROM scored JOIN (SELECT doc_id, is_duplicate, duplicate_of FROM dups) d1 USING (doc_id)"


def run(spark, d):
    return plan.scored(evidence(spark, d), RUN, PARTY_RULES)


def run_dup(spark, d):
    return plan.scored_with_duplicates(evidence(spark, d), RUN, PARTY_RULES)


# ---- 2.1 ----------------------------------------------------------------------------------
# one file per source and kind, of wanted and unwanted extensions; a line ends each text
@query("corpus_scan", "SELECT source, '.txt' AS extension, CAST(sum(octet_length(encode(content)) + 1) AS BIGINT) AS length FROM ev GROUP BY source "
       "UNION ALL SELECT source, '.csv', CAST(sum(octet_length(encode(CAST(doc_id AS VARCHAR))) + 1) AS BIGINT) FROM ev GROUP BY source")
def _(spark, d):
    path = fresh_path(spark, "corpus")
    ev = evidence(spark, d)
    ev.select("source", "content").repartition("source").write.partitionBy("source").text(f"{path}/text")
    ev.select("source", F.col("doc_id").cast("string").alias("v")).repartition("source").write.partitionBy("source").csv(f"{path}/table")
    ev.select("source", F.struct("doc_id").alias("v")).write.partitionBy("source").json(f"{path}/other")  # not an extension to scan
    found = fs.corpus_scan(spark, path, [".txt", ".CSV"])
    return found.select(F.regexp_extract("path", "source=([^/]*)", 1).alias("source"), "extension", "length")


_FT = "CASE extension " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in lx.FILE_TYPES.items()) + " ELSE 'Unknown' END"
_XC = "CASE extension " + " ".join(f"WHEN {q(e)} THEN {q(c)}" for c, es in lx.EXTENSION_CATEGORIES.items() for e in es) + " END"
_TS = "strftime({}, '%Y-%m-%d %H:%M:%S')"


@query("file_metadata", f"SELECT file_path, file_name, extension, {_FT} AS file_type, file_size, "
       f"{_TS.format('created_ts')} AS created_ts, {_TS.format('modified_ts')} AS modified_ts FROM ev")
def _(spark, d):
    return sn.file_metadata(evidence(spark, d))


@query("ext_category", f"SELECT file_path, extension, {_XC} AS category, {_XC} IS NOT NULL AS supported FROM ev")
def _(spark, d):
    return sn.ext_category(evidence(spark, d))


@query("mime_type", "SELECT file_path, CASE extension " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in lx.MIME_TYPES.items())
       + f" ELSE {q(lx.DEFAULT_MIME)} END AS mime_type FROM ev")
def _(spark, d):
    return sn.mime_type(evidence(spark, d))


@query("content_hashes", "SELECT file_path, sha256(raw) AS sha256, md5(raw) AS md5, sha1(raw) AS sha1 FROM ev")
def _(spark, d):
    return sn.content_hashes(evidence(spark, d), ["sha256", "md5", "sha1", "crc7"])


_LATIN = r"regexp_full_match(text, '(?s)[\x00-\xFF]*') AND regexp_matches(text, '[\x80-\xFF]') AND doc_id % 2 = 1"


@query("text_decode", "SELECT doc_id, text AS content, CASE WHEN " + _LATIN + " THEN 'latin-1' ELSE 'utf-8' END AS encoding_used, "
       "CAST(len(string_split(text, chr(10))) AS BIGINT) AS line_count FROM documents")
def _(spark, d):
    latin = F.rlike("text", F.lit(r"(?s)^[\x00-\xFF]*$")) & (F.col("doc_id") % 2 == 1)
    data = F.when(latin, F.encode("text", "ISO-8859-1")).otherwise(F.encode("text", "UTF-8"))
    return fs.text_decode(table(spark, d, "documents").select("doc_id", data.alias("content")), "doc_id")


@query("csv_profile", "SELECT concat('c_nationkey=', CAST(c_nationkey AS VARCHAR)) AS path, count(*) AS rows, CAST(4 AS BIGINT) AS columns, "
       "'c_custkey,c_name,c_acctbal,c_mktsegment' AS column_names FROM customer GROUP BY c_nationkey")
def _(spark, d):
    path = fresh_path(spark, "csv")
    table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment") \
        .write.partitionBy("c_nationkey").option("header", True).csv(path)
    files = fs.csv_profile(spark, path)
    return files.groupBy(F.regexp_extract("path", r"(c_nationkey=\d+)", 1).alias("path"), "columns", "column_names").agg(
        F.sum("rows").alias("rows")).select("path", "rows", "columns", "column_names")


@query("email_extract", "SELECT conv_id * 1000 + turn AS key, concat('Conversation ', CAST(conv_id AS VARCHAR)) AS subject, "
       "concat(role, '@example.org') AS sender, CASE WHEN turn % 2 = 0 THEN 'desk@example.org' ELSE 'Unknown Recipient' END AS recipient, "
       "'Unknown Date' AS sent, sha256(concat(text, chr(10))) AS body_hash, turn % 3 = 0 AS is_multipart FROM conversations")
def _(spark, d):
    head = F.concat(F.lit("Subject: Conversation "), "conv_id", F.lit("\r\nFrom: "), "role", F.lit("@example.org\r\n"),
                    F.when(F.col("turn") % 2 == 0, "To: desk@example.org\r\n").otherwise(""), F.lit("MIME-Version: 1.0\r\n"))
    part = F.concat(F.lit("Content-Type: text/plain; charset=utf-8\r\nContent-Transfer-Encoding: 8bit\r\n\r\n"), "text", F.lit("\n"))
    multi = F.concat(F.lit("Content-Type: multipart/mixed; boundary=BOUND\r\n\r\n--BOUND\r\n"), part,
                     F.lit("\r\n--BOUND\r\nContent-Type: text/html\r\n\r\n<p>x</p>\r\n--BOUND--\r\n"))
    eml = F.encode(F.concat(head, F.when(F.col("turn") % 3 == 0, multi).otherwise(part)), "UTF-8")
    mails = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("key"), eml.alias("content"))
    return fs.email_extract(mails, "key").select("key", "subject", "sender", "recipient", "sent",
                                                 F.sha2("body", 256).alias("body_hash"), "is_multipart")


@query("results_json", "SELECT doc_id, file_path, file_name, new_name, file_hash, file_size, file_type, "
       "strftime(created_ts, '%Y-%m-%dT%H:%M:%S') AS created_date, strftime(modified_ts, '%Y-%m-%dT%H:%M:%S') AS modified_date, "
       f"substring(content, 1, 500) AS content_preview, summary, category, subcategory, {r6('confidence_score')} AS confidence_score, "
       f"{r6('probative_value')} AS probative_value, {r6('prejudicial_value')} AS prejudicial_value, {r6('relevance_score')} AS relevance_score, "
       f"{r6('admissibility_score')} AS admissibility_score, {r6('overall_impact')} AS overall_impact, is_duplicate, duplicate_of, "
       "requires_human_review FROM scored_dup")
def _(spark, d):
    return sn.results_table(run_dup(spark, d))


@query("organize_sink", "SELECT doc_id, file_path, category, subcategory, concat_ws('/', category, nullif(subcategory, ''), new_name) AS target_path "
       "FROM scored_dup WHERE NOT is_duplicate OR overall_impact > 0.7 OR probative_value > 0.8")
def _(spark, d):
    return sn.organize_manifest(run_dup(spark, d))


@query("custody_ledger", f"SELECT file_path AS rel_path, file_hash AS sha256, file_size AS size, {_TS.format('modified_ts')} AS modified_ts, "
       "concat('/evidence/', file_path) AS full_path FROM ev")
def _(spark, d):
    return sn.custody_ledger(evidence(spark, d))


# three runs of an inventory: in the second, which is stored twice, some files are gone; in the third they are back and others changed
def custody_runs(spark, d):
    path, ev = fresh_path(spark, "custody"), evidence(spark, d)
    ev = ev.withColumn("file_path", F.concat_ws("/", "doc_id", "file_path"))  # paths of the sample repeat; a ledger has each once a run
    ev = written(ev.select("doc_id", "file_path", "raw", "file_size", "modified_ts"), "inventory")  # joined once for all runs
    fewer = ev.where(F.col("doc_id") % 7 != 0)
    changed = ev.withColumn("raw", F.when(F.col("doc_id") % 5 == 0, F.concat("raw", F.lit("+"))).otherwise(F.col("raw")))
    for run, files in (("2024-01-01", ev), ("2024-02-01", fewer), ("2024-02-01", fewer), ("2024-03-01", changed)):
        sinks.append_custody(files, F.lit(run), path)
    return sinks.read_custody(spark, path)


@query("custody_changes", "SELECT '2024-01-01' AS run_ts, concat(doc_id, '/', file_path) AS rel_path, 'added' AS change FROM ev "
       "UNION ALL SELECT '2024-02-01', concat(doc_id, '/', file_path), CASE WHEN doc_id % 7 = 0 THEN 'missing' ELSE 'unchanged' END FROM ev "
       "UNION ALL SELECT '2024-03-01', concat(doc_id, '/', file_path), CASE WHEN doc_id % 7 = 0 THEN 'added' WHEN doc_id % 5 = 0 THEN 'modified' ELSE 'unchanged' END FROM ev")
def _(spark, d):
    return custody.custody_changes(custody_runs(spark, d))


@query("custody_compare", "SELECT concat(doc_id, '/', file_path) AS rel_path, CASE WHEN doc_id % 5 = 0 THEN 'modified' ELSE 'unchanged' END AS change FROM ev")
def _(spark, d):
    return custody.custody_compare(custody_runs(spark, d), "2024-01-01", "2024-03-01")


@query("custody_latest", "SELECT concat(doc_id, '/', file_path) AS rel_path, '2024-03-01' AS run_ts, CASE WHEN doc_id % 5 = 0 THEN sha256(concat(raw, '+')) ELSE file_hash END AS sha256 FROM ev")
def _(spark, d):
    return custody.custody_latest(custody_runs(spark, d)).select("rel_path", "run_ts", "sha256")


# written and read back; the fields of each record are taken out of its JSON
@query("export_bundle", f"SELECT 'files' AS table_name, 'Sample' AS case_name, CAST(doc_id AS VARCHAR) AS id, new_name AS name, {r6('overall_impact')} AS value FROM scored "
       "UNION ALL SELECT 'categories', 'Sample', category, subcategory, CAST(count(*) AS DOUBLE) FROM scored GROUP BY category, subcategory")
def _(spark, d):
    s, path = written(run(spark, d).select("doc_id", "new_name", "category", "subcategory", "overall_impact"), "scored"), fresh_path(spark, "bundle")
    write_bundle({"case_name": "Sample", "source": "documents"}, {
        "files": s.select(F.col("doc_id").cast("string").alias("id"), F.col("new_name").alias("name"), F.col("overall_impact").alias("value")),
        "categories": s.groupBy(F.col("category").alias("id"), F.col("subcategory").alias("name")).agg(F.count("*").cast("double").alias("value"))}, path)
    read = spark.read.schema("header string, record string, table_name string").json(path)
    record = F.from_json("record", "id string, name string, value double")
    return read.select("table_name", F.get_json_object("header", "$.case_name").alias("case_name"), record.alias("r")) \
        .select("table_name", "case_name", "r.*")


@query("lexicon_load", r"""SELECT concat('item_', CAST(item_id AS VARCHAR)) AS group_name, 'words' AS sub_pattern, w AS keyword, 0.5::DOUBLE AS base_confidence,
  CASE WHEN item_id % 2 = 0 THEN 0.1 ELSE 0.05 END::DOUBLE AS boost, 'Pattern of ''words'' detected.' AS template
  FROM (SELECT item_id, unnest(string_split(text, ' ')) AS w FROM benchmark WHERE item_id % 5 <> 0)""")
def _(spark, d):
    path = fresh_path(spark, "rules")
    words = F.split("text", " ")
    body = F.to_json(F.struct(
        words.alias("keywords"), F.when(F.col("item_id") % 2 == 0, 0.1).alias("default_confidence_boost")))
    broken = F.concat(F.lit('{"item_'), "item_id", F.lit('": "not a group"}'))
    good = F.concat(F.lit('{"item_'), "item_id", F.lit('": {"sub_patterns": {"words": '), body, F.lit("}}}"))
    table(spark, d, "benchmark").select(F.when(F.col("item_id") % 5 == 0, broken).otherwise(good).alias("value")).write.text(path)
    return fs.lexicon_load(spark, path)


# ---- 2.2 ----------------------------------------------------------------------------------
@query("content_truncate", "SELECT doc_id, substring(content, 1, 5000) AS content FROM ev")
def _(spark, d):
    return pj.content_truncate(evidence(spark, d))


@query("lead3_summary", f"SELECT doc_id, {_SUMMARY} AS summary FROM ev")
def _(spark, d):
    return pj.lead3_summary(evidence(spark, d))


@query("basic_summary", r"""SELECT doc_id, CASE WHEN len(p) = 0 THEN CASE WHEN length(content) > 200 THEN concat(substring(content, 1, 200), '...') ELSE content END
  WHEN length(j) > 500 THEN concat(substring(j, 1, 497), '...') ELSE j END AS summary FROM (SELECT *, array_to_string(p[1:3], '. ') AS j FROM (
  SELECT doc_id, content, list_filter(list_transform(string_split(replace(content, chr(10), ' '), '.'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS p FROM ev))""")
def _(spark, d):
    return pj.basic_summary(evidence(spark, d))


@query("prefix_summary", "SELECT doc_id, CASE WHEN length(content) > 500 THEN concat(substring(content, 1, 500), '...') ELSE content END AS summary_auto FROM ev")
def _(spark, d):
    return pj.prefix_summary(evidence(spark, d))


@query("text_counts", r"""SELECT doc_id, CAST(len(regexp_extract_all(content, '[^\s]+')) AS BIGINT) AS word_count, CAST(length(content) AS BIGINT) AS character_count,
  CAST(len(string_split(content, chr(10))) AS BIGINT) AS line_count FROM ev""")
def _(spark, d):
    return pj.text_counts(evidence(spark, d))


@query("standardized_name", "SELECT doc_id, new_name FROM scored")
def _(spark, d):
    return pj.standardized_name(run(spark, d).withColumn("category", F.col("folder")))


@query("category_code", r"""SELECT folder, upper(substring(array_to_string(list_transform(list_filter(string_split(folder, '_'),
  lambda w: regexp_full_match(w, '\p{L}+')), lambda w: w[1]), ''), 1, 4)) AS code FROM (SELECT DISTINCT concat(CAST(l_linenumber AS VARCHAR), '_', replace(p_type, ' ', '_')) AS folder
  FROM lineitem JOIN part ON p_partkey = l_partkey)""")
def _(spark, d):
    folders = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey")).select(
        F.concat(F.col("l_linenumber").cast("string"), F.lit("_"), F.replace("p_type", F.lit(" "), F.lit("_"))).alias("folder")).distinct()
    return pj.category_code(folders)


@query("sanitize_filename", r"""SELECT name, CASE WHEN length(c) <= 255 THEN c WHEN regexp_extract(c, '\.([^.]*)$', 1) <> '' THEN
  concat(substring(regexp_replace(c, '\.[^.]*$', ''), 1, 254 - length(regexp_extract(c, '\.([^.]*)$', 1))), '.', regexp_extract(c, '\.([^.]*)$', 1))
  ELSE substring(regexp_replace(c, '\.[^.]*$', ''), 1, 255) END AS sanitized FROM (SELECT name, regexp_replace(name, '[<>:"/\\|?*]', '_', 'g') AS c
  FROM (SELECT concat(replace(raw, chr(10), ':'), file_path) AS name FROM ev))""")
def _(spark, d):
    name = F.concat(F.replace("raw", F.lit("\n"), F.lit(":")), "file_path")
    return pj.sanitize_filename(evidence(spark, d).select(name.alias("name")))


@query("sanitize_folder", r"""SELECT name, CASE WHEN name = '' THEN 'Unnamed_Folder' ELSE substring(regexp_replace(regexp_replace(name, '[^a-zA-Z0-9_\-\s]', '', 'g'), '\s+', '_', 'g'), 1, 100) END AS folder_name
  FROM (SELECT raw AS name FROM ev)""")
def _(spark, d):
    return pj.sanitize_folder(evidence(spark, d).select(
        F.col("raw").alias("name")))


@query("format_size", "SELECT doc_id, CASE WHEN s = 0 THEN '0 B' WHEN s < 1024 THEN printf('%.1f B', s::DOUBLE) WHEN s < 1048576 THEN printf('%.1f KB', s / 1024.0) "
       "WHEN s < 1073741824 THEN printf('%.1f MB', s / 1048576.0) ELSE printf('%.1f GB', s / 1073741824.0) END AS size_label FROM "
       "(SELECT doc_id, file_size * CASE doc_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 1024 WHEN 2 THEN 1048576 ELSE 0 END AS s FROM ev)")
def _(spark, d):
    factor = F.element_at(F.array(F.lit(1), F.lit(1024), F.lit(1048576), F.lit(0)), (F.col("doc_id") % 4 + 1).cast("int"))
    return pj.format_size(evidence(spark, d).withColumn("file_size", F.col("file_size") * factor))


SNIPPET_WORDS = ["hit", "threatened", "spyware", "offshore", "take the kids", "receipt", "lie"]
_SN = " UNION ALL ".join(
    f"SELECT doc_id, 'content' AS source, {q(w)} AS keyword, start AS start_pos, start + length(raw_match) AS end_pos, concat(CASE WHEN start > 50 THEN '...' ELSE '' END, "
    "substring(txt, greatest(0, start - 50) + 1, start + length(raw_match) + 50 - greatest(0, start - 50)), CASE WHEN start + length(raw_match) + 50 < length(txt) THEN '...' ELSE '' END) AS snippet "
    "FROM (" + positions_sql("ev", "content", r"(?i)\b" + w + r"\b", "doc_id") + ") k" for w in SNIPPET_WORDS)


@query("keyword_snippets", _SN)
def _(spark, d):
    return pj.keyword_snippets(pj.text_sources(evidence(spark, d), ["content"]), SNIPPET_WORDS)


@query("required_fields", "SELECT doc_id, array_to_string(list_filter([CASE WHEN summary = '' THEN 'summary' END, CASE WHEN subcategory = '' THEN 'subcategory' END, "
       "CASE WHEN duplicate_of IS NULL THEN 'duplicate_of' END, CASE WHEN prejudicial_value = 0 THEN 'prejudicial_value' END, 'reviewer'], lambda x: x IS NOT NULL), '|') AS missing FROM scored_dup")
def _(spark, d):
    return pj.required_fields(run_dup(spark, d), "doc_id", ["summary", "subcategory", "duplicate_of", "prejudicial_value", "reviewer"])


_FOUR = ("(SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN '' ELSE content END AS content, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE raw END AS summary, "
         "CASE WHEN doc_id % 5 = 0 THEN concat('AI says: ', raw) ELSE '' END AS ai_summary, CASE WHEN doc_id % 8 = 0 THEN raw END AS ocr_text FROM ev)")


def four_texts(spark, d):
    ev = evidence(spark, d)
    return ev.select(
        "doc_id", F.when(F.col("doc_id") % 4 == 0, "").otherwise(F.col("content")).alias("content"),
        F.when(F.col("doc_id") % 3 != 0, F.col("raw")).alias("summary"),
        F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("AI says: "), "raw")).otherwise("").alias("ai_summary"),
        F.when(F.col("doc_id") % 8 == 0, F.col("raw")).alias("ocr_text"))


@query("text_sources", " UNION ALL ".join(
    f"SELECT doc_id, '{s}' AS source, {s} AS text FROM {_FOUR} WHERE coalesce({s}, '') <> ''" for s in pj.TEXT_SOURCES))
def _(spark, d):
    return pj.text_sources(four_texts(spark, d))


@query("best_text", f"SELECT doc_id, coalesce(nullif(content, ''), nullif(summary, ''), nullif(ai_summary, ''), nullif(ocr_text, '')) AS text FROM {_FOUR}")
def _(spark, d):
    return pj.best_text(four_texts(spark, d))


@query("searchable_text", f"SELECT doc_id, lower(concat_ws(chr(10), nullif(content, ''), nullif(summary, ''), nullif(ai_summary, ''), nullif(ocr_text, ''))) AS search_text FROM {_FOUR}")
def _(spark, d):
    return pj.searchable_text(four_texts(spark, d))


@query("truncate_marked", "SELECT doc_id, CASE WHEN length(content) > 2000 THEN concat(substring(content, 1, 2000), chr(10), '[Content truncated due to length limits]') ELSE content END AS llm_input, "
       "length(content) > 2000 AS truncated FROM ev")
def _(spark, d):
    return pj.truncate_marked(evidence(spark, d), 2000)


@query("preserved_path", "SELECT doc_id, CASE WHEN c <> '' THEN concat(file_hash, '_', file_name) END AS preserved_filename, CASE WHEN c <> '' THEN concat('cases/', c, '/preserved_files/', file_hash, '/', file_hash, '_', file_name) END AS preserved_path, "
       "CASE WHEN c = '' THEN 'Case ID not found' END AS error FROM (SELECT *, CASE WHEN doc_id % 7 = 0 THEN '' ELSE concat('case', CAST(doc_id % 3 AS VARCHAR)) END AS c FROM ev)")
def _(spark, d):
    case = F.when(F.col("doc_id") % 7 == 0, "").otherwise(F.concat(F.lit("case"), (F.col("doc_id") % 3).cast("string")))
    return pj.preserved_path(evidence(spark, d), case)
