"""Registered queries for survey section 2.6."""

from pyspark.sql import functions as F

from probatio import lexicons as lx
from probatio.operators import dedup as dd
from probatio.operators import pairs as pr
from probatio.operators import patterns as pt
from probatio.operators import scans as sn
from probatio.operators import timeline as tl
from probatio.plans import q_entities as qe
from probatio.plans import q_scan_text as base
from probatio.plans import scored as plan
from probatio.plans.registry import COMMON, any_sql, q, query, r6
from probatio.sources.evidence import evidence, table


@query("exact_duplicates", "SELECT doc_id, file_hash, is_duplicate, duplicate_of FROM dups")
def _(spark, d):
    return dd.exact_duplicates(evidence(spark, d))


_KEPT = "NOT is_duplicate OR overall_impact > 0.7 OR probative_value > 0.8"


@query("duplicate_policy", f"SELECT doc_id, is_duplicate, {r6('overall_impact')} AS overall_impact FROM scored_dup WHERE {_KEPT}")
def _(spark, d):
    return dd.duplicate_policy(base.run_dup(spark, d)).select("doc_id", "is_duplicate", "overall_impact")


@query("duplicate_report", f"SELECT doc_id, file_name, substring(file_hash, 1, 16) AS hash16, duplicate_of, {r6('overall_impact')} AS overall_impact, "
       "CASE WHEN overall_impact > 0.7 THEN 'Kept (high value)' ELSE 'Removed' END AS action FROM scored_dup WHERE is_duplicate")
def _(spark, d):
    return dd.duplicate_report(base.run_dup(spark, d))


# the backup: some files changed, some lost, some without hash, some new; paths are per document
_BK = ("SELECT concat(CASE WHEN doc_id % 23 = 0 THEN 'new/' ELSE '' END, CAST(doc_id AS VARCHAR), '/', file_path) AS rel_path, CASE WHEN doc_id % 17 = 0 THEN sha256(concat(raw, 'x')) WHEN doc_id % 19 = 0 THEN '' ELSE file_hash END AS backup_hash "
       "FROM ev WHERE doc_id % 13 <> 0")
COMMON["backup"] = _BK
COMMON["uev"] = "SELECT doc_id, concat(CAST(doc_id AS VARCHAR), '/', file_path) AS file_path, file_hash FROM ev"
COMMON["verified"] = ("SELECT u.file_path AS rel_path, u.file_hash AS original_hash, b.backup_hash, CASE WHEN b.rel_path IS NULL THEN 'error_copying' WHEN b.backup_hash = '' THEN 'copy_error_hash_calculation' "
                      "WHEN b.backup_hash = u.file_hash THEN 'copied_verified' ELSE 'hash_mismatch' END AS status FROM uev u LEFT JOIN backup b ON b.rel_path = u.file_path")


def own_paths(spark, d):
    return evidence(spark, d).withColumn("file_path", F.concat_ws("/", F.col("doc_id").cast("string"), "file_path"))


def backup(spark, d):
    doc = F.col("doc_id")
    return own_paths(spark, d).where(doc % 13 != 0).select(
        F.concat(F.when(doc % 23 == 0, "new/").otherwise(""), "file_path").alias("rel_path"),
        F.when(doc % 17 == 0, F.sha2(F.concat("raw", F.lit("x")), 256)).when(doc % 19 == 0, "").otherwise(F.col("file_hash")).alias("backup_hash"))


@query("copy_verify", "SELECT * FROM verified")
def _(spark, d):
    return dd.copy_verify(own_paths(spark, d), backup(spark, d))


@query("ingest_summary", "SELECT count(*) AS scanned, count(*) FILTER (status IN ('copied_verified', 'copy_error_hash_calculation')) AS copied, count(*) FILTER (status = 'copied_verified') AS verified, "
       "count(*) FILTER (status = 'hash_mismatch') AS mismatched, count(*) FILTER (status IN ('error_copying', 'copy_error_hash_calculation')) AS failed FROM verified")
def _(spark, d):
    return dd.ingest_summary(dd.copy_verify(own_paths(spark, d), backup(spark, d)))


@query("integrity_check", "SELECT coalesce(b.rel_path, u.file_path) AS rel_path, CASE WHEN b.rel_path IS NULL THEN 'added' WHEN u.file_path IS NULL THEN 'missing' WHEN b.backup_hash = u.file_hash THEN 'unchanged' ELSE 'modified' END AS change "
       "FROM backup b FULL JOIN uev u ON u.file_path = b.rel_path")
def _(spark, d):
    return dd.integrity_check(backup(spark, d).withColumnRenamed("backup_hash", "sha256"), own_paths(spark, d))


# ---- together in files ----------------------------------------------------------------------
def _pairs_sql(column, a, b, step, cap):
    return (f"SELECT x.v AS {a}, y.v AS {b}, count(*) AS n_files, min(x.doc_id) AS first_file, max(x.doc_id) AS last_file, {r6(f'least({cap}, count(*) * {step})')} AS confidence FROM "
            f"(SELECT doc_id, unnest({column}) AS v FROM esets) x JOIN (SELECT doc_id, unnest({column}) AS v FROM esets) y ON x.doc_id = y.doc_id AND x.v < y.v GROUP BY x.v, y.v HAVING count(*) >= 2")


COMMON["name_pairs"] = _pairs_sql("names", "name1", "name2", 0.3, 0.9)


@query("name_cooccurrence", "SELECT * FROM name_pairs")
def _(spark, d):
    return pr.name_cooccurrence(evidence(spark, d))


@query("name_pair_files", "SELECT p.name1, p.name2, e.doc_id FROM name_pairs p JOIN esets e ON list_contains(names, name1) AND list_contains(names, name2)")
def _(spark, d):
    return pr.name_pair_files(evidence(spark, d))


@query("term_cooccurrence", _pairs_sql("legal_terms", "term1", "term2", 0.25, 0.7))
def _(spark, d):
    return pr.term_cooccurrence(evidence(spark, d))


@query("communication_clusters", "SELECT communication_type, count(*) AS n_files, min(doc_id) AS first_file, " + r6("least(0.8, count(*) * 0.2)") + " AS confidence FROM ("
       + " UNION ALL ".join(f"SELECT {q(g)} AS communication_type, doc_id FROM ev WHERE {any_sql('lower(content)', w)}" for g, w in lx.COMMUNICATION_GROUPS.items()) + ") c GROUP BY communication_type HAVING count(*) >= 2")
def _(spark, d):
    return pr.communication_clusters(evidence(spark, d))


@query("term_pair_files", "SELECT p.term1, p.term2, e.doc_id FROM (" + _pairs_sql("legal_terms", "term1", "term2", 0.25, 0.7)
       + ") p JOIN esets e ON list_contains(legal_terms, term1) AND list_contains(legal_terms, term2)")
def _(spark, d):
    return pr.term_pair_files(evidence(spark, d))


_COMM = " UNION ALL ".join(f"SELECT {q(g)} AS communication_type, doc_id FROM ev WHERE {any_sql('lower(content)', w)}" for g, w in lx.COMMUNICATION_GROUPS.items())


@query("communication_files", f"SELECT communication_type, doc_id FROM (SELECT *, count(*) OVER (PARTITION BY communication_type) AS n FROM ({_COMM}) c) x WHERE n >= 2")
def _(spark, d):
    return pr.communication_files(evidence(spark, d))


@query("date_files", "SELECT strftime(dd, '%Y-%m-%d') AS event_date, doc_id, n_events FROM (SELECT *, count(*) OVER (PARTITION BY dd) AS n FROM (SELECT event_date AS dd, doc_id, count(*) AS n_events FROM events_all GROUP BY 1, 2) c) x WHERE n >= 2")
def _(spark, d):
    return pr.date_files(tl.timeline_events(plan.categorised(evidence(spark, d))))


@query("uncategorised_files", "SELECT file_path, doc_id FROM ev JOIN cat_best USING (doc_id) WHERE category IS NULL")
def _(spark, d):
    return sn.uncategorised_files(evidence(spark, d))


@query("theory_assignment", "SELECT doc_id, coalesce(theory, '') AS theory, folder2 AS folder, concat(folder2, '/', regexp_replace(folder, '[^a-zA-Z0-9_\\-\\s]', '', 'g'), '/', file_name) AS target_path FROM ("
       "SELECT ev.doc_id, file_name, b.folder, t.theory, CASE WHEN t.theory IS NULL THEN 'GENERAL_EVIDENCE' ELSE concat('THEORY_', replace(replace(t.theory, '!', ''), ' ', '_')) END AS folder2 FROM ev JOIN cat_best b USING (doc_id) LEFT JOIN ("
       "SELECT doc_id, arg_min(concat('Theory! No ', CAST(supp AS VARCHAR)), supp) AS theory FROM (SELECT l_orderkey AS doc_id, l_suppkey % 7 AS supp FROM lineitem) l GROUP BY doc_id) t USING (doc_id)) x")
def _(spark, d):
    supp = F.col("l_suppkey") % 7
    theories = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), supp.alias("ord"), F.concat(F.lit("Theory! No "), supp.cast("string")).alias("theory_name"))
    files = plan.categorised(evidence(spark, d)).select("doc_id", "file_name", F.col("folder").alias("category_folder"))
    return dd.theory_assignment(files, theories)


_NAMES = ("CASE ev.doc_id % 7 WHEN 0 THEN regexp_replace(ev.file_name, '_[0-9]+', '_1', 'g') WHEN 1 THEN regexp_replace(ev.file_name, '_[0-9]+', '_2', 'g') "
          "ELSE regexp_replace(ev.file_name, '_[0-9]+', '', 'g') END")


@query("name_conflicts", rf"""WITH n AS (SELECT doc_id, folder, file_name, regexp_replace(file_name, '\.[^./]+$', '') AS stem, regexp_extract(file_name, '(\.[^./]+)$', 1) AS suffix,
  row_number() OVER (PARTITION BY folder, file_name ORDER BY doc_id) AS rn FROM (SELECT ev.doc_id, b.folder, {_NAMES} AS file_name FROM ev JOIN cat_best b USING (doc_id)) a),
  most AS (SELECT folder, stem, suffix, max(rn) AS files FROM n GROUP BY 1, 2, 3),
  free AS (SELECT folder, stem, suffix, k, row_number() OVER (PARTITION BY folder, stem, suffix ORDER BY k) AS place FROM (
    SELECT folder, stem, suffix, unnest(range(1, files + 1 + (SELECT count(*) FROM n))) AS k FROM most WHERE files > 1) f
    WHERE NOT EXISTS (SELECT 1 FROM n t WHERE t.folder = f.folder AND t.file_name = concat(f.stem, '_', CAST(f.k AS VARCHAR), f.suffix)))
  SELECT doc_id, n.folder, CASE WHEN rn = 1 THEN file_name ELSE concat(n.stem, '_', CAST(k AS VARCHAR), n.suffix) END AS unique_name
  FROM n LEFT JOIN free ON free.folder = n.folder AND free.stem = n.stem AND free.suffix = n.suffix AND free.place = n.rn - 1""")
def _(spark, d):
    def renamed(tail: str):
        return F.regexp_replace("file_name", "_[0-9]+", tail)
    name = F.when(F.col("doc_id") % 7 == 0, renamed("_1")).when(F.col("doc_id") % 7 == 1, renamed("_2")).otherwise(renamed(""))
    return dd.name_conflicts(plan.categorised(evidence(spark, d)).select("doc_id", "folder", name.alias("file_name")), block_size=100)


@query("stage_merge", "SELECT coalesce(e.doc_id, l.doc_id + 5) AS doc_id, CASE WHEN l.doc_id IS NOT NULL THEN CASE WHEN l.quality = 1 THEN 'good' ELSE 'poor' END ELSE e.lang END AS lang, e.source, CAST(l.toxic AS BIGINT) AS toxic "
       "FROM documents e FULL JOIN labels l ON e.doc_id = l.doc_id + 5")
def _(spark, d):
    master = table(spark, d, "documents").select("doc_id", "lang", "source")
    stage = table(spark, d, "labels").select((F.col("doc_id") + 5).alias("doc_id"), F.when(F.col("quality") == 1, "good").otherwise("poor").alias("lang"), "toxic")
    return dd.stage_merge(master, stage, "doc_id")


@query("unsupported_files", "SELECT file_path, extension FROM ev WHERE extension = '.xyz'")
def _(spark, d):
    return sn.unsupported_files(evidence(spark, d))


# ---- content similarity: the oracle compares the sets of all pairs of distinct word sets --------
COMMON["words20"] = (
    "SELECT doc_id, list_sort(list(w)) AS words FROM (SELECT doc_id, w, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first_at) AS rn FROM ("
    "SELECT doc_id, w, count(*) AS n, min(i) AS first_at FROM (SELECT doc_id, unnest(m) AS w, generate_subscripts(m, 1) AS i FROM ("
    r"SELECT doc_id, regexp_extract_all(lower(content), '[\p{L}\p{N}_]{5,}') AS m FROM ev) a) b GROUP BY doc_id, w) c) d WHERE rn <= 20 GROUP BY doc_id")
COMMON["wsets"] = "SELECT words, min(doc_id) AS rep, count(*) AS members FROM words20 GROUP BY words"
COMMON["wtok"] = "SELECT rep, members, len(words) AS n, unnest(words) AS w FROM wsets"


@query("content_similarity", "SELECT doc1, doc2, relation, " + r6("similarity") + " AS similarity, CAST(n_pairs AS BIGINT) AS n_pairs, " + r6("least(0.9, similarity)") + " AS confidence FROM ("
       "SELECT a.rep AS doc1, b.rep AS doc2, 'overlap' AS relation, count(*) / (any_value(a.n) + any_value(b.n) - count(*)) AS similarity, any_value(a.members) * any_value(b.members) AS n_pairs "
       "FROM wtok a JOIN wtok b ON a.w = b.w AND a.rep < b.rep GROUP BY a.rep, b.rep HAVING count(*) / (any_value(a.n) + any_value(b.n) - count(*)) > 0.3 "
       "UNION ALL SELECT s.rep, t.doc_id, 'same', 1.0, 1 FROM words20 t JOIN wsets s ON s.words = t.words WHERE t.doc_id <> s.rep) z")
def _(spark, d):
    return pr.content_similarity(evidence(spark, d))


@query("temporal_clusters", "SELECT strftime(event_date, '%Y-%m-%d') AS event_date, CAST(sum(n) AS BIGINT) AS event_count, count(*) AS n_files, min(doc_id) AS first_file, " + r6("least(0.8, count(*) * 0.3)") + " AS confidence FROM ("
       "SELECT event_date, doc_id, count(*) AS n FROM events_all GROUP BY event_date, doc_id) e GROUP BY event_date HAVING count(*) >= 2")
def _(spark, d):
    return pr.temporal_clusters(tl.timeline_events(plan.categorised(evidence(spark, d))))


# ---- vectors ---------------------------------------------------------------------------------
# the sample's vectors are spread widely, so the wanted cosine is lower than the usual 0.85
NEAR = 0.35


@query("semantic_neighbors", f"SELECT a.vec_id AS id1, b.vec_id AS id2, {r6('list_cosine_similarity(a.e, b.e)')} AS similarity, 'near' AS relation FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) a "
       f"JOIN (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) b ON a.vec_id < b.vec_id AND list_cosine_similarity(a.e, b.e) >= {NEAR}")
def _(spark, d):
    return pr.semantic_neighbors(table(spark, d, "embeddings"), NEAR)


@query("semantic_clusters", f"""WITH RECURSIVE ed AS (SELECT a.vec_id AS x, b.vec_id AS y FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) a
  JOIN (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.4),
  reach(id, c) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT ed.y, reach.c FROM reach JOIN ed ON ed.x = reach.id)
  SELECT id, min(c) AS cluster_id FROM reach GROUP BY id""")
def _(spark, d):
    return pr.semantic_clusters(table(spark, d, "embeddings"), 0.4)
