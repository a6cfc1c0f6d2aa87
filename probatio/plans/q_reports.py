"""Registered queries for survey section 2.10."""

from pyspark.sql import functions as F

from probatio.operators import ai_tables as ai
from probatio.operators import categorize as ca
from probatio.operators import entities as en
from probatio.operators import patterns as pt
from probatio.operators import reports as rp
from probatio.plans import q_ai as qa
from probatio.plans import q_patterns as qp
from probatio.plans import q_scan_text as base
from probatio.plans.registry import COMMON, lit_list, q, query, r6
from probatio.sources.evidence import ai_results, evidence, table


@query("corpus_summary", f"SELECT count(*) AS total, count(*) FILTER (category <> '09_FOR_HUMAN_REVIEW') AS categorised, count(*) FILTER (category = '09_FOR_HUMAN_REVIEW') AS for_review, {r6('avg(relevance_score)')} AS avg_relevance, {r6('avg(overall_impact)')} AS avg_impact FROM scored")
def _(spark, d):
    return rp.corpus_summary(base.run(spark, d))


@query("category_distribution", "SELECT category, count(*) AS files FROM scored GROUP BY category")
def _(spark, d):
    return rp.category_distribution(base.run(spark, d))


COMMON["fstrength"] = (
    "SELECT category, files, avg_impact, avg_relevance, high_impact_files, high_impact_files / files AS high_impact_ratio, round(avg_impact * 0.5 + avg_relevance * 0.3 + high_impact_files / files * 0.2, 9) AS strength FROM ("
    "SELECT category, count(*) AS files, avg(overall_impact) AS avg_impact, avg(relevance_score) AS avg_relevance, count(*) FILTER (overall_impact > 0.7) AS high_impact_files FROM scored GROUP BY category) g")


@query("folder_strength", f"SELECT category, files, {r6('avg_impact')} AS avg_impact, {r6('avg_relevance')} AS avg_relevance, high_impact_files, {r6('high_impact_ratio')} AS high_impact_ratio, {r6('strength')} AS strength, "
       "row_number() OVER (ORDER BY strength DESC, category) AS rank FROM fstrength")
def _(spark, d):
    return rp.folder_strength(base.run(spark, d))


@query("folder_strength_ai", f"""SELECT category, files, {r6('avg_impact')} AS avg_impact, {r6('avg_relevance')} AS avg_relevance, high_impact_files, ai_files, {r6('high_impact_files / files')} AS high_impact_ratio, {r6('strength')} AS strength,
  row_number() OVER (ORDER BY strength DESC, category) AS rank FROM (SELECT *, round(avg_impact * 0.4 + avg_relevance * 0.3 + high_impact_files / files * 0.2 + ai_files / files * 0.1, 9) AS strength FROM (
  SELECT category, count(*) AS files, avg(overall_impact) AS avg_impact, avg(relevance_score) AS avg_relevance, count(*) FILTER (overall_impact > 0.7) AS high_impact_files, count(*) FILTER (doc_id IN (SELECT doc_id FROM labels)) AS ai_files FROM scored GROUP BY category) g) h""")
def _(spark, d):
    marked = base.run(spark, d).join(table(spark, d, "labels").select("doc_id", F.lit(True).alias("has_ai")), "doc_id", "left")
    return rp.folder_strength(marked.withColumn("has_ai", F.coalesce("has_ai", F.lit(False))), with_ai=True)


@query("argument_bands", "SELECT category, CASE WHEN strength > 0.7 THEN 'strong' WHEN strength < 0.5 THEN 'weak' ELSE 'adequate' END AS band FROM fstrength")
def _(spark, d):
    return rp.argument_bands(rp.folder_strength(base.run(spark, d)))


@query("folder_index", f"SELECT category AS folder, count(*) AS files, {r6('sum(file_size) / 1048576.0')} AS total_mb, {r6('avg(relevance_score)')} AS avg_relevance, {r6('avg(probative_value)')} AS avg_probative FROM scored GROUP BY category")
def _(spark, d):
    return rp.folder_index(base.run(spark, d))


@query("folder_entries", "SELECT category AS folder, doc_id, new_name, file_name, file_type, concat(substring(summary, 1, 200), '...') AS summary, " + ", ".join(
    f"{r6(c)} AS {c}" for c in ("relevance_score", "probative_value", "admissibility_score", "overall_impact")) + " FROM scored")
def _(spark, d):
    return rp.folder_entries(base.run(spark, d))


# a run log from the orders: some stages report processed files, some only a total
@query("run_summary", "SELECT count(*) AS stages, count(*) FILTER (o_orderstatus = 'F') AS successful, CAST(sum(coalesce(CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 50 END, o_custkey % 20)) AS BIGINT) AS total_files FROM orders")
def _(spark, d):
    runs = table(spark, d, "orders").select(
        F.when(F.col("o_orderstatus") == "F", "success").otherwise("error").alias("status"),
        F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderkey") % 50).alias("files_processed"), (F.col("o_custkey") % 20).alias("total_files"))
    return rp.run_summary(runs)


@query("file_360", f"""SELECT s.doc_id, s.file_path, s.file_hash, s.file_size, s.category, {r6('s.overall_impact')} AS overall_impact, s.summary, coalesce(array_to_string(t.tags, '|'), '') AS tags, coalesce(p.patterns, 0) AS patterns, coalesce(e.entities, 0) AS entities
  FROM (SELECT * FROM scored ORDER BY file_path, doc_id LIMIT 20) s LEFT JOIN ctags t USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS patterns FROM lexpat GROUP BY doc_id) p USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS entities FROM eindex GROUP BY doc_id) e USING (doc_id)""")
def _(spark, d):
    # the page is chosen first; its parts are then computed for its files only
    page = base.plan.scored(evidence(spark, d).orderBy("file_path", "doc_id").limit(20), base.RUN, base.PARTY_RULES)
    texts = page.select("doc_id", F.lit("content").alias("source"), F.col("content").alias("text"))
    parts = {
        "tags": ca.concept_tags(page.select("doc_id", "content")),
        "patterns": pt.lexicon_patterns(texts).groupBy("doc_id").agg(F.count("*").alias("patterns")),
        "entities": en.entity_index(en.entities_sets(page)).groupBy("doc_id").agg(F.count("*").alias("entities"))}
    wide = rp.file_360(page.select("doc_id", "file_path", "file_hash", "file_size", "category", "overall_impact", "summary"), parts, None)
    return wide.withColumn("patterns", F.coalesce("patterns", F.lit(0))).withColumn("entities", F.coalesce("entities", F.lit(0)))


@query("extraction_summary", "SELECT count(*) AS total, count(*) FILTER (doc_id % 9 <> 0) AS extracted, count(*) FILTER (doc_id % 9 = 0) AS failed FROM documents")
def _(spark, d):
    return rp.extraction_summary(table(spark, d, "documents").select(F.when(F.col("doc_id") % 9 != 0, F.col("text")).alias("content")))


@query("theory_top5", f"SELECT CAST(ord AS BIGINT) AS ord, theory, supporting_files, {r6('avg_score')} AS avg_score FROM (SELECT theory, count(*) AS supporting_files, avg(score) AS avg_score, CAST(replace(theory, 'Theory ', '') AS BIGINT) AS ord FROM tscores GROUP BY theory) t ORDER BY ord LIMIT 5")
def _(spark, d):
    theories = ai.theory_support(qa.scores(spark, d), []).withColumn("ord", F.replace("theory", F.lit("Theory ")).cast("bigint"))
    return rp.theory_top5(theories).select("ord", "theory", "supporting_files", "avg_score")


# a status log from the events: user = file, event type = agent
COMMON["slog"] = "SELECT user_id AS doc_id, event_type AS agent, CASE event_id % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'done' ELSE 'failed' END AS status, ts FROM events"


@query("status_latest", "SELECT doc_id, agent, status, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, agent ORDER BY ts DESC) AS rn FROM slog) a WHERE rn = 1 UNION ALL "
       "SELECT doc_id, '*', status, strftime(ts, '%Y-%m-%d %H:%M:%S') FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ts DESC, agent DESC) AS rn FROM slog) b WHERE rn = 1")
def _(spark, d):
    log = table(spark, d, "events").select(
        F.col("user_id").alias("doc_id"), F.col("event_type").alias("agent"),
        F.element_at(F.array(*map(F.lit, ["pending", "done", "failed"])), (F.col("event_id") % 3 + 1).cast("int")).alias("status"), "ts")
    return rp.status_latest(log)


@query("ai_run_stats", f"SELECT count(*) FILTER (has_ai) AS ai_files, {r6('avg(CASE WHEN has_ai THEN (doc_id % 10) / 4 ELSE 0 END)')} AS avg_ai_seconds, {r6('sum(cost)')} AS total_cost, count(*) FILTER (requires_human_review) AS for_review FROM "
       "(SELECT doc_id, requires_human_review, doc_id IN (SELECT doc_id FROM labels) AS has_ai, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN cost ELSE 0 END AS cost FROM aimerge) m")
def _(spark, d):
    # cost of the files that have labels; seconds by document
    s = base.run(spark, d)
    cost = qa.merged(spark, d).select("doc_id", "cost")
    files = s.select("doc_id", "requires_human_review").join(cost, "doc_id").join(
        table(spark, d, "labels").select("doc_id", F.lit(True).alias("has_ai")), "doc_id", "left")
    has = F.coalesce("has_ai", F.lit(False))
    return rp.ai_run_stats(files.select("requires_human_review", has.alias("has_ai"), F.when(has, (F.col("doc_id") % 10) / 4).alias("ai_seconds"), F.when(has, F.col("cost")).alias("cost")))
