"""Registered queries for survey section 2.9."""

from pyspark.sql import functions as F

from probatio import lexicons as lx
from probatio.config import UsageLimits
from probatio.operators import ai_tables as ai
from probatio.operators import patterns as pt
from probatio.plans import q_scan_text as base
from probatio.plans.registry import COMMON, any_sql, q, query, r6
from probatio.sources.evidence import ai_results, ai_usage, evidence, table


def parsed(spark, d):
    return ai.ai_parse(ai_results(spark, d))


_O = r"regexp_extract(raw_response, '(?s)\{.*\}', 0)"


def js(field):
    return f"json_extract_string(o, '$.{field}')"


def num(field):
    return f"TRY_CAST({js(field)} AS DOUBLE)"


COMMON["found"] = (f"SELECT *, o IS NOT NULL AS structured, CASE WHEN o IS NOT NULL THEN coalesce({js('summary')}, '') ELSE substring(raw_response, 1, 500) END AS summary, "
                   f"coalesce({num('confidence')}, {num('confidence_score')}, {num('certainty')}, CASE WHEN o IS NOT NULL THEN 0.7 ELSE 0.4 END)::DOUBLE AS conf "
                   f"FROM (SELECT *, CASE WHEN json_valid({_O}) THEN {_O} END AS o FROM answers) a")


@query("ai_parse", f"SELECT doc_id, agent, structured, summary, {js('evidence_category')} AS evidence_category, {js('legal_significance')} AS legal_significance FROM found")
def _(spark, d):
    return parsed(spark, d).select("doc_id", "agent", "structured", "summary", F.col("findings.evidence_category").alias("evidence_category"),
                                   F.col("findings.legal_significance").alias("legal_significance"))


_SIG = f"lower(coalesce({js('legal_significance')}, ''))"


@query("ai_numeric_defaults", "SELECT doc_id, agent, " + ", ".join(f"coalesce({num(k)}, {v})::DOUBLE AS {k}" for k, v in lx.AI_NUMERIC_DEFAULTS.items())
       + f", coalesce({num('probative_value')}, CASE WHEN {any_sql(_SIG, ['strong', 'significant', 'crucial'])} THEN 0.8 WHEN {any_sql(_SIG, ['relevant', 'important', 'useful'])} THEN 0.6 ELSE 0.4 END)::DOUBLE AS probative_by_text FROM found")
def _(spark, d):
    return ai.ai_numeric_defaults(parsed(spark, d))


@query("ai_confidence", f"SELECT doc_id, agent, {r6('conf')} AS confidence_score, {r6('coalesce(' + num('confidence') + ', CASE WHEN structured THEN 0.8 WHEN length(raw_response) > 100 THEN 0.6 ELSE 0.3 END)')} AS confidence_by_length FROM found")
def _(spark, d):
    return ai.ai_confidence(parsed(spark, d))


_ENT = [("key_parties", "key_parties", 0.8), ("organizations", "organizations", 0.8), ("financial_amounts", "money", 0.9), ("important_dates", "date", 0.8)]


@query("ai_entities", " UNION ALL ".join(f"SELECT doc_id, agent, '{k}' AS type, unnest(json_extract_string(o, '$.{f}[*]')) AS value, {c}::DOUBLE AS confidence FROM found WHERE o IS NOT NULL" for f, k, c in _ENT))
def _(spark, d):
    return ai.ai_entities(parsed(spark, d))


COMMON["aitags"] = (f"SELECT doc_id, agent, list_sort(list_distinct(list_concat(list_filter([{js('evidence_category')}, {js('document_type')}, CASE WHEN json_exists(o, '$.key_facts') THEN 'factual_evidence' END, "
                    "CASE WHEN conf > 0.8 THEN 'high_confidence' WHEN conf < 0.5 THEN 'low_confidence' END, 'case_type_general'], lambda x: x IS NOT NULL), coalesce(json_keys(o, '$.legal_theory_support'), [])))) AS tags FROM found")


@query("ai_tags", "SELECT doc_id, agent, array_to_string(tags, '|') AS tags FROM aitags")
def _(spark, d):
    return ai.ai_tags(parsed(spark, d))


@query("ai_tags_merged", "SELECT doc_id, array_to_string(list_sort(list_distinct(flatten(list(tags)))), '|') AS tags FROM aitags GROUP BY doc_id")
def _(spark, d):
    return ai.merged_tags(ai.ai_tags(parsed(spark, d)))


_MAPAI = "CASE lower(cat) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in lx.AI_CATEGORY_FOLDERS.items()) + f" ELSE '{lx.REVIEW_FOLDER}' END"
COMMON["aimerge"] = (
    f"SELECT s.doc_id, s.requires_human_review, coalesce(ai_confidence, 0.0) AS ai_confidence, greatest(s.probative_value, coalesce(pv, 0.0)) AS probative_value, greatest(s.relevance_score, coalesce(rv, 0.0)) AS relevance_score, "
    f"CASE WHEN l.cat IS NOT NULL THEN {_MAPAI} ELSE s.category END AS category, coalesce(l.conf, s.confidence_score) AS confidence_score, coalesce(tok, 0) * 0.0001 AS cost, tok IS NOT NULL AS has_ai FROM scored s "
    f"LEFT JOIN (SELECT doc_id, max(conf) AS ai_confidence, max(CASE WHEN conf >= 0.6 THEN coalesce({num('probative_value')}, 0.5) END) AS pv, max(CASE WHEN conf >= 0.6 THEN coalesce({num('relevance_score')}, 0.5) END) AS rv, sum(tokens_used) AS tok FROM found GROUP BY doc_id) g ON g.doc_id = s.doc_id "
    f"LEFT JOIN (SELECT doc_id, conf, {js('evidence_category')} AS cat FROM found WHERE conf >= 0.6 AND {js('evidence_category')} IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY agent_ord DESC) = 1) l ON l.doc_id = s.doc_id")


def merged(spark, d):
    return ai.ai_merge(parsed(spark, d), base.run(spark, d))


@query("ai_merge", "SELECT doc_id, " + ", ".join(f"{r6(c)} AS {c}" for c in ("ai_confidence", "probative_value", "relevance_score", "confidence_score", "cost")) + ", category FROM aimerge")
def _(spark, d):
    return merged(spark, d)


COMMON["tscores"] = ("SELECT doc_id, theory, max(score) AS score FROM (SELECT doc_id, t.k AS theory, CAST(json_extract_string(o, concat('$.legal_theory_support.\"', t.k, '\"')) AS DOUBLE) AS score FROM "
                     "(SELECT doc_id, o, unnest(json_keys(o, '$.legal_theory_support')) AS k FROM found WHERE json_exists(o, '$.legal_theory_support')) t) x GROUP BY doc_id, theory")
THEORIES = ["Theory 0", "Theory 1", "Theory 2", "Theory 3", "Theory 4", "Theory 9"]
_CONF = " UNION ALL ".join(f"SELECT '{t}' AS theory, {i} AS ord" for i, t in enumerate(THEORIES))


def scores(spark, d):
    return ai.theory_scores(parsed(spark, d))


@query("theory_scores", f"SELECT doc_id, theory, {r6('score')} AS score FROM tscores")
def _(spark, d):
    return scores(spark, d)


@query("theory_support", f"SELECT coalesce(c.theory, s.theory) AS theory, coalesce(n, 0) AS supporting_files, {r6('coalesce(a, 0)')} AS avg_score FROM ({_CONF}) c FULL JOIN (SELECT theory, count(*) AS n, avg(score) AS a FROM tscores GROUP BY theory) s ON s.theory = c.theory")
def _(spark, d):
    return ai.theory_support(scores(spark, d), THEORIES)


@query("case_theory_analysis", f"""SELECT theory, n AS supporting_files, {r6('a')} AS avg_score, CASE WHEN a > 0.7 THEN 'Strong' WHEN a > 0.4 THEN 'Moderate' ELSE 'Weak' END AS strength, k AS key_evidence, coalesce(top, '') AS top_files,
  row_number() OVER (ORDER BY round(a, 9), ord) AS priority_rank FROM (SELECT c.theory, c.ord, count(s.doc_id) AS n, coalesce(avg(s.score), 0) AS a, count(*) FILTER (s.score > 0.8) AS k,
  string_agg(CAST(s.doc_id AS VARCHAR), '|' ORDER BY rn) FILTER (rn <= 5) AS top FROM ({_CONF}) c LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY theory ORDER BY score DESC, doc_id) AS rn FROM tscores) s ON s.theory = c.theory GROUP BY c.theory, c.ord) x""")
def _(spark, d):
    return ai.case_theory_analysis(scores(spark, d), THEORIES)


@query("high_conf_findings", f"SELECT doc_id, agent, {r6('conf')} AS confidence, summary AS finding, coalesce({js('legal_significance')}, '') AS legal_significance FROM found WHERE conf > 0.8")
def _(spark, d):
    return ai.high_conf_findings(parsed(spark, d))


@query("insight_counts", "SELECT insight, count(*) AS mentions FROM (SELECT unnest(json_extract_string(o, '$.case_specific_insights[*]')) AS insight FROM found) x GROUP BY insight")
def _(spark, d):
    return ai.insight_counts(parsed(spark, d))


@query("suggested_theories", " UNION ".join(f"SELECT '{k}' AS kind, unnest(json_extract_string(o, '$.{k}[*]')) AS value FROM found" for k in ("suggested_theories", "strategic_insights")))
def _(spark, d):
    return ai.suggested_theories(parsed(spark, d))


@query("usage_report", f"SELECT provider, count(*) AS requests, count(*) FILTER (success) AS successes, {r6('count(*) FILTER (success) / greatest(count(*), 1) * 100')} AS success_rate, CAST(sum(tokens_used) AS BIGINT) AS tokens, "
       f"{r6('sum(tokens_used) / greatest(count(*) FILTER (success), 1)')} AS avg_tokens FROM answers GROUP BY provider")
def _(spark, d):
    return ai.usage_report(ai_results(spark, d))


_KINDS = [*lx.PROMPT_OVERHEAD, "other"]
_COST = UsageLimits(cost_per_token=0.0005)


@query("cost_estimate", " UNION ALL ".join(
    f"SELECT doc_id, '{k}' AS analysis_type, tok AS tokens, {r6('tok * 0.0005')} AS cost, tok * 0.0005 > 1.0 AS high_cost FROM (SELECT doc_id, CAST(length(content) // 4 + {lx.PROMPT_OVERHEAD.get(k, 400)} + 1000 AS BIGINT) AS tok FROM ev) t" for k in _KINDS))
def _(spark, d):
    return ai.cost_estimate(evidence(spark, d), limits=_COST)


@query("agent_plan", "SELECT doc_id, unnest(['document_intelligence', 'legal_analysis']) AS agent FROM documents")
def _(spark, d):
    return ai.agent_plan(table(spark, d, "documents"), "standard")


# ---- usage: the sample's ledger is thin per user, so one key stands for ten users ----------------
LIMITS = UsageLimits(requests_per_minute=2, tokens_per_hour=20_000.0, cost_per_hour=2.5, max_backoff_seconds=60.0)
COMMON["ledger"] = "SELECT usage_key % 15 AS usage_key, request_id, ts, tokens, cost, success FROM usage"
_UW = """SELECT usage_key, request_id, epoch_us(ts) AS us, success,
  count(*) OVER (w RANGE BETWEEN INTERVAL '59.999999 seconds' PRECEDING AND CURRENT ROW) - own_n AS requests_60s,
  coalesce(sum(tokens) OVER (w RANGE BETWEEN INTERVAL '3599.999999 seconds' PRECEDING AND CURRENT ROW), 0) - own_t AS tokens_3600s,
  coalesce(sum(cost) OVER (w RANGE BETWEEN INTERVAL '3599.999999 seconds' PRECEDING AND CURRENT ROW), 0) - own_c AS cost_3600s
  FROM (SELECT *, count(*) OVER s AS own_n, sum(tokens) OVER s AS own_t, sum(cost) OVER s AS own_c FROM ledger WINDOW s AS (PARTITION BY usage_key, ts ORDER BY request_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) x
  WINDOW w AS (PARTITION BY usage_key ORDER BY ts)"""
COMMON["errs"] = ("SELECT usage_key, request_id, success, CAST(row_number() OVER (PARTITION BY usage_key ORDER BY ts, request_id) - 1 - coalesce(last_ok, 0) AS BIGINT) AS errors_before FROM ("
                  "SELECT *, max(CASE WHEN success THEN i END) OVER (PARTITION BY usage_key ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_ok FROM ("
                  "SELECT *, row_number() OVER (PARTITION BY usage_key ORDER BY ts, request_id) AS i FROM ledger) a) b")


def ledger(spark, d):
    return ai_usage(spark, d).withColumn("usage_key", F.col("usage_key") % 15)


_FOLD = """WITH RECURSIVE steps AS (SELECT e.usage_key, e.request_id, e.success, CASE WHEN e.success THEN 0 ELSE e.errors_before + 1 END AS ce,
  row_number() OVER (PARTITION BY e.usage_key ORDER BY l.ts, e.request_id) AS i FROM errs e JOIN ledger l ON l.request_id = e.request_id),
  fold(usage_key, i, request_id, ce, m0, m) AS (SELECT usage_key, CAST(0 AS BIGINT), CAST(-1 AS BIGINT), CAST(0 AS BIGINT), CAST(1.0 AS DOUBLE), CAST(1.0 AS DOUBLE) FROM (SELECT DISTINCT usage_key FROM ledger) k
  UNION ALL SELECT s.usage_key, s.i, s.request_id, s.ce, f.m, CASE WHEN s.success THEN least(1.0, f.m + 0.1) WHEN s.ce >= 3 THEN greatest(0.3, f.m * 0.7) ELSE f.m END FROM fold f JOIN steps s ON s.usage_key = f.usage_key AND s.i = f.i + 1)"""
def _flags(rate: str, over: str, window: str) -> str:
    by_minute = f"requests_60s >= floor(round({rate} * {LIMITS.requests_per_minute}, 9))"
    by_hour = f"(tokens_3600s >= floor(round({rate} * {LIMITS.tokens_per_hour}, 9)) OR round(cost_3600s, 9) >= round({rate} * {LIMITS.cost_per_hour}, 9))"
    return f"{by_minute} OR {by_hour} AS {over}, CAST(CASE WHEN {by_minute} THEN 60 WHEN {by_hour} THEN 3600 ELSE 0 END AS BIGINT) AS {window}"


_LOADS = f"usage_key, request_id, us, requests_60s, CAST(tokens_3600s AS BIGINT) AS tokens_3600s, {r6('cost_3600s')} AS cost_3600s"
_UW_INLINE = _UW.replace(" OVER (w RANGE", " OVER (PARTITION BY usage_key ORDER BY ts RANGE").replace("  WINDOW w AS (PARTITION BY usage_key ORDER BY ts)", "")
_UWIN = _FOLD + (f", uwin AS (SELECT *, {_flags('1.0', 'over_limit', 'window_seconds')}, {_flags('m0', 'over_scaled', 'scaled_window_seconds')} "
                 f"FROM ({_UW_INLINE}) w0 JOIN (SELECT request_id, m0 FROM fold WHERE i > 0) f0 USING (request_id))")


# by the plain limits and by the limits times the key's rate
_BOTH = f"{_UWIN} SELECT {_LOADS}, over_limit, window_seconds, {r6('m0')} AS multiplier_before, over_scaled, scaled_window_seconds FROM uwin"


@query("usage_windows", _BOTH)
def _(spark, d):
    return ai.usage_windows_scaled(ledger(spark, d), LIMITS)


@query("usage_windows_scaled", _BOTH)
def _(spark, d):
    return ai.usage_windows_scaled(ledger(spark, d), LIMITS)


@query("consecutive_errors", "SELECT usage_key, request_id, errors_before, CASE WHEN success THEN 0 ELSE errors_before + 1 END AS consecutive_errors FROM errs")
def _(spark, d):
    return ai.consecutive_errors(ledger(spark, d)).select("usage_key", "request_id", "errors_before", "consecutive_errors")


# the fold, step by step over each key's requests
@query("rate_multiplier", f"{_FOLD} SELECT usage_key, request_id, ce AS consecutive_errors, {r6('m')} AS multiplier, {r6('m0')} AS multiplier_before FROM fold WHERE i > 0")
def _(spark, d):
    return ai.rate_multiplier(ledger(spark, d))


@query("backoff", f"{_UWIN} SELECT u.usage_key, u.request_id, scaled_window_seconds AS window_seconds, errors_before, {r6(f'least(least(scaled_window_seconds * 0.1, 60.0) * pow(1.5, least(errors_before, 5)), {LIMITS.max_backoff_seconds})')} AS backoff_seconds FROM uwin u JOIN errs e ON e.request_id = u.request_id WHERE over_scaled")
def _(spark, d):
    return ai.backoff(ledger(spark, d), LIMITS)


@query("health_status", """SELECT providers_up, agents_up, agents, CASE WHEN providers_up = 0 THEN 'critical' WHEN agents_up < agents / 2 THEN 'degraded' ELSE 'healthy' END AS system_health FROM (
  SELECT count(DISTINCT CASE WHEN available THEN provider END) AS providers_up, count(*) FILTER (available) AS agents_up, count(*) AS agents FROM (
  SELECT concat(agent, '/', provider) AS agent, provider, bool_or(success AND agent_ord < 3 AND provider = 'provider_a') AS available FROM answers GROUP BY 1, 2) a) b""")
def _(spark, d):
    up = F.max((F.col("success") & (F.col("agent_ord") < 3) & (F.col("provider") == "provider_a")).cast("int")) == 1
    agents = ai_results(spark, d).groupBy(F.concat_ws("/", "agent", "provider").alias("agent"), "provider").agg(up.alias("available"))
    return ai.health_status(agents)


@query("case_brief", "SELECT count(*) AS documents, CAST(to_json(list({'file': file_name, 'category': category, 'summary': substring(summary, 1, 200)} ORDER BY doc_id)) AS VARCHAR) AS context FROM (SELECT * FROM scored ORDER BY doc_id LIMIT 50) s")
def _(spark, d):
    return ai.case_brief(base.run(spark, d))


_STATE = "(SELECT doc_id, content, CASE WHEN doc_id % 4 = 0 THEN '' ELSE summary END AS summary, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE category END AS category FROM scored WHERE doc_id % 10 <> 9 UNION ALL SELECT doc_id, '', summary, category FROM scored WHERE doc_id % 10 = 9)"


@query("enrichment_plan", f"SELECT doc_id, unnest(list_filter([CASE WHEN summary = '' THEN 'summary' END, CASE WHEN coalesce(category, '') IN ('', '{lx.REVIEW_FOLDER}') THEN 'category' END, CASE WHEN coalesce(category, '') <> '' THEN 'scores' END, 'entities', 'timeline'], lambda x: x IS NOT NULL)) AS task FROM {_STATE} s WHERE content <> ''")
def _(spark, d):
    doc = F.col("doc_id")
    state = base.run(spark, d).withColumn("content", F.when(doc % 10 == 9, "").otherwise(F.col("content"))) \
        .withColumn("summary", F.when((doc % 4 == 0) & (doc % 10 != 9), "").otherwise(F.col("summary"))) \
        .withColumn("category", F.when((doc % 7 != 0) | (doc % 10 == 9), F.col("category")))
    return ai.enrichment_plan(state)


COMMON["tanswers"] = ("SELECT doc_id, file_path, folder AS category, CASE doc_id % 4 WHEN 0 THEN concat('[{\"date\": \"', strftime(created_ts, '%Y-%m-%d'), '\", \"title\": \"Event of ', CAST(doc_id AS VARCHAR), '\", \"event_type\": \"legal\", \"participants\": [\"A\", \"B\"], \"evidence_strength\": 0.9}, {\"title\": \"second\"}]') "
                      "WHEN 1 THEN 'The events are unclear' WHEN 2 THEN '[]' ELSE '[{\"date\": \"around May\", \"date_confidence\": 0.2, \"description\": \"approximate\"}]' END AS raw_response FROM ev JOIN cat_best USING (doc_id)")


@query("ai_timeline_ingest", """SELECT doc_id, file_path, category, pos AS position, coalesce(json_extract_string(e, '$.date'), '') AS event_date, coalesce(CAST(json_extract_string(e, '$.date_confidence') AS DOUBLE), 0.5) AS date_confidence,
  coalesce(json_extract_string(e, '$.title'), '') AS title, coalesce(json_extract_string(e, '$.description'), '') AS description, coalesce(json_extract_string(e, '$.event_type'), 'unknown') AS event_type,
  coalesce(array_to_string(json_extract_string(e, '$.participants[*]'), '|'), '') AS participants, coalesce(CAST(json_extract_string(e, '$.evidence_strength') AS DOUBLE), 0.5) AS evidence_strength FROM (
  SELECT doc_id, file_path, category, unnest(json_extract(raw_response, '$[*]')) AS e, CAST(generate_subscripts(json_extract(raw_response, '$[*]'), 1) - 1 AS BIGINT) AS pos FROM (SELECT * FROM tanswers WHERE json_valid(raw_response)) v) x""")
def _(spark, d):
    from probatio.plans import scored as plan
    ev = plan.categorised(evidence(spark, d))
    doc = F.col("doc_id")
    texts = [F.concat(F.lit('[{"date": "'), F.date_format("created_ts", "yyyy-MM-dd"), F.lit('", "title": "Event of '), doc.cast("string"),
                      F.lit('", "event_type": "legal", "participants": ["A", "B"], "evidence_strength": 0.9}, {"title": "second"}]')),
             F.lit("The events are unclear"), F.lit("[]"), F.lit('[{"date": "around May", "date_confidence": 0.2, "description": "approximate"}]')]
    return ai.ai_timeline_ingest(ev.select("doc_id", "file_path", F.col("folder").alias("category"),
                                           F.element_at(F.array(*texts), (doc % 4 + 1).cast("int")).alias("raw_response")))
