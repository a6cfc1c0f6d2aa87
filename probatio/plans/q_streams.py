"""Registered queries for survey section 2.13: streams drained and compared with batch SQL.

In append mode a period or session appears once the watermark (latest time minus delay) has
passed its end; the oracles say the same.
"""

from pyspark.sql import functions as F

from probatio.plans import q_scan_text as base
from probatio.plans.q_ai import LIMITS
from probatio.plans.registry import query, r6
from probatio.sources.evidence import USAGE_SQL, evidence, stream_table
from probatio.streaming import jobs
from probatio.streaming.run import drained, upserted


def _files(spark, d):
    return evidence(spark, d, stream_table(spark, d, "documents", "doc_id"))


def _usage(spark, d):
    return spark.sql(USAGE_SQL, events=stream_table(spark, d, "events", "ts")).withColumn("usage_key", F.col("usage_key") % 15)


@query("stream_ingest", f"SELECT doc_id, file_hash, file_type, category, subcategory, new_name, {r6('overall_impact')} AS overall_impact, requires_human_review FROM scored")
def _(spark, d):
    return drained(jobs.stream_ingest(_files(spark, d), base.RUN, base.PARTY_RULES).select(
        "doc_id", "file_hash", "file_type", "category", "subcategory", "new_name", "overall_impact", "requires_human_review"), "ingest")


@query("stream_dedup", "SELECT DISTINCT file_hash FROM ev")
def _(spark, d):
    # which copy of one batch comes first is open, so only the hash is compared
    return drained(jobs.stream_dedup(_files(spark, d)).select("file_hash"), "dedup")


@query("stream_periods", "SELECT strftime(p, '%Y-%m-%d %H:%M:%S') AS period_start, strftime(p + INTERVAL '1 day', '%Y-%m-%d %H:%M:%S') AS period_end, event_type, count(*) AS events, " + r6("sum(value)") + " AS total, count(*) >= 60 AS high_activity FROM "
       "(SELECT *, date_trunc('day', ts) AS p FROM events) e WHERE p + INTERVAL '1 day' <= (SELECT max(ts) - INTERVAL '1 hour' FROM events) GROUP BY p, event_type")
def _(spark, d):
    return drained(jobs.stream_periods(stream_table(spark, d, "events", "ts"), busy=60), "periods")


@query("stream_months", "SELECT strftime(ts, '%Y-%m') AS month, event_type, count(*) AS events, count(*) >= 3 AS high_activity FROM events GROUP BY 1, 2")
def _(spark, d):
    return upserted(jobs.stream_months(stream_table(spark, d, "events", "ts")), ["month", "event_type"], "months")


@query("stream_sessions", "SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_ts, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_ts, count(*) AS events FROM (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM ("
       "SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL '6 hours' THEN 0 ELSE 1 END AS nw FROM events) a) b GROUP BY user_id, run HAVING max(ts) + INTERVAL '6 hours' <= (SELECT max(ts) - INTERVAL '1 hour' FROM events)")
def _(spark, d):
    return drained(jobs.stream_sessions(stream_table(spark, d, "events", "ts")), "sessions")


@query("stream_usage", f"SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, usage_key, count(*) AS requests, CAST(sum(tokens) AS BIGINT) AS tokens, {r6('sum(cost)')} AS cost, sum(tokens) >= {LIMITS.tokens_per_hour} OR round(sum(cost), 9) >= {LIMITS.cost_per_hour} OR count(*) >= {LIMITS.requests_per_minute * 60} AS over_limit FROM "
       "(SELECT *, time_bucket(INTERVAL '10 minutes', ts) - k * INTERVAL '10 minutes' AS w FROM ledger, (SELECT unnest(range(0, 6)) AS k) r) x WHERE w + INTERVAL '1 hour' <= (SELECT max(ts) - INTERVAL '1 hour' FROM ledger) GROUP BY w, usage_key")
def _(spark, d):
    return drained(jobs.stream_usage(_usage(spark, d), LIMITS), "usage")


@query("stream_rate_state", f"""WITH RECURSIVE steps AS (SELECT e.usage_key, e.request_id, e.success, CASE WHEN e.success THEN 0 ELSE e.errors_before + 1 END AS ce,
  row_number() OVER (PARTITION BY e.usage_key ORDER BY l.ts, e.request_id) AS i FROM errs e JOIN ledger l ON l.request_id = e.request_id),
  fold(usage_key, i, request_id, m) AS (SELECT usage_key, CAST(0 AS BIGINT), CAST(-1 AS BIGINT), CAST(1.0 AS DOUBLE) FROM (SELECT DISTINCT usage_key FROM ledger) k
  UNION ALL SELECT s.usage_key, s.i, s.request_id, CASE WHEN s.success THEN least(1.0, f.m + 0.1) WHEN s.ce >= 3 THEN greatest(0.3, f.m * 0.7) ELSE f.m END FROM fold f JOIN steps s ON s.usage_key = f.usage_key AND s.i = f.i + 1)
  SELECT fold.usage_key, fold.request_id, {r6('m')} AS multiplier FROM fold JOIN ledger l2 ON l2.request_id = fold.request_id WHERE i > 0 AND l2.ts <= (SELECT max(ts) - INTERVAL '1 hour' FROM ledger)""")
def _(spark, d):
    return drained(jobs.stream_rate_state(_usage(spark, d)), "rate")
