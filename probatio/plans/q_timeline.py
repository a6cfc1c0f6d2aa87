"""Registered queries for survey section 2.7."""

from pyspark.sql import functions as F

from probatio.operators import timeline as tl
from probatio.plans import q_entities as qe
from probatio.plans import scored as plan
from probatio.plans.registry import COMMON, query, r6
from probatio.sources.evidence import evidence

_D = "strftime({0}, '%Y-%m-%d') AS {0}"


def day(column):
    return _D.format(column)


_META = ("SELECT doc_id, file_path, CAST({no} AS BIGINT) AS position, 'metadata' AS format, CAST({ts} AS DATE) AS event_date, 0.9::DOUBLE AS date_confidence, 'document' AS event_type, {arg} AS argument, "
         "concat('Document {label}: ', file_name) AS title, concat('File {verb}: ', file_type, ' document') AS description, CAST([] AS VARCHAR[]) AS participants, {s}::DOUBLE AS evidence_strength FROM ev JOIN cat_best USING (doc_id)")
COMMON["mevents"] = (_META.format(no=-2, ts="created_ts", arg=qe.ARG_SQL, label="Created", verb="created", s=0.3) + " UNION ALL "
                     + _META.format(no=-1, ts="modified_ts", arg=qe.ARG_SQL, label="Modified", verb="last modified", s=0.4) + " WHERE created_ts <> modified_ts")
COMMON["events_all"] = (
    f"SELECT doc_id, file_path, position, format, event_date, confidence AS date_confidence, event_type, {qe.ARG_SQL} AS argument, "
    "concat(upper(event_type[1]), event_type[2:], ' Event') AS title, description, "
    + qe._participants_sql("regexp_replace(description, '[À-ÖØ-öø-ɏ]', '_', 'g')") + " AS participants, evidence_strength FROM pevents UNION ALL SELECT * FROM mevents")


def events(spark, d):
    return tl.timeline_events(plan.categorised(evidence(spark, d)))


@query("date_mentions", "SELECT doc_id, position, raw_date, format, confidence, context FROM mentions")
def _(spark, d):
    return qe.mentions(spark, d).select("doc_id", "position", "raw_date", "format", "confidence", "context")


@query("date_parse", f"SELECT doc_id, position, raw_date, format, {day('event_date')} FROM parsed")
def _(spark, d):
    return tl.date_parse(qe.mentions(spark, d)).select("doc_id", "position", "raw_date", "format", "event_date")


@query("mention_dedup", f"SELECT doc_id, {day('event_date')}, position, arg_min(raw_date, format) AS raw_date FROM parsed GROUP BY doc_id, parsed.event_date, position")
def _(spark, d):
    return tl.mention_dedup(tl.date_parse(qe.mentions(spark, d)))


_EVC = f"doc_id, file_path, position, format, {day('event_date')}, date_confidence, event_type, argument, title, description, coalesce(array_to_string(participants, '|'), '') AS participants, {r6('evidence_strength')} AS evidence_strength"


@query("pattern_events", f"SELECT {_EVC} FROM events_all WHERE format <> 'metadata'")
def _(spark, d):
    ev = plan.categorised(evidence(spark, d)).select("doc_id", "file_path", "folder", "content")
    return tl.pattern_events(tl.date_parse(tl.date_mentions(ev)))


@query("metadata_events", f"SELECT {_EVC} FROM mevents")
def _(spark, d):
    return tl.metadata_events(plan.categorised(evidence(spark, d)))


_TL = f"strftime(min(event_date), '%Y-%m-%d') AS start_date, strftime(max(event_date), '%Y-%m-%d') AS end_date, count(*) AS total_events, {r6('avg(evidence_strength)')} AS strength_score"
_TID = "concat('timeline_', replace(lower(argument), ' ', '_')) AS timeline_id"
COMMON["tlines"] = (f"SELECT argument, {_TL}, avg(evidence_strength) AS exact_strength, {_TID} FROM events_all GROUP BY argument UNION ALL SELECT 'Master Timeline', {_TL}, avg(evidence_strength), 'timeline_master_timeline' FROM events_all")


@query("argument_timelines", f"SELECT argument, {_TL}, {_TID} FROM events_all GROUP BY argument")
def _(spark, d):
    return tl.argument_timelines(events(spark, d))


@query("master_timeline", "SELECT * EXCLUDE (exact_strength) FROM tlines")
def _(spark, d):
    return tl.master_timeline(events(spark, d))


@query("repeated_types", "SELECT argument, event_type, count(*) AS occurrences FROM events_all GROUP BY argument, event_type HAVING count(*) >= 3")
def _(spark, d):
    return tl.repeated_types(events(spark, d))


@query("escalation", f"""SELECT argument, events, {r6('f')} AS first_strength, {r6('l')} AS last_strength, l > f AS escalating FROM (SELECT argument, count(*) AS events,
  max(evidence_strength) FILTER (a = 1) AS f, max(evidence_strength) FILTER (z = 1) AS l FROM (SELECT *, row_number() OVER (PARTITION BY argument ORDER BY event_date, doc_id, position, format) AS a,
  row_number() OVER (PARTITION BY argument ORDER BY event_date DESC, doc_id DESC, position DESC, format DESC) AS z FROM events_all WHERE event_type = 'abuse') x GROUP BY argument) y WHERE events >= 2""")
def _(spark, d):
    return tl.escalation(events(spark, d))


@query("date_clusters", """SELECT argument, row_number() OVER (PARTITION BY argument ORDER BY a) AS cluster_no, strftime(a, '%Y-%m-%d') AS start_date, strftime(b, '%Y-%m-%d') AS end_date, n AS events, n >= 3 AS reported,
  strftime(a, '%B %Y') AS label FROM (SELECT argument, run, min(event_date) AS a, max(event_date) AS b, count(*) AS n FROM (SELECT *, sum(nw) OVER (PARTITION BY argument ORDER BY event_date, doc_id, position, event_type, format ROWS UNBOUNDED PRECEDING) AS run FROM (
  SELECT *, CASE WHEN datediff('day', lag(event_date) OVER (PARTITION BY argument ORDER BY event_date, doc_id, position, event_type, format), event_date) <= 10 THEN 0 ELSE 1 END AS nw FROM events_all) p) q GROUP BY argument, run HAVING count(*) >= 2) c""")
def _(spark, d):
    return tl.date_clusters(events(spark, d), gap_days=10)


_CP = ("SELECT argument, strftime(event_date, '%Y-%m') AS month, count(*) AS event_count, avg(evidence_strength) AS average_strength, CASE WHEN count(*) >= 3 THEN 'High activity period' WHEN max(evidence_strength) >= 0.8 THEN 'High-strength evidence period' END AS reason "
       "FROM events_all GROUP BY argument, strftime(event_date, '%Y-%m')")


@query("critical_periods", f"SELECT argument, month, event_count, {r6('average_strength')} AS average_strength, reason FROM ({_CP}) c WHERE reason IS NOT NULL")
def _(spark, d):
    return tl.critical_periods(events(spark, d))


@query("critical_titles", f"SELECT argument, month, title, n AS events FROM (SELECT e.argument, c.month, title, count(*) FILTER (reason = 'High activity period' OR evidence_strength >= 0.8) AS n FROM events_all e JOIN ({_CP}) c "
       "ON c.argument = e.argument AND c.month = strftime(e.event_date, '%Y-%m') WHERE reason IS NOT NULL GROUP BY e.argument, c.month, title) t WHERE n > 0")
def _(spark, d):
    return tl.critical_titles(events(spark, d))


@query("timeline_viz", f"SELECT argument, doc_id, {day('event_date')}, title, event_type AS type, {r6('evidence_strength')} AS strength, CASE WHEN length(description) > 100 THEN concat(substring(description, 1, 100), '...') ELSE description END AS description FROM events_all")
def _(spark, d):
    return tl.timeline_viz(events(spark, d))


@query("timeline_summary", f"SELECT count(*) AS timelines, CAST(sum(total_events) AS BIGINT) AS total_events, {r6('avg(exact_strength)')} AS average_strength, count(*) FILTER (argument <> 'Master Timeline') AS argument_timelines, "
       "CAST(sum(total_events) FILTER (argument <> 'Master Timeline') AS BIGINT) AS argument_events FROM tlines")
def _(spark, d):
    return tl.timeline_summary(tl.master_timeline(events(spark, d)))


@query("timeline_stats", f"SELECT coalesce(event_type, 'all') AS event_type, count(*) AS events, {r6('avg(date_confidence)')} AS average_confidence, strftime(min(event_date), '%Y-%m-%d') AS earliest, strftime(max(event_date), '%Y-%m-%d') AS latest "
       "FROM events_all GROUP BY ROLLUP (event_type)")
def _(spark, d):
    return tl.timeline_stats(events(spark, d))


@query("first_events", f"SELECT {day('event_date')}, doc_id, position, event_type, title FROM events_all ORDER BY events_all.event_date, doc_id, position, format, event_type LIMIT 10")
def _(spark, d):
    return tl.first_events(events(spark, d))


@query("timeline_listing", "SELECT CASE WHEN row_number() OVER (PARTITION BY year(event_date) ORDER BY event_date, doc_id, position, format, event_type) = 1 THEN concat('=== ', CAST(year(event_date) AS VARCHAR), ' ===') ELSE '' END AS heading, "
       "strftime(event_date, '%B %d, %Y') AS date, doc_id, position, format, array_to_string(list_transform(string_split(event_type, '_'), lambda w: concat(upper(w[1]), w[2:])), ' ') AS type, file_path, description, " + r6("date_confidence") + " AS date_confidence FROM events_all")
def _(spark, d):
    return tl.timeline_listing(events(spark, d))


@query("events_by_year", "SELECT year(event_date) AS year, count(*) AS events, strftime(min(event_date), '%Y-%m-%d') AS first_date, strftime(max(event_date), '%Y-%m-%d') AS last_date FROM events_all GROUP BY year(event_date)")
def _(spark, d):
    return tl.events_by_year(events(spark, d))
