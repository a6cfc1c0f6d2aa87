"""Reading the sample tables, and the views the registered queries run on.

``documents`` is plain prose, so the evidence view adds to each text a sentence built from
the order and customer with the same number: dates, amounts, names and case words then
occur in known places. The view's text is one SQL statement in the common subset of
ANSI dialects; only hash functions differ between engines and are added outside it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probatio.session import fresh_path


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: Rows that a file of a batch stands for at least, so that rows dealt in turn leave no file of it empty.
FILE_ROWS = 1000


def stream_table(spark: SparkSession, folder: str, name: str, order: str, batches: int = 4, file_rows: int = FILE_ROWS) -> DataFrame:
    """The same table as a stream of ``batches`` batches, in ascending order of a column.

    The table is laid out anew, one batch after the other. Every batch has the same number of files, about as many as it
    has input splits, so that no task writes or reads a whole batch and no batch takes files of the next. A
    batch too small for that many files goes with the next one.
    """
    rows = table(spark, folder, name)
    kind = rows.schema[order].dataType.typeName()
    key = F.coalesce((F.col(order).cast("timestamp") if "timestamp" in kind else F.col(order)).cast("double"), F.lit(0.0))
    cuts = rows.select(key.alias("v")).stat.approxQuantile("v", [k / batches for k in range(1, batches)], 0.01)
    files = max(1, min(-(-rows.rdd.getNumPartitions() // batches), rows.count() // file_rows))
    if files > 1:
        number = sum(((key > cut).cast("int") for cut in cuts), F.lit(0))
        sizes, kept, waiting = {r["no"]: r["n"] for r in rows.groupBy(number.alias("no")).agg(F.count("*").alias("n")).collect()}, [], 0
        for no, cut in enumerate(cuts):
            waiting += sizes.get(no, 0)
            if waiting >= files * file_rows:
                kept, waiting = [*kept, cut], 0
        last = waiting + sizes.get(len(cuts), 0)
        cuts = kept if last >= files * file_rows else kept[:-1]
    path = fresh_path(spark, f"arriving-{name}")
    for low, high in zip([None, *cuts], [*cuts, None]):
        part = rows.where((F.lit(True) if low is None else key > low) & (F.lit(True) if high is None else key <= high))
        (part.repartition(files) if files > 1 else part.coalesce(1)).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(path)


# {documents} {orders} {customer} are bound by the engine that runs the statement.
EVIDENCE_SQL = """
SELECT doc_id, raw, lang, source, file_name, ext AS extension, created_ts, modified_ts, party,
       concat(source, '/', file_name) AS file_path,
       CASE ext WHEN '.txt' THEN 'Text File' WHEN '.pdf' THEN 'PDF Document'
            WHEN '.docx' THEN 'Word Document' WHEN '.eml' THEN 'Email' WHEN '.png' THEN 'Image'
            WHEN '.csv' THEN 'CSV File' ELSE 'Unknown' END AS file_type,
       concat(raw, chr(10), sentence) AS content
FROM (
 SELECT doc_id, raw, lang, source, ext, party,
  concat(CASE doc_id % 9 WHEN 0 THEN 'motion_summary' WHEN 1 THEN 'bank_asset_list'
     WHEN 2 THEN 'text_message_log' WHEN 3 THEN 'site:notes' WHEN 4 THEN 'fraud_memo'
     WHEN 5 THEN 'digital_copy' WHEN 6 THEN 'due_process letter' WHEN 7 THEN 'harassment_log'
     ELSE 'scan' END, '_', CAST(doc_id % 40 AS VARCHAR(9)), ext) AS file_name,
  o_orderdate AS created_ts,
  CASE doc_id % 3 WHEN 0 THEN o_orderdate WHEN 1 THEN o_orderdate + INTERVAL '1' DAY
     ELSE o_orderdate + INTERVAL '2' DAY END AS modified_ts,
  concat(CASE doc_id % 8
    WHEN 0 THEN concat('On ', d1, ' ', n1, ' filed a motion with the court and the judge set a hearing at 10:30 AM. Dr. Wexford and ', n2, ' gave testimony; this analysis of the statute is a summary.')
    WHEN 1 THEN concat('On ', d1, ' ', n1, ' transferred $', amt, '.50 from the bank account to an offshore account; the receipt and a false statement of income are evidence of missing statements.')
    WHEN 2 THEN concat('Told ', n2, ' that someone threatened me, hit me and grabbed my phone on ', d1, '. I was scared of the stalkerware, spyware and surveillance of my computer and device. A police record exists.')
    WHEN 3 THEN concat('The text message sent ', d1, ' by ', n1, ' to ', n2, ' over whatsapp was deleted, see the screenshot of the chat conversation. Call 555-', ph3, '-', ph4, ' or mail p', ph3, '@example.org.')
    WHEN 4 THEN concat('School pick up on ', d1, ' by the plaintiff ', n1, '; parenting time and custody visitation. They said take the kids, never see them again, bad mother.')
    WHEN 5 THEN concat('Attorney notes, confidential: fraud, perjury and a false exhibit by ', n2, ', the lie after ', d1, ' continued. Failed to disclose; delay tactics, I admit.')
    WHEN 6 THEN concat('Due process and bias in a meeting with J. Harrow about the appointment of ', d1, ', maybe ongoing harassment and a violation after that, getting worse and escalating.')
    ELSE concat('Nothing of note, ', n1, ' and ', n2, ' agree.') END,
    CASE WHEN doc_id % 4 = 1 THEN concat(' A follow-up with ', n2, ' about payment came on ', d2, ' at 14:05:09, perhaps earlier than 2/30/2020.') ELSE '' END) AS sentence
 FROM (
  SELECT f.doc_id, f.text AS raw, f.lang, f.source, f.c_name AS party, f.o_orderdate,
   CASE CAST(floor(f.doc_id / 3) AS BIGINT) % 8 WHEN 0 THEN '.txt' WHEN 1 THEN '.pdf' WHEN 2 THEN '.docx'
     WHEN 3 THEN '.eml' WHEN 4 THEN '.png' WHEN 5 THEN '.csv' WHEN 6 THEN '.zip' ELSE '.xyz' END AS ext,
   CASE CAST(floor(f.doc_id / 8) AS BIGINT) % 6
     WHEN 0 THEN concat(mm, '/', dd, '/', yy) WHEN 1 THEN concat(yy, '-', mm, '-', dd)
     WHEN 2 THEN concat(mon, ' ', d0, ', ', yy) WHEN 3 THEN concat(d0, ' ', mon, ' ', yy)
     WHEN 4 THEN concat(mm, '-', dd, '-', yy) ELSE concat(dd, '/', mm, '/', y2) END AS d1,
   concat(yy, '-', mm, '-', CASE WHEN CAST(dd AS INT) < 15 THEN '28' ELSE '09' END) AS d2,
   CAST(CAST(floor(f.o_totalprice) AS BIGINT) AS VARCHAR(20)) AS amt,
   lpad(CAST(f.c_custkey % 1000 AS VARCHAR(9)), 3, '0') AS ph3,
   lpad(CAST(f.doc_id % 10000 AS VARCHAR(9)), 4, '0') AS ph4,
   concat(CASE f.c_custkey % 6 WHEN 0 THEN 'Alder' WHEN 1 THEN 'Birch' WHEN 2 THEN 'Cedar' WHEN 3 THEN 'Dorian'
      WHEN 4 THEN 'Elm' ELSE 'Fern' END, ' ', CASE f.c_custkey % 4 WHEN 0 THEN 'Northgate' WHEN 1 THEN 'Eastwick'
      WHEN 2 THEN 'Southall' ELSE 'Westbrook' END) AS n1,
   concat(CASE f.doc_id % 5 WHEN 0 THEN 'Gale' WHEN 1 THEN 'Hazel' WHEN 2 THEN 'Iris' WHEN 3 THEN 'Juniper'
      ELSE 'Kestrel' END, ' ', CASE f.doc_id % 3 WHEN 0 THEN 'Marsh' WHEN 1 THEN 'Field' ELSE 'Stone' END) AS n2
  FROM (
   SELECT e.*, lpad(CAST(extract(month FROM o_orderdate) AS VARCHAR(9)), 2, '0') AS mm,
          lpad(CAST(extract(day FROM o_orderdate) AS VARCHAR(9)), 2, '0') AS dd,
          CAST(extract(day FROM o_orderdate) AS VARCHAR(9)) AS d0,
          CAST(extract(year FROM o_orderdate) AS VARCHAR(9)) AS yy,
          substring(CAST(extract(year FROM o_orderdate) AS VARCHAR(9)), 3, 2) AS y2,
          CASE extract(month FROM o_orderdate) WHEN 1 THEN 'January' WHEN 2 THEN 'February'
           WHEN 3 THEN 'March' WHEN 4 THEN 'April' WHEN 5 THEN 'May' WHEN 6 THEN 'June'
           WHEN 7 THEN 'July' WHEN 8 THEN 'August' WHEN 9 THEN 'September' WHEN 10 THEN 'October'
           WHEN 11 THEN 'November' ELSE 'December' END AS mon
   FROM (
    SELECT d.doc_id, d.text, d.lang, d.source, coalesce(o.o_orderdate, TIMESTAMP '2000-01-01 00:00:00') AS o_orderdate,
           coalesce(o.o_totalprice, 0) AS o_totalprice, coalesce(c.c_custkey, 0) AS c_custkey, coalesce(c.c_name, 'No party') AS c_name
    FROM {documents} d LEFT JOIN {orders} o ON o.o_orderkey = d.doc_id LEFT JOIN {customer} c ON c.c_custkey = o.o_custkey
   ) e
  ) f
 ) a
) b
"""


_JOINS = "FROM {documents} d LEFT JOIN {orders} o ON o.o_orderkey = d.doc_id LEFT JOIN {customer} c ON c.c_custkey = o.o_custkey"
assert _JOINS in EVIDENCE_SQL
#: The same statement where orders have met their customers before, so that texts are shuffled once.
_EVIDENCE_BY_ORDER = EVIDENCE_SQL.replace(_JOINS, "FROM {documents} d LEFT JOIN {parties} c ON c.o_orderkey = d.doc_id") \
    .replace("coalesce(o.", "coalesce(c.")


def _parties(documents: DataFrame, orders: DataFrame, customer: DataFrame) -> DataFrame:
    """Orders with their customer; of stored documents only the orders that have one."""
    used = orders.select("o_orderkey", "o_orderdate", "o_totalprice", "o_custkey")
    if not documents.isStreaming:
        used = used.join(documents.select(F.col("doc_id").alias("o_orderkey")), "o_orderkey", "left_semi")
    return used.join(customer.select("c_custkey", "c_name"), F.col("c_custkey") == F.col("o_custkey"), "left") \
        .select("o_orderkey", "o_orderdate", "o_totalprice", "c_custkey", "c_name")


def evidence(spark: SparkSession, folder: str, documents: DataFrame | None = None) -> DataFrame:
    """The evidence table: one row per document, keyed by ``doc_id``.

    ``file_hash`` and ``file_size`` describe the original text; ``content`` is what was
    extracted from it. ``documents`` may be a stream.
    """
    if documents is None:
        documents = table(spark, folder, "documents")
    base = spark.sql(_EVIDENCE_BY_ORDER, documents=documents, parties=_parties(
        documents, table(spark, folder, "orders"), table(spark, folder, "customer")))
    return base.select(
        "doc_id", "file_path", "file_name", "extension", "file_type", "content", "raw",
        F.sha2("raw", 256).alias("file_hash"),
        F.octet_length("raw").cast("bigint").alias("file_size"),
        "created_ts", "modified_ts", "lang", "source", "party")


# One row per document and agent; the answers come in five shapes (by doc_id % 5):
# prose around JSON, bare JSON, prose only, broken JSON, JSON with text numbers. {documents} has
# a row per agent already.
AGENTS = ["document_intelligence", "legal_analysis", "pattern_discovery"]
AI_RESULTS_SQL = """
SELECT doc_id, agent, agent_ord, case_theory, provider, tokens_used, success, ts, theory1, theory2, score1, score2,
  CASE doc_id % 5
    WHEN 0 THEN concat('Here is my analysis:', chr(10), body, chr(10), 'Thank you.')
    WHEN 1 THEN body
    WHEN 2 THEN concat('No object here, only prose about document ', CAST(doc_id AS VARCHAR(20)), ' for ', agent, CASE WHEN doc_id % 2 = 0 THEN ' and it goes on for quite some time so that the answer is longer than one hundred characters in the end.' ELSE '.' END)
    WHEN 3 THEN concat('{{"summary": "broken ', CAST(doc_id AS VARCHAR(20)), '", "confidence": }}')
    ELSE concat('{{"summary": "text numbers", "confidence": "', conf, '", "certainty": 0.9, "probative_value": "n/a", "relevance_score": "0.8", "evidence_category": "Communications"}}') END AS raw_response
FROM (
 SELECT x.*, concat('{{"summary": "Finding ', CAST(doc_id AS VARCHAR(20)), ' by ', agent, '", "confidence": ', conf,
   ', "evidence_category": "', cat, '", "document_type": "', CASE WHEN doc_id % 2 = 0 THEN 'letter' ELSE 'email' END,
   '", "probative_value": 0.', CAST(1 + doc_id % 9 AS VARCHAR(9)), ', "relevance_score": 0.', CAST(1 + (doc_id + agent_ord) % 9 AS VARCHAR(9)),
   ', "legal_significance": "', CASE doc_id % 3 WHEN 0 THEN 'crucial for the case' WHEN 1 THEN 'relevant detail' ELSE '' END,
   '", "key_parties": ["Party ', CAST(doc_id % 7 AS VARCHAR(9)), '", "Party ', CAST(doc_id % 4 AS VARCHAR(9)),
   '"], "organizations": ["Org ', CAST(doc_id % 3 AS VARCHAR(9)), '"], "financial_amounts": ["$', CAST(doc_id * 10 AS VARCHAR(20)),
   '"], "important_dates": ["2020-01-0', CAST(1 + doc_id % 9 AS VARCHAR(9)), '"], "key_facts": ["fact"], "case_specific_insights": ["insight ', CAST(doc_id % 6 AS VARCHAR(9)),
   '", "insight ', CAST(doc_id % 4 AS VARCHAR(9)), '"], "suggested_theories": ["Theory S', CAST(doc_id % 3 AS VARCHAR(9)),
   '"], "strategic_insights": ["Move ', CAST(agent_ord AS VARCHAR(9)), '"], "legal_theory_support": {{"', theory1, '": ', score1, ', "', theory2, '": ', score2, '}}}}') AS body
 FROM (
  SELECT d.doc_id, d.agent, d.agent_ord, 'all' AS case_theory,
   CASE WHEN (d.doc_id + d.agent_ord) % 2 = 0 THEN 'provider_a' ELSE 'provider_b' END AS provider,
   500 + d.doc_id % 700 + 10 * d.agent_ord AS tokens_used, (d.doc_id + d.agent_ord) % 11 <> 0 AS success,
   coalesce(o.o_orderdate, TIMESTAMP '2000-01-01 00:00:00') AS ts,
   CASE WHEN l.quality = 1 THEN concat('0.', CAST(7 + d.doc_id % 3 AS VARCHAR(9)), CAST(d.agent_ord AS VARCHAR(9))) ELSE concat('0.', CAST(4 + d.doc_id % 5 AS VARCHAR(9)), CAST(d.agent_ord AS VARCHAR(9))) END AS conf,
   CASE d.doc_id % 6 WHEN 0 THEN 'financial_evidence' WHEN 1 THEN 'abuse_evidence' WHEN 2 THEN 'legal_violations'
     WHEN 3 THEN 'communications' WHEN 4 THEN 'court_records' ELSE 'other' END AS cat,
   concat('Theory ', CAST(d.doc_id % 4 AS VARCHAR(9))) AS theory1, concat('Theory ', CAST(4 + d.doc_id % 3 AS VARCHAR(9))) AS theory2,
   concat('0.', CAST(1 + (d.doc_id + 2 * d.agent_ord) % 9 AS VARCHAR(9))) AS score1, concat('0.', CAST(1 + (2 * d.doc_id + d.agent_ord) % 9 AS VARCHAR(9)), '5') AS score2
  FROM {documents} d LEFT JOIN {orders} o ON o.o_orderkey = d.doc_id
  LEFT JOIN {labels} l ON l.doc_id = d.doc_id
 ) x
) y
"""


def ai_results(spark: SparkSession, folder: str) -> DataFrame:
    """Answers of models: one row per document and agent."""
    each = table(spark, folder, "documents").select(
        "doc_id", F.posexplode(F.array(*[F.lit(a) for a in AGENTS])).alias("pos", "agent"))
    return spark.sql(
        AI_RESULTS_SQL, documents=each.select("doc_id", "agent", (F.col("pos") + 1).alias("agent_ord")),
        orders=table(spark, folder, "orders"), labels=table(spark, folder, "labels"))


USAGE_SQL = """
SELECT user_id AS usage_key, event_id AS request_id, ts, CAST(floor(value * 100) AS BIGINT) AS tokens,
       CAST(floor(value * 100) AS BIGINT) * 0.0001 AS cost, event_type NOT IN ('error', 'click', 'view') AS success,
       event_type
FROM {events}
"""


def ai_usage(spark: SparkSession, folder: str) -> DataFrame:
    """The usage ledger: one row per request (from ``events``)."""
    return spark.sql(USAGE_SQL, events=table(spark, folder, "events"))
