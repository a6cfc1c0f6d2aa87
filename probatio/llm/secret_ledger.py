"""Secret scans over an incremental ledger of blobs.

Every version of every path is addressed by the hash of its content. The ledger holds one row per
(blob, rule, rule version) that has been scanned, with the spans found, also when there are none.
A run scans only pairs the ledger lacks, once per blob however many paths hold it, and joins the
findings back to all paths. Column functions only.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from probatio.llm.common import bind, packed, unpacked
from probatio.operators.skew import attach_by_key
from probatio.session import written

LEDGER_SCHEMA = "blob string, rule string, rule_version int, spans array<struct<start: int, end: int>>"


def either_case(word: str) -> str:
    """A pattern for ``word`` with letters in either case, ASCII alone."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` are taken from the left without overlap; those whose ``group`` has
    fewer than ``least`` characters are dropped afterwards."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1


# fixed values: the kinds of secrets, in the order in which ties are listed
KEYWORDS = ("password", "passwd", "secret", "token", "api_?key")
ASSIGN = "(" + "|".join(either_case(k) for k in KEYWORDS) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE_RULES = (
    Rule("assign", 1, ASSIGN, 2, 12),
    Rule("access", 1, "AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", 1, "[0-9a-f]{16,}"),
)
RULES = (*BASE_RULES, Rule("pem", 1, "-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----"))


def _matches(text: Column, rule: Rule) -> Column:
    """Per match: characters between it and the one before, its length, and whether it stays.
    A text without a match is searched once, any other a second time for the gaps."""
    pattern = F.lit(rule.pattern)

    def described(found: Column) -> Column:
        held = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else found
        return bind(F.struct(F.split(text, rule.pattern, -1).alias("gaps"), held.alias("held")), lambda s: F.transform(
            found, lambda m, i: F.struct(F.length(F.get(s["gaps"], i)).alias("gap"), F.length(m).alias("len"),
                                         (F.length(F.get(s["held"], i)) >= rule.least).alias("stays"))))

    return bind(F.regexp_extract_all(text, pattern, F.lit(0)), lambda found: F.when(F.size(found) > 0, described(found)))


def scan_blobs(blobs: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Ledger rows for ``blobs`` (blob, text, missing array<string>): each rule named in ``missing``
    is run. Starts are running sums of gaps and lengths, taken in a window per blob and rule. A blob
    may have several rows: they bring the same matches, which count once."""
    per_rule = F.array(*[F.struct(
        F.lit(r.kind).alias("rule"), F.lit(r.version).alias("rule_version"),
        F.array_contains("missing", r.kind).alias("due"),
        F.when(F.array_contains("missing", r.kind), _matches(F.col("text"), r)).alias("matches")) for r in rules])
    rows = blobs.select("blob", F.explode(per_rule).alias("r")).where("r.due") \
        .select("blob", "r.rule", "r.rule_version", F.posexplode_outer("r.matches").alias("at", "m")) \
        .groupBy("blob", "rule", "rule_version", "at").agg(*[F.max(f"m.{c}").alias(c) for c in ("gap", "len", "stays")])
    order = Window.partitionBy("blob", "rule").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("gap") + F.col("len")).over(order).cast("int")
    return rows.withColumn("end", end).groupBy("blob", "rule", "rule_version").agg(F.sort_array(F.collect_set(
        F.when(F.col("stays"), F.struct((F.col("end") - F.col("len")).alias("start"), F.col("end"))))).alias("spans"))


def scan_history(history: DataFrame, ledger: DataFrame | None = None, rules: Sequence[Rule] = RULES,
                 path_col: str = "doc_id", text_col: str = "text",
                 version_col: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(new ledger rows, findings of all paths).

    ``ledger``: what earlier runs returned, appended; None if there were none. Findings have one
    row per row of ``history``: path, version, blob, and ``spans``, all findings of the current
    rule versions as (start, kind_no, end, kind), in order. A null text is the empty blob. Repeated
    rows share a blob and are scanned once; those of equal path and version may be scanned each, with
    the matches counted once.
    """
    version = history[version_col].cast("string") if version_col else F.lit("")
    text = F.coalesce(history[text_col].cast("string"), F.lit(""))
    versions = history.select(history[path_col].alias("path"), version.alias("version"),
                              F.sha2(text, 256).alias("blob"), text.alias("text"))
    paths = written(versions.drop("text"), "paths")
    blobs = paths.groupBy("blob").agg(F.min(F.struct("path", "version")).alias("at"), F.count("*").alias("copies"))
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    current = F.array(*[F.struct(F.lit(r.kind).alias("rule"), F.lit(r.version).alias("rule_version")) for r in rules])
    if ledger is None:
        due = blobs.withColumn("missing", kinds)
    else:
        ledger = ledger.where(F.array_contains(current, F.struct("rule", "rule_version")))
        seen = ledger.groupBy("blob").agg(F.collect_set("rule").alias("seen"))
        due = blobs.join(seen, "blob", "left").withColumn(
            "missing", F.when(F.col("seen").isNull(), kinds).otherwise(F.array_except(kinds, "seen"))).where(F.size("missing") > 0)
    due = due.select(F.col("at.path").alias("_path"), F.col("at.version").alias("_version"), F.col("blob").alias("_blob"), "missing")
    same = versions["path"].eqNullSafe(F.col("_path")) & (versions["version"] == F.col("_version")) & (versions["blob"] == F.col("_blob"))
    new = written(scan_blobs(versions.join(due, same).select("blob", "text", "missing"), rules), "ledger")
    known = new if ledger is None else ledger.select(*new.columns).unionByName(new)
    number = F.array_position(kinds, F.col("rule")).cast("int")
    per_blob = known.where(F.size("spans") > 0).withColumn("span", F.explode("spans")).groupBy("blob").agg(
        F.sort_array(F.collect_list(F.struct("span.start", number.alias("kind_no"), "span.end", F.col("rule").alias("kind")))).alias("spans"))
    # every blob has a row, so that a much copied one counts as heavy also if nothing was found in it
    per_blob = blobs.select("blob", "copies").join(per_blob, "blob", "left")
    spread = paths.withColumn("_row", F.xxhash64("path", "version"))
    return new, attach_by_key(spread, per_blob, "blob", "copies", "_row").select(
        "path", "version", "blob", F.coalesce("spans", F.array().cast(per_blob.schema["spans"].dataType)).alias("spans"))


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(findings: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of :func:`scan_history`'s findings."""
    base = F.filter("spans", lambda s: s["kind_no"] <= len(BASE_RULES))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(r.kind) for r in BASE_RULES]
    return findings.select(F.col("path").cast("long").alias("doc_id"), *counts,
                           F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def islands(findings: DataFrame) -> DataFrame:
    """(blob, copies, cuts): overlapping spans of a blob as one, as (start, end) in order."""
    per_blob = findings.where(F.size("spans") > 0).groupBy("blob").agg(
        F.first("spans").alias("spans"), F.count("*").alias("copies"))
    rows = per_blob.select("blob", "copies", F.explode("spans").alias("s")).select("blob", "copies", "s.start", "s.end", "s.kind_no")
    order = Window.partitionBy("blob").orderBy("start", "kind_no")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = rows.withColumn("opens", F.when(before.isNull() | (F.col("start") > before), 1).otherwise(0))
    numbered = opened.withColumn("island", F.sum("opens").over(order))
    return numbered.groupBy("blob", "copies", "island").agg(F.min("start").alias("start"), F.max("end").alias("end")) \
        .groupBy("blob", "copies").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("cuts"))


def redact(docs: DataFrame, rules: Sequence[Rule] = RULES, path_col: str = "doc_id", text_col: str = "text",
           mask: str = "[secret]") -> DataFrame:
    """The rows of ``docs`` with each run of found spans replaced by ``mask``; all other columns,
    and texts without findings (null too), stay as they are."""
    found = scan_history(docs, None, rules, path_col, text_col)[1].where(F.size("spans") > 0)
    # by path and blob: the copies of a text, found in or not, are spread over their paths
    at = found.select(F.col("path").alias("_path"), "blob").distinct()
    cuts = attach_by_key(at.withColumn("_row", F.xxhash64("_path", "blob")), islands(found), "blob", "copies", "_row") \
        .select("_path", F.col("blob").alias("_found"), F.col("cuts").alias("_cuts"))
    keyed = packed(docs, docs[path_col].alias("path"), F.sha2(F.coalesce(docs[text_col].cast("string"), F.lit("")), 256).alias("blob"))
    marked = keyed.join(cuts, F.col("path").eqNullSafe(F.col("_path")) & (F.col("blob") == F.col("_found")), "left")
    text = F.col("row")[text_col]
    whole = F.coalesce(text.cast("string"), F.lit(""))

    def rebuilt(found: Column) -> Column:
        def piece(cut: Column, i: Column) -> Column:
            done = F.when(i == 0, F.lit(0)).otherwise(F.get(found, i - 1)["end"])
            return F.concat(F.substring(whole, done + 1, cut["start"] - done), F.lit(mask))
        tail = F.substring(whole, F.element_at(found, -1)["end"] + 1, F.length(whole))
        return F.concat(F.array_join(F.transform(found, piece), ""), tail)

    redacted = F.when(F.col("_cuts").isNull(), text).otherwise(bind(F.col("_cuts"), rebuilt))
    return unpacked(marked, docs.columns, **{text_col: redacted})
