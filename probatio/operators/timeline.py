"""Dated mentions, events and timelines (survey section 2.7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from probatio import lexicons as lx
from probatio.functions import text as tx
from probatio.functions.dates import parse_mention
from probatio.operators.categorize import argument_col
from probatio.operators.entities import participants_in
from probatio.operators.scoring import strength_col
from probatio.session import written


# ---- mentions --------------------------------------------------------------------
def date_mentions(ev: DataFrame, window: int = 100, wide: int = 200) -> DataFrame:
    """Every match of the date patterns with position, context and ``nearby``, what lies up to
    ``wide`` characters around its start; one narrow pass.

    Both are cut out before the matches become rows, so no row carries the text. Columns of ``ev``
    other than the text are carried along.
    """
    keep = [c for c in ev.columns if c != "content"]
    # the array is exploded as an expression: of a column Spark would first test the size, and so find all matches again
    return ev.select(*keep, F.explode(mentions_in(F.col("content"), window, wide)).alias("d")).select(*keep, "d.*")


def mention_rows(found: DataFrame) -> DataFrame:
    """Rows of the column ``mentions``, with the other columns of ``found``."""
    keep = [c for c in found.columns if c != "mentions"]
    return found.select(*keep, F.explode("mentions").alias("d")).select(*keep, "d.*")


def mentions_in(text: Column, window: int = 100, wide: int = 200) -> Column:
    """The mentions of one text as an array, null if there are none."""
    def found_by(fmt: str, pattern: str, conf: float) -> Column:
        sign, hint = lx.DATE_HINTS[fmt]
        may = F.contains(text, F.lit(sign)) & F.rlike(text, F.lit(hint)) if sign else F.rlike(text, F.lit(hint))
        found = F.transform(tx.match_positions(text, pattern), lambda m: F.struct(
            m["start"].alias("position"), m["raw"].alias("raw_date"), F.lit(fmt).alias("format"),
            F.lit(conf).alias("confidence")))
        return F.when(may, found).otherwise(F.array().cast("array<struct<position:int,raw_date:string,format:string,confidence:double>>"))

    def cut(matches: Column) -> Column:
        return tx.bound(tx.segments(text), lambda parts: F.transform(matches, lambda m: F.struct(
            m["position"].alias("position"), m["raw_date"].alias("raw_date"), m["format"].alias("format"), m["confidence"].alias("confidence"),
            tx.around(parts, m["position"], F.length(m["raw_date"]), window).alias("context"),
            tx.around(parts, m["position"], F.lit(0), wide).alias("nearby"))))

    return tx.bound(F.concat(*[found_by(*p) for p in lx.DATE_PATTERNS]), lambda ms: F.when(F.size(ms) > 0, cut(ms)))


def date_parse(mentions: DataFrame, pivot: int = 70) -> DataFrame:
    """The date of each mention; impossible dates are dropped."""
    return mentions.withColumn("event_date", parse_mention(
        F.col("raw_date"), F.col("format"), pivot)).where(F.col("event_date").isNotNull())


def mention_dedup(parsed: DataFrame) -> DataFrame:
    """One row per file, date and position."""
    return parsed.groupBy("doc_id", "event_date", "position").agg(
        F.min_by("raw_date", "format").alias("raw_date"))


# ---- events ----------------------------------------------------------------------
EVENT_COLUMNS = ["doc_id", "file_path", "position", "format", "event_date", "date_confidence", "event_type",
                 "argument", "title", "description", "participants", "evidence_strength"]


def _event_types(lower: Column) -> Column:
    return F.array_compact(F.array(*[
        F.when(F.rlike(lower, F.lit("|".join(patterns))), F.lit(kind))
        for kind, patterns in lx.EVENT_PATTERNS.items()]))


def pattern_events(parsed: DataFrame) -> DataFrame:
    """Up to one event per mention and event type, where the context fits its patterns.

    ``parsed`` carries nearby, file_path and folder. The few rules are literal expressions, so
    events come out of the same narrow pass as the mentions.
    """
    parsed = parsed.withColumn("_lower", F.lower("context"))
    rows = (parsed.withColumn("description", tx.strip(F.col("nearby"))).withColumn("event_type", F.explode(_event_types(F.col("_lower"))))
            .withColumn("participants", participants_in(F.col("description"))))
    return rows.select(
        "doc_id", "file_path", F.col("position").cast("bigint").alias("position"), "format", "event_date",
        F.col("confidence").alias("date_confidence"), "event_type", argument_col(F.col("folder")).alias("argument"),
        F.concat(F.initcap("event_type"), F.lit(" Event")).alias("title"), "description", "participants",
        strength_col(F.col("description"), F.col("event_type")).alias("evidence_strength"))


def _metadata() -> Column:
    """The entries of T05 of one file as an array."""
    def event(label: str, verb: str, ts: str, strength: float, no: int) -> Column:
        return F.struct(
            F.lit(-no).cast("bigint").alias("position"), F.to_date(ts).alias("event_date"),
            F.concat(F.lit(f"Document {label}: "), "file_name").alias("title"),
            F.concat(F.lit(f"File {verb}: "), "file_type", F.lit(" document")).alias("description"),
            F.lit(strength).alias("evidence_strength"))

    created = F.when(F.col("created_ts").isNotNull(), event("Created", "created", "created_ts", 0.3, 2))
    modified = F.when(F.col("created_ts") != F.col("modified_ts"),
                      event("Modified", "last modified", "modified_ts", 0.4, 1))
    return F.array_compact(F.array(created, modified))


def metadata_events(categorised: DataFrame) -> DataFrame:
    """A Created event per file, and a Modified event if that time differs."""
    rows = categorised.withColumn("e", F.explode(_metadata()))
    return rows.select(
        "doc_id", "file_path", "e.position", F.lit("metadata").alias("format"), "e.event_date",
        F.lit(0.9).alias("date_confidence"), F.lit("document").alias("event_type"),
        argument_col(F.col("folder")).alias("argument"), "e.title", "e.description",
        F.array().cast("array<string>").alias("participants"), "e.evidence_strength")


_MENTION = "struct<position:int,raw_date:string,format:string,confidence:double,context:string,nearby:string>"
_ENTRY = "struct<position:bigint,event_date:date,title:string,description:string,evidence_strength:double>"


def timeline_events(categorised: DataFrame) -> DataFrame:
    """All events of a corpus: T01, T02, T04 and T05 in one table and one pass over the texts.

    Mentions and metadata of a file are entries of one array, exploded as an expression: of a column Spark would
    first test the size, and so find all matches again.
    """
    mentions = F.transform(mentions_in(F.col("content")), lambda m: F.struct(
        m.cast(_MENTION).alias("m"), F.lit(None).cast(_ENTRY).alias("e")))
    entries = F.transform(_metadata(), lambda e: F.struct(F.lit(None).cast(_MENTION).alias("m"), e.cast(_ENTRY).alias("e")))
    both = F.concat(F.coalesce(mentions, F.array().cast(f"array<struct<m:{_MENTION},e:{_ENTRY}>>")), entries)
    rows = categorised.select("doc_id", "file_path", "folder", F.explode(both).alias("x")).select("doc_id", "file_path", "folder", "x.m.*", "x.e")
    meta = F.col("e").isNotNull()
    rows = rows.withColumn("event_date", F.when(meta, F.col("e.event_date")).otherwise(parse_mention(F.col("raw_date"), F.col("format")))) \
        .where("event_date IS NOT NULL").withColumn("description", F.when(meta, F.col("e.description")).otherwise(tx.strip(F.col("nearby")))) \
        .withColumn("event_type", F.explode(F.when(meta, F.array(F.lit("document"))).otherwise(_event_types(F.lower("context")))))

    def either(entry: str | Column, mention: Column) -> Column:
        return F.when(meta, entry if isinstance(entry, Column) else F.col(f"e.{entry}")).otherwise(mention)

    return rows.select(
        "doc_id", "file_path", either("position", F.col("position").cast("bigint")).alias("position"),
        either(F.lit("metadata"), F.col("format")).alias("format"), "event_date", either(F.lit(0.9), F.col("confidence")).alias("date_confidence"),
        "event_type", argument_col(F.col("folder")).alias("argument"),
        either("title", F.concat(F.initcap("event_type"), F.lit(" Event"))).alias("title"), "description",
        either(F.array().cast("array<string>"), participants_in(F.col("description"))).alias("participants"),
        either("evidence_strength", strength_col(F.col("description"), F.col("event_type"))).alias("evidence_strength"))


def fact_events(facts: DataFrame) -> DataFrame:
    """The same where the mentions of each file have been found before."""
    mentions = mention_rows(facts.select("doc_id", "file_path", "folder", "mentions"))
    return pattern_events(date_parse(mentions)).select(*EVENT_COLUMNS) \
        .unionByName(metadata_events(facts).select(*EVENT_COLUMNS))


# ---- timelines -------------------------------------------------------------------
def _timeline_id(argument: Column) -> Column:
    return F.concat(F.lit("timeline_"), F.replace(F.lower(argument), F.lit(" "), F.lit("_")))


_TIMELINE = lambda: [F.min("event_date").alias("start_date"), F.max("event_date").alias("end_date"),
                     F.count("*").alias("total_events"), F.avg("evidence_strength").alias("strength_score")]


def argument_timelines(events: DataFrame) -> DataFrame:
    """Range, size and mean strength per argument (partial aggregation; events stay rows)."""
    return events.groupBy("argument").agg(*_TIMELINE()).withColumn("timeline_id", _timeline_id(F.col("argument")))


def master_timeline(events: DataFrame) -> DataFrame:
    """The same with a row for all arguments together."""
    out = events.rollup("argument").agg(F.grouping_id().alias("_g"), *_TIMELINE()) \
        .withColumn("argument", F.when(F.col("_g") == 1, lx.MASTER_TIMELINE).otherwise(F.col("argument"))).drop("_g")
    return out.where("total_events > 0").withColumn("timeline_id", _timeline_id(F.col("argument")))


def repeated_types(events: DataFrame, at_least: int = 3) -> DataFrame:
    """Event types that recur within an argument."""
    return events.groupBy("argument", "event_type").agg(F.count("*").alias("occurrences")) \
        .where(F.col("occurrences") >= at_least)


def escalation(events: DataFrame, kind: str = "abuse") -> DataFrame:
    """Do the events of a kind end stronger than they began? (two or more needed)"""
    order = F.struct("event_date", "doc_id", "position", "format")
    return (events.where(F.col("event_type") == kind).groupBy("argument")
            .agg(F.count("*").alias("events"), F.min_by("evidence_strength", order).alias("first_strength"),
                 F.max_by("evidence_strength", order).alias("last_strength"))
            .where("events >= 2").withColumn("escalating", F.col("last_strength") > F.col("first_strength")))


def date_clusters(events: DataFrame, gap_days: int = 30, keep: int = 2, report: int = 3) -> DataFrame:
    """Runs of dates at most ``gap_days`` apart, per argument.

    Events are counted per date first; the window then sees at most one row per calendar day,
    however many events there are.
    """
    days = events.groupBy("argument", "event_date").agg(F.count("*").alias("n"))
    w = Window.partitionBy("argument").orderBy("event_date")
    gap = F.datediff("event_date", F.lag("event_date").over(w))
    runs = days.withColumn("new", F.when(gap <= gap_days, 0).otherwise(1)) \
        .withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    clusters = (runs.groupBy("argument", "run").agg(
        F.min("event_date").alias("start_date"), F.max("event_date").alias("end_date"), F.sum("n").alias("events"))
        .where(F.col("events") >= keep))
    return clusters.select(
        "argument", F.row_number().over(Window.partitionBy("argument").orderBy("run")).alias("cluster_no"),
        "start_date", "end_date", "events", (F.col("events") >= report).alias("reported"),
        F.date_format("start_date", "MMMM yyyy").alias("label"))


HIGH_STRENGTH = 0.8


def _critical_reason(busy: int) -> Column:
    return F.when(F.col("event_count") >= busy, "High activity period") \
        .when(F.col("_top") >= HIGH_STRENGTH, "High-strength evidence period")


def critical_periods(events: DataFrame, busy: int = 3) -> DataFrame:
    """Months with many events, or else with strong ones. Titles: :func:`critical_titles`."""
    months = events.withColumn("month", F.date_format("event_date", "yyyy-MM")).groupBy("argument", "month").agg(
        F.count("*").alias("event_count"), F.avg("evidence_strength").alias("average_strength"),
        F.max("evidence_strength").alias("_top"))
    return months.withColumn("reason", _critical_reason(busy)).where("reason IS NOT NULL").drop("_top")


def critical_titles(events: DataFrame, busy: int = 3) -> DataFrame:
    """Titles of the events of each critical month as rows with counts, never one long list.

    A month picked for strength only lists its strong events. Months are sums over the written titles, so
    the texts behind the events are read once; the side joined has one row per argument and month.
    """
    titles = written(events.withColumn("month", F.date_format("event_date", "yyyy-MM")).groupBy("argument", "month", "title").agg(
        F.count("*").alias("n"), F.count_if(F.col("evidence_strength") >= HIGH_STRENGTH).alias("strong"),
        F.max("evidence_strength").alias("top")), "titles")
    months = titles.groupBy("argument", "month").agg(F.sum("n").alias("event_count"), F.max("top").alias("_top"))
    picked = months.withColumn("reason", _critical_reason(busy)).where("reason IS NOT NULL").select("argument", "month", "reason")
    shown = F.when(F.col("reason") == "High activity period", F.col("n")).otherwise(F.col("strong"))
    return titles.join(picked, ["argument", "month"]).withColumn("events", shown).where("events > 0") \
        .select("argument", "month", "title", "events")


def timeline_viz(events: DataFrame) -> DataFrame:
    """Chart rows of dated events."""
    from probatio.operators.projections import prefix
    return events.where("event_date IS NOT NULL").select(
        "argument", "doc_id", "event_date", "title", F.col("event_type").alias("type"),
        F.col("evidence_strength").alias("strength"), prefix(F.col("description"), 100).alias("description"))


def timeline_summary(timelines: DataFrame) -> DataFrame:
    """Over all timelines, the master included; and without it."""
    own = F.col("argument") != lx.MASTER_TIMELINE
    return timelines.agg(
        F.count("*").alias("timelines"), F.sum("total_events").alias("total_events"),
        F.avg("strength_score").alias("average_strength"), F.count_if(own).alias("argument_timelines"),
        F.sum(F.when(own, F.col("total_events"))).alias("argument_events"))


def timeline_stats(events: DataFrame) -> DataFrame:
    """Events per type with mean confidence and range; one row for all types."""
    return events.rollup("event_type").agg(
        F.grouping_id().alias("_g"), F.count("*").alias("events"), F.avg("date_confidence").alias("average_confidence"),
        F.min("event_date").alias("earliest"), F.max("event_date").alias("latest")) \
        .withColumn("event_type", F.when(F.col("_g") == 1, "all").otherwise(F.col("event_type"))).drop("_g")


def first_events(events: DataFrame, n: int = 10) -> DataFrame:
    """The earliest events (a top-k, no full sort)."""
    return events.orderBy("event_date", "doc_id", "position", "format", "event_type").limit(n) \
        .select("event_date", "doc_id", "position", "event_type", "title")


def timeline_listing(events: DataFrame) -> DataFrame:
    """The lines of the chronological listing; the first event of a year carries its heading.

    Sort by ``event_date, doc_id, position, format, event_type`` to print. The firsts are at most one
    row for each of the 10,000 years a date can have, so they are broadcast.
    """
    place = F.struct("event_date", "doc_id", "position", "format", "event_type")
    rows = written(events.select("event_date", "doc_id", "position", "format", "event_type", "file_path", "description", "date_confidence"), "events")
    firsts = rows.groupBy(F.year("event_date").alias("year")).agg(F.min(place).alias("first"))
    heading = F.when(place == F.col("first"), F.concat(F.lit("=== "), F.col("year").cast("string"), F.lit(" ==="))).otherwise("")
    return rows.withColumn("year", F.year("event_date")).join(F.broadcast(firsts), "year").select(
        heading.alias("heading"), F.date_format("event_date", "MMMM dd, yyyy").alias("date"), "doc_id", "position", "format",
        F.initcap(F.replace("event_type", F.lit("_"), F.lit(" "))).alias("type"), "file_path", "description", "date_confidence")


def events_by_year(events: DataFrame) -> DataFrame:
    """Events per year; sort by year, date for the listing under year headings."""
    return events.groupBy(F.year("event_date").alias("year")).agg(
        F.count("*").alias("events"), F.min("event_date").alias("first_date"), F.max("event_date").alias("last_date"))
