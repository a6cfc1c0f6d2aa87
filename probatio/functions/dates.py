"""Reading dates out of matched text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from probatio.lexicons import MONTHS


def _date(year: Column, month: Column, day: Column) -> Column:
    """NULL for an impossible day, month or year."""
    return F.to_date(F.try_to_timestamp(
        F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(month.cast("string"), 2, "0"),
                    F.lpad(day.cast("string"), 2, "0")), F.lit("yyyy-MM-dd")))


def _month_no(name: Column) -> Column:
    return F.array_position(F.array(*[F.lit(m) for m in MONTHS]),
                            F.lower(F.substring(name, 1, 3))).cast("int")


def _part(raw: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(raw, pattern, group).try_cast("int")


def parse_mention(raw: Column, fmt: Column, pivot: int = 70) -> Column:
    """Date of a mention, month first and day first as the second attempt.

    Two-digit years below ``pivot`` are 20xx, others 19xx. The first three letters of a month
    name decide. Anything impossible gives NULL.
    """
    def part(i: int) -> Column:
        return _part(raw, r"(\d+)[/-](\d+)[/-](\d+)", i)

    a, b, c = part(1), part(2), part(3)
    month_first = F.coalesce(_date(c, a, b), _date(c, b, a))
    short = F.when(c < pivot, c + 2000).otherwise(c + 1900)
    short_first = F.coalesce(_date(short, a, b), _date(short, b, a))
    named = r"([A-Za-z]{3,9})\s+(\d{1,2}),?\s+(\d{4})"
    day_named = r"(\d{1,2})\s+([A-Za-z]{3,9})\s+(\d{4})"
    return (
        F.when(fmt.isin("MM/DD/YYYY", "MM-DD-YYYY"), month_first)
        .when(fmt == "YYYY-MM-DD", _date(a, b, c))
        .when(fmt == "MM/DD/YY", short_first)
        .when(fmt == "Month DD, YYYY", _date(
            _part(raw, named, 3), _month_no(F.regexp_extract(raw, named, 1)), _part(raw, named, 2)))
        .when(fmt == "DD Month YYYY", _date(
            _part(raw, day_named, 3), _month_no(F.regexp_extract(raw, day_named, 2)),
            _part(raw, day_named, 1))))
