"""Dates that people write, as column expressions. "Present" is the explicit date `as_of`."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sieverank.functions import literals

MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def _month(word: Column) -> Column:
    """1 to 12 by the first three letters, else null."""
    at = F.array_position(literals.array(MONTHS), F.substring(F.lower(word), 1, 3))
    return F.nullif(at.cast("int"), F.lit(0))


def _date(year: Column, month: Column, day: Column) -> Column:
    """Null outside 1900 to 2100 and outside the calendar's months; days above 28 become 28."""
    ok = year.between(1900, 2100) & month.between(1, 12) & (day >= 1)
    return F.when(ok, F.make_date(F.when(ok, year), F.when(ok, month), F.when(ok, F.least(day, F.lit(28)))))


def parse_date(x: Column, as_of: Column) -> Column:
    """The first form that applies: words for now; D Month Y; Month Y; Mon.Y; Mon'YY; Mon-YY(YY); D/M/Y or M/D/Y; M/Y;
    Y/M; a year alone (its first of June). Forms need only match at the start, a year alone must be all."""
    d = F.regexp_replace(x, r"^\s+|\s+$", "")
    low = F.lower(d)

    def group(pattern: str, i: int) -> Column:
        return F.regexp_extract(d, pattern, i)

    def number(pattern: str, i: int) -> Column:
        return F.nullif(group(pattern, i), F.lit("")).cast("int")

    def full_year(y: Column) -> Column:
        return F.when(y >= 100, y).when(y <= 40, y + 2000).otherwise(y + 1900)

    one = F.lit(1)
    p1, p2, p3 = r"^(\d{1,2})\s+(\w+)\s+(\d{4})", r"^(\w+)\.?\s+(\d{4})", r"^(\w+)\.(\d{4})"
    p4, p5 = r"^(\w+)'(\d{2})", r"^(\w+)-(\d{2,4})"
    p6, p7, p8, p9 = r"^(\d{1,2})[/\-](\d{1,2})[/\-](\d{4})", r"^(\d{1,2})[/\-.](\d{4})", r"^(\d{4})/(\d{1,2})", r"^(\d{4})$"
    a, b = number(p6, 1), number(p6, 2)
    day_first = (a > 12) & b.between(1, 12)
    return F.when(low.isin("present", "current", "now", "ongoing") | low.startswith("till") | low.startswith("to date"), as_of).otherwise(
        F.coalesce(
            _date(number(p1, 3), _month(group(p1, 2)), number(p1, 1)),
            _date(number(p2, 2), F.coalesce(_month(group(p2, 1)), one), one),
            _date(number(p3, 2), _month(group(p3, 1)), one),
            _date(full_year(number(p4, 2)), F.coalesce(_month(group(p4, 1)), one), one),
            _date(full_year(number(p5, 2)), _month(group(p5, 1)), one),
            _date(number(p6, 3), F.when(day_first, b).otherwise(a), F.when(day_first, a).otherwise(b)),
            _date(number(p7, 2), number(p7, 1), one),
            _date(number(p8, 1), number(p8, 2), one),
            _date(number(p9, 1), F.lit(6), one),
        )
    )


def years_between(start: Column, end: Column) -> Column:
    return F.datediff(end, start) / F.lit(365.25)


def recency_score(last: Column, any_entry: Column, as_of: Column) -> Column:
    """100, 85, 60 or 30 by the years since the last end; 50 for entries without dates, 20 without entries."""
    ago = years_between(last, as_of)
    dated = F.when(ago <= 0.5, 100.0).when(ago <= 2, 85.0).when(ago <= 5, 60.0).otherwise(30.0)
    return F.when(last.isNotNull(), dated).when(any_entry, 50.0).otherwise(20.0)
