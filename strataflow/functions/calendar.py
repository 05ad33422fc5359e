"""Calendar time: civil dates against a numeric axis with an origin and a unit; no time zones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Days in a unit of time, in the Gregorian average.
DAYS_PER_UNIT = {"days": 1.0, "weeks": 7.0, "months": 365.2425 / 12, "years": 365.2425}
_ISO = r"^\d{4}-\d{2}-\d{2}(\.\d+)?$"


def to_internal(date: Column, origin: str, unit: str = "days") -> Column:
    """Units from the origin to a date."""
    return F.datediff(date, F.lit(origin).cast("date")).cast("double") / DAYS_PER_UNIT[unit]


def to_date(t: Column, origin: str, unit: str = "days") -> Column:
    """The civil date that an internal time lies in."""
    return F.date_add(F.lit(origin).cast("date"), F.floor(t * DAYS_PER_UNIT[unit] + 1e-9).cast("int"))


def parse_iso(text: Column, origin: str, unit: str = "days") -> Column:
    """Internal time of ``YYYY-MM-DD`` with an optional fraction of a day; anything else, zones included, is missing."""
    day = F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd")
    part = F.coalesce(F.concat(F.lit("0"), F.nullif(F.substring(text, 11, 40), F.lit(""))).try_cast("double"), F.lit(0.0))
    days = F.datediff(day, F.lit(origin).cast("date")) + part
    return F.when(text.rlike(_ISO), days / DAYS_PER_UNIT[unit])


def time_column_kind(df: DataFrame, column: str) -> DataFrame:
    """One row: how many cells are numbers, ISO dates or neither, and the kind (``number``, ``date`` or ``mixed``)."""
    c = F.col(column).cast("string")
    number, date = c.try_cast("double").isNotNull(), c.rlike(_ISO)
    out = df.agg(F.count_if(number & ~date).alias("n_number"), F.count_if(date).alias("n_date"), F.count_if(c.isNotNull() & ~number & ~date).alias("n_other"))
    kind = F.when(F.col("n_other") > 0, "mixed").when((F.col("n_number") > 0) & (F.col("n_date") > 0), "mixed").when(F.col("n_date") > 0, "date").otherwise("number")
    return out.withColumn("kind", kind)


def add_months(date: Column, n: int) -> Column:
    """Calendar months; the day is clamped to the end of the month."""
    return F.add_months(date, n)


def add_years(date: Column, n: int) -> Column:
    return F.add_months(date, 12 * n)


def date_range(start: Column, end: Column | None = None, count: int | None = None, days: int | None = None, months: int | None = None, years: int | None = None, inclusive_end: bool = True) -> Column:
    """Array of dates; entry i is counted from the start.  ``count`` = N gives N + 1 entries.

    An ``end`` on the cadence is an entry unless ``inclusive_end`` is off; one off the cadence never is.  An end before the
    start gives no entry, and a null date a null array.
    """
    if sum(x is not None for x in (days, months, years)) != 1 or (end is None) == (count is None):
        raise ValueError("give one of days, months and years, and an end or a count")
    if years is not None:
        months = 12 * years
    n = days if days is not None else months
    if n <= 0 or (count is not None and count < 1):
        raise ValueError("the cadence and the count must be positive")
    step = F.make_dt_interval(days=F.lit(n)) if days is not None else F.make_ym_interval(months=F.lit(n))
    if count is not None:
        return F.transform(F.sequence(F.lit(0), F.lit(count)), lambda i: F.date_add(start, i * n) if days is not None else F.add_months(start, i * n))
    out = F.when(start <= end, F.sequence(start, end, step)).when(start > end, F.array().cast("array<date>"))
    return out if inclusive_end else F.filter(out, lambda d: d < end)


def anchors(df: DataFrame, by: list[str], time: str, before: float = 0.0, after: float = 0.0) -> DataFrame:
    """First and last observed time per group, moved by offsets."""
    return df.groupBy(*by).agg((F.min(time) - before).alias("first_obs"), (F.max(time) + after).alias("last_obs"))


def render(t: Column, origin: str, unit: str = "days", decimals: int = 6) -> Column:
    """Date text of an internal time; a fraction of a day follows, with trailing zeros cut."""
    days = F.round(t * DAYS_PER_UNIT[unit], decimals)
    whole = F.floor(days)
    rest = F.regexp_replace(F.format_string(f"%.{decimals}f", days - whole), r"^0|\.?0+$", "")
    return F.concat(F.date_format(F.date_add(F.lit(origin).cast("date"), whole.cast("int")), "yyyy-MM-dd"), rest)
