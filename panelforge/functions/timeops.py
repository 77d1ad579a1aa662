"""Date and time columns: Sunday-ending weeks, sessions, point-in-time dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Minutes of the trading session: from 09:00, before 13:30.
OPEN_MINUTE, CLOSE_MINUTE = 540, 810


def week_of(d: Column) -> Column:
    """The Sunday that ends the week of ``d``."""
    return F.next_day(F.date_sub(d, 1), "SUN")


def return_week(week: Column) -> Column:
    return F.date_add(week, 7)


def as_of(week: Column) -> Column:
    """The Monday on which the features of a week are known."""
    return F.date_add(week, 1)


def feature_week(at: Column) -> Column:
    """Inverse of :func:`as_of`; null unless ``at`` is a Monday."""
    return F.when(F.weekday(at) == 0, F.date_sub(at, 1))


def latest_feature_week(at: Column) -> Column:
    """The last week that ended before ``at``."""
    return F.date_sub(week_of(at), 7)


def available_at(end: Column) -> Column:
    """A label can be used from the day after its last day."""
    return F.date_add(end, 1)


def minute_of_day(ts: Column) -> Column:
    return F.hour(ts) * 60 + F.minute(ts)


def is_weekend(d: Column) -> Column:
    return F.weekday(d) >= 5


def calendar_window(d: Column) -> Column:
    return F.when(is_weekend(d), "weekend").otherwise("weekday")


def session_window(ts: Column, is_trading_day: Column) -> Column:
    inside = F.coalesce(is_trading_day, F.lit(False)) & minute_of_day(ts).between(OPEN_MINUTE, CLOSE_MINUTE - 1)
    return F.when(inside, "intraday").otherwise("non_trading")


def roc_date(s: Column) -> Column:
    """Dates of the Minguo calendar (year + 1911) and plain yyyymmdd; null if neither."""
    parts = [F.regexp_extract(s, r"^\s*(\d{2,3})[年/](\d{1,2})[月/](\d{1,2})日?\s*$", i) for i in (1, 2, 3)]
    flat7 = F.regexp_extract(s, r"^\s*(\d{3})(\d{2})(\d{2})\s*$", 1)
    joined = F.when(flat7 != "", F.concat((F.try_to_number(flat7, F.lit("999")) + 1911).cast("int").cast("string"), F.lit("-"), F.regexp_extract(s, r"^\s*(\d{3})(\d{2})(\d{2})\s*$", 2), F.lit("-"), F.regexp_extract(s, r"^\s*(\d{3})(\d{2})(\d{2})\s*$", 3)))
    joined = joined.when(parts[0] != "", F.concat((parts[0].try_cast("int") + 1911).cast("string"), F.lit("-"), F.lpad(parts[1], 2, "0"), F.lit("-"), F.lpad(parts[2], 2, "0")))
    eight = r"^\s*(\d{4})(\d{2})(\d{2})\s*$"
    joined = joined.when(F.regexp_extract(s, eight, 1) != "", F.concat_ws("-", *[F.regexp_extract(s, eight, i) for i in (1, 2, 3)]))
    return joined.try_cast("date")


def first_monday(year: Column) -> Column:
    """First Monday on or after January 1st."""
    return F.next_day(F.date_sub(F.make_date(year, F.lit(1), F.lit(1)), 1), "MON")


def age_years(listed: Column, at: Column) -> Column:
    return F.datediff(at, listed) / 365.25


def epoch_local(seconds: Column, zone: str = "Asia/Taipei") -> Column:
    """Epoch seconds as a naive local timestamp."""
    return F.from_utc_timestamp(F.timestamp_seconds(seconds), zone).cast("timestamp_ntz")


def weeks_between(first: Column, last: Column) -> Column:
    """Array of week labels from ``first`` to ``last``."""
    return F.sequence(first, last, F.expr("interval 7 days"))
