"""As-of, interval, calendar and range joins built from unions and windows.

A union sorted by time inside each entity needs one shuffle on the entity, where a
non-equi join would compare every pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def _union(left: DataFrame, right: DataFrame, keys: list[str], left_on: str, right_on: str, payload: list[str], right_first: bool) -> DataFrame:
    a = left.select(F.struct("*").alias("__row"), F.lit(None).cast(right.select(F.struct(right_on, *payload)).schema[0].dataType).alias("__hit"), *keys, F.col(left_on).alias("__t"), F.lit(1 if right_first else 0).alias("__side"))
    b = right.select(F.lit(None).cast(left.select(F.struct("*")).schema[0].dataType).alias("__row"), F.struct(right_on, *payload).alias("__hit"), *keys, F.col(right_on).alias("__t"), F.lit(0 if right_first else 1).alias("__side"))
    return a.unionByName(b)


def backward(left: DataFrame, right: DataFrame, keys: list[str], left_on: str, right_on: str, payload: list[str], strict: bool = True, tie: str | None = None) -> DataFrame:
    """Each left row with the latest right row before it (or at it, if not strict).

    Right rows of one time are ordered by ``tie``, the last wins.
    """
    u = _union(left, right, keys, left_on, right_on, payload, right_first=not strict)
    order = ["__t", "__side", *([F.col(f"__hit.{tie}")] if tie else [])]
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    found = u.withColumn("__found", F.last("__hit", ignorenulls=True).over(w)).where("__row IS NOT NULL")
    return found.select("__row.*", *[F.col(f"__found.{c}").alias(c) for c in [right_on, *payload] if c not in left.columns])


def forward(left: DataFrame, right: DataFrame, keys: list[str], left_on: str, right_on: str, payload: list[str], strict: bool = True) -> DataFrame:
    """Each left row with the first right row after it (or at it, if not strict)."""
    u = _union(left, right, keys, left_on, right_on, payload, right_first=strict)
    # Read backwards in time, so that the frame only grows; one that shrinks is recomputed for every row.
    w = Window.partitionBy(*keys).orderBy(F.desc("__t"), F.desc("__side")).rowsBetween(Window.unboundedPreceding, 0)
    found = u.withColumn("__found", F.last("__hit", ignorenulls=True).over(w)).where("__row IS NOT NULL")
    return found.select("__row.*", *[F.col(f"__found.{c}").alias(c) for c in [right_on, *payload] if c not in left.columns])


def valid_at(left: DataFrame, spans: DataFrame, keys: list[str], at: str, start: str, end: str, value: str, default: str | None = None) -> DataFrame:
    """The value of the span that holds ``at`` (start <= at < end; an open end never ends).

    Of the spans that hold it the one that starts last wins, also where spans nest or
    overlap; of equal starts the greatest end, then the greatest value.  Without a span the
    value is ``default`` (a column of left).  Nested spans are
    first cut at every start and end of their key into pieces of one value (``flatten``), so
    that the lookup stays an as-of join.
    """
    pieces = flatten(spans, keys, start, end, value)
    found = backward(left, pieces, keys, at, "__from", ["__open", value], strict=False)
    out = F.when(F.col("__open"), F.col(value))
    return found.withColumn(value, F.coalesce(out, F.col(default)) if default else out).drop("__from", "__open")


def flatten(spans: DataFrame, keys: list[str], start: str, end: str, value: str) -> DataFrame:
    """(keys, __from, __open, value): what holds from each start or end of a key's spans on.

    A span that ends falls back to the latest one before it that is still open: every end is
    matched with the spans of its key that hold it.  Spans of a key are few (a validity
    history), and only those that end inside another are looked at.
    """
    s = spans.select(*keys, F.col(start).alias("__s"), F.col(end).alias("__e"), F.col(value).alias(value)).where("__s IS NOT NULL AND (__e IS NULL OR __e > __s)")
    # Of equal starts the greatest end wins, of equal ends the greatest value; an open end is the greatest.
    s = s.groupBy(*keys, "__s").agg(F.max_by(F.struct("__e", value), F.struct(F.coalesce(F.col("__e").cast("timestamp"), F.lit("9999-12-31").cast("timestamp")), F.col(value), F.col("__e").isNull())).alias("__v")).select(*keys, "__s", F.col("__v.__e").alias("__e"), F.col(f"__v.{value}").alias(value))
    ends = s.where("__e IS NOT NULL").select(*keys, F.col("__e").alias("__from")).distinct().join(s.select(*keys, F.col("__s").alias("__from")), [*keys, "__from"], "left_anti")
    over = ends.alias("x").join(s.alias("y"), [F.col(f"x.{k}") == F.col(f"y.{k}") for k in keys] + [F.col("y.__s") < F.col("x.__from"), F.col("y.__e").isNull() | (F.col("y.__e") > F.col("x.__from"))])
    back = over.groupBy(*[F.col(f"x.{k}").alias(k) for k in keys], F.col("x.__from").alias("__from")).agg(F.max_by(f"y.{value}", "y.__s").alias(value), F.lit(True).alias("__open"))
    closed = ends.join(back, [*keys, "__from"], "left").withColumn("__open", F.coalesce("__open", F.lit(False)))
    opened = s.select(*keys, F.col("__s").alias("__from"), F.lit(True).alias("__open"), value)
    return opened.unionByName(closed.select(*opened.columns))


def calendar_bounds(days: DataFrame, day: str = "date") -> DataFrame:
    """First and last trading day of every week, and how many there are."""
    from ..functions.timeops import week_of

    return days.select(F.col(day).alias("d")).distinct().groupBy(week_of(F.col("d")).alias("week")).agg(F.min("d").alias("first_date"), F.max("d").alias("last_date"), F.count(F.lit(1)).alias("n_days"))


def range_first_last(ranges: DataFrame, daily: DataFrame, key: str, start: str, end: str, open_col: str = "adj_open", close_col: str = "adj_close", date: str = "date") -> DataFrame:
    """Holding return over [start, end] of each distinct (key, start, end).

    First row's open to last row's close by row (nulls are not skipped); null if either
    is missing or the open is not positive.  Both ends are as-of lookups, so no range join
    is needed.
    """
    spans = ranges.select(key, start, end).distinct()
    rows = daily.select(key, F.col(date).alias("__d"), F.struct(open_col).alias("__o"), F.struct(close_col).alias("__c"))
    first = forward(spans, rows.withColumnRenamed("__d", "__d1"), [key], start, "__d1", ["__o"], strict=False)
    both = backward(first, rows.withColumnRenamed("__d", "__d2"), [key], end, "__d2", ["__c"], strict=False)
    inside = (F.col("__d1") <= F.col(end)) & (F.col("__d2") >= F.col(start))
    o, c = F.col(f"__o.{open_col}"), F.col(f"__c.{close_col}")
    ret = F.when(inside & (o > 0) & c.isNotNull(), c / o - 1)
    return both.select(key, start, end, ret.alias("period_ret"))


#: Levels of blocks of 1, 2, 4, ... rows: enough for a billion rows of one key.
LEVELS = 30


def range_aggregate(ranges: DataFrame, daily: DataFrame, key: str, start: str, end: str, value: str, date: str = "date") -> DataFrame:
    """n, total, least and most of ``value`` over the rows in [start, end] of each distinct (key, start, end); see ``range_aggregates``."""
    out = range_aggregates(ranges, daily, key, start, end, [value], date)
    return out.select(key, start, end, "n", *[F.col(f"{f}_{value}").alias(f) for f in ("total", "least", "most")])


def range_aggregates(ranges: DataFrame, daily: DataFrame, key: str, start: str, end: str, values: list[str], date: str = "date") -> DataFrame:
    """n, and total_, least_ and most_ of each of ``values`` over the rows in [start, end] of each distinct (key, start, end).

    A key's rows are summed up in blocks of 1, 2, 4, ... rows; a range is put together from at
    most two blocks of each size, found by an equi-join, so neither a long range nor many of
    them meet every row.  ``n`` counts rows, the others pass over nulls (no value: null).
    """
    w = Window.partitionBy(key).orderBy(date)
    v = [F.col(c).alias(f"__v{i}") for i, c in enumerate(values)]
    rows = daily.select(key, F.col(date).alias("__d"), *v, (F.row_number().over(w) - 1).cast("bigint").alias("p"))  # a key is one task
    spans = ranges.select(key, start, end).distinct()
    at = rows.groupBy(key, "__d").agg(F.struct(F.min("p").alias("first"), F.max("p").alias("last")).alias("__at"))
    found = forward(spans, at.withColumnRenamed("__d", "__d1").withColumnRenamed("__at", "__f"), [key], start, "__d1", ["__f"], strict=False)
    found = backward(found, at.withColumnRenamed("__d", "__d2").withColumnRenamed("__at", "__l"), [key], end, "__d2", ["__l"], strict=False)
    inside = (F.col("__d1") <= F.col(end)) & (F.col("__d2") >= F.col(start))
    found = found.select(key, start, end, F.when(inside, F.col("__f.first")).alias("i"), F.when(inside, F.col("__l.last") + 1).alias("j"))
    found = cut_lineage(found)
    # Blocks are built up to the size that the longest range can hold.
    longest = found.agg(F.max(F.col("j") - F.col("i"))).first()[0] or 1
    tall = rows.select(key, "p", *[f"__v{i}" for i in range(len(values))], F.explode(F.sequence(F.lit(0), F.lit(max(longest, 1).bit_length() - 1))).alias("h"))
    names = [f"{f}_{c}" for c in values for f in ("total", "least", "most")]
    blocks = tall.groupBy(key, "h", F.expr("shiftright(p, h)").alias("b")).agg(F.count(F.lit(1)).alias("n"), *[f(f"__v{i}").alias(f"{n}_{c}") for i, c in enumerate(values) for n, f in (("total", F.sum), ("least", F.min), ("most", F.max))])

    kind = "array<struct<h:int,b:bigint>>"

    def step(s: Column, h: Column) -> Column:
        low, high = s["l"], s["r"]
        odd_l, odd_r = (low < high) & (low % 2 == 1), (low < high) & (high % 2 == 1)
        taken = lambda odd, b: F.when(odd, F.array(F.struct(h.alias("h"), b.alias("b")))).otherwise(F.array()).cast(kind)
        out = F.concat(s["out"], taken(odd_l, low), taken(odd_r, high - 1))
        return F.struct(F.shiftright(F.when(odd_l, low + 1).otherwise(low), 1).alias("l"), F.shiftright(F.when(odd_r, high - 1).otherwise(high), 1).alias("r"), out.alias("out"))

    state = F.struct(F.col("i").alias("l"), F.col("j").alias("r"), F.array().cast(kind).alias("out"))
    parts = F.aggregate(F.sequence(F.lit(0), F.lit(LEVELS)), state, step, lambda s: s["out"])
    pieces = found.where("i IS NOT NULL AND i < j").select(key, start, end, F.explode(parts).alias("__p")).select(key, start, end, F.col("__p.h").alias("h"), F.col("__p.b").alias("b"))
    sums = pieces.join(blocks, [key, "h", "b"]).groupBy(key, start, end).agg(F.sum("n").alias("n"), *[{"total": F.sum, "least": F.min, "most": F.max}[n.split("_", 1)[0]](n).alias(n) for n in names])
    # A range without its two ends holds no row; one with them holds the row it starts at.
    none = found.where("NOT coalesce(i < j, false)").select(key, start, end, F.lit(0).cast("bigint").alias("n"), *[F.lit(None).cast(dict(sums.dtypes)[c]).alias(c) for c in names])
    return sums.unionByName(none)


def dense_calendar(days: DataFrame, day: str = "date") -> DataFrame:
    """Every date of the calendar's span: d, is_trading, n_upto (sessions to d), next_day (first session after d).

    One row a date, so a few ten thousand for a century: small enough to broadcast.
    """
    own = days.select(F.col(day).cast("date").alias("d")).distinct().withColumn("is_trading", F.lit(True))
    every = own.agg(F.explode(F.sequence(F.min("d"), F.max("d"))).alias("d"))
    w = Window.orderBy("d")
    full = every.join(own, "d", "left").withColumn("is_trading", F.coalesce("is_trading", F.lit(False)))
    later = F.last(F.when(F.col("is_trading"), F.col("d")), ignorenulls=True).over(Window.orderBy(F.desc("d")).rowsBetween(Window.unboundedPreceding, -1))
    return full.select("d", "is_trading", F.sum(F.col("is_trading").cast("int")).over(w).cast("bigint").alias("n_upto"), later.alias("next_day"))


def next_sessions(rows: DataFrame, days: DataFrame, date: str, minute: Column, close: int, day: str = "date") -> DataFrame:
    """``next_day``: the row's own session before its close, else the first session after its date.

    Dates before the calendar go to its first session, dates after it have none.
    """
    dense = dense_calendar(days, day)
    first = days.agg(F.min(F.col(day).cast("date")).alias("__first"))
    out = rows.join(F.broadcast(dense.select(F.col("d").alias(date), F.col("is_trading").alias("__own"), F.col("next_day").alias("__next"))), date, "left").join(F.broadcast(first))
    later = F.when(F.col(date) < F.col("__first"), F.col("__first")).otherwise(F.col("__next"))
    return out.withColumn("next_day", F.when(F.coalesce(F.col("__own") & (minute < close), F.lit(False)), F.col(date)).otherwise(later)).drop("__own", "__next", "__first")


def session_count(ranges: DataFrame, days: DataFrame, start: str, end: str, day: str = "date") -> DataFrame:
    """Trading sessions in [start, end], by the calendar's running count.

    Either date may lie outside the calendar's span: nothing trades before its first
    session or after its last.
    """
    cal = dense_calendar(days, day)
    a = F.broadcast(cal.select(F.col("d").alias(start), (F.col("n_upto") - F.col("is_trading").cast("int")).alias("__before")))
    b = F.broadcast(cal.select(F.col("d").alias(end), F.col("n_upto").alias("__upto")))
    edge = F.broadcast(cal.agg(F.min("d").alias("__lo"), F.max("d").alias("__hi"), F.coalesce(F.max("n_upto"), F.lit(0)).alias("__all")))
    out = ranges.join(a, start, "left").join(b, end, "left").join(edge)
    outside = lambda c, inside: F.when(F.col(c) < F.col("__lo"), 0).when(F.col(c) > F.col("__hi"), F.col("__all")).otherwise(inside)
    n = F.greatest(F.lit(0), outside(end, F.col("__upto")) - outside(start, F.col("__before")))
    return out.withColumn("n_sessions", F.when(F.col(start).isNotNull() & F.col(end).isNotNull(), F.coalesce(n, F.lit(0)).cast("bigint"))).drop("__before", "__upto", "__lo", "__hi", "__all")
