"""Array columns: running sums and spans of matches."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column, f) -> Column:
    """f(value) with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def running(steps: Column) -> Column:
    """Running sums of an array of longs, in time n ** 1.5.

    Blocks of about sqrt(n) steps are summed on their own, then shifted by the blocks
    before them: growing one array step by step would cost n ** 2.
    """
    none = F.array().cast("array<bigint>")
    last = lambda a: F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0).cast("bigint"))
    grow = lambda xs: F.aggregate(xs, none, lambda a, x: F.concat(a, F.array(last(a) + x)))

    def made(s: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(s))).cast("int")
        blocks = F.transform(F.sequence(F.lit(1), F.size(s), width), lambda at: grow(F.slice(s, at, width)))
        shifted = lambda bs: F.zip_with(bs, grow(F.transform(bs, last)), lambda b, upto: F.transform(b, lambda x: x + upto - last(b)))
        return once(blocks, lambda bs: F.flatten(shifted(bs)))

    return F.when(F.size(steps) > 0, once(steps, made)).otherwise(none)


SPANS = "array<struct<start:bigint,end:bigint,word:string>>"


def spans(text: Column, pattern: str) -> Column:
    """Non-overlapping matches of a regular expression: (start, end, word), ends exclusive."""
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)

    def placed(s: Column) -> Column:
        steps = F.zip_with(F.slice(s["gaps"], F.lit(1), F.size(s["found"])), s["found"], lambda g, w: (F.length(g) + F.length(w)).cast("bigint"))
        return F.zip_with(running(steps), s["found"], lambda e, w: F.struct((e - F.length(w)).cast("bigint").alias("start"), e.alias("end"), w.alias("word")))

    made = once(F.struct(gaps.alias("gaps"), found.alias("found")), placed).cast(SPANS)
    return F.when(text.rlike(pattern), made).otherwise(F.array().cast(SPANS))


def occurrences(text: Column, words: str) -> Column:
    """At every place where the expression ``words`` matches, overlapping or not: (start, end, word).

    A look-ahead matches without consuming, so the pieces between its matches give the
    places; a leading blank keeps a match at the very start from being swallowed by split.
    """
    ahead = f"(?={words})"
    padded = F.concat(F.lit(" "), text)
    found, pieces = F.regexp_extract_all(padded, F.lit(f"(?=({words}))"), F.lit(1)), F.split(padded, ahead, -1)

    def placed(s: Column) -> Column:
        starts = running(F.transform(F.slice(s["pieces"], F.lit(1), F.size(s["found"])), lambda p: F.length(p).cast("bigint")))
        return F.zip_with(starts, s["found"], lambda at, w: F.struct((at - 1).alias("start"), (at - 1 + F.length(w)).alias("end"), w.alias("word")))

    made = once(F.struct(pieces.alias("pieces"), found.alias("found")), placed).cast(SPANS)
    return F.when(text.rlike(words), made).otherwise(F.array().cast(SPANS))
