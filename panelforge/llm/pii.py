"""PII: format-preserving Feistel pseudonyms (native).

Personal values are found by pattern, validated, and permuted within their format by
keyed Feistel networks (SHA-256 rounds), so a value is replaced by another valid value
of the same form and equal values get equal pseudonyms in every document:

* card   13-19 digits, Luhn-valid: digits after the first; the check digit is recomputed;
* phone  North American: area, exchange and line within their valid ranges, or within the
         numbers of that form whose area or exchange is not assigned; other international
         numbers: the digits after the first two;
* ssn    ddd-dd-dddd with valid parts, within the valid parts;
* ip     dotted quads of octets up to 255, within all such;
* iban   valid modulo 97: the digits of the account; the check digits are recomputed;
* date   real days from 1900 to 2099 as yyyy-mm-dd, dd.mm.yyyy or mm/dd/yyyy (dd/mm/yyyy
         where only that is a date), within the days that are written alike;
* email  letters and digits before the @, each within its class; signs ahead of the first
         letter or digit (emphasis, list dashes, dots) are not part of it.

What does not validate stays.  Separators stay where they were.  The permutations are
one-to-one for one key, which is a parameter without a default: whoever knows it can undo
them.

Defined cases: null text stays null and empty text empty; very long texts are read whole,
in time n ** 1.5 of the values; repeated rows get the same result; an empty table gives an empty result; columns of any
name may be present.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import once as _let
from ..functions.arrays import running
from .common import feistel, permute_below
from .secrets import DIGIT, LOWER, UPPER

ROUNDS = 8
#: kind -> pattern of a candidate; the first that fits at a place is taken.  Signs before an
#: email's first letter or digit are matched, so that a run is read once, but not of the value.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[._%+-]*+[A-Za-z0-9][A-Za-z0-9._%+-]*+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "ip": r"(?<![\w.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![\w]|\.[0-9])",
    "date": r"(?<![\w./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![\w/-]|\.[0-9])",
    "ssn": r"(?<![\w.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-]|\.[0-9])",
    "phone": r"(?<![\w.+-])(?:\+1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[-.])[0-9]{3}[-. ][0-9]{4}(?![\w-]|\.[0-9])|(?<![\w.+-])\+1[ .-]?[0-9]{3}[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![\w-]|\.[0-9])",
    "intl": r"(?<![\w.+-])\+[2-9][0-9](?:[ .-]?\(?[0-9]{1,5}\)?){2,6}(?![\w-]|\.[0-9])",
    "card": r"(?<![\w.+-])[0-9](?:[ -]?[0-9]){12,18}(?![\w-]|\.[0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
_POWERS = [10**i for i in range(10)]
FIRST, LAST = dt.date(1900, 1, 1), dt.date(2099, 12, 31)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _refill(m: Column, digits: Column) -> Column:
    """``m`` with its digits replaced, in order, by ``digits``."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("used"))

    def step(s: Column, c: Column) -> Column:
        is_digit = c.rlike("^[0-9]$")
        return F.struct(F.concat(s["out"], F.when(is_digit, F.substring(digits, s["used"] + 1, F.lit(1))).otherwise(c)).alias("out"), (s["used"] + is_digit.cast("int")).alias("used"))

    return F.aggregate(F.split(m, ""), start, step, lambda s: s["out"])


def _permute_digits(d: Column, key: str) -> Column:
    """Feistel over strings of up to 18 digits of one length."""
    n = F.length(d)
    powers = F.array(*[F.lit(p).cast("bigint") for p in _POWERS])
    a, b = F.element_at(powers, F.ceil(n / 2).cast("int") + 1), F.element_at(powers, F.floor(n / 2).cast("int") + 1)
    return F.lpad(feistel(d.cast("bigint"), a, b, key, ROUNDS, "sha2").cast("string"), n, F.lit("0"))


def luhn_check(d: Column) -> Column:
    """The check digit for the digits ``d``."""
    n = F.length(d)

    def add(acc: Column, i: Column) -> Column:
        x = F.substring(d, i, F.lit(1)).cast("int")
        twice = F.when(x > 4, 2 * x - 9).otherwise(2 * x)
        return acc + F.when((n - i) % 2 == 0, twice).otherwise(x)

    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add)
    return ((10 - total % 10) % 10).cast("string")


def _card(m: Column, key: str) -> Column:
    def made(d: Column) -> Column:
        n = F.length(d)
        head, body, check = F.substring(d, F.lit(1), F.lit(1)), F.substring(d, F.lit(2), n - 2), F.substring(d, n, F.lit(1))
        new = _let(F.concat(head, _permute_digits(body, key + "card")), lambda x: F.concat(x, luhn_check(x)))
        return F.when(luhn_check(F.concat(head, body)) == check, _refill(m, new))

    return _let(_digits(m), made)


def _walk(x: Column, inside, key: str, a: int, b: int, steps: int = 110) -> Column:
    """Permutation of the part of 0..a*b-1 for which ``inside`` holds, by cycle walking."""
    step = lambda v: feistel(v, a, b, key, ROUNDS, "sha2")
    y = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), step(x), lambda v, _: F.when(inside(v), v).otherwise(step(v)))
    return _let(y, lambda v: F.when(inside(v), v).otherwise(F.raise_error(F.lit("cycle walk did not end")).cast("bigint")))


def _phone(m: Column, key: str) -> Column:
    unassigned = lambda y: (F.floor(y / 10_000_000) < 200) | (F.floor(y / 10_000) % 1000 < 200)

    def made(d: Column) -> Column:
        ten = F.substring(d, F.length(d) - 9, F.lit(10))
        area, exchange, line = (F.substring(ten, F.lit(i), F.lit(n)).cast("bigint") for i, n in ((1, 3), (4, 3), (7, 4)))
        back = lambda new: _refill(m, F.concat(F.substring(d, F.lit(1), F.length(d) - 10), new))

        def valid(y: Column) -> Column:
            return back(F.concat((F.floor(y / 8_000_000) + 200).cast("string"), (F.floor(y / 10_000) % 800 + 200).cast("string"), F.lpad((y % 10_000).cast("string"), 4, "0")))

        x = ((area - 200) * 800 + exchange - 200) * 10_000 + line
        other = _walk(ten.cast("bigint"), unassigned, key + "phone", 100_000, 100_000)
        return F.when((area >= 200) & (exchange >= 200), _let(feistel(x, 80_000, 80_000, key + "phone", ROUNDS, "sha2"), valid)).otherwise(back(F.lpad(other.cast("string"), 10, "0")))

    return _let(_digits(m), made)


def _intl(m: Column, key: str) -> Column:
    def made(d: Column) -> Column:
        n = F.length(d)
        new = F.concat(F.substring(d, F.lit(1), F.lit(2)), _permute_digits(F.substring(d, F.lit(3), n - 2), key + "intl"))
        return F.when(n.between(8, 15), _refill(m, new))

    return _let(_digits(m), made)


def _ssn(m: Column, key: str) -> Column:
    def made(d: Column) -> Column:
        area, group, serial = (F.substring(d, F.lit(i), F.lit(n)).cast("bigint") for i, n in ((1, 3), (4, 2), (6, 4)))
        place = area - 1 - (area > 666).cast("bigint")
        x = (place * 99 + group - 1) * 9999 + serial - 1

        def text(y: Column) -> Column:
            p = F.floor(y / (99 * 9999))
            new = F.concat(F.lpad((p + 1 + (p >= 665).cast("bigint")).cast("string"), 3, "0"), F.lpad((F.floor(y / 9999) % 99 + 1).cast("string"), 2, "0"), F.lpad((y % 9999 + 1).cast("string"), 4, "0"))
            return _refill(m, new)

        fine = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
        return F.when(fine, _let(feistel(x, 898 * 99, 9999, key + "ssn", ROUNDS, "sha2"), text))

    return _let(_digits(m), made)


def _ip(m: Column, key: str) -> Column:
    def made(o: Column) -> Column:
        x = F.aggregate(o, F.lit(0).cast("bigint"), lambda a, v: a * 256 + v)

        def text(y: Column) -> Column:
            return F.concat_ws(".", *[(F.floor(y / 256**k) % 256).cast("string") for k in (3, 2, 1, 0)])

        return F.when(F.forall(o, lambda v: v <= 255), _let(feistel(x, 65_536, 65_536, key + "ip", ROUNDS, "sha2"), text))

    return _let(F.transform(F.split(m, r"\."), lambda v: v.cast("bigint")), made)


def _date(m: Column, key: str) -> Column:
    days = (LAST - FIRST).days + 1

    def moved(form: str, which: str) -> Column:
        day = F.to_date(F.try_to_timestamp(m, F.lit(form)))

        def walk(d: Column) -> Column:
            step = lambda x: permute_below(x, days, key + "date", ROUNDS, "sha2")
            x = F.datediff(d, F.lit(FIRST)).cast("bigint")
            if which != "day":
                y = step(x)
            else:  # only days after the 12th are read day first: walk until one of those
                late = lambda v: F.dayofmonth(F.date_add(F.lit(FIRST), v.cast("int"))) > 12
                y = F.aggregate(F.sequence(F.lit(1), F.lit(60)), step(x), lambda v, _: F.when(late(v), v).otherwise(step(v)))
                y = F.when(late(y), y).otherwise(F.raise_error(F.lit("date walk did not end")).cast("bigint"))
            return F.when((x >= 0) & (x < days), _let(y, lambda v: F.date_format(F.date_add(F.lit(FIRST), v.cast("int")), form)))

        return _let(day, walk)

    us = moved("MM/dd/yyyy", "month")
    return F.when(m.contains("-"), moved("yyyy-MM-dd", "iso")).when(m.contains("."), moved("dd.MM.yyyy", "dot")).otherwise(F.coalesce(us, moved("dd/MM/yyyy", "day")))


def _mod97(s: Column) -> Column:
    """Remainder of an IBAN's rearranged text (letters count 10 to 35)."""

    def add(acc: Column, c: Column) -> Column:
        v = F.instr(F.lit(DIGIT + UPPER), c) - 1
        return F.when(v > 9, acc * 100 + v).otherwise(acc * 10 + v) % 97

    return F.aggregate(F.split(s, ""), F.lit(0), add)


def _iban(m: Column, key: str) -> Column:
    def made(s: Column) -> Column:
        country, body = F.substring(s, F.lit(1), F.lit(2)), F.substring(s, F.lit(5), F.length(s) - 4)
        fine = _mod97(F.concat(body, F.substring(s, F.lit(1), F.lit(4)))) == 1
        digits = _digits(body)
        low, high = F.substring(digits, F.lit(1), F.lit(18)), F.substring(digits, F.lit(19), F.lit(18))
        new = F.concat(_permute_digits(low, key + "iban"), F.when(F.length(high) > 0, _permute_digits(high, key + "iban2")).otherwise(F.lit("")))
        body2 = F.when(F.length(digits) > 0, _refill(body, new)).otherwise(body)

        def close(b: Column) -> Column:
            check = F.lpad((98 - _mod97(F.concat(b, country, F.lit("00")))).cast("string"), 2, "0")
            flat = F.concat(country, check, b)
            # spaces back to their places
            start = F.struct(F.lit("").alias("out"), F.lit(0).alias("used"))
            step = lambda a, c: F.struct(F.concat(a["out"], F.when(c == " ", c).otherwise(F.substring(flat, a["used"] + 1, F.lit(1)))).alias("out"), (a["used"] + (c != " ").cast("int")).alias("used"))
            return F.aggregate(F.split(m, ""), start, step, lambda a: a["out"])

        return F.when(fine & (F.length(s) >= 15), _let(body2, close))

    return _let(F.replace(m, F.lit(" "), F.lit("")), made)


def _shift(text: Column, stream: Column) -> Column:
    """Each letter and digit moved within its class by the hex stream."""

    def one(c: Column, i: Column) -> Column:
        k = F.conv(F.substring(stream, (i % 32) * 2 + 1, F.lit(2)), 16, 10).cast("int")
        out = c
        for letters in (LOWER, UPPER, DIGIT):
            at = F.instr(F.lit(letters), c)
            out = F.when(at > 0, F.substring(F.lit(letters), (at - 1 + k) % len(letters) + 1, F.lit(1))).otherwise(out)
        return out

    return F.array_join(F.transform(F.split(text, ""), one), "")


def _email(m: Column, key: str) -> Column:
    def made(parts: Column) -> Column:
        local, domain = F.element_at(parts, 1), F.element_at(parts, 2)
        half = F.floor(F.length(local) / 2).cast("int")
        start = F.struct(F.substring(local, F.lit(1), half).alias("l"), F.substring(local, half + 1, F.length(local)).alias("r"))

        def step(s: Column, i: Column) -> Column:
            stream = lambda other: F.sha2(F.concat_ws(":", F.lit(key + "email"), i.cast("string"), other), 256)
            left = F.when((i % 2 == 0) & (F.length(s["l"]) > 0), _shift(s["l"], stream(s["r"]))).otherwise(s["l"])
            right = F.when(i % 2 == 0, s["r"]).otherwise(_shift(s["r"], stream(s["l"])))
            return F.struct(left.alias("l"), right.alias("r"))

        new = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda s: F.concat(s["l"], s["r"]))
        return F.concat(new, F.lit("@"), domain)

    return _let(F.split(m, "@"), made)


_MAKERS = {"email": _email, "ip": _ip, "date": _date, "ssn": _ssn, "phone": _phone, "intl": _intl, "card": _card, "iban": _iban}


def pseudonym(m: Column, key: str) -> Column:
    """struct(kind, value) for a candidate; both null if it does not validate."""
    kind = F.lit(None).cast("string")
    for k, p in reversed(PATTERNS.items()):
        kind = F.when(m.rlike(f"^(?:{p})$"), k).otherwise(kind)

    def made(k: Column) -> Column:
        value = F.lit(None).cast("string")
        for name, f in reversed(_MAKERS.items()):
            value = F.when(k == name, f(m, key)).otherwise(value)
        return _let(value, lambda v: F.struct(F.when(v.isNotNull(), k).alias("kind"), v.alias("value")))

    return _let(kind, made)


_FOUND = "array<struct<kind:string,start:bigint,end:bigint>>"


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """row (struct of the input row), text (pseudonymised), found: (kind, start, end) in the old text.

    ``key`` is the secret: who knows it can undo the pseudonyms.
    """
    if not key:
        raise ValueError("a key is needed")
    rows = docs.select(F.struct("*").alias("row"), F.col(text_col).alias("old"))
    some = F.coalesce(F.col("old").rlike(ANY), F.lit(False))
    rows = rows.select("row", "old", F.when(some, F.struct(F.regexp_extract_all("old", F.lit(ANY), F.lit(0)).alias("seen"), F.split("old", ANY, -1).alias("gaps"))).alias("cut"))
    # Signs ahead of an email belong to the gap before it.
    lead = F.transform("cut.seen", lambda m: F.when(m.contains("@"), F.regexp_extract(m, "^[._%+-]*", 0)).otherwise(""))
    rows = rows.select("row", "old", F.col("cut.gaps").alias("gaps"), F.col("cut.seen").alias("seen"), lead.alias("lead"))
    value = F.zip_with("seen", "lead", lambda m, s: F.substring(m, F.length(s) + 1, F.length(m)))
    rows = rows.select("row", "old", F.element_at("gaps", -1).alias("rest"), F.zip_with(F.slice("gaps", F.lit(1), F.size("seen")), "lead", lambda g, s: F.concat(g, s)).alias("gap"), value.alias("value"))
    rows = rows.withColumn("new", F.transform("value", lambda m: pseudonym(m, key)))
    parts = F.zip_with("gap", F.zip_with("value", "new", lambda v, n: F.coalesce(n["value"], v)), lambda g, v: F.concat(g, v))
    ends = running(F.zip_with("gap", "value", lambda g, v: (F.length(g) + F.length(v)).cast("bigint")))
    spans = F.zip_with(F.zip_with(ends, "value", lambda e, v: F.struct((e - F.length(v)).cast("bigint").alias("start"), e.alias("end"))), "new", lambda s, n: F.struct(n["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    found = F.filter(spans, lambda s: s["kind"].isNotNull()).cast(_FOUND)
    return rows.select("row", F.when(F.col("value").isNotNull(), F.concat(F.array_join(parts, ""), F.col("rest"))).otherwise(F.col("old")).alias("text"), F.when(F.col("value").isNotNull(), found).otherwise(F.array().cast(_FOUND)).alias("found"))


def pseudonymised_documents(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """``docs`` with the text replaced; all columns."""
    out = pseudonymise(docs, key, text_col)
    return out.select(*[F.col("text").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns])
