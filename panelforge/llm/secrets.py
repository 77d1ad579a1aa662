"""Secret scans: patterns plus a randomness test battery (native).

Base kinds are patterns.  The method adds spans of kind ``random``: every run of ``MIN_TOKEN``
or more token characters outside the base spans, letters only and digits only included, is
read without its separators (``-``, ``_``, padding) in the narrowest encoding that holds it
(digits, hex, letters, base32, base36, base62, base64) and tested for randomness:

* chi-squared: its symbols are not further from uniform than text is;
* runs: upper and lower half of the alphabet change neither too seldom nor too often;
* serial correlation of neighbouring values.

A token is ordinary until shown random, so each test is one of equivalence: its null is a
deviation of at least the margin of ordinary text (``margin``, ``RUNS_OFF``, ``SERIAL``), and
a small p-value says that the token is nearer to random than that.  A token must pass all
three, so its p-value is the largest.  Tokens are reported by a Benjamini-Hochberg procedure
at rate ``FDR`` over the whole corpus: at most that share of the reported ones is expected
to be ordinary.  It runs within length classes, because short tokens have less power and
need not make long ones pay for it.  The procedure uses a histogram of log p-values, so it
needs one small aggregate and four thresholds, not a sort of all tokens.

Positions are code points, ends exclusive.  Defined cases: a null text is the empty text;
very long texts and tokens are read whole, in time n ** 1.5 of the matches; repeated rows
are scanned alike; equal starts are ordered by kind; an empty table gives an empty result;
columns of any name may be present (they are in the struct ``row``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import once, running
from .common import materialize

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
MIN_TOKEN = 20
TOKEN = r"[A-Za-z0-9+/_-]{20,}={0,2}"
#: Symbols of a token without its separators that are tested at least.
MIN_BODY = 16
#: Kinds in the order of equal starts.
KINDS = ("assign", "access", "hex", "random")
FDR = 0.05
#: Upper ends of the length classes.
CLASSES = (31, 47, 79)
LOWER, UPPER, DIGIT = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: (name, pattern of the token without separators, alphabet in order of value); the first that fits.
ENCODINGS = (
    ("digits", "^[0-9]+$", DIGIT),
    ("hex", "^[0-9a-f]+$", DIGIT + LOWER[:6]),
    ("hex_upper", "^[0-9A-F]+$", DIGIT + UPPER[:6]),
    ("lower", "^[a-z]+$", LOWER),
    ("upper", "^[A-Z]+$", UPPER),
    ("base32", "^[A-Z2-7]+$", UPPER + DIGIT[2:8]),
    ("base36", "^[0-9A-Z]+$", DIGIT + UPPER),
    ("base36_lower", "^[0-9a-z]+$", DIGIT + LOWER),
    ("letters", "^[A-Za-z]+$", UPPER + LOWER),
    ("base62", "^[A-Za-z0-9]+$", UPPER + LOWER + DIGIT),
    ("base64", "^.*$", UPPER + LOWER + DIGIT + "+/"),
)
#: Two symbols of ordinary text are equal with this probability at least.
EQUAL = 0.06
#: Margins of the runs test (share of changes from a half) and of the serial correlation.
RUNS_OFF, SERIAL = 0.3, 0.6
_SPAN = "array<struct<start:bigint,end:bigint,text:string,group:string>>"


def spans_of(text: Column, pattern: str, group: int = 0) -> Column:
    """Matches, leftmost and non-overlapping: array of (start, end, text, group).

    A text without a match costs one scan, one with matches two more.
    """
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)

    def rows(s: Column) -> Column:
        steps = F.zip_with(F.slice(s["g"], F.lit(1), F.size(s["f"])), s["f"], lambda g, f: (F.length(g) + F.length(f)).cast("bigint"))
        inner = lambda f: F.regexp_extract(f, pattern, group) if group else F.lit(None).cast("string")
        return F.zip_with(running(steps), s["f"], lambda e, f: F.struct((e - F.length(f)).cast("bigint").alias("start"), e.alias("end"), f.alias("text"), inner(f).alias("group")))

    made = once(F.struct(gaps.alias("g"), found.alias("f")), rows).cast(_SPAN)
    return F.when(text.rlike(pattern), made).otherwise(F.array().cast(_SPAN))


def normal_tail(z: Column) -> Column:
    """P(Z > z) by a rational approximation (absolute error below 1e-7)."""
    x = F.abs(z) / float(2**0.5)
    t = 1.0 / (1.0 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    half = F.greatest(0.5 * poly * F.exp(-x * x), F.lit(1e-300))
    return F.when(z >= 0, half).otherwise(1.0 - half)


def margin(k: float) -> float:
    """Non-uniformity (chi-squared per symbol) of ordinary text over an alphabet of ``k``."""
    return 1.0 if k <= 16 else EQUAL * k - 1.0


def battery(token: Column) -> Column:
    """(encoding, n, p_chi, p_runs, p_serial, p) of a token as a struct; small: near random."""
    body = F.regexp_replace(token, "[=_-]", "")

    def encoded(body: Column) -> Column:
        names, letters = F.lit(None).cast("string"), F.lit("")
        off = F.lit(0.0)
        for n, pattern, alphabet in reversed(ENCODINGS):
            fits = body.rlike(pattern)
            names, letters, off = F.when(fits, n).otherwise(names), F.when(fits, alphabet).otherwise(letters), F.when(fits, margin(len(alphabet))).otherwise(off)
        return F.struct(names.alias("encoding"), letters.alias("alphabet"), off.alias("off"), body.alias("body"), F.split(body, "").alias("chars"))

    def valued(s: Column) -> Column:
        k = F.length(s["alphabet"]).cast("double")
        values = F.transform(s["chars"], lambda c: (F.instr(s["alphabet"], c) - 1).cast("double"))
        return F.struct(s["encoding"].alias("encoding"), s["off"].alias("off"), s["chars"].alias("chars"), s["body"].alias("body"), F.length(s["body"]).cast("double").alias("n"), k.alias("k"), values.alias("v"), F.transform(values, lambda v: v * 2 >= k).alias("high"))

    def p_values(s: Column) -> Column:
        n, k = s["n"], s["k"]
        # Chi-squared against a non-central one: Patnaik's scaling, then Wilson and Hilferty's cube root.
        squares = F.aggregate(F.array_distinct(s["chars"]), F.lit(0.0), lambda a, c: a + F.pow((n - F.length(F.replace(s["body"], c, F.lit("")))).cast("double"), F.lit(2.0)))
        chi2, df, lam = squares * k / n - n, k - 1, n * s["off"]
        scale, dof = (df + 2 * lam) / (df + lam), (df + lam) * (df + lam) / (df + 2 * lam)
        spread = 2.0 / (9.0 * dof)
        p_chi = normal_tail(-(F.pow(F.greatest(chi2 / scale / dof, F.lit(1e-9)), F.lit(1 / 3)) - (1.0 - spread)) / F.sqrt(spread))
        next_to = lambda x: F.arrays_zip(F.slice(x, F.lit(1), F.size(x) - 1).alias("a"), F.slice(x, F.lit(2), F.size(x) - 1).alias("b"))
        changes = F.size(F.filter(next_to(s["high"]), lambda z: z["a"] != z["b"])).cast("double")
        seldom, sd = 0.5 - RUNS_OFF, F.sqrt((n - 1.0) * (0.25 - RUNS_OFF**2))
        p_runs = F.greatest(normal_tail((changes - seldom * (n - 1.0)) / sd), normal_tail(((1.0 - seldom) * (n - 1.0) - changes) / sd))
        mean = F.aggregate(s["v"], F.lit(0.0), lambda a, v: a + v) / n
        own = F.aggregate(s["v"], F.lit(0.0), lambda a, v: a + (v - mean) * (v - mean))
        cross = F.aggregate(next_to(s["v"]), F.lit(0.0), lambda a, z: a + (z["a"] - mean) * (z["b"] - mean))
        r, se = cross / F.nullif(own, F.lit(0.0)), F.lit((1.0 - SERIAL**2) ** 0.5) / F.sqrt(n)
        p_serial = F.coalesce(F.greatest(normal_tail((SERIAL - r) / se), normal_tail((SERIAL + r) / se)), F.lit(1.0))
        return F.struct(s["encoding"].alias("encoding"), n.cast("bigint").alias("n"), p_chi.alias("p_chi"), p_runs.alias("p_runs"), p_serial.alias("p_serial"), F.greatest(p_chi, p_runs, p_serial).alias("p"))

    return F.element_at(F.transform(F.transform(F.array(once(body, encoded)), valued), p_values), 1)


def length_class(n: Column) -> Column:
    out = F.lit(len(CLASSES))
    for i in reversed(range(len(CLASSES))):
        out = F.when(n <= CLASSES[i], i).otherwise(out)
    return out


def reported_below(tokens: DataFrame, rate: float = FDR) -> list[float]:
    """By length class: the largest p-value that Benjamini-Hochberg rejects (0: none).

    ``tokens``: n, p.  P-values are binned by their logarithm and judged at the upper
    end of their bin, which never rejects more than the exact procedure.
    """
    bins = tokens.select(length_class(F.col("n")).alias("cls"), F.least(F.lit(2000), F.floor(-20.0 * F.log10(F.greatest("p", F.lit(1e-200))))).cast("int").alias("bin"))
    counts = bins.groupBy("cls", "bin").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy("cls")
    upto = F.sum("c").over(w.orderBy(F.desc("bin")))
    ranked = counts.select("cls", F.pow(F.lit(10.0), -F.col("bin") / 20.0).alias("upper"), upto.alias("upto"), F.sum("c").over(w).alias("m"))
    found = ranked.where(F.col("upper") <= rate * F.col("upto") / F.col("m")).groupBy("cls").agg(F.max("upper").alias("t")).collect()  # a row a class
    out = [0.0] * (len(CLASSES) + 1)
    for r in found:
        out[r["cls"]] = r["t"]
    return out


def scan(docs: DataFrame, text_col: str = "text", rate: float = FDR, keep: tuple[str, ...] | None = None) -> DataFrame:
    """row (struct of the columns ``keep``, default: all but the text), assign, access, hex, random: arrays of (start, end, text)."""
    keep = [c for c in docs.columns if c != text_col] if keep is None else list(keep)
    slim = lambda spans: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text")))
    rows = docs.select(F.struct(*keep).alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select("row", slim(F.filter(spans_of(F.col("text"), ASSIGN, 2), lambda s: F.length(s["group"]) >= 12)).alias("assign"), slim(spans_of(F.col("text"), ACCESS)).alias("access"), slim(spans_of(F.col("text"), HEX)).alias("hex"), slim(spans_of(F.col("text"), TOKEN)).alias("token"))
    base = F.concat("assign", "access", "hex")
    fresh = F.filter("token", lambda s: (F.length(F.regexp_replace(s["text"], "[=_-]", "")) >= MIN_BODY) & ~F.exists(base, lambda b: (b["start"] <= s["start"]) & (b["end"] >= s["end"])))
    tested = rows.withColumn("token", fresh).withColumn("token", F.transform("token", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text"), battery(s["text"]).alias("test"))))
    tested = materialize(tested)
    cut = reported_below(tested.select(F.explode("token.test").alias("t")).select("t.n", "t.p"), rate)
    limit = lambda n: F.element_at(F.array(*[F.lit(c) for c in cut]), length_class(n) + 1)
    return tested.select("row", "assign", "access", "hex", F.filter("token", lambda s: s["test"]["p"] <= limit(s["test"]["n"])).alias("random"))


def listed(*kinds: str) -> Column:
    """kind:start:end of the named span columns, by start and then kind, comma-joined."""
    ordered = lambda k: F.transform(k, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(k)).alias("order"), s["end"].alias("end")))
    every = [ordered(k) for k in kinds]
    names = F.array(*[F.lit(k) for k in KINDS])
    parts = F.transform(F.array_sort(F.concat(*every)), lambda s: F.concat_ws(":", F.element_at(names, s["order"] + 1), s["start"].cast("string"), s["end"].cast("string")))
    return F.concat_ws(",", parts)
