"""Mixing sources to target weights by Poisson replication (native).

A source with ``n`` rows and target share ``w`` of ``total`` rows has the mean repetition
rate ``total * w / n``.  Each document draws its count by inverting the Poisson
distribution at a uniform number hashed from the seed and the document; it is exploded by
that count and the copies are shuffled globally by a hashed key (hash partitions, sorted
inside, so any reading order of the output is a random order of the corpus).

Default target: shares in proportion to ``n ** temperature`` of each source.

A rate above ``PART`` is drawn as a sum of independent parts, so the distribution table of
a source has at most ``TERMS`` entries.  The table of sources is broadcast only when it
has at most ``BROADCAST_SOURCES`` rows; beyond it is a shuffled join in which a hot
source is salted.

Defined cases: a null source is a source of its own; a null identifier hashes as the
empty text; rows that repeat an identifier draw the same count and key (and go to different
partitions if any of their strings differ); texts may be null, empty or very long; a source without a weight in a given table gets none; an empty table gives
an empty result; columns of any name may be present.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

PART = 32.0
TERMS = 160
BROADCAST_SOURCES = 10_000
SALTS = 64


def hashed(*parts) -> Column:
    """60 bits of an MD5 over the parts' texts, as a long."""
    cols = [F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *cols)), 1, 15), 16, 10).cast("bigint")


def uniform(*parts) -> Column:
    """A number inside (0, 1) from 50 hashed bits."""
    return (F.shiftright(hashed(*parts), 10).cast("double") + 0.5) / float(2**50)


def poisson_table(rate: Column) -> Column:
    """Cumulative probabilities of 0 .. TERMS-1 at ``rate`` <= PART."""
    one = F.struct(F.exp(-rate).alias("p"), F.array(F.exp(-rate)).alias("cdf"))

    def step(s: Column, k: Column) -> Column:
        p = s["p"] * rate / k
        return F.struct(p.alias("p"), F.concat(s["cdf"], F.array(F.element_at(s["cdf"], -1) + p)).alias("cdf"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS - 1)), one, step, lambda s: s["cdf"])


def source_rates(docs: DataFrame, source_col: str, total: float | None, temperature: float, weights: DataFrame | None) -> DataFrame:
    """source, n, rate, parts, cdf: one row per source."""
    sizes = docs.groupBy(F.col(source_col).alias("source")).agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        shares = sizes.withColumn("weight", F.pow(F.col("n").cast("double"), F.lit(temperature)))
    else:
        w = weights.select(F.col("source").alias("__s"), F.col("weight").cast("double").alias("weight"))
        shares = sizes.join(w, F.col("source").eqNullSafe(F.col("__s")), "left").select("source", "n", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    shares = materialize(shares)
    sums = shares.agg(F.sum("weight").alias("w"), F.sum("n").alias("n")).first()
    want = float(total if total is not None else (sums["n"] or 0))
    rate = F.lit(want) * F.col("weight") / F.lit(sums["w"] or 1.0) / F.col("n")
    out = shares.select("source", "n", rate.alias("rate"))
    out = out.withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("rate") / PART)).cast("int"))
    return out.withColumn("cdf", poisson_table(F.col("rate") / F.col("parts")))


def mix(docs: DataFrame, seed: str = "mix", total: float | None = None, temperature: float = 0.5, weights: DataFrame | None = None, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """row (struct of the input row), copy, copies, rate, shuffle_key; in shuffled order."""
    rates = materialize(source_rates(docs, source_col, total, temperature, weights))
    n_sources = rates.count()
    rows = docs.select(F.struct("*").alias("row"), F.col(source_col).alias("__source"))
    if n_sources <= BROADCAST_SOURCES:
        joined = rows.join(F.broadcast(rates), F.col("__source").eqNullSafe(F.col("source")))
    else:
        salt = F.pmod(F.xxhash64(F.col(f"row.{id_col}")), F.lit(SALTS)).cast("int")
        salted = rates.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn("__salt", salt).join(salted, F.col("__source").eqNullSafe(F.col("source")) & (F.col("__salt") == F.col("salt")))
    ident = F.col(f"row.{id_col}")
    draw = lambda j: F.size(F.filter(F.col("cdf"), lambda c: c <= uniform(F.lit(seed), ident, j))).cast("bigint")
    one = F.size(F.filter(F.col("cdf"), lambda c: c <= F.col("u"))).cast("bigint")
    many = F.aggregate(F.sequence(F.lit(1), F.col("parts")), F.lit(0).cast("bigint"), lambda a, j: a + draw(j))
    counted = joined.withColumn("u", uniform(F.lit(seed), ident, F.lit(1)))
    counted = counted.select("row", "rate", F.when(F.col("parts") == 1, one).otherwise(many).alias("copies")).where("copies > 0")
    copies = counted.select("row", "rate", "copies", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))).alias("copy"))
    keyed = copies.withColumn("shuffle_key", hashed(F.lit(seed), F.lit("place"), ident, F.col("copy")))
    # Rows without an identifier, or with a shared one, have one key: their texts part them.
    return keyed.repartition("shuffle_key", F.xxhash64(*[F.col(f"row.{c}") for c, t in docs.dtypes if t == "string"])).sortWithinPartitions("shuffle_key")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mixture with the columns of ``docs``."""
    return mix(docs, **options).select("row.*")
