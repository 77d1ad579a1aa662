"""Exact percentiles of whole columns, spread over the cluster.

The built-in exact percentile keeps every distinct value of a group in one reducer.  Here a
mergeable sketch brackets each wanted rank, one pass counts what lies below each bracket,
and only the values inside the brackets (a few in ``ACCURACY`` of the rows, equal ones
counted first) are put in order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

ACCURACY = 10_000


def exact_percentiles(df: DataFrame, cols: list[str], probs: list[float]) -> DataFrame:
    """variable, n, q (array of the percentiles, interpolated, in the order of ``probs``).

    Nulls do not count; a column without a value has n 0 and null percentiles.
    """
    df = cut_lineage(df.select(*[F.col(c).cast("double").alias(c) for c in dict.fromkeys(cols)]))  # read five times
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("double").alias("x")) for c in cols])).alias("r")).select("r.*").where("x IS NOT NULL")
    low = F.percentile_approx("x", [max(0.0, p - 2 / ACCURACY) for p in probs], ACCURACY)
    high = F.percentile_approx("x", [min(1.0, p + 2 / ACCURACY) for p in probs], ACCURACY)
    edges = long.groupBy("variable").agg(F.count(F.lit(1)).alias("n"), F.arrays_zip(low.alias("low"), high.alias("high"), F.array(*[F.lit(float(p)) for p in probs]).alias("p")).alias("e"))
    edges = edges.select("variable", "n", F.posexplode("e").alias("i", "e")).select("variable", "n", "i", "e.*")
    wide = edges.groupBy("variable").agg(F.array_sort(F.collect_list(F.struct("i", "low", "high"))).alias("e"))  # one row a column
    near = long.join(F.broadcast(wide), "variable")
    below = near.groupBy("variable").agg(F.array(*[F.sum((F.col("x") < F.col("e")[i]["low"]).cast("bigint")) for i in range(len(probs))]).alias("b"))
    below = below.select("variable", F.posexplode("b").alias("i", "below"))
    inside = F.filter("e", lambda b: (F.col("x") >= b["low"]) & (F.col("x") <= b["high"]))
    hits = near.select("variable", "x", F.explode(F.transform(inside, lambda b: b["i"])).alias("i")).groupBy("variable", "i", "x").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy("variable", "i").orderBy("x")
    ranked = hits.join(F.broadcast(below), ["variable", "i"]).withColumn("upto", F.col("below") + F.sum("c").over(w)).withColumn("from", F.col("upto") - F.col("c"))
    at = (F.col("n") - 1) * F.col("p")
    ranked = ranked.join(F.broadcast(edges.select("variable", "i", "n", "p")), ["variable", "i"])
    value = lambda k: F.max(F.when((F.col("from") <= k) & (k < F.col("upto")), F.col("x")))
    found = ranked.groupBy("variable", "i", "n", "p").agg(value(F.floor(at)).alias("a"), value(F.ceil(at)).alias("b"))
    share = at - F.floor(at)
    q = found.select("variable", "n", "i", (F.col("a") * (1 - share) + F.col("b") * share).alias("q"))
    out = q.groupBy("variable", "n").agg(F.array_sort(F.collect_list(F.struct("i", "q"))).alias("q")).select("variable", "n", F.col("q.q").alias("q"))
    names = df.sparkSession.createDataFrame([(c,) for c in cols], "variable string")
    return names.join(F.broadcast(out), "variable", "left").select("variable", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("q", F.array(*[F.lit(None).cast("double") for _ in probs])).alias("q"))
