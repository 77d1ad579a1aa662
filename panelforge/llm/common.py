"""Shared plumbing of the training-data operators."""

from __future__ import annotations

import atexit
import math
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: ASCII white space of every text contract here: space and U+0009..U+000D.
ASCII_WS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read by Spark only (the path may be in any store Spark reads)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The folder of a local session that names none.
_local_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Where it is unset, a session whose master is local (tests) gets a temporary folder that
    is removed at exit; on a cluster that is an error, as no folder is known to be shared.
    """
    global _local_dir
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if _local_dir is None:
        _local_dir = tempfile.mkdtemp(prefix="panelforge-")
        atexit.register(shutil.rmtree, _local_dir, ignore_errors=True)
    return _local_dir


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet to the shared folder and read it back.

    Unlike a cached or local checkpoint the files outlive any executor.  They are
    deleted when the application's file system closes.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/panelforge-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


#: Keys at most that a table may be broadcast for because they hold many rows.
HOT_KEYS = 2000
HOT_ROWS = 256


def hot_limit(total: int) -> int:
    """Rows of a key beyond which it is hot: at most ``HOT_KEYS`` keys of ``total`` rows can be."""
    return max(HOT_ROWS, -(-total // HOT_KEYS))


def spread_join(rows: DataFrame, table: DataFrame, key: str, total: int, by: str, n: str = "n") -> DataFrame:
    """``rows`` inner-joined with ``table`` on ``key``; no task gets all rows of a hot key.

    ``table`` has one row a key and says in ``n`` how many of the ``total`` rows have it (an
    upper bound will do).  The rows of a hot key are dealt over parts by a hash of the column
    ``by``, and its row of the table is repeated for each part.  Hot keys are HOT_KEYS at
    most, whatever the size, so their list (key, number of parts) is broadcast.
    """
    limit = hot_limit(total)
    parts = F.ceil(F.col(n) / limit).cast("int")
    hot = table.where(F.col(n) > limit).select(key, parts.alias("__parts"))
    salted = rows.join(F.broadcast(hot), key, "left").withColumn("__salt", F.pmod(F.xxhash64(by), F.coalesce("__parts", F.lit(1))).cast("int")).drop("__parts")
    spread = table.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.greatest(parts, F.lit(1)) - 1))).drop(n)
    return salted.join(spread, [key, "__salt"]).drop("__salt")


#: Bits that a key has in the filter of ``may_hold``, and bits of one bitmap of Spark's.
KEY_BITS, BITMAP_BITS = 16, 32_768


def may_hold(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """``rows`` whose ``key`` may be among the distinct ``keys``: all that are, and one in ``KEY_BITS`` of the others at most.

    Spares the exact join behind it most of the rows it would shuffle.  Two bytes a key are
    broadcast, in bitmaps of 4 KB.
    """
    bits = max(1, -(-keys.count() * KEY_BITS // BITMAP_BITS)) * BITMAP_BITS
    at = F.pmod(F.xxhash64(key), F.lit(bits))
    held = keys.select(at.alias("__at")).groupBy(F.floor(F.col("__at") / BITMAP_BITS).alias("__map")).agg(F.bitmap_construct_agg(F.col("__at") % BITMAP_BITS).alias("__bits"))
    asked = rows.withColumn("__at", at).withColumn("__map", F.floor(F.col("__at") / BITMAP_BITS)).join(F.broadcast(held), "__map")
    place = F.col("__at") % BITMAP_BITS
    byte = F.conv(F.hex(F.substring("__bits", (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return asked.where(byte.bitwiseAND(F.pow(F.lit(2), place % 8).cast("int")) != 0).select(*rows.columns)


#: Keys that a filter of rows may be broadcast for; beyond, it is a shuffled join.
BROADCAST_KEYS = 500_000


def drop_keys(rows: DataFrame, keys: list[str], gone: DataFrame, twins: DataFrame) -> DataFrame:
    """The column ``row`` of ``rows`` (row, and ``keys``) without those whose keys are in ``gone``.

    ``twins`` holds keys that several rows share of which one stays.  Both are distinct; they
    are counted, and broadcast if they are ``BROADCAST_KEYS`` at most, so that whole rows need
    not travel; beyond, the rows are shuffled once.
    """

    def same(t: DataFrame) -> tuple[DataFrame, Column]:
        t = t.select(*[F.col(k).alias(f"__{k}") for k in keys])
        on = F.lit(True)
        for k in keys:
            on = on & F.col(k).eqNullSafe(F.col(f"__{k}"))
        return t, on

    gone, twins = materialize(gone), materialize(twins)
    small = lambda t: F.broadcast(t) if t.count() <= BROADCAST_KEYS else t
    g, on = same(gone)
    kept = rows.join(small(g), on, "left_anti")
    if twins.isEmpty():
        return kept.select("row")
    t, on = same(twins)
    t = small(t)
    # Of twins one row travels from each partition: the aggregate starts before the shuffle.
    one = kept.join(t, on, "left_semi").groupBy(*keys).agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return kept.join(t, on, "left_anti").select("row").unionByName(one.select("row"))


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable over ``links`` (a, b), for linked nodes.

    Large-star / small-star rounds: every node's larger neighbours move to its smallest
    one, then its smaller ones do.  Minima are pre-aggregated before each shuffle, and
    the joins of a round deal large stars over parts (``spread_join``).
    """
    edges = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct())

    def smallest(pairs: DataFrame) -> DataFrame:
        return pairs.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))

    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = smallest(both).select("u", F.least("u", "m").alias("m"), "n")
        large = spread_join(both.where("v > u"), least, "u", 2 * edges.count(), "v").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(large.distinct())
        least = smallest(large)
        small = spread_join(large, least, "u", large.count(), "v").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        edges = materialize(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        # A forest of stars: no node is a leaf twice, or a leaf and a centre.
        roles = edges.select(F.col("u").alias("x"), F.lit(1).alias("leaf"), F.lit(0).alias("centre")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("leaf"), F.lit(1).alias("centre")))
        if roles.groupBy("x").agg(F.sum("leaf").alias("leaf"), F.max("centre").alias("centre")).where("leaf + centre > 1 AND leaf > 0").isEmpty():
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    raise RuntimeError("components did not settle")


def numbering_buckets(n: int) -> int:
    """Hash buckets used to number ``n`` rows; at most 65,536, so offsets stay small."""
    return max(1024, min(65_536, n // 2048))


#: Buckets whose offsets are summed in one task, where groups have their own.
BLOCK_BUCKETS = 4096
#: Equal rows that are numbered together, by one explode.
RUN_ROWS = 4096


def dense_numbers(df: DataFrame, out: str, buckets: int | Column, within: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    """Number rows 0, 1, 2, ... without a global sort (per group of ``within``, if given).

    Equal rows are interchangeable: they are counted (before any shuffle), numbered as one
    run, and spelled out again in pieces of ``RUN_ROWS``, so that a table of one repeated row
    is spread as well.  Runs go to hash buckets of ``order`` (default: all columns); each
    bucket is numbered on its own and shifted by the rows of the buckets before it.  The
    offsets table has at most ``buckets`` rows per group of ``within`` and is joined as such.
    The numbering depends on the rows alone, not on their partitions.
    """
    within = within or []
    names, order = df.columns, order or df.columns
    runs = df.groupBy(*names).agg(F.count(F.lit(1)).alias("__n"))
    runs = materialize(runs.withColumn("__bucket", F.pmod(F.xxhash64(*order), F.lit(buckets) if isinstance(buckets, int) else buckets).cast("int")))
    sizes = runs.groupBy(*within, "__bucket").agg(F.sum("__n").alias("__size")).withColumn("__block", F.floor(F.col("__bucket") / BLOCK_BUCKETS))
    ahead = lambda part, order, what: F.coalesce(F.sum(what).over(Window.partitionBy(*within, *part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    if within:
        # Two levels: buckets within their block, blocks within their group; no task gets all buckets of a hot group.
        blocks = sizes.groupBy(*within, "__block").agg(F.sum("__size").alias("__sum"))
        blocks = blocks.select(*within, "__block", ahead([], "__block", "__sum").alias("__base"))
        offsets = sizes.withColumn("__own", ahead(["__block"], "__bucket", "__size")).join(blocks, [*within, "__block"])
        offsets = offsets.select(*within, "__bucket", (F.col("__base") + F.col("__own")).alias("__before"))
    else:
        offsets = sizes.select("__bucket", ahead([], "__bucket", "__size").alias("__before"))
    rest = [c for c in names if c not in order]
    w_run = Window.partitionBy(*within, "__bucket").orderBy(*order, *rest).rowsBetween(Window.unboundedPreceding, -1)
    numbered = runs.withColumn("__from", F.coalesce(F.sum("__n").over(w_run), F.lit(0)))
    offsets = F.broadcast(offsets) if not within else offsets
    numbered = numbered.join(offsets, [*within, "__bucket"]).withColumn("__from", F.col("__before") + F.col("__from"))
    one = numbered.where("__n = 1").select(*names, F.col("__from").alias(out))
    cut = numbered.where("__n > 1").withColumn("__at", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("__n") - 1, F.lit(RUN_ROWS).cast("bigint"))))
    spread = cut.repartition(F.xxhash64("__from", "__at"))
    last = F.least(F.col("__n"), F.col("__at") + RUN_ROWS) - 1
    many = spread.withColumn("__at", F.explode(F.sequence(F.col("__at"), last))).select(*names, (F.col("__from") + F.col("__at")).alias(out))
    return one.unionByName(many)


def square_sides(n: int) -> tuple[int, int]:
    """Sides a, b of the smallest near-square with a*b >= n."""
    a = max(1, math.isqrt(max(0, n - 1)) + 1)
    return a, max(1, -(-n // a))


def _xx(key: str, i: Column, v: Column) -> Column:
    return F.xxhash64(F.lit(key), i, v)


def _sha(key: str, i: Column, v: Column) -> Column:
    return F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(key), i.cast("string"), v.cast("string")), 256), 1, 15), 16, 10).cast("bigint")


def feistel(x: Column, a: Column | int, b: Column | int, key: str, rounds: int = 8, prf: str = "xxhash64") -> Column:
    """Keyed permutation of 0 .. a*b-1: alternating modular-addition Feistel rounds.

    ``x = left * b + right`` with ``left < a`` and ``right < b``; even rounds add a
    keyed hash of ``right`` to ``left`` modulo ``a``, odd rounds the other way round.
    """
    f = {"xxhash64": _xx, "sha2": _sha}[prf]
    a = F.lit(a).cast("bigint") if isinstance(a, int) else a
    b = F.lit(b).cast("bigint") if isinstance(b, int) else b

    def step(s: Column, i: Column) -> Column:
        even = i % 2 == 0
        left = F.when(even, F.pmod(s["l"] + F.pmod(f(key, i, s["r"]), a), a)).otherwise(s["l"])
        right = F.when(even, s["r"]).otherwise(F.pmod(s["r"] + F.pmod(f(key, i, s["l"]), b), b))
        return F.struct(left.alias("l"), right.alias("r"))

    start = F.struct(F.floor(x / b).cast("bigint").alias("l"), F.pmod(x, b).cast("bigint").alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), start, step, lambda s: s["l"] * b + s["r"])


def permute_below(x: Column, n: int, key: str, rounds: int = 8, prf: str = "xxhash64") -> Column:
    """Permutation of 0 .. n-1 by cycle walking a Feistel permutation of a*b >= n.

    The near-square domain exceeds ``n`` by less than its side, so a walk longer than
    ``steps`` is either impossible (small n) or has a probability below 1e-20; if it
    ever happened, the query fails instead of returning a wrong place.
    """
    a, b = square_sides(n)
    excess = a * b - n
    once = feistel(x, a, b, key, rounds, prf)
    if not excess:
        return once
    steps = min(excess, 24) + 1
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), once, lambda y, _: F.when(y < n, y).otherwise(feistel(y, a, b, key, rounds, prf)))
    return F.when(walked < n, walked).otherwise(F.raise_error(F.lit("cycle walk did not end")).cast("bigint"))
