"""Approximate nearest neighbours: multi-index hashing over learned rotated binary codes.

Codes.  From a bounded sample (``SAMPLE_ROWS`` vectors, smallest identifier hashes): centre,
principal axes, and rotations learned by iterative quantisation from different starts; a
code is the signs of the rotated coordinates, as many bits as the plan below wants.

Index.  A code is cut into ``m`` substrings of ``w`` bits.  The index is one table keyed by
(substring, value), with the code of the row; it is written once for all queries.  A query
asks, for each substring, for every value within ``r`` bits of its own, as rows of an equi-
join: by the pigeonhole principle that retrieves every code within ``m * (r + 1) - 1`` bits,
and most of those somewhat further away.  Codes within ``reach`` bits are reranked by exact
double-precision Euclidean distance of the original vectors.

Plan.  ``w``, ``r`` and ``m`` are fitted: of the combinations that find ``TARGET`` of the
sample's true neighbours, the one with the least work (values asked for, index rows, pairs
met) at the table's size.  Where neighbours are close, the index excludes nearly all rows;
the further they are from being close (isotropic vectors of many dimensions), the larger
the share of rows that any index must meet, and the plan shows it: see ``Plan.share``.  A plan
that meets ``LOUD`` of the rows or more (a small table, whose comparison is cheap, or a sample
for which no combination finds the target, where every row is met) is reported by a warning.

Equal vectors are one entry of the index: of each, the ``k`` + 1 smallest identifiers are
kept, which is all that a ranking by (distance, identifier) can return.  Values that many
different codes share are dealt over parts.  A query that met fewer than ``k`` rows is
compared with all rows, so an answer is short only when there are fewer candidates.

Defined cases: vectors that are null, zero, of another dimension than the largest group
of vectors, or hold a null or non-finite component take no part, nor do null identifiers;
rows that repeat an identifier count once, at their nearest, and as a query at their
smallest vector; ties go to the smaller identifier; an empty table gives an empty result;
other columns pass by.
"""

from __future__ import annotations

import itertools
import warnings
from collections.abc import Iterator
from dataclasses import dataclass
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import hot_limit, materialize

SAMPLE_ROWS = 20_000
SAMPLE_QUERIES = 200
#: Share of the sample's true neighbours that the plan must find.
TARGET = 0.96
#: Share of the neighbours met that the filter on whole codes lets pass.
REACH = 0.995
#: Bits of the longest code; bits of the filter at least.
MAX_BITS, FILTER_BITS = 768, 256
MAX_VALUES = 1024
#: Rows and rounds that learn a rotation.
ROTATION_ROWS, ITERATIONS = 4096, 12
#: Work of a pair that is met, against that of a value asked for or a row of the index.
PAIR_WORK = 4
QUERY_BLOCK = 8192
#: Rows whose projections are held at once.
BIT_ROWS = 1024
#: Share of the rows met from which a plan says so.
LOUD = 0.5


@dataclass
class Plan:
    """How codes are cut and asked for; ``share``: of all rows that a query meets, as estimated."""

    width: int
    near: int
    parts: int
    reach: int
    share: float

    @property
    def words(self) -> int:
        return max(FILTER_BITS, self.width * self.parts + 63) // 64

    def masks(self) -> list[int]:
        """What to flip in a value to get every value within ``near`` bits."""
        return [sum(1 << b for b in bits) for n in range(self.near + 1) for bits in itertools.combinations(range(self.width), n)]


@dataclass
class Codes:
    mean: np.ndarray
    turns: np.ndarray  # dimension x bits

    def bits(self, x: np.ndarray, n: int) -> np.ndarray:
        out = np.empty((len(x), n), bool)
        for at in range(0, len(x), BIT_ROWS):  # the projections are eight times the size of the bits
            out[at : at + BIT_ROWS] = ((x[at : at + BIT_ROWS] - self.mean) @ self.turns[:, :n]) > 0
        return out


def rotations(sample: np.ndarray, bits: int, seed: int = 0) -> Codes:
    """``bits`` directions: blocks of rotations of the principal axes, each learned from its own start."""
    rng = np.random.default_rng(seed)
    mean = sample.mean(axis=0)
    centred = sample[:ROTATION_ROWS] - mean
    _, axes = np.linalg.eigh(centred.T @ centred)
    axes = axes[:, ::-1]
    z, blocks = centred @ axes, []
    while sum(b.shape[1] for b in blocks) < bits:
        turn = np.linalg.qr(rng.normal(size=(z.shape[1], z.shape[1])))[0]
        for _ in range(ITERATIONS if len(sample) > 1 else 0):
            u, _, vt = np.linalg.svd(np.where(z @ turn > 0, 1.0, -1.0).T @ z)
            turn = (u @ vt).T
        blocks.append(axes @ turn)
    return Codes(mean, np.concatenate(blocks, axis=1)[:, :bits])


def neighbour_pairs(sample: np.ndarray, k: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(query, neighbour) rows of the sample: each query's ``k`` nearest others."""
    asked = np.random.default_rng(seed).permutation(len(sample))[:SAMPLE_QUERIES]
    k = min(k, len(sample) - 1)
    lengths, found = (sample * sample).sum(axis=1), []
    for q in asked:  # one row of distances at a time
        d = lengths[q] + lengths - 2 * (sample @ sample[q])
        d[q] = np.inf
        found.append(np.argsort(d, kind="stable")[:k])
    return np.repeat(asked, k), np.concatenate(found)


def learn(sample: np.ndarray, k: int, n_rows: int, n_queries: int, target: float = TARGET) -> tuple[Codes, Plan]:
    """Codes and the cheapest plan that finds ``target`` of the sample's neighbours."""
    codes = rotations(sample, MAX_BITS)
    everything = Plan(1, 1, 1, FILTER_BITS, 1.0)
    if len(sample) < 2:
        return codes, everything
    a, b = neighbour_pairs(sample, k)
    rng = np.random.default_rng(2)
    c, d = rng.integers(0, len(sample), (2, 4000))
    own = codes.bits(sample, MAX_BITS)
    close, any_pair = own[a] != own[b], (own[c] != own[d])[c != d]
    best, least = None, np.inf
    for w in range(4, 21):
        m = MAX_BITS // w
        # Bits apart in each substring, of neighbours and of any two rows.
        apart, apart_any = (x[:, : m * w].reshape(len(x), m, w).sum(axis=2) for x in (close, any_pair))
        for r in range(w):
            values = sum(comb(w, i) for i in range(r + 1))
            if values > MAX_VALUES:
                break
            found = np.logical_or.accumulate(apart <= r, axis=1).mean(axis=0)
            enough = np.flatnonzero(found >= target)
            if not len(enough):
                continue
            parts = int(enough[0]) + 1
            met = float((apart_any[:, :parts] <= r).mean())
            work = n_queries * parts * values + n_rows * parts + PAIR_WORK * n_queries * n_rows * parts * met
            if work < least:
                bits = max(FILTER_BITS, -(-w * parts // 64) * 64)
                reach = int(np.quantile(close[:, :bits].sum(axis=1), REACH, method="higher"))
                share = float((apart_any[:, :parts] <= r).any(axis=1).mean())
                best, least = Plan(w, r, parts, reach, share), work
    return codes, best or everything


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id, v (doubles) of the vectors that take part, of any dimension."""
    v = F.col(vec_col).cast("array<double>")
    fine = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.where(F.col(id_col).isNotNull() & F.coalesce(fine, F.lit(False))).select(F.col(id_col).cast("bigint").alias("id"), v.alias("v"))


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _stacked(col: pa.ChunkedArray, dim: int) -> np.ndarray:
    return np.concatenate([np.zeros((0, dim)), *(_matrix(c, dim) for c in col.chunks)])


def _collected(vectors: DataFrame, dim: int) -> np.ndarray:
    """``v`` of a bounded table as one array, without an object a number."""
    return _stacked(vectors.select("v").toArrow().column("v"), dim)


def coded(rows: DataFrame, codes: Codes, plan: Plan, dim: int) -> DataFrame:
    """id, h, g (hashes of the vector), w0 .. (the code's words) and subs (its substrings)."""
    shared = rows.sparkSession.sparkContext.broadcast((codes, plan))
    words = plan.words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, plan = shared.value
        weights = 1 << np.arange(plan.width, dtype=np.int64)
        for b in batches:
            on = codes.bits(_matrix(b.column(3), dim), 64 * words)
            packed = np.packbits(on, axis=1, bitorder="little").view("<i8").reshape(-1, words)
            subs = on[:, : plan.width * plan.parts].reshape(len(on), plan.parts, plan.width) @ weights
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, subs.size + 1, plan.parts, dtype=np.int32)), pa.array(subs.reshape(-1)))
            cols = [*(b.column(n) for n in range(3)), *(pa.array(np.ascontiguousarray(packed[:, i])) for i in range(words)), flat]
            yield pa.RecordBatch.from_arrays(cols, ["id", "h", "g", *(f"w{i}" for i in range(words)), "subs"])

    schema = "id long, h long, g long, " + "".join(f"w{i} long, " for i in range(words)) + "subs array<long>"
    return rows.select("id", F.xxhash64("v").alias("h"), F.xxhash64(F.lit(11), "v").alias("g"), "v").mapInArrow(run, schema)


def retrieve(index: DataFrame, asked: DataFrame, plan: Plan) -> DataFrame:
    """Distinct (query_id, rep): index entries that a query meets whose code is within ``reach``.

    ``index``: rep and a code per different vector; ``asked``: query_id and a code.
    """
    words = [f"w{i}" for i in range(plan.words)]
    key = lambda value: F.col("j") * F.lit(2**32) + value
    entries = materialize(index.select("rep", *words, F.posexplode("subs").alias("j", "value")).select("rep", *words, key(F.col("value")).alias("key")))
    limit = hot_limit(entries.count())
    # Values of more entries than that are 2000 at most.
    hot = materialize(entries.groupBy("key").count().where(F.col("count") > limit).select("key", F.ceil(F.col("count") / limit).cast("int").alias("parts")))
    entries = entries.join(F.broadcast(hot), "key", "left").withColumn("part", F.pmod(F.xxhash64("rep"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    # Queries are few rows, often one file, and are dealt before each asks for thousands of values.
    dealt = asked.repartition(asked.sparkSession.sparkContext.defaultParallelism, "query_id")
    probes = dealt.select("query_id", *[F.col(x).alias(f"q{x}") for x in words], F.posexplode("subs").alias("j", "value"))
    masks = F.array(*[F.lit(x).cast("bigint") for x in plan.masks()])
    probes = probes.withColumn("mask", F.explode(masks)).withColumn("key", key(F.col("value").bitwiseXOR(F.col("mask")))).drop("j", "value", "mask")
    probes = probes.join(F.broadcast(hot), "key", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    apart = sum((F.bit_count(F.col(x).bitwiseXOR(F.col(f"q{x}"))) for x in words), F.lit(0))
    # Spark guesses the size of the values asked for without counting how many a query has, and would send them all through the driver.
    return probes.hint("merge").join(entries, ["key", "part"]).where(apart <= plan.reach).select("query_id", "rep").distinct()


def distances(pairs: DataFrame, dim: int) -> DataFrame:
    """query_id, vec_id, score of pairs (query_id, vec_id, qv, v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = np.sqrt(((_matrix(b.column(2), dim) - _matrix(b.column(3), dim)) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(d)], ["query_id", "vec_id", "score"])

    return pairs.select("query_id", "vec_id", "qv", "v").mapInArrow(run, "query_id long, vec_id long, score double")


def scan(rows: DataFrame, queries: DataFrame, dim: int, k: int) -> DataFrame:
    """query_id, vec_id, score: the best ``k`` of each partition for a block of queries (id, v), collected."""
    got = queries.select("id", "v").toArrow()
    shared = rows.sparkSession.sparkContext.broadcast((got.column("id").to_numpy(), _stacked(got.column("v"), dim)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qid, qv = shared.value
        best = [(np.zeros(0), np.zeros(0, np.int64))] * len(qid)
        for b in batches:
            ids, x = b.column(0).to_numpy(zero_copy_only=False), _matrix(b.column(1), dim)
            for i in range(len(qid)):
                other = ids != qid[i]
                d = np.concatenate([best[i][0], np.sqrt(((x[other] - qv[i]) ** 2).sum(axis=1))])
                c = np.concatenate([best[i][1], ids[other]])
                order = np.lexsort((c, d))
                order = order[np.sort(np.unique(c[order], return_index=True)[1])][:k]
                best[i] = d[order], c[order]
        n = [len(d) for d, _ in best]
        cols = [np.repeat(qid, n), np.concatenate([c for _, c in best] or [np.zeros(0, np.int64)]), np.concatenate([d for d, _ in best] or [np.zeros(0)])]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["query_id", "vec_id", "score"])

    return rows.mapInArrow(run, "query_id long, vec_id long, score double")


def _top(found: DataFrame, k: int) -> DataFrame:
    once = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    w = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return once.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def neighbours(vectors: DataFrame, is_query, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", target: float = TARGET) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found for every query row.

    ``is_query``: a condition on the column ``id``.
    """
    spark = vectors.sparkSession
    rows = materialize(usable(vectors, id_col, vec_col))
    dims = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if dims is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, total = dims["dim"], dims["count"]
    rows = rows.where(F.size("v") == dim)
    h = F.xxhash64(F.lit("ann"), "id", "v")
    picked = rows.where(h.cast("double") / 2.0**64 + 0.5 <= min(1.0, 1.2 * SAMPLE_ROWS / total)).select(h.alias("h"), "v").orderBy("h").limit(SAMPLE_ROWS).select("v")
    asked = materialize(rows.where(is_query).groupBy("id").agg(F.min("v").alias("v")))
    codes, plan = learn(_collected(picked, dim), k, total, asked.count(), target)
    if plan.share >= LOUD:
        warnings.warn(f"the index excludes little: a query meets {plan.share:.0%} of {total} vectors ({plan.parts} substrings of {plan.width} bits, {plan.near} bits apart)", stacklevel=2)
    entries = coded(rows, codes, plan, dim)
    same = Window.partitionBy("h", "g").orderBy("id")
    members = materialize(entries.withColumn("rn", F.row_number().over(same)).where(F.col("rn") <= k + 1).withColumn("rep", F.first("id").over(same)))
    index = members.where("rn = 1").select(F.struct("rep", "h", "g").alias("rep"), *[c for c in members.columns if c.startswith("w") or c == "subs"])
    queries = coded(asked, codes, plan, dim).withColumnRenamed("id", "query_id")
    met = retrieve(index, queries, plan).select("query_id", "rep.*")
    pairs = met.join(members.select("rep", "h", "g", F.col("id").alias("vec_id")), ["rep", "h", "g"]).where("query_id != vec_id")
    keyed = rows.select(F.col("id").alias("vec_id"), F.xxhash64("v").alias("h"), "v")
    both = pairs.select("query_id", "vec_id", "h").join(keyed, ["vec_id", "h"]).join(asked.select(F.col("id").alias("query_id"), F.col("v").alias("qv")), "query_id")
    best = materialize(_top(distances(both, dim), k))
    full = best.groupBy("query_id").count().where(F.col("count") >= k).select(F.col("query_id").alias("id"))
    short = materialize(asked.join(full, "id", "left_anti"))
    blocks = -(-short.count() // QUERY_BLOCK)
    if blocks:
        best = best.join(short.select(F.col("id").alias("query_id")), "query_id", "left_anti")
    for b in range(blocks):
        mine = short.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b)
        best = best.unionByName(materialize(_top(scan(rows, mine, dim, k), k)))
    return best.select("query_id", "rank", "vec_id", "score")
