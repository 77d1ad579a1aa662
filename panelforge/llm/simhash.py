"""SimHash near-dedup with BK-trees over exact shards of fingerprint space.

Fingerprints are 64-bit SimHashes over word shingles.  Two fingerprints link when at
most two bits differ.  The search is exact:

* Pigeonhole shards.  Cut 64 bits into four blocks; two fingerprints within two bits
  agree on at least two whole blocks, so they share one of six (block pair, value)
  shards.  A shard with more than ``SHARD_ROWS`` fingerprints is cut again in the same
  way over its free bits: 64 -> 32 -> 16 -> 8 free bits, so that a shard has at most
  256 fingerprints after the third cut, however large a group of near copies is.
* One BK-tree per shard (children keyed by their integer Hamming distance to the
  parent); a lookup follows only edges within the radius of the distance.  Trees are
  built where their shard's rows already are, rather than broadcast: the set of all
  fingerprints grows with the input and has no bound that would allow a broadcast.
* A shard gives a spanning forest of its links, never all pairs; components are then
  joined by min-label contraction over those links, in distributed rounds.

Defined cases: null and white-space-only texts have fingerprint zero and are linked as
any other; fewer words than a shingle give one shingle of all words; repeated rows are
one node; null identifiers are larger than any other; very long texts are hashed whole, in
chunks of shingles; an empty table gives an empty result; other columns pass by.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, drop_keys, materialize, spread_join
from .similar import similar_links

RADIUS = 2
#: Fingerprints of a shard before it is cut again.
SHARD_ROWS = 512
_PAIRS = ((0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3))


def simhash64(text: str | None, words: int = 3, seed: int = 42, chunk: int = 65_536) -> int:
    """SimHash of a whole text; memory stays bounded for very long texts."""
    if not text:
        return 0
    tokens = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII case and ASCII white space only
    if not tokens:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(tokens) <= words:
        hashes = [digest(b" ".join(tokens), seed)]
        return hashes[0]
    n, counts = len(tokens) - words + 1, np.zeros(64, np.int64)
    for at in range(0, n, chunk):
        hashes = [digest(b" ".join(tokens[i : i + words]), seed) for i in range(at, min(n, at + chunk))]
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fp (the 64 bits as a signed long) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((simhash64(t.as_py(), words) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["id", "fp"])

    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, fp long")


class BKTree:
    """Nodes are fingerprints; a child's key is its Hamming distance to its parent."""

    __slots__ = ("values", "children")

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> int:
        """Insert; returns the node (an existing one if the value is there)."""
        if not self.values:
            self.values.append(value)
            self.children.append({})
            return 0
        at = 0
        while d := (value ^ self.values[at]).bit_count():
            if (nxt := self.children[at].get(d)) is None:
                self.children[at][d] = len(self.values)
                self.values.append(value)
                self.children.append({})
                return len(self.values) - 1
            at = nxt
        return at

    def within(self, value: int, radius: int) -> list[int]:
        """Nodes at most ``radius`` bits away."""
        found, todo = [], [0] if self.values else []
        while todo:
            at = todo.pop()
            d = (value ^ self.values[at]).bit_count()
            if d <= radius:
                found.append(at)
            kids = self.children[at]
            for k in range(max(1, d - radius), d + radius + 1):
                if k in kids:
                    todo.append(kids[k])
        return found


def shard_links(values: list[int], radius: int = RADIUS) -> Iterator[tuple[int, int]]:
    """Spanning forest of the links among a shard's distinct values, as (i, root) indices."""
    tree, parent = BKTree(), list(range(len(values)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, v in enumerate(values):
        for j in tree.within(v, radius):
            a, b = root(i), root(j)
            if a != b:
                parent[max(a, b)] = min(a, b)
        tree.add(v)
    return ((i, r) for i in range(len(values)) if (r := root(i)) != i)


def _tree_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (shard, node) -> links (node, root node) of each shard."""
    shard, fps, nodes, out_a, out_b = None, [], [], [], []

    def close() -> None:
        if len(fps) > 1:
            for i, r in shard_links([f & 0xFFFFFFFFFFFFFFFF for f in fps]):
                out_a.append(nodes[i])
                out_b.append(nodes[r])

    def batch() -> pa.RecordBatch:
        b = pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])
        out_a.clear(), out_b.clear()
        return b

    for b in batches:
        for s, f, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
            if s != shard:
                close()
                shard, fps, nodes = s, [], []
            fps.append(f)
            nodes.append(n)
        if len(out_a) > 50_000:
            yield batch()
    close()
    yield batch()


def _cut(rows: DataFrame, level: int) -> DataFrame:
    """Each row into the six shards of its shard; free bits are cut into four blocks.

    ``free`` holds the free bits, packed; ``level`` 0, 1, 2 has 64, 32, 16 of them.
    """
    width = 16 >> level
    mask = (1 << width) - 1
    block = [F.shiftrightunsigned(F.col("free"), width * k).bitwiseAND(F.lit(mask)) for k in range(4)]
    cuts = []
    for c, (i, j) in enumerate(_PAIRS):
        k, m = (x for x in range(4) if x not in (i, j))
        held = F.shiftleft(block[i], width).bitwiseOR(block[j])
        rest = F.shiftleft(block[k], width).bitwiseOR(block[m])
        cuts.append(F.struct(F.concat("shard", F.array(F.lit(c).cast("bigint"), held)).alias("shard"), rest.alias("free")))
    return rows.withColumn("cut", F.explode(F.array(*cuts))).select("cut.shard", "cut.free", "fp", "node")


def fingerprint_links(nodes: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints within two bits.

    ``nodes``: fp long, node long, one row per distinct fingerprint.
    """
    rows = nodes.select(F.array().cast("array<bigint>").alias("shard"), F.col("fp").alias("free"), "fp", "node")
    links = None
    for level in range(3):
        rows = _cut(rows, level)
        if level < 2:
            rows = materialize(rows)
            large = materialize(rows.groupBy("shard").count().where(F.col("count") > shard_rows).select("shard"))
            small = rows.join(large, "shard", "left_anti")
        else:
            small = rows
        # The shards are 1/6 of a table each at most in number of rows, and short: a task
        # holds one shard's fingerprints at a time.
        out = small.select(F.concat_ws(",", F.col("shard").cast("array<string>")).alias("shard"), "fp", "node").repartition("shard").sortWithinPartitions("shard", "node").mapInArrow(_tree_links, "a long, b long")
        links = out if links is None else links.unionByName(out)
        if level == 2 or large.isEmpty():
            break
        rows = rows.join(large, "shard", "left_semi")
    return links


def near_components(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fp, component (smallest id of the component) for every row."""
    prints = materialize(fingerprints(docs, words, id_col, text_col))
    big = F.lit(2**63 - 1)
    nodes = materialize(prints.groupBy("fp").agg(F.min(F.coalesce("id", big)).alias("node"), F.count(F.lit(1)).alias("n")))
    linked = components(fingerprint_links(nodes.select("fp", "node")))
    label = nodes.join(linked, "node", "left").select("fp", "n", F.coalesce("component", "node").alias("component"))
    return spread_join(prints, label, "fp", prints.count(), "id").select("id", "fp", F.nullif("component", big).alias("component"))


def row_key(id_col: str, text_col: str):
    """The identifier; for a null one a number above all others, by the text."""
    text = F.col(text_col)
    own = F.lit(2**63 - 1) - F.pmod(F.xxhash64(F.coalesce(text, F.lit("")), text.isNull()), F.lit(2**40))
    return F.coalesce(F.col(id_col).cast("bigint"), own)


def text_node(text_col: str):
    """A row's node: the hash of its text."""
    return F.xxhash64(text_col, F.col(text_col).isNull())


def text_check(text_col: str):
    """A second, independent hash, by which two texts of one node are told apart."""
    return F.hash(text_col, F.col(text_col).isNull())


def similar_components(docs: DataFrame, words: int = 5, similarity: float = 0.8, text_col: str = "text") -> DataFrame:
    """node, component over the fingerprint links and the links of shingle similarity.

    Nodes are texts (``text_node``), so that different texts of one identifier stay apart.
    """
    texts = docs.select(text_node(text_col).alias("id"), F.col(text_col).alias("text"))
    prints = materialize(fingerprints(texts, words, "id", "text").distinct())
    nodes = materialize(prints.groupBy("fp").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("n")))
    same = spread_join(prints, nodes, "fp", prints.count(), "id").where("id != node").select(F.col("id").alias("a"), F.col("node").alias("b"))
    links = fingerprint_links(nodes.select("fp", "node")).unionByName(same).unionByName(similar_links(texts, words, similarity, "id", "text"))
    linked = components(links)
    return prints.select(F.col("id").alias("node")).join(linked, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def drop_near_copies(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component of near copies: the smallest id stays.

    Rows that repeat an id are judged by their texts, each on its own; of those in one
    component the one with the smallest hash of its text stays.  Should two different texts share
    a node, one of them (by a second hash) stands for it, and rows of the other are kept.
    """
    keys = ["id", "node", "check"]
    key = [row_key(id_col, text_col).alias("id"), text_node(text_col).alias("node"), text_check(text_col).alias("check")]
    labels = similar_components(docs, words, similarity, text_col)
    rows = materialize(docs.select(*key).groupBy(*keys).agg(F.count(F.lit(1)).alias("n")))
    # Most rows of a node bear one text; a text that fills a third of the table is dealt over parts.
    sizes = rows.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("check").alias("main")).join(labels, "node")
    found = materialize(spread_join(rows.withColumnRenamed("n", "times"), sizes, "node", rows.count(), "id").where("check = main"))
    first = found.groupBy("component").agg(F.min(F.struct("id", "node")).alias("first")).select("first.*")
    said = found.join(first.withColumn("kept", F.lit(True)), ["id", "node"], "left")
    return drop_keys(docs.select(F.struct("*").alias("row"), *key), keys, said.where("kept IS NULL").select(*keys), said.where("kept AND times > 1").select(*keys)).select("row.*")
