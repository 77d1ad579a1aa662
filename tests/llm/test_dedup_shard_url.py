import hashlib
import re
import types
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from panelforge.functions.arrays import running
from panelforge.llm import common, vocabulary
from panelforge.llm import queries as Q
from panelforge.llm.common import permute_below, spread_join
from panelforge.llm.dedup_exact import drop_copies, exact_dedup
from panelforge.llm.sharding import feistel_shards, place
from panelforge.llm.url_filter import build, hits, judge_urls

from .helpers import ODD, docs


def sha(t):
    return hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", t or "").encode()).hexdigest()


def test_exact_dedup_odd_rows(spark):
    rows = exact_dedup(docs(spark, ODD), fan_in=2).collect()
    assert len(rows) == len(ODD)
    groups = defaultdict(list)
    for i, t, *_ in ODD:
        groups[sha(t)].append(i)
    for r in rows:
        ids = [i for i in groups[r.text_sha256] if i is not None]
        assert r.group_size == len(groups[r.text_sha256])
        assert r.keep_id == (min(ids) if ids else None)
    assert Counter(r.text_sha256 for r in rows if r.kept) == Counter(groups.keys())
    assert all(r.id == r.keep_id for r in rows if r.kept)


def test_drop_copies_keeps_columns_and_one_of_each(spark):
    d = docs(spark, ODD)
    out = drop_copies(d)
    assert out.columns == d.columns
    assert sorted(sha(r.text) for r in out.collect()) == sorted({sha(t) for _, t, *_ in ODD})


def test_deep_tree_with_a_hot_digest(spark):
    d = spark.range(3000, numPartitions=40).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), F.col("id") % 1500)).alias("text"))
    rows = exact_dedup(d, fan_in=2).collect()
    assert {r.group_size for r in rows if r.id % 3 == 0} == {1000}
    assert {r.keep_id for r in rows if r.id % 3 == 0} == {0}
    assert all(r.keep_id == r.id % 1500 and r.group_size == 2 for r in rows if r.id % 3)


def test_empty_tables(spark):
    none = docs(spark, ODD).where("false")
    assert exact_dedup(none).count() == 0
    assert drop_copies(none).count() == 0
    assert feistel_shards(none).count() == 0


def test_shards(spark):
    d = docs(spark, ODD)
    rows = feistel_shards(d, 3).collect()
    assert sorted((r.doc_id or -1, r["size"], r.text_crc32) for r in rows) == sorted((i or -1, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in ODD)
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    again = feistel_shards(d.repartition(7), 3).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


@pytest.mark.parametrize("n", [1, 2, 3, 7, 24, 100, 1001, 4999])
def test_permutation_is_whole(spark, n):
    out = spark.range(n).select(permute_below(F.col("id"), n, "k").alias("p")).collect()
    assert sorted(r.p for r in out) == list(range(n))


def test_shard_query(spark, sf):
    rows = Q.op9_feistel_shards(spark, sf).collect()
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    c = Counter(r.shard for r in rows)
    assert len(rows) == n and set(c) == set(range(24)) and max(c.values()) - min(c.values()) <= 1
    assert {r.law for r in rows} == {"rows"} and all(r.grown_shard is None for r in rows)


def test_vocabulary_boundaries():
    auto = build({"casino": 1.0}, {"spam": 1.0, "farm": 1.0})
    assert hits(auto, "http://CASINO.com/") == (1, set())
    assert hits(auto, "http://casinos.com/xcasino/") == (0, set())
    assert hits(auto, "http://a-casino_casino.b") == (2, set())
    assert hits(auto, "http://spam.spam/farm") == (0, {"spam", "farm"})


def test_url_rules(spark):
    urls = [None, "", "no scheme/en/", "http://A.COM/en/x", "https://sub.example.com/en/77?x", "http://example.com/en/8", "http://example.net/de/81#f", "http://x.example.net/de/9", "http://notexample.net/de/8", "http://b.org/es/", "http://org", "http://casino.x.org/fr/?q", "http://spam.x/", "http://spam-farm.x/", "ftp://x?://casino", "casino without scheme", "http://x.y/free/cheap"]
    d = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.row.page_id: (r.host, r.path, r.rule, r.verdict) for r in judge_urls(d).collect()}
    assert got[0] == got[1] == got[2] == ("", "", None, "allow")
    assert got[3] == ("a.com", "/en/x", "com/en/", "block")
    assert got[4] == ("sub.example.com", "/en/77", "example.com/en/7", "allow")
    assert got[5][2:] == ("com/en/", "block")
    assert got[6] == ("example.net", "/de/81", "example.net/de/8", "block")
    assert got[7][2:] == ("net/de/", "allow")
    assert got[8][2:] == ("net/de/", "allow")
    assert got[9] == ("b.org", "/es/", "org/es/", "block")
    assert got[10] == ("org", "", None, "allow")
    assert got[11][2:] == (None, "block")
    assert got[12][2:] == (None, "allow")
    assert got[13][2:] == (None, "block")
    assert got[14] == ("x", "", None, "block")
    assert got[15][2:] == (None, "block") and got[16][2:] == (None, "allow")
    assert judge_urls(d.where("false")).count() == 0


def test_url_weights_long_urls_repeats_and_clashing_names(spark):
    soft = {"aa": 0.5, "bb": 1.5, "cc": 3.0}
    urls = ["http://x.y/aa/bb", "http://x.y/cc/cc", "http://x.y/aa", "http://x.y/" + "z/" * 200_000 + "bb-aa", "http://x.y/aa/bb"]
    d = spark.createDataFrame([(i, u, "h", "f", "v") for i, u in enumerate(urls)], "page_id long, url string, host string, found string, verdict string")
    got = sorted(judge_urls(d, strict={}, soft=soft).collect(), key=lambda r: r.row.page_id)
    assert [r.verdict for r in got] == ["block", "allow", "allow", "block", "block"]
    assert [r.soft_weight for r in got] == [2.0, 3.0, 0.5, 2.0, 2.0]
    assert all(r.row.host == "h" and r.row.found == "f" and r.row.verdict == "v" and r.host == "x.y" for r in got)
    assert {r.verdict for r in judge_urls(d, strict={}, soft={}).collect()} == {"allow"}


def test_vocabulary_has_each_term_once():
    strict, soft = vocabulary.read("strict 1: a b\nsoft 0.5: b c\nsoft 2: c d\n")
    assert strict == {"a": 1.0, "b": 1.0} and soft == {"c": 0.5, "d": 2.0}
    strict, soft = vocabulary.read()
    assert not set(strict) & set(soft) and {"casino"} <= set(strict) and {"spam", "farm"} <= set(soft)


def test_shard_query_against_plain(spark, sf):
    """Every column of the query recomputed: size and CRC from the text, shard and slot from the row number."""
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    n = len(texts)
    rows = Q.op9_feistel_shards(spark, sf).collect()
    assert {(r.doc_id, r["size"], r.text_crc32) for r in rows} == {(i, len(t) + 8, zlib.crc32(t)) for i, t in texts.items()}
    taken = {(r.shard, r.slot) for r in rows}
    assert taken == {(p % 24, p // 24) for p in range(n)}
    numbered = feistel_shards(spark.read.parquet(f"{sf}/documents.parquet"), 24)
    assert sorted(r.row_number for r in numbered.collect()) == list(range(n))
    places = {r.row_number: r for r in numbered.select("row_number", "shard", "slot").collect()}
    alone = spark.range(n).select("id", *[c.alias(a) for c, a in zip(place(F.col("id"), n, 24, "panelforge"), ("shard", "slot"))])
    assert all((r.shard, r.slot) == (places[r.id].shard, places[r.id].slot) for r in alone.collect())


def test_equal_rows_are_spread_when_numbered(spark):
    d = spark.range(20_000, numPartitions=4).select(F.when(F.col("id") < 15_000, None).otherwise(F.col("id")).alias("doc_id"), F.lit("t").alias("text"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as where partitions are large
    try:
        out = feistel_shards(d, 5)
        rows = out.collect()
        tasks = Counter(r.p for r in out.where("doc_id IS NULL").select(F.spark_partition_id().alias("p")).collect())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(r.row_number for r in rows) == list(range(20_000))
    assert sum(r.doc_id is None for r in rows) == 15_000
    assert max(tasks.values()) < 12_000


def test_running_sums(spark):
    d = spark.createDataFrame([(i, [(7 * j) % 11 for j in range(i)]) for i in (0, 1, 2, 3, 10, 101)], "n int, x array<long>")
    for r in d.select("x", running(F.col("x")).alias("y")).collect():
        assert r.y == [sum(r.x[: k + 1]) for k in range(len(r.x))]


def test_twins_of_one_identifier_and_text(spark, monkeypatch):
    rows = [(1, "same text"), (1, "same  text"), (1, "same text"), (2, "same text"), (3, "other"), (None, "null id"), (None, "null id")]
    for limit in (500_000, 0):
        monkeypatch.setattr(common, "BROADCAST_KEYS", limit)
        got = sorted((r.doc_id or 0, " ".join(r.text.split())) for r in drop_copies(docs(spark, rows)).collect())
        assert got == [(0, "null id"), (1, "same text"), (3, "other")]


def test_hot_keys_are_dealt_over_parts(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 2)
    rows = spark.range(1000).select(F.when(F.col("id") < 700, -1).otherwise(F.col("id")).alias("k"), "id")
    t = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("m"))
    out = spread_join(rows, t, "k", 1000, "id").collect()
    assert len(out) == 1000 and all(r.m == (0 if r.k == -1 else r.id) for r in out)


def test_shared_folder_is_named_or_local():
    class Conf(dict):
        def get(self, k, default=None):
            return dict.get(self, k, default)

    def session(master, **conf):
        return types.SimpleNamespace(conf=Conf(conf), sparkContext=types.SimpleNamespace(master=master))

    assert common.shared_dir(session("spark://x", **{"spark.checkpoint.dir": "s3://b/c/"})) == "s3://b/c"
    one = common.shared_dir(session("local[2]"))
    assert one == common.shared_dir(session("local[2]"))
    for master in ("spark://x", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            common.shared_dir(session(master))
