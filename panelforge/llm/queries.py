"""The thin queries over the operators of this subpackage, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import once
from . import secrets
from .ann import neighbours
from .common import table
from .dedup_exact import exact_dedup
from .langid import identify
from .mixing import mix
from .packing import pack
from .periodic import periodic_runs
from .pii import pseudonymise
from .quality import BUCKETS, CLEAN_WEIGHT, MAX_REPEAT_PERCENT, MIN_WORDS, MIX, judge
from .sharding import feistel_shards
from .simhash import near_components
from .url_filter import RULES, SOFT, SOFT_LIMIT, STRICT, judge_urls
from .vector_codes import compress, digest, hex_code


def op1_simhash_bktree(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = near_components(table(spark, sf_dir, "documents"), words=3)
    return near.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op2_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, k=10)


def op3_zstd_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


#: op4: target shares in proportion to the square root of a source's rows, as many rows as there are.
MIX_SEED, MIX_TEMPERATURE = "mix", 0.5


def op4_poisson_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(table(spark, sf_dir, "documents"), MIX_SEED, temperature=MIX_TEMPERATURE)
    return out.select("row.doc_id", "row.source", F.col("copy").cast("bigint").alias("copy"), F.col("copies").cast("bigint").alias("copies"), F.round("rate", 6).alias("rate"), "shuffle_key", F.md5(F.coalesce("row.text", F.lit(""))).alias("text_md5"))


#: op5: a key for demonstration; real data needs a secret one.
DEMO_KEY = "panelforge demonstration key"


def op5_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pseudonymise(table(spark, sf_dir, "documents"), DEMO_KEY)
    spans = F.transform("found", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return out.select("row.doc_id", "text", F.size("found").cast("bigint").alias("n_found"), F.concat_ws(",", spans).alias("spans"))


def op6_lp_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op7_randomness_battery(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"), keep=("doc_id",))
    counts = [F.size(k).cast("bigint").alias(f"n_{k}") for k in ("assign", "access", "hex", "random")]
    return found.select("row.doc_id", *counts, F.sha2(secrets.listed("assign", "access", "hex"), 256).alias("base_sha256"), secrets.listed(*secrets.KINDS).alias("spans"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


def op9_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = feistel_shards(table(spark, sf_dir, "documents"), n_shards=24)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_url_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge_urls(table(spark, sf_dir, "pages"), keep=("page_id",))
    return out.select("row.page_id", "host", "path", "rule", "verdict", "strict_hits", "soft_hits", "soft_weight")


def op11_vantage_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, books = compress(table(spark, sf_dir, "embeddings"))
    return out.select(F.col("id").alias("vec_id"), hex_code().alias("code"), "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def with_planted_run(id_col: str = "doc_id", text: str = "text") -> Column:
    """The text; in one document of ten a run of words is written over its end, as a place and a period drawn from its identifier say."""
    h = F.crc32(F.col(id_col).cast("string"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all(F.col(text), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))

    def over(ws: Column) -> Column:
        n = F.size(ws)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        return F.array_join(F.transform(ws, lambda w, i: F.when(i < a, w).otherwise(F.get(ws, a + (i - a) % p))), " ")

    planted = once(words, lambda ws: F.when(F.size(ws) > 0, over(ws)).otherwise(F.lit("")))
    return F.when(h % 10 == 0, planted).otherwise(F.col(text))


def op12_harmonic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = periodic_runs(table(spark, sf_dir, "documents"), with_planted_run())
    said = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    listed = F.when(F.size("runs") > 0, F.concat(said, F.lit("\n"))).otherwise(F.lit(""))
    return out.select(
        "row.doc_id", F.size("runs").cast("bigint").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_ngram_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


def _url_sql() -> str:
    low = "translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    hit = lambda t: f"regexp_matches(low, '(^|[^a-z0-9]){t}([^a-z0-9]|$)')"
    rules = sorted(RULES, key=lambda r: -(len(r.host) + len(r.path)))
    fits = lambda r: f"((host = '{r.host}' OR host LIKE '%.{r.host}') AND starts_with(path, '{r.path}'))"
    rule = "CASE " + " ".join(f"WHEN {fits(r)} THEN '{r.host + r.path}'" for r in rules) + " END"
    said = "CASE " + " ".join(f"WHEN {fits(r)} THEN '{r.verdict}'" for r in rules) + " END"
    soft = " + ".join(f"{hit(t)}::INT" for t in SOFT)
    weight = " + ".join(f"{hit(t)}::INT * {w}::DOUBLE" for t, w in SOFT.items())
    # Strict hits are counted for the report: matches with boundaries, which may share a boundary.
    strict = " + ".join(f"(len(regexp_extract_all(regexp_replace(low, '([^a-z0-9])', '\\1\\1', 'g'), '(^|[^a-z0-9]){t}([^a-z0-9]|$)')))" for t in STRICT)
    return f"""
WITH u AS (SELECT page_id, {low} AS low,
    CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, low, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
j AS (SELECT page_id, host, path, {rule} AS rule, {said} AS said,
    ({strict})::INT AS strict_hits, ({soft})::INT AS soft_hits, ({weight})::DOUBLE AS soft_weight FROM p)
SELECT page_id, host, path, rule,
    coalesce(said, CASE WHEN strict_hits > 0 OR (soft_hits > 1 AND soft_weight >= {SOFT_LIMIT}) THEN 'block' ELSE 'allow' END) AS verdict,
    strict_hits, soft_hits, soft_weight FROM j"""


_EXACT_SQL = r"""
WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
    doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM n WINDOW w AS (PARTITION BY text_sha256)"""


_H = "('0x' || substr(md5({}), 1, 15))::BIGINT"
_MIX_SQL = f"""
WITH s AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
r AS (SELECT source, (SELECT sum(n) FROM s) * pow(n::DOUBLE, {MIX_TEMPERATURE}) / (SELECT sum(pow(n::DOUBLE, {MIX_TEMPERATURE})) FROM s) / n AS rate FROM s),
c AS (SELECT source, rate, sum(exp(-rate + k * ln(rate) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS cdf
    FROM r, range(0, 100) t(k)),
d AS (SELECT doc_id, source, md5(coalesce(text, '')) AS text_md5, (({_H.format(f"'{MIX_SEED}|' || doc_id || '|1'")} >> 10) + 0.5) / pow(2, 50) AS u FROM documents),
x AS (SELECT d.doc_id, d.source, d.text_md5, c.rate, count(*) FILTER (WHERE c.cdf <= d.u) AS copies
    FROM d JOIN c ON d.source IS NOT DISTINCT FROM c.source GROUP BY ALL)
SELECT doc_id, source, unnest(range(1, copies + 1))::BIGINT AS copy, copies, round(rate, 6) AS rate, text_md5,
    {_H.format(f"'{MIX_SEED}|place|' || doc_id || '|' || copy")} AS shuffle_key FROM x WHERE copies > 0"""


def _codes_sql() -> str:
    floor_mean = "((s - ((s % n) + n) % n) // n)"
    nearest = lambda books: f"SELECT vec_id, part, any_value(p.x) AS x, min(list_sum(list_transform(list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::HUGEINT * 64 + e) AS de FROM p JOIN {books} b USING (part) GROUP BY vec_id, part"
    refined = lambda found, books: f"SELECT part, e, coalesce(m.x, b.x) AS x FROM {books} b LEFT JOIN (SELECT part, e, list({floor_mean}::BIGINT ORDER BY i) AS x FROM (SELECT part, (de % 64)::INT AS e, i, sum(x[i]) AS s, count(*)::HUGEINT AS n FROM {found}, range(1, 1 + (SELECT max(len(x)) FROM p)) t(i) GROUP BY ALL) GROUP BY part, e) m USING (part, e)"
    return f"""
WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
p AS (SELECT vec_id, k::INT AS part, v[k * (len(v) // 16) + 1:(k + 1) * (len(v) // 16)] AS x FROM kept, range(16) t(k)),
ids AS (SELECT vec_id, (row_number() OVER (ORDER BY vec_id) - 1)::INT AS e FROM kept ORDER BY vec_id LIMIT 64),
b0 AS MATERIALIZED (SELECT part, e, x FROM p JOIN ids USING (vec_id)),
f0 AS MATERIALIZED ({nearest("b0")}), b1 AS MATERIALIZED ({refined("f0", "b0")}),
f1 AS MATERIALIZED ({nearest("b1")}), b2 AS MATERIALIZED ({refined("f1", "b1")}),
f2 AS MATERIALIZED ({nearest("b2")}),
c AS (SELECT vec_id, string_agg(printf('%02x', (de % 64)::INT), '' ORDER BY part) AS code, sum(de // 64)::BIGINT AS error FROM f2 GROUP BY vec_id)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
    (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, e)) FROM b2) AS codebooks_sha256 FROM c JOIN kept USING (vec_id)"""


def _quality_sql() -> str:
    ws = r"\x20\x09-\x0D"
    wide = r"a-z0-9\x{80}-\x{10FFFF}"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
g AS (SELECT doc_id, min((quality = 1 AND toxic = 0)::INT) FILTER (WHERE quality IS NOT NULL AND toxic IS NOT NULL) AS good, min((quality = 1)::INT) FILTER (WHERE quality IS NOT NULL) AS fine FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
h AS (SELECT rid, list_transform(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[{wide}]+|[^{wide}{ws}]+'), lambda t: ('0x' || substr(md5(t), 1, 7))::BIGINT) AS h FROM d),
n AS (SELECT rid, unnest(list_concat(list_transform(h, lambda x: x % {BUCKETS}), list_transform(list_zip(h[:-2], h[2:]), lambda z: (z[1] * {MIX} + z[2] + 1) % {BUCKETS}))) AS bucket FROM h),
c AS (SELECT bucket, count(*) AS raw, count(*) FILTER (WHERE good = 1) AS target FROM n JOIN d USING (rid) LEFT JOIN g USING (doc_id) GROUP BY bucket),
t AS (SELECT sum(raw)::BIGINT AS raw_all, sum(target)::BIGINT AS target_all FROM c),
r AS (SELECT bucket, CASE WHEN target_all > 0 THEN floor(ln(((target * raw_all)::DOUBLE / target_all / raw + 1.0::DOUBLE) / 2.0::DOUBLE) * 1e6::DOUBLE + 0.5::DOUBLE)::BIGINT ELSE 0 END AS micro FROM c, t),
sc AS (SELECT rid, floor(sum(micro)::DOUBLE / (count(*) * 1000))::BIGINT AS step FROM n JOIN r USING (bucket) GROUP BY rid),
w AS (SELECT rid, regexp_extract_all(text, '[^{ws}]+') AS w FROM d),
x AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
rep AS (SELECT rid, count(DISTINCT i + k) AS n FROM (SELECT rid, i FROM x QUALIFY count(*) OVER (PARTITION BY rid, s) > 1), range(3) o(k) GROUP BY rid),
b AS (SELECT rid, doc_id, len(w) AS n_words, length(regexp_replace(text, '[{ws}]+', '', 'g')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
    len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words
    FROM (SELECT *, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^{ws}]')) AS l FROM d) JOIN w USING (rid) LEFT JOIN rep USING (rid)),
j AS (SELECT b.*, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed, step, fine FROM b LEFT JOIN sc USING (rid) LEFT JOIN g USING (doc_id)),
e AS (SELECT step, sum(fine) AS fine, sum(1 - fine) AS poor FROM j WHERE NOT base_failed AND step IS NOT NULL AND fine IS NOT NULL GROUP BY step),
k AS (SELECT arg_min(step, cost * 1000000 + o) AS cut, max(any_fine) AS any_fine FROM (SELECT step, row_number() OVER (ORDER BY step) AS o, sum(fine) OVER () AS any_fine,
    {CLEAN_WEIGHT} * coalesce(sum(fine) OVER (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + sum(poor) OVER (ORDER BY step ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS cost FROM e))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(any_fine IS NULL OR any_fine = 0 OR step >= cut, true) AS kept, step / 1000.0::DOUBLE AS score FROM j, k"""


def queries() -> dict:
    return {f.__name__: f for f in (op1_simhash_bktree, op2_multi_index_hashing, op3_zstd_language, op4_poisson_mixture, op5_feistel_pseudonyms, op6_lp_packing, op7_randomness_battery, op8_exact_dedup, op9_feistel_shards, op10_url_vocabulary, op11_vantage_codes, op12_harmonic_runs, op13_ngram_ratio)}


def oracle_sql() -> dict[str, str]:
    return {"op4_poisson_mixture": _MIX_SQL, "op8_exact_dedup": _EXACT_SQL, "op10_url_vocabulary": _url_sql(), "op11_vantage_codes": _codes_sql(), "op13_ngram_ratio": _quality_sql()}
