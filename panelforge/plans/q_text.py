"""Titles, numbers, dates, mark-up, snippets, matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import timeops as T
from ..operators import matcher, reports
from . import base as B
from .registry import query

# Titles are made from order keys: prefixes, known and unknown tags.
_TITLE = """CASE o_orderkey % 4 WHEN 0 THEN 'Re: ' WHEN 1 THEN 'Fw: Re: ' ELSE '' END || CASE o_orderkey % 7 WHEN 0 THEN '[標的]' WHEN 1 THEN '[新聞]' WHEN 2 THEN '[心得]' WHEN 3 THEN '[雜談]' WHEN 4 THEN '' WHEN 5 THEN '[請益]' ELSE '[問卷]' END || ' ' || o_orderpriority"""
_CATS = "|".join(X.CATEGORIES)


@query(f"""WITH t AS (SELECT o_orderkey, {_TITLE} AS title FROM orders),
p AS (SELECT o_orderkey, regexp_extract(title, '^(?:(?:Re|Fw|RE|FW):\\s*)*\\[({_CATS})\\]', 1) AS known, regexp_matches(title, '^(?:(?:Re|Fw|RE|FW):\\s*)*\\[[^\\]]{{1,6}}\\]') AS tagged, regexp_matches(title, '^(?:Re|Fw|RE|FW):') AS is_reply FROM t),
c AS (SELECT o_orderkey, is_reply, CASE WHEN known <> '' THEN known WHEN tagged THEN '其他' ELSE '未分類' END AS category FROM p)
SELECT o_orderkey, category, is_reply, CASE WHEN category = '標的' THEN CASE WHEN is_reply THEN 'mid_effort' ELSE 'high_effort' END WHEN category IN ('請益', '心得') THEN 'mid_effort' WHEN category IN ('新聞', '閒聊', '情報', '公告', '爆卦', '投顧') THEN 'low_effort' ELSE 'unclassified' END AS effort FROM c""")
def title_parse(spark, d):
    t = B.read(spark, d, "orders").select("o_orderkey", F.expr(_TITLE).alias("title"))
    c, r = X.title_category(F.col("title")), X.is_reply(F.col("title"))
    return t.select("o_orderkey", c.alias("category"), r.alias("is_reply"), X.effort_tier(c, r).alias("effort"))


@query(r"""SELECT page_id, trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(html, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '<[^>]+>', ' ', 'g'), '[\s ]+', ' ', 'g')) AS text FROM pages""")
def html_strip_basic(spark, d):
    return B.read(spark, d, "pages").select("page_id", X.strip_html(F.col("html")).alias("text"))


_NUM = "CASE c_custkey % 4 WHEN 0 THEN '1,' || lpad((c_custkey % 1000)::VARCHAR, 3, '0') WHEN 1 THEN 'NT$ ' || c_custkey || '.50' WHEN 2 THEN '-' || c_custkey || ' ' ELSE '--' END"


@query(f"WITH t AS (SELECT c_custkey, {_NUM} AS raw FROM customer) SELECT c_custkey, CASE WHEN try_cast(regexp_replace(raw, '[^0-9.\\-]', '', 'g') AS DOUBLE) > 0 THEN try_cast(regexp_replace(raw, '[^0-9.\\-]', '', 'g') AS DOUBLE) END AS price, try_cast(regexp_replace(raw, '[^0-9.\\-]', '', 'g') AS DOUBLE) AS number, coalesce(try_cast(regexp_replace(raw, '[^0-9\\-]', '', 'g') AS DOUBLE), 0) AS shares FROM t")
def number_clean(spark, d):
    t = B.read(spark, d, "customer").select("c_custkey", F.expr(_NUM.replace("::VARCHAR", "").replace("(c_custkey % 1000)", "CAST(c_custkey % 1000 AS STRING)")).alias("raw"))
    raw = F.col("raw")
    return t.select("c_custkey", X.number(raw, True).alias("price"), X.number(raw).alias("number"), X.shares(raw).alias("shares"))


_ROC = """CASE o_orderkey % 4 WHEN 0 THEN lpad((year(o_orderdate) - 1911)::VARCHAR, 3, '0') || strftime(o_orderdate, '%m%d') WHEN 1 THEN strftime(o_orderdate, '%Y%m%d') WHEN 2 THEN (year(o_orderdate) - 1911) || '年' || strftime(o_orderdate, '%m月%d日') ELSE (year(o_orderdate) - 1911) || '/13/40' END"""


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 3 THEN o_orderdate::DATE END AS parsed FROM orders")
def roc_date_parse(spark, d):
    y = "CAST(year(o_orderdate) - 1911 AS STRING)"
    raw = f"""CASE o_orderkey % 4 WHEN 0 THEN lpad({y}, 3, '0') || date_format(o_orderdate, 'MMdd') WHEN 1 THEN date_format(o_orderdate, 'yyyyMMdd') WHEN 2 THEN {y} || '年' || date_format(o_orderdate, 'MM') || '月' || date_format(o_orderdate, 'dd') || '日' ELSE {y} || '/13/40' END"""
    return B.read(spark, d, "orders").select("o_orderkey", T.roc_date(F.expr(raw)).alias("parsed"))


_AT = "right(array_to_string(p[:{k}], 'license'), 120) || '【license】' || left(array_to_string(p[{k} + 1:], 'license'), 120)"


@query("WITH h AS (SELECT doc_id, string_split(text, 'license') AS p FROM documents WHERE contains(text, 'license')), n AS (SELECT *, unnest(range(1, least(len(p) - 1, 3) + 1)) AS k FROM h) SELECT doc_id, k::INT AS hit, " + _AT.format(k="k") + " AS snippet FROM n")
def snippet_windows(spark, d):
    x = B.read(spark, d, "documents").where(F.col("text").contains("license"))
    hits = F.posexplode(X.snippets(F.col("text"), "license")).alias("i", "snippet")
    return x.select("doc_id", hits).select("doc_id", (F.col("i") + 1).alias("hit"), "snippet")


# Titles for the two parsers: other cases, full-width colons, blanks inside the brackets.
_ODD = """CASE o_orderkey % 5 WHEN 0 THEN 're: ' WHEN 1 THEN 'Re：' WHEN 2 THEN '  Fw: Re: ' WHEN 3 THEN 'Re: ' ELSE '' END || CASE o_orderkey % 7 WHEN 0 THEN '[標的]' WHEN 1 THEN '[ 新聞 ]' WHEN 2 THEN '[心得]' WHEN 3 THEN '[雜談]' WHEN 4 THEN '' WHEN 5 THEN '[很長很長的標籤]' ELSE '[這個標籤實在太長了吧]' END || ' x'"""
_AGREE = f"""t AS (SELECT o_orderkey, {_ODD} AS title FROM orders), s AS (SELECT *, trim(title) AS tt FROM t),
p AS (SELECT *, regexp_extract(tt, '^(?:(?:Re|Fw|RE|FW):\\s*)*\\[({_CATS})\\]', 1) AS known, regexp_matches(tt, '^(?:(?:Re|Fw|RE|FW):\\s*)*\\[[^\\]]{{1,6}}\\]') AS tagged, regexp_matches(tt, '^(?:Re|Fw|RE|FW):') AS is_reply,
    regexp_matches(title, '(?i)^\\s*(?:(?:re|fw)\\s*[:：]\\s*)*\\[\\s*[^\\]]{{1,8}}\\s*\\]') AS itag, trim(regexp_extract(title, '(?i)^\\s*(?:(?:re|fw)\\s*[:：]\\s*)*\\[\\s*([^\\]]{{1,8}})\\s*\\]', 1)) AS icat0, regexp_matches(title, '(?i)^\\s*(?:re|fw)\\s*[:：]') AS ireply FROM s),
c AS (SELECT o_orderkey, CASE WHEN known <> '' THEN known WHEN tagged THEN '其他' ELSE '未分類' END AS category, is_reply, CASE WHEN itag THEN icat0 ELSE '未分類' END AS independent_category, ireply AS independent_is_reply FROM p),
g AS (SELECT *, category = independent_category OR (category = '其他' AND independent_category <> '未分類') OR (category = '未分類' AND independent_category = '未分類') AS category_agree, is_reply = independent_is_reply AS reply_agree FROM c)"""


def _agreement(spark, d):
    t = B.read(spark, d, "orders").select("o_orderkey", F.expr(_ODD).alias("title"))
    return t.select("o_orderkey", X.title_agreement(F.col("title")).alias("a")).select("o_orderkey", "a.*")


@query("WITH " + _AGREE + " SELECT *, category_agree AND reply_agree AS both_agree FROM g")
def title_parser_agreement(spark, d):
    return _agreement(spark, d)


@query("WITH " + _AGREE + " SELECT count(*) AS n, round(avg((category_agree AND reply_agree)::INT), 6) AS agreement_rate, round(avg(category_agree::INT), 6) AS category_agreement, round(avg(reply_agree::INT), 6) AS reply_agreement, round(avg(is_reply::INT), 6) AS share_reply, avg((category_agree AND reply_agree)::INT) > 0.95 AS passed FROM g")
def title_agreement_rates(spark, d):
    x = reports.title_agreement_rates(_agreement(spark, d))
    return x.select("n", *[F.round(c, 6).alias(c) for c in ("agreement_rate", "category_agreement", "reply_agreement", "share_reply")], "passed")


def demo_dictionary() -> matcher.Dictionary:
    return matcher.Dictionary([matcher.Name("1001", "License"), matcher.Name("1002", "Apache License"), matcher.Name("1003", "MIT", "name_with_context"), matcher.Name("1004", "General Public", not_before=("License",))])


@query("""SELECT doc_id, ticker, match_mode FROM (SELECT doc_id, '1001' AS ticker, 'name' AS match_mode FROM documents WHERE contains(replace(text, 'Apache License', ''), 'License') UNION ALL SELECT doc_id, '1002', 'name' FROM documents WHERE contains(text, 'Apache License'))""")
def dictionary_matcher(spark, d):
    x = B.read(spark, d, "documents").select("doc_id", F.lit("").alias("title"), F.col("text").alias("body"))
    return matcher.bridge(x, demo_dictionary()).select("doc_id", "ticker", "match_mode")


# Invented entities, and for every class of evidence texts with what must be found in them.
_N = matcher.Name
CASE_NAMES = [
    _N("4101", "海岸水泥"), _N("4102", "海岸", "name_with_context", not_after=("大",), not_before=("證券", "投信", "銀行", "大學")), _N("4103", "東林", "name_with_context"), _N("4104", "東林鋼業"),
    _N("2015", "豐實", "name_with_context"), _N("2007", "長橋"), _N("4105", "長名電子股份"), _N("4106", "聯聚", "name_with_context", not_after=("互",), not_before=("平台",)), _N("4107", "冠領", "name_with_context"),
]
CASE_DICTIONARY = matcher.Dictionary(CASE_NAMES, code_only={"4107"}, codes={n.entity for n in CASE_NAMES} | {"4400", "4555"})
CASES: list[tuple[str, dict[str, str]]] = [
    # longest spelling first, and across entities
    ("海岸水泥 今日大漲", {"4101": "name"}), ("東林鋼業 股價看好", {"4104": "name"}), ("東林 的營收", {"4103": "name_with_context"}),
    # short names need context
    ("海岸 很美", {}), ("海岸 的目標價", {"4102": "name_with_context"}),
    # longer entities around a short name
    ("海岸證券 股價", {}), ("海岸  銀行 財報", {}), ("大海岸 停損", {}), ("大 海岸 停損", {}), ("海岸大學的學生 股票", {}), ("互聯聚寶 股價", {}), ("聯聚 平台 股票", {}), ("聯聚與海岸 爆量 收黑 股價", {"4102": "name_with_context", "4106": "name_with_context"}),
    # a rejected longer place does not hide a later one
    ("海岸證券說海岸 股價", {"4102": "name_with_context"}),
    # codes, also full width and next to brackets
    ("買 4101 進場", {"4101": "code"}), ("４１０１ 不錯", {"4101": "code"}), ("海岸水泥(4101)", {"4101": "code"}), ("觀察 4101、4103、4555的線型", {"4101": "code", "4103": "code", "4555": "code"}), ("聯聚 (4106-TW) 具備產能", {"4106": "code"}),
    # code only entities
    ("冠領 股價 績效", {}), ("4107 冠領 適合存股嗎", {"4107": "code"}),
    # year-like codes
    ("回顧 2015 年的行情", {}), ("從 2015 到 2020", {}), ("2015 這檔如何", {"2015": "code"}), ("豐實 2015 財報", {"2015": "code"}), ("2007 大跌", {}), ("長橋 2007", {"2007": "code"}),
    # prices, amounts, dates and units
    ("漲到 4400 點", {}), ("約4400 元", {}), ("4400張設質", {}), ("共 4400 人", {}), ("4400/12 的事", {}), ("12/4400 的事", {}), ("4400.5", {}), ("累計 4400 例", {}), ("持有4400噸黃金", {}), ("有4400件申訴", {}), ("a4400 與 4400b", {}), ("44001", {}),
    # columns of figures
    ("+4400   2. 廣記  -4555", {}), ("25  超好  971    25  華好  -4400", {}), ("100  4400  200", {}), ("3706  神奇          4400      1823        14    24.86", {}), ("29      大成          4400            29      宇宙", {}), ("1  4101海岸水泥   市  1430  37.45", {"4101": "code"}), ("4103    東林    17.8    4,186   元富", {"4103": "code"}),
    # example lines of a form
    ("(例 4400 長名電子股份)\n內文", {}), ("ex [標的] 4400.TW 長名電子股份 多\n1. 標的:4103 東林", {"4103": "code"}), ("按 ctrl+Y 刪除 4400\n正文", {}), ("例: 4400\n長名電子股份", {"4105": "name"}),
    # several at once; a code beats a name
    ("4400 與 長名電子股份", {"4400": "code", "4105": "name"}), ("長名電子股份 4105", {"4105": "code"}), ("", {}),
]
_EXPECTED = ", ".join(f"({i}, '{e}', '{m}')" for i, (_, found) in enumerate(CASES) for e, m in found.items())


@query(f"SELECT o_orderkey, ticker, match_mode FROM orders JOIN (VALUES {_EXPECTED}) e(k, ticker, match_mode) ON (o_orderkey // 2) % {len(CASES)} = k")
def matcher_classes(spark, d):
    """Every class of evidence for and against a mention, once per order."""
    texts = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "k int, body string")
    x = B.read(spark, d, "orders").select("o_orderkey", F.expr(f"CAST((o_orderkey DIV 2) % {len(CASES)} AS INT)").alias("k"))
    rows = x.join(F.broadcast(texts), "k").select("o_orderkey", F.lit(None).cast("string").alias("title"), "body")
    return matcher.bridge(rows, CASE_DICTIONARY).select("o_orderkey", "ticker", "match_mode")
