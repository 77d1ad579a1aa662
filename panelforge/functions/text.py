"""Text columns: titles, effort tiers, mark-up, numbers, snippets."""

from __future__ import annotations

import html
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Fixed values of the title grammar and of the effort tiers.
CATEGORIES = ("標的", "新聞", "請益", "心得", "閒聊", "公告", "問卷", "其他", "情報", "創作", "爆卦", "投顧", "討論", "活動", "贈送")
MID = ("請益", "心得")
LOW = ("新聞", "閒聊", "情報", "公告", "爆卦", "投顧")
OTHER, NONE, STOCK = "其他", "未分類", "標的"
PREFIX = r"(?:(?:Re|Fw|RE|FW):\s*)"


def title_category(title: Column) -> Column:
    t = F.trim(F.coalesce(title, F.lit("")))
    known = F.regexp_extract(t, rf"^{PREFIX}*\[({'|'.join(CATEGORIES)})\]", 1)
    tagged = t.rlike(rf"^{PREFIX}*\[[^\]]{{1,6}}\]")
    return F.when(known != "", known).when(tagged, OTHER).otherwise(NONE)


def is_reply(title: Column) -> Column:
    return F.trim(F.coalesce(title, F.lit(""))).rlike(rf"^{PREFIX}+")


def effort_tier(category: Column, reply: Column) -> Column:
    return F.when(category == STOCK, F.when(reply, "mid_effort").otherwise("high_effort")).when(category.isin(*MID), "mid_effort").when(category.isin(*LOW), "low_effort").otherwise("unclassified")


def strip_template(text: Column) -> Column:
    """Example lines of a posting form, and the line about its deletion key."""
    # Every such line holds one of these words; other texts are not searched line by line.
    example = F.regexp_replace(text, r"(?md)^.*(?:\(例|（例|ex\s*\[標的\]|例\s*[:：]).*$", "")
    text = F.when(F.contains(text, F.lit("例")) | F.contains(text, F.lit("標的")), example).otherwise(text)
    return F.when(F.contains(text, F.lit("按")), F.regexp_replace(text, r"(?md)^.*按\s*[Cc]trl\+[yY].*$", "")).otherwise(text)


def strip_html(s: Column) -> Column:
    """Basic entities first, then tags to spaces, then single spaces."""
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        s = F.replace(s, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(F.regexp_replace(s, r"<[^>]+>", " "), r"[\s ]+", " "))


@F.pandas_udf(StringType())
def unescape(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """All character references of HTML, named and numbered; texts without an ampersand pass by."""
    for batch in texts:
        yield batch.map(lambda t: html.unescape(t) if t and "&" in t else t)


def strip_html_full(s: Column) -> Column:
    """As ``strip_html``, with every character reference (an Arrow stage)."""
    return F.trim(F.regexp_replace(F.regexp_replace(unescape(s), r"<[^>]+>", " "), r"[\s\u00a0]+", " "))


def independent_title(title: Column) -> tuple[Column, Column]:
    """(category, is a reply) by a second, looser grammar, to be held against the first.

    Letters of any case, white space inside the brackets, full-width colons, any tag of up
    to eight characters.
    """
    t = F.coalesce(title, F.lit(""))
    grammar = r"(?i)^\s*((?:(?:re|fw)\s*[:：]\s*)*)\[\s*([^\]]{1,8})\s*\]"
    tagged = t.rlike(grammar)
    category = F.when(tagged, F.trim(F.regexp_extract(t, grammar, 2))).otherwise(NONE)
    return category, F.when(tagged, F.regexp_extract(t, grammar, 1) != "").otherwise(t.rlike(r"(?i)^\s*(?:re|fw)\s*[:：]"))


def title_agreement(title: Column) -> Column:
    """What the two grammars say of a title, and where they agree, as a struct."""
    own, reply = title_category(title), is_reply(title)
    other, other_reply = independent_title(title)
    same = (own == other) | ((own == OTHER) & (other != NONE)) | ((own == NONE) & (other == NONE))
    return F.struct(own.alias("category"), reply.alias("is_reply"), other.alias("independent_category"), other_reply.alias("independent_is_reply"), same.alias("category_agree"), (reply == other_reply).alias("reply_agree"), (same & (reply == other_reply)).alias("both_agree"))


def number(s: Column, positive: bool = False) -> Column:
    """Digits, sign and point of a text as a double; null if none (or not positive)."""
    x = F.regexp_replace(s, r"[^0-9.\-]", "").try_cast("double")
    return F.when(x > 0, x) if positive else x


def shares(s: Column) -> Column:
    """A share count with thousands separators; blank or broken is 0."""
    return F.coalesce(F.regexp_replace(s, r"[^0-9\-]", "").try_cast("double"), F.lit(0.0))


def stars(t: Column) -> Column:
    a = F.abs(t)
    return F.when(a >= 2.576, "***").when(a >= 1.96, "**").when(a >= 1.645, "*").otherwise("")


def snippets(text: Column, needle: str, reach: int = 120, most: int = 3) -> Column:
    """The first ``most`` hits of a literal, marked, with ``reach`` characters around."""
    parts = F.split(text, "\\Q" + needle + "\\E", -1)
    hits = F.least(F.size(parts) - 1, F.lit(most))
    one = lambda k: F.concat(
        F.right(F.array_join(F.slice(parts, F.lit(1), k), needle), F.lit(reach)),
        F.lit(f"【{needle}】"),
        F.left(F.array_join(F.slice(parts, k + 1, F.size(parts) - k), needle), F.lit(reach)),
    )
    return F.when(hits > 0, F.transform(F.sequence(F.lit(1), F.greatest(hits, F.lit(1))), one)).otherwise(F.array().cast("array<string>"))
