"""Text, URL and key functions on columns; all but two_places run in the JVM."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Hosts whose links aren't read again, the alphabet of short codes, and zero-width characters.
SKIP_HOSTS = ("instagram.com", "instagr.am", "facebook.com", "threads.net")
CODE_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"
ZERO_WIDTH = "​‌‍﻿"


def norm_url(url: Column) -> Column:
    """Without query, fragment and slashes at the end; a post's path keeps its case, all else is lower case."""
    cut = F.regexp_replace(F.regexp_replace(F.trim(url), r"[?#](?s).*$", ""), "/+$", "")
    code = F.regexp_extract(cut, r"instagram\.com/+(?:p|reel|reels|tv)/+([^/]+)", 1)
    return F.when(code != "", F.concat(F.lit("https://www.instagram.com/p/"), code)).otherwise(F.lower(cut))


def normalize(text: Column) -> Column:
    return F.translate(F.lower(text), ZERO_WIDTH, "")


def alias_tells(alias: Column) -> Column:
    """Whether an alias is long enough to be looked for: four characters, two with one of the Chinese, Japanese or Korean scripts."""
    low = normalize(alias)
    return F.length(low) >= F.when(low.rlike("[぀-ヿㇰ-ㇿ㐀-䶿一-鿿가-힣]"), 2).otherwise(4)


def brand_key(name: Column) -> Column:
    """Lower-case letters and digits of any script."""
    return F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]", "")


def candidate_key(account: Column, url: Column, post_id: Column) -> Column:
    name = F.lower(F.regexp_replace(account, "[^A-Za-z0-9]", ""))
    basis = F.when(F.trim(F.coalesce(url, F.lit(""))) == "", post_id).otherwise(url)
    return F.concat(F.when(name == "", "src").otherwise(name), F.lit("-"), F.substring(F.sha2(basis, 256), 1, 6))


def two_places(x: Column) -> Column:
    """A double with two decimals as C prints it, by its exact value: 0.965, which is a little less, is 0.96 (Java's format: 0.97)."""

    @F.pandas_udf("string")
    def printed(v: pd.Series) -> pd.Series:
        return v.map("{:.2f}".format, na_action="ignore").astype(object)

    return printed(x)


def media_id(code: Column) -> Column:
    """A short code as a decimal number in text; digits stay; null if it isn't a code."""
    code = F.trim(code)
    place = F.transform(F.split(code, ""), lambda c: F.instr(F.lit(CODE_ALPHABET), c) - 1)
    number = F.aggregate(place, F.lit(0).cast("decimal(38,0)"), lambda a, v: (a * 64 + v).cast("decimal(38,0)"))
    valid = code.rlike("^[A-Za-z0-9_-]{1,11}$")
    return F.when(code.rlike("^[0-9]{1,20}$"), code).when(valid, number.cast("string"))


def plain_text(html: Column) -> Column:
    """One line without tags; a tag that isn't closed ends the text."""
    return F.trim(F.regexp_replace(F.regexp_replace(html, r"<[^>]*(>|$)", " "), r"\s+", " "))


#: Blocks that hold no text of their own, tags that end a line, and the entities that are decoded, in order.
DROPPED = "script|style|noscript|svg|nav|footer|header|form|iframe|template"
NO_TEXT = rf"(?is)<!--.*?-->|<(?:{DROPPED})\b.*?</\s*(?:{DROPPED})\s*>"
LINE_ENDS = r"(?i)<br\s*/?>|</(?:p|div|li|h[1-6]|tr|section|article|blockquote)\s*>"
TITLE = r"(?is)<title[^>]*>(.*?)</title>"
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&amp;", "&"))


def _decoded(x: Column) -> Column:
    for name, char in ENTITIES:
        x = F.replace(x, F.lit(name), F.lit(char))
    return x


def html_to_text(html: Column, limit: int = 20_000) -> Column:
    """Lines of text without blocks that hold none, the title before them unless they begin with it; cut at limit characters."""
    title = _decoded(F.regexp_replace(F.regexp_extract(html, TITLE, 1), r"^\s+|\s+$", ""))
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(html, NO_TEXT, " "), LINE_ENDS, "\n"), r"(?s)<[^>]*>", " ")
    lines = F.transform(F.split(_decoded(plain), "\n"), lambda v: F.trim(F.regexp_replace(v, r"\s+", " ")))
    body = F.substring(F.array_join(F.filter(lines, lambda v: v != ""), "\n"), 1, limit)
    return F.substring(F.when((title == "") | body.startswith(title), body).otherwise(F.concat(title, F.lit("\n"), body)), 1, limit)


#: Fixed value: a link in a text, which ends before white space, quotes, brackets and marks of either width.
LINK = r"""https?://[^\s<>"'（）()【】「」《》，。；！？、]+"""


def urls_in(text: Column, most: int = 3, skip: tuple[str, ...] = SKIP_HOSTS) -> Column:
    """The first distinct links of a text, without those to the skipped hosts and their subdomains."""
    found = F.transform(F.regexp_extract_all(text, F.lit(LINK), F.lit(0)), lambda u: F.regexp_replace(u, r"[.,)\]]+$", ""))
    host = "|".join(h.replace(".", r"\.") for h in skip)
    return F.slice(F.array_distinct(F.filter(found, lambda u: ~u.rlike(rf"(?i)^https?://([^/?#]*\.)?({host})([/:?#]|$)"))), 1, most)


def needs_translation(text: Column) -> Column:
    han, latin = (F.regexp_count(text, F.lit(p)) for p in ("[㐀-䶿一-鿿]", "[A-Za-z]"))
    return text.rlike("[぀-ヿㇰ-ㇿｦ-ﾝ]") | ((latin > han) & (latin >= 20))


def language_bucket(text: Column) -> Column:
    kana, hangul, han = (text.rlike(p) for p in ("[぀-ヿ]", "[가-힣]", "[一-鿿]"))
    return F.when(kana, "ja").when(hangul, "ko").when(han, "zh").otherwise("en")


def number(text: Column) -> Column:
    """A number without separators and units; null for a dash, nothing or anything else."""
    return F.trim(F.translate(text, ",%s秒", "")).try_cast("double")


def note_flags(views: Column, impressions: Column, watch: Column) -> Column:
    """Marks of counts that can't be right yet, as an array."""
    seen = views > 0
    return F.array_compact(F.array(F.when(seen & (impressions == 0), "refresh_pending:观看>0 而曝光=0"), F.when(seen & (watch == 0), "refresh_pending:观看>0 而平均时长=0")))


def dedupe_text(text: Column) -> Column:
    """For comparing messages: without mentions and white space."""
    return F.regexp_replace(F.regexp_replace(text, r"@\S+", ""), r"\s+", "")


def fingerprint(fields: list[Column], refs: Column) -> Column:
    """A hash of fields in order and references in any order; null is like empty."""
    return F.sha2(F.concat_ws("\x1f", *(F.coalesce(f.cast("string"), F.lit("")) for f in fields), F.array_sort(refs)), 256)


def tokens(text: Column) -> Column:
    """Lower-case words of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def key_phrases(words: Column, most: int = 8) -> Column:
    """The longest distinct words that tell something, the earlier of equal length first."""
    telling = F.filter(F.array_distinct(words), lambda w: F.length(w) >= F.when(w.rlike("[a-z0-9]"), 3).otherwise(2))
    placed = F.transform(telling, lambda w, i: F.struct((-F.length(w)).alias("n"), i.alias("i"), w.alias("w")))
    return F.transform(F.slice(F.array_sort(placed), 1, most), lambda x: x["w"])


def heat_note(likes: Column, comments: Column, followers: Column, baseline: Column, ratio: Column, tags: Column) -> Column:
    """Counts that are known, likes beside what is usual for the account, and tags that aren't blank; says so if nothing is known."""
    usual = F.when(baseline > 0, F.concat(F.lit("常态 "), baseline.cast("string"), F.lit(" 的 "))).otherwise("常态的 ")
    beside = F.when(ratio.isNotNull(), F.concat(F.lit(" · "), usual, F.format_string("%.1f", ratio.cast("double")), F.lit("×"))).otherwise("")
    parts = F.concat_ws(" · ", F.concat(likes.cast("string"), F.lit(" 赞"), beside), F.concat(comments.cast("string"), F.lit(" 评论")), F.concat(F.lit("账号 "), followers.cast("string"), F.lit(" 粉丝")))
    named = F.array_join(F.filter(F.coalesce(tags, F.array().cast("array<string>")), lambda x: F.trim(x) != ""), "、")
    labels = F.when(named == "", "").otherwise(F.concat(F.when(parts == "", "").otherwise("；"), F.lit("标签："), named))
    return F.when((parts == "") & (labels == ""), "热度不详").otherwise(F.concat(parts, labels))


#: The shapes of dates and prices, the words and signs of currencies, and what ends a product's name.
MONTH = "(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*"
DATES = (
    r"\d{4}\s*[-/.年]\s*\d{1,2}\s*[-/.月]\s*\d{1,2}\s*日?",
    r"\d{1,2}\s*[/月]\s*\d{1,2}\s*日?",
    MONTH + r"\.?\s+\d{1,2}(?:\s*,\s*\d{4})?",
    r"\d{1,2}\s+" + MONTH + r"\.?(?:\s+\d{4})?",
)
PRICES = (
    r"[¥￥$€£₩]\s*\d[\d,.\s]*\d",
    r"[¥￥$€£₩]\s*\d",
    r"\d[\d,.\s]*\d\s*(?:円|元|圆|usd|jpy|eur|gbp|rmb|cny|yen|dollars?)",
    r"\d\s*(?:円|元|usd|jpy|yen)",
)
NAME_ENDS = "\n。.!！#"


def _candidates(found: Column, most: int) -> Column:
    """The first distinct ones, whatever their case; the first spelling stays."""
    found = F.filter(F.transform(found, lambda x: F.trim(x)), lambda x: x != "")
    folded = F.transform(found, lambda x: F.lower(x))
    first = F.filter(found, lambda x, i: F.array_position(folded, F.lower(x)) == i + 1)
    return F.slice(first, 1, most)


def date_candidates(text: Column, most: int = 8) -> Column:
    return _candidates(F.regexp_extract_all(text, F.lit("(?i)" + "|".join(DATES)), F.lit(0)), most)


def price_candidates(text: Column, most: int = 8) -> Column:
    return _candidates(F.regexp_extract_all(text, F.lit("(?i)" + "|".join(PRICES)), F.lit(0)), most)


def product_candidates(text: Column, alias: Column, most: int = 8) -> Column:
    """What follows each place of the alias, up to 30 characters and the end of a line or sentence."""
    tail = F.concat(F.lit(r"(?i)\Q"), alias, F.lit(rf"\E(?=([^{NAME_ENDS}]{{0,30}}))"))
    cut = F.transform(F.regexp_extract_all(text, tail, F.lit(1)), lambda x: F.trim(F.regexp_replace(F.trim(x), "^[的:：—-]+", "")))
    return _candidates(F.transform(F.filter(cut, lambda x: F.length(x) >= 2), lambda x: F.concat_ws(" ", alias, x)), most)


#: Fixed value: what begins a section or a record of our own.
MARKER = r"(?i)^\s*(【|\[(?=.{0,37}\])|c\s*a\s*n\s*d\s*i\s*d\s*a\s*t\s*e\s*_?\s*k\s*e\s*y\s*[:：])"


def fence(text: Column) -> Column:
    """Text of others to be put in a prompt: rules become dashes, lines that look like our sections get a dot in front; nothing is lost."""
    lines = F.split(F.regexp_replace(text, "[─-╿]", "-"), "\r?\n")
    return F.array_join(F.transform(lines, lambda v: F.when(v.rlike(MARKER), F.concat(F.lit("· "), v)).otherwise(v)), "\n")


def sized_url(url: Column, width: int) -> Column:
    """The address of a picture in that width, once; 0 leaves it."""
    resize = f"x-oss-process=image/resize,w_{width}/format,jpg/quality,q_80"
    more = F.concat(url, F.when(F.contains(url, F.lit("?")), "&").otherwise("?"), F.lit(resize))
    return F.when(F.lit(width == 0) | F.contains(url, F.lit("x-oss-process")), url).otherwise(more)


def strip_title_suffix(title: Column) -> Column:
    """Without what follows the last bar, if that is a column's name: in title quotes, of up to 8 characters or the publisher's."""
    tail = F.trim(F.regexp_extract(title, r"(?s)\|([^|]*)$", 1))
    suffix = F.contains(title, F.lit("|")) & ((F.length(tail) <= 8) | tail.rlike("^(《|营事)"))
    return F.trim(F.when(suffix, F.regexp_replace(title, r"(?s)\|[^|]*$", "")).otherwise(title))
