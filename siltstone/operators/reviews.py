"""What an editor's review says about entries: which tier each is given, which are merged, with short keys spelled out.

A small grammar that runs in Arrow batches; all that texts need from other rows comes by joins.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.session import materialize

#: Keys of entries, tier words with the longer of two that begin alike first, what makes a key an object
#: instead of the subject, and the shapes in which a tier follows its key (W stands for a tier word).
KEY = re.compile(r"[a-z0-9_.]+-[0-9a-f]{6}")
TIERS = {
    "not_recommend": "not_recommend", "pending_check": "pending_check", "alternate": "alternate", "recommend": "recommend",
    "不推荐": "not_recommend", "待核": "pending_check", "备选": "alternate", "继续": "recommend",
    "停止": "not_recommend", "淘汰": "not_recommend", "推荐": "recommend",
}
OBJECT = re.compile(r"(?:item_key|所属|归属|仍归|归到|归入|归|属于|并入|挂到|挂在|映射到?|指向)\s*[=＝:：]?\s*$")
ENUMERATED = re.compile(r"(?:\s*[、,，]\s*[a-z0-9_.]+-[0-9a-f]{6})+")
SHAPES = [
    re.compile(shape.replace("W", "|".join(TIERS)))
    for shape in (
        r"\s*[=＝:：→]?\s*[一二三四五六七八九十两0-9]*\s*(W)",
        r"\s*[=＝:：→]\s*(?:隔离|暂|先|仍|转为?|列为?|降为?|升为?|改列)\s*(W)",
        r"[^，,。；;]{0,24}?(?:tier|status|档位|档)\s*[=＝:：]\s*(W)",
        r"[^，,。；;]{0,12}?(?:改为|改成|改回|恢复为?|定为|落为?|保持为?)\s*(W)",
        r"[^。；;]{0,30}?保留[^，,。；;]{0,8}?(W)",
        r"[^。；;]{0,30}?(W)\s*(?:不变|保留)",
    )
]
#: Numbered items and what they may say later on, with the words that turn it into its opposite.
NUMBERED = re.compile(r"(?m)^\s*(?:\d+[\.、．]|卡\s*\d+)")
LATER = {
    "隔离待核": "pending_check", "降为待核": "pending_check", "降待核": "pending_check", "改为待核": "pending_check",
    "停止本期": "not_recommend", "停止追加": "not_recommend",
    "继续价值评估": "recommend", "保留继续评估": "recommend", "继续评估": "recommend",
}
NEGATIONS = ("不", "勿", "别", "禁止", "非")
#: Headings that give a tier to the lines below them, and the marks of such lines.
HEADING = re.compile(r"\s*(?:[#>*]+\s*)?(保留继续评估|继续评估|继续|隔离待核|隔离|待核|本期不纳入|不纳入|停止)[^\n：:]{0,12}?[一二三四五六七八九十两\d]+\s*条")
HEADING_TIERS = {"隔离待核": "pending_check", "隔离": "pending_check", "待核": "pending_check", "本期不纳入": "not_recommend", "不纳入": "not_recommend", "停止": "not_recommend"}
LISTED = re.compile(r"\s*(?:\d{1,2}(?:[\s\.、．)）]+)|[-•·*]\s*)")
#: Six digits of a key that stand alone; verbs of a merge and what names its target.
SHORT = re.compile(r"(^|[^a-z0-9_.\-])([0-9a-f]{6})([^0-9a-z]|$)")
MERGE = re.compile(r"并入|归入|归到|合并到|退出独立[^，,。；;]{0,4}位")
TARGET = re.compile(r"(?:关联|并入|归入|归到|合并到)\s*[=＝:：]?\s*([a-z0-9_.]{3,})")
NOTE_CHARS, HEAD_CHARS = 160, 30


def _subjects(text: str) -> list[re.Match]:
    """The keys of a text that aren't the object of a phrase before them."""
    return [m for m in KEY.finditer(text) if not OBJECT.search(text[: m.start()])]


def _note(after: str) -> str:
    return after.lstrip(":： =")[:NOTE_CHARS].strip()


def _stated(tail: str) -> str | None:
    """The tier that follows a key, if no other key stands between."""
    tail = tail[m.end() :] if (m := ENUMERATED.match(tail)) else tail
    for shape in SHAPES:
        if (m := shape.match(tail)) and not KEY.search(tail[: m.start(1)]):
            return TIERS[m[1]]
    return None


def _affirmed(text: str, at: int, reach: int, negations: tuple[str, ...]) -> bool:
    """Whether none of the negations stands in the characters before a place."""
    return not any(n in text[max(0, at - reach) : at] for n in negations)


def _said_later(after: str) -> str | None:
    """The earliest of the phrases for which some place isn't negated within the three characters before it."""
    found = []
    for phrase, tier in LATER.items():
        for m in re.finditer(re.escape(phrase), after):
            if _affirmed(after, m.start(), 3, NEGATIONS):
                found.append((m.start(), tier))
                break
    return min(found, key=lambda x: x[0])[1] if found else None


def _by_clause(text: str) -> dict[str, tuple[str, str]]:
    out: dict[str, tuple[str, str]] = {}
    for clause in re.split("[；;。\n]", text):
        for m in _subjects(clause):
            if tier := _stated(clause[m.end() :]):
                out.pop(m[0], None)  # what is said last counts, and its place with it
                at = text.index(m[0]) + len(m[0])
                out[m[0]] = tier, _note(text[at:].split("\n")[0])
    return out


def _by_item(text: str, known: dict) -> dict[str, tuple[str, str]]:
    """Numbered items with one key, whose tier is said in a later sentence."""
    out: dict[str, tuple[str, str]] = {}
    starts = [m.start() for m in NUMBERED.finditer(text)]
    for a, b in zip(starts, [*starts, len(text)][1:], strict=True):
        item = next((line for line in text[a:b].split("\n") if line.strip()), "")
        keys = _subjects(item)
        if len(keys) == 1 and keys[0][0] not in known and keys[0][0] not in out:
            after = item[item.index(keys[0][0]) + len(keys[0][0]) :]
            if tier := _said_later(after):
                out[keys[0][0]] = tier, _note(after)
    return out


def _by_heading(text: str) -> list[tuple[str, str, str]]:
    out, open_ = [], None
    for line in text.splitlines():
        if m := HEADING.match(line):
            open_ = HEADING_TIERS.get(m[1], "recommend"), line.strip()[:HEAD_CHARS]
            parts = re.split("[：:]", line, maxsplit=1)
            out += [(k[0], *open_) for k in KEY.finditer(parts[1].split("。")[0])] if len(parts) > 1 else []
        elif open_ and LISTED.match(line):
            out += [(k[0], open_[0], f"{open_[1]}｜{line.strip()[:NOTE_CHARS]}") for k in _subjects(re.split("[：:]", line, maxsplit=1)[0])]
        else:
            open_ = None
    return out


def stated_tiers(text: str) -> list[tuple[str, str, str]]:
    """key, tier and the words about it, in the order in which they count: clauses, numbered items, then headings."""
    found = _by_clause(text)
    found |= _by_item(text, found)
    for key, tier, note in _by_heading(text):
        found.pop(key, None)
        found[key] = tier, note
    return [(k, *v) for k, v in found.items()]


def stated_merges(text: str) -> list[tuple[str, str, bool]]:
    """key, what it is merged into, and whether that is a key (else an account), the last statement for each key."""
    out: dict[str, tuple[str, bool]] = {}
    for sentence in re.split("[。；;\n]", text):
        verb, subjects = MERGE.search(sentence), _subjects(sentence)
        if not verb or not subjects:
            continue
        if not any(_affirmed(sentence, m.start(), 6, (*NEGATIONS, "无需")) for m in re.finditer(re.escape(verb[0]), sentence)):
            continue
        subject = subjects[0][0]
        keys = [k[0] for k in KEY.finditer(sentence[verb.start() :]) if k[0] != subject]
        names = [m[1] for m in TARGET.finditer(sentence) if not subject.startswith(f"{m[1]}-") and m[1] != subject]
        if keys or names:
            out.pop(subject, None)
            out[subject] = (keys[0], True) if keys else (names[0].rstrip("."), False)
    return [(k, *v) for k, v in out.items()]


def _map(df: DataFrame, keep: str, work, schema: str) -> DataFrame:
    """work on each text (column 1, null as empty), its result as a list column beside `keep` (column 0)."""
    kind = df.schema[keep].dataType.simpleString()

    def run(batches):
        for b in batches:
            rows = [work(*x) for x in zip(*(b.column(k).to_pylist() for k in range(1, b.num_columns)), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, schema_type)], [keep, "found"])

    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    schema_type = to_arrow_type(_parse_datatype_string(schema))
    return df.mapInArrow(run, f"{keep} {kind}, found {schema}")


def spelled_out(reviews: DataFrame, entries: DataFrame, group: str, key: str = "review_id") -> DataFrame:
    """reviews (group, key, text) with keys written as their last six digits in full, if one entry of the group fits.

    entries has group and entry, the full key. Digits that fit several entries, or none, stay as they are. key tells
    reviews apart. Digits of a review are joined with the ends of its group's entries, which are counted first, so that
    a group may have any number of entries; a null text is empty.
    """
    text = F.coalesce("text", F.lit(""))
    digits = F.array_distinct(F.regexp_extract_all(text, F.lit("[0-9a-f]{6}"), F.lit(0)))
    asked = reviews.select(group, key, F.explode(digits).alias("short"))
    ends = entries.where(F.col("entry").rlike("-[0-9a-f]{6}$")).select(group, "entry").distinct()
    ends = ends.groupBy(group, F.substring("entry", -6, 6).alias("short")).agg(F.count("*").alias("n"), F.min("entry").alias("entry")).where("n = 1")
    known = asked.join(ends, [group, "short"]).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("short", "entry"))).alias("_known"))
    rows = materialize(reviews.select(group, key, text.alias("text")).join(known, key, "left"), "reviews")

    def work(t: str, known: list | dict | None) -> list:
        known = dict(known or {})
        return [(SHORT.sub(lambda m: f"{m[1]}{known.get(m[2], m[2])}{m[3]}", t),)]

    found = _map(rows.select(key, "text", "_known"), key, work, "array<struct<text:string>>")
    return found.select(key, F.get("found", F.lit(0))["text"].alias("text")).join(reviews.select(group, key), key)


def review_tiers(reviews: DataFrame, key: str = "review_id", text: str = "text") -> DataFrame:
    """key, place, entry, tier and note of all statements of each review; see stated_tiers. A null text says nothing."""
    found = _map(reviews.select(key, F.coalesce(text, F.lit(""))), key, stated_tiers, "array<struct<entry:string,tier:string,note:string>>")
    return found.select(key, F.posexplode("found").alias("place", "x")).select(key, "place", "x.*")


def review_merges(reviews: DataFrame, key: str = "review_id", text: str = "text") -> DataFrame:
    """key, entry, target and is_key of all merges that a review asks for; see stated_merges."""
    found = _map(reviews.select(key, F.coalesce(text, F.lit(""))), key, stated_merges, "array<struct<entry:string,target:string,is_key:boolean>>")
    return found.select(key, F.explode("found").alias("x")).select(key, "x.*")
