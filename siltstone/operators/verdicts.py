"""Rules that bring a judgement in line with its evidence, as an ordered list of conditions and changes on columns.

A judgement is a row; see FIELDS. Each rule reads the row as the rules before it left it, all changes of one rule take
effect at once, and each rule that changes something leaves its name in `notes`. What the model has to write again is in `again`.
A null field counts as empty or false; other columns stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GAP = "struct<level:string,what:string,owner:string,tried:string,next:string>"
FIELDS = {
    "tier": "string",  # recommend, alternate, not_recommend, pending_check
    "headline": "string", "what": "string", "why_worth": "string", "grounds": "string",
    "novelty_kind": "string", "prior_evidence": "string", "novelty_basis": "string",
    "dims": "array<struct<dim:string,verdict:string,basis:string>>",
    "comparison": "string",  # unrelated, same_fact_no_gain, unconfirmed or another
    "hits": "array<struct<ref:string,title:string,url:string,state:string,body:boolean>>",
    "materials": "array<struct<no:string,kind:string,brand:string,title:string,source:string,state:string,body:boolean,excerpt:string>>",
    "brand_keys": "array<string>", "memory_refs": "array<string>", "gaps": f"array<{GAP}>",
    "comparison_note": "string", "readiness_note": "string",
    "unanswered": "string", "image_seen": "boolean", "complete": "boolean",
    "images_all_read": "boolean", "deepchecked": "boolean", "may_ask_again": "boolean", "source_text": "string",
}

#: Sentence shapes of a contrast with an earlier state, gaps that say pictures weren't looked at, gaps that
#: say there is none, words for content elsewhere, words of a gap about the duplicate check, the mark for removed sentences,
#: and what a supplied gap says.
CONTRAST = r"从[^，。；！？\n]{1,30}?(?:变成|变为|改为|改成|升级为|升级成|转为|转成|进化为|演变为)|告别[^，。；！？\n]{1,20}|不再(?:只)?是"
IMAGE_UNREAD = (
    r"未(?:能)?(?:真正)?(?:读到|看到|查看|读取|实读)[^；。]{0,12}实图"
    r"|(?:只|仅)(?:实际|实)?(?:查看|读取|读到|读|看|见)了?(?:前\s*(?:3|三)\s*张|第\s*1\s*(?:[—\-–~至到、]\s*)?3\s*张)"
    r"|逐图核验|全图(?:核验|审核|判断)|(?:文字|画面)(?:描述|说明|摘要)(?:替代|代替)"
)
NOT_A_GAP = r"^\s*(?:没有|无|暂无|不存在)(?:任何)?(?:影响[^；。，]{0,10}的)?(?:缺口|缺失材料|缺失|缺少的?材料)"
ELSEWHERE = ("外链", "链接", "主页", "全文", "官网", "完整内容", "link", "详见", "快拍", "精选", "商品页", "产品页", "博客")
DUPLICATE_WORDS = ("查重", "正文不可得", "对照")
STRIPPED = "（无旧款依据的前后对比，已删）"
TEXTS = {
    "unseen": "未读到实图",
    "fetch_again": "下一轮重新下载、识别后重判",
    "no_basis": "模型没给依据，按不明处理",
    "check_posted": "核对是否真的发过，再定档",
    "only_generated": "对照材料里只有生成稿或只有标题",
    "open_history": "打开命中的历史文章核对正文",
    "only_titles": "对照材料里只有标题",
    "still_missing": "深核后仍缺决定选题的关键资料",
    "by_hand": "人工补证后再定是否推荐",
    "missing_material": "关键资料尚未取得",
    "angle_not_formed": "报道角度尚未成立",
    "low_value": "价值是否成立尚待确认",
    "other": "判断所需的关键信息尚待确认",
    "read_again": "补读或人工核对后重判",
    "history": "命中的历史文章正文缺失，无法确认有无重复",
    "compare_bodies": "人工核对那几篇正文是否同一事实，核清后再定档",
    "see_hits": "判断时给的对照材料见 comparison.hits；标正文不可得的那几篇只给了标题或摘要",
    "unproven": "查重未确认：不推荐的理由是「同一事实已发」，但没有站得住的已发证据",
    "undecided": "查重未确认：对照材料核不了是否同一事实",
    "all_looked_up": "五类材料都查过（查过不等于正文已得）",
    "only_unconfirmed": "这几条的事实级查重只能是未确认",
    "not_counted": "查重结论基于已给正文的材料，这几条未计入；未得正文不是已发证据",
    "not_complete": "对照正文未得，查重未确认，资料不算齐全",
}
#: Claims that all five kinds of material are there, and marks of what was added to a note before.
ALL_PROVIDED = r"五类(?:对照)?(?:材料|对照)(?:均|都)?(?:已)?(?:提供|齐备|齐全|齐)(?:记录或查询结果)?"
BODIES_MISSING = "正文未得："
COMPARISON_MISSING = "对照正文未得"
CONTRAST_DIMS = ("change", "explain", "gain")

SENTENCE = r"[^。；！？\n]+[。；！？\n]?"
HEADLINE_CHARS = 40


def contrast_phrases(texts: list[Column], source: Column) -> Column:
    """The distinct contrasts in texts, an array; what the source says itself isn't one."""
    found = F.flatten(F.array(*(F.regexp_extract_all(F.coalesce(t, F.lit("")), F.lit(CONTRAST), F.lit(0)) for t in texts)))
    return F.filter(F.array_distinct(found), lambda p: ~F.contains(F.coalesce(source, F.lit("")), p))


def _holds(text: Column, phrases: Column) -> Column:
    return F.exists(phrases, lambda p: F.contains(text, p))


def strip_sentences(text: Column, phrases: Column) -> Column:
    """text with one mark in place of the sentences that hold a phrase."""
    sentences = F.transform(F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(0)), lambda s: F.struct(s.alias("s"), _holds(s, phrases).alias("bad")))
    first = F.array_position(F.transform(sentences, lambda x: x["bad"]), F.lit(True))
    kept = F.transform(sentences, lambda x, i: F.when(~x["bad"], x["s"]).when(i + 1 == first, F.lit(STRIPPED)).otherwise(""))
    return F.when(_holds(text, phrases), F.array_join(kept, "")).otherwise(text)


def strip_headline(text: Column, phrases: Column) -> Column:
    """Only the object before the bar if the headline holds a phrase; nothing if the object does too."""
    thing = F.trim(F.split_part(text, F.lit("｜"), F.lit(1)))
    return F.when(~_holds(text, phrases), text).when(_holds(thing, phrases), "").otherwise(thing)


def _gap(what: Column | str, next_: Column | str = "", owner: str = "collector", tried: str = "") -> Column:
    what = F.lit(what) if isinstance(what, str) else what
    return F.struct(F.lit("decision").alias("level"), what.alias("what"), F.lit(owner).alias("owner"), F.lit(tried).alias("tried"), (F.lit(next_) if isinstance(next_, str) else next_).alias("next"))


def _decisive(gaps: Column) -> Column:
    return F.exists(gaps, lambda g: g["level"] == "decision")


def _blank(text: Column) -> Column:
    return F.coalesce(F.trim(text), F.lit("")) == ""


def _any_word(text: Column, words: tuple[str, ...]) -> Column:
    return text.rlike("|".join(words))


def _material(hit: Column) -> Column:
    """The material that a hit names; null if it names none."""
    return F.get(F.filter(F.col("materials"), lambda m: m["no"] == F.trim(hit["ref"])), 0)


def _dim(name: str) -> Column:
    return F.coalesce(F.exists("dims", lambda d: (d["dim"] == name) & (d["verdict"] == "yes")), F.lit(False))


def _rules() -> Iterator[tuple[str, Column, dict[str, Column]]]:
    """name, condition and changes, in order. A name that begins with "?" asks the model again; one with "_" leaves no note."""
    c = F.col
    gaps, tier, pending = c("gaps"), c("tier"), c("tier") == "pending_check"
    add = lambda *g: F.concat(gaps, F.array(*g).cast(f"array<{GAP}>"))

    yield "pictures_unread", ~c("images_all_read") & c("image_seen"), {"image_seen": F.lit(False), "tier": F.lit("pending_check")}
    yield "_pictures_read", c("images_all_read"), {"image_seen": F.lit(True)}
    told = lambda g: F.coalesce(g["what"].rlike(IMAGE_UNREAD), F.lit(False))
    left = F.filter(gaps, lambda g: ~told(g))
    yield "?pictures", c("images_all_read") & F.exists(gaps, told) & pending & ~_decisive(left) & c("may_ask_again"), {}
    yield "pictures_not_a_gap", c("images_all_read") & F.exists(gaps, told), {"gaps": left}
    none = lambda g: F.coalesce(g["what"].rlike(NOT_A_GAP), F.lit(False))
    yield "no_gap_dropped", F.exists(gaps, none), {"gaps": F.filter(gaps, lambda g: ~none(g))}

    unseen = F.when(_decisive(gaps), gaps).otherwise(add(_gap(TEXTS["unseen"], TEXTS["fetch_again"])))
    yield "unseen_pending", ~c("image_seen") & ~pending, {"gaps": unseen, "tier": F.lit("pending_check")}
    bare = lambda d: _blank(d["basis"])
    unclear = F.transform("dims", lambda d: F.when(bare(d), d.withField("basis", F.lit(TEXTS["no_basis"])).withField("verdict", F.lit("unclear"))).otherwise(d))
    yield "no_basis", F.exists("dims", bare), {"dims": unclear}

    def copied(h: Column) -> Column:
        m = _material(h)
        state = F.when(m["state"].isin("published", "draft", "generated", "decision"), m["state"]).otherwise("unknown")
        url = F.when(m["source"].rlike("^https?://"), m["source"]).otherwise("")
        return F.when(m.isNull(), h.withField("url", F.lit(""))).otherwise(h.withField("url", url).withField("state", state).withField("body", F.coalesce(m["body"], F.lit(False))))

    yield "_hits_from_materials", F.size("hits") > 0, {"hits": F.transform("hits", copied)}

    texts = ["headline", "what", "why_worth", "grounds", "novelty_basis"]
    of_dims = F.array_join(F.transform(F.filter("dims", lambda d: d["dim"].isin(*CONTRAST_DIMS)), lambda d: d["basis"]), "\n")
    yield "_contrasts", F.lit(True), {"_found": contrast_phrases([*(c(t) for t in texts), of_dims], c("source_text"))}
    invented = (F.size("_found") > 0) & ((c("novelty_kind") != "evidenced_change") | _blank(c("prior_evidence")))
    yield "?contrast", invented & c("may_ask_again"), {}
    fixed = {t: strip_sentences(c(t), c("_found")) for t in texts[1:]} | {"headline": strip_headline(c("headline"), c("_found"))}
    fixed["dims"] = F.transform("dims", lambda d: F.when(d["dim"].isin(*CONTRAST_DIMS), d.withField("basis", strip_sentences(d["basis"], c("_found")))).otherwise(d))
    yield "contrast_removed", invented & ~c("may_ask_again"), fixed

    solid = F.exists("hits", lambda h: F.exists("materials", lambda m: (m["no"] == F.trim(h["ref"])) & ~m["kind"].isin("generated_post", "prior_ledger") & m["body"]))
    weak = (c("comparison") == "same_fact_no_gain") & ~F.coalesce(solid, F.lit(False))
    yield "_weak", F.lit(True), {"_weak": weak}
    yield "same_fact_unproven", c("_weak"), {"comparison": F.lit("unconfirmed")}
    yield "?same_fact", c("_weak") & (tier == "not_recommend") & c("may_ask_again"), {}
    ask = _gap(TEXTS["unproven"], TEXTS["check_posted"], "editor", TEXTS["only_generated"])
    yield "same_fact_pending", c("_weak") & (tier == "not_recommend") & ~c("may_ask_again"), {"tier": F.lit("pending_check"), "gaps": add(ask)}

    key = lambda name: F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]", "")
    untold = F.filter("materials", lambda m: m["kind"].isin("published", "example") & ~F.coalesce(m["body"], F.lit(False)) & ~_blank(m["brand"]) & F.array_contains("brand_keys", key(m["brand"])))
    admits = F.exists("hits", lambda h: ~F.coalesce(h["body"], F.lit(False)))
    titles = F.array_join(F.transform(untold, lambda m: m["title"]), "》《")
    history = F.when(F.size(untold) > 0, F.concat(F.lit("同品牌历史文章《"), titles, F.lit("》正文缺失，无法确认有无重复"))).otherwise(TEXTS["history"])
    to_open = F.when(F.size(untold) > 0, F.concat(F.lit("核对《"), titles, F.lit("》正文"))).otherwise(TEXTS["open_history"])
    yield "history_unread", (c("comparison") == "unrelated") & ((F.size(untold) > 0) | admits) & tier.isin("recommend", "alternate"), {
        "comparison": F.lit("unconfirmed"), "gaps": add(_gap(history, to_open, "editor", TEXTS["only_titles"]))}

    yield "gain_not_shown", (tier == "recommend") & ~_dim("gain"), {"tier": F.lit("alternate")}
    yield "fit_not_shown", (tier == "recommend") & ~_dim("csw"), {"tier": F.lit("alternate")}
    away = F.exists(gaps, lambda g: (g["level"] == "decision") & _any_word(F.concat_ws("", g["what"], g["next"]), ELSEWHERE))
    yield "material_missing", (tier == "not_recommend") & ((c("unanswered") == "missing_material") | ((c("unanswered") != "low_value") & away)), {"tier": F.lit("pending_check")}

    deep = F.when(_decisive(gaps), gaps).otherwise(add(_gap(TEXTS["still_missing"])))
    to_editor = F.transform(deep, lambda g: F.when(g["level"] == "decision", g.withField("owner", F.lit("editor")).withField("next", F.when(_blank(g["next"]), TEXTS["by_hand"]).otherwise(g["next"]))).otherwise(g))
    yield "checked_still_open", c("deepchecked") & pending, {"gaps": to_editor}
    why = F.when(c("unanswered") == "missing_material", TEXTS["missing_material"]).when(c("unanswered") == "angle_not_formed", TEXTS["angle_not_formed"]).when(c("unanswered") == "low_value", TEXTS["low_value"]).otherwise(TEXTS["other"])
    yield "gap_supplied", pending & ~_decisive(gaps), {"gaps": add(_gap(why, TEXTS["read_again"]))}
    idle = lambda g: (g["owner"] == "collector") & (g["level"] != "boundary") & _blank(g["next"])
    yield "next_supplied", F.exists(gaps, idle), {"gaps": F.transform(gaps, lambda g: F.when(idle(g), g.withField("next", F.lit(TEXTS["read_again"]))).otherwise(g))}

    remembered = F.transform(F.filter("materials", lambda m: m["kind"] == "memory"), lambda m: m["no"])
    known = F.filter("memory_refs", lambda r: F.coalesce(F.array_contains(remembered, F.trim(r)), F.lit(False)))
    yield "memory_refs_dropped", F.size(known) < F.size("memory_refs"), {"memory_refs": known}
    short = F.substring(F.trim("what"), 1, HEADLINE_CHARS)
    yield "headline_supplied", _blank(c("headline")), {"headline": F.when(short == "", c("candidate_key")).otherwise(short)}
    yield "headline_long", F.length("headline") > HEADLINE_CHARS, {}

    def given(h: Column) -> Column:
        m = F.get(F.filter(F.col("materials"), lambda m: m["no"] == h["ref"]), 0)
        return F.coalesce(m["kind"].isin("published", "example", "generated_post") & m["body"] & ~_blank(m["excerpt"]), F.lit(False))

    told_wrong = F.exists("hits", lambda h: F.coalesce(h["body"], F.lit(False)) != given(h))
    yield "bodies_as_given", told_wrong, {"hits": F.transform("hits", lambda h: h.withField("body", given(h)))}

    note, open_ = c("comparison_note"), c("comparison") == "unconfirmed"
    unread = F.filter("hits", lambda h: ~F.coalesce(h["body"], F.lit(False)))
    titled = lambda h: F.concat(F.lit("《"), F.coalesce(h["title"], F.lit("")), F.lit("》"))
    named = F.array_join(F.transform(unread, lambda h: F.when(h["ref"] == "", titled(h)).otherwise(h["ref"])), "、")
    yield "tail_reworded", ~open_ & F.contains(note, F.lit(TEXTS["only_unconfirmed"])), {"comparison_note": F.replace(note, F.lit(TEXTS["only_unconfirmed"]), F.lit(TEXTS["not_counted"]))}
    looked = F.regexp_replace(note, ALL_PROVIDED, TEXTS["all_looked_up"])
    between = F.when(looked.rlike(r"[。；.]\z"), "").otherwise("；")
    tail = F.when(open_, TEXTS["only_unconfirmed"]).otherwise(TEXTS["not_counted"])
    listed = F.concat(looked, between, F.lit(BODIES_MISSING), named, F.lit("（只有标题或决定摘要），"), tail, F.lit("。"))
    yield "claim_of_all_material", (F.size(unread) > 0) & note.rlike(ALL_PROVIDED), {"comparison_note": F.when(F.contains(looked, F.lit(BODIES_MISSING)), looked).otherwise(listed)}

    asked = F.exists(gaps, lambda g: (g["level"] == "decision") & _any_word(g["what"], DUPLICATE_WORDS))
    both = F.array_join(F.transform(unread, lambda h: F.when(h["ref"] == "", titled(h)).otherwise(F.concat(h["ref"], titled(h)))), "、")
    what = F.when(F.size(unread) > 0, F.concat(F.lit("查重未确认："), both, F.lit("正文不可得，核不了是否同一事实"))).otherwise(TEXTS["undecided"])
    yield "duplicate_gap", open_ & (tier != "not_recommend") & ~asked, {"gaps": add(_gap(what, TEXTS["compare_bodies"], "editor", TEXTS["see_hits"]))}
    yield "duplicate_pending", open_ & tier.isin("recommend", "alternate"), {"tier": F.lit("pending_check")}
    ready = c("readiness_note")
    said = F.when(F.contains(ready, F.lit(COMPARISON_MISSING)), ready).otherwise(F.concat(ready, F.when(_blank(ready), "").otherwise("；"), F.lit(TEXTS["not_complete"])))
    yield "not_complete", open_ & c("complete"), {"complete": F.lit(False), "readiness_note": said}


def apply_rules(rows: DataFrame) -> DataFrame:
    """rows (candidate_key and FIELDS) after all rules, with the arrays notes and again. One projection, no shuffle."""
    empty = {"string": F.lit(""), "boolean": F.lit(False)}
    fill = {n: F.coalesce(F.col(n).cast(t), empty.get(t, F.array()).cast(t)) for n, t in FIELDS.items()}
    out = rows.withColumns({**fill, "notes": F.array().cast("array<string>"), "again": F.array().cast("array<string>")})
    for name, when, change in _rules():
        hit = F.coalesce(when, F.lit(False))
        new = {k: v if k.startswith("_") else F.when(hit, v).otherwise(F.col(k)) for k, v in change.items()}
        if not name.startswith("_"):
            log = "again" if name.startswith("?") else "notes"
            new[log] = F.when(hit, F.array_append(log, F.lit(name.lstrip("?")))).otherwise(F.col(log))
        out = out.withColumns(new)
    return out.drop("_found", "_weak")
