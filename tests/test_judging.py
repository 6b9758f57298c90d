import itertools

import pytest
from pyspark.sql import functions as F

from siltstone.functions import text as X
from siltstone.operators import records, search, verdicts


def test_rules_take_null_and_empty_rows(spark):
    rows = spark.range(3).select(F.col("id").cast("string").alias("candidate_key"), F.lit("kept").alias("extra"), *(F.lit(None).cast(t).alias(n) for n, t in verdicts.FIELDS.items()))
    out = verdicts.apply_rules(rows).collect()
    assert {(r.tier, r.headline, r.extra, r.gaps[0].level) for r in out} == {("pending_check", k, "kept", "decision") for k in "012"}
    assert verdicts.apply_rules(rows.limit(0)).count() == 0


def test_refs_are_trimmed_and_gaps_name_what_is_missing(spark):
    """A hit " M1" is the material M1, so that the same fact stands; history without its text is named in the gap."""
    hit = "array<struct<ref:string,title:string,url:string,state:string,body:boolean>>"
    rows = [
        ("a", "same_fact_no_gain", "not_recommend", [(" M1", "t1", "", "published", True)], []),
        ("b", "same_fact_no_gain", "not_recommend", [("M7", "t1", "", "published", True)], []),
        ("c", "unrelated", "alternate", [], ["acme"]),
        ("d", "unrelated", "alternate", [("M2", "t2", "", "published", True)], []),
        ("e", "unconfirmed", "alternate", [("", "t9", "", "published", False), ("M2", "t2", "", "", True)], []),
    ]
    df = spark.createDataFrame(rows, f"candidate_key string, comparison string, tier string, hits {hit}, brand_keys array<string>")
    given = [("M1", "published", "Other", "t1", "https://x", "published", True, "e"), ("M2", "prior_ledger", "", "t2", "", "", False, ""), ("M3", "published", "Acme", "t3", "", "", False, ""), ("M4", "example", "ACME!", "t4", "", "", False, "")]
    fields = {"materials": F.array(*(F.struct(*map(F.lit, m)) for m in given)).cast(verdicts.FIELDS["materials"]), "image_seen": F.lit(True), "images_all_read": F.lit(True)}
    rest = [F.lit(None).cast(k).alias(n) for n, k in verdicts.FIELDS.items() if n not in {*df.columns, *fields}]
    out = {r.candidate_key: r for r in verdicts.apply_rules(df.select("*", *(v.alias(n) for n, v in fields.items()), *rest)).collect()}
    assert (out["a"].comparison, out["a"].tier) == ("same_fact_no_gain", "not_recommend")
    assert out["b"].gaps[0].what == "查重未确认：不推荐的理由是「同一事实已发」，但没有站得住的已发证据"
    assert (out["c"].gaps[0].what, out["c"].gaps[0].next) == ("同品牌历史文章《t3》《t4》正文缺失，无法确认有无重复", "核对《t3》《t4》正文")
    assert (out["d"].gaps[0].what, out["d"].gaps[0].next) == ("命中的历史文章正文缺失，无法确认有无重复", "打开命中的历史文章核对正文")
    assert out["e"].gaps[0].what == "查重未确认：《t9》、M2《t2》正文不可得，核不了是否同一事实"
    assert out["e"].tier == "pending_check"


def test_headline_keeps_the_object(spark):
    rows = spark.createDataFrame([("椅子｜告别旧款",), ("告别旧款｜好",), ("椅子｜好",)], "h string")
    p = F.array(F.lit("告别旧款"))
    assert [r[0] for r in rows.select(verdicts.strip_headline(F.col("h"), p)).collect()] == ["椅子", "", "椅子｜好"]


def test_fence_loses_nothing(spark):
    rows = spark.createDataFrame([("[a] b",), ("[" + "x" * 50 + "]",), (" 【x",), ("a【x",), ("",), (None,), ("candidatekey:1",)], "t string")
    assert [r[0] for r in rows.select(X.fence(F.col("t"))).collect()] == ["· [a] b", "[" + "x" * 50 + "]", "·  【x", "a【x", "", None, "· candidatekey:1"]


def test_sweeps_need_their_required_sources(spark):
    rows = spark.range(2)
    assert {r.partial for r in records.collect_sources([("a", rows, True)]).collect()} == {False}
    for bad in ([("a", None, True), ("b", rows, False)], [("a", None, False)]):
        with pytest.raises(ValueError):
            records.collect_sources(bad)


def test_pairs_of_a_hot_brand_stay_few(spark):
    rows = spark.range(3000).select("id", (F.col("id") % 5).alias("acct"), F.when(F.col("id") < 2000, "hot").otherwise(F.col("id").cast("string")).alias("brand"))
    got = records.sample_pairs(rows, "id", "acct", "brand", 100, buckets=8).collect()
    assert {b: sum(r.bucket == b for r in got) for b in ("same_account", "cross_account", "unrelated")} == {"same_account": 100, "cross_account": 100, "unrelated": 100}
    brand = lambda i: "hot" if i < 2000 else str(i)
    for r in got:
        assert r.i < r.j and (brand(r.i) == brand(r.j)) == (r.bucket != "unrelated")
        assert r.bucket == "unrelated" or (r.i % 5 == r.j % 5) == (r.bucket == "same_account")
    assert records.sample_pairs(rows.limit(0), "id", "acct", "brand", 5).count() == 0


def test_history_against_a_loop(spark):
    users = [("u1", "_acme__co_", "Acme Co"), ("u2", "ab", "xy"), ("u3", "zeta9", "é Zeta")]
    docs = [(i, "ab"[i % 2], f"title {i % 7}", ["ACME", "Zeta9", None][i % 3], ["with acme co inside", None, "é ZETA"][i % 3], "u", None if i % 4 == 0 else f"2024-01-{i:02d}") for i in range(1, 30)]
    got = search.history_hits(spark.createDataFrame(users, "user string, username string, full_name string"), spark.createDataFrame(docs, "key long, kind string, title string, brand string, body string, url string, published string"))
    want = set()
    for user, name, full in users:
        core = "".join(c for c in name if c.isascii() and c.isalnum())
        words = [name.strip("_").replace("__", "_")] + [core] * (len(core) >= 4) + [full] * (len(full) >= 3)
        seen = []
        for w in words:
            if len(w.encode()) < 3:
                continue
            hits = [d for d in docs if any(w.lower() in (d[k] or "").lower() for k in (2, 3, 4, 5))]
            for d in list(itertools.islice(sorted(sorted(hits, key=lambda d: d[0]), key=lambda d: d[6] or "", reverse=True), 5)):
                if (d[1], d[2]) not in seen and len(seen) < 5:
                    seen.append((d[1], d[2]))
                    want.add((user, d[1], d[2], d[6], len(seen)))
    assert {(r.user, r.kind, r.title, r.published, r.place) for r in got.collect()} == want and want


@pytest.mark.parametrize("net, flag", [("7", "definition_pending"), ("8", None)])
def test_daily_trend(spark, tmp_path, net, flag):
    from siltstone.sources.files import daily_trend

    path = tmp_path / "trend.csv"
    path.write_text(f"﻿Day,Net,New,Lost,Note\n2024-01-02,{net},\"1,005\",1000,x\n2024-01-01,0,5,2,\n,,,,--\n", encoding="utf-8")
    totals, summary = daily_trend(spark, str(path), {"day": "date", "net": "follows", "new": "new_follows", "lost": "unfollows"})
    assert {r.name: r.total for r in totals.collect()} == {"Net": float(net), "New": 1010.0, "Lost": 1002.0}
    assert [tuple(r) for r in summary.collect()] == [("2024-01-01", "2024-01-02", flag)]
