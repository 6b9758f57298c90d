"""Statements of reviews; the texts are made up."""

import pytest

from siltstone.operators import reviews


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("abc-123abc 不推荐", {"abc-123abc": "not_recommend"}),
        ("ab-000001、cd-000002=待核；ef-000003：备选；gh-000004=停止", {"ab-000001": "pending_check", "cd-000002": "pending_check", "ef-000003": "alternate", "gh-000004": "not_recommend"}),
        ("首页恢复ab-000001、cd-000002二继续，另加两条", {"ab-000001": "recommend", "cd-000002": "recommend"}),
        ("停止针对 ab-000001 再深核", {}),
        ("某品牌 继续、另一品牌 待核", {}),
        ("ab-000001：item_key=cd-000002、tier=not_recommend", {}),
        ("ab-000001.tier由待核改推荐；恢复ab-000001 tier=pending_check", {"ab-000001": "pending_check"}),
        ("ab-000001：隔离待核。cd-000002 改回 alternate", {"ab-000001": "pending_check", "cd-000002": "alternate"}),
        ("ab-000001 保留官方正文与 recommend", {"ab-000001": "recommend"}),
        ("ab-000001 的 pending_check 不变", {"ab-000001": "pending_check"}),
        ("ab-000001=待核。ab-000001=继续", {"ab-000001": "recommend"}),
        ("1. 卡6 ab-000001：无新增变化。隔离待核不作替补\n2. cd-000002：另议，不继续评估\n3. ef-000003：可看。停止追加", {"ab-000001": "pending_check", "ef-000003": "not_recommend"}),
        ("继续评估两条（非成熟）：\n1 ab-000001及关联cd-000002：一\n- ef-000003：二\n别的\n- gh-000004：三", {"ab-000001": "recommend", "cd-000002": "recommend", "ef-000003": "recommend"}),
        ("隔离一条：ab-000001 甲。cd-000002 乙", {"ab-000001": "pending_check"}),
        ("", {}),
    ],
)
def test_tiers(text, want):
    got = {k: t for k, t, _ in reviews.stated_tiers(text)}
    assert got == want


def test_notes_and_order():
    text = "ab-000001=待核，理由甲\ncd-000002：备选。\nab-000001 改为 继续"
    assert reviews.stated_tiers(text) == [("cd-000002", "alternate", "备选。"), ("ab-000001", "recommend", "待核，理由甲")]
    assert reviews.stated_tiers("停止一条：\n- ab-000001：x") == [("ab-000001", "not_recommend", "停止一条：｜- ab-000001：x")]


def test_merges():
    assert reviews.stated_merges("ab-000001 并入 cd-000002；ef-000003 退出独立事件位，关联fasuna；不并入gh-000004；ij-000005 无需并入 kl-000006") == [("ab-000001", "cd-000002", True), ("ef-000003", "fasuna", False)]
    assert reviews.stated_merges("无") == []


def test_short_keys_are_spelled_out_if_one_entry_fits(spark):
    given = [(1, "r1", "唯一为e1cd9d.tier；abcdef 不认，000001=待核"), (2, "r1", None), (3, "r2", "x-e1cd9d 与 e1cd9d=停止"), (4, None, "e1cd9d")]
    entries = [("r1", "one-e1cd9d"), ("r1", "a-000001"), ("r1", "b-000001"), ("r2", "two-e1cd9d"), ("r2", "two-e1cd9d"), ("r2", None)]
    a = spark.createDataFrame(given, "review_id int, run string, text string")
    b = spark.createDataFrame(entries, "run string, entry string")
    got = {r.review_id: r.text for r in reviews.spelled_out(a, b, "run").collect()}
    assert got == {1: "唯一为one-e1cd9d.tier；abcdef 不认，000001=待核", 2: "", 3: "x-e1cd9d 与 two-e1cd9d=停止", 4: "e1cd9d"}
    rows = reviews.review_tiers(reviews.spelled_out(a, b, "run")).collect()
    assert [(r.review_id, r.entry, r.tier) for r in rows] == [(3, "two-e1cd9d", "not_recommend")]
    assert reviews.review_merges(a.limit(0)).count() == 0
