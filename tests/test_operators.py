import random
import tempfile

import pytest
from pyspark.sql import functions as F

from siltstone.functions import text as X
from siltstone.functions import times as T
from siltstone.operators import flow, graph, ordered, records


def test_capped_edges_are_those_of_one_pass_in_order(spark):
    rng = random.Random(3)
    pairs = sorted({tuple(sorted(rng.sample(range(12), 2))) for _ in range(45)}, key=lambda _: rng.random())
    degree, want = {}, set()
    for a, b in pairs:
        if degree.get(a, 0) < 3 and degree.get(b, 0) < 3:
            want.add((a, b))
            degree[a], degree[b] = degree.get(a, 0) + 1, degree.get(b, 0) + 1
    df = spark.createDataFrame([(a, b, k) for k, (a, b) in enumerate(pairs)], "a long, b long, rank long")
    assert {(r.a, r.b) for r in flow.capped_edges(df, 3).collect()} == want


def test_components_of_a_long_path_and_a_star(spark):
    path = [(k, k + 1) for k in range(1, 40)]
    star = [(100, k) for k in range(101, 160)]
    rows = graph.connected_components(spark.createDataFrame(path + star + [(7, 7)], "a long, b long")).collect()
    assert {r.node: r.component for r in rows} == {k: 1 for k in range(1, 41)} | {k: 100 for k in range(100, 160)}


def test_components_of_no_edges(spark):
    none = spark.createDataFrame([], "a long, b long")
    assert graph.connected_components(none).count() == 0
    alone = graph.connected_components(none, nodes=spark.createDataFrame([(3,), (3,), (None,)], "node long"))
    assert [tuple(r) for r in alone.collect()] == [(3, 3)]


def union_find(edges):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        up[y] = x
    return {x: find(x) for x in up}


def shuffled(edges, seed):
    names = list(range(max(map(max, edges)) + 1))
    random.Random(seed).shuffle(names)
    return [(names[a], names[b]) for a, b in edges]


GRAPHS = {
    "path": shuffled([(k, k + 1) for k in range(399)], 1),
    "ordered path": [(k, k + 1) for k in range(300)],
    "grid": shuffled([(r * 20 + k, r * 20 + k + d) for r in range(20) for k in range(19) for d in (1, 20) if r < 19 or d == 1], 2),
    "star and rings": shuffled([(0, k) for k in range(1, 200)] + [(200 + k, 200 + k // 7 * 7 + (k + 1) % 7) for k in range(70)], 3),
}


@pytest.mark.parametrize("name", sorted(GRAPHS))
def test_components_by_contraction_alone(name, spark):
    edges = GRAPHS[name]
    rows = graph.connected_components(spark.createDataFrame(edges, "a long, b long"), last_edges=0).collect()
    assert {r.node: r.component for r in rows} == union_find(edges)


def test_rounds_grow_with_the_logarithm_of_a_shuffled_path(spark, monkeypatch):
    edges = shuffled([(k, k + 1) for k in range(60_000)], 4)
    rounds = []
    monkeypatch.setattr(graph, "_contracted", lambda *a, real=graph._contracted: rounds.append(1) or real(*a))
    rows = graph.connected_components(spark.createDataFrame(edges, "a long, b long").repartition(4), last_edges=2_000)
    assert rows.where("component <> 0").count() == 0 and rows.count() == 60_001 and len(rounds) < 12


def test_ranks_of_a_group_that_holds_all_rows(spark):
    df = spark.range(500).select(F.lit("x").alias("g"), "id")
    ranks = [r["rank"] for r in ordered.rank_in_group(df, ["g"], ["id"], 500, per_bucket=40).collect()]
    assert sorted(ranks) == list(range(500))


def test_running_total_over_many_parts(spark):
    df = spark.range(3000).select((F.col("id") / 2).cast("long").alias("part"), F.col("id").alias("seq"), F.lit(2).cast("long").alias("v"))
    rows = ordered.running_total(df, "part", "seq", "v", "start").collect()
    assert all(r["start"] == 2 * r["seq"] for r in rows)


def test_text_functions(spark):
    row = spark.range(1).select(
        X.norm_url(F.lit(" https://WWW.instagram.com/reel/AbC/?x=1 ")).alias("post"), X.norm_url(F.lit("HTTP://A.com/B/#f")).alias("url"),
        X.media_id(F.lit("BA")).alias("code"), X.media_id(F.lit("!")).alias("bad"), X.media_id(F.lit("123")).alias("digits"),
        X.candidate_key(F.lit("A b!"), F.lit(""), F.lit("7")).alias("key"), X.number(F.lit("1,200 s")).alias("n"), X.number(F.lit("--")).alias("none"),
        X.html_to_text(F.lit("<p>a &amp;lt; b</p><script>x</script><p> c\t d</p>")).alias("html"), X.needs_translation(F.lit("ひ")).alias("kana"),
        X.key_phrases(X.tokens(F.lit("The small red-brick house, the HOUSE"))).alias("phrases"), X.note_flags(F.lit(120), F.lit(0), F.lit(0)).alias("flags"),
        X.urls_in(F.lit("https://a.io/x). https://www.facebook.com/y https://a.io/x")).alias("urls"),
    ).first()
    assert row.post == "https://www.instagram.com/p/AbC" and row.url == "http://a.com/b"
    assert (row.code, row.bad, row.digits) == ("64", None, "123")
    assert row.key.startswith("ab-") and len(row.key) == 9
    assert row.n == 1200 and row.none is None and row.html == "a &lt; b\nc d" and row.kana
    assert row.phrases == ["small", "brick", "house", "the", "red"] and len(row.flags) == 2 and row.urls == ["https://a.io/x"]


def test_page_text_has_its_title_once_and_no_menus(spark):
    pages = ["<head><title> A &amp; b </title></head><nav>menu</nav><p>x<br>y</p><form>f</form>", "<title>x</title><p>x y</p>", "<p>z</p><title>T</title>", "", None]
    df = spark.createDataFrame([(h,) for h in pages], "h string")
    assert [r[0] for r in df.select(X.html_to_text(F.col("h"))).collect()] == ["A & b x\ny", "x x y", "T\nz\nT", "", None]
    heat = lambda *v: X.heat_note(*(F.lit(x).cast("long") for x in v[:4]), F.lit(v[4]), F.lit(v[5]).cast("array<string>"))
    row = spark.range(1).select(heat(5, None, 9, 2, 2.5, ["a", " "]).alias("a"), heat(5, 1, None, None, 2.5, None).alias("b"), heat(None, None, None, 3, 1.0, None).alias("c"), heat(None, None, None, None, None, ["t"]).alias("d")).first()
    assert tuple(row) == ("5 赞 · 常态 2 的 2.5× · 账号 9 粉丝；标签：a", "5 赞 · 常态的 2.5× · 1 评论", "热度不详", "标签：t")


def test_monday_looks_back_three_days_and_marks_ahead_are_not_trusted(spark):
    now = F.lit("2024-01-07 18:00:00").cast("timestamp")  # Monday at UTC+8
    rows = spark.range(1).select(T.round_window(now, F.lit(None).cast("timestamp")).alias("a"), T.round_window(now, F.lit("2024-02-01").cast("timestamp")).alias("b"), T.round_window(now, F.lit("2023-01-01").cast("timestamp")).alias("c"), T.task_window(now, F.lit("2024-01-07 12:00:00").cast("timestamp"), F.lit("2024-01-07 10:00:00").cast("timestamp")).alias("d")).first()
    hours = lambda w: (w.end - w.start).total_seconds() / 3600
    assert [hours(rows[k]) for k in "abcd"] == [72, 72, 216, 8] and [rows[k].truncated for k in "abcd"] == [False, False, True, False]


def test_upsert_does_not_depend_on_row_order(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "k int, s string, n string")
    new = spark.createDataFrame([(2, "c", ""), (3, "d", None)], "k int, s string, n string")
    got = records.upsert(old, new, ["k"], {"s": "overwrite", "n": "keep"})
    assert sorted(map(tuple, got.collect())) == [(1, "a", "x"), (2, "c", "y"), (3, "d", None)]


def test_layers_find_the_longest_path_and_cycles_fail(spark):
    rows = flow.layers(spark.createDataFrame([(1, 2), (2, 3), (1, 3)], "up int, down int")).collect()
    assert {r.node: r.layer for r in rows} == {1: 0, 2: 1, 3: 2}


def test_stalled_runs(spark):
    ts = lambda m: f"2024-01-01 10:{m:02d}:00"
    runs = spark.createDataFrame([(1, "active"), (2, "active"), (3, "done")], "run int, status string")
    tasks = spark.createDataFrame([(1, "blocked"), (2, "blocked"), (2, "running"), (3, "ready")], "run int, status string")
    events = spark.createDataFrame([(1, ts(0)), (2, ts(0)), (3, ts(0))], "run int, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    assert [r.run for r in flow.stalled(runs, tasks, events, F.lit(ts(40)).cast("timestamp"), 30).collect()] == [1]


def test_memory_picks_join_the_front_of_a_brand_only(spark, monkeypatch):
    """Against all pairs, with addresses that hide the first cases of a brand; a brand stands in the join with six cases of a kind."""
    from siltstone.operators import records

    tables = []
    real = records.materialize
    monkeypatch.setattr(records, "materialize", lambda df, name: tables.append(real(df, name)) or tables[-1])
    rng = random.Random(5)
    cases = [(k, f"b{rng.randrange(3)}", rng.choice([None, "", "u1", "u1", "u2", f"u{k}"]), rng.choice(["adopted", "rejected"]), rng.randrange(9)) for k in range(200)]
    asked = [(q, f"b{b}", f"u{q}" if q else None) for q in range(12) for b in range(1 + q % 3)]
    out = records.memory_picks(
        spark.createDataFrame(asked, "asked int, brand string, url string"), spark.createDataFrame(cases, "case int, brand string, url string, decision string, place int"),
        spark.createDataFrame([], "asked int, case int, sim double"))
    want = set()
    for q in range(12):
        own = {b for a, b, _ in asked if a == q}
        for kind in (True, False):
            shown = sorted((p, k) for k, b, u, d, p in cases if b in own and (d == "adopted") == kind and not (q and u == f"u{q}"))
            want |= {(q, k) for _, k in shown[:3]}
    assert {(r.asked, r.case) for r in out.collect()} == want
    assert [t.groupBy("brand", "kind").count().agg({"count": "max"}).first()[0] for t in tables] == [6]


def test_two_places_are_those_of_c(spark, duck):
    values = [k / 10000 for k in range(5000, 10001, 5)] + [0.0, None]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(X.two_places(F.col("v"))).collect()]
    assert got == [duck.execute("SELECT printf('%.2f', ?::DOUBLE)", [v]).fetchone()[0] if v is not None else None for v in values]


def test_media_ids_above_eighteen_bits(spark):
    from siltstone.plans.registry import QUERIES

    ids = [0, 63, 2**18 - 1, 2**18, 2**18 + 5, 10**10, 2**63 - 1]

    with tempfile.TemporaryDirectory() as folder:
        spark.createDataFrame([(k,) for k in ids], "doc_id long").write.parquet(f"{folder}/documents.parquet")
        assert {(r.doc_id, r.id) for r in QUERIES["o129_media_id"](spark, folder).collect()} == {(k, str(k)) for k in ids}
