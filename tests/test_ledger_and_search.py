import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.functions import text as X
from siltstone.operators import automata, flow, neighbours, records, search


def test_weight_batches_fill_in_turn_and_keep_heavy_ones_alone(spark):
    df = spark.createDataFrame([(1, [3, 3, 3, 9, 1]), (2, []), (3, [9, 9])], "k int, w array<long>")
    got = {r.k: r.b for r in df.select("k", records.weight_batches(F.col("w"), 6).alias("b")).collect()}
    assert got == {1: [0, 0, 1, 2, 3], 2: [], 3: [0, 1]}


def test_replay_answers_or_fails(spark):
    asked = spark.createDataFrame([(1, "x"), (2, "y")], "id int, a string").withColumn("h", records.request_hash(b=F.col("id"), a=F.col("a")))
    known = asked.select("h", F.lit("yes").alias("answer"))
    assert [r.answer for r in records.replay(asked, known, "h", "answer").collect()] == ["yes", "yes"]
    with pytest.raises(Exception, match="no record of request"):
        records.replay(asked, known.limit(1), "h", "answer").collect()


def test_inherit_leaves_null_keys_alone(spark):
    df = spark.createDataFrame([(1, "a", 5), (2, "a", None), (3, None, 7), (4, None, None), (5, "b", None)], "id int, h string, v int")
    assert {r.id: r.v for r in records.inherit(df, "h", "v").collect()} == {1: 5, 2: 5, 3: 7, 4: None, 5: None}


def test_first_policy_keeps_the_old_value(spark):
    old = spark.createDataFrame([(1, False), (2, None)], "k int, active boolean")
    new = spark.createDataFrame([(1, True), (2, True), (3, True)], "k int, active boolean")
    assert {r.k: r.active for r in records.upsert(old, new, ["k"], {"active": "first"}).collect()} == {1: False, 2: True, 3: True}


def test_closure_of_a_cycle(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "up int, down int")
    got = {(r.node, r.reach) for r in flow.closure(edges).collect()}
    assert got == {(a, b) for a in (1, 2, 3) for b in (1, 2, 3, 4)}


def test_many_aliases_give_the_same_hits(spark, monkeypatch):
    texts = spark.createDataFrame([(1, "The Springfield-ring of a kind"), (2, "And Wander packs"), (3, None), (4, "")], "id int, t string")
    aliases = spark.createDataFrame([("r", "ring"), ("r", "field-ring"), ("w", "and wander"), ("k", "a Kind"), ("n", "zzz")], "brand string, alias string")
    small = sorted(map(tuple, search.contains_alias(texts, "id", "t", aliases).collect()))
    monkeypatch.setattr(automata, "CHARACTERS", 5)
    assert sorted(map(tuple, search.contains_alias(texts, "id", "t", aliases).collect())) == small
    assert small == [(1, "k", "a Kind"), (1, "r", "field-ring"), (2, "w", "and wander")]


def test_similar_pairs_in_cells_match_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(60, 4))
    rows = [(i, [float(x) for x in v[i]]) for i in range(60)] + [(60, None), (61, [0.0] * 4), (62, [float("nan"), 1.0, 0.0, 0.0]), (63, [None, 1.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    n = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = {(i, j) for i in range(60) for j in range(i + 1, 60) if n[i] @ n[j] >= 0.8}
    monkeypatch.setattr(neighbours.Cells.__init__, "__defaults__", (5,))
    monkeypatch.setattr(neighbours, "TILE_BYTES", 8 * 4 * 6)
    got = search.similar_pairs(df, 0.8).collect()
    assert {(r.i, r.j) for r in got} == want and len(got) == len(want)
    assert search.similar_pairs(df.limit(0), 0.8).count() == 0


def test_near_in_time_at_the_edges(spark):
    df = spark.createDataFrame([(1, "a", 0), (2, "a", 1200), (3, "a", 1801), (4, "b", 0), (5, "a", -600)], "id int, k string, s long").withColumn("ts", F.timestamp_seconds("s"))
    seen = spark.createDataFrame([("a", 600), ("a", -1200)], "k string, s long").withColumn("ts", F.timestamp_seconds("s"))
    assert {r.id for r in records.near_in_time(df, seen, "k", "ts", 600).collect()} == {3, 4}


def test_candidates(spark):
    df = spark.createDataFrame([("Out Sep 18, 2026 or 2026年9月18日 or SEP 18, 2026, ¥12,800 and 899 元", "Foo"), ("FOO: red bag. foo x! foo - foo hat", "foo"), (None, "a"), ("", "a")], "t string, a string")
    got = df.select(X.date_candidates(F.col("t")).alias("d"), X.price_candidates(F.col("t")).alias("p"), X.product_candidates(F.col("t"), F.col("a")).alias("n")).collect()
    assert got[0].d == ["Sep 18, 2026", "2026年9月18日"] and got[0].p == ["¥12,800", "899 元"] and got[0].n == []
    assert got[1].n == ["foo red bag", "foo foo hat", "foo hat"]
    assert got[2].d is None and got[3].n == []


def test_aliases_of_signs_are_found_either_way(spark, monkeypatch):
    texts = spark.createDataFrame([(1, "we say +++ and & more"), (2, "nothing"), (3, "c++ is +")], "id int, t string")
    aliases = spark.createDataFrame([("plus", "+++"), ("amp", "&"), ("c", "c++"), ("one", "+"), ("none", None)], "brand string, alias string")
    small = sorted(map(tuple, search.contains_alias(texts, "id", "t", aliases).collect()))
    assert small == [(1, "amp", "&"), (1, "one", "+"), (1, "plus", "+++"), (3, "c", "c++"), (3, "one", "+")]
    monkeypatch.setattr(automata, "CHARACTERS", 2)
    assert sorted(map(tuple, search.contains_alias(texts, "id", "t", aliases).collect())) == small


def test_nearest_leaves_out_vectors_without_direction(spark, monkeypatch):
    """In one block of queries and in several; zero, null and non-finite vectors, other lengths and ties."""
    rng = np.random.default_rng(5)
    v = rng.integers(-2, 3, size=(50, 3)).astype(float)
    rows = [(k, x.tolist()) for k, x in enumerate(v)] + [(50, [0.0] * 3), (51, None), (52, [float("inf"), 1.0, 0.0]), (53, [1.0, 2.0]), (54, [1e300, 1e300, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    good = {k: np.array(x) / max(map(abs, x)) for k, x in rows if x and len(x) == 3 and np.isfinite(x).all() and any(x)}
    good = {k: x / np.linalg.norm(x) for k, x in good.items()}
    want = []
    for q in sorted(good):
        if q < 20:
            best = sorted(((-round(float(good[q] @ x), 6) + 0.0, k) for k, x in good.items() if k != q))[:5]
            want += [(q, k, round(-s, 6), r) for r, (s, k) in enumerate(best, 1)]
    monkeypatch.setattr(neighbours.Cells.__init__, "__defaults__", (6,))
    monkeypatch.setattr(neighbours, "TILE_BYTES", 8 * 3 * 5)
    for size in (None, 0):
        got = search.nearest(df.where("vec_id < 20 OR vec_id = 50").selectExpr("vec_id AS query_id", "embedding"), df, 5, query_bytes=size).select("query_id", "vec_id", "similarity", "rank").collect()
        assert sorted((r[0], r[1], round(r[2], 6) + 0.0, r[3]) for r in got) == sorted((a, b, s + 0.0, r) for a, b, s, r in want)


@pytest.mark.parametrize("query_bytes", [None, 0])
def test_nearest_of_clusters_and_copies_at_2048_dimensions(spark, query_bytes):
    """Every vector is a query; a third are copies of one; ids are strings; the time of a dimension doesn't grow with it."""
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(6, 2048))
    x = centres[rng.integers(0, 6, 90)] + 0.3 * rng.normal(size=(90, 2048))
    x[30:60] = x[30]
    df = spark.createDataFrame([(f"v{k:03d}", v.tolist()) for k, v in enumerate(x)], "vec_id string, embedding array<double>")
    n = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(n @ n.T, 6)
    want = []
    for q in range(90):
        want += [(f"v{q:03d}", f"v{k:03d}", r) for r, (_, k) in enumerate(sorted((-s[q, k], k) for k in range(90) if k != q)[:4], 1)]
    began = time.time()
    got = search.nearest(df.selectExpr("vec_id AS query_id", "embedding"), df, 4, query_bytes=query_bytes).collect()
    assert sorted((r.query_id, r.vec_id, r["rank"]) for r in got) == sorted(want)
    assert time.time() - began < 60


def test_pictures_take_the_nearest_free_one(spark):
    import random

    rng = random.Random(8)
    rows = []
    for item in range(40):
        rows += [(item, side, place, rng.randrange(64)) for side in (0, 1) for place in range(1, rng.randrange(2, 7))]
    df = spark.createDataFrame(rows, "item int, side int, place int, print long")
    side = lambda k: F.array_sort(F.collect_list(F.when(F.col("side") == k, F.struct("place", "print")))).alias(f"s{k}")
    got = df.groupBy("item").agg(side(0), side(1)).select("item", F.explode(records.assign_nearest(F.col("s0"), F.col("s1"), 2)).alias("x")).select("item", "x.*").collect()
    want = set()
    for item in range(40):
        free = {p: x for i, s, p, x in rows if i == item and s == 1}
        for p, x in sorted((p, x) for i, s, p, x in rows if i == item and s == 0):
            near = min(((bin(x ^ y).count("1"), q != p, q) for q, y in free.items()), default=(9,))
            if near[0] <= 2:
                want.add((item, p, near[2], near[0]))
                del free[near[2]]
    assert {tuple(r) for r in got} == want


def test_layers_of_a_cycle_fail_and_long_paths_settle(spark):
    with pytest.raises(ValueError, match="cycle"):
        flow.layers(spark.createDataFrame([(1, 2), (2, 3), (3, 2)], "up int, down int"))
    path = spark.createDataFrame([(k, k + 1) for k in range(70)], "up int, down int")
    assert flow.closure(path).count() == 70 * 71 // 2
