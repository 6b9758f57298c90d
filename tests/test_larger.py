"""What must not grow with the square of a group, with a batch's texts or with a fixed number of tasks."""

import random
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siltstone.operators import prints
from siltstone.plans.registry import QUERIES


def test_cells_of_a_long_text_take_one_pass(spark):
    text = "".join(random.Random(1).choices("eéa🙂 ", k=400_000))
    df = spark.createDataFrame([(1, text), (2, "eee"), (3, ""), (4, None)], "id int, t string")
    df.select(prints.text_cells(F.col("t"), "e")).where("id > 1").collect()
    began = time.time()
    got = {r.id: r.c for r in df.select("id", prints.text_cells(F.col("t"), "e", 0.1, 0.9).alias("c")).collect()}
    assert time.time() - began < 10
    cut = [40_000 + 320_000 * i // 72 for i in range(73)]
    assert got[1] == [text[a:b].count("e") for a, b in zip(cut, cut[1:])]
    assert sum(got[2]) == 2 and got[3] == [0] * 72 and got[4] == [None] * 72


def test_recall_takes_a_query_s_own_targets_only(spark, duck, same, tmp_path, monkeypatch):
    """One source and two labels: targets are those of the pool and two more of the label, not all of it."""
    import duckdb

    from siltstone.operators import measures
    from siltstone.plans.registry import ORACLES

    rng = random.Random(4)
    rows = [(k, [rng.gauss(0, 1) for _ in range(4)], k % 2 if k != 300 else 9) for k in range(400)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([(k, "one") for k in range(400)], "doc_id long, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    real = measures.recall_by_route
    monkeypatch.setattr(measures, "recall_by_route", lambda pool, targets, *a: seen.append((pool.count(), targets.count())) or real(pool, targets, *a))
    con = duckdb.connect()
    for name in ("embeddings", "documents"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    same(QUERIES["o073_recall_by_route"](spark, str(tmp_path)), con, ORACLES["o073_recall_by_route"])
    assert seen[0][1] <= seen[0][0] + 2 * 4


@pytest.mark.parametrize("kind", ["text", "words"])
def test_batches_are_cut_by_what_they_hold(kind):
    from siltstone.operators.batches import in_slices

    values = ["x" * n for n in (0, 3, 4, 50, 1, 2, 0)] + [None]
    column = pa.array(values) if kind == "text" else pa.array([None if v is None else list(v) for v in values], pa.list_(pa.string()))
    batch = pa.RecordBatch.from_arrays([pa.array(range(8)), column], ["k", "v"])
    parts = [p.column(0).to_pylist() for p in in_slices([batch, batch.slice(0, 0)], 7)]
    assert parts == [[0, 1, 2], [3], [4, 5, 6, 7]]


def test_only_blocked_tasks_are_joined_with_what_they_need(spark, tmp_path, monkeypatch):
    from siltstone.operators import flow

    lines = [(r, k, "R" if k == 20 else "A" if r else "N") for r in range(2) for k in range(1, 21)]
    spark.createDataFrame(lines + [(2, 1, "R"), (3, 1, "A"), (3, 1, "N"), (3, 2, "R")], "l_orderkey long, l_linenumber long, l_returnflag string").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    seen = []
    real = flow.ready
    monkeypatch.setattr(flow, "ready", lambda tasks, deps: seen.append(deps.count()) or real(tasks, deps))
    assert {(r.run, r.task) for r in QUERIES["o151_readiness"](spark, str(tmp_path)).collect()} == {(1, 20), (2, 1)}
    assert seen == [2 * 19 + 2]


@pytest.mark.parametrize("kind", ["float", "double"])
def test_pairs_send_a_vector_to_each_tile_not_to_each_cell(spark, monkeypatch, kind):
    """Vectors of two dimensions without clusters, near and exact copies, and an id that occurs twice."""
    import numpy as np

    from siltstone.operators import neighbours

    rng = np.random.default_rng(8)
    v = [rng.normal(size=6 if k % 3 else 5) for k in range(900)]
    v[600:640] = [v[1]] * 40
    v[640:680] = [v[1] + 0.01 * rng.normal(size=6) for _ in range(40)]
    ids = [*range(-10, 889), 5]
    df = spark.createDataFrame([(i, x.astype("f4" if kind == "float" else "f8").tolist()) for i, x in zip(ids, v)], f"vec_id long, embedding array<{kind}>")
    unit = [x / np.linalg.norm(x) for x in (x.astype("f4" if kind == "float" else "f8").astype(float) for x in v)]
    want = []
    for n in (5, 6):
        own = [k for k in range(900) if len(v[k]) == n]
        s = np.array([unit[k] for k in own]) @ np.array([unit[k] for k in own]).T
        want += [(min(ids[a], ids[b]), max(ids[a], ids[b]), round(s[p, q], 4)) for p, a in enumerate(own) for q, b in enumerate(own) if p < q and ids[a] != ids[b] and s[p, q] >= 0.9]
    written = []
    real = neighbours.materialize
    monkeypatch.setattr(neighbours, "materialize", lambda df, name: written.append((t := real(df, name)).count()) or t)
    for tile_rows in (100, 2048):
        monkeypatch.setattr(neighbours, "TILE_ROWS", tile_rows, raising=False)
        written.clear()
        got = sorted(map(tuple, neighbours.similar_pairs(df, 0.9).collect()))
        assert [x[:2] for x in got] == [x[:2] for x in sorted(want)] and max(abs(x[2] - y[2]) for x, y in zip(got, sorted(want))) < 2e-4
        assert max(written) <= 900
        cells = neighbours.Cells(neighbours.units(df, "vec_id", given=True))
        tiles = max(at + parts for at, parts in cells.tiles().values())
        assert (tiles == 2 if tile_rows == 2048 else 9 <= tiles <= 20) and neighbours.tile_pairs(cells, 0.9).count() <= 900 * tiles


def test_pairs_of_many_copies_are_whole(spark):
    from siltstone.operators import neighbours

    df = spark.range(2500).selectExpr("id AS vec_id", "array(1.0D, 2.0D, if(id < 3, -2.0D, 2.0D)) AS embedding")
    assert [tuple(r) for r in neighbours.similar_pairs(df, 0.7).groupBy("similarity").count().collect()] == [(1.0, 2497 * 2496 // 2 + 3)]


@pytest.mark.parametrize("name", ["o054_similar_pairs", "o119_edge_confirmation", "o122_merge_notes"])
def test_pairs_of_made_vectors_are_those_of_sql(spark, same, tmp_path, monkeypatch, name):
    """Clusters and vectors without any, as the given tables have no pairs; no table between is larger than the vectors."""
    import duckdb
    import numpy as np

    from siltstone.operators import neighbours
    from siltstone.plans import relational  # noqa: F401
    from siltstone.plans.registry import ORACLES

    rng = np.random.default_rng(9)
    x = rng.normal(size=(400, 16))
    x[:60] = x[rng.integers(60, 70, 60)] + rng.uniform(0.1, 0.9, (60, 1)) * rng.normal(size=(60, 16))
    spark.createDataFrame([(k, v.tolist(), 0) for k, v in enumerate(x)], "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert con.execute(f"SELECT count(*) FROM ({ORACLES[name]})").fetchone()[0] > 20
    written = []
    real = neighbours.materialize
    monkeypatch.setattr(neighbours, "materialize", lambda df, name: written.append((t := real(df, name)).count()) or t)
    same(QUERIES[name](spark, str(tmp_path)), con, ORACLES[name])
    assert max(written) <= 400


def made_vectors(kind: str, n: int = 64):
    """600 vectors of length 1 without clusters, lying evenly, mostly along few directions or about a mean, and partners of 60 of them at cosines about 0.85."""
    import numpy as np

    rng = np.random.default_rng(13)
    x = rng.normal(size=(600, n)) * (0.9 ** np.arange(n) if kind == "few" else 1) + (0.5 if kind == "mean" else 0)
    x /= np.linalg.norm(x, axis=1)[:, None]
    side = rng.normal(size=(60, n))
    side -= np.einsum("ij,ij->i", side, x[:60])[:, None] * x[:60]
    s = np.linspace(0.8495, 0.8504, 60)[:, None]
    return np.concatenate([x, s * x[:60] + np.sqrt(1 - s * s) * side / np.linalg.norm(side, axis=1)[:, None]])


@pytest.mark.parametrize("kind", ["evenly", "few", "mean"])
def test_short_forms_are_short_and_never_below_the_cosine(kind):
    import numpy as np

    from siltstone.operators import neighbours

    x = made_vectors(kind)
    ways = neighbours.short_ways({64: (0, x[:256])}, 0.8499)
    assert 4 <= ways[64].shape[1] <= 48
    short = neighbours.short_form(x, ways[64])
    assert short.shape[1] == ways[64].shape[1] + 1 and (short @ short.T >= x @ x.T - 70 / (1 << 23)).all()
    assert not neighbours.short_ways({64: (0, x[:20])}, 0.8499)
    copies = np.repeat(x[:64], 4, axis=0)
    assert (neighbours.short_form(copies, ways[64]) @ neighbours.short_form(copies, ways[64]).T >= copies @ copies.T - 70 / (1 << 23)).all()


@pytest.mark.parametrize("kind", ["evenly", "few", "mean"])
def test_confirmed_edges_are_those_of_sql_near_the_line(spark, same, tmp_path, monkeypatch, kind):
    """Only pairs that can be confirmed are asked for, and vectors go to tiles by many in a row."""
    import duckdb

    from siltstone.operators import neighbours, search
    from siltstone.plans import relational  # noqa: F401
    from siltstone.plans.registry import ORACLES

    rows = [(k, v.tolist(), 0) for k, v in enumerate(made_vectors(kind))]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    lines, dealt = [], []
    pairs, tiles = search.similar_pairs, neighbours.tile_pairs
    monkeypatch.setattr(search, "similar_pairs", lambda df, line, *a: lines.append(line) or pairs(df, line, *a))
    monkeypatch.setattr(neighbours, "tile_pairs", lambda *a: dealt.append((t := tiles(*a)).count()) or t)
    monkeypatch.setattr(neighbours, "TILE_ROWS", 100)
    name = "o119_edge_confirmation"
    found = QUERIES[name](spark, str(tmp_path))
    same(found, con, ORACLES[name])
    assert 20 < found.where("i < 60 AND j >= 600 AND probability < 0.503").count() < 60
    assert 0.84 < lines[0] <= 0.84995 and dealt[0] <= 660
