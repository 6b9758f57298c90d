"""Exact neighbours of vectors by cosine, and pairs above a line.

Vectors are brought to length 1 in Arrow batches. Few queries are sent to every task, which reads its vectors once and
keeps the best of each query. Many queries visit cells: vectors belong to the nearest of some pivots, and from the widest
angle in a cell follows the highest cosine that any of its vectors can have with a query, so that cells that can't hold
a better neighbour aren't visited. Pivots decide what is left out of the work, never what is found.

For pairs, cells are packed into few large tiles, and a vector is sent once to each tile that can have a partner of it,
not to each cell. Products in 32-bit floating point with a margin for their error leave the pairs that are computed
again in double precision. They are of short forms where these do: the parts along some directions and the length of the
rest, whose product is never below the cosine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.operators.records import top_per_key
from siltstone.session import materialize

#: Bytes of queries that are sent to every task, and of vectors or queries of a tile.
QUERY_BYTES = 32 << 20
TILE_BYTES = 16 << 20
#: Products that a task has at a time.
PRODUCTS = 1 << 22
PIVOTS = 256
#: Tiles of pairs: as many at least, so that all tasks have work, but none smaller than so many vectors.
TILES, TILE_ROWS = 8, 2048
#: Rows and columns of products that a task has at a time, and their share from which all are computed in double precision.
BLOCK, DENSE = (512, 512), 0.02
#: Share of a tile's vectors from which a cell is compared with all of them.
MOST = 0.8
#: What computing a pair again takes, in components of a product, and pivots of a dimension below which all components are used.
AGAIN, TRIED = 40_000, 64
#: What an angle, and a cosine rounded to six places, may be off.
SLACK = 2e-6


def unit_rows(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows and their vectors at length 1 for each dimension of a list column.

    Null, empty and zero vectors and those with null or non-finite parts are left out.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # a null part is NaN
    start = np.cumsum(size) - size
    for n in np.unique(size[size > 0]).tolist():
        rows = np.flatnonzero(size == n)
        x = flat.reshape(-1, n) if len(rows) * n == len(flat) else flat[start[rows][:, None] + np.arange(n)]
        top = np.abs(x).max(axis=1)
        good = np.isfinite(top) & (top > 0)
        yield rows[good], _length_one(x[good], top[good])


def _length_one(x: np.ndarray, top: np.ndarray) -> np.ndarray:
    x = x / top[:, None]
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _lists(x: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))


def units(df: DataFrame, key: str, vector: str = "embedding", given: bool = False) -> DataFrame:
    """id, n (the dimension) and v, the vector at length 1, of the rows whose vector has a direction and whose key isn't null.

    given: v is the vector as it is given.
    """

    def work(batches):
        for b in batches:
            for rows, x in unit_rows(b.column(1)):
                take = pa.array(rows)
                yield pa.RecordBatch.from_arrays([b.column(0).take(take), pa.array(np.full(len(rows), x.shape[1], np.int32)), b.column(1).take(take) if given else _lists(x)], ["id", "n", "v"])

    rows = df.where(F.col(key).isNotNull()).select(key, vector)
    kind = rows.schema[vector].dataType.simpleString() if given else "array<double>"
    return rows.mapInArrow(work, f"id {rows.schema[key].dataType.simpleString()}, n int, v {kind}")


class _Best:
    """The k best of each query so far, by similarity, then by key."""

    def __init__(self, k: int):
        self.k = k
        self.query, self.key, self.s = np.zeros(0, np.int64), None, np.zeros(0)

    def add(self, query: np.ndarray, key: np.ndarray, s: np.ndarray) -> None:
        q, s = np.concatenate([self.query, query]), np.concatenate([self.s, s])
        key = key if self.key is None else np.concatenate([self.key, key])
        order = np.lexsort((key, -s, q))
        q = q[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        keep = order[place < self.k]
        self.query, self.key, self.s = q[place < self.k], key[keep], s[keep]

    def products(self, query: np.ndarray, x: np.ndarray, same: np.ndarray, key: np.ndarray, y: np.ndarray) -> None:
        """Compare x, of the numbers query, with y. same: for each of y the place in x of the same id, or -1."""
        step = max(1, PRODUCTS // max(len(x), 1))
        for a in range(0, len(y), step):
            s = np.round(x @ y[a : a + step].T, 6)
            own = same[a : a + step]
            s[own[own >= 0], np.flatnonzero(own >= 0)] = -np.inf
            if s.shape[1] > self.k:
                s[s < np.partition(s, s.shape[1] - self.k, axis=1)[:, s.shape[1] - self.k, None]] = -np.inf
            i, j = np.nonzero(s > -np.inf)
            self.add(query[i], key[a + j], s[i, j])


def _places(ids: pa.Array, among: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.index_in(ids, value_set=among), -1).to_numpy(zero_copy_only=False).astype(np.int64)


def _keys(ids: pa.Array) -> np.ndarray:
    x = ids.to_numpy(zero_copy_only=False)
    return x.astype(str) if x.dtype == object else x


def _scan(q: pa.Table, vectors: DataFrame, key: str, vector: str, k: int, schema: str) -> DataFrame:
    """The k best of each query in each task's vectors."""
    shared = vectors.sparkSession.sparkContext.broadcast(q)  # QUERY_BYTES at most
    rows = vectors.where(F.col(key).isNotNull()).select(key, vector)

    def work(batches):
        t = shared.value
        ids = t["id"].combine_chunks()
        size = t["n"].to_numpy()
        flat = t["v"].combine_chunks().flatten().to_numpy()
        start = np.cumsum(size) - size
        sets = {n: (r := np.flatnonzero(size == n), flat[start[r][:, None] + np.arange(n)], ids.take(pa.array(r))) for n in np.unique(size).tolist()}
        best = _Best(k)
        for b in batches:
            for mine, y in unit_rows(b.column(1)):
                if y.shape[1] in sets:
                    r, x, own = sets[y.shape[1]]
                    keys = b.column(0).take(pa.array(mine))
                    best.products(r, x, _places(keys, own), _keys(keys), y)
        if len(best.s):
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(best.query)), pa.array(best.key), pa.array(best.s)], ["query", "key", "similarity"])

    return rows.mapInArrow(work, schema)


class Cells:
    """Vectors dealt to the nearest of some pivots, with the number and the widest angle of each cell."""

    def __init__(self, vectors: DataFrame, pivots: int = PIVOTS):
        """vectors: what units() gives. At most `pivots` vectors, by the hash of their ids, are sent to all tasks."""
        self.spark = vectors.sparkSession
        chosen = vectors.orderBy(F.xxhash64("id"), "id").limit(pivots).select("v").toArrow()
        self.pivots, first = {}, 0
        for _, x in unit_rows(chosen["v"]):
            self.pivots[x.shape[1]] = (first, x)
            first += len(x)
        shared = self.spark.sparkContext.broadcast(self.pivots)
        kind, list_kind = (vectors.schema[k].dataType.simpleString() for k in ("id", "v"))

        def work(batches):
            for b in batches:
                for rows, x in unit_rows(b.column(2)):
                    n = x.shape[1]
                    first, pivots = shared.value.get(n, (-n, x[:1]))  # a dimension without a pivot is a cell of its own
                    s = x @ pivots.T
                    cell = s.argmax(axis=1)
                    angle = np.arccos(np.clip(s[np.arange(len(x)), cell], -1, 1)) if n in shared.value else np.full(len(x), np.pi)
                    cell = first + cell if n in shared.value else np.full(len(x), first)
                    take = pa.array(rows)
                    yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), b.column(2).take(take), pa.array(cell), pa.array(angle)], ["id", "n", "v", "cell", "angle"])

        self.rows = materialize(vectors.mapInArrow(work, f"id {kind}, n int, v {list_kind}, cell long, angle double"), "cells")
        found = self.rows.groupBy("cell", "n").agg(F.count("*").alias("size"), F.max("angle").alias("angle")).collect()  # a row for each pivot and dimension
        self.size = {r["cell"]: (r["n"], r["size"], r["angle"]) for r in found}

    def visits(self, queries: DataFrame, line: str | None, k: int = 0) -> DataFrame:
        """queries with a row for each cell to visit. With a column line: cells that can have a cosine of line or more;
        without: those of the nearest pivots, until they have k vectors and one more."""
        shared, sizes = self.spark.sparkContext.broadcast(self.pivots), self.spark.sparkContext.broadcast(self.size)
        names = ["id", "n", "v", *([line, "seen"] if line and "seen" in queries.columns else [line] if line else [])]
        kind = queries.schema["id"].dataType.simpleString()

        def work(batches):
            for b in batches:
                for rows, x in unit_rows(b.column(2)):
                    n = x.shape[1]
                    known = {c: (m, a) for c, (d, m, a) in sizes.value.items() if d == n}
                    if not known:
                        continue
                    cells = np.array(list(known))
                    many = np.array([known[c][0] for c in known])
                    wide = np.array([known[c][1] for c in known])
                    first, pivots = shared.value.get(n, (-n, None))
                    angle = np.arccos(np.clip(x @ pivots[cells - first].T, -1, 1)) if pivots is not None else np.zeros((len(x), 1))
                    if line:
                        low = b.column(3).to_numpy(zero_copy_only=False)[rows]
                        go = np.cos(np.maximum(angle - wide - SLACK, 0)) >= low[:, None] - SLACK
                        if len(names) == 5:
                            seen = b.column(4).to_pylist()
                            for i, r in enumerate(rows.tolist()):
                                go[i] &= ~np.isin(cells, seen[r])
                    else:
                        order = np.argsort(angle, axis=1, kind="stable")
                        before = np.cumsum(many[order], axis=1) - many[order]
                        go = np.zeros(angle.shape, bool)
                        np.put_along_axis(go, order, before < k + 1, axis=1)
                    i, j = np.nonzero(go)
                    for a in range(0, len(i), 4096):
                        take = pa.array(rows[i[a : a + 4096]])
                        yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(2).take(take), pa.array(cells[j[a : a + 4096]])], ["id", "v", "cell"])

        return queries.select(*names).mapInArrow(work, f"id {kind}, v array<double>, cell long")

    def tiles(self) -> dict[int, tuple[int, int]]:
        """The first tile of each cell and how many it has: small cells of a dimension share one, large ones have several."""
        out, at = {}, 0
        for n in sorted({n for n, _, _ in self.size.values()}):
            own = {c: size for c, (m, size, _) in sorted(self.size.items()) if m == n}
            room = max(1, min(TILE_BYTES // (8 * n), max(TILE_ROWS, -(-sum(own.values()) // TILES))))
            held = 0
            for cell, size in own.items():
                if held and held + size > room:
                    at, held = at + 1, 0
                parts = -(-size // room)
                out[cell] = (at, parts)
                at, held = (at + parts, 0) if parts > 1 else (at, held + size)
            at += held > 0
        return out

    def meet(self, visits: DataFrame, work, schema: str) -> DataFrame:
        """work on tiles: some of the queries of a cell and some of its vectors, TILE_BYTES of each at most."""
        visits = materialize(visits, "visits")
        known = {r["cell"]: r["n"] for r in visits.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # a row for each cell
        parts = []
        for cell, (n, size, _) in self.size.items():
            room = max(1, TILE_BYTES // (8 * n))
            parts.append((cell, -(-size // room), -(-known.get(cell, 0) // room)))
        table = F.broadcast(self.spark.createDataFrame([p for p in parts if p[2]], "cell long, parts long, turns long"))  # a row for each cell
        left = visits.join(table, "cell").withColumn("turn", F.pmod(F.xxhash64("id"), F.col("turns"))).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        right = self.rows.join(table, "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts"))).withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("turns") - 1)))
        tile = ["cell", "part", "turn"]
        return left.select(*tile, "id", "v").groupBy(*tile).cogroup(right.select(*tile, "id", "v").groupBy(*tile)).applyInArrow(work, schema)


def _matrix(t: pa.Table) -> np.ndarray:
    return t["v"].combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1)


def nearest(queries: DataFrame, vectors: DataFrame, k: int, query_key: str = "query_id", key: str = "vec_id", query_bytes: int | None = None) -> DataFrame:
    """The k most similar other vectors of each query: query_key, key, similarity, rank; exact, ties by key.

    Vectors without a direction and null keys are left out; only vectors of one dimension have a similarity. query_key
    tells queries apart. The queries are counted; up to query_bytes of them are sent to all tasks, and a task passes on
    k rows for a query. More visit cells in two rounds: the first gives each query a line, its k-th similarity so far;
    in the second it visits all other cells that can have a vector at that line or above.
    """
    q = materialize(units(queries, query_key), "queries")
    most, dimension = q.agg(F.count("*"), F.max("n")).first()  # type: ignore[misc]
    kinds = {c: f.schema[c].dataType.simpleString() for c, f in ((query_key, queries), (key, vectors))}
    schema = f"query {kinds[query_key]}, key {kinds[key]}, similarity double"
    out = [F.col("query").alias(query_key), F.col("key").alias(key), "similarity"]
    if most * (dimension or 0) * 8 <= (QUERY_BYTES if query_bytes is None else query_bytes):
        found = _scan(q.toArrow(), vectors, key, "embedding", k, schema)
        return top_per_key(found.select(*out), [query_key], [F.desc("similarity"), key], k)

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        best = _Best(k)
        if left.num_rows and right.num_rows:
            ids, keys = left["id"].combine_chunks(), right["id"].combine_chunks()
            best.products(np.arange(len(ids)), _matrix(left), _places(keys, ids), _keys(keys), _matrix(right))
        if not len(best.s):
            return pa.table({"query": left["id"].slice(0, 0), "key": right["id"].slice(0, 0), "similarity": pa.array([], pa.float64())})
        return pa.table({"query": ids.take(pa.array(best.query)), "key": pa.array(best.key), "similarity": pa.array(best.s)})

    cells = Cells(units(vectors, key))
    if not cells.size:
        return vectors.sparkSession.createDataFrame([], schema).select(*out).withColumn("rank", F.lit(1))
    visits = materialize(cells.visits(q, None, k), "first-visits")
    first = materialize(cells.meet(visits, work, schema), "first-round")
    ranked = top_per_key(first, ["query"], [F.desc("similarity"), "key"], k)
    lines = ranked.groupBy("query").agg(F.when(F.count("*") >= k, F.min("similarity")).otherwise(-2.0).alias("line"))
    seen = visits.groupBy("id").agg(F.collect_set("cell").alias("seen"))  # as many as there are pivots at most
    again = q.join(lines.withColumnRenamed("query", "id"), "id", "left").join(seen, "id", "left").select("id", "n", "v", F.coalesce("line", F.lit(-2.0)).alias("line"), F.coalesce("seen", F.expr("cast(array() as array<bigint>)")).alias("seen"))
    second = cells.meet(cells.visits(again, "line"), work, schema)
    return top_per_key(first.unionByName(second).select(*out), [query_key], [F.desc("similarity"), key], k)


def short_ways(pivots: dict[int, tuple[int, np.ndarray]], threshold: float) -> dict[int, np.ndarray]:
    """Orthonormal directions, as columns, for the dimensions in which short forms take less work than whole vectors.

    They are those in which half of the pivots lie most; the other half tells how many of them pay, by the share of its
    pairs that would be computed again.
    """
    out = {}
    for n, (_, p) in pivots.items():
        if len(p) < TRIED:
            continue
        ways = np.linalg.svd(p[::2], full_matrices=False)[2].T
        pairs = np.triu_indices(len(p) // 2, 1)
        least = n + AGAIN * np.mean((p[1::2] @ p[1::2].T)[pairs] >= threshold)
        step = max(1, n // 32)
        for k in range(step, min(n - 1, ways.shape[1]), step):
            short = short_form(p[1::2], ways[:, :k])
            work = k + 1 + AGAIN * np.mean((short @ short.T)[pairs] >= threshold)
            if work < least:
                least, out[n] = work, np.ascontiguousarray(ways[:, :k])
    return out


def short_form(x: np.ndarray, ways: np.ndarray | None) -> np.ndarray:
    """x in 32-bit; with ways, its parts along them and the length of the rest.

    By the Cauchy-Schwarz inequality the product of the rests of two vectors is up to that of their lengths. What is
    added to the length is more than its error in double precision.
    """
    if ways is None:
        return x.astype(np.float32)
    part = x @ ways
    rest = np.sqrt(np.maximum(1 - np.einsum("ij,ij->i", part, part), 0) + 1e-15 * x.shape[1])
    return np.column_stack([part, rest]).astype(np.float32)


def _above(x: np.ndarray, y: np.ndarray, short_x: np.ndarray, short_y: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in x and y, and cosines, of the pairs that reach the threshold. short_x, short_y: their short forms.

    The error of a 32-bit product of n components of vectors of length 1 is below (n + 2) / 2^24, in whatever order it is summed.
    """
    about = short_x @ short_y.T
    line = np.float32(threshold - (x.shape[1] + 8) / (1 << 23))
    some = np.flatnonzero(about.max(axis=1) >= line)
    if not len(some):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    i, j = np.divmod(np.flatnonzero(about[some] >= line), about.shape[1])
    i = some[i]
    if len(i) > DENSE * about.size:
        s = (x @ y.T)[i, j]
    else:
        step = max(1, PRODUCTS // 4 // x.shape[1])
        s = np.concatenate([np.einsum("ij,ij->i", x[i[a : a + step]], y[j[a : a + step]]) for a in range(0, len(i), step)])
    keep = s >= threshold
    return i[keep], j[keep], s[keep]


def _reached(x: np.ndarray, pivots: np.ndarray | None, wide: np.ndarray, threshold: float) -> np.ndarray:
    """Which of the cells around the pivots, as wide as that, can have a vector at the threshold, for each row of x."""
    if pivots is None:
        return np.ones((len(x), len(wide)), bool)
    return np.arccos(np.clip(x @ pivots.T, -1, 1)) <= wide + np.arccos(np.clip(threshold, -1, 1)) + 2 * SLACK


def tile_pairs(cells: Cells, threshold: float) -> DataFrame:
    """a, b, own, n, cell, id, raw: each vector with each pair of tiles, a <= b, of its own and one that it can have a partner in.

    A row has many vectors of tile own; cell, id and raw are theirs in one piece each, of 64-bit integers and, for raw, the
    components as given, of 32 bits if the vectors are of floats, else of 64.
    """
    shared, sizes, tiles = (cells.spark.sparkContext.broadcast(x) for x in (cells.pivots, cells.size, cells.tiles()))
    kind = _kind(cells)

    def pieces(values: np.ndarray, ends: np.ndarray) -> pa.Array:
        ends = (ends * (values.nbytes // len(values))).astype(np.int32)
        return pa.BinaryArray.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(values)])

    def work(batches):
        for b in batches:
            ids, own_cell = b.column(0).to_numpy(), b.column(3).to_numpy()
            for rows, x in unit_rows(b.column(2)):
                n = x.shape[1]
                known = np.array(sorted(c for c, (m, _, _) in sizes.value.items() if m == n))
                first, pivots = shared.value.get(n, (0, None))
                go = _reached(x, None if pivots is None else pivots[known - first], np.array([sizes.value[c][2] for c in known.tolist()]), threshold)
                start, parts = np.array([tiles.value[c] for c in known.tolist()]).T
                low = start[0]
                lies = np.zeros((len(known), start[-1] + parts[-1] - low), np.float32)
                for k, (s, p) in enumerate(zip(start.tolist(), parts.tolist(), strict=True)):
                    lies[k, s - low : s - low + p] = 1
                place = np.searchsorted(known, own_cell[rows])
                own = start[place] + (_mixed(ids[rows]) % parts[place].astype(np.uint64)).astype(np.int64)
                raw = b.column(2).take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, n)
                i, j = np.nonzero(go.astype(np.float32) @ lies > 0)
                order = np.lexsort((j, own[i]))
                step = max(1, TILE_BYTES // (8 * n))
                for at in range(0, len(order), step):
                    k, to = i[order[at : at + step]], low + j[order[at : at + step]]
                    mine = own[k]
                    begin = np.flatnonzero(np.r_[True, (mine[1:] != mine[:-1]) | (to[1:] != to[:-1])])
                    ends = np.r_[begin, len(k)]
                    mine, to = mine[begin], to[begin]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(mine, to)), pa.array(np.maximum(mine, to)), pa.array(mine), pa.array(np.full(len(mine), n, np.int32)), *(pieces(v, ends) for v in (own_cell[rows[k]], ids[rows[k]], raw[k]))], ["a", "b", "own", "n", "cell", "id", "raw"])

    return cells.rows.select("id", "n", "v", "cell").mapInArrow(work, "a long, b long, own long, n int, cell binary, id binary, raw binary")


def _kind(cells: Cells) -> str:
    return "<f4" if cells.rows.schema["v"].dataType.simpleString() == "array<float>" else "<f8"


def _mixed(ids: np.ndarray) -> np.ndarray:
    """The ids' bits, mixed, so that those of a pattern are dealt out evenly."""
    x = ids.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def similar_pairs(vectors: DataFrame, threshold: float, key: str = "vec_id") -> DataFrame:
    """Pairs (i, j, similarity) with i < j of vectors whose cosine reaches the threshold; exact.

    Each pair of tiles is one group, which has at most TILE_BYTES of vectors a side and passes on hits as it finds them.
    Vectors of a tile are compared with a cell of the other only if that can have one at the threshold. Null and zero
    vectors and those with null or non-finite parts have no pairs.
    """
    cells = Cells(units(vectors.select(F.col(key).cast("long").alias("k"), "embedding"), "k", given=True))
    if not cells.size:
        return vectors.sparkSession.createDataFrame([], "i long, j long, s double").select("i", "j", F.col("s").alias("similarity"))
    kind = _kind(cells)
    shared, sizes, ways = (cells.spark.sparkContext.broadcast(x) for x in (cells.pivots, cells.size, short_ways(cells.pivots, threshold)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches)
        a, b, n = (t[k][0].as_py() for k in ("a", "b", "n"))
        cell, ids, x = (np.frombuffer(b"".join(t[k].to_pylist()), d) for k, d in (("cell", "<i8"), ("id", "<i8"), ("raw", kind)))
        own = np.repeat(t["own"].to_numpy(), pc.binary_length(t["id"]).to_numpy() // 8)
        order = np.lexsort((cell, own))
        x = x.reshape(-1, n)[order].astype(np.float64)
        x = _length_one(x, np.abs(x).max(axis=1))
        own, cell, ids = own[order], cell[order], ids[order]
        short = short_form(x, ways.value.get(n))
        left = int(np.searchsorted(own, a, "right"))
        right = 0 if a == b else left
        there = np.unique(cell[:left])
        first, pivots = shared.value.get(n, (0, None))
        go = _reached(x[right:], None if pivots is None else pivots[there - first], np.array([sizes.value[c][2] for c in there.tolist()]), threshold)
        rows, columns = BLOCK
        held: list[tuple] = []
        for k, c in enumerate(there.tolist()):
            begin, end = np.searchsorted(cell[:left], [c, c + 1]).tolist()
            from_ = begin if a == b else right
            others = from_ + np.flatnonzero(go[from_ - right :, k])
            whole = len(others) > MOST * (len(x) - from_)  # none is copied, then
            others = np.arange(from_, len(x)) if whole else others
            for q in range(0, len(others), columns):
                near = slice(from_ + q, from_ + q + columns) if whole else others[q : q + columns]
                y, short_y = x[near], short[near]
                for p in range(begin, end, rows):
                    i, j, s = _above(x[p : min(p + rows, end)], y, short[p : min(p + rows, end)], short_y, threshold)
                    if not len(i):
                        continue
                    i, j = p + i, others[q + j]
                    keep = (ids[i] != ids[j]) & ((i < j) | (a != b))
                    i, j, s = ids[i[keep]], ids[j[keep]], s[keep]
                    held.append((np.minimum(i, j), np.maximum(i, j), s))
                    if sum(len(h[2]) for h in held) >= 1 << 16:
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(h)) for h in zip(*held, strict=True)], ["i", "j", "s"])
                        held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(h)) for h in zip(*held, strict=True)], ["i", "j", "s"])

    many = max(at + parts for at, parts in cells.tiles().values())
    groups = tile_pairs(cells, threshold).repartition(min(many * (many + 1), 8192), "a", "b").groupBy("a", "b")  # two partitions for each pair of tiles, so that few pairs meet in a task
    return groups.applyInArrow(work, "i long, j long, s double").select("i", "j", F.round("s", 4).alias("similarity"))
