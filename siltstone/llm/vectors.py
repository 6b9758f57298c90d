"""Near-duplicate vectors by cosine, with int8 tile products and rigorous error bounds.

Equal vectors are one node first. Nodes are dealt to cells by their nearest pivot, large cells are split, and two tiles
meet unless the angle between their pivots proves that no vectors of theirs can be alike. In a tile pair all vectors
are quantised to 8-bit codes with a scale of their own; products of codes, exact in 32-bit floating point, estimate all
cosines up to a bound that follows from each vector's quantisation error. Only pairs that may reach the threshold are
computed again in double precision. A tile pair returns link counts and edges that join its classes, never all pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.operators.graph import connected_components
from siltstone.session import discard, materialize

COSINE = 0.9
#: Vectors of a tile, and pivots at most; the pivots are broadcast.
TILE, PIVOTS = 4096, 1024
#: Bytes of vectors that a task copies at a time for the tiles that their tile meets.
COPIED = 16 << 20
#: Share of possible pairs from which a block of rows is computed again as a whole.
DENSE = 0.02


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """8-bit codes, as 32-bit floats for the matrix product, the scale, and the length of the error, rounded up."""
    scale = np.abs(unit).max(axis=1) / 127
    scale[scale == 0] = 1
    code = np.rint(unit / scale[:, None]).astype(np.int8)
    error = np.linalg.norm(unit - code * scale[:, None], axis=1) * (1 + 1e-9) + 1e-12
    return code.astype(np.float32), scale, error


def linked(a: np.ndarray, b: np.ndarray, cosine: float = COSINE, rows: int = 256):
    """Blocks of rows of a, as first row and a boolean matrix: which rows of b have that cosine or more with them.

    a and b are unit vectors in double precision. The error of an estimate is up to e_a (1 + e_b) + e_b by the
    Cauchy-Schwarz inequality, where e is the length of a vector's quantisation error.
    """
    (code_a, scale_a, error_a), (code_b, scale_b, error_b) = quantise(a), quantise(b)
    if a.shape[1] * 127 * 127 >= 1 << 24:
        code_a, code_b = code_a.astype(np.float64), code_b.astype(np.float64)
    for at in range(0, len(a), rows):
        k = slice(at, at + rows)
        about = (code_a[k] @ code_b.T) * scale_a[k, None] * scale_b
        maybe = about + (error_a[k, None] * (1 + error_b) + error_b) >= cosine - 1e-9
        if maybe.mean() > DENSE:
            yield at, maybe & (a[k] @ b.T >= cosine)
        else:
            i, j = np.nonzero(maybe)
            maybe[i, j] = np.einsum("ij,ij->i", a[at + i], b[j]) >= cosine
            yield at, maybe


def _unit(raw: list[bytes], kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors in double precision, padded with zeros to the longest, and their numbers of components.

    kind: of the components in raw, "<f4" or "<f8".
    """
    size = np.array([len(x) // int(kind[-1]) for x in raw])
    out = np.zeros((len(raw), int(size.max())))
    for n in np.unique(size):
        k = np.flatnonzero(size == n)
        out[k, :n] = np.frombuffer(b"".join(raw[i] for i in k), kind).reshape(len(k), n)
    out /= np.abs(out).max(axis=1, keepdims=True)
    return out / np.linalg.norm(out, axis=1, keepdims=True), size


def _tile_pair(node: np.ndarray, copies: np.ndarray, unit: np.ndarray, size: np.ndarray, left: np.ndarray, right: np.ndarray, cosine: float) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Links of each row to rows of the other tile, copies counted, and edges between rows that join their classes."""
    own = left is right
    links = np.zeros(len(node), np.int64)
    label = np.arange(len(node))
    edges = []
    for at, hit in linked(unit[left], unit[right], cosine):
        rows = left[at : at + len(hit)]
        hit &= size[rows][:, None] == size[right][None]
        if own:
            hit[np.arange(len(hit)), at + np.arange(len(hit))] = False
        links[rows] += hit @ copies[right]
        if not own:
            links[right] += copies[rows] @ hit
        for i in np.flatnonzero(hit.any(axis=1)):
            near = right[hit[i]]
            seen, first = np.unique(label[near], return_index=True)
            other = seen != label[rows[i]]
            if other.any():
                edges += [(int(rows[i]), int(x)) for x in near[first[other]]]
                label[np.isin(label, seen)] = label[rows[i]]
    return links, edges


def near_vectors(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id and kept for each row of vectors, which has vec_id and embedding.

    Components of other types than float are compared as doubles; floats stay floats where they are moved, which is
    exact. Vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor do vectors of
    different lengths. A row without vec_id links with nothing, has no component and isn't kept. Rows with equal
    vectors link with each other.
    """
    x = F.col("embedding")
    good = x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    single = vectors.schema["embedding"].dataType.simpleString() == "array<float>"
    kind, x = ("<f4", x) if single else ("<f8", x.cast("array<double>"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("embedding"))
    rows = rows.withColumn("node", F.when(F.coalesce(good, F.lit(False)) & F.col("vec_id").isNotNull(), F.xxhash64("embedding")))
    nodes = rows.where("node IS NOT NULL").groupBy("node", "embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    nodes = materialize(nodes, "nodes")
    n = nodes.count()
    chosen = nodes.orderBy("node").limit(max(1, min(PIVOTS, -(-n // TILE)))).toArrow().column("embedding").to_pylist()
    pivots = _unit([np.array(v, kind).tobytes() for v in chosen], kind)[0] if chosen else np.zeros((0, 1))

    def place(batches):
        for b in batches:
            values = b.column(1)
            cuts = values.offsets.to_numpy()
            flat = values.values.to_numpy(zero_copy_only=False).astype(kind)
            raw = [flat[i:j].tobytes() for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
            if not raw:
                continue
            unit, _ = _unit(raw, kind)
            width = max(unit.shape[1], pivots.shape[1])
            cos = np.pad(unit, ((0, 0), (0, width - unit.shape[1]))) @ np.pad(pivots, ((0, 0), (0, width - pivots.shape[1]))).T
            cell = cos.argmax(axis=1)
            angle = np.arccos(np.clip(cos[np.arange(len(cell)), cell], -1, 1))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(raw, pa.binary()), pa.array(cell), pa.array(angle)], ["node", "copies", "raw", "cell", "angle"])

    placed = materialize(nodes.select("node", "embedding", "copies").mapInArrow(place, "node long, copies long, raw binary, cell long, angle double"), "placed")
    stats = {r["cell"]: r for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("angle")).collect()}  # a row for each pivot
    tiles = np.array([-(-stats[c]["n"] // TILE) if c in stats else 0 for c in range(len(pivots))], np.int64)
    first = np.cumsum(tiles) - tiles
    radius = np.array([stats[c]["angle"] if c in stats else 0.0 for c in range(len(pivots))])
    apart = np.arccos(np.clip(pivots @ pivots.T, -1, 1)) if len(pivots) else np.zeros((0, 0))
    meets = apart - radius[:, None] - radius[None] <= np.arccos(cosine) + 1e-6

    def deal(batches):
        for b in batches:
            cell = b.column(3).to_numpy()
            node, raw = b.column(0).to_numpy(), b.column(2).to_pylist()
            for c in np.unique(cell):
                others = np.concatenate([first[o] + np.arange(tiles[o]) for o in np.flatnonzero(meets[c])])
                k = np.flatnonzero(cell == c)
                mine = first[c] + (node[k].view(np.uint64) % np.uint64(tiles[c])).astype(np.int64)
                some = max(1, COPIED // sum(len(raw[i]) for i in k))
                for at in range(0, len(others), some):  # a batch is never copied for all tiles at once
                    near = others[at : at + some]
                    own, other = np.repeat(mine, len(near)), np.tile(near, len(k))
                    got = b.take(pa.array(np.repeat(k, len(near))))
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(own, other)), pa.array(np.maximum(own, other)), pa.array(own), *(got.column(i) for i in range(3))], ["i", "j", "own", "node", "copies", "raw"])

    dealt = placed.mapInArrow(deal, "i long, j long, own long, node long, copies long, raw binary").repartition("i", "j").sortWithinPartitions("i", "j")

    def meet(batches):
        held: list[pa.RecordBatch] = []
        at = None

        def out():
            t = pa.Table.from_batches(held)
            own, node, copies = (t.column(k).to_numpy() for k in (2, 3, 4))
            left = np.flatnonzero(own == at[0])
            right = left if at[0] == at[1] else np.flatnonzero(own == at[1])
            if not len(left) or not len(right):
                return
            links, edges = _tile_pair(node, copies, *_unit(t.column(5).to_pylist(), kind), left, right, cosine)
            some = np.flatnonzero(links)
            a = np.concatenate([node[some], node[[x for x, _ in edges]] if edges else node[:0]])
            b = [None] * len(some) + [int(node[y]) for _, y in edges]
            n = np.concatenate([links[some], np.zeros(len(edges), np.int64)])
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b, pa.int64()), pa.array(n)], ["a", "b", "links"])

        for batch in batches:
            i, j = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            edges = np.flatnonzero((i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
            for x, y in zip([0, *edges], [*edges, len(i)], strict=True):
                if x == y:
                    continue
                if at is not None and at != (i[x], j[x]):
                    yield from out()
                    held = []
                at = (i[x], j[x])
                held.append(batch.slice(x, y - x))
        if held:
            yield from out()

    found = materialize(dealt.mapInArrow(meet, "a long, b long, links long"), "found")
    discard(placed)
    counts = found.where("b IS NULL").groupBy("a").agg(F.sum("links").alias("links"))
    classes = connected_components(found.where("b IS NOT NULL").select("a", "b"))
    known = nodes.select("node", "least", "copies").join(classes, "node", "left").withColumn("class", F.coalesce("component", "node"))
    smallest = known.groupBy("class").agg(F.min("least").alias("component_id"))
    known = known.join(smallest, "class").join(counts.withColumnRenamed("a", "node"), "node", "left")
    known = known.select("node", "component_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    joined = rows.select("vec_id", "node").join(known, "node", "left")
    component = F.coalesce("component_id", "vec_id")
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
