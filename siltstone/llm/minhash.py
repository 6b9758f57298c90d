"""Near-duplicate documents by DartMinHash over weighted word shingles.

A document's elements are its shingles, and an element's weight is how often the document has it. Each element's region,
a strip as wide as its weight, is hit by darts whose ranks and coordinates are hashed from the element, so that documents
which share an element share its darts. A signature keeps the earliest dart of each coordinate; two signatures agree in
a coordinate with the probability of the weighted Jaccard similarity of the documents, the sum of the smaller weights by
that of the larger ones. Only darts up to a rank that some K log K + 2 K darts reach are thrown, whatever the number of
elements, and strips are thrown at in pieces that double in width, whatever the weights.

Signatures are cut into bands. Documents that agree in a band are candidates, first with the one that is the smallest in
most of their buckets; what these links leave apart is compared block by block within the buckets that still hold
several classes, where each document is first tried with its likeliest partner, and only blocks that are then still apart
with all. Candidates are verified by the exact weighted Jaccard similarity.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.batches import map_texts, spare, text_of
from siltstone.llm.words import blocks, mix
from siltstone.operators.graph import connected_components
from siltstone.operators.joins import join_checked
from siltstone.session import discard, materialize

SHINGLE, SIMILARITY = 5, 0.8
#: At 0.8 a pair has no band in common with a probability of (1 - 0.8**4)**32, 5 in 10**8.
BANDS, ROWS = 32, 4
#: Share of equal coordinates from which a candidate is verified; one at 0.8 has less with a probability of 9 in 10**9.
PLAUSIBLE = 0.58
#: Documents that one copy of the set of their bucket's first document is compared with.
STAR_MEMBERS = 512
#: Members of a bucket that are compared with as many others at a time.
BLOCK_MEMBERS = 256

_U = np.uint64
_Q = _U(0xA0761D6478BD642F)


def shingles(texts: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all windows of words and their texts' rows, in order; number of words and a hash of all words by text.

    A text of fewer words has one shingle, all its words; one without words has none.
    """
    n = len(texts)
    hashes, docs = [np.zeros(0, _U)], [np.zeros(0, np.int64)]
    for b in blocks(texts):
        s, e = b.words()
        hashes.append(b.hashes(b.sums(), s, e))
        docs.append(b.doc[b.segment(s)])
    h, doc = np.concatenate(hashes), np.concatenate(docs)
    words = np.bincount(doc, minlength=n)
    first = np.cumsum(words) - words
    at = np.arange(len(h))
    place = at - first[doc] if len(h) else at
    content = np.zeros(n, _U)
    np.add.at(content, doc, mix(h ^ mix(place.astype(_U) + _U(1))))
    content = mix(content + words.astype(_U))
    start = np.flatnonzero((words[doc] - place >= size) | ((place == 0) & (words[doc] < size)))
    out = np.zeros(len(start), _U)
    for j in range(size):
        inside = place[start] + j < words[doc[start]]
        out = np.where(inside, out * _Q + h[np.minimum(start + j, max(len(h) - 1, 0))], out)
    return mix(out), doc[start], words, content


def weighed(element: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct elements of each document, in the order of documents and elements, their documents and their counts."""
    order = np.lexsort((element, doc))
    element, doc = element[order], doc[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (element[1:] != element[:-1])
    first = np.flatnonzero(new)
    return element[first], doc[first], np.diff(np.append(first, len(doc)))


def signatures(element: np.ndarray, doc: np.ndarray, n: int, weight: np.ndarray | None = None, k: int = BANDS * ROWS) -> np.ndarray:
    """The rank of the earliest dart of each of k coordinates for documents 0 to n - 1; infinite without elements.

    weight: of each element in its document, where it stands once; 1 if there is none. The strip from 0 to the weight is
    cut at 1, 2, 4, 8 and so on. Darts hit the piece from a to b at a rate of b - a for each unit of rank, the same
    ones in all documents; those beyond the weight are dropped.
    """
    weight = np.ones(len(element)) if weight is None else weight.astype(np.float64)
    total = np.bincount(doc, weights=weight, minlength=n)
    out = np.full((n, k), np.inf)
    reach = np.where(total > 0, (k * np.log(k) + 2 * k) / np.maximum(total, 1e-300), 0)
    todo = total > 0
    while todo.any():
        own = np.flatnonzero(todo[doc])
        low, high, piece = 0.0, 1.0, 0
        while len(own := own[weight[own] > low]):
            at = own
            key = mix(element[at] ^ mix(np.full(1, 2 * piece + 1, _U)))
            rank, throw = np.zeros(len(at)), 0
            while len(at):
                throw += 1
                dart = mix(key + _U(throw * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
                rank = rank - np.log(((dart >> _U(11)).astype(np.float64) + 0.5) / float(1 << 53)) / (high - low)
                near = rank <= reach[doc[at]]
                at, key, rank, dart = at[near], key[near], rank[near], dart[near]
                spot = mix(dart ^ _U(0x5851F42D4C957F2D))
                hit = low + (high - low) * ((spot >> _U(40)).astype(np.float64) / (1 << 24)) < weight[at]
                cell = doc[at[hit]] * k + ((spot[hit] & _U(0xFFFFFF)) * _U(k) >> _U(24)).astype(np.int64)
                np.minimum.at(out.reshape(-1), cell, rank[hit])
            low, high, piece = high, 2 * high, piece + 1
        todo = todo & np.isinf(out).any(axis=1)
        reach[todo] *= 2
    return out


def _signed(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, node, a hash of all words, and of texts with words the bands and short coordinates."""

    def work(b: pa.RecordBatch) -> pa.RecordBatch:
        n = b.num_rows
        element, doc, words, content = shingles(b.column(2))
        element, doc, count = weighed(element, doc)
        ranks = signatures(element, doc, n, count)
        coordinate = mix(ranks.view(_U).reshape(-1)).reshape(n, -1)
        band = np.repeat(mix(np.arange(1, BANDS + 1, dtype=_U))[None], n, axis=0)
        for j in range(ROWS):
            band = mix(band * _Q + coordinate[:, j::ROWS][:, :BANDS])
        none = words == 0
        offsets = np.arange(n + 1, dtype=np.int32) * BANDS
        bands = pa.ListArray.from_arrays(pa.array(offsets), pa.array(band.reshape(-1).view(np.int64)))
        short = (coordinate & _U(0xFFFF)).astype("<u2").tobytes()
        size = 2 * BANDS * ROWS
        sig = pa.array([None if none[i] else short[i * size : (i + 1) * size] for i in range(n)], pa.binary())
        columns = [b.column(0), b.column(1), pa.array(content.view(np.int64)), pa.array(~none), bands, sig]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "node", "has_words", "bands", "sig"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_of()).alias("text_hash"), text_of().alias("text"))
    return map_texts(rows, "text", "doc_id long, text_hash long, node long, has_words boolean, bands array<long>, sig binary", work)


def _same(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """For all pairs of two lists of short coordinates, which coordinates agree."""
    x, y = (np.frombuffer(b"".join(v), "<u2").reshape(len(v), -1) for v in (a, b))
    return x[:, None, :] == y[None, :, :]


def _plausible(pairs: DataFrame, sigs: DataFrame, plausible: float) -> DataFrame:
    """The pairs a, b of nodes whose coordinates agree often enough."""

    def work(batches):
        for t in batches:
            x, y = (np.frombuffer(b"".join(t.column(i).to_pylist()), "<u2").reshape(t.num_rows, -1) for i in (2, 3))
            keep = pa.array((x == y).mean(axis=1) >= plausible)
            yield pa.RecordBatch.from_arrays([t.column(0).filter(keep), t.column(1).filter(keep)], ["a", "b"])

    left, right = (sigs.select(F.col("node").alias(c), F.col("sig").alias(f"sig_{c}")) for c in "ab")
    return pairs.join(left, "a").join(right, "b").select("a", "b", "sig_a", "sig_b").mapInArrow(work, "a long, b long")


def _sets(nodes: DataFrame, carriers: DataFrame, docs: DataFrame) -> DataFrame:
    """node and shingles, sorted hashes, for each of nodes, from the text of a document that has it.

    The second and further ones of equal shingles get hashes of their own, so that what two of these sets have in common
    is the sum of the smaller weights, and what they have together that of the larger ones.
    """
    wanted = materialize(carriers.join(nodes, "node", "left_semi").select("node", "doc_id", "text_hash"), "carriers")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_of()).alias("text_hash"), text_of().alias("text"))
    texts = join_checked(rows, wanted, ["doc_id", "text_hash"], "inner", 60).select("node", "text")

    def sets(b: pa.RecordBatch) -> pa.RecordBatch:
        element, doc, _, _ = shingles(b.column(1))
        element, doc, count = weighed(element, doc)
        again = np.flatnonzero(count > 1)
        if len(again):
            more = count[again] - 1
            nth = np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more) + 1
            element = np.concatenate([element, mix(np.repeat(element[again], more) ^ mix(nth.astype(_U)))])
            doc = np.concatenate([doc, np.repeat(doc[again], more)])
            order = np.lexsort((element, doc))
            element, doc = element[order], doc[order]
        ends = np.searchsorted(doc, np.arange(b.num_rows + 1)).astype(np.int32)
        values = pa.ListArray.from_arrays(pa.array(ends), pa.array(element.view(np.int64)))
        return pa.RecordBatch.from_arrays([b.column(0), values], ["node", "shingles"])

    return materialize(map_texts(texts, "text", "node long, shingles array<long>", sets).dropDuplicates(["node"]), "shingles")


def _alike(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    """Whether two sorted sets have that Jaccard similarity."""
    small, large = min(len(x), len(y)), max(len(x), len(y))
    if small < similarity * large:
        return False
    both = np.sort(np.concatenate([x, y]))
    common = int((both[1:] == both[:-1]).sum())
    return common >= similarity * (small + large - common) - 1e-9


def _rows(t: pa.RecordBatch):
    """Rows as tuples; a list of numbers stays a numpy array."""

    def cells(c: pa.Array):
        if not pa.types.is_list(c.type):
            return c.to_pylist()
        cuts, values = c.offsets.to_numpy(), c.values.to_numpy()
        return [values[x:y] for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]

    return zip(*map(cells, t.columns), strict=True)


def _star_links(star: DataFrame, carriers: DataFrame, docs: DataFrame, similarity: float) -> DataFrame:
    """The pairs a, b with that similarity. star is a written table with a row for each node b at most.

    The pairs of one a are dealt to parts of some STAR_MEMBERS, to each of which its set goes once; a task holds that
    set while the others pass by.
    """
    nodes = star.select(F.col("a").alias("node")).union(star.select("b")).distinct()
    sets_of = _sets(nodes, carriers, docs)
    parts = star.groupBy("a").agg(F.ceil(F.count("*") / STAR_MEMBERS).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part")
    members = star.join(parts, "a").select("a", part, "b").join(sets_of.withColumnRenamed("node", "b"), "b").select("a", "part", F.lit(1).alias("kind"), "b", "shingles")
    heads = parts.join(sets_of.withColumnRenamed("node", "a"), "a").select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("kind"), F.col("a").alias("b"), "shingles")
    dealt = heads.unionByName(members).repartition("a", "part").sortWithinPartitions("a", "part", "kind")

    def work(batches):
        head = None
        for t in batches:
            links = []
            for a, _, kind, b, own in _rows(t):
                if kind == 0:
                    head = own.copy()
                elif _alike(head, own, similarity):
                    links.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["a", "b"])

    links = materialize(dealt.mapInArrow(work, "a long, b long"), "links")
    discard(sets_of)
    return links


def _groups(batches, width: int):
    """Runs of rows, as tuples, that agree in their first width columns, from batches in that order."""
    held: list[tuple] = []
    for t in batches:
        for row in _rows(t):
            if held and row[:width] != held[0][:width]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _plausible_in_tiles(members: DataFrame, plausible: float) -> DataFrame:
    """Members with a plausible partner of another label: tile, node, partners, listed on one of both sides, and best, the
    partner whose coordinates agree most often, with the share of these as score.

    members has key, band, n, node, label, sig and bands. A bucket of n members is cut into blocks of some BLOCK_MEMBERS, each
    two of which meet in a tile; so a task holds two blocks at a time, and no rows are made for pairs. A pair that
    shares several buckets is listed in that of its first common key among the bands' keys: coordinates in a signature
    are shorter and may agree by chance where the keys don't.
    """
    cuts = F.ceil(F.col("n") / BLOCK_MEMBERS).cast("int")
    placed = members.withColumn("own", F.pmod(F.xxhash64("node"), cuts).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), cuts - 1)))
    placed = placed.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "band", "node", "label", "sig", "own", "bands")
    placed = placed.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def work(batches):
        for rows in _groups(batches, 3):
            i, j, band = rows[0][1:4]
            node, label, own = (np.array([r[k] for r in rows]) for k in (4, 5, 7))
            bands = np.array([r[8] for r in rows])
            left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
            partners: dict[int, list[int]] = {}
            best: dict[int, tuple[float, int]] = {}
            for at in range(0, len(left), 32):
                some = left[at : at + 32]
                equal = _same([rows[x][6] for x in some], [rows[x][6] for x in right])
                share = equal.mean(axis=2)
                ok = (share >= plausible) & (label[some][:, None] != label[right][None])
                if i == j:
                    ok &= node[some][:, None] < node[right][None]
                x, y = np.nonzero(ok)
                first = (bands[some[x]] == bands[right[y]]).argmax(axis=1) == band
                for u, v, z in zip(some[x[first]].tolist(), right[y[first]].tolist(), share[x[first], y[first]].tolist(), strict=True):
                    partners.setdefault(u, []).append(int(node[v]))
                    partners.setdefault(v, [])
                    for a, b in ((u, v), (v, u)):
                        best[a] = max(best.get(a, (0.0, 0)), (z, int(node[b])))
            if partners:
                tile = int(mix(np.array([rows[0][0] ^ (i << 20) ^ j], np.int64).view(_U)).view(np.int64)[0])
                where = {int(node[u]): u for u in partners}
                columns = [[tile] * len(where), list(where), [partners[u] for u in where.values()], [best[u][1] for u in where.values()], [best[u][0] for u in where.values()]]
                kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["tile", "node", "partners", "best", "score"])

    return materialize(placed.mapInArrow(work, "tile long, node long, partners array<long>, best long, score double"), "tiles")


def _apart(tiles: DataFrame) -> DataFrame:
    """The rows of tiles without partners of the same label, and without those that no row then has as a partner."""

    def work(batches):
        for group in _groups(batches, 1):
            label = {r[1]: r[2] for r in group}
            left = {r[1]: [p for p in r[3].tolist() if label[p] != r[2]] for r in group}
            named = {p for x in left.values() for p in x}
            rows = [(group[0][0], node, label[node], x) for node, x in left.items() if x or node in named]
            if rows:
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["tile", "node", "label", "partners"])

    rows = tiles.repartition("tile").sortWithinPartitions("tile")
    return materialize(rows.mapInArrow(work, "tile long, node long, label long, partners array<long>"), "apart")


def _tile_links(tiles: DataFrame, carriers: DataFrame, docs: DataFrame, similarity: float) -> DataFrame:
    """Links a, b that join all labels which similar partners in a tile join; others between the same two are left out."""
    sets_of = _sets(tiles.select("node").distinct(), carriers, docs)
    at = tiles.groupBy("node").agg(F.collect_list(F.struct("tile", "label", "partners")).alias("at"))  # a node meets its set once
    rows = at.join(sets_of, "node").select("node", "shingles", F.explode("at").alias("at")).select("at.tile", "node", "at.label", "at.partners", "shingles")
    rows = rows.repartition("tile").sortWithinPartitions("tile")

    def work(batches):
        for group in _groups(batches, 1):
            sets = {r[1]: r[4] for r in group}
            root = {r[1]: r[2] for r in group}
            up: dict[int, int] = {}

            def find(x: int) -> int:
                while x in up:
                    x = up[x]
                return x

            links = []
            for r in group:
                for partner in r[3].tolist():
                    x, y = find(root[r[1]]), find(root[partner])
                    if x != y and _alike(sets[r[1]], sets[partner], similarity):
                        up[max(x, y)] = min(x, y)
                        links.append((r[1], partner))
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["a", "b"])

    links = materialize(rows.mapInArrow(work, "a long, b long"), "links")
    discard(sets_of)
    return links


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, plausible: float = PLAUSIBLE) -> DataFrame:
    """doc_id, class_id and kept for each row of docs; class_id is the smallest doc_id that links reach.

    Links join documents with equal words, or whose shingles, weighed by their counts, have a Jaccard similarity of
    similarity or more. A document without words, or a null text, is a class of its own; a row without doc_id has no
    class and is kept. Repeated rows are in one class; kept is true for all of them if they have its smallest doc_id.
    Other columns of docs have no part in it. plausible 0 verifies all candidates, whatever their signatures say.
    """
    signed = materialize(_signed(docs), "signed")
    usable = signed.where("has_words AND doc_id IS NOT NULL")
    least = F.min(F.struct("doc_id", "text_hash"))
    nodes = materialize(usable.groupBy("node").agg(least.alias("c"), F.first("bands").alias("bands"), F.first("sig").alias("sig")).select("node", "c.*", "bands", "sig"), "nodes")
    banded = nodes.select("node", "doc_id", F.posexplode("bands").alias("band", "key"))
    leader = F.min(F.struct("doc_id", "node"))
    buckets = materialize(banded.groupBy("key").agg(leader.alias("leader"), F.count("*").alias("n")).where("n > 1"), "buckets")
    members = materialize(banded.drop("doc_id").join(buckets, "key"), "members")
    sigs, carriers = nodes.select("node", "sig"), nodes.select("node", "doc_id", "text_hash")

    led = members.where("leader.node <> node").groupBy("node", "leader").agg(F.count("*").alias("bands"))
    star = led.groupBy("node").agg(F.min_by("leader.node", F.struct(-F.col("bands"), F.col("leader"))).alias("a")).select("a", F.col("node").alias("b"))
    links = _star_links(materialize(_plausible(star, sigs, plausible), "star"), carriers, docs, similarity)
    labels = connected_components(links)
    labelled = members.join(labels, "node", "left").withColumn("label", F.coalesce("component", "node"))
    open_ = labelled.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("key")
    at = labelled.join(open_, "key", "left_semi").groupBy("node").agg(F.first("label").alias("label"), F.collect_list(F.struct("key", "band", "n")).alias("at"))  # BANDS at most
    rest = at.join(nodes.select("node", "sig", "bands"), "node").select("node", "label", "sig", "bands", F.explode("at").alias("at")).select("at.*", "node", "label", "sig", "bands")
    tiles = _plausible_in_tiles(rest, plausible)
    discard(members, buckets)
    near = tiles.groupBy("node").agg(F.max_by("best", F.struct("score", "best")).alias("a")).select("a", F.col("node").alias("b"))
    best = _star_links(materialize(near, "near"), carriers, docs, similarity)
    labels = connected_components(links.union(best))
    labelled = tiles.select("tile", "node", "partners").join(labels, "node", "left").withColumn("label", F.coalesce("component", "node"))
    rest = _apart(labelled.select("tile", "node", "label", "partners"))
    more = _tile_links(rest, carriers, docs, similarity)
    labels = connected_components(links.union(best).union(more))
    discard(links, best, more, tiles, rest)

    classes = nodes.join(labels, "node", "left").select("node", F.coalesce("component", "node").alias("class"), "doc_id")
    smallest = classes.groupBy("class").agg(F.min("doc_id").alias("class_id"))
    classes = classes.join(smallest, "class").select("node", "class_id")
    out = signed.select("doc_id", "text_hash", F.when(F.col("has_words"), F.col("node")).alias("node")).join(classes, "node", "left")
    class_id = F.coalesce(F.when(F.col("doc_id").isNotNull(), F.col("class_id")), F.col("doc_id"))
    return out.select("doc_id", class_id.alias("class_id"), (F.col("doc_id").isNull() | (class_id == F.col("doc_id"))).alias("kept"))


def keep_one(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of docs, with its columns, without those that have a smaller doc_id in their class."""
    key = spare("doc", docs)
    gone = materialize(near_duplicates(docs, similarity).where("NOT kept").select(F.col("doc_id").alias(key)).distinct(), "gone")
    keyed = docs.withColumn(key, F.col("doc_id").cast("long"))
    return join_checked(keyed, gone, [key], "left_anti", 64).drop(key)
