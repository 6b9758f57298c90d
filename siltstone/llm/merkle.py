"""A Merkle tree over documents: leaves of each source in order, their subroots in order of the sources, one root.

Leaves are cut into aligned blocks of FANOUT ** LEVELS. A task has the digests of a block as one matrix of bytes, which
it reshapes by the fanout and hashes row by row, level after level; which digests are a node's siblings follows from
its number alone. Roots of blocks are leaves of the next round, so that rounds grow with the logarithm of the leaves.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.operators.joins import join_checked
from siltstone.operators.ordered import in_order
from siltstone.session import materialize

FANOUT = 16
#: Levels of a block: a task has FANOUT ** LEVELS digests of a group at a time.
LEVELS = 3
HEX = 64

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf(fields: list[Column]) -> Column:
    """sha256, in hex, of the fields: - for null, else the UTF-8 bytes' number, a colon and the value."""
    text = [F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string"))) for c in fields]
    return F.sha2(F.concat(*text), 256)


def _hash(x) -> bytes:
    return hashlib.sha256(x).hexdigest().encode()


def levels(digests: bytes, n: int, most: int) -> list[bytes]:
    """The digests of each level, from those given up to the top of the block, as hex one after another.

    n is how many nodes the block's whole group has: a level is added while more than one are left in the group, and up
    to most.
    """
    out = [digests]
    while n > 1 and len(out) <= most:
        nodes = np.frombuffer(out[-1], np.uint8).reshape(-1, HEX)
        full = len(nodes) // FANOUT
        tops = [_hash(row) for row in nodes[: full * FANOUT].reshape(full, FANOUT * HEX)]
        if len(nodes) % FANOUT:
            tops.append(_hash(nodes[full * FANOUT :].tobytes()))
        out.append(b"".join(tops))
        n = -(-n // FANOUT)
    return out


def siblings(level: bytes, i: int) -> tuple[bytes, bytes]:
    """The digests before and after node i in its run."""
    start = i // FANOUT * FANOUT * HEX
    return level[start : i * HEX], level[(i + 1) * HEX : start + FANOUT * HEX]


def fold(digest: bytes, path: bytes, i: int, n: int) -> bytes:
    """The top that a digest in place i of n leads to, with the siblings of each level one after another in path."""
    at = 0
    while n > 1:
        place = i % FANOUT
        others = min(FANOUT, n - (i - place)) - 1
        digest = _hash(path[at : at + place * HEX] + digest + path[at + place * HEX : at + others * HEX])
        at += others * HEX
        i, n = i // FANOUT, -(-n // FANOUT)
    return digest


def _hex(column: pa.ChunkedArray) -> bytes:
    """32-byte digests as hex one after another."""
    return b"".join(column.to_pylist()).hex().encode()


def _blocks(nodes: DataFrame, depth: int) -> DataFrame:
    """tree, i, n, digest of the blocks of nodes: their tops, numbered, and how many the tree has of them."""
    block = FANOUT**depth

    def work(t: pa.Table) -> pa.Table:
        t = t.sort_by("i")
        n = t["n"][0].as_py()
        top = levels(_hex(t["digest"]), n, depth)[-1]
        row = (t["tree"][0].as_py(), t["i"][0].as_py() // block, -(-n // block), bytes.fromhex(top.decode()))
        return pa.table({k: pa.array([v], kind) for k, v, kind in zip(("tree", "i", "n", "digest"), row, (pa.int64(),) * 3 + (pa.binary(),), strict=True)})

    rows = nodes.select("tree", "i", "n", "digest", F.floor(F.col("i") / FANOUT**depth).alias("block"))
    return materialize(rows.groupBy("tree", "block").applyInArrow(work, "tree long, i long, n long, digest binary"), "blocks")


def _paths(nodes: DataFrame, depth: int) -> DataFrame:
    """tree, i, n, path, top of nodes that are few beside the leaves: path has the siblings of all levels up to the top."""
    if (nodes.agg(F.max("n")).first()[0] or 0) <= 1:
        return nodes.select("tree", "i", "n", F.lit(b"").alias("path"), "digest", F.col("digest").alias("top"))
    above = _paths(_blocks(nodes, depth), depth).select("tree", F.col("i").alias("block"), "path", "top")

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by("i")
        place = [x % FANOUT**depth for x in left["i"].to_pylist()]
        steps = levels(_hex(left["digest"]), left["n"][0].as_py(), depth)[:-1]
        upper, top = right["path"][0].as_py(), right["top"][0].as_py()
        paths = [b"".join(x for k, level in enumerate(steps) for x in siblings(level, p // FANOUT**k)) + upper for p in place]
        columns = {k: left[k] for k in ("tree", "i", "n")} | {"path": pa.array(paths, pa.binary()), "digest": left["digest"], "top": pa.array([top] * len(place), pa.binary())}
        return pa.table(columns)

    rows = nodes.select("tree", "i", "n", "digest", F.floor(F.col("i") / FANOUT**depth).alias("block"))
    joined = rows.groupBy("tree", "block").cogroup(above.groupBy("tree", "block"))
    return materialize(joined.applyInArrow(work, "tree long, i long, n long, path binary, digest binary, top binary"), "paths")


def tampered_copy(docs: DataFrame) -> tuple[Column, Column]:
    """Which documents the query tampers with, and their text after that: A-Z in lower case."""
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return hit, F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def leaves(docs: DataFrame, tamper=tampered_copy) -> DataFrame:
    """doc_id, key, leaf and changed of each document; changed, the leaf after tampering, is null where nothing was done."""
    fields = [F.col("doc_id").cast("long"), F.col("source"), F.col("lang"), F.col("n_chars").cast("long")]
    hit, text = tamper(docs)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.concat(F.lit("+"), "source"), F.lit("")).alias("key"),  # null first, then the order of the bytes
        F.unhex(leaf([*fields, F.col("text")])).alias("leaf"),
        F.when(hit, F.unhex(leaf([*fields, text]))).alias("changed"),
    )
    return materialize(rows, "leaves")


def manifest(docs: DataFrame, tamper=tampered_copy, depth: int = LEVELS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, source and place of every row of docs.

    docs has doc_id, source, lang, n_chars and text, any of them null; null has a leaf of its own, and a null source is a
    source. place is the leaf's number in its source, by doc_id, null first; rows of one doc_id follow each other by
    their leaves, so that equal rows stand side by side with proofs of their own. Other columns have no part in it.
    An empty table has no rows. tamper(docs) says which documents are changed, and how their text then reads.

    folded_root comes from the changed leaf, or else from the leaf, and the siblings as they were. Documents are read
    once; what is shuffled are their digests. One source may have any share of all rows.
    """
    own = in_order(leaves(docs, tamper), ["key"], [F.col("doc_id").asc_nulls_first(), F.col("leaf").asc()])
    width = own.agg(F.max(F.octet_length("key"))).first()[0]
    if width is None:
        return docs.limit(0).select(F.lit(0).cast("long").alias("doc_id"), *[F.lit("").alias(c) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")], F.lit(True).alias("verified"), F.lit("").alias("source"), F.lit(0).cast("long").alias("place"))
    sources = in_order(own.where("rank = 0").select("key"), [], [F.col("key").asc()])
    numbered = materialize(sources.select("key", F.col("rank").alias("tree"), F.col("size").alias("trees")), "sources")
    rows = join_checked(own, numbered, ["key"], "inner", width + 64).withColumn("block", F.floor(F.col("rank") / FANOUT**depth))
    rows = materialize(rows.select("doc_id", "key", "leaf", "changed", F.col("rank").alias("i"), F.col("size").alias("n"), "tree", "trees", "block"), "placed")
    inner = _paths(_blocks(rows.select("tree", "i", "n", F.col("leaf").alias("digest")), depth), depth).select("tree", F.col("i").alias("block"), "path", F.col("top").alias("subroot"))
    inner = materialize(inner, "inner")
    tops = inner.where("block = 0").select("tree", "subroot").join(numbered.select("tree", "trees"), "tree")
    outer = _paths(tops.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("i"), F.col("trees").alias("n"), F.col("subroot").alias("digest")), depth)
    outer = materialize(outer.select(F.col("i").alias("tree"), F.col("path").alias("outer"), F.col("top").alias("root")), "outer")
    longest = outer.agg(F.max(F.octet_length("outer"))).first()[0]
    paths = join_checked(inner, outer, ["tree"], "inner", longest + 128)

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by("i")
        path, outer = right["path"][0].as_py(), right["outer"][0].as_py()
        subroot, root = (right[c][0].as_py().hex() for c in ("subroot", "root"))
        digests = _hex(left["leaf"])
        n, tree, trees = (left[c][0].as_py() for c in ("n", "tree", "trees"))
        steps = levels(digests, n, depth)[:-1]
        proof, folded = [], []
        for i, leaf, changed in zip(left["i"].to_pylist(), left["leaf"].to_pylist(), left["changed"].to_pylist(), strict=True):
            own = b"".join(x for k, level in enumerate(steps) for x in siblings(level, i % FANOUT**depth // FANOUT**k)) + path
            proof.append(_hash(own + outer).decode())
            folded.append(fold(fold((changed or leaf).hex().encode(), own, i, n), outer, tree, trees).decode())
        size = left.num_rows
        text = [digests[k * HEX : (k + 1) * HEX].decode() for k in range(size)]
        return pa.table({"doc_id": left["doc_id"], "leaf": text, "subroot": [subroot] * size, "root": [root] * size, "proof_sha256": proof, "folded_root": folded, "verified": [x == root for x in folded], "key": left["key"], "place": left["i"]})

    schema = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, key string, place long"
    out = rows.groupBy("tree", "block").cogroup(paths.groupBy("tree", "block")).applyInArrow(work, schema)
    return out.withColumn("source", F.when(F.col("key") != "", F.substr("key", F.lit(2)))).drop("key").select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", "source", "place")


def _sql() -> str:
    """The same in DuckDB: levels, siblings and folding by recursion."""

    def field(c: str) -> str:
        return f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c}::VARCHAR END"

    def digest(text: str) -> str:
        return "sha256(" + " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"

    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    bits = "list_reduce([xor(c, b)] || [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, (x & 1) * 3988292384::UBIGINT))"
    crc = f"xor(list_reduce([4294967295::UBIGINT] || list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::UBIGINT), lambda c, b: {bits}), 4294967295::UBIGINT)"

    def climb(t: str, nodes: str) -> str:
        """Levels of the trees of nodes (tree, i, n, digest), siblings of each node, and the top of each tree."""
        return f"""
{t}(tree, level, i, n, digest) AS (SELECT tree, 0, i, n, digest FROM {nodes} UNION ALL
    SELECT tree, level + 1, i // {FANOUT}, (n + {FANOUT - 1}) // {FANOUT}, sha256(string_agg(digest, '' ORDER BY i)) FROM {t} WHERE n > 1 GROUP BY tree, level, n, i // {FANOUT}),
{t}_side AS (SELECT a.tree, a.level, a.i, coalesce(string_agg(b.digest, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS before, coalesce(string_agg(b.digest, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS after
    FROM {t} a JOIN {t} b ON a.tree = b.tree AND a.level = b.level AND a.i // {FANOUT} = b.i // {FANOUT} WHERE a.n > 1 GROUP BY a.tree, a.level, a.i),
{t}_top AS (SELECT tree, digest AS top FROM {t} WHERE n = 1)"""

    def folds(t: str, start: str) -> str:
        """Proof and top that each row of start (row, tree, i, digest) leads to."""
        return f"""
{t}_fold(row, tree, level, i, digest, proof) AS (SELECT row, tree, 0, i, digest, '' FROM {start} UNION ALL
    SELECT f.row, f.tree, f.level + 1, f.i // {FANOUT}, sha256(s.before || f.digest || s.after), f.proof || s.before || s.after FROM {t}_fold f JOIN {t}_side s ON s.tree = f.tree AND s.level = f.level AND s.i = f.i),
{t}_end AS (SELECT row, arg_max(digest, level) AS digest, arg_max(proof, level) AS proof FROM {t}_fold GROUP BY row)"""

    return f"""
WITH RECURSIVE leaves AS (SELECT row_number() OVER () AS row, doc_id, source, CASE WHEN source IS NULL THEN '' ELSE '+' || source END AS tree, {digest("text")} AS leaf,
    CASE WHEN coalesce({crc} % 5 = 0, false) THEN {digest(low)} ELSE {digest("text")} END AS changed FROM documents),
own AS (SELECT *, leaf AS digest, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY tree) AS n FROM leaves),
{climb("t", "own")},
tops AS (SELECT tree AS source_key, 0 AS tree, row_number() OVER (ORDER BY tree) - 1 AS i, count(*) OVER () AS n, top AS digest FROM t_top),
{climb("u", "tops")},
changed AS (SELECT row, tree, i, changed AS digest FROM own),
{folds("t", "changed")},
outer_changed AS (SELECT e.row, 0 AS tree, tops.i, e.digest FROM t_end e JOIN own USING (row) JOIN tops ON tops.source_key = own.tree),
{folds("u", "outer_changed")}
SELECT doc_id, leaf, t_top.top AS subroot, u_top.top AS root, sha256(t_end.proof || u_end.proof) AS proof_sha256, u_end.digest AS folded_root, u_end.digest = u_top.top AS verified, source, own.i AS place
FROM own JOIN t_top ON t_top.tree = own.tree CROSS JOIN u_top JOIN t_end ON t_end.row = own.row JOIN u_end ON u_end.row = own.row
"""


ORACLE = _sql()
