"""Alignment of two tokenizers' tokens of the same texts, and counts of the id pairs that are linked.

The ends of both tokenizers' tokens, united, cut a text into elementary intervals, each of which lies in one token of
either side: its owners, found by binary search. So each interval is one overlap; where both sides end, a group closes.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.batches import arrays, map_texts, text_of
from siltstone.llm.tokens import _LETTERS, encoder, tokenizer_path
from siltstone.llm.words import _buffers
from siltstone.session import discard, materialize

BYTE_LEVEL = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"

#: Pairs that are sent to every task: those with at least this share of all links, so that there are no more than HEAD.
HEAD = 1 << 17
#: Distinct pairs that a task gathers before it passes their counts on.
GATHERED = 1 << 20
#: Tokens of documents that are taken at a time; one document with more comes alone.
TOKENS = 1 << 20
#: Parts of texts whose pieces are remembered.
REMEMBERED = 100_000
#: Bytes of text that are aligned at a time; one longer text comes alone.
SLICE = 1 << 19

SIDES = ("a", "b", "a_in_group", "b_in_group", "link_a", "link_b")
SCHEMA = "doc_id long, " + ", ".join(f"{x} array<int>" for x in SIDES)


class ByteLevel:
    """Ids and bytes of a byte-level vocabulary; strings of special tokens are plain text."""

    def __init__(self, path: str):
        self.encoder = encoder(path, "byte", as_text=True)
        back = {v: k for k, v in _LETTERS.items()}
        vocabulary = self.encoder.tokenizer.get_vocab()
        self.raw = np.full(max(vocabulary.values()) + 1, b"", object)
        for token, i in vocabulary.items():
            self.raw[i] = bytes(back.get(c, ord(c) & 255) for c in token)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        return self.encoder.encode(pc.if_else(pc.equal(texts, ""), "", pc.binary_join_element_wise(pa.scalar(" ", texts.type), texts, pa.scalar("", texts.type))))


class Pieces:
    """Ids and bytes of a sentence-piece model that puts a space before each text.

    If no piece of the model goes on after a space that follows something else, a text falls apart at its single
    spaces, and each part is encoded as if alone: the space that the model puts before it stands for the one cut away.
    Parts are remembered, up to REMEMBERED of them.
    """

    CUT = re.compile("(?<=[^ ]) (?=[^ ])")

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.raw = np.full(len(pieces), b"", object)
        for i, piece in enumerate(pieces):
            self.raw[i] = bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode()
        self.parts = not any("▁" in p.lstrip("▁") for p in pieces)
        self.known: dict[str, tuple[int, ...]] = {}

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        flat, count = [], []
        for text in texts.to_pylist():
            if not text:
                parts = []
            elif not self.parts:
                parts = [text]
            elif "  " in text or text[0] == " " or text[-1] == " ":
                parts = self.CUT.split(text)
            else:
                parts = text.split(" ")
            if new := [p for p in dict.fromkeys(parts) if p not in self.known]:
                if len(self.known) + len(new) > REMEMBERED:
                    self.known = {}
                    new = list(dict.fromkeys(parts))
                self.known.update(zip(new, map(tuple, self.model.encode(new, num_threads=1)), strict=True))
            ids = np.fromiter(chain.from_iterable(map(self.known.__getitem__, parts)), np.int32)
            flat.append(ids)
            count.append(len(ids))
        return np.concatenate(flat) if flat else np.zeros(0, np.int32), np.array(count, np.int64)


_open: dict[tuple[str, str], ByteLevel | Pieces] = {}


def _side(kind: type, path: str) -> ByteLevel | Pieces:
    """One per worker process, kept between its tasks."""
    if (kind.__name__, path) not in _open:
        _open[kind.__name__, path] = kind(path)
    return _open[kind.__name__, path]


def _ends(x: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(x)]).astype(np.int64)


def intervals(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """End of each elementary interval, its owners on both sides, and whether it closes a group.

    ends_a and ends_b are the ends of tokens that aren't empty, rising, with the last one in common.
    """
    ends = np.union1d(ends_a, ends_b)
    own_a, own_b = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
    return ends, own_a, own_b, (ends_a[own_a] == ends) & (ends_b[own_b] == ends) if len(ends) else np.zeros(0, bool)


def products(n_a: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs within each group, as places of tokens, from the tokens of each group on both sides."""
    size = n_a * n_b
    group = np.repeat(np.arange(len(size)), size)
    inner = np.arange(size.sum()) - np.repeat(_ends(size)[:-1], size)
    return _ends(n_a)[group] + inner // n_b[group], _ends(n_b)[group] + inner % n_b[group]


def _width(side: ByteLevel | Pieces) -> np.ndarray:
    return np.fromiter(map(len, side.raw), np.int64, len(side.raw))


def _whole(side: ByteLevel | Pieces, ids: np.ndarray, count: np.ndarray, raw: bytes, at: np.ndarray) -> np.ndarray:
    """Whether the bytes of each text's tokens are the text's."""
    width = _ends(_width(side)[ids])[_ends(count)]
    good = np.diff(width) == np.diff(at)
    joined = b"".join(side.raw[ids].tolist())
    if good.all() and joined == raw:
        return good
    return good & np.array([joined[width[i] : width[i + 1]] == raw[at[i] : at[i + 1]] for i in range(len(count))], bool)


def _align(texts: pa.Array, a: ByteLevel, b: Pieces, links: str) -> list[pa.ListArray]:
    """The list columns of SIDES for a batch of texts."""
    filled = pc.fill_null(texts.cast(pa.large_string()), "")
    spaced = pc.if_else(pc.equal(filled, ""), "", pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), filled, pa.scalar("", pa.large_string())))
    data, at = _buffers(spaced)
    raw = data.tobytes()
    good = np.diff(at) > 0
    sides = []
    for side in (a, b):
        ids, count = side.encode(filled)
        fit = _whole(side, ids, count, raw, at)
        good &= fit
        sides.append((side, ids, count))
    ids, count, ends = [], [], []
    for side, own, n in sides:
        keep = np.repeat(good, n)
        ids.append(own[keep])
        count.append(np.where(good, n, 0))
        ends.append(np.cumsum(_width(side)[ids[-1]]))
    stop, own_a, own_b, closes = intervals(*ends)
    last = _ends(np.where(good, np.diff(at), 0))[1:]
    group_end = stop[closes]
    n_groups = np.diff(_ends(np.zeros(0)) if not len(last) else np.concatenate([[0], np.searchsorted(group_end, last, "right")]))
    in_group = [np.diff(np.concatenate([[0], np.searchsorted(e, group_end, "right")])) for e in ends]
    if links == "ends":
        pair = own_a[closes], own_b[closes]
    elif links == "overlaps":
        pair = own_a, own_b
    else:
        pair = products(*in_group)
    first = [_ends(n) for n in count]
    doc = np.searchsorted(first[0][1:], pair[0], "right")
    n_links = np.bincount(doc, minlength=len(good)).astype(np.int64)
    own = [(pair[k] - first[k][doc]).astype(np.int32) for k in (0, 1)]
    lists = [(ids[0], count[0]), (ids[1], count[1]), (in_group[0], n_groups), (in_group[1], n_groups), (own[0], n_links), (own[1], n_links)]
    return [arrays(x.astype(np.int32, copy=False), n, pa.int32()) for x, n in lists]


def align(docs: DataFrame, links: str = "ends", byte_level: str = BYTE_LEVEL, pieces: str = PIECES) -> DataFrame:
    """doc_id, the ids a and b of a space and the text by both tokenizers, how many of each a group has, and the links.

    links says which pairs of tokens are linked: "ends" those that end at one byte, "overlaps" those that share a byte,
    "products" all pairs within a group. link_a and link_b are places of tokens, from 0, in rising order.

    Texts that are null or empty, and those whose tokens don't give back a space and the text in either vocabulary (one
    that holds U+2581, say), have empty lists. Repeated rows are aligned each; columns but doc_id and text are left out.
    The piece tokenizer gets a text in parts at its single spaces, which no piece of its model spans.
    """
    if links not in ("ends", "overlaps", "products"):
        raise ValueError(f"links is {links!r}")
    path_a, path_b = tokenizer_path(byte_level), tokenizer_path(pieces)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = _align(batch.column(1), _side(ByteLevel, path_a), _side(Pieces, path_b), links)
        return pa.RecordBatch.from_arrays([batch.column(0), *lists], ["doc_id", *SIDES])

    return map_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")), "text", SCHEMA, work, SLICE)


def _runs(batch: pa.RecordBatch, names: list[str], limit: int) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose lists have up to limit values in all."""
    size = sum(pc.list_value_length(batch.column(batch.schema.get_field_index(x))).to_numpy(zero_copy_only=False).astype(np.int64) for x in names)
    upto, start = np.cumsum(size), 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(upto, (upto[start - 1] if start else 0) + limit, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def _list(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column one after another, and the length of each."""
    column = batch.column(batch.schema.get_field_index(name))
    return column.flatten().to_numpy(zero_copy_only=False), pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)


def _pairs(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Both ids of each link in one number, that of b above, and the links of each row."""
    (a, n_a), (b, n_b), (x, n), (y, _) = (_list(batch, c) for c in ("a", "b", "link_a", "link_b"))
    x, y = x + np.repeat(_ends(n_a)[:-1], n), y + np.repeat(_ends(n_b)[:-1], n)
    return (b[y].astype(np.int64) << 32) | a[x].astype(np.int64), n


def pair_counts(rows: DataFrame) -> DataFrame:
    """pair and count: how many links of all rows, with pairs and times, hold each pair. Tasks add up before they shuffle."""

    def work(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def summed() -> tuple[np.ndarray, np.ndarray]:
            pair, place = np.unique(np.concatenate([x for x, _ in held]), return_inverse=True)
            return pair, np.bincount(place, weights=np.concatenate([n for _, n in held]), minlength=len(pair)).astype(np.int64)

        def out(pair: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(pair), pa.array(n)], ["pair", "n"])

        for batch in batches:
            for run in _runs(batch, ["pairs"], TOKENS):
                held.append((_list(run, "pairs")[0], _list(run, "times")[0]))
                size += len(held[-1][0])
                if size > 2 * GATHERED:
                    held = [summed()]
                    size = len(held[0][0])
                    if size > GATHERED:
                        yield out(*held[0])
                        held, size = [], 0
        if held:
            yield out(*summed())

    return rows.select("pairs", "times").mapInArrow(work, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("count"))


@lru_cache(1)
def _digits(size: int) -> np.ndarray:
    """Decimal numbers up to size, with a comma after them, then with a bar, then with a semicolon."""
    return np.array([f"{i}{end}" for end in ",|;" for i in range(size)], object)


def _spelled(batch: pa.RecordBatch, numbers: np.ndarray) -> list[str]:
    """The groups of each row as a1,a2|b1;a3|b2,b3."""
    (a, n_a), (b, n_b), (g_a, n), (g_b, _) = (_list(batch, c) for c in ("a", "b", "a_in_group", "b_in_group"))
    size = len(numbers) // 3
    ends_a, ends_b = np.cumsum(g_a, dtype=np.int64), np.cumsum(g_b, dtype=np.int64)
    mark_a, mark_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    mark_a[ends_a - 1], mark_b[ends_b - 1] = size, 2 * size
    out = np.empty(len(a) + len(b), np.int64)
    group_a, group_b = np.repeat(np.arange(len(g_a)), g_a), np.repeat(np.arange(len(g_b)), g_b)
    out[np.arange(len(a)) + (ends_b - g_b)[group_a]] = a + mark_a
    out[np.arange(len(b)) + ends_a[group_b]] = b + mark_b
    words, at = numbers[out].tolist(), _ends(n_a + n_b)
    return ["".join(words[i:j])[:-1] for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def summaries(docs: DataFrame, links: str = "ends", byte_level: str = BYTE_LEVEL, pieces: str = PIECES) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256, and pairs and times of each row of docs.

    pairs has the distinct linked id pairs of the row in one number each, that of b above, times how many links hold
    them. All else as in align, whose lists are summed up where they are made and don't leave the task.
    """
    path_a, path_b = tokenizer_path(byte_level), tokenizer_path(pieces)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        a, b = _side(ByteLevel, path_a), _side(Pieces, path_b)
        run = pa.RecordBatch.from_arrays(_align(batch.column(1), a, b, links), list(SIDES))
        n_a, n_b, n_groups = (_list(run, c)[1] for c in ("a", "b", "a_in_group"))
        sha = [hashlib.sha256(s.encode()).hexdigest() if t else "" for s, t in zip(_spelled(run, _digits(max(len(a.raw), len(b.raw)))), n_a.tolist(), strict=True)]
        key, n = _pairs(run)
        doc = np.repeat(np.arange(len(n)), n)
        order = np.lexsort((key, doc))
        doc, key = doc[order], key[order]
        first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])])) if len(key) else np.zeros(0, np.int64)
        own = np.bincount(doc[first], minlength=len(n)).astype(np.int64)
        columns = [batch.column(0), *map(pa.array, (n_a, n_b, n_groups, n)), pa.array(sha, pa.string()), arrays(key[first], own, pa.int64()), arrays(np.diff(np.append(first, len(key))).astype(np.int32), own, pa.int32())]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])

    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"
    return map_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")), "text", schema, work, SLICE)


def digest(docs: DataFrame, links: str = "ends", byte_level: str = BYTE_LEVEL, pieces: str = PIECES) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of each row of docs.

    Counts of pairs cover all rows. Frequent pairs, HEAD of them at most by the share of links that they must have, are
    sent to all tasks, which add up a document's counts where it lies. Each of the others has too few links to weigh on
    a task, and only a document's distinct ones are joined with their counts. Rows as in align: without tokens, zeros
    and an empty hash.
    """
    rows = materialize(summaries(docs, links, byte_level, pieces).withColumn("_at", F.monotonically_increasing_id()), "aligned")
    sums = materialize(pair_counts(rows), "pair-counts")
    b = F.shiftright("pair", 32)
    best = sums.groupBy(b.alias("b")).agg(F.max("count").alias("_top"))  # a row for an id of b, as many as its vocabulary has at most
    counts = sums.withColumn("b", b).join(F.broadcast(best), "b").select("pair", "count", (F.col("count") == F.col("_top")).cast("long").alias("best"))
    counts = materialize(counts, "pairs")
    discard(sums)
    total = counts.agg(F.sum("count")).first()[0] or 0
    frequent = F.col("count") * HEAD >= total
    head = counts.where(frequent).toArrow().sort_by("pair")  # HEAD rows at most, since counts add up to total
    shared = rows.sparkSession.sparkContext.broadcast([head[c].to_numpy() for c in ("pair", "count", "best")])
    kept = ["_at", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]

    def work(batches):
        pair, count, best = shared.value
        for batch in batches:
            for run in _runs(batch, ["pairs"], TOKENS):
                (key, n), (times, _) = _list(run, "pairs"), _list(run, "times")
                doc = np.repeat(np.arange(run.num_rows), n)
                i = np.minimum(np.searchsorted(pair, key), max(len(pair) - 1, 0))
                known = pair[i] == key if len(pair) else np.zeros(len(key), bool)
                mine = [np.bincount(doc[known], weights=x[i[known]] * times[known], minlength=run.num_rows).astype(np.int64) for x in (best, count)]
                own = np.bincount(doc[~known], minlength=run.num_rows).astype(np.int64)
                columns = [*(run.column(run.schema.get_field_index(c)) for c in kept), *map(pa.array, mine), arrays(key[~known], own, pa.int64()), arrays(times[~known], own, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, [*kept, "n_best", "count_sum", "pairs", "times"])

    schema = "_at long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long, pairs array<long>, times array<int>"
    digests = materialize(rows.select(*kept, "pairs", "times").mapInArrow(work, schema), "digests")
    discard(rows)
    rest = digests.select("_at", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("_at", F.col("x.pairs").alias("pair"), F.col("x.times").alias("_n"))
    rare = rest.join(counts.where(~frequent), "pair").groupBy("_at").agg(F.sum(F.col("_n") * F.col("best")).alias("_best"), F.sum(F.col("_n") * F.col("count")).alias("_count"))
    out = digests.drop("pairs", "times").join(rare, "_at", "left")
    more = [(F.col(x) + F.coalesce(y, F.lit(0))).alias(x) for x, y in (("n_best", "_best"), ("count_sum", "_count"))]
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", *more, "groups_sha256")
