"""Best-fit packing of documents into sequences of a fixed number of tokens, by minimum bin slack.

Sequences are alike if they hold pieces of the same lengths. So the search works on the histogram of lengths, at most
one count for each length up to the capacity, whatever the number of documents: a bitset subset-sum dynamic program
over the lengths that are left finds the fullest combination with the longest of them, and that combination is removed
as often as all its lengths last. At least one length is used up each time, so there are no more combinations than
lengths. The documents then take their places by their rank among those of equal length, which Spark computes.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.batches import arrays, map_texts, text_of
from siltstone.llm.tokens import encoder, tokenizer_path
from siltstone.operators.ordered import rank_in_group
from siltstone.session import materialize

CAPACITY = 4096
TOKENIZER = "word_bpe_49k.json"
END_ID = 1


def fullest(room: int, counts: dict[int, int]) -> dict[int, int]:
    """How many of which lengths fill room best, longer ones first among equals."""
    reach, taken = 1, []
    mask = (1 << (room + 1)) - 1
    for length in sorted((x for x in counts if 0 < x <= room), reverse=True):
        left, chunk = min(counts[length], room // length), 1
        while left > 0:
            chunk = min(chunk, left)
            taken.append((length, chunk, reach))
            reach |= (reach << (length * chunk)) & mask
            left -= chunk
            chunk *= 2
        if reach >> room & 1:
            break
    at, found = reach.bit_length() - 1, {}
    for length, chunk, before in reversed(taken):
        if not before >> at & 1:
            found[length] = found.get(length, 0) + chunk
            at -= length * chunk
    return found


@dataclass
class Layout:
    """Row i: pieces of length[i] with a rank from rank[i] on are dealt `each` to a sequence, from sequence[i], at offset[i]."""

    length: np.ndarray
    rank: np.ndarray
    each: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    sequences: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The sequence and the offset in it of each piece. rank: among the pieces of the same length."""
        keys = (self.length << 40) + self.rank
        i = np.searchsorted(keys, (length << 40) + rank, side="right") - 1
        nth = rank - self.rank[i]
        return self.sequence[i] + nth // self.each[i], self.offset[i] + nth % self.each[i] * length


def layout(histogram: dict[int, int], capacity: int = CAPACITY) -> Layout:
    """Minimum bin slack over the number of pieces of each length from 1 to capacity."""
    left = {int(k): int(n) for k, n in histogram.items() if n > 0}
    if left and not 0 < min(left) <= max(left) <= capacity:
        raise ValueError("lengths have to be from 1 to the capacity")
    used = dict.fromkeys(left, 0)
    rows, sequence = [], 0
    while left:
        longest = max(left)
        rest = left | {longest: left[longest] - 1}
        combination = fullest(capacity - longest, {k: n for k, n in rest.items() if n})
        combination[longest] = combination.get(longest, 0) + 1
        times = min(left[k] // n for k, n in combination.items())
        offset = 0
        for k in sorted(combination, reverse=True):
            rows.append((k, used[k], combination[k], sequence, offset))
            used[k] += combination[k] * times
            offset += k * combination[k]
            left[k] -= combination[k] * times
            if not left[k]:
                del left[k]
        sequence += times
    rows.sort()
    columns = np.array(rows, np.int64).reshape(-1, 5).T
    return Layout(*columns, sequence)


def pack(pieces: DataFrame, length: str, key: list[str], capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to pieces, so that the pieces of a sequence fill it from 0 on without gaps.

    pieces is a table that was written, with lengths from 1 to capacity and the columns `sequence_id` and `offset` free.
    Pieces with equal key and length may change places. The plan that goes to the tasks has at most capacity
    combinations, each with lengths that add up to capacity, whatever the number of rows.
    """
    counts = {r[0]: r[1] for r in pieces.groupBy(length).count().collect()}  # one row for each length at most
    plan = layout(counts, capacity)
    ranked = rank_in_group(pieces, [length], key, sum(counts.values()))

    def place(batches):
        for b in batches:
            n = b.column(b.schema.get_field_index(length)).to_numpy().astype(np.int64)
            sequence, offset = plan.place(n, b.column(b.schema.get_field_index("rank")).to_numpy().astype(np.int64))
            keep = [c for c in b.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in keep), pa.array(sequence), pa.array(offset)], [*keep, "sequence_id", "offset"])

    columns = [f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema]
    return ranked.select(*pieces.columns, "rank").mapInArrow(place, ", ".join([*columns, "sequence_id long", "offset long"]))


def tokenized_pieces(docs: DataFrame, tokenizer: str = TOKENIZER, kind: str = "word", end_id: int = END_ID, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Each document's ids and end_id in pieces of up to capacity: doc_id, piece, start, length, ids_crc32 (and ids)."""
    path = tokenizer_path(tokenizer)

    def work(b: pa.RecordBatch) -> pa.RecordBatch:
        ids, n = encoder(path, kind).encode(b.column(1))
        ends = np.cumsum(n + 1)
        flat = np.full(len(ids) + len(n), end_id, np.uint32)
        inner = np.ones(len(flat), bool)
        inner[ends - 1] = False
        flat[inner] = ids
        cuts = -(-(n + 1) // capacity)
        row = np.repeat(np.arange(len(n)), cuts)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
        start = piece * capacity
        length = np.minimum(capacity, (n + 1)[row] - start)
        at = (ends - n - 1)[row] + start
        raw = memoryview(flat.astype("<u4").tobytes())
        crc = [zlib.crc32(raw[4 * a : 4 * z]) for a, z in zip(at.tolist(), (at + length).tolist(), strict=True)]
        columns = [b.column(0).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        if with_ids:
            columns, names = [*columns, arrays(flat.view(np.int32), length)], [*names, "ids"]
        return pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return map_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")), "text", schema, work)


def pack_documents(docs: DataFrame, tokenizer: str = TOKENIZER, kind: str = "word", end_id: int = END_ID, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row for each piece of a document with its place in a sequence of up to capacity tokens.

    docs has doc_id and text; other columns are left out. A null text is empty and gives one piece, the end id. Repeated
    rows are packed as often as they come, a null doc_id is kept. Only documents of more than capacity tokens are cut.
    with_ids keeps the ids of each piece; sequences() puts them together.
    """
    pieces = materialize(tokenized_pieces(docs, tokenizer, kind, end_id, capacity, with_ids), "pieces")
    return pack(pieces, "length", ["doc_id", "piece", "ids_crc32"], capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and ids from pieces that were packed with their ids; no group is larger than a sequence."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda x: x["ids"])).alias("ids"))
