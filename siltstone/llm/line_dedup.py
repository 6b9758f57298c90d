"""Line dedup by pairwise alignment: common blocks of lines are deleted from the later of two documents.

Each document is cut into spans: from each line on, and up to each line, as few lines as have enough words to lead to a
pair, and as few as have enough to be deleted. Documents that share a rare span, one that stands in RARE places at most,
are all paired with each other; a span that more places have leads from each later document to the first holder only, so
that no line, however frequent, makes more pairs than it has places. Each pair is aligned by patience diff. A block is a
run of aligned lines without a gap on either side; those of enough words are marked in the later document.

An alignment keeps the order of both sides, so a block that moved isn't in it. Therefore the lines that no block took are
aligned again, until that finds no more: a block that stands elsewhere is in a later alignment. What repeated alignment
can still miss are blocks of lines that stand several times on both sides, or that share lines with blocks found before;
where lines of the other document are left, a check of all spans of such lines finds those. The marks of all pairs are
deleted. marked_lines(..., moved=True) also marks every block that any earlier document has, wherever it stands.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.batches import map_texts, slices, spare, text_of
from siltstone.operators.joins import join_checked
from siltstone.session import discard, materialize

#: Words of a span of lines that may lead to a pair, and of a run of aligned lines that is deleted.
LEAST_LINE, LEAST_BLOCK = 5, 20
#: Places up to which a span is rare, so that all documents that have it are paired with each other.
RARE = 8
#: Characters of scripts without spaces, two of which count as a further word where sizes are compared: South-East Asian, kana and Han.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")


def line_sizes(lines: list[str], words: list[int]) -> list[int]:
    """Numbers of words of lines, with those that no spaces part."""
    return [n + len(_UNSPACED.findall(x)) // 2 for x, n in zip(lines, words, strict=True)]


def line_hashes(text: str) -> tuple[list[int], list[int]]:
    """Hashes and sizes of the lines that have words; white space counts as one space."""
    words = [x.split() for x in text.encode().split(b"\n")]
    sizes = [len(x) for x in words]
    if _UNSPACED.search(text):
        sizes = line_sizes(text.split("\n"), sizes)
    return [xxhash.xxh3_64_intdigest(b" ".join(x)) - (1 << 63) for x in words if x], [n for x, n in zip(words, sizes, strict=True) if x]


def _upto(sizes: list[int], least: int) -> list[tuple[int, int]]:
    """First and last place of the shortest spans of size least that end at each place."""
    out, start, total = [], 0, 0
    for end, n in enumerate(sizes):
        total += n
        while total - sizes[start] >= least and start < end:
            total -= sizes[start]
            start += 1
        if total >= least:
            out.append((start, end))
    return out


def spans(sizes: list[int], least: int) -> set[tuple[int, int]]:
    """First and last place of the shortest spans of size least from each place on and up to each place.

    Those inside of any run of that size cover it.
    """
    last = len(sizes) - 1
    return {*_upto(sizes, least), *((last - b, last - a) for a, b in _upto(sizes[::-1], least))}


def span_hashes(lines: list[int], sizes: list[int], least: int) -> tuple[list[int], list[int], list[int], list[bool]]:
    """Hashes, first and last places of a document's spans, and whether they are long enough to be deleted."""
    blocks = spans(sizes, least)
    places = sorted(spans(sizes, LEAST_LINE) | blocks)
    raw = array("q", lines).tobytes()
    keys = [lines[a] if a == b else xxhash.xxh3_64_intdigest(raw[8 * a : 8 * b + 8]) - (1 << 63) for a, b in places]
    return keys, [a for a, _ in places], [b for _, b in places], [x in blocks for x in places]


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs, in the order of the first numbers, in which the second ones rise."""
    tails, at, back = [], [], []
    for k, (_, y) in enumerate(pairs):
        i = bisect_left(tails, y)
        back.append(at[i - 1] if i else -1)
        if i == len(tails):
            tails.append(y)
            at.append(k)
        else:
            tails[i], at[i] = y, k
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Places in a and b of the lines that patience diff aligns.

    Lines that are unique on both sides are anchors; between two of them the search goes on. Where no line is unique,
    the nth copy of a line stands for itself.
    """
    found, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            found.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            found.append((a1 - 1, b1 - 1))
            a1, b1 = a1 - 1, b1 - 1
        if a0 >= a1 or b0 >= b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        where = {x: b0 + i for i, x in enumerate(b[b0:b1]) if in_b[x] == 1}
        anchors = _rising([(i, where[a[i]]) for i in range(a0, a1) if in_a[a[i]] == 1 and a[i] in where])
        if anchors:
            edges = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
            found += anchors
            todo += [(x + 1, z, y + 1, w) for (x, y), (z, w) in zip(edges, edges[1:], strict=False)]
        elif in_a.keys() & in_b.keys():
            seen, nth = Counter(), {}
            for i in range(b0, b1):
                nth[b[i], seen[b[i]]] = i
                seen[b[i]] += 1
            seen, both = Counter(), []
            for i in range(a0, a1):
                if (j := nth.get((a[i], seen[a[i]]))) is not None:
                    both.append((i, j))
                seen[a[i]] += 1
            found += _rising(both)
    return sorted(found)


def _spans_of(lines: list[int], size: dict[int, int], least: int) -> Iterator[tuple[int, int]]:
    """spans() of the runs of lines whose size is known."""
    run = 0
    for k in range(len(lines) + 1):
        if k == len(lines) or lines[k] not in size:
            yield from ((run + x, run + y) for x, y in spans([size[v] for v in lines[run:k]], least))
            run = k + 1


def _other_blocks(a: list[int], sizes: list[int], b: list[int], left: list[int], least: int) -> set[int]:
    """Places in a of all runs of size least that b has too, if any of the places left has a line of b."""
    there = set(b)
    if not any(a[i] in there for i in left):
        return set()
    size = {v: n for v, n in zip(a, sizes, strict=True) if v in there}
    known = {tuple(b[x : y + 1]) for x, y in _spans_of(b, size, least)}
    return {i for x, y in _spans_of(a, size, least) if tuple(a[x : y + 1]) in known for i in range(x, y + 1)}


def common_blocks(a: list[int], sizes: list[int], b: list[int], least: int) -> list[int]:
    """Places in a of the aligned blocks of size least: runs of aligned lines without a gap in a or b.

    What is left of a is aligned with b again as long as blocks are found, each time at least one of that size. Then
    all runs of that size count that both have, wherever they stand.
    """
    out: list[int] = []
    left = list(range(len(a)))
    while True:
        new, run = [], []
        for x, y in [*((left[i], j) for i, j in patience([a[i] for i in left], b)), (-1, -1)]:
            if run and (x, y) != (run[-1][0] + 1, run[-1][1] + 1):
                if sum(sizes[i] for i, _ in run) >= least:
                    new += [i for i, _ in run]
                run = []
            run.append((x, y))
        out += new
        gone = set(new)
        left = [i for i in left if i not in gone]
        if not new or sum(sizes[i] for i in left) < least:
            return sorted({*out, *_other_blocks(a, sizes, b, left, least)})


def delete_lines(text: str, marked: set[int]) -> tuple[str, int, int]:
    """The text without marked lines, and how many lines and words went.

    marked has places among the lines with words; lines without words between two of them that follow each other go too.
    """
    lines = text.split("\n")
    inked = [(i, n) for i, x in enumerate(lines) if (n := len(x.encode().split()))]
    gone = {inked[k][0] for k in marked}
    for k in marked:
        if k + 1 in marked:
            gone.update(range(inked[k][0], inked[k + 1][0]))
    return "\n".join(x for i, x in enumerate(lines) if i not in gone), len(marked), sum(inked[k][1] for k in marked)


def _numbers(column: pa.Array) -> list:
    """A list column as numpy arrays, one for each row."""
    cuts, values = column.offsets.to_numpy(), column.values.to_numpy()
    return [values[x:y] for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


def marked_lines(docs: DataFrame, least: int = LEAST_BLOCK, moved: bool = False) -> DataFrame:
    """doc_id, text_hash and marked: places, among lines with words, in blocks of size least with an earlier document.

    Blocks are those of the alignments; with moved, those of any span that an earlier document has come to them.

    Documents are in the order of doc_id and, where it is repeated, of a hash of their text; rows alike are one
    document. Rows without doc_id have no part in it. The table is written.
    """

    def work(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = [line_hashes(x) for x in b.column(2).to_pylist()]
        found = [span_hashes(*x, least) for x in rows]
        kinds = {"keys": pa.int64(), "starts": pa.int32(), "ends": pa.int32(), "blocks": pa.bool_()}
        columns = [b.column(0), b.column(1), pa.array([x for x, _ in rows], pa.list_(pa.int64())), pa.array([x for _, x in rows], pa.list_(pa.int32()))]
        columns += [pa.array([x[i] for x in found], pa.list_(kind)) for i, kind in enumerate(kinds.values())]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "lines", "sizes", *kinds])

    rows = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_of()).alias("text_hash"), text_of().alias("text"))
    lines = map_texts(rows, "text", "doc_id long, text_hash long, lines array<long>, sizes array<int>, keys array<long>, starts array<int>, ends array<int>, blocks array<boolean>", work)
    lines = materialize(lines, "lines")
    doc = F.struct("doc_id", "text_hash")
    first = lines.select(doc.alias("doc"), F.explode("keys").alias("key")).groupBy("key").agg(F.min("doc").alias("first"), F.max("doc").alias("last"), F.count("*").alias("n")).where("first < last")
    spots = lines.select(doc.alias("doc"), F.explode(F.arrays_zip("keys", "starts", "ends", "blocks")).alias("x")).select("doc", F.col("x.keys").alias("key"), F.col("x.starts").alias("start"), F.col("x.ends").alias("end"), F.col("x.blocks").alias("block"))
    hits = materialize(spots.join(first.select("key", "first", "n"), "key").where(f"doc > first OR n <= {RARE}"), "hits")
    rare = hits.where(F.col("n") <= RARE).groupBy("key").agg(F.collect_set("doc").alias("docs"))  # RARE at most
    rare = rare.select(F.explode("docs").alias("doc"), "docs").select("doc", F.explode(F.filter("docs", lambda x: x < F.col("doc"))).alias("other"))
    pairs = rare.union(hits.where(F.col("n") > RARE).select("doc", F.col("first").alias("other"))).distinct()
    # rows alike are one document
    own = lines.select(doc.alias("doc"), "lines", "sizes").dropDuplicates(["doc"])
    both = pairs.join(own, "doc").join(own.select(F.col("doc").alias("other"), F.col("lines").alias("other_lines")), "other")

    def align(batches):
        for t in batches:
            a, sizes, b = (_numbers(t.column(i)) for i in (2, 3, 4))
            found = [common_blocks(x.tolist(), n.tolist(), y.tolist(), least) for x, n, y in zip(a, sizes, b, strict=True)]
            yield pa.RecordBatch.from_arrays([t.column(0), t.column(1), pa.array(found, pa.list_(pa.int32()))], ["doc_id", "text_hash", "marked"])

    aligned = both.select("doc.doc_id", "doc.text_hash", "lines", "sizes", "other_lines").mapInArrow(align, "doc_id long, text_hash long, marked array<int>")
    if moved:
        aligned = aligned.union(hits.where("block AND doc > first").select("doc.doc_id", "doc.text_hash", F.sequence("start", "end").alias("marked")))
    places = aligned.select("doc_id", "text_hash", F.explode("marked").alias("i")).distinct()
    marked = materialize(places.groupBy("doc_id", "text_hash").agg(F.collect_list("i").alias("marked")), "marked")
    discard(lines, hits)
    return marked


def dedup_lines(docs: DataFrame, least: int = LEAST_BLOCK) -> DataFrame:
    """docs with its columns, text without the blocks of lines that earlier documents have, n_removed_lines, n_removed_words.

    A null text is empty. Rows without doc_id, and texts without a shared block, stay as they are. Columns of docs with
    the names of the two new ones are replaced; any others stay. No row goes; a copy of an earlier text of that size is
    left empty. Sizes are words between spaces, and one more for two characters of scripts without spaces; the numbers
    returned are without these.
    """
    key, text_hash, places = (spare(x, docs) for x in ("id", "hash", "marked"))
    marked = marked_lines(docs, least).withColumnsRenamed({"doc_id": key, "text_hash": text_hash, "marked": places})
    names = [c for c in docs.columns if c not in ("n_removed_lines", "n_removed_words")]
    keyed = docs.select(*(F.col(f"`{c}`") for c in names if c != "text"), text_of().alias("text"))
    keyed = keyed.withColumn(key, F.col("doc_id").cast("long")).withColumn(text_hash, F.xxhash64("text"))
    size = marked.agg(F.count("*"), F.coalesce(F.sum(F.size(places)), F.lit(0))).first()
    joined = join_checked(keyed, marked, [key, text_hash], "left", 128 + 4 * -(-size[1] // max(size[0], 1)))

    def edit(batches):
        for batch in batches:
            for b in slices(batch, "text"):
                at = {c: b.schema.get_field_index(c) for c in [*names, places]}
                rows = [delete_lines(x, set(m)) if m else (x, 0, 0) for x, m in zip(b.column(at["text"]).to_pylist(), b.column(at[places]).to_pylist(), strict=True)]
                columns = [pa.array([x for x, _, _ in rows], pa.string()) if c == "text" else b.column(at[c]) for c in names]
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array([x[k] for x in rows], pa.int64()) for k in (1, 2))], [*names, "n_removed_lines", "n_removed_words"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*(F.col(f"`{c}`") for c in names)).withColumn("text", text_of()).select(*(F.col(f"`{c}`") for c in names)).schema)
    return joined.drop(key, text_hash).mapInArrow(edit, f"{schema}, n_removed_lines long, n_removed_words long")
