"""Quality rules by repetition coverage: how much of a text stands in n-grams and lines that it repeats.

Hashes of words are rolled over windows of several lengths with numpy. A text is rejected if duplicated n-grams of any
of these lengths, or duplicated lines, cover too large a share of its characters.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.batches import map_texts, slices, text_of
from siltstone.llm.words import _P, _power, blocks, mix

#: Words in an n-gram and the percentage of a text's word characters that repeated n-grams may cover.
NGRAMS = {5: 20, 7: 18, 10: 16}
#: Percentage of word characters in lines that repeat an earlier line, and of lines that do, among lines with words.
LINE_CHARS, LINES = 20, 50
LEAST_WORDS, REPEATED_WORDS = 10, 20

COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"

_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[list(b"#*$%&|<>")] = 1
_Q = np.uint64(0xA0761D6478BD642F)


def _join_cut_lines(raw: np.ndarray, size: np.ndarray, words: np.ndarray, chars: np.ndarray, goes_on: np.ndarray) -> None:
    """Put the parts of lines that lie in several blocks together, in the first part; the others become empty."""
    for i in np.flatnonzero(goes_on):
        first = i - 1
        while first >= 0 and goes_on[first]:
            first -= 1
        with np.errstate(over="ignore"):
            raw[first] += raw[i] * np.uint64(pow(_P, int(size[first]), 1 << 64))
        size[first] += size[i]
        words[first] += words[i]
        chars[first] += chars[i]
        words[i] = 0


def measure(texts: pa.Array) -> dict[str, np.ndarray]:
    """Counts for each text, and the word characters that repeated n-grams and lines cover. Null is empty."""
    n = len(texts)
    hashes, chars, docs, lines = [], [], [], []
    symbols = np.zeros(n, np.int64)
    ended = True
    for b in blocks(texts):
        s, e = b.words()
        sums = b.sums()
        hashes.append(b.hashes(sums, s, e))
        points = np.zeros(len(b.data) + 1, np.int64)
        np.cumsum((b.data & 0xC0) != 0x80, out=points[1:])
        chars.append(points[e] - points[s])
        docs.append(b.doc[b.segment(s)])
        marks = np.zeros(len(b.data) + 1, np.int64)
        np.cumsum(_SYMBOL[b.data], out=marks[1:])
        np.add.at(symbols, b.doc, marks[b.at[1:]] - marks[b.at[:-1]])
        # lines
        start = np.unique(np.concatenate([b.at[:-1], np.flatnonzero(b.data == 10) + 1]))
        start = start[start < len(b.data)]
        end = np.append(start[1:], len(b.data))[: len(start)]
        end -= (b.data[np.maximum(end - 1, 0)] == 10) & (end > start)
        seg = b.segment(start)
        _, inverse = _power(len(b.data))
        raw = (sums[end] - sums[start]) * inverse[start]
        upto = np.zeros(len(s) + 1, np.int64)
        np.cumsum(chars[-1], out=upto[1:])
        first, last = np.searchsorted(s, start), np.searchsorted(s, end)
        follows = np.append(False, b.doc[1:] == b.doc[:-1])
        follows[0] = bool(lines) and len(lines[-1][0]) > 0 and not ended and lines[-1][4][-1] == b.doc[0]
        ended = bool(b.last[-1])
        goes_on = follows[seg] & (start == b.at[seg])
        lines.append((raw, end - start, last - first, upto[last] - upto[first], b.doc[seg], goes_on))
    empty = np.zeros(0, np.int64)
    hashes, chars, docs = (np.concatenate(x) if x else empty for x in (hashes, chars, docs))
    raw, size, words, line_chars, line_doc, goes_on = (np.concatenate(x) for x in zip(*lines, strict=True)) if lines else (empty,) * 6
    if len(lines) and goes_on.any():
        _join_cut_lines(raw, size, words, line_chars, goes_on)
    out = {"n_words": np.bincount(docs, minlength=n), "word_chars": np.bincount(docs, weights=chars, minlength=n).astype(np.int64), "n_symbols": symbols}
    inked = words > 0
    line_doc, line_chars = line_doc[inked].astype(np.int64), line_chars[inked]
    key = mix(raw[inked].astype(np.uint64) + size[inked].astype(np.uint64)) ^ mix(line_doc.astype(np.uint64) + np.uint64(1))
    order = np.argsort(key, kind="stable")
    again = np.zeros(len(key), bool)
    again[order[1:]] = key[order[1:]] == key[order[:-1]]
    out["n_lines"] = np.bincount(line_doc, minlength=n)
    out["n_dup_lines"] = np.bincount(line_doc[again], minlength=n)
    out["dup_line_chars"] = np.bincount(line_doc[again], weights=line_chars[again], minlength=n).astype(np.int64)
    where = np.arange(len(hashes))
    for length in sorted(NGRAMS):
        where = where[where <= len(hashes) - length]
        where = where[docs[where] == docs[where + length - 1]]
        key = np.zeros(len(where), np.uint64)
        for j in range(length):
            key = key * _Q + hashes[where + j]
        key = mix(key) ^ mix(docs[where].astype(np.uint64) + np.uint64(1))
        ordered = np.sort(key)
        twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        i = np.minimum(np.searchsorted(twice, key), max(len(twice) - 1, 0))
        where = where[twice[i] == key] if len(twice) else where[:0]  # longer ones repeat only where shorter ones do
        step = np.zeros(len(hashes) + 1, np.int64)
        np.add.at(step, where, 1)
        np.add.at(step, where + length, -1)
        covered = np.cumsum(step[:-1]) > 0
        if length == min(NGRAMS):
            out["n_repeat_words"] = np.bincount(docs[covered], minlength=n)
        out[f"repeat_{length}_chars"] = np.bincount(docs[covered], weights=chars[covered], minlength=n).astype(np.int64)
    return out


def verdict(m: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """base_failed and kept."""
    failed = (m["n_words"] < LEAST_WORDS) | (100 * m["n_repeat_words"] > REPEATED_WORDS * m["n_words"])
    over = (100 * m["dup_line_chars"] > LINE_CHARS * m["word_chars"]) | (100 * m["n_dup_lines"] > LINES * m["n_lines"])
    for length, percent in NGRAMS.items():
        over |= 100 * m[f"repeat_{length}_chars"] > percent * m["word_chars"]
    return failed, ~failed & ~over


def judge(docs: DataFrame) -> DataFrame:
    """doc_id with the measures of COLUMNS, a row for each row of docs; a null text has no words and isn't kept.

    Each text is judged by itself, whole; repeated rows and a null doc_id are rows like others. A task needs some 20
    bytes for each byte of the longest text.
    """

    def work(b: pa.RecordBatch) -> pa.RecordBatch:
        m = measure(b.column(1))
        failed, kept = verdict(m)
        names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
        columns = [b.column(0), *(pa.array(m[c].astype(np.int64)) for c in names), pa.array(failed), pa.array(kept)]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", *names, "base_failed", "kept"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return map_texts(rows, "text", f"doc_id long, {COLUMNS}", work)


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs, with its columns, that the rules keep; the texts aren't shuffled."""

    def run(batches):
        for batch in batches:
            for b in slices(batch, "text"):
                mask = pa.array(verdict(measure(b.column(b.schema.get_field_index("text"))))[1])
                yield pa.RecordBatch.from_struct_array(pa.StructArray.from_arrays(b.columns, b.schema.names).filter(mask))

    return docs.mapInArrow(run, docs.schema)


def _oracle() -> str:
    grams = []
    for n in NGRAMS:
        gram = " || ' ' || ".join(["word"] + [f"lead(word, {j}) OVER p" for j in range(1, n)])
        grams.append(f"""g{n} AS (SELECT doc_id, i, {gram} AS gram FROM w WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
t{n} AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g{n} WHERE gram IS NOT NULL) WHERE n > 1),
c{n} AS (SELECT doc_id, count(*) AS n_words, sum(length(word)) AS n_chars FROM w
  WHERE EXISTS (SELECT 1 FROM (SELECT DISTINCT doc_id, i + unnest(range({n})) AS i FROM t{n}) x WHERE x.doc_id = w.doc_id AND x.i = w.i) GROUP BY doc_id)""")
    over = " OR ".join(f"100 * coalesce(c{n}.n_chars, 0) > {p} * word_chars" for n, p in NGRAMS.items())
    joins = " ".join(f"LEFT JOIN c{n} USING (doc_id)" for n in NGRAMS)
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
w AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM d),
{", ".join(grams)},
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d),
m AS (SELECT doc_id, length(array_to_string(regexp_extract_all(line, '[^\x20\x09-\x0D]+'), '')) AS n_chars,
    row_number() OVER (PARTITION BY doc_id, line ORDER BY i) > 1 AS again FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE again) AS n_dup_lines, coalesce(sum(n_chars) FILTER (WHERE again), 0) AS dup_chars FROM m GROUP BY doc_id),
base AS (SELECT d.doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    coalesce(dup.n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(dup.n_lines, 0) AS n_lines, coalesce(dup.dup_chars, 0) AS dup_chars FROM d LEFT JOIN dup USING (doc_id)),
j AS (SELECT base.*, coalesce(c5.n_words, 0)::BIGINT AS n_repeat_words, ({over}) AS over FROM base {joins})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {REPEATED_WORDS} * n_words) AS base_failed,
  NOT (n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {REPEATED_WORDS} * n_words) AND NOT over
    AND NOT (100 * dup_chars > {LINE_CHARS} * word_chars OR 100 * n_dup_lines > {LINES} * n_lines) AS kept
FROM j"""


ORACLE = _oracle()
