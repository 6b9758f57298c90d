"""Many words looked for in one pass over each text, by an automaton that each worker process builds once."""

from __future__ import annotations

import re
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.text import normalize
from siltstone.operators.batches import in_slices
from siltstone.operators.joins import join_checked
from siltstone.session import materialize

#: Characters of all words together that one automaton holds; it takes some hundred bytes for each in a worker.
CHARACTERS = 4 << 20

_built: dict[str, object] = {}


def _automaton(name: str, words: list, values: list):
    """The automaton of a broadcast list, kept until another one is asked for."""
    if name not in _built:
        import ahocorasick

        made = ahocorasick.Automaton()
        for word, value in zip(words, values, strict=True):
            made.add_word(word, value)
        made.make_automaton()
        _built.clear()
        _built[name] = made
    return _built[name]


def contains_words(texts: DataFrame, key: str, text: Column, words: DataFrame) -> DataFrame:
    """key and word for each row of texts and each word (words has a column `word`) that its text contains, once.

    Words are counted by their characters; up to CHARACTERS go to every task, which then reads each text once, however
    many they are. More are dealt to several such passes, each with all texts. Null and empty words are nowhere.
    """
    words = materialize(words.select("word").where("word <> ''").distinct(), "words")
    total = words.agg(F.sum(F.length("word"))).first()[0] or 0
    passes = max(1, -(-total // CHARACTERS))
    rows = texts.select(key, text.alias("_text")).where("_text IS NOT NULL")
    schema = f"{key} {rows.schema[key].dataType.simpleString()}, word string"
    out = None
    for k in range(passes):
        some = words if passes == 1 else words.where(F.pmod(F.xxhash64("word"), F.lit(passes)) == k)
        listed = [r[0] for r in some.collect()]  # CHARACTERS characters, give or take the hash
        name, shared = uuid.uuid4().hex, texts.sparkSession.sparkContext.broadcast(listed)

        def work(batches, name=name, shared=shared):
            if not shared.value:
                return
            find = _automaton(name, shared.value, shared.value)
            for b in in_slices(batches):
                place, found = [], []
                for i, t in enumerate(b.column(1).to_pylist()):
                    own = {word for _, word in find.iter(t)}
                    place += [i] * len(own)
                    found += own
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(place, pa.int32())), pa.array(found, pa.string())], [key, "word"])

        hit = rows.mapInArrow(work, schema)
        out = hit if out is None else out.unionByName(hit)
    return out


def contains_alias(texts: DataFrame, key: str, text: str, aliases: DataFrame) -> DataFrame:
    """For each text and brand the longest alias in it; aliases has brand and alias.

    Texts and aliases are compared in lower case and without zero-width characters; an alias of nothing else is nowhere.
    Of aliases of equal length the last in order is given. Rows of one key count as one text.
    """
    table = materialize(aliases.select("brand", "alias", normalize(F.col("alias")).alias("word")).where("word <> ''").distinct(), "aliases")
    hits = contains_words(texts, key, normalize(F.col(text)), table)
    width = table.agg(F.max(F.octet_length("brand") + F.octet_length("alias") + F.octet_length("word"))).first()[0] or 0
    named = join_checked(hits, table, ["word"], "inner", width + 64)
    return named.groupBy(key, "brand").agg(F.max_by("alias", F.struct(F.length("alias"), "alias")).alias("alias"))


#: Runs of letters and digits.
RUN = re.compile(r"[^\W_]+")


def best_cut(run: str, matches: list[tuple[int, int, int]], unknown: int) -> list[tuple[int, int, bool]]:
    """The path of the highest score over a run: start, end and whether it is a word of the dictionary.

    matches are start, end and score of words within the run. A character that no word of the path covers costs
    `unknown`; such characters side by side are one piece. Of paths with one score, that with the longer first step.
    """
    n = len(run)
    by_start: list[list] = [[] for _ in range(n)]
    for start, end, score in matches:
        by_start[start].append((end, score))
    best, step, known = [0] * (n + 1), [0] * n, [False] * n
    for i in range(n - 1, -1, -1):
        best[i], step[i] = unknown + best[i + 1], i + 1
        for end, score in by_start[i]:
            if (score + best[end], end) > (best[i], step[i]) or (score + best[end], end) == (best[i], step[i]):
                best[i], step[i], known[i] = score + best[end], end, True
    out: list[tuple[int, int, bool]] = []
    i = 0
    while i < n:
        if not known[i] and out and not out[-1][2] and out[-1][1] == i:
            out[-1] = (out[-1][0], step[i], False)
        else:
            out.append((i, step[i], known[i]))
        i = step[i]
    return out


def segment(texts: DataFrame, key: str, text: Column, dictionary: DataFrame, search: bool = False) -> DataFrame:
    """key and words, those of the text by a dictionary (word, weight), for texts without spaces too.

    Texts and words are in lower case and without zero-width characters. Each run of letters and digits is cut where
    the product of the words' shares of all weights is highest, to six places of their logarithms; a character outside
    of the dictionary counts like a word of weight 1, and such characters side by side stay together, so that an unknown
    name is one word. With search, the words of two and three characters within a longer word come before it.
    Words with white space, of weight below 1, or null are left out of the dictionary; of repeated ones the heaviest
    counts. A null text has null words. The dictionary has CHARACTERS characters at most, which is checked.
    """
    rows = dictionary.select(normalize(F.col("word")).alias("word"), F.col("weight").cast("double").alias("weight")).where(r"word <> '' AND weight >= 1 AND NOT word RLIKE '\\s'")
    rows = materialize(rows.groupBy("word").agg(F.max("weight").alias("weight")), "dictionary")
    total, size = rows.agg(F.sum("weight"), F.sum(F.length("word"))).first()
    if (size or 0) > CHARACTERS:
        raise ValueError(f"a dictionary of {size} characters; {CHARACTERS} at most")
    price = lambda w: F.round(F.log(w / F.lit(total or 1.0)) * 1e6).cast("long")
    listed = [(r[0], r[1]) for r in rows.select("word", price(F.col("weight"))).collect()]  # CHARACTERS characters at most
    unknown = int(rows.sparkSession.range(1).select(price(F.lit(1.0))).first()[0])
    name, shared = uuid.uuid4().hex, texts.sparkSession.sparkContext.broadcast(listed)

    def cut(t: str, find, words: set) -> list[str]:
        out = []
        for m in RUN.finditer(t):
            run = m.group()
            matches = [(end + 1 - n, end + 1, score) for end, (n, score) in find.iter(run)] if find else []
            for a, b, known in best_cut(run, matches, unknown):
                if search and known:
                    out += [run[i : i + n] for n in (2, 3) if b - a > n for i in range(a, b - n + 1) if run[i : i + n] in words]
                out.append(run[a:b])
        return out

    def work(batches):
        find = _automaton(name, [w for w, _ in shared.value], [(len(w), s) for w, s in shared.value]) if shared.value else None
        words = {w for w, _ in shared.value if len(w) <= 3}
        for b in in_slices(batches):
            found = [None if t is None else cut(t, find, words) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.string()))], [key, "words"])

    rows = texts.select(key, normalize(text).alias("_text"))
    return rows.mapInArrow(work, f"{key} {rows.schema[key].dataType.simpleString()}, words array<string>")
