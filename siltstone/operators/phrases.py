"""A positional index of words, and phrases found in it."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.text import tokens
from siltstone.operators.batches import in_slices
from siltstone.operators.joins import join_checked
from siltstone.operators.records import top_per_key
from siltstone.session import materialize

K1, B = 1.2, 0.75


def positional_index(docs: DataFrame, key: str, text: str, words: Column | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """A written table: key, length (words of the document), term, and at, the term's places from 0; with columns to carry.

    words, an array column, takes the place of the text's words of letters and digits. Each document also has a row
    with an empty term, so that documents can be counted. Texts are read once, and a document's places are put together
    where it lies. key tells documents apart; one with a null key is counted but not found.
    """
    rows = docs.select(key, *carry, (tokens(F.col(text)) if words is None else words).alias("_words"))

    def work(batches):
        for b in in_slices(batches):
            column = b.column(b.num_columns - 1)
            size = pc.list_value_length(column).to_numpy(zero_copy_only=False)  # a null text has no length
            count = np.nan_to_num(size).astype(np.int64)
            coded = column.flatten().dictionary_encode()
            code, doc = coded.indices.to_numpy(zero_copy_only=False), np.repeat(np.arange(len(count)), count)
            place = np.arange(len(code)) - np.repeat(np.cumsum(count) - count, count)
            order = np.lexsort((code, doc))  # stable: places stay in order
            doc, code, place = doc[order], code[order], place[order]
            first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (code[1:] != code[:-1])])) if len(code) else np.zeros(0, np.int64)
            row = np.concatenate([np.arange(len(count)), doc[first]])
            term = pa.concat_arrays([pa.array([""] * len(count), pa.string()), coded.dictionary.cast(pa.string()).take(pa.array(code[first]))])
            ends = np.concatenate([np.zeros(len(count) + 1, np.int32), np.append(first[1:], len(code)).astype(np.int32) if len(first) else np.zeros(0, np.int32)])
            at = pa.ListArray.from_arrays(pa.array(ends), pa.array(place.astype(np.int32)))
            length = pc.list_value_length(column).cast(pa.int32())
            yield pa.RecordBatch.from_arrays([*(b.column(i).take(pa.array(row)) for i in range(b.num_columns - 1)), length.take(pa.array(row)), term, at], [key, *carry, "length", "term", "at"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return materialize(rows.mapInArrow(work, f"{kinds}, length int, term string, at array<int>"), "index")


def phrase_places(index: DataFrame, key: str, phrases: DataFrame) -> DataFrame:
    """phrase, key, length and the carried columns, and at, where the phrase starts, of each document that has it.

    phrases has phrase and words, an array; null and empty ones are in no document. Only the places of their words are
    taken from the index. The documents of a phrase's rarest word are its candidates; for these alone the other words'
    places, moved back by their place in the phrase, are joined on document and word, and what all have in common stays.
    So a word that all documents have adds no rows but those of the candidates, and no task gets all of its documents.
    """
    words = materialize(phrases.select("phrase", F.size("words").alias("_n"), F.posexplode("words").alias("_i", "term")), "phrase-words")
    terms = materialize(words.groupBy("term").agg(F.lit(1).alias("_one")).select("term"), "phrase-terms")
    width = terms.agg(F.max(F.octet_length("term"))).first()[0] or 0
    own = materialize(join_checked(index.where("term <> ''"), terms, ["term"], "left_semi", width + 32), "places")
    found = words.join(own.groupBy("term").agg(F.count("*").alias("_df")), "term")
    rarest = found.groupBy("phrase", "_n").agg(F.count("*").alias("_known"), F.min_by(F.struct("term", "_i"), F.struct("_df", "_i")).alias("_rare")).where("_known = _n")
    rarest = materialize(rarest.select("phrase", "_n", "_rare.term", "_rare._i"), "rarest")
    carried = [c for c in index.columns if c not in (key, "term", "at", "length")]
    back = F.filter(F.transform("at", lambda x: x - F.col("_i")), lambda x: x >= 0)
    first = join_checked(own, rarest, ["term"], "inner", width + 64).select("phrase", "_n", key, "length", *carried, "_i", back.alias("_at")).where(F.size("_at") > 0)
    first = materialize(first, "candidates")
    others = words.select("phrase", F.col("_i").alias("_j"), "term")
    asked = first.select("phrase", key, "_i").join(others, "phrase").where("_i <> _j").select("phrase", key, "term", F.col("_j").alias("_i"))
    rest = asked.join(own.select(key, "term", "at"), [key, "term"]).select("phrase", key, back.alias("_at"))
    empty = [F.lit(None).cast(index.schema[c].dataType).alias(c) for c in ("length", *carried)]
    both = first.select("phrase", key, "_at", "_n", "length", *carried).unionByName(rest.select("phrase", key, "_at", F.lit(None).cast("int").alias("_n"), *empty))
    met = both.groupBy("phrase", key).agg(F.collect_list("_at").alias("_all"), *[F.max(c).alias(c) for c in ("_n", "length", *carried)])
    at = F.aggregate(F.slice("_all", 2, F.greatest(F.size("_all") - 1, F.lit(1))), F.get("_all", F.lit(0)), F.array_intersect)
    return met.where(F.size("_all") == F.col("_n")).select("phrase", key, "length", *carried, F.array_sort(at).alias("at")).where(F.size("at") > 0)


def phrase_hits(index: DataFrame, key: str, phrases: DataFrame, per_phrase: int = 4, only: Column | None = None) -> DataFrame:
    """The best documents of each phrase: phrase, key, occurrences, score, rank; ties by key.

    The score is BM25 with a phrase as a term: how often a document has it, and how many documents do. only, a condition
    on carried columns, restricts the hits to some kinds of documents; scores stay those among all documents.
    """
    places = materialize(phrase_places(index, key, phrases), "phrase-places")
    total = index.where("term = ''").agg(F.count("*").alias("total"), F.avg("length").alias("mean"))
    df = places.groupBy("phrase").agg(F.count("*").alias("df"))
    rows = places.where(F.lit(True) if only is None else F.coalesce(only, F.lit(False))).withColumn("tf", F.size("at"))
    rows = rows.join(df, "phrase").crossJoin(F.broadcast(total))  # one row
    idf = F.greatest(F.lit(1e-6), F.log((F.col("total") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    norm = F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean"))
    scored = rows.withColumn("score", F.round(idf * F.col("tf") * (K1 + 1) / norm, 6))
    return top_per_key(scored, ["phrase"], [F.desc("score"), key], per_phrase).select("phrase", key, F.col("tf").alias("occurrences"), "score", "rank")
