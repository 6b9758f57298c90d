"""Token ids in ORC files, in the order of the documents, for readers that take a stripe each.

ORC keeps the ids in integer run-length encoding; its stripes can be read side by side, and row indexes and Bloom
filters on doc_id let a reader skip stripes and row groups that don't hold the documents it looks for.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.batches import arrays, map_texts, text_of
from siltstone.llm.tokens import encoder, tokenizer_path
from siltstone.operators.ordered import running_total
from siltstone.session import materialize

TOKENIZER = "byte_bpe_50k.json"
END_ID = 0
SCHEMA = "doc_id long, ids array<int>, seq long"
#: Stripes of 64 MB before compression, an index entry each 1,000 rows, Bloom filters with 1 % false positives.
OPTIONS = {"orc.stripe.size": 64 << 20, "orc.row.index.stride": 1000, "orc.create.index": "true", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": 0.01, "compression": "zstd"}


def write_tokens(docs: DataFrame, path: str, tokenizer: str = TOKENIZER, kind: str = "byte", end_id: int = END_ID, options: dict | None = None) -> None:
    """Write doc_id, ids with end_id at the end, and seq, which rises with the order of the documents, as ORC to path.

    docs has doc_id and text; other columns are left out. A null text is empty, a null doc_id comes first; rows with
    equal doc_id follow each other by a hash of their text. Texts, which are smaller than their ids, are dealt into
    ranges of doc_id; a hash is part of the range key, so that one doc_id with many rows doesn't fill a partition.
    """
    vocabulary = tokenizer_path(tokenizer)

    def work(b: pa.RecordBatch) -> pa.RecordBatch:
        ids, n = encoder(vocabulary, kind).encode(b.column(1))
        flat = np.full(len(ids) + len(n), end_id, np.int32)
        inner = np.ones(len(flat), bool)
        inner[np.cumsum(n + 1) - 1] = False
        flat[inner] = ids
        return pa.RecordBatch.from_arrays([b.column(0), arrays(flat, n + 1)], ["doc_id", "ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    key = ["doc_id", F.xxhash64("text")]
    ordered = rows.repartitionByRange(*key).sortWithinPartitions(*key)
    tokens = map_texts(ordered, "text", "doc_id long, ids array<int>", work).withColumn("seq", F.monotonically_increasing_id())
    tokens.write.options(**{k: str(v) for k, v in (OPTIONS | (options or {})).items()}).orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """What write_tokens wrote; filters on doc_id are pushed down to stripes and row groups."""
    return spark.read.schema(SCHEMA).orc(path)


def token_index(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document of a token table; start counts all ids before it."""

    def work(batches):
        for b in batches:
            ids = b.column(1)
            ends = ids.offsets.to_numpy().astype(np.int64)
            raw = memoryview(ids.values.to_numpy().astype("<u4").tobytes())
            crc = [zlib.crc32(raw[4 * a : 4 * z]) for a, z in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(np.diff(ends)), pa.array(crc, pa.int64())], ["doc_id", "seq", "n_tokens", "ids_crc32"])

    rows = tokens.select("doc_id", "ids", "seq").mapInArrow(work, "doc_id long, seq long, n_tokens long, ids_crc32 long")
    rows = materialize(rows, "token-index").withColumn("_part", F.shiftrightunsigned("seq", 33))
    return running_total(rows, "_part", "seq", "n_tokens", "start").select("doc_id", "start", "n_tokens", "ids_crc32")
