"""Token ids in ORC files: ascending ids, integer run-length encoding, row indexes, Bloom filters on the id.

Files are written by one task each over ranges of doc_id, so that every stripe can be read alone and the
row index (minimum and maximum per 10,000 rows) or the Bloom filter lets a lookup skip the others.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievegrid.llm.chunked import encoder
from sievegrid.llm.common import id_and_text, small_side

#: doc_id; ids, the end id included; how many; tokens before them in the file; place of the row in the file.
SCHEMA = "doc_id long, ids array<int>, n_tokens long, file_start long, file_row long"
ORC_OPTIONS = {"orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.create.index": "true", "orc.row.index.stride": "10000", "orc.stripe.size": str(64 << 20), "compression": "zstd"}


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes the whole text of every row and writes ORC files to `path`, in ascending order of id over all files.

    Null text counts as empty: its ids are the end id alone. Rows without an id come first. Rows that repeat
    an id are all kept, in order of a hash of their texts, over as many ranges as they fill: an id, or none, that a
    third of the rows have is no task of its own. An empty table gives files without rows. Other columns of docs
    are not read. A lost executor costs only its own ranges, which are encoded again.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, rows, end = 0, 0, np.array([end_id], "<u4").tobytes()
        for batch in batches:
            encoded = [ids + end for ids in encoder(tokenizer_path).encode_all(batch.column(1))]
            n = np.array([len(ids) // 4 for ids in encoded], np.int64)
            ends = np.cumsum(n)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(np.frombuffer(b"".join(encoded), "<i4")))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(n), pa.array(tokens + ends - n), pa.array(np.arange(rows, rows + len(n)))], ["doc_id", "ids", "n_tokens", "file_start", "file_row"])
            tokens, rows = tokens + int(n.sum()), rows + len(n)

    order = ["doc_id", "hash", "row"]
    rows = id_and_text(docs, id_col, text_col).withColumn("hash", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    ordered.mapInArrow(encode, SCHEMA).write.options(**ORC_OPTIONS).orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the files with `start`: how many ids all rows before them hold, in the order of the files."""
    rows = spark.read.schema(SCHEMA).orc(path).withColumn("file", F.col("_metadata.file_path"))
    # one row per file: what the files before it hold
    files = rows.groupBy("file").agg(F.min(F.struct(F.col("doc_id").isNotNull(), F.col("doc_id"), F.col("file"))).alias("first"), F.sum("n_tokens").alias("total"))
    starts = files.select("file", F.expr("sum(total) OVER (ORDER BY first) - total").alias("before"))
    return rows.join(small_side(starts), "file").select("doc_id", "ids", "n_tokens", (F.col("before") + F.col("file_start")).alias("start"))


def token_digests(rows: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the crc32 of the ids as little-endian unsigned 32-bit integers."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(3)
            values, at = np.asarray(ids.values).astype("<u4"), np.asarray(ids.offsets)
            crc = [zlib.crc32(values[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.select("doc_id", "start", "n_tokens", "ids").mapInArrow(digest, "doc_id long, start long, n_tokens long, ids_crc32 long")
