"""Token counts behind a digest cache: only texts that the cache lacks are encoded, each distinct one once."""

from __future__ import annotations

import hashlib
import importlib.metadata
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievegrid.llm.chunked import encoder
from sievegrid.llm.common import hot_keys, id_and_text, small_side, spread_join, stored

CACHE_SCHEMA = "digest binary, version string, n_tokens long"


def tokenizer_version(tokenizer_path: str) -> str:
    """SHA-256 of the tokenizer's file and the library's version: others never meet counts of this one. How texts are cut
    into chunks follows from the file."""
    return hashlib.sha256(Path(tokenizer_path).read_bytes() + importlib.metadata.version("tokenizers").encode()).hexdigest()


def cached_counts(spark: SparkSession, cache_path: str, version: str) -> DataFrame | None:
    """digest, n_tokens of a version; None before the first append. Rows that two writers added count once."""
    path = spark._jvm.org.apache.hadoop.fs.Path(cache_path)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    rows = spark.read.schema(CACHE_SCHEMA).parquet(cache_path).where(F.col("version") == version)
    return rows.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, cache_path: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes (UTF-8) and n_tokens of the whole text of every row, as the tokenizer's library counts.

    Content is normalised only in that a null text is an empty one: any other change could change the count.
    Its digest is SHA-256, the key of the cache at `cache_path` together with the tokenizer's version. Rows
    without an id and repeated rows are counted like any others; an empty table gives no rows and appends none.
    Other columns of docs are not read. Copies meet before the shuffle, so a text that a third of the rows
    share moves once per task, and its rows meet their count in several tasks. An append that is cut short leaves whole files or none, and the next call
    encodes what is still missing.
    """
    spark = docs.sparkSession
    version = tokenizer_version(tokenizer_path)
    texts = id_and_text(docs, id_col, text_col).withColumn("digest", F.unhex(F.sha2("text", 256)))
    keys = stored(texts.select("doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes")), "token-keys")
    known = cached_counts(spark, cache_path, version)
    missing = texts.select("digest", "text")
    if known is not None:
        missing = missing.join(small_side(known.select("digest")), "digest", "left_anti")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [len(ids) // 4 for ids in encoder(tokenizer_path).encode_all(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([version] * len(n), pa.string()), pa.array(n, pa.int64())], ["digest", "version", "n_tokens"])

    missing.groupBy("digest").agg(F.first("text").alias("text")).mapInArrow(count, CACHE_SCHEMA).write.mode("append").parquet(cache_path)
    copies = keys.groupBy("digest").agg(F.count("*").alias("copies"))
    hot = hot_keys(copies, ["digest"], "copies", keys.count())
    return spread_join(keys, cached_counts(spark, cache_path, version), ["digest"], hot=hot).select("doc_id", "n_bytes", "n_tokens")
