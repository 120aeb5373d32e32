"""From raw documents to packed sequences: score, filter, deduplicate, pack.

Each stage reads the Parquet that the one before it wrote; all but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sievegrid.llm import neardup, packing, quality_model, quality_rules
from sievegrid.llm.common import settled

#: Calibrated score from which a document stays.
LEAST_QUALITY = 0.3


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what the ranking, learnt from the labelled documents among docs, scores at least LEAST_QUALITY.

    Null and empty texts score as texts without words. Rows that repeat are judged alike, each by itself; rows without an id
    are judged, but not learnt from. Texts are read whole, however long. Further columns stay as they are, whatever
    their names. Without labelled documents of both kinds every score is 0.5 and all stay; an empty table stays empty.
    """
    ranking = quality_model.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_model.keep(docs, ranking, LEAST_QUALITY)


def quality_rule_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what passes the base rules and isn't depleted of words by lines that its source repeats, less these lines.

    Null and empty texts fail the base rules. A null source is a source of its own. Equal texts of a source count once in the
    frequencies and have one verdict; ids don't matter. Whole texts are read. Further columns stay as they are, and
    n_chars follows the text; an empty table stays empty.
    """
    return quality_rules.keep_cleaned(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near-duplicates: five words a shingle, similarity of 0.8 or more.

    Of a group the row of the smallest id stays, of rows with one id the one whose text comes first. Rows without an id all
    stay; texts without words, null ones too, are like no other and stay, one an id. Whole texts are compared, however
    long. Further columns stay as they are; an empty table stays empty.
    """
    return neardup.keep(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in sequences of 2048 tokens.

    A null or empty text is one piece with the end id alone. Rows that repeat, and rows without an id, have pieces of their
    own; long texts are cut into as many as they need; documents of one length take their places in order of group, then id.
    Further columns are not read; an empty table gives no rows.
    """
    return packing.pack(packing.cut_pieces(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("quality classifier", quality_classifier),
    ("quality rules", quality_rule_filter),
    ("near-dedup", near_dedup),
    ("best-fit packing", best_fit_packing),
]

#: The ranking is learnt and the sets are hashed: no SQL. tests/llm/test_pipeline.py compares with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for documents; the other stages' rows are written and read again.

    Each stage's rows are a table on the way of the next one: they go when that has been written, with all that it stored itself.
    """

    def rows_after(stages: list) -> DataFrame:
        if not stages:
            return spark.read.parquet(f"{sf_dir}/documents.parquet")
        name, stage = stages[-1]
        return settled(spark, lambda: stage(spark, rows_after(stages[:-1]), sf_dir), name.replace(" ", "-"))

    return STAGES[-1][1](spark, rows_after(STAGES[:-1]), sf_dir)
