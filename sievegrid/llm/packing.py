"""Best-fit packing in bulk-synchronous rounds.

Lengths are whole numbers up to the capacity, so documents of one length and sequences of one gap are
interchangeable: rows stand for classes of them (a length with its range of ranks, a gap with its range of sequences),
whose number the capacity bounds, not the data. A round sorts both by size into ranges; in each range, at the same time
as in the others, the lengths sweep down, and each takes the gaps upwards from its successor, the smallest that
holds it; the ranks of a length decide which of its documents get a gap that not all can have; gaps are updated. What
finds no gap in its range waits for the next round, which has half as many ranges; in the topmost range, above which there
are no gaps, it opens new sequences. Counting, ranking and placing the rows are Spark jobs over all of them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievegrid.llm.chunked import encoder
from sievegrid.llm.common import id_and_text, small_side, stored

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ids of every whole text and the end id, cut into pieces of `capacity`; only longer documents are cut.

    Null text counts as empty: one piece with the end id alone. Rows without an id and repeated rows are cut
    like others. Other columns are not read.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            out: list[tuple] = []
            for doc, ids in zip(batch.column(0).to_pylist(), encoder(tokenizer_path).encode_all(batch.column(1)), strict=True):
                ids += end
                out += [(doc, n, at // 4, min(len(ids) - at, 4 * capacity) // 4, zlib.crc32(ids[at : at + 4 * capacity])) for n, at in enumerate(range(0, len(ids), 4 * capacity))]
            columns = zip(*out, strict=True) if out else [()] * 5
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return id_and_text(docs, id_col, text_col).mapInArrow(rows, PIECES)


#: A row of the rounds. size: a gap, or a length; first, n: its sequences, or the ranks of its documents, that are left.
#: STEP: documents of a length from rank `first` on go to sequences from `sequence` on, `fit` to each, behind `used` tokens.
NEXT, GAP, DOCS, STEP = range(4)
ROUND = "kind int, size long, first long, n long, sequence long, fit long, used long"
#: Ranges of the first round.
RANGES = 4
#: Rows ranked together: what has one length is ranked in as many groups as there are so many rows.
RANKED_ROWS = 20_000


def sweep(rows: pd.DataFrame, capacity: int) -> list[tuple[int, ...]]:
    """What is left of the rows of one range (kind, size, first, n), and its steps.

    A length that finds a gap of g puts g // length documents into each such sequence: after one, the gap that is left
    is the smallest that holds the next. Only the range that has the row NEXT (first: the number of the next
    sequence) opens sequences.
    """
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap: (first sequence, sequences) of those that have it
    out: list[tuple[int, ...]] = []
    of = {k: rows[rows["kind"] == k].sort_values(["size", "first"], ascending=[False, True]) for k in (NEXT, GAP, DOCS)}
    opened = int(of[NEXT]["first"].iloc[0]) if len(of[NEXT]) else None
    for gap, first, n in of[GAP][["size", "first", "n"]].itertuples(index=False):
        gaps.setdefault(int(gap), []).append((int(first), int(n)))
    for length, rank, total in of[DOCS][["size", "first", "n"]].itertuples(index=False):
        length, rank, end = int(length), int(rank), int(rank + total)
        for gap in [*sorted(g for g in gaps if g >= length), capacity]:
            if rank == end:
                break
            fit = gap // length
            if gap < capacity:
                ranges = gaps.pop(gap)
            elif opened is not None:
                ranges = [(opened, -(-(end - rank) // fit))]
                opened += ranges[0][1]
            else:
                ranges = []
            for first, n in ranges:
                put = min(end - rank, n * fit)
                if put:
                    out.append((STEP, length, rank, put, first, fit, capacity - gap))
                full, some = divmod(put, fit)
                for at, many, left in ((first, full, gap - fit * length), (first + full, int(some > 0), gap - some * length), (first + full + (some > 0), n - full - (some > 0), gap)):
                    if many and left:
                        gaps.setdefault(left, []).append((at, many))
                rank += put
        if rank < end:
            out.append((DOCS, length, rank, end - rank, 0, 0, 0))
    out += [(GAP, gap, first, n, 0, 0, 0) for gap, ranges in gaps.items() for first, n in ranges]
    return out if opened is None else [*out, (NEXT, capacity + 1, opened, 0, 0, 0, 0)]


def best_fit_rounds(counts: DataFrame, capacity: int, ranges: int = RANGES) -> DataFrame:
    """The steps (size, first, n, sequence, fit, used) that place documents of the lengths in counts (length, n)."""

    def of_range(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat([pd.DataFrame(columns=["kind", "size", "first", "n"], dtype="int64"), *batches], ignore_index=True)
        found = sweep(rows, capacity)
        yield pd.DataFrame(np.array(found, np.int64).reshape(-1, 7), columns=["kind", "size", "first", "n", "sequence", "fit", "used"]).astype({"kind": "int32"})

    row = lambda kind, size, n: [F.lit(kind).cast("int").alias("kind"), F.lit(size).cast("long").alias("size"), F.lit(0).cast("long").alias("first"), n.cast("long").alias("n")]
    left = counts.select(*row(DOCS, F.col("length"), F.col("n"))).unionByName(counts.sparkSession.range(1).select(*row(NEXT, capacity + 1, F.lit(0))))
    steps = None
    while True:
        # the last round has one range: the classes that are left, at most some thousands for any number of documents
        dealt = left.repartitionByRange(ranges, F.col("size").desc()) if ranges > 1 else left.coalesce(1)
        done = stored(dealt.select("kind", "size", "first", "n").mapInPandas(of_range, ROUND), "packing-round")
        found = done.where(F.col("kind") == STEP).drop("kind")
        steps = found if steps is None else steps.unionByName(found)
        left = done.where(F.col("kind") != STEP)
        if ranges == 1 or left.where(F.col("kind") == DOCS).isEmpty():
            return steps
        ranges //= 2


def pack(pieces: DataFrame, capacity: int = 2048, length_col: str = "length", ranges: int = RANGES) -> DataFrame:
    """pieces with sequence_id and offset (instead of columns of these names): packed into sequences of at most `capacity`.

    Every row with a length from 1 to capacity gets a place; the places in a sequence are gapless from 0. Rows
    whose length is null or out of this range are an error. Repeated rows get a place each; ties in length
    are taken in order of group, then id and piece. An empty table gives no rows. Columns may have any names.
    Ranks within a length come from counts by (group, length), so that a length which a third of the rows share is ranked
    in many tasks. With one range the result is exact best-fit decreasing.
    """
    spark = pieces.sparkSession
    length = F.expr(f"CASE WHEN `{length_col}` BETWEEN 1 AND {capacity} THEN `{length_col}` ELSE raise_error('length out of range') END").cast("long")
    it = F.struct(*[F.col(f"`{c}`") for c in pieces.columns if c.lower() not in ("sequence_id", "offset")])
    rows = stored(pieces.select(it.alias("it"), length.alias("length"), F.spark_partition_id().alias("part")), "pieces")
    groups = max(1, -(-rows.count() // RANKED_ROWS))
    rows = rows.withColumn("group", F.col("part") % groups)
    by_group = stored(rows.groupBy("group", "length").agg(F.count("*").alias("n")), "piece-counts")
    steps = best_fit_rounds(by_group.groupBy("length").agg(F.sum("n").alias("n")), capacity, ranges)
    found = steps.orderBy("size", "first").toPandas()  # classes of lengths and gaps: some thousands for any number of documents
    send = spark.sparkContext.broadcast({k: found[k].to_numpy(np.int64) for k in found})

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        s = send.value
        length, rank = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        at = np.searchsorted(s["size"] * (1 << 45) + s["first"], length * (1 << 45) + rank, side="right") - 1
        nth = rank - s["first"][at]
        return pd.DataFrame({"sequence_id": s["sequence"][at] + nth // s["fit"][at], "offset": s["used"][at] + nth % s["fit"][at] * length})

    before = by_group.select("group", "length", F.expr("sum(n) OVER (PARTITION BY length ORDER BY group) - n").alias("before"))
    order = [F.col(f"it.{c}") for c in ("doc_id", "piece") if c in pieces.columns] or [F.col("part")]
    ranked = rows.withColumn("row", F.row_number().over(Window.partitionBy("group", "length").orderBy(*order)))
    placed = ranked.join(small_side(before, by_group.count()), ["group", "length"]).select("it", place(F.col("length"), F.col("before") + F.col("row") - 1).alias("place"))
    return placed.select("it.*", "place.sequence_id", "place.offset")
