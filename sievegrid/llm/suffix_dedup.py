"""Removal of long passages that occur again, by a logarithmic family of sparse suffix arrays.

Of all suffixes those at anchors are kept: in each window of `length` bytes the place whose next `head` bytes have the least
hash. Equal windows have their anchors at equal places, so two equal strings of that length meet at one of them, and some
one suffix in (length - head) / 2 is kept. An entry of an array is (key, block, n): fingerprints of the suffix's first
`head` bytes and of all bytes that the windows of this anchor cover, and how often both occur; arrays are sorted
by them, which puts next to each other what shares the first bytes, as the order of the bytes would.

A batch gets its array and is merged in a scan with every level there is. Neighbours with one key and one block are
settled: all windows of these anchors occur again. Neighbours with one key and different blocks are open: they are cut into pieces of a
few windows, at equal places from the anchor, of each block once. A piece that occurs again as a whole is settled; if only what all
its windows share occurs again, its windows are compared one by one; else none of them occurs again. Levels of one rank are merged into one of the next, so that an entry is
written again only as often as the logarithm of the number of batches.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievegrid.llm.common import BROADCAST_ROWS, hot_keys, id_and_text, remove, small_side, spread_join, stored, work_folder

_M64 = (1 << 64) - 1
_BASE, _ODD = 0x9E3779B97F4A7C15, np.uint64(0xC2B2AE3D27D4EB4F)
#: Window starts that are worked on at a time, so that arrays stay in the cache of a core.
_CHUNK = 1 << 15


@dataclass(frozen=True)
class Settings:
    """length: bytes of a string that must not occur again; head: bytes by which suffixes meet; batches: of a whole table;
    piece: windows of a piece of an open block."""

    length: int = 200
    head: int = 64
    batches: int = 4
    piece: int = 16


class Anchors:
    """Of texts that lie one after another: the anchor of each run of windows, the first of these windows, and their number."""

    def __init__(self, s: Settings):
        self.s = s
        powers, inverse = np.empty(_CHUNK + s.length, np.uint64), np.empty(_CHUNK + s.length, np.uint64)
        up, down, back = 1, 1, pow(_BASE, -1, 1 << 64)
        for i in range(len(powers)):
            powers[i], inverse[i] = up, down
            up, down = up * _BASE & _M64, down * back & _M64
        self.powers, self.inverse = powers, inverse
        self.values = np.random.default_rng(3).integers(0, 1 << 64, 256, np.uint64)

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        length, head, out = self.s.length, self.s.head, []
        first, last, seen, before = int(offsets[0]), int(offsets[-1]) - length + 1, 0, -1
        inside = np.ones(max(0, last - first), bool)  # windows that don't reach into the next text
        for start, end in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            inside[max(start, end - length + 1) - first : end - first] = False
        for at in range(first, last, _CHUNK):
            to = min(at + _CHUNK, last)
            places = np.flatnonzero(inside[at - first : to - first])
            if not len(places):
                continue
            x = data[at : to + length - 1]
            sums = np.zeros(len(x) + 1, np.uint64)
            np.cumsum(self.values[x] * self.powers[: len(x)], out=sums[1:])
            least = (sums[head:] - sums[:-head]) * self.inverse[: len(x) - head + 1] * _ODD
            least &= np.uint64(0xFFFFFFFF00000000)  # by the upper half of the hash, then by place
            least |= np.arange(at, at + len(least), dtype=np.uint64)
            width, step = length - head + 1, 1
            while 2 * step <= width:
                least = np.minimum(least[:-step], least[step:])
                step *= 2
            if step < width:
                least = np.minimum(least[: step - width], least[width - step :])
            anchor = (least[: to - at][places] & np.uint64(0xFFFFFFFF)).astype(np.int64)
            new = np.flatnonzero(np.diff(anchor, prepend=before))
            out.append((anchor[new], places[new] + at, new + seen))
            seen, before = seen + len(places), anchor[-1]
        if not out:
            return (np.empty(0, np.int64),) * 3
        anchor, start, order = (np.concatenate(x) for x in zip(*out, strict=True))
        return anchor, start, np.diff(order, append=seen)


def _texts(column: pa.Array) -> tuple[np.ndarray, memoryview, np.ndarray]:
    """The bytes of a binary column, twice, and where its rows begin and end in them."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    view = memoryview(data) if data is not None else memoryview(b"")
    return np.frombuffer(view, np.uint8), view, np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]


def _longs(found: list[int]) -> np.ndarray:
    return np.array(found, np.uint64).view(np.int64)


def suffixes(docs: DataFrame, s: Settings) -> DataFrame:
    """doc_id, content, n_bytes, suffixes of rows (doc_id, content, text as bytes). lead: from the first window to the anchor."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, digest = Anchors(s), xxhash.xxh3_64_intdigest
        for batch in batches:
            data, view, offsets = _texts(batch.column(2))
            at, start, windows = anchors(data, offsets) if len(batch) else (np.empty(0, np.int64),) * 3
            key = _longs([digest(view[a : a + s.head]) for a in at.tolist()])
            block = _longs([digest(view[a:b]) for a, b in zip(start.tolist(), (start + windows + s.length - 1).tolist(), strict=True)])
            ends = np.searchsorted(start, offsets).astype(np.int32)
            of = np.repeat(offsets[:-1], np.diff(ends))
            fields = {"key": key, "block": block, "start": (start - of).astype(np.int32), "windows": windows.astype(np.int32), "lead": (at - start).astype(np.int32)}
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(x) for x in fields.values()], list(fields)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(offsets)), lists], ["doc_id", "content", "n_bytes", "suffixes"])

    return docs.mapInArrow(rows, "doc_id long, content binary, n_bytes long, suffixes array<struct<key: bigint, block: bigint, start: int, windows: int, lead: int>>")


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, block, n, is_new) in order to those that are settled or open, and the first and last one (part: which task's)."""
    part, held, is_first = TaskContext.get().partitionId(), None, True
    names = ["key", "block", "n", "is_new", "is_settled", "is_open", "part"]

    def out(key, block, n, new, settled, is_open, edge):
        use = np.flatnonzero(settled | is_open | edge)
        columns = [key, block, n, new, settled, is_open]
        return pa.RecordBatch.from_arrays([*(pa.array(c[use]) for c in columns), pa.array(np.where(edge[use], part, -1), pa.int32())], names)

    for batch in batches:
        if not len(batch):
            continue
        key, block, n, new = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        settled, is_open, edge = (n > 1) & new, np.zeros(len(key), bool), np.zeros(len(key), bool)
        edge[0] = is_first
        if held is not None:
            key, block, n, new, settled, is_open, edge = (np.concatenate([a, b]) for a, b in zip(held, (key, block, n, new, settled, is_open, edge), strict=True))
        is_first = False
        meet = (key[1:] == key[:-1]) & (new[1:] | new[:-1])
        for flag, pair in ((settled, meet & (block[1:] == block[:-1])), (is_open, meet & (block[1:] != block[:-1]))):
            flag[1:] |= pair
            flag[:-1] |= pair
        every = (key, block, n, new, settled, is_open, edge)
        held = tuple(x[-1:].copy() for x in every)
        yield out(*(x[:-1] for x in every))
    if held is not None:
        held[-1][:] = True
        yield out(*held)


class SuffixFamily:
    """Levels of suffix arrays in the work folder: add() a batch of suffixes, and get what meets in it or in older levels."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.levels: list[tuple[int, str]] = []

    def _sorted(self, rows: DataFrame) -> str:
        path = work_folder(self.spark, "suffix-array")
        arrays = rows.groupBy("key", "block").agg(F.sum("n").alias("n"))  # copies meet before the shuffle
        arrays.orderBy("key", "block").write.option("compression", "zstd").parquet(path)
        return path

    def _read(self, path: str) -> DataFrame:
        return self.spark.read.schema("key long, block long, n long").parquet(path)

    def add(self, batch: DataFrame) -> DataFrame:
        """key, block, n, is_settled, is_open of entries that batch (key, block) brings together, in the batch or in a level."""
        self._merge()
        new = self._sorted(batch.select("key", "block", F.lit(1).alias("n")))
        every = self._read(new).withColumn("is_new", F.lit(True))
        for _, path in self.levels:
            every = every.unionByName(self._read(path).withColumn("is_new", F.lit(False)))
        ordered = every.repartitionByRange("key", "block").sortWithinPartitions("key", "block")
        schema = "key long, block long, n long, is_new boolean, is_settled boolean, is_open boolean, part int"
        met = stored(ordered.mapInArrow(_neighbours, schema), "neighbours")
        # a key may go on in the next range: the first and last rows of the ranges, two a task, are compared here
        edges = Window.partitionBy(F.lit(0)).orderBy("part", "key", "block")
        same = lambda f: (f("key").over(edges) == F.col("key")) & (f("part").over(edges) != F.col("part")) & (F.col("is_new") | f("is_new").over(edges))
        across = met.where("part >= 0").withColumn("is_open", F.col("is_open") | F.coalesce(same(F.lag), F.lit(False)) | F.coalesce(same(F.lead), F.lit(False)))
        self.levels.append((0, new))
        found = met.where("part < 0").unionByName(across).where("is_settled OR is_open")
        return found.select("key", "block", "n", "is_settled", "is_open")

    def _merge(self) -> None:
        """Merges the last levels, as long as two have one rank: done before a batch is added, so the last one waits."""
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (rank, a), (_, b) = self.levels.pop(), self.levels.pop()
            self.levels.append((rank + 1, self._sorted(self._read(a).unionByName(self._read(b)))))
            remove(self.spark, a)
            remove(self.spark, b)

    def drop(self) -> None:
        for _, path in self.levels:
            remove(self.spark, path)
        self.levels = []


def _pieces(s: Settings):
    """Rows (row, text, suffixes: list of (key, start, windows, lead, is_asked)) to one for each piece: row, key (fingerprint of
    key, place and what all windows of the piece share), whole (of all bytes), start, windows, is_asked."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, before = xxhash.xxh3_64_intdigest, s.length - s.head
        for batch in batches:
            _, view, offsets = _texts(batch.column(1))
            out: tuple[list, ...] = ([], [], [], [], [], [])
            for row, base, found in zip(batch.column(0).to_pylist(), offsets[:-1].tolist(), batch.column(2).to_pylist(), strict=True):
                for x in found:
                    first = x["start"] + x["lead"] - before  # where the first window of a full block would start
                    at, end = x["start"], x["start"] + x["windows"]
                    while at < end:
                        k = (at - first) // s.piece
                        to = min(end, first + (k + 1) * s.piece)
                        shared = view[base + first + (k + 1) * s.piece - 1 : base + first + k * s.piece + s.length]
                        of = (row, digest(shared, (x["key"] + k) & _M64), digest(view[base + at : base + to - 1 + s.length]), at, to - at, x["is_asked"])
                        for column, value in zip(out, of, strict=True):
                            column.append(value)
                        at = to
            row, key, whole, start, windows, asked = out
            columns = [pa.array(row, pa.int64()), pa.array(_longs(key)), pa.array(_longs(whole)), pa.array(start, pa.int32()), pa.array(windows, pa.int32()), pa.array(asked, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, ["row", "key", "whole", "start", "windows", "is_asked"])

    return rows


def _windows(s: Settings):
    """Rows (row, text, suffixes: list of (key, start, windows, is_asked)) to one for each window: row, key, hash, at, is_asked."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            _, view, offsets = _texts(batch.column(1))
            out: list[tuple[int, int, int, int, bool]] = []
            hashes: list[int] = []
            for row, base, found in zip(batch.column(0).to_pylist(), offsets[:-1].tolist(), batch.column(2).to_pylist(), strict=True):
                for x in found:
                    at = range(base + x["start"], base + x["start"] + x["windows"])
                    hashes += [digest(view[i : i + s.length]) for i in at]
                    out.append((row, x["key"], x["start"], x["windows"], x["is_asked"]))
            row, key, start, n, asked = (np.array(c) for c in zip(*out, strict=True)) if out else (np.empty(0, np.int64),) * 5
            place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            columns = [np.repeat(row, n), np.repeat(key, n), _longs(hashes), (np.repeat(start, n) + place).astype(np.int32), np.repeat(asked, n).astype(bool)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["row", "key", "hash", "at", "is_asked"])

    return rows


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (row, text, spans: list of (start, stop)) to row, n_removed, n_spans, kept_sha256."""
    for batch in batches:
        _, view, offsets = _texts(batch.column(1))
        removed, runs, digests = [], [], []
        for base, end, spans in zip(offsets[:-1].tolist(), offsets[1:].tolist(), batch.column(2), strict=True):
            start, stop = (np.sort(spans.values.field(i).to_numpy(zero_copy_only=False)) for i in range(2))
            # with starts and stops each in order, a run ends where the next start lies beyond the stop of the same rank
            gap = np.flatnonzero(start[1:] > stop[:-1])
            first, last = np.concatenate([start[:1], start[gap + 1]]), np.concatenate([stop[gap], stop[-1:]])
            left, at = hashlib.sha256(), base
            for a, b in zip(first.tolist(), last.tolist(), strict=True):
                left.update(view[at : base + a])
                at = base + b
            left.update(view[at:end])
            removed.append(int((last - first).sum()))
            runs.append(len(first))
            digests.append(left.hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(digests, pa.string())], ["row", "n_removed", "n_spans", "kept_sha256"])


def _joined(left: DataFrame, right: DataFrame, keys: list[str], how: str, sizes: str, rows: int) -> DataFrame:
    """left with right, which has one row a key: right broadcast if it is small, else hot keys dealt to several tasks."""
    n = right.count()
    if n <= BROADCAST_ROWS:
        return left.join(small_side(right.drop(sizes), n), keys, how)
    return spread_join(left, right.drop(sizes), keys, how, hot_keys(right, keys, sizes, rows), "row")


def remove_repeats(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row: what is left of its text, in UTF-8, without the bytes that
    a string of `length` bytes covers which starts anywhere else too, in this text or in another row's.

    Strings are judged on the input. Null text counts as empty; rows that repeat, and rows without an id, are texts of
    their own, and so lose all bytes if there are `length` of them; texts are read whole; an empty table gives
    no rows; other columns are not read.
    """
    s, spark = settings, docs.sparkSession
    content = F.unhex(F.sha2("text", 256))
    rows = id_and_text(docs, id_col, text_col)
    found = suffixes(rows.select("doc_id", content.alias("content"), F.col("text").cast("binary").alias("text")), s)
    # numbers and batches are written, and so stay as they are
    every = stored(found.withColumn("row", F.monotonically_increasing_id()).withColumn("batch", F.pmod(F.xxhash64("content"), F.lit(s.batches)).cast("int")), "suffixes", ["batch"])
    n_rows = every.count()
    copies = stored(every.groupBy("content").agg(F.min("row").alias("node"), F.count("*").alias("copies")).where("copies > 1"), "copies")
    light = _joined(every.select("row", "doc_id", "content", "n_bytes"), copies, ["content"], "left", "copies", n_rows)
    whole = F.col("node").isNotNull() & (F.col("n_bytes") >= s.length)  # goes whole: its copies have every string of it
    nodes = _joined(every, copies, ["content"], "left", "copies", n_rows).where("node IS NULL OR node = row")
    entries = nodes.select("row", "batch", whole.alias("is_whole"), F.inline("suffixes"))

    family, met = SuffixFamily(spark), []
    for batch in range(s.batches):
        met.append(family.add(entries.where(F.col("batch") == batch).select("key", "block")))
    marks = met[0]
    for more in met[1:]:
        marks = marks.unionByName(more)
    marks = stored(marks.groupBy("key", "block").agg(F.sum("n").alias("n"), F.max("is_settled").alias("is_settled"), F.max("is_open").alias("is_open")), "marks")
    family.drop()
    marked = stored(spread_join(entries.drop("batch"), marks.drop("n"), ["key", "block"], hot=hot_keys(marks, ["key", "block"], "n", n_rows), by="row"), "marked")
    span = lambda start, stop: F.struct(start.alias("start"), stop.alias("stop"))
    settled = marked.where("is_settled AND NOT is_whole").select("row", span(F.col("start"), F.col("start") + F.col("windows") + (s.length - 1)).alias("span"))

    # open blocks: those that are alone ask, and one row of each of the others answers
    suffix = ["row", "start", "windows", "lead"]
    asked = marked.where("is_open AND NOT is_settled").select("key", *suffix, (~F.col("is_whole")).alias("is_asked"))
    others = marked.where("is_open AND is_settled").groupBy("key", "block").agg(F.min(F.struct(*suffix)).alias("x")).select("key", "x.*", F.lit(False).alias("is_asked"))
    lists = lambda df, *more: df.groupBy("row").agg(F.collect_list(F.struct("key", "start", "windows", *more, "is_asked")).alias("suffixes"))
    open_suffixes = stored(lists(asked.unionByName(others), "lead"), "open-suffixes")
    needed = stored(settled.select("row").unionByName(open_suffixes.select("row")).distinct().join(every.select("row", "content"), "row"), "needed-texts")
    hashed = rows.select(content.alias("content"), F.col("text").cast("binary").alias("text"))
    texts = stored(hashed.join(small_side(needed), "content").groupBy("row").agg(F.first("text").alias("text")), "texts")

    of_text = lambda df: texts.join(df, "row").select("row", "text", "suffixes")
    pieces = stored(of_text(open_suffixes).mapInArrow(_pieces(s), "row long, key long, whole long, start int, windows int, is_asked boolean"), "pieces")
    kinds = stored(pieces.groupBy("key", "whole").agg(F.count("*").alias("n"), F.min(F.struct("row", "start", "windows", "is_asked")).alias("x")), "kinds-of-pieces")
    again = kinds.where("n > 1").select("key", "whole", "n")
    settled_pieces = spread_join(pieces.where("is_asked"), again.drop("n"), ["key", "whole"], hot=hot_keys(again, ["key", "whole"], "n", n_rows), by="row")
    several = stored(kinds.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "open-pieces")
    alone = F.col("x.is_asked") & (F.col("n") == 1)
    open_pieces = spread_join(kinds, several.drop("n"), ["key"], hot=hot_keys(several, ["key"], "n", n_rows), by="whole").select("key", "x.row", "x.start", "x.windows", alone.alias("is_asked"))
    windows = stored(of_text(lists(open_pieces)).mapInArrow(_windows(s), "row long, key long, hash long, at int, is_asked boolean"), "windows")
    again = stored(windows.groupBy("key", "hash").agg(F.count("*").alias("n")).where("n > 1"), "repeated-windows")
    repeated = spread_join(windows.where("is_asked"), again.drop("n"), ["key", "hash"], hot=hot_keys(again, ["key", "hash"], "n", n_rows), by="row")

    spans = settled.unionByName(settled_pieces.select("row", span(F.col("start"), F.col("start") + F.col("windows") + (s.length - 1)).alias("span")))
    spans = spans.unionByName(repeated.select("row", span(F.col("at"), F.col("at") + s.length).alias("span"))).groupBy("row").agg(F.collect_list("span").alias("spans"))
    parts = texts.join(spans, "row").select("row", "text", "spans").mapInArrow(_without, "row long, n_removed long, n_spans long, kept_sha256 string")

    long = lambda x, part: F.when(whole, x).otherwise(F.coalesce(part, F.lit(0))).cast("long")
    kept = F.when(whole, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("content"))))
    return light.join(parts, "row", "left").select("doc_id", "n_bytes", long(F.col("n_bytes"), "n_removed").alias("n_removed"), long(F.lit(1), "n_spans").alias("n_spans"), kept.alias("kept_sha256"))
