"""Near-duplicates by min-max hashing: each permutation gives two values, the least and the greatest hash of the set.

Either agrees for two sets with a probability of their Jaccard similarity, so half as many permutations fill a
signature. Texts with equal sets are one node. Nodes meet in bands; in each bucket they are compared with two
leaders, and what these leave in different components is compared in blocks. Every link is confirmed on the full
sets; a block counts shared shingles itself and gives only links that join components, never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievegrid.llm.common import fresh, hot_keys, id_and_text, settled, small_side, spread_join, stored
from sievegrid.llm.graph import components

_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


@dataclass(frozen=True)
class Settings:
    """words per shingle; percent: least similarity of a link, in hundredths; bands of 2 * half values, of `half` least and
    `half` greatest hashes. With 24 bands of 6 a pair at 0.85 is missed once in 80,000, at 0.8 once in 1,500.
    block, block_shingles: rows and shingles that one side of a block of a bucket has on average, at most."""

    words: int = 5
    percent: int = 80
    bands: int = 30
    half: int = 3
    block: int = 512
    block_shingles: int = 1_000_000
    seed: int = 1


def shingles(text: str, words: int) -> np.ndarray:
    """64-bit hashes of the distinct runs of words, ascending; of the whole sequence if it is shorter; none without words."""
    found = text.encode().lower().split()  # bytes: A-Z alone are lowered, and the six ASCII white space characters split
    if not found:
        return np.empty(0, np.uint64)
    if len(found) < words:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(found), 1)], np.uint64)
    hashes = np.array(list(map(xxhash.xxh3_64_intdigest, found)), np.uint64)
    n = len(found) - words + 1
    out = hashes[:n].copy()
    for k in range(1, words):
        out = out * _ODD[0] + hashes[k : k + n]
        out ^= out >> np.uint64(29)
    return np.unique(out * _ODD[1])


class MinMax:
    def __init__(self, permutations: int, seed: int):
        random = np.random.default_rng(seed)
        self.times = random.integers(0, 1 << 32, (permutations, 1), np.uint32) | np.uint32(1)
        self.xor = random.integers(0, 1 << 32, (permutations, 1), np.uint32)

    def __call__(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        short = ((found * _ODD[2]) >> np.uint64(32)).astype(np.uint32)
        least = greatest = None
        for at in range(0, len(short), 2048):  # stays in the cache of a core
            values = (short[at : at + 2048] ^ self.xor) * self.times
            low, high = values.min(1), values.max(1)
            least, greatest = (low, high) if least is None else (np.minimum(least, low), np.maximum(greatest, high))
        return least, greatest


def band_keys(found: np.ndarray, hashing: MinMax, s: Settings) -> list[int]:
    least, greatest = hashing(found)
    rows = np.hstack([least.reshape(s.bands, s.half), np.roll(greatest.reshape(s.bands, s.half), 1, axis=0)])
    return [xxhash.xxh3_64_intdigest(row.tobytes(), n) - (1 << 63) for n, row in enumerate(rows)]


def signatures(docs: DataFrame, s: Settings) -> DataFrame:
    """doc_id, n_shingles, digest of the set, band keys."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashing = MinMax(s.bands * s.half, s.seed)
        for batch in batches:
            n, digests, keys = [], [], []
            for text in batch.column(1).to_pylist():
                found = shingles(text, s.words)
                n.append(len(found))
                digests.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
                keys.append(band_keys(found, hashing, s) if len(found) else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "digest", "bands"])

    return docs.mapInArrow(rows, "doc_id long, n_shingles long, digest binary, bands array<long>")


def full_sets(docs: DataFrame, s: Settings) -> DataFrame:
    """node, set (array of hashes) of the rows of docs that have words."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t, s.words) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))], ["node", "set"])

    return docs.mapInArrow(rows, "node long, set array<long>").where(F.size("set") > 0)


def linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    side = lambda c: sets.select(F.col("node").alias(c), F.col("set").alias(f"set_{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    shared = F.size(F.array_intersect("set_a", "set_b"))
    return both.where(100 * shared >= percent * (F.size("set_a") + F.size("set_b") - shared)).select("a", "b")


def _shared(one: np.ndarray, values: np.ndarray, owners: np.ndarray, n: int) -> np.ndarray:
    """Of a set, how many values it shares with each of n others; values: those of all others, ascending; owners: whose."""
    low, high = np.searchsorted(values, one, "left"), np.searchsorted(values, one, "right")
    many = high - low
    at = np.arange(many.sum()) + np.repeat(low - np.cumsum(many) + many, many)
    return np.bincount(owners[at], minlength=n)


def _blocks(s: Settings):
    """Links, from rows (key, left, right, is_left, node, component, minor, set) in order of block: of each block no more
    than it takes to join the components that are linked."""

    def of_block(x: pd.DataFrame) -> pd.DataFrame:
        one, other = x[x["is_left"]], x[~x["is_left"]]
        out: list[tuple[int, int]] = []
        if len(one) and len(other):
            node, minor, sets = (other[c].to_numpy() for c in ("node", "minor", "set"))
            size = np.array([len(v) for v in sets])
            values, owners = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
            order = np.argsort(values, kind="stable")
            values, owners = values[order], owners[order]
            code = np.unique(np.concatenate([one["component"], other["component"]]), return_inverse=True)[1]
            joined = np.arange(code.max() + 1)  # components that a link of this block has joined have one number
            for r_node, r_set, r_code in zip(one["node"], one["set"], code[: len(one)], strict=True):
                n, theirs = len(r_set), joined[code[len(one) :]]
                fits = (theirs != joined[r_code]) & (100 * np.minimum(size, n) >= s.percent * np.maximum(size, n)) & (~minor | (node > r_node))
                if fits.any():
                    shared = _shared(r_set, values, owners, len(sets))
                    at = np.flatnonzero(fits & (100 * shared >= s.percent * (size + n - shared)))
                    new, first = np.unique(theirs[at], return_index=True)
                    out += [(min(r_node, m), max(r_node, m)) for m in node[at[first]]]
                    joined[np.isin(joined, new)] = joined[r_code]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None  # the last block of a batch may go on in the next
        for batch in batches:
            batch = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            change = np.flatnonzero((batch[["key", "left", "right"]].diff().iloc[1:] != 0).any(axis=1).to_numpy()) + 1
            cuts = [0, *change.tolist(), len(batch)]
            found = [of_block(batch.iloc[a:b]) for a, b in zip(cuts[:-2], cuts[1:-1], strict=True)]
            if found:
                yield pd.concat(found, ignore_index=True)
            rest = batch.iloc[cuts[-2] :] if len(batch) else None
        if rest is not None:
            yield of_block(rest)

    return rows


def link(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row.

    component_id is the smallest id that links lead to; kept: it is the row's own. Null text and texts without words have
    no shingles and are linked with nothing. Rows that repeat an id count as one document: equal or not, they share
    a component. Rows without an id are linked with nothing, have a null component and are kept. Very long texts are
    read whole: their sets of shingles are compared whole. An empty table gives no rows; other columns are not read.
    The rows are stored; the tables that led to them (signatures, buckets, sets) are deleted before they are returned.
    """
    return settled(docs.sparkSession, lambda: _linked_rows(id_and_text(docs, id_col, text_col), settings), "components")


def _linked_rows(rows: DataFrame, s: Settings) -> DataFrame:
    every = stored(signatures(rows, s), "signatures")
    known = every.where("n_shingles > 0 AND doc_id IS NOT NULL")
    nodes = stored(known.groupBy("digest").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.count("*").alias("copies")), "nodes")
    of_copies = hot_keys(nodes, ["digest"], "copies", nodes.agg(F.sum("copies")).first()[0] or 0)  # texts with many copies are split in joins

    each = nodes.select("node", "n", F.explode("bands").alias("key"))
    sizes = stored(each.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "bucket-sizes")
    hot = hot_keys(sizes, ["key"], "size", sizes.agg(F.sum("size")).first()[0] or 0)  # large buckets are split in joins
    members = stored(spread_join(each, sizes, ["key"], hot=hot, by="node"), "members")
    # leaders of a bucket: the node that most others meet in all its buckets, and one by chance
    central = members.groupBy("node").agg((-F.sum("size")).alias("order"))
    ordered = stored(members.join(central, "node").drop("size"), "members")
    leader = lambda order: F.min(F.struct(order.alias("o"), F.col("node").alias("node"), F.col("n").alias("n")))
    leaders = ordered.groupBy("key").agg(leader(F.col("order")).alias("hub"), leader(F.xxhash64("node", "key")).alias("any"), F.count("*").alias("size"))
    fits = lambda a, b: 100 * F.least(a, b) >= s.percent * F.greatest(a, b)
    met = spread_join(ordered, leaders, ["key"], hot=hot, by="node").select("node", "n", F.explode(F.array("hub", "any")).alias("l")).where((F.col("node") != F.col("l.node")) & fits(F.col("n"), F.col("l.n")))
    pairs = met.select(F.least("node", "l.node").alias("a"), F.greatest("node", "l.node").alias("b")).distinct()

    candidates = stored(ordered.select(F.col("node").alias("doc_id")).distinct(), "candidates")
    sets = stored(full_sets(rows.join(small_side(candidates), "doc_id", "left_semi"), s), "sets")
    links = stored(linked(pairs, sets, s.percent), "links")
    # rows that repeat an id, with whatever texts, are one document: it links the nodes of these texts
    repeated = stored(every.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated-ids")
    ids_repeat = not repeated.isEmpty()
    if ids_repeat:
        texts = every.join(small_side(repeated), "doc_id", "left_semi").select("doc_id", "digest").distinct()
        same = spread_join(texts.where("digest IS NOT NULL"), nodes.select("digest", "node"), ["digest"], hot=of_copies, by="doc_id")
        links = links.unionByName(same.select(F.col("node").alias("a"), F.col("doc_id").alias("b")))
    first = components(links)

    # the rest: members of a bucket outside the component of its hub, against all members of other components
    labelled = ordered.join(first, "node", "left").select("key", "node", "n", F.coalesce("component", "node").alias("component"))
    hubs = leaders.select("key", F.col("hub.node").alias("node")).join(first, "node", "left").select("key", F.coalesce("component", "node").alias("hub"))
    marked = stored(spread_join(labelled, hubs, ["key"], hot=hot, by="node").withColumn("minor", F.col("component") != F.col("hub")).drop("hub"), "marked")
    blocks = lambda of: F.ceil(F.greatest(F.sum(of) / s.block, F.sum(of * F.col("n")) / s.block_shingles)).cast("int")
    minor = F.col("minor").cast("int")
    open_ = marked.groupBy("key").agg(blocks(minor).alias("minor_blocks"), blocks(F.lit(1)).alias("all_blocks")).where("minor_blocks > 0")
    rest = spread_join(marked, open_, ["key"], hot=hot, by="node").groupBy("key", "node").agg(*[F.first(c).alias(c) for c in ("component", "minor", "minor_blocks", "all_blocks")])
    part = lambda blocks: F.pmod(F.xxhash64("node"), blocks).cast("int")
    through = lambda blocks: F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))
    left = rest.where("minor").select("key", part("minor_blocks").alias("left"), through("all_blocks").alias("right"), F.lit(True).alias("is_left"), "node", "component", "minor")
    right = rest.select("key", through("minor_blocks").alias("left"), part("all_blocks").alias("right"), F.lit(False).alias("is_left"), "node", "component", "minor")
    block_rows = left.unionByName(right).join(sets, "node").select("key", "left", "right", "is_left", "node", "component", "minor", "set")
    more = block_rows.repartition("key", "left", "right").sortWithinPartitions("key", "left", "right").mapInPandas(_blocks(s), "a long, b long")
    # links that the leaders have settled join equal components and so don't come again
    more_links = stored(more.distinct(), "links")
    joined = components(links.unionByName(more_links)) if not more_links.isEmpty() else first

    classes = nodes.select("digest", "node").join(joined, "node", "left").select("digest", F.coalesce("component", "node").alias("component"))
    # rows without words have no node, and take no part in the join
    light = every.select("doc_id", "n_shingles", "digest")
    wordless = light.where("digest IS NULL").withColumn("component", F.lit(None).cast("long"))
    found = spread_join(light.where("digest IS NOT NULL"), classes, ["digest"], "left", of_copies, "doc_id").unionByName(wordless)
    if ids_repeat:  # rows without words have no node: they follow the rows with words that have their id
        of_ids = stored(joined.join(repeated, joined["node"] == repeated["doc_id"]).select("doc_id", F.col("component").alias("of_id")), "of-ids")
        found = found.join(small_side(of_ids), "doc_id", "left").withColumn("component", F.coalesce("component", "of_id"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of near-duplicate texts, with all its columns: that of the smallest id, and of rows that
    repeat this id the one whose text comes first. Rows without an id all stay, as do those without words, one an id.

    Where ids repeat, rows take the place of ids: an id that has several texts must not take one of them along when
    another one goes.
    """
    doc_id = F.col(id_col).cast("long")
    row, gone_, id_, first_ = fresh(docs, "_row", "_gone", "_id", "_first")
    if docs.where(doc_id.isNotNull()).groupBy(doc_id).count().where("count > 1").isEmpty():
        found = link(docs, settings, id_col, text_col)
        gone = found.where(~F.col("kept")).select(F.col("doc_id").alias(gone_))
        return docs.join(small_side(gone), doc_id == F.col(gone_), "left_anti")
    rows = stored(docs.where(doc_id.isNotNull()).orderBy(doc_id, text_col).withColumn(row, F.monotonically_increasing_id()), "rows")
    found = link(rows, settings, row, text_col)
    wordless = found.where("n_shingles = 0").select(F.col("doc_id").alias(row)).join(rows.select(row, doc_id.alias(id_)), row)
    first = wordless.groupBy(id_).agg(F.min(row).alias(first_))
    again = wordless.join(first, id_).where(F.col(row) > F.col(first_)).select(row)
    gone = stored(found.where(~F.col("kept")).select(F.col("doc_id").alias(row)).unionByName(again), "gone")
    return rows.join(small_side(gone), row, "left_anti").select(*docs.columns).unionByName(docs.where(doc_id.isNull()))
