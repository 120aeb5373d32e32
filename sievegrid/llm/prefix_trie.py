"""The trie of all beginnings of conversations: what a cache of prefixes would share.

A beginning of d turns has a polynomial rolling fingerprint: the sum of its turns' digests times powers of a base, modulo two
primes. Numpy scans sum it up along the conversations; these lie in ranges, so a conversation may go on in the next
range, and what it brought along from the ranges before is added afterwards. Equal fingerprints of one depth are a
candidate group; its members are compared by turn and by the group of the beginning one turn shorter with the
member of the smallest id, and split where they differ, until no group has two kinds: then each group is one node.
Sums over subtrees go up by doubling: in round k a node takes over what its descendants at a distance of 2^k have so far.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievegrid.llm.common import hot_keys, small_side, spread_join, stored, text_or_empty

_NOTHING = hashlib.sha256().hexdigest()


@dataclass(frozen=True)
class Settings:
    """primes under 2^31, and a base for each: some 62 bits of fingerprint. Small ones make groups collide: then these are split."""

    primes: tuple[int, int] = (2147483647, 2147483629)
    bases: tuple[int, int] = (1103515245, 69069069)


def turns_of(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv, at (from 0), digest (SHA-256 of role and text), n_bytes (of the text) of every turn.

    In order of turn (null first), then role, then the SHA-256 of the text. Null role and text count as empty; turns without a
    conversation are left out; repeated rows are turns each.
    """
    text, role = text_or_empty(text_col), text_or_empty(role_col)
    digest = F.unhex(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = conversations.select(F.col(id_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"), role.alias("role"), digest.alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"), F.unhex(F.sha2(text, 256)).alias("text_digest"))
    keys = ["conv", F.asc_nulls_first("turn"), "role", "text_digest"]
    ordered = rows.where("conv IS NOT NULL").repartitionByRange(*keys).sortWithinPartitions(*keys).select("conv", "digest", "n_bytes")
    local = stored(ordered.mapInArrow(_numbers, "conv long, digest binary, n_bytes long, at long, part int"), "numbered")
    ends = local.groupBy("conv", "part").agg((F.max("at") + 1).alias("carry"))
    return stored(_carried(local, ends, ["carry"]).withColumn("at", F.col("at") + F.col("carry")).drop("carry", "part"), "turns")


def _carried(local: DataFrame, ends: DataFrame, sums: list[str]) -> DataFrame:
    """local (conv, part and more) with what each conversation's earlier parts sum up to. ends: conv, part, sums of each part.

    Of conversations in one part nothing is carried; the others have at most two rows a part: one for its begin, one for its end.
    """
    parts = Window.partitionBy("conv")
    before = parts.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    several = ends.withColumn("parts", F.count("*").over(parts)).where("parts > 1")
    several = stored(several.select("conv", "part", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in sums]), "carried")
    joined = local.join(small_side(several), ["conv", "part"], "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(0)) for c in sums})


def _starts(conv: np.ndarray) -> np.ndarray:
    """Of each row, the first row of its conversation in the batch."""
    first = np.flatnonzero(np.diff(conv, prepend=conv[0] - 1))
    return np.repeat(first, np.diff(first, append=len(conv)))


def _numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the place of a turn in its conversation, counted in this task."""
    part, last, n = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        if len(batch):
            conv = batch.column(0).to_numpy()
            start = _starts(conv)
            at = np.arange(len(conv)) - start + np.where((start == 0) & (conv == last), n, 0)
            last, n = conv[-1], at[-1] + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int64()), pa.array(np.full(len(conv), part, np.int32))], ["conv", "digest", "n_bytes", "at", "part"])


def _powers(base: int, exponents: np.ndarray, prime: int) -> np.ndarray:
    out, base, exponents = np.ones(len(exponents), np.int64), base % prime, exponents.copy()
    while exponents.any():
        out = np.where(exponents & 1, out * base % prime, out)
        base, exponents = base * base % prime, exponents >> 1
    return out


def _scan(s: Settings):
    """Rows (conv, depth, digest, n_bytes) in order, with term and sum of the fingerprint for either prime, summed in this task."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, carry = TaskContext.get().partitionId(), None, [0, 0]
        for batch in batches:
            if not len(batch):
                continue
            conv, depth = (batch.column(i).to_numpy() for i in range(2))
            digest = np.frombuffer(b"".join(x[:8] for x in batch.column(2).to_pylist()), np.uint64)
            start, columns = _starts(conv), []
            for k, (prime, base) in enumerate(zip(s.primes, s.bases, strict=True)):
                term = (digest % np.uint64(prime)).astype(np.int64) * _powers(base, depth, prime) % prime
                sums = np.cumsum(term)
                whole = (sums - sums[start] + term[start] + np.where((start == 0) & (conv == last), carry[k], 0)) % prime
                carry[k] = int(whole[-1])
                columns += [pa.array(term), pa.array(whole)]
            last = conv[-1]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns, pa.array(np.full(len(conv), part, np.int32))], ["conv", "depth", "digest", "n_bytes", "t1", "f1", "t2", "f2", "part"])

    return rows


def _beginnings(turns: DataFrame, s: Settings) -> DataFrame:
    """conv, depth, id, parent, digest, n_bytes: id is the fingerprint of the beginning that the turn ends, parent that of one less."""
    ordered = turns.select("conv", F.col("depth").cast("long").alias("depth"), "digest", "n_bytes").repartitionByRange("conv", "depth").sortWithinPartitions("conv", "depth")
    local = stored(ordered.mapInArrow(_scan(s), "conv long, depth long, digest binary, n_bytes long, t1 long, f1 long, t2 long, f2 long, part int"), "fingerprints")
    ends = local.groupBy("conv", "part").agg(F.max_by("f1", "depth").alias("c1"), F.max_by("f2", "depth").alias("c2"))
    found = _carried(local, ends, ["c1", "c2"])
    both = lambda one, two: F.shiftleft(F.pmod(one, F.lit(s.primes[0])), 32) + F.pmod(two, F.lit(s.primes[1]))
    f1, f2 = F.col("f1") + F.col("c1"), F.col("f2") + F.col("c2")
    return found.select("conv", "depth", both(f1, f2).alias("id"), both(f1 - F.col("t1"), f2 - F.col("t2")).alias("parent"), "digest", "n_bytes")


def _kinds(turns: DataFrame) -> DataFrame:
    """The kinds of beginnings in each group: members that agree in the turn and in the parent's group fold together."""
    return stored(turns.groupBy("depth", "id", "parent", "digest").agg(F.min("conv").alias("first"), F.count("*").alias("n_convs"), F.max("n_bytes").alias("n_bytes")), "kinds")


def _verified(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """turns and their kinds, of which no group has two any more: where one has, each kind becomes a group, and so again with
    the beginnings that are a turn longer."""
    while True:
        kinds = _kinds(turns)
        if kinds.groupBy("depth", "id").count().where("count > 1").isEmpty():
            return turns, kinds
        keys = ["depth", "id", "parent", "digest"]
        split = stored(spread_join(turns, kinds.select(*keys, "first"), keys, hot=hot_keys(kinds, keys, "n_convs", turns.count()), by="conv"), "split-groups")
        above = split.select("conv", (F.col("depth") + 1).alias("depth"), F.col("first").alias("above"))
        renamed = split.join(above, ["conv", "depth"], "left")  # the root is one group
        turns = stored(renamed.select("conv", "depth", F.col("first").alias("id"), F.coalesce("above", F.lit(0)).alias("parent"), "digest", "n_bytes"), "split-groups")


def _id_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (depth, id, conv) in order to depth, id and the SHA-256 of the conversations' ids, as text with commas.

    Such a digest is made in one order, so one task makes it; ids go through it and aren't kept.
    """
    node, digest = None, hashlib.sha256()
    names = ["depth", "id", "ends_sha256"]
    for batch in batches:
        done: list[tuple[int, int, str]] = []
        for depth, of, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (depth, of) == node:
                digest.update(b",")
            else:
                if node is not None:
                    done.append((*node, digest.hexdigest()))
                node, digest = (depth, of), hashlib.sha256()
            digest.update(str(conv).encode())
        yield pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in done], pa.schema([("depth", pa.int64()), ("id", pa.int64()), ("ends_sha256", pa.string())]))
    if node is not None:
        yield pa.RecordBatch.from_pylist([dict(zip(names, (*node, digest.hexdigest()), strict=True))], pa.schema([("depth", pa.int64()), ("id", pa.int64()), ("ends_sha256", pa.string())]))


def _rolled_up(nodes: DataFrame, sums: list[str]) -> DataFrame:
    """depth, id and sums over the subtree of each of nodes (depth, id, parent, sums).

    In round k the ancestor `far` of a node is 2^k turns shorter; there are as many rounds as the greatest depth has bits.
    """
    every, step = stored(nodes.select("depth", "id", F.col("parent").alias("far"), *sums), "rollup"), 1
    depth = every.agg(F.max("depth")).first()[0] or 0
    while step <= depth:
        up = every.where(F.col("depth") >= step).groupBy((F.col("depth") - step).alias("depth"), F.col("far").alias("id"))
        more = stored(up.agg(F.count("*").alias("n"), *[F.sum(c).alias(f"_{c}") for c in sums]), "rollup-sums")
        grown = every.join(more.drop("n"), ["depth", "id"], "left").select("depth", "id", "far", *[(F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in sums])
        upper = every.select((F.col("depth") + step).alias("depth"), F.col("id").alias("far"), F.col("far").alias("farther"))
        hot = hot_keys(more.withColumns({"far": F.col("id"), "depth": F.col("depth") + step}), ["depth", "far"], "n", every.count()) if step * 2 <= depth else None
        moved = spread_join(grown, upper.where(F.col("depth") >= 2 * step), ["depth", "far"], "left", hot, "id") if step * 2 <= depth else grown.withColumn("farther", F.lit(None).cast("long"))
        every = stored(moved.select("depth", "id", F.col("farther").alias("far"), *sums), "rollup")
        step *= 2
    return every.drop("far")


def build(turns: DataFrame, conversations: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node.

    turns: conv, depth (1, 2, ... without gaps), digest, n_bytes; conversations: conv, every one, also those without turns. A node
    is named by the smallest of the conversations that begin like this; the root, of depth 0, is the beginning without turns.
    saved_tokens: over the subtree, the bytes of each node's last turn times its conversations but one. Without
    conversations there are no rows.
    """
    convs = stored(conversations.select("conv").distinct(), "conversations")
    turns, kinds = _verified(stored(_beginnings(turns, settings), "beginnings"))
    root = convs.agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    root = root.select(F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("id"), F.lit(None).cast("long").alias("parent"), "conv_id", "n_convs", F.lit(0).cast("long").alias("n_bytes"))
    nodes = stored(kinds.select("depth", "id", "parent", F.col("first").alias("conv_id"), "n_convs", "n_bytes").unionByName(root), "nodes")

    below = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("parent").alias("id")).agg(F.count("*").alias("n_children"))
    nodes = stored(nodes.join(below, ["depth", "id"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "nodes")
    sums = _rolled_up(nodes.select("depth", "id", "parent", (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("saved_tokens")), ["n_leaves", "saved_tokens"])

    last = turns.groupBy("conv").agg(F.max(F.struct("depth", "id")).alias("x"))
    ends = convs.join(last, "conv", "left").select(F.coalesce("x.depth", F.lit(0)).alias("depth"), F.coalesce("x.id", F.lit(0)).alias("id"), "conv")
    digests = ends.repartition("depth", "id").sortWithinPartitions("depth", "id", "conv").mapInArrow(_id_digests, "depth long, id long, ends_sha256 string")

    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    hot = hot_keys(above, ["depth", "parent"], "n_children", nodes.count())
    named = spread_join(nodes, above.drop("n_children"), ["depth", "parent"], "left", hot, "id")
    found = named.join(sums, ["depth", "id"]).join(digests, ["depth", "id"], "left")
    return found.select("conv_id", "depth", "parent_conv_id", *[F.col(c).cast("long").alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")], F.coalesce("ends_sha256", F.lit(_NOTHING)).alias("ends_sha256"))


def trie(conversations: DataFrame, settings: Settings = Settings(), id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """build() for the conversations as they are: whole texts, cases as in turns_of(); other columns are not read."""
    turns = turns_of(conversations, id_col, turn_col, role_col, text_col)
    return build(turns.withColumn("depth", F.col("at") + 1), turns, settings)


def grafted(turns: DataFrame, base: Column, heads: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """turns (of turns_of()) of conversations that begin like others, with their depth, and all conversations.

    A conversation gets the first `heads` turns of `base` (all if it has fewer, none if there is no such one), then its own after
    its first `heads`. base, heads: columns over `conv`; heads are at most `most`, so that at most so many turns are repeated.
    """
    convs = stored(turns.groupBy("conv").agg(F.count("*").alias("n")).withColumns({"base": base.cast("long"), "heads": heads.cast("int")}), "conversations")
    first = stored(turns.where(F.col("at") < most).select(F.col("conv").alias("base"), "at", "digest", "n_bytes"), "first-turns")
    begun = convs.select("conv", "base", "heads").join(first, "base").where("at < heads")
    lent = stored(begun.groupBy("conv").agg(F.count("*").alias("lent")).join(convs.select("conv", "heads", "n"), "conv", "right").withColumn("lent", F.coalesce("lent", F.lit(0))), "lent")
    own = spread_join(turns, lent.drop("n"), ["conv"], hot=hot_keys(lent, ["conv"], "n", turns.count()), by="at").where("at >= heads")
    depth = lambda x: x.cast("long").alias("depth")
    every = begun.select("conv", depth(F.col("at") + 1), "digest", "n_bytes").unionByName(own.select("conv", depth(F.col("at") - F.col("heads") + F.col("lent") + 1), "digest", "n_bytes"))
    return every, convs
