"""Pieces that all training-data operators share: the work folder, and clean (id, text) columns."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side of a join may be broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 200_000
#: A key with more rows than this, and than a 100,000th of all, is split over several tasks by spread_join().
HOT_ROWS = 1000
#: Bytes of texts that a Python worker gets at a time.
BATCH_BYTES = 8 << 20
#: Rows of each label that a shard of training rows has at least, if there are so many.
SHARD_LABELS = 100
_ROOTS: set[str] = set()
#: Tables that the innermost settled() of this thread has written so far.
_WRITTEN: ContextVar[list[str] | None] = ContextVar("written", default=None)


def work_folder(spark: SparkSession, name: str = "work") -> str:
    """A new path in the shared folder that the cluster names in spark.checkpoint.dir; what lies there goes when the driver ends.

    Where that setting is missing, as in tests, a local master gets a temporary folder; any other is an error, as executors
    would not see each other's files.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        if found.isDefined():
            base = found.get()
        elif spark.sparkContext.master.split("[")[0] == "local":
            base = "file://" + tempfile.mkdtemp(prefix="sievegrid-")
            spark.sparkContext.setCheckpointDir(base)
        else:
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    root = f"{base.rstrip('/')}/sievegrid/{spark.sparkContext.applicationId}"
    if root not in _ROOTS:
        _ROOTS.add(root)
        atexit.register(remove, spark, root)
    return f"{root}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, root: str) -> None:
    """Deletes a path of the work folder."""
    if spark.sparkContext._jsc is not None and not spark.sparkContext._jsc.sc().isStopped():
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame, name: str = "work", partition_by: list[str] | None = None) -> DataFrame:
    """df, written as Parquet to the shared folder and read back: its lineage ends there."""
    path = work_folder(df.sparkSession, name)
    written = _WRITTEN.get()
    if written is not None:
        written.append(path)
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.option("compression", "zstd").parquet(path)  # unlike snappy it keeps no direct buffers, which outlive a task
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled(spark: SparkSession, make: Callable[[], DataFrame], name: str = "work") -> DataFrame:
    """make(), stored; the tables that it stores on its way are deleted, also if it fails.

    Only the result outlives the call, so a driver that runs many operators holds the results of these and no more.
    Calls may lie within each other: the result of an inner one is a table on the way of the outer one.
    """
    written: list[str] = []
    token = _WRITTEN.set(written)
    try:
        result = make()
        _WRITTEN.reset(token)
        token = None
        return stored(result, name)
    finally:
        if token is not None:
            _WRITTEN.reset(token)
        for path in written:
            remove(spark, path)


def small_side(df: DataFrame, rows: int | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most `limit` rows (counted here unless given), else df: the join then shuffles."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n <= limit else df


def hot_keys(sizes: DataFrame, keys: list[str], size: str, rows: int) -> DataFrame | None:
    """Of sizes (keys, size), how many rows each key has out of `rows`: keys and parts of the hot ones, 100,000 at most; None without any."""
    limit = max(HOT_ROWS, rows // 100_000)
    hot = stored(sizes.where(F.col(size) > limit).select(*keys, F.ceil(F.col(size) / limit).cast("int").alias("_parts")), "hot-keys")
    return None if hot.isEmpty() else hot


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", hot: DataFrame | None = None, by: str | None = None) -> DataFrame:
    """left.join(right, keys, how) for an inner or left join, where few rows of right have one key and many of left may.

    Rows of a hot key (of hot_keys()) are dealt to its parts, each of which meets a copy of the rows of right: by a column
    that differs within a key, or in turn. In turn only if left is a scan: in another order, as after a shuffle, a task
    that is run again would deal otherwise.
    """
    if hot is None:
        return left.join(right, keys, how)
    parts, salt = F.coalesce("_parts", F.lit(1)), "_salt"
    turn = F.monotonically_increasing_id() if by is None else F.xxhash64(by)
    dealt = left.join(F.broadcast(hot), keys, "left").withColumn(salt, F.pmod(turn, parts).cast("int")).drop("_parts")
    copies = right.join(F.broadcast(hot), keys, "left").withColumn(salt, F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return dealt.join(copies, [*keys, salt], how).drop(salt)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """names, with underscores added until df has no such column: what an operator adds can't clash with its caller's columns."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def text_or_empty(text_col: str = "text") -> Column:
    return F.coalesce(F.col(text_col).cast("string"), F.lit(""))


def bounded_batches(spark: SparkSession) -> None:
    """Lowers the session's limit on the bytes of an Arrow batch to BATCH_BYTES: texts are long, and each batch is held
    by the executor and by its Python worker, several times over."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name))
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(name, f"{BATCH_BYTES}b")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: str) -> DataFrame:
    """Only the columns that an operator reads, named doc_id and text: further columns can't clash. Null text: empty.

    Ids are whole numbers, or text or other types that hold one; an id that holds none is an error of the cast.
    """
    bounded_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"), *more)


def labelled(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text and label of all labelled documents.

    An id that is labelled more than once takes the larger label; null ids and labels are left out. Texts are shuffled only
    if more ids are labelled than a broadcast may have.
    """
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).dropna()
    return id_and_text(docs, id_col, text_col).join(small_side(known.groupBy("doc_id").agg(F.max("label").alias("label"))), "doc_id")


def dealt(rows: DataFrame, sizes: dict[int, int], shard_rows: int) -> DataFrame:
    """rows (doc_id, label and more; `sizes` of them have each label) with `shard`, from 0: about `shard_rows` rows each, by hash.

    Each row is in a shard. A label with fewer than SHARD_LABELS rows a shard is dealt to several, so that all have so many, or all
    there are. Repeated rows meet before the shuffle and are dealt each by itself, so that one id fills no shard.
    """
    shards = max(1, -(-sum(sizes.values()) // shard_rows))
    times = F.lit(1)
    for label, n in sizes.items():
        times = F.when(F.col("label") == label, min(shards, -(-SHARD_LABELS * shards // n))).otherwise(times)
    each = rows.groupBy(*rows.columns).agg(F.count("*").alias("_n")).withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "_n")))
    first = F.xxhash64(*rows.columns, "_copy")
    turn = F.explode(F.sequence(F.lit(0), times - 1))
    return each.withColumn("_turn", turn).select(*rows.columns, F.pmod(F.pmod(first, F.lit(shards)) + F.col("_turn"), F.lit(shards)).cast("int").alias("shard"))


def at_ranks(values: DataFrame, column: str, ranks: list[int], parts: int = 4096) -> list[float]:
    """The values of a column of doubles at ranks, from 0, in ascending order: exact, nothing is sorted.

    The span that holds a rank is cut into `parts`, whose rows are counted, until it is a single value: two or three rounds for
    millions of rows. The driver gets the counts of the parts.
    """
    low, high = values.agg(F.min(column), F.max(column)).first()
    spans = {r: (low, high, 0) for r in ranks}  # least and greatest value, rows below
    while open_spans := sorted({s for s in spans.values() if s[0] < s[1]}):
        x = F.col(column)
        # the part is a monotonic function of the value, whatever the rounding
        part = lambda s: F.least(F.floor((x - s[0]) / (s[1] - s[0]) * parts), F.lit(parts - 1))
        inside = F.array(*[F.when(x.between(s[0], s[1]), F.struct(F.lit(i).alias("span"), part(s).alias("part"))) for i, s in enumerate(open_spans)])
        rows = values.select(x, F.explode(F.array_compact(inside)).alias("k")).groupBy("k.span", "k.part").agg(F.count("*").alias("n"), F.min(column).alias("low"), F.max(column).alias("high"))
        found: dict[int, list] = {}
        for r in sorted(rows.collect(), key=lambda r: (r["span"], r["part"])):
            found.setdefault(r["span"], []).append(r)
        for rank, span in spans.items():
            if span[0] < span[1]:
                below = span[2]
                for r in found[open_spans.index(span)]:
                    if rank < below + r["n"]:
                        spans[rank] = (r["low"], r["high"], below)
                        break
                    below += r["n"]
    return [spans[r][0] for r in ranks]


def quantiles(values: DataFrame, column: str, rows: int, shares: list[float]) -> list[float]:
    """Exact quantiles of a column of `rows` doubles, linear between neighbours."""
    places = [s * (rows - 1) for s in shares]
    ranks = sorted({r for p in places for r in (int(p), min(int(p) + 1, rows - 1))})
    value = dict(zip(ranks, at_ranks(values, column, ranks), strict=True))
    return [value[int(p)] + (value[min(int(p) + 1, rows - 1)] - value[int(p)]) * (p - int(p)) for p in places]


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str, text_col: str, rows: int) -> DataFrame:
    """doc_id, text and label of the documents of at most `rows` labelled ids, those with the smallest hashes.

    An id that is labelled more than once takes the larger label; null ids and labels are left out. The ids are
    chosen from the table of labels alone and sent to the documents: a side of at most `rows` rows.
    """
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).dropna()
    chosen = known.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return id_and_text(docs, id_col, text_col).join(F.broadcast(chosen), "doc_id")
