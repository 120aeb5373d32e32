"""Density-peak ranking of frames, temporal segments, and the choice of frames that answer a query."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType
from pyspark.sql.window import WindowSpec

from sievegrid.functions.vectors import dot, unit
from sievegrid.operators.sampling import uniform_sample


def _video() -> WindowSpec:
    return Window.partitionBy("video_id")


#: Lines of a query file, and frames of a pool: what goes to every task, or into one row.
MOST_QUERIES, POOL = 1000, 512


def checked_queries(queries: DataFrame, most: int = MOST_QUERIES) -> DataFrame:
    """One row with `all`, the unit vectors of the queries (query); more than `most` are an error."""
    few = queries.limit(most + 1).agg(F.collect_list(unit(F.col("query"))).alias("all"))
    return few.select(F.when(F.size("all") <= most, F.col("all")).otherwise(F.raise_error(F.lit("too many queries")).cast("array<array<double>>")).alias("all"))


def with_query_scores(frames: DataFrame, queries: DataFrame, how: str = "max", emb: str = "emb") -> DataFrame:
    """frames with score: cosine of `emb` with each query (query), aggregated by max or mean, in place.

    The queries, at most MOST_QUERIES, go to every task.
    """
    rows = frames.withColumn("_unit", unit(F.col(emb)))
    each = rows.crossJoin(F.broadcast(checked_queries(queries))).withColumn("_c", F.transform("all", lambda q: dot(F.col("_unit"), q)))
    total = F.aggregate("_c", F.lit(0.0), lambda s, x: s + x)
    score = {"max": F.array_max("_c"), "mean": total / F.size("_c")}[how]
    return each.withColumn("score", score).drop("_unit", "all", "_c")


def with_own_query_scores(frames: DataFrame, queries: DataFrame) -> DataFrame:
    """frames (video_id, emb and more) with score: the best cosine with the queries (video_id, query) of the frame's own video,
    null without any. A video has at most MOST_QUERIES, more are an error."""
    sizes = queries.groupBy("video_id").agg(F.count("*").alias("_n"))
    fits = F.when(F.col("_n") <= MOST_QUERIES, F.col("query")).otherwise(F.raise_error(F.lit("too many queries")).cast(queries.schema["query"].dataType))
    # counted before any task gathers them
    few = queries.join(sizes, "video_id").select("video_id", fits.alias("query")).groupBy("video_id").agg(F.collect_list(unit(F.col("query"))).alias("_all"))
    rows = frames.withColumn("_unit", unit(F.col("emb"))).join(few, "video_id", "left")
    return rows.withColumn("score", F.array_max(F.transform("_all", lambda q: dot(F.col("_unit"), q)))).drop("_unit", "_all")


def query_scores(frames: DataFrame, queries: DataFrame, how: str = "max") -> DataFrame:
    """video_id, t, score of frames (emb), as in with_query_scores()."""
    return with_query_scores(frames.select("video_id", "t", "emb"), queries, how).select("video_id", "t", "score")


def pool(frames: DataFrame, n: int = POOL) -> DataFrame:
    """Of each video's frames (video_id, t and more) at most n, evenly spread; pool_index counts them from 0."""
    sizes = frames.groupBy("video_id").agg(F.count("*").alias("total"))
    picked = uniform_sample(sizes, n).select("video_id", F.col("position").cast("long").alias("pool_index"), F.col("frame_index").alias("_at"))
    placed = frames.withColumn("_at", (F.row_number().over(_video().orderBy("t")) - 1).cast("long"))
    return placed.join(picked, ["video_id", "_at"]).drop("_at")


def _peaks(x: pd.DataFrame, neighbours: int) -> pd.DataFrame:
    """One pool in order of time with rho, delta and center_rank: distances are one product of matrices."""
    v = np.stack(x["emb"].to_numpy()).astype(float)
    v /= np.maximum(np.sqrt((v * v).sum(1, keepdims=True)), 1e-12)
    n = len(x)
    rho, delta = np.full(n, np.nan), np.full(n, np.nan)
    if n > 1:
        # to 12 digits, so that equal vectors tie in any order of summation
        d = np.round(np.maximum(1 - v @ v.T, 0), 12)
        other = ~np.eye(n, dtype=bool)
        nearest = np.sort(np.where(other, d, np.inf), axis=1)[:, : min(max(1, neighbours), n - 1)]
        rho = np.round(np.exp(-nearest * nearest).sum(1), 12)
        least = np.where(rho[None, :] > rho[:, None], d, np.inf).min(1)
        delta = np.where(np.isinf(least), np.where(other, d, -np.inf).max(1), least)
    value = np.round(np.nan_to_num(rho * delta) - 1e-6 * np.arange(n) / max(n - 1, 1), 10)
    rank = np.empty(n, np.int64)
    rank[np.argsort(-value, kind="stable")] = np.arange(1, n + 1)
    return x.drop(columns="emb").assign(pool_index=np.arange(n), rho=rho, delta=delta, center_rank=rank)


def density_rank(frames: DataFrame, neighbours: int = 5, most: int = POOL, also: list[str] | None = None) -> DataFrame:
    """video_id, t, pool_index, rho, delta, center_rank (from 1), and the columns `also` of frames (video_id, t, emb).

    The frames of a video are its pool; pool_index counts them in order of t, and all that follows goes by it: the bias here, the
    boundaries of segments(), the history of escalation(). rho: sum of exp(-d^2) over the nearest min(max(1, neighbours), n - 1)
    frames. delta: distance to the nearest frame that is strictly denser, else to the farthest of all. Order: rho * delta,
    less a bias of 1e-6 * pool_index / (n - 1), descending. A pool has at most `most` frames; a larger one is an
    error before any task gathers it.
    """
    names = ["video_id", "t", *(also or [])]
    sizes = frames.groupBy("video_id").agg(F.count("*").alias("_n"))
    fits = F.when(F.col("_n") <= most, F.col("t")).otherwise(F.raise_error(F.lit(f"more than {most} frames in a pool")).cast(frames.schema["t"].dataType))
    checked = frames.select(*names, "emb").join(sizes, "video_id").withColumn("t", fits).drop("_n")
    extra = [StructField("pool_index", LongType()), *(StructField(c, DoubleType()) for c in ("rho", "delta")), StructField("center_rank", LongType())]
    schema = StructType([frames.schema[c] for c in names] + extra)
    return checked.groupBy("video_id").applyInPandas(lambda x: _peaks(x.sort_values("t", kind="stable"), neighbours), schema)


def segments(centers: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Segments (segment_index, start_pool_index, end_pool_index, center_pool_index, center_t) of a pool around centers (keys,
    pool_index, t, pool_size).

    A boundary lies after the middle, rounded down, of two neighbours; the first segment starts at 0, the last ends with the
    pool. Places are those in the pool; center_t is the frame's own number.
    """
    keys = keys or ["video_id"]
    w = Window.partitionBy(*keys).orderBy("pool_index")
    c, at = centers.dropDuplicates([*keys, "pool_index"]), F.col("pool_index")
    start = F.coalesce(F.floor((F.lag("pool_index").over(w) + at) / 2) + 1, F.lit(0))
    end = F.coalesce(F.floor((at + F.lead("pool_index").over(w)) / 2), F.col("pool_size") - 1)
    index = (F.row_number().over(w) - 1).cast("long").alias("segment_index")
    return c.select(*keys, index, start.cast("long").alias("start_pool_index"), end.cast("long").alias("end_pool_index"), at.alias("center_pool_index"), F.col("t").alias("center_t"))


def k_set(threshold: int, given: list[int] | None = None) -> list[int]:
    """Numbers of centers to try: threshold times 1, 2, 3, or those given, each once; the first must be the threshold."""
    ks = list(dict.fromkeys(given or [threshold, 2 * threshold, 3 * threshold]))
    if min(ks) <= 0 or ks[0] != threshold:
        raise ValueError("the numbers must be positive and start with the threshold")
    return ks


def _tried(ranked: DataFrame, threshold: int, tau: float, ks: list[int] | None) -> DataFrame:
    """ranked (video_id, center_rank, score) with n, highs (of each k tried, its centers of relevance tau at least) and last,
    the place of the first k with enough of them, or of the last k."""
    tried = k_set(threshold, ks)
    high = F.array(*[F.count_if((F.col("score") >= tau) & (F.col("center_rank") <= k)).over(_video()) for k in tried])
    rows = ranked.withColumn("n", F.count("*").over(_video())).withColumn("highs", high)
    enough = F.array_position(F.transform("highs", lambda x: x >= threshold), True)
    return rows.withColumn("last", F.when(enough > 0, enough).otherwise(len(tried)).cast("int"))


def escalation(ranked: DataFrame, threshold: int, tau: float, ks: list[int] | None = None) -> DataFrame:
    """The history of trying k centers after k, up to the first k with at least `threshold` centers of relevance >= tau.

    ranked (video_id, pool_index, center_rank, score) to (video_id, step, requested_k, effective_k, center_pool_indices,
    high_count, satisfied): the centers that were tried are an array in order of place. All steps are counted at once
    instead of in a loop.
    """
    tried = k_set(threshold, ks)
    rows = _tried(ranked, threshold, tau, ks).where(F.col("center_rank") <= max(tried))
    # an array of max(ks) centers a video at most
    firsts = rows.groupBy("video_id").agg(*[F.first(c).alias(c) for c in ("n", "highs", "last")], F.array_sort(F.collect_list(F.struct("pool_index", "center_rank"))).alias("centers"))
    one = F.explode(F.slice(F.array(*[F.struct(F.lit(i).cast("long").alias("step"), F.lit(k).cast("long").alias("requested_k")) for i, k in enumerate(tried)]), F.lit(1), F.col("last")))
    each = firsts.select("video_id", "n", "highs", "centers", one.alias("k"))
    of_step = F.transform(F.filter("centers", lambda c: c["center_rank"] <= F.col("k.requested_k")), lambda c: c["pool_index"])
    counts = each.select("video_id", "k.*", F.least("k.requested_k", "n").alias("effective_k"), of_step.alias("center_pool_indices"), F.get("highs", F.col("k.step").cast("int")).alias("high_count"))
    return counts.withColumn("satisfied", F.col("high_count") >= threshold)


def final_centers(ranked: DataFrame, threshold: int, tau: float, ks: list[int] | None = None) -> DataFrame:
    """The rows of ranked that are centers at the last step of escalation(), with pool_size, final_k and satisfied."""
    tried = k_set(threshold, ks)
    last = F.get(F.array(*[F.lit(k) for k in tried]), F.col("last") - 1)
    rows = _tried(ranked, threshold, tau, ks).withColumn("final_k", last.cast("long"))
    satisfied = F.get("highs", F.col("last") - 1) >= threshold
    return rows.where(F.col("center_rank") <= F.col("final_k")).withColumn("satisfied", satisfied).withColumnRenamed("n", "pool_size").drop("highs", "last")


def escalating_select(ranked: DataFrame, threshold: int, tau: float, ks: list[int] | None = None, also: list[str] | None = None) -> DataFrame:
    """video_id, t, pool_index, score, pick (from 1), high, and the columns `also`: the frames chosen at the last step of escalation().

    Of its centers those with a relevance of tau at least come first, then the others by relevance: as the former have the
    higher scores, this is the order of score, ties by place.
    """
    centers = final_centers(ranked, threshold, tau, ks)
    pick = F.row_number().over(_video().orderBy(F.col("score").desc(), "pool_index")).cast("long")
    return centers.select("video_id", "t", "pool_index", "score", pick.alias("pick"), (F.col("score") >= tau).alias("high"), *(also or [])).where(F.col("pick") <= threshold)


def selection(chosen: DataFrame, segments: DataFrame) -> DataFrame:
    """The output of frame selection: chosen (video_id, pool_index, t, score and more, repeats included) in order of place, with the
    segment whose center the frame is, -1 if it is none, and position from 0. What chosen carries along, like the
    score maps of its frames, is the slice that the next step takes over."""
    centers = segments.select("video_id", F.col("center_pool_index").alias("pool_index"), "segment_index")
    joined = chosen.join(centers, ["video_id", "pool_index"], "left").withColumn("segment_index", F.coalesce("segment_index", F.lit(-1)).cast("long"))
    return joined.withColumn("position", (F.row_number().over(_video().orderBy("pool_index")) - 1).cast("long"))


def selection_summary(ranked: DataFrame, threshold: int, tau: float, ks: list[int] | None = None) -> DataFrame:
    """One row a video: what frame selection did, places in the pool and numbers of frames side by side.

    video_id, pool_size, final_k, effective_final_k, high_count, fallback_used, padded_to_threshold, and arrays: center_pool_indices,
    center_original_indices, center_scores (by place), selected_pool_indices, selected_original_indices, selected_segment_indices,
    selected_scores (by place, repeats included). Arrays have as many entries as the last k or the threshold.
    """
    centers = final_centers(ranked, threshold, tau, ks)
    cut = segments(centers).select("video_id", F.col("center_pool_index").alias("pool_index"), "segment_index")
    one = F.array_sort(F.collect_list(F.struct("pool_index", "t", "score", "segment_index"))).alias("c")
    found = centers.join(cut, ["video_id", "pool_index"]).groupBy("video_id").agg(F.first("pool_size").alias("pool_size"), F.first("final_k").alias("final_k"), F.first("satisfied").alias("satisfied"), one)
    by_score = F.array_sort(F.transform("c", lambda x: F.struct((-x["score"]).alias("o"), x.alias("x"))))
    found = found.withColumn("best", F.slice(by_score, 1, threshold)).withColumn("size", F.size("best"))
    turn = lambda i: F.get("best", (i % F.col("size")).cast("int"))["x"]
    found = found.withColumn("s", F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(threshold - 1)), turn)))
    part = lambda a, f: F.transform(a, lambda x: x[f])
    arrays = {f"{name}_{out}": part(a, f) for name, a, fields in (("center", "c", ("pool_index", "t", "score")), ("selected", "s", ("pool_index", "t", "segment_index", "score"))) for f, out in ((f, {"pool_index": "pool_indices", "t": "original_indices", "segment_index": "segment_indices", "score": "scores"}[f]) for f in fields)}
    high = F.size(F.filter("c", lambda x: x["score"] >= tau)).cast("long")
    plain = [high.alias("high_count"), (~F.col("satisfied")).alias("fallback_used"), (F.col("size") < threshold).alias("padded_to_threshold")]
    return found.select("video_id", "pool_size", "final_k", F.size("c").cast("long").alias("effective_final_k"), *plain, *[v.alias(k) for k, v in arrays.items()])


def pad(selected: DataFrame, threshold: int, centers: DataFrame | None = None) -> DataFrame:
    """selected (video_id, t, score) with repeats, best score first and in turn, until each video has `threshold` rows.

    A video of centers (video_id, t, score) of which nothing is selected is filled from its centers, in the same way. Adds slot
    (from 0) and padded. Videos with enough rows stay as they are, cut to the threshold.
    """
    rows = selected.select("video_id", "t", "score", F.lit(True).alias("_own"))
    if centers is not None:
        rest = centers.join(selected.select("video_id").distinct(), "video_id", "left_anti")
        rows = rows.unionByName(rest.select("video_id", "t", "score", F.lit(False).alias("_own")))
    w = Window.partitionBy("video_id").orderBy(F.col("score").desc(), "t")
    ranked = rows.withColumn("r", F.row_number().over(w) - 1).withColumn("m", F.count("*").over(_video()))
    turns = F.floor((threshold - 1 - F.col("r")) / F.col("m"))
    slot = F.explode(F.transform(F.sequence(F.lit(0), turns), lambda k: (F.col("r") + k * F.col("m")).cast("long"))).alias("slot")
    filled = ranked.where(F.col("r") < threshold).select("video_id", "t", "score", slot, "m", "_own")
    return filled.withColumn("padded", ~F.col("_own") | (F.col("slot") >= F.col("m"))).drop("m", "_own")
