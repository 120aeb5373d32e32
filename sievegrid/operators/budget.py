"""Token budgets of frames: softmax shares under capacities, and the tokens that they buy.

A frame is one row: video_id, t, score (its own similarity with the queries) and map, the scores of its tokens as an
array. What concerns one frame happens inside its row; only the shares of a video need a shuffle, by video.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from sievegrid.operators.grid import MAP, top_k


def _video() -> WindowSpec:
    return Window.partitionBy("video_id")


def checked_ratio(ratio: float) -> float:
    if not 0 < ratio <= 1:
        raise ValueError("ratio must be in (0, 1]")
    return ratio


def total_budget(tokens: Column, ratio: float, explicit: int | None = None) -> Column:
    """An explicit budget, above 0 and not above the tokens, else the ratio of them, rounded up, 1 at least.

    No tokens at all are an error, as no budget can be met.
    """
    if explicit is None:
        given = F.greatest(F.lit(1), F.ceil(F.round(tokens * checked_ratio(ratio), 9)))
    elif explicit <= 0:
        raise ValueError("an explicit budget must be above 0")
    else:
        given = F.lit(explicit)
    return F.when(given <= tokens, given).otherwise(F.raise_error(F.lit("budget above the number of tokens")).cast("int")).cast("long")


def softmax_weight(score: Column, capacity: Column, temperature: float) -> Column:
    """Share of a frame among those of its video with room; 0 for those without."""
    room = F.when(capacity > 0, score)
    e = F.when(capacity > 0, F.exp((score - F.max(room).over(_video())) / temperature)).otherwise(0.0)
    return e / F.nullif(F.sum(e).over(_video()), F.lit(0.0))


def allocate(
    frames: DataFrame,
    temperature: float = 1.0,
    score: str = "score",
    capacity: str = "capacity",
    budget: str = "budget",
    out: str = "allocated",
) -> DataFrame:
    """frames (video_id, t, score, capacity, budget) with `out`: whole tokens in proportion to exp(score / temperature),
    none above its capacity, budget (or all capacity, if that is less) in sum.

    Frames that a proportional share would overfill take their capacity, and the others share the rest, until
    all fit. In order of capacity / weight the full frames come first, so that running sums find them at once:
    a frame is full if the rest of the budget over the rest of the weights reaches its ratio. What remains after
    rounding down goes, one each, to the largest fractions.
    """
    c, s = F.col(capacity), F.col(score)
    f = frames.withColumn("_b", F.least(F.col(budget), F.sum(c).over(_video())))
    weight = F.greatest(F.exp((s - F.max(F.when(c > 0, s)).over(_video())) / temperature), F.lit(1e-300))
    f = f.withColumn("_e", F.when(c > 0, weight).otherwise(0.0))
    f = f.withColumn("_r", F.when(c > 0, c / F.nullif("_e", F.lit(0.0))).otherwise(0.0))
    order = Window.partitionBy("video_id").orderBy("_r", "t")
    before = F.coalesce(F.sum(c).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # summed up from the other end: a frame that ends at unboundedFollowing is summed anew for each row
    back = Window.partitionBy("video_id").orderBy(F.col("_r").desc(), F.col("t").desc())
    rest = F.sum("_e").over(back.rowsBetween(Window.unboundedPreceding, 0))
    f = f.withColumn("_lambda", (F.col("_b") - before) / F.nullif(rest, F.lit(0.0)))
    f = f.withColumn("_full", (c == 0) | F.coalesce(F.round(F.col("_lambda") - F.col("_r"), 9) >= 0, F.lit(True)))
    share = F.max(F.when(~F.col("_full"), F.col("_lambda"))).over(_video())
    quota = F.when(F.col("_full"), F.least(c, F.col("_b")).cast("double")).otherwise(share * F.col("_e"))
    f = f.withColumn("_quota", F.round(quota, 9)).withColumn("_floor", F.floor("_quota"))
    f = f.withColumn("_key", F.when(F.col("_floor") < c, F.round(F.col("_quota") - F.col("_floor") + 1e-6 * s, 9)))
    rank = F.row_number().over(Window.partitionBy("video_id").orderBy(F.col("_key").desc_nulls_last(), "t"))
    f = f.withColumn("_rank", rank).withColumn("_rest", F.col("_b") - F.sum("_floor").over(_video()))
    extra = F.when(F.col("_key").isNotNull() & (F.col("_rank") <= F.col("_rest")), 1).otherwise(0)
    mine = ["_b", "_e", "_r", "_lambda", "_full", "_quota", "_floor", "_key", "_rank", "_rest"]
    return f.withColumn(out, (F.col("_floor") + extra).cast("long")).drop(*mine)


def frame_maps(tokens: DataFrame, frame_scores: DataFrame) -> DataFrame:
    """Frames of tokens (video_id, t, token, score), numbered from 0 without gaps, and of frame_scores (video_id, t, score)."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("token", "score"))), lambda x: x["score"])
    return tokens.groupBy(*MAP).agg(ordered.alias("map")).join(frame_scores.select(*MAP, "score"), MAP)


def frame_table(frames: DataFrame, threshold: float | None, ratio: float, explicit: int | None = None) -> DataFrame:
    """frames (video_id, t, score, map) with the least and greatest score of a token, eligible tokens, tokens, and the video's budget."""
    eligible = F.size("map") if threshold is None else F.size(F.filter("map", lambda x: x >= threshold))
    f = frames.select(
        *MAP,
        "score",
        "map",
        F.array_min("map").alias("score_min"),
        F.array_max("map").alias("score_max"),
        eligible.cast("long").alias("eligible"),
        F.size("map").cast("long").alias("tokens"),
    )
    return f.withColumn("budget", total_budget(F.sum("tokens").over(_video()), ratio, explicit))


def fixed_ratio(tokens: DataFrame, ratio: float) -> DataFrame:
    """v1 on tokens (video_id, t, token, score): of each frame the best max(1, ceil(tokens * ratio)), 0 < ratio <= 1."""
    count = F.count("*").over(Window.partitionBy(*MAP))
    n = tokens.withColumn("k", F.greatest(F.lit(1), F.ceil(F.round(count * checked_ratio(ratio), 9))))
    return top_k(n, F.col("k")).drop("k")


def budget_frames(
    frames: DataFrame,
    version: str,
    ratio: float,
    threshold: float = 0.0,
    temperature: float = 1.0,
    explicit: int | None = None,
) -> DataFrame:
    """frames (video_id, t, score, map) with allocated, initial_keep, reallocated and keep, by version.

    v1: the same ratio of each frame. v2: capacity is all tokens. v3: as v2, cut to the eligible tokens, what is left over
    dealt once more among the rest of them. v4: capacity is the eligible tokens. v5 is v4 on maps that a noisy query
    gave, while the scores of frames are those of the clean one.
    """
    if version not in ("v1", "v2", "v3", "v4", "v5"):
        raise ValueError(f"unknown version {version}")
    f = frame_table(frames, None if version in ("v1", "v2") else threshold, ratio, explicit)
    once = lambda df: df.withColumns({"initial_keep": F.col("allocated"), "reallocated": F.lit(0).cast("long"), "keep": F.col("allocated")})
    if version == "v1":
        return once(f.withColumn("allocated", F.greatest(F.lit(1), F.ceil(F.round(F.col("tokens") * ratio, 9))).cast("long")))
    f = allocate(f.withColumn("capacity", F.col("eligible" if version in ("v4", "v5") else "tokens")), temperature)
    if version != "v3":
        return once(f)
    f = f.withColumn("initial_keep", F.least("allocated", "eligible"))
    left = F.sum("allocated").over(_video()) - F.sum("initial_keep").over(_video())
    f = f.withColumn("_room", F.col("eligible") - F.col("initial_keep")).withColumn("_left", left)
    f = allocate(f, temperature, capacity="_room", budget="_left", out="reallocated").drop("_room", "_left")
    return f.withColumn("keep", F.col("initial_keep") + F.col("reallocated"))


def select(frames: DataFrame, threshold: float | None = None) -> DataFrame:
    """video_id, t, token, score: of each frame (map, keep) its `keep` best tokens, ties by token, among the eligible ones
    if there is a threshold. More to keep than there are is an error."""
    scored = F.transform("map", lambda x, i: F.struct((-x).alias("s"), i.cast("long").alias("token")))
    eligible = scored if threshold is None else F.filter(scored, lambda x: x["s"] <= -threshold)
    ranked = frames.select(*MAP, "keep", F.array_sort(eligible).alias("best"))
    short = F.raise_error(F.lit("budget of a frame above its eligible tokens")).cast("int")
    checked = F.when(F.col("keep") <= F.size("best"), F.col("keep").cast("int")).otherwise(short)
    kept = ranked.select(*MAP, F.explode(F.slice("best", F.lit(1), checked)).alias("x"))
    return kept.select(*MAP, "x.token", (-F.col("x.s")).alias("score"))


def metadata(frames: DataFrame) -> DataFrame:
    """Per video: budget, what could be allotted, what was selected, reallocated and left unfilled."""
    total = lambda c: F.sum(c).alias(c)
    f = frames.groupBy("video_id").agg(
        F.count("*").alias("frames"),
        total("tokens"),
        F.max("budget").alias("budget"),
        total("eligible"),
        F.sum("keep").alias("selected"),
        total("reallocated"),
        F.min("score_min").alias("score_min"),
        F.max("score_max").alias("score_max"),
    )
    return f.withColumn("allocatable", F.least("budget", "eligible")).withColumn("underfilled", F.col("budget") - F.col("selected"))
