"""Frames in time: sampling, decoding fallbacks, duplication, alignment, clips and sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FACTOR = 28


def sample_indices(total: Column, n: int) -> Column:
    """Array of the sampled indices: all if there are at most n, the middle one for n = 1, else n even steps, half to even."""
    spread = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.rint(i * ((total - 1) / float(max(1, n - 1)))).cast("long"))
    some = F.array(F.floor(total / 2).cast("long")) if n == 1 else spread
    every = F.transform(F.sequence(F.lit(0), F.greatest(total - 1, F.lit(0)).cast("int")), lambda i: i.cast("long"))
    return F.when(total <= 0, F.array().cast("array<long>")).when(total <= n, every).otherwise(some)


def uniform_sample(videos: DataFrame, n: int) -> DataFrame:
    """videos (video_id, total) to (video_id, position, frame_index)."""
    return videos.select("video_id", F.posexplode(sample_indices(F.col("total"), n)).alias("position", "frame_index"))


def display_sample(videos: DataFrame, n: int) -> DataFrame:
    """As uniform_sample(), each index once."""
    return videos.select("video_id", F.explode(F.array_sort(F.array_distinct(sample_indices(F.col("total"), n)))).alias("frame_index"))


def strided_sample(videos: DataFrame, stride: int) -> DataFrame:
    """videos (video_id, total) to (video_id, frame_index): every stride-th frame, from the first one on."""
    if stride <= 0:
        raise ValueError("the stride must be positive")
    each = F.sequence(F.lit(0).cast("long"), F.col("total").cast("long") - 1, F.lit(stride).cast("long"))
    return videos.where("total > 0").select("video_id", F.explode(each).alias("frame_index"))


def decoded_or_prefix(requested: DataFrame, decoded: DataFrame, n: int) -> DataFrame:
    """Frames to use: the requested ones if all decode, else the first min(decoded frames, n).

    requested, decoded: (video_id, frame_index). Adds used_fallback. A video without decoded frames gives none.
    """
    wanted = requested.dropDuplicates(["video_id", "frame_index"])
    flagged = decoded.join(wanted.withColumn("wanted", F.lit(1)), ["video_id", "frame_index"], "left")
    got = flagged.groupBy("video_id").agg(F.count("wanted").alias("got"), F.count("*").alias("actual"))
    need = wanted.groupBy("video_id").agg(F.count("*").alias("need"))
    state = got.join(need, "video_id").select("video_id", "actual", (F.col("got") < F.col("need")).alias("used_fallback"))
    chosen = flagged.join(state, "video_id").where(F.when(F.col("used_fallback"), F.col("frame_index") < F.least("actual", F.lit(n))).otherwise(F.col("wanted").isNotNull()))
    return chosen.select("video_id", "frame_index", "used_fallback")


def fitted_size(height: Column, width: Column, max_side: int | None = 720, factor: int = FACTOR, min_pixels: int = 3136, max_pixels: int = 12845056) -> tuple[Column, Column]:
    """Size within max_side, then as multiples of factor within the pixel limits; sides more than 200 to 1 are an error."""
    h, w = height.cast("double"), width.cast("double")
    if max_side is not None:
        scale = F.least(max_side / F.greatest(h, w), F.lit(1.0))
        h, w = (F.when(scale < 1, F.greatest(F.lit(1.0), F.rint(x * scale))).otherwise(x) for x in (h, w))
    whole = lambda x: F.greatest(F.lit(float(factor)), F.rint(x / factor) * factor)
    pixels = whole(h) * whole(w)
    down, up = F.sqrt(h * w / max_pixels), F.sqrt(min_pixels / (h * w))
    side = lambda x: F.when(pixels > max_pixels, F.greatest(F.lit(float(factor)), F.floor(x / down / factor) * factor)).when(pixels < min_pixels, F.greatest(F.lit(float(factor)), F.ceil(x * up / factor) * factor)).otherwise(whole(x))
    checked = lambda x: F.when(F.greatest(h, w) / F.least(h, w) <= 200, side(x)).otherwise(F.raise_error(F.lit("aspect ratio above 200")).cast("double")).cast("long")
    return checked(h), checked(w)


def duplicate(frames: DataFrame, times: int, t: str = "t") -> DataFrame:
    """Each frame `times` times in a row: t becomes t * times + copy; source_t is the old one."""
    return frames.withColumn("source_t", F.col(t)).withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(times - 1)))).withColumn(t, F.col(t) * times + F.col("_copy")).drop("_copy")


def undo_duplicate(frames: DataFrame, times: int, t: str = "t") -> DataFrame:
    """The first copy of each frame, numbered as before duplicate()."""
    return frames.where(F.col(t) % times == 0).withColumn(t, F.floor(F.col(t) / times))


def lineage(selected: Column, sampled: Column, total: Column) -> Column:
    """The first of the two index arrays that has `total` entries without nulls, else 0 to total - 1."""
    valid = lambda a: F.when((F.size(a) == total) & F.forall(a, lambda x: x.isNotNull()), a)
    return F.coalesce(valid(selected), valid(sampled), F.sequence(F.lit(0), (total - 1).cast("int")).cast("array<long>"))


def temporal_patch(parameter: Column, total: Column, grid_t: Column) -> Column:
    """Frames per step of the grid: the parameter, else their ratio if it is whole, else 1."""
    return F.coalesce(parameter, F.when(total % grid_t == 0, F.floor(total / grid_t)), F.lit(1))


def align(scores: DataFrame, patch: int) -> DataFrame:
    """Mean over each `patch` frames in a row; (video_id, t, y, x, score). Every step must have all its frames."""
    steps = scores.withColumn("t", F.floor(F.col("t") / patch)).groupBy("video_id", "t", "y", "x").agg(F.avg("score").alias("score"), F.count("*").alias("_n"))
    return steps.withColumn("score", F.when(F.col("_n") == patch, F.col("score")).otherwise(F.raise_error(F.lit("frames don't fill the grid")).cast("double"))).drop("_n")


def clip(frames: DataFrame, clips: DataFrame) -> DataFrame:
    """frames (video_id, frame_index) of clips (video_id, clip_id, start, end, fps).

    From round(start * fps) to round(end * fps), both included; null start: 0; an end that is null or not after the
    start: the whole video; fps that is null or not above 0: 30.
    """
    fps = F.when(F.col("fps") > 0, F.col("fps")).otherwise(30.0)
    start = F.coalesce("start", F.lit(0.0))
    part = F.col("end") > start
    bounds = clips.select("video_id", "clip_id", F.when(part, F.rint(start * fps)).otherwise(0).cast("long").alias("lo"), F.when(part, F.rint(F.col("end") * fps)).otherwise((1 << 62) * 1).cast("long").alias("hi"))
    return frames.join(bounds, "video_id").where(F.col("frame_index").between(F.col("lo"), F.col("hi"))).drop("lo", "hi")


def duration(total: Column, fps: Column) -> Column:
    return total / F.nullif(fps, F.lit(0.0))
