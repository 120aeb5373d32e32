"""Score maps: pooling, resizing, sliding windows, winners and masks, in long form (video_id, t, y, x, score)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAP = ["video_id", "t"]


def block_pool(scores: DataFrame, m: int, keys: list[str] = MAP) -> DataFrame:
    """Mean of each m by m block; a block without all its cells is an error: sides must be multiples of m."""
    blocks = scores.groupBy(*keys, F.floor(F.col("y") / m).alias("y"), F.floor(F.col("x") / m).alias("x")).agg(F.avg("score").alias("score"), F.count("*").alias("_n"))
    whole = F.when(F.col("_n") == m * m, F.col("score")).otherwise(F.raise_error(F.lit("cells don't fill the blocks")).cast("double"))
    return blocks.withColumn("score", whole).drop("_n")


def pooled(cells: Column, rows: int, columns: int, m: int) -> Column:
    """Mean of each m by m block of a map in one array, row after row; sides that m doesn't divide are an error."""
    if rows % m or columns % m:
        raise ValueError(f"{rows} by {columns} cells don't fall into blocks of {m} by {m}")
    wide = columns // m
    corner = lambda k: F.floor(k / wide) * (m * columns) + k % wide * m
    block = lambda k: sum((F.get(cells, (corner(k) + dy * columns + dx).cast("int")) for dy in range(m) for dx in range(m)), F.lit(0.0)) / (m * m)
    checked = F.when(F.size(cells) == rows * columns, cells).otherwise(F.raise_error(F.lit("map of another size")).cast("array<double>"))
    return F.when(checked.isNotNull(), F.transform(F.sequence(F.lit(0), F.lit(rows // m * wide - 1)), block))


def axis_weights(size: int, target: int) -> list[tuple[int, int, float]]:
    """(target cell, source cell, weight) of bilinear interpolation between cell centres, clamped at the edges."""
    out = []
    for i in range(target):
        at = max(0.0, (i + 0.5) * size / target - 0.5)
        low = math.floor(at)
        high = min(low + 1, size - 1)
        out += [(i, low, 1 - (at - low)), (i, high, at - low)] if high != low else [(i, low, 1.0)]
    return out


def bilinear(scores: DataFrame, size: tuple[int, int], target: tuple[int, int], keys: list[str] = MAP) -> DataFrame:
    """Maps of `size` (rows, columns) as maps of `target`. The weights are a small table per axis."""
    if size == target:
        return scores
    spark = scores.sparkSession
    rows = spark.createDataFrame(axis_weights(size[0], target[0]), "ty long, y long, wy double")
    cols = spark.createDataFrame(axis_weights(size[1], target[1]), "tx long, x long, wx double")
    wide = scores.join(F.broadcast(rows), "y").join(F.broadcast(cols), "x")
    return wide.groupBy(*keys, F.col("ty").alias("y"), F.col("tx").alias("x")).agg(F.sum(F.col("score") * F.col("wy") * F.col("wx")).alias("score"))


def _covering(at: Column, size: int, window: int, stride: int) -> Column:
    """Windows along an axis that cover the cell `at`: an array of their numbers."""
    last = (size - window) // stride
    low = F.greatest(F.ceil((at - window + 1) / stride), F.lit(0)).cast("long")
    high = F.least(F.floor(at / stride), F.lit(last)).cast("long")
    return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<long>"))


def window_pool(scores: DataFrame, size: tuple[int, int], window: int, stride: int, keys: list[str] = MAP) -> DataFrame:
    """Mean of each window by window square that lies inside the map, one every `stride` cells."""
    each = scores.select(*keys, "score", F.explode(_covering(F.col("y"), size[0], window, stride)).alias("wy"), "x")
    each = each.select(*keys, "score", "wy", F.explode(_covering(F.col("x"), size[1], window, stride)).alias("wx"))
    return each.groupBy(*keys, F.col("wy").alias("y"), F.col("wx").alias("x")).agg(F.avg("score").alias("score"))


def overlap_add(windows: DataFrame, window: int, stride: int, m: int, keys: list[str] = MAP) -> DataFrame:
    """Each window lays its mean on its cells; a block of m by m cells is the sum of what lies on it over their number.

    Cells that no window covers add nothing. A block without any doesn't appear; merged() makes that an error.
    """
    along = lambda c: F.explode(F.transform(F.sequence(F.lit(0), F.lit(window - 1)), lambda d: F.floor((F.col(c) * stride + d) / m)))
    laid = windows.withColumn("by", along("y")).withColumn("bx", along("x"))
    return laid.groupBy(*keys, F.col("by").alias("y"), F.col("bx").alias("x")).agg((F.sum("score") / F.count("*")).alias("score"))


def merged(scores: DataFrame, size: tuple[int, int], mode: str = "naive_mean", m: int = 2, window: int = 2, stride: int = 1) -> DataFrame:
    """Token scores by mode: naive_mean (also merge) or sliding_window, whose windows must reach every block."""
    if size[0] % m or size[1] % m:
        raise ValueError(f"{size[0]} by {size[1]} cells don't fall into blocks of {m} by {m}")
    if mode in ("naive_mean", "merge"):
        return block_pool(scores, m)
    if mode == "sliding_window":
        for side in size:
            laid = {(w * stride + d) // m for w in range((side - window) // stride + 1) for d in range(window)}
            if laid != set(range(side // m)):
                raise ValueError(f"windows of {window} every {stride} cells leave blocks uncovered")
        return overlap_add(window_pool(scores, size, window, stride), window, stride, m)
    raise ValueError(f"unknown mode {mode}")


def query_winner(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Of rows (keys, query_idx, score): the query with the highest score of each key, the first on ties, and that score."""
    best = F.max(F.struct(F.col("score").alias("score"), (-F.col("query_idx")).alias("q"))).alias("best")
    return scores.groupBy(*keys).agg(best).select(*keys, (-F.col("best.q")).alias("query_idx"), F.col("best.score").alias("score"))


def flat_index(t: Column, y: Column, x: Column, rows: int, columns: int) -> Column:
    return (t * rows + y) * columns + x


def from_flat(index: Column, rows: int, columns: int) -> tuple[Column, Column, Column]:
    return F.floor(index / (rows * columns)), F.floor(index / columns) % rows, index % columns


def mask_expand(tokens: DataFrame, scale: int) -> DataFrame:
    """Cells (video_id, t, y, x) of the finer grid under tokens (video_id, t, y, x)."""
    along = lambda c: F.explode(F.transform(F.sequence(F.lit(0), F.lit(scale - 1)), lambda d: F.col(c) * scale + d))
    return tokens.select("video_id", "t", along("y").alias("y"), "x").select("video_id", "t", "y", along("x").alias("x"))


def grid_shape(tensor: Column, listed: Column) -> Column:
    """struct(grid_t, grid_h, grid_w) of the first of two arrays that holds one shape: a tensor's (three numbers, or one row of
    three) before that of the metadata; neither is an error. tensor: ARRAY<ARRAY<BIGINT>>, listed: ARRAY<BIGINT>."""
    rows = F.when((F.size(tensor) == 1) & (F.size(F.get(tensor, 0)) == 3), F.get(tensor, 0))
    flat = F.when((F.size(tensor) == 3) & F.forall(tensor, lambda x: F.size(x) == 1), F.flatten(tensor))
    shape = F.coalesce(rows, flat, F.when(F.size(listed) == 3, listed), F.raise_error(F.lit("no grid of a video")).cast("array<bigint>"))
    return F.struct(*[F.get(shape, i).alias(n) for i, n in enumerate(("grid_t", "grid_h", "grid_w"))])


def score_grid(raw: DataFrame, merged_scores: DataFrame, grid: str, query_index: int | None = None) -> DataFrame:
    """Scores to be shown (keys, y, x, score): of the raw grid, of one query (query_idx) or the best over all, or the merged ones."""
    if grid == "merged":
        return merged_scores
    if grid != "raw":
        raise ValueError(f"unknown grid {grid}")
    if query_index is not None:
        return raw.where(F.col("query_idx") == query_index).drop("query_idx")
    return raw.groupBy(*[c for c in raw.columns if c not in ("query_idx", "score")]).agg(F.max("score").alias("score"))


def steps(grids: DataFrame) -> DataFrame:
    """grids (video_id, grid_t, grid_h, grid_w) as one row (1, h, w) per step."""
    return grids.select("video_id", F.explode(F.sequence(F.lit(0), F.col("grid_t") - 1)).alias("t"), F.lit(1).alias("grid_t"), "grid_h", "grid_w")


def score_limits(scores: DataFrame, low: float, high: float) -> DataFrame:
    """Exact quantiles of the finite scores per video; a tiny step apart if they are equal."""
    finite = scores.where(~F.isnan("score") & (F.abs("score") < float("inf")))
    q = finite.groupBy("video_id").agg(F.expr(f"percentile(score, {low}D)").alias("vmin"), F.expr(f"percentile(score, {high}D)").alias("vmax"))
    return q.withColumn("vmax", F.when(F.col("vmin") == F.col("vmax"), F.col("vmax") + 1e-6).otherwise(F.col("vmax")))


def mask_stats(scores: DataFrame) -> DataFrame:
    """Mean score of each frame overall, inside and outside the mask (scores has `selected`); null where there is no cell."""
    inside = lambda c: F.avg(F.when(c, F.col("score")))
    return scores.groupBy(*MAP).agg(F.avg("score").alias("mean_all"), inside(F.col("selected")).alias("mean_in"), inside(~F.col("selected")).alias("mean_out"))


def top_k(tokens: DataFrame, k: Column, keys: list[str] = MAP, bound: int | None = None) -> DataFrame:
    """The k best tokens of each frame, by score, then token; k may differ by frame. bound: a number that k doesn't pass,
    which lets Spark cut the groups before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("score").desc(), "token"))
    ranked = tokens.withColumn("rank", rank)
    ranked = ranked.where(F.col("rank") <= bound) if bound else ranked
    return ranked.where(F.col("rank") <= k).drop("rank")
