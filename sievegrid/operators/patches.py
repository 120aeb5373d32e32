"""Scores of patches under queries, scores that frame selection hands on, and scores of frames that were duplicated."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from sievegrid.operators import budget
from sievegrid.operators.ranking import MOST_QUERIES


def _query_matrix(queries: DataFrame) -> np.ndarray:
    """The queries (query_idx, query) in order, one a row: MOST_QUERIES at most, more are an error."""
    rows = queries.select("query_idx", F.col("query").cast("array<double>").alias("query")).limit(MOST_QUERIES + 1).collect()
    if len(rows) > MOST_QUERIES:
        raise ValueError("too many queries")
    if not rows:
        raise ValueError("no queries")
    return np.array([r["query"] for r in sorted(rows, key=lambda r: r["query_idx"])], float)


def _unit_rows(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12)


def patch_scores(frames: DataFrame, queries: DataFrame, how: str | None = "max", patches: str = "patches", out: str = "map", cosine: bool = True) -> DataFrame:
    """frames with the similarity of each of their patches with the queries, `patches` (array of vectors) being replaced by `out`.

    how: max or mean over the queries, one value a patch, or None: for each query, in order of query_idx, its own map. Cosines,
    or dot products. The patches of all frames of an Arrow batch are one matrix, which is multiplied with that of the
    queries (MOST_QUERIES at most); frames are not shuffled. Null patches give a null map; no patches, an empty one.
    """
    if how not in ("max", "mean", None):
        raise ValueError(f"unknown aggregation {how}")
    q = _query_matrix(queries)
    q = (_unit_rows(q) if cosine else q).T
    kept = [c for c in frames.columns if c != patches]
    kind = ArrayType(DoubleType()) if how else ArrayType(ArrayType(DoubleType()))
    schema = StructType([*(frames.schema[c] for c in kept), StructField(out, kind)])

    def lists(values: np.ndarray, sizes: np.ndarray, missing: np.ndarray) -> pa.Array:
        ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), values, mask=pa.array(missing))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(patches))
            missing = column.is_null().to_numpy(zero_copy_only=False)
            sizes = np.where(missing, 0, column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            vectors = column.flatten()
            flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(float)
            if len(flat) != len(vectors) * q.shape[0]:
                raise ValueError("patches and queries differ in dimensions")
            x = flat.reshape(-1, q.shape[0])
            each = (_unit_rows(x) if cosine else x) @ q
            if how:
                found = lists(pa.array(each.max(1) if how == "max" else each.mean(1)), sizes, missing)
            else:  # of each frame: a row for each query
                cuts = np.split(each, np.cumsum(sizes)[:-1])
                values = np.concatenate([c.T.ravel() for c in cuts]) if len(cuts) else np.empty(0)
                inner = lists(pa.array(values), np.repeat(sizes, q.shape[1]), np.zeros(len(sizes) * q.shape[1], bool))
                found = lists(inner, np.full(len(sizes), q.shape[1]), missing)
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in kept), found], [*kept, out])

    return frames.select(*kept, F.col(patches).cast("array<array<double>>").alias(patches)).mapInArrow(rows, schema)


def best_queries(maps: Column, digits: int = 9) -> Column:
    """Of maps, one a query as patch_scores() gives them: for each patch struct(score, query_idx) of the query with the highest
    score, the first on ties; scores count to so many digits. Frames stay in their rows."""
    at = lambda k: F.array_max(F.transform(maps, lambda m, i: F.struct(F.round(F.get(m, k), digits).alias("score"), (-i).alias("q"))))
    found = F.transform(F.sequence(F.lit(0), F.size(F.get(maps, F.lit(0))) - 1), at)
    return F.transform(found, lambda x: F.struct(x["score"].alias("score"), (-x["q"]).cast("long").alias("query_idx")))


def content_keys(frames: DataFrame, settings: dict[str, object], queries: DataFrame, also: list[Column] | None = None) -> DataFrame:
    """video_id, frame_count, cache_key: what scores of the video depend on: its frames (video_id, t, emb, whatever their order),
    the queries, settings (model, aggregation, grid and the like), and columns of the video that differ from one to the other."""
    shown = json.dumps(settings, sort_keys=True, default=str)
    words = [json.dumps(r.tolist()) for r in _query_matrix(queries)]
    rows = frames.select("video_id", F.sha2(F.to_json(F.struct("t", "emb", *(also or []))), 256).alias("h"))
    # a sum of hashes doesn't depend on the order of frames, and is summed up in part before the shuffle
    part = lambda at: F.sum(F.conv(F.substring("h", at, 14), 16, 10).cast("decimal(20,0)")).cast("string")
    digests = rows.groupBy("video_id").agg(F.count("*").alias("frame_count"), part(1).alias("a"), part(15).alias("b"), part(29).alias("c"))
    return digests.select("video_id", "frame_count", F.sha2(F.concat_ws("|", "frame_count", "a", "b", "c", F.lit(shown), F.lit(" ".join(words))), 256).alias("cache_key"))


def handed_over(frames: DataFrame, keys: DataFrame, cache: DataFrame, make) -> DataFrame:
    """video_id, t, score, map, cache_key, from_cache of frames (video_id, t and what make needs).

    cache: rows of this form that frame selection handed on. A video whose rows there have the key of keys (video_id,
    frame_count, cache_key), one for each of its frames, takes them over; make(frames) gives score and map of the others.
    Only the frames of these go through make.
    """
    mine = cache.select("video_id", "t", "score", "map", "cache_key").join(keys, ["video_id", "cache_key"])
    places = mine.join(frames.select("video_id", "t"), ["video_id", "t"]).groupBy("video_id", "frame_count").agg(F.count_distinct("t").alias("n"), F.count("*").alias("rows"))
    hits = places.where((F.col("n") == F.col("frame_count")) & (F.col("rows") == F.col("n"))).select("video_id")
    taken = mine.join(hits, "video_id", "left_semi").select("video_id", "t", "score", "map", "cache_key", F.lit(True).alias("from_cache"))
    fresh = make(frames.join(hits, "video_id", "left_anti")).select("video_id", "t", "score", "map")
    fresh = fresh.join(keys.select("video_id", "cache_key"), "video_id").select("video_id", "t", "score", "map", "cache_key", F.lit(False).alias("from_cache"))
    return taken.unionByName(fresh)


def cached_budget_frames(scored: DataFrame, ratio: float, threshold: float = 0.0, temperature: float = 1.0, explicit: int | None = None) -> DataFrame:
    """Version 4 on the scores of handed_over(), with from_cache of each frame's video."""
    found = budget.budget_frames(scored.select("video_id", "t", "score", "map"), "v4", ratio, threshold, temperature, explicit)
    source = scored.groupBy("video_id").agg(F.bool_and("from_cache").alias("from_cache"))
    return found.join(source, "video_id")


def version_for(settings: dict[str, object]) -> str:
    """v4 if there is a least score of a patch, or if the name of the selector says version 3 to 5; else v1. The names are fixed
    values."""
    named = str(settings.get("_target_") or "")
    by_name = any(mark in named for mark in ("selection_v3", "selection_v4", "selection_v5"))
    return "v4" if settings.get("patch_score_threshold") is not None or by_name else "v1"


def select_by_settings(frames: DataFrame, settings: dict[str, object]) -> DataFrame:
    """video_id, t, token, score of frames (video_id, t, score, map), by the version that the settings ask for.

    Missing or zero keep_ratio counts as 0.5, temperature as 1, a missing threshold as 0 (fixed values).
    """
    version, ratio = version_for(settings), float(settings.get("keep_ratio") or 0.5)
    threshold = float(settings.get("patch_score_threshold") or 0.0)
    if version == "v1":
        return budget.select(budget.budget_frames(frames, version, ratio))
    explicit = settings.get("total_budget")
    found = budget.budget_frames(frames, version, ratio, threshold, float(settings.get("temperature") or 1.0), None if explicit is None else int(explicit))
    return budget.select(found, threshold)


def scoring_frames(frames: DataFrame, duplication: DataFrame) -> DataFrame:
    """The frames (video_id, t from 0) that are scored, with duplicate_factor: of a video whose frames were each taken several
    times in a row the first of each, numbered from 0; of others all.

    duplication: video_id, applied, duplicate_factor, original_num_frames. It counts only if it was applied, with a factor above 1
    and frames at all, and if the video has their product in frames; else the factor is 1.
    """
    sizes = frames.groupBy("video_id").agg(F.count("*").alias("n"))
    given = sizes.join(duplication.select("video_id", "applied", F.col("duplicate_factor").alias("f"), F.col("original_num_frames").alias("o")), "video_id", "left")
    valid = F.col("applied") & (F.col("f") > 1) & (F.col("o") > 0) & (F.col("n") == F.col("f") * F.col("o"))
    factor = given.select("video_id", F.when(F.coalesce(valid, F.lit(False)), F.col("f")).otherwise(1).cast("long").alias("duplicate_factor"))
    both = frames.join(factor, "video_id").where(F.col("t") % F.col("duplicate_factor") == 0)
    return both.withColumn("t", F.floor(F.col("t") / F.col("duplicate_factor")))


def expanded_scores(scores: DataFrame) -> DataFrame:
    """scores (video_id, t, duplicate_factor and more) of scoring_frames(), for each copy of the frame again."""
    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.col("duplicate_factor") - 1))
    return scores.withColumn("_copy", copies).withColumn("t", F.col("t") * F.col("duplicate_factor") + F.col("_copy")).drop("_copy", "duplicate_factor")
