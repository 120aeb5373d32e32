"""The library's own selectors by name, for operators.registry.call(): frames of a video, and tokens of frames."""

from __future__ import annotations

from pyspark.sql import DataFrame

from sievegrid.operators import budget, ranking, sampling
from sievegrid.operators.registry import selector


@selector("uniform_frames")
def uniform_frames(videos: DataFrame, n: int = 8) -> DataFrame:
    """Of videos (video_id, total) n frames evenly spread."""
    return sampling.uniform_sample(videos, n)


@selector("density_frames")
def density_frames(frames: DataFrame, threshold: int = 10, tau: float = 0.2, ks: list[int] | None = None, neighbours: int = 5, pool_size: int = ranking.POOL) -> DataFrame:
    """Of frames (video_id, t, emb, score) those that answer the queries among the density peaks."""
    ranked = ranking.density_rank(ranking.pool(frames, pool_size), neighbours, also=["score"])
    return ranking.escalating_select(ranked, threshold, tau, ks)


def _tokens(version: str):
    def select(frames: DataFrame, ratio: float = 0.5, threshold: float = 0.0, temperature: float = 1.0, explicit: int | None = None) -> DataFrame:
        found = budget.budget_frames(frames, version, ratio, threshold, temperature, explicit)
        return budget.select(found, None if version in ("v1", "v2") else threshold)

    return select


for _version in ("v1", "v2", "v3", "v4", "v5"):
    selector(f"tokens_{_version}")(_tokens(_version))
