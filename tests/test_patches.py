"""Patch scores, handed-over scores, duplication, and what selectors may return."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievegrid.operators import patches, registry, sampling


@pytest.fixture(scope="module")
def views(spark):
    r = np.random.default_rng(1)
    frames = [(v, t, [[float(x) for x in row] for row in r.normal(size=(3 + v, 5))]) for v in (1, 2) for t in range(4)]
    frames += [(3, 0, None), (3, 1, []), (3, 2, [[0.0] * 5])]
    return spark.createDataFrame(frames, "video_id long, t long, patches array<array<double>>").repartition(3)


@pytest.fixture(scope="module")
def words(spark):
    r = np.random.default_rng(2)
    return spark.createDataFrame([(i, [float(x) for x in r.normal(size=5)]) for i in (2, 0, 1)], "query_idx long, query array<double>")


@pytest.mark.parametrize("cosine", [True, False])
def test_patch_scores(views, words, cosine):
    q = np.array([x["query"] for x in words.orderBy("query_idx").collect()])
    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12) if cosine else x
    plain = {(x["video_id"], x["t"]): None if x["patches"] is None else unit(np.array(x["patches"]).reshape(-1, 5)) @ unit(q).T for x in views.collect()}
    for how, f in (("max", lambda m: m.max(1)), ("mean", lambda m: m.mean(1))):
        for x in patches.patch_scores(views, words, how, cosine=cosine).collect():
            m = plain[x["video_id"], x["t"]]
            assert x["map"] is None if m is None else np.allclose(x["map"], f(m) if len(m) else [])
    for x in patches.patch_scores(views, words, None, cosine=cosine).collect():
        m = plain[x["video_id"], x["t"]]
        assert x["map"] is None if m is None else len(x["map"]) == 3 and all(np.allclose(x["map"][i], m[:, i]) for i in range(3))
    assert patches.patch_scores(views.limit(0), words).count() == 0


def test_best_queries(spark):
    maps = spark.createDataFrame([(1, [[0.1, 0.5, 0.2], [0.3, 0.5, 0.1]])], "t long, maps array<array<double>>")
    got = {r["t"]: [(x["query_idx"], x["score"]) for x in r["b"]] for r in maps.select("t", patches.best_queries(F.col("maps")).alias("b")).collect()}
    assert got == {1: [(1, 0.3), (0, 0.5), (0, 0.2)]}


def test_patch_scores_are_checked(spark, views, words, monkeypatch):
    with pytest.raises(Exception, match="dimensions"):
        patches.patch_scores(views, words.withColumn("query", F.slice("query", 1, 4))).collect()
    with pytest.raises(ValueError, match="no queries"):
        patches.patch_scores(views, words.limit(0))
    monkeypatch.setattr(patches, "MOST_QUERIES", 2)
    with pytest.raises(ValueError, match="too many"):
        patches.patch_scores(views, words)


def test_only_changed_videos_are_scored_again(spark, words):
    frames = spark.createDataFrame([(v, t, [float(v + t)] * 5) for v in range(1, 5) for t in range(3)], "video_id long, t long, emb array<double>")
    keys = patches.content_keys(frames, {"model": "m"}, words)
    assert keys.select("cache_key").distinct().count() == 4
    same = patches.content_keys(frames.orderBy(F.desc("t")).repartition(2), {"model": "m"}, words)
    assert sorted(map(tuple, keys.collect())) == sorted(map(tuple, same.collect()))
    other = [patches.content_keys(frames, {"model": "n"}, words), patches.content_keys(frames, {"model": "m"}, words.where("query_idx > 0"))]
    changed = frames.withColumn("emb", F.when((F.col("video_id") == 2) & (F.col("t") == 1), F.array(*[F.lit(0.5)] * 5)).otherwise(F.col("emb")))
    assert all(k.join(keys, "cache_key").count() == 0 for k in other)
    asked = []

    def make(rest):
        asked.extend(sorted({r["video_id"] for r in rest.collect()}))
        return rest.select("video_id", "t", F.lit(0.0).alias("score"), F.array(F.lit(0.0)).alias("map"))

    cache = frames.select("video_id", "t", F.lit(1.0).alias("score"), F.array(F.lit(1.0)).alias("map")).join(keys.select("video_id", "cache_key"), "video_id")
    cache = cache.where("NOT (video_id = 3 AND t = 2)")  # breaks off
    got = patches.handed_over(changed, patches.content_keys(changed, {"model": "m"}, words), cache, make).collect()
    assert asked == [2, 3] and len(got) == 12
    assert {(r["video_id"], r["from_cache"], r["score"]) for r in got} == {(1, True, 1.0), (2, False, 0.0), (3, False, 0.0), (4, True, 1.0)}


@pytest.mark.parametrize(("settings", "version"), [({}, "v1"), ({"_target_": "a.selection_v1.f"}, "v1"), ({"_target_": "a.selection_v3.f"}, "v4"), ({"_target_": "selection_v5"}, "v4"), ({"patch_score_threshold": 0.0}, "v4"), ({"_target_": "selection_v2", "patch_score_threshold": None}, "v1")])
def test_version_follows_settings(settings, version):
    assert patches.version_for(settings) == version


def test_select_by_settings(spark):
    maps = spark.createDataFrame([(1, t, 0.5, [0.1 * t, 0.2, 0.9, 0.4]) for t in range(3)], "video_id long, t long, score double, map array<double>")
    assert patches.select_by_settings(maps, {}).groupBy("t").count().where("count = 2").count() == 3
    found = patches.select_by_settings(maps, {"total_budget": 2, "patch_score_threshold": 0.8})
    assert [(r["token"], r["score"]) for r in found.collect()] == [(2, 0.9)] * 2


def test_duplication_round_trip(spark):
    frames = spark.createDataFrame([(v, t, v * 100 + t // f) for v, n, f in ((1, 6, 3), (2, 6, 2), (3, 5, 1), (4, 4, 2), (5, 4, 1)) for t in range(n)], "video_id long, t long, x long")
    notes = spark.createDataFrame([(1, True, 3, 2), (2, True, 2, 3), (3, True, 2, 3), (4, False, 2, 2), (5, None, None, None)], "video_id long, applied boolean, duplicate_factor int, original_num_frames int")
    scored = patches.scoring_frames(frames, notes)
    assert {r["video_id"]: (r["duplicate_factor"], r["count"]) for r in scored.groupBy("video_id", "duplicate_factor").count().collect()} == {1: (3, 2), 2: (2, 3), 3: (1, 5), 4: (1, 4), 5: (1, 4)}
    again = patches.expanded_scores(scored)
    assert sorted(map(tuple, again.select("video_id", "t", "x").collect())) == sorted(map(tuple, frames.collect()))
    assert sorted(r["frame_index"] for r in sampling.strided_sample(spark.createDataFrame([(1, 7), (2, 0)], "video_id long, total long"), 3).collect()) == [0, 3, 6]


@pytest.fixture(scope="module")
def tokens(spark):
    return spark.createDataFrame([(v, i, float(10 * v + i)) for v in (1, 2) for i in range(3)], "video_id long, index long, feature double")


class Output:
    def __init__(self, indices, features):
        self.selected_indices, self.selected_features = indices, features


def test_selector_forms(spark, tokens):
    rows = lambda df: sorted(map(tuple, df.collect()))
    keys = ["video_id"]
    assert rows(registry.normalised(None, tokens, keys)) == [(v, i, i, 10.0 * v + i) for v in (1, 2) for i in range(3)]
    listed = [(v, p, i, 10.0 * v + i) for v in (1, 2) for p, i in enumerate((2, 0))]
    assert rows(registry.normalised([2, 0], tokens, keys)) == rows(registry.normalised({"selected_indices": (2, 0), "note": 1}, tokens, keys)) == rows(registry.normalised(Output([2, 0], None), tokens, keys)) == listed
    assert rows(registry.normalised([], tokens, keys)) == []
    some = tokens.where("index > 0").select("video_id", "index")
    assert rows(registry.normalised(some, tokens, keys)) == [(v, i - 1, i, 10.0 * v + i) for v in (1, 2) for i in (1, 2)]
    made = spark.createDataFrame([(1, 0, 5.0), (1, 1, 6.0), (2, 0, 7.0)], "video_id long, position long, feature double")
    assert rows(registry.normalised(made, tokens, keys)) == [(1, 0, 0, 5.0), (1, 1, 1, 6.0), (2, 0, 0, 7.0)]
    two = spark.createDataFrame([(1, 0, 2), (1, 1, 0), (2, 0, 1)], "video_id long, position long, index long")
    assert rows(registry.normalised(Output(two, made), tokens, keys)) == [(1, 0, 2, 5.0), (1, 1, 0, 6.0), (2, 0, 1, 7.0)]
    with pytest.raises(Exception, match="differ in number"):
        registry.normalised(Output(two.limit(2), made), tokens, keys).collect()
    for wrong in ([3], [-1], two.withColumn("index", F.lit(None).cast("long")), two.withColumn("video_id", F.lit(9))):
        with pytest.raises(Exception, match="out of bounds"):
            registry.normalised(wrong, tokens, keys).collect()
    for wrong, error in (("abc", TypeError), (3, TypeError), ({}, ValueError), (tokens.select("video_id"), TypeError)):
        with pytest.raises(error):
            registry.normalised(wrong, tokens, keys)


def test_call_tokens(tokens):
    registry.selector("first_token")(lambda tokens, n=1: list(range(n)))
    registry.selector("none_at_all")(lambda tokens: None)
    assert registry.call_tokens("first_token", tokens, ["video_id"], n=2, unknown=3).count() == 4
    assert registry.call_tokens("none_at_all", tokens, ["video_id"]).count() == 6


def test_frame_selector_forms(spark):
    frames = spark.createDataFrame([(v, t, f"{v}-{t}") for v in (1, 2) for t in range(4)], "video_id long, t long, image string")
    keys = ["video_id"]
    rows = lambda x: sorted((r["video_id"], r["position"], r["t"], r["image"], r["num_frames"]) for r in registry.normalised_frames(x, frames, keys).collect())
    assert rows(None) == rows({"frames": None}) == rows([]) == []
    assert rows([3, 0, 3]) == rows({"frames": [3, 0, 3], "note": 1}) == [(v, p, t, f"{v}-{t}", 3) for v in (1, 2) for p, t in enumerate((3, 0, 3))]
    some = spark.createDataFrame([(1, 2, 5), (1, 0, 9)], "video_id long, t long, position long")
    assert rows(some) == [(1, 0, 2, "1-2", 2), (1, 1, 0, "1-0", 2)]
    assert rows(some.drop("position")) == [(1, 0, 0, "1-0", 2), (1, 1, 2, "1-2", 2)]
    with pytest.raises(Exception, match="no frame 4"):
        rows([4])
    for wrong in ("abc", 3, frames.select("video_id")):
        with pytest.raises(TypeError):
            registry.normalised_frames(wrong, frames, keys)
    registry.selector("first_frame")(lambda frames: [0])
    assert registry.call_frames("first_frame", frames, keys).count() == 2
