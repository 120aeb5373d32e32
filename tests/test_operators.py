"""Small hand-made cases and invariants of the operators."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievegrid.functions import text, vectors
from sievegrid.operators import budget, evaluate, grid, parsing, ranking, registry, sampling, sync, tokens


@pytest.mark.parametrize(("total", "n", "expected"), [(10, 4, [0, 3, 6, 9]), (3, 8, [0, 1, 2]), (9, 1, [4]), (6, 3, [0, 2, 5]), (0, 4, [])])
def test_sample_indices(spark, total, n, expected):
    df = spark.range(1).select(sampling.sample_indices(F.lit(total), n).alias("i"))
    assert df.first()["i"] == expected


def test_segments(spark):
    centers = spark.createDataFrame([(1, p, 10 * p, 16) for p in (7, 2, 12, 7)], "video_id long, pool_index long, t long, pool_size long")
    got = ranking.segments(centers).orderBy("segment_index")
    assert [tuple(r)[1:] for r in got.collect()] == [(0, 0, 4, 2, 20), (1, 5, 9, 7, 70), (2, 10, 15, 12, 120)]


def plain_peaks(vectors, neighbours=5):
    """Ranks of one pool, pair by pair."""
    unit = [v / np.linalg.norm(v) for v in vectors]
    n = len(unit)
    d = [[round(max(0.0, 1 - float(a @ b)), 12) for b in unit] for a in unit]
    rho = [round(sum(np.exp(-x * x) for x in sorted(d[i][j] for j in range(n) if j != i)[:neighbours]), 12) for i in range(n)]
    delta = [min([d[i][j] for j in range(n) if rho[j] > rho[i]], default=max(d[i][j] for j in range(n) if j != i)) for i in range(n)]
    value = [round(rho[i] * delta[i] - 1e-6 * i / (n - 1), 10) for i in range(n)]
    return sorted(range(n), key=lambda i: (-value[i], i))


def test_long_video_in_two_index_spaces(spark):
    """Of 2,000 frames 40 are the pool: bias, boundaries and history go by places in it, the output names both."""
    r = np.random.default_rng(5)
    base = r.normal(size=(7, 16))
    emb = base[r.integers(0, 7, 2000)]  # many equal frames: the bias decides between them
    rows = [(1, int(t), [float(x) for x in emb[t]], float(t % 10) / 10, [float(t)]) for t in r.permutation(2000)]
    frames = spark.createDataFrame(rows, "video_id long, t long, emb array<double>, score double, map array<double>")
    picked = [round(i * 1999 / 39) for i in range(40)]
    order = plain_peaks([emb[t] for t in picked])
    ranked = ranking.density_rank(ranking.pool(frames, 40), also=["score", "map"])
    got = ranked.orderBy("center_rank").collect()
    assert [x["pool_index"] for x in got] == order
    assert all(x["t"] == picked[x["pool_index"]] and x["map"] == [float(x["t"])] for x in got)

    score = [t % 10 / 10 for t in picked]
    steps = [(k, sorted(order[:k]), sum(score[i] >= 0.75 for i in order[:k])) for k in (4, 8, 12)]
    last = next((i for i, x in enumerate(steps) if x[2] >= 4), 2)
    history = ranking.escalation(ranked, 4, 0.75).orderBy("step").collect()
    assert [(x["requested_k"], x["center_pool_indices"], x["high_count"]) for x in history] == steps[: last + 1]

    centers = steps[last][1]
    cut = [0, *[(a + b) // 2 + 1 for a, b in zip(centers, centers[1:], strict=False)], 40]
    final = ranking.final_centers(ranked, 4, 0.75)
    found = ranking.segments(final).orderBy("segment_index").collect()
    assert [tuple(x)[2:] for x in found] == [(a, b - 1, c, picked[c]) for a, b, c in zip(cut, cut[1:], centers, strict=False)]

    chosen = sorted(sorted(centers, key=lambda i: (-score[i], i))[:4])
    out = ranking.selection(ranking.escalating_select(ranked, 4, 0.75, also=["map"]), ranking.segments(final)).orderBy("position").collect()
    assert [(x["pool_index"], x["t"], x["segment_index"], x["map"]) for x in out] == [(i, picked[i], centers.index(i), [float(picked[i])]) for i in chosen]
    summary = ranking.selection_summary(ranked, 4, 0.75).first()
    assert (summary["selected_pool_indices"], summary["selected_original_indices"], summary["center_pool_indices"]) == (chosen, [picked[i] for i in chosen], centers)
    assert summary["selected_segment_indices"] == [centers.index(i) for i in chosen] and summary["fallback_used"] == (steps[last][2] < 4)


def test_pad_from_centers(spark):
    schema = "video_id long, t long, score double"
    centers = spark.createDataFrame([(1, 3, 0.9), (1, 8, 0.4), (2, 1, 0.1), (2, 5, 0.2)], schema)
    got = ranking.pad(centers.where("score > 0.8"), 3, centers).orderBy("video_id", "slot").collect()
    assert [(r["video_id"], r["t"], r["padded"]) for r in got] == [(1, 3, False), (1, 3, True), (1, 3, True), (2, 5, True), (2, 1, True), (2, 5, True)]


def test_pad(spark):
    got = ranking.pad(spark.createDataFrame([(1, 3, 0.9), (1, 8, 0.4)], "video_id long, t long, score double"), 5).orderBy("slot").collect()
    assert [r["t"] for r in got] == [3, 8, 3, 8, 3]
    assert [r["padded"] for r in got] == [False, False, True, True, True]


def plain_allocation(scores, capacities, total, temperature):
    """The loop that the windows replace."""
    import math

    n, left, quota = len(scores), min(total, sum(capacities)), [0.0] * len(scores)
    active = {i for i in range(n) if capacities[i] > 0}
    while active and left > 0:
        top = max(scores[i] for i in range(n) if capacities[i] > 0)
        e = {i: math.exp((scores[i] - top) / temperature) for i in active}
        s = sum(e.values())
        full = {i for i in active if left * e[i] / s >= capacities[i] - 1e-12}
        for i in full or active:
            quota[i] = capacities[i] if full else left * e[i] / s
        if not full:
            break
        left -= sum(capacities[i] for i in full)
        active -= full
    out = [int(round(q, 9)) for q in quota]
    order = sorted((i for i in range(n) if out[i] < capacities[i]), key=lambda i: (-round(quota[i] - out[i] + 1e-6 * scores[i], 9), i))
    for i in order[: min(total, sum(capacities)) - sum(out)]:
        out[i] += 1
    return out


def test_allocation(spark):
    random.seed(3)
    cases = [([0.5] * 3, [1, 10, 10], 7), ([0.1, 0.2], [0, 3], 10), ([0.3], [0], 4)]
    cases += [([random.random() for _ in range(k)], [random.randint(0, 9) for _ in range(k)], random.randint(1, 40)) for k in (random.randint(1, 12) for _ in range(60))]
    rows = [(v, t, s, c, b) for v, (ss, cs, b) in enumerate(cases) for t, (s, c) in enumerate(zip(ss, cs, strict=True))]
    got = {}
    for r in budget.allocate(spark.createDataFrame(rows, "video_id int, t int, score double, capacity long, budget long"), 0.5).collect():
        got.setdefault(r["video_id"], {})[r["t"]] = r["allocated"]
    for v, (ss, cs, b) in enumerate(cases):
        mine = [got[v][t] for t in range(len(ss))]
        assert mine == plain_allocation(ss, cs, b, 0.5)
        assert sum(mine) == min(b, sum(cs))
    assert [got[0][t] for t in range(3)] == [1, 3, 3]


def test_allocation_has_running_sums_only(spark):
    """A window from the current row to the end is summed anew for each row, so its time is quadratic in the frames of a video."""
    frames = spark.createDataFrame([(0, 0, 0.5, 3, 2)], "video_id int, t int, score double, capacity long, budget long")
    plan = budget.allocate(frames, 0.5)._jdf.queryExecution().optimizedPlan().toString()
    assert "specifiedwindowframe" in plan and "currentrow$(), unboundedfollowing$()" not in plan


def test_explicit_budget_above_tokens(spark):
    with pytest.raises(Exception, match="budget above"):
        spark.range(1).select(budget.total_budget(F.lit(5), 0.5, 6)).collect()


@pytest.mark.parametrize(("response", "index", "method"), [("", None, "empty_response"), ("Answer: 10", None, "unparsed"), ("!!!", 0, "substring_match"), ("a dog", 0, "letter_regex"), ("Option 2", 2, "index_regex"), ("it is grey", 1, "substring_match"), ("the rid horse", 2, "fuzzy_match")])
def test_index_first(spark, response, index, method):
    df = spark.createDataFrame([(response, ["blue", "grey", "the red horse"])], "response string, options array<string>")
    got = parsing.parse_index_first(df, fuzzy=True).first()
    assert (got["prediction"], got["parse_method"]) == (index, method)


@pytest.mark.parametrize(("response", "letter", "method"), [("4", "D", "one_based_index_regex"), ("0", "A", "index_regex"), ("(b)", "B", "letter_regex"), ("zzz", "zzz", "raw_response"), (None, "", "empty_response")])
def test_letter_first(spark, response, letter, method):
    df = spark.createDataFrame([(response, ["one", "two", "three", "four"])], "response string, options array<string>")
    got = parsing.parse_letter_first(df).first()
    assert (got["letter"], got["parse_method"]) == (letter, method)


def test_bilinear_identity_and_edges(spark):
    assert grid.axis_weights(2, 4) == [(0, 0, 1.0), (0, 1, 0.0), (1, 0, 0.75), (1, 1, 0.25), (2, 0, 0.25), (2, 1, 0.75), (3, 1, 1.0)]
    df = spark.createDataFrame([(0, 0, y, x, float(y * 4 + x)) for y in range(4) for x in range(4)], "video_id int, t int, y long, x long, score double")
    assert grid.bilinear(df, (4, 4), (4, 4)) is df
    assert {(r["y"], r["x"]): r["score"] for r in grid.block_pool(df, 2).collect()} == {(0, 0): 2.5, (0, 1): 4.5, (1, 0): 10.5, (1, 1): 12.5}
    with pytest.raises(ValueError):
        grid.merged(df, (4, 4), "other")


def test_align_needs_full_steps(spark):
    df = spark.createDataFrame([(0, t, 0, 0, 1.0) for t in range(3)], "video_id int, t int, y int, x int, score double")
    with pytest.raises(Exception, match="don't fill"):
        sampling.align(df, 2).collect()


def test_clip_bounds(spark):
    frames = spark.range(10).select(F.lit(1).alias("video_id"), F.col("id").alias("frame_index"))
    clips = spark.createDataFrame([(1, 1, 0.5, 1.5, 2.0), (1, 2, None, 1.0, 2.0), (1, 3, 3.0, 1.0, 2.0), (1, 4, 0.1, 0.2, None)], "video_id int, clip_id int, start double, end double, fps double")
    got = {k: sorted(x["frame_index"] for x in v) for k, v in _grouped(sampling.clip(frames, clips).collect(), "clip_id").items()}
    assert got == {1: [1, 2, 3] if round(0.5 * 2.0) == 1 else [], 2: [0, 1, 2], 3: list(range(10)), 4: [3, 4, 5, 6]}


def _grouped(rows, key):
    out = {}
    for r in rows:
        out.setdefault(r[key], []).append(r)
    return out


def test_duplicate_round_trip(spark):
    df = spark.createDataFrame([(1, 0), (1, 1)], "video_id int, t int")
    twice = sampling.duplicate(df, 3)
    assert sorted(r["t"] for r in twice.collect()) == list(range(6))
    assert sorted(r["t"] for r in sampling.undo_duplicate(twice, 3).collect()) == [0, 1]


def test_text_functions(spark):
    df = spark.createDataFrame([(" A  dog,\n’s ", "v1", "v1:3", "[A. one, B. two, three]", "https://x/y/abc.mp4?t=1", "f10.png")], "s string, v string, q string, o string, u string, f string")
    r = df.select(text.match_text(F.col("s")).alias("m"), text.question_uid(F.col("v"), F.col("q"), F.lit(0)).alias("uid"), text.split_options(F.col("o")).alias("o"), text.url_uid(F.col("u")).alias("u"), text.natural_key(F.col("f")).alias("n"), text.whole_number(F.lit("2.9")).alias("w"), text.whole_number(F.lit("true")).alias("b"), text.render(F.lit("{a} {b}"), {"a": F.lit("x")}).alias("p"), text.option_block(F.array(F.lit("p"), F.lit("q"))).alias("ob")).first()
    assert (r["m"], r["uid"], r["o"], r["u"], r["n"][1], r["w"], r["b"], r["p"], r["ob"]) == ("a dog s", "v1:3", ["one", "two, three"], "abc", "0" * 18 + "10", None, None, "x {b}", "Option 0: p\nOption 1: q")
    with pytest.raises(Exception, match="not a prediction"):
        spark.range(1).select(text.strict_prediction(F.lit("x"))).collect()


def test_noise(spark):
    df = spark.createDataFrame([([0.6, 0.8],)], "v array<double>")
    assert df.select(vectors.noisy(F.col("v"), 0).alias("v")).first()["v"] == [0.6, 0.8]
    a, b = (df.select(vectors.noisy(F.col("v"), 0.1, 5).alias("v")).first()["v"] for _ in range(2))
    assert a == b != [0.6, 0.8]
    assert abs(sum(x * x for x in a) - 1) < 1e-9


def test_prune(spark):
    seq = spark.createDataFrame([(1, 0, None), (1, 1, 0), (1, 2, 1), (1, 3, None)], "v int, position int, video_index int")
    got = tokens.prune(seq, spark.createDataFrame([(1, 1)], "v int, video_index int"), ["v"]).orderBy("new_position").collect()
    assert [(r["position"], r["new_position"]) for r in got] == [(0, 0), (2, 1), (3, 2)]


def test_sync_plan(spark):
    remote = spark.createDataFrame([("a", True), ("a/keep", True), ("a/keep/x.txt", False), ("a/b.txt", False), ("c", True), ("c/d.log", False), ("e", True)], "rel_path string, is_folder boolean")
    local = spark.createDataFrame([("n.py",)], "rel_path string")
    got = {(r["action"], r["rel_path"]) for r in sync.plan(local, remote, ["keep/", "*.log"]).collect()}
    assert got == {("upload", "n.py"), ("preserve", "a"), ("preserve", "a/keep"), ("preserve", "a/keep/x.txt"), ("delete", "a/b.txt"), ("preserve", "c"), ("preserve", "c/d.log"), ("delete", "e")}


def test_last_wins_and_paths(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, 6), ("b", 1, 7)], "q_uid string, line int, prediction int")
    assert {(r["q_uid"], r["prediction"]) for r in evaluate.last_wins(df, "q_uid", "line").collect()} == {("a", 6), ("b", 7)}
    listing = spark.createDataFrame([("x", "/p/x.mp4"), ("y", "/p/y.mp4")], "key string, path string")
    samples = spark.createDataFrame([("z", "y"), ("x", "y"), ("q", "r")], "a string, b string")
    got = evaluate.resolve_paths(samples, listing, [F.col("a"), F.col("b")])
    assert {(r["a"], r["path"]) for r in got.collect()} == {("z", "/p/y.mp4"), ("x", "/p/x.mp4"), ("q", None)}


def test_metric_summary_of_nulls(spark):
    df = spark.createDataFrame([(None,), (None,)], "m double")
    r = evaluate.metric_summary(df, ["m"]).first()
    assert (r["samples"], r["average"]) == (0, None)


def test_selectors(spark):
    @registry.selector("few")
    def few(df, n):
        return df.limit(n)

    @registry.selector("all")
    def every(df):
        return None

    df = spark.range(5)
    assert registry.call("few", df, n=2, other=1).count() == 2
    assert registry.call("all", df).count() == 5


def frame(t, score, values, video=1):
    return (video, t, score, [float(v) for v in values])


def test_budget_versions(spark):
    rows = [frame(0, 0.9, [1, 5, 5, -1]), frame(1, 0.1, [0, -2, -3, -4]), frame(2, 0.5, [2, 2, 2, 2])]
    df = spark.createDataFrame(rows, "video_id int, t int, score double, map array<double>")
    kept = lambda version, **p: {r["t"]: r["keep"] for r in budget.budget_frames(df, version, 0.5, 0.0, 0.1, **p).collect()}
    assert kept("v1") == {0: 2, 1: 2, 2: 2}
    assert kept("v2") == {0: 4, 1: 0, 2: 2} and kept("v3") == kept("v4") == {0: 3, 1: 0, 2: 3}
    assert kept("v4", explicit=8) == {0: 3, 1: 1, 2: 4}
    chosen = budget.select(budget.budget_frames(df, "v4", 0.5, 0.0, 0.1), 0.0).where("t = 0").collect()
    assert {(r["token"], r["score"]) for r in chosen} == {(1, 5.0), (2, 5.0), (0, 1.0)}
    with pytest.raises(Exception, match="above its eligible"):
        budget.select(budget.budget_frames(df, "v2", 0.5, temperature=0.1), 0.0).collect()
    for wrong in ({"ratio": 0.0}, {"ratio": 1.5}, {"ratio": 0.5, "explicit": 0}):
        with pytest.raises(ValueError):
            budget.budget_frames(df, "v4", **wrong)
    with pytest.raises(ValueError):
        budget.budget_frames(df, "v6", 0.5)
    tokens_ = spark.createDataFrame([(1, t, k, v) for _, t, _, m in rows for k, v in enumerate(m)], "video_id int, t int, token int, score double").repartition(3)
    assert sorted(map(tuple, budget.frame_maps(tokens_, df).select("video_id", "t", "score", "map").collect())) == rows


def test_density_needs_a_pool(spark):
    many = spark.range(30).selectExpr("1 AS video_id", "id AS t", "array(id + 1.0D, 2.0D) AS emb")
    with pytest.raises(Exception, match="more than 20 frames"):
        ranking.density_rank(many, most=20).collect()
    pooled = ranking.pool(many, 4).orderBy("t").collect()
    assert [(r["pool_index"], r["t"]) for r in pooled] == [(0, 0), (1, 10), (2, 19), (3, 29)]
    alone = ranking.density_rank(many.where("t = 3")).first()
    assert (alone["rho"], alone["delta"], alone["center_rank"]) == (None, None, 1)
    with pytest.raises(Exception, match="too many queries"):
        ranking.checked_queries(many.selectExpr("emb AS query"), 5).collect()


def test_blocks_that_are_not_whole(spark):
    df = spark.createDataFrame([(0, 0, y, x, 1.0) for y in range(5) for x in range(5)], "video_id int, t int, y long, x long, score double")
    with pytest.raises(Exception, match="don't fill the blocks"):
        grid.block_pool(df, 2).collect()
    with pytest.raises(ValueError):
        grid.merged(df, (5, 5), "sliding_window", 2, 2, 1)
    with pytest.raises(ValueError, match="uncovered"):
        grid.merged(df, (6, 6), "sliding_window", 2, 2, 4)
    one = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0],)], "m array<double>")
    assert one.select(grid.pooled(F.col("m"), 2, 2, 2).alias("p")).first()["p"] == [2.5]
    with pytest.raises(Exception, match="another size"):
        one.select(grid.pooled(F.col("m"), 4, 4, 2)).collect()


def test_grids(spark):
    df = spark.createDataFrame([(1, [[2, 3, 4]], [9, 9, 9]), (2, [[2], [3], [4]], None), (3, None, [5, 6, 7])], "i int, a array<array<long>>, b array<long>")
    got = df.select("i", grid.grid_shape(F.col("a"), F.col("b")).alias("g")).orderBy("i").collect()
    assert [tuple(r["g"]) for r in got] == [(2, 3, 4), (2, 3, 4), (5, 6, 7)]
    with pytest.raises(Exception, match="no grid"):
        spark.range(1).select(grid.grid_shape(F.lit(None).cast("array<array<long>>"), F.lit(None).cast("array<long>"))).collect()
    raw = spark.createDataFrame([(0, 0, 0, 0.5), (0, 0, 1, 0.7)], "y int, x int, query_idx int, score double")
    assert [tuple(r) for r in grid.score_grid(raw, raw, "raw").collect()] == [(0, 0, 0.7)]
    assert [tuple(r) for r in grid.score_grid(raw, raw, "raw", 0).collect()] == [(0, 0, 0.5)]
    assert grid.score_grid(raw, raw, "merged") is raw


def test_ignore_rules(spark):
    """By the rules of ignore files: (pattern lines, paths that are ignored, paths that aren't); folders end with a slash."""
    cases = [
        (["*.log"], ["a.log", "d/a.log", "a.log/x"], ["a.logs", "log"]),
        (["keep/"], ["keep/", "keep/x", "d/keep/x"], ["keep", "d/keep"]),
        (["/top"], ["top", "top/x", "top/"], ["d/top"]),
        (["a/b"], ["a/b", "a/b/c"], ["d/a/b"]),
        (["**/x"], ["x", "d/x", "d/e/x"], ["xx"]),
        (["d/**"], ["d/e", "d/e/f"], ["d", "e/d/f"]),
        (["a/**/b"], ["a/b", "a/x/b", "a/x/y/b"], ["b", "x/a/b"]),
        (["f?[0-9]", "# no"], ["fa1", "d/fb2"], ["f1", "fa1x", "# no"]),
        (["f[!0-9]"], ["fa"], ["f1"]),
        (["*.txt", "!good.txt"], ["a.txt"], ["good.txt", "d/good.txt"]),
        (["", "  "], [], ["a"]),
        (["a.b+c"], ["a.b+c"], ["aXb+c", "a.bbc"]),
    ]
    for patterns, yes, no in cases:
        paths = spark.createDataFrame([(p.rstrip("/"), p.endswith("/")) for p in yes + no], "path string, folder boolean")
        got = paths.select(sync.ignored(F.col("path"), patterns, F.col("folder")).alias("i")).collect()
        assert [r["i"] for r in got] == [True] * len(yes) + [False] * len(no), patterns


def test_lookup_by_keys(spark):
    files = [("/r/v/One_1.5_20.MP4", "v/One_1.5_20.MP4", True), ("/r/w/two.mp4", "w/two.mp4", True), ("/r/x/two.mkv", "x/two.mkv", True), ("/r/frames.d", "frames.d", False)]
    listing = spark.createDataFrame(files, "path string, rel_path string, is_file boolean")
    samples = lambda *names: spark.createDataFrame([(n,) for n in names], "video string")
    got = {r["video"]: r["path"] for r in evaluate.lookup(samples("one", "v/one_1.5_20", "ONE.avi", "w/Two", "frames.d"), listing, "video").collect()}
    assert got == {"one": files[0][0], "v/one_1.5_20": files[0][0], "ONE.avi": files[0][0], "w/Two": files[1][0], "frames.d": files[3][0]}
    for name, message in (("two", "ambiguous"), ("three", "no video")):
        with pytest.raises(Exception, match=message):
            evaluate.lookup(samples(name), listing, "video").collect()
    assert [r["video"] for r in evaluate.lookup(samples("two", "three", "one"), listing, "video", skip=True).collect()] == ["one"]


def test_prune_of_unknown_index(spark):
    seq = spark.createDataFrame([(1, 0, None), (1, 1, 0)], "v int, position long, video_index int")
    with pytest.raises(Exception, match="no token has the index 9"):
        tokens.prune(seq, spark.createDataFrame([(1, 9)], "v int, video_index int"), ["v"]).collect()
