"""Queries on frames, score maps and budgets. Embeddings stand in for video frames, events for clips (sources/canonical.py)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievegrid.functions.vectors import noisy, unit
from sievegrid.operators import budget, diagnostics, grid, maps, patches, ranking, registry, sampling, selectors, tokens  # noqa: F401  selectors registers itself
from sievegrid.plans.registry import query
from sievegrid.sources import canonical

FRAME = "frame AS (SELECT label::BIGINT AS video_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS t, vec_id, embedding::DOUBLE[] AS emb FROM embeddings)"
SCORE = FRAME + ", score AS (SELECT video_id, t, pos // 8 AS y, pos % 8 AS x, emb[pos + 1] AS score FROM frame, range(64) AS r(pos))"
TOKEN = SCORE + ", token AS (SELECT video_id, t, (y // 2) * 4 + x // 2 AS token, avg(score) AS score FROM score GROUP BY ALL)"
RATIO, THRESHOLD, TEMPERATURE = 0.3, 0.05, 0.5


def token_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """video_id, t, token, score: 4 by 4 tokens of each 8 by 8 map."""
    pooled = grid.block_pool(canonical.scores(canonical.frames(spark, sf_dir)), 2)
    return pooled.select("video_id", "t", (F.col("y") * 4 + F.col("x")).alias("token"), "score")


def frame_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """video_id, t, score, map: similarity of the whole frame with the queries, and the scores of its 4 by 4 tokens."""
    scored = ranking.with_query_scores(canonical.frames(spark, sf_dir), canonical.queries(spark, sf_dir))
    return scored.select("video_id", "t", F.round("score", 9).alias("score"), grid.pooled(F.col("emb"), 8, 8, 2).alias("map"))


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def allocation(source: str, capacity: str, total: str, out: str) -> str:
    """CTEs that deal `total` of each video over the frames of `source` within `capacity`; the result is in {out}."""
    return f"""
    {out}_a AS (SELECT *, least({total}, sum({capacity}) OVER (PARTITION BY video_id)) AS b_,
        CASE WHEN {capacity} > 0 THEN greatest(exp((score - max(CASE WHEN {capacity} > 0 THEN score END) OVER (PARTITION BY video_id)) / {TEMPERATURE}), 1e-300) ELSE 0 END AS e_ FROM {source}),
    {out}_b AS (SELECT *, CASE WHEN {capacity} > 0 THEN {capacity} / e_ ELSE 0 END AS r_ FROM {out}_a),
    {out}_c AS (SELECT *, (b_ - coalesce(sum({capacity}) OVER (PARTITION BY video_id ORDER BY r_, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / nullif(sum(e_) OVER (PARTITION BY video_id ORDER BY r_, t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS l_ FROM {out}_b),
    {out}_d AS (SELECT *, {capacity} = 0 OR coalesce(round(l_ - r_, 9) >= 0, true) AS full_ FROM {out}_c),
    {out}_e AS (SELECT *, round(CASE WHEN full_ THEN least({capacity}, b_)::DOUBLE ELSE max(CASE WHEN NOT full_ THEN l_ END) OVER (PARTITION BY video_id) * e_ END, 9) AS q_ FROM {out}_d),
    {out}_f AS (SELECT *, CASE WHEN floor(q_) < {capacity} THEN round(q_ - floor(q_) + 1e-6 * score, 9) END AS k_ FROM {out}_e),
    {out}_g AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY k_ DESC NULLS LAST, t) AS n_, b_ - sum(floor(q_)) OVER (PARTITION BY video_id) AS left_ FROM {out}_f),
    {out} AS (SELECT * EXCLUDE (b_, e_, r_, l_, full_, q_, k_, n_, left_), (floor(q_) + CASE WHEN k_ IS NOT NULL AND n_ <= left_ THEN 1 ELSE 0 END)::BIGINT AS {out}_n FROM {out}_g)"""


COSINES = FRAME + """, q AS (SELECT vec_id AS query_idx, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id < 3),
    cosine AS (SELECT video_id, t, list_dot_product(emb, q) / (greatest(sqrt(list_dot_product(emb, emb)), 1e-12) * greatest(sqrt(list_dot_product(q, q)), 1e-12)) AS c FROM frame, q),
    rel AS (SELECT video_id, t, round(max(c), 9) AS score FROM cosine GROUP BY ALL)"""


def frame_budget(token: str, total: str) -> str:
    """CTEs from tokens to f: per frame its own score, those of its tokens, and the video's budget."""
    return f"""{token}, {COSINES.removeprefix(FRAME + ', ')},
    f0 AS (SELECT video_id, t, min(score) AS score_min, max(score) AS score_max, count(*) FILTER (WHERE score >= {THRESHOLD}) AS eligible, count(*) AS tokens FROM token GROUP BY ALL),
    f AS (SELECT f0.*, rel.score, {total} AS budget FROM f0 JOIN rel USING (video_id, t))"""


FRAME_BUDGET = frame_budget(TOKEN, f"greatest(1, ceil(round(sum(tokens) OVER (PARTITION BY video_id) * {RATIO}, 9)))::BIGINT")
V4 = f"WITH {FRAME_BUDGET}, {allocation('f', 'eligible', 'budget', 'v4')}"
RANKED = "ranked AS (SELECT video_id, t, token, score, row_number() OVER (PARTITION BY video_id, t ORDER BY score DESC, token) AS n FROM token)"
ELIGIBLE = RANKED.replace("FROM token", f"FROM token WHERE score >= {THRESHOLD}")
KEPT = "SELECT ranked.video_id, ranked.t, token, round(ranked.score, 6) AS score FROM ranked"


@query(f"{V4}, {ELIGIBLE} {KEPT} JOIN v4 USING (video_id, t) WHERE n <= v4_n")
def budget_v4_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = budget.budget_frames(frame_maps(spark, sf_dir), "v4", RATIO, THRESHOLD, TEMPERATURE)
    return rounded(budget.select(f, THRESHOLD), "score")


@query(f"WITH {TOKEN}, {RANKED} {KEPT} WHERE n <= greatest(1, ceil(round(16 * {RATIO}, 9)))")
def budget_v1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(budget.select(budget.budget_frames(frame_maps(spark, sf_dir), "v1", RATIO)), "score")


@query(f"WITH {FRAME_BUDGET}, {allocation('f', 'tokens', 'budget', 'v2')}, {RANKED} {KEPT} JOIN v2 USING (video_id, t) WHERE n <= v2_n")
def budget_v2_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(budget.select(budget.budget_frames(frame_maps(spark, sf_dir), "v2", RATIO, temperature=TEMPERATURE)), "score")


V3 = f"""WITH {FRAME_BUDGET}, {allocation('f', 'tokens', 'budget', 'v3')}, cut AS (SELECT *, least(v3_n, eligible) AS initial FROM v3),
    room AS (SELECT *, eligible - initial AS room, sum(v3_n) OVER (PARTITION BY video_id) - sum(initial) OVER (PARTITION BY video_id) AS rest FROM cut), {allocation('room', 'room', 'rest', 'again')}"""


@query(f"""{V3} SELECT video_id, t, eligible, budget, v3_n AS allocated, initial AS initial_keep, again_n AS reallocated, initial + again_n AS keep FROM again""")
def budget_v3_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = budget.budget_frames(frame_maps(spark, sf_dir), "v3", RATIO, THRESHOLD, TEMPERATURE)
    return f.select("video_id", "t", "eligible", "budget", "allocated", "initial_keep", "reallocated", "keep")


@query(f"{V3}, {ELIGIBLE} {KEPT} JOIN again USING (video_id, t) WHERE n <= initial + again_n")
def budget_v3_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = budget.budget_frames(frame_maps(spark, sf_dir), "v3", RATIO, THRESHOLD, TEMPERATURE)
    return rounded(budget.select(f, THRESHOLD), "score")


@query(f"""WITH {frame_budget(TOKEN, '40')}, {allocation('f', 'eligible', 'budget', 'v4')},
    w AS (SELECT *, CASE WHEN eligible > 0 THEN exp((score - max(CASE WHEN eligible > 0 THEN score END) OVER (PARTITION BY video_id)) / {TEMPERATURE}) ELSE 0 END AS e FROM v4)
    SELECT video_id, t, eligible, budget::BIGINT AS budget, v4_n AS keep, round(e / nullif(sum(e) OVER (PARTITION BY video_id), 0), 6) AS weight FROM w""")
def budget_explicit(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = budget.budget_frames(frame_maps(spark, sf_dir), "v4", RATIO, THRESHOLD, TEMPERATURE, explicit=40)
    f = f.withColumn("weight", F.round(budget.softmax_weight(F.col("score"), F.col("eligible"), TEMPERATURE), 6))
    return f.select("video_id", "t", "eligible", "budget", "keep", "weight")


@query(f"""{V4} SELECT video_id, count(*) AS frames, sum(tokens)::BIGINT AS tokens, max(budget) AS budget, sum(eligible)::BIGINT AS eligible, sum(v4_n)::BIGINT AS selected, 0::BIGINT AS reallocated,
    round(min(score_min), 6) AS score_min, round(max(score_max), 6) AS score_max, least(max(budget), sum(eligible))::BIGINT AS allocatable,
        (max(budget) - sum(v4_n))::BIGINT AS underfilled FROM v4 GROUP BY video_id""")
def budget_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = budget.budget_frames(frame_maps(spark, sf_dir), "v4", RATIO, THRESHOLD, TEMPERATURE)
    return rounded(budget.metadata(f), "score_min", "score_max")


@query(f"{V4}, {ELIGIBLE} {KEPT} JOIN v4 USING (video_id, t) WHERE n <= v4_n")
def selector_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A selector of the library, called by its name; a parameter that it doesn't take is left out."""
    parameters = {"ratio": RATIO, "threshold": THRESHOLD, "temperature": TEMPERATURE, "device": "none"}
    return rounded(registry.call("tokens_v4", frame_maps(spark, sf_dir), **parameters), "score")


@query(f"""{V4}, {RANKED}, eligible_rank AS (SELECT *, score >= {THRESHOLD} AS eligible FROM ranked)
    SELECT r.video_id, r.t, token, token // 4 AS y, token % 4 AS x, round(r.score, 6) AS score, r.eligible, r.eligible AND n <= v4_n AS selected, round(v4.score, 6) AS frame_score, v4_n AS keep
    FROM eligible_rank r JOIN v4 USING (video_id, t)""")
def selection_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tokens with what the selection did to them, no model needed."""
    f = budget.budget_frames(frame_maps(spark, sf_dir), "v4", RATIO, THRESHOLD, TEMPERATURE)
    return rounded(diagnostics.selection_rows(f, 4, THRESHOLD), "score", "frame_score")


@query(f"""WITH {FRAME}, own AS (SELECT video_id, emb AS q FROM frame WHERE t IN (0, 5))
    SELECT video_id, t, round(max(list_dot_product(emb, q) / (greatest(sqrt(list_dot_product(emb, emb)), 1e-12) * greatest(sqrt(list_dot_product(q, q)), 1e-12))), 6) AS score
    FROM frame JOIN own USING (video_id) GROUP BY ALL""")
def own_query_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries that differ by video, in one job: two frames of each stand in for its query file."""
    frames = canonical.frames(spark, sf_dir)
    own = frames.where(F.col("t").isin(0, 5)).select("video_id", F.col("emb").alias("query"))
    return rounded(ranking.with_own_query_scores(frames, own).select("video_id", "t", "score"), "score")


def blocks(frames: DataFrame, scale: float) -> DataFrame:
    """frames with patches: the 16 blocks of 2 by 2 values, each in a vector of all 64 places that is 0 elsewhere, times scale.

    Its dot product with a query is the block's part of the frame's, a stand-in for a patch's similarity with the query.
    """
    zeros = lambda n: [F.array_repeat(F.lit(0.0), n)] if n else []
    scaled = frames.withColumn("_e", F.transform("emb", lambda v: v * scale))
    at = [k // 4 * 16 + k % 4 * 2 for k in range(16)]
    own = lambda i: F.concat(*zeros(i), F.slice("_e", i + 1, 2), *zeros(6), F.slice("_e", i + 9, 2), *zeros(54 - i))
    return scaled.withColumn("patches", F.array(*[own(i) for i in at])).drop("_e")


def query_maps(spark: SparkSession, sf_dir: str, noise: float = 0.0) -> DataFrame:
    """video_id, t, score, map: scores of tokens under noisy queries, the best one each, of frames under the clean ones."""
    clean = canonical.queries(spark, sf_dir)
    frames = ranking.with_query_scores(canonical.frames(spark, sf_dir), clean)
    noisy_ones = clean.withColumn("query", unit(noisy(unit(F.col("query")), noise, 7)))
    both = patches.patch_scores(blocks(frames, 16.0).select("video_id", "t", "score", "patches"), noisy_ones, "max", cosine=False)
    return both.select("video_id", "t", F.round("score", 9).alias("score"), F.transform("map", lambda x: F.round(x, 9)).alias("map"))


QUERY_TOKEN = f"""{FRAME}, u AS (SELECT embedding::DOUBLE[] AS v, greatest(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 1e-12) AS n FROM embeddings WHERE vec_id < 3),
    part AS (SELECT video_id, t, row_number() OVER (PARTITION BY video_id, t) AS query_no, emb, v, n FROM frame, u),
    cell AS (SELECT video_id, t, query_no, pos // 16 * 4 + pos % 8 // 2 AS token, emb[pos + 1] * v[pos + 1] / n * 64 AS score FROM part, range(64) AS r(pos)),
    mean AS (SELECT video_id, t, query_no, token, avg(score) AS score FROM cell GROUP BY ALL),
    token AS (SELECT video_id, t, token, round(max(score), 9) AS score FROM mean GROUP BY ALL)"""


@query(f"""WITH {frame_budget(QUERY_TOKEN, f'greatest(1, ceil(round(sum(tokens) OVER (PARTITION BY video_id) * {RATIO}, 9)))::BIGINT')},
    {allocation('f', 'eligible', 'budget', 'v4')}, {ELIGIBLE} {KEPT} JOIN v4 USING (video_id, t) WHERE n <= v4_n""")
def budget_v5_without_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At a scale of 0 the fifth version is the fourth one."""
    f = budget.budget_frames(query_maps(spark, sf_dir), "v5", RATIO, THRESHOLD, TEMPERATURE)
    return rounded(budget.select(f, THRESHOLD), "score")


@query()
def noisy_query_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of patches under a noisy query, of frames under the clean one. Seeded hashes give the noise: no SQL twin."""
    f = budget.budget_frames(query_maps(spark, sf_dir, 0.01), "v5", RATIO, THRESHOLD, TEMPERATURE)
    return rounded(budget.select(f, THRESHOLD), "score")


@query(f"WITH {COSINES} SELECT video_id, t, round(max(c), 6) AS score FROM cosine GROUP BY ALL")
def frame_query_scores_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ranking.query_scores(canonical.frames(spark, sf_dir), canonical.queries(spark, sf_dir)), "score")


@query(f"WITH {COSINES} SELECT video_id, t, round(avg(c), 6) AS score FROM cosine GROUP BY ALL")
def frame_query_scores_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ranking.query_scores(canonical.frames(spark, sf_dir), canonical.queries(spark, sf_dir), "mean"), "score")


def query_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """video_id, t, query_idx, y, x, score of each block under each query: the maps of the queries one by one."""
    found = patches.patch_scores(blocks(canonical.frames(spark, sf_dir), 0.25).select("video_id", "t", "patches"), canonical.queries(spark, sf_dir), None, out="maps", cosine=False)
    each = found.select("video_id", "t", F.posexplode("maps").alias("query_idx", "map")).select("video_id", "t", F.col("query_idx").cast("long").alias("query_idx"), F.posexplode("map").alias("k", "score"))
    return rounded(each.select("video_id", "t", "query_idx", F.floor(F.col("k") / 4).alias("y"), (F.col("k") % 4).cast("long").alias("x"), "score"), "score", digits=9)


ROW_SCORES = f"""{FRAME}, q AS (SELECT vec_id AS query_idx, embedding[1:8]::DOUBLE[] AS q FROM embeddings WHERE vec_id < 3),
    row AS (SELECT video_id, t, patch, emb[patch * 8 + 1:patch * 8 + 8] AS v FROM frame, range(8) AS r(patch)),
    each AS (SELECT video_id, t, patch, query_idx, list_dot_product(v, q) / (greatest(sqrt(list_dot_product(v, v)), 1e-12) * greatest(sqrt(list_dot_product(q, q)), 1e-12)) AS c FROM row, q)"""


def _row_patches(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The eight rows of each map as patches, and queries of eight values."""
    rows = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.slice("emb", k * 8 + 1, 8))
    queries = canonical.queries(spark, sf_dir).withColumn("query", F.slice("query", 1, 8))
    return canonical.frames(spark, sf_dir).select("video_id", "t", rows.alias("patches")), queries


@query(f"WITH {ROW_SCORES} SELECT video_id, t, patch, round(max(c), 6) AS best, round(avg(c), 6) AS mean FROM each GROUP BY ALL")
def patch_query_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosines of patches and queries, by the best query and on average."""
    rows, queries = _row_patches(spark, sf_dir)
    both = patches.patch_scores(rows.withColumn("again", F.col("patches")), queries, "max", out="best")
    both = patches.patch_scores(both, queries, "mean", "again", "mean")
    each = both.select("video_id", "t", F.posexplode(F.arrays_zip("best", "mean")).alias("patch", "m"))
    return rounded(each.select("video_id", "t", F.col("patch").cast("long").alias("patch"), "m.best", "m.mean"), "best", "mean")


@query(f"WITH {ROW_SCORES} SELECT video_id, t, query_idx, patch, round(c, 6) AS score FROM each")
def patch_query_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A map of its own for each query."""
    rows, queries = _row_patches(spark, sf_dir)
    found = patches.patch_scores(rows, queries, None, out="maps")
    each = found.select("video_id", "t", F.posexplode("maps").alias("query_idx", "map")).select("video_id", "t", F.col("query_idx").cast("long").alias("query_idx"), F.posexplode("map").alias("patch", "score"))
    return rounded(each.withColumn("patch", F.col("patch").cast("long")), "score")


@query(f"{V4}, {ELIGIBLE} {KEPT.replace('round(ranked.score, 6) AS score', 'round(ranked.score, 6) AS score, ranked.video_id % 3 <> 1 AS from_cache')} JOIN v4 USING (video_id, t) WHERE n <= v4_n")
def cached_budget_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores that frame selection hands on, with a key each video. Those of every third video were made by another model, and are
    nonsense: they are made anew, the others are taken over."""
    frames, queries = canonical.frames(spark, sf_dir), canonical.queries(spark, sf_dir)
    settings = {"aggregation": "max", "grid": [4, 4]}
    model = lambda odd: F.when(F.col("video_id") % 3 == 1, F.lit(odd)).otherwise(F.lit("a")).alias("model")
    old, now = (patches.content_keys(frames, settings, queries, [model(m)]) for m in ("b", "a"))
    wrong = F.col("video_id") % 3 == 1
    cache = frame_maps(spark, sf_dir).withColumn("score", F.when(wrong, 0.0).otherwise(F.col("score"))).withColumn("map", F.when(wrong, F.array_repeat(F.lit(9.0), 16)).otherwise(F.col("map")))

    def make(rest: DataFrame) -> DataFrame:
        scored = ranking.with_query_scores(rest, queries)
        return scored.select("video_id", "t", F.round("score", 9).alias("score"), grid.pooled(F.col("emb"), 8, 8, 2).alias("map"))

    scored = patches.handed_over(frames, now, cache.join(old.select("video_id", "cache_key"), "video_id"), make)
    found = patches.cached_budget_frames(scored, RATIO, THRESHOLD, TEMPERATURE)
    kept = budget.select(found, THRESHOLD)
    return rounded(kept.join(found.select("video_id", "t", "from_cache"), ["video_id", "t"]), "score")


@query(f"""{V4}, {ELIGIBLE}, plain AS (SELECT video_id, t, token, score, row_number() OVER (PARTITION BY video_id, t ORDER BY score DESC, token) AS n FROM token)
    SELECT video_id, t, token, 'v4' AS version, round(ranked.score, 6) AS score FROM ranked JOIN v4 USING (video_id, t) WHERE n <= v4_n
    UNION ALL SELECT video_id, t, token, 'v1', round(score, 6) FROM plain WHERE n <= greatest(1, ceil(round(16 * {RATIO}, 9)))""")
def selector_by_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A least score of a patch asks for the fourth version, none for the first."""
    maps, out = frame_maps(spark, sf_dir), None
    for settings in ({"keep_ratio": RATIO, "patch_score_threshold": THRESHOLD, "temperature": TEMPERATURE}, {"keep_ratio": RATIO}):
        one = patches.select_by_settings(maps, settings).withColumn("version", F.lit(patches.version_for(settings)))
        out = one if out is None else out.unionByName(one)
    return rounded(out, "score")


@query(f"""WITH {COSINES}, size AS (SELECT video_id, count(*) AS n FROM frame GROUP BY ALL),
    d AS (SELECT video_id, n, CASE WHEN video_id % 3 = 0 AND n % 2 = 0 THEN 2 ELSE 1 END AS f FROM size)
    SELECT r.video_id, r.t, round(coalesce(s.score, r.score), 6) AS score FROM rel r JOIN d USING (video_id) LEFT JOIN rel s ON s.video_id = r.video_id AND s.t = r.t - r.t % f""")
def duplicated_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of some videos count as taken twice: the first of two is scored, both have its score. Where the number of frames is odd
    the note on it doesn't fit, and all are scored."""
    frames = canonical.frames(spark, sf_dir)
    sizes = frames.groupBy("video_id").agg(F.count("*").alias("n"))
    notes = sizes.select("video_id", (F.col("video_id") % 3 == 0).alias("applied"), F.lit(2).alias("duplicate_factor"), F.floor(F.col("n") / 2).alias("original_num_frames"))
    scored = ranking.with_query_scores(patches.scoring_frames(frames, notes), canonical.queries(spark, sf_dir))
    return rounded(patches.expanded_scores(scored.select("video_id", "t", "duplicate_factor", "score")), "score")


@registry.selector("best_tokens_of_video")
def best_tokens(tokens: DataFrame, n: int = 7) -> dict[str, DataFrame]:
    """Indices and doubled features of a video's n best tokens, in order of index."""
    rank = F.row_number().over(Window.partitionBy("video_id").orderBy(F.col("feature").desc(), "index"))
    best = tokens.withColumn("rank", rank).where(F.col("rank") <= n)
    place = (F.row_number().over(Window.partitionBy("video_id").orderBy("index")) - 1).cast("long")
    best = best.withColumn("position", place)
    return {"selected_indices": best.select("video_id", "position", "index"), "selected_features": best.select("video_id", "position", (F.col("feature") * 2).alias("feature"))}


@query(f"""WITH {TOKEN}, i AS (SELECT video_id, t * 16 + token AS index, score FROM token), r AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY score DESC, index) AS n FROM i)
    SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY index) - 1 AS position, index, round(score * 2, 6) AS feature FROM r WHERE n <= 7""")
def normalised_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A selector that returns indices and features apart; bounds and numbers are checked on the way."""
    tokens_ = token_scores(spark, sf_dir).select("video_id", (F.col("t") * 16 + F.col("token")).alias("index"), F.col("score").alias("feature"))
    return rounded(registry.call_tokens("best_tokens_of_video", tokens_, ["video_id"]), "feature")


WINNER = f"""WITH {FRAME}, q AS (SELECT vec_id AS query_idx, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id < 3),
    cell AS (SELECT video_id, t, query_idx, pos // 8 AS y, pos % 8 AS x, emb[pos + 1] * q[pos + 1] AS score FROM frame, q, range(64) AS r(pos)),
    pooled AS (SELECT video_id, t, query_idx, y // 2 AS y, x // 2 AS x, round(avg(score), 9) AS score FROM cell GROUP BY ALL),
    best AS (SELECT *, row_number() OVER (PARTITION BY video_id, t, y, x ORDER BY score DESC, query_idx) AS n FROM pooled)"""


@query(f"{WINNER} SELECT video_id, t, y, x, query_idx, round(score, 6) AS score FROM best WHERE n = 1")
def patch_query_winner(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = patches.patch_scores(blocks(canonical.frames(spark, sf_dir), 0.25).select("video_id", "t", "patches"), canonical.queries(spark, sf_dir), None, out="maps", cosine=False)
    each = found.select("video_id", "t", F.posexplode(patches.best_queries(F.col("maps"))).alias("k", "b"))
    return rounded(each.select("video_id", "t", F.floor(F.col("k") / 4).alias("y"), (F.col("k") % 4).cast("long").alias("x"), "b.query_idx", "b.score"), "score")


@query(f"{WINNER} SELECT video_id, t, y, x, (y + x) % 2 = 0 AS selected, round(score, 6) AS score, CASE WHEN query_idx < 2 THEN 'q' || query_idx || ': vector ' || query_idx ELSE 'n/a' END AS label FROM best WHERE n = 1")
def hover_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every other cell is in the mask; the third query has no name."""
    cells = query_cells(spark, sf_dir)
    names = canonical.queries(spark, sf_dir, 2).select("query_idx", F.concat(F.lit("vector "), F.col("query_idx").cast("string")).alias("query"))
    return rounded(diagnostics.hover_rows(cells, cells.where((F.col("y") + F.col("x")) % 2 == 0), names), "score")


def ranked_sql(most: int) -> str:
    """CTEs to ranked: of more than `most` frames of a video as many evenly spread ones, by density; p is the place in this pool."""
    return FRAME + f""", size AS (SELECT video_id, count(*) AS n FROM frame GROUP BY ALL),
    pool AS (SELECT f.*, row_number() OVER (PARTITION BY f.video_id ORDER BY f.t) - 1 AS p, count(*) OVER (PARTITION BY f.video_id) AS m FROM frame f JOIN size USING (video_id)
        WHERE n <= {most} OR f.t IN (SELECT round_even(i * ((n - 1) / {most - 1}.0::DOUBLE), 0)::BIGINT FROM range({most}) AS r(i))),
    u AS (SELECT video_id, t, emb, greatest(sqrt(list_dot_product(emb, emb)), 1e-12) AS n FROM pool),
    d AS (SELECT a.video_id, a.t AS i, b.t AS j, round(greatest(1 - list_dot_product(a.emb, b.emb) / (a.n * b.n), 0), 12) AS d FROM u a JOIN u b ON a.video_id = b.video_id AND a.t <> b.t),
    near AS (SELECT *, row_number() OVER (PARTITION BY video_id, i ORDER BY d, j) AS n FROM d),
    rho AS (SELECT video_id, i, round(sum(exp(-d * d)), 12) AS rho FROM near WHERE n <= 5 GROUP BY ALL),
    delta AS (SELECT d.video_id, d.i, a.rho, coalesce(min(CASE WHEN b.rho > a.rho THEN d.d END), max(d.d)) AS delta FROM d
        JOIN rho a ON a.video_id = d.video_id AND a.i = d.i JOIN rho b ON b.video_id = d.video_id AND b.i = d.j GROUP BY ALL),
    value AS (SELECT f.video_id, f.t, f.p, f.m, delta.rho, delta.delta, round(coalesce(delta.rho * delta.delta, 0) - 1e-6 * f.p / greatest(f.m - 1, 1), 10) AS v
        FROM pool f LEFT JOIN delta ON delta.video_id = f.video_id AND delta.i = f.t),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY v DESC, p) AS center_rank FROM value)"""


RANK = ranked_sql(ranking.POOL)
#: A pool smaller than the given videos: places in it and numbers of frames differ.
SMALL_POOL = 32


@query(f"WITH {RANK} SELECT video_id, t, center_rank, round(rho, 6) AS rho, round(delta, 6) AS delta FROM ranked")
def knn_density_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ranking.density_rank(frame_pool(spark, sf_dir)).drop("pool_index"), "rho", "delta")


def frame_pool(spark: SparkSession, sf_dir: str, most: int = ranking.POOL) -> DataFrame:
    """Frames with their similarity to the queries, 512 of a video at most."""
    scored = ranking.with_query_scores(canonical.frames(spark, sf_dir), canonical.queries(spark, sf_dir))
    return ranking.pool(scored.withColumn("score", F.round("score", 9)), most)


SEGMENTS = """SELECT video_id, row_number() OVER w - 1 AS segment_index, coalesce((lag(p) OVER w + p) // 2 + 1, 0)::BIGINT AS start_pool_index,
    coalesce((p + lead(p) OVER w) // 2, m - 1)::BIGINT AS end_pool_index, p AS center_pool_index, t AS center_t FROM ranked WHERE center_rank <= 8 WINDOW w AS (PARTITION BY video_id ORDER BY p)"""


def _segments_of_eight(pool: DataFrame) -> DataFrame:
    ranked = ranking.density_rank(pool)
    sized = ranked.withColumn("pool_size", F.count("*").over(Window.partitionBy("video_id")))
    return ranking.segments(sized.where("center_rank <= 8"))


@query(f"WITH {RANK} {SEGMENTS}")
def temporal_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _segments_of_eight(ranking.pool(canonical.frames(spark, sf_dir)))


@query(f"WITH {ranked_sql(SMALL_POOL)} {SEGMENTS}")
def pooled_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boundaries in places of a pool of 32 frames, not in numbers of frames."""
    return _segments_of_eight(ranking.pool(canonical.frames(spark, sf_dir), SMALL_POOL))


THETA, TAU = 3, 0.15


def tried_sql(most: int) -> str:
    """CTEs to history and last: the steps of trying more centers, and the last k of each video."""
    return f"""WITH {ranked_sql(most)}, {COSINES.removeprefix(FRAME + ', ')}, k AS (SELECT * FROM (VALUES (0, 3), (1, 6), (2, 9)) AS k(step, requested_k)),
    each AS (SELECT video_id, step::BIGINT AS step, requested_k::BIGINT AS requested_k, count(*) AS effective_k,
        string_agg(p::VARCHAR, ' ' ORDER BY p) AS center_pool_indices, count(*) FILTER (WHERE score >= {TAU}) AS high_count FROM ranked JOIN rel USING (video_id, t), k WHERE center_rank <= requested_k
        GROUP BY ALL),
    first AS (SELECT *, high_count >= {THETA} AS satisfied, min(CASE WHEN high_count >= {THETA} THEN step END) OVER (PARTITION BY video_id) AS stop FROM each),
    history AS (SELECT * EXCLUDE (stop) FROM first WHERE stop IS NULL OR step <= stop),
    last AS (SELECT video_id, max(requested_k) AS k, max_by(satisfied, requested_k) AS satisfied FROM history GROUP BY ALL),
    center AS (SELECT video_id, t, p, m, score, k, satisfied, row_number() OVER (PARTITION BY video_id ORDER BY p) - 1 AS segment_index FROM ranked JOIN rel USING (video_id, t) JOIN last USING (video_id) WHERE center_rank <= k),
    pick AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY score DESC, p) AS pick, score >= {TAU} AS high FROM center)"""


TRIED = tried_sql(ranking.POOL)


def ranked_pool(spark: SparkSession, sf_dir: str, most: int = ranking.POOL) -> DataFrame:
    return ranking.density_rank(frame_pool(spark, sf_dir, most), also=["score"])


def spelt(*columns: str):
    """Arrays as text, for results that are compared by value."""
    return [F.array_join(F.transform(c, lambda x: x.cast("string")), " ").alias(c) for c in columns]


@query(f"{TRIED} SELECT * FROM history")
def escalating_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ranking.escalation(ranked_pool(spark, sf_dir), THETA, TAU)
    return found.select(*[c for c in found.columns if c != "center_pool_indices"], *spelt("center_pool_indices"))


@query(f"{TRIED} SELECT video_id, t, round(score, 6) AS score, pick, high FROM pick WHERE pick <= {THETA}")
def escalating_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ranking.escalating_select(ranked_pool(spark, sf_dir), THETA, TAU).drop("pool_index"), "score")


SELECTED = f"""SELECT video_id, p AS pool_index, t, round(score, 6) AS score, segment_index, row_number() OVER (PARTITION BY video_id ORDER BY p) - 1 AS position
    FROM pick WHERE pick <= {THETA}"""


def _selection(ranked: DataFrame, also: list[str] | None = None) -> DataFrame:
    cut = ranking.segments(ranking.final_centers(ranked, THETA, TAU))
    found = ranking.selection(ranking.escalating_select(ranked, THETA, TAU, also=also), cut)
    return rounded(found.select("video_id", "pool_index", "t", "score", "segment_index", "position", *(also or [])), "score")


@query(f"{TRIED} {SELECTED}")
def frame_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What frame selection hands on, with the segments around all centers of the last step."""
    return _selection(ranked_pool(spark, sf_dir))


@query(f"{tried_sql(SMALL_POOL)} {SELECTED}")
def pooled_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a pool of 32 frames."""
    return _selection(ranked_pool(spark, sf_dir, SMALL_POOL))


@query(f"""{tried_sql(SMALL_POOL)}, chosen AS ({SELECTED}), {TOKEN.removeprefix(FRAME + ', ')}
    SELECT c.video_id, position, pool_index, t, token, round(token.score, 6) AS score FROM chosen c JOIN token USING (video_id, t)""")
def selected_score_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The slice of the score maps that belongs to the chosen frames travels with them through the ranking."""
    scored = frame_pool(spark, sf_dir, SMALL_POOL).withColumn("map", grid.pooled(F.col("emb"), 8, 8, 2))
    found = _selection(ranking.density_rank(scored, also=["score", "map"]), ["map"])
    cells = found.select("video_id", "position", "pool_index", "t", F.posexplode("map").alias("token", "score"))
    return rounded(cells.withColumn("token", F.col("token").cast("long")), "score")


@query(f"""{tried_sql(SMALL_POOL)}, best AS (SELECT *, pick - 1 AS r, least({THETA}, count(*) OVER (PARTITION BY video_id)) AS size FROM pick),
    slot AS (SELECT b.* FROM best b, range({THETA}) AS s(i) WHERE pick <= {THETA} AND i % size = r)
    SELECT c.video_id, any_value(m) AS pool_size, any_value(k)::BIGINT AS final_k, count(*) AS effective_final_k, count(*) FILTER (WHERE score >= {TAU}) AS high_count, NOT any_value(satisfied) AS fallback_used, count(*) < {THETA} AS padded_to_threshold,
        string_agg(p::VARCHAR, ' ' ORDER BY p) AS center_pool_indices, string_agg(t::VARCHAR, ' ' ORDER BY p) AS center_original_indices,
        any_value(s.pools) AS selected_pool_indices, any_value(s.frames) AS selected_original_indices, any_value(s.segments) AS selected_segment_indices, round(any_value(s.total), 6) AS selected_score_sum, round(sum(score), 6) AS center_score_sum
    FROM center c JOIN (SELECT video_id, string_agg(p::VARCHAR, ' ' ORDER BY p) AS pools, string_agg(t::VARCHAR, ' ' ORDER BY p) AS frames, string_agg(segment_index::VARCHAR, ' ' ORDER BY p) AS segments, sum(score) AS total FROM slot GROUP BY ALL) s USING (video_id) GROUP BY c.video_id""")
def selection_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a video, pool of 32 frames."""
    found = ranking.selection_summary(ranked_pool(spark, sf_dir, SMALL_POOL), THETA, TAU)
    lists = ["center_pool_indices", "center_original_indices", "selected_pool_indices", "selected_original_indices", "selected_segment_indices"]
    total = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda s, x: s + x), 6)
    plain = [c for c in found.columns if not c.startswith(("center_", "selected_"))]
    return found.select(*plain, *spelt(*lists), total("selected_scores").alias("selected_score_sum"), total("center_scores").alias("center_score_sum"))


@query(f"""{TRIED}, two AS (SELECT video_id, t, score, pick - 1 AS r, least(2, count(*) OVER (PARTITION BY video_id)) AS m FROM pick)
    SELECT video_id, t, round(score, 6) AS score, slot, slot >= m AS padded FROM two, range(7) AS s(slot) WHERE r < 2 AND slot % m = r""")
def pad_to_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two best frames of each video, repeated to fill seven places."""
    two = ranking.escalating_select(ranked_pool(spark, sf_dir), THETA, TAU).where("pick <= 2")
    return rounded(ranking.pad(two.select("video_id", "t", "score"), 7), "score")


@query(f"""{TRIED}, own AS (SELECT video_id, t, score, true AS own FROM center WHERE score >= 0.3), src AS (FROM own UNION ALL SELECT video_id, t, score, false FROM center WHERE video_id NOT IN (SELECT video_id FROM own)),
    r AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY score DESC, t) - 1 AS r, count(*) OVER (PARTITION BY video_id) AS m FROM src)
    SELECT video_id, t, round(score, 6) AS score, slot, NOT own OR slot >= m AS padded FROM r, range(7) AS s(slot) WHERE slot % m = r""")
def pad_from_centers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only centers of high relevance are selected; of most videos none is, and these are filled from all their centers."""
    centers = ranking.final_centers(ranked_pool(spark, sf_dir), THETA, TAU).select("video_id", "t", "score")
    return rounded(ranking.pad(centers.where("score >= 0.3"), 7, centers), "score")


CLIP = "clip AS (SELECT user_id::BIGINT AS video_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_index, ts, event_id FROM events), total AS (SELECT video_id, count(*) AS total FROM clip GROUP BY ALL)"
SAMPLE = CLIP + """, idx AS (SELECT video_id, i AS position, CASE WHEN total <= 8 THEN i ELSE round_even(i * ((total - 1) / 7.0::DOUBLE), 0) END::BIGINT AS frame_index FROM total, range(8) AS r(i) WHERE total > 8 OR i < total)"""


def _totals(frames: DataFrame) -> DataFrame:
    return frames.groupBy("video_id").agg(F.count("*").alias("total"))


@query(f"WITH {SAMPLE} SELECT i.video_id, i.position::BIGINT AS position, i.frame_index, c.event_id FROM idx i JOIN clip c USING (video_id, frame_index)")
def uniform_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = canonical.clips(spark, sf_dir)
    picked = sampling.uniform_sample(_totals(frames), 8).withColumn("position", F.col("position").cast("long"))
    return picked.join(frames.drop("ts"), ["video_id", "frame_index"])


@query(f"WITH {CLIP} SELECT video_id, i * 3 AS frame_index FROM total, range(100000) AS r(i) WHERE i * 3 < total")
def strided_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third frame, for display."""
    return sampling.strided_sample(_totals(canonical.clips(spark, sf_dir)), 3)


@query(f"""WITH {SAMPLE}, ok AS (SELECT c.video_id, frame_index FROM clip c JOIN events USING (event_id) WHERE event_type <> 'error'), wanted AS (SELECT DISTINCT video_id, frame_index FROM idx),
    state AS (SELECT video_id, count(*) AS actual, count(w.frame_index) AS got FROM (SELECT ok.video_id, w.frame_index FROM ok LEFT
        JOIN wanted w ON w.video_id = ok.video_id AND w.frame_index = ok.frame_index) w GROUP BY ALL),
    need AS (SELECT video_id, count(*) AS need FROM wanted GROUP BY ALL)
    SELECT ok.video_id, ok.frame_index, got < need AS used_fallback FROM ok JOIN state USING (video_id) JOIN need USING (video_id) LEFT
        JOIN wanted w ON w.video_id = ok.video_id AND w.frame_index = ok.frame_index
    WHERE CASE WHEN got < need THEN ok.frame_index < least(actual, 8) ELSE w.frame_index IS NOT NULL END""")
def short_video_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of type error stand in for frames that don't decode."""
    frames = canonical.clips(spark, sf_dir)
    good = canonical.table(spark, sf_dir, "events").where("event_type <> 'error'").select("event_id")
    return sampling.decoded_or_prefix(sampling.uniform_sample(_totals(frames), 8), frames.join(good, "event_id").select("video_id", "frame_index"), 8)


@query("""WITH s AS (SELECT p_partkey, (p_size * 37 + 13)::DOUBLE AS h0, (p_partkey % 1500 + 200)::DOUBLE AS w0 FROM part), s1 AS (SELECT *, least(720 / greatest(h0, w0), 1.0::DOUBLE) AS k FROM s),
    s2 AS (SELECT p_partkey, CASE WHEN k < 1 THEN greatest(1, round_even(h0 * k, 0)) ELSE h0 END AS h, CASE WHEN k < 1 THEN greatest(1, round_even(w0 * k, 0)) ELSE w0 END AS w FROM s1),
    s3 AS (SELECT *, greatest(28, round_even(h / 28, 0) * 28) AS rh, greatest(28, round_even(w / 28, 0) * 28) AS rw FROM s2)
    SELECT p_partkey, (CASE WHEN rh * rw > 12845056 THEN greatest(28,
        floor(h / sqrt(h * w / 12845056) / 28) * 28) WHEN rh * rw < 3136 THEN greatest(28,
        ceil(h * sqrt(3136 / (h * w)) / 28) * 28) ELSE rh END)::BIGINT AS out_height,
    (CASE WHEN rh * rw > 12845056 THEN greatest(28, floor(w / sqrt(h * w / 12845056) / 28) * 28) WHEN rh * rw < 3136 THEN greatest(28,
        ceil(w * sqrt(3136 / (h * w)) / 28) * 28) ELSE rw END)::BIGINT AS out_width FROM s3""")
def smart_resize(spark: SparkSession, sf_dir: str) -> DataFrame:
    h, w = sampling.fitted_size(F.col("p_size") * 37 + 13, F.col("p_partkey") % 1500 + 200)
    return canonical.table(spark, sf_dir, "part").select("p_partkey", h.alias("out_height"), w.alias("out_width"))


@query(f"""WITH {SCORE}, n AS (SELECT video_id, count(*) AS n FROM frame GROUP BY ALL),
    even AS (SELECT * FROM score UNION ALL SELECT video_id, t + 1, y, x, score FROM score JOIN n USING (video_id) WHERE n % 2 = 1 AND t = n - 1)
    SELECT video_id, t // 2 AS t, y, x, round(avg(score), 6) AS score FROM even GROUP BY ALL""")
def temporal_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of frames; the last one of a video with an odd number comes twice, so that every step has its frames."""
    sized = canonical.frames(spark, sf_dir).withColumn("n", F.count("*").over(Window.partitionBy("video_id")))
    last = (F.col("n") % 2 == 1) & (F.col("t") == F.col("n") - 1)
    even = sized.withColumn("t", F.explode(F.when(last, F.array("t", F.col("t") + 1)).otherwise(F.array("t")))).drop("n")
    return rounded(sampling.align(canonical.scores(even), 2), "score")


@query(f"WITH {FRAME} SELECT video_id, t * 2 + k AS t, t AS source_t, vec_id FROM frame, range(2) AS r(k)")
def frame_duplicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.duplicate(canonical.frames(spark, sf_dir).drop("emb"), 2)


@query(f"""WITH {CLIP}, part AS (SELECT video_id, CASE video_id % 3 WHEN 0 THEN NULL ELSE 0.5 END AS s, CASE video_id % 3 WHEN 2 THEN 0.25 ELSE 1.5 END AS e FROM total)
    SELECT c.video_id, c.video_id AS clip_id, c.frame_index, c.event_id FROM clip c JOIN part USING (video_id)
    WHERE NOT e > coalesce(s, 0) OR c.frame_index BETWEEN round_even(coalesce(s, 0) * 3, 0) AND round_even(e * 3, 0)""")
def clip_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = canonical.clips(spark, sf_dir)
    third = F.col("video_id") % 3
    clips = _totals(frames).select("video_id", F.col("video_id").alias("clip_id"), F.when(third != 0, 0.5).alias("start"), F.when(third == 2, 0.25).otherwise(1.5).alias("end"), F.lit(3.0).alias("fps"))
    return sampling.clip(frames.drop("ts"), clips)


def _mapped(spark: SparkSession, sf_dir: str, matrix, columns: int) -> DataFrame:
    """The cells of each frame's map of 8 by 8, after the matrix."""
    found = maps.transformed(canonical.frames(spark, sf_dir).select("video_id", "t", F.col("emb").alias("map")), matrix)
    return rounded(maps.cells(found, columns, ["video_id", "t"]), "score")


@query(f"WITH {SCORE} SELECT video_id, t, y // 2 AS y, x // 2 AS x, round(avg(score), 6) AS score FROM score GROUP BY ALL")
def block_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mapped(spark, sf_dir, maps.block_matrix((8, 8), 2), 4)


AXIS = """src AS (SELECT i, greatest((i + 0.5::DOUBLE) * 8 / 12 - 0.5, 0) AS p FROM range(12) AS r(i)), lo AS (SELECT i, floor(p)::BIGINT AS k, p - floor(p) AS f FROM src),
    axis AS (SELECT i, k, 1 - CASE WHEN k = 7 THEN 0 ELSE f END AS w FROM lo UNION ALL SELECT i, k + 1, f FROM lo WHERE k < 7)"""


@query(f"WITH {SCORE}, {AXIS} SELECT video_id, t, a.i AS y, b.i AS x, round(sum(score * a.w * b.w), 6) AS score FROM score JOIN axis a ON a.k = y JOIN axis b ON b.k = x GROUP BY ALL")
def bilinear_resize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mapped(spark, sf_dir, maps.bilinear_matrix((8, 8), (12, 12)), 12)


WINDOW = SCORE + ", win AS (SELECT video_id, t, wy AS y, wx AS x, avg(score) AS score FROM score, range(3) AS a(wy), range(3) AS b(wx) WHERE y BETWEEN wy * 2 AND wy * 2 + 2 AND x BETWEEN wx * 2 AND wx * 2 + 2 GROUP BY ALL)"


@query(f"WITH {WINDOW} SELECT video_id, t, y, x, round(score, 6) AS score FROM win")
def window_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mapped(spark, sf_dir, maps.window_matrix((8, 8), 3, 2), 3)


@query(f"WITH {WINDOW} SELECT video_id, t, (y * 2 + dy) // 2 AS y, (x * 2 + dx) // 2 AS x, round(sum(score) / count(*), 6) AS score FROM win, range(3) AS a(dy), range(3) AS b(dx) GROUP BY 1, 2, 3, 4")
def overlap_add_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mapped(spark, sf_dir, maps.merge_matrix((8, 8), "sliding_window", 2, 3, 2), 4)


@query(f"""WITH {TOKEN}, ranked AS (SELECT *, row_number() OVER (PARTITION BY video_id, t ORDER BY score DESC, token) AS n FROM token)
    SELECT video_id, t, token // 4 * 2 + dy AS y, token % 4 * 2 + dx AS x FROM ranked, range(2) AS a(dy), range(2) AS b(dx) WHERE n <= 5""")
def mask_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = budget.fixed_ratio(token_scores(spark, sf_dir), RATIO)
    _, y, x = grid.from_flat(F.col("token"), 4, 4)
    return grid.mask_expand(kept.select("video_id", "t", y.alias("y"), x.alias("x")), 2)


@query(f"""WITH {TOKEN}, ranked AS (SELECT *, row_number() OVER (PARTITION BY video_id, t ORDER BY score DESC, token) AS n FROM token),
    kept AS (SELECT video_id, t * 16 + token AS video_index FROM ranked WHERE n <= 5), size AS (SELECT video_id, count(*) * 16 AS n FROM frame GROUP BY ALL),
    seq AS (SELECT video_id, p AS position, CASE WHEN p BETWEEN 4 AND n + 3 THEN p - 4 END AS video_index FROM size, range(100000) AS r(p) WHERE p < n + 7)
    SELECT seq.video_id, position, seq.video_index, CASE WHEN seq.video_index IS NULL THEN 0 ELSE 2 END::BIGINT AS type_id,
        row_number() OVER (PARTITION BY seq.video_id ORDER BY position) - 1 AS new_position
    FROM seq LEFT JOIN kept ON kept.video_id = seq.video_id AND kept.video_index = seq.video_index WHERE seq.video_index IS NULL OR kept.video_index IS NOT NULL""")
def token_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prompt of four text tokens, all tokens of the video, three text tokens."""
    t = token_scores(spark, sf_dir)
    kept = budget.fixed_ratio(t, RATIO).select("video_id", (F.col("t") * 16 + F.col("token")).alias("video_index"))
    sizes = t.groupBy("video_id").agg(F.count("*").alias("n"))
    seq = sizes.select("video_id", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") + 6)).alias("position"))
    seq = seq.select("video_id", "position", F.when(F.col("position").between(4, F.col("n") + 3), F.col("position") - 4).alias("video_index"))
    kind = tokens.type_id(F.when(F.col("video_index").isNotNull(), 2).otherwise(0), 1, 2)
    return tokens.prune(seq, kept, ["video_id"]).withColumn("type_id", kind)


@query(f"WITH {SCORE} SELECT video_id, round(quantile_cont(score, 0.02::DOUBLE), 6) AS vmin, round(quantile_cont(score, 0.98::DOUBLE), 6) AS vmax FROM score GROUP BY ALL")
def score_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(grid.score_limits(canonical.scores(canonical.frames(spark, sf_dir)), 0.02, 0.98), "vmin", "vmax")


@query(f"""WITH {TOKEN}, ranked AS (SELECT *, row_number() OVER (PARTITION BY video_id, t ORDER BY score DESC, token) <= 5 AS s FROM token)
    SELECT video_id, t, round(avg(score), 6) AS mean_all, round(avg(score) FILTER (WHERE s), 6) AS mean_in, round(avg(score) FILTER (WHERE NOT s), 6) AS mean_out FROM ranked GROUP BY ALL""")
def mask_score_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = token_scores(spark, sf_dir)
    rank = F.row_number().over(Window.partitionBy("video_id", "t").orderBy(F.col("score").desc(), "token"))
    return rounded(grid.mask_stats(t.withColumn("selected", rank <= 5)), "mean_all", "mean_in", "mean_out")


@query(f"""{V4}, size AS (SELECT video_id, t, v4_n AS selected, tokens - v4_n AS not_selected, v4_n * 4 AS raw_selected, round(score, 6) AS frame_score, budget FROM v4) SELECT * FROM size""")
def temporal_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the charts over time show: per frame selected and other tokens, cells of the raw grid, score, budget."""
    f = budget.budget_frames(frame_maps(spark, sf_dir), "v4", RATIO, THRESHOLD, TEMPERATURE)
    return f.select("video_id", "t", F.col("keep").alias("selected"), (F.col("tokens") - F.col("keep")).alias("not_selected"), (F.col("keep") * 4).alias("raw_selected"), F.round("score", 6).alias("frame_score"), "budget")
