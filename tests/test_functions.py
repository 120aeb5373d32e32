"""One case or more for each small function of text, time, answers and grids."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievegrid.functions import text
from sievegrid.operators import evaluate, grid, maps, ranking, sampling, tokens
from sievegrid.sources import io


@pytest.fixture(scope="module")
def value(spark):
    """The value of a column over one row."""
    return lambda c: spark.range(1).select(c.alias("v")).first()["v"]


def cases():
    """(column, its value)."""
    return [
        (text.query_text(F.lit(" a \n\t b ")), "a b"),
        (text.optional_text(F.lit("  ")), None),
        (text.optional_text(F.lit(" x ")), "x"),
        (text.optional_number(F.lit(-1)), None),
        (text.optional_number(F.lit(0.0)), 0.0),
        (text.truth(F.lit(" Yes ")), True),
        (text.truth(F.lit("2")), False),
        (text.whole_number(F.lit("-12")), -12),
        (text.whole_number(F.lit("2.9")), None),
        (text.whole_number(F.lit("True")), None),
        (text.real_number(F.lit("2.5e1")), 25.0),
        (text.real_number(F.lit("true")), None),
        (text.real_number(F.lit("many")), None),
        (text.url_stem(F.lit("https://h.org/a/b/clip.one.webm?x=1")), "clip.one"),
        (text.url_stem(F.lit("nothing")), None),
        (text.short_label(F.lit("abcdefghij"), 10), "abcdefghij"),
        (text.short_label(F.lit("abcdefghijk"), 10), "...efghijk"),
        (text.safe_id(F.lit(" a b/ç:1 ")), "a_b_1"),
        (text.shown_number(F.lit(0.123456)), "0.1235"),
        (text.shown_number(F.lit(2.0), F.lit(3), "s"), "2.00s (n=3)"),
        (text.shown_number(F.lit(None).cast("double")), "N/A"),
        (text.shown_bytes(F.lit(3 << 29), F.lit(2)), "1.50 GiB (n=2)"),
        (text.shown_bytes(F.lit(None).cast("long"), F.lit(0)), "N/A"),
        (text.shown_accuracy(F.lit(2), F.lit(3)), "0.6667"),
        (text.shown_accuracy(F.lit(0), F.lit(0)), "N/A"),
        (text.skip_reason(F.lit("unparsed"), F.lit(None)), "unparsed"),
        (text.skip_reason(F.lit("letter_regex"), F.lit(None)), "missing_prediction"),
        (text.skip_reason(F.lit("letter_regex"), F.lit(1)), None),
        (text.scaled(F.array(F.lit(1.5), F.lit(2.0)), 2, "long"), [3, 4]),
        (text.submission_uid([F.lit(" "), F.lit("u")], F.lit("x"), F.lit("f")), "u"),
        (text.submission_uid([F.lit(None).cast("string")], F.lit("http://h/v.mp4"), F.lit("f")), "v"),
        (text.first_present(F.lit(None).cast("string"), F.lit(" y ")), "y"),
        (text.legacy_prompt(F.lit(""), F.lit(" ask "), F.lit(False), F.lit("<v>")), "ask"),
        (text.legacy_prompt(F.lit("be short"), F.lit("ask"), F.lit(True), F.lit("<v>")), "<v>\nSystem:\nbe short\n\nUser:\nask"),
        (text.legacy_prompt(F.lit(None).cast("string"), F.lit("see <v>"), F.lit(True), F.lit("<v>")), "see <v>"),
        (text.legacy_prompt(F.lit(None).cast("string"), F.lit("see"), F.lit(True), F.lit(None).cast("string")), "see"),
        (tokens.generated(F.lit(5), F.lit(7)), 0),
        (tokens.generated(F.lit(9), F.lit(7)), 2),
        (sampling.duration(F.lit(10), F.lit(4.0)), 2.5),
        (sampling.duration(F.lit(10), F.lit(0.0)), None),
        (sampling.lineage(F.array(F.lit(4), F.lit(2)), F.array(F.lit(1)), F.lit(2)), [4, 2]),
        (sampling.lineage(F.array(F.lit(4)), F.array(F.lit(1), F.lit(3)), F.lit(2)), [1, 3]),
        (sampling.lineage(F.array(F.lit(4)), F.array(F.lit(1)), F.lit(2)), [0, 1]),
        (sampling.temporal_patch(F.lit(None).cast("long"), F.lit(8), F.lit(4)), 2),
        (sampling.temporal_patch(F.lit(None).cast("long"), F.lit(9), F.lit(4)), 1),
        (sampling.temporal_patch(F.lit(3), F.lit(9), F.lit(4)), 3),
    ]


def test_values(spark):
    found = spark.range(1).select(*[c.alias(f"c{n}") for n, (c, _) in enumerate(cases())]).first()
    assert [(n, v) for n, v in enumerate(found)] == [(n, v) for n, (_, v) in enumerate(cases())]


def test_errors(value):
    for column, error in ((text.legacy_prompt(F.lit("s"), F.lit(" "), F.lit(True), F.lit("v")), "empty user prompt"), (tokens.checked_index(F.lit(3), F.lit(3)), "out of bounds")):
        with pytest.raises(Exception, match=error):
            value(column)


def test_numbers_of_centers():
    assert ranking.k_set(4) == [4, 8, 12] and ranking.k_set(4, [4, 9, 4]) == [4, 9]
    for given in ([5], [4, 0], [8, 4]):
        with pytest.raises(ValueError):
            ranking.k_set(4, given)


def test_display_and_undo(spark):
    videos = spark.createDataFrame([(1, 9), (2, 3)], "video_id long, total long")
    assert sorted(tuple(r) for r in sampling.display_sample(videos, 4).collect()) == [(1, 0), (1, 3), (1, 5), (1, 8), (2, 0), (2, 1), (2, 2)]
    frames = spark.createDataFrame([(1, t) for t in range(6)], "video_id long, t long")
    assert sorted(r["t"] for r in sampling.undo_duplicate(frames, 2).collect()) == [0, 1, 2]
    with pytest.raises(ValueError):
        sampling.strided_sample(videos, 0)


def test_samples_by_name_and_place(spark):
    rows = spark.createDataFrame([(n, f"u{n}", f"Vid{n % 2}") for n in range(6)], "n long, uid string, video string")
    assert evaluate.pick_sample(rows, " VID1 ", ["uid", "video"], "n").first()["n"] == 1
    assert [r["n"] for r in evaluate.sliced(rows, ["n"], 2, 3).collect()] == [2, 3, 4]
    assert evaluate.sliced(rows, ["n"], -1, -1).count() == 6
    questions = spark.createDataFrame([("v", "1", "old"), ("v", "2", None)], "video_id string, question_id string, response string")
    answers = spark.createDataFrame([("v", "2", "B")], "video_id string, question_id string, response string")
    assert {(r["question_id"], r["response"]) for r in evaluate.fill_responses(questions, answers).collect()} == {("1", ""), ("2", "B")}


def test_paths_by_rules(spark):
    """Several listings and keys in one pass; rows that repeat, and keys that are null, are no trouble."""
    rows = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", None), ("c", "z"), (None, None)], "one string, two string")
    first = spark.createDataFrame([("a", "/1/a", "2"), ("a", "/9/a", "1")], "key string, path string, order string")
    second = spark.createDataFrame([("x", "/2/x"), ("z", "/2/z"), ("z", "/1/z"), ("b", "/2/b")], "key string, path string")
    got = evaluate.resolve(rows, {"f": first, "s": second}, [("f", F.col("one")), ("s", F.col("two")), ("s", F.col("one"))]).collect()
    assert sorted((str(r["one"]), str(r["path"])) for r in got) == [("None", "None"), ("a", "/9/a"), ("a", "/9/a"), ("b", "/2/b"), ("c", "/1/z")]


def test_ops_total(spark):
    ops = spark.createDataFrame([("mm", 2e9), ("mm", 1e9), ("add", 0.0), ("exp", 5e8)], "name string, flops double")
    assert tuple(evaluate.ops_total(ops).first()) == (3.5e9, 2, 3, 3.5)
    assert tuple(evaluate.ops_total(ops.limit(0)).first()) == (0.0, 0, 0, 0.0)


def test_steps_of_a_grid(spark):
    got = grid.steps(spark.createDataFrame([(1, 3, 4, 5)], "video_id long, grid_t long, grid_h long, grid_w long")).collect()
    assert [tuple(r) for r in got] == [(1, t, 1, 4, 5) for t in range(3)]


def test_writers(spark, tmp_path):
    rows = spark.createDataFrame([("10", "q", "A"), ("9", "q", None)], "video_id string, question_id string, response string")
    io.write_results(rows, str(tmp_path / "r"))
    io.write_results(rows.limit(1), str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).count() == 1
    io.write_submission(evaluate.submission(rows), str(tmp_path / "s"))
    files = sorted((tmp_path / "s").glob("part-*"))
    assert [line.split('"video_id":"')[1][:2] for f in files for line in f.read_text().splitlines()] == ['9"', "10"]


def test_uid_metadata(spark):
    questions = spark.createDataFrame([("a",), ("b",)], "q_uid string")
    uids = spark.createDataFrame([("a", "u", "v", 1)], "q_uid string, url string, video_uid string, more int")
    assert sorted(map(tuple, io.with_uid_metadata(questions, uids).collect())) == [("a", "u", "v"), ("b", None, None)]


@pytest.mark.parametrize(("rows", "columns"), [(8, 8), (6, 4)])
def test_maps_in_arrays_equal_cells(spark, rows, columns):
    """Each matrix gives what the same step gives on single cells."""
    r = np.random.default_rng(rows)
    data = [(1, t, [float(x) for x in r.normal(size=rows * columns)]) for t in range(5)]
    frames = spark.createDataFrame(data, "video_id long, t long, map array<double>")
    cells = maps.cells(frames, columns, ["video_id", "t"])
    size = (rows, columns)
    steps = [
        (maps.bilinear_matrix(size, (5, 9)), 9, grid.bilinear(cells, size, (5, 9))),
        (maps.window_matrix(size, 3, 1), columns - 2, grid.window_pool(cells, size, 3, 1)),
        (maps.block_matrix(size, 2), columns // 2, grid.block_pool(cells, 2)),
        (maps.merge_matrix(size, "merge", 2), columns // 2, grid.merged(cells, size, "merge", 2)),
        (maps.merge_matrix(size, "sliding_window", 2, 2, 1), columns // 2, grid.merged(cells, size, "sliding_window", 2, 2, 1)),
    ]
    for matrix, wide, plain in steps:
        one = {(x["t"], x["y"], x["x"]): x["score"] for x in maps.cells(maps.transformed(frames, matrix), wide, ["t"]).collect()}
        other = {(x["t"], x["y"], x["x"]): x["score"] for x in plain.collect()}
        assert one.keys() == other.keys() and all(math.isclose(v, other[k], abs_tol=1e-9) for k, v in one.items())


def test_maps_are_checked(spark):
    frames = spark.createDataFrame([(1, [1.0, 2.0]), (2, None)], "t long, map array<double>")
    got = {r["t"]: r["map"] for r in maps.transformed(frames, np.array([[1.0, 1.0]])).collect()}
    assert got == {1: [3.0], 2: None}
    with pytest.raises(Exception, match="has not 3 cells"):
        maps.transformed(frames, np.ones((1, 3))).collect()
    for mode, window, stride in (("sliding_window", 1, 4), ("other", 2, 1)):
        with pytest.raises(ValueError):
            maps.merge_matrix((8, 8), mode, 2, window, stride)
    with pytest.raises(ValueError):
        maps.block_matrix((7, 8), 2)
