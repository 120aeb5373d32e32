"""Readers and writers on small files."""

import json

import pytest
from pyspark.sql import functions as F

from sievegrid.sources import io
from sievegrid.streaming import resume


def test_questions(spark, tmp_path):
    (tmp_path / "q.csv").write_text('﻿video,qid,question,a0,a1,a2,a3,a4,answer,type\n7,1," why? ",a,b,c,d,e,3,CW\n8,,how,a,b,c,d,e,x,\n', encoding="utf-8")
    rows = io.questions_csv(spark, str(tmp_path / "q.csv")).collect()
    assert [(r["q_uid"], r["question"], r["ground_truth"], r["question_type"]) for r in rows] == [("7:1", "why?", 3, "CW"), ("1", "how", None, None)]
    (tmp_path / "q.json").write_text('{"u1": {"query": "who", "option 0": "x", "option 1": "y", "answer": "B",},}')
    r = io.questions_json(spark, str(tmp_path / "q.json")).first()
    assert (r["q_uid"], r["question"], r["options"], r["ground_truth"]) == ("u1", "who", ["x", "y"], 1)
    (tmp_path / "l.json").write_text('{"data": [{"q_uid": "z", "text": "t", "choices": ["p", "q"], "label": 1}]}')
    r = io.questions_json(spark, str(tmp_path / "l.json")).first()
    assert (r["q_uid"], r["options"], r["ground_truth"]) == ("z", ["p", "q"], 1)


def test_tasks_and_nested(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t/move.json").write_text(json.dumps([{"video": "v", "question": "q", "candidates": ["Up!", "down"], "answer": "up", "start": -1, "end": 2.5}]))
    r = io.task_files(spark, str(tmp_path / "t"), ["move"]).first()
    assert (r["task_name"], r["ground_truth"], r["start"], r["end"]) == ("move", 0, None, 2.5)
    with pytest.raises(ValueError):
        io.task_files(spark, str(tmp_path / "t"), ["gone"])
    (tmp_path / "n.json").write_text(json.dumps([{"video_id": "v", "questions": [{"question_id": "1", "question": "q", "options": ["A"], "answer": "A"}]}]))
    assert io.nested_questions(spark, str(tmp_path / "n.json")).first()["options"] == ["A"]


def test_text_files(spark, tmp_path):
    (tmp_path / "p.txt").write_text("[SYSTEM]\nbe short\n[USER]\n{q}\n\nnow\n")
    r = io.prompt_template(spark, str(tmp_path / "p.txt")).first()
    assert (r["system"], r["user"]) == ("be short", "{q}\n\nnow")
    (tmp_path / "l.txt").write_text("\n a cat \n\nb\n")
    assert [(r[0], r[1]) for r in io.query_lines(spark, str(tmp_path / "l.txt")).collect()] == [(0, "a cat"), (1, "b")]
    (tmp_path / "u.json").write_text('{"a": "https://x/1.mp4", "b": {"url": "https://x/2.mp4?z"}}')
    assert sorted(r["video_uid"] for r in io.uid_map(spark, str(tmp_path / "u.json")).collect()) == ["1", "2"]
    (tmp_path / "m.json").write_text('{"a": "one.mp4", "b": ""}')
    assert io.video_map(spark, str(tmp_path / "m.json")).count() == 1
    (tmp_path / "page.html").write_text('<b>[1]</b> newPlot("x", [{"name": "s", "x": [1, 2], "y": [3, 4]}], {})')
    assert [tuple(r) for r in io.chart_values(spark, str(tmp_path / "page.html"), "newPlot", "s").collect()] == [(0, 1.0, 3.0), (1, 2.0, 4.0)]
    assert io.files(spark, str(tmp_path), ".json").count() == 2
    assert spark.range(1).select(io.frame_folder_fps(F.lit("a/fps12/b"))).first()[0] == 12.0


def test_results(spark, tmp_path):
    out = str(tmp_path / "r")
    io.append_results(spark.createDataFrame([("a", 1)], "q_uid string, prediction int"), out)
    io.append_results(spark.createDataFrame([("b", None)], "q_uid string, prediction int"), out)
    assert {r[0] for r in io.completed(spark, out).collect()} == {"a", "b"}
    (tmp_path / "bad.jsonl").write_text('{"q_uid": "a"}\nnot json\n')
    assert io.completed(spark, str(tmp_path / "bad.jsonl")).count() == 1
    with pytest.raises(Exception):
        io.predictions(spark, str(tmp_path / "bad.jsonl"), "q_uid string").collect()
    rows = spark.createDataFrame([("a", 1, "index_regex"), ("b", 2, "unparsed")], "q_uid string, prediction int, parse_method string")
    assert json.loads(io.upload_payload(rows).first()["payload"]) == {"a": 1}


def test_stream(spark, tmp_path):
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    put = lambda *ids: spark.createDataFrame([(i,) for i in ids], "q_uid string").coalesce(1).write.mode("append").json(source)
    put("a", "b", "a")
    for more in (("b", "c"), ()):
        if more:
            resume.append_new(spark.readStream.schema("q_uid string").json(source), out, state).awaitTermination()
            put(*more)
        else:
            resume.append_new(spark.readStream.schema("q_uid string").json(source), out, state).awaitTermination()
    assert sorted(r[0] for r in spark.read.json(out).collect()) == ["a", "b", "c"]
    samples = spark.createDataFrame([("c",), ("d",)], "q_uid string")
    assert [r[0] for r in resume.pending_of(samples, out).collect()] == ["d"]


def test_fps_of_folders(spark):
    paths = ["a/clip_FPS24/x", "a/fps0/x", "fps0/fps2.5", "none", "fpsx"]
    got = spark.createDataFrame([(p,) for p in paths], "p string").select(io.frame_folder_fps(F.col("p")).alias("f")).collect()
    assert [r["f"] for r in got] == [24.0, 3.0, 2.5, 3.0, 3.0]


def test_samples_with_paths(spark, tmp_path):
    (tmp_path / "q.json").write_text(json.dumps([{"q_uid": k, "question": "?", "option 0": "x", "answer": 0} for k in ("a", "b", "c")]))
    (tmp_path / "u.json").write_text(json.dumps({"a": "https://h/p/va.mp4?x", "b": {"video_uid": "vb", "url": "https://h/other.mp4"}}))
    listing = spark.createDataFrame([("/v/va.mp4",), ("/v/vb.mp4",), ("/v/c.mp4",), ("/v/other.mp4",)], "path string")
    got = io.samples(spark, str(tmp_path / "q.json"), str(tmp_path / "u.json"), listing)
    assert {r["q_uid"]: r["video_path"] for r in got.collect()} == {"a": "/v/va.mp4", "b": "/v/vb.mp4", "c": "/v/c.mp4"}
    with pytest.raises(Exception, match="no video for c"):
        io.samples(spark, str(tmp_path / "q.json"), str(tmp_path / "u.json"), listing.where("path <> '/v/c.mp4'")).collect()


def test_files_without_content(spark, tmp_path):
    (tmp_path / "q.txt").write_text("\n  \n")
    with pytest.raises(Exception, match="no queries"):
        io.query_lines(spark, str(tmp_path / "q.txt")).collect()
    (tmp_path / "p.html").write_text("<script>plot([{\"name\": \"a\", \"x\": [1], \"y\": [2]}])")
    assert [tuple(r) for r in io.chart_values(spark, str(tmp_path / "p.html"), "plot(", "a").collect()] == [(0, 1.0, 2.0)]
    with pytest.raises(Exception, match="no trace b"):
        io.chart_values(spark, str(tmp_path / "p.html"), "plot(", "b").collect()


def test_cached_scores(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(len(made))

    for key, count in (({"frames": 3}, 1), ({"frames": 3}, 1), ({"frames": 4}, 2), ({"frames": 3}, 3)):
        assert io.cached(spark, str(tmp_path / "c"), key, make).count() == count


def test_lines_by_number(spark, tmp_path):
    """Files that are read in several parts: numbers go on from part to part, and the bad lines are told by theirs."""
    rows = [json.dumps({"q_uid": f"u{n}", "prediction": n}) for n in range(1, 2001)]
    rows[10], rows[600], rows[1500], rows[1999] = "", "not json", "[1]", '{"q_uid": "u", "prediction": "many"}'
    (tmp_path / "p").mkdir()
    (tmp_path / "p/a.jsonl").write_text("\n".join(rows) + "\n")
    (tmp_path / "p/b.jsonl").write_text('﻿{"q_uid": "b", "prediction": 7}\n7')
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        assert spark.read.text(str(tmp_path / "p")).rdd.getNumPartitions() > 5
        lines = io.numbered_lines(spark, str(tmp_path / "p/a.jsonl")).collect()
        assert sorted((r["line"], r["value"]) for r in lines) == list(enumerate(rows, 1))
        got = io.json_lines(spark, str(tmp_path / "p"), "q_uid string, prediction int", strict=False).collect()
        bad = {(r["file"][-7:], r["line"]): r["problem"] for r in got if r["problem"]}
        assert set(bad) == {("a.jsonl", 601), ("a.jsonl", 1501), ("a.jsonl", 2000), ("b.jsonl", 2)}
        assert bad["a.jsonl", 601] == "invalid JSON" and bad["a.jsonl", 1501].startswith("not an object")
        assert {(r["q_uid"], r["line"]) for r in got if not r["problem"] and r["file"].endswith("a.jsonl")} == {(f"u{n}", n) for n in range(1, 2001) if n not in (11, 601, 1501, 2000)}
        with pytest.raises(Exception, match=r"invalid JSON at line 601 in .*a\.jsonl"):
            io.json_lines(spark, str(tmp_path / "p/a.jsonl"), "q_uid string").where("line < 1000").collect()
        (tmp_path / "q.csv").write_text("video,qid,question,a0,a1,a2,a3,a4,answer,type\n" + "".join(f"{n},,q,a,b,c,d,e,1,\n" for n in range(500)))
        assert {(r["video_id"], r["q_uid"]) for r in io.questions_csv(spark, str(tmp_path / "q.csv")).collect()} == {(str(n), str(n)) for n in range(500)}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def paths_of(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "path string")


def test_csv_samples(spark, tmp_path):
    (tmp_path / "q.csv").write_text("video,qid,question,a0,a1,a2,a3,a4,answer,type\n" + "".join(f"{v},{v},q,a,b,c,d,e,1,\n" for v in (1, 2, 3, 4)))
    listing = paths_of(spark, "file:/v/1.webm", "file:/v/1.avi", "file:/v/x/1.mp4", "file:/v/b/2.MP4", "file:/v/a/2.avi", "file:/v/z/3.mp4", "file:/v/3.txt", "file:/v/4.mp4")
    got = io.csv_samples(spark, str(tmp_path / "q.csv"), listing, "/v/").collect()
    assert {r["video_id"]: r["video_path"] for r in got} == {"1": "file:/v/1.avi", "2": "file:/v/a/2.avi", "3": "file:/v/z/3.mp4", "4": "file:/v/4.mp4"}
    with pytest.raises(Exception, match="no video for 4"):
        io.csv_samples(spark, str(tmp_path / "q.csv"), listing.where("path NOT LIKE '%4.mp4'"), "/v").collect()


def test_named_samples(spark, tmp_path):
    videos = [{"video_id": "10", "videoID": " ABC ", "domain": " ", "questions": [{"question_id": "10-2", "question": "q", "options": "[A. x\nB. y]", "task_type": "t", "answer": "A"}, {"question_id": "10-1", "question": "q", "options": ["x"]}]}, {"video_id": "9", "videoID": "mapped", "duration": "short", "questions": [{"question_id": "9-1", "question": "q", "options": ["x"], "response": "B"}]}]
    (tmp_path / "n.json").write_text(json.dumps(videos))
    questions = io.nested_questions(spark, str(tmp_path / "n.json"))
    listing = paths_of(spark, "/v/b/abc.mp4", "/v/A/Abc.webm", "/v/other.mkv")
    names = spark.createDataFrame([("mapped", "/data/clips/OTHER.mp4"), ("unused", "x")], "video string, file_name string")
    got = io.named_samples(questions, listing, names).collect()
    assert [(r["question_id"], r["video_path"], r["duration"], r["domain"]) for r in got] == [("9-1", "/v/other.mkv", "short", None), ("10-1", "/v/A/Abc.webm", None, None), ("10-2", "/v/A/Abc.webm", None, None)]
    with pytest.raises(Exception, match="no video for mapped"):
        io.named_samples(questions, listing).collect()
    (tmp_path / "e.json").write_text(json.dumps([{"video_id": "1", "questions": []}]))
    with pytest.raises(Exception, match="without questions"):
        io.nested_questions(spark, str(tmp_path / "e.json")).collect()


def test_task_samples(spark, tmp_path):
    item = lambda v: {"video": v, "question": "q", "candidates": ["Up", "Down"], "answer": "down"}
    (tmp_path / "move.json").write_text(json.dumps([item("a.mp4"), item("twice.mp4"), item("clip.mp4")]))
    listing = spark.createDataFrame([("/v/a.mp4", "a.mp4", True), ("/v/x/twice.mp4", "x/twice.mp4", True), ("/v/y/twice.mp4", "y/twice.mp4", True), ("/v/clip_1.0_2.5.mp4", "clip_1.0_2.5.mp4", True)], "path string, rel_path string, is_file boolean")
    got = io.task_samples(spark, str(tmp_path), listing).collect()
    assert {(r["video"], r["video_path"], r["ground_truth"]) for r in got} == {("a.mp4", "/v/a.mp4", 1), ("clip.mp4", "/v/clip_1.0_2.5.mp4", 1)}
    with pytest.raises(Exception, match="no video clip.mp4"):
        io.task_samples(spark, str(tmp_path), listing.where("path NOT LIKE '%clip%'")).collect()
    assert io.task_samples(spark, str(tmp_path), listing.where("path NOT LIKE '%clip%'"), skip_missing=True).count() == 1
    (tmp_path / "move.json").write_text(json.dumps([item(" ")]))
    with pytest.raises(Exception, match="invalid sample of move"):
        io.task_samples(spark, str(tmp_path), listing).collect()


def test_frame_folders(spark, tmp_path):
    for folder, names in (("fps2/one", ["f10.jpg", "f9.jpg", "f1.PNG", "note.txt"]), ("two", ["0.jpeg"])):
        (tmp_path / folder).mkdir(parents=True)
        for n in names:
            (tmp_path / folder / n).write_bytes(b"x")
    got = io.frame_folders(spark, str(tmp_path)).collect()
    place = {r["path"].split("/")[-1]: (r["frame_index"], r["fps"]) for r in got}
    assert place == {"f1.PNG": (0, 2.0), "f9.jpg": (1, 2.0), "f10.jpg": (2, 2.0), "0.jpeg": (0, 3.0)}
    one = next(r["video_id"] for r in got if r["path"].endswith("f9.jpg"))
    clips = spark.createDataFrame([(one, "c", 0.5, 1.0)], "video_id string, clip_id string, start double, end double")
    assert sorted(r["path"].split("/")[-1] for r in io.frame_clips(spark, str(tmp_path), clips).collect()) == ["f10.jpg", "f9.jpg"]
