"""Readers of questions, options, prompts and predictions, and writers of results. All return or take DataFrames."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievegrid.functions import text
from sievegrid.operators import sampling
from sievegrid.operators.evaluate import ambiguous_keys, key_variants, lookup, resolve, resolve_paths


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """file, n (from 1), line of text files, in the order of each file."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", "^﻿", "").alias("value"))
    each = whole.select("file", F.posexplode(F.split("value", r"\r?\n")).alias("n", "line"))
    return each.withColumn("n", F.col("n") + 1)


def _numbered(rows: DataFrame, out: str) -> DataFrame:
    """rows (_file, _block and more, as scanned) with `out`: the row's number in its file, from 1. Files may be split: rows are
    counted by block, and the counts summed up along each file."""
    placed = rows.withColumn("_at", F.monotonically_increasing_id())  # in the order of the scan, block by block
    counts = placed.groupBy("_file", "_block").agg(F.count("*").alias("_rows"), F.min("_at").alias("_first"))
    along = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("_file", "_block", "_first", F.coalesce(F.sum("_rows").over(along), F.lit(0)).alias("_before"))
    joined = placed.join(before, ["_file", "_block"])
    return joined.withColumn(out, F.col("_before") + F.col("_at") - F.col("_first") + 1).drop("_at", "_first", "_before", "_block")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line (from 1), value of text files that may be split over tasks; blank lines count."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"))
    return _numbered(lines, "line").select(F.col("_file").alias("file"), "line", "value")


def json_lines(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """file, line, problem and the columns of schema of JSONL files. Blank lines are skipped.

    A line that is no JSON, or no object, or has a field of another type, is an error that names file and line; if not strict
    it is a row with its problem and nulls. problem is null for good lines.
    """
    lines = numbered_lines(spark, path).withColumn("value", F.regexp_replace("value", r"^\ufeff?\s+|^\ufeff|\s+$", "")).where("value <> ''")
    kind = F.schema_of_variant(F.try_parse_json("value"))
    fields = spark.createDataFrame([], schema).columns
    row = F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    read = lines.withColumn("_row", row)
    problem = F.when(kind.isNull(), F.lit("invalid JSON")).when(~F.startswith(kind, F.lit("OBJECT")), F.concat(F.lit("not an object but "), kind)).when(F.col("_row._bad").isNotNull(), F.lit("a field of another type"))
    read = read.withColumn("problem", problem)
    if strict:
        told = F.concat(F.col("problem"), F.lit(" at line "), F.col("line").cast("string"), F.lit(" in "), F.col("file"))
        read = read.where(F.when(F.col("problem").isNull(), True).otherwise(F.raise_error(told).cast("boolean")))
    return read.select("file", "line", "problem", *[F.when(F.col("problem").isNull(), F.col(f"_row.{c}")).alias(c) for c in fields])


def query_lines(spark: SparkSession, path: str) -> DataFrame:
    """query_idx, query: the lines that aren't blank, in order; a file without any is an error when read."""
    lines = _lines(spark, path).withColumn("query", F.trim("line"))
    counted = lines.withColumn("some", F.count_if(F.col("query") != "").over(Window.partitionBy("file")))
    checked = F.when(F.col("some") > 0, F.col("query")).otherwise(F.raise_error(F.lit("no queries in the file")).cast("string"))
    full = counted.withColumn("query", checked).where("query <> ''")
    return full.select((F.row_number().over(Window.partitionBy("file").orderBy("n")) - 1).alias("query_idx"), "query")


def questions_csv(spark: SparkSession, path: str) -> DataFrame:
    """q_uid, video_id, question, options, ground_truth, question_type of a CSV with video, qid, question, a0 to a4, answer, type.

    Without a qid the uid is the number of the row in its file, from 0."""
    rows = spark.read.csv(path, header=True, multiLine=True, encoding="UTF-8", escape='"')
    rows = rows.toDF(*[c.removeprefix("﻿") for c in rows.columns])
    rows = _numbered(rows.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block")), "_n").withColumn("_n", F.col("_n") - 1)
    options = F.array(*[F.trim(F.col(f"a{i}")) for i in range(5)])
    truth = F.when(F.col("answer").rlike(r"^\s*[0-9]+\s*$"), F.trim("answer").cast("int"))
    kind = text.optional_text(F.col("type")) if "type" in rows.columns else F.lit(None).cast("string")
    video = F.trim(F.col("video").cast("string"))
    return rows.select(text.question_uid(video, F.col("qid").cast("string"), F.col("_n")).alias("q_uid"), video.alias("video_id"), F.trim("question").alias("question"), options.alias("options"), truth.alias("ground_truth"), kind.alias("question_type"))


def loose_variant(s: Column) -> Column:
    """JSON text as VARIANT; if it doesn't parse, once more without commas before closing brackets."""
    return F.coalesce(F.try_parse_json(s), F.parse_json(F.regexp_replace(s, r",(?=\s*[\]}])", "")))


def _get(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def _items(v: Column) -> tuple[Column, Column]:
    """The list of items in a payload, and the map of items by uid if it is none of a list or an object with one."""
    lists = [F.try_variant_get(v, "$", "array<variant>"), *[F.try_variant_get(v, f"$.{k}", "array<variant>") for k in ("questions", "data", "items", "annotations")]]
    return F.coalesce(*lists), F.try_variant_get(v, "$", "map<string, variant>")


def questions_json(spark: SparkSession, path: str) -> DataFrame:
    """q_uid, question, options, ground_truth, raw_item (JSON) of a list, an object that holds one, or an object by uid.

    The first key that is present gives a field: q_uid, quid, uid, question_uid; question, query, text, prompt; `option N` in
    order of N, else choices, options, candidates; answer, label, answer_idx, correct_option, target.
    """
    whole = spark.read.text(path, wholetext=True).select(loose_variant(F.col("value")).alias("v"))
    listed, keyed = _items(F.col("v"))
    pairs = F.transform(F.map_entries(keyed), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("item")))
    rows = whole.select(F.explode(F.coalesce(F.transform(listed, lambda i: F.struct(F.lit(None).cast("string").alias("key"), i.alias("item"))), pairs)).alias("e")).select("e.*")
    item = F.col("item")
    first = lambda *keys: text.first_present(*[_get(item, f"$.{k}") for k in keys])
    numbered = F.filter(F.map_entries(F.try_variant_get(item, "$", "map<string, variant>")), lambda e: F.lower(e["key"]).rlike(r"^option[\s_]*\d+$"))
    ordered = F.array_sort(F.transform(numbered, lambda e: F.struct(F.regexp_extract(e["key"], r"(\d+)$", 1).cast("int").alias("n"), e["value"].cast("string").alias("o"))))
    named = F.coalesce(*[F.try_variant_get(item, f"$.{k}", "array<string>") for k in ("choices", "options", "candidates")])
    options = F.when(F.size(ordered) > 0, F.transform(ordered, lambda o: o["o"])).otherwise(named)
    return rows.select(F.coalesce(first("q_uid", "quid", "uid", "question_uid"), F.col("key")).alias("q_uid"), first("question", "query", "text", "prompt").alias("question"), options.alias("options"), text.answer_index(first("answer", "label", "answer_idx", "correct_option", "target")).alias("ground_truth"), F.to_json(item).alias("raw_item"))


def uid_map(spark: SparkSession, path: str) -> DataFrame:
    """q_uid, url, video_uid of an object from uid to a URL or to an object with one; a given video_uid wins over the URL."""
    whole = spark.read.text(path, wholetext=True).select(F.explode(F.try_variant_get(loose_variant(F.col("value")), "$", "map<string, variant>")).alias("q_uid", "v"))
    url = F.coalesce(_get(F.col("v"), "$.url"), _get(F.col("v"), "$.video_url"), F.when(~F.to_json("v").startswith("{"), _get(F.col("v"), "$")))
    given = F.coalesce(*[_get(F.col("v"), f"$.{k}") for k in ("video_uid", "video_id", "uid", "google_drive_id")])
    named = F.coalesce(_get(F.col("v"), "$.video_uid"), text.url_uid(url), given)
    return whole.select("q_uid", url.alias("url"), named.alias("video_uid"))


def with_uid_metadata(questions: DataFrame, uids: DataFrame) -> DataFrame:
    """questions (q_uid and more) with url and video_uid of uid_map(), null without an entry. Both sides may be large."""
    return questions.join(uids.select("q_uid", "url", "video_uid"), "q_uid", "left")


def samples(spark: SparkSession, questions_path: str, uid_path: str, listing: DataFrame) -> DataFrame:
    """Samples of a question file and an uid map, with the path of each video in listing (path): the first of q_uid and video_uid
    that a file `<stem>.mp4` has. A question without a file is an error."""
    both = with_uid_metadata(questions_json(spark, questions_path), uid_map(spark, uid_path))
    files_ = listing.select(F.regexp_extract("path", r"([^/]+)\.mp4$", 1).alias("key"), "path").where("key <> ''")
    found = resolve_paths(both, files_, [F.col("q_uid"), F.col("video_uid")])
    lost = F.raise_error(F.concat(F.lit("no video for "), F.col("q_uid"))).cast("string")
    return found.withColumn("video_path", F.coalesce("path", lost)).drop("path")


def questions_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Annotations with video_id, question_id, question, options (array or bracketed text) and what else they have; blank text is null."""
    rows = spark.read.parquet(path)
    options = F.col("options") if dict(rows.dtypes)["options"].startswith("array") else text.split_options(F.col("options"))
    return rows.select(*[options.alias("options") if c == "options" else text.optional_text(F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in rows.dtypes])


def nested_questions(spark: SparkSession, path: str) -> DataFrame:
    """One row per question of a list of videos with `questions`: video_id, videoID (else the video_id), duration, domain,
    sub_category, question_id, task_type, question, options, answer, response. A video without questions is an error."""
    whole = spark.read.text(path, wholetext=True).select(F.explode(F.try_variant_get(loose_variant(F.col("value")), "$", "array<variant>")).alias("v"))
    needed = lambda c, name: F.when(text.optional_text(c).isNotNull(), F.trim(c)).otherwise(F.raise_error(F.lit(f"missing {name}")).cast("string"))
    of = lambda c, k: text.optional_text(_get(F.col(c), f"$.{k}")).alias(k)
    asked = F.try_variant_get("v", "$.questions", "array<variant>")
    some = F.when(F.size(asked) > 0, asked).otherwise(F.raise_error(F.lit("a video without questions")).cast("array<variant>"))
    name = F.coalesce(_get(F.col("v"), "$.videoID"), _get(F.col("v"), "$.video_id"))
    each = whole.select(needed(_get(F.col("v"), "$.video_id"), "video_id").alias("video_id"), F.trim(name).alias("videoID"), *[of("v", k) for k in ("duration", "domain", "sub_category")], F.explode(some).alias("q"))
    options = F.coalesce(F.try_variant_get("q", "$.options", "array<string>"), text.split_options(_get(F.col("q"), "$.options")))
    return each.select("video_id", "videoID", "duration", "domain", "sub_category", needed(_get(F.col("q"), "$.question_id"), "question_id").alias("question_id"), of("q", "task_type"), needed(_get(F.col("q"), "$.question"), "question").alias("question"), options.alias("options"), of("q", "answer"), _get(F.col("q"), "$.response").alias("response"))


#: Suffixes of videos, in the order in which one beside the others is preferred; fixed values.
VIDEO_SUFFIXES = ("mp4", "avi", "webm")


def _relative(folder: str) -> Column:
    """The path of a listed file below the folder; schemes and leading slashes don't matter."""
    root = re.sub(r"^(?:[a-z]+:)?/*|/+$", "", folder) + "/"
    bare = F.regexp_replace("path", r"^(?:[a-z]+:)?/*", "")
    return F.when(F.startswith(bare, F.lit(root)), F.substring(bare, len(root) + 1, 1 << 30)).otherwise(bare)


def csv_samples(spark: SparkSession, path: str, listing: DataFrame, folder: str) -> DataFrame:
    """questions_csv() with video_path: `<video>.mp4`, `.avi` or `.webm` in the folder, in this order, else the first file of that stem
    in any folder below, in order of folder and name. listing: path of the files. A question without a file is an error."""
    rel = listing.select("path", _relative(folder).alias("rel"))
    name = F.regexp_extract("rel", r"([^/]+)$", 1)
    video = rel.where(F.lower(F.regexp_extract("rel", r"\.([^./]+)$", 1)).isin(*VIDEO_SUFFIXES))
    by_stem = video.select(F.regexp_replace(name, r"\.[^.]+$", "").alias("key"), "path", F.lower("rel").alias("order"))
    listings = {"name": rel.select(F.col("rel").alias("key"), "path", F.lit("").alias("order")), "stem": by_stem}
    rules = [*[("name", F.concat("video_id", F.lit(f".{x}"))) for x in VIDEO_SUFFIXES], ("stem", F.col("video_id"))]
    return _needs_video(resolve(questions_csv(spark, path), listings, rules), F.col("video_id"))


def named_samples(questions: DataFrame, listing: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """questions (video_id, videoID, question_id and more) with video_path, in order of video_id by length, then as text, then question_id.

    A video is found by its name, or name with .mp4, among names and stems of the files in listing (path), whatever the case;
    else by the file name that names (video, file_name) has for it, by that one's last part, or by its stem. Of files
    with one name the first by folder and name counts. A question without a file is an error.
    """
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    order = F.concat_ws("\0", F.lower(F.regexp_extract("path", r"^(.*?)/?[^/]+$", 1)), F.lower(name))
    keys = listing.select("path", order.alias("order"), F.explode(F.array_distinct(F.array(F.lower(name), F.lower(F.regexp_replace(name, r"(?<=.)\.[^.]+$", ""))))).alias("key"))
    rows = questions.withColumn("_name", F.trim("videoID"))
    rows = rows.join(names.select(F.col("video").alias("_name"), F.col("file_name").alias("_mapped")).dropDuplicates(["_name"]), "_name", "left") if names is not None else rows.withColumn("_mapped", F.lit(None).cast("string"))
    last = F.regexp_extract("_mapped", r"([^/]+)$", 1)
    tried = [F.col("_name"), F.concat("_name", F.lit(".mp4")), F.col("_mapped"), last, F.regexp_replace(last, r"(?<=.)\.[^.]+$", "")]
    found = _needs_video(resolve(rows, {"": keys}, [("", F.lower(c)) for c in tried]), F.col("_name")).drop("_name", "_mapped")
    return found.orderBy(F.length("video_id"), "video_id", "question_id")


def task_samples(spark: SparkSession, folder: str, listing: DataFrame, names: list[str] | None = None, skip_missing: bool = False) -> DataFrame:
    """task_files() with video_path by lookup() in listing (path, rel_path, is_file).

    Samples whose video or its stem is an ambiguous key are left out; one without a video is an error, or left out too if
    skip_missing. Blank video, question or answer, and missing candidates, are errors.
    """
    rows = task_files(spark, folder, names).withColumn("video", F.trim("video"))
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    wrong = blank("video") | blank("question") | blank("answer") | F.col("candidates").isNull()
    rows = rows.withColumn("video", F.when(~wrong, F.col("video")).otherwise(F.raise_error(F.concat(F.lit("invalid sample of "), F.col("task_name"))).cast("string")))
    keys = ambiguous_keys(listing.select("path", key_variants(F.col("rel_path"), F.col("is_file")).alias("keys"))).where("ambiguous").select("key")
    stem = F.lower(F.regexp_replace(F.regexp_extract("video", r"([^/]+)$", 1), r"(?<=.)\.[^.]*$", ""))
    plain = rows.join(keys, (F.lower("video") == F.col("key")) | (stem == F.col("key")), "left_anti")
    return lookup(plain, listing, "video", skip_missing).withColumnRenamed("path", "video_path")


def _needs_video(found: DataFrame, name: Column) -> DataFrame:
    lost = F.raise_error(F.concat(F.lit("no video for "), name)).cast("string")
    return found.withColumn("video_path", F.coalesce("path", lost)).drop("path")


def task_files(spark: SparkSession, folder: str, names: list[str] | None = None) -> DataFrame:
    """task_name (a file's stem), sample_index, video, question, candidates, ground_truth, start, end of *.json files.

    names: only these tasks; one without a file is an error. Negative times are null.
    """
    whole = spark.read.text(f"{folder}/*.json", wholetext=True).select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.json$", 1).alias("task_name"), "value")
    if names is not None:
        have = {r[0] for r in whole.select("task_name").distinct().collect()}
        if missing := sorted(set(names) - have):
            raise ValueError(f"no file for {missing}")
        whole = whole.where(F.col("task_name").isin(names))
    schema = "array<struct<video:string,question:string,candidates:array<string>,answer:string,start:double,end:double>>"
    each = whole.select("task_name", F.posexplode(F.from_json("value", schema)).alias("sample_index", "q")).select("task_name", "sample_index", "q.*")
    time = lambda c: text.optional_number(F.col(c)).alias(c)
    return each.select("task_name", "sample_index", "video", "question", "candidates", "answer", text.text_answer_index(F.col("answer"), F.col("candidates")).alias("ground_truth"), time("start"), time("end"))


def video_map(spark: SparkSession, path: str) -> DataFrame:
    """video, file_name of a CSV or of a JSON object; rows without either are left out."""
    if path.endswith(".json"):
        rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("video", "file_name"))
    else:
        rows = spark.read.csv(path, header=True)
        name = F.coalesce(*[F.col(c) for c in ("file_name", "filename") if c in rows.columns])
        rows = rows.select(F.col("video_id" if "video_id" in rows.columns else rows.columns[0]).alias("video"), name.alias("file_name"))
    return rows.where((F.trim("video") != "") & (F.trim("file_name") != ""))


def files(spark: SparkSession, folder: str, suffix: str = "*") -> DataFrame:
    """path, length of the files below a folder; their content isn't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{suffix}").load(folder).select("path", "length")


def frame_folder_fps(path: Column) -> Column:
    """The first number above 0 that follows `fps` in any part of a folder's path, whatever the case, else 3.0. The pattern and
    the default are fixed values."""
    parts = F.transform(F.split(F.lower(path), "/"), lambda p: F.nullif(F.regexp_extract(p, r"fps([0-9]+(?:\.[0-9]+)?)", 1), F.lit("")).cast("double"))
    return F.coalesce(F.get(F.filter(parts, lambda x: x > 0), 0), F.lit(3.0))


#: Suffixes of images that count as frames; fixed values.
FRAME_SUFFIXES = ("jpg", "jpeg", "png", "bmp", "webp")


def frame_folders(spark: SparkSession, folder: str) -> DataFrame:
    """video_id (the folder of the frames), frame_index (from 0), path, fps of all images below a folder: a folder's images in natural
    order of their names, so that f9 comes before f10; fps from the folder's path. Files are listed, not read."""
    images = files(spark, folder).where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*FRAME_SUFFIXES))
    parent, name = F.regexp_extract("path", r"^(.*)/[^/]+$", 1), F.regexp_extract("path", r"([^/]+)$", 1)
    rows = images.select(parent.alias("video_id"), "path", text.natural_key(name).alias("_key"))
    place = F.row_number().over(Window.partitionBy("video_id").orderBy("_key", "path")) - 1
    return rows.select("video_id", place.cast("long").alias("frame_index"), "path", frame_folder_fps(F.col("video_id")).alias("fps"))


def frame_clips(spark: SparkSession, folder: str, clips: DataFrame) -> DataFrame:
    """The frames of frame_folders() that clips (video_id, clip_id, start, end, in seconds) cover, by each folder's fps."""
    found = frame_folders(spark, folder)
    rates = found.groupBy("video_id").agg(F.first("fps").alias("fps"))
    return sampling.clip(found, clips.join(rates, "video_id"))


def prompt_template(spark: SparkSession, path: str) -> DataFrame:
    """system, user: the lines after [SYSTEM] and [USER]; text without either section is the user's; no user text is an error."""
    lines = _lines(spark, path)
    mark = F.regexp_extract(F.upper(F.trim("line")), r"^\[(SYSTEM|USER)\]$", 1)
    order = Window.partitionBy("file").orderBy("n")
    tagged = lines.withColumn("mark", F.nullif(mark, F.lit(""))).withColumn("section", F.coalesce(F.last("mark", ignorenulls=True).over(order), F.lit("USER")))
    body = tagged.where("mark IS NULL").groupBy("file", "section").agg(F.array_sort(F.collect_list(F.struct("n", "line"))).alias("l"))
    joined = body.select("file", "section", F.regexp_replace(F.array_join(F.transform("l", lambda x: x["line"]), "\n"), r"^\s+|\s+$", "").alias("t"))
    sections = joined.groupBy("file").agg(F.max(F.when(F.col("section") == "SYSTEM", F.col("t"))).alias("system"), F.max(F.when(F.col("section") == "USER", F.col("t"))).alias("user"))
    user = F.when(F.coalesce("user", F.lit("")) != "", F.col("user")).otherwise(F.raise_error(F.lit("no [USER] section")).cast("string"))
    return sections.select(F.coalesce("system", F.lit("")).alias("system"), user.alias("user"))


def predictions(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """Rows of JSONL files; a line that isn't an object of this schema is an error that names it, or left out if not strict."""
    rows = json_lines(spark, path, schema, strict)
    good = rows if strict else rows.where("problem IS NULL")  # that condition would hide the bad lines from the error
    return good.drop("file", "line", "problem")


def completed(spark: SparkSession, path: str, uid: str = "q_uid") -> DataFrame:
    """Ids that a results file holds: lines that don't parse and null ids are skipped."""
    return predictions(spark, path, f"{uid} string", strict=False).where(F.col(uid).isNotNull()).distinct()


def chart_values(spark: SparkSession, path: str, marker: str, name: str) -> DataFrame:
    """position, x, y of the trace `name` in the first JSON array after a marker in a page; a page without either is an error."""

    @F.pandas_udf("string")
    def array_after(pages: pd.Series) -> pd.Series:
        def one(page: str) -> str | None:
            at = page.find(marker)
            start = page.find("[", at + len(marker)) if at >= 0 else -1
            return None if start < 0 else json.dumps(json.JSONDecoder().raw_decode(page, start)[0])

        return pages.map(one)

    traces = F.from_json(array_after("value"), "array<struct<name:string,x:array<double>,y:array<double>>>")
    named = F.filter(traces, lambda t: t["name"] == name)
    checked = F.when(F.size(named) > 0, named).otherwise(F.raise_error(F.lit(f"no trace {name} after {marker}")).cast("array<struct<name:string,x:array<double>,y:array<double>>>"))
    one = spark.read.text(path, wholetext=True).select(F.explode(checked).alias("t"))
    return one.select(F.posexplode(F.arrays_zip(F.col("t.x").alias("x"), F.col("t.y").alias("y"))).alias("position", "v")).select("position", "v.*")


def cached(spark: SparkSession, path: str, key: dict[str, object], make: Callable[[], DataFrame]) -> DataFrame:
    """What an earlier call with the same key (such as frame count, model, queries, aggregation) stored under path, else what
    make() gives, which takes its place. A folder that breaks off while it is written counts as none."""
    shown = json.dumps(key, sort_keys=True, default=str)
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        rows = spark.read.parquet(path)
        first = rows.select("_cache_key").first()
        if first is not None and first[0] == shown:
            return rows.drop("_cache_key")
    make().withColumn("_cache_key", F.lit(shown)).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path).drop("_cache_key")


def append_results(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def write_results(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_submission(nested: DataFrame, path: str) -> None:
    """One JSON object per video, in order of its id's length, then its id."""
    nested.orderBy(F.length(F.col("video_id").cast("string")), "video_id").write.mode("overwrite").json(path)


def upload_payload(rows: DataFrame) -> DataFrame:
    """One JSON object from uid to prediction, as text, of rows with both: a submission, which is one value by definition and so
    in one task. Sending it is left to the caller."""
    usable = rows.where(F.col("prediction").isNotNull() & ~F.coalesce("parse_method", F.lit("")).isin("unparsed", "empty_response"))
    return usable.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("q_uid").cast("string").alias("key"), F.col("prediction").alias("value")))))).alias("payload"))
