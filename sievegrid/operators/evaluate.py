"""Accuracy in its several definitions, breakdowns, metric summaries, resuming and submissions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievegrid.functions.text import first_letter

#: A time range at the end of a stem, `_1.5_20`: a fixed value.
TIME_RANGE = r"_[0-9]+(?:\.[0-9]+)?_[0-9]+(?:\.[0-9]+)?$"


def share(part: Column, whole: Column) -> Column:
    return part / F.nullif(whole, F.lit(0))


def accuracy_labelled(rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """correct over labelled rows (prediction, ground_truth): unparsed counts as wrong, unlabelled not at all."""
    right = F.count_if(F.col("prediction").eqNullSafe(F.col("ground_truth")) & F.col("ground_truth").isNotNull())
    counts = rows.groupBy(*(keys or [])).agg(F.count("*").alias("total"), F.count("ground_truth").alias("labelled"), right.alias("correct"))
    return counts.withColumn("accuracy", share(F.col("correct"), F.col("labelled")))


def accuracy_all(rows: DataFrame, keys: list[str]) -> DataFrame:
    """correct over all rows of a task: unlabelled counts as wrong; the share of answered rows apart."""
    right = F.count_if(F.coalesce(F.col("prediction") == F.col("ground_truth"), F.lit(False)))
    counts = rows.groupBy(*keys).agg(F.count("*").alias("total"), F.count("prediction").alias("answered"), right.alias("correct"))
    return counts.withColumn("accuracy", share(F.col("correct"), F.col("total"))).withColumn("answer_rate", share(F.col("answered"), F.col("total")))


def matched(predictions: DataFrame, labels: DataFrame, uid: str = "q_uid") -> DataFrame:
    """correct over the predictions that have a label; and how many are matched, missing and extra. Both sides: one row per uid."""
    both = predictions.select(uid, "prediction", F.lit(1).alias("p")).join(labels.select(uid, "ground_truth", F.lit(1).alias("l")), uid, "full_outer")
    has = lambda c: F.col(c).isNotNull()
    counts = both.agg(F.count_if(has("p") & has("l")).alias("matched"), F.count_if(has("l") & ~has("p")).alias("missing"), F.count_if(has("p") & ~has("l")).alias("extra"), F.count_if(has("p") & has("l") & (F.col("prediction") == F.col("ground_truth"))).alias("correct"))
    return counts.withColumn("accuracy", share(F.col("correct"), F.col("matched")))


def missing_and_extra(predictions: DataFrame, labels: DataFrame, uid: str = "q_uid") -> DataFrame:
    """uid and status of labels without a prediction (missing) and predictions without a label (extra)."""
    part = lambda a, b, name: a.join(b, uid, "left_anti").select(uid, F.lit(name).alias("status"))
    return part(labels, predictions, "missing").unionByName(part(predictions, labels, "extra"))


def pending(samples: DataFrame, completed: DataFrame, uid: str = "q_uid") -> DataFrame:
    """Samples whose uid has no row among the completed ones; null uids there count for nothing."""
    return samples.join(completed.where(F.col(uid).isNotNull()).select(uid).distinct(), uid, "left_anti")


def breakdown(rows: DataFrame, keys: list[str]) -> DataFrame:
    """dimension, value, total, correct, missing, accuracy_pct, missing_pct for each key and over all, in one pass.

    rows: prediction_letter, answer_letter and the keys. Blank or null keys are 'unknown'; a blank letter is missing; an
    empty answer is never met.
    """
    known = lambda c: F.coalesce(F.nullif(F.trim(F.col(c)), F.lit("")), F.lit("unknown"))
    each = F.array(*[F.struct(F.lit(k).alias("dimension"), known(k).alias("value")) for k in keys], F.struct(F.lit("all").alias("dimension"), F.lit("all").alias("value")))
    long = rows.select(F.explode(each).alias("d"), first_letter(F.col("prediction_letter")).alias("p"), first_letter(F.col("answer_letter")).alias("a"))
    counts = long.groupBy("d.dimension", "d.value").agg(F.count("*").alias("total"), F.count_if((F.col("p") != "") & (F.col("p") == F.col("a"))).alias("correct"), F.count_if(F.col("p") == "").alias("missing"))
    return counts.withColumn("accuracy_pct", 100.0 * F.col("correct") / F.col("total")).withColumn("missing_pct", 100.0 * F.col("missing") / F.col("total"))


def metric_summary(rows: DataFrame, metrics: list[str], keys: list[str] | None = None) -> DataFrame:
    """metric, samples, total, average, peak of numeric columns: nulls are left out, an average over none is null."""
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("m")
    agg = rows.select(*(keys or []), each).groupBy(*(keys or []), "m.metric")
    return agg.agg(F.count("m.value").alias("samples"), F.sum("m.value").alias("total"), F.avg("m.value").alias("average"), F.max("m.value").alias("peak"))


def top_ops(ops: DataFrame, n: int) -> DataFrame:
    """Of ops (name, flops): the n with most flops in sum, calls with flops above 0, and gflops; ties by name."""
    sums = ops.groupBy("name").agg(F.sum("flops").alias("flops"), F.count_if(F.col("flops") > 0).alias("calls"))
    return sums.withColumn("gflops", F.col("flops") / 1e9).orderBy(F.col("flops").desc(), "name").limit(n)


def ops_total(ops: DataFrame) -> DataFrame:
    """Of all operations of ops (name, flops): flops, gflops, names with flops above 0, and calls with some."""
    total = ops.agg(F.coalesce(F.sum("flops"), F.lit(0.0)).cast("double").alias("flops"), F.count_distinct(F.when(F.col("flops") > 0, F.col("name"))).alias("ops"), F.count_if(F.col("flops") > 0).alias("calls"))
    return total.withColumn("gflops", F.col("flops") / 1e9)


def histogram(rows: DataFrame, column: str = "parse_method") -> DataFrame:
    return rows.groupBy(column).agg(F.count("*").alias("n"))


def submission(rows: DataFrame) -> DataFrame:
    """video_id, n_questions, questions: rows (video_id, question_id, response) nested, questions in order of id."""
    one = F.struct("question_id", F.coalesce("response", F.lit("")).alias("response"))
    return rows.groupBy("video_id").agg(F.count("*").alias("n_questions"), F.array_sort(F.collect_list(one)).alias("questions"))


def submission_stats(rows: DataFrame) -> DataFrame:
    filled = F.coalesce(F.trim("response"), F.lit("")) != ""
    return rows.agg(F.count_distinct("video_id").alias("videos"), F.count("*").alias("questions"), F.count_if(filled).alias("filled"), F.count_if(~filled).alias("empty"))


def last_wins(rows: DataFrame, uid: str, line: str) -> DataFrame:
    """Of rows that share a uid the one with the greatest line number, in one aggregation."""
    rest = [c for c in rows.columns if c != uid]
    return rows.groupBy(uid).agg(F.max_by(F.struct(*rest), F.col(line)).alias("_r")).select(uid, "_r.*")


def fill_responses(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """questions with the response of the same (video_id, question_id), '' without one."""
    return questions.drop("response").join(answers.select("video_id", "question_id", "response"), ["video_id", "question_id"], "left").withColumn("response", F.coalesce("response", F.lit("")))


def pick_sample(samples: DataFrame, wanted: str, columns: list[str], order: str) -> DataFrame:
    """The first sample, in `order`, any of whose columns equals the id, whatever the case."""
    hit = F.exists(F.array(*[F.lower(F.trim(F.col(c).cast("string"))) for c in columns]), lambda x: x == wanted.strip().lower())
    return samples.where(hit).orderBy(order).limit(1)


def sliced(samples: DataFrame, order: list[str], start: int | None = None, limit: int | None = None) -> DataFrame:
    """Samples from position `start` on, `limit` at most; none or a negative number: no bound."""
    ordered = samples.orderBy(*order)
    ordered = ordered.offset(start) if start and start > 0 else ordered
    return ordered.limit(limit) if limit is not None and limit >= 0 else ordered


def resolve(samples: DataFrame, listings: dict[str, DataFrame], rules: list[tuple[str, Column]], out: str = "path") -> DataFrame:
    """samples with `out`: the path that the first of the rules finds, null if none does.

    listings: (key, path) by name; a key that several paths have stands for the least one by (order, path), if the listing
    has a column `order`. rules: the name of a listing and the key to look up there, in order of priority. All rules go through one join
    and one aggregation, by the different sets of keys and not by rows, which may repeat.
    """
    every = None
    for name, rows in listings.items():
        order = F.col("order").cast("string") if "order" in rows.columns else F.lit("")
        one = rows.select(F.lit(name).alias("listing"), "key", F.struct(order.alias("order"), F.col("path").alias("path")).alias("hit"))
        every = one if every is None else every.unionByName(one)
    found = every.groupBy("listing", "key").agg(F.min("hit").alias("hit"))
    keyed = samples.withColumn("_keys", F.array(*[F.coalesce(k.cast("string"), F.lit("")) for _, k in rules]))
    names = F.array(*[F.lit(n) for n, _ in rules])
    tries = keyed.select("_keys").distinct().select("_keys", F.posexplode(F.arrays_zip(names.alias("listing"), F.col("_keys").alias("key"))).alias("rule", "x")).select("_keys", "rule", "x.*")
    best = tries.join(found, ["listing", "key"]).groupBy("_keys").agg(F.min_by("hit", "rule")["path"].alias(out))
    return keyed.join(best, "_keys", "left").drop("_keys")


def resolve_paths(samples: DataFrame, listing: DataFrame, candidates: list[Column]) -> DataFrame:
    """samples with path: that of the first candidate key found in listing (key, path); null if none is."""
    return resolve(samples, {"": listing}, [("", c) for c in candidates])


def key_variants(rel_path: Column, is_file: Column) -> Column:
    """Keys by which a video or a folder of frames is found, in lower case: its name and its relative path, and of a file
    these without extension, and without a time range behind them."""
    name = F.regexp_extract(rel_path, r"([^/]+)$", 1)
    bare = lambda c: F.regexp_replace(c, r"(?<=[^/])\.[^./]*$", "")
    plain = lambda c: F.regexp_replace(bare(c), TIME_RANGE, "")
    of_files = F.when(is_file, F.array(bare(name), plain(name), bare(rel_path), plain(rel_path))).otherwise(F.array().cast("array<string>"))
    keys = F.transform(F.concat(F.array(name, rel_path), of_files), F.lower)
    return F.filter(F.array_distinct(keys), lambda k: k != "")


def lookup(samples: DataFrame, listing: DataFrame, video: str, skip: bool = False) -> DataFrame:
    """samples with path: by their video's name, else its stem, among the keys of listing (path, rel_path, is_file).

    A key that leads to more than one path is ambiguous. A sample whose key is, or has no path, is an error, or left out.
    """
    keys = listing.select("path", F.explode(key_variants(F.col("rel_path"), F.col("is_file"))).alias("key"))
    paths = keys.groupBy("key").agg(F.min("path").alias("path"), F.count_distinct("path").alias("n"))
    name = F.lower(F.col(video))
    tries = F.array(name, F.regexp_replace(F.regexp_extract(name, r"([^/]+)$", 1), r"(?<=.)\.[^.]*$", ""))
    keyed = samples.withColumn("_id", F.monotonically_increasing_id())
    each = keyed.select("_id", F.posexplode(tries).alias("order", "key")).join(paths, "key")
    best = each.groupBy("_id").agg(F.min_by(F.struct("path", "n"), "order").alias("_hit"))
    found = keyed.join(best, "_id", "left").drop("_id")
    if skip:
        return found.where("_hit.n = 1").withColumn("path", F.col("_hit.path")).drop("_hit")
    wrong = F.when(F.col("_hit.n") > 1, F.lit("ambiguous video ")).otherwise(F.lit("no video "))
    path = F.when(F.col("_hit.n") == 1, F.col("_hit.path")).otherwise(F.raise_error(F.concat(wrong, F.col(video))).cast("string"))
    return found.withColumn("path", path).drop("_hit")


def ambiguous_keys(listing: DataFrame) -> DataFrame:
    """key, paths, ambiguous of listing (path, keys): keys that lead to more than one path are ambiguous."""
    keys = listing.select("path", F.explode(F.array_distinct("keys")).alias("key"))
    return keys.groupBy("key").agg(F.count_distinct("path").alias("paths")).withColumn("ambiguous", F.col("paths") > 1)


def first_by_stem(files: DataFrame) -> DataFrame:
    """stem, path: of files that share a stem the first by folder and name, whatever the case."""
    folder, name = F.regexp_extract("path", r"^(.*?)/?([^/]+)$", 1), F.regexp_extract("path", r"([^/]+)$", 1)
    stem = F.regexp_replace(name, r"\.[^.]+$", "")
    return files.select(stem.alias("stem"), "path", F.row_number().over(Window.partitionBy(stem).orderBy(F.lower(folder), F.lower(name), "path")).alias("n")).where("n = 1").drop("n")
