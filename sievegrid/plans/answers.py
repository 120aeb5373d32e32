"""Queries on answers, labels, metrics and paths. Conversations stand in for responses, documents and their labels for
questions, events for metrics, URLs of pages for files (sources/canonical.py says how)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievegrid.functions import text
from sievegrid.operators import diagnostics, evaluate, parsing, sync
from sievegrid.plans.registry import query
from sievegrid.sources.canonical import table

OPTIONS = ["the first", "a second one", "in the middle", "of all"]
_LIST = "['the first', 'a second one', 'in the middle', 'of all']"


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    return c.select("conv_id", "turn", F.col("text").alias("response"), F.array(*map(F.lit, OPTIONS)).alias("options"))


FOLDED = f"""r AS (SELECT conv_id, turn, text AS response, {_LIST} AS options FROM conversations WHERE role = 'assistant'),
    folded AS (SELECT *, regexp_replace(trim(response), '[À-ÖØ-öø-ÿĀ-ſ]', '_', 'g') AS s, regexp_replace(trim(upper(response)), '[À-ÖØ-öø-ÿĀ-ſ]', '_', 'g') AS u,
        trim(regexp_replace(regexp_replace(lower(response), '[^0-9a-z\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS m FROM r)"""
CUE = r"(?i)\b(?:answer|option|choice)?\s*[:#\-]?\s*"
HITS = f"""{FOLDED}, hits AS (SELECT *, list_transform(regexp_extract_all(s, '{CUE}([0-9])\\b', 1), lambda d: d::INT) AS digits,
    list_transform(regexp_extract_all(u, '{CUE}([LETTERS])\\b', 1), lambda c: ascii(upper(c)) - 65) AS letters, list_position(list_transform(options, lambda o: contains(m, o) OR contains(o, m)), true) - 1 AS sub FROM folded)"""


@query(f"""WITH {HITS.replace('LETTERS', 'A-E')}, p AS (SELECT *, list_filter(digits, lambda d: d < 4)[1] AS i, list_filter(letters, lambda d: d < 4)[1] AS l,
        CASE WHEN sub >= 0 THEN sub END AS b FROM hits)
    SELECT conv_id, turn, CASE WHEN trim(response) = '' THEN NULL ELSE coalesce(i, l, b) END::BIGINT AS prediction,
    CASE WHEN trim(response) = '' THEN 'empty_response' WHEN i IS NOT NULL THEN 'index_regex' WHEN l IS NOT NULL THEN 'letter_regex' WHEN b IS NOT NULL THEN 'substring_match' ELSE 'unparsed' END AS parse_method FROM p""")
def parse_index_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsing.parse_index_first(responses(spark, sf_dir)).drop("response", "options")


LETTER_FIRST = f"""WITH {HITS.replace('LETTERS', 'A-D')}, p AS (SELECT *, list_filter(digits, lambda d: d <= 4)[1] AS i, list_filter(letters, lambda d: d < 4)[1] AS l,
        CASE WHEN sub >= 0 THEN sub END AS b FROM hits),
    parsed AS (SELECT conv_id, turn, response, CASE WHEN trim(response) = '' THEN NULL ELSE coalesce(l, CASE WHEN i < 4 THEN i ELSE i - 1 END, b) END::BIGINT AS prediction,
    CASE WHEN trim(response) = '' THEN 'empty_response' WHEN l IS NOT NULL THEN 'letter_regex' WHEN i < 4 THEN 'index_regex' WHEN i IS NOT NULL THEN 'one_based_index_regex' WHEN b IS NOT NULL THEN 'substring_match' ELSE 'raw_response' END AS parse_method FROM p)"""


@query(f"{LETTER_FIRST} SELECT conv_id, turn, prediction, parse_method, CASE WHEN prediction IS NOT NULL THEN chr(65 + prediction::INT) ELSE trim(response) END AS letter FROM parsed")
def parse_letter_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsing.parse_letter_first(responses(spark, sf_dir)).drop("response", "options")


@query()
def parse_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark item and its text with a word less, as response and options; the ratio has no SQL form."""
    b = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("t"))
    rows = b.select("item_id", F.regexp_replace("t", r"^\S+\s+\S+\s", "zz ").alias("response"), F.array(F.lit("nothing like it"), F.col("t")).alias("options"))
    return parsing.parse_index_first(rows, fuzzy=True).drop("response", "options")


@query(f"{LETTER_FIRST} SELECT parse_method, count(*) AS n FROM parsed GROUP BY ALL")
def parse_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.histogram(parsing.parse_letter_first(responses(spark, sf_dir)))


@query(f"""{LETTER_FIRST}, t AS (SELECT 'turn' || (turn % 4) AS task_name, prediction, (conv_id % 4)::BIGINT AS truth FROM parsed)
    SELECT task_name, count(*) AS total, count(prediction) AS answered, count(*) FILTER (WHERE prediction = truth) AS correct,
        round(count(*) FILTER (WHERE prediction = truth) / count(*), 6) AS accuracy, round(count(prediction) / count(*), 6) AS answer_rate
        FROM t GROUP BY ALL""")
def task_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parsing.parse_letter_first(responses(spark, sf_dir)).withColumn("task_name", F.concat(F.lit("turn"), F.col("turn") % 4)).withColumn("ground_truth", F.col("conv_id") % 4)
    return evaluate.accuracy_all(rows, ["task_name"]).withColumns({c: F.round(c, 6) for c in ("accuracy", "answer_rate")})


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as questions: longer than 1,200 characters predicts quality 1, fewer than 200 gives no prediction."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.when(F.col("n_chars") >= 200,(F.col("n_chars") > 1200).cast("int")).alias("prediction"))
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("ground_truth"))
    return docs.join(labels, "doc_id", "left")


JUDGED = "j AS (SELECT doc_id, lang, source, CASE WHEN n_chars >= 200 THEN (n_chars > 1200)::INT END AS prediction, quality AS truth FROM documents LEFT JOIN labels USING (doc_id))"


@query(f"""WITH {JUDGED} SELECT lang, count(*) AS total, count(truth) AS labelled, count(*) FILTER (WHERE prediction = truth) AS correct, round(count(*) FILTER (WHERE prediction = truth) / nullif(count(truth), 0), 6) AS accuracy FROM j GROUP BY lang""")
def accuracy_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.accuracy_labelled(judged(spark, sf_dir), ["lang"]).withColumn("accuracy", F.round("accuracy", 6))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with fewer than 200 characters have no prediction."""
    d = table(spark, sf_dir, "documents").where("n_chars >= 200")
    return d.select(F.col("doc_id").alias("q_uid"), (F.col("n_chars") > 1200).cast("int").alias("prediction"))


def truths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("q_uid"), F.col("quality").alias("ground_truth"))


PREDICTED = "p AS (SELECT doc_id AS q_uid, (n_chars > 1200)::INT AS prediction FROM documents WHERE n_chars >= 200), l AS (SELECT doc_id AS q_uid, quality AS truth FROM labels)"


@query(f"""WITH {PREDICTED}, f AS (SELECT p.q_uid AS pu, l.q_uid AS lu, prediction, truth FROM p FULL
        JOIN l ON p.q_uid = l.q_uid), c AS (SELECT count(*) FILTER (WHERE pu IS NOT NULL AND lu IS NOT NULL) AS matched,
    count(*) FILTER (WHERE pu IS NULL) AS missing, count(*) FILTER (WHERE lu IS NULL) AS extra,
        count(*) FILTER (WHERE prediction = truth) AS correct FROM f) SELECT *, round(correct / nullif(matched, 0), 6) AS accuracy FROM c""")
def accuracy_matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.matched(predictions(spark, sf_dir), truths(spark, sf_dir)).withColumn("accuracy", F.round("accuracy", 6))


@query(f"""WITH {PREDICTED} SELECT q_uid, 'missing' AS status FROM l WHERE q_uid NOT IN (SELECT q_uid FROM p) UNION ALL SELECT q_uid, 'extra' FROM p WHERE q_uid NOT IN (SELECT q_uid FROM l)""")
def missing_extra_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.missing_and_extra(predictions(spark, sf_dir), truths(spark, sf_dir))


@query("SELECT doc_id AS q_uid, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("q_uid"), "lang")
    return evaluate.pending(samples, truths(spark, sf_dir))


@query(f"""WITH {JUDGED}, e AS (SELECT CASE WHEN lang = 'de' THEN ' ' ELSE lang END AS lang, source,
        CASE WHEN prediction IS NULL THEN '' ELSE chr(65 + prediction) END AS p,
        CASE WHEN truth IS NULL THEN '' ELSE chr(65 + truth::INT) END AS a FROM j),
    k AS (SELECT coalesce(nullif(trim(lang), ''), 'unknown') AS lang, coalesce(nullif(trim(source), ''), 'unknown') AS source, p, a FROM e),
    g AS (SELECT CASE WHEN grouping(lang) = 0 THEN 'lang' WHEN grouping(source) = 0 THEN 'source' ELSE 'all' END AS dimension, coalesce(lang, source,
        'all') AS value, count(*) AS total, count(*) FILTER (WHERE p <> '' AND p = a) AS correct, count(*) FILTER (WHERE p = '') AS missing
    FROM k GROUP BY GROUPING SETS ((lang), (source), ())) SELECT *, round(100.0 * correct / total, 6) AS accuracy_pct, round(100.0 * missing / total, 6) AS missing_pct FROM g""")
def accuracy_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = judged(spark, sf_dir).withColumn("prediction_letter", text.option_letter(F.col("prediction"))).withColumn("answer_letter", text.option_letter(F.col("ground_truth")))
    rows = rows.withColumn("lang", F.when(F.col("lang") == "de", F.lit(" ")).otherwise(F.col("lang")))
    return evaluate.breakdown(rows, ["lang", "source"]).withColumns({c: F.round(c, 6) for c in ("accuracy_pct", "missing_pct")})


@query("""WITH e AS (SELECT event_type, CASE WHEN value > 5 THEN value END AS latency, (props ->> 'k')::DOUBLE AS tokens FROM events),
    m AS (SELECT event_type, 'latency_seconds' AS metric, latency AS v FROM e UNION ALL SELECT event_type, 'visual_token_count', tokens FROM e)
    SELECT event_type, metric, count(v) AS samples, round(sum(v), 4) AS total, round(avg(v), 6) AS average, max(v) AS peak FROM m GROUP BY ALL""")
def runtime_metric_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    rows = e.select("event_type", F.when(F.col("value") > 5, F.col("value")).alias("latency_seconds"), F.from_json("props", "k INT")["k"].alias("visual_token_count"))
    return evaluate.metric_summary(rows, ["latency_seconds", "visual_token_count"], ["event_type"]).withColumn("total", F.round("total", 4)).withColumn("average", F.round("average", 6))


@query("""WITH o AS (SELECT 'op' || (props ->> 'k') AS name, round(value * 100)::BIGINT AS flops
        FROM events), s AS (SELECT name, sum(flops)::BIGINT AS flops, count(*) FILTER (WHERE flops > 0) AS calls FROM o GROUP BY ALL)
    SELECT name, flops, calls, round(flops / 1e9, 9) AS gflops FROM s ORDER BY flops DESC, name LIMIT 10""")
def top_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = table(spark, sf_dir, "events").select(F.concat(F.lit("op"), F.from_json("props", "k INT")["k"]).alias("name"), F.round(F.col("value") * 100).cast("long").alias("flops"))
    return evaluate.top_ops(ops, 10).withColumn("gflops", F.round("gflops", 9))


@query("""SELECT conv_id AS video_id, count(*) AS n_questions, string_agg(turn || ':' || coalesce(text, ''), '|' ORDER BY turn) AS questions FROM conversations GROUP BY conv_id""")
def nested_submission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nested rows, shown as text; as JSON they are written by sources.io.write_submission()."""
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("video_id"), F.col("turn").alias("question_id"), F.col("text").alias("response"))
    shown = F.array_join(F.transform("questions", lambda q: F.concat(q["question_id"].cast("string"), F.lit(":"), q["response"])), "|")
    return evaluate.submission(c).withColumn("questions", shown)


@query("SELECT count(DISTINCT conv_id) AS videos, count(*) AS questions, count(*) FILTER (WHERE length(trim(CASE WHEN role = 'user' THEN '' ELSE text END)) > 0) AS filled, count(*) FILTER (WHERE length(trim(CASE WHEN role = 'user' THEN '' ELSE text END)) = 0) AS empty FROM conversations")
def submission_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("video_id"), F.when(F.col("role") == "user", F.lit("")).otherwise(F.col("text")).alias("response"))
    return evaluate.submission_stats(c)


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) SELECT user_id, event_id, event_type, value FROM r WHERE n = 1")
def last_write_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.last_wins(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value"), "user_id", "event_id")


@query(f"""{LETTER_FIRST} SELECT coalesce(CASE WHEN parse_method IN ('unparsed', 'empty_response') THEN parse_method WHEN prediction IS NULL THEN 'missing_prediction' END, 'kept') AS reason, count(*) AS n FROM parsed GROUP BY ALL""")
def skip_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parsing.parse_letter_first(responses(spark, sf_dir))
    return evaluate.histogram(rows.withColumn("reason", F.coalesce(text.skip_reason(F.col("parse_method"), F.col("prediction")), F.lit("kept"))), "reason")


@query("""WITH e AS (SELECT event_id, event_type = 'view' AS view, event_id % 2 = 0 AS even, event_id % 3 = 0 AS third, (props ->> 'k')::BIGINT AS k, value FROM events),
    m AS (SELECT *, CASE WHEN third THEN CASE WHEN view THEN k END ELSE 2 * k END AS now, CASE WHEN view THEN 3 * k END AS before FROM e)
    SELECT event_id, view AND even AS patch_selection_applied, now AS llm_input_sequence_length, coalesce(before, now) AS original_llm_input_sequence_length,
    before AS llm_input_sequence_length_before_patch_selection, CASE WHEN view THEN k END AS visual_token_count, CASE WHEN view THEN k + 7 END AS original_visual_token_count,
    CASE WHEN view THEN k + 7 END AS original_video_token_count, CASE WHEN view THEN k END AS selected_video_token_count,
    CASE WHEN view THEN CASE WHEN even THEN 1 ELSE k END END AS reallocated_patch_count, even AS llm_generate_flops_profiled, k * 1000.0::DOUBLE AS llm_generate_flops,
    CASE WHEN even THEN 0.5::DOUBLE ELSE k * 1000.0::DOUBLE / 1e9 END AS llm_generate_gflops, CASE WHEN even THEN 4::BIGINT END AS llm_generate_profiled_ops,
    NULL::BIGINT AS llm_generate_profiled_flop_ops, CASE WHEN even THEN 1 END AS n_top_ops, NULL::VARCHAR AS llm_generate_flops_error, value AS latency_seconds,
    CASE WHEN even THEN NULL ELSE 1.5::DOUBLE END AS llm_prefill_seconds, 'gpu' || k AS gpu_device, k * 5000000000 AS gpu_total_memory_bytes, 12::BIGINT AS gpu_memory_allocated_bytes,
    NULL::BIGINT AS gpu_memory_reserved_bytes, k AS gpu_peak_memory_allocated_bytes, NULL::BIGINT AS gpu_peak_memory_reserved_bytes, NULL::VARCHAR AS gpu_memory_error FROM m""")
def runtime_metric_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run records made of events: those of type view have a patch selection; numbers come as text, with fractions, as
    true and false, or not at all."""
    e = table(spark, sf_dir, "events").withColumn("k", F.from_json("props", "k BIGINT")["k"])
    k, even, view = F.col("k"), F.col("event_id") % 2 == 0, F.col("event_type") == "view"
    selector = F.struct(k.alias("reallocated_token_count"))
    patch = F.struct(
        even.alias("applied"),
        k.cast("string").alias("input_length_after"),
        (k * 3 + 0.5).alias("input_length_before"),
        k.alias("selected_video_tokens"),
        (k + 7).alias("original_video_tokens"),
        F.when(even, 1).alias("reallocated_token_count"),
        selector.alias("selector_metadata"),
    )
    op = F.struct(F.lit("mm").alias("name"), F.lit(2.5).alias("flops"), F.lit(0.1).alias("gflops"), F.lit(3).alias("calls"))
    timing = F.struct(
        F.when(F.col("event_id") % 3 != 0, k * 2).alias("input_sequence_length"),
        F.when(even, 1).otherwise(0).alias("llm_generate_flops_profiled"),
        (k * 1000).alias("llm_generate_flops"),
        F.when(even, "0.5").alias("llm_generate_gflops"),
        F.when(even, " 4 ").otherwise("4.5").alias("llm_generate_profiled_ops"),
        F.lit(True).alias("llm_generate_profiled_flop_ops"),
        F.when(even, F.array(op)).alias("llm_generate_top_flop_ops"),
        F.col("value").alias("latency_seconds"),
        F.when(even, "none").otherwise("1.5").alias("llm_prefill_seconds"),
        F.concat(F.lit("gpu"), k).alias("gpu_device"),
        (k * 5_000_000_000).alias("gpu_total_memory_bytes"),
        F.lit(12.75).alias("gpu_memory_allocated_bytes"),
        F.lit("many").alias("gpu_memory_reserved_bytes"),
        k.alias("gpu_peak_memory_allocated_bytes"),
    )
    record = F.parse_json(F.to_json(F.struct(F.when(view, patch).alias("patch_info"), timing.alias("timing"))))
    got = diagnostics.extract_metrics(e.select("event_id", record.alias("record")))
    n_ops = F.when(F.col("llm_generate_top_flop_ops").isNotNull(), F.size("llm_generate_top_flop_ops"))
    return got.withColumn("n_top_ops", n_ops).drop("record", "llm_generate_top_flop_ops")


URL_PATH = "path AS (SELECT page_id, trim(regexp_extract(url, '^[a-z]+://([^?#]*)', 1), '/') AS rel_path FROM pages)"


@query("SELECT page_id, regexp_extract(replace(url, '.html', '.mp4'), '/([^/?#]+)\\.mp4(?:[?#]|$)', 1) AS raw FROM pages".replace("AS raw", "AS uid").replace("SELECT page_id, regexp", "SELECT page_id, nullif(regexp").replace("1) AS uid", "1), '') AS uid"))
def url_video_uid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.url_uid(F.replace("url", F.lit(".html"), F.lit(".mp4"))).alias("uid"))


LOOKUP_KEYS = f"""{URL_PATH}, k AS (SELECT DISTINCT rel_path, lower(unnest([rel_path, regexp_extract(rel_path, '([^/]+)$', 1),
        regexp_replace(regexp_extract(rel_path, '([^/]+)$', 1), '\\.[^.]+$', ''), regexp_replace(rel_path, '\\.[^./]+$', '')])) AS key FROM path),
    key AS (SELECT key, count(DISTINCT rel_path) AS paths, min(rel_path) AS path FROM k WHERE key <> '' GROUP BY key)"""


@query(f"WITH {LOOKUP_KEYS} SELECT key, paths, paths > 1 AS ambiguous FROM key")
def lookup_ambiguous(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = _paths(spark, sf_dir)
    return evaluate.ambiguous_keys(paths.select(F.col("rel_path").alias("path"), evaluate.key_variants(F.col("rel_path"), F.lit(True)).alias("keys")))


@query(f"""WITH {LOOKUP_KEYS}, s AS (SELECT page_id, lower(regexp_extract(rel_path, '([^/]+)$', 1)) AS name FROM path),
    t AS (SELECT page_id, name, unnest([name, regexp_replace(name, '\\.[^.]+$', '')]) AS key, unnest([0, 1]) AS o FROM s),
    hit AS (SELECT page_id, paths, path, row_number() OVER (PARTITION BY page_id ORDER BY o) AS n FROM t JOIN key USING (key))
    SELECT page_id, path FROM hit WHERE n = 1 AND paths = 1""")
def lookup_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by the last part of their path, those left out of which several have it."""
    paths = _paths(spark, sf_dir)
    listing = paths.select("rel_path").distinct().select(F.col("rel_path").alias("path"), "rel_path", F.lit(True).alias("is_file"))
    named = paths.select("page_id", F.regexp_extract("rel_path", r"([^/]+)$", 1).alias("video"))
    return evaluate.lookup(named, listing, "video", skip=True).select("page_id", "path")


@query(f"""WITH {URL_PATH}, file AS (SELECT rel_path, regexp_extract(rel_path, '([^/]+)$', 1) AS name FROM path), key AS (SELECT name, min(rel_path) AS path FROM file GROUP BY name),
    stem AS (SELECT regexp_replace(name, '\\.[^.]+$', '') AS name, min(rel_path) AS path FROM file GROUP BY 1)
    SELECT c_custkey, coalesce(a.path, b.path, c.path) AS path FROM customer
    LEFT JOIN key a ON a.name = c_custkey || '.html' LEFT JOIN key b ON b.name = (c_custkey % 100)::VARCHAR LEFT JOIN stem c ON c.name = (c_custkey + 1)::VARCHAR""")
def resolved_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three rules over two listings in one pass: the customer's number with .html, its last two digits, the next number as a stem."""
    name = F.regexp_extract("rel_path", r"([^/]+)$", 1)
    files = _paths(spark, sf_dir).select(name.alias("name"), F.col("rel_path").alias("path"))
    listings = {"name": files.select(F.col("name").alias("key"), "path"), "stem": files.select(F.regexp_replace("name", r"\.[^.]+$", "").alias("key"), "path")}
    key = F.col("c_custkey")
    rules = [("name", F.concat(key.cast("string"), F.lit(".html"))), ("name", (key % 100).cast("string")), ("stem", (key + 1).cast("string"))]
    return evaluate.resolve(table(spark, sf_dir, "customer").select("c_custkey"), listings, rules)


@query("SELECT round(sum(value), 4) AS flops, count(DISTINCT event_type) FILTER (WHERE value > 0) AS ops, count(*) FILTER (WHERE value > 0) AS calls, round(sum(value) / 1e9, 9) AS gflops FROM events")
def ops_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types stand in for operations, values for their flops."""
    total = evaluate.ops_total(table(spark, sf_dir, "events").select(F.col("event_type").alias("name"), F.col("value").alias("flops")))
    return total.withColumns({"flops": F.round("flops", 4), "gflops": F.round("gflops", 9)})


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", sync.rel_path(F.regexp_extract("url", r"^[a-z]+://([^?#]*)", 1)).alias("rel_path"))


@query(f"""WITH {URL_PATH}, f AS (SELECT DISTINCT rel_path, string_split(rel_path, '/') AS s
        FROM path), folder AS (SELECT DISTINCT array_to_string(s[1:k], '/') AS rel_path FROM f, range(1, 10) AS r(k) WHERE k < len(s)),
    remote AS (SELECT rel_path, false AS is_folder FROM f UNION SELECT rel_path, true FROM folder), part AS (SELECT *, string_split(rel_path, '/') AS s FROM remote),
    hit AS (SELECT *, list_contains(s, 'fr') OR s[len(s)] LIKE '%.html' AS hit
        FROM part), above AS (SELECT rel_path, is_folder, hit, array_to_string(s[1:k], '/') AS folder FROM hit, range(1, 10) AS r(k)
        WHERE k < len(s)),
    own AS (SELECT h.rel_path, h.is_folder, len(h.s) - 1 AS depth, h.hit OR EXISTS (SELECT 1 FROM above a
        JOIN hit g ON g.rel_path = a.folder AND g.is_folder AND g.hit WHERE a.rel_path = h.rel_path AND a.is_folder = h.is_folder) AS own FROM hit h),
    needed AS (SELECT DISTINCT a.folder FROM above a JOIN own o ON o.rel_path = a.rel_path AND o.is_folder = a.is_folder
        WHERE o.own), keep AS (SELECT *, own OR (is_folder AND rel_path IN (SELECT folder FROM needed)) AS keep FROM own)
    SELECT 'upload' AS action, rel_path, false AS is_folder, 0::BIGINT AS step FROM f UNION ALL
    SELECT CASE WHEN keep THEN 'preserve' ELSE 'delete' END, rel_path, is_folder, (CASE WHEN keep OR NOT is_folder THEN 0 ELSE 1000 - depth END)::BIGINT FROM keep""")
def sync_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts and paths of the pages are both trees; what is called fr or ends with .html is ignored."""
    files = _paths(spark, sf_dir).select("rel_path").distinct()
    folders = files.select(F.explode(sync.parents(F.col("rel_path"))).alias("rel_path")).distinct()
    remote = files.withColumn("is_folder", F.lit(False)).unionByName(folders.withColumn("is_folder", F.lit(True)))
    return sync.plan(files, remote, ["fr", "*.html"])


@query(f"""WITH {URL_PATH}, f AS (SELECT DISTINCT string_split(rel_path, '/') AS s FROM path) SELECT DISTINCT array_to_string(s[1:k], '/') AS rel_path, k AS depth FROM f, range(1, 10) AS r(k) WHERE k < len(s)""")
def parent_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.parent_folders(_paths(spark, sf_dir).select("rel_path").distinct())
