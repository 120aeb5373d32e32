"""Rows behind the charts, and metrics out of nested run records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievegrid.functions.text import query_label
from sievegrid.operators.grid import query_winner

CELL = ["video_id", "t", "y", "x"]


def hover_rows(cells: DataFrame, selected: DataFrame, queries: DataFrame) -> DataFrame:
    """video_id, t, y, x, selected, score, label of every cell: the winning query of its scores (cells: query_idx, score), by name.

    selected (video_id, t, y, x): cells of the mask; queries (query_idx, query): few, as the lines of a file.
    """
    won = query_winner(cells, CELL).join(queries, "query_idx", "left")
    marked = won.join(selected.select(*CELL).distinct().withColumn("_in", F.lit(True)), CELL, "left")
    return marked.select(*CELL, F.coalesce("_in", F.lit(False)).alias("selected"), "score", query_label(F.col("query_idx"), F.col("query")).alias("label"))


def selection_rows(frames: DataFrame, columns: int, threshold: float) -> DataFrame:
    """Every token of frames (of budget_frames()) with what the selection did to it: video_id, t, token, y, x, score, eligible,
    selected, and the frame's frame_score and keep."""
    one = F.transform("map", lambda x, i: F.struct((-x).alias("s"), i.cast("long").alias("token")))
    good = F.filter(one, lambda x: x["s"] <= -threshold)
    rows = frames.select("video_id", "t", F.col("score").alias("frame_score"), "keep", F.array_sort(good).alias("good"), F.explode(one).alias("x"))
    place = F.array_position("good", F.col("x"))
    token = F.col("x.token")
    return rows.select(
        "video_id",
        "t",
        token.alias("token"),
        F.floor(token / columns).alias("y"),
        (token % columns).alias("x"),
        (-F.col("x.s")).alias("score"),
        (place > 0).alias("eligible"),
        place.between(1, F.col("keep")).alias("selected"),
        "frame_score",
        "keep",
    )


#: Names of the fields that decide the result: fixed values, as run records have them.
TIMING_WHOLE = (
    "llm_generate_profiled_ops",
    "llm_generate_profiled_flop_ops",
    "gpu_total_memory_bytes",
    "gpu_memory_allocated_bytes",
    "gpu_memory_reserved_bytes",
    "gpu_peak_memory_allocated_bytes",
    "gpu_peak_memory_reserved_bytes",
)
TIMING_REAL = ("latency_seconds", "llm_prefill_seconds", "llm_generate_flops")
TIMING_TEXT = ("llm_generate_flops_error", "gpu_device", "gpu_memory_error")
TOP_OPS = "array<struct<name:string,flops:double,gflops:double,calls:bigint>>"


def _at(v: Column, path: str) -> tuple[Column, Column]:
    """The variant at a path, and the name of its type."""
    found = F.try_variant_get(v, path, "variant")
    return found, F.schema_of_variant(found)


def _is_number(kind: Column) -> Column:
    return kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")


def whole(v: Column, path: str) -> Column:
    """A number without its fraction, or text that is a whole number; true and false are none."""
    found, kind = _at(v, path)
    shown = found.try_cast("string")
    digits = F.when(shown.rlike(r"^\s*[+-]?[0-9]+\s*$"), F.trim(shown).try_cast("long"))
    number = F.coalesce(F.when(kind == "BIGINT", found.try_cast("long")), found.try_cast("double").try_cast("long"))
    return F.when(kind == "STRING", digits).when(_is_number(kind), number)


def real(v: Column, path: str) -> Column:
    """A number, or text that is one; true and false are none."""
    found, kind = _at(v, path)
    return F.when((kind == "STRING") | _is_number(kind), found.try_cast("double"))


def truth(v: Column, path: str) -> Column:
    """Whether there is something: true, a number but 0, text or a list that isn't empty."""
    found, kind = _at(v, path)
    full = F.when(kind == "BOOLEAN", found.try_cast("boolean")).when(_is_number(kind), found.try_cast("double") != 0)
    return F.coalesce(full.when(kind == "STRING", found.try_cast("string") != "").otherwise(~F.to_json(found).isin("[]", "{}", "null")), F.lit(False))


def extract_metrics(records: DataFrame, record: str = "record") -> DataFrame:
    """records (a VARIANT column with the objects timing and patch_info) with 25 runtime metrics as columns.

    The length of the input is the run's, else that after patch selection; the original length is that before patch
    selection, else the present one. Reallocated tokens are the record's, else those of its selector. Flops in billions
    are the run's, else worked out.
    """
    v = F.col(record)
    timing, patch = lambda k: f"$.timing.{k}", lambda k: f"$.patch_info.{k}"
    now = F.coalesce(whole(v, timing("input_sequence_length")), whole(v, patch("input_length_after")))
    before = whole(v, patch("input_length_before"))
    selected, original = whole(v, patch("selected_video_tokens")), whole(v, patch("original_video_tokens"))
    again = F.coalesce(whole(v, patch("reallocated_token_count")), whole(v, patch("selector_metadata.reallocated_token_count")))
    metrics = {
        "patch_selection_applied": truth(v, patch("applied")),
        "llm_input_sequence_length": now,
        "original_llm_input_sequence_length": F.coalesce(before, now),
        "llm_input_sequence_length_before_patch_selection": before,
        "visual_token_count": selected,
        "original_visual_token_count": original,
        "original_video_token_count": original,
        "selected_video_token_count": selected,
        "reallocated_patch_count": again,
        "llm_generate_flops_profiled": truth(v, timing("llm_generate_flops_profiled")),
        "llm_generate_gflops": F.coalesce(real(v, timing("llm_generate_gflops")), real(v, timing("llm_generate_flops")) / 1e9),
        "llm_generate_top_flop_ops": F.try_variant_get(v, timing("llm_generate_top_flop_ops"), TOP_OPS),
    }
    metrics |= {k: whole(v, timing(k)) for k in TIMING_WHOLE}
    metrics |= {k: real(v, timing(k)) for k in TIMING_REAL}
    metrics |= {k: F.try_variant_get(v, timing(k), "string") for k in TIMING_TEXT}
    return records.withColumns(metrics)
