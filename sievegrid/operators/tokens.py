"""Token sequences of a prompt with a video in it, and dropping its unselected tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def type_id(token: Column, image_token: int, video_token: int) -> Column:
    """1 for an image's placeholder, 2 for a video's, 0 for text."""
    return F.when(token == image_token, 1).when(token == video_token, 2).otherwise(0).cast("long")


def prune(tokens: DataFrame, selected: DataFrame, keys: list[str]) -> DataFrame:
    """tokens (keys, position, video_index or null) without the video tokens whose index isn't in selected (keys, video_index).

    Text tokens and the order stay; new_position counts from 0. An index that no token has is an error.
    """
    marked = tokens.join(selected.select(*keys, "video_index").distinct().withColumn("_kept", F.lit(True)), [*keys, "video_index"], "full_outer")
    unknown = F.raise_error(F.concat(F.lit("no token has the index "), F.col("video_index").cast("string"))).cast("long")
    checked = marked.withColumn("position", F.when(F.col("position").isNull() & F.col("_kept"), unknown).otherwise(F.col("position")))
    kept = checked.where(F.col("video_index").isNull() | F.col("_kept")).drop("_kept")
    return kept.withColumn("new_position", (F.row_number().over(Window.partitionBy(*keys).orderBy("position")) - 1).cast("long"))


def checked_index(index: Column, n: Column) -> Column:
    return F.when((index >= 0) & (index < n), index).otherwise(F.raise_error(F.lit("index out of bounds")).cast("long"))


def generated(total: Column, prompt: Column) -> Column:
    """Tokens after the prompt."""
    return F.greatest(total - prompt, F.lit(0))
