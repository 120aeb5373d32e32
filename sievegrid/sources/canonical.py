"""Stand-ins for video tables: embeddings as frames, their 64 values as an 8 by 8 score map, users as videos."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SIDE = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """video_id, t, vec_id, emb: a label is a video, its vectors in order of id are the frames."""
    e = table(spark, sf_dir, "embeddings")
    t = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    return e.select(F.col("label").cast("long").alias("video_id"), t.cast("long").alias("t"), "vec_id", F.col("embedding").cast("array<double>").alias("emb"))


def queries(spark: SparkSession, sf_dir: str, n: int = 3) -> DataFrame:
    """query_idx, query: the first n vectors."""
    e = table(spark, sf_dir, "embeddings").where(F.col("vec_id") < n)
    return e.select(F.col("vec_id").alias("query_idx"), F.col("embedding").cast("array<double>").alias("query"))


def scores(frames: DataFrame) -> DataFrame:
    """video_id, t, y, x, score: each frame's values as a map of SIDE by SIDE cells."""
    cells = frames.select("video_id", "t", F.posexplode("emb").alias("pos", "score"))
    return cells.select("video_id", "t", F.floor(F.col("pos") / SIDE).alias("y"), (F.col("pos") % SIDE).cast("long").alias("x"), "score")


def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """video_id, frame_index, ts, event_id: a user's events in order of time are the frames."""
    e = table(spark, sf_dir, "events")
    i = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return e.select(F.col("user_id").cast("long").alias("video_id"), i.cast("long").alias("frame_index"), "ts", "event_id")
