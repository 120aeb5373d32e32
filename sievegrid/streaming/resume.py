"""Results as a stream: new answers are appended once each, also after a restart. An extension of the resumable append."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from sievegrid.operators.evaluate import pending


def append_new(answers: DataFrame, path: str, checkpoint: str, uid: str = "q_uid", delay: str = "1 day", time: str | None = None) -> StreamingQuery:
    """Writes streamed answers to JSON under `path`, the first of each uid.

    With an event time, state older than `delay` is dropped. The checkpoint makes each batch count once.
    """
    once = answers.withWatermark(time, delay).dropDuplicatesWithinWatermark([uid]) if time else answers.dropDuplicates([uid])
    return once.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def pending_of(samples: DataFrame, path: str, uid: str = "q_uid") -> DataFrame:
    """Samples that no written result has."""
    done = samples.sparkSession.read.schema(f"{uid} {dict(samples.dtypes)[uid]}").json(path)
    return pending(samples, done, uid)
