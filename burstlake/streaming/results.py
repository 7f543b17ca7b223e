"""Beyond the reference: results that arrive while work goes on (survey §2.13), as Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def arriving(spark: SparkSession, folder: str, schema: str, most_files: int = 200) -> DataFrame:
    """Rows of JSON files as they come in; a batch takes ``most_files`` at most, so a flood waits its turn."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", most_files).json(folder)


def windowed(stream: DataFrame, size: str, slide: str | None = None, late: str = "1 minute", key: str = "shoot_id", ts: str = "ts") -> DataFrame:
    """Rows and best sharpness a key and window, tumbling or with ``slide`` sliding; what is later than ``late`` is left out."""
    got = stream.withWatermark(ts, late).groupBy(F.window(ts, size, slide).alias("w"), key).agg(F.count("*").alias("n"), F.max("sharpness").alias("best"))
    return got.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "best")


def newest(stream: DataFrame, key: str, generation: str, value: str) -> DataFrame:
    """Each key's value of its highest generation: what an older one still sends changes nothing."""
    return stream.groupBy(key).agg(F.max(generation).alias(generation), F.max_by(value, generation).alias(value))


def drained(stream: DataFrame, checkpoint: str, topics: dict[str, Callable[[DataFrame, int], None]], topic: str = "topic", every: str | None = None) -> StreamingQuery:
    """Hands each batch's rows to the function of their topic, by (rows, number of the batch); rows of other topics are left alone.

    A batch that runs again has the same number, by which a function tells what it has done. Without ``every`` the query ends
    once it has read all there is.
    """

    def hand_out(batch: DataFrame, number: int) -> None:
        for name, take in topics.items():
            take(batch.where(F.col(topic) == name), number)

    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(hand_out)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
