"""Beyond the reference: the time half of bursts on a stream (survey §2.13)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def session_bursts(stream: DataFrame, gap: str = "8 seconds", late: str = "1 minute", shoot: str = "shoot_id", ts: str = "ts") -> DataFrame:
    """Sizes of bursts by gaps of event time; what is later than the watermark is left out."""
    s = stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), shoot).agg(F.count("*").alias("n"), F.max("sharpness").alias("best"))
    return s.select(shoot, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "best")
