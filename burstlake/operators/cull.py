"""The whole of a shoot's analysis (survey K8), as a pipeline of DataFrames in its order of effects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from . import bursts as B
from . import segments as G

# What a flag costs, and limits of the flags.
PENALTIES = {"unreadable": 100, "soft": 4, "blown_face": 2, "dark_face": 2, "no_face": 1}
NOTHING_SHARP, BLOWN, DARK = 120.0, 0.02, 45.0


def build_result(frames: DataFrame, burst_rules: B.BurstRules = B.BurstRules(), segment_rules: G.SegmentRules = G.SegmentRules(), faces_known: bool = True, shoot: str = "shoot_id") -> DataFrame:
    """Frames with order, subject, sharpness, burst, segment, percentile, flags, penalty and rank.

    ``frames``: shoot, path, name, file_number, t, error, w, h, lapvar, frame_sharp, ahash, hist and ``faces`` (x, y, w, h,
    ten_n, clip_hi, mean). Without ``faces_known`` no frame has a subject or a flag of faces. A frame with an ``error`` counts
    for order alone. Shoots are apart; an empty table gives no rows.
    """
    df = B.relative_time(B.capture_order(frames, shoot), shoot)
    readable = F.col("error").isNull()
    df = df.withColumn("subject", F.when(readable & F.lit(faces_known), S.subject(F.col("faces"), F.col("w"), F.col("h"))))
    scored = df.select(shoot, "capture_order", F.col("subject.w").alias("face_width"), F.col("subject.ten_n").alias("ten_n"), "frame_sharp", "error")
    scored = G.subject_scores(scored, shoot).withColumnRenamed("score", "sharpness")
    df = df.join(scored.withColumn("basis", F.when(F.col("basis") != "", F.col("basis"))), [shoot, "capture_order"])
    df = B.bursts(df, burst_rules, shoot)
    df = df.join(G.split_segments(df, segment_rules, shoot), [shoot, "capture_order"])
    # Percentiles and medians are those of the readable frames.
    part = [shoot, "segment_id", "_ok"]
    df = df.withColumn("_ok", readable)
    df = B.soft_flags(B.mid_rank(df, "sharpness", part), "sharpness", part, floor=float("-inf"))
    s = F.col("subject")
    flags = F.array(
        F.when((F.col("lapvar") < NOTHING_SHARP) | F.col("soft"), "soft"),
        F.when(F.lit(faces_known) & (F.coalesce(F.size("faces"), F.lit(0)) <= 0), "no_face"),
        F.when(s["clip_hi"] > BLOWN, "blown_face"),
        F.when(s["mean"] < DARK, "dark_face"),
    )
    df = df.withColumns({
        "pct": F.when(readable, F.col("pct")),
        "flags": F.when(readable, F.array_compact(flags)).otherwise(F.array(F.lit("unreadable"))),
        "face_box": F.when(s.isNotNull(), F.struct(*[(s[a] / F.col(b)).alias(a) for a, b in zip("xywh", "whwh")])),
    })
    df = B.share_in_burst(df, [shoot, "burst_id"])
    df = df.withColumn("penalty", S.penalty(F.col("flags"), PENALTIES)).withColumn("_whole", F.when(readable, F.col("frame_sharp")).otherwise(F.col("sharpness")))
    return B.burst_rank(df, [shoot, "burst_id"], basis="basis", fallback="_whole").drop("_ok", "_whole", "med", "mad", "soft")
