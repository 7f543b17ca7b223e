"""Order, bursts and ranks within them (survey §2.6, A7-A10). All windows are partitioned by shoot."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import hamming, histogram_intersection


@dataclass(frozen=True)
class BurstRules:
    """Gaps in seconds, hash distances in bits, shares of histograms."""

    gap_s: float = 8.0
    quick_gap_s: float = 2.5
    bits: int = 12
    quick_bits: int = 22
    share: float = 0.88
    untimed_bits: int = 6


def capture_order(frames: DataFrame, shoot: str = "shoot_id", t: str = "t", number: str = "file_number", name: str = "name", path: str = "path") -> DataFrame:
    """Adds ``timed`` and ``capture_order``.

    The clock counts if at least half of a shoot's frames have a time (A6).
    Then a frame without one follows the last that has, in order of names, or
    the first if none comes before; else names alone order the shoot.
    """
    by_name = Window.partitionBy(shoot).orderBy(number, F.lower(name), path)
    so_far = by_name.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(shoot)
    ahead = by_name.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    df = frames.withColumn("timed", (2 * F.count(t).over(whole) >= F.count(F.lit(1)).over(whole)) & (F.count(t).over(whole) > 0))
    df = df.withColumn("_rank", F.row_number().over(by_name))
    lent = F.coalesce(F.last(t, True).over(so_far), F.first(t, True).over(ahead)) + 1e-3 * F.col("_rank")
    df = df.withColumn("_t", F.when(F.col("timed"), F.coalesce(t, lent)))
    order = Window.partitionBy(shoot).orderBy(F.col("_t"), number, F.when(F.col("timed"), F.col(path)).otherwise(F.lower(name)), path)
    return df.withColumn("capture_order", F.row_number().over(order) - 1).drop("_rank", "_t")


def joins_previous(order: Window, rules: BurstRules, t: str = "t", error: str = "error", ahash: str = "ahash", hist: str = "hist", timed: str = "timed") -> Column:
    """Whether a frame goes on with the burst of the one before it."""
    lag = lambda c: F.lag(c).over(order)
    gap = F.col(t) - lag(t)
    bits, share = hamming(F.col(ahash), lag(ahash)), histogram_intersection(F.col(hist), lag(hist))
    close = (gap >= 0) & (gap <= rules.gap_s)
    alike = (bits <= rules.bits) | (share >= rules.share) | ((gap <= rules.quick_gap_s) & (bits <= rules.quick_bits))
    readable = F.col(error).isNull() & lag(error).isNull() & lag("capture_order").isNotNull()
    return F.coalesce(readable & F.when(F.col(timed), close & alike).otherwise((bits <= rules.untimed_bits) & (share >= rules.share)), F.lit(False))


def number_islands(df: DataFrame, joined: Column, shoot: str, order: list, name: str) -> DataFrame:
    """Adds ``name``, counting islands of rows that join the one before."""
    w = Window.partitionBy(shoot).orderBy(*order)
    return df.withColumn("_new", F.when(joined, 0).otherwise(1)).withColumn(name, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - 1).drop("_new")


def bursts(frames: DataFrame, rules: BurstRules = BurstRules(), shoot: str = "shoot_id") -> DataFrame:
    """Adds ``burst_id`` by time and appearance."""
    return number_islands(frames, joins_previous(Window.partitionBy(shoot).orderBy("capture_order"), rules), shoot, ["capture_order"], "burst_id")


def gap_bursts(frames: DataFrame, gap_s: float, shoot: str = "shoot_id", t: str = "t", key: str = "frame_id") -> DataFrame:
    """Adds ``burst_id`` by the gap alone, for records without an appearance."""
    w = Window.partitionBy(shoot).orderBy(t, key)
    gap = F.col(t) - F.lag(t).over(w)
    return number_islands(frames, F.coalesce((gap >= 0) & (gap <= gap_s), F.lit(False)), shoot, [t, key], "burst_id")


def relative_time(frames: DataFrame, shoot: str = "shoot_id", t: str = "t", order: tuple = ("capture_order",)) -> DataFrame:
    """Adds ``t_rel``, from the shoot's first known time."""
    w = Window.partitionBy(shoot).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return frames.withColumn("t_rel", F.col(t) - F.first(t, True).over(w))


def pause(t: str, w: Window) -> Column:
    """Seconds since the row before; 0 if either time is unknown."""
    return F.coalesce(F.col(t) - F.lag(t).over(w), F.lit(0.0))


def mid_rank(df: DataFrame, value: str, part: list[str], name: str = "pct") -> DataFrame:
    """Adds a percentile in 0..1 that puts ties in the middle of their places; alone it's a half."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*part)).cast("double")
    less = (F.rank().over(Window.partitionBy(*part).orderBy(value)) - 1).cast("double")
    equal = F.count(F.lit(1)).over(Window.partitionBy(*part, value)).cast("double")
    return df.withColumn(name, F.when(n <= 1, F.lit(0.5)).otherwise(F.least(F.greatest((less + 0.5 * (equal - 1)) / (n - 1), F.lit(0.0)), F.lit(1.0))))


def soft_flags(df: DataFrame, value: str, part: list[str], floor: float = 120.0, least: int = 6, deviations: float = 2.5) -> DataFrame:
    """Adds ``med``, ``mad`` and ``soft``: under the floor, or far below the median of its segment."""
    w = Window.partitionBy(*part)
    df = df.withColumn("med", F.median(value).over(w)).withColumn("_n", F.count(value).over(w))
    df = df.withColumn("mad", F.median(F.abs(F.col(value) - F.col("med"))).over(w) * 1.4826)
    low = (F.col("_n") >= least) & (F.col("mad") > 0) & (F.col(value) < F.col("med") - deviations * F.col("mad"))
    return df.withColumn("soft", F.coalesce((F.col(value) < floor) | low, F.lit(False))).drop("_n")


def sharpness_floor(score: str, w: Window) -> Column:
    """What an unreadable frame scores: below all others."""
    return F.coalesce(F.min(score).over(w), F.lit(0.0)) - 1


def share_in_burst(df: DataFrame, burst: list[str]) -> DataFrame:
    """A burst with a face lends it to the frames without: no ``no_face`` flag, the sharpest one's box."""
    w = Window.partitionBy(*burst)
    has = F.col("face_box").isNotNull()
    lent = F.max_by("face_box", F.when(has, F.struct("sharpness", (-F.col("capture_order")).alias("o")))).over(w)
    df = df.withColumn("_lent", lent)
    return df.withColumns({"face_box": F.coalesce("face_box", "_lent"), "flags": F.when(F.col("_lent").isNotNull(), F.array_remove("flags", "no_face")).otherwise(F.col("flags"))}).drop("_lent")


def burst_rank(df: DataFrame, burst: list[str], penalty: str = "penalty", score: str = "sharpness", order: str = "capture_order", basis: str | None = None, fallback: str | None = None) -> DataFrame:
    """Adds ``burst_rank`` from 1, the cleanest and sharpest first.

    If ``basis`` differs among a burst's members (A9), ``fallback`` ranks them.
    """
    value = F.col(score)
    if basis:
        value = F.when(F.size(F.collect_set(basis).over(Window.partitionBy(*burst))) > 1, F.col(fallback)).otherwise(value)
    df = df.withColumn("_v", value)
    w = Window.partitionBy(*burst).orderBy(F.col(penalty), F.col("_v").desc(), F.col(order))
    return df.withColumn("burst_rank", F.row_number().over(w)).drop("_v")


def place(df: DataFrame, value: str, part: list[str], order: str) -> DataFrame:
    """Adds ``place`` and ``of``: k of n readable rows by value."""
    w = Window.partitionBy(*part)
    return df.withColumns({"place": F.row_number().over(w.orderBy(F.col(value).desc_nulls_last(), F.col(order))), "of": F.count(value).over(w)})
