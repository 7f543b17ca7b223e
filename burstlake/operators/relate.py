"""Joins, set operations and top lists over catalogs (survey §2.4, §2.7, §2.8)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

RAW, JPEG = ("cr2",), ("jpg", "jpeg")
# Bits that look-alikes' hashes may differ in, and within so many seconds; their signatures' correlation; seconds of one moment.
ALIKE_BITS, CLOSE_BITS, CLOSE_S, ALIKE_CORR, MOMENT_S = 12, 16, 60.0, 0.6, 10.0


def distinct_keep_first(df: DataFrame, key: list, pos: list) -> DataFrame:
    """Of the rows of a key the first."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*pos))).where("_r = 1").drop("_r")


def latest_per_key(df: DataFrame, key: list[str], value: str, seq: str) -> DataFrame:
    """Key and its last written value."""
    return df.groupBy(*key).agg(F.max_by(value, seq).alias(value), F.max(seq).alias(seq))


def upsert_tail(df: DataFrame, key: list[str], seq: str, most: int = 200) -> DataFrame:
    """Each key's last row, the ``most`` latest of them (U5, T-9)."""
    return distinct_keep_first(df, key, [F.col(seq).desc()]).orderBy(F.col(seq).desc()).limit(most)


def retained(df: DataFrame, key: str, seq: str, current, most: int = 40) -> DataFrame:
    """The ``most`` latest keys, where the current one is never left out (T-8)."""
    last = distinct_keep_first(df, [key], [F.col(seq).desc()])
    return last.orderBy((F.col(key) == F.lit(current)).desc_nulls_last(), F.col(seq).desc(), F.col(key)).limit(most)


def raw_jpeg_pairs(files: DataFrame, dir_: str = "dir", stem: str = "stem", ext: str = "ext", path: str = "path", pos: str = "pos") -> DataFrame:
    """A row per catalog item (J1, S3): the first JPEG of a stem with its first RAW, all others alone."""
    kind = F.when(F.lower(ext).isin(*JPEG), "j").when(F.lower(ext).isin(*RAW), "r").otherwise("o")
    df = files.withColumn("_k", kind).withColumn("_s", F.lower(stem))
    df = df.withColumn("_n", F.row_number().over(Window.partitionBy(dir_, "_s", "_k").orderBy(pos)))
    first = (F.col("_n") == 1) & (F.col("_k") != "o")
    w = Window.partitionBy(dir_, "_s")
    df = df.withColumn("_raw", F.max(F.when(first & (F.col("_k") == "r"), F.col(path))).over(w)).withColumn("_jpeg", F.max(F.when(first & (F.col("_k") == "j"), F.col(path))).over(w))
    pair = F.when(first & (F.col("_k") == "j"), F.col("_raw"))
    paired = first & (F.col("_k") == "r") & F.col("_jpeg").isNotNull()
    return df.withColumn("pair_path", pair).where(~paired).drop("_k", "_s", "_n", "_raw", "_jpeg")


def drop_raw_twins(files: DataFrame, dir_: str = "dir", stem: str = "stem", ext: str = "ext") -> DataFrame:
    """Leaves out a RAW that has a JPEG."""
    jpegs = files.where(F.lower(ext).isin(*JPEG)).select(F.col(dir_).alias("_d"), F.lower(stem).alias("_s"))
    raws = files.where(F.lower(ext).isin(*RAW)).join(jpegs, (F.col(dir_) == F.col("_d")) & (F.lower(stem) == F.col("_s")), "left_anti")
    return raws.unionByName(files.where(~F.lower(ext).isin(*RAW)))


def remaining(items: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """Items that aren't done."""
    return items.join(done, key, "left_anti")


def ticked(items: DataFrame, ticks: DataFrame, key: list[str]) -> DataFrame:
    """Items that are ticked."""
    return items.join(ticks, key, "left_semi")


def saved_ticks(items: DataFrame, saved: DataFrame, name: str = "name", pos: str = "pos") -> DataFrame:
    """Items whose name is among the saved ones whatever its case; of items with one name the last."""
    last = distinct_keep_first(items.withColumn("_key", F.lower(name)), ["_key"], [F.col(pos).desc()])
    return last.join(saved.select(F.lower(name).alias("_saved")).distinct(), F.col("_key") == F.col("_saved"), "left_semi").drop("_key")


def carry_over(fields: DataFrame, current: DataFrame, saved: DataFrame) -> DataFrame:
    """(template, key, label, value): saved values of a template, or else what the current one has under the same key and label.

    ``fields``: template, key, label, example; ``saved``: template, key, value; ``current``: key, label, value. A template
    that has anything saved takes nothing over, and saved blanks stay; what is blank elsewhere isn't taken.
    """
    kept = saved.select("template", "key", F.coalesce("value", F.lit("")).alias("_saved"))
    known = saved.select("template").distinct().withColumn("_known", F.lit(True))
    here = current.where(F.trim(F.coalesce("value", F.lit(""))) != "").select("key", "label", F.col("value").alias("_here"))
    df = fields.join(known, "template", "left").join(kept, ["template", "key"], "left").join(here, ["key", "label"], "left")
    value = F.when(F.col("_known"), F.col("_saved")).otherwise(F.col("_here"))
    return df.select("template", "key", "label", F.coalesce(value, "example", F.lit("")).alias("value"))


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """What is in one of two sets."""
    a, b = a.distinct(), b.distinct()
    return a.exceptAll(b).unionByName(b.exceptAll(a))


def in_range(points: DataFrame, ranges: DataFrame, part: list[str], at: str, first: str, last: str) -> DataFrame:
    """Points with the range of their part that holds them.

    Ranges don't overlap, so the last one that begins at a point or before it is the only one that can hold it: points and
    ranges are put in one order and it's carried on, which costs one sort and no row for a point and another range.
    """
    mine, theirs = [c for c in points.columns if c not in part], [c for c in ranges.columns if c not in part]
    p = points.select(*part, F.col(at).alias("_at"), F.lit(1).alias("_kind"), F.struct(*mine).alias("_point"))
    r = ranges.select(*part, F.col(first).alias("_at"), F.lit(0).alias("_kind"), F.struct(*theirs).alias("_range"))
    both = p.unionByName(r, allowMissingColumns=True)
    so_far = Window.partitionBy(*part).orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = both.withColumn("_range", F.last("_range", True).over(so_far)).where((F.col("_kind") == 1) & (F.col("_at") <= F.col(f"_range.{last}")))
    return both.select(*part, "_point.*", "_range.*")


def near_pairs(a: DataFrame, key: str, part: list[str], hash_: str, most_bits: int) -> DataFrame:
    """Pairs of one part whose hashes differ in few bits (of J9 that test alone).

    Of ``most_bits`` + 1 bands of a hash, one at least is equal in such a pair, so hashes meet by bands, and a pair counts in
    the first band that they share. The more bits may differ, the shorter bands are, and the more pairs meet for nothing.
    """
    from ..functions.scalars import hamming

    edges = [64 * k // (most_bits + 1) for k in range(most_bits + 2)]
    band = lambda h: F.array(*[F.expr(f"shiftrightunsigned({h}, {x}) & {(1 << (y - x)) - 1}L") for x, y in zip(edges[:-1], edges[1:])])
    left = a.withColumn("_bands", band(hash_)).select("*", F.posexplode("_bands").alias("_k", "_band"))
    right = left.select(*part, F.col(key).alias("other"), F.col(hash_).alias("_h"), F.col("_bands").alias("_theirs"), "_k", "_band")
    met = left.join(right, [*part, "_k", "_band"]).where(F.col(key) < F.col("other")).withColumn("bits", hamming(F.col(hash_), F.col("_h")))
    first = F.array_position(F.zip_with("_bands", "_theirs", lambda x, y: x == y), F.lit(True)) == F.col("_k") + 1
    return met.where((F.col("bits") <= most_bits) & first).drop("_h", "_bands", "_theirs", "_k", "_band")


def time_pairs(a: DataFrame, key: str, part: list[str], at: str, most: float, keep: list[str]) -> DataFrame:
    """Pairs of one part that are at most ``most`` apart (of J9 that test alone), with ``keep`` of both, the other's as ``_other_``.

    Time is cut into slots of that length, and a row meets its own slot's rows and those of the two beside it. Rows without a
    time are in no pair.
    """
    slot = F.floor(F.col(at) / most)
    left = a.select(*part, key, F.col(at).alias("_at"), *keep, F.explode(F.array(slot - 1, slot, slot + 1)).alias("_slot"))
    right = a.select(*part, F.col(key).alias("other"), F.col(at).alias("_other_at"), *(F.col(c).alias(f"_other_{c}") for c in keep), slot.alias("_slot"))
    met = left.join(right, [*part, "_slot"]).where(F.col(key) < F.col("other")).withColumn("apart", F.abs(F.col("_at") - F.col("_other_at")))
    return met.where(F.col("apart") <= most).drop("_slot", "_at", "_other_at")


def _block_pairs(a: DataFrame, key: str, part: list[str], vector: str, block: int) -> DataFrame:
    """Rows with their block ``_b``, once for each two blocks (``_i`` <= ``_j``) of their part that theirs is one of."""
    rows = a.where(F.col(vector).isNotNull()).select(*part, key, F.col(vector).cast("array<double>").alias("_v"))
    blocks = rows.groupBy(*part).agg(F.ceil(F.count("*") / block).cast("int").alias("_n"))
    rows = rows.join(blocks, part).withColumn("_b", F.pmod(F.xxhash64(key), F.col("_n")).cast("int"))
    rows = rows.withColumn("_x", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    rows = rows.withColumn("_i", F.least("_b", "_x")).withColumn("_j", F.greatest("_b", "_x"))
    return rows.select(*part, key, "_v", "_b", "_i", "_j")


def correlated_pairs(a: DataFrame, key: str, part: list[str], vector: str, least: float, block: int = 256) -> DataFrame:
    """Pairs of one part whose vectors' product, to six places, is ``least`` or more (of J9 that test alone).

    A part is dealt into blocks of about ``block`` rows by its keys' hashes, and two blocks at a time meet in a matrix product,
    so a task holds two blocks however large a part is; a row travels once for each block of its part. Rows without a vector
    or a part are in no pair; the others' have one length.
    """

    def products(g: pd.DataFrame) -> pd.DataFrame:
        first = g[g["_b"] == g["_i"].iloc[0]]
        second = g[g["_b"] == g["_j"].iloc[0]]
        if not len(first) or not len(second):
            return pd.DataFrame({c: [] for c in (*part, key, "other")})
        x, y = np.stack(first["_v"].to_list()), np.stack(second["_v"].to_list())
        k, o = np.nonzero(np.round(x @ y.T, 6) >= least)
        met = pd.DataFrame({key: first[key].to_numpy()[k], "other": second[key].to_numpy()[o]})
        if g["_i"].iloc[0] != g["_j"].iloc[0]:
            turned = met[key] > met["other"]
            met.loc[turned, [key, "other"]] = met.loc[turned, ["other", key]].to_numpy()
        met = met[met[key] < met["other"]]
        return met.assign(**{c: g[c].iloc[0] for c in part})[[*part, key, "other"]]

    ids = a.schema[key].dataType
    schema = T.StructType([*(a.schema[c] for c in part), T.StructField(key, ids), T.StructField("other", ids)])
    return _block_pairs(a, key, part, vector, block).groupBy(*part, "_i", "_j").applyInPandas(products, schema)


def closest(a: DataFrame, key: str, part: list[str], vector: str, block: int = 256) -> DataFrame:
    """(key, best, corr): of each row the other one of its part with the largest product, to six places, of equal ones the first (F8).

    Two blocks at a time meet in a matrix product, which leaves a row a candidate for each block. A row alone in its part, or
    without a vector or a part, has none and is left out.
    """

    def products(g: pd.DataFrame) -> pd.DataFrame:
        i, j = g["_i"].iloc[0], g["_j"].iloc[0]
        first, second = (g[g["_b"] == k].sort_values(key) for k in (i, j))
        out = []
        if len(first) and len(second):
            corr = np.round(np.stack(first["_v"].to_list()) @ np.stack(second["_v"].to_list()).T, 6)
            if i == j:
                np.fill_diagonal(corr, -np.inf)
            for rows, others, c in ((first, second, corr), (second, first, corr.T))[: 1 if i == j else 2]:
                at = c.argmax(axis=1)  # the first of equal ones
                top = c[np.arange(len(c)), at]
                out.append(pd.DataFrame({key: rows[key].to_numpy(), "best": others[key].to_numpy()[at], "corr": top})[top > -np.inf])
        return pd.concat(out) if out else pd.DataFrame({key: [], "best": [], "corr": []})

    ids = a.schema[key].dataType
    schema = T.StructType([T.StructField(key, ids), T.StructField("best", ids), T.StructField("corr", T.DoubleType())])
    some = _block_pairs(a, key, part, vector, block).groupBy(*part, "_i", "_j").applyInPandas(products, schema)
    return some.groupBy(key).agg(F.min_by("best", F.struct(-F.col("corr"), "best")).alias("best"), F.max("corr").alias("corr"))


def near_duplicates(a: DataFrame, key: str, part: list[str], hash_: str, at: str, segment: str, signature: str) -> DataFrame:
    """All pairs of one part (a shoot) that are near-duplicates (J9, P5), each once: part, key, other.

    Hashes that differ in few bits, or in some more within a minute; correlated signatures, whatever the time; or seconds apart
    in one segment. Each test has candidates of its own, and what it needs and is null fails it alone; a null segment is like another.
    """
    ids = [*part, key, "other"]
    near = time_pairs(a, key, part, at, max(CLOSE_S, MOMENT_S), [hash_, segment])
    looks = (F.col("apart") <= CLOSE_S) & (F.bit_count(F.col(hash_).bitwiseXOR(F.col(f"_other_{hash_}"))) <= CLOSE_BITS)
    moment = (F.col("apart") <= MOMENT_S) & F.col(segment).eqNullSafe(F.col(f"_other_{segment}"))
    alike = near_pairs(a.select(*part, key, hash_), key, part, hash_, ALIKE_BITS)
    return alike.select(*ids).unionByName(near.where(looks | moment).select(*ids)).unionByName(correlated_pairs(a, key, part, signature, ALIKE_CORR)).distinct()


def three_state_sort(df: DataFrame, col: str, seq: str, state: str) -> DataFrame:
    """Off: as inserted; ascending; descending, which turns the tie-break as well (T-5)."""
    if state == "off":
        return df.orderBy(seq)
    way = (lambda c: F.col(c).asc()) if state == "asc" else (lambda c: F.col(c).desc())
    return df.orderBy(way(col), way(seq))


def placed(df: DataFrame, place: str = "place") -> DataFrame:
    """Rows with their place, from 1, in the order that ``df`` has; no task gets more than its part of it."""
    rows = df.rdd.zipWithIndex().map(lambda r: (*r[0], r[1] + 1))
    return df.sparkSession.createDataFrame(rows, T.StructType([*df.schema.fields, T.StructField(place, T.LongType())]), verifySchema=False)


def with_pairs(picks: DataFrame, path: str = "path", pair: str = "pair_path", pos: str = "pos", include: bool = True) -> DataFrame:
    """Each pick, and its RAW right after it."""
    both = F.array_compact(F.array(path, pair)) if include else F.array(path)
    return picks.select(F.col(pos), F.posexplode(both).alias("nth", "src"))


def override(df: DataFrame, user: DataFrame, key: list[str], value: str, chosen: str) -> DataFrame:
    """The user's choice where there is one."""
    return df.join(user, key, "left").withColumn(value, F.coalesce(chosen, value)).drop(chosen)


def count_where(**tests: Column) -> list[Column]:
    """Named counts of conditions, for one aggregation (A1-A5)."""
    return [F.count_if(c).alias(n) for n, c in tests.items()]
