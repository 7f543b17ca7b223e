"""Mixing sources to target weights.

Every document gets a hash-random key. Keys are uniform, so equal ranges of
them hold equal shares of any source, the hot one too. In the order of keys a
source is cut at its exact budget, after as many full epochs as the budget
holds: prefix sums over the ranges' word counts find the range in which the
budget ends, and within it, step by step, the row. So a source is known by one
place, and a document's words by whether it lies before that place. Documents
themselves are never dealt out or sorted.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch, word_count

#: The contract's weights, by the sources' order.
WEIGHTS = (1, 2, 3)


def targets(sources: DataFrame, weights: tuple = WEIGHTS, most_epochs: int = 3) -> DataFrame:
    """Adds ``target`` to rows (source, source_size), one a source.

    Sources by code point, null last, take the weights in turn; together they
    share all words. No target exceeds ``most_epochs`` times its source's size:
    sources in order of size for their weight are held at that while the rest's
    equal share is above it, which is where resharing the excess ends too.
    """
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.col("_n") % len(weights)).cast("int") + 1)
    by_ratio = Window.orderBy("_ratio", "_n")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("_ratio", "_n").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    df = sources.withColumn("_n", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    df = df.withColumn("_w", w.cast("long")).withColumn("_cap", F.col("source_size") * most_epochs)
    df = df.withColumn("_ratio", F.col("_cap").cast("double") / F.col("_w"))
    df = df.withColumn("_total", F.sum("source_size").over(everything))
    df = df.withColumn("_held", F.coalesce(F.sum("_cap").over(before), F.lit(0)))
    df = df.withColumn("_left", F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0)))
    df = df.withColumn("_capped", (F.col("_total") - F.col("_held")).cast("double") / F.col("_left") > F.col("_ratio"))
    df = df.withColumn("_share", F.min(F.when(~F.col("_capped"), F.struct("_ratio", "_n", (F.col("_total") - F.col("_held")).cast("double") / F.col("_left")))).over(everything)["col3"])
    target = F.when(F.col("_capped"), F.col("_cap").cast("double")).otherwise(F.col("_w") * F.col("_share"))
    return df.select("source", "source_size", target.alias("target"))


def _ends(rows: DataFrame, ends: DataFrame, by: list[str]) -> DataFrame:
    """Narrows the place where each source ends to the group by ``by`` that holds its word number ``left``, which then counts within the group.

    ``ends``: a row for each source, with columns of ``rows`` that say where to look, and ``left``. Sources without words have no place.
    """
    known = [c for c in ends.columns if c != "left"]
    at = ends.select(*[F.col(c).alias(f"_{c}") for c in ends.columns])
    groups = rows.join(at, _same(known)).groupBy(*known, *[c for c in by if c not in known]).agg(F.sum("size").alias("n"), F.first("_left").alias("left"))
    before = Window.partitionBy("source").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.withColumn("left", F.col("left") - F.coalesce(F.sum("n").over(before), F.lit(0)))
    return groups.where("left >= 0 and left < n").drop("n")


def _same(columns: list[str]) -> Column:
    return reduce(and_, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in columns])


def mix(docs: DataFrame, weights: tuple = WEIGHTS, most_epochs: int = 3, seed: str = "mix-0", id_col: str = "doc_id", text: str = "text", source: str = "source", rows_per_range: int = 100_000, keep: list[str] | None = None) -> DataFrame:
    """One row per row of ``docs``: id, size, source_size, target, and the words the mix takes of it.

    A source's taken words are the floor of its target, to the word: the last
    document may be taken in part. Null texts have size 0; null is a source of
    its own; empty sources have target 0. Repeated rows are documents of their
    own. Keys depend on id and seed alone; of rows with one id, smaller ones
    come first, then the order is that of a hash of the text, so reruns agree.
    Null ids are documents like others; an empty table gives no rows. Ranges are
    as many as keep one under ``rows_per_range`` rows, whatever the table's size.
    ``keep``: columns of ``docs`` to pass on, but those of the result's names;
    they are written once, and shuffled only if the table of sources, a row
    each, is too large for Spark to broadcast.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    passed = [c for c in (keep or []) if c not in {id_col, "size", "source_size", "target", "taken"}]
    rest = F.struct(*[F.col(c) for c in passed]) if passed else F.lit(None).cast("int")
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source).alias("source"), word_count(text).alias("size"), key.alias("key"), F.xxhash64(text).alias("tie"), rest.alias("rest"))
    sized = scratch.table(sized.withColumn("row", F.monotonically_increasing_id()), "sized")
    digits = max(3, math.ceil(math.log(max(1, sized.count() / rows_per_range), 16)))
    # A row's number starts with that of the task that wrote it, so rows equal in all else are counted by task first.
    rows = sized.withColumns({"part": F.substring("key", 1, digits), "task": F.shiftright("row", 33)})
    parts = scratch.table(rows.groupBy("source", "part").agg(F.sum("size").alias("size")), "parts")
    budget = targets(parts.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most_epochs)
    epochs = F.when(F.col("source_size") > 0, F.expr("floor(target) div source_size")).otherwise(0)
    budget = scratch.table(budget.withColumn("epochs", epochs), "budget")
    ends = budget.select("source", (F.floor("target") - F.col("epochs") * F.col("source_size")).alias("left"))
    for of, by in ((parts, ["part"]), (rows, ["key", "size", "tie"]), (rows, ["task"]), (rows, ["row"])):
        ends = scratch.table(_ends(of, ends, by), f"ends_{by[0]}")
    place = F.struct("key", "size", "tie", "row")
    ends = budget.withColumnRenamed("source", "_source").join(ends.select("source", place.alias("end"), "left"), _same(["source"]), "left").drop("source")
    ends = scratch.table(ends, "ends")
    more = F.when(place < F.col("end"), F.col("size")).when(place == F.col("end"), F.col("left")).otherwise(0)
    taken = F.col("epochs") * F.col("size") + more
    return sized.join(ends, _same(["source"])).select(F.col("doc_id").alias(id_col), "size", "source_size", "target", taken.cast("long").alias("taken"), *[F.col(f"rest.{c}").alias(c) for c in passed])
