"""Removal of repeated word windows, by level-wise doubling.

A window of 35 words can only occur twice if the 9 words that are its minimizer
(the least hash among its 9-word windows) occur twice as one, and then the 18
words that go on from there to the right or to the left. So the first level
takes 9-word windows at minimizers, about one in fourteen words; only those that
occur twice are extended to 18 words, and only where those occur twice, to 35.
Neighbouring windows with one minimizer are a run and go through the levels
together; equal runs are settled by their count, and whole windows are compared
only between different runs that share their minimizer.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, map_rows

_B = 0x9E3779B97F4A7C15
_INV = pow(_B, -1, 1 << 64)
_POWERS: dict = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("b", ())) < n:
        m = 1 << max(16, n.bit_length())
        with np.errstate(over="ignore"):
            for name, base in (("b", _B), ("i", _INV)):
                x = np.full(m, base, np.uint64)
                x[0] = 1
                _POWERS[name] = np.multiply.accumulate(x)
    return _POWERS["b"][:n], _POWERS["i"][:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hashed:
    """A text's words, with the hash of any stretch of them in a step or two."""

    def __init__(self, words: list[bytes]):
        import xxhash

        n = len(words)
        x = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, n)
        power, self.back = _powers(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(x * power[:n], out=self.sums[1:])

    def of(self, start, size) -> np.ndarray:
        return _mix((self.sums[start + size] - self.sums[start]) * self.back[start] + np.asarray(size).astype(np.uint64))


def runs(words: list[bytes], length: int, first: int) -> tuple | None:
    """Runs of neighbouring windows with one minimizer: starts, counts, places of the minimizer, and hashes at each level."""
    n, w = len(words), length - first + 1
    if n < length:
        return None
    h = Hashed(words)
    at = np.arange(n - first + 1)
    low = np.uint64((1 << 24) - 1)
    key = (h.of(at, first) & ~low) | (low - (at.astype(np.uint64) & low))  # equal hashes: the last place
    have, best = 1, key
    while have < w:
        step = min(have, w - have)
        best = np.minimum(best[:-step], best[step:])
        have += step
    wrapped = (low - (best & low)).astype(np.int64)
    starts = np.arange(len(best))
    place = starts + ((wrapped - starts) & int(low))
    begin = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    count = np.diff(np.r_[begin, len(place)])
    p = place[begin]
    right, left = p + 2 * first <= n, p >= first
    r = np.where(right, h.of(np.where(right, p, 0), 2 * first) >> np.uint64(32), 0)
    l = np.where(left, h.of(np.where(left, p - first, 0), 2 * first) >> np.uint64(32), 0)
    return begin, count, p - begin, h.of(p, first), r, l, h.of(begin, count + length - 1)


def substring_dedup(docs: DataFrame, length: int = 35, first: int = 9, id_col: str = "doc_id", text: str = "text", texts: bool = False) -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_removed, kept_sha256, and with ``texts`` the kept words joined by spaces.

    A word goes if a window of ``length`` words that covers it also starts
    anywhere else; windows are judged on the input. Null and short texts lose
    nothing; a repeated row of ``length`` words or more is lost with its copy;
    null and repeated ids are documents like others; an empty table gives no
    rows. Other columns are left out. Words compare by 64-bit hashes, windows by
    two, of themselves and of their minimizer. What is joined back to its groups
    is a table, so Spark can split both sides of the join at a hot window.
    ``first``: words at the first level, with 3 * first - 1 <= length <= 4 * first.
    """
    if not 3 * first - 1 <= length <= 4 * first:
        raise ValueError("two doublings of the first level must reach the length, and each window hold an extension")
    spark = docs.sparkSession
    scratch = Scratch(spark, "substring")
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_text"), F.xxhash64(F.col(id_col), F.col(text)).alias("rid"))

    def make():
        def each(cols):
            parts = []
            for rid, x in zip(cols["rid"], cols["_text"]):
                got = runs(x.encode().split(), length, first) if x else None
                if got is not None:
                    parts.append((np.full(len(got[0]), rid), *got))
            if not parts:
                return None
            rid, start, count, off, h1, r, l, hs = map(np.concatenate, zip(*parts))
            signed = lambda a: a.astype(np.uint64).view(np.int64)
            half = lambda a: a.astype(np.uint32).view(np.int32)
            return {"rid": rid, "start": start.astype(np.int32), "n": count.astype(np.int16), "off": off.astype(np.int16), "h1": signed(h1), "r": half(r), "l": half(l), "hs": signed(hs)}

        return each

    found = scratch.table(map_rows(rows.select("rid", "_text"), "rid long, start int, n short, off short, h1 long, r int, l int, hs long", make), "runs")
    # Level one: minimizers that occur twice.
    twice = scratch.table(found.groupBy("h1").agg(F.count("*").alias("_n")).where("_n > 1").select("h1"), "twice")
    one = scratch.table(found.join(twice, "h1", "left_semi"), "one")
    scratch.drop("runs", "twice")
    # Level two: a window that reaches far to the right needs the right 18 words twice, one that reaches far to the left the left.
    reach = length - 2 * first  # windows that begin at most this far before the minimizer hold its right extension
    rr = one.groupBy("h1", "r").agg(F.count("*").alias("_n")).where("_n > 1").select("h1", "r", F.lit(True).alias("_r"))
    ll = one.groupBy("h1", "l").agg(F.count("*").alias("_n")).where("_n > 1").select("h1", "l", F.lit(True).alias("_l"))
    rr, ll = scratch.table(rr, "right"), scratch.table(ll, "left")
    two = one.join(rr, ["h1", "r"], "left").join(ll, ["h1", "l"], "left")
    two = two.where(f"(_r and _l) or (_r and off - n + 1 < {first}) or (_l and off > {reach})")
    two = scratch.table(two.select("rid", "start", "n", "off", "h1", "hs"), "two")
    scratch.drop("one", "right", "left")
    # Level three. Equal runs are one span; a span that occurs twice is repeated in all its windows.
    spans = two.groupBy("h1", "hs", "n", "off").agg(F.count("*").alias("copies"), F.min(F.struct("rid", "start")).alias("at"))
    spans = scratch.table(spans.withColumn("span", F.xxhash64("h1", "hs", "n", "off")), "spans")
    mixed = scratch.table(spans.groupBy("h1").agg(F.count("*").alias("_k")).where("_k > 1").select("h1"), "mixed")
    some = scratch.table(spans.join(mixed, "h1", "left_semi").select(F.col("at.rid").alias("rid"), F.col("at.start").alias("start"), "n", "h1", "span", "copies"), "some")
    ask = scratch.table(some.groupBy("rid").agg(F.collect_list(F.struct("start", "n", "h1", "span", "copies")).alias("ask")), "ask")

    def windows():
        def each(cols):
            h, h1, span, k, copies = [], [], [], [], []
            for x, ask in zip(cols["_text"], cols["ask"]):
                hashed = Hashed(x.encode().split())
                start = np.concatenate([np.arange(a["start"], a["start"] + a["n"]) for a in ask])
                h.append(hashed.of(start, length).view(np.int64))
                k.append(np.concatenate([np.arange(a["n"]) for a in ask]))
                for to, name in ((h1, "h1"), (span, "span"), (copies, "copies")):
                    to.append(np.repeat([a[name] for a in ask], [a["n"] for a in ask]))
            h, h1, span, k, copies = map(np.concatenate, (h, h1, span, k, copies))
            return {"h": h, "h1": h1, "span": span, "k": k.astype(np.int16), "copies": copies}

        return each

    asked = rows.select("rid", "_text").join(ask, "rid")
    whole = map_rows(asked.select("_text", "ask"), "h long, h1 long, span long, k short, copies long", windows)
    whole = scratch.table(whole.distinct(), "windows")  # a repeated row gives its windows twice
    again = scratch.table(whole.groupBy("h1", "h").agg(F.sum("copies").alias("_n")).where("_n > 1").select("h1", "h"), "again")
    masks = whole.where("copies = 1").join(again, ["h1", "h"], "left_semi").groupBy("span").agg(F.bit_or(F.expr("shiftleft(1L, k)")).alias("mask"))
    masks = scratch.table(masks.unionByName(spans.where("copies > 1").select("span", F.expr("shiftleft(1L, n) - 1").alias("mask"))), "masks")
    scratch.drop("windows", "again", "ask", "some", "mixed", "spans")
    gone = two.withColumn("span", F.xxhash64("h1", "hs", "n", "off")).join(masks, "span")
    gone = gone.groupBy("rid").agg(F.collect_set(F.struct("start", "mask")).alias("gone"))
    gone = scratch.table(gone, "gone")
    scratch.drop("two", "masks")

    def cut():
        def each(cols):
            out: dict = {"id": cols["_id"], "n_words": [], "n_removed": [], "kept_sha256": [], "kept": []}
            for x, gone in zip(cols["_text"], cols["gone"]):
                words = (x or "").encode().split()
                if gone:
                    step = np.zeros(len(words) + 1, np.int32)
                    for g in gone:
                        k = np.flatnonzero((g["mask"] >> np.arange(length)) & 1) + g["start"]
                        np.add.at(step, k, 1)
                        np.add.at(step, k + length, -1)
                    kept = [w for w, c in zip(words, np.cumsum(step[:-1]).tolist()) if not c]
                else:
                    kept = words
                body = b" ".join(kept)
                out["n_words"].append(len(words))
                out["n_removed"].append(len(words) - len(kept))
                out["kept_sha256"].append(hashlib.sha256(body).hexdigest())
                out["kept"].append(body.decode() if texts else None)
            return out

        return each

    kind = docs.schema[id_col].dataType.simpleString()
    done = map_rows(rows.join(gone, "rid", "left").select("_id", "_text", "gone"), f"id {kind}, n_words long, n_removed long, kept_sha256 string, kept string", cut)
    return done.select(F.col("id").alias(id_col), "n_words", "n_removed", "kept_sha256", *["kept"] * texts)

