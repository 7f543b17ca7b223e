"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items meet at seeds, runs of tokens that both hold: a
join on the seeds' running Karp-Rabin hashes. Between a document and an item
that share one, the longest match is marked again and again until none of the
least length is left between unmarked tokens; a match is a run of seeds on one
diagonal. The share of an item's tokens that got marked is its coverage, which
parts of an item in another order reach as well as the item itself.

The benchmark is a table like the documents. All that is broadcast is a bitmap
of its seeds' hashes, of a bounded size, which keeps most of the documents'
other seeds out of the join; where it is too full to do that, more seeds are
joined, and the result is the same.
"""

from __future__ import annotations

import heapq
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, map_rows

_token = re.compile(r"[^\W_]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)


def tokens(text: str) -> list[str]:
    """Runs of letters and digits, in lower case."""
    return _token.findall(text.lower())


def token_hashes(text: str | None) -> np.ndarray:
    import xxhash

    words = tokens(text or "")
    return np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))


def seeds(x: np.ndarray, n: int) -> np.ndarray:
    """Karp-Rabin hashes of all runs of ``n`` tokens, spread over all bits."""
    if len(x) < n:
        return np.empty(0, np.uint64)
    out = np.full(len(x) - n + 1, n, np.uint64)
    for k in range(n):
        out = out * _BASE + x[k : len(x) - n + 1 + k]
    out = (out ^ (out >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(32))


def _grouped(h: np.ndarray, at: np.ndarray) -> tuple[list[int], list[list[int]]]:
    """Different hashes, as signed numbers, and the places of each, in order."""
    order = np.lexsort((at, h))
    h, at = h[order], at[order]
    begin = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.empty(0, np.int64)
    return h[begin].view(np.int64).tolist(), [p.tolist() for p in np.split(at, begin[1:])] if len(h) else []


def matches(places: list[tuple[list[int], list[int]]], n: int, most: int = 4_000_000) -> list[tuple[int, int, int]]:
    """(size, place in the item, diagonal) of the longest runs of shared seeds of ``n`` tokens.

    ``places``: of each seed its places in the document and in the item. Pairs
    of places are made ``most`` at a time, in order of the document's places.
    """
    q = np.concatenate([np.asarray(d, np.int64) for d, _ in places])
    which = np.repeat(np.arange(len(places)), [len(d) for d, _ in places])
    order = np.argsort(q, kind="stable")
    q, which = q[order], which[order]
    items = [np.asarray(p, np.int64) for _, p in places]
    width = np.array([len(p) for p in items])
    so_far = np.cumsum(width[which])
    found: list[tuple[int, int, int]] = []
    open_: dict = {}  # diagonal: (place in the item, seeds) of a run that may go on
    at = 0
    while at < len(q):
        end = max(at + 1, int(np.searchsorted(so_far, (so_far[at - 1] if at else 0) + most, "right")))
        p = np.concatenate([items[k] for k in which[at:end]])
        d = np.repeat(q[at:end], width[which[at:end]]) - p
        by = np.lexsort((p, d))
        p, d = p[by], d[by]
        begin = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (p[1:] != p[:-1] + 1)])
        size = np.diff(np.r_[begin, len(p)])
        still: dict = {}
        for dd, pp, k in zip(d[begin].tolist(), p[begin].tolist(), size.tolist()):
            was = open_.pop(dd, None)
            if was is not None and was[0] + was[1] == pp:
                pp, k = was[0], was[1] + k
            elif was is not None:
                found.append((was[1] + n - 1, was[0], dd))
            if (last := still.pop(dd, None)) is not None:
                found.append((last[1] + n - 1, last[0], dd))
            still[dd] = (pp, k)
        found += [(k + n - 1, pp, dd) for dd, (pp, k) in open_.items()]
        open_, at = still, end
    return found + [(k + n - 1, pp, dd) for dd, (pp, k) in open_.items()]


def tile(size: int, places: list[tuple[list[int], list[int]]], n: int) -> float:
    """Greedy tiling of an item of ``size`` tokens: the share of its tokens in tiles of ``n`` tokens or more.

    Of equally long matches the first in the item comes first, and then the one
    further to the left in the document.
    """
    heap = [(-s, p, d) for s, p, d in matches(places, n)]
    heapq.heapify(heap)
    in_item, in_doc = np.zeros(size, bool), np.zeros(max((p + d - s for s, p, d in heap), default=0), bool)
    while heap and not in_item.all():
        s, p, d = heapq.heappop(heap)
        taken = in_item[p : p - s] | in_doc[p + d : p + d - s]
        if not taken.any():
            in_item[p : p - s] = True
            in_doc[p + d : p + d - s] = True
            continue
        edges = np.flatnonzero(np.diff(np.r_[True, taken, True].astype(np.int8)))  # what is left of it, if long enough, waits its turn
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if b - a >= n:
                heapq.heappush(heap, (a - b, p + a, d))
    return float(in_item.mean())


def coverage(item: str, doc: str, least: int = 5) -> float:
    """The share of an item's tokens that tiles in a document cover; both are texts."""
    x, y = token_hashes(item), token_hashes(doc)
    if not (n := min(least, len(x))):
        return 0.0
    mine, theirs = (dict(zip(*_grouped(seeds(z, n), np.arange(max(0, len(z) - n + 1))))) for z in (x, y))
    places = [(theirs[h], p) for h, p in mine.items() if h in theirs]
    return tile(len(x), places, n) if places else 0.0


def _spots(h: np.ndarray, bits: int) -> list[np.ndarray]:
    """Four places of each hash in a bitmap of ``bits``, a power of two."""
    g, mask = h * np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(bits - 1)
    return [x & mask for x in (h, h >> np.uint64(32), g >> np.uint64(37), g >> np.uint64(8))]


def _bitmap(h: DataFrame, most_bits: int) -> np.ndarray:
    """A bitmap of hashes: 64 bits for each, but no more than ``most_bits``, so few others are held while they have that room."""
    bits = min(most_bits, max(1 << 16, 1 << (64 * h.count()).bit_length()))

    def make():
        return lambda cols: {"b": np.concatenate(_spots(np.array(cols["h"], np.int64).view(np.uint64), bits)).astype(np.int64).tolist()}

    words = map_rows(h, "b long", make).groupBy(F.shiftright("b", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b & 63 as int))")).alias("x")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[words["w"].to_numpy()] = words["x"].to_numpy().view(np.uint64)
    return out


def _held(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The places of hashes that may be in the bitmap."""
    at = np.arange(len(h))
    for b in _spots(h, len(bitmap) * 64):
        b = b[at]
        at = at[(bitmap[b >> np.uint64(6)] >> (b & np.uint64(63))) & np.uint64(1) == 1]
    return at


def decontaminate(docs: DataFrame, benchmark: DataFrame, least: int = 5, threshold: float = 0.5, id_col: str = "doc_id", text: str = "text", keep: list[str] | None = None, most_bits: int = 1 << 27) -> DataFrame:
    """One row per row of ``docs``: id, contaminated, n_items, item_id and coverage of the best item, and all items at ``threshold``.

    Null and empty texts hold no item; items without tokens are never held;
    an item of under ``least`` tokens counts if it occurs whole. Equal
    coverages: the smallest item id; null is the largest. Items without an id
    count for contaminated and n_items like others, each row by itself, and
    are null in item_id and left out of items; an item that is listed twice
    counts twice. Repeated rows are judged alike, null and repeated ids too;
    an empty table gives no rows, an empty benchmark is in no document.
    ``keep``: columns of ``docs`` to pass on, but those of the result's names.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "tiling")
    own = {id_col, "contaminated", "n_items", "item_id", "coverage", "items"}
    passed = [c for c in (keep or []) if c not in own]

    def of_items():
        def each(cols):
            out: dict = {"item": [], "size": [], "n": [], "at": []}
            for i, x in zip(cols["_item"], cols["_text"]):
                x = token_hashes(x)
                if n := min(least, len(x)):
                    h, places = _grouped(seeds(x, n), np.arange(len(x) - n + 1))
                    out["item"].append(i)
                    out["size"].append(len(x))
                    out["n"].append(n)
                    out["at"].append([{"h": a, "p": p} for a, p in zip(h, places)])
            return out

        return each

    items = benchmark.select(F.col("item_id").cast("long").alias("_item"), F.col("text").alias("_text"))
    items = map_rows(items, "item long, size int, n int, at array<struct<h:long,p:array<int>>>", of_items)
    items = scratch.table(items.withColumn("key", F.monotonically_increasing_id()), "items")
    at = items.select("key", "item", "size", "n", F.explode("at").alias("s")).select("key", "item", "size", "n", "s.h", "s.p")
    sizes = sorted(r.n for r in items.select("n").distinct().collect())  # at most ``least`` numbers
    bitmap = spark.sparkContext.broadcast(_bitmap(at.select("h").distinct(), most_bits))

    def of_docs():
        def each(cols):
            found = []
            for x in cols["_text"]:
                x = token_hashes(x) if sizes else np.empty(0, np.uint64)
                h, q = [], []
                for n in sizes:
                    hs = seeds(x, n)
                    some = _held(bitmap.value, hs)
                    h.append(hs[some])
                    q.append(some)
                found.append([{"h": a, "q": p} for a, p in zip(*_grouped(np.concatenate(h), np.concatenate(q)))] if sizes and any(map(len, h)) else None)
            return {"_id": cols["_id"], "_rest": cols["_rest"], "_found": found}

        return each

    rest = F.struct(*[F.col(c) for c in passed]) if passed else F.lit(None).cast("int")
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_text"), rest.alias("_rest"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    rows = map_rows(rows, f"_id {kinds['_id']}, _rest {kinds['_rest']}, _found array<struct<h:long,q:array<int>>>", of_docs)
    rows = scratch.table(rows.withColumn("_row", F.monotonically_increasing_id()), "rows")

    # A row for a document, an item and a seed that both hold, with its places in both.
    mine = rows.where("_found is not null").select("_row", F.explode("_found").alias("s")).select("_row", "s.h", "s.q")
    met = mine.join(at, "h").groupBy("_row", "key").agg(F.first("item").alias("item"), F.first("size").alias("size"), F.first("n").alias("n"), F.collect_list(F.struct("q", "p")).alias("places"))

    def tiles():
        def each(cols):
            covered = [tile(size, [(s["q"], s["p"]) for s in places], n) for size, n, places in zip(cols["size"], cols["n"], cols["places"])]
            return {"_row": cols["_row"], "item": cols["item"], "coverage": covered}

        return each

    hits = map_rows(met.drop("key"), "_row long, item long, coverage double", tiles)
    over = F.col("coverage") >= threshold
    hits = hits.groupBy(F.col("_row").alias("_of")).agg(
        F.count_if(over).alias("_n"),
        F.min(F.struct((-F.col("coverage")).alias("c"), F.col("item").isNull().alias("none"), F.col("item").alias("i"))).alias("_best"),
        F.sort_array(F.collect_list(F.when(over, F.col("item")))).alias("_items"),
    )
    hits = scratch.table(hits, "hits")
    some = rows.where("_found is not null").join(hits, F.col("_row") == F.col("_of"), "left").drop("_found", "_of")
    none = rows.where("_found is null").drop("_found").select("*", *[F.lit(None).cast(hits.schema[c].dataType).alias(c) for c in ("_n", "_best", "_items")])
    return some.unionByName(none).select(
        F.col("_id").alias(id_col),
        (F.coalesce("_n", F.lit(0)) > 0).alias("contaminated"),
        F.coalesce("_n", F.lit(0)).cast("long").alias("n_items"),
        F.col("_best.i").alias("item_id"),
        F.coalesce(-F.col("_best.c"), F.lit(0.0)).alias("coverage"),
        F.coalesce("_items", F.array().cast("array<long>")).alias("items"),
        *[F.col(f"_rest.{c}").alias(c) for c in passed],
    )
