"""Documents whose sets of word n-grams are alike: MinHash banding, verified on the full sets.

Documents with one set of n-grams are one node, however many there are. Nodes
meet by band hashes; the nodes of a bucket are linked to its first, which makes
candidate groups without a pair per pair. Groups are cut into blocks of bounded
size, and each pair of blocks is compared whole, as a product of incidence
matrices: every pair of a group is verified on its sets, and what comes out is a
row per node, its links counted and its root among the verified links.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import Scratch, map_rows


def bands_for(threshold: float, recall: float = 0.995, most_hashes: int = 168) -> tuple[int, int]:
    """(bands, rows): the most rows, so the fewest false candidates, that reach ``recall`` at ``threshold`` with so many hashes."""
    best = (most_hashes, 1)
    for rows in range(1, most_hashes + 1):
        p = threshold**rows
        bands = 1 if p >= 1 else int(np.ceil(np.log(1 - recall) / np.log1p(-p)))
        if bands * rows <= most_hashes:
            best = (bands, rows)
    return best


def shingles(text: str | None, n: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the ``n``-word runs; a shorter text is one run, one without words none."""
    import xxhash

    words = (text or "").encode().split()
    if not words:
        return np.empty(0, np.uint64)
    x = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    m = min(n, len(words))
    h = np.full(len(words) - m + 1, m, np.uint64)
    for k in range(m):
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + x[k : len(x) - m + 1 + k]
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return np.unique(h ^ (h >> np.uint64(29)))


def signatures(docs: DataFrame, threshold: float, n: int, recall: float, seed: int = 1) -> DataFrame:
    """(_id, rid, set_id, words, bands) per row; ``set_id`` is a 128-bit hash of the set, null if it is empty."""
    bands, rows = bands_for(threshold, recall)

    def make():
        import xxhash

        rng = np.random.default_rng(seed)
        a = rng.integers(1, 1 << 63, bands * rows, np.uint64) * np.uint64(2) + np.uint64(1)
        b = rng.integers(0, 1 << 63, bands * rows, np.uint64)

        def least(s):
            out = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
            for k in range(0, len(s), 512):
                x = s[None, k : k + 512] * a[:, None]
                x += b[:, None]
                np.minimum(out, x.min(axis=1), out=out)
            return out

        def each(cols):
            out: dict = {"_id": cols["_id"], "rid": cols["rid"], "set_id": [], "words": [], "bands": []}
            for x in cols["_text"]:
                s = shingles(x, n)
                out["words"].append(len(s))
                if len(s):
                    out["set_id"].append(xxhash.xxh3_128_hexdigest(s.tobytes()))
                    low = least(s).reshape(bands, rows)
                    out["bands"].append([xxhash.xxh64_intdigest(low[k].tobytes(), seed=k) - (1 << 63) for k in range(bands)])
                else:
                    out["set_id"].append(None)
                    out["bands"].append([])
            return out

        return each

    kind = docs.schema["_id"].dataType.simpleString()
    return map_rows(docs, f"_id {kind}, rid long, set_id string, words long, bands array<long>", make)


def _verify(threshold: float, n: int):
    top = round(threshold * 1000)

    def run(g: pd.DataFrame) -> pd.DataFrame:
        i, j = int(g["i"].iloc[0]), int(g["j"].iloc[0])
        g = g.sort_values("node")
        nodes, block = g["node"].to_numpy(), g["block"].to_numpy()
        copies = g["copies"].to_numpy()
        sets = [shingles(t, n) for t in g["_text"]]
        sizes = np.array([len(s) for s in sets], np.int64)
        every, inverse, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        column = np.cumsum(df > 1) - 1
        shared = (df > 1)[inverse]
        row = np.repeat(np.arange(len(sets)), sizes)[shared]
        col = column[inverse[shared]]
        order = np.argsort(col, kind="stable")
        row, col = row[order], col[order]
        inter = np.zeros((len(sets), len(sets)), np.float32)
        step = 4096
        for k in range(0, int(col[-1]) + 1 if len(col) else 0, step):
            lo, hi = np.searchsorted(col, (k, k + step))
            m = np.zeros((len(sets), step), np.float32)
            m[row[lo:hi], col[lo:hi] - k] = 1
            inter += m @ m.T
        inter = np.rint(inter).astype(np.int64)
        link = inter * 1000 >= top * (sizes[:, None] + sizes[None, :] - inter)
        np.fill_diagonal(link, False)
        if i != j:
            link &= block[:, None] != block[None, :]
        count = link @ copies
        root = np.arange(len(sets))
        while True:  # nodes are sorted: each takes the first root among its neighbours until nothing moves
            low = np.minimum(root, np.where(link, root[None, :], len(sets)).min(axis=1, initial=len(sets)))
            low = low[low]
            if (low == root).all():
                break
            root = low
        keep = count > 0
        return pd.DataFrame({"node": nodes[keep], "links": count[keep], "root": nodes[root][keep]})

    return run


def ngram_join(docs: DataFrame, threshold: float = 0.8, n: int = 5, recall: float = 0.995, id_col: str = "doc_id", text: str = "text", block_rows: int = 256, block_words: int = 500_000) -> DataFrame:
    """One row per row of ``docs``: id, class_id (the smallest id its links lead to), class_size, n_links, n_copies.

    ``n_links`` counts the other rows whose n-gram sets have a Jaccard
    similarity of ``threshold`` or more with this one's, copies included;
    ``n_copies`` those with an equal set. Texts of under ``n`` words are one
    n-gram; null texts and those without words are alone. Null ids are kept,
    and a null is no class's smallest id while others are there; repeated rows
    are copies; an empty table gives no rows. Other columns are left out.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "ngrams")
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_text"), F.xxhash64(F.col(id_col), F.col(text)).alias("rid"))
    signed = scratch.table(signatures(rows, threshold, n, recall), "signed")
    nodes = signed.where("set_id is not null").groupBy("set_id").agg(F.count("*").alias("copies"), F.min("_id").alias("first"), F.min("rid").alias("rid"), F.max("words").alias("words"), F.first("bands").alias("bands"))
    nodes = scratch.table(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    # Candidates: each node of a bucket and the bucket's first. A band's hash has the band in it.
    met = nodes.select("node", F.explode("bands").alias("h"))
    # What is joined back to its groups is a table, so both sides of the join are exchanges that Spark can split at a hot key.
    firsts = scratch.table(met.groupBy("h").agg(F.min("node").alias("pivot"), F.count("*").alias("_n")).where("_n > 1").select("h", "pivot"), "firsts")
    stars = scratch.table(met.join(firsts, "h").where("node <> pivot").select(F.col("node").alias("u"), F.col("pivot").alias("v")).distinct(), "stars")
    groups = scratch.table(components(stars, scratch, "candidates"), "groups")
    # Work units: pairs of blocks of a group.
    members = groups.join(nodes.select("node", "copies", "rid", "words"), "node")
    size = groups.join(nodes.select("node", "words"), "node").groupBy("root").agg(F.greatest(F.ceil(F.count("*") / block_rows), F.ceil(F.sum("words") / block_words)).cast("int").alias("blocks"))
    size = scratch.table(size, "sizes")
    members = members.join(size, "root").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    members = scratch.table(members.select("root", "node", "copies", "rid", "block", "blocks"), "members")
    wanted = members.select(F.col("rid").alias("w_rid"), "root", "node", "copies", "block", "blocks")
    # Merged at every size, so that small inputs are planned as large ones have to be.
    texts = rows.select("rid", "_text").join(wanted.hint("merge"), F.col("rid") == F.col("w_rid")).dropDuplicates(["node"])
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    units = texts.select("root", "node", "copies", "block", "_text", other).withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("other")
    # Units are dealt out by ranges, balanced by their rows; hashes would put several large ones into one task.
    verified = units.repartitionByRange("root", "i", "j").groupBy("root", "i", "j").applyInPandas(_verify(threshold, n), "node long, links long, root long")
    verified = scratch.table(verified, "verified")
    scratch.drop("firsts", "stars", "groups", "sizes", "members")
    classes = components(verified.select(F.col("node").alias("u"), F.col("root").alias("v")), scratch, "classes")
    links = verified.groupBy("node").agg(F.sum("links").alias("links"))
    known = nodes.select("node", "set_id", "copies", "first").join(classes, "node", "left").join(links, "node", "left").withColumn("root", F.coalesce("root", "node"))
    known = scratch.table(known, "known")
    whole = scratch.table(known.groupBy("root").agg(F.min("first").alias("class_id"), F.sum("copies").alias("class_size")), "classes")
    known = scratch.table(known.join(whole, "root").select(F.col("set_id").alias("k_set"), "class_id", "class_size", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), (F.col("copies") - 1).alias("n_copies")), "final")
    out = signed.select("_id", "set_id").join(known, F.col("set_id") == F.col("k_set"), "left")
    return out.select(
        F.col("_id").alias(id_col), F.when(F.col("set_id").isNull(), F.col("_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("class_size", F.lit(1)).alias("class_size"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("n_copies", F.lit(0)).alias("n_copies"),
    )
