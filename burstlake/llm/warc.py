"""WARC archives: writing, and reading back by boundary-chain verification.

The writer is Spark's text writer with the archive's record gap as its line
end, so files are committed whole whatever happens to executors. The reader
splits files at the version line, of whatever size they are; each piece that
looks like a header is a candidate, and its lengths give the place where the
next record must begin. Which candidates are records is settled by pointer
jumping from each file's start: first within each split, then over splits. A
version line inside a payload makes a candidate that nothing points to.
"""

from __future__ import annotations

import contextlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import Scratch

# The format's version line and gaps, and the contract's least size for a revisit.
MAGIC = "WARC/1.0\r\n"
GAP = "\r\n\r\n"
LEAST = 1000
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def with_revisits(pages: DataFrame, scratch: Scratch, id_col: str = "page_id", least: int = LEAST) -> DataFrame:
    """Adds ``refers_to``: of rows with equal payloads of ``least`` bytes or more, the largest id, but null on that row itself.

    Every row that has the largest id is a response, also where the row is
    repeated; a null id is smaller than any other, and rows that have nothing
    but null ids refer to none. Only payloads that occur twice are joined. Their
    table is written first, so Spark broadcasts it if its size on disk allows
    that, and otherwise merges.
    """
    df = pages.withColumn("_sha", F.sha1(F.col("_payload"))).withColumn("_len", F.octet_length("_payload").cast("long"))
    twice = df.where(F.col("_len") >= least).groupBy("_sha").agg(F.max(id_col).alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    twice = scratch.table(twice.select(F.col("_sha").alias("_sha2"), "_first"), "twice")
    df = df.join(twice, (F.col("_sha") == F.col("_sha2")) & (F.col("_len") >= least), "left")
    return df.withColumn("refers_to", F.when(F.col("_first") != F.col(id_col), F.col("_first"))).withColumn(
        "_revisit", F.col("_first").isNotNull() & (F.col(id_col).isNull() | (F.col("_first") != F.col(id_col)))
    ).withColumn("refers_to", F.when(F.col("_revisit"), F.col("_first")))


def write_warc(pages: DataFrame, path: str, scratch: Scratch, id_col: str = "page_id", url: str = "url", body: str = "html", date: str = "2024-01-01T00:00:00Z", rows_per_file: int = 50_000) -> None:
    """Writes a record per row; a null body is an empty payload, a null url leaves its header out.

    Record ids carry the row's id (``null`` if it is null; repeated ids and
    rows are records of their own). Revisits hold no payload but its digest and
    length. Line ends in urls become spaces. Other columns are left out. An
    empty table makes an archive without records.
    """
    df = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url).alias("_url"), F.coalesce(F.col(body).cast("binary"), F.lit(b"")).alias("_payload"))
    df = with_revisits(df, scratch)
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")), F.lit(">"))
    line = lambda name, value: F.concat(F.lit(name + ": "), value, F.lit("\r\n"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"), line("Content-Length", F.col("_len").cast("string")), F.lit("\r\n"))
    df = df.withColumn("_http", http)
    block = F.octet_length("_http") + F.when(F.col("_revisit"), 0).otherwise(F.col("_len"))
    head = F.concat(
        F.lit(MAGIC),
        line("WARC-Type", F.when(F.col("_revisit"), "revisit").otherwise("response")),
        line("WARC-Record-ID", urn("page_id")),
        line("WARC-Date", F.lit(date)),
        F.coalesce(line("WARC-Target-URI", F.regexp_replace("_url", r"[\r\n]+", " ")), F.lit("")),
        F.when(F.col("_revisit"), F.concat(line("WARC-Refers-To", urn("refers_to")), line("WARC-Profile", F.lit(REVISIT)))).otherwise(""),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("_sha"))),
        line("X-Payload-Length", F.col("_len").cast("string")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", block.cast("string")),
        F.lit("\r\n"),
    )
    payload = F.when(F.col("_revisit"), F.lit(b"")).otherwise(F.col("_payload"))
    record = F.concat(head.cast("binary"), F.col("_http").cast("binary"), payload).cast("string")
    df.select(record.alias("value")).write.option("lineSep", GAP).option("maxRecordsPerFile", rows_per_file).text(path)


def _field(name: str) -> "F.Column":
    """A header's value; null if it is missing."""
    got = F.regexp_extract("_head", rf"(?i)(?:^|\r\n){name}:[ \t]*([^\r\n]*)", 1)
    return F.when(got != "", got)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """What lies between version lines, with its place in the split; headers parsed where they look like one."""
    df = spark.read.option("lineSep", MAGIC).text(path)
    df = df.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("nth"),
        F.col("value").cast("binary").alias("_bytes"),
        F.substring_index("value", GAP, 1).alias("_head"),
    )
    size = F.octet_length("_bytes").cast("long")
    at = F.octet_length("_head").cast("long") + 4
    length = F.when(_field("Content-Length").rlike("^[0-9]{1,18}$"), _field("Content-Length")).cast("long")
    valid = F.col("_head").rlike("^[A-Za-z-]+:") & (at <= size) & length.isNotNull() & _field("WARC-Type").isNotNull()
    df = df.select(
        "file", "split", "nth", "_bytes", "_head",
        size.alias("size"), F.when(valid, at).alias("at"), F.when(valid, length).alias("length"),
    )
    block = F.expr("substring(_bytes, cast(at + 1 as int), cast(length as int))")
    inside = F.col("at") + F.col("length") <= F.col("size")
    http = F.octet_length(F.substring_index(block.cast("string"), GAP, 1)).cast("long") + 4
    df = df.withColumn("_http", F.when(inside & _field("Content-Type").startswith("application/http"), http).otherwise(F.when(inside, F.lit(0))))
    payload = F.expr("substring(_bytes, cast(at + _http + 1 as int), cast(length - _http as int))")
    return df.select(
        "file", "split", "nth", "size", "at", "length",
        _field("WARC-Type").alias("type"), _field("WARC-Record-ID").alias("record"), _field("WARC-Refers-To").alias("refers"),
        _field("WARC-Payload-Digest").alias("claimed"), _field("X-Payload-Length").cast("long").alias("claimed_len"),
        F.sha1(payload).alias("sha"), F.octet_length(payload).cast("long").alias("len"), _field("Content-Type").alias("ctype"),
    )


@contextlib.contextmanager
def _same_splits(scratch: Scratch, conf: str = "spark.sql.files.minPartitionNum"):
    """How files are cut into splits doesn't change when executors come or go between the scans of a run, so each numbers pieces alike."""
    spark = scratch.spark
    was = spark.conf.get(conf, None)
    scratch.splits = getattr(scratch, "splits", None) or was or str(spark.sparkContext.defaultParallelism)
    spark.conf.set(conf, scratch.splits)
    try:
        yield
    finally:
        spark.conf.unset(conf) if was is None else spark.conf.set(conf, was)


def _jump(succ: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Each candidate's first successor that is not among these candidates, by pointer jumping."""
    where = np.searchsorted(offsets, succ)
    inside = (where < len(offsets)) & (offsets[np.minimum(where, len(offsets) - 1)] == succ)
    nxt = np.where(inside, where, np.arange(len(offsets)))
    while True:
        far = nxt[nxt]
        if (far == nxt).all():
            return succ[nxt]
        nxt = far


def records(spark: SparkSession, path: str, scratch: Scratch) -> DataFrame:
    """The archive's true records: file, offset, and what ``_pieces`` read of them.

    A chain that meets no candidate where its next record must begin ends there;
    what lies behind it is no record. Files may be of any size: what one task
    holds is the candidates of one split.
    """
    with _same_splits(scratch):
        pieces = scratch.table(_pieces(spark, path), "pieces")
    m = len(MAGIC)
    # A split's pieces are read in order; a piece starts behind all that came before it in its file, and a version line each.
    total = pieces.groupBy("file", "split").agg(F.sum(F.col("size") + m).alias("total"))
    base = total.select("file", "split", F.coalesce(F.sum("total").over(Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inner = Window.partitionBy("file", "split").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    placed = pieces.withColumn("before", F.coalesce(F.sum(F.col("size") + m).over(inner), F.lit(0)))
    placed = placed.join(base, ["file", "split"]).withColumn("offset", F.col("base") + F.col("before") - m)
    placed = placed.withColumn("succ", F.col("offset") + m + F.col("at") + F.col("length") + 4)
    placed = scratch.table(placed.drop("before", "base"), "placed")
    candidates = placed.where("succ is not null and offset >= 0")

    def exits(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("offset")
        g["far"] = _jump(g["succ"].to_numpy(), g["offset"].to_numpy())
        return g[["file", "split", "offset", "far"]]

    edges = scratch.table(candidates.select("file", "split", "offset", "succ").groupBy("file", "split").applyInPandas(exits, "file string, split long, offset long, far long"), "edges")
    # Over splits: only where some split's chain can enter another. Both what is reached and the jumps double each round.
    far = edges.select("file", F.col("far").alias("offset")).distinct()
    jumps = edges.join(far, ["file", "offset"], "left_semi").unionByName(edges.where("offset = 0")).select("file", "offset", "far").distinct()
    jumps = scratch.table(jumps, "jumps-0")
    reached = scratch.table(edges.select("file").distinct().withColumn("offset", F.lit(0).cast("long")), "reached-0")
    n, k = reached.count(), 0
    while True:
        step = jumps.join(reached, ["file", "offset"]).select("file", F.col("far").alias("offset"))
        k += 1
        reached = scratch.table(reached.unionByName(step).distinct(), f"reached-{k}")
        m2 = reached.count()
        if m2 == n:
            break
        n = m2
        on = jumps.select("file", F.col("offset").alias("far"), F.col("far").alias("farther"))
        jumps = scratch.table(jumps.join(on, ["file", "far"], "left").select("file", "offset", F.coalesce("farther", "far").alias("far")), f"jumps-{k}")
    enters = edges.join(reached, ["file", "offset"], "left_semi").groupBy("file", "split").agg(F.min("offset").alias("enter"))

    def chain(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("offset")
        offsets, succ = g["offset"].to_numpy(), g["succ"].to_numpy()
        true = offsets == g["enter"].to_numpy()
        where = np.searchsorted(offsets, succ)
        inside = (where < len(offsets)) & (offsets[np.minimum(where, len(offsets) - 1)] == succ)
        end = len(offsets)
        nxt = np.append(np.where(inside, where, end), end)
        true = np.append(true, False)
        while True:  # what is reached, and how far a jump goes, double
            more = true.copy()
            more[nxt[np.flatnonzero(true)]] = True
            more[end] = False
            if (more == true).all():
                break
            true, nxt = more, nxt[nxt]
        return g.loc[true[:-1], ["file", "offset"]]

    true = candidates.join(enters, ["file", "split"]).select("file", "split", "offset", "succ", "enter").groupBy("file", "split").applyInPandas(chain, "file string, offset long")
    return placed.join(scratch.table(true, "true"), ["file", "offset"], "left_semi")


def read_warc(spark: SparkSession, path: str, scratch: Scratch) -> DataFrame:
    """One row per record: page_id, payload_bytes, payload_digest, record_type, refers_to, digest_ok.

    Payload figures are computed from the bytes read; a revisit has its
    original's from its header. ``digest_ok``: the header's digest agrees.
    A record whose payload holds version lines is put together from its pieces.
    """
    found = records(spark, path, scratch)
    m = len(MAGIC)
    split = found.where("sha is null and succ is not null").select("file", F.col("offset").alias("start"), "succ", F.col("at").alias("head"), "length", "ctype")
    split = scratch.table(split, "split-records")
    if split.isEmpty():
        whole = found
    else:
        whole = found.join(_joined_payloads(spark, path, scratch, split), ["file", "offset"], "left")
        whole = whole.withColumn("sha", F.coalesce("sha", "sha_joined")).withColumn("len", F.coalesce("len", "len_joined"))
    number = lambda c: F.expr(f"try_cast(regexp_extract({c}, 'urn:page:(-?[0-9]+)', 1) as long)")
    back = F.col("type") == "revisit"
    return whole.select(
        number("record").alias("page_id"),
        F.when(back, F.col("claimed_len")).otherwise(F.col("len")).alias("payload_bytes"),
        F.when(back, F.regexp_replace("claimed", "^sha1:", "")).otherwise(F.col("sha")).alias("payload_digest"),
        F.col("type").alias("record_type"),
        F.when(back, number("refers")).alias("refers_to"),
        (back | (F.concat(F.lit("sha1:"), F.col("sha")) == F.col("claimed"))).alias("digest_ok"),
    )


def _joined_payloads(spark: SparkSession, path: str, scratch: Scratch, split: DataFrame) -> DataFrame:
    """Digest and length of payloads that hold version lines. Only their own pieces are read again and moved.

    A piece is found again by its file, split and number, and must have its size; a record that isn't whole then is an error.
    """
    placed = spark.read.parquet(scratch.path("placed")).select("file", "split", "nth", "offset", "size")
    starts = split.select("file", F.col("start").alias("offset"), "start", "succ", "head", "length", "ctype")
    last = Window.partitionBy("file", "split").orderBy("offset")
    # A record's start is carried to the pieces behind it, within its split and from split to split.
    cut = placed.join(starts, ["file", "offset"], "left")
    carried = F.struct("start", "succ", "head", "length", "ctype")
    cut = cut.withColumn("_r", F.when(F.col("start").isNotNull(), carried))
    ends = cut.groupBy("file", "split").agg(F.max_by("_r", F.when(F.col("start").isNotNull(), F.col("start"))).alias("_e"))
    ends = ends.select("file", "split", F.last("_e", True).over(Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)).alias("_e"))
    cut = cut.withColumn("_r", F.last("_r", True).over(last)).join(ends, ["file", "split"])
    cut = cut.withColumn("_r", F.coalesce("_r", "_e")).where("offset >= _r.start and offset < _r.succ").select("file", "split", "nth", "offset", "size", "_r.*")
    cut = scratch.table(cut, "split-pieces")
    again = spark.read.option("lineSep", MAGIC).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("nth"), F.col("value").cast("binary").alias("bytes")
    )

    def put(g: pd.DataFrame) -> pd.DataFrame:
        import hashlib

        g = g.sort_values("offset")
        r = g.iloc[0]
        block = b"".join(MAGIC.encode() * bool(i) + bytes(b) for i, b in enumerate(g["bytes"]))[int(r["head"]) :][: int(r["length"])]
        if len(block) != r["length"]:
            raise ValueError(f"the record at {r['start']} of {r['file']} has {len(block)} of {r['length']} bytes: the archive has changed")
        if (r["ctype"] or "").startswith("application/http"):
            block = block[block.find(b"\r\n\r\n") + 4 :]
        return pd.DataFrame({"file": [r["file"]], "offset": [r["start"]], "sha_joined": [hashlib.sha1(block).hexdigest()], "len_joined": [len(block)]})

    both = again.join(cut, ["file", "split", "nth"]).where(F.octet_length("bytes") == F.col("size"))
    with _same_splits(scratch):
        return scratch.table(both.groupBy("file", "start").applyInPandas(put, "file string, offset long, sha_joined string, len_joined long"), "joined")
