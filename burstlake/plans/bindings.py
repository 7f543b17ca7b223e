"""The driver's tables in the roles of the survey's entities (§7.1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import naive_seconds, sign_hash

#: What an event's kind costs as a flag.
PENALTIES = {"error": 4, "signup": 2, "purchase": 1}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as frames: a user's events are a shoot. Times are naive."""
    e = table(spark, sf_dir, "events")
    pen = F.when(F.col("event_type") == "error", 4).when(F.col("event_type") == "signup", 2).when(F.col("event_type") == "purchase", 1).otherwise(0)
    t = naive_seconds(F.col("ts"))
    k = F.get_json_object("props", "$.k").cast("long")
    return e.select(F.col("event_id").alias("frame_id"), F.col("user_id").alias("shoot_id"), t.alias("t"), F.col("value").alias("sharpness"), "event_type", k.alias("k"), pen.alias("penalty"))


FRAMES_SQL = """frames AS (SELECT event_id AS frame_id, user_id AS shoot_id, epoch_us(ts) / 1e6 AS t, value AS sharpness, event_type,
 CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
 CASE event_type WHEN 'error' THEN 4 WHEN 'signup' THEN 2 WHEN 'purchase' THEN 1 ELSE 0 END AS penalty FROM events)"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as a catalog: the source is the folder; ids count pairs of names, a third of them RAW."""
    d = table(spark, sf_dir, "documents")
    ext = F.when(F.col("doc_id") % 3 == 0, "CR2").when(F.col("doc_id") % 3 == 1, "jpg").otherwise("JPEG")
    stem = F.concat(F.when(F.col("doc_id") % 2 == 0, "IMG_").otherwise("img_"), F.floor(F.col("doc_id") / 4).cast("string"))
    d = d.select(F.col("doc_id").alias("pos"), F.col("source").alias("dir"), stem.alias("stem"), ext.alias("ext"), "n_chars", "lang")
    d = d.withColumn("dir", F.concat(F.lit("d"), (F.floor(F.col("pos") / 40)).cast("string")))
    return d.withColumn("path", F.concat_ws("", "dir", F.lit("/"), "stem", F.lit("."), "ext"))


FILES_SQL = """files AS (SELECT *, dir || '/' || stem || '.' || ext AS path FROM (SELECT doc_id AS pos, 'd' || CAST(doc_id // 40 AS VARCHAR) AS dir,
 CASE WHEN doc_id % 2 = 0 THEN 'IMG_' ELSE 'img_' END || CAST(doc_id // 4 AS VARCHAR) AS stem,
 CASE doc_id % 3 WHEN 0 THEN 'CR2' WHEN 1 THEN 'jpg' ELSE 'JPEG' END AS ext, n_chars, lang FROM documents))"""


def portraits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``embeddings`` as analysed frames: forty make a shoot, with runs of quick frames, pauses, unknown times, unreadable frames and up to two faces."""
    v, i = F.col("vec_id"), F.col("vec_id") % 40
    t = (i * 2 + F.floor(i / 5) * 20 + F.floor(i / 13) * 400).cast("double")

    def face(k):
        size = 24 + v * (5 + k) % 80
        return F.struct((40 + v * (7 + k) % 400).alias("x"), (v * (11 + k) % 250).alias("y"), size.alias("w"), size.alias("h"), (0.05 + (v * (13 + k) % 29) / 100).alias("ten_n"), ((v * (17 + k) % 40) / 1000).alias("clip_hi"), (30 + v * (19 + k) % 150).cast("double").alias("mean"))

    size = F.transform("embedding", lambda x: F.abs(x.cast("double")))
    total = F.aggregate(size, F.lit(0.0), lambda a, x: a + x)
    return table(spark, sf_dir, "embeddings").select(
        F.floor(v / 40).alias("shoot_id"), v.alias("frame_id"), F.lpad(v.cast("string"), 8, "0").alias("path"), F.concat(F.lit("IMG_"), F.lpad(v.cast("string"), 8, "0")).alias("name"), v.alias("file_number"),
        F.when(v % 23 != 0, t).alias("t"), F.when(v % 31 == 0, "broken").alias("error"), F.lit(640).alias("w"), F.lit(432).alias("h"), (60 + v * 37 % 600).cast("double").alias("lapvar"), (v * 53 % 97 / 10.0).alias("frame_sharp"),
        sign_hash(F.col("embedding")).alias("ahash"), F.transform(size, lambda x: x / total).alias("hist"), F.slice(F.array(face(0), face(1)), 1, (v % 3).cast("int")).alias("faces"),
    )


_FACE = """SELECT vec_id AS frame_id, {k} AS k, 40 + vec_id * {a} % 400 AS x, vec_id * {b} % 250 AS y, 24 + vec_id * {c} % 80 AS s, 0.05::DOUBLE + (vec_id * {d} % 29) / 100.0::DOUBLE AS ten_n,
 (vec_id * {e} % 40) / 1000.0::DOUBLE AS clip_hi, (30 + vec_id * {f} % 150)::DOUBLE AS mean FROM embeddings WHERE vec_id % 3 > {k}"""
PORTRAITS_SQL = f"""portraits AS (SELECT vec_id // 40 AS shoot_id, vec_id AS frame_id, CASE WHEN vec_id % 23 <> 0 THEN (i * 2 + i // 5 * 20 + i // 13 * 400)::DOUBLE END AS t, vec_id % 31 = 0 AS bad, vec_id % 3 AS n_faces,
 (60 + vec_id * 37 % 600)::DOUBLE AS lapvar, (vec_id * 53 % 97) / 10.0::DOUBLE AS frame_sharp, [x > 0 for x in embedding] AS bits, [abs(x::DOUBLE) for x in embedding] AS size FROM (SELECT *, vec_id % 40 AS i FROM embeddings)),
 faces AS ({_FACE.format(k=0, a=7, b=11, c=5, d=13, e=17, f=19)} UNION ALL {_FACE.format(k=1, a=8, b=12, c=6, d=14, e=18, f=20)})"""
