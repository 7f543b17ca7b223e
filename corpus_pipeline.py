"""From raw documents to a training mix: five operators, each on all that its predecessor kept.

Each stage carries its input row as one struct beside what its operator adds, so
columns of any name pass through unchanged. Null and repeated ids are documents
like others; of rows repeated whole the second stage keeps one; null and empty
texts fail the first stage; an empty table gives no rows at every stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from burstlake.llm import decontamination, mixing, ngram_join, quality_rules, secret_scan
from burstlake.llm.shared import Scratch, scoped


def _carried(docs: DataFrame, *names: str) -> DataFrame:
    """``names`` of the columns, and whole rows as ``_row``."""
    return docs.select(*names, F.struct(*docs.columns).alias("_row"))


def _key(id_: str, text: str) -> Column:
    """128 bits for an id and a text, nulls and all."""
    part = lambda c: F.coalesce(F.md5(F.col(c).cast("string")), F.lit("-"))
    return F.md5(F.concat(part(id_), part(text)))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what the base test and the learned list keep."""
    rules = quality_rules.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_rules.quality_rules(_carried(docs, "text"), rules).where("kept").select("_row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each class the document with the smallest id, and of rows with one id and text one.

    Documents are told apart by id and text together, so neither a null id nor
    one that several texts share lets a copy through. The copies of one row are
    dropped on the side of the map, before the rows are dealt out for the join.
    """
    rows = docs.select(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", _key("doc_id", "text").alias("key")).alias("id"), "text")
    found = ngram_join.ngram_join(rows, id_col="id").where("id <=> class_id").select(F.col("id.key").alias("_kept")).distinct()
    return _carried(docs).withColumn("_key", _key("_row.doc_id", "_row.text")).dropDuplicates(["_key"]).join(found, F.col("_key") == F.col("_kept"), "left_semi").select("_row.*")


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    found = decontamination.decontaminate(_carried(docs, "doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=["_row"])
    return found.where("not contaminated").select("_row.*")


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps all documents; what looks like a secret is replaced in the text."""
    found = secret_scan.secret_scan(_carried(docs, "doc_id", "text"), redacted=True, keep=["_row"])
    put = {"text": F.col("redacted")}
    if "n_chars" in docs.columns:
        put["n_chars"] = F.when(F.col("spans") == "", F.col("_row.n_chars")).otherwise(F.char_length("redacted").cast(docs.schema["n_chars"].dataType))
    return found.select(*[put.get(c, F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which the mix takes words: how many, and their columns, but those that have a name of the mix's own."""
    return mixing.mix(docs, keep=docs.columns).where("taken > 0")


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("benchmark_free", benchmark_free), ("without_secrets", without_secrets), ("mixed", mixed)]
#: SQL cannot express the learned rules, banding or tiling; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each one's result is a table that is dropped once the next is written, the operators' own tables with it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        with scoped():
            docs = scratch.table(stage(spark, docs, sf_dir), name)
        if k:
            scratch.drop(STAGES[k - 1][0])
    return docs
