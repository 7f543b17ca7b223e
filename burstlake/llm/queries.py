"""The queries of this subpackage, over the tables in ``sf_dir``."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, lm, mixing, ngram_join, personal_data, quality_rules, secret_scan, substring_dedup, token_counts, warc
from .shared import Scratch


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _tokenizer_file() -> str:
    if found := os.environ.get("BURSTLAKE_TOKENIZER"):
        return found
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_warc(spark, sf_dir):
    scratch = Scratch(spark, "warc")
    warc.write_warc(_read(spark, sf_dir, "pages"), scratch.path("archive"), scratch)
    return warc.read_warc(spark, scratch.path("archive"), scratch)


def op2_lm(spark, sf_dir):
    return lm.score_held_out(_read(spark, sf_dir, "documents"))


def op3_quality(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    rules = quality_rules.fit(docs, _read(spark, sf_dir, "labels"))
    got = quality_rules.quality_rules(docs, rules)
    return got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op4_ngram_join(spark, sf_dir):
    return ngram_join.ngram_join(_read(spark, sf_dir, "documents"))


def op5_substring(spark, sf_dir):
    return substring_dedup.substring_dedup(_read(spark, sf_dir, "documents"))


def op6_mixing(spark, sf_dir):
    return mixing.mix(_read(spark, sf_dir, "documents"))


def op7_tokens(spark, sf_dir):
    return token_counts.token_counts(_read(spark, sf_dir, "documents"), _tokenizer_file())


def op8_secrets(spark, sf_dir):
    return secret_scan.secret_scan(_read(spark, sf_dir, "documents"))


def op9_personal(spark, sf_dir):
    return personal_data.personal_data(_read(spark, sf_dir, "documents"))


def op10_decontaminate(spark, sf_dir):
    return decontamination.decontaminate(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_warc, op2_lm, op3_quality, op4_ngram_join, op5_substring, op6_mixing, op7_tokens, op8_secrets, op9_personal, op10_decontaminate)}
ORACLES: dict[str, str] = {}
