"""The queries op1_ ... op10_ with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, decontaminate, lm, pii, secrets, simhash, tokenfiles, toxicity, urls
from .common import documents, new_folder


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(documents(spark, sf_dir))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_idfiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = new_folder(spark, "idfiles")
    tokenfiles.write(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), folder, end_id=2)
    return tokenfiles.read(spark, folder)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(documents(spark, sf_dir))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(documents(spark, sf_dir))


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(documents(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(documents(spark, sf_dir, "pages"), urls.RULES)


def op10_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.report(documents(spark, sf_dir))


_QUERIES = [op1_bpe, op2_simhash, op3_idfiles, op4_toxicity, op5_decontaminate, op6_secrets, op7_pii, op8_ann, op9_urls, op10_lm]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: q for q in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op5_decontaminate": decontaminate.SQL, "op9_urls": urls.SQL}
