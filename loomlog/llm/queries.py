"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomlog.llm import binary, language, licences, mixing, neighbours, packing, quality, secrets, simhash, urls
from loomlog.llm.shared import scratch, table


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents")))


def op5_binary_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "tokens")
    binary.write_tokens(table(spark, sf_dir, "documents"), path)
    return binary.read_tokens(spark, path)


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.predict(docs, *language.learn(docs))


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), every=20)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.judged(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


QUERIES = {"op1_packing": op1_packing, "op2_mixing": op2_mixing, "op3_simhash": op3_simhash, "op4_secrets": op4_secrets, "op5_binary_output": op5_binary_output, "op6_licenses": op6_licenses, "op7_urls": op7_urls, "op8_language": op8_language, "op9_neighbours": op9_neighbours, "op10_quality": op10_quality}
ORACLES: dict[str, str] = {"op2_mixing": mixing.oracle(), "op4_secrets": secrets.oracle(), "op6_licenses": licences.oracle(), "op7_urls": urls.oracle()}
