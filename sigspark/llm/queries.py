"""Queries of this subpackage and their SQL."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigspark.llm import alignment, audio, bpe, language, licenses, mixing, quality, repair, search, sharding, simhash, suffix, warc
from sigspark.llm.common import table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hexadecimal(F.col("fps")[0]).alias("fingerprint"), "component_id")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.sharded(table(spark, sf_dir, "documents"), 16)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op3_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.digests(suffix.deduplicated(table(spark, sf_dir, "documents")))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.mixed(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return rows.select(
        "doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"),
        (F.col("_size") * F.col("_times")).alias("taken"),
    )


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.round_trip(table(spark, sf_dir, "pages"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.decode(bpe.encode(table(spark, sf_dir, "documents"))))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    filters = language.learn(docs.filter(~language.held_out(F.col("doc_id"))))
    said = language.predict(docs, filters)
    return said.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op9_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.digests(audio.read_media(audio.to_media(table(spark, sf_dir, "documents"))))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.scored(docs, table(spark, sf_dir, "labels")).drop("text")


def op11_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(search.build(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.round_trip(table(spark, sf_dir, "documents"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_simhash, op2_sharding, op3_suffix, op4_mixing, op5_warc, op6_bpe, op7_licenses, op8_language, op9_audio, op10_quality,
        op11_search, op12_repair, op13_alignment,
    )
}
ORACLES = {"op4_mixing": mixing.SQL, "op11_search": search.SQL}
