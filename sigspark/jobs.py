"""The main entry points as chains of operators: build a store, map instructions, publish folds, train a tokenizer, score.

Each job declares one plan per written table and leaves the execution to Spark.
"""
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigspark.operators import bpe, mapping, scoring, signal, splits
from sigspark.sources import tables


def segments(recordings: DataFrame, target_sf: int, segment_len: int, rules: dict = signal.ADMISSION) -> DataFrame:
    """Stored segments of admitted recordings: reordered, resampled, cut and repaired. One narrow pass, no shuffle."""
    admitted, _ = signal.admit(recordings, rules)
    ready = admitted.withColumn("ecg", signal.reordered(F.col("ecg"), F.col("base_data")))
    ready = ready.withColumn("ecg", signal.resampled(target_sf))
    cut = signal.segment_recordings(ready, segment_len)
    clean = cut.withColumn("ecg", signal.repaired_recording(F.col("ecg")).cast("array<array<float>>"))
    key = tables.stored_key(F.col("base_data"), F.col("path"), F.col("rec_id"), F.col("seg_idx"))
    return clean.select(
        key.alias("segment_key"), "rec_id", "base_data", "seg_idx", F.lit(segment_len).alias("segment_len"),
        F.lit(target_sf).alias("target_sf"), "orig_sf", "report", "path", "ecg",
    )


def build_store(recordings: DataFrame, out: str, target_sf: int, segment_len: int, rules: dict = signal.ADMISSION) -> DataFrame:
    """Writes the store and returns processed and skipped recordings per corpus."""
    tables.write_segments(segments(recordings, target_sf, segment_len, rules), out)
    return signal.admission_counts(recordings, rules)


def map_to_store(instances: DataFrame, store: DataFrame, segment_len: int, target_sf: int) -> DataFrame:
    """Instances (inst_id, corpus, key, text, name) joined with the segments the store holds."""
    stems = store.filter(F.col("segment_len") == segment_len).select(F.col("segment_key").alias("stem"))
    return mapping.map_instances(instances, mapping.segment_names(stems), segment_len, target_sf)


def publish_folds(mapped: DataFrame, out: str, dataset: str, folds: int = 5, seed: int = 42, train_ratio: float = 0.7) -> DataFrame:
    """Writes patient-safe folds and returns the leak count of each, which must be zero."""
    row = F.concat_ws(":", "inst_id", "seg_idx")
    patients = mapped.select("ecg_path", "text", "name", row.alias("row"), splits.patient_of(F.col("ecg_path")).alias("patient"))
    split = splits.grouped_split(patients, "row", "patient", train_ratio, seed, folds)
    tables.write_splits(split.withColumn("dataset", F.lit(dataset)), out)
    leaks = splits.leaking_groups(split, "patient")
    checked = F.when(F.col("leaking") > 0, F.raise_error(F.lit("patient overlap")).cast("bigint")).otherwise(F.col("leaking"))
    return leaks.withColumn("leaking", checked)


def symbol_corpus(store: DataFrame, n: int | None = None, seed: int = 42) -> DataFrame:
    """(segment_key, symbols) of all or ``n`` sampled segments; broken ones are left out."""
    whole = store.filter(signal.broken_samples(F.col("ecg")) == 0)
    picked = whole if n is None else splits.sample_rows(whole, "segment_key", n, seed)
    doubles = picked.withColumn("ecg", F.col("ecg").cast("array<array<double>>"))
    coded = signal.with_normalised(doubles).select("segment_key", signal.symbolised(F.col("norm")).alias("symbols"))
    return coded.filter(F.length("symbols") > 0)


def train_tokenizer(store: DataFrame, out: str, merges: int, n: int | None = None, seed: int = 42) -> DataFrame:
    """Learns and writes a vocabulary; returns it."""
    corpus = symbol_corpus(store, n, seed)
    if corpus.limit(1).isEmpty():
        raise ValueError("no valid recordings")
    learned = bpe.train(corpus, "symbols", merges)
    spark: SparkSession = store.sparkSession
    vocab = bpe.byte_vocabulary(spark, learned)
    tables.write_tokenizer(vocab, learned, out)
    return vocab


def evaluate(generated: DataFrame) -> DataFrame:
    """Statistics over seeds of all scores, from (seed, pair_id, ref, hyp)."""
    return scoring.seed_statistics(scoring.report(generated, by=("seed",)))
