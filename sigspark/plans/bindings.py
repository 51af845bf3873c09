"""Views that present the given tables as recordings, conversations, pairs and so on."""
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigspark.functions.arrays import let, unrolled
from sigspark.functions.session import spread
from sigspark.operators import ranking

LEADS, SAMPLES = 4, 16
SEGMENT = 32
EPOCH_START = 1704067200  # 2024-01-01 UTC, the first day of the events table


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings of 4 leads x 16 samples from the embedding vectors."""
    vectors = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("rec_id"), "label", F.col("embedding").cast("array<double>").alias("v")
    )
    leads = [F.slice("v", lead * SAMPLES + 1, SAMPLES) for lead in range(LEADS)]
    return spread(vectors, "rec_id").select("rec_id", "label", F.array(*leads).alias("ecg"))


REC = """
rec AS (SELECT vec_id AS rec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
samples AS (SELECT rec_id, label, (i // 16)::INT AS lead, (i % 16)::INT AS s, v[i + 1] AS x
            FROM rec, range(64) t(i))"""


def stream_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-lead recordings of any length: samples of each user in time order, numbered from 0."""
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("rec_id"), "ts", "event_id", "value")
    return ranking.number_rows(events, ["rec_id"], ["ts", "event_id"], "s")


STREAM = """
stream AS (SELECT user_id AS rec_id, ts, event_id, value,
                  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS s FROM events)"""


def stream_segments(spark: SparkSession, sf_dir: str, length: int = SEGMENT) -> DataFrame:
    """All samples of the one-lead recordings as arrays of at most ``length``; the last of a recording may be shorter."""
    from sigspark.operators.signal import segment_samples

    return segment_samples(stream_samples(spark, sf_dir), "rec_id", "s", "value", length, rest=True)


SEGMENTS = STREAM + f""",
seg_samples AS (SELECT rec_id, s // {SEGMENT} AS seg, (s % {SEGMENT})::INT AS i, value AS x,
                       count(*) OVER (PARTITION BY rec_id, s // {SEGMENT}) AS n FROM stream),
segs AS (SELECT rec_id, seg, i, x, n FROM seg_samples)"""


def conv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per conversation, turns in order."""
    turn = F.struct("turn", F.col("role").alias("from"), F.col("text").alias("value"))
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("t"))
    return turns.select(
        "conv_id", F.transform("t", lambda x: F.struct(x["from"].alias("from"), x["value"].alias("value"))).alias("conversations")
    )


WHITESPACE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference = the whole text, hypothesis = the text without every word whose index % 7 is 3."""
    words = F.filter(F.split("text", r"(?U)[\s\x1c-\x1f]+"), lambda w: w != "")
    texts = let(
        words,
        lambda w: F.struct(
            F.array_join(w, " ").alias("ref"), F.array_join(F.filter(w, lambda x, i: i % 7 != 3), " ").alias("hyp")
        ),
    )
    docs = spread(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pair_id"), "text"), "pair_id")
    # Unrolled from a list of one, so that filters on the texts do not compute them again.
    return unrolled(docs, ["pair_id"], F.array(texts), "p").select("pair_id", "p.ref", "p.hyp")


PAIR = rf"""
words AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '{WHITESPACE}'), lambda w: w <> '') AS w FROM documents),
pair AS (SELECT doc_id AS pair_id, w AS r, list_filter(w, lambda x, i: (i - 1) % 7 <> 3) AS h FROM words)"""


def feats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two feature spaces per row: the two halves of each vector, each of unit length."""
    from sigspark.operators.alignment import l2_normalised

    v = F.col("embedding").cast("array<double>")
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"),
        l2_normalised(F.slice(v, 1, 32)).alias("a"),
        l2_normalised(F.slice(v, 33, 32)).alias("b"),
    )


FEATS = """
halves AS (SELECT vec_id AS id, list_transform(embedding[1:32], lambda x: x::DOUBLE) AS a0,
                  list_transform(embedding[33:64], lambda x: x::DOUBLE) AS b0 FROM embeddings),
feats AS (SELECT id, list_transform(a0, lambda x: x / greatest(sqrt(list_sum(list_transform(a0, lambda y: y * y))), 1e-12)) AS a,
                 list_transform(b0, lambda x: x / greatest(sqrt(list_sum(list_transform(b0, lambda y: y * y))), 1e-12)) AS b
          FROM halves)"""
