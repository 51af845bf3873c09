"""Contiguous shards of near equal size, cut from global prefix sums."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigspark.llm.common import ranked


def byte_size(text: Column) -> Column:
    """UTF-8 bytes plus one; null has no bytes."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def assign(rows: DataFrame, order: list[str], size: str, shards: int) -> DataFrame:
    """Adds ``shard`` and ``slot`` to rows of ``order`` columns and a positive long ``size``.

    The sizes, laid end to end in the order, are cut at equal targets; a row
    goes to the shard in which its middle lies, so a shard misses its target by
    the size of one row at most. Slots count from 0 without gaps.

    Nulls in the order come first and count as one value. Rows equal in all
    order columns stay together in an unspecified order. An empty table gives
    an empty result; shards may be empty when there are fewer rows than shards.
    """
    placed = ranked(rows, order, size).withColumn(
        "shard", F.expr(f"least({shards - 1}, ((2 * _before + {size}) * {shards}) div (2 * _total))").cast("int")
    )
    # One row for each shard.
    first = placed.groupBy("shard").agg(F.min("_rank").alias("_first"))
    placed = placed.join(F.broadcast(first), "shard")
    return placed.select(*rows.columns, "shard", (F.col("_rank") - F.col("_first")).alias("slot"))


def sharded(docs: DataFrame, shards: int = 16) -> DataFrame:
    """Shard and slot of every document in the order of ``doc_id``.

    Needs ``doc_id`` and ``text``; other columns are not read. Null and empty
    texts have size 1. Documents of one doc_id are ordered by checksum and size.
    """
    rows = docs.select(
        "doc_id", byte_size(F.col("text")).alias("size"), F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32")
    )
    return assign(rows, ["doc_id", "text_crc32", "size"], "size", shards)


def write(docs: DataFrame, path: str, shards: int = 16) -> None:
    """The documents themselves, a folder for each shard, in slot order inside a file."""
    keys = ["doc_id", "text_crc32", "size"]
    own = docs.select(
        F.struct("*").alias("row"), "doc_id", F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
        byte_size(F.col("text")).alias("size"),
    )
    places = sharded(docs, shards).groupBy(*keys).agg(F.min("shard").alias("shard"), F.min("slot").alias("slot"))
    out = own.join(places, [own[k].eqNullSafe(places[k]) for k in keys]).select("row.*", "shard", "slot")
    out.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
