"""Helpers that several operators of this subpackage share."""
from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sigspark.functions.session import scratch_path

#: Separators of words: space and the control characters from tab to carriage return.
BLANKS = r"[\x20\x09-\x0D]+"
DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, stem: str) -> DataFrame:
    """Written to the shared folder and read again: later steps start from the files, not from the plan."""
    path = scratch_path(df.sparkSession, stem)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANKS), lambda w: w != "")


def as_bytes(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """UTF-8 of a text column; null counts as empty."""
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


def record(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)


def ranked(rows: DataFrame, order: list[str], amount: str) -> DataFrame:
    """Global prefix sums: adds ``_before`` (sum of ``amount`` over all earlier rows), ``_rank`` (from 0) and ``_total``.

    Rows are dealt out by ranges of the order and stored with the number of
    their part. The totals of the parts, one row for each, are summed up; the
    sum inside a part is a window over that part. No task sees all rows.
    """
    laid = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    laid = stored(laid.withColumn("_part", F.spark_partition_id()), "ranked")
    totals = laid.groupBy("_part").agg(F.sum(amount).alias("_sum"), F.count(F.lit(1)).alias("_rows"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    offsets = totals.select(
        "_part",
        F.coalesce(F.sum("_sum").over(earlier), zero).alias("_part_before"),
        F.coalesce(F.sum("_rows").over(earlier), zero).alias("_part_rank"),
        F.sum("_sum").over(Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_total"),
    )
    inside = Window.partitionBy("_part").orderBy(*order)
    before = F.coalesce(F.sum(amount).over(inside.rowsBetween(Window.unboundedPreceding, -1)), zero)
    out = laid.withColumn("_inside", before).withColumn("_nth", F.row_number().over(inside) - 1)
    # One row for each part, as many as tasks wrote: small whatever the number of rows.
    out = out.join(F.broadcast(offsets), "_part")
    return out.select(
        *rows.columns, (F.col("_part_before") + F.col("_inside")).alias("_before"),
        (F.col("_part_rank") + F.col("_nth")).alias("_rank"), "_total",
    )
