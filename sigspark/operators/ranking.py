"""Exact ranks and exact top-n selections that never sort one group in one task.

A window over a whole group puts the group into one task. Here a group is cut
into buckets or ranges of the sort key first; their counts are small, running sums
say where each one starts, and only rows within one are sorted together.
"""
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigspark.functions.session import sized

HEX_DIGITS = 3  # 16**3 buckets per group for hashed keys


def _starts(counts: DataFrame, group: list[str]) -> DataFrame:
    """Running count before each bucket, and the group's total."""
    by_group = Window.partitionBy(*group)
    before = by_group.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).withColumn(
        "_total", F.sum("_n").over(by_group)
    )


def take_lowest(df: DataFrame, key: str, wanted, group: list[str] | None = None) -> DataFrame:
    """Keep, per group, the rows with the ``wanted`` lowest values of ``key``.

    ``key`` is a hex string that is unique within the group. ``wanted`` is a
    function from the group's row count (a column) to a column, or a table with
    the group columns and ``_wanted``. The cut value of each group is found from
    bucket counts plus a sort of the one bucket that the cut falls into, so the
    rows themselves are only filtered. The tables of edges and cuts have one row
    for each group; they are written, so that few are broadcast and no row moves.
    """
    constant = not group
    if constant:
        df, group = df.withColumn("_all", F.lit(0)), ["_all"]
    keyed = df.withColumn("_bucket", F.substring(F.col(key), 1, HEX_DIGITS))
    starts = _starts(keyed.groupBy(*group, "_bucket").agg(F.count("*").alias("_n")), group)
    if callable(wanted):
        starts = starts.withColumn("_wanted", wanted(F.col("_total")).cast("long"))
    else:
        starts = starts.join(wanted.select(*group, "_wanted"), group)
    cut_here = (F.col("_before") < F.col("_wanted")) & (F.col("_before") + F.col("_n") >= F.col("_wanted"))
    last = starts.filter((cut_here & (F.col("_wanted") < F.col("_total"))) | (F.col("_wanted") >= F.col("_total")))
    need = F.when(F.col("_wanted") < F.col("_total"), F.col("_wanted") - F.col("_before"))  # null: the whole group
    last = sized(last.select(*group, F.when(need.isNotNull(), F.col("_bucket")).alias("_bucket"), need.alias("_need")).distinct(), "edges")
    in_edge = keyed.select(*group, "_bucket", key).join(last.filter("_need IS NOT NULL"), [*group, "_bucket"])
    place = F.row_number().over(Window.partitionBy(*group, "_bucket").orderBy(key))
    cuts = in_edge.withColumn("_place", place).filter("_place = _need").select(*group, F.col(key).alias("_cut"))
    whole = last.filter("_need IS NULL").select(*group, F.lit("g").alias("_cut"))
    kept = df.join(sized(cuts.unionByName(whole), "cuts"), group).filter(F.col(key) <= F.col("_cut"))
    return kept.drop("_cut", "_all") if constant else kept.drop("_cut")


def number_rows(df: DataFrame, group: list[str], order: list[str], out: str = "row_index") -> DataFrame:
    """Zero-based position of each row in its group, ordered by ``order``.

    Rows are dealt out by ranges of the whole key, group and order, sorted inside
    a part and written with their place in it. A part of a group begins where the
    counts of its earlier parts end; there is one count for each part and group.
    So neither a large group nor one frequent value of the first column meets in a
    task; rows equal in the whole key do. Rows without the first order column come
    last. A null in a group column is a group like others.
    """
    keys = [*map(F.col, group), F.asc_nulls_last(order[0]), *map(F.col, order[1:])]
    within = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)  # the part's number stands above these bits
    laid = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    laid = sized(laid.withColumns({"_part": F.spark_partition_id(), "_nth": within}), "numbered")
    parts = laid.groupBy("_part", *group).agg(F.count(F.lit(1)).alias("_n"), F.min("_nth").alias("_first"))
    earlier = Window.partitionBy(*(group or [F.lit(0)])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0).cast("long")))
    starts = sized(starts.select(F.struct("_part", *group).alias("_key"), (F.col("_before") - F.col("_first")).alias("_shift")), "starts")
    same = [laid[c].eqNullSafe(starts["_key"][c]) for c in group]
    joined = laid.join(starts, reduce(Column.__and__, same, laid["_part"] == starts["_key"]["_part"]))
    return joined.withColumn(out, F.col("_nth") + F.col("_shift")).drop("_part", "_nth", "_key", "_shift")


def with_previous(df: DataFrame, group: list[str], index: str, value: str, out: str, chunk: int = 4096) -> DataFrame:
    """The value one position earlier, for rows already numbered in their group.

    Rows are windowed in chunks of positions; the last row of each chunk is
    copied into the next one, so no group has to fit into one task.
    """
    here = df.withColumn("_chunk", F.floor(F.col(index) / chunk)).withColumn("_copy", F.lit(False))
    border = here.filter(F.col(index) % chunk == chunk - 1).withColumn("_chunk", F.col("_chunk") + 1)
    both = here.unionByName(border.withColumn("_copy", F.lit(True)))
    window = Window.partitionBy(*group, "_chunk").orderBy(index)
    return both.withColumn(out, F.lag(value).over(window)).filter(~F.col("_copy")).drop("_chunk", "_copy")
