"""Preparation of metadata tables: columns in, columns out, joins left to the optimiser."""
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

REPORT_COLUMNS = [f"report_{i}" for i in range(18)]
QUESTION_TYPES = ["single-verify", "single-choose", "single-query"]


def select_renamed(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Keep the named columns under new names."""
    return df.select(*[F.col(old).alias(new) for old, new in columns.items()])


def joined_text(columns: list[str]) -> Column:
    """Values of a row joined by one space, nulls left out."""
    return F.concat_ws(" ", *[F.col(c).cast("string") for c in columns])


def drop_if_all_null(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.na.drop("all", subset=columns)


def drop_if_any_null(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return df.na.drop("any", subset=columns)


def null_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows kept and rows dropped by :func:`drop_if_any_null`."""
    any_null = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns or df.columns])
    return df.agg(F.count_if(~any_null).alias("kept"), F.count_if(any_null).alias("dropped"))


def measured_reports(records: DataFrame, measurements: DataFrame, columns: list[str] = REPORT_COLUMNS) -> DataFrame:
    """(path, report): records with at least one machine report, joined on subject and study."""
    some = drop_if_all_null(measurements, columns)
    reports = some.select("subject_id", "study_id", joined_text(columns).alias("report"))
    return records.join(reports, ["subject_id", "study_id"]).select("path", "report")


def first_rows(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """First ``n`` rows in an explicit order, for trial runs."""
    return df.orderBy(*order).limit(n)


def image_key(path: Column) -> Column:
    """Last path part up to the first ``-``."""
    return F.substring_index(F.substring_index(path, "/", -1), "-", 1)


def enriched(items: DataFrame, index: DataFrame, path: str = "image_path") -> DataFrame:
    """Items whose key is in the index, with the indexed path; items without a match are left out."""
    keyed = items.withColumn("orig_file_name", image_key(F.col(path)))
    return keyed.join(index.withColumnRenamed("stem", "orig_file_name"), "orig_file_name")


def on_text(text: Column, f) -> Column:
    """``f`` on non-blank text, the empty string otherwise."""
    return F.when(F.length(F.trim(text)) > 0, f(text)).otherwise(F.lit(""))


def require_text(df: DataFrame, text: str) -> DataFrame:
    """Fail when the table has no row with text; one pass that stops at the first hit."""
    if df.filter(F.length(F.trim(text)) > 0).limit(1).isEmpty():
        raise ValueError("all input texts are empty")
    return df


def first_occurrences(df: DataFrame, key: Column, order: str) -> DataFrame:
    """(key, first value of ``order``): combined before the shuffle, so a hot key costs no more than others."""
    return df.groupBy(key.alias("key")).agg(F.min(order).alias(order))


def question_files(tables: dict[str, DataFrame], kinds: list[str] = QUESTION_TYPES, column="question_type") -> DataFrame:
    """Union of files in name order (``file_order``), restricted to some question types before the union."""
    parts = [
        df.filter(F.col(column).isin(kinds)).withColumn("file", F.lit(name)).withColumn("file_order", F.lit(i))
        for i, (name, df) in enumerate(sorted(tables.items()))
    ]
    return reduce(DataFrame.unionByName, parts)


def mixed(tables: dict[str, DataFrame]) -> DataFrame:
    """Concatenation of datasets, tagged by name."""
    return reduce(DataFrame.unionByName, [df.withColumn("dataset", F.lit(name)) for name, df in tables.items()])


def mix_summary(df: DataFrame) -> DataFrame:
    """Rows per dataset, the total, and the segment length named after the last ``_``."""
    counts = df.groupBy("dataset").agg(F.count("*").alias("n"))
    length = F.substring_index("dataset", "_", -1).try_cast("int")
    every = Window.partitionBy(F.lit(0))
    return counts.select("dataset", "n", length.alias("segment_len"), F.sum("n").over(every).alias("total"))


def moved_path(path: Column, root: str, old: str = "./data") -> Column:
    """Stored paths read from another root."""
    return F.replace(path, F.lit(old), F.lit(root))


def or_empty(name: Column) -> Column:
    return F.coalesce(name, F.lit(""))
