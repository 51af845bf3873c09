"""Readers and writers: CSV metadata, JSON, path lists, recording store, named splits, artefacts."""
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigspark.functions.json import decoded_json
from sigspark.sources import schemas


def read_csv(spark: SparkSession, path: str, schema: str, line_breaks: bool = True) -> DataFrame:
    """CSV with a header row and an explicit schema. Files without quoted line breaks can be split: ``line_breaks=False``."""
    return spark.read.schema(schema).options(header=True, multiLine=line_breaks, escape='"').csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").options(header=True, escape='"').csv(path)


def read_json(spark: SparkSession, path: str, schema: str, whole_file: bool = False) -> DataFrame:
    """JSON lines, or files that hold one array each (such a file cannot be split between tasks)."""
    return spark.read.schema(schema).option("multiLine", whole_file).json(path)


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines, split by partition."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def read_paths(spark: SparkSession, path: str) -> DataFrame:
    """One path per line; blanks are stripped, empty lines skipped."""
    lines = spark.read.text(path).select(F.regexp_replace("value", r"^\s+|\s+$", "").alias("path"))
    return lines.filter(F.length("path") > 0)


def write_paths(df: DataFrame, column: str, path: str) -> None:
    df.select(F.col(column).alias("value")).write.mode("overwrite").text(path)


def segment_key(path: Column, j: Column) -> Column:
    """Name of segment ``j`` of a recording: its path with ``/`` as ``_``, then the number."""
    return F.concat_ws("_", F.replace(path, F.lit("/"), F.lit("_")), j.cast("string"))


def stored_key(corpus: Column, path: Column, exam_id: Column, j: Column) -> Column:
    """As :func:`segment_key`; recordings of the exam-numbered corpus are named by exam."""
    return F.when(corpus == "code15", F.concat_ws("_", exam_id, j.cast("string"))).otherwise(segment_key(path, j))


def write_segments(df: DataFrame, path: str) -> None:
    """Parquet, partitioned so that a reader prunes by corpus and segment length; empty records are not written."""
    full = df.filter((F.size("ecg") > 0) & (F.size(F.col("ecg")[0]) > 0) & (F.length("report") > 0))
    full.write.mode("overwrite").partitionBy("base_data", "segment_len").parquet(path)


def read_segments(spark: SparkSession, path: str, base_data=None, segment_len: int | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    if base_data is not None:
        df = df.filter(F.col("base_data").isin([base_data] if isinstance(base_data, str) else list(base_data)))
    return df if segment_len is None else df.filter(F.col("segment_len") == segment_len)


def keyed_index(parts: DataFrame, key: str, part: str = "part", idx: str = "idx") -> DataFrame:
    """Last (part, idx) per key over all parts; keys are numbers that may be written with leading zeros or as bytes."""
    number = F.col(key).cast("string").cast("bigint").cast("string")
    latest = F.max(F.struct(part, idx)).alias("_last")
    return parts.groupBy(number.alias("key")).agg(latest).select("key", f"_last.{part}", f"_last.{idx}")


def file_stem(path: Column) -> Column:
    """Last path part up to its first dot."""
    return F.substring_index(F.substring_index(path, "/", -1), ".", 1)


def file_name_index(paths: DataFrame, path: str = "path") -> DataFrame:
    """(stem, path): one path per stem, the last in path order."""
    return paths.groupBy(file_stem(F.col(path)).alias("stem")).agg(F.max(path).alias("path"))


def list_files(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """Paths below a folder; the content of the files is not read."""
    return (
        spark.read.format("binaryFile").options(pathGlobFilter=glob, recursiveFileLookup=True).load(folder).select("path")
    )


def number_pair(path: Column) -> Column:
    """The first ``a_b`` of two numbers in the file name; null if there is none."""
    name = F.substring_index(path, "/", -1)
    part = lambda i: F.regexp_extract(name, r"(\d+)_(\d+)", i)
    found = F.struct(part(1).cast("bigint").alias("a"), part(2).cast("bigint").alias("b"))
    return F.when(part(1) != "", found)


def align_files(signals: DataFrame, texts: DataFrame, path: str = "path") -> DataFrame:
    """(a, b, signal, text) for number pairs present on both sides; of equal pairs the last path counts."""

    def last(df, name):
        keyed = df.withColumn("_k", number_pair(F.col(path))).filter(F.col("_k").isNotNull())
        return keyed.groupBy(F.col("_k.a").alias("a"), F.col("_k.b").alias("b")).agg(F.max(path).alias(name))

    return last(signals, "signal").join(last(texts, "text"), ["a", "b"])


def json_text(value: Column) -> Column:
    """Compact JSON, non-ASCII characters kept."""
    return F.to_json(value, {"ignoreNullFields": "false"})


def with_decoded(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``decoded`` (VARIANT) if the text is valid JSON and ``raw`` if it is not."""
    decoded = df.withColumn("decoded", decoded_json(F.col(text)))
    return decoded.withColumn("raw", F.when(F.col("decoded").isNull(), F.col(text)))


def write_splits(df: DataFrame, path: str) -> None:
    """Rows (dataset, fold, split, ecg_path, text, name), partitioned by the first three."""
    columns = [F.col(c).cast("string") for c in ("ecg_path", "text", "name")]
    out = df.select("dataset", "fold", "split", *columns)
    out.write.mode("overwrite").partitionBy("dataset", "fold", "split").parquet(path)


def read_split(spark: SparkSession, path: str, dataset=None, fold: int | None = None, split: str | None = None) -> DataFrame:
    """Only the folders of the named split are listed and read."""
    df = spark.read.parquet(path)
    for column, value in (("dataset", dataset), ("fold", fold), ("split", split)):
        if value is not None:
            df = df.filter(F.col(column) == value)
    return df


def write_tokenizer(vocab: DataFrame, merges: DataFrame, path: str) -> None:
    vocab.write.mode("overwrite").parquet(f"{path}/vocab")
    merges.write.mode("overwrite").parquet(f"{path}/merges")


def read_tokenizer(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    vocab = spark.read.schema(schemas.VOCAB).parquet(f"{path}/vocab")
    return vocab, spark.read.schema(schemas.MERGES).parquet(f"{path}/merges")


def write_token_vectors(df: DataFrame, path: str) -> None:
    df.select("token_id", "vector", "freq").write.mode("overwrite").parquet(path)


def read_token_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.TOKEN_VECTORS).parquet(path)
