"""Instruction data mapped onto stored segments."""
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Test sets of the mixed benchmark and the corpus each belongs to.
BENCHMARK_CORPUS = {
    "ecgqa-test": "ptb",
    "ptb-test-report": "ptb",
    "ptb-test": "ptb",
    "cpsc-test": "cpsc",
    "csn-test-no-cot": "csn",
    "code15-test": "code15",
}
LIST_VALUED = ["ecgqa-test"]


def parts_of(path: Column) -> Column:
    return F.split(path, "/")


def joined_from(path: Column, start: int) -> Column:
    """Path parts from a zero-based position on, joined by ``_``."""
    return F.array_join(F.slice(parts_of(path), start + 1, F.size(parts_of(path))), "_")


def folder(corpus: Column, segment_len: int, sf: int) -> Column:
    return F.concat(F.lit("./data/"), corpus, F.lit(f"/preprocessed_{segment_len}_{sf}"))


def chat_key(path: Column) -> Column:
    return F.replace(path, F.lit("/"), F.lit("_"))


def qa_key(paths: Column) -> Column:
    """From the first path, without its two leading parts."""
    return joined_from(paths[0], 2)


def qa_text(kind: Column, question: Column, answer: Column) -> Column:
    return F.array(kind, question, answer)


def _thousand_folder(number: Column) -> Column:
    return F.concat(F.lit("records500_"), F.substring(number, 1, 2), F.lit("000_"), number)


def benchmark_key(name: Column, file_name: Column, looked_up: Column) -> Column:
    """Segment key by test set; ``looked_up`` is the path found in the file-name index."""
    return (
        F.when(name.isin("ecgqa-test", "ptb-test-report", "ptb-test"), _thousand_folder(file_name))
        .when(name.isin("cpsc-test", "csn-test-no-cot"), chat_key(looked_up))
        .when(name == "code15-test", F.substring_index(file_name, "-", 1))
    )


def with_benchmark_key(items: DataFrame, index: DataFrame) -> DataFrame:
    """Adds ``key``; only the two test sets that need the file index can match it."""
    listed = index.select(F.col("stem").alias("file_name"), F.col("path").alias("_found"))
    joined = items.join(listed, "file_name", "left")
    return joined.withColumn("key", benchmark_key(F.col("name"), F.col("file_name"), F.col("_found"))).drop("_found")


def image_key(image: Column) -> tuple[Column, Column]:
    """(corpus, key) of an image path; its first part names the corpus."""
    p = parts_of(image)
    kind, file = p[0], F.element_at(p, -1)
    stem = F.substring_index(file, "-", 1)
    middle = F.slice(p, 2, F.greatest(F.size(p) - 2, F.lit(0)))
    number = F.concat(F.substring_index(file, "_", 1), F.lit("_hr"))
    corpus = F.when(kind.isin("mimic_v4", "mimic"), "mimic").when(kind == "ptb-xl", "ptb").when(kind == "code15_v4", "code15")
    key = (
        F.when(corpus == "mimic", F.concat(F.lit("files_"), F.array_join(F.concat(middle, F.array(stem)), "_")))
        .when(corpus == "ptb", _thousand_folder(number))
        .when(corpus == "code15", stem)
    )
    return corpus, key


def grounding_key(path: Column) -> tuple[Column, Column]:
    """(corpus, key) of a grounding path."""
    p = parts_of(path)
    corpus = (
        F.when(p[0] == "mimic-iv", "mimic").when(p[0] == "ecg_ptbxl_benchmarking", "ptb").when(p[0] == "code15", "code15")
    )
    key = (
        F.when(corpus == "mimic", joined_from(path, 1))
        .when(corpus == "ptb", joined_from(path, 3))
        .when(corpus == "code15", F.element_at(p, -1))
    )
    return corpus, key


def segment_names(segments: DataFrame, stem: str = "stem") -> DataFrame:
    """Available segments as (key, seg_idx): the number after the last ``_`` and all before it."""
    s = F.col(stem)
    number = F.regexp_extract(s, r"_(0|[1-9][0-9]{0,8})$", 1)
    cut = s.substr(F.lit(1), F.length(s) - F.length(number) - 1)
    return segments.filter(number != "").select(cut.alias("key"), number.cast("int").alias("seg_idx")).distinct()


def _below(segments: DataFrame, max_segments: int | None) -> DataFrame:
    return segments if max_segments is None else segments.filter(F.col("seg_idx") < max_segments)


def map_instances(instances: DataFrame, segments: DataFrame, segment_len: int, sf: int, max_segments: int | None = None) -> DataFrame:
    """(inst_id, seg_idx, ecg_path, text, name): one row per available segment of each instance.

    One equi-join on the recording key. A recording has any number of segments
    unless ``max_segments`` says how many are looked up.
    """
    hits = instances.join(_below(segments, max_segments), "key")
    file = F.concat(F.col("key"), F.lit("_"), F.col("seg_idx"), F.lit(".npy"))
    path = F.concat_ws("/", folder(F.col("corpus"), segment_len, sf), file)
    return hits.select("inst_id", "seg_idx", path.alias("ecg_path"), "text", F.coalesce("name", F.lit("")).alias("name"))


def mapping_audit(instances: DataFrame, segments: DataFrame, max_segments: int | None = None) -> DataFrame:
    """Instances, available segments, mapped rows, instances without a segment: from counts per key only."""
    per_instance = instances.groupBy("key").agg(F.count("*").alias("i"))
    per_segment = _below(segments, max_segments).groupBy("key").agg(F.count("*").alias("s"))
    both = per_instance.join(per_segment, "key", "full").na.fill(0, ["i", "s"])
    return both.agg(
        F.sum("i").alias("instances"),
        F.sum("s").alias("segments"),
        F.sum(F.col("i") * F.col("s")).alias("valid"),
        F.sum(F.when(F.col("s") == 0, F.col("i")).otherwise(0)).alias("unmatched"),
    )


def flat_values(name: Column, values: Column) -> Column:
    """Whole turn values from their pieces: joined without a space in the sets with list values, else with the space they had."""
    return F.when(name.isin(LIST_VALUED), F.array_join(values, "")).otherwise(F.array_join(values, " "))


def assembled(sources: dict[str, DataFrame]) -> DataFrame:
    """Union of sources, each tagged by ``name``."""
    return reduce(DataFrame.unionByName, [df.withColumn("name", F.lit(name)) for name, df in sources.items()])


def answer_text(answers: Column) -> Column:
    return F.array_join(answers, " ")


def category_counts(df: DataFrame, category: str) -> DataFrame:
    return df.groupBy(category).agg(F.count("*").alias("n"))


def category_samples(df: DataFrame, category: str, order: str, k: int = 5) -> DataFrame:
    """First ``k`` rows of each category; rows beyond them are dropped before the shuffle."""
    place = F.row_number().over(Window.partitionBy(category).orderBy(order))
    return df.withColumn("place", place).filter(F.col("place") <= k)
