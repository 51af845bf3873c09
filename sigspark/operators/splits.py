"""Patient-safe train/test splits and samples; every choice is a hash of (seed, id)."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigspark.functions.hashing import hash_hex
from sigspark.functions.session import sized
from sigspark.operators.ranking import take_lowest

HEAVY = 1000  # a group of more than this part of all rows is large


def corpus_of(path: Column) -> Column:
    """Path part after the first part named ``data``; empty if there is none."""
    parts = F.split(F.regexp_replace(path, r"^(\./)+|(?<=/)(\./)+|(?<=/)/+", ""), "/")
    place = F.array_position(parts, "data")
    return F.lower(F.coalesce(F.when(place > 0, F.get(parts, place.cast("int"))), F.lit("")))


def patient_of(path: Column) -> Column:
    """Patient of a recording path: the longest ``p<digits>`` or the record number, by corpus; else null."""
    runs = F.regexp_extract_all(path, F.lit(r"(p\d+)"), F.lit(1))
    longest = F.aggregate(runs, F.lit(""), lambda best, r: F.when(F.length(r) > F.length(best), r).otherwise(best))
    record = F.regexp_extract(path, r"_([0-9]+)_hr", 1)
    corpus = corpus_of(path)
    found = F.when(corpus == "mimic", longest).when(corpus == "ptb", record)
    return F.when(F.length(found) > 0, found)


def _greedy_takes(sizes: list, target: int) -> list[tuple[int, int]]:
    """How many groups of each size fit, largest first."""
    left, takes = target, []
    for size, groups in sorted(sizes, reverse=True):
        taken = min(groups, left // size)
        takes.append((size, taken))
        left -= taken * size
    return takes


def grouped_split(
    df: DataFrame, row: str, group: str, train_ratio: float = 0.7, seed: int = 42, folds: int = 1
) -> DataFrame:
    """Adds (fold, split): whole groups go to train or test, rows with a null group stand alone.

    Groups in order of falling size go to train while they fit into
    round(n * ratio). With sizes sorted, only the number of groups of each size
    matters, so the greedy walk runs over the size histogram. Its distinct sizes
    number at most sqrt(2n). Which groups of a size go to train is decided by hash,
    a fresh one per fold, without sorting a whole size class in one task. Groups
    of more than a HEAVY-th of all rows are few; their rows meet their side by a
    broadcast and are dealt out by row, so no task gets a whole large group.
    """
    # The prefixes keep a stand-alone row apart from a group with the same name.
    identity = F.when(F.col(group).isNotNull(), F.concat(F.lit("g"), F.col(group))).otherwise(
        F.concat(F.lit("r"), F.col(row))
    )
    keyed = df.withColumn("_group", identity)
    groups = sized(keyed.groupBy("_group").agg(F.count("*").alias("_size")), "groups")
    histogram = [(r["_size"], r["n"]) for r in groups.groupBy("_size").agg(F.count("*").alias("n")).collect()]
    total = sum(size * n for size, n in histogram)
    takes = _greedy_takes(histogram, round(total * train_ratio))
    wanted = df.sparkSession.createDataFrame(
        [(k + 1, size, n) for k in range(folds) for size, n in takes], "fold int, _size bigint, _wanted bigint"
    )
    per_fold = groups.withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(folds))))
    hashed = F.concat(F.md5(F.concat(F.lit(seed - 1) + F.col("fold"), F.lit(":"), F.col("_group"))), F.lit(":"), F.col("_group"))
    train = take_lowest(per_fold.withColumn("_hash", hashed), "_hash", wanted, ["fold", "_size"]).select("fold", "_group")
    in_train = train.groupBy("_group").agg(F.collect_set("fold").alias("_train"))
    large = groups.filter(F.col("_size") > max(1, total // HEAVY)).join(in_train, "_group", "left")
    large = sized(large.select("_group", F.coalesce("_train", F.array().cast("array<int>")).alias("_of_large")), "large_groups")
    apart = keyed.join(large, "_group", "left")
    # A large group's rows have their side; where they go does not matter, as long as they do not go together.
    place = F.when(F.col("_of_large").isNull(), F.col("_group")).otherwise(F.concat(F.lit("x"), F.xxhash64(row).cast("string")))
    joined = apart.withColumn("_group", place).join(in_train, "_group", "left")
    marked = joined.withColumn("_train", F.coalesce("_of_large", "_train")).drop("_of_large")
    marked = marked.withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(folds))))
    is_train = F.coalesce(F.array_contains("_train", F.col("fold")), F.lit(False))
    return marked.withColumn("split", F.when(is_train, "train").otherwise("test")).drop("_group", "_train")


def leaking_groups(split: DataFrame, group: str) -> DataFrame:
    """Groups found in train and in test, counted per fold; zero for a safe split."""
    sides = split.filter(F.col(group).isNotNull()).groupBy("fold", group).agg(
        F.max(F.when(F.col("split") == "train", 1).otherwise(0)).alias("tr"),
        F.max(F.when(F.col("split") == "test", 1).otherwise(0)).alias("te"),
    )
    return sides.groupBy("fold").agg(F.sum(F.col("tr") * F.col("te")).alias("leaking"), F.count("*").alias("groups"))


def _ordered_hash(seed, row: str) -> Column:
    return F.concat(hash_hex(seed, row), F.lit(":"), F.col(row))


def sample_rows(df: DataFrame, row: str, n: int, seed=42) -> DataFrame:
    """min(n, all) rows without replacement."""
    return take_lowest(df.withColumn("_hash", _ordered_hash(seed, row)), "_hash", lambda total: F.least(F.lit(n), total)).drop("_hash")


def sample_fraction(df: DataFrame, row: str, fraction: float, seed=42, at_least: int = 0) -> DataFrame:
    """int(n * fraction) rows without replacement, at least ``at_least``."""
    if not 0 <= fraction <= 1:
        raise ValueError("fraction must be between 0 and 1")
    wanted = lambda total: F.greatest(F.floor(total * F.lit(float(fraction))), F.lit(at_least))
    return take_lowest(df.withColumn("_hash", _ordered_hash(seed, row)), "_hash", wanted).drop("_hash")


def sample_aligned(left: DataFrame, right: DataFrame, row: str, fraction: float, seed=42) -> DataFrame:
    """The same max(1, int(n * fraction)) rows of two tables that have the same row ids."""
    sides = left.select(row, F.lit(1).alias("_l")).unionByName(
        right.select(row, F.lit(0).alias("_l"))
    )
    odd = sides.groupBy(row).agg(F.sum("_l").alias("l"), F.count("*").alias("n")).filter("l <> 1 or n <> 2")
    if not odd.limit(1).isEmpty():
        raise ValueError("lists must have the same rows")
    # Both sides have the same rows, so the ids of one decide; the columns are joined for the rows that stay.
    chosen = sample_fraction(left.select(row).filter(F.col(row).isNotNull()), row, fraction, seed, at_least=1)
    return chosen.join(left, row).join(right, row)
