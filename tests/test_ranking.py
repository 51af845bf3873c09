import random

import pytest
from pyspark.sql import functions as F

from sigspark.operators import ranking, splits


@pytest.fixture(scope="module")
def skewed(spark):
    """One group holds most rows, one has a single row."""
    rows = [(i, "hot" if i % 3 else f"g{i % 30}", float((i * 7919) % 5003)) for i in range(5000)] + [(5000, "one", 1.0)]
    return spark.createDataFrame(rows, "id bigint, grp string, x double").repartition(7)


def brute_lowest(rows, n_of):
    groups = {}
    for r in rows:
        groups.setdefault(r["grp"], []).append(r)
    return sorted(r["id"] for g in groups.values() for r in sorted(g, key=lambda r: r["h"])[: n_of(len(g))])


@pytest.mark.parametrize(
    "plain,column",
    [
        (lambda n: n // 3, lambda t: F.floor(t / 3)),
        (lambda n: min(n, 4), lambda t: F.least(t, F.lit(4))),
        (lambda n: n, lambda t: t),
        (lambda n: 0, lambda t: F.lit(0)),
    ],
)
def test_take_lowest_per_group(skewed, plain, column):
    hashed = skewed.withColumn("h", F.concat(F.md5(F.col("id").cast("string")), F.lit(":"), "id"))
    got = ranking.take_lowest(hashed, "h", column, ["grp"])
    assert sorted(r["id"] for r in got.collect()) == brute_lowest(hashed.collect(), plain)


def test_take_lowest_over_all(skewed):
    hashed = skewed.withColumn("h", F.concat(F.md5(F.col("id").cast("string")), F.lit(":"), "id"))
    got = ranking.take_lowest(hashed, "h", lambda t: F.floor(t * 0.25))
    rows = sorted(hashed.collect(), key=lambda r: r["h"])[: int(5001 * 0.25)]
    assert sorted(r["id"] for r in got.collect()) == sorted(r["id"] for r in rows)
    assert set(got.columns) == set(hashed.columns)


def test_number_rows_in_a_hot_group(skewed):
    got = ranking.number_rows(skewed, ["grp"], ["x", "id"]).collect()
    for group in {r["grp"] for r in got}:
        rows = sorted((r for r in got if r["grp"] == group), key=lambda r: (r["x"], r["id"]))
        assert [r["row_index"] for r in rows] == list(range(len(rows)))


def test_number_rows_of_one_value(spark):
    """Nine of ten rows have one value in the first order column: they lie in several parts, and none holds them all."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = spark.range(20_000).select("id", F.when(F.col("id") % 10 > 0, 5.0).when(F.col("id") % 20 > 0, F.col("id") * 1.0).alias("x"))
        rows = rows.withColumn("grp", F.when(F.col("id") % 3 > 0, "a")).repartition(6)
        for group in ([], ["grp"]):
            numbered = ranking.number_rows(rows, group, ["x", "id"])
            assert max(r["n"] for r in numbered.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()) < 8_000
            got = numbered.collect()
            assert len(got) == 20_000 and set(numbered.columns) == {"id", "x", "grp", "row_index"}
            for g in {r["grp"] if group else 0 for r in got}:
                mine = [r for r in got if not group or r["grp"] == g]
                mine.sort(key=lambda r: (r["x"] is None, r["x"] or 0, r["id"]))
                assert [r["row_index"] for r in mine] == list(range(len(mine)))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert ranking.number_rows(rows.filter("id < 0"), ["grp"], ["x", "id"]).collect() == []


def test_previous_value_crosses_chunks(skewed):
    numbered = ranking.number_rows(skewed, ["grp"], ["x", "id"], "s")
    got = ranking.with_previous(numbered, ["grp"], "s", "x", "before", chunk=16).collect()
    assert len(got) == 5001
    by_place = {(r["grp"], r["s"]): r["x"] for r in got}
    assert all(r["before"] == by_place.get((r["grp"], r["s"] - 1)) for r in got)


def sequential_split(sizes, target):
    """Groups in falling size order, taken while they fit."""
    taken, used = {}, 0
    for size in sorted(sizes, reverse=True):
        if used + size <= target:
            used += size
            taken[size] = taken.get(size, 0) + 1
    return taken


def test_histogram_walk_equals_sequential_walk():
    rng = random.Random(5)
    for _ in range(500):
        sizes = [rng.choice([1, 1, 2, 3, 5, 8, 40]) for _ in range(rng.randint(1, 40))]
        target = round(sum(sizes) * 0.7)
        histogram = [(s, sizes.count(s)) for s in set(sizes)]
        walked = {s: n for s, n in splits._greedy_takes(histogram, target) if n}
        assert walked == sequential_split(sizes, target)


def test_split_keeps_groups_whole_and_is_partition_independent(spark):
    rows = [(i, "hot" if i % 3 == 0 else (None if i % 7 == 0 else f"p{i % 50}")) for i in range(3000)]
    df = spark.createDataFrame(rows, "row bigint, patient string")
    one = splits.grouped_split(df.coalesce(1), "row", "patient", folds=3).collect()
    many = splits.grouped_split(df.repartition(7), "row", "patient", folds=3).collect()
    assert sorted((r["fold"], r["row"], r["split"]) for r in one) == sorted((r["fold"], r["row"], r["split"]) for r in many)
    assert len(one) == 9000
    sides = {}
    for r in one:
        if r["patient"]:
            sides.setdefault((r["fold"], r["patient"]), set()).add(r["split"])
    assert all(len(s) == 1 for s in sides.values())
    for fold in (1, 2, 3):
        assert sum(r["split"] == "train" for r in one if r["fold"] == fold) <= round(3000 * 0.7)


def test_a_row_never_joins_a_patient_of_its_name(spark):
    df = spark.createDataFrame([(1, None), (2, "1"), (3, "1")], "row bigint, patient string")
    assert splits.grouped_split(df, "row", "patient", 0.99).count() == 3


def test_patient_rules(spark):
    paths = [
        ("./data/mimic/files/p1000/p10000032/s4/4_0.npy", "mimic", "p10000032"),
        ("data/MIMIC/p12/p34/x", "mimic", "p12"),
        ("./data/ptb/records500_00000_00001_hr_0.npy", "ptb", "00001"),
        ("./data/csn/p1_1_hr", "csn", None),
        ("/x/y", "", None),
    ]
    df = spark.createDataFrame(paths, "path string, corpus string, patient string")
    got = df.select("corpus", "patient", splits.corpus_of(F.col("path")).alias("c"), splits.patient_of(F.col("path")).alias("p"))
    assert all((r["corpus"], r["patient"]) == (r["c"], r["p"]) for r in got.collect())


def test_aligned_sample_needs_equal_rows(spark):
    a, b = spark.range(100).withColumnRenamed("id", "row"), spark.range(99).withColumnRenamed("id", "row")
    with pytest.raises(ValueError):
        splits.sample_aligned(a, b, "row", 0.1)
    with pytest.raises(ValueError):
        splits.sample_fraction(a, "row", 1.5)
    assert splits.sample_aligned(a, a, "row", 0.001).count() == 1


@pytest.fixture
def planned(spark):
    """Only tables of a few rows are broadcast, and plans are carried out as they are made."""
    settings = {"spark.sql.autoBroadcastJoinThreshold": "20000", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def _joins(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_of_one_group_do_not_meet_to_be_cut(planned):
    # The cut of a group is one row: the rows stay where they are instead of being dealt by the group.
    rows = planned.range(30_000).select(F.col("id").alias("row"), F.lit("same").alias("grp"))
    hashed = rows.withColumn("h", F.md5(F.col("row").cast("string")))
    for got in (ranking.take_lowest(hashed, "h", lambda t: F.lit(5)), splits.sample_rows(rows, "row", 5)):
        assert "SortMergeJoin" not in _joins(got)
        assert got.count() == 5


def test_aligned_sample_is_drawn_before_the_columns_are_joined(planned):
    left = planned.range(300_000).select(F.col("id").alias("row"), (F.col("id") * 2).alias("x"))
    right = planned.range(300_000).select(F.col("id").alias("row"), (F.col("id") * 3).alias("y"))
    got = splits.sample_aligned(left, right, "row", 0.0001)
    assert got.columns == ["row", "x", "y"]
    assert got.filter("x <> 2 * row OR y <> 3 * row").count() == 0 and got.count() == 30
    want = splits.sample_fraction(left, "row", 0.0001)
    assert {r["row"] for r in got.collect()} == {r["row"] for r in want.collect()}
    assert _joins(got).count("SortMergeJoin") <= 2  # the columns of the rows that stay, once each


def test_large_group_is_not_dealt_to_one_task(planned):
    rows = planned.range(20_000).select(F.col("id").alias("row"), F.when(F.col("id") % 2 == 0, "p1").otherwise(F.lit(None)).alias("p"))
    split = splits.grouped_split(rows, "row", "p", folds=2)
    assert split.count() == 40_000 and split.columns == ["row", "p", "fold", "split"]
    assert split.filter("p IS NOT NULL").select("fold", "split").distinct().count() == 2
    assert [r["n"] for r in split.filter("split = 'train'").groupBy("fold").agg(F.count("*").alias("n")).collect()] == [14_000] * 2
    split = splits.grouped_split(rows, "row", "p")
    sizes = split.groupBy(F.spark_partition_id()).count().orderBy(F.desc("count")).limit(1).collect()
    assert sizes[0]["count"] < 10_000  # p1 has 10,000 rows
