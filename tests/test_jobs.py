import numpy as np
from pyspark.sql import functions as F

from sigspark import jobs
from sigspark.sources import tables

RULES = {"mimic": (20, 100, 12), "cpsc": (20, None, None)}


def recordings(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(24):
        corpus = "mimic" if i % 3 else "cpsc"
        n = 100 if i % 5 else 70
        ecg = rng.normal(size=(12, n))
        if i == 4:
            ecg[0, 3] = np.nan
        rows.append((str(i), corpus, f"files/p{i // 4}/s{i}/{i}", "" if i == 7 else "sinus rhythm", 20, ecg.tolist()))
    schema = "rec_id string, base_data string, path string, report string, orig_sf int, ecg array<array<double>>"
    return spark.createDataFrame(rows, schema).repartition(3)


def test_from_recordings_to_folds_and_tokens(spark, tmp_path):
    rec = recordings(spark)
    counts = {r["base_data"]: (r["processed"], r["skipped"]) for r in jobs.build_store(rec, f"{tmp_path}/store", 10, 20, RULES).collect()}
    short = [i for i in range(24) if i % 3 and i % 5 == 0]
    assert counts == {"mimic": (16 - len(short), len(short)), "cpsc": (8, 0)}
    store = tables.read_segments(spark, f"{tmp_path}/store")
    keys = {r["segment_key"] for r in store.select("segment_key").collect()}
    # 100 samples at half the rate are two segments of 20, 70 samples are one.
    want = {f"files_p{i // 4}_s{i}_{i}_{j}" for i in range(24) if i != 7 and i not in short for j in range(2 if i % 5 else 1)}
    assert keys == want
    assert store.filter(F.exists(F.flatten("ecg"), F.isnan)).count() == 0

    inst = rec.select(
        F.monotonically_increasing_id().alias("inst_id"), F.lit("mimic").alias("corpus"),
        F.replace("path", F.lit("/"), F.lit("_")).alias("key"), F.lit('["q","a"]').alias("text"), F.lit(None).cast("string").alias("name"),
    )
    mapped = jobs.map_to_store(inst, store, 20, 10)
    assert mapped.count() == len(want) and mapped.filter("name <> ''").count() == 0
    leaks = jobs.publish_folds(mapped, f"{tmp_path}/folds", "demo", folds=2)
    assert {r["fold"]: r["leaking"] for r in leaks.collect()} == {1: 0, 2: 0}
    both = [tables.read_split(spark, f"{tmp_path}/folds", "demo", 1, s).count() for s in ("train", "test")]
    assert sum(both) == len(want) and 0 < both[0] <= round(len(want) * 0.7)

    vocab = jobs.train_tokenizer(store, f"{tmp_path}/tok", 5, n=10)
    assert vocab.count() == 256 + 5


def test_statistics_over_seeds(spark):
    rows = [(s, i, "a b c d e", "a b c d e" if (i + s) % 2 else "a b x") for s in (1, 2, 3) for i in range(3)]
    got = jobs.evaluate(spark.createDataFrame(rows, "seed int, pair_id bigint, ref string, hyp string")).collect()
    acc = next(r for r in got if r["metric"] == "ACC")
    values = [100 * np.mean([(i + s) % 2 for i in range(3)]) for s in (1, 2, 3)]
    assert np.isclose(acc["mean"], np.mean(values)) and np.isclose(acc["std"], np.std(values, ddof=1))
    assert len(got) == 7
