"""Vectors trained in blocks against the same training in one process."""
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigspark.operators import tokens, vectors

SETTINGS = dict(dim=8, width=3, negatives=3, epochs=2, steps=2, rate=0.1, per_token=2, seed=7)
GROUPS = [range(0, 5), range(5, 10), range(20, 25)]


@pytest.fixture(scope="module")
def seqs(spark):
    """Tokens of one group stand together; a few odd sequences; one token makes up a third of a group."""
    rng = random.Random(1)
    rows = [(i, [rng.choice([g[0], *g]) for _ in range(rng.randint(2, 30))]) for i in range(150) for g in [rng.choice(GROUPS)]]
    rows += [(900, []), (901, None), (902, [3]), (903, [4, 4])]
    return spark.createDataFrame(rows, "seq_id long, tokens array<int>").withColumn("block", F.lit("clash")).repartition(5)


def _in_one_process(seqs, dim, width, negatives, epochs, steps, rate, per_token, seed):
    """The same draws and steps on whole matrices."""
    clean = seqs.select("seq_id", "tokens").filter("size(tokens) > 0")
    freq = tokens.frequencies(clean.select(F.explode("tokens").alias("token_id"))).filter("freq > 0")
    ids = sorted(r["token_id"] for r in freq.collect())
    drawn = np.stack([np.random.Generator(np.random.Philox(key=[seed, t])).random(dim) for t in ids])
    x = {"center": (drawn - 0.5) / dim, "context": np.zeros((len(ids), dim))}
    m, v = ({s: np.zeros((len(ids), dim)) for s in x} for _ in range(2))
    at = {t: i for i, t in enumerate(ids)}
    for epoch in range(epochs):
        pairs = tokens.sampled_pairs(clean, width, per_token, f"{seed}-{epoch}")
        noise = tokens.noise_distribution(freq, 0.75)
        found = vectors.examples(pairs, tokens.negatives(pairs, noise, negatives, f"{seed}-{epoch}"))
        found = found.withColumn("step", F.pmod(F.xxhash64(F.lit(seed + epoch), "center", "context"), F.lit(steps))).collect()
        for step in range(steps):
            mine = [r for r in found if r["step"] == step]
            n_up, n_down = sum(r["positive"] for r in mine), sum(r["negative"] for r in mine)
            g = {s: np.zeros((len(ids), dim)) for s in x}
            for r in mine:
                i, j = at[r["center"]], at[r["context"]]
                s = 1 / (1 + math.exp(-float(x["center"][i] @ x["context"][j])))
                pull = r["positive"] / max(1, n_up) * (s - 1) + r["negative"] / max(1, n_down) * s
                g["center"][i] += pull * x["context"][j]
                g["context"][j] += pull * x["center"][i]
            t = epoch * steps + step + 1
            falling = rate * (1 + math.cos(math.pi * (t - 1) / (epochs * steps))) / 2
            for side in x:
                m[side] = 0.9 * m[side] + 0.1 * g[side]
                v[side] = 0.999 * v[side] + 0.001 * g[side] ** 2
                x[side] = x[side] * (1 - falling * 1e-5) - falling * (m[side] / (1 - 0.9**t)) / (np.sqrt(v[side] / (1 - 0.999**t)) + 1e-8)
    return {t: (x["center"][i] + x["context"][i]) / 2 for t, i in at.items()}


def test_equals_one_process_in_one_and_many_blocks(spark, seqs, monkeypatch):
    want = _in_one_process(seqs, **SETTINGS)
    for block_bytes, row in ((2_000_000, 100_000), (8 * 8 * 6, 40)):
        monkeypatch.setattr(vectors, "BLOCK_BYTES", block_bytes)
        monkeypatch.setattr(vectors, "ROW_EXAMPLES", row)
        got = {r["token_id"]: np.array(r["vector"]) for r in vectors.train(seqs, **SETTINGS).collect()}
        assert got.keys() == want.keys()
        assert max(np.abs(got[t] - want[t]).max() for t in want) < 1e-5


def test_neighbours_of_planted_groups_and_reruns(spark, seqs):
    settings = dict(SETTINGS, epochs=10, steps=1, rate=0.3)
    one, two = ({r["token_id"]: np.array(r["vector"]) for r in vectors.train(s, **settings).collect()} for s in (seqs, seqs.repartition(2)))
    assert one.keys() == two.keys() and all((one[t] == two[t]).all() for t in one)
    unit = {t: x / np.linalg.norm(x) for t, x in one.items()}
    for group in GROUPS:
        for t in group:
            nearest = max((u for u in unit if u != t), key=lambda u: unit[t] @ unit[u])
            assert nearest in group


def test_nothing_to_train_on(seqs):
    assert vectors.train(seqs.filter("seq_id < 0"), **dict(SETTINGS, epochs=1, steps=1)).collect() == []
    got = vectors.train(seqs.filter("seq_id = 902"), **dict(SETTINGS, epochs=1, steps=1)).collect()
    assert [r["token_id"] for r in got] == [3]
