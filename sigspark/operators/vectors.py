"""Skip-gram vectors trained with negative sampling.

The vocabulary is dealt out into blocks of vectors, one table row for a block of
each side (centres and contexts). Training examples, pairs of tokens with how
often they were drawn together and as noise, go to the pair of blocks that they
touch. A step joins examples with their two blocks, works out gradients there,
sums them by block and updates the blocks; no task holds more than two blocks,
and no vector passes through the driver. An epoch ends with its blocks written to
the shared folder.
"""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigspark.functions.session import drop_table, sized
from sigspark.operators import tokens as tk

#: Vectors of a block take so many bytes on one side.
BLOCK_BYTES = 2_000_000
#: Examples of a pair of blocks that stand in one row, on average.
ROW_EXAMPLES = 100_000
#: Sums of gradients of a block are made in so many parts first.
LANES = 16
DECAY, BETA1, BETA2, TINY = 1e-5, 0.9, 0.999, 1e-8

STATE = "side string, block int, token_ids array<int>, vectors binary, first binary, second binary"
_STATE = pa.schema(
    [("side", pa.string()), ("block", pa.int32()), ("token_ids", pa.list_(pa.int32()))] + [(c, pa.binary()) for c in ("vectors", "first", "second")]
)
_GRADIENT = pa.schema([("side", pa.string()), ("block", pa.int32()), ("place", pa.int64()), ("token_ids", pa.list_(pa.int32())), ("gradient", pa.binary())])
GRADIENT = "side string, block int, place long, token_ids array<int>, gradient binary"


def examples(pairs: DataFrame, drawn: DataFrame) -> DataFrame:
    """(center, context, positive, negative): how often two tokens were drawn as neighbours and as noise."""
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
    near = pairs.select("center", "context", one.alias("positive"), zero.alias("negative"))
    noise = drawn.select("center", F.col("negative").alias("context"), zero.alias("positive"), one.alias("negative"))
    return near.unionByName(noise).groupBy("center", "context").agg(F.sum("positive").alias("positive"), F.sum("negative").alias("negative"))


def _block(token: str, blocks: int) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(blocks)).cast("int")


def example_rows(found: DataFrame, blocks: int, steps: int, seed: int) -> DataFrame:
    """(step, bc, bo, lane, n_positive, n_negative, …): examples of a pair of blocks in rows of bounded expected size.

    Each example belongs to one step of the epoch, by its hash.
    """
    key = F.xxhash64(F.lit(seed), "center", "context")
    found = found.select(
        "center", "context", "positive", "negative", F.pmod(key, F.lit(steps)).cast("int").alias("step"), _block("center", blocks).alias("bc"),
        _block("context", blocks).alias("bo"), F.pmod(F.xxhash64(F.lit(-1 - seed), "center", "context"), F.lit(1 << 30)).alias("_h"),
    )
    sizes = found.groupBy("step", "bc", "bo").agg(F.count(F.lit(1)).alias("_n"), F.sum("positive").alias("_p"), F.sum("negative").alias("_q"))
    sizes = sized(sizes, "examples")
    totals = sizes.groupBy("step").agg(F.sum("_p").alias("n_positive"), F.sum("_q").alias("n_negative"))
    sizes = sizes.join(totals, "step").select("step", "bc", "bo", "_n", "n_positive", "n_negative")
    laid = found.join(sizes, ["step", "bc", "bo"]).withColumn("lane", F.pmod("_h", F.ceil(F.col("_n") / ROW_EXAMPLES)).cast("int"))
    rows = laid.groupBy("step", "bc", "bo", "lane").agg(
        F.first("n_positive").alias("n_positive"), F.first("n_negative").alias("n_negative"),
        F.array_sort(F.collect_list(F.struct("center", "context", "positive", "negative"))).alias("examples"),
    )
    return rows.select("step", "bc", "bo", "lane", "n_positive", "n_negative", *(F.col(f"examples.{c}").alias(c) for c in ("center", "context", "positive", "negative")))


def start(vocabulary: DataFrame, dim: int, blocks: int, seed: int) -> DataFrame:
    """Blocks before training: centres uniform within half a step of 1 / dim, by (seed, token) alone; contexts zero."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for block, ids in zip(batch.column("block").to_pylist(), batch.column("token_ids").to_pylist()):
                drawn = np.stack([np.random.Generator(np.random.Philox(key=[seed, t & (1 << 64) - 1])).random(dim) for t in ids])
                zero = np.zeros((len(ids), dim)).tobytes()
                rows += [("center", block, ids, ((drawn - 0.5) / dim).tobytes(), zero, zero), ("context", block, ids, zero, zero, zero)]
            yield pa.record_batch([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_STATE)], schema=_STATE)

    ids = vocabulary.select(_block("token_id", blocks).alias("block"), F.col("token_id").cast("int").alias("token_id"))
    return ids.groupBy("block").agg(F.array_sort(F.collect_set("token_id")).alias("token_ids")).mapInArrow(work, STATE)


def _matrix(data: bytes, rows: int) -> np.ndarray:
    return np.frombuffer(data, np.float64).reshape(rows, -1)


def gradient(center: np.ndarray, context: np.ndarray, i: np.ndarray, j: np.ndarray, up: np.ndarray, down: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of mean -log sigmoid(x) over neighbours plus mean -log sigmoid(-x) over noise, x the product of rows i and j.

    ``up`` and ``down`` are the shares of each pair in the two means.
    """
    a, b = center[i], context[j]
    s = 1 / (1 + np.exp(-np.einsum("nd,nd->n", a, b)))
    pull = (up * (s - 1) + down * s)[:, None]
    d_center, d_context = np.zeros_like(center), np.zeros_like(context)
    np.add.at(d_center, i, pull * b)
    np.add.at(d_context, j, pull * a)
    return d_center, d_context


def adam(x: np.ndarray, first: np.ndarray, second: np.ndarray, g: np.ndarray, step: int, rate: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One step with decoupled weight decay; steps count from 1."""
    first, second = BETA1 * first + (1 - BETA1) * g, BETA2 * second + (1 - BETA2) * g * g
    x = x * (1 - rate * DECAY) - rate * (first / (1 - BETA1**step)) / (np.sqrt(second / (1 - BETA2**step)) + TINY)
    return x, first, second


def _gradients(rows: DataFrame, state: DataFrame) -> DataFrame:
    """One row for each row of examples and side: gradients of the tokens that it touches."""
    side = lambda s, key: state.filter(F.col("side") == s).select(
        F.col("block").alias(key), F.col("token_ids").alias(f"{s}_ids"), F.col("vectors").alias(f"{s}_vectors")
    )
    joined = rows.join(side("center", "bc"), "bc").join(side("context", "bo"), "bo")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                row = {c: batch.column(c)[r] for c in batch.schema.names}
                number = lambda c: row[c].values.to_numpy()
                ids_a, ids_b = number("center_ids"), number("context_ids")
                a, b = _matrix(row["center_vectors"].as_py(), len(ids_a)), _matrix(row["context_vectors"].as_py(), len(ids_b))
                up = number("positive") / max(1, row["n_positive"].as_py())
                down = number("negative") / max(1, row["n_negative"].as_py())
                i, j = np.searchsorted(ids_a, number("center")), np.searchsorted(ids_b, number("context"))
                bc, bo, lane = (row[c].as_py() for c in ("bc", "bo", "lane"))
                out = []
                for name, block, ids, g, used, other in zip(("center", "context"), (bc, bo), (ids_a, ids_b), gradient(a, b, i, j, up, down), (i, j), (bo, bc)):
                    used = np.unique(used)
                    out.append((name, block, other << 32 | lane, ids[used], g[used].tobytes()))
                yield pa.record_batch([pa.array([x[k] for x in out], f.type) for k, f in enumerate(_GRADIENT)], schema=_GRADIENT)

    return joined.mapInArrow(work, GRADIENT)


def _total(ids: np.ndarray, parts: pa.Table, dim: int) -> np.ndarray:
    """Sum of gradients in a fixed order, so that a rerun adds the same numbers in the same order."""
    total = np.zeros((len(ids), dim))
    for row in parts.sort_by("place").select(["token_ids", "gradient"]).to_pylist():
        total[np.searchsorted(ids, row["token_ids"])] += _matrix(row["gradient"], len(row["token_ids"]))
    return total


def _partly(gradients: DataFrame, dim: int) -> DataFrame:
    """Sums over the rows of a lane: what meets in a block is bounded by the number of lanes."""

    def add(key: tuple, parts: pa.Table) -> pa.Table:
        ids = np.unique(parts.column("token_ids").combine_chunks().flatten().to_numpy())
        row = (key[0].as_py(), key[1].as_py(), key[2].as_py(), ids, _total(ids, parts, dim).tobytes())
        return pa.table([pa.array([x], f.type) for x, f in zip(row, _GRADIENT)], schema=_GRADIENT)

    lane = F.pmod(F.xxhash64("place"), F.lit(LANES)).alias("lane")
    return gradients.groupBy("side", "block", lane).applyInArrow(add, GRADIENT)


def _stepped(state: DataFrame, gradients: DataFrame, dim: int, step: int, rate: float) -> DataFrame:
    def update(own: pa.Table, parts: pa.Table) -> pa.Table:
        (row,) = own.to_pylist()
        ids = np.array(row["token_ids"])
        x, first, second = (_matrix(row[c], len(ids)) for c in ("vectors", "first", "second"))
        new = adam(x, first, second, _total(ids, parts, dim), step, rate)
        values = (row["side"], row["block"], row["token_ids"], *(m.tobytes() for m in new))
        return pa.table([pa.array([v], f.type) for v, f in zip(values, _STATE)], schema=_STATE)

    keys = ["side", "block"]
    return state.groupBy(*keys).cogroup(_partly(gradients, dim).groupBy(*keys)).applyInArrow(update, STATE)


def train(
    seqs: DataFrame, tokens: str = "tokens", dim: int = 128, width: int = 12, negatives: int = 5, epochs: int = 10, steps: int = 4, rate: float = 0.05,
    per_token: int = 4, alpha: float = 0.75, seed: int = 42,
) -> DataFrame:
    """(token_id, vector): the mean of the centre and the context vector of every token of ``seqs`` (seq_id, tokens).

    Each epoch draws ``per_token`` neighbours of every position within ``width``
    and ``negatives`` noise tokens for each, and makes ``steps`` steps over hash
    slices of them with a rate that falls along a cosine. Every draw is a hash, sums
    have a fixed order: reruns agree to the last bit. Sequences of one token, null
    and empty ones give no examples, but their tokens have vectors, as all others do.
    An empty table gives an empty result.
    """
    seqs = seqs.select("seq_id", F.col(tokens).alias("tokens")).filter(F.size("tokens") > 0)
    frequencies = sized(tk.frequencies(seqs.select(F.explode("tokens").alias("token_id"))).filter("freq > 0"), "frequencies")
    noise = sized(tk.noise_distribution(frequencies, alpha), "noise")
    vocabulary = frequencies.count()
    blocks = max(1, math.ceil(vocabulary * dim * 8 / BLOCK_BYTES))
    state = sized(start(frequencies, dim, blocks, seed), "vectors")
    total = epochs * steps
    for epoch in range(epochs):
        pairs = tk.sampled_pairs(seqs, width, per_token, f"{seed}-{epoch}")
        found = examples(pairs, tk.negatives(pairs, noise, negatives, f"{seed}-{epoch}"))
        rows = sized(example_rows(sized(found, "drawn"), blocks, steps, seed + epoch), "rows")
        before = state
        for step in range(steps):
            done = epoch * steps + step
            falling = rate * (1 + math.cos(math.pi * done / total)) / 2
            state = _stepped(state, _gradients(rows.filter(F.col("step") == step).drop("step"), state), dim, done + 1, falling)
        state = sized(state, "vectors")
        drop_table(before)
        drop_table(rows)
    return means(state)


def means(state: DataFrame) -> DataFrame:
    """(token_id, vector) from the blocks of both sides."""
    schema = pa.schema([("token_id", pa.int32()), ("vector", pa.list_(pa.float32()))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                ids = batch.column("token_ids")[r].values
                both = [_matrix(batch.column(c)[r].as_py(), len(ids)) for c in ("center", "context")]
                yield pa.record_batch([ids, pa.array(list(((both[0] + both[1]) / 2).astype(np.float32)), schema[1].type)], schema=schema)

    side = lambda s: state.filter(F.col("side") == s).select("block", F.col("vectors").alias(s), *(["token_ids"] if s == "center" else []))
    return side("center").join(side("context"), "block").mapInArrow(work, "token_id int, vector array<float>")
