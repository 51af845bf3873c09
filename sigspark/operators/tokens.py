"""Statistics of token sequences and the training table of token vectors.

Sequences are long tables (seq_id, pos, token_id); a vocabulary has a bounded
number of entries, so per-token tables are small while sequences are not.
"""
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigspark.functions.arrays import fold_sum, let, unrolled
from sigspark.functions.hashing import uniform
from sigspark.functions.session import sized

PREFIX = "signal_"  # fixed value: namespace of signal tokens in a text vocabulary
PAD = -2  # fixed value: padding of ragged index lists


def _vocabulary():
    """A window over a whole table; only for tables with one row per vocabulary entry."""
    return Window.partitionBy(F.lit(0))


def token_name(token_id: Column) -> Column:
    return F.concat(F.lit(PREFIX), token_id.cast("string"))


def token_number(name: Column) -> Column:
    """Inverse of :func:`token_name`; null for other tokens."""
    return F.regexp_extract(name, f"^{PREFIX}([0-9]+)$", 1).try_cast("int")


def frequencies(tokens: DataFrame) -> DataFrame:
    """(token_id, freq) for every id from 0 to the largest one, zeros included."""
    counts = tokens.groupBy("token_id").agg(F.count("*").alias("freq"))
    # Each counted id brings along the uncounted ones right before it.
    before = F.coalesce(F.lag("token_id").over(_vocabulary().orderBy("token_id")), F.lit(-1))
    filled = counts.withColumn("_ids", F.sequence(before + 1, F.col("token_id")))
    filled = filled.select("token_id", "freq", F.explode("_ids").alias("id"))
    return filled.select(F.col("id").alias("token_id"), F.when(F.col("id") == F.col("token_id"), F.col("freq")).otherwise(0).alias("freq"))


def drop_rare(tokens: DataFrame, freq: DataFrame, min_count: int) -> DataFrame:
    """Tokens seen at least ``min_count`` times."""
    kept = sized(freq.filter(F.col("freq") >= min_count).select("token_id"), "kept")
    return tokens.join(kept, "token_id", "left_semi")


def subsampled(tokens: DataFrame, freq: DataFrame, t: float, seed=42) -> DataFrame:
    """Frequent tokens thinned out: kept with probability min(1, sqrt(t/f) + t/f), f the relative frequency."""
    total = F.greatest(F.sum("freq").over(_vocabulary()), F.lit(1))
    rel = F.greatest(F.col("freq") / total, F.lit(1e-12))
    p = F.least(F.lit(1.0), F.sqrt(F.lit(t) / rel) + F.lit(t) / rel)
    keep = sized(freq.select("token_id", p.alias("_p")), "shares")
    return tokens.join(keep, "token_id").filter(uniform(seed, "seq_id", "pos") < F.col("_p")).drop("_p")


def drop_short(tokens: DataFrame) -> DataFrame:
    """Sequences of more than one token; counts are combined before the shuffle."""
    long_ones = tokens.groupBy("seq_id").agg(F.count("*").alias("_n")).filter("_n > 1").select("seq_id")
    return tokens.join(long_ones, "seq_id", "left_semi")


def require_rows(df: DataFrame) -> DataFrame:
    if df.limit(1).isEmpty():
        raise ValueError("all sequences became empty; relax the thresholds")
    return df


def noise_distribution(freq: DataFrame, alpha: float = 0.75) -> DataFrame:
    """(token_id, p): frequency to the power ``alpha``, scaled to one; uniform if nothing was seen."""
    weight = F.pow(F.col("freq").cast("double"), F.lit(alpha))
    total = F.sum(weight).over(_vocabulary())
    p = F.when(total > 0, weight / total).otherwise(F.lit(1.0) / F.count("*").over(_vocabulary()))
    return freq.select("token_id", p.alias("p"))


def window_pairs(seqs: DataFrame, width: int, tokens: str = "tokens") -> DataFrame:
    """(seq_id, center, context) of all positions at most ``width`` apart: at most 2*width rows per token."""

    def both_ways(t):
        n = F.size(t)
        out = []
        for d in range(1, width + 1):
            early, late = F.slice(t, 1, F.greatest(n - d, F.lit(0))), F.slice(t, d + 1, F.greatest(n - d, F.lit(0)))
            pair = lambda a, b: F.struct(a.alias("center"), b.alias("context"))
            out += [F.zip_with(early, late, pair), F.zip_with(late, early, pair)]
        return F.concat(*out)

    pairs = unrolled(seqs, ["seq_id"], let(F.col(tokens), both_ways), "p")
    return pairs.select("seq_id", "p.center", "p.context")


def sampled_pairs(seqs: DataFrame, width: int, per_token: int = 1, seed=42, tokens: str = "tokens") -> DataFrame:
    """``per_token`` draws per centre: a window w in 1…width, then one context position in it. No pair table is built."""
    t, n = F.col(tokens), F.size(tokens)

    def draw(c, i, r):
        w = (F.floor(uniform(f"{seed}w", "seq_id", i, r) * width) + 1).cast("int")
        lo, hi = F.greatest(i - w, F.lit(0)), F.least(i + w, n - 1)
        u = uniform(f"{seed}c", "seq_id", i, r)
        j = let(lo + F.floor(u * (hi - lo)).cast("int"), lambda x: F.when(x >= i, x + 1).otherwise(x))
        return F.struct(i.alias("pos"), r.cast("int").alias("draw"), c.alias("center"), F.get(t, j).alias("context"))

    drawn = F.flatten(
        F.transform(t, lambda c, i: F.transform(F.sequence(F.lit(0), F.lit(per_token - 1)), lambda r: draw(c, i, r)))
    )
    pairs = unrolled(seqs, ["seq_id"], F.when(n > 1, drawn), "p")
    return pairs.select("seq_id", "p.pos", "p.draw", "p.center", "p.context")


def _cumulative(noise: DataFrame, cells: int) -> DataFrame:
    """Inverse-distribution table: each token's interval [lo, hi), repeated for every cell of [0, 1) it touches."""
    order = _vocabulary().orderBy("token_id")
    upto = noise.withColumn("hi", F.sum("p").over(order)).withColumn("lo", F.coalesce(F.lag("hi").over(order), F.lit(0.0)))
    last = F.lead("token_id").over(order).isNull()
    upto = upto.withColumn("hi", F.when(last, F.lit(1.0)).otherwise(F.col("hi"))).filter(F.col("hi") > F.col("lo"))
    first_cell = F.least(F.floor(F.col("lo") * cells), F.lit(cells - 1))
    last_cell = F.least(F.floor(F.col("hi") * cells), F.lit(cells - 1))
    return upto.select(
        F.col("token_id").alias("noise_id"), "lo", "hi", F.explode(F.sequence(first_cell, last_cell)).alias("_cell")
    )


def _drawn(pairs: DataFrame, table: DataFrame, u: Column, cells: int, out: str) -> DataFrame:
    """One token per row from its uniform number: an equi-join on the cell, not a range join."""
    numbered = pairs.withColumn("_u", u).withColumn("_cell", F.least(F.floor(F.col("_u") * cells), F.lit(cells - 1)))
    hit = numbered.join(table, "_cell").filter((F.col("_u") >= F.col("lo")) & (F.col("_u") < F.col("hi")))
    return hit.withColumn(out, F.col("noise_id")).drop("_cell", "_u", "lo", "hi", "noise_id")


def negatives(pairs: DataFrame, noise: DataFrame, k: int, seed=42, cells: int = 1024) -> DataFrame:
    """``k`` noise tokens per pair; one equal to the context is drawn once more."""
    table = sized(_cumulative(noise, cells), "cells")
    drawn = pairs.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    first = _drawn(drawn, table, uniform(f"{seed}n", "seq_id", "pos", "draw", "k"), cells, "_first")
    both = _drawn(first, table, uniform(f"{seed}m", "seq_id", "pos", "draw", "k"), cells, "_second")
    chosen = F.when(F.col("_first") == F.col("context"), F.col("_second")).otherwise(F.col("_first"))
    return both.withColumn("negative", chosen).drop("_first", "_second")


def renormalised(vector: Column) -> Column:
    """Unit length, in double precision."""
    v = vector.cast("array<double>")
    norm = F.greatest(F.sqrt(fold_sum(F.transform(v, lambda x: x * x))), F.lit(1e-12))
    return let(norm, lambda n: F.transform(v, lambda x: x / n))


def top_tokens(freq: DataFrame, k: int) -> DataFrame:
    return freq.orderBy(F.desc("freq"), "token_id").limit(k)


def looked_up(tokens: DataFrame, vectors: DataFrame, dim: int) -> DataFrame:
    """Vector of each token; the padding id, and only it, gets zeros."""
    real = tokens.withColumn("_id", F.when(F.col("token_id") != PAD, F.col("token_id")))
    joined = real.join(sized(vectors.withColumnRenamed("token_id", "_id"), "vectors"), "_id", "left").drop("_id")
    zeros = F.array_repeat(F.lit(0.0).cast("float"), dim)
    return joined.withColumn("vector", F.when(F.col("token_id") == PAD, zeros).otherwise(F.col("vector")))


def rank_frequency(freq: DataFrame) -> DataFrame:
    """(rank, token_id, freq) by falling frequency; one row per vocabulary entry."""
    order = _vocabulary().orderBy(F.desc("freq"), "token_id")
    return freq.filter(F.col("freq") > 0).select(F.row_number().over(order).alias("rank"), "token_id", "freq")


def length_histogram(lengths: DataFrame, length: str, bins: int = 30) -> DataFrame:
    """Counts of equal-width bins between the shortest and the longest length; the last bin is closed."""
    counts = lengths.groupBy(F.col(length).alias("_len")).agg(F.count("*").alias("_n"))
    lo = counts.agg(F.min("_len").cast("double")).scalar()
    hi = counts.agg(F.max("_len").cast("double")).scalar()
    width = F.when(hi > lo, (hi - lo) / bins).otherwise(F.lit(1.0))
    place = F.least(F.floor((F.col("_len") - lo) / width), F.lit(bins - 1)).cast("int")
    return counts.groupBy(place.alias("bin")).agg(F.sum("_n").alias("n"))


def spans(seqs: DataFrame, lengths: str) -> DataFrame:
    """(seq_id, pos, start, stop) of each token on the signal, from the lengths of its tokens."""
    numbered = unrolled(seqs, ["seq_id"], F.col(lengths), "_len", "pos")
    before = Window.partitionBy("seq_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    stop = F.sum("_len").over(before)
    return numbered.select("seq_id", "pos", (stop - F.col("_len")).alias("start"), stop.alias("stop"))
