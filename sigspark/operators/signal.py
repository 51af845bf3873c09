"""Signal operators on ``ecg array<array<double>>`` (lead outermost), one recording per row.

Unless said otherwise an operator is a narrow, JVM-side projection: no shuffle.
"""
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigspark.functions.arrays import at, indices, let, map_leads, mean, square_deviation, unrolled
from sigspark.functions.hashing import hash_hex, normal, uniform

# Lead orders of the corpora and the one order all recordings are brought to.
LEAD_ORDER = ["I", "II", "III", "aVL", "aVR", "aVF", "V1", "V2", "V3", "V4", "V5", "V6"]
SOURCE_LEAD_ORDER = {
    "mimic": ["I", "II", "III", "aVR", "aVF", "aVL", "V1", "V2", "V3", "V4", "V5", "V6"],
    "code15": ["I", "II", "III", "aVR", "aVL", "aVF", "V1", "V2", "V3", "V4", "V5", "V6"],
}
# Sampling rate, samples and leads that a corpus must have (None = any).
ADMISSION = {
    "mimic": (500, 5000, 12),
    "ptb": (500, 5000, 12),
    "csn": (500, 5000, 12),
    "code15": (400, 4096, 12),
    "cpsc": (500, None, None),
}
SYMBOLS = "abcdefghijklmnopqrstuvwxyz"
EPSILON = 1e-6
MIN_SAMPLES = 4


def refusal(rules: dict = ADMISSION, corpus="base_data", rate="orig_sf", ecg="ecg") -> Column:
    """Why a recording is refused, or null if it is admitted."""
    n_leads = F.size(ecg)
    samples_of = F.size(F.get(ecg, F.lit(0)))
    uneven = F.exists(F.col(ecg), lambda lead: ~F.size(lead).eqNullSafe(samples_of))
    # A condition that a null leaves open counts as not met.
    unmet = lambda condition: ~F.coalesce(condition, F.lit(False))
    reason = F.when(unmet(F.col(corpus).isin(*rules)), "unknown corpus")
    for name, (sf, samples, leads) in rules.items():
        here = F.col(corpus) == name
        reason = reason.when(here & unmet(F.col(rate) == sf), "sampling rate")
        if leads is not None:
            reason = reason.when(here & unmet((n_leads == leads) & ~uneven), "leads")
        if samples is not None:
            reason = reason.when(here & unmet(samples_of == samples), "samples")
    # Later steps fit a spline through the samples, which takes MIN_SAMPLES.
    return reason.when(unmet((samples_of >= MIN_SAMPLES) & ~uneven), "signal")


def admit(df: DataFrame, rules: dict = ADMISSION, **columns) -> tuple[DataFrame, DataFrame]:
    """Admitted recordings, and the refused ones with the reason."""
    marked = df.withColumn("refusal", refusal(rules, **columns))
    return marked.filter(F.col("refusal").isNull()).drop("refusal"), marked.filter(F.col("refusal").isNotNull())


def admission_counts(df: DataFrame, rules: dict = ADMISSION, **columns) -> DataFrame:
    """Processed and skipped recordings per corpus."""
    marked = df.withColumn("refusal", refusal(rules, **columns))
    return marked.groupBy(columns.get("corpus", "base_data")).agg(
        F.count_if(F.col("refusal").isNull()).alias("processed"),
        F.count_if(F.col("refusal").isNotNull()).alias("skipped"),
    )


def reordered(ecg: Column, corpus: Column, sources: dict = SOURCE_LEAD_ORDER, target: list = LEAD_ORDER) -> Column:
    """Leads brought to the target order; corpora without an entry already have it."""
    result = F
    for name, order in sources.items():
        moved = F.array(*[at(ecg, F.lit(order.index(lead))) for lead in target])
        result = result.when(corpus == name, moved)
    return result.otherwise(ecg)


def cubic_resample(values: np.ndarray, n_out: int) -> np.ndarray:
    """Not-a-knot cubic spline through the columns of ``values`` (time first), at ``n_out`` even points.

    Both grids include the end points. The second derivatives solve a
    tridiagonal system; all columns are solved in one sweep over time.
    """
    n = values.shape[0]
    if n_out == n:
        return values.copy()
    if n < 4:
        raise ValueError("a cubic spline needs at least 4 samples")
    bend = 6.0 * (values[:-2] - 2.0 * values[1:-1] + values[2:])
    # Not-a-knot: curvature is linear over the first and the last two intervals,
    # which turns the first and last interior rows into 6*M = bend.
    size = n - 2
    pivot, rhs = np.empty(size), np.empty_like(bend)
    upper = np.ones(size)
    upper[0] = 0.0
    pivot[0], rhs[0] = 6.0, bend[0]
    for i in range(1, size):
        lower, diagonal = (0.0, 6.0) if i == size - 1 else (1.0, 4.0)
        factor = lower / pivot[i - 1]
        pivot[i] = diagonal - factor * upper[i - 1]
        rhs[i] = bend[i] - factor * rhs[i - 1]
    curve = np.empty_like(values)
    curve[size] = rhs[size - 1] / pivot[size - 1]
    for i in range(size - 2, -1, -1):
        curve[i + 1] = (rhs[i] - upper[i] * curve[i + 2]) / pivot[i]
    curve[0] = 2.0 * curve[1] - curve[2]
    curve[n - 1] = 2.0 * curve[n - 2] - curve[n - 3]
    u = np.arange(n_out) * ((n - 1) / (n_out - 1)) if n_out > 1 else np.zeros(n_out)
    k = np.minimum(u.astype(int), n - 2)
    t = (u - k)[:, None]
    s = 1.0 - t
    return (
        s * values[k] + t * values[k + 1] + ((s**3 - s) * curve[k] + (t**3 - t) * curve[k + 1]) / 6.0
    )


def resampled(target_sf: int, ecg="ecg", rate="orig_sf") -> Column:
    """Recordings at ``target_sf``, single precision; recordings of equal length are solved together."""

    @F.pandas_udf("array<array<float>>")
    def solve(signals: pd.Series, rates: pd.Series) -> pd.Series:
        out = [None] * len(signals)
        shapes: dict = {}
        for i, (signal, sf) in enumerate(zip(signals, rates)):
            shapes.setdefault((len(signal), len(signal[0]), sf), []).append(i)
        for (leads, n, sf), rows in shapes.items():
            stack = np.array([np.stack(signals.iloc[i]) for i in rows], dtype=np.float64)
            flat = stack.reshape(len(rows) * leads, n).T
            if sf != target_sf:
                flat = cubic_resample(flat, int(n * target_sf / sf))
            done = np.ascontiguousarray(flat.T, dtype=np.float32).reshape(len(rows), leads, -1)
            for j, i in enumerate(rows):
                out[i] = list(done[j])
        return pd.Series(out)

    return solve(F.col(ecg), F.col(rate))


def segment_recordings(df: DataFrame, length: int, ecg="ecg") -> DataFrame:
    """Whole non-overlapping windows of ``length`` samples; the remainder is dropped, other columns are copied."""
    windows = F.floor(F.size(F.col(ecg)[0]) / length)
    parts = F.transform(
        indices(windows), lambda i: F.transform(F.col(ecg), lambda lead: F.slice(lead, i * length + 1, length))
    )
    # Cut first and unrolled after: a row carries its own window only.
    cut = unrolled(df, [c for c in df.columns if c != ecg], parts, "_part", "seg_idx")
    return cut.withColumnRenamed("_part", ecg)


def segment_samples(df: DataFrame, rec: str, index: str, value: str, length: int, rest: bool = False) -> DataFrame:
    """Segments of numbered samples, for recordings too long for one row; a group holds one segment.

    The shorter rest at the end is dropped, unless ``rest`` asks for it.
    """
    sample = F.struct(F.col(index), F.col(value))
    grouped = df.groupBy(rec, F.floor(F.col(index) / length).alias("seg_idx")).agg(
        F.array_sort(F.collect_list(sample)).alias("_samples")
    )
    whole = grouped if rest else grouped.filter(F.size("_samples") == length)
    return whole.select(rec, "seg_idx", F.array(F.transform("_samples", lambda x: x[value])).alias("ecg"))


def is_broken(x: Column) -> Column:
    return F.isnan(x) | (F.abs(x) == F.lit(float("inf")))


def repaired(x: Column) -> Column:
    """NaN and infinities become zero."""
    return F.when(is_broken(x), F.lit(0.0)).otherwise(x)


def repaired_recording(ecg: Column) -> Column:
    return map_leads(ecg, repaired)


def broken_samples(ecg: Column) -> Column:
    """How many samples a repair would change."""
    return F.size(F.filter(F.flatten(ecg), is_broken))


def is_valid(ecg: Column, report: Column) -> Column:
    """Signal and report are both non-empty."""
    return F.coalesce((F.size(F.flatten(ecg)) > 0) & (F.length(report) > 0), F.lit(False))


def transposed(ecg: Column) -> Column:
    """Time outermost instead of leads outermost, or back."""
    return let(ecg, lambda e: F.transform(indices(F.size(e[0])), lambda i: F.transform(e, lambda row: at(row, i))))


def value_range(ecg: Column) -> Column:
    flat = F.flatten(ecg)
    return F.struct(F.array_min(flat).alias("lo"), F.array_max(flat).alias("hi"))


def with_normalised(df: DataFrame, ecg="ecg", out="norm") -> DataFrame:
    """Min-max normalised recording in [0, 1] and its value range ``lo``, ``hi``."""
    ranged = df.withColumn("_range", value_range(F.col(ecg)))
    ranged = ranged.withColumn("lo", F.col("_range.lo")).withColumn("hi", F.col("_range.hi")).drop("_range")
    scale = F.col("hi") - F.col("lo") + F.lit(EPSILON)
    clipped = map_leads(
        F.col(ecg), lambda x: F.greatest(F.least((x - F.col("lo")) / scale, F.lit(1.0)), F.lit(0.0))
    )
    return ranged.withColumn(out, clipped)


def denormalised(norm: Column, lo: Column, hi: Column) -> Column:
    return map_leads(norm, lambda x: x * (hi - lo) + lo)


def level(x: Column) -> Column:
    """Quantised level 0…25 of a normalised sample."""
    return F.least(F.floor(x * len(SYMBOLS)), F.lit(len(SYMBOLS) - 1)).cast("int")


def symbolised(norm: Column) -> Column:
    """One letter per sample, leads one after the other."""
    return F.array_join(F.transform(F.flatten(norm), lambda x: F.char(level(x) + ord("a"))), "")


def desymbolised(symbols: Column, samples: Column) -> Column:
    """Normalised recording from letters; the level is divided by 25, so the round trip is biased."""
    levels = F.transform(F.split(symbols, ""), lambda c: (F.ascii(c) - ord("a")) / F.lit(float(len(SYMBOLS) - 1)))
    return regrouped(levels, samples)


def regrouped(flat: Column, length: Column) -> Column:
    """Flat array cut into rows of ``length``."""
    cut = lambda f: F.transform(indices(F.floor(F.size(f) / length)), lambda i: F.slice(f, i * length + 1, length))
    return let(flat, cut)


def max_abs_error(a: Column, b: Column) -> Column:
    return F.array_max(F.zip_with(F.flatten(a), F.flatten(b), lambda x, y: F.abs(x - y)))


def zscored(df: DataFrame, ecg="ecg") -> DataFrame:
    """Per-lead z-score and a text header per lead; flat leads are only centred."""
    out = df.withColumn("mean", F.transform(ecg, mean))
    out = out.withColumn("std", F.transform(ecg, lambda lead: F.sqrt(square_deviation(lead) / F.size(lead))))
    moments = F.arrays_zip("mean", "std")
    centred = F.zip_with(
        F.col(ecg),
        moments,
        lambda lead, m: F.transform(lead, lambda x: (x - m["mean"]) / F.when(m["std"] > 1e-6, m["std"]).otherwise(1.0)),
    )
    header = F.transform(
        moments,
        lambda m: F.format_string("normalized (mean=%.3f, std=%.3f)", m["mean"], m["std"]),
    )
    return out.withColumn("zscore", centred).withColumn("header", header)


def blackout(ecg: Column) -> Column:
    return map_leads(ecg, lambda x: F.lit(0.0))


def with_noise(df: DataFrame, id_col: str, seed=42, ecg="ecg", out="noisy") -> DataFrame:
    """With probability 1/2 Gaussian noise of 0.05 std; then, with probability 1/2, a baseline wander.

    The wander is 0.07 max|x| times a sine over 1 to 5 half periods, the same on all leads.
    """
    flat = F.flatten(ecg)
    prepared = df.withColumn("_peak", F.array_max(F.transform(flat, F.abs)))
    prepared = prepared.withColumn("_std", F.sqrt(square_deviation(flat) / F.size(flat)))
    prepared = prepared.withColumn("noised", uniform(f"{seed}:noise", id_col) < 0.5)
    prepared = prepared.withColumn("wandered", F.col("noised") & (uniform(f"{seed}:wander", id_col) < 0.5))
    prepared = prepared.withColumn("_half", F.floor(uniform(f"{seed}:half", id_col) * 5) + 1)
    steps = F.greatest(F.size(F.col(ecg)[0]) - 1, F.lit(1))
    moved = F.transform(
        F.col(ecg),
        lambda lead, l: F.transform(
            lead,
            lambda x, i: x
            + normal(f"{seed}:n", F.col(id_col), l, i) * F.lit(0.05) * F.col("_std")
            + F.when(
                F.col("wandered"),
                F.lit(0.07) * F.col("_peak") * F.sin(F.col("_half") * F.lit(math.pi) * (i / steps)),
            ).otherwise(0.0),
        ),
    )
    return prepared.withColumn(out, F.when(F.col("noised"), moved).otherwise(F.col(ecg))).drop(
        "_peak", "_std", "_half"
    )


def stacked_levels(norm: Column) -> Column:
    """Normalised samples as 0…255, three equal channels per sample."""
    return map_leads(norm, lambda x: F.array_repeat(F.floor(x * 255).cast("int"), 3))


def patches(ecg: Column, size: int, layout: str) -> Column:
    """Cut a recording into patches.

    ``lead``: (lead, n, size). ``time``: (n, size*leads), samples outer, leads
    inner. ``group``: (n, size*T), ``size`` leads after one another.
    """
    if layout == "lead":
        return F.transform(ecg, lambda lead: regrouped(lead, F.lit(size)))
    if layout == "time":
        return regrouped(F.flatten(transposed(ecg)), F.size(ecg) * size)
    if layout == "group":
        return regrouped(F.flatten(ecg), F.size(ecg[0]) * size)
    raise ValueError(f"unknown layout {layout}")


def unpatched(parts: Column, size: int, layout: str, n_leads: int) -> Column:
    """Inverse of :func:`patches`."""
    if layout == "lead":
        return F.transform(parts, F.flatten)
    flat = F.flatten(parts)
    if layout == "time":
        return transposed(regrouped(flat, F.lit(n_leads)))
    if layout == "group":
        return let(flat, lambda f: regrouped(f, F.floor(F.size(f) / n_leads)))
    raise ValueError(f"unknown layout {layout}")


def check_divides(df: DataFrame, size: int, ecg="ecg") -> DataFrame:
    """Fail on a recording whose length is no multiple of the patch size."""
    length = F.size(F.col(ecg)[0])
    message = F.format_string("length %d is no multiple of %d", length, F.lit(size))
    return df.withColumn(ecg, F.when(length % size == 0, F.col(ecg)).otherwise(F.raise_error(message)))


def patch_size(length: Column) -> Column:
    """Divisor of ``length`` that gives 16 to 64 patches, as near to 32 as possible; else near sqrt(length/32)."""
    factors = F.filter(F.sequence(F.lit(1), length), lambda i: length % i == 0)
    target = F.floor(F.sqrt(length / 32))
    n_patches = lambda p: F.floor(length / p)
    rated = F.transform(
        factors,
        lambda p: F.struct(
            F.when(n_patches(p).between(16, 64), 0).otherwise(1).alias("unfit"),
            F.when(n_patches(p).between(16, 64), F.abs(n_patches(p) - 32)).otherwise(F.abs(p - target)).alias("distance"),
            p.alias("p"),
        ),
    )
    return F.array_min(rated)["p"]


def patch_mask(n: int, ratio: float, seed, *identity) -> Column:
    """0 for the int(n*(1-ratio)) patches of lowest noise, 1 for the removed ones."""
    keep = int(n * (1 - ratio))
    noise = F.transform(
        indices(F.lit(n)), lambda i: F.struct(hash_hex(seed, *identity, i).alias("h"), i.cast("int").alias("i"))
    )
    kept = F.transform(F.slice(F.array_sort(noise), 1, keep), lambda x: x["i"])
    return let(
        kept, lambda k: F.transform(indices(F.lit(n)), lambda i: F.when(F.array_contains(k, i), 0).otherwise(1))
    )


def bernoulli_mask(n: int, share: float, seed, *identity) -> Column:
    """1 with probability ``share``, independently per patch."""
    return F.transform(
        indices(F.lit(n)), lambda i: F.when(uniform(seed, *identity, i) < share, 1).otherwise(0)
    )


def patch_error(target: Column, predicted: Column, standardise: bool = False) -> Column:
    """Mean squared error of one patch; the target may be standardised by its own mean and sample variance."""
    if standardise:
        raw = target
        moments = F.struct(
            mean(raw).alias("m"), F.sqrt(square_deviation(raw) / (F.size(raw) - 1) + F.lit(EPSILON)).alias("s")
        )
        target = let(moments, lambda q: F.transform(raw, lambda x: (x - q["m"]) / q["s"]))
    return mean(F.zip_with(predicted, target, lambda p, t: (p - t) * (p - t)))


def masked_error(df: DataFrame, error="error", mask="mask") -> Column:
    """Aggregate: mean error over removed patches."""
    return F.sum(F.col(error) * F.col(mask)) / F.sum(mask)
