"""Per-lead signal features. A lead is one ``array<double>``; segments bound its length.

Statistics, rates and widths stay in the JVM; spectrum, peaks and wavelets run as
Arrow batches in numpy.
"""
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigspark.functions.arrays import at, indices, let, mean, square_deviation

PEAK_SHARE = 0.3  # fixed value: lowest peak height as a share of the range
MAX_WINDOW = 1024  # fixed value: samples per spectrum window
MAX_LEVEL = 5  # fixed value: deepest wavelet level
# Scaling filter of the Daubechies wavelet with four vanishing moments.
DB4 = np.array([
    0.23037781330885523, 0.7148465705525415, 0.6308807679295904, -0.02798376941698385,
    -0.18703481171888114, 0.030841381835986965, 0.032883011666982945, -0.010597401784997278,
])


def percentile(lead: Column, q: float) -> Column:
    """Linear interpolation between order statistics."""

    def pick(s):
        place = (F.size(s) - 1) * F.lit(float(q))
        low = F.floor(place)
        high = F.least(low + 1, F.size(s) - 1)
        return at(s, low) + (at(s, high) - at(s, low)) * (place - low)

    return let(F.array_sort(lead), pick)


def summary(lead: Column) -> Column:
    """mean, std (population), max, min, median, p25, p75."""
    return F.struct(
        mean(lead).alias("mean"),
        F.sqrt(square_deviation(lead) / F.size(lead)).alias("std"),
        F.array_max(lead).alias("max"),
        F.array_min(lead).alias("min"),
        percentile(lead, 0.5).alias("median"),
        percentile(lead, 0.25).alias("p25"),
        percentile(lead, 0.75).alias("p75"),
    )


def welch(x: np.ndarray, fs: float) -> tuple[np.ndarray, np.ndarray]:
    """One-sided power spectrum of the rows of ``x``: Hann windows, half overlapping, mean removed."""
    n = min(MAX_WINDOW, x.shape[1])
    step = n - n // 2
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n) if n > 1 else np.ones(1)
    starts = np.arange(0, x.shape[1] - n + 1, step)
    cut = np.stack([x[:, s : s + n] for s in starts], axis=1)
    cut = (cut - cut.mean(axis=2, keepdims=True)) * window
    power = np.abs(np.fft.rfft(cut, axis=2)) ** 2 / (fs * (window**2).sum())
    power[..., 1 : (-1 if n % 2 == 0 else None)] *= 2
    return np.arange(power.shape[2]) * fs / n, power.mean(axis=1)


def _by_length(leads: pd.Series):
    """Rows of equal length together, as (row numbers, matrix)."""
    lengths = leads.map(len)
    for n in lengths.unique():
        rows = np.flatnonzero(lengths.to_numpy() == n)
        yield rows, (np.stack(leads.iloc[rows].to_list()).astype(np.float64) if n else np.zeros((len(rows), 0)))


def _spectrum_rows(x: np.ndarray, fs: float) -> np.ndarray:
    if x.shape[1] == 0:
        return np.zeros((len(x), 4))
    f, p = welch(x, fs)
    total = p.sum(axis=1)
    centroid = np.divide((f * p).sum(axis=1), total, out=np.zeros(len(x)), where=total > 0)
    return np.column_stack([total, p.max(axis=1), f[p.argmax(axis=1)], centroid])


def spectrum(lead: Column, fs: float) -> Column:
    """total power, largest power, its frequency, centroid (0 without power)."""

    @F.pandas_udf("total double, peak double, peak_freq double, centroid double")
    def run(leads: pd.Series) -> pd.DataFrame:
        out = np.zeros((len(leads), 4))
        for rows, x in _by_length(leads):
            out[rows] = _spectrum_rows(x, fs)
        return pd.DataFrame(out, columns=["total", "peak", "peak_freq", "centroid"])

    return run(lead)


def find_peaks(x: np.ndarray, height: float, distance: int) -> np.ndarray:
    """Local maxima (middle of flat tops) of at least ``height``; of two closer than ``distance`` the higher stays."""
    change = np.flatnonzero(np.diff(x)) + 1
    starts = np.concatenate([[0], change])
    stops = np.concatenate([change, [len(x)]]) - 1
    v = x[starts]
    inner = np.zeros(len(v), dtype=bool)
    inner[1:-1] = (v[1:-1] > v[:-2]) & (v[1:-1] > v[2:])
    peaks = ((starts + stops) // 2)[inner]
    peaks = peaks[x[peaks] >= height]
    keep = np.ones(len(peaks), dtype=bool)
    for j in np.argsort(x[peaks], kind="stable")[::-1]:
        if keep[j]:
            keep &= np.abs(peaks - peaks[j]) >= distance
            keep[j] = True
    return peaks[keep]


def _peaks_of(lead, fs: float) -> np.ndarray:
    x = np.asarray(lead, dtype=np.float64)
    if len(x) == 0 or x.max() == x.min():
        return np.zeros(0, dtype=np.int32)
    height = PEAK_SHARE * (x.max() - x.min()) + x.min()
    return find_peaks(x, height, max(int(0.2 * fs), 1)).astype(np.int32)


def peaks(lead: Column, fs: float) -> Column:
    """Peak positions; empty for a flat lead."""

    @F.pandas_udf("array<int>")
    def run(leads: pd.Series) -> pd.Series:
        return leads.map(lambda x: _peaks_of(x, fs))

    return run(lead)


def _gaps(found: Column, fs: float) -> Column:
    tail = F.slice(found, 2, F.greatest(F.size(found) - 1, F.lit(0)))
    head = F.slice(found, 1, F.greatest(F.size(found) - 1, F.lit(0)))
    return F.zip_with(tail, head, lambda b, a: (b - a) / F.lit(float(fs)))


def rate(found: Column, fs: float) -> Column:
    """Beats per minute and standard deviation of the gaps; zeros below two peaks."""

    def of(gaps):
        bpm = F.when(F.size(gaps) > 0, F.lit(60.0) / mean(gaps)).otherwise(0.0)
        spread = F.when(F.size(gaps) > 1, F.sqrt(square_deviation(gaps) / F.size(gaps))).otherwise(0.0)
        return F.struct(bpm.alias("rate"), spread.alias("variability"))

    return let(_gaps(found, fs), of)


def _span(x: Column) -> Column:
    return F.array_max(x) - F.array_min(x)


def qrs_width(lead: Column, found: Column, fs: float) -> Column:
    """Mean over peaks of the time near the peak spent above a tenth of the local range."""
    w = int(0.1 * fs)

    def width(p):
        start = F.greatest(p - w, F.lit(0))
        local = F.slice(lead, start + 1, F.least(p + w, F.size(lead)) - start)

        def above(s):
            facts = F.struct(mean(s).alias("m"), (_span(s) * 0.1 + F.array_min(s)).alias("t"))
            hits = let(facts, lambda q: F.size(F.filter(s, lambda x: F.abs(x - q["m"]) > q["t"])))
            return F.when((F.size(s) == 0) | (_span(s) == 0), 0.0).otherwise(hits / F.lit(float(fs)))

        return let(local, above)

    return F.when(F.size(found) > 1, mean(F.transform(found, width))).otherwise(0.0)


def t_amplitude(lead: Column, found: Column) -> Column:
    """Range between the last two peaks."""
    a, b = F.get(found, F.size(found) - 2), F.get(found, F.size(found) - 1)
    return F.when(F.size(found) > 1, _span(F.slice(lead, a + 1, b - a))).otherwise(0.0)


def st_deviation(lead: Column, found: Column, fs: float) -> Column:
    """Level shortly after the last peak, relative to the peak."""
    last = F.get(found, F.size(found) - 1)
    later = F.least(last + int(0.08 * fs), F.size(lead) - 1)
    return F.when(F.size(found) > 1, F.get(lead, later) - F.get(lead, last)).otherwise(0.0)


def wavelet_bands(x: np.ndarray) -> list[np.ndarray]:
    """Approximation, then details from coarse to fine, of the rows of ``x``; edges are mirrored."""
    taps = len(DB4)
    level = 0
    if x.shape[1] >= taps - 1:
        level = min(MAX_LEVEL, int(np.floor(np.log2(x.shape[1] / (taps - 1.0)))))
    low, high = DB4[::-1], DB4 * np.where(np.arange(taps) % 2 == 0, -1.0, 1.0)
    details = []
    for _ in range(level):
        padded = np.pad(x, ((0, 0), (taps - 1, taps - 1)), mode="symmetric")
        n = x.shape[1] + taps - 1
        windows = np.lib.stride_tricks.sliding_window_view(padded, taps, axis=1)[:, :n][:, 1::2, ::-1]
        details.append(windows @ high)
        x = windows @ low
    return [x, *details[::-1]]


def _energy_rows(x: np.ndarray) -> np.ndarray:
    if x.shape[1] == 0:
        return np.zeros((len(x), MAX_LEVEL + 1))
    return np.column_stack([np.abs(c).mean(axis=1) for c in wavelet_bands(x)])


def wavelet_energy(lead: Column) -> Column:
    """Mean absolute coefficient per band; fewer bands for short leads."""

    @F.pandas_udf("array<double>")
    def run(leads: pd.Series) -> pd.Series:
        out = [None] * len(leads)
        for rows, x in _by_length(leads):
            for r, bands in zip(rows, _energy_rows(x)):
                out[r] = bands
        return pd.Series(out)

    return run(lead)


def roughness(lead: Column) -> Column:
    """Mean absolute and root mean square step; null for a single sample."""
    tail = F.slice(lead, 2, F.greatest(F.size(lead) - 1, F.lit(0)))
    head = F.slice(lead, 1, F.greatest(F.size(lead) - 1, F.lit(0)))
    steps = F.zip_with(tail, head, lambda b, a: b - a)
    return let(
        steps,
        lambda s: F.struct(
            F.when(F.size(s) > 0, mean(F.transform(s, F.abs))).alias("mean_abs"),
            F.when(F.size(s) > 0, F.sqrt(mean(F.transform(s, lambda x: x * x)))).alias("rms"),
        ),
    )


def _numerics(ecg: Column, fs: float) -> Column:
    """Peaks, spectrum and wavelet bands of all leads of a recording, in one Arrow exchange."""

    @F.pandas_udf("struct<peaks:array<array<int>>,spectrum:array<array<double>>,bands:array<array<double>>>")
    def run(recordings: pd.Series) -> pd.DataFrame:
        rows = []
        for recording in recordings:
            x = np.stack(recording).astype(np.float64)
            rows.append(([_peaks_of(lead, fs) for lead in x], list(_spectrum_rows(x, fs)), list(_energy_rows(x))))
        return pd.DataFrame(rows, columns=["peaks", "spectrum", "bands"])

    return run(ecg)


def lead_features(df: DataFrame, fs: float, ecg="ecg") -> DataFrame:
    """Adds ``features``: the values of every lead in fixed order, leads one after the other."""
    found = df.withColumn("_numeric", _numerics(F.col(ecg), fs))
    leads, numeric = F.col(ecg), F.col("_numeric")

    def vector(i):
        lead, p = at(leads, i), at(numeric["peaks"], i)
        beat = lambda r: F.array(
            r["rate"], r["variability"], qrs_width(lead, p, fs), t_amplitude(lead, p), st_deviation(lead, p, fs)
        )
        return F.concat(
            let(summary(lead), lambda s: F.array(*[s[c] for c in ("mean", "std", "max", "min", "median", "p25", "p75")])),
            at(numeric["spectrum"], i),
            F.when(F.size(p) > 1, let(rate(p, fs), beat)).otherwise(F.array_repeat(F.lit(0.0), 5)),
            at(numeric["bands"], i),
            let(roughness(lead), lambda g: F.array(g["mean_abs"], g["rms"])),
        )

    return found.withColumn("features", F.flatten(F.transform(indices(F.size(ecg)), vector))).drop("_numeric")
