import numpy as np
import pytest
from pyspark.sql import functions as F

from sigspark.operators import features, signal
from sigspark.plans.signals import _spline_weights


def test_resample_is_exact_on_cubics_and_identity():
    t = np.linspace(-1, 2, 50)
    poly = lambda x: 2 * x**3 - x**2 + 3 * x - 1
    x = np.column_stack([poly(t), np.ones(50)])
    y = signal.cubic_resample(x, 23)
    assert np.allclose(y[:, 0], poly(np.linspace(-1, 2, 23)), atol=1e-10)
    assert np.allclose(y[:, 1], 1.0)
    assert np.array_equal(signal.cubic_resample(x, 50), x)


@pytest.mark.parametrize("n,m", [(4, 9), (5, 3), (17, 40), (100, 51)])
def test_resample_equals_dense_solution(n, m):
    x = np.random.default_rng(0).normal(size=(n, 3))
    assert np.allclose(signal.cubic_resample(x, m), _spline_weights(n, m) @ x, atol=1e-9)


def test_resample_column_mixes_lengths(spark):
    rows = [(1, 8, [[float(i) for i in range(16)]] * 2), (2, 4, [[float(i) for i in range(10)]] * 2)]
    df = spark.createDataFrame(rows, "rec_id int, orig_sf int, ecg array<array<double>>")
    got = {r["rec_id"]: r["e"] for r in df.select("rec_id", signal.resampled(4).alias("e")).collect()}
    assert [len(x) for x in got[1]] == [8, 8]
    assert np.allclose(got[1][0], np.linspace(0, 15, 8), atol=1e-5)
    assert got[2][1] == [float(i) for i in range(10)]


def test_admission_of_real_shapes(spark):
    make = lambda n, leads: [[0.0] * n for _ in range(leads)]
    rows = [
        ("ptb", 500, make(5000, 12), None), ("code15", 400, make(4096, 12), None), ("cpsc", 500, make(77, 3), None),
        ("mimic", 250, make(5000, 12), "sampling rate"), ("csn", 500, make(5000, 11), "leads"), ("ptb", 500, make(4999, 12), "samples"),
        ("xyz", 500, make(5000, 12), "unknown corpus"),
    ]
    df = spark.createDataFrame([(a, b, c, d) for a, b, c, d in rows], "base_data string, orig_sf int, ecg array<array<double>>, want string")
    assert all(r["want"] == r["got"] for r in df.select("want", signal.refusal().alias("got")).collect())


def test_lead_orders(spark):
    rows = [(c, [[float(i)] for i in range(12)]) for c in ("mimic", "code15", "ptb")]
    df = spark.createDataFrame(rows, "c string, ecg array<array<double>>")
    got = {r["c"]: [int(x[0]) for x in r["e"]] for r in df.select("c", signal.reordered(F.col("ecg"), F.col("c")).alias("e")).collect()}
    assert got["ptb"] == list(range(12))
    for corpus in ("mimic", "code15"):
        assert [signal.SOURCE_LEAD_ORDER[corpus][i] for i in got[corpus]] == signal.LEAD_ORDER


def test_flat_and_broken_signals(spark):
    rows = [(1, [[float("nan"), float("inf"), float("-inf"), 2.0]]), (2, [[5.0, 5.0, 5.0, 5.0]])]
    df = spark.createDataFrame(rows, "rec_id int, ecg array<array<double>>")
    clean = df.withColumn("n", signal.broken_samples(F.col("ecg"))).withColumn("ecg", signal.repaired_recording(F.col("ecg")))
    got = {r["rec_id"]: r for r in signal.with_normalised(clean).withColumn("s", signal.symbolised(F.col("norm"))).collect()}
    assert got[1]["n"] == 3 and got[1]["ecg"] == [[0.0, 0.0, 0.0, 2.0]]
    assert got[1]["s"] == "aaaz" and got[2]["s"] == "aaaa"
    z = signal.zscored(clean).filter("rec_id = 2").first()
    assert z["zscore"] == [[0.0] * 4] and z["header"] == ["normalized (mean=5.000, std=0.000)"]


def test_patch_length_must_divide(spark):
    df = spark.createDataFrame([(1, [[1.0, 2.0, 3.0]])], "rec_id int, ecg array<array<double>>")
    with pytest.raises(Exception, match="no multiple"):
        signal.check_divides(df, 2).collect()


def test_noise_moments(spark):
    rows = [(i, [[float(np.sin(s / 5.0)) for s in range(200)]] * 2) for i in range(200)]
    df = spark.createDataFrame(rows, "rec_id int, ecg array<array<double>>")
    out = signal.with_noise(df, "rec_id").collect()
    share = np.mean([r["noised"] for r in out])
    assert 0.4 < share < 0.6
    plain = [np.subtract(r["noisy"], r["ecg"]).ravel() for r in out if r["noised"] and not r["wandered"]]
    sd = np.std([np.sin(s / 5.0) for s in range(200)])
    assert abs(np.std(np.concatenate(plain)) / (0.05 * sd) - 1) < 0.03
    assert all(r["noisy"] == r["ecg"] for r in out if not r["noised"])


def reference_peaks(x, height, distance):
    found, i = [], 1
    while i < len(x) - 1:
        if x[i - 1] < x[i]:
            j = i
            while j < len(x) - 1 and x[j + 1] == x[i]:
                j += 1
            if j < len(x) - 1 and x[j + 1] < x[i]:
                found.append((i + j) // 2)
            i = j
        i += 1
    found = [p for p in found if x[p] >= height]
    kept = []
    for p in sorted(found, key=lambda p: (x[p], p), reverse=True):
        if all(abs(p - q) >= distance for q in kept):
            kept.append(p)
    return sorted(kept)


def test_peaks_equal_the_definition():
    rng = np.random.default_rng(3)
    for _ in range(300):
        x = rng.integers(0, 6, size=rng.integers(3, 60)).astype(float)
        d = int(rng.integers(1, 6))
        assert features.find_peaks(x, 2.0, d).tolist() == reference_peaks(x, 2.0, d)


def test_spectrum_of_a_sine_over_several_windows():
    fs, f0 = 250.0, 12.5
    x = np.sin(2 * np.pi * f0 * np.arange(5000) / fs)[None, :]
    f, p = features.welch(x, fs)
    assert len(f) == 513
    assert abs(f[p[0].argmax()] - f0) < fs / 1024
    # The integral of the spectrum is the variance.
    assert abs(p[0].sum() * (f[1] - f[0]) - 0.5) < 0.01


def test_wavelet_bands():
    bands = features.wavelet_bands(np.full((1, 500), 3.0))
    assert len(bands) == 6
    assert np.allclose(bands[0], 3.0 * 2**2.5)
    assert all(np.allclose(b, 0.0, atol=1e-9) for b in bands[1:])
    # Four vanishing moments: cubics leave no detail away from the edges.
    cubic = (np.arange(64.0) ** 3)[None, :]
    assert np.allclose(features.wavelet_bands(cubic)[-1][0, 8:-8], 0.0, atol=1e-6)


def test_feature_vector_has_24_values_per_lead(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=(3, 500)).tolist()) for i in range(3)] + [(9, [[1.0] * 500] * 3)]
    df = spark.createDataFrame(rows, "rec_id int, ecg array<array<double>>")
    got = {r["rec_id"]: r["features"] for r in features.lead_features(df, 250).collect()}
    assert all(len(v) == 24 * 3 for v in got.values())
    x = np.array(rows[0][1][1])
    v = got[0][24:48]
    assert np.allclose(v[:7], [x.mean(), x.std(), x.max(), x.min(), np.median(x), np.percentile(x, 25), np.percentile(x, 75)])
    assert np.allclose(v[22:], [np.abs(np.diff(x)).mean(), np.sqrt((np.diff(x) ** 2).mean())])
    p = features.find_peaks(x, 0.3 * np.ptp(x) + x.min(), 50)
    assert np.isclose(v[11], 60 / np.mean(np.diff(p) / 250)) and np.isclose(v[12], np.std(np.diff(p) / 250))
    assert got[9][11:16] == [0.0] * 5


def test_nulls_and_short_signals_are_refused(spark):
    good = [[0.0] * 5000] * 12
    rows = [
        (None, 500, good, "unknown corpus"), ("ptb", None, good, "sampling rate"), ("cpsc", 500, None, "signal"), ("cpsc", 500, [[0.0] * 3] * 12, "signal"),
        ("cpsc", 500, [[0.0] * 4] * 2, None), ("csn", 500, None, "leads"), ("csn", 500, [[0.0] * 5000] * 11 + [None], "leads"), ("csn", 500, good, None),
    ]
    df = spark.createDataFrame(rows, "base_data string, orig_sf int, ecg array<array<double>>, want string")
    assert all(r["want"] == r["got"] for r in df.select("want", signal.refusal().alias("got")).collect())
    assert sum(r["skipped"] for r in signal.admission_counts(df).collect()) == 6
