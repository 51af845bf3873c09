"""Queries on signal features of all stream samples (one lead, at most SEGMENT samples a row, SEGMENT per second)."""
from pyspark.sql import functions as F

from sigspark.functions.arrays import rounded, unrolled
from sigspark.operators import features, long_features
from sigspark.operators.ranking import number_rows, with_previous
from sigspark.plans.bindings import SEGMENT, SEGMENTS, STREAM, rec, stream_samples, stream_segments, table

FS = SEGMENT
R = 7


def _segments(spark, d):
    return stream_segments(spark, d).select("rec_id", F.col("seg_idx").alias("seg"), F.col("ecg")[0].alias("x"))


def _fields(df, struct, names):
    return df.select("rec_id", "seg", *[rounded(F.col(f"{struct}.{n}"), R).alias(n) for n in names])


def summary_statistics(spark, d):
    s = _segments(spark, d).withColumn("s", features.summary(F.col("x")))
    return _fields(s, "s", ["mean", "std", "max", "min", "median", "p25", "p75"])


def power_spectrum(spark, d):
    s = _segments(spark, d).withColumn("s", features.spectrum(F.col("x"), FS))
    return _fields(s, "s", ["total", "peak", "peak_freq"])


def spectral_centroid(spark, d):
    s = _segments(spark, d).withColumn("s", features.spectrum(F.col("x"), FS))
    return _fields(s, "s", ["centroid"])


_SPECTRUM = f"""WITH {SEGMENTS},
m AS (SELECT rec_id, seg, avg(x) AS mu FROM segs GROUP BY ALL),
win AS (SELECT n, i, CASE WHEN n = 1 THEN 1.0::DOUBLE ELSE 0.5 - 0.5 * cos(2 * pi() * i / n::DOUBLE) END AS w
        FROM range(1, {SEGMENT + 1}) s(n), range({SEGMENT}) t(i) WHERE i < n),
sizes AS (SELECT n, sum(w * w) AS ww FROM win GROUP BY n),
tapered AS (SELECT rec_id, seg, segs.n, segs.i, (x - mu) * w AS y FROM segs JOIN m USING (rec_id, seg) JOIN win ON win.i = segs.i AND win.n = segs.n),
dft AS (SELECT rec_id, seg, n, k, sum(y * cos(2 * pi() * k * i / n::DOUBLE)) AS re, sum(y * sin(2 * pi() * k * i / n::DOUBLE)) AS im
        FROM tapered, range({SEGMENT // 2 + 1}) t(k) WHERE k <= n // 2 GROUP BY ALL),
psd AS (SELECT rec_id, seg, k * {FS} / n::DOUBLE AS f,
               (re * re + im * im) / ({FS} * ww) * CASE WHEN k = 0 OR 2 * k = n THEN 1 ELSE 2 END AS p FROM dft JOIN sizes USING (n))"""


def peak_detection(spark, d):
    s = _segments(spark, d).withColumn("p", features.peaks(F.col("x"), FS))
    return unrolled(s, ["rec_id", "seg"], F.col("p"), "peak", "place")


_DISTANCE, _QRS, _ST = max(int(0.2 * FS), 1), int(0.1 * FS), int(0.08 * FS)
_PEAKS = f"""{SEGMENTS},
steps AS (SELECT *, CASE WHEN x = lag(x) OVER (PARTITION BY rec_id, seg ORDER BY i) THEN 0 ELSE 1 END AS fresh FROM segs),
runs0 AS (SELECT *, sum(fresh) OVER (PARTITION BY rec_id, seg ORDER BY i) AS run FROM steps),
runs AS (SELECT rec_id, seg, run, min(i) AS a, max(i) AS b, any_value(x) AS v FROM runs0 GROUP BY ALL),
tops AS (SELECT rec_id, seg, (a + b) // 2 AS p, v, lag(v) OVER w AS pv, lead(v) OVER w AS nv FROM runs WINDOW w AS (PARTITION BY rec_id, seg ORDER BY run)),
ext AS (SELECT rec_id, seg, min(x) AS lo, max(x) AS hi, avg(x) AS mu FROM segs GROUP BY ALL),
cand AS (SELECT rec_id, seg, p, v FROM tops JOIN ext USING (rec_id, seg) WHERE v > pv AND v > nv AND v >= 0.3::DOUBLE * (hi - lo) + lo),
chosen AS (SELECT rec_id, seg, list_sort(list_reduce(list([p] ORDER BY v DESC, p DESC),
    lambda acc, y: CASE WHEN len(list_filter(acc, lambda q: abs(q - y[1]) < {_DISTANCE})) > 0 THEN acc ELSE list_append(acc, y[1]) END)) AS ps
  FROM cand GROUP BY ALL),
placed AS (SELECT rec_id, seg, unnest(ps) AS p, generate_subscripts(ps, 1) - 1 AS place, len(ps) AS n FROM chosen)"""


def _with_peaks(spark, d):
    return _segments(spark, d).withColumn("p", features.peaks(F.col("x"), FS))


def beat_rate(spark, d):
    s = _with_peaks(spark, d).withColumn("r", features.rate(F.col("p"), FS))
    return _fields(s, "r", ["rate", "variability"])


def qrs_width(spark, d):
    w = features.qrs_width(F.col("x"), F.col("p"), FS)
    return _with_peaks(spark, d).select("rec_id", "seg", rounded(w, R).alias("qrs"))


def t_wave_amplitude(spark, d):
    a = features.t_amplitude(F.col("x"), F.col("p"))
    return _with_peaks(spark, d).select("rec_id", "seg", rounded(a, R).alias("amplitude"))


def st_deviation(spark, d):
    a = features.st_deviation(F.col("x"), F.col("p"), FS)
    return _with_peaks(spark, d).select("rec_id", "seg", rounded(a, R).alias("deviation"))


_QRS_SQL = f"""WITH {_PEAKS},
near AS (SELECT c.rec_id, c.seg, c.p, x FROM placed c JOIN segs s ON s.rec_id = c.rec_id AND s.seg = c.seg
         AND s.i >= c.p - {_QRS} AND s.i < c.p + {_QRS} WHERE c.n > 1),
facts AS (SELECT rec_id, seg, p, avg(x) AS mu, max(x) AS hi, 0.1::DOUBLE * (max(x) - min(x)) + min(x) AS t, min(x) AS lo FROM near GROUP BY ALL),
widths AS (SELECT rec_id, seg, p, CASE WHEN any_value(hi) = any_value(lo) THEN 0.0 ELSE count(*) FILTER (abs(x - mu) > t) / {FS}.0::DOUBLE END AS w
           FROM near JOIN facts USING (rec_id, seg, p) GROUP BY ALL),
means AS (SELECT rec_id, seg, avg(w) AS q FROM widths GROUP BY ALL)
SELECT rec_id, seg, round(coalesce(q, 0.0), {R}) + 0.0 AS qrs FROM ext LEFT JOIN means USING (rec_id, seg)"""


def wavelet_energy(spark, d):
    s = _segments(spark, d).withColumn("e", features.wavelet_energy(F.col("x")))
    e = unrolled(s, ["rec_id", "seg"], F.col("e"), "energy", "band")
    return e.withColumn("energy", rounded(F.col("energy"), R))


def _wavelet_sql():
    low = list(reversed(features.DB4.tolist()))
    high = [(-1.0 if j % 2 == 0 else 1.0) * v for j, v in enumerate(features.DB4.tolist())]
    taps = ", ".join(f"({j}, {low[j]!r}::DOUBLE, {high[j]!r}::DOUBLE)" for j in range(8))

    def level(name, source, least):
        at = "(2 * k + 1 - j)"
        place = f"CASE WHEN {at} < 0 THEN -{at} - 1 WHEN {at} >= s.n THEN 2 * s.n - 1 - {at} ELSE {at} END"
        return f"""{name} AS (SELECT rec_id, seg, size, k, (s.n + 7) // 2 AS n, sum(x * lo) AS a, sum(x * hi) AS d
            FROM range({SEGMENT}) t(k), taps, {source} s WHERE size >= {least} AND k < (s.n + 7) // 2 AND s.i = {place} GROUP BY ALL)"""

    return f"""WITH {SEGMENTS}, taps(j, lo, hi) AS (VALUES {taps}), s0 AS (SELECT *, n AS size FROM segs),
{level("l1", "s0", 14)}, s1 AS (SELECT rec_id, seg, size, n, k AS i, a AS x FROM l1), {level("l2", "s1", 28)}
SELECT rec_id, seg, 0 AS band, round(avg(abs(x)), {R}) + 0.0 AS energy FROM s0 WHERE size < 14 GROUP BY ALL
UNION ALL SELECT rec_id, seg, 0, round(avg(abs(a)), {R}) + 0.0 FROM l1 WHERE size < 28 GROUP BY ALL
UNION ALL SELECT rec_id, seg, 1, round(avg(abs(d)), {R}) + 0.0 FROM l1 WHERE size < 28 GROUP BY ALL
UNION ALL SELECT rec_id, seg, 0, round(avg(abs(a)), {R}) + 0.0 FROM l2 GROUP BY ALL
UNION ALL SELECT rec_id, seg, 1, round(avg(abs(d)), {R}) + 0.0 FROM l2 GROUP BY ALL
UNION ALL SELECT rec_id, seg, 2, round(avg(abs(d)), {R}) + 0.0 FROM l1 WHERE size >= 28 GROUP BY ALL"""


def roughness(spark, d):
    s = _segments(spark, d).withColumn("g", features.roughness(F.col("x")))
    return _fields(s, "g", ["mean_abs", "rms"])


def stream_roughness(spark, d):
    """Roughness of whole streams of any length: steps from numbered samples."""
    steps = with_previous(stream_samples(spark, d), ["rec_id"], "s", "value", "before")
    step = F.col("value") - F.col("before")
    return steps.groupBy("rec_id").agg(
        rounded(F.avg(F.abs(step)), R).alias("mean_abs"), rounded(F.sqrt(F.avg(step * step)), R).alias("rms")
    )


def feature_vector(spark, d):
    v = unrolled(features.lead_features(rec(spark, d), 16), ["rec_id"], F.col("features"), "value", "i")
    return v.withColumn("value", rounded(F.col("value"), 6))


def feature_vector_width(spark, d):
    v = features.lead_features(stream_segments(spark, d), FS)
    return v.groupBy(F.size("features").alias("width")).agg(F.count("*").alias("segments"))


LONG_FS = 32.0
LONG_BLOCK = 1024


def long_lead_features(spark, d):
    """Whole leads, one for each type of event, in blocks: several spectrum windows, all wavelet levels, peaks over borders."""
    events = table(spark, d, "events").select("event_type", "ts", "event_id", "value")
    samples = number_rows(events, ["event_type"], ["ts", "event_id"], "s")
    rows = long_features.blocks_of(samples, "event_type", "s", "value", LONG_BLOCK)
    v = unrolled(long_features.long_features(rows, LONG_FS, LONG_BLOCK), ["rec"], F.col("features"), "value", "i")
    return v.select("rec", "i", rounded(F.col("value"), 5).alias("value"))


def _long_sql():
    """The same values from whole leads; a lead is the one segment of its type."""
    segs = """leads AS (SELECT event_type AS rec_id, 0 AS seg, (row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1)::INT AS i,
                               value AS x, count(*) OVER (PARTITION BY event_type)::INT AS n FROM events),
segs AS (SELECT * FROM leads)"""
    low = list(reversed(features.DB4.tolist()))
    high = [(-1.0 if j % 2 == 0 else 1.0) * v for j, v in enumerate(features.DB4.tolist())]
    taps = ", ".join(f"({j}, {low[j]!r}::DOUBLE, {high[j]!r}::DOUBLE)" for j in range(8))
    waves = f"""taps(j, lo, hi) AS (VALUES {taps}),
z0 AS (SELECT DISTINCT rec_id, n, CASE WHEN n < 7 THEN 0 ELSE least(5, floor(log2(n / 7.0::DOUBLE)))::INT END AS level FROM leads),
a0 AS (SELECT rec_id, i, x FROM leads)"""
    for k in range(1, 6):
        at = "(2 * k + 1 - j)"
        waves += f""",
p{k} AS (SELECT rec_id, n, k, j, lo, hi FROM (SELECT rec_id, n, unnest(range((n + 7) // 2)) AS k FROM z{k - 1} WHERE level >= {k}), taps),
w{k} AS (SELECT q.rec_id, k, sum(x * lo) AS a, sum(x * hi) AS d FROM (SELECT *, CASE WHEN {at} < 0 THEN -{at} - 1 WHEN {at} >= n THEN 2 * n - 1 - {at} ELSE {at} END AS place FROM p{k}) q
         JOIN a{k - 1} s ON s.rec_id = q.rec_id AND s.i = q.place GROUP BY ALL),
z{k} AS (SELECT rec_id, (n + 7) // 2 AS n, level FROM z{k - 1} WHERE level >= {k}), a{k} AS (SELECT rec_id, k AS i, a AS x FROM w{k})"""
    bands = " UNION ALL ".join(
        [f"SELECT rec_id, 0 AS b, avg(abs(x)) AS v FROM a{k} JOIN z0 USING (rec_id) WHERE level = {k} GROUP BY ALL" for k in range(6)]
        + [f"SELECT rec_id, level - {k} + 1, avg(abs(d)) FROM w{k} JOIN z0 USING (rec_id) GROUP BY ALL" for k in range(1, 6)]
    )
    peaks = _PEAKS.replace(SEGMENTS, segs)
    return f"""WITH {peaks}, {waves}, bands AS ({bands}),
wins AS (SELECT rec_id, n, least(n, 1024) AS w, unnest(range(0, n - least(n, 1024) + 1, least(n, 1024) - least(n, 1024) // 2)) AS s FROM z0),
cut AS (SELECT v.rec_id, v.s, v.w, l.i - v.s AS i, x - avg(x) OVER (PARTITION BY v.rec_id, v.s) AS x FROM wins v JOIN leads l ON l.rec_id = v.rec_id AND l.i >= v.s AND l.i < v.s + v.w),
tapered AS (SELECT rec_id, s, w, i, x * h AS y, sum(h * h) OVER (PARTITION BY rec_id, s) AS hh FROM (SELECT *, 0.5 - 0.5 * cos(2 * pi() * i / w::DOUBLE) AS h FROM cut)),
dft AS (SELECT rec_id, s, w, k, any_value(hh) AS hh, sum(y * cos(2 * pi() * (k * i % w) / w::DOUBLE)) AS re, sum(y * sin(2 * pi() * (k * i % w) / w::DOUBLE)) AS im
        FROM tapered, range(513) t(k) WHERE k <= w // 2 GROUP BY ALL),
psd AS (SELECT rec_id, k * {LONG_FS} / w AS f, avg((re * re + im * im) / ({LONG_FS}::DOUBLE * hh) * CASE WHEN k = 0 OR 2 * k = w THEN 1 ELSE 2 END) AS p FROM dft GROUP BY ALL),
rr AS (SELECT rec_id, (p - lag(p) OVER (PARTITION BY rec_id ORDER BY p)) / {LONG_FS}::DOUBLE AS g FROM placed),
r AS (SELECT rec_id, avg(g) AS g, stddev_pop(g) AS sd FROM rr GROUP BY ALL HAVING count(g) > 0),
near AS (SELECT c.rec_id, c.p, x FROM placed c JOIN leads s ON s.rec_id = c.rec_id AND s.i >= c.p - {int(0.1 * LONG_FS)} AND s.i < c.p + {int(0.1 * LONG_FS)} WHERE c.n > 1),
marks AS (SELECT rec_id, p, avg(x) AS mu, max(x) AS hi, 0.1::DOUBLE * (max(x) - min(x)) + min(x) AS t, min(x) AS lo FROM near GROUP BY ALL),
widths AS (SELECT rec_id, p, CASE WHEN any_value(hi) = any_value(lo) THEN 0.0 ELSE count(*) FILTER (abs(x - mu) > t) / {LONG_FS}::DOUBLE END AS w FROM near JOIN marks USING (rec_id, p) GROUP BY ALL),
qrs AS (SELECT rec_id, avg(w) AS q FROM widths GROUP BY ALL),
last2 AS (SELECT rec_id, ps[-2] AS a, ps[-1] AS b FROM chosen WHERE len(ps) > 1),
amp AS (SELECT l.rec_id, max(x) - min(x) AS t FROM last2 l JOIN leads s ON s.rec_id = l.rec_id AND i >= a AND i < b GROUP BY ALL),
st AS (SELECT l.rec_id, y.x - z.x AS st FROM last2 l JOIN z0 o USING (rec_id) JOIN leads y ON y.rec_id = l.rec_id AND y.i = least(b + {int(0.08 * LONG_FS)}, o.n - 1) JOIN leads z ON z.rec_id = l.rec_id AND z.i = b),
stats AS (SELECT rec_id, [avg(x), stddev_pop(x), max(x), min(x), quantile_cont(x, 0.5), quantile_cont(x, 0.25), quantile_cont(x, 0.75)] AS v FROM leads GROUP BY ALL),
spec AS (SELECT rec_id, [sum(p), max(p), (list(f ORDER BY round(p, 12) DESC, f))[1], CASE WHEN sum(p) > 0 THEN sum(f * p) / sum(p) ELSE 0 END] AS v FROM psd GROUP BY ALL),
beat AS (SELECT rec_id, [coalesce(60 / g, 0.0), coalesce(sd, 0.0), coalesce(q, 0.0), coalesce(t, 0.0), coalesce(st, 0.0)] AS v
         FROM z0 LEFT JOIN r USING (rec_id) LEFT JOIN qrs USING (rec_id) LEFT JOIN amp USING (rec_id) LEFT JOIN st USING (rec_id)),
band AS (SELECT rec_id, list(v ORDER BY b) AS v FROM bands GROUP BY ALL),
moves AS (SELECT rec_id, x - lag(x) OVER (PARTITION BY rec_id ORDER BY i) AS d FROM leads),
rough AS (SELECT rec_id, [avg(abs(d)), sqrt(avg(d * d))] AS v FROM moves GROUP BY ALL),
vectors AS (SELECT rec_id, list_concat(stats.v, spec.v, beat.v, band.v, rough.v) AS v
            FROM stats JOIN spec USING (rec_id) JOIN beat USING (rec_id) JOIN band USING (rec_id) JOIN rough USING (rec_id))
SELECT rec_id AS rec, (i - 1)::INT AS i, round(v[i], 5) + 0.0 AS value FROM (SELECT rec_id, v, unnest(range(1, len(v) + 1)) AS i FROM vectors)"""


_LEFT = "FROM ext LEFT JOIN"
PLANS = {
    "summary_statistics": (
        summary_statistics,
        f"""WITH {SEGMENTS} SELECT rec_id, seg, round(avg(x), {R}) + 0.0 AS mean, round(stddev_pop(x), {R}) + 0.0 AS std, max(x) AS max, min(x) AS min,
            round(quantile_cont(x, 0.5), {R}) + 0.0 AS median, round(quantile_cont(x, 0.25), {R}) + 0.0 AS p25,
            round(quantile_cont(x, 0.75), {R}) + 0.0 AS p75 FROM segs GROUP BY 1, 2""",
    ),
    "power_spectrum": (
        power_spectrum,
        f"""{_SPECTRUM} SELECT rec_id, seg, round(sum(p), {R}) + 0.0 AS total, round(max(p), {R}) + 0.0 AS peak,
            round((list(f ORDER BY round(p, 12) DESC, f))[1], {R}) + 0.0 AS peak_freq FROM psd GROUP BY 1, 2""",
    ),
    "spectral_centroid": (
        spectral_centroid,
        f"{_SPECTRUM} SELECT rec_id, seg, round(CASE WHEN sum(p) > 0 THEN sum(f * p) / sum(p) ELSE 0 END, {R}) + 0.0 AS centroid FROM psd GROUP BY 1, 2",
    ),
    "peak_detection": (peak_detection, f"WITH {_PEAKS} SELECT rec_id, seg, place::INT AS place, p::INT AS peak FROM placed"),
    "beat_rate": (
        beat_rate,
        f"""WITH {_PEAKS}, rr AS (SELECT rec_id, seg, (p - lag(p) OVER (PARTITION BY rec_id, seg ORDER BY p)) / {FS}.0::DOUBLE AS g FROM placed),
            r AS (SELECT rec_id, seg, avg(g) AS g, stddev_pop(g) AS sd FROM rr GROUP BY ALL)
            SELECT rec_id, seg, round(coalesce(60.0::DOUBLE / g, 0.0), {R}) + 0.0 AS rate, round(coalesce(sd, 0.0), {R}) + 0.0 AS variability
            {_LEFT} r USING (rec_id, seg)""",
    ),
    "qrs_width": (qrs_width, _QRS_SQL),
    "t_wave_amplitude": (
        t_wave_amplitude,
        f"""WITH {_PEAKS}, last2 AS (SELECT rec_id, seg, ps[-2] AS a, ps[-1] AS b FROM chosen WHERE len(ps) > 1),
            t AS (SELECT l.rec_id, l.seg, max(x) - min(x) AS amp FROM last2 l JOIN segs s ON s.rec_id = l.rec_id AND s.seg = l.seg AND i >= a AND i < b GROUP BY ALL)
            SELECT rec_id, seg, round(coalesce(amp, 0.0), {R}) + 0.0 AS amplitude {_LEFT} t USING (rec_id, seg)""",
    ),
    "st_deviation": (
        st_deviation,
        f"""WITH {_PEAKS}, ns AS (SELECT rec_id, seg, any_value(n) AS n FROM segs GROUP BY ALL),
            lasts AS (SELECT rec_id, seg, ps[-1] AS b, least(ps[-1] + {_ST}, n - 1) AS later FROM chosen JOIN ns USING (rec_id, seg) WHERE len(ps) > 1),
            t AS (SELECT l.rec_id, l.seg, y.x - z.x AS dev FROM lasts l JOIN segs y ON y.rec_id = l.rec_id AND y.seg = l.seg AND y.i = later
                  JOIN segs z ON z.rec_id = l.rec_id AND z.seg = l.seg AND z.i = b)
            SELECT rec_id, seg, round(coalesce(dev, 0.0), {R}) + 0.0 AS deviation {_LEFT} t USING (rec_id, seg)""",
    ),
    "wavelet_energy": (wavelet_energy, _wavelet_sql()),
    "roughness": (
        roughness,
        f"""WITH {SEGMENTS}, st AS (SELECT rec_id, seg, x - lag(x) OVER (PARTITION BY rec_id, seg ORDER BY i) AS d FROM segs)
            SELECT rec_id, seg, round(avg(abs(d)), {R}) + 0.0 AS mean_abs, round(sqrt(avg(d * d)), {R}) + 0.0 AS rms FROM st GROUP BY 1, 2""",
    ),
    "stream_roughness": (
        stream_roughness,
        f"""WITH {STREAM}, st AS (SELECT rec_id, value - lag(value) OVER (PARTITION BY rec_id ORDER BY s) AS d FROM stream)
            SELECT rec_id, round(avg(abs(d)), {R}) + 0.0 AS mean_abs, round(sqrt(avg(d * d)), {R}) + 0.0 AS rms FROM st GROUP BY 1""",
    ),
    "long_lead_features": (long_lead_features, _long_sql()),
    "feature_vector": (feature_vector, None),
    "feature_vector_width": (
        feature_vector_width,
        # 18 values and the bands of the wavelet: one, two from 14 samples, three from 28.
        f"""WITH {SEGMENTS}, ns AS (SELECT rec_id, seg, any_value(n) AS n FROM segs GROUP BY ALL)
            SELECT (CASE WHEN n < 14 THEN 19 WHEN n < 28 THEN 20 ELSE 21 END)::INT AS width, count(*) AS segments FROM ns GROUP BY 1""",
    ),
}
