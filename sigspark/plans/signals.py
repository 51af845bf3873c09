"""Queries on signal operators."""
import numpy as np
from pyspark.sql import functions as F

from sigspark.functions.arrays import mean, rounded, unrolled
from sigspark.operators import signal
from sigspark.plans.bindings import LEADS, REC, SAMPLES, STREAM, rec, stream_samples, table

R = 8


def _long(df, array, out="x", keep=("rec_id",)):
    """lead, s, value rows of a recording column."""
    leads = unrolled(df, keep, F.col(array), "_lead", "lead")
    samples = unrolled(leads, [*keep, "lead"], F.col("_lead"), "_x", "s")
    return samples.select(*keep, "lead", "s", rounded(F.col("_x"), R).alias(out))


# --- admission -------------------------------------------------------------
_RULES = {"mimic": (500, 16, 4), "code15": (400, 16, 4), "cpsc": (500, None, None)}


def _mixed(spark, d):
    r = rec(spark, d)
    corpus = F.element_at(F.array(*map(F.lit, ["mimic", "code15", "cpsc", "other"])), (F.col("label") % 4 + 1).cast("int"))
    rate = F.when(F.col("label") % 4 == 1, 400).when(F.col("rec_id") % 9 == 0, 250).otherwise(500)
    cut = F.when(F.col("rec_id") % 7 == 0, F.transform("ecg", lambda x: F.slice(x, 1, 12)))
    cut = cut.when(F.col("rec_id") % 11 == 0, F.slice("ecg", 1, 3)).otherwise(F.col("ecg"))
    return r.select("rec_id", corpus.alias("base_data"), rate.alias("orig_sf"), cut.alias("ecg"))


_MIXED = """
mixed AS (SELECT rec_id, ['mimic', 'code15', 'cpsc', 'other'][label % 4 + 1] AS base_data,
                 CASE WHEN label % 4 = 1 THEN 400 WHEN rec_id % 9 = 0 THEN 250 ELSE 500 END AS sf,
                 CASE WHEN rec_id % 7 = 0 THEN 12 ELSE 16 END AS n,
                 CASE WHEN rec_id % 7 <> 0 AND rec_id % 11 = 0 THEN 3 ELSE 4 END AS leads FROM rec),
judged AS (SELECT rec_id, base_data, CASE
    WHEN base_data = 'other' THEN 'unknown corpus'
    WHEN sf <> (CASE base_data WHEN 'code15' THEN 400 ELSE 500 END) THEN 'sampling rate'
    WHEN base_data <> 'cpsc' AND leads <> 4 THEN 'leads'
    WHEN base_data <> 'cpsc' AND n <> 16 THEN 'samples' END AS refusal FROM mixed)"""


def admission_gate(spark, d):
    admitted, refused = signal.admit(_mixed(spark, d), _RULES)
    kept = admitted.select("rec_id", "base_data", F.lit("admitted").alias("outcome"))
    return kept.unionByName(refused.select("rec_id", "base_data", F.col("refusal").alias("outcome")))


def admission_outcome_counts(spark, d):
    return signal.admission_counts(_mixed(spark, d), _RULES)


# --- lead order ------------------------------------------------------------
_SOURCES = {"mimic": ["I", "II", "aVR", "aVL"], "code15": ["aVL", "aVR", "I", "II"]}
_TARGET = ["I", "II", "aVL", "aVR"]


def lead_reorder(spark, d):
    corpus = F.when(F.col("label") % 3 == 0, "mimic").when(F.col("label") % 3 == 1, "code15").otherwise("ptb")
    moved = signal.reordered(F.col("ecg"), corpus, _SOURCES, _TARGET)
    return _long(rec(spark, d).withColumn("ecg", moved), "ecg")


_REORDER = f"""WITH {REC},
moves(kind, lead, src) AS (VALUES (0, 0, 0), (0, 1, 1), (0, 2, 3), (0, 3, 2), (1, 0, 2), (1, 1, 3), (1, 2, 0), (1, 3, 1),
                           (2, 0, 0), (2, 1, 1), (2, 2, 2), (2, 3, 3))
SELECT rec_id, m.lead, s, round(x, {R}) + 0.0 AS x FROM samples JOIN moves m ON m.kind = label % 3 AND m.src = samples.lead"""


# --- resampling ------------------------------------------------------------
def resample(spark, d):
    at_half = rec(spark, d).withColumn("orig_sf", F.lit(16)).withColumn("ecg", signal.resampled(10))
    leads = unrolled(at_half, ["rec_id"], F.col("ecg"), "_lead", "lead")
    samples = unrolled(leads, ["rec_id", "lead"], F.col("_lead"), "x", "s")
    return samples.withColumn("x", rounded(F.col("x"), 5))


def _spline_weights(n, m):
    """Dense spline matrix from the defining equations, independent of the sweep used by the operator."""
    a, b = np.zeros((n, n)), np.zeros((n, n))
    a[0, :3] = a[-1, -3:] = [1, -2, 1]
    for i in range(1, n - 1):
        a[i, i - 1 : i + 2], b[i, i - 1 : i + 2] = [1, 4, 1], [6, -12, 6]
    curve = np.linalg.solve(a, b)
    out = np.zeros((m, n))
    for i in range(m):
        u = i * (n - 1) / (m - 1)
        k = min(int(u), n - 2)
        t = u - k
        out[i, k] += 1 - t
        out[i, k + 1] += t
        out[i] += (((1 - t) ** 3 - (1 - t)) * curve[k] + (t**3 - t) * curve[k + 1]) / 6
    return out


def _resample_sql():
    weights = _spline_weights(SAMPLES, 10)
    rows = ", ".join(f"({i}, {j}, {weights[i, j]!r}::DOUBLE)".replace("np.float64(", "").replace(")::", "::") for i in range(10) for j in range(SAMPLES))
    return f"""WITH {REC}, w(s, j, weight) AS (VALUES {rows})
SELECT rec_id, lead, w.s AS s, round(sum(x * weight)::FLOAT::DOUBLE, 5) + 0.0 AS x
FROM samples JOIN w ON w.j = samples.s GROUP BY rec_id, lead, w.s"""


# --- segments --------------------------------------------------------------
def stream_segmentation(spark, d):
    segs = signal.segment_samples(stream_samples(spark, d), "rec_id", "s", "value", 20)
    x = F.col("ecg")[0]
    return segs.select(
        "rec_id",
        "seg_idx",
        x[0].alias("first"),
        x[19].alias("last"),
        rounded(mean(x), R).alias("mean"),
    )


def array_segmentation(spark, d):
    return _long(signal.segment_recordings(rec(spark, d), 5), "ecg", keep=("rec_id", "seg_idx"))


def segment_shortfall(spark, d):
    """Recordings with the number of segments and of dropped samples; none is lost silently."""
    n = table(spark, d, "events").groupBy(F.col("user_id").alias("rec_id")).agg(F.count("*").alias("samples"))
    return n.select(
        "rec_id",
        "samples",
        F.floor(F.col("samples") / 60).alias("segments"),
        (F.col("samples") % 60).alias("dropped"),
    )


# --- repair ----------------------------------------------------------------
def _broken(spark, d):
    v = F.when(F.col("event_id") % 11 == 0, F.lit(float("nan"))).when(F.col("event_id") % 13 == 0, F.lit(float("inf")))
    v = v.when(F.col("event_id") % 17 == 0, F.lit(float("-inf"))).otherwise(F.col("value"))
    return table(spark, d, "events").select("event_id", "user_id", v.alias("value"))


_BROKEN = """WITH broken AS (SELECT event_id, user_id, event_id % 11 = 0 OR event_id % 13 = 0 OR event_id % 17 = 0 AS bad, value FROM events)"""


def sample_repair(spark, d):
    return _broken(spark, d).select("event_id", signal.repaired(F.col("value")).alias("value"))


def repair_counts(spark, d):
    bad = signal.is_broken(F.col("value"))
    return _broken(spark, d).groupBy("user_id").agg(F.count_if(bad).alias("repaired"), F.count("*").alias("samples"))


def validity_filter(spark, d):
    docs = table(spark, d, "documents").select(
        "doc_id",
        F.when(F.col("doc_id") % 5 == 0, "").when(F.col("doc_id") % 9 == 0, None).otherwise(F.col("text")).alias("report"),
        F.when(F.col("doc_id") % 4 == 0, F.array().cast("array<array<double>>"))
        .otherwise(F.array(F.array(F.col("n_chars").cast("double"))))
        .alias("ecg"),
    )
    return docs.filter(signal.is_valid(F.col("ecg"), F.col("report"))).select("doc_id", F.length("report").alias("report_chars"))


# --- layout ----------------------------------------------------------------
def transpose(spark, d):
    turned = rec(spark, d).withColumn("ecg", signal.transposed(F.col("ecg")))
    return _long(turned, "ecg").withColumnsRenamed({"lead": "time", "s": "lead"})


# --- amplitude -------------------------------------------------------------
_NORM = f"""{REC},
ranges AS (SELECT rec_id, list_min(v) AS lo, list_max(v) AS hi FROM rec),
norm AS (SELECT rec_id, lead, s, x, lo, hi, greatest(least((x - lo) / (hi - lo + 1e-6), 1.0::DOUBLE), 0.0::DOUBLE) AS y
         FROM samples JOIN ranges USING (rec_id)),
levels AS (SELECT *, least(floor(y * 26), 25)::INT AS q FROM norm)"""
SYMBOL_SQL = _NORM + """,
symbols AS (SELECT rec_id, string_agg(chr(97 + q), '' ORDER BY lead, s) AS symbols FROM levels GROUP BY rec_id)"""


def symbol_table(spark, d):
    """rec_id, lo, hi, norm, symbols of every recording."""
    return signal.with_normalised(rec(spark, d)).withColumn("symbols", signal.symbolised(F.col("norm")))


def normalise(spark, d):
    return _long(signal.with_normalised(rec(spark, d)), "norm")


def value_ranges(spark, d):
    return signal.with_normalised(rec(spark, d)).select("rec_id", rounded(F.col("lo")).alias("lo"), rounded(F.col("hi")).alias("hi"))


def denormalise(spark, d):
    n = signal.with_normalised(rec(spark, d))
    return _long(n.withColumn("back", signal.denormalised(F.col("norm"), F.col("lo"), F.col("hi"))), "back")


def quantise(spark, d):
    n = signal.with_normalised(rec(spark, d))
    n = unrolled(n, ["rec_id"], F.transform(F.flatten("norm"), signal.level), "level")
    return n.groupBy("rec_id", "level").agg(F.count("*").alias("n"))


def symbolise(spark, d):
    return symbol_table(spark, d).select("rec_id", "symbols")


def _restored(spark, d):
    back = signal.desymbolised(F.col("symbols"), F.lit(SAMPLES))
    s = symbol_table(spark, d).withColumn("levels", back)
    return s.withColumn("back", signal.denormalised(F.col("levels"), F.col("lo"), F.col("hi")))


def desymbolise(spark, d):
    return _long(_restored(spark, d), "back")


def round_trip_error(spark, d):
    r = _restored(spark, d)
    again = F.array_join(F.transform(F.flatten("levels"), lambda y: F.char(F.round(y * 25).cast("int") + 97)), "")
    return r.select(
        "rec_id",
        (again == F.col("symbols")).alias("same_symbols"),
        rounded(signal.max_abs_error(F.col("ecg"), F.col("back"))).alias("max_abs_err"),
    )


def zscore(spark, d):
    return _long(signal.zscored(rec(spark, d)), "zscore")


def lead_moments(spark, d):
    z = signal.zscored(rec(spark, d)).select("rec_id", F.posexplode(F.arrays_zip("mean", "std", "header")).alias("lead", "m"))
    return z.select("rec_id", "lead", rounded(F.col("m.mean")).alias("mean"), rounded(F.col("m.std")).alias("std"))


# --- perturbation ----------------------------------------------------------
def blackout(spark, d):
    return _long(rec(spark, d).withColumn("ecg", signal.blackout(F.col("ecg"))), "ecg")


def noise(spark, d):
    return _long(signal.with_noise(rec(spark, d), "rec_id"), "noisy")


def sql_uniform(text):
    return f"(('0x' || substring(md5({text}), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


_NOISE = f"""WITH {REC},
stats AS (SELECT rec_id, stddev_pop(x) AS sd, max(abs(x)) AS peak FROM samples GROUP BY rec_id),
coins AS (SELECT rec_id, sd, peak, {sql_uniform("'42:noise:' || rec_id")} < 0.5 AS noised,
                 {sql_uniform("'42:wander:' || rec_id")} < 0.5 AS wandered,
                 floor({sql_uniform("'42:half:' || rec_id")} * 5) + 1 AS half FROM stats),
drawn AS (SELECT rec_id, lead, s, x, sd, peak, noised, noised AND wandered AS wandered, half,
                 sqrt(-2.0::DOUBLE * ln(1.0::DOUBLE - {sql_uniform("concat_ws(':', '42:na', rec_id, lead, s)")}))
                 * cos(2.0 * pi() * {sql_uniform("concat_ws(':', '42:nb', rec_id, lead, s)")}) AS z
          FROM samples JOIN coins USING (rec_id))
SELECT rec_id, lead, s, round(CASE WHEN noised THEN x + z * 0.05::DOUBLE * sd
           + CASE WHEN wandered THEN 0.07::DOUBLE * peak * sin(half * pi() * (s / 15.0::DOUBLE)) ELSE 0 END
       ELSE x END, {R}) + 0.0 AS x FROM drawn"""


def channel_stack(spark, d):
    n = signal.with_normalised(rec(spark, d))
    levels = n.withColumn("stack", signal.stacked_levels(F.col("norm")))
    leads = unrolled(levels, ["rec_id"], F.col("stack"), "_l", "lead")
    px = unrolled(leads, ["rec_id", "lead"], F.col("_l"), "_p", "s")
    return unrolled(px, ["rec_id", "lead", "s"], F.col("_p"), "level", "channel").groupBy("rec_id", "channel").agg(
        F.sum("level").alias("total"), F.sum(F.col("level") * (F.col("lead") * 16 + F.col("s") + 1)).alias("weighted")
    )


# --- patches ---------------------------------------------------------------
def _patch_rows(r, layout, size):
    p = r.withColumn("p", signal.patches(F.col("ecg"), size, layout))
    if layout == "lead":
        p = unrolled(p, ["rec_id"], F.col("p"), "q", "lead")
    else:
        p = p.select("rec_id", F.lit(-1).alias("lead"), F.col("p").alias("q"))
    p = unrolled(p, ["rec_id", "lead"], F.col("q"), "_v", "patch")
    return unrolled(p, [F.lit(layout).alias("layout"), "rec_id", "lead", "patch"], F.col("_v"), "x", "pos")


def patchify(spark, d):
    r = signal.check_divides(rec(spark, d), 4)
    parts = [_patch_rows(r, "lead", 4), _patch_rows(r, "time", 4), _patch_rows(r, "group", 2)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).withColumn("x", rounded(F.col("x"), R))


_PATCHIFY = f"""WITH {REC}
SELECT 'lead' AS layout, rec_id, lead, s // 4 AS patch, s % 4 AS pos, round(x, {R}) + 0.0 AS x FROM samples
UNION ALL SELECT 'time', rec_id, -1, s // 4, (s % 4) * 4 + lead, round(x, {R}) + 0.0 FROM samples
UNION ALL SELECT 'group', rec_id, -1, lead // 2, (lead % 2) * 16 + s, round(x, {R}) + 0.0 FROM samples"""


def unpatchify(spark, d):
    out = None
    for layout, size in (("lead", 4), ("time", 4), ("group", 2)):
        parts = signal.patches(F.col("ecg"), size, layout)
        back = rec(spark, d).withColumn("ecg", signal.unpatched(parts, size, layout, LEADS))
        rows = _long(back, "ecg").withColumn("layout", F.lit(layout))
        out = rows if out is None else out.unionByName(rows)
    return out


def patch_sizes(spark, d):
    lengths = table(spark, d, "part").select((F.col("p_size") * 25).alias("length")).distinct()
    return lengths.select("length", signal.patch_size(F.col("length")).alias("patch_size"))


_PATCH_SIZES = """WITH lengths AS (SELECT DISTINCT p_size * 25 AS length FROM part),
factors AS (SELECT length, unnest(range(1, length + 1)) AS p FROM lengths),
ok AS (SELECT length, p, length // p BETWEEN 16 AND 64 AS fits FROM factors WHERE length % p = 0),
ranked AS (SELECT length, p, row_number() OVER (PARTITION BY length ORDER BY fits DESC,
    CASE WHEN fits THEN abs(length // p - 32) ELSE abs(p - floor(sqrt(length / 32.0))) END, p) AS rn FROM ok)
SELECT length, p::INT AS patch_size FROM ranked WHERE rn = 1"""


def patch_masking(spark, d):
    leads = rec(spark, d).select("rec_id", F.posexplode("ecg").alias("lead", "x"))
    m = leads.withColumn("m", signal.patch_mask(8, 0.75, 42, F.col("rec_id"), F.col("lead")))
    b = leads.withColumn("m", signal.bernoulli_mask(8, 0.75, "42b", F.col("rec_id"), F.col("lead")))
    both = m.select("rec_id", "lead", F.lit("lowest").alias("rule"), "m").unionByName(
        b.select("rec_id", "lead", F.lit("bernoulli").alias("rule"), "m")
    )
    return unrolled(both, ["rule", "rec_id", "lead"], F.col("m"), "mask", "patch")


_MASKS = f"""masks AS (SELECT rec_id, lead, patch, CASE WHEN row_number() OVER (
        PARTITION BY rec_id, lead ORDER BY md5(concat_ws(':', '42', rec_id, lead, patch)), patch) <= 2 THEN 0 ELSE 1 END AS mask,
    CASE WHEN {sql_uniform("concat_ws(':', '42b', rec_id, lead, patch)")} < 0.75 THEN 1 ELSE 0 END AS coin
  FROM (SELECT DISTINCT rec_id, lead, (s // 2)::INT AS patch FROM samples))"""


def masked_reconstruction_error(spark, d):
    leads = rec(spark, d).select("rec_id", F.posexplode("ecg").alias("lead", "x"))
    leads = leads.withColumn("m", signal.patch_mask(8, 0.75, 42, F.col("rec_id"), F.col("lead")))
    leads = leads.withColumn("level", mean(F.col("x")))
    p = unrolled(leads, ["rec_id", "level", "m"], signal.regrouped(F.col("x"), F.lit(2)), "target", "patch")
    p = p.withColumn("pred", F.transform("target", lambda t: F.col("level"))).withColumn(
        "mask", F.element_at("m", F.col("patch") + 1)
    )
    p = p.withColumn("error", signal.patch_error(F.col("target"), F.col("pred")))
    p = p.withColumn("error_std", signal.patch_error(F.col("target"), F.col("pred"), standardise=True))
    return p.agg(
        rounded(signal.masked_error(p)).alias("loss"),
        rounded(signal.masked_error(p, "error_std")).alias("loss_standardised"),
        F.sum("mask").alias("removed"),
    )


_ERRORS = f"""WITH {REC}, {_MASKS},
preds AS (SELECT rec_id, lead, avg(x) AS level FROM samples GROUP BY ALL),
moments AS (SELECT rec_id, lead, s // 2 AS patch, avg(x) AS m, var_samp(x) AS v FROM samples GROUP BY ALL),
errors AS (SELECT k.rec_id, k.lead, k.patch, avg((level - x) ** 2) AS e, avg((level - (x - m) / sqrt(v + 1e-6)) ** 2) AS es
           FROM samples t JOIN preds USING (rec_id, lead) JOIN moments k ON k.rec_id = t.rec_id AND k.lead = t.lead AND k.patch = t.s // 2
           GROUP BY ALL)
SELECT round(sum(e * mask) / sum(mask), {R}) + 0.0 AS loss, round(sum(es * mask) / sum(mask), {R}) + 0.0 AS loss_standardised,
       sum(mask)::BIGINT AS removed FROM errors JOIN masks USING (rec_id, lead, patch)"""


def frequent_symbol_pairs(spark, d):
    from sigspark.operators import bpe

    clean = rec(spark, d).withColumn("ecg", signal.repaired_recording(F.col("ecg")))
    symbols = signal.with_normalised(clean).withColumn("symbols", signal.symbolised(F.col("norm")))
    return bpe.top_pairs(bpe.pair_counts(symbols, "symbols"), 20)


PAIRS_SQL = SYMBOL_SQL + """,
pairs AS (SELECT symbols[i] AS "left", symbols[i + 1] AS "right", count(*) AS n
          FROM symbols, range(1, 64) t(i) GROUP BY ALL)"""

PLANS = {
    "admission_gate": (admission_gate, f"WITH {REC}, {_MIXED} SELECT rec_id, base_data, coalesce(refusal, 'admitted') AS outcome FROM judged"),
    "admission_outcome_counts": (
        admission_outcome_counts,
        f"WITH {REC}, {_MIXED} SELECT base_data, count(*) FILTER (refusal IS NULL) AS processed, count(refusal) AS skipped FROM judged GROUP BY 1",
    ),
    "lead_reorder": (lead_reorder, _REORDER),
    "resample": (resample, _resample_sql()),
    "stream_segmentation": (
        stream_segmentation,
        f"""WITH {STREAM} SELECT rec_id, s // 20 AS seg_idx, arg_min(value, s) AS "first", arg_max(value, s) AS "last",
            round(avg(value), {R}) + 0.0 AS mean FROM stream GROUP BY 1, 2 HAVING count(*) = 20""",
    ),
    "array_segmentation": (
        array_segmentation,
        f"WITH {REC} SELECT rec_id, (s // 5)::INT AS seg_idx, lead, s % 5 AS s, round(x, {R}) + 0.0 AS x FROM samples WHERE s < 15",
    ),
    "segment_shortfall": (
        segment_shortfall,
        "SELECT user_id AS rec_id, count(*) AS samples, count(*) // 60 AS segments, count(*) % 60 AS dropped FROM events GROUP BY 1",
    ),
    "sample_repair": (sample_repair, _BROKEN + " SELECT event_id, CASE WHEN bad THEN 0.0 ELSE value END AS value FROM broken"),
    "repair_counts": (
        repair_counts,
        _BROKEN + " SELECT user_id, count(*) FILTER (bad) AS repaired, count(*) AS samples FROM broken GROUP BY 1",
    ),
    "validity_filter": (
        validity_filter,
        "SELECT doc_id, length(text)::INT AS report_chars FROM documents WHERE doc_id % 5 <> 0 AND doc_id % 9 <> 0 AND doc_id % 4 <> 0 AND text <> ''",
    ),
    "transpose": (transpose, f'WITH {REC} SELECT rec_id, s AS "time", lead, round(x, {R}) + 0.0 AS x FROM samples'),
    "normalise": (normalise, f"WITH {_NORM} SELECT rec_id, lead, s, round(y, {R}) + 0.0 AS x FROM norm"),
    "value_ranges": (value_ranges, f"WITH {_NORM} SELECT rec_id, round(lo, {R}) + 0.0 AS lo, round(hi, {R}) + 0.0 AS hi FROM ranges"),
    "denormalise": (denormalise, f"WITH {_NORM} SELECT rec_id, lead, s, round(y * (hi - lo) + lo, {R}) + 0.0 AS x FROM norm"),
    "quantise": (quantise, f"WITH {_NORM} SELECT rec_id, q AS level, count(*) AS n FROM levels GROUP BY 1, 2"),
    "symbolise": (symbolise, f"WITH {SYMBOL_SQL} SELECT rec_id, symbols FROM symbols"),
    "desymbolise": (desymbolise, f"WITH {_NORM} SELECT rec_id, lead, s, round(q / 25.0::DOUBLE * (hi - lo) + lo, {R}) + 0.0 AS x FROM levels"),
    "round_trip_error": (
        round_trip_error,
        f"""WITH {_NORM} SELECT rec_id, true AS same_symbols, round(max(abs(x - (q / 25.0::DOUBLE * (hi - lo) + lo))), {R}) + 0.0 AS max_abs_err
            FROM levels GROUP BY 1""",
    ),
    "zscore": (
        zscore,
        f"""WITH {REC}, m AS (SELECT rec_id, lead, avg(x) AS mu, stddev_pop(x) AS sd FROM samples GROUP BY ALL)
            SELECT rec_id, lead, s, round((x - mu) / CASE WHEN sd > 1e-6 THEN sd ELSE 1 END, {R}) + 0.0 AS x FROM samples JOIN m USING (rec_id, lead)""",
    ),
    "lead_moments": (
        lead_moments,
        f"WITH {REC} SELECT rec_id, lead, round(avg(x), {R}) + 0.0 AS mean, round(stddev_pop(x), {R}) + 0.0 AS std FROM samples GROUP BY 1, 2",
    ),
    "blackout": (blackout, f"WITH {REC} SELECT rec_id, lead, s, 0.0::DOUBLE AS x FROM samples"),
    "noise": (noise, _NOISE),
    "channel_stack": (
        channel_stack,
        f"""WITH {_NORM}, px AS (SELECT rec_id, lead, s, floor(y * 255)::INT AS level FROM norm)
            SELECT rec_id, channel, sum(level)::BIGINT AS total, sum(level * (lead * 16 + s + 1))::BIGINT AS weighted
            FROM px, (VALUES (0), (1), (2)) c(channel) GROUP BY 1, 2""",
    ),
    "patchify": (patchify, _PATCHIFY),
    "unpatchify": (
        unpatchify,
        f"""WITH {REC} SELECT layout, rec_id, lead, s, round(x, {R}) + 0.0 AS x
            FROM samples, (VALUES ('lead'), ('time'), ('group')) l(layout)""",
    ),
    "patch_sizes": (patch_sizes, _PATCH_SIZES),
    "patch_masking": (
        patch_masking,
        f"""WITH {REC}, {_MASKS} SELECT 'lowest' AS rule, rec_id, lead, patch, mask FROM masks
            UNION ALL SELECT 'bernoulli', rec_id, lead, patch, coin FROM masks""",
    ),
    "masked_reconstruction_error": (masked_reconstruction_error, _ERRORS),
    "frequent_symbol_pairs": (
        frequent_symbol_pairs,
        f'WITH {PAIRS_SQL} SELECT "left", "right", n FROM pairs ORDER BY n DESC, "left", "right" LIMIT 20',
    ),
}
