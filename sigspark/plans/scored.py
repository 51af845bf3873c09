"""Queries on text scores and training logs."""
from pyspark.sql import functions as F

from sigspark.functions.arrays import rounded
from sigspark.operators import scoring
from sigspark.plans.bindings import EPOCH_START, PAIR, pair, table

R = 8


def _holed(spark, d):
    """Pairs in which every sixth reference or ninth hypothesis is empty, and each fifth hypothesis is the reference."""
    p = pair(spark, d)
    ref = F.when(F.col("pair_id") % 6 == 0, "").otherwise(F.col("ref"))
    hyp = F.when(F.col("pair_id") % 9 == 0, None).when(F.col("pair_id") % 5 == 0, F.col("ref")).otherwise(F.col("hyp"))
    return p.select("pair_id", ref.alias("ref"), hyp.alias("hyp"))


def pair_admission(spark, d):
    refs = _holed(spark, d).select("pair_id", F.col("ref").alias("text"))
    hyps = _holed(spark, d).select("pair_id", F.coalesce("hyp", F.lit("")).alias("text"))
    return scoring.admitted(scoring.pair_up(refs, hyps, "pair_id")).select("pair_id")


def exact_match(spark, d):
    return scoring.exact_match(_holed(spark, d)).select(rounded(F.col("value")).alias("value"))


def corpus_bleu(spark, d):
    return scoring.corpus_bleu(pair(spark, d)).select(rounded(F.col("value")).alias("value"))


def _scores(df):
    return df.select("pair_id", rounded(F.col("score"), R).alias("score"))


def sentence_bleu(spark, d):
    return _scores(scoring.sentence_bleu(pair(spark, d)))


def unigram_alignment(spark, d):
    return _scores(scoring.unigram_alignment(pair(spark, d)))


def stemmed_alignment(spark, d):
    """Half of the hypotheses get endings that their stems do not have."""
    p = pair(spark, d).withColumn("hyp", F.when(F.col("pair_id") % 2 == 0, F.regexp_replace("hyp", r"([a-z]{4,}) ", "$1ness ")).otherwise(F.col("hyp")))
    return _scores(scoring.unigram_alignment(p, stems=True))


def set_overlap_1(spark, d):
    return _scores(scoring.set_overlap(pair(spark, d), 1))


def set_overlap_2(spark, d):
    return _scores(scoring.set_overlap(pair(spark, d), 2))


def subsequence_overlap(spark, d):
    return _scores(scoring.subsequence_overlap(pair(spark, d)))


def metric_report(spark, d):
    r = scoring.report(pair(spark, d))
    return r.select("metric", "sub_metric", rounded(F.col("value")).alias("value"))


_GRAMS = f"""{PAIR},
orders AS (SELECT pair_id, r, h, n, len(r) AS lr, len(h) AS lh FROM pair, range(1, 5) t(n) WHERE len(r) > 0 AND len(h) > 0),
rg AS (SELECT pair_id, n, array_to_string(r[i:i + n - 1], ' ') AS g, count(*) AS c
       FROM (SELECT pair_id, n, r, unnest(range(1, lr - n + 2)) AS i FROM orders) GROUP BY ALL),
hg AS (SELECT pair_id, n, array_to_string(h[i:i + n - 1], ' ') AS g, count(*) AS c
       FROM (SELECT pair_id, n, h, unnest(range(1, lh - n + 2)) AS i FROM orders) GROUP BY ALL),
hits AS (SELECT hg.pair_id, hg.n, sum(least(hg.c, coalesce(rg.c, 0))) AS matched, sum(hg.c) AS total FROM hg LEFT JOIN rg USING (pair_id, n, g) GROUP BY ALL)"""
_CORPUS = f"""{_GRAMS},
per_n AS (SELECT n, (SELECT coalesce(sum(matched), 0) FROM hits WHERE hits.n = o.n) AS m, sum(greatest(lh - n + 1, 1)) AS t FROM orders o GROUP BY n),
sizes AS (SELECT sum(lr) AS r, sum(lh) AS h FROM orders WHERE n = 1),
corpus AS (SELECT CASE WHEN (SELECT m FROM per_n WHERE n = 1) = 0 THEN 0.0 ELSE
    (SELECT CASE WHEN h > r THEN 1.0 ELSE exp(1 - r / h::DOUBLE) END FROM sizes) *
    (SELECT exp(avg(ln(CASE WHEN m = 0 THEN 0.1::DOUBLE ELSE m END / t::DOUBLE))) FROM per_n) END AS value)"""
_SENTENCE = """
sent AS (SELECT pair_id, CASE WHEN max(matched) FILTER (n = 1) > 0 THEN
           any_value(CASE WHEN lh > lr THEN 1.0 ELSE exp(1 - lr / lh::DOUBLE) END) * exp(avg(ln(CASE WHEN matched = 0 THEN 0.1::DOUBLE ELSE matched END / total::DOUBLE)))
           ELSE 0.0 END AS score FROM orders JOIN hits USING (pair_id, n) WHERE n <= least(4, lr, lh) GROUP BY 1)"""
_ALIGN = """
lowered AS (SELECT pair_id, list_transform(r, lambda x: lower(x)) AS r, list_transform(h, lambda x: lower(x)) AS h FROM pair WHERE len(r) > 0 AND len(h) > 0),
rw AS (SELECT pair_id, i AS pos, r[i] AS w, row_number() OVER (PARTITION BY pair_id, r[i] ORDER BY i DESC) AS k FROM (SELECT pair_id, r, unnest(range(1, len(r) + 1)) AS i FROM lowered)),
hw AS (SELECT pair_id, i AS pos, h[i] AS w, row_number() OVER (PARTITION BY pair_id, h[i] ORDER BY i DESC) AS k FROM (SELECT pair_id, h, unnest(range(1, len(h) + 1)) AS i FROM lowered)),
al AS (SELECT hw.pair_id, hw.pos AS hp, rw.pos AS rp FROM hw JOIN rw USING (pair_id, w, k)),
ch AS (SELECT pair_id, CASE WHEN hp = lag(hp) OVER o + 1 AND rp = lag(rp) OVER o + 1 THEN 0 ELSE 1 END AS c FROM al WINDOW o AS (PARTITION BY pair_id ORDER BY hp)),
cm AS (SELECT pair_id, count(*)::DOUBLE AS m, sum(c) AS chunks FROM ch GROUP BY 1),
met AS (SELECT pair_id, coalesce((m / len(h)) * (m / len(r)) / (0.9::DOUBLE * (m / len(h)) + 0.1::DOUBLE * (m / len(r))) * (1 - 0.5::DOUBLE * pow(chunks / m, 3)), 0.0) AS score
        FROM lowered LEFT JOIN cm USING (pair_id))"""
_SETS = """
texts AS (SELECT pair_id, array_to_string(r, ' ') AS r, array_to_string(h, ' ') AS h FROM pair WHERE len(r) > 0 AND len(h) > 0),
flatw AS (SELECT pair_id, flatten(list_transform(list_filter(string_split(r, '.'), lambda s: s <> ''), lambda s: string_split(trim(s), ' '))) AS r,
                 flatten(list_transform(list_filter(string_split(h, '.'), lambda s: s <> ''), lambda s: string_split(trim(s), ' '))) AS h FROM texts),
unis AS (SELECT pair_id, list_distinct(r) AS r, list_distinct(h) AS h FROM flatw),
bis AS (SELECT pair_id, list_distinct(list_transform(range(1, len(r)), lambda i: r[i] || ' ' || r[i + 1])) AS r,
               list_distinct(list_transform(range(1, len(h)), lambda i: h[i] || ' ' || h[i + 1])) AS h FROM flatw)"""


def _set_sql(source):
    return f"""(SELECT pair_id, 2 * (p * q / (p + q + 1e-8)) AS score FROM (SELECT pair_id,
        CASE WHEN len(h) > 0 THEN len(list_intersect(h, r)) / len(h)::DOUBLE ELSE 0 END AS p,
        CASE WHEN len(r) > 0 THEN len(list_intersect(h, r)) / len(r)::DOUBLE ELSE 0 END AS q FROM {source}))"""


# --- statistics ------------------------------------------------------------
def seed_statistics(spark, d):
    labels = table(spark, d, "labels").withColumn("seed", F.col("doc_id") % 5)
    labels = labels.unpivot("seed", ["quality", "toxic"], "sub_metric", "value").withColumn("metric", F.lit("label"))
    s = scoring.seed_statistics(labels)
    return s.select("metric", "sub_metric", *[rounded(F.col(c), 6).alias(c) for c in ("mean", "std", "lo", "hi")])


def _log(spark, d):
    e = table(spark, d, "events")
    hours = F.timestamp_diff("HOUR", F.lit("2024-01-01").cast("timestamp_ntz"), F.col("ts"))
    return e.select(F.col("event_type").alias("run"), hours.alias("epoch"), F.col("event_id").alias("step"), F.col("value").alias("loss"))


_LOG = f"log AS (SELECT event_type AS run, floor((epoch(ts) - {EPOCH_START}) / 3600)::BIGINT AS epoch, event_id AS step, value AS loss FROM events)"


def epoch_losses(spark, d):
    return scoring.epoch_losses(_log(spark, d), 4, 0.5).withColumn("loss", rounded(F.col("loss"), 6))


def saved_steps(spark, d):
    return scoring.saved_steps(_log(spark, d), 5).select("run", "epoch", "step")


PLANS = {
    "pair_admission": (
        pair_admission,
        f"WITH {PAIR} SELECT pair_id FROM pair WHERE pair_id % 6 <> 0 AND pair_id % 9 <> 0 AND len(r) > 0 AND (len(h) > 0 OR pair_id % 5 = 0)",
    ),
    "exact_match": (
        exact_match,
        f"""WITH {PAIR} SELECT round(avg(CASE WHEN pair_id % 5 = 0 OR r = h THEN 1.0::DOUBLE ELSE 0 END), {R}) + 0.0 AS value FROM pair
            WHERE pair_id % 6 <> 0 AND pair_id % 9 <> 0 AND len(r) > 0 AND (len(h) > 0 OR pair_id % 5 = 0)""",
    ),
    "corpus_bleu": (corpus_bleu, f"WITH {_CORPUS} SELECT round(value, {R}) + 0.0 AS value FROM corpus"),
    "sentence_bleu": (sentence_bleu, f"WITH {_GRAMS}, {_SENTENCE} SELECT pair_id, round(score, {R}) + 0.0 AS score FROM sent"),
    "stemmed_alignment": (stemmed_alignment, None),
    "unigram_alignment": (unigram_alignment, f"WITH {PAIR}, {_ALIGN} SELECT pair_id, round(score, {R}) + 0.0 AS score FROM met"),
    "set_overlap_1": (set_overlap_1, f"WITH {PAIR}, {_SETS} SELECT pair_id, round(score, {R}) + 0.0 AS score FROM {_set_sql('unis')}"),
    "set_overlap_2": (set_overlap_2, f"WITH {PAIR}, {_SETS} SELECT pair_id, round(score, {R}) + 0.0 AS score FROM {_set_sql('bis')}"),
    "subsequence_overlap": (subsequence_overlap, None),
    "metric_report": (metric_report, None),
    "seed_statistics": (
        seed_statistics,
        f"""WITH m AS (SELECT doc_id % 5 AS seed, 'quality' AS sub_metric, quality AS v FROM labels UNION ALL SELECT doc_id % 5, 'toxic', toxic FROM labels),
            p AS (SELECT seed, sub_metric, avg(v) * 100 AS v FROM m GROUP BY ALL),
            s AS (SELECT sub_metric, avg(v) AS mean, stddev_samp(v) AS std, count(*) AS n FROM p GROUP BY 1)
            SELECT 'label' AS metric, sub_metric, round(mean, 6) + 0.0 AS mean, round(std, 6) + 0.0 AS std,
                   round(mean - 2.7764451051977987::DOUBLE * std / sqrt(n), 6) + 0.0 AS lo, round(mean + 2.7764451051977987::DOUBLE * std / sqrt(n), 6) + 0.0 AS hi FROM s""",
    ),
    "epoch_losses": (
        epoch_losses,
        f"""WITH {_LOG}, e AS (SELECT run, epoch, avg(loss) AS loss FROM log GROUP BY ALL)
            SELECT run, epoch, round(loss, 6) + 0.0 AS loss,
                   coalesce(loss < min(loss) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS is_best,
                   coalesce(min(loss) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) >
                            min(loss) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 4 PRECEDING) - 0.5::DOUBLE, false) AS stop FROM e""",
    ),
    "saved_steps": (
        saved_steps,
        f"""WITH {_LOG}, n AS (SELECT *, row_number() OVER (PARTITION BY run, epoch ORDER BY step) - 1 AS nth, count(*) OVER (PARTITION BY run, epoch) AS steps FROM log)
            SELECT run, epoch, step FROM n WHERE nth % greatest(steps // 5, 1) = 0""",
    ),
}
