"""Queries on embedding spaces."""
from pyspark.sql import functions as F

from sigspark.functions.arrays import rounded, unrolled
from sigspark.functions.session import cut_lineage
from sigspark.operators import alignment
from sigspark.plans.bindings import FEATS, REC, feats, rec, table

R = 7
K = 10


def normalised_rows(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double") * 5).alias("v"))
    unit = unrolled(v, ["vec_id"], alignment.l2_normalised(F.col("v")), "x", "i")
    return unit.withColumn("x", rounded(F.col("x"), R))


def _states(spark, d):
    """Two layers, four positions, eight dimensions; the first ``label % 5`` positions are valid."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("row"), "label", F.col("embedding").cast("array<double>").alias("v"))
    parts = [
        F.struct(F.lit(layer).alias("layer"), F.lit(pos).alias("pos"), F.slice("v", layer * 32 + pos * 8 + 1, 8).alias("vector"))
        for layer in range(2)
        for pos in range(4)
    ]
    s = unrolled(e, ["row", "label"], F.array(*parts), "s").select("row", "label", "s.*")
    return s.withColumn("mask", F.when(F.col("pos") < F.col("label") % 5, 1).otherwise(0)).withColumn("signal_pos", F.col("label") % 4)


_STATES = f"""{REC},
states AS (SELECT rec_id AS "row", label, (i // 32)::INT AS layer, ((i % 32) // 8)::INT AS pos, (i % 8)::INT AS dim, v[i + 1] AS x,
                  CASE WHEN (i % 32) // 8 < label % 5 THEN 1 ELSE 0 END AS m FROM rec, range(64) t(i))"""


def _dims(df):
    out = unrolled(df, ["row"], F.col("vector"), "x", "dim")
    return out.withColumn("x", rounded(F.col("x"), R))


def masked_pooling(spark, d):
    return _dims(alignment.pooled(_states(spark, d), 2))


def text_pooling(spark, d):
    return _dims(alignment.pooled(_states(spark, d), 2, "signal_pos"))


def signal_position_pick(spark, d):
    return _dims(alignment.signal_states(_states(spark, d), 2, "signal_pos"))


# --- neighbours ------------------------------------------------------------
def nearest_neighbours(spark, d):
    n = alignment.neighbours(feats(spark, d), K)
    return n.select("space", "id", "rank", "other", rounded(F.col("sim"), R).alias("sim"))


def _knn(spark, d, k=K):
    """Neighbour lists, written once because the scores read them several times."""
    return cut_lineage(alignment.neighbours(feats(spark, d), k))


def _value(df):
    return df.select(rounded(F.col("value"), R).alias("value"))


def cycle_knn(spark, d):
    return _value(alignment.cycle_knn(_knn(spark, d)))


def mutual_knn(spark, d):
    return _value(alignment.mutual_knn(_knn(spark, d), K))


def lcs_knn(spark, d):
    return _value(alignment.lcs_knn(_knn(spark, d)))


def edit_distance_knn(spark, d):
    return _value(alignment.edit_distance_knn(_knn(spark, d), K))


_SIMS = f"""{FEATS},
sims AS (SELECT x.id, y.id AS other, list_dot_product(x.a, y.a) AS sa, list_dot_product(x.b, y.b) AS sb FROM feats x JOIN feats y ON x.id <> y.id),
ka AS (SELECT * FROM (SELECT id, other, sa AS sim, row_number() OVER (PARTITION BY id ORDER BY round(sa, 9) DESC, other) AS rank FROM sims) WHERE rank <= {K}),
kb AS (SELECT * FROM (SELECT id, other, sb AS sim, row_number() OVER (PARTITION BY id ORDER BY round(sb, 9) DESC, other) AS rank FROM sims) WHERE rank <= {K})"""
_EDIT = f"""WITH {_SIMS}, la AS (SELECT id, list(other ORDER BY rank) AS a FROM ka GROUP BY 1), lb AS (SELECT id, list(other ORDER BY rank) AS b FROM kb GROUP BY 1),
e AS (SELECT id, a, b, list_distinct(list_concat(a, b)) AS u FROM la JOIN lb USING (id)),
w AS (SELECT array_to_string(list_transform(a, lambda x: chr(64 + list_position(u, x)::INT)), '') AS a,
             array_to_string(list_transform(b, lambda x: chr(64 + list_position(u, x)::INT)), '') AS b FROM e)"""


# --- kernels ---------------------------------------------------------------
def cka_linear(spark, d):
    return _value(alignment.cka_linear(feats(spark, d)))


def cka_linear_unbiased(spark, d):
    return _value(alignment.cka_linear(feats(spark, d), unbiased=True))


def cka_rbf(spark, d):
    return _value(alignment.cka_rbf(feats(spark, d)))


def cka_rbf_unbiased(spark, d):
    return _value(alignment.cka_rbf(feats(spark, d), unbiased=True))


def _hsic_sql(kernel, unbiased):
    """Kernel alignment over whole kernels, from the defining formulas."""
    k, l = kernel
    grid = f"{FEATS}, grid AS (SELECT x.id AS i, y.id AS j, {k} AS k, {l} AS l FROM feats x, feats y), n AS (SELECT count(*)::DOUBLE AS n FROM feats)"
    if unbiased:
        return f"""WITH {grid}, z AS (SELECT i, j, CASE WHEN i = j THEN 0 ELSE k END AS k, CASE WHEN i = j THEN 0 ELSE l END AS l FROM grid),
r AS (SELECT i, sum(k) AS k, sum(l) AS l FROM z GROUP BY 1),
t AS (SELECT (SELECT sum(k * l) FROM z) AS kl, (SELECT sum(k * k) FROM z) AS kk, (SELECT sum(l * l) FROM z) AS ll, sum(k) AS sk, sum(l) AS sl,
             sum(k * l) AS ckl, sum(k * k) AS ckk, sum(l * l) AS cll FROM r),
h AS (SELECT (kl + sk * sl / ((n - 1) * (n - 2)) - 2 * ckl / (n - 2)) / (n * (n - 3)) AS kl,
             (kk + sk * sk / ((n - 1) * (n - 2)) - 2 * ckk / (n - 2)) / (n * (n - 3)) AS kk,
             (ll + sl * sl / ((n - 1) * (n - 2)) - 2 * cll / (n - 2)) / (n * (n - 3)) AS ll FROM t, n)
SELECT round(kl / (sqrt(kk * ll) + 1e-6), {R}) + 0.0 AS value FROM h"""
    return f"""WITH {grid},
c AS (SELECT i, j, k - avg(k) OVER (PARTITION BY i) - avg(k) OVER (PARTITION BY j) + avg(k) OVER () AS k,
             l - avg(l) OVER (PARTITION BY i) - avg(l) OVER (PARTITION BY j) + avg(l) OVER () AS l FROM grid)
SELECT round(sum(k * l) / (sqrt(sum(k * k) * sum(l * l)) + 1e-6), {R}) + 0.0 AS value FROM c"""


_LINEAR = ("list_dot_product(x.a, y.a)", "list_dot_product(x.b, y.b)")
_RBF = tuple(f"exp(-greatest(list_dot_product(x.{s}, x.{s}) + list_dot_product(y.{s}, y.{s}) - 2 * list_dot_product(x.{s}, y.{s}), 0) / 2)" for s in "ab")


def cknna(spark, d):
    rows = feats(spark, d).agg(F.count("*").cast("double")).scalar()
    return _value(alignment.cknna(_knn(spark, d), rows, K))


def cknna_distance_agnostic(spark, d):
    rows = feats(spark, d).agg(F.count("*").cast("double")).scalar()
    return _value(alignment.cknna(_knn(spark, d), rows, K, distance_agnostic=True))


def _cknna_sql():
    def hsic(name, source):
        return f"""{name}_e AS ({source}),
{name} AS (SELECT ((SELECT coalesce(sum(p.x * q.y), 0) FROM {name}_e p JOIN {name}_e q ON p.i = q.j AND p.j = q.i)
    + (SELECT sum(x) FROM {name}_e) * (SELECT sum(y) FROM {name}_e) / ((n - 1) * (n - 2))
    - 2 * (SELECT sum(cx * ry) FROM (SELECT j AS node, sum(x) AS cx FROM {name}_e GROUP BY 1) JOIN (SELECT i AS node, sum(y) AS ry FROM {name}_e GROUP BY 1) USING (node)) / (n - 2))
    / (n * (n - 3)) AS v FROM n)"""

    return f"""WITH {_SIMS}, n AS (SELECT count(*)::DOUBLE AS n FROM feats),
{hsic("ab", "SELECT ka.id AS i, ka.other AS j, ka.sim AS x, kb.sim AS y FROM ka JOIN kb USING (id, other)")},
{hsic("aa", "SELECT id AS i, other AS j, sim AS x, sim AS y FROM ka")}, {hsic("bb", "SELECT id AS i, other AS j, sim AS x, sim AS y FROM kb")}
SELECT round((SELECT v FROM ab) / (sqrt((SELECT v FROM aa) * (SELECT v FROM bb)) + 1e-6), {R}) + 0.0 AS value"""


def svcca(spark, d):
    return _value(alignment.svcca(feats(spark, d)))


# --- outliers, losses, overrides -------------------------------------------
def outlier_clamp_exact(spark, d):
    f = feats(spark, d)
    c = unrolled(alignment.clamped(f, "a", 0.9, exact=True), ["id"], F.col("a"), "x", "i")
    return c.withColumn("x", rounded(F.col("x"), R))


def outlier_clamp_rows(spark, d):
    f = feats(spark, d)
    c = unrolled(alignment.clamped(f, "a", 0.9), ["id"], F.col("a"), "x", "i")
    return c.withColumn("x", rounded(F.col("x"), R))


def metric_sweep(spark, d):
    s = alignment.sweep(feats(spark, d), K)
    return s.select("metric", rounded(F.col("score"), R).alias("score"))


def contrastive_loss(spark, d):
    return _value(alignment.contrastive_loss(feats(spark, d)))


def vector_override(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("row"), "label", F.col("embedding").cast("array<double>").alias("v"))
    parts = F.array(*[F.slice("v", p * 8 + 1, 8) for p in range(8)])
    states = unrolled(e, ["row"], parts, "vector", "pos")
    pos = F.when(F.col("row") % 7 == 0, alignment.PAD).otherwise((F.col("label") % 8).cast("int"))
    new = F.when(F.col("row") % 5 == 0, F.array_repeat(F.lit(0.0), 8)).otherwise(F.array_repeat(F.col("row") + F.lit(0.5), 8))
    out = alignment.overridden(states, e.select("row", pos.alias("pos"), new.alias("vector")), 8)
    dims = unrolled(out, ["row", "pos"], F.col("vector"), "x", "dim")
    return dims.withColumn("x", rounded(F.col("x"), R))


def adaptive_pooling(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    bins = unrolled(v, ["vec_id"], alignment.adaptive_pool(F.col("v"), 5), "x", "bin")
    return bins.withColumn("x", rounded(F.col("x"), R))


def lead_mean_pooling(spark, d):
    r = rec(spark, d)
    bins = unrolled(r, ["rec_id"], alignment.adaptive_pool(alignment.lead_mean(F.col("ecg")), 3), "x", "bin")
    return bins.withColumn("x", rounded(F.col("x"), R))


_CLAMP = """WITH {feats}, e AS (SELECT id, (i - 1)::INT AS i, a[i] AS x FROM feats, range(1, 33) t(i)), lim AS ({limit})
SELECT id, i, round(greatest(least(x, q), -q), {r}) + 0.0 AS x FROM e, lim"""

PLANS = {
    "normalised_rows": (
        normalised_rows,
        f"""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * 5) AS v FROM embeddings)
            SELECT vec_id, i::INT AS i, round(v[i + 1] / greatest(sqrt(list_dot_product(v, v)), 1e-12), {R}) + 0.0 AS x FROM e, range(64) t(i)""",
    ),
    "masked_pooling": (
        masked_pooling,
        f"""WITH {_STATES} SELECT "row", dim, round(sum(x * m) / 2 / greatest(sum(m) / 2.0::DOUBLE, 1), {R}) + 0.0 AS x FROM states GROUP BY 1, 2""",
    ),
    "text_pooling": (
        text_pooling,
        f"""WITH {_STATES} SELECT "row", dim, round(sum(x * m) / 2 / greatest(sum(m) / 2.0::DOUBLE, 1), {R}) + 0.0 AS x FROM states
            WHERE pos <> label % 4 GROUP BY 1, 2""",
    ),
    "signal_position_pick": (
        signal_position_pick,
        f"""WITH {_STATES} SELECT "row", dim, round(avg(x), {R}) + 0.0 AS x FROM states WHERE pos = label % 4 GROUP BY 1, 2""",
    ),
    "nearest_neighbours": (
        nearest_neighbours,
        f"""WITH {_SIMS} SELECT 'a' AS space, id, rank::INT AS rank, other, round(sim, {R}) + 0.0 AS sim FROM ka
            UNION ALL SELECT 'b', id, rank::INT, other, round(sim, {R}) + 0.0 FROM kb""",
    ),
    "cycle_knn": (
        cycle_knn,
        f"""WITH {_SIMS}, h AS (SELECT DISTINCT kb.id FROM kb JOIN ka ON ka.id = kb.other AND ka.other = kb.id)
            SELECT round((SELECT count(*) FROM h) / (SELECT count(*) FROM feats)::DOUBLE, {R}) + 0.0 AS value""",
    ),
    "mutual_knn": (
        mutual_knn,
        f"""WITH {_SIMS} SELECT round((SELECT count(*) FROM ka JOIN kb USING (id, other)) / {K}.0::DOUBLE / (SELECT count(*) FROM feats), {R}) + 0.0 AS value""",
    ),
    "lcs_knn": (
        lcs_knn,
        # Lists without repeats: the longest common subsequence is the longest rising run of places, here (place, length) pairs.
        f"""WITH {_SIMS}, la AS (SELECT id, list(other ORDER BY rank) AS a FROM ka GROUP BY 1), lb AS (SELECT id, list(other ORDER BY rank) AS b FROM kb GROUP BY 1),
            p AS (SELECT id, list_transform(list_filter(a, lambda x: list_contains(b, x)), lambda x: [[list_position(b, x)::INT, 0]]) AS places FROM la JOIN lb USING (id)),
            r AS (SELECT id, list_reduce(places, lambda acc, x: list_append(acc, [x[1][1], 1 + coalesce(list_max(list_transform(
                list_filter(acc, lambda y: y[1] < x[1][1]), lambda y: y[2])), 0)]), []::INT[][]) AS runs FROM p)
            SELECT round(avg(coalesce(list_max(list_transform(runs, lambda y: y[2])), 0)), {R}) + 0.0 AS value FROM r""",
    ),
    "edit_distance_knn": (
        edit_distance_knn,
        f"{_EDIT} SELECT round(1 - avg(levenshtein(a, b)) / {K}.0::DOUBLE, {R}) + 0.0 AS value FROM w",
    ),
    "cka_linear": (cka_linear, _hsic_sql(_LINEAR, False)),
    "cka_linear_unbiased": (cka_linear_unbiased, _hsic_sql(_LINEAR, True)),
    "cka_rbf": (cka_rbf, _hsic_sql(_RBF, False)),
    "cka_rbf_unbiased": (cka_rbf_unbiased, _hsic_sql(_RBF, True)),
    "cknna": (cknna, _cknna_sql()),
    "cknna_distance_agnostic": (
        cknna_distance_agnostic,
        f"""WITH {_SIMS} SELECT round((SELECT count(*) FROM ka JOIN kb USING (id, other))
            / (sqrt((SELECT count(*) FROM ka)::DOUBLE * (SELECT count(*) FROM kb)) + 1e-6), {R}) + 0.0 AS value""",
    ),
    "svcca": (svcca, None),
    "outlier_clamp_exact": (
        outlier_clamp_exact,
        _CLAMP.format(feats=FEATS, r=R, limit="""SELECT x AS q FROM (SELECT abs(x) AS x, row_number() OVER (ORDER BY abs(x)) - 1 AS rn FROM e)
            WHERE rn = (SELECT floor(count(*) * 0.9::DOUBLE) FROM e)"""),
    ),
    "outlier_clamp_rows": (
        outlier_clamp_rows,
        _CLAMP.format(feats=FEATS, r=R, limit="SELECT avg(q) AS q FROM (SELECT quantile_cont(abs(x), 0.9) AS q FROM e GROUP BY id)"),
    ),
    "metric_sweep": (metric_sweep, None),
    "contrastive_loss": (
        contrastive_loss,
        f"""WITH {FEATS}, s AS (SELECT x.id AS i, y.id AS j, list_dot_product(x.a, y.b) / 0.07::DOUBLE AS v FROM feats x, feats y),
            r AS (SELECT avg(l) AS l FROM (SELECT ln(sum(exp(v))) AS l FROM s GROUP BY i)), c AS (SELECT avg(l) AS l FROM (SELECT ln(sum(exp(v))) AS l FROM s GROUP BY j))
            SELECT round(r.l + c.l - 2 * (SELECT avg(v) FROM s WHERE i = j), {R}) + 0.0 AS value FROM r, c""",
    ),
    "vector_override": (
        vector_override,
        f"""SELECT vec_id AS "row", (i // 8)::INT AS pos, (i % 8)::INT AS dim,
            round(CASE WHEN i // 8 = label % 8 AND vec_id % 7 <> 0 AND vec_id % 5 <> 0 THEN vec_id + 0.5 ELSE embedding[i + 1]::DOUBLE END, {R}) + 0.0 AS x
            FROM embeddings, range(64) t(i)""",
    ),
    "adaptive_pooling": (
        adaptive_pooling,
        f"""SELECT vec_id, b::INT AS bin, round(avg(embedding[i + 1]::DOUBLE), {R}) + 0.0 AS x FROM embeddings, range(5) t(b), range(64) u(i)
            WHERE i >= b * 64 // 5 AND i < ceil((b + 1) * 64 / 5.0) GROUP BY 1, 2""",
    ),
    "lead_mean_pooling": (
        lead_mean_pooling,
        f"""WITH {REC} SELECT rec_id, b::INT AS bin, round(avg(x), {R}) + 0.0 AS x FROM samples, range(3) t(b)
            WHERE s >= b * 16 // 3 AND s < ceil((b + 1) * 16 / 3.0) GROUP BY 1, 2""",
    ),
}
