import numpy as np
import pytest
from pyspark.sql import functions as F

from sigspark.operators import alignment

N, K = 60, 5


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(11)
    a = rng.normal(size=(N, 6))
    b = a @ rng.normal(size=(6, 4)) + 0.5 * rng.normal(size=(N, 4))
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    return unit(a), unit(b)


@pytest.fixture(scope="module")
def frame(spark, data):
    return spark.createDataFrame(
        [(i, x.tolist(), y.tolist()) for i, (x, y) in enumerate(zip(*data))], "id bigint, a array<double>, b array<double>"
    ).repartition(5)


def value(df):
    return df.first()["value"]


def brute_knn(x):
    s = x @ x.T
    np.fill_diagonal(s, -np.inf)
    return np.argsort(-s, axis=1, kind="stable")[:, :K]


@pytest.fixture(scope="module", params=[7, 1000, None])
def knn(request, frame):
    return alignment.neighbours(frame, K, block_rows=request.param).cache()


def test_block_counts():
    assert alignment._block_count(10, 8) == 1
    assert alignment._block_count(100_000, 8) == 6
    assert alignment._block_count(10_000_000, 1000) == 306
    assert alignment._block_count(10_000_000, 8, 2 * 8192) == 9766  # 1024 rows of 128 KB each


def test_neighbours_in_blocks(knn, data):
    for space, x in zip("ab", data):
        got = np.zeros((N, K), dtype=int)
        for r in knn.filter(F.col("space") == space).collect():
            got[r["id"], r["rank"] - 1] = r["other"]
        assert np.array_equal(got, brute_knn(x))


def test_neighbour_scores(knn, data):
    ka, kb = map(brute_knn, data)
    assert value(alignment.mutual_knn(knn, K)) == pytest.approx(np.mean([len(set(x) & set(y)) / K for x, y in zip(ka, kb)]))
    assert value(alignment.cycle_knn(knn)) == pytest.approx(np.mean([(ka[kb[i]] == i).any() for i in range(N)]))

    def lcs(x, y):
        t = np.zeros((K + 1, K + 1), dtype=int)
        for i in range(K):
            for j in range(K):
                t[i + 1, j + 1] = t[i, j] + 1 if x[i] == y[j] else max(t[i, j + 1], t[i + 1, j])
        return t[K, K]

    assert value(alignment.lcs_knn(knn)) == pytest.approx(np.mean([lcs(x, y) for x, y in zip(ka, kb)]))


def kernels(data, kind):
    if kind == "linear":
        return [x @ x.T for x in data]
    return [np.exp(-((x[:, None] - x[None]) ** 2).sum(-1) / 2) for x in data]


def hsic(k, l, unbiased):
    n = len(k)
    if not unbiased:
        h = np.eye(n) - 1 / n
        return np.trace(k @ h @ l @ h)
    k, l = k - np.diag(np.diag(k)), l - np.diag(np.diag(l))
    return ((k * l.T).sum() + k.sum() * l.sum() / ((n - 1) * (n - 2)) - 2 * (k @ l).sum() / (n - 2)) / (n * (n - 3))


def ratio(k, l, unbiased):
    return hsic(k, l, unbiased) / (np.sqrt(hsic(k, k, unbiased) * hsic(l, l, unbiased)) + 1e-6)


@pytest.mark.parametrize("unbiased", [False, True])
def test_kernel_alignment(frame, data, unbiased):
    assert value(alignment.cka_linear(frame, unbiased)) == pytest.approx(ratio(*kernels(data, "linear"), unbiased), abs=1e-9)
    assert value(alignment.cka_rbf(frame, unbiased=unbiased, block_rows=9)) == pytest.approx(ratio(*kernels(data, "rbf"), unbiased), abs=1e-9)


def test_neighbour_kernel_alignment(knn, data):
    masks = []
    for x in data:
        m = np.zeros((N, N))
        np.put_along_axis(m, brute_knn(x), 1, axis=1)
        masks.append(m)
    k, l = kernels(data, "linear")
    part = lambda p, q, m: hsic(m * p, m * q, True)
    want = part(k, l, masks[0] * masks[1]) / (np.sqrt(part(k, k, masks[0]) * part(l, l, masks[1])) + 1e-6)
    assert value(alignment.cknna(knn, F.lit(float(N)), K)) == pytest.approx(want, abs=1e-9)
    with pytest.raises(ValueError):
        alignment.cknna(knn, F.lit(float(N)), 1)


def test_equal_and_rotated_spaces(frame, spark, data):
    a = data[0]
    turn = np.linalg.qr(np.random.default_rng(0).normal(size=(6, 6)))[0]
    rows = [(i, x.tolist(), (x @ turn).tolist()) for i, x in enumerate(a)]
    turned = spark.createDataFrame(rows, "id bigint, a array<double>, b array<double>")
    assert value(alignment.cka_linear(turned)) == pytest.approx(1.0, abs=1e-3)
    assert value(alignment.svcca(turned, 6)) == pytest.approx(1.0, abs=1e-6)
    same = frame.withColumn("b", F.col("a"))
    assert value(alignment.svcca(same, 3)) == pytest.approx(1.0, abs=1e-6)
    same_knn = alignment.neighbours(same, K)
    assert value(alignment.lcs_knn(same_knn)) == K and value(alignment.edit_distance_knn(same_knn, K)) == 1.0


def test_contrastive_loss_in_blocks(spark, data):
    b = data[0][:, ::-1] + 0.3 * data[0]
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    frame = spark.createDataFrame(
        [(i, x.tolist(), y.tolist()) for i, (x, y) in enumerate(zip(data[0], b))], "id bigint, a array<double>, b array<double>"
    )
    s = data[0] @ b.T / 0.07
    ce = lambda m: np.mean(np.log(np.exp(m).sum(axis=1)) - np.diag(m))
    for rows in (8, 1000):
        assert value(alignment.contrastive_loss(frame, block_rows=rows)) == pytest.approx(ce(s) + ce(s.T), abs=1e-9)


def test_clamp_limits(frame, data):
    flat = np.sort(np.abs(data[0]).ravel())
    assert value(alignment.clamp_limit(frame, "a", 0.8, exact=True)) == flat[int(0.8 * flat.size)]
    assert value(alignment.clamp_limit(frame, "a", 0.8)) == pytest.approx(np.quantile(np.abs(data[0]), 0.8, axis=1).mean())
    assert alignment.clamped(frame, "a", 1) is frame


def test_override_writes_only_its_positions(spark):
    rng = np.random.default_rng(0)
    states = [(b, t, rng.normal(size=5).tolist()) for b in range(3) for t in range(8)]
    idx = [[0, 3], [1, 5], [2, 6]]
    new = [(b, t, rng.normal(size=5).tolist()) for b in range(3) for t in idx[b]] + [(0, -2, [1.0] * 5), (1, 7, [0.0] * 5)]
    schema = "row bigint, pos int, vector array<double>"
    out = alignment.overridden(spark.createDataFrame(states, schema), spark.createDataFrame(new, schema), 8)
    want = {(b, t): v for b, t, v in states} | {(b, t): v for b, t, v in new[:6]}
    assert {(r["row"], r["pos"]): r["vector"] for r in out.collect()} == want
    with pytest.raises(Exception, match="outside"):
        alignment.overridden(spark.createDataFrame(states, schema), spark.createDataFrame([(0, 8, [1.0] * 5)], schema), 8).collect()


def test_blocks_of_several_chunks(spark):
    rng = np.random.default_rng(2)
    a, b = (m / np.linalg.norm(m, axis=1, keepdims=True) for m in rng.normal(size=(2, 1300, 4)))
    frame = spark.createDataFrame(
        [(i, x.tolist(), y.tolist()) for i, (x, y) in enumerate(zip(a, b))], "id bigint, a array<double>, b array<double>"
    )
    got = np.zeros((1300, K), dtype=int)
    for r in alignment.neighbours(frame, K, spaces=["b"], block_rows=1000).collect():
        got[r["id"], r["rank"] - 1] = r["other"]
    assert np.array_equal(got, brute_knn(b))
    assert value(alignment.cka_rbf(frame, block_rows=1000)) == pytest.approx(ratio(*kernels((a, b), "rbf"), False), abs=1e-9)
    s = a @ b.T / 0.07
    ce = lambda m: np.mean(np.log(np.exp(m).sum(axis=1)) - np.diag(m))
    assert value(alignment.contrastive_loss(frame, block_rows=1000)) == pytest.approx(ce(s) + ce(s.T), abs=1e-9)


@pytest.mark.parametrize("width", [1, 700, 32768, 3 << 20])
def test_a_product_does_not_grow_with_the_blocks(width):
    block = np.arange(1500.0).reshape(750, 2)
    pieces = list(alignment._chunks(block, width))
    assert all(len(x) * width <= alignment.CHUNK_CELLS or len(x) == 1 for _, x in pieces)
    assert np.array_equal(np.concatenate([x for _, x in pieces]), block)
    assert [start for start, _ in pieces] == np.cumsum([0, *(len(x) for _, x in pieces)])[:-1].tolist()


def unit(m):
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def vectors(kind, rng):
    x = unit(rng.normal(size=(2500, 8)))
    if kind == "copies":
        return x[rng.integers(0, 40, len(x))]
    if kind == "equal":
        return np.repeat(x[:1], len(x), axis=0)
    if kind == "close":
        return x[0] + 1e-6 * rng.normal(size=x.shape)
    if kind == "coarse":
        return np.round(x, 1)
    if kind == "scales":
        return x * 10.0 ** rng.integers(-5, 6, len(x))[:, None]
    if kind in ("tiny", "huge"):
        return x * (1e-200 if kind == "tiny" else 1e160)
    if kind == "gaps":
        x[rng.integers(0, len(x), 500)] = 0
        x[[3, 700]] = np.nan
        x[1400, 2] = np.inf
    return x


@pytest.mark.parametrize("kind", ["plain", "copies", "equal", "close", "coarse", "scales", "tiny", "huge", "gaps"])
def test_nearest_rows_of_a_block(kind):
    y = vectors(kind, np.random.default_rng(4))
    with np.errstate(invalid="ignore", over="ignore"):
        sim = np.einsum("id,jd->ij", y[:600], y)
    sim[np.arange(600), np.arange(600)] = -np.inf
    sim[~np.isfinite(sim)] = -np.inf
    order = np.argsort(-np.round(sim, alignment.TIE_DIGITS), axis=1, kind="stable")[:, :K] if kind != "huge" else None
    r, c, found = alignment._nearest(y[:600], y, K, np.arange(600))
    if order is None:  # every product overflows
        assert len(r) == 0
        return
    want = [(i, j) for i in range(600) for j in order[i] if np.isfinite(sim[i, j])]
    assert list(zip(r, c)) == want
    assert np.array_equal(found, sim[r, c])


def test_nearest_of_few_rows():
    y = unit(np.random.default_rng(5).normal(size=(4, 3)))
    r, c, _ = alignment._nearest(y, y, K, np.arange(4))
    assert sorted(zip(r, c)) == [(i, j) for i in range(4) for j in range(4) if i != j]
    for x, z in ((y, y[:0]), (y[:0], y)):
        assert not any(len(v) for v in alignment._nearest(x, z, K, np.full(len(x), -1)))


@pytest.mark.parametrize(("kind", "most"), [("plain", 0.02), ("copies", 0.1), ("equal", 0.3)])
def test_few_products_are_made_twice(kind, most, monkeypatch):
    """A further column is scored only where it may be a neighbour: not all pairs are ranked."""
    y = vectors(kind, np.random.default_rng(6)) if kind != "plain" else unit(np.random.default_rng(6).normal(size=(6000, 8)))
    scored, scores = [], alignment._scores
    monkeypatch.setattr(alignment, "_scores", lambda x, y, r, c: scored.append(len(r)) or scores(x, y, r, c))
    alignment._nearest(y[:1000], y, K, np.arange(1000))
    assert sum(scored) <= most * 1000 * len(y)


def test_pairs_of_blocks_are_not_joined_into_few_tasks(spark, frame):
    cells = alignment._space_cells(frame, ["a", "b"], 20)
    sizes = cells.groupBy("_s", "_i", "_j", F.spark_partition_id().alias("p")).count().collect()
    keys = {(r["_s"], r["_i"], r["_j"]) for r in sizes}
    assert len(keys) == len(sizes) == 2 * 3 * 3
    assert len({r["p"] for r in sizes}) > len(keys) / 2
    copies = cells.groupBy("_s", "id").count().select("count").distinct().collect()
    assert [r["count"] for r in copies] == [2 * 3 - 1]  # as a row and as a column, once where they are the same


def test_neighbours_of_odd_rows(spark):
    x = unit(np.random.default_rng(7).normal(size=(40, 4)))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows[8] = (8, [None, 1.0, 0.0, 0.0])
    schema = "id bigint, a array<double>"
    near = lambda r, n: alignment.neighbours(spark.createDataFrame(r, schema).repartition(3), K, ["a"], n)
    want = x @ x.T
    want[8] = want[:, 8] = -np.inf
    np.fill_diagonal(want, -np.inf)
    for n in (6, None):
        got = {(r["id"], r["rank"]): (r["other"], r["sim"]) for r in near(rows, n).collect()}
        assert len(got) == 39 * K and all(i != 8 for i, _ in got)
        assert all(j == np.argsort(-want[i], kind="stable")[k - 1] and s == pytest.approx(want[i, j]) for (i, k), (j, s) in got.items())
    assert near(rows[:0], None).count() == 0
    twice = sorted((r["id"], r["rank"], r["other"]) for r in near(rows[:3] + rows[:3], None).collect())
    assert [t for t in twice if t[0] == 0][:2] == [(0, 1, 0), (0, 2, 0)]  # a second row of the same id is another row
    with pytest.raises(Exception, match="not null"):
        near([*rows, (41, None)], None).count()
