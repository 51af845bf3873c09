"""Comparison of two embedding spaces over the same rows: (id, a array, b array).

Neighbours and kernel sums need all pairs of rows. Rows are dealt into blocks of
bounded size by a hash of their id, and each pair of blocks is one task: a matrix
product that leaves only k neighbours or one partial sum per row. Products that
only rule out neighbours are made in single precision, with its error allowed for;
what they leave is judged in double precision. Linear kernels need no pairs at all,
only sums over the dimensions.
"""
import math
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigspark.functions.arrays import at, dot, fold_sum, indices, let, mean
from sigspark.functions.session import cut_lineage
from sigspark.operators.long_features import order_statistics

BLOCK_ROWS = 32768  # largest block; rows are copied once per block, so few large blocks move the least data
BLOCK_BYTES = 128 << 20  # of the vectors of a block in double precision; wide vectors make blocks of fewer rows
CHUNK_ROWS = 512  # most rows of a block multiplied at a time
CHUNK_CELLS = 1 << 20  # entries of a product at a time; a step holds several arrays of this size, whatever the size of the blocks
NEAR_ROWS = 131072  # largest block in the search for neighbours, where a block holds one space; each block adds k rows to merge for every row
NEAR_BYTES = 64 << 20  # of the vectors of such a block in double precision
FIRST_COLUMNS = 512  # columns whose products are all ranked; they set the first bound of what may be a neighbour
TILE_COLUMNS = 1024  # columns of a product that is held against these bounds
DENSE = 16  # one in so many entries of such a product above its bound: it is made again in double precision
TIE_DIGITS = 9  # similarities equal to this many digits are ties; the lower id comes first


def l2_normalised(vector: Column) -> Column:
    norm = F.greatest(F.sqrt(dot(vector, vector)), F.lit(1e-12))
    return let(norm, lambda n: F.transform(vector, lambda x: x / n))


def pooled(states: DataFrame, n_layers: int, signal_pos: str | None = None) -> DataFrame:
    """(row, vector): mean over layers, then mean over unmasked positions (divisor at least 1).

    ``states``: (row, layer, pos, vector, mask). The position named by ``signal_pos`` is left out.
    """
    kept = states if signal_pos is None else states.filter(F.col("pos") != F.col(signal_pos))
    per_dim = kept.select("row", F.col("mask").cast("double").alias("m"), F.posexplode("vector").alias("dim", "x"))
    valid = F.greatest(F.sum("m") / n_layers, F.lit(1.0))
    means = per_dim.groupBy("row", "dim").agg((F.sum(F.col("x") * F.col("m")) / n_layers / valid).alias("x"))
    ordered = F.array_sort(F.collect_list(F.struct("dim", "x")))
    return means.groupBy("row").agg(F.transform(ordered, lambda v: v["x"]).alias("vector"))


def signal_states(states: DataFrame, n_layers: int, signal_pos: str) -> DataFrame:
    """(row, vector): the signal position alone, mean over layers."""
    picked = states.filter(F.col("pos") == F.col(signal_pos)).withColumn("mask", F.lit(1.0))
    return pooled(picked, n_layers)


# --- blocks ----------------------------------------------------------------
def _block_count(n: int, cores: int, width: int = 1, rows: int = BLOCK_ROWS, size: int = BLOCK_BYTES) -> int:
    """Blocks of at most ``rows`` rows and ``size`` bytes for ``width`` numbers a row; of a smaller input enough to keep all cores busy."""
    busy = min(-(-n // CHUNK_ROWS), math.ceil(2 * math.sqrt(cores)))
    most = max(1, min(rows, size // (8 * max(1, width))))
    return max(1, -(-n // most), busy)


def _cells(df: DataFrame, columns: list[str], block_rows: int | None, symmetric: bool = True) -> DataFrame:
    """Rows copied to every pair of blocks they take part in: (_i, _j, _block, id, …).

    A symmetric pair is built once, for _i <= _j.
    """
    n, width = df.agg(F.count("*"), F.max(sum(F.size(c) for c in columns))).first()
    cores = df.sparkSession.sparkContext.defaultParallelism
    n_blocks = _block_count(n, cores, width or 1) if block_rows is None else max(1, -(-n // block_rows))
    block = F.pmod(F.xxhash64("id"), F.lit(n_blocks)).cast("int")
    placed = df.select("id", *columns, block.alias("_block")).withColumn("_o", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    if symmetric:
        ends = [F.least("_block", "_o").alias("_i"), F.greatest("_block", "_o").alias("_j")]
        return placed.select("id", *columns, "_block", *ends)
    as_row = placed.select("id", *columns, F.lit(True).alias("_as_row"), F.col("_block").alias("_i"), F.col("_o").alias("_j"))
    as_col = placed.select("id", *columns, F.lit(False).alias("_as_row"), F.col("_o").alias("_i"), F.col("_block").alias("_j"))
    return as_row.unionByName(as_col)


def _sides(pdf: pd.DataFrame, i: int, j: int):
    """The two blocks of a cell; one and the same on the diagonal."""
    first = pdf[pdf["_block"] == i].sort_values("id")
    second = first if i == j else pdf[pdf["_block"] == j].sort_values("id")
    return first, second


def _matrix(pdf: pd.DataFrame, column: str) -> np.ndarray:
    return np.stack(pdf[column].to_list()).astype(np.float64)


def _chunks(x: np.ndarray, width: int):
    """(first row, rows) pieces of a block that is multiplied by ``width`` rows."""
    rows = max(1, min(CHUNK_ROWS, CHUNK_CELLS // max(1, width)))
    return ((start, x[start : start + rows]) for start in range(0, len(x), rows))


def _space_cells(df: DataFrame, spaces: list[str], block_rows: int | None) -> DataFrame:
    """Rows copied, one space at a time, to every ordered pair of blocks they take part in: (_s, _i, _j, _as_row, id, vector).

    On the diagonal the rows are the columns too and come once. Rows are dealt out
    before they are copied, as a scan may give them all to one task. Pairs of blocks
    are about equal in work and are dealt to many partitions, which stay as they are:
    joined by their size, a few of them would hold up the rest.
    """
    n, *widths = df.agg(F.count("*"), *[F.max(F.size(s)) for s in spaces]).first()
    cores = df.sparkSession.sparkContext.defaultParallelism
    width = max((w for w in widths if w), default=1)
    n_blocks = _block_count(n, cores, width, NEAR_ROWS, NEAR_BYTES) if block_rows is None else max(1, -(-n // block_rows))
    block = F.pmod(F.xxhash64("id"), F.lit(n_blocks)).cast("int")
    dealt = df.select("id", *spaces, block.alias("_b")).repartition(4 * cores, "id")
    copies = dealt.withColumn("_c", F.explode(F.sequence(F.lit(0), F.lit(2 * len(spaces) * n_blocks - 1))))
    other, side = (F.col("_c") % n_blocks).cast("int"), F.floor(F.col("_c") / n_blocks).cast("int")
    copies = copies.select("id", *spaces, "_b", other.alias("_o"), (side % 2 == 0).alias("_as_row"), F.floor(side / 2).cast("int").alias("_s"))
    copies = copies.filter(F.col("_as_row") | (F.col("_b") != F.col("_o")))
    ends = [F.when(F.col("_as_row"), F.col(x)).otherwise(F.col(y)).alias(name) for x, y, name in (("_b", "_o", "_i"), ("_o", "_b", "_j"))]
    vector = reduce(lambda rest, s: F.when(F.col("_s") == s, F.col(spaces[s])).otherwise(rest), range(len(spaces) - 1), F.col(spaces[-1]))
    partitions = min(4 * len(spaces) * n_blocks**2, 64 * cores)
    return copies.select("_s", *ends, "_as_row", "id", vector.alias("vector")).repartition(partitions, "_s", "_i", "_j")


def _vectors(column: pa.ChunkedArray) -> np.ndarray:
    lists = column.combine_chunks()
    sizes = pc.min_max(pc.list_value_length(lists)).as_py()
    if lists.null_count or sizes["min"] != sizes["max"]:
        raise ValueError("vectors must be of one length and not null")
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(lists), -1)


def _lengths(x: np.ndarray) -> np.ndarray:
    """Lengths of finite vectors, 1 for zero; large and small entries neither overflow nor vanish."""
    most = np.abs(x).max(axis=1)
    most[most == 0] = 1.0
    part = x / most[:, None]
    length = np.sqrt(np.einsum("nd,nd->n", part, part))
    length[length == 0] = 1.0
    with np.errstate(over="ignore"):
        return most * np.minimum(length, np.finfo(np.float64).max / most)


def _places(mask: np.ndarray) -> np.ndarray:
    """Flat places that are set, mostly few: eight are looked at together."""
    if mask.size % 8:
        return np.flatnonzero(mask)
    words = np.flatnonzero(mask.reshape(-1).view(np.uint64) != 0)
    word, byte = np.nonzero(mask.reshape(-1, 8)[words])
    return words[word] * 8 + byte


def _scores(x: np.ndarray, y: np.ndarray, r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Products of single pairs: equal for equal vectors, wherever they stand."""
    step = max(1, CHUNK_CELLS // max(1, x.shape[1]))
    pieces = [np.einsum("nd,nd->n", x[r[i : i + step]], y[c[i : i + step]]) for i in range(0, len(r), step)]
    return np.concatenate(pieces) if pieces else np.empty(0)


def _best(n: int, k: int, r: np.ndarray, c: np.ndarray, sim: np.ndarray) -> tuple:
    """The ``k`` best entries of each of ``n`` rows, best first, and the k-th best rounded value; entries of a row come by rising columns where they tie."""
    rank = -np.round(sim, TIE_DIGITS)
    order = np.argsort(rank, kind="stable")
    order = order[np.argsort(r[order].astype(np.int16), kind="stable")]
    r, c, sim, rank = r[order], c[order], sim[order], rank[order]
    place = np.arange(len(r)) - np.searchsorted(r, np.arange(n))[r]
    least = np.full(n, -np.inf)
    least[r[place == k - 1]] = -rank[place == k - 1]
    kept = place < k
    return (r[kept], c[kept], sim[kept]), least


def _nearest(x: np.ndarray, y: np.ndarray, k: int, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, product): of each row of ``x`` the ``k`` largest finite products with rows of ``y``, best first; of equal ones the lower column.

    ``own`` is the column that is the row itself, -1 if there is none; it is left out.
    The k-th best product so far bounds what a further column must reach. Bounds
    rise quickly, so nearly all columns are ruled out by a product in single
    precision; it is off by no more than ``slack`` for vectors of length one. Few
    are left to be scored, and the work on them does not depend on how they are cut.
    """
    real = [np.flatnonzero(np.isfinite(m).all(axis=1)) for m in (x, y)]
    if len(real[0]) < len(x) or len(real[1]) < len(y):  # products with other vectors are not finite
        place = np.full(len(y) + 1, -1)
        place[real[1]] = np.arange(len(real[1]))
        r, c, sim = _nearest(x[real[0]], y[real[1]], k, place[own[real[0]]])
        return real[0][r], real[1][c], sim
    if not len(x) or not len(y):
        return np.empty(0, int), np.empty(0, int), np.empty(0)
    width, length, longest = x.shape[1], _lengths(x), _lengths(y).max()
    x32, y32 = (x / length[:, None]).astype(np.float32), (y / longest).astype(np.float32)
    slack, slack64 = (width + 8) * 2.0**-23, (width + 8) * 2.0**-52
    first = max(FIRST_COLUMNS, k + 1)
    found = []
    product, above = np.empty((CHUNK_ROWS, TILE_COLUMNS), np.float32), np.empty((CHUNK_ROWS, TILE_COLUMNS), bool)
    for start in range(0, len(x), CHUNK_ROWS):
        rows = slice(start, start + CHUNK_ROWS)
        a, a32, mine, scale = x[rows], x32[rows], own[rows], length[rows]
        n = len(a)

        def merged(best: tuple, r: np.ndarray, c: np.ndarray) -> tuple:
            other = c != mine[r]
            r, c = r[other], c[other]
            sim = _scores(a, y, r, c)
            real = np.isfinite(sim)
            return _best(n, k, *(np.concatenate(v) for v in zip(best, (r[real], c[real], sim[real]))))

        def bounds(least: np.ndarray) -> tuple:
            """What a better entry reaches at least, rounding allowed for: in double, in single precision."""
            reach = (least + 0.499 * 10.0**-TIE_DIGITS)[:, None]
            with np.errstate(over="ignore"):
                single = (reach / scale[:, None] / longest - slack).astype(np.float32)
                return reach - slack64 * scale[:, None] * longest, np.nextafter(single, np.float32(-np.inf))

        sim = a @ y[:first].T
        ranked = min(k + 1, sim.shape[1])  # the row itself may be among them
        last = -np.partition(-sim, ranked - 1, axis=1)[:, ranked - 1 : ranked]
        near = 2 * 10.0**-TIE_DIGITS + slack64 * scale[:, None] * longest
        best, least = merged((np.empty(0, int), np.empty(0, int), np.empty(0)), *np.nonzero(~(sim < last - near)))
        done = min(first, len(y))
        while done < len(y):
            stop, pending, waiting = min(len(y), 2 * done), [], 0
            exact, single = bounds(least)
            for i in range(done, stop, TILE_COLUMNS):
                j = min(i + TILE_COLUMNS, stop)
                whole = n == CHUNK_ROWS and j - i == TILE_COLUMNS
                p = np.matmul(a32, y32[i:j].T, out=product if whole else None)
                hits = _places(np.greater_equal(p, single, out=above if whole else None))
                if len(hits) * DENSE > p.size:
                    hits = _places(~(a @ y[i:j].T < exact))
                pending.append((hits // (j - i), hits % (j - i) + i))
                waiting += len(hits)
                if waiting * DENSE > CHUNK_CELLS or j == stop:
                    best, least = merged(best, *(np.concatenate(v) for v in zip(*pending)))
                    exact, single = bounds(least)
                    pending, waiting = [], 0
            done = stop
        found.append((best[0] + start, *best[1:]))
    return tuple(np.concatenate(v) for v in zip(*found))


def neighbours(df: DataFrame, k: int, spaces=("a", "b"), block_rows: int | None = None) -> DataFrame:
    """(space, id, rank, other, sim): the ``k`` largest inner products of each row with the others, in each space."""
    spaces = list(spaces)

    def cell(key: tuple, table: pa.Table) -> pa.Table:
        s, i, j = (v.as_py() for v in key)
        as_row = table.column("_as_row")
        table = table.select(["id", "vector"])
        rows = table.filter(as_row)
        cols = rows if i == j else table.filter(pc.invert(as_row))
        row_ids, col_ids = (side.column("id").cast(pa.int64()).combine_chunks() for side in (rows, cols))
        if len(row_ids) == 0 or len(col_ids) == 0:
            r, c, sim = np.empty(0, int), np.empty(0, int), np.empty(0)
            order = r
        else:
            order = pc.array_sort_indices(col_ids).to_numpy()  # of equal products the lower id counts
            own = np.full(len(row_ids), -1)
            if i == j:
                own[order] = np.arange(len(order))
            r, c, sim = _nearest(_vectors(rows.column("vector")), _vectors(cols.column("vector"))[order], k, own)
        of_rows, starts = np.unique(r, return_index=True)
        entries = pa.StructArray.from_arrays([col_ids.take(pa.array(order[c])), pa.array(sim)], names=["other", "sim"])
        lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(r)).astype(np.int32)), entries)
        return pa.table([pa.repeat(spaces[s], len(of_rows)), row_ids.take(pa.array(of_rows)), lists], names=["space", "id", "found"])

    cells = _space_cells(df, spaces, block_rows)
    lists = cells.groupBy("_s", "_i", "_j").applyInArrow(cell, "space string, id bigint, found array<struct<other: bigint, sim: double>>")
    # What a block of columns gives to a row travels as one row.
    found = lists.repartition("space", "id").select("space", "id", F.explode("found").alias("_f")).select("space", "id", "_f.other", "_f.sim")
    order = Window.partitionBy("space", "id").orderBy(F.desc(F.round("sim", TIE_DIGITS)), "other")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def neighbour_lists(knn: DataFrame) -> DataFrame:
    """(id, a, b): neighbour ids of both spaces, best first; k entries each."""
    ranked = F.transform(F.array_sort(F.collect_list(F.struct("rank", "other"))), lambda x: x["other"])
    lists = knn.groupBy("id", "space").agg(ranked.alias("list"))
    one = lambda s: F.max(F.when(F.col("space") == s, F.col("list"))).alias(s)
    return lists.groupBy("id").agg(one("a"), one("b"))


# --- neighbour scores ------------------------------------------------------
def cycle_knn(knn: DataFrame) -> DataFrame:
    """Share of rows that are among the a-neighbours of their own b-neighbours."""
    of = lambda s: knn.filter(F.col("space") == s).select("id", "other")
    hop = of("b").withColumnsRenamed({"id": "start", "other": "mid"})
    back = of("a").withColumnsRenamed({"id": "mid", "other": "start"})
    hits = hop.join(back, ["start", "mid"]).select("start").distinct().agg(F.count("*").alias("h"))
    rows = knn.filter(F.col("space") == "b").agg(F.count_distinct("id")).scalar()
    return hits.select((F.col("h") / rows).alias("value"))


def mutual_knn(knn: DataFrame, k: int) -> DataFrame:
    """Mean share of common neighbours."""
    both = neighbour_lists(knn)
    return both.agg(F.avg(F.size(F.array_intersect("a", "b")) / F.lit(float(k))).alias("value"))


def lcs_length(a: np.ndarray, b: np.ndarray) -> int:
    """Length of a longest common subsequence of two lists without repeated entries: a longest rising run of places."""
    place = {x: i for i, x in enumerate(b)}
    tails: list = []
    for x in a:
        if x in place:
            at_ = int(np.searchsorted(tails, place[x]))
            tails[at_ : at_ + 1] = [place[x]]
    return len(tails)


def lcs_knn(knn: DataFrame) -> DataFrame:
    """Mean length of the longest common subsequence of the two neighbour lists."""

    @F.pandas_udf("int")
    def length(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([lcs_length(x, y) for x, y in zip(a, b)], dtype="int32")

    return neighbour_lists(knn).agg(F.avg(length("a", "b")).alias("value"))


def edit_distance_knn(knn: DataFrame, k: int) -> DataFrame:
    """1 - mean edit distance of the neighbour lists / k; ids become letters so that the built-in distance applies."""

    letters = F.lit("".join(chr(0x4E00 + i) for i in range(2 * k)))
    spelled = neighbour_lists(knn).withColumn("every", F.array_distinct(F.concat("a", "b")))
    word = lambda c: F.array_join(
        F.transform(c, lambda x: letters.substr(F.array_position("every", x).cast("int"), F.lit(1))), ""
    )
    return spelled.agg((F.lit(1.0) - F.avg(F.levenshtein(word("a"), word("b"))) / k).alias("value"))


# --- kernels from sums over dimensions -------------------------------------
def moments(df: DataFrame, columns=("a", "b")) -> DataFrame:
    """(term, i, j, value): sums of products over all rows, in one pass.

    Terms per pair of spaces ``xy``: gram ``g:xy`` (i, j); sums ``s:x`` (i);
    sums weighted by the other square norm ``w:xy`` (i); products of
    square norms ``q:xy``; square norms ``q:x``; ``n``. Every task adds up its rows
    first, so only one table of the size of the dimensions per task is shuffled.
    """
    x, y = columns

    def partial(batches):
        sums: dict = {}

        def add(term, value):
            sums[term] = sums[term] + value if term in sums else value

        for pdf in batches:
            if len(pdf) == 0:
                continue
            m = {"a": _matrix(pdf, x), "b": _matrix(pdf, y)}
            sq = {s: (v * v).sum(axis=1) for s, v in m.items()}
            for s in "ab":
                add(f"s:{s}", m[s].sum(axis=0))
                add(f"q:{s}", sq[s].sum())
                for t in "ab":
                    add(f"w:{s}{t}", m[s].T @ sq[t])
                    if s <= t:
                        add(f"g:{s}{t}", m[s].T @ m[t])
                        add(f"q:{s}{t}", float(sq[s] @ sq[t]))
            add("n", float(len(pdf)))
        for term, value in sums.items():
            v = np.atleast_2d(np.asarray(value, dtype=float))
            v = v if np.ndim(value) == 2 else v.T
            i, j = np.indices(v.shape)
            yield pd.DataFrame({"term": term, "i": i.ravel(), "j": j.ravel(), "value": v.ravel()})

    parts = df.select(x, y).mapInPandas(partial, "term string, i int, j int, value double")
    return parts.groupBy("term", "i", "j").agg(F.sum("value").alias("value"))


def _hsic_terms(sums: DataFrame) -> DataFrame:
    """One row: HSIC of the linear kernels, ``biased_xy`` and ``unbiased_xy`` for xy = ab, aa, bb."""
    part = lambda start, n: F.substr("term", F.lit(start), F.lit(n))
    gram = sums.filter(F.col("term").startswith("g:")).select(part(3, 2).alias("pair"), "i", "j", F.col("value").alias("g"))
    total = sums.filter(F.col("term").startswith("s:")).select(part(3, 1).alias("space"), "i", F.col("value").alias("v"))
    weighted = sums.filter(F.col("term").startswith("w:")).select(
        "term", part(3, 1).alias("space"), "i", F.col("value").alias("w")
    )
    n = sums.filter(F.col("term") == "n").select("value").scalar()
    left = total.select(F.col("space").alias("_x"), "i", F.col("v").alias("sx"))
    right = total.select(F.col("space").alias("_y"), F.col("i").alias("j"), F.col("v").alias("sy"))
    joined = gram.withColumn("_x", F.substr("pair", F.lit(1), F.lit(1))).withColumn("_y", F.substr("pair", F.lit(2), F.lit(1)))
    joined = joined.join(left, ["_x", "i"]).join(right, ["_y", "j"])
    centred = F.col("g") - F.col("sx") * F.col("sy") / n
    of_gram = joined.groupBy("pair").agg(
        F.sum(F.col("g") * F.col("g")).alias("gg"),
        F.sum(F.col("sx") * F.col("g") * F.col("sy")).alias("sgs"),
        F.sum(centred * centred).alias("cc"),
    )
    facts = [
        sums.filter(F.col("term").startswith("q:") | (F.col("term") == "n")).select(F.col("term").alias("key"), "value"),
        of_gram.unpivot("pair", ["gg", "sgs", "cc"], "f", "value").select(F.concat("f", F.lit(":"), "pair").alias("key"), "value"),
        total.groupBy(F.concat(F.lit("ss:"), "space").alias("key")).agg(F.sum(F.col("v") * F.col("v")).alias("value")),
        weighted.join(total, ["space", "i"]).groupBy(F.concat(F.lit("s"), "term").alias("key")).agg(F.sum(F.col("w") * F.col("v")).alias("value")),
    ]
    f = lambda key: F.max(F.when(F.col("key") == key, F.col("value")))

    def unbiased(s, t):
        m, q = f("n"), f(f"q:{s}{t}")
        cross = f(f"sgs:{s}{t}") - f(f"sw:{s}{t}") - f(f"sw:{t}{s}") + q
        k, l = f(f"ss:{s}") - f(f"q:{s}"), f(f"ss:{t}") - f(f"q:{t}")
        return (f(f"gg:{s}{t}") - q + k * l / ((m - 1) * (m - 2)) - cross * 2 / (m - 2)) / (m * (m - 3))

    pairs = [("a", "b"), ("a", "a"), ("b", "b")]
    return reduce(DataFrame.unionByName, facts).agg(
        *[f(f"cc:{s}{t}").alias(f"biased_{s}{t}") for s, t in pairs], *[unbiased(s, t).alias(f"unbiased_{s}{t}") for s, t in pairs]
    )


def _aligned(ab: Column, aa: Column, bb: Column) -> Column:
    return ab / (F.sqrt(aa * bb) + F.lit(1e-6))


def cka_linear(df: DataFrame, unbiased: bool = False) -> DataFrame:
    """Alignment of linear kernels without any pair of rows."""
    kind = "unbiased" if unbiased else "biased"
    terms = _hsic_terms(moments(df))
    return terms.select(_aligned(*[F.col(f"{kind}_{p}") for p in ("ab", "aa", "bb")]).alias("value"))


def cka_rbf(df: DataFrame, sigma: float = 1.0, unbiased: bool = False, block_rows: int | None = None) -> DataFrame:
    """Alignment of kernels exp(-d^2 / 2 sigma^2): row sums and products per cell, never a whole kernel."""

    def kernel(x, y):
        square = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2 * x @ y.T
        return np.exp(-np.maximum(square, 0.0) / (2 * sigma**2))

    def cell(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        first, second = _sides(pdf, *key)
        if not len(first) or not len(second):
            return pd.DataFrame(columns=["id", "k", "l", "kl", "kk", "ll"])
        xa, xb, ya, yb = (_matrix(side, c) for side in (first, second) for c in "ab")
        by_row, by_col = np.zeros((len(first), 5)), np.zeros((len(second), 5))
        for start, x in _chunks(xa, len(second)):
            k, l = kernel(x, ya), kernel(xb[start : start + len(x)], yb)
            if first is second:
                own = np.arange(len(x))
                k[own, start + own] = l[own, start + own] = 0.0
            for i, product in enumerate((k, l, k * l, k * k, l * l)):
                by_row[start : start + len(x), i] = product.sum(axis=1)
                by_col[:, i] += product.sum(axis=0)
        sums = [(first, by_row)] if first is second else [(first, by_row), (second, by_col)]
        frame = lambda side, m: pd.DataFrame(m, columns=["k", "l", "kl", "kk", "ll"]).assign(id=side["id"].to_numpy())
        return pd.concat([frame(side, m) for side, m in sums])[["id", "k", "l", "kl", "kk", "ll"]]

    parts = _cells(df, ["a", "b"], block_rows).groupBy("_i", "_j").applyInPandas(
        cell, "id bigint, k double, l double, kl double, kk double, ll double"
    )
    rows = parts.groupBy("id").agg(*[F.sum(c).alias(c) for c in ("k", "l", "kl", "kk", "ll")])
    # Diagonals are 1 in both kernels; the sums above leave them out.
    total = rows.agg(
        F.count("*").cast("double").alias("n"), *[F.sum(c).alias(c) for c in ("k", "l", "kl", "kk", "ll")],
        *[F.sum(F.col(p) * F.col(q)).alias(f"r{p}{q}") for p, q in ("kl", "kk", "ll")],
        *[F.sum((F.col(p) + 1) * (F.col(q) + 1)).alias(f"d{p}{q}") for p, q in ("kl", "kk", "ll")],
    )
    n = F.col("n")

    def hsic(p, q):
        if unbiased:
            value = F.col(p + q) + F.col(p) * F.col(q) / ((n - 1) * (n - 2)) - F.col(f"r{p}{q}") * 2 / (n - 2)
            return value / (n * (n - 3))
        return F.col(p + q) + n - F.col(f"d{p}{q}") * 2 / n + (F.col(p) + n) * (F.col(q) + n) / (n * n)

    return total.select(_aligned(hsic("k", "l"), hsic("k", "k"), hsic("l", "l")).alias("value"))


def cknna(knn: DataFrame, n_rows: Column, k: int, distance_agnostic: bool = False) -> DataFrame:
    """Alignment of linear kernels restricted to common neighbours; k at least 2.

    The masked kernels are sparse and not symmetric: entry (i, j) counts when j is
    a neighbour of i in both spaces. ``distance_agnostic`` replaces their
    alignment by the number of common neighbours.
    """
    if k < 2:
        raise ValueError("k must be at least 2")
    of = lambda s, name: knn.filter(F.col("space") == s).select(F.col("id").alias("i"), F.col("other").alias("j"), F.col("sim").alias(name))
    a, b = of("a", "x"), of("b", "y")
    pairs = {
        "ab": a.join(b, ["i", "j"]),
        "aa": a.withColumn("y", F.col("x")),
        "bb": b.withColumn("x", F.col("y")),
    }
    rows = []
    for name, entries in pairs.items():
        if distance_agnostic:
            rows.append(entries.agg(F.count("*").cast("double").alias("v")).select(F.lit(name).alias("pair"), "v"))
            continue
        turned = entries.select(F.col("j").alias("i"), F.col("i").alias("j"), F.col("y").alias("y2"))
        product = entries.join(turned, ["i", "j"]).agg(F.coalesce(F.sum(F.col("x") * F.col("y2")), F.lit(0.0))).scalar()
        columns = entries.groupBy(F.col("j").alias("node")).agg(F.sum("x").alias("cx"))
        sums = entries.groupBy(F.col("i").alias("node")).agg(F.sum("y").alias("ry"))
        cross = columns.join(sums, "node").agg(F.coalesce(F.sum(F.col("cx") * F.col("ry")), F.lit(0.0))).scalar()
        total = entries.agg(F.coalesce(F.sum("x"), F.lit(0.0)).alias("sx"), F.coalesce(F.sum("y"), F.lit(0.0)).alias("sy"))
        m = n_rows
        value = (product + F.col("sx") * F.col("sy") / ((m - 1) * (m - 2)) - cross * 2 / (m - 2)) / (m * (m - 3))
        rows.append(total.select(F.lit(name).alias("pair"), value.alias("v")))
    of_pair = lambda pair: F.max(F.when(F.col("pair") == pair, F.col("v")))
    return reduce(DataFrame.unionByName, rows).agg(_aligned(of_pair("ab"), of_pair("aa"), of_pair("bb")).alias("value"))


def svcca(df: DataFrame, q: int = 10) -> DataFrame:
    """Mean canonical correlation of the leading ``q`` directions of both standardised spaces.

    All that is needed of the rows are the dimension-by-dimension sums, one
    bounded table for a single small task.
    """

    def correlate(pdf: pd.DataFrame) -> pd.DataFrame:
        def grid(term):
            t = pdf[pdf["term"] == term]
            out = np.zeros((t["i"].max() + 1, t["j"].max() + 1))
            out[t["i"], t["j"]] = t["value"]
            return out

        n = grid("n")[0, 0]
        mean = {s: grid(f"s:{s}")[:, 0] / n for s in "ab"}
        cov = {p: grid(f"g:{p}") - n * np.outer(mean[p[0]], mean[p[1]]) for p in ("aa", "ab", "bb")}
        scale = {s: np.sqrt(np.maximum(np.diag(cov[s + s]), 0) / (n - 1)) + 1e-8 for s in "ab"}
        cov = {p: c / np.outer(scale[p[0]], scale[p[1]]) for p, c in cov.items()}
        whiten = {}
        for s in "ab":
            values, vectors = np.linalg.eigh(cov[s + s])
            whiten[s] = vectors[:, ::-1][:, :q] / np.sqrt(np.maximum(values[::-1][:q], 1e-300))
        both = np.linalg.svd(whiten["a"].T @ cov["ab"] @ whiten["b"], compute_uv=False)
        return pd.DataFrame({"value": [float(np.mean(np.minimum(both, 1.0)))]})

    return moments(df).groupBy(F.lit(0).alias("_one")).applyInPandas(correlate, "value double")


# --- outliers --------------------------------------------------------------
def clamp_limit(df: DataFrame, vector: str, q: float, exact: bool = False) -> DataFrame:
    """(value): the ``q``-quantile of absolute entries; over all of them, or the mean of the rows' quantiles.

    Over all entries it is found by counts of digits: nothing is sorted, and
    equal entries, however many, are one count.
    """
    if exact:
        one = F.lit(0).alias("rec")
        rows = df.select(one, F.transform(vector, lambda x: F.abs(x.cast("double"))).alias("x"))
        rank = df.agg(F.floor(F.sum(F.size(vector)) * F.lit(float(q))).alias("rank"))
        return order_statistics(rows, rank.filter("rank IS NOT NULL").select(one, "rank")).select("value")

    def quantile(s):
        place = (F.size(s) - 1) * F.lit(float(q))
        low = F.floor(place)
        return at(s, low) + (at(s, F.least(low + 1, F.size(s) - 1)) - at(s, low)) * (place - low)

    return df.agg(F.avg(let(F.array_sort(F.transform(vector, F.abs)), quantile)).alias("value"))


def clamped(df: DataFrame, vector: str, q: float, exact: bool = False) -> DataFrame:
    """Entries limited to plus and minus the clamp limit; unchanged for q = 1."""
    if q == 1:
        return df
    limit = clamp_limit(df, vector, q, exact).scalar()
    bounded = df.withColumn("_limit", limit)
    inside = F.transform(vector, lambda x: F.greatest(F.least(x, F.col("_limit")), -F.col("_limit")))
    return bounded.withColumn(vector, inside).drop("_limit")


# --- losses and overrides --------------------------------------------------
def contrastive_loss(df: DataFrame, temperature: float = 0.07, block_rows: int | None = None) -> DataFrame:
    """Cross-entropy of matching a to b and b to a over all rows, summed.

    Unit vectors bound similarities by 1/temperature, which serves as the common
    shift of all exponentials, so partial sums of cells add up.
    """
    shift = 1.0 / temperature
    unit = df.select("id", l2_normalised(F.col("a")).alias("a"), l2_normalised(F.col("b")).alias("b"))

    def cell(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, cols = pdf[pdf["_as_row"]], pdf[~pdf["_as_row"]]
        if not len(rows) or not len(cols):
            return pd.DataFrame(columns=["id", "side", "total"])
        turned = _matrix(cols, "b").T
        by_row, by_col = np.zeros(len(rows)), np.zeros(len(cols))
        for start, x in _chunks(_matrix(rows, "a"), len(cols)):
            e = np.exp(x @ turned / temperature - shift)
            by_row[start : start + len(x)] = e.sum(axis=1)
            by_col += e.sum(axis=0)
        sides = [(rows, 0, by_row), (cols, 1, by_col)]
        return pd.concat([pd.DataFrame({"id": p["id"].to_numpy(), "side": side, "total": t}) for p, side, t in sides])

    cells = _cells(unit, ["a", "b"], block_rows, symmetric=False)
    parts = cells.groupBy("_i", "_j").applyInPandas(cell, "id bigint, side int, total double")
    sums = parts.groupBy("id", "side").agg(F.sum("total").alias("total"))
    logs = sums.groupBy("side").agg(F.avg(F.log("total") + F.lit(shift)).alias("v")).agg(F.sum("v").alias("logs"))
    own = unit.agg(F.avg(dot(F.col("a"), F.col("b")) / temperature)).scalar()
    return logs.select((F.col("logs") - own * 2).alias("value"))


PAD = -2  # fixed value: no position


def overridden(states: DataFrame, overrides: DataFrame, length: int) -> DataFrame:
    """(row, pos, vector) with the vectors of ``overrides`` written in; padding and zero vectors are skipped."""
    zero = ~F.exists("vector", lambda x: x != 0)
    real = overrides.filter((F.col("pos") != PAD) & ~zero)
    fail = F.raise_error(F.format_string("position %d is outside of 0 to %d", F.col("pos"), F.lit(length - 1)))
    checked = real.withColumn("pos", F.when((F.col("pos") >= 0) & (F.col("pos") < length), F.col("pos")).otherwise(fail.cast("int")))
    new = checked.select("row", "pos", F.col("vector").alias("_new"))
    joined = states.join(new, ["row", "pos"], "left")
    return joined.withColumn("vector", F.coalesce("_new", "vector")).drop("_new")


def adaptive_pool(positions: Column, n: int) -> Column:
    """Array averaged into ``n`` bins [floor(iL/n), ceil((i+1)L/n)), which may overlap."""

    def bins(x):
        size = F.size(x)

        def one(i):
            start, stop = F.floor(i * size / n), F.ceil((i + 1) * size / n)
            return mean(F.slice(x, (start + 1).cast("int"), (stop - start).cast("int")))

        return F.transform(indices(F.lit(n)), one)

    return let(positions, bins)


def lead_mean(recording: Column) -> Column:
    """Leads averaged position by position."""
    n = F.size(recording)
    return let(
        recording, lambda r: F.transform(indices(F.size(r[0])), lambda i: fold_sum(F.transform(r, lambda lead: at(lead, i))) / n)
    )


def sweep(df: DataFrame, k: int = 10, q: int = 10, sigma: float = 1.0, block_rows: int | None = None) -> DataFrame:
    """(metric, score) of all alignment scores; they are deterministic, so nothing is repeated."""
    knn = cut_lineage(neighbours(df, k, block_rows=block_rows))
    rows = df.agg(F.count("*").cast("double")).scalar()
    parts = {
        "cycle_knn": cycle_knn(knn),
        "mutual_knn": mutual_knn(knn, k),
        "lcs_knn": lcs_knn(knn),
        "edit_distance_knn": edit_distance_knn(knn, k),
        "cka": cka_linear(df),
        "unbiased_cka": cka_linear(df, unbiased=True),
        "cka_rbf": cka_rbf(df, sigma, block_rows=block_rows),
        "cknna": cknna(knn, rows, k),
        "svcca": svcca(df, q),
    }
    return reduce(DataFrame.unionByName, [p.select(F.lit(m).alias("metric"), F.col("value").alias("score")) for m, p in parts.items()])
