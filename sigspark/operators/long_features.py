"""Features of leads of any length, which stand in rows of blocks.

A block takes the samples next to it from its neighbours (a halo), works out what
lies inside it, and what remains is added up over blocks: sums of power over
windows, of coefficients over bands, of gaps between peaks. Flat tops are joined over
borders by their ends, peaks that are too close are decided block by block until
no decision waits for a neighbour, and percentiles are found by counting digits.
The result equals that of the lead in one row; no task holds a whole lead.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigspark.functions.session import drop_table, sized
from sigspark.operators.features import DB4, MAX_LEVEL, MAX_WINDOW, PEAK_SHARE

#: Samples that a block gets from the one before it, and from the one behind it.
BEFORE, BEHIND = 512, MAX_WINDOW
#: Samples of a block: a multiple of both.
BLOCK = 65_536
#: Bits of a digit when order statistics are counted.
DIGIT = 16
BANDS = MAX_LEVEL + 1


def blocks_of(samples: DataFrame, rec: str, index: str, value: str, length: int = BLOCK) -> DataFrame:
    """(rec, block, x) from samples numbered 0, 1, … in each lead."""
    if length % BEHIND:
        raise ValueError(f"the length of a block must be a multiple of {BEHIND}")
    pair = F.struct(F.col(index).alias("i"), F.col(value).cast("double").alias("v"))
    grouped = samples.groupBy(F.col(rec).alias("rec"), F.floor(F.col(index) / length).alias("block")).agg(F.array_sort(F.collect_list(pair)).alias("s"))
    return grouped.select("rec", "block", F.transform("s", lambda x: x["v"]).alias("x"))


def with_halo(rows: DataFrame, values: str = "x", before: int = BEFORE, behind: int = BEHIND) -> DataFrame:
    """Adds ``left`` and ``right``: the last samples of the block before, the first of the block behind; empty at the ends."""
    none = F.array().cast("array<double>")
    own = rows.withColumn("_side", F.lit(0)).withColumn("_halo", none)
    keys = [F.col("rec"), F.lit(None).cast("array<double>").alias(values)]
    x = F.col(values)
    tails = rows.select(*keys, (F.col("block") + 1).alias("block"), F.lit(-1).alias("_side"), F.slice(x, F.greatest(F.size(x) - before + 1, F.lit(1)), before).alias("_halo"))
    heads = rows.select(*keys, (F.col("block") - 1).alias("block"), F.lit(1).alias("_side"), F.slice(x, 1, behind).alias("_halo"))
    rest = [c for c in rows.columns if c not in ("rec", "block")]
    both = own.unionByName(tails, allowMissingColumns=True).unionByName(heads, allowMissingColumns=True)
    side = lambda k: F.coalesce(F.max(F.when(F.col("_side") == k, F.col("_halo"))), none)
    met = both.groupBy("rec", "block").agg(*[F.max(F.when(F.col("_side") == 0, F.col(c))).alias(c) for c in rest], side(-1).alias("left"), side(1).alias("right"))
    return met.filter(F.col(values).isNotNull())


def facts(rows: DataFrame) -> DataFrame:
    """(rec, n, mean, std, lo, hi): exact over all blocks of a lead."""
    x = F.col("x")
    total = F.aggregate(x, F.lit(0.0), lambda a, v: a + v)
    part = rows.select("rec", F.size(x).cast("long").alias("_n"), total.alias("_s"), F.array_min(x).alias("_lo"), F.array_max(x).alias("_hi"))
    first = part.groupBy("rec").agg(F.sum("_n").alias("n"), (F.sum("_s") / F.sum("_n")).alias("mean"), F.min("_lo").alias("lo"), F.max("_hi").alias("hi"))
    first = sized(first, "facts")
    away = F.aggregate(x, F.lit(0.0), lambda a, v: a + (v - F.col("mean")) * (v - F.col("mean")))
    second = rows.join(first, "rec").select("rec", away.alias("_d")).groupBy("rec").agg(F.sum("_d").alias("_d"))
    return first.join(second, "rec").select("rec", "n", "mean", F.sqrt(F.col("_d") / F.col("n")).alias("std"), "lo", "hi")


# Order statistics by counting digits


def _keys(x: np.ndarray) -> np.ndarray:
    """Numbers without sign in the order of the doubles."""
    bits = (x + 0.0).view(np.uint64)
    return np.where(bits >> np.uint64(63), ~bits, bits | np.uint64(1 << 63))


def order_statistics(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(rec, rank, value) for (rec, rank), ranks from 0: counts of leading digits, refined digit by digit.

    Each of four passes sends, for a rank, one row for a digit and task. Equal
    values need no sorting, however many there are.
    """
    state = sized(wanted.select("rec", F.col("rank").cast("long").alias("rank"), F.col("rank").cast("long").alias("left"), F.lit(0).cast("long").alias("prefix")), "ranks")
    for turn in range(64 // DIGIT):
        shift = 64 - DIGIT * (turn + 1)
        asked = state.groupBy("rec").agg(F.collect_set("prefix").alias("prefixes"))

        def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                out = []
                for rec, mine in f.groupby("rec", sort=False):
                    keys = _keys(np.concatenate(mine["x"].to_list()).astype(np.float64))
                    for p in mine["prefixes"].iloc[0]:
                        some = keys if shift == 64 - DIGIT else keys[keys >> np.uint64(shift + DIGIT) == np.uint64(p)]  # noqa: B023
                        digit, n = np.unique(some >> np.uint64(shift) & np.uint64((1 << DIGIT) - 1), return_counts=True)  # noqa: B023
                        out.append(pd.DataFrame({"rec": rec, "prefix": int(p), "digit": digit.astype(np.int64), "n": n.astype(np.int64)}))
                if out:
                    yield pd.concat(out)

        kind = dict(rows.dtypes)["rec"]
        found = rows.select("rec", "x").join(asked, "rec").mapInPandas(count, f"rec {kind}, prefix long, digit long, n long")
        found = found.groupBy("rec", "prefix", "digit").agg(F.sum("n").alias("n"))
        upto = F.sum("n").over(Window.partitionBy("rec", "prefix").orderBy("digit"))  # at most as many rows as there are digits
        found = found.withColumn("upto", upto)
        chosen = state.join(found, ["rec", "prefix"]).filter((F.col("left") < F.col("upto")) & (F.col("left") >= F.col("upto") - F.col("n")))
        before, state = state, sized(
            chosen.select("rec", "rank", (F.col("left") - F.col("upto") + F.col("n")).alias("left"), F.shiftleft("prefix", DIGIT).bitwiseOR(F.col("digit")).alias("prefix")), "ranks"
        )
        drop_table(before)

    @F.pandas_udf("double")
    def number(keys: pd.Series) -> pd.Series:
        k = keys.to_numpy(np.int64).view(np.uint64)
        return pd.Series(np.where(k >> np.uint64(63), k & np.uint64((1 << 63) - 1), ~k).view(np.float64))

    return state.select("rec", "rank", number("prefix").alias("value"))


def percentiles(rows: DataFrame, lengths: DataFrame, shares: dict[str, float]) -> DataFrame:
    """(rec, a column for each share): linear interpolation between order statistics."""
    named = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.lit(float(q)).alias("q")) for c, q in shares.items()]))
    places = lengths.select("rec", "n", named.alias("s")).select("rec", "s.name", ((F.col("n") - 1) * F.col("s.q")).alias("place"), "n")
    places = places.withColumn("low", F.floor("place")).withColumn("high", F.least(F.floor("place") + 1, F.col("n") - 1))
    ranks = places.select("rec", F.explode(F.array("low", "high")).alias("rank")).distinct()
    found = sized(order_statistics(rows, ranks), "order")
    of = lambda c: found.select("rec", F.col("rank").alias(c), F.col("value").alias(f"at_{c}"))
    value = F.col("at_low") + (F.col("at_high") - F.col("at_low")) * (F.col("place") - F.col("low"))
    both = places.join(of("low"), ["rec", "low"]).join(of("high"), ["rec", "high"])
    return both.groupBy("rec").agg(*[F.max(F.when(F.col("name") == c, value)).alias(c) for c in shares])


# What a block sees of spectrum, wavelet, steps and flat tops


def _powers(x: np.ndarray, start: int, stop: int, n: int, fs: float) -> tuple[np.ndarray, int]:
    """Sum of the power of all windows that begin in a block; ``x`` reaches from ``start`` to its halo behind."""
    width = min(MAX_WINDOW, n)
    step = width - width // 2
    first = -(-start // step) * step
    begins = np.arange(first, min(stop, n - width + 1), step) - start
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(width) / width) if width > 1 else np.ones(1)
    out = np.zeros(width // 2 + 1)
    for s in range(0, len(begins), 256):
        cut = x[begins[s : s + 256, None] + np.arange(width)]
        cut = (cut - cut.mean(axis=1, keepdims=True)) * window
        power = np.abs(np.fft.rfft(cut, axis=1)) ** 2 / (fs * (window**2).sum())
        power[:, 1 : (-1 if width % 2 == 0 else None)] *= 2
        out += power.sum(axis=0)
    return out, len(begins)


def _bands(x: np.ndarray, at: int, start: int, stop: int, n: int) -> tuple[list[float], list[int]]:
    """Sums of absolute coefficients by band, and their number, of the indices that belong to a block.

    ``x`` begins at sample ``at``. Beyond the ends of the lead values are
    mirrored; elsewhere a coefficient is worked out only where all it needs is known.
    """
    taps = len(DB4)
    level = min(MAX_LEVEL, int(np.floor(np.log2(n / (taps - 1.0))))) if n >= taps - 1 else 0
    low, high = DB4[::-1], DB4 * np.where(np.arange(taps) % 2 == 0, -1.0, 1.0)
    details, last = [], stop >= n
    for _ in range(level):
        length = (n + taps - 1) // 2
        # Index k needs samples 2k - 6 to 2k + 1.
        k0 = 0 if at == 0 else -(-(at + taps - 2) // 2)
        k1 = length if last else (at + len(x)) // 2
        places = 2 * np.arange(k0, k1)[:, None] + 1 - np.arange(taps)[None, :]
        places = np.where(places < 0, -places - 1, places)
        places = np.where(places >= n, 2 * n - 1 - places, places) - at
        values = x[places]
        start, stop = start // 2, length if last else stop // 2
        own = np.arange(k0, k1) >= start
        own &= np.arange(k0, k1) < stop
        details.append((values @ high)[own])
        x, at, n = values @ low, k0, length
    mine = (np.arange(at, at + len(x)) >= start) & (np.arange(at, at + len(x)) < stop)
    bands = [x[mine], *details[::-1]]
    return [float(np.abs(b).sum()) for b in bands], [len(b) for b in bands]


def _tops(x: np.ndarray, start: int) -> tuple[list, list]:
    """Flat runs of a block: peaks strictly inside, (place, value), and the first and last run, (from, to, value, inner neighbour before, behind)."""
    change = np.flatnonzero(np.diff(x)) + 1
    begins, ends = np.append(0, change), np.append(change, len(x)) - 1
    v = x[begins]
    up = np.flatnonzero((v[1:-1] > v[:-2]) & (v[1:-1] > v[2:])) + 1 if len(v) > 2 else np.zeros(0, int)
    inside = [(int(start + (begins[k] + ends[k]) // 2), float(v[k])) for k in up]
    run = lambda k: (int(start + begins[k]), int(start + ends[k]), float(v[k]), float(v[k - 1]) if k else None, float(v[k + 1]) if k + 1 < len(v) else None)
    return inside, [run(k) for k in dict.fromkeys((0, len(v) - 1))]


_RUN = "struct<`from`:long,`to`:long,v:double,before:double,behind:double>"
_SEEN = f"powers array<double>, windows long, sums array<double>, counts array<long>, steps double, squares double, tops array<struct<p:long,v:double>>, ends array<{_RUN}>"


def seen(rows: DataFrame, lengths: DataFrame, fs: float, length: int) -> DataFrame:
    """One row for a block: its share of spectrum, bands and steps, its peaks and the runs at its ends."""
    kind = dict(rows.dtypes)["rec"]

    def look(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for rec, block, x, left, right, n in zip(f["rec"], f["block"], f["x"], f["left"], f["right"], f["n"]):
                x, left, right = (np.asarray(a, np.float64) for a in (x, left, right))
                start, stop = block * length, block * length + len(x)
                powers, windows = _powers(np.concatenate([x, right]), start, stop, n, fs)
                sums, counts = _bands(np.concatenate([left, x]), start - len(left), start, stop, n)
                d = np.diff(np.concatenate([left[-1:], x]))
                tops, ends = _tops(x, start)
                out.append((rec, block, powers, windows, sums, counts, float(np.abs(d).sum()), float((d * d).sum()), tops, ends))
            yield pd.DataFrame(out, columns=["rec", "block", "powers", "windows", "sums", "counts", "steps", "squares", "tops", "ends"])

    wide = with_halo(rows).join(lengths.select("rec", "n"), "rec")
    return wide.select("rec", "block", "x", "left", "right", "n").mapInPandas(look, f"rec {kind}, block long, {_SEEN}")


def _added(rows: DataFrame, column: str, out: str) -> DataFrame:
    """(rec, out): arrays added up place by place."""
    each = rows.select("rec", F.posexplode(column).alias("k", "v")).groupBy("rec", "k").agg(F.sum("v").alias("v"))
    return each.groupBy("rec").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda s: s["v"]).alias(out))


def _border_tops(sight: DataFrame) -> DataFrame:
    """(rec, p, v): flat tops that touch a border; runs of one value in neighbouring blocks are one."""
    ends = sight.select("rec", F.explode("ends").alias("e")).select("rec", "e.*")  # two rows for a block
    order = Window.partitionBy("rec").orderBy("from")
    new = F.coalesce((F.col("v") != F.lag("v").over(order)) | (F.lag("to").over(order) + 1 != F.col("from")), F.lit(True))
    ends = ends.withColumn("new", new.cast("int"))
    runs = ends.withColumn("run", F.sum("new").over(order)).groupBy("rec", "run").agg(
        F.min("from").alias("from"), F.max("to").alias("to"), F.first("v").alias("v"), F.min_by("before", "from").alias("before"), F.max_by("behind", "from").alias("behind")
    )
    of = Window.partitionBy("rec").orderBy("from")
    before = F.coalesce("before", F.when(F.lag("to").over(of) + 1 == F.col("from"), F.lag("v").over(of)))
    behind = F.coalesce("behind", F.when(F.lead("from").over(of) - 1 == F.col("to"), F.lead("v").over(of)))
    runs = runs.select("rec", F.floor((F.col("from") + F.col("to")) / 2).alias("p"), "v", before.alias("before"), behind.alias("behind"))
    return runs.filter((F.col("v") > F.col("before")) & (F.col("v") > F.col("behind"))).select("rec", "p", "v")


# Peaks that are too close to a higher one


def decided(p: np.ndarray, v: np.ndarray, status: np.ndarray, distance: int) -> np.ndarray:
    """Decisions on candidates by falling height, later ones first among equals; 1 stays, -1 goes, 0 is open.

    One stays when all higher ones nearer than the distance go, and goes when one
    of them stays; it waits for those that are open.
    """
    status = status.copy()
    first, last = np.searchsorted(p, p - distance + 1), np.searchsorted(p, p + distance - 1, side="right")
    for j in np.lexsort((p, v))[::-1]:
        if status[j]:
            continue
        near = np.arange(first[j], last[j])
        above = near[(v[near] > v[j]) | ((v[near] == v[j]) & (p[near] > p[j]))]
        if (status[above] == 1).any():
            status[j] = -1
        elif (status[above] == -1).all():
            status[j] = 1
    return status


def kept_peaks(candidates: DataFrame, distance: int, length: int) -> DataFrame:
    """(rec, block, ps): the peaks that stay, by block.

    In each round a block sees the candidates of its neighbours within the
    distance, with what is decided on them. It decides all that does not hang on
    an open one over there; the highest open one always can be, so rounds end.
    """
    if distance >= length:
        raise ValueError("peaks reach further than the next block")
    kind = dict(candidates.dtypes)["rec"]
    rows = candidates.groupBy("rec", F.floor(F.col("p") / length).alias("block")).agg(F.array_sort(F.collect_list(F.struct("p", "v", F.lit(0).alias("s")))).alias("c"))
    rows = sized(rows, "candidates")
    shape = f"rec {kind}, block long, c array<struct<p:long,v:double,s:int>>"

    def decide(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for rec, block, *held in zip(f["rec"], f["block"], f["ps"], f["vs"], f["ss"]):
                p, v, s = (np.asarray(h) for h in held)
                order = np.argsort(p)
                p, v, s = p[order], v[order].astype(np.float64), s[order].astype(np.int64)
                own = (p // length) == block
                # Those of a neighbour are decided over there: here they only count as they are.
                inner = s.copy()
                inner[~own & (s == 0)] = 2
                new = decided(p, v, inner, distance)
                out.append((rec, block, [dict(p=int(a), v=float(b), s=int(c)) for a, b, c, o in zip(p, v, new, own) if o]))
            yield pd.DataFrame(out, columns=["rec", "block", "c"])

    while True:
        near = lambda k, side: rows.select("rec", (F.col("block") + k).alias("block"), F.filter("c", side).alias("c"))
        edge = lambda c: F.pmod(c["p"], F.lit(length))
        tails = near(1, lambda c: edge(c) > length - distance)
        heads = near(-1, lambda c: edge(c) < distance - 1)
        met = rows.withColumn("own", F.lit(True)).unionByName(tails.unionByName(heads).withColumn("own", F.lit(False)))
        met = met.groupBy("rec", "block").agg(F.flatten(F.collect_list("c")).alias("c"), F.max("own").alias("own")).filter("own")
        met = met.select("rec", "block", *[F.col(f"c.{k}").alias(f"{k}s") for k in "pvs"])
        before, rows = rows, sized(met.mapInPandas(decide, shape), "candidates")
        drop_table(before)
        if rows.filter(F.exists("c", lambda c: c["s"] == 0)).limit(1).isEmpty():
            break
    return rows.select("rec", "block", F.transform(F.filter("c", lambda c: c["s"] == 1), lambda c: c["p"]).alias("ps"))


# Beats


def _beats(rows: DataFrame, peaks: DataFrame, lengths: DataFrame, fs: float, length: int) -> DataFrame:
    """(rec, rate, variability, qrs, t, st): zeros below two peaks."""
    some = sized(peaks.filter(F.size("ps") > 0), "peaks")
    last = F.last("_end", ignorenulls=True).over(Window.partitionBy("rec").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))  # a row for a block
    some_with = some.withColumn("_end", F.element_at("ps", -1)).withColumn("_before", last)
    chain = F.when(F.col("_before").isNotNull(), F.concat(F.array("_before"), F.col("ps"))).otherwise(F.col("ps"))
    steps = F.greatest(F.size("c") - 1, F.lit(0))
    gap = F.zip_with(F.slice("c", 2, steps), F.slice("c", 1, steps), lambda b, a: (b - a) / F.lit(float(fs)))
    gaps = some_with.select("rec", "ps", chain.alias("c")).withColumn("g", gap)
    total = lambda c: F.sum(F.aggregate(c, F.lit(0.0), lambda a, v: a + v))
    lasts = F.sort_array(F.flatten(F.collect_list(F.slice("ps", F.greatest(F.size("ps") - 1, F.lit(1)), 2))))  # two for a block
    sums = [F.sum(F.size("ps")).alias("beats"), total("g").alias("sum"), F.sum(F.size("g")).alias("gaps"), lasts.alias("ends")]
    first = sized(gaps.groupBy("rec").agg(*sums), "gaps")
    first = first.filter("beats > 1").withColumn("mean", F.col("sum") / F.col("gaps")).withColumn("a", F.element_at("ends", -2)).withColumn("b", F.element_at("ends", -1)).drop("ends", "sum")
    away = gaps.join(first.select("rec", "mean"), "rec").select("rec", F.aggregate("g", F.lit(0.0), lambda a, v: a + (v - F.col("mean")) * (v - F.col("mean"))).alias("d"))
    spread = away.groupBy("rec").agg(F.sum("d").alias("d"))
    kind, w, later = dict(rows.dtypes)["rec"], int(0.1 * fs), int(0.08 * fs)
    if w > BEFORE:
        raise ValueError("the halo is shorter than the window around a peak")

    def look(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for rec, block, x, left, right, ps, n, a, b in zip(*(f[c] for c in ("rec", "block", "x", "left", "right", "ps", "n", "a", "b"))):
                whole, start = np.concatenate([np.asarray(s, np.float64) for s in (left, x, right)]), block * length - len(left)
                widths = 0.0
                for p in () if ps is None else ps:
                    s = whole[max(0, p - w) - start : min(p + w, n) - start]
                    if len(s) and s.max() > s.min():
                        widths += float((np.abs(s - s.mean()) > 0.1 * (s.max() - s.min()) + s.min()).sum()) / fs
                own = np.asarray(x, np.float64)
                lo, hi = max(0, a - block * length), min(len(own), b - block * length)
                between = own[lo:hi] if hi > lo else own[:0]
                at = lambda i: float(own[i - block * length]) if 0 <= i - block * length < len(own) else None  # noqa: B023, E731
                out.append((rec, widths, float(between.min()) if len(between) else None, float(between.max()) if len(between) else None, at(b), at(min(b + later, n - 1))))
            yield pd.DataFrame(out, columns=["rec", "widths", "low", "high", "at_peak", "at_later"]).astype({c: float for c in ("low", "high", "at_peak", "at_later")})

    halo = with_halo(rows).join(first.select("rec", "a", "b"), "rec").join(lengths.select("rec", "n"), "rec").join(some, ["rec", "block"], "left")
    local = halo.select("rec", "block", "x", "left", "right", "ps", "n", "a", "b").mapInPandas(look, f"rec {kind}, widths double, low double, high double, at_peak double, at_later double")
    nan = lambda c: F.when(~F.isnan(c), F.col(c))
    local = local.groupBy("rec").agg(F.sum("widths").alias("widths"), (F.max(nan("high")) - F.min(nan("low"))).alias("t"), (F.max(nan("at_later")) - F.max(nan("at_peak"))).alias("st"))
    all_of = first.join(spread, "rec").join(local, "rec")
    return all_of.select(
        "rec", (F.lit(60.0) / F.col("mean")).alias("rate"), F.when(F.col("gaps") > 1, F.sqrt(F.col("d") / F.col("gaps"))).otherwise(0.0).alias("variability"),
        (F.col("widths") / F.col("beats")).alias("qrs"), "t", "st",
    )


def long_features(rows: DataFrame, fs: float, length: int = BLOCK) -> DataFrame:
    """(rec, features): the values of a lead in the order of ``features.lead_features``.

    ``rows`` has ``rec``, ``block`` and ``x``: blocks 0, 1, … of ``length`` samples, the
    last one as long as what is left. Leads without samples are absent; an empty
    table gives an empty result. Samples must be numbers; repair them first.
    """
    if length % BEHIND:
        raise ValueError(f"the length of a block must be a multiple of {BEHIND}")
    rows = rows.select("rec", "block", "x").filter(F.size("x") > 0)
    known = sized(facts(rows), "facts")
    shares = percentiles(rows, known, {"median": 0.5, "p25": 0.25, "p75": 0.75})
    sight = sized(seen(rows, known, fs, length), "seen")
    power, sums, counts = _added(sight, "powers", "power"), _added(sight, "sums", "sums"), _added(sight, "counts", "counts")
    rest = sight.groupBy("rec").agg(F.sum("windows").alias("windows"), F.sum("steps").alias("steps"), F.sum("squares").alias("squares"))
    tops = sight.select("rec", F.explode("tops").alias("t")).select("rec", "t.*").unionByName(_border_tops(sight))
    height = F.lit(PEAK_SHARE) * (F.col("hi") - F.col("lo")) + F.col("lo")
    tops = tops.join(known, "rec").filter((F.col("v") >= height) & (F.col("hi") > F.col("lo"))).select("rec", "p", "v")
    beats = _beats(rows, kept_peaks(tops, max(int(0.2 * fs), 1), length), known, fs, length)
    p = F.transform("power", lambda x: x / F.col("windows"))
    total = F.aggregate(p, F.lit(0.0), lambda a, x: a + x)
    width = F.least(F.col("n"), F.lit(MAX_WINDOW))
    frequency = lambda k: k * F.lit(float(fs)) / width
    weighted = F.aggregate(F.transform(p, lambda x, k: x * frequency(k)), F.lit(0.0), lambda a, x: a + x)
    zero: Column = F.lit(0.0)
    steps = F.col("n") - 1
    vector = F.concat(
        F.array("mean", "std", "hi", "lo", "median", "p25", "p75", total, F.array_max(p), frequency(F.array_position(p, F.array_max(p)) - 1), F.when(total > 0, weighted / total).otherwise(zero)),
        F.array(*[F.coalesce(c, zero) for c in ("rate", "variability", "qrs", "t", "st")]),
        F.zip_with("sums", "counts", lambda s, c: s / c),
        F.array(F.when(steps > 0, F.col("steps") / steps), F.when(steps > 0, F.sqrt(F.col("squares") / steps))),
    )
    out = known
    for more in (shares, power, sums, counts, rest):
        out = out.join(more, "rec")
    return out.join(beats, "rec", "left").select("rec", vector.alias("features"))
