"""Scores of generated text against references, and statistics over seeds and training logs.

A pair is one row, and every per-pair count is taken inside the row. So a score
is one narrow pass and one small aggregation, whatever the words are.
"""
import math
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigspark.functions.arrays import let
from sigspark.functions.stems import stem
from sigspark.operators.ranking import number_rows

MAX_N = 4
ORDERS = range(1, MAX_N + 1)
SMOOTHING = 0.1  # fixed value: numerator used for an n above 1 without a match
ALPHA, BETA, GAMMA = 0.9, 3.0, 0.5  # fixed values: weights of the unigram alignment score


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)[\s\x1c-\x1f]+"), lambda w: w != "")


def admitted(pairs: DataFrame) -> DataFrame:
    """Pairs with text on both sides."""
    return pairs.filter((F.length("ref") > 0) & (F.length("hyp") > 0))


def pair_up(refs: DataFrame, hyps: DataFrame, key: str) -> DataFrame:
    """Join references and hypotheses; fail when a row lacks its counterpart."""
    both = refs.withColumnRenamed("text", "ref").join(hyps.withColumnRenamed("text", "hyp"), key, "full")
    single = F.col("ref").isNull() | F.col("hyp").isNull()
    fail = F.raise_error(F.lit("references and hypotheses differ in number"))
    return both.select(key, F.when(single, fail.cast("string")).otherwise(F.col("ref")).alias("ref"), "hyp")


def exact_match(pairs: DataFrame) -> DataFrame:
    return admitted(pairs).agg(F.coalesce(F.avg((F.col("ref") == F.col("hyp")).cast("double")), F.lit(0.0)).alias("value"))


def ngrams(tokens: Column, n: int) -> Column:
    """Space-joined n-grams of a token array, each built from the n-gram one word shorter."""
    return _longer(tokens, tokens, 1, n)


def clipped_matches(ref: list, hyp: list, n: int) -> int:
    """n-grams of the hypothesis found in the reference, each at most as often as there."""
    count = lambda w: Counter(zip(*(w[i:] for i in range(n))))
    return (count(ref) & count(hyp)).total()


def aligned_runs(ref: list, hyp: list, stems: bool = False) -> tuple[int, int]:
    """Matched words and unbroken runs of them; both sides pair their k-th last occurrence of a word.

    With stems, words that are left over are paired once more by their stems.
    """
    matches, left_ref, left_hyp = [], list(range(len(ref))), list(range(len(hyp)))
    for form in (None, stem) if stems else (None,):
        places = defaultdict(list)
        for i in left_ref:
            places[form(ref[i]) if form else ref[i]].append(i)
        found = [(j, p.pop()) for j in reversed(left_hyp) if (p := places.get(form(hyp[j]) if form else hyp[j]))]
        matches += found
        taken_hyp, taken_ref = {j for j, _ in found}, {i for _, i in found}
        left_hyp, left_ref = [j for j in left_hyp if j not in taken_hyp], [i for i in left_ref if i not in taken_ref]
    matches.sort(reverse=True)
    # Walking backwards, a match continues a run if both places are just before those of the match after it.
    runs = sum(1 for x, y in zip(matches, matches[1:]) if (x[0] - 1, x[1] - 1) != y) + bool(matches)
    return len(matches), runs


def _word_counts():
    @F.pandas_udf("ref_len int, hyp_len int, matched array<bigint>")
    def count(refs: pd.Series, hyps: pd.Series) -> pd.DataFrame:
        rows = [(len(r), len(h), [clipped_matches(r, h, n) for n in ORDERS]) for r, h in zip(refs.map(list), hyps.map(list))]
        return pd.DataFrame(rows, columns=["ref_len", "hyp_len", "matched"])

    return count(words(F.col("ref")), words(F.col("hyp")))


def _aligned(stems: bool):
    @F.pandas_udf("aligned int, runs int")
    def align(refs: pd.Series, hyps: pd.Series) -> pd.DataFrame:
        rows = [aligned_runs([w.lower() for w in r], [w.lower() for w in h], stems) for r, h in zip(refs, hyps)]
        return pd.DataFrame(rows, columns=["aligned", "runs"])

    return align(words(F.col("ref")), words(F.col("hyp")))


def word_counts(pairs: DataFrame) -> DataFrame:
    """(pair_id, ref_len, hyp_len, matched[n = 1…4]) of admitted pairs.

    Both texts of a pair are in one row, so all counting stays in the row: one
    narrow pass, where exploded n-grams would shuffle several times the text.
    """
    return admitted(pairs).select("pair_id", _word_counts().alias("c")).select("pair_id", "c.*")


def _brevity(ref_len: Column, hyp_len: Column) -> Column:
    return F.when(hyp_len > ref_len, F.lit(1.0)).otherwise(F.exp(F.lit(1.0) - ref_len / F.nullif(hyp_len, F.lit(0))))


def _possible(n: int) -> Column:
    """Hypothesis n-grams; a text shorter than n counts as one, as in the published implementation."""
    return F.greatest(F.col("hyp_len") - n + 1, F.lit(1))


def _log_precision(matched: Column, possible: Column) -> Column:
    return F.log(F.when(matched > 0, matched).otherwise(F.lit(SMOOTHING)) / possible)


def _matched(n: int) -> Column:
    return F.get("matched", F.lit(n - 1))


def _corpus_sums() -> list[Column]:
    return [
        F.sum("ref_len").alias("r"),
        F.sum("hyp_len").alias("h"),
        *[F.sum(_matched(n)).alias(f"m{n}") for n in ORDERS],
        *[F.sum(_possible(n)).alias(f"p{n}") for n in ORDERS],
    ]


def _corpus_score() -> Column:
    logs = sum((_log_precision(F.col(f"m{n}"), F.col(f"p{n}")) for n in ORDERS), F.lit(0.0)) / MAX_N
    score = F.when(F.col("m1") > 0, _brevity(F.col("r"), F.col("h")) * F.exp(logs))
    return F.coalesce(score, F.lit(0.0))


def _sentence_score() -> Column:
    upto = F.least(F.lit(MAX_N), F.col("ref_len"), F.col("hyp_len"))
    logs = sum((F.when(upto >= n, _log_precision(_matched(n), _possible(n))).otherwise(0.0) for n in ORDERS), F.lit(0.0))
    score = _brevity(F.col("ref_len"), F.col("hyp_len")) * F.exp(logs / F.nullif(upto, F.lit(0)))
    return F.when(_matched(1) > 0, score).otherwise(F.lit(0.0))


def _alignment_score() -> Column:
    m = F.nullif(F.col("aligned"), F.lit(0))
    p, r = m / F.col("hyp_len"), m / F.col("ref_len")
    f = p * r / (F.lit(ALPHA) * p + F.lit(1.0 - ALPHA) * r)
    return F.coalesce(f * (F.lit(1.0) - F.lit(GAMMA) * F.pow(F.col("runs") / m, F.lit(BETA))), F.lit(0.0))


def corpus_bleu(pairs: DataFrame) -> DataFrame:
    """Corpus score up to 4-grams; 0 without a matching word."""
    return word_counts(pairs).agg(*_corpus_sums()).select(_corpus_score().alias("value"))


def sentence_bleu(pairs: DataFrame) -> DataFrame:
    """(pair_id, score): orders up to min(4, both lengths), equal weights."""
    return word_counts(pairs).select("pair_id", _sentence_score().alias("score"))


def unigram_alignment(pairs: DataFrame, stems: bool = False) -> DataFrame:
    """(pair_id, score): matches of lower-case words, then of the stems of the others, with a penalty on broken runs.

    Without ``stems`` only equal words match. Synonyms are not looked up. A stem
    is worked out once for each distinct word that a worker meets.
    """
    lengths = [F.size(words(F.col(c))).alias(f"{c}_len") for c in ("ref", "hyp")]
    counted = admitted(pairs).select("pair_id", *lengths, _aligned(stems).alias("a")).select("pair_id", "ref_len", "hyp_len", "a.*")
    return counted.select("pair_id", _alignment_score().alias("score"))


# --- recall-oriented overlap -----------------------------------------------
def sentences(text: Column) -> Column:
    """Non-empty parts between full stops, white space normalised."""
    parts = F.filter(F.split(text, r"\."), lambda s: F.length(s) > 0)
    return F.transform(parts, lambda s: F.array_join(words(s), " "))


def _f1(overlap: Column, n_hyp: Column, n_ref: Column) -> Column:
    p = F.when(n_hyp > 0, overlap / n_hyp).otherwise(0.0)
    r = F.when(n_ref > 0, overlap / n_ref).otherwise(0.0)
    return F.lit(2.0) * (p * r / (p + r + F.lit(1e-8)))


def ngrams(tokens: Column, n: int) -> Column:
    """Space-joined n-grams of a token array, each built from the n-gram one word shorter."""
    return _longer(tokens, tokens, 1, n)


def _longer(tokens: Column, grams: Column, have: int, want: int) -> Column:
    if have == want:
        return grams
    head = F.slice(grams, 1, F.greatest(F.size(grams) - 1, F.lit(0)))
    tail = F.slice(tokens, have + 1, F.greatest(F.size(tokens) - have, F.lit(0)))
    longer = F.zip_with(head, tail, lambda g, w: F.concat(g, F.lit(" "), w))
    return let(longer, lambda x: _longer(tokens, x, have + 1, want))


def _words_of(parts: Column) -> Column:
    return F.flatten(F.transform(parts, lambda s: F.split(s, " ")))


def _set_score(ref: Column, hyp: Column, n: int) -> Column:
    grams = lambda text: F.array_distinct(let(_words_of(sentences(text)), lambda t: ngrams(t, n)))
    both = F.struct(grams(ref).alias("r"), grams(hyp).alias("h"))
    return let(both, lambda x: _f1(F.size(F.array_intersect(x["h"], x["r"])), F.size(x["h"]), F.size(x["r"])))


def set_overlap(pairs: DataFrame, n: int) -> DataFrame:
    """(pair_id, score): F1 of the sets of n-grams; n-grams run across sentences."""
    each = admitted(pairs)
    return each.select("pair_id", _set_score(F.col("ref"), F.col("hyp"), n).alias("score"))


def lcs_words(a: list, b: list) -> set:
    """Words of the longest common subsequence found by walking back from both ends, towards earlier ``b`` on ties.

    A row of the length table is kept as one integer: bit j is clear where the
    length grows at position j, which is all that walking back has to know. If
    one side is a subsequence of the other, it is the longest common one.
    """
    short, rest = (a, iter(b)) if len(a) < len(b) else (b, iter(a))
    if all(w in rest for w in short):
        return set(short)
    at = defaultdict(int)
    for j, w in enumerate(b):
        at[w] |= 1 << j
    row = every = (1 << len(b)) - 1
    rows = []
    for w in a:
        hit = at.get(w, 0)
        row = ((row + (row & hit)) | (row & ~hit)) & every
        rows.append(row)
    i, j, found = len(a) - 1, len(b) - 1, set()
    while i >= 0 and j >= 0:
        if a[i] == b[j]:
            found.add(a[i])
            i, j = i - 1, j - 1
        elif rows[i] >> j & 1:
            j -= 1
        else:
            i -= 1
    return found


def common_subsequence_words(ref: list, hyp: list) -> int:
    """Number of different words that some pair of sentences has in a longest common subsequence.

    Only sentence pairs that share a word not yet found are compared: equal
    sentences add all their words at once, and other pairs seldom add any.
    """
    ref, hyp = [s.split(" ") for s in dict.fromkeys(ref)], [s.split(" ") for s in dict.fromkeys(hyp)]
    equal = set(map(tuple, ref)) & set(map(tuple, hyp))
    found = {w for s in equal for w in s}
    in_ref, in_hyp = defaultdict(list), defaultdict(list)
    for where, side in ((in_ref, ref), (in_hyp, hyp)):
        for i, s in enumerate(side):
            for w in dict.fromkeys(s):
                where[w].append(i)
    done = set()

    def compare(i, j):
        if (i, j) not in done:
            done.add((i, j))
            found.update(lcs_words(ref[i], hyp[j]))

    # A sentence's rarest word most likely leads to its counterpart.
    for i, s in enumerate(ref):
        shared = [w for w in s if w in in_hyp]
        if any(w not in found for w in shared):
            rarest = min(shared, key=lambda w: len(in_hyp[w]))
            compare(i, min(in_hyp[rarest], key=lambda j: abs(i - j)))
    for w in in_ref:
        for i, j in ((i, j) for i in in_ref[w] for j in in_hyp.get(w, ())):
            if w in found:
                break
            compare(i, j)
    return len(found)


def _subsequence_words():
    @F.pandas_udf("int")
    def union(refs: pd.Series, hyps: pd.Series) -> pd.Series:
        return pd.Series([common_subsequence_words(list(r), list(h)) for r, h in zip(refs, hyps)], dtype="int32")

    return union(sentences(F.col("ref")), sentences(F.col("hyp")))


def _subsequence_score(found: Column) -> Column:
    n = lambda c: F.size(F.array_distinct(_words_of(sentences(F.col(c)))))
    return _f1(found, n("hyp"), n("ref"))


def subsequence_overlap(pairs: DataFrame) -> DataFrame:
    """(pair_id, score): summary-level F1 of longest common subsequences over all sentence pairs."""
    counted = admitted(pairs).withColumn("_found", _subsequence_words())
    return counted.select("pair_id", _subsequence_score(F.col("_found")).alias("score"))


def average(scores: DataFrame) -> DataFrame:
    return scores.agg(F.coalesce(F.avg("score"), F.lit(0.0)).alias("value"))


def _gram_codes(words: list, split: int) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """For each order up to MAX_N: a number for every n-gram before place ``split`` and behind it, and how many numbers there are."""
    number = {}
    code = word = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    size, out = len(number), []
    for n in ORDERS:
        if n > 1:  # an n-gram is one that is a word shorter and a word
            code, size = code[: max(len(word) - n + 1, 0)] * len(number) + word[n - 1 :], 0
            distinct, code = np.unique(code, return_inverse=True)
            size = len(distinct)
        out.append((code[: max(split - n + 1, 0)], code[split:], size))
    return out


def pair_counts(ref: str, hyp: str) -> tuple:
    """All counts of a pair that its scores need, from its two texts."""
    r, h = ref.split(), hyp.split()  # the white space of ``words``
    matched = [int(np.minimum(np.bincount(a, minlength=size), np.bincount(b, minlength=size)).sum()) for a, b, size in _gram_codes(r + h, len(r))]
    sides = [[" ".join(s.split()) for s in text.split(".") if s] for text in (ref, hyp)]
    flat = [[w for s in side for w in s.split(" ")] for side in sides]
    sets = [[set(w), set(zip(w, w[1:]))] for w in flat]
    overlaps = [x for one, two in zip(*sets) for x in (len(one & two), len(two), len(one))]
    return (len(r), len(h), matched, *aligned_runs([w.lower() for w in r], [w.lower() for w in h], True), *overlaps, common_subsequence_words(*sides))


def _pair_counts():
    @F.pandas_udf(
        "ref_len int, hyp_len int, matched array<bigint>, aligned int, runs int, "
        "both1 int, hyp1 int, ref1 int, both2 int, hyp2 int, ref2 int, found int"
    )
    def count(refs: pd.Series, hyps: pd.Series) -> pd.DataFrame:
        names = ["ref_len", "hyp_len", "matched", "aligned", "runs", "both1", "hyp1", "ref1", "both2", "hyp2", "ref2", "found"]
        return pd.DataFrame([pair_counts(r, h) for r, h in zip(refs, hyps)], columns=names)

    return count("ref", "hyp")


def report(pairs: DataFrame, by: tuple = ()) -> DataFrame:
    """(by…, metric, sub_metric, value) of all scores, alignments with stems: one narrow pass over the pairs, one aggregation.

    A pair's texts are split into words once for all scores. Without ``by``,
    zeros when no pair is admitted.
    """
    each = admitted(pairs).select(*by, (F.col("ref") == F.col("hyp")).cast("double").alias("_acc"), _pair_counts().alias("c"))
    f1 = lambda overlap, n: _f1(F.col(overlap), F.col(f"hyp{n}"), F.col(f"ref{n}"))
    scored = each.select(*by, "_acc", "c.*")
    means = {
        "BLEU_sent:": _sentence_score(), "METEOR:": _alignment_score(),
        "ROUGE:rouge-1": f1("both1", 1), "ROUGE:rouge-2": f1("both2", 2), "ROUGE:rouge-l": f1("found", 1), "ACC:": F.col("_acc"),
    }
    sums = scored.groupBy(*by).agg(*_corpus_sums(), *[F.coalesce(F.avg(c), F.lit(0.0)).alias(name) for name, c in means.items()])
    wide = sums.select(*by, _corpus_score().alias("BLEU:"), *[F.col(f"`{name}`") for name in means])
    long = wide.unpivot(list(by), [f"`{name}`" for name in ["BLEU:", *means]], "_name", "value")
    name = F.split("_name", ":")
    return long.select(*by, name[0].alias("metric"), name[1].alias("sub_metric"), "value")


# --- statistics over seeds -------------------------------------------------
def t_cdf(t: float, df: int) -> float:
    """Student distribution function for whole degrees of freedom (finite trigonometric sums)."""
    theta = math.atan(t / math.sqrt(df))
    s, c = math.sin(theta), math.cos(theta)
    if df % 2:
        term, total = c, 0.0
        for k in range(1, (df - 1) // 2 + 1):
            total += term
            term *= c * c * 2 * k / (2 * k + 1)
        return 0.5 + (theta + s * total) / math.pi
    term, total = 1.0, 0.0
    for k in range(df // 2):
        total += term
        term *= c * c * (2 * k + 1) / (2 * k + 2)
    return 0.5 + s * total / 2


def t_quantile(p: float, df: int) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if t_cdf(mid, df) < p else (lo, mid)
    return (lo + hi) / 2


def seed_statistics(metrics: DataFrame, confidence: float = 0.95) -> DataFrame:
    """(metric, sub_metric, mean, std, lo, hi) in percent, from (seed, metric, sub_metric, value).

    Several values of one seed are averaged first. One seed has no interval.
    """
    per_seed = metrics.groupBy("metric", "sub_metric", "seed").agg((F.avg("value") * 100).alias("v"))
    stats = per_seed.groupBy("metric", "sub_metric").agg(
        F.avg("v").alias("mean"), F.when(F.count("*") > 1, F.stddev_samp("v")).alias("std"), F.count("*").alias("n")
    )

    @F.pandas_udf("double")
    def quantile(n: pd.Series) -> pd.Series:
        known = {k: t_quantile((1 + confidence) / 2, int(k) - 1) for k in n.unique() if k > 1}
        return n.map(known).astype("float64")

    margin = quantile("n") * F.col("std") / F.sqrt("n")
    return stats.select(
        "metric", "sub_metric", "mean", "std", (F.col("mean") - margin).alias("lo"), (F.col("mean") + margin).alias("hi")
    )


# --- training logs ---------------------------------------------------------
def epoch_losses(log: DataFrame, patience: int, delta: float) -> DataFrame:
    """(run, epoch, loss, is_best, stop) from (run, epoch, step, loss).

    ``is_best``: below all earlier epochs. ``stop``: the best of the last
    ``patience`` epochs does not improve on the best before them by ``delta``.
    """
    mean = log.groupBy("run", "epoch").agg(F.avg("loss").alias("loss"))
    order = Window.partitionBy("run").orderBy("epoch")  # one row per epoch
    earlier = F.min("loss").over(order.rowsBetween(Window.unboundedPreceding, -1))
    recent = F.min("loss").over(order.rowsBetween(-patience + 1, 0))
    before = F.min("loss").over(order.rowsBetween(Window.unboundedPreceding, -patience))
    return mean.select(
        "run", "epoch", "loss",
        (earlier.isNull() | (F.col("loss") < earlier)).alias("is_best"),
        F.coalesce(recent > before - delta, F.lit(False)).alias("stop"),
    )


def saved_steps(log: DataFrame, saves: int = 5) -> DataFrame:
    """Steps at which a checkpoint is due: the first, then each fifth of the epoch."""
    counts = log.groupBy("run", "epoch").agg(F.count("*").alias("steps"))
    numbered = number_rows(log, ["run", "epoch"], ["step"], "nth").join(counts, ["run", "epoch"])
    interval = F.greatest(F.floor(F.col("steps") / saves), F.lit(1))
    return numbered.filter(F.col("nth") % interval == 0).drop("steps")
