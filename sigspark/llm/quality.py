"""Quality rules: surface counts, and a likelihood ratio of hashed n-grams between trusted and all documents."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigspark.functions.arrays import let, unrolled
from sigspark.llm.common import DOCUMENT_COLUMNS, words_of

#: Counters of the two multinomials.
BUCKETS = 32768
#: Pseudo count of every counter.
SMOOTHING = 1.0
#: The trusted sample holds at most so many labelled documents, those with the lowest hash.
TRUSTED_ROWS = 100_000
#: A document stays if its mean log ratio for each n-gram is at least this.
LEAST_RATIO = -0.1
SYMBOLS = "#*$%&|<>"


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids of documents labelled good and not toxic, at most TRUSTED_ROWS."""
    good = labels.filter("quality = 1 AND toxic = 0 AND doc_id IS NOT NULL").select("doc_id").distinct()
    return good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRUSTED_ROWS)


def _counter(*words: Column) -> Column:
    return F.pmod(F.xxhash64(*words), F.lit(BUCKETS)).cast("int")


def _pairs(w: Column) -> Column:
    """Each word with the next; the last with null."""
    return F.arrays_zip(w.alias("a"), F.slice(w, 2, F.greatest(F.size(w), F.lit(1))).alias("b"))


def log_ratios(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: the array ``ratios`` of log p(trusted) - log p(all) for each counter of words and word pairs.

    All documents are counted whole. Each counter has the pseudo count in both
    multinomials. Without trusted documents all ratios are 0.
    """
    # At most TRUSTED_ROWS ids.
    trusted = F.broadcast(trusted_ids(labels).withColumn("_good", F.lit(1)))
    rows = docs.select("doc_id", words_of(F.col("text")).alias("_w")).join(trusted, "doc_id", "left")
    words = unrolled(rows.select("_good", _pairs(F.col("_w")).alias("_p")), ["_good"], F.col("_p"), "p")
    second = F.when(F.col("p.b").isNotNull(), _counter(F.col("p.a"), F.col("p.b")))
    grams = words.select("_good", F.explode(F.array(_counter(F.col("p.a")), second)).alias("_b")).filter("_b IS NOT NULL")
    counts = grams.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"), F.count("_good").alias("_g"))
    every = F.struct(*[F.sum(c).alias(c) for c in ("_n", "_g")])

    def ratio(n, g):
        trusted_part = F.log((g + SMOOTHING) / (F.col("_all._g") + SMOOTHING * BUCKETS))
        whole_part = F.log((n + SMOOTHING) / (F.col("_all._n") + SMOOTHING * BUCKETS))
        return F.when(F.col("_all._g") > 0, trusted_part - whole_part).otherwise(0.0)

    dense = counts.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("_b"))
    # The one group has BUCKETS rows.
    return (
        dense.join(counts, "_b", "left").fillna(0, ["_n", "_g"])
        .agg(every.alias("_all"), F.array_sort(F.collect_list(F.struct("_b", "_n", "_g"))).alias("_rows"))
        .select(F.transform("_rows", lambda r: ratio(r["_n"], r["_g"])).alias("ratios"))
    )


def _marked(t: Column) -> Column:
    """Places of windows that occur twice or more, in order: equal neighbours among the sorted hashes.

    Most texts repeat no window: their hashes are all different, and nothing is sorted.
    """
    placed = F.sort_array(F.transform(t, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    both = let(placed, lambda s: F.zip_with(
        F.slice(s, 1, F.size(s) - 1), F.slice(s, 2, F.size(s) - 1), lambda x, y: F.when(x["h"] == y["h"], F.array(x["i"], y["i"]))
    ))
    repeated = F.sort_array(F.array_distinct(F.flatten(F.filter(both, lambda x: x.isNotNull()))))
    return F.when(F.size(F.array_distinct(t)) < F.size(t), repeated).otherwise(F.array().cast("array<int>"))


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts, ``base_failed``, mean log ratio ``score`` and verdict ``kept`` for every document.

    Needs ``doc_id`` and ``text``; further columns come through. Null and empty
    texts have no words and fail the base rules. A document of one word has one
    n-gram. Labels of unknown documents and null labels have no effect; a
    repeated label counts once. No document is sampled: both multinomials and
    the verdict take whole texts of all.
    """
    ratios = log_ratios(docs, labels).scalar()  # one row of BUCKETS numbers
    text, w = F.coalesce("text", F.lit("")), F.col("_w")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    a = docs.select(*docs.columns, words_of(F.col("text")).alias("_w"), lines.alias("_l"))
    inner = F.greatest(F.size(w) - 2, F.lit(0))
    windows = F.transform(F.arrays_zip(*[F.slice(w, k, inner).alias(c) for k, c in ((1, "a"), (2, "b"), (3, "c"))]), lambda x: F.xxhash64(x))
    # Each copy of the ratios is read once, right behind where it enters; so the optimiser reads it in place and copies it to no row.
    a = a.select(
        *docs.columns, F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        windows.alias("_t"), w, _pairs(w).alias("_p"), ratios.alias("_r1"), ratios.alias("_r2"),
    )
    names = [*docs.columns, "n_words", "word_chars", "n_symbols", "n_dup_lines"]
    single = F.aggregate("_w", F.lit(0.0), lambda acc, x: acc + F.get("_r1", _counter(x)))
    double = F.aggregate("_p", F.lit(0.0), lambda acc, p: acc + F.when(p["b"].isNull(), 0.0).otherwise(F.get("_r2", _counter(p["a"], p["b"]))))
    a = a.select(*names, "_t", single.alias("_s1"), double.alias("_s2"))
    a = a.select(*names, "_s1", "_s2", _marked(F.col("_t")).alias("_m"))
    # A place covers three words less those that the place before covers.
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("p"))
    covered = F.aggregate(
        "_m", start, lambda acc, p: F.struct((acc["n"] + F.least(F.lit(3), p - acc["p"])).cast("long").alias("n"), p.alias("p")), lambda acc: acc["n"]
    )
    mean = F.when(F.col("n_words") > 0, (F.col("_s1") + F.col("_s2")) / (2 * F.col("n_words") - 1)).otherwise(0.0)
    a = a.select(*names, covered.alias("n_repeat_words"), mean.alias("score"))
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    return a.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("score") >= LEAST_RATIO))


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that stay, with their own columns.

    A filter would be pushed below the projections, where it computes words and
    ratios once more for each use. So one element is unrolled for a document that stays.
    """
    rows = scored(docs.select(*DOCUMENT_COLUMNS), labels)
    stays = F.explode(F.when(F.col("kept"), F.array(F.lit(True))))
    return rows.select(*DOCUMENT_COLUMNS, stays.alias("_stays")).select(*DOCUMENT_COLUMNS)
