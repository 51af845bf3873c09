"""Mixing sources to target weights: capped water-filling and seeded repetitions."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigspark.llm.common import DOCUMENT_COLUMNS, ranked, stored, words_of

WEIGHTS = (5, 2, 1)
SHARE = 1.5
EPOCHS = 2
SEED = "mix"
#: Rows of a source are spread over so many buckets of the seeded order.
BUCKET_DIGITS = 3


def _keyed(docs: DataFrame, seed: str) -> DataFrame:
    """Documents with size, source key and place in the seeded order."""
    key = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    return docs.select(
        "*", F.size(words_of(F.col("text"))).cast("long").alias("_size"), F.col("source").isNull().alias("_none"),
        F.coalesce("source", F.lit("")).alias("_name"), key.alias("_key"),
        F.substring(key, 1, BUCKET_DIGITS).alias("_bucket"),
    )


def level(sources: DataFrame, share: float, epochs: int) -> float:
    """Words for each unit of weight: raised until what clamped sources leave over has been dealt out.

    ``sources`` has ``weight`` and ``_source_size``. Every pass is one sum over
    the sources and clamps at least one source more; the passes stop when none is above its cap.
    """
    total, weight = sources.agg(F.sum("_source_size"), F.sum("weight")).first()
    if not total:
        return 0.0
    budget, at = share * total, share * total / weight
    cap = F.col("_source_size") * float(epochs)
    while True:
        full = F.lit(at) * F.col("weight") > cap
        used, free = sources.agg(
            F.sum(F.when(full, cap).otherwise(0.0)), F.sum(F.when(full, 0).otherwise(F.col("weight")))
        ).first()
        if not free or (budget - used) / free <= at:
            return at
        at = (budget - used) / free


def _targets(sized: DataFrame, weights, share, epochs) -> DataFrame:
    totals = sized.groupBy("_none", "_name").agg(F.sum("_size").alias("_source_size"))
    order = ranked(totals, ["_none", "_name"], "_source_size")
    picked = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    sources = stored(order.select("_none", "_name", "_source_size", picked.alias("weight")), "sources")
    at = level(sources, share, epochs)
    target = F.least(F.col("_source_size") * float(epochs), F.lit(at) * F.col("weight"))
    ratio = F.when(F.col("_source_size") > 0, F.col("_target") / F.col("_source_size")).otherwise(F.lit(0.0))
    return (
        sources.withColumn("_target", target)
        .withColumn("_whole", F.floor(ratio))
        .withColumn("_goal", F.col("_target") - F.col("_whole") * F.col("_source_size"))
    )


def mixed(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, seed: str = SEED) -> DataFrame:
    """Adds ``_size``, ``_source_size``, ``_target`` and ``_times``, how often the mix takes the row.

    Needs ``doc_id``, ``text`` and ``source``. All rows of a source are taken
    as often as its target divided by its size says; the rest of the target is
    filled with rows in the order of a seeded hash, to the row whose middle
    passes it. A source, however large, is spread over buckets of that hash:
    sums of buckets find where a bucket begins, and only inside a bucket rows
    are sorted. Reruns agree.

    A null source is a source of its own, behind all others. Null and empty
    texts have size 0; they are taken as often as their whole source and never
    as part of a rest. Repeated rows count each. An empty table stays empty.
    """
    keyed = _keyed(docs, seed)
    narrow = stored(keyed.select("_none", "_name", "_bucket", "_size"), "sized")
    targets = _targets(narrow, weights, share, epochs)
    buckets = narrow.groupBy("_none", "_name", "_bucket").agg(F.sum("_size").alias("_sum"))
    earlier = Window.partitionBy("_none", "_name").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    begun = buckets.withColumn("_begin", F.coalesce(F.sum("_sum").over(earlier), F.lit(0).cast("long"))).drop("_sum")
    begun = begun.join(targets, ["_none", "_name"])
    inside = Window.partitionBy("_none", "_name", "_bucket").orderBy("_key", "doc_id", "_size")
    before = F.coalesce(F.sum("_size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    rows = keyed.join(begun, ["_none", "_name", "_bucket"]).withColumn("_inside", before)
    middle = (F.col("_begin") + F.col("_inside")) * 2 + F.col("_size")
    extra = (F.col("_size") > 0) & (middle.cast("double") <= F.col("_goal") * 2)
    times: Column = F.col("_whole") + extra.cast("long")
    return rows.select(*docs.columns, "_size", "_source_size", "_target", times.alias("_times"))


def mix_documents(docs: DataFrame) -> DataFrame:
    """The mix itself: every document as often as it is taken."""
    rows = mixed(docs.select(*DOCUMENT_COLUMNS)).filter("_times > 0")
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.col("_times")))
    return rows.select(*DOCUMENT_COLUMNS, copies.alias("_copy")).drop("_copy")


SQL = f"""
WITH sized AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
           md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null')) AS k FROM documents),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM totals),
levels AS (
    SELECT ({SHARE} * sum(source_size) OVER () - coalesce(sum({EPOCHS}.0::DOUBLE * source_size) OVER (
               ORDER BY source_size::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
           / sum(weight) OVER (ORDER BY source_size::DOUBLE / weight, source NULLS LAST
                               ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS lvl FROM weighed),
targets AS (SELECT *, least({EPOCHS}.0::DOUBLE * source_size, (SELECT max(lvl) FROM levels) * weight) AS target FROM weighed),
goals AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM targets),
placed AS (
    SELECT s.doc_id, s.size, g.source_size, g.target, g.whole, g.target - g.whole * g.source_size AS goal,
           coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.k, s.doc_id, s.size
                                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
    FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
       (size * (whole + CASE WHEN size > 0 AND 2 * before + size <= 2 * goal THEN 1 ELSE 0 END))::BIGINT AS taken
FROM placed"""
