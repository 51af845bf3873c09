"""Queries on sources and sinks. Round trips write below the shared folder and read back."""
from pyspark.sql import functions as F

from sigspark.functions.arrays import fold_sum, rounded
from sigspark.functions.session import scratch_path
from sigspark.operators import splits
from sigspark.plans.bindings import REC, conv, rec, table
from sigspark.sources import schemas, tables

CUSTOMER = "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
CONVERSATION = f"conv_id bigint, conversations {schemas.TURNS}"

URL_PATH = r"^https?://([^?#]*)"


def url_paths(spark, d):
    """Page urls without scheme, query and fragment: host/part/part."""
    return table(spark, d, "pages").select("page_id", F.regexp_extract("url", URL_PATH, 1).alias("path"))


URLS = f"urls AS (SELECT page_id, regexp_extract(url, '{URL_PATH}', 1) AS path FROM pages)"


def csv_round_trip(spark, d):
    path = scratch_path(spark, "csv")
    tables.write_csv(table(spark, d, "customer"), path)
    back = tables.read_csv(spark, path, CUSTOMER)
    return back.groupBy("c_nationkey", "c_mktsegment").agg(
        F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"), F.max("c_name").alias("last_name")
    )


def json_round_trip(spark, d):
    path = scratch_path(spark, "json")
    tables.write_json(conv(spark, d), path)
    back = tables.read_json(spark, path, CONVERSATION)
    turns = back.select("conv_id", F.posexplode("conversations").alias("turn", "t"))
    return turns.select(
        "conv_id", F.col("turn").cast("bigint").alias("turn"), F.col("t.from").alias("role"), F.md5("t.value").alias("value_md5")
    )


def recording_store(spark, d):
    r = rec(spark, d).select(
        F.col("rec_id").cast("string").alias("rec_id"),
        F.element_at(F.array(F.lit("ptb"), F.lit("mimic"), F.lit("csn")), (F.col("label") % 3 + 1).cast("int")).alias("base_data"),
        F.lit(16).alias("segment_len"),
        F.lit("report").alias("report"),
        F.col("ecg").cast("array<array<float>>").alias("ecg"),
    )
    path = scratch_path(spark, "segments")
    tables.write_segments(r, path)
    back = tables.read_segments(spark, path, ["ptb", "mimic", "csn"], 16)
    leads = back.select("base_data", "rec_id", F.posexplode("ecg").alias("lead", "x"))
    return leads.select("base_data", "rec_id", "lead", rounded(fold_sum(F.transform("x", lambda v: v.cast("double")))).alias("total"))


def segment_naming(spark, d):
    u = url_paths(spark, d).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(2))))
    corpus = F.when(F.col("page_id") % 4 == 0, "code15").otherwise("ptb")
    return u.select("page_id", "j", tables.stored_key(corpus, F.col("path"), F.col("page_id").cast("string"), F.col("j")).alias("segment_key"))


def keyed_shard_index(spark, d):
    parts = table(spark, d, "events").select(
        F.lpad(F.col("user_id").cast("string"), 9, "0").cast("binary").alias("exam_id"),
        (F.col("event_id") % 18).alias("part"),
        F.floor(F.col("event_id") / 18).alias("idx"),
    )
    return tables.keyed_index(parts, "exam_id")


def file_name_index(spark, d):
    return tables.file_name_index(url_paths(spark, d))


def path_list_round_trip(spark, d):
    path = scratch_path(spark, "paths")
    lines = table(spark, d, "pages").select(
        F.explode(F.array(F.concat(F.lit("  "), "url", F.lit("\t")), F.lit("   "), F.lit(""))).alias("line")
    )
    tables.write_paths(lines, "line", path)
    return tables.read_paths(spark, path).groupBy("path").agg(F.count("*").alias("n"))


def split_publication(spark, d):
    o = table(spark, d, "orders").select(
        F.concat(F.lit("./data/mimic/p"), F.col("o_custkey"), F.lit("/s"), F.col("o_orderkey"), F.lit("_0.npy")).alias("ecg_path"),
        tables.json_text(F.struct(F.col("o_orderpriority").alias("question"), F.col("o_orderstatus").alias("answer"))).alias("text"),
        F.lit("").alias("name"),
        F.col("o_orderkey").alias("row"),
        F.col("o_custkey").cast("string").alias("patient"),
    )
    path = scratch_path(spark, "splits")
    tables.write_splits(splits.grouped_split(o, "row", "patient", folds=2).withColumn("dataset", F.lit("orders")), path)
    parts = None
    for fold in (1, 2):
        for split in ("train", "test"):
            part = tables.read_split(spark, path, "orders", fold, split).groupBy("fold", "split").agg(
                F.count("*").alias("n"), F.count_distinct("ecg_path").alias("paths"), F.max("text").alias("last_text")
            )
            parts = part if parts is None else parts.unionByName(part)
    return parts


def json_text(spark, d):
    c = table(spark, d, "conversations")
    row = F.struct(F.col("role").alias("from"), F.col("text").alias("value"))
    return c.select("conv_id", "turn", F.md5(tables.json_text(row)).alias("text_md5"))


def lenient_json(spark, d):
    e = table(spark, d, "events").select(
        "event_id", F.when(F.col("event_id") % 10 == 0, F.expr("substring(props, 1, length(props) - 1)")).otherwise(F.col("props")).alias("text")
    )
    back = tables.with_decoded(e)
    return back.select(
        "event_id", F.try_variant_get("decoded", "$.k", "bigint").alias("k"), "raw", F.col("decoded").isNotNull().alias("is_json")
    )


def token_vectors_artefact(spark, d):
    e = table(spark, d, "embeddings").select(
        F.col("vec_id").cast("int").alias("token_id"), F.col("embedding").alias("vector"), F.col("label").cast("bigint").alias("freq")
    )
    path = scratch_path(spark, "vectors")
    tables.write_token_vectors(e, path)
    back = tables.read_token_vectors(spark, path)
    return back.select(
        "token_id", "freq", F.size("vector").alias("dim"), rounded(fold_sum(F.transform("vector", lambda x: x.cast("double")))).alias("total")
    )


def file_alignment(spark, d):
    signals = table(spark, d, "orders").select(
        F.concat(F.lit("signals/x7/rec_"), "o_orderkey", F.lit("_"), F.col("o_orderkey") % 7 + 1, F.lit(".npy")).alias("path")
    )
    texts = table(spark, d, "lineitem").select(
        F.concat(F.lit("texts/"), "l_linestatus", F.lit("/note_"), "l_orderkey", F.lit("_"), "l_linenumber", F.lit("_"), "l_partkey", F.lit(".json")).alias("path")
    )
    return tables.align_files(signals, texts)


def split_sql(folds, ratio=0.7, seed=42):
    """Sequential greedy walk over groups sorted by size, for each fold, as a recursive query over the size histogram."""
    return f"""
sizes AS (SELECT 'g' || grp AS g, count(*) AS size FROM keyed GROUP BY 1),
hist AS (SELECT size, count(*) AS n, row_number() OVER (ORDER BY size DESC) AS i FROM sizes GROUP BY size),
walk AS (SELECT 0::BIGINT AS i, round_even((SELECT count(*) FROM keyed) * {ratio}, 0)::BIGINT AS remaining, 0::BIGINT AS size, 0::BIGINT AS taken
         UNION ALL SELECT h.i, w.remaining - least(h.n, w.remaining // h.size) * h.size, h.size, least(h.n, w.remaining // h.size)
         FROM walk w JOIN hist h ON h.i = w.i + 1),
placed AS (SELECT f + 1 AS fold, g, size, row_number() OVER (PARTITION BY f, size ORDER BY md5(({seed} + f) || ':' || g), g) AS rn
           FROM sizes, range({folds}) t(f)),
chosen AS (SELECT p.fold, p.g, CASE WHEN p.rn <= w.taken THEN 'train' ELSE 'test' END AS split
           FROM placed p JOIN walk w ON w.size = p.size AND w.i > 0)"""


PLANS = {
    "csv_round_trip": (
        csv_round_trip,
        """SELECT c_nationkey, c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS balance, max(c_name) AS last_name
           FROM customer GROUP BY 1, 2""",
    ),
    "json_round_trip": (json_round_trip, "SELECT conv_id, turn, role, md5(text) AS value_md5 FROM conversations"),
    "recording_store": (
        recording_store,
        f"""WITH {REC} SELECT ['ptb', 'mimic', 'csn'][label % 3 + 1] AS base_data, rec_id::VARCHAR AS rec_id, lead,
            round(sum(x), 8) + 0.0 AS total FROM samples GROUP BY ALL""",
    ),
    "segment_naming": (
        segment_naming,
        f"""WITH {URLS} SELECT page_id, j::INT AS j, CASE WHEN page_id % 4 = 0 THEN page_id || '_' || j
            ELSE replace(path, '/', '_') || '_' || j END AS segment_key FROM urls, range(3) t(j)""",
    ),
    "keyed_shard_index": (
        keyed_shard_index,
        """SELECT user_id::VARCHAR AS key, arg_max(event_id % 18, (event_id % 18, event_id // 18)) AS part,
                  arg_max(event_id // 18, (event_id % 18, event_id // 18)) AS idx FROM events GROUP BY 1""",
    ),
    "file_name_index": (
        file_name_index,
        f"""WITH {URLS} SELECT split_part(split_part(path, '/', -1), '.', 1) AS stem, max(path) AS path FROM urls GROUP BY 1""",
    ),
    "path_list_round_trip": (path_list_round_trip, "SELECT trim(url) AS path, count(*) AS n FROM pages GROUP BY 1"),
    "split_publication": (
        split_publication,
        f"""WITH RECURSIVE keyed AS (SELECT o_orderkey AS id, o_custkey::VARCHAR AS grp, o_orderpriority, o_orderstatus FROM orders), {split_sql(2)}
            SELECT fold::INT AS fold, split, count(*) AS n, count(DISTINCT id) AS paths,
                   max('{{"question":"' || o_orderpriority || '","answer":"' || o_orderstatus || '"}}') AS last_text
            FROM keyed JOIN chosen ON g = 'g' || grp GROUP BY 1, 2""",
    ),
    "json_text": (
        json_text,
        """SELECT conv_id, turn, md5(to_json({'from': role, 'value': text})::VARCHAR) AS text_md5 FROM conversations""",
    ),
    "lenient_json": (
        lenient_json,
        """SELECT event_id, CASE WHEN event_id % 10 <> 0 THEN (props::JSON->>'$.k')::BIGINT END AS k,
                  CASE WHEN event_id % 10 = 0 THEN props[1:length(props) - 1] END AS raw, event_id % 10 <> 0 AS is_json FROM events""",
    ),
    "token_vectors_artefact": (
        token_vectors_artefact,
        """SELECT vec_id::INT AS token_id, label::BIGINT AS freq, len(embedding)::INT AS dim,
                  round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 8) + 0.0 AS total FROM embeddings""",
    ),
    "file_alignment": (
        file_alignment,
        r"""WITH sig AS (SELECT 'signals/x7/rec_' || o_orderkey || '_' || (o_orderkey % 7 + 1) || '.npy' AS p, o_orderkey AS a, o_orderkey % 7 + 1 AS b FROM orders),
            txt AS (SELECT max('texts/' || l_linestatus || '/note_' || l_orderkey || '_' || l_linenumber || '_' || l_partkey || '.json') AS p,
                           l_orderkey AS a, l_linenumber::BIGINT AS b FROM lineitem GROUP BY 2, 3)
            SELECT a, b, sig.p AS signal, txt.p AS text FROM sig JOIN txt USING (a, b)""",
    ),
}
