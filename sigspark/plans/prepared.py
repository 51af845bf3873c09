"""Queries on metadata preparation, mapping and splits."""
from pyspark.sql import functions as F

from sigspark.operators import mapping, prep, splits
from sigspark.plans.bindings import table
from sigspark.plans.stored import URLS, split_sql, url_paths
from sigspark.sources import tables

LINES = [f"report_{i}" for i in range(1, 8)]


# --- preparation -----------------------------------------------------------
def rename_project(spark, d):
    return prep.select_renamed(table(spark, d, "documents"), {"source": "path", "n_chars": "report_chars", "doc_id": "doc_id"})


def measurements(spark, d):
    """Seven nullable report columns per order, from the flags of its open lines."""
    flag = F.when(F.col("l_linestatus") == "O", F.concat("l_returnflag", F.lit("-"), F.col("l_linenumber")))
    cells = [F.max(F.when(F.col("l_linenumber") == i, flag)).alias(f"report_{i}") for i in range(1, 8)]
    grouped = table(spark, d, "lineitem").groupBy("l_orderkey").agg(*cells)
    return grouped.select(
        F.col("l_orderkey").alias("study_id"), (F.col("l_orderkey") % 100).alias("subject_id"), *LINES
    )


MEASURED = "measured AS (SELECT l_orderkey AS study_id, l_orderkey % 100 AS subject_id, " + ", ".join(
    f"max(l_returnflag || '-' || l_linenumber) FILTER (l_linenumber = {i} AND l_linestatus = 'O') AS report_{i}" for i in range(1, 8)
) + " FROM lineitem GROUP BY l_orderkey)"
_JOINED = "concat_ws(' ', " + ", ".join(LINES) + ")"
_SOME = "coalesce(" + ", ".join(LINES) + ") IS NOT NULL"
_EVERY = " AND ".join(f"{c} IS NOT NULL" for c in LINES)


def nonnull_concat(spark, d):
    return measurements(spark, d).select("study_id", prep.joined_text(LINES).alias("report"))


def drop_all_null_rows(spark, d):
    return prep.drop_if_all_null(measurements(spark, d), LINES).select("study_id")


def drop_any_null_rows(spark, d):
    return prep.drop_if_any_null(measurements(spark, d), LINES).select("study_id", prep.joined_text(LINES).alias("report"))


def null_row_counts(spark, d):
    return prep.null_counts(measurements(spark, d), LINES)


def two_key_join(spark, d):
    li = table(spark, d, "lineitem")
    keys = ["l_orderkey", "l_linenumber"]
    records = li.groupBy(*keys).agg(F.sum("l_quantity").alias("quantity"))
    prices = li.filter(F.col("l_tax") > 0).groupBy(*keys).agg(F.max("l_extendedprice").alias("price"))
    return records.join(prices, keys)


def measured_reports(spark, d):
    records = table(spark, d, "orders").select(
        (F.col("o_orderkey") % 100).alias("subject_id"),
        F.col("o_orderkey").alias("study_id"),
        F.concat(F.lit("files/p"), F.col("o_custkey"), F.lit("/s"), F.col("o_orderkey")).alias("path"),
    )
    return prep.measured_reports(records, measurements(spark, d), LINES)


def head_rows(spark, d):
    return prep.first_rows(table(spark, d, "orders"), ["o_orderkey"], 1000).select("o_orderkey", "o_custkey")


def lookup_enrichment(spark, d):
    u = url_paths(spark, d)
    items = u.select("page_id", F.concat(F.regexp_replace("path", r"\.[a-z]+$", ""), F.lit("-0.png")).alias("image_path"))
    index = tables.file_name_index(u.filter(F.col("path").endswith(".html")))
    return prep.enriched(items, index).select("page_id", "orig_file_name", "path")


def masked_apply(spark, d):
    text = F.when(F.col("doc_id") % 5 == 0, F.lit("   ")).when(F.col("doc_id") % 7 == 0, None).otherwise(F.col("text"))
    docs = table(spark, d, "documents").select("doc_id", text.alias("report"))
    prep.require_text(docs, "report")
    tagged = prep.on_text(F.col("report"), lambda t: F.concat(F.lit("[en] "), t))
    return docs.select("doc_id", F.md5(tagged).alias("report_md5"), F.length(tagged).alias("chars"))


def ordered_dedupe(spark, d):
    return prep.first_occurrences(table(spark, d, "documents"), F.md5("text"), "doc_id")


def question_type_filter(spark, d):
    e = table(spark, d, "events").select("event_id", F.col("event_type").alias("question_type"), "value")
    files = {
        "template/low.json": e.filter(F.col("value") < 40),
        "paraphrased/high.json": e.filter(F.col("value") >= 90),
        "paraphrased/mid.json": e.filter((F.col("value") >= 40) & (F.col("value") < 90)),
    }
    return prep.question_files(files, ["click", "view", "error"]).select("file_order", "file", "question_type", "event_id")


def _mixed(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text")
    pages = table(spark, d, "pages").select(F.col("page_id").alias("id"), F.col("html").alias("text"))
    return prep.mixed({"docs_mapped_1250": docs, "items_mapped_500": items, "pages_raw": pages})


def dataset_mixing(spark, d):
    return _mixed(spark, d).select("dataset", "id", F.md5("text").alias("text_md5"))


def mix_summary(spark, d):
    return prep.mix_summary(_mixed(spark, d))


def path_rewriting(spark, d):
    u = url_paths(spark, d)
    stored = F.concat(F.lit("./data/"), F.col("path"))
    name = F.when(F.col("page_id") % 3 == 0, F.lit("pages"))
    return u.select("page_id", prep.moved_path(stored, "./corpus/data").alias("path"), prep.or_empty(name).alias("name"))


# --- mapping ---------------------------------------------------------------
def chat_keys(spark, d):
    return url_paths(spark, d).select("page_id", mapping.chat_key(F.col("path")).alias("key"))


def qa_keys(spark, d):
    paths = F.array(F.concat(F.lit("./store/"), F.col("path")), F.lit("unused/second"))
    text = mapping.qa_text(F.lit("single-verify"), F.col("path"), F.col("page_id").cast("string"))
    return url_paths(spark, d).select("page_id", mapping.qa_key(paths).alias("key"), F.array_join(text, "|").alias("text"))


_SETS = ["ecgqa-test", "cpsc-test", "code15-test", "csn-test-no-cot", "ptb-test", "other-test"]


def benchmark_keys(spark, d):
    u = url_paths(spark, d)
    docs = table(spark, d, "documents").select("doc_id", "source")
    name = F.element_at(F.array(*map(F.lit, _SETS)), (F.col("doc_id") % 6 + 1).cast("int"))
    file = F.when(F.col("doc_id") % 6 == 2, F.concat(F.col("doc_id"), F.lit("-"), "source")).otherwise(
        F.lpad((F.col("doc_id") * 7 % 1000).cast("string"), 3, "0")
    )
    items = docs.select("doc_id", name.alias("name"), file.alias("file_name"))
    index = tables.file_name_index(u.withColumn("path", F.regexp_replace("path", r"\.[a-z]+$", "")))
    index = index.withColumn("stem", F.lpad("stem", 3, "0")).groupBy("stem").agg(F.max("path").alias("path"))
    return mapping.with_benchmark_key(items, index).select("doc_id", "name", "key")


_BENCHMARK = f"""WITH {URLS},
items AS (SELECT doc_id, ['ecgqa-test', 'cpsc-test', 'code15-test', 'csn-test-no-cot', 'ptb-test', 'other-test'][doc_id % 6 + 1] AS name,
                 CASE WHEN doc_id % 6 = 2 THEN doc_id || '-' || source ELSE lpad((doc_id * 7 % 1000)::VARCHAR, 3, '0') END AS f FROM documents),
plain AS (SELECT regexp_replace(path, '\\.[a-z]+$', '') AS path FROM urls),
idx AS (SELECT substring(lpad(split_part(split_part(path, '/', -1), '.', 1), 3, '0'), 1, 3) AS stem, max(path) AS path FROM plain GROUP BY 1)
SELECT doc_id, name, CASE
    WHEN doc_id % 6 IN (0, 4) THEN 'records500_' || substring(f, 1, 2) || '000_' || f
    WHEN doc_id % 6 IN (1, 3) THEN replace(path, '/', '_')
    WHEN doc_id % 6 = 2 THEN split_part(f, '-', 1) END AS key
FROM items LEFT JOIN idx ON f = stem"""


def _three(*names):
    return F.element_at(F.array(*map(F.lit, names)), (F.col("page_id") % len(names) + 1).cast("int"))


def image_keys(spark, d):
    u = url_paths(spark, d)
    tail = F.concat(F.col("page_id"), F.lit("_lr-0.png"))
    image = F.concat_ws("/", _three("mimic_v4", "ptb-xl", "code15_v4", "mimic", "unknown"), "path", tail)
    corpus, key = mapping.image_key(image)
    return u.select("page_id", corpus.alias("corpus"), key.alias("key"))


def grounding_keys(spark, d):
    u = url_paths(spark, d)
    path = F.concat_ws("/", _three("mimic-iv", "ecg_ptbxl_benchmarking", "code15", "unknown"), "path", F.concat(F.lit("f"), "page_id"))
    corpus, key = mapping.grounding_key(path)
    return u.select("page_id", corpus.alias("corpus"), key.alias("key"))


def _instances(spark, d):
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("inst_id"),
        F.lit("mimic").alias("corpus"),
        F.concat(F.lit("p_"), F.col("o_orderkey")).alias("key"),
        F.col("o_orderpriority").alias("text"),
        F.when(F.col("o_orderstatus") == "O", F.lit("open")).alias("name"),
    )


def _segments(spark, d):
    stems = table(spark, d, "lineitem").select(
        F.concat(F.lit("p_"), F.col("l_orderkey"), F.lit("_"), F.col("l_linenumber")).alias("stem")
    )
    return mapping.segment_names(stems)


def instance_mapping(spark, d):
    return mapping.map_instances(_instances(spark, d), _segments(spark, d), 1250, 250)


def mapping_audit(spark, d):
    return mapping.mapping_audit(_instances(spark, d), _segments(spark, d))


def corpus_assembly(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", "role", F.split("text", " ").alias("values"))
    sources = {
        "cpsc-test": c.filter(F.col("role") == "system"),
        "ptb-test": c.filter(F.col("role") == "user"),
        "ecgqa-test": c.filter(F.col("role") == "assistant"),
    }
    all_turns = mapping.assembled(sources)
    value = mapping.flat_values(F.col("name"), F.col("values"))
    return all_turns.select("conv_id", "turn", "name", F.md5(value).alias("value_md5"))


def _qa(spark, d):
    """Every document; without a label its answer is that it was not rated."""
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    said = lambda c, yes, no: F.when(F.col(c) == 1, yes).when(F.col(c).isNull(), "unrated").otherwise(no)
    answers = F.array(said("quality", "yes", "no"), said("toxic", "unsafe", "safe"))
    return docs.select(
        "doc_id", F.col("lang").alias("category"), F.md5("text").alias("question"), mapping.answer_text(answers).alias("answer")
    )


def category_counts(spark, d):
    return mapping.category_counts(_qa(spark, d), "category")


def category_samples(spark, d):
    return mapping.category_samples(_qa(spark, d), "category", "doc_id").select("category", "place", "doc_id", "question", "answer")


_QA = """WITH qa AS (SELECT doc_id, lang AS category, md5(text) AS question,
    CASE WHEN quality = 1 THEN 'yes' WHEN quality IS NULL THEN 'unrated' ELSE 'no' END || ' ' ||
    CASE WHEN toxic = 1 THEN 'unsafe' WHEN toxic IS NULL THEN 'unrated' ELSE 'safe' END AS answer
  FROM documents LEFT JOIN labels USING (doc_id))"""


# --- splits ----------------------------------------------------------------
def _recording_paths(spark, d):
    o = table(spark, d, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    path = (
        F.when(k % 4 == 0, F.concat(F.lit("./data/mimic/files/p1000/p"), c, F.lit("/s"), k, F.lit("_0.npy")))
        .when(k % 4 == 1, F.concat(F.lit("./data/PTB/records500_00000_"), c, F.lit("_hr_0.npy")))
        .when(k % 4 == 2, F.concat(F.lit("./data/code15/p"), c, F.lit("_"), k, F.lit("_hr_0.npy")))
        .otherwise(F.concat(F.lit("/store//mimic/p"), c, F.lit("/"), k))
    )
    return o.select(k.alias("row"), path.alias("ecg_path"))


def patient_ids(spark, d):
    p = _recording_paths(spark, d)
    return p.select("row", splits.corpus_of(F.col("ecg_path")).alias("corpus"), splits.patient_of(F.col("ecg_path")).alias("patient"))


def _patients(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("row"), F.col("o_custkey").cast("string").alias("patient"))


def grouped_split(spark, d):
    return splits.grouped_split(_patients(spark, d), "row", "patient").select("row", "patient", "split")


def fold_sizes(spark, d):
    s = splits.grouped_split(_patients(spark, d), "row", "patient", folds=5)
    return s.groupBy("fold", "split").agg(
        F.count("*").alias("rows"), F.count_distinct("patient").alias("patients"), F.sum("row").alias("row_sum")
    )


def leakage_check(spark, d):
    s = splits.grouped_split(_patients(spark, d), "row", "patient", folds=5)
    return splits.leaking_groups(s, "patient")


def recording_path_split(spark, d):
    """Patients from paths where there are any, single rows elsewhere."""
    p = _recording_paths(spark, d).withColumn("patient", splits.patient_of(F.col("ecg_path")))
    return splits.grouped_split(p, "row", "patient").groupBy("split").agg(F.count("*").alias("rows"), F.sum("row").alias("row_sum"))


_PATHS = """paths AS (SELECT o_orderkey AS row, CASE o_orderkey % 4 WHEN 0 THEN 'mimic' WHEN 1 THEN 'ptb' WHEN 2 THEN 'code15' ELSE '' END AS corpus,
    CASE o_orderkey % 4
        WHEN 0 THEN CASE WHEN o_custkey >= 1000 THEN CASE WHEN o_custkey >= 10000 THEN 'p' || o_custkey ELSE 'p1000' END ELSE 'p1000' END
        WHEN 1 THEN o_custkey::VARCHAR END AS patient FROM orders)"""


def row_sample(spark, d):
    return splits.sample_rows(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 5000)


def fraction_subset(spark, d):
    return splits.sample_fraction(table(spark, d, "documents").select("doc_id", "lang"), "doc_id", 0.6)


def aligned_sample(spark, d):
    o = table(spark, d, "orders")
    left = o.select("o_orderkey", "o_totalprice")
    right = o.select("o_orderkey", "o_orderpriority")
    return splits.sample_aligned(left, right, "o_orderkey", 0.05, seed=7)


PLANS = {
    "rename_project": (rename_project, "SELECT source AS path, n_chars AS report_chars, doc_id FROM documents"),
    "nonnull_concat": (nonnull_concat, f"WITH {MEASURED} SELECT study_id, {_JOINED} AS report FROM measured"),
    "drop_all_null_rows": (drop_all_null_rows, f"WITH {MEASURED} SELECT study_id FROM measured WHERE {_SOME}"),
    "drop_any_null_rows": (drop_any_null_rows, f"WITH {MEASURED} SELECT study_id, {_JOINED} AS report FROM measured WHERE {_EVERY}"),
    "null_row_counts": (
        null_row_counts,
        f"WITH {MEASURED} SELECT count(*) FILTER ({_EVERY}) AS kept, count(*) FILTER (NOT ({_EVERY})) AS dropped FROM measured",
    ),
    "two_key_join": (
        two_key_join,
        """SELECT l_orderkey, l_linenumber, sum(l_quantity) AS quantity, max(l_extendedprice) FILTER (l_tax > 0) AS price
           FROM lineitem GROUP BY 1, 2 HAVING count(*) FILTER (l_tax > 0) > 0""",
    ),
    "measured_reports": (
        measured_reports,
        f"""WITH {MEASURED} SELECT 'files/p' || o_custkey || '/s' || o_orderkey AS path, {_JOINED} AS report
            FROM orders JOIN measured ON study_id = o_orderkey WHERE {_SOME}""",
    ),
    "head_rows": (head_rows, "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 1000"),
    "lookup_enrichment": (
        lookup_enrichment,
        f"""WITH {URLS}, idx AS (SELECT split_part(split_part(path, '/', -1), '.', 1) AS stem, max(path) AS path FROM urls
                                 WHERE path LIKE '%.html' GROUP BY 1),
            keyed AS (SELECT page_id, split_part(split_part(regexp_replace(path, '\\.[a-z]+$', ''), '/', -1), '-', 1) AS k FROM urls)
            SELECT page_id, k AS orig_file_name, path FROM keyed JOIN idx ON k = stem""",
    ),
    "masked_apply": (
        masked_apply,
        """WITH t AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 OR doc_id % 7 = 0 OR trim(text) = '' THEN '' ELSE '[en] ' || text END AS t FROM documents)
           SELECT doc_id, md5(t) AS report_md5, length(t)::INT AS chars FROM t""",
    ),
    "ordered_dedupe": (ordered_dedupe, "SELECT md5(text) AS key, min(doc_id) AS doc_id FROM documents GROUP BY 1"),
    "question_type_filter": (
        question_type_filter,
        """SELECT CASE WHEN value >= 90 THEN 0 WHEN value >= 40 THEN 1 ELSE 2 END AS file_order,
                  CASE WHEN value >= 90 THEN 'paraphrased/high.json' WHEN value >= 40 THEN 'paraphrased/mid.json' ELSE 'template/low.json' END AS file,
                  event_type AS question_type, event_id FROM events WHERE event_type IN ('click', 'view', 'error')""",
    ),
    "dataset_mixing": (
        dataset_mixing,
        """SELECT 'docs_mapped_1250' AS dataset, doc_id AS id, md5(text) AS text_md5 FROM documents
           UNION ALL SELECT 'items_mapped_500', item_id, md5(text) FROM benchmark
           UNION ALL SELECT 'pages_raw', page_id, md5(html) FROM pages""",
    ),
    "mix_summary": (
        mix_summary,
        """WITH c AS (SELECT 'docs_mapped_1250' AS dataset, count(*) AS n, 1250 AS segment_len FROM documents
                      UNION ALL SELECT 'items_mapped_500', count(*), 500 FROM benchmark
                      UNION ALL SELECT 'pages_raw', count(*), NULL FROM pages)
           SELECT dataset, n, segment_len::INT AS segment_len, (sum(n) OVER ())::BIGINT AS total FROM c""",
    ),
    "path_rewriting": (
        path_rewriting,
        f"WITH {URLS} SELECT page_id, './corpus/data/' || path AS path, CASE WHEN page_id % 3 = 0 THEN 'pages' ELSE '' END AS name FROM urls",
    ),
    "chat_keys": (chat_keys, f"WITH {URLS} SELECT page_id, replace(path, '/', '_') AS key FROM urls"),
    "qa_keys": (
        qa_keys,
        f"WITH {URLS} SELECT page_id, replace(path, '/', '_') AS key, 'single-verify|' || path || '|' || page_id AS text FROM urls",
    ),
    "benchmark_keys": (benchmark_keys, _BENCHMARK),
    "image_keys": (
        image_keys,
        f"""WITH {URLS} SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'mimic' WHEN 1 THEN 'ptb' WHEN 2 THEN 'code15' WHEN 3 THEN 'mimic' END AS corpus,
            CASE WHEN page_id % 5 IN (0, 3) THEN 'files_' || replace(path, '/', '_') || '_' || page_id || '_lr'
                 WHEN page_id % 5 = 1 THEN 'records500_' || substring(page_id || '_hr', 1, 2) || '000_' || page_id || '_hr'
                 WHEN page_id % 5 = 2 THEN page_id || '_lr' END AS key FROM urls""",
    ),
    "grounding_keys": (
        grounding_keys,
        f"""WITH {URLS}, p AS (SELECT page_id, string_split(path || '/f' || page_id, '/') AS parts FROM urls)
            SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'mimic' WHEN 1 THEN 'ptb' WHEN 2 THEN 'code15' END AS corpus,
            CASE page_id % 4 WHEN 0 THEN array_to_string(parts, '_') WHEN 1 THEN array_to_string(parts[3:], '_') WHEN 2 THEN parts[-1] END AS key FROM p""",
    ),
    "instance_mapping": (
        instance_mapping,
        """WITH seg AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)
           SELECT o_orderkey AS inst_id, l_linenumber AS seg_idx,
                  './data/mimic/preprocessed_1250_250/p_' || o_orderkey || '_' || l_linenumber || '.npy' AS ecg_path,
                  o_orderpriority AS text, CASE WHEN o_orderstatus = 'O' THEN 'open' ELSE '' END AS name
           FROM orders JOIN seg ON o_orderkey = l_orderkey""",
    ),
    "mapping_audit": (
        mapping_audit,
        """WITH seg AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)
           SELECT (SELECT count(*) FROM orders)::BIGINT AS instances, (SELECT count(*) FROM seg)::BIGINT AS segments,
                  (SELECT count(*) FROM orders JOIN seg ON o_orderkey = l_orderkey)::BIGINT AS valid,
                  (SELECT count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM seg))::BIGINT AS unmatched""",
    ),
    "corpus_assembly": (
        corpus_assembly,
        """SELECT conv_id, turn, CASE role WHEN 'system' THEN 'cpsc-test' WHEN 'user' THEN 'ptb-test' ELSE 'ecgqa-test' END AS name,
                  md5(CASE WHEN role IN ('system', 'user') THEN text ELSE replace(text, ' ', '') END) AS value_md5
           FROM conversations""",
    ),
    "category_counts": (category_counts, _QA + " SELECT category, count(*) AS n FROM qa GROUP BY 1"),
    "category_samples": (
        category_samples,
        _QA + """, r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY doc_id)::INT AS place FROM qa)
                 SELECT category, place, doc_id, question, answer FROM r WHERE place <= 5""",
    ),
    "patient_ids": (patient_ids, f"WITH {_PATHS} SELECT row, corpus, patient FROM paths"),
    "grouped_split": (
        grouped_split,
        f"""WITH RECURSIVE keyed AS (SELECT o_orderkey AS row, o_custkey::VARCHAR AS grp FROM orders), {split_sql(1)}
            SELECT row, grp AS patient, split FROM keyed JOIN chosen ON g = 'g' || grp""",
    ),
    "fold_sizes": (
        fold_sizes,
        f"""WITH RECURSIVE keyed AS (SELECT o_orderkey AS row, o_custkey::VARCHAR AS grp FROM orders), {split_sql(5)}
            SELECT fold::INT AS fold, split, count(*) AS "rows", count(DISTINCT grp) AS patients, sum(row)::BIGINT AS row_sum
            FROM keyed JOIN chosen ON g = 'g' || grp GROUP BY 1, 2""",
    ),
    "leakage_check": (
        leakage_check,
        "SELECT f::INT AS fold, 0::BIGINT AS leaking, (SELECT count(DISTINCT o_custkey) FROM orders) AS groups FROM range(1, 6) t(f)",
    ),
    "recording_path_split": (
        recording_path_split,
        f"""WITH RECURSIVE {_PATHS}, keyed AS (SELECT row, coalesce('g' || patient, 'r' || row) AS grp FROM paths),
            {split_sql(1).replace("'g' || grp", "grp")}
            SELECT split, count(*) AS "rows", sum(row)::BIGINT AS row_sum FROM keyed JOIN chosen ON g = grp GROUP BY 1""",
    ),
    "row_sample": (row_sample, "SELECT o_orderkey FROM orders ORDER BY md5('42:' || o_orderkey), o_orderkey::VARCHAR LIMIT 5000"),
    "fraction_subset": (
        fraction_subset,
        """WITH r AS (SELECT doc_id, lang, row_number() OVER (ORDER BY md5('42:' || doc_id)) AS rn FROM documents)
           SELECT doc_id, lang FROM r WHERE rn <= floor((SELECT count(*) FROM documents) * 0.6::DOUBLE)""",
    ),
    "aligned_sample": (
        aligned_sample,
        """WITH r AS (SELECT *, row_number() OVER (ORDER BY md5('7:' || o_orderkey)) AS rn FROM orders)
           SELECT o_orderkey, o_totalprice, o_orderpriority FROM r WHERE rn <= floor((SELECT count(*) FROM orders) * 0.05::DOUBLE)""",
    ),
}
