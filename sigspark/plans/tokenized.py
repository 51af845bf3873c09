"""Queries on byte-pair tokens and token statistics."""
from pyspark.sql import functions as F

from sigspark.functions.arrays import rounded, unrolled
from sigspark.functions.session import scratch_path
from sigspark.operators import bpe, splits, tokens, vectors
from sigspark.plans.bindings import table
from sigspark.plans.signals import PAIRS_SQL, SYMBOL_SQL, sql_uniform, symbol_table
from sigspark.sources import tables

R = 8
# Fixed vocabulary of the encoding queries: single letters and entries with shared prefixes.
VOCAB = ["mm", "mn", "nm", "nn", "mnm", "mnmn", "lm", "lmn", "ml", "nmn", "kl", "lk"]
ALPHABET = "abcdefghijklmnopqrstuvwxyz"
IDS = {c: ord(c) for c in ALPHABET} | {v: 256 + i for i, v in enumerate(VOCAB)}
_VOCAB_SQL = "vocab(symbols, token_id) AS (VALUES " + ", ".join(f"('{s}', {i})" for s, i in IDS.items()) + ")"
_PATTERN = "|".join(sorted(IDS, key=lambda s: (-len(s), s)))
ENCODED_SQL = f"""{SYMBOL_SQL}, {_VOCAB_SQL},
pieces AS (SELECT rec_id, unnest(regexp_extract_all(symbols, '{_PATTERN}')) AS piece,
                  generate_subscripts(regexp_extract_all(symbols, '{_PATTERN}'), 1) - 1 AS pos FROM symbols),
tokens AS (SELECT rec_id AS seq_id, pos::INT AS pos, token_id, piece FROM pieces JOIN vocab ON piece = symbols)"""


def _vocab(spark):
    return spark.createDataFrame([(i, s) for s, i in IDS.items()], "token_id int, symbols string")


def encoded(spark, d):
    """seq_id, pos, token_id, symbols of every recording under the fixed vocabulary."""
    s = symbol_table(spark, d).select(F.col("rec_id").alias("seq_id"), "symbols")
    return bpe.encode(s, "symbols", _vocab(spark), ["seq_id"])


def sequences(spark, d):
    """seq_id, tokens array under the fixed vocabulary."""
    s = symbol_table(spark, d)
    return s.select(F.col("rec_id").alias("seq_id"), bpe.encoded(F.col("symbols"), IDS).alias("tokens"))


def recording_sample_corpus(spark, d):
    """Symbols of sampled recordings; repeated and broken ones are left out."""
    s = symbol_table(spark, d).select("rec_id", "symbols").dropDuplicates(["rec_id"]).filter(F.length("symbols") > 0)
    picked = splits.sample_rows(s, "rec_id", 300)
    return picked.select("rec_id", F.length("symbols").alias("n"), "symbols")


def pair_counts(spark, d):
    return bpe.pair_counts(symbol_table(spark, d), "symbols")


def best_pair(spark, d):
    return bpe.top_pairs(bpe.pair_counts(symbol_table(spark, d), "symbols"), 1)


def single_merge(spark, d):
    return symbol_table(spark, d).select("rec_id", bpe.merged(F.col("symbols"), "m", "m", "M").alias("merged"))


MERGES = 8


def train_merges(spark, d):
    return bpe.train(symbol_table(spark, d), "symbols", MERGES)


def train_sql(merges=MERGES):
    """One statement per merge, each on the corpus that the merge before left; tokens are code points 4096 + id."""
    steps = [SYMBOL_SQL, "c0 AS (SELECT rec_id, translate(symbols, 'abcdefghijklmnopqrstuvwxyz', '"
             + "".join(chr(4096 + ord(c)) for c in ALPHABET) + "') AS s FROM symbols)",
             "names0 AS (SELECT i::INT AS id, chr(i::INT) AS name FROM range(97, 123) t(i))"]
    for k in range(1, merges + 1):
        steps.append(
            f"""b{k} AS MATERIALIZED (SELECT s[i] AS l, s[i + 1] AS r, count(*) AS n FROM c{k - 1}, range(1, 64) t(i)
                WHERE i < length(s) GROUP BY ALL ORDER BY n DESC, l, r LIMIT 1)""")
        steps.append(f"c{k} AS MATERIALIZED (SELECT rec_id, replace(s, l || r, chr({4096 + 255 + k})) AS s FROM c{k - 1}, b{k})")
        steps.append(
            f"""names{k} AS MATERIALIZED (SELECT id, name FROM names{k - 1} UNION ALL SELECT {255 + k}, x.name || y.name FROM b{k}
                JOIN names{k - 1} x ON x.id = ord(l) - 4096 JOIN names{k - 1} y ON y.id = ord(r) - 4096)""")
    rows = " UNION ALL ".join(
        f"""SELECT {k} AS rank, ord(l) - 4096 AS left_id, ord(r) - 4096 AS right_id, {255 + k} AS token_id, n, name AS symbols
            FROM b{k} JOIN names{k} ON id = {255 + k}""" for k in range(1, merges + 1))
    return "WITH " + ", ".join(steps) + " " + rows


def encode(spark, d):
    return encoded(spark, d).select("seq_id", "pos", "token_id")


def encode_arrays(spark, d):
    return unrolled(sequences(spark, d), ["seq_id"], F.col("tokens"), "token_id", "pos")


def decode(spark, d):
    return bpe.decode(encoded(spark, d), _vocab(spark), ["seq_id"])


def compression(spark, d):
    s = symbol_table(spark, d).select(F.length("symbols").alias("n"), F.size(bpe.tokens_of(F.col("symbols"), list(IDS))).alias("m"))
    return s.agg(
        F.sum("n").alias("original"),
        F.sum("m").alias("encoded"),
        rounded(F.sum("n") / F.sum("m")).alias("ratio"),
        F.lit(len(IDS)).alias("vocab_size"),
    )


def token_names(spark, d):
    named = encoded(spark, d).withColumn("name", tokens.token_name(F.col("token_id")))
    return named.select("name", tokens.token_number(F.col("name")).alias("back")).groupBy("name", "back").agg(F.count("*").alias("n"))


def token_frequencies(spark, d):
    return tokens.frequencies(encoded(spark, d))


_FREQ = """freq AS (SELECT id AS token_id, count(t.token_id) AS freq FROM range((SELECT max(token_id) + 1 FROM tokens)) r(id)
                    LEFT JOIN tokens t ON t.token_id = id GROUP BY 1)"""


def min_count_filter(spark, d):
    t = encoded(spark, d)
    kept = tokens.drop_rare(t, tokens.frequencies(t), 200)
    return kept.groupBy("token_id").agg(F.count("*").alias("n"), F.count_distinct("seq_id").alias("sequences"))


def subsample(spark, d):
    t = encoded(spark, d)
    kept = tokens.drop_short(tokens.subsampled(t, tokens.frequencies(t), 0.01))
    return kept.select("seq_id", "pos", "token_id")


_SUBSAMPLE = f"""{ENCODED_SQL}, {_FREQ},
rel AS (SELECT token_id, greatest(freq / (SELECT sum(freq) FROM freq)::DOUBLE, 1e-12) AS f FROM freq),
kept AS (SELECT seq_id, pos, token_id FROM tokens JOIN rel USING (token_id)
         WHERE {sql_uniform("concat_ws(':', '42', seq_id, pos)")} < least(1.0, sqrt(0.01::DOUBLE / f) + 0.01::DOUBLE / f))
SELECT * FROM kept WHERE seq_id IN (SELECT seq_id FROM kept GROUP BY 1 HAVING count(*) > 1)"""


def noise_distribution(spark, d):
    return tokens.noise_distribution(tokens.frequencies(encoded(spark, d))).select("token_id", rounded(F.col("p")).alias("p"))


_NOISE = f"""{ENCODED_SQL}, {_FREQ}, noise AS (SELECT token_id, freq, pow(freq, 0.75::DOUBLE) / (SELECT sum(pow(freq, 0.75::DOUBLE)) FROM freq) AS p FROM freq)"""


def skip_gram_pairs(spark, d):
    pairs = tokens.window_pairs(sequences(spark, d), 3)
    return pairs.groupBy("center", "context").agg(F.count("*").alias("n"))


def sampled_skip_grams(spark, d):
    return tokens.sampled_pairs(sequences(spark, d), 5, per_token=2)


_LENGTHS = "lens AS (SELECT seq_id, count(*) AS n FROM tokens GROUP BY 1)"
_SAMPLED = f"""{ENCODED_SQL}, {_LENGTHS},
drawn AS (SELECT seq_id, pos, draw::INT AS draw, token_id AS center, n,
                 floor({sql_uniform("concat_ws(':', '42w', seq_id, pos, draw)")} * 5)::INT + 1 AS w,
                 {sql_uniform("concat_ws(':', '42c', seq_id, pos, draw)")} AS u
          FROM tokens JOIN lens USING (seq_id), range(2) t(draw) WHERE n > 1),
placed AS (SELECT *, greatest(pos - w, 0) AS lo, least(pos + w, n - 1) AS hi FROM drawn),
picked AS (SELECT *, lo + floor(u * (hi - lo))::INT AS j0 FROM placed),
sampled AS (SELECT p.seq_id, p.pos, p.draw, p.center, t.token_id AS context FROM picked p
            JOIN tokens t ON t.seq_id = p.seq_id AND t.pos = CASE WHEN j0 >= p.pos THEN j0 + 1 ELSE j0 END)"""


def negative_samples(spark, d):
    pairs = tokens.sampled_pairs(sequences(spark, d), 5, per_token=1)
    noise = tokens.noise_distribution(tokens.frequencies(encoded(spark, d)))
    drawn = tokens.negatives(pairs, noise, 2)
    return drawn.select("seq_id", "pos", "k", "context", "negative")


_NEGATIVE = f"""WITH {_SAMPLED.replace("range(2) t(draw)", "range(1) t(draw)")}, {_FREQ},
noise AS (SELECT token_id, pow(freq, 0.75::DOUBLE) / (SELECT sum(pow(freq, 0.75::DOUBLE)) FROM freq) AS p FROM freq),
cdf0 AS (SELECT token_id, sum(p) OVER (ORDER BY token_id) AS hi FROM noise),
cdf AS (SELECT token_id, coalesce(lag(hi) OVER (ORDER BY token_id), 0.0) AS lo,
               CASE WHEN token_id = (SELECT max(token_id) FROM noise) THEN 1.0 ELSE hi END AS hi FROM cdf0),
real AS (SELECT * FROM cdf WHERE hi > lo),
draws AS (SELECT seq_id, pos, k::INT AS k, context, {sql_uniform("concat_ws(':', '42n', seq_id, pos, draw, k)")} AS u,
                 {sql_uniform("concat_ws(':', '42m', seq_id, pos, draw, k)")} AS u2 FROM sampled, range(2) t(k))
SELECT seq_id, pos, k, context, CASE WHEN a.token_id = context THEN b.token_id ELSE a.token_id END AS negative
FROM draws JOIN real a ON u >= a.lo AND u < a.hi JOIN real b ON u2 >= b.lo AND u2 < b.hi"""


def token_vectors(spark, d):
    """Trained vectors of the tokens; SQL states the tokens and dimensions, tests hold the values against one process."""
    v = vectors.train(sequences(spark, d), dim=16, width=5, epochs=1, steps=2, per_token=1)
    finite = F.forall("vector", lambda x: ~F.isnan(x) & (F.abs(x) < 1e6))
    return v.select("token_id", F.size("vector").alias("dim"), finite.alias("finite"))


def vector_renormalisation(spark, d):
    e = table(spark, d, "embeddings").withColumn("v", F.transform("embedding", lambda x: x * F.lit(3.0)))
    unit = unrolled(e, ["vec_id"], tokens.renormalised(F.col("v")), "x", "i")
    return unit.select("vec_id", "i", rounded(F.col("x"), 6).alias("x"))


def top_tokens(spark, d):
    return tokens.top_tokens(tokens.frequencies(encoded(spark, d)), 10)


def vector_lookup(spark, d):
    known = table(spark, d, "embeddings").select(F.col("vec_id").cast("int").alias("token_id"), F.col("embedding").alias("vector"))
    t = encoded(spark, d).select("seq_id", "pos", F.when(F.col("pos") % 5 == 4, tokens.PAD).otherwise(F.col("token_id")).alias("token_id"))
    found = tokens.looked_up(t, known, 64)
    weighed = F.aggregate(F.transform("vector", lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return found.select("seq_id", "pos", F.coalesce(F.size("vector"), F.lit(-1)).alias("dim"), rounded(weighed, 5).alias("weighed"))


def rank_frequency(spark, d):
    return tokens.rank_frequency(tokens.frequencies(encoded(spark, d)))


def length_histogram(spark, d):
    lengths = encoded(spark, d).groupBy("seq_id").agg(F.count("*").alias("n_tokens"))
    return tokens.length_histogram(lengths, "n_tokens")


def token_spans(spark, d):
    pieces = symbol_table(spark, d).select(
        F.col("rec_id").alias("seq_id"), F.transform(bpe.tokens_of(F.col("symbols"), list(IDS)), F.length).alias("lengths")
    )
    return tokens.spans(pieces, "lengths")


def tokenizer_artefact(spark, d):
    """The whole vocabulary, 256 bytes and two merges, written and read back."""
    merges = bpe.train(symbol_table(spark, d), "symbols", 2)
    path = scratch_path(spark, "tokenizer")
    tables.write_tokenizer(bpe.byte_vocabulary(spark, merges), merges, path)
    vocab, back = tables.read_tokenizer(spark, path)
    both = vocab.join(back.select("token_id", "rank", "n"), "token_id", "left")
    return both.select("rank", "token_id", F.hex("symbols").alias("symbols"), "n")


PLANS = {
    "tokenizer_artefact": (
        tokenizer_artefact,
        f"""SELECT rank, token_id, hex(symbols) AS symbols, n FROM ({train_sql(2)})
            UNION ALL SELECT NULL, i::INT, CASE WHEN i < 128 THEN printf('%02X', i) ELSE hex('<' || i || '>') END, NULL FROM range(256) t(i)""",
    ),
    "recording_sample_corpus": (
        recording_sample_corpus,
        f"WITH {SYMBOL_SQL} SELECT rec_id, 64::INT AS n, symbols FROM symbols ORDER BY md5('42:' || rec_id) LIMIT 300",
    ),
    "pair_counts": (pair_counts, f'WITH {PAIRS_SQL} SELECT "left", "right", n FROM pairs'),
    "best_pair": (best_pair, f'WITH {PAIRS_SQL} SELECT "left", "right", n FROM pairs ORDER BY n DESC, "left", "right" LIMIT 1'),
    "single_merge": (single_merge, f"WITH {SYMBOL_SQL} SELECT rec_id, replace(symbols, 'mm', 'M') AS merged FROM symbols"),
    "train_merges": (train_merges, train_sql()),
    "encode": (encode, f"WITH {ENCODED_SQL} SELECT seq_id, pos, token_id FROM tokens"),
    "encode_arrays": (encode_arrays, f"WITH {ENCODED_SQL} SELECT seq_id, pos, token_id FROM tokens"),
    "decode": (decode, f"WITH {SYMBOL_SQL} SELECT rec_id AS seq_id, symbols FROM symbols"),
    "compression": (
        compression,
        f"""WITH {ENCODED_SQL} SELECT sum(length(piece))::BIGINT AS original, count(*) AS encoded,
            round(sum(length(piece)) / count(*)::DOUBLE, {R}) + 0.0 AS ratio, {len(IDS)} AS vocab_size FROM tokens""",
    ),
    "token_names": (
        token_names,
        f"WITH {ENCODED_SQL} SELECT 'signal_' || token_id AS name, token_id AS back, count(*) AS n FROM tokens GROUP BY 1, 2",
    ),
    "token_frequencies": (token_frequencies, f"WITH {ENCODED_SQL}, {_FREQ} SELECT token_id::INT AS token_id, freq FROM freq"),
    "min_count_filter": (
        min_count_filter,
        f"WITH {ENCODED_SQL} SELECT token_id, count(*) AS n, count(DISTINCT seq_id) AS sequences FROM tokens GROUP BY 1 HAVING count(*) >= 200",
    ),
    "subsample": (subsample, f"WITH {_SUBSAMPLE}"),
    "noise_distribution": (noise_distribution, f"WITH {_NOISE} SELECT token_id::INT AS token_id, round(p, {R}) + 0.0 AS p FROM noise"),
    "skip_gram_pairs": (
        skip_gram_pairs,
        f"""WITH {ENCODED_SQL} SELECT a.token_id AS center, b.token_id AS context, count(*) AS n FROM tokens a
            JOIN tokens b ON a.seq_id = b.seq_id AND a.pos <> b.pos AND abs(a.pos - b.pos) <= 3 GROUP BY 1, 2""",
    ),
    "sampled_skip_grams": (sampled_skip_grams, f"WITH {_SAMPLED} SELECT seq_id, pos, draw, center, context FROM sampled"),
    "negative_samples": (negative_samples, _NEGATIVE.replace("AS negative", "::INT AS negative").replace("END ::INT", "END::INT")),
    "token_vectors": (token_vectors, f"WITH {ENCODED_SQL} SELECT DISTINCT token_id, 16 AS dim, true AS finite FROM tokens"),
    "vector_renormalisation": (
        vector_renormalisation,
        """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: (x::DOUBLE * 3.0::DOUBLE)) AS v FROM embeddings),
           n AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm FROM e)
           SELECT vec_id, i::INT AS i, round(v[i + 1] / norm, 6) + 0.0 AS x FROM n, range(64) t(i)""",
    ),
    "top_tokens": (
        top_tokens,
        f"WITH {ENCODED_SQL} SELECT token_id, count(*) AS freq FROM tokens GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    ),
    "vector_lookup": (
        vector_lookup,
        f"""WITH {ENCODED_SQL}, e AS (SELECT vec_id, list_sum(list_transform(embedding, lambda x, i: x::DOUBLE * i)) AS w, len(embedding) AS dim FROM embeddings)
            SELECT seq_id, pos, CASE WHEN pos % 5 = 4 THEN 64 ELSE coalesce(dim, -1) END::INT AS dim,
                   round(CASE WHEN pos % 5 = 4 THEN 0.0::DOUBLE ELSE w END, 5) + 0.0 AS weighed FROM tokens LEFT JOIN e ON vec_id = token_id""",
    ),
    "rank_frequency": (
        rank_frequency,
        f"""WITH {ENCODED_SQL}, c AS (SELECT token_id, count(*) AS freq FROM tokens GROUP BY 1)
            SELECT row_number() OVER (ORDER BY freq DESC, token_id)::INT AS rank, token_id, freq FROM c""",
    ),
    "length_histogram": (
        length_histogram,
        f"""WITH {ENCODED_SQL}, {_LENGTHS}, span AS (SELECT min(n)::DOUBLE AS lo, max(n)::DOUBLE AS hi FROM lens)
            SELECT least(floor((n - lo) / ((hi - lo) / 30)), 29)::INT AS bin, count(*) AS n FROM lens, span GROUP BY 1""",
    ),
    "token_spans": (
        token_spans,
        f"""WITH {ENCODED_SQL}, s AS (SELECT seq_id, pos, length(piece) AS len,
                sum(length(piece)) OVER (PARTITION BY seq_id ORDER BY pos) AS stop FROM tokens)
            SELECT seq_id, pos, (stop - len)::BIGINT AS start, stop::BIGINT AS stop FROM s""",
    ),
}
