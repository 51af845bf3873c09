"""Byte-pair vocabulary over symbol strings, greedy encoding, decoding.

The corpus stays a table with one recording per row. While training, a token is
one character (code point ``BASE + id``), so a merge is a string replacement
inside the JVM: left to right and non-overlapping, as byte-pair merging needs.
"""
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigspark.functions.arrays import unrolled
from sigspark.functions.session import cut_lineage, sized

BYTES = 256
BASE = 0x1000  # first code point used for tokens while training
SURROGATES, N_SURROGATES = 0xD800, 0x800  # code points that no text can hold
MAX_TOKENS = 0x110000 - BASE - N_SURROGATES
MERGES_PER_PASS = 64
PASSES_PER_CHECKPOINT = 8


def _character(token_id: int) -> str:
    code = BASE + token_id
    return chr(code + N_SURROGATES if code >= SURROGATES else code)


def _number(character: str) -> int:
    code = ord(character)
    return code - BASE - (N_SURROGATES if code >= SURROGATES else 0)


def adjacent(text: Column) -> Column:
    """All overlapping windows of two symbols."""
    chars = F.split(text, "")
    moved = F.slice(chars, 2, F.greatest(F.size(chars) - 1, F.lit(0)))
    head = F.slice(chars, 1, F.greatest(F.size(chars) - 1, F.lit(0)))
    return F.zip_with(head, moved, lambda a, b: F.concat(a, b))


def pair_counts(df: DataFrame, text: str) -> DataFrame:
    """Counts of adjacent symbols; pairs never cross recordings."""
    counted = unrolled(df, [], adjacent(F.col(text)), "pair").groupBy("pair").agg(F.count("*").alias("n"))
    return counted.select(F.substring("pair", 1, 1).alias("left"), F.substring("pair", 2, 1).alias("right"), "n")


def top_pairs(counts: DataFrame, k: int) -> DataFrame:
    """Most frequent pairs; equal counts go to the smaller (left, right)."""
    return counts.orderBy(F.desc("n"), "left", "right").limit(k)


def merged(text: Column, left: str, right: str, new: str) -> Column:
    return F.replace(text, F.lit(left + right), F.lit(new))


def _independent(best: list, limit: int) -> list:
    """Longest run of best pairs that one pass may merge with the result of single merges.

    Merging (a, b) takes away from a pair only where the two can overlap, that is
    from pairs that end in a or begin with b. A pair with the new token is
    never more frequent than such a pair was, and on equal counts its higher id
    puts it behind. So the next best pairs stay the next best until the first one
    that could overlap an earlier one. A pair of equal symbols overlaps itself
    and ends the run.
    """
    run, lefts, rights = [], set(), set()
    for row in best[:limit]:
        if row["right"] in lefts or row["left"] in rights:
            break
        run.append(row)
        if row["left"] == row["right"]:
            break
        lefts.add(row["left"])
        rights.add(row["right"])
    return run


def train(df: DataFrame, text: str, merges: int, alphabet: str = "abcdefghijklmnopqrstuvwxyz") -> DataFrame:
    """Learn ``merges`` merges: (rank, left_id, right_id, token_id, n, symbols).

    Each pass counts pairs with one partial and one final aggregation; only the
    best few pairs reach the driver. Ends early when no pair is left.
    """
    spark = df.sparkSession
    if BYTES + merges > MAX_TOKENS:
        raise ValueError(f"at most {MAX_TOKENS - BYTES} merges")
    token = {_character(i): chr(i) for i in range(BYTES)}
    coded = "".join(_character(ord(c)) for c in alphabet)
    corpus = cut_lineage(df.select(F.translate(text, alphabet, coded).alias("_s")))
    learned: list = []
    passes = 0
    while len(learned) < merges:
        best = top_pairs(pair_counts(corpus, "_s"), MERGES_PER_PASS).collect()
        run = _independent(best, merges - len(learned))
        if not run:
            break
        symbols = F.col("_s")
        for row in run:
            new = _character(BYTES + len(learned))
            token[new] = token[row["left"]] + token[row["right"]]
            symbols = merged(symbols, row["left"], row["right"], new)
            ids = [_number(row["left"]), _number(row["right"]), _number(new)]
            learned.append((len(learned) + 1, *ids, row["n"], token[new]))
        corpus = corpus.select(symbols.alias("_s"))
        passes += 1
        if passes % PASSES_PER_CHECKPOINT == 0:
            corpus = cut_lineage(corpus)
    schema = "rank int, left_id int, right_id int, token_id int, n bigint, symbols string"
    return spark.createDataFrame(learned, schema)


def vocabulary(spark: SparkSession, merges: DataFrame, alphabet: str = "abcdefghijklmnopqrstuvwxyz") -> DataFrame:
    """(token_id, symbols): the single bytes of the alphabet and all merges."""
    singles = spark.createDataFrame([(ord(c), c) for c in alphabet], "token_id int, symbols string")
    return singles.unionByName(merges.select("token_id", "symbols"))


def byte_vocabulary(spark: SparkSession, merges: DataFrame) -> DataFrame:
    """(token_id, symbols) with all 256 bytes; bytes above 127 are written ``<n>``."""
    byte = F.when(F.col("id") < 128, F.char(F.col("id"))).otherwise(F.concat(F.lit("<"), F.col("id"), F.lit(">")))
    singles = spark.range(BYTES).select(F.col("id").cast("int").alias("token_id"), byte.alias("symbols"))
    return singles.unionByName(merges.select("token_id", "symbols"))


class LongestMatch:
    """Flat table (node, symbol) -> node of the tokens' common prefixes.

    A position is tested in as many steps as the match is long, whatever the
    size of the vocabulary and the length of its tokens. A symbol outside the
    vocabulary matches alone.
    """

    def __init__(self, tokens: list[str]):
        self.step: dict[tuple[int, str], int] = {}
        self.ends: set[int] = set()
        for token in tokens:
            node = 0
            for c in token:
                node = self.step.setdefault((node, c), len(self.step) + 1)
            if node:
                self.ends.add(node)

    def split(self, text: str) -> list[str]:
        out, i, step, ends = [], 0, self.step, self.ends
        while i < len(text):
            node, j, end = step.get((0, text[i])), i + 1, i + 1
            while node is not None:
                if node in ends:
                    end = j
                if j == len(text):
                    break
                node, j = step.get((node, text[j])), j + 1
            out.append(text[i:end])
            i = end
        return out


def tokens_of(text: Column, vocab_symbols: list[str]) -> Column:
    """Greedy longest-match tokens as strings."""
    table = LongestMatch(vocab_symbols)

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else table.split(t))

    return cut(text)


def encode(df: DataFrame, text: str, vocab: DataFrame, keep: list[str]) -> DataFrame:
    """Long form: (keep…, pos, token_id, symbols). A vocabulary has at most MAX_TOKENS rows, which is checked."""
    known = vocab.limit(MAX_TOKENS + 1).collect()
    if len(known) > MAX_TOKENS:
        raise ValueError(f"a vocabulary has at most {MAX_TOKENS} tokens")
    pieces = unrolled(df, keep, tokens_of(F.col(text), [r["symbols"] for r in known]), "symbols", "pos")
    named = F.broadcast(vocab.select("token_id", F.col("symbols").alias("_v")))
    joined = pieces.join(named, pieces["symbols"] == named["_v"], "left")
    unknown = F.coalesce("token_id", F.ascii("symbols"))
    return joined.select(*keep, "pos", unknown.alias("token_id"), "symbols")


def encoded(text: Column, vocab: dict[str, int]) -> Column:
    """Array form: token ids of one recording, for row-wise use; one dictionary look-up per token."""
    table = LongestMatch(list(vocab))

    @F.pandas_udf("array<int>")
    def look_up(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else [vocab.get(p, ord(p[0])) for p in table.split(t)])

    return look_up(text)


def decode(tokens: DataFrame, vocab: DataFrame, keep: list[str]) -> DataFrame:
    """Symbol string of each sequence from (keep…, pos, token_id)."""
    named = tokens.join(sized(vocab.select("token_id", F.col("symbols").alias("_v")), "names"), "token_id")
    ordered = F.array_sort(F.collect_list(F.struct("pos", "_v")))
    return named.groupBy(*keep).agg(F.array_join(F.transform(ordered, lambda x: x["_v"]), "").alias("symbols"))
