"""Ranked lexical search in an index stratified by length.

The score of a document depends on its length only through a whole number, the
normaliser ``m``. Documents of equal ``m`` form a stratum; its postings are kept
by term and, within a term, by occurrences ``tf``. So what one occurrence count
of a term is worth is worked out once for a stratum and not once for a document,
and the highest ``tf`` of each term bounds the score of all documents of the
stratum. Strata are visited from the highest bound on, in waves that double,
until the bound falls below the lowest score that still counts.
"""
from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigspark.functions.session import sized
from sigspark.llm.common import as_bytes, stored

#: Terms in UTF-8, after A-Z are lower-cased: digits, letters, and all that is not ASCII.
TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
#: A part of a stratum ends with the document that reaches so many postings; a larger stratum has several parts.
PART_POSTINGS = 300_000
#: Items are searched in blocks of so many bytes of distinct terms; a block is broadcast.
BLOCK_BYTES = 4_000_000
#: Strata times terms of the items, at most, in a table of bounds.
CELLS = 2_000_000
#: Postings of strata that are visited together, at most, unless one stratum has more.
POSTINGS_AT_ONCE = 1_500_000
#: Items whose bounds are worked out together.
ITEMS_AT_ONCE = 256
BEST = 10
#: Stands for a null doc_id in the index.
UNNUMBERED = -(1 << 63)

STRATA = (
    "m long, docs array<long>, terms array<binary>, groups array<int>, dfs array<int>, tfs array<int>, sizes array<int>, postings array<int>"
)
_STRATA = pa.schema(
    [("m", pa.int64()), ("docs", pa.list_(pa.int64())), ("terms", pa.list_(pa.binary()))]
    + [(c, pa.list_(pa.int32())) for c in ("groups", "dfs", "tfs", "sizes", "postings")]
)


class Index(NamedTuple):
    strata: DataFrame  # columns of STRATA
    documents: int  # N, documents with a term
    occurrences: int  # L, all terms with repeats


def _slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for s in range(0, batch.num_rows, rows):
            yield batch.slice(s, rows)


def forward(docs: DataFrame) -> DataFrame:
    """(doc_id, n, k, terms, tfs): terms of every whole text, k of them, once each with blanks between, and their occurrences.

    Texts without a term, null and empty ones among them, have no row.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("k", pa.int64()), ("terms", pa.binary()), ("tfs", pa.binary())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in _slices(batches, 1024):
            rows = []
            for doc_id, text in zip(some.column("doc_id").to_pylist(), as_bytes(some, "text")):
                counts = Counter(TERM.findall(text.lower()))
                if counts:
                    tfs = np.fromiter(counts.values(), np.int32, len(counts))
                    rows.append((doc_id, int(tfs.sum(dtype=np.int64)), len(tfs), b" ".join(counts), tfs.tobytes()))
            yield pa.record_batch([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(work, "doc_id long, n long, k long, terms binary, tfs binary")


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places start, start + 1, … of each range, one range after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def _lists(values: pa.Array, counts: np.ndarray) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), values)


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where a new combination of the keys begins; the rows are sorted by them."""
    n = len(keys[0])
    new = np.ones(n, bool)
    if n:
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


def _strata(rows: list[tuple]) -> pa.RecordBatch:
    """One row of STRATA for each normaliser in (m, doc_id, terms, tfs), sorted by m."""
    m = np.array([r[0] for r in rows], np.int64)
    tf = np.concatenate([np.frombuffer(r[3], np.int32) for r in rows])
    coded = pa.array(b" ".join([r[2] for r in rows]).split(b" "), pa.binary()).dictionary_encode()
    code = coded.indices.to_numpy()
    first_doc = _starts(m)
    of_doc = np.repeat(np.arange(len(first_doc)), np.diff(np.append(first_doc, len(m))))  # stratum of each document
    doc = np.repeat(np.arange(len(rows)), [len(r[3]) // 4 for r in rows])
    order = np.lexsort((tf, code, of_doc[doc]))  # stable: documents stay in order
    tf, code, doc = tf[order], code[order], doc[order]
    stratum = of_doc[doc]
    group, entry = _starts(stratum, code, tf), _starts(stratum, code)
    sizes = np.diff(np.append(group, len(tf)))
    groups = np.diff(np.append(np.searchsorted(group, entry), len(group)))
    dfs = np.diff(np.append(entry, len(tf)))
    count = lambda of: np.bincount(of, minlength=len(first_doc))
    i32 = lambda x: pa.array(x.astype(np.int32))
    n_entries, n_groups = count(stratum[entry]), count(stratum[group])
    return pa.record_batch(
        [
            pa.array(m[first_doc]), _lists(pa.array([r[1] for r in rows], pa.int64()), count(of_doc)),
            _lists(coded.dictionary.take(pa.array(code[entry])), n_entries), _lists(i32(groups), n_entries), _lists(i32(dfs), n_entries),
            _lists(i32(tf[group]), n_groups), _lists(i32(sizes), n_groups), _lists(i32(doc - first_doc[stratum]), count(stratum)),
        ],
        schema=_STRATA,
    )


def build(docs: DataFrame) -> Index:
    """The index of all documents; needs ``doc_id`` and ``text``, other columns are not read.

    Documents are dealt out by their normaliser, and by a hash inside one that has
    more postings than a part should hold: a stratum with a third of all documents
    spreads over tasks. A task writes parts of strata of bounded size. Repeated rows are documents of
    their own. A document is counted by its terms; those without one are absent.
    """
    ahead = stored(forward(docs), "forward")
    n, total = ahead.agg(F.count(F.lit(1)), F.sum("n")).first()
    m = F.expr(f"10L + (90L * n * {n}L) div {total or 1}L")
    parts = ahead.groupBy(m.alias("m")).agg(F.ceil(F.sum("k") / PART_POSTINGS).alias("parts"))
    doc_id = F.coalesce("doc_id", F.lit(UNNUMBERED))
    # One row for each normaliser: its size is known once it is written, and a small table is broadcast.
    rows = ahead.select(m.alias("m"), doc_id.alias("doc_id"), "terms", "tfs").join(sized(parts, "parts"), "m")
    rows = rows.withColumn("part", F.pmod(F.xxhash64("doc_id", "tfs"), F.col("parts")))
    laid = rows.repartition("m", "part").sortWithinPartitions("m", "part").select("m", "doc_id", "terms", "tfs")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, postings = [], 0
        for some in _slices(batches, 64):
            for row in zip(*(some.column(c).to_pylist() for c in ("m", "doc_id", "terms", "tfs"))):
                rows.append(row)
                postings += len(row[3]) // 4
                if postings >= PART_POSTINGS:
                    yield _strata(rows)
                    rows, postings = [], 0
        if rows:
            yield _strata(rows)

    return Index(stored(laid.mapInArrow(work, STRATA), "strata"), n, total or 0)


class Block(NamedTuple):
    """Some items: what a task needs to search for them."""

    items: list  # item_id of each
    words: list[bytes]  # distinct terms
    weights: np.ndarray  # of each term
    terms: list[np.ndarray]  # of each item, places in words


def _blocks(items: DataFrame) -> Iterator[tuple[list, list[bytes], list[np.ndarray]]]:
    """Items read one after the other, in blocks of bounded size."""
    names, terms, place = [], [], {}
    size = 0
    for row in forward(items.select(F.col("item_id").alias("doc_id"), "text").distinct()).select("doc_id", "terms").toLocalIterator():
        own = bytes(row["terms"]).split(b" ")
        size += sum(len(t) + 8 for t in own)
        names.append(row["doc_id"])
        terms.append(np.array([place.setdefault(t, len(place)) for t in own]))
        if size >= BLOCK_BYTES:
            yield names, list(place), terms
            names, terms, place, size = [], [], {}, 0
    if names:
        yield names, list(place), terms


def _frequencies(index: Index, words: list[bytes]) -> np.ndarray:
    """Documents that hold each of the words; one row for a word and task is shuffled."""
    shared = index.strata.sparkSession.sparkContext.broadcast(words)  # bounded by BLOCK_BYTES
    schema = pa.schema([("word", pa.int32()), ("df", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, found = pa.array(shared.value, pa.binary()), np.zeros(len(shared.value), np.int64)
        for batch in batches:
            at = pc.index_in(batch.column("terms").flatten(), value_set=known)
            hit = at.is_valid().to_numpy(zero_copy_only=False)
            np.add.at(found, at.drop_null().to_numpy(), batch.column("dfs").flatten().to_numpy()[hit])
        some = np.flatnonzero(found)
        yield pa.record_batch([pa.array(some.astype(np.int32)), pa.array(found[some])], schema=schema)

    rows = index.strata.select("terms", "dfs").mapInArrow(work, "word int, df long").groupBy("word").agg(F.sum("df").alias("df"))
    out = np.zeros(len(words), np.int64)
    for word, df in rows.collect():  # at most one for each word of the block
        out[word] = df
    return out


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    tf = tf.astype(np.int64)
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


class _Search:
    """The best of each item among the strata that a task has seen."""

    def __init__(self, block: Block, best: int):
        self.block, self.best = block, best
        self.known = pa.array(block.words, pa.binary())
        empty = np.zeros(0, np.int64)
        self.score, self.doc = [empty] * len(block.items), [empty] * len(block.items)

    def see(self, batch: pa.RecordBatch) -> None:
        flat = {f.name: batch.column(f.name).flatten().to_numpy(zero_copy_only=False) for f in _STRATA if f.name not in ("m", "terms")}
        first = {c: np.concatenate([[0], np.cumsum(batch.column(c).value_lengths().to_numpy())]) for c in ("docs", "terms", "tfs", "postings")}
        m = batch.column("m").to_numpy()
        at = pc.index_in(batch.column("terms").flatten(), value_set=self.known).fill_null(-1).to_numpy()
        entry = np.flatnonzero(at >= 0)  # only terms of the items from here on
        word, stratum = at[entry], np.searchsorted(first["terms"], entry, side="right") - 1
        group_end = np.cumsum(flat["groups"])
        group, n_groups = (group_end - flat["groups"])[entry], flat["groups"][entry]
        posting = np.cumsum(flat["sizes"]) - flat["sizes"]  # all postings stand in one row, stratum by stratum
        flat["postings"] = flat["postings"] + np.repeat(first["docs"][:-1].astype(np.int32), np.diff(first["postings"]))
        # Once for each term, stratum and number of occurrences, whatever the documents.
        value = impact(flat["tfs"], np.repeat(m, np.diff(first["tfs"])))
        # Occurrences of a term ascend, so its last group has the highest impact.
        top = self.block.weights[word] * value[group + n_groups - 1]
        bounds = np.zeros((len(m), len(self.block.words)))
        bounds[stratum, word] = top
        place = np.full((len(m), len(self.block.words)), -1, np.int32)
        place[stratum, word] = np.arange(len(entry))
        for s in range(0, len(self.block.items), ITEMS_AT_ONCE):
            items = range(s, min(s + ITEMS_AT_ONCE, len(self.block.items)))
            holds = np.zeros((len(self.block.words), len(items)))
            for k, i in enumerate(items):
                holds[self.block.terms[i], k] = 1
            bound = bounds @ holds  # whole numbers below 2 ** 53: exact
            for k, i in enumerate(items):
                order, done, wave = np.argsort(-bound[:, k], kind="stable"), 0, 1
                while done < len(order):
                    least = self.score[i][-1] if len(self.score[i]) == self.best else 1
                    now = order[done : done + wave]
                    now = now[bound[now, k] >= least]
                    if not len(now):
                        break
                    done, wave = done + wave, 2 * wave
                    mine = place[now][:, self.block.terms[i]].ravel()
                    mine = mine[mine >= 0]
                    groups = _ragged(group[mine], n_groups[mine])
                    worth = np.repeat(self.block.weights[word[mine]], n_groups[mine]) * value[groups]
                    sizes = flat["sizes"][groups]
                    docs = flat["postings"][_ragged(posting[groups], sizes)]
                    total = np.bincount(docs, np.repeat(worth, sizes), len(flat["docs"])).astype(np.int64)
                    self.keep(i, total, flat["docs"], least)

    def keep(self, i: int, score: np.ndarray, doc: np.ndarray, least: int) -> None:
        some = np.flatnonzero(score >= least)
        score, doc = np.append(self.score[i], score[some]), np.append(self.doc[i], doc[some])
        first = np.lexsort((doc, -score))[: self.best]
        self.score[i], self.doc[i] = score[first], doc[first]


def _found(index: Index, block: Block, best: int) -> DataFrame:
    shared = index.strata.sparkSession.sparkContext.broadcast(block)  # bounded by BLOCK_BYTES
    schema = pa.schema([("item_id", pa.int64()), ("nth", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = _Search(shared.value, best)
        most = max(1, CELLS // len(shared.value.words))
        for batch in batches:
            held = np.cumsum(batch.column("postings").value_lengths().to_numpy())
            s = 0
            while s < batch.num_rows:  # as many strata as have bounded tables, one at least
                rows = int(np.searchsorted(held, (held[s - 1] if s else 0) + POSTINGS_AT_ONCE, side="right")) - s
                rows = min(max(rows, 1), most)
                search.see(batch.slice(s, rows))
                s += rows
        n = [len(x) for x in search.score]
        nth = np.repeat(np.arange(len(n)), n)
        ids = pa.array(shared.value.items, pa.int64()).take(pa.array(nth))
        columns = [ids, nth.astype(np.int32), np.concatenate(search.doc), np.concatenate(search.score)]
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return index.strata.mapInArrow(work, "item_id long, nth int, doc_id long, score long")


def search(index: Index, items: DataFrame, best: int = BEST) -> DataFrame:
    """(item_id, rank, doc_id, score): the highest documents of each item with a score above 0, ties by ascending doc_id.

    Needs ``item_id`` and ``text``; rows equal in both are one item, rows of one
    item_id with other texts are searched each. Items without a term that some
    document has give no row. A null doc_id comes first among ties.

    Every task keeps the best of each item; only these are shuffled.
    """
    spark = index.strata.sparkSession
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for names, words, terms in _blocks(items):
        df = _frequencies(index, words)
        weights = np.array([math.floor(1000 * math.log((2 * index.documents + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
        found = _found(index, Block(names, words, weights, terms), best)
        by = Window.partitionBy("nth").orderBy(F.desc("score"), "doc_id")
        found = found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= best)
        out = out.union(found.select("item_id", "rank", F.nullif("doc_id", F.lit(UNNUMBERED)).alias("doc_id"), "score"))
    return out


SQL = r"""
WITH words AS (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM documents
), counts AS (
    SELECT doc_id, term, count(*) AS tf FROM words GROUP BY doc_id, term
), lengths AS (
    SELECT doc_id, sum(tf)::BIGINT AS n FROM counts GROUP BY doc_id
), totals AS (
    SELECT count(*) AS docs, sum(n)::BIGINT AS occurrences FROM lengths
), rarity AS (
    SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM counts, totals GROUP BY term, docs
), wanted AS (
    SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                       '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark
), scores AS (
    SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * docs) // occurrences)))))::BIGINT AS score
    FROM wanted JOIN counts USING (term) JOIN rarity USING (term) JOIN lengths USING (doc_id), totals
    GROUP BY item_id, doc_id
), ordered AS (
    SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM scores WHERE score > 0
)
SELECT * FROM ordered WHERE rank <= 10
"""
