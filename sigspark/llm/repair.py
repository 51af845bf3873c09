"""Files of token ids, compressed by a grammar of pairs (Re-Pair).

Documents stand in the order of their ids, cut into shards of bounded size. In
a shard, frequent pairs of neighbours are replaced by new symbols again and
again. The file holds the rules, how many ids each expands to, and what is left
of every document, so one document, or a part of one, is read without the others.
"""
from __future__ import annotations

import functools
import re
import struct
import unicodedata
import zlib
from array import array
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sigspark.llm import bpe
from sigspark.llm.common import as_bytes
from sigspark.functions.session import scratch_path

#: A shard ends with the document that reaches so many ids.
SHARD_IDS = 1_000_000
#: A pair is replaced if it occurs so often: a rule takes the room of three symbols.
LEAST = 4
#: A round replaces pairs down to one so manieth of the limit of the round before, from the most frequent pair on.
SHARE = 64
#: At the lowest limit a round must shorten the shard by one so manieth.
PAYS = 64
#: Counters of pairs by hash.
SLOTS = 1 << 20
#: Documents and bytes of text that are encoded together; one longer text is alone.
ROWS, BYTES = 1024, 4 << 20
#: Documents that are handed on together.
HANDED = 256
#: Distinct words of a generation that a worker remembers.
REMEMBERED = 300_000
#: Ends every document.
END = 1
#: Requests that go to a shard together.
REQUESTS = 256

MARK = b"RPG1"
SHARDS = "part int, shard int, before long, n_ids long, docs array<long>, data binary"
_SHARDS = pa.schema(
    [("part", pa.int32()), ("shard", pa.int32()), ("before", pa.int64()), ("n_ids", pa.int64()), ("docs", pa.list_(pa.int64())), ("data", pa.binary())]
)


#: Kinds of bytes: white space, letters, and marks. The vocabulary splits a word between a letter and a mark behind it, so the two are encoded by themselves.
BLANK, LETTER, MARKS = 1, 2, 3
KIND = bytes(
    BLANK if c in b" \t\n\r\x0b\x0c" else LETTER if 97 <= c <= 122 else MARKS if 33 <= c <= 47 or 58 <= c <= 64 or 91 <= c <= 96 or 123 <= c <= 126 else 0
    for c in range(256)
)
#: Small letters that every version of Unicode has as such, that no normal form changes and that join to no neighbour: Latin, Greek, Cyrillic, Hebrew, kana, Han.
SMALL = re.compile(
    "[a-z" + "".join(
        chr(c) for a, b in ((0xDF, 0x17F), (0x3B1, 0x3C9), (0x430, 0x45F), (0x5D0, 0x5EA), (0x3041, 0x3094), (0x30A1, 0x30FA), (0x4E00, 0x9FA5)) for c in range(a, b + 1)
        if chr(c).isalpha() and chr(c).lower() == chr(c) == unicodedata.normalize("NFC", chr(c))
    ) + "]+"
).fullmatch


class Encoder:
    """Tokens of whole texts, word by word; words met before are looked up.

    Words are folded to fewer ones where that changes no token: the vocabulary
    lower-cases anyway, and a mark behind a letter begins a new piece. Texts that
    may hold a special token or a combining mark are left as they are. New words of
    letters alone go to the tokenizer many in one text: each is at least one piece,
    and the last token of a piece alone has the mark of an end. Words of small
    letters are as the tokenizer's normalizer leaves them and one piece each, so
    they go to its model at once.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.codec = bpe.codec(path)
        vocabulary = self.codec.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.letters, self.model = (Tokenizer(self.codec.tokenizer.model) for _ in range(2))  # the same model, not a copy
        blanks = pre_tokenizers.WhitespaceSplit()
        self.letters.pre_tokenizer = blanks  # a letter from a to z stands for its byte
        self.model.pre_tokenizer = pre_tokenizers.Sequence([blanks, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}  # the generation before: a word in use moves up

    @staticmethod
    def words(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
        """Words of all texts in a row, and how many each text has."""
        odd = [b"<|" in t or b"\xcc" in t or b"\xcd" in t for t in texts]
        line = b" ".join([*(t if o else t.lower() for t, o in zip(texts, odd)), b""])
        stops = np.cumsum([len(t) + 1 for t in texts])
        kind = np.frombuffer(line.translate(KIND), np.uint8)
        blank = kind == BLANK
        new = np.empty(len(kind), bool)
        new[:1] = True
        np.logical_or(blank[:-1], (kind[:-1] == LETTER) & (kind[1:] == MARKS), out=new[1:])
        for k in np.flatnonzero(odd).tolist():
            a, b = int(stops[k]) - len(texts[k]) - 1, int(stops[k])
            new[a + 1 : b] = blank[a : b - 1]
        new &= ~blank
        counts = np.diff(np.searchsorted(np.flatnonzero(new), stops), prepend=0)
        # Without the white space, each word ends where the next one begins.
        data = np.frombuffer(line, np.uint8)[~blank]
        offsets = np.append(np.flatnonzero(new[~blank]), len(data))
        return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)]), counts

    def pieces(self, words: list[bytes], by) -> dict[bytes, bytes]:
        """Ids of words of letters, from one text of them all; none if some word is more than one piece."""
        ids = np.array(by.encode_batch_fast([b" ".join(words).decode()], add_special_tokens=False)[0].ids, "<i4")
        ends = ((np.flatnonzero(self.last[ids]) + 1) * 4).tolist()
        if len(ends) != len(words):
            return {}
        data = ids.tobytes()
        return {w: data[a:b] for w, a, b in zip(words, [0, *ends], ends)}

    def learn(self, new: list[bytes]) -> None:
        """Adds words to those known."""
        known, english, small, plain, short = self.known, [], [], [], []
        for w in new:
            if len(w) > bpe.UNSPLIT:
                known[w] = array("i", self.codec.long_word(w.decode())).tobytes()
            elif w.isalpha() and w.islower():  # of bytes: a-z only
                english.append(w)
            else:
                text = w.decode()
                (small if SMALL(text) else plain if text.isalpha() else short).append(w)
        for some, by in ((english, self.letters), (small, self.model), (plain, self.codec.tokenizer)):
            for s in range(0, len(some), 1024):
                got = self.pieces(some[s : s + 1024], by)
                known.update(got)
                if not got:
                    short += some[s : s + 1024]
        for s in range(0, len(short), 4096):
            some = short[s : s + 4096]
            for w, e in zip(some, self.codec.tokenizer.encode_batch_fast([w.decode() for w in some], add_special_tokens=False)):
                known[w] = array("i", e.ids).tobytes()

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text as bytes of 32-bit numbers."""
        words, counts = self.words(texts)
        if not len(words):
            return [b""] * len(texts)
        coded = words.dictionary_encode()
        if len(self.known) > REMEMBERED:
            self.known, self.older = {}, self.known
        known, older, new = self.known, self.older, []
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = list(map(known.get, distinct))
        missing = [k for k, x in enumerate(found) if x is None]
        for k in missing:
            w = distinct[k]
            if w in older:
                known[w] = older[w]
            else:
                new.append(w)
        self.learn(new)
        for k in missing:
            found[k] = known[distinct[k]]
        ids = pa.array(found, pa.large_binary()).take(coded.indices)
        ends = np.frombuffer(ids.buffers()[1], np.int64)[np.append(0, np.cumsum(counts))].tolist()
        data = memoryview(ids.buffers()[2])
        for w in new:
            if len(w) > bpe.UNSPLIT:
                del known[w]
        return [bytes(data[a:b]) for a, b in zip(ends, ends[1:])]


@functools.lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    return Encoder(path)


class Grammar(NamedTuple):
    base: int  # first symbol that is a rule
    rounds: np.ndarray  # rules of each round; a rule refers to ids and to rules of earlier rounds
    left: np.ndarray
    right: np.ndarray
    lengths: np.ndarray  # ids that each rule expands to
    counts: np.ndarray  # symbols of each document
    symbols: np.ndarray  # of all documents in a row


def by_pair(place: np.ndarray, a: np.ndarray, b: np.ndarray, symbols: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and their pairs, by pair and then by place. Where both fit into one number, numbers are sorted instead of places."""
    wide, low = symbols.bit_length(), n.bit_length()
    if 2 * wide + low > 63:
        pair = a << 32 | b
        order = np.argsort(pair, kind="stable")
        return place[order], pair[order]
    key = np.sort((a << wide | b) << low | place)
    return key & (1 << low) - 1, key >> low


def compressed(ids: np.ndarray, counts: np.ndarray) -> Grammar:
    """The grammar of documents of ``counts`` ids each; pairs do not cross documents.

    A round counts all pairs, ranks those that are frequent by their number, and
    replaces an occurrence unless one that overlaps it ranks higher; in a run of
    one symbol every second place counts. What was in the way is counted again
    in the next round. It ends when the pairs that are left do not pay.
    """
    seq = ids.astype(np.uint32)
    base = int(seq.max()) + 1 if len(seq) else 0
    owner = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
    rounds, left, right, lengths = [], [], [], [np.ones(base, np.int64)]
    total, limit = base, len(seq)
    while len(seq) > 1:
        place = np.flatnonzero(owner[1:] == owner[:-1])
        a, b = seq[place], seq[place + 1]
        # Counts by a hash of the pair are too high at most: few places are left to be sorted by pair.
        slot = (a * np.uint32(0x9E3779B1) + b * np.uint32(0x85EBCA6B) >> np.uint32(7)) & np.uint32(SLOTS - 1)
        rough = np.bincount(slot, minlength=SLOTS)
        limit = max(LEAST, min(limit, int(rough.max(initial=0))) // SHARE)
        some = np.flatnonzero((rough >= limit)[slot])
        place, pair = by_pair(place[some], a[some].astype(np.int64), b[some].astype(np.int64), total, len(seq))
        first = np.flatnonzero(np.append(True, pair[1:] != pair[:-1])) if len(pair) else np.zeros(0, np.int64)
        times = np.diff(np.append(first, len(pair)))
        frequent = np.flatnonzero(times >= limit)
        rank = np.full(len(times), len(times), np.int32)
        rank[frequent[np.argsort(-times[frequent], kind="stable")]] = np.arange(len(frequent))
        at = np.full(len(seq) + 1, len(times), np.int32)  # rank of the pair that begins at a place
        at[place] = np.repeat(rank, times)
        here, before = at[1:-1], at[:-2]
        run = np.flatnonzero((here == before) & (here < len(times))) + 1
        if len(run):
            start = np.maximum.accumulate(np.where(np.append(True, run[1:] != run[:-1] + 1), run, 0))
            at[run[(run - start) % 2 == 0]] = len(times)
        taken = (at[:-1] < len(times)) & (at[:-1] < at[1:])
        taken[1:] &= at[1:-1] < at[:-2]
        spot = np.flatnonzero(taken)
        often = np.bincount(at[spot], minlength=len(frequent))
        kept = np.flatnonzero(often >= LEAST - 1)
        if not often[kept].sum() * PAYS > len(seq):
            if limit == LEAST:
                break
            continue
        name = np.full(len(often), -1)
        name[kept] = total + np.arange(len(kept))
        spot = spot[name[at[spot]] >= 0]
        new = name[at[spot]]
        a, b = np.zeros(len(kept), np.int64), np.zeros(len(kept), np.int64)
        a[new - total], b[new - total] = seq[spot], seq[spot + 1]
        known = np.concatenate(lengths)
        rounds.append(len(kept))
        left.append(a)
        right.append(b)
        lengths.append(known[a] + known[b])
        total += len(kept)
        seq[spot] = new
        stays = np.ones(len(seq), bool)
        stays[spot + 1] = False
        seq, owner = seq[stays], owner[stays]
    none = np.zeros(0, np.int64)
    return Grammar(
        base, np.array(rounds, np.int64), np.concatenate([none, *left]), np.concatenate([none, *right]),
        np.concatenate([none, *lengths[1:]]), np.bincount(owner, minlength=len(counts)), seq.astype(np.int64),
    )


def packed(g: Grammar) -> bytes:
    """A file: mark, sizes, then arrays of 32-bit numbers; symbols as planes of bytes, lowest first."""
    width = max(1, (int(g.symbols.max(initial=0)).bit_length() + 7) // 8)
    planes = g.symbols.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :width].T
    head = struct.pack("<6I", g.base, len(g.rounds), len(g.left), len(g.counts), len(g.symbols), width)
    return b"".join([MARK, head, *(x.astype("<u4").tobytes() for x in g[1:6]), planes.tobytes()])


def unpacked(data: bytes) -> Grammar:
    if data[:4] != MARK:
        raise ValueError("not a file of token ids")
    base, n_rounds, n_rules, n_docs, n_symbols, width = struct.unpack_from("<6I", data, 4)
    at, out = 28, []
    for n in (n_rounds, n_rules, n_rules, n_rules, n_docs):
        out.append(np.frombuffer(data, "<u4", n, at).astype(np.int64))
        at += 4 * n
    symbols = np.zeros((n_symbols, 4), np.uint8)
    symbols[:, :width] = np.frombuffer(data, np.uint8, n_symbols * width, at).reshape(width, n_symbols).T
    return Grammar(base, *out, symbols.view("<u4").ravel().astype(np.int64))


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places start, start + 1, … of each range, one range after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def expanded(g: Grammar) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a shard, and how many each document has. Rules are written out round by round, each from two earlier ones."""
    flat, size = np.arange(g.base), np.concatenate([np.ones(g.base, np.int64), g.lengths])
    start = np.concatenate([np.arange(g.base), g.base + np.cumsum(g.lengths) - g.lengths])
    done = 0
    for n in g.rounds.tolist():
        sides = np.stack([g.left[done : done + n], g.right[done : done + n]], axis=1).ravel()
        flat = np.append(flat, flat[_ragged(start[sides], size[sides])])
        done += n
    ids = flat[_ragged(start[g.symbols], size[g.symbols])]
    ends = np.append(0, np.cumsum(size[g.symbols]))[np.append(0, np.cumsum(g.counts))]
    return ids.astype(np.int32), np.diff(ends)


def between(g: Grammar, nth: int, start: int, stop: int) -> list[int]:
    """Ids ``start`` to ``stop`` (not included) of the nth document; only symbols that reach into that range are expanded."""
    last = int(g.counts[: nth + 1].sum())
    own = g.symbols[last - int(g.counts[nth]) : last]
    size = np.where(own < g.base, 1, g.lengths[np.maximum(own - g.base, 0)] if len(g.lengths) else 1)
    ends = np.cumsum(size)
    start, stop = max(0, start), min(stop, int(ends[-1]) if len(ends) else 0)
    out, k = [], int(np.searchsorted(ends, start, side="right"))
    while k < len(own) and ends[k] - size[k] < stop:
        todo = [(int(own[k]), int(ends[k] - size[k]))]
        while todo:
            symbol, at = todo.pop()
            if symbol < g.base:
                out.append(symbol)
                continue
            left, right = int(g.left[symbol - g.base]), int(g.right[symbol - g.base])
            middle = at + (1 if left < g.base else int(g.lengths[left - g.base]))
            end = at + int(g.lengths[symbol - g.base])
            if middle < stop and end > start:
                todo.append((right, middle))
            if at < stop and middle > start:
                todo.append((left, at))
        k += 1
    return out


def portions(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows of a batch, ROWS or BYTES of text at a time."""
    sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy()
    ends, s = np.cumsum(sizes, dtype=np.int64), 0
    while s < len(ends):
        stop = int(np.searchsorted(ends, ends[s] - sizes[s] + BYTES, "right"))
        n = min(ROWS, max(1, stop - s))
        yield batch.slice(s, n)
        s += n


def write(docs: DataFrame, path: str, vocabulary: str | None = None) -> None:
    """Encodes every whole text, ends it with ``END``, and writes shards in ascending doc_id order below ``path``.

    Needs ``doc_id`` and ``text``; other columns are not read. Null and empty
    texts have the end only. A null doc_id comes first. Rows of one doc_id are
    neighbours in the order of a hash of their texts; repeated rows are written each.
    An empty table gives no shard. A task streams one range of ids and holds one shard.
    """
    vocabulary = vocabulary or bpe.default_vocabulary()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    keys = ["doc_id", F.xxhash64("text")]
    laid = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("doc_id", "text", F.spark_partition_id().alias("part"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end = encoder(vocabulary), struct.pack("<i", END)
        part, shard, before, held, docs, texts = None, 0, 0, 0, [], []

        def shut() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(texts), "<i4")
            data = packed(compressed(ids, np.array([len(t) // 4 for t in texts])))
            return pa.record_batch([pa.array([x], f.type) for x, f in zip((part, shard, before, held, docs, data), _SHARDS)], schema=_SHARDS)

        for batch in batches:
            for some in portions(batch):
                part = some.column("part")[0].as_py()
                for doc_id, ids in zip(some.column("doc_id").to_pylist(), words.encode(as_bytes(some, "text"))):
                    texts.append(ids + end)
                    docs.append(doc_id)
                    held += len(texts[-1]) // 4
                    if held >= SHARD_IDS:
                        yield shut()
                        shard, before, held, docs, texts = shard + 1, before + held, 0, [], []
        if docs:
            yield shut()

    laid.mapInArrow(work, SHARDS).write.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The shards as they are stored, columns of SHARDS."""
    return spark.read.schema(SHARDS).parquet(path)


def _opened(shards: DataFrame, schema: pa.Schema, kind: str, columns: Callable[[np.ndarray, np.ndarray], list[pa.Array]]) -> DataFrame:
    """(doc_id, start, …): every document of the files, with the number of ids of all documents before it.

    ``columns`` makes the other columns from the ids of some documents and from where each begins, the end of the last one behind.
    """
    totals = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))  # one row for each part, as many as tasks wrote
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0).cast("long")).alias("earlier"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                ids, n = expanded(unpacked(batch.column("data")[r].as_py()))
                offsets = np.append(0, np.cumsum(n))
                start = batch.column("earlier")[r].as_py() + batch.column("before")[r].as_py() + offsets[:-1]
                docs = batch.column("docs")[r].values
                # Some documents at a time: what a shard expands to is handed on in pieces.
                for s in range(0, len(n), HANDED):
                    some = offsets[s : s + HANDED + 1]
                    yield pa.record_batch([docs.slice(s, HANDED), pa.array(start[s : s + HANDED]), *columns(ids[some[0] : some[-1]], some - some[0])], schema=schema)

    rows = shards.join(F.broadcast(totals), "part").select("earlier", "before", "docs", "data")
    return rows.mapInArrow(work, f"doc_id long, start long, {kind}")


def documents(shards: DataFrame) -> DataFrame:
    """(doc_id, start, ids): every document of the files, with the number of ids of all documents before it."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.list_(pa.int32()))])
    return _opened(shards, schema, "ids array<int>", lambda ids, offsets: [pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))])


def lookup(shards: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, start, stop, ids) for ranges of ids of single documents, read without the rest of their shards.

    ``wanted`` has ``doc_id``, ``start`` and ``stop``; equal requests count once.
    A document that is not there gives no row, a range beyond its end what there
    is. Rows of one doc_id are answered each. Requests for one shard go to it in
    lists of bounded length.
    """
    places = shards.select("part", "shard", F.posexplode("docs").alias("nth", "doc_id"))
    asked = wanted.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"))
    asked = asked.distinct().join(places, "doc_id")
    turn = F.row_number().over(Window.partitionBy("part", "shard").orderBy("nth", "start", "stop"))
    asked = asked.withColumn("turn", F.floor((turn - 1) / REQUESTS))
    lists = asked.groupBy("part", "shard", "turn").agg(F.collect_list(F.struct("doc_id", "nth", "start", "stop")).alias("asked"))
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("stop", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                g = unpacked(batch.column("data")[r].as_py())
                rows = batch.column("asked")[r].as_py()
                found = [between(g, x["nth"], x["start"], x["stop"]) for x in rows]
                yield pa.record_batch([pa.array([x[c] for x in rows], pa.int64()) for c in ("doc_id", "start", "stop")] + [pa.array(found, schema[3].type)], schema=schema)

    return lists.join(shards.select("part", "shard", "data"), ["part", "shard"]).select("asked", "data").mapInArrow(
        work, "doc_id long, start long, stop long, ids array<int>"
    )


def checksums(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document of the files: its ids as little-endian unsigned 32-bit numbers.

    Ids are summed up where they are read; they do not leave the task.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def sums(ids: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
        data, ends = memoryview(ids.astype("<u4").tobytes()), (offsets * 4).tolist()
        return [pa.array(np.diff(offsets)), pa.array([zlib.crc32(data[a:b]) for a, b in zip(ends, ends[1:])], pa.int64())]

    return _opened(shards, schema, "n_tokens long, ids_crc32 long", sums)


def round_trip(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Writes all documents to files in the shared folder and returns the checksums of what is read back."""
    path = scratch_path(docs.sparkSession, "token_ids")
    write(docs, path, vocabulary)
    return checksums(read(docs.sparkSession, path))
