"""Tokens of two tokenizers laid side by side, with corpus-wide scores of id pairs.

Two encodings of one text are cut into groups where tokens of both end; every
token of one side in a group is linked with every token of the other. How many
documents hold an id pair linked comes from an inverted table: documents are
numbered inside chunks of bounded size, and for each pair and chunk a compressed
bitmap tells the documents, further bitmaps the bits of how many links more than
one each has. Bitmaps of a chunk are merged by OR while documents arrive,
popcounts are summed over chunks, and the same postings carry the scores of the
pairs back to their documents.
"""
from __future__ import annotations

import functools
import hashlib
import os
import re
from array import array
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigspark.llm.common import stored

#: Documents of a chunk; their numbers have 16 bits.
CHUNK = 8192
#: A chunk also ends with the document that brings it to so many links of different pairs.
CHUNK_PAIRS = 2_000_000
#: Distinct units that a worker remembers, and the longest that is remembered, in characters.
REMEMBERED = 250_000
LONGEST = 256
#: Documents whose units are looked up together.
ROWS = 64

#: White space in Unicode.
BLANK = "".join(map(chr, [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))

DOCUMENTS = "doc_id long, chunk long, place int, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
PAIRS = "chunk long, a int, b int, n int, docs binary, planes array<binary>"
_DOCUMENTS = pa.schema(
    [("doc_id", pa.int64()), ("chunk", pa.int64()), ("place", pa.int32())]
    + [(c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")] + [("groups_sha256", pa.string())]
)
_PAIRS = pa.schema(
    [("chunk", pa.int64()), ("a", pa.int32()), ("b", pa.int32()), ("n", pa.int32()), ("docs", pa.binary()), ("planes", pa.list_(pa.binary()))]
)


def default_vocabularies() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


# Bitmaps of a chunk


def packed(places: np.ndarray) -> bytes:
    """Ascending distinct numbers below 65,536: the shorter of a list of 16-bit numbers and a row of bits, after a byte for the form."""
    if not len(places) or 16 * len(places) <= int(places[-1]) + 1:
        return b"\0" + places.astype("<u2").tobytes()
    bits = np.zeros(int(places[-1]) + 1, np.uint8)
    bits[places] = 1
    return b"\1" + np.packbits(bits, bitorder="little").tobytes()


def unpacked(bitmap: bytes) -> np.ndarray:
    """The numbers of a bitmap, ascending."""
    if bitmap[0]:
        return np.flatnonzero(np.unpackbits(np.frombuffer(bitmap, np.uint8, offset=1), bitorder="little"))
    return np.frombuffer(bitmap, "<u2", offset=1).astype(np.int64)


def merged(one: bytes, two: bytes) -> bytes:
    """OR of two bitmaps."""
    return packed(np.union1d(unpacked(one), unpacked(two)))


def popcount(bitmap: bytes) -> int:
    """How many numbers a bitmap holds."""
    if bitmap[0]:
        return int(np.bitwise_count(np.frombuffer(bitmap, np.uint8, offset=1)).sum())
    return (len(bitmap) - 1) // 2


# Alignment of a text


def _byte_of(character: str) -> int:
    """The byte that a character stands for in a byte-level vocabulary: visible bytes for themselves, the others in order from 256."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    if ord(character) < 256:
        return ord(character)
    return [b for b in range(256) if b not in plain][ord(character) - 256]


#: Groups as the digest has them (None: the tokens of a side are not the text), tokens of both sides, and a << 32 | b of every link.
Unit = tuple[str | None, int, bytes]
DIFFERENT: Unit = (None, 0, b"")


class Aligner:
    """Both vocabularies in a worker, and the units it has met.

    A unit is a stretch that both tokenizers encode by itself, from white space
    to the next; the groups of a text are those of its units in a row.
    """

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True  # their strings are plain text
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        code = functools.lru_cache(None)(_byte_of)
        self.bytes_a = {i: bytes(map(code, t)) for t, i in self.a.get_vocab(with_added_tokens=False).items()}
        pieces = [self.b.id_to_piece(i).replace("▁", " ") for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.encode() for i, p in enumerate(pieces)]
        self.size_a = np.array([len(self.bytes_a.get(i, b"")) for i in range(max(self.bytes_a) + 1)])
        self.size_b = np.array([len(x) for x in self.bytes_b])
        # Numbers with what follows them: a further token of the side, the other side, the next group.
        self.name = np.array([[f"{i},", f"{i}|", f"{i};"] for i in range(max(len(self.size_a), len(self.size_b)))], object)
        # A text may be cut before white space that follows other characters: no token of the
        # first side has such a place inside, and none of the second if the character never
        # stands there, nor behind the blank that the second side puts in front.
        joined = {c for p in pieces for before, c in zip(p, p[1:]) if c in BLANK and (c != " " or before not in BLANK)}
        inside = "".join(c for c in BLANK if c in joined)
        more = f"(?:[{inside}][{BLANK}]*[^{BLANK}]*)*" if inside else ""
        self.unit = re.compile(f"[{BLANK}]*[^{BLANK}]+{more}|[{BLANK}]+")
        self.known: dict[str, Unit] = {}
        self.older: dict[str, Unit] = {}  # those of the generation before: a unit in use moves up

    def unit_of(self, text: str, a: list[int], b: list[int]) -> Unit:
        """Groups of one unit from the tokens of both sides."""
        bytes_a, bytes_b, own = self.bytes_a, self.bytes_b, text.encode()
        if text[0] != " ":
            # The second side puts a blank in front, which no token has together with what follows here.
            if not b or bytes_b[b[0]] != b" ":
                return DIFFERENT
            b = b[1:]
        if b"".join([bytes_a[k] for k in a]) != own or b"".join([bytes_b[k] for k in b]) != own:
            return DIFFERENT
        end_a, end_b = list(accumulate([len(bytes_a[k]) for k in a])), list(accumulate([len(bytes_b[k]) for k in b]))
        said, links, i, j = [], [], 0, 0
        for end in sorted(set(end_a).intersection(end_b)):
            to_i, to_j = end_a.index(end, i) + 1, end_b.index(end, j) + 1
            x, y = a[i:to_i], b[j:to_j]
            said.append(f"{','.join(map(str, x))}|{','.join(map(str, y))}")
            links += [k << 32 | n for k in x for n in y]
            i, j = to_i, to_j
        return ";".join(said), len(a) << 32 | len(b), array("q", links).tobytes()

    def together(self, units: list[str]) -> list[Unit]:
        """The same for many units that begin with a blank: in a row, they are a text that is cut between them."""
        text = "".join(units)
        a = np.array(self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids)
        b = np.array(self.b.encode(text[1:]))
        if b"".join([self.bytes_b[k] for k in b.tolist()]) != text.encode():
            return [self.unit_of(u, self.a.encode(u, add_special_tokens=False).ids, self.b.encode(u[1:])) for u in units]
        end_a, end_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        both = np.intersect1d(end_a, end_b, assume_unique=True)
        of_a, of_b = np.searchsorted(both, end_a), np.searchsorted(both, end_b)  # group of each token
        n_a, n_b = np.bincount(of_a, minlength=len(both)), np.bincount(of_b, minlength=len(both))
        first_a, first_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
        said = np.empty(len(a) + len(b), object)
        said[np.arange(len(a)) + first_b[of_a]] = self.name[a, np.where(np.isin(end_a, both), 1, 0)]
        said[np.arange(len(b)) + (first_a + n_a)[of_b]] = self.name[b, np.where(np.isin(end_b, both), 2, 0)]
        # All links of a group: each token of one side with each of the other.
        links = n_a * n_b
        of_link = np.repeat(np.arange(len(both)), links)
        nth = np.arange(len(of_link)) - (np.cumsum(links) - links)[of_link]
        pair = a[first_a[of_link] + nth // n_b[of_link]] << 32 | b[first_b[of_link] + nth % n_b[of_link]]
        last = np.searchsorted(both, np.cumsum([len(u.encode()) for u in units])) + 1
        ends = [np.append(0, np.cumsum(x))[last].tolist() for x in (n_a, n_b, links)]
        said, pair, out, i, j, k = said.tolist(), pair.astype(np.int64).tobytes(), [], 0, 0, 0
        for to_i, to_j, to_k in zip(*ends):
            out.append(("".join(said[i + j : to_i + to_j])[:-1], (to_i - i) << 32 | (to_j - j), pair[8 * k : 8 * to_k]))
            i, j, k = to_i, to_j, to_k
        return out

    def units(self, texts: list[str | None]) -> list[list[Unit]]:
        """The units of each text; units not met before are encoded together."""
        cut = [self.unit.findall(" " + t) if t else [] for t in texts]
        if len(self.known) > REMEMBERED:
            self.known, self.older = {}, self.known
        new = []
        for u in {u for units in cut for u in units}:
            if u not in self.known:
                if u in self.older:
                    self.known[u] = self.older[u]
                else:
                    new.append(u)
        # White space at the end of a text would run into that of another unit, and tokens with it.
        plain = [u for u in new if u[0] == " " and u[-1] not in BLANK and "▁" not in u]
        for s in range(0, len(plain), 2048):
            self.known.update(zip(plain[s : s + 2048], self.together(plain[s : s + 2048])))
        for u in new:
            if u[0] == " " and u[-1] in BLANK and "▁" not in u:
                self.known[u] = self.together([" x", u])[-1]
            elif u[0] != " " or "▁" in u:
                self.known[u] = self.unit_of(u, self.a.encode(u, add_special_tokens=False).ids, self.b.encode(u[1:] if u[0] == " " else u))
        out = [[self.known[u] for u in units] for units in cut]
        for u in new:
            if len(u) > LONGEST:
                del self.known[u]
        return out


@functools.lru_cache(maxsize=1)
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


class Chunk:
    """Bitmaps of some documents: rows of (pair, document, links), merged by OR as documents arrive."""

    def __init__(self):
        self.documents, self.held, self.parts = 0, 0, []

    def add(self, pairs: np.ndarray) -> None:
        """The links of the next document."""
        pair, links = np.unique(pairs, return_counts=True)
        self.parts.append((pair, np.full(len(pair), self.documents, np.int64), links))
        self.documents += 1
        self.held += len(pair)

    @property
    def full(self) -> bool:
        return self.documents >= CHUNK or self.held >= CHUNK_PAIRS

    def rows(self, number: int) -> pa.RecordBatch:
        pair, doc, links = (np.concatenate([p[k] for p in self.parts]) if self.parts else np.zeros(0, np.int64) for k in range(3))
        order = np.argsort(pair, kind="stable")  # documents stay in order
        pair, doc, more = pair[order], doc[order], links[order] - 1
        first = np.flatnonzero(np.append(True, pair[1:] != pair[:-1])) if len(pair) else np.zeros(0, np.int64)
        ends = np.append(first[1:], len(pair))
        docs, planes = [], []
        many = np.maximum.reduceat(more, first) if len(first) else more
        for s, e, top in zip(first.tolist(), ends.tolist(), many.tolist()):
            docs.append(packed(doc[s:e]))
            planes.append([packed(doc[s:e][more[s:e] >> bit & 1 == 1]) for bit in range(int(top).bit_length())])
        columns = [np.full(len(first), number), pair[first] >> 32, pair[first] & 0xFFFFFFFF, [popcount(d) for d in docs], docs, planes]
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, _PAIRS)], schema=_PAIRS)


def encode(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """(document, pairs): a row with ``document`` for each text, and one with ``pairs`` for each id pair and chunk.

    A text is null, empty, or not what the tokens of a side say (with a blank
    before it): then it has no tokens, zeros and an empty digest. Repeated rows
    are documents of their own. Other columns are not read.
    """
    default = default_vocabularies()
    path_a, path_b = path_a or default[0], path_b or default[1]
    schema = pa.schema([("document", pa.struct(list(_DOCUMENTS))), ("pair", pa.struct(list(_PAIRS)))])

    def out(documents: list[tuple] = (), pairs: pa.RecordBatch | None = None) -> pa.RecordBatch:
        if pairs is None:
            rows = pa.record_batch([pa.array([d[k] for d in documents], f.type) for k, f in enumerate(_DOCUMENTS)], schema=_DOCUMENTS)
            return pa.record_batch([rows.to_struct_array(), pa.nulls(len(rows), schema[1].type)], schema=schema)
        return pa.record_batch([pa.nulls(len(pairs), schema[0].type), pairs.to_struct_array()], schema=schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(path_a, path_b)
        # A chunk belongs to the task that makes it; its number is the same if the task runs again.
        number, chunk = TaskContext.get().partitionId() << 32, Chunk()
        for batch in batches:
            rows = []
            for s in range(0, batch.num_rows, ROWS):
                some = batch.slice(s, ROWS)
                for doc_id, units in zip(some.column("doc_id").to_pylist(), both.units(some.column("text").to_pylist())):
                    said = [u[0] for u in units]
                    if None in said:
                        units, said = [], []
                    said, tokens = ";".join(said), sum([u[1] for u in units])
                    links = np.frombuffer(b"".join([u[2] for u in units]), np.int64)
                    digest = hashlib.sha256(said.encode()).hexdigest() if units else ""
                    rows.append((doc_id, number, chunk.documents, tokens >> 32, tokens & 0xFFFFFFFF, said.count("|"), len(links), digest))
                    chunk.add(links)
                    if chunk.full:
                        yield out(rows)
                        yield out(pairs=chunk.rows(number))
                        number, chunk, rows = number + 1, Chunk(), []
            if rows:
                yield out(rows)
        if chunk.held:
            yield out(pairs=chunk.rows(number))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(work, f"document struct<{_typed(DOCUMENTS)}>, pair struct<{_typed(PAIRS)}>")


def _typed(columns: str) -> str:
    return ", ".join(c.replace(" ", ":", 1) for c in columns.split(", "))


def pair_counts(pairs: DataFrame) -> DataFrame:
    """(a, b, count, best): documents that hold a pair linked, and whether no pair of the same ``a`` has more."""
    counts = pairs.groupBy("a", "b").agg(F.sum("n").alias("count"))
    counts = stored(counts, "counts")
    highest = counts.groupBy("a").agg(F.max("count").alias("highest"))
    return counts.join(highest, "a").select("a", "b", "count", (F.col("count") == F.col("highest")).cast("int").alias("best"))


def _scores(pairs: DataFrame, counts: DataFrame) -> DataFrame:
    """(chunk, place, n_best, count_sum): what the postings of a chunk bring to its documents."""
    schema = pa.schema([("chunk", pa.int64()), ("place", pa.int32()), ("n_best", pa.int64()), ("count_sum", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, total, chunk, most = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), None, -1
        for batch in batches:
            chunk = batch.column("chunk")[0].as_py()
            columns = (batch.column(c).to_pylist() for c in ("docs", "planes", "count", "best"))
            for docs, planes, count, is_best in zip(*columns):
                for bit, bitmap in enumerate([docs, *planes]):
                    places, times = unpacked(bitmap), 1 << max(0, bit - 1)  # the first bitmap stands for one link each
                    total[places] += times * count
                    if is_best:
                        best[places] += times
                    most = max(most, int(places[-1])) if len(places) else most
        n = most + 1
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(([chunk] * n, range(n), best[:n], total[:n]), schema)], schema=schema)

    rows = pairs.select("a", "b", "chunk", "docs", "planes").join(counts, ["a", "b"])
    return rows.groupBy("chunk").applyInArrow(work, "chunk long, place int, n_best long, count_sum long")


def align(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """Per document: tokens of both sides, groups, links, their digest, and how its links stand in the corpus.

    ``n_best`` counts links whose pair is held by as many documents as any of its
    ``a``, ``count_sum`` sums the documents of the pair over all links. Cases are
    those of ``encode``; an empty table gives an empty result.
    """
    rows = stored(encode(docs, path_a, path_b), "links")
    documents = rows.filter("document IS NOT NULL").select("document.*")
    pairs = rows.filter("pair IS NOT NULL").select("pair.*")
    scores = _scores(pairs, pair_counts(pairs))
    zero: Column = F.lit(0).cast("long")
    return documents.join(scores, ["chunk", "place"], "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"),
        F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256",
    )
