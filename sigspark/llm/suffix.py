"""Removal of long repeated passages with run-length suffix indexes.

A window of WINDOW bytes belongs to its anchor, the GRAM bytes in it with the
lowest hash. Equal windows have equal anchors, so repeated windows meet in the
shard of their anchor. Neighbouring windows with one anchor form a stretch.

1. Texts are packed into compressed blocks.
2. Blocks send the hashes of their anchors; anchors of one document only drop out.
3. Blocks send their distinct stretches at the other anchors, with the lowest document.
4. A shard indexes its distinct stretches: suffix order, Burrows-Wheeler transform
   in runs, samples at the ends of runs. Stretches stream through the index; where
   the matching statistic reaches WINDOW, the rows of the match name the lowest document.
5. Blocks get a bit for each window back and drop the bytes that repeat an earlier document.
"""
from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import accumulate
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigspark.llm.common import DOCUMENT_COLUMNS, as_bytes, stored

WINDOW = 50
GRAM = 16
#: Places of an anchor in a window; at most so many windows in a stretch.
REACH = WINDOW - GRAM + 1
#: Of the other bytes of a window at least so many stand on one side of its anchor.
SIDE = -(-(WINDOW - GRAM) // 2)
#: Text bytes of a block.
BLOCK_BYTES = 8 << 20
#: Text bytes for each shard.
SHARD_BYTES = 12 << 20
#: Stretch bytes of an index; a shard builds several where needed.
INDEX_BYTES = 2 << 20
_POS_BITS = 16
_SLICE = (1 << _POS_BITS) - WINDOW
_LAST = np.iinfo(np.int64).max  # stands for a null doc_id
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _gram_hashes(data: bytes) -> np.ndarray:
    """Hash of the GRAM bytes at each place, its low bits free."""
    n = len(data) - GRAM + 1
    low = np.ndarray((n,), "<u8", data, strides=(1,))
    high = np.ndarray((n,), "<u8", data, 8, strides=(1,))
    with np.errstate(over="ignore"):
        h = low * _M1
        h ^= h >> np.uint64(32)
        h += high
        h *= _M2
        h ^= h >> np.uint64(29)
        h *= _M1
    return h


def _spread(h: np.ndarray) -> np.ndarray:
    """Halves of 48 bits exchanged: the lowest hash of a window has a low front, its other end is even."""
    return (h & np.uint64(0xFFFFFF)) << np.uint64(24) | h >> np.uint64(24)


class Stretches(NamedTuple):
    start: np.ndarray  # first window
    count: np.ndarray  # windows
    anchor: np.ndarray  # hash of 48 bits
    doc: np.ndarray  # place of the document in the block


def stretches(data: bytes, ends: np.ndarray) -> Stretches:
    """All windows of the documents that lie end to end in ``data``, by runs of one anchor."""
    out = []
    free = np.uint64((1 << 64) - (1 << _POS_BITS))
    for s in range(0, max(0, len(data) - WINDOW + 1), _SLICE):
        part = data[s : s + _SLICE + WINDOW - 1]
        h = _gram_hashes(part)
        h &= free
        h |= np.arange(len(h), dtype=np.uint64)
        step = 1
        while step * 2 <= REACH:
            h = np.minimum(h[:-step], h[step:])
            step *= 2
        if REACH > step:
            h = np.minimum(h[: len(h) - (REACH - step)], h[REACH - step :])
        first, last = np.searchsorted(ends, [s, s + len(h)], "right")
        borders = ends[first : last + 1] - s
        new = np.empty(len(h), bool)
        new[0] = True
        np.not_equal(h[1:], h[:-1], out=new[1:])
        valid = np.ones(len(h), bool)
        for b in borders.tolist():  # windows over a border belong to no document
            valid[max(0, b - WINDOW + 1) : max(0, min(b, len(h)))] = False
            if 0 <= b < len(h):
                new[b] = True
        edge = np.flatnonzero(new | ~valid)
        at = edge[valid[edge]]
        stop = np.r_[edge, len(h)][np.searchsorted(edge, at, "right")]
        out.append((at + s, stop - at, _spread(h[at] >> np.uint64(_POS_BITS))))
    if not out:
        return Stretches(*(np.empty(0, t) for t in (np.int64, np.int64, np.uint64, np.int64)))
    start, count, anchor = (np.concatenate(x) for x in zip(*out))
    return Stretches(start, count, anchor, np.searchsorted(ends, start, "right"))


def _bucket(anchor: np.ndarray, buckets: int) -> np.ndarray:
    return (anchor >> np.uint64(16)) * np.uint64(buckets) >> np.uint64(32)


class Index:
    """Run-length index of distinct byte strings of up to 112 bytes, each with a document.

    Places and rows are numbers of 32 bits and symbols of 16, and what only the
    sorting needs goes as soon as it can: a worker holds few arrays at a time.
    """

    def __init__(self, strings: list[bytes], docs: np.ndarray):
        sizes = np.fromiter(map(len, strings), np.int64, len(strings))
        self.starts = np.cumsum(sizes + 1) - sizes - 1
        self.sizes = sizes
        self.sym = np.frombuffer(b"\x00".join(strings) + b"\x00", np.uint8).astype(np.int16) + np.int16(1)
        stops = self.starts + sizes
        self.sym[stops] = 0
        n = self.n = len(self.sym)
        stop = np.repeat(stops.astype(np.int32), sizes + 1)
        place = np.arange(n, dtype=np.int32)
        # Suffixes end at their string's mark: seven symbols in one number, then doubled.
        key, alive = np.zeros(n, np.int64), np.ones(n, bool)
        padded = np.append(self.sym, np.zeros(8, np.int16))
        for j in range(7):
            key <<= 9
            key |= np.where(alive, padded[j : j + n], np.int16(0))
            alive &= padded[j : j + n] != 0
        del padded, alive
        rank, depth, fifty = self._ranks(key), 7, None
        while True:
            del key
            if depth == 28:
                fifty = self._paired(rank, WINDOW - 28, stop, place)
            key = self._paired(rank, depth, stop, place)
            if depth >= 56:
                break
            rank, depth = self._ranks(key), depth * 2
        del rank, stop, place
        self.order = order = np.argsort(key, kind="stable").astype(np.int32)  # equal suffixes by place, as if each mark were its own
        del key
        before = self.sym[order - 1]
        head = np.r_[True, before[1:] != before[:-1]]
        self.run_start = np.flatnonzero(head).astype(np.int32)
        self.run_char = before[self.run_start]
        self.run_of = np.cumsum(head, dtype=np.int32) - np.int32(1)
        del before, head
        run_end = np.append(self.run_start[1:], np.int32(n)) - np.int32(1)
        self.first_sample, self.last_sample = order[self.run_start], order[run_end]
        self.run_end = run_end
        # Runs by symbol: the rows before a run in this order are the rows that its first row maps to.
        self.by_char = np.argsort(self.run_char, kind="stable").astype(np.int32)
        lengths = (run_end - self.run_start + 1)[self.by_char]
        self.base = np.empty(len(lengths), np.int32)
        self.base[self.by_char] = np.cumsum(lengths, dtype=np.int32) - lengths
        self.char_key = self.run_char[self.by_char].astype(np.int64) * len(lengths) + self.by_char
        # Rows that agree in WINDOW bytes, and the lowest document among them.
        fifty = fifty[order]
        self.group_start = np.flatnonzero(np.append(True, fifty[1:] != fifty[:-1])).astype(np.int32)
        del fifty
        self.lowest = np.minimum.reduceat(np.repeat(docs, sizes + 1)[order], self.group_start)

    def _ranks(self, key: np.ndarray) -> np.ndarray:
        order = np.argsort(key)
        key = key[order]
        rank = np.empty(self.n, np.int32)
        rank[order] = np.cumsum(np.append(False, key[1:] != key[:-1]), dtype=np.int32)
        return rank

    def _paired(self, rank, depth, stop, place) -> np.ndarray:
        after = np.zeros(self.n, np.int32)
        after[: self.n - depth] = rank[depth:] + np.int32(1)
        after[place + np.int32(depth) > stop] = 0
        key = rank.astype(np.int64)
        key *= self.n + 1
        key += after
        return key

    def _common(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Symbols that the suffixes at two places share, up to a bound."""
        out, todo = np.zeros(len(a), np.int64), np.flatnonzero(most > 0)
        while len(todo):
            x = self.sym[np.minimum(a[todo] + out[todo], self.n - 1)]
            same = (x == self.sym[np.minimum(b[todo] + out[todo], self.n - 1)]) & (x > 0)
            todo = todo[same]
            out[todo] += 1
            todo = todo[out[todo] < most[todo]]
        return out

    def stream(self, text: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, int, np.ndarray, np.ndarray]]:
        """Matching statistics of many texts, all from their last symbol to the first in step.

        Yields for every step the texts, how many symbols lie behind, the length
        of the longest match from there, and a row of the index that has it. If
        the row's run has the wanted symbol, the match grows; if not, it moves to
        the end of the run before or the start of the run behind that has it,
        where a sample tells how much of the match remains.
        """
        lanes = np.argsort(-sizes, kind="stable")
        row, at, length = np.zeros(len(lanes), np.int64), np.full(len(lanes), self.order[0]), np.zeros(len(lanes), np.int64)
        runs = len(self.run_start)
        for t in range(int(sizes.max(initial=0))):
            some = lanes[: int(np.count_nonzero(sizes > t))]
            q, p, n = row[: len(some)], at[: len(some)], length[: len(some)]
            c = text[starts[some] + sizes[some] - 1 - t]
            r = self.run_of[q].astype(np.int64)
            off = np.flatnonzero(self.run_char[r] != c)
            if len(off):
                i = np.searchsorted(self.char_key, c[off].astype(np.int64) * runs + r[off])
                up, down = np.maximum(i - 1, 0), np.minimum(i, runs - 1)
                has_up = (i > 0) & (self.run_char[self.by_char[up]] == c[off])
                has_down = (i < runs) & (self.run_char[self.by_char[down]] == c[off])
                above, below = self.by_char[up], self.by_char[down]
                n_up = np.where(has_up, self._common(p[off], self.last_sample[above], np.where(has_up, n[off], 0)), -1)
                n_down = np.where(has_down, self._common(p[off], self.first_sample[below], np.where(has_down, n[off], 0)), -1)
                lower = n_down > n_up
                to = np.where(lower, below, above)
                gone = np.maximum(n_up, n_down) < 0  # the symbol is not in the index
                q[off] = np.where(lower, self.run_start[to], self.run_end[to])
                p[off] = np.where(lower, self.first_sample[to], self.last_sample[to])
                n[off] = np.maximum(n_up, n_down)
                r[off] = to
                q_next = self.base[r] + q - self.run_start[r]
                q_next[off[gone]] = 0
                q[:] = q_next
                p -= 1
                n += 1
                p[off[gone]], n[off[gone]] = self.order[0], 0
            else:
                q[:] = self.base[r] + q - self.run_start[r]
                p -= 1
                n += 1
            yield some, t + 1, n, q

    def lowest_documents(self) -> np.ndarray:
        """[string, window]: lowest document with the window, found by streaming all strings."""
        out = np.full((len(self.sizes), REACH), _LAST)
        for some, behind, n, q in self.stream(self.sym, self.starts, self.sizes):
            long = np.flatnonzero(n >= WINDOW)
            if len(long):
                group = np.searchsorted(self.group_start, q[long].astype(np.int32), "right") - 1
                out[some[long], self.sizes[some[long]] - behind] = self.lowest[group]
        return out


def _blocks(docs: DataFrame, carry: list[str]) -> DataFrame:
    fields = [("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("content", pa.binary()), *((c, pa.list_(pa.string())) for c in carry)]
    schema = pa.schema(fields)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        texts, ids, more, held = [], [], [[] for _ in carry], 0

        def closed():
            cols = [[ids], [[len(t) for t in texts]], [pack.compress(b"".join(texts))], *([m] for m in more)]
            return pa.record_batch([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

        for batch in batches:
            others = [batch.column(c).to_pylist() for c in carry]
            for i, (doc_id, text) in enumerate(zip(batch.column("doc_id").to_pylist(), as_bytes(batch, "text"))):
                if texts and held + len(text) > BLOCK_BYTES:
                    yield closed()
                    texts, ids, more, held = [], [], [[] for _ in carry], 0
                texts.append(text)
                ids.append(_LAST if doc_id is None else doc_id)
                for m, o in zip(more, others):
                    m.append(o[i])
                held += len(text)
        if texts:
            yield closed()

    text = "ids array<long>, sizes array<long>, content binary" + "".join(f", `{c}` array<string>" for c in carry)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *[F.col(c).cast("string").alias(c) for c in carry])
    return stored(rows.mapInArrow(work, text).withColumn("block", F.monotonically_increasing_id()), "blocks")


def _opened(batch: pa.RecordBatch, i: int) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Text, ends and doc_ids of a block."""
    data = zstandard.ZstdDecompressor().decompress(batch.column("content")[i].as_py())
    sizes = batch.column("sizes")[i].values.to_numpy()
    return data, np.cumsum(sizes), batch.column("ids")[i].values.to_numpy()


def _six(h: np.ndarray) -> bytes:
    return np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _from_six(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8")[:, 0]


def _shared_anchors(blocks: DataFrame, buckets: int) -> DataFrame:
    """(block, marks): for each block which of its anchors other documents have too, by bucket."""
    schema = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("anchors", pa.binary()), ("several", pa.binary())])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                data, ends, _ = _opened(batch, i)
                s = stretches(data, ends)
                order = np.argsort(s.anchor, kind="stable")
                a, d = s.anchor[order], s.doc[order]
                first = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else np.empty(0, np.int64)
                if not len(first):
                    continue
                several = np.minimum.reduceat(d, first) != np.maximum.reduceat(d, first)
                a = a[first]
                to = _bucket(a, buckets)
                cut = np.flatnonzero(np.r_[True, to[1:] != to[:-1]])
                spans = list(zip(cut.tolist(), [*cut[1:].tolist(), len(a)]))
                block = batch.column("block")[i].as_py()
                yield pa.record_batch([
                    pa.array(to[cut].astype(np.int64)), pa.array([block] * len(cut), pa.int64()),
                    pa.array([_six(a[x:y]) for x, y in spans], pa.binary()),
                    pa.array([np.packbits(several[x:y]).tobytes() for x, y in spans], pa.binary()),
                ], schema=schema)

    out = pa.schema([("block", pa.int64()), ("bucket", pa.int64()), ("marks", pa.binary())])

    def meet(rows: pa.Table) -> pa.Table:
        parts = [_from_six(x) for x in rows.column("anchors").to_pylist()]
        sizes = [len(p) for p in parts]
        a = np.concatenate(parts)
        several = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=n) for x, n in zip(rows.column("several").to_pylist(), sizes)])
        order = np.argsort(a)
        same = a[order][1:] == a[order][:-1]
        twice = np.r_[False, same] | np.r_[same, False]
        shared = several.astype(bool)
        shared[order[twice]] = True
        marks = [np.packbits(shared[e - n : e]).tobytes() for e, n in zip(accumulate(sizes), sizes)]
        return pa.table([rows.column("block"), rows.column("bucket"), pa.array(marks, pa.binary())], schema=out)

    sent = blocks.select("block", "ids", "sizes", "content").mapInArrow(send, "bucket long, block long, anchors binary, several binary")
    met = sent.groupBy("bucket").applyInArrow(meet, "block long, bucket long, marks binary")
    return met.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("bucket", "marks"))).alias("marks"))  # a block has at most all buckets


class Chosen(NamedTuple):
    """Distinct stretches of a block at shared anchors, and where they occur."""

    strings: list[bytes]
    lowest: np.ndarray  # lowest document of the block that has the string
    bucket: np.ndarray
    start: np.ndarray  # occurrences: first window, number of windows, document, place of the string
    count: np.ndarray
    doc: np.ndarray
    string: np.ndarray


def _chosen(data: bytes, ends: np.ndarray, ids: np.ndarray, marks: list[dict], buckets: int) -> Chosen:
    s = stretches(data, ends)
    distinct, place = np.unique(s.anchor, return_inverse=True)
    to = _bucket(distinct, buckets)
    shared = np.zeros(len(distinct), bool)
    for m in marks:
        x, y = np.searchsorted(to, [m["bucket"], m["bucket"] + 1])
        shared[x:y] = np.unpackbits(np.frombuffer(m["marks"], np.uint8), count=int(y - x))
    take = np.flatnonzero(shared[place])
    take = take[np.argsort(to[place[take]], kind="stable")]  # by bucket, else in order
    start, count, doc = s.start[take], s.count[take], s.doc[take]
    known: dict[bytes, int] = {}
    string = np.array([known.setdefault(data[a:b], len(known)) for a, b in zip(start.tolist(), (start + count + WINDOW - 1).tolist())], np.int64)
    lowest, bucket = np.full(len(known), _LAST), np.zeros(len(known), np.int64)
    np.minimum.at(lowest, string, ids[doc])
    bucket[string] = to[place[take]].astype(np.int64)
    return Chosen(list(known), lowest, bucket, start, count, doc, string)


def _search(strings: list[bytes], docs: np.ndarray) -> np.ndarray:
    """Bits of the windows of distinct strings that a lower document than the string's own has.

    A window that two strings share has their anchor and, as WINDOW is longer
    than the anchor, at least SIDE more bytes on one side of it. Strings that
    agree so with no other string need no index.
    """
    bits = np.zeros(len(strings), np.uint64)
    sizes = np.fromiter(map(len, strings), np.int64, len(strings))
    joined = b"".join(strings)
    ends = np.cumsum(sizes)
    h = _gram_hashes(joined)
    h &= np.uint64((1 << 64) - (1 << _POS_BITS))
    h |= (np.arange(len(h)) - np.repeat(ends - sizes, sizes)[: len(h)]).astype(np.uint64)
    for j in range(1, GRAM):
        h[ends[ends - j < len(h)] - j] = np.iinfo(np.uint64).max
    best = np.minimum.reduceat(h, ends - sizes)
    anchor, place = _spread(best >> np.uint64(_POS_BITS)), (best & np.uint64((1 << _POS_BITS) - 1)).astype(np.int64).tolist()
    left = [x[p - SIDE : p + GRAM] if p >= SIDE else None for x, p in zip(strings, place)]
    right = [x[p : p + GRAM + SIDE] if p + GRAM + SIDE <= len(x) else None for x, p in zip(strings, place)]
    before, behind = Counter(left), Counter(right)
    before[None] = behind[None] = 0
    need = np.flatnonzero([before[a] > 1 or behind[b] > 1 for a, b in zip(left, right)])
    if not len(need):
        return bits
    # Parts by anchor keep equal windows together and an index small.
    anchor = anchor[need]
    parts = max(1, -(-int(sizes[need].sum()) // INDEX_BYTES))
    # The low bits: the high ones chose the shard.
    part = (anchor & np.uint64(0xFFFF)) * np.uint64(parts) >> np.uint64(16)
    order = np.argsort(part, kind="stable")
    cuts = np.searchsorted(part[order], np.arange(parts + 1, dtype=np.uint64))
    for a, b in zip(cuts[:-1], cuts[1:]):
        some = need[order[a:b]]
        if len(some):
            low = Index([strings[i] for i in some.tolist()], docs[some]).lowest_documents()
            hit = low < docs[some][:, None]
            bits[some] = (hit.astype(np.uint64) << np.arange(REACH, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    return bits


def _repeated_windows(blocks: DataFrame, marks: DataFrame, buckets: int) -> DataFrame:
    """(block, bits): for the distinct stretches of each block, in order, the repeated windows."""
    schema = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("content", pa.binary()), ("sizes", pa.binary()), ("lowest", pa.binary())])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for i in range(batch.num_rows):
                c = _chosen(*_opened(batch, i), batch.column("marks")[i].as_py(), buckets)
                if not c.strings:
                    continue
                cut = np.flatnonzero(np.r_[True, c.bucket[1:] != c.bucket[:-1]])
                spans = list(zip(cut.tolist(), [*cut[1:].tolist(), len(c.strings)]))
                block = batch.column("block")[i].as_py()
                yield pa.record_batch([
                    pa.array(c.bucket[cut]), pa.array([block] * len(cut), pa.int64()),
                    pa.array([pack.compress(b"".join(c.strings[x:y])) for x, y in spans], pa.binary()),
                    pa.array([bytes(map(len, c.strings[x:y])) for x, y in spans], pa.binary()),
                    pa.array([pack.compress(c.lowest[x:y].astype("<i8").tobytes()) for x, y in spans], pa.binary()),
                ], schema=schema)

    out = pa.schema([("block", pa.int64()), ("bucket", pa.int64()), ("bits", pa.binary())])

    def meet(rows: pa.Table) -> pa.Table:
        unpack, pack = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=1)
        known: dict[bytes, int] = {}
        places, lows = [], []
        for content, sizes, lowest in zip(*(rows.column(c).to_pylist() for c in ("content", "sizes", "lowest"))):
            data, ends = unpack.decompress(content), list(accumulate(sizes))
            places.append(np.array([known.setdefault(data[e - n : e], len(known)) for e, n in zip(ends, sizes)], np.int64))
            lows.append(np.frombuffer(unpack.decompress(lowest), "<i8"))
        docs = np.full(len(known), _LAST)
        for p, d in zip(places, lows):
            np.minimum.at(docs, p, d)
        bits = _search(list(known), docs)
        # A string that a lower document has whole is repeated in all its windows.
        every = np.uint64((1 << 64) - 1)
        back = [np.where(d > docs[p], every, bits[p]) for p, d in zip(places, lows)]
        packed = [pack.compress(b.astype("<u8").tobytes()) for b in back]
        return pa.table([rows.column("block"), rows.column("bucket"), pa.array(packed, pa.binary())], schema=out)

    rows = blocks.select("block", "ids", "sizes", "content").join(marks, "block")
    sent = rows.mapInArrow(send, "bucket long, block long, content binary, sizes binary, lowest binary")
    met = sent.groupBy("bucket").applyInArrow(meet, "block long, bucket long, bits binary")
    return met.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("bucket", "bits"))).alias("bits"))


def deduplicated(docs: DataFrame, carry: list[str] | None = None, as_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, spans, kept): bytes that repeat WINDOW bytes of a document with a smaller doc_id are cut out.

    Needs ``doc_id`` and ``text``; ``carry`` names string columns to bring along.
    ``spans`` are the maximal removed runs [start, end), ``kept`` the other bytes, or
    with ``as_text`` the other characters, without those that a cut goes through.
    Null and empty texts, and texts shorter than a window, stay as they are. A
    null doc_id counts as larger than all others. Rows of one doc_id do not
    remove each other's bytes. Every window of every text is looked at.
    """
    carry = carry or []
    blocks = _blocks(docs, carry)
    total = blocks.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n")).first()["n"] or 0
    buckets = max(8, -(-total // SHARD_BYTES))
    marks = stored(_shared_anchors(blocks, buckets), "anchors")
    bits = _repeated_windows(blocks, marks, buckets)
    found = stored(marks.join(bits, "block", "left"), "repeats")
    fields = [
        ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
        ("kept", pa.string() if as_text else pa.binary()), *((c, pa.string()) for c in carry),
    ]
    schema = pa.schema(fields)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for i in range(batch.num_rows):
                data, ends, ids = _opened(batch, i)
                gone = np.zeros(len(data) + 1, np.int32)
                got = batch.column("bits")[i].as_py()
                if got:
                    c = _chosen(data, ends, ids, batch.column("marks")[i].as_py(), buckets)
                    bits = np.concatenate([np.frombuffer(unpack.decompress(b["bits"]), "<u8") for b in got])
                    bits = np.where(ids[c.doc] > c.lowest[c.string], np.uint64((1 << 64) - 1), bits[c.string])
                    hit = np.flatnonzero(bits)
                    start, count, bits = c.start[hit], c.count[hit], bits[hit]
                    shift = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                    window = (np.repeat(start, count) + shift)[np.repeat(bits, count) >> shift.astype(np.uint64) & np.uint64(1) == 1]
                    np.add.at(gone, window, 1)
                    np.add.at(gone, window + WINDOW, -1)
                    np.cumsum(gone, out=gone)
                rows = ([], [], [], [])
                raw = np.frombuffer(data, np.uint8)
                for a, b, doc_id in zip([0, *ends[:-1].tolist()], ends.tolist(), ids.tolist()):
                    out = gone[a:b] > 0
                    spans = []
                    if out.any():
                        turn = np.flatnonzero(np.diff(np.r_[0, out.view(np.int8), 0]))
                        spans = [{"start": x, "end": y} for x, y in turn.reshape(-1, 2).tolist()]
                    kept = raw[a:b][~out].tobytes() if spans else data[a:b]
                    row = (None if doc_id == _LAST else doc_id, b - a, spans, kept.decode("utf-8", "ignore") if as_text else kept)
                    for col, x in zip(rows, row):
                        col.append(x)
                more = [batch.column(c)[i].as_py() for c in carry]
                yield pa.record_batch([pa.array(x, f.type) for x, f in zip([*rows, *more], schema)], schema=schema)

    kind = "string" if as_text else "binary"
    text = f"doc_id long, n_bytes long, spans array<struct<start: long, end: long>>, kept {kind}" + "".join(f", `{c}` string" for c in carry)
    return blocks.join(found, "block", "left").mapInArrow(cut, text)


def digests(out: DataFrame) -> DataFrame:
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return out.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


def without_repeats(docs: DataFrame) -> DataFrame:
    """The documents without repeated passages. A character that a cut goes through is dropped."""
    out = deduplicated(docs.select(*DOCUMENT_COLUMNS), ["lang", "source"], as_text=True)
    return out.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("long").alias("n_chars"))
