"""Language identification by bit-sliced Bloom filters over byte n-grams.

One filter for each language, laid side by side: a slot holds one bit for every
language, so a look-up returns the languages that contain an n-gram at once.
"""
from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigspark.llm.common import record

GRAM = 4
HASHES = 4
#: Slots for each n-gram of the fullest language, before rounding up to a power of two.
SLOTS_PER_GRAM = 8
#: A language contains an n-gram that makes up this share of its own n-grams; so it contains 1/LEAST_SHARE at most.
LEAST_SHARE = 2e-6
#: ... and whose share is at least this part of the share in the language where it is most common.
NEAR_BEST = 0.25
UNKNOWN = "und"
_FLUSH = 2_000_000
_NO_LETTER = re.compile(r"[\W\d_]+")
# Fixed value of the mixing function: odd multipliers, one for each hash.
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype=np.uint64)


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 3 == 1


def folded(text: str | None) -> bytes:
    """Lower-cased letters, one blank for all else, blanks around; empty without a letter."""
    words = _NO_LETTER.sub(" ", (text or "").lower()).strip()
    if not any(map(str.isalpha, words)):
        return b""
    return b"  " + words.encode("utf-8", "ignore") + b" "


def grams(data: bytes) -> np.ndarray:
    """All n-grams of the bytes as numbers."""
    if len(data) < GRAM:
        return np.empty(0, np.uint32)
    return np.ndarray((len(data) - GRAM + 1,), "<u4", data, strides=(1,)).copy()


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, place = np.unique(np.concatenate(keys), return_inverse=True)
    return key, np.bincount(place, np.concatenate(counts), len(key)).astype(np.int64)


def gram_counts(docs: DataFrame) -> DataFrame:
    """(lang, gram, n) of ``text`` by ``lang``, all rows; counted inside a task before the shuffle."""
    schema = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])

    def emit(held):
        for lang, (keys, counts) in held.items():
            key, n = _merged(keys, counts)
            yield pa.record_batch([pa.array([lang] * len(key), pa.string()), pa.array(key.astype(np.int64)), pa.array(n)], schema=schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            texts: dict = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                texts.setdefault(lang, []).append(folded(text))
            for lang, parts in texts.items():
                found = [g for p in parts if len(g := grams(p))]
                if found:
                    key, n = np.unique(np.concatenate(found), return_counts=True)
                    keys, counts = held.setdefault(lang, ([], []))
                    keys.append(key)
                    counts.append(n)
                    if sum(map(len, keys)) > _FLUSH:
                        key, n = _merged(keys, counts)
                        held[lang] = ([key], [n])
            if sum(len(k) for keys, _ in held.values() for k in keys) > 4 * _FLUSH:
                yield from emit(held)
                held = {}
        yield from emit(held)

    return docs.select("lang", "text").mapInArrow(work, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Filters(NamedTuple):
    languages: list[str]
    slots: np.ndarray  # uint64 [words, slots]; bit i % 64 of word i // 64 is language i
    false_positive: np.ndarray

    def masks(self, keys: np.ndarray) -> list[np.ndarray]:
        out = None
        for m in _MULTIPLIERS[:HASHES]:
            with np.errstate(over="ignore"):
                place = (keys.astype(np.uint64) + np.uint64(1)) * m
            place = (place ^ place >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - (self.slots.shape[1] - 1).bit_length())
            got = [word[place] for word in self.slots]
            out = got if out is None else [a & b for a, b in zip(out, got)]
        return out


def build(found: list[tuple[str, np.ndarray]]) -> Filters:
    """Filters of the languages' n-grams."""
    size = 1 << max(10, int(np.ceil(np.log2(SLOTS_PER_GRAM * max([1, *(len(g) for _, g in found)])))))
    words = max(1, -(-len(found) // 64))
    f = Filters([lang for lang, _ in found], np.zeros((words, size), np.uint64), np.zeros(len(found)))
    for i, (_, keys) in enumerate(found):
        bit = np.uint64(1 << i % 64)
        for m in _MULTIPLIERS[:HASHES]:
            with np.errstate(over="ignore"):
                place = (keys.astype(np.uint64) + np.uint64(1)) * m
            place = (place ^ place >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - (size - 1).bit_length())
            f.slots[i // 64][place] |= bit
        fill = np.count_nonzero(f.slots[i // 64] & bit) / size
        f.false_positive[i] = fill**HASHES
    return f


def learn(docs: DataFrame) -> Filters:
    """Filters from ``text`` and ``lang`` of the given rows; rows without a language are left out.

    The n-grams that reach the driver are those with the least share, at most
    1/LEAST_SHARE for each language however large the table.
    """
    counts = gram_counts(docs.filter("lang IS NOT NULL"))
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    shares = counts.join(F.broadcast(totals), "lang").withColumn("share", F.col("n") / F.col("total")).filter(F.col("share") >= LEAST_SHARE)
    best = shares.groupBy("gram").agg(F.max("share").alias("best"))
    kept = shares.join(best, "gram").filter(F.col("share") >= F.col("best") * NEAR_BEST).select("lang", "gram").toArrow().to_pandas()
    return build([(lang, np.sort(g["gram"].to_numpy())) for lang, g in sorted(kept.groupby("lang"))])


def predict(docs: DataFrame, filters: Filters) -> DataFrame:
    """``lang_pred`` and ``score``, the corrected share of n-grams that the language contains.

    Needs ``doc_id`` and ``text`` and reads nothing else. Null, empty and
    letterless texts are ``und`` with score 0, and so is everything if no
    language was learned. Ties go to the language first in order.
    """
    shared = docs.sparkSession.sparkContext.broadcast(filters)  # bounded by the learned n-grams
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def votes(f: Filters, parts: list[np.ndarray]) -> np.ndarray:
        """Share of each language for each document."""
        sizes = np.array([len(p) for p in parts])
        starts = np.cumsum(sizes) - sizes
        masks = f.masks(np.concatenate(parts))
        out = np.empty((len(parts), len(f.languages)))
        for i in range(len(f.languages)):
            bits = (masks[i // 64] >> np.uint64(i % 64) & np.uint64(1)).astype(np.int64)
            share = np.add.reduceat(bits, starts) / sizes
            out[:, i] = (share - f.false_positive[i]) / (1 - f.false_positive[i]) if f.false_positive[i] < 1 else 0
        return np.clip(out, 0, 1)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = shared.value
        for batch in batches:
            ids, n = batch.column("doc_id"), batch.num_rows
            langs, scores = np.full(n, UNKNOWN, object), np.zeros(n)
            if f.languages:
                rows, parts, held = [], [], 0
                for i in range(n + 1):
                    # Documents are voted on together as long as their n-grams fit; a long one alone.
                    if parts and (i == n or held > _FLUSH):
                        v = votes(f, parts)
                        top = v.argmax(axis=1)
                        langs[rows], scores[rows] = np.array(f.languages, object)[top], v[np.arange(len(top)), top]
                        rows, parts, held = [], [], 0
                    if i < n and len(g := grams(folded(batch.column("text")[i].as_py()))):
                        rows.append(i)
                        parts.append(g)
                        held += len(g)
            yield pa.record_batch([ids, pa.array(langs.tolist(), pa.string()), pa.array(scores)], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, "doc_id long, lang_pred string, score double")
