"""Byte-pair encoding with a public vocabulary, and decoding.

White space ends every piece that merges can reach, so a text is the sequence of
its words and each distinct word is encoded once in a worker. A long word is not
handed over whole: it is encoded as a tree of halves.
"""
from __future__ import annotations

import functools
import heapq
import json
import os
from array import array
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigspark.llm.common import DOCUMENT_COLUMNS, as_bytes

#: Words of more bytes are encoded as a tree.
UNSPLIT = 2048
#: Symbols of a leaf of the tree.
LEAF = 512
#: Distinct words that a worker remembers.
REMEMBERED = 300_000
#: Documents whose tokens are sent on together.
ROWS = 256


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Merges(NamedTuple):
    rank: dict  # pair of symbols -> order
    ids: dict  # symbol -> number

    def apply(self, symbols: list[str]) -> list[str]:
        """Lowest rank first, leftmost among equals."""
        text, after, before = list(symbols), list(range(1, len(symbols) + 1)), list(range(-1, len(symbols) - 1))
        heap = [(r, i, text[i], text[i + 1]) for i in range(len(text) - 1) if (r := self.rank.get((text[i], text[i + 1]))) is not None]
        heapq.heapify(heap)

        def offer(i, j):
            if i >= 0 and j < len(text) and (r := self.rank.get((text[i], text[j]))) is not None:
                heapq.heappush(heap, (r, i, text[i], text[j]))

        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            if text[i] != left or j >= len(text) or text[j] != right:
                continue  # one of the two has been merged meanwhile
            text[i], text[j] = left + right, None
            after[i] = after[j]
            if after[j] < len(text):
                before[after[j]] = i
            offer(before[i], i)
            offer(i, after[i])
        return [t for t in text if t is not None]

    def split(self, token: str) -> list[str]:
        """The symbols of a token."""
        end = token.endswith("</w>") and len(token) > 4
        chars = list(token[:-4] if end else token)
        if end:
            chars[-1] += "</w>"
        return chars


def joined(merges: Merges, left: list[str], right: list[str]) -> list[str]:
    """Tokens of the text of both sides, from the tokens of each.

    A window around the joint is encoded anew. It grows until its first token is
    the one that the left side has there and its last the one of the right side.
    Then all neighbours in the result stand together in a correct encoding, and
    such a sequence is the encoding of the whole.
    """
    k = 2
    while True:
        a, b = min(k, len(left)), min(k, len(right))
        window = merges.apply([s for t in left[len(left) - a :] + right[:b] for s in merges.split(t)])
        if (a == len(left) or window[0] == left[len(left) - a]) and (b == len(right) or window[-1] == right[b - 1]):
            return left[: len(left) - a] + window + right[b:]
        k *= 2


def tree(merges: Merges, symbols: list[str], leaf: int = LEAF) -> list[str]:
    """Encoding of a long piece: leaves first, then neighbours joined level by level."""
    level = [merges.apply(symbols[i : i + leaf]) for i in range(0, len(symbols), leaf)]
    while len(level) > 1:
        level = [joined(merges, *level[i : i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0] if level else []


class Codec:
    """The vocabulary in a worker. Tokens of a word are kept as the bytes of 32-bit numbers."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.path = path
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.known: dict[bytes, bytes] = {}

    @functools.cached_property
    def merges(self) -> Merges:
        """Only long words need them."""
        with open(self.path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        return Merges({tuple(p): i for i, p in enumerate(pairs)}, model["vocab"])

    def long_word(self, word: str) -> list[int]:
        parts = [word]
        for s in self.special:
            parts = [x for p in parts for x in ([p] if p in self.special else _kept_split(p, s))]
        out = []
        for part in parts:
            if part in self.special:
                out.append(self.special[part])
                continue
            text = self.tokenizer.normalizer.normalize_str(part)
            for piece, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(text):
                out += [self.merges.ids[t] for t in tree(self.merges, [*piece[:-1], piece[-1] + "</w>"])]
        return out

    def encode(self, text: bytes) -> bytes:
        words = text.split()  # at ASCII white space only
        missing = [w for w in dict.fromkeys(words) if w not in self.known]
        if len(self.known) + len(missing) > REMEMBERED:
            self.known.clear()
            missing = list(dict.fromkeys(words))
        long = [w for w in missing if len(w) > UNSPLIT]
        for s in range(0, len(missing), 4096):
            short = [w for w in missing[s : s + 4096] if len(w) <= UNSPLIT]
            for w, e in zip(short, self.tokenizer.encode_batch_fast([w.decode() for w in short], add_special_tokens=False)):
                self.known[w] = array("i", e.ids).tobytes()
        for w in long:
            self.known[w] = array("i", self.long_word(w.decode())).tobytes()
        out = b"".join([self.known[w] for w in words])
        for w in long:
            del self.known[w]
        return out


def _kept_split(text: str, mark: str) -> list[str]:
    out = []
    for part in text.split(mark):
        out += [part, mark]
    return [p for p in out[:-1] if p]


@functools.lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


@functools.lru_cache(maxsize=2)
def names(path: str) -> np.ndarray:
    """Token of each number."""
    with open(path, encoding="utf-8") as f:
        stored = json.load(f)
    number = {**stored["model"]["vocab"], **{t["content"]: t["id"] for t in stored["added_tokens"]}}
    out = np.full(max(number.values()) + 1, "", object)
    for token, i in number.items():
        out[i] = token
    return out


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Column ``ids``: tokens of every whole text.

    Needs ``doc_id`` and ``text``. Null and empty texts, and texts of white
    space, have no tokens. Repeated rows are encoded each.
    """
    path = path or default_vocabulary()
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for whole in batches:
            for s in range(0, whole.num_rows, ROWS):
                batch = whole.slice(s, ROWS)
                tokens = [c.encode(text) for text in as_bytes(batch, "text")]
                offsets = np.cumsum([0, *(len(t) // 4 for t in tokens)]).astype(np.int32)
                flat = pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, pa.py_buffer(b"".join(tokens))])
                yield pa.record_batch([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets), flat)], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """Adds ``decoded``, the text of ``ids``; a null list gives an empty text."""
    path = path or default_vocabulary()
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = names(path)
        for whole in batches:
            for s in range(0, whole.num_rows, ROWS):
                batch = whole.slice(s, ROWS)
                # This vocabulary has no decoder of its own: tokens stand with blanks between.
                texts = [" ".join(token[ids.values.to_numpy()].tolist()) if ids.is_valid else "" for ids in batch.column("ids")]
                yield pa.record_batch([batch.column("doc_id"), batch.column("ids"), pa.array(texts, pa.string())], schema=schema)

    return encoded.select("doc_id", "ids").mapInArrow(work, "doc_id long, ids array<int>, decoded string")


def digests(decoded: DataFrame) -> DataFrame:
    ids: Column = F.coalesce(F.array_join(F.col("ids").cast("array<string>"), " "), F.lit(""))
    return decoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def encode_documents(docs: DataFrame) -> DataFrame:
    """The last stage of a pipeline: tokens of each document with a check of its decoding."""
    rows = docs.select(*DOCUMENT_COLUMNS)
    return digests(decode(encode(rows)))
