"""SimHash near-duplicates: fingerprints, BK-trees over shards, and components.

Two fingerprints within a radius agree in one of more blocks than the radius
has bits. So each fingerprint goes to the shards (block, bits of the block); a
shard's tree holds its fingerprints and meets only the queries of its shard.
"""
from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigspark.functions.session import drop_table
from sigspark.llm.common import DOCUMENT_COLUMNS, as_bytes, stored

SEED = 42
BITS = 64
RADIUS = 3
#: Blocks into which a fingerprint is cut; more than RADIUS, so that close pairs share one.
BLOCKS = 4
#: Distinct fingerprints of a shard above which it is cut again by the bits outside its block.
LARGE_SHARD = 20_000
#: Pairs of query and node looked at in one step.
STEP = 1 << 20
#: Shingles turned into bits at once.
SHINGLES = 1 << 18


def hashes(text: bytes, shingle: int) -> np.ndarray:
    """XXH64 of the word shingles of a text, in order, repeats included."""
    words = text.lower().split()  # bytes: A-Z only, ASCII white space only
    if not words:
        return np.empty(0, np.uint64)
    line = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(line, SEED)], np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(words) - shingle + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist())], np.uint64)


def _remix(h: np.ndarray, n: int) -> np.ndarray:
    """The n-th further hash of each hash; the 0-th is the hash itself."""
    if not n:
        return h
    with np.errstate(over="ignore"):
        x = h + np.uint64(n) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def fold(parts: list[np.ndarray], count: int) -> np.ndarray:
    """Fingerprints [document, count] of hash lists: bits that over half of a document's hashes have."""
    out = np.zeros((len(parts), count), np.uint64)
    at = 0
    while at < len(parts):
        end, held = at, 0
        while end < len(parts) and (end == at or held + len(parts[end]) <= SHINGLES):
            held += len(parts[end])
            end += 1
        some = [i for i in range(at, end) if len(parts[i])]
        if some:
            sizes = np.array([len(parts[i]) for i in some])
            h = np.concatenate([parts[i] for i in some])
            for k in range(count):
                ones = np.zeros((len(some), BITS), np.int64)
                hk = _remix(h, k)
                if len(some) == 1:  # a long text, in slices
                    for s in range(0, len(hk), SHINGLES):
                        ones[0] += np.unpackbits(hk[s : s + SHINGLES].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
                else:
                    bits = np.unpackbits(hk.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                    ends = np.cumsum(sizes)
                    for i, (x, y) in enumerate(zip((ends - sizes).tolist(), ends.tolist())):  # several times as fast as one reduceat
                        bits[x:y].sum(axis=0, dtype=np.int64, out=ones[i])
                major = (ones * 2 > sizes[:, None]).astype(np.uint8)
                out[some, k] = np.packbits(major, axis=1, bitorder="little").view(np.uint64)[:, 0]
        at = end
    return out


def fingerprints(docs: DataFrame, shingle: int = 3, count: int = 1) -> DataFrame:
    """(doc_id, fps): ``count`` fingerprints of 64 bits for every whole text; without words all are zero.

    A text of fewer words than a shingle is one shingle.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("fps", pa.list_(pa.int64()))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_bytes(batch, "text")
            rows = []
            for s in range(0, len(texts), 256):
                rows.append(fold([hashes(t, shingle) for t in texts[s : s + 256]], count))
            got = np.concatenate(rows).view(np.int64) if rows else np.empty((0, count), np.int64)
            yield pa.record_batch([batch.column("doc_id"), pa.array(list(got), pa.list_(pa.int64()))], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, "doc_id long, fps array<long>")


class Forest(NamedTuple):
    """BK-trees of many shards in flat arrays. Node i holds value i; the first value of a shard is its root."""

    parent: np.ndarray
    edge: np.ndarray  # distance to the parent, -1 at a root
    child_key: np.ndarray  # parent * 65 + edge of every node that is no root, sorted
    child: np.ndarray
    depth: np.ndarray


def plant(values: np.ndarray, shard: np.ndarray) -> Forest:
    """Trees of distinct values; rows of a shard are neighbours.

    All values go down their trees at the same time. On each level the first
    value that meets a free place becomes the node there.
    """
    n = len(values)
    parent, edge, depth = np.full(n, -1), np.full(n, -1), np.zeros(n, np.int64)
    root = np.r_[True, shard[1:] != shard[:-1]] if n else np.empty(0, bool)
    at = np.flatnonzero(root)[np.cumsum(root) - 1] if n else np.empty(0, np.int64)
    down = np.flatnonzero(~root)
    at = at[down]
    level = 0
    while len(down):
        level += 1
        d = np.bitwise_count(values[down] ^ values[at]).astype(np.int64)
        key = at * 65 + d
        order = np.argsort(key, kind="stable")
        first = np.r_[True, key[order][1:] != key[order][:-1]]
        settled = order[first]  # stable: the earliest row
        node = down[settled][np.cumsum(first) - 1]
        parent[down[settled]], edge[down[settled]], depth[down[settled]] = at[settled], d[settled], level
        target = np.empty(len(down), np.int64)
        target[order] = node
        rest = target != down
        down, at = down[rest], target[rest]
    kids = np.flatnonzero(parent >= 0)
    key = parent[kids] * 65 + edge[kids]
    order = np.argsort(key, kind="stable")
    return Forest(parent, edge, key[order], kids[order], depth)


def _united(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Smallest label reachable over the pairs, by repeated minima and jumps."""
    label = label.copy()
    while len(a):
        la, lb = label[a], label[b]
        differ = la != lb
        a, b, la, lb = a[differ], b[differ], la[differ], lb[differ]
        if not len(a):
            break
        np.minimum.at(label, la, lb)
        np.minimum.at(label, lb, la)
        while True:
            jumped = label[label]
            if np.array_equal(jumped, label):
                break
            label = jumped
    return label


def close_pairs(values: np.ndarray, shard: np.ndarray, radius: int) -> np.ndarray:
    """Label of every value: values that a chain of pairs within the radius joins inside their shard share one.

    Trees are searched from the roots: at a node with distance d to the query
    only edges from d - radius to d + radius are followed. A subtree all of whose
    nodes are joined to the query already has nothing to add and is passed by.
    """
    n = len(values)
    forest = plant(values, shard)
    label = np.arange(n)
    kids = np.flatnonzero((forest.parent >= 0) & (forest.edge <= radius))
    own, up = kids, forest.parent[kids]
    label = _united(n, own, up, label)
    root = np.r_[True, shard[1:] != shard[:-1]] if n else np.empty(0, bool)
    roots = np.flatnonzero(root)
    size = np.diff(np.r_[roots, n])
    of = np.cumsum(root) - 1
    todo = np.flatnonzero(size[of] > 1) if n else np.empty(0, np.int64)
    deepest = np.argsort(-forest.depth, kind="stable")
    deepest = deepest[forest.parent[deepest] >= 0]
    bounds = np.flatnonzero(np.r_[True, forest.depth[deepest][1:] != forest.depth[deepest][:-1]]) if len(deepest) else np.empty(0, np.int64)
    at = 0
    while at < len(todo):
        # As many queries as keep one step small, whatever the size of their shards.
        width = np.cumsum(np.minimum(size[of[todo[at : at + STEP]]], 4096))
        end = at + max(1, int(np.searchsorted(width, STEP, "right")))
        query = todo[at:end]
        low, high = label.copy(), label.copy()
        for s, e in zip(bounds, np.r_[bounds[1:], len(deepest)]):
            nodes = deepest[s:e]
            np.minimum.at(low, forest.parent[nodes], low[nodes])
            np.maximum.at(high, forest.parent[nodes], high[nodes])
        node, pairs = roots[of[query]], []
        while len(query):
            open_ = (low[node] != label[query]) | (high[node] != label[query])
            query, node = query[open_], node[open_]
            d = np.bitwise_count(values[query] ^ values[node]).astype(np.int64)
            hit = (d <= radius) & (query > node) & (label[query] != label[node])
            if hit.any():
                pairs.append((query[hit], node[hit]))
            lo = np.searchsorted(forest.child_key, node * 65 + np.maximum(d - radius, 0))
            hi = np.searchsorted(forest.child_key, node * 65 + np.minimum(d + radius, 64), "right")
            many = hi - lo
            query = np.repeat(query, many)
            node = forest.child[np.repeat(hi - np.cumsum(many), many) + np.arange(many.sum())] if len(query) else query
        if pairs:
            a, b = (np.concatenate(x) for x in zip(*pairs))
            label = _united(n, a, b, label)
        at = end
    return label


def _shards(keys: DataFrame, width: int, blocks: int) -> DataFrame:
    """(shard, item, fps): every fingerprint under each of its blocks; large shards are cut by a second block."""
    size = BITS // blocks
    lanes = []
    for k in range(width):
        fp = F.col("fps")[k]
        for b in range(blocks):
            value = F.shiftrightunsigned(fp, b * size).bitwiseAND((1 << size) - 1)
            lanes.append(F.struct(F.lit(k).alias("lane"), F.lit(b).alias("block"), value.alias("bits")))
    placed = keys.select("item", "fps", F.explode(F.array(*lanes)).alias("p")).select("item", "fps", "p.*")
    sizes = placed.groupBy("lane", "block", "bits").agg(F.count(F.lit(1)).alias("_size")).filter(F.col("_size") > LARGE_SHARD)
    # Few rows, of a size known from its files: the optimiser broadcasts it only if it is small, and then no row moves here.
    placed = placed.join(stored(sizes, "large"), ["lane", "block", "bits"], "left")
    # Inside a shard the block agrees, so the radius applies to the other bits, which are cut the same way.
    rest = []
    part = size * (blocks - 1) // blocks
    fp = F.element_at("fps", F.col("lane") + 1)
    below = fp.bitwiseAND(F.expr(f"shiftleft(1L, block * {size}) - 1"))
    above = F.when(
        F.col("block") < blocks - 1,
        F.expr(f"shiftleft(shiftrightunsigned(element_at(fps, lane + 1), (block + 1) * {size}), block * {size})"),
    ).otherwise(F.lit(0).cast("long"))
    other = below.bitwiseOR(above)
    for b in range(blocks):
        rest.append(F.struct(F.lit(b).alias("second"), F.shiftrightunsigned(other, b * part).bitwiseAND((1 << part) - 1).alias("more")))
    whole = F.array(F.struct(F.lit(-1).alias("second"), F.lit(0).cast("long").alias("more")))
    cut = F.explode(F.when(F.col("_size") > LARGE_SHARD, F.array(*rest)).otherwise(whole)).alias("c")
    return placed.select("lane", "block", "bits", "item", "fps", cut).select("lane", "block", "bits", "c.second", "c.more", "item", "fps")


def links(keys: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """(a, b): links that join the same items as all pairs within the radius in a shared shard.

    ``keys`` has one row for each distinct ``fps``, of one fingerprint, with its
    ``item``. There must be more blocks than the radius has bits; then the
    result is exact.
    """
    if blocks <= radius:
        raise ValueError(f"{blocks} blocks lose pairs within a radius of {radius}")
    spread = _shards(keys, 1, blocks)
    spread = spread.repartition("lane", "block", "bits", "second", "more").sortWithinPartitions("lane", "block", "bits", "second", "more", "item")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    names = ["lane", "block", "bits", "second", "more"]

    def joined(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(parts)
        keys_ = np.stack([rows.column(c).to_numpy() for c in names], axis=1)
        changed = np.r_[True, (keys_[1:] != keys_[:-1]).any(axis=1)]
        shard = np.cumsum(changed)
        item = rows.column("item").to_numpy()
        fps = rows.column("fps").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(item), -1)
        values = fps[np.arange(len(item)), rows.column("lane").to_numpy()]
        order = np.lexsort((values, shard))
        item, values, shard = item[order], values[order], shard[order]
        label = close_pairs(values, shard, radius)
        far = label != np.arange(len(label))
        yield pa.record_batch([pa.array(item[far]), pa.array(item[label[far]])], schema=schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole shards of the sorted rows, many small ones at a time."""
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            ks = np.stack([batch.column(c).to_numpy() for c in names], axis=1)
            last = np.flatnonzero((ks != ks[-1]).any(axis=1))
            cut = int(last[-1]) + 1 if len(last) else 0
            if not cut and held:
                end = [held[-1].column(c)[-1].as_py() for c in names]
                if [int(x) for x in ks[-1]] != end:
                    yield from joined(held)
                    held = []
            if cut:
                held.append(batch.slice(0, cut))
                yield from joined(held)
                held = []
            held.append(batch.slice(cut))
        if held:
            yield from joined(held)

    return spread.mapInArrow(work, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(item, component): an id shared by the items that chains of links join; items without a link are absent.

    In every round each item moves to the neighbour with the lowest hash of the
    round, itself included; links follow their ends, and links inside one item
    vanish. A round is joins and minima; it keeps no neighbour list. Rounds are
    written to the shared folder. The number of items with links falls by a
    constant factor in each round. Tables of a round are deleted after the next.
    """
    edges = stored(edges.filter("a <> b"), "links")
    nodes = edges.select(F.col("a").alias("item")).union(edges.select("b")).distinct()
    place = stored(nodes.select("item", F.col("item").alias("at")), "places")
    turn = 0
    while edges.head(1):
        turn += 1
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        order = lambda c: F.struct(F.xxhash64(F.lit(turn), F.col(c)).alias("h"), F.col(c).alias("id"))  # noqa: B023, E731
        best = both.groupBy("a").agg(F.min(order("b")).alias("m")).select(F.col("a").alias("n"), F.least("m", order("a"))["id"].alias("to"))
        best = stored(best, f"moves{turn}")
        closer = (
            edges.join(best.select(F.col("n").alias("a"), F.col("to").alias("p")), "a")
            .join(best.select(F.col("n").alias("b"), F.col("to").alias("q")), "b")
            .filter("p <> q").select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct()
        )
        closer, moved = stored(closer, f"links{turn}"), place.join(best, place["at"] == best["n"], "left")
        moved = stored(moved.select("item", F.coalesce("to", "at").alias("at")), f"places{turn}")
        for table in (edges, place, best):
            drop_table(table)
        edges, place = closer, moved
    drop_table(edges)
    return place.select("item", F.col("at").alias("component"))


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """(doc_id, fps, component_id): the smallest doc_id that a document is linked to, itself included.

    Needs ``doc_id`` and ``text``. Null and empty texts have the fingerprint
    zero and are linked to each other. Equal fingerprints meet as one item;
    rows with a null doc_id are kept and count as the largest id.
    Repeated rows come out each. An empty table gives no rows.
    """
    rows = stored(fingerprints(docs, shingle), "fingerprints")
    items = rows.groupBy("fps").agg(F.min("doc_id").alias("least"))
    items = stored(items.withColumn("item", F.col("fps")[0]), "items")
    found = components(links(items, radius, blocks))
    placed = items.join(found, "item", "left").select("fps", "least", F.coalesce("component", "item").alias("component"))
    lowest = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    named = placed.join(lowest, "component").select("fps", "component_id")
    return rows.join(named, "fps").select("doc_id", "fps", "component_id")


def hexadecimal(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """One document of each group of near copies, that with the smallest doc_id.

    Items whose SimHash fingerprints are close are held against each other, and
    whole sets check them (``similar``). Near copies have a similarity of
    five-word shingles of 0.8 or more; all such pairs count, also those that
    fingerprints lose. A document is a doc_id with a text: of rows with one doc_id those
    whose text is a copy go and others stay, and repeated rows stay or go
    together. A row whose doc_id is null stays. Null and empty texts are one
    group. An empty table gives an empty result; other columns than those of
    documents are left out.
    """
    from sigspark.llm import similar

    kept = F.struct(F.col("component_id").alias("doc_id"), F.col("least_hash").alias("text_hash"))
    groups = similar.grouped(docs).filter("doc_id IS NOT NULL")
    gone = groups.filter(F.struct("doc_id", "text_hash") != kept).select(F.col("doc_id").alias("_doc_id"), "text_hash").distinct()
    rows = docs.select(*DOCUMENT_COLUMNS)
    here = (F.col("doc_id").cast("long") == gone["_doc_id"]) & (F.xxhash64("text") == gone["text_hash"])
    return rows.join(gone, here, "left_anti")
