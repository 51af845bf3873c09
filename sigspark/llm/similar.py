"""Near copies by SimHash fingerprints and an exact check; a join of word shingles brings the pairs that fingerprints lose.

The similarity of two texts is the number of shingles in both over the number
in either. Sets whose fingerprints differ in few bits are held against each
other first. In any order of all shingles, two sets of a similarity of 0.8 share
one among their first fifth; so documents that are still apart meet at those
shingles only, and whole sets decide. Frequent shingles come last in the order:
few documents meet at one. No pair of a similarity of 0.8 or more is lost.
"""
from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigspark.functions.session import drop_table
from sigspark.llm.common import as_bytes, stored
from sigspark.llm.simhash import components, fold, hashes, links

SHINGLE = 5
#: Shingles are counted in one of so many texts. The order they get changes the work, never the result.
SAMPLED = 16
#: So many frequent shingles have a place of their own in the order; the others go by their hash.
FREQUENT = 200_000
#: Rounds before components that are still apart are tested: items before it in a random order that an item is held against
#: at a shingle, and how many of them, those that share most of its first shingles, are looked at.
ROUNDS = ((1, 2), (12, 6))
#: Items of a component that stand in one row when two components are held against each other, on average.
MEMBERS = 256
#: Buckets of a sketch, a byte each.
BUCKETS = 512
#: Texts whose sets a worker holds at once.
ROWS = 256


def alike(common: Column, a: Column, b: Column) -> Column:
    """A similarity of 0.8 or more of sets of sizes a and b, in whole numbers: common / (a + b - common) >= 4 / 5."""
    return common * 9 >= (a + b) * 4


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows, ROWS at a time."""
    for batch in batches:
        for s in range(0, batch.num_rows, ROWS):
            yield batch.slice(s, ROWS)


def _sets(batch: pa.RecordBatch, shingle: int) -> Iterator[tuple[np.ndarray, int]]:
    """Distinct shingle hashes of each text, and their digest as a number."""
    for text in as_bytes(batch, "text"):
        s = np.unique(hashes(text, shingle))
        yield s, int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def sketch(s: np.ndarray) -> bytes:
    """Shingles of a set by bucket, 255 for that and more."""
    return np.minimum(np.bincount((s & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS), 255).astype(np.uint8).tobytes()


def most_common(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Upper bound on the shingles that two sets have in common, from rows of sketches; a full bucket may hold any number."""
    low = np.minimum(one, two)
    return np.where((low == 255).any(axis=1), np.iinfo(np.int64).max // 16, low.sum(axis=1, dtype=np.int64))


def frequent_shingles(docs: DataFrame, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that three or more sampled texts have, sorted, with their counts; at most FREQUENT."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            parts = [s for s, _ in _sets(batch, shingle)]
            yield pa.record_batch([pa.array(np.concatenate(parts).view(np.int64) if parts else [], pa.int64())], names=["token"])

    some = docs.select("text").filter(F.pmod(F.xxhash64("text"), F.lit(SAMPLED)) == 0).distinct()
    counts = some.mapInArrow(work, "token long").groupBy("token").agg(F.count(F.lit(1)).alias("n")).filter("n > 2")
    rows = counts.orderBy(F.desc("n"), "token").limit(FREQUENT).toArrow()
    token, n = rows["token"].to_numpy().view(np.uint64), rows["n"].to_numpy()
    order = np.argsort(token)
    return token[order], n[order]


def first_shingles(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, text_hash, item, n, prefix, sketch, fp): size of the set of every text, its first shingles in the common order, its sketch and its fingerprint.

    Texts of the same set are one item.
    """
    shared = docs.sparkSession.sparkContext.broadcast(frequent_shingles(docs, shingle))  # at most FREQUENT
    schema = pa.schema(
        [(c, pa.int64()) for c in ("doc_id", "text_hash", "item")] + [("n", pa.int32()), ("prefix", pa.list_(pa.int64())), ("sketch", pa.binary()), ("fp", pa.int64())]
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, often = shared.value
        for batch in _pieces(batches):
            rows, sets = [], list(_sets(batch, shingle))
            marks = fold([s for s, _ in sets], 1)[:, 0].view(np.int64).tolist()
            for (s, item), mark in zip(sets, marks):
                place = np.searchsorted(known, s)
                count = np.zeros(len(s), np.int64)
                if len(known):
                    place[place == len(known)] = 0
                    same = known[place] == s
                    count[same] = often[place[same]]
                first = len(s) - (4 * len(s) + 4) // 5 + 1 if len(s) else 0
                rows.append((item, len(s), s[np.argsort(count, kind="stable")[:first]].view(np.int64), sketch(s), mark))
            yield pa.record_batch(
                [batch.column("doc_id"), batch.column("text_hash"), *(pa.array([r[k] for r in rows], f.type) for k, f in enumerate(list(schema)[2:]))],
                schema=schema,
            )

    return _keyed(docs).mapInArrow(work, "doc_id long, text_hash long, item long, n int, prefix array<long>, sketch binary, fp long")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")


def whole_sets(docs: DataFrame, wanted: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(item, tokens) for the wanted (text_hash, item): the set of a text with that hash."""
    schema = pa.schema([("item", pa.int64()), ("tokens", pa.list_(pa.int64()))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            # A hash may be that of other texts too.
            got = [(i, s.view(np.int64)) for i, (s, item) in zip(batch.column("item").to_pylist(), _sets(batch, shingle)) if i == item]
            yield pa.record_batch([pa.array([x[k] for x in got], f.type) for k, f in enumerate(schema)], schema=schema)

    texts = _keyed(docs).select("text_hash", "text").join(wanted, "text_hash").dropDuplicates(["text_hash", "item"]).select("item", "text")
    return texts.mapInArrow(work, "item long, tokens array<long>").dropDuplicates(["item"])


def fingerprint_groups(firsts: DataFrame) -> DataFrame:
    """(item, fp, near): every item with its fingerprint and the group that chains of close fingerprints join it to.

    Fingerprints are close by ``simhash.links``; equal ones meet as one.
    """
    rows = stored(firsts.select("item", "fp").distinct(), "fingerprints")
    keys = stored(rows.select("fp").distinct().select(F.array("fp").alias("fps"), F.col("fp").alias("item")), "keys")
    near = components(links(keys))
    return rows.join(near.select(F.col("item").alias("fp"), "component"), "fp", "left").select("item", "fp", F.coalesce("component", "fp").alias("near"))


def neighbours(groups: DataFrame) -> DataFrame:
    """(a, b): items of a group that are next to each other in the order of their fingerprints.

    Rows are dealt out by ranges of the whole order, so a large group is in many
    tasks; its chain is open where a range ends.
    """
    order = ["near", "fp", "item"]
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near, item = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            near, item = (np.append(x[-1:], batch.column(c).to_numpy()) for x, c in ((near, "near"), (item, "item")))
            same = np.flatnonzero(near[1:] == near[:-1])
            yield pa.record_batch([pa.array(item[same]), pa.array(item[same + 1])], schema=schema)

    return groups.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(work, "a long, b long")


def possible(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """Pairs (a, b, …) whose sketches allow a similarity of 0.8; none of that similarity is lost."""
    columns = pairs.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 1024):
                some = batch.slice(s, 1024)
                one, two = (np.frombuffer(b"".join(some.column(c).to_pylist()), np.uint8).reshape(-1, BUCKETS) for c in ("sa", "sb"))
                sizes = some.column("na").to_numpy().astype(np.int64) + some.column("nb").to_numpy()
                yield some.filter(pa.array(most_common(one, two) * 9 >= sizes * 4)).select(columns)

    both = pairs
    for c in "ab":
        both = both.join(sketches.select(F.col("item").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}")), c)
    return both.select(*columns, "na", "nb", "sa", "sb").mapInArrow(work, pairs.schema)


def across(at: DataFrame, sketches: DataFrame) -> DataFrame:
    """(a, b, p, q): items of two components that share a shingle, where sizes and sketches allow a similarity of 0.8.

    Components meet at their shingles, not items. The items of the smaller one
    then go to the larger one's blocks and are tested against whole blocks there;
    only pairs that may be similar are rows.
    """
    # The most that an item of a component can have in common from this shingle on, and the smallest one.
    here = at.groupBy("token", "component").agg(F.max(F.col("n") - F.col("pos")).alias("left"), F.min("n").alias("n"))
    side = lambda c: here.select("token", *(F.col(x).alias(f"{x}_{c}") for x in ("component", "left", "n")))
    met = side("p").join(side("q"), "token").filter(F.col("component_p") < F.col("component_q"))
    met = met.filter(alike(F.least("left_p", "left_q"), F.col("n_p"), F.col("n_q")))
    met = met.select(F.col("component_p").alias("p"), F.col("component_q").alias("q")).distinct()
    members = at.select("component", "item").distinct()
    sizes = stored(members.groupBy("component").agg(F.count(F.lit(1)).alias("size")), "sizes")
    for c in "pq":
        met = met.join(sizes.select(F.col("component").alias(c), F.col("size").alias(f"_{c}")), c)
    sides = [F.struct(F.col(f"_{c}").alias("size"), F.col(c).alias("component")) for c in "pq"]
    met = met.select(F.least(*sides).alias("s"), F.greatest(*sides).alias("l"))
    met = met.select(F.col("s.component").alias("small"), F.col("l.component").alias("large"), F.col("l.size").alias("many"))
    blocks = F.ceil(F.col("many") / MEMBERS)
    met = met.select("small", "large", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("block"))
    held = members.join(sketches, "item").select("component", F.struct("item", "n", "sketch").alias("own"))
    block = F.pmod(F.xxhash64("own.item"), F.ceil(F.col("size") / MEMBERS)).alias("block")
    whole = held.join(sizes, "component").groupBy(F.col("component").alias("large"), block).agg(F.collect_list("own").alias("there"))
    asked = met.join(held.select(F.col("component").alias("small"), "own"), "small").join(whole, ["large", "block"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                own, there = batch.column("own")[r], batch.column("there")[r].values
                n = there.field("n").to_numpy().astype(np.int64)
                two = np.frombuffer(b"".join(there.field("sketch").to_pylist()), np.uint8).reshape(-1, BUCKETS)
                one = np.frombuffer(own["sketch"].as_py(), np.uint8)[None]
                common = np.minimum(most_common(one, two), np.minimum(n, own["n"].as_py()))
                hit = np.flatnonzero(common * 9 >= (n + own["n"].as_py()) * 4)
                many = len(hit)
                item, small, large = (batch.column(c)[r].as_py() if c else own["item"].as_py() for c in ("", "small", "large"))
                yield pa.record_batch([pa.array([item] * many, pa.int64()), there.field("item").take(pa.array(hit)), pa.array([small] * many, pa.int64()), pa.array([large] * many, pa.int64())], names=list("abpq"))

    return asked.select("small", "large", "own", "there").mapInArrow(work, "a long, b long, p long, q long")


class _Sets:
    """Whole sets of the items that some pair asked for, each made from its text once."""

    def __init__(self, docs: DataFrame, names: DataFrame, shingle: int):
        self.docs, self.names, self.shingle, self.parts = docs, names, shingle, []

    def of(self, pairs: DataFrame) -> DataFrame:
        wanted = pairs.select(F.col("a").alias("item")).union(pairs.select("b")).distinct()
        for part in self.parts:
            wanted = wanted.join(part.select("item"), "item", "left_anti")
        self.parts.append(stored(whole_sets(self.docs, self.names.join(wanted, "item"), self.shingle), "sets"))
        return functools.reduce(DataFrame.union, self.parts)

    def drop(self) -> None:
        for part in self.parts:
            drop_table(part)


def _replaced(new: DataFrame, old: DataFrame | None, stem: str) -> DataFrame:
    new = stored(new, stem)
    if old is not None:
        drop_table(old)
    return new


def similar_links(docs: DataFrame, firsts: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(item, component) over all pairs of a similarity of 0.8 or more; items without such a pair are absent.

    First items with close fingerprints are held against each other. Then items
    meet at their first shingles. In the first round each is held against
    its next one in a random order, so that a large group of copies becomes few
    components by a chain of a few links for each item; in the next ones those still
    apart are held against some more. Then components that share a shingle are held
    against each other, item by block of items, and every pair of theirs is tested. Sizes,
    places and sketches sort out pairs before sets are looked at, and whole sets
    judge every link. Tables of a round are deleted when the next is written.
    """
    items = firsts.groupBy("item").agg(F.first("n").alias("n"), F.first("prefix").alias("prefix"))
    places = items.select("item", "n", F.posexplode("prefix").alias("pos", "token"))
    here = Window.partitionBy("token").orderBy("item")
    places = places.select("token", "item", "n", "pos", F.lag("item").over(here).alias("before"), F.lead("item").over(here).alias("after"))
    places = stored(places.filter("before IS NOT NULL OR after IS NOT NULL").drop("before", "after"), "shingles")
    meeting = places.select("item").distinct()
    sketches = stored(firsts.select("item", "n", "sketch").join(meeting, "item", "left_semi").dropDuplicates(["item"]), "sketches")
    names = firsts.select("item", "text_hash").groupBy("item").agg(F.min("text_hash").alias("text_hash"))
    sets = _Sets(docs, names, shingle)

    def may_be(a: str, b: str) -> Column:
        """At the first shingle that two sets share, all that is common is here or behind."""
        left = F.least(*(F.col(f"{x}.n") - F.col(f"{x}.pos") for x in (a, b)))
        return alike(left, F.col(f"{a}.n"), F.col(f"{b}.n"))

    def linked(pairs: DataFrame) -> DataFrame | None:
        pairs = stored(pairs, "pairs")
        if not pairs.head(1):
            return None
        tokens = sets.of(pairs)
        both = pairs.join(tokens.select(F.col("item").alias("a"), F.col("tokens").alias("s")), "a")
        both = both.join(tokens.select(F.col("item").alias("b"), F.col("tokens").alias("t")), "b")
        out = stored(both.filter(alike(F.size(F.array_intersect("s", "t")), F.size("s"), F.size("t"))).select("p", "q").distinct(), "found")
        drop_table(pairs)
        return out if out.head(1) else None

    at, found = stored(places.withColumn("component", F.col("item")), "apart"), None
    drop_table(places)
    for turn in range(-1, len(ROUNDS) + 1):
        if turn < 0:
            met = neighbours(fingerprint_groups(firsts)).select("a", "b", F.col("a").alias("p"), F.col("b").alias("q"))
            more = linked(possible(met, sketches))
        elif turn < len(ROUNDS):
            one = F.struct("item", "n", "pos", "component")
            earlier, partners = ROUNDS[turn]
            order = Window.partitionBy("token").orderBy(F.xxhash64(F.lit(turn), "item"), "item").rowsBetween(-earlier, -1)
            met = at.select(one.alias("x"), F.collect_list(one).over(order).alias("others"))
            met = met.select("x", F.explode("others").alias("y")).filter("x.component <> y.component")
            low, high = (f(F.struct("x.item", "x.component"), F.struct("y.item", "y.component")) for f in (F.least, F.greatest))
            met = met.filter(may_be("x", "y")).select(low.alias("l"), high.alias("h")).groupBy("l", "h").agg(F.count(F.lit(1)).alias("votes"))
            met = met.select(F.col("l.item").alias("a"), F.col("h.item").alias("b"), F.col("l.component").alias("p"), F.col("h.component").alias("q"), "votes")
            nth = lambda c: F.row_number().over(Window.partitionBy(c).orderBy(F.desc("votes"), "a", "b"))
            met = met.withColumn("_a", nth("a")).withColumn("_b", nth("b")).filter((F.col("_a") <= partners) | (F.col("_b") <= partners))
            more = linked(possible(met.select("a", "b", "p", "q"), sketches))
        else:
            more = linked(across(at, sketches))
        if more is None:
            continue
        joined = components(more.select(F.col("p").alias("a"), F.col("q").alias("b")))
        further = stored(joined.select(F.col("item").alias("old"), F.col("component").alias("new")), f"further{turn + 1}")
        drop_table(joined)
        drop_table(more)
        if found is None:
            found = stored(further.select(F.col("old").alias("item"), F.col("new").alias("component")), "joined")
        else:
            single = further.select(F.col("old").alias("item"), F.col("old").alias("component")).join(found, "item", "left_anti")
            every = found.union(single)
            now = every.join(further, every["component"] == further["old"], "left").select("item", F.coalesce("new", "component").alias("component"))
            found = _replaced(now, found, "joined")
        if turn < len(ROUNDS):
            now = at.join(further, at["component"] == further["old"], "left").withColumn("component", F.coalesce("new", "component"))
            whole = Window.partitionBy("token")
            ends = now.select("token", "item", "n", "pos", "component", F.min("component").over(whole).alias("low"), F.max("component").over(whole).alias("high"))
            at = _replaced(ends.filter("low <> high").drop("low", "high"), at, "apart")
        drop_table(further)
    sets.drop()
    for table in (at, sketches):
        drop_table(table)
    return docs.sparkSession.createDataFrame([], "item long, component long") if found is None else found


def grouped(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, text_hash, component_id, least_hash): the smallest doc_id that chains of similar pairs join a row to, and the text it has.

    Null doc_ids are never the smallest one while there is another. Among rows
    of that doc_id the smallest hash of a text counts. Rows equal in doc_id and
    text come out each, with the same values.
    """
    firsts = stored(first_shingles(docs, shingle), "firsts")
    found = similar_links(docs, firsts, shingle)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    items = firsts.groupBy("item").agg(F.min(order).alias("least")).join(found, "item", "left")
    items = stored(items.select("item", "least", F.coalesce("component", "item").alias("component")), "items")
    lowest = items.groupBy("component").agg(F.min("least").alias("least"))
    named = items.drop("least").join(lowest, "component").select("item", "least")
    out = firsts.select("doc_id", "text_hash", "item").join(named, "item")
    return out.select("doc_id", "text_hash", F.col("least.doc_id").alias("component_id"), F.col("least.text_hash").alias("least_hash"))


def near_copies(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, component_id): the smallest doc_id that chains of similar pairs join a document to, itself included.

    Needs ``doc_id`` and ``text``; other columns are not read. Null and empty
    texts are copies of each other. Rows with a null doc_id are kept and count as
    the largest id; repeated rows, and rows of one doc_id with other texts, come
    out each. An empty table gives no rows.
    """
    return grouped(docs, shingle).select("doc_id", "component_id")
