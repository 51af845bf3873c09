"""Operators against plain forms, on the smallest tables and on a table of odd rows."""
import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigspark.llm import audio, bpe, language, licenses, mixing, quality, queries, sharding, simhash, suffix, warc
from tests.llm import brute

SF = "/root/testdata/sf0.001"
PASSAGE = "a passage of well over fifty bytes that stands in several of the documents, ünïcode included"
LONG = " ".join(f"word{i * 7919 % 5003}" for i in range(40_000))
ODD = [
    (1, None, None, None), (2, "", "en", "a"), (3, " \t\n", "en", None), (4, "one", "en", "a"), (5, "one two", None, "b"),
    (6, PASSAGE, "en", "a"), (7, f"start {PASSAGE} end", "en", "b"), (8, f"{PASSAGE}{PASSAGE}", "en", "a"), (9, PASSAGE, "de", "ü"),
    (10, LONG, "en", "a"), (11, LONG + " tail", "en", "a"), (12, "x" * 5000, None, "a"), (13, "The MIT License and the Apache license", "en", "b"),
    (14, "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
         "conditions are met", "en", "b"),
    (15, "1234 -- 5678 !", "en", "b"), (16, "日本語のテキスト " * 30, "ja", "b"), (17, "line one\nline one\nline | two\n\n", "en", None),
    (None, "no number, yet a text", "en", "a"), (18, "same row", "en", "a"), (18, "same row", "en", "a"),
    (19, "<|endoftext|> it's 'S ﬁ Å <|startoftext|>x", "en", "a"), (20, "\x00\x1c z ", "en", "a"),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd rows with further columns whose names operators use themselves."""
    df = spark.createDataFrame([(d, t, g, s, len(t or "")) for d, t, g, s in ODD], "doc_id long, text string, lang string, source string, n_chars long")
    for c in ("shard", "slot", "size", "_part", "_before", "_size", "_times", "fps", "ids", "sizes", "block", "content", "score", "item", "_w", "_h", "at"):
        df = df.withColumn(c, F.lit("clash"))
    return df.repartition(3)


@pytest.fixture(scope="module")
def none(odd):
    return odd.filter("doc_id < 0")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r for r in docs.collect()}


def test_simhash_query(spark, texts):
    rows = queries.op1_simhash(spark, SF).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    fps = {d: brute.simhash(r["text"]) for d, r in texts.items()}
    assert {r["doc_id"]: int(r["fingerprint"], 16) for r in rows} == fps
    ids = sorted(fps)
    want = dict(zip(ids, brute.reach(ids, [fps[d] for d in ids], lambda a, b: (a ^ b).bit_count() <= 3)))
    assert {r["doc_id"]: r["component_id"] for r in rows} == want


def _fingerprints(spark, values):
    rows = [(i, [v - (1 << 64) if v >> 63 else v], v - (1 << 64) if v >> 63 else v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "doc_id long, fps array<long>, item long")


@pytest.mark.parametrize("large", [20_000, 8])
def test_simhash_links_equal_all_pairs(spark, monkeypatch, large):
    """Also with shards that are cut again."""
    monkeypatch.setattr(simhash, "LARGE_SHARD", large)
    rng = random.Random(5)
    values = {0, (1 << 64) - 1}
    for _ in range(12):
        v = rng.getrandbits(64)
        for _ in range(25):
            values.add(v)
            for _ in range(rng.randint(1, 3)):
                v ^= 1 << rng.randrange(64)
    values |= {rng.getrandbits(64) for _ in range(200)}
    values = sorted(values)
    found = simhash.components(simhash.links(_fingerprints(spark, values)))
    label = {r["item"]: r["component"] for r in found.collect()}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    want = brute.reach(list(range(len(values))), values, lambda a, b: (a ^ b).bit_count() <= 3)
    groups = defaultdict(set)
    for s, w in zip(signed, want):
        groups[w].add(label.get(s, ("alone", s)))
    assert all(len(g) == 1 for g in groups.values())
    assert len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_links_refuse_a_radius_that_loses_pairs(spark):
    with pytest.raises(ValueError):
        simhash.links(_fingerprints(spark, [1, 3]), radius=4)


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    label = {r["item"]: r["component"] for r in simhash.components(edges).collect()}
    assert len({label[i] for i in range(61)}) == 1 and label[100] == label[101] != label[0]


def test_near_copies_in_the_stage(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    rows = []
    for i in range(40):
        words = [word() for _ in range(300)]
        rows.append((i, " ".join(words)))
        words[rng.randrange(300)] = "changed"
        rows.append((100 + i, " ".join(words)))
    df = spark.createDataFrame([(d, t, "en", "s", 0) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r["doc_id"] for r in simhash.one_of_each(df).collect()}
    assert kept == set(range(40))


def test_stage_near_its_limit(spark):
    """Copies with 6 of 300 words changed have a similarity of about 0.82, those with 40 one below 0.5."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    rows = []
    for i in range(100):
        words = [word() for _ in range(300)]
        rows.append((i, " ".join(words)))
        for first, changes in ((1000, 6), (2000, 40)):
            other = list(words)
            for k in range(changes):
                other[k * (300 // changes) + rng.randrange(3)] = word()
            rows.append((first + i, " ".join(other)))
    df = spark.createDataFrame([(d, t, "en", "s", 0) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r["doc_id"] for r in simhash.one_of_each(df).collect()}
    assert set(range(100)) <= kept and set(range(2000, 2100)) <= kept
    assert len(kept & set(range(1000, 1100))) <= 20


def _similar(a, b):
    """Similarity of the five-word shingles of two texts, plainly."""
    sets = []
    for text in (a, b):
        words = (text or "").lower().split()
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1]) if sets[0] | sets[1] else 1.0


def test_stage_joins_every_similar_pair(spark, monkeypatch):
    """Pairs on both sides of the limit of 0.8, beside a common passage; no shard or fingerprint decides."""
    monkeypatch.setattr(simhash, "LARGE_SHARD", 8)
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    passage = [word() for _ in range(40)]
    texts = []
    for i in range(60):
        words = passage + [word() for _ in range(260)]
        texts.append(" ".join(words))
        for changes in (5, 6, 7, 8):
            other = list(words)
            for k in rng.sample(range(8, 58), changes):
                other[k * 5] = word()
            texts.append(" ".join(other))
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    want = brute.reach(list(range(len(texts))), texts, lambda a, b: _similar(a, b) >= 0.8)
    from sigspark.llm import similar

    got = {r["doc_id"]: r["component_id"] for r in similar.near_copies(df).collect()}
    assert [got[i] for i in range(len(texts))] == want and len(set(want)) > 60
    assert {r["doc_id"] for r in simhash.one_of_each(df).collect()} == set(want)


def test_stage_goes_by_fingerprints_first(spark, monkeypatch):
    """Groups of fingerprints against plain ones; the pairs they propose are checked on whole sets."""
    from sigspark.llm import similar

    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(30)]
    values = base + [v ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(6))) for v in base * 3]
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    rows = similar.fingerprint_groups(spark.createDataFrame(list(enumerate(signed)), "item long, fp long")).collect()
    near = {r["item"]: r["near"] for r in rows}
    want = brute.reach(list(range(len(values))), values, lambda a, b: (a ^ b).bit_count() <= 3)
    assert len({(near[i], w) for i, w in enumerate(want)}) == len(set(want)) == len(set(near.values()))
    groups = spark.createDataFrame([tuple(r) for r in rows], "item long, fp long, near long").coalesce(1)
    assert all(near[r["a"]] == near[r["b"]] for r in similar.neighbours(groups).collect())

    proposed, real = [], similar.possible
    monkeypatch.setattr(similar, "possible", lambda pairs, sketches: proposed.append(pairs.count()) or real(pairs, sketches))
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    texts = []
    for _ in range(20):
        words = [word() for _ in range(2000)]
        texts += [" ".join(words), " ".join([*words[:-1], "changed"])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in similar.near_copies(df).collect()}
    assert got == {i: i // 2 * 2 for i in range(40)}
    assert proposed[0] >= 15 and not any(proposed[1:])  # all but those whose fingerprints differ, or whose chain a range cuts


def test_stage_keeps_other_texts_of_a_removed_number(spark):
    one, two = "first text that is long enough to have shingles", "second, unlike any other of these texts"
    rows = [(3, one), (5, one), (5, two), (5, two), (None, one), (9, None), (8, "")]
    df = spark.createDataFrame([(d, t, "en", "s", 0) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = [(r["doc_id"], r["text"]) for r in simhash.one_of_each(df).collect()]
    assert sorted(kept, key=str) == sorted([(3, one), (5, two), (5, two), (None, one), (8, "")], key=str)


def test_near_copies_of_odd_rows(odd, none):
    from sigspark.llm import similar

    found = [(r["doc_id"], r["component_id"]) for r in similar.near_copies(odd).collect()]
    texts = [t for _, t, _, _ in ODD]
    ids = [d if d is not None else 10**9 for d, _, _, _ in ODD]
    want = brute.reach(ids, texts, lambda a, b: _similar(a, b) >= 0.8)
    assert sorted((d if d is not None else 10**9, c) for d, c in found) == sorted(zip(ids, (w if w < 10**9 else None for w in want)))
    assert similar.near_copies(none).collect() == []


def test_sketches_bound_what_is_common():
    from sigspark.llm import similar

    rng = np.random.default_rng(1)
    pool = rng.integers(0, 1 << 63, 200_000).astype(np.uint64)
    sets = [np.unique(rng.choice(pool, n)) for n in (0, 1, 5, 400, 3000, 150_000, 190_000)]
    rows = [np.frombuffer(similar.sketch(s), np.uint8) for s in sets]
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            assert similar.most_common(rows[i][None], rows[j][None])[0] >= len(np.intersect1d(a, b))


def test_common_passages_bring_few_pairs(spark, monkeypatch):
    """Documents of 600 own and 400 common words: pairs grow with the documents, not with their square."""
    from sigspark.llm import similar

    made = []
    real = similar.possible
    monkeypatch.setattr(similar, "possible", lambda pairs, sketches: made.append(pairs.count()) or real(pairs, sketches))
    rng = random.Random(2)
    common = " ".join(f"common{k}" for k in range(400))
    for n in (100, 200):
        rows = [(i, " ".join(f"w{rng.getrandbits(40)}" for _ in range(600)) + " " + common) for i in range(n)]
        found = similar.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert all(r["doc_id"] == r["component_id"] for r in found)
    assert max(made) <= 2 * 200


def test_odd_rows_simhash(odd, none):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == len(ODD)
    by = {r["doc_id"]: r for r in rows}
    assert [by[i]["fps"] for i in (1, 2, 3)] == [[0]] * 3 and [by[i]["component_id"] for i in (1, 2, 3)] == [1] * 3
    assert by[9]["component_id"] == 6
    assert simhash.near_duplicates(none).collect() == [] and simhash.one_of_each(none).collect() == []
    assert len(simhash.one_of_each(odd).columns) == 5


def _check_shards(rows, shards):
    rows = sorted(rows, key=lambda r: (r["shard"], r["slot"]))
    total = sum(r["size"] for r in rows)
    at = defaultdict(list)
    for r in rows:
        at[r["shard"]].append(r)
    for k, members in at.items():
        assert [m["slot"] for m in members] == list(range(len(members)))
        assert abs(sum(m["size"] for m in members) - total / shards) <= max(r["size"] for r in rows)
    ids = [r["doc_id"] for r in rows if r["doc_id"] is not None]
    assert ids == sorted(ids)


def test_sharding(spark, odd, none, texts, tmp_path):
    rows = queries.op2_sharding(spark, SF).collect()
    _check_shards(rows, 16)
    for r in rows:
        raw = texts[r["doc_id"]]["text"].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 1, brute.crc(raw), "bytes", None)
    got = sharding.sharded(odd, 3).collect()
    assert len(got) == len(ODD)
    _check_shards(got, 3)
    assert sharding.sharded(none, 3).collect() == []
    sharding.write(odd.select("doc_id", "text"), str(tmp_path / "shards"), 3)
    assert spark.read.parquet(str(tmp_path / "shards")).count() == len(ODD)


def test_suffix_query(spark, texts):
    got = {r["doc_id"]: tuple(r[c] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")) for r in queries.op3_suffix(spark, SF).collect()}
    assert got == brute.cut([(d, r["text"]) for d, r in texts.items()])


@pytest.mark.parametrize("block, part", [(1 << 20, 1 << 20), (3000, 4000)])
def test_suffix_blocks_and_parts(spark, texts, monkeypatch, block, part):
    """The result does not depend on how texts are packed and indexed."""
    monkeypatch.setattr(suffix, "BLOCK_BYTES", block)
    monkeypatch.setattr(suffix, "INDEX_BYTES", part)
    rows = [(d, r["text"]) for d, r in sorted(texts.items())[:80]]
    rows += [(900 + i, PASSAGE[i:] + "abab" * 40 + PASSAGE[: 60 + i]) for i in range(20)] + [(950, "abab" * 60), (951, "b" * 200), (952, "b" * 49)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: tuple(r[c] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")) for r in suffix.digests(suffix.deduplicated(df)).collect()}
    assert got == brute.cut(rows)


def test_odd_rows_suffix(odd, none):
    rows = suffix.digests(suffix.deduplicated(odd)).collect()
    want = brute.cut([(d, t) for d, t, *_ in ODD if d is not None])
    assert len(rows) == len(ODD)
    for r in rows:
        if r["doc_id"] is not None:
            assert tuple(r[c] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")) == want[r["doc_id"]]
    assert suffix.deduplicated(none).collect() == []
    kept = {r["doc_id"]: r for r in suffix.without_repeats(odd).collect()}
    assert kept[9]["text"] == "" and kept[6]["text"] == PASSAGE and kept[7]["text"] == "start  end" and kept[9]["source"] == "ü"


def test_index_matching_statistics():
    import numpy as np

    rng = random.Random(1)
    base = bytes(rng.choice(b"abc") for _ in range(300))
    strings = list(dict.fromkeys(base[i : i + rng.randint(50, 84)] for i in range(0, 210, 7)))
    index = suffix.Index(strings, np.arange(len(strings)))
    assert len(index.run_start) < index.n
    queries_ = [bytes(rng.choice(b"abcd") for _ in range(70)), base[3:80], base[100:140] + b"zz" + base[20:60]]
    text = np.frombuffer(b"".join(queries_), np.uint8).astype(np.int64) + 1
    sizes = np.array([len(q) for q in queries_])
    starts = np.cumsum(sizes) - sizes
    for some, behind, n, _ in index.stream(text, starts, sizes):
        for q, k in zip(some.tolist(), n.tolist()):
            rest = queries_[q][len(queries_[q]) - behind :]
            assert k == max((m for m in range(len(rest) + 1) if any(rest[:m] in s for s in strings)), default=0)


def test_index_holds_few_bytes_for_a_symbol():
    import tracemalloc

    import numpy as np

    rng = random.Random(2)
    strings = [bytes(rng.choices(range(97, 123), k=80)) for _ in range(4000)]
    tracemalloc.start()
    index = suffix.Index(strings, np.arange(4000))
    left, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert left <= 70 * index.n and most <= 100 * index.n


def _check_mix(rows, source_of, size_of):
    totals, weights, taken, target = defaultdict(int), {}, defaultdict(int), {}
    for r in rows:
        assert r["size"] == size_of[r["doc_id"]] if r["doc_id"] is not None else True
        s = source_of(r)
        totals[s] += r["size"]
        taken[s] += r["taken"]
        target[s] = r["target"]
        assert r["taken"] <= 2 * r["size"]
    for i, s in enumerate(sorted(totals, key=lambda s: (s is None, s or ""))):
        weights[s] = (5, 2, 1)[i % 3]
    full, at = set(), 0.0
    while True:
        free = sum(weights[s] for s in totals if s not in full)
        at = (1.5 * sum(totals.values()) - sum(2 * totals[s] for s in full)) / free
        more = {s for s in totals if s not in full and at * weights[s] > 2 * totals[s]}
        if not more:
            break
        full |= more
    largest = max(r["size"] for r in rows)
    for s in totals:
        assert math.isclose(target[s], 2 * totals[s] if s in full else at * weights[s])
        assert abs(taken[s] - target[s]) <= largest


def test_mixing(spark, odd, none, texts):
    rows = queries.op4_mixing(spark, SF).collect()
    size_of = {d: len(brute.WORD.findall(r["text"])) for d, r in texts.items()}
    _check_mix(rows, lambda r: texts[r["doc_id"]]["source"], size_of)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, queries.op4_mixing(spark, SF).collect()))
    got = mixing.mixed(odd.drop("_size", "_times")).collect()
    assert len(got) == len(ODD)
    rows = [{"doc_id": r["doc_id"], "size": r["_size"], "taken": r["_size"] * r["_times"], "target": r["_target"], "source": r["source"]} for r in got]
    _check_mix(rows, lambda r: r["source"], {d: len(brute.WORD.findall(t or "")) for d, t, *_ in ODD})
    assert mixing.mix_documents(none).collect() == []
    copies = mixing.mix_documents(odd).groupBy("doc_id").count().collect()
    assert {r["doc_id"]: r["count"] for r in copies}.keys() <= {d for d, *_ in ODD}


def test_warc(spark):
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = queries.op5_warc(spark, SF).collect()
    assert sorted(r["page_id"] for r in rows) == sorted(pages) and all(r["intact"] for r in rows)
    last = {}
    for p, r in pages.items():
        last[r["html"]] = max(p, last.get(r["html"], p))
    for r in rows:
        raw = pages[r["page_id"]]["html"].encode()
        other = last[pages[r["page_id"]]["html"]]
        want = ("revisit", other) if len(raw) >= 1000 and other != r["page_id"] else ("response", None)
        assert (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) == (len(raw), hashlib.sha1(raw).hexdigest(), *want)


def test_warc_odd_pages(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 300)
    big = "<p>é\r\n\r\nWARC/1.1</p>" * 80
    pages = [
        (1, "http://www.a.org/x y?q=1#f", big), (2, "https://a.org:443/x y?q=1", big), (3, None, None), (4, "", ""), (5, "http://[bad", "short"),
        (6, "http://b.org/", "short"), (7, "http://b.org/", big), (None, "http://c.org", "null id"), (8, "h" * 500, big[1:]), (8, "h" * 500, big[1:]),
        (9, "http://ü.example/ä\tö", "x"),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("archive", F.lit("clash"))
    archives = warc.write_archives(df)
    blocks, directory = warc.build_index(warc.index_lines(archives), block_lines=2)
    assert len(directory) > 2 and directory == sorted(directory)
    keys = spark.createDataFrame([(warc.line_key(u, p),) for p, u, _ in pages], "key string")
    got = warc.read_ranges(warc.find(keys, blocks, directory), archives).collect()
    assert len(got) == len(pages) and all(r["intact"] for r in got)
    types = {r["page_id"]: (r["record_type"], r["refers_to"], r["payload_bytes"]) for r in got}
    n = len(big.encode())
    assert types[1] == types[2] == ("revisit", 7, n) and types[7] == ("response", None, n)
    assert types[3] == ("response", None, 0) and types[8] == ("response", None, len(big[1:].encode()))
    assert {r["page_id"]: bytes(r["payload"] or b"") for r in got}[7] == big.encode()
    assert warc.surt("http://www.a.org/x") == warc.surt("https://a.org:443/x") == "org,a)/x"
    assert warc.round_trip(df.filter("page_id < 0")).collect() == []


def _library():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.no_truncation()
    t.no_padding()
    return t


def test_bpe(spark, odd, none, texts):
    t = _library()
    for rows, text_of in (
        (queries.op6_bpe(spark, SF).collect(), {d: r["text"] for d, r in texts.items()}),
        (bpe.digests(bpe.decode(bpe.encode(odd))).collect(), {d: x for d, x, *_ in ODD}),
    ):
        assert len(rows) >= len(text_of)
        for r in rows:
            ids = t.encode(text_of[r["doc_id"]] or "", add_special_tokens=False).ids
            want = (len(ids), brute.sha(" ".join(map(str, ids)).encode()), brute.sha(t.decode(ids, skip_special_tokens=False).encode()))
            assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == want
    assert bpe.encode(none).collect() == []


def test_bpe_tree():
    t, c = _library(), bpe.codec(bpe.default_vocabulary())
    rng = random.Random(9)
    for alphabet in ("ab", "thein", "aeéñ日", "a", "ab1!"):
        for n in (1, 2, 37, 400, 3001):
            word = "".join(rng.choice(alphabet) for _ in range(n))
            assert c.long_word(word) == t.encode(word, add_special_tokens=False).ids
            symbols = [*word[:-1], word[-1] + "</w>"]
            if all(ord(x) < 128 for x in word) and word.isalpha():
                for leaf in (1, 3, 16):
                    assert bpe.tree(c.merges, symbols, leaf) == c.merges.apply(symbols)


def test_licenses(spark, odd, none, texts):
    rows = queries.op7_licenses(spark, SF).collect()
    for r in rows:
        assert tuple(r[c] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels")) == brute.license_base(texts[r["doc_id"]]["text"])
        assert set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    got = {r["doc_id"]: r for r in licenses.scan(odd).collect()}
    assert got[13]["base_labels"] == "apache,mit" and got[14]["labels"] == "bsd" and got[14]["score"] == 1 and got[1]["n_words"] == 0
    assert licenses.scan(none).collect() == []


def test_wrapped_licenses(spark):
    """Every template, wrapped at several widths inside other text, bare and as a comment."""
    import textwrap

    rows, want = [], {}
    for label, templates in licenses.TEMPLATES.items():
        for template in templates:
            for width in (30, 72, 80):
                for mark in ("", "# ", " * "):
                    body = "\n".join(mark + line for line in textwrap.wrap("Copyright (c) someone. " + template + ". More text follows.", width))
                    want[len(rows)] = label
                    rows.append((len(rows), f"/* some file\n{mark}\n{body}\n\nint main;\n"))
    rows.append((len(rows), "nothing of that kind\nstands in\nthese lines"))
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for d, label in want.items():
        assert label in got[d]["labels"].split(",") and max(b["containment"] for b in got[d]["blocks"] if b["template"] == label) == 1.0
    assert got[len(rows) - 1]["blocks"] == []


def test_license_join_finds_all():
    rng = random.Random(2)
    words = [f"w{i}".encode() for i in range(40)]
    sets = [(str(i), frozenset(rng.sample(words, rng.randint(1, 12)))) for i in range(30)]
    index = licenses.TemplateIndex(sets, {w: rng.randint(0, 9) for w in words}, 0.8)
    for _ in range(3000):
        block = set(rng.sample(words, rng.randint(0, 30)))
        want = {i for i, (_, s) in enumerate(sets) if len(s & block) / len(s) >= 0.8}
        assert {i for i, _ in index.matches(block)} == want


def test_language(spark, odd, none):
    rows = queries.op8_language(spark, "/root/testdata/sf0.01").collect()
    truth = {r["doc_id"]: r for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    held = [r for r in rows if r["held_out"]]
    assert {r["doc_id"] for r in held} == {d for d in truth if brute.crc(str(d).encode()) % 3 == 1}
    assert sum(r["lang_pred"] == truth[r["doc_id"]]["lang"] for r in held) / len(held) > 0.97
    filters = language.learn(odd)
    got = {r["doc_id"]: r for r in language.predict(odd, filters).collect()}
    assert {got[i]["lang_pred"] for i in (1, 2, 3, 15)} == {"und"} and got[16]["lang_pred"] == "ja" and got[10]["lang_pred"] == "en"
    empty = language.predict(odd, language.learn(none)).collect()
    assert {r["lang_pred"] for r in empty} == {"und"} and len(empty) == len(ODD)
    assert language.predict(none, filters).collect() == []


def test_filters_return_all_languages():
    import numpy as np

    rng = np.random.default_rng(1)
    found = [(f"l{i:02}", np.unique(rng.integers(0, 1 << 32, 500))) for i in range(70)]
    f = language.build(found)
    for i, (_, keys) in enumerate(found):
        assert (f.masks(keys)[i // 64] >> np.uint64(i % 64) & np.uint64(1)).all()
    other = rng.integers(0, 1 << 32, 20_000)
    rate = np.mean([(f.masks(other)[i // 64] >> np.uint64(i % 64) & np.uint64(1)).mean() for i in range(70)])
    assert abs(rate - f.false_positive.mean()) < 0.002


def test_audio(spark, odd, none, texts):
    for rows, text_of in (
        (queries.op9_audio(spark, SF).collect(), {d: r["text"] for d, r in texts.items()}),
        (audio.digests(audio.read_media(audio.to_media(odd))).collect(), {d: x for d, x, *_ in ODD}),
    ):
        for r in rows:
            raw, p = (text_of[r["doc_id"]] or "").encode(), brute.padded(text_of[r["doc_id"]])
            got = tuple(r[c] for c in ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_sha256"))
            assert got == (len(raw), len(p), brute.sha(p), brute.crc(p[-16:]), brute.sha(audio.encode(p)))
            assert r["media_bytes"] == len(audio.encode(p)) and "damaged=0" in r["feature"]
    assert audio.read_media(audio.to_media(none)).collect() == []


def test_audio_frames_after_damage():
    payload = bytes(random.Random(4).randrange(256) for _ in range(192 * 40))
    stream = audio.encode(payload)
    whole = audio.decode(stream)
    assert whole.payload == payload and whole.declared == len(whole.frames) and len(whole.table) == 100
    assert whole.seconds == (1152 * len(whole.frames), 48000)
    at = whole.frames[3].offset
    hurt = stream[:at] + b"\xff\xfa junk \xff" + stream[at + 5 :]
    assert [f.offset + 4 for f in whole.frames[4:]] == [f.offset for f in audio.decode(hurt).frames if f.offset > at + 100]
    spoiled = bytearray(stream)
    spoiled[at + 10] ^= 1
    assert audio.decode(bytes(spoiled)).damaged == 1
    assert audio.decode(b"").frames == [] and audio.decode(b"\xff" * 50).frames == []
    assert audio.crc16(b"123456789") == 0xAEE7


def test_quality(spark, odd, none, texts):
    rows = queries.op10_quality(spark, SF).collect()
    assert len(rows) == len(texts)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    for r in rows:
        assert tuple(r[c] for c in names) == brute.base_counts(texts[r["doc_id"]]["text"])
        assert not (r["base_failed"] and r["kept"])
    labels = spark.createDataFrame([(10, 1, 0), (10, 1, 0), (99, 1, 0), (None, 1, 0), (4, None, None)], "doc_id long, quality int, toxic int")
    plain = odd.select("doc_id", "text", "lang", "source", "n_chars")
    got = quality.scored(plain, labels).collect()
    assert len(got) == len(ODD)
    text_of = {d: t for d, t, *_ in ODD}
    for r in got:
        assert tuple(r[c] for c in names) == brute.base_counts(text_of[r["doc_id"]])
    assert quality.good_documents(odd, labels).columns == plain.columns
    assert quality.scored(plain, labels.filter("doc_id < 0")).filter("score <> 0").count() == 0
    assert quality.good_documents(none, labels).collect() == []


def test_quality_ratio(spark):
    """Scores against counts with plain dictionaries."""
    import xxhash

    docs = [(1, "a b a"), (2, "c d"), (3, "a")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in quality.scored(df, spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")).collect()}
    word = lambda w: xxhash.xxh64_intdigest(w.encode(), 42)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    hashes = {d: [signed(word(w)) for w in t.split()] for d, t in docs}
    pair = spark.createDataFrame([(d, a, b) for d, h in hashes.items() for a, b in zip(h, h[1:])], "d long, a long, b long")
    grams = {d: [x % quality.BUCKETS for x in h] for d, h in hashes.items()}
    for r in pair.select("d", F.xxhash64("a", "b").alias("x")).collect():
        grams[r["d"]].append(r["x"] % quality.BUCKETS)
    every = [b for g in grams.values() for b in g]
    for d, g in grams.items():
        one = lambda b: math.log((grams[1].count(b) + 1) / (len(grams[1]) + quality.BUCKETS)) - math.log((every.count(b) + 1) / (len(every) + quality.BUCKETS))  # noqa: B023, E731
        assert math.isclose(got[d], sum(map(one, g)) / len(g), abs_tol=1e-9)
