"""Ranked search, files of token ids and alignment against plain forms."""
import hashlib
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sigspark.llm import alignment, bpe, repair, search
from tests.llm.test_operators import ODD, SF, docs, none, odd, texts  # noqa: F401


# Ranked search


def _ranked(documents, items):
    import math

    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    held = [(d, Counter(term.findall(lower(t)))) for d, t in documents]
    held = [(d, c) for d, c in held if c]
    n, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for d, c in held:
            m = 10 + 90 * sum(c.values()) * n // total
            s = sum(
                math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in set(term.findall(lower(text))) if t in c
            )
            if s > 0:
                scores.append((-s, d if d is not None else -1, d))
        out += [(item, k + 1, d, -s) for k, (s, _, d) in enumerate(sorted(scores)[:10])]
    return out


@pytest.mark.parametrize("small", [False, True])
def test_search_equals_every_score(spark, monkeypatch, small):
    """Also with strata in many parts, items in many blocks, and one stratum for most documents."""
    if small:
        for name, value in (("PART_POSTINGS", 20), ("BLOCK_BYTES", 60), ("CELLS", 40), ("POSTINGS_AT_ONCE", 30), ("ITEMS_AT_ONCE", 2)):
            monkeypatch.setattr(search, name, value)
    rng = random.Random(4)
    word = lambda: rng.choice(["alpha", "Beta", "γάμμα", "delta", "x1", "same", "same", "rare%d" % rng.randint(0, 30)])
    documents = [(i, " ".join(word() for _ in range(rng.choice([5, 5, 5, 12, 80])))) for i in range(120)]
    documents += [(500, None), (501, ""), (502, "--- !"), (None, "alpha beta"), (503, "same row"), (503, "same row"), (504, "ALPHA-beta_gamma`x")]
    items = [(1, "alpha rare3 same"), (2, None), (3, "nowhere"), (4, "same"), (5, "γάμμα BETA beta x1 rare1 rare2"), (6, " ")]
    index = search.build(spark.createDataFrame(documents, "doc_id long, text string").withColumn("m", F.lit("clash")))
    found = search.search(index, spark.createDataFrame(items, "item_id long, text string").withColumn("score", F.lit("clash")))
    assert found.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(_ranked(documents, items), key=str)


def test_search_of_odd_and_no_rows(odd, none):  # noqa: F811
    items = odd.select(F.col("doc_id").alias("item_id"), "text", "score").filter("item_id IN (4, 6, 13, 16, 2)")
    got = search.search(search.build(odd), items).collect()
    want = _ranked([(d, t) for d, t, _, _ in ODD], [(d, t) for d, t, _, _ in ODD if d in (4, 6, 13, 16, 2)])
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert search.search(search.build(none), items).collect() == []
    assert search.search(search.build(odd), items.filter("item_id < 0")).collect() == []


# Files of token ids


def test_grammar_gives_back_every_document_and_range():
    rng = random.Random(1)
    for trial in range(300):
        alphabet = [1, 2, 3, 50] if trial % 2 else [7]
        given = [[rng.choice(alphabet) for _ in range(rng.choice([0, 1, 2, 3, 40, 200]))] for _ in range(rng.randint(0, 12))]
        flat = np.array([x for d in given for x in d], np.int32)
        g = repair.unpacked(repair.packed(repair.compressed(flat, np.array([len(d) for d in given], np.int64))))
        ids, counts = repair.expanded(g)
        assert ids.tolist() == flat.tolist() and counts.tolist() == [len(d) for d in given]
        for k, d in enumerate(given):
            a, b = rng.randint(0, len(d) + 1), rng.randint(0, len(d) + 3)
            assert repair.between(g, k, a, b) == d[a:b]


def test_grammar_shortens_copies():
    rng = np.random.default_rng(3)
    one = rng.integers(0, 40_000, 500)
    g = repair.compressed(np.tile(one, 40).astype(np.int32), np.full(40, 500))
    assert len(g.symbols) <= 40 and (g.lengths <= 500).all()


def _ids(text):
    from tokenizers import Tokenizer

    t = _ids.__dict__.setdefault("t", Tokenizer.from_file(bpe.default_vocabulary()))
    return t.encode(text or "", add_special_tokens=False).ids + [1]


@pytest.mark.parametrize("shard", [1_000_000, 300])
def test_files_hold_what_the_library_encodes(docs, monkeypatch, shard):  # noqa: F811
    monkeypatch.setattr(repair, "SHARD_IDS", shard)
    rows = docs.select("doc_id", "text").collect()
    got = {r["doc_id"]: tuple(r)[1:] for r in repair.round_trip(docs).collect()}
    start, want = 0, {}
    for r in sorted(rows, key=lambda r: r["doc_id"]):
        ids = _ids(r["text"])
        want[r["doc_id"]] = (start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        start += len(ids)
    assert got == want


def test_new_words_go_to_the_tokenizer_together(monkeypatch):
    """Words of letters in a few texts, also where one of them is more than one piece; ids are those of the library."""
    from tokenizers import Tokenizer

    rng = random.Random(9)
    letters = "abcdefghijklmnopqrstuvwxyzABCéÉñßſüöçžłøæﬁǆαβγΩжщדش中文字한글"
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.randrange(1, 12)))
    several = ["İstanbul", "\u0958क", "x\u0301", "don't", "a1b22", "<|endoftext|>", "</w>", "ªº"]
    sent = []

    class Spy:
        def __init__(self, real):
            self.real = real

        def __getattr__(self, name):
            return getattr(self.real, name)

        def encode_batch_fast(self, some, **more):
            sent.extend(some)
            return self.real.encode_batch_fast(some, **more)

    library = Tokenizer.from_file(bpe.default_vocabulary())
    for odd_words in ([], several):
        e = repair.Encoder(bpe.default_vocabulary())
        sent.clear()
        with monkeypatch.context() as m:
            m.setattr(e.codec, "tokenizer", Spy(e.codec.tokenizer))
            texts = [" ".join([*(word() for _ in range(300)), *odd_words]) for _ in range(10)]
            got = e.encode([t.encode() for t in texts])
        assert [np.frombuffer(g, "<i4").tolist() for g in got] == [library.encode(t, add_special_tokens=False).ids for t in texts]
        assert odd_words or len(sent) <= 4  # 3000 words


def test_words_of_small_letters_skip_the_normalizer(monkeypatch):
    """They go to the model at once, also in texts with marks on every side; others still go to the whole tokenizer."""
    from tokenizers import Tokenizer

    rng = random.Random(4)
    small = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzéñßſøæαςжщש中文かカ") for _ in range(rng.randrange(1, 12))) for _ in range(2000)]
    other = ["Été", "ÇA", "İx", "한글", "ﬁn", "ǆa", "é\u0301", "x1y", "\u3042\u3099", "a\u00adb"]
    marked = ["it's", "a,b", ",,a", "(small),", "a\tb\x0bc", "x\u00a0y", "\x1cq\x1f", "a<b>", "don't've", "...", "a--b"]
    sent = []

    class Spy:
        def __init__(self, real):
            self.real = real

        def __getattr__(self, name):
            return getattr(self.real, name)

        def encode_batch_fast(self, some, **more):
            sent.extend(w for x in some for w in x.split())
            return self.real.encode_batch_fast(some, **more)

    library = Tokenizer.from_file(bpe.default_vocabulary())
    e = repair.Encoder(bpe.default_vocabulary())
    monkeypatch.setattr(e.codec, "tokenizer", Spy(e.codec.tokenizer))
    texts = [" ".join(rng.sample([*small, *other, *marked], 400)) for _ in range(12)] + [" ".join([*other[:4], *marked]), "", " ", "\n\n", "A,", ",", " a", "<|endoftext|>A, b", "a <| b,C"]
    for some in (texts, texts[::-1], texts[:1], [""], []):
        got = e.encode([t.encode() for t in some])
        assert [np.frombuffer(g, "<i4").tolist() for g in got] == [library.encode(t, add_special_tokens=False).ids for t in some]
    assert not {w for w in small if len(w) > 3} & set(sent) and {"Été", "한글"} <= set(sent)


def test_texts_are_encoded_by_rows_and_bytes(monkeypatch):
    monkeypatch.setattr(repair, "ROWS", 3)
    monkeypatch.setattr(repair, "BYTES", 10)
    texts = ["a" * 4, None, "b" * 6, "c", "d" * 50, "", "e", "f", "g" * 10, "h"]
    batch = pa.record_batch([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"]).slice(1)
    got = [p.column("doc_id").to_pylist() for p in repair.portions(batch)]
    assert [x for p in got for x in p] == list(range(1, 10))
    assert got == [[1, 2, 3], [4], [5, 6, 7], [8], [9]]


def test_pairs_are_sorted_alike_in_one_number_and_in_two():
    rng = np.random.default_rng(5)
    place, a, b = rng.permutation(3000), rng.integers(0, 40, 3000), rng.integers(0, 40, 3000)
    one, two = repair.by_pair(np.sort(place), a, b, 40, 3000), repair.by_pair(np.sort(place), a, b, 1 << 30, 3000)
    assert one[0].tolist() == two[0].tolist()
    assert np.flatnonzero(np.diff(one[1])).tolist() == np.flatnonzero(np.diff(two[1])).tolist()


def test_checksums_stay_in_the_task_that_reads(spark, odd, tmp_path):  # noqa: F811
    repair.write(odd, str(tmp_path / "ids"))
    shards = repair.read(spark, str(tmp_path / "ids"))
    sums = repair.checksums(shards)
    assert sums._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    want = [(r["doc_id"], r["start"], len(r["ids"]), zlib.crc32(struct.pack(f"<{len(r['ids'])}I", *r["ids"]))) for r in repair.documents(shards).collect()]
    assert sorted(map(tuple, sums.collect()), key=str) == sorted(want, key=str)


def test_files_of_odd_rows_and_ranges(spark, odd, none, tmp_path):  # noqa: F811
    repair.write(odd, str(tmp_path / "ids"))
    shards = repair.read(spark, str(tmp_path / "ids"))
    back = repair.documents(shards).collect()
    assert sorted((r["doc_id"] or 0, list(r["ids"])) for r in back) == sorted((d or 0, _ids(t)) for d, t, _, _ in ODD)
    starts = sorted((r["start"], len(r["ids"]), r["doc_id"] or 0) for r in back)
    assert [s for s, _, _ in starts] == [sum(n for _, n, _ in starts[:k]) for k in range(len(starts))]
    assert [d for _, _, d in starts] == sorted(d for _, _, d in starts)
    wanted = [(10, 5, 9), (10, 79_990, 10**9), (2, 0, 5), (7, 3, 3), (77, 0, 1), (18, 0, 2), (18, 0, 2)]
    found = repair.lookup(shards, spark.createDataFrame(wanted, "doc_id long, start long, stop long").withColumn("data", F.lit("clash"))).collect()
    by = {d: _ids(t) for d, t, _, _ in ODD}
    want = [(d, a, b, by[d][a:b]) for d, a, b in dict.fromkeys(wanted) if d in by]
    want += [x for x in want if x[0] == 18]  # two rows have that number
    assert sorted(tuple(r) for r in found) == sorted(want)
    assert repair.round_trip(none).collect() == []


# Alignment


def _groups(text):
    import sentencepiece
    from tokenizers import Tokenizer

    if "a" not in _groups.__dict__:
        path_a, path_b = alignment.default_vocabularies()
        _groups.a, _groups.b = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
        _groups.a.encode_special_tokens = True
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in visible]
        _groups.code = {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(hidden)}
    if not text:
        return []
    a, b = _groups.a.encode(" " + text, add_special_tokens=False).ids, _groups.b.encode(text)
    of_a = [bytes(_groups.code[c] for c in _groups.a.id_to_token(i)) for i in a]
    of_b = [bytes([int(_groups.b.id_to_piece(i)[3:5], 16)]) if _groups.b.is_byte(i) else _groups.b.id_to_piece(i).replace("▁", " ").encode() for i in b]
    if not b"".join(of_a) == b"".join(of_b) == (" " + text).encode():
        return []
    out, x, y, i, j, mine, other = [], 0, 0, 0, 0, [], []
    while i < len(a) or j < len(b):
        if x <= y:
            mine, x, i = [*mine, a[i]], x + len(of_a[i]), i + 1
        else:
            other, y, j = [*other, b[j]], y + len(of_b[j]), j + 1
        if x == y:
            out.append((mine, other))
            mine, other = [], []
    return out


def _aligned(documents):
    groups = [_groups(t) for _, t in documents]
    links = [Counter((x, y) for xs, ys in g for x in xs for y in ys) for g in groups]
    count = Counter(p for c in links for p in c)
    most = defaultdict(int)
    for (x, _), n in count.items():
        most[x] = max(most[x], n)
    say = lambda g: ";".join(",".join(map(str, xs)) + "|" + ",".join(map(str, ys)) for xs, ys in g)
    return [
        (
            d, sum(len(xs) for xs, _ in g), sum(len(ys) for _, ys in g), len(g), c.total(), sum(k for p, k in c.items() if count[p] == most[p[0]]),
            sum(k * count[p] for p, k in c.items()), hashlib.sha256(say(g).encode()).hexdigest() if g else "",
        )
        for (d, _), g, c in zip(documents, groups, links)
    ]


SPACES = [
    (101, "  a  b \n\n c\t"), (102, "<s> x</s> <|endoftext|>"), (103, "a▁b"), (104, "日本語 の　テ"), (105, "it's  we'll\x1cq !\x1c z\x85y\xa0 w"), (106, " \n x"),
    (107, "a;\r\nb;\r c\r"), (108, "\n\n"), (109, "a     b"), (110, "<0x0A> é \U0001f600 a\x00b"), (111, "the the the " * 300),
]


@pytest.mark.parametrize("chunk", [8192, 3])
def test_alignment_equals_whole_texts(spark, odd, monkeypatch, chunk):  # noqa: F811
    """Whole texts in both libraries; with small chunks most pairs have bitmaps in several."""
    monkeypatch.setattr(alignment, "CHUNK", chunk)
    given = [(d, t) for d, t, _, _ in ODD] + SPACES
    more = spark.createDataFrame(SPACES, "doc_id long, text string").select("doc_id", "text")
    df = odd.select("doc_id", "text").union(more).withColumn("chunk", F.lit("clash")).repartition(3)
    assert sorted(map(tuple, alignment.align(df).collect()), key=str) == sorted(_aligned(given), key=str)


def test_blanks_at_the_end_of_a_text_stay_apart():
    """Units met together are encoded in one text: blanks at its end must not run into the next unit."""
    texts = [f"x{end}" for end in (" ", "  ", " \n", " \n\n", " \t ")]
    both = alignment.Aligner(*alignment.default_vocabularies())
    found = both.units(texts + [f"y  b{k} \n c{k}" for k in range(60)])
    say = lambda g: ";".join(",".join(map(str, xs)) + "|" + ",".join(map(str, ys)) for xs, ys in g)
    assert [";".join(u[0] or "" for u in units) for units in found[: len(texts)]] == [say(_groups(t)) for t in texts]


def test_alignment_of_the_smallest_tables(docs, none):  # noqa: F811
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert sorted(map(tuple, alignment.align(docs).collect())) == sorted(_aligned(rows))
    assert alignment.align(none).collect() == []


def test_bitmaps():
    rng = np.random.default_rng(0)
    for n in (0, 1, 5, 300, 5000):
        one, two = (np.unique(rng.integers(0, 8192, n)) for _ in range(2))
        a, b = alignment.packed(one), alignment.packed(two)
        assert alignment.unpacked(a).tolist() == one.tolist() and alignment.popcount(a) == len(one)
        assert alignment.unpacked(alignment.merged(a, b)).tolist() == np.union1d(one, two).tolist()
        assert len(a) <= 1 + min(2 * n if n else 0, 1024) or n > 512
