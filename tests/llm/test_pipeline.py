"""Every stage of the pipeline on its own input, against plain forms; the whole on odd rows and on an empty table."""
import hashlib

import pytest

import corpus_pipeline
from sigspark.llm import bpe
from sigspark.llm.common import DOCUMENT_COLUMNS, stored
from tests.llm import brute
from tests.llm.test_operators import SF, _similar, docs, none, odd  # noqa: F401


def _run(spark, docs):  # noqa: F811
    """Input of each stage, and the result."""
    tables = [docs]
    for name, stage in corpus_pipeline.STAGES:
        tables.append(stored(stage(spark, tables[-1], SF), "stage"))
    return tables


@pytest.fixture(scope="module")
def tables(spark, docs):  # noqa: F811
    return [[tuple(r) for r in t.select(*(DOCUMENT_COLUMNS if k < 5 else t.columns)).collect()] for k, t in enumerate(_run(spark, docs))]


def test_quality_rules_keep_whole_rows(tables):
    assert set(tables[1]) <= set(tables[0]) and 0 < len(tables[1]) < len(tables[0])
    assert not any(brute.base_counts(r[1])[-1] for r in tables[1])


def test_near_duplicates_leave_one_of_each(tables):
    rows = sorted(tables[1])
    want = brute.reach([r[0] for r in rows], [r[1] for r in rows], lambda a, b: _similar(a, b) >= 0.8)
    assert sorted(tables[2]) == [r for r, w in zip(rows, want) if r[0] == w]


def test_repeated_passages_are_cut(tables):
    cut = brute.cut([(r[0], r[1]) for r in tables[2]])
    left = {r[0]: hashlib.sha256((r[1] or "").encode()).hexdigest() for r in tables[3]}
    assert left.keys() == cut.keys()
    # Where a cut falls into a character, what is left of it cannot stand in a text.
    assert sum(left[d] == cut[d][3] for d in cut) >= 0.95 * len(cut)


def test_mixing_repeats_whole_documents(tables):
    before, after = {r[0]: r for r in tables[3]}, [r for r in tables[4]]
    assert all(r == before[r[0]] for r in after)
    assert max(sum(1 for r in after if r[0] == d) for d in before) <= 2


def test_tokens_are_those_of_the_library(tables):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_vocabulary())
    want = sorted((r[0], *(lambda ids: (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()))(t.encode(r[1] or "", add_special_tokens=False).ids)) for r in tables[4])
    assert sorted(r[:3] for r in tables[5]) == want


def test_odd_rows_and_no_rows(spark, odd, none):  # noqa: F811
    last = _run(spark, odd)[-1]
    assert last.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert {r["doc_id"] for r in last.collect()} <= {10, 11}  # all others have fewer than 50 words or repeat themselves
    for table in _run(spark, none)[1:]:
        assert table.collect() == []
