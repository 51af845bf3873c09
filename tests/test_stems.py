"""Stems and the alignment that uses them."""
import itertools
import random

import pytest
from pyspark.sql import functions as F

from sigspark.functions import stems
from sigspark.operators import scoring
from sigspark.plans import registry
from sigspark.plans.bindings import pair

# Published examples of the rules, a word and its stem.
KNOWN = """
caresses caress, ponies poni, ties tie, caress caress, cats cat, feed feed, agreed agre, plastered plaster, bled bled, motoring motor, sing sing,
conflated conflat, troubled troubl, sized size, hopping hop, tanned tan, falling fall, hissing hiss, fizzed fizz, failing fail, filing file, happy happi,
sky sky, relational relat, conditional condit, rational ration, digitizer digit, vietnamization vietnam, predication predic, operator oper,
feudalism feudal, decisiveness decis, hopefulness hope, triplicate triplic, formative form, formalize formal, electrical electr, hopeful hope,
goodness good, revival reviv, allowance allow, inference infer, airliner airlin, gyroscopic gyroscop, adjustable adjust, defensible defens,
irritant irrit, replacement replac, adjustment adjust, dependent depend, adoption adopt, communism commun, activate activ, homologous homolog,
effective effect, probate probat, rate rate, cease ceas, controll control, roll roll, dying die, flies fli, dies die, died die, denied deni,
generalizations gener, oscillators oscil, enjoy enjoy, by by, geology geolog
"""


def test_published_examples():
    for word, stem in (x.split() for x in KNOWN.split(",")):
        assert stems.stem(word) == stem, word


def test_any_word_has_a_stem():
    rng = random.Random(0)
    for _ in range(3000):
        word = "".join(rng.choice("aeiouyyybcdlst7é") for _ in range(rng.randint(0, 9)))
        assert len(stems.stem(word)) <= len(word) + 1 and stems.stem(word) == stems.stem(word)


def _plain(ref, hyp, stem):
    """Both stages over pairs of places, without counting words."""
    left, right, met = list(enumerate(ref)), list(enumerate(hyp)), []
    for form in ((lambda w: w), stem) if stem else ((lambda w: w),):
        for j, w in list(right)[::-1]:
            for i, v in list(left)[::-1]:
                if form(w) == form(v):
                    met.append((j, i))
                    left.remove((i, v))
                    right.remove((j, w))
                    break
    met.sort()
    runs = sum(1 for k, (j, i) in enumerate(met) if not k or met[k - 1] != (j - 1, i - 1))
    if not met:
        return 0.0
    p, r = len(met) / len(hyp), len(met) / len(ref)
    return p * r / (0.9 * p + 0.1 * r) * (1 - 0.5 * (runs / len(met)) ** 3)


@pytest.mark.parametrize("with_stems", [False, True])
def test_equals_plain_alignment(spark, with_stems):
    rng = random.Random(3)
    words = "hope hopes hoped hoping hopeful run running runs Cats cat x y ly".split()
    rows = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(1, 12))), " ".join(rng.choice(words) for _ in range(rng.randint(1, 12)))) for k in range(200)]
    got = scoring.unigram_alignment(spark.createDataFrame(rows + [(900, "", "x"), (901, None, "x"), (902, " ", "x")], "pair_id int, ref string, hyp string"), with_stems)
    got = {r["pair_id"]: r["score"] for r in got.collect()}
    want = {k: _plain(a.lower().split(), b.lower().split(), stems.stem if with_stems else None) for k, a, b in rows}
    assert got.keys() - {902} == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want) and got[902] == 0


def test_query_over_the_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    got = {r["pair_id"]: r["score"] for r in registry.QUERIES["stemmed_alignment"](spark, sf).collect()}
    p = pair(spark, sf).withColumn("hyp", F.when(F.col("pair_id") % 2 == 0, F.regexp_replace("hyp", r"([a-z]{4,}) ", "$1ness ")).otherwise(F.col("hyp")))
    rows = [r for r in scoring.admitted(p).select("pair_id", scoring.words(F.lower("ref")).alias("r"), scoring.words(F.lower("hyp")).alias("h")).collect()]
    assert len(got) == len(rows)
    for r in itertools.islice((r for r in rows if len(r["r"]) * len(r["h"]) < 40_000), 60):
        assert abs(got[r["pair_id"]] - _plain(r["r"], r["h"], stems.stem)) < 1e-7
