"""Suffix stripping after Porter (1980), with the amendments that are usual in text scoring."""
from __future__ import annotations

import functools
import re

# Rules in the order in which they are tried, (suffix, replacement, least measure of what is before it).
PLURAL = [("sses", "ss", 0), ("ies", "i", 0), ("ss", "ss", 0), ("s", "", 0)]
LONG = [
    ("ational", "ate", 1), ("tional", "tion", 1), ("enci", "ence", 1), ("anci", "ance", 1), ("izer", "ize", 1), ("bli", "ble", 1), ("alli", "al", 1),
    ("entli", "ent", 1), ("eli", "e", 1), ("ousli", "ous", 1), ("ization", "ize", 1), ("ation", "ate", 1), ("ator", "ate", 1), ("alism", "al", 1),
    ("iveness", "ive", 1), ("fulness", "ful", 1), ("ousness", "ous", 1), ("aliti", "al", 1), ("iviti", "ive", 1), ("biliti", "ble", 1), ("fulli", "ful", 1),
]
MIDDLE = [("icate", "ic", 1), ("ative", "", 1), ("alize", "al", 1), ("iciti", "ic", 1), ("ical", "ic", 1), ("ful", "", 1), ("ness", "", 1)]
SHORT = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()
# Words with a stem of their own.
IRREGULAR = {
    "sky": "sky", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news", "innings": "inning", "inning": "inning",
    "outings": "outing", "outing": "outing", "cannings": "canning", "canning": "canning", "howe": "howe", "proceed": "proceed",
    "exceed": "exceed", "succeed": "succeed",
}

_TURNS = re.compile("v+c+")


def shape(word: str) -> str:
    """``v`` or ``c`` for every letter; y is a vowel after a consonant."""
    out = ""
    for c in word:
        out += "v" if c in "aeiou" or (c == "y" and out.endswith("c")) else "c"
    return out


def measure(word: str) -> int:
    """Changes from vowels to consonants."""
    return len(_TURNS.findall(shape(word)))


def _short(word: str) -> bool:
    """Ends in consonant, vowel, consonant other than w, x, y; or is a vowel and a consonant."""
    s = shape(word)
    return (s.endswith("cvc") and word[-1] not in "wxy") or s == "vc"


def _by(rules: list[tuple[str, str, int]], word: str) -> str:
    """The first rule whose suffix fits decides, also if its measure forbids the change."""
    for suffix, new, least in rules:
        if word.endswith(suffix):
            before = word[: len(word) - len(suffix)]
            return before + new if not least or measure(before) >= least else word
    return word


def _tense(word: str) -> str:
    if word.endswith("ied"):
        return word[:-1] if len(word) == 4 else word[:-2]
    if word.endswith("eed"):
        return word[:-1] if measure(word[:-3]) else word
    for suffix in ("ed", "ing"):
        before = word[: len(word) - len(suffix)]
        if word.endswith(suffix) and "v" in shape(before):
            if before.endswith(("at", "bl", "iz")):
                return before + "e"
            if len(before) > 1 and before[-1] == before[-2] and shape(before).endswith("c"):
                return before if before[-1] in "lsz" else before[:-1]
            return before + "e" if measure(before) == 1 and _short(before) else before
    return word


def _noun(word: str) -> str:
    if word.endswith("alli") and measure(word[:-4]):
        return _noun(word[:-2])
    if word.endswith("logi") and not any(word.endswith(s) for s, _, _ in LONG):
        return word[:-1] if measure(word[:-3]) else word
    return _by(LONG, word)


def _ending(word: str) -> str:
    for suffix in SHORT:
        if word.endswith(suffix):
            before = word[: len(word) - len(suffix)]
            return before if measure(before) > 1 and (suffix != "ion" or before[-1:] in ("s", "t")) else word
    return word


@functools.lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """The stem of a lower-case word. Words of one or two letters stay."""
    if word in IRREGULAR or len(word) <= 2:
        return IRREGULAR.get(word, word)
    word = word[:-1] if word.endswith("ies") and len(word) == 4 else _by(PLURAL, word)
    word = _tense(word)
    if word.endswith("y") and len(word) > 2 and shape(word)[-2] == "c":
        word = word[:-1] + "i"
    word = _ending(_by(MIDDLE, _noun(word)))
    if word.endswith("e"):
        m = measure(word[:-1])
        if m > 1 or (m == 1 and not _short(word[:-1])):
            word = word[:-1]
    return word[:-1] if word.endswith("ll") and measure(word[:-1]) > 1 else word
