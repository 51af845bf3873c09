"""Plain forms of the operators, for small tables."""
import hashlib
import re
import zlib
from collections import Counter

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def simhash(text):
    words = WORD.findall(lower(text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def reach(ids, values, near):
    """Smallest id that each place reaches."""
    at = list(range(len(ids)))

    def root(i):
        while at[i] != i:
            i = at[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if near(values[i], values[j]):
                at[root(i)] = root(j)
    least = {}
    for i, d in enumerate(ids):
        least[root(i)] = min(least.get(root(i), d), d)
    return [least[root(i)] for i in range(len(ids))]


def cut(docs, window=50):
    """{doc_id: (n_bytes, n_removed, n_spans, sha256)} of (doc_id, text)."""
    least = {}
    for d, text in docs:
        raw = (text or "").encode()
        for i in range(len(raw) - window + 1):
            w = raw[i : i + window]
            least[w] = min(least.get(w, d), d)
    out = {}
    for d, text in docs:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - window + 1):
            if least[raw[i : i + window]] < d:
                gone[i : i + window] = b"\x01" * window
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out[d] = (len(raw), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return out


def base_counts(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(windows)
    covered = {j for i, w in enumerate(windows) if n[w] > 1 for j in range(i, i + 3)}
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed)


def license_base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    found = [
        (i, label) for phrase, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
        for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()
    ]
    places = [i for i, _ in found]
    return (len(words), len(found), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in found})))


def padded(text):
    raw = (text or "").encode()
    return raw.ljust(max(1, -(-len(raw) // 192)) * 192, b" ")


def crc(data):
    return zlib.crc32(data)


def sha(data):
    return hashlib.sha256(data).hexdigest()
