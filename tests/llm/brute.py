"""Plain versions of the operators, for small fixtures."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def words(text, lower=False):
    text = text or ""
    return WORD.findall(text.translate(LOWER) if lower else text)


def targets(sizes, repeats=3):
    """sizes by source -> target by source, sharing and resharing step by step."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    free, left, out = set(order), float(sum(sizes.values())), {}
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > repeats * sizes[s]}
        if not over:
            return out | share
        for s in over:
            out[s] = repeats * sizes[s]
            left -= out[s]
        free -= over
    return out


def sainte_lague(ideals, caps, total):
    """Seats by one quotient after the other."""
    seats = [0] * len(ideals)
    for _ in range(total):
        q = [(v / (2 * s + 1) if s < c else -1.0) for v, s, c in zip(ideals, seats, caps, strict=True)]
        seats[q.index(max(q))] += 1
    return seats


def shingles(text):
    w = words(text, True)
    return frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[i : i + 5]) for i in range(len(w) - 4)])


def components(rows):
    """[(doc_id, text)] -> [(doc_id, set size, component)] in the same order."""
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both, either = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if either and both and 100 * both >= 75 * either:
                up[root(i)] = root(j)
    lowest = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            lowest[root(i)] = min(doc_id, lowest.get(root(i), doc_id))
    return [(d, len(s), lowest.get(root(i))) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))]


def repeated(data, width):
    """Of each text, which bytes a string of width bytes covers that starts anywhere else too."""
    seen = Counter(b[i : i + width] for b in data for i in range(len(b) - width + 1))
    out = []
    for b in data:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - width + 1):
            if seen[b[i : i + width]] > 1:
                gone[i : i + width] = True
        out.append(gone)
    return out


def passages(rows, width=200, least=50):
    """Bytes of each text in repeated runs of over `least` whole words, word by word."""
    data = [(t or "").encode() for _, t in rows]
    out = []
    for b, gone in zip(data, repeated(data, width), strict=True):
        spans, total, i = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", b)], 0, 0
        while i < len(b):
            j = i
            while j < len(b) and gone[j]:
                j += 1
            total += j - i if sum(i <= s and e <= j for s, e in spans) > least else 0
            i = j + 1
        out.append(total)
    return out


def repeats(rows, width=400):
    """[(doc_id, text)] -> rows of op6."""
    data = [(t or "").encode() for _, t in rows]
    out = []
    for (doc_id, _), b, gone in zip(rows, data, repeated(data, width), strict=True):
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((doc_id, len(b), int(gone.sum()), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return out


def fold(doc_id, modulus, remainder):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % modulus == remainder


def distance(pattern, text):
    """Smallest edit distance of pattern to any part of text."""
    last = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        row = [i]
        for j, d in enumerate(text, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (c != d)))
        last = row
    return min(last)
