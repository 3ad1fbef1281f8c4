"""Hashed word shingles of many texts at once, in numpy.

Texts are folded (A-Z lower-cased, separators to single spaces). A shingle is five consecutive words, or all words of a
text that has fewer. Its hash is that of its bytes: a polynomial over table-mapped bytes modulo 2**64, taken from prefix
sums, so that every shingle costs one subtraction and one product, whatever its place in the text.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np

from siltstone.llm.common import FOLD, splitmix

WORDS = 5
BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
TABLE = splitmix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
SEGMENT = 4 << 20


@lru_cache(2)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    n = 1 << bits
    with np.errstate(over="ignore"):
        return tuple(np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(n, b, np.uint64), dtype=np.uint64))) for b in (BASE, pow(BASE, -1, 1 << 64)))


def _segments(raw: bytes, k: int) -> list[tuple[bytes, int]]:
    """A folded text cut at spaces into parts of about SEGMENT bytes, each starting with the last k - 1 words before it; and how many words that are."""
    if len(raw) <= SEGMENT or len(raw.split(None, k)) < k:
        return [(raw, 0)]
    out, at = [], 0
    while at < len(raw):
        end = raw.find(b" ", min(at + SEGMENT, len(raw)))
        end = len(raw) if end < 0 else end
        carry = out[-1][0].split()[-(k - 1) :] if out and k > 1 else []
        out.append((b" ".join([*carry, raw[at:end]]), len(carry)))
        at = end
    return out


def hashed(texts: list[bytes], k: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """``(hashes, first, words, keys)``: shingle hashes of all texts, one after the other and with repeats; where each text's begin (length + 1 values); each text's number of words; the MD5 of each folded text."""
    many = [_segments(t.translate(FOLD), k) for t in texts]
    owner = np.repeat(np.arange(len(many)), [len(x) for x in many])
    parts = [p for x in many for p, _ in x]
    carried = [n for x in many for _, n in x]
    groups, size = [[]], 0
    for i, p in enumerate(parts):
        if groups[-1] and size + len(p) > SEGMENT:
            groups.append([])
            size = 0
        groups[-1].append(i)
        size += len(p)
    hashes, counts, words = [], np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    digest = [hashlib.md5() for _ in texts]
    for group in groups:
        if not group:
            continue
        h, n, w, folded = _hash_group([parts[i] for i in group], [len(many[owner[i]]) > 1 for i in group], k)
        hashes.append(h)
        np.add.at(counts, owner[group], n)
        for j, i in enumerate(group):
            new = folded[j].split(b" ", carried[i])[carried[i] :] if carried[i] else [folded[j]]
            if new and new[0]:
                digest[owner[i]].update(b" " * int(words[owner[i]] > 0) + new[0])
            words[owner[i]] += w[j] - carried[i]
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), np.concatenate(([0], np.cumsum(counts))), words, [d.digest() for d in digest]


def _hash_group(parts: list[bytes], cut: list[bool], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    data = np.frombuffer(b" ".join(parts) + b" ", np.uint8)
    solid = data != 32
    edge = np.diff(np.concatenate(([False], solid)).view(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    begins = np.concatenate(([0], np.cumsum([len(p) + 1 for p in parts])))
    first = np.searchsorted(start, begins)  # first word of each part
    n_words = np.diff(first)
    norm = data[solid | np.concatenate(([False], solid[:-1]))]  # each word and one space
    length = end - start
    left = np.concatenate(([0], np.cumsum(length + 1)))
    power, inverse = _powers(max(16, int(len(norm)).bit_length()))
    with np.errstate(over="ignore"):
        prefix = np.concatenate((np.zeros(1, np.uint64), np.cumsum(TABLE[norm] * power[: len(norm)], dtype=np.uint64)))
        n_shingles = np.where(n_words >= k, n_words - k + 1, np.minimum(n_words, 1))
        n_shingles = np.where(np.array(cut) & (n_words < k), 0, n_shingles)  # a part of a long text has whole shingles only
        part = np.repeat(np.arange(len(parts)), n_shingles)
        word = np.arange(len(part)) - np.repeat(np.concatenate(([0], np.cumsum(n_shingles)[:-1])), n_shingles) + first[:-1][part]
        last = word + np.minimum(k, n_words[part]) - 1
        a, b = left[word], left[last] + length[last]
        out = splitmix((prefix[b] - prefix[a]) * inverse[a])
    raw = norm.tobytes()
    edges = left[first]
    folded = [raw[edges[i] : max(edges[i], edges[i + 1] - 1)] for i in range(len(parts))]
    return out, n_shingles, n_words, folded


def distinct(hashes: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """Each text's sorted distinct hashes."""
    return [np.unique(hashes[first[i] : first[i + 1]]) for i in range(len(first) - 1)]
