"""Bags of word shingles and their weighted MinHash signatures, vectorised over blocks of texts."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa

from quayside.llm.chunks import sums, text_bytes

U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, dtype=bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True
_BASE, _SHINGLE = 0x9E3779B97F4A7C15, U(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit numbers without visible order (splitmix64's finaliser)."""
    x = x + U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BYTE = mix(np.arange(256, dtype=np.uint64))


@functools.lru_cache(maxsize=2)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2**64."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        p = np.empty(1 << bits, dtype=np.uint64)
        p[0] = 1
        for k in range(bits):
            p[1 << k : 2 << k] = p[: 1 << k] * U(pow(base, 1 << k, 1 << 64))
        out.append(p)
    return out[0], out[1]


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words end to end, and where each text's begin, the end last.

    Words are runs of ASCII letters (in lower case), digits and all other characters beyond ASCII.
    """
    buf, edges = text_bytes(texts)
    inside = _WORD[buf]
    inside[int(edges[-1]) :] = False
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    ends_at = inside.copy()
    ends_at[:-1] &= ~inside[1:]
    first = edges[:-1][edges[:-1] < edges[1:]]
    begin[first] |= inside[first]
    cut = first[first > 0] - 1
    ends_at[cut] |= inside[cut]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(ends_at) + 1
    up, down = _powers(max(21, int(len(buf) + 1).bit_length()))
    total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(_BYTE[_LOWER[buf]] * up[: len(buf)])])
    h = mix((total[ends] - total[starts]) * down[starts] ^ (ends - starts).astype(np.uint64))
    return h, np.searchsorted(starts, edges)


def bags(texts: pa.Array, size: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle hash, count) of all distinct shingles by text and hash, and the number of words of each text.

    A text of fewer words than ``size`` has one shingle of all its words; one without words has none.
    """
    h, at = words(texts)
    n = np.diff(at)
    shingles = np.maximum(np.minimum(n, 1), n - size + 1)
    text = np.repeat(np.arange(len(n)), shingles)
    ends = np.cumsum(shingles)
    start = np.arange(len(text)) - np.repeat(ends - shingles, shingles) + at[text]
    limit = at[text + 1]
    padded = np.concatenate([h, np.zeros(size, dtype=np.uint64)])
    s = padded[start].copy()
    for j in range(1, size):
        s = s * _SHINGLE + np.where(start + j < limit, padded[start + j], U(0)) + U(j)
    s = mix(s)
    order = np.lexsort((s, text))
    s, text = s[order], text[order]
    new = np.ones(len(s), dtype=bool)
    new[1:] = (s[1:] != s[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    return text[first], s[first], np.diff(first, append=len(s)), n


def uniform(x: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) from 64-bit hashes."""
    return ((x >> U(11)).astype(np.float64) + 0.5) * 2.0**-53


def signatures(text: np.ndarray, shingle: np.ndarray, count: np.ndarray, n_texts: int, m: int) -> np.ndarray:
    """BagMinHash signatures: two texts agree in a component with the probability of their weighted Jaccard similarity.

    Each shingle has, for each component, a Poisson process in time over the levels 1, 2, ... of its count; a point at
    a level counts if the bag holds the shingle that often, and a component takes the earliest point. The levels are
    grouped as 1, 2, 3-4, 5-8, ..., with one process for each group and all components together: a point draws
    its component and its level, and is passed over if the level is above the count. Points are drawn in order of
    time up to a horizon that fills nearly all components; texts with an empty component get twice the horizon.
    """
    out = np.zeros((n_texts, m), dtype=np.uint64)
    total = np.bincount(text, weights=count, minlength=n_texts)
    todo = np.flatnonzero(total > 0)
    groups = np.maximum(1, np.ceil(np.log2(np.maximum(count, 1))).astype(np.int64) + 1)
    groups = np.where(count == 1, 1, groups)
    row = np.repeat(np.arange(len(text)), groups)
    ends = np.cumsum(groups)
    group = np.arange(len(row)) - np.repeat(ends - groups, groups)
    low = np.where(group == 0, 0, 1 << np.maximum(group - 1, 0))
    width = np.where(group <= 1, 1, low)
    seed = mix(shingle[row] ^ mix(group.astype(np.uint64)))
    doc, most = text[row], count[row]
    horizon = (np.log(m) + 2.0) / np.maximum(total, 1)
    first = -np.log(uniform(mix(seed))) / (m * width)  # the time of the first point
    live = np.ones(len(row), dtype=bool)
    while len(todo):
        pick = np.flatnonzero(live & (first <= horizon[doc]))
        time, k = first[pick], 0
        docs, times, parts, values = [], [], [], []
        while len(pick):
            point = mix(seed[pick] + U(0x632BE59BD9B4E019 * (k + 1) % (1 << 64)))
            level = low[pick] + 1 + (uniform(mix(point ^ U(1))) * width[pick]).astype(np.int64)
            ok = level <= most[pick]
            docs.append(doc[pick][ok])
            times.append(time[ok])
            parts.append((mix(point[ok] ^ U(2)) % U(m)).astype(np.int64))
            values.append(point[ok])
            time = time - np.log(uniform(mix(point ^ U(3)))) / (m * width[pick])
            k += 1
            on = time <= horizon[doc[pick]]
            pick, time = pick[on], time[on]
        if docs:
            d, t, c, v = map(np.concatenate, (docs, times, parts, values))
            late_first = np.argsort(-t)
            slot = d[late_first] * m + c[late_first]
            filled = np.zeros(n_texts * m, dtype=bool)
            filled[slot] = True
            flat = out.reshape(-1)
            flat[slot] = v[late_first]
            full = filled.reshape(n_texts, m).all(axis=1)
        else:
            full = np.zeros(n_texts, dtype=bool)
        todo = todo[~full[todo]]
        again = np.zeros(n_texts, dtype=bool)
        again[todo] = True
        live = again[doc]
        horizon[todo] *= 2
    return out


def bands(signature: np.ndarray, rows: int) -> np.ndarray:
    """One hash for each band of ``rows`` components."""
    n, m = signature.shape
    parts = signature.reshape(n, m // rows, rows)
    h = np.broadcast_to(mix(np.arange(m // rows, dtype=np.uint64)), (n, m // rows)).copy()
    for j in range(rows):
        h = mix(h ^ parts[:, :, j])
    return h


def fingerprints(text: np.ndarray, shingle: np.ndarray, count: np.ndarray, n_texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two sums over each bag by which equal bags are known, and the bags' sizes."""
    edges = np.searchsorted(text, np.arange(n_texts + 1))
    c = count.astype(np.uint64)
    return sums(mix(shingle ^ U(11)) * c, edges), sums(mix(shingle ^ U(13)) * c, edges), sums(count, edges)


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> int:
    """Sum over shingles of the smaller count; each bag as sorted shingles and counts."""
    at = np.searchsorted(b[0], a[0])
    at[at == len(b[0])] = 0
    same = b[0][at] == a[0] if len(b[0]) else np.zeros(len(a[0]), dtype=bool)
    return int(np.minimum(a[1][same], b[1][at[same]]).sum())
