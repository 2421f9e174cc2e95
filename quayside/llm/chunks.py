"""A table of text chunks and what each stands for, so that a chunk seen before costs a few numpy steps.

Texts repeat their words. An encoder whose result never crosses certain places can work on each distinct chunk
between them once and join results with numpy. Chunks of up to 32 bytes are told apart by their bytes as four
64-bit words (sorted by a hash of these, then compared in full), longer ones by a dictionary. The table is
bounded: when full, it starts afresh.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa

WORDS = 4
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts (padded by 64 zeros) and where each begins, the end last. Null is the empty text."""
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    size = int(ends[-1] - ends[0])
    buf = np.zeros(size + 64, dtype=np.uint8)
    if size:
        buf[:size] = np.frombuffer(texts.buffers()[2], dtype=np.uint8)[ends[0] : ends[-1]]
    return buf, ends - ends[0]


def _mix(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


class ChunkTable:
    """``compute(chunks)`` gives the integer arrays of new chunks (bytes); ``look_up`` numbers them."""

    def __init__(self, compute: Callable[[list[bytes]], list[np.ndarray]], max_entries: int = 500_000, max_values: int = 4_000_000):
        self.compute, self.max_entries, self.max_values = compute, max_entries, max_values
        self.reset()

    def reset(self) -> None:
        self.hashes = np.empty(0, dtype=np.uint64)  # sorted
        self.numbers = np.empty(0, dtype=np.int64)  # of the entries, in the order of hashes
        self.words = np.empty((WORDS + 1, 1 << 14), dtype=np.uint64)  # of the entries: bytes, then length
        self.long: dict[bytes, int] = {}
        self.values = np.empty(1 << 16, dtype=np.int32)
        self.starts = np.empty(1 << 14, dtype=np.int64)
        self.lengths = np.empty(1 << 14, dtype=np.int64)
        self.filled = self.used = 0

    def _add(self, chunks: list[bytes]) -> np.ndarray:
        """Numbers of these new entries."""
        at = self.filled
        for i in range(0, len(chunks), 65_536):
            got = self.compute(chunks[i : i + 65_536])
            lengths = np.fromiter(map(len, got), dtype=np.int64, count=len(got))
            total = int(lengths.sum())
            if self.filled + len(got) > len(self.starts):
                n = 2 * (self.filled + len(got))
                self.starts, self.lengths = np.resize(self.starts, n), np.resize(self.lengths, n)
            if self.used + total > len(self.values):
                self.values = np.resize(self.values, 2 * (self.used + total))
            self.starts[self.filled : self.filled + len(got)] = self.used + np.cumsum(lengths) - lengths
            self.lengths[self.filled : self.filled + len(got)] = lengths
            if total:
                np.concatenate(got, out=self.values[self.used : self.used + total], casting="unsafe")
            self.used += total
            self.filled += len(got)
        return np.arange(at, self.filled)

    def look_up(self, buf: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The entry of each chunk; new ones are computed. ``buf`` has 32 bytes at least after the last chunk."""
        if self.filled > self.max_entries or self.used > self.max_values:
            self.reset()
        at8 = np.ndarray((len(buf) - 7,), dtype="<u8", buffer=buf, strides=(1,))
        words = [at8[starts] & _MASKS[np.minimum(lengths, 8)]]
        for k in range(1, WORDS):
            words.append(np.zeros(len(starts), dtype=np.uint64))
            if len(more := np.flatnonzero(lengths > 8 * k)):
                words[k][more] = at8[starts[more] + 8 * k] & _MASKS[np.minimum(lengths[more] - 8 * k, 8)]
        words.append(lengths.astype(np.uint64))
        h = words[0] * _ODD[0]
        for k in range(1, WORDS + 1):
            h += _mix(words[k] * _ODD[k]) if k < WORDS else words[k] * _ODD[k]
        h = _mix(h)
        order = np.argsort(h)
        ordered = h[order]
        new = np.ones(len(h), dtype=bool)
        new[1:] = ordered[1:] != ordered[:-1]
        group = np.empty(len(h), dtype=np.int64)
        group[order] = np.cumsum(new) - 1
        leaders = order[new]
        distinct = ordered[new]
        odd = lengths > 8 * WORDS
        for w in words:
            odd |= w[leaders][group] != w
        place = np.searchsorted(self.hashes, distinct)
        numbers = np.full(len(distinct), -1, dtype=np.int64)
        inside = place < len(self.hashes)
        hit = np.flatnonzero(inside)
        hit = hit[self.hashes[place[hit]] == distinct[hit]]
        numbers[hit] = self.numbers[place[hit]]
        clash = np.zeros(len(distinct), dtype=bool)
        for k, w in enumerate(words):
            clash[hit] |= self.words[k][numbers[hit]] != w[leaders[hit]]
        short = ~odd[leaders] & (numbers < 0)
        fresh = np.flatnonzero(short)
        if len(fresh):
            data, first = buf.data, leaders[fresh]
            numbers[fresh] = self._add([bytes(data[s:e]) for s, e in zip(starts[first].tolist(), (starts[first] + lengths[first]).tolist(), strict=True)])
            if self.words.shape[1] < self.filled:
                grown = np.empty((WORDS + 1, 2 * self.filled), dtype=np.uint64)
                grown[:, : self.words.shape[1]] = self.words
                self.words = grown
            for k, w in enumerate(words):
                self.words[k][numbers[fresh]] = w[first]
            self.hashes = np.insert(self.hashes, place[fresh], distinct[fresh])
            self.numbers = np.insert(self.numbers, place[fresh], numbers[fresh])
        out = numbers[group]
        rest = np.flatnonzero(odd | clash[group] | (out < 0))
        if len(rest):
            self._long(buf, starts, lengths, rest, out)
        return out

    def _long(self, buf: np.ndarray, starts: np.ndarray, lengths: np.ndarray, rest: np.ndarray, out: np.ndarray) -> None:
        data = buf.data
        keys = [bytes(data[s:e]) for s, e in zip(starts[rest].tolist(), (starts[rest] + lengths[rest]).tolist(), strict=True)]
        fresh = [k for k in dict.fromkeys(keys) if k not in self.long]
        if fresh:
            numbers = self._add(fresh)
            if self.words.shape[1] < self.filled:
                grown = np.empty((WORDS + 1, 2 * self.filled), dtype=np.uint64)
                grown[:, : self.words.shape[1]] = self.words
                self.words = grown
            self.long.update(zip(fresh, numbers.tolist(), strict=True))
        out[rest] = [self.long[k] for k in keys]

    def gather(self, entries: np.ndarray) -> np.ndarray:
        """The arrays of these entries, end to end."""
        lengths = self.lengths[entries]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        return self.values[np.repeat(self.starts[entries] - ends + lengths, lengths) + np.arange(total)]


def cut(boundary: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and lengths of the chunks that begin where ``boundary`` is true or a text begins, and each text's first.

    ``edges``: where texts begin, the end last. Empty texts have no chunk.
    """
    size = int(edges[-1])
    begins = edges[:-1][edges[:-1] < edges[1:]]
    boundary[begins] = True
    starts = np.flatnonzero(boundary[:size])
    lengths = np.diff(starts, append=size)
    return starts, lengths, np.searchsorted(starts, edges)


def sums(values: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Sums of values[firsts[k]:firsts[k + 1]], also of none."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[firsts[1:]] - total[firsts[:-1]]
