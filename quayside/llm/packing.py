"""Packing documents into sequences of a fixed length by minimum bin slack.

Each partition packs its own documents, so nothing is shuffled. What remains of a document after its whole
sequences goes to a pool of lengths with counts. For each next sequence, a subset-sum dynamic programme over bit
sets finds the multiset of remaining lengths that comes closest to the capacity, the largest remaining length
taken first; the counts are traced back, and the multiset is used as often as the counts allow. Slack that no
multiset closes is filled by cutting a piece. The last, partial sequence of a pool is cut into powers of two.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.llm._common import text_blocks, text_of


def best_fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """Of the multisets of ``counts`` with a sum of at most ``capacity``, one with the largest sum."""
    reached, states, full = 1, [], 1 << capacity
    mask = (1 << (capacity + 1)) - 1
    for length in sorted((x for x in counts if x <= capacity and counts[x]), reverse=True):
        left, part = min(counts[length], capacity // length), 1
        while left and not reached & full:  # binary splitting of the count
            take = min(part, left)
            states.append((reached, length, take))
            reached |= (reached << (length * take)) & mask
            left -= take
            part *= 2
        if reached & full:
            break
    at, used = reached.bit_length() - 1, defaultdict(int)
    for before, length, take in reversed(states):
        if not before >> at & 1:
            at -= length * take
            used[length] += take
    return dict(used)


def pool_patterns(counts: dict[int, int], capacity: int) -> Iterator[tuple[dict[int, int], int]]:
    """Multisets and how often each is used, until the counts hold less than a sequence. Takes them off ``counts``."""
    total = sum(k * v for k, v in counts.items())
    while total >= capacity:
        largest = max(counts)
        counts[largest] -= 1
        used = best_fill(counts, capacity - largest)
        counts[largest] += 1
        used[largest] = used.get(largest, 0) + 1
        times = min(counts[k] // v for k, v in used.items())
        fill = sum(k * v for k, v in used.items())
        slack = capacity - fill
        times = times if not slack else 1
        for k, v in used.items():
            counts[k] -= v * times
            if not counts[k]:
                del counts[k]
        total -= fill * times
        if slack:
            longest = max(counts)  # longer than the slack, or it would have been taken
            counts[longest] -= 1
            if not counts[longest]:
                del counts[longest]
            counts[longest - slack] = counts.get(longest - slack, 0) + 1
            total -= slack
            yield used | {-longest: slack}, 1
        else:
            yield used, times


def powers(n: int) -> list[int]:
    """The powers of two that make up n, largest first."""
    return [1 << k for k in range(n.bit_length() - 1, -1, -1) if n >> k & 1]


class Packer:
    """Packs the documents of one task. Pieces are (row, start, length, sequence, offset)."""

    def __init__(self, capacity: int):
        self.capacity, self.sequence = capacity, 0
        self.pool: dict[int, list[tuple[int, int]]] = defaultdict(list)  # by length: row, start

    def add(self, lengths: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """Whole sequences of each document; the rest goes to the pool."""
        out = []
        for row, n in enumerate(lengths.tolist()):
            whole = n // self.capacity
            for k in range(whole):
                out.append((row, k * self.capacity, self.capacity, self.sequence, 0))
                self.sequence += 1
            if rest := n - whole * self.capacity:
                self.pool[rest].append((row, whole * self.capacity))
        return out

    def flush(self) -> list[tuple[int, int, int, int, int]]:
        out = []
        for used, times in pool_patterns({k: len(v) for k, v in self.pool.items()}, self.capacity):
            for _ in range(times):
                offset = 0
                for length, n in used.items():
                    if length > 0:
                        for _ in range(n):
                            row, start = self.pool[length].pop()
                            out.append((row, start, length, self.sequence, offset))
                            offset += length
                for length, cut in used.items():
                    if length < 0:
                        row, start = self.pool[-length].pop()
                        out.append((row, start, cut, self.sequence, offset))
                        self.pool[-length - cut].append((row, start + cut))
                self.sequence += 1
        rest = [(length, row, start) for length in sorted(self.pool, reverse=True) for row, start in self.pool[length]]
        self.pool.clear()
        for size in powers(sum(x[0] for x in rest)):
            offset = 0
            while offset < size:
                length, row, start = rest.pop()
                take = min(length, size - offset)
                out.append((row, start, take, self.sequence, offset))
                offset += take
                if take < length:
                    rest.append((length - take, row, start + take))
            self.sequence += 1
        return out


def pack_sequences(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", flush_tokens: int = 3_000_000) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, doc_tokens, sequence_id, offset, ids (binary, 32 bit each).

    A document is its text's ids and then ``end_id``; null text counts as empty, so every row has a piece. Every
    id lies in one piece. Sequences are full, or hold a power of two of ids. Rows with equal ids are packed as documents of
    their own; null ids stay null. Memory holds the ids of up to ``flush_tokens`` and the longest text; the pool is
    emptied whenever it has as many. ``sequence_id`` is unique over all partitions and not dense.
    """
    if capacity & (capacity - 1):
        raise ValueError("the capacity has to be a power of two")
    from pyspark import TaskContext

    from quayside.llm.byte_bpe import shared

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text_of(text_col).alias("text"))
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, base = shared(tokenizer_path), TaskContext.get().partitionId() << 40
        packer, held = Packer(capacity), []

        def emit() -> Iterator[pa.RecordBatch]:
            doc_ids = pa.concat_arrays([h[0] for h in held])
            counts = np.concatenate([h[2] for h in held])
            tokens = np.concatenate([h[1] for h in held])
            begins = np.cumsum(counts) - counts
            pieces = np.array([*packer.add(counts), *packer.flush()], dtype=np.int64).reshape(-1, 5)
            raw = tokens.astype("<u4").tobytes()
            for i in range(0, len(pieces), 4096):
                row, start, length, sequence, offset = pieces[i : i + 4096].T
                at = (begins[row] + start) * 4
                ids = [raw[a:b] for a, b in zip(at.tolist(), (at + length * 4).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([doc_ids.take(pa.array(row)), pa.array(start), pa.array(length), pa.array(counts[row]), pa.array(sequence + base), pa.array(offset), pa.array(ids, type=pa.binary())], schema=schema)

        size = 0
        for piece in text_blocks(batches, "text", 1 << 20):
            ids, counts = bpe.encode(piece.column("text"))
            with_end = np.full(len(ids) + len(counts), end_id, dtype=np.int32)
            keep = np.ones(len(with_end), dtype=bool)
            keep[np.cumsum(counts + 1) - 1] = False
            with_end[keep] = ids
            held.append((piece.column("id"), with_end, counts + 1))
            size += len(with_end)
            if size >= flush_tokens:
                yield from emit()
                held, size = [], 0
        if held:
            yield from emit()

    return rows.mapInArrow(pack, "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")
