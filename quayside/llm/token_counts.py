"""Exact token counts of every prefix of a text, by dynamic programming over a BPE vocabulary.

The last token of a prefix decides the rest: what stands before it is the encoding of the shorter prefix. So the
count of a prefix is one more than that of the prefix before its last token, and the last token is the one piece
that ends there and stays apart from the last token of the shorter prefix. Prefixes that words share are worked
out once. Truncation and budget questions are then answered from the counts, without encoding again.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.llm._common import text_blocks, text_of
from quayside.llm.chunks import ChunkTable, cut, text_bytes
from quayside.llm.pieces import NORMAL, SPACE, Cuts, PieceModel


class PrefixCounts:
    """Counts of all prefixes of texts for a SentencePiece BPE model. Positions are characters (code points)."""

    def __init__(self, path: str, max_prefixes: int = 700_000):
        self.model = PieceModel.load(path)
        if not self.model.by_chunk():
            raise ValueError("needs a BPE model that keeps texts as they are and has no piece with an inner space")
        self.rank = {p: score for p, score, kind in self.model.pieces if kind == NORMAL}
        self.longest = max(map(len, self.rank))
        self.cuts = Cuts(self.model)
        self.max_prefixes = max_prefixes
        self.states: dict[str, tuple[int, str]] = {}  # by prefix of a chunk: count, last token
        self.apart: dict[tuple[str, str], bool] = {}
        self.tail_lengths: dict[str, tuple[int, ...]] = {}
        by_end: dict[str, set[int]] = {}
        for p in self.rank:
            by_end.setdefault(p[-1], set()).add(len(p))
        self.tail_lengths = {c: tuple(sorted(n, reverse=True)) for c, n in by_end.items()}
        # entries hold for each chunk: its count, then the counts of all its prefixes
        self.table = ChunkTable(self._compute, max_entries=800_000, max_values=16_000_000)

    def merge(self, text: str) -> list[str]:
        """BPE of a short string: the best-scored pair, leftmost of equals, is joined again and again."""
        parts = list(text)
        rank = self.rank
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = rank.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _apart(self, a: str, b: str) -> bool:
        key = (a, b)
        got = self.apart.get(key)
        if got is None:
            if len(self.apart) > 500_000:
                self.apart.clear()
            got = self.apart[key] = (a[-1] + b[0] not in self.rank and len(a) == 1 == len(b)) or self.merge(a + b) == [a, b]
        return got

    def _cost(self, token: str) -> int:
        return 1 if token in self.rank else len(token.encode()) if self.model.byte_fallback else 1

    def _last(self, text: str, i: int, state) -> tuple[int, str]:
        """Count and last token of text[:i]; ``state(j)`` gives those of text[:j]."""
        rank = self.rank
        for n in self.tail_lengths.get(text[i - 1], (1,)):
            if n > i:
                continue
            token = text[i - n : i]
            if n > 1 and token not in rank:
                continue
            count, before = state(i - n)
            if not before or self._apart(before, token):
                return count + self._cost(token), token
        token = text[i - 1]
        return state(i - 1)[0] + self._cost(token), token

    def profile(self, chunk: str) -> list[int]:
        """Counts of chunk[:0], chunk[:1] up to the whole chunk."""
        states, n = self.states, len(chunk)
        if n > 48:
            own = [(0, "")]
            for i in range(1, n + 1):
                own.append(self._last(chunk, i, own.__getitem__))
            return [c for c, _ in own]
        prefixes = [chunk[:i] for i in range(1, n + 1)]
        own, known = [(0, "")], True
        for i, p in enumerate(prefixes, 1):
            got = states.get(p) if known else None
            if got is None:
                known = False
                got = states[p] = self._last(chunk, i, own.__getitem__)
            own.append(got)
        return [c for c, _ in own]

    def _compute(self, chunks: list[bytes]) -> list[np.ndarray]:
        if len(self.states) > self.max_prefixes:
            self.states = {}
        out = []
        for raw in chunks:
            counts = self.profile(raw.decode().replace(" ", SPACE))
            out.append(np.array([counts[-1], *counts[1:]], dtype=np.int32))
        return out

    def prefix_counts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Counts of all prefixes of the texts end to end, and where each text's begin, the end last.

        A text of n characters has n + 1 counts, of its first 0, 1, ..., n characters. Null is the empty text.
        """
        # the model puts a space before each text, as any word but a text's first has one
        filled = texts.fill_null("") if texts.null_count else texts
        spaced = pc.binary_join_element_wise(pa.scalar("", pa.large_string()), filled.cast(pa.large_string()), pa.scalar(" ", pa.large_string())) if len(filled) else filled
        buf, edges = text_bytes(spaced)
        starts, lengths, firsts = cut(self.cuts(buf), edges)
        entries = self.table.look_up(buf, starts, lengths)
        sizes = self.table.lengths[entries] - 1  # characters
        whole = self.table.values[self.table.starts[entries]]
        before = np.cumsum(whole) - whole
        chunk_text = np.repeat(np.arange(len(edges) - 1), np.diff(firsts))
        before = before - before[firsts[chunk_text]] if len(entries) else before
        ends = np.cumsum(sizes)
        flat = self.table.values[np.repeat(self.table.starts[entries] + 1 - ends + sizes, sizes) + np.arange(int(ends[-1]) if len(ends) else 0)]
        flat = flat + np.repeat(before, sizes)
        per_text = np.concatenate([[0], np.cumsum(np.concatenate([[0], ends])[firsts[1:]] - np.concatenate([[0], ends])[firsts[:-1]])])
        flat[per_text[:-1]] = 0  # the space alone stands for the empty text, which has no token
        return flat, per_text


@functools.lru_cache(maxsize=1)
def shared(path: str) -> PrefixCounts:
    return PrefixCounts(path)


def longest_within(counts: np.ndarray, budget: int) -> int:
    """Characters of the longest prefix of at most ``budget`` tokens."""
    return int(np.flatnonzero(counts <= budget)[-1]) if len(counts) else 0


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096, with_prefixes: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_tokens, over_limit, fits_chars, and prefix_counts if asked for.

    n_tokens is the count of the whole text as the model's own library gives it; fits_chars is the length in
    characters of the longest prefix within ``limit`` tokens; prefix_counts[k] counts the tokens of the first k characters.
    Null text counts as empty: 0 tokens. Null and repeated ids are kept as they are; an empty input gives no rows;
    other columns aren't read. A text of any length is worked on whole, in memory that follows its length.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_of(text_col).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = shared(model_path)
        for block in text_blocks(batches, "text"):
            texts = block.column("text")
            flat, at = counter.prefix_counts(texts)
            n = flat[at[1:] - 1].astype(np.int64)
            fits = np.diff(at) - 1
            for k in np.flatnonzero(np.maximum.reduceat(flat, at[:-1]) > limit).tolist():
                fits[k] = longest_within(flat[at[k] : at[k + 1]], limit)
            out = [block.column("doc_id"), pc.binary_length(texts).cast(pa.int64()), pa.array(n), pa.array(n > limit), pa.array(fits)]
            names = ["doc_id", "n_bytes", "n_tokens", "over_limit", "fits_chars"]
            if with_prefixes:
                out.append(pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(flat.astype(np.int32))))
                names.append("prefix_counts")
            yield pa.RecordBatch.from_arrays(out, names=names)

    return rows.mapInArrow(count, f"doc_id {id_type}, n_bytes long, n_tokens long, over_limit boolean, fits_chars long" + ", prefix_counts array<int>" * with_prefixes)
