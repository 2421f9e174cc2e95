"""Two tokenizers' tokens of the same texts, aligned by an event sweep.

Each tokenizer gives end events: where in the text's bytes a token ends, and its id. The two streams of events are united,
repartitioned by document and sorted by offset within partitions; a machine then reads them in order. Where both streams have an end
it closes a group; where the byte ranges of two tokens overlap it notes a link. It holds the events since the last common
end only. Events travel in runs: a row has the offset at which its run begins and the ids that follow, from whose lengths
the ends follow.
"""

from __future__ import annotations

import functools
import hashlib
import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.llm._common import Scratch, free_name, numbered, text_blocks, text_of
from quayside.llm.byte_bpe import ByteBpe
from quayside.llm.chunks import sums, text_bytes
from quayside.llm.pieces import BYTE, SPACE, PieceModel
from quayside.llm.sentencepiece_codec import Codec

RUN = 16_384  # ids in a row of events
UNIT = 1 << 20  # ids that are swept together
PAIRS = 4_000_000  # pairs of ids whose counts are broadcast at most (48 MB); beyond, they are joined


def _byte_level() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, the others from U+0100 on."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(others)}


class Tokens:
    """A tokenizer whose ids stand for bytes: ``encode(texts)`` of a space and each text that isn't empty."""

    def __init__(self, path: str):
        if path.endswith(".json"):
            self.own = ByteBpe(path)
            self.own.library.encode_special_tokens = True
            with open(path, encoding="utf-8") as f:
                spec = json.load(f)
            known = spec["model"]["vocab"] | {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
            to_byte, size = _byte_level(), max(known.values()) + 1
            spelled = [b""] * size
            for token, i in known.items():
                spelled[i] = bytes(to_byte[c] for c in token) if all(c in to_byte for c in token) else token.encode()
        else:
            self.own = Codec(path, 1)
            spelled = [bytes([int(p[3:5], 16)]) if kind == BYTE else p.replace(SPACE, " ").encode() for p, _, kind in PieceModel.load(path).pieces]
        self.lengths = np.array([len(b) for b in spelled], dtype=np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(spelled) or b"\0", dtype=np.uint8)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids end to end, the number of ids of each text, and whether a text's ids spell a space and the text."""
        filled = texts.fill_null("").cast(pa.large_string())
        spaced = pc.if_else(pc.equal(filled, ""), filled, pc.binary_join_element_wise(pa.scalar("", pa.large_string()), filled, pa.scalar(" ", pa.large_string()))) if len(filled) else filled
        ids, counts = self.own.encode(filled)[:2] if isinstance(self.own, Codec) else self.own.encode(spaced)
        buf, edges = text_bytes(spaced)
        sizes = np.diff(edges)
        firsts = np.concatenate([[0], np.cumsum(counts)])
        n = self.lengths[ids]
        good = sums(n, firsts) == sizes
        if not good.all():
            n = n[np.repeat(good, counts)]
            spelling = ids[np.repeat(good, counts)]
            buf = buf[: edges[-1]][np.repeat(good, sizes)]
        else:
            spelling, buf = ids, buf[: edges[-1]]
        ends = np.cumsum(n)
        spelled = self.bytes[np.repeat(self.starts[spelling] - ends + n, n) + np.arange(int(ends[-1]) if len(ends) else 0)]
        wrong = np.flatnonzero(spelled != buf)
        if len(wrong):
            among = np.flatnonzero(good)
            good[among[np.unique(np.searchsorted(np.cumsum(sizes[among]), wrong, side="right"))]] = False
        return ids, counts, good & (sizes > 0)


@functools.lru_cache(maxsize=2)
def shared(path: str) -> Tokens:
    """One tokenizer of each kind for each Python worker."""
    return Tokens(path)


def planes(values: np.ndarray) -> bytes:
    """Numbers below 2**63, squeezed: first all lowest bytes, then all next ones."""
    return pa.compress(np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes(), "zstd", asbytes=True)


def from_planes(data, n: int) -> np.ndarray:
    raw = np.frombuffer(pa.decompress(data, 8 * n, "zstd"), dtype=np.uint8).reshape(8, n)
    return np.ascontiguousarray(raw.T).view("<u8").reshape(n).astype(np.int64)


class Aligned:
    """The groups and links of many documents' tokens, which cover the same bytes in both tokenizers."""

    def __init__(self, ids: tuple[np.ndarray, np.ndarray], counts: tuple[np.ndarray, np.ndarray], lengths: tuple[np.ndarray, np.ndarray]):
        (a, b), self.counts = ids, counts
        self.ids = ids
        na, nb = lengths[0][a], lengths[1][b]
        end_a, end_b = np.cumsum(na), np.cumsum(nb)
        first = np.searchsorted(end_b, end_a - na, side="right")
        last = np.searchsorted(end_b, end_a, side="left")
        self.n_links = last - first + 1
        total = int(self.n_links.sum())
        each = np.repeat(np.cumsum(self.n_links) - self.n_links - first, self.n_links)
        self.link_a, self.link_b = np.repeat(a, self.n_links), b[np.arange(total) - each]
        meets_a, meets_b = end_b[last] == end_a, np.zeros(len(b), dtype=bool)
        meets_b[last[meets_a]] = True
        # the group of each token: the common ends before it
        self.group_a, self.group_b = np.cumsum(meets_a) - meets_a, np.cumsum(meets_b) - meets_b
        self.firsts_a = np.concatenate([[0], np.cumsum(counts[0])])
        self.n_groups = sums(meets_a.astype(np.int64), self.firsts_a)
        self.doc_links = sums(self.n_links, self.firsts_a)
        self.common = meets_a

    def text(self) -> tuple[np.ndarray, np.ndarray]:
        """All groups as text (`a1,a2|b1;a3|b2`, a document's end to end) and where each document's begins, the end last."""
        (a, b), n_groups = self.ids, int(self.n_groups.sum())
        per_a, per_b = np.bincount(self.group_a, minlength=n_groups), np.bincount(self.group_b, minlength=n_groups)
        before_b, upto_a = np.cumsum(per_b) - per_b, np.cumsum(per_a)
        size = len(a) + len(b)
        ids, sign = np.empty(size, dtype=np.int64), np.full(size, ord(","), dtype=np.uint8)
        place_a, place_b = np.arange(len(a)) + before_b[self.group_a], np.arange(len(b)) + upto_a[self.group_b]
        ids[place_a], ids[place_b] = a, b
        sign[place_a[np.cumsum(per_a) - per_a]] = ord(";")
        sign[place_b[before_b]] = ord("|")
        heads = place_a[self.firsts_a[:-1][self.counts[0] > 0]]
        sign[heads] = 0
        digits = np.ones(size, dtype=np.int64)
        top = 10
        while size and (more := ids >= top).any():
            digits += more
            top *= 10
        widths = digits + (sign > 0)
        ends = np.cumsum(widths)
        out = np.empty(int(ends[-1]) if size else 0, dtype=np.uint8)
        left = ids.copy()
        for k in range(int(digits.max()) if size else 0):
            has = digits > k
            out[ends[has] - 1 - k] = 48 + left[has] % 10
            left //= 10
        starts = ends - widths
        out[starts[sign > 0]] = sign[sign > 0]
        tokens = np.concatenate([[0], np.cumsum(self.counts[0] + self.counts[1])])
        return out, np.concatenate([[0], ends])[tokens]


DOC = {"doc_id": pa.int64(), "n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(), "n_links": pa.int64(), "groups": pa.string(), "groups_sha256": pa.string(), "n_pairs": pa.int64(), "pairs": pa.binary(), "times": pa.binary()}


class Sweep:
    """Reads runs of events, sorted by document and offset."""

    def __init__(self, lengths: tuple[np.ndarray, np.ndarray], unit: int, with_groups: bool):
        self.lengths, self.unit, self.with_groups = lengths, unit, with_groups
        self.base = len(lengths[1])  # a pair of ids as a number: a * base + b
        self.whole: list[tuple] = []  # documents whose events are all here
        self.size = 0
        self.seen: list[tuple[np.ndarray, np.ndarray]] = []  # pairs, and how many documents have them
        self.n_seen = 0
        self.out: list[tuple] = []
        self.row = None

    def begin(self, row) -> None:
        self.row, self.doc_id, self.ok, self.parts, self.held = row, None, True, ([], []), 0
        self.before = None  # what a long document gave so far

    def event(self, row: int, doc_id: int | None, side: int, ok: bool, ids: np.ndarray) -> None:
        if row != self.row:
            self.end()
            self.begin(row)
        self.ok &= ok
        if side == 0:
            self.doc_id = doc_id
        if self.ok:
            self.parts[side].append(ids)
            self.held += len(ids)
            if self.held > self.unit:
                self.partly()

    def partly(self) -> None:
        """Sweep what is held of a long document up to its last common end."""
        a, b = (np.concatenate([*p, np.empty(0, dtype=np.int64)]) for p in self.parts)
        end_a, end_b = np.cumsum(self.lengths[0][a]), np.cumsum(self.lengths[1][b])
        common = np.intersect1d(end_a, end_b)
        if not len(common):
            return
        to_a, to_b = np.searchsorted(end_a, common[-1], side="right"), np.searchsorted(end_b, common[-1], side="right")
        self.add(a[:to_a], b[:to_b])
        self.parts, self.held = ([a[to_a:]], [b[to_b:]]), len(a) - to_a + len(b) - to_b

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        done = Aligned((a, b), (np.array([len(a)]), np.array([len(b)])), self.lengths)
        text, _ = done.text()
        pairs, times = np.unique(done.link_a * self.base + done.link_b, return_counts=True)
        if self.before is None:
            self.before = [0, 0, 0, 0, hashlib.sha256(), [], np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)]
        x = self.before
        piece = (b";" if x[2] else b"") + text.tobytes()
        x[:4] = x[0] + len(a), x[1] + len(b), x[2] + int(done.n_groups[0]), x[3] + int(done.doc_links[0])
        x[4].update(piece)
        if self.with_groups:
            x[5].append(piece)
        both, at = np.unique(np.concatenate([x[6], pairs]), return_inverse=True)
        x[6], x[7] = both, np.bincount(at, np.concatenate([x[7], times]), minlength=len(both)).astype(np.int64)

    def end(self) -> None:
        """The current document's events are all read."""
        if self.row is None:
            return
        none = np.empty(0, dtype=np.int64)
        if self.before is not None and self.ok:
            if self.held:
                self.add(*(np.concatenate(p) for p in self.parts))
            n_a, n_b, n_groups, n_links, sha, pieces, pairs, times = self.before
            self.note(pairs, np.ones(len(pairs), dtype=np.int64))
            self.out.append((self.doc_id, n_a, n_b, n_groups, n_links, b"".join(pieces).decode() if self.with_groups else None, sha.hexdigest(), len(pairs), planes(pairs), planes(times)))
        else:
            a, b = (np.concatenate([*p, none]) if self.ok else none for p in self.parts)
            self.whole.append((self.doc_id, a, b))
            self.size += len(a) + len(b)
        self.row = None
        if self.size > self.unit or len(self.whole) > 20_000:
            self.flush()

    def note(self, pairs: np.ndarray, docs: np.ndarray) -> None:
        self.seen.append((pairs, docs))
        self.n_seen += len(pairs)
        if self.n_seen > 2 * UNIT:
            keys, at = np.unique(np.concatenate([x for x, _ in self.seen]), return_inverse=True)
            self.seen = [(keys, np.bincount(at, np.concatenate([n for _, n in self.seen]), minlength=len(keys)).astype(np.int64))]
            self.n_seen = len(keys)

    def flush(self) -> None:
        """Sweep all whole documents together."""
        if not self.whole:
            return
        doc_ids, a, b = zip(*self.whole, strict=True)
        counts = tuple(np.array([len(x) for x in side], dtype=np.int64) for side in (a, b))
        done = Aligned((np.concatenate(a), np.concatenate(b)), counts, self.lengths)
        text, edges = done.text()
        keys = len(self.lengths[0]) * self.base
        doc = np.repeat(np.repeat(np.arange(len(doc_ids)), counts[0]), done.n_links)
        pairs, times = np.unique(doc * keys + done.link_a * self.base + done.link_b, return_counts=True)
        firsts = np.searchsorted(pairs, np.arange(len(doc_ids) + 1) * keys)
        pairs %= keys
        self.note(*np.unique(pairs, return_counts=True))
        raw, edges = text.tobytes(), edges.tolist()
        rows = zip(doc_ids, counts[0].tolist(), counts[1].tolist(), done.n_groups.tolist(), done.doc_links.tolist(), edges, edges[1:], firsts.tolist(), firsts[1:].tolist(), strict=False)
        for doc_id, n_a, n_b, n_groups, n_links, s, e, p, q in rows:
            groups = raw[s:e]
            self.out.append((doc_id, n_a, n_b, n_groups, n_links, groups.decode() if self.with_groups else None, hashlib.sha256(groups).hexdigest() if n_a else "", q - p, planes(pairs[p:q]), planes(times[p:q])))
        self.whole, self.size = [], 0

    def rows(self) -> Iterator[pa.RecordBatch]:
        if self.out:
            columns = [pa.array([r[k] for r in self.out], kind) for k, kind in enumerate(DOC.values())]
            none = pa.nulls(len(self.out), pa.int64())
            self.out = []
            yield pa.RecordBatch.from_arrays([*columns, none, none], names=[*DOC, "pair", "n_docs"])

    def counts(self) -> Iterator[pa.RecordBatch]:
        for pairs, docs in self.seen:
            none = [pa.nulls(len(pairs), kind) for kind in DOC.values()]
            yield pa.RecordBatch.from_arrays([*none, pa.array(pairs), pa.array(docs)], names=[*DOC, "pair", "n_docs"])
        self.seen, self.n_seen = [], 0


def _events(path: str, side: int) -> Callable:
    def events(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = shared(path)
        kind = np.uint16 if len(tokens.lengths) <= 1 << 16 else np.uint32
        for block in text_blocks(batches, "text"):
            ids, counts, ok = tokens.encode(block.column("text"))
            ends, rows = np.cumsum(counts).tolist(), []
            for row, doc_id, end, n, good in zip(block.column("row").to_pylist(), block.column("doc_id").to_pylist(), ends, counts.tolist(), ok.tolist(), strict=True):
                own, at = ids[end - n : end] if good else ids[:0], 0
                for k in range(0, max(1, len(own)), RUN):
                    run = own[k : k + RUN]
                    rows.append((row, doc_id if side == 0 else None, side, at, good, len(run), pa.compress(run.astype(kind).tobytes(), "zstd", asbytes=True) if len(run) else b""))
                    at += int(tokens.lengths[run].sum())
            names = ["row", "doc_id", "side", "at", "ok", "n", "ids"]
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)

    return events


def _sweep(path_a: str, path_b: str, unit: int, with_groups: bool) -> Callable:
    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = shared(path_a).lengths, shared(path_b).lengths
        kinds = [np.uint16 if len(n) <= 1 << 16 else np.uint32 for n in lengths]
        machine = Sweep(lengths, unit, with_groups)
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("row", "doc_id", "side", "ok", "n", "ids")]
            for row, doc_id, side, ok, n, data in zip(*columns, strict=True):
                ids = np.frombuffer(pa.decompress(data, n * kinds[side]().itemsize, "zstd"), dtype=kinds[side]).astype(np.int64) if n else np.empty(0, dtype=np.int64)
                machine.event(row, doc_id, side, ok, ids)
                if len(machine.out) > 2000:
                    yield from machine.rows()
        machine.end()
        machine.flush()
        yield from machine.rows()
        yield from machine.counts()

    return sweep


def _totals(known) -> Callable:
    """Adds up each document's links by the corpus-wide counts."""

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, best = known.value
        for batch in batches:
            n = batch.column("n_pairs").to_pylist()
            both = [(from_planes(p.as_buffer(), k), from_planes(t.as_buffer(), k)) for p, t, k in zip(batch.column("pairs"), batch.column("times"), n, strict=True) if k]
            pairs, times = (np.concatenate([x[i] for x in both]) if both else np.empty(0, dtype=np.int64) for i in (0, 1))
            at = np.searchsorted(keys, pairs)
            firsts = np.concatenate([[0], np.cumsum(n)]).astype(np.int64)
            found = sums(times * best[at], firsts), sums(times * counts[at], firsts)
            names = [c for c in batch.schema.names if c not in ("n_pairs", "pairs", "times")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(found[0]), pa.array(found[1])], names=[*names, "n_best", "count_sum"])

    return totals


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each pair of each document."""
    for batch in batches:
        for row, p, t, k in zip(batch.column("row").to_pylist(), batch.column("pairs"), batch.column("times"), batch.column("n_pairs").to_pylist(), strict=True):
            if k:
                yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(row, pa.int64()), k), pa.array(from_planes(p.as_buffer(), k)), pa.array(from_planes(t.as_buffer(), k))], names=["row", "pair", "times"])


def align(docs: DataFrame, path_a: str, path_b: str, with_groups: bool = False, id_col: str = "doc_id", text_col: str = "text", unit: int = UNIT, max_pairs: int = PAIRS) -> DataFrame:
    """One row per row of ``docs``: doc_id (long), n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum, and groups if asked for.

    ``path_a`` is a byte-level BPE of the tokenizers library (.json), ``path_b`` a SentencePiece model; both read a space and the text,
    special tokens' strings being plain text. Texts that are null or empty, or that either tokenizer's tokens don't spell, have no tokens: zeros
    and an empty groups_sha256. groups is the text `a1,a2|b1;a3|b2,b3`. A link is a pair of token places whose byte ranges
    overlap; the count of its ids says how many rows of ``docs`` hold them linked. n_best counts the links whose count is the highest
    of their A id, count_sum adds up all links' counts. Null and repeated ids are kept, each row counts by itself; an empty table
    gives no rows; other columns aren't read. A text of any length is swept in parts of about ``unit`` ids.

    Counts of up to ``max_pairs`` pairs of ids are broadcast; beyond that, documents' pairs are joined with them.
    """
    spark, name = docs.sparkSession, free_name(docs)
    rows = numbered(docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_of(text_col).alias("text")), name).select(F.col(name).alias("row"), "doc_id", "text")
    schema = "row long, doc_id long, side int, at long, ok boolean, n int, ids binary"
    events = rows.mapInArrow(_events(path_a, 0), schema).unionByName(rows.mapInArrow(_events(path_b, 1), schema))
    ordered = events.repartition("row").sortWithinPartitions("row", "at", "side")
    out_schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, groups_sha256 string, n_pairs long, pairs binary, times binary, pair long, n_docs long"
    swept = Scratch(spark).keep(ordered.mapInArrow(_sweep(path_a, path_b, unit, with_groups), out_schema), "swept")
    base = len(shared(path_b).lengths)
    counts = swept.where("pair is not null").groupBy("pair").agg(F.sum("n_docs").alias("n_docs")).withColumn("a", F.floor(F.col("pair") / base))
    top = counts.groupBy("a").agg(F.max("n_docs").alias("top"))
    counts = Scratch(spark).keep(counts.join(top, "a").select("pair", "n_docs", (F.col("n_docs") == F.col("top")).alias("best")), "counts")
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", *(["groups"] if with_groups else []), "groups_sha256"]
    kept = swept.where("pair is null")
    if Scratch.rows(counts) <= max_pairs:
        table = counts.toArrow()
        keys = table.column("pair").to_numpy()
        order = np.argsort(keys)
        known = spark.sparkContext.broadcast((keys[order], table.column("n_docs").to_numpy()[order], table.column("best").to_numpy()[order]))
        types = ", ".join(f"{c} {kept.schema[c].dataType.simpleString()}" for c in columns)
        return kept.select(*columns, "n_pairs", "pairs", "times").mapInArrow(_totals(known), f"{types}, n_best long, count_sum long")
    own = numbered(kept.select(*columns, "n_pairs", "pairs", "times"), "row")
    each = own.select("row", "n_pairs", "pairs", "times").mapInArrow(_spread, "row long, pair long, times long").join(counts, "pair")
    added = each.groupBy("row").agg(F.sum(F.col("times") * F.col("best").cast("long")).alias("n_best"), F.sum(F.col("times") * F.col("n_docs")).alias("count_sum"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return own.join(added, "row", "left").select(*columns, zero("n_best"), zero("count_sum"))
