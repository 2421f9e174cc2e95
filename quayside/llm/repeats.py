"""Removal of repeated byte strings: suffixes in order through a fixed depth, by most-significant-digit passes.

A string of ``width`` bytes is repeated where two suffixes agree through ``width`` bytes, so suffixes need no order beyond
that depth. The first digit of a suffix is a shorter string inside its first ``width`` bytes, its anchor: of all strings
of ``width - span + 1`` bytes there, the one that hashes lowest. Equal suffixes have equal anchors, and neighbouring suffixes share
theirs, so a text has an anchor only every dozen bytes or so. Passes:

1. anchors are dealt out by hash; those that only one block of texts has are dropped, and nothing of them moves again;
2. what is left goes, as the stretch of text that an anchor's suffixes span, to the task of its anchor, where the
   suffixes are split by digits of eight bytes, until ``width`` bytes are read. After every digit, groups of one document drop out.

What is left are exactly the repeated strings. An anchor that very many blocks have (a common line with different
surroundings) would make one task's group: its suffixes are dealt out one by one, by all their bytes. Within a block of texts
equal stretches travel once, with the smallest id. Whole copies of a text are settled before and don't take part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.llm._common import Scratch, free_name, numbered, text_blocks, text_of
from quayside.llm.chunks import text_bytes

BUCKET_BYTES = 16 << 20  # of text for each task that sorts
TILE = 1 << 14  # places whose hashes are worked out together, in the processor's cache
HOT_BLOCKS = 512  # blocks with an anchor, beyond which its suffixes are dealt out one by one
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)
_LOW = np.uint64(0xFFFFFFFF)
NO_ID = np.iinfo(np.int64).max  # a null id counts as larger than any other


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _ODD[1]
    h = (h ^ (h >> np.uint64(29))) * _ODD[2]
    return h ^ (h >> np.uint64(32))


def _eights(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a number, the first byte counting most."""
    return np.ndarray((len(buf) - 7,), dtype=">u8", buffer=buf, strides=(1,))


def _digits(width: int) -> list[int]:
    """Where the eight-byte digits of a string of ``width`` bytes begin; the last overlaps the one before."""
    return [*range(0, width - 7, 8)] + ([width - 8] if width % 8 and width > 8 else []) if width >= 8 else [0]


def _digit(eights: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    got = eights[at].astype(np.uint64)
    return got >> np.uint64(8 * (8 - width)) if width < 8 else got


class Block:
    """A block of texts, with the stretches of suffixes that share an anchor: lo to hi (places in ``buf``), doc, g (the anchor's hash)."""

    def __init__(self, batch: pa.RecordBatch, width: int):
        self.width, self.span = width, max(1, min(32, width // 2))
        ids = batch.column("id")
        self.ids = np.asarray(ids.fill_null(NO_ID).to_numpy(zero_copy_only=False), dtype=np.int64)
        self.buf, self.edges = text_bytes(batch.column("text"))
        self.eights = _eights(self.buf)
        size, lengths = int(self.edges[-1]), np.diff(self.edges)
        if not (lengths >= width).any():
            self.lo = self.hi = self.doc = self.anchor = np.empty(0, dtype=np.int64)
            self.g = np.empty(0, dtype=np.uint64)
            return
        gram = width - self.span + 1
        # a hash of the ``gram`` bytes from each place on, and the place of the lowest of the next ``span``, leftmost of equals
        plain = np.ndarray((len(self.buf) - 7,), dtype="<u8", buffer=self.buf, strides=(1,))
        h, least = np.empty(size, dtype=np.uint64), np.empty(size, dtype=np.uint64)
        for s in range(0, size, TILE):
            own = h[s : s + TILE + self.span - 1]
            own[:] = 0
            for k, at in enumerate(_digits(gram)):
                own ^= own >> np.uint64(32)
                word = plain[s + at : s + at + len(own)]
                own += word if gram >= 8 else word & np.uint64((1 << 8 * gram) - 1)
                own *= _ODD[k % 3]
            low = own >> np.uint64(32)
            low <<= np.uint64(32)
            low |= np.arange(s, s + len(own), dtype=np.uint64)
            step = 1
            while step < self.span:
                more = min(step, self.span - step)
                np.minimum(low[:-more], low[more:], out=low[:-more])
                step += more
            least[s : s + TILE] = low[:TILE]
        whole = np.ones(size, dtype=bool)  # places where a suffix of ``width`` bytes begins
        tails = np.minimum(lengths, width - 1)
        whole[np.arange(int(tails.sum())) - np.repeat(np.cumsum(tails) - self.edges[1:], tails)] = False
        same = least[1:] == least[:-1]
        same &= whole[1:] & whole[:-1]
        first, last = whole.copy(), whole
        first[1:] &= ~same
        last[:-1] &= ~same
        self.lo, self.hi = np.flatnonzero(first), np.flatnonzero(last)
        self.doc = np.searchsorted(self.edges, self.lo, side="right") - 1
        self.anchor = (least[self.lo] & _LOW).astype(np.int64)
        self.g = _mix(h[self.anchor] + _ODD[0])

    def in_several(self) -> np.ndarray:
        """Which stretches' anchors several texts of the block have."""
        order = np.lexsort((self.doc, self.g))
        g, doc = self.g[order], self.doc[order]
        new = np.ones(len(g), dtype=bool)
        new[1:] = g[1:] != g[:-1]
        start = np.flatnonzero(new)
        several = doc[start] != doc[np.append(start[1:], len(g)) - 1] if len(g) else np.empty(0, dtype=bool)
        out = np.empty(len(g), dtype=bool)
        out[order] = several[np.cumsum(new) - 1]
        return out

    def keep(self, which: np.ndarray) -> None:
        self.lo, self.hi, self.doc, self.anchor, self.g = (x[which] for x in (self.lo, self.hi, self.doc, self.anchor, self.g))

    def one_by_one(self, which: np.ndarray) -> None:
        """Cut these stretches into single suffixes, told apart by all their bytes."""
        n = self.hi[which] - self.lo[which] + 1
        lo = np.repeat(self.lo[which], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        g = _mix(content(self.eights, lo, np.full(len(lo), self.width), self.width)[1] + _ODD[1])
        rest = ~which
        join = lambda old, new: np.concatenate([old[rest], new])
        self.doc, self.anchor = join(self.doc, np.repeat(self.doc[which], n)), join(self.anchor, lo)
        self.lo, self.hi, self.g = join(self.lo, lo), join(self.hi, lo), join(self.g, g)

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The number of each stretch's content (in the order of g), a stretch of each content, and the smallest id that has it."""
        lengths = self.hi - self.lo + self.width
        words, h = content(self.eights, self.lo, lengths, self.width)
        order = np.lexsort((h, self.g))
        new = np.ones(len(order), dtype=bool)
        new[1:] = (self.g[order[1:]] != self.g[order[:-1]]) | (lengths[order[1:]] != lengths[order[:-1]])
        for w in words:
            new[1:] |= w[order[1:]] != w[order[:-1]]
        number = np.empty(len(order), dtype=np.int64)
        number[order] = np.cumsum(new) - 1
        start = np.flatnonzero(new)
        least = np.minimum.reduceat(self.ids[self.doc[order]], start) if len(start) else np.empty(0, dtype=np.int64)
        return number, order[start], least


def content(eights: np.ndarray, at: np.ndarray, lengths: np.ndarray, width: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Stretches' bytes as eight-byte numbers, and a hash of them."""
    words, h = [], lengths.astype(np.uint64)
    for k in range(0, int(lengths.max()) if len(lengths) else 0, 8):
        left = np.clip(lengths - k, 0, 8).astype(np.uint64)
        word = eights[np.minimum(at + k, len(eights) - 1)].astype(np.uint64)
        word = np.where(left > 0, word >> (np.uint64(8) * (np.uint64(8) - np.maximum(left, np.uint64(1)))), np.uint64(0))
        words.append(word)
        h = _mix((h + word) * _ODD[(k // 8) % 3])
    return words, h


def _groups(order: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Numbers of the runs of equal keys in this order."""
    new = np.zeros(len(order), dtype=bool)
    for k in keys:
        new[1:] |= k[order[1:]] != k[order[:-1]]
    return np.cumsum(new)


def repeated(buf: np.ndarray, starts: np.ndarray, lengths: np.ndarray, ids: np.ndarray, values: np.ndarray, offsets: np.ndarray, width: int) -> np.ndarray:
    """For each stretch a bit for each of its suffixes: whether a smaller id has the same ``width`` bytes.

    ``values`` and ``offsets``: the anchors' hashes and where they begin in their stretches. ``buf`` has eight bytes after the last stretch.
    """
    eights = _eights(buf)
    n = lengths - width + 1
    full = (np.uint64(1) << n.astype(np.uint64)) - np.uint64(1)
    words, h = content(eights, starts, lengths, width)
    order = np.argsort(h, kind="stable")
    number = np.empty(len(order), dtype=np.int64)
    number[order] = group = _groups(order, h, lengths, *words)
    first = np.flatnonzero(np.diff(group, prepend=-1))
    least = np.minimum.reduceat(ids[order], first)
    shown = order[first]  # a stretch of each content
    # the suffixes of the distinct stretches, sorted digit by digit
    m = n[shown]
    stretch = np.repeat(np.arange(len(shown)), m)
    j = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
    at, own = starts[shown][stretch] + j, least[stretch]
    found = np.zeros(len(at), dtype=bool)
    left = np.arange(len(at))
    group = (values[shown][stretch].astype(np.uint64) << np.uint64(8)) | (offsets[shown][stretch] - j).astype(np.uint64)
    for digit in [None, *_digits(width)]:
        if not len(left):
            break
        if digit is None:
            order = np.argsort(group, kind="stable")
            runs = _groups(order, group)
        else:
            key = _digit(eights, at[left] + digit, width)
            order = np.lexsort((key, group))
            runs = _groups(order, group, key)
        left = left[order]
        start = np.flatnonzero(np.diff(runs, prepend=-1))
        low, high = np.minimum.reduceat(own[left], start), np.maximum.reduceat(own[left], start)
        stays = (low != high)[runs]
        low, left, group = low[runs][stays], left[stays], runs[stays]
    found[left] = low < own[left] if len(left) else False
    bits = np.zeros(len(shown), dtype=np.uint64)
    np.bitwise_or.at(bits, stretch[found], np.uint64(1) << j[found].astype(np.uint64))
    return np.where(ids > least[number], full, bits[number])


def _pack(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _batch(names: dict[str, pa.DataType], rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(names.values())], names=list(names))


_HASHES = {"bucket": pa.int32(), "block": pa.int64(), "data": pa.binary()}
_SIDE = {"block": pa.int64(), "kind": pa.string(), "bucket": pa.int32(), "data": pa.binary(), "more": pa.binary()}
_STRETCHES = {"bucket": pa.int32(), "block": pa.int64(), "base": pa.int64(), "vals": pa.binary(), "offsets": pa.binary(), "lengths": pa.binary(), "ids": pa.binary(), "bytes": pa.binary()}
_DDL = {pa.int32(): "int", pa.int64(): "long", pa.binary(): "binary", pa.string(): "string"}


def _ddl(names: dict[str, pa.DataType]) -> str:
    return ", ".join(f"{k} {_DDL[v]}" for k, v in names.items())


def _slices(bucket: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Runs of equal buckets."""
    starts = np.flatnonzero(np.diff(bucket, prepend=-1))
    for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(bucket)], strict=True):
        yield int(bucket[s]), slice(s, e)


class _Work:
    """The functions that tasks run."""

    def __init__(self, width: int, n_buckets: int, hot_blocks: int):
        self.width, self.n_buckets, self.hot_blocks = width, n_buckets, hot_blocks

    def bucket(self, g: np.ndarray) -> np.ndarray:
        return ((g >> np.uint64(32)) * np.uint64(self.n_buckets) >> np.uint64(32)).astype(np.int64)

    def blocks(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_blocks(batches, "text"):
            yield _batch({"block": pa.int64(), "payload": pa.binary()}, [(part.column("row")[0].as_py(), _pack(part))])

    def digests(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for part in text_blocks(batches, "text"):
            n = part.num_rows
            sha = [hashlib.sha256(t.as_buffer()).digest() if t.is_valid else hashlib.sha256().digest() for t in part.column("text")]
            ids = part.column("id").fill_null(NO_ID)
            yield pa.RecordBatch.from_arrays([pa.repeat(part.column("row")[0], n), pa.array(range(n), pa.int32()), ids, pa.array(sha, pa.binary())], names=["block", "slot", "id", "sha"])

    def hashes(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_blocks(batches, "text"):
            g = np.unique(Block(part, self.width).g)
            low, block = (g & _LOW).astype("<u4"), part.column("row")[0].as_py()
            if len(g):
                yield _batch(_HASHES, [(b, block, low[s].tobytes()) for b, s in _slices(self.bucket(g))])

    def repeats(self, table: pa.Table) -> pa.Table:
        """For each block which of its hashes in this bucket another block has too, and which of them very many have."""
        parts = [np.frombuffer(x.as_buffer(), dtype="<u4") for x in table.column("data")]
        values, counts = np.unique(np.concatenate(parts), return_counts=True)
        common, hot = values[counts > 1], values[counts > self.hot_blocks]
        rows = []
        for block, bucket, own in zip(table.column("block").to_pylist(), table.column("bucket").to_pylist(), parts, strict=True):
            if len(mine := own[np.isin(own, common, assume_unique=True)]):
                rows.append((block, "hashes", bucket, mine.tobytes(), mine[np.isin(mine, hot, assume_unique=True)].tobytes()))
        return pa.Table.from_batches([_batch(_SIDE, rows)])

    def open(self, payload, side) -> tuple[pa.RecordBatch, Block, np.ndarray]:
        """A block with the stretches that may be repeated, and which texts are copies of others with smaller ids."""
        batch = pa.ipc.open_stream(payload.as_buffer()).read_next_batch()
        block = Block(batch, self.width)
        copies = np.zeros(batch.num_rows, dtype=bool)
        known, hot = [], []
        for s in side.as_py() or ():
            if s["kind"] == "copies":
                copies[np.frombuffer(s["data"], dtype=">i4")] = True
            elif s["kind"] == "hashes":
                top = np.uint64(s["bucket"]) << np.uint64(32)
                known.append(np.frombuffer(s["data"], dtype="<u4") | top)
                hot.append(np.frombuffer(s["more"], dtype="<u4") | top)
        block.keep(~copies[block.doc])
        key = (self.bucket(block.g).astype(np.uint64) << np.uint64(32)) | (block.g & _LOW)
        among = lambda sets: np.isin(key, np.concatenate(sets)) if sets else np.zeros(len(key), dtype=bool)
        may, often = among(known) | block.in_several(), among(hot)
        block.keep(may)
        if often.any():
            block.one_by_one(often[may])
        return batch, block, copies

    def stretches(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for name, payload, side in zip(rows.column("block").to_pylist(), rows.column("payload"), rows.column("side"), strict=True):
                _, block, _ = self.open(payload, side)
                _, shown, least = block.distinct()
                if not len(shown):
                    continue
                lo, g = block.lo[shown], block.g[shown]
                lengths = block.hi[shown] - lo + self.width
                offsets = (block.anchor[shown] - lo).astype(np.uint8)
                ends = np.cumsum(lengths)
                flat = block.buf[np.repeat(lo - ends + lengths, lengths) + np.arange(int(ends[-1]))]
                out = []
                for b, s in _slices(self.bucket(g)):
                    raw = flat[ends[s.start] - lengths[s.start] : ends[s.stop - 1]]
                    out.append((b, name, s.start, (g[s] & _LOW).astype("<u4").tobytes(), offsets[s].tobytes(), lengths[s].astype(np.uint8).tobytes(), least[s].astype("<i8").tobytes(), pa.compress(raw.tobytes(), "zstd", asbytes=True)))
                yield _batch(_STRETCHES, out)

    def sort(self, table: pa.Table) -> pa.Table:
        """The stretches of one bucket, sorted: for each block the numbers of those with repeated suffixes, and their bits."""
        take = lambda name, kind: [np.frombuffer(x.as_buffer(), dtype=kind) for x in table.column(name)]
        lengths = take("lengths", np.uint8)
        raw = [np.frombuffer(pa.decompress(x.as_buffer(), int(n.sum(dtype=np.int64)), "zstd"), dtype=np.uint8) for x, n in zip(table.column("bytes"), lengths, strict=True)]
        sizes = [len(x) for x in lengths]
        flat = np.concatenate(lengths).astype(np.int64)
        buf = np.concatenate([*raw, np.zeros(64, dtype=np.uint8)])
        bits = repeated(buf, np.cumsum(flat) - flat, flat, np.concatenate(take("ids", "<i8")), np.concatenate(take("vals", "<u4")), np.concatenate(take("offsets", np.uint8)).astype(np.int64), self.width)
        rows, at = [], 0
        for block, base, n in zip(table.column("block").to_pylist(), table.column("base").to_pylist(), sizes, strict=True):
            own = bits[at : at + n]
            at += n
            if len(hit := np.flatnonzero(own)):
                rows.append((block, "bits", 0, (hit + base).astype("<i8").tobytes(), own[hit].astype("<u4").tobytes()))
        return pa.Table.from_batches([_batch(_SIDE, rows)])

    def cut(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each text's removed runs and what is left."""
        for rows in batches:
            for payload, side in zip(rows.column("payload"), rows.column("side"), strict=True):
                batch, block, copies = self.open(payload, side)
                number, shown, least = block.distinct()
                bits = np.zeros(len(shown), dtype=np.uint64)
                for s in side.as_py() or ():
                    if s["kind"] == "bits":
                        bits[np.frombuffer(s["data"], dtype="<i8")] = np.frombuffer(s["more"], dtype="<u4")
                n = block.hi - block.lo + 1
                full = (np.uint64(1) << n.astype(np.uint64)) - np.uint64(1)
                mine = np.where(block.ids[block.doc] > least[number], full, bits[number]) if len(n) else bits
                size, edges, lengths = int(block.edges[-1]), block.edges, np.diff(block.edges)
                depth = np.zeros(size + 1, dtype=np.int64)
                for j in range(int(n.max()) if len(n) else 0):
                    at = block.lo[(mine >> np.uint64(j)) & np.uint64(1) == 1] + j
                    np.add.at(depth, at, 1)
                    np.add.at(depth, at + self.width, -1)
                gone = np.cumsum(depth[:-1]) > 0
                gone |= np.repeat(copies & (lengths >= self.width), lengths)
                before = np.zeros(size, dtype=bool)
                before[1:] = gone[:-1]
                before[edges[:-1][lengths > 0]] = False
                after = np.zeros(size, dtype=bool)
                after[:-1] = gone[1:]
                after[edges[1:][lengths > 0] - 1] = False
                begin, end = np.flatnonzero(gone & ~before), np.flatnonzero(gone & ~after) + 1
                owner = np.searchsorted(edges, begin, side="right") - 1
                runs = pa.StructArray.from_arrays([pa.array(begin - edges[owner]), pa.array(end - edges[owner])], names=["start", "end"])
                spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(begin, edges).astype(np.int32)), runs)
                kept_ends = np.concatenate([[0], np.cumsum(~gone)])[edges]
                left = pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(kept_ends.astype(np.int64).tobytes()), pa.py_buffer(block.buf[:size][~gone].tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(lengths), spans, left], names=["doc_id", "n_bytes", "spans", "kept"])


def remove_repeats(docs: DataFrame, width: int = 50, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES, hot_blocks: int = HOT_BLOCKS) -> DataFrame:
    """One row per row of ``docs``: doc_id (long), n_bytes, spans (removed runs, start and end in bytes), kept (the other bytes).

    A byte goes if it lies in a string of ``width`` bytes (at most 64) that a row with a smaller id also holds; strings are judged on the
    texts as they come. Null texts count as empty, and null ids as larger than any other; rows of one id don't count against each
    other. Texts shorter than ``width`` stay whole; an empty table gives no rows; other columns aren't read. Tables are kept in
    the shared folder while the result is in use.
    """
    if not 2 <= width <= 64:
        raise ValueError("width: from 2 to 64 bytes")
    spark, name = docs.sparkSession, free_name(docs)
    rows = numbered(docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text_of(text_col).alias("text")), name).select(F.col(name).alias("row"), "id", "text")
    scratch = Scratch(spark)
    seen = scratch.keep(rows.mapInArrow(_Work(width, 1, 1).digests, "block long, slot int, id long, sha binary"), "digests")
    # each copy of a text with a smaller id goes whole; the group's smallest id returns to its rows part by part
    parts = max(1, Scratch.rows(seen) // 1_000_000)
    dealt = seen.withColumn("part", F.pmod(F.xxhash64("block"), F.lit(parts)))
    some = dealt.groupBy("sha", "part").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n"))
    groups = some.groupBy("sha").agg(F.min("least").alias("least"), F.sum("n").alias("n")).where("n > 1").drop("n")
    copies = dealt.join(some.select("sha", "part").join(groups, "sha"), ["sha", "part"]).where("id > least")
    slots = F.unhex(F.array_join(F.transform(F.collect_list("slot"), lambda s: F.lpad(F.hex(s.cast("long")), 8, "0")), ""))
    copies = copies.groupBy("block").agg(slots.alias("data")).select("block", F.lit("copies").alias("kind"), F.lit(0).alias("bucket"), "data", F.lit(None).cast("binary").alias("more"))

    size = rows.select(F.sum(F.octet_length("text"))).first()[0] or 0
    n_buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // bucket_bytes))
    work = _Work(width, n_buckets, hot_blocks)
    found = rows.mapInArrow(work.hashes, _ddl(_HASHES)).groupBy("bucket").applyInArrow(lambda t: work.repeats(t), _ddl(_SIDE))
    side = scratch.keep(found.unionByName(copies), "side")
    per_block = lambda t: t.groupBy("block").agg(F.collect_list(F.struct("kind", "bucket", "data", "more")).alias("side"))
    blocks = rows.mapInArrow(work.blocks, "block long, payload binary")
    stretches = blocks.join(per_block(side), "block", "left").mapInArrow(work.stretches, _ddl(_STRETCHES))
    bits = scratch.keep(stretches.groupBy("bucket").applyInArrow(lambda t: work.sort(t), _ddl(_SIDE)), "bits")
    ready = blocks.join(per_block(side.unionByName(bits)), "block", "left")
    return ready.mapInArrow(work.cut, "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")
