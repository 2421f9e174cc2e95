"""Token ids in files of fixed-width packed bits.

A shard file holds, little-endian:

* ``QTOK0001``, then 4 unsigned 32-bit numbers: bits of an id, ids of a block, end-of-document id, 0
* blocks: each the ids of ``block`` positions at ``bits`` bits, lowest bit first, filled up to a whole byte
* the footer: offsets of the blocks in the file (64 bit, one more than blocks), starts of the documents among the
  shard's ids (64 bit, one more than documents), the documents' ids (64 bit), one byte for each, 0 where it is null
* 4 unsigned 64-bit numbers: where the footer begins, blocks, documents, ids

Any id is found from its position alone: block ``position // block``, bits ``(position % block) * bits`` onwards.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.llm._common import qualified, row_id, shared_dir, text_blocks, text_of

SHARD_BYTES = 256 << 20
MAGIC, HEAD, TAIL = b"QTOK0001", struct.Struct("<8s4I"), struct.Struct("<4Q")


def bits_for(vocab_size: int) -> int:
    """The least width that holds every id of the vocabulary."""
    return max(1, (vocab_size - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    each = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :bits]
    return np.packbits(each.reshape(-1), bitorder="little").tobytes()


def unpack(data: bytes, n: int, bits: int, first: int = 0) -> np.ndarray:
    """``n`` ids from position ``first`` of packed data."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, dtype=f"<u{bits // 8}", count=n, offset=first * bits // 8).astype(np.uint32)
    lowest = first * bits
    raw = np.frombuffer(data, dtype=np.uint8)[lowest // 8 : (lowest + n * bits + 7) // 8]
    each = np.unpackbits(raw, bitorder="little")[lowest % 8 : lowest % 8 + n * bits].reshape(n, bits)
    out = np.zeros((n, 32), dtype=np.uint8)
    out[:, :bits] = each
    return np.packbits(out, axis=1, bitorder="little").view("<u4").reshape(-1).astype(np.uint32)


def open_fs(path: str):
    """The file system of a URI or path, and the path on it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class ShardWriter:
    """Writes one shard; memory holds a block and the documents' numbers."""

    def __init__(self, stream, bits: int, block: int, end_id: int):
        self.out, self.bits, self.block = stream, bits, block
        self.out.write(HEAD.pack(MAGIC, bits, block, end_id, 0))
        self.at, self.offsets, self.rest = HEAD.size, [], np.empty(0, dtype=np.uint32)
        self.lengths: list[np.ndarray] = []
        self.ids: list[np.ndarray] = []
        self.known: list[np.ndarray] = []

    def add(self, doc_ids: np.ndarray, known: np.ndarray, tokens: np.ndarray, counts: np.ndarray) -> None:
        self.lengths.append(counts.astype("<i8"))
        self.ids.append(doc_ids.astype("<i8"))
        self.known.append(known.astype(np.uint8))
        tokens = np.concatenate([self.rest, tokens.astype(np.uint32)])
        whole = len(tokens) // self.block * self.block
        for i in range(0, whole, self.block):
            self._block(tokens[i : i + self.block])
        self.rest = tokens[whole:]

    def _block(self, ids: np.ndarray) -> None:
        data = pack(ids, self.bits)
        self.offsets.append(self.at)
        self.out.write(data)
        self.at += len(data)

    def close(self) -> tuple[int, int]:
        if len(self.rest):
            self._block(self.rest)
        none = [np.empty(0, dtype="<i8")]
        lengths = np.concatenate(self.lengths or none)
        starts = np.concatenate([[0], np.cumsum(lengths)]).astype("<i8")
        foot = self.at
        for part in (np.array([*self.offsets, self.at], dtype="<i8"), starts, np.concatenate(self.ids or none).astype("<i8"), np.concatenate(self.known or [np.empty(0, dtype=np.uint8)])):
            self.out.write(part.tobytes())
        self.out.write(TAIL.pack(foot, len(self.offsets), len(lengths), int(starts[-1])))
        return len(lengths), int(starts[-1])


class Shard:
    """Reads a shard file from a random-access file: whole documents or any span of ids."""

    def __init__(self, file):
        self.file, size = file, file.size()
        magic, self.bits, self.block, self.end_id, _ = HEAD.unpack(file.read_at(HEAD.size, 0))
        if magic != MAGIC:
            raise ValueError("not a token file")
        foot, blocks, docs, self.n_tokens = TAIL.unpack(file.read_at(TAIL.size, size - TAIL.size))
        raw, self.blob = file.read_at(size - TAIL.size - foot, foot), None
        self.offsets = np.frombuffer(raw, dtype="<i8", count=blocks + 1)
        self.starts = np.frombuffer(raw, dtype="<i8", count=docs + 1, offset=8 * (blocks + 1))
        self.doc_ids = np.frombuffer(raw, dtype="<i8", count=docs, offset=8 * (blocks + docs + 2))
        self.known = np.frombuffer(raw, dtype=np.uint8, count=docs, offset=8 * (blocks + 2 * docs + 2)).astype(bool)

    def tokens(self, start: int, n: int) -> np.ndarray:
        """``n`` ids from position ``start``; only their blocks are read."""
        if n <= 0:
            return np.empty(0, dtype=np.uint32)
        first, last = start // self.block, (start + n - 1) // self.block
        data = self.file.read_at(int(self.offsets[last + 1] - self.offsets[first]), int(self.offsets[first]))
        if self.block * self.bits % 8 == 0:
            return unpack(data, n, self.bits, start - first * self.block)
        base, parts = int(self.offsets[first]), []
        for b in range(first, last + 1):
            here = min(self.block, self.n_tokens - b * self.block)
            parts.append(unpack(data[int(self.offsets[b]) - base : int(self.offsets[b + 1]) - base], here, self.bits))
        return np.concatenate(parts)[start - first * self.block :][:n]

    def document(self, k: int) -> np.ndarray:
        return self.tokens(int(self.starts[k]), int(self.starts[k + 1] - self.starts[k]))


def write_token_files(
    docs: DataFrame, tokenizer_path: str, out_dir: str | None = None, end_id: int = 2, block: int = 4096, shards: int | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Write all documents' ids in ascending order of ``id_col``, a shard file per range of ids.

    Returns the shards in order: shard, path, n_docs, n_tokens, start (ids in the shards before). Each document's
    ids end with ``end_id``; null text counts as empty; null ids come first; rows with equal ids lie side by side in
    the order of their texts' hashes, over several shards if they are many. There are as many shards as shuffle partitions, and more
    where those would hold over ``SHARD_BYTES`` of text on average. A task writes under a name of its own attempt and then renames, so that a task that runs twice leaves one
    whole file. An empty input gives no shard. Ids are whole numbers.
    """
    from pyspark import TaskContext

    from quayside.llm.byte_bpe import shared

    spark = docs.sparkSession
    out_dir = qualified(spark, out_dir) if out_dir else shared_dir(spark)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text_of(text_col).alias("text"))
    if not shards:
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        shards = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))
    keyed = rows.withColumns({"hash": F.xxhash64("text"), "row": row_id()})
    ordered = keyed.repartitionByRange(shards, "id", "hash", "row").sortWithinPartitions("id", "hash", "text").select("id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, bpe, writer = TaskContext.get(), None, None
        fs, folder = open_fs(out_dir)
        part, name = f"{folder}/.{task.partitionId():06d}-{task.taskAttemptId()}", f"{folder}/{task.partitionId():06d}.qtok"
        for piece in text_blocks(batches, "text"):
            if writer is None:
                bpe = shared(tokenizer_path)
                fs.create_dir(folder, recursive=True)
                stream = fs.open_output_stream(part)
                writer = ShardWriter(stream, bits_for(max(bpe.vocab_size, end_id + 1)), block, end_id)
            ids, counts = bpe.encode(piece.column("text"))
            with_end = np.full(len(ids) + len(counts), end_id, dtype=np.uint32)
            ends = np.cumsum(counts + 1) - 1
            keep = np.ones(len(with_end), dtype=bool)
            keep[ends] = False
            with_end[keep] = ids
            doc_ids = piece.column("id")
            writer.add(doc_ids.fill_null(0).to_numpy(zero_copy_only=False), doc_ids.is_valid().to_numpy(zero_copy_only=False), with_end, counts + 1)
        if writer is not None:
            n_docs, n_tokens = writer.close()
            stream.close()
            fs.move(part, name)
            yield pa.RecordBatch.from_pydict({"shard": [task.partitionId()], "path": [f"{out_dir}/{task.partitionId():06d}.qtok"], "n_docs": [n_docs], "n_tokens": [n_tokens]}, schema=_SHARD)

    # a row for each shard file, as Spark's own writers report their files to the driver
    done = sorted((r.shard, r.path, r.n_docs, r.n_tokens) for r in ordered.mapInArrow(write, "shard int, path string, n_docs long, n_tokens long").collect())
    start, out = 0, []
    for r in done:
        out.append((*r, start))
        start += r[3]
    return spark.createDataFrame(out, "shard int, path string, n_docs long, n_tokens long, start long")


_SHARD = pa.schema([("shard", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])


def read_token_files(shards: DataFrame, max_tokens: int = 1 << 20) -> DataFrame:
    """All documents of the shards: doc_id, start (ids of all documents before it), n_tokens, ids (binary, 32 bit each)."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                fs, name = open_fs(path)
                with fs.open_input_file(name) as file:
                    shard, k = Shard(file), 0
                    while k < len(shard.doc_ids):
                        to = max(k + 1, int(np.searchsorted(shard.starts, shard.starts[k] + max_tokens, side="right")) - 1)
                        first = int(shard.starts[k])
                        raw = shard.tokens(first, int(shard.starts[to]) - first).astype("<u4").tobytes()
                        edges = ((shard.starts[k : to + 1] - first) * 4).tolist()
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(shard.doc_ids[k:to], mask=~shard.known[k:to]),
                                pa.array(shard.starts[k:to] + base),
                                pa.array(np.diff(shard.starts[k : to + 1])),
                                pa.array([raw[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)], type=pa.binary()),
                            ],
                            schema=schema,
                        )
                        k = to

    n = max(1, int(shards.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return shards.repartition(n, "shard").mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")


def round_trip(spark: SparkSession, docs: DataFrame, tokenizer_path: str, **options) -> DataFrame:
    return read_token_files(write_token_files(docs, tokenizer_path, **options))
