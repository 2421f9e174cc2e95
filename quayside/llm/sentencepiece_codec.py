"""SentencePiece models on the tokenizers library.

The model's protobuf gives the normaliser (its character map, the space mark, the space put before a text), the
pieces with their scores and byte fallback. A unigram model becomes the library's Unigram over those scores. A
BPE model has no unigram scores: there a piece's score is its rank, so it becomes the library's BPE, each split of a piece into
two others being a merge of that rank. Batches are encoded by several threads. Every distinct chunk of text is also
encoded by the model's own library, and where the two differ, that library's ids count (and are reported).
"""

from __future__ import annotations

import functools
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.llm._common import text_blocks, text_of
from quayside.llm.chunks import ChunkTable, cut, sums, text_bytes
from quayside.llm.pieces import BYTE, NORMAL, SPACE, USER, Cuts, PieceModel


def backend(model: PieceModel):
    """The tokenizers library's tokenizer for the model, without the space put before a text."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    ids: dict[str, int] = {}
    for i, (p, _, _) in enumerate(model.pieces):
        ids.setdefault(p, i)
    unknown = model.pieces[model.unk_id][0]
    if model.bpe:
        score = {p: s for p, s, kind in model.pieces if kind in (NORMAL, USER)}
        merges = [(score[p], ids[p], p[:k], p[k:]) for p in score for k in range(1, len(p)) if p[:k] in score and p[k:] in score]
        merges.sort(key=lambda m: (-m[0], m[1], len(m[2])))
        core = models.BPE(vocab=ids, merges=[m[2:] for m in merges], unk_token=unknown, fuse_unk=True, byte_fallback=model.byte_fallback)
    else:
        core = models.Unigram([(p, s) for p, s, _ in model.pieces], unk_id=model.unk_id, byte_fallback=model.byte_fallback)
    t = Tokenizer(core)
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.strip_spaces:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    t.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", SPACE)])
    t.pre_tokenizer = pre_tokenizers.Split("\n", "isolated")
    t.decoder = decoders.Sequence([decoders.Replace(SPACE, " "), decoders.ByteFallback(), decoders.Fuse(), *([decoders.Strip(" ", 1, 0)] if model.dummy_prefix else [])])
    return t


class Codec:
    """Encodes and decodes whole texts; null is the empty text."""

    def __init__(self, path: str, threads: int = 2):
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        from sentencepiece import SentencePieceProcessor

        self.model = PieceModel.load(path)
        self.library, self.own = backend(self.model), SentencePieceProcessor(model_file=path)
        byte = {p: i for i, (p, _, kind) in enumerate(self.model.pieces) if kind == BYTE}
        self.newline = byte.get("<0x0A>")
        self.cuts = Cuts(self.model)
        self.by_chunk = self.model.by_chunk() and self.newline is not None and self.cuts.newline
        self.head = self.own.encode("a")
        self.table = ChunkTable(self._compute)  # of each chunk: 1 if repaired, then its ids

    def _compute(self, chunks: list[bytes]) -> list[np.ndarray]:
        texts = [c.decode() for c in chunks]
        plain = [k for k, t in enumerate(texts) if "\n" not in t]
        got: list = [None] * len(texts)
        per = 512
        lines = [[texts[k] for k in plain[i : i + per]] for i in range(0, len(plain), per)]
        at = 0
        for group, one in zip(lines, self.library.encode_batch_fast(["\n".join(g) for g in lines], add_special_tokens=False), strict=True):
            arr = np.array(one.ids, dtype=np.int32)
            ends = [*np.flatnonzero(arr == self.newline).tolist(), len(arr)]
            if len(ends) != len(group):
                raise ValueError("a newline between chunks was not a token of its own")
            start = 0
            for end in ends:
                got[plain[at]] = arr[start:end]
                start, at = end + 1, at + 1
        rest = [k for k, g in enumerate(got) if g is None]
        for k, one in zip(rest, self.library.encode_batch_fast([texts[k] for k in rest], add_special_tokens=False), strict=True):
            got[k] = np.array(one.ids, dtype=np.int32)
        out, skip = [], len(self.head)
        for mine, own in zip(got, self.own.encode(["a" + t for t in texts], num_threads=1), strict=True):
            own = own[skip:]
            same = len(own) == len(mine) and own == mine.tolist()
            out.append(np.concatenate([[0], mine]) if same else np.array([1, *own], dtype=np.int32))
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids end to end, the number of ids of each text, and how many of its chunks the backend had wrong."""
        filled = texts.fill_null("") if texts.null_count else texts
        if not self.by_chunk:
            whole = filled.to_pylist()
            space = " " if self.model.dummy_prefix else ""
            mine = [x.ids for x in self.library.encode_batch_fast([space + t if t else "" for t in whole], add_special_tokens=False)]
            own = self.own.encode(whole, num_threads=1)
            return np.array([i for x in own for i in x], dtype=np.int32), np.array([len(x) for x in own], dtype=np.int64), np.array([a != b for a, b in zip(mine, own, strict=True)], dtype=np.int64)
        raw, edges = text_bytes(filled)
        # a space before each text that isn't empty
        n = np.diff(edges)
        shift = np.cumsum(n > 0)
        buf = np.full(len(raw) + int(shift[-1] if len(n) else 0), 0, dtype=np.uint8)
        size = int(edges[-1])
        buf[np.arange(size) + np.repeat(shift, n)] = raw[:size]
        edges = edges + np.concatenate([[0], shift])
        buf[edges[:-1][n > 0]] = 0x20
        starts, lengths, firsts = cut(self.cuts(buf), edges)
        entries = self.table.look_up(buf, starts, lengths)
        counts = self.table.lengths[entries]
        flags = self.table.values[self.table.starts[entries]].astype(np.int64)
        flat = self.table.gather(entries)
        keep = np.ones(len(flat), dtype=bool)
        keep[np.cumsum(counts) - counts] = False
        return flat[keep], sums(counts - 1, firsts), sums(flags, firsts)

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.library.decode_batch(ids, skip_special_tokens=False)


@functools.lru_cache(maxsize=1)
def shared(path: str, threads: int) -> Codec:
    return Codec(path, threads)


def _encoder(model_path: str, threads: int):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared(model_path, threads)
        for block in text_blocks(batches, "text", 1 << 20):
            ids, counts, repaired = codec.encode(block.column("text"))
            raw, ends = ids.astype("<u4").tobytes(), np.cumsum(counts) * 4
            parts = [raw[e - 4 * n : e] for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), block.column("text"), pa.array(parts, pa.binary()), pa.array(counts), pa.array(repaired)], names=["doc_id", "text", "ids", "n_tokens", "n_repaired"])

    return encode


def _decoder(model_path: str, threads: int, ids_col: str):
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared(model_path, threads)
        for block in text_blocks(batches, ids_col, 1 << 20):
            ids = [None if b is None else np.frombuffer(b, dtype="<u4").tolist() for b in block.column(ids_col).to_pylist()]
            texts = iter(codec.decode([x for x in ids if x is not None]))
            decoded = pa.array([None if x is None else next(texts) for x in ids], pa.string())
            names = [n for n in block.schema.names if n != "decoded"]
            yield pa.RecordBatch.from_arrays([*(block.column(n) for n in names), decoded], names=[*names, "decoded"])

    return decode


def _rows(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_of(text_col).alias("text"))
    return rows, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string, ids binary, n_tokens long, n_repaired long"


def encode_pieces(docs: DataFrame, model_path: str, threads: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, text, ids (binary, 32 bit each, little-endian), n_tokens, n_repaired.

    No begin, end or added special tokens. Null text counts as empty and has no ids. Ids are kept as they are, null and
    repeated ones too; an empty input gives no rows; other columns aren't read.
    """
    rows, schema = _rows(docs, id_col, text_col)
    return rows.mapInArrow(_encoder(model_path, threads), schema)


def decode_pieces(encoded: DataFrame, model_path: str, threads: int = 2, ids_col: str = "ids") -> DataFrame:
    """The rows of ``encoded`` with a further column ``decoded``: the text of the ids; of null ids it is null."""
    from pyspark.sql import types as T

    schema = T.StructType([f for f in encoded.schema if f.name != "decoded"] + [T.StructField("decoded", T.StringType())])
    return encoded.mapInArrow(_decoder(model_path, threads, ids_col), schema)


def round_trip_pieces(docs: DataFrame, model_path: str, threads: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """decode_pieces(encode_pieces(docs)), both in one Python worker with one model and one set of buffers."""
    rows, schema = _rows(docs, id_col, text_col)
    encode, decode = _encoder(model_path, threads), _decoder(model_path, threads, "ids")
    return rows.mapInArrow(lambda batches: decode(encode(batches)), schema + ", decoded string")
