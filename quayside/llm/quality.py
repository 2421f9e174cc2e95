"""Document quality by votes of the nearest labelled neighbours in a latent semantic space.

A document's features are its hashed words, its trigrams of character kinds (runs of letters and of digits count once),
and how often a word repeats the one before it. A truncated singular value decomposition of a bounded
labelled sample gives the latent space. The sample's vectors go with the tasks; every document's cosines with all
of them are computed exactly, in blocks, and its nearest neighbours vote, weighted by similarity.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside.llm import labelled
from quayside.llm._common import Scratch, text_blocks, text_of
from quayside.llm.bagminhash import mix, words
from quayside.llm.chunks import text_bytes

DIM, WORDS, KINDS = 2048, 1024, 40  # slots of trigrams and of words; kinds of characters
_KIND = np.full(256, 39, dtype=np.int64)  # controls
_KIND[0x21:0x30] = np.arange(4, 19)
_KIND[0x3A:0x41] = np.arange(19, 26)
_KIND[0x5B:0x61] = np.arange(26, 32)
_KIND[0x7B:0x7F] = np.arange(32, 36)
_KIND[48:58], _KIND[65:91], _KIND[97:123] = 0, 1, 2
_KIND[0x20], _KIND[0x0A], _KIND[0x80:0xC0], _KIND[0xC0:] = 3, 38, 36, 2  # later bytes of a character are left out


def features(texts: pa.Array) -> np.ndarray:
    """Rows of DIM + 24 + WORDS counts of each whole text."""
    buf, edges = text_bytes(texts)
    n = len(edges) - 1
    kind = _KIND[buf[: int(edges[-1])]]
    text = np.repeat(np.arange(n), np.diff(edges))
    keep = kind != 36
    kind, text = kind[keep], text[keep]
    run = np.ones(len(kind), dtype=bool)
    run[1:] = (kind[1:] != kind[:-1]) | (kind[1:] > 2) | (text[1:] != text[:-1])
    kind, text = kind[run], text[run]
    if len(kind) >= 3:
        code = (kind[:-2] * KINDS + kind[1:-1]) * KINDS + kind[2:]
        same = text[:-2] == text[2:]
        slot = (mix(code.astype(np.uint64)) % np.uint64(DIM)).astype(np.int64)
        counts = np.bincount(text[:-2][same] * DIM + slot[same], minlength=n * DIM).reshape(n, DIM).astype(np.float32)
    else:
        counts = np.zeros((n, DIM), dtype=np.float32)
    h, at = words(texts)
    of = np.repeat(np.arange(n), np.diff(at))
    size = np.diff(at)
    extra = np.zeros((n, 24), dtype=np.float32)
    if len(h):
        again = np.zeros(len(h), dtype=bool)
        again[1:] = (h[1:] == h[:-1]) & (of[1:] == of[:-1])
        share = np.bincount(of, weights=again, minlength=n) / np.maximum(size, 1)
        extra[np.arange(n), np.minimum(15, (share * 16).astype(np.int64))] = np.maximum(size, 1)
        low = np.bincount(text, weights=kind == 1, minlength=n) / np.maximum(np.bincount(text, weights=kind <= 2, minlength=n), 1)
        extra[np.arange(n), 16 + np.minimum(7, (low * 8).astype(np.int64))] = np.maximum(size, 1)
        extra[size == 0] = 0
    word = np.bincount(of * WORDS + (mix(h) % np.uint64(WORDS)).astype(np.int64), minlength=n * WORDS).reshape(n, WORDS).astype(np.float32)
    return np.hstack([counts, extra, word])


class Neighbours:
    """Labelled latent vectors and the projection into their space."""

    def __init__(self, idf: np.ndarray, basis: np.ndarray, vectors: np.ndarray, votes: np.ndarray, k: int, power: float):
        self.idf, self.basis, self.vectors, self.votes, self.k, self.power = idf, basis, vectors, votes, k, power

    @staticmethod
    def weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
        total = lambda part: np.maximum(part.sum(axis=1, keepdims=True), 1.0)
        x = np.sqrt(counts)
        x[:, : DIM + 24] /= np.sqrt(total(counts[:, :DIM]))
        x[:, DIM + 24 :] /= np.sqrt(total(counts[:, DIM + 24 :]))
        x *= idf
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        return x

    @classmethod
    def fit(cls, counts: np.ndarray, ys: np.ndarray, dims: int = 48, k: int = 15, power: float = 8.0) -> Neighbours | None:
        """Of the features and labels of the examples; None unless both labels are there."""
        if not len(ys) or ys.min() == ys.max():
            return None
        idf = np.log((1 + len(ys)) / (1 + (counts > 0).sum(axis=0))).astype(np.float32) + 1
        x = cls.weigh(counts, idf)
        basis = np.linalg.qr(np.random.default_rng(5).normal(size=(x.shape[1], min(dims + 16, len(ys)))).astype(np.float32))[0]
        for _ in range(8):  # subspace iteration for the leading right singular vectors
            basis = np.linalg.qr(x.T @ (x @ basis))[0]
        right = np.linalg.svd(x @ basis, full_matrices=False)[2]
        basis = (basis @ right.T)[:, : min(dims, len(ys))].astype(np.float32)
        latent = x @ basis
        latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-12)
        return cls(idf, basis, latent.astype(np.float32), ys, k, power)

    def score(self, texts: pa.Array) -> np.ndarray:
        """Share of the votes for label 1."""
        out = np.empty(len(texts))
        for i in range(0, len(texts), 256):
            part = features(texts.slice(i, 256))
            latent = self.weigh(part, self.idf) @ self.basis
            nothing = ~part.any(axis=1)
            latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-12)
            cosine = latent @ self.vectors.T
            k = min(self.k, cosine.shape[1])
            near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
            weight = np.maximum(np.take_along_axis(cosine, near, axis=1), 1e-6).astype(np.float64) ** self.power
            out[i : i + len(part)] = (weight * self.votes[near]).sum(axis=1) / weight.sum(axis=1)
            out[i : i + len(part)][nothing] = 0.5
        return np.clip(out, 0.0, 1.0)


def fit(docs: DataFrame, labels: DataFrame, train: Column, per_class: int = 2000, id_col: str = "doc_id", text_col: str = "text") -> Neighbours | None:
    """Learned from at most ``per_class`` examples of each label; None if the labels don't hold both.

    Features are counted in parallel; one task, bounded by ``per_class``, fits the model, and the driver gets its arrays.
    Null texts count as empty texts; empty tables give None.
    """
    examples = labelled.sample(docs, labels, "quality", train, per_class, id_col, text_col)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches, "text", 1 << 20):
            rows = [x.tobytes() for x in features(block.column("text"))]
            yield pa.RecordBatch.from_arrays([block.column("y"), pa.array(rows, pa.binary())], names=["y", "x"])

    def model(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ys, rows = [], []
        for batch in batches:
            ys += batch.column("y").to_pylist()
            rows += batch.column("x").to_pylist()
        fitted = None
        if rows:
            examples_ = sorted(zip(ys, rows, strict=True))  # however they arrive
            counts = np.stack([np.frombuffer(x, dtype=np.float32) for _, x in examples_])
            labels_ = np.array([y for y, _ in examples_], dtype=np.float32)
            del rows, examples_
            fitted = Neighbours.fit(counts, labels_)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fitted)], pa.binary())], names=["model"])

    counted = Scratch(docs.sparkSession).keep(examples.select("y", "text").mapInArrow(count, "y int, x binary"), "features")
    got = counted.coalesce(1).mapInArrow(model, "model binary").collect()
    return pickle.loads(bytes(got[0].model)) if got else None


def _score(model: Neighbours | None, texts: pa.Array) -> np.ndarray:
    return np.full(len(texts), 0.5) if model is None else model.score(texts)


def score_quality(docs: DataFrame, model: Neighbours | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id and score, 0 to 1.

    Null text counts as empty; an empty text has no neighbours and scores 0.5. Without a model
    every score is 0.5. Ids are kept as they are, null and repeated ones too; an empty input gives no rows.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_of(text_col).alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample: 2 * per_class vectors

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches, "text"):
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(_score(sent.value, block.column("text")))], names=["doc_id", "score"])

    return rows.mapInArrow(score, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")


def drop_poor(docs: DataFrame, model: Neighbours | None, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that score ``threshold`` or more.

    Null and empty texts score 0.5, as every text does without a model; an empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def good(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches, text_col):
            yield block.filter(pa.array(_score(sent.value, block.column(text_col).cast(pa.string())) >= threshold))

    return docs.mapInArrow(good, docs.schema)
