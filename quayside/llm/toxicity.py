"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton on folded text.

Folding undoes disguises: case, look-alike letters of other scripts, digits and signs written for letters. The
lexicon's terms are whole words and beginnings of words; each weighs its log odds among labelled documents. A hit
inside an exception phrase doesn't count. A document's weight is divided by the square root of its words.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside.llm import labelled
from quayside.llm._common import text_blocks, text_of

# fixed values: Cyrillic, Greek and other letters that look like Latin ones; digits written for letters
LOOK_ALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "н": "h", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ѵ": "v", "ԝ": "w",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ɡ": "g", "ı": "i", "ℓ": "l",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g"}
SIGNS = {"@": "a", "$": "s"}
#: Phrases in which a term is harmless.
EXCEPTIONS = ("trash can", "trash bin", "trash collection", "clown fish", "class clown", "idiot proof", "worthless currency", "pathetic fallacy", "scum line")
PREFIXES = (4, 5, 6)

_FOLD = str.maketrans(LOOK_ALIKES | DIGITS | {chr(0xFF01 + k): chr(0x21 + k) for k in range(94)} | {"­": None, "​": None, "‌": None, "‍": None, "﻿": None, "l": "i"})
_SIGN = re.compile(r"[@$](?=[^\W\d_])|(?<=[^\W\d_])[!|](?=[^\W\d_])")
_WORDS = re.compile(r"[^\W_]+")


def fold(text: str) -> str:
    """Folded words between single spaces, a space at both ends. l, 1, ! and | all become i, as they look alike."""
    low = text.lower()
    if "@" in low or "$" in low or "!" in low or "|" in low:
        low = _SIGN.sub(lambda m: SIGNS.get(m[0], "i"), low)
    return " " + " ".join(_WORDS.findall(low.translate(_FOLD))) + " "


def terms_of(folded: str) -> set[str]:
    """Whole words as ' word ', beginnings of longer words as ' begi'."""
    out = set()
    for w in set(folded.split()):
        out.add(f" {w} ")
        out.update(f" {w[:n]}" for n in PREFIXES if len(w) > n)
    return out


def learn(examples: DataFrame, least_docs: int = 3, least_weight: float = 0.5) -> dict[str, float]:
    """The lexicon of (id, y, text): terms of at least ``least_docs`` toxic examples and their weights.

    A weight is the log odds less 2.6 standard errors, so that chance terms fall out. Of a label's examples with the same text
    one counts, as copies say nothing new. A longer term is left out where a beginning of it says as much.
    Terms are counted on the executors; only the chosen ones come to the driver, all of them: the sample bounds their number.
    Null texts count as empty; without toxic or without clean examples there are no terms.
    """
    once = examples.groupBy("y", F.sha2("text", 256).alias("digest")).agg(F.min(F.struct("id", "text")).alias("x"))
    examples = once.select("x.id", "y", "x.text")
    totals = {r.y: r.n for r in examples.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = totals.get(1, 0), totals.get(0, 0)
    if not n1 or not n0:
        return {}

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches, "text"):
            for y, text in zip(block.column("y").to_pylist(), block.column("text").to_pylist(), strict=True):
                terms = sorted(terms_of(fold(text)))
                yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([y] * len(terms), pa.int32())], names=["term", "y"])

    counted = examples.select("y", "text").mapInArrow(split, "term string, y int").groupBy("term").agg(F.sum("y").alias("k"), F.sum(1 - F.col("y")).alias("c"))
    k, c = F.col("k") + 0.5, F.col("c") + 0.5
    weight = F.log(k / (n1 + 1)) - F.log(c / (n0 + 1)) - 2.6 * F.sqrt(1 / k + 1 / c)
    best = counted.where(F.col("k") >= least_docs).select("term", weight.alias("w")).where(F.col("w") >= least_weight)
    chosen = {r.term: r.w for r in best.orderBy("term").collect()}
    return {t: w for t, w in chosen.items() if not any(t[: n + 1] != t and chosen.get(t[: n + 1], -1.0) >= w for n in PREFIXES)}


class Lexicon:
    def __init__(self, terms: dict[str, float], slope: float, intercept: float, exceptions: tuple[str, ...] = EXCEPTIONS):
        self.terms, self.slope, self.intercept, self.exceptions = terms, slope, intercept, exceptions
        self.automaton = None

    def __getstate__(self):
        return self.__dict__ | {"automaton": None}

    def build(self):
        import ahocorasick

        a = ahocorasick.Automaton()
        for t, w in self.terms.items():
            a.add_word(t, (len(t), w))
        for e in self.exceptions:
            if (p := fold(e)) not in self.terms:
                a.add_word(p, (len(p), None))
        if len(a):
            a.make_automaton()
        return a

    def weight(self, text: str) -> tuple[float, int, int]:
        """Sum of the weights of the words hit (each by its weightiest term), words hit, words."""
        if self.automaton is None:
            self.automaton = self.build()
        folded = fold(text)
        n = folded.count(" ") - 1 if len(folded) > 2 else 0
        if not len(self.automaton) or n < 1:
            return 0.0, 0, max(0, n)
        hits: dict[int, float] = {}
        spans: list[tuple[int, int]] = []
        for end, (length, w) in self.automaton.iter(folded):
            at = end - length + 1
            if w is None:
                spans.append((at, end))
            elif w > hits.get(at, 0.0):
                hits[at] = w
        if spans:
            hits = {at: w for at, w in hits.items() if not any(a <= at < b for a, b in spans)}
        return sum(hits.values()), len(hits), n

    @staticmethod
    def density(weight: float, n: int) -> float:
        """Weight by length; its square root tames very toxic short texts."""
        return math.sqrt(weight / math.sqrt(n + 4))

    def score_of(self, weight: float, n: int) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.slope * self.density(weight, n) + self.intercept))))


def fit(docs: DataFrame, labels: DataFrame, train: Column, per_class: int = 4000, id_col: str = "doc_id", text_col: str = "text") -> Lexicon:
    """A lexicon learned from at most ``per_class`` toxic and as many clean examples. Without both, nothing is toxic.

    Null texts count as empty texts, null ids aren't learned from; empty tables give a lexicon without terms.
    """
    examples = labelled.sample(docs, labels, "toxic", train, per_class, id_col, text_col)
    terms = learn(examples)
    lexicon = Lexicon(terms, 0.0, -5.0)
    if terms:

        def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block in text_blocks(batches, "text"):
                x = [Lexicon.density(w, n) for w, _, n in map(lexicon.weight, block.column("text").to_pylist())]
                yield pa.RecordBatch.from_arrays([block.column("id"), block.column("y"), pa.array(x, pa.float64())], names=["id", "y", "x"])

        kind = examples.schema["id"].dataType.simpleString()
        points = sorted((r.x, r.y) for r in examples.mapInArrow(weigh, f"id {kind}, y int, x double").select("x", "y").collect())
        lexicon.slope, lexicon.intercept = labelled.logistic([x for x, _ in points], [y for _, y in points], l2=1e-4)
    return lexicon


def score_toxicity(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, score (0 to 1), n_hits, n_words.

    Null text counts as empty and scores as a text without hits. Ids are kept as they are, null and repeated ones
    too; an empty input gives no rows. The lexicon, bounded by its number of terms, goes with the tasks.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_of(text_col).alias("text"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches, "text"):
            found = [lexicon.weight(t) for t in block.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [block.column("doc_id"), pa.array([lexicon.score_of(w, n) for w, _, n in found], pa.float64()), pa.array([h for _, h, _ in found], pa.int64()), pa.array([n for *_, n in found], pa.int64())],
                names=["doc_id", "score", "n_hits", "n_words"],
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(score, f"doc_id {kind}, score double, n_hits long, n_words long")


def drop_toxic(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that score less than ``threshold``.

    Null and empty texts have no hits and score as such; an empty table gives no rows.
    """

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches, text_col):
            keep = [lexicon.score_of(w, n) < threshold for w, _, n in map(lexicon.weight, (t or "" for t in block.column(text_col).to_pylist()))]
            yield block.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(clean, docs.schema)
