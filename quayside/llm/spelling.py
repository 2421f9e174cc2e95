"""Spelling variants: words that are one edit apart, found by a positional q-gram index with a count filter.

An edit spoils a few q-grams of a word and leaves the others, at the same place or one beside it. Postings are dealt out by the longest
q-grams of which one edit must leave one, the halves of the longer word: two words near each other meet under a half, at
its place or one before it. There, an inverted index over positional 2-grams is probed: of a word's 2-grams only two can be
spoilt, so the postings of the three rarest are merged on a heap, under limits of length and place; what shares as many 2-grams
as one edit leaves at least is compared in full.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside.llm._common import Scratch, text_of

HELD = 400_000  # distinct words that a task holds before it hands their counts on
HOT = 20_000  # words under a half, from which on a quarter more is asked for
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def words_of(text: str, doc_id: int | None, min_length: int, every: int) -> Counter:
    """How often each word of at least ``min_length`` letters stands in a text, a letter being lost from one run in ``every``."""
    out: Counter = Counter()
    head = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for run, n in Counter(re.findall(rf"[a-zÀ-ÿ]{{{min_length},}}", text.translate(_LOWER))).items():
        h = zlib.crc32(run.encode(), head)
        if h % every == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
            if len(run) < min_length:
                continue
        out[run] += n
    return out


def count_words(docs: DataFrame, min_length: int = 6, min_count: int = 5, every: int = 199, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n: the words of ``docs`` and how often they occur, counted within tasks first.

    Words are runs of A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased; where ``every`` divides the crc32 of `id:run`, the run loses a
    letter. Null texts count as empty, null ids as the empty text; an empty table gives no rows.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), text_of(text_col).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def hand_on() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column("id").to_pylist(), batch.column("text"), strict=True):
                held.update(words_of(text.as_py(), doc_id, min_length, every))
                if len(held) > HELD:
                    yield hand_on()
        yield hand_on()

    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def one_edit(a: str, b: str) -> bool:
    """Whether one inserted, deleted or replaced letter makes one word of the other."""
    if len(a) < len(b):
        a, b = b, a
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(b))
    return (len(a) == len(b) and i < len(a) and a[i + 1 :] == b[i + 1 :]) or (len(a) == len(b) + 1 and a[i + 1 :] == b[i:])


def near_pairs(words: list[str], longest: int) -> Iterator[tuple[int, int]]:
    """Pairs (i, j) of words one edit apart, the first of length ``longest``, the second as long (then i < j) or a letter shorter.

    The words are distinct.
    """
    if len(words) < 2:
        return
    postings: dict[str, list[tuple[int, int]]] = defaultdict(list)
    for i, w in enumerate(words):
        for p in range(len(w) - 1):
            postings[w[p : p + 2]].append((i, p))
    least = longest - 3  # 2-grams of longest - 1 that one edit leaves
    for i, w in enumerate(words):
        if len(w) < longest:
            continue
        grams = sorted(range(longest - 1), key=lambda p, w=w: len(postings[w[p : p + 2]]))[:3]
        lists = [[(j, p) for j, q in postings[w[p : p + 2]] if (q == p and j > i) or (q in (p, p - 1) and len(words[j]) < longest)] for p in grams]
        last = -1
        for j, _ in heapq.merge(*lists):
            if j == last:
                continue
            last, other = j, words[j]
            if len(other) == longest:
                shared = sum(w[p : p + 2] == other[p : p + 2] for p in range(longest - 1))
            else:
                shared = sum(w[p : p + 2] in (other[p : p + 2], other[p - 1 : p + 1] if p else "") for p in range(longest - 1))
            if shared >= least and one_edit(w, other):
                yield i, j


def _halves(word: Column, longest: Column, rest: bool) -> Column:
    """The keys of a word among words of at most ``longest`` letters: a half each, and with ``rest`` the two finer keys of each."""
    short = longest - F.char_length(word)  # 0 or 1
    m = F.floor(longest / 2).cast("int")
    part = lambda at, n: F.substring(word, at, n)
    first, second = part(F.lit(1), m), part(m - short + 1, longest - m)
    r, s = F.floor((longest - m) / 2).cast("int"), F.floor(m / 2).cast("int")
    after = part(m + 1, r), part(m + r - short + 1, longest - m - r)
    before = part(F.lit(1), s), part(s - short + 1, m - s)
    key = lambda *parts: F.concat_ws("|", longest.cast("string"), *parts)
    finer = lambda side, half, parts: [key(F.lit(side), half, F.lit(str(k)), p) for k, p in enumerate(parts)]
    one, two = key(F.lit("0"), first), key(F.lit("1"), second)
    keys = [F.struct(one.alias("key"), F.array(*(finer("0", first, after) if rest else [])).alias("finer")), F.struct(two.alias("key"), F.array(*(finer("1", second, before) if rest else [])).alias("finer"))]
    return F.array(*keys)


def near_words(words: DataFrame, hot: int = HOT) -> DataFrame:
    """word, near, near_n: all pairs of ``words`` (word, n; distinct, of at least four letters) that are one edit apart, both ways round.

    A half that more than ``hot`` words have is split: its words meet under a quarter more, of which an edit elsewhere
    leaves one, too.
    """
    length = F.char_length("word")
    posted = words.select("word", "n", F.explode(F.concat(_halves(F.col("word"), length, True), _halves(F.col("word"), length + 1, True))).alias("k")).select("word", "n", "k.key", "k.finer")
    large = posted.groupBy("key").count().where(F.col("count") > hot).select("key", F.lit(True).alias("large"))
    dealt = posted.join(large, "key", "left").select("word", "n", F.explode(F.when(F.col("large"), F.col("finer")).otherwise(F.array("key"))).alias("key"))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[str, str, int]] = []

        def group(key: str, members: list[tuple[str, int]]) -> None:
            names = [w for w, _ in members]
            for i, j in near_pairs(names, int(key.partition("|")[0])):
                out.append((names[i], names[j], members[j][1]))
                out.append((names[j], names[i], members[i][1]))

        def rows() -> pa.RecordBatch:
            got = [pa.array([r[k] for r in out], kind) for k, kind in enumerate((pa.string(), pa.string(), pa.int64()))]
            out.clear()
            return pa.RecordBatch.from_arrays(got, names=["word", "near", "near_n"])

        now, members = None, []
        for batch in batches:
            for key, word, n in zip(batch.column("key").to_pylist(), batch.column("word").to_pylist(), batch.column("n").to_pylist(), strict=True):
                if key != now:
                    if now is not None:
                        group(now, members)
                    now, members = key, []
                members.append((word, n))
                if len(out) > 50_000:
                    yield rows()
        if now is not None:
            group(now, members)
        yield rows()

    by_key = dealt.select("key", "word", "n").repartition("key").sortWithinPartitions("key", "word")
    return by_key.mapInArrow(probe, "word string, near string, near_n long").dropDuplicates(["word", "near"])


def spelling_variants(docs: DataFrame, min_length: int = 6, min_count: int = 5, ratio: int = 5, every: int = 199, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """word, n, n_near, form, form_n, root for every word of ``docs``, as ``count_words`` counts them.

    n_near: the words one edit apart. form: of these the one with the largest n (of equals the smallest by code points), if its n is
    at least ``ratio`` times the word's, else null with form_n. root: the end of the chain of forms, the word itself if it has none.
    An empty table gives no rows.
    """
    if min_length < 4 or ratio < 2:
        raise ValueError("min_length: 4 at least; ratio: 2 at least")
    scratch = Scratch(docs.sparkSession)
    words = scratch.keep(count_words(docs, min_length, min_count, every, id_col, text_col), "words")
    best = F.min(F.struct((-F.col("near_n")).alias("order"), F.col("near"), F.col("near_n"))).alias("best")
    near = near_words(words, hot).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best)
    joined = words.join(near, "word", "left")
    has = F.col("best.near_n") >= ratio * F.col("n")
    out = scratch.keep(joined.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(has, F.col("best.near")).alias("form"), F.when(has, F.col("best.near_n")).alias("form_n")), "variants")
    # each round doubles the steps; a step multiplies n by the ratio, so a few rounds reach every end
    roots = scratch.keep(out.where("form is not null").select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "roots")
    while Scratch.rows(roots):
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        after = roots.drop("moved").join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        after = scratch.keep(after, "roots", moved=F.count_if("moved"))
        scratch.drop(roots)
        roots = after
        if not roots._quayside_seen["moved"]:
            break
    return out.join(roots.drop("moved"), "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
