"""Near-duplicate documents by BagMinHash signatures, banding and verified multiset overlap.

1. Every text gives a bag of word shingles, a signature and its bands. Texts with equal bags are one class,
   combined before they are shuffled, so a hot group of copies is one row from here on.
2. Classes that share a band are candidates. No bucket is expanded into its pairs: each bucket's leader is
   compared with its other members, links are followed to components, and only buckets that still hold several
   components go on, with another leader. What is left after these rounds is compared exactly, whatever its size: the
   buckets that hang together form clusters, whose texts are compared block by block with matrix products. Of each pair
   of blocks only a spanning forest of its links comes out, and a cluster's largest component isn't compared with itself.
3. A pair is a link if the sum of smaller counts over the sum of larger counts reaches the threshold, computed
   on the texts themselves.

Groups that can be hot (bands, components, classes) are aggregated first, and what comes of it meets the group's
rows in salted parts.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside.llm import bagminhash as bag
from quayside.llm._common import Scratch, each_salt, free_name, numbered, salt, salts, text_blocks, text_of
from quayside.llm.graph import Sets, components

BANDS, ROWS = 32, 6  # two texts at 0.8 share a band with a probability of 0.99994
PART = 512  # candidates of one leader that meet its text in one group
BROADCAST = 2_000_000  # rows of one number each that may be broadcast; beyond that they are shuffled
BLOCK, BLOCK_WORDS = 256, 1 << 18  # texts, and words, of a block on average


def signed(docs: DataFrame, shingle: int, bands: int, rows: int) -> DataFrame:
    """(row, id, key1, key2, size, bands) of each row of (row, id, text)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches, "text"):
            texts = block.column("text")
            t, s, c, n = bag.bags(texts, shingle)
            k1, k2, size = bag.fingerprints(t, s, c, len(texts))
            for i in np.flatnonzero(n == 0).tolist():  # without words: only equal texts belong together
                raw = pa.array([(texts[i].as_py() or "").encode().hex() or "0"])
                k1[i], k2[i] = bag.mix(bag.words(raw)[0])[0], U0
            sig = bag.bands(bag.signatures(t, s, c, len(texts), bands * rows), rows)
            flat = sig[size > 0].reshape(-1).view(np.int64)
            offsets = np.concatenate([[0], np.cumsum(np.where(size > 0, bands, 0))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [block.column("row"), block.column("id"), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), pa.array(size.astype(np.int64)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))],
                names=["row", "id", "key1", "key2", "size", "bands"],
            )

    return docs.mapInArrow(sign, "row long, id long, key1 long, key2 long, size long, bands array<long>")


U0 = np.uint64(0)


def verified(pairs: DataFrame, texts: DataFrame, shingle: int, threshold: float) -> DataFrame:
    """Links (a, b) between the components of those pairs (a, b, component_a, component_b) whose bags overlap enough.

    ``a`` may be the same in very many pairs: it meets them in parts.
    """
    parts = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")).select("a", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / PART).cast("int"))).alias("part"), F.floor((F.col("n") - 1) / PART).alias("last"))
    leaders = parts.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    lasts = parts.where("part = 0").select("a", "last")
    dealt = pairs.join(lasts, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("last") + 1).cast("int")).drop("last")
    members = dealt.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    met = members.join(leaders.drop("last").hint("merge"), ["a", "part"]).select("a", "b", "component_a", "component_b", "text_a", "text_b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: OrderedDict[int, tuple[np.ndarray, np.ndarray]] = OrderedDict()

        def one(t, s, c, k, edges):
            return s[edges[k] : edges[k + 1]], c[edges[k] : edges[k + 1]]

        for block in text_blocks(batches, "text_b"):
            a = block.column("a").to_pylist()
            fresh = [k for k in dict((x, i) for i, x in enumerate(a) if x not in known).values()]
            if fresh:
                t, s, c, _ = bag.bags(block.column("text_a").take(pa.array(fresh)), shingle)
                edges = np.searchsorted(t, np.arange(len(fresh) + 1))
                for k, i in enumerate(fresh):
                    known[a[i]] = one(t, s, c, k, edges)
            t, s, c, _ = bag.bags(block.column("text_b"), shingle)
            edges = np.searchsorted(t, np.arange(len(a) + 1))
            keep = []
            for k, x in enumerate(a):
                left, right = known[x], one(t, s, c, k, edges)
                small = bag.overlap(left, right)
                large = int(left[1].sum()) + int(right[1].sum()) - small
                keep.append(large > 0 and small >= threshold * large - 1e-9)
            while len(known) > 16:
                known.popitem(last=False)
            yield pa.RecordBatch.from_arrays([block.column("component_a"), block.column("component_b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return met.mapInArrow(check, "a long, b long")


def overlaps(left: tuple[np.ndarray, ...], right: tuple[np.ndarray, ...], n_left: int, n_right: int) -> np.ndarray:
    """Multiset overlaps of all bags of one block, as (text, shingle, count), with all of another."""
    (t1, s1, c1), (t2, s2, c2) = left, right
    out = np.zeros((n_left, n_right), dtype=np.float32)
    shared = np.intersect1d(s1, s2)
    if not len(shared):
        return out
    in1, in2 = np.isin(s1, shared), np.isin(s2, shared)
    t1, s1, c1, t2, s2, c2 = t1[in1], np.searchsorted(shared, s1[in1]), c1[in1], t2[in2], np.searchsorted(shared, s2[in2]), c2[in2]
    for at in range(0, len(shared), 8192):
        a, b = np.zeros((n_left, 8192), dtype=np.float32), np.zeros((n_right, 8192), dtype=np.float32)
        k1, k2 = (s1 >= at) & (s1 < at + 8192), (s2 >= at) & (s2 < at + 8192)
        a[t1[k1], s1[k1] - at] = 1
        b[t2[k2], s2[k2] - at] = 1
        out += a @ b.T
    more1, more2 = c1 > 1, c2 > 1  # each shared shingle counts once so far
    t1, s1, c1, t2, s2, c2 = t1[more1], s1[more1], c1[more1], t2[more2], s2[more2], c2[more2]
    if len(s1) and len(s2):
        count = np.zeros(len(shared), dtype=np.int64)
        edges = np.searchsorted(t1, np.arange(n_left + 1))
        for k in np.unique(t1).tolist():
            own = slice(edges[k], edges[k + 1])
            count[s1[own]] = c1[own] - 1
            out[k] += np.bincount(t2, weights=np.minimum(count[s2], c2 - 1), minlength=n_right)
            count[s1[own]] = 0
    return out


def forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Of the links between ``a`` and ``b`` so many that all components stay the same: fewer than there are nodes."""
    sets = Sets()
    return [(x, y) for x, y in np.unique(np.column_stack([a, b]), axis=0).tolist() if sets.join(x, y)]


def block_links(members: DataFrame, texts: DataFrame, scratch: Scratch, shingle: int, threshold: float) -> DataFrame:
    """Links (a, b) between components of (band, node, size, component) whose texts are alike, a spanning forest of each pair of blocks."""
    # a band hangs on the component that has most of it, so that a cluster is nearly a star and soon found
    in_band = members.groupBy("band", "component").agg(F.count(F.lit(1)).alias("n")).withColumn("salt", salt("component"))
    lead = in_band.groupBy("band").agg(F.max(F.struct("n", "component")).alias("lead"), salts()).select("band", "lead", each_salt())
    hang = in_band.join(lead, ["band", "salt"]).select(F.col("lead.component").alias("a"), F.col("component").alias("b")).where("a <> b").distinct()
    clusters = components(hang, scratch).select(F.col("node").alias("component"), F.col("component").alias("cluster"))
    own = scratch.keep(members.select("node", "component", "size").distinct().withColumn("salt", salt("node")), "own")
    parts = own.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words"), salts()).join(clusters, "component")
    parts = scratch.keep(parts.withColumnsRenamed({"salts": "own_salts"}).withColumn("salt", salt("component")), "parts")
    whole = parts.groupBy("cluster").agg(F.max(F.struct("n", "words", "component")).alias("most"), F.sum("n").alias("n"), F.sum("words").alias("words"), F.count(F.lit(1)).alias("parts"), salts()).where("parts > 1")
    blocks = lambda n, words: F.ceil(F.greatest(n / BLOCK, words / BLOCK_WORDS, F.lit(1))).cast("int")
    inner, outer = blocks(F.col("most.n"), F.col("most.words")), blocks(F.col("n") - F.col("most.n"), F.col("words") - F.col("most.words"))
    whole = whole.select("cluster", F.col("most.component").alias("largest"), inner.alias("inner"), outer.alias("outer"), each_salt())
    named = parts.select("cluster", "component", "own_salts", "salt").join(whole, ["cluster", "salt"]).select("cluster", "component", "largest", "inner", "outer", F.col("own_salts").alias("salts"))
    spread = own.join(named.select("*", each_salt()).drop("salts"), ["component", "salt"])
    hashed, largest = F.xxhash64("node", F.lit(1)), F.col("component") == F.col("largest")
    spread = spread.withColumn("block", F.when(largest, F.pmod(hashed, "inner")).otherwise(F.col("inner") + F.pmod(hashed, "outer")).cast("int"))
    others = F.sequence(F.when(largest, F.col("inner")).otherwise(F.lit(0)), F.col("inner") + F.col("outer") - 1)
    met = spread.select("cluster", "node", "component", "block", F.explode(others).alias("other")).select("cluster", "node", "component", "block", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"))

    def compare(rows: pa.Table) -> pa.Table:
        block = rows.column("block")
        left, right = rows.filter(pc.equal(block, rows.column("p"))), rows.filter(pc.equal(block, rows.column("q")))
        found: list[tuple[int, int]] = []
        if len(left) and len(right):
            of = lambda t: bag.bags(t.column("text").combine_chunks(), shingle)[:3]
            b1 = of(left)
            b2 = b1 if left.equals(right) else of(right)
            small = overlaps(b1, b2, len(left), len(right))
            sizes = np.bincount(b1[0], weights=b1[2], minlength=len(left))[:, None] + np.bincount(b2[0], weights=b2[2], minlength=len(right))[None, :]
            i, j = np.nonzero(small >= threshold * (sizes - small) - 1e-3)
            a, b = left.column("component").to_numpy()[i], right.column("component").to_numpy()[j]
            found = forest(a[a != b], b[a != b])
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    return met.join(texts, "node").groupBy("cluster", "p", "q").applyInArrow(compare, "a long, b long")


def near_dedup(
    docs: DataFrame,
    threshold: float = 0.8,
    shingle: int = 5,
    bands: int = BANDS,
    rows: int = ROWS,
    leader_rounds: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    row: Column | None = None,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id, group_id, group_size, kept and the row's number ``_row``.

    class_id and group_id are the smallest ids of the texts with an equal bag and of the group of linked classes.
    Words are runs of ASCII letters (case ignored), digits and characters beyond ASCII; a text of fewer words than a shingle
    has one shingle of them all; texts without words (null and empty ones too) belong together only if equal. One
    row of each group stays: that with the smallest id, a null id being larger than any other. An empty
    input gives no rows. Other columns aren't read.
    """
    scratch = Scratch(docs.sparkSession)
    if row is None:
        name = free_name(docs)
        docs, row = numbered(docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")), name), F.col(name)
    rows_ = docs.select(row.alias("row"), F.col(f"`{id_col}`").cast("long").alias("id"), text_of(text_col).alias("text"))
    signs = scratch.keep(signed(rows_, shingle, bands, rows).withColumn("salt", salt("row")), "signed")
    best = F.struct(F.coalesce("id", F.lit((1 << 63) - 1)).alias("order"), "row")
    # a node is a class, named after the row number of its first row
    classes = signs.groupBy("key1", "key2").agg(F.min(best).alias("first"), F.count(F.lit(1)).alias("n"), salts(), F.min(F.struct("row", "bands", "size")).alias("any"))
    classes = scratch.keep(classes.select("key1", "key2", "first", "n", "salts", F.col("any.row").alias("node"), F.col("any.size").alias("size"), F.col("any.bands").alias("bands")), "classes")
    members = classes.select("node", "size", F.explode("bands").alias("band")).withColumn("salt", salt("node"))
    shared = members.groupBy("band").agg(F.count(F.lit(1)).alias("n"), salts()).where("n > 1").select("band", each_salt())
    members = scratch.keep(members.join(shared, ["band", "salt"]), "members")
    labels = scratch.keep(members.groupBy("node").agg(F.first("salt").alias("salt")).withColumn("component", F.col("node")), "labels")
    few = scratch.rows(labels) <= BROADCAST
    wanted = F.broadcast(labels.select("node")) if few else labels.select("node")
    texts = scratch.keep(rows_.select(F.col("row").alias("node"), "text").join(wanted, "node"), "texts")

    def still_open(members: DataFrame, turn: int) -> DataFrame:
        """Those of the members whose bands hold several components, with the band's leader. Bands that don't never will again."""
        named = members.select("band", "node", "size", "salt").join(labels.select("node", "component"), "node")
        lead = F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("order"), "node", "size", "component")).alias("lead")
        several = named.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), lead, salts()).where("lo <> hi").select("band", "lead", each_salt())
        return scratch.keep(named.join(several, ["band", "salt"]), "open")

    def merged(links: DataFrame) -> DataFrame:
        """The labels after components that are linked have become one."""
        to = components(links, scratch).select(F.col("node").alias("component"), F.col("component").alias("to"))
        parts = labels.groupBy("component").agg(salts()).join(to, "component").select("component", "to", each_salt())
        return scratch.keep(labels.join(parts, ["component", "salt"], "left").select("node", "salt", F.coalesce("to", "component").alias("component")), "labels")

    for turn in range(leader_rounds):
        members = still_open(members, turn)
        pairs = members.where("component <> lead.component").select(F.col("lead.node").alias("a"), F.col("node").alias("b"), F.col("lead.component").alias("component_a"), F.col("component").alias("component_b"), F.col("lead.size").alias("size_a"), F.col("size").alias("size_b"))
        # pairs whose sizes differ too much can't overlap enough
        pairs = scratch.keep(pairs.where(F.least("size_a", "size_b") >= F.greatest("size_a", "size_b") * (threshold - 1e-9)).drop("size_a", "size_b").distinct(), "pairs")
        if not scratch.rows(pairs):
            break
        labels = merged(verified(pairs, texts, shingle, threshold))
    rest = still_open(members, leader_rounds)
    if scratch.rows(rest):
        labels = merged(block_links(rest, texts, scratch, shingle, threshold))
    by_class = classes.select("key1", "key2", "first", "n", "salts", "node").join(labels.select("node", "component"), "node", "left")
    by_class = scratch.keep(by_class.select("key1", "key2", "first", "n", F.col("salts").alias("row_salts"), F.coalesce("component", "node").alias("component"), salt("node")), "by-class")
    by_group = by_class.groupBy("component").agg(F.min("first").alias("group_first"), F.sum("n").alias("group_size"), salts()).select("component", "group_first", "group_size", each_salt())
    final = by_class.join(by_group, ["component", "salt"]).select("key1", "key2", "first", "group_first", "group_size", F.col("row_salts").alias("salts")).select("*", each_salt()).drop("salts")
    null_if_none = lambda c: F.when(F.col(c) != (1 << 63) - 1, F.col(c))
    return signs.select("row", "id", "key1", "key2", "salt").join(final, ["key1", "key2", "salt"]).select(
        F.col("id").alias(id_col),
        null_if_none("first.order").alias("class_id"),
        null_if_none("group_first.order").alias("group_id"),
        F.col("group_size").cast("long").alias("group_size"),
        (F.col("row") == F.col("group_first.row")).alias("kept"),
        F.col("row").alias("_row"),
    )


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that near_dedup keeps, with all their columns. Null texts count as empty; an empty table gives no rows."""
    name = free_name(docs)
    rows = numbered(docs, name)
    kept = near_dedup(rows, id_col=id_col, text_col=text_col, row=F.col(name), **options).where("kept").select(F.col("_row").alias(name))
    return rows.join(kept, name, "left_semi").drop(name)
