"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.llm._common import Scratch

REST = 16_384  # links that one task puts together


class Sets:
    """Sets of numbers that are joined, link by link."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (up := self.parent.setdefault(x, x)) != x:
            self.parent[x] = self.parent[up]
            x = up
        return x

    def join(self, x: int, y: int) -> bool:
        """Whether that made one set of two."""
        p, q = self.root(x), self.root(y)
        self.parent[p] = q
        return p != q


def components(links: DataFrame, scratch: Scratch, limit: int = REST) -> DataFrame:
    """(node, component) of every node of ``links`` (a, b); a component is named after one of its nodes.

    The graph is contracted round by round: every node is merged into that of its neighbours or itself that comes first
    in an order drawn anew for the round, and links are put between what is left; inner and repeated links fall
    out. A star is gone after one round, and any graph loses a fixed share of its nodes each round, so the rounds go on
    until at most ``limit`` links are left, which one task puts together. Then the rounds' tables are joined, the last first.
    An empty table gives no rows; links from a node to itself don't count. Tables are written to the shared folder.
    """

    def kept(ends: DataFrame) -> DataFrame:
        return scratch.keep(ends.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "links")

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = Sets()
        for batch in batches:
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                sets.join(a, b)
        nodes = list(sets.parent)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(map(sets.root, nodes), pa.int64())], names=["node", "to"])

    merged: list[DataFrame] = []
    left = kept(links)
    while scratch.rows(left) > limit:
        turn = F.lit(len(merged))
        both = left.select(F.col("a").alias("node"), F.col("b").alias("to")).union(left.select("b", "a"))
        first = F.min(F.struct(F.xxhash64("to", turn).alias("order"), "to")).alias("first")
        own = F.struct(F.xxhash64("node", turn).alias("order"), F.col("node").alias("to"))
        merged.append(scratch.keep(both.groupBy("node").agg(first).select("node", F.least("first", own)["to"].alias("to")), "merged"))
        to = lambda end: merged[-1].select(F.col("node").alias(end), F.col("to").alias(f"{end}_to"))
        after = kept(left.join(to("a"), "a").join(to("b"), "b").select(F.col("a_to").alias("a"), F.col("b_to").alias("b")))
        scratch.drop(left)
        left = after
    out = scratch.keep(left.coalesce(1).mapInArrow(rest, "node long, to long"), "merged").withColumnRenamed("to", "component")
    for step in reversed(merged):
        named = step.join(out.withColumnRenamed("node", "to"), "to", "left").select("node", F.coalesce("component", "to").alias("component"))
        out = scratch.keep(named, "components")
    return out
