"""Approximate nearest neighbours with a hash-prefix forest (LSH forest).

The vectors are dealt into shards of bounded size. In each shard every tree sorts its vectors by a long string of
hash bits (which side of a random hyperplane, through a point fitted on a bounded sample). A query finds its
longest matching prefix in each sorted array; all trees then ascend together, a bit at a time, until their ranges
hold enough candidates. Exact distances to these give the shard's nearest, and the shards' results are merged.
Equal vectors share all prefixes and come together, so a vector that fills a third of the table is no special case.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SHARD, QUERIES, MERGE = 16_384, 8_192, 512  # rows of a shard, queries of a block, shards whose results are merged first


class Forest:
    """The trees over one shard's vectors."""

    def __init__(self, vectors: np.ndarray, centre: np.ndarray, trees: int, bits: int, seed: int = 7):
        self.vectors, self.bits = vectors, bits
        self.centre, self.planes = centre, np.random.default_rng(seed).normal(size=(trees, vectors.shape[1], bits))
        self.order, self.keys = [], []
        for t in range(trees):
            key = self.codes(vectors, t)
            order = np.argsort(key, kind="stable")
            self.order.append(order)
            self.keys.append(key[order])

    def codes(self, x: np.ndarray, tree: int) -> np.ndarray:
        """Hash strings as integers, the first bit highest."""
        return ((x - self.centre) @ self.planes[tree] > 0) @ (1 << np.arange(self.bits - 1, -1, -1, dtype=np.int64))

    def ranges(self, queries: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        """For each tree and query the range that shares the first ``level`` bits."""
        drop = self.bits - level
        low = np.empty((len(self.keys), len(queries[0])), dtype=np.int64)
        high = np.empty_like(low)
        for t, keys in enumerate(self.keys):
            prefix = queries[t] >> drop
            low[t], high[t] = np.searchsorted(keys, prefix << drop), np.searchsorted(keys, (prefix + 1) << drop)
        return low, high

    def candidates(self, queries: np.ndarray, enough: int):
        """For each query the rows of the longest prefixes that hold ``enough`` of them, or all rows."""
        codes = [self.codes(queries, t) for t in range(len(self.keys))]
        todo, n = np.arange(len(queries)), len(self.vectors)
        found: list[np.ndarray | None] = [None] * len(queries)
        for level in range(self.bits, -1, -1):
            low, high = self.ranges([c[todo] for c in codes], level)
            # ranges that together hold fewer rows than needed can't hold enough different ones
            ready = np.flatnonzero((high - low).sum(axis=0) >= min(enough, n))
            done = []
            for j in ready.tolist():
                mark = np.zeros(n, dtype=bool)
                for t, order in enumerate(self.order):
                    mark[order[low[t, j] : high[t, j]]] = True
                rows = np.flatnonzero(mark)
                if len(rows) >= enough or level == 0:
                    found[todo[j]] = rows
                    done.append(j)
            todo = np.delete(todo, done)
            if not len(todo):
                break
        return found


def distances(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    return np.sqrt(((vectors - query) ** 2).sum(axis=1))


def usable(vec: Column) -> Column:
    """Neither null nor all zero nor with null or non-finite components."""
    fine = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vec.isNotNull() & F.coalesce(fine, F.lit(False)) & F.coalesce(F.exists(vec, lambda x: x != 0), F.lit(False))


def nearest(
    table: DataFrame,
    is_query: Column,
    k: int = 10,
    trees: int = 64,
    bits: int = 24,
    share: float = 0.5,
    least: int = 400,
    sample: int = 4_000,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
) -> DataFrame:
    """query_id, rank, vec_id, score: each query's ``k`` nearest rows found, by Euclidean distance, nearest first.

    ``is_query`` is a condition on ``id``. A row is no neighbour of a query with its own id. Vectors that aren't ``usable``
    or have a null id take no part; a query's neighbours have its own dimension. Ties go to the smaller id; repeated rows are
    separate neighbours; fewer than ``k`` other rows give fewer. Query rows with the same id and different vectors are
    queries of their own, equal ones are asked once. An empty table gives no rows; other columns aren't read.
    Every row is indexed; ``sample`` bounds only the rows from which the hyperplanes' common point is fitted.
    ``share`` of a shard, and ``least`` rows, are enough candidates.
    """
    rows = table.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vec_col}`").cast("array<double>").alias("vec")).where(F.col("id").isNotNull() & usable(F.col("vec")))
    spark = table.sparkSession
    fitted = rows.orderBy(F.xxhash64("id"), "id").limit(sample).select("vec").collect()
    hit = [T.StructField("vec_id", T.LongType()), T.StructField("score", T.DoubleType())]
    out = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("asked", T.LongType()), T.StructField("query_id", T.LongType()), *hit])
    if not fitted:
        return spark.createDataFrame([], T.StructType([T.StructField("query_id", T.LongType()), T.StructField("rank", T.IntegerType()), *hit]))
    sizes: dict[int, list] = {}
    for r in fitted:
        sizes.setdefault(len(r.vec), []).append(r.vec)
    centres = {dim: np.median(np.array(vecs), axis=0) for dim, vecs in sizes.items()}
    rows = rows.withColumn("dim", F.size("vec"))
    n, q = rows.agg(F.count(F.lit(1)), F.count(F.when(is_query, 1))).first()
    shards, blocks = max(1, -(-n // SHARD)), max(1, -(-q // QUERIES))
    # every block of queries meets every shard: a stated query set against all rows, in blocks
    index = rows.withColumn("shard", F.pmod(F.xxhash64("id", "vec"), F.lit(shards)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asked = rows.where(is_query).withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).dropDuplicates(["id", "vec"]).withColumn("asked", F.xxhash64("id", "vec")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))

    def search(own: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        got: dict[str, list] = {"part": [], "asked": [], "query_id": [], "vec_id": [], "score": []}
        if len(own) and len(queries):
            own = own.sort_values("id", kind="stable")
            ids, vectors = own["id"].to_numpy(), np.stack(own["vec"].to_numpy())
            asked_ids, asked_vecs = queries["id"].to_numpy(), np.stack(queries["vec"].to_numpy())
            forest = Forest(vectors, centres.get(vectors.shape[1], np.zeros(vectors.shape[1])), trees, bits)
            enough = max(least, int(share * len(ids)))
            for i in range(0, len(asked_ids), 256):
                for j, near in enumerate(forest.candidates(asked_vecs[i : i + 256], enough), i):
                    near = near[ids[near] != asked_ids[j]]
                    d = distances(vectors[near], asked_vecs[j])
                    if len(d) > k:  # ties at the k-th stay in
                        close = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1])
                        near, d = near[close], d[close]
                    best = np.lexsort((ids[near], d))[:k]
                    got["part"] += [int(queries["shard"].iloc[0]) // MERGE] * len(best)
                    got["asked"] += [int(queries["asked"].iloc[j])] * len(best)
                    got["query_id"] += [int(asked_ids[j])] * len(best)
                    got["vec_id"] += ids[near[best]].tolist()
                    got["score"] += d[best].tolist()
        return pd.DataFrame(got).astype({"part": "int32", "asked": "int64", "query_id": "int64", "vec_id": "int64", "score": "float64"})

    found = asked.groupBy("dim", "shard", "block").cogroup(index.groupBy("dim", "shard", "block")).applyInPandas(lambda a, b: search(b, a), out)
    best = lambda hits: F.slice(F.sort_array(hits), 1, k)
    parts = found.groupBy("query_id", "asked", "part").agg(best(F.collect_list(F.struct("score", "vec_id"))).alias("near"))
    lists = parts.groupBy("query_id", "asked").agg(best(F.flatten(F.collect_list("near"))).alias("near"))
    return lists.select("query_id", F.posexplode("near").alias("at", "hit")).select("query_id", (F.col("at") + 1).alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score"))
