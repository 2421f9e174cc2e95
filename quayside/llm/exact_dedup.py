"""Exact deduplication that a hot group of copies can't skew.

Rows are combined in three steps, each of which compares whole texts: within each partition (Spark's partial
aggregation), then over (digest, salt), then over the digest's salt winners. A group that holds a third of all
rows leaves each partition as at most one row per salt.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside.llm._common import each_salt, free_name, numbered, salt, salts, text_of


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    normalise: Callable[[Column], Column] | None = None,
    digest: Callable[[Column], Column] = sha256,
    row: Column | None = None,
) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, keep_id, group_size, kept, text_sha256 and the row's number ``_row``.

    Equal texts (after ``normalise``; null counts as empty) form a group; the row with the largest id stays, a
    null id being smaller than any other; of rows with the same largest id exactly one stays. An empty input gives
    no rows. Other columns of ``docs`` are not read. ``digest`` only deals rows out: where two texts share one,
    they are told apart by their content. ``row`` is a column that numbers the rows.
    """
    text = text_of(text_col)
    text = normalise(text) if normalise else text
    if row is None:
        name = free_name(docs)
        docs, row = numbered(docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")), name), F.col(name)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("text"), row.alias("row"))
    keyed = rows.withColumn("digest", digest(F.col("text"))).withColumn("sha", sha256(F.col("text")) if digest is not sha256 else F.col("digest"))
    salted = keyed.withColumn("salt", salt("row"))
    local = salted.groupBy("digest", "salt", "text").agg(F.max(F.struct("id", "row")).alias("best"), F.count(F.lit(1)).alias("n"))
    winners = local.groupBy("digest", "text").agg(F.max("best").alias("best"), F.sum("n").alias("n"), salts())
    # the result of a group goes back to its rows by salt, so that a hot group's rows don't meet in one task either
    winners = winners.select("digest", sha256(F.col("text")).alias("sha"), "best", "n", each_salt())
    joined = salted.select("id", "row", "digest", "sha", "salt").join(winners, ["digest", "sha", "salt"])
    return joined.select(
        F.col("id").alias(id_col),
        F.col("best.id").alias("keep_id"),
        F.col("n").cast("long").alias("group_size"),
        (F.col("row") == F.col("best.row")).alias("kept"),
        F.col("sha").alias("text_sha256"),
        F.col("row").alias("_row"),
    )


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that exact_dedup keeps, with all their columns. Null texts count as empty; an empty table gives no rows."""
    name = free_name(docs)
    rows = numbered(docs, name)
    kept = exact_dedup(rows, id_col, text_col, row=F.col(name)).where("kept").select(F.col("_row").alias(name))
    return rows.join(kept, name, "left_semi").drop(name)
