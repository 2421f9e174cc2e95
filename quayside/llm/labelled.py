"""A bounded sample of labelled rows to fit a classifier on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside.llm._common import Scratch, text_of


def crc_remainder(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the text ''."""
    return F.pmod(F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def sample(docs: DataFrame, labels: DataFrame, label: str, train: Column, per_class: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, y, text) of at most ``per_class`` ids of each label, those with the smallest hashes, with whole texts.

    ``train`` tells by the id which rows may be learned from. Labels other than 0 and 1 are left out; of an id
    with several labels the largest counts, and of its rows with different texts the alphabetically first text, so that
    ``per_class`` bounds rows as well as ids. Only the chosen ids, bounded by ``per_class``, are broadcast; the texts stay
    on the executors, in the shared folder.
    """
    lab = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label}`").alias("y")).where("id is not null and y in (0, 1)").groupBy("id").agg(F.max("y").alias("y")).where(train)
    order = F.xxhash64("id")
    chosen = lab.where("y = 1").select("id", "y").orderBy(order, "id").limit(per_class).union(lab.where("y = 0").select("id", "y").orderBy(order, "id").limit(per_class))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), text_of(text_col).alias("text")).join(F.broadcast(chosen), "id")
    return Scratch(docs.sparkSession).keep(rows.groupBy("id").agg(F.max("y").cast("int").alias("y"), F.min("text").alias("text")), "sample")


def logistic(x, y, l2: float = 1e-2, steps: int = 50):
    """Slope and intercept of a one-feature logistic regression, classes weighted alike (Newton's method)."""
    import numpy as np

    x, y = np.asarray(x, dtype=float), np.asarray(y, dtype=float)
    design = np.column_stack([x, np.ones(len(x))])
    weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    beta = np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        grad = design.T @ (weight * (p - y)) + l2 * beta * np.array([1.0, 0.0])
        hess = (design * (weight * p * (1 - p))[:, None]).T @ design + np.diag([l2, 1e-9])
        step = np.linalg.solve(hess, grad)
        beta -= step
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), float(beta[1])
