"""Running sums and maxima whose groups may be larger than a task.

A group's rows are cut into buckets in the order of the rows (hours of a log, say). Buckets are summed up first; the sums of a group's
buckets before each, a short table, are then added to the running sums within the bucket. So a group is spread over as many tasks
as it has buckets, and only its buckets' sums meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running(rows: DataFrame, group: list[str], bucket: Column, order: list[Column], sums: dict[str, Column] | None = None, maxes: dict[str, Column] | None = None) -> DataFrame:
    """``rows`` with the running sums and maxima (null where nothing came yet) of these values, the row itself included.

    ``bucket`` must not fall in the order of the rows, which ``order`` must make complete: rows that tie in it get one
    another's values in no stated order.
    """
    sums, maxes = sums or {}, maxes or {}
    cut = rows.withColumns({"_bucket": bucket, **{f"_{k}": F.coalesce(c.cast("long"), F.lit(0).cast("long")) for k, c in sums.items()}, **{f"_{k}": c for k, c in maxes.items()}})
    totals = cut.groupBy(*group, "_bucket").agg(*[F.sum(f"_{k}").alias(f"_{k}_total") for k in sums], *[F.max(f"_{k}").alias(f"_{k}_total") for k in maxes])
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*group, "_bucket", *[F.coalesce(F.sum(f"_{k}_total").over(before), F.lit(0).cast("long")).alias(f"_{k}_before") for k in sums], *[F.max(f"_{k}_total").over(before).alias(f"_{k}_before") for k in maxes])
    inner = Window.partitionBy(*group, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = cut.select(*rows.columns, "_bucket", *[F.sum(f"_{k}").over(inner).alias(f"_{k}_here") for k in sums], *[F.max(f"_{k}").over(inner).alias(f"_{k}_here") for k in maxes])
    joined = local.join(carried, [*group, "_bucket"])
    return joined.select(*rows.columns, *[(F.col(f"_{k}_before") + F.col(f"_{k}_here")).alias(k) for k in sums], *[F.greatest(f"_{k}_before", f"_{k}_here").alias(k) for k in maxes])


def within(rows: DataFrame, group: list[str], at: str, width: int, bucket: int, sums: dict[str, Column]) -> DataFrame:
    """For each distinct (group, at): the sums over the group's rows from ``at - width`` to ``at``, both included.

    ``at`` is a whole number, ``bucket`` the span of a bucket. Sums up to each time less those before its window: each time stands in the table
    twice, where it is and where its window begins.
    """
    points = rows.groupBy(*group, at).agg(*[F.coalesce(F.sum(c.cast("long")), F.lit(0).cast("long")).alias(k) for k, c in sums.items()])
    ends = points.select(*group, F.col(at).alias("_at"), F.lit(1).alias("_turn"), F.col(at).alias("_of"), *sums)
    starts = points.select(*group, (F.col(at) - width).alias("_at"), F.lit(0).alias("_turn"), F.col(at).alias("_of"), *[F.lit(0).cast("long").alias(k) for k in sums])
    both = running(ends.unionByName(starts), group, F.floor(F.col("_at") / bucket), [F.col("_at"), F.col("_turn")], {f"{k}_so_far": F.col(k) for k in sums})
    part = lambda k: F.sum(F.when(F.col("_turn") == 1, F.col(f"{k}_so_far")).otherwise(-F.col(f"{k}_so_far"))).alias(k)
    return both.groupBy(*group, F.col("_of").alias(at)).agg(*[part(k) for k in sums])
