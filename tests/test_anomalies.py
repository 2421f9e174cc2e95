"""Pairs of prices that are far apart, counted without listing them."""

import datetime
import random

import numpy as np
from pyspark.sql import functions as F

from quayside.operators import prices as P

T0 = datetime.datetime(2024, 1, 1)


def pairs(rows, percent):
    out = {}
    for listing, t, a in rows:
        for other, u, b in rows:
            if listing == other and None not in (a, b, t, u) and t < u and a > 0 and abs(b - a) * 100 > a * percent:
                out[listing] = out.get(listing, 0) + 1
    return out


def test_both_ways_of_counting(spark):
    rnd = random.Random(4)
    rows = [(rnd.randrange(4), T0 + datetime.timedelta(hours=rnd.randrange(900)), rnd.choice([None, 0, 1, 2, 100, 150, 151, 50, 49, rnd.randrange(1, 400)])) for _ in range(260)]
    rows += [(9, T0, 5), (8, T0, 100), (8, T0, 300), (7, None, 5), (7, T0, 50), (6, T0, 0), (6, T0 + datetime.timedelta(1), 90)]
    df = spark.createDataFrame(rows, "listing_id long, recorded_at timestamp, price_pence long")
    for percent in (50, 0, 120):
        for in_row in (2_000, 0, 70):
            got = {r.listing_id: r.anomalies for r in P.anomalies(df, percent, in_row).collect()}
            assert got == pairs(rows, percent), (percent, in_row)
    assert P.anomalies(df.limit(0)).count() == 0


def test_a_listing_with_very_many_prices(spark):
    """As many ordered pairs as a sorted list of the earlier prices tells; no row holds them and no task most of them."""
    n = 20_000
    df = spark.range(n).select(F.lit(1).cast("long").alias("listing_id"), F.timestamp_seconds(F.col("id") * 60).alias("recorded_at"), (F.pmod(F.xxhash64("id"), F.lit(5_000)) + 1).cast("long").alias("price_pence"))
    values = [r[0] for r in df.orderBy("recorded_at").select("price_pence").collect()]
    want, seen = 0, np.zeros(5_001, dtype=np.int64)
    for b in values:
        want += int(seen[: -(-100 * b // 150)].sum() + seen[200 * b // 100 + 1 :].sum())
        seen[b] += 1
    assert P.anomalies(df).first().anomalies == want
