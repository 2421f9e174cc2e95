"""Running values over groups cut into buckets, against plain loops."""

import random

from pyspark.sql import functions as F

from quayside.operators.prefix import running, within

ROWS = [(random.Random(k).choice("aab"), k, random.Random(k + 1).randrange(-5, 40), random.Random(k + 2).choice([None, 1, 2, 7, -3])) for k in range(300)] + [(None, 900, 3, 4), (None, 901, 3, 5)]


def test_running(spark):
    df = spark.createDataFrame(ROWS, "g string, id long, at long, v long").where("g is not null")
    for span in (1, 7, 1000):
        got = running(df, ["g"], F.floor(F.col("at") / span), [F.col("at"), F.col("id")], {"total": F.col("v"), "n": F.lit(1)}, {"top": F.col("v")})
        out = {(r.g, r.id): (r.total, r.n, r.top) for r in got.collect()}
        for g in "ab":
            own = sorted((at, i, v) for h, i, at, v in ROWS if h == g)
            for k, (_, i, _) in enumerate(own, 1):
                seen = [v for _, _, v in own[:k] if v is not None]
                assert out[g, i] == (sum(seen), k, max(seen, default=None))
    assert running(df.limit(0), ["g"], F.col("at"), [F.col("at")], {"total": F.col("v")}).count() == 0


def test_within(spark):
    df = spark.createDataFrame(ROWS, "g string, id long, at long, v long").where("g is not null")
    for width, span in ((0, 3), (5, 2), (17, 100)):
        out = {(r.g, r.at): (r.total, r.n) for r in within(df, ["g"], "at", width, span, {"total": F.col("v"), "n": F.lit(1)}).collect()}
        want = {}
        for g, _, at, _ in ROWS:
            if g:
                near = [v for h, _, t, v in ROWS if h == g and at - width <= t <= at]
                want[g, at] = (sum(v for v in near if v is not None), len(near))
        assert out == want


def test_a_group_is_spread_over_its_buckets(spark):
    """One group only: no task of the windows gets more than a bucket."""
    df = spark.range(20_000).select(F.when(F.col("id") >= 0, "one").otherwise("two").alias("g"), "id", (F.col("id") * 10).alias("at"))
    plan = running(df, ["g"], F.floor(F.col("at") / 1000), [F.col("at")], {"n": F.lit(1)})._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(g" in plan and "_bucket" in plan[plan.index("hashpartitioning(g") :][:60]
    last = running(df, ["g"], F.floor(F.col("at") / 1000), [F.col("at")], {"n": F.lit(1)}).orderBy(F.desc("at")).first()
    assert last.n == 20_000
