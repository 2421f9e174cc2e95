"""Streams over shuffled micro-batches give what an ordered log gives; state ends; a stopped run goes on where it ended."""

import datetime
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quayside.operators import events as batch, prices as P
from quayside.streaming import jobs as S

T0 = datetime.datetime(2024, 1, 1)
EVENTS = "id long, crawl_id long, event string, retailer string, created_at timestamp, duration_ms long"


def at(minutes):
    return T0 + datetime.timedelta(minutes=minutes)


def files(spark, folder, batches, schema):
    """One file for each micro-batch, oldest first."""
    import os

    for k, rows in enumerate(batches):
        path = f"{folder}/{k}.parquet"
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{folder}/tmp{k}")
        (part,) = [f for f in os.listdir(f"{folder}/tmp{k}") if f.endswith(".parquet")]
        os.rename(f"{folder}/tmp{k}/{part}", path)
        os.utime(path, (1_700_000_000 + k, 1_700_000_000 + k))


def stream(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*.parquet")


def log(seed, n, minutes=7):
    rnd = random.Random(seed)
    return [(k, rnd.randrange(6), rnd.choice(["started", "discovered", "completed", "failed", "failed"]), f"r{rnd.randrange(2)}", at(k * minutes + rnd.random()), 1000) for k in range(n)]


def shuffled(rows, size, reach, seed=1):
    """Batches of rows that stand up to ``reach`` places from where they belong."""
    rnd = random.Random(seed)
    order = sorted(range(len(rows)), key=lambda k: k + rnd.random() * reach)
    return [[rows[k] for k in order[i : i + size]] for i in range(0, len(rows), size)]


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def closing(rows):
    """Two late events of other keys, with which the watermark passes all the others."""
    return [*rows, [(10_000, 99, "completed", "end", at(50_000), None)], [(10_001, 99, "completed", "end", at(50_001), None)]]


def test_order_of_arrival_doesnt_matter(spark, tmp_path):
    rows = log(3, 120)
    ordered, mixed = str(tmp_path / "a"), str(tmp_path / "b")
    files(spark, ordered, closing([rows]), EVENTS)
    files(spark, mixed, closing(shuffled(rows, 17, 15)), EVENTS)
    for job in (S.crawl_rejects, S.health_changes, S.circuits):
        one = rows_of(S.run_available(job(stream(spark, ordered, EVENTS), late="12 hours")))
        two = rows_of(S.run_available(job(stream(spark, mixed, EVENTS), late="12 hours")))
        assert one == two and one, job.__name__
    table = spark.createDataFrame(rows, EVENTS)
    rejected = {(r.crawl_id, r.n) for r in S.run_available(S.crawl_rejects(stream(spark, mixed, EVENTS), late="12 hours")).groupBy("crawl_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert rejected == {(r.crawl_id, r.rejected) for r in batch.crawl_state(table).where("rejected > 0").collect()}


def test_keys_that_share_a_bucket(spark, tmp_path):
    import pandas as pd

    from quayside.streaming.ordered import Spec, fold_in_order

    folder = str(tmp_path / "buckets")
    files(spark, folder, closing(shuffled(log(4, 60), 20, 5)), EVENTS)
    spec = Spec(lambda last, row: ((row.id,), [(row.id, last and last[0])]), ["id"], "last long", "id long, before long", pd.Timedelta("60 days"))
    one, many = (rows_of(S.run_available(fold_in_order(stream(spark, folder, EVENTS), ["crawl_id"], "created_at", spec, "12 hours", n))) for n in (1, 64))
    assert one == many and len(one) >= 60


def test_late_rows_are_dropped(spark, tmp_path):
    folder = str(tmp_path / "late")
    rows = [(k, 1, "failed" if k == 1 else "discovered", "r", at(k * 60), None) for k in range(6)]
    files(spark, folder, [rows[:5], [rows[5]], [(90, 1, "completed", "r", at(61), None)], *closing([])], EVENTS)
    got = {r.id for r in S.run_available(S.crawl_rejects(stream(spark, folder, EVENTS), late="1 hour")).collect()}
    assert got == {2, 3, 4, 5}


def test_health_pauses_and_refuses(spark, tmp_path):
    folder = str(tmp_path / "health")
    rows = [(k, 1, "failed", "r", at(k * 10), None) for k in range(18)] + [(18, 1, "completed", "r", at(200), 5), (19, 1, "failed", "r", at(210), None)]
    files(spark, folder, closing([rows]), EVENTS)
    got = [(r.status, r.consecutive_failures, r.changed_at, r.paused_until, r.refused) for r in S.run_available(S.health_changes(stream(spark, folder, EVENTS))).orderBy("changed_at").collect()]
    # failures meanwhile don't extend a pause; one after its end begins another
    assert got == [("degraded", 5, at(40), None, False), ("failed", 10, at(90), at(150), False), ("failed", 16, at(150), at(210), False), ("active", 0, at(200), None, False)]


DROPS = "listing_id long, id long, dropped_at timestamp, old_price_pence long, new_price_pence long"


def test_alerts_rest_for_a_day_and_their_state_ends(spark, tmp_path):
    folder = str(tmp_path / "drops")
    drops = [(1, 1, at(0), 100, 50), (1, 2, at(60), 50, 40), (2, 3, at(120), 90, 30), (1, 4, at(24 * 60), 40, 30), (1, 5, at(24 * 60 + 1), 40, 30), (1, 6, at(60 * 60), 30, 20), (3, 7, at(100), 9, 8)]
    end = [[(9, 90, at(50_000), 2, 1)], [(9, 91, at(60_000), 2, 1)]]
    files(spark, folder, [drops[3:], drops[:3], *end], DROPS)
    matches = spark.createDataFrame([(1, 7), (2, 7), (3, 8), (9, 9)], "listing_id long, product_id long")
    alerts = spark.createDataFrame([(5, 7, 60, True, None), (6, 7, 35, True, at(-60)), (6, 8, 60, False, None), (7, 9, 60, True, None)], "user_id long, product_id long, target_price_pence long, is_active boolean, last_notified_at timestamp")
    out = S.run_available(S.user_alerts(stream(spark, folder, DROPS), matches, alerts, late="3 days"))
    got = rows_of(out.where("user_id < 7"))
    table = spark.createDataFrame(drops, DROPS)
    assert got == rows_of(P.alerts_with_cooldown(table, matches, alerts))
    assert {(r[0], r[3]) for r in got} == {(5, 1), (5, 5), (5, 6), (6, 4), (6, 6)}

    def kept(cooldown):
        """Rows of state after the last trigger."""
        seen = []
        hit = S.user_alerts(stream(spark, folder, DROPS), matches, alerts, cooldown_hours=cooldown, late="3 days")
        path = S.work_dir(spark)
        S.run_available(hit, path=path, each=lambda rows, k: seen.append(k))
        states = spark.read.format("statestore").option("stateVarName", "now").load(f"{path}/checkpoint")
        return states.count()

    assert kept(24) < kept(24 * 365)


def test_alerts_of_many_users_wait_as_drops_not_as_pairs(spark, tmp_path):
    r, folder = random.Random(3), str(tmp_path / "drops")
    drops = [(r.randrange(3), k, at(60 * r.randrange(150)), 100, r.randrange(20, 80)) for k in range(120)]
    files(spark, folder, [drops[:50], drops[50:], [(2, 900, at(60_000), 2, 1)], [(2, 901, at(70_000), 2, 1)]], DROPS)
    matches = spark.createDataFrame([(0, 7), (1, 7), (2, 8)], "listing_id long, product_id long")
    told = [None, at(-60), at(3_000)]
    users = [(u, r.choice([7, 8]), r.randrange(15, 90), r.random() < 0.9, r.choice(told)) for u in [*range(300), *range(100)]]
    alerts = spark.createDataFrame(users, "user_id long, product_id long, target_price_pence long, is_active boolean, last_notified_at timestamp")
    out = S.run_available(S.user_alerts(stream(spark, folder, DROPS), matches, alerts, late="8 days"))
    want = rows_of(P.alerts_with_cooldown(spark.createDataFrame(drops, DROPS), matches, alerts))
    assert rows_of(out.where("id < 900")) == want and len(want) > 500
    # nothing has passed: 122 drops wait, at most once in each of eight parts, whereas more than 10,000 pairs of drops and users would
    path = S.work_dir(spark)
    S.run_available(S.user_alerts(stream(spark, folder, DROPS), matches, alerts, late="900 days"), path=path)
    waiting = [x.list_element.block for x in spark.read.format("statestore").option("stateVarName", "pending").load(f"{path}/checkpoint").collect()]
    assert 100 < sum(pa.ipc.open_stream(b).read_all().num_rows for b in waiting) <= 122 * 8


def test_a_stopped_run_goes_on(spark, tmp_path):
    """Three triggers, the second of which is killed while it writes: nothing is lost and nothing comes twice."""
    rows = log(5, 90)
    batches = closing(shuffled(rows, 30, 10))
    want_folder, folder = str(tmp_path / "whole"), str(tmp_path / "parts")
    files(spark, want_folder, batches, EVENTS)
    want = {job: rows_of(S.run_available(job(stream(spark, want_folder, EVENTS), late="12 hours"))) for job in (S.crawl_rejects, S.health_changes, S.daily_statistics)}
    for job, expected in want.items():
        own, path = f"{folder}-{job.__name__}", S.work_dir(spark)
        files(spark, own, batches[:1], EVENTS)
        S.run_available(job(stream(spark, own, EVENTS), late="12 hours"), path=path)
        files(spark, own, batches[:3], EVENTS)

        def die(part, batch_id):
            raise RuntimeError("killed")

        with pytest.raises(Exception, match="killed"):
            S.run_available(job(stream(spark, own, EVENTS), late="12 hours"), path=path, each=die)
        files(spark, own, batches, EVENTS)
        assert rows_of(S.run_available(job(stream(spark, own, EVENTS), late="12 hours"), path=path)) == expected, job.__name__


@pytest.mark.parametrize("name", ["stream_daily_stats", "stream_failure_sessions"])
def test_queries_count_windows_that_are_still_open(spark, tmp_path, name):
    """All days and sessions of the table come out, also those that the watermark hasn't passed."""
    from quayside.plans.event_queries import QUERIES

    rows = [(k, k % 3, "error", at(k * 600), 1.0) for k in range(9)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, ts timestamp, value double").write.parquet(str(tmp_path / "events.parquet"))
    got = QUERIES[name](spark, str(tmp_path)).collect()
    assert sum(r.failed if name == "stream_daily_stats" else r.failures for r in got) == len(rows)


def test_first_seen_and_follow_ups(spark, tmp_path):
    folder = str(tmp_path / "seen")
    rows = [(k, 1, u, "r", at(k), None) for k, u in enumerate("abacabad")]
    files(spark, folder, [rows[:3], rows[3:6], rows[6:]], EVENTS)
    asked = []
    out = S.run_available(S.first_seen(stream(spark, folder, EVENTS), ["retailer", "event"]), each=lambda part, k: asked.append({r.event for r in part.collect()}))
    assert sorted(r.event for r in out.collect()) == ["a", "b", "c", "d"]
    assert [x for x in asked if x] == [{"a", "b"}, {"c"}, {"d"}]


def test_enrichment_is_the_batch_join(spark, tmp_path):
    rows = log(8, 80)
    folder = str(tmp_path / "enriched")
    files(spark, folder, closing(shuffled(rows, 20, 6)), EVENTS)
    got = rows_of(S.run_available(S.enriched_outcomes(stream(spark, folder, EVENTS), late="12 hours")).where("crawl_id < 99"))
    want = []
    for r in rows:
        if r[2] in ("completed", "failed"):
            starts = [s for s in rows if s[2] == "started" and s[1] == r[1] and r[4] - datetime.timedelta(days=1) <= s[4] <= r[4]]
            want += [(r[1], r[0], r[2], r[4], s[4], s[3]) for s in starts] or [(r[1], r[0], r[2], r[4], None, None)]
    assert got == sorted(want, key=str)


def test_a_cluster_needs_a_shared_folder(spark):
    class Conf:
        def get(self, name, default=None):
            return default

    class Context:
        master = "spark://somewhere:7077"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match=r"spark\.checkpoint\.dir"):
        S.work_dir(Session())
