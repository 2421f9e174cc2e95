"""Crawl events as tables: what the streaming jobs keep up to date, computed over a whole log.

``events`` has id, crawl_id, event (started, discovered, completed, failed), retailer, created_at, duration_ms; the
order is (created_at, id).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside.functions import fixed
from quayside.functions.numbers import rounded_mean, rounded_ratio
from quayside.operators.prefix import running, within

ORDER = ("created_at", "id")
HOUR = 3_600_000_000  # microseconds


def seconds(column: str = "created_at") -> Column:
    return F.unix_micros(F.col(column).cast("timestamp"))


def daily_statistics(events: DataFrame) -> DataFrame:
    """Counts of each retailer and day, and the mean duration of completed crawls."""
    kind = lambda e: F.count_if(F.col("event") == e).alias(e)
    done = F.when(F.col("event") == "completed", F.col("duration_ms"))
    return events.groupBy("retailer", F.to_date("created_at").alias("day")).agg(
        kind("started"), kind("completed"), kind("failed"), kind("discovered"), rounded_mean(F.sum(done), F.count(done)).alias("average_duration_ms")
    )


def running_average(events: DataFrame) -> DataFrame:
    """The mean duration of each retailer and day as it is kept event by event, rounded at each step."""
    done = events.where("event = 'completed' and duration_ms is not null")
    lists = done.groupBy("retailer", F.to_date("created_at").alias("day")).agg(F.sort_array(F.collect_list(F.struct(*ORDER, "duration_ms"))).alias("x"))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("mean"))
    step = lambda s, e: F.struct((s["n"] + 1).alias("n"), rounded_mean(s["mean"] * s["n"] + e["duration_ms"], s["n"] + 1).alias("mean"))
    return lists.select("retailer", "day", F.aggregate("x", start, step)["mean"].alias("running_average_ms"))


def crawl_state(events: DataFrame) -> DataFrame:
    """The state of each crawl after its log: a completed or failed crawl ignores its later outcomes.

    ``rejected`` counts what isn't allowed: discoveries after a failure, completions after a failure.
    """
    first = F.min(F.when(F.col("event") == "failed", F.struct(*ORDER))).alias("failed_at")
    done = F.min(F.when(F.col("event") == "completed", F.struct(*ORDER))).alias("completed_at")
    marks = events.groupBy("crawl_id").agg(first, done)
    rows = events.join(marks, "crawl_id").withColumn("at", F.struct(*ORDER))
    failed_first = F.col("failed_at").isNotNull() & (F.col("completed_at").isNull() | (F.col("failed_at") < F.col("completed_at")))
    after = failed_first & (F.col("at") > F.col("failed_at"))
    grouped = rows.groupBy("crawl_id").agg(
        F.count_if((F.col("event") == "discovered") & ~after).alias("listings_discovered"),
        F.count_if(F.col("event").isin("discovered", "completed") & after).alias("rejected"),
        F.max(failed_first).alias("failed"),
        F.max(F.col("completed_at").isNotNull()).alias("completed"),
    )
    state = F.when(F.col("failed"), "failed").when(F.col("completed"), "completed").otherwise("running")
    return grouped.select("crawl_id", state.alias("state"), "listings_discovered", "rejected")


def outcomes(events: DataFrame) -> DataFrame:
    return events.where(F.col("event").isin("completed", "failed"))


def sliding_failure_rate(events: DataFrame, minutes: int = fixed.CIRCUIT["window_minutes"]) -> DataFrame:
    """At each outcome the failure rate of its retailer's last ``minutes``, and whether the circuit opens.

    A retailer's outcomes are spread over its hours.
    """
    rows = outcomes(events).select("retailer", "id", "created_at", "event", seconds().alias("us"))
    found = within(rows, ["retailer"], "us", minutes * 60_000_000, HOUR, {"n": F.lit(1), "failed": F.col("event") == "failed"})
    rows = rows.drop("event").join(found, ["retailer", "us"]).drop("us")
    opens = (F.col("n") >= fixed.CIRCUIT["least_crawls"]) & (F.col("failed") * 100 >= F.col("n") * fixed.CIRCUIT["failure_percent"])
    return rows.withColumn("failure_rate", rounded_ratio(F.col("failed") * 100, F.col("n"), 2)).withColumn("opens", opens)


def health(events: DataFrame, hours: int = fixed.HEALTH["window_hours"]) -> DataFrame:
    """At each outcome the success rate, mean duration and last success of its retailer's last ``hours``, spread over its hours."""
    done = F.col("event") == "completed"
    rows = outcomes(events).select("retailer", "id", "created_at", "event", "duration_ms", seconds().alias("us"))
    time, width = F.when(done, F.col("duration_ms")), hours * HOUR
    found = within(rows, ["retailer"], "us", width, HOUR, {"n": F.lit(1), "completed": done, "total": time, "timed": time.isNotNull()})
    times = rows.groupBy("retailer", "us").agg(F.max(F.when(done, F.col("created_at"))).alias("success"))
    last = running(times, ["retailer"], F.floor(F.col("us") / HOUR), [F.col("us")], maxes={"last_success_at": F.col("success")}).select("retailer", "us", "last_success_at")
    rows = rows.select("retailer", "id", "us").join(found, ["retailer", "us"]).join(last, ["retailer", "us"])
    recent = F.when(F.unix_micros(F.col("last_success_at").cast("timestamp")) >= F.col("us") - width, F.col("last_success_at"))
    average = (rounded_ratio(F.when(F.col("timed") > 0, F.col("total")), F.col("timed") * 10) / 100).alias("average_seconds")
    return rows.select("retailer", "id", rounded_ratio(F.col("completed") * 100, F.col("n"), 2).alias("success_rate"), average, recent.alias("last_success_at"))


def failure_streaks(events: DataFrame) -> DataFrame:
    """At each outcome the failures of its retailer in a row, and the status they lead to.

    Failures so far less those up to the last success, both as running values spread over the retailer's hours.
    """
    rows = outcomes(events).select("retailer", "id", "created_at", "event", seconds().alias("us"))
    order, hour = [F.col(c) for c in ORDER], F.floor(F.col("us") / HOUR)
    counted = running(rows, ["retailer"], hour, order, sums={"failures": F.col("event") == "failed"})
    counted = running(counted, ["retailer"], hour, order, maxes={"settled": F.when(F.col("event") == "completed", F.col("failures"))})
    streak = (F.col("failures") - F.coalesce("settled", F.lit(0))).alias("consecutive_failures")
    status = F.when(F.col("consecutive_failures") >= fixed.HEALTH["failed_after"], "failed").when(F.col("consecutive_failures") >= fixed.HEALTH["degraded_after"], "degraded").otherwise("active")
    return counted.select("retailer", "id", "created_at", "event", streak).withColumn("status", status)


def failure_sessions(events: DataFrame, gap_minutes: int = fixed.FAILURE_ALERT["gap_minutes"], least: int = fixed.FAILURE_ALERT["failures"]) -> DataFrame:
    """Runs of failures of a retailer with no longer gap, and the alerts they raise: one at each failure from the ``least``-th on."""
    rows = events.where("event = 'failed'").groupBy("retailer", F.session_window("created_at", f"{int(gap_minutes)} minutes").alias("w")).agg(F.count(F.lit(1)).alias("failures"))
    return rows.select("retailer", F.col("w.start").alias("first_failure_at"), "failures", F.greatest(F.col("failures") - (least - 1), F.lit(0)).cast("long").alias("alerts"))


def started_of(events: DataFrame, least_first: bool = True) -> DataFrame:
    """Outcomes with the time of the first start of their crawl, null where there is none."""
    starts = events.where("event = 'started'").groupBy("crawl_id").agg(F.min("created_at").alias("started_at"))
    return outcomes(events).select("crawl_id", "id", "event", "created_at").join(starts, "crawl_id", "left")


def new_listings(discovered: DataFrame) -> DataFrame:
    """The latest row of each (retailer, url), and whether it was seen once only."""
    grouped = discovered.groupBy("retailer", "url").agg(F.max_by(F.struct(*[c for c in discovered.columns if c not in ("retailer", "url")]), F.struct(*ORDER)).alias("x"), F.count(F.lit(1)).alias("n"))
    return grouped.select("retailer", "url", "x.*", (F.col("n") == 1).alias("is_new"))
