"""Price observations over time: statistics, trends, sale patterns, buying advice, reports, anomalies, alerts.

``prices`` has listing_id, id, recorded_at, price_pence, original_price_pence; observations of a listing are in the
order of (recorded_at, id, price_pence). ``as_of`` is a timestamp column, usually ``latest(prices)``. Null prices take no part.
"""

from __future__ import annotations

from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quayside.functions import fixed
from quayside.functions.numbers import change_percent, days_between, discount_percent, drop_percent, pattern_class, rounded_mean, rounded_ratio, sample_deviation, savings_percent, trend_indicator
from quayside.operators.prefix import running

ORDER = ("recorded_at", "id", "price_pence")


def latest(table: DataFrame, column: str = "recorded_at") -> Column:
    """The newest time in the table, as a scalar subquery."""
    return table.agg(F.max(column)).scalar()


def ago(as_of: Column, days: int) -> Column:
    return as_of - F.expr(f"INTERVAL {int(days)} DAYS")


def since(prices: DataFrame, as_of: Column, days: int) -> DataFrame:
    return prices.where(F.col("price_pence").isNotNull() & (F.col("recorded_at") >= ago(as_of, days)))


def _summary(*keys: str):
    n, total = F.count("price_pence"), F.sum("price_pence")
    return [n.alias("n"), total.alias("total"), F.sum(F.col("price_pence") * F.col("price_pence")).alias("squares"), F.min("price_pence").alias("min_price_pence"), F.max("price_pence").alias("max_price_pence")]


def _figures(grouped: DataFrame, *keys: str) -> DataFrame:
    mean = rounded_mean(F.col("total"), F.col("n"))
    return grouped.withColumn("average_price_pence", mean).select(
        *keys,
        "average_price_pence",
        "min_price_pence",
        "max_price_pence",
        (F.col("max_price_pence") - F.col("min_price_pence")).alias("price_range_pence"),
        sample_deviation(F.col("n"), F.col("total"), F.col("squares"), F.col("average_price_pence")).alias("standard_deviation"),
        F.col("n").alias("price_count"),
    )


def average_price(prices: DataFrame, as_of: Column, days: int) -> DataFrame:
    """listing_id, average_price_pence of the last ``days``; listings without a price have no row."""
    return since(prices, as_of, days).groupBy("listing_id").agg(rounded_mean(F.sum("price_pence"), F.count("price_pence")).alias("average_price_pence"))


def statistics(prices: DataFrame, as_of: Column, days: int) -> DataFrame:
    """Mean, extremes, range, deviation and count of each listing's last ``days``; no row without a price."""
    return _figures(since(prices, as_of, days).groupBy("listing_id").agg(*_summary()), "listing_id")


def statistics_of_periods(prices: DataFrame, as_of: Column, periods: tuple[int, ...] = (7, 30, 90)) -> DataFrame:
    """The same for several nested periods in one pass: a price counts in each period that holds it."""
    recent = since(prices, as_of, max(periods))
    each = recent.withColumn("days", F.explode(F.array(*[F.lit(p) for p in periods]))).where(F.col("recorded_at") >= as_of_minus(as_of, F.col("days")))
    return _figures(each.groupBy("listing_id", "days").agg(*_summary()), "listing_id", "days")


def as_of_minus(as_of: Column, days: Column) -> Column:
    return as_of - F.make_dt_interval(days.cast("int"))


def trend(prices: DataFrame, as_of: Column, days: int) -> DataFrame:
    """First and last price of the last ``days``, the change in percent and its indicator."""
    first, last = F.min_by("price_pence", F.struct(*ORDER)), F.max_by("price_pence", F.struct(*ORDER))
    grouped = since(prices, as_of, days).groupBy("listing_id").agg(first.alias("start_price_pence"), last.alias("end_price_pence"), *_summary())
    mean = rounded_mean(F.col("total"), F.col("n"))
    deviation = sample_deviation(F.col("n"), F.col("total"), F.col("squares"), mean)
    change = change_percent(F.col("start_price_pence"), F.col("end_price_pence"))
    return grouped.select("listing_id", "start_price_pence", "end_price_pence", change.alias("change_percentage"), trend_indicator(change, deviation, mean).alias("indicator"))


def sales(prices: DataFrame, as_of: Column, days: int) -> DataFrame:
    """Observations on sale in the last ``days``."""
    return since(prices, as_of, days).where(F.col("original_price_pence").isNotNull() & (F.col("price_pence") < F.col("original_price_pence")))


def sale_pattern(prices: DataFrame, as_of: Column, lookback: int = 90) -> DataFrame:
    """Mean discount, mean gap in days, class, dates and description of listings with two sales at least."""
    discount = discount_percent(F.col("original_price_pence"), F.col("price_pence")).cast("long")
    rows = sales(prices, as_of, lookback).withColumn("discount", discount)
    # the gaps between neighbours add up to the time from the first to the last
    grouped = rows.groupBy("listing_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("discount").alias("discounts"),
        days_between(F.min("recorded_at"), F.max("recorded_at")).alias("span"),
        F.sort_array(F.collect_list("recorded_at")).alias("sale_dates"),
    )
    gap = F.floor(F.col("span") / (F.col("n") - 1) + 0.5).cast("long")
    found = grouped.where("n >= 2").withColumn("sale_frequency_days", gap).withColumn("average_discount", rounded_mean(F.col("discounts"), F.col("n")))
    kind = pattern_class(F.col("sale_frequency_days"), F.col("n"), lookback)
    percent = F.concat(F.lit("with an average "), F.col("average_discount").cast("string"), F.lit("% discount"))
    text = (
        F.when(kind == "frequent", F.concat(F.lit("Frequently on sale "), percent))
        .when(kind == "bi_weekly", F.concat(F.lit("Sales roughly every 2 weeks "), percent))
        .when(kind == "monthly", F.concat(F.lit("Monthly sales pattern "), percent))
        .when(kind == "occasional", F.concat(F.lit("Occasional sales approximately every "), F.col("sale_frequency_days").cast("string"), F.lit(" days "), percent))
        .otherwise("No clear sale pattern detected")
    )
    return found.select("listing_id", kind.alias("pattern_type"), "average_discount", "sale_frequency_days", F.col("n").alias("sale_count"), "sale_dates", text.alias("description"))


def sale_weekdays(prices: DataFrame, as_of: Column, lookback: int = 90, top: int = 2, least: int = 3) -> DataFrame:
    """The ``top`` weekdays with the most sales of listings with ``least`` sales, most first, ties to the earlier first sale."""
    days = sales(prices, as_of, lookback).groupBy("listing_id", F.date_format("recorded_at", "EEEE").alias("weekday")).agg(F.count(F.lit(1)).alias("n"), F.min("recorded_at").alias("first"))
    per = days.groupBy("listing_id").agg(F.sum("n").alias("total"), F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("o"), "first", "weekday"))).alias("days"))
    return per.where(F.col("total") >= least).select("listing_id", F.transform(F.slice("days", 1, top), lambda d: d["weekday"]).alias("recommended_days"))


def best_time_to_buy(listings: DataFrame, prices: DataFrame, as_of: Column, lookback: int = 90) -> DataFrame:
    """Advice for every listing from its current price, statistics and sale pattern; a missing price counts as 0."""
    stats = statistics(prices, as_of, lookback).select("listing_id", "average_price_pence", "min_price_pence")
    pattern = sale_pattern(prices, as_of, lookback).select("listing_id", "sale_frequency_days", F.try_element_at("sale_dates", F.lit(-1)).alias("last_sale"))
    days = sale_weekdays(prices, as_of, lookback)
    own = listings.select(F.col("id").alias("listing_id"), F.coalesce("price_pence", F.lit(0)).alias("price"), F.coalesce(F.col("price_pence") < F.col("original_price_pence"), F.lit(False)).alias("on_sale"))
    joined = own.join(stats, "listing_id", "left").join(pattern, "listing_id", "left").join(days, "listing_id", "left")
    rows = joined.select(
        "listing_id", "on_sale", "price",
        F.coalesce("average_price_pence", "price").alias("average"),
        F.coalesce("min_price_pence", "price").alias("lowest"),
        F.when(~F.col("on_sale") & (F.col("sale_frequency_days") > 0), F.greatest(F.lit(0), F.floor(F.col("sale_frequency_days") - days_between(F.col("last_sale"), as_of)))).cast("long").alias("expected"),
        F.coalesce("recommended_days", F.array().cast("array<string>")).alias("recommended_days"),
    )
    price, average, expected = F.col("price"), F.col("average"), F.col("expected")
    text = lambda c: c.cast("long").cast("string")
    saving = F.coalesce(text(rounded_ratio((average - price) * 100, average)), F.lit("0"))
    over = text(rounded_ratio((price - average) * 100, average))
    advice = (
        F.when(F.col("on_sale") & (price <= F.col("lowest")), F.concat(F.lit("Excellent time to buy! This is the lowest price recorded. You're saving approximately "), saving, F.lit("% compared to the average price.")))
        .when(F.col("on_sale"), F.concat(F.lit("Good time to buy! The product is currently on sale, saving approximately "), saving, F.lit("% compared to the average price.")))
        .when((price > average) & (expected <= 7), F.concat(F.lit("Consider waiting. The price is "), over, F.lit("% above average and a sale may occur within "), text(expected), F.lit(" days.")))
        .when(price > average, F.concat(F.lit("Current price is "), over, F.lit("% above average. Consider waiting for a sale if possible.")))
        .when(expected <= 3, F.concat(F.lit("A sale may be coming soon (estimated "), text(expected), F.lit(" days). Consider waiting for better prices.")))
        .otherwise("Current price is near or below average. Reasonable time to purchase.")
    )
    return rows.select(
        "listing_id", F.col("on_sale").alias("is_on_sale"), F.col("price").alias("current_price_pence"), F.col("average").alias("average_price_pence"), F.col("lowest").alias("lowest_price_pence"),
        F.col("expected").alias("expected_days_until_sale"), "recommended_days", savings_percent(F.col("on_sale"), average, price).alias("savings_percent"), advice.alias("recommendation"),
    )


def price_before(prices: DataFrame, at: Column) -> DataFrame:
    """Each listing's last price strictly before a time."""
    before = prices.where(F.col("price_pence").isNotNull() & (F.col("recorded_at") < at))
    return before.groupBy("listing_id").agg(F.max_by("price_pence", F.struct(*ORDER)).alias("previous_price_pence"))


def changes_since(listings: DataFrame, prices: DataFrame, at: Column) -> DataFrame:
    """Current price against the last one before ``at``; listings without either, or with a previous price of 0, have no row."""
    now = listings.where(F.col("price_pence").isNotNull()).select(F.col("id").alias("listing_id"), "title", F.col("price_pence").alias("current_price_pence"))
    both = now.join(price_before(prices, at), "listing_id").where("previous_price_pence <> 0")
    return both.withColumn("change_percentage", change_percent(F.col("previous_price_pence"), F.col("current_price_pence")))


def in_category(listings: DataFrame, matches: DataFrame, products: DataFrame) -> DataFrame:
    """Listings with the canonical category of the products they are matched to, in any state of the match."""
    kinds = matches.join(products.select(F.col("id").alias("product_id"), "canonical_category"), "product_id").select(F.col("listing_id").alias("id"), "canonical_category").distinct()
    return listings.join(kinds, "id")


def weekly_report(listings: DataFrame, matches: DataFrame, products: DataFrame, prices: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """One row for each canonical category, also empty ones: counts, prices, sales and the mean change."""
    rows = in_category(listings, matches, products)
    changed = changes_since(listings, prices, ago(as_of, days)).select(F.col("listing_id").alias("id"), F.round(F.col("change_percentage") * 100).cast("long").alias("hundredths"))
    on_sale = F.col("original_price_pence").isNotNull() & (F.col("price_pence") < F.col("original_price_pence"))
    grouped = rows.join(changed, "id", "left").groupBy("canonical_category").agg(
        F.count("price_pence").alias("n"), F.sum("price_pence").alias("total"), F.min("price_pence").alias("lo"), F.max("price_pence").alias("hi"),
        F.count_if(on_sale).alias("sale"), F.count("hundredths").alias("changes"), F.sum("hundredths").alias("change"),
    )
    every = listings.sparkSession.createDataFrame([(c,) for c in list(fixed.CATEGORIES)], "canonical_category string")
    none = F.lit(0).cast("long")
    return every.join(grouped, "canonical_category", "left").select(
        "canonical_category",
        F.coalesce("n", none).alias("product_count"),
        F.coalesce(rounded_mean(F.col("total"), F.col("n")), none).alias("average_price_pence"),
        F.coalesce("lo", none).alias("min_price_pence"),
        F.coalesce("hi", none).alias("max_price_pence"),
        F.coalesce("sale", none).alias("on_sale_count"),
        F.coalesce(rounded_ratio(F.col("sale") * 100, F.col("n"), 1), F.lit(0.0)).alias("on_sale_percentage"),
        F.coalesce(rounded_ratio(F.col("change"), F.col("changes")) / 100, F.lit(0.0)).alias("average_change_percentage"),
    )


def top_movers(listings: DataFrame, matches: DataFrame, products: DataFrame, prices: DataFrame, as_of: Column, days: int = 7, top: int = 5) -> DataFrame:
    """The ``top`` drops and rises of each category, largest first, ties to the smaller listing id."""
    kinds = in_category(listings, matches, products).select(F.col("id").alias("listing_id"), "canonical_category")
    rows = changes_since(listings, prices, ago(as_of, days)).where("change_percentage <> 0").join(kinds, "listing_id")
    rows = rows.withColumn("direction", F.when(F.col("change_percentage") < 0, "drop").otherwise("rise"))
    rank = F.row_number().over(Window.partitionBy("canonical_category", "direction").orderBy(F.desc(F.abs("change_percentage")), "listing_id"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= top)


def product_prices(products: DataFrame, matches: DataFrame, listings: DataFrame) -> DataFrame:
    """Products with the lowest and mean price of their matched listings in stock; unchanged where there is none."""
    priced = listings.where("in_stock and price_pence is not null").select(F.col("id").alias("listing_id"), "price_pence")
    found = matches.join(priced, "listing_id").groupBy("product_id").agg(F.min("price_pence").alias("lo"), rounded_mean(F.sum("price_pence"), F.count("price_pence")).alias("mean"))
    joined = products.join(found.withColumnRenamed("product_id", "id"), "id", "left")
    old = lambda c: F.col(c) if c in products.columns else F.lit(None).cast("long")
    return joined.select("id", F.coalesce("lo", old("lowest_price_pence")).alias("lowest_price_pence"), F.coalesce("mean", old("average_price_pence")).alias("average_price_pence"))


def product_trend(matches: DataFrame, listings: DataFrame, prices: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """The trend of each product's cheapest priced listing, ties to the smaller id."""
    priced = listings.where("price_pence is not null").select(F.col("id").alias("listing_id"), "price_pence")
    cheapest = matches.join(priced, "listing_id").groupBy("product_id").agg(F.min(F.struct("price_pence", "listing_id")).alias("c")).select("product_id", F.col("c.listing_id").alias("listing_id"))
    return cheapest.join(trend(prices, as_of, days), "listing_id")


def recent_drops(listings: DataFrame, prices: DataFrame, as_of: Column, days: int = 7, top: int = 8) -> DataFrame:
    """The ``top`` listings in stock whose last price is recent and below the one before."""
    newest = F.row_number().over(Window.partitionBy("listing_id").orderBy(*[F.desc(c) for c in ORDER]))
    two = prices.where(F.col("price_pence").isNotNull()).withColumn("r", newest).where(F.col("r") <= 2)
    last = lambda c, r: F.max(F.when(F.col("r") == r, F.col(c)))
    pair = two.groupBy("listing_id").agg(last("recorded_at", 1).alias("at"), last("price_pence", 1).alias("price_pence"), last("price_pence", 2).alias("previous_price_pence"))
    rows = pair.where((F.col("at") >= ago(as_of, days)) & (F.col("price_pence") < F.col("previous_price_pence")))
    rows = rows.join(listings.where("in_stock").select(F.col("id").alias("listing_id"), "title"), "listing_id")
    return rows.withColumn("drop_percentage", drop_percent(F.col("previous_price_pence"), F.col("price_pence"), 1)).orderBy(F.desc("drop_percentage"), "listing_id").limit(top).drop("at")


def change_log(prices: DataFrame) -> DataFrame:
    """Observations whose price differs from the one before, and each listing's first."""
    before = F.lag("price_pence").over(Window.partitionBy("listing_id").orderBy(*ORDER))
    return prices.withColumn("before", before).where(F.col("before").isNull() | (F.col("price_pence") != F.col("before"))).drop("before")


def drop_events(prices: DataFrame, least_percent: float = fixed.PRICE_ALERT["drop_percent"]) -> DataFrame:
    """An event for each price that is lower than the one before by ``least_percent`` or more."""
    before = F.lag("price_pence").over(Window.partitionBy("listing_id").orderBy(*ORDER))
    rows = prices.withColumn("old_price_pence", before).where(F.col("price_pence") < F.col("old_price_pence"))
    rows = rows.withColumn("drop_percentage", drop_percent(F.col("old_price_pence"), F.col("price_pence")))
    return rows.where(F.col("drop_percentage") >= least_percent).select("listing_id", "id", F.col("recorded_at").alias("dropped_at"), "old_price_pence", F.col("price_pence").alias("new_price_pence"), "drop_percentage")


def user_alerts(drops: DataFrame, matches: DataFrame, alerts: DataFrame, cooldown_hours: int = fixed.PRICE_ALERT["cooldown_hours"], users: int = 400) -> DataFrame:
    """Active alerts whose target the new price reaches and that weren't sent within the cooldown before the drop.

    The rows are pairs of drops and alerts, so they are made in an order that is written small: a product's alerts are cut into lists of ``users``
    with near targets, a drop meets a list as one row, and the drops that reach all of a list follow each other, each with the same users in the same order.
    """
    active = alerts.where("is_active and target_price_pence is not null").select("user_id", "product_id", "target_price_pence", "last_notified_at")
    parts = active.groupBy("product_id").agg(F.ceil(F.count(F.lit(1)) / (16 * users)).alias("parts"))
    near = Window.partitionBy("product_id", "part").orderBy("last_notified_at", F.desc("target_price_pence"), "user_id")
    dealt = active.join(parts, "product_id").withColumn("part", F.pmod(F.xxhash64("user_id"), F.col("parts"))).withColumn("cut", F.floor((F.row_number().over(near) - 1) / users))
    told, target = F.col("last_notified_at"), F.col("target_price_pence")
    key = ["product_id", "part", "cut"]
    lists = dealt.groupBy(*key).agg(
        F.sort_array(F.collect_list(F.struct("last_notified_at", "target_price_pence", "user_id")), asc=False).alias("list"),
        F.min(target).alias("lowest"), F.max(target).alias("highest"), F.when(F.count(told) == F.count(F.lit(1)), F.min(told)).alias("first_told"), F.max(told).alias("last_told"),
    )
    rested = lambda told: told.isNull() | (told < F.col("dropped_at") - F.expr(f"INTERVAL {int(cooldown_hours)} HOURS"))
    watched = matches.select("listing_id", "product_id").join(parts.select("product_id"), "product_id")
    meet = drops.join(watched, "listing_id").join(lists.drop("list"), "product_id").where((F.col("highest") >= F.col("new_price_pence")) & rested(F.col("first_told")))
    rows = meet.select(*key, "listing_id", "id", "dropped_at", "new_price_pence", F.coalesce((F.col("lowest") >= F.col("new_price_pence")) & rested(F.col("last_told")), F.lit(False)).alias("all"))
    both = lists.select(*key, "list", F.explode(F.array(F.lit(True), F.lit(False))).alias("all"))
    hit = rows.join(both.hint("merge"), [*key, "all"]).select("product_id", "listing_id", "id", "dropped_at", "new_price_pence", F.inline("list"))
    return hit.where((target >= F.col("new_price_pence")) & rested(told)).select("user_id", "product_id", "listing_id", "id", "dropped_at", "new_price_pence", "target_price_pence")


def alerts_with_cooldown(drops: DataFrame, matches: DataFrame, alerts: DataFrame, cooldown_hours: int = fixed.PRICE_ALERT["cooldown_hours"], users: int = 1_000) -> DataFrame:
    """As user_alerts, each alert that is sent also resting its user and product: of drops within the cooldown one alerts.

    Drops and alerts of a product meet in parts of about ``users`` alerts, never as all pairs; a part walks through its product's drops once.
    """
    active = alerts.where("is_active and target_price_pence is not null").select("user_id", "product_id", "target_price_pence", "last_notified_at")
    parts = active.groupBy("product_id").agg(F.ceil(F.count(F.lit(1)) / users).alias("parts"))
    own = drops.join(matches.select("listing_id", "product_id"), "listing_id").join(parts, "product_id")
    # at one time a user is sent the first drop that reaches the target: one that is lower than all before it
    before = Window.partitionBy("product_id", "dropped_at").orderBy("listing_id", "id", "new_price_pence").rowsBetween(Window.unboundedPreceding, -1)
    lower = F.coalesce(F.col("new_price_pence") < F.min("new_price_pence").over(before), F.lit(True))
    rows = own.withColumn("lower", lower).where("lower and new_price_pence is not null and dropped_at is not null").drop("lower")
    rows = rows.select("product_id", "dropped_at", "listing_id", "id", "new_price_pence", F.explode(F.sequence(F.lit(1).cast("long"), "parts")).alias("part"))
    dealt = active.join(parts, "product_id").withColumn("part", F.pmod(F.xxhash64("user_id"), F.col("parts")) + 1).drop("parts")
    kinds = {f.name: f.dataType.simpleString() for f in (*dealt.schema, *rows.schema)}
    columns = ("user_id", "product_id", "listing_id", "id", "dropped_at", "new_price_pence", "target_price_pence")
    wait = int(cooldown_hours) * 3_600_000_000
    return dealt.groupBy("product_id", "part").cogroup(rows.groupBy("product_id", "part")).applyInArrow(lambda a, d: _sent(a, d, wait, columns), ", ".join(f"{c} {kinds[c]}" for c in columns))


def _sent(alerts: pa.Table, drops: pa.Table, wait: int, columns: tuple[str, ...]) -> pa.Table:
    """What a product's drops send to some of its users, time by time, all users at once. A user's alerts of one product rest together."""
    alerts = alerts.sort_by([("user_id", "ascending"), ("target_price_pence", "ascending")])
    drops = drops.sort_by([(c, "ascending") for c in ("dropped_at", "listing_id", "id", "new_price_pence")])
    us = lambda t, c: pc.fill_null(t[c].cast(pa.timestamp("us", getattr(t.schema.field(c).type, "tz", None))).cast(pa.int64()), _NEVER).to_numpy()
    times, prices, targets, last = us(drops, "dropped_at"), drops["new_price_pence"].to_numpy(), alerts["target_price_pence"].to_numpy(), us(alerts, "last_notified_at").copy()
    user = np.unique(alerts["user_id"].to_numpy(), return_inverse=True)[1]
    single = len(user) == (user[-1] + 1 if len(user) else 0)
    rest = np.full(user[-1] + 1 if len(user) else 0, _NEVER)
    at = np.flatnonzero(np.r_[True, times[1:] != times[:-1]]) if len(times) else np.array([], int)
    who, which = [], []
    for start, end in pairwise([*at, len(times)]):
        hit = np.flatnonzero((np.maximum(last, rest[user]) < times[start] - wait) & (targets >= prices[end - 1]))
        if not len(hit):
            continue
        first = start + np.searchsorted(-prices[start:end], -targets[hit], side="left")
        if not single:  # of a user's alerts the one with the earliest drop, then the lowest target
            order = np.lexsort((targets[hit], first, user[hit]))
            keep = order[np.r_[True, np.diff(user[hit][order]) != 0]]
            hit, first = hit[keep], first[keep]
        who.append(hit)
        which.append(first)
        rest[user[hit]] = times[start]
    none = np.array([], int)
    a, d = alerts.take(np.concatenate([none, *who])), drops.take(np.concatenate([none, *which]))
    return pa.table({c: (a if c in ("user_id", "product_id", "target_price_pence") else d)[c] for c in columns})


_NEVER = np.iinfo(np.int64).min // 2


def anomalies(prices: DataFrame, percent: int = 50, in_row: int = 2_000) -> DataFrame:
    """Listings and the number of ordered pairs of their prices that differ by more than ``percent`` of the earlier.

    All pairs in time are compared, not only neighbours, but never listed. A listing of at most ``in_row`` prices has them in one row;
    larger ones are counted by ``far_pairs``.
    """
    rows = prices.where(F.col("price_pence").isNotNull() & F.col("recorded_at").isNotNull()).select("listing_id", "recorded_at", "price_pence")
    sized = rows.join(rows.groupBy("listing_id").agg(F.count(F.lit(1)).alias("n")), "listing_id")
    at = sized.where(F.col("n") <= in_row).groupBy("listing_id").agg(F.sort_array(F.collect_list(F.struct("recorded_at", "price_pence"))).alias("x"))
    far = lambda a, b: (a["recorded_at"] < b["recorded_at"]) & (a["price_pence"] > 0) & (F.abs(b["price_pence"] - a["price_pence"]) * 100 > a["price_pence"] * percent)
    count = F.aggregate("x", F.lit(0).cast("long"), lambda n, b: n + F.size(F.filter("x", lambda a: far(a, b))))
    counted = at.select("listing_id", count.alias("anomalies")).unionByName(far_pairs(sized.where(F.col("n") > in_row).drop("n"), percent))
    return counted.where("anomalies > 0")


def far_pairs(rows: DataFrame, percent: int, price_bucket: int = 1_000, days: int = 30) -> DataFrame:
    """As ``anomalies``, for listings with any number of prices: pairs are counted by merging sorted halves.

    Two times of a listing, numbered in order, differ first at one binary digit; at its level the earlier price is in the left half of a
    block and the later in the right. There the earlier prices that are too low or too high for a later one are counted by running sums
    in the order of price. Each row stands once or twice at each of about log2(n) levels, and no task gets more of a listing's block
    than a bucket of prices.
    """
    us = F.unix_micros(F.col("recorded_at").cast("timestamp"))
    timed = rows.select("listing_id", us.alias("us"), F.col("price_pence").cast("long").alias("price"))
    times = running(timed.select("listing_id", "us").distinct(), ["listing_id"], F.floor(F.col("us") / (days * 86_400_000_000)), [F.col("us")], {"k": F.lit(1)})
    most = times.groupBy("listing_id").agg(F.max("k").alias("most"))
    levels = F.when(F.col("most") > 1, F.sequence(F.lit(0), F.ceil(F.log2(F.col("most").cast("double"))).cast("int")))
    placed = timed.join(times, ["listing_id", "us"]).join(most, "listing_id").select("listing_id", (F.col("k") - 1).alias("k"), "price", F.explode(levels).alias("level"))
    shifted = lambda by: F.call_function("shiftright", F.col("k"), by)
    point = lambda key, turn, low, high: F.struct(key.cast("long").alias("key"), F.lit(turn).alias("turn"), F.lit(low).alias("low"), F.lit(high).alias("high"))
    price = F.col("price")
    left = F.when(price > 0, F.array(point(price * (100 - percent), 0, 1, 0), point(price * (100 + percent), 2, 0, 1)))
    points = F.when(shifted(F.col("level")) % 2 == 0, left).otherwise(F.array(point(price * 100, 1, 0, 0)))
    group = ["listing_id", "level", "block"]
    spread = placed.select("listing_id", "level", shifted(F.col("level") + 1).alias("block"), F.explode(points).alias("p")).select(*group, "p.*")
    so_far = running(spread, group, F.floor(F.col("key") / (100 * price_bucket)), [F.col("key"), F.col("turn")], {"lows": F.col("low"), "highs": F.col("high")})
    lefts = spread.groupBy(*group).agg(F.sum("low").alias("left"))
    later = so_far.where("turn = 1").join(lefts, group)
    # too high: its lower bound is above the later price; too low: its upper bound is below
    return later.groupBy("listing_id").agg(F.sum(F.col("left") - F.col("lows") + F.col("highs")).alias("anomalies"))


def pivot_by_day(prices: DataFrame, listings: DataFrame, matches: DataFrame) -> DataFrame:
    """(product, day) -> map of retailer to price: the day's first price of the dearest listing in stock."""
    shown = listings.where("in_stock").select(F.col("id").alias("listing_id"), "retailer_id", F.col("price_pence").alias("current"))
    rows = matches.select("listing_id", "product_id").join(shown, "listing_id").join(prices, "listing_id").withColumn("day", F.to_date("recorded_at"))
    first = F.min_by("price_pence", F.struct((-F.col("current")).alias("o"), (-F.col("listing_id")).alias("l"), *ORDER))
    cells = rows.groupBy("product_id", "day", "retailer_id").agg(first.alias("price_pence"))
    return cells.groupBy("product_id", "day").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("retailer_id", "price_pence")))).alias("prices"))


def price_history(prices: DataFrame, listings: DataFrame, matches: DataFrame, product_id: int | None = None) -> DataFrame:
    """A product's observations across listings, newest first; without an id every product's, with their product_id."""
    retailers = listings.select(F.col("id").alias("listing_id"), "retailer_id")
    newest = (F.desc("recorded_at"), F.desc("id"), "listing_id")
    if product_id is None:
        own = matches.where(F.col("product_id").isNotNull()).select("listing_id", "product_id").distinct()
        return prices.join(own, "listing_id").join(retailers, "listing_id").orderBy("product_id", *newest)
    own = matches.where(F.col("product_id") == product_id).select("listing_id")
    return prices.join(own, "listing_id", "left_semi").join(retailers, "listing_id").orderBy(*newest)


def chart_points(prices: DataFrame, width: float, height: float) -> DataFrame:
    """Coordinates of each listing's prices in a chart of that size; flat lines run through the middle."""
    own = Window.partitionBy("listing_id")
    order = own.orderBy(*ORDER)
    n, i = F.count(F.lit(1)).over(own), F.row_number().over(order) - 1
    lo, hi = F.min("price_pence").over(own), F.max("price_pence").over(own)
    x = F.when(n > 1, i / (n - 1) * width).otherwise(F.lit(0.0))
    y = F.when(hi > lo, height - (F.col("price_pence") - lo) / (hi - lo) * height).otherwise(F.lit(height / 2))
    return prices.select("listing_id", "recorded_at", "price_pence", x.alias("x"), y.alias("y"))
