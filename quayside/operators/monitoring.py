"""Data quality, freshness, crawl statistics and verification reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside.functions.numbers import rounded_ratio
from quayside.operators.filters import crawlable

COMPLETENESS = ("title", "brand", "price_pence", "weight_grams", "ingredients", "images")


def hours(n: int) -> Column:
    return F.expr(f"INTERVAL {int(n)} HOURS")


def completeness(listings: DataFrame, fields: tuple[str, ...] = COMPLETENESS) -> DataFrame:
    """One row: listings, those missing each field, and the share of filled fields in percent."""
    row = listings.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col(c).isNull()).alias(f"missing_{c}") for c in fields])
    missing = sum((F.col(f"missing_{c}") for c in fields[1:]), F.col(f"missing_{fields[0]}"))
    cells = F.col("total") * len(fields)
    return row.withColumn("score", F.coalesce(rounded_ratio((cells - missing) * 100, cells, 1), F.lit(100.0)))


def stale(listings: DataFrame, as_of: Column, after_hours: int = 48) -> DataFrame:
    """Stale listings of each retailer and the oldest scrape."""
    old = listings.where(F.col("last_scraped_at").isNull() | (F.col("last_scraped_at") < as_of - hours(after_hours)))
    return old.groupBy("retailer_id").agg(F.count(F.lit(1)).alias("stale_count"), F.min("last_scraped_at").alias("oldest_scrape"))


def freshness(listings: DataFrame, as_of: Column) -> DataFrame:
    """One row with half-open buckets of the time since the last scrape."""
    at = F.col("last_scraped_at")
    return listings.agg(
        F.count_if(at >= as_of - hours(24)).alias("under_24h"),
        F.count_if((at < as_of - hours(24)) & (at >= as_of - hours(48))).alias("under_48h"),
        F.count_if((at < as_of - hours(48)) & (at >= as_of - hours(168))).alias("under_7d"),
        F.count_if(at < as_of - hours(168)).alias("over_7d"),
        F.count_if(at.isNull()).alias("never"),
    )


def failure_rates(retailers: DataFrame, listings: DataFrame, as_of: Column, least: float = 0.2) -> DataFrame:
    """Crawlable retailers of whose listings ``least`` or more weren't scraped within a day."""
    late = F.col("last_scraped_at").isNull() | (F.col("last_scraped_at") < as_of - hours(24))
    counts = listings.groupBy("retailer_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(late).alias("failed"))
    rows = retailers.where(crawlable()).select(F.col("id").alias("retailer_id"), "name").join(counts, "retailer_id")
    return rows.where(F.col("failed") >= F.col("total") * least).withColumn("failure_rate", rounded_ratio(F.col("failed") * 100, F.col("total"), 2))


def inactive(retailers: DataFrame, as_of: Column) -> DataFrame:
    return retailers.where(crawlable() & (F.col("last_crawled_at").isNull() | (F.col("last_crawled_at") < as_of - hours(24))))


def status_counts(retailers: DataFrame) -> DataFrame:
    """Every status with its number of retailers, zeros too, and 'all'."""
    from quayside.functions import fixed

    every = retailers.sparkSession.createDataFrame([(s,) for s in [*fixed.STATUS_MOVES, "all"]], "status string")
    counts = retailers.select(F.explode(F.array("status", F.lit("all"))).alias("status")).groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    return every.join(counts, "status", "left").select("status", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def retailer_summary(retailers: DataFrame, as_of: Column, listings: DataFrame) -> DataFrame:
    """One row: all retailers, those to crawl, with problems, crawled within a day, and all their listings."""
    from quayside.operators.filters import problem

    held = listings.groupBy(F.col("retailer_id").alias("id")).agg(F.count(F.lit(1)).alias("held"))
    return retailers.join(held, "id", "left").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(crawlable()).alias("crawlable"), F.count_if(problem()).alias("with_problems"),
        F.count_if(F.col("last_crawled_at") >= as_of - hours(24)).alias("crawled_last_day"), F.coalesce(F.sum("held"), F.lit(0).cast("long")).alias("listings"),
    )


def match_statistics(listings: DataFrame, matches: DataFrame) -> DataFrame:
    """(match_type, n): zeros for types without matches, and the unmatched listings."""
    every = listings.sparkSession.createDataFrame([(t,) for t in ("exact", "fuzzy", "barcode", "manual", "unmatched")], "match_type string")
    kinds = matches.groupBy("match_type").agg(F.count(F.lit(1)).alias("n"))
    rest = listings.select("id").join(matches.select(F.col("listing_id").alias("id")), "id", "left_anti").agg(F.count(F.lit(1)).alias("n"))
    both = kinds.unionByName(rest.withColumn("match_type", F.lit("unmatched")))
    return every.join(both, "match_type", "left").select("match_type", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def verification_counts(matches: DataFrame) -> DataFrame:
    status = lambda s: F.count_if(F.col("status") == s).alias(s)
    sure = F.count_if((F.col("status") == "pending") & (F.col("confidence_score") >= 90)).alias("high_confidence_pending")
    return matches.agg(status("pending"), status("approved"), status("rejected"), F.count(F.lit(1)).alias("total"), sure)


def verifier_activity(matches: DataFrame) -> DataFrame:
    """Approvals of each verifier and day."""
    return matches.where("verified_by is not null").groupBy("verified_by", F.to_date("verified_at").alias("day")).agg(F.count(F.lit(1)).alias("approved"))


def home_totals(products: DataFrame, listings: DataFrame, retailers: DataFrame) -> DataFrame:
    """(name, n) of products, listings in stock and active retailers."""
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
    return one(products, "products").unionByName(one(listings.where("in_stock"), "in_stock_listings")).unionByName(one(retailers.where("status = 'active'"), "active_retailers"))


def daily_chart(statistics: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """Sums of each of the last ``days``, zeros on days without any."""
    last = F.to_date(as_of)
    one = statistics.sparkSession.range(1).select(F.explode(F.sequence(last - F.lit(days - 1), last)).alias("day"))
    sums = statistics.groupBy("day").agg(*[F.sum(c).alias(c) for c in ("started", "completed", "failed")])
    return one.join(sums, "day", "left").select("day", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("started", "completed", "failed")])


def success_rates(statistics: DataFrame) -> DataFrame:
    """Totals of each retailer and the share of completed crawls, null without an outcome."""
    sums = statistics.groupBy("retailer").agg(*[F.sum(c).alias(c) for c in ("started", "completed", "failed", "discovered")])
    return sums.withColumn("success_rate", rounded_ratio(F.col("completed") * 100, F.col("completed") + F.col("failed"), 2))


def queue_totals(events: DataFrame, as_of: Column) -> DataFrame:
    """Events of the last hour and day, by type."""
    at = F.col("created_at")
    return events.groupBy("event").agg(F.count(F.lit(1)).alias("total"), F.count_if(at >= as_of - hours(1)).alias("last_hour"), F.count_if(at >= as_of - hours(24)).alias("last_day"))
