"""Report rows and monitoring totals: what the dashboards and the report files show."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quayside.functions.numbers import rounded_ratio
from quayside.operators import prices as P
from quayside.operators.filters import between_days, on_sale
from quayside.operators.monitoring import hours

COUNTS = ("started", "completed", "failed", "discovered")
QUALITY = ("price_pence", "description", "images", "brand", "ingredients")
SEVERITY = ("failed", "disabled", "degraded", "paused", "active")


def _sums(columns: tuple[str, ...]) -> list[Column]:
    return [F.coalesce(F.sum(c), F.lit(0).cast("long")).alias(c) for c in columns]


def _success(done: str = "completed", failed: str = "failed") -> Column:
    """Completed crawls of those with an outcome, in percent; null without one."""
    return rounded_ratio(F.col(done) * 100, F.col(done) + F.col(failed), 2)


def day_totals(statistics: DataFrame, day: Column) -> DataFrame:
    """One row: the sums of one day over all retailers, zeros without any, and the success rate."""
    return statistics.where(F.col("day") == day).agg(*_sums(COUNTS)).withColumn("success_rate", _success())


def retailer_history(statistics: DataFrame, as_of: Column, failures: int = 10) -> DataFrame:
    """For each retailer: sums and success rate of the last 7 days, failures of the last 30, its newest days with failures.

    A day is in a span when it isn't before the span's first day. Retailers without rows in a span have zeros there.
    """
    last = F.to_date(as_of)
    in_week, in_month = F.col("day") >= last - F.lit(7), F.col("day") >= last - F.lit(30)
    none = F.lit(0).cast("long")
    week = [F.coalesce(F.sum(F.when(in_week, F.col(c))), none).alias(c) for c in COUNTS]
    month = F.coalesce(F.sum(F.when(in_month, F.col("failed"))), none).alias("failed_in_30_days")
    sums = statistics.groupBy("retailer").agg(*week, month).withColumn("success_rate", _success())
    newest = F.row_number().over(Window.partitionBy("retailer").orderBy(F.desc("day")))
    bad = statistics.where("failed > 0").select("retailer", "day").withColumn("r", newest).where(F.col("r") <= failures)
    days = bad.groupBy("retailer").agg(F.sort_array(F.collect_list("day"), asc=False).alias("failure_days"))
    return sums.join(days, "retailer", "left").withColumn("failure_days", F.coalesce("failure_days", F.array().cast("array<date>")))


def verification_history(log: DataFrame, first: Column, last: Column) -> DataFrame:
    """Counts of each verifier and day from ``first`` to ``last``, both included.

    ``log`` has user_id, action (approved, rejected, rematched), bulk and verified_at. Bulk approvals count as approvals
    and apart; the total leaves them in once.
    """
    day = F.to_date("verified_at")
    kind = lambda a: F.count_if(F.col("action") == a).alias(a)
    rows = log.where(between_days("verified_at", first, last)).groupBy("user_id", day.alias("day"))
    counted = rows.agg(kind("approved"), kind("rejected"), kind("rematched"), F.count_if((F.col("action") == "approved") & F.col("bulk")).alias("bulk_approvals"))
    return counted.withColumn("total", F.col("approved") + F.col("rejected") + F.col("rematched"))


def recent_counts(tables: dict[str, tuple[DataFrame, str]], as_of: Column, last_hours: int = 24) -> DataFrame:
    """(name, total, recent) of several tables, each with the column that says when a row came; zeros for empty tables."""
    fresh = lambda c: F.count_if(F.col(c) >= as_of - hours(last_hours)).alias("recent")
    rows = [df.agg(F.count(F.lit(1)).alias("total"), fresh(c)).select(F.lit(name).alias("name"), "total", "recent") for name, (df, c) in tables.items()]
    out = rows[0]
    for row in rows[1:]:
        out = out.unionByName(row)
    return out


def top_events(events: DataFrame, top: int = 10) -> DataFrame:
    """The commonest kinds of events, ties by name."""
    return events.groupBy("event").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "event").limit(top)


def stored_bytes(files: DataFrame, size: str = "size") -> DataFrame:
    """One row: the number of kept files and the sum of their sizes, unknown sizes as 0."""
    return files.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(size), F.lit(0).cast("long")).alias("total_bytes"))


def match_rate(listings: DataFrame, matches: DataFrame) -> DataFrame:
    """One row: listings, those with a match, and their share in percent, null without listings."""
    found = matches.select(F.col("listing_id").alias("id"), F.lit(1).alias("hit")).distinct()
    row = listings.select("id").join(found, "id", "left").agg(F.count(F.lit(1)).alias("listings"), F.count("hit").alias("matched"))
    return row.withColumn("match_rate", rounded_ratio(F.col("matched") * 100, F.col("listings")))


def by_severity(retailers: DataFrame) -> DataFrame:
    """Retailers, those in the worst state first, unknown states last, then by name; ``severity`` counts from 0."""
    rank = F.array_position(F.array(*[F.lit(s) for s in SEVERITY]), F.col("status"))
    severity = F.when(rank > 0, (rank - 1).cast("int"))
    return retailers.withColumn("severity", severity).orderBy(F.asc_nulls_last("severity"), "name", "id")


def label(name: Column) -> Column:
    """'dry_food' -> 'Dry Food'."""
    return F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))


def weekly_rows(listings: DataFrame, matches: DataFrame, products: DataFrame, prices: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """The weekly price report as the ten columns of its file, one row for each category."""
    end = F.to_date(as_of)
    report = P.weekly_report(listings, matches, products, prices, as_of, days)
    return report.select(
        label(F.col("canonical_category")).alias("category"),
        (end - F.lit(days)).alias("period_start"),
        end.alias("period_end"),
        F.col("product_count").alias("total_listings"),
        "average_price_pence", "min_price_pence", "max_price_pence",
        F.col("average_change_percentage").alias("average_price_change"),
        F.col("on_sale_count").alias("listings_on_sale"),
        F.col("on_sale_percentage").alias("sale_percentage"),
    )


def quality_rows(retailers: DataFrame, listings: DataFrame, prices: DataFrame, as_of: Column, stale_hours: int = 48) -> DataFrame:
    """The data-quality report as the eleven columns of its file, one row for each retailer with listings.

    ``price_anomalies`` counts the retailer's listings that have any. The score is the share of filled fields in percent.
    """
    old = F.col("last_scraped_at").isNull() | (F.col("last_scraped_at") < as_of - hours(stale_hours))
    odd = P.anomalies(prices).select(F.col("listing_id").alias("id"), F.lit(1).alias("odd"))
    missing = [F.count_if(F.col(c).isNull()).alias(f"missing_{c.removesuffix('_pence')}") for c in QUALITY]
    counts = listings.join(odd, "id", "left").groupBy("retailer_id").agg(
        F.count(F.lit(1)).alias("total_listings"), *missing, F.count_if(old).alias("stale_listings"), F.count("odd").alias("price_anomalies")
    )
    gone = sum((F.col(f"missing_{c.removesuffix('_pence')}") for c in QUALITY), F.lit(0))
    cells = F.col("total_listings") * len(QUALITY)
    rows = counts.withColumn("completeness_score", rounded_ratio((cells - gone) * 100, cells, 1))
    return retailers.select(F.col("id").alias("retailer_id"), F.col("name").alias("retailer"), "slug").join(rows, "retailer_id").drop("retailer_id")


def listing_ingredients(bridge: DataFrame, ingredients: DataFrame) -> DataFrame:
    """Each listing's ingredient names in the order of their positions, ties by name.

    ``bridge`` has listing_id, ingredient_id and position, ``ingredients`` has id and name. Ingredients that don't exist
    are left out.
    """
    named = bridge.join(ingredients.select(F.col("id").alias("ingredient_id"), "name"), "ingredient_id")
    lists = named.groupBy("listing_id").agg(F.sort_array(F.collect_list(F.struct("position", "name"))).alias("x"))
    return lists.select("listing_id", F.transform("x", lambda e: e["name"]).alias("ingredients"))


def sale_discounts(listings: DataFrame) -> DataFrame:
    """Listings on sale with the discount in whole percent of the old price."""
    percent = rounded_ratio((F.col("original_price_pence") - F.col("price_pence")) * 100, F.col("original_price_pence"))
    return listings.where(on_sale()).select("id", percent.alias("discount_percentage"))
