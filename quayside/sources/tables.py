"""The engine's tables, and how the driver's tables stand in for them.

Every function returns a DataFrame that scans only the columns it needs. Money is in integer pence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.functions.numbers import int_div
from quayside.functions.text import lookup, normalize_category, slugify

SCHEMAS = {
    "retailers": "id long, name string, slug string, status string, consecutive_failures int, last_crawled_at timestamp, last_failure_at timestamp, paused_until timestamp",
    "products": "id long, name string, slug string, brand string, description string, category string, canonical_category string, subcategory string, weight_grams long, quantity int, primary_image string, "
    "average_price_pence long, lowest_price_pence long, is_verified boolean, created_at timestamp, updated_at timestamp",
    "listings": "id long, retailer_id long, external_id string, barcode string, url string, title string, description string, price_pence long, original_price_pence long, currency string, weight_grams long, quantity int, "
    "brand string, category string, images array<string>, ingredients string, nutritional_info map<string,string>, in_stock boolean, last_scraped_at timestamp, last_reviews_scraped_at timestamp",
    "prices": "listing_id long, id long, recorded_at timestamp, price_pence long, original_price_pence long",
    "matches": "listing_id long, product_id long, confidence_score decimal(5,2), match_type string, status string, matched_at timestamp, verified_by long, verified_at timestamp, rejection_reason string",
    "reviews": "listing_id long, id long, title string, body string, rating double, verified_purchase boolean, review_date date, helpful_count int",
    "events": "id long, crawl_id string, event string, retailer string, created_at timestamp, duration_ms long",
    "alerts": "user_id long, product_id long, target_price_pence long, is_active boolean, last_notified_at timestamp",
}

#: Category texts that stand for the part types, titles that stand for reviews'.
PART_CATEGORIES = {"STANDARD": "Adult Dry Food", "ECONOMY": "Wet Food Pouches", "PROMO": "Dog Treats", "LARGE": "Dental Sticks", "MEDIUM": "Puppy Food", "SMALL": "Senior 7+"}
INGREDIENTS = (
    "Ingredients: Chicken (26%), rice, maize 10%, beef fat; minerals",
    "Composition: Salmon meal 30%; potato; peas; zinc oxide",
    "Lamb, brown rice, oats, egg powder, vitamin E, rosemary extract",
)
REVIEW_TITLES = (
    "My dog loves this food, really great value", "Not bad at all", "Would not recommend, got sick", "Five stars", "Does not love it, very picky",
    "Extremely good quality and shiny coat", "Arrived late and overpriced", "It is ok",
)


def scan(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pence(amount: Column) -> Column:
    return (amount.cast("decimal(18,2)") * 100).cast("long")


def one_of(values: tuple[str, ...], index: Column) -> Column:
    """The value at an index from 0, null beyond the end."""
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as price observations: the extended price before, and after the discount."""
    return price_columns(scan(spark, sf_dir, "lineitem"))


def price_columns(lines: DataFrame) -> DataFrame:
    """Line items, in batch or as a stream, as price observations."""
    original = pence(F.col("l_extendedprice"))
    percent = F.round(F.col("l_discount") * 100).cast("long")
    return lines.select(
        F.col("l_partkey").alias("listing_id"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
        F.col("l_shipdate").alias("recorded_at"),
        (original - int_div(original * percent, F.lit(100))).alias("price_pence"),
        original.alias("original_price_pence"),
    )


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as listings of ten retailers."""
    key, size, price = F.col("p_partkey"), F.col("p_size").cast("long"), pence(F.col("p_retailprice"))
    seen = scan(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.max("l_shipdate").alias("last_scraped_at"))
    return scan(spark, sf_dir, "part").join(seen, "p_partkey", "left").select(
        key.alias("id"),
        (key % 10).alias("retailer_id"),
        F.when(size % 2 == 0, F.lpad(key.cast("string"), 13, "0")).alias("barcode"),
        F.col("p_name").alias("title"),
        F.col("p_brand").alias("brand"),
        F.coalesce(lookup(F.col("p_type"), PART_CATEGORIES), F.col("p_type")).alias("category"),
        price.alias("price_pence"),
        F.when(size % 3 == 0, price + size * 10).alias("original_price_pence"),
        (size * 100).alias("weight_grams"),
        (size % 5 != 0).alias("in_stock"),
        one_of(INGREDIENTS, size % 4).alias("ingredients"),
        F.when(size % 2 == 0, F.array(F.concat(F.lit("https://img.example.com/"), key.cast("string"), F.lit(".jpg")))).alias("images"),
        "last_scraped_at",
    )


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One product for each brand and name, with the data of its first part."""
    first = F.min_by(F.struct("p_type", "p_size", "p_retailprice"), "p_partkey")
    grouped = scan(spark, sf_dir, "part").groupBy("p_brand", "p_name").agg(F.min("p_partkey").alias("id"), first.alias("f"))
    category = F.coalesce(lookup(F.col("f.p_type"), PART_CATEGORIES), F.col("f.p_type"))
    return grouped.select(
        "id",
        F.col("p_name").alias("name"),
        slugify(F.col("p_name")).alias("slug"),
        F.col("p_brand").alias("brand"),
        category.alias("category"),
        normalize_category(category).alias("canonical_category"),
        (F.col("f.p_size").cast("long") * 100).alias("weight_grams"),
        pence(F.col("f.p_retailprice")).alias("lowest_price_pence"),
        (F.col("id") % 2 == 0).alias("is_verified"),
    )


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part with its product; the confidence comes from category and weight, titles and brands being equal."""
    part = scan(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_name", "p_type", "p_size")
    own = part.groupBy("p_brand", "p_name").agg(F.min("p_partkey").alias("product_id"), F.min_by(F.struct("p_type", "p_size"), "p_partkey").alias("f"))
    joined = part.join(own, ["p_brand", "p_name"])
    size, other = F.col("p_size").cast("long"), F.col("f.p_size").cast("long")
    close = F.abs(size - other) * 40 <= size + other
    score = F.lit(69) + F.when(F.col("p_type") == F.col("f.p_type"), 15).otherwise(0) + F.when(close, 12).otherwise(0)
    at = F.expr("TIMESTAMP '2001-06-01 00:00:00' + make_dt_interval(cast(p_partkey % 150 as int))")
    status = F.when(score >= 95, "approved").when(score >= 80, "pending").otherwise("rejected")
    return joined.select(
        F.col("p_partkey").alias("listing_id"),
        "product_id",
        score.cast("decimal(5,2)").alias("confidence_score"),
        F.when(score >= 95, "exact").otherwise("fuzzy").alias("match_type"),
        status.alias("status"),
        at.alias("matched_at"),
        F.when(score >= 95, F.col("p_partkey") % 7).alias("verified_by"),
        F.when(score >= 95, at + F.expr("INTERVAL 1 DAY")).alias("verified_at"),
    )


def retailers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as retailers, last crawled when they last shipped."""
    key = F.col("s_suppkey")
    seen = scan(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.max("l_shipdate").alias("last_crawled_at"))
    status = one_of(("active", "active", "active", "degraded", "paused", "failed"), key % 6)
    return scan(spark, sf_dir, "supplier").join(seen, "s_suppkey", "left").select(
        key.alias("id"),
        F.col("s_name").alias("name"),
        slugify(F.col("s_name")).alias("slug"),
        status.alias("status"),
        (key % 12).cast("int").alias("consecutive_failures"),
        "last_crawled_at",
        F.when(status == "paused", F.expr("TIMESTAMP '2001-11-01 00:00:00' + make_dt_interval(cast(s_suppkey % 7 as int))")).alias("paused_until"),
    )


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as reviews of fifty listings; ratings come from the labels."""
    labels = scan(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    rating = F.when(F.col("toxic") == 1, 1.0).when((F.col("quality") == 1) & (F.col("toxic") == 0), 5.0).otherwise(3.0)
    return scan(spark, sf_dir, "documents").select("doc_id", "text").join(labels, "doc_id", "left").select(
        (F.col("doc_id") % 50).alias("listing_id"),
        F.col("doc_id").alias("id"),
        one_of(REVIEW_TITLES, F.col("doc_id") % 8).alias("title"),
        F.col("text").alias("body"),
        rating.alias("rating"),
        F.expr("date_sub(DATE '2001-10-30', cast(doc_id % 120 as int))").alias("review_date"),
    )


def crawl_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event stream as crawl events; a user stands for a crawl, 25 retailers have several crawls each."""
    names = {"view": "started", "click": "discovered", "signup": "completed", "purchase": "completed", "error": "failed"}
    return scan(spark, sf_dir, "events").select(*EVENT_COLUMNS(names))


def EVENT_COLUMNS(names: dict[str, str]) -> list[Column]:
    return [
        F.col("event_id").alias("id"),
        F.col("user_id").alias("crawl_id"),
        lookup(F.col("event_type"), names).alias("event"),
        F.concat(F.lit("retailer-"), (F.col("user_id") % 25).cast("string")).alias("retailer"),
        F.col("ts").alias("created_at"),
        F.round(F.col("value").cast("decimal(18,2)") * 1000).cast("long").alias("duration_ms"),
    ]


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' price alerts, five products each at most one alert."""
    key = F.col("c_custkey")
    return scan(spark, sf_dir, "customer").select(
        key.alias("user_id"),
        (key % 97).alias("product_id"),
        (F.abs(pence(F.col("c_acctbal"))) * 5 + 100_000).alias("target_price_pence"),
        (F.col("c_mktsegment") != "MACHINERY").alias("is_active"),
        F.when(key % 3 == 0, F.expr("TIMESTAMP '2001-10-01 00:00:00'")).alias("last_notified_at"),
    )
