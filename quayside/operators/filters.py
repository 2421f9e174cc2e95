"""Reusable predicates, for ``DataFrame.transform`` or ``where``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside.functions import fixed, ingredients
from quayside.functions.text import slugify


def in_stock() -> Column:
    return F.col("in_stock")


def on_sale() -> Column:
    return F.col("original_price_pence").isNotNull() & (F.col("price_pence") < F.col("original_price_pence"))


def needs_scraping(as_of: Column, hours: int = 24, column: str = "last_scraped_at") -> Column:
    """Never done, or longer ago than ``hours``."""
    return F.col(column).isNull() | (F.col(column) < as_of - F.expr(f"INTERVAL {int(hours)} HOURS"))


def needs_review_scraping(as_of: Column, days: int = 7) -> Column:
    return needs_scraping(as_of, 24 * days, "last_reviews_scraped_at")


def with_barcode() -> Column:
    return F.col("barcode").isNotNull()


def verified(yes: bool = True) -> Column:
    return F.col("verified_at").isNotNull() if yes else F.col("verified_at").isNull()


def confidence(least: float | None = None, below: float | None = None) -> Column:
    out = F.lit(True)
    if least is not None:
        out = out & (F.col("confidence_score") >= least)
    return out & (F.col("confidence_score") < below) if below is not None else out


def recent_reviews(as_of: Column, days: int = 30) -> Column:
    return F.col("review_date") >= F.to_date(as_of) - F.lit(days)


def high_rated(least: float = 4.0) -> Column:
    return F.col("rating") >= least


def verified_purchase() -> Column:
    return F.col("verified_purchase")


def equal(**values) -> Column:
    """Every named column has the given value, e.g. retailer_id, brand, category or barcode; without names every row."""
    out = F.lit(True)
    for name, value in values.items():
        out = out & (F.col(name) == value)
    return out


def between_days(column: str, first: Column, last: Column) -> Column:
    """The column's day lies between two days, both included."""
    return F.to_date(column).between(first, last)


def crawlable() -> Column:
    return F.col("status").isin(list(fixed.CRAWLABLE))


def problem() -> Column:
    return F.col("status").isin(list(fixed.PROBLEM))


def pause_expired(as_of: Column) -> Column:
    return (F.col("status") == "paused") & (F.col("paused_until") <= as_of)


def active_or_not(active: bool | None) -> Column:
    """True: active ones, False: all others, None: every row."""
    return F.lit(True) if active is None else (F.col("status") == "active" if active else F.col("status") != "active")


def contains_text(text: str, *columns: str) -> Column:
    """Any of the columns contains the text, whatever its case; a text of fewer than two characters is no condition."""
    if len(text) < 2:
        return F.lit(True)
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(F.contains(F.lower(F.col(c)), F.lit(text.lower())), F.lit(False))
    return out


def listings_of(listings: DataFrame, products: DataFrame, matches: DataFrame, condition: Column) -> DataFrame:
    """Products that have a listing with ``condition``."""
    having = matches.join(listings.where(condition).select(F.col("id").alias("listing_id")), "listing_id", "left_semi").select(F.col("product_id").alias("id"))
    return products.join(having, "id", "left_semi")


def with_allergens(listings: DataFrame) -> DataFrame:
    """Listings with the distinct allergens of their ingredients."""
    return listings.withColumn("allergens", ingredients.allergens(ingredients.names(F.col("ingredients"))))


def with_allergen(listings: DataFrame, allergen: str) -> DataFrame:
    return with_allergens(listings).where(F.array_contains("allergens", allergen))


def without_allergen(listings: DataFrame, *allergens: str) -> DataFrame:
    return with_allergens(listings).where(~F.arrays_overlap("allergens", F.array(*[F.lit(a) for a in allergens])))


def grain_free(listings: DataFrame) -> DataFrame:
    return with_allergens(listings).where(ingredients.is_grain_free(F.col("allergens")))


def single_protein(listings: DataFrame) -> DataFrame:
    """Exactly one of the five proteins."""
    return with_allergens(listings).where(ingredients.exactly_one_protein(F.col("allergens")))


def with_retailer(rows: DataFrame, retailers: DataFrame) -> DataFrame:
    """Rows with the id of the retailer whose slug their ``retailer_name`` gives; rows of unknown names are left out."""
    known = retailers.select(F.col("slug").alias("_slug"), F.col("id").alias("retailer_id"))
    return rows.withColumn("_slug", slugify(F.col("retailer_name"))).join(known, "_slug").drop("_slug")
