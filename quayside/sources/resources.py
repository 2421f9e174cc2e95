"""Rows as the JSON interface and the search index show them: projections with formatted money and ISO times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside.functions.text import money
from quayside.operators.filters import on_sale
from quayside.sources.exports import ISO

PRODUCT = ("id", "name", "slug", "brand", "description", "category", "subcategory", "weight_grams", "quantity", "primary_image")
SEARCHED_PRODUCT = ("id", "name", "brand", "description", "category", "canonical_category", "subcategory")
SEARCHED_LISTING = ("id", "title", "description", "brand", "category", "barcode", "retailer_id")


def present(df: DataFrame, columns: tuple[str, ...]) -> list[str]:
    return [c for c in columns if c in df.columns]


def times(df: DataFrame, *columns: str) -> list[Column]:
    return [F.date_format(c, ISO).alias(c) for c in present(df, columns)]


def amounts(df: DataFrame, *columns: str) -> list[Column]:
    """Each present column in pence and, beside it, formatted."""
    return [x for c in present(df, columns) for x in (F.col(c), money(F.col(c)).alias(c.replace("_pence", "_formatted")))]


def counted(df: DataFrame, others: DataFrame | None, key: str) -> DataFrame:
    """``df`` with its number of rows in ``others``, 0 for none; unchanged without ``others``."""
    if others is None:
        return df
    n = others.groupBy(F.col(key).alias("id")).agg(F.count(F.lit(1)).alias("listings_count"))
    return df.join(n, "id", "left").withColumn("listings_count", F.coalesce("listings_count", F.lit(0).cast("long")))


def products(rows: DataFrame, matches: DataFrame | None = None) -> DataFrame:
    all_ = counted(rows, matches, "product_id")
    return all_.select(*present(all_, PRODUCT), *amounts(all_, "average_price_pence", "lowest_price_pence"), "is_verified", *present(all_, ("listings_count",)), *times(all_, "created_at", "updated_at"))


def retailers(rows: DataFrame, as_of: Column, listings: DataFrame | None = None) -> DataFrame:
    all_ = counted(rows, listings, "retailer_id")
    paused = F.coalesce(F.col("paused_until") > as_of, F.lit(False)).alias("is_paused")
    return all_.select(
        "id", "name", "slug", *present(all_, ("base_url",)), "status", F.initcap("status").alias("status_label"), paused,
        *present(all_, ("listings_count",)), *times(all_, "paused_until", "last_crawled_at", "created_at", "updated_at"),
    )


def prices(rows: DataFrame, listings: DataFrame, retailers: DataFrame) -> DataFrame:
    """Price observations with their listing's title and retailer; those of unknown listings or retailers stay, without."""
    shops = retailers.select(F.col("id").alias("retailer_id"), F.col("name").alias("retailer_name"), F.col("slug").alias("retailer_slug"))
    own = listings.select(F.col("id").alias("listing_id"), F.col("title").alias("listing_title"), "retailer_id").join(shops, "retailer_id", "left")
    all_ = rows.join(own, "listing_id", "left")
    return all_.select(
        "id", *amounts(all_, "price_pence"), "original_price_pence", F.coalesce(on_sale(), F.lit(False)).alias("is_on_sale"),
        "listing_title", "retailer_name", "retailer_slug", *times(all_, "recorded_at"),
    )


def alerts(rows: DataFrame, products: DataFrame) -> DataFrame:
    """Price alerts with their product's name, null where there is no such product."""
    all_ = rows.join(products.select(F.col("id").alias("product_id"), F.col("name").alias("product_name")), "product_id", "left")
    return all_.select(*present(all_, ("id", "user_id")), "product_id", *amounts(all_, "target_price_pence"), "is_active", "product_name", *times(all_, "last_notified_at", "created_at", "updated_at"))


def product_documents(rows: DataFrame) -> DataFrame:
    return rows.select(*present(rows, SEARCHED_PRODUCT))


def listing_documents(rows: DataFrame) -> DataFrame:
    return rows.select(*present(rows, SEARCHED_LISTING))


def images(values: Column, placeholder: str) -> Column:
    """JSON texts of images, each a plain address or an object, as structs of seven fields; null stays null.

    An object without an address takes its cached one, without either the empty text; fields that are not given are null,
    ``is_primary`` false.
    """
    fields = "url string, cached_url string, alt_text string, is_primary boolean, width int, height int"

    def one(text: Column) -> Column:
        is_object = F.startswith(F.ltrim(text), F.lit("{"))
        o = F.from_json(F.when(is_object, text), fields)
        cached = o["cached_url"]
        url = F.when(is_object, F.coalesce(o["url"], cached, F.lit(""))).otherwise(text)
        return F.struct(
            url.alias("url"), cached.alias("cached_url"), o["alt_text"].alias("alt_text"), F.coalesce(o["is_primary"], F.lit(False)).alias("is_primary"),
            o["width"].alias("width"), o["height"].alias("height"), F.lit(placeholder).alias("placeholder_url"),
        )

    return F.transform(values, one)


def event_property(properties: Column, name: str) -> Column:
    """A top-level property of an event's JSON as text, null where there is none or the text isn't JSON."""
    return F.get_json_object(properties, f"$['{name}']")
