"""The catalogue: filters, search, ranking, suggestions, facets, pages, API projections."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside.functions.text import money
from quayside.operators.filters import contains_text

SORTABLE = ("name", "brand", "lowest_price_pence", "created_at", "updated_at")
#: Weights of the fields of a full-text match.
FIELD_WEIGHTS = {"name": 1.0, "brand": 1.0, "description": 0.4, "category": 0.2, "subcategory": 0.2}


@dataclass(frozen=True)
class Filters:
    """What to search for; None is no condition. Prices are in pence."""

    text: str | None = None
    brand: str | None = None
    category: str | None = None
    canonical_category: str | None = None
    min_price: int | None = None
    max_price: int | None = None
    verified: bool | None = None
    sort: str = "name"
    descending: bool = False
    page: int = 1
    per_page: int = 15

    @classmethod
    def in_pounds(cls, min_pounds: float | None = None, max_pounds: float | None = None, **others) -> Filters:
        """Filters whose prices are given in pounds."""
        pence = lambda x: None if x is None else round(x * 100)
        return cls(min_price=pence(min_pounds), max_price=pence(max_pounds), **others)

    def __post_init__(self):
        if self.text is not None and not 2 <= len(self.text) <= 200:
            raise ValueError("a search text has 2 to 200 characters")
        if not 1 <= self.per_page <= 100 or self.page < 1:
            raise ValueError("a page has 1 to 100 rows, and pages begin at 1")
        if (self.min_price or 0) < 0 or (self.max_price is not None and self.max_price < (self.min_price or 0)):
            raise ValueError("prices aren't negative, and the largest isn't below the smallest")


def filtered(products: DataFrame, f: Filters) -> DataFrame:
    for column, value in (("brand", f.brand), ("category", f.category), ("canonical_category", f.canonical_category), ("is_verified", f.verified)):
        if value is not None:
            products = products.where(F.col(column) == value)
    if f.min_price is not None:
        products = products.where(F.col("lowest_price_pence") >= f.min_price)
    if f.max_price is not None:
        products = products.where(F.col("lowest_price_pence") <= f.max_price)
    return products


def query_terms(text: str) -> list[str]:
    """Words of a query without signs, in lower case."""
    return [w for w in (re.sub(r"[^0-9a-z]", "", part) for part in text.lower().split()) if w]


def full_text(products: DataFrame, text: str) -> DataFrame:
    """Products with all words of the query in some field, the last one as the beginning of a word; scored by field.

    The score adds the weights of the fields that hold each word. Words aren't stemmed.
    """
    terms = query_terms(text)
    fields = [c for c in FIELD_WEIGHTS if c in products.columns]
    tokens = {c: F.split(F.lower(F.coalesce(F.col(c), F.lit(""))), r"[^0-9a-z]+") for c in fields}
    score, every = F.lit(0.0), F.lit(bool(terms))
    for k, term in enumerate(terms):
        last = k == len(terms) - 1
        held = {c: F.exists(tokens[c], lambda w: w.startswith(term)) if last else F.array_contains(tokens[c], term) for c in fields}  # noqa: B023
        some = F.lit(False)
        for c in fields:
            some = some | held[c]
            score = score + F.when(held[c], FIELD_WEIGHTS[c]).otherwise(0.0)
        every = every & some
    return products.where(every).withColumn("relevance", score)


def like(products: DataFrame, text: str) -> DataFrame:
    """Products where a field holds the query's words in order with anything between; name before brand before others."""
    pattern = "%" + text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_").replace(" ", "%") + "%"
    fields = [c for c in FIELD_WEIGHTS if c in products.columns]
    some = F.lit(False)
    for c in fields:
        some = some | F.coalesce(F.col(c).ilike(pattern), F.lit(False))
    rank = F.when(F.col("name").ilike(pattern), 1).when(F.col("brand").ilike(pattern), 2).otherwise(3)
    return products.where(some).withColumn("rank", rank)


def ordered(products: DataFrame, sort: str, descending: bool = False) -> DataFrame:
    """By an allowed column, ties by id; any other name leaves the order by id."""
    if sort not in SORTABLE or sort not in products.columns:
        return products.orderBy("id")
    return products.orderBy(F.desc_nulls_last(sort) if descending else F.asc_nulls_last(sort), "id")


def page(products: DataFrame, f: Filters) -> DataFrame:
    return ordered(products, f.sort, f.descending).offset((f.page - 1) * f.per_page).limit(f.per_page)


def search(products: DataFrame, f: Filters) -> DataFrame:
    """A page of the filtered products; with a text the best matches first."""
    rows = filtered(products, f)
    if f.text is None:
        return page(rows, f)
    found = full_text(rows, f.text)
    return found.orderBy(F.desc("relevance"), "name", "id").offset((f.page - 1) * f.per_page).limit(f.per_page)


def suggestions(products: DataFrame, text: str, top: int = 10) -> DataFrame:
    """Products whose name or brand contains the text, names first."""
    low = F.lit(text.lower())
    rank = F.when(F.contains(F.lower("name"), low), 1).otherwise(2)
    return products.where(contains_text(text, "name", "brand")).withColumn("rank", rank).orderBy("rank", "name", "id").limit(top)


def facets(products: DataFrame) -> DataFrame:
    """(facet, value, n) of brands and canonical categories, without nulls."""
    values = F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).alias("value")) for c in ("brand", "canonical_category")])
    return products.select(F.explode(values).alias("x")).select("x.*").where("value is not null").groupBy("facet", "value").agg(F.count(F.lit(1)).alias("n"))


def suggested_products(listing_id: int, brand: str, name: str, products: DataFrame, exclude: int | None = None, top: int = 10) -> DataFrame:
    """Products of the brand or with it in their name."""
    hit = (F.col("brand") == brand) | F.contains(F.lower("name"), F.lit(brand.lower()))
    if exclude is not None:
        hit = hit & (F.col("id") != exclude)
    return products.where(hit).orderBy("id").limit(top).withColumn("listing_id", F.lit(listing_id))


def featured(products: DataFrame, listings: DataFrame, matches: DataFrame, top: int = 8) -> DataFrame:
    """Products with a listing in stock, newest first."""
    stocked = matches.join(listings.where("in_stock").select(F.col("id").alias("listing_id")), "listing_id", "left_semi").select(F.col("product_id").alias("id"))
    order = [F.desc_nulls_last("updated_at")] if "updated_at" in products.columns else []
    return products.join(stocked, "id", "left_semi").orderBy(*order, F.desc("id")).limit(top)


def listing_counts(products: DataFrame, matches: DataFrame) -> DataFrame:
    counts = matches.groupBy(F.col("product_id").alias("id")).agg(F.count(F.lit(1)).alias("listing_count"))
    return products.join(counts, "id", "left").withColumn("listing_count", F.coalesce("listing_count", F.lit(0).cast("long")))


def compared(listings: DataFrame, matches: DataFrame) -> DataFrame:
    """Each product's listings with the price's distance to the lowest."""
    from pyspark.sql import Window

    lowest = F.min("price_pence").over(Window.partitionBy("product_id"))
    rows = matches.select("listing_id", "product_id").join(listings.select(F.col("id").alias("listing_id"), "title", "price_pence"), "listing_id")
    return rows.withColumn("above_lowest_pence", F.col("price_pence") - lowest)


def other_matches(matches: DataFrame, top: int = 10) -> DataFrame:
    """For each match up to ``top`` other listings of its product, smallest ids first, each product's list built once."""
    from pyspark.sql import Window

    first = F.row_number().over(Window.partitionBy("product_id").orderBy("listing_id"))
    few = matches.select("product_id", "listing_id").distinct().withColumn("r", first).where(F.col("r") <= top + 1)
    some = few.groupBy("product_id").agg(F.sort_array(F.collect_list("listing_id")).alias("x"))
    return matches.select("listing_id", "product_id").join(some, "product_id").select("listing_id", "product_id", F.slice(F.array_remove("x", F.col("listing_id")), 1, top).alias("others"))


def as_resource(listings: DataFrame) -> DataFrame:
    """Listings as the API shows them."""
    sale: Column = F.col("original_price_pence").isNotNull() & (F.col("price_pence") < F.col("original_price_pence"))
    return listings.select("id", "title", "price_pence", money(F.col("price_pence")).alias("formatted_price"), F.coalesce(sale, F.lit(False)).alias("is_on_sale"), "in_stock")
