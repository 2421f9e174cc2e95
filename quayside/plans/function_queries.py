"""Queries over text functions, file names and updates that no other query applies."""

from __future__ import annotations

from pyspark.sql import functions as F

from quayside.functions import fixed, text
from quayside.operators import filters
from quayside.operators import updates as U
from quayside.operators.prices import latest
from quayside.plans.base import case, sql
from quayside.plans.report_queries import _bridge
from quayside.sources import exports as X
from quayside.sources import tables as T

UNITS = ("kg", "g", "lb", "oz", "stone")
HEADERS = ("image/PNG; q=1", "", "image/webp", "text/html")
DECIDED = "2001-12-01 00:00:00"


def _at(s):
    return F.lit(s).cast("timestamp")


def _part(s, d):
    return T.scan(s, d, "part").withColumn("size", F.col("p_size").cast("long"))


def _weights(s, d):
    unit = T.one_of(UNITS, F.col("size") % 5)
    other = F.col("size") + F.col("p_partkey") % 5
    return _part(s, d).select("p_partkey", text.normalize_weight(F.col("size"), unit).alias("grams"), text.weights_match(F.col("size"), other).alias("close"))


def _get_or_create(s, d):
    wanted = _part(s, d).select(F.col("p_brand").alias("brand"), F.col("p_partkey").alias("first_id"))
    known = wanted.where("first_id < 20").groupBy("brand").agg(F.max("first_id").alias("first_id"))
    return U.get_or_create(known, wanted, "brand", "first_id")


def _synchronise(s, d):
    wanted = _part(s, d).where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("listing_id"), (F.col("p_partkey") % 10).alias("ingredient_id"), F.lit(1).alias("position"))
    return U.synchronise(_bridge(s, d), wanted, "listing_id")


def _verify(s, d):
    matches, k = T.matches(s, d), F.col("listing_id") % 5
    decision = F.when(k == 0, "approve").when(k == 1, "reject").otherwise("rematch")
    decisions = matches.where(k < 3).select("listing_id", decision.alias("decision"), F.lit(9).cast("long").alias("user_id"), F.lit("wrong size").alias("reason"), F.lit(0).cast("long").alias("new_product_id"))
    return U.verify(matches, decisions, _at(DECIDED)).drop("matched_at")


def _flags(s, d):
    key = F.col("s_suppkey")
    health = T.one_of(("healthy", "degraded", "unhealthy"), key % 3)
    until = F.when(key % 4 == 1, _at("2002-01-01 00:00:00")).when(key % 4 == 2, _at("2001-01-01 00:00:00"))
    return T.scan(s, d, "supplier").select(key.alias("id"), U.status_of_flags(key % 7 != 0, health, until, _at(DECIDED)).alias("status"))


def _media(s, d):
    mime = text.mime_type(T.one_of(HEADERS, F.col("size") % 5))
    url = F.concat(F.lit("https://m.example.com/I/"), F.col("p_partkey").cast("string"), F.lit("._AC200_.jpg?w=90"))
    return _part(s, d).select("p_partkey", mime.alias("mime"), text.image_extension(mime).alias("extension"), *[text.larger_image(url, r).alias(r.split("-")[0]) for r in ("amazon-uk", "sainsburys", "ocado")])


QUERIES = {
    "weights": _weights,
    "brands_agree": lambda s, d: T.listings(s, d).select("id", text.brands_match(F.upper("brand"), F.concat(F.lit(" "), F.col("brand"))).alias("same"), text.brands_match(F.col("brand"), F.col("title")).alias("other")),
    "category_in_context": lambda s, d: T.listings(s, d).select("id", text.category_in_context(F.when(F.col("id") % 2 == 0, F.col("category")), F.when(F.col("id") % 3 == 0, F.lit("Puppy Food")).otherwise(F.col("title"))).alias("canonical_category")),
    "titles_from_urls": lambda s, d: T.scan(s, d, "pages").select("page_id", text.title_from_url(F.col("url")).alias("title"), text.class_basename(F.col("url")).alias("last_part")),
    "ingredient_names": lambda s, d: _part(s, d).select("p_partkey", text.ingredient_name(F.concat(F.lit(" "), "p_type", F.lit(" - "), "p_name", F.lit(". "))).alias("name")),
    "lists_in_words": lambda s, d: _part(s, d).groupBy("p_size").agg(text.list_in_words(F.array_sort(F.collect_set("p_type"))).alias("types")),
    "first_lines": lambda s, d: T.scan(s, d, "documents").select("doc_id", text.first_line(F.col("text")).alias("line")),
    "review_ids": lambda s, d: T.reviews(s, d).select("id", text.review_id(F.lit("asda"), F.col("title"), F.lit(None).cast("string"), F.col("body"), F.col("id")).alias("external_id")),
    "media_addresses": _media,
    "image_cache": lambda s, d: X.image_cache(T.listings(s, d).select(F.explode("images").alias("url"))),
    "export_file_names": lambda s, d: T.scan(s, d, "orders").select("o_orderkey", X.file_name(F.lower("o_orderstatus"), F.col("o_orderdate"), "csv").alias("file_name")),
    "exports_expired": lambda s, d: X.expired(T.scan(s, d, "orders").select("o_orderkey", F.col("o_orderdate").alias("created_at")), _at("1998-01-01 00:00:00")),
    "listings_to_review": lambda s, d: T.listings(s, d).withColumn("last_reviews_scraped_at", F.when(F.col("id") % 4 != 0, F.col("last_scraped_at"))).where(filters.needs_review_scraping(latest(T.prices(s, d)), 30)).select("id"),
    "retailers_not_active": lambda s, d: T.retailers(s, d).where(filters.active_or_not(False)).select("id", "status"),
    "listings_containing": lambda s, d: T.listings(s, d).where(filters.contains_text("RED", "title", "brand")).select("id", "title"),
    "get_or_create": _get_or_create,
    "synchronise_ingredients": _synchronise,
    "verify_matches": _verify,
    "fill_categories": lambda s, d: U.fill_categories(T.products(s, d).withColumn("canonical_category", F.when(F.col("id") % 2 == 0, F.col("canonical_category")))).select("id", "canonical_category", "updated"),
    "status_of_flags": _flags,
}

_FACTOR = case("p_size % 5", {k: fixed.UNIT_GRAMS.get(u, 1) for k, u in enumerate(UNITS)})
_WORDS = "list_sort(list_distinct(list(p_type)))"

ORACLE_SQL = {
    "weights": f"SELECT p_partkey, CAST(floor(p_size * CAST({_FACTOR} AS DOUBLE) + 0.5) AS BIGINT) AS grams, abs(p_partkey % 5) * 2 <= (2 * p_size + p_partkey % 5) * 0.05::DOUBLE AS close FROM part",
    "brands_agree": sql("listings", " SELECT id, brand IS NOT NULL AND brand <> '' AS same, coalesce(brand = title, false) AS other FROM listings"),
    "category_in_context": sql("listings products", """ SELECT l.id, CASE WHEN l.id % 2 = 0 AND c.canonical_category <> 'other' THEN c.canonical_category WHEN l.id % 3 = 0 THEN 'puppy_food' ELSE 'other' END AS canonical_category
        FROM listings l JOIN (SELECT DISTINCT category, canonical_category FROM products) c USING (category)"""),
    "titles_from_urls": """SELECT page_id, coalesce(array_to_string(list_transform(string_split(regexp_replace(p[-1], '[-_]', ' ', 'g'), ' '), lambda w: upper(w[1]) || w[2:]), ' '), 'Unknown Product') AS title, string_split(url, '/')[-1] AS last_part
        FROM (SELECT page_id, url, list_filter(string_split(regexp_extract(url, '^(?:[a-z+]+://[^/?#]*)?([^?#]*)', 1), '/'), lambda x: x <> '') AS p FROM pages)""",
    "ingredient_names": "SELECT p_partkey, lower(p_type) || '__' || replace(p_name, ' ', '_') AS name FROM part",
    "lists_in_words": f"SELECT p_size, CASE len(x) WHEN 1 THEN x[1] WHEN 2 THEN x[1] || ' and ' || x[2] ELSE array_to_string(x[:-2], ', ') || ', and ' || x[-1] END AS types FROM (SELECT p_size, {_WORDS} AS x FROM part GROUP BY 1)",
    "first_lines": "SELECT doc_id, left(string_split(text, chr(10))[1], 200) AS line FROM documents",
    "review_ids": sql("reviews", " SELECT id, 'asda-review-' || md5(title || body) || '-' || id AS external_id FROM reviews"),
    "media_addresses": f"""SELECT p_partkey, m AS mime, CASE m WHEN 'image/png' THEN 'png' WHEN 'image/webp' THEN 'webp' ELSE 'jpg' END AS extension, u || '._SL1500_.jpg?w=90' AS amazon, u || '._AC200_.jpg?w=800' AS sainsburys, u || '._AC200_.jpg?w=90' AS ocado
        FROM (SELECT p_partkey, 'https://m.example.com/I/' || p_partkey AS u, {case("p_size % 5", {0: "image/png", 2: "image/webp", 3: "text/html"}, "'image/jpeg'")} AS m FROM part)""",
    "image_cache": "SELECT url, sha256(url) || '.jpg' AS cached_path FROM (SELECT 'https://img.example.com/' || p_partkey || '.jpg' AS url FROM part WHERE p_size % 2 = 0)",
    "export_file_names": "SELECT o_orderkey, lower(o_orderstatus) || '_' || strftime(o_orderdate, '%Y-%m-%d_%H%M%S') || '.csv' AS file_name FROM orders",
    "exports_expired": "SELECT o_orderkey, o_orderdate AS created_at FROM orders WHERE o_orderdate < TIMESTAMP '1997-12-25 00:00:00'",
    "listings_to_review": sql("listings now_", " SELECT id FROM listings, now_ WHERE id % 4 = 0 OR last_scraped_at IS NULL OR last_scraped_at < t - INTERVAL 30 DAY"),
    "retailers_not_active": sql("retailers", " SELECT id, status FROM retailers WHERE status <> 'active'"),
    "listings_containing": sql("listings", " SELECT id, title FROM listings WHERE title ILIKE '%red%' OR brand ILIKE '%red%'"),
    "get_or_create": """WITH k AS (SELECT p_brand AS brand, max(p_partkey) AS first_id FROM part WHERE p_partkey < 20 GROUP BY 1)
        SELECT * FROM k UNION ALL SELECT p_brand, min(p_partkey) FROM part WHERE p_brand NOT IN (SELECT brand FROM k) GROUP BY 1""",
    "synchronise_ingredients": """SELECT l_partkey AS listing_id, l_suppkey AS ingredient_id, min(l_linenumber) AS position FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 2 = 0) GROUP BY 1, 2
        UNION ALL SELECT p_partkey, p_partkey % 10, 1 FROM part WHERE p_partkey % 2 = 0""",
    "verify_matches": sql("matches", f""" SELECT listing_id, CASE WHEN k = 2 THEN 0 ELSE product_id END AS product_id, CASE k WHEN 0 THEN 'approved' WHEN 1 THEN 'rejected' WHEN 2 THEN 'approved' ELSE status END AS status,
        CASE WHEN k = 2 THEN CAST(100 AS DECIMAL(5,2)) ELSE confidence_score END AS confidence_score, CASE WHEN k = 2 THEN 'manual' ELSE match_type END AS match_type, CASE WHEN k < 3 THEN 9 ELSE verified_by END AS verified_by,
        CASE WHEN k < 3 THEN TIMESTAMP '{DECIDED}' ELSE verified_at END AS verified_at, CASE WHEN k = 1 THEN 'wrong size' END AS rejection_reason FROM (SELECT *, listing_id % 5 AS k FROM matches)"""),
    "fill_categories": sql("products", " SELECT id, canonical_category, id % 2 = 1 AS updated FROM products"),
    "status_of_flags": f"""SELECT s_suppkey AS id, CASE WHEN s_suppkey % 7 = 0 THEN 'disabled' WHEN s_suppkey % 3 = 2 THEN 'failed' WHEN s_suppkey % 4 = 1 THEN 'paused' WHEN s_suppkey % 3 = 1 THEN 'degraded' ELSE 'active' END AS status FROM supplier""",
}
