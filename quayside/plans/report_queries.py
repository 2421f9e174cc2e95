"""Queries over report rows, resources, search documents and monitoring totals."""

from __future__ import annotations

from pyspark.sql import functions as F

from quayside.operators import events as E
from quayside.operators import filters
from quayside.operators import reports as R
from quayside.operators.prices import latest
from quayside.plans.base import CTES, ratio, sql
from quayside.plans.event_queries import _DAILY
from quayside.plans.price_queries import ORACLE_SQL as PRICE_SQL
from quayside.sources import resources as S
from quayside.sources import tables as T

PLACEHOLDER = "https://img.example.com/placeholder.svg"


def _now(spark, sf_dir):
    return latest(T.prices(spark, sf_dir))


def _last_event(spark, sf_dir):
    return latest(T.crawl_events(spark, sf_dir), "created_at")


def _daily(spark, sf_dir):
    return E.daily_statistics(T.crawl_events(spark, sf_dir))


def _described(spark, sf_dir):
    """Listings with a description, every seventh without."""
    return T.listings(spark, sf_dir).withColumn("description", F.when(F.col("id") % 7 != 0, F.col("title")))


def _verifications(spark, sf_dir):
    """Orders as verifications by twenty users: the status is the action, urgent ones are bulk approvals."""
    action = F.when(F.col("o_orderstatus") == "F", "approved").when(F.col("o_orderstatus") == "O", "rejected").otherwise("rematched")
    return T.scan(spark, sf_dir, "orders").select(
        (F.col("o_custkey") % 20).alias("user_id"), action.alias("action"), (F.col("o_orderpriority") == "1-URGENT").alias("bulk"), F.col("o_orderdate").alias("verified_at")
    )


def _bridge(spark, sf_dir):
    """Line items as positions of ingredients in listings: a supplier stands for an ingredient, its smallest line number for the position."""
    lines = T.scan(spark, sf_dir, "lineitem")
    return lines.groupBy(F.col("l_partkey").alias("listing_id"), F.col("l_suppkey").alias("ingredient_id")).agg(F.min("l_linenumber").alias("position"))


def _ingredients(spark, sf_dir):
    return T.scan(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))


def _retailer_names(spark, sf_dir):
    """Listings with their retailer's name as a page spells it."""
    spelt = F.concat(F.lit("SUPPLIER#"), F.lpad(F.col("retailer_id").cast("string"), 9, "0"))
    return T.listings(spark, sf_dir).select("id", spelt.alias("retailer_name"))


def _images(spark, sf_dir):
    """Listings with one image each: an address, an object, or an object without an address."""
    key = F.col("id").cast("string")
    plain = F.concat(F.lit("https://img.example.com/"), key, F.lit(".jpg"))
    full = F.to_json(F.struct(plain.alias("url"), F.lit("front").alias("alt_text"), F.lit(True).alias("is_primary"), F.lit(640).alias("width")))
    cached = F.to_json(F.struct(F.concat(F.lit("/cache/"), key).alias("cached_url")))
    one = F.when(F.col("id") % 3 == 0, plain).when(F.col("id") % 3 == 1, full).otherwise(cached)
    return T.listings(spark, sf_dir).select("id", F.explode(S.images(F.array(one), PLACEHOLDER)).alias("image")).select("id", "image.*")


def _recent(s, d):
    tables = {"listings": (T.listings(s, d), "last_scraped_at"), "reviews": (T.reviews(s, d), "review_date"), "prices": (T.prices(s, d), "recorded_at")}
    return R.recent_counts(tables, _now(s, d))


QUERIES = {
    "day_totals": lambda s, d: R.day_totals(_daily(s, d), F.to_date(_last_event(s, d))),
    "retailer_history": lambda s, d: R.retailer_history(_daily(s, d), _last_event(s, d)).withColumn("failure_days", F.array_join(F.col("failure_days").cast("array<string>"), ",")),
    "verification_history": lambda s, d: R.verification_history(_verifications(s, d), F.lit("1996-01-01").cast("date"), F.lit("1997-12-31").cast("date")),
    "recent_counts": _recent,
    "top_events": lambda s, d: R.top_events(T.crawl_events(s, d)),
    "stored_bytes": lambda s, d: R.stored_bytes(T.scan(s, d, "pages").select(F.octet_length("html").cast("long").alias("size"))),
    "match_rate": lambda s, d: R.match_rate(T.listings(s, d), T.matches(s, d).where("status <> 'rejected'")),
    "retailers_by_severity": lambda s, d: R.by_severity(T.retailers(s, d)).select("id", "status", "severity"),
    "weekly_report_rows": lambda s, d: R.weekly_rows(T.listings(s, d), T.matches(s, d), T.products(s, d), T.prices(s, d), _now(s, d)),
    "quality_report_rows": lambda s, d: R.quality_rows(T.retailers(s, d), _described(s, d), T.prices(s, d), _now(s, d)),
    "listing_ingredients": lambda s, d: R.listing_ingredients(_bridge(s, d), _ingredients(s, d)).withColumn("ingredients", F.array_join("ingredients", ",")),
    "sale_discounts": lambda s, d: R.sale_discounts(T.listings(s, d)),
    "api_products": lambda s, d: S.products(T.products(s, d), T.matches(s, d)),
    "api_retailers": lambda s, d: S.retailers(T.retailers(s, d), _now(s, d), T.listings(s, d)),
    "api_prices": lambda s, d: S.prices(T.prices(s, d), T.listings(s, d), T.retailers(s, d)),
    "api_alerts": lambda s, d: S.alerts(T.alerts(s, d), T.products(s, d)),
    "api_images": _images,
    "search_product_documents": lambda s, d: S.product_documents(T.products(s, d)),
    "search_listing_documents": lambda s, d: S.listing_documents(_described(s, d)),
    "event_properties": lambda s, d: T.scan(s, d, "events").select("event_id", S.event_property(F.col("props"), "k").alias("k")),
    "listings_by_retailer_slug": lambda s, d: filters.with_retailer(_retailer_names(s, d), T.retailers(s, d)).select("id", "retailer_id"),
    "listings_equal": lambda s, d: T.listings(s, d).where(filters.equal(retailer_id=3, brand="Brand#13")).select("id", "barcode"),
    "reviews_high_rated": lambda s, d: T.reviews(s, d).where(filters.high_rated()).select("id", "rating"),
}

_POUNDS = lambda c: f"'£' || format('{{:,}}', {c} // 100) || '.' || lpad(CAST({c} % 100 AS VARCHAR), 2, '0')"
_ISO = lambda c: f"strftime({c}, '%Y-%m-%dT%H:%M:%SZ')"
_SUMS = ", ".join(f"CAST(coalesce(sum({c}), 0) AS BIGINT) AS {c}" for c in R.COUNTS)
_RATE = ratio("completed * 100", "completed + failed", 2)
_WEEK = ", ".join(f"CAST(coalesce(sum({c}) FILTER (day >= t - 7), 0) AS BIGINT) AS {c}" for c in R.COUNTS)
_DAY = "n AS (SELECT CAST(max(ts) AS DATE) AS t FROM events)"
_LACKS = {"price": "price_pence IS NULL", "description": "id % 7 = 0 OR title IS NULL", "images": "NOT has_image", "brand": "brand IS NULL", "ingredients": "ingredients IS NULL"}
_MISSING = ", ".join(f"count(*) FILTER ({cond}) AS missing_{c}" for c, cond in _LACKS.items())
_GONE = " - ".join(f"missing_{c}" for c in _LACKS)
_IMG = "'https://img.example.com/' || id || '.jpg'"

ORACLE_SQL = {
    "day_totals": sql("crawl", f", s AS ({_DAILY}), {_DAY} SELECT *, {_RATE} AS success_rate FROM (SELECT {_SUMS} FROM s, n WHERE day = t)"),
    "retailer_history": sql("crawl", f""", s AS ({_DAILY}), {_DAY}, f AS (SELECT retailer, string_agg(CAST(day AS VARCHAR), ',' ORDER BY day DESC) AS failure_days
        FROM (SELECT *, row_number() OVER (PARTITION BY retailer ORDER BY day DESC) AS r FROM s WHERE failed > 0) WHERE r <= 10 GROUP BY 1)
        SELECT g.*, {_RATE} AS success_rate, coalesce(failure_days, '') AS failure_days FROM (SELECT retailer, {_WEEK}, CAST(coalesce(sum(failed) FILTER (day >= t - 30), 0) AS BIGINT) AS failed_in_30_days FROM s, n GROUP BY 1) g LEFT JOIN f USING (retailer)"""),
    "verification_history": """SELECT *, approved + rejected + rematched AS total FROM (SELECT o_custkey % 20 AS user_id, CAST(o_orderdate AS DATE) AS day, count(*) FILTER (o_orderstatus = 'F') AS approved, count(*) FILTER (o_orderstatus = 'O') AS rejected,
        count(*) FILTER (o_orderstatus NOT IN ('F', 'O')) AS rematched, count(*) FILTER (o_orderstatus = 'F' AND o_orderpriority = '1-URGENT') AS bulk_approvals
        FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1996-01-01' AND DATE '1997-12-31' GROUP BY 1, 2)""",
    "recent_counts": sql("listings reviews prices now_", " UNION ALL ".join(
        f" SELECT '{n}' AS name, count(*) AS total, count(*) FILTER ({c} >= t - INTERVAL 24 HOUR) AS recent FROM {n}, now_" for n, c in (("listings", "last_scraped_at"), ("reviews", "review_date"), ("prices", "recorded_at")))),
    "top_events": sql("crawl", " SELECT event, count(*) AS n FROM crawl GROUP BY 1 ORDER BY n DESC, event LIMIT 10"),
    "stored_bytes": "SELECT count(*) AS n, CAST(coalesce(sum(octet_length(encode(html))), 0) AS BIGINT) AS total_bytes FROM pages",
    "match_rate": sql("listings matches", f" SELECT *, {ratio('matched * 100', 'listings')} AS match_rate FROM (SELECT count(*) AS listings, count(*) FILTER (id IN (SELECT listing_id FROM matches WHERE status <> 'rejected')) AS matched FROM listings)"),
    "retailers_by_severity": sql("retailers", " SELECT id, status, CAST(list_position(['failed', 'disabled', 'degraded', 'paused', 'active'], status) - 1 AS INT) AS severity FROM retailers"),
    "weekly_report_rows": f"""SELECT list_aggregate(list_transform(string_split(canonical_category, '_'), lambda w: upper(w[1]) || w[2:]), 'string_agg', ' ') AS category, CAST(t AS DATE) - 7 AS period_start, CAST(t AS DATE) AS period_end,
        product_count AS total_listings, average_price_pence, min_price_pence, max_price_pence, average_change_percentage AS average_price_change, on_sale_count AS listings_on_sale, on_sale_percentage AS sale_percentage
        FROM ({PRICE_SQL["category_weekly_report"]}), ({CTES["now_"]})""",
    "quality_report_rows": sql("retailers listings prices now_", f""", odd AS (SELECT DISTINCT a.listing_id FROM prices a JOIN prices b ON a.listing_id = b.listing_id AND a.recorded_at < b.recorded_at
        WHERE a.price_pence > 0 AND abs(b.price_pence - a.price_pence) * 100 > a.price_pence * 50)
        SELECT r.name AS retailer, slug, g.* EXCLUDE (retailer_id), {ratio(f"(total_listings * 5 - {_GONE}) * 100", "total_listings * 5", 1)} AS completeness_score FROM retailers r JOIN (SELECT retailer_id, count(*) AS total_listings, {_MISSING},
        count(*) FILTER (last_scraped_at IS NULL OR last_scraped_at < t - INTERVAL 48 HOUR) AS stale_listings, count(*) FILTER (id IN (SELECT listing_id FROM odd)) AS price_anomalies FROM listings, now_ GROUP BY 1) g ON g.retailer_id = r.id"""),
    "listing_ingredients": """SELECT listing_id, string_agg(s_name, ',' ORDER BY position, s_name) AS ingredients FROM (SELECT l_partkey AS listing_id, l_suppkey, min(l_linenumber) AS position FROM lineitem GROUP BY 1, 2)
        JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1""",
    "sale_discounts": sql("listings", f" SELECT id, {ratio('(original_price_pence - price_pence) * 100', 'original_price_pence')} AS discount_percentage FROM listings WHERE price_pence < original_price_pence"),
    "api_products": sql("products matches", f" SELECT id, name, slug, brand, category, weight_grams, lowest_price_pence, {_POUNDS('lowest_price_pence')} AS lowest_price_formatted, is_verified, (SELECT count(*) FROM matches WHERE product_id = products.id) AS listings_count FROM products"),
    "api_retailers": sql("retailers listings now_", f""" SELECT id, name, slug, status, upper(status[1]) || status[2:] AS status_label, coalesce(paused_until > t, false) AS is_paused, (SELECT count(*) FROM listings WHERE retailer_id = retailers.id) AS listings_count,
        {_ISO("paused_until")} AS paused_until, {_ISO("last_crawled_at")} AS last_crawled_at FROM retailers, now_"""),
    "api_prices": sql("prices listings retailers", f""" SELECT p.id, p.price_pence, {_POUNDS("p.price_pence")} AS price_formatted, p.original_price_pence, p.price_pence < p.original_price_pence AS is_on_sale, title AS listing_title, r.name AS retailer_name,
        r.slug AS retailer_slug, {_ISO("recorded_at")} AS recorded_at FROM prices p LEFT JOIN listings l ON l.id = p.listing_id LEFT JOIN retailers r ON r.id = l.retailer_id"""),
    "api_alerts": sql("alerts products", f" SELECT user_id, product_id, target_price_pence, {_POUNDS('target_price_pence')} AS target_price_formatted, is_active, name AS product_name, {_ISO('last_notified_at')} AS last_notified_at FROM alerts LEFT JOIN products ON products.id = product_id"),
    "api_images": sql("listings", f""" SELECT id, CASE id % 3 WHEN 2 THEN '/cache/' || id ELSE {_IMG} END AS url, CASE WHEN id % 3 = 2 THEN '/cache/' || id END AS cached_url, CASE WHEN id % 3 = 1 THEN 'front' END AS alt_text,
        id % 3 = 1 AS is_primary, CASE WHEN id % 3 = 1 THEN CAST(640 AS INT) END AS width, CAST(NULL AS INT) AS height, '{PLACEHOLDER}' AS placeholder_url FROM listings"""),
    "search_product_documents": sql("products", " SELECT id, name, brand, category, canonical_category FROM products"),
    "search_listing_documents": sql("listings", " SELECT id, title, CASE WHEN id % 7 <> 0 THEN title END AS description, brand, category, barcode, retailer_id FROM listings"),
    "event_properties": "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events",
    "listings_by_retailer_slug": sql("listings retailers", " SELECT l.id, r.id AS retailer_id FROM listings l JOIN retailers r ON r.slug = 'supplier' || lpad(CAST(retailer_id AS VARCHAR), 9, '0')"),
    "listings_equal": sql("listings", " SELECT id, barcode FROM listings WHERE retailer_id = 3 AND brand = 'Brand#13'"),
    "reviews_high_rated": sql("reviews", " SELECT id, rating FROM reviews WHERE rating >= 4.0"),
}
