"""Queries over the catalogue, monitoring, updates and exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from quayside.operators import catalogue as C
from quayside.operators import filters, monitoring as M, updates as U
from quayside.operators.prices import latest
from quayside.plans.base import ratio, sql
from quayside.sources import exports as X
from quayside.sources import tables as T


def _now(spark, sf_dir):
    return latest(T.prices(spark, sf_dir))


def _joined(d):
    return d.withColumn("allergens", F.array_join("allergens", ","))


_LISTED = ["id", "title", "price_pence"]
QUERIES = {
    "listings_in_stock": lambda s, d: T.listings(s, d).where(filters.in_stock()).select(*_LISTED),
    "listings_on_sale": lambda s, d: T.listings(s, d).where(filters.on_sale()).select(*_LISTED),
    "listings_to_scrape": lambda s, d: T.listings(s, d).where(filters.needs_scraping(_now(s, d), 24 * 60)).select("id", "last_scraped_at"),
    "listings_with_barcode": lambda s, d: T.listings(s, d).where(filters.with_barcode()).select("id", "barcode"),
    "matches_high_confidence": lambda s, d: T.matches(s, d).where(filters.confidence(least=90) & filters.verified()).select("listing_id", "product_id"),
    "matches_low_confidence": lambda s, d: T.matches(s, d).where(filters.confidence(below=70)).select("listing_id", "product_id"),
    "reviews_recent": lambda s, d: T.reviews(s, d).where(filters.recent_reviews(F.lit("2001-10-30 00:00:00").cast("timestamp"))).select("id", "review_date"),
    "retailers_crawlable": lambda s, d: T.retailers(s, d).where(filters.crawlable()).select("id", "status"),
    "pauses_expired": lambda s, d: T.retailers(s, d).where(filters.pause_expired(_now(s, d))).select("id", "paused_until"),
    "products_with_stock": lambda s, d: filters.listings_of(T.listings(s, d), T.products(s, d), T.matches(s, d), filters.in_stock()).select("id", "name"),
    "listings_with_allergen": lambda s, d: filters.with_allergen(T.listings(s, d), "chicken").select("id"),
    "listings_without_allergen": lambda s, d: filters.without_allergen(T.listings(s, d), "chicken").select("id"),
    "listings_grain_free": lambda s, d: filters.grain_free(T.listings(s, d)).select("id"),
    "listings_single_protein": lambda s, d: filters.single_protein(T.listings(s, d)).select("id"),
    "search_like": lambda s, d: C.like(T.products(s, d), "red w").select("id", "name", "rank"),
    "search_tokens": lambda s, d: C.full_text(T.products(s, d), "Red wid").select("id", "name", "relevance"),
    "search_page": lambda s, d: C.search(T.products(s, d), C.Filters(text="blue", max_price=150_000, per_page=20)).select("id", "name", "relevance"),
    "suggestions": lambda s, d: C.suggestions(T.products(s, d), "wid").select("id", "name", "rank"),
    "catalogue_filter": lambda s, d: C.filtered(T.products(s, d), C.Filters(canonical_category="treats", min_price=95_000, max_price=100_000, verified=True)).select("id", "name", "lowest_price_pence"),
    "catalogue_page": lambda s, d: C.page(T.products(s, d), C.Filters(sort="lowest_price_pence", descending=True, page=3, per_page=24)).select("id", "lowest_price_pence"),
    "facets": lambda s, d: C.facets(T.products(s, d)),
    "suggested_products": lambda s, d: C.suggested_products(1, "Brand#17", "red widget", T.products(s, d), exclude=1).select("id", "name", "brand"),
    "featured_products": lambda s, d: C.featured(T.products(s, d), T.listings(s, d), T.matches(s, d)).select("id", "name"),
    "listing_counts": lambda s, d: C.listing_counts(T.products(s, d), T.matches(s, d)).select("id", "listing_count"),
    "price_comparison": lambda s, d: C.compared(T.listings(s, d), T.matches(s, d)),
    "other_matches": lambda s, d: C.other_matches(T.matches(s, d)).withColumn("others", F.array_join(F.col("others").cast("array<string>"), ",")),
    "api_listings": lambda s, d: C.as_resource(T.listings(s, d)),
    "completeness": lambda s, d: M.completeness(T.listings(s, d)),
    "stale_counts": lambda s, d: M.stale(T.listings(s, d), _now(s, d)),
    "freshness_histogram": lambda s, d: M.freshness(T.listings(s, d), _now(s, d)),
    "failure_rates": lambda s, d: M.failure_rates(T.retailers(s, d), T.listings(s, d), _now(s, d)),
    "inactive_entities": lambda s, d: M.inactive(T.retailers(s, d), _now(s, d)).select("id", "last_crawled_at"),
    "status_counts": lambda s, d: M.status_counts(T.retailers(s, d)),
    "catalogue_filter_pounds": lambda s, d: C.filtered(T.products(s, d), C.Filters.in_pounds(min_pounds=950.5, max_pounds=1000, canonical_category="treats")).select("id", "name", "lowest_price_pence"),
    "bulk_approve": lambda s, d: U.bulk_approve(T.matches(s, d), 80, 100, 7, F.expr("TIMESTAMP '2001-12-01 00:00:00'")).select("listing_id", "status", "verified_by", "verified_at"),
    "retailer_summary": lambda s, d: M.retailer_summary(T.retailers(s, d), _now(s, d), T.listings(s, d)),
    "match_type_counts": lambda s, d: M.match_statistics(T.listings(s, d), T.matches(s, d).where("status <> 'rejected'")),
    "verification_counts": lambda s, d: M.verification_counts(T.matches(s, d)),
    "verifier_activity": lambda s, d: M.verifier_activity(T.matches(s, d)),
    "home_totals": lambda s, d: M.home_totals(T.products(s, d), T.listings(s, d), T.retailers(s, d)),
    "retailer_transitions": lambda s, d: U.move(T.retailers(s, d), T.retailers(s, d).select("id", F.when(F.col("id") % 2 == 0, "paused").otherwise("degraded").alias("new_status"))).select("id", "status", "moved", "refused"),
    "resume_paused": lambda s, d: U.resume_expired(T.retailers(s, d), _now(s, d)).select("id", "status", "resumed"),
    "upsert_listings": lambda s, d: U.upsert(_observed(s, d, True), _observed(s, d, False), ["listing_id"], ["recorded_at", "id", "price_pence"]),
    "detect_changes": lambda s, d: U.changes(_observed(s, d, True).groupBy("listing_id").agg(F.max("price_pence").alias("p")), _observed(s, d, False).groupBy("listing_id").agg(F.max("price_pence").alias("p")), ["listing_id"], ["p"]),
    "bulk_approvable": lambda s, d: U.bulk_approvable(T.matches(s, d), 80, 100).select("listing_id", "product_id"),
    "export_products": lambda s, d: X.product_rows(T.products(s, d)),
    "export_prices": lambda s, d: X.price_rows(T.products(s, d), T.matches(s, d), T.listings(s, d), T.retailers(s, d)),
    "export_nested_json": lambda s, d: X.nested(T.products(s, d), T.matches(s, d), T.listings(s, d), T.retailers(s, d)),
}


def _observed(spark, sf_dir, early):
    rows = T.prices(spark, sf_dir).select("listing_id", "recorded_at", "id", "price_pence")
    return rows.where(F.col("recorded_at") < "1999-01-01" if early else F.col("recorded_at") >= "1999-01-01")


_PASSED = "l.id IN (SELECT listing_id FROM matches)"
_HOURS = lambda n: f"t - INTERVAL {n} HOUR"
_ALLERGEN = {"chicken": "ingredients LIKE '%Chicken%'"}
_SALE = "original_price_pence IS NOT NULL AND price_pence < original_price_pence"
_TOKENS = "string_split_regex(lower({}), '[^0-9a-z]+')"
_HIT = lambda c, t, last=False: f"list_has_any({_TOKENS.format(c)}, ['{t}'])" if not last else f"len(list_filter({_TOKENS.format(c)}, lambda x: starts_with(x, '{t}'))) > 0"
_POUNDS = lambda c: f"format('{{:,}}', {c} // 100) || '.' || lpad(CAST({c} % 100 AS VARCHAR), 2, '0')"
_FT = lambda one: f"(CASE WHEN {one('name')} THEN 1.0 ELSE 0 END + CASE WHEN {one('brand')} THEN 1.0 ELSE 0 END + CASE WHEN {one('category')} THEN 0.2 ELSE 0 END)::DOUBLE"
_red, _wid, _blue = (lambda c: _HIT(c, "red")), (lambda c: _HIT(c, "wid", True)), (lambda c: _HIT(c, "blue", True))
_any = lambda one: f"({one('name')} OR {one('brand')} OR {one('category')})"

ORACLE_SQL = {
    "listings_in_stock": sql("listings", " SELECT id, title, price_pence FROM listings WHERE in_stock"),
    "listings_on_sale": sql("listings", f" SELECT id, title, price_pence FROM listings WHERE {_SALE}"),
    "listings_to_scrape": sql("listings now_", f" SELECT id, last_scraped_at FROM listings, now_ WHERE last_scraped_at IS NULL OR last_scraped_at < {_HOURS(24 * 60)}"),
    "listings_with_barcode": sql("listings", " SELECT id, barcode FROM listings WHERE barcode IS NOT NULL"),
    "matches_high_confidence": sql("matches", " SELECT listing_id, product_id FROM matches WHERE c >= 90 AND verified_at IS NOT NULL"),
    "matches_low_confidence": sql("matches", " SELECT listing_id, product_id FROM matches WHERE c < 70"),
    "reviews_recent": sql("reviews", " SELECT id, review_date FROM reviews WHERE review_date >= DATE '2001-09-30'"),
    "retailers_crawlable": sql("retailers", " SELECT id, status FROM retailers WHERE status IN ('active', 'degraded')"),
    "pauses_expired": sql("retailers now_", " SELECT id, paused_until FROM retailers, now_ WHERE status = 'paused' AND paused_until <= t"),
    "products_with_stock": sql("products listings matches", " SELECT id, name FROM products WHERE id IN (SELECT product_id FROM matches WHERE listing_id IN (SELECT id FROM listings WHERE in_stock))"),
    "listings_with_allergen": sql("listings", " SELECT id FROM listings WHERE ingredients LIKE '%Chicken%'"),
    "listings_without_allergen": sql("listings", " SELECT id FROM listings WHERE ingredients IS NULL OR ingredients NOT LIKE '%Chicken%'"),
    "listings_grain_free": sql("listings", " SELECT id FROM listings WHERE ingredients IS NULL OR NOT regexp_matches(lower(ingredients), 'grain|rice|oat|barley|millet|sorghum|cereal|wheat|gluten|flour|corn|maize')"),
    "listings_single_protein": sql("listings", """ SELECT id FROM listings WHERE CAST(regexp_matches(lower(ingredients), 'chicken|poultry') AS INT) + CAST(regexp_matches(lower(ingredients), 'beef|cattle|ox|bovine') AS INT)
        + CAST(regexp_matches(lower(ingredients), 'pork|pig|swine|ham|bacon') AS INT) + CAST(regexp_matches(lower(ingredients), 'fish|salmon|tuna|cod|herring|trout') AS INT) + CAST(regexp_matches(lower(ingredients), 'lamb|mutton|sheep|ovine') AS INT) = 1"""),
    "search_like": sql("products", " SELECT id, name, CASE WHEN name ILIKE '%red%w%' THEN 1 WHEN brand ILIKE '%red%w%' THEN 2 ELSE 3 END AS rank FROM products WHERE name ILIKE '%red%w%' OR brand ILIKE '%red%w%' OR category ILIKE '%red%w%'"),
    "search_tokens": sql("products", f" SELECT id, name, {_FT(_red)} + {_FT(_wid)} AS relevance FROM products WHERE {_any(_red)} AND {_any(_wid)}"),
    "search_page": sql("products", f" SELECT id, name, {_FT(_blue)} AS relevance FROM products WHERE {_any(_blue)} AND lowest_price_pence <= 150000 ORDER BY relevance DESC, name, id LIMIT 20"),
    "suggestions": sql("products", " SELECT id, name, CASE WHEN contains(lower(name), 'wid') THEN 1 ELSE 2 END AS rank FROM products WHERE contains(lower(name), 'wid') OR contains(lower(brand), 'wid') ORDER BY rank, name, id LIMIT 10"),
    "catalogue_filter": sql("products", " SELECT id, name, lowest_price_pence FROM products WHERE canonical_category = 'treats' AND lowest_price_pence BETWEEN 95000 AND 100000 AND is_verified"),
    "catalogue_page": sql("products", " SELECT id, lowest_price_pence FROM products ORDER BY lowest_price_pence DESC, id LIMIT 24 OFFSET 48"),
    "facets": sql("products", " SELECT 'brand' AS facet, brand AS value, count(*) AS n FROM products GROUP BY 2 UNION ALL SELECT 'canonical_category', canonical_category, count(*) FROM products GROUP BY 2"),
    "suggested_products": sql("products", " SELECT id, name, brand FROM products WHERE (brand = 'Brand#17' OR contains(lower(name), 'brand#17')) AND id <> 1 ORDER BY id LIMIT 10"),
    "featured_products": sql("products listings matches", " SELECT id, name FROM products WHERE id IN (SELECT product_id FROM matches m JOIN listings l ON l.id = m.listing_id WHERE in_stock) ORDER BY id DESC LIMIT 8"),
    "listing_counts": sql("products matches", " SELECT id, (SELECT count(*) FROM matches WHERE product_id = products.id) AS listing_count FROM products"),
    "price_comparison": sql("listings matches", " SELECT listing_id, product_id, title, price_pence, price_pence - min(price_pence) OVER (PARTITION BY product_id) AS above_lowest_pence FROM matches m JOIN listings l ON l.id = m.listing_id"),
    "other_matches": sql("matches", """ SELECT a.listing_id, a.product_id, coalesce((SELECT string_agg(CAST(x AS VARCHAR), ',' ORDER BY x) FROM (SELECT b.listing_id AS x FROM matches b WHERE b.product_id = a.product_id AND b.listing_id <> a.listing_id ORDER BY x LIMIT 10)), '') AS others FROM matches a"""),
    "api_listings": sql("listings", f" SELECT id, title, price_pence, '£' || {_POUNDS('price_pence')} AS formatted_price, coalesce({_SALE}, false) AS is_on_sale, in_stock FROM listings"),
    "completeness": sql("listings", f""" SELECT *, {ratio("(total * 6 - missing_title - missing_brand - missing_price_pence - missing_weight_grams - missing_ingredients - missing_images) * 100", "total * 6", 1)} AS score FROM (SELECT count(*) AS total,
        count(*) FILTER (title IS NULL) AS missing_title, count(*) FILTER (brand IS NULL) AS missing_brand, count(*) FILTER (price_pence IS NULL) AS missing_price_pence, count(*) FILTER (weight_grams IS NULL) AS missing_weight_grams,
        count(*) FILTER (ingredients IS NULL) AS missing_ingredients, count(*) FILTER (NOT has_image) AS missing_images FROM listings)"""),
    "stale_counts": sql("listings now_", f" SELECT retailer_id, count(*) AS stale_count, min(last_scraped_at) AS oldest_scrape FROM listings, now_ WHERE last_scraped_at IS NULL OR last_scraped_at < {_HOURS(48)} GROUP BY 1"),
    "freshness_histogram": sql("listings now_", f""" SELECT count(*) FILTER (last_scraped_at >= {_HOURS(24)}) AS under_24h, count(*) FILTER (last_scraped_at < {_HOURS(24)} AND last_scraped_at >= {_HOURS(48)}) AS under_48h,
        count(*) FILTER (last_scraped_at < {_HOURS(48)} AND last_scraped_at >= {_HOURS(168)}) AS under_7d, count(*) FILTER (last_scraped_at < {_HOURS(168)}) AS over_7d, count(*) FILTER (last_scraped_at IS NULL) AS never FROM listings, now_"""),
    "failure_rates": sql("retailers listings now_", f""" SELECT r.id AS retailer_id, name, total, failed, {ratio("failed * 100", "total", 2)} AS failure_rate FROM retailers r JOIN (SELECT retailer_id, count(*) AS total,
        count(*) FILTER (last_scraped_at IS NULL OR last_scraped_at < {_HOURS(24)}) AS failed FROM listings, now_ GROUP BY 1) g ON g.retailer_id = r.id WHERE status IN ('active', 'degraded') AND failed >= total * 0.2"""),
    "inactive_entities": sql("retailers now_", f" SELECT id, last_crawled_at FROM retailers, now_ WHERE status IN ('active', 'degraded') AND (last_crawled_at IS NULL OR last_crawled_at < {_HOURS(24)})"),
    "status_counts": sql("retailers", " SELECT v.status, count(r.id) AS n FROM (VALUES ('active'), ('paused'), ('disabled'), ('degraded'), ('failed'), ('all')) v(status) LEFT JOIN retailers r ON r.status = v.status OR v.status = 'all' GROUP BY 1"),
    "catalogue_filter_pounds": sql("products", " SELECT id, name, lowest_price_pence FROM products WHERE canonical_category = 'treats' AND lowest_price_pence BETWEEN 95050 AND 100000"),
    "bulk_approve": sql("matches", """, chosen AS (SELECT listing_id FROM matches WHERE status = 'pending' AND c >= 80 ORDER BY listing_id LIMIT 100)
        SELECT listing_id, CASE WHEN x THEN 'approved' ELSE status END AS status, CASE WHEN x THEN 7 ELSE verified_by END AS verified_by, CASE WHEN x THEN TIMESTAMP '2001-12-01 00:00:00' ELSE verified_at END AS verified_at
        FROM (SELECT *, listing_id IN (SELECT listing_id FROM chosen) AS x FROM matches)"""),
    "retailer_summary": sql("retailers now_", f" SELECT count(*) AS total, count(*) FILTER (status IN ('active', 'degraded')) AS crawlable, count(*) FILTER (status IN ('paused', 'degraded', 'failed')) AS with_problems, count(*) FILTER (last_crawled_at >= {_HOURS(24)}) AS crawled_last_day, (SELECT count(*) FROM part WHERE p_partkey % 10 IN (SELECT s_suppkey FROM supplier)) AS listings FROM retailers, now_"),
    "match_type_counts": sql("listings matches", """ SELECT v.t AS match_type, CASE WHEN v.t = 'unmatched' THEN (SELECT count(*) FROM listings WHERE id NOT IN (SELECT listing_id FROM matches WHERE status <> 'rejected'))
        ELSE (SELECT count(*) FROM matches WHERE match_type = v.t AND status <> 'rejected') END AS n FROM (VALUES ('exact'), ('fuzzy'), ('barcode'), ('manual'), ('unmatched')) v(t)"""),
    "verification_counts": sql("matches", " SELECT count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'approved') AS approved, count(*) FILTER (status = 'rejected') AS rejected, count(*) AS total, count(*) FILTER (status = 'pending' AND c >= 90) AS high_confidence_pending FROM matches"),
    "verifier_activity": sql("matches", " SELECT verified_by, CAST(verified_at AS DATE) AS day, count(*) AS approved FROM matches WHERE verified_by IS NOT NULL GROUP BY 1, 2"),
    "home_totals": sql("products listings retailers", " SELECT 'products' AS name, count(*) AS n FROM products UNION ALL SELECT 'in_stock_listings', count(*) FROM listings WHERE in_stock UNION ALL SELECT 'active_retailers', count(*) FROM retailers WHERE status = 'active'"),
    "retailer_transitions": sql("retailers", """ SELECT id, CASE WHEN fine THEN w ELSE status END AS status, fine AND w <> status AS moved, NOT fine AS refused FROM (SELECT *, w = status OR (status = 'active') OR (status = 'degraded' AND w = 'paused') AS fine
        FROM (SELECT id, status, CASE WHEN id % 2 = 0 THEN 'paused' ELSE 'degraded' END AS w FROM retailers))"""),
    "resume_paused": sql("retailers now_", " SELECT id, CASE WHEN o THEN 'active' ELSE status END AS status, o AS resumed FROM (SELECT *, coalesce(status = 'paused' AND paused_until <= t, false) AS o FROM retailers, now_)"),
    "upsert_listings": sql("prices", " SELECT listing_id, x.recorded_at, x.id, x.price_pence FROM (SELECT listing_id, arg_max({'recorded_at': recorded_at, 'id': id, 'price_pence': price_pence}, (recorded_at, id, price_pence)) AS x FROM prices GROUP BY 1)"),
    "detect_changes": sql("prices", """ SELECT coalesce(a.listing_id, b.listing_id) AS listing_id, CASE WHEN a.listing_id IS NULL THEN 'created' WHEN b.listing_id IS NULL THEN 'missing' WHEN a.p = b.p THEN 'unchanged' ELSE 'updated' END AS change
        FROM (SELECT listing_id, max(price_pence) AS p FROM prices WHERE recorded_at < '1999-01-01' GROUP BY 1) a FULL JOIN (SELECT listing_id, max(price_pence) AS p FROM prices WHERE recorded_at >= '1999-01-01' GROUP BY 1) b ON a.listing_id = b.listing_id"""),
    "bulk_approvable": sql("matches", " SELECT listing_id, product_id FROM matches WHERE status = 'pending' AND c >= 80 ORDER BY listing_id LIMIT 100"),
    "export_products": sql("products", f" SELECT id, name, slug, brand, category, canonical_category, weight_grams, {_POUNDS('lowest_price_pence')} AS lowest_price, CASE WHEN is_verified THEN 'Yes' ELSE 'No' END AS verified FROM products"),
    "export_prices": sql("products matches listings retailers", f""" SELECT product_id, p.name, p.brand, r.name AS retailer, listing_id, title, CASE WHEN price_pence <> 0 THEN {_POUNDS("price_pence")} END AS price,
        CASE WHEN original_price_pence <> 0 THEN {_POUNDS("original_price_pence")} END AS original_price, CASE WHEN {_SALE} THEN 'Yes' ELSE 'No' END AS on_sale, CASE WHEN in_stock THEN 'Yes' ELSE 'No' END AS in_stock,
        strftime(l.last_scraped_at, '%Y-%m-%dT%H:%M:%SZ') AS last_scraped
        FROM products p JOIN matches m ON m.product_id = p.id JOIN listings l ON l.id = m.listing_id LEFT JOIN retailers r ON r.id = l.retailer_id"""),
    "export_nested_json": sql("products matches listings retailers", """, x AS (SELECT product_id, list({'price_pence': price_pence, 'listing_id': listing_id, 'title': title, 'in_stock': in_stock,
        'retailer': CASE WHEN r.id IS NOT NULL THEN {'id': r.id, 'name': r.name, 'slug': r.slug} END} ORDER BY price_pence, listing_id) AS listings
        FROM matches m JOIN listings l ON l.id = m.listing_id LEFT JOIN retailers r ON r.id = l.retailer_id GROUP BY 1)
        SELECT id, CAST(to_json({'id': id, 'name': name, 'brand': brand, 'listings': coalesce(listings, [])}) AS VARCHAR) AS json FROM products LEFT JOIN x ON x.product_id = products.id"""),
}
