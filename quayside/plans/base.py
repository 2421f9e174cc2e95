"""The driver's tables as the engine's, in SQL; see sources.tables for the same in Spark."""

from __future__ import annotations

from quayside.sources.tables import INGREDIENTS, PART_CATEGORIES, REVIEW_TITLES


def case(column: str, values: dict, otherwise: str = "NULL") -> str:
    return f"CASE {column} " + " ".join(f"WHEN {k!r} THEN {v!r}" for k, v in values.items()) + f" ELSE {otherwise} END"


PENCE = "CAST(CAST({} AS DECIMAL(18,2)) * 100 AS BIGINT)"
_CATEGORY = case("p_type", PART_CATEGORIES, "p_type")
_CANONICAL = case("p_type", {"STANDARD": "dry_food", "ECONOMY": "wet_food", "PROMO": "treats", "LARGE": "dental", "MEDIUM": "puppy_food", "SMALL": "senior_food"}, "'other'")

CTES = {
    "prices": f"""SELECT listing_id, id, recorded_at, o - (o * d) // 100 AS price_pence, o AS original_price_pence FROM (
        SELECT l_partkey AS listing_id, l_orderkey * 10 + l_linenumber AS id, l_shipdate AS recorded_at,
               {PENCE.format("l_extendedprice")} AS o, CAST(round(l_discount * 100) AS BIGINT) AS d FROM lineitem)""",
    "listings": f"""SELECT p_partkey AS id, p_partkey % 10 AS retailer_id, CASE WHEN p_size % 2 = 0 THEN lpad(CAST(p_partkey AS VARCHAR), 13, '0') END AS barcode,
        p_name AS title, p_brand AS brand, {_CATEGORY} AS category, {PENCE.format("p_retailprice")} AS price_pence,
        CASE WHEN p_size % 3 = 0 THEN {PENCE.format("p_retailprice")} + p_size * 10 END AS original_price_pence,
        CAST(p_size AS BIGINT) * 100 AS weight_grams, p_size % 5 <> 0 AS in_stock,
        {case("p_size % 4", dict(enumerate(INGREDIENTS)))} AS ingredients, p_size % 2 = 0 AS has_image, last_scraped_at
        FROM part LEFT JOIN (SELECT l_partkey, max(l_shipdate) AS last_scraped_at FROM lineitem GROUP BY 1) ON l_partkey = p_partkey""",
    "products": f"""SELECT id, p_name AS name, replace(p_name, ' ', '-') AS slug, p_brand AS brand, {_CATEGORY} AS category, {_CANONICAL} AS canonical_category,
        CAST(p_size AS BIGINT) * 100 AS weight_grams, {PENCE.format("p_retailprice")} AS lowest_price_pence, id % 2 = 0 AS is_verified
        FROM (SELECT p_brand, p_name, min(p_partkey) AS id FROM part GROUP BY 1, 2) k JOIN (SELECT p_partkey, p_type, p_size, p_retailprice FROM part) p ON k.id = p.p_partkey""",
    "matches": """SELECT *, CASE WHEN c >= 95 THEN 'exact' ELSE 'fuzzy' END AS match_type, CAST(c AS DECIMAL(5,2)) AS confidence_score,
        CASE WHEN c >= 95 THEN 'approved' WHEN c >= 80 THEN 'pending' ELSE 'rejected' END AS status,
        CASE WHEN c >= 95 THEN listing_id % 7 END AS verified_by, CASE WHEN c >= 95 THEN matched_at + INTERVAL 1 DAY END AS verified_at
        FROM (SELECT a.p_partkey AS listing_id, b.id AS product_id, TIMESTAMP '2001-06-01 00:00:00' + to_days(CAST(a.p_partkey % 150 AS INT)) AS matched_at,
              69 + CASE WHEN a.p_type = f.p_type THEN 15 ELSE 0 END + CASE WHEN abs(a.p_size - f.p_size) * 40 <= a.p_size + f.p_size THEN 12 ELSE 0 END AS c
              FROM part a JOIN (SELECT p_brand, p_name, min(p_partkey) AS id FROM part GROUP BY 1, 2) b ON a.p_brand = b.p_brand AND a.p_name = b.p_name JOIN part f ON f.p_partkey = b.id)""",
    "retailers": f"""SELECT s_suppkey AS id, s_name AS name, lower(replace(s_name, '#', '')) AS slug,
        {case("s_suppkey % 6", {0: "active", 1: "active", 2: "active", 3: "degraded", 4: "paused", 5: "failed"})} AS status, CAST(s_suppkey % 12 AS INT) AS consecutive_failures, last_crawled_at,
        CASE WHEN s_suppkey % 6 = 4 THEN TIMESTAMP '2001-11-01 00:00:00' + to_days(CAST(s_suppkey % 7 AS INT)) END AS paused_until
        FROM supplier LEFT JOIN (SELECT l_suppkey, max(l_shipdate) AS last_crawled_at FROM lineitem GROUP BY 1) ON l_suppkey = s_suppkey""",
    "reviews": f"""SELECT d.doc_id % 50 AS listing_id, d.doc_id AS id, {case("d.doc_id % 8", dict(enumerate(REVIEW_TITLES)))} AS title, text AS body,
        CASE WHEN toxic = 1 THEN 1.0::DOUBLE WHEN quality = 1 AND toxic = 0 THEN 5.0::DOUBLE ELSE 3.0::DOUBLE END AS rating, DATE '2001-10-30' - CAST(d.doc_id % 120 AS INT) AS review_date
        FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY 1) l ON d.doc_id = l.doc_id""",
    "crawl": f"""SELECT event_id AS id, user_id AS crawl_id, {case("event_type", {"view": "started", "click": "discovered", "signup": "completed", "purchase": "completed", "error": "failed"})} AS event,
        'retailer-' || CAST(user_id % 25 AS VARCHAR) AS retailer, ts AS created_at, CAST(CAST(value AS DECIMAL(18,2)) * 1000 AS BIGINT) AS duration_ms FROM events""",
    "alerts": f"""SELECT c_custkey AS user_id, c_custkey % 97 AS product_id, abs({PENCE.format("c_acctbal")}) * 5 + 100000 AS target_price_pence, c_mktsegment <> 'MACHINERY' AS is_active,
        CASE WHEN c_custkey % 3 = 0 THEN TIMESTAMP '2001-10-01 00:00:00' END AS last_notified_at FROM customer""",
    "now_": "SELECT max(l_shipdate) AS t FROM lineitem",
}


def sql(tables: str, body: str) -> str:
    """The body after the CTEs of the named tables."""
    return "WITH " + ", ".join(f"{t} AS ({CTES[t]})" for t in tables.split()) + body


def ratio(num: str, den: str, digits: int = 0) -> str:
    """num / den of integers, rounded half away from zero."""
    size = f"((abs({num}) * {2 * 10**digits} + ({den})) // (({den}) * 2))"
    return f"CASE WHEN ({den}) > 0 THEN (CASE WHEN ({num}) < 0 THEN -1 ELSE 1 END * {size}) / {10.0**digits}::DOUBLE END"


def mean(total: str, n: str) -> str:
    return f"CAST((2 * {total} + {n}) // (2 * {n}) AS BIGINT)"
