"""Queries over price observations."""

from __future__ import annotations

from pyspark.sql import functions as F

from quayside.operators import prices as P
from quayside.plans.base import mean, ratio, sql
from quayside.sources import tables as T


def _q(f):
    """f(prices, as_of, spark, sf_dir)."""

    def run(spark, sf_dir):
        prices = T.prices(spark, sf_dir)
        return f(prices, P.latest(prices), spark, sf_dir)

    return run


def _reporting(spark, sf_dir):
    return T.listings(spark, sf_dir), T.matches(spark, sf_dir), T.products(spark, sf_dir)


QUERIES = {
    "price_statistics": _q(lambda p, t, *_: P.statistics(p, t, 90)),
    "average_price": _q(lambda p, t, *_: P.average_price(p, t, 30)),
    "price_statistics_multi": _q(lambda p, t, *_: P.statistics_of_periods(p, t)),
    "price_trend": _q(lambda p, t, *_: P.trend(p, t, 365)),
    "sale_pattern": _q(lambda p, t, *_: P.sale_pattern(p, t, 365).withColumn("sale_dates", F.size("sale_dates").cast("long"))),
    "sale_weekdays": _q(lambda p, t, *_: P.sale_weekdays(p, t, 365).withColumn("recommended_days", F.array_join("recommended_days", ","))),
    "best_time_to_buy": _q(lambda p, t, s, d: P.best_time_to_buy(T.listings(s, d), p, t, 365).withColumn("recommended_days", F.array_join("recommended_days", ","))),
    "price_as_of": _q(lambda p, t, *_: P.price_before(p, P.ago(t, 7))),
    "category_weekly_report": _q(lambda p, t, s, d: P.weekly_report(*_reporting(s, d), p, t)),
    "category_top_movers": _q(lambda p, t, s, d: P.top_movers(*_reporting(s, d), p, t)),
    "product_price_rollup": lambda s, d: P.product_prices(T.products(s, d), T.matches(s, d), T.listings(s, d)),
    "product_trend": _q(lambda p, t, s, d: P.product_trend(T.matches(s, d), T.listings(s, d), p, t, 365)),
    "recent_price_drops": _q(lambda p, t, s, d: P.recent_drops(T.listings(s, d), p, t, 30)),
    "price_change_log": lambda s, d: P.change_log(T.prices(s, d)),
    "price_anomalies": lambda s, d: P.anomalies(T.prices(s, d)),
    "price_pivot": lambda s, d: P.pivot_by_day(T.prices(s, d), T.listings(s, d), T.matches(s, d)).select("product_id", "day", F.explode("prices").alias("retailer_id", "price_pence")),
    "price_drop_events": lambda s, d: P.drop_events(T.prices(s, d)),
    "user_alerts": lambda s, d: P.user_alerts(P.drop_events(T.prices(s, d)), T.matches(s, d), T.alerts(s, d)),
    "price_history": lambda s, d: P.price_history(T.prices(s, d), T.listings(s, d), T.matches(s, d), 1),
    "price_history_all_products": lambda s, d: P.price_history(T.prices(s, d), T.listings(s, d), T.matches(s, d)),
    "price_chart": lambda s, d: P.chart_points(T.prices(s, d), 100.0, 40.0),
}

_AGG = "count(*) AS n, CAST(sum(price_pence) AS BIGINT) AS s, CAST(sum(price_pence * price_pence) AS BIGINT) AS q, min(price_pence) AS lo, max(price_pence) AS hi"
_SD = "CASE WHEN n < 2 THEN 0.0::DOUBLE ELSE floor(sqrt(CAST(q - 2 * m * s + n * m * m AS DOUBLE) / (n - 1)) * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE END"
_STATS = f"m AS average_price_pence, lo AS min_price_pence, hi AS max_price_pence, hi - lo AS price_range_pence, {_SD} AS standard_deviation, n AS price_count"
_ORDER = "recorded_at, id, price_pence"
_SALES = "SELECT p.* FROM prices p, now_ WHERE recorded_at >= t - INTERVAL 365 DAY AND price_pence < original_price_pence"
_TREND = f"""SELECT listing_id, a AS start_price_pence, b AS end_price_pence, c AS change_percentage,
 CASE WHEN CASE WHEN m > 0 THEN sd / m * 100 ELSE 0.0 END > 15 THEN 'volatile' WHEN abs(c) <= 2 THEN 'stable' WHEN c > 0 THEN 'rising' ELSE 'falling' END AS indicator
 FROM (SELECT *, {_SD} AS sd, CASE WHEN a = 0 THEN 0.0::DOUBLE ELSE {ratio("(b - a) * 100", "a", 2)} END AS c FROM (SELECT *, {mean("s", "n")} AS m FROM (
 SELECT listing_id, {_AGG}, arg_min(price_pence, (recorded_at, id, price_pence)) AS a, arg_max(price_pence, (recorded_at, id, price_pence)) AS b FROM prices, now_ WHERE recorded_at >= t - INTERVAL 365 DAY GROUP BY 1)))"""
_PATTERN = f"""SELECT *, CASE WHEN n * 30 >= 4 * 365 THEN 'frequent' WHEN g <= 14 THEN 'bi_weekly' WHEN g <= 35 THEN 'monthly' ELSE 'occasional' END AS k FROM (
 SELECT listing_id, count(*) AS n, {mean("CAST(sum(d) AS BIGINT)", "count(*)")} AS a, max(recorded_at) AS last_sale,
 CASE WHEN count(*) > 1 THEN CAST(floor((epoch_us(max(recorded_at)) - epoch_us(min(recorded_at))) / 86400000000.0::DOUBLE / (count(*) - 1) + 0.5) AS BIGINT) END AS g
 FROM (SELECT *, CAST({ratio("(original_price_pence - price_pence) * 100", "original_price_pence")} AS BIGINT) AS d FROM sales) GROUP BY 1) WHERE n >= 2"""
_DAYS = """SELECT listing_id, string_agg(weekday, ',' ORDER BY r) AS recommended_days FROM (
 SELECT *, row_number() OVER (PARTITION BY listing_id ORDER BY n DESC, f, weekday) AS r, sum(n) OVER (PARTITION BY listing_id) AS total FROM (
 SELECT listing_id, dayname(recorded_at) AS weekday, count(*) AS n, min(recorded_at) AS f FROM sales GROUP BY 1, 2)) WHERE total >= 3 AND r <= 2 GROUP BY 1"""
_CHANGES = f"""SELECT l.id AS listing_id, title, l.price_pence AS current_price_pence, previous_price_pence, {ratio("(l.price_pence - previous_price_pence) * 100", "previous_price_pence", 2)} AS change_percentage
 FROM listings l JOIN (SELECT listing_id, arg_max(price_pence, (recorded_at, id, price_pence)) AS previous_price_pence FROM prices, now_ WHERE recorded_at < t - INTERVAL 7 DAY GROUP BY 1) b ON l.id = b.listing_id WHERE previous_price_pence <> 0"""
_KINDS = "SELECT DISTINCT listing_id AS id, canonical_category FROM matches m JOIN products p ON m.product_id = p.id"
_DROPS = f"""SELECT * FROM (SELECT listing_id, id, recorded_at AS dropped_at, b AS old_price_pence, price_pence AS new_price_pence, {ratio("(b - price_pence) * 100", "b", 2)} AS drop_percentage
 FROM (SELECT *, lag(price_pence) OVER (PARTITION BY listing_id ORDER BY {_ORDER}) AS b FROM prices) WHERE price_pence < b) WHERE drop_percentage >= 20"""

ORACLE_SQL = {
    "price_statistics": sql("prices now_", f" SELECT listing_id, {_STATS} FROM (SELECT *, {mean('s', 'n')} AS m FROM (SELECT listing_id, {_AGG} FROM prices, now_ WHERE recorded_at >= t - INTERVAL 90 DAY GROUP BY 1))"),
    "average_price": sql("prices now_", f" SELECT listing_id, {mean('CAST(sum(price_pence) AS BIGINT)', 'count(*)')} AS average_price_pence FROM prices, now_ WHERE recorded_at >= t - INTERVAL 30 DAY GROUP BY 1"),
    "price_statistics_multi": sql("prices now_", f""" SELECT listing_id, days, {_STATS} FROM (SELECT *, {mean("s", "n")} AS m FROM (SELECT listing_id, days, {_AGG}
        FROM prices, now_, (VALUES (7), (30), (90)) v(days) WHERE recorded_at >= t - to_days(days) GROUP BY 1, 2))"""),
    "price_trend": sql("prices now_", " " + _TREND),
    "sale_pattern": sql("prices now_", f""", sales AS ({_SALES}) SELECT listing_id, k AS pattern_type, a AS average_discount, g AS sale_frequency_days, n AS sale_count, n AS sale_dates,
        CASE k WHEN 'frequent' THEN 'Frequently on sale ' WHEN 'bi_weekly' THEN 'Sales roughly every 2 weeks ' WHEN 'monthly' THEN 'Monthly sales pattern ' ELSE 'Occasional sales approximately every ' || g || ' days ' END
        || 'with an average ' || a || '% discount' AS description FROM ({_PATTERN})"""),
    "sale_weekdays": sql("prices now_", f", sales AS ({_SALES}) {_DAYS}"),
    "best_time_to_buy": sql("prices listings now_", f""", sales AS ({_SALES}), r AS (SELECT l.id AS listing_id, l.price_pence AS p, coalesce(l.price_pence < l.original_price_pence, false) AS o, coalesce(m, l.price_pence) AS a, coalesce(lo, l.price_pence) AS lo,
        CASE WHEN NOT coalesce(l.price_pence < l.original_price_pence, false) AND g > 0 THEN greatest(0, CAST(floor(g - (epoch_us(t) - epoch_us(last_sale)) / 86400000000.0::DOUBLE) AS BIGINT)) END AS e, coalesce(recommended_days, '') AS recommended_days
        FROM listings l JOIN now_ ON true LEFT JOIN (SELECT listing_id, {mean("CAST(sum(price_pence) AS BIGINT)", "count(*)")} AS m, min(price_pence) AS lo FROM prices, now_ WHERE recorded_at >= t - INTERVAL 365 DAY GROUP BY 1) s ON s.listing_id = l.id
        LEFT JOIN ({_PATTERN}) k ON k.listing_id = l.id LEFT JOIN ({_DAYS}) y ON y.listing_id = l.id),
        w AS (SELECT *, coalesce(CAST(CAST({ratio("(a - p) * 100", "a")} AS BIGINT) AS VARCHAR), '0') AS sv, CAST(CAST({ratio("(p - a) * 100", "a")} AS BIGINT) AS VARCHAR) AS ov FROM r)
        SELECT listing_id, o AS is_on_sale, p AS current_price_pence, a AS average_price_pence, lo AS lowest_price_pence, e AS expected_days_until_sale, recommended_days,
        CASE WHEN o AND a > 0 THEN {ratio("(a - p) * 100", "a", 1)} END AS savings_percent,
        CASE WHEN o AND p <= lo THEN 'Excellent time to buy! This is the lowest price recorded. You''re saving approximately ' || sv || '% compared to the average price.'
        WHEN o THEN 'Good time to buy! The product is currently on sale, saving approximately ' || sv || '% compared to the average price.'
        WHEN p > a AND e <= 7 THEN 'Consider waiting. The price is ' || ov || '% above average and a sale may occur within ' || e || ' days.'
        WHEN p > a THEN 'Current price is ' || ov || '% above average. Consider waiting for a sale if possible.'
        WHEN e <= 3 THEN 'A sale may be coming soon (estimated ' || e || ' days). Consider waiting for better prices.'
        ELSE 'Current price is near or below average. Reasonable time to purchase.' END AS recommendation FROM w"""),
    "price_as_of": sql("prices now_", " SELECT listing_id, arg_max(price_pence, (recorded_at, id, price_pence)) AS previous_price_pence FROM prices, now_ WHERE recorded_at < t - INTERVAL 7 DAY GROUP BY 1"),
    "category_weekly_report": sql("prices listings products matches now_", f""", c AS ({_CHANGES}), g AS (SELECT canonical_category, count(l.price_pence) AS n, CAST(sum(l.price_pence) AS BIGINT) AS s, min(l.price_pence) AS lo, max(l.price_pence) AS hi,
        count(*) FILTER (l.price_pence < l.original_price_pence) AS sale, count(change_percentage) AS cn, CAST(sum(CAST(round(change_percentage * 100) AS BIGINT)) AS BIGINT) AS cs
        FROM listings l JOIN ({_KINDS}) k USING (id) LEFT JOIN c ON c.listing_id = l.id GROUP BY 1)
        SELECT v.canonical_category, coalesce(n, 0) AS product_count, coalesce({mean("s", "n")}, 0) AS average_price_pence, coalesce(lo, 0) AS min_price_pence, coalesce(hi, 0) AS max_price_pence, coalesce(sale, 0) AS on_sale_count,
        coalesce({ratio("sale * 100", "n", 1)}, 0.0::DOUBLE) AS on_sale_percentage, coalesce(({ratio("cs", "cn")}) / 100, 0.0::DOUBLE) AS average_change_percentage
        FROM (VALUES ('dry_food'), ('wet_food'), ('treats'), ('dental'), ('puppy_food'), ('senior_food'), ('other')) v(canonical_category) LEFT JOIN g USING (canonical_category)"""),
    "category_top_movers": sql("prices listings products matches now_", f""", c AS ({_CHANGES}) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY canonical_category, direction ORDER BY abs(change_percentage) DESC, listing_id) AS rank
        FROM (SELECT c.*, canonical_category, CASE WHEN change_percentage < 0 THEN 'drop' ELSE 'rise' END AS direction FROM c JOIN ({_KINDS}) k ON k.id = c.listing_id WHERE change_percentage <> 0)) WHERE rank <= 5"""),
    "product_price_rollup": sql("listings products matches", f""" SELECT p.id, coalesce(lo, lowest_price_pence) AS lowest_price_pence, a AS average_price_pence FROM products p LEFT JOIN (
        SELECT product_id, min(price_pence) AS lo, {mean("CAST(sum(price_pence) AS BIGINT)", "count(*)")} AS a FROM matches m JOIN listings l ON l.id = m.listing_id WHERE in_stock GROUP BY 1) g ON g.product_id = p.id"""),
    "product_trend": sql("prices listings matches now_", f""" SELECT product_id, x.* FROM (SELECT product_id, arg_min(listing_id, (price_pence, listing_id)) AS listing_id FROM matches m JOIN listings l ON l.id = m.listing_id GROUP BY 1) JOIN ({_TREND}) x USING (listing_id)"""),
    "recent_price_drops": sql("prices listings now_", f""" SELECT listing_id, price_pence, previous_price_pence, title, {ratio("(previous_price_pence - price_pence) * 100", "previous_price_pence", 1)} AS drop_percentage FROM (
        SELECT listing_id, recorded_at, price_pence, lead(price_pence) OVER w AS previous_price_pence, row_number() OVER w AS r FROM prices WINDOW w AS (PARTITION BY listing_id ORDER BY recorded_at DESC, id DESC, price_pence DESC)) x
        JOIN (SELECT id, title FROM listings WHERE in_stock) l ON l.id = listing_id, now_ WHERE r = 1 AND recorded_at >= t - INTERVAL 30 DAY AND price_pence < previous_price_pence ORDER BY drop_percentage DESC, listing_id LIMIT 8"""),
    "price_change_log": sql("prices", f" SELECT * EXCLUDE (b) FROM (SELECT *, lag(price_pence) OVER (PARTITION BY listing_id ORDER BY {_ORDER}) AS b FROM prices) WHERE b IS NULL OR b <> price_pence"),
    "price_anomalies": sql("prices", " SELECT a.listing_id, count(*) AS anomalies FROM prices a JOIN prices b ON a.listing_id = b.listing_id AND a.recorded_at < b.recorded_at WHERE a.price_pence > 0 AND abs(b.price_pence - a.price_pence) * 100 > a.price_pence * 50 GROUP BY 1"),
    "price_pivot": sql("prices listings matches", """ SELECT product_id, CAST(recorded_at AS DATE) AS day, retailer_id, arg_min(p.price_pence, (-l.price_pence, -l.id, recorded_at, p.id, p.price_pence)) AS price_pence
        FROM prices p JOIN listings l ON l.id = p.listing_id JOIN matches m ON m.listing_id = l.id WHERE in_stock GROUP BY 1, 2, 3"""),
    "price_drop_events": sql("prices", " " + _DROPS),
    "user_alerts": sql("prices matches alerts", f""" SELECT user_id, product_id, listing_id, d.id, dropped_at, new_price_pence, target_price_pence FROM ({_DROPS}) d JOIN matches USING (listing_id) JOIN alerts USING (product_id)
        WHERE is_active AND target_price_pence >= new_price_pence AND (last_notified_at IS NULL OR last_notified_at < dropped_at - INTERVAL 24 HOUR)"""),
    "price_history": sql("prices listings matches", " SELECT p.*, retailer_id FROM prices p JOIN listings l ON l.id = p.listing_id WHERE listing_id IN (SELECT listing_id FROM matches WHERE product_id = 1)"),
    "price_history_all_products": sql("prices listings matches", " SELECT p.*, product_id, retailer_id FROM prices p JOIN listings l ON l.id = p.listing_id JOIN (SELECT DISTINCT listing_id, product_id FROM matches) m ON m.listing_id = p.listing_id"),
    "price_chart": sql("prices", """ SELECT listing_id, recorded_at, price_pence, CASE WHEN n > 1 THEN i / (n - 1) * 100.0::DOUBLE ELSE 0.0 END AS x, CASE WHEN hi > lo THEN 40.0::DOUBLE - (price_pence - lo) / (hi - lo) * 40.0::DOUBLE ELSE 20.0 END AS y
        FROM (SELECT *, count(*) OVER p AS n, row_number() OVER (PARTITION BY listing_id ORDER BY recorded_at, id, price_pence) - 1 AS i, min(price_pence) OVER p AS lo, max(price_pence) OVER p AS hi FROM prices WINDOW p AS (PARTITION BY listing_id))"""),
}
