"""Queries over crawl events, in batch and as streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from quayside.operators import events as E
from quayside.operators import monitoring as M
from quayside.operators import prices as P
from quayside.operators.prices import latest
from quayside.plans.base import mean, ratio, sql
from quayside.sources import tables as T
from quayside.streaming import jobs as S


def _stream(spark, sf_dir, name, shape):
    """A table read as a stream, in the shape of its batch twin. The schema comes from the files."""
    static = T.scan(spark, sf_dir, name)
    stream = S.read(spark, f"{sf_dir}/{name}.parquet*", static.schema)
    return shape(stream)


_NAMES = {"view": "started", "click": "discovered", "signup": "completed", "purchase": "completed", "error": "failed"}


def _crawl_stream(spark, sf_dir):
    rows = _stream(spark, sf_dir, "events", lambda s: s.select(*T.EVENT_COLUMNS(_NAMES)))
    return rows.withColumn("created_at", F.col("created_at").cast("timestamp"))


def _price_stream(spark, sf_dir):
    return _stream(spark, sf_dir, "lineitem", T.price_columns).withColumn("recorded_at", F.col("recorded_at").cast("timestamp"))


def _discovered(rows):
    """Each discovery's listing, the address being that of one of forty pages of its crawl."""
    return rows.where("event = 'discovered'").select("id", "created_at", "retailer", F.concat(F.lit("/p/"), (F.col("crawl_id") % 40).cast("string")).alias("url"))


def _follow_ups(spark, sf_dir):
    """The listings that ask for their details to be fetched: the first discovery of each, from the stream."""
    return S.run_available(S.first_seen(_discovered(_crawl_stream(spark, sf_dir)), ["retailer", "url"], "60 days").select("retailer", "url"))


def _alerted(spark, sf_dir):
    drops = S.run_available(S.price_drops(_price_stream(spark, sf_dir)))
    again = S.read(spark, drops.inputFiles()[0].rsplit("/out/", 1)[0] + "/out/*", drops.schema)
    return S.run_available(S.user_alerts(again, T.matches(spark, sf_dir), T.alerts(spark, sf_dir)))


def _now(spark, sf_dir):
    return latest(T.scan(spark, sf_dir, "events"), "ts")


QUERIES = {
    "crawl_state": lambda s, d: E.crawl_state(T.crawl_events(s, d)),
    "daily_crawl_stats": lambda s, d: E.daily_statistics(T.crawl_events(s, d)),
    "running_average": lambda s, d: E.running_average(T.crawl_events(s, d)),
    "sliding_failure_rate": lambda s, d: E.sliding_failure_rate(T.crawl_events(s, d), 600),
    "failure_streaks": lambda s, d: E.failure_streaks(T.crawl_events(s, d)),
    "failure_sessions": lambda s, d: E.failure_sessions(T.crawl_events(s, d), 600),
    "health_metrics": lambda s, d: E.health(T.crawl_events(s, d)),
    "event_enrichment": lambda s, d: E.started_of(T.crawl_events(s, d)),
    "daily_chart_gapfilled": lambda s, d: M.daily_chart(E.daily_statistics(T.crawl_events(s, d).where("retailer = 'retailer-3'")), _now(s, d)),
    "daily_chart_all_retailers": lambda s, d: M.daily_chart(E.daily_statistics(T.crawl_events(s, d)), _now(s, d)),
    "success_rates": lambda s, d: M.success_rates(E.daily_statistics(T.crawl_events(s, d))),
    "today_totals": lambda s, d: M.queue_totals(T.crawl_events(s, d), _now(s, d)),
    "stream_daily_stats": lambda s, d: S.run_available(S.daily_statistics(_crawl_stream(s, d)), "complete"),
    "stream_failure_sessions": lambda s, d: S.run_available(S.failure_sessions(_crawl_stream(s, d)), "complete"),
    "stream_price_drops": lambda s, d: S.run_available(S.price_drops(_price_stream(s, d))),
    "stream_circuits": lambda s, d: S.run_available(S.circuits(_crawl_stream(s, d))),
    "stream_health": lambda s, d: S.run_available(S.health_changes(_crawl_stream(s, d))),
    "stream_enrichment": lambda s, d: S.run_available(S.enriched_outcomes(_crawl_stream(s, d))),
    "stream_follow_ups": _follow_ups,
    "stream_user_alerts": _alerted,
    "alerts_with_cooldown": lambda s, d: P.alerts_with_cooldown(P.drop_events(T.prices(s, d)), T.matches(s, d), T.alerts(s, d)),
    "listings_first_seen": lambda s, d: E.new_listings(_discovered(T.crawl_events(s, d))),
    "stream_crawl_rejects": lambda s, d: S.run_available(S.crawl_rejects(_crawl_stream(s, d))),
}

_DAILY = f"""SELECT retailer, CAST(created_at AS DATE) AS day, count(*) FILTER (event = 'started') AS started, count(*) FILTER (event = 'completed') AS completed, count(*) FILTER (event = 'failed') AS failed, count(*) FILTER (event = 'discovered') AS discovered,
 CASE WHEN count(*) FILTER (event = 'completed') > 0 THEN {mean("CAST(sum(duration_ms) FILTER (event = 'completed') AS BIGINT)", "count(*) FILTER (event = 'completed')")} END AS average_duration_ms FROM crawl GROUP BY 1, 2"""
_STREAKS = """SELECT retailer, id, created_at, event, count(*) FILTER (event = 'failed') OVER (PARTITION BY retailer, island ORDER BY created_at, id ROWS UNBOUNDED PRECEDING) AS f FROM (
 SELECT *, count(*) FILTER (event = 'completed') OVER (PARTITION BY retailer ORDER BY created_at, id ROWS UNBOUNDED PRECEDING) AS island FROM crawl WHERE event IN ('completed', 'failed'))"""
_STATUS = "CASE WHEN f >= 10 THEN 'failed' WHEN f >= 5 THEN 'degraded' ELSE 'active' END"
_STATE = """marks AS (SELECT crawl_id, min((created_at, id)) FILTER (event = 'failed') AS f, min((created_at, id)) FILTER (event = 'completed') AS c FROM crawl GROUP BY 1),
 r AS (SELECT e.*, f IS NOT NULL AND (c IS NULL OR f < c) AS ff, c, coalesce(f IS NOT NULL AND (c IS NULL OR f < c) AND (created_at, id) > f, false) AS after FROM crawl e JOIN marks USING (crawl_id))"""


def _sessions(minutes: int) -> str:
    return f"""SELECT retailer, min(created_at) AS first_failure_at, max(created_at) AS last_failure_at, count(*) AS failures FROM (SELECT *, sum(b) OVER (PARTITION BY retailer ORDER BY created_at, id) AS s FROM (
     SELECT *, CASE WHEN lag(created_at) OVER (PARTITION BY retailer ORDER BY created_at, id) + INTERVAL {minutes} MINUTE >= created_at THEN 0 ELSE 1 END AS b FROM crawl WHERE event = 'failed')) GROUP BY retailer, s"""


def _window(span: str) -> str:
    return f"(PARTITION BY retailer ORDER BY created_at RANGE BETWEEN INTERVAL {span} PRECEDING AND CURRENT ROW)"


# streams fold what their watermark has passed
_PASSED = "created_at <= (SELECT max(created_at) - INTERVAL 1 HOUR FROM crawl)"
_OUTCOMES_PASSED = "created_at <= (SELECT max(created_at) - INTERVAL 1 HOUR FROM crawl WHERE event IN ('completed', 'failed'))"
_BEHIND = " AND recorded_at <= (SELECT max(recorded_at) - INTERVAL 1 DAY FROM prices)"
_DROPS = f"SELECT listing_id, id, recorded_at AS dropped_at, b AS old_price_pence, price_pence AS new_price_pence FROM (SELECT *, lag(price_pence) OVER (PARTITION BY listing_id ORDER BY recorded_at, id, price_pence) AS b FROM prices) WHERE price_pence < b AND (b - price_pence) * 100 >= b * 20{_BEHIND}"
_RECENT = "list_append(list_filter(s.t, lambda y: y.us >= x.us - INTERVAL 60 MINUTE), x)"
_OPENS = f"s.until <= x.us AND len({_RECENT}) >= 3 AND len(list_filter({_RECENT}, lambda y: y.bad)) * 100 >= len({_RECENT}) * 50"
_CIRCUIT = f"""{{'t': {_RECENT}, 'until': CASE WHEN {_OPENS} THEN x.us + INTERVAL 30 MINUTE ELSE s.until END,
    'out': CASE WHEN {_OPENS} THEN list_append(s.out, {{'opened_at': x.us, 'n': len({_RECENT})::INT, 'failed': len(list_filter({_RECENT}, lambda y: y.bad))::INT}}) ELSE s.out END}}"""
_WANTED = "CASE WHEN s.c + 1 >= 10 THEN 'failed' WHEN s.c + 1 >= 5 THEN 'degraded' ELSE 'active' END"
_REFUSED = f"(s.status = 'failed' AND {_WANTED} <> 'failed')"
_PAUSES = f"({_WANTED} = 'failed' AND (s.until IS NULL OR s.until <= x.us))"
_NOTE = "list_append(s.out, {'changed_at': x.us, 'status': %s, 'consecutive_failures': %s, 'paused_until': %s, 'refused': %s})"
_UNTIL = f"CASE WHEN {_PAUSES} THEN x.us + INTERVAL 60 MINUTE ELSE s.until END"
_HEALTH = f"""CASE WHEN NOT x.bad THEN {{'c': 0, 'status': 'active', 'until': NULL::TIMESTAMP, 'out': CASE WHEN s.status <> 'active' THEN {_NOTE % ("'active'", "0", "NULL::TIMESTAMP", "false")} ELSE s.out END}}
    WHEN {_REFUSED} THEN {{'c': s.c + 1, 'status': s.status, 'until': s.until, 'out': {_NOTE % ("s.status", "s.c + 1", "s.until", "true")}}}
    ELSE {{'c': s.c + 1, 'status': {_WANTED}, 'until': {_UNTIL}, 'out': CASE WHEN {_WANTED} <> s.status OR {_PAUSES} THEN {_NOTE % (_WANTED, "s.c + 1", _UNTIL, "false")} ELSE s.out END}} END"""
#: Of a user's and product's hits in order, those more than a day after the last that counted.
_HITS = """hits AS (SELECT a.user_id, m.product_id, d.listing_id, d.id, d.dropped_at, d.new_price_pence, a.target_price_pence, a.last_notified_at FROM drops d JOIN matches m USING (listing_id) JOIN alerts a USING (product_id)
      WHERE is_active AND target_price_pence >= new_price_pence)"""
_COOLED = """SELECT user_id, product_id, unnest(s.out, recursive := true) FROM (SELECT user_id, product_id, list_reduce(list({'at': dropped_at, 'last': last_notified_at, 'row': {'listing_id': listing_id, 'id': id, 'dropped_at': dropped_at, 'new_price_pence': new_price_pence, 'target_price_pence': target_price_pence}} ORDER BY dropped_at, listing_id, id),
      lambda s, x: CASE WHEN greatest(s.last, x.last) IS NULL OR greatest(s.last, x.last) < x.at - INTERVAL 24 HOUR THEN {'last': x.at, 'out': list_append(s.out, x.row)} ELSE s END,
      {'last': NULL::TIMESTAMP, 'out': []::STRUCT(listing_id BIGINT, id BIGINT, dropped_at TIMESTAMP, new_price_pence BIGINT, target_price_pence BIGINT)[]}) AS s FROM hits GROUP BY 1, 2)"""

ORACLE_SQL = {
    "crawl_state": sql("crawl", f", {_STATE} SELECT crawl_id, CASE WHEN bool_or(ff) THEN 'failed' WHEN bool_or(c IS NOT NULL) THEN 'completed' ELSE 'running' END AS state, count(*) FILTER (event = 'discovered' AND NOT after) AS listings_discovered, count(*) FILTER (event IN ('discovered', 'completed') AND after) AS rejected FROM r GROUP BY 1"),
    "daily_crawl_stats": sql("crawl", " " + _DAILY),
    "sliding_failure_rate": sql("crawl", f""" SELECT *, {ratio("failed * 100", "n", 2)} AS failure_rate, n >= 3 AND failed * 100 >= n * 50 AS opens FROM (SELECT retailer, id, created_at, count(*) OVER w AS n, count(*) FILTER (event = 'failed') OVER w AS failed
        FROM crawl WHERE event IN ('completed', 'failed') WINDOW w AS {_window("600 MINUTE")})"""),
    "failure_streaks": sql("crawl", f" SELECT retailer, id, created_at, event, f AS consecutive_failures, {_STATUS} AS status FROM ({_STREAKS})"),
    "failure_sessions": sql("crawl", f" SELECT retailer, first_failure_at, failures, greatest(failures - 2, 0) AS alerts FROM ({_sessions(600)})"),
    "health_metrics": sql("crawl", f""" SELECT retailer, id, {ratio("k * 100", "n", 2)} AS success_rate, ({ratio("total", "k * 10")}) / 100 AS average_seconds, last_success_at FROM (SELECT retailer, id, count(*) OVER w AS n, count(*) FILTER (event = 'completed') OVER w AS k,
        CAST(sum(CASE WHEN event = 'completed' THEN duration_ms END) OVER w AS BIGINT) AS total, max(CASE WHEN event = 'completed' THEN created_at END) OVER w AS last_success_at FROM crawl WHERE event IN ('completed', 'failed') WINDOW w AS {_window("24 HOUR")})"""),
    "event_enrichment": sql("crawl", " SELECT c.crawl_id, id, event, created_at, started_at FROM crawl c LEFT JOIN (SELECT crawl_id, min(created_at) AS started_at FROM crawl WHERE event = 'started' GROUP BY 1) s ON s.crawl_id = c.crawl_id WHERE event IN ('completed', 'failed')"),
    "daily_chart_gapfilled": sql("crawl", f""", s AS ({_DAILY}), n AS (SELECT CAST(max(ts) AS DATE) AS t FROM events) SELECT CAST(g.d AS DATE) AS day, coalesce(started, 0) AS started, coalesce(completed, 0) AS completed, coalesce(failed, 0) AS failed
        FROM (SELECT unnest(generate_series(t - 29, t, INTERVAL 1 DAY)) AS d FROM n) g LEFT JOIN (SELECT * FROM s WHERE retailer = 'retailer-3') x ON x.day = CAST(g.d AS DATE)"""),
    "daily_chart_all_retailers": sql("crawl", f""", s AS ({_DAILY}), n AS (SELECT CAST(max(ts) AS DATE) AS t FROM events) SELECT CAST(g.d AS DATE) AS day, coalesce(started, 0) AS started, coalesce(completed, 0) AS completed, coalesce(failed, 0) AS failed
        FROM (SELECT unnest(generate_series(t - 29, t, INTERVAL 1 DAY)) AS d FROM n) g LEFT JOIN (SELECT day, sum(started) AS started, sum(completed) AS completed, sum(failed) AS failed FROM s GROUP BY 1) x ON x.day = CAST(g.d AS DATE)"""),
    "running_average": sql("crawl", """ SELECT retailer, CAST(created_at AS DATE) AS day, list_reduce(list({'n': 1::BIGINT, 'm': duration_ms} ORDER BY created_at, id),
        lambda a, x: {'n': a.n + 1, 'm': (2 * (a.m * a.n + x.m) + a.n + 1) // (2 * (a.n + 1))}).m AS running_average_ms FROM crawl WHERE event = 'completed' AND duration_ms IS NOT NULL GROUP BY 1, 2"""),
    "success_rates": sql("crawl", f" SELECT *, {ratio('completed * 100', 'completed + failed', 2)} AS success_rate FROM (SELECT retailer, count(*) FILTER (event = 'started') AS started, count(*) FILTER (event = 'completed') AS completed, count(*) FILTER (event = 'failed') AS failed, count(*) FILTER (event = 'discovered') AS discovered FROM crawl GROUP BY 1)"),
    "today_totals": sql("crawl", ", n AS (SELECT max(ts) AS t FROM events) SELECT event, count(*) AS total, count(*) FILTER (created_at >= t - INTERVAL 1 HOUR) AS last_hour, count(*) FILTER (created_at >= t - INTERVAL 24 HOUR) AS last_day FROM crawl, n GROUP BY 1"),
    "stream_daily_stats": sql("crawl", " " + _DAILY),
    "stream_failure_sessions": sql("crawl", f" SELECT retailer, first_failure_at, failures FROM ({_sessions(60)})"),
    "stream_price_drops": sql("prices", f" {_DROPS}"),
    "stream_circuits": sql("crawl", f""" SELECT retailer, unnest(s.out, recursive := true) FROM (SELECT retailer, list_reduce(list({{'us': created_at, 'bad': event = 'failed'}} ORDER BY created_at, id, event),
        lambda s, x: CASE WHEN s.until > x.us AND NOT x.bad THEN {{'t': []::STRUCT(us TIMESTAMP, bad BOOLEAN)[], 'until': TIMESTAMP '1970-01-01', 'out': s.out}} ELSE
          {_CIRCUIT} END, {{'t': []::STRUCT(us TIMESTAMP, bad BOOLEAN)[], 'until': TIMESTAMP '1970-01-01', 'out': []::STRUCT(opened_at TIMESTAMP, n INT, failed INT)[]}}) AS s
        FROM crawl WHERE event IN ('completed', 'failed') AND {_OUTCOMES_PASSED} GROUP BY retailer)"""),
    "stream_health": sql("crawl", f""" SELECT retailer, unnest(s.out, recursive := true) FROM (SELECT retailer, list_reduce(list({{'us': created_at, 'bad': event = 'failed'}} ORDER BY created_at, id, event), lambda s, x: {_HEALTH},
        {{'c': 0, 'status': 'active', 'until': NULL::TIMESTAMP, 'out': []::STRUCT(changed_at TIMESTAMP, status VARCHAR, consecutive_failures INT, paused_until TIMESTAMP, refused BOOLEAN)[]}}) AS s
        FROM crawl WHERE event IN ('completed', 'failed') AND {_OUTCOMES_PASSED} GROUP BY retailer)"""),
    "stream_enrichment": sql("crawl", """ SELECT c.crawl_id, c.id, c.event, c.created_at, s.created_at AS started_at, s.retailer FROM crawl c LEFT JOIN crawl s ON s.crawl_id = c.crawl_id AND s.event = 'started' AND s.created_at <= c.created_at AND s.created_at >= c.created_at - INTERVAL 1 DAY
        WHERE c.event IN ('completed', 'failed') AND (s.id IS NOT NULL OR c.created_at < (SELECT max(created_at) - INTERVAL 1 HOUR FROM crawl))"""),
    "stream_follow_ups": sql("crawl", " SELECT DISTINCT retailer, '/p/' || (crawl_id % 40) AS url FROM crawl WHERE event = 'discovered'"),
    "stream_user_alerts": sql("prices matches alerts", f", drops AS ({_DROPS}), {_HITS} SELECT * FROM ({_COOLED}) WHERE dropped_at <= (SELECT max(dropped_at) - INTERVAL 1 DAY FROM hits)"),
    "alerts_with_cooldown": sql("prices matches alerts", f", drops AS ({_DROPS.replace(_BEHIND, '')}), {_HITS} {_COOLED}"),
    "listings_first_seen": sql("crawl", """ SELECT retailer, url, max_by(id, (created_at, id)) AS id, max(created_at) AS created_at, count(*) = 1 AS is_new FROM (SELECT *, '/p/' || (crawl_id % 40) AS url FROM crawl WHERE event = 'discovered') GROUP BY 1, 2"""),
    "stream_crawl_rejects": sql("crawl", f", {_STATE} SELECT crawl_id, id, event FROM r WHERE event IN ('discovered', 'completed') AND after AND {_PASSED}"),
}
