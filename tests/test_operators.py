"""Operators on small tables, empty ones too."""

import datetime as dt
import random

from pyspark.sql import functions as F

from quayside.functions.similarity import title_similarity
from quayside.operators import alike, events, matching, prices, updates
from quayside.sources import exports
from quayside.sources.tables import SCHEMAS

NOW = dt.datetime(2024, 6, 30)
PRICES = SCHEMAS["prices"]


def table(spark, *observations):
    """Of (price, original, days ago)."""
    rows = [(1, k, NOW - dt.timedelta(days=ago), price, original) for k, (price, original, ago) in enumerate(observations)]
    return spark.createDataFrame(rows, PRICES)


def now():
    return F.lit(NOW)


def test_statistics(spark):
    got = prices.statistics(table(spark, (800, None, 6), (1000, None, 4), (1200, None, 2), (1000, None, 1)), now(), 7).first()
    assert (got.average_price_pence, got.min_price_pence, got.max_price_pence, got.price_range_pence, got.price_count, got.standard_deviation) == (1000, 800, 1200, 400, 4, 163.3)


def test_trends(spark):
    rising = prices.trend(table(spark, (1000, None, 6), (1100, None, 4), (1200, None, 2), (1300, None, 1)), now(), 30).first()
    assert (rising.indicator, rising.change_percentage) == ("rising", 30.0)
    assert prices.trend(table(spark, (800, None, 6), (1400, None, 4), (600, None, 2), (1200, None, 1)), now(), 30).first().indicator == "volatile"


def test_sale_pattern(spark):
    got = prices.sale_pattern(table(spark, (700, 1000, 60), (600, 1000, 30), (500, 1000, 1)), now()).first()
    assert (got.average_discount, got.sale_count) == (40, 3)
    assert prices.sale_pattern(table(spark, (700, 1000, 60)), now()).count() == 0


def test_anomalies_count_all_pairs(spark):
    assert prices.anomalies(table(spark, (1000, None, 2), (400, None, 1))).first().anomalies == 1
    assert prices.anomalies(table(spark, (1000, None, 2), (900, None, 1))).count() == 0


def test_empty_tables(spark):
    empty = table(spark)
    assert prices.statistics(empty, prices.latest(empty), 7).count() == 0
    assert prices.trend(empty, prices.latest(empty), 7).count() == 0
    assert prices.change_log(empty).count() == 0
    assert events.crawl_state(spark.createDataFrame([], SCHEMAS["events"])).count() == 0


def test_matching(spark):
    kinds = "id long, {} string, brand string, category string, weight_grams long, quantity int"
    products = spark.createDataFrame([(7, "Dry Chicken", "Acme", "Kibble", 2000, 1), (8, "Dry Chicken", "Other", "Kibble", 2000, 1)], kinds.format("name"))
    listings = spark.createDataFrame([(1, "Dry Chicken 2kg", "acme", "Kibble", 2000, 1), (2, "Dry Chicken", "acme", "Kibble", 5000, 1), (3, "Cat Litter", "acme", None, None, None)], kinds.format("title"))
    best = {r.listing_id: r for r in matching.best(matching.candidates(listings, products)).collect()}
    assert (best[1].product_id, float(best[1].confidence_score), best[1].match_type) == (7, 100.0, "exact")
    assert float(best[2].confidence_score) == 88.0
    assert 3 not in best
    # a pair of the same title is exact, although one of another title has more points
    close = spark.createDataFrame([(20, "crunchy lamb supper", "Acme", "Kibble", 2000, None), (21, "crunchy lamb zupper", "Acme", "Kibble", 2000, 1)], kinds.format("name"))
    asked = spark.createDataFrame([(4, "crunchy lamb supper", "Acme", None, 2000, 1), (5, "crunchy lamb dry food", "Acme", None, 2000, 1)], kinds.format("title"))
    found = {r.listing_id: r for r in matching.candidates(asked, close.withColumn("canonical_category", F.lit("other"))).transform(matching.best).collect()}
    assert (found[4].product_id, found[4].match_type) == (20, "exact")
    none = spark.createDataFrame([], "listing_id long")
    assert {(r.listing_id, r.is_new) for r in matching.match(listings, products, none).collect()} == {(1, False), (2, False), (3, True)}


def compared(a, b):
    """All pairs of prepared rows whose titles reach 70 percent, by comparing each with each."""
    rows = a.crossJoin(b).withColumn("similarity", title_similarity(F.col("l_title"), F.col("p_title")))
    return matching.rated(rows.where("similarity >= 70"))


def test_matching_meets_all_brands(spark):
    """Against all pairs: different and missing brands, misspelt, empty and null titles, letters that come often."""
    kinds = "id long, {} string, brand string, category string, weight_grams long, quantity int"
    names = ["Dry Chicken", "Dry Chickn", "Chicken Dry Feast", "beef stew", "beefstew", "bef stw", "", None, "eeeeeeeeee", "eeeeeeeee", "12345", "a b c d e f", "kg"]
    rows = [(10 * k + j, n, brand, category, weight, quantity) for k, n in enumerate(names) for j, (brand, category, weight, quantity) in enumerate([("Acme", "Kibble", 2000, 1), ("Other", "Kibble", 2000, None), (None, "Kibble", None, 1), ("", None, 5000, 2)])]
    listings, products = spark.createDataFrame(rows, kinds.format("title")), spark.createDataFrame(rows, kinds.format("name"))
    a, b = matching.prepared(listings, "l_", "title"), matching.prepared(products, "p_", "name")
    every = compared(a, b).where("confidence >= 70")
    key = lambda df: sorted((r.listing_id, r.product_id, round(r.confidence, 6), r.same_category) for r in df.collect())
    assert key(matching.candidates(listings, products).where("confidence >= 70")) == key(every)
    got = {(r.listing_id, r.product_id) for r in every.collect()}
    assert {(0, 2), (2, 0), (2, 10), (22, 22)} <= got and (0, 3) not in got
    lone = spark.createDataFrame([(1, "Dry Chicken", None, "Kibble", 2000, 1)], kinds.format("title"))
    match = matching.match(lone, products, spark.createDataFrame([], "listing_id long")).first()
    assert (match.product_id, match.is_new) == (0, False)


def test_matching_of_other_brands_on_tables(spark):
    from quayside.sources import tables

    data = "/root/testdata/sf0.001"
    listings, products = tables.listings(spark, data), tables.products(spark, data)
    a, b = matching.prepared(listings, "l_", "title"), matching.prepared(products, "p_", "name")
    key = lambda df: sorted((r.listing_id, r.product_id, round(r.confidence, 6)) for r in df.where("confidence >= 70").collect())
    every = key(compared(a, b))
    assert key(matching.candidates(listings, products)) == every
    assert len(every) > len(key(compared(a, b.where("p_brand LIKE '%1%'"))))


def test_matching_normalises_names_and_not_rows(spark):
    """Titles, brands and categories are normalised above the aggregate that gives the distinct ones; no table's rows are broadcast for its small file."""
    kinds = "id long, {} string, brand string, category string, weight_grams long, quantity int"
    rows = [(k, f"Dry Chicken {k % 3}", "Acme", "Kibble", 2000, 1) for k in range(30)]
    listings, products = spark.createDataFrame(rows, kinds.format("title")), spark.createDataFrame(rows[:3], kinds.format("name"))
    pairs = matching.candidates(listings, products)
    lines = pairs._jdf.queryExecution().optimizedPlan().toString().splitlines()
    depth = [len(x) - len(x.lstrip(" :+-")) for x in lines]
    for at, line in enumerate(lines):
        if "regexp_replace(" in line:
            end = next((n for n in range(at + 1, len(lines)) if depth[n] <= depth[at]), len(lines))
            assert any("Aggregate [" in x for x in lines[at:end]), line
    assert sum("Join Inner" in x and "strategy=merge" in x for x in lines) == 2
    assert pairs.count() == 90


def test_match_finds_candidates_once(spark):
    kinds = "id long, {} string, brand string, category string, weight_grams long, quantity int"
    rows = [(9, "Cat Litter", None, None, None, None), (3, "cat litter", None, None, None, None), (4, "Cat Litter", "Acme", None, 500, None), (5, "Dry Chicken", "acme", "Kibble", 2000, 1), (6, "Dry Chicken", "acme", "Kibble", 2000, 1)]
    listings, products = spark.createDataFrame(rows, kinds.format("title")), spark.createDataFrame([(7, "Dry Chicken", "Acme", "Kibble", 2000, 1)], kinds.format("name"))
    out = matching.match(listings, products, spark.createDataFrame([(6,)], "listing_id long"))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
    assert sorted((r.listing_id, r.product_id, float(r.confidence_score), r.match_type, r.is_new) for r in out.collect()) == [(3, 3, 100.0, "exact", True), (4, 4, 100.0, "exact", True), (5, 7, 100.0, "exact", False), (9, 3, 100.0, "exact", True)]


def test_near_titles_lose_no_pair(spark):
    """Against all pairs, with titles of 0 to 60 characters that differ by some edits, for several thresholds."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7)))
    base = ["", "a", "aa", "ab", "aaaaaaa", "aaaaaab"] + [" ".join(word() for _ in range(rng.randint(1, 9))) for _ in range(40)]
    changed = lambda t: "".join(c for c in t if rng.random() > 0.12) + rng.choice(["", "x", " ab"])
    rows = [(rng.choice("xy"), t) for t in base] + [(rng.choice("xy"), changed(t)) for t in base * 2] + [(None, "ab"), ("x", None)]
    a, b = (spark.createDataFrame(r, "block string, title string") for r in (rows[::2] + rows[:9], rows[1::2] + rows[:30]))
    for least in (60.0, 70.0, 87.5):
        every = a.select("block", F.col("title").alias("l_title")).join(b.select("block", F.col("title").alias("p_title")), "block").distinct()
        wanted = {tuple(r)[:3] for r in every.where(title_similarity(F.col("l_title"), F.col("p_title")) >= least).collect()}
        got = [tuple(r) for r in alike.near_titles(a, b, least).collect()]
        assert wanted <= set(got) and len(got) == len(set(got)) and len(wanted) > 30
    assert alike.near_titles(a.limit(0), b, 70.0).count() == 0


def test_near_titles_meet_below_quadratic(spark):
    """Four times the titles, of a catalogue whose names grow with it: less than eight times the pairs are met."""
    def met(n):
        rng = random.Random(n)
        name = lambda: "".join(rng.choice("bcdfghklmnprstvw") + rng.choice("aeiou") for _ in range(rng.randint(2, 4)))
        names = [name() for _ in range(n)]
        rows = [("", " ".join(rng.sample(names, 2)) + rng.choice([" dry food", " wet food", " treats"])) for _ in range(n)]
        titles = spark.createDataFrame(rows, "block string, title string")
        return alike.meetings(titles, titles, 87.5).count()

    few, many = met(400), met(1600)
    assert many < 8 * few and many < 1600 * 1600 / 4


def test_whole_chart_and_history(spark):
    from quayside.plans.registry import QUERIES
    from quayside.sources import tables

    data = "/root/testdata/sf0.001"
    one, every = (QUERIES[f"daily_chart_{name}"](spark, data).agg(F.sum("completed")).first()[0] for name in ("gapfilled", "all_retailers"))
    assert every > one
    history = QUERIES["price_history_all_products"](spark, data).select("product_id").distinct()
    assert history.count() == tables.matches(spark, data).join(tables.prices(spark, data), "listing_id", "left_semi").select("product_id").distinct().count() > 1


def test_updates(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, t int")
    new = spark.createDataFrame([(1, "c", 1), (3, "d", 0), (2, "z", 0)], "k int, v string, t int")
    assert {tuple(r) for r in updates.upsert(old, new, ["k"], ["t"]).collect()} == {(1, "c", 1), (2, "b", 1), (3, "d", 0)}
    assert {tuple(r) for r in updates.changes(old, new, ["k"], ["v"]).collect()} == {(1, "updated"), (2, "updated"), (3, "created")}
    moves = spark.createDataFrame([("active", "paused"), ("paused", "failed"), ("failed", "failed"), ("disabled", "paused")], "a string, b string")
    assert [r.x for r in moves.select(updates.move_allowed(F.col("a"), F.col("b")).alias("x")).collect()] == [True, False, True, False]


def test_export(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a, b")], "id long, name string")
    log = exports.export(rows, str(tmp_path / "out"), "products", NOW).first()
    assert (log.status, log.row_count) == ("completed", 1)
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).first().name == "a, b"
    assert exports.export(rows, str(tmp_path / "out"), "products", NOW).first().status == "failed"


def test_user_alerts_meet_in_lists(spark, tmp_path):
    """As a plain loop over all pairs gives, and written in less than a byte and a half for a row of seven columns."""
    import datetime
    import random

    from quayside.operators import prices as P

    rnd, day = random.Random(6), datetime.datetime(2024, 1, 1)
    kinds = ("listing_id long, id long, dropped_at timestamp, new_price_pence long", "listing_id long, product_id long", "user_id long, product_id long, target_price_pence long, is_active boolean, last_notified_at timestamp")
    told, price = (None, day + datetime.timedelta(days=2), day + datetime.timedelta(days=3)), lambda: rnd.randrange(1, 100)
    drops = [(rnd.randrange(6), k, rnd.choice([None, *(day + datetime.timedelta(hours=12 * n) for n in range(12))]), price()) for k in range(90)]
    alerts = [(rnd.choice([None, u, u]), rnd.choice([None, 0, 1, 2]), rnd.choice([None, *range(1, 100)]), rnd.choice([None, False, True, True, True]), rnd.choice(told)) for u in range(160)] + [(1, 1, 50, True, None)] * 3
    matches = [(listing, listing % 4) for listing in range(6)] + [(1, 2), (1, 2), (2, None), (None, 1)]
    wait = datetime.timedelta(hours=24)
    want = [
        (a[0], p, listing, i, at, cost, a[2]) for listing, i, at, cost in drops for own, p in matches for a in alerts
        if own == listing and p is not None and a[1] == p and a[3] and a[2] is not None and a[2] >= cost and (a[4] is None or (at is not None and a[4] < at - wait))
    ]
    args = [spark.createDataFrame(rows, kind) for rows, kind in zip((drops, matches, alerts), kinds, strict=True)]
    assert want
    for more in ({}, {"users": 1}, {"users": 4}):
        out = P.user_alerts(*args, **more)
        assert sorted(map(repr, map(tuple, out.collect()))) == sorted(map(repr, want))

    drops = [(k % 500, k, day + datetime.timedelta(days=rnd.randrange(300)), rnd.randrange(100_000)) for k in range(1_500)]
    alerts = [(u, u % 5, rnd.randrange(100_000), True, None) for u in range(4_000)]
    args = [spark.createDataFrame(rows, kind) for rows, kind in zip((drops, [(k, k % 5) for k in range(500)], alerts), kinds, strict=True)]
    P.user_alerts(*args).write.parquet(out := str(tmp_path / "out"))
    size = sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet"))
    assert size < 1.5 * spark.read.parquet(out).count()


def test_alerts_with_cooldown_meet_in_parts(spark):
    """As a plain loop over all hits gives, and without rows for all pairs of drops and users."""
    import datetime
    import random

    from quayside.operators import prices as P

    rnd, day = random.Random(4), datetime.datetime(2024, 1, 1)
    drops = [(rnd.randrange(6), k, day + datetime.timedelta(hours=12 * rnd.randrange(20)), rnd.randrange(1, 100)) for k in range(300)]
    alerts = [(u, rnd.randrange(3), rnd.randrange(1, 100), u % 7 > 0, rnd.choice([None, day + datetime.timedelta(days=2)])) for u in range(60)] + [(1, 1, 5, True, None), (1, 1, 90, True, None), (1, 1, 40, True, None)]
    matches = {listing: listing % 4 for listing in range(6)}
    want, last = set(), {}
    hits = ((d[2], d[0], d[1], d[3], a[2], a[0], a[1], a[4]) for d in drops for a in alerts if a[3] and a[1] == matches[d[0]] and a[2] >= d[3])
    for at, listing, i, price, target, user, product, told in sorted(hits, key=lambda h: h[:7]):
        known = [t for t in (told, last.get((user, product))) if t is not None]
        if not known or max(known) < at - datetime.timedelta(hours=24):
            last[user, product] = at
            want.add((user, product, listing, i, at, price, target))
    args = (
        spark.createDataFrame(drops, "listing_id long, id long, dropped_at timestamp, new_price_pence long"), spark.createDataFrame(list(matches.items()), "listing_id long, product_id long"),
        spark.createDataFrame(alerts, "user_id long, product_id long, target_price_pence long, is_active boolean, last_notified_at timestamp"),
    )
    for users in (5, 1_000):
        out = P.alerts_with_cooldown(*args, users=users)
        assert {tuple(r) for r in out.collect()} == want
    assert "collect_list" not in out._jdf.queryExecution().optimizedPlan().toString()
