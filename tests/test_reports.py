"""Report rows and resources on small tables: nulls, empty tables, unknown keys."""

import datetime

from pyspark.sql import functions as F

from quayside.operators import filters
from quayside.operators import reports as R
from quayside.sources import exports as X
from quayside.sources import resources as S

DAY = datetime.date(2026, 3, 10)
STATISTICS = "retailer string, day date, started long, completed long, failed long, discovered long"


def at(days_ago):
    return DAY - datetime.timedelta(days=days_ago)


def test_day_totals_without_rows(spark):
    row = R.day_totals(spark.createDataFrame([], STATISTICS), F.lit(DAY)).first()
    assert (row.started, row.failed, row.success_rate) == (0, 0, None)


def test_retailer_history(spark):
    rows = [("a", at(n), 2, 1, 1, 5) for n in range(13)] + [("b", at(40), 1, 1, 0, 0)]
    found = {r.retailer: r for r in R.retailer_history(spark.createDataFrame(rows, STATISTICS), F.lit(DAY)).collect()}
    assert (found["a"].started, found["a"].failed_in_30_days, found["a"].success_rate) == (16, 13, 50.0)
    assert found["a"].failure_days == [at(n) for n in range(10)]
    assert (found["b"].started, found["b"].success_rate, found["b"].failure_days) == (0, None, [])


def test_verifications_between_days(spark):
    log = [(1, "approved", True, DAY), (1, "approved", False, DAY), (1, "rematched", None, DAY), (1, "rejected", False, at(1)), (2, "approved", False, at(9))]
    df = spark.createDataFrame(log, "user_id long, action string, bulk boolean, verified_at date")
    found = {(r.user_id, r.day): (r.approved, r.rejected, r.rematched, r.bulk_approvals, r.total) for r in R.verification_history(df, F.lit(at(1)), F.lit(DAY)).collect()}
    assert found == {(1, DAY): (2, 0, 1, 1, 3), (1, at(1)): (0, 1, 0, 0, 1)}


def test_severity_puts_unknown_states_last(spark):
    rows = [(1, "x", "active"), (2, "y", None), (3, "z", "failed"), (4, "w", "odd")]
    found = R.by_severity(spark.createDataFrame(rows, "id long, name string, status string")).collect()
    assert [r.id for r in found] == [3, 1, 4, 2] and [r.severity for r in found] == [0, 4, None, None]


def test_match_rate_counts_a_listing_once(spark):
    listings = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    matches = spark.createDataFrame([(1, 7), (1, 8), (9, 7)], "listing_id long, product_id long")
    assert tuple(R.match_rate(listings, matches).first()) == (3, 1, 33.0)
    assert R.match_rate(listings.limit(0), matches).first().match_rate is None


def test_images(spark):
    values = ["https://a/1.jpg", '{"url": "https://a/2.jpg", "width": 5}', '{"cached_url": "/c"}', "{}"]
    df = spark.createDataFrame([(1, values), (2, None), (3, [])], "id long, images array<string>")
    found = {r.id: r.x for r in df.select("id", S.images(F.col("images"), "none.svg").alias("x")).collect()}
    assert [i.url for i in found[1]] == ["https://a/1.jpg", "https://a/2.jpg", "/c", ""]
    assert [i.width for i in found[1]] == [None, 5, None, None] and not any(i.is_primary for i in found[1])
    assert found[1][0].placeholder_url == "none.svg" and found[2] is None and found[3] == []


def test_event_property(spark):
    df = spark.createDataFrame([('{"retailer": "pets"}',), ("no json",), (None,), ("{}",)], "p string")
    assert [r[0] for r in df.select(S.event_property(F.col("p"), "retailer")).collect()] == ["pets", None, None, None]


def test_retailer_by_slug(spark):
    rows = spark.createDataFrame([(1, "Pets at Home"), (2, "Unknown"), (3, None)], "id long, retailer_name string")
    shops = spark.createDataFrame([(7, "pets-at-home")], "id long, slug string")
    assert [(r.id, r.retailer_id) for r in filters.with_retailer(rows, shops).collect()] == [(1, 7)]


def test_ingredients_in_order(spark):
    bridge = spark.createDataFrame([(1, 10, 2), (1, 11, 1), (1, 99, 3), (2, 10, 1)], "listing_id long, ingredient_id long, position int")
    names = spark.createDataFrame([(10, "rice"), (11, "lamb")], "id long, name string")
    assert {r.listing_id: r.ingredients for r in R.listing_ingredients(bridge, names).collect()} == {1: ["lamb", "rice"], 2: ["rice"]}


def test_export_lines_and_their_envelope(spark):
    products = spark.createDataFrame([(1, "n", None), (2, "m", "b")], "id long, name string, brand string")
    matches = spark.createDataFrame([(5, 1), (6, 1)], "listing_id long, product_id long")
    listings = spark.createDataFrame([(5, 3, 200, "t", True), (6, 4, 100, "u", False)], "id long, retailer_id long, price_pence long, title string, in_stock boolean")
    shops = spark.createDataFrame([(3, "Shop", "shop")], "id long, name string, slug string")
    rows = X.nested(products, matches, listings, shops)
    first = '{"id":1,"name":"n","brand":null,"listings":[{"price_pence":100,"listing_id":6,"title":"u","in_stock":false,"retailer":null},'
    found = {r.id: r.json for r in rows.collect()}
    assert found[1].startswith(first) and found[1].endswith('"retailer":{"id":3,"name":"Shop","slug":"shop"}}]}')
    assert found[2] == '{"id":2,"name":"m","brand":"b","listings":[]}'
    assert tuple(X.envelope(rows, F.lit("2026-03-10 00:00:00").cast("timestamp")).first()) == (2, "2026-03-10T00:00:00Z")
