"""Facts about single values."""

import pytest
from pyspark.sql import functions as F

from quayside.functions import ingredients, numbers, sentiment, text, urls
from quayside.functions.similarity import common_chars
from quayside.sources import extractors, pages


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("given", "grams"),
    [("Food 2.5kg", 2500), ("Food 15 kg", 15000), ("5 lb bag", 2270), ("2,5 kg", 2500), ("500ml", 500), ("no weight", None), ("", None), ("12 x 400g", 400)],
)
def test_weight(spark, given, grams):
    assert value(spark, text.parse_weight(F.lit(given))) == grams


def test_quantities_brands_and_titles(spark):
    assert value(spark, text.extract_quantity(F.lit("Wet Food 12x400g"))) == 12
    assert value(spark, text.extract_quantity(F.lit("Treats 20 pack"))) == 20
    assert value(spark, text.extract_quantity(F.lit("Treats"))) is None
    assert value(spark, text.normalize_brand(F.lit("lilys kitchen"))) == "Lily's Kitchen"
    assert value(spark, text.normalize_brand(F.lit(""))) is None
    assert value(spark, text.normalize_brand(F.lit(None).cast("string"))) is None
    assert value(spark, text.normalize_title(F.lit("Premium Adult Dog Food 12 x 400g with Rice!"))) == "dog food rice"
    assert value(spark, text.slugify(F.lit("B&M"))) == "bm"
    assert value(spark, text.title_from_url(F.lit("https://x.example/p/dry-dog_food?a=1"))) == "Dry Dog Food"


@pytest.mark.parametrize(("a", "b", "tolerance", "same"), [(2000, 2050, 0.05, True), (2000, 2200, 0.05, False), (2000, 2200, 0.1, True), (None, 5, 0.05, False)])
def test_weights_match(spark, a, b, tolerance, same):
    assert value(spark, text.weights_match(F.lit(a).cast("long"), F.lit(b).cast("long"), tolerance)) is same


@pytest.mark.parametrize(("given", "kind"), [("Dog Dental Chews", "treats"), ("dental chews", "dental"), ("Kibble", "dry_food"), (" ", "other"), (None, "other"), ("Toys", "other")])
def test_category(spark, given, kind):
    assert value(spark, text.normalize_category(F.lit(given).cast("string"))) == kind


@pytest.mark.parametrize(("given", "pence"), [("£12.99", 1299), ("95p", 95), ("£5", 500), ("£120", 120), ("1,50", 150), ("12.5", 1250), ("", None), ("free", None)])
def test_price(spark, given, pence):
    assert value(spark, numbers.price_to_pence(F.lit(given))) == pence


def test_rounding_is_away_from_zero(spark):
    assert value(spark, numbers.rounded_ratio(F.lit(-285), F.lit(1000), 2)) == -0.29
    assert value(spark, numbers.rounded_ratio(F.lit(1), F.lit(0), 2)) is None
    assert value(spark, numbers.change_percent(F.lit(1000), F.lit(1300))) == 30.0
    assert value(spark, numbers.drop_percent(F.lit(1000), F.lit(1100))) == 0.0


def test_multi_buy_and_lists(spark):
    assert value(spark, text.multi_buy(F.lit("Any 3 for £5"))) == (3, 500)
    assert value(spark, text.multi_buy(F.lit("buy 2 get 1 free"))) == (3, None)
    assert value(spark, text.list_in_words(F.array(*map(F.lit, "abc")))) == "a, b, and c"
    assert value(spark, text.brand_from_title(F.lit("Adult Royal Canin Medium"))) == "Royal Canin"
    assert value(spark, text.brand_from_title(F.lit("Zorba Rex lamb"))) == "Zorba Rex"


def test_ingredients(spark):
    got = value(spark, ingredients.parse(F.lit("Ingredients: Chicken (26%, fresh), rice; maize 10%, ,oil")))
    assert [(x.name, x.percentage, x.position) for x in got] == [("Chicken", "26%", 0), ("rice", None, 1), ("maize", "10%", 2), ("oil", None, 3)]
    assert value(spark, ingredients.parse(F.lit(None).cast("string"))) == []
    found = ingredients.allergens(ingredients.names(F.lit("zinc oxide, salmon, oats")))
    assert value(spark, found) == ["beef", "fish", "grain"]
    assert value(spark, ingredients.is_single_protein(found)) is False


def analysed(spark, title, body, rating):
    return sentiment.analyse(spark.createDataFrame([(title, body, rating)], "title string, body string, rating double")).first()


@pytest.mark.parametrize(
    ("body", "rating", "keyword", "column"),
    [
        ("Our cat is not happy with the tin", 2.0, "not happy", "negative_keywords"),
        ("Shipping was never awful here", 4.0, "not awful", "positive_keywords"),
        ("My vet and I would recommend the salmon one, good value too", 5.0, "would recommend", "positive_keywords"),
        ("Honestly not worth the trouble, he won't eat a bite", 1.0, "not worth", "negative_keywords"),
        ("she devours it and her coat looks great", 5.0, "taste", "praises"),
        ("the bag came torn and was expensive", 1.0, "packaging", "complaints"),
        ("ISN'T fresh", 3.0, "not fresh", "negative_keywords"),
    ],
)
def test_sentiment(spark, body, rating, keyword, column):
    assert keyword in analysed(spark, None, body, rating)[column]


def test_sentiment_fold(spark):
    # the negation covers both words: 0.8 * 0.7 for great, 0.8 * 0.5 * 1.5 for nice
    got = analysed(spark, "", "hardly great and extremely nice, truly", None)
    assert got.negative_keywords == ["not great", "not nice"]
    assert got.score == round(-0.4 * 1.16 / 2, 3)
    assert analysed(spark, "", "no one here says bad things", None).positive_keywords == []  # the fourth word after the negation
    assert analysed(spark, None, None, 5.0).score == 0.6
    assert sentiment.analyse(spark.createDataFrame([], "title string, body string, rating double")).count() == 0


def test_common_chars():
    assert common_chars("World", "Word") == 4
    assert common_chars("", "a") == 0


def test_addresses(spark):
    join = lambda a, b: value(spark, urls.resolve(F.lit(a), F.lit(b)))
    assert join("/a", "https://x.example/b/c?d") == "https://x.example/a"
    assert join("//y.example/a", "https://x.example/b") == "https://y.example/a"
    assert join("a", "https://x.example/b/c?d") == "https://x.example/b/a"
    assert value(spark, urls.category(F.lit("https://x.example/pets/puppy-food/"))) == "dog-food"
    assert value(spark, urls.category(F.lit("https://x.example/aisle/pet-shop/dog/dog-food/1234"))) == "dog-food"
    assert value(spark, urls.page_number(F.lit("https://x.example/?start=48"))) == 3
    assert value(spark, urls.external_id(F.lit("https://www.tesco.com/groceries/en-GB/products/2543"))) == "2543"
    assert value(spark, urls.retailer_of(F.lit("https://other.example/"))) is None


PRODUCT = """<html><head><title>t</title><script type="application/ld+json">{"@graph": [{"@type": "WebPage"}, {"@type": "Product", "name": "Acme Dry Dog Food 12kg",
"brand": {"name": "Acme"}, "gtin13": "5012345678900", "image": ["a.jpg"], "offers": {"price": "24.99", "availability": "https://schema.org/OutOfStock"},
"review": [{"reviewRating": {"ratingValue": "4"}, "author": {"name": "Jo"}, "reviewBody": "fine", "datePublished": "2024-01-15"}, {"reviewBody": "no rating"}]}]}</script></head>
<body><h1>Other</h1><a href="/product/x/ABC1">x</a><ul class="pagination"><a rel="next" href="?page=2">Next</a></ul></body></html>"""


def test_pages(spark):
    url = "https://www.petsathome.com/product/dog-food/P71"
    rows = spark.createDataFrame([(1, url, PRODUCT), (2, "https://none.example/", ""), (3, "https://none.example/", None)], "page_id long, url string, html string")
    got = {r.page_id: r for r in extractors.details(rows).collect()}
    assert (got[1].title, got[1].brand, got[1].price_pence, got[1].weight_grams, got[1].in_stock, got[1].barcode, got[1].external_id) == ("Acme Dry Dog Food 12kg", "Acme", 2499, 12000, False, "5012345678900", "P71")
    assert (got[2].title, got[2].price_pence, got[2].in_stock) == ("Unknown Product", 0, True)
    assert [(r.rating, r.author, str(r.review_date)) for r in pages.reviews(rows).collect()] == [(4.0, "Jo", "2024-01-15")]
    assert [r.external_id for r in pages.product_links(rows).collect()] == ["ABC1"]
    assert extractors.next_pages(rows).where("page_id = 1").first().next_url.endswith("?page=2")
