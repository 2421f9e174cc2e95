"""Queries that normalise text, score reviews, match titles and read pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from quayside.functions import fixed, ingredients, similarity, text
from quayside.functions.numbers import price_to_pence, rating_factor, stars
from quayside.operators import matching, reviews
from quayside.plans.base import case, sql
from quayside.sources import pages, tables as T

def _listings(spark, sf_dir):
    kg = (F.col("weight_grams") / 100).cast("int").cast("string")
    return T.listings(spark, sf_dir).withColumn("long_title", F.concat("brand", F.lit(" Complete "), "title", F.lit(" "), kg, F.lit("kg 12 x 400g & More")))


def _pages(spark, sf_dir):
    return T.scan(spark, sf_dir, "pages")


QUERIES = {
    "normalize_titles": lambda s, d: _listings(s, d).select("id", text.normalize_title(F.col("long_title")).alias("title")),
    "normalize_brands": lambda s, d: T.listings(s, d).groupBy(text.normalize_brand(F.concat(F.lit(" "), F.upper("brand"))).alias("brand")).agg(F.count(F.lit(1)).alias("n")),
    "parse_weights": lambda s, d: _listings(s, d).select("id", text.parse_weight(F.col("long_title")).alias("grams"), text.parse_weight(F.concat(F.lit("Pack 2,5 lbs of "), "title")).alias("pounds_in_grams")),
    "parse_quantities": lambda s, d: _listings(s, d).select("id", text.extract_quantity(F.col("long_title")).alias("quantity"), text.page_quantity(F.col("title")).alias("page_quantity")),
    "normalize_categories": lambda s, d: T.listings(s, d).groupBy(text.normalize_category(F.col("category")).alias("category")).agg(F.count(F.lit(1)).alias("n")),
    "slugify": lambda s, d: T.retailers(s, d).select("id", text.slugify(F.concat("name", F.lit(" & Sons_Ltd"))).alias("slug")),
    "format_money": lambda s, d: T.listings(s, d).select("id", text.money(F.col("price_pence")).alias("price")),
    "read_prices": lambda s, d: T.listings(s, d).select("id", price_to_pence(text.money(F.col("price_pence"))).alias("pence"), price_to_pence(F.concat((F.col("id") % 300).cast("string"), F.lit(" "))).alias("whole")),
    "barcodes": lambda s, d: T.listings(s, d).select("id", text.barcode(F.concat(F.lit("EAN "), "barcode")).alias("barcode")).where("barcode is not null"),
    "title_similarity_levenshtein": lambda s, d: _pairs(s, d).select("a", "b", similarity.levenshtein_similarity(F.col("a"), F.col("b")).alias("similarity")),
    "title_similarity": lambda s, d: _pairs(s, d).select("a", "b", similarity.title_similarity(F.col("a"), F.col("b")).alias("similarity")),
    "match_candidates": lambda s, d: matching.candidates(T.listings(s, d), T.products(s, d)),
    "match_best": lambda s, d: matching.best(matching.candidates(T.listings(s, d), T.products(s, d))),
    "match_pipeline": lambda s, d: matching.match(T.listings(s, d), T.products(s, d).where("is_verified"), T.matches(s, d).where("status = 'approved'")),
    "unmatched_listings": lambda s, d: matching.unmatched(T.listings(s, d), T.matches(s, d).where("status <> 'rejected'")).select("id", "title"),
    "new_products": lambda s, d: matching.new_products(T.listings(s, d)).select("brand", "title", "weight", "product_id", F.size("listing_ids").alias("n")),
    "allergens": lambda s, d: _ingredients(s, d).select("id", F.array_join(F.array_sort(ingredients.allergens(ingredients.names(F.col("ingredients")))), ",").alias("allergens")),
    "ingredient_lists": lambda s, d: _ingredients(s, d).select("id", F.explode(ingredients.parse(F.col("ingredients"))).alias("x")).select("id", "x.*", ingredients.ingredient_class(F.col("x.name")).alias("class")),
    "ingredient_flags": lambda s, d: _ingredients(s, d).withColumn("a", ingredients.allergens(ingredients.names(F.col("ingredients")))).select(
        "id", ingredients.is_grain_free(F.col("a")).alias("grain_free"), ingredients.is_single_protein(F.col("a")).alias("single_protein"), ingredients.primary_protein(F.col("a")).alias("primary_protein")),
    "sentiment_scores": lambda s, d: reviews.analyse(T.reviews(s, d)).select("listing_id", "id", "score", "label", "confidence", F.array_join("positive_keywords", ",").alias("positive"), F.array_join("negative_keywords", ",").alias("negative")),
    "sentiment_topics": lambda s, d: reviews.topics(T.reviews(s, d)).select("id", F.array_join("praises", ",").alias("praises"), F.array_join("complaints", ",").alias("complaints")),
    "sentiment_summary": lambda s, d: reviews.summary(T.reviews(s, d)),
    "rating_factor": lambda s, d: T.reviews(s, d).select("id", rating_factor(F.col("rating")).alias("factor"), stars(F.col("rating")).alias("stars")),
    "newest_reviews": lambda s, d: reviews.newest(T.reviews(s, d)).select("listing_id", "id", "review_date"),
    "product_ratings": lambda s, d: reviews.rating_of_products(T.reviews(s, d), T.matches(s, d)),
    "page_links": lambda s, d: pages.links(_pages(s, d)).select("page_id", "href"),
    "page_titles": lambda s, d: pages.titles(_pages(s, d)),
}


def _pairs(spark, sf_dir):
    """Normalised names that share a word and begin alike."""
    names = T.scan(spark, sf_dir, "part").select(F.lower("p_name").alias("a")).distinct().withColumn("word", F.substring_index("a", " ", 1))
    return names.join(names.select(F.col("a").alias("b"), "word"), "word").where("a < b").select("a", "b")


#: Words from which parts' lists of ingredients are put together.
_MEATS = ("Chicken", "Fresh Lamb", "pork liver", "Salmon", "beef", "Duck", "Whitefish meal")
_CARBS = ("brown rice", "Potato", "wheat flour", "Maize", "oats", "pea starch", "tapioca", "soya protein", "barley", "chickpea", "sweet potato")
_REST = ("egg powder", "Carrot", "cranberry extract", "butter", "vitamin E (with iron, zinc)", "citric acid", "sunflower oil", "cheese", "zinc oxide", "apple", "rosemary extract", "celery", "minerals")


def _ingredients(spark, sf_dir):
    """id, ingredients: a list for each part, of words by its key and size."""
    key, size = F.col("p_partkey"), F.col("p_size")
    pick = lambda words, by: F.get(F.array(*[F.lit(w) for w in words]), (by % len(words)).cast("int"))
    text = F.concat(
        F.when(key % 2 == 0, "Composition: ").otherwise("INGREDIENTS : "), pick(_MEATS, key), F.lit(" (dried, "), size.cast("string"), F.lit(".5%), "), pick(_CARBS, size), F.lit("; ; "), F.col("p_name"), F.lit(" 4 %,"), pick(_REST, key + size), F.lit("; "), pick(_MEATS, size),
    )
    return T.scan(spark, sf_dir, "part").select(key.alias("id"), F.when(key % 10 != 9, text).alias("ingredients"))


_UNIT = "|".join(sorted(text.UNIT_GRAMS, key=lambda u: (-len(u), u)))
_GRAMS = "CASE lower(u) " + " ".join(f"WHEN '{u}' THEN {g}" for u, g in text.UNIT_GRAMS.items()) + " END"
_LONG = "brand || ' Complete ' || title || ' ' || (weight_grams // 100) || 'kg 12 x 400g & More'"
_topic = lambda table: "array_to_string(list_filter([" + ", ".join("CASE WHEN " + " OR ".join(f"contains(t, '{w.replace(chr(39), chr(39) * 2)}')" for w in v) + f" THEN '{k}' END" for k, v in table.items()) + "], lambda x: x IS NOT NULL), ',')"


def _weight(expr: str) -> str:
    return f"(SELECT CAST(floor(CAST(replace(n, ',', '.') AS DOUBLE) * {_GRAMS} + 0.5) AS BIGINT) FROM (SELECT regexp_extract({expr}, '(?i)(\\d+(?:[.,]\\d+)?)\\s*({_UNIT})\\b', 1) AS n, regexp_extract({expr}, '(?i)(\\d+(?:[.,]\\d+)?)\\s*({_UNIT})\\b', 2) AS u))"


_CLEAN = lambda tag: f"""nullif(replace(replace(replace(replace(replace(replace(replace(trim(regexp_replace(regexp_replace(nullif(regexp_extract(html, '(?is)<{tag}(?:\\s[^>]*)?>(.*?)</{tag}\\s*>', 1), ''), '(?s)<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')),
    '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&pound;', '£'), '&nbsp;', ' '), '&amp;', '&'), '')"""  # noqa: E731

def _picked(words, by: str) -> str:
    return case(f"({by}) % {len(words)}", dict(enumerate(words)))


# a comma inside parentheses stands as a sign of its own while lists are split
_LISTS = f"""WITH texts AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 10 <> 9 THEN ({_picked(_MEATS, "p_partkey")}) || ' (dried~ ' || p_size || '.5%), ' || ({_picked(_CARBS, "p_size")}) || '; ; ' || p_name || ' 4 %,'
        || replace({_picked(_REST, "p_partkey + p_size")}, 'iron, ', 'iron~ ') || '; ' || ({_picked(_MEATS, "p_size")}) END AS t FROM part),
    parts AS (SELECT id, list_filter(list_transform(string_split(replace(t, ';', ','), ','), lambda x: trim(x)), lambda x: x <> '') AS l FROM texts),
    one AS (SELECT id, unnest(l) AS x, unnest(range(len(l))) AS position FROM parts),
    lists AS (SELECT id, trim(regexp_replace(regexp_replace(regexp_replace(x, '\\d+(?:\\.\\d+)?\\s*%', '', 'g'), '\\([^)]*\\)', '', 'g'), '\\s+', ' ', 'g')) AS name, CASE WHEN regexp_extract(x, '(\\d+(?:\\.\\d+)?)\\s*%', 1) <> '' THEN regexp_extract(x, '(\\d+(?:\\.\\d+)?)\\s*%', 1) || '%' END AS percentage,
        CAST(position AS INT) AS position FROM one),
    named AS (SELECT * FROM lists WHERE name <> ''),
    found AS (SELECT p.p_partkey AS id, list_distinct(coalesce(flatten(list(CASE WHEN name IS NULL THEN [] ELSE list_filter([{", ".join(f"CASE WHEN regexp_matches(lower(name), '{'|'.join(v)}') THEN '{k}' END" for k, v in fixed.ALLERGENS.items())}], lambda a: a IS NOT NULL) END)), [])) AS a
        FROM part p LEFT JOIN named n ON n.id = p.p_partkey GROUP BY 1)"""

ORACLE_SQL = {
    "allergens": f"{_LISTS} SELECT id, array_to_string(list_sort(a), ',') AS allergens FROM found",
    "ingredient_lists": f"{_LISTS} SELECT *, CASE {' '.join(f"WHEN regexp_matches(lower(name), '{'|'.join(v)}') THEN '{k}'" for k, v in fixed.INGREDIENT_CLASSES.items())} END AS class FROM named",
    "ingredient_flags": f"""{_LISTS} SELECT id, NOT list_has_any(a, {list(fixed.GRAINS)!r}) AS grain_free, len(list_intersect(a, {list(fixed.PROTEINS)!r})) <= 1 AS single_protein,
        CASE {" ".join(f"WHEN list_contains(a, '{x}') THEN '{x}'" for x in fixed.PROTEINS)} END AS primary_protein FROM found""",
    "normalize_titles": sql("listings", f""" SELECT id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(replace(lower({_LONG}), 'with', ''), 'adult', ''), 'complete', ''), 'premium', ''), 'natural', ''),
        'grain free', ''), 'grain-free', ''), '\\d+(\\.\\d+)?\\s*(kg|g|lb|lbs|oz|ml|l)\\b', '', 'g'), '\\d+\\s*(x|pack)\\s*\\d*', '', 'g'), '[^a-z0-9\\s]', '', 'g'), '\\s+', ' ', 'g')) AS title FROM listings"""),
    "normalize_brands": "SELECT upper(left(lower(p_brand), 1)) || substr(lower(p_brand), 2) AS brand, count(*) AS n FROM part GROUP BY 1",
    "parse_weights": sql("listings", f" SELECT id, {_weight(_LONG)} AS grams, {_weight(chr(39) + 'Pack 2,5 lbs of ' + chr(39) + ' || title')} AS pounds_in_grams FROM listings"),
    "parse_quantities": sql("listings", f" SELECT id, CAST(regexp_extract({_LONG}, '(?i)(\\d+)\\s*(?:x|pack)', 1) AS INT) AS quantity, CAST(nullif(regexp_extract(title, '(?i)(\\d+)\\s*(?:pack|x|pcs|pieces|count)\\b', 1), '') AS INT) AS page_quantity FROM listings"),
    "normalize_categories": "SELECT CASE p_type WHEN 'STANDARD' THEN 'dry_food' WHEN 'ECONOMY' THEN 'wet_food' WHEN 'PROMO' THEN 'treats' WHEN 'LARGE' THEN 'dental' WHEN 'MEDIUM' THEN 'puppy_food' WHEN 'SMALL' THEN 'senior_food' ELSE 'other' END AS category, count(*) AS n FROM part GROUP BY 1",
    "slugify": "SELECT s_suppkey AS id, trim(regexp_replace(regexp_replace(lower(s_name || ' & Sons_Ltd'), '[^a-z0-9\\s_-]', '', 'g'), '[\\s_-]+', '-', 'g'), '-') AS slug FROM supplier",
    "format_money": sql("listings", " SELECT id, '£' || format('{:,}', price_pence // 100) || '.' || lpad(CAST(price_pence % 100 AS VARCHAR), 2, '0') AS price FROM listings"),
    "read_prices": sql("listings", " SELECT id, price_pence AS pence, CASE WHEN id % 300 < 100 THEN id % 300 * 100 ELSE id % 300 END AS whole FROM listings"),
    "barcodes": sql("listings", " SELECT id, barcode FROM listings WHERE barcode IS NOT NULL"),
    "title_similarity_levenshtein": "WITH n AS (SELECT DISTINCT lower(p_name) AS a FROM part) SELECT x.a, y.a AS b, (1.0::DOUBLE - levenshtein(x.a, y.a)::DOUBLE / greatest(length(x.a), length(y.a))) * 100 AS similarity FROM n x JOIN n y ON split_part(x.a, ' ', 1) = split_part(y.a, ' ', 1) AND x.a < y.a",
    "unmatched_listings": sql("listings matches", " SELECT id, title FROM listings WHERE id NOT IN (SELECT listing_id FROM matches WHERE status <> 'rejected')"),
    "new_products": sql("listings", " SELECT upper(left(lower(brand), 1)) || substr(lower(brand), 2) AS brand, title, weight_grams AS weight, min(id) AS product_id, count(*) AS n FROM listings GROUP BY 1, 2, 3"),
    "sentiment_topics": sql("reviews", f" SELECT id, {_topic(fixed.PRAISE_TOPICS)} AS praises, {_topic(fixed.COMPLAINT_TOPICS)} AS complaints FROM (SELECT id, lower(trim(title || ' ' || coalesce(body, ''))) AS t FROM reviews)"),
    "rating_factor": sql("reviews", " SELECT id, (rating - 3) / 2 AS factor, CAST(round(rating) AS INT) AS stars FROM reviews"),
    "newest_reviews": sql("reviews", " SELECT listing_id, id, review_date FROM (SELECT *, row_number() OVER (PARTITION BY listing_id ORDER BY review_date DESC, id DESC) AS r FROM reviews) WHERE r <= 10"),
    "product_ratings": sql("reviews matches", """ SELECT product_id, count(*) AS review_count, ((2 * CAST(sum(CAST(rating * 10 AS BIGINT)) AS BIGINT) + count(*)) // (2 * count(*))) / 10.0::DOUBLE AS average_rating
        FROM (SELECT *, row_number() OVER (PARTITION BY listing_id ORDER BY review_date DESC, id DESC) AS r FROM reviews) JOIN matches USING (listing_id) WHERE r <= 10 GROUP BY 1"""),
    "page_links": "SELECT DISTINCT page_id, unnest(regexp_extract_all(html, '(?is)<a\\s[^>]*?href=[\"'']([^\"'']*)[\"'']', 1)) AS href FROM pages",
    "page_titles": f"SELECT page_id, {_CLEAN('title')} AS title, {_CLEAN('h1')} AS heading FROM pages",
}
