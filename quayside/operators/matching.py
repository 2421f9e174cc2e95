"""Entity resolution: candidate pairs by blocking, confidence, the best product of each listing, new products."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quayside.functions import fixed
from quayside.functions.numbers import brand_points, match_confidence
from quayside.functions.similarity import title_similarity
from quayside.functions.text import category_in_context, normalize_brand, normalize_category, normalize_title, weights_match
from quayside.operators.alike import SLACK, near_titles

#: The title's share of the confidence, and the most that the rest gives where brands differ.
TITLE_PART, BEST_OF_OTHER_BRAND = 0.4, 35.0


def unmatched(listings: DataFrame, matches: DataFrame) -> DataFrame:
    """Listings without a match."""
    return listings.hint("merge").join(matches.select(F.col("listing_id").alias("id")), "id", "left_anti")


def prepared(table: DataFrame, prefix: str, name: str) -> DataFrame:
    """The columns that matching compares, normalised, named with a prefix."""
    return table.select(F.col("id").alias(f"{prefix}id"), *normalised(table, prefix, name), *measures(table, prefix))


def normalised(table: DataFrame, prefix: str, name: str) -> list[Column]:
    category = F.col("category") if "category" in table.columns else F.lit(None).cast("string")
    kind = F.col("canonical_category") if "canonical_category" in table.columns else F.when(category.isNotNull(), normalize_category(category))
    if prefix != "p_":  # a listing's title tells the category where its own says nothing
        kind = category_in_context(category, F.col(name))
    return [normalize_title(F.col(name)).alias(f"{prefix}title"), normalize_brand(F.col("brand")).alias(f"{prefix}brand"), kind.alias(f"{prefix}category")]


def measures(table: DataFrame, prefix: str) -> list[Column]:
    col = lambda c, kind: F.col(c) if c in table.columns else F.lit(None).cast(kind)
    return [col("weight_grams", "long").alias(f"{prefix}weight"), col("quantity", "int").alias(f"{prefix}quantity")]


def candidates(listings: DataFrame, products: DataFrame, least: float = fixed.FUZZY_CONFIDENCE) -> DataFrame:
    """listing_id, product_id, similarity, confidence, same_category, exact of pairs that may match.

    Of equal brands all pairs whose titles reach ``least``; of different or missing brands those whose confidence
    reaches it too, as no other can match. Without the brand's part of the confidence, titles of different brands have
    to be more alike than ``least``.

    Distinct titles meet first, on their rarest grams: those of a brand, those without one with all others, and the more
    alike ones of any brand. The similarity is computed once for each pair of titles; then names meet (title, brand and
    category as they stand), which alone are normalised, and last the rows that have them.
    """
    differ = max(least, (least - BEST_OF_OTHER_BRAND) / TITLE_PART)
    own, other = names(listings, "l_", "title"), names(products, "p_", "name")
    titles = lambda df, p: df.select(F.lit("").alias("block"), F.col(f"{p}title").alias("title"))
    near = near_titles(blocks(own, "l_", "listings", "products"), blocks(other, "p_", "products", "listings"), least)
    near = near.select("l_title", "p_title").unionAll(near_titles(titles(own, "l_"), titles(other, "p_"), differ).select("l_title", "p_title"))
    pairs = near.distinct().withColumn("similarity", title_similarity(F.col("l_title"), F.col("p_title"))).where(F.col("similarity") >= least)
    same = F.coalesce(F.col("l_block") == F.col("p_block"), F.lit(False))
    enough = F.col("l_block").isNull() | F.col("p_block").isNull() | (F.col("similarity") >= differ - SLACK)
    points, equal = brand_points(F.col("l_brand"), F.col("p_brand")), (F.lit(1), F.lit(1))
    most = match_confidence(F.col("similarity"), points, (F.col("l_category"), F.col("p_category")), equal, equal)
    known = pairs.join(own, "l_title").join(other, "p_title").where(same | (enough & (most >= least)))
    known = known.select("similarity", same.alias("same_brand"), points.alias("brand_points"), *[c for df in (own, other) for c in df.columns if "_own_" in c or c.endswith("_category")])
    found = having(having(known, products, "p_", "name"), listings, "l_", "title")
    return rated(found, F.col("same_brand") | (F.col("confidence") >= least))


def keys(table: DataFrame, prefix: str, name: str) -> dict[str, str]:
    """The columns of a name as it stands, and what they are called beside the normalised ones."""
    return {c: f"{prefix}own_{c}" for c in (name, "brand", "category", "canonical_category") if c in table.columns}


def names(table: DataFrame, prefix: str, name: str) -> DataFrame:
    """The distinct names of a table, as they stand and normalised, and the block of their brand."""
    # a maximum: filters on the normalised title stay here then, and don't normalise the title of each row
    own = keys(table, prefix, name)
    rows = table.groupBy(*own).agg(F.max(name).alias("text"))
    rows = rows.select(*[F.col(c).alias(k) for c, k in own.items()], *normalised(rows, prefix, "text"))
    return rows.withColumn(f"{prefix}block", F.lower(f"{prefix}brand"))


def having(pairs: DataFrame, table: DataFrame, prefix: str, name: str) -> DataFrame:
    """The pairs of names with each row of the table that has the name. Sorted on both sides, as a small file may hold very many rows."""
    own = keys(table, prefix, name)
    rows = table.select(F.col("id").alias(f"{prefix}id"), *own, *measures(table, prefix))
    equal = [rows[c].eqNullSafe(pairs[k]) if c != name else rows[c] == pairs[k] for c, k in own.items()]
    return rows.hint("merge").join(pairs, equal).drop(*own, *own.values())


def blocks(table: DataFrame, prefix: str, own: str, all_of: str) -> DataFrame:
    """A title in the block of its brand, in one that all have and, without a brand, in one that meets all others."""
    block = F.col(f"{prefix}block")
    every = F.array(F.concat(F.lit("="), block), F.when(block.isNull(), own), F.lit(all_of))
    return table.select(F.explode(every).alias("block"), F.col(f"{prefix}title").alias("title"))


def rated(near: DataFrame, wanted: Column | None = None) -> DataFrame:
    """The pairs with their confidence; ``same_brand`` and ``brand_points`` are worked out where the pairs don't have them."""
    columns = lambda c: (F.col(f"l_{c}"), F.col(f"p_{c}"))
    if "brand_points" not in near.columns:
        same_brand = F.coalesce(F.lower("l_brand") == F.lower("p_brand"), F.lit(False))
        near = near.withColumn("same_brand", same_brand).withColumn("brand_points", brand_points(*columns("brand")))
    sure = match_confidence(F.col("similarity"), F.col("brand_points"), columns("category"), columns("weight"), columns("quantity"))
    same = F.coalesce((F.col("l_category") == F.col("p_category")) & (F.col("l_category") != "other"), F.lit(False))
    either = lambda c, ok: F.col(f"l_{c}").isNull() | F.col(f"p_{c}").isNull() | ok(F.col(f"l_{c}"), F.col(f"p_{c}"))
    alike = F.col("same_brand") & (F.col("similarity") >= fixed.EXACT_CONFIDENCE) & either("weight", weights_match) & either("quantity", lambda x, y: x == y)
    rows = near.withColumn("confidence", sure)
    if wanted is not None:
        rows = rows.where(wanted)
    exact = alike & (F.col("confidence") >= fixed.EXACT_CONFIDENCE)
    return rows.select(F.col("l_id").alias("listing_id"), F.col("p_id").alias("product_id"), "similarity", "confidence", same.alias("same_category"), exact.alias("exact"))


def best(pairs: DataFrame, least: float = fixed.FUZZY_CONFIDENCE) -> DataFrame:
    """Each listing's candidate: an exact one before any other, then the highest confidence, the same category, the smaller product id.

    Exact is a pair of equal brands whose titles and confidence reach 95 and whose weights and quantities, where known, agree.
    """
    top = F.min(F.struct((~F.col("exact")).alias("e"), (-F.col("confidence")).alias("o"), (~F.col("same_category")).alias("c"), "product_id", "confidence", "exact")).alias("b")
    rows = pairs.where(F.col("confidence") >= least).groupBy("listing_id").agg(top)
    kind = F.when(F.col("b.exact"), "exact").otherwise("fuzzy")
    return rows.select("listing_id", F.col("b.product_id").alias("product_id"), F.col("b.confidence").cast("decimal(5,2)").alias("confidence_score"), kind.alias("match_type"))


def new_products(listings: DataFrame) -> DataFrame:
    """One product for each (brand, title, weight, quantity) of listings without a match, and its listings.

    All listings are matched against the existing products first, then those left are grouped, so the result doesn't
    depend on an order of processing.
    """
    rows = prepared(listings, "", "title")
    return rows.groupBy("brand", "title", "weight", "quantity").agg(F.min("id").alias("product_id"), F.sort_array(F.collect_list("id")).alias("listing_ids"))


def match(listings: DataFrame, products: DataFrame, matches: DataFrame) -> DataFrame:
    """Matches of all unmatched listings: existing products where one is near enough, else new ones (exact, 100).

    New products are those of ``new_products``. Candidates are found once: a listing without one is told by the join with the best ones.
    """
    todo = unmatched(listings, matches)
    rows = todo.select("id", "title", "brand", *measures(todo, "")).hint("merge").join(best(candidates(todo, products)).withColumnRenamed("listing_id", "id"), "id", "left")
    is_new = F.col("product_id").isNull()
    group = (normalize_brand(F.col("brand")), normalize_title(F.col("title")), F.col("weight"), F.col("quantity"))
    each = Window.partitionBy(*[F.when(is_new, c) for c in group], F.when(~is_new, F.col("id"))).orderBy("id")
    rows = rows.select("id", "product_id", "confidence_score", "match_type", is_new.alias("is_new"), F.min("id").over(each).alias("first"), F.row_number().over(each).alias("n"))
    return rows.where("is_new OR n = 1").select(
        F.col("id").alias("listing_id"),
        F.coalesce("product_id", "first").alias("product_id"),
        F.coalesce("confidence_score", F.lit(100).cast("decimal(5,2)")).alias("confidence_score"),
        F.coalesce("match_type", F.lit("exact")).alias("match_type"),
        "is_new",
    )
