"""Reviews: sentiment of each, totals for each listing, summaries in words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quayside.functions import fixed, sentiment
from quayside.functions.numbers import round_to, rounded_ratio
from quayside.functions.text import list_in_words, lookup


def analyse(reviews: DataFrame) -> DataFrame:
    """listing_id, id, score, label, confidence, keywords and topics of each review."""
    return sentiment.analyse(reviews.select("listing_id", "id", "title", "body", "rating")).drop("title", "body", "rating")


def topics(reviews: DataFrame) -> DataFrame:
    """listing_id, id, praises and complaints of each review, without its score."""
    text = sentiment.review_text(F.col("title"), F.col("body"))
    return reviews.select("listing_id", "id", sentiment.topics(text, fixed.PRAISE_TOPICS).alias("praises"), sentiment.topics(text, fixed.COMPLAINT_TOPICS).alias("complaints"))


LISTS = {"praises": 5, "complaints": 5, "positive_keywords": 10, "negative_keywords": 10}


def frequent(scored: DataFrame, lists: dict[str, int] = LISTS) -> DataFrame:
    """The most frequent entries of each list column of each listing with their counts, ties in alphabetical order."""
    entries = F.concat(*[F.transform(c, lambda x: F.struct(F.lit(c).alias("kind"), x.alias("entry"))) for c in lists])  # noqa: B023
    counts = scored.select("listing_id", F.explode(entries).alias("x")).groupBy("listing_id", "x").agg(F.count(F.lit(1)).alias("n")).select("listing_id", "x.*", "n")
    order = F.row_number().over(Window.partitionBy("listing_id", "kind").orderBy(F.desc("n"), "entry"))
    top = counts.withColumn("r", order).where(F.col("r") <= max(lists.values()))
    ranked = F.sort_array(F.collect_list(F.struct("r", "kind", "entry", "n"))).alias("all")
    grouped = top.groupBy("listing_id").agg(ranked)
    of = lambda c, n: F.transform(F.filter("all", lambda x: (x["kind"] == c) & (x["r"] <= n)), lambda x: F.struct(x["entry"].alias("entry"), x["n"].alias("n"))).alias(c)
    return grouped.select("listing_id", *[of(c, n) for c, n in lists.items()])


def totals(scored: DataFrame) -> DataFrame:
    """Mean score, counts and shares of labels and mean confidence of each listing."""
    return shares(
        scored.groupBy("listing_id").agg(
            F.count(F.lit(1)).alias("total_reviews"), F.sum(thousandths("score")).alias("score"), F.sum(thousandths("confidence")).alias("confidence"),
            *[F.count_if(F.col("label") == x).alias(x) for x in LABELS],
        )
    )


LABELS = ("positive", "neutral", "negative")


def thousandths(c: str) -> Column:
    """Whole thousandths, so that sums don't depend on an order."""
    return F.round(F.col(c) * 1000).cast("long")


def shares(summed: DataFrame, *more: Column) -> DataFrame:
    """Means and percentages of each listing's sums, and ``more`` columns."""
    n = F.col("total_reviews")
    share = lambda c: rounded_ratio(F.col(c) * 100, n, 1)
    return summed.select(
        "listing_id", "total_reviews", *LABELS,
        (rounded_ratio(F.col("score"), n) / 1000).alias("average_score"),
        (rounded_ratio(F.col("confidence"), n * 10) / 100).alias("average_confidence"),
        *[share(x).alias(f"{x}_percent") for x in LABELS],
        *more,
    )


def summary(reviews: DataFrame) -> DataFrame:
    """Totals, frequent topics and keywords, and a text, for each listing with reviews.

    A review gives a row for its label, with its score, and a row for each of its entries, so that all is counted in one pass.
    """
    row = lambda kind, entry, score, sure: F.struct(F.lit(kind).alias("kind"), entry.alias("entry"), score.alias("score"), sure.alias("confidence"))
    none = F.lit(0).cast("long")
    entries = F.concat(F.array(row("label", F.col("label"), thousandths("score"), thousandths("confidence"))), *[F.transform(c, lambda x: row(c, x, none, none)) for c in LISTS])  # noqa: B023
    counts = analyse(reviews).select("listing_id", F.explode(entries).alias("x")).groupBy("listing_id", "x.kind", "x.entry").agg(F.count(F.lit(1)).alias("n"), F.sum("x.score").alias("score"), F.sum("x.confidence").alias("confidence"))
    order = F.row_number().over(Window.partitionBy("listing_id", "kind").orderBy(F.desc("n"), "entry"))
    top = counts.withColumn("r", order).where(F.col("r") <= max(LISTS.values()))
    label = F.col("kind") == "label"
    grouped = top.groupBy("listing_id").agg(
        F.sum(F.when(label, F.col("n"))).alias("total_reviews"), F.sum("score").alias("score"), F.sum("confidence").alias("confidence"),
        *[F.coalesce(F.sum(F.when(label & (F.col("entry") == x), F.col("n"))), none).alias(x) for x in LABELS],
        F.sort_array(F.collect_list(F.when(~label, F.struct("r", "kind", "entry", "n")))).alias("all"),
    )
    of = lambda c, n: F.transform(F.filter("all", lambda x: (x["kind"] == c) & (x["r"] <= n)), lambda x: F.struct(x["entry"].alias("entry"), x["n"].alias("n"))).alias(c)
    return shares(grouped, *[of(c, n) for c, n in LISTS.items()]).withColumn("summary", in_words())


def in_words() -> Column:
    count = F.concat(F.lit("Based on "), F.col("total_reviews").cast("string"), F.when(F.col("total_reviews") == 1, " review, ").otherwise(" reviews, "))
    label = sentiment.label_of(F.col("average_score"))
    shown = lambda c: F.concat(F.lit(" ("), F.col(c).cast("string"), F.lit("% "))
    overall = (
        F.when(label == "positive", F.concat(count, F.lit("customers are generally pleased with this product"), shown("positive_percent"), F.lit("positive).")))
        .when(label == "negative", F.concat(count, F.lit("customers have expressed concerns about this product"), shown("negative_percent"), F.lit("negative).")))
        .otherwise(F.concat(count, F.lit("customer opinions on this product are mixed.")))
    )
    topics = lambda c, table: list_in_words(F.transform(F.slice(c, 1, 3), lambda x: F.coalesce(lookup(x["entry"], table), x["entry"])))
    praise = F.when(F.size("praises") > 0, F.concat(F.lit("Customers commonly praise the "), topics("praises", fixed.PRAISE_LABELS), F.lit(".")))
    complaint = F.when(F.size("complaints") > 0, F.concat(F.lit("Some customers have mentioned "), topics("complaints", fixed.COMPLAINT_LABELS), F.lit(".")))
    return F.concat_ws(" ", overall, praise, complaint)


def newest(reviews: DataFrame, per_listing: int = 10) -> DataFrame:
    order = Window.partitionBy("listing_id").orderBy(F.desc("review_date"), F.desc("id"))
    return reviews.withColumn("r", F.row_number().over(order)).where(F.col("r") <= per_listing).drop("r")


def rating_of_products(reviews: DataFrame, matches: DataFrame, per_listing: int | None = 10) -> DataFrame:
    """Mean rating (one decimal) and count of each product, over the newest reviews of its listings, or all (None)."""
    rows = newest(reviews, per_listing) if per_listing else reviews
    rows = rows.join(matches.select("listing_id", "product_id"), "listing_id")
    rated = F.when(F.col("rating") > 0, F.round(F.col("rating") * 10).cast("long"))
    grouped = rows.groupBy("product_id").agg(F.count(F.lit(1)).alias("review_count"), F.sum(rated).alias("total"), F.count(rated).alias("rated"))
    return grouped.select("product_id", "review_count", (rounded_ratio(F.col("total"), F.col("rated")) / 10).alias("average_rating"))


def unanalysed(reviews: DataFrame, analysed: DataFrame) -> DataFrame:
    """Reviews without a stored analysis."""
    return reviews.join(analysed.select("id"), "id", "left_anti")


def rounded_score(scored: DataFrame) -> DataFrame:
    return scored.withColumn("score", round_to(F.col("score"), 3))
