"""Fetched pages (page_id, url, html) as tables of links, next pages, titles, and what their structured data tells.

Pages are read with regular expressions and Spark's JSON functions, so nothing leaves the JVM. Every row of a page stays a
row of Spark's plan: wide pages explode, they don't loop. What stands in elements is read by ``extractors``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside.functions import urls
from quayside.functions.text import review_id, unescape

BLOCKED = "captcha|robot check|access denied|blocked"
OFFER = "struct<price:string,availability:string,name:string,gtin13:string>"
REVIEW = "struct<reviewRating:struct<ratingValue:string>,ratingValue:string,author:string,reviewBody:string,description:string,datePublished:string,name:string,headline:string,upvoteCount:string,verifiedPurchase:string>"


def tag_text(html: Column, tag: str) -> Column:
    """The text of the first element of a kind, without tags, or null."""
    inner = urls.extracted(html, rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}\s*>")
    return F.nullif(unescape(F.trim(F.regexp_replace(F.regexp_replace(inner, r"(?s)<[^>]*>", " "), r"\s+", " "))), F.lit(""))


def hrefs(html: Column) -> Column:
    """Distinct addresses of links, in order."""
    return F.array_distinct(F.regexp_extract_all(html, F.lit(r"(?is)<a\s[^>]*?href=[\"']([^\"']*)[\"']"), F.lit(1)))


def links(pages: DataFrame) -> DataFrame:
    """page_id, position, href, link: all distinct links of pages, absolute."""
    rows = pages.select("page_id", "url", F.posexplode(hrefs(F.col("html"))).alias("position", "href"))
    return rows.select("page_id", "position", "href", urls.resolve(F.col("href"), F.col("url")).alias("link"))


def product_links(pages: DataFrame) -> DataFrame:
    """Links to products of known retailers, one row for each page and address."""
    found = links(pages).where(urls.is_product(F.col("link"))).dropDuplicates(["page_id", "link"])
    kind = urls.category(F.col("link"))
    return found.select("page_id", "link", urls.retailer_of(F.col("link")).alias("retailer"), urls.external_id(F.col("link")).alias("external_id"), kind.alias("category"))


def titles(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", tag_text(F.col("html"), "title").alias("title"), tag_text(F.col("html"), "h1").alias("heading"))


def json_ld(html: Column) -> Column:
    """The first structured Product of a page as JSON text, also from within @graph, or null."""
    scripts = F.regexp_extract_all(html, F.lit(r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"), F.lit(1))
    graph = F.flatten(F.transform(scripts, lambda s: F.coalesce(F.from_json(F.get_json_object(s, "$.@graph"), "array<string>"), F.array(s))))
    return F.get(F.filter(graph, lambda j: F.get_json_object(j, "$.@type").isin("Product", '["Product"]')), F.lit(0))


def _either(json: Column, *paths: str) -> Column:
    return F.coalesce(*[F.nullif(F.trim(F.get_json_object(json, p)), F.lit("")) for p in paths])


def reviews(pages: DataFrame) -> DataFrame:
    """Reviews in the structured data of pages that aren't blocked; those without rating or text are left out."""
    html = F.col("html")
    rows = pages.where(~F.lower(html).rlike(BLOCKED)).select("page_id", "url", F.posexplode(F.from_json(F.get_json_object(json_ld(html), "$.review"), f"array<{REVIEW}>")).alias("index", "r"))
    rating = F.coalesce(F.col("r.reviewRating.ratingValue"), F.col("r.ratingValue")).try_cast("double")
    author = F.coalesce(F.get_json_object("r.author", "$.name"), F.col("r.author"))
    body = F.coalesce(F.nullif("r.reviewBody", F.lit("")), F.nullif("r.description", F.lit("")))
    found = rows.select(
        "page_id", review_id(F.coalesce(urls.retailer_of(F.col("url")), F.lit("unknown")), F.col("url"), author, body, F.col("index")).alias("external_id"),
        rating.alias("rating"), author.alias("author"), F.coalesce("r.name", "r.headline").alias("title"), body.alias("body"),
        F.coalesce(F.col("r.verifiedPurchase").try_cast("boolean"), F.lit(False)).alias("verified_purchase"),
        review_date(F.col("r.datePublished")).alias("review_date"), F.coalesce(F.col("r.upvoteCount").try_cast("int"), F.lit(0)).alias("helpful_count"),
    )
    return found.where("rating > 0 and body is not null")


def review_date(text: Column) -> Column:
    """'2024-01-15', '15 January 2024', 'Reviewed on 15th Jan 2024' as a date, else null."""
    day = F.regexp_replace(F.regexp_extract(text, r"(\d{1,2}(?:st|nd|rd|th)?\s+\w+\s+\d{4})", 1), r"(?<=\d)(st|nd|rd|th)\b", "")
    stamp = F.regexp_extract(text, r"(\d{4}-\d{2}-\d{2})", 1)
    read = lambda c, f: F.try_to_timestamp(F.nullif(c, F.lit("")), F.lit(f)).cast("date")
    return F.coalesce(read(stamp, "yyyy-MM-dd"), read(day, "d MMMM yyyy"), read(day, "d MMM yyyy"))
