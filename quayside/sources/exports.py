"""Sinks: CSV and JSON exports, report files, file names, retention. Spark writes them in parallel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside.functions.text import money
from quayside.operators.filters import on_sale

ISO = "yyyy-MM-dd'T'HH:mm:ssXXX"


def pounds(pence: Column) -> Column:
    return F.replace(money(pence), F.lit("£"), F.lit(""))


def yes_no(flag: Column) -> Column:
    return F.when(flag, "Yes").otherwise("No")


def product_rows(products: DataFrame) -> DataFrame:
    """Products as they are exported: text only, prices in pounds."""
    times = [F.date_format(c, ISO).alias(c) for c in ("created_at", "updated_at") if c in products.columns]
    plain = [c for c in ("id", "name", "slug", "brand", "category", "canonical_category", "weight_grams", "quantity") if c in products.columns]
    prices = [pounds(F.col(f"{c}_pence")).alias(c) for c in ("lowest_price", "average_price") if f"{c}_pence" in products.columns]
    return products.select(*plain, *prices, yes_no(F.col("is_verified")).alias("verified"), *times)


def price_rows(products: DataFrame, matches: DataFrame, listings: DataFrame, retailers: DataFrame) -> DataFrame:
    """One row for each product and listing. Prices of 0 count as unknown; a listing of no known retailer has none."""
    known = lambda c: pounds(F.nullif(F.col(c), F.lit(0)))
    shops = retailers.select(F.col("id").alias("retailer_id"), F.col("name").alias("retailer"))
    url = [c for c in ("url",) if c in listings.columns]
    own = listings.select(F.col("id").alias("listing_id"), "retailer_id", "title", "price_pence", "original_price_pence", "in_stock", "last_scraped_at", *url).join(shops, "retailer_id", "left")
    rows = products.select(F.col("id").alias("product_id"), "name", "brand").join(matches.select("product_id", "listing_id"), "product_id").join(own, "listing_id")
    return rows.select(
        "product_id", "name", "brand", "retailer", "listing_id", "title", known("price_pence").alias("price"), known("original_price_pence").alias("original_price"),
        yes_no(on_sale()).alias("on_sale"), yes_no(F.col("in_stock")).alias("in_stock"), *url, F.date_format("last_scraped_at", ISO).alias("last_scraped"),
    )


LISTING = "struct<price_pence:bigint,listing_id:bigint,title:string,in_stock:boolean,retailer:struct<id:bigint,name:string,slug:string>>"


def nested(products: DataFrame, matches: DataFrame, listings: DataFrame, retailers: DataFrame) -> DataFrame:
    """(id, json) of each product with its listings, cheapest first, and each listing's retailer, null where unknown."""
    shops = retailers.select(F.col("id").alias("retailer_id"), F.struct("id", "name", "slug").alias("retailer"))
    priced = listings.select(F.col("id").alias("listing_id"), "retailer_id", "price_pence", "title", "in_stock").join(shops, "retailer_id", "left")
    own = matches.select("product_id", "listing_id").join(priced, "listing_id")
    lists = own.groupBy("product_id").agg(F.sort_array(F.collect_list(F.struct("price_pence", "listing_id", "title", "in_stock", "retailer"))).alias("listings"))
    rows = products.join(lists.withColumnRenamed("product_id", "id"), "id", "left")
    listed = F.coalesce("listings", F.array().cast(f"array<{LISTING}>")).alias("listings")
    return rows.select("id", F.to_json(F.struct("id", "name", "brand", listed), {"ignoreNullFields": "false"}).alias("json"))


def envelope(rows: DataFrame, exported_at: Column) -> DataFrame:
    """One row for the file beside an export's lines: how many there are, and when they were written."""
    return rows.agg(F.count(F.lit(1)).alias("count")).withColumn("exported_at", F.date_format(exported_at, ISO))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """Rows with a json column as lines, others as JSON objects."""
    if df.columns[-1] == "json":
        df.select("json").write.text(path)
    else:
        df.write.json(path)


def export(df: DataFrame, path: str, kind: str, exported_at, write=write_csv) -> DataFrame:
    """Write and return the log row of the run: kind, path, row_count, status, error. A failed run is logged, not raised."""
    from pyspark.sql import Observation

    spark, seen = df.sparkSession, Observation()
    schema = "kind string, path string, row_count long, status string, error_message string, completed_at timestamp"
    try:
        write(df.observe(seen, F.count(F.lit(1)).alias("n")), path)
    except Exception as e:
        return spark.createDataFrame([(kind, path, None, "failed", str(e).split("\n")[0][:200], exported_at)], schema)
    return spark.createDataFrame([(kind, path, seen.get["n"], "completed", None, exported_at)], schema)


def file_name(kind: Column, at: Column, extension: str) -> Column:
    return F.concat(kind, F.lit("_"), F.date_format(at, "yyyy-MM-dd_HHmmss"), F.lit(f".{extension}"))


def expired(exports: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """Exports to delete."""
    return exports.where(F.col("created_at") < as_of - F.expr(f"INTERVAL {int(days)} DAYS"))


def image_cache(urls: DataFrame) -> DataFrame:
    """One row for each address: the path it is kept under."""
    return urls.where("url is not null").dropDuplicates(["url"]).select("url", F.concat(F.sha2("url", 256), F.lit("."), F.coalesce(F.nullif(F.regexp_extract("url", r"\.(\w{3,4})(?:\?|$)", 1), F.lit("")), F.lit("jpg"))).alias("cached_path"))
