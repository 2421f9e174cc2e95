"""Pages as shops would write them, made by Spark from the driver's tables, to read them back.

Each of eleven shops gets its own addresses and marks, taken from its extractor, so that what a page says is known from the
tables it was made of.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.sources import extractors as X, tables as T
from quayside.sources.selecting import _STEP, _simple

#: Each shop's address of a product, $ being its id; the letter before an id, and its least length.
ADDRESSES = {
    "bm": ("https://www.bmstores.co.uk/p/$", ("", 0)),
    "pets-at-home": ("https://www.petsathome.com/product/food/$", ("P", 0)),
    "tesco": ("https://www.tesco.com/groceries/en-GB/products/$", ("", 0)),
    "asda": ("https://groceries.asda.com/product/food/$", ("", 0)),
    "sainsburys": ("https://www.sainsburys.co.uk/gol-ui/product/food--$", ("", 0)),
    "amazon-uk": ("https://www.amazon.co.uk/dp/$", ("", 10)),
    "morrisons": ("https://groceries.morrisons.com/products/food/$", ("", 0)),
    "just-for-pets": ("https://www.justforpetsonline.co.uk/p/$", ("", 0)),
    "waitrose": ("https://www.waitrose.com/ecom/products/food/$", ("", 0)),
    "ocado": ("https://www.ocado.com/products/food-$", ("", 0)),
    "zooplus-uk": ("https://www.zooplus.co.uk/shop/dogs/dry/food_$", ("", 6)),
}
SHOPS = tuple(ADDRESSES)


def shop_id(shop: str, key: Column) -> Column:
    letter, least = ADDRESSES[shop][1]
    text = key.cast("string")
    return F.concat(F.lit(letter), F.lpad(text, F.greatest(F.length(text), F.lit(least)), F.lit("0")))


def escaped(text: Column) -> Column:
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(sign), F.lit(entity))
    return text


def marked(selector: str, content: Column, extra: str = "") -> Column:
    """Markup that a selector selects, a tag within a tag for each step; a tag without content stays open."""
    opening, closing = "", ""
    steps = [_simple(m[2]) for m in _STEP.finditer(selector.split(",")[0])]
    for k, (tag, ident, classes, has, _) in enumerate(steps):
        name = tag or "div"
        parts = [name, *([f'id="{ident}"'] if ident else []), *([f"class='{' '.join(classes)}'"] if classes else []), *(f'{a}="{v}"' for a, _, v in has), *([extra] if k == len(steps) - 1 and extra else [])]
        opening += f"<{' '.join(parts)}>"
        closing = ("" if name in ("img", "input", "meta") else f"</{name}>") + closing
    return F.concat(F.lit(opening), content, F.lit(closing))


def _mark(shop: str, field: str, content: Column, extra: str = "") -> Column:
    own = X.OWN.get(shop, {}).get(field) or {**X.COMMON_DETAILS, **X.COMMON_REVIEWS}[field]
    return marked(own[0], content, extra)


def _by_shop(index: Column, value) -> Column:
    return F.coalesce(*[F.when(index == k, value(shop)) for k, shop in enumerate(SHOPS)])


def product_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, html: a page for each part, of the shop ``p_partkey % 11``; every seventh also has structured data."""
    part = T.scan(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")
    key, size = F.col("p_partkey"), F.col("p_size")
    amount = F.col("p_retailprice").cast("decimal(18,2)").cast("string")
    when = lambda on, c: F.when(on, c).otherwise("")
    category = F.coalesce(T.lookup(F.col("p_type"), T.PART_CATEGORIES), F.col("p_type"))

    def html(shop: str) -> Column:
        m = lambda field, content, extra="": _mark(shop, field, content, extra)
        crumbs = F.concat(F.lit("<nav class='breadcrumb'><a href=/>Home</a><ul><li><a href='/pets'>Pets</a><li><a href='/c'>"), escaped(category), F.lit("</a><li><a>"), escaped(F.col("p_brand")), F.lit("</a></ul></nav>"))
        data = F.concat(
            F.lit('<script type="application/ld+json">'), F.to_json(F.struct(F.lit("Product").alias("@type"), F.concat("p_name", F.lit(" told")).alias("name"), F.struct(amount.alias("price"), F.lit("https://schema.org/OutOfStock").alias("availability")).alias("offers"))), F.lit("</script>"),
        )
        image = F.concat(F.lit("<img data-lazy-src='https://img.example.com/"), F.when(size % 2 == 0, key.cast("string")).otherwise("placeholder"), F.lit(".jpg'>"))
        holder = (X.OWN.get(shop, {}).get("image") or X.COMMON_DETAILS["image"])[0].removesuffix(" img")
        return F.concat(
            F.lit("<!DOCTYPE html><html lang=en><head><title>Shop</title><style>h1{top:0}</style>"), when(key % 7 == 0, data), F.lit("</head><body><!-- <h1>no</h1> -->"), crumbs,
            F.lit("<div class=page><p>Welcome<p>to <b>us"), m("title", F.concat(F.lit(" \n <span>"), escaped(F.col("p_name")), F.lit("</span>"))),
            m("brand", escaped(F.col("p_brand"))), m("price", F.concat(F.lit(" £"), F.format_number(F.col("p_retailprice").cast("decimal(18,2)"), 2), F.lit(" "))),
            when(size % 3 == 0, m("original_price", F.concat(F.lit("&pound;"), (F.floor(F.col("p_retailprice")) + 100).cast("string"), F.lit(".5")))),
            when(size % 4 == 0, m("member_price", F.lit("95p"))), when(size % 6 == 0, m("offer", F.lit("Any 3 for £5"))),
            m("weight", F.concat(F.lit("Size: "), (size * 100).cast("string"), F.lit("g"))), m("description", F.lit("Good <b>food</b> &amp; more<br>\n for  pets")),
            when(size % 4 < 3, m("ingredients", F.coalesce(T.one_of(T.INGREDIENTS, size % 4), F.lit("")))), marked(holder, image) if holder.startswith((".", "#", "[")) else image,
            when(size % 5 == 0, m("out_of_stock", F.lit("Sold out"))), when(size % 2 == 0, F.concat(F.lit("<span class=ean data-ean="), F.lpad(key.cast("string"), 13, "0"), F.lit("></span>"))),
            F.when(key % 2 == 0, F.concat(F.lit("<table class=nutritional-info><tr><th>Protein</th><td> "), size.cast("string"), F.lit("%</td></tr><tr><td>Fat<td>5.5%<td>x<tr><td>Ash<td></table>"))).otherwise(F.concat(F.lit("<p class=analysis>Crude fibre: "), size.cast("string"), F.lit("% and more"))),
            F.lit("</div><footer><p>&copy; <i>end</footer></body></html>"),
        )

    index = key % len(SHOPS)
    url = lambda shop: F.concat(F.lit(ADDRESSES[shop][0].removesuffix("$")), shop_id(shop, key))
    return part.select(key.alias("page_id"), _by_shop(index, url).alias("url"), _by_shop(index, html).alias("html"))


def review_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, html: a page for each conversation, of the shop ``conv_id % 11``, with a review for each turn."""
    turn, conv = F.col("turn"), F.col("conv_id")
    rating = ((turn + conv) % 5 + 1).cast("int")
    form = (turn % 6).cast("int")

    def box(shop: str) -> Column:
        m = lambda field, content, extra="": _mark(shop, field, content, extra)
        stars = F.concat(F.lit("<div>"), F.repeat(F.lit("<i class='fa star-filled'></i>"), rating), F.repeat(F.lit("<i class='star-empty'></i>"), 5 - rating), F.lit("</div>"))
        told = (
            F.when(form == 1, F.concat(m("rating", F.concat(rating.cast("string"), F.lit(".0 out of 5")))))
            .when(form == 2, F.concat(F.lit("<meta itemprop=ratingValue content='"), rating.cast("string"), F.lit("'>"))).when(form == 3, stars)
            .when(form == 4, F.concat(F.lit("<div class='rating-stars' style='color: red; width: "), (rating * 20).cast("string"), F.lit("%'></div>"))).when(form == 5, F.concat(F.lit("<b class=stars>"), rating.cast("string"), F.lit("/5</b>"))).otherwise("")
        )
        inner = F.concat(
            told, m("author", escaped(F.coalesce("role", F.lit("")))), F.lit("<ul><li>one<li>two</ul>"), m("body", escaped(F.coalesce("text", F.lit("")))), F.lit("<time datetime='2024-01-"), F.lpad((turn % 28 + 1).cast("string"), 2, "0"), F.lit("'>some day</time>"),
            F.when(turn % 2 == 0, F.lit("<span class='badge badge-verified'>yes</span>")).otherwise(""), F.lit("<span class=helpful-count>"), turn.cast("string"), F.lit(" people found this helpful</span>"),
        )
        opening = m("review", F.lit("\u0001"))
        attributes = F.concat(F.when(form == 0, F.concat(F.lit(" data-rating="), rating.cast("string"))).otherwise(""), F.when(turn % 3 == 0, F.concat(F.lit(" data-review-id='r-"), conv.cast("string"), F.lit("-"), turn.cast("string"), F.lit("'"))).otherwise(""), F.lit(">"))
        head, tail = F.substring_index(opening, "\u0001", 1), F.substring_index(opening, "\u0001", -1)
        return F.concat(F.expr("''"), F.substring(head, F.lit(1), F.length(head) - 1), attributes, inner, tail)

    index = conv % len(SHOPS)
    rows = T.scan(spark, sf_dir, "conversations").select("conv_id", F.struct("turn", _by_shop(index, box).alias("box")).alias("t"))
    pages = rows.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("t")), lambda t: t["box"]), "\n").alias("boxes"))
    url = lambda shop: F.concat(F.lit(ADDRESSES[shop][0].removesuffix("$")), shop_id(shop, F.col("conv_id")))
    return pages.select(F.col("conv_id").alias("page_id"), _by_shop(F.col("conv_id") % len(SHOPS), url).alias("url"), F.concat(F.lit("<html><head><title>Reviews</title></head><body><div id=all>"), "boxes", F.lit("</div></body></html>")).alias("html"))


def list_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, html: a shop's parts, twenty a page; links come twice, with other links between, and the next page by mark or number."""
    key = F.col("p_partkey")
    n = len(SHOPS)
    rows = T.scan(spark, sf_dir, "part").select(key, (key % n).alias("shop"), F.floor(key / (20 * n)).alias("page"))

    def link(shop: str, key: Column) -> Column:
        address = ADDRESSES[shop][0].removesuffix("$")
        path = "/" + address.split("/", 3)[3]
        one, i = (lambda a: F.concat(F.lit(f"<li class='item'><a class=x href='{a}"), i, F.lit("'>see</a>"))), shop_id(shop, key)
        return F.concat(one(path), one(address), F.lit("<a href='/help'>help</a>"))

    grouped = rows.groupBy("shop", "page").agg(F.array_sort(F.collect_list("p_partkey")).alias("keys"))
    grouped = grouped.select("shop", "page", _by_shop(F.col("shop"), lambda shop: F.array_join(F.transform("keys", lambda k: link(shop, k)), "")).alias("links"))
    following = (F.col("page") + 2).cast("string")
    head = F.concat(F.lit("<nav class='my-pagination'><a href='?page=1'>1</a><a href='?page="), following, F.lit("'>"), following, F.lit("</a></nav>"))
    mark = F.concat(F.lit("<a rel='nofollow' href='#'>x</a><a rel=next href='?page="), following, F.lit("'>on</a>"))
    script = F.when(F.col("shop") == SHOPS.index("asda"), F.concat(F.lit("<script>var s = {\"productId\": \"9"), "page", F.lit("\"};</script>"))).otherwise("")
    origin = _by_shop(F.col("shop"), lambda s: F.lit("/".join(ADDRESSES[s][0].split("/")[:3])))
    url = F.concat(origin, F.lit("/pets/dog-food?page="), (F.col("page") + 1).cast("string"))
    html = F.concat(F.lit("<html><body><ul>"), "links", F.lit("</ul>"), F.when(F.col("page") % 3 == 0, head).when(F.col("page") % 3 == 1, mark).otherwise(F.lit("<a rel=next href='javascript:next()'>on</a>")), script, F.lit("</body></html>"))
    return grouped.select((F.col("page") * n + F.col("shop")).alias("page_id"), url.alias("url"), html.alias("html"))
