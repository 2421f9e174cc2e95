"""Queries that read pages by their elements: the driver's pages, and pages made of its other tables, whose ids are negative."""

from __future__ import annotations

from pyspark.sql import functions as F

from quayside.functions import fixed
from quayside.plans.base import case
from quayside.sources import elements as E, extractors as X, pages as P, selecting as S, shop_pages as M, tables as T

def _pages(spark, sf_dir):
    return T.scan(spark, sf_dir, "pages").select("page_id", "url", "html")


def _with_made(spark, sf_dir, made):
    return _pages(spark, sf_dir).unionByName(made(spark, sf_dir).withColumn("page_id", -1 - F.col("page_id")))


def _elements(spark, sf_dir):
    rows = E.by_page(_pages(spark, sf_dir))
    out = E.with_contents(E.elements(rows), rows)
    a = F.col("attributes")
    return out.select("page_id", "pre", "post", "depth", "parent", "tag", a["class"].alias("class"), a["href"].alias("href"), F.md5("text").alias("text_md5"), F.char_length("html").alias("html_length"))


RULES = (
    ("any", "link", 0, 'nav > ul li a[href^="/"]'), ("any", "bold", 0, "section b, article b"), ("any", "bold", 1, "b"), ("any", "first", 0, ".none"), ("any", "first", 1, "article p"), ("any", "advert", 0, "div.ad:not(.big)"),
)


def _selected(spark, sf_dir):
    rows = E.by_page(_pages(spark, sf_dir))
    found = S.matches(E.elements(rows).withColumn("retailer", F.lit("any")), S.compile_rules(spark, RULES))
    return S.select_all(found).select("page_id", "field", "rank", "pre", "tag")


def _first(spark, sf_dir):
    rows = E.by_page(_pages(spark, sf_dir))
    found = E.with_contents(S.matches(E.elements(rows).withColumn("retailer", F.lit("any")), S.compile_rules(spark, RULES)), rows)
    # of the paragraphs of an article only the first is looked at
    chosen = S.select_first(found, F.when(F.col("field") == "first", F.char_length("text") > 100).otherwise(F.col("text") != ""))
    return chosen.select("page_id", "field", "rank", "pre", F.md5("text").alias("text_md5"))


def _details(spark, sf_dir):
    out = X.details(_with_made(spark, sf_dir, M.product_pages))
    return out.select(
        "page_id", "retailer", "title", "description", "brand", "price_pence", "original_price_pence", "member_price_pence", "rollback_price_pence", F.col("offer.quantity").alias("offer_quantity"), F.col("offer.price_pence").alias("offer_pence"),
        "currency", "weight_grams", "quantity", F.array_join("images", " ").alias("images"), "ingredients", "in_stock", "external_id", "category", "barcode",
    )


def _html_reviews(spark, sf_dir):
    return X.reviews(_with_made(spark, sf_dir, M.review_pages))


def _listing_urls(spark, sf_dir):
    return X.listing_urls(_with_made(spark, sf_dir, M.list_pages))


QUERIES = {
    "page_elements": _elements,
    "page_select_all": _selected,
    "page_select_first": _first,
    "page_details": _details,
    "page_reviews": _html_reviews,
    "page_listing_urls": _listing_urls,
    "page_nutrition": lambda s, d: X.nutrition(_with_made(s, d, M.product_pages)).select("page_id", F.explode("nutrition").alias("name", "value")),
    "page_next": lambda s, d: X.next_pages(_with_made(s, d, M.list_pages)),
    "page_link_addresses": lambda s, d: P.links(_with_made(s, d, M.list_pages)).select("page_id", "link"),
    "page_product_links": lambda s, d: P.product_links(_with_made(s, d, M.list_pages)),
}

# fixed values: character references in the order in which they are resolved
_REFERENCES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&pound;", "£"), ("&nbsp;", " "), ("&amp;", "&"))


def _unescape(c: str) -> str:
    for a, b in _REFERENCES:
        c = f"replace({c}, '{a}', '{b}')"
    return c


def _tidy(c: str) -> str:
    return f"trim(regexp_replace({c}, '[ \\n\\r\\t\\f]+', ' ', 'g'))"


_TOKEN = r"""(?is)<!--.*?-->|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<[!?][^>]*>|</?[a-z](?:[^>"'']+|"[^"]*"|''[^'']*'')*>|[^<]+|<"""
_LIST = lambda names: ", ".join(f"'{x}'" for x in names)
_ATTRIBUTE = lambda name: f"""coalesce(nullif(regexp_extract(token, '(?i)\\s{name}\\s*=\\s*"([^"]*)"', 1), ''), nullif(regexp_extract(token, '(?i)\\s{name}\\s*=\\s*''([^'']*)''', 1), ''))"""

#: The table of elements of ``pages``: the same steps as sources.elements, crossing pairs by comparison.
_ELEMENTS = f"""
cut AS (SELECT page_id, regexp_extract_all(html, '{_TOKEN}') AS l FROM pages),
tok AS (SELECT page_id, unnest(l) AS token, unnest(range(len(l))) AS i FROM cut),
kinds AS (SELECT page_id, i, token, CASE WHEN txt THEN '' ELSE lower(regexp_extract(token, '^</?([a-zA-Z][a-zA-Z0-9:-]*)', 1)) END AS tag, txt
          FROM (SELECT *, NOT regexp_matches(token, '^<[!?/a-zA-Z]') OR token = '<' AS txt FROM tok)),
kind AS (SELECT *, CASE WHEN txt THEN 'text' WHEN regexp_matches(token, '^<[!?]') THEN 'other' WHEN starts_with(token, '</') THEN 'close'
                        WHEN tag IN ('script', 'style') AND regexp_matches(token, '(?is)</' || tag || '\\s*>$') THEN 'empty' WHEN tag IN ({_LIST(E.VOID)}) OR ends_with(token, '/>') THEN 'empty' ELSE 'open' END AS kind,
                length(token) AS h, CASE WHEN txt THEN {_unescape("token")} ELSE '' END AS said FROM kinds),
sums AS (SELECT *, sum(h) OVER w AS h_end, sum(length(said)) OVER w AS t_end,
                sum(CASE kind WHEN 'open' THEN 1 WHEN 'close' THEN -1 ELSE 0 END) OVER (PARTITION BY page_id, tag ORDER BY i) + (kind = 'close')::INT AS level
         FROM kind WINDOW w AS (PARTITION BY page_id ORDER BY i)),
paired AS (SELECT *, CASE WHEN kind = 'open' AND lead(kind) OVER w = 'close' THEN lead(i) OVER w END AS c0, kind = 'close' AND lag(kind) OVER w = 'open' AS s0, lag(i) OVER w AS o0
           FROM sums WINDOW w AS (PARTITION BY page_id, tag, level, kind IN ('open', 'close') ORDER BY i)),
bad AS (SELECT DISTINCT b.page_id, b.i FROM paired a JOIN paired b ON a.page_id = b.page_id AND a.i < b.i AND b.i < a.c0 AND a.c0 < b.c0),
pair AS (SELECT p.*, CASE WHEN b.i IS NULL THEN c0 END AS closing, s0 AND z.i IS NULL AS closes FROM paired p LEFT JOIN bad b ON p.page_id = b.page_id AND p.i = b.i LEFT JOIN bad z ON p.page_id = z.page_id AND p.o0 = z.i AND p.s0),
deep AS (SELECT *, sum(CASE WHEN closing IS NOT NULL THEN 1 WHEN closes THEN -1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY i) - CASE WHEN closing IS NOT NULL THEN 1 WHEN closes THEN -1 ELSE 0 END AS inside FROM pair),
stop AS (SELECT *, CASE WHEN kind = 'open' AND closing IS NULL THEN coalesce(least(
              CASE WHEN tag IN ({_LIST(E.CONTAINERS)}) THEN NULL {" ".join(f"WHEN tag IN ({_LIST(k for k, v in E.ENDED_BY.items() if v == names)}) THEN min(i) FILTER (kind IN ('open', 'empty') AND tag IN ({_LIST(names)})) OVER w" for names in sorted(set(E.ENDED_BY.values())))}
                   ELSE min(i) FILTER (kind IN ('open', 'empty') AND tag IN ({_LIST(E.BLOCKS)})) OVER w END, min(i) FILTER (closes) OVER w), max(i) OVER (PARTITION BY page_id) + 1) END AS ending
         FROM deep WINDOW w AS (PARTITION BY page_id, inside ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
el AS (SELECT page_id, i AS pre, CASE WHEN kind = 'empty' THEN i ELSE coalesce(closing, ending - 1) END AS post, tag, token, h_end, t_end, CASE WHEN kind = 'empty' THEN i WHEN closing IS NOT NULL THEN closing - 1 ELSE ending - 1 END AS last_in
       FROM stop WHERE kind IN ('open', 'empty')),
placed AS (SELECT e.*, s.h_end - e.h_end AS html_length, e.t_end AS text_from, s.t_end AS text_to FROM el e JOIN sums s ON s.page_id = e.page_id AND s.i = e.last_in),
nested AS (SELECT b.page_id, b.pre, count(a.pre) AS depth, max(a.pre) AS parent FROM el b LEFT JOIN el a ON a.page_id = b.page_id AND a.pre < b.pre AND a.post >= b.post GROUP BY ALL),
said AS (SELECT page_id, string_agg(said, '' ORDER BY i) AS said FROM kind GROUP BY page_id),
elements AS (SELECT p.page_id, p.pre, p.post, n.depth, n.parent, p.tag, {_ATTRIBUTE("class")} AS class, {_ATTRIBUTE("href")} AS href, {_tidy("substr(said, CAST(text_from + 1 AS BIGINT), CAST(text_to - text_from AS BIGINT))")} AS text, html_length
             FROM placed p JOIN nested n USING (page_id, pre) JOIN said USING (page_id))"""

_UNDER = lambda a, b: f"EXISTS (FROM elements x WHERE x.page_id = e.page_id AND x.pre < e.pre AND x.post >= e.post AND x.tag IN ({_LIST(a)}))" if b else ""
_FOUND = f"""
found AS (SELECT e.page_id, 'link' AS field, 0 AS rank, e.pre, e.tag, e.text FROM elements e JOIN elements li ON li.page_id = e.page_id AND li.tag = 'li' AND li.pre < e.pre AND li.post >= e.post
              JOIN elements ul ON ul.page_id = e.page_id AND ul.tag = 'ul' AND ul.pre < li.pre AND ul.post >= li.post JOIN elements nav ON nav.page_id = e.page_id AND nav.tag = 'nav' AND nav.pre = ul.parent
              WHERE e.tag = 'a' AND starts_with(e.href, '/')
          UNION SELECT page_id, 'bold', 0, pre, tag, text FROM elements e WHERE tag = 'b' AND {_UNDER(("section", "article"), True)}
          UNION SELECT page_id, 'bold', 1, pre, tag, text FROM elements WHERE tag = 'b'
          UNION SELECT page_id, 'first', 1, pre, tag, text FROM elements e WHERE tag = 'p' AND {_UNDER(("article",), True)}
          UNION SELECT page_id, 'advert', 0, pre, tag, text FROM elements WHERE tag = 'div' AND class = 'ad')"""

_SHOP = lambda key, values: case(f"{key} % {len(M.SHOPS)}", dict(enumerate(values)))


def _id(shop: str, key: str) -> str:
    letter, least = M.ADDRESSES[shop][1]
    return f"'{letter}' || lpad({key}::VARCHAR, CAST(greatest(length({key}::VARCHAR), {least}) AS INT), '0')"


_SHOP_ID = lambda key: f"CASE {key} % {len(M.SHOPS)} " + " ".join(f"WHEN {k} THEN {_id(s, key)}" for k, s in enumerate(M.SHOPS)) + " END"
_ADDRESS = lambda key: f"({_SHOP(key, [a[0].removesuffix('$') for a in M.ADDRESSES.values()])}) || ({_SHOP_ID(key)})"
_ORIGINS = ["/".join(a[0].split("/")[:3]) for a in M.ADDRESSES.values()]
_LIKE = lambda w: f"(regexp_matches({w}, '^[A-Z]') AND length({w}) > 1 AND lower({w}) NOT IN ({_LIST(fixed.BRAND_SKIP_WORDS)}))"
_QUOTED = ", ".join("'" + b.replace("'", "''") + "'" for b in fixed.KNOWN_BRANDS)
_BLOCKED = "regexp_matches(lower(coalesce(text, '')), 'captcha|robot check|access denied|blocked')"

ORACLE_SQL = {
    "page_elements": f"WITH {_ELEMENTS} SELECT page_id, pre, post, depth, parent, tag, class, href, md5(text) AS text_md5, html_length FROM elements",
    "page_select_all": f"WITH {_ELEMENTS}, {_FOUND} SELECT page_id, field, rank, pre, tag FROM (SELECT *, min(rank) OVER (PARTITION BY page_id, field) AS least FROM found) WHERE rank = least",
    "page_select_first": f"""WITH {_ELEMENTS}, {_FOUND} SELECT page_id, field, rank, pre, md5(text) AS text_md5 FROM (
        SELECT *, row_number() OVER (PARTITION BY page_id, field ORDER BY rank) AS k FROM (SELECT *, row_number() OVER (PARTITION BY page_id, field, rank ORDER BY pre) AS n FROM found)
        WHERE n = 1 AND CASE field WHEN 'first' THEN length(text) > 100 ELSE text <> '' END) WHERE k = 1""",
    "page_details": f"""WITH h1 AS (SELECT page_id, {_tidy(_unescape("regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]*>', '', 'g')"))} AS t FROM pages),
        words AS (SELECT page_id, t, list_filter(string_split(t, ' '), lambda x: x <> '' AND x <> '0') AS w FROM h1),
        parts AS (SELECT p_partkey AS k, p_partkey % 11 AS shop, p_size AS z, {case("p_type", T.PART_CATEGORIES, "p_type")} AS category, CAST(CAST(p_retailprice AS DECIMAL(18,2)) * 100 AS BIGINT) AS pence, * FROM part)
        SELECT page_id, NULL AS retailer, t AS title, NULL AS description,
               coalesce(list_filter([{_QUOTED}], lambda b: contains(lower(t), lower(b)))[1], CASE WHEN len(w) > 1 AND {_LIKE("w[1]")} THEN w[1] || CASE WHEN {_LIKE("w[2]")} THEN ' ' || w[2] ELSE '' END END) AS brand,
               0 AS price_pence, NULL AS original_price_pence, NULL AS member_price_pence, NULL AS rollback_price_pence, NULL AS offer_quantity, NULL AS offer_pence, 'GBP' AS currency, NULL AS weight_grams, NULL AS quantity,
               '' AS images, NULL AS ingredients, true AS in_stock, NULL AS external_id, NULL AS category, NULL AS barcode FROM words
        UNION ALL SELECT -1 - k, {_SHOP("k", M.SHOPS)}, CASE WHEN k % 7 = 0 THEN p_name || ' told' ELSE p_name END, 'Good food & more for pets', p_brand, pence, CASE WHEN z % 3 = 0 THEN CAST(floor(p_retailprice) AS BIGINT) * 100 + 10050 END,
               CASE WHEN z % 4 = 0 THEN 95 END, NULL, CASE WHEN z % 6 = 0 THEN 3 END, CASE WHEN z % 6 = 0 THEN 500 END, 'GBP', CAST(z AS BIGINT) * 100, NULL,
               CASE WHEN z % 2 = 0 THEN 'https://img.example.com/' || k || '.jpg' ELSE '' END, {case("z % 4", dict(enumerate(T.INGREDIENTS)))}, CASE WHEN k % 7 = 0 AND shop <> 0 THEN false ELSE z % 5 <> 0 END,
               {_SHOP_ID("k")}, category, CASE WHEN z % 2 = 0 THEN lpad(k::VARCHAR, 13, '0') END FROM parts""",
    "page_reviews": f"""WITH free AS (SELECT conv_id FROM conversations GROUP BY 1 HAVING NOT bool_or({_BLOCKED})),
        said AS (SELECT conv_id, turn, role, {_tidy("coalesce(text, '')")} AS body, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS n FROM conversations JOIN free USING (conv_id) WHERE {_tidy("coalesce(text, '')")} <> '')
        SELECT -1 - conv_id AS page_id, CASE WHEN turn % 3 = 0 THEN 'r-' || conv_id || '-' || turn ELSE ({_SHOP("conv_id", M.SHOPS)}) || '-review-' || md5({_ADDRESS("conv_id")} || role || body) || '-' || n END AS external_id,
               CAST((turn + conv_id) % 5 + 1 AS DOUBLE) AS rating, role AS author, NULL AS title, body, turn % 2 = 0 OR regexp_matches(body, '(?i)verified\\s+(purchase|buyer|owner)') AS verified_purchase,
               make_date(2024, 1, CAST(turn % 28 + 1 AS INT)) AS review_date, CAST(turn AS INT) AS helpful_count FROM said""",
    "page_listing_urls": f"""WITH l AS (SELECT p_partkey AS k, p_partkey % 11 AS shop, p_partkey // 220 AS page FROM part), g AS (SELECT DISTINCT shop, page FROM l)
        SELECT -1 - (page * 11 + shop) AS page_id, 'product' AS kind, {_ADDRESS("k")} AS url, {_SHOP("shop", M.SHOPS)} AS retailer, 'dog-food' AS category, {_SHOP_ID("k")} AS external_id, NULL::INT AS page FROM l
        UNION ALL SELECT -1 - (page * 11 + shop), 'product', 'https://groceries.asda.com/product/9' || page, 'asda', 'dog-food', '9' || page, NULL FROM g WHERE shop = {M.SHOPS.index("asda")}
        UNION ALL SELECT -1 - (page * 11 + shop), 'pagination', ({_SHOP("shop", _ORIGINS)}) || '/pets/?page=' || (page + 2), {_SHOP("shop", M.SHOPS)}, 'dog-food', NULL, CAST(page + 2 AS INT) FROM g WHERE page % 3 < 2""",
    "page_nutrition": """SELECT -1 - p_partkey AS page_id, 'Protein' AS name, p_size || '%' AS value FROM part WHERE p_partkey % 2 = 0
        UNION ALL SELECT -1 - p_partkey, 'Fat', '5.5%' FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT -1 - p_partkey, 'Crude fibre', p_size || '%' FROM part WHERE p_partkey % 2 = 1""",
    "page_next": f"""WITH g AS (SELECT DISTINCT p_partkey % 11 AS shop, p_partkey // 220 AS page FROM part)
        SELECT page_id, coalesce({", ".join(f"TRY_CAST(nullif(regexp_extract(url, '{p}', 1), '') AS INT)" for p in ("(?i)[?&]page=([0-9]{1,9})", "(?i)/page/([0-9]{1,9})", "(?i)/p/([0-9]{1,9})"))}, 1) AS page, NULL AS next_url FROM pages
        UNION ALL SELECT -1 - (page * 11 + shop), CAST(page + 1 AS INT), CASE WHEN page % 3 < 2 THEN ({_SHOP("shop", _ORIGINS)}) || '/pets/?page=' || (page + 2) END FROM g""",
    "page_link_addresses": f"""WITH l AS (SELECT DISTINCT page_id, url, unnest(regexp_extract_all(html, '(?is)<a\\s[^>]*?href=["'']([^"'']*)["'']', 1)) AS href FROM pages),
        parts AS (SELECT p_partkey AS k, p_partkey % 11 AS shop, p_partkey // 220 AS page, {_ADDRESS("p_partkey")} AS address FROM part), g AS (SELECT DISTINCT shop, page, {_SHOP("shop", _ORIGINS)} AS origin FROM parts)
        SELECT page_id, CASE WHEN regexp_matches(href, '^(?i)https?://') THEN href WHEN starts_with(href, '//') THEN regexp_extract(url, '^\\w+:') || href WHEN starts_with(href, '/') THEN regexp_extract(url, '^\\w+://[^/?#]+') || href
            ELSE regexp_replace(regexp_replace(url, '[?#].*$', ''), '([^:/])/[^/]*$', '\1') || '/' || href END AS link FROM l
        UNION ALL SELECT -1 - (page * 11 + shop), unnest([address, address]) FROM parts
        UNION ALL SELECT -1 - (page * 11 + shop), origin || '/help' FROM g
        UNION ALL SELECT -1 - (page * 11 + shop), origin || '/pets/' || unnest(CASE page % 3 WHEN 0 THEN ['?page=1', '?page=' || (page + 2)] WHEN 1 THEN ['#', '?page=' || (page + 2)] ELSE ['javascript:next()'] END) FROM g""",
    "page_product_links": f"""SELECT -1 - ((p_partkey // 220) * 11 + p_partkey % 11) AS page_id, {_ADDRESS("p_partkey")} AS link, {_SHOP("p_partkey", M.SHOPS)} AS retailer, {_SHOP_ID("p_partkey")} AS external_id,
        CASE WHEN p_partkey % 11 = {M.SHOPS.index("sainsburys")} THEN 'food--' || p_partkey END AS category FROM part""",
}
