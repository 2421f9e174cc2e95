"""Pages as a table of elements, numbered by intervals.

A page's tags and texts come out of one regular expression; a small helper pairs the opening and closing tags of a page. Elements that
are never closed end where HTML ends them: before the next element that can't stand inside, or with the element around. A holds B just
where A's interval (pre, post) holds B's, and an element's text is a piece of its page's text. Pages are dealt out by their ids once;
elements, selectors and fields are then found where their page is.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from itertools import accumulate, chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, MapType, StringType, StructField, StructType

from quayside.functions.text import REFERENCES, unescape

TOKEN = (
    r"(?is)<!--.*?-->|<script\b[^>]*+>.*?</script\s*+>|<style\b[^>]*+>.*?</style\s*+>|<[!?][^>]*+>"
    r"|</?[a-z](?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|[^<]++|<"
)
ATTRIBUTE = r"([a-zA-Z_:@][a-zA-Z0-9_:.@-]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?"
# fixed values: HTML's elements without content, and those that only another element's end or start closes
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
CONTAINERS = ("html", "head", "body", "div", "section", "article", "main", "nav", "aside", "header", "footer", "ul", "ol", "dl", "table", "thead", "tbody", "tfoot", "form", "select")
BLOCKS = ("p", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "blockquote", "li", "dt", "dd", "tr", "td", "th", *CONTAINERS)
#: Of elements left open: the group of openings that ends them. Others that aren't containers end before the next block.
ENDED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th", "tr"), "th": ("td", "th", "tr"), "option": ("option",)}


def tokens(html: Column) -> Column:
    """All of the page in order: tags, texts, scripts and comments."""
    return F.regexp_extract_all(html, F.lit(TOKEN), F.lit(0))


def is_text(token: Column) -> Column:
    return ~token.rlike(r"(?i)^<[!?/a-z]") | (token == "<")


def page_text(html: Column) -> Column:
    """All texts of a page end to end, without tags, scripts and styles, entities resolved."""
    return F.array_join(F.transform(F.filter(tokens(html), is_text), unescape), "")


def tidy(text: Column) -> Column:
    """White space as a browser shows it."""
    return F.trim(F.regexp_replace(text, r"[ \n\r\t\f]+", " "))


_NUMBERS = {"pre": pa.int32(), "post": pa.int32(), "depth": pa.int64(), "parent": pa.int32(), "html_from": pa.int64(), "html_to": pa.int64(), "text_from": pa.int64(), "text_to": pa.int64()}
ELEMENT = StructType(
    [*(StructField(n, IntegerType() if kind == pa.int32() else LongType()) for n, kind in _NUMBERS.items()), StructField("tag", StringType()), StructField("attributes", MapType(StringType(), StringType()))]
)
OTHER, OPEN, CLOSE, EMPTY = range(4)


def paired(tags: list[str], kinds: list[int]) -> dict[int, int]:
    """The opening tags that are closed, and by which: within a tag and a level, by the next one, if that is a closing tag.

    A pair that begins inside another and ends after it isn't one: its opening tag was never closed.
    """
    level: dict[str, int] = {}
    last: dict[tuple[str, int], int | None] = {}
    closing: dict[int, int] = {}
    for i, (tag, kind) in enumerate(zip(tags, kinds, strict=True)):
        if kind == OPEN:
            level[tag] = level.get(tag, 0) + 1
            last[tag, level[tag]] = i
        elif kind == CLOSE:
            level[tag] = level.get(tag, 0) - 1
            opened, last[tag, level[tag] + 1] = last.get((tag, level[tag] + 1)), None
            if opened is not None:
                closing[opened] = i
    around: list[int] = []  # ends of the pairs that are open, the innermost last
    kept = {}
    for i, to in sorted(closing.items()):
        while around and around[-1] < i:
            around.pop()
        if not around or around[-1] > to:
            around.append(to)
            kept[i] = to
    return kept


def ended(tags: list[str], kinds: list[int], closing: dict[int, int]) -> dict[int, int]:
    """Of the opening tags that are never closed, the place before which their elements end.

    It is the next one in the same closed element that can't stand inside, or that element's end; else the page's.
    """
    closes, inside, depth = set(closing.values()), [], 0
    for i in range(len(tags)):
        inside.append(depth)
        depth += (i in closing) - (i in closes)
    following: dict[tuple, int] = {}  # by what ends an element, and the number of closed elements around
    ends = {}
    for i in range(len(tags) - 1, -1, -1):
        tag, at = tags[i], inside[i]
        if kinds[i] == OPEN and i not in closing:
            by = None if tag in CONTAINERS else ENDED_BY.get(tag, BLOCKS)
            ends[i] = min(following.get((by, at), len(tags)), following.get((CLOSE, at), len(tags)))
        if i in closes:
            following[CLOSE, at] = i
        elif kinds[i] in (OPEN, EMPTY):
            for names in _ENDS.get(tag, ()):
                following[names, at] = i
    return ends


#: For each tag, the groups of openings that it belongs to.
_ENDS = {tag: [names for names in {BLOCKS, *ENDED_BY.values()} if tag in names] for tag in {*BLOCKS, *(t for names in ENDED_BY.values() for t in names)}}


def kind_of(token: str) -> tuple[int, str]:
    """What a token is, and the tag it names."""
    if token[0] != "<" or token == "<" or not _MARKUP.match(token):
        return OTHER, ""
    name = _NAME.match(token)
    if not name:
        return OTHER, ""
    tag = name[1].lower()
    if token[1] == "/":
        return CLOSE, tag
    return EMPTY if tag in VOID or token.endswith("/>") or token[1] in "sS" and _RAW.match(token) else OPEN, tag


def attributes(token: str) -> list[tuple[str, str]]:
    """The attributes of an opening tag, names in lower case, the first of a name counting."""
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(_END.sub("", _TAIL.match(token)[1])):
        found.setdefault(m[1].lower(), resolved(m[2] or m[3] or m[4] or ""))
    return list(found.items())


def resolved(text: str) -> str:
    """As ``unescape``."""
    if "&" in text:
        for entity, sign in REFERENCES.items():
            text = text.replace(entity, sign)
    return text


_MARKUP, _NAME = re.compile(r"<[!?/a-zA-Z]"), re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*)")
_RAW = re.compile(r"<(script|style)\b.*</\1\s*>\Z", re.I | re.S | re.A)
_TAIL, _END = re.compile(r"<[a-zA-Z][a-zA-Z0-9:-]*((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)", re.S), re.compile(r"/\s*$", re.A)
_ATTRIBUTE = re.compile(ATTRIBUTE, re.A)


def nested(tokens: list[str]) -> list[tuple]:
    """The elements of one page as rows of ``ELEMENT``, from all of its tokens in order."""
    kinds, tags = zip(*map(kind_of, tokens), strict=True) if tokens else ((), ())
    closing = paired(tags, kinds)
    ends = ended(tags, kinds, closing) if kinds.count(OPEN) > len(closing) else {}
    html = [0, *accumulate(map(len, tokens))]
    text = [0, *accumulate(0 if k != OTHER or x != "<" and _MARKUP.match(x) else len(resolved(x)) for k, x in zip(kinds, tokens, strict=True))]
    found, around, posts = [], [], []
    for i, kind in enumerate(kinds):
        if kind not in (OPEN, EMPTY):
            continue
        end = i + 1 if kind == EMPTY else closing[i] if i in closing else ends[i]
        post = end if i in closing else end - 1
        while around and around[-1][1] < i:
            around.pop()
        # elements left open can overlap: those around are the ones that end no earlier
        parent = next((pre for pre, to in reversed(around) if to >= post), None)
        found.append((i, post, len(posts) - bisect_left(posts, post), parent, html[i + 1], html[end], text[i + 1], text[end], tags[i], attributes(tokens[i])))
        around.append((i, post))
        insort(posts, post)
    return found


@F.arrow_udf(ArrayType(ELEMENT))
def nesting(pages: pa.Array) -> pa.Array:
    """``nested`` of each page, a page being the array of its tokens."""
    rows = [nested(p or []) for p in pages.to_pylist()]
    columns = list(zip(*chain.from_iterable(rows), strict=True)) or [()] * len(ELEMENT)
    numbers = [pa.array(c, kind) for c, kind in zip(columns, _NUMBERS.values(), strict=False)]
    values = pa.StructArray.from_arrays([*numbers, pa.array(columns[-2], pa.string()), pa.array(columns[-1], pa.map_(pa.string(), pa.string()))], ELEMENT.names)
    return pa.ListArray.from_arrays(pa.array([0, *accumulate(map(len, rows))], pa.int32()), values)


def by_page(pages: DataFrame, least: int = 200) -> DataFrame:
    """``pages`` dealt out by page_id, once for all that follows.

    The number of parts is given, as Spark would choose it by the compressed size: pages are much alike, and their elements many times as large.
    """
    return pages.repartition(max(least, int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "page_id")


def elements(pages: DataFrame, *keep: str) -> DataFrame:
    """page_id, pre, post, depth, parent, tag, attributes, html_from, html_to, text_from, text_to of every element of ``pages``.

    pre is the place of its opening tag among the page's tags and texts, post that of the last one inside or of its closing tag;
    parent is the pre of the element around, null at the top. The others are places in the page's html (what is inside the element)
    and in ``page_text``, from 0. A page without html has no elements; page_id must be unique. ``keep``: columns of pages that come too.
    """
    found = pages.select("page_id", *keep, F.inline(nesting(tokens(F.col("html")))))
    return found.select("page_id", "pre", "post", "depth", "parent", "tag", "attributes", "html_from", "html_to", "text_from", "text_to", *keep)


def with_contents(found: DataFrame, pages: DataFrame) -> DataFrame:
    """``found`` (elements) with html and text: what is inside, the text with its white space tidied."""
    texts = pages.select("page_id", F.col("html").alias("_html"), page_text(F.col("html")).alias("_text"))
    part = lambda name, a, b: F.substring(F.col(name), F.col(a) + 1, F.col(b) - F.col(a))
    joined = found.join(texts, "page_id")
    return joined.withColumns({"html": part("_html", "html_from", "html_to"), "text": tidy(part("_text", "text_from", "text_to"))}).drop("_html", "_text")
