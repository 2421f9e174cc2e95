"""Selectors as rows, joined to the table of elements.

A rule says which elements of a retailer's pages hold a field, and its rank among the field's rules. ``compile_rules`` turns each
selector's steps into rows; ``matches`` joins them to elements by one key (an id, class, attribute or tag) and checks the
rest. Steps are put together by interval: an element lies inside some match of the step before if, of the matches that begin
before it, the one that ends last ends after it. So neither pages nor rules are looped over.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ATTRIBUTE_TEST = "struct<name:string,op:string,value:string>"
RULE_SCHEMA = (
    "rule int, retailer string, field string, rank int, selector int, step int, last boolean, child boolean, key string, tag string, id string, classes array<string>, "
    f"has array<{ATTRIBUTE_TEST}>, hasnt array<{ATTRIBUTE_TEST}>"
)
_STEP = re.compile(r"\s*(>)?\s*((?:\[[^\]]*\]|:not\([^)]*\)|[^\s>\[,])+)")
_PART = re.compile(r"""(?P<not>:not\((?P<inner>[^)]*)\))|\[(?P<name>[\w-]+)\s*(?:(?P<op>[*^$~]?=)\s*["']?(?P<value>[^"'\]]*)["']?\s*)?\]|(?P<sign>[.#:]?)(?P<word>[\w-]+)""")


def _simple(text: str) -> tuple[str | None, str | None, list[str], list[tuple], list[tuple]]:
    """tag, id, classes, attribute tests that hold and that don't, of one step such as ``h1.title[data-x="1"]:not(.old)``."""
    tag, ident, classes, has, hasnt, end = None, None, [], [], [], 0
    for m in _PART.finditer(text):
        if m.start() != end:
            break
        end = m.end()
        if m["not"]:
            inner = _simple(m["inner"])
            hasnt += [*inner[3], *[("class", "word", c) for c in inner[2]], *([("id", "=", inner[1])] if inner[1] else [])]
        elif m["name"]:
            has.append((m["name"].lower(), m["op"] or "", m["value"] or ""))
        elif m["sign"] == ".":
            classes.append(m["word"])
        elif m["sign"] == "#":
            ident = m["word"]
        elif m["sign"] == ":":
            if m["word"] != "checked":
                raise ValueError(f"not supported: {text}")
            has.append(("selected", "", ""))
        else:
            tag = m["word"].lower()
    if end != len(text):
        raise ValueError(f"not a selector: {text}")
    return tag, ident, classes, has, hasnt


def compile_rules(spark: SparkSession, rules: Iterable[tuple[str, str, int, str]]) -> DataFrame:
    """Rows of ``RULE_SCHEMA`` from (retailer, field, rank, selector).

    Selectors may have tags, #ids, .classes, [attributes] with =, *=, ^=, $= or ~=, :not(...) of one of these, :checked, spaces for
    descendants, > for children, and commas for alternatives of one rank.
    """
    rows, selector = [], 0
    for rule, (retailer, field, rank, text) in enumerate(rules):
        for alternative in text.split(","):
            steps, end = [], 0
            for m in _STEP.finditer(alternative):
                steps.append((bool(m[1]), _simple(m[2])))
                end = m.end()
            if not steps or alternative[end:].strip():
                raise ValueError(f"not a selector: {text}")
            for k, (child, (tag, ident, classes, has, hasnt)) in enumerate(steps):
                key = f"#{ident}" if ident else f".{classes[0]}" if classes else f"[{has[0][0]}" if has else tag
                if key is None:
                    raise ValueError(f"a step needs a tag, id, class or attribute: {text}")
                rows.append((rule, retailer, field, rank, selector, k, k == len(steps) - 1, child, key, tag, ident, classes, has, hasnt))
            selector += 1
    return spark.createDataFrame(rows, RULE_SCHEMA)


def classes_of(attributes: Column) -> Column:
    return F.filter(F.split(F.coalesce(attributes["class"], F.lit("")), r"\s+"), lambda c: c != "")


def _holds(attributes: Column, test: Column) -> Column:
    value, wanted = attributes[test["name"]], test["value"]
    op = test["op"]
    return F.coalesce(
        F.when(op == "", value.isNotNull()).when(op == "=", value == wanted).when(op == "*=", value.contains(wanted)).when(op == "^=", value.startswith(wanted))
        .when(op == "$=", value.endswith(wanted)).when(op.isin("~=", "word"), F.array_contains(F.split(value, r"\s+"), wanted)),
        F.lit(False),
    )


def matches(elements: DataFrame, rules: DataFrame) -> DataFrame:
    """The elements (with ``retailer``) that rules of their retailer select: their columns, and rule, field, rank.

    ``rules`` are rows of ``compile_rules``; they are broadcast, a registry's selectors being a few thousand at most.
    """
    attributes = F.col("attributes")
    keys = F.concat(
        F.array("tag"), F.transform(classes_of(attributes), lambda c: F.concat(F.lit("."), c)), F.transform(F.map_keys(attributes), lambda a: F.concat(F.lit("["), a)),
        F.transform(F.filter(F.array(attributes["id"]), lambda x: x.isNotNull()), lambda x: F.concat(F.lit("#"), x)),
    )
    rule = F.broadcast(rules.withColumnsRenamed({"tag": "rule_tag", "retailer": "rule_retailer", "id": "rule_id"}))
    keyed = elements.select("*", F.explode(F.array_distinct(keys)).alias("key")).join(rule, "key").where(F.col("rule_retailer") == F.col("retailer"))
    fits = F.coalesce(F.col("tag") == F.col("rule_tag"), F.lit(True)) & F.coalesce(attributes["id"] == F.col("rule_id"), F.col("rule_id").isNull())
    fits &= F.size(F.array_except("classes", classes_of(attributes))) == 0
    fits &= F.forall("has", lambda t: _holds(attributes, t)) & ~F.exists("hasnt", lambda t: _holds(attributes, t))
    # step by step, rows of a selector in page order; at one element a later step's row comes first, as nothing lies inside itself
    hits = keyed.where(fits).withColumn("ok", F.col("step") == 0)
    before = Window.partitionBy("page_id", "selector").orderBy("pre", F.col("step").desc()).rowsBetween(Window.unboundedPreceding, -1)
    for step, child in enumerate(_steps(rules), 1):
        outer = (F.col("step") == step - 1) & F.col("ok")
        here = F.max(F.when(outer, F.col("post"))).over(before) >= F.col("post")
        if child:
            shared = F.when(F.col("step") == step - 1, F.col("pre")).when(F.col("step") == step, F.col("parent"))
            of_parent = F.max(outer.cast("int")).over(Window.partitionBy("page_id", "selector", shared)) == 1
            here = F.when(F.col("child"), of_parent).otherwise(here)
        hits = hits.withColumn("ok", F.when(F.col("step") == step, F.coalesce(here, F.lit(False))).otherwise(F.col("ok")))
    found = hits.where("last and ok").select(*elements.columns, "rule", "field", "rank")
    return found.dropDuplicates(["page_id", "pre", "rule"])


def _steps(rules: DataFrame) -> list[bool]:
    """For each step after the first, up to the longest selector's last: whether some selector asks for children there."""
    return [r.child for r in rules.where("step > 0").groupBy("step").agg(F.max("child").alias("child")).orderBy("step").collect()]


def select_all(found: DataFrame, *within: str) -> DataFrame:
    """Of each page and field (and each value of ``within``), all elements of the first rule that selects any."""
    best = Window.partitionBy("page_id", "field", *within)
    return found.withColumn("_first", F.min("rank").over(best)).where("rank = _first").drop("_first")


def select_first(found: DataFrame, accept: Column | None = None, *within: str) -> DataFrame:
    """Of each page and field (and each value of ``within``), the first element of the first rule whose first element is accepted.

    Of a rule's elements only the first on the page is looked at. ``accept`` is a condition on the columns of ``found``; one that is
    null doesn't accept.
    """
    columns = [c for c in found.columns if c not in ("page_id", "field", "rank", *within)]
    heads = found.groupBy("page_id", "field", *within, "rank").agg(F.min_by(F.struct(*columns), "pre").alias("e")).select("page_id", "field", *within, "rank", "e.*")
    accepted = heads if accept is None else heads.where(accept)
    chosen = accepted.groupBy("page_id", "field", *within).agg(F.min_by(F.struct("rank", *columns), "rank").alias("e"))
    return chosen.select("page_id", "field", *within, "e.*")


def inside(found: DataFrame, box: Column, *within: str) -> DataFrame:
    """``found``, in each page (and value of ``within``), with ``is_box`` (where ``box`` holds) and ``box``: for a box its own pre, for others that of each box they lie in or stand for.

    Boxes that hold each other are told apart by how many lie around; at each such level they are apart, so the box of an element
    is the last that begins before it, if it ends after it. An element comes once for each box around it, and not at all if there
    is none.
    """
    columns = found.columns
    begins = F.struct(F.col("pre").alias("at"), F.when(F.col("is_box"), 1).otherwise(0).alias("turn"))
    ends = F.struct((F.col("post") + 0.5).alias("at"), F.lit(-1).alias("turn"))
    rows = found.withColumn("is_box", F.coalesce(box, F.lit(False)))
    rows = rows.select("*", F.explode(F.when(F.col("is_box"), F.array(begins, ends)).otherwise(F.array(begins))).alias("e"))
    order = Window.partitionBy("page_id", *within).orderBy("e.at", F.col("e.turn").desc())
    rows = rows.withColumn("level", F.sum("e.turn").over(order) - 1).where("e.turn >= 0").drop("e")
    deepest = F.max(F.when(F.col("is_box"), F.col("level"))).over(Window.partitionBy("page_id", *within))
    rows = rows.withColumn("deepest", deepest).where("deepest is not null")
    levels = F.when(F.col("is_box"), F.array("level")).otherwise(F.sequence(F.lit(0).cast("long"), F.col("deepest")))
    rows = rows.select(*columns, "is_box", F.explode(levels).alias("level"))
    so_far = Window.partitionBy("page_id", *within, "level").orderBy("pre", ~F.col("is_box")).rowsBetween(Window.unboundedPreceding, -1)
    around = F.last(F.when(F.col("is_box"), F.struct("pre", "post")), ignorenulls=True).over(so_far)
    rows = rows.withColumn("_in", F.when(F.col("is_box"), F.struct("pre", "post")).otherwise(around)).where("_in.post >= post")
    return rows.select(*columns, "is_box", F.col("_in.pre").alias("box"))
