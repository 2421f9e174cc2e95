"""Ingredient lists: parsing, allergens and classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quayside.functions import fixed
from quayside.functions.text import first_contained


def clean(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?i)(ingredients|composition)\s*:\s*", ""))


def split_list(text: Column) -> Column:
    """Entries between commas and semicolons outside parentheses, without empty ones."""
    parts = F.transform(F.split(text, r"[,;](?![^()]*\))"), lambda p: F.trim(p))
    return F.filter(parts, lambda p: p != "")


def parse(text: Column) -> Column:
    """array<struct<name, percentage, position>>; empty for null and blank. Positions count from 0; dropped entries keep theirs."""

    def one(part: Column, position: Column) -> Column:
        share = F.regexp_extract(part, r"(\d+(?:\.\d+)?)\s*%", 1)
        name = F.regexp_replace(F.regexp_replace(part, r"\d+(?:\.\d+)?\s*%", ""), r"\([^)]*\)", "")
        name = F.trim(F.regexp_replace(name, r"\s+", " "))
        return F.struct(name.alias("name"), F.when(share != "", F.concat(share, F.lit("%"))).alias("percentage"), position.cast("int").alias("position"))

    found = F.filter(F.transform(split_list(clean(F.coalesce(text, F.lit("")))), one), lambda x: x["name"] != "")
    return found


def names(text: Column) -> Column:
    return F.transform(parse(text), lambda x: x["name"])


def allergens_of(name: Column) -> Column:
    """Allergens with a keyword anywhere in a name, in the table's order."""
    low = F.lower(name)
    hit = lambda entries: F.exists(F.array(*[F.lit(w) for w in entries]), lambda w: F.contains(low, w))
    return F.filter(F.array(*[F.when(hit(entries), F.lit(a)) for a, entries in fixed.ALLERGENS.items()]), lambda a: a.isNotNull())


def allergens(list_of_names: Column) -> Column:
    """Distinct allergens of all names, in order of discovery."""
    return F.array_distinct(F.flatten(F.transform(list_of_names, allergens_of)))


def group(name: str) -> Column:
    return F.array(*[F.lit(a) for a in {"proteins": fixed.PROTEINS, "grains": fixed.GRAINS}[name]])


def is_grain_free(found: Column) -> Column:
    return ~F.arrays_overlap(found, group("grains"))


def is_single_protein(found: Column) -> Column:
    """At most one of the five proteins; see ``exactly_one_protein`` for the stricter catalogue filter."""
    return F.size(F.array_intersect(found, group("proteins"))) <= 1


def exactly_one_protein(found: Column) -> Column:
    return F.size(F.array_intersect(found, group("proteins"))) == 1


def primary_protein(found: Column) -> Column:
    """The first protein in the table's order, or null."""
    return F.get(F.filter(group("proteins"), lambda p: F.array_contains(found, p)), F.lit(0))


def ingredient_class(name: Column) -> Column:
    """protein, carbohydrate, ... by the first entry contained, or null."""
    return first_contained(F.lower(name), fixed.INGREDIENT_CLASSES)
