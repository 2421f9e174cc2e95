"""Pairs of alike titles from postings of their rarest grams, losing none that can reach the threshold.

Both measures of likeness need a common subsequence of ``least`` percent of the mean length (``functions.similarity``).
Two titles of ``both`` characters together with such a one of length c share at least ``(2q - 1) c - (q - 1)(both + 1)``
grams of q characters, as each character outside it breaks at most q - 1 of them on either side. So the grams, numbered by
occurrence and ordered by how many titles have them, need to meet in a prefix only: all but as many of the commonest as
have to be shared, less one. Each pair meets on the longest grams of which it must share one; short titles on characters.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lengths of grams, and the words of 64 bits in which a title's characters leave a bit each.
GRAMS, WORDS = (1, 2, 3), 2
SLACK = 1e-6  # for rounding


def near_titles(a: DataFrame, b: DataFrame, least: float) -> DataFrame:
    """block, l_title, p_title: distinct pairs of equal block that can reach ``least`` percent, and some that can't.

    ``a`` and ``b`` hold block and title; rows with a null in either pair with none, repeated rows count once. An empty
    title meets empty titles only. A gram that very many titles have among their rarest is one key of a join, which
    adaptive execution splits on both sides.
    """
    met = meetings(a, b, least).select("block", "l_title", "p_title").distinct()
    both = F.length("l_title") + F.length("p_title")
    edits = both - 2 * F.ceil(both * (least / 200) - SLACK)
    return met.where((F.col("l_title") == F.col("p_title")) | (F.levenshtein("l_title", "p_title") <= edits))


def meetings(a: DataFrame, b: DataFrame, least: float) -> DataFrame:
    """A row for each gram at which a pair meets and isn't ruled out by lengths, the grams' places or characters."""
    rows = postings(a, b, least)
    named = lambda side, p: rows.where(F.col("side") == side).select("block", "gram", "q", *[F.col(c).alias(f"{p}{c}") for c in rows.columns if c not in ("block", "gram", "q", "side")])
    both, shorter = F.col("l_n") + F.col("p_n"), F.least("l_n", "p_n")
    needed, fits = F.lit(0), F.lit(False)
    for q, (low, high) in spans(least).items():
        here = F.col("q") == q
        fits = fits | (here & both.between(low, high))
        needed = F.when(here, shared(q, both, least)).otherwise(needed)
    behind = F.least(F.col("l_size") - F.col("l_at"), F.col("p_size") - F.col("p_at"))  # the most that is shared from here on
    apart = sum(F.bit_count(F.col(f"l_bits{k}").bitwiseXOR(F.col(f"p_bits{k}"))) for k in range(WORDS))
    met = named(0, "l_").join(named(1, "p_"), ["block", "gram", "q"])
    return met.where(fits & (shorter * 200 >= both * least - SLACK) & (behind >= needed) & (apart <= both - 2 * shared(1, both, least)))


def shared(q: int, both, least: float):
    """How many grams two titles of ``both`` characters that reach ``least`` share at the least; of a column or a number."""
    exact = both * ((2 * q - 1) * least / 200 - (q - 1)) - (q - 1) - SLACK
    return F.ceil(exact).cast("int") if isinstance(both, Column) else math.ceil(exact)


def spans(least: float) -> dict[int, tuple[int, int]]:
    """The lengths of both titles together, from and to, for which pairs meet on grams of q."""
    out, end = {}, 2**31 - 1
    for q in sorted(GRAMS, reverse=True):
        slope = (2 * q - 1) * least / 200 - (q - 1)
        first = 0 if q == 1 else (math.floor((q - 1 + SLACK) / slope) + 1 if slope > SLACK else end)
        if first < end:
            out[q], end = (first, end - 1), first
    return out


def postings(a: DataFrame, b: DataFrame, least: float) -> DataFrame:
    """side (0: of a, 1: of b), block, q, gram, title, n, size, at, bits: the rarest grams of each distinct title.

    ``at`` counts a title's grams from 0, the rarest first, by the number of titles that have it.
    """
    one = grams(a.select("block", "title", F.lit(0).alias("side")).unionAll(b.select("block", "title", F.lit(1).alias("side"))), least)
    counts = one.groupBy("gram").agg(F.count(F.lit(1)).alias("titles"))
    rows = one.join(counts, "gram").groupBy("side", "block", "title", "q").agg(F.sort_array(F.collect_list(F.struct("titles", "gram"))).alias("all"))
    n, size, most = F.length("title"), F.size("all"), F.lit(1)
    for q, (low, _) in spans(least).items():
        fewest = F.greatest(n + F.ceil(n * (least / (200 - least)) - SLACK), F.lit(low))
        most = F.when(F.col("q") == q, F.greatest(shared(q, fewest, least), F.lit(1))).otherwise(most)
    rows = rows.select("*", n.alias("n"), size.alias("size"), F.slice("all", 1, F.greatest(size - most + 1, F.lit(0))).alias("rarest"), cut(F.col("title"), 1).alias("cut"))
    rows = rows.select("side", "block", "title", "q", "n", "size", "rarest", *bits(F.col("cut")))
    return rows.select("*", F.posexplode_outer("rarest").alias("at", "g")).withColumn("gram", F.col("g.gram")).drop("rarest", "g")


def grams(titles: DataFrame, least: float) -> DataFrame:
    """side, block, title, q, gram of each distinct title, of the lengths on which it may meet others; the k-th 'ab' is 'ab:k'."""
    # a maximum, and outer: filters on a title stay here then, and aren't moved to where it is made, to make it for each anew
    n = F.length("title")
    longest, shortest = n + F.floor(n * ((200 - least) / least) + SLACK), n + F.ceil(n * (least / (200 - least)) - SLACK)
    kinds = [F.when((n >= q) & (longest >= low) & (shortest <= high), F.lit(q)) for q, (low, high) in spans(least).items()]
    kinds.append(F.when(n == 0, F.lit(1)))  # an empty title has one gram, which is empty
    rows = titles.where("block IS NOT NULL").groupBy("side", "block", F.col("title").alias("key")).agg(F.max("title").alias("title")).where("key IS NOT NULL")
    rows = rows.drop("key").withColumn("q", F.explode_outer(F.array_compact(F.array(*kinds)))).where("q IS NOT NULL")
    rows = rows.withColumn("cut", cut(F.col("title"), F.col("q")))
    return rows.select("side", "block", "title", "q", F.explode_outer(numbered(F.col("cut"))).alias("gram"))


def cut(title: Column, q: Column | int) -> Column:
    """The grams of q characters in their own order; of a shorter title the whole title."""
    q = F.lit(q) if isinstance(q, int) else q
    return F.sort_array(F.transform(F.sequence(F.lit(1), F.greatest(F.length(title) - q + 1, F.lit(1))), lambda i: F.substr(title, i, q)))


def numbered(grams: Column) -> Column:
    """Ordered grams, each with its number among its equals."""
    return F.transform(grams, lambda g, i: F.concat(g, F.lit(":"), (i + 2 - F.array_position(grams, g)).cast("string")))


def bits(chars: Column) -> list[Column]:
    """A bit for each numbered character. Titles differ in at least as many characters as in bits."""
    places = F.transform(numbered(chars), lambda c: F.pmod(F.xxhash64(c), F.lit(64 * WORDS)).cast("int"))
    bit = lambda h, k: F.when((h >= 64 * k) & (h < 64 * k + 64), F.call_function("shiftleft", F.lit(1).cast("long"), h - 64 * k)).otherwise(F.lit(0).cast("long"))
    return [F.aggregate(places, F.lit(0).cast("long"), lambda s, h: s.bitwiseOR(bit(h, k))).alias(f"bits{k}") for k in range(WORDS)]  # noqa: B023
