"""Sentiment of reviews: a fold over the lexicon's words with negation and intensifiers, then phrases and the rating."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside.functions import fixed
from quayside.functions.numbers import rating_factor, round_to

_STATE = "struct<pos: double, neg: double, pos_hits: array<string>, neg_hits: array<string>, specials: int, negated_at: int, boosted_at: int, boost: double>"
#: What each word of the lexicon does.
_KINDS = {w: ("negation", 0.0) for w in fixed.NEGATIONS} | {w: ("boost", x) for w, x in fixed.INTENSIFIERS.items()}
_KINDS |= {w: ("good", x) for w, x in fixed.POSITIVE_WORDS.items()} | {w: ("bad", x) for w, x in fixed.NEGATIVE_WORDS.items()}
WINDOW = 3  # words that a negation reaches


def review_text(title: Column, body: Column) -> Column:
    """Title and body in lower case, neither null."""
    part = F.when(title != "", F.concat(title, F.lit(" "))).otherwise("")
    return F.lower(F.trim(F.concat(F.coalesce(part, F.lit("")), F.coalesce(body, F.lit("")))))


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(text, r"(?U)[^\w\s']", " "), r"(?U)\s+"), lambda w: w != "")


def _step(state: Column, hit: Column) -> Column:
    """One hit of the lexicon. Words are counted without negations and intensifiers, which don't use up a negation's reach or a boost."""
    word, at = hit["word"], hit["at"] - state["specials"]
    kind, weight = hit["entry"]["kind"], hit["entry"]["weight"]
    good, special = kind == "good", kind.isin("negation", "boost")
    negated = at - state["negated_at"] < WINDOW
    value = weight * F.when(state["boosted_at"] == at, state["boost"]).otherwise(F.lit(1.0))
    plus = good != negated  # a negated bad word is a good one
    put = lambda c, ok, x: F.when(~special & ok, x).otherwise(state[c]).alias(c)
    shown = F.array(F.when(negated, F.concat(F.lit("not "), word)).otherwise(word))
    return F.struct(
        put("pos", plus, state["pos"] + F.when(good, value).otherwise(value * 0.5)),
        put("neg", ~plus, state["neg"] + F.when(good, value * 0.8).otherwise(value)),
        put("pos_hits", plus, F.concat(state["pos_hits"], shown)),
        put("neg_hits", ~plus, F.concat(state["neg_hits"], shown)),
        (state["specials"] + special.cast("int")).alias("specials"),
        F.when(kind == "negation", at).otherwise(state["negated_at"]).alias("negated_at"),
        F.when(kind == "boost", at).otherwise(state["boosted_at"]).alias("boosted_at"),
        F.when(kind == "boost", weight).otherwise(state["boost"]).alias("boost"),
    ).cast(_STATE)


def hits(text: Column) -> Column:
    """The words of the text that the lexicon knows, what they do, and their places."""
    indexed = F.filter(F.transform(tokens(text), lambda w, i: F.struct(w.alias("word"), i.alias("at"))), lambda x: x["word"].isin(list(_KINDS)) | x["word"].endswith("n't"))
    entries = {w: F.struct(F.lit(k).alias("kind"), F.lit(x).alias("weight")) for w, (k, x) in _KINDS.items()}
    table = F.create_map(*[c for w, e in entries.items() for c in (F.lit(w), e)])
    return F.transform(indexed, lambda x: F.struct(x["word"].alias("word"), x["at"].alias("at"), F.coalesce(F.try_element_at(table, x["word"]), entries["not"]).alias("entry")))


def phrases(text: Column, table: dict[str, float]) -> Column:
    """The table's phrases that the text contains, with their weights."""
    found = F.array(*[F.when(F.contains(text, F.lit(p)), F.struct(F.lit(p).alias("p"), F.lit(w).alias("w"))) for p, w in table.items()])
    return F.filter(found, lambda e: e.isNotNull())


def topics(text: Column, table: dict[str, tuple[str, ...]]) -> Column:
    """Topics with a keyword anywhere in the text, in the table's order."""
    hits = [F.when(reduce(lambda a, b: a | b, (F.contains(text, F.lit(w)) for w in entries)), F.lit(t)) for t, entries in table.items()]
    return F.filter(F.array(*hits), lambda t: t.isNotNull())


def label_of(score: Column) -> Column:
    return F.when(score >= 0.3, "positive").when(score <= -0.3, "negative").otherwise("neutral")


def analyse(reviews: DataFrame) -> DataFrame:
    """``reviews`` (title, body, rating, and others) with score, label, confidence, positive_keywords, negative_keywords, praises and complaints.

    A null rating counts as neutral and lowers the confidence; a review without text has only its rating. What later
    steps read several times is a column of its own, so that it is computed once.
    """
    none = F.array().cast("array<string>")
    start = F.struct(
        F.lit(0.0).alias("pos"), F.lit(0.0).alias("neg"), none.alias("pos_hits"), none.alias("neg_hits"),
        F.lit(0).alias("specials"), F.lit(-WINDOW).alias("negated_at"), F.lit(-1).alias("boosted_at"), F.lit(1.0).alias("boost"),
    ).cast(_STATE)
    total = lambda phrases: F.aggregate(phrases, F.lit(0.0), lambda a, e: a + e["w"])
    names = lambda phrases: F.transform(phrases, lambda e: e["p"])
    text, s = F.col("_text"), F.col("_fold")
    out = reviews.withColumn("_text", review_text(F.col("title"), F.col("body")))
    out = out.withColumns(
        {
            "_hits": hits(text), "_good": phrases(text, fixed.POSITIVE_PHRASES), "_bad": phrases(text, fixed.NEGATIVE_PHRASES),
            "praises": topics(text, fixed.PRAISE_TOPICS), "complaints": topics(text, fixed.COMPLAINT_TOPICS),
        }
    )
    out = out.withColumn("_fold", F.aggregate("_hits", start, _step))
    out = out.withColumns({"_n": F.size(s["pos_hits"]) + F.size(s["neg_hits"]) + F.size("_good") + F.size("_bad"), "_sum": s["pos"] + total(F.col("_good")) - s["neg"] - total(F.col("_bad"))})
    words = F.when(F.col("_n") > 0, F.col("_sum") / F.col("_n")).otherwise(F.lit(0.0))
    out = out.withColumn("_raw", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), words * 0.4 + rating_factor(F.col("rating")) * 0.6)))
    sure = F.least(F.lit(1.0), F.lit(0.3) + F.when(F.col("rating").isNotNull(), 0.4).otherwise(0.0) + F.least(F.lit(0.3), F.col("_n") * F.lit(0.1)))
    return out.select(
        *reviews.columns, round_to(F.col("_raw"), 3).alias("score"), label_of(F.col("_raw")).alias("label"), round_to(sure, 2).alias("confidence"),
        F.array_distinct(F.concat(s["pos_hits"], names(F.col("_good")))).alias("positive_keywords"), F.array_distinct(F.concat(s["neg_hits"], names(F.col("_bad")))).alias("negative_keywords"),
        "praises", "complaints",
    )
