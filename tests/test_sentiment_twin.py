"""Sentiment against a plain loop over words, on the reviews of the tables and on random ones made of the lexicon."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quayside.functions import fixed
from quayside.operators import reviews
from quayside.sources import tables as T


def plain(title, body, rating):
    text = ((title + " " if title else "") + (body or "")).strip(" ").lower()
    pos = neg = 0.0
    good, bad, reach, boost = [], [], 0, 1.0
    for w in re.findall(r"[\w']+", text):
        up, down = fixed.POSITIVE_WORDS.get(w), fixed.NEGATIVE_WORDS.get(w)
        if down is None and up is None:
            if w in fixed.INTENSIFIERS:
                boost = fixed.INTENSIFIERS[w]
                continue
            if w in fixed.NEGATIONS or w.endswith("n't"):
                reach = 3
                continue
        elif down is not None:
            if reach:
                pos, good = pos + down * boost * 0.5, [*good, f"not {w}"]
            else:
                neg, bad = neg + down * boost, [*bad, w]
        elif reach:
            neg, bad = neg + up * boost * 0.8, [*bad, f"not {w}"]
        else:
            pos, good = pos + up * boost, [*good, w]
        reach, boost = max(0, reach - 1), 1.0
    praised = [p for p in fixed.POSITIVE_PHRASES if p in text]
    blamed = [p for p in fixed.NEGATIVE_PHRASES if p in text]
    n = len(good) + len(bad) + len(praised) + len(blamed)
    total = pos + sum(fixed.POSITIVE_PHRASES[p] for p in praised) - neg - sum(fixed.NEGATIVE_PHRASES[p] for p in blamed)
    stars = 0.0 if rating is None else (rating - 3) / 2
    raw = max(-1.0, min(1.0, (total / n if n else 0.0) * 0.4 + stars * 0.6))
    sure = min(1.0, 0.3 + (0.4 if rating is not None else 0.0) + min(0.3, n * 0.1))
    return raw, sure, list(dict.fromkeys(good + praised)), list(dict.fromkeys(bad + blamed))


def check(table):
    rows = {(r.listing_id, r.id): r for r in table.select("listing_id", "id", "title", "body", "rating").collect()}
    scored = reviews.analyse(table).collect()
    assert len(scored) == len(rows)
    for r in scored:
        x = rows[r.listing_id, r.id]
        raw, sure, good, bad = plain(x.title, x.body, x.rating)
        assert r.score == pytest.approx(raw, abs=0.00051) and r.confidence == pytest.approx(sure, abs=0.0051), x
        assert (r.positive_keywords, r.negative_keywords) == (good, bad), x
        if abs(abs(raw) - 0.3) > 1e-9:
            assert r.label == ("positive" if raw > 0.3 else "negative" if raw < -0.3 else "neutral")


def test_reviews_of_the_tables(spark):
    check(T.reviews(spark, "/root/testdata/sf0.001"))


def test_random_reviews(spark):
    rnd = random.Random(11)
    pool = [*fixed.POSITIVE_WORDS, *fixed.NEGATIVE_WORDS, *fixed.NEGATIONS * 3, *fixed.INTENSIFIERS, *fixed.INTENSIFIERS, *fixed.POSITIVE_PHRASES, *fixed.NEGATIVE_PHRASES, *["dog", "food", "don't", "isn't", "It's", "café", "-", ".", "the"] * 8]
    text = lambda n: None if rnd.random() < 0.05 else rnd.choice([" ", "  ", ", "]).join(rnd.choices(pool, k=rnd.randrange(n)))
    rows = [(k % 7, k, text(4), text(30), rnd.choice([None, 1.0, 2.5, 3.0, 4.0, 5.0])) for k in range(400)]
    check(spark.createDataFrame(rows, "listing_id long, id long, title string, body string, rating double").withColumn("review_date", F.current_date()))
