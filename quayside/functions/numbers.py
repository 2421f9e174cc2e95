"""Money, percentages and classes of prices. Ratios of integers are rounded exactly, half away from zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quayside.functions import fixed


def int_div(a: Column, b: Column) -> Column:
    return F.call_function("div", a.cast("long"), b.cast("long"))


def rounded_ratio(num: Column, den: Column, digits: int = 0) -> Column:
    """num / den of integers, rounded to ``digits``, as a double; null where den isn't positive."""
    num, den = num.cast("long"), den.cast("long")
    size = int_div(F.abs(num) * (2 * 10**digits) + den, den * 2)
    return F.when(den > 0, F.when(num < 0, -size).otherwise(size) / F.lit(float(10**digits)))


def rounded_mean(total: Column, n: Column) -> Column:
    """The integer nearest to total / n."""
    return rounded_ratio(total, n).cast("long")


def round_to(x: Column, digits: int) -> Column:
    """A double rounded half away from zero."""
    scale = F.lit(float(10**digits))
    return F.when(x < 0, -F.floor(-x * scale + 0.5)).otherwise(F.floor(x * scale + 0.5)) / scale


def change_percent(start: Column, end: Column, digits: int = 2) -> Column:
    """By how many percent ``end`` differs from ``start``; 0 where start is 0."""
    return F.when(start == 0, F.lit(0.0)).otherwise(rounded_ratio((end - start) * 100, start, digits))


def drop_percent(old: Column, new: Column, digits: int = 2) -> Column:
    """By how many percent the price fell; 0 if it didn't, or if there was none."""
    return F.when((old <= 0) | (new >= old), F.lit(0.0)).otherwise(rounded_ratio((old - new) * 100, old, digits))


def discount_percent(original: Column, price: Column, digits: int = 0) -> Column:
    """Null unless the original price is known, positive and higher."""
    return F.when((original > 0) & (price < original), rounded_ratio((original - price) * 100, original, digits))


def sample_deviation(n: Column, total: Column, squares: Column, mean: Column) -> Column:
    """Deviation around the rounded mean with n - 1 below, two decimals; 0 for fewer than two values."""
    around = (squares - mean * total * 2 + n * mean * mean).cast("double")
    return F.when(n < 2, F.lit(0.0)).otherwise(round_to(F.sqrt(around / (n - 1)), 2))


def trend_indicator(change: Column, deviation: Column, average: Column) -> Column:
    """volatile before stable before rising or falling."""
    volatility = F.when(average > 0, deviation / average * 100).otherwise(F.lit(0.0))
    return (
        F.when(volatility > fixed.VOLATILE_PERCENT, "volatile")
        .when(F.abs(change) <= fixed.STABLE_PERCENT, "stable")
        .when(change > 0, "rising")
        .otherwise("falling")
    )


def pattern_class(gap_days: Column, n_sales: Column, lookback: int) -> Column:
    """How often a listing is on sale."""
    return (
        F.when(n_sales == 0, "none")
        .when(n_sales * 30 >= 4 * lookback, "frequent")
        .when(gap_days <= 14, "bi_weekly")
        .when(gap_days <= 35, "monthly")
        .otherwise("occasional")
    )


def savings_percent(on_sale: Column, average: Column, price: Column) -> Column:
    """Savings against the average, one decimal; null unless on sale with a positive average."""
    return F.when(on_sale & (average > 0), rounded_ratio((average - price) * 100, average, 1))


def brand_points(a: Column, b: Column) -> Column:
    """The brand's part of the confidence: half of 25 where either side is missing."""
    from quayside.functions.text import brands_match

    return F.when(a.isNull() | b.isNull(), 12.5).when(brands_match(a, b), 25.0).otherwise(0.0)


def match_confidence(similarity: Column, brands: tuple[Column, Column] | Column, categories: tuple[Column, Column], weights: tuple[Column, Column], quantities: tuple[Column, Column]) -> Column:
    """0 to 100: title 40 %, brand 25, category 15, weight 12, quantity 8; half of a part where either side is missing.

    ``brands`` are the two brands, or the points that they give.
    """
    from quayside.functions.text import weights_match

    missing = lambda pair: pair[0].isNull() | pair[1].isNull()
    brand = brands if isinstance(brands, Column) else brand_points(*brands)
    category = F.when(categories[1].isNull() | (categories[0] == categories[1]), 15.0).otherwise(0.0)
    weight = F.when(missing(weights), 6.0).when(weights_match(*weights), 12.0).otherwise(0.0)
    quantity = F.when(missing(quantities), 4.0).when(quantities[0] == quantities[1], 8.0).otherwise(0.0)
    return F.least(F.lit(100.0), similarity * 0.4 + brand + category + weight + quantity)


def rating_factor(rating: Column) -> Column:
    return F.coalesce((rating.cast("double") - 3) / 2, F.lit(0.0))


def stars(rating: Column) -> Column:
    return F.floor(rating.cast("double") + 0.5).cast("int")


def price_to_pence(text: Column) -> Column:
    """'95p' as pence, '12.5' as pounds and pence; a bare number is pounds below 100, else pence; null if unreadable."""
    t = F.trim(text)
    plain = F.regexp_replace(t, r"[£$€\s,]", "")
    pounds, pence = F.regexp_extract(plain, r"^(\d{1,9})[.,](\d{1,2})$", 1), F.regexp_extract(plain, r"^(\d{1,9})[.,](\d{1,2})$", 2)
    whole = F.regexp_extract(plain, r"^(\d{1,9})$", 1)
    only_pence = F.regexp_extract(t, r"(?i)^(\d{1,9})p$", 1)
    number = lambda c: c.try_cast("int")
    return (
        F.when(only_pence != "", number(only_pence))
        .when(pounds != "", number(pounds) * 100 + number(F.rpad(pence, 2, "0")))
        .when(whole != "", F.when(number(whole) < 100, number(whole) * 100).otherwise(number(whole)))
    )


def decimal_price_to_pence(text: Column) -> Column:
    """A price of structured data in pence."""
    return F.floor(text.try_cast("double") * 100 + 0.5).cast("int")


def page_of_offset(start: Column, per_page: int = 24) -> Column:
    return (F.floor(start / per_page) + 1).cast("int")


def days_between(a: Column, b: Column) -> Column:
    """Elapsed days with fractions, not calendar days."""
    return F.timestamp_diff("MICROSECOND", a, b) / F.lit(86_400_000_000.0)
