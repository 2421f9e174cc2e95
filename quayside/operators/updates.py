"""Changes as new versions of tables: upserts, synchronised sets, status moves, verification."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside.functions import fixed
from quayside.functions.text import normalize_category


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The latest row of each key of both tables; rows of ``new`` win over those of ``old`` at the same time."""
    both = old.withColumn("_side", F.lit(0)).unionByName(new.withColumn("_side", F.lit(1)))
    rest = [c for c in old.columns if c not in keys]
    newest = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order, "_side")).alias("x"))
    return newest.select(*keys, "x.*").select(*old.columns)


def changes(old: DataFrame, new: DataFrame, keys: list[str], compared: list[str]) -> DataFrame:
    """keys and change: created, updated (one of ``compared`` differs), unchanged or missing."""
    a = old.select(*keys, F.struct(*compared).alias("_old"))
    b = new.select(*keys, F.struct(*compared).alias("_new"))
    kind = F.when(F.col("_old").isNull(), "created").when(F.col("_new").isNull(), "missing").when(F.col("_old").eqNullSafe(F.col("_new")), "unchanged").otherwise("updated")
    return a.join(b, keys, "full").select(*keys, kind.alias("change"))


def get_or_create(known: DataFrame, wanted: DataFrame, key: str, first_by: str) -> DataFrame:
    """``known`` and one row for each new key, that with the smallest ``first_by``."""
    rest = [c for c in wanted.columns if c != key]
    new = wanted.join(known.select(key), key, "left_anti").groupBy(key).agg(F.min_by(F.struct(*rest), first_by).alias("x")).select(key, "x.*")
    return known.unionByName(new.select(*known.columns))


def synchronise(bridge: DataFrame, wanted: DataFrame, owner: str) -> DataFrame:
    """The bridge with the rows of each owner in ``wanted`` replaced by these."""
    return bridge.join(wanted.select(owner).distinct(), owner, "left_anti").unionByName(wanted)


def move_allowed(old: Column, new: Column) -> Column:
    """Whether a retailer may go from one status to another; staying is always allowed."""
    return (old == new) | reduce(lambda a, b: a | b, ((old == k) & new.isin(*v) for k, v in fixed.STATUS_MOVES.items()))


def move(retailers: DataFrame, wanted: DataFrame) -> DataFrame:
    """Retailers after the wanted (id, new_status), with ``moved`` and ``refused``."""
    joined = retailers.join(wanted, "id", "left")
    asked = F.col("new_status").isNotNull()
    fine = asked & move_allowed(F.col("status"), F.col("new_status"))
    out = joined.withColumn("moved", fine & (F.col("status") != F.col("new_status"))).withColumn("refused", asked & ~fine)
    return out.withColumn("status", F.when(fine, F.col("new_status")).otherwise(F.col("status"))).drop("new_status")


def resume_expired(retailers: DataFrame, as_of: Column) -> DataFrame:
    """Retailers whose pause is over become active."""
    over = F.coalesce((F.col("status") == "paused") & (F.col("paused_until") <= as_of), F.lit(False))
    return retailers.withColumn("resumed", over).withColumn("status", F.when(over, "active").otherwise(F.col("status"))).withColumn("paused_until", F.when(~over, F.col("paused_until")))


def status_of_flags(is_active: Column, health: Column, paused_until: Column, as_of: Column) -> Column:
    """One status from older flags: disabled before failed before paused before degraded before active."""
    return (
        F.when(~is_active, "disabled").when(health == "unhealthy", "failed").when(paused_until > as_of, "paused").when(health == "degraded", "degraded").otherwise("active")
    )


def verify(matches: DataFrame, decisions: DataFrame, as_of: Column) -> DataFrame:
    """Matches after decisions (listing_id, decision, user_id, reason, new_product_id): approve, reject or rematch."""
    joined = matches.join(decisions, "listing_id", "left")
    act, again = F.col("decision"), F.col("decision") == "rematch"
    out = joined.withColumns(
        {
            "status": F.when(act.isin("approve", "rematch"), "approved").when(act == "reject", "rejected").otherwise(F.col("status")),
            "product_id": F.when(again, F.col("new_product_id")).otherwise(F.col("product_id")),
            "confidence_score": F.when(again, F.lit(100).cast("decimal(5,2)")).otherwise(F.col("confidence_score")),
            "match_type": F.when(again, "manual").otherwise(F.col("match_type")),
            "verified_by": F.when(act.isNotNull(), F.col("user_id")).otherwise(F.col("verified_by")),
            "verified_at": F.when(act.isNotNull(), as_of).otherwise(F.col("verified_at")),
            "rejection_reason": F.when(act == "reject", F.col("reason")),
        }
    )
    return out.drop("decision", "user_id", "reason", "new_product_id")


def bulk_approvable(matches: DataFrame, least: float = 95, most: int = 100) -> DataFrame:
    """The first ``most`` (1 to 500) pending matches of at least that confidence (80 to 100), by id."""
    if not 80 <= least <= 100 or not 1 <= most <= 500:
        raise ValueError("a confidence from 80 to 100, and 1 to 500 matches")
    return matches.where((F.col("status") == "pending") & (F.col("confidence_score") >= least)).orderBy("listing_id").limit(most)


def bulk_approve(matches: DataFrame, least: float, most: int, user_id: int, as_of: Column) -> DataFrame:
    """All matches, those of ``bulk_approvable`` approved."""
    chosen = bulk_approvable(matches, least, most).select("listing_id", F.lit(True).alias("chosen"))
    out = matches.join(F.broadcast(chosen), "listing_id", "left")  # at most 500 rows
    now = lambda c, value: F.when(F.col("chosen"), value).otherwise(F.col(c)).alias(c)
    changed = {"status": F.lit("approved"), "verified_by": F.lit(user_id).cast("long"), "verified_at": as_of}
    return out.select(*[now(c, changed[c]) if c in changed else c for c in matches.columns])


def fill_categories(products: DataFrame) -> DataFrame:
    """Products with their canonical category, and whether it changed."""
    new = normalize_category(F.col("category"))
    return products.withColumn("updated", ~F.col("canonical_category").eqNullSafe(new)).withColumn("canonical_category", new)
