"""Tables that live from run to run: restore, hydrate, fall back, upsert, evict."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_by_key(rows: DataFrame, key: str = "id", order: Sequence[Column | str] = ("ord",)) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_nth", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("_nth = 1").drop("_nth")


def restore_missing(new: DataFrame, old: DataFrame) -> DataFrame:
    """new, then old rows whose source sent nothing and whose id is absent, marked restored."""
    silent = old.join(new.select("source").distinct(), "source", "left_anti").join(new.select("id").distinct(), "id", "left_anti")
    return new.withColumn("restored", F.lit(False)).unionByName(silent.withColumn("restored", F.lit(True)), allowMissingColumns=True)


def new_ids(current: DataFrame, known: DataFrame) -> DataFrame:
    return current.select("id").distinct().join(known.select("id"), "id", "left_anti")


def evict(cache: DataFrame, active: DataFrame, key: str = "id") -> DataFrame:
    """Only cache rows whose key is active."""
    return cache.join(active.select(key).distinct(), key, "left_semi")


def hydrate(rows: DataFrame, cache: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """rows with the cache's fields where all keys agree, and pending where they don't."""
    hit = cache.select(*keys, *fields, F.lit(True).alias("_hit"))
    return rows.join(hit, list(keys), "left").withColumn("pending", F.col("_hit").isNull()).drop("_hit")


def fall_back(rows: DataFrame, old: DataFrame, fields: Sequence[str], when: str = "summary") -> DataFrame:
    """Rows with an empty `when` take it and other non-null fields from the old row of that id, if its own is not empty."""
    empty = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    past = old.filter(~empty(F.col(when))).select("id", *(F.col(c).alias(f"_{c}") for c in (when, *fields)))
    out = rows.join(past, "id", "left")
    use = empty(F.col(when)) & F.col(f"_{when}").isNotNull()
    return out.withColumns({c: F.when(use, F.coalesce(F.col(f"_{c}"), F.col(c))).otherwise(F.col(c)) for c in (when, *fields)}).drop(*(f"_{c}" for c in (when, *fields)))


def upsert_content(rows: DataFrame, previous: DataFrame) -> DataFrame:
    """id, content, action: this run's content, else the previous one, else a minimal text of title and url.

    action is written, unchanged, reused or minimal.
    """
    old = previous.select("id", F.col("content").alias("_old"))
    out = rows.join(old, "id", "left")
    filled = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    content = F.when(filled("content"), F.col("content")).when(filled("_old"), F.col("_old")).otherwise(F.concat_ws("\n", "title", "url"))
    action = F.when(filled("content") & F.col("content").eqNullSafe(F.col("_old")), "unchanged").when(filled("content"), "written").when(filled("_old"), "reused").otherwise("minimal")
    return out.select("id", content.alias("content"), action.alias("action"))


def merge_state(state: DataFrame, changes: DataFrame, key: str, order: str) -> DataFrame:
    """state with the latest change of each key."""
    latest = changes.withColumn("_nth", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).filter("_nth = 1").drop("_nth")
    return state.join(latest.select(key), key, "left_anti").unionByName(latest)


def toggle(members: DataFrame, changed: DataFrame, key: str = "id") -> DataFrame:
    """Symmetric difference: keys that are in exactly one of the two sets."""
    a, b = members.select(key).distinct(), changed.select(key).distinct()
    return a.join(b, key, "left_anti").unionByName(b.join(a, key, "left_anti"))


def upsert_quality(rows: DataFrame, previous: DataFrame, computed: DataFrame) -> DataFrame:
    """id, quality, origin: this run's quality, else the previous one, else the computed one."""
    old, own = previous.select("id", F.col("quality").alias("_old")), computed.select("id", F.col("quality").alias("_own"))
    origin = F.when(F.col("quality").isNotNull(), "current").when(F.col("_old").isNotNull(), "previous").otherwise("computed")
    return rows.select("id", "quality").join(old, "id", "left").join(own, "id", "left").select("id", F.coalesce("quality", "_old", "_own").alias("quality"), origin.alias("origin"))
