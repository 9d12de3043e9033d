"""Bounded registries: newest rows, upserts, merges and clean-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def recent_n(df: DataFrame, owner: str, order: str = "ts", tie: str = "id", n: int = 10) -> DataFrame:
    """The newest ``n`` rows of each owner, ``place`` 1 first."""
    newest = Window.partitionBy(owner).orderBy(F.desc(order), F.desc(tie))
    return df.withColumn("place", F.row_number().over(newest)).where(F.col("place") <= n)


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The newest row of each key, by an aggregation that shrinks before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order)).alias("r")
    return df.groupBy(*keys).agg(best).select(*keys, *(F.col(f"r.{c}").alias(c) for c in rest))


def upsert_books(df: DataFrame, n: int = 20) -> DataFrame:
    """One row a book, its newest; a page of 0 keeps the page before; the ``n`` newest books of an owner."""
    order = F.struct("time", "seq")
    newest = df.groupBy("owner", "uri").agg(F.max(order).alias("at"), F.max_by("total", order).alias("total"), F.max_by(F.nullif("page", F.lit(0)), F.when(F.col("page") != 0, order)).alias("page"))
    rows = newest.select("owner", "uri", F.col("at.time").alias("time"), F.col("at.seq").alias("seq"), F.coalesce("page", F.lit(0)).alias("page"), "total")
    return recent_n(rows, "owner", "time", "seq", n)


def book_progress(books: DataFrame, moves: DataFrame) -> DataFrame:
    """Books with the page of their latest move, within 0 and the last page."""
    last = latest(moves.select("owner", "uri", F.col("page").alias("moved"), F.col("time").alias("moved_at"), F.col("seq").alias("move_seq")), ["owner", "uri"], ["moved_at", "move_seq"])
    both = books.join(last, ["owner", "uri"], "left")
    page = F.greatest(F.least(F.coalesce("moved", "page"), F.col("total") - 1), F.lit(0))
    return both.select("owner", "uri", "total", page.alias("page"), F.coalesce("moved_at", "time").alias("time"))


def merge_devices(found: DataFrame, saved: DataFrame, host: str = "host") -> DataFrame:
    """Devices that are online, then saved ones that aren't."""
    online = found.select(host).distinct().withColumn("online", F.lit(True))
    offline = saved.select(host).distinct().join(online, host, "left_anti").withColumn("online", F.lit(False))
    return online.unionByName(offline)


def orphan_files(before: DataFrame, after: DataFrame, name: str) -> DataFrame:
    """Managed files that no kept row uses."""
    return before.select(name).where(F.col(name).isNotNull()).distinct().join(after.select(name), name, "left_anti")


def inbox_fifo(df: DataFrame, owner: str, order: str, tie: str, n: int = 30) -> DataFrame:
    """All rows with ``kept``: whether they are among the owner's newest ``n``."""
    newest = Window.partitionBy(owner).orderBy(F.desc(order), F.desc(tie))
    return df.withColumn("kept", F.row_number().over(newest) <= n)


def acknowledge(items: DataFrame, acks: DataFrame, key: str) -> DataFrame:
    return items.join(acks.select(key), key, "left_anti")


def uniqued(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the given order."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, *(F.col(f"r.{c}").alias(c) for c in rest))


def recast(history: DataFrame, owner: str, place: Column | int, default_title: str) -> DataFrame:
    """The item at ``place`` (0 newest) of each owner; the default title becomes empty."""
    n = F.lit(place) if isinstance(place, int) else place
    ranked = history.withColumn("place", F.row_number().over(Window.partitionBy(owner).orderBy(F.desc("ts"), F.desc("id"))))
    return ranked.where(F.col("place") == n + 1).withColumn("title", F.when(F.col("title") == default_title, "").otherwise(F.col("title"))).drop("place")


def active_config(configs: DataFrame, preferred: DataFrame, owner: str) -> DataFrame:
    """Each owner's preferred configuration, else the first one with a key.  ``preferred`` has (owner, id)."""
    wish = preferred.select(owner, F.col("id").alias("wish"))
    good = configs.join(wish, owner, "left").where((F.col("id") == F.col("wish")) | F.col("has_key"))
    return uniqued(good.withColumn("rank", F.when(F.col("id") == F.col("wish"), 0).otherwise(1)), [owner], ["rank", "id"]).select(owner, "id")


#: Settings up to this number are a literal list in the plan.
FEW_SETTINGS = 1000


def with_defaults(stored: DataFrame, defaults: DataFrame, key: str = "name") -> DataFrame:
    """Every setting of ``defaults(name, value, low, high)`` per owner, the stored value within its limits.

    A list of settings as an application has it is counted and becomes a literal that each owner explodes; a longer one
    meets the owners in a distributed product.
    """
    owners, named = stored.select("owner").distinct(), defaults.select(key, F.col("value").alias("default"), "low", "high")
    few = named.limit(FEW_SETTINGS + 1).collect()
    if len(few) > FEW_SETTINGS:
        wanted = owners.crossJoin(named)
    else:
        settings = F.array(*(F.struct(*(F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(row, named.schema.fields, strict=True))) for row in few))
        wanted = owners.select("owner", F.explode(settings).alias("s")).select("owner", "s.*") if few else owners.crossJoin(named)
    value = F.greatest(F.least(F.coalesce("value", "default"), F.col("high")), F.col("low"))
    return wanted.join(stored, ["owner", key], "left").select("owner", key, value.alias("value"))
