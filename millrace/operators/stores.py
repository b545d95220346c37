"""Chunk stores as tables, and what moves chunks between them: joins on the id."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.chunking import digest_of


def has(ids: DataFrame, store: DataFrame) -> DataFrame:
    """Rows of ids whose chunk the store holds."""
    return ids.join(store.select("id"), "id", "left_semi")


def lacks(ids: DataFrame, store: DataFrame) -> DataFrame:
    return ids.join(store.select("id"), "id", "left_anti")


def fetched(ids: DataFrame, store: DataFrame, verify: bool = True) -> DataFrame:
    """Chunks by id, with `valid` telling whether the payload has its digest; a missing chunk gives no row."""
    got = ids.select("id").distinct().join(store, "id")
    return got.withColumn("valid", F.sha2("payload", 256) == F.col("id")) if verify else got


def to_store(chunks: DataFrame, store: DataFrame) -> DataFrame:
    """What storing the chunks adds: each id once, and none the store has."""
    return lacks(chunks.dropDuplicates(["id"]), store)


def without(ids: DataFrame, *ignored: DataFrame) -> DataFrame:
    for x in ignored:
        ids = lacks(ids, x)
    return ids


def copy_plan(wanted: DataFrame, ignored: Sequence[DataFrame], target: DataFrame, source: DataFrame) -> DataFrame:
    """id and found for the distinct wanted ids that are neither ignored nor in the target; found: in the source."""
    left = lacks(without(wanted.select("id").distinct(), *ignored), target)
    return left.join(source.select("id", F.lit(True).alias("there")).distinct(), "id", "left").select("id", F.coalesce("there", F.lit(False)).alias("found"))


def prune(store: DataFrame, referenced: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(to delete, to keep)."""
    return lacks(store, referenced), has(store, referenced)


def invalid(store: DataFrame, kind: str = "sha256") -> DataFrame:
    """Chunks whose payload is missing or doesn't have the digest it is stored under."""
    return store.withColumn("own", digest_of(F.col("payload"), kind)).where("own is null or own <> id").drop("own")


def routed(ids: DataFrame, stores: DataFrame, *payload: str) -> DataFrame:
    """id and the store that serves it: the one of least priority that holds it; served is null if none does.

    stores: id, store, priority and payload columns. One aggregation with partial results, no window.
    """
    best = stores.groupBy("id").agg(F.min_by(F.struct("store", *payload), F.struct("priority", "store")).alias("s"))
    return ids.select("id").distinct().join(best, "id", "left").select("id", F.col("s.store").alias("served"), *(F.col(f"s.{p}").alias(p) for p in payload))


def cached(ids: DataFrame, cache: DataFrame, source: DataFrame, repair: bool = False) -> DataFrame:
    """id and outcome (hit, fill or missing) of reading through a cache; with repair, a cached chunk that is not valid counts as absent.

    cache: id and, for repair, valid.
    """
    have = cache.where("valid") if repair else cache
    a = have.select("id", F.lit(True).alias("c")).distinct()
    b = source.select("id", F.lit(True).alias("s")).distinct()
    out = F.when(F.col("c"), "hit").when(F.col("s"), "fill").otherwise("missing")
    return ids.select("id").distinct().join(a, "id", "left").join(b, "id", "left").select("id", out.alias("outcome"))


def failover(events: DataFrame, key: str, order: str, failed: Column, stores: int) -> DataFrame:
    """The store that answers each request of a group of `stores`: after an error the next one takes over.

    Requests of one key come in order; each tries the active store once and then, if that failed, the next. The
    active store is the count of errors so far, so no state need be passed along.
    """
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(failed.cast("long")).over(w), F.lit(0))
    return events.select(key, order, (before % stores).cast("long").alias("active"), ((before + failed.cast("long")) % stores).cast("long").alias("next"))
