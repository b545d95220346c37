"""What an index holds, and how much of it seeds, caches and stores already have."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.index import first_occurrence


def flag(df: DataFrame, other: DataFrame | None, on: list[str], name: str) -> DataFrame:
    """df with whether other has the row's key."""
    if other is None:
        return df.withColumn(name, F.lit(False))
    there = other.select(*on, F.lit(True).alias(name)).distinct()
    return df.join(there, on, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def info(index: DataFrame, key: str, seeds: DataFrame | None = None, cache: DataFrame | None = None, store: DataFrame | None = None, sizes: DataFrame | None = None) -> DataFrame:
    """One row for each index (value of key).

    seeds: (key, id) pairs of what the seeds of an index hold; cache, store: ids; sizes: id and compressed_size.
    The compressed sum is 0 if any chunk it is to cover has no compressed size, or 0.
    """
    u = first_occurrence(index, key)
    u = flag(flag(flag(u, seeds, [key, "id"], "in_seed"), cache, ["id"], "in_cache"), store, ["id"], "in_store")
    u = u.join(sizes.select("id", "compressed_size").dropDuplicates(["id"]), "id", "left") if sizes is not None else u.withColumn("compressed_size", F.lit(None).cast("long"))
    neither = ~F.col("in_seed") & ~F.col("in_cache")
    known = F.coalesce(F.col("compressed_size") > 0, F.lit(False))
    count = lambda c: F.count_if(c)
    total = lambda c, v: F.coalesce(F.sum(F.when(c, F.col(v))), F.lit(0))
    per = u.groupBy(key).agg(
        F.count("*").alias("unique"), count(F.col("in_seed")).alias("in_seed"), count(F.col("in_cache")).alias("in_cache"), count(F.col("in_store")).alias("in_store"), count(neither).alias("not_in_seed_nor_cache"),
        total(~F.col("in_seed"), "size").alias("dedup_size_not_in_seed"), total(neither, "size").alias("dedup_size_not_in_seed_nor_cache"),
        F.when(F.count_if(neither & ~known) == 0, total(neither, "compressed_size")).otherwise(0).alias("dedup_size_not_in_seed_nor_cache_compressed"),
    )
    all_rows = index.groupBy(key).agg(F.count("*").alias("total"), F.max(F.col("start") + F.col("size")).alias("size"))
    return all_rows.join(per, key)


def size_conflicts(index: DataFrame, sizes: DataFrame) -> DataFrame:
    """Ids whose uncompressed size in a chunk table differs from the index's: such a table doesn't belong to the index."""
    return index.select("id", "size").distinct().join(sizes.select("id", "uncompressed_size"), "id").where("size <> uncompressed_size")


def inspected(index: DataFrame, stored: DataFrame) -> DataFrame:
    """Every position with its id, uncompressed size and, where the store has the chunk, its stored size (else 0)."""
    per = stored.groupBy("id").agg(F.max("stored_size").alias("s"))
    return index.join(per, "id", "left").withColumn("compressed_size", F.coalesce("s", F.lit(0)).cast("long")).drop("s").withColumnRenamed("size", "uncompressed_size")
