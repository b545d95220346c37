"""Chunk indexes as tables: (key, pos, id, start, size)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.rolling import Sizes
from millrace.operators.chunking import digest_of
from millrace.sources.formats import SHA512_256, decode_index, encode_index


def numbered(chunks: DataFrame, key: str, *order: str) -> DataFrame:
    """One index for each key from the chunks of several blobs laid end to end in `order`: pos and start count on.

    All chunks of a key are one window; where chunks of a blob are numbered already, `laid_out` takes a window over blobs only.
    """
    w = Window.partitionBy(key).orderBy(*order)
    running = F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return chunks.select(key, (F.row_number().over(w) - 1).cast("long").alias("pos"), "id", F.coalesce(running, F.lit(0)).cast("long").alias("start"), "size")


def laid_out(chunks: DataFrame, key: str, blob: str) -> DataFrame:
    """numbered for chunks (key, blob, pos, id, start, size) whose pos and start count from their blob's begin: prefix
    sums in two levels, so a window holds a row for each blob of a key, not for each chunk. chunks are read twice."""
    totals = chunks.groupBy(key, blob).agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    before = Window.partitionBy(key).orderBy(blob).rowsBetween(Window.unboundedPreceding, -1)
    begin = totals.select(key, blob, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n"), F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes"))
    return chunks.join(begin, [key, blob]).select(key, (F.col("pos") + F.col("n")).alias("pos"), "id", (F.col("start") + F.col("bytes")).alias("start"), "size")


def to_offsets(index: DataFrame, key: str) -> DataFrame:
    """start and size to the end offsets that index files hold."""
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return index.select(key, "pos", "id", F.sum("size").over(w).alias("offset"))


def from_offsets(table: DataFrame, key: str) -> DataFrame:
    before = F.lag("offset", 1, 0).over(Window.partitionBy(key).orderBy("pos"))
    return table.select(key, "pos", "id", before.cast("long").alias("start"), (F.col("offset") - before).cast("long").alias("size"))


def lengths(index: DataFrame, key: str) -> DataFrame:
    """key, length (where the last chunk ends) and n_chunks."""
    return index.groupBy(key).agg(F.max(F.col("start") + F.col("size")).alias("length"), F.count("*").alias("n_chunks"))


def first_occurrence(index: DataFrame, key: str) -> DataFrame:
    """The first position of each id in each index."""
    return index.groupBy(key, "id").agg(F.min("pos").alias("pos"), F.min_by("size", "pos").alias("size"))


def sliced(index: DataFrame, blobs: DataFrame, key: str) -> DataFrame:
    """Index rows with the bytes they name, cut from blobs (key, data)."""
    return index.join(blobs, key).withColumn("payload", F.substring(F.col("data"), (F.col("start") + 1).cast("int"), F.col("size").cast("int"))).drop("data")


def invalid_chunks(index: DataFrame, blobs: DataFrame, key: str, kind: str = "sha256") -> DataFrame:
    """verify-index: rows whose bytes don't have the digest the index names."""
    return sliced(index, blobs, key).withColumn("own", digest_of(F.col("payload"), kind)).where("own <> id").drop("payload", "own")


def valid_name(name: Column) -> Column:
    """An index name that stays in its store: not empty, no dots alone, no separators."""
    return ~name.isin("", ".", "..") & ~name.contains("/") & ~name.contains("\\")


def to_files(index: DataFrame, sizes: Sizes) -> DataFrame:
    """name and data: the bytes of an index file for each name."""
    import pyarrow as pa

    flags = SHA512_256 if sizes.digest == "sha512_256" else 0

    def pack(t: pa.Table) -> pa.Table:
        t = t.sort_by("pos")
        data = encode_index(list(zip(t.column("id").to_pylist(), t.column("size").to_pylist(), strict=True)), sizes.least, sizes.average, sizes.most, flags)
        return pa.table([t.column("name").slice(0, 1), pa.array([data], pa.binary())], ["name", "data"])

    return index.select("name", "pos", "id", "size").groupBy("name").applyInArrow(pack, "name string, data binary")


def from_files(files: DataFrame, sizes: Sizes) -> DataFrame:
    """The rows of index files (name, data), every field of the format checked."""
    import pyarrow as pa

    def unpack(batches):
        for b in batches:
            for name, data in zip(b.column("name").to_pylist(), b.column("data").to_pylist(), strict=True):
                chunks = decode_index(data, sizes.digest)[1]
                ids, starts, counts = zip(*chunks, strict=True) if chunks else ((), (), ())
                n = len(ids)
                yield pa.record_batch([pa.array([name] * n, pa.string()), pa.array(range(n), pa.int64()), pa.array(ids, pa.string()), pa.array(starts, pa.int64()), pa.array(counts, pa.int64())], ["name", "pos", "id", "start", "size"])

    return files.select("name", "data").mapInArrow(unpack, "name string, pos long, id string, start long, size long")
