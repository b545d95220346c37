"""What the corpus operators share: scratch tables, checkpoints and Arrow helpers."""

from __future__ import annotations

import ctypes
import gc
import sys
import tempfile
import types
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Where the session names none: a fresh temporary one if all runs on this machine, else an error."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="millrace-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(base)
    return base


SCRATCH: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """The path of a new scratch table in the shared folder."""
    SCRATCH.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return SCRATCH[-1]


def discard_scratch(spark: SparkSession) -> None:
    """Delete the scratch tables made so far; to be called once the results that read them are written."""
    while SCRATCH:
        path = spark._jvm.org.apache.hadoop.fs.Path(SCRATCH.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def let_go(spark: SparkSession, since: int | None = None) -> None:
    """Free disk between the steps of a query: the shuffle files of what was written before, which stay until the driver
    happens to collect its garbage, and the scratch tables from number `since` on, but for the last."""
    for path in SCRATCH[since:-1] if since is not None else []:
        SCRATCH.remove(path)
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    gc.collect()
    spark._jvm.System.gc()


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    shared_dir(df.sparkSession)
    return df.checkpoint()


BATCH_BYTES = 6 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Have Spark hand Python batches of a few MB: 10,000 long texts at once need not fit in a worker's memory."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name, "64m").lower().removesuffix("b")
    units = {"k": 10, "m": 20, "g": 30}
    size = int(now[:-1]) << units[now[-1]] if now[-1:] in units else int(now)
    if not 0 < size <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """Only the columns an operator needs, a null text as the empty one."""
    bounded_batches(docs.sparkSession)
    return docs.select("doc_id", *more, F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))


def text_hash(text: str | Column = "text") -> Column:
    """A hash of a row's text (null as the empty one): with doc_id it names a row, but for rows alike in both."""
    return F.xxhash64(F.coalesce((F.col(text) if isinstance(text, str) else text).cast("string"), F.lit("")))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of df has, in any case."""
    taken = {c.lower() for c in df.columns}
    return [next(n for k in range(len(taken) + 1) if (n := f"{x} {k}") not in taken) for x in names]


def unsent(df: DataFrame) -> DataFrame:
    """df as a side of a join that meets the other one by a shuffle: what grows with the input isn't broadcast through the driver, however small Spark takes it for."""
    return df.hint("merge")


def without(docs: DataFrame, bad: DataFrame) -> DataFrame:
    """docs without the rows that bad (doc_id, text_hash) names; all columns kept, whatever their names."""
    names = fresh(docs, "doc of", "hash of")
    bad = bad.select(F.col("doc_id").alias(names[0]), F.col("text_hash").alias(names[1])).distinct()
    return docs.join(unsent(bad), docs["doc_id"].eqNullSafe(F.col(f"`{names[0]}`")) & (text_hash(docs["text"]) == F.col(f"`{names[1]}`")), "left_anti")


def salted(large: DataFrame, small: DataFrame, on: list[str], by: str, ways: int = 16, how: str = "inner") -> DataFrame:
    """large joined with small on `on`; rows of a hot key of large are dealt to `ways` tasks by the column `by`, small is repeated."""
    a = large.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(ways)))
    b = small.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(ways - 1)))).withColumn("salt", F.col("salt").cast("long"))
    return a.join(unsent(b), [*on, "salt"], how).drop("salt")


def dealt(large: DataFrame, small: DataFrame, on: str, by: str, buckets: int = 1 << 16, most: int = 1024) -> DataFrame:
    """large joined with small on the column `on`, of which small holds each value once, and large any number of times.

    Rows of large are counted in `buckets` buckets of values (so the counts have a bound and are broadcast). Those of a
    bucket with far more than its share are dealt by the column `by` to as many tasks as it holds shares, `most` at
    most, and small's rows of that bucket are repeated as often; all others meet once, unrepeated.
    """
    bucket = F.pmod(F.xxhash64(on), F.lit(buckets))
    counts = checkpointed(large.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n")))
    share = max(256, 4 * (counts.agg(F.sum("n")).first()[0] or 0) // buckets)
    ways = F.broadcast(counts.where(F.col("n") > share).select("bucket", F.least(F.ceil(F.col("n") / share), F.lit(most)).cast("long").alias("ways")))
    n = F.coalesce("ways", F.lit(1).cast("long"))
    a, b = (t.withColumn("bucket", bucket).join(ways, "bucket", "left") for t in (large, small))
    a = a.withColumn("salt", F.pmod(F.xxhash64(by), n)).drop("bucket", "ways")
    b = b.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), n - 1))).drop("bucket", "ways")
    return a.join(unsent(b), [on, "salt"]).drop("salt")


def give_back() -> None:
    """Return freed memory to the system: workers live on, and what they no longer use others need."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def slices(batches: Iterator[pa.RecordBatch], most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each holds about `most` bytes; a longer row stays whole."""
    for batch in batches:
        if not batch.num_rows:
            continue
        step = max(1, int(batch.num_rows * most / max(batch.get_total_buffer_size(), 1)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)
        give_back()


def kept(kind: str, make: Callable, *args):
    """make(*args), kept by the Python worker from one task to the next; only the last one made is.

    It must not change what a task returns.
    """
    home = sys.modules.setdefault("_kept_by_worker", types.ModuleType("_kept_by_worker"))
    held = home.__dict__.setdefault("held", {})
    if (kind, args) not in held:
        held.clear()
        held[kind, args] = make(*args)
    return held[kind, args]


def list_array(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    flat = np.concatenate(parts) if parts else np.zeros(0, kind.to_pandas_dtype())
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, type=kind))


def unsigned_crc(col) -> Column:
    """crc32 of an id written as decimal text, as the labels' folds are fixed."""
    return F.crc32(col.cast("string").cast("binary"))
