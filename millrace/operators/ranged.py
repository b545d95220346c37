"""Chunking of files of any size by byte ranges: every range is read, tested and digested by a task of its own."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.rolling import WINDOW, Sizes, cut, digest
from millrace.operators.chunking import places
from millrace.plans.scratch import stored

RANGE = 64 << 20


def open_path(path: str) -> BinaryIO:
    """A file to seek and read in, by a path as Spark's listing spells it: local and mounted ones, and what pyarrow's file systems reach."""
    from urllib.parse import quote

    from pyarrow import fs

    scheme, colon, rest = path.partition(":")
    if not colon or "/" in scheme:
        return fs.LocalFileSystem().open_input_file(path)
    if scheme == "file":
        return fs.LocalFileSystem().open_input_file("/" + rest.lstrip("/"))
    system, inner = fs.FileSystem.from_uri(f"{scheme}:{quote(rest)}")
    return system.open_input_file(inner)


def files(spark: SparkSession, path: str) -> DataFrame:
    """path and total (bytes) of the files at a path; only the listing is read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("length").alias("total"))


def file_ranges(spark: SparkSession, path: str, length: int = RANGE) -> DataFrame:
    """path, total, part and begin of every range of `length` bytes of the files at a path; an empty file has none."""
    parts = F.sequence(F.lit(0).cast("long"), F.expr(f"(total - 1) div {length}"))
    return files(spark, path).where("total > 0").select("path", "total", F.explode(parts).alias("part")).withColumn("begin", F.col("part") * length)


def range_places(ranges: DataFrame, sizes: Sizes, length: int, opened: Callable[[str], BinaryIO]) -> DataFrame:
    """The ranges with `places`: candidates from begin to `most` bytes past the range, for chunks that begin in it end there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                b = batch.slice(k, 1)
                path, begin = b.column("path")[0].as_py(), b.column("begin")[0].as_py()
                lead = min(WINDOW - 1, begin)
                with opened(path) as f:
                    f.seek(begin - lead)
                    data = f.read(lead + length + sizes.most)
                found = [p + begin - lead for p in places(data, sizes)]
                yield pa.record_batch([*b.columns, pa.array([found], pa.list_(pa.int64()))], [*b.schema.names, "places"])

    return ranges.mapInArrow(run, "path string, total long, part long, begin long, places array<long>")


def range_cuts(found: DataFrame, sizes: Sizes, length: int) -> DataFrame:
    """path, pos and start of the first chunk that begins in a range, and ends of all such; ranges where none begins are left out.

    The only walk in order: it streams a file's sparse candidates range by range and holds no more than one range's.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = None
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["path"] != path:
                    path, pos, start, due = r["path"], 0, 0, 0
                if r["part"] != due:
                    raise ValueError(f"range {due} of {path} is missing or there twice")
                due += 1
                stop = min(r["begin"] + length, r["total"])
                ends, at = [], start
                # A chunk that begins here is cut as if the file ended `most` bytes past the range: it ends before.
                for end in cut(min(r["total"], stop + sizes.most) - start, [p - start for p in r["places"] if p >= start], sizes):
                    if at >= stop:
                        break
                    at = start + end
                    ends.append(at)
                if ends:
                    out.append({"path": path, "pos": pos, "start": start, "ends": ends})
                    pos, start = pos + len(ends), at
            yield pa.RecordBatch.from_pylist(out, pa.schema({"path": pa.string(), "pos": pa.int64(), "start": pa.int64(), "ends": pa.list_(pa.int64())}))

    return found.repartition("path").sortWithinPartitions("path", "part").mapInArrow(run, "path string, pos long, start long, ends array<long>")


def chunk_files(spark: SparkSession, path: str, sizes: Sizes, payload: bool = False, length: int = RANGE, opened: Callable[[str], BinaryIO] = open_path) -> DataFrame:
    """path, pos, start, size, id and, if asked for, payload of every chunk of the files at a path, as chunk_index cuts them.

    A task holds one range of `length` bytes (the largest chunk at least) and what overlaps, so files have no
    limit. Bytes are read twice, once for boundaries and once for digests, and never shuffled; between the two,
    the candidates and cuts are written to the shared folder. An empty file has no chunks; a file that changes
    meanwhile raises if it became shorter.
    """
    if length < sizes.most:
        raise ValueError("a range holds the largest chunk at least")
    ranges = file_ranges(spark, path, length)
    n = min(max(ranges.count(), 1), 10_000)
    found = stored(range_places(ranges.repartition(n), sizes, length, opened), "places")
    cuts = stored(range_cuts(found, sizes, length), "cuts")
    schema = "path string, pos long, start long, size long, id string" + ", payload binary" * payload

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                starts = [r["start"], *r["ends"][:-1]]
                with opened(r["path"]) as f:
                    f.seek(r["start"])
                    data = memoryview(f.read(r["ends"][-1] - r["start"]))
                if len(data) < r["ends"][-1] - r["start"]:
                    raise ValueError(f"{r['path']} became shorter")
                parts = [data[a - r["start"] : b - r["start"]] for a, b in zip(starts, r["ends"], strict=True)]
                columns = [pa.array([r["path"]] * len(parts), pa.string()), pa.array(range(r["pos"], r["pos"] + len(parts)), pa.int64()), pa.array(starts, pa.int64())]
                columns += [pa.array([len(p) for p in parts], pa.int64()), pa.array([digest(p, sizes.digest) for p in parts], pa.string())]
                columns += [pa.array([bytes(p) for p in parts], pa.binary())] * payload
                yield pa.record_batch(columns, ["path", "pos", "start", "size", "id", *["payload"] * payload])

    return cuts.repartition(n).mapInArrow(run, schema)
