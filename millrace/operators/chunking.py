"""Content-defined chunking as a table function: blobs in, chunk indexes out."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.rolling import Sizes, candidates, cut, digest

PART, BLOCK = 64 << 20, 4 << 20


def blobs(df: DataFrame, data: Column, *keys: str) -> DataFrame:
    """Key columns and `data` as bytes; text as UTF-8, null as no bytes."""
    return df.select(*keys, F.coalesce(data.cast("binary"), F.lit(b"")).alias("data"))


def places(data: bytes, sizes: Sizes) -> list[int]:
    """Candidates of one blob; a large one in parts that overlap by the window, which bounds memory."""
    if len(data) <= BLOCK:
        return candidates(np.frombuffer(data, np.uint8), sizes).tolist()
    out: list[int] = []
    for at in range(0, len(data), BLOCK):
        begin = max(0, at - 47)
        out += [p for p in (candidates(np.frombuffer(data, np.uint8, min(at + BLOCK, len(data)) - begin, begin), sizes) + begin).tolist() if p >= at]
    return out


def batched_places(parts: list[bytes], sizes: Sizes) -> list[list[int]]:
    """Candidates of many small blobs at once: the hash looks back 48 bytes only, and no chunk is shorter."""
    if sum(map(len, parts)) > PART:
        return [places(p, sizes) for p in parts]
    found = candidates(np.frombuffer(b"".join(parts), np.uint8), sizes)
    ends = np.cumsum([len(p) for p in parts])
    cuts = np.searchsorted(found, ends)
    begins = ends - [len(p) for p in parts]
    return [(found[a:b] - s).tolist() for a, b, s in zip(np.concatenate([[0], cuts[:-1]]), cuts, begins, strict=True)]


def chunk_index(df: DataFrame, sizes: Sizes, ids: bool = True, payload: bool = False, begin: int = 0) -> DataFrame:
    """The key columns of df (all but data), then pos, start, size (longs), id (hex digest) and payload of every chunk.

    One Arrow pass, no shuffle. An empty blob has no chunks. `ids=False` gives boundaries only. With `begin`,
    chunking starts at that byte, as if the blob began there; starts still count from the blob's first byte.
    """
    keys = [f for f in df.schema.fields if f.name != "data"]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in keys] + ["pos long", "start long", "size long"] + ["id string"] * ids + ["payload binary"] * payload)
    names = [f.name for f in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, int(batch.num_rows * (8 << 20) / max(batch.get_total_buffer_size(), 1)))
            for at in range(0, batch.num_rows, step):
                b = batch.slice(at, step)
                data = [d[begin:] for d in b.column("data").to_pylist()]
                row, pos, start, size, names_of, parts = [], [], [], [], [], []
                for k, (d, found) in enumerate(zip(data, batched_places(data, sizes), strict=True)):
                    last = 0
                    for n, end in enumerate(cut(len(d), found, sizes)):
                        row.append(k)
                        pos.append(n)
                        start.append(begin + last)
                        size.append(end - last)
                        if ids:
                            names_of.append(digest(d[last:end], sizes.digest))
                        if payload:
                            parts.append(d[last:end])
                        last = end
                take = pa.array(row, pa.int64())
                columns = [b.column(c).take(take) for c in names] + [pa.array(x, pa.int64()) for x in (pos, start, size)]
                columns += [pa.array(names_of, pa.string())] * ids + [pa.array(parts, pa.binary())] * payload
                yield pa.record_batch(columns, [*names, "pos", "start", "size", *["id"] * ids, *["payload"] * payload])

    return df.select(*names, "data").mapInArrow(run, schema)


def candidate_counts(df: DataFrame, sizes: Sizes) -> DataFrame:
    """The key columns and n_candidates of every blob."""
    names = [f.name for f in df.schema.fields if f.name != "data"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name != "data") + ", n_candidates long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([*(b.column(c) for c in names), pa.array([len(x) for x in batched_lists(b, sizes)], pa.int64())], [*names, "n_candidates"])

    def batched_lists(b: pa.RecordBatch, sizes: Sizes) -> list[list[int]]:
        return [[p for p in found if p >= 47] for found in batched_places(b.column("data").to_pylist(), sizes)]

    return df.select(*names, "data").mapInArrow(run, schema)


def digest_of(data: Column, kind: str) -> Column:
    """The id of a chunk's bytes: built in for SHA-256, an Arrow function for others (SHA512/256 is the index format's default)."""
    if kind == "sha256":
        return F.sha2(data, 256)

    @F.pandas_udf("string")
    def other(parts: pd.Series) -> pd.Series:
        return parts.map(lambda p: None if p is None else digest(bytes(p), kind))

    return other(data)


def null_id(sizes: Sizes) -> str:
    """The id of the largest chunk of zero bytes."""
    return digest(bytes(sizes.most), sizes.digest)
