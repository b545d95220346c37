"""Harmonic packing of token ids into sequences (operator 7)."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import kept, slices, texts
from millrace.llm.tokens import Encoder

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


class Part:
    """Ids of a document from `start` on that aren't packed yet."""

    __slots__ = ("doc", "ids", "first", "total", "start", "stop")

    def __init__(self, doc, ids: np.ndarray, first: int, total: int, start: int, stop: int):
        # ids begin at the document's place `first`; the document has `total`.
        self.doc, self.ids, self.first, self.total, self.start, self.stop = doc, ids, first, total, start, stop

    def __len__(self) -> int:
        return self.stop - self.start

    def taken(self, most: int) -> Part:
        """The first ids, `most` at most, as a part of their own."""
        end = min(self.stop, self.start + most)
        out = Part(self.doc, self.ids, self.first, self.total, self.start, end)
        self.start = end
        return out


class Bins:
    """One worker's bins, independent of all others'.

    A part of more than capacity / (j + 1) and at most capacity / j ids is of class j, and a bin of class j is
    closed once it holds j parts: its fixed count. What a closed bin lacks, at most capacity / (j + 1), is filled
    from a reserve of parts, the only ones that are cut (besides documents longer than a sequence, which give
    whole sequences first). The reserve is kept at a sequence's length at least by putting the next parts there.
    So closed bins are always full. Parts that wait: less than one bin of each class, of which there are about
    2 * sqrt(capacity), and the reserve.
    """

    def __init__(self, capacity: int, first: int):
        self.capacity, self.next = capacity, first
        self.open: dict[int, list[Part]] = {}
        self.reserve: deque[Part] = deque()
        self.held = 0  # ids in reserve

    def drawn(self, most: int) -> Iterator[Part]:
        """`most` ids from the reserve, or all it has."""
        while most and self.reserve:
            part = self.reserve[0].taken(most)
            most -= len(part)
            self.held -= len(part)
            if not len(self.reserve[0]):
                self.reserve.popleft()
            yield part

    def close(self, parts: list[Part]) -> Iterator[tuple]:
        at = 0
        for p in parts:
            yield p.doc, p.start, len(p), p.ids[p.start - p.first : p.stop - p.first].astype("<u4").tobytes(), p.total, self.next, at
            at += len(p)
        self.next += 1

    def place(self, doc, ids: np.ndarray) -> Iterator[tuple]:
        """Take a document; gives back the rows of the bins that are full now."""
        rest = Part(doc, ids, 0, len(ids), 0, len(ids))
        while len(rest) >= self.capacity:
            yield from self.close([rest.taken(self.capacity)])
        if not len(rest):
            return
        rest.ids, rest.first = rest.ids[rest.start :].copy(), rest.start  # what waits must not hold a batch's ids
        if self.held < self.capacity:
            self.reserve.append(rest)
            self.held += len(rest)
            return
        count = self.capacity // len(rest)
        own = self.open.setdefault(count, [])
        own.append(rest)
        if len(own) == count:
            del self.open[count]
            yield from self.close([*own, *self.drawn(self.capacity - sum(map(len, own)))])

    def rest(self) -> Iterator[tuple]:
        """What no bin completed, longest parts first, laid end to end: whole sequences, then ones of powers of two."""
        left = sorted((p for own in self.open.values() for p in own), key=len, reverse=True)
        self.reserve.extendleft(reversed(left))
        self.held += sum(map(len, left))
        self.open = {}
        while self.held:
            room = self.capacity if self.held >= self.capacity else 1 << (self.held.bit_length() - 1)
            yield from self.close(list(self.drawn(room)))


def pack(docs: DataFrame, tokenizer: str, end: int | None = 1, capacity: int = 2048) -> DataFrame:
    """Pieces of documents in sequences of at most `capacity` ids (a power of two), with no padding.

    Each task packs the documents it reads (see Bins): nothing is shuffled, and a sequence number holds the task's
    number in its upper bits, so tasks need not agree. Every sequence is full, but for at most log2(capacity) of
    each task, whose fill is a power of two. Returns doc_id, start (its document's ids before the piece), length,
    ids (little-endian uint32), doc_tokens, sequence_id and offset. A null text is empty (the end id alone is
    packed); a null doc_id and repeated ids are packed like any others; other columns are left out; an empty
    table gives no rows.
    """
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, bins = kept("encoder", Encoder, tokenizer, end), Bins(capacity, TaskContext.get().partitionId() << 36)
        for b in slices(batches, 6 << 20):
            full: list[tuple] = []
            for doc, ids in zip(b.column("doc_id").to_pylist(), coder.encode(b.column("text")), strict=True):
                full += bins.place(doc, ids)
            yield rows(full)
        yield rows(list(bins.rest()))

    return texts(docs).mapInArrow(run, SCHEMA)


def rows(pieces: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*pieces, strict=True)) if pieces else [()] * 7
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])


def packing_digests(packed: DataFrame) -> DataFrame:
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
