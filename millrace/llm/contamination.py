"""Benchmark decontamination with a distributed positional inverted index (operator 8)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import list_array, salted, slices, stored, text_hash, texts, without

# A-Z to a-z; every byte that belongs to no word to a space. Bytes above 0x7F are parts of words.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
NONE = np.zeros(0, np.int32)


def words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(WORD_BYTES).split()


INDEX_SCHEMA = "block long, term binary, places array<int>, docs array<long>, hashes array<long>, sizes array<int>"
INDEX_OPTIONS = {"compression": "zstd", "parquet.writer.version": "v2"}


def build_index(docs: DataFrame, block_words: int = 2_000_000) -> DataFrame:
    """Positional postings of all terms in all documents, written to the shared folder.

    A block holds whole documents with about `block_words` words (a longer document is a block of its own) and is
    built where the documents are read: nothing is shuffled. Its documents are laid end to end, with a gap of one
    between them, and a posting is a place on that line. A row for each block and term: `places`; and one for each
    block, with a null term: its documents' ids, text hashes and counts of words.
    """

    def block(number: int, ids: list, hashes: list, sizes: list[int], found: list[np.ndarray], terms: dict[bytes, int]) -> pa.RecordBatch:
        counts = np.array(sizes, np.int64)
        codes = np.concatenate([*found, NONE])
        places = (np.arange(len(codes)) + np.repeat(np.arange(len(sizes)), counts)).astype(np.int32)
        order = np.argsort(codes.astype(np.uint16) if len(terms) < 1 << 16 else codes, kind="stable")
        offsets = np.concatenate([[0], np.cumsum(np.bincount(codes, minlength=len(terms))), [len(codes)]]).astype(np.int32)
        postings = pa.ListArray.from_arrays(pa.array(offsets), pa.array(places[order]))
        last = lambda x, kind: pa.array([*[None] * len(terms), x], pa.list_(kind))
        return pa.record_batch(
            [pa.array(np.full(len(terms) + 1, number)), pa.array([*terms, None], pa.binary()), postings, last(ids, pa.int64()), last(hashes, pa.int64()), last(sizes, pa.int32())],
            ["block", "term", "places", "docs", "hashes", "sizes"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids, hashes, sizes, found, terms, total = [], [], [], [], {}, 0
        for b in slices(batches):
            each = [words(t) for t in b.column("text").to_pylist()]
            flat = pa.array([w for ws in each for w in ws], pa.binary()).dictionary_encode()
            own = np.array([terms.setdefault(w, len(terms)) for w in flat.dictionary.to_pylist()], np.int32)
            found.append(np.take(own, flat.indices.to_numpy()) if len(flat) else NONE)
            sizes += map(len, each)
            ids += b.column("doc_id").to_pylist()
            hashes += b.column("text_hash").to_pylist()
            total += len(flat)
            if total >= block_words:
                yield block(number, ids, hashes, sizes, found, terms)
                ids, hashes, sizes, found, terms, total, number = [], [], [], [], {}, 0, number + 1
        if ids:
            yield block(number, ids, hashes, sizes, found, terms)

    rows = texts(docs).select(F.col("doc_id").cast("long").alias("doc_id"), text_hash().alias("text_hash"), "text")
    return stored(rows.mapInArrow(run, INDEX_SCHEMA), "postings", **INDEX_OPTIONS)


class Block:
    """Posting lists of a block."""

    def __init__(self, lists: dict[bytes, np.ndarray], sizes: np.ndarray | None = None):
        self.lists = lists
        if sizes is not None:
            self.sizes = np.asarray(sizes, np.int64)
            self.begins = np.cumsum(self.sizes + 1) - self.sizes - 1

    @staticmethod
    def of(terms: pa.Array, places: pa.Array) -> Block:
        at, flat = places.offsets.to_numpy(), places.values.to_numpy(zero_copy_only=False)
        return Block({t: flat[a:b] for t, a, b in zip(terms.to_pylist(), at[:-1], at[1:], strict=True) if t is not None})

    def count(self, term: bytes) -> int:
        return len(self.postings(term))

    def postings(self, term: bytes) -> np.ndarray:
        return self.lists.get(term, NONE)

    def phrase(self, terms: Sequence[bytes]) -> np.ndarray:
        """Where the phrase begins: the list of its rarest term, cut down by the others' offset-adjusted lists."""
        order = sorted(range(len(terms)), key=lambda k: self.count(terms[k]))
        if not self.count(terms[order[0]]):
            return NONE
        found = self.postings(terms[order[0]]) - order[0]
        found = found[found >= 0]
        for k in order[1:]:
            if not len(found):
                break
            there = self.postings(terms[k])
            at = np.searchsorted(there, found + k)
            found = found[there[np.minimum(at, len(there) - 1)] == found + k]
        return found

    def near(self, terms: Sequence[bytes], within: int) -> np.ndarray:
        """Places of the rarest term such that all terms stand within `within` words after or before it, in its document."""
        order = sorted(set(terms), key=self.count)
        if not order or not self.count(order[0]):
            return NONE
        found = self.postings(order[0])
        for term in order[1:]:
            there = self.postings(term)
            doc = np.searchsorted(self.begins, found, "right") - 1
            low = np.maximum(found - within, self.begins[doc])
            high = np.minimum(found + within, self.begins[doc] + self.sizes[doc] - 1)
            found = found[np.searchsorted(there, low) < np.searchsorted(there, high, "right")]
        return found

    def document(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.begins, places, "right") - 1


def item_windows(benchmark: DataFrame, size: int) -> DataFrame:
    """window (its words, with blanks between them), n (their number), item_id: the windows of each item; an item of fewer words is one window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            row, found, count = [], [], []
            for k, text in enumerate(b.column("text").to_pylist()):
                w = words(text)
                for at in range(max(len(w) - size, 0) + 1 if w else 0):
                    row.append(k)
                    found.append(b" ".join(w[at : at + size]))
                    count.append(min(len(w), size))
            yield pa.record_batch([b.column("item_id").take(pa.array(row, pa.int64())), pa.array(found, pa.binary()), pa.array(count, pa.int32())], ["item_id", "window", "n"])

    kind = benchmark.schema["item_id"].dataType.simpleString()
    rows = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select("item_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"item_id {kind}, window binary, n int").distinct()


def occurrences(index: DataFrame, windows: DataFrame, most: int = 200_000) -> DataFrame:
    """block, starts, ends (the stretches of a block's line that windows cover), found and places (windows, and a place of each in each document).

    windows: window, distinct. Only posting lists of their terms are read. A window is looked for where its rarest
    term occurs, and dropped if one of its terms occurs nowhere. A task holds the wanted posting lists of one block
    and at most about `most` windows; beyond that they are dealt to several.
    """
    terms = windows.select("window", F.explode(F.split(F.col("window").cast("string"), " ")).alias("term")).distinct().withColumn("term", F.col("term").cast("binary"))
    wanted = stored(salted(index.where("term is not null").select("block", "term", "places"), terms.select("term").distinct(), ["term"], "block", 8), "wanted", **INDEX_OPTIONS)
    known = wanted.groupBy("term").agg(F.sum(F.size("places")).alias("n"))
    rarest = terms.join(known, "term", "left").groupBy("window").agg(F.min_by("term", F.struct("n", "term")).alias("term"), F.min(F.col("n").isNotNull()).alias("all")).where("all")
    parts = -(-max(windows.count(), 1) // most)
    dealt = rarest.select("window", "term", F.pmod(F.xxhash64("window"), F.lit(parts)).cast("int").alias("part"))
    places = dealt.join(wanted.select("block", "term"), "term").select("block", "part", "window")
    lists = wanted.select("block", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "term", "places")

    def look(lists: pa.Table, asked: pa.Table) -> pa.Table:
        if not asked.num_rows:
            return pa.table({c: pa.array([], k) for c, k in kinds.items()})
        lists = lists.combine_chunks()
        one = lists.num_rows > 0
        b = Block.of(lists.column("term").chunk(0), lists.column("places").chunk(0)) if one else Block({})
        begins, ends, found, places = [], [], [], []
        for window in asked.column("window").to_pylist():
            ws = window.split(b" ")
            if any(w not in b.lists for w in ws):
                continue
            if len(at := b.phrase(ws)):
                begins.append(at)
                ends.append(at + len(ws))
                found += [window] * len(at)
                places.append(at)
        block = asked.column("block")[0].as_py()
        return pa.table([pa.array([block], pa.int64()), *(pa.array([np.concatenate([*x, NONE])], pa.list_(pa.int32())) for x in (begins, ends)), pa.array([found], pa.list_(pa.binary())), pa.array([np.concatenate([*places, NONE])], pa.list_(pa.int32()))], list(kinds))

    kinds = {"block": pa.int64(), "starts": pa.list_(pa.int32()), "ends": pa.list_(pa.int32()), "found": pa.list_(pa.binary()), "places": pa.list_(pa.int32())}
    return lists.groupBy("block", "part").cogroup(places.groupBy("block", "part")).applyInArrow(look, "block long, starts array<int>, ends array<int>, found array<binary>, places array<int>")


def by_document(index: DataFrame, hits: DataFrame) -> DataFrame:
    """block, nth, doc_id, text_hash, n_words, spans and found (the windows) of every document of the index."""
    all_of = lambda c: F.flatten(F.collect_list(c)).alias(c)
    per = hits.where(F.size("starts") > 0).groupBy("block").agg(*(all_of(c) for c in ("starts", "ends", "found", "places")))
    rows = index.where("term is null").select("block", "docs", "hashes", "sizes").join(per, "block", "left")

    def one(block: int, docs: list, hashes: list, sizes: np.ndarray, starts, ends, found, places) -> pa.RecordBatch:
        b = Block({}, sizes)
        spans, named = [[] for _ in docs], [[] for _ in docs]
        if starts is not None:
            cover = np.zeros(int((b.sizes + 1).sum()) + 1, np.int32)
            np.add.at(cover, starts.values.to_numpy(), 1)
            np.add.at(cover, ends.values.to_numpy(), -1)
            edge = np.flatnonzero(np.diff(np.concatenate([[False], np.cumsum(cover[:-1]) > 0, [False]]).astype(np.int8)))
            doc = b.document(edge[::2])
            for d, s, e in zip(doc.tolist(), (edge[::2] - b.begins[doc]).tolist(), (edge[1::2] - b.begins[doc]).tolist(), strict=True):
                spans[d] += [s, e]
            for d, w in {(d, w) for d, w in zip(b.document(places.values.to_numpy()).tolist(), found.as_py(), strict=True)}:
                named[d].append(w)
        n = len(docs)
        return pa.record_batch(
            [pa.array([block] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(docs, pa.int64()), pa.array(hashes, pa.int64()), pa.array(b.sizes), pa.array(spans, pa.list_(pa.int32())), pa.array(named, pa.list_(pa.binary()))],
            ["block", "nth", "doc_id", "text_hash", "n_words", "spans", "found"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                r = {c: batch.column(c)[k] for c in batch.schema.names}
                lists = {c: r[c] if r[c].is_valid else None for c in ("starts", "ends", "found", "places")}
                yield one(r["block"].as_py(), r["docs"].as_py(), r["hashes"].as_py(), r["sizes"].values.to_numpy(), **lists)

    return rows.mapInArrow(run, "block long, nth int, doc_id long, text_hash long, n_words long, spans array<int>, found array<binary>")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, block_words: int = 2_000_000, most: int = 200_000) -> DataFrame:
    """Which words of each document lie in windows of benchmark items.

    Returns doc_id, text_hash, n_words, spans (begin and end of each covered stretch of words, end exclusive, one
    after another) and items (sorted ids of the items with occurring windows). The index is written once; the
    benchmark is a table like any other and passes through no single task. Nulls: a document without text
    has no words; benchmark rows without id or text are no items. Rows that share a doc_id are judged one by one.
    Items that repeat count once. Empty tables give no rows, or rows without hits. Other columns are left out.
    """
    index = build_index(docs, block_words)
    of = stored(item_windows(benchmark, window), "windows")
    hits = occurrences(index, of.select("window").distinct(), most)
    found = stored(by_document(index, hits), "found", compression="zstd")
    each = found.where(F.size("found") > 0).select("block", "nth", F.explode("found").alias("window"))
    items = salted(each, of.select("window", "item_id"), ["window"], "nth").groupBy("block", "nth").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    kind = f"array<{benchmark.schema['item_id'].dataType.simpleString()}>"
    clean = found.where(F.size("found") == 0).select("doc_id", "text_hash", "n_words", "spans", F.array().cast(kind).alias("items"))
    return clean.union(found.where(F.size("found") > 0).join(items, ["block", "nth"]).select("doc_id", "text_hash", "n_words", "spans", "items"))


def find(index: DataFrame, phrase: str, within: int | None = None) -> DataFrame:
    """Occurrences of a phrase in an index (doc_id, place in words), or, with `within`, of its words near one another.

    Only the posting lists of the phrase's words are read. A phrase without words occurs nowhere.
    """
    w = words(phrase)

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        b = Block.of(t.column("term").chunk(0), t.column("places").chunk(0))
        row = next(r for r in t.select(["term", "docs", "sizes"]).to_pylist() if r["term"] is None)
        b = Block(b.lists, row["sizes"])
        at = np.unique((b.phrase(w) if within is None else b.near(w, within)) if w else NONE)
        doc = b.document(at)
        return pa.table([pa.array([row["docs"][d] for d in doc], pa.int64()), pa.array((at - b.begins[doc]).astype(np.int64))], ["doc_id", "place"])

    wanted = index.where(F.col("term").isNull() | F.col("term").isin([bytearray(x) for x in set(w)]) if w else F.col("term").isNull())
    return wanted.groupBy("block").applyInArrow(run, "doc_id long, place long")


def verdicts(found: DataFrame) -> DataFrame:
    """The digest columns of `contamination`: contaminated from one word in twenty on.

    Built-in functions, so that a task keeps one Python worker, the index search's.
    """
    signed = F.transform("spans", lambda x, k: F.when(k % 2 == 0, -x).otherwise(x).cast("long"))
    hit = F.aggregate(signed, F.lit(0).cast("long"), lambda a, x: a + x)
    names = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    out = found.select("doc_id", "text_hash", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(names, ","), 256).alias("items_sha256"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 13) -> DataFrame:
    """docs without the documents that the verdict names, all columns kept. Every row is judged by its own text, whatever its doc_id."""
    return without(docs, verdicts(contamination(docs, benchmark, window)).where("contaminated"))
