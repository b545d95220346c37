"""SimHash near-duplicate detection with Golay-code fuzzy hashing (operator 10)."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import checkpointed, dealt, fresh, salted, slices, stored, text_hash, texts, unsent
from millrace.plans.components import components

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
SEED = 42


def fingerprint(text: str, size: int = 4) -> int:
    """64-bit SimHash of a text's word shingles, as a signed number; every shingle counts as often as it occurs."""
    words = text.encode("utf-8", "surrogatepass").translate(LOWER).split()  # splits at \x20 and \x09-\x0D
    if not words:
        return 0
    line = memoryview(b" ".join(words))
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    begins = [0, *(ends[:-1] + 1).tolist()]
    ends = ends.tolist()[size - 1 :] or [len(line)]
    total = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for k in range(0, len(ends), 1 << 16):  # bounds the memory of a very long text
        h = np.array([digest(line[a:b], SEED) for a, b in zip(begins[k : k + (1 << 16)], ends[k : k + (1 << 16)], strict=False)], "<u8")
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > len(ends), bitorder="little").view("<i8")[0])


# The binary Golay code of length 23: cyclic, with this generator polynomial (a fixed value).
GENERATOR, LENGTH, CHECKS = 0b101011100011, 23, 11


def syndrome(word: int) -> int:
    for k in range(LENGTH - 1, CHECKS - 1, -1):
        if word >> k & 1:
            word ^= GENERATOR << (k - CHECKS)
    return word


class Golay:
    """Keys of 23-bit words: the upper 12 bits of near codewords, which determine them.

    The code is perfect: every word has one codeword within three errors, its own. A word at three errors has
    five more codewords at four. So words that differ in one bit find each other's own codeword among their
    six (or one), and words that differ in two share one of them.
    """

    def __init__(self):
        single = [syndrome(1 << k) for k in range(LENGTH)]
        patterns: dict[int, list[int]] = {0: [0]}
        for weight in range(1, 5):
            for bits in combinations(range(LENGTH), weight):
                s = 0
                for k in bits:
                    s ^= single[k]
                have = patterns.setdefault(s, [])
                if weight <= 3 or have[0].bit_count() == 3:
                    have.append(sum(1 << k for k in bits))
        self.errors = np.full((1 << CHECKS, 6), -1, np.int64)
        for s, p in patterns.items():
            self.errors[s, : len(p)] = p
        self.low = np.array([self.slow(x, single) for x in range(1 << 12)], np.int64)
        self.high = np.array([self.slow(x << 12, single) for x in range(1 << 11)], np.int64)

    @staticmethod
    def slow(word: int, single: list[int]) -> int:
        s = 0
        for k in range(LENGTH):
            if word >> k & 1:
                s ^= single[k]
        return s

    def keys(self, words: np.ndarray) -> np.ndarray:
        """[n, 6]: the own codeword first; -1 where there are no more."""
        e = self.errors[self.low[words & 4095] ^ self.high[words >> 12]]
        return np.where(e < 0, -1, (words[:, None] ^ e) >> CHECKS)


CUTS = ((0, 22), (22, 21), (43, 21))  # three segments (first bit, bits) of the fingerprint
PAIRS = ((0, 1), (0, 2), (1, 2))


def key_rows(fps: np.ndarray, code: Golay) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, side, place in fps): two fingerprints within 4 bits share a key of different sides.

    Four errors on three segments leave two with at most one error each, or one segment without and two with two
    errors each. For the first, side 0 joins the own codeword of one segment with all keys of another, and side 1
    the reverse: each finds the other's own. For the second, both sides join a segment's bits with all keys of
    the next.
    """
    u = fps.view(np.uint64)
    seg = [(u >> np.uint64(a)).astype(np.int64) & ((1 << n) - 1) for a, n in CUTS]
    keys = [code.keys(s) for s in seg]
    out = []
    for table, (a, b) in enumerate(PAIRS):
        for side, k in ((0, np.where(keys[b] < 0, -1, keys[a][:, :1] << 12 | keys[b])), (1, np.where(keys[a] < 0, -1, keys[a] << 12 | keys[b][:, :1]))):
            out.append((k, table, side))
    for a in range(3):
        b = keys[(a + 1) % 3]
        k = np.where(b < 0, -1, seg[a][:, None] << 12 | b)
        out += [(k, 3 + a, 0), (k, 3 + a, 1)]
    where = [np.nonzero(k >= 0) for k, _, _ in out]
    return (
        np.concatenate([k[w] | table << 40 for (k, table, _), w in zip(out, where, strict=True)]),
        np.concatenate([np.full(len(w[0]), side, np.int8) for (_, _, side), w in zip(out, where, strict=True)]),
        np.concatenate([w[0] for w in where]),
    )


def fingerprints(docs: DataFrame, size: int = 4) -> DataFrame:
    """doc_id, text_hash and fp (long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            fps = [fingerprint(t, size) for t in b.column("text").to_pylist()]
            yield pa.record_batch([b.column("doc_id").cast(pa.int64()), b.column("text_hash"), pa.array(fps, pa.int64())], ["doc_id", "text_hash", "fp"])

    return texts(docs).select("doc_id", text_hash().alias("text_hash"), "text").mapInArrow(run, "doc_id long, text_hash long, fp long")


def links(nodes: DataFrame, most: int = 4) -> DataFrame:
    """(x, y), x < y: all pairs of different fingerprints of nodes (column fp, distinct) that differ in `most` bits or fewer, 4 at most.

    A pair can share several keys of several tables; the join keeps it in the first table that must hold it, and
    only there, so rows don't multiply.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Golay()
        for b in batches:
            for at in range(0, b.num_rows, 1 << 13):
                fps = b.column("fp").slice(at, 1 << 13).to_numpy()
                key, side, k = key_rows(fps, code)
                yield pa.record_batch([pa.array(key), pa.array(side), pa.array(fps[k])], ["key", "side", "fp"])

    keys = nodes.select("fp").mapInArrow(run, "key long, side byte, fp long")
    x = keys.where("side = 0").select("key", F.col("fp").alias("x"))
    y = keys.where("side = 1").select("key", F.col("fp").alias("y"))
    apart = F.col("x").bitwiseXOR(F.col("y"))
    e = [F.bit_count(apart.bitwiseAND(F.lit(((1 << n) - 1) << a if a + n < 64 else (((1 << n) - 1) << a) - (1 << 64)))) for a, n in CUTS]
    few = [(e[a] <= 1) & (e[b] <= 1) for a, b in PAIRS]
    first = F.when(few[0], 0).when(few[1], 1).when(few[2], 2).when(e[0] == 0, 3).when(e[1] == 0, 4).otherwise(5)
    on = (x["key"] == y["key"]) & (F.col("x") < F.col("y")) & (F.bit_count(apart) <= min(most, 4)) & (F.shiftright(x["key"], 40) == first)
    return x.join(unsent(y), on).select("x", "y").distinct()


def grouped(docs: DataFrame, size: int, most: int) -> DataFrame:
    """doc_id, text_hash, fp, component (a fingerprint that names the group) and component_id of every row; see near_duplicates."""
    fps = stored(fingerprints(docs, size), "fingerprints")
    nodes = checkpointed(fps.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("least")))
    # Fingerprints are the nodes: a doc_id may stand over texts that have nothing to do with one another.
    of = checkpointed(components(links(nodes, most).select(F.col("x").alias("a"), F.col("y").alias("b")), checkpointed).withColumnRenamed("node", "fp"))
    linked = nodes.join(unsent(of), "fp")
    roots = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    named = salted(linked, roots, ["component"], "fp").select("fp", "component", "component_id")
    # One fingerprint may stand over a third of all rows.
    out = dealt(fps.where("doc_id is not null"), nodes.join(unsent(named), "fp", "left"), "fp", "doc_id")
    out = out.select("doc_id", "text_hash", "fp", F.coalesce("component", "fp").alias("component"), F.coalesce("component_id", "least").alias("component_id"))
    none = F.lit(None).cast("long")
    return out.union(fps.where("doc_id is null").select("doc_id", "text_hash", "fp", none, none))


def near_duplicates(docs: DataFrame, size: int = 4, most: int = 4) -> DataFrame:
    """doc_id, text_hash, fp (long) and component_id (the smallest doc_id reachable over links) of every row.

    Rows with one fingerprint are one node from the start, so groups of copies of any size cost nothing more;
    links join different fingerprints. A null or empty text has fingerprint 0. A row without doc_id takes no
    part in any group and has no component_id. Rows that repeat, or share a doc_id, keep a row each, and are
    grouped by their own texts. An empty table gives no rows. Other columns are left out.
    """
    return grouped(docs, size, most).drop("component")


def fingerprint_digests(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def without_near_duplicates(docs: DataFrame) -> DataFrame:
    """docs with one row of each group, all columns kept: the smallest doc_id's, of several of that id the one of the
    smallest text hash, of rows alike in both any one. Rows that share a doc_id and aren't near duplicates stay; so do
    rows without doc_id.
    """
    found = grouped(docs, 4, 4).where("doc_id is not null")
    own, key = fresh(docs, "doc of", "hash of")
    row = F.struct(F.col("doc_id").alias(own), F.col("text_hash").alias(key))
    keep = stored(found.groupBy("component").agg(F.min(row).alias("row")).select("row.*"), "survivors")
    twice = found.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n")).where("n > 1")
    out = docs.join(unsent(keep), (docs["doc_id"] == F.col(f"`{own}`")) & (text_hash(docs["text"]) == F.col(f"`{key}`")), "left_semi")
    if not twice.isEmpty():  # rows alike in id and text: any one of them
        out = out.withColumn(key, text_hash(docs["text"])).dropDuplicates(["doc_id", key]).drop(key)
    return out.union(docs.where("doc_id is null"))
