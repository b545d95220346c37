"""Line dedup with a log-template tree (operator 9)."""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from functools import reduce
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from millrace.llm.common import SCRATCH, fresh, let_go, list_array, salted, slices, stored, text_hash, texts, unsent

DIGIT = re.compile("[0-9]")
BLANK = "<*>"
FREE = 64  # the rank of a line that leads no group; more than there are rounds
ENDS, CLOSE = ".!?\u2026", "\"'\u201d\u2019)]\u00bb"  # of a sentence, and what may follow
LAST = frozenset(ENDS + CLOSE)
WORD = re.compile(r"\S+")
SHORT, LONG = 5, 50  # tokens: what is too short to stand alone inside a line, and a sentence that is cut further
LEAF_BITS = 26


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def cuts_of(tokens: list[str]) -> list[int]:
    """Where a line of these tokens is cut: the counts of tokens before each cut, the whole line's last.

    A line is cut where a sentence of SHORT tokens or more ends, so a shorter one goes with what follows it. A
    sentence of more than LONG tokens is cut like one with ends after those tokens that their hash picks. Each cut
    depends on the sentence before it alone, so a passage is cut alike wherever it stands.
    """
    ends = [k + 1 for k, t in enumerate(tokens) if t[-1] in LAST and (t[-1] in ENDS or t.rstrip(CLOSE)[-1:] in ENDS[:4])] if len(tokens) > SHORT else []
    out, last = [], 0
    for at in [*ends, len(tokens)]:
        if at - last > LONG:
            for k in range(last, at - 1):
                if zlib.crc32(tokens[k].encode("utf-8", "surrogatepass")) % 16 == 0:
                    if k + 1 - last >= SHORT:
                        out.append(k + 1)
                    last = k + 1
        if at - last >= SHORT and at < len(tokens):
            out.append(at)
        last = max(last, at)
    return [*out, len(tokens)]


def tokens_of(line: str) -> list[str]:
    """A line's tokens; one with a digit is a variable field."""
    tokens = line.split()
    return [BLANK if DIGIT.search(x) else x for x in tokens] if DIGIT.search(line) else tokens


def units_of(text: str) -> Iterator[tuple[list[str], bool]]:
    """The tokens of a text's units, in order, and whether a unit is a whole line.

    A line that isn't cut (see cuts_of) is one unit, of any length, if it holds a token; of one that is cut each
    part is, but for a last one of fewer than SHORT tokens, which stays. A token with a digit is a variable field.
    """
    for line in text.split("\n"):
        tokens = line.split()
        if not tokens:
            continue
        cuts = cuts_of(tokens)
        if DIGIT.search(line):
            tokens = [BLANK if DIGIT.search(x) else x for x in tokens]
        if len(cuts) == 1:
            yield tokens, True
            continue
        begin = 0
        for at in cuts:
            if at - begin >= SHORT:
                yield tokens[begin:at], False
            begin = at


def parts_of(line: str) -> list[tuple[str, bool]]:
    """A line's parts, which joined give it, and whether each is a unit (see units_of)."""
    starts = [m.start() for m in WORD.finditer(line)]
    if not starts:
        return [(line, False)]
    cuts = cuts_of(line.split())
    out, begin = [], 0
    for at in cuts:
        own = len(cuts) == 1 or at - begin >= SHORT
        out.append((line[starts[begin] if begin else 0 : starts[at] if at < len(starts) else len(line)], own))
        begin = at
    return out


def hashes_of(tokens: list[str], depth: int) -> tuple[int, int]:
    """A unit's leaf, found by the count of its tokens and then by the first `depth`, and its own hash. Units are told
    apart by both: 128 bits, but for those of one leaf."""
    digest = xxhash.xxh64_intdigest
    return signed(digest(f"{len(tokens)} {' '.join(tokens[:depth])}".encode("utf-8", "surrogatepass"))), signed(digest(" ".join(tokens).encode("utf-8", "surrogatepass")))


def keyed(docs: DataFrame) -> DataFrame:
    return texts(docs).select("doc_id", text_hash().alias("key"), "text")


def line_records(docs: DataFrame, depth: int) -> DataFrame:
    """doc_id, key (of the text), unit (its number), whole (is it a line), leaf and line_hash of every unit (see units_of)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            at, unit, whole, leaf, own = [], [], [], [], []
            for k, text in enumerate(b.column("text").to_pylist()):
                for n, (t, line) in enumerate(units_of(text)):
                    x, y = hashes_of(t, depth)
                    at.append(k)
                    unit.append(n)
                    whole.append(line)
                    leaf.append(x)
                    own.append(y)
            take = pa.array(at, pa.int64())
            yield pa.record_batch([b.column("doc_id").cast(pa.int64()).take(take), b.column("key").take(take), pa.array(unit, pa.int32()), pa.array(whole, pa.bool_()), pa.array(leaf, pa.int64()), pa.array(own, pa.int64())], ["doc_id", "key", "unit", "whole", "leaf", "line_hash"])

    return keyed(docs).mapInArrow(run, "doc_id long, key long, unit int, whole boolean, leaf long, line_hash long")


def bands_of(leaf: int, tokens: np.ndarray, depth: int, alike: float) -> list[int]:
    """Keys of a line's bands: one more than the places at which lines alike may differ, so any two of them share one."""
    n = len(tokens)
    count = n - math.ceil(alike * n) + 1
    ends = [depth + (n - depth) * k // count for k in range(count + 1)]
    return [signed(xxhash.xxh64_intdigest(tokens[a:b].tobytes(), (leaf + k) % (1 << 64))) for k, (a, b) in enumerate(pairwise(ends))]


def leaf_map(leaves: DataFrame) -> np.ndarray:
    """Bits of the leaves' hashes, 8 MB at most: a leaf whose bit is unset isn't among them."""
    bit = F.col("leaf").bitwiseAND((1 << LEAF_BITS) - 1)
    rows = leaves.groupBy(F.shiftright(bit, 15).alias("bucket")).agg(F.bitmap_construct_agg(bit.bitwiseAND(32767)).alias("bits"))
    out = np.zeros((1 << LEAF_BITS) // 8, np.uint8)
    for r in rows.collect():
        out[r.bucket * 4096 : (r.bucket + 1) * 4096] = np.frombuffer(r.bits, np.uint8)
    return out


def line_tokens(docs: DataFrame, leaves: DataFrame, depth: int, alike: float) -> DataFrame:
    """leaf, line_hash, the tokens (hashes) and the bands of the different whole lines of some leaves, read from the texts once more.

    Nothing but these lines is shuffled: the leaves are sent along as a map of bits. Some others come with them,
    which no band joins to any.
    """
    bits = docs.sparkSession.sparkContext.broadcast(leaf_map(leaves))
    mask = (1 << LEAF_BITS) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = bits.value
        for b in slices(batches):
            found: dict[tuple[int, int], np.ndarray] = {}
            for text in b.column("text").to_pylist():
                for line in text.split("\n"):
                    t = tokens_of(line)
                    if len(t) <= depth or not held[(x := (at := hashes_of(t, depth))[0] & mask) >> 3] >> (x & 7) & 1 or at in found:
                        continue
                    if len(cuts_of(line.split())) == 1:
                        found[at] = np.array([xxhash.xxh32_intdigest(w.encode("utf-8", "surrogatepass")) for w in t], np.uint32).view(np.int32)
            bands = [np.array(bands_of(x, t, depth, alike), np.int64) for (x, _), t in found.items()]
            yield pa.record_batch([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64()), list_array(list(found.values()), pa.int32()), list_array(bands, pa.int64())], ["leaf", "line_hash", "tokens", "bands"])

    rows = keyed(docs).mapInArrow(run, "leaf long, line_hash long, tokens array<int>, bands array<long>")
    return rows.groupBy("leaf", "line_hash").agg(F.first("tokens").alias("tokens"), F.first("bands").alias("bands"))


def templates(docs: DataFrame, different: DataFrame, depth: int, alike: float) -> DataFrame:
    """leaf, line_hash, template: for the different whole lines of leaves that hold several, the group each generalises to.

    A group has a leader, and its lines hold the leader's token at the share `alike` of places or more. Once the groups
    stand, each generalises to a template, and groups and lines that are instances of one go with it (see
    generalised). Lines alike share a band (see bands_of), so a line is compared with the first few
    lines of each of its bands, in rounds: of the lines found alike, those with no leader or line before them
    lead, those alike to a leader join the first such, and the others go on. A line leaves a band once all of
    the band was compared with it, and twice as many are compared in the next round, until no band holds two lines.
    A line in no group stands for itself. Most leaves of long lines hold one line, so tokens are read for few.
    """
    leaves = different.where("whole").groupBy("leaf").agg(F.count("*").alias("n")).where("n > 1").select("leaf")
    found = stored(line_tokens(docs, leaves, depth, alike), "leaves", compression="zstd")
    tokens = found.select("leaf", "line_hash", "tokens")
    # rank orders lines: leaders by the round that made them, then the others; their hashes decide.
    rest = found.select(F.explode("bands").alias("band"), F.struct(F.lit(FREE).alias("rank"), "leaf", "line_hash").alias("x"))
    alone = F.count("*").over(Window.partitionBy("band"))
    joined, made, heads = [], [], 1
    for k in range(FREE):
        rest = stored(rest.withColumn("n", alone).where("n > 1").drop("n"), f"bands{k}", compression="zstd")
        if rest.isEmpty():
            break
        first = rest.withColumn("nth", F.row_number().over(Window.partitionBy("band").orderBy("x"))).where(F.col("nth") <= heads).select("band", F.col("x").alias("head"))
        pairs = rest.join(first, "band").where((F.col("head") < F.col("x")) & (F.col("x.rank") == FREE)).select("x", "head").distinct()
        ours, theirs = (tokens.select(F.struct("leaf", "line_hash").alias(f"{c} of"), F.col("tokens").alias(c)) for c in ("ours", "theirs"))
        line = lambda c: F.struct(F.col(f"{c}.leaf").alias("leaf"), F.col(f"{c}.line_hash").alias("line_hash"))
        both = pairs.join(ours, line("x") == F.col("`ours of`")).join(theirs, line("head") == F.col("`theirs of`"))
        equal = F.size(F.filter(F.zip_with("ours", "theirs", lambda a, b: a == b), lambda e: e))
        near = stored(both.where(equal >= alike * F.size("ours")).select("x", "head"), f"alike{k}")
        lead = near.select(F.col("head").alias("x")).distinct().join(near.select("x"), "x", "left_anti")
        joins = stored(near.join(lead.select(F.col("x").alias("head")), "head").groupBy("x").agg(F.min("head").alias("head")), f"joined{k}")
        joined.append(joins.select("x.leaf", "x.line_hash", F.col("head.line_hash").alias("leader")))
        fresh = lead.where(F.col("x.rank") == FREE)
        made.append(fresh.select("x.leaf", "x.line_hash", F.col("x.line_hash").alias("leader")))
        # What a line that isn't placed yet was found alike to counts again in the next round.
        open_ = near.select("x").union(near.select(F.col("head").alias("x"))).distinct().join(lead, "x", "left_anti").withColumn("open", F.lit(True))
        left = rest.join(joins.select("x"), "x", "left_anti").join(open_, "x", "left").join(first.withColumnRenamed("head", "x").withColumn("was", F.lit(True)), ["band", "x"], "left")
        left = left.where("was is null or open").join(fresh.withColumn("leads", F.lit(True)), "x", "left")
        rest = left.select("band", F.struct(F.when(F.col("leads"), k).otherwise(F.col("x.rank")).alias("rank"), F.col("x.leaf").alias("leaf"), F.col("x.line_hash").alias("line_hash")).alias("x"))
        heads *= 2
    placed = [x for pair in zip(joined, made, strict=True) for x in pair]
    none = found.where(F.lit(False)).select("leaf", "line_hash", F.col("line_hash").alias("leader"))
    return generalised(found.select("leaf", "line_hash", "tokens"), stored(reduce(DataFrame.union, placed, none), "placed"), alike)


def generalised(lines: DataFrame, placed: DataFrame, alike: float) -> DataFrame:
    """leaf, line_hash, template of the lines that go with a group: the leader of the most general template they are instances of.

    lines: leaf, line_hash, tokens; placed: leaf, line_hash, leader of those in a group. A group's template has the token
    that the share `alike` of its lines or more hold at a place, or else a variable field there; a line in no group is
    its own template. One is an instance of another if it has all of its constants; only templates with constants
    at half their places or more take instances. What is an instance of an instance is one itself, so one join finds
    the most general template of each (fewest constants, then the smallest leader). Every line of a leaf is
    read once for each different set of variable fields in it, never against each template.
    """
    grouped = lines.join(unsent(placed), ["leaf", "line_hash"])
    held = grouped.select("leaf", "leader", F.posexplode("tokens").alias("place", "token")).groupBy("leaf", "leader", "place", "token").agg(F.count("*").alias("n"))
    places = held.groupBy("leaf", "leader", "place").agg(F.sum("n").alias("n"), F.max(F.struct("n", "token")).alias("top"))
    token = F.when(F.col("top.n") >= alike * F.col("n"), F.col("top.token")).alias("token")
    shapes = places.select("leaf", "leader", F.struct("place", token).alias("x")).groupBy("leaf", "leader").agg(F.array_sort(F.collect_list("x")).alias("x")).select("leaf", "leader", F.col("x.token").alias("shape"))
    alone = lines.join(unsent(placed.select("leaf", "line_hash")), ["leaf", "line_hash"], "left_anti")
    shapes = stored(shapes.union(alone.select("leaf", "line_hash", "tokens")), "shapes", compression="zstd")
    constants = F.size(F.filter("shape", lambda t: t.isNotNull()))
    broad = shapes.where((constants < F.size("shape")) & (2 * constants >= F.size("shape")))
    fields = broad.select("leaf", F.transform("shape", lambda t: t.isNull()).alias("fields")).distinct()
    seen = salted(shapes, fields, ["leaf"], "leader", 4).select("leaf", "leader", F.zip_with("shape", "fields", lambda t, f: F.when(~f, t)).alias("seen"))
    general = broad.select("leaf", F.col("shape").alias("seen"), F.struct(constants.alias("n"), F.col("leader").alias("leader")).alias("of"))
    named = seen.join(unsent(general), ["leaf", "seen"]).groupBy("leaf", "leader").agg(F.min("of").alias("of")).select("leaf", "leader", F.col("of.leader").alias("template"))
    named = stored(named, "named")
    out = placed.join(unsent(named), ["leaf", "leader"], "left").select("leaf", "line_hash", F.coalesce("template", "leader").alias("template"))
    single = alone.select("leaf", F.col("line_hash").alias("leader")).join(unsent(named), ["leaf", "leader"])
    return out.union(single.select("leaf", F.col("leader").alias("line_hash"), "template"))


def recurring(docs: DataFrame, depth: int = 3, alike: float = 0.8) -> DataFrame:
    """doc_id, key (a hash of the text) and the numbers of the units to drop: those whose template occurs in several
    documents, but for its first occurrence (smallest doc_id, a null last, then the smallest key and unit).

    Lines are first reduced to the different ones, where they are read, so one that a third of all documents hold
    costs no task more than others; the templates that recur are then dealt to several tasks for each line.
    """
    made = len(SCRATCH)
    lines = stored(line_records(docs, depth), "lines", compression="zstd")
    document = F.xxhash64("doc_id", "key")
    different = lines.groupBy("leaf", "line_hash").agg(F.max("whole").alias("whole"), F.min(document).alias("a"), F.max(document).alias("b"))
    different = stored(different, "different", compression="zstd")
    let_go(docs.sparkSession)
    named = stored(templates(docs, different, depth, alike), "templates")
    # What is in no group and in one document alone goes no further.
    of = different.where("whole").join(named, ["leaf", "line_hash"])
    of = of.unionByName(different.where("a <> b").join(named, ["leaf", "line_hash"], "left_anti").withColumn("template", F.col("line_hash")))
    groups = of.groupBy("leaf", "template").agg(F.min("a").alias("a"), F.max("b").alias("b")).where("a <> b").select("leaf", "template")
    again = salted(of.select("leaf", "line_hash", "template"), groups, ["leaf", "template"], "line_hash", 4)
    found = stored(salted(lines.drop("whole"), again, ["leaf", "line_hash"], "key", 8).select("leaf", "template", "doc_id", "key", "unit"), "recurring", compression="zstd")
    del lines, different, named, of, groups, again
    let_go(docs.sparkSession, made)  # the rest reads `found` alone
    place = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("doc_id"), F.col("key").alias("key"), F.col("unit").alias("unit"))
    firsts = found.groupBy("leaf", "template").agg(F.min(place).alias("first"))
    drop = salted(found, firsts, ["leaf", "template"], "key", 8).where(~place.eqNullSafe(F.col("first")))
    return drop.groupBy("doc_id", "key").agg(F.collect_set("unit").alias("units"))


@F.pandas_udf(StringType())
def left_over(text: pd.Series, gone: pd.Series) -> pd.Series:
    """A text without the units of the given numbers; a line that loses all of its parts goes as a whole."""

    def one(t: str | None, units) -> str | None:
        if t is None:
            return None
        out, n, lines = set(units.tolist()), 0, []
        for line in t.split("\n"):
            tokens = line.split()
            cuts = cuts_of(tokens) if tokens else []
            count = 1 if len(cuts) == 1 else sum(b - a >= SHORT for a, b in pairwise([0, *cuts]))
            if not out.isdisjoint(range(n, n + count)):
                keep, lost, k = [], False, n
                for part, own in parts_of(line):
                    lost = own and k in out
                    keep += [] if lost else [part]
                    k += own
                if keep:
                    lines.append("".join(keep).rstrip() if lost else "".join(keep))
            else:
                lines.append(line)
            n += count
        return "\n".join(lines)

    return pd.Series([one(t, g) for t, g in zip(text, gone, strict=True)], dtype=object)


def without_recurring_lines(docs: DataFrame, depth: int = 3, alike: float = 0.8, counts: bool = False) -> DataFrame:
    """docs with recurring lines taken out of text; with counts, also n_lines and n_dropped (units).

    Lines are taken as units (a line, or the sentences of one that holds several; see units_of). A unit belongs to a
    template of the tree (see hashes_of and templates): whole lines generalise, sentences inside longer lines recur only
    as they stand, but for fields with digits. Where a template occurs in two or more documents, every unit of it
    goes but the first. Units that recur in one document alone stay, and so do lines without a token. No
    document goes, whatever is left of it. A null text stays null; rows that repeat exactly (same doc_id and text) are
    one document; a null doc_id is ordered last. What remains is joined as it stood. An empty table gives no
    rows; all other columns stay (n_lines and n_dropped replace any of those names).
    """
    names = fresh(docs, "doc of", "key of", "units of")
    found = recurring(docs, depth, alike).toDF(*names)
    own, key, gone = (F.col(f"`{n}`") for n in names)
    out = docs.join(found, docs["doc_id"].eqNullSafe(own) & (text_hash(docs["text"]) == key), "left")
    n_lines = F.coalesce(F.size(F.split(F.col("text"), "\n", -1)), F.lit(0)).cast("long")
    if counts:
        out = out.withColumn("n_dropped", F.when(gone.isNull(), 0).otherwise(F.size(gone)).cast("long")).withColumn("n_lines", F.when(F.col("text").isNull(), 0).otherwise(n_lines).cast("long"))
    left = left_over(F.when(gone.isNotNull(), F.col("text")), gone)  # Python sees the texts that change, no others
    out = out.withColumn("text", F.when(gone.isNull(), F.col("text")).otherwise(left))
    more = ["n_lines", "n_dropped"] if counts else []
    return out.select(*(F.col(f"`{c}`") for c in docs.columns if c not in more), *more)
