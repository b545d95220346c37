"""Tokenising whole texts with a public tokenizer, and the Parquet format for token ids (operator 6).

A text is cut where the tokenizer itself always cuts (around single white space), and each distinct
piece is encoded by the tokenizers library once per Python worker; a document's ids are the pieces' ids joined.
Texts where such a cut could be wrong (white space in a row, text of special tokens) are encoded whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain, filterfalse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from millrace.llm.common import kept, list_array, scratch, slices, texts


# White space of any kind but the space and the line feed, as a class of the regular expressions below.
OTHER_SPACE = r"\t\x0b\f\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


class Encoder:
    """Texts to ids (arrays of uint32), with `end` after each.

    Cuts of the two kinds of pre-tokenizer: one drops white space altogether, so any space or line feed
    separates pieces; the byte-level one gives a single space to the piece after it and keeps a single
    line feed alone. A batch's pieces are numbered by Arrow, so Python sees each distinct piece of a batch
    once, and the library each distinct one of at most `held` that are kept.
    """

    MARK = ("\u00a9", "\u00a7", "\u00ae", "\u00b0", "#", "@")

    def __init__(self, path: str, end: int | None, held: int = 800_000):
        from tokenizers import Tokenizer

        self.lib, self.end, self.held = Tokenizer.from_file(path), end, held
        self.drops_space = self.plain("a b").tolist() == [*self.plain("a"), *self.plain("b")]
        self.whole = rf"<\||[{OTHER_SPACE}]" if self.drops_space else rf"<\||[ \n{OTHER_SPACE}][ \n{OTHER_SPACE}]"
        self.gap = " " if self.drops_space else ""
        self.mark = next(((m, int(e[0])) for m in self.MARK if len(e := self.plain(f" {m}")) == 1), None)
        self.ends: dict[str, bool] = {}
        self.forget()

    def ends_word(self, letter: str) -> bool:
        """Whether the tokenizer cuts between this letter and a mark after it. Normalising may make a letter end in a
        combining mark, which some pre-tokenizers join with what follows; the library itself is asked."""
        if letter not in self.ends:
            text = f"a{letter},"
            if self.lib.normalizer is not None:
                text = self.lib.normalizer.normalize_str(text)
            self.ends[letter] = text[-1:] == "," and self.lib.pre_tokenizer.pre_tokenize_str(text)[-1][0] == ","
        return self.ends[letter]

    def forget(self) -> None:
        """Keep the pieces that came up in several batches since the last time, at most three fifths of `held`.

        known: piece to its row of starts, lengths and hits; the first two tell where its ids are in ids.
        """
        old, least = getattr(self, "known", {}), 2
        while old and (self.hits >= least).sum() > 0.6 * self.held:
            least *= 2
        names = [k for k, r in old.items() if r and self.hits[r] >= least]
        rows = np.array([0, *(old[k] for k in names)], np.int64)
        ids, lengths = (self.gathered(rows), self.lengths[rows]) if old else (np.zeros(0, np.uint32), np.zeros(1, np.int32))
        self.known: dict[str, int] = {k: n for n, k in enumerate(["", *names])}
        self.rows, self.used, self.ids, self.lengths = len(names) + 1, len(ids), ids, lengths
        self.starts = (np.cumsum(lengths) - lengths).astype(np.int32)
        self.hits = np.zeros(len(lengths), np.int32)

    def plain(self, text: str) -> np.ndarray:
        return np.array(self.lib.encode(text, add_special_tokens=False).ids, np.uint32)

    def marked(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids and counts of pieces that begin with a space (or need none), encoded many at a time with a mark between them."""
        mark, number = self.mark
        lines = [f"{self.gap} {mark}{self.gap}".join(pieces[k : k + 200]) + f"{self.gap} {mark}" for k in range(0, len(pieces), 200)]
        flat = np.fromiter(chain.from_iterable(e.ids for e in self.lib.encode_batch_fast(lines, add_special_tokens=False)), np.uint32)
        at = np.flatnonzero(flat == number)
        if len(at) != len(pieces):
            return None
        return np.delete(flat, at), np.diff(at, prepend=-1) - 1

    def learn(self, pieces: list[str]) -> None:
        plain = [p for p in pieces if not self.mark or self.mark[0] in p or not (self.drops_space or p[0] == " " and len(p) > 1)]
        alone = set(plain)
        many = [p for p in pieces if p not in alone]
        got = self.marked(many) if many else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
        if got is None:
            plain, many, got = pieces, [], (np.zeros(0, np.uint32), np.zeros(0, np.int64))
        more = [self.plain(p) for p in plain]
        self.keep(np.concatenate([got[0], *more]), np.concatenate([got[1], np.array([len(x) for x in more], np.int64)]))
        for p in chain(many, plain):
            self.known[p] = self.rows
            self.rows += 1

    def gathered(self, rows: np.ndarray) -> np.ndarray:
        """The ids of pieces, one after another."""
        counts = np.take(self.lengths, rows)
        ends = np.cumsum(counts, dtype=np.int32)
        at = np.repeat(np.take(self.starts, rows) - (ends - counts), counts)
        at += np.arange(len(at), dtype=np.int32)
        return np.take(self.ids, at)

    def keep(self, flat: np.ndarray, counts: np.ndarray) -> None:
        if self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.zeros(self.used + 2 * len(flat), np.uint32)])
        self.ids[self.used : self.used + len(flat)] = flat
        self.starts = np.concatenate([self.starts, (self.used + np.cumsum(counts) - counts).astype(np.int32)])
        self.lengths = np.concatenate([self.lengths, counts.astype(np.int32)])
        self.hits = np.concatenate([self.hits, np.zeros(len(counts), np.int32)])
        self.used += len(flat)

    def rows_of(self, codes: np.ndarray, names: list[str]) -> np.ndarray:
        """The row of every code, codes being numbers into names; pieces that are new are learnt."""
        there = np.flatnonzero(np.bincount(codes, minlength=len(names)))
        keys = [names[k] for k in there]
        if new := list(filterfalse(self.known.__contains__, keys)):
            self.learn(new)
        of = np.zeros(len(names), np.int32)
        of[there] = rows = np.fromiter(map(self.known.__getitem__, keys), np.int32, len(keys))
        self.hits[rows] += 1
        return np.take(of, codes)

    def places(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The row of every piece, and where each text's pieces begin.

        A piece counts as two: a word and the marks that end it, which are always encoded apart; either may be
        empty. The tokenizer that drops white space lowers letters, so ASCII words are lowered here.
        """
        cut = pc.split_pattern(pc.replace_substring(texts, "\n", " " if self.drops_space else " \n "), " ")
        begin = cut.offsets.to_numpy().astype(np.int64)
        pieces = cut.values.slice(begin[0], begin[-1] - begin[0]).dictionary_encode()
        begin -= begin[0]
        code, names = pieces.indices.to_numpy(), pieces.dictionary
        bare = pc.utf8_rtrim(names, ",.;:!?*%$#&")
        marked = pc.and_(pc.not_equal(pc.binary_length(bare), pc.binary_length(names)), pc.match_substring_regex(bare, r"[\p{L}\p{N}]$"))
        last = pc.utf8_slice_codeunits(pc.if_else(marked, bare, ""), -1).dictionary_encode()
        parts = np.array([x != "" and self.ends_word(x) for x in last.dictionary.to_pylist()], bool)
        marked = pa.array(np.take(parts, last.indices.to_numpy()) if len(parts) else np.zeros(0, bool))
        bare = pc.if_else(marked, bare, names)
        ends = pc.if_else(marked, pc.replace_substring_regex(names, r"(?s)^.*[\p{L}\p{N}]", ""), "").dictionary_encode()
        if self.drops_space:
            bare = pc.if_else(pc.string_is_ascii(bare), pc.ascii_lower(bare), bare)
        words = bare.dictionary_encode()
        word, of = np.take(words.indices.to_numpy(), code), words.dictionary.to_pylist()
        if not self.drops_space:
            spaced = np.ones(len(word), bool)
            spaced[begin[:-1][begin[:-1] < len(word)]] = False
            feed = word == of.index("\n") if "\n" in of else np.zeros(len(word), bool)
            spaced[1:] &= ~feed[:-1]
            word = word * 2 + (spaced & ~feed)
            of = [x for w in of for x in (w, " " + w)]
        rows = np.empty(2 * len(code), np.int32)
        rows[0::2] = self.rows_of(word, of)
        rows[1::2] = self.rows_of(np.take(ends.indices.to_numpy(), code), ends.dictionary.to_pylist())
        return rows, 2 * begin

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        if not len(texts):
            return []
        if len(self.known) > self.held:
            self.forget()
        whole = np.flatnonzero(pc.match_substring_regex(texts, self.whole).to_numpy(zero_copy_only=False))
        piece, begin = self.places(pc.if_else(pc.match_substring_regex(texts, self.whole), "", texts) if len(whole) else texts)
        counts = self.lengths[piece]
        ends = np.cumsum(counts)
        flat = self.gathered(piece)
        at = np.concatenate([[0], ends])[begin]
        if self.end is not None:
            flat = np.insert(flat, at[1:], self.end)
            at = at + np.arange(len(at))
        out = [flat[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
        for k in whole.tolist():
            out[k] = np.append(self.plain(texts[k].as_py()), np.array([] if self.end is None else [self.end], np.uint32)).astype(np.uint32)
        return out


FILE_OPTIONS = {
    "compression": "zstd",
    "parquet.writer.version": "v2",  # ids that overflow a dictionary page are delta encoded
    "parquet.enable.dictionary": "true",
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(1 << 20),
    "parquet.page.row.count.limit": "2000",  # a page index entry for every 2,000 values of doc_id at most
}
FILE_SCHEMA = "doc_id long, part int, part_start long, n_tokens long, ids array<int>"


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end: int | None = 1, files: int | None = None) -> None:
    """Write the ids of every document to Parquet files under `path`, in ascending doc_id order.

    One file for each range of doc_id (`files`, by default spark.sql.shuffle.partitions). Columns: doc_id,
    part (the file's place), part_start (ids before the document in its file), n_tokens, ids (a list column,
    dictionary or delta encoded). Row groups are 32 MB, and pages carry indexes, so a filter on doc_id reads
    few pages and metadata are read without ids. A null text is empty; a null doc_id comes first; rows that
    share a doc_id are ordered by text; other columns are left out; an empty table gives files without rows.
    """
    spark = docs.sparkSession
    n = files or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, start = kept("encoder", Encoder, tokenizer, end), TaskContext.get().partitionId(), 0
        for b in slices(batches, 6 << 20):
            ids = [x.view(np.int32) for x in coder.encode(b.column("text"))]
            counts = np.array([len(x) for x in ids], np.int64)
            before = start + np.cumsum(counts) - counts
            start += int(counts.sum())
            yield pa.record_batch([b.column("doc_id").cast(pa.int64()), pa.array(np.full(len(ids), part, np.int32)), pa.array(before), pa.array(counts), list_array(ids, pa.int32())], ["doc_id", "part", "part_start", "n_tokens", "ids"])

    # Texts, not ids, are dealt out: sampling for the ranges would otherwise run the tokenizer twice.
    ordered = texts(docs).repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(run, FILE_SCHEMA).write.options(**FILE_OPTIONS).parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """The files' rows; select or filter to read only some columns, row groups and pages."""
    return spark.read.schema(FILE_SCHEMA).parquet(path)


def file_starts(rows: DataFrame) -> dict[int, int]:
    """Ids before each file. One number for each file, which the driver lists anyway."""
    from pyspark.sql import functions as F

    sums = sorted((r.part, r.n) for r in rows.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    before = np.cumsum([0, *(n for _, n in sums)])
    return {part: int(b) for (part, _), b in zip(sums, before, strict=False)}


def token_digests(rows: DataFrame) -> DataFrame:
    """Per document of token files: start (ids of all documents before it), n_tokens and ids_crc32."""
    starts = file_starts(rows.select("part", "n_tokens"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("ids")
            at, flat = ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False)
            crc = [zlib.crc32(flat[x:y].tobytes()) for x, y in zip(at[:-1], at[1:], strict=True)]
            first = np.array([starts[p] for p in b.column("part").to_pylist()], np.int64)
            yield pa.record_batch([b.column("doc_id"), pa.array(first + b.column("part_start").to_numpy()), pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.select("doc_id", "part", "part_start", "ids").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_ids_written(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write token files to the shared folder, read them back and digest what was read."""
    path = scratch(docs.sparkSession, "tokens")
    write_token_files(docs, path, tokenizer)
    return token_digests(read_token_files(docs.sparkSession, path))
