"""Toxicity classifier: boosted trees over dense lexical features, calibrated (operator 5)."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import kept, list_array, slices, text_hash, texts, without
from millrace.llm.labelled import in_fold, sample
from millrace.llm.trees import Boosted, Isotonic

# Second-person words, and insults that count whatever the labels hold.
SECOND = frozenset("you your yours yourself u ur du dich dir dein deine deiner euch euer ihr tu te toi ton ta tes vous votre vos tú ti usted ustedes vosotros".split())
INSULTS = frozenset("asshole bastard bitch clown crap cretin cunt disgusting dumb dumbass fuck fucking idiot idiotic imbecile jerk loser moron moronic pathetic pig retard scum shit slut stupid trash ugly vermin whore worthless arschloch depp dreckig hurensohn trottel wichser connard salope débile cabrón gilipollas imbécil puta pendejo".split())
LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "i", "€": "e"})
EDGES = "\"'.,;:!?()[]{}<>«»“”„…-_*#%&$/\\|~`^+="
STEMS = range(4, 7)

FEATURES = ("length", "hits", "hit_density", "hidden", "hidden_density", "near_second", "near_second_density", "second_density", "capitals", "shouting", "marks", "mixed", "stretched", "spelled")
WORD, HIDDEN, YOU, CAPS, SHOUT, MIXED, LONG, LETTER, MARKED = (1 << k for k in range(9))


def core(token: str) -> str:
    return token.strip(EDGES).lower()


def chars_plain(word: str) -> Iterator[str]:
    """What an obfuscated word may stand for: look-alikes put back, separators taken out, stretched letters shortened."""
    for x in (word.translate(LEET), re.sub(r"[\W_]+", "", word.translate(LEET)), re.sub(r"[\W_]+", "", word)):
        yield x
        yield re.sub(r"(.)\1{2,}", r"\1", x)
        yield re.sub(r"(.)\1+", r"\1", x)


class Lexicon:
    """Words, and stems that a word may begin with."""

    def __init__(self, words: Iterable[str] = (), stems: Iterable[str] = ()):
        self.words, self.stems = INSULTS | set(words), frozenset(stems)
        self.by_length: dict[int, list[str]] = defaultdict(list)
        for w in sorted(self.words):
            self.by_length[len(w)].append(w)

    def has(self, word: str) -> bool:
        return word in self.words or any(word[:k] in self.stems for k in STEMS if len(word) >= k)

    def starred(self, word: str) -> bool:
        """Letters covered by marks: st*p*d."""
        return "*" in word[1:] and sum(c != "*" for c in word) >= 2 and any(all(a in ("*", b) for a, b in zip(word, w, strict=True)) for w in self.by_length[len(word)])

    def hides(self, token: str, word: str) -> bool:
        whole = token.lower().strip("\"'.,;:?()[]{}<>«»“”„…")
        return len(word) >= 3 and not word.isalpha() and (any(self.has(x) for t in {whole, word} for x in chars_plain(t)) or self.starred(whole)) or bool(re.search(r"(.)\1\1", word)) and any(self.has(x) for x in chars_plain(word))


class Marks(dict):
    """Token to its bits; at most `most` tokens are kept."""

    def __init__(self, lexicon: Lexicon, most: int = 300_000):
        self.lexicon, self.most = lexicon, most

    def __missing__(self, token: str) -> int:
        if len(self) >= self.most:
            self.clear()
        word, k = core(token), 0
        if self.lexicon.has(word):
            k = WORD
        elif self.lexicon.hides(token, word):
            k = HIDDEN
        k |= YOU * (word in SECOND) | CAPS * (len(word) > 1 and token.isupper()) | SHOUT * (token[-1] in "!?") | LONG * bool(re.search(r"(.)\1\1", word))
        k |= MIXED * (any(c.isalpha() for c in word) and any(not c.isalpha() for c in word.strip("'’-"))) | LETTER * (len(word) == 1 and word.isalpha()) | MARKED * (len(token) > len(word))
        self[token] = k
        return k


def spelled(tokens: list[str], single: np.ndarray, lexicon: Lexicon) -> int:
    """Words of the lexicon that are spelled out letter by letter: i d i o t."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], single, [0]])))
    runs = ("".join(core(t) for t in tokens[a:b]) for a, b in zip(edge[::2], edge[1::2], strict=True) if b - a >= 4)
    return sum(any(lexicon.has(r[k:m]) for k in range(len(r)) for m in range(k + 4, min(k + 14, len(r)) + 1)) for r in runs)


def features(text: str, marks: Marks) -> list[float]:
    tokens = text.split()
    k = np.fromiter(map(marks.__getitem__, tokens), np.int64, len(tokens))
    n = max(len(tokens), 1)
    count = lambda bit: int(((k & bit) > 0).sum())
    at, you = np.flatnonzero(k & (WORD | HIDDEN)), np.flatnonzero(k & YOU)
    near = int((np.searchsorted(you, at - 5) < np.searchsorted(you, at + 5, "right")).sum())
    single = ((k & LETTER) > 0).astype(np.int8)
    out = spelled(tokens, single, marks.lexicon) if single.sum() >= 4 else 0
    hits, hidden = count(WORD), count(HIDDEN) + out
    return [np.log1p(n), np.log1p(hits), hits / n, np.log1p(hidden), hidden / n, np.log1p(near), near / n, len(you) / n, count(CAPS) / n, count(SHOUT) / n, count(MARKED) / n, count(MIXED) / n, count(LONG) / n, np.log1p(out)]


def mine(rows: list[tuple[set[str], int]], share: float = 0.01, ratio: float = 25.0) -> tuple[list[str], list[str]]:
    """Words and stems that set toxic documents apart, from (words of a document, label).

    Toxic documents that are copies of one another (by the share of equal minima of hashed words) count once, so
    that the rare words of a copied document don't pass for a lexicon. An entry must occur in at least 3 and in
    `share` of the groups, in so many that hardly any of all words would be found in toxic documents alone by
    chance, and `ratio` times as often as in documents that aren't toxic. A stem must gather several words.
    """
    toxic = [w for w, y in rows if y and w]
    clean = [w for w, y in rows if not y]
    salts = np.random.default_rng(7).integers(1, 1 << 32, 48, dtype=np.uint64) | np.uint64(1)
    minima = []
    for w in toxic:
        h = np.array([zlib.crc32(x.encode("utf-8", "surrogatepass")) for x in sorted(w)], np.uint64)
        minima.append(((h[:, None] * salts) & np.uint64(0xFFFFFFFF)).min(0))
    group = list(range(len(toxic)))
    for k, m in enumerate(minima):
        if k and len(near := np.flatnonzero((np.stack(minima[:k]) == m).mean(1) >= 0.5)):
            group[k] = group[near[0]]
    found: dict[str, set[int]] = defaultdict(set)
    for g, w in zip(group, toxic, strict=True):
        for x in parts(w):
            found[x].add(g)
    groups = len(set(group))
    chance = groups / max(groups + len(clean), 1)  # that a word of one document is a toxic one's
    least = max(3, share * groups, math.log(0.1 / max(len(found), 1)) / math.log(min(max(chance, 1e-9), 0.5)))
    held = {x: len(g) for x, g in found.items() if len(g) >= least}
    other = Counter(x for w in clean for x in parts(w) if x in held)
    good = {x for x, n in held.items() if n / max(groups, 1) >= ratio * (other[x] + 0.5) / (len(clean) + 1)}
    words = sorted(x[1:] for x in good if x[0] == "=")
    longer: dict[str, int] = defaultdict(int)  # of a stem, the most groups that one longer entry has
    for x in good:
        bare = x.removeprefix("=")
        for k in STEMS:
            if k < len(bare):
                longer[bare[:k]] = max(longer[bare[:k]], held[x])
    stems = {x for x in good if x[0] != "=" and longer[x] < 0.95 * held[x]}  # else the longer entry says it all
    return words, sorted(x for x in stems if not any(x[:k] in stems for k in STEMS if k < len(x)))


def parts(words: Iterable[str]) -> set[str]:
    """"=" and the word, and the word's stems."""
    return {f"={w}" for w in words} | {w[:k] for w in words for k in STEMS if len(w) > k}


class Model:
    def __init__(self, lexicon: Lexicon, trees: Boosted, isotonic: Isotonic):
        self.lexicon, self.trees, self.isotonic = lexicon, trees, isotonic


def train(docs: DataFrame, labels: DataFrame, column: str = "toxic", folds: int = 5, fold: int = 0, most: int = 6000) -> Model:
    """Lexicon, trees and calibration from at most `most` labelled documents outside the fold.

    One task reads the words of those documents and mines the lexicon; features are computed where the documents
    are, and the driver fits on `most` rows of 14 numbers: trees on three quarters, calibration on the rest.
    """
    rows = sample(docs, labels, column, folds, fold, most)

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            words = [sorted({w for t in set(x.split()) if (w := core(t)).isalpha() and len(w) > 2}) for x in b.column("text").to_pylist()]
            yield pa.record_batch([b.column("place"), b.column("label"), pa.array(words, pa.list_(pa.string()))], ["place", "label", "words"])

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, stems = mine([(set(w), y) for b in batches for w, y in zip(b.column("words").to_pylist(), b.column("label").to_pylist(), strict=True)])
        yield pa.record_batch([pa.array([words], pa.list_(pa.string())), pa.array([stems], pa.list_(pa.string()))], ["words", "stems"])

    mined = rows.mapInArrow(distinct, "place long, label int, words array<string>").repartition(1).sortWithinPartitions("place", "label", "words").mapInArrow(one, "words array<string>, stems array<string>").first()
    lexicon = Lexicon(mined.words, mined.stems) if mined else Lexicon()
    table = sorted((r.place, r.label, tuple(r.x)) for r in with_features(rows, lexicon, "place", "label").collect())
    x, y = np.array([r[2] for r in table]).reshape(-1, len(FEATURES)), np.array([r[1] for r in table], np.float64)
    aside = np.array([zlib.crc32(b"%d" % r[0]) % 4 == 0 for r in table], bool)
    trees = Boosted().fit(x[~aside], y[~aside])
    return Model(lexicon, trees, Isotonic(trees.raw(x[aside]), y[aside]))


def with_features(rows: DataFrame, lexicon: Lexicon, *keep: str) -> DataFrame:
    words, stems = tuple(sorted(lexicon.words)), tuple(sorted(lexicon.stems))
    kinds = {"place": "long", "label": "int", "doc_id": "long"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = kept("marks", lambda w, s: Marks(Lexicon(w, s)), words, stems)
        for b in slices(batches):
            x = [np.array(features(t, marks)) for t in b.column("text").to_pylist()]
            yield pa.record_batch([*(b.column(c) for c in keep), list_array(x, pa.float64())], [*keep, "x"])

    return rows.select(*keep, "text").mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in keep) + ", x array<double>")


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, text_hash and score (0 to 1) of every row."""
    words, stems = tuple(sorted(model.lexicon.words)), tuple(sorted(model.lexicon.stems))
    trees, isotonic = model.trees, model.isotonic

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = kept("marks", lambda w, s: Marks(Lexicon(w, s)), words, stems)
        for b in slices(batches):
            x = np.array([features(t, marks) for t in b.column("text").to_pylist()]).reshape(-1, len(FEATURES))
            yield pa.record_batch([b.column("doc_id").cast(pa.int64()), b.column("text_hash"), pa.array(isotonic(trees.raw(x)))], ["doc_id", "text_hash", "score"])

    return texts(docs).select("doc_id", text_hash().alias("text_hash"), "text").mapInArrow(run, "doc_id long, text_hash long, score double")


def judged(docs: DataFrame, labels: DataFrame, column: str = "toxic", folds: int = 5, fold: int = 0, least: float = 0.5, most: int = 6000) -> DataFrame:
    """doc_id, held_out, score and predicted (1 from `least` on) of every document.

    A null text is scored as the empty one; rows with a null or repeated doc_id are scored like any others; an
    empty table gives no rows; without labels every score is 0.05.
    Other columns are never read.
    """
    out = score(docs, train(docs, labels, column, folds, fold, most))
    return out.select("doc_id", in_fold(F.col("doc_id"), folds, fold).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the documents scored 0.5 or more, all columns kept. Every row is judged by its own text, whatever its doc_id."""
    return without(docs, score(docs, train(docs, labels)).where("score >= 0.5"))
