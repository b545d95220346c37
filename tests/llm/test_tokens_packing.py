import random
import unicodedata
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from millrace.llm.packing import Bins, pack, packing_digests
from millrace.llm.tokens import Encoder, read_token_files, token_ids_written, write_token_files

from .conftest import edge_rows

WORD, BYTE = (str(public_tokenizers.path(f"{x}.json")) for x in ("word_bpe_49k", "byte_bpe_50k"))
LIB = {p: Tokenizer.from_file(p) for p in (WORD, BYTE)}
ENCODER = {p: Encoder(p, 1, held=50) for p in (WORD, BYTE)}


def plain(path, text):
    return np.array([*LIB[path].encode(text or "", add_special_tokens=False).ids, 1], "<u4").tobytes()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "Bc", " ", " ", "\n", "'s", "©", " word", "12", "é", ",", "!?", ")", "É.", "́", "\t", "<|endoftext|>", "...", "\x1c", "漢字", " "]), max_size=12).map("".join), max_size=4))
def test_pieces_give_the_librarys_ids(texts):
    for p in (WORD, BYTE):
        assert [x.tobytes() for x in ENCODER[p].encode(pa.array(texts, pa.string()))] == [plain(p, t) for t in texts]


def test_token_files(spark, edge, empty):
    got = token_ids_written(edge, WORD).collect()
    rows = sorted(edge_rows(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want, start = [], 0
    for i, t in rows:
        ids = plain(WORD, t)
        want.append((i, start, len(ids) // 4, zlib.crc32(ids)))
        start += len(ids) // 4
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert token_ids_written(empty, WORD).count() == 0


def test_selected_documents_are_read_alone(spark, edge, tmp_path):
    write_token_files(edge, str(tmp_path / "t"), WORD, files=2)
    rows = read_token_files(spark, str(tmp_path / "t"))
    plan = rows.where("doc_id = 5").select("doc_id", "n_tokens")._jdf.queryExecution().toString()
    assert "EqualTo(doc_id,5)" in plan and "ids:array" not in plan.split("Physical Plan")[1]
    assert rows.where("doc_id = 5").first().n_tokens == len(plain(WORD, dict(edge_rows()[:60])[5])) // 4


def test_packing(spark, edge, empty):
    packed = pack(edge, BYTE)
    got = packing_digests(packed).collect()
    docs = defaultdict(list)
    for r in packed.collect():
        assert zlib.crc32(r.ids) in {g.ids_crc32 for g in got if g.sequence_id == r.sequence_id} and len(r.ids) == 4 * r.length
        docs[r.doc_id, r.doc_tokens].append((r.start, bytes(r.ids)))
    whole = defaultdict(list)
    for i, t in edge_rows():
        whole[i, len(plain(BYTE, t)) // 4].append(plain(BYTE, t))
    assert docs.keys() == whole.keys()
    for k, pieces in docs.items():
        byte_of = lambda p: p[0]
        starts = [s for s, _ in sorted(pieces, key=byte_of)]
        assert starts.count(0) == len(whole[k]) and sum(len(x) for _, x in pieces) == sum(map(len, whole[k]))
        if len(whole[k]) == 1:
            assert b"".join(x for _, x in sorted(pieces, key=byte_of)) == whole[k][0]
        else:
            assert all(any(w[4 * s : 4 * s + len(x)] == x for w in whole[k]) for s, x in pieces)
    bins = defaultdict(list)
    for g in got:
        bins[g.sequence_id].append((g.offset, g.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 2048 and at & (at - 1) == 0  # no padding at all
    assert sum(sum(n for _, n in b) < 2048 for b in bins.values()) <= 12 * edge.rdd.getNumPartitions()
    assert pack(empty, BYTE).count() == 0


def test_bins_are_harmonic():
    r = np.random.default_rng(5)
    lengths = [*r.integers(1, 300, 4000).tolist(), *r.integers(1, 9000, 300).tolist(), 1, 2048, 4096, 1, 1]
    r.shuffle(lengths)
    bins, rows = Bins(2048, 7), []
    for k, n in enumerate(lengths):
        rows += bins.place(k, np.arange(n, dtype=np.uint32))
        assert len(bins.open) < 2 * 2048**0.5 and all(len(v) < j and all(2048 // (j + 1) < len(p) <= 2048 // j for p in v) for j, v in bins.open.items())
    closed = bins.next
    assert all(sum(x[2] for x in rows if x[5] == s) == 2048 for s in range(7, closed))  # bins of a fixed count, filled up
    rows += bins.rest()
    got = defaultdict(list)
    for doc, start, n, ids, total, sequence, offset in rows:
        assert total == lengths[doc] and np.frombuffer(ids, "<u4").tolist() == list(range(start, start + n))
        got[doc].append((start, n))
    for k, n in enumerate(lengths):
        at = 0
        for start, size in sorted(got[k]):
            assert start == at
            at += size
        assert at == n
    whole = sum(n // 2048 for n in lengths)
    assert len(rows) < 1.4 * (len(lengths) + whole)  # few documents are cut


ODD = ["\u095c", "\u09dc", "\u0b5c", "\ufb2a", "\u0130", "\u1e9b\u0323", "\u0958", "\u0344", "\u2126", "\u01c5"]


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_letters_that_end_in_marks_when_normalised(path):
    """Every letter that NFC or lower-casing makes something else, before each mark, and random Unicode."""
    letters = [c for k in range(0x110000) if not 0xD800 <= k < 0xE000 and (c := chr(k)).isalpha() and not c.isascii() and unicodedata.normalize("NFC", c.lower()) != c]
    assert set("\u095c\u09dc\u0b5c\ufb2a\u0130") <= set(letters)
    texts = [f"a{c}{m} b{c}{m}" for n, c in enumerate(letters) for m in (",.;:!?*%$#&" if c in ODD or n % 40 == 0 else ",")]
    r = random.Random(3)
    points = [chr(k) for a, b in ((0x20, 0x24F), (0x370, 0x52F), (0x591, 0x6FF), (0x900, 0xDFF), (0x1100, 0x11FF), (0x1E00, 0x1FFF), (0x2000, 0x206F), (0xFB00, 0xFB4F), (0x1F300, 0x1F64F)) for k in range(a, b)]
    texts += ["".join(r.choice(points if r.random() < 0.6 else ", .!ab") for _ in range(r.randrange(14))) for _ in range(20_000)]
    coder = Encoder(path, 1)
    got = [x.tobytes() for k in range(0, len(texts), 5000) for x in coder.encode(pa.array(texts[k : k + 5000], pa.string()))]
    assert [t for t, g in zip(texts, got, strict=True) if g != plain(path, t)] == []
