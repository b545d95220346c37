import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.functions import rolling as R
from millrace.operators import chunking

SMALL = R.Sizes(48, 96, 192, digest="sha256")


def model(data, s):
    """Byte by byte: roll the hash, test each byte past the smallest size."""
    t, d, ends, start = s.table, s.divisor, [], 0
    rot = lambda x, k: (x << k % 32 | x >> (32 - k % 32)) & R.MASK
    while start < len(data):
        rest = data[start:]
        end = len(rest) if len(rest) <= s.least else min(len(rest), s.most)
        if len(rest) > s.least:
            h = 0
            for k, b in enumerate(rest[s.least - 48 : s.least]):
                h ^= rot(t[b], 47 - k)
            for k in range(s.least, end):
                h = rot(h, 1) ^ rot(t[rest[k - 48]], 48) ^ t[rest[k]]
                if h % d == d - 1:
                    end = k + 1
                    break
        start += end
        ends.append(start)
    return ends


def test_discriminators():
    assert {a: R.discriminator(a) for a in (64, 128, 256, 512, 1024, 4096, 8192, 65536)} == {64: 48, 128: 96, 256: 192, 512: 384, 1024: 768, 4096: 3075, 8192: 6153, 65536: 49535}


@pytest.mark.parametrize("bad", [(47, 96, 192), (96, 64, 192), (64, 256, 128)])
def test_wrong_sizes(bad):
    with pytest.raises(ValueError):
        R.Sizes(*bad)


def test_parse():
    s = R.Sizes.parse("16:64:256")
    assert (s.least, s.average, s.most) == (16384, 65536, 262144)
    for text in ("16:64", "a:b:c", "1:2:3:4"):
        with pytest.raises(ValueError):
            R.Sizes.parse(text)


def test_table_parameter(tmp_path):
    (tmp_path / "t").write_text(", ".join(hex(x) for x in range(256)))
    assert R.read_table(str(tmp_path / "t")) == tuple(range(256))
    (tmp_path / "t").write_text("1 2 3")
    with pytest.raises(ValueError):
        R.read_table(str(tmp_path / "t"))


@settings(max_examples=60, deadline=None)
@given(st.one_of(st.binary(max_size=900), st.integers(0, 900).map(bytes), st.tuples(st.integers(0, 99), st.sampled_from([0, 1, 47, 48, 49, 95, 96, 97, 191, 192, 193, 2000])).map(lambda x: random.Random(x[0]).randbytes(x[1]))))
def test_equals_the_byte_by_byte_model(data):
    assert R.cut(len(data), chunking.places(data, SMALL), SMALL) == model(data, SMALL)


def test_many_blobs_at_once_and_large_blobs_in_parts(monkeypatch):
    blobs = [random.Random(k).randbytes(n) for k, n in enumerate([0, 1, 47, 500, 3000, 48, 0])]
    got = [R.cut(len(b), p, SMALL) for b, p in zip(blobs, chunking.batched_places(blobs, SMALL), strict=True)]
    assert got == [model(b, SMALL) for b in blobs]
    monkeypatch.setattr(chunking, "PART", 100)
    assert [R.cut(len(b), p, SMALL) for b, p in zip(blobs, chunking.batched_places(blobs, SMALL), strict=True)] == got


def test_shared_middle_is_found_again():
    r = random.Random(1)
    middle = r.randbytes(6000)
    ids = [{hashlib.sha256(b[x:y]).hexdigest() for x, y in zip([0, *e], e, strict=False)} for b in (r.randbytes(777) + middle, middle + r.randbytes(50)) for e in [model(b, SMALL)]]
    assert len(ids[0] & ids[1]) > 20


def test_table_function(spark):
    rows = [(1, random.Random(3).randbytes(2000)), (2, b""), (3, None), (4, "grüße".encode() * 60)]
    df = chunking.blobs(spark.createDataFrame(rows, "k long, d binary"), __import__("pyspark").sql.functions.col("d"), "k")
    got = chunking.chunk_index(df, SMALL, payload=True).collect()
    for k, data in rows:
        own = sorted((r for r in got if r.k == k), key=lambda r: r.pos)
        assert b"".join(bytes(r.payload) for r in own) == (data or b"")
        assert [r.start + r.size for r in own] == model(data or b"", SMALL) and [r.id for r in own] == [hashlib.sha256(r.payload).hexdigest() for r in own]
    assert chunking.null_id(R.Sizes(2048, 8192, 32768)) == hashlib.new("sha512_256", bytes(32768)).hexdigest()
    assert np.array(SMALL.table).shape == (256,)
