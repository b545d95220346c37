import io
import random

import pytest
from pyspark.sql import functions as F

from millrace.functions.rolling import Sizes
from millrace.operators import chunking, ranged

SMALL = Sizes(48, 96, 192, digest="sha256")


@pytest.mark.parametrize("length", [192, 500, 4096, 1 << 20])
def test_ranges_cut_as_one_stream(spark, tmp_path, length):
    r = random.Random(length)
    texts = {"random": r.randbytes(9000), "zeros": bytes(5000), "mixed": r.randbytes(700) + bytes(1500) + r.randbytes(1200), "empty": b"", "one": b"x", "edge": r.randbytes(length), "a b%20ü": r.randbytes(1000)}
    for name, data in texts.items():
        (tmp_path / name).write_bytes(data)
    got = ranged.chunk_files(spark, str(tmp_path), SMALL, payload=True, length=length)
    got = sorted((x.path.rpartition("/")[2], x.pos, x.start, x.size, x.id, bytes(x.payload)) for x in got.collect())
    blobs = spark.createDataFrame([(k, bytearray(v)) for k, v in texts.items()], "path string, data binary")
    want = sorted((x.path, x.pos, x.start, x.size, x.id, bytes(x.payload)) for x in chunking.chunk_index(blobs, SMALL, payload=True).collect())
    assert got == want
    assert b"".join(x[5] for x in got if x[0] == "mixed") == texts["mixed"]


def test_bad_ranges_raise(spark, tmp_path):
    (tmp_path / "f").write_bytes(random.Random(1).randbytes(2000))
    with pytest.raises(ValueError, match="largest chunk"):
        ranged.chunk_files(spark, str(tmp_path), SMALL, length=191)
    found = ranged.range_places(ranged.file_ranges(spark, str(tmp_path), 192), SMALL, 192, ranged.open_path)
    with pytest.raises(Exception, match="missing or there twice"):
        ranged.range_cuts(found.where("part <> 3"), SMALL, 192).collect()
    with pytest.raises(Exception, match="missing or there twice"):
        ranged.range_cuts(found.union(found), SMALL, 192).collect()


def test_files_are_opened_as_told(spark, tmp_path):
    data = random.Random(2).randbytes(3000)
    (tmp_path / "f").write_bytes(bytes(3000))  # same length, other bytes: only the given opener is read
    got = ranged.chunk_files(spark, str(tmp_path), SMALL, length=512, opened=lambda path: io.BytesIO(data))
    blob = spark.createDataFrame([(bytearray(data),)], "data binary")
    want = chunking.chunk_index(blob, SMALL).orderBy("pos").select("start", "id").collect()
    assert got.orderBy("pos").select("start", "id").collect() == want


def test_nothing_there(spark, tmp_path):
    (tmp_path / "empty").write_bytes(b"")
    assert ranged.chunk_files(spark, str(tmp_path), SMALL).agg(F.count("*")).first()[0] == 0
