import random

import pytest
from pyspark.sql import functions as F

from millrace.engine import Engine, Store, mtree
from millrace.functions.rolling import Sizes
from millrace.sources import formats as fm
from millrace.sources.readers import node_row

SMALL = Sizes(64, 256, 1024, digest="sha256")


def test_commands(spark, tmp_path):
    r = random.Random(1)
    shared = r.randbytes(4000)
    files = {"a": r.randbytes(3000) + shared, "b": shared + r.randbytes(500), "zero": bytes(5000), "none": b""}
    for n, d in files.items():
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / n).write_bytes(d)
    store = Store(spark, str(tmp_path / "store"), key=bytes(32))
    e = Engine(spark, str(tmp_path / "index"), store, sizes=SMALL)
    blobs = e.blobs(str(tmp_path / "in"))
    e.make(blobs)
    e.stores[0].add(blobs.select(F.sha2("data", 256).alias("id"), F.col("data").alias("payload")).where("false"))
    assert {x.name: bytes(x.data) for x in e.extract().collect()} == {n: d for n, d in files.items() if d}
    assert store.rows().count() == store.rows().select("id").distinct().count() == e.index().select("id").distinct().count()
    assert e.cat("a", 2990, 30) == files["a"][2990:3020] and e.cat("b", 4000) == files["b"][4000:] and e.cat("b", 4500) == b""
    with pytest.raises(EOFError):
        e.cat("a", 9999)
    i = e.info("a", seed="b").first()
    assert i.size == 7000 and i.in_store == i.unique and i.in_seed > 0 and i.total == len(e.list_chunks("a"))
    assert e.inspect_chunks("zero").where("compressed_size < uncompressed_size").count() > 0
    assert e.verify_index(blobs, "a") and not e.verify_index(blobs.withColumn("data", F.concat("data", F.lit(b"x"))), "a")

    cache = Store(spark, str(tmp_path / "cache"), compress=False)
    e.copy_to(cache, "b", ignore=e.index("a"))
    assert {x.id for x in cache.rows().collect()} == set(e.list_chunks("b")) - set(e.list_chunks("a"))
    through = Engine(spark, str(tmp_path / "index"), store, sizes=SMALL, cache=cache)
    assert bytes(through.extract("b").first().data) == files["b"]
    through.extract("a").collect()
    assert {x.id for x in cache.rows().collect()} == set(e.list_chunks("b")) | set(e.list_chunks("a"))

    assert store.verify().isEmpty()
    gone = {x.id for x in e.prune("a", "zero").collect()}
    assert gone == set(e.list_chunks("b")) - set(e.list_chunks("a")) - set(e.list_chunks("zero"))
    assert bytes(e.extract("a").first().data) == files["a"]
    with pytest.raises(Exception, match="missing"):
        e.extract("b").collect()
    e.chop(blobs, "b", ignore=e.index("a"))
    assert bytes(e.extract("b").first().data) == files["b"]
    with pytest.raises(Exception, match="doesn't match"):
        e.chop(blobs.withColumn("data", F.reverse("data")), "b")

    broken = Store(spark, str(tmp_path / "broken"), compress=False)
    broken.add(spark.createDataFrame([("0" * 64, b"not this"), (e.list_chunks("a")[0], files["a"][: e.index("a").where("pos = 0").first().size])], "id string, payload binary"))
    assert [x.id for x in broken.verify(repair=True).collect()] == ["0" * 64] and broken.verify().isEmpty() and broken.rows().count() == 1


def test_a_second_make_replaces_an_index(spark, tmp_path):
    r = random.Random(5)
    e = Engine(spark, str(tmp_path / "i"), Store(spark, str(tmp_path / "s")), sizes=SMALL)
    row = lambda *x: spark.createDataFrame([(n, bytearray(d)) for n, d in x], "name string, data binary")
    old, new, other = r.randbytes(260), r.randbytes(900), r.randbytes(700)
    e.make(row(("x", old), ("y", other)))
    e.make(row(("x", new)))
    assert {x.name: bytes(x.data) for x in e.extract().collect()} == {"x": new, "y": other}
    e.make(row(("x", b"")))
    assert e.index("x").isEmpty() and [x.name for x in e.extract().collect()] == ["y"]
    with pytest.raises(Exception, match="not an index name"):
        e.make(row(("../x", old)))


def test_files_of_any_size_are_made_by_ranges(spark, tmp_path):
    r = random.Random(9)
    files = {"big": r.randbytes(20000), "none": b"", "zero": bytes(3000)}
    (tmp_path / "in" / "more").mkdir(parents=True)
    for n, d in files.items():
        (tmp_path / "in" / n).write_bytes(d)
    e = Engine(spark, str(tmp_path / "index"), Store(spark, str(tmp_path / "store")), sizes=SMALL)
    e.make(str(tmp_path / "in"))
    by_ranges = sorted(map(tuple, e.index().select("name", "pos", "id", "start", "size").collect()))
    e.make(e.blobs(str(tmp_path / "in")))
    assert by_ranges == sorted(map(tuple, e.index().select("name", "pos", "id", "start", "size").collect()))
    assert {x.name: bytes(x.data) for x in e.extract().collect()} == {n: d for n, d in files.items() if d}
    (tmp_path / "in" / "more" / "big").write_bytes(b"another of this name")
    with pytest.raises(ValueError, match="one name"):
        e.make(str(tmp_path / "in"))


@pytest.mark.parametrize("kind", ["sha256", "sha512_256"])
def test_extract_takes_what_local_blobs_hold(spark, tmp_path, kind):
    r = random.Random(6)
    shared = r.randbytes(9000)
    files = {"old": shared + r.randbytes(800), "bad": shared + r.randbytes(50), "new": r.randbytes(300) + shared + bytes(4096) + r.randbytes(400)}
    store = Store(spark, str(tmp_path / "s"), digest=kind)
    e = Engine(spark, str(tmp_path / "i"), store, sizes=Sizes(64, 256, 1024, digest=kind))
    blobs = spark.createDataFrame([(n, bytearray(d)) for n, d in files.items()], "name string, data binary")
    e.make(blobs)
    assert store.verify().isEmpty() and e.verify_index(blobs, "new")
    broken = F.when(F.col("name") == "bad", F.reverse("data")).otherwise(F.col("data"))
    local = blobs.where("name <> 'new'").withColumn("data", broken)
    plan = e.planned("new", local=local).where("seed is not null").collect()
    assert plan and {p.seed for p in plan} == {"old"}  # a seed that isn't what its index says is left out
    with pytest.raises(ValueError, match="doesn't match"):
        e.planned("new", local=local, on_invalid="bail")
    # Only what is in no seed and not null is left in the store.
    need = {x.id for x in e.index("new").collect()} - {x.id for x in e.index("old").collect()}
    only = Store(spark, str(tmp_path / "only"), digest=kind)
    only.add(store.plain().where(F.col("id").isin(list(need))))
    few = Engine(spark, str(tmp_path / "i"), only, sizes=e.sizes)
    assert bytes(few.extract("new", local=local).first().data) == files["new"]
    with pytest.raises(Exception, match="missing"):
        few.extract("new").collect()


def test_archives(spark, tmp_path):
    tree = [fm.Node(".", "dir", 0o40755), fm.Node("d", "dir", 0o40755), fm.Node("d/f", "file", 0o100644, 1, 2, 3, {"user.k": b"v"}, b"body" * 300), fm.Node("dev", "device", 0o20600, major=1, minor=3)]
    nodes = spark.createDataFrame([node_row("t", n) for n in tree], "name string, path string, kind string, mode long, uid long, gid long, mtime_ns long, xattrs map<string,binary>, size long, data binary, target string, major long, minor long")
    e = Engine(spark, str(tmp_path / "i"), Store(spark, str(tmp_path / "s")), sizes=SMALL)
    e.tar(nodes)
    back = e.untar("t")
    assert sorted(map(str, (tuple(x)[1:] for x in back.collect()))) == sorted(str(node_row("", n)[1:]) for n in tree)
    lines = {x.path: x.line for x in mtree(back).collect()}
    assert lines["dev"].startswith("dev type=char mode=0600") and "size=1200" in lines["d/f"] and lines["."].startswith(". type=dir")
