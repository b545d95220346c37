import hashlib
import os

import pytest
from pyspark.sql import functions as F

from millrace.functions import codecs, paths
from millrace.functions.rolling import Sizes
from millrace.functions.siphash import siphash
from millrace.operators import archive, index, info, ranges, seeds, stores
from millrace.sources import formats as fm
from millrace.sources.readers import ArchiveFiles, IndexFiles, TarFiles, node_row, tar_nodes, to_tar, write_index


def sha(x):
    return hashlib.sha256(x).hexdigest()


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


def test_siphash_of_the_paper():
    assert siphash(0x0706050403020100, 0x0F0E0D0C0B0A0908, bytes(range(15))) == 0xA129CA6149BE45E5


def test_lookup_table_is_a_complete_tree():
    assert fm.heap_order(list(range(16))) == [8, 4, 12, 2, 6, 10, 14, 1, 3, 5, 7, 9, 11, 13, 15, 0]
    assert [fm.heap_order(list(range(n))) for n in range(5)] == [[], [0], [1, 0], [1, 0, 2], [2, 1, 3, 0]]


@pytest.mark.parametrize("name, want", [("abc", "abc"), ("name with space", r"name\040with\040space"), ("a\\b", r"a\134b"), ("a#b", r"a\043b"), ("a\tb", r"a\011b"), ("a\nb", r"a\012b"), ("a\x7fb", r"a\177b"), ("é", r"\303\251"), ("", "")])
def test_mtree_names(spark, name, want):
    assert one(spark, name, paths.mtree_name) == want


@pytest.mark.parametrize("name, ok", [("a", True), ("..", False), (".", False), ("", False), ("a/b", False), ("a\\b", False), ("/a", False), ("...", True)])
def test_safe_components(spark, name, ok):
    assert one(spark, name, paths.safe_component) is ok and fm.safe(name) is ok
    assert one(spark, name, index.valid_name) is ok


@pytest.mark.parametrize("path, ok", [("a/b", True), ("a/../b", True), ("..", False), ("a/../../b", False), ("/a", False), (".", True), ("./a/..", True), ("a/..b", True)])
def test_confined(spark, path, ok):
    assert one(spark, path, paths.confined) is ok


@pytest.mark.parametrize(
    "pattern, location, ok",
    [
        ("sftp://depot/a/b", "sftp://depot/a/b/", True), ("http://depot:81/", "http://depot:81", True), ("gs://bucket/x", "gs://bucket/x", True), ("gs://bucket/x", "gs://bucket/y", False), ("http://depot/ch*", "http://depot/chunks", True), ("http://*/x", "http://depot/x", True),
        ("http://*/x", "http://depot/y/x", False), ("*://depot/x", "sftp://depot/x", True), ("http://dep?t/x", "http://depot/x", True), ("http://dep?t/x", "http://deppot/x", False), ("http://depot/v[0-9]", "http://depot/v7", True), ("http://depot/v[0-9]", "http://depot/vx", False),
        ("http://depot:81/x", "http://depot:82/x", False), ("http://depot/x/*", "http://depot/x", False), ("/srv/store", "/srv/store/sub/..", True), ("/srv/*", "/srv/a/b", False), ("/srv/[", "/srv/[", False),
    ],
)
def test_locations(pattern, location, ok):
    assert paths.location_matches(pattern, location) is ok


def test_options_of_a_location():
    assert paths.configured({"/a*": {"x": 1}, "/b": {}}, "/abc") == {"x": 1} and paths.configured({}, "/a") == {}
    with pytest.raises(ValueError):
        paths.configured({"/a*": {}, "/ab*": {}}, "/abc")
    assert paths.parse_stores(["/a|http://b/", "s3+http://c"]) == [[("local", "/a"), ("http", "http://b/")], [("s3+http", "s3+http://c")]]
    with pytest.raises(ValueError):
        paths.parse_stores(["ftp://x"])
    assert paths.retry_delays(3) == [500, 1000]


def test_chunk_names(spark):
    id = "ab" * 32
    assert one(spark, f"p/{id[:4]}/{id}.cacnk", lambda c: paths.chunk_id(c, "p/")) == id
    for wrong in (f"{id[:4]}/{id}", f"abcd/{id}.cacnk", f"{id}.cacnk", f"{id[:4]}/{id[:-1]}.cacnk", f"x/{id[:4]}/{id}.cacnk"):
        assert one(spark, wrong, paths.chunk_id) is None


def test_codecs(spark):
    key = bytes(range(32))
    df = spark.createDataFrame([(b"hello" * 40,), (b"",), (None,)], "x binary")
    for compress, k in ((True, None), (False, key), (True, key)):
        rows = df.select("x", codecs.to_storage(F.col("x"), compress, k).alias("s")).select("x", "s", codecs.from_storage(F.col("s"), compress, k).alias("y")).collect()
        assert all(r.x == r.y for r in rows)
    wrong = df.select(codecs.from_storage(codecs.to_storage(F.col("x"), True, key), True, bytes(32)).alias("y")).collect()
    assert all(r.y is None for r in wrong)
    assert one(spark, b"12345", lambda c: F.length(codecs.encrypted(c, key)), "binary") == 33
    assert codecs.extension() == ".cacnk" and codecs.extension(False) == "" and codecs.extension(True, "aes-256-gcm", key) == f".cacnk.aes-256-gcm-{sha(key)[:8]}"
    for bad in ((False, None, "k"), (True, "rot13", "0" * 64), (True, None, "zz"), (True, None, None)):
        with pytest.raises(ValueError):
            codecs.check_options(*bad)
    codecs.check_options(True, None, "0a" * 32)


def test_xchacha(spark):
    from millrace.functions import xchacha

    text = b"Ladies and Gentlemen of the class of '99: If I could offer you only one tip for the future, sunscreen would be it."
    out = xchacha.seal(bytes(range(0x80, 0xA0)), text, bytes(range(0x40, 0x58)), bytes.fromhex("50515253c0c1c2c3c4c5c6c7"))
    assert out[24:40].hex() == "bd6d179d3e83d43b9576579493c0e939" and out[-16:].hex() == "c0875924c1c7987947deafd8780acf49"
    key = bytes(range(32))
    for n in (0, 1, 63, 64, 65, 5000):
        data = os.urandom(n)
        box = xchacha.seal(key, data)
        assert xchacha.unseal(key, box) == data and xchacha.unseal(bytes(32), box) is None and xchacha.unseal(key, box[:-1]) is None
    df = spark.createDataFrame([(b"hello" * 40,), (b"",), (None,)], "x binary")
    both = df.select("x", codecs.from_storage(codecs.to_storage(F.col("x"), True, key, "xchacha20-poly1305"), True, key, "xchacha20-poly1305").alias("y"))
    assert all(r.x == r.y for r in both.collect())


def test_chunk_folders(spark, tmp_path):
    from millrace.sources.folders import read_chunks, write_chunks

    chunks = spark.createDataFrame([(sha(b"%d" % k * 50), b"%d" % k * 50) for k in range(20)], "id string, payload binary")
    for compress in (True, False):
        path = str(tmp_path / f"s{compress}")
        assert write_chunks(chunks.repartition(3), path, compress).agg(F.sum("written")).first()[0] == 20
        assert write_chunks(chunks, path, compress).agg(F.sum("written")).first()[0] == 0
        assert sorted(map(tuple, read_chunks(spark, path, compress).select("id", "payload").collect())) == sorted(map(tuple, chunks.collect()))
        assert read_chunks(spark, path, not compress).count() == 0
    name = next((tmp_path / "sFalse").glob("*/*"))
    assert name.parent.name == name.name[:4]
    name.write_bytes(b"damaged")
    assert [r.id for r in stores.invalid(read_chunks(spark, str(tmp_path / "sFalse"), False)).collect()] == [name.name]


def test_local_trees(spark, tmp_path):
    from millrace.sources.folders import local_nodes, write_nodes

    root = tmp_path / "t"
    (root / "b" / "c").mkdir(parents=True)
    (root / "b" / "f").write_bytes(b"x" * 10)
    (root / "a").symlink_to("b/f")
    nodes = local_nodes(str(root))
    assert [(n.path, n.kind) for n in nodes] == [(".", "dir"), ("a", "link"), ("b", "dir"), ("b/c", "dir"), ("b/f", "file")]
    write_nodes(nodes, str(tmp_path / "u"))
    assert [(n.path, n.kind, n.mode, n.mtime_ns, n.data, n.target) for n in local_nodes(str(tmp_path / "u"))] == [(n.path, n.kind, n.mode, n.mtime_ns, n.data, n.target) for n in nodes]
    assert {n.mtime_ns for n in local_nodes(str(root), no_time=True)} == {0}
    for bad in ("../x", "/etc/x", "a/../../x"):
        with pytest.raises(fm.FormatError):
            write_nodes([fm.Node(bad, "file", 0o100644, data=b"")], str(tmp_path / "v"))
    with pytest.raises(OSError):  # nothing is written through a link
        write_nodes([fm.Node("l", "link", 0o120777, target="/tmp"), fm.Node("l/x", "file", 0o100644, data=b"")], str(tmp_path / "w"))


def tree():
    return [fm.Node(".", "dir", 0o40755, 1, 2, 10**18 + 5), fm.Node("b", "file", 0o100644, 0, 0, 7, {"user.b": b"2", "user.a": b"1"}, b"data"), fm.Node("a", "dir", 0o40700), fm.Node("a/x", "link", 0o120777, target="../b"), fm.Node("a/d", "device", 0o20600, major=4, minor=5), fm.Node("a/e", "file", 0o100600, data=b""), fm.Node("a/sub", "dir", 0o40700), fm.Node("c", "file", 0o100600, data=b"z")]


def test_archive_round_trip_and_order():
    data = fm.encode_archive(tree())
    back = fm.decode_archive(data)
    assert sorted(back, key=lambda n: n.path) == sorted(tree(), key=lambda n: n.path)
    assert [n.path for n in back] == [".", "a", "a/d", "a/e", "a/sub", "a/x", "b", "c"]
    kinds = [k for k, _ in fm.elements(data)]
    assert kinds[:6] == [fm.ENTRY, fm.FILENAME, fm.ENTRY, fm.FILENAME, fm.ENTRY, fm.DEVICE] and kinds[-1] == fm.GOODBYE


@pytest.mark.parametrize("spoil", [lambda d: d[:-1], lambda d: d[:16], lambda d: d.replace(b"sub\0", b"s/b\0"), lambda d: b"\x10" + bytes(7) + b"?" * 8 + d])
def test_broken_archives(spoil):
    data = spoil(fm.encode_archive(tree()))
    if data == fm.encode_archive(tree())[:16]:
        data = data[:10]
    with pytest.raises(fm.FormatError):
        fm.decode_archive(data)


def test_index_files(spark, tmp_path):
    rows = [("one.caibx", k, sha(b"%d" % k), 100 * k, 100) for k in range(5)] + [("two.caibx", 0, sha(b"x"), 0, 7), ("two.caibx", 1, sha(b"x"), 7, 7)]
    df = spark.createDataFrame(rows, "name string, pos long, id string, start long, size long")
    write_index(df, str(tmp_path / "i"), least=64, average=96, most=128)
    spark.dataSource.register(IndexFiles)
    got = spark.read.format("caibx").load(str(tmp_path / "i")).collect()
    assert sorted(map(tuple, got)) == sorted(rows)
    data = (tmp_path / "i" / "one.caibx").read_bytes()
    assert len(data) == 48 + 16 + 40 * 5 + 40 and fm.decode_index(data)[0] == {"flags": 0, "least": 64, "average": 96, "most": 128}
    for bad in (data[:-1], data[:100], b"x" * 64, data[:32] + bytes(16) + data[48:], data + b"y"):
        with pytest.raises(fm.FormatError):
            fm.decode_index(bad)
    with pytest.raises(fm.FormatError):
        fm.decode_index(data, "sha512_256")


def test_archive_and_tar_sources(spark, tmp_path):
    (tmp_path / "t.catar").write_bytes(fm.encode_archive(tree()))
    (tmp_path / "t.tar").write_bytes(to_tar(tree()))
    for s in (ArchiveFiles, TarFiles):
        spark.dataSource.register(s)
    cat = spark.read.format("catar").load(str(tmp_path / "t.catar")).collect()
    assert sorted(tuple(r)[1:] for r in cat) == sorted(node_row("", n)[1:] for n in tree())
    assert {(r.path, r.kind, r.size) for r in spark.read.format("gnutar").load(str(tmp_path / "t.tar")).collect()} == {(n.path, n.kind, len(n.data or b"")) for n in tree()}
    assert {n.path: n.xattrs for n in tar_nodes(to_tar(tree()))}["b"] == {"user.a": b"1", "user.b": b"2"}
    assert tar_nodes(to_tar(tree()[1:2]), add_root=True)[0].path == "."
    nodes = spark.createDataFrame([(1, *node_row("", n)[1:]) for n in tree()], "k int, path string, kind string, mode long, uid long, gid long, mtime_ns long, xattrs map<string,binary>, size long, data binary, target string, major long, minor long")
    assert bytes(archive.archives(nodes, "k").first().data) == fm.encode_archive(tree())


def test_mtree(spark):
    rows = [("d x", "dir", 0o40755, 1, 2, 3 * 10**9 + 4, 0, None, None), ("f", "file", 0o100644, 0, 0, 5, 3, b"abc", None), ("l", "link", 0o120777, 0, 0, 0, 0, None, "t o"), ("c", "char", 0o20600, 0, 0, 0, 0, None, None)]
    df = spark.createDataFrame(rows, "path string, kind string, mode int, uid int, gid int, mtime_ns long, size int, data binary, target string")
    assert [r.line for r in df.select(archive.mtree_lines(df).alias("line")).collect()] == [
        r"d\040x type=dir mode=0755 uid=1 gid=2 time=3.        4", f"f type=file mode=0644 uid=0 gid=0 size=3 time=0.000000005 sha256digest={sha(b'abc')}", r"l type=link mode=0777 target=t\040o uid=0 gid=0 time=0.        0", "c type=char mode=0600 uid=0 gid=0 time=0.        0",
    ]


def test_info_all_or_nothing(spark):
    idx = spark.createDataFrame([("i", 0, "a", 0, 10), ("i", 1, "b", 10, 20), ("i", 2, "a", 30, 10), ("i", 3, "c", 40, 5)], "k string, pos long, id string, start long, size long")
    ids = lambda *x: spark.createDataFrame([(v,) for v in x], "id string")
    table = spark.createDataFrame([("a", 10, 6), ("c", 5, 3), ("b", 21, None)], "id string, uncompressed_size long, compressed_size long")
    r = info.info(idx, "k", spark.createDataFrame([("i", "b")], "k string, id string"), None, ids("a"), table).first()
    assert (r.total, r.unique, r.in_seed, r.in_store, r.size, r.dedup_size_not_in_seed, r.dedup_size_not_in_seed_nor_cache_compressed) == (4, 3, 1, 1, 45, 15, 9)
    r = info.info(idx, "k", None, ids("a"), None, table).first()
    assert (r.in_cache, r.not_in_seed_nor_cache, r.dedup_size_not_in_seed_nor_cache, r.dedup_size_not_in_seed_nor_cache_compressed) == (1, 2, 25, 0)
    assert [x.id for x in info.size_conflicts(idx, table).collect()] == ["b"]


def test_range_lookup(spark):
    sizes = [7, 1, 64, 3, 25]  # chunks of unlike sizes: every range against the bytes each chunk holds
    starts = [sum(sizes[:k]) for k in range(len(sizes))]
    idx = spark.createDataFrame([(1, k, "x", a, n) for k, (a, n) in enumerate(zip(starts, sizes, strict=True))], "k int, pos long, id string, start long, size long")
    asked = [(a, n) for a in (0, 6, 7, 8, 40, 71, 72, 74, 75, 99) for n in (1, 2, 60) if a + n <= 100]
    for begin, length in asked[::3] + asked[-2:]:
        held = [k for k, (a, n) in enumerate(zip(starts, sizes, strict=True)) if a < begin + length and begin < a + n]
        r = ranges.positions(idx, spark.createDataFrame([(1, begin, length)], "k int, begin long, length long"), "k").first()
        assert (r.first, r.last) == (held[0], held[-1]), (begin, length)


def test_sparse_state(spark):
    idx = spark.createDataFrame([(1, k) for k in range(11)] + [(2, 0)], "k int, pos long")
    on = spark.createDataFrame([(1, 0), (1, 9), (1, 3)], "k int, pos long")
    state = ranges.saved_state(idx, on, "k")
    assert {r.k: bytes(r.state) for r in state.collect()} == {1: b"\x09\x02", 2: b"\0"}
    assert {(r.k, r.pos) for r in ranges.loaded_state(state, idx, "k").collect()} == {(1, 0), (1, 9), (1, 3)}
    with pytest.raises(Exception, match="state doesn't fit"):
        ranges.loaded_state(state.withColumn("state", F.lit(b"xyz")), idx, "k").collect()


@pytest.mark.parametrize("text", ["a", "zzzz", "abcabdabe", "mississippi", "abcdefgh", "xyyx" * 3])
def test_self_seed(spark, text):
    ids, copies = list(text), len(text) - len(set(text))
    idx = spark.createDataFrame([(1, p, str(i), 1024 * p, 1024) for p, i in enumerate(ids)], "k int, pos long, id string, start long, size long")
    none = idx.select("k", F.lit("s").alias("seed"), F.col("pos").alias("seed_pos"), "id").where("false")
    r = seeds.extract_stats(seeds.sources(seeds.planned(idx, none, "k"), idx, "k"), "k").first()
    assert (r.bytes_from_self, r.bytes_from_store, r.chunks_from_seeds) == (copies * 1024, (len(ids) - copies) * 1024, 0)


def walk(target, of, limit, null=None):
    """The rule, walked: (first, last, seed, seed_pos); zeros come before all seeds."""
    at, out = 0, []
    while at < len(target):
        n = 0
        while n < limit and at + n < len(target) and target[at + n] == null:
            n += 1
        best = (n * 10, n, None, -1) if n else (0, 1, None, None)
        for s in sorted(of):
            found = (0, None)
            for j, x in enumerate(of[s]):
                n = 0
                while x == target[at] and n < limit and at + n < len(target) and j + n < len(of[s]) and target[at + n] == of[s][j + n]:
                    n += 1
                if n > found[0]:
                    found = (n, j)
            if found[0] * 10 > best[0]:
                best = (found[0] * 10, found[0], s, found[1])
        out.append((at, at + best[1] - 1, best[2], best[3]))
        at += best[1]
    return out


@pytest.mark.parametrize("case", range(6))
def test_plan_equals_the_walk(spark, case):
    import random

    r = random.Random(case)
    target = [r.choice("abcde") for _ in range(25)]
    of = {s: [r.choice("abcde") for _ in range(15)] for s in "pqr"}
    of["p"] += target[5:15]
    idx = spark.createDataFrame([(1, p, i, 10 * p, 10) for p, i in enumerate(target)], "k int, pos long, id string, start long, size long")
    s = spark.createDataFrame([(1, n, p, i) for n, ids in of.items() for p, i in enumerate(ids)], "k int, seed string, seed_pos long, id string")
    limit = (100, 3)[case % 2]
    for null in (None, "a"):
        plan = seeds.planned(idx, s, "k", limit, null_id=null)
        want = walk(target, of, limit, null)
        assert sorted(map(tuple, plan.select("first", "last", "seed", "seed_pos").collect())) == want
        seeded = sum(last - first + 1 for first, last, _, pos in want if pos is not None)
        assert seeds.extract_stats(seeds.sources(plan, idx, "k"), "k").first().chunks_from_seeds == seeded


@pytest.mark.parametrize("limit", [100, 4, 1])
def test_zeros_meet_only_next_to_other_matches(spark, limit):
    import random

    r = random.Random(limit)
    target = [x for _ in range(12) for x in ["0"] * r.randint(1, 8) + [r.choice("abc") for _ in range(r.randint(1, 2))]]
    of = {"p": target[7:40] + ["0"] * 9 + target[:6], "q": [x for _ in range(6) for x in ["0"] * r.randint(1, 8) + [r.choice("abcd")]], "r": ["0"] * 300}
    idx = spark.createDataFrame([(1, p, i, 10 * p, 10) for p, i in enumerate(target)], "k int, pos long, id string, start long, size long")
    s = spark.createDataFrame([(1, n, p, i) for n, ids in of.items() for p, i in enumerate(ids)], "k int, seed string, seed_pos long, id string")
    assert sorted(map(tuple, seeds.planned(idx, s, "k", limit, null_id="0").select("first", "last", "seed", "seed_pos").collect())) == walk(target, of, limit, "0")
    # A seed of zeros alone has no runs, however many there are: 300 for each of the target's zeros otherwise.
    assert {x.seed for x in seeds.runs(idx, s, "k", limit, "0").collect()} == {"p", "q"}
    assert "r" in {x.seed for x in seeds.runs(idx, s, "k", limit).collect()}


def shuffled(spark):
    """Rows that all stages so far wrote to shuffles."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    none = spark.sparkContext._gateway.new_array(spark._jvm.double, 0)
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, none, None)
    return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))


@pytest.mark.parametrize("null", [None, "0"])
def test_copies_are_not_paired(spark, null):
    n = 1500
    target = [x for k in range(n) for x in ("a", "b", "0", f"t{k}")]
    seed = [x for k in range(n) for x in ("a", f"s{k}", "0", "b")] + ["a", "b", "0", "a"]
    idx = spark.createDataFrame([(1, p, i, 10 * p, 10) for p, i in enumerate(target)], "k int, pos long, id string, start long, size long")
    s = spark.createDataFrame([(1, "p", p, i) for p, i in enumerate(seed) if i in "ab0"], "k int, seed string, seed_pos long, id string")
    before = shuffled(spark)
    got = {(r.pos, r.seed_pos, r.n) for r in seeds.runs(idx, s, "k", null_id=null).collect()}
    assert shuffled(spark) - before < 20 * len(target)  # n times n pairs of a alone
    want = {0: (4 * n, 3), 1: (4 * n + 1, 2), 2: (2, 1)}
    assert {x for x in got if target[x[0]] != "0"} == {(p, *want[p % 4]) for p in range(4 * n) if p % 4 < 2}
    assert null or {x for x in got if target[x[0]] == "0"} == {(p, *want[2]) for p in range(2, 4 * n, 4)}


@pytest.mark.parametrize("case", range(4))
def test_runs_over_block_ends(spark, case, monkeypatch):
    import random

    r = random.Random(case)
    limit = (7, 20)[case % 2]
    monkeypatch.setattr(seeds, "BLOCK", 8)
    target = [r.choice("000ab") for _ in range(90)]
    of = {s: [r.choice("0ab") for _ in range(20)] + target[30:75] for s in "pq"}
    idx = spark.createDataFrame([(1, p, i, 10 * p, 10) for p, i in enumerate(target)], "k int, pos long, id string, start long, size long")
    s = spark.createDataFrame([(1, n, p, i) for n, ids in of.items() for p, i in enumerate(ids)], "k int, seed string, seed_pos long, id string")
    for null in (None, "0"):
        assert sorted(map(tuple, seeds.planned(idx, s, "k", limit, null_id=null).select("first", "last", "seed", "seed_pos").collect())) == walk(target, of, limit, null)


def test_invalid_seeds(spark):
    data = [b"a", b"b", b"c"]
    idx = spark.createDataFrame([(1, p, sha(d), p, 1) for p, d in enumerate(data)], "k int, pos long, id string, start long, size long")
    s = spark.createDataFrame([(1, "x", p, sha(d), b"?" if p == 1 else d) for p, d in enumerate(data)] + [(1, "y", 0, sha(b"c"), b"c")], "k int, seed string, seed_pos long, id string, payload binary")
    with pytest.raises(ValueError):
        seeds.planned(idx, s, "k")
    assert sorted(map(tuple, seeds.planned(idx, s, "k", on_invalid="skip").select("first", "last", "seed").collect())) == [(0, 0, None), (1, 1, None), (2, 2, "y")]


def test_clone_parts(spark):
    rows = [(0, 0, 1000), (5, 5, 1000), (5, 6, 1000), (100, 612, 100), (0, 512, 512)]
    got = seeds.clone_parts(spark.createDataFrame(rows, "source long, target long, length long"), 512).collect()
    assert [(r.cloned, r.copied) for r in got] == [(512, 488), (0, 1000), (0, 1000), (0, 100), (512, 0)]


def test_stores(spark):
    ids = lambda *x: spark.createDataFrame([(v,) for v in x], "id string")
    got = lambda df, *c: sorted(tuple(r) for r in df.select(*c).collect())
    held = spark.createDataFrame([("a", "s1", 0), ("a", "s0", 1), ("b", "s0", 1)], "id string, store string, priority int")
    assert got(stores.routed(ids("a", "b", "c", "a"), held), "id", "served") == [("a", "s1"), ("b", "s0"), ("c", None)]
    assert got(stores.has(ids("a", "z"), held), "id") == [("a",)]
    assert got(stores.to_store(ids("a", "x", "x"), held), "id") == [("x",)]
    delete, keep = stores.prune(ids("a", "b"), ids("b"))
    assert got(delete, "id") == [("a",)] and got(keep, "id") == [("b",)]
    store = spark.createDataFrame([(sha(b"1"), b"1"), (sha(b"2"), b"x"), ("n", None)], "id string, payload binary")
    assert got(stores.invalid(store), "id") == sorted([(sha(b"2"),), ("n",)])
    assert got(stores.fetched(ids(sha(b"1"), sha(b"2"), "q"), store), "id", "valid") == sorted([(sha(b"1"), True), (sha(b"2"), False)])
    assert got(stores.copy_plan(ids("a", "b", "c", "d"), [ids("a")], ids("b"), ids("c")), "id", "found") == [("c", True), ("d", False)]


def test_failover_is_a_walk(spark):
    fails = [0, 1, 1, 0, 1, 0, 0]
    df = spark.createDataFrame([(1, k, f) for k, f in enumerate(fails)], "g int, at long, bad int")
    active, want = 0, []
    for k, f in enumerate(fails):
        want.append((k, active, (active + f) % 3))
        active = (active + f) % 3
    assert sorted((r.at, r.active, r.next) for r in stores.failover(df, "g", "at", F.col("bad") == 1, 3).collect()) == want


def test_streamed_blobs(spark, tmp_path):
    from millrace.streaming.ingest import ingest

    sizes = Sizes(48, 96, 192, digest="sha256")
    for k in range(2):
        spark.createDataFrame([(k, os.urandom(50)), (9, b"same" * 200)], "k int, data binary").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k int, data binary").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    ingest(stream, str(tmp_path / "store"), str(tmp_path / "index"), str(tmp_path / "cp"), sizes).awaitTermination(60)
    store = spark.read.parquet(str(tmp_path / "store"))
    assert store.count() == store.select("id").distinct().count() == spark.read.parquet(str(tmp_path / "index")).select("id").distinct().count()
    assert stores.invalid(store).count() == 0 and store.select("batch").distinct().count() == 2
