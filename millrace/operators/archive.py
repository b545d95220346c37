"""Directory trees as tables of nodes, packed into archives and listed as mtree manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.paths import mtree_name
from millrace.sources.formats import Node, decode_archive, encode_archive, heap_order, name_hash
from millrace.sources.readers import NODE_SCHEMA, node_row

HEADER = "#mtree v1.0"
NODE_COLUMNS = [c.split()[0] for c in NODE_SCHEMA.split(", ")]


def mtree_lines(nodes: DataFrame) -> Column:
    """The manifest line of a node: columns path, kind (dir, file, link, char, block), mode, uid, gid, mtime_ns, size, data, target."""
    seconds, nanos = F.floor(F.col("mtime_ns") / 1_000_000_000), F.pmod("mtime_ns", F.lit(1_000_000_000))
    mode = F.lpad(F.conv(F.col("mode").bitwiseAND(0o777).cast("string"), 10, 8), 4, "0")
    ids = [F.format_string("uid=%d", "uid"), F.format_string("gid=%d", "gid")]
    head = [mtree_name(F.col("path")), F.concat(F.lit("type="), F.col("kind")), F.concat(F.lit("mode="), mode)]
    padded = F.format_string("time=%d.%9d", seconds, nanos)
    file = F.concat_ws(" ", *head, *ids, F.format_string("size=%d", "size"), F.format_string("time=%d.%09d", seconds, nanos), F.concat(F.lit("sha256digest="), F.sha2("data", 256)))
    link = F.concat_ws(" ", *head, F.concat(F.lit("target="), mtree_name(F.col("target"))), *ids, padded)
    return F.when(F.col("kind") == "file", file).when(F.col("kind") == "link", link).otherwise(F.concat_ws(" ", *head, *ids, padded))


def archives(nodes: DataFrame, key: str) -> DataFrame:
    """key and data (the archive) of each tree; a tree is one group, whose nodes are put in path order."""
    import pyarrow as pa

    def pack(t: pa.Table) -> pa.Table:
        tree = [Node(r["path"], r["kind"], r["mode"], r["uid"], r["gid"], r["mtime_ns"], dict(r["xattrs"] or []), r["data"], r["target"], r["major"] or 0, r["minor"] or 0) for r in t.to_pylist()]
        return pa.table([t.column(key).slice(0, 1), pa.array([encode_archive(tree)], pa.binary())], [key, "data"])

    return nodes.groupBy(key).applyInArrow(pack, f"{key} {dict(nodes.dtypes)[key]}, data binary")


def unpacked(packed: DataFrame, key: str) -> DataFrame:
    """The nodes of archives (key, data); `file` is the key as text."""

    def nodes(batches):
        import pandas as pd

        for b in batches:
            rows = [node_row(str(name), n) for name, data in zip(b[key], b["data"], strict=True) for n in decode_archive(bytes(data))]
            yield pd.DataFrame(rows, columns=NODE_COLUMNS)

    return packed.select(key, "data").mapInPandas(nodes, NODE_SCHEMA)


def goodbye_order(names: DataFrame, key: str) -> DataFrame:
    """key, name, hash (signed), place: where each name of a directory stands in its lookup table."""
    import pyarrow as pa

    def order(t: pa.Table) -> pa.Table:
        items = heap_order(sorted((name_hash(n), n) for n in set(t.column("name").to_pylist())))
        k = t.column(key)[0].as_py()
        return pa.table([pa.array([k] * len(items), t.column(key).type), pa.array([n for _, n in items], pa.string()), pa.array([h - (1 << 64) if h >> 63 else h for h, _ in items], pa.int64()), pa.array(range(len(items)), pa.int64())], [key, "name", "hash", "place"])

    return names.select(key, "name").groupBy(key).applyInArrow(order, f"{key} {dict(names.dtypes)[key]}, name string, hash long, place long")
