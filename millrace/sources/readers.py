"""Spark data sources for index files, archives and tar files.

    spark.dataSource.register(IndexFiles); spark.read.format("caibx").load(path)

Each file is one partition. Files are opened through Spark's own `binaryFile` reader elsewhere in the library;
these sources are for local and mounted paths.
"""

from __future__ import annotations

import glob
import io
import os
import tarfile
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from millrace.sources.formats import Node, decode_archive, decode_index, encode_index

NODE_SCHEMA = "file string, path string, kind string, mode long, uid long, gid long, mtime_ns long, xattrs map<string,binary>, size long, data binary, target string, major long, minor long"
INDEX_SCHEMA = "name string, pos long, id string, start long, size long"


class FilesReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self):
        path = self.options["path"].removeprefix("file://")
        names = sorted(glob.glob(os.path.join(path, "*")) if os.path.isdir(path) else glob.glob(path))
        return [InputPartition(n) for n in names if os.path.isfile(n)]

    def read(self, partition) -> Iterator[tuple]:
        with open(partition.value, "rb") as f:
            yield from self.rows(os.path.basename(partition.value), f.read())


class IndexReader(FilesReader):
    def rows(self, name: str, data: bytes) -> Iterator[tuple]:
        _, chunks = decode_index(data, self.options.get("digest"))
        for pos, (id, start, size) in enumerate(chunks):
            yield name, pos, id, start, size


def node_row(file: str, n: Node) -> tuple:
    return file, n.path, n.kind, n.mode, n.uid, n.gid, n.mtime_ns, n.xattrs, len(n.data or b""), n.data, n.target, n.major, n.minor


class ArchiveReader(FilesReader):
    def rows(self, name: str, data: bytes) -> Iterator[tuple]:
        for n in decode_archive(data):
            yield node_row(name, n)


PAX = "SCHILY.xattr."
TAR_KINDS = {tarfile.DIRTYPE: ("dir", 0o040000), tarfile.REGTYPE: ("file", 0o100000), tarfile.AREGTYPE: ("file", 0o100000), tarfile.SYMTYPE: ("link", 0o120000), tarfile.CHRTYPE: ("device", 0o020000), tarfile.BLKTYPE: ("device", 0o060000)}


def tar_nodes(data: bytes, add_root: bool = False) -> list[Node]:
    """The members of a tar file that archives can hold; the root is added if asked for."""
    out = [Node(".", "dir", 0o040755)] if add_root else []
    with tarfile.open(fileobj=io.BytesIO(data)) as t:
        for m in t:
            if m.type not in TAR_KINDS:
                continue
            kind, bits = TAR_KINDS[m.type]
            xattrs = {k.removeprefix(PAX): v.encode("utf-8", "surrogateescape") for k, v in m.pax_headers.items() if k.startswith(PAX)}
            body = t.extractfile(m).read() if kind == "file" else None
            out.append(Node(os.path.normpath(m.name), kind, bits | m.mode & 0o7777, m.uid, m.gid, round(float(m.pax_headers.get("mtime", m.mtime)) * 10**9), xattrs, body, m.linkname or None, m.devmajor or 0, m.devminor or 0))
    return out


def to_tar(nodes: list[Node]) -> bytes:
    out = io.BytesIO()
    kinds = {"dir": tarfile.DIRTYPE, "file": tarfile.REGTYPE, "link": tarfile.SYMTYPE}
    with tarfile.open(fileobj=out, mode="w", format=tarfile.PAX_FORMAT) as t:
        for n in nodes:
            m = tarfile.TarInfo(n.path)
            m.type = kinds.get(n.kind) or (tarfile.CHRTYPE if n.mode & 0o170000 == 0o020000 else tarfile.BLKTYPE)
            m.mode, m.uid, m.gid, m.mtime, m.size = n.mode & 0o7777, n.uid, n.gid, n.mtime_ns // 10**9, len(n.data or b"")
            m.linkname, m.devmajor, m.devminor = n.target or "", n.major, n.minor
            m.pax_headers = {PAX + k: v.decode("utf-8", "surrogateescape") for k, v in sorted(n.xattrs.items())}
            t.addfile(m, io.BytesIO(n.data or b""))
    return out.getvalue()


class TarReader(FilesReader):
    def rows(self, name: str, data: bytes) -> Iterator[tuple]:
        for n in tar_nodes(data, self.options.get("addroot", "false") == "true"):
            yield node_row(name, n)


class IndexWriter(DataSourceWriter):
    """One file for each name; a name's rows must be in one partition, in order of pos."""

    def __init__(self, options: dict):
        self.options = options

    def write(self, iterator) -> WriterCommitMessage:
        path = self.options["path"].removeprefix("file://")
        os.makedirs(path, exist_ok=True)
        names: dict[str, list] = {}
        for r in iterator:
            names.setdefault(r.name, []).append((r.pos, r.id, r.size))
        sizes = [int(self.options.get(k, d)) for k, d in (("least", 16 << 10), ("average", 64 << 10), ("most", 256 << 10), ("flags", 0))]
        for name, rows in names.items():
            part = os.path.join(path, f".{name}.part")
            with open(part, "wb") as f:
                f.write(encode_index([(id, size) for _, id, size in sorted(rows)], *sizes))
            os.replace(part, os.path.join(path, name))  # whole or not at all, also when a task runs again
        return WriterCommitMessage()


class IndexFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "caibx"

    def schema(self) -> str:
        return INDEX_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return IndexReader(self.options)

    def writer(self, schema, overwrite) -> DataSourceWriter:
        return IndexWriter(self.options)


class ArchiveFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "catar"

    def schema(self) -> str:
        return NODE_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return ArchiveReader(self.options)


class TarFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "gnutar"

    def schema(self) -> str:
        return NODE_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return TarReader(self.options)


def write_index(index: DataFrame, path: str, **options) -> None:
    """Index files, one for each name."""
    index.sparkSession.dataSource.register(IndexFiles)
    rows = index.select("name", F.col("pos").cast("long").alias("pos"), "id", "start", "size").repartition("name").sortWithinPartitions("name", "pos")
    rows.write.format("caibx").options(path=path, **{k: str(v) for k, v in options.items()}).mode("append").save()
