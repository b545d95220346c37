"""Chunk stores as folders of files, and directory trees on a local or mounted disk."""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import codecs
from millrace.functions.paths import chunk_id
from millrace.sources.formats import FormatError, Node, safe


def read_chunks(spark: SparkSession, path: str, compress: bool = True, key: bytes | None = None, algorithm: str = "aes-256-gcm") -> DataFrame:
    """id, stored_size and payload of the chunk files below a path (xxxx/<id><extension>); files with another extension are of another store."""
    ext = codecs.extension(compress, algorithm, key)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    ids = files.select(chunk_id(F.regexp_extract("path", r"([^/]*/[^/]*)$", 1), "", ext).alias("id"), F.col("length").alias("stored_size"), "content")
    return ids.where("id is not null").select("id", "stored_size", codecs.from_storage(F.col("content"), compress, key, algorithm).alias("payload"))


def write_chunks(chunks: DataFrame, path: str, compress: bool = True, key: bytes | None = None, algorithm: str = "aes-256-gcm") -> DataFrame:
    """Write chunks (id, payload) as files and return how many each task wrote; those that are there stay.

    Each file is written aside and renamed, so a task that runs again does no harm. The path must be one that all
    executors mount.
    """
    ext, root = codecs.extension(compress, algorithm, key), path.removeprefix("file://")
    rows = chunks.dropDuplicates(["id"]).select("id", codecs.to_storage(F.col("payload"), compress, key, algorithm).alias("data"))

    def write(batches: Iterator) -> Iterator:
        import pandas as pd

        for b in batches:
            n = 0
            for id, data in zip(b["id"], b["data"], strict=True):
                folder = os.path.join(root, id[:4])
                name = os.path.join(folder, id + ext)
                if os.path.exists(name):
                    continue
                os.makedirs(folder, exist_ok=True)
                aside = os.path.join(folder, f".tmp-{os.getpid()}-{id}")
                with open(aside, "wb") as f:
                    f.write(data)
                os.replace(aside, name)
                n += 1
            yield pd.DataFrame({"written": [n]})

    written = rows.mapInPandas(write, "written long")
    return written.sparkSession.createDataFrame(written.collect(), "written long")  # one number for each batch


def local_nodes(root: str, one_filesystem: bool = False, no_time: bool = False) -> list[Node]:
    """A directory tree, each directory before its entries, entries in order of name. Sockets and pipes are left out."""
    out: list[Node] = []
    device = os.lstat(root).st_dev

    def visit(path: str, name: str) -> None:
        s = os.lstat(path)
        if one_filesystem and s.st_dev != device:
            return
        kinds = ((stat.S_ISDIR, "dir"), (stat.S_ISREG, "file"), (stat.S_ISLNK, "link"), (stat.S_ISCHR, "device"), (stat.S_ISBLK, "device"))
        kind = next((k for test, k in kinds if test(s.st_mode)), None)
        if not kind:
            return
        node = Node(name, kind, s.st_mode, s.st_uid, s.st_gid, 0 if no_time else s.st_mtime_ns)
        if kind != "link":
            node.xattrs = {x: os.getxattr(path, x) for x in os.listxattr(path)}
        if kind == "file":
            with open(path, "rb") as f:
                node.data = f.read()
        elif kind == "link":
            node.target = os.readlink(path)
        elif kind == "device":
            node.major, node.minor = os.major(s.st_rdev), os.minor(s.st_rdev)
        out.append(node)
        if kind == "dir":
            for entry in sorted(os.listdir(path)):
                visit(os.path.join(path, entry), entry if name == "." else f"{name}/{entry}")

    visit(root, ".")
    return out


def write_nodes(nodes: list[Node], root: str, owner: bool = False) -> None:
    """Write a tree below root, never outside it; modes and times of directories come last, deepest first.

    Directories are opened one below the other and never through a link, so neither names nor links in an
    archive lead elsewhere. Devices need privileges and are skipped without them.
    """
    os.makedirs(root, exist_ok=True)
    dirs: list[Node] = []

    def opened(path: str) -> int:
        at = os.open(root, os.O_RDONLY | os.O_DIRECTORY)
        for part in path.split("/") if path not in ("", ".") else []:
            below = os.open(part, os.O_RDONLY | os.O_DIRECTORY | os.O_NOFOLLOW, dir_fd=at)
            os.close(at)
            at = below
        return at

    def finish(n: Node, at: int, name: str) -> None:
        if owner:
            os.chown(name, n.uid, n.gid, dir_fd=at, follow_symlinks=False)
        if n.kind != "link":
            os.chmod(name, n.mode & 0o7777, dir_fd=at)
        os.utime(name, ns=(n.mtime_ns, n.mtime_ns), dir_fd=at, follow_symlinks=False)

    for n in nodes:
        if n.path == ".":
            dirs.append(n)
            continue
        parts = n.path.split("/")
        if not all(safe(p) for p in parts):
            raise FormatError(f"unsafe path {n.path!r}")
        at = opened("/".join(parts[:-1]))
        name = parts[-1]
        try:
            if n.kind == "dir":
                if not (name in os.listdir(at) and stat.S_ISDIR(os.lstat(name, dir_fd=at).st_mode)):
                    os.mkdir(name, dir_fd=at)
                dirs.append(n)
                continue
            if name in os.listdir(at):
                os.unlink(name, dir_fd=at)
            if n.kind == "link":
                os.symlink(n.target or "", name, dir_fd=at)
            elif n.kind == "device":
                try:
                    os.mknod(name, n.mode, os.makedev(n.major, n.minor), dir_fd=at)
                except PermissionError:
                    continue
            else:
                f = os.open(name, os.O_WRONLY | os.O_CREAT | os.O_EXCL, 0o600, dir_fd=at)
                with os.fdopen(f, "wb") as out:
                    out.write(n.data or b"")
                    for k, v in n.xattrs.items():
                        os.setxattr(out.fileno(), k, v)
            finish(n, at, name)
        finally:
            os.close(at)
    for n in sorted(dirs, key=lambda n: n.path.count("/") + (n.path != "."), reverse=True):
        at = opened(n.path)
        try:
            if owner:
                os.fchown(at, n.uid, n.gid)
            os.fchmod(at, n.mode & 0o7777)
            os.utime(at, ns=(n.mtime_ns, n.mtime_ns))
        finally:
            os.close(at)
