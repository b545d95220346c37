"""The everyday commands over a chunk store: make, chop, extract, cat, info, cache, prune, verify, tar and untar."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import codecs
from millrace.functions.rolling import Sizes
from millrace.operators import archive, chunking, index, info, ranged, ranges, seeds, stores
from millrace.sources.formats import Node

STORE_SCHEMA = "id string, size long, stored_size long, data binary, generation int"
INDEX_SCHEMA = "name string, pos long, id string, start long, size long, version long"


class Store:
    """Chunks (id, size, stored_size, data) in Parquet folders below `path`, compressed and encrypted as asked for.

    A write adds a folder to the newest generation. Pruning writes the survivors as the next generation and makes
    that the newest, so readers see all or nothing of it; older generations may be deleted at leisure.
    """

    def __init__(self, spark: SparkSession, path: str, compress: bool = True, key: bytes | None = None, digest: str = "sha256"):
        self.spark, self.path, self.compress, self.key, self.digest = spark, path.rstrip("/"), compress, key, digest
        self.fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def generation(self) -> int:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not self.fs.exists(p):
            return 0
        names = [s.getPath().getName() for s in self.fs.listStatus(p)]
        return max([int(n.partition("=")[2]) for n in names if n.startswith("generation=")], default=0)

    def rows(self) -> DataFrame:
        """All chunks as stored; columns that aren't asked for aren't read."""
        if not self.fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(self.path)):
            return self.spark.createDataFrame([], STORE_SCHEMA).drop("generation")
        base = self.spark.read.schema(STORE_SCHEMA.rpartition(",")[0]).option("recursiveFileLookup", "true")
        return base.parquet(f"{self.path}/generation={self.generation()}")

    def plain(self, rows: DataFrame | None = None) -> DataFrame:
        """id and payload; a payload that can't be taken back is null."""
        rows = self.rows() if rows is None else rows
        return rows.select("id", codecs.from_storage(F.col("data"), self.compress, self.key).alias("payload"))

    def add(self, chunks: DataFrame) -> None:
        """Store chunks (id, payload) that aren't there yet."""
        new = stores.to_store(chunks.select("id", "payload"), self.rows())
        data = new.select("id", F.octet_length("payload").cast("long").alias("size"), codecs.to_storage(F.col("payload"), self.compress, self.key).alias("data"))
        sized = data.select("id", "size", F.octet_length("data").cast("long").alias("stored_size"), "data")
        sized.write.parquet(f"{self.path}/generation={self.generation()}/{uuid.uuid4().hex}")

    def replace(self, keep: DataFrame) -> None:
        """Make these rows the newest generation: written aside, then renamed."""
        Path, n = self.spark._jvm.org.apache.hadoop.fs.Path, self.generation()
        aside = f"{self.path}/.{uuid.uuid4().hex}"
        keep.write.parquet(f"{aside}/all")
        if not self.fs.rename(Path(aside), Path(f"{self.path}/generation={n + 1}")):
            self.fs.delete(Path(aside), True)
            raise OSError(f"can't make generation {n + 1} of {self.path}")

    def prune(self, referenced: DataFrame) -> DataFrame:
        """Drop chunks that are not referenced; returns their ids."""
        delete, keep = stores.prune(self.rows(), referenced)
        gone = delete.select("id").checkpoint() if self.spark.sparkContext.getCheckpointDir() else self.spark.createDataFrame(delete.select("id").toLocalIterator(), "id string")
        self.replace(keep)
        return gone

    def invalid(self) -> DataFrame:
        return stores.invalid(self.plain(), self.digest).select("id")

    def verify(self, repair: bool = False) -> DataFrame:
        """Ids whose chunk is damaged; with repair they are dropped (and the ids kept in a folder beside the chunks)."""
        if not repair:
            return self.invalid()
        path = f"{self.path}/.damaged-{uuid.uuid4().hex}"
        self.invalid().write.parquet(path)
        bad = self.spark.read.schema("id string").parquet(path)
        if not bad.isEmpty():
            self.replace(stores.lacks(self.rows(), bad))
        return bad


class Engine:
    """Indexes (Parquet below `indexes`) over stores in order of priority, the first of which is written to."""

    def __init__(self, spark: SparkSession, indexes: str, *held: Store, sizes: Sizes | None = None, cache: Store | None = None):
        self.spark, self.path, self.stores, self.cache = spark, indexes.rstrip("/"), held, cache
        self.sizes = sizes or Sizes(digest="sha256")

    def blobs(self, path: str) -> DataFrame:
        """name and data of the files at a path."""
        return self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("content").alias("data"))

    def same(self, payload: str = "payload") -> Column:
        """Whether a chunk's bytes have the digest of its id."""
        return chunking.digest_of(F.col(payload), self.sizes.digest) == F.col("id")

    def kept(self) -> DataFrame:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        there = p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)
        return self.spark.read.schema(INDEX_SCHEMA).parquet(self.path) if there else self.spark.createDataFrame([], INDEX_SCHEMA)

    def save(self, chunks: DataFrame, names: DataFrame) -> None:
        """Keep the indexes of `names`: a version newer than all, which replaces earlier ones of these names, also where
        a blob has no chunks now (a row of pos -1 marks each). A name that doesn't stay in its store raises."""
        version = (self.kept().agg(F.max("version")).first()[0] or 0) + 1
        mark = F.when(index.valid_name(F.col("name")), F.lit(-1)).otherwise(F.raise_error(F.concat(F.lit("not an index name: "), F.col("name")))).cast("long")
        marks = names.select("name").distinct().select("name", mark.alias("pos"), F.lit(None).cast("string").alias("id"), F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("size"))
        rows = chunks.select("name", "pos", "id", "start", "size").union(marks)
        rows.withColumn("version", F.lit(version).cast("long")).write.mode("append").parquet(self.path)

    def index(self, *names: str) -> DataFrame:
        """The newest index of every name, or of these."""
        out = self.kept()
        out = out.where(F.col("name").isin(list(names))) if names else out
        newest = out.where("pos < 0").groupBy("name").agg(F.max("version").alias("version"))
        return out.where("pos >= 0").join(newest, ["name", "version"]).drop("version")

    def make(self, blobs: DataFrame | str) -> DataFrame:
        """Chunk blobs (name, data) or the files at a path, which may have any size, store what is new, keep their indexes."""
        if isinstance(blobs, str):
            name = F.element_at(F.split("path", "/"), -1).alias("name")
            chunks = ranged.chunk_files(self.spark, blobs, self.sizes, payload=True).select(name, "pos", "start", "size", "id", "payload")
            names = ranged.files(self.spark, blobs).select(name)
            if names.count() > names.distinct().count():
                raise ValueError(f"several files at {blobs} have one name")
        else:
            chunks, names = chunking.chunk_index(blobs, self.sizes, payload=True), blobs
        chunks.persist()
        self.stores[0].add(chunks)
        self.save(chunks, names)
        chunks.unpersist()
        return self.index()

    def chop(self, blobs: DataFrame, *names: str, ignore: DataFrame | None = None) -> None:
        """Store the chunks of blobs that have an index, but for ignored ids; bytes that don't match raise."""
        parts = index.sliced(self.index(*names), blobs, "name")
        if not parts.where(~self.same()).isEmpty():
            raise ValueError("a blob doesn't match its index")
        self.stores[0].add(stores.without(parts, *([ignore] if ignore is not None else [])))

    def fetched(self, ids: DataFrame) -> DataFrame:
        """id and payload (null if no store has the chunk): the cache first, then the stores; damaged cached chunks count as absent."""
        each = [*([self.cache] if self.cache else []), *self.stores]
        rows = None
        for k, s in enumerate(each):
            own = stores.has(s.rows(), ids)
            part = s.plain(own)
            if s is self.cache:
                part = part.where(self.same())
            part = part.withColumns({"store": F.lit(s.path), "priority": F.lit(k)})
            rows = part if rows is None else rows.union(part)
        return stores.routed(ids, rows, "payload")

    def planned(self, *names: str, local: DataFrame, on_invalid: str = "skip") -> DataFrame:
        """name, first, last, seed, seed_pos: which runs of these indexes come from local blobs (name, data) that have
        indexes too, and which are zeros (seed_pos -1). The plan is made over seeds that are what their indexes say (on_invalid: skip, or bail, which raises)."""
        idx = self.index(*names)
        of = index.sliced(self.index().join(local.select("name").distinct(), "name"), local, "name")
        held = of.select(F.col("name").alias("seed"), F.col("pos").alias("seed_pos"), "id", self.same().alias("same"))
        bad = held.where(~F.col("same")).select("seed").distinct()
        if on_invalid == "bail" and not bad.isEmpty():
            raise ValueError("a seed doesn't match its index")
        held = held.join(bad, "seed", "left_anti").join(idx.select("name", "id").distinct(), "id")
        return seeds.planned(idx, held.select("name", "seed", "seed_pos", "id"), "name", null_id=chunking.null_id(self.sizes))

    def extract(self, *names: str, local: DataFrame | None = None, on_invalid: str = "skip") -> DataFrame:
        """name and data of blobs; a chunk that is missing or damaged raises.

        Chunks of zero bytes of the largest size are made, runs that local blobs hold (see planned) are taken from
        there, and only the rest is fetched from the cache and the stores, each id once.
        """
        idx = self.index(*names)
        null = chunking.null_id(self.sizes)
        zeros = F.unhex(F.repeat(F.lit("00"), F.col("size").cast("int")))
        parts = idx.where(F.col("id") == null).withColumn("payload", zeros)
        rest = idx.where(F.col("id") != null)
        if local is not None:
            runs = self.planned(*names, local=local, on_invalid=on_invalid).where("seed is not null")
            each = runs.select("name", "seed", F.explode(F.arrays_zip(F.sequence("first", "last").alias("pos"), F.sequence(F.col("seed_pos"), F.col("seed_pos") + F.col("last") - F.col("first")).alias("seed_pos"))).alias("at"))
            of = index.sliced(self.index().join(local.select("name").distinct(), "name"), local, "name").select(F.col("name").alias("seed"), F.col("pos").alias("seed_pos"), "payload")
            own = each.select("name", "seed", "at.pos", "at.seed_pos").join(of, ["seed", "seed_pos"]).select("name", "pos", "payload")
            parts = parts.unionByName(rest.join(own, ["name", "pos"]).select(*parts.columns))
            rest = rest.join(own.select("name", "pos"), ["name", "pos"], "left_anti")
        got = self.fetched(rest).select("id", "payload")
        checked = got.withColumn("payload", F.when(self.same(), F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("chunk missing or damaged: "), F.col("id")))))
        if self.cache:
            self.cache.add(checked)
        return seeds.assembled(parts.unionByName(rest.join(checked, "id").select(*parts.columns)), "name")

    def cat(self, name: str, offset: int = 0, length: int = 0) -> bytes:
        """Bytes of a blob from offset on (length 0: to the end); only the chunks that hold them are fetched."""
        idx = self.index(name)
        end = idx.agg(F.max(F.col("start") + F.col("size"))).first()[0] or 0
        if offset > end:
            raise EOFError(f"{name} has {end} bytes")
        wanted = self.spark.createDataFrame([(name, offset, length)], "name string, begin long, length long")
        need = ranges.overlapping(idx, wanted, "name").select("name", "pos", "id", "start", "size")
        got = ranges.cat(need.join(self.fetched(need).select("id", "payload"), "id"), wanted, "name").first()
        return bytes(got.data) if got else b""

    def list_chunks(self, name: str) -> list[str]:
        return [r.id for r in self.index(name).orderBy("pos").select("id").toLocalIterator()]

    def info(self, *names: str, seed: str | None = None) -> DataFrame:
        idx = self.index(*names)
        of = self.index(seed).select("id").distinct() if seed else None
        seeded = idx.select("name", "id").distinct().join(of, "id") if of is not None else None
        held = self.stores[0].rows().select("id")
        for s in self.stores[1:]:
            held = held.union(s.rows().select("id"))
        return info.info(idx, "name", seeded, self.cache.rows() if self.cache else None, held)

    def inspect_chunks(self, *names: str) -> DataFrame:
        return info.inspected(self.index(*names), self.stores[0].rows())

    def copy_to(self, target: Store, *names: str, ignore: DataFrame | None = None) -> None:
        """cache: what these indexes need and the target lacks, from the stores; a chunk that none has raises."""
        ids = stores.lacks(stores.without(self.index(*names).select("id").distinct(), *([ignore] if ignore is not None else [])), target.rows())
        got = self.fetched(ids)
        target.add(got.withColumn("payload", F.when(F.col("payload").isNotNull(), F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("chunk missing: "), F.col("id"))))))

    def prune(self, *names: str) -> DataFrame:
        """Drop what no index (of these names, or any) needs."""
        return self.stores[0].prune(self.index(*names))

    def verify_index(self, blobs: DataFrame, name: str) -> bool:
        """Whether a blob is what its index says: length and every chunk."""
        idx, own = self.index(name), blobs.where(F.col("name") == name)
        size = own.select(F.octet_length("data")).first()
        end = idx.agg(F.max(F.col("start") + F.col("size"))).first()[0] or 0
        return bool(size) and size[0] == end and index.invalid_chunks(idx, own, "name", self.sizes.digest).isEmpty()

    def tar(self, nodes: DataFrame) -> DataFrame:
        """Pack trees (name, then the columns of a node) into archives, chunked and stored like any blob."""
        return self.make(archive.archives(nodes, "name"))

    def untar(self, *names: str) -> DataFrame:
        """The nodes of stored archives."""

        return archive.unpacked(self.extract(*names), "name")


def mtree(nodes: DataFrame) -> DataFrame:
    """file, path and line of the manifest of archives' nodes (as `Engine.untar` gives them)."""
    kinds = F.when(F.col("kind") != "device", F.col("kind")).when(F.col("mode").bitwiseAND(0o170000) == 0o020000, "char").otherwise("block")
    named = nodes.withColumn("kind", kinds)
    return named.select("file", "path", archive.mtree_lines(named).alias("line"))


__all__ = ["Engine", "Node", "Store", "mtree"]
