"""Versioned tables: immutable Parquet parts and a log of snapshots, for stores that are read while they change.

A commit writes its parts first and then one small log entry that names all parts of the new version; the entry appears by a
rename. A reader takes a version and sees that version's parts whatever is committed later; a writer that stops half-way leaves
parts that no version names. Two writers that start from one version can't both commit: the later one gets ``Conflict``.

Rows carry ``seq``, the version that wrote them, so that a delete can stand for "all rows written before it".
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructType


class Conflict(Exception):
    """Another writer has committed the version that this one was about to."""


@dataclass(frozen=True)
class Snapshot:
    """Of one version: table name to schema (JSON) and parts, and facts that the writer keeps."""

    version: int = -1
    schemas: dict[str, str] = field(default_factory=dict)
    parts: dict[str, list[str]] = field(default_factory=dict)
    facts: dict = field(default_factory=dict)
    staged: bool = False


class Versions:
    """Tables below one root folder of any file system that Spark writes to."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._hadoop.Path(name)

    def versions(self) -> list[int]:
        folder = self._path(f"{self.root}/log")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("_"))

    def snapshot(self, version: int | None = None) -> Snapshot:
        """A version, or the latest one; before the first commit it is empty."""
        known = self.versions()
        if version is None and not known:
            return Snapshot()
        number = known[-1] if version is None else version
        if number not in known:
            raise ValueError(f"no version {number} in {self.root}")
        stream = self._fs.open(self._path(f"{self.root}/log/{number:012d}.json"))
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return Snapshot(**json.loads(text))

    def read(self, name: str, at: Snapshot | None = None) -> DataFrame | None:
        """A table of a snapshot, with seq; None if it has no such table."""
        at = at or self.snapshot()
        if name not in at.schemas:
            return None
        schema = StructType.fromJson(json.loads(at.schemas[name]))
        if not at.parts[name]:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.root}/{name}").parquet(*[f"{self.root}/{name}/part={p}" for p in at.parts[name]]).drop("part")

    def stage(self, writes: dict[str, DataFrame], base: Snapshot, replace: tuple[str, ...] = (), facts: dict | None = None, partition_by: dict[str, str] | None = None) -> Snapshot:
        """Writes parts for the version after base, or for base itself if that is staged; nobody sees them before publish().

        Tables in replace lose the parts that base has of them. partition_by names a table's folder column.
        """
        number = base.version if base.staged else base.version + 1
        schemas, parts = dict(base.schemas), {k: list(v) for k, v in base.parts.items()}
        for name in replace:
            parts[name] = []
        for name, df in writes.items():
            own = df if "seq" in df.columns else df.withColumn("seq", F.lit(number).cast("long"))
            part, last = uuid.uuid4().hex, (partition_by or {}).get(name)
            (own.write.partitionBy(last) if last else own.write).parquet(f"{self.root}/{name}/part={part}")
            schemas[name] = StructType(sorted(own.schema, key=lambda f: f.name == last)).json()
            parts.setdefault(name, []).append(part)
        return Snapshot(number, schemas, {k: v for k, v in parts.items() if k in schemas}, {**base.facts, **(facts or {})}, True)

    def publish(self, made: Snapshot) -> Snapshot:
        """The staged version becomes the latest, all of it at once."""
        final = self._path(f"{self.root}/log/{made.version:012d}.json")
        draft = self._path(f"{self.root}/log/_{uuid.uuid4().hex}")
        done = replace(made, staged=False)
        out = self._fs.create(draft, True)
        out.write(bytearray(json.dumps(done.__dict__).encode()))
        out.close()
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            self._fs.delete(draft, False)
            raise Conflict(f"version {made.version} of {self.root} is there already")
        return done

    def commit(self, writes: dict[str, DataFrame], base: Snapshot, replace: tuple[str, ...] = (), facts: dict | None = None, partition_by: dict[str, str] | None = None) -> Snapshot:
        return self.publish(self.stage(writes, base, replace, facts, partition_by))

    def vacuum(self, keep: int = 1) -> int:
        """Deletes all but the latest ``keep`` versions and the parts that none of those names; the number of parts deleted.

        Parts of writers at work are named by no version yet: run it when none is.
        """
        known = self.versions()
        kept = [self.snapshot(v) for v in known[-keep:]]
        for v in known[:-keep]:
            self._fs.delete(self._path(f"{self.root}/log/{v:012d}.json"), False)
        named = {(name, p) for s in kept for name, ps in s.parts.items() for p in ps}
        gone = 0
        for name in {n for s in kept for n in s.schemas}:
            folder = self._path(f"{self.root}/{name}")
            for status in self._fs.listStatus(folder) if self._fs.exists(folder) else []:
                if (name, status.getPath().getName().removeprefix("part=")) not in named:
                    gone += bool(self._fs.delete(status.getPath(), True))
        return gone


class ChunkStore:
    """Chunks (doc_id, chunk_id, ord and any more columns) under versions: append, upsert, delete by document or chunk, compact."""

    def __init__(self, spark: SparkSession, root: str):
        self.log = Versions(spark, root)

    @staticmethod
    def _dealt(rows: DataFrame) -> DataFrame:
        """A document's rows together, in files of the advisory size however many rows a document or the store has."""
        return rows.hint("rebalance", "doc_id").sortWithinPartitions("doc_id", "ord")

    @staticmethod
    def _marks(gone: DataFrame, base: Snapshot) -> DataFrame:
        return gone.withColumn("seq", F.lit(base.version + 1).cast("long"))

    def append(self, rows: DataFrame) -> int:
        return self.log.commit({"rows": self._dealt(rows)}, self.log.snapshot()).version

    def delete_documents(self, ids: DataFrame) -> int:
        """ids (doc_id): all their rows go, in this version and later, until new ones are added."""
        base = self.log.snapshot()
        return self.log.commit({"gone_documents": self._marks(ids.select("doc_id").distinct(), base)}, base).version

    def upsert(self, rows: DataFrame) -> int:
        """Rows replace those of equal chunk_id and are added otherwise."""
        base = self.log.snapshot()
        return self.log.commit({"rows": self._dealt(rows), "gone_chunks": self._marks(rows.select("chunk_id").distinct(), base)}, base).version

    def replace_documents(self, rows: DataFrame, facts: dict | None = None, ids: DataFrame | None = None) -> int:
        """The documents of rows, or those of ids (doc_id), have these rows and no others."""
        base = self.log.snapshot()
        gone = (rows if ids is None else ids).select("doc_id").distinct()
        return self.log.commit({"rows": self._dealt(rows), "gone_documents": self._marks(gone, base)}, base, facts=facts).version

    def add_absent(self, rows: DataFrame) -> int:
        """Rows whose chunk_id is stored already are left out; of rows of equal new chunk_id the first by ord stays."""
        base = self.log.snapshot()
        first = rows.withColumn("__n", F.row_number().over(Window.partitionBy("chunk_id").orderBy("ord"))).where("__n = 1").drop("__n")
        held = self._live(base)
        fresh = first if held is None else first.join(held.select(F.col("chunk_id").alias("__c")), F.col("chunk_id").eqNullSafe(F.col("__c")), "left_anti")
        return self.log.commit({"rows": self._dealt(fresh)}, base).version

    def clear(self) -> int:
        """An empty version; older ones stay readable."""
        base = self.log.snapshot()
        return self.log.commit({}, base, tuple(base.schemas)).version

    def compact(self) -> int:
        """The same rows in one part, without marks of deleted ones."""
        base = self.log.snapshot()
        live = self._live(base)
        if live is None:
            return base.version
        return self.log.commit({"rows": self._dealt(live)}, base, ("rows", "gone_documents", "gone_chunks")).version

    def _live(self, at: Snapshot) -> DataFrame | None:
        rows = self.log.read("rows", at)
        for table, key in (("gone_documents", "doc_id"), ("gone_chunks", "chunk_id")):
            if rows is not None and at.parts.get(table):
                # a version's marks are few beside its rows; Spark sends them to all tasks if their files' size allows it
                gone = self.log.read(table, at).groupBy(F.col(key).alias("__k")).agg(F.max("seq").alias("__s"))
                rows = rows.join(gone, F.col(key).eqNullSafe(F.col("__k")) & (F.col("seq") < F.col("__s")), "left_anti")
        return rows

    def read(self, version: int | None = None) -> DataFrame | None:
        """The rows of a version; None before the first commit."""
        rows = self._live(self.log.snapshot(version))
        return None if rows is None else rows.drop("seq")

    def document(self, doc_id, version: int | None = None) -> DataFrame:
        """A document's rows in order; files are sorted by document, so the filter reads its row groups alone."""
        return self.read(version).where(F.col("doc_id").eqNullSafe(F.lit(doc_id))).orderBy("ord")




def reset(stores: dict[str, ChunkStore]) -> dict[str, str]:
    """Empties several stores by name: an error or an empty text each. One that fails doesn't keep the others, and each reset is one commit."""
    errors = {}
    for name, store in stores.items():
        try:
            store.clear()
            errors[name] = ""
        except Exception as e:  # noqa: BLE001  reported by name
            errors[name] = str(e)
    return errors
