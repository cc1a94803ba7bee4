"""Documents as a versioned table: append-only data, a log of manifests, reads as of a version.

A commit writes the documents that it changes below ``data`` under a name of its own, then a manifest
``log/<version>.json`` that names them. The manifest appears whole or not at all and only where none is,
so of two writers who want the same version one gets it. The other looks at what was committed since
the version that it had read: if a document of its own is among that, it is told so by ``Conflict``; if
not, it takes the next version. Data that no manifest names is never read.

A read takes, of each document, the row of the last version up to the one asked for, from the last
snapshot on; ``snapshot`` bounds how many commits a read goes through. Deleting a document, deleting
sections, rewriting pairs of sections and undoing a commit are commits like any other.

On a local path the manifest is a hard link, elsewhere a rename of Hadoop's that refuses to overwrite
(atomic on HDFS). Stores without such a rename need one writer at a time.
"""

from __future__ import annotations

import json
import os
import uuid
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import edits as E

MANIFEST = "version bigint, data string, base bigint, kind string, undoes bigint"


class Conflict(RuntimeError):
    """Documents of a commit were changed after the version that it is based on."""

    def __init__(self, documents: list, version: int) -> None:
        super().__init__(f"changed by version {version} or before: {documents}")
        self.documents, self.version = documents, version


class VersionedTable:
    """(key, markdown) by version; ``key`` is the name of a column of any atomic type."""

    def __init__(self, spark: SparkSession, path: str, key: str = "doc_index") -> None:
        self.spark, self.path, self.key = spark, path.rstrip("/"), key

    @classmethod
    def create(cls, docs: DataFrame, path: str, key: str = "doc_index") -> VersionedTable:
        """A new table with docs as version 1."""
        table = cls(docs.sparkSession, path, key)
        table._commit(docs.select(key, "markdown", F.lit(False).alias("deleted")), 0, "load")
        return table

    # The log

    def log(self, until: int | None = None) -> list:
        """Manifests in order, one small row for each commit."""
        try:
            rows = self.spark.read.schema(MANIFEST).json(f"{self.path}/log").collect()
        except Exception as e:  # noqa: BLE001  a table without commits has no folder
            if "PATH_NOT_FOUND" not in str(e):
                raise
            rows = []
        return sorted((r for r in rows if until is None or r["version"] <= until), key=lambda r: r["version"])

    def latest(self) -> int:
        return max((r["version"] for r in self.log()), default=0)

    def _appear(self, version: int, manifest: dict) -> bool:
        """Write a manifest; False if there is one of that version."""
        name, text = f"{self.path}/log/{version:012d}.json", json.dumps(manifest) + "\n"
        hidden = f"{self.path}/log/_{uuid.uuid4().hex}"
        if name.startswith("file:") or "://" not in name:
            local = lambda x: unquote(urlparse(x).path) if x.startswith("file:") else x
            os.makedirs(os.path.dirname(local(name)), exist_ok=True)
            with open(local(hidden), "w", encoding="utf-8") as f:
                f.write(text)
            try:
                os.link(local(hidden), local(name))
            except FileExistsError:
                return False
            finally:
                os.unlink(local(hidden))
            return True
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        at, to = hadoop.Path(hidden), hadoop.Path(name)
        files = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        out = files.create(at, False)
        out.write(bytearray(text.encode()))
        out.close()
        if files.exists(to):
            files.delete(at, False)
            return False
        context = hadoop.FileContext.getFileContext(at.toUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark._jvm.java.lang.reflect.Array.newInstance(self.spark._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)
        try:
            context.rename(at, to, none)
        except Exception as e:  # noqa: BLE001
            files.delete(at, False)
            if "FileAlreadyExists" not in str(e):
                raise
            return False
        return True

    def _commit(self, changes: DataFrame, base: int, kind: str, undoes: int | None = None) -> int:
        """changes: (key, markdown, deleted), one row a document. The new version."""
        data = uuid.uuid4().hex
        changes.select(self.key, F.col("markdown").cast("string").alias("markdown"), "deleted").write.option("compression", "zstd").parquet(f"{self.path}/data/{data}")
        own, checked = self._data([data]), base
        while True:
            log = self.log()
            since = [r for r in log if r["version"] > checked and r["kind"] != "snapshot"]
            if since:
                touched = self._data([r["data"] for r in since]).select(self.key).distinct()
                both = [r[0] for r in own.select(self.key).join(touched, self.key, "left_semi").limit(10).collect()]
                if both:
                    raise Conflict(sorted(both), since[-1]["version"])
            # What comes after this reading of the log has the version that is tried now, or a later one.
            checked = max([checked, *(r["version"] for r in log)])
            if self._appear(checked + 1, {"version": checked + 1, "data": data, "base": base, "kind": kind, "undoes": undoes}):
                return checked + 1

    def _data(self, names: list[str]) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.path}/data/{x}" for x in names])

    # Reading

    def as_of(self, version: int | None = None) -> DataFrame:
        """(key, version, markdown): every document there was, with the version that wrote it."""
        log = self.log(version)
        if not log or (version is not None and log[-1]["version"] != version):
            raise ValueError(f"no version {version}")
        last = max((k for k, r in enumerate(log) if r["kind"] == "snapshot"), default=0)
        log = log[last:]
        of = self.spark.createDataFrame([(r["data"], r["version"]) for r in log], "data string, committed bigint")
        rows = self._data([r["data"] for r in log]).withColumn("data", F.regexp_extract("_metadata.file_path", r"/data/([0-9a-f]{32})/", 1)).join(F.broadcast(of), "data")
        # A snapshot's rows say which version wrote them.
        if log[0]["kind"] == "snapshot":
            kept = self.spark.read.parquet(f"{self.path}/data/{log[0]['data']}-versions").withColumnRenamed("version", "wrote")
            rows = rows.join(kept, self.key, "left").withColumn("committed", F.when(F.col("committed") == log[0]["version"], F.col("wrote")).otherwise(F.col("committed")))
        newest = rows.groupBy(self.key).agg(F.max(F.struct("committed", "deleted", "markdown")).alias("v"))
        return newest.where("not v.deleted").select(self.key, F.col("v.committed").alias("version"), "v.markdown")

    # Writing

    def commit(self, changes: DataFrame, base: int, kind: str = "edit") -> int:
        """changes: (key, markdown) of documents as they are to be, made from the table as of ``base``."""
        return self._commit(changes.select(self.key, "markdown", F.lit(False).alias("deleted")), base, kind)

    def delete(self, keys: DataFrame, base: int) -> int:
        """Documents that are to go; their earlier versions stay readable."""
        return self._commit(keys.select(self.key).distinct().select(self.key, F.lit(None).cast("string").alias("markdown"), F.lit(True).alias("deleted")), base, "delete")

    def undo(self, version: int) -> int:
        """The documents of a commit as they were before it. Conflict if one was changed since."""
        log = {r["version"]: r for r in self.log()}
        if version not in log or log[version]["kind"] in ("load", "snapshot"):
            raise ValueError(f"version {version} can't be undone")
        touched = self._data([log[version]["data"]]).select(self.key)
        before = touched.join(self.as_of(version - 1), self.key, "left")
        return self._commit(before.select(self.key, "markdown", F.col("version").isNull().alias("deleted")), version, "undo", undoes=version)

    def snapshot(self) -> int:
        """A version equal to the latest, from which later reads begin."""
        while True:
            at, data = self.latest(), uuid.uuid4().hex
            now = self.as_of(at)
            now.select(self.key, "markdown", F.lit(False).alias("deleted")).write.option("compression", "zstd").parquet(f"{self.path}/data/{data}")
            now.select(self.key, "version").write.parquet(f"{self.path}/data/{data}-versions")
            if self._appear(at + 1, {"version": at + 1, "data": data, "base": at, "kind": "snapshot", "undoes": None}):
                return at + 1


def delete_sections(table: VersionedTable, sections: DataFrame, base: int | None = None) -> tuple[int | None, DataFrame]:
    """sections: (original_order, doc, part): whole sections to delete, in that order. (version, report):
    the report adds ``state``: done, stale (the section no longer stands in its document), claimed (an
    earlier row deletes it) or missing (no such document). No version if nothing is done."""
    base = table.latest() if base is None else base
    docs = table.as_of(base).select(F.col(table.key).alias("doc"), "markdown")
    first = sections.groupBy("doc", "part").agg(F.min("original_order").alias("first"))
    found = sections.join(first, ["doc", "part"]).join(docs, "doc", "left")
    state = F.when(F.col("markdown").isNull(), "missing").when(F.col("original_order") > F.col("first"), "claimed").when(E.occurs(F.col("markdown"), F.col("part")), "done").otherwise("stale")
    report = found.select("original_order", "doc", "part", state.alias("state"))
    each = report.where("state = 'done'").groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("original_order", "part"))).alias("gone"))
    new = docs.join(each, "doc").select(F.col("doc").alias(table.key), F.aggregate("gone", F.col("markdown"), lambda md, x: E.delete_section(md, x["part"])).alias("markdown"))
    return (None if new.isEmpty() else table.commit(new, base, "delete_sections")), report


def rewrite_pairs(table: VersionedTable, edits: DataFrame, base: int | None = None) -> tuple[int | None, DataFrame]:
    """edits as in ``operators.edits.commit``, whose report is returned with the version; each edit
    changes both sides or none, and all that hold are one commit."""
    base = table.latest() if base is None else base
    docs = table.as_of(base).select(F.col(table.key).alias("doc_index"), "markdown")
    history, report = E.commit(docs, edits)
    new = history.where("version = 1").select(F.col("doc_index").alias(table.key), "markdown")
    return (None if new.isEmpty() else table.commit(new, base, "rewrite")), report
