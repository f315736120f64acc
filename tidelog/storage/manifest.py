"""Versioned JSON manifests with atomic publication.

Version ``n`` of a manifest is the file ``_manifest/<n>.json``. It is written
under a temporary name and renamed without overwriting, so a reader sees either
the whole new version or the old one, and of two writers of one version only one
succeeds; this asks for a file system whose rename is atomic (HDFS or a local one; not a
plain object store). The file is synced before it is renamed. Data files that no manifest names are orphans of failed runs.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession

from tidelog.storage.workspace import delete, hadoop


class CommitConflict(RuntimeError):
    """Another writer published this version first."""


class ManifestStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.folder = f"{self.path}/_manifest"

    def versions(self) -> list[int]:
        fs, p = hadoop(self.spark, self.folder)
        if not fs.exists(p):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def read(self, version: int | None = None) -> dict | None:
        """The given or newest manifest; None if there is none."""
        if version is None:
            all_versions = self.versions()
            if not all_versions:
                return None
            version = all_versions[-1]
        fs, p = hadoop(self.spark, f"{self.folder}/{version:010d}.json")
        stream = fs.open(p)
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text)

    def commit(self, version: int, content: dict) -> dict:
        """Publish ``content`` as ``version``; raises CommitConflict if it exists."""
        jvm = self.spark._jvm
        fs, final = hadoop(self.spark, f"{self.folder}/{version:010d}.json")
        fs.mkdirs(final.getParent())
        if fs.exists(final):
            raise CommitConflict(f"{final} exists")
        tmp = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{version:010d}.{uuid.uuid4().hex}.tmp")
        body = {**content, "version": version}
        out = fs.create(tmp, False)
        out.write(bytearray(json.dumps(body, sort_keys=True).encode()))
        out.hsync()
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
            final.toUri() if final.toUri().getScheme() else fs.getUri(), self.spark._jsc.hadoopConfiguration()
        )
        none = jvm.org.apache.hadoop.fs.Options.Rename.valueOf("NONE")
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = none
        try:
            context.rename(tmp, final, options)
        except Exception as e:
            fs.delete(tmp, False)
            raise CommitConflict(str(e)) from e
        return body

    def expire(self, retain: int, named: Callable[[dict], set[str]]) -> None:
        """Drop all but the newest ``retain`` versions, oldest first, each with the folders
        that it names and the next version doesn't (a folder once left isn't named again)."""
        versions = self.versions()
        for version, later in zip(versions[:-retain], versions[1:]):
            for folder in named(self.read(version)) - named(self.read(later)):
                delete(self.spark, f"{self.path}/{folder}")
            delete(self.spark, f"{self.folder}/{version:010d}.json")
