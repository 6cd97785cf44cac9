"""Tables of versions in a shared folder, suites and reports as JSON.

A version is a Parquet folder; the manifest names the one that counts and is written last, so a write that breaks off
leaves the table as it was. Readers pin the version they opened.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SUITE = "id string, query string, intent string, must_cite array<string>, should_cite array<string>, forbidden array<string>, contains array<string>, max_latency_s double, tags array<string>"


class VersionedTable:
    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _fs(self, path: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def versions(self) -> list[str]:
        """Names of finished versions, oldest first."""
        fs, p = self._fs(f"{self.folder}/manifest")
        if not fs.exists(p):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return [json.loads(self._read(f"{self.folder}/manifest/{n}"))["version"] for n in sorted(n for n in names if n.endswith(".json"))]

    def _read(self, path: str) -> str:
        fs, p = self._fs(path)
        stream = fs.open(p)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def read(self, version: str | None = None) -> DataFrame | None:
        """A version, the last one by default; None if there is none."""
        known = self.versions()
        if version is None and not known or version is not None and version not in known:
            return None
        return self.spark.read.parquet(f"{self.folder}/data/{version or known[-1]}")

    def write(self, df: DataFrame, label: str = "") -> str:
        """Writes a new version and then its manifest."""
        n = len(self.versions())
        version = f"{n:06d}-{label or 'v'}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(f"{self.folder}/data/{version}")
        fs, p = self._fs(f"{self.folder}/manifest/{n:06d}.json")
        out = fs.create(p, False)
        try:
            out.write(bytearray(json.dumps({"version": version}).encode()))
        finally:
            out.close()
        return version


def read_suite(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation cases from JSON (lines or one array), typed, with empty lists for what is left out."""
    df = spark.read.schema(SUITE).option("multiLine", "true").json(path)
    lists = ("must_cite", "should_cite", "forbidden", "contains", "tags")
    return df.select(*[F.coalesce(c, F.array().cast("array<string>")).alias(c) if c in lists else F.col(c) for c in df.columns])


def write_report(cases: DataFrame, path: str) -> None:
    cases.write.mode("overwrite").json(path)


def discover(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """Files under a folder with path, size and time; contents are read only where they are selected."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder).select(F.col("path").alias("file"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), "content")
