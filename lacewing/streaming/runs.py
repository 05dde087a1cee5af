"""Resumable runs: a manifest with a fingerprint, phases, and records of each phase.

All files go through Spark's file systems, so a run's folder can be any that driver
and executors share.  A record is JSON with a key; of one key the last written counts.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class FingerprintMismatch(RuntimeError):
    """The folder holds a run of another fingerprint."""


class Run:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.manifest: dict = {}

    def _fs(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _read(self) -> dict | None:
        fs, path = self._fs("manifest.json")
        if not fs.exists(path):
            return None
        return json.loads("\n".join(r.value for r in self.spark.read.text(str(path)).collect()))

    def _save(self) -> None:
        """Written beside the manifest and then put in its place, so a lost driver leaves the old or the new one."""
        fs, path = self._fs("manifest.json")
        _, fresh = self._fs("manifest.json.new")
        out = fs.create(fresh, True)
        out.write(bytearray(json.dumps(self.manifest, sort_keys=True).encode()))
        out.close()
        fs.delete(path, False)
        fs.rename(fresh, path)

    def prepare(self, fingerprint: dict, resume: bool = True) -> bool:
        """Whether an earlier run goes on; another fingerprint is refused, without ``resume`` all is begun anew."""
        old = self._read()
        if old and resume:
            if old["fingerprint"] != fingerprint:
                raise FingerprintMismatch("the folder holds a run of another fingerprint; take another folder or begin anew")
            self.manifest = old
            return True
        fs, path = self._fs("")
        fs.delete(path, True)
        self.manifest = {"version": 1, "fingerprint": fingerprint, "phases": {}}
        self._save()
        return False

    def mark(self, phase: str, status: str, count: int = 0, skipped: int = 0) -> None:
        self.manifest["phases"][phase] = {"status": status, "count": count, "skipped": skipped}
        self._save()

    def done(self, phase: str) -> bool:
        return self.manifest["phases"].get(phase, {}).get("status") == "done"

    def append(self, phase: str, rows: DataFrame, key: str) -> None:
        at = time.time_ns()
        rows.select(F.col(key).cast("string").alias("key"), F.lit(at).alias("at"), F.to_json(F.struct(*sorted(rows.columns))).alias("record")).write.mode("append").parquet(f"{self.folder}/{phase}")

    def records(self, phase: str, valid: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
        """(key, record), the last of each key, of those that ``valid`` lets through."""
        fs, path = self._fs(phase)
        if not fs.exists(path):
            return self.spark.createDataFrame([], "key string, record string")
        rows = self.spark.read.parquet(str(path))
        rows = valid(rows) if valid else rows
        return rows.groupBy("key").agg(F.max_by("record", "at").alias("record"))

    def pending(self, phase: str, rows: DataFrame, key: str) -> DataFrame:
        """The rows without a record in the phase."""
        return rows.join(self.records(phase).select(F.col("key").alias("_k")), F.col(key).cast("string") == F.col("_k"), "left_anti")
