"""Places that the driver and every executor can reach, and tables written there.

Intermediate tables go below ``spark.checkpoint.dir``.  Where that setting is
unset and the master is local (tests, a laptop) one temporary folder is made for the
application; on a cluster that would be a folder of each machine's own, so it is an error.
"""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_ROOT = str(Path(__file__).resolve().parents[2])
BATCH_BYTES = 1 << 20
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package by name, and bound Arrow batches by their bytes.

    Batches of long texts would else hold 10,000 rows each, in a task's JVM and in its
    worker at once.  A smaller bound set by the caller stays.
    """
    if _size(spark.conf.get(BATCH_SETTING)) > BATCH_BYTES:
        spark.conf.set(BATCH_SETTING, BATCH_BYTES)
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", "").split(os.pathsep)
    if _ROOT not in known:
        env["PYTHONPATH"] = os.pathsep.join([_ROOT, *filter(None, known)])


def _size(setting: str) -> int:
    """Bytes of a setting such as 67108864b or 64m; one without a limit is larger than any."""
    number, unit = re.fullmatch(r"(-?[0-9]+)([bkmgtp]?)b?", setting.strip().lower()).groups()
    size = int(number) << 10 * "bkmgtp".index(unit or "b")
    return size if size > 0 else 1 << 62


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, or one made for this application."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="lacewing-")
    return _OWN[app]


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


class Workspace:
    """Intermediate tables of one query.

    ``cut`` writes a DataFrame and reads it back, which ends its lineage in
    files that survive lost executors.  ``drop`` deletes one table as soon as no
    later step reads it; the rest goes when the application ends.
    """

    def __init__(self, spark: SparkSession, what: str):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/lacewing-{what}-{uuid.uuid4().hex[:12]}"
        atexit.register(self.close)

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def cut(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        df.write.option("compression", codec).mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            _delete(self.spark, self.path(name))

    def close(self) -> None:
        try:
            _delete(self.spark, self.base)
        except Exception:  # noqa: BLE001  the session has gone; nothing is left to do
            pass


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
