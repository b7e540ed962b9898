"""Session helpers: table access, materialisation in the cluster's shared folder, size checks."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Rows up to which a side may be broadcast; every use counts the side first and has another way beyond it.
BROADCAST_ROWS = 200_000


def ship(spark: SparkSession) -> None:
    """Give this package to the Python workers of the session, once; Spark copies it to every executor."""
    context = spark.sparkContext
    if getattr(context, "_quarrylight_shipped", False):
        return
    package = Path(__file__).parent
    path = os.path.join(tempfile.mkdtemp(prefix="quarrylight"), "quarrylight.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    context.addPyFile(path)
    context._quarrylight_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data directory."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or in local mode a temporary one where it is unset.

    On a cluster a machine's own folder would not do, so there the setting is required.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + os.path.join(tempfile.gettempdir(), "quarrylight-shared")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def materialise(df: DataFrame, hint: str = "t", by: str | None = None) -> DataFrame:
    """Write df as a table in the shared folder and read it back: the lineage is cut and survives lost executors.

    With ``by`` the table is split by that column, so that a filter on it reads its part alone. The folder is removed
    when the driver's Python ends, or by ``release``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quarrylight/{hint}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    atexit.register(_remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quarrylight_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Remove materialised tables that nothing reads any more, such as an iteration's earlier rounds."""
    for t in tables:
        path = getattr(t, "_quarrylight_path", None)
        if path:
            _remove(t.sparkSession, path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the JVM is gone already
        pass


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)
