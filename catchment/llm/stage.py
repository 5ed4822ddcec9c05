"""Written intermediate tables in the shared folder of ``spark.checkpoint.dir``.

A stage that is read more than once, or whose lineage should end, is written
as Parquet there and read back: it survives the loss of executors, and unlike
an RDD checkpoint it is compressed and column-pruned.  The copies are removed
when the application ends.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..session import ensure_checkpoint_dir

#: Rows of an Arrow batch where the session has Spark's default: whole texts
#: are longer than the rows that default is meant for.
BATCH_ROWS, BATCH_SETTING, BATCH_DEFAULT = 2_000, "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared checkpoint folder, deleted at exit."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def written(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to a fresh stage folder and return it read back (with the
    schema given, so that an empty table keeps its columns)."""
    path = new_path(df.sparkSession, name)
    out = df.write.mode("overwrite")
    if partition_by:
        out = out.partitionBy(*partition_by)
    out.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table of a data folder, read by Spark from wherever it lies."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application, so they
    can import it wherever it is installed on the driver; batches of texts
    get their size."""
    if spark.conf.get(BATCH_SETTING) == BATCH_DEFAULT:
        spark.conf.set(BATCH_SETTING, BATCH_ROWS)
    sc, package = spark.sparkContext, Path(__file__).resolve().parents[1]
    name = f"{package.name}-{sc.applicationId}.zip"
    if name in sc._python_includes:
        return
    path = os.path.join(tempfile.mkdtemp(), name)
    with zipfile.ZipFile(path, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    sc.addPyFile(path)
