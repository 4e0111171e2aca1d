"""What every operator shares with its executors: the package itself, and the folder of intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
#: Rows and bytes of one Arrow batch; both bound a Python worker's memory.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def ship(spark: SparkSession | None = None) -> None:
    """Sends the package to the executors, once for each application: their Python workers needn't share the driver's search path.

    Every operator that runs Python on the executors calls it; without a session it is the active one's, and nothing if there is none. It also bounds the
    session's Arrow batches by rows and bytes, unless they have smaller bounds.
    """
    spark = spark or SparkSession.getActiveSession()
    if spark is None:
        return
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = (spark.conf.get(key) or "").lower().removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))
    sc, root = spark.sparkContext, Path(__file__).resolve().parents[1]
    if sc.applicationId in _shipped or not root.is_dir():
        return
    target = Path(tempfile.mkdtemp(prefix="fathomline-")) / f"{root.name}.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(target))
    _shipped.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a local one only where the setting is absent and Spark runs in this machine."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="fathomline-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(base)
    return sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, for this application."""
    return f"{shared_dir(spark)}/tables/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back: later jobs see the same rows, whatever executors are lost.

    Tables lie below <shared>/tables/<application id>; clean() drops them.
    """
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, name: str, by: str) -> DataFrame:
    """As stored(), in buckets of `by`, as many as a shuffle has partitions: joins by that column, however many, don't shuffle these rows again."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    n, table_ = int(spark.conf.get("spark.sql.shuffle.partitions")), f"fathomline_{name}_{uuid.uuid4().hex}"
    df.write.format("parquet").bucketBy(n, by).option("compression", "zstd").option("path", path).saveAsTable(table_)
    return spark.table(table_)


def clean(spark: SparkSession) -> None:
    """Deletes this application's intermediate tables: for a long session between its queries, when no frame that reads them is used any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/tables/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
