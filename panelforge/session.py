"""Session builder with the settings the engine expects."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "panelforge", master: str | None = None, **conf: str) -> SparkSession:
    """UTC times and adaptive execution with skew handling; ``conf`` overrides."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
    }
    for k, v in (base | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()


#: The folder of a local session that names none.
_local_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Where it is unset, a local session gets a temporary folder that is removed at exit; on a
    cluster that is an error, as no folder is known to be shared.
    """
    global _local_dir
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if _local_dir is None:
        _local_dir = tempfile.mkdtemp(prefix="panelforge-")
        atexit.register(shutil.rmtree, _local_dir, ignore_errors=True)
    return _local_dir


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back.

    A long chain of steps is planned and, after a lost executor, repeated from there only; the
    files outlive any executor and are deleted when the application's file system closes.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/panelforge-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)
