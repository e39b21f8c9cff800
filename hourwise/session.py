"""Session construction and cluster-shared locations."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

# Only for sessions that this library starts itself (tests, bench); a cluster's own settings always stay.
LOCAL_CONF = {
    "spark.ui.enabled": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.shuffle.partitions": "8",
}


def get_session(master: str | None = None, app_name: str = "hourwise", conf: dict | None = None) -> SparkSession:
    """The active session as it is, or a new one. Nothing is set on an existing session but ``conf``; a new
    local one (``master``) gets ``LOCAL_CONF`` as well."""
    spark = SparkSession.getActiveSession()
    if spark is None:
        builder = SparkSession.builder.appName(app_name)
        if master:
            builder = builder.master(master)
        for k, v in {**(LOCAL_CONF if master and master.startswith("local") else {}), **(conf or {})}.items():
            builder = builder.config(k, v)
        spark = builder.getOrCreate()
        spark.sparkContext.setLogLevel("ERROR")
    else:
        for k, v in (conf or {}).items():
            spark.conf.set(k, v)
    ship_package(spark)
    return spark


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``hourwise`` importable in the Python workers (pandas functions are pickled by reference).

    The package is zipped once per SparkContext on the driver and added with ``addPyFile`` - the
    ``--py-files`` mechanism: Spark distributes the archive to every executor itself.
    """
    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg)
    fd, path = tempfile.mkstemp(prefix="hourwise-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as zf:
        for dirpath, dirnames, filenames in os.walk(pkg):
            dirnames[:] = [d for d in dirnames if d != "__pycache__"]
            for f in filenames:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    zf.write(full, os.path.relpath(full, root))
    sc.addPyFile(path)
    _SHIPPED.add(key)


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors share: ``spark.checkpoint.dir``, else the session's checkpoint
    folder, else the warehouse. A machine-local folder is taken only where the whole session is one process."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if sc.master.startswith("local") and not sc.master.startswith("local-cluster"):
        return os.path.join(tempfile.gettempdir(), "hourwise-shared")
    warehouse = spark.conf.get("spark.sql.warehouse.dir", None)
    if not warehouse:
        raise ValueError("name a shared folder in spark.checkpoint.dir")
    return warehouse.rstrip("/")


def scratch_path(spark: SparkSession, name: str, suffix: str = "") -> str:
    """A new path in the shared folder; Spark's file system removes it when the driver ends."""
    path = f"{shared_dir(spark)}/hourwise/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}{suffix}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def cut_lineage(df: DataFrame, name: str = "step") -> DataFrame:
    """``df`` written once as Parquet to the shared folder and read again: later jobs start there, readers still
    prune columns, and a lost executor costs only its running tasks."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
