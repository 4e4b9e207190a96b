"""Session set-up and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def build_session(app: str = "plumbline", cores: str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and the bench. On a cluster the caller supplies the session."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _root(spark: SparkSession) -> str:
    """This application's folder below the cluster's shared checkpoint folder.

    ``spark.checkpoint.dir`` names it on a cluster. Only where that is unset and the master is
    local (tests, bench) a temporary folder stands in; a machine-local folder is refused elsewhere.
    """
    root = spark.conf.get(CHECKPOINT_CONF, None)
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder every executor can reach")
        root = tempfile.mkdtemp(prefix="plumbline-")
        spark.conf.set(CHECKPOINT_CONF, root)
    return f"{root.rstrip('/')}/plumbline-{spark.sparkContext.applicationId}"


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder below the application's shared folder."""
    return f"{_root(spark)}/{purpose}-{uuid.uuid4().hex}"


def release(spark: SparkSession) -> None:
    """Delete every stage that this application has written; no frame built so far may be read afterwards."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_root(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame, purpose: str = "stage") -> DataFrame:
    """Write an often reused intermediate to the shared folder and read it back.

    Downstream plans start at that table, and a lost executor rereads it instead of recomputing.
    ``release`` deletes all of them.
    """
    path = shared_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
