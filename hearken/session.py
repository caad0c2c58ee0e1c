"""Session defaults for local work; a cluster's own settings win."""

from __future__ import annotations

import pickle
import tempfile
import uuid
from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
}


def session(master: str = "local[8]", **conf: str) -> SparkSession:
    builder = SparkSession.builder.master(master).appName("hearken")
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


#: Bytes at which a batch of texts that goes to Python ends; by itself Spark counts rows only, 10,000 of any length.
BATCH_KEY, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 1 << 20


def batches_by_bytes(spark: SparkSession) -> None:
    """Arrow batches of the session end at ``BATCH_BYTES`` or at the row after; all rows go on.  The session's own limit wins.

    Spark reads the limit when a query runs, so it stays for frames that are computed later.
    """
    if spark.conf.get(BATCH_KEY, None) is None:
        spark.conf.set(BATCH_KEY, str(BATCH_BYTES))


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only where none is set, as in local tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or None
    if folder is None:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="hearken-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, which goes when the driver ends."""
    path = f"{shared_folder(spark)}/hearken-{name}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(at)
    files.deleteOnExit(at)
    return path


def spread(df: DataFrame) -> DataFrame:
    """A small table in one file would be one task: its rows are dealt out where they are in fewer parts than there are cores.

    A large table has many parts and stays as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def sent_to_workers(spark: SparkSession, value: object) -> Callable[[], object]:
    """Broadcast a value with the classes it is made of, so that workers need no copy of this package; call it once per task."""
    blob = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: pickle.loads(blob.value)
