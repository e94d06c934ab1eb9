"""Tables written once to the folder that all executors share, to cut lineage."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []
_RUN = uuid.uuid4().hex[:12]
_REGISTERED: set[str] = set()


def stage_path(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``, removed when the driver's Python ends.

    Only a local session may leave the setting out; it gets a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _OWN:
            _OWN.append("file://" + tempfile.mkdtemp(prefix="pagequarry-"))
        base = _OWN[0]
    folder = f"{base.rstrip('/')}/pagequarry-stage-{_RUN}"
    if folder not in _REGISTERED:
        _REGISTERED.add(folder)
        atexit.register(_remove, spark, folder)
    return f"{folder}/{name}-{uuid.uuid4().hex[:12]}"


def _remove(spark: SparkSession, folder: str) -> None:
    try:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except (Py4JError, AttributeError, OSError):
        pass  # the session ended first; the folder is the cluster's to clear


def spread(table: DataFrame) -> DataFrame:
    """A table read from few files, dealt out among the task slots; one with a partition for each slot stays as it is.

    For tables as they are read: one that was shuffled would be computed for the answer.
    """
    slots = table.sparkSession.sparkContext.defaultParallelism
    return table if table.rdd.getNumPartitions() >= slots else table.repartition(slots)


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet and read again."""
    path = stage_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
