"""Tables written once to the folder every executor can reach.

Iterative and multi-pass operators cut their lineage by writing a Parquet
table below ``spark.checkpoint.dir`` and reading it again, so that a lost
executor costs a re-read and never a wrong or missing part.
"""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import DataType, StructField, StructType

_RUN = uuid.uuid4().hex[:12]
_LOCAL: dict[str, str] = {}
_USED: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The run's own folder below ``spark.checkpoint.dir``.

    Only a local session that names no folder (tests) gets one of its own, and the
    setting filled in with it; on a cluster the setting is required, as no executor
    could read another machine's temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or _LOCAL.get("dir")
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = _LOCAL["dir"] = "file://" + tempfile.mkdtemp(prefix="pagequarry-")
        spark.sparkContext.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/pagequarry-{_RUN}"
    if path not in _USED:
        _USED.add(path)
        atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    from pyspark.errors import PySparkException
    from py4j.protocol import Py4JError

    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except (PySparkException, Py4JError, AttributeError, OSError):
        pass  # the session is already gone; the folder belongs to the cluster


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex[:12]}"


def stash(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and return it reread."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def added(schema: StructType, **columns: DataType) -> StructType:
    """A schema with further columns; the given one stays as it is."""
    return StructType([*schema.fields, *(StructField(n, t) for n, t in columns.items())])


def local_files(url: str) -> tuple[object, str]:
    """(pyarrow filesystem, path) of a shared-folder URL, usable on executors."""
    import pyarrow.fs as pafs

    return pafs.FileSystem.from_uri(url if "://" in url or url.startswith("file:") else f"file://{os.path.abspath(url)}")


#: Most bytes of input (as stored) to a part of a packed shuffle, which one task reads at a time.
PART_BYTES = 64 << 20


def stored_bytes(df: DataFrame) -> int:
    """What the tables below ``df`` take on disk, by Spark's own statistics; tables of unknown size count as nothing."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(x for x in sizes if x < 1 << 60)


def partitions(df: DataFrame, nbytes: int | None = None) -> int:
    """Number of parts for a packed shuffle: the session's setting for shuffles, and more where a part would hold over PART_BYTES."""
    least = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return max(least, -(-(stored_bytes(df) if nbytes is None else nbytes) // PART_BYTES))


#: Most rows of ids (8 to 40 bytes each) that may be broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 1_000_000


def ids_for_join(ids: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``ids`` (a stashed table) with a broadcast hint if its counted rows are few enough; fewer for wider rows."""
    from pyspark.sql import functions as F

    return F.broadcast(ids) if ids.count() <= most else ids
