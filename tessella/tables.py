"""Tables that end a lineage, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []  # the folder of local sessions that name none, as in tests
_written: list[str] = []  # tables that cut() has written and discard() has not removed


def scratch(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``; local sessions that name none get a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own:
        _own.append(f"file://{tempfile.mkdtemp(prefix='tessella-')}")
    return _own[0]


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet; :func:`discard` removes what is written there."""
    path = f"{scratch(spark)}/tessella-{name}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def cut(df: DataFrame, name: str = "step", codec: str = "zstd") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends here."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Within it, what a statement has shuffled leaves the executors' disks as soon as the statement ends, not when the driver collects its garbage; for steps that write what is wanted of them."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def discard(spark: SparkSession) -> int:
    """Remove this driver's intermediate tables, once no result that reads them is still wanted; returns how many there were."""
    removed = 0
    while _written:
        path = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
        removed += bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))
    return removed


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def read_or_empty(spark: SparkSession, path: str, schema: str, kind: str, **options) -> DataFrame:
    """Files of a kind with a schema; no rows where nothing has been written yet."""
    try:
        return spark.read.schema(schema).options(**options).format(kind).load(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
