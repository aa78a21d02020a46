"""Session settings and the shared folder in which lineage is cut."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings for a local run; a cluster's own settings stay untouched.
LOCAL = {
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and the benchmark."""
    builder = SparkSession.builder.master(f"local[{cores}]").config("spark.driver.memory", memory)
    for key, value in (LOCAL | {"spark.sql.shuffle.partitions": str(shuffle_partitions)}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; only where none is set, one of our own, and that in local mode only.

    Elsewhere each executor would write to a disk that the others don't see, so the setting is required there.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir", None)
    if not named:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = getattr(context, "_tarnwell_shared", None)
        if named is None:
            made = tempfile.mkdtemp(prefix="tarnwell-")
            atexit.register(shutil.rmtree, made, ignore_errors=True)
            context._tarnwell_shared = named = "file://" + made
    return named.rstrip("/")


def new_table_path(spark: SparkSession, name: str) -> str:
    """A path nobody else uses, in the shared folder; what is left there at the end of the process is removed."""
    path = f"{shared_dir(spark)}/tarnwell/{name}-{uuid.uuid4().hex}"
    _owned.setdefault(spark, set()).add(path)
    return path


#: Session -> the paths of its tables that haven't been dropped.
_owned: dict[SparkSession, set[str]] = {}


def _remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    _owned.get(spark, set()).discard(path)


def drop_tables(spark: SparkSession) -> int:
    """Removes all tables that the operators left for their results to be read from; returns how many.

    To be called when the results of a session's queries have been read or written; at the end of the process it happens
    by itself.
    """
    paths = list(_owned.get(spark, ()))
    for path in paths:
        _remove(spark, path)
    return len(paths)


@atexit.register
def _drop_all() -> None:
    for spark in list(_owned):
        try:
            drop_tables(spark)
        except Exception:  # the session has ended; its storage can't be reached any more
            return


def materialize(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """``df`` written once to the shared folder and read back: its lineage ends there and a lost executor costs nothing."""
    path = new_table_path(df.sparkSession, name)
    writer = df.write.mode("error")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._tarnwell_path = path
    return back


def drop_table(df: DataFrame) -> None:
    """Removes the files of a table made by ``materialize`` that nothing reads any more."""
    path = getattr(df, "_tarnwell_path", None)
    if path is not None:
        _remove(df.sparkSession, path)
        df._tarnwell_path = None
