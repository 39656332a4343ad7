"""Session defaults and the shared scratch folder that cuts lineage between stages."""

from __future__ import annotations

import atexit
import sys
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Scratch folder of each application whose session names none, by application id.
_OWN: dict[str, str] = {}
#: Folders written so far and not yet discarded, by path; what is left goes when the interpreter ends.
_WRITTEN: dict[str, SparkSession] = {}
#: Spark's switch that drops an execution's shuffle files when it has ended.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Rows of a task behind a shuffle whose partitions are counted by rows.
TASK_ROWS = 500_000


def get_session(cores: int = 8, name: str = "arcwright", **conf: str) -> SparkSession:
    """A local session with the defaults that tests and the bench use."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


@contextmanager
def settings(spark: SparkSession, conf: dict[str, str]):
    """``conf`` for the plans made inside."""
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def parts_for(spark: SparkSession, rows: int) -> int:
    """Partitions of a shuffle that leave a task some hundred MB, however many the rows are."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    A cluster names it in ``spark.checkpoint.dir``. Only a local master, where driver and
    executors are one process, may fall back to a temporary folder of this machine.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="arcwright-")
    return _OWN[app]


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new path under the shared folder, dropped when the interpreter ends at the latest."""
    path = f"{scratch_root(spark)}/{tag}-{uuid.uuid4().hex}"
    _WRITTEN[path] = spark
    return path


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    The result has no lineage into what made it: a lost executor costs a re-read of Parquet
    files, not a rerun, and an iterative plan does not grow from round to round. The shuffle files
    of the write go with it: nothing reads them again.
    """
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEAN)
        else:
            spark.conf.set(_CLEAN, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(df: DataFrame | None) -> None:
    """Drop the files behind a materialized table that no later plan reads."""
    path = getattr(df, "_scratch", None)
    if path:
        _remove(df.sparkSession, path)
        _WRITTEN.pop(path, None)


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _sweep() -> None:
    for path, spark in list(_WRITTEN.items()):
        if spark.sparkContext._jsc is None:  # the session is already gone; the cluster's own clean-up takes over
            continue
        try:
            _remove(spark, path)
        except Exception as error:  # one folder that will not go must not keep the others
            print(f"{path} stays: {error}", file=sys.stderr)
