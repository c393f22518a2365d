"""Session helpers. The library never creates a session for the caller; these
are for tests, the bench and command-line use."""

from __future__ import annotations

import tempfile
import threading
import uuid
import weakref
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
_OPEN = threading.local()


def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session configured like the tests and the bench expect."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("logsieve")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder, setting it up if needed.

    The cluster names a shared folder in ``spark.checkpoint.dir``; we use it as
    is. Only a local-mode session without that setting (tests, laptops) gets a
    fresh folder under the system temp dir. A cluster session without it is an
    error: a machine-local folder would not survive a lost executor.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None
    )
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; point it at a shared folder "
            "(HDFS/S3/ABFS) before running iterative operators"
        )
    local_dir = tempfile.mkdtemp(prefix="logsieve-ckpt-")
    sc.setCheckpointDir(local_dir)
    return sc.getCheckpointDir() or local_dir


@contextmanager
def shuffles_removed(spark: SparkSession):
    """Shuffle files of what runs inside go when it ends, not whenever the driver happens
    to collect its garbage."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def written(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """``df`` as a Parquet table below the checkpoint folder, read back: it is
    computed once, its lineage is cut, its size is known to the optimizer, and lost
    executors only reread it. Inside ``scratch`` it is deleted at the end, unless kept.
    ``codec``: the compression, if not the session's (zstd for whole texts)."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/written/{name}-{uuid.uuid4().hex}"
    with shuffles_removed(spark):
        df.write.parquet(path, compression=codec)
    table = spark.read.schema(df.schema).parquet(path)
    _PATHS[table] = path
    if open_ := getattr(_OPEN, "scratches", None):
        open_[-1].tables.append(table)
    return table


def dropped(*tables: DataFrame) -> None:
    """Deletes tables that ``written`` gave and that nothing reads any more."""
    for table in tables:
        path = _PATHS.pop(table, None)
        if path is not None:
            sc = table.sparkSession.sparkContext
            hp = sc._jvm.org.apache.hadoop.fs.Path(path)
            hp.getFileSystem(sc._jsc.hadoopConfiguration()).delete(hp, True)


class scratch:
    """``with scratch() as made``: tables written inside are deleted at the end, but for
    those that ``made.keep`` names."""

    def __enter__(self) -> scratch:
        self.tables: list[DataFrame] = []
        if not hasattr(_OPEN, "scratches"):
            _OPEN.scratches = []
        _OPEN.scratches.append(self)
        return self

    def keep(self, table: DataFrame) -> DataFrame:
        """``table`` outlives this scratch (an outer one has it then)."""
        self.tables = [t for t in self.tables if t is not table]
        if len(_OPEN.scratches) > 1:
            _OPEN.scratches[-2].tables.append(table)
        return table

    def __exit__(self, *_) -> None:
        _OPEN.scratches.pop()
        dropped(*self.tables)
