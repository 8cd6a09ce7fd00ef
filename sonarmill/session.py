"""Session construction and the shared scratch folder.

Every table that one Spark job writes and a later one reads goes below the
folder named in ``spark.checkpoint.dir``; a folder of our own is used only
where that setting is absent (tests, a laptop).
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

_LOCAL_SCRATCH: list[str] = []
_CUT: dict[int, tuple[weakref.ref, str]] = {}


def build_session(app: str = "sonarmill", cpus: int | None = None, **conf: str) -> SparkSession:
    """A local session for tests and the benchmark; on a cluster use the one you are given."""
    n = cpus or os.cpu_count() or 1
    builder = (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see.

    It is read from the session; a temporary one is made, and set, only where
    the session names none and all of it runs on this machine. On a cluster
    a folder of one machine would be wrong, so there the setting is needed.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors see")
        if not _LOCAL_SCRATCH:
            _LOCAL_SCRATCH.append(tempfile.mkdtemp(prefix="sonarmill-"))
        named = f"file://{_LOCAL_SCRATCH[0]}"
        spark.conf.set("spark.checkpoint.dir", named)
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


BATCH_ROWS = 1000


def bounded_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Lets Arrow batches hold at most ``rows`` rows from now on: whole texts go through Python, and a
    batch is held several times over. A lower setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if not 0 < now <= rows:
        spark.conf.set(key, str(rows))


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that nothing has used, removed at exit."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    atexit.register(remove_path, spark, path)
    return path


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a path through Hadoop's file system, whatever its scheme."""
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session may be gone at exit
        return


def cut(df: DataFrame, label: str = "cut") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here.

    An executor lost later costs no recomputation, and the reread table has
    true sizes for the planner.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _CUT[id(out)] = (weakref.ref(out), path)
    return out


def free(*tables: DataFrame) -> None:
    """Delete tables made by ``cut``; only for those that nothing will read again."""
    for df in tables:
        made, path = _CUT.pop(id(df), (None, None))
        if made is not None and made() is df:
            remove_path(df.sparkSession, path)
