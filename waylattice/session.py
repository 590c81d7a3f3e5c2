"""Session set-up, lineage cuts and the few settings every operator relies on."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Directory that holds the package, for workers that do not have it on their path yet.
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def build_session(cpus: int = 8, shuffle_partitions: int = 8, memory: str = "8g", app: str = "waylattice") -> SparkSession:
    """Local session for tests and the bench; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship_package(spark: SparkSession) -> None:
    """Lets Python workers on this file system import the package even if the driver found it by ``sys.path``."""
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
    if ROOT not in have.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, have) if x)


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder.

    Read from ``spark.checkpoint.dir``; a temporary folder is made only in local
    mode, where driver and executor share one machine. On a cluster without the
    setting this raises rather than writing to one machine's disk.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if folder is None:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="waylattice-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


#: Tables that ``cut`` has written, by session, until ``sweep`` removes them.
_WRITTEN: dict[str, list[str]] = {}


def _remove(spark: SparkSession, path: str, at_exit: bool) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if at_exit:
        fs.deleteOnExit(where)
    else:
        fs.delete(where, True)


def cut(df: DataFrame) -> DataFrame:
    """Writes ``df`` once to the shared folder and returns a reader of that table.

    Cuts the lineage so that a lost executor costs a re-read and not a
    recomputation, and evaluates ``df`` exactly once. The table is removed when
    the driver ends, or by ``sweep``.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    df.write.parquet(path)
    _remove(spark, path, at_exit=True)
    return spark.read.schema(df.schema).parquet(path)


def sweep(spark: SparkSession) -> int:
    """Removes the tables that ``cut`` has written so far in this session; results that still read them can't be computed again."""
    paths = _WRITTEN.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        _remove(spark, path, at_exit=False)
    return len(paths)
