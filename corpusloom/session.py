"""Session settings and the shared working folder."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A single-process session for tests and the bench; on a cluster the caller brings its own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("corpusloom")
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = (
        builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, as named by ``spark.checkpoint.dir``.

    Only where the session names none and runs in one process (tests, bench) a temporary folder is
    made and removed again when the process ends; a cluster without the setting raises.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    held = spark.sparkContext.getCheckpointDir()
    if held:
        return held.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="corpusloom-")
    atexit.register(shutil.rmtree, own, True)
    spark.sparkContext.setCheckpointDir(f"file://{own}")
    return spark.sparkContext.getCheckpointDir().rstrip("/")


#: Tables that this process wrote
_WRITTEN: list[str] = []


def working_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which sweep() deletes."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


def sweep(spark: SparkSession) -> int:
    """Deletes what settle and working_path left, for use when no result of it is needed any more; gives the number of tables."""
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    done = 0
    while _WRITTEN:
        path = spark._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        done += bool(path.getFileSystem(hadoop).delete(path, True))
    return done


def settle(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` once as a columnar table in the shared folder and read it back.

    It cuts the lineage like ``checkpoint()`` does, so a lost executor costs no recomputation of
    what came before, and later steps read only the columns they need. The table is deleted by sweep(), or when the
    application ends.
    """
    spark = df.sparkSession
    path = working_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    written = spark._jvm.org.apache.hadoop.fs.Path(path)
    written.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(written)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_small(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """A written table of a few numbers a row, marked to be broadcast if it has at most ``rows`` rows; a larger one is
    joined as Spark sees fit."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
