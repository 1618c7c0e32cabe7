"""Session helpers: the checkpoint folder all executors share, and cutting lineage in it."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int = 8, memory: str = "8g", partitions: int | None = None) -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tilmoch")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions or cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset (tests), a temporary one is set."""
    here = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if here:
        return here
    own = spark.sparkContext.getCheckpointDir()
    if own is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        own = os.path.join(tempfile.gettempdir(), f"tilmoch-checkpoint-{os.getpid()}")
        spark.sparkContext.setCheckpointDir(own)
    return own


def shared_table(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write df as compressed Parquet in the shared folder and read it back: lineage is cut and survives lost executors."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._shared_path = path
    return out


def drop_shared(table: DataFrame) -> None:
    """Delete what ``shared_table`` wrote for this very table, once nothing reads it any more."""
    path = getattr(table, "_shared_path", None)
    if path is None:
        raise ValueError("not a shared table")
    jvm = table.sparkSession.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the workers where they cannot import it by path: once per application, before the first query."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    sc = spark.sparkContext
    by_path = root in os.environ.get("PYTHONPATH", "").split(os.pathsep) or (sc.master.startswith("local[") and os.getcwd() == root)
    if by_path or getattr(sc, "_tilmoch_shipped", False):
        return
    target = os.path.join(tempfile.mkdtemp(prefix="tilmoch-"), "tilmoch.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(os.path.join(root, "tilmoch")):
            for n in sorted(names):
                if n.endswith(".py"):
                    z.write(os.path.join(folder, n), os.path.relpath(os.path.join(folder, n), root))
    sc.addPyFile(target)
    sc._tilmoch_shipped = True
