"""Session, table and lineage helpers that every operator shares."""

from __future__ import annotations

import atexit
import io
import os
import tempfile
import uuid
import weakref
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_WRITTEN: list[tuple[SparkSession, str]] = []
_SHIPPED: weakref.WeakSet = weakref.WeakSet()


def session(app: str = "pagestrata", cores: int | str = "*", partitions: int | None = None) -> SparkSession:
    """A local session with the settings the engine expects; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table: one parquet file or a folder of parts."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A small input that lies in fewer parts than there are cores, spread over them; any other as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() * 2 <= cores else df


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir. Only a local session without the setting, as in tests, gets a
    temporary folder; a cluster without it is an error, as its executors would write to disks of their own."""
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="pagestrata-checkpoint-")
    sc.setCheckpointDir(configured)
    return sc._jsc.sc().getCheckpointDir().get()


def ship(spark: SparkSession) -> None:
    """Give the workers this package, once a context, so that Python stages run wherever the driver was started from."""
    sc = spark.sparkContext
    if sc in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as archive:
        for folder, _, files in os.walk(root):
            for name in sorted(files):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    archive.write(path, os.path.relpath(path, os.path.dirname(root)))
    target = sc._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark).rstrip('/')}/pagestrata-{uuid.uuid4().hex}.zip")
    out = target.getFileSystem(sc._jsc.hadoopConfiguration()).create(target)
    out.write(packed.getvalue())
    out.close()
    sc.addPyFile(target.toString())
    _SHIPPED.add(sc)
    _WRITTEN.append((spark, target.toString()))


def _forget() -> None:
    for spark, path in _WRITTEN:
        try:
            jvm = spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # noqa: BLE001 - the session may be gone at exit
            pass


atexit.register(_forget)


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df as a table in the shared folder and read it back.

    Unlike a cached or locally checkpointed frame the copy outlives any executor, and unlike
    checkpoint() it is columnar, so that later stages read only the columns they need.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _WRITTEN.append((spark, path))
    copy = spark.read.schema(df.schema).parquet(path)
    copy._pagestrata_path = path
    return copy


def free(copy: DataFrame) -> None:
    """Delete what written() stored, once nothing reads it any more."""
    path = copy._pagestrata_path
    spark = copy.sparkSession
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    _WRITTEN.remove((spark, path))


def one_delivery(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Each key once; redelivered rows are equal in the chosen columns, so any of them will do. Null keys are dropped."""
    return df.select(key, *[c for c in columns if c != key]).where(F.col(key).isNotNull()).dropDuplicates([key])


