"""Session helpers: builder for local use and lineage cutting in the shared folder."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


#: Applications that have the package, and folders that are there.
_SHIPPED: set[str] = set()


def build_session(app: str = "lodestone", master: str = "local[8]", partitions: int = 8) -> SparkSession:
    """A session with AQE, UTC and a shuffle width that suits a single node."""
    spark = (
        SparkSession.builder.appName(app)
        .master(master)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    ship(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by the cluster; only where none is set, a local one (tests)."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder all executors share")
        named = os.path.join(tempfile.gettempdir(), "lodestone-checkpoints")
    sc.setCheckpointDir(named)
    return named


def shared_folder(spark: SparkSession) -> str:
    """This application's own folder in the shared one; it goes when the application ends."""
    sc = spark.sparkContext
    at = f"{ensure_checkpoint_dir(spark)}/lodestone-{sc.applicationId}"
    if at not in _SHIPPED:
        path = sc._jvm.org.apache.hadoop.fs.Path(at)
        fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        for own in (path, sc._jvm.org.apache.hadoop.fs.Path(sc.getCheckpointDir())):
            fs.deleteOnExit(own)
        _SHIPPED.add(at)
    return at


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage of ``df`` with a reliable checkpoint in the shared folder; partitions and their order stay."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_table(df: DataFrame) -> DataFrame:
    """The same through a written table, for wide or large rows: compressed, and readers take only the columns they name."""
    at = f"{shared_folder(df.sparkSession)}/t-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame, key: str) -> DataFrame:
    """For CPU-bound stages on inputs with fewer partitions than the cluster can work on: hash-partitions by ``key``.

    Large inputs come in more partitions than a few per core and stay as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    width = max(cores, min(shuffle_width(df.sparkSession), 4 * cores))
    return df.repartition(width, key) if df.rdd.getNumPartitions() < width else df


def ship(spark: SparkSession) -> None:
    """Lets the executors import this package: sends it to them as one archive, once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(here):
            for n in sorted(names):
                if n.endswith(".py"):
                    z.write(os.path.join(folder, n), os.path.relpath(os.path.join(folder, n), os.path.dirname(here)))
    # into the shared folder, from which Spark hands it out to the executors
    at = f"{shared_folder(spark)}/package.zip"
    path = sc._jvm.org.apache.hadoop.fs.Path(at)
    out = path.getFileSystem(sc._jsc.hadoopConfiguration()).create(path, True)
    try:
        out.write(bytearray(buffer.getvalue()))
    finally:
        out.close()
    sc.addPyFile(at)
    _SHIPPED.add(sc.applicationId)
