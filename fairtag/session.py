"""Session settings the operators are planned for."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime settings: adaptive execution splits hot join keys and merges small
# shuffle partitions, UTC makes timestamps independent of the machine.
# Shuffle files go when the query that wrote them has ended; what later queries
# read is in intermediate tables, not in the shuffles behind them.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    # A field that a payload names twice has its last value, as in other JSON readers.
    "spark.sql.variant.allowDuplicateKeys": "true",
}


def tuned(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def local_session(app: str, cpus: str | int = "*", partitions: int = 8) -> SparkSession:
    """Session for tests and the local bench; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="fairtag-"))
        # Call-site capture costs more than building the expression itself.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(partitions))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return tuned(spark)


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster shares: spark.checkpoint.dir, else the context's own, else one in the (shared) warehouse."""
    return (
        spark.conf.get("spark.checkpoint.dir", None)
        or spark.sparkContext.getCheckpointDir()
        or f"{spark.conf.get('spark.sql.warehouse.dir')}/_scratch"
    )


def scratch(spark: SparkSession) -> str:
    """A fresh folder in the shared one, for stream state and intermediate tables."""
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder, so a lost executor costs no recompute.

    Compressed columns take a fraction of the disk that a checkpoint's rows do, and readers skip the ones they do not ask for.
    """
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """The same rows dealt over the cluster: a file of one row group is read by one task, however long its rows take."""
    spark = df.sparkSession
    # A number that adaptive execution leaves alone: narrow rows can take long, too.
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism))


def _located(spark: SparkSession, path: str):
    """(file system, path) of a folder that any store Spark writes to may hold."""
    context = spark.sparkContext
    where = context._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(context._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    files, where = _located(spark, path)
    return files.exists(where)


def remove(spark: SparkSession, *paths: str) -> None:
    """Remove folders that this library has written and no longer reads."""
    for path in paths:
        files, where = _located(spark, path)
        files.delete(where, True)
