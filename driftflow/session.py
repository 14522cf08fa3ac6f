"""Session set-up and the two places where the library touches cluster state."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Size up to which a helper table is sent to every task.
SMALL_TABLE_MB = 32


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "driftflow",
                  **conf: str) -> SparkSession:
    """Session for tests and benches; on a cluster the caller brings their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        # Sorting costs far more than starting a local task, so keep small partitions apart.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
    )
    for name, value in conf.items():
        builder = builder.config(name, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors see, as named by ``spark.checkpoint.dir``.

    A machine-local folder is made only for a local master with nothing configured.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        named = tempfile.mkdtemp(prefix="driftflow-")
        context.setCheckpointDir(named)
    return named


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has been written to yet."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str, rows_per_file: int = 0) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so that later uses do not
    recompute it and a lost executor costs no upstream work. Rows of megabytes go to files
    of ``rows_per_file``, since the writer and the readers of a file hold many rows at once."""
    path = fresh_path(df.sparkSession, name)
    (df.write.option("maxRecordsPerFile", rows_per_file) if rows_per_file else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows out to all cores if they come in fewer parts than there are, as from one file that can't be
    split. A table of more parts is left as it is, and so is one that a shuffle deals out anyway; looking runs
    no job."""
    plan = df._jdf.queryExecution()
    if plan.executedPlan().nodeName().startswith("AdaptiveSparkPlan"):
        return df
    wanted = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(wanted) if plan.toRdd().getNumPartitions() < wanted else df


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table that :func:`fresh_path` named, once nothing reads it any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def local_table(spark: SparkSession, rows: Iterable[tuple], schema: pa.Schema) -> DataFrame:
    """A few driver-side rows as a table that is part of the plan itself."""
    columns = list(zip(*rows)) or [[] for _ in schema]
    arrays = [pa.array(values, field.type) for values, field in zip(columns, schema)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, schema=schema))


def small_table(df: DataFrame, limit_mb: int = SMALL_TABLE_MB) -> DataFrame:
    """Run ``df`` once and, if its rows take at most ``limit_mb``, return it as a broadcast table.

    A bigger table is written and comes back without a hint: its joins shuffle, and AQE
    splits skewed partitions. Only rows up to the limit are ever brought to the driver.
    """
    width = max(1, len(df.schema)) * 16
    most = (limit_mb << 20) // width
    rows = df.limit(most + 1).toArrow()
    if rows.num_rows > most or rows.nbytes > limit_mb << 20:
        return settle(df, "helper")
    return F.broadcast(df.sparkSession.createDataFrame(rows, schema=df.schema))
