"""Session helpers shared by every operator: sessions, lineage cuts, sized broadcasts."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest estimated size, in bytes, of a side that may be broadcast. Beyond it the join shuffles.
BROADCAST_LIMIT = 8 << 20


def local_session(cpus: int | str = 8, partitions: int = 8, app: str = "lodestrand") -> SparkSession:
    """A local session for tests and the bench."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("LODESTRAND_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )


def _is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.split("[")[0] == "local"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or a temporary one where it is unset and all is one machine.

    On a cluster without that setting this raises: a folder of the driver's machine is not what executors would see.
    """
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if conf:
        return conf
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isEmpty():
        if not _is_local(spark):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lodestrand-"))
        _removed_at_end(spark, os.path.dirname(jsc.getCheckpointDir().get().removeprefix("file:")))
    return jsc.getCheckpointDir().get()


def _removed_at_end(spark: SparkSession, path: str) -> None:
    """Have the file system remove a folder when the application ends."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(at)


def tables_dir(spark: SparkSession) -> str:
    """The application's own folder for intermediate tables, removed when it ends."""
    path = f"{shared_dir(spark)}/tables/{spark.sparkContext.applicationId}"
    if path not in _TABLE_DIRS:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).mkdirs(at)
        _removed_at_end(spark, path)
        _TABLE_DIRS.add(path)
    return path


_TABLE_DIRS: set[str] = set()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise through a reliable checkpoint, so that a lost executor does not replay the plan."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back: columnar, compressed, re-readable."""
    path = f"{tables_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, name: str) -> DataFrame:
    """``df``, stored, with consecutive numbers from 0 in its order; only one count a partition reaches the driver."""
    kept = stored(df.withColumn(name, F.monotonically_increasing_id()))
    part = F.shiftright(name, 33)
    sizes = sorted((r[0], r[1]) for r in kept.groupBy(part.alias("p")).count().collect())
    before, rows = 0, []
    for p, n in sizes:
        rows.append((p, before))
        before += n
    starts = df.sparkSession.createDataFrame(rows, "_part long, _before long")
    joined = kept.withColumn("_part", part).join(F.broadcast(starts) if len(rows) < 100_000 else starts, "_part")
    return joined.withColumn(name, F.col("_before") + F.col(name).bitwiseAND(F.lit((1 << 33) - 1))).drop("_part", "_before")


def planned_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of the size of ``df``, without running it."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def small_side(df: DataFrame, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """``df`` with a broadcast hint if its estimated size is within ``limit``, else unchanged (the join then shuffles)."""
    return F.broadcast(df) if planned_bytes(df) <= limit else df
