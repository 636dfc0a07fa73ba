"""Session settings and the folder that all executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Most bytes of a batch of rows for Python.
BATCH_BYTES = 8 << 20
#: By this setting Spark deletes the shuffle files of a query as soon as it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "skillgrid") -> SparkSession:
    """A local session with the settings every operator assumes (UTC, ANSI, adaptive execution)."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local session, where one machine is the whole cluster, may do without the setting.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        if found.isDefined():
            base = found.get()
    if base is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def bound_batches(spark: SparkSession) -> None:
    """Let batches that go to Python have no more than ``BATCH_BYTES``; a row that is longer goes alone. By default they may have eight times that, in every worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def materialize(df: DataFrame, name: str, cleanup: bool = False, by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back: lineage is cut, and a lost executor loses nothing.

    With ``by`` it is dealt into folders by these columns, which are its last ones. With ``cleanup`` the shuffle files of the write are deleted at its end, not when the driver's JVM has collected what refers to them.
    """
    spark, path = df.sparkSession, shared_path(df.sparkSession, name)
    bound_batches(spark)
    before = spark.conf.get(CLEANUP, None)
    if cleanup:
        spark.conf.set(CLEANUP, "true")
    try:
        (df.write.partitionBy(*by) if by else df.write).parquet(path)
    finally:
        if cleanup:
            spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    made = spark.read.schema(df.schema).parquet(path)
    made._shared_path = path
    return made


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` for a join that moves both sides by their keys. Left to itself Spark broadcasts what it takes for small: it goes by a table's bytes on disk, which are a tenth of those in memory, and no explode raises the figure."""
    return df.hint("merge")


def drop(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` returned and that nothing will read again."""
    for table in tables:
        discard(table.sparkSession, table._shared_path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table of the shared folder that nothing will read again."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of steps whose results are written: it does so once the driver's JVM has collected what refers to them."""
    gc.collect()
    spark._jvm.System.gc()


def fresh(name: str, taken: list[str]) -> str:
    """``name``, or the first of ``name_1``, ``name_2`` and so on that no column of ``taken`` has."""
    used, n, out = {c.lower() for c in taken}, 0, name
    while out.lower() in used:
        n += 1
        out = f"{name}_{n}"
    return out
