"""Session helpers: where intermediate tables live and how lineage is cut."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CHECKPOINT_KEY = "spark.checkpoint.dir"
_CLEANUP_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, as the cluster names it in spark.checkpoint.dir.

    Only where that setting is absent (tests, local runs) is a temporary folder made.
    """
    named = spark.conf.get(CHECKPOINT_KEY, None)
    if not named:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError(f"set {CHECKPOINT_KEY} to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="lodestone-")
        spark.conf.set(CHECKPOINT_KEY, named)
    return named


def materialise(df: DataFrame, name: str = "table", partition_by: list[str] | None = None) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back.

    The result has no lineage, survives the loss of any executor, and the
    shuffle files of the write are dropped as soon as it ends. The files go
    when the driver ends.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    before = spark.conf.get(_CLEANUP_KEY, None)
    spark.conf.set(_CLEANUP_KEY, "true")
    try:
        writer = df.write.mode("overwrite")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP_KEY)
        else:
            spark.conf.set(_CLEANUP_KEY, before)
    return spark.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that df doesn't have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    return next(x for x in (f"_{stem}{k or ''}" for k in range(len(taken) + 1)) if x.lower() not in taken)


def drop_ids(df: DataFrame, ids: DataFrame, column: str = "doc_id") -> DataFrame:
    """The rows of df, all columns as they are, whose `column` is not among those of the one column of ids; nulls stay.

    ids are hashed to partitions, not broadcast, as they grow with the data.
    """
    name = free_name(df, "gone")
    gone = ids.toDF(name).hint("shuffle_hash")
    return df.join(gone, F.col(f"`{column}`") == F.col(name), "left_anti")


def sized(df: DataFrame, most: int) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """df, and F.broadcast if it has at most `most` rows, else a function that leaves its argument to a shuffled join."""
    few = df.limit(most + 1).count() <= most
    return df, F.broadcast if few else lambda x: x


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there goes when the driver ends."""
    path = f"{shared_folder(spark)}/lodestone-{name}-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def number_rows(df: DataFrame, by: list[str], name: str) -> DataFrame:
    """df with the column `name`: 0, 1, ... in order of `by`, whose values should differ.

    Rows are range-partitioned, numbered within their partition, and shifted by
    the sizes of the partitions before, one small row each.
    """
    placed = materialise(df.repartitionByRange(*by).withColumn("_part", F.spark_partition_id()), "placed")
    sizes = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("_part").count().withColumn("_start", F.coalesce(F.sum("count").over(sizes), F.lit(0))).select("_part", "_start")
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*by))
    return placed.withColumn("_n", within).join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + F.col("_n") - 1).drop("_part", "_start", "_n")


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, so that workers can import it wherever they run."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="lodestone-package-")) / "lodestone.zip"  # on the driver alone
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(target))
    _SHIPPED.add(app)
