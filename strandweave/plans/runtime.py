"""Tables between steps, and global order without a single task."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it; on a
    cluster without that folder it is shipped with ``--py-files``."""
    env = spark.sparkContext.environment
    path = env.get("PYTHONPATH") or os.environ.get("PYTHONPATH", "")
    if ROOT not in path.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(p for p in (ROOT, path) if p)


def shared_folder(spark: SparkSession, kind: str = "table") -> str:
    """A new folder below ``spark.checkpoint.dir``. Where that is unset, a local
    one on a single machine, and an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file:///tmp/strandweave-checkpoints"
    return f"{base.rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read: iterative plans stay short and
    restartable."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove a table that ``materialize`` wrote; nothing may read it any more."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
        if "/table-" in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def tree_reduce[T](items: list[T], combine: Callable[[T, T], T]) -> T:
    """Combine neighbours pairwise until one is left: the plan of n tables is
    log n deep, and a combination need only be associative."""
    if not items:
        raise ValueError("nothing to combine")
    while len(items) > 1:
        pairs = zip(items[::2], items[1::2])
        items = [combine(a, b) for a, b in pairs] + ([items[-1]] if len(items) % 2 else [])
    return items[0]


def global_index(df: DataFrame, order: list[Column | str], name: str = "rank") -> DataFrame:
    """A contiguous 0-based index in a total order.

    Rows are range-partitioned and sorted; each partition's rows are counted and
    only those counts are summed in one place. No task sees the whole table.
    """
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ordered = materialize(ordered.withColumn("_m", F.monotonically_increasing_id()))
    ordered = ordered.withColumns({"_p": F.shiftright("_m", 33), "_r": F.col("_m").bitwiseAND(2**33 - 1)})
    sizes = ordered.groupBy("_p").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).drop("_n")
    return ordered.join(F.broadcast(before), "_p").withColumn(name, F.col("_before") + F.col("_r")).drop("_m", "_p", "_r", "_before")


def running_sum(df: DataFrame, order: list[str], sums: dict[str, Column]) -> DataFrame:
    """Running sums (each row included) in a total order, by name.

    Rows are range-partitioned; a partition's rows are summed among themselves,
    and only one total for each partition is summed in one place.
    """
    ordered = materialize(df.repartitionByRange(*order).withColumns({"_p": F.spark_partition_id(), **{f"_v_{k}": v for k, v in sums.items()}}))
    totals = ordered.groupBy("_p").agg(*[F.sum(f"_v_{k}").alias(f"_t_{k}") for k in sums])
    before = totals.select("_p", *[(F.sum(f"_t_{k}").over(Window.orderBy("_p")) - F.col(f"_t_{k}")).alias(f"_b_{k}") for k in sums])
    inside = Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = ordered.withColumns({f"_w_{k}": F.sum(f"_v_{k}").over(inside) for k in sums}).join(F.broadcast(before), "_p")
    return out.withColumns({k: F.col(f"_w_{k}") + F.col(f"_b_{k}") for k in sums}).drop("_p", *[f"_{x}_{k}" for x in "vwb" for k in sums])


def global_lag(df: DataFrame, index: str, columns: list[str], by: int = 1) -> DataFrame:
    """Columns of the row ``by`` places before (negative: after), by an equi join
    on a contiguous index; names get a ``prev_`` prefix."""
    other = df.select((F.col(index) + by).alias(index), *[F.col(c).alias(f"prev_{c}") for c in columns])
    return df.join(other, index, "left")
