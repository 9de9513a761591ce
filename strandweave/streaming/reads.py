"""Stateless streaming: reads mapped as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strandweave.plans.mapping import map_reads

READS = "read string, seq string"


def read_stream(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """Reads from Parquet files that appear in a folder; those with N are left out."""
    stream = spark.readStream.schema(READS).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    return stream.filter(~F.contains(F.upper("seq"), F.lit("N")))


def map_stream(stream: DataFrame, reference: list[tuple], scheme: str = "natural", **parameters) -> DataFrame:
    """The same rows as for a table; no state is kept between batches."""
    return map_reads(stream, reference, scheme, **parameters)


def write_mappings(mapped: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append mappings as Parquet; with ``once`` what is there now, then stop."""
    writer = mapped.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
