"""Edge batches folded into the store as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from spindrift.operators.graph import merged
from spindrift.sources.store import EDGES


def follow(spark: SparkSession, incoming: str, out: str, checkpoint: str) -> StreamingQuery:
    """Read edge files (JSON lines) as they are put into a folder and append each batch, one row per column pair, under its batch number.

    A batch that is run again replaces its own folder, so its edges are never there twice. latest() reads them.
    """
    stream = spark.readStream.schema(EDGES).json(incoming)

    def write(batch: DataFrame, number: int) -> None:
        one = merged(batch.withColumn("ord", F.monotonically_increasing_id())).drop("ord")
        one.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()


def latest(spark: SparkSession, out: str) -> DataFrame:
    """All batches merged: of a column pair the most significant edge, of equal ones the latest batch's."""
    rows = spark.read.parquet(out)
    return merged(rows.withColumn("ord", F.col("batch").cast("long")).drop("batch")).drop("ord")
