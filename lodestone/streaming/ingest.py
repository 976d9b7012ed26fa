"""Documents that arrive as a stream: each micro-batch upserts the stored table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestone.operators.graph_store import latest_documents


def upsert_stream(documents: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Append every micro-batch of documents(doc_id, title, content) to a versioned table under `folder`.

    A batch is written under its number, so a batch that is run again replaces
    what it wrote before: each document is counted once.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("ingest_seq", F.struct(F.lit(number).cast("long").alias("number"), F.monotonically_increasing_id().alias("row"))).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return documents.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_documents(spark: SparkSession, folder: str) -> DataFrame:
    """The last version of each document that upsert_stream() stored."""
    return latest_documents(spark.read.parquet(folder).drop("batch"))
