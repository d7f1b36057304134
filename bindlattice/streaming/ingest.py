"""Streaming ingest: growing folders of site records, each key stored once.

Spark-native extras; the batch operators define the results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from bindlattice.sources.files import INTERACTION, write_results


def read_interactions(spark: SparkSession, folder: str) -> DataFrame:
    """New JSON-lines files of a folder as they arrive."""
    return spark.readStream.schema(INTERACTION).json(folder)


def as_results(rows: DataFrame) -> DataFrame:
    return rows.select(
        F.col("trn").alias("transcript_id"), F.col("gna").alias("mirna_id"), F.col("den").cast("float").alias("binding_dG"), F.col("kdv").cast("float").alias("Kd"),
        F.col("pst").cast("long").alias("position_start"), F.col("pen").cast("long").alias("position_end"), F.col("rgn").alias("region"), F.col("sty").alias("seed_type"),
        F.coalesce("pcs", F.lit(-1.0)).cast("float").alias("phastcons"), F.col("brl").alias("bridge"), F.coalesce("itb", F.lit(False)).alias("validated"), F.col("alt").alias("interaction_string"),
    ).where("transcript_id is not null and mirna_id is not null and position_start is not null")


def store(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Store what is there, then end; a batch that runs twice adds nothing, as stored keys win."""
    put = lambda batch, _: write_results(batch, path)
    return as_results(rows).writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def rates(events: DataFrame, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Events and their mean value by type and window; data later than ``late`` is left out in a stream."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean")).select("window.start", "event_type", "n", "mean")
