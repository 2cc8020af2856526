"""Records that arrive over time: normalised on the fly, and matched against the standing blocks.

An extension beyond batch runs. Arrivals are normalised with the same expressions as in batch; the blocks of the targets are
formed once and stored, and each micro batch of new records is joined with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from kithmark.functions.text import processed
from kithmark.operators.blocking import Caps, PRODUCTION, blocking_view, fold_blocks, target_blocks


def read_arrivals(spark: SparkSession, folder: str, schema: StructType, files_per_batch: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def deliveries_per_hour(arrivals: DataFrame, *, time: str = "received_at", lateness: str = "1 day") -> DataFrame:
    """Records and rows by hour and country; records delivered twice within the lateness count once."""
    once = arrivals.withWatermark(time, lateness).dropDuplicatesWithinWatermark(["entity_id"])
    return once.groupBy(F.window(time, "1 hour"), "country_clean").agg(F.count(F.lit(1)).alias("n_records"))


def match_arrivals(arrivals: DataFrame, targets: DataFrame, out: str, checkpoint: str, *, caps: Caps = Caps(), routes=PRODUCTION, cap: int = 15):
    """Writes candidate lists of each micro batch of primary records to ``out`` (Parquet), once per batch id; the blocks stand in ``out``_blocks."""
    spark = targets.sparkSession
    stored = f"{out}_blocks"
    target_blocks(blocking_view(targets), caps, routes, cap).write.mode("overwrite").parquet(stored)

    def each(batch: DataFrame, number: int) -> None:
        fresh = processed(batch) if "business_name_normalized" not in batch.columns else batch
        lists = fold_blocks(blocking_view(fresh), spark.read.parquet(stored), routes, cap)
        lists.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return arrivals.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
