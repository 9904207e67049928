"""Events as changes of papers and as news of their copies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from proofmill.plans.registry import query
from proofmill.session import table
from proofmill.streaming import deliveries


@query()
def delivery_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes due, is settled, given up or expires, of each user's events in order."""
    k = F.get_json_object("props", "$.k").cast("int") % 10
    what = F.when(k < 4, "change").when(k < 8, "failed").otherwise("sent")
    return deliveries.log(table(spark, sf_dir, "events").select(F.col("user_id").alias("paper"), "ts", F.col("event_id").alias("seq"), what.alias("what")))
