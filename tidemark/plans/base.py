"""Tables and views that queries share, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a timeline: user_id, event_id, cls, value, sec and hr since 1970."""
    days = F.datediff(F.to_date("ts"), F.lit("1970-01-01").cast("date")).cast("long")
    sec = days * 86400 + F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")
    return table(spark, sf_dir, "events").select("user_id", "event_id", F.col("event_type").alias("cls"), "value", sec.alias("sec"), (days * 24 + F.hour("ts")).alias("hr"))


#: The same view for DuckDB; queries start with "with " + EV.
EV = "ev as (select user_id, event_id, event_type as cls, value, cast(floor(epoch(ts)) as bigint) as sec, cast(floor(epoch(ts) / 3600) as bigint) as hr from events)"
