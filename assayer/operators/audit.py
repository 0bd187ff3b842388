"""Audit rows."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from assayer.functions.pii import mask_metadata

AUDIT_COLUMNS = ("id", "actor_id", "action", "resource", "purpose", "result", "ip", "metadata", "created_at", "dt")


def client_address(forwarded_for: Column, peer: Column) -> Column:
    """First forwarded address, else the peer's."""
    first = F.trim(F.split_part(forwarded_for, F.lit(","), F.lit(1)))
    return F.when(F.coalesce(forwarded_for, F.lit("")) != "", first).otherwise(peer)


def metadata_map(json: Column) -> Column:
    """Top-level map of a JSON object; nested values stay JSON text."""
    return F.coalesce(F.from_json(json, "map<string,string>"), F.create_map().cast("map<string,string>"))


def audit_rows(events: DataFrame) -> DataFrame:
    """Events in the audit schema with masked metadata and a date partition.

    Absent columns become null; a missing id is drawn.
    """
    have = set(events.columns)

    def col(name: str, default: Column | None = None) -> Column:
        empty = default if default is not None else F.lit(None).cast("string")
        return F.coalesce(F.col(name), empty) if name in have else empty

    kind = dict(events.dtypes).get("metadata")
    metadata = metadata_map(F.col("metadata")) if kind == "string" else col("metadata", F.create_map().cast("map<string,string>"))
    rows = events.select(
        col("id", F.uuid()).cast("string").alias("id"), *[col(c).alias(c) for c in ("actor_id", "action", "resource", "purpose")],
        col("result", F.lit("SUCCESS")).alias("result"), col("ip").alias("ip"),
        mask_metadata(metadata).alias("metadata"), F.col("created_at").cast("timestamp").alias("created_at"),
    )
    return rows.withColumn("dt", F.to_date("created_at"))


def append_audit(rows: DataFrame, path: str) -> None:
    """Append by date; a day is written by as many tasks as its size asks for."""
    rows.hint("rebalance", "dt").write.mode("append").partitionBy("dt").parquet(path)


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    """Stored events, each id once: a retried or repeated event is one event."""
    return spark.read.parquet(path).dropDuplicates(["id"])
