"""Audit events as a stream."""

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from assayer.operators.audit import audit_rows


def masked_events(events: DataFrame) -> DataFrame:
    """Masked audit rows of all events, however late; ``operators.audit.read_audit``
    leaves out what was sent again."""
    return audit_rows(events)


def start_audit(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return (
        masked_events(events).writeStream.format("parquet").partitionBy("dt")
        .option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
