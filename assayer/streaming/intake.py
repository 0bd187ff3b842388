"""Dataset intake as a file stream."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from assayer.operators.audit import append_audit
from assayer.operators.intake import ingest, read_lines
from assayer.sources.versions import VersionedTables


def start_intake(uploads: DataFrame, tables: VersionedTables, checkpoint: str, as_of: Callable[[], Column], audit_path: str) -> StreamingQuery:
    """Ingest micro-batches of upload rows into the versioned catalogue.

    ``uploads`` streams the rows that ``ingest`` takes, with ``file`` as the path
    of the stored bytes. A batch that is run again after a failure writes the
    same rows, keyed by file hash. Only paths reach the driver, one micro-batch
    at a time; limit those with the source's ``maxFilesPerTrigger``.
    """
    def run(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        try:
            files = [r["file"] for r in batch.filter(F.lower("filename").endswith(".csv")).select("file").distinct().collect()]
            lines = read_lines(spark, files) if files else spark.createDataFrame([], "file string, at struct<block:bigint,row:bigint>, line string")
            catalog, audit = ingest(batch, lines, tables.read("users"), tables.read("catalog"), as_of())
            append_audit(audit, audit_path)
            tables.commit(catalog=catalog)
        finally:
            batch.unpersist()

    return uploads.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
