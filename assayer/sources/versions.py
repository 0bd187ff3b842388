"""Tables kept as numbered versions, switched together.

A commit writes every changed table to ``<root>/<name>/v=<n>`` and then appends
one row to ``<root>/_commits``. Readers see the last committed row, so a failed
job changes nothing and no path is overwritten while it is read.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.errors import AnalysisException

COMMIT_SCHEMA = "version BIGINT, tables MAP<STRING,BIGINT>"


class VersionedTables:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def _commits(self) -> DataFrame:
        try:
            return self.spark.read.schema(COMMIT_SCHEMA).parquet(f"{self.root}/_commits")
        except AnalysisException:  # nothing committed yet
            return self.spark.createDataFrame([], COMMIT_SCHEMA)

    def state(self) -> tuple[int, dict[str, int]]:
        """Last version and the table versions it points to (one small row)."""
        row = self._commits().agg(F.max("version").alias("v"), F.max_by("tables", "version").alias("t")).first()
        return (0, {}) if row["v"] is None else (row["v"], dict(row["t"]))

    def read(self, name: str) -> DataFrame:
        _, tables = self.state()
        if name not in tables:
            raise KeyError(f"no committed table: {name}")
        return self.spark.read.parquet(f"{self.root}/{name}/v={tables[name]}")

    def commit(self, **tables: DataFrame) -> int:
        """Write the given tables and switch to them at once."""
        version, current = self.state()
        following = version + 1
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{self.root}/{name}/v={following}")
            current[name] = following
        row = self.spark.createDataFrame([(following, current)], COMMIT_SCHEMA)
        row.coalesce(1).write.mode("append").parquet(f"{self.root}/_commits")
        return following
