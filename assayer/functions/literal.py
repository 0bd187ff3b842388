"""Small constant tables built inside the plan."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F


def literal_table(spark: SparkSession, names: Sequence[str], rows: Sequence[Sequence]) -> DataFrame:
    """A table of constants; always tiny, so joins with it may be broadcast."""
    structs = [F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row)]) for row in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))
