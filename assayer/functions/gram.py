"""Cross products of many columns: one mergeable matrix instead of an expression per pair."""

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

PARTS = "part bigint, total binary"


@dataclass
class Cross:
    """Sums over the rows in which both columns of a pair have a value.

    ``n[i, j]`` counts these rows; ``sums[i, j]`` and ``squares[i, j]`` are over
    column i, ``products[i, j]`` over both, all after ``shift`` is taken off.
    """

    shift: np.ndarray
    n: np.ndarray
    sums: np.ndarray
    squares: np.ndarray
    products: np.ndarray

    def covariance(self) -> np.ndarray:
        """Population covariance of each pair; not a number where no row has both."""
        with np.errstate(divide="ignore", invalid="ignore"):
            return (self.products - self.sums * self.sums.T / self.n) / self.n

    def correlation(self) -> np.ndarray:
        """Pearson correlation of each pair over its own rows."""
        with np.errstate(divide="ignore", invalid="ignore"):
            spread = np.maximum(self.squares - self.sums**2 / self.n, 0)
            return np.clip(self.covariance() * self.n / np.sqrt(spread * spread.T), -1, 1)


def _matrices(batch: pa.RecordBatch, shift: np.ndarray, whole: bool) -> np.ndarray:
    values = np.stack([c.to_numpy(zero_copy_only=False).astype(np.float64) for c in batch.columns], axis=1) - shift
    held = ~np.isnan(values)
    if whole:
        values, held = (x[held.all(axis=1)] for x in (values, held))
    filled, mask = np.where(held, values, 0.0), held.astype(np.float64)
    return np.stack([mask.T @ mask, filled.T @ mask, (filled * filled).T @ mask, filled.T @ filled])


def _summed(parts: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
    total = None
    for part in parts:
        total = part if total is None else total + part
    if total is not None:
        yield pa.record_batch([pa.array([TaskContext.get().partitionId()]), pa.array([total.tobytes()])], names=["part", "total"])


def cross_products(df: DataFrame, columns: Sequence[str], whole: bool = False) -> Cross:
    """Cross products of numeric columns, not-a-number and null being no value; with
    ``whole`` only rows that have all values count.

    Every task adds its rows to one matrix, block by block; matrices are added in
    two steps, and one reaches the driver. There are a few tasks per core, so the
    number of matrices does not grow with the table. Means are taken off first,
    which keeps the sums exact enough for columns far from 0.
    """
    doubles = df.select(*[F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None).cast("double")).alias(f"c{i}") for i, c in enumerate(columns)])
    size = len(columns)
    means = doubles.agg(*[F.avg(c) for c in doubles.columns]).first()
    shift = np.array([0.0 if m is None or not np.isfinite(m) else m for m in means])
    tasks = 4 * df.sparkSession.sparkContext.defaultParallelism
    made = doubles.coalesce(tasks).mapInArrow(lambda batches: _summed(_matrices(b, shift, whole) for b in batches if b.num_rows), PARTS)
    for groups in (ceil(sqrt(tasks)), 1):
        made = made.repartition(groups, "part").sortWithinPartitions("part").mapInArrow(
            lambda batches: _summed(np.frombuffer(x).reshape(4, size, size) for b in batches for x in b.column("total").to_pylist()), PARTS
        )
    row = made.first()
    total = np.zeros((4, size, size)) if row is None else np.frombuffer(bytes(row.total)).reshape(4, size, size)
    return Cross(shift, *total)
