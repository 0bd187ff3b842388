"""Ordered computations that never sort one whole series in one task.

Rows are cut into pieces by a range exchange over series, order and row number.
Its bounds lie at counted rows, so pieces are of even size wherever the rows are: a
series with most of the rows is many pieces, and equal times are cut as well. The
cut is checkpointed, for its bounds are sampled. Windows run inside a piece; a
summary row per series and piece carries the state across, in a tree: no window
sees more than ``FAN`` summary rows of a series.
"""

from collections.abc import Callable, Sequence
from math import ceil, isfinite, sqrt

from pyspark.sql import Column, DataFrame, Window, functions as F

from assayer.session import durable

SERIES, PIECE, TIE, BLOCK = "__series", "__piece", "__tie", "__block"
KEYS = [SERIES, PIECE]
FAN = 256


class Pieces:
    """Rows of ``df`` in pieces by ``order`` within series; nulls come first.

    Series are equal ``keys``, nulls included. Without ``pieces`` there are as many
    as the session has shuffle partitions, or fewer where these would be small.
    """

    def __init__(self, df: DataFrame, keys: Sequence[str], order: Sequence[str], pieces: int | None = None, fan: int = FAN) -> None:
        # The keys become one struct, which is never null itself, so that pieces
        # join by plain equality and rows keep the partitioning of their window.
        rows = df.withColumns({SERIES: F.struct(*keys) if keys else F.lit(0), TIE: F.monotonically_increasing_id()})
        by = [SERIES, *order, TIE]
        ranged = rows.repartitionByRange(pieces, *by) if pieces else rows.repartitionByRange(*by)
        self.rows = durable(ranged.withColumn(PIECE, F.spark_partition_id()))
        self.order, self.fan, self.columns = [*order, TIE], fan, list(df.columns)
        self.most = pieces or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        self.inside = Window.partitionBy(*KEYS).orderBy(*self.order)

    def frame(self) -> DataFrame:
        return self.rows.select(*self.columns)

    def previous(self, values: Sequence[str], name: str = "prev") -> "Pieces":
        """Add struct ``name`` with ``values`` of the row before, null for the first."""
        state = F.struct(*values)
        tails = self.rows.groupBy(*KEYS).agg(F.max_by(state, F.struct(*self.order)).alias("__tail"))
        last = {"__tail": lambda rows: F.max_by("__tail", PIECE)}
        carried = _before(tails, self.most, last, lambda name, above: F.coalesce(name, above), self.fan)
        local = self.rows.withColumn("__local", F.lag(state).over(self.inside))
        return self._with(local.join(carried, KEYS, "left").withColumn(name, F.coalesce("__local", "__tail")).drop("__local", "__tail"), [name])

    def running_sums(self, values: dict[str, Column]) -> "Pieces":
        """Add running sums, the current row included: ``values`` maps name to term.

        The sum over the whole series comes along as ``<name>_total``.
        """
        upto = self.inside.rowsBetween(Window.unboundedPreceding, 0)
        sums = self.rows.groupBy(*KEYS).agg(*[F.sum(term).alias(name) for name, term in values.items()])
        totals = sums.groupBy(SERIES).agg(*[F.sum(name).alias(f"{name}_total") for name in values])
        add = lambda name, above: F.coalesce(name, F.lit(0)) + F.coalesce(above, F.lit(0))
        before = _before(sums, self.most, {name: (lambda rows, name=name: F.sum(name)) for name in values}, add, self.fan)
        before = before.join(totals, SERIES).withColumnsRenamed({name: f"__o_{name}" for name in values})
        local = self.rows.select("*", *[F.sum(term).over(upto).alias(name) for name, term in values.items()])
        joined = local.join(before, KEYS, "left").withColumns({name: F.col(name) + F.coalesce(f"__o_{name}", F.lit(0)) for name in values})
        return self._with(joined.drop(*[f"__o_{name}" for name in values]), [*values, *[f"{name}_total" for name in values]])

    def least_before(self, term: Column, name: str) -> "Pieces":
        """Add the least ``term`` of all rows before, null if there is none."""
        least = self.rows.groupBy(*KEYS).agg(F.min(term).alias("__least"))
        carried = _before(least, self.most, {"__least": lambda rows: F.min("__least")}, F.least, self.fan)
        local = self.rows.withColumn("__local", F.min(term).over(self.inside.rowsBetween(Window.unboundedPreceding, -1)))
        return self._with(local.join(carried, KEYS, "left").withColumn(name, F.least("__local", "__least")).drop("__local", "__least"), [name])

    def _with(self, rows: DataFrame, added: Sequence[str]) -> "Pieces":
        out = object.__new__(Pieces)
        out.__dict__.update(self.__dict__)
        out.rows, out.columns = rows, [*self.columns, *added]
        return out


def _before(states: DataFrame, numbers: int, merge: dict[str, Callable], join: Callable, fan: int) -> DataFrame:
    """What all pieces of a series before each piece add up to, or null.

    ``numbers`` is above every piece number. Inside blocks of ``fan`` numbers a
    window does it; the sums of the blocks take the same way, and are joined on.
    """
    rows = states.withColumn(BLOCK, F.floor(F.col(PIECE) / fan))
    before = Window.partitionBy(SERIES, BLOCK).orderBy(PIECE).rowsBetween(Window.unboundedPreceding, -1)
    local = rows.select(*KEYS, BLOCK, *[made(rows).over(before).alias(name) for name, made in merge.items()])
    if numbers <= fan:
        return local.drop(BLOCK)
    blocks = rows.groupBy(SERIES, BLOCK).agg(*[made(rows).alias(name) for name, made in merge.items()]).withColumnRenamed(BLOCK, PIECE)
    above = _before(blocks, ceil(numbers / fan), merge, join, fan)
    above = above.withColumnsRenamed({PIECE: BLOCK, **{name: f"__a_{name}" for name in merge}})
    return local.join(above, [SERIES, BLOCK], "left").select(*KEYS, *[join(F.col(name), F.col(f"__a_{name}")).alias(name) for name in merge])


def with_previous(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str], name: str = "prev", pieces: int | None = None) -> DataFrame:
    """Add struct ``name`` with ``values`` of the row before, in ``order`` per key."""
    return Pieces(df, keys, order, pieces).previous(values, name).frame()


def with_running_sums(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: dict[str, Column], pieces: int | None = None) -> DataFrame:
    """Add running sums in ``order`` per key, and ``<name>_total`` of the series."""
    return Pieces(df, keys, order, pieces).running_sums(values).frame()


def edge_bucket(column: str, edges: Sequence[float]) -> Column:
    """Number of edges below the value of a column.

    A few edges are a binary search in the plan. Many edges are searched in two
    steps, a search over groups and a count inside one, since a very deep
    expression would not be compiled.
    """
    def literal(edge: float) -> str:
        return f"{edge!r}D" if isfinite(edge) else f"double('{edge}')"

    def search(tops: Sequence[float], low: int, high: int) -> str:
        if low == high:
            return str(low)
        middle = (low + high) // 2
        return f"if(`{column}` > {literal(tops[middle])}, {search(tops, middle + 1, high)}, {search(tops, low, middle)})"

    edges = sorted(float(e) for e in edges)
    if len(edges) <= 64:
        return F.expr(search(edges, 0, len(edges)))
    step = ceil(sqrt(len(edges)))
    groups = [edges[i : i + step] for i in range(0, len(edges), step)]
    group = search([g[-1] for g in groups[:-1]], 0, len(groups) - 1)
    table = ", ".join(f"array({', '.join(map(literal, g))})" for g in groups)
    return F.expr(f"{step} * ({group}) + size(filter(element_at(array({table}), ({group}) + 1), e -> e < `{column}`))")
