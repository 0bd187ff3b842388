"""Two-sample comparisons: drift, distances, coverage and overlap.

Both samples are reduced to counts per value or bin before they meet, so a
value that holds a third of the rows is one row by then.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from assayer.functions.keys import row_key
from assayer.functions.literal import literal_table
from assayer.functions.ordered import Pieces, edge_bucket
from assayer.operators.statistics import exact_quantiles, numeric_long


def _sides(base: DataFrame, other: DataFrame, value: Column) -> DataFrame:
    """(value, p, q): both samples in one frame with 0/1 weights."""
    left = base.select(value.alias("value"), F.lit(1).alias("p"), F.lit(0).alias("q"))
    right = other.select(value.alias("value"), F.lit(0).alias("p"), F.lit(1).alias("q"))
    return left.unionByName(right).filter("value IS NOT NULL")


def _shares(base: DataFrame, other: DataFrame, value: Column) -> DataFrame:
    """(value, p, q): relative frequency of each value in both samples.

    One grouped union replaces the full outer join of two grouped tables.
    """
    counts = _sides(base, other, value).groupBy("value").agg(F.sum("p").cast("double").alias("np"), F.sum("q").cast("double").alias("nq"))
    totals = counts.agg(F.struct(F.sum("np").alias("p"), F.sum("nq").alias("q")).alias("t")).scalar()
    return counts.withColumn("t", totals).select("value", (F.col("np") / F.col("t.p")).alias("p"), (F.col("nq") / F.col("t.q")).alias("q"))


def psi(base: DataFrame, other: DataFrame, column: str, edges: list[float], floor: float = 1e-4) -> DataFrame:
    """Population stability index over the bins cut by ``edges``."""
    value = F.when(F.col(f"`{column}`").isNotNull(), edge_bucket(column, edges))
    shares = _shares(base, other, value)
    p, q = F.greatest("p", F.lit(floor)), F.greatest("q", F.lit(floor))
    out = shares.agg(F.sum((q - p) * F.log(q / p)).alias("psi"))
    v = F.col("psi")
    return out.withColumn("status", F.when(v > 0.25, "FAIL").when(v > 0.1, "WARN").otherwise("PASS"))


def quantile_edges(base: DataFrame, column: str, bins: int = 10) -> list[float]:
    """Exact baseline quantile edges (deciles by default): a few numbers reach the
    driver."""
    probs = [i / bins for i in range(1, bins)]
    row = exact_quantiles(base, [column], probs).first()
    return [] if row is None else sorted({row[f"q{i}"] for i in range(1, bins)})


def binned_drift(base: DataFrame, other: DataFrame, columns: Sequence[str], bins: int = 10, floor: float = 1e-4) -> DataFrame:
    """(column, psi, jensen_shannon, hellinger) of numeric columns, over the baseline's
    quantile bins; columns without values on either side are left out.

    Quantiles of all columns come from one set of passes, counts of all bins and
    both sides from one more.
    """
    probs = [i / bins for i in range(1, bins)]
    quantiles = exact_quantiles(base, columns, probs).collect()
    if not quantiles:
        return base.sparkSession.createDataFrame([], "column string, psi double, jensen_shannon double, hellinger double")
    edges = literal_table(base.sparkSession, ["column", "edges"], [(r["column"], sorted({r[f"q{i}"] for i in range(1, bins)})) for r in quantiles])
    side = lambda df, p, q: numeric_long(df, columns).select("column", "value", F.lit(p).alias("p"), F.lit(q).alias("q"))
    both = side(base, 1, 0).unionByName(side(other, 0, 1)).join(F.broadcast(edges), "column")
    counts = both.groupBy("column", F.size(F.filter("edges", lambda e: e < F.col("value"))).alias("bin")).agg(F.sum("p").cast("double").alias("p"), F.sum("q").cast("double").alias("q"))
    totals = counts.groupBy("column").agg(F.sum("p").alias("all_p"), F.sum("q").alias("all_q")).where("all_p > 0 and all_q > 0")
    shares = counts.join(F.broadcast(totals), "column").select("column", (F.col("p") / F.col("all_p")).alias("p"), (F.col("q") / F.col("all_q")).alias("q"))
    p, q = F.col("p"), F.col("q")
    low, high, m = F.greatest(p, F.lit(floor)), F.greatest(q, F.lit(floor)), (p + q) / 2
    part = lambda a: F.when(a > 0, a * F.log(a / m)).otherwise(0.0)
    return shares.groupBy("column").agg(
        F.sum((high - low) * F.log(high / low)).alias("psi"), (F.sum(part(p) + part(q)) / 2).alias("jensen_shannon"),
        F.sqrt(F.greatest(F.lit(0.0), 1.0 - F.sum(F.sqrt(p * q)))).alias("hellinger"),
    )


def share_distances(base: DataFrame, other: DataFrame, value: Column) -> DataFrame:
    """Hellinger, total variation, Jensen-Shannon and Kullback-Leibler (smoothed) distances."""
    p, q = F.col("p"), F.col("q")
    m = (p + q) / 2

    def part(a: Column, b: Column) -> Column:
        return F.when(a > 0, a * F.log(a / b)).otherwise(0.0)

    small = F.lit(1e-12)
    return _shares(base, other, value).agg(
        F.sqrt(F.greatest(F.lit(0.0), 1.0 - F.sum(F.sqrt(p * q)))).alias("hellinger"),
        (F.sum(F.abs(p - q)) / 2).alias("total_variation"),
        F.sum((part(p, m) + part(q, m)) / 2).alias("jensen_shannon"),
        F.sum(F.when(p > 0, p * F.log(p / F.greatest(q, small))).otherwise(0.0)).alias("kullback_leibler"),
    )


def distribution_gaps(base: DataFrame, other: DataFrame, columns: Sequence[str], pieces: int | None = None) -> DataFrame:
    """(column, value, f, g, prev): both cumulative distributions at each distinct
    value, and the same of the value before. Values are counted before they are
    ordered; columns without values on either side are left out."""
    side = lambda df, p, q: numeric_long(df, columns).select("column", "value", F.lit(p).alias("p"), F.lit(q).alias("q"))
    counts = side(base, 1, 0).unionByName(side(other, 0, 1)).groupBy("column", "value").agg(F.sum("p").alias("np"), F.sum("q").alias("nq"))
    placed = Pieces(counts, ["column"], ["value"], pieces).running_sums({"cp": F.col("np"), "cq": F.col("nq")})
    found = placed.previous(["value", "cp", "cq"]).frame().where("cp_total > 0 and cq_total > 0")
    share = lambda sums, side: F.col(f"{sums}c{side}") / F.col(f"c{side}_total")
    before = F.when(F.col("prev").isNotNull(), F.struct(F.col("prev.value").alias("value"), share("prev.", "p").alias("f"), share("prev.", "q").alias("g")))
    return found.select("column", "value", share("", "p").alias("f"), share("", "q").alias("g"), before.alias("prev"))


def cdf_columns(base: DataFrame, other: DataFrame, columns: Sequence[str], pieces: int | None = None) -> DataFrame:
    """(column, wasserstein, energy_distance, kolmogorov_smirnov, span) of numeric
    columns in one go; span is the largest value less the smallest."""
    # Integrals run over the gap that ends at a value, with both distributions
    # as they were at the value before.
    steps = distribution_gaps(base, other, columns, pieces)
    gap = F.col("value") - F.col("prev.value")
    diff = F.abs(F.col("prev.f") - F.col("prev.g"))
    return steps.groupBy("column").agg(
        F.coalesce(F.sum(gap * diff), F.lit(0.0)).alias("wasserstein"), F.coalesce(2.0 * F.sum(gap * diff * diff), F.lit(0.0)).alias("energy_distance"),
        F.max(F.abs(F.col("f") - F.col("g"))).alias("kolmogorov_smirnov"), (F.max("value") - F.min("value")).alias("span"),
    )


def cdf_distances(base: DataFrame, other: DataFrame, column: str, pieces: int | None = None) -> DataFrame:
    """Wasserstein-1, energy distance and Kolmogorov-Smirnov statistic of one column;
    zeros and no statistic where one of the samples is empty."""
    found = cdf_columns(base, other, [column], pieces)
    return found.agg(
        F.coalesce(F.max("wasserstein"), F.lit(0.0)).alias("wasserstein"), F.coalesce(F.max("energy_distance"), F.lit(0.0)).alias("energy_distance"),
        F.max("kolmogorov_smirnov").alias("kolmogorov_smirnov"),
    )


def category_coverage(base: DataFrame, other: DataFrame, column: str) -> DataFrame:
    """Share of the baseline's categories that the comparison also has."""
    seen = _sides(base, other, F.col(column)).groupBy("value").agg(F.max("p").alias("p"), F.max("q").alias("q"))
    both = F.count_if((F.col("p") == 1) & (F.col("q") == 1))
    n = F.count_if(F.col("p") == 1)
    return seen.agg(n.alias("baseline_categories"), both.alias("covered"), F.try_divide(both, n).alias("coverage"))


def uncovered_categories(base: DataFrame, other: DataFrame, column: str) -> DataFrame:
    seen = _sides(base, other, F.col(column)).groupBy("value").agg(F.max("p").alias("p"), F.max("q").alias("q"))
    return seen.filter("p = 1 AND q = 0").select(F.col("value").alias(column))


def row_overlap(base: DataFrame, other: DataFrame) -> DataFrame:
    """Rows of ``base`` that also occur in ``other``, compared by whole row.

    Copies are counted before the two sides meet, so a row copied many times is
    one group with a count.
    """
    left = base.select(row_key(base).alias("k"), F.lit(1).alias("l"), F.lit(0).alias("r"))
    right = other.select(row_key(other).alias("k"), F.lit(0).alias("l"), F.lit(1).alias("r"))
    groups = left.unionByName(right).groupBy("k").agg(F.sum("l").alias("l"), F.max("r").alias("r"))
    n, hit = F.coalesce(F.sum("l"), F.lit(0)), F.coalesce(F.sum(F.col("l") * F.col("r")), F.lit(0))
    return groups.agg(n.alias("rows"), hit.alias("overlapping_rows"), F.try_divide(hit, n).alias("overlap_share"))
