"""Checks on time-ordered values, per series.

A series is processed in pieces of counted rows (see functions.ordered), so one busy
series, or one busy day of it, does not end in one task.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from assayer.functions.numeric import correlation
from assayer.functions.ordered import Pieces, with_previous, with_running_sums
from assayer.functions.times import days_between, seconds_between


def time_gaps(df: DataFrame, keys: Sequence[str], time: str, tie: str, late_after: float) -> DataFrame:
    """Per series: events, largest gap in seconds, share of gaps above ``late_after``."""
    seen = with_previous(df.select(*keys, time, tie), keys, [time, tie], [time])
    gap = seconds_between(F.col(time), F.col(f"prev.{time}"))
    return seen.withColumn("gap", gap).groupBy(*keys).agg(
        F.count("*").alias("events"), F.max("gap").alias("max_gap"),
        F.avg((F.col("gap") > late_after).cast("double")).alias("late_share"),
    )


def arrival_order(df: DataFrame, arrival: str, time: str) -> DataFrame:
    """Rows whose time is before that of the row arriving just before."""
    seen = with_previous(df.select(arrival, time), [], [arrival], [time])
    return seen.agg(F.count("*").alias("rows"), F.count_if(F.col(time) < F.col(f"prev.{time}")).alias("out_of_order"))


def gap_autocorrelation(df: DataFrame, time: str, tie: str) -> DataFrame:
    """Correlation, as its absolute value, of each gap with the gap before; null for
    fewer than two pairs or gaps that are all alike."""
    first = Pieces(df.select(time, tie), [], [time, tie]).previous([time])
    gaps = first.frame().select(time, tie, seconds_between(F.col(time), F.col(f"prev.{time}")).alias("gap"))
    pairs = with_previous(gaps, [], [time, tie], ["gap"])
    return pairs.where("gap IS NOT NULL AND prev.gap IS NOT NULL").agg(F.abs(correlation(F.col("gap"), F.col("prev.gap"))).alias("strength"), F.count("*").alias("gaps"))


def freshness(df: DataFrame, time: str, as_of: Column) -> DataFrame:
    """Newest time and its age in days at ``as_of``."""
    out = df.agg(F.max(time).alias("newest"))
    return out.withColumn("age_days", days_between(as_of, F.col("newest")))


def autocorrelation(df: DataFrame, keys: Sequence[str], time: str, tie: str, value: str, lag: int = 1) -> DataFrame:
    """Correlation of a series with itself ``lag`` rows earlier, per series.

    Rows get their position first; the lagged pair is then an equi-join on
    (series, position), whose key is unique and so cannot be skewed.
    """
    rows = df.select(*keys, time, tie, F.col(value).cast("double").alias("x"))
    placed = with_running_sums(rows, keys, [time, tie], {"pos": F.lit(1)}).select(*keys, "pos", "x")
    earlier = placed.select(*keys, (F.col("pos") + lag).alias("pos"), F.col("x").alias("before"))
    return placed.join(earlier, [*keys, "pos"]).groupBy(*keys).agg(
        F.count("*").alias("pairs"), correlation(F.col("x"), F.col("before")).alias("autocorrelation")
    )


def change_point(df: DataFrame, keys: Sequence[str], time: str, tie: str, value: str) -> DataFrame:
    """Largest absolute cumulative sum of deviations from the mean, and where.

    The running count times the mean is subtracted from the running sum; the
    mean comes from the series totals, so no join on the series is needed.
    """
    rows = df.select(*keys, time, tie, F.col(value).cast("double").alias("x")).filter("x IS NOT NULL")
    sums = with_running_sums(rows, keys, [time, tie], {"s": F.col("x"), "n": F.lit(1)})
    cusum = F.abs(F.col("s") - F.col("n") * F.col("s_total") / F.col("n_total"))
    best = F.max(F.struct(cusum.alias("c"), (-F.col("n")).alias("neg")))
    return sums.groupBy(*keys).agg(best.alias("b"), F.count("*").alias("events")).select(
        *keys, "events", F.col("b.c").alias("max_cusum"), (-F.col("b.neg")).alias("position")
    )
