"""Check registry and runner of the tabular quality engine.

A check is either batched, contributing aggregate expressions to one shared
aggregate over the table, or reads a one-row plan, which checks may share. All end
in the same columns: index, test, status, dimension, interpretation, metric.
"""

from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType, TimestampNTZType, TimestampType

from assayer import fixed_values as fv
from assayer.functions import pii
from assayer.functions.keys import missing, row_key
from assayer.functions.numeric import share_status
from assayer.functions.times import days_between
from assayer.operators import drift, profile, scoring, statistics, timeseries

RESULT_COLUMNS = ("index", "test", "status", "dimension", "interpretation", "metric")


@dataclass
class Context:
    """Table, comparison and column roles; schema-level facts only."""

    df: DataFrame
    compare: DataFrame | None = None
    id_col: str | None = None
    time_col: str | None = None
    target_col: str | None = None
    as_of: Column | None = None
    warnings: list[str] = field(default_factory=list)

    @property
    def numeric(self) -> list[str]:
        return profile.numeric_columns(self.df)

    @property
    def measures(self) -> list[str]:
        """Numeric columns without a role."""
        return [c for c in self.numeric if c not in (self.id_col, self.target_col)]

    @property
    def several(self) -> list[str]:
        return self.measures if len(self.measures) > 1 else []

    @property
    def shared(self) -> list[str]:
        """Measures that the comparison has as numbers too."""
        return [] if self.compare is None else [c for c in self.measures if c in profile.numeric_columns(self.compare)]

    @property
    def groups(self) -> list[str]:
        """String columns without a role."""
        return [c for c in self.strings if c not in (self.id_col, self.target_col)]

    @property
    def shared_groups(self) -> list[str]:
        return [] if self.compare is None else [c for c in self.groups if c in self.compare.columns]

    @property
    def several_groups(self) -> list[str]:
        return self.groups if len(self.groups) > 1 else []

    @property
    def numeric_target(self) -> str | None:
        return self.target_col if self.target_col in self.numeric and self.measures else None

    @property
    def strings(self) -> list[str]:
        return profile.string_columns(self.df)


@dataclass(frozen=True)
class Outcome:
    """Status, message and metric of one check, over the columns of its row."""

    status: Column
    interpretation: Column
    metric: Mapping[str, Column] = field(default_factory=dict)


@dataclass(frozen=True)
class Check:
    name: str
    category: str
    judge: Callable[[Context], Outcome | None]
    measures: Callable[[Context], dict[str, Column]] | None = None  # shared aggregate
    table: Callable[[Context], DataFrame] | None = None  # own one-row plan
    needs: tuple[str, ...] = ()  # context fields; absent means SKIP


def _cells(ctx: Context, per_field: Callable) -> Column:
    total = F.lit(0)
    for f in ctx.df.schema.fields:
        total = total + per_field(f).cast("int")
    return total


def _pct(value: Column) -> Column:
    return F.format_string("%.3f%%", value)


def _share_outcome(column: str, limits, text: str) -> Callable[[Context], Outcome]:
    def judge(_: Context) -> Outcome:
        pct = F.col(column)
        return Outcome(share_status(pct, limits), F.concat(F.lit(f"{text} "), _pct(pct)), {column: pct})

    return judge


def _worst(table: DataFrame, value: str) -> DataFrame:
    return table.agg(F.max(value).alias(value), F.max_by("column", value).alias("worst"))


def _missing_measure(ctx: Context) -> dict[str, Column]:
    cells = F.sum(_cells(ctx, missing)) / (F.count("*") * len(ctx.df.columns))
    return {"missing_pct": 100.0 * cells}


def _duplicate_measure(ctx: Context) -> dict[str, Column]:
    n = F.count("*")
    return {"duplicate_pct": 100.0 * (n - F.count_distinct(row_key(ctx.df))) / F.greatest(F.lit(1), n)}


def _blank_measure(ctx: Context) -> dict[str, Column]:
    total, n = F.lit(0), 0
    for f in ctx.df.schema.fields:
        if isinstance(f.dataType, StringType):
            total, n = total + F.coalesce(F.trim(F.col(f"`{f.name}`")) == "", F.lit(False)).cast("int"), n + 1
    return {"blank_pct": 100.0 * F.sum(total) / (F.count("*") * max(1, n))}


def _pii_measure(ctx: Context) -> dict[str, Column]:
    hit = F.lit(False)
    for c in ctx.strings:
        for label in pii.FOUR_LABELS:
            hit = hit | F.coalesce(pii.has_match(F.col(f"`{c}`"), label), F.lit(False))
    return {"pii_rows": F.count_if(hit)}


def _utf8_measure(ctx: Context) -> dict[str, Column]:
    good = F.lit(True)
    for c in ctx.strings:
        good = good & F.coalesce(F.is_valid_utf8(F.col(f"`{c}`")), F.lit(True))
    return {"bad_encoding_rows": F.count_if(~good)}


def _freshness_measure(ctx: Context) -> dict[str, Column]:
    return {"age_days": days_between(ctx.as_of, F.max(F.col(ctx.time_col)))}


def _zero_outcome(column: str, text: str, bad: str = "WARN") -> Callable[[Context], Outcome]:
    def judge(_: Context) -> Outcome:
        n = F.col(column)
        return Outcome(F.when(n == 0, "PASS").otherwise(bad), F.format_string(f"{text}: %d", n), {column: n})

    return judge


def _drift_table(ctx: Context) -> DataFrame:
    """The worst of all shared columns by each distance over the baseline's deciles."""
    found = drift.binned_drift(ctx.df, ctx.compare, ctx.shared)
    return found.agg(*[c for m in ("psi", "jensen_shannon", "hellinger") for c in (F.max(m).alias(m), F.max_by("column", m).alias(f"{m}_column"))])


def _shift_table(ctx: Context) -> DataFrame:
    """The worst of all shared columns by each distance of the distributions."""
    found = drift.cdf_columns(ctx.df, ctx.compare, ctx.shared).withColumn("relative", F.when(F.col("span") > 0, F.col("wasserstein") / F.col("span")).otherwise(0.0))
    return found.agg(*[c for m in ("kolmogorov_smirnov", "relative") for c in (F.max(m).alias(m), F.max_by("column", m).alias(f"{m}_column"))])


def _coverage_table(ctx: Context) -> DataFrame:
    """The shared string column whose categories the comparison covers least."""
    sides = [df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in ctx.shared_groups]).unpivot([], ctx.shared_groups, "column", "value") for df in (ctx.df, ctx.compare)]
    flagged = sides[0].withColumn("p", F.lit(1)).withColumn("q", F.lit(0)).unionByName(sides[1].withColumn("p", F.lit(0)).withColumn("q", F.lit(1))).where("value IS NOT NULL")
    seen = flagged.groupBy("column", "value").agg(F.max("p").alias("p"), F.max("q").alias("q")).where("p = 1")
    return seen.groupBy("column").agg(F.avg("q").alias("coverage")).agg(F.min("coverage").alias("coverage"), F.min_by("column", "coverage").alias("column"))


def _moments_table(ctx: Context) -> DataFrame:
    found = statistics.moments(ctx.df, ctx.measures)
    return found.agg(F.max(F.abs("skewness")).alias("skewness"), F.max_by("column", F.abs("skewness")).alias("column"), F.max("jarque_bera").alias("jarque_bera"))


def _leverage_cutoff(columns: int) -> float:
    """Squared distance that one in a thousand normal rows exceeds (Wilson-Hilferty)."""
    spread = 2 / (9 * columns)
    return columns * (1 - spread + 3.0902 * spread**0.5) ** 3


def _histogram_table(ctx: Context) -> DataFrame:
    """Share of rows that lie in bins a hundred times rarer than the tallest, on average."""
    scores = statistics.histogram_scores(ctx.df.withColumn("__key", F.lit(0)), "__key", ctx.measures)
    far = F.col("hbos") > len(ctx.measures) * 4.605
    return scores.agg((100.0 * F.count_if(far) / F.greatest(F.lit(1), F.count("*"))).alias("outlier_pct"))


def _series(ctx: Context) -> DataFrame:
    """(column, time, tie, value) of all measures."""
    tie = ctx.id_col or ctx.time_col
    rows = ctx.df.select(F.col(f"`{ctx.time_col}`").alias("time"), F.col(f"`{tie}`").alias("tie"), *[F.col(f"`{c}`").cast("double").alias(c) for c in ctx.measures])
    return rows.unpivot(["time", "tie"], ctx.measures, "column", "value").where(F.col("value").isNotNull() & ~F.isnan("value") & F.col("time").isNotNull())


def _change_table(ctx: Context) -> DataFrame:
    """Largest sum of deviations of a measure, in spreads of all its rows."""
    series = _series(ctx)
    found = timeseries.change_point(series, ["column"], "time", "tie", "value").join(series.groupBy("column").agg(F.stddev_pop("value").alias("sd")), "column")
    shift = F.when(F.col("sd") > 0, F.col("max_cusum") / (F.col("events") * F.col("sd"))).otherwise(0.0)
    return found.withColumn("shift", shift).agg(F.max("shift").alias("shift"), F.max_by("column", "shift").alias("column"), F.max_by("position", "shift").alias("position"))


def _lag_table(ctx: Context) -> DataFrame:
    found = timeseries.autocorrelation(_series(ctx), ["column"], "time", "tie", "value")
    found = found.withColumn("strength", F.abs("autocorrelation"))
    return found.agg(F.max("strength").alias("strength"), F.max_by("column", "strength").alias("column"))


def _gap_table(ctx: Context) -> DataFrame:
    """Autocorrelation of the gaps between rows, and the share of gaps above a day."""
    tie = ctx.id_col or ctx.time_col
    rows = ctx.df.select(F.col(f"`{ctx.time_col}`").alias("time"), F.col(f"`{tie}`").alias("tie")).where("time IS NOT NULL")
    return timeseries.gap_autocorrelation(rows, "time", "tie").join(timeseries.time_gaps(rows, [], "time", "tie", 86400.0).select("late_share"))


def _pair_table(ctx: Context) -> DataFrame:
    strength = F.abs("r")
    return statistics.correlation_pairs(ctx.df, ctx.several).agg(F.max(strength).alias("strength"), F.max_by(F.concat("a", F.lit(" / "), "b"), strength).alias("pair"))


def _dependence_table(ctx: Context) -> DataFrame:
    found = statistics.dependence_pairs(ctx.df, ctx.several_groups)
    return found.agg(F.max("share").alias("share"), F.max_by(F.concat("a", F.lit(" / "), "b"), "share").alias("pair"))


def _least_outcome(column: str, good: float, fair: float, text: str) -> Callable[[Context], Outcome]:
    def judge(_: Context) -> Outcome:
        v = F.col(column)
        status = F.when(v.isNull(), "SKIP").when(v >= good, "PASS").when(v >= fair, "WARN").otherwise("FAIL")
        return Outcome(status, F.concat(F.lit(f"{text} "), F.coalesce(F.format_string("%.4f", v.cast("double")), F.lit("unknown"))), {column: v})

    return judge


def _most_outcome(column: str, limits: tuple[float, float], text: str, *more: str) -> Callable[[Context], Outcome]:
    """As a range, with further columns in the metric; no value skips the check."""
    def judge(_: Context) -> Outcome:
        v = F.col(column)
        status = F.when(v.isNull() | F.isnan(v), "SKIP").otherwise(share_status(v, limits))
        return Outcome(status, F.concat(F.lit(f"{text} "), F.coalesce(F.format_string("%.4f", v.cast("double")), F.lit("unknown"))), {c: F.col(c) for c in (column, *more)})

    return judge


def _status_from(column: str, text: str, metric: Sequence[str]) -> Callable[[Context], Outcome]:
    def judge(_: Context) -> Outcome:
        return Outcome(F.col(column), F.lit(text), {m: F.col(m) for m in metric})

    return judge


def _parity_outcome(_: Context) -> Outcome:
    p = F.col("prevalence_parity")
    text = F.when(p.isNull(), "No non-null labels").otherwise(F.format_string("Label prevalence parity=%.3f", p))
    return Outcome(F.col("status"), text, {"prevalence_parity": p})


def _balance_outcome(_: Context) -> Outcome:
    b = F.col("balance")
    status = F.when(F.col("classes") < 2, "SKIP").when(b >= 70, "PASS").when(b >= 40, "WARN").otherwise("FAIL")
    return Outcome(status, F.format_string("Class balance score %.1f", b), {"balance": b})


def _range_outcome(column: str, warn: float, fail: float, text: str) -> Callable[[Context], Outcome]:
    def judge(_: Context) -> Outcome:
        v = F.col(column)
        return Outcome(share_status(v, (warn, fail)), F.concat(F.lit(f"{text} "), F.format_string("%.4f", v)), {column: v})

    return judge


CHECKS: tuple[Check, ...] = (
    Check("Missing value ratio", "Missingness Analysis", _share_outcome("missing_pct", fv.MISSING_PCT, "Missing cells"), _missing_measure),
    Check("Blank string format", "Data Integrity & Validation", _share_outcome("blank_pct", fv.MISSING_PCT, "Blank strings"), _blank_measure),
    Check("Duplicate row ratio", "Data Integrity & Validation", _share_outcome("duplicate_pct", fv.MISSING_PCT, "Duplicate rows"), _duplicate_measure),
    Check("PII pattern scan", "Privacy & Anonymity", _zero_outcome("pii_rows", "Rows with personal data"), _pii_measure),
    Check("Text encoding", "Text Quality", _zero_outcome("bad_encoding_rows", "Rows with invalid UTF-8", "FAIL"), _utf8_measure),
    Check("Timeliness freshness", "Time Series: Stationarity", _range_outcome("age_days", 365.0, 1095.0, "Age in days"), _freshness_measure, needs=("time_col", "as_of")),
    Check("Primary-key uniqueness", "Data Integrity & Validation", _status_from("status", "Identifier is unique and filled", ("repeated_keys", "null_keys")),
          table=lambda c: statistics.key_uniqueness(c.df, [c.id_col]), needs=("id_col",)),
    Check("IQR outlier share", "Outlier Detection", _range_outcome("outlier_pct", *fv.OUTLIER_PCT, "Worst column outlier share"),
          table=lambda c: _worst(statistics.iqr_outliers(c.df, [x for x in c.numeric if x != c.id_col]), "outlier_pct"), needs=("measures",)),
    Check("Z-score outlier share", "Outlier Detection", _range_outcome("outlier_pct", *fv.OUTLIER_PCT, "Worst column outlier share"),
          table=lambda c: _worst(statistics.zscore_outliers(c.df, [x for x in c.numeric if x != c.id_col]), "outlier_pct"), needs=("measures",)),
    Check("PSI drift", "Two-Sample/Drift Tests", _most_outcome("psi", (0.1, 0.25), "Population stability index of the worst column", "psi_column"), table=_drift_table, needs=("compare", "shared")),
    Check("Kolmogorov-Smirnov shift", "Two-Sample/Drift Tests", _most_outcome("kolmogorov_smirnov", (0.1, 0.25), "Largest gap of the distributions", "kolmogorov_smirnov_column"), table=_shift_table, needs=("compare", "shared")),
    Check("Row leakage overlap", "Data Leakage", _range_outcome("overlap_share", 0.0, 0.05, "Share of rows also in the comparison"),
          table=lambda c: drift.row_overlap(c.df, c.compare), needs=("compare",)),
    Check("Label class balance", "Label Quality", _balance_outcome, table=lambda c: statistics.class_balance(c.df, c.target_col), needs=("target_col",)),
    Check("Fairness coverage", "Label Quality", _parity_outcome, table=lambda c: statistics.class_parity(c.df, c.target_col), needs=("target_col",)),
    Check("Time gap autocorrelation", "Time Series: Autocorrelation", _most_outcome("strength", (0.5, 0.9), "Correlation of a gap with the one before", "gaps"), table=_gap_table, needs=("time_col",)),
    Check("Time gap lateness", "Time Series: Stationarity", _most_outcome("late_share", (0.05, 0.2), "Share of gaps above a day"), table=_gap_table, needs=("time_col",)),
    Check("Variance inflation", "Multivariate Tests", _most_outcome("vif", fv.VIF_LIMITS, "Worst variance inflation factor", "worst"),
          table=lambda c: _worst(statistics.vif(c.df, c.several), "vif"), needs=("several",)),
    Check("Condition number", "Multivariate Tests", _most_outcome("condition_number", fv.CONDITION_LIMITS, "Condition number of the centred columns"),
          table=lambda c: statistics.condition_number(c.df, c.several), needs=("several",)),
    Check("Mahalanobis outlier share", "Multivariate Tests", _most_outcome("outlier_pct", fv.OUTLIER_PCT, "Share of rows far from the centre"),
          table=lambda c: statistics.mahalanobis_outliers(c.df, c.several, _leverage_cutoff(len(c.several))), needs=("several",)),
    Check("Correlated column pairs", "Multivariate Tests", _most_outcome("strength", (0.95, 0.999), "Strongest correlation of two columns", "pair"), table=_pair_table, needs=("several",)),
    Check("Histogram outlier share", "Outlier Detection", _most_outcome("outlier_pct", fv.OUTLIER_PCT, "Share of rows in rare bins"), table=_histogram_table, needs=("measures",)),
    Check("Skewness of distributions", "Distribution & Normality", _most_outcome("skewness", (2.0, 10.0), "Largest skewness", "column", "jarque_bera"), table=_moments_table, needs=("measures",)),
    Check("Jensen-Shannon divergence", "Multivariate Divergences", _most_outcome("jensen_shannon", (0.05, 0.2), "Largest divergence over deciles", "jensen_shannon_column"), table=_drift_table, needs=("compare", "shared")),
    Check("Wasserstein shift", "Multivariate Divergences", _most_outcome("relative", (0.05, 0.2), "Largest distance in parts of the range", "relative_column"), table=_shift_table, needs=("compare", "shared")),
    Check("Category coverage", "Coverage & Sampling", _least_outcome("coverage", 0.95, 0.8, "Least share of categories in the comparison"), table=_coverage_table, needs=("compare", "shared_groups")),
    Check("Change point", "Change-Point Detection", _most_outcome("shift", (0.1, 0.25), "Largest cumulative deviation", "column", "position"), table=_change_table, needs=("time_col", "measures")),
    Check("Value autocorrelation", "Time Series: Autocorrelation", _most_outcome("strength", (0.9, 0.99), "Strongest correlation with the row before", "column"), table=_lag_table, needs=("time_col", "measures")),
    Check("Dependent column pairs", "Information Theory", _most_outcome("share", (0.95, 0.9999), "Largest share of information in common", "pair"), table=_dependence_table, needs=("several_groups",)),
    Check("k-anonymity", "Privacy & Anonymity", _least_outcome("k_anonymity", 5, 2, "Smallest group of equal rows"),
          table=lambda c: statistics.anonymity(c.df, c.groups, c.target_col or c.groups[0]), needs=("groups",)),
    Check("Target leakage", "Data Leakage", _most_outcome("abs_corr", (0.95, 0.99), "Strongest correlation with the target", "worst"),
          table=lambda c: _worst(statistics.target_leakage(c.df, c.target_col, c.measures), "abs_corr"), needs=("numeric_target",)),
)

KNOWN_STATUS = tuple(fv.STATUS_SCORE)


def _present(ctx: Context, need: str) -> bool:
    value = getattr(ctx, need)
    return bool(value) if isinstance(value, (list, str)) else value is not None


def _result(index: int, check: Check, outcome: Outcome) -> Column:
    """One result struct; an unknown status becomes WARN."""
    status = F.when(outcome.status.isin(*KNOWN_STATUS), outcome.status).otherwise("WARN")
    pairs = [x for k, v in outcome.metric.items() for x in (F.lit(k), v.cast("string"))]
    metric = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    default = fv.CHECK_CATEGORY_DIMENSION.get(check.category, fv.DEFAULT_DIMENSION)
    return F.struct(
        F.lit(index).alias("index"), F.lit(check.name).alias("test"), F.coalesce(status, F.lit("WARN")).alias("status"),
        F.lit(scoring.dimension_of(check.name, default)).alias("dimension"),
        F.coalesce(outcome.interpretation, F.lit("")).alias("interpretation"), metric.alias("metric"),
    )


def _fixed(status: str, text: str, **metric: str) -> Outcome:
    return Outcome(F.lit(status), F.lit(text), {k: F.lit(v) for k, v in metric.items()})


RESULTS = "index int, test string, status string, dimension string, interpretation string, metric map<string,string>"


def _failed(index: int, check: Check, error: Exception) -> Column:
    text = (str(error).splitlines() or [type(error).__name__])[0]
    return _result(index, check, _fixed("FAIL", f"Exception during execution: {text}", error=text))


def run_checks(ctx: Context, checks: Sequence[Check] = CHECKS) -> DataFrame:
    """Result rows in check order.

    Missing roles give SKIP. A check that cannot be built, or fails while it runs,
    gives FAIL with the reason; the others stand. Batched checks share one pass over
    the table, checks with one plan share its row; a shared pass that fails is taken
    apart to find whose fault it is. Only result rows reach the driver.
    """
    constant: list[Column] = []
    batched: dict[int, tuple[Check, dict[str, Column]]] = {}
    shared: dict[Callable, list[tuple[int, Check]]] = {}
    for index, check in enumerate(checks, 1):
        lacking = [n for n in check.needs if not _present(ctx, n)]
        if lacking:
            constant.append(_result(index, check, _fixed("SKIP", f"No {lacking[0]} for this check.")))
        elif check.measures is not None:
            try:
                measures = check.measures(ctx)
                ctx.df.agg(*[m.alias(n) for n, m in measures.items()]).schema
                batched[index] = (check, measures)
            except Exception as error:  # a broken check must not stop the others
                constant.append(_failed(index, check, error))
        elif check.table is not None:
            shared.setdefault(check.table, []).append((index, check))
        else:
            constant.append(_result(index, check, _fixed("SKIP", "No implementation mapped for this test.")))

    def measured(own: dict[int, tuple[Check, dict[str, Column]]]) -> list:
        columns = {n: m for _, ms in own.values() for n, m in ms.items()}
        return settled(lambda: ctx.df.agg(*[m.alias(n) for n, m in columns.items()]), [(i, c) for i, (c, _) in own.items()], lambda i: measured({i: own[i]}))

    def read(table: Callable, own: list[tuple[int, Check]]) -> list:
        return settled(lambda: table(ctx), own, lambda i: read(table, [x for x in own if x[0] == i]))

    def settled(build: Callable[[], DataFrame], own: list[tuple[int, Check]], alone: Callable[[int], list]) -> list:
        try:
            row = build().select(*[_result(i, c, c.judge(ctx)).alias(f"r{i}") for i, c in own]).first()
            return [row[f"r{i}"] for i, _ in own]
        except Exception as error:
            if len(own) > 1:
                return [r for i, _ in own for r in alone(i)]
            constant.append(_failed(*own[0], error))
            return []

    jobs = [lambda: measured(batched)] * bool(batched) + [lambda t=t, own=own: read(t, own) for t, own in shared.items()]
    with ThreadPoolExecutor(4) as pool:
        rows = [r for found in pool.map(lambda job: job(), jobs) for r in found]
    spark = ctx.df.sparkSession
    if constant:
        rows += [r["r"] for r in spark.range(1).select(F.explode(F.array(*constant)).alias("r")).collect()]
    return spark.createDataFrame(sorted(rows, key=lambda r: r["index"]), RESULTS)


def make_context(
    df: DataFrame, compare: DataFrame | None = None, id_col: str | None = None, time_col: str | None = None,
    target_col: str | None = None, as_of: Column | None = None, max_rows: int | None = None, sample_key: str | None = None,
) -> Context:
    """Trim headers, align with the comparison, check roles, read time columns.

    The row cap is off unless asked for.
    """
    if max_rows is not None:
        df = profile.sample_rows(df, sample_key or df.columns[0], max_rows)
    df = profile.trim_headers(df)
    notes = []
    if compare is not None:
        df, compare = profile.align_columns(df, compare)
        if compare is None:
            notes.append("No shared columns with the comparison; drift checks are skipped.")
    roles, warnings = profile.valid_roles(df, id_col=id_col, time_col=time_col, target_col=target_col)
    time = roles["time_col"]
    if time and not isinstance(df.schema[time].dataType, (TimestampType, TimestampNTZType)):
        df = profile.coerce_dates(df, [time])
    return Context(df, compare, as_of=as_of, warnings=notes + warnings, **roles)


def assess_table(ctx: Context, checks: Sequence[Check] = CHECKS) -> DataFrame:
    """One report row: scores, tier, advice, actions, status counts, and the table's
    size, column roles and warnings."""
    report = report_results(run_checks(ctx, checks))
    roles = F.create_map(*[x for name in ("id_col", "time_col", "target_col") for x in (F.lit(name), F.lit(getattr(ctx, name)).cast("string"))])
    return report.withColumns(
        {
            "n_rows": F.lit(ctx.df.count()).cast("bigint"), "n_columns": F.lit(len(ctx.df.columns)).cast("bigint"), "roles": roles,
            "warnings": F.array(*[F.lit(w) for w in ctx.warnings]).cast("array<string>"),
        }
    )


def report_results(results: DataFrame) -> DataFrame:
    """Report row from result rows, in one aggregate over them."""
    parts = [
        F.coalesce(F.avg(F.when(F.col("dimension") == d, scoring.status_score(F.col("status")))), F.lit(fv.NEUTRAL_SCORE)).alias(d)
        for d in fv.DIMENSIONS
    ]
    counts = [F.count_if(F.col("status") == s).alias(f"n_{s.lower()}") for s in ("PASS", "WARN", "FAIL", "SKIP")]
    listed = F.sort_array(F.collect_list(F.struct("index", "test", "status", "dimension", "interpretation")))
    row = scoring.with_overall(results.agg(*parts, *counts, F.count("*").alias("total_tests"), listed.alias("tests")))
    lines = F.filter("tests", lambda r: r["status"].isin("FAIL", "WARN"))

    def action(name: Column) -> Column:
        out = None
        for words, text in fv.REMEDIATION_KEYWORDS:
            cond = F.lower(name).rlike("|".join(words))
            out = F.when(cond, text) if out is None else out.when(cond, text)
        return out

    actions = F.slice(F.array_distinct(F.array_compact(F.transform(lines, lambda r: action(r["test"])))), 1, 8)
    fixes = F.when(F.size(actions) > 0, actions).otherwise(F.array(F.lit(fv.REMEDIATION_NONE)))

    def first(status: str) -> Column:
        return F.slice(F.filter("tests", lambda r: r["status"] == status), 1, 25)

    return scoring.report(
        row, "tabular",
        {
            "fix_actions": fixes,
            "summary": F.struct("total_tests", *[F.col(f"n_{s}").alias(s) for s in ("pass", "warn", "fail", "skip")]),
            "failed_tests": first("FAIL"), "warning_tests": first("WARN"),
        },
    )


def quality_summary(df: DataFrame) -> DataFrame:
    """Score, tier and dimensions of a batch of rows."""
    return assess_table(make_context(df)).select("overall_score", "quality_tier", "dimension_scores")

