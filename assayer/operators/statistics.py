"""Named statistical checks on one table."""

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from assayer import fixed_values as fv
from assayer.functions.gram import cross_products
from assayer.functions.keys import missing, value_key
from assayer.functions.literal import literal_table
from assayer.functions.numeric import correlation, share_status
from assayer.functions.ordered import with_running_sums
from assayer.operators.profile import numeric_columns
from assayer.session import spread


def missingness(df: DataFrame, limits=fv.MISSING_PCT) -> DataFrame:
    """Missing share and status per column, from one aggregate."""
    fields = df.schema.fields
    row = df.agg(F.count("*").alias("n"), *[F.count_if(missing(f)).alias(f"m{i}") for i, f in enumerate(fields)])
    rows = [F.struct(F.lit(f.name).alias("column"), F.col(f"m{i}").alias("missing")) for i, f in enumerate(fields)]
    pct = F.try_divide(100.0 * F.col("missing"), F.col("n"))
    return row.select("n", F.inline(F.array(*rows))).select(
        "column", "missing", pct.alias("missing_pct"), share_status(pct, limits).alias("status")
    )


def numeric_long(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value) rows of numeric columns without missing values."""
    doubles = df.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in columns])
    long = doubles.unpivot([], list(columns), "column", "value")
    return long.filter(F.col("value").isNotNull() & ~F.isnan("value"))


#: Size of a rank sketch, and the share of ranks on either side of a wanted one that
#: is looked at exactly; about three times the error such a sketch usually has.
SKETCH, MARGIN = 2048, 0.004


def _doubles(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The columns as doubles; read several times, so small inputs are spread."""
    return spread(df.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in columns]), *columns)


def rank_sketches(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, n, sketch): a mergeable rank sketch of each column, from one wide pass.

    Sketches of parts of a table merge with ``kll_merge_agg_double``, so they can be
    kept with a table instead of being read again.
    """
    row = df.agg(*[F.struct(F.lit(c).alias("column"), F.count(number(c)).alias("n"), F.kll_sketch_agg_double(number(c), F.lit(SKETCH)).alias("sketch")).alias(f"s{i}") for i, c in enumerate(columns)])
    return row.select(F.inline(F.array(*[f"s{i}" for i in range(len(columns))])))


def exact_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float] = (0.25, 0.75)) -> DataFrame:
    """(column, q1, q2, ...): linear-interpolated quantiles, exact at any size."""
    return _quantiles(_doubles(df, columns), columns, probs)


def _quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """Quantiles by rank sketches that leave a narrow bracket for each.

    One wide pass makes the sketches, one counts the rows below the brackets, one
    counts the values inside, which are put in order in pieces. Should a rank lie
    outside its bracket, the brackets are widened: the result is exact. Only
    brackets and results, numbers per column, reach the driver.
    """
    sketches = rank_sketches(df, columns).where("n > 0")
    margin, found = MARGIN, {}
    while True:
        ranks = [min(1.0, max(0.0, p + side)) for p in probs for side in (-margin, margin)]
        ends = F.kll_sketch_get_quantile_double("sketch", F.array(*[F.lit(r) for r in ranks]))
        brackets = {r.column: (r.n, list(zip(r.ends[::2], r.ends[1::2], strict=True))) for r in sketches.select("column", "n", ends.alias("ends")).collect() if r.column not in found}
        found |= _selected(df, brackets, probs) if brackets else {}
        if set(found) >= set(brackets):
            break
        margin *= 16
    names = ["column", *[f"q{i}" for i in range(1, len(probs) + 1)]]
    rows = [(c, *found[c]) for c in columns if c in found]
    return literal_table(df.sparkSession, names, rows) if rows else df.sparkSession.createDataFrame([], "column string, " + ", ".join(f"{n} double" for n in names[1:]))


def _selected(df: DataFrame, brackets: dict[str, tuple[int, list[tuple[float, float]]]], probs: Sequence[float]) -> dict[str, list[float]]:
    """Quantiles of the columns whose ranks all lie in their brackets."""
    spots = [(c, j, lo, hi) for c, (_, ends) in brackets.items() for j, (lo, hi) in enumerate(ends)]
    below = df.agg(*[F.count_if(number(c) < lo).alias(f"b{k}") for k, (c, _, lo, _) in enumerate(spots)]).first()
    inside = [F.when(number(c).between(lo, hi), F.struct(F.lit(k).alias("spot"), number(c).alias("value"))) for k, (c, _, lo, hi) in enumerate(spots)]
    counts = df.select(F.inline(F.filter(F.array(*inside), lambda x: x.isNotNull()))).groupBy("spot", "value").agg(F.count("*").alias("n"))
    ordered = with_running_sums(counts, ["spot"], ["value"], {"seen": F.col("n")})
    wanted = []
    for k, (c, j, _, _) in enumerate(spots):
        rank = (brackets[c][0] - 1) * probs[j]
        wanted += [(k, side, int(at) - below[k]) for side, at in enumerate((np.floor(rank), np.ceil(rank)))]
    ranks = literal_table(df.sparkSession, ["spot", "side", "at"], wanted)
    hits = ordered.join(F.broadcast(ranks), "spot").where("seen - n <= at and at < seen").select("spot", "side", "value").collect()
    values = {(r.spot, r.side): r.value for r in hits}
    out: dict[str, list[float]] = {}
    for k, (c, j, _, _) in enumerate(spots):
        rank = (brackets[c][0] - 1) * probs[j]
        low, high = values.get((k, 0)), values.get((k, 1))
        out.setdefault(c, []).append(None if low is None or high is None else low + (high - low) * (rank - np.floor(rank)))
    return {c: [float(x) for x in q] for c, q in out.items() if None not in q}


def iqr_outliers(df: DataFrame, columns: Sequence[str] | None = None, limits=fv.OUTLIER_PCT) -> DataFrame:
    """Share of values outside the 1.5 IQR fences per column. The quartile table
    has one row per column."""
    columns = list(columns or numeric_columns(df))
    df = _doubles(df, columns)
    quartiles = _quantiles(df, columns, (0.25, 0.75))
    fence = (F.col("q2") - F.col("q1")) * 1.5
    outside = (F.col("value") < F.col("q1") - fence) | (F.col("value") > F.col("q2") + fence)
    joined = numeric_long(df, columns).join(F.broadcast(quartiles), "column")
    pct = 100.0 * F.count_if(outside) / F.count("*")
    out = joined.groupBy("column").agg(F.count_if(outside).alias("outliers"), pct.alias("outlier_pct"))
    return out.withColumn("status", share_status(F.col("outlier_pct"), limits))


def zscore_outliers(df: DataFrame, columns: Sequence[str] | None = None, z: float = 3.0, limits=fv.OUTLIER_PCT) -> DataFrame:
    columns = list(columns or numeric_columns(df))
    long = numeric_long(df, columns)
    moments = long.groupBy("column").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"))
    outside = F.abs(F.col("value") - F.col("mean")) > F.col("sd") * z
    pct = 100.0 * F.count_if(outside) / F.count("*")
    out = long.join(F.broadcast(moments), "column").groupBy("column").agg(F.count_if(outside).alias("outliers"), pct.alias("outlier_pct"))
    return out.withColumn("status", share_status(F.col("outlier_pct"), limits))


def moments(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Skewness, excess kurtosis and Jarque-Bera per column, one pass."""
    columns = list(columns or numeric_columns(df))
    n, s, k = F.count("value"), F.skewness("value"), F.kurtosis("value")
    return numeric_long(df, columns).groupBy("column").agg(
        n.alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"),
        s.alias("skewness"), k.alias("kurtosis"), (n / 6.0 * (s * s + k * k / 4.0)).alias("jarque_bera"),
    )


def number(c: str) -> Column:
    """A column as double; not-a-number counts as missing."""
    return F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None).cast("double"))


def correlation_pairs(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Pearson correlation of each column pair, each over the rows that have both.
    Pairs without two different values have none."""
    columns = list(columns or numeric_columns(df))
    r = cross_products(df, columns).correlation()
    rows = [(a, b, float(r[i, j]) if np.isfinite(r[i, j]) else None) for i, a in enumerate(columns) for j, b in enumerate(columns) if i < j]
    return df.sparkSession.createDataFrame(rows, "a string, b string, r double")


def covariance(df: DataFrame, columns: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Mean vector and population covariance; rows with a missing value count for no
    pair, so the matrix stays consistent."""
    cross = cross_products(df, columns, whole=True)
    with np.errstate(divide="ignore", invalid="ignore"):
        return cross.shift + np.diag(cross.sums) / np.diag(cross.n), cross.covariance()


def vif(df: DataFrame, columns: Sequence[str], limits=fv.VIF_LIMITS) -> DataFrame:
    """Variance inflation factor per column: diagonal of the inverse correlation
    matrix. A constant column, or any column without whole rows, has none."""
    _, cov = covariance(df, columns)
    sd = np.sqrt(np.diag(cov))
    vary = np.flatnonzero(np.isfinite(sd) & (sd > 0))
    values = np.full(len(columns), np.nan)
    values[vary] = np.diag(np.linalg.pinv((cov / np.outer(np.where(sd > 0, sd, 1), np.where(sd > 0, sd, 1)))[np.ix_(vary, vary)]))
    table = literal_table(df.sparkSession, ["column", "vif"], [(c, float(v)) for c, v in zip(columns, values)])
    table = table.withColumn("vif", F.nanvl("vif", F.lit(None).cast("double")))
    return table.withColumn("status", share_status(F.col("vif"), limits))


def condition_number(df: DataFrame, columns: Sequence[str], limits=fv.CONDITION_LIMITS) -> DataFrame:
    """Ratio of the largest to the smallest singular value of the centred data."""
    _, cov = covariance(df, columns)
    singular = np.linalg.svd(cov, compute_uv=False)
    value = float(np.sqrt(singular[0] / singular[-1])) if singular[-1] > 0 else float("inf")
    table = literal_table(df.sparkSession, ["condition_number"], [(value,)])
    return table.withColumn("status", share_status(F.col("condition_number"), limits))


def mahalanobis(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows with ``distance2``: squared Mahalanobis distance; null where a value is
    missing. Rows are multiplied with the inverse in batches."""
    mean, cov = covariance(df, columns)
    if not np.isfinite(cov).all():
        return df.withColumn("distance2", F.lit(None).cast("double"))
    inverse, size = np.linalg.pinv(cov), len(columns)

    @F.arrow_udf("double")
    def distance(values: pa.Array) -> pa.Array:
        x = values.flatten().to_numpy(zero_copy_only=False).reshape(-1, size) - mean
        found = np.einsum("ni,ij,nj->n", x, inverse, x, optimize=True)
        return pa.array(found, pa.float64(), mask=np.isnan(found))

    blank = F.lit(float("nan"))
    return df.withColumn("distance2", distance(F.array(*[F.coalesce(F.col(f"`{c}`").cast("double"), blank) for c in columns])))


def mahalanobis_outliers(df: DataFrame, columns: Sequence[str], cutoff: float, limits=fv.OUTLIER_PCT) -> DataFrame:
    far = F.col("distance2") > cutoff
    pct = F.try_divide(100.0 * F.count_if(far), F.count("distance2"))
    out = mahalanobis(df, columns).agg(F.count_if(far).alias("outliers"), pct.alias("outlier_pct"))
    return out.withColumn("status", share_status(F.col("outlier_pct"), limits))


def histogram_scores(df: DataFrame, key: str, columns: Sequence[str], bins: int = 10) -> DataFrame:
    """Histogram-based outlier score per row: sum of -ln(bin height / tallest bin).

    The bin costs, ``bins`` numbers per column, reach each row as one constant
    struct of maps, so the rows themselves are never shuffled.
    """
    num = number
    limits = df.agg(F.struct(*[F.struct(F.min(num(c)).alias("lo"), F.max(num(c)).alias("hi")).alias(c) for c in columns]).alias("b"))

    def bin_of(c: str) -> Column:
        lo, hi = F.col(f"__b.`{c}`.lo"), F.col(f"__b.`{c}`.hi")
        at = F.least(F.floor((num(c) - lo) / (hi - lo) * bins), F.lit(bins - 1))
        return F.when(num(c).isNotNull(), F.when(hi > lo, at).otherwise(0))

    binned = df.withColumn("__b", limits.scalar()).select(F.col(key), *[bin_of(c).alias(f"__bin{i}") for i, c in enumerate(columns)])
    names = [f"__bin{i}" for i in range(len(columns))]
    heights = binned.select(*names).unpivot([], names, "column", "bin").filter("bin IS NOT NULL").groupBy("column", "bin").agg(F.count("*").alias("n"))
    lists = heights.groupBy("column").agg(F.max("n").alias("top"), F.collect_list(F.struct("bin", "n")).alias("l"))
    costs = lists.select("column", F.map_from_entries(F.transform("l", lambda e: F.struct(e["bin"], -F.log(e["n"] / F.col("top"))))).alias("m"))
    table = costs.agg(F.map_from_entries(F.collect_list(F.struct("column", "m"))).alias("t"))
    total = F.lit(0.0)
    for name in names:
        total = total + F.coalesce(F.col("__t")[name][F.col(name)], F.lit(0.0))
    return binned.withColumn("__t", table.scalar()).select(key, total.alias("hbos"))


def key_uniqueness(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows, distinct keys, repeated keys and null keys, with a status."""
    fields = {f.name: f for f in df.schema.fields}
    filled = None
    for k in keys:
        cond = F.col(f"`{k}`").isNotNull()
        filled = cond if filled is None else filled & cond
    groups = df.groupBy(*[value_key(fields[k]).alias(k) for k in keys], filled.alias("__filled")).agg(F.count("*").alias("n"))
    out = groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.count_if("__filled").alias("distinct_keys"),
        F.count_if(F.col("__filled") & (F.col("n") > 1)).alias("repeated_keys"),
        F.coalesce(F.sum(F.when(~F.col("__filled"), F.col("n"))), F.lit(0)).alias("null_keys"),
    )
    return out.withColumn("status", F.when((F.col("repeated_keys") == 0) & (F.col("null_keys") == 0), "PASS").otherwise("FAIL"))


def repeated_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def class_balance(df: DataFrame, target: str) -> DataFrame:
    """Min/max class share and normalised entropy; neutral 70 for one class."""
    counts = df.filter(F.col(target).isNotNull()).groupBy(target).agg(F.count("*").alias("n"))
    n = F.col("n").cast("double")
    total = F.sum(n)
    ratio = F.min(n) / F.max(n)
    with_total = counts.agg(
        F.count("*").alias("classes"), ratio.alias("ratio"),
        (F.log2(total) - F.sum(n * F.log2(n)) / total).alias("bits"),
    )
    several = F.col("classes") > 1
    entropy = F.col("bits") / F.log2(F.col("classes").cast("double"))
    return with_total.select(
        "classes",
        F.when(several, F.col("ratio")).alias("minority_majority_ratio"),
        F.when(several, entropy).alias("normalized_entropy"),
        F.when(several, 100.0 * (F.col("ratio") + entropy) / 2).otherwise(fv.NEUTRAL_SCORE).alias("balance"),
    )


def class_parity(df: DataFrame, target: str) -> DataFrame:
    """Prevalence parity of the labels with its status (PASS from one half on)."""
    counts = df.filter(F.col(target).isNotNull()).groupBy(target).agg(F.count("*").alias("n"))
    out = counts.agg((F.min("n") / F.max("n")).alias("prevalence_parity"))
    p = F.col("prevalence_parity")
    return out.withColumn("status", F.when(p.isNull(), "SKIP").when(p >= 0.5, "PASS").otherwise("WARN"))


def mutual_information(df: DataFrame, a: str, b: str) -> DataFrame:
    """Entropies and mutual information in bits, from joint counts.

    Marginals come from grouping the joint counts again, so no group is ever
    gathered for a window.
    """
    joint = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").cast("double").alias("n"))

    def spread(counts: DataFrame, name: str) -> DataFrame:
        total = F.sum("n")
        return counts.agg((F.log2(total) - F.sum(F.col("n") * F.log2("n")) / total).alias(name))

    out = spread(joint, "h_ab").withColumns(
        {
            "h_a": spread(joint.groupBy("a").agg(F.sum("n").alias("n")), "h").scalar(),
            "h_b": spread(joint.groupBy("b").agg(F.sum("n").alias("n")), "h").scalar(),
        }
    )
    return out.select("h_a", "h_b", "h_ab", (F.col("h_a") + F.col("h_b") - F.col("h_ab")).alias("mutual_information"))


def dependence_pairs(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Entropies, mutual information in bits and its share of the smaller entropy for
    every pair of columns, over the rows that have both.

    One pass counts the joint values of all pairs; grouping sets over these counts
    give the marginals. Counts are taken before rows meet, so a hot value is one row
    per task. A pair without common rows has nulls.
    """
    columns, fields = list(columns), {f.name: f for f in df.schema.fields}
    values = [F.struct(F.lit(i).alias("c"), value_key(fields[c]).cast("string").alias("v")) for i, c in enumerate(columns)]
    row = df.select(F.filter(F.array(*values), lambda x: x["v"].isNotNull()).alias("x"))
    later = lambda x, i: F.transform(F.slice("x", i + 2, F.size("x")), lambda y: F.struct(x["c"].alias("i"), y["c"].alias("j"), x["v"].alias("va"), y["v"].alias("vb")))
    joint = row.select(F.inline(F.flatten(F.transform("x", later)))).groupBy("i", "j", "va", "vb").agg(F.count("*").cast("double").alias("n"))
    pair = [F.col("i"), F.col("j")]
    sets = joint.groupingSets([[*pair, F.col("va"), F.col("vb")], [*pair, F.col("va")], [*pair, F.col("vb")]], "i", "j", "va", "vb").agg(F.sum("n").alias("n"), F.grouping_id().alias("kind"))
    total = F.sum("n")
    spread = sets.groupBy("i", "j").pivot("kind", [0, 1, 2]).agg(F.log2(total) - F.sum(F.col("n") * F.log2("n")) / total)
    names = df.sparkSession.createDataFrame([(i, j, a, b) for i, a in enumerate(columns) for j, b in enumerate(columns) if i < j], "i int, j int, a string, b string")
    found = names.join(spread, ["i", "j"], "left").select("a", "b", F.col("1").alias("h_a"), F.col("2").alias("h_b"), F.col("0").alias("h_ab"))
    both = F.greatest(F.col("h_a") + F.col("h_b") - F.col("h_ab"), F.lit(0.0))
    return found.withColumn("mutual_information", both).withColumn("share", F.try_divide("mutual_information", F.least("h_a", "h_b")))


def anonymity(df: DataFrame, quasi: Sequence[str], sensitive: str) -> DataFrame:
    """k-anonymity and l-diversity over quasi-identifiers.

    Distinct sensitive values are counted per (class, value) pair, so a huge
    class is not gathered in one place.
    """
    pairs = df.groupBy(*quasi, F.col(sensitive).alias("__s")).agg(F.count("*").alias("n"))
    classes = pairs.groupBy(*quasi).agg(F.sum("n").alias("size"), F.count("__s").alias("values"))
    return classes.agg(
        F.count("*").alias("classes"), F.min("size").alias("k_anonymity"),
        F.min("values").alias("l_diversity"), F.count_if(F.col("size") == 1).alias("unique_classes"),
    )


def target_leakage(df: DataFrame, target: str, columns: Sequence[str], bound: float = 0.99) -> DataFrame:
    """|correlation| of each feature with the target; close to one is a leak."""
    row = df.agg(*[correlation(number(c), number(target)).alias(f"r{i}") for i, c in enumerate(columns)])
    rows = [F.struct(F.lit(c).alias("column"), F.abs(F.col(f"r{i}")).alias("abs_corr")) for i, c in enumerate(columns)]
    r = F.col("abs_corr")
    return row.select(F.inline(F.array(*rows))).withColumn("status", F.when(r.isNull(), "SKIP").when(r >= bound, "FAIL").otherwise("PASS"))


def format_match(df: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """Share of filled values of each column that match its pattern entirely."""
    row = df.agg(
        *[
            F.avg(F.col(f"`{c}`").cast("string").rlike(rf"\A(?:{p})\z").cast("double")).alias(f"s{i}")
            for i, (c, p) in enumerate(patterns.items())
        ]
    )
    rows = [F.struct(F.lit(c).alias("column"), F.col(f"s{i}").alias("match_share")) for i, c in enumerate(patterns)]
    return row.select(F.inline(F.array(*rows)))


def type_match_share(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Share of filled values of each column that cast to the declared type."""
    row = df.agg(
        *[
            F.avg(F.when(F.col(f"`{c}`").isNotNull(), F.col(f"`{c}`").cast("string").try_cast(t).isNotNull().cast("double"))).alias(f"s{i}")
            for i, (c, t) in enumerate(types.items())
        ]
    )
    rows = [F.struct(F.lit(c).alias("column"), F.lit(t).alias("declared"), F.col(f"s{i}").alias("match_share")) for i, (c, t) in enumerate(types.items())]
    return row.select(F.inline(F.array(*rows)))


def utf8_share(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    row = df.agg(*[F.avg(F.is_valid_utf8(F.col(f"`{c}`")).cast("double")).alias(f"s{i}") for i, c in enumerate(columns)])
    rows = [F.struct(F.lit(c).alias("column"), F.col(f"s{i}").alias("valid_share")) for i, c in enumerate(columns)]
    return row.select(F.inline(F.array(*rows)))


def presence(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Share of rows in which each governance field is present."""
    row = df.agg(*[F.avg(cond.cast("double")).alias(f"s{i}") for i, cond in enumerate(columns.values())])
    rows = [F.struct(F.lit(c).alias("field"), F.col(f"s{i}").alias("present_share")) for i, c in enumerate(columns)]
    return row.select(F.inline(F.array(*rows)))
