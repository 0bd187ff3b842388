"""Queries: named statistical checks, drift and time order."""

from pyspark.sql import functions as F

from assayer.operators import drift, statistics as st, timeseries as ts
from assayer.plans.registry import Registry
from assayer.plans.tables import load, moment, project, projection_sql, with_sql

QUERIES = Registry()
MEASURES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def rounded(df, *columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _status(x: str, warn: float, fail: float) -> str:
    return f"CASE WHEN {x} > {fail} THEN 'FAIL' WHEN {x} > {warn} THEN 'WARN' ELSE 'PASS' END"


def _lines(spark, d):
    return load(spark, d, "lineitem")


def union(parts) -> str:
    return " UNION ALL ".join(parts)


CATALOG = ("file_hash", "file_type", "quality_score", "confidence", "owner", "extra_owner", "bytes")
QUERIES.add(
    "missingness",
    lambda spark, d: rounded(st.missingness(project(spark, d, "catalog").select(*CATALOG)), "missing_pct"),
    f"WITH src AS ({projection_sql('catalog')}) SELECT \"column\", missing, round(pct, 6) AS missing_pct, {_status('pct', 5, 20)} AS status FROM ("
    + union(f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS missing, 100.0 * (count(*) - count({c})) / count(*) AS pct FROM src" for c in CATALOG) + ")",
)
QUERIES.add(
    "exact_quantiles",
    lambda spark, d: rounded(st.exact_quantiles(_lines(spark, d), MEASURES, (0.05, 0.25, 0.5, 0.75, 0.95)), "q1", "q2", "q3", "q4", "q5"),
    union(
        f"SELECT '{c}' AS \"column\", " + ", ".join(f"round(quantile_cont({c}, {p}), 6) AS q{i}" for i, p in enumerate((0.05, 0.25, 0.5, 0.75, 0.95), 1)) + " FROM lineitem"
        for c in MEASURES
    ),
)


def _iqr_sql(table: str, columns) -> str:
    return f"SELECT \"column\", outliers, round(pct, 6) AS outlier_pct, {_status('pct', 10, 30)} AS status FROM (" + union(
        f"SELECT '{c}' AS \"column\", count(*) FILTER (v < a - 1.5 * (b - a) OR v > b + 1.5 * (b - a)) AS outliers, "
        f"100.0 * count(*) FILTER (v < a - 1.5 * (b - a) OR v > b + 1.5 * (b - a)) / count(*) AS pct FROM (SELECT CAST({c} AS DOUBLE) AS v FROM {table}), "
        f"(SELECT quantile_cont(CAST({c} AS DOUBLE), 0.25) AS a, quantile_cont(CAST({c} AS DOUBLE), 0.75) AS b FROM {table})" for c in columns
    ) + ")"


QUERIES.add("iqr_outliers_lineitem", lambda spark, d: rounded(st.iqr_outliers(_lines(spark, d), MEASURES), "outlier_pct"), _iqr_sql("lineitem", MEASURES))
QUERIES.add(
    "iqr_outliers_documents",
    lambda spark, d: rounded(st.iqr_outliers(load(spark, d, "documents"), ["n_chars"]), "outlier_pct"), _iqr_sql("documents", ["n_chars"]),
)
QUERIES.add(
    "zscore_outliers",
    lambda spark, d: rounded(st.zscore_outliers(load(spark, d, "documents").select("n_chars", "doc_id"), z=2.0), "outlier_pct"),
    f"SELECT \"column\", outliers, round(pct, 6) AS outlier_pct, {_status('pct', 10, 30)} AS status FROM (" + union(
        f"SELECT '{c}' AS \"column\", count(*) FILTER (abs({c} - m) > 2 * sd) AS outliers, 100.0 * count(*) FILTER (abs({c} - m) > 2 * sd) / count(*) AS pct "
        f"FROM documents, (SELECT avg({c}) AS m, stddev_pop({c}) AS sd FROM documents)" for c in ("n_chars", "doc_id")
    ) + ")",
)
QUERIES.add(
    "moments",
    lambda spark, d: rounded(st.moments(_lines(spark, d), MEASURES), "mean", "sd", "skewness", "kurtosis", "jarque_bera", digits=4),
    union(
        f"SELECT '{c}' AS \"column\", n, round(m, 4) AS mean, round(sd, 4) AS sd, round(s, 4) AS skewness, round(k, 4) AS kurtosis, round(n / 6.0 * (s * s + k * k / 4.0), 4) AS jarque_bera FROM ("
        f"SELECT count({c}) AS n, m, sd, avg(power(({c} - m) / sd, 3)) AS s, avg(power(({c} - m) / sd, 4)) - 3 AS k FROM lineitem, (SELECT avg({c}) AS m, stddev_pop({c}) AS sd FROM lineitem) GROUP BY m, sd)"
        for c in MEASURES
    ),
)
QUERIES.add(
    "normality",
    lambda spark, d: st.moments(load(spark, d, "customer"), ["c_acctbal"]).select("column", F.round("jarque_bera", 4).alias("jarque_bera")),
    "SELECT 'c_acctbal' AS \"column\", round(n / 6.0 * (s * s + k * k / 4.0), 4) AS jarque_bera FROM (SELECT count(*) AS n, avg(power((c_acctbal - m) / sd, 3)) AS s, "
    "avg(power((c_acctbal - m) / sd, 4)) - 3 AS k FROM customer, (SELECT avg(c_acctbal) AS m, stddev_pop(c_acctbal) AS sd FROM customer))",
)
PAIRS = [(a, b) for i, a in enumerate(MEASURES) for b in MEASURES[i + 1 :]]
QUERIES.add(
    "correlation_pairs",
    lambda spark, d: rounded(st.correlation_pairs(_lines(spark, d), MEASURES), "r"),
    union(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM lineitem" for a, b in PAIRS),
)
LINKED = ("l_returnflag", "l_linestatus", "l_linenumber", "l_quantity", "l_discount", "l_tax")
_HS = "log2(sum(n)) - sum(n * log2(n)) / sum(n)"
QUERIES.add(
    "dependence_pairs",
    lambda spark, d: rounded(st.dependence_pairs(load(spark, d, "lineitem"), LINKED), "h_a", "h_b", "h_ab", "mutual_information", "share", digits=5),
    "SELECT a, b, round(h_a, 5) AS h_a, round(h_b, 5) AS h_b, round(h_ab, 5) AS h_ab, round(greatest(h_a + h_b - h_ab, 0), 5) AS mutual_information, round(greatest(h_a + h_b - h_ab, 0) / least(h_a, h_b), 5) AS share FROM ("
    + union(
        f"SELECT '{a}' AS a, '{b}' AS b, (SELECT {_HS} FROM (SELECT count(*) AS n FROM lineitem WHERE {b} IS NOT NULL AND {a} IS NOT NULL GROUP BY {a})) AS h_a, "
        f"(SELECT {_HS} FROM (SELECT count(*) AS n FROM lineitem WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY {b})) AS h_b, "
        f"(SELECT {_HS} FROM (SELECT count(*) AS n FROM lineitem WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY {a}, {b})) AS h_ab"
        for i, a in enumerate(LINKED) for b in LINKED[i + 1 :]
    ) + ")",
)
THREE = ("l_quantity", "l_extendedprice", "l_tax")
_R = ", ".join(f"corr({THREE[i]}, {THREE[j]}) AS r{i}{j}" for i, j in ((0, 1), (0, 2), (1, 2)))
_DET = "(1 + 2 * r01 * r02 * r12 - r01 * r01 - r02 * r02 - r12 * r12)"
QUERIES.add(
    "vif",
    lambda spark, d: rounded(st.vif(_lines(spark, d), THREE), "vif"),
    f"SELECT \"column\", round(v, 6) AS vif, {_status('v', 10, 50)} AS status FROM (" + union(
        f"SELECT '{c}' AS \"column\", (1 - {r} * {r}) / {_DET} AS v FROM (SELECT {_R} FROM lineitem)" for c, r in zip(THREE, ("r12", "r02", "r01"))
    ) + ")",
)
_COV = "SELECT avg(l_quantity) AS mx, avg(l_tax) AS my, var_pop(l_quantity) AS a, var_pop(l_tax) AS c, covar_pop(l_quantity, l_tax) AS b FROM lineitem"
QUERIES.add(
    "condition_number",
    lambda spark, d: rounded(st.condition_number(_lines(spark, d), ("l_quantity", "l_tax")), "condition_number", digits=3),
    f"SELECT round(k, 3) AS condition_number, {_status('k', 1e5, 1e8)} AS status FROM (SELECT sqrt(big / small) AS k FROM (SELECT ((a + c) + sqrt((a - c) * (a - c) + 4 * b * b)) / 2 AS big, "
    f"(a * c - b * b) / (((a + c) + sqrt((a - c) * (a - c) + 4 * b * b)) / 2) AS small FROM ({_COV})))",
)
_D2 = "((l_quantity - mx) * (l_quantity - mx) * c - 2 * (l_quantity - mx) * (l_tax - my) * b + (l_tax - my) * (l_tax - my) * a) / (a * c - b * b)"
QUERIES.add(
    "mahalanobis_outliers",
    lambda spark, d: rounded(st.mahalanobis_outliers(_lines(spark, d), ("l_quantity", "l_tax"), 4.5), "outlier_pct"),
    f"SELECT outliers, round(pct, 6) AS outlier_pct, {_status('pct', 10, 30)} AS status FROM (SELECT count(*) FILTER ({_D2} > 4.5) AS outliers, 100.0 * count(*) FILTER ({_D2} > 4.5) / count(*) AS pct FROM lineitem, ({_COV}))",
)


def _hbos_sql(columns, bins: int) -> str:
    parts = []
    for c in columns:
        b = f"least(CAST(floor((v - lo) / (hi - lo) * {bins}) AS BIGINT), {bins - 1})"
        parts.append(
            f"SELECT k, -ln(n / max(n) OVER ()) AS cost FROM (SELECT k, CAST(count(*) OVER (PARTITION BY {b}) AS DOUBLE) AS n FROM "
            f"(SELECT o_orderkey AS k, CAST({c} AS DOUBLE) AS v, min({c}) OVER () AS lo, max({c}) OVER () AS hi FROM orders))"
        )
    return f"SELECT k AS o_orderkey, round(sum(cost), 6) AS hbos FROM ({union(parts)}) GROUP BY k"


QUERIES.add(
    "histogram_outlier_scores",
    lambda spark, d: rounded(st.histogram_scores(load(spark, d, "orders"), "o_orderkey", ("o_totalprice", "o_custkey")), "hbos"),
    _hbos_sql(("o_totalprice", "o_custkey"), 10),
)


def _unique_sql(table: str, keys) -> str:
    k = ", ".join(keys)
    return (
        f"SELECT CAST(sum(n) AS BIGINT) AS rows, count(*) AS distinct_keys, count(*) FILTER (n > 1) AS repeated_keys, CAST(0 AS BIGINT) AS null_keys, "
        f"CASE WHEN count(*) FILTER (n > 1) = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM (SELECT count(*) AS n FROM {table} GROUP BY {k})"
    )


for _name, _table, _keys in (("primary", "orders", ["o_orderkey"]), ("composite", "lineitem", ["l_orderkey", "l_linenumber"])):
    QUERIES.add(f"{_name}_key_uniqueness", lambda spark, d, t=_table, k=_keys: st.key_uniqueness(load(spark, d, t), k), _unique_sql(_table, _keys))
QUERIES.add(
    "null_keys",
    lambda spark, d: st.key_uniqueness(project(spark, d, "catalog"), ["file_type", "category"]),
    with_sql(
        "SELECT count(*) AS rows, count(DISTINCT file_type || category) AS distinct_keys, (SELECT count(*) FROM (SELECT 1 FROM catalog_fx WHERE file_type IS NOT NULL "
        "GROUP BY file_type, category HAVING count(*) > 1)) AS repeated_keys, count(*) FILTER (file_type IS NULL) AS null_keys, 'FAIL' AS status FROM catalog_fx", "catalog",
    ),
)
QUERIES.add(
    "repeated_keys",
    lambda spark, d: st.repeated_keys(_lines(spark, d), ["l_orderkey", "l_linenumber"]),
    "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1",
)
_H = "(SELECT -sum(n / t * log2(n / t)) FROM (SELECT CAST(count(*) AS DOUBLE) AS n, sum(count(*)) OVER () AS t FROM events GROUP BY {k}))"
QUERIES.add(
    "mutual_information",
    lambda spark, d: rounded(st.mutual_information(load(spark, d, "events"), "event_type", "user_id"), "h_a", "h_b", "h_ab", "mutual_information"),
    "SELECT round(a, 6) AS h_a, round(b, 6) AS h_b, round(ab, 6) AS h_ab, round(a + b - ab, 6) AS mutual_information FROM (SELECT "
    + _H.format(k="event_type") + " AS a, " + _H.format(k="user_id") + " AS b, " + _H.format(k="event_type, user_id") + " AS ab)",
)
QUERIES.add(
    "anonymity",
    lambda spark, d: st.anonymity(load(spark, d, "customer"), ["c_nationkey"], "c_mktsegment"),
    "SELECT count(*) AS classes, CAST(min(n) AS BIGINT) AS k_anonymity, min(v) AS l_diversity, count(*) FILTER (n = 1) AS unique_classes FROM "
    "(SELECT count(*) AS n, count(DISTINCT c_mktsegment) AS v FROM customer GROUP BY c_nationkey)",
)
QUERIES.add(
    "target_leakage",
    lambda spark, d: rounded(st.target_leakage(_lines(spark, d).withColumn("net", F.col("l_extendedprice") * 0.9), "l_extendedprice", ["l_quantity", "l_discount", "net"]), "abs_corr"),
    "SELECT \"column\", round(r, 6) AS abs_corr, CASE WHEN r >= 0.99 THEN 'FAIL' ELSE 'PASS' END AS status FROM ("
    + union(f"SELECT '{n}' AS \"column\", abs(corr({e}, l_extendedprice)) AS r FROM lineitem" for n, e in (("l_quantity", "l_quantity"), ("l_discount", "l_discount"), ("net", "l_extendedprice * 0.9"))) + ")",
)
FORMATS = {"c_name": r"Customer#[0-9]{9}", "c_mktsegment": r"[A-Z]+", "c_custkey": r"[0-9]{1,3}"}
QUERIES.add(
    "format_match",
    lambda spark, d: rounded(st.format_match(load(spark, d, "customer"), FORMATS), "match_share"),
    union(f"SELECT '{c}' AS \"column\", round(avg(CAST(regexp_full_match(CAST({c} AS VARCHAR), '{p}') AS INT)), 6) AS match_share FROM customer" for c, p in FORMATS.items()),
)
DECLARED = {"o_orderpriority": "BIGINT", "o_totalprice": "DOUBLE", "o_orderkey": "INT"}
QUERIES.add(
    "type_match_share",
    lambda spark, d: rounded(st.type_match_share(load(spark, d, "orders"), {c: t.lower() for c, t in DECLARED.items()}), "match_share"),
    union(f"SELECT '{c}' AS \"column\", '{t.lower()}' AS declared, round(avg(CAST(TRY_CAST(CAST({c} AS VARCHAR) AS {t}) IS NOT NULL AS INT)), 6) AS match_share FROM orders" for c, t in DECLARED.items()),
)
QUERIES.add(
    "utf8_share",
    lambda spark, d: st.utf8_share(load(spark, d, "documents"), ["text", "lang"]),
    union(f"SELECT '{c}' AS \"column\", avg(CAST({c} IS NOT NULL AS INT)) AS valid_share FROM documents" for c in ("text", "lang")),
)
QUERIES.add(
    "governance_presence",
    lambda spark, d: rounded(
        st.presence(
            project(spark, d, "catalog"),
            {"owner": F.col("owner").isNotNull(), "file_type": F.col("file_type").isNotNull(), "retention": F.col("retention_expires_at").isNotNull(), "price": F.col("ask_price_usd") > 0},
        ), "present_share",
    ),
    with_sql(
        union(
            f"SELECT '{n}' AS field, round(avg(CAST({e} AS INT)), 6) AS present_share FROM catalog_fx"
            for n, e in (("owner", "owner IS NOT NULL"), ("file_type", "file_type IS NOT NULL"), ("retention", "retention_expires_at IS NOT NULL"), ("price", "ask_price_usd > 0"))
        ), "catalog",
    ),
)

# --------------------------------------------------------------------- drift


def _sides(spark, d):
    lines = _lines(spark, d)
    return lines.filter("l_returnflag = 'A'"), lines.filter("l_returnflag = 'R'")


EDGES = [float(x) for x in range(10000, 100001, 10000)]
_BIN = " + ".join(f"CAST(l_extendedprice > {e} AS INT)" for e in EDGES)


def _share_sql(value: str) -> str:
    """(v, p, q) shares of both samples."""
    return (
        f"SELECT v, count(*) FILTER (l_returnflag = 'A') / (SELECT CAST(count(*) AS DOUBLE) FROM lineitem WHERE l_returnflag = 'A') AS p, "
        f"count(*) FILTER (l_returnflag = 'R') / (SELECT CAST(count(*) AS DOUBLE) FROM lineitem WHERE l_returnflag = 'R') AS q "
        f"FROM (SELECT {value} AS v, l_returnflag FROM lineitem WHERE l_returnflag IN ('A', 'R')) GROUP BY v"
    )


QUERIES.add(
    "psi_drift",
    lambda spark, d: rounded(drift.psi(*_sides(spark, d), "l_extendedprice", EDGES), "psi"),
    "SELECT round(psi, 6) AS psi, CASE WHEN psi > 0.25 THEN 'FAIL' WHEN psi > 0.1 THEN 'WARN' ELSE 'PASS' END AS status FROM (SELECT sum((greatest(q, 1e-4) - greatest(p, 1e-4)) "
    f"* ln(greatest(q, 1e-4) / greatest(p, 1e-4))) AS psi FROM ({_share_sql(_BIN)}))",
)


def _psi_deciles(spark, d):
    a, b = _sides(spark, d)
    return drift.psi(a, b, "l_extendedprice", drift.quantile_edges(a, "l_extendedprice"))


_DECILES = "(SELECT " + ", ".join(f"quantile_cont(l_extendedprice, {i / 10}) AS e{i}" for i in range(1, 10)) + " FROM lineitem WHERE l_returnflag = 'A')"
_BY_DECILE = _share_sql(" + ".join(f"CAST(l_extendedprice > e{i} AS INT)" for i in range(1, 10))).replace("l_returnflag FROM lineitem WHERE l_returnflag IN", f"l_returnflag FROM lineitem, {_DECILES} WHERE l_returnflag IN")
QUERIES.add(
    "psi_drift_deciles", lambda spark, d: rounded(_psi_deciles(spark, d), "psi"),
    "SELECT round(psi, 6) AS psi, CASE WHEN psi > 0.25 THEN 'FAIL' WHEN psi > 0.1 THEN 'WARN' ELSE 'PASS' END AS status FROM (SELECT sum((greatest(q, 1e-4) - greatest(p, 1e-4)) "
    f"* ln(greatest(q, 1e-4) / greatest(p, 1e-4))) AS psi FROM ({_BY_DECILE}))",
)
_DIST = (
    "SELECT round(sqrt(greatest(0.0, 1.0 - sum(sqrt(p * q)))), 6) AS hellinger, round(sum(abs(p - q)) / 2, 6) AS total_variation, "
    "round(sum((CASE WHEN p > 0 THEN p * ln(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * ln(q / ((p + q) / 2)) ELSE 0 END) / 2), 6) AS jensen_shannon, "
    "round(sum(CASE WHEN p > 0 THEN p * ln(p / greatest(q, 1e-12)) ELSE 0 END), 6) AS kullback_leibler FROM ({s})"
)
for _name, _expr, _sql in (("linenumber", lambda: F.col("l_linenumber"), "l_linenumber"), ("supplier", lambda: F.col("l_suppkey"), "l_suppkey")):
    QUERIES.add(
        f"share_distances_{_name}",
        lambda spark, d, e=_expr: rounded(drift.share_distances(*_sides(spark, d), e()), "hellinger", "total_variation", "jensen_shannon", "kullback_leibler"),
        _DIST.format(s=_share_sql(_sql)),
    )
QUERIES.add(
    "cdf_distances",
    lambda spark, d: rounded(drift.cdf_distances(*_sides(spark, d), "l_extendedprice"), "wasserstein", "energy_distance", "kolmogorov_smirnov", digits=4),
    "SELECT round(sum(coalesce((nv - v) * abs(f - g), 0)), 4) AS wasserstein, round(2 * sum(coalesce((nv - v) * (f - g) * (f - g), 0)), 4) AS energy_distance, round(max(abs(f - g)), 4) AS kolmogorov_smirnov FROM "
    f"(SELECT v, lead(v) OVER (ORDER BY v) AS nv, sum(p) OVER (ORDER BY v) AS f, sum(q) OVER (ORDER BY v) AS g FROM ({_share_sql('l_extendedprice')}))",
)
QUERIES.add(
    "cdf_distances_quantity",
    lambda spark, d: rounded(drift.cdf_distances(*_sides(spark, d), "l_quantity"), "wasserstein", "energy_distance", "kolmogorov_smirnov", digits=4),
    "SELECT round(sum(coalesce((nv - v) * abs(f - g), 0)), 4) AS wasserstein, round(2 * sum(coalesce((nv - v) * (f - g) * (f - g), 0)), 4) AS energy_distance, round(max(abs(f - g)), 4) AS kolmogorov_smirnov FROM "
    f"(SELECT v, lead(v) OVER (ORDER BY v) AS nv, sum(p) OVER (ORDER BY v) AS f, sum(q) OVER (ORDER BY v) AS g FROM ({_share_sql('l_quantity')}))",
)


def _years(spark, d):
    orders = load(spark, d, "orders")
    return orders.filter("o_orderdate < '1997-01-01'"), orders.filter("o_orderdate >= '1997-01-01'")


_EARLY, _LATE = "SELECT DISTINCT o_custkey FROM orders WHERE o_orderdate < '1997-01-01'", "SELECT DISTINCT o_custkey FROM orders WHERE o_orderdate >= '1997-01-01'"
QUERIES.add(
    "category_coverage",
    lambda spark, d: rounded(drift.category_coverage(*_years(spark, d), "o_custkey"), "coverage"),
    f"SELECT count(*) AS baseline_categories, count(*) FILTER (o_custkey IN ({_LATE})) AS covered, round(count(*) FILTER (o_custkey IN ({_LATE})) / count(*), 6) AS coverage FROM ({_EARLY})",
)
QUERIES.add("uncovered_categories", lambda spark, d: drift.uncovered_categories(*_years(spark, d), "o_custkey"), f"{_EARLY} EXCEPT {_LATE}")
QUERIES.add(
    "row_overlap",
    lambda spark, d: rounded(
        drift.row_overlap(load(spark, d, "documents").select("lang", "text"), load(spark, d, "documents").filter("source < 's5'").select("lang", "text")), "overlap_share"
    ),
    "SELECT count(*) AS rows, count(*) FILTER (hit) AS overlapping_rows, round(count(*) FILTER (hit) / count(*), 6) AS overlap_share FROM "
    "(SELECT EXISTS (SELECT 1 FROM documents b WHERE b.source < 's5' AND b.lang = a.lang AND b.text = a.text) AS hit FROM documents a)",
)
QUERIES.add(
    "benchmark_overlap",
    lambda spark, d: rounded(drift.row_overlap(load(spark, d, "documents").select("text"), load(spark, d, "benchmark").select("text")), "overlap_share"),
    "SELECT count(*) AS rows, count(*) FILTER (text IN (SELECT text FROM benchmark)) AS overlapping_rows, round(count(*) FILTER (text IN (SELECT text FROM benchmark)) / count(*), 6) AS overlap_share FROM documents",
)

# ---------------------------------------------------------------- time order


def _events(spark, d):
    return load(spark, d, "events")


QUERIES.add(
    "time_gaps",
    lambda spark, d: rounded(ts.time_gaps(_events(spark, d), ["user_id"], "ts", "event_id", 43200.0), "max_gap", "late_share"),
    "SELECT user_id, count(*) AS events, round(max(gap), 6) AS max_gap, round(avg(CAST(gap > 43200 AS INT)), 6) AS late_share FROM (SELECT user_id, "
    "(epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 1e6 AS gap FROM events) GROUP BY user_id",
)
QUERIES.add(
    "time_gaps_overall",
    lambda spark, d: rounded(ts.time_gaps(_events(spark, d), [], "ts", "event_id", 600.0), "max_gap", "late_share"),
    "SELECT count(*) AS events, round(max(gap), 6) AS max_gap, round(avg(CAST(gap > 600 AS INT)), 6) AS late_share FROM "
    "(SELECT (epoch_us(ts) - lag(epoch_us(ts)) OVER (ORDER BY ts, event_id)) / 1e6 AS gap FROM events)",
)
QUERIES.add(
    "arrival_order",
    lambda spark, d: ts.arrival_order(load(spark, d, "orders"), "o_orderkey", "o_orderdate"),
    "SELECT count(*) AS rows, count(*) FILTER (o_orderdate < before) AS out_of_order FROM (SELECT o_orderdate, lag(o_orderdate) OVER (ORDER BY o_orderkey) AS before FROM orders)",
)
QUERIES.add(
    "time_freshness",
    lambda spark, d: ts.freshness(_events(spark, d), "ts", moment("2026-06-08")).select(F.round("age_days", 6).alias("age_days")),
    "SELECT round((epoch_us(TIMESTAMP '2026-06-08') - epoch_us(max(ts))) / 86400e6, 6) AS age_days FROM events",
)
for _lag in (1, 3):
    QUERIES.add(
        f"autocorrelation_lag{_lag}",
        lambda spark, d, k=_lag: rounded(ts.autocorrelation(_events(spark, d), ["user_id"], "ts", "event_id", "value", k), "autocorrelation"),
        f"SELECT user_id, count(*) AS pairs, round(corr(value, before), 6) AS autocorrelation FROM (SELECT user_id, value, lag(value, {_lag}) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before, "
        f"row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events) WHERE rn > {_lag} GROUP BY user_id",
    )
QUERIES.add(
    "change_point",
    lambda spark, d: rounded(ts.change_point(_events(spark, d), ["event_type"], "ts", "event_id", "value"), "max_cusum", digits=4),
    "SELECT event_type, count(*) AS events, round(max(c), 4) AS max_cusum, arg_max(rn, c) AS position FROM (SELECT event_type, rn, abs(s - rn * m) AS c FROM (SELECT event_type, "
    "row_number() OVER w AS rn, sum(value) OVER w AS s, avg(value) OVER (PARTITION BY event_type) AS m FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id))) GROUP BY event_type",
)
