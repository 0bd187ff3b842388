"""Queries: check results, dimension scores, advice, and text corpora."""

from pyspark.sql import functions as F

from assayer import fixed_values as fv
from assayer.functions import numeric, text as tx
from assayer.operators import checks, scoring, textcorpus
from assayer.operators.statistics import class_balance, class_parity
from assayer.plans import sqltext as q
from assayer.plans.registry import Registry
from assayer.plans.tables import load, moment, project, with_sql

QUERIES = Registry()


def _results(spark, d):
    """Check results projected from the events table."""
    return scoring.check_dimensions(project(spark, d, "checks"))


BY_CATEGORY = "CASE category " + " ".join(f"WHEN {q.quote(c)} THEN {q.quote(v)}" for c, v in fv.CHECK_CATEGORY_DIMENSION.items()) + " ELSE 'Validity' END"
DIMENSION = q.first_group("lower(test)", fv.DIMENSION_KEYWORDS) + f" ELSE {BY_CATEGORY} END"
RESULTS = f'SELECT "index", test, category, status, {DIMENSION} AS dimension FROM checks_fx'
SCORE = "CASE status WHEN 'PASS' THEN 100.0 WHEN 'WARN' THEN 70.0 WHEN 'FAIL' THEN 20.0 ELSE 70.0 END"
DIMS = "(VALUES " + ", ".join(f"({i}, '{d}', {fv.DIMENSION_WEIGHTS[d]})" for i, d in enumerate(fv.DIMENSIONS, 1)) + ") dims(ord, dimension, weight)"
SCORES = (
    f"SELECT ord, dims.dimension AS dimension, CAST(weight AS DOUBLE) AS weight, CAST(coalesce(avg({SCORE}) FILTER (r.status IS NOT NULL), 70.0) AS DOUBLE) AS score "
    f"FROM {DIMS} LEFT JOIN ({RESULTS}) r ON r.dimension = dims.dimension GROUP BY ALL"
)
OVERALL = "sum(score * weight) / sum(weight)"


def _tier(x: str) -> str:
    return f"CASE WHEN {x} >= 85 THEN 'Excellent' WHEN {x} >= 70 THEN 'Good' WHEN {x} >= 55 THEN 'Fair' ELSE 'Poor' END"


QUERIES.add(
    "check_dimensions",
    lambda spark, d: _results(spark, d).select("index", "test", "category", "status", "dimension"),
    with_sql(RESULTS, "checks"),
)
QUERIES.add(
    "keyword_override",
    lambda spark, d: project(spark, d, "checks").groupBy(scoring.keyword_dimension(F.col("test"), F.lit("Validity")).alias("dimension")).agg(F.count("*").alias("n")),
    with_sql(f"SELECT {q.first_group('lower(test)', fv.DIMENSION_KEYWORDS)} ELSE 'Validity' END AS dimension, count(*) AS n FROM checks_fx GROUP BY ALL", "checks"),
)
QUERIES.add(
    "dimension_scores",
    lambda spark, d: scoring.dimension_scores(_results(spark, d)).withColumn("score", F.round("score", 6)),
    with_sql(f"SELECT ord, dimension, round(score, 6) AS score FROM ({SCORES})", "checks"),
)
QUERIES.add(
    "overall_score",
    lambda spark, d: scoring.overall_score(scoring.dimension_scores(_results(spark, d))).select("overall_score", "quality_tier"),
    with_sql(f"SELECT {q.py_round(OVERALL, 2)} AS overall_score, {_tier(OVERALL)} AS quality_tier FROM ({SCORES})", "checks"),
)
QUERIES.add(
    "status_counts",
    lambda spark, d: scoring.status_counts(_results(spark, d)),
    with_sql(
        "SELECT count(*) AS total_tests, " + ", ".join(f"count(*) FILTER (status = '{s}') AS {s.lower()}" for s in ("PASS", "WARN", "FAIL", "SKIP")) + " FROM checks_fx", "checks"
    ),
)
for _status in ("FAIL", "WARN"):
    QUERIES.add(
        f"top_{_status.lower()}_results",
        lambda spark, d, s=_status: scoring.top_results(_results(spark, d), s).select("index", "test", "status", "dimension"),
        with_sql(f'SELECT "index", test, status, dimension FROM ({RESULTS}) WHERE status = \'{_status}\' ORDER BY "index" LIMIT 25', "checks"),
    )
QUERIES.add(
    "search_results",
    lambda spark, d: scoring.search_results(_results(spark, d), " Drift ", "FAIL").select("index", "test", "status"),
    with_sql("SELECT \"index\", test, status FROM checks_fx WHERE contains(lower(test), 'drift') AND status = 'FAIL' ORDER BY \"index\" LIMIT 25", "checks"),
)
ACTION = q.first_group("lower(test)", [(a, w) for w, a in fv.REMEDIATION_KEYWORDS]) + " END"
QUERIES.add(
    "remediation",
    lambda spark, d: scoring.remediation(_results(spark, d)),
    with_sql(
        f'SELECT action, first_index FROM (SELECT {ACTION} AS action, min("index") AS first_index FROM checks_fx WHERE status IN (\'FAIL\', \'WARN\') GROUP BY 1) '
        "WHERE action IS NOT NULL ORDER BY first_index LIMIT 8", "checks",
    ),
)
QUERIES.add(
    "remediation_none",
    lambda spark, d: scoring.remediation(_results(spark, d).filter("status = 'PASS'")).select("action"),
    with_sql(f"SELECT DISTINCT {q.quote(fv.REMEDIATION_NONE)} AS action FROM checks_fx WHERE status = 'PASS'", "checks"),
)
QUERIES.add(
    "weakest_dimensions",
    lambda spark, d: scoring.weakest_dimensions(scoring.dimension_scores(_results(spark, d)), 3).select("ord", "dimension"),
    with_sql(f"SELECT ord, dimension FROM ({SCORES}) ORDER BY score, ord LIMIT 3", "checks"),
)
QUERIES.add(
    "improvement_actions",
    lambda spark, d: scoring.improvement_actions(scoring.dimension_scores(_results(spark, d)), "text"),
    with_sql(
        f"SELECT row_number() OVER (ORDER BY k) AS position, action FROM (SELECT row_number() OVER (ORDER BY score, ord) AS k, CASE dimension "
        + " ".join(f"WHEN '{d}' THEN {q.quote(a)}" for d, a in fv.IMPROVEMENT_ACTIONS.items())
        + f" END AS action FROM ({SCORES}) QUALIFY k <= 4 UNION ALL SELECT 99, {q.quote(fv.IMPROVEMENT_EXTRA['text'])})", "checks",
    ),
)


def _advice(modality):
    def build(spark, d):
        told = scoring.advice(scoring.dimension_scores(_results(spark, d)), modality)
        return told.select("best_use_recommendation", F.array_join("recommended_use_cases", "|").alias("recommended"), F.array_join("cautions", "|").alias("cautions"))

    return build


def _advice_sql(modality: str) -> str:
    caveat = "'Best fit now, but weaker for scenarios requiring strong ' || lower(weak) || ' (current ' || printf('%.1f', low) || ').'"
    rungs = []
    for lines in fv.ADVICE[modality]:
        rest = "".join(f" || '|' || {q.quote(x)}" for x in lines[1:])
        rungs.append((f"{q.quote(lines[0])} || ' ' || {caveat}", rest))
    bounds = ("overall >= 85", "overall >= 70", "overall >= 55")

    def pick(with_rest):
        texts = [a + (b if with_rest else "") for a, b in rungs]
        return "CASE " + " ".join(f"WHEN {c} THEN {t}" for c, t in zip(bounds, texts)) + f" ELSE {texts[-1]} END"

    cautions = []
    if modality == "tabular":
        cautions.append("CASE WHEN low < 65 THEN 'Weakest dimension is ' || weak || ' (' || printf('%.1f', low) || '); avoid high-stakes use cases dependent on it.' END")
    cautions += [f"CASE WHEN {d} < {b} THEN {q.quote(t)} END" for d, b, t in fv.CAUTIONS[modality]]
    wide = ", ".join(f"max(score) FILTER (dimension = '{d}') AS {d}" for d in fv.DIMENSIONS)
    row = f"SELECT {OVERALL} AS overall, first(dimension ORDER BY score, ord) AS weak, min(score) AS low, {wide} FROM ({SCORES})"
    return f"SELECT {pick(False)} AS best_use_recommendation, {pick(True)} AS recommended, concat_ws('|', {', '.join(cautions)}) AS cautions FROM ({row})"


for _m in ("tabular", "text", "image"):
    QUERIES.add(f"advice_{_m}", _advice(_m), with_sql(_advice_sql(_m), "checks"))

DIM_STATUS = "CASE WHEN score >= 85 THEN 'PASS' WHEN score >= 60 THEN 'WARN' ELSE 'FAIL' END"
QUERIES.add(
    "dimension_checks",
    lambda spark, d: scoring.dimension_checks(scoring.dimension_scores(_results(spark, d))),
    with_sql(
        f"SELECT ord AS \"index\", 'Dimension aggregate: ' || dimension AS test, {DIM_STATUS} AS status, dimension, 'Aggregated ' || dimension || ' score' AS interpretation, "
        f"{q.py_round('score', 2)} AS score FROM ({SCORES})", "checks",
    ),
)
QUERIES.add(
    "dimension_summary",
    lambda spark, d: scoring.dimension_summary(scoring.dimension_scores(_results(spark, d))),
    with_sql(
        "SELECT " + ", ".join(f"count(*) FILTER ({DIM_STATUS} = '{s}') AS {s.lower()}" for s in ("PASS", "WARN", "FAIL"))
        + f", CAST(0 AS BIGINT) AS skip, count(*) AS total_tests FROM ({SCORES})", "checks",
    ),
)


def _result_report(spark, d):
    report = checks.report_results(_results(spark, d).withColumn("interpretation", F.lit("")))
    return report.select(
        "overall_score", "quality_tier", "best_use_recommendation", F.array_join("fix_actions", "|").alias("fix_actions"),
        F.size("failed_tests").cast("bigint").alias("failed"), F.size("warning_tests").cast("bigint").alias("warned"), F.col("summary.total_tests").alias("total_tests"),
    )


QUERIES.add(
    "result_report", _result_report,
    with_sql(
        f"SELECT * FROM (SELECT {q.py_round('overall', 2)} AS overall_score, {_tier('overall')} AS quality_tier FROM (SELECT {OVERALL} AS overall FROM ({SCORES}))), "
        f"(SELECT best_use_recommendation FROM ({_advice_sql('tabular')})), "
        f"(SELECT string_agg(action, '|' ORDER BY first_index) AS fix_actions FROM (SELECT {ACTION} AS action, min(\"index\") AS first_index FROM checks_fx WHERE status IN ('FAIL', 'WARN') GROUP BY 1 ORDER BY 2 LIMIT 8) WHERE action IS NOT NULL), "
        "(SELECT least(25, count(*) FILTER (status = 'FAIL')) AS failed, least(25, count(*) FILTER (status = 'WARN')) AS warned, count(*) AS total_tests FROM checks_fx)",
        "checks",
    ),
)


def _table_context(spark, d):
    """Customers with the suppliers as comparison."""
    def named(name, p):
        t = load(spark, d, name)
        return t.select(F.col(f"{p}_custkey" if p == "c" else f"{p}_suppkey").alias("id"), F.col(f"{p}_nationkey").alias("nation"), F.col(f"{p}_acctbal").alias("balance"))

    return checks.make_context(named("customer", "c"), compare=named("supplier", "s"), id_col="id", time_col="joined", target_col="nation", as_of=moment("2026-06-08"))


def _table_checks_sql() -> str:
    """Statuses by plain SQL; the only measure without a role is the balance."""
    def three(x, warn, fail):
        return f"CASE WHEN {x} > {fail} THEN 'FAIL' WHEN {x} > {warn} THEN 'WARN' ELSE 'PASS' END"

    c = "(SELECT c_custkey AS id, c_nationkey AS nation, c_acctbal AS balance FROM customer)"
    s = "(SELECT s_suppkey AS id, s_nationkey AS nation, s_acctbal AS balance FROM supplier)"

    def iqr(col):
        return (
            f"(SELECT 100.0 * count(*) FILTER ({col} < a - 1.5 * (b - a) OR {col} > b + 1.5 * (b - a)) / count(*) FROM {c}, "
            f"(SELECT quantile_cont({col}, 0.25) AS a, quantile_cont({col}, 0.75) AS b FROM {c}))"
        )

    def z(col):
        return f"(SELECT 100.0 * count(*) FILTER (abs({col} - m) > 3 * sd) / count(*) FROM {c}, (SELECT avg({col}) AS m, stddev_pop({col}) AS sd FROM {c}))"

    sizes = f"(SELECT nation, count(*) AS n FROM {c} GROUP BY nation)"
    parity = f"(SELECT CAST(min(n) AS DOUBLE) / max(n) FROM {sizes})"
    entropy = f"(SELECT -sum(n / t * log2(n / t)) / log2(count(*)) FROM (SELECT CAST(n AS DOUBLE) AS n, sum(n) OVER () AS t FROM {sizes}))"
    balance = f"(100.0 * ({parity} + {entropy}) / 2)"
    overlap = f"(SELECT avg(CASE WHEN EXISTS (SELECT 1 FROM {s} s WHERE s.id = c.id AND s.nation = c.nation AND s.balance = c.balance) THEN 1.0 ELSE 0.0 END) FROM {c} c)"
    distinct = "list_distinct([" + ", ".join(f"e{i}" for i in range(1, 10)) + "])"

    def binned_of(col):
        edges = "(SELECT " + ", ".join(f"quantile_cont({col}, {i / 10}) AS e{i}" for i in range(1, 10)) + f" FROM {c})"
        both = f"(SELECT {col} AS v, 1 AS p, 0 AS q FROM {c} UNION ALL SELECT {col}, 0, 1 FROM {s})"
        return f"(SELECT len(list_filter({distinct}, lambda e: e < v)) AS b, sum(p) / (SELECT count(*) FROM {c}) AS p, sum(q) / (SELECT count(*) FROM {s}) AS q FROM {both}, {edges} GROUP BY 1)"

    def gaps_of(col):
        both = f"(SELECT {col} AS v, 1 AS p, 0 AS q FROM {c} UNION ALL SELECT {col}, 0, 1 FROM {s})"
        return f"(SELECT v, lead(v) OVER w AS nv, sum(sum(p)) OVER w / (SELECT count(*) FROM {c}) AS f, sum(sum(q)) OVER w / (SELECT count(*) FROM {s}) AS g FROM {both} GROUP BY v WINDOW w AS (ORDER BY v))"

    psi = f"(SELECT sum((greatest(q, 1e-4) - greatest(p, 1e-4)) * ln(greatest(q, 1e-4) / greatest(p, 1e-4))) FROM {binned_of('balance')})"
    half = "CASE WHEN {0} > 0 THEN {0} * ln({0} / ((p + q) / 2)) ELSE 0 END"
    shannon = f"(SELECT sum({half.format('p')} + {half.format('q')}) / 2 FROM {binned_of('balance')})"
    ks = f"(SELECT max(abs(f - g)) FROM {gaps_of('balance')})"
    moved = f"(SELECT sum(coalesce((nv - v) * abs(f - g), 0)) / (max(v) - min(v)) FROM {gaps_of('balance')})"
    skew = f"(SELECT abs(avg(power((balance - m) / sd, 3))) FROM {c}, (SELECT avg(balance) AS m, stddev_pop(balance) AS sd FROM {c}))"
    rare = (
        f"(SELECT 100.0 * sum(n) FILTER (-ln(CAST(n AS DOUBLE) / top) > 4.605) / sum(n) FROM (SELECT count(*) AS n, max(count(*)) OVER () AS top FROM {c}, "
        f"(SELECT min(balance) AS lo, max(balance) AS hi FROM {c}) GROUP BY least(floor((balance - lo) / (hi - lo) * 10), 9)))"
    )
    leak = f"(SELECT abs(corr(balance, nation)) FROM {c})"
    statuses = {
        "PSI drift": f"CASE WHEN {psi} > 0.25 THEN 'FAIL' WHEN {psi} > 0.1 THEN 'WARN' ELSE 'PASS' END", "Kolmogorov-Smirnov shift": three(ks, 0.1, 0.25),
        "Missing value ratio": "'PASS'", "Blank string format": "'PASS'", "Duplicate row ratio": "'PASS'", "PII pattern scan": "'PASS'", "Text encoding": "'PASS'",
        "Timeliness freshness": "'SKIP'", "Primary-key uniqueness": f"CASE WHEN (SELECT count(*) - count(DISTINCT id) FROM {c}) = 0 THEN 'PASS' ELSE 'FAIL' END",
        "IQR outlier share": three(f"greatest({iqr('nation')}, {iqr('balance')})", 10, 30), "Z-score outlier share": three(f"greatest({z('nation')}, {z('balance')})", 10, 30),
        "Row leakage overlap": three(overlap, 0, 0.05), "Label class balance": f"CASE WHEN {balance} >= 70 THEN 'PASS' WHEN {balance} >= 40 THEN 'WARN' ELSE 'FAIL' END",
        "Fairness coverage": f"CASE WHEN {parity} >= 0.5 THEN 'PASS' ELSE 'WARN' END", "Jensen-Shannon divergence": three(shannon, 0.05, 0.2),
        "Wasserstein shift": three(moved, 0.05, 0.2), "Skewness of distributions": three(skew, 2, 10), "Histogram outlier share": three(f"coalesce({rare}, 0)", 10, 30), "Target leakage": three(leak, 0.95, 0.99),
    }
    groups = [(d, w) for d, w in fv.DIMENSION_KEYWORDS]
    parts = []
    for i, check in enumerate(checks.CHECKS, 1):
        default = q.quote(fv.CHECK_CATEGORY_DIMENSION[check.category])
        parts.append(f"SELECT {i} AS \"index\", {q.quote(check.name)} AS test, {statuses.get(check.name, "'SKIP'")} AS status, {q.first_group(q.quote(check.name.lower()), groups)} ELSE {default} END AS dimension")
    return " UNION ALL ".join(parts)


_TABLE_CHECKS = _table_checks_sql()
QUERIES.add(
    "table_checks",
    lambda spark, d: checks.run_checks(_table_context(spark, d)).select("index", "test", "status", "dimension"),
    _TABLE_CHECKS,
)


def _table_report(spark, d):
    row = checks.assess_table(_table_context(spark, d))
    return row.select(
        "overall_score", "quality_tier", F.array_join("fix_actions", "|").alias("fix_actions"), "n_rows", "n_columns", F.array_join("warnings", "|").alias("warnings"),
        F.col("roles")["id_col"].alias("id_col"), F.col("roles")["time_col"].alias("time_col"), F.col("roles")["target_col"].alias("target_col"),
        *[F.col(f"summary.{s}").alias(s) for s in ("total_tests", "pass", "warn", "fail", "skip")],
    )


_TABLE_SCORES = SCORES.replace(f"({RESULTS})", "results")
QUERIES.add(
    "table_assessment", _table_report,
    f"WITH results AS ({_TABLE_CHECKS}) SELECT * FROM (SELECT {q.py_round('overall', 2)} AS overall_score, {_tier('overall')} AS quality_tier FROM (SELECT {OVERALL} AS overall FROM ({_TABLE_SCORES}))), "
    f"(SELECT coalesce(string_agg(action, '|' ORDER BY first_index), {q.quote(fv.REMEDIATION_NONE)}) AS fix_actions FROM (SELECT {ACTION} AS action, min(\"index\") AS first_index FROM results WHERE status IN ('FAIL', 'WARN') GROUP BY 1) WHERE action IS NOT NULL), "
    "(SELECT count(*) AS n_rows, CAST(3 AS BIGINT) AS n_columns FROM customer), "
    "(SELECT 'time_col=joined not found; its checks are skipped.' AS warnings, 'id' AS id_col, CAST(NULL AS VARCHAR) AS time_col, 'nation' AS target_col), "
    "(SELECT count(*) AS total_tests, " + ", ".join(f"count(*) FILTER (status = '{s.upper()}') AS \"{s}\"" for s in ("pass", "warn", "fail", "skip")) + " FROM results)",
)
QUERIES.add(
    "fairness_coverage",
    lambda spark, d: class_parity(load(spark, d, "labels"), "quality").withColumn("prevalence_parity", F.round("prevalence_parity", 6)),
    "SELECT round(p, 6) AS prevalence_parity, CASE WHEN p >= 0.5 THEN 'PASS' ELSE 'WARN' END AS status FROM "
    "(SELECT CAST(min(n) AS DOUBLE) / max(n) AS p FROM (SELECT count(*) AS n FROM labels WHERE quality IS NOT NULL GROUP BY quality))",
)
_BALANCE = (
    "SELECT count(*) AS classes, round(min(n) / max(n), 6) AS minority_majority_ratio, round(-sum(n / t * log2(n / t)) / log2(count(*)), 6) AS normalized_entropy, "
    "round(100.0 * (min(n) / max(n) - sum(n / t * log2(n / t)) / log2(count(*))) / 2, 6) AS balance FROM "
    "(SELECT CAST(count(*) AS DOUBLE) AS n, sum(count(*)) OVER () AS t FROM {t} WHERE {c} IS NOT NULL GROUP BY {c})"
)


def _balance(table, column):
    def build(spark, d):
        out = class_balance(load(spark, d, table), column)
        return out.withColumns({c: F.round(c, 6) for c in ("minority_majority_ratio", "normalized_entropy", "balance")})

    return build


for _t, _c in (("labels", "quality"), ("labels", "toxic"), ("embeddings", "label"), ("conversations", "role")):
    QUERIES.add(f"label_balance_{_t}_{_c}", _balance(_t, _c), _BALANCE.format(t=_t, c=_c))

# -------------------------------------------------------------- text corpora


def _docs(spark, d):
    return textcorpus.trimmed(load(spark, d, "documents"), "text", "doc_id")


def _measures(spark, d):
    return textcorpus.document_measures(_docs(spark, d))


TRIMMED = f"SELECT doc_id, {q.strip('text')} AS t FROM documents"
FILLED = f"SELECT * FROM ({TRIMMED}) WHERE t <> ''"
TOKENS = r"len(regexp_extract_all(t, '[\pL\pN_]+'))"
SYMBOLS = rf"(length(t) - length(regexp_replace(t, '[^\pL\pN_\s\x0b\x1c-\x1f\x{{85}}\pZ]', '', 'g')))"
LETTERS = r"(length(t) - length(regexp_replace(t, '\pL', '', 'g')))"
LATIN = "regexp_extract_all(lower(t), '[a-z'']+')"
ENGLISH = ", ".join(q.quote(w) for w in fv.ENGLISH_HINT_WORDS)
HINT = (
    f"SELECT doc_id, n, CASE WHEN n = 0 THEN 0.0 ELSE CAST(hits AS DOUBLE) / least(400, n) END AS r FROM (SELECT doc_id, len(w) AS n, "
    f"len(list_filter(list_slice(w, 1, 400), lambda x: x IN ({ENGLISH}))) AS hits FROM (SELECT doc_id, {LATIN} AS w FROM ({FILLED})))"
)
HINTED = (
    "SELECT doc_id, CASE WHEN r >= 0.02 THEN 'en' ELSE 'unknown' END AS lang, CASE WHEN n = 0 THEN 0.0 WHEN r >= 0.02 THEN least(1.0, r * 15) ELSE greatest(0.05, r) END AS confidence "
    f"FROM ({HINT})"
)
FORM = f"regexp_replace(lower(t), '{q.SPACE}+', ' ', 'g')"
DIVERSITY = f"(SELECT CAST(count(DISTINCT w) AS DOUBLE) / greatest(1, count(*)) FROM (SELECT unnest({LATIN}) AS w FROM ({FILLED})))"
UNIQUE = f"(SELECT 100.0 * count(DISTINCT {FORM}) / greatest(1, count(*)) FROM ({FILLED}))"
SAMPLE = f"(SELECT least(100.0, log10(count(*) + 1) / log10(2001.0) * 100.0) FROM ({FILLED}))"
LENGTHS = f"(SELECT 100.0 * (1.0 - (avg(CAST({TOKENS} < 5 AS INT)) + avg(CAST({TOKENS} > 1500 AS INT))) / 2) FROM ({FILLED}))"
RATIO = f"(SELECT avg(CAST({SYMBOLS} AS DOUBLE) / greatest(1, {TOKENS})) FROM ({FILLED}))"
ALPHA = f"(SELECT avg(CAST({LETTERS} AS DOUBLE) / greatest(1, length(t))) FROM ({FILLED}))"
CONFIDENCE = f"(SELECT avg(confidence) FROM ({HINTED}))"
COMPLETE = f"(SELECT 100.0 * count(*) FILTER (t <> '') / greatest(1, count(*)) FROM ({TRIMMED}))"


def _rounded(df, *columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


QUERIES.add(
    "text_completeness", lambda spark, d: _rounded(textcorpus.completeness(_docs(spark, d)), "completeness"),
    f"SELECT count(*) AS n_documents, count(*) FILTER (t <> '') AS n_filled, round(100.0 * count(*) FILTER (t <> '') / greatest(1, count(*)), 6) AS completeness FROM ({TRIMMED})",
)
QUERIES.add(
    "text_uniqueness", lambda spark, d: _rounded(textcorpus.uniqueness(_docs(spark, d)), "uniqueness"),
    f"SELECT count(DISTINCT {FORM}) AS distinct_texts, round(100.0 * count(DISTINCT {FORM}) / greatest(1, count(*)), 6) AS uniqueness FROM ({FILLED})",
)
QUERIES.add(
    "token_summary",
    lambda spark, d: textcorpus.token_summary(_docs(spark, d)).select(F.col("min_tokens").cast("bigint").alias("min_tokens"), "median_tokens", F.col("max_tokens").cast("bigint").alias("max_tokens")),
    f"SELECT min({TOKENS}) AS min_tokens, CAST(median({TOKENS}) AS DOUBLE) AS median_tokens, max({TOKENS}) AS max_tokens FROM ({FILLED})",
)
QUERIES.add("length_quality", lambda spark, d: _rounded(textcorpus.length_quality(_measures(spark, d)), "length_quality"), f"SELECT round({LENGTHS}, 6) AS length_quality")
QUERIES.add(
    "symbol_ratio", lambda spark, d: _rounded(textcorpus.symbol_validity(_measures(spark, d)), "symbol_ratio", "validity"),
    f"SELECT round({RATIO}, 6) AS symbol_ratio, round(100.0 * (1.0 - least(1.0, {RATIO} / 0.5)), 6) AS validity",
)
QUERIES.add("letter_share", lambda spark, d: _rounded(textcorpus.letter_consistency(_measures(spark, d)), "letter_consistency"), f"SELECT round(100.0 * {ALPHA}, 6) AS letter_consistency")
QUERIES.add(
    "language_hint",
    lambda spark, d: _measures(spark, d).select(F.col("ord").alias("doc_id"), "hint.lang", F.round("hint.confidence", 6).alias("confidence")),
    f"SELECT doc_id, lang, round(confidence, 6) AS confidence FROM ({HINTED})",
)
QUERIES.add(
    "language_summary", lambda spark, d: _rounded(textcorpus.language_summary(_measures(spark, d)), "mean_confidence"),
    f"SELECT (SELECT lang FROM ({HINTED}) GROUP BY lang ORDER BY count(*) DESC, min(doc_id) LIMIT 1) AS dominant_language, round(100.0 * avg(confidence), 6) AS mean_confidence FROM ({HINTED})",
)
QUERIES.add(
    "vocabulary", lambda spark, d: _rounded(textcorpus.vocabulary(_docs(spark, d)), "vocab_diversity"),
    f"SELECT count(DISTINCT w) AS distinct_tokens, count(*) AS all_tokens, round(CAST(count(DISTINCT w) AS DOUBLE) / greatest(1, count(*)), 6) AS vocab_diversity FROM (SELECT unnest({LATIN}) AS w FROM ({FILLED}))",
)
REPRESENTATIVE = f"(({SAMPLE} + least(100.0, {DIVERSITY} * 400.0) + {UNIQUE}) / 3)"
QUERIES.add(
    "text_representativeness", lambda spark, d: _rounded(textcorpus.representativeness(_docs(spark, d)), "representativeness"),
    f"SELECT round({REPRESENTATIVE}, 6) AS representativeness",
)
TEXT_DIMS = {
    "Completeness": COMPLETE, "Validity": f"(100.0 * (1.0 - least(1.0, {RATIO} / 0.5)))",
    "Consistency": f"((100.0 * {ALPHA} + {LENGTHS} + 100.0 * {CONFIDENCE}) / 3)", "Uniqueness": UNIQUE, "Representativeness": REPRESENTATIVE,
    "Balance": "70.0", "Timeliness": "70.0",
}
TEXT_SCORES = " UNION ALL ".join(
    f"SELECT {i} AS ord, '{d}' AS dimension, CAST({fv.DIMENSION_WEIGHTS[d]} AS DOUBLE) AS weight, CAST(least(100.0, greatest(0.0, {e})) AS DOUBLE) AS score" for i, (d, e) in enumerate(TEXT_DIMS.items(), 1)
)
QUERIES.add(
    "text_scores", lambda spark, d: _rounded(textcorpus.corpus_scores(_docs(spark, d)), "score"),
    f"SELECT ord, dimension, round(score, 6) AS score FROM ({TEXT_SCORES})",
)


def _text_report(table, key):
    def build(spark, d):
        report = textcorpus.assess_text(load(spark, d, table).withColumn("__key", F.expr(key)), "text", "__key")
        return report.select(
            "overall_score", "quality_tier", "best_use_recommendation", F.array_join("cautions", "|").alias("cautions"), F.array_join("fix_actions", "|").alias("fix_actions"),
            F.col("details.n_documents").alias("n_documents"), F.col("details.vocab_diversity").alias("vocab_diversity"), F.col("details.symbol_to_word_ratio").alias("symbol_to_word_ratio"),
            F.col("details.dominant_language").alias("dominant_language"), F.col("details.mean_confidence").alias("mean_confidence"), F.col("details.pii_pattern_hits.phone").alias("phone_hits"),
            F.col("details.language_votes.en").alias("en_votes"), F.col("details.language_votes.unknown").alias("unknown_votes"),
            F.array_join(F.transform("test_results", lambda r: F.concat_ws(":", r["index"], r["test"], r["status"], r["interpretation"])), "|").alias("tests"),
        )

    return build


def _text_report_sql(source: str = "") -> str:
    """``source`` stands in for the documents table."""
    actions = " ".join(f"WHEN '{d}' THEN {q.quote(a)}" for d, a in fv.IMPROVEMENT_ACTIONS.items())
    fixes = (
        f"(SELECT string_agg(a, '|' ORDER BY k) FROM (SELECT row_number() OVER (ORDER BY score, ord) AS k, CASE dimension {actions} END AS a FROM s QUALIFY k <= 4 "
        f"UNION ALL SELECT 99, {q.quote(fv.IMPROVEMENT_EXTRA['text'])}))"
    )
    told = _advice_sql("text").replace(f"({SCORES})", "s")
    return (
        f"WITH {source}s AS MATERIALIZED ({TEXT_SCORES}), a AS ({told}) SELECT (SELECT {q.py_round(OVERALL, 2)} FROM s) AS overall_score, (SELECT {_tier(OVERALL)} FROM s) AS quality_tier, "
        f"best_use_recommendation, cautions, {fixes} AS fix_actions, (SELECT count(*) FROM documents) AS n_documents, {q.py_round(DIVERSITY, 4)} AS vocab_diversity, "
        f"{q.py_round(RATIO, 4)} AS symbol_to_word_ratio, (SELECT lang FROM ({HINTED}) GROUP BY lang ORDER BY count(*) DESC, min(doc_id) LIMIT 1) AS dominant_language, "
        f"{q.py_round(f'100.0 * {CONFIDENCE}', 2)} AS mean_confidence, (SELECT count(*) FILTER (regexp_matches(t, {q.quote(fv.PII_PATTERNS['PHONE'])})) FROM ({FILLED})) AS phone_hits, "
        f"(SELECT count(*) FILTER (lang = 'en') FROM ({HINTED})) AS en_votes, (SELECT count(*) FILTER (lang <> 'en') FROM ({HINTED})) AS unknown_votes, "
        f"(SELECT string_agg(ord || ':Dimension aggregate: ' || dimension || ':' || {DIM_STATUS} || ':Aggregated ' || dimension || ' score', '|' ORDER BY ord) FROM s) AS tests FROM a"
    )


QUERIES.add("text_report", _text_report("documents", "doc_id"), _text_report_sql())
QUERIES.add("text_report_conversations", _text_report("conversations", "conv_id * 1000 + turn"), _text_report_sql("documents AS (SELECT conv_id * 1000 + turn AS doc_id, text FROM conversations), "))
QUERIES.add(
    "normal_forms",
    lambda spark, d: load(spark, d, "conversations").select("conv_id", "turn", tx.normal_form(F.col("text")).alias("form"), tx.word_count(F.col("text")).cast("bigint").alias("words")),
    f"SELECT conv_id, turn, regexp_replace(lower({q.strip('text')}), '{q.SPACE}+', ' ', 'g') AS form, {q.words('text')} AS words FROM conversations",
)
QUERIES.add(
    "half_even_rounding",
    lambda spark, d: load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", numeric.half_even(F.col("l_extendedprice") * F.col("l_discount"), 1).alias("r1")),
    f"SELECT l_orderkey, l_linenumber, {q.py_round('l_extendedprice * l_discount', 1)} AS r1 FROM lineitem",
)
