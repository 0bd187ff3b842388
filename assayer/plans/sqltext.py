"""Fragments of check SQL, written independently of the Spark expressions."""

from assayer import fixed_values as fv

SPACE = r"[\s\x0b\x1c-\x1f\x{85}\pZ]"


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def py_round(expr: str, digits: int) -> str:
    """C formatting rounds by the exact binary value, ties to even."""
    return f"CAST(printf('%.{digits}f', {expr}) AS DOUBLE)"


def scrub(expr: str, labels=tuple(fv.PII_PATTERNS)) -> str:
    out = expr
    for label in labels:
        out = f"regexp_replace({out}, {quote(fv.PII_PATTERNS[label])}, '[{label}_REDACTED]', 'g')"
    return out


def strip(expr: str) -> str:
    return f"regexp_replace({expr}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def words(expr: str) -> str:
    return rf"len(regexp_extract_all({expr}, '[\pL\pN_]+'))"


def category_hits(expr: str) -> dict[str, str]:
    return {
        name: " + ".join(f"CAST(contains({expr}, {quote(k)}) AS INT)" for k in keys)
        for name, keys in fv.CATEGORY_KEYWORDS.items()
    }


def categorised(source: str, text: str, keep: str) -> str:
    """SELECT keep, category, confidence FROM source, by keyword hits of text."""
    hits = category_hits("lt")
    columns = ", ".join(f"{h} AS h{i}" for i, h in enumerate(hits.values()))
    best = "greatest(" + ", ".join(f"h{i}" for i in range(len(hits))) + ")"
    name = "CASE WHEN best = 0 THEN 'General/Other' " + " ".join(
        f"WHEN h{i} = best THEN {quote(n)}" for i, n in enumerate(hits)
    ) + " END"
    return (
        f"SELECT {keep}, {name} AS category, CAST(CASE WHEN best = 0 THEN 0.5 WHEN best = 1 THEN 0.72 WHEN best = 2 THEN 0.84 "
        f"ELSE 0.93 END AS DOUBLE) AS confidence FROM (SELECT *, {best} AS best FROM (SELECT *, {columns} FROM "
        f"(SELECT *, lower(coalesce({text}, '')) AS lt FROM ({source}))))"
    )


def table_stats(source: str, columns: list[str], floating: tuple[str, ...] = ()) -> str:
    """One stats row of a table or subquery."""
    nulls = " + ".join(
        f"CAST(({c} IS NULL{f' OR isnan({c})' if c in floating else ''}) AS BIGINT)" for c in columns
    )
    width = len(columns)
    return (
        f"SELECT count(*) AS row_count, CAST({width} AS BIGINT) AS column_count, CAST(coalesce(sum({nulls}), 0) AS BIGINT) AS missing_cells, "
        f"CASE WHEN count(*) = 0 THEN 0.0 ELSE CAST(sum({nulls}) AS DOUBLE) / (count(*) * {width}) * 100 END AS missing_pct_exact, "
        f"count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM ({source}))) AS duplicate_rows FROM ({source})"
    )


def fast_score(stats: str) -> str:
    """Stats row with dimensions, score and label."""
    dims = (
        f"{py_round('greatest(0.0, 100.0 - least(missing_pct_exact, 100.0) * 1.6)', 1)} AS completeness, "
        f"{py_round('greatest(0.0, 100.0 - CAST(duplicate_rows AS DOUBLE) / greatest(row_count, 1) * 100.0)', 1)} AS uniqueness, "
        "CAST(CASE WHEN column_count >= 3 THEN 100.0 WHEN column_count = 2 THEN 72.0 ELSE 55.0 END AS DOUBLE) AS consistency, "
        "CAST(CASE WHEN row_count >= 100 THEN 92.0 WHEN row_count >= 10 THEN 84.0 WHEN row_count >= 2 THEN 76.0 ELSE 58.0 END AS DOUBLE) AS representativeness"
    )
    total = (
        "completeness * CAST(0.35 AS DOUBLE) + uniqueness * CAST(0.25 AS DOUBLE) + consistency * CAST(0.20 AS DOUBLE) "
        "+ representativeness * CAST(0.20 AS DOUBLE)"
    )
    return (
        "SELECT *, CASE WHEN quality_score >= 90 THEN 'Production analytics and model training' "
        "WHEN quality_score >= 80 THEN 'Business intelligence and exploratory analysis' "
        "WHEN quality_score >= 70 THEN 'Exploratory Data Analysis (EDA)' ELSE 'Needs cleaning before reuse' END AS best_use_case "
        f"FROM (SELECT *, {py_round(total, 1)} AS quality_score FROM (SELECT *, {dims} FROM ({stats})))"
    )


def first_group(expr: str, groups) -> str:
    """CASE over (label, words): first group with a word inside expr."""
    return "CASE " + " ".join(
        "WHEN " + " OR ".join(f"contains({expr}, {quote(w)})" for w in words_) + f" THEN {quote(label)}" for label, words_ in groups
    )
