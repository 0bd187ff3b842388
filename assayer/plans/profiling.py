"""Queries: profile, redaction, categories and the fast quality score."""

from pyspark.sql import functions as F

from assayer import fixed_values as fv
from assayer.functions import numeric, pii
from assayer.functions.category import tags, type_match, with_category
from assayer.operators import categorise as cat, fastscore, intake, profile, redaction
from assayer.plans import sqltext as q
from assayer.plans.registry import Registry
from assayer.plans.tables import PROJECTIONS, load, project, projection_sql, with_sql
from assayer.session import spread

QUERIES = Registry()

COLUMNS = {
    "customer": ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"),
    "orders": ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"),
    "lineitem": (
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
        "l_returnflag", "l_linestatus", "l_shipdate",
    ),
    "part": ("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"),
    "supplier": ("s_suppkey", "s_name", "s_nationkey", "s_acctbal"),
    "nation": ("n_nationkey", "n_name", "n_regionkey"),
    "documents": ("doc_id", "text", "lang", "source", "n_chars"),
    "events": ("event_id", "ts", "user_id", "event_type", "value", "props"),
    "conversations": ("conv_id", "turn", "role", "text"),
    "embeddings": ("vec_id", "embedding", "label"),
    "labels": ("doc_id", "quality", "toxic"),
    "pages": ("page_id", "url", "html"),
}
STRINGS = {
    "customer": ("c_name", "c_mktsegment"), "documents": ("text", "lang", "source"), "part": ("p_name", "p_brand", "p_type"),
    "conversations": ("role", "text"), "lineitem": ("l_returnflag", "l_linestatus"), "orders": ("o_orderstatus", "o_orderpriority"),
    "pages": ("url", "html"),
}
STAT_COLUMNS = ("row_count", "column_count", "missing_cells", "missing_percentage", "duplicate_rows")


# ------------------------------------------------------------------- profile


def _stats_sql(source: str, columns) -> str:
    return (
        f"SELECT row_count, column_count, missing_cells, {q.py_round('missing_pct_exact', 2)} AS missing_percentage, duplicate_rows "
        f"FROM ({q.table_stats(source, list(columns))})"
    )


def _stats(name):
    return lambda spark, d: profile.table_stats(load(spark, d, name)).select(*STAT_COLUMNS)


for _name in ("customer", "orders", "lineitem", "documents", "events", "conversations", "embeddings", "pages", "part", "supplier"):
    QUERIES.add(f"table_stats_{_name}", _stats(_name), _stats_sql(f"SELECT * FROM {_name}", COLUMNS[_name]))

CATALOG_COLUMNS = tuple(PROJECTIONS["catalog"][1])

QUERIES.add(
    "table_stats_catalog",
    lambda spark, d: profile.table_stats(project(spark, d, "catalog")).select(*STAT_COLUMNS),
    _stats_sql(projection_sql("catalog"), [f'"{c}"' for c in CATALOG_COLUMNS]),
)


def _repeated(spark, d):
    """Line items without their keys, so that copies occur."""
    return load(spark, d, "lineitem").select("l_returnflag", "l_linestatus", "l_discount", "l_tax", "l_quantity")


QUERIES.add(
    "duplicate_rows_lineitem",
    lambda spark, d: profile.table_stats(_repeated(spark, d)).select("row_count", "duplicate_rows"),
    "SELECT row_count, duplicate_rows FROM ("
    + q.table_stats("SELECT l_returnflag, l_linestatus, l_discount, l_tax, l_quantity FROM lineitem", ["l_returnflag"]) + ")",
)

CATALOG_TYPES = {
    "file_hash": "string", "timestamp": "timestamp_ntz", "filename": "string", "category": "string", "file_type": "string",
    "quality_score": "double", "confidence": "double", "redacted_cells": "long", "owner": "string", "bytes": "long",
    "restriction_status": "string",
}


def _profile_sql(source: str, types: dict[str, str]) -> str:
    parts = []
    for i, (c, t) in enumerate(types.items()):
        dtype, inferred = profile.DTYPE_NAMES[t]
        parts.append(
            f"SELECT {i} AS position, '{c}' AS \"column\", '{dtype}' AS dtype, '{inferred}' AS inferred, "
            f"round(100.0 * (count(*) - count(\"{c}\")) / count(*), 6) AS missing_pct, count(DISTINCT \"{c}\") AS cardinality FROM src"
        )
    return f"WITH src AS ({source}) " + " UNION ALL ".join(parts)


QUERIES.add(
    "column_profile",
    lambda spark, d: profile.column_profile(project(spark, d, "catalog").select(*CATALOG_TYPES)).withColumn("missing_pct", F.round("missing_pct", 6)),
    _profile_sql(projection_sql("catalog"), CATALOG_TYPES),
)
QUERIES.add(
    "column_profile_approx",
    lambda spark, d: profile.column_profile(load(spark, d, "lineitem"), approx=True),
)


def _roles_sql(source: str, columns) -> str:
    parts = []
    for c in columns:
        parts.append(
            f"SELECT '{c}' AS \"column\", count({c}) AS filled, count(DISTINCT {c}) AS cardinality, round(avg(length({c})), 6) AS mean_length, "
            f"round(count(DISTINCT {c}) / greatest(1, count({c})), 6) AS distinct_share FROM src"
        )
    return (
        f"WITH src AS ({source}) SELECT *, CASE WHEN cardinality BETWEEN 2 AND 100 THEN 'categorical' "
        "WHEN mean_length > 5 AND distinct_share > 0.6 THEN 'text' ELSE 'other' END AS role FROM (" + " UNION ALL ".join(parts) + ")"
    )


def _roles(name):
    def build(spark, d):
        roles = profile.column_roles(load(spark, d, name).select(*STRINGS[name]))
        return roles.withColumns({"mean_length": F.round("mean_length", 6), "distinct_share": F.round("distinct_share", 6)})

    return build


for _name in ("documents", "customer", "part"):
    QUERIES.add(f"column_roles_{_name}", _roles(_name), _roles_sql(f"SELECT * FROM {_name}", STRINGS[_name]))

QUERIES.add(
    "datetime_columns",
    lambda spark, d: profile.column_roles(
        load(spark, d, "orders").select(
            F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.date_format("o_orderdate", "MM/dd/yyyy").alias("slashes"),
            F.when(F.col("o_orderkey") % 500 == 0, "n/a").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("broken"),
        )
    ).select("column", "filled", "role"),
    "WITH src AS (SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, strftime(o_orderdate, '%m/%d/%Y') AS slashes, "
    "CASE WHEN o_orderkey % 500 = 0 THEN 'n/a' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS broken FROM orders) "
    "SELECT 'day' AS \"column\", count(day) AS filled, CASE WHEN bool_and(try_strptime(day, '%Y-%m-%d') IS NOT NULL) THEN 'datetime' ELSE 'other' END AS role FROM src "
    "UNION ALL SELECT 'slashes', count(slashes), CASE WHEN bool_and(try_strptime(slashes, '%m/%d/%Y') IS NOT NULL) THEN 'datetime' ELSE 'other' END FROM src "
    "UNION ALL SELECT 'broken', count(broken), CASE WHEN bool_and(try_strptime(broken, '%Y-%m-%d') IS NOT NULL) THEN 'datetime' ELSE 'other' END FROM src",
)
QUERIES.add(
    "coerced_dates",
    lambda spark, d: profile.coerce_dates(
        load(spark, d, "orders").select(
            "o_orderkey", F.when(F.col("o_orderkey") % 5 == 0, "soon").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).alias("at")
        ), ["at"],
    ).select("o_orderkey", F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("at")),
    "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS at FROM orders",
)
QUERIES.add(
    "sample_rows",
    lambda spark, d: profile.sample_rows(load(spark, d, "orders"), "o_orderkey", n=500).select("o_orderkey", "o_custkey", "o_orderstatus"),
    "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders ORDER BY md5(concat('42-', o_orderkey)), o_orderkey LIMIT 500",
)


def _entropy_sql(source: str, columns) -> str:
    parts = [
        f"SELECT '{c}' AS \"column\", -sum(p * log2(p)) AS entropy FROM "
        f"(SELECT count(*) / sum(count(*)) OVER () AS p FROM {source} WHERE {c} IS NOT NULL GROUP BY {c})"
        for c in columns
    ]
    return " UNION ALL ".join(parts)


QUERIES.add(
    "category_entropy",
    lambda spark, d: profile.category_entropy(load(spark, d, "part"), STRINGS["part"]).withColumn("entropy", F.round("entropy", 6)),
    f"SELECT \"column\", round(entropy, 6) AS entropy FROM ({_entropy_sql('part', STRINGS['part'])})",
)
QUERIES.add(
    "mean_entropy",
    lambda spark, d: profile.mean_entropy(load(spark, d, "orders"), STRINGS["orders"]).withColumn("mean_entropy", F.round("mean_entropy", 6)),
    f"SELECT round(avg(entropy), 6) AS mean_entropy FROM ({_entropy_sql('orders', STRINGS['orders'])})",
)
QUERIES.add(
    "preview_customer",
    lambda spark, d: profile.preview(load(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment"), ["c_custkey"]),
    "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, coalesce(c_name, '') AS c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey, "
    "coalesce(c_mktsegment, '') AS c_mktsegment FROM customer ORDER BY customer.c_custkey LIMIT 5",
)
QUERIES.add(
    "preview_clean",
    lambda spark, d: fastscore.clean_preview(project(spark, d, "users").select("id", "email", "plan"), ["id"]),
    with_sql(f"SELECT id, {q.scrub('email')} AS email, plan FROM users_fx ORDER BY id LIMIT 5", "users"),
)
QUERIES.add(
    "aligned_columns",
    lambda spark, d: profile.align_columns(
        load(spark, d, "supplier").withColumnsRenamed({"s_nationkey": " nationkey", "s_acctbal": "acctbal "}),
        load(spark, d, "customer").withColumnsRenamed({"c_nationkey": "nationkey", "c_acctbal": "acctbal"}),
    )[1].groupBy("nationkey").agg(F.count("acctbal").alias("n")),
    "SELECT c_nationkey AS nationkey, count(c_acctbal) AS n FROM customer GROUP BY c_nationkey",
)

# ----------------------------------------------------------------- redaction


def _scrub(name, key, labels):
    def build(spark, d):
        table = spread(load(spark, d, name).select(*key, "text"), *key)
        return table.select(*key, pii.scrub(F.coalesce("text", F.lit("")), labels).alias("text"))

    return build


QUERIES.add(
    "scrub_documents", _scrub("documents", ["doc_id"], pii.ALL_LABELS), f"SELECT doc_id, {q.scrub('text')} AS text FROM documents"
)
QUERIES.add(
    "scrub_conversations", _scrub("conversations", ["conv_id", "turn"], pii.ALL_LABELS),
    f"SELECT conv_id, turn, {q.scrub('text')} AS text FROM conversations",
)
QUERIES.add(
    "scrub_four_patterns", _scrub("documents", ["doc_id"], pii.FOUR_LABELS),
    f"SELECT doc_id, {q.scrub('text', fv.PII_LABELS_WITHOUT_DATE)} AS text FROM documents",
)


def _dated(spark, d):
    """Order lines as text with a date, an identity number and a card number."""
    return load(spark, d, "orders").select(
        "o_orderkey",
        F.concat(
            F.lit("placed "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" by 123-45-"),
            F.lpad((F.col("o_custkey") % 10000).cast("string"), 4, "0"), F.lit(", card 4532 1234 5678 "),
            F.lpad((F.col("o_orderkey") % 10000).cast("string"), 4, "0"), F.lit(", stamped "), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'"),
        ).alias("note"),
    )


QUERIES.add(
    "scrub_order_notes",
    lambda spark, d: redaction.scrub_table(_dated(spark, d)),
    "SELECT o_orderkey, " + q.scrub("note") + " AS note FROM (SELECT o_orderkey, concat('placed ', strftime(o_orderdate, '%Y-%m-%d'), ' by 123-45-', "
    "lpad(CAST(o_custkey % 10000 AS VARCHAR), 4, '0'), ', card 4532 1234 5678 ', lpad(CAST(o_orderkey % 10000 AS VARCHAR), 4, '0'), ', stamped ', "
    "strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ')) AS note FROM orders)",
)


def _redacted_sql(source: str, columns) -> str:
    cells = " + ".join(f"CAST({q.scrub(f'coalesce({c}, {q.quote(str())})')} <> coalesce({c}, '') AS INT)" for c in columns)
    return f"SELECT CAST(coalesce(sum({cells}), 0) AS BIGINT) AS redacted_cells FROM ({source})"


QUERIES.add(
    "redaction_report",
    lambda spark, d: redaction.redaction_report(spread(load(spark, d, "documents"), "doc_id")),
    "SELECT redacted_cells, CASE WHEN redacted_cells > 0 THEN printf('Scrubbed %d cell(s) containing sensitive PII.', redacted_cells) "
    f"ELSE 'No sensitive PII detected.' END AS status FROM ({_redacted_sql('SELECT * FROM documents', STRINGS['documents'])})",
)
QUERIES.add(
    "pii_hits",
    lambda spark, d: redaction.pattern_hits(spread(load(spark, d, "documents").select("doc_id", "text"), "doc_id"), "text"),
    "SELECT " + ", ".join(
        f"count(*) FILTER (regexp_matches(text, {q.quote(fv.PII_PATTERNS[p])})) AS {p.lower()}" for p in fv.PII_LABELS_WITHOUT_DATE
    ) + " FROM documents",
)


def _nested(spark, d):
    people = project(spark, d, "users")
    rows = people.select(
        "id",
        F.struct(
            F.col("email").alias("mail"), F.array("email", "username").alias("names"), F.create_map(F.lit("m"), F.col("email")).alias("by_key"),
            F.array(F.struct(F.col("email").alias("inner"), F.lit(7).alias("n"))).alias("items"), F.array(F.array("email")).alias("lists"),
        ).alias("person"),
    )
    s = F.col("person")
    return redaction.scrub_nested(rows).select(
        "id", s["mail"].alias("mail"), F.array_join(s["names"], "|").alias("names"), s["by_key"]["m"].alias("by_key"),
        s["items"][0]["inner"].alias("item"), s["items"][0]["n"].cast("bigint").alias("n"), s["lists"][0][0].alias("lists"),
    )


QUERIES.add(
    "scrub_nested", _nested,
    with_sql(
        f"SELECT {q.scrub('id', fv.PII_LABELS_WITHOUT_DATE)} AS id, {q.scrub('email', fv.PII_LABELS_WITHOUT_DATE)} AS mail, "
        f"concat({q.scrub('email', fv.PII_LABELS_WITHOUT_DATE)}, '|', {q.scrub('username', fv.PII_LABELS_WITHOUT_DATE)}) AS names, "
        f"{q.scrub('email', fv.PII_LABELS_WITHOUT_DATE)} AS by_key, {q.scrub('email', fv.PII_LABELS_WITHOUT_DATE)} AS item, "
        "CAST(7 AS BIGINT) AS n, email AS lists FROM users_fx",
        "users",
    ),
)

# ---------------------------------------------------------------- categories

QUERIES.add(
    "keyword_category",
    lambda spark, d: with_category(spread(load(spark, d, "documents").select("doc_id", "text"), "doc_id"), F.col("text"), "c")
    .select("doc_id", "c.category", "c.confidence"),
    q.categorised("SELECT doc_id, text FROM documents", "text", "doc_id"),
)
QUERIES.add(
    "categorise_conversations",
    lambda spark, d: cat.categorise_rows(load(spark, d, "conversations").select("conv_id", "turn", "text"), "text").drop("text"),
    f"SELECT conv_id, turn, CASE WHEN {q.strip('text')} = '' OR text IS NULL THEN 'General/Other' ELSE category END AS category FROM ("
    + q.categorised("SELECT conv_id, turn, text FROM conversations", "text", "conv_id, turn, text") + ")",
)
QUERIES.add(
    "category_of_filename",
    lambda spark, d: cat.categorise_filename(
        load(spark, d, "part").select("p_partkey", F.concat(F.translate("p_name", " ", "_"), F.lit("."), F.lower("p_type")).alias("filename")), "filename"
    ),
    q.categorised(
        "SELECT p_partkey, filename, concat(filename, ' .', regexp_extract(lower(filename), '\\.([^.]*)$', 1)) AS t FROM "
        "(SELECT p_partkey, concat(replace(p_name, ' ', '_'), '.', lower(p_type)) AS filename FROM part)",
        "t", "p_partkey, filename",
    ),
)

_TAGGED = q.categorised("SELECT c_custkey, c_mktsegment, CAST(c_custkey % 101 AS DOUBLE) AS score FROM customer", "c_mktsegment", "c_custkey, score")
QUERIES.add(
    "tags",
    lambda spark, d: with_category(load(spark, d, "customer"), F.col("c_mktsegment"), "c").select(
        "c_custkey", F.array_join(tags(F.col("c.category"), (F.col("c_custkey") % 101).cast("double")), ",").alias("tags")
    ),
    "SELECT c_custkey, concat(replace(lower(category), '/', '-'), ',', CASE WHEN score >= 90 THEN 'production-ready' WHEN score >= 75 THEN 'high-quality' "
    f"ELSE 'needs-cleaning' END) AS tags FROM ({_TAGGED})",
)
QUERIES.add(
    "type_match",
    lambda spark, d: with_category(project(spark, d, "catalog"), F.col("filename"), "c").select(
        "file_hash", type_match(F.col("category"), F.when(F.col("confidence").isNotNull(), F.col("c.category"))).alias("match"),
        type_match(F.col("category"), F.col("file_type")).alias("match_suffix"),
    ),
    with_sql(
        "SELECT file_hash, CASE WHEN confidence IS NULL THEN NULL ELSE false END AS match, "
        "CASE WHEN file_type IS NULL THEN NULL ELSE category = file_type END AS match_suffix FROM catalog_fx", "catalog",
    ),
)


def _head_sql(source: str, columns, order: str, n: int = 10, scrubbed=()) -> str:
    cells = ", ".join(f"coalesce({q.scrub(c) if c in scrubbed else f'CAST({c} AS VARCHAR)'}, '')" for c in columns)
    return f"SELECT string_agg(cells, ' ' ORDER BY {order}) AS head FROM (SELECT {order}, concat_ws(' ', {cells}) AS cells FROM ({source}) ORDER BY {order} LIMIT {n})"


QUERIES.add(
    "categorise_dataset",
    lambda spark, d: cat.categorise_dataset(load(spark, d, "documents").select("doc_id", "text", "lang"), "finance_leads.csv", ["doc_id"]),
    q.categorised(
        f"SELECT concat('finance_leads.csv doc_id text lang ', head) AS t FROM ({_head_sql('SELECT * FROM documents', ('doc_id', 'text', 'lang'), 'doc_id')})", "t", "1 AS one"
    ).replace("SELECT 1 AS one, ", "SELECT ", 1),
)
QUERIES.add(
    "categorise_first_row",
    lambda spark, d: cat.categorise_first_row(load(spark, d, "documents").select("doc_id", "text", "lang", "source"), ["doc_id"]),
    "SELECT category FROM (" + q.categorised(
        "SELECT concat('doc_id text lang source ', text, ' ', lang, ' ', source) AS t FROM documents ORDER BY doc_id LIMIT 1", "t", "1 AS one") + ")",
)

# ---------------------------------------------------------------- fast score


def _report(df):
    return df.select(
        "predicted_category", "confidence", "quality_score", "status", F.array_join("details", "|").alias("details"),
        F.array_join("generated_tags", ",").alias("generated_tags"), "best_use_case", F.col("stats.row_count").alias("row_count"),
        F.col("stats.missing_cells").alias("missing_cells"), F.col("stats.duplicate_rows").alias("duplicate_rows"), "redacted_cells", "pii_status",
    )


def _report_sql(source: str, columns, strings, filename: str, order: str) -> str:
    head = _head_sql(source, columns, order, 10, strings)
    text = f"SELECT concat({q.quote(filename + ' ' + ' '.join(columns) + ' ')}, head) AS t FROM ({head})"
    category = q.categorised(text, "t", "1 AS one")
    lines = " || '|' || ".join(
        [
            "'PII scrubbed with deterministic fast path.'", "'Categorized as ' || category || '.'",
            "'Scored ' || printf('%.1f', quality_score) || '/100.'", "'Best Use Case: ' || best_use_case",
            *[f"'{n}: ' || printf('%.1f', {n.lower()})" for n in fv.FAST_WEIGHTS],
        ]
    )
    return (
        f"WITH s AS ({q.fast_score(q.table_stats(source, list(columns)))}), r AS ({_redacted_sql(source, strings)}), c AS ({category}) "
        "SELECT category AS predicted_category, confidence, quality_score, CASE WHEN quality_score >= 80 THEN 'passed' ELSE 'needs_review' END AS status, "
        f"{lines} AS details, replace(lower(category), '/', '-') || ',' || CASE WHEN quality_score >= 90 THEN 'production-ready' "
        "WHEN quality_score >= 75 THEN 'high-quality' ELSE 'needs-cleaning' END AS generated_tags, best_use_case, row_count, missing_cells, duplicate_rows, "
        "redacted_cells, CASE WHEN redacted_cells > 0 THEN printf('Scrubbed %d cell(s) containing sensitive PII.', redacted_cells) "
        "ELSE 'No sensitive PII detected.' END AS pii_status FROM s, r, c"
    )


def _assess(name, filename, order):
    return lambda spark, d: _report(fastscore.assess(load(spark, d, name).select(*REPORT_COLUMNS[name]), filename, [order]))


REPORT_COLUMNS = {
    "documents": COLUMNS["documents"], "customer": ("c_custkey", "c_name", "c_nationkey", "c_mktsegment"),
    "conversations": COLUMNS["conversations"], "part": ("p_partkey", "p_name", "p_brand", "p_type", "p_size"),
}
for _name, _file, _order in (
    ("documents", "documents.csv", "doc_id"), ("customer", "customer_invoice.csv", "c_custkey"), ("part", "parts.csv", "p_partkey"),
):
    QUERIES.add(
        f"fast_report_{_name}", _assess(_name, _file, _order),
        _report_sql(f"SELECT {', '.join(REPORT_COLUMNS[_name])} FROM {_name}", REPORT_COLUMNS[_name], STRINGS[_name], _file, _order),
    )


def _narrow(spark, d):
    """Catalogue rows with gaps and copies."""
    return project(spark, d, "catalog").select("category", "file_type", "quality_score")


QUERIES.add(
    "fast_score_catalog",
    lambda spark, d: fastscore.with_quality_score(profile.table_stats(_narrow(spark, d))).select(
        "row_count", "missing_cells", "duplicate_rows", "completeness", "uniqueness", "consistency", "representativeness", "quality_score", "best_use_case"
    ),
    "SELECT row_count, missing_cells, duplicate_rows, completeness, uniqueness, consistency, representativeness, quality_score, best_use_case FROM ("
    + q.fast_score(q.table_stats(with_sql("SELECT category, file_type, quality_score FROM catalog_fx", "catalog"), ["category", "file_type", "quality_score"])) + ")",
)
QUERIES.add(
    "score_ladders",
    lambda spark, d: load(spark, d, "orders").select(
        "o_orderkey", ((F.col("o_orderkey") % 1001) / 10).alias("score")
    ).select("o_orderkey", numeric.best_use(F.col("score")).alias("best_use_case"), numeric.pass_gate(F.col("score")).alias("status"), numeric.quality_tier(F.col("score")).alias("tier")),
    "SELECT o_orderkey, CASE WHEN s >= 90 THEN 'Production analytics and model training' WHEN s >= 80 THEN 'Business intelligence and exploratory analysis' "
    "WHEN s >= 70 THEN 'Exploratory Data Analysis (EDA)' ELSE 'Needs cleaning before reuse' END AS best_use_case, CASE WHEN s >= 80 THEN 'passed' ELSE 'needs_review' END AS status, "
    "CASE WHEN s >= 85 THEN 'Excellent' WHEN s >= 70 THEN 'Good' WHEN s >= 55 THEN 'Fair' ELSE 'Poor' END AS tier FROM (SELECT o_orderkey, (o_orderkey % 1001) / 10 AS s FROM orders)",
)
QUERIES.add(
    "unread_files",
    lambda spark, d: fastscore.assess_unread(project(spark, d, "catalog").filter("file_type IS NULL OR file_type <> 'csv'").select("file_hash", "filename"), keep=("file_hash",))
    .select("file_hash", "predicted_category", "confidence", "quality_score", "status", F.array_join("details", "|").alias("details"), F.array_join("generated_tags", ",").alias("tags")),
    with_sql(
        "SELECT file_hash, category AS predicted_category, confidence, CAST(75.0 AS DOUBLE) AS quality_score, 'needs_review' AS status, "
        "'PII scrubbed with deterministic fast path.|Categorized as ' || category || '.|Scored 75.0/100.|Best Use Case: Exploratory Data Analysis (EDA)' AS details, "
        "replace(lower(category), '/', '-') || ',high-quality' AS tags FROM ("
        + q.categorised("SELECT file_hash, concat(filename, ' ', regexp_extract(filename, '\\.[^.]*$')) AS t FROM catalog_fx WHERE file_type IS NULL OR file_type <> 'csv'", "t", "file_hash") + ")",
        "catalog",
    ),
)

# ----------------------------------------------------- many files in one run


def delimited_lines(spark, d):
    """Three tables as lines of delimited files."""
    def lines(name, columns, order):
        table = load(spark, d, name)
        cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
        quoted = [F.when(F.contains(c, F.lit(",")) | F.contains(c, F.lit('"')), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c) for c in cells]
        def at(block, row):
            return F.struct(block.alias("block"), row.cast("bigint").alias("row"))

        body = table.select(F.lit(name).alias("file"), at(F.lit(1), F.col(order)).alias("at"), F.concat_ws(",", *quoted).alias("line"))
        head = table.limit(1).select(F.lit(name).alias("file"), at(F.lit(0), F.lit(0)).alias("at"), F.lit(",".join(columns)).alias("line"))
        return head.unionByName(body)

    out = None
    for name, (columns, order) in FILE_TABLES.items():
        part = lines(name, columns, order)
        out = part if out is None else out.unionByName(part)
    return out


FILE_TABLES = {
    "customer": (("c_custkey", "c_name", "c_nationkey", "c_mktsegment"), "c_custkey"),
    "events": (("event_id", "user_id", "event_type", "props"), "event_id"),
    "part": (("p_partkey", "p_name", "p_type"), "p_partkey"),
}


FILE_STRINGS = {"customer": ("c_name", "c_mktsegment"), "events": ("event_type", "props"), "part": ("p_name", "p_type")}


def file_names(lines):
    return lines.select("file").distinct().withColumn("filename", F.concat("file", F.lit(".csv")))


def _assess_files(spark, d):
    lines = delimited_lines(spark, d)
    return intake.assess_files(lines, file_names(lines)).select(
        "file", "predicted_category", "confidence", "quality_score", "redacted_cells", "stats", F.array_join("tags", ",").alias("tags")
    )


def _assess_files_sql() -> str:
    strings = FILE_STRINGS
    parts = []
    for name, (columns, order) in FILE_TABLES.items():
        source = f"SELECT {', '.join(columns)} FROM {name}"
        inner = _report_sql(source, columns, strings[name], f"{name}.csv", order)
        parts.append(
            f"SELECT '{name}' AS file, predicted_category, confidence, quality_score, redacted_cells, "
            f"'{{\"row_count\":' || row_count || ',\"column_count\":{len(columns)},\"missing_cells\":' || missing_cells || ',\"missing_percentage\":0.0,\"duplicate_rows\":' || duplicate_rows || '}}' AS stats, "
            f"generated_tags AS tags FROM ({inner})"
        )
    return " UNION ALL ".join(parts)


QUERIES.add("assess_files", _assess_files, _assess_files_sql())


QUERIES.add(
    "scrubbed_lines",
    lambda spark, d: intake.scrubbed_lines(delimited_lines(spark, d)).select("file", F.col("at.block").cast("bigint").alias("block"), F.col("at.row").alias("row"), "line"),
    " UNION ALL ".join(
        f"SELECT '{name}' AS file, CAST(0 AS BIGINT) AS block, CAST(0 AS BIGINT) AS row, '{','.join(columns)}' AS line UNION ALL SELECT '{name}', 1, {order}, concat_ws(',', "
        + ", ".join(
            f"CASE WHEN contains({c}, ',') OR contains({c}, '\"') THEN '\"' || replace({q.scrub(c)}, '\"', '\"\"') || '\"' ELSE {q.scrub(c)} END" if c in FILE_STRINGS[name] else c for c in columns
        )
        + f") FROM {name}"
        for name, (columns, order) in FILE_TABLES.items()
    ),
)
