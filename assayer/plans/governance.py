"""Queries: catalogue, access, retention, rights, reviews, users and audit."""

from pyspark.sql import functions as F

from assayer import fixed_values as fv
from assayer.functions import pii, policy
from assayer.functions.money import normalise_price, price_problem
from assayer.functions.times import iso_utc, parse_instant
from assayer.operators import access, audit, catalog as ct, intake, retention, reviews as rv, rights, users as us
from assayer.plans import sqltext as q
from assayer.plans.registry import Registry
from assayer.plans.tables import AS_OF_CATALOG, AS_OF_REVIEWS, catalog, load, moment, project, reviews, users, with_sql

QUERIES = Registry()


def stamp(column: str, name: str | None = None):
    """Time as text, so that engines print it alike."""
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss").alias(name or column)


def stamp_sql(column: str, name: str | None = None) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S') AS {name or column}"


EXTRA_OWNER = "extra_owner"
NUMBER = "CAST(substring(file_hash, 4) AS BIGINT)"

# --------------------------------------------------------------- policy rules

SENSITIVITY = (
    "CASE WHEN redacted_cells > 0 AND category <> 'medical' THEN 'sensitive' ELSE CASE category WHEN 'medical' THEN 'special_category' "
    "WHEN 'finance' THEN 'confidential' WHEN 'geospatial' THEN 'confidential' ELSE 'internal' END END"
)
PLAN_OF = "CASE {s} WHEN 'public' THEN 'free' WHEN 'sensitive' THEN 'business' WHEN 'special_category' THEN 'enterprise' ELSE 'basic' END"
KYB_OF = "({s} IN ('sensitive', 'special_category'))"


def _policy(spark, d):
    flat = project(spark, d, "catalog")
    rule = policy.access_policy(F.col("category"), F.col("redacted_cells"))
    return flat.select(
        "file_hash", rule["sensitivity"].alias("sensitivity"), rule["min_plan"].alias("min_plan"), rule["kyb_required"].alias("kyb_required"),
        F.array_join(rule["permitted_uses"], ",").alias("permitted_uses"), policy.listing_decision(rule["sensitivity"]).alias("listing_decision"),
    )


QUERIES.add(
    "access_policy", _policy,
    with_sql(
        f"SELECT file_hash, s AS sensitivity, {PLAN_OF.format(s='s')} AS min_plan, {KYB_OF.format(s='s')} AS kyb_required, 'analytics,research,product_development' AS permitted_uses, "
        f"CASE WHEN {KYB_OF.format(s='s')} THEN 'needs_review' ELSE 'listable' END AS listing_decision FROM (SELECT file_hash, {SENSITIVITY} AS s FROM catalog_fx)", "catalog",
    ),
)
QUERIES.add(
    "sensitivity_names",
    lambda spark, d: load(spark, d, "part").select("p_partkey", policy.normalise_sensitivity(F.when(F.col("p_partkey") % 3 == 0, " Special-Category ").when(F.col("p_partkey") % 3 == 1, "PUBLIC").otherwise(F.col("p_type"))).alias("sensitivity")),
    "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'special_category' WHEN 1 THEN 'public' ELSE 'internal' END AS sensitivity FROM part",
)


def _prices(spark, d):
    key, total = F.col("o_orderkey"), F.col("o_totalprice")
    return load(spark, d, "orders").select(
        "o_orderkey",
        F.when(key % 6 == 0, "").when(key % 6 == 1, "abc").when(key % 6 == 2, F.concat(F.lit("-"), (key % 90 + 1).cast("string")))
        .when(key % 6 == 3, F.concat(F.lit("  "), (key % 1000).cast("string"), F.lit(".5 "))).when(key % 6 == 4, F.concat((key % 77).cast("string"), F.lit("e1")))
        .otherwise(F.format_string("%.3f", F.floor(total) + 0.128)).alias("raw"),
    )


QUERIES.add(
    "price_normalise",
    lambda spark, d: _prices(spark, d).select("o_orderkey", normalise_price(F.col("raw")).cast("double").alias("price"), price_problem(F.col("raw")).alias("problem")),
    "SELECT o_orderkey, CASE o_orderkey % 6 WHEN 3 THEN (o_orderkey % 1000) + 0.5 WHEN 4 THEN (o_orderkey % 77) * 10.0 WHEN 5 THEN floor(o_totalprice) + 0.13 END::DOUBLE AS price, "
    "CASE o_orderkey % 6 WHEN 1 THEN 'invalid_ask_price' WHEN 2 THEN 'negative_ask_price' END AS problem FROM orders",
)
QUERIES.add(
    "version_and_time",
    lambda spark, d: load(spark, d, "orders").select(
        "o_orderkey",
        ct.coerce_version(F.when(F.col("o_orderkey") % 3 == 0, "7").when(F.col("o_orderkey") % 3 == 1, "2.9").otherwise("x")).cast("bigint").alias("version"),
        iso_utc(parse_instant(F.when(F.col("o_orderkey") % 4 == 0, "later").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")), moment(AS_OF_CATALOG))).alias("at"),
    ),
    "SELECT o_orderkey, CAST(CASE o_orderkey % 3 WHEN 0 THEN 7 WHEN 1 THEN 2 ELSE 0 END AS BIGINT) AS version, "
    "CASE WHEN o_orderkey % 4 = 0 THEN '2001-01-01T00:00:00Z' ELSE strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') END AS at FROM orders",
)
QUERIES.add(
    "mime_and_keys",
    lambda spark, d: project(spark, d, "catalog").select(
        "file_hash", ct.mime_choice(ct.safe_name(F.concat(F.lit("../up/"), "filename")), F.when(F.col("redacted_cells") == 0, "application/octet-stream").when(F.col("redacted_cells") == 1, "text/tab")).alias("m"),
        ct.object_key(F.col("file_hash"), ct.safe_name(F.concat(F.lit("../up/"), "filename"))).alias("object_key"), ct.file_type(F.col("filename")).alias("suffix"),
    ).select("file_hash", "m.mime", "m.mime_source", "object_key", "suffix"),
    with_sql(
        "SELECT file_hash, CASE WHEN redacted_cells = 1 THEN 'text/tab' ELSE coalesce(g, 'application/octet-stream') END AS mime, "
        "CASE WHEN redacted_cells = 1 THEN 'client' WHEN g IS NOT NULL THEN 'filename' ELSE 'default' END AS mime_source, 'datasets/' || file_hash || '/' || filename AS object_key, file_type AS suffix "
        "FROM (SELECT *, CASE file_type WHEN 'csv' THEN 'text/csv' WHEN 'json' THEN 'application/json' WHEN 'txt' THEN 'text/plain' END AS g FROM catalog_fx)", "catalog",
    ),
)

# -------------------------------------------------------------- catalog writes


def _batch(spark, d):
    """One to four versions of each record, and a new record beside each."""
    base = catalog(spark, d)
    number = F.substring("file_hash", 4, 20).cast("bigint")
    versions = base.withColumn("arrival", F.explode(F.sequence(F.lit(1), number % 4 + 1)))
    changed = versions.withColumn("quality_score", F.col("arrival") * 10.0)
    new = base.withColumn("file_hash", F.concat(F.lit("new-"), number.cast("string"))).withColumn("arrival", F.lit(1).cast("bigint"))
    return changed.unionByName(new)


QUERIES.add(
    "catalog_upsert",
    lambda spark, d: ct.upsert(catalog(spark, d), _batch(spark, d), ["arrival"]).select("file_hash", "category", "quality_score"),
    with_sql(
        f"SELECT file_hash, category, CAST(({NUMBER} % 4 + 1) * 10.0 AS DOUBLE) AS quality_score FROM catalog_fx "
        f"UNION ALL SELECT 'new-' || {NUMBER}, category, quality_score FROM catalog_fx", "catalog",
    ),
)


def _records(spark, d):
    """Records built from upload facts on the projected catalogue."""
    flat = project(spark, d, "catalog")
    mime = ct.mime_choice(F.col("filename"), F.lit(None).cast("string"))
    items = flat.select(
        "file_hash", "filename", "category", F.col("extra_owner").alias("owner"), F.lit("").alias("description"), F.col("ask_price_usd").cast("string").alias("ask_price_usd"),
        "bytes", mime["mime"].alias("mime"), mime["mime_source"].alias("mime_source"), F.lit("Financial").alias("predicted_category"), "confidence",
        F.coalesce("quality_score", F.lit(75.0)).alias("quality_score"), F.lit("passed").alias("status"), F.array(F.lit("x")).alias("details"),
        F.lit("Exploratory Data Analysis (EDA)").alias("best_use_case"), "redacted_cells", F.lit("ok").alias("pii_status"), F.lit("{}").alias("stats"),
        F.array(F.lit("financial")).alias("tags"),
    )
    return ct.build_records(items, moment(AS_OF_CATALOG))


QUERIES.add(
    "catalog_records",
    lambda spark, d: _records(spark, d).select(
        "file_hash", "file_type", "quality_score", F.col("quality_scores")["overall"].alias("overall"), F.col("category_verification.match").alias("match"), "description",
        F.col("access_policy.sensitivity").alias("sensitivity"), F.col("compliance_evidence")["listing_decision"].alias("listing"), F.col("provenance")["mime_source"].alias("mime_source"),
        F.col("retention_policy")["retention_days"].alias("days"), stamp("retention_expires_at", "expires"), F.col("ask_price_usd").cast("double").alias("price"),
        F.col("extra")["owner_user_id"].alias("extra_owner"), "object_key",
    ),
    with_sql(
        f"SELECT file_hash, file_type, coalesce(quality_score, 75.0) AS quality_score, coalesce(quality_score, 75.0) AS overall, false AS match, 'Exploratory Data Analysis (EDA)' AS description, s AS sensitivity, "
        f"CASE WHEN {KYB_OF.format(s='s')} THEN 'needs_review' ELSE 'listable' END AS listing, CASE WHEN file_type IS NULL THEN 'default' ELSE 'filename' END AS mime_source, '365' AS days, '2002-01-01 00:00:00' AS expires, "
        f"CAST(ask_price_usd AS DOUBLE) AS price, extra_owner, 'datasets/' || file_hash || '/' || filename AS object_key FROM (SELECT *, {SENSITIVITY} AS s FROM catalog_fx)", "catalog",
    ),
)


def _loose(spark, d):
    """Records as they come from an older store: control fields only in ``extra``."""
    base = catalog(spark, d)
    number = F.substring("file_hash", 4, 20).cast("bigint")
    notes = F.create_map(
        F.lit("owner_user_id"), F.col("extra")["owner_user_id"], F.lit("restriction_status"), F.when(number % 2 == 0, "restricted"),
        F.lit("provenance"), F.lit('{"source":"old"}'), F.lit("retention_expires_at"), F.date_format("retention_expires_at", "yyyy-MM-dd'T'HH:mm:ss'Z'"),
    )
    return base.withColumns(
        {
            "owner": F.when(number % 5 == 0, F.col("owner")).otherwise(""), "extra": notes, "schema_version": F.lit("1.0"), "restriction_status": F.when(number % 3 == 0, "active").otherwise(""),
            "retention_expires_at": F.lit(None).cast("string"), "timestamp": F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss'Z'"), "ask_price_usd": F.when(number % 7 == 0, "-3").otherwise("12.345"),
        }
    )


QUERIES.add(
    "catalog_resolve",
    lambda spark, d: ct.resolve_fields(_loose(spark, d), moment(AS_OF_CATALOG)).select(
        "file_hash", "owner", F.col("schema_version").cast("bigint").alias("schema_version"), "restriction_status", F.col("provenance")["source"].alias("source"),
        stamp("retention_expires_at", "expires"), F.col("ask_price_usd").cast("double").alias("price"), F.col("extra")["ask_price_usd"].alias("noted_price"),
    ),
    with_sql(
        f"SELECT file_hash, CASE WHEN {NUMBER} % 5 = 0 AND owner IS NOT NULL THEN owner ELSE extra_owner END AS owner, CAST(1 AS BIGINT) AS schema_version, "
        f"CASE WHEN {NUMBER} % 3 = 0 THEN 'active' WHEN {NUMBER} % 2 = 0 THEN 'restricted' ELSE 'active' END AS restriction_status, 'old' AS source, {stamp_sql('retention_expires_at', 'expires')}, "
        f"CAST(CASE WHEN {NUMBER} % 7 <> 0 THEN 12.35 END AS DOUBLE) AS price, CASE WHEN {NUMBER} % 7 <> 0 THEN '12.35' END AS noted_price FROM catalog_fx", "catalog",
    ),
)


def _updates(spark, d):
    """An update for each record; null parts are not supplied."""
    number = F.substring("file_hash", 4, 20).cast("bigint")
    given = number % 4 == 1
    return project(spark, d, "catalog").select(
        "file_hash", F.when(given, F.create_map(F.lit("owner_user_id"), F.lit("user-x"), F.lit("note"), F.lit("n"))).alias("extra"),
        F.when(number % 8 == 1, "restricted").alias("restriction_status"), F.when(given, F.struct(F.lit("enterprise").alias("min_plan"))).alias("access_policy"),
    )


QUERIES.add(
    "catalog_controls",
    lambda spark, d: ct.update_controls(catalog(spark, d), _updates(spark, d)).select(
        "file_hash", F.col("extra")["owner_user_id"].alias("extra_owner"), F.col("extra")["note"].alias("note"), "restriction_status",
        F.col("access_policy.min_plan").alias("min_plan"), F.col("access_policy.sensitivity").alias("sensitivity"),
    ),
    with_sql(
        f"SELECT file_hash, CASE WHEN n % 4 = 1 THEN 'user-x' ELSE extra_owner END AS extra_owner, CASE WHEN n % 4 = 1 THEN 'n' END AS note, "
        f"CASE WHEN n % 8 = 1 THEN 'restricted' ELSE restriction_status END AS restriction_status, CASE WHEN n % 4 = 1 THEN 'enterprise' WHEN n % 17 <> 0 THEN {PLAN_OF.format(s='s')} END AS min_plan, "
        f"CASE WHEN n % 17 <> 0 THEN s END AS sensitivity FROM (SELECT *, {NUMBER} AS n, {SENSITIVITY} AS s FROM catalog_fx)", "catalog",
    ),
)


def _changes(spark, d):
    """A change request per line item; about one in six comes from the owner."""
    lines = load(spark, d, "lineitem")
    orders = load(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    joined = lines.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").dropDuplicates(["l_orderkey", "l_linenumber"]).join(orders, "l_orderkey", "left")
    who = F.when(F.col("l_orderkey") % 6 == 0, F.concat(F.lit("user-"), F.col("o_custkey").cast("string"))).when(F.col("l_orderkey") % 6 == 1, "").otherwise("user-none")
    return joined.select(
        F.concat(F.lit("ds-"), (F.col("l_orderkey") + F.when(F.col("l_orderkey") % 10 == 0, 100000000).otherwise(0)).cast("string")).alias("file_hash"),
        who.alias("requester_id"), F.when(F.col("l_orderkey") % 9 == 0, F.repeat(F.lit("x"), 1001)).otherwise(F.concat(F.lit("text "), F.col("l_linenumber").cast("string"))).alias("description"),
        F.col("l_linenumber").cast("bigint").alias("seq"),
    )


_CHANGES = (
    "SELECT DISTINCT concat('ds-', l_orderkey + CASE WHEN l_orderkey % 10 = 0 THEN 100000000 ELSE 0 END) AS file_hash, l_orderkey, CAST(l_linenumber AS BIGINT) AS seq, "
    "CASE l_orderkey % 6 WHEN 0 THEN concat('user-', o_custkey) WHEN 1 THEN '' ELSE 'user-none' END AS requester_id FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey"
)
_REASON = (
    "CASE WHEN l_orderkey % 10 = 0 OR c.file_hash IS NULL THEN 'not_found' WHEN requester_id = '' THEN 'missing_requester' WHEN coalesce(extra_owner, '') <> requester_id THEN 'not_owner' END"
)
QUERIES.add(
    "description_decisions",
    lambda spark, d: ct.decide_descriptions(catalog(spark, d), _changes(spark, d)).groupBy("reason").agg(F.count("*").alias("n")),
    with_sql(f"SELECT CASE WHEN l_orderkey % 9 = 0 THEN 'description_too_long' ELSE {_REASON} END AS reason, count(*) AS n FROM ({_CHANGES}) r LEFT JOIN catalog_fx c ON c.file_hash = r.file_hash GROUP BY 1", "catalog"),
)


def _described(spark, d):
    current = catalog(spark, d)
    decided = ct.decide_descriptions(current, _changes(spark, d))
    return ct.apply_descriptions(current, decided, ["seq"]).select("file_hash", "description")


QUERIES.add(
    "description_updates", _described,
    with_sql(
        f"SELECT c.file_hash, coalesce('text ' || max(seq), '') AS description FROM catalog_fx c LEFT JOIN (SELECT r.file_hash, seq FROM ({_CHANGES}) r LEFT JOIN catalog_fx c ON c.file_hash = r.file_hash "
        f"WHERE l_orderkey % 9 <> 0 AND {_REASON} IS NULL) u ON u.file_hash = c.file_hash GROUP BY c.file_hash", "catalog",
    ),
)


def _deleted(spark, d):
    current = catalog(spark, d)
    decided = ct.decide_changes(current, _changes(spark, d))
    return ct.delete_records(current, decided.filter("reason IS NULL")).select("file_hash", "category")


QUERIES.add(
    "catalog_delete", _deleted,
    with_sql(
        f"SELECT file_hash, category FROM catalog_fx WHERE file_hash NOT IN (SELECT r.file_hash FROM ({_CHANGES}) r JOIN catalog_fx c ON c.file_hash = r.file_hash WHERE {_REASON} IS NULL)", "catalog"
    ),
)
QUERIES.add(
    "schema_evolution",
    lambda spark, d: ct.add_columns(
        project(spark, d, "catalog").select("file_hash", "restriction_status").withColumn("restriction_status", F.when(F.col("restriction_status") == "restricted", "restricted")),
        {"restriction_status": F.lit("active"), "retention_days": F.lit(365), "object_key": F.lit(None).cast("string")},
    ).select("file_hash", "restriction_status", F.col("retention_days").cast("bigint").alias("retention_days"), "object_key"),
    with_sql("SELECT file_hash, restriction_status, CAST(365 AS BIGINT) AS retention_days, CAST(NULL AS VARCHAR) AS object_key FROM catalog_fx", "catalog"),
)

# --------------------------------------------------------------- catalog reads

LISTED = ("file_hash", "category", "quality_score")
LISTED_SQL = ", ".join(LISTED)
NEWEST = 'ORDER BY "timestamp" DESC, file_hash'
QUERIES.add("catalog_list", lambda spark, d: ct.list_records(catalog(spark, d), 50).select(*LISTED), with_sql(f"SELECT {LISTED_SQL} FROM catalog_fx {NEWEST} LIMIT 50", "catalog"))
QUERIES.add("catalog_list_all", lambda spark, d: ct.list_records(catalog(spark, d), 0).select(*LISTED), with_sql(f"SELECT {LISTED_SQL} FROM catalog_fx", "catalog"))
QUERIES.add(
    "catalog_by_owner", lambda spark, d: ct.list_by_owner(catalog(spark, d), "user-11", 2000).select(*LISTED),
    with_sql(f"SELECT {LISTED_SQL} FROM (SELECT * FROM catalog_fx {NEWEST} LIMIT 2000) WHERE extra_owner = 'user-11'", "catalog"),
)
QUERIES.add(
    "catalog_by_owner_filter_first", lambda spark, d: ct.list_by_owner(catalog(spark, d), "user-11", 5, filter_first=True).select(*LISTED),
    with_sql(f"SELECT {LISTED_SQL} FROM catalog_fx WHERE extra_owner = 'user-11' {NEWEST} LIMIT 5", "catalog"),
)
QUERIES.add(
    "catalog_owned", lambda spark, d: catalog(spark, d).groupBy(ct.owner_id().alias("owner")).agg(F.count("*").alias("n")),
    with_sql("SELECT coalesce(owner, extra_owner) AS owner, count(*) AS n FROM catalog_fx GROUP BY 1", "catalog"),
)
QUERIES.add(
    "catalog_lookup", lambda spark, d: ct.load_records(catalog(spark, d), project(spark, d, "requests").filter("purpose = 'resale'")).select(*LISTED),
    with_sql(f"SELECT {LISTED_SQL} FROM catalog_fx WHERE file_hash IN (SELECT file_hash FROM requests_fx WHERE purpose = 'resale')", "catalog", "requests"),
)
_MARKET = "FROM catalog_fx WHERE category = 'finance' AND coalesce(file_type, 'other') = 'csv' AND confidence >= 0.6 AND confidence <= 0.9 AND quality_score >= 20"
QUERIES.add(
    "market_filter", lambda spark, d: ct.market_filter(catalog(spark, d), "finance", "csv", (0.6, 0.9), (20.0, None)).select(*LISTED),
    with_sql(f"SELECT {LISTED_SQL} {_MARKET}", "catalog"),
)
QUERIES.add(
    "market_filter_open", lambda spark, d: ct.market_filter(catalog(spark, d), "all", "other", (0.9, 0.1), (None, 50.0)).select(*LISTED),
    with_sql(f"SELECT {LISTED_SQL} FROM catalog_fx WHERE file_type IS NULL AND quality_score <= 50", "catalog"),
)
for _key, _order in (("newest", NEWEST), ("trending", 'ORDER BY coalesce(quality_score, 0) DESC, "timestamp" DESC, file_hash')):
    QUERIES.add(
        f"market_{_key}", lambda spark, d, k=_key: ct.market_sort(catalog(spark, d), k).select(*LISTED), with_sql(f"SELECT {LISTED_SQL} FROM catalog_fx {_order}", "catalog")
    )
_HISTORY = {"date": 'epoch_us("timestamp")', "quality": "coalesce(quality_score, -1)", "size": "coalesce(bytes, -1)"}
for _field, _expr in _HISTORY.items():
    for _way in ("asc", "desc"):
        QUERIES.add(
            f"history_{_field}_{_way}", lambda spark, d, k=f"{_field}_{_way}": ct.history_sort(catalog(spark, d), k, "file_hash").select(*LISTED),
            with_sql(f"SELECT {LISTED_SQL} FROM catalog_fx ORDER BY {_expr} {_way}, file_hash", "catalog"),
        )
QUERIES.add(
    "facets", lambda spark, d: ct.facets(load(spark, d, "part").select(F.col("p_brand").alias("category"), "p_partkey"), "p_partkey"),
    "SELECT row_number() OVER (ORDER BY m) AS position, facet FROM (SELECT lower(p_brand) AS facet, min(p_partkey) AS m FROM part GROUP BY 1 ORDER BY 2 LIMIT 8)",
)
QUERIES.add(
    "facets_fixed", lambda spark, d: ct.facets(project(spark, d, "catalog"), "file_hash"),
    "SELECT * FROM (VALUES " + ", ".join(f"(CAST({i} AS BIGINT), '{c}')" for i, c in enumerate(fv.UPLOAD_CATEGORIES, 1)) + ") t(position, facet) WHERE (SELECT count(*) FROM orders) > 0",
)
QUERIES.add(
    "detail_view", lambda spark, d: ct.detail_view(catalog(spark, d)).withColumn("ask_price_usd", F.col("ask_price_usd").cast("double")),
    with_sql(
        f"SELECT file_hash, coalesce(quality_score, 0.0) AS score, CASE WHEN {NUMBER} % 4 <> 0 THEN confidence END AS confidence, '' AS description, CAST(ask_price_usd AS DOUBLE) AS ask_price_usd FROM catalog_fx", "catalog"
    ),
)

# ----------------------------------------------------------------------- gate


def _uploads(spark, d):
    n = F.substring("file_hash", 4, 20).cast("bigint")
    return project(spark, d, "catalog").select(
        F.col("file_hash").alias("file"), "file_hash", "filename", F.when(n % 19 == 0, "misc").otherwise(F.col("category")).alias("category"),
        F.when(n % 23 == 0, F.lit(None)).otherwise(F.coalesce("extra_owner", F.lit("user-none"))).alias("user_id"), F.lit("").alias("description"),
        F.when(n % 29 == 0, "free").when(n % 31 == 0, "-1").otherwise(F.col("ask_price_usd").cast("string")).alias("ask_price_usd"),
        F.lit(None).cast("string").alias("content_type"), F.when(n % 37 == 0, 0).otherwise(F.col("bytes")).cast("bigint").alias("bytes"),
    )


_GATE = (
    f"SELECT c.*, n, CASE WHEN n % 19 = 0 THEN 'invalid_category' WHEN n % 23 = 0 THEN 'missing_user_id' WHEN NOT coalesce(u.kyb_status = 'verified' AND NOT u.restricted, false) THEN 'seller_kyb_required' "
    f"WHEN n % 29 = 0 THEN 'invalid_ask_price' WHEN n % 31 = 0 THEN 'negative_ask_price' WHEN n % 37 = 0 OR bytes = 0 THEN 'empty_file' END AS reason FROM (SELECT *, {NUMBER} AS n FROM catalog_fx) c LEFT JOIN users_fx u ON u.id = c.extra_owner"
)
QUERIES.add(
    "intake_gate", lambda spark, d: intake.gate_uploads(_uploads(spark, d), users(spark, d)).select("file_hash", "reason", "mime"),
    with_sql(
        f"SELECT file_hash, reason, CASE file_type WHEN 'csv' THEN 'text/csv' WHEN 'json' THEN 'application/json' WHEN 'txt' THEN 'text/plain' ELSE 'application/octet-stream' END AS mime FROM ({_GATE})", "catalog", "users"
    ),
)


TABLE_HEADER = "l_linenumber,l_partkey,l_quantity,l_returnflag,l_shipdate"


def _upload_lines(spark, d):
    """Each delimited upload of the projection holds the line items of its order."""
    def at(block, row):
        return F.struct(block.cast("bigint").alias("block"), row.cast("bigint").alias("row"))

    heads = project(spark, d, "catalog").filter("file_type = 'csv'").select(F.col("file_hash").alias("file"), at(F.lit(0), F.lit(0)).alias("at"), F.lit(TABLE_HEADER).alias("line"))
    cells = [F.col(c).cast("string") for c in ("l_linenumber", "l_partkey")] + [F.col("l_quantity").cast("bigint").cast("string"), F.col("l_returnflag"), F.date_format("l_shipdate", "yyyy-MM-dd")]
    body = load(spark, d, "lineitem").select(
        F.concat(F.lit("ds-"), F.col("l_orderkey").cast("string")).alias("file"), at(F.lit(1), F.col("l_linenumber") * 10000000 + F.col("l_partkey")).alias("at"), F.concat_ws(",", *cells).alias("line")
    )
    return heads.unionByName(body)


def _ingested(spark, d):
    return intake.ingest(_uploads(spark, d), _upload_lines(spark, d), users(spark, d), catalog(spark, d).limit(0), moment(AS_OF_CATALOG))


_HEAD = TABLE_HEADER.replace(",", " ")
_FILES = (
    "SELECT 'ds-' || l_orderkey AS file_hash, count(*) AS row_count, count(*) - count(DISTINCT (l_linenumber, l_partkey, l_quantity, l_returnflag, l_shipdate)) AS duplicate_rows, "
    "string_agg(concat_ws(' ', l_linenumber, l_partkey, CAST(l_quantity AS BIGINT), l_returnflag, '[DATE_REDACTED]'), ' ' ORDER BY l_linenumber, l_partkey) AS head FROM lineitem GROUP BY l_orderkey"
)
_READ = (
    "SELECT a.file_hash, a.category AS bin, a.filename, a.extra_owner, coalesce(row_count, 0) AS row_count, CAST(5 AS BIGINT) AS column_count, CAST(0 AS DOUBLE) AS missing_pct_exact, coalesce(duplicate_rows, 0) AS duplicate_rows, "
    f"a.filename || ' {_HEAD} ' || coalesce(head, '') AS t FROM (SELECT * FROM ({_GATE}) WHERE reason IS NULL AND file_type = 'csv') a LEFT JOIN ({_FILES}) f ON f.file_hash = a.file_hash"
)
_READ_SCORED = q.fast_score(q.categorised(_READ, "t", "* EXCLUDE (lt)").replace("* EXCLUDE (lt), CASE", "file_hash, bin, extra_owner, row_count, column_count, missing_pct_exact, duplicate_rows, CASE", 1))
_INGESTED = (
    "SELECT file_hash, quality_score, CASE WHEN quality_score >= 80 THEN 'passed' ELSE 'needs_review' END AS status, category AS predicted, "
    "CASE WHEN bin = 'medical' THEN 'special_category' WHEN row_count > 0 THEN 'sensitive' WHEN bin IN ('finance', 'geospatial') THEN 'confidential' ELSE 'internal' END AS sensitivity, extra_owner AS owner "
    f"FROM ({_READ_SCORED}) UNION ALL SELECT file_hash, CAST(75.0 AS DOUBLE), 'needs_review', 'General/Other', CASE category WHEN 'medical' THEN 'special_category' WHEN 'finance' THEN 'confidential' "
    f"WHEN 'geospatial' THEN 'confidential' ELSE 'internal' END, extra_owner FROM ({_GATE}) WHERE reason IS NULL AND coalesce(file_type, '') <> 'csv'"
)
QUERIES.add(
    "ingest_catalog",
    lambda spark, d: _ingested(spark, d)[0].select(
        "file_hash", "quality_score", "status", F.col("category_verification.auto_detected").alias("predicted"), F.col("access_policy.sensitivity").alias("sensitivity"), "owner"
    ),
    with_sql(_INGESTED, "catalog", "users"),
)
QUERIES.add(
    "ingest_audit",
    lambda spark, d: _ingested(spark, d)[1].groupBy("result", F.col("metadata")["reason"].alias("reason"), F.col("metadata")["predicted_category"].alias("predicted")).agg(F.count("*").alias("n")),
    with_sql(
        f"SELECT CASE WHEN reason IS NULL THEN 'SUCCESS' ELSE 'DENIED' END AS result, reason, predicted, count(*) AS n FROM ({_GATE}) g LEFT JOIN ({_INGESTED}) i ON i.file_hash = g.file_hash GROUP BY 1, 2, 3", "catalog", "users"
    ),
)

# --------------------------------------------------------------------- access

ADMIN_IDS, ADMIN_NAMES = ("user-7", "user-8"), ("Customer#000000012", "customer#000000013")
_DECIDED = (
    f"SELECT r.*, CASE WHEN c.file_hash IS NULL THEN 'not_found' WHEN c.restriction_status <> 'active' THEN 'dataset_restricted' WHEN u.id IS NULL THEN 'not_authorized' "
    "WHEN r.requester_id = coalesce(c.owner, c.extra_owner) THEN NULL WHEN u.restricted THEN 'account_restricted' WHEN u.id IN ('user-7', 'user-8') OR u.username IN ('customer#000000012', 'customer#000000013') THEN NULL "
    "WHEN CASE u.plan WHEN 'free' THEN 0 WHEN 'basic' THEN 1 WHEN 'business' THEN 2 ELSE 3 END < CASE c.least WHEN 'basic' THEN 1 WHEN 'business' THEN 2 WHEN 'enterprise' THEN 3 ELSE 0 END THEN 'plan_too_low' "
    "WHEN c.kyb AND u.kyb_status <> 'verified' THEN 'kyb_required' WHEN c.ruled AND purpose = 'resale' THEN 'purpose_not_permitted' END AS reason FROM requests_fx r LEFT JOIN "
    f"(SELECT *, CASE WHEN ruled THEN {PLAN_OF.format(s='s')} ELSE 'basic' END AS least, (ruled AND {KYB_OF.format(s='s')}) AS kyb FROM (SELECT *, {SENSITIVITY} AS s, ({NUMBER} % 17 <> 0) AS ruled FROM catalog_fx)) c "
    "ON c.file_hash = r.file_hash LEFT JOIN users_fx u ON u.id = r.requester_id"
)


def _decisions(spark, d):
    return access.decide_access(project(spark, d, "requests"), catalog(spark, d), users(spark, d), ADMIN_IDS, ADMIN_NAMES)


QUERIES.add(
    "access_decision",
    lambda spark, d: _decisions(spark, d).withColumn("code", F.col("code").cast("bigint")),
    with_sql(
        "SELECT requester_id, file_hash, purpose, reason IS NULL AS allowed, CAST(CASE WHEN reason IS NULL THEN 200 WHEN reason = 'not_found' THEN 404 WHEN reason IN ('dataset_restricted', 'account_restricted') THEN 423 ELSE 403 END AS BIGINT) AS code, "
        f"reason FROM ({_DECIDED})", "requests", "catalog", "users",
    ),
)
QUERIES.add(
    "access_log",
    lambda spark, d: access.access_log(_decisions(spark, d), moment(AS_OF_REVIEWS)).groupBy("result", F.col("metadata")["reason"].alias("message")).agg(F.count("*").alias("n"), F.count("actor_id").alias("actors")),
    with_sql(
        "SELECT CASE WHEN reason IS NULL THEN 'SUCCESS' WHEN reason = 'not_found' THEN 'NOT_FOUND' ELSE 'DENIED' END AS result, CASE reason WHEN 'not_found' THEN NULL "
        + " ".join(f"WHEN '{k}' THEN {q.quote(v)}" for k, v in access.ACCESS_MESSAGES.items() if k != "not_found")
        + f" END AS message, count(*) AS n, count(*) FILTER (reason IS NULL OR reason <> 'not_found') AS actors FROM ({_DECIDED}) GROUP BY 1, 2", "requests", "catalog", "users",
    ),
)

# ------------------------------------------------------------------ retention

QUERIES.add(
    "retention_stamp",
    lambda spark, d: project(spark, d, "catalog").select(
        "file_hash", iso_utc(retention.stamp(30, F.col("timestamp"))[1]).alias("expires"), retention.stamp(30, F.col("timestamp"))[0]["issued_at"].alias("issued_at"),
        retention.stamp(30, F.col("timestamp"))[0]["retention_days"].alias("days"),
    ),
    with_sql("SELECT file_hash, strftime(\"timestamp\" + INTERVAL 30 DAY, '%Y-%m-%dT%H:%M:%SZ') AS expires, strftime(\"timestamp\", '%Y-%m-%dT%H:%M:%SZ') AS issued_at, '30' AS days FROM catalog_fx", "catalog"),
)
_DUE = f"FROM catalog_fx WHERE retention_expires_at <= TIMESTAMP '{AS_OF_CATALOG}' AND restriction_status = 'active'"
QUERIES.add(
    "retention_due", lambda spark, d: retention.due_records(catalog(spark, d), moment(AS_OF_CATALOG)).select("file_hash", stamp("retention_expires_at")),
    with_sql(f"SELECT file_hash, {stamp_sql('retention_expires_at')} {_DUE}", "catalog"),
)
QUERIES.add(
    "retention_due_first", lambda spark, d: retention.due_records(catalog(spark, d), moment(AS_OF_CATALOG), 40).select("file_hash", stamp("retention_expires_at")),
    with_sql(f"SELECT file_hash, strftime(x, '%Y-%m-%d %H:%M:%S') AS retention_expires_at FROM (SELECT file_hash, retention_expires_at AS x {_DUE} ORDER BY retention_expires_at, file_hash LIMIT 40)", "catalog"),
)
QUERIES.add(
    "retention_sweep_items", lambda spark, d: retention.sweep_items(catalog(spark, d), moment(AS_OF_CATALOG), dry_run=False, delete_objects=True),
    with_sql(
        "SELECT file_hash, filename, strftime(retention_expires_at, '%Y-%m-%dT%H:%M:%SZ') AS retention_expires_at, false AS dry_run, 'restricted' AS action, true AS object_deleted, "
        f"'datasets/' || file_hash || '/' || filename AS object_key {_DUE}", "catalog",
    ),
)


QUERIES.add(
    "retention_summary", lambda spark, d: retention.sweep_summary(catalog(spark, d), moment(AS_OF_CATALOG), dry_run=False),
    with_sql(f"SELECT true AS ok, false AS dry_run, strftime(TIMESTAMP '{AS_OF_CATALOG}', '%Y-%m-%dT%H:%M:%SZ') AS processed_at, count(*) AS due_count FROM (SELECT 1 {_DUE})", "catalog"),
)


def _swept(limit):
    def build(spark, d):
        return retention.apply_sweep(catalog(spark, d), moment(AS_OF_CATALOG), limit).select(
            "file_hash", "restriction_status", F.get_json_object(F.col("compliance_evidence")["retention"], "$.action").alias("action"),
            F.col("extra")["retention_last_action_at"].alias("acted_at"), F.col("extra")["owner_user_id"].alias("extra_owner"),
        )

    return build


def _swept_sql(limit: str) -> str:
    chosen = f"SELECT file_hash {_DUE} ORDER BY retention_expires_at, file_hash {limit}"
    return with_sql(
        "SELECT c.file_hash, CASE WHEN due THEN 'retention_expired' ELSE restriction_status END AS restriction_status, CASE WHEN due THEN 'retention_expired' END AS action, "
        f"CASE WHEN due THEN '2001-01-01T00:00:00Z' END AS acted_at, extra_owner FROM (SELECT *, file_hash IN ({chosen}) AS due FROM catalog_fx) c", "catalog",
    )


QUERIES.add("retention_sweep", _swept(None), _swept_sql(""))
QUERIES.add("retention_sweep_limited", _swept(25), _swept_sql("LIMIT 25"))


def _restriction(spark, d):
    """Customers in debt ask for a restriction, all others have it lifted."""
    asked = load(spark, d, "customer").select(
        F.concat(F.lit("user-"), F.col("c_custkey").cast("string")).alias("user_id"), (F.col("c_acctbal") < 0).alias("restricted"), F.lit("asked").alias("reason")
    )
    return retention.restrict_users(users(spark, d), catalog(spark, d), asked)


QUERIES.add(
    "restrict_users", lambda spark, d: _restriction(spark, d)[0].select("id", "restricted"),
    "SELECT concat('user-', c_custkey) AS id, c_acctbal < 0 AS restricted FROM customer",
)
QUERIES.add(
    "restrict_datasets",
    lambda spark, d: _restriction(spark, d)[1].select("file_hash", "restriction_status", F.get_json_object(F.col("compliance_evidence")["restriction_request"], "$.reason").alias("why")),
    with_sql(
        "SELECT file_hash, CASE WHEN c_acctbal < 0 THEN 'restricted' WHEN c_acctbal >= 0 THEN 'active' ELSE restriction_status END AS restriction_status, CASE WHEN c_custkey IS NOT NULL THEN 'asked' END AS why "
        "FROM catalog_fx LEFT JOIN customer ON concat('user-', c_custkey) = coalesce(owner, extra_owner)", "catalog",
    ),
)



def _restriction_requests(spark, d):
    """Customers ask for themselves, for a neighbour, without a name, or are unknown."""
    key = F.col("c_custkey")
    name = lambda k: F.concat(F.lit("user-"), k.cast("string"))
    return load(spark, d, "customer").select(
        F.when(key % 7 == 0, F.concat(F.lit("gone-"), key.cast("string"))).otherwise(name(key)).alias("user_id"),
        F.when(key % 5 == 0, name(key + 1)).when(key % 11 == 0, F.lit(None).cast("string")).when(key % 7 == 0, F.concat(F.lit("gone-"), key.cast("string"))).otherwise(name(key)).alias("requester_id"),
        (F.col("c_acctbal") < 0).alias("restricted"), F.lit("asked").alias("reason"),
    )


def _restriction_decisions(spark, d):
    return retention.restriction_decisions(users(spark, d), catalog(spark, d), _restriction_requests(spark, d))


_REQUESTED = (
    "SELECT CASE WHEN c_custkey % 7 = 0 THEN 'gone-' ELSE 'user-' END || c_custkey AS user_id, CASE WHEN c_custkey % 5 = 0 THEN 'user-' || (c_custkey + 1) WHEN c_custkey % 11 = 0 THEN NULL "
    "WHEN c_custkey % 7 = 0 THEN 'gone-' || c_custkey ELSE 'user-' || c_custkey END AS requester_id, c_acctbal < 0 AS restricted, 'asked' AS reason FROM customer"
)
_RESTRICTED = (
    f"SELECT r.*, CASE WHEN requester_id IS NULL OR requester_id <> user_id THEN 'DENIED' WHEN u.id IS NULL THEN 'NOT_FOUND' ELSE 'SUCCESS' END AS result, coalesce(n, 0) AS n FROM ({_REQUESTED}) r "
    "LEFT JOIN users_fx u ON u.id = user_id LEFT JOIN (SELECT coalesce(owner, extra_owner) AS o, count(*) AS n FROM catalog_fx GROUP BY 1) c ON c.o = user_id"
)
QUERIES.add(
    "restriction_decisions", lambda spark, d: _restriction_decisions(spark, d).select("user_id", "requester_id", "restricted", "reason", "result", F.col("code").cast("bigint").alias("code"), "dataset_count", "restriction_status"),
    with_sql(
        "SELECT user_id, requester_id, restricted, reason, result, CAST(CASE result WHEN 'SUCCESS' THEN 200 WHEN 'DENIED' THEN 403 ELSE 404 END AS BIGINT) AS code, CASE WHEN result = 'SUCCESS' THEN n END AS dataset_count, "
        f"CASE WHEN result = 'SUCCESS' THEN CASE WHEN restricted THEN 'restricted' ELSE 'active' END END AS restriction_status FROM ({_RESTRICTED})", "users", "catalog",
    ),
)
QUERIES.add(
    "restriction_log", lambda spark, d: retention.restriction_log(_restriction_decisions(spark, d), moment(AS_OF_CATALOG)).select("action", "actor_id", "resource", "purpose", "result", F.col("metadata")["dataset_count"].alias("dataset_count"), F.col("metadata")["reason"].alias("why")),
    with_sql(
        "SELECT 'RESTRICT_USER_PROCESSING' AS action, CASE WHEN result = 'DENIED' THEN requester_id ELSE user_id END AS actor_id, user_id AS resource, 'data_subject_restriction_request' AS purpose, result, "
        f"CASE WHEN result = 'SUCCESS' THEN CAST(n AS VARCHAR) END AS dataset_count, CASE result WHEN 'SUCCESS' THEN 'asked' WHEN 'DENIED' THEN 'not_owner' ELSE 'User not found' END AS why FROM ({_RESTRICTED})", "users", "catalog",
    ),
)

# --------------------------------------------------------------------- rights


def _subjects(spark, d):
    """Customers of one market segment exercise their rights."""
    return load(spark, d, "customer").filter("c_mktsegment = 'MACHINERY'").select(F.concat(F.lit("user-"), F.col("c_custkey").cast("string")).alias("user_id"))


_SUBJECT = "{c} IN (SELECT concat('user-', c_custkey) FROM customer WHERE c_mktsegment = 'MACHINERY')"
QUERIES.add(
    "export_sections", lambda spark, d: rights.export_sections(_subjects(spark, d), users(spark, d), catalog(spark, d), reviews(spark, d)),
    with_sql(
        "SELECT id AS user_id, 'user' AS section, id, NULL AS filename, NULL AS category, NULL AS status, CASE WHEN restricted THEN 'restricted' ELSE 'active' END AS restriction_status, plan, kyb_status FROM users_fx WHERE "
        + _SUBJECT.format(c="id") + " UNION ALL SELECT o, 'dataset', file_hash, filename, category, NULL, restriction_status, NULL, NULL FROM (SELECT *, coalesce(owner, extra_owner) AS o FROM catalog_fx) WHERE "
        + _SUBJECT.format(c="o") + " UNION ALL SELECT user_id, 'review', id, NULL, NULL, status, NULL, NULL, NULL FROM reviews_fx WHERE " + _SUBJECT.format(c="user_id"), "users", "catalog", "reviews",
    ),
)


def _export_documents(spark, d):
    """The documents, read back field by field."""
    found = rights.export_documents(_subjects(spark, d), users(spark, d), catalog(spark, d), reviews(spark, d))
    path = lambda p: F.get_json_object("document", p)
    hashes = F.from_json(path("$.datasets"), "array<struct<file_hash: string, filename: string, bytes: bigint, restriction_status: string>>")
    return found.select(
        "user_id", "n_datasets", path("$.user.id").alias("id"), path("$.user.plan").alias("plan"), path("$.user.email").alias("email"),
        F.array_join(F.transform(hashes, lambda r: F.concat_ws(":", r["file_hash"], r["filename"], r["bytes"], r["restriction_status"])), ",").alias("datasets"),
        path("$.review.id").alias("review_id"), F.sha2(path("$.review.review_text"), 256).alias("review_sha256"), path("$.review.status").alias("review_status"), path("$.review.rating").cast("int").alias("rating"),
    )


QUERIES.add(
    "export_documents", _export_documents,
    with_sql(
        "SELECT u.id AS user_id, coalesce(n, 0) AS n_datasets, u.id AS id, u.plan, u.email, coalesce(ds, '') AS datasets, r.id AS review_id, sha256(r.review_text) AS review_sha256, r.status AS review_status, r.rating FROM users_fx u LEFT JOIN ("
        "SELECT o, count(*) AS n, string_agg(concat_ws(':', file_hash, filename, bytes, restriction_status), ',' ORDER BY \"timestamp\" DESC, file_hash) AS ds FROM (SELECT *, coalesce(owner, extra_owner) AS o FROM catalog_fx) GROUP BY o) c ON c.o = u.id "
        "LEFT JOIN reviews_fx r ON r.user_id = u.id WHERE " + _SUBJECT.format(c="u.id"), "users", "catalog", "reviews",
    ),
)


def _erased(spark, d):
    return rights.erase(_subjects(spark, d), users(spark, d), catalog(spark, d), reviews(spark, d))


QUERIES.add("erase_users", lambda spark, d: _erased(spark, d).users.select("id", "plan"), with_sql("SELECT id, plan FROM users_fx WHERE NOT (" + _SUBJECT.format(c="id") + ")", "users"))
QUERIES.add(
    "erase_datasets", lambda spark, d: _erased(spark, d).catalog.select("file_hash"),
    with_sql("SELECT file_hash FROM catalog_fx WHERE NOT coalesce(" + _SUBJECT.format(c="extra_owner") + ", false)", "catalog", "users"),
)
QUERIES.add(
    "erase_reviews", lambda spark, d: _erased(spark, d).reviews.select("id"), with_sql("SELECT id FROM reviews_fx WHERE NOT (" + _SUBJECT.format(c="user_id") + ")", "reviews", "users")
)
QUERIES.add(
    "erase_objects", lambda spark, d: _erased(spark, d).object_keys,
    with_sql("SELECT extra_owner AS user_id, file_hash, 'datasets/' || file_hash || '/' || filename AS object_key FROM catalog_fx WHERE " + _SUBJECT.format(c="extra_owner"), "catalog", "users"),
)
QUERIES.add(
    "erase_counts", lambda spark, d: _erased(spark, d).counts,
    with_sql("SELECT extra_owner AS user_id, count(*) AS datasets FROM catalog_fx WHERE " + _SUBJECT.format(c="extra_owner") + " GROUP BY 1", "catalog", "users"),
)

# -------------------------------------------------------------------- reviews



def clean_sql(text: str) -> str:
    bare = q.strip(f"replace(coalesce({text}, ''), chr(0), '')")
    return q.strip(f"regexp_replace(regexp_replace({bare}, '<[^>]*>', '', 'g'), '{q.SPACE}+', ' ', 'g')")


QUERIES.add(
    "review_sanitise", lambda spark, d: load(spark, d, "pages").select("page_id", rv.sanitise(F.col("html")).alias("text")), f"SELECT page_id, {clean_sql('html')} AS text FROM pages"
)


def _submitted(spark, d):
    """Conversation turns as review texts; ratings run from 0 to 6."""
    return load(spark, d, "conversations").select(
        "conv_id", "turn", F.when(F.col("conv_id") % 5 == 0, " ").otherwise(F.concat(F.lit(" <b>"), F.col("text"), F.lit("</b> "))).alias("review_text"), ((F.col("conv_id") + F.col("turn")) % 7).alias("rating")
    )


_SUBMITTED = "SELECT conv_id, turn, CASE WHEN conv_id % 5 = 0 THEN ' ' ELSE concat(' <b>', text, '</b> ') END AS review_text, (conv_id + turn) % 7 AS rating FROM conversations"
_REFUSED = "CASE WHEN c = '' THEN 'empty' WHEN length(c) < 30 THEN 'too_short' WHEN length(c) > 1000 THEN 'too_long' WHEN rating < 1 OR rating > 5 THEN 'rating_out_of_range' END"
QUERIES.add(
    "review_validate", lambda spark, d: rv.validate(_submitted(spark, d)).select("conv_id", "turn", "cleaned_text", "reason"),
    f"SELECT conv_id, turn, c AS cleaned_text, {_REFUSED} AS reason FROM (SELECT *, {clean_sql('review_text')} AS c FROM ({_SUBMITTED}))",
)
QUERIES.add(
    "review_validate_documents", lambda spark, d: rv.validate(reviews(spark, d)).groupBy("reason").agg(F.count("*").alias("n")),
    with_sql(f"SELECT {_REFUSED} AS reason, count(*) AS n FROM (SELECT *, {clean_sql('review_text')} AS c FROM reviews_fx) GROUP BY 1", "reviews"),
)
EDGE = f"(TIMESTAMP '{AS_OF_REVIEWS}' - INTERVAL {fv.REVIEW_MONTHS} MONTH)"
VISIBLE = f"(status = 'approved' AND created_at >= {EDGE})"
ARCHIVED = f"(status = 'approved' AND created_at < {EDGE})"
QUERIES.add(
    "reviews_public", lambda spark, d: rv.public_list(reviews(spark, d), users(spark, d), moment(AS_OF_REVIEWS), 500).select("id", "rating", stamp("created_at"), "reviewer_name"),
    with_sql(
        f"SELECT r.id, rating, strftime(r.created_at, '%Y-%m-%d %H:%M:%S') AS created_at, coalesce(username, 'Anonymous') AS reviewer_name FROM (SELECT * FROM reviews_fx WHERE {VISIBLE} ORDER BY created_at DESC, id LIMIT 200) r LEFT JOIN users_fx u ON u.id = r.user_id",
        "reviews", "users",
    ),
)
QUERIES.add(
    "reviews_archived", lambda spark, d: rv.archived_list(reviews(spark, d), moment(AS_OF_REVIEWS)).select("id", "status"),
    with_sql(f"SELECT id, status FROM reviews_fx WHERE {ARCHIVED} ORDER BY created_at DESC, id LIMIT 200", "reviews"),
)
QUERIES.add("reviews_by_status", lambda spark, d: rv.by_status(reviews(spark, d), "pending").select("id", "status"), with_sql("SELECT id, status FROM reviews_fx WHERE status = 'pending'", "reviews"))
_FILTERS = {"all": "true", "pending": "status = 'pending'", "rejected": "status = 'rejected'", "approved": "status = 'approved'", "visible": VISIBLE, "archived": ARCHIVED}
for _key, _cond in _FILTERS.items():
    QUERIES.add(
        f"reviews_moderation_{_key}", lambda spark, d, k=_key: rv.moderation_list(reviews(spark, d), users(spark, d), k, moment(AS_OF_REVIEWS)).select("id", "status", "view_status", "reviewer_name"),
        with_sql(
            f"SELECT r.id, r.status, CASE WHEN {ARCHIVED} THEN 'archived' WHEN status = 'approved' THEN 'visible' ELSE status END AS view_status, coalesce(username, 'Unknown') AS reviewer_name FROM "
            f"(SELECT * FROM reviews_fx WHERE {_cond} ORDER BY created_at DESC, id LIMIT 200) r LEFT JOIN users_fx u ON u.id = r.user_id", "reviews", "users",
        ),
    )
QUERIES.add(
    "review_stats",
    lambda spark, d: (lambda s: s.withColumns({c: F.round(c, 6) for c in s.columns if c.endswith("avg")}))(rv.rating_stats(reviews(spark, d), moment(AS_OF_REVIEWS))),
    with_sql(
        "SELECT " + ", ".join(f"round(coalesce(avg(rating) FILTER ({c}), 0.0), 6) AS {n}_avg, count(*) FILTER ({c}) AS {n}_count" for n, c in (("visible", VISIBLE), ("lifetime", "true"), ("approved", "status = 'approved'"))) + " FROM reviews_fx",
        "reviews",
    ),
)
QUERIES.add(
    "review_visibility", lambda spark, d: reviews(spark, d).select("id", rv.is_visible(rv.cutoff(moment(AS_OF_REVIEWS))).alias("visible"), rv.is_archived(rv.cutoff(moment(AS_OF_REVIEWS))).alias("archived")),
    with_sql(f"SELECT id, {VISIBLE} AS visible, {ARCHIVED} AS archived FROM reviews_fx", "reviews"),
)
QUERIES.add(
    "month_cutoffs", lambda spark, d: load(spark, d, "orders").select("o_orderkey", F.date_format(rv.cutoff(F.col("o_orderdate"), 7), "yyyy-MM-dd HH:mm:ss").alias("cutoff")),
    "SELECT o_orderkey, strftime(o_orderdate - INTERVAL 7 MONTH, '%Y-%m-%d %H:%M:%S') AS cutoff FROM orders",
)
_CHAIN = (
    "WITH RECURSIVE ev AS (SELECT {k} AS k, epoch_us(ts) AS t, min(event_id) AS e FROM events GROUP BY ALL), acc AS (SELECT k, min(t) AS t FROM ev GROUP BY k "
    "UNION ALL SELECT acc.k, (SELECT min(ev.t) FROM ev WHERE ev.k = acc.k AND ev.t > acc.t + {w}) FROM acc WHERE acc.t IS NOT NULL) "
)
QUERIES.add(
    "review_own", lambda spark, d: rv.own_reviews(reviews(spark, d), load(spark, d, "customer").select(F.concat(F.lit("user-"), F.col("c_custkey").cast("string")).alias("user_id"))).select("id", "user_id", "rating", "status"),
    with_sql("SELECT id, user_id, rating, status FROM reviews_fx WHERE user_id IN (SELECT concat('user-', c_custkey) FROM customer)", "reviews"),
)
QUERIES.add(
    "review_rate_limit", lambda spark, d: rv.rate_limit(load(spark, d, "events").select("event_id", "user_id", "ts"), "user_id", "ts", "event_id", 43200).select("event_id", "user_id", "accepted"),
    _CHAIN.format(k="user_id", w=43200 * 1_000_000)
    + "SELECT event_id, user_id, EXISTS (SELECT 1 FROM acc JOIN ev ON ev.k = acc.k AND ev.t = acc.t WHERE acc.k = user_id AND ev.e = event_id) AS accepted FROM events",
)


def _review_events(spark, d):
    """Events as submitted reviews."""
    return load(spark, d, "events").select(
        F.concat(F.lit("s-"), F.col("event_id").cast("string")).alias("id"), F.concat(F.lit("user-"), (F.col("user_id") * 2).cast("string")).alias("user_id"), F.col("event_type").alias("review_text"),
        (F.col("event_id") % 5 + 1).cast("int").alias("rating"), F.col("ts").alias("submitted_at"),
    )


QUERIES.add(
    "review_upsert", lambda spark, d: rv.upsert_reviews(reviews(spark, d).withColumn("updated_at", F.lit("2020-01-01").cast("timestamp_ntz")), _review_events(spark, d), 43200)[0].select("id", "user_id", "review_text", "rating", "status"),
    with_sql(
        "SELECT coalesce(r.id, 's-' || f.e) AS id, coalesce(r.user_id, x.u) AS user_id, coalesce(x.review_text, r.review_text) AS review_text, coalesce(x.rating, r.rating) AS rating, CASE WHEN x.u IS NULL THEN r.status ELSE 'pending' END AS status FROM reviews_fx r "
        "FULL JOIN (SELECT 'user-' || k * 2 AS u, event_type AS review_text, CAST(event_id % 5 + 1 AS INT) AS rating FROM (SELECT acc.k, ev.e, row_number() OVER (PARTITION BY acc.k ORDER BY acc.t DESC) AS rn FROM acc JOIN ev ON ev.k = acc.k AND ev.t = acc.t) JOIN events ON event_id = e WHERE rn = 1) x ON x.u = r.user_id "
        "LEFT JOIN (SELECT 'user-' || acc.k * 2 AS u, arg_min(ev.e, ev.t) AS e FROM acc JOIN ev ON ev.k = acc.k AND ev.t = acc.t GROUP BY acc.k) f ON f.u = coalesce(r.user_id, x.u)", "reviews",
    ).replace("WITH ", _CHAIN.format(k="user_id", w=43200 * 1_000_000).rstrip() + ", ", 1),
)


def _verdicts(spark, d):
    return load(spark, d, "labels").select(F.concat(F.lit("review-"), F.col("doc_id").cast("string")).alias("id"), F.when(F.col("toxic") == 1, "rejected").when(F.col("quality") == 1, "approved").otherwise("unsure").alias("status"))


_VERDICT = "SELECT 'review-' || doc_id AS id, CASE WHEN toxic = 1 THEN 'rejected' WHEN quality = 1 THEN 'approved' END AS s FROM labels"
QUERIES.add(
    "review_moderate", lambda spark, d: rv.moderate(reviews(spark, d), _verdicts(spark, d), moment(AS_OF_REVIEWS)).select("id", "status", stamp("updated_at")),
    with_sql(
        f"SELECT r.id, coalesce(s, status) AS status, strftime(CASE WHEN s IS NULL THEN updated_at ELSE TIMESTAMP '{AS_OF_REVIEWS}' END, '%Y-%m-%d %H:%M:%S') AS updated_at FROM reviews_fx r LEFT JOIN ({_VERDICT}) v ON v.id = r.id", "reviews"
    ),
)
QUERIES.add(
    "review_delete", lambda spark, d: rv.delete_reviews(reviews(spark, d), _verdicts(spark, d).filter("status = 'rejected'")).select("id"),
    with_sql(f"SELECT id FROM reviews_fx WHERE id NOT IN (SELECT id FROM ({_VERDICT}) WHERE s = 'rejected')", "reviews"),
)

# ---------------------------------------------------------------------- users

QUERIES.add(
    "users_public", lambda spark, d: us.public_view(users(spark, d).withColumn("plan", F.when(F.col("plan") != "free", F.col("plan"))).withColumn("secret", F.lit("x"))),
    with_sql("SELECT id, username, email, plan, kyb_status, restricted FROM users_fx", "users"),
)


def _signups(spark, d):
    """Every customer signs up; names repeat by segment, mails by nation and key."""
    key = F.col("c_custkey")
    return load(spark, d, "customer").select(
        F.concat(F.lit("new-"), key.cast("string")).alias("id"), F.when(key % 50 == 0, " ").otherwise(F.concat(F.lit(" n"), (key % 400).cast("string"), F.lit(" "))).alias("username"),
        F.concat(F.lit("M"), (key % 600).cast("string"), F.lit("@Example.com")).alias("email"), F.when(key % 2 == 0, "Business").otherwise("gold").alias("plan"), key.alias("seq"),
    )


QUERIES.add("user_register", lambda spark, d: us.register(_signups(spark, d), users(spark, d), ["seq"]).select("id", "username", "email", "plan", "reason"),
    with_sql(
        "SELECT * FROM (WITH RECURSIVE asked AS (SELECT 'new-' || c_custkey AS id, CASE WHEN c_custkey % 50 = 0 THEN '' ELSE 'n' || c_custkey % 400 END AS username, 'm' || c_custkey % 600 || '@example.com' AS email, "
        "CASE WHEN c_custkey % 2 = 0 THEN 'business' ELSE 'free' END AS plan, row_number() OVER (ORDER BY c_custkey) AS seq FROM customer), "
        "base AS (SELECT a.*, CASE WHEN username = '' THEN 'username_required' WHEN username IN (SELECT username FROM users_fx) THEN 'username_exists' WHEN email IN (SELECT email FROM users_fx) THEN 'email_exists' END AS refused FROM asked a), "
        "step AS (SELECT CAST(0 AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS id, CAST(NULL AS VARCHAR) AS reason, CAST([] AS VARCHAR[]) AS names, CAST([] AS VARCHAR[]) AS mails UNION ALL "
        "SELECT seq, id, reason, CASE WHEN reason IS NULL THEN list_append(names, username) ELSE names END, CASE WHEN reason IS NULL THEN list_append(mails, email) ELSE mails END FROM ("
        "SELECT b.seq, b.id, b.username, b.email, names, mails, CASE WHEN refused IS NOT NULL AND refused <> 'email_exists' THEN refused WHEN list_contains(names, b.username) THEN 'username_exists' "
        "WHEN refused IS NOT NULL OR list_contains(mails, b.email) THEN 'email_exists' END AS reason FROM step s JOIN base b ON b.seq = s.seq + 1)) "
        "SELECT a.id, username, email, plan, reason FROM asked a JOIN step s ON s.id = a.id)", "users",
    ),
)


def _plain_signups(spark, d):
    """Customers and suppliers sign up; a supplier's mail may belong to a customer."""
    people = load(spark, d, "customer").select(
        F.concat(F.lit("c-"), F.col("c_custkey").cast("string")).alias("id"), F.concat(F.lit("c"), (F.col("c_custkey") % 1000).cast("string")).alias("username"),
        F.concat(F.lit("c"), F.col("c_custkey").cast("string"), F.lit("@x.org")).alias("email"), F.lit("basic").alias("plan"), F.col("c_custkey").alias("seq"),
    )
    return people


QUERIES.add(
    "user_register_names", lambda spark, d: us.register(_plain_signups(spark, d), users(spark, d), ["seq"]).select("id", "username", "reason"),
    "SELECT 'c-' || c_custkey AS id, 'c' || c_custkey % 1000 AS username, CASE WHEN c_custkey >= 1000 AND min(c_custkey) OVER (PARTITION BY c_custkey % 1000) < c_custkey THEN 'username_exists' END AS reason FROM customer",
)


def _plan_requests(spark, d):
    return load(spark, d, "orders").select(
        F.concat(F.lit("user-"), F.col("o_custkey").cast("string")).alias("user_id"), F.element_at(F.array(F.lit(" Enterprise"), F.lit("basic"), F.lit("gold"), F.lit("FREE")), (F.col("o_orderkey") % 4 + 1).cast("int")).alias("value"), F.col("o_orderkey").alias("seq")
    )


_ASKED = "SELECT 'user-' || o_custkey AS user_id, CASE o_orderkey % 4 WHEN 0 THEN 'enterprise' WHEN 1 THEN 'basic' WHEN 2 THEN 'gold' ELSE 'free' END AS value, o_orderkey AS seq FROM orders"
QUERIES.add(
    "user_plan_decisions", lambda spark, d: us.decide_field(users(spark, d), _plan_requests(spark, d), "plan", tuple(fv.PLAN_RANK)).groupBy("value", "reason").agg(F.count("*").alias("n")),
    with_sql(f"SELECT value, CASE WHEN value = 'gold' THEN 'invalid_plan' WHEN id IS NULL THEN 'user_not_found' END AS reason, count(*) AS n FROM ({_ASKED}) LEFT JOIN users_fx ON id = user_id GROUP BY ALL", "users"),
)


def _plans(spark, d):
    people = users(spark, d)
    return us.apply_field(people, us.decide_field(people, _plan_requests(spark, d), "plan", tuple(fv.PLAN_RANK)), "plan", ["seq"]).select("id", "plan")


QUERIES.add(
    "user_plan_updates", _plans,
    with_sql(f"SELECT id, coalesce(v, plan) AS plan FROM users_fx LEFT JOIN (SELECT user_id, arg_max(value, seq) AS v FROM ({_ASKED}) WHERE value <> 'gold' GROUP BY user_id) ON user_id = id", "users"),
)

# ---------------------------------------------------------------------- audit


def _metadata(spark, d):
    return project(spark, d, "audit").withColumn("metadata", F.concat(F.lit('{"filename":"a.csv","Object_Key":"q","nested":{"token":"t"},"k":'), F.get_json_object("metadata", "$.k"), F.lit("}")))


QUERIES.add(
    "audit_mask",
    lambda spark, d: audit.audit_rows(_metadata(spark, d)).select(
        "id", F.col("metadata")["filename"].alias("filename"), F.col("metadata")["Object_Key"].alias("object_key"), F.col("metadata")["nested"].alias("nested"), F.col("metadata")["k"].alias("k"), F.col("dt").cast("string").alias("dt")
    ),
    with_sql(
        "SELECT id, 'a.csv' AS filename, '[REDACTED]' AS object_key, '{\"token\":\"t\"}' AS nested, json_extract_string(metadata, '$.k') AS k, strftime(created_at, '%Y-%m-%d') AS dt FROM audit_fx", "audit"
    ),
)
QUERIES.add(
    "client_address",
    lambda spark, d: load(spark, d, "events").select(
        "event_id", audit.client_address(F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(" 10.0.0."), (F.col("user_id") % 256).cast("string"), F.lit(" , 1.1.1.1"))).when(F.col("event_id") % 3 == 1, ""), F.lit("127.0.0.1")).alias("ip")
    ),
    "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '10.0.0.' || (user_id % 256) ELSE '127.0.0.1' END AS ip FROM events",
)
QUERIES.add(
    "audit_by_day",
    lambda spark, d: audit.audit_rows(project(spark, d, "audit")).groupBy(F.col("dt").cast("string").alias("dt"), "action", "result").agg(F.count("*").alias("n")),
    with_sql("SELECT strftime(created_at, '%Y-%m-%d') AS dt, action, result, count(*) AS n FROM audit_fx GROUP BY ALL", "audit"),
)
QUERIES.add(
    "scrub_audit_metadata", lambda spark, d: project(spark, d, "audit").select("id", pii.scrub(F.concat_ws(" ", "actor_id", "metadata", F.date_format("created_at", "yyyy-MM-dd"))).alias("line")),
    with_sql("SELECT id, " + q.scrub("concat_ws(' ', actor_id, metadata, strftime(created_at, '%Y-%m-%d'))") + " AS line FROM audit_fx", "audit"),
)
