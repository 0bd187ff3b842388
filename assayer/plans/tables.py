"""Given tables, and catalogue-shaped projections of them.

The projections are written once as expressions that Spark and ANSI SQL read
alike, so a query and its check start from the same rows.
"""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from assayer.functions import policy
from assayer.operators.catalog import empty_map
from assayer.session import configure

AS_OF_REVIEWS = "2026-06-08 00:00:00"
AS_OF_CATALOG = "2001-01-01 00:00:00"


def moment(text: str) -> Column:
    return F.lit(text).cast("timestamp")


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    configure(spark)
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


CASES = {
    "suffix": "CASE o_orderkey % 4 WHEN 0 THEN '.csv' WHEN 1 THEN '.json' WHEN 2 THEN '.txt' ELSE '' END",
    "bin": (
        "CASE o_orderkey % 7 WHEN 0 THEN 'medical' WHEN 1 THEN 'finance' WHEN 2 THEN 'retail' WHEN 3 THEN 'text' "
        "WHEN 4 THEN 'images' WHEN 5 THEN 'geospatial' ELSE 'general' END"
    ),
}

PROJECTIONS: dict[str, tuple[str, dict[str, str]]] = {
    "users": (
        "customer",
        {
            "id": "concat('user-', CAST(c_custkey AS STRING))",
            "username": "lower(c_name)",
            "email": "concat('u', CAST(c_custkey AS STRING), '@example.com')",
            "plan": "CASE c_custkey % 4 WHEN 0 THEN 'free' WHEN 1 THEN 'basic' WHEN 2 THEN 'business' ELSE 'enterprise' END",
            "kyb_status": "CASE c_custkey % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'verified' ELSE 'rejected' END",
            "restricted": "(c_custkey % 10 = 0)",
        },
    ),
    "catalog": (
        "orders",
        {
            "file_hash": "concat('ds-', CAST(o_orderkey AS STRING))",
            "timestamp": "o_orderdate",
            "filename": f"concat('f', CAST(o_orderkey AS STRING), {CASES['suffix']})",
            "category": CASES["bin"],
            "file_type": "CASE o_orderkey % 4 WHEN 0 THEN 'csv' WHEN 1 THEN 'json' WHEN 2 THEN 'txt' ELSE NULL END",
            "quality_score": "CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(o_orderkey % 1001 AS DOUBLE) / 10 END",
            "confidence": (
                "CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN CAST(0.5 AS DOUBLE) WHEN 2 THEN CAST(0.72 AS DOUBLE) "
                "WHEN 3 THEN CAST(0.84 AS DOUBLE) ELSE CAST(0.93 AS DOUBLE) END"
            ),
            "redacted_cells": "o_orderkey % 3",
            "owner": "CASE WHEN o_orderkey % 2 = 0 THEN concat('user-', CAST(o_custkey AS STRING)) ELSE NULL END",
            "extra_owner": "CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE concat('user-', CAST(o_custkey AS STRING)) END",
            "bytes": "CAST(floor(o_totalprice) AS BIGINT)",
            "ask_price_usd": "CAST(o_totalprice AS DECIMAL(18,2))",
            "restriction_status": "CASE o_orderstatus WHEN 'F' THEN 'restricted' ELSE 'active' END",
            "retention_expires_at": "o_orderdate + INTERVAL '365' DAY",
        },
    ),
    "reviews": (
        "documents",
        {
            "id": "concat('review-', CAST(doc_id AS STRING))",
            "user_id": "concat('user-', CAST(doc_id * 2 AS STRING))",
            "review_text": "text",
            "rating": "CAST(1 + doc_id % 5 AS INT)",
            "status": "CASE doc_id % 3 WHEN 0 THEN 'approved' WHEN 1 THEN 'pending' ELSE 'rejected' END",
            "created_at": "TIMESTAMP '2026-06-08 00:00:00' - doc_id * INTERVAL '1' DAY",
            "updated_at": "TIMESTAMP '2026-06-08 00:00:00' - doc_id * INTERVAL '1' DAY",
        },
    ),
    "audit": (
        "events",
        {
            "id": "CAST(event_id AS STRING)",
            "actor_id": "concat('user-', CAST(user_id AS STRING))",
            "action": "upper(event_type)",
            "result": "CASE event_type WHEN 'error' THEN 'DENIED' ELSE 'SUCCESS' END",
            "metadata": "props",
            "created_at": "ts",
        },
    ),
    "requests": (
        "lineitem",
        {
            "requester_id": "concat('user-', CAST(l_partkey % 2000 AS STRING))",
            "file_hash": "concat('ds-', CAST(l_orderkey AS STRING))",
            "purpose": "CASE l_linenumber % 4 WHEN 0 THEN 'buyer_download' WHEN 1 THEN 'analytics' WHEN 2 THEN 'research' ELSE 'resale' END",
        },
    ),
    "checks": (
        "events",
        {
            "index": "event_id",
            "test": (
                "concat(CASE event_id % 9 WHEN 0 THEN 'Null share' WHEN 1 THEN 'HBOS outlier scan' WHEN 2 THEN 'Composite-key test' "
                "WHEN 3 THEN 'PSI drift' WHEN 4 THEN 'KPSS stationarity' WHEN 5 THEN 'Leakage by target' WHEN 6 THEN 'Regex format' "
                "WHEN 7 THEN 'Class balance' ELSE 'Spectral entropy' END, ' ', CAST(event_id AS STRING))"
            ),
            "category": (
                "CASE event_id % 6 WHEN 0 THEN 'Outlier Detection' WHEN 1 THEN 'Complexity & Causality' WHEN 2 THEN 'Label Quality' "
                "WHEN 3 THEN 'Manifold & Geometry' WHEN 4 THEN 'Metadata & Governance' ELSE 'Unlisted' END"
            ),
            "status": "CASE event_type WHEN 'error' THEN 'FAIL' WHEN 'click' THEN 'WARN' WHEN 'view' THEN 'PASS' ELSE 'SKIP' END",
        },
    ),
}


def project(spark: SparkSession, folder: str, name: str) -> DataFrame:
    source, columns = PROJECTIONS[name]
    return load(spark, folder, source).selectExpr(*[f"{e} AS `{c}`" for c, e in columns.items()])


def projection_sql(name: str) -> str:
    source, columns = PROJECTIONS[name]
    listed = ", ".join(f'{e} AS "{c}"' for c, e in columns.items())
    return f"SELECT {listed} FROM {source}"


def with_sql(query: str, *names: str) -> str:
    """Query text with projections ``<name>_fx`` in front."""
    ctes = ", ".join(f"{n}_fx AS ({projection_sql(n)})" for n in names)
    return f"WITH {ctes} {query}"


def users(spark: SparkSession, folder: str) -> DataFrame:
    return project(spark, folder, "users")


def reviews(spark: SparkSession, folder: str) -> DataFrame:
    return project(spark, folder, "reviews")


def catalog(spark: SparkSession, folder: str) -> DataFrame:
    """The catalogue projection in the catalogue's own nested shape.

    Every seventeenth record has no policy of its own.
    """
    flat = project(spark, folder, "catalog")
    note = F.map_filter(
        F.create_map(F.lit("owner_user_id"), F.col("extra_owner"), F.lit("prediction_confidence"), F.col("confidence").cast("string")),
        lambda k, v: v.isNotNull(),
    )
    rule = policy.access_policy(F.col("category"), F.col("redacted_cells"))
    number = F.substring("file_hash", 4, 20).cast("bigint")
    return flat.select(
        "file_hash", F.lit(1).alias("schema_version"), "timestamp", "filename", "category", "file_type", "quality_score",
        F.create_map(F.lit("overall"), F.col("quality_score")).alias("quality_scores"),
        F.struct(
            F.col("category").alias("user_selected"), F.lit(None).cast("string").alias("auto_detected"),
            F.when(number % 4 != 0, F.col("confidence")).alias("confidence"), F.lit(None).cast("boolean").alias("match"),
        ).alias("category_verification"),
        F.lit(None).cast("string").alias("status"), F.array().cast("array<string>").alias("details"),
        F.lit("").alias("description"), note.alias("extra"), "owner", F.lit("files").alias("storage_provider"),
        F.concat_ws("/", F.lit("datasets"), "file_hash", "filename").alias("object_key"), "bytes",
        F.lit(None).cast("string").alias("mime"), empty_map().alias("provenance"), empty_map().alias("compliance_evidence"),
        F.when(number % 17 != 0, rule).alias("access_policy"), "restriction_status", empty_map().alias("retention_policy"),
        "retention_expires_at", "ask_price_usd",
    )
