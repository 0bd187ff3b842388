"""Queries: type promotion, fingerprints, older stores, and streams run to the end."""

import uuid

from pyspark.sql import functions as F

from assayer.operators import scoring
from assayer.plans.registry import Registry
from assayer.plans.tables import PROJECTIONS, load, project, with_sql
from assayer.session import checkpoint_folder, configure
from assayer.sources import files, legacy
from assayer.streaming.audit import masked_events
from assayer.streaming.ratelimit import limit_stream

QUERIES = Registry()


def _as_text(spark, d):
    """Orders as they come out of a delimited file, with several null spellings."""
    key = F.col("o_orderkey")
    return load(spark, d, "orders").select(
        key.cast("string").alias("id"), F.when(key % 4 == 0, "NA").otherwise(F.col("o_custkey").cast("string")).alias("customer"),
        F.when(key % 5 == 0, "n/a").otherwise(F.col("o_totalprice").cast("string")).alias("price"), F.when(key % 6 == 0, "").otherwise(F.initcap((key % 2 == 0).cast("string"))).alias("even"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.when(key % 2 == 0, "NULL").otherwise("nan").alias("gap"),
    )


QUERIES.add(
    "promoted_types",
    lambda spark, d: (lambda t: t.agg(
        F.lit(",".join(k for _, k in t.dtypes)).alias("types"), F.sum("id").alias("ids"), F.sum("customer").alias("customers"), F.round(F.sum("price"), 2).alias("prices"),
        F.count_if("even").alias("evens"), F.count("even").alias("filled"), F.min("day").alias("first_day"), F.count("gap").alias("gaps"),
    ))(files.promote(_as_text(spark, d))),
    "SELECT 'bigint,bigint,double,boolean,string,double' AS types, CAST(sum(o_orderkey) AS BIGINT) AS ids, CAST(sum(o_custkey) FILTER (o_orderkey % 4 <> 0) AS BIGINT) AS customers, "
    "round(sum(o_totalprice) FILTER (o_orderkey % 5 <> 0), 2) AS prices, count(*) FILTER (o_orderkey % 2 = 0 AND o_orderkey % 6 <> 0) AS evens, count(*) FILTER (o_orderkey % 6 <> 0) AS filled, "
    "strftime(min(o_orderdate), '%Y-%m-%d') AS first_day, CAST(0 AS BIGINT) AS gaps FROM orders",
)


def _fingerprints(spark, d):
    """Fingerprints of a table, of its rows in another order, and of all rows twice."""
    lines = load(spark, d, "lineitem")
    return (
        files.table_fingerprint(lines).select(F.col("fingerprint").alias("f"), F.lit("plain").alias("version"))
        .union(files.table_fingerprint(lines.repartition(*lines.columns)).select("fingerprint", F.lit("moved")))
        .union(files.table_fingerprint(lines.union(lines)).select("fingerprint", F.lit("doubled")))
        .groupBy("f").agg(F.array_join(F.sort_array(F.collect_list("version")), ",").alias("versions")).select("versions")
    )


QUERIES.add("table_fingerprints", _fingerprints, "SELECT * FROM (VALUES ('moved,plain'), ('doubled')) t(versions) WHERE (SELECT count(*) FROM lineitem) > 0")


def _legacy(spark, d):
    """Customers as JSON maps of an older store, one map each; some lack an id."""
    user = F.struct(
        F.when(F.col("restricted"), F.lit(None)).otherwise(F.col("id")).alias("id"), "username", "email", F.when(F.col("plan") != "free", F.col("plan")).alias("plan"),
    )
    lines = project(spark, d, "users").select(F.to_json(F.create_map(F.col("id"), user)).alias("value"))
    return legacy.legacy_users(lines, F.col("value"))


def _known(spark, d):
    return project(spark, d, "users").filter("plan = 'business'").select("id")


QUERIES.add(
    "legacy_users", lambda spark, d: legacy.load_users(_legacy(spark, d), _known(spark, d))[0].select("id", "username", "plan", "kyb_status", "restricted"),
    with_sql("SELECT id, username, plan, 'pending' AS kyb_status, false AS restricted FROM users_fx WHERE NOT restricted AND plan <> 'business'", "users"),
)
QUERIES.add(
    "legacy_user_counts", lambda spark, d: legacy.load_users(_legacy(spark, d), _known(spark, d))[1],
    with_sql("SELECT count(*) FILTER (NOT restricted AND plan <> 'business') AS created, count(*) FILTER (restricted OR plan = 'business') AS skipped FROM users_fx", "users"),
)
QUERIES.add(
    "compact_metrics",
    lambda spark, d: load(spark, d, "embeddings").select("vec_id", _metric().alias("m")).select("vec_id", *_parts()),
    "SELECT vec_id, CAST(13 AS BIGINT) AS n, '... truncated (' || len(embedding) || ' items)' AS mark, round(CAST(embedding[12] AS DOUBLE), 5) AS last, '{\"d\":\"...\"}' AS deep, label AS shallow FROM embeddings",
)


def _metric():
    """Nested JSON: a vector, and a label five levels down and one level down."""
    deep = F.struct(F.struct(F.struct(F.struct(F.col("label").alias("e")).alias("d")).alias("c")).alias("b"))
    return scoring.compact_json(F.to_json(F.struct(F.col("embedding").alias("v"), deep.alias("a"), F.col("label").alias("l"))))


def _parts():
    path = lambda p: F.get_json_object("m", p)
    return (
        F.json_array_length(path("$.v")).cast("bigint").alias("n"), path("$.v[12]").alias("mark"), F.round(path("$.v[11]").cast("double"), 5).alias("last"),
        path("$.a.b.c").alias("deep"), path("$.l").cast("int").alias("shallow"),
    )


# -------------------------------------------------------------------- streams


def _stream(spark, d, name):
    """A given table as a file stream."""
    configure(spark)
    folder = d.rstrip("/")
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def _drain(stream, spark, mode="append"):
    """Run a stream over all that is there and read what it wrote."""
    root = f"{checkpoint_folder(spark).rstrip('/')}/stream-{uuid.uuid4()}"
    writer = stream.writeStream.format("parquet").outputMode(mode).option("path", f"{root}/out").option("checkpointLocation", f"{root}/state")
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/out")


def _audit_stream(spark, d):
    events = _stream(spark, d, "events").selectExpr(*[f"{e} AS `{c}`" for c, e in PROJECTIONS["audit"][1].items()])
    masked = masked_events(events.withColumn("metadata", F.concat(F.lit('{"api_token":"t","body":'), F.col("metadata"), F.lit("}"))))
    return _drain(masked, spark).select("id", "action", "result", F.col("metadata")["api_token"].alias("token"), F.col("metadata")["body"].alias("body"), F.col("dt").cast("string").alias("dt"))


QUERIES.add(
    "stream_audit", _audit_stream,
    with_sql("SELECT id, action, result, '[REDACTED]' AS token, replace(metadata, ': ', ':') AS body, strftime(created_at, '%Y-%m-%d') AS dt FROM audit_fx", "audit"),
)
_WAIT = 43200
QUERIES.add(
    "stream_rate_limit",
    lambda spark, d: _drain(
        limit_stream(_stream(spark, d, "events").select(F.lpad(F.col("event_id").cast("string"), 20, "0").alias("event_id"), F.col("user_id").cast("string").alias("user_id"), F.col("ts").alias("at")), _WAIT), spark
    ).select(F.col("event_id").cast("bigint").alias("event_id"), F.col("user_id").cast("bigint").alias("user_id"), "accepted"),
    "WITH RECURSIVE ev AS (SELECT user_id AS k, epoch_us(ts) AS t, min(event_id) AS e FROM events GROUP BY ALL), acc AS (SELECT k, min(t) AS t FROM ev GROUP BY k "
    f"UNION ALL SELECT acc.k, (SELECT min(ev.t) FROM ev WHERE ev.k = acc.k AND ev.t > acc.t + {_WAIT * 1_000_000}) FROM acc WHERE acc.t IS NOT NULL) "
    "SELECT event_id, user_id, EXISTS (SELECT 1 FROM acc JOIN ev ON ev.k = acc.k AND ev.t = acc.t WHERE acc.k = user_id AND ev.e = event_id) AS accepted FROM events",
)
