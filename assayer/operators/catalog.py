"""Catalogue of datasets: building rows, writes as table rewrites, and reads.

Writes take the current table and a batch of changes and return the next
table; sources.versions stores it under a new version.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from assayer import fixed_values as fv
from assayer.functions import policy
from assayer.functions.category import type_match
from assayer.functions.money import normalise_price
from assayer.functions.policy import lookup
from assayer.functions.times import iso_utc, parse_instant

CATALOG_SCHEMA = """
file_hash STRING, schema_version INT, timestamp TIMESTAMP, filename STRING, category STRING, file_type STRING,
quality_score DOUBLE, quality_scores MAP<STRING,DOUBLE>,
category_verification STRUCT<user_selected: STRING, auto_detected: STRING, confidence: DOUBLE, match: BOOLEAN>,
status STRING, details ARRAY<STRING>, description STRING, extra MAP<STRING,STRING>, owner STRING,
storage_provider STRING, object_key STRING, bytes BIGINT, mime STRING, provenance MAP<STRING,STRING>,
compliance_evidence MAP<STRING,STRING>,
access_policy STRUCT<sensitivity: STRING, min_plan: STRING, kyb_required: BOOLEAN, permitted_uses: ARRAY<STRING>, prohibited_uses: ARRAY<STRING>>,
restriction_status STRING, retention_policy MAP<STRING,STRING>, retention_expires_at TIMESTAMP, ask_price_usd DECIMAL(18,2)
"""

MAP = "map<string,string>"


def empty_map() -> Column:
    return F.create_map().cast(MAP)


def merge_maps(old: Column, new: Column) -> Column:
    """Shallow merge, the right side wins; a null side changes nothing."""
    old, new = F.coalesce(old, empty_map()), F.coalesce(new, empty_map())
    kept = F.map_filter(old, lambda k, v: ~F.map_contains_key(new, k))
    return F.map_concat(kept, new)


# ------------------------------------------------------------------ row build


def file_type(filename: Column) -> Column:
    return F.when(F.contains(filename, F.lit(".")), F.lower(F.regexp_extract(filename, r"([^.]*)\z", 1)))


def safe_name(name: Column) -> Column:
    """Base name of a client path; a missing name becomes 'upload'."""
    return F.regexp_extract(F.when(F.coalesce(name, F.lit("")) == "", "upload").otherwise(name), r"([^/]*)\z", 1)


def object_key(file_hash: Column, name: Column) -> Column:
    return F.concat_ws("/", F.lit("datasets"), file_hash, name)


def mime_choice(filename: Column, client: Column) -> Column:
    """Struct(mime, mime_source): the client's type unless generic, else by suffix."""
    specific = F.coalesce(client, F.lit("")) != ""
    specific = specific & ~F.coalesce(client.isin(*fv.GENERIC_MIME), F.lit(False))
    guessed = lookup(fv.MIME_BY_SUFFIX, F.coalesce(file_type(filename), F.lit("")))
    fallback = F.when(F.coalesce(client, F.lit("")) != "", client).otherwise(fv.GENERIC_MIME[0])
    return F.struct(
        F.when(specific, client).otherwise(F.coalesce(guessed, fallback)).alias("mime"),
        F.when(specific, "client").when(guessed.isNotNull(), "filename").otherwise("default").alias("mime_source"),
    )


def coerce_version(raw: Column) -> Column:
    """Whole number of a lenient version text, 0 when unreadable."""
    text = F.trim(raw.cast("string"))
    whole = F.when(text.rlike(r"\A[+-]?\d+\z"), text.try_cast("int"))
    fraction = F.when(text.rlike(r"\A[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\z"), text.try_cast("double"))
    return F.coalesce(whole, fraction.try_cast("int"), F.lit(0))


def build_records(items: DataFrame, as_of: Column, storage_provider: str = "files") -> DataFrame:
    """Catalogue rows from assessed uploads.

    ``items`` holds file_hash, filename, category, owner, description,
    ask_price_usd, bytes, mime, mime_source, and the assessment columns
    predicted_category, confidence, quality_score, status, details,
    best_use_case, redacted_cells, pii_status, stats (json), tags.
    """
    price = normalise_price(F.col("ask_price_usd"))
    rule = policy.access_policy(F.col("category"), F.col("redacted_cells"))
    described = F.when(F.coalesce(F.col("description"), F.lit("")) != "", F.col("description")).otherwise(F.coalesce("best_use_case", F.lit("")))
    key = object_key(F.col("file_hash"), F.col("filename"))
    matched = type_match(F.col("category"), F.col("predicted_category"))
    expires = as_of.cast("timestamp") + F.make_dt_interval(F.lit(fv.RETENTION_DAYS))
    return items.select(
        "file_hash",
        F.lit(fv.SCHEMA_VERSION).alias("schema_version"),
        as_of.cast("timestamp").alias("timestamp"),
        "filename", "category",
        file_type(F.col("filename")).alias("file_type"),
        "quality_score",
        F.create_map(F.lit("overall"), F.col("quality_score")).alias("quality_scores"),
        F.struct(
            F.col("category").alias("user_selected"), F.col("predicted_category").alias("auto_detected"),
            F.col("confidence").alias("confidence"), matched.alias("match"),
        ).alias("category_verification"),
        "status", "details",
        described.alias("description"),
        F.map_filter(
            F.create_map(
                F.lit("owner_user_id"), F.col("owner"), F.lit("predicted_category"), F.col("predicted_category"),
                F.lit("prediction_confidence"), F.col("confidence").cast("string"),
                F.lit("category_match"), matched.cast("string"), F.lit("mime_source"), F.col("mime_source"),
                F.lit("tags"), F.to_json("tags"), F.lit("stats"), F.col("stats"),
                F.lit("ask_price_usd"), price.cast("string"), F.lit("restriction_status"), F.lit("active"),
            ),
            lambda k, v: v.isNotNull(),
        ).alias("extra"),
        "owner",
        F.lit(storage_provider).alias("storage_provider"),
        key.alias("object_key"),
        "bytes", "mime",
        provenance(storage_provider).alias("provenance"),
        compliance_evidence(rule).alias("compliance_evidence"),
        rule.alias("access_policy"),
        F.lit("active").alias("restriction_status"),
        retention_policy(as_of).alias("retention_policy"),
        expires.alias("retention_expires_at"),
        price.alias("ask_price_usd"),
    )


def provenance(storage_provider: str) -> Column:
    """Lineage of an upload; nested parts as JSON text."""
    return F.create_map(
        F.lit("source"), F.lit("seller_upload"), F.lit("uploader_user_id"), F.col("owner"),
        F.lit("original_filename"), F.col("filename"), F.lit("file_hash"), F.col("file_hash"),
        F.lit("storage_provider"), F.lit(storage_provider),
        F.lit("object_key"), object_key(F.col("file_hash"), F.col("filename")),
        F.lit("mime"), F.col("mime"), F.lit("mime_source"), F.col("mime_source"),
        F.lit("pipeline_version"), F.lit(fv.PIPELINE_VERSION),
        F.lit("transformations"), F.to_json(F.array(*[F.lit(t) for t in fv.TRANSFORMATIONS])),
        F.lit("stats"), F.col("stats"),
    )


def compliance_evidence(rule: Column) -> Column:
    """Evidence of the upload checks; nested parts as JSON text."""
    matched = type_match(F.col("category"), F.col("predicted_category"))
    return F.create_map(
        F.lit("pii_report"), F.to_json(F.struct("redacted_cells", F.col("pii_status").alias("status"))),
        F.lit("category_verification"),
        F.to_json(F.struct(
            F.col("category").alias("user_selected"), F.col("predicted_category").alias("auto_detected"),
            "confidence", matched.alias("match"),
        )),
        F.lit("quality"), F.to_json(F.struct(F.col("quality_score").alias("score"), "best_use_case", "details")),
        F.lit("access_policy"), F.to_json(rule),
        F.lit("listing_decision"), policy.listing_decision(rule["sensitivity"]),
    )


def retention_policy(as_of: Column, days: int = fv.RETENTION_DAYS, delete_objects: bool = False) -> Column:
    return F.create_map(
        F.lit("basis"), F.lit(fv.RETENTION_BASIS), F.lit("retention_days"), F.lit(str(days)),
        F.lit("issued_at"), iso_utc(as_of), F.lit("expiry_action"), F.lit(fv.RETENTION_ACTION),
        F.lit("object_deletion_enabled"), F.lit(str(delete_objects).lower()),
    )


def resolve_fields(records: DataFrame, as_of: Column) -> DataFrame:
    """Fill control fields of loosely typed records from their ``extra`` copy,
    then from defaults."""
    extra = F.coalesce("extra", empty_map())

    def text(name: str, default: Column | None = None) -> Column:
        own = F.when(F.col(name) != "", F.col(name))
        parts = [own, F.when(extra[name] != "", extra[name])] + ([default] if default is not None else [])
        return F.coalesce(*parts)

    def mapping(name: str) -> Column:
        own = F.when(F.size(F.coalesce(name, empty_map())) > 0, F.col(name))
        return F.coalesce(own, F.from_json(extra[name], MAP), empty_map())

    price = normalise_price(F.col("ask_price_usd"))
    priced = F.when(price.isNotNull(), F.create_map(F.lit("ask_price_usd"), price.cast("string"))).otherwise(empty_map())
    return records.withColumns(
        {
            "owner": F.coalesce(F.when(F.col("owner") != "", F.col("owner")), extra["owner_user_id"]),
            "schema_version": coerce_version(F.col("schema_version")),
            "timestamp": parse_instant(F.col("timestamp").cast("string"), as_of),
            "description": F.coalesce("description", F.lit("")),
            "details": F.coalesce("details", F.array().cast("array<string>")),
            "extra": merge_maps(extra, priced),
            "provenance": mapping("provenance"),
            "compliance_evidence": mapping("compliance_evidence"),
            "retention_policy": mapping("retention_policy"),
            "restriction_status": text("restriction_status", F.lit("active")),
            "retention_expires_at": F.when(text("retention_expires_at").isNotNull(), parse_instant(text("retention_expires_at"), as_of)),
            "ask_price_usd": price,
        }
    )


# --------------------------------------------------------------------- writes


def latest(batch: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Last row per key by aggregation: many versions of one key collapse before
    the shuffle, so a hot key is not sorted in one task."""
    whole = F.struct(*[F.col(f"`{c}`") for c in batch.columns])
    return batch.groupBy(key).agg(F.max_by(whole, F.struct(*order)).alias("__r")).select("__r.*")


def upsert(current: DataFrame, batch: DataFrame, order: Sequence[str], key: str = "file_hash") -> DataFrame:
    """Replace rows by key, last write wins, and add new ones."""
    newest = latest(batch, key, order)
    kept = current.join(newest.select(key), key, "left_anti").select(*current.columns)
    known = [c for c in current.columns if c in batch.columns]
    return kept.unionByName(newest.select(*known), allowMissingColumns=True)


def add_columns(current: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """Schema evolution: new nullable columns, backfilled with their default."""
    return current.withColumns(
        {n: F.coalesce(F.col(n), d) if n in current.columns else d for n, d in defaults.items()}
    )


def update_controls(current: DataFrame, updates: DataFrame) -> DataFrame:
    """Apply one control update per file_hash: maps merge shallowly, scalars are
    replaced, null means not supplied."""
    maps = ("extra", "provenance", "compliance_evidence", "retention_policy")
    given = [c for c in updates.columns if c != "file_hash"]
    joined = current.join(updates.select("file_hash", *[F.col(c).alias(f"__n_{c}") for c in given]), "file_hash", "left")
    changed = {}
    for c in given:
        new = F.col(f"__n_{c}")
        if c in maps:
            changed[c] = F.when(new.isNull(), F.col(c)).otherwise(merge_maps(F.col(c), new))
        elif c == "access_policy":
            fields = current.schema[c].dataType.names
            have = updates.schema[c].dataType.names
            merged = F.struct(*[(F.coalesce(new[f], F.col(c)[f]) if f in have else F.col(c)[f]).alias(f) for f in fields])
            changed[c] = F.when(new.isNull(), F.col(c)).otherwise(merged)
        else:
            changed[c] = F.coalesce(new, F.col(c))
    return joined.withColumns(changed).select(*current.columns)


def owner_in_extra() -> Column:
    return F.coalesce("extra", empty_map())["owner_user_id"]


def decide_changes(current: DataFrame, requests: DataFrame, checks: Column | None = None) -> DataFrame:
    """Owner-only changes: each request gets a reason, null when accepted.

    The owner is the one noted in ``extra``. ``checks`` adds reasons that come
    before the lookup.
    """
    owners = current.select("file_hash", owner_in_extra().alias("__owner"), F.lit(True).alias("__found"))
    joined = requests.join(owners, "file_hash", "left")
    requester = F.coalesce("requester_id", F.lit(""))
    reason = (
        F.when(F.col("__found").isNull(), "not_found")
        .when(requester == "", "missing_requester")
        .when(F.coalesce("__owner", F.lit("")) != requester, "not_owner")
    )
    out = reason if checks is None else F.coalesce(checks, reason)
    return joined.withColumn("reason", out).drop("__owner", "__found")


def decide_descriptions(current: DataFrame, requests: DataFrame, users: DataFrame | None = None) -> DataFrame:
    """Description updates: text up to 1000 characters, by the owner; a missing
    id is looked up by name."""
    text = F.col("description")
    problem = F.when(text.isNull(), "invalid_description_type").when(F.length(text) > fv.DESCRIPTION_LIMIT, "description_too_long")
    if users is not None and "requester_username" in requests.columns:
        names = users.select(F.col("username").alias("requester_username"), F.col("id").alias("__by_name"))
        requests = requests.join(names, "requester_username", "left")
        requests = requests.withColumn("requester_id", F.coalesce("requester_id", "__by_name")).drop("__by_name")
    return decide_changes(current, requests, problem)


def apply_descriptions(current: DataFrame, decided: DataFrame, order: Sequence[str]) -> DataFrame:
    accepted = latest(decided.filter("reason IS NULL"), "file_hash", order).select("file_hash", F.col("description").alias("__new"))
    joined = current.join(accepted, "file_hash", "left")
    return joined.withColumn("description", F.coalesce("__new", "description")).select(*current.columns)


def delete_records(current: DataFrame, hashes: DataFrame) -> DataFrame:
    return current.join(hashes.select("file_hash"), "file_hash", "left_anti")


# ---------------------------------------------------------------------- reads


def list_records(catalog: DataFrame, limit: int | None = None) -> DataFrame:
    """Newest first; ties by hash. No limit, or 0, lists all."""
    listed = catalog.orderBy(F.desc("timestamp"), "file_hash")
    return listed.limit(limit) if limit else listed


def owner_id() -> Column:
    return F.coalesce(F.nullif("owner", F.lit("")), owner_in_extra())


def list_by_owner(catalog: DataFrame, owner: str, limit: int | None = None, filter_first: bool = False, owner_column: Column | None = None) -> DataFrame:
    """Records of an owner. The limit applies before the owner filter, as
    published; ``filter_first`` turns that round and lets the filter reach the
    scan."""
    mine = (owner_column if owner_column is not None else owner_in_extra()) == owner
    if filter_first or not limit:
        return list_records(catalog.filter(mine), limit)
    return list_records(catalog, limit).filter(mine)


def load_records(catalog: DataFrame, hashes: DataFrame) -> DataFrame:
    return catalog.join(hashes.select("file_hash"), "file_hash", "left_semi")


def market_score() -> Column:
    """Stored score, else the overall entry."""
    return F.coalesce("quality_score", F.col("quality_scores")["overall"])


def market_filter(
    catalog: DataFrame, category: str = "all", suffix: str = "all",
    confidence: tuple[float | None, float | None] = (None, None),
    quality: tuple[float | None, float | None] = (None, None),
    confidence_column: Column | None = None, score_column: Column | None = None,
) -> DataFrame:
    """Marketplace filter. A null value fails an active range; a range with
    min > max is ignored."""
    out = catalog
    if category != "all":
        out = out.filter(F.coalesce(F.nullif("category", F.lit("")), F.lit("general")) == category)
    if suffix != "all":
        out = out.filter(F.lower(F.coalesce(F.nullif("file_type", F.lit("")), F.lit("other"))) == suffix)
    conf = confidence_column if confidence_column is not None else F.coalesce(
        F.col("category_verification.confidence"), F.col("extra")["prediction_confidence"].try_cast("double"))
    score = score_column if score_column is not None else market_score()
    for value, (low, high) in ((conf, confidence), (score, quality)):
        if low is not None and high is not None and low > high:
            continue
        if low is not None:
            out = out.filter(value >= low)
        if high is not None:
            out = out.filter(value <= high)
    return out


def market_sort(catalog: DataFrame, key: str, score_column: Column | None = None) -> DataFrame:
    """'newest' or 'trending' (score, then time); ties by hash."""
    if key == "newest":
        return catalog.orderBy(F.desc("timestamp"), "file_hash")
    if key == "trending":
        score = F.coalesce(score_column if score_column is not None else market_score(), F.lit(0.0))
        return catalog.orderBy(score.desc(), F.desc("timestamp"), "file_hash")
    return catalog


HISTORY_KEYS = {
    "date": lambda: F.coalesce(F.unix_micros(F.col("timestamp").cast("timestamp")), F.lit(0)),
    "quality": lambda: F.coalesce("quality_score", F.lit(-1.0)),
    "size": lambda: F.coalesce("bytes", F.lit(-1)),
}


def history_sort(records: DataFrame, key: str, position: str) -> DataFrame:
    """Sort by '<date|quality|size>_<asc|desc>'; ties keep the input position."""
    name, _, direction = key.partition("_")
    if name not in HISTORY_KEYS:
        return records.orderBy(position)
    value = HISTORY_KEYS[name]()
    return records.orderBy(value.desc() if direction == "desc" else value.asc(), position)


def facets(catalog: DataFrame, position: str, n: int = 8) -> DataFrame:
    """First ``n`` distinct lower-cased categories by position, or the fixed bins
    when there are fewer."""
    name = F.lower(F.coalesce(F.nullif("category", F.lit("")), F.lit("general")))
    found = catalog.groupBy(name.alias("facet")).agg(F.min(position).alias("first_seen"))
    top = found.orderBy("first_seen").limit(n)
    listed = top.agg(F.transform(F.sort_array(F.collect_list(F.struct("first_seen", "facet"))), lambda r: r["facet"]).alias("f"))
    fixed = F.array(*[F.lit(c) for c in fv.UPLOAD_CATEGORIES])
    chosen = F.when(F.size("f") >= n, F.col("f")).otherwise(fixed)
    return listed.select(F.posexplode(chosen).alias("pos", "facet")).select((F.col("pos") + 1).cast("bigint").alias("position"), "facet")


def detail_view(catalog: DataFrame) -> DataFrame:
    extra = F.coalesce("extra", empty_map())
    return catalog.select(
        "file_hash",
        F.coalesce("quality_score", F.col("quality_scores")["overall"], F.lit(0.0)).alias("score"),
        F.col("category_verification.confidence").alias("confidence"),
        F.coalesce("description", extra["description"], F.lit("")).alias("description"),
        F.coalesce(F.col("ask_price_usd"), extra["ask_price_usd"].try_cast("decimal(18,2)")).alias("ask_price_usd"),
    )
