"""Upload intake: many delimited files assessed, scrubbed and catalogued at once.

Files are read as lines, so one huge file is many tasks and thousands of small
ones are a few. Rows meet the facts of their file by (file, block, slice), so a huge
file stays spread; everything per file is an aggregate that is combined before its
shuffle.
"""

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from assayer import fixed_values as fv
from assayer.functions import numeric, pii
from assayer.functions.category import tags, with_category
from assayer.functions.keys import narrow_text
from assayer.operators.access import intake_gate
from assayer.operators.audit import AUDIT_COLUMNS, audit_rows
from assayer.operators.catalog import build_records, mime_choice, safe_name, upsert
from assayer.operators.fastscore import assess_unread, detail_lines, with_quality_score
from assayer.session import durable
from assayer.sources.files import cell_kinds, null_spellings

KINDS = ("bigint", "double", "boolean")
#: Slices of a block: a file that comes as one block still goes to many tasks.
SLICES = 256


def read_lines(spark: SparkSession, paths) -> DataFrame:
    """(file, at, line): lines of delimited files in file order; blank lines are
    skipped. Quoted cells must not span lines."""
    raw = spark.read.text(paths)
    at = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    return raw.select(F.col("_metadata.file_path").alias("file"), at.alias("at"), F.regexp_replace("value", r"\r\z", "").alias("line")).filter("line <> ''")


def split_line(line: Column) -> Column:
    """Cells of one delimited line, quotes resolved."""
    raw = F.regexp_extract_all(F.concat(line, F.lit(",")), F.lit('("(?:[^"]|"")*+"|[^,]*+),'), F.lit(1))
    return F.transform(
        raw,
        lambda c: F.when(c.startswith('"'), F.replace(F.substring(c, 2, F.length(c) - 2), F.lit('""'), F.lit('"'))).otherwise(c),
    )


PLACE = ["file", "__block", "__slice"]


def _placed(lines: DataFrame) -> DataFrame:
    """Lines with their place as columns, which stay as they are if they are there."""
    if set(PLACE) <= set(lines.columns):
        return lines
    return lines.withColumns({"__block": F.col("at.block"), "__slice": F.pmod(F.xxhash64("at"), F.lit(SLICES))})


def parse_files(lines: DataFrame) -> DataFrame:
    """(file, head_at, header, places, kinds): header cells, the blocks that the file
    was read in with their slices that have lines, and promoted column types.

    The header line takes part in the counts and is taken off again, so that no
    join is needed to skip it. The counts are plain numbers per (file, column)
    and are combined before the shuffle.
    """
    heads = _placed(lines).groupBy("file").agg(F.min(F.struct("at", "line")).alias("h"), F.collect_set(F.struct("__block", "__slice")).alias("places"))
    heads = heads.select("file", F.col("h.at").alias("head_at"), split_line(F.col("h.line")).alias("header"), "places")
    cells = lines.select("file", F.posexplode(split_line(F.col("line"))).alias("pos", "raw"))
    cells = cells.select("file", "pos", null_spellings(F.col("raw")).alias("cell"))
    fits = cell_kinds(F.col("cell"))
    counted = cells.groupBy("file", "pos").agg(F.count("cell").alias("filled"), *[F.count_if(~fits[k]).alias(k) for k in KINDS])
    by_file = counted.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("pos", "filled", *KINDS))).alias("columns"))

    def kind(name: Column, column: Column) -> Column:
        own = null_spellings(name)
        tests = cell_kinds(own)
        clean = {k: column[k] == (~tests[k]).cast("int") for k in KINDS}
        return (
            F.when(column["filled"] == own.isNotNull().cast("int"), "double").when(clean["bigint"], "bigint")
            .when(clean["double"], "double").when(clean["boolean"], "boolean").otherwise("string")
        )

    own_columns = F.slice("columns", F.lit(1), F.size("header"))
    return heads.join(by_file, "file").select("file", "head_at", "header", "places", F.zip_with("header", own_columns, kind).alias("kinds"))


def _typed_text(cell: Column, kind: Column) -> Column:
    """Canonical text of a typed cell, so that 1.0 and 1 in a double column agree."""
    return (
        F.when(kind == "double", (F.trim(cell).try_cast("double") + 0.0).cast("string"))
        .when(kind == "bigint", F.trim(cell).try_cast("bigint").cast("string"))
        .when(kind == "boolean", F.lower(cell)).otherwise(cell)
    )


def scrub_files(lines: DataFrame, facts: DataFrame) -> DataFrame:
    """(file, at, header, clean, key, missing, redacted): data rows with string
    cells scrubbed. ``facts`` has one row per file, and goes to each of its places."""
    width = F.size("header")
    cells = F.transform(split_line(F.col("line")), null_spellings)
    # Short rows are filled with nulls, as readers do.
    padded = F.slice(F.concat(cells, F.array_repeat(F.lit(None).cast("string"), width)), F.lit(1), width)
    by_place = facts.select("file", "head_at", "header", "kinds", F.inline("places").alias("__block", "__slice"))
    # Compressed lines can pass for a small side; broadcast, they would all meet the facts in one task.
    joined = _placed(lines).join(by_place.hint("merge"), PLACE).filter("at > head_at").select("file", "at", "header", "kinds", padded.alias("cells"))
    clean = F.zip_with(
        "cells", "kinds",
        lambda c, k: F.when(k == "string", pii.scrub(F.coalesce(c, F.lit("")))).otherwise(_typed_text(c, k)),
    )
    keyed = F.zip_with("cells", "kinds", lambda c, k: narrow_text(_typed_text(c, k)))
    out = joined.select("file", "at", "header", "cells", "kinds", clean.alias("clean"), keyed.alias("key"))
    changed = F.zip_with(
        F.zip_with("cells", "kinds", lambda c, k: F.when(k == "string", F.coalesce(c, F.lit("")))),
        "clean", lambda source, done: source.isNotNull() & (source != done),
    )
    return out.select(
        "file", "at", "header", "clean", "key",
        F.size(F.filter("cells", lambda c: c.isNull())).alias("missing"),
        F.size(F.filter(changed, lambda x: x)).alias("redacted"),
    )


def assess_files(lines: DataFrame, names: DataFrame) -> DataFrame:
    """One report row per file; ``names`` holds (file, filename).

    Counts and distinct rows are partial aggregates; the first ten rows come from
    a ranked window whose limit Spark applies before the shuffle, and only those
    are scrubbed for the category. Lines are dealt out once, by the places at which
    they meet the facts.
    """
    lines = _placed(lines.select("file", "at", "line")).repartition(*PLACE)
    facts = parse_files(lines)
    rows = scrub_files(lines, facts)
    stats = rows.groupBy("file").agg(
        F.count("*").alias("row_count"), F.sum("missing").alias("missing_cells"),
        F.count_distinct("key").alias("__distinct"), F.sum("redacted").cast("long").alias("redacted_cells"),
    )
    first = lines.withColumn("rank", F.row_number().over(Window.partitionBy("file").orderBy("at"))).filter("rank <= 11").drop("rank")
    shown = F.concat_ws(" ", F.transform("clean", lambda c: F.coalesce(c, F.lit(""))))
    heads = scrub_files(first, facts).groupBy("file").agg(F.sort_array(F.collect_list(F.struct("at", shown.alias("cells")))).alias("h"))
    heads = heads.select("file", F.array_join(F.transform("h", lambda r: r["cells"]), " ").alias("head"))
    joined = facts.join(stats, "file", "left").join(heads, "file", "left").fillna(0, ["row_count", "missing_cells", "__distinct", "redacted_cells"])
    width = F.size("header").cast("long")
    total = F.col("row_count") * width
    pct = F.when(total > 0, F.col("missing_cells") / total * 100).otherwise(0.0)
    measured = joined.select(
        "file", "header", F.coalesce("head", F.lit("")).alias("head"), "row_count", width.alias("column_count"), "missing_cells",
        numeric.half_even(pct, 2).alias("missing_percentage"), pct.alias("missing_pct_exact"),
        (F.col("row_count") - F.col("__distinct")).alias("duplicate_rows"), "redacted_cells",
    )
    scored = with_quality_score(measured).join(names.select("file", "filename"), "file")
    text = F.concat_ws(" ", "filename", F.array_join("header", " "), "head")
    labelled = with_category(scored, text, "c")
    parts = [(name, F.col(name.lower())) for name in fv.FAST_WEIGHTS]
    return labelled.select(
        "file", "filename", F.col("c.category").alias("predicted_category"), F.col("c.confidence").alias("confidence"),
        "quality_score", numeric.pass_gate(F.col("quality_score")).alias("status"),
        detail_lines(F.col("c.category"), F.col("quality_score"), F.col("best_use_case"), parts).alias("details"),
        tags(F.col("c.category"), F.col("quality_score")).alias("tags"), "best_use_case", "redacted_cells",
        pii.redaction_status(F.col("redacted_cells")).alias("pii_status"),
        F.to_json(F.struct("row_count", "column_count", "missing_cells", "missing_percentage", "duplicate_rows")).alias("stats"),
    )


def join_line(cells: Column) -> Column:
    quoted = F.transform(
        cells, lambda c: F.when(c.rlike('[",\\n\\r]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.coalesce(c, F.lit("")))
    )
    return F.array_join(quoted, ",")


def scrubbed_lines(lines: DataFrame) -> DataFrame:
    """(file, at, line) of the scrubbed files, headers included."""
    facts = parse_files(lines)
    heads = facts.select("file", F.col("head_at").alias("at"), join_line(F.col("header")).alias("line"))
    return heads.unionByName(scrub_files(lines, facts).select("file", "at", join_line(F.col("clean")).alias("line")))


def is_delimited(name: Column) -> Column:
    return F.lower(name).endswith(".csv")


def gate_uploads(uploads: DataFrame, users: DataFrame) -> DataFrame:
    """Uploads with safe names, media types and the first failing rule.

    ``uploads`` has file, file_hash, filename, category, user_id, description,
    ask_price_usd, content_type and bytes.
    """
    named = uploads.withColumn("filename", safe_name(F.col("filename")))
    typed = named.withColumn("__m", mime_choice(F.col("filename"), F.col("content_type"))).select("*", "__m.*").drop("__m")
    return intake_gate(typed, users)


def ingest(uploads: DataFrame, lines: DataFrame, users: DataFrame, catalog: DataFrame, as_of: Column, storage_provider: str = "files") -> tuple[DataFrame, DataFrame]:
    """(next catalogue, audit rows) for a batch of uploads.

    ``lines`` holds the lines of the delimited files among them (``read_lines``).
    Re-running a batch changes nothing but times: rows are keyed by file hash.
    """
    gated = gate_uploads(uploads, users)
    accepted = gated.filter("reason IS NULL")
    tables = accepted.filter(is_delimited(F.col("filename")))
    wanted = lines.join(tables.select("file").distinct(), "file", "left_semi")
    reports = assess_files(wanted, tables.select("file", "filename")).drop("filename")
    read = tables.join(reports, "file")
    # Tables without a single line keep the default report, with the reason.
    empty = tables.join(lines.select("file").distinct(), "file", "left_anti")
    unread = with_unread_report(accepted.filter(~is_delimited(F.col("filename"))))
    failed = with_unread_report(empty, suffix=False).withColumn("pii_status", F.lit(EMPTY_TABLE))
    both = read.unionByName(unread).unionByName(failed).withColumn("owner", F.col("user_id"))
    # Used by the catalogue and by the audit: assessed once.
    records = durable(build_records(both, as_of, storage_provider))
    following = upsert(catalog, records, ["timestamp", "filename"]).select(*catalog.columns)
    return following, upload_audit(gated, records, as_of)


EMPTY_TABLE = "Fast pipeline fallback used: No columns to parse from file"


def with_unread_report(uploads: DataFrame, suffix: bool = True) -> DataFrame:
    """Uploads that are not delimited tables, with the default report columns."""
    reported = assess_unread(uploads, "filename", keep=uploads.columns, suffix=suffix)
    return reported.withColumnRenamed("generated_tags", "tags").withColumn("stats", F.lit("{}"))


def upload_audit(gated: DataFrame, records: DataFrame, as_of: Column) -> DataFrame:
    """One audit row per upload, with the refusal reason or the outcome."""
    outcome = records.select("file_hash", F.col("quality_score").alias("__score"), F.col("category_verification.auto_detected").alias("__found"))
    joined = gated.join(outcome.dropDuplicates(["file_hash"]), "file_hash", "left")
    refused = F.col("reason").isNotNull()
    done = F.create_map(
        F.lit("filename"), F.col("filename"), F.lit("category"), F.col("category"), F.lit("predicted_category"), F.col("__found"),
        F.lit("quality_score"), F.col("__score").cast("string"), F.lit("bytes"), F.col("bytes").cast("string"),
    )
    events = joined.select(
        F.sha2(F.concat_ws("|", F.lit("upload"), "file_hash", "user_id", "filename", "reason"), 256).alias("id"),
        F.col("user_id").alias("actor_id"), F.lit("UPLOAD_DATASET").alias("action"),
        F.when(~refused, F.col("file_hash")).alias("resource"), F.lit("seller_upload").alias("purpose"),
        F.when(refused, "DENIED").otherwise("SUCCESS").alias("result"),
        F.when(refused, F.create_map(F.lit("reason"), F.col("reason"), F.lit("category"), F.col("category"))).otherwise(done).alias("metadata"),
        as_of.cast("timestamp").alias("created_at"),
    )
    return audit_rows(events).select(*AUDIT_COLUMNS)
