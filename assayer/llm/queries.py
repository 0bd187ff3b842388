"""Registered queries of the training-data operators: op<N>_<name>."""

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, functions as F

from assayer.llm import decontaminate, divergence, fuzzyhash, lines, neardup, neural, personal, pieces, quality, repeats, runs, secrets, warc
from assayer.llm.words import table
from assayer.plans.registry import Registry
from assayer.session import checkpoint_folder

QUERIES = Registry()


def op1_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op2_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fuzzyhash.fingerprints(table(spark, folder, "documents"))


def op3_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    cleaned = lines.remove_boilerplate(table(spark, folder, "documents"))
    return cleaned.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op4_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    scored = quality.score(docs.select("doc_id", "text"), quality.train(docs, labels))
    return scored.select("doc_id", F.coalesce(quality.held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_warc(spark: SparkSession, folder: str) -> DataFrame:
    path = f"{checkpoint_folder(spark)}/warc-{uuid4().hex}"
    warc.write_archives(table(spark, folder, "pages"), path)
    found = warc.transactions(warc.read_archives(spark, path, payload=False))
    again = F.col("main.record_type") == "revisit"
    declared = F.try_element_at(F.col("metadata.headers"), F.lit("payload-bytes")).cast("bigint")
    return found.select(
        F.try_to_number(F.split("capture_id", ":")[2], F.lit("S9999999999999999999")).cast("bigint").alias("page_id"),
        F.when(again, declared).otherwise(F.col("main.payload_bytes")).alias("payload_bytes"),
        F.when(again, F.col("main.payload_digest")).otherwise(F.col("main.payload_sha1")).alias("payload_digest"),
        F.col("main.record_type").alias("record_type"), F.regexp_extract("main.refers_to", "^<urn:page:(-?[0-9]+)>$", 1).cast("bigint").alias("refers_to"),
    )


def op6_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.digest(secrets.find_secrets(table(spark, folder, "documents")))


def op7_personal(spark: SparkSession, folder: str) -> DataFrame:
    return personal.digest(personal.find_personal(table(spark, folder, "documents")))


def op8_repeats(spark: SparkSession, folder: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, folder, "documents")).drop("kept")


def op9_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.encode(table(spark, folder, "documents").select("doc_id", "text"), with_ids=False)


def op10_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, folder, "documents"), size=3, percent=85)


def op11_language_model(spark: SparkSession, folder: str) -> DataFrame:
    return neural.score(table(spark, folder, "documents"))


def _periodic(docs: DataFrame) -> DataFrame:
    """The edit of the contract: one text in ten goes on in a period from word a on."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", "[ \\x09-\\x0D]+"), lambda w: w != "")
    g, n = F.floor(F.col("h") / 10), F.size("w").cast("bigint")
    edited = F.expr("array_join(transform(w, (x, i) -> if(i < a, x, w[int(a + (i - a) % p)])), ' ')")
    cut = docs.select("doc_id", "text", h.alias("h")).withColumn("w", F.when(F.col("h") % 10 == 0, words))
    cut = cut.withColumn("a", F.when(n > 0, g % n)).withColumn("p", F.lit(1).cast("bigint") + F.floor((n - F.col("a")) / (3 + g % 8)))
    return cut.select("doc_id", F.when(F.col("a").isNotNull(), edited).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    found = runs.collapse_runs(_periodic(table(spark, folder, "documents")))
    best = F.expr("aggregate(runs, cast(null as struct<start: bigint, length: bigint, period: bigint>), (b, r) -> if(b is null or r.length * b.period > b.length * r.period, r, b))")
    listed = F.concat_ws("", F.transform("runs", lambda r: F.format_string("%d,%d,%d\n", r["start"], r["length"], r["period"])))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.audit(table(spark, folder, "documents")).withColumnRenamed("kind", "part")


LINES_SQL = """
WITH rows AS (
  SELECT doc_id, coalesce(source, '') AS site, string_split(text, chr(10)) AS cut FROM documents
), spread AS (
  SELECT trim(line) AS line, count(DISTINCT site) AS n, min(doc_id) AS first FROM (SELECT doc_id, site, unnest(cut) AS line FROM rows)
  WHERE trim(line) <> '' GROUP BY 1 HAVING count(DISTINCT site) >= 5
), lines AS (
  SELECT doc_id, unnest(cut) AS line, generate_subscripts(cut, 1) AS place FROM rows
), marked AS (
  SELECT l.doc_id, l.place, l.line, s.line IS NOT NULL AND s.first <> l.doc_id AS gone FROM lines l LEFT JOIN spread s ON trim(l.line) = s.line
)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_removed,
  sha256(coalesce(string_agg(CASE WHEN gone THEN NULL ELSE line END, chr(10) ORDER BY place), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

WARC_SQL = """
WITH own AS (
  SELECT page_id, coalesce(html, '') AS body FROM pages
), first AS (
  SELECT body, min(page_id) AS first FROM own GROUP BY body
), joined AS (
  SELECT page_id, octet_length(encode(body)) AS payload_bytes, sha1(body) AS hex, first FROM own JOIN first USING (body)
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(((CAST('0x' || substr(hex, CAST(1 + 5 * (i // 4) AS INT), 5) AS INT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31) + 1 AS INT), 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM joined
"""

DIVERGENCE_SQL = """
WITH docs AS (
  SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms FROM documents
), groups AS (
  SELECT DISTINCT lang, source FROM docs
), used AS (
  SELECT lang, source, k, term, count(*) AS n FROM (SELECT lang, source, k, unnest(terms) AS term FROM docs) GROUP BY ALL
), kept AS (
  SELECT lang, term FROM used GROUP BY lang, term HAVING count(*) >= 30
), sizes AS (
  SELECT lang, count(*) AS v FROM kept GROUP BY lang
), counted AS (
  SELECT lang, source, term, sum(n) AS c FROM used JOIN kept USING (lang, term) GROUP BY ALL
), dense AS (
  SELECT g.lang, g.source, k.term, CAST(coalesce(c.c, 0) AS HUGEINT) AS c FROM groups g JOIN kept k USING (lang) LEFT JOIN counted c USING (lang, source, term)
), shares AS (
  SELECT lang, source, term, c, 1 + (1000000000 * (c + 5)) // (CAST(sum(c) OVER (PARTITION BY lang, source) AS HUGEINT) + 5 * v) AS p FROM dense JOIN sizes USING (lang)
), whole AS (
  SELECT lang, term, 1 + (1000000000 * (c + 5)) // (CAST(sum(c) OVER (PARTITION BY lang) AS HUGEINT) + 5 * v) AS q
  FROM (SELECT lang, term, CAST(sum(c) AS HUGEINT) AS c FROM counted GROUP BY ALL) JOIN sizes USING (lang)
), compared AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(c.value, 0) AS BIGINT) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN compared c ON c.lang = a.lang AND c.source = a.source AND c.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM shares JOIN whole USING (lang, term) WHERE c > 0 AND p > q
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM parts
)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""

QUERIES.add("op1_decontaminate", op1_decontaminate)
QUERIES.add("op2_fingerprints", op2_fingerprints)
QUERIES.add("op3_line_dedup", op3_line_dedup, LINES_SQL)
QUERIES.add("op4_quality", op4_quality)
QUERIES.add("op5_warc", op5_warc, WARC_SQL)
QUERIES.add("op6_secrets", op6_secrets)
QUERIES.add("op7_personal", op7_personal)
QUERIES.add("op8_repeats", op8_repeats)
QUERIES.add("op9_pieces", op9_pieces)
QUERIES.add("op10_near_duplicates", op10_near_duplicates)
QUERIES.add("op11_language_model", op11_language_model)
QUERIES.add("op12_periodic_runs", op12_periodic_runs)
QUERIES.add("op13_source_divergence", op13_source_divergence, DIVERGENCE_SQL)
