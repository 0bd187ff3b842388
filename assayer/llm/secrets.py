"""Secret scan with multipart credential linking."""

from pyspark.sql import DataFrame, functions as F

from assayer.llm.spans import listed, matches, row_key
from assayer.session import durable

#: The base patterns. Short runs never pass their length check, so
#: ``access`` and ``hex`` ask for it at once; assignments keep theirs apart, as a
#: short value still takes up its place.
ASSIGN = r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]+"
ASSIGN_VALUE = r"^(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ["assign", "access", "hex", "weak_identifier", "weak_secret", "endpoint"]

#: Weak parts: identifiers of other prefixes, bare 40-letter secrets, endpoints.
WEAK_IDENTIFIER = r"(?<![A-Z0-9])(?:ASIA|AIDA|AROA|AGPA|ANPA)[A-Z0-9]{16}(?![A-Z0-9])"
WEAK_SECRET = r"(?<![A-Za-z0-9/+=])[A-Za-z0-9/+]{40}(?![A-Za-z0-9/+=])"
ENDPOINT = r"https?://[A-Za-z0-9.-]++(?::[0-9]++)?+(?:/[A-Za-z0-9._~/-]*+)?+"

SCOPE = 400


def _scanned(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    long_value = lambda m: F.length(F.regexp_extract(m, ASSIGN_VALUE, 1)) >= 6
    base = F.concat(matches(text, ASSIGN, 0, long_value), matches(text, ACCESS, 1), matches(text, HEX, 2))
    weak = F.concat(matches(text, WEAK_IDENTIFIER, 3), matches(text, WEAK_SECRET, 4), matches(text, ENDPOINT, 5))
    return durable(docs.select("doc_id", "text").select(*row_key(), "doc_id", base.alias("base"), weak.alias("weak")))


def _linked(scanned: DataFrame, scope: int) -> DataFrame:
    """Weak parts that have what completes them within ``scope`` characters.

    Interval join: a part meets the others of its row in all pieces of ``scope``
    characters that it touches and the two neighbouring ones; what lies in such a
    piece is bounded by its length. A weak identifier needs a secret, a weak secret an
    identifier, an endpoint both.
    """
    parts = scanned.where("size(weak) > 0").select("k1", "k2", F.explode(F.concat("weak", F.filter("base", lambda x: x["kind"] < 2))).alias("x")).distinct()
    parts = parts.select("k1", "k2", "x", F.when(F.col("x.kind").isin(1, 3), "identifier").when(F.col("x.kind").isin(0, 4), "secret").otherwise("endpoint").alias("role"))
    first, last = F.floor(F.col("x.start") / scope), F.floor(F.col("x.end") / scope)
    weak = parts.where("x.kind >= 3").withColumn("piece", F.explode(F.sequence(first, last)))
    pieces = F.explode(F.sequence(first - 1, last + 1))
    others = parts.where("role != 'endpoint'").select("k1", "k2", F.col("x").alias("y"), F.col("role").alias("other"), pieces.alias("piece"))
    near = (F.col("y.start") - F.col("x.end") <= scope) & (F.col("x.start") - F.col("y.end") <= scope)
    apart = (F.col("y.start") >= F.col("x.end")) | (F.col("x.start") >= F.col("y.end"))
    met = weak.join(others, ["k1", "k2", "piece"]).where(near & apart & (F.col("role") != F.col("other")))
    roles = met.groupBy("k1", "k2", "x", "role").agg(F.max((F.col("other") == "identifier").cast("int")).alias("id"), F.max((F.col("other") == "secret").cast("int")).alias("secret"))
    whole = roles.where("(role = 'identifier' and secret = 1) or (role = 'secret' and id = 1) or (id = 1 and secret = 1)")
    return whole.groupBy("k1", "k2").agg(F.collect_set("x").alias("linked"))


def find_secrets(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Secrets of every whole text: doc_id, base and linked spans.

    Spans are struct(start, kind, end) with kind a number into ``KINDS``; base
    spans come from the patterns alone, linked ones are weak parts of a credential
    that are reported only where the other parts are near. Null and empty texts
    have none; rows that repeat id and text are treated alike; other columns are
    ignored.
    """
    scanned = _scanned(docs)
    none = F.array().cast("array<struct<start: int, kind: int, end: int>>")
    joined = scanned.join(_linked(scanned, scope), ["k1", "k2"], "left")
    return joined.select("doc_id", F.array_sort("base").alias("base"), F.array_sort(F.coalesce("linked", none)).alias("linked"))


def digest(found: DataFrame) -> DataFrame:
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("bigint")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(listed(F.col("base"), KINDS), 256).alias("base_sha256"), listed(F.concat("base", "linked"), KINDS).alias("spans"),
    )
