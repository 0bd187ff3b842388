"""Personal data: patterns, and contextual extraction bootstrapped from what they find."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from assayer.llm.spans import listed, matches, row_key
from assayer.session import durable

#: The base patterns, written so that a long run of fitting
#: characters is looked at once. A match starts a run or follows a match.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])[0-9](?:[\x20-]?+[0-9]){11,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ["email", "ip", "card", "phone", "context"]

#: Words with a digit, @ or +, with the groups of digits that follow: what can
#: have the shape of a match. All of these hold a digit or @, or begin with +.
TOKEN = r"(?<!\S)[^\s0-9@+]*+[0-9@+]\S*+(?:\x20(?=[().+-]*+[0-9])[0-9().+-]++(?![^\s,;:!?]))*+"

ROUNDS, SEEDS, CONFIDENT = 3, 3, 0.8


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(match: Column) -> Column:
    digits = F.split(F.reverse(_digits(match)), "")
    numbers = F.transform(digits, lambda x, i: F.when(i % 2 == 0, x.cast("int")).otherwise(x.cast("int") * 2 - F.when(x.cast("int") > 4, 9).otherwise(0)))
    long_enough = F.length(_digits(match)).between(12, 19)
    return long_enough & (F.aggregate(F.when(long_enough, numbers), F.lit(0), lambda a, x: a + x) % 10 == 0)


def _address(match: Column) -> Column:
    parts = F.transform(F.split(match, r"\."), lambda x: F.regexp_replace(x, "^0+(?=[0-9])", ""))
    return F.forall(parts, lambda x: (F.length(x) <= 3) & (F.substring(x, 1, 3).cast("int") <= 255))


class _Context:
    """Lexical pattern around a token or base span: up to two words among the
    ``reach`` characters before it, and the first ``marks`` characters of its shape.
    Both are part of what a pattern is, not of what is looked at."""

    names = ["pattern", "token"]
    reach, marks = 80, 40

    def __call__(self, match: Column, before: Column) -> list[Column]:
        words = F.lower(F.regexp_extract(before, r"((?:\S+\s+)?\S+)\s*$", 1))
        shape = F.regexp_replace(match, "[^@+()]+", "x")
        masked = F.regexp_replace(F.regexp_replace(words, "[0-9]", "9"), r"\s+", " ")
        return [F.concat(masked, F.lit(" | "), F.substring(shape, 1, self.marks)).alias("pattern"), F.sha1(F.lower(match)).alias("token")]


def _scanned(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    phone = lambda m: F.length(_digits(m)).between(9, 15)
    kinds = [(EMAIL, None), (IP, _address), (CARD, _luhn), (PHONE, phone)]
    seeds = F.concat(*[matches(text, pattern, kind, ok, _Context()) for kind, (pattern, ok) in enumerate(kinds)])
    tokens = matches(text, TOKEN, len(kinds), None, _Context())
    return durable(docs.select("doc_id", "text").select(*row_key(), "doc_id", seeds.alias("seeds"), tokens.alias("tokens")))


def _span(x: Column) -> Column:
    return F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"))


def _discovered(scanned: DataFrame, rounds: int) -> DataFrame:
    """Tokens that confident patterns hold, by row.

    Base spans are the seeds; tokens that overlap one are left to it. In each round a pattern scores
    the sum of its distinct tokens' scores over their number plus one, and a token
    that is no seed the best score of its patterns; only patterns with ``SEEDS``
    distinct seeds or more count. Hot patterns and tokens are aggregated by
    (pattern, token) first.
    """
    spread = scanned.where("size(seeds) + size(tokens) > 0").select("k1", "k2", F.explode(F.concat("seeds", "tokens")).alias("x"))
    seed = F.col("x.kind") != KINDS.index("context")
    # a token overlaps a seed that began before and ends in it, or begins in it
    row = Window.partitionBy("k1", "k2")
    reach = F.max(F.when(seed, F.col("x.end"))).over(row.orderBy("x.start", "x.kind"))
    ahead = F.min(F.when(seed, F.col("x.start"))).over(row.orderBy(F.desc("x.start"), F.desc("x.kind")))
    placed = spread.select("k1", "k2", "x", seed.alias("seed"), reach.alias("reach"), ahead.alias("ahead"))
    overlaps = F.coalesce(F.col("reach") > F.col("x.start"), F.lit(False)) | F.coalesce(F.col("ahead") < F.col("x.end"), F.lit(False))
    seen = placed.where(F.col("seed") | ~overlaps).select("k1", "k2", _span(F.col("x")).alias("span"), F.col("x.pattern").alias("pattern"), F.col("x.token").alias("token"), "seed")
    graph = durable(seen.groupBy("pattern", "token").agg(F.max(F.col("seed").cast("int")).alias("seed")))
    useful = graph.groupBy("pattern").agg(F.sum("seed").alias("n")).where(F.col("n") >= SEEDS).select("pattern")
    graph = durable(graph.join(useful, "pattern"))
    scores = graph.groupBy("token").agg(F.max("seed").cast("double").alias("score"))
    for _ in range(rounds):
        patterns = graph.join(scores, "token").groupBy("pattern").agg((F.sum("score") / (F.count("*") + 1)).alias("strength"))
        best = graph.join(patterns, "pattern").groupBy("token").agg(F.greatest(F.max("seed").cast("double"), F.max("strength")).alias("score"))
        scores = durable(best)
    strong = graph.join(scores, "token").groupBy("pattern").agg((F.sum("score") / (F.count("*") + 1)).alias("strength")).where(F.col("strength") >= CONFIDENT)
    found = seen.where("not seed").join(durable(strong.select("pattern")), "pattern")
    return found.groupBy("k1", "k2").agg(F.collect_set("span").alias("more"))


def find_personal(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Personal data of every whole text: doc_id, base and more spans.

    Spans are struct(start, kind, end) with kind a number into ``KINDS``; base
    spans come from the patterns alone, more are identifiers in contexts that
    elsewhere hold what the patterns find. Null and empty texts have none; rows
    that repeat id and text are treated alike; other columns are ignored.
    """
    scanned = _scanned(docs)
    none = F.array().cast("array<struct<start: int, kind: int, end: int>>")
    joined = scanned.select("k1", "k2", "doc_id", F.transform("seeds", _span).alias("base")).join(_discovered(scanned, rounds), ["k1", "k2"], "left")
    return joined.select("doc_id", F.array_sort("base").alias("base"), F.array_sort(F.coalesce("more", none)).alias("more"))


def digest(found: DataFrame) -> DataFrame:
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("bigint")
    return found.select(
        "doc_id", count(0).alias("n_email"), count(1).alias("n_ip"), count(2).alias("n_card"), count(3).alias("n_phone"),
        F.sha2(listed(F.col("base"), KINDS), 256).alias("base_sha256"), listed(F.concat("base", "more"), KINDS).alias("spans"),
    )
