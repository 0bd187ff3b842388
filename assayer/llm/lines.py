"""Line dedup by distinct-site spread: HyperLogLog sketches, exact counts near the threshold."""

from pyspark.sql import Column, DataFrame, functions as F

from assayer.session import durable

SITES, LOG_REGISTERS, BAND = 5, 8, 0.25


def _keys(*columns: Column | str) -> tuple[Column, Column]:
    """128 bits of hash over columns."""
    return F.xxhash64(*columns), F.xxhash64(F.lit(1), *columns)


def _lines(docs: DataFrame) -> DataFrame:
    """(k1, k2) of the row, doc_id, site, place and (h1, h2) of each line that is not blank."""
    k1, k2 = _keys("doc_id", "text")
    rows = docs.select(k1.alias("k1"), k2.alias("k2"), "doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("site"), F.posexplode(F.split("text", "\n")).alias("at", "line"))
    h1, h2 = _keys("line")
    return rows.withColumn("line", F.trim("line")).where("line != ''").select("k1", "k2", "doc_id", "site", "at", h1.alias("h1"), h2.alias("h2"))


def boilerplate(docs: DataFrame, sites: int = SITES) -> DataFrame:
    """Hashes (h1, h2) of lines on ``sites`` distinct sites or more, with the
    smallest doc_id that has the line.

    One HyperLogLog sketch per line, merged map-side and again after the shuffle.
    An estimate beyond a quarter of the threshold, which is four standard errors
    of a sketch of 256 registers, decides; lines nearer get an exact count of
    their distinct (line, site) rows.
    """
    lines = _lines(docs.select("doc_id", "source", "text"))
    spread = lines.groupBy("h1", "h2").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LOG_REGISTERS))).alias("about"), F.min("doc_id").alias("first"))
    wide = durable(spread.where(F.col("about") >= (1 - BAND) * sites))
    near = wide.where(F.col("about") <= (1 + BAND) * sites)
    pairs = lines.select("h1", "h2", "site").join(near.select("h1", "h2"), ["h1", "h2"]).distinct()
    exact = pairs.groupBy("h1", "h2").agg(F.count("*").alias("n")).where(F.col("n") >= sites).select("h1", "h2")
    sure = wide.where(F.col("about") > (1 + BAND) * sites).select("h1", "h2", "first")
    return durable(sure.union(near.join(exact, ["h1", "h2"]).select("h1", "h2", "first")))


def remove_boilerplate(docs: DataFrame, sites: int = SITES) -> DataFrame:
    """Documents without the lines that ``sites`` distinct sites or more share.

    ``source`` is the site; a null source is a site of its own. Lines are parted
    by line feeds and compared without outer blanks; blank lines are left alone.
    The document with the smallest doc_id that has such a line keeps it, so a
    document that others copy stays whole. Adds n_lines and n_removed and replaces
    text; columns of these names are replaced, others kept. A null text stays null
    with no lines. Rows that repeat id and text are treated alike; with null ids
    only, all rows count as the first document.
    """
    hits = (
        _lines(docs.select("doc_id", "source", "text")).join(boilerplate(docs, sites), ["h1", "h2"]).where(~F.col("doc_id").eqNullSafe(F.col("first")))
        .groupBy("k1", "k2").agg(F.collect_set("at").alias("__gone"))
    )
    k1, k2 = _keys("doc_id", "text")
    named = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    cut = docs.select(*named, F.split("text", "\n").alias("__lines"), k1.alias("k1__"), k2.alias("k2__")).drop("text")
    joined = cut.join(hits.select(F.col("k1").alias("k1__"), F.col("k2").alias("k2__"), "__gone"), ["k1__", "k2__"], "left")
    left = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), "__gone")
    kept = F.when(F.col("__gone").isNull(), F.col("__lines")).otherwise(F.transform(left, lambda i: F.get("__lines", i)))
    return joined.select(
        *[F.array_join(kept, "\n").alias("text") if c == "text" else F.col(c) for c in named],
        F.coalesce(F.when(F.col("__lines").isNotNull(), F.size("__lines")), F.lit(0)).cast("bigint").alias("n_lines"),
        F.coalesce(F.when(F.col("__gone").isNotNull(), F.size("__gone")), F.lit(0)).cast("bigint").alias("n_removed"),
    )
