"""How the sources of a language differ in their use of words, in exact numbers.

CountVectorizer learns the terms of each language that at least ``least``
documents hold, without a bound on their number, and turns documents into sparse
vectors. Each task sums its vectors by source, as a summarizer does, and holds only
terms that occur; pairs of sources are compared block by block of the vocabulary
from the sparse sums.

A language whose vocabulary is over ``PART`` terms is learnt in parts, each of the
terms with one remainder of their hash, so that neither a vectorizer nor a
vocabulary grows with the corpus.
"""

from collections import Counter
from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from assayer.llm import words
from assayer.session import checkpoint_folder

#: What each byte counts as: letters in lower case, bytes beyond ASCII, else a blank.
TERM_BYTES = np.where(np.arange(256) < 128, 32, np.arange(256)).astype(np.uint8)
TERM_BYTES[97:123] = TERM_BYTES[65:91] = np.arange(97, 123)
LEAST, SCALE, ADDED, BEST = 30, 1_000_000_000, 5, 50
PART, BLOCK, TILE = 1 << 18, 512, 256
#: Terms or entries of group sums that a task holds before it passes them on.
HELD = 1 << 20


def _spaced(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Texts with a blank for each byte that is in no term."""
    data, offsets = words.text_bytes(batch.column("text"))
    text = pa.Array.from_buffers(pa.large_string(), batch.num_rows, [None, pa.py_buffer(offsets), pa.py_buffer(TERM_BYTES[data])])
    return pa.record_batch([batch.column("lang"), batch.column("source"), text.cast(pa.string())], names=["lang", "source", "text"])


def spaced_texts(docs: DataFrame, folder: str) -> tuple[DataFrame, dict[str, int]]:
    """(lang, source, text, part_of) with the terms of each text between blanks, a
    folder per language; and the number of each language in part_of.

    Terms are runs of ASCII letters and characters beyond ASCII, only A-Z
    lower-cased; nulls are ''.
    """
    lang, source = (F.coalesce(F.col(n).cast("string"), F.lit("")).alias(n) for n in ("lang", "source"))
    docs = docs.select(lang, source, F.col("text").cast("string").alias("text"))
    langs = sorted(r.lang for r in docs.select("lang").distinct().collect())
    numbers = docs.sparkSession.createDataFrame(list(enumerate(langs)), "part_of int, lang string")
    words.map_texts(docs, _spaced, "lang string, source string, text string").join(F.broadcast(numbers), "lang").write.partitionBy("part_of").parquet(f"{folder}/texts")
    return docs.sparkSession.read.schema("lang string, source string, text string, part_of int").parquet(f"{folder}/texts"), {x: i for i, x in enumerate(langs)}


def _group_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of sparse vectors (source, indices, values) by source and index, over as
    many vectors as ``HELD`` sums allow."""
    numbers: dict[str, int] = {}
    keys, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def passed() -> pa.RecordBatch:
        own = pa.array(list(numbers)).take(pa.array(keys >> 32))
        return pa.record_batch([own, pa.array(keys & 0xFFFFFFFF), pa.array(sums)], names=["source", "place", "count"])

    for batch in batches:
        indices = batch.column("indices")
        owner = np.array([numbers.setdefault(x, len(numbers)) for x in batch.column("source").to_pylist()], np.int64)
        sizes = pa.compute.list_value_length(indices).to_numpy(zero_copy_only=False)
        found = np.repeat(owner, sizes) << 32 | indices.flatten().to_numpy(zero_copy_only=False)
        counts = batch.column("counts").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        found, counts = np.concatenate([keys, found]), np.concatenate([sums, counts])
        order = np.argsort(found, kind="stable")
        found = found[order]
        first = np.flatnonzero(np.r_[True, found[1:] != found[:-1]]) if len(found) else np.zeros(0, np.int64)
        keys, sums = found[first], np.add.reduceat(counts[order], first) if len(first) else counts
        if len(keys) > HELD:
            yield passed()
            keys, sums = keys[:0], sums[:0]
            numbers.clear()
    if len(keys):
        yield passed()


def _term_spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, term, held): documents that hold each term, counted over as many as
    ``HELD`` terms allow."""
    counts: dict[str, Counter] = {}

    def passed() -> Iterator[pa.RecordBatch]:
        for lang, own in counts.items():
            terms = pa.array(list(own), pa.binary()).cast(pa.string())
            yield pa.record_batch([pa.repeat(lang, len(own)), terms, pa.array(list(own.values()), pa.int64())], names=["lang", "term", "held"])

    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            counts.setdefault(lang, Counter()).update(set(text.encode().split()))
        if sum(map(len, counts.values())) > HELD:
            yield from passed()
            counts.clear()
    yield from passed()


def vectorize(texts: DataFrame, langs: dict[str, int], folder: str, least: int = LEAST, part: int = PART) -> tuple[DataFrame, DataFrame] | None:
    """Vocabulary (lang, term, code) and sums of document vectors (lang, source, code, count).

    None if no term is in ``least`` documents of its language. Codes number the
    terms of a language; both tables are written below ``folder``.
    """
    spark = texts.sparkSession
    found = texts.select("part_of", "lang", "source", F.array_remove(F.split("text", " "), "").alias("terms"))
    spread = words.small_batches(texts.select("lang", "text")).mapInArrow(_term_spread, "lang string, term string, held bigint").groupBy("lang", "term").agg(F.sum("held").alias("held")).where(F.col("held") >= least)
    sizes = spread.groupBy("lang").agg(F.count("*").alias("kept")).orderBy("lang").collect()
    for lang, kept in sizes:
        parts = -(-kept // part)
        for number in range(parts):
            own = found.where(F.col("part_of") == langs[lang]).select("source", "terms")
            if parts > 1:
                own = own.withColumn("terms", F.filter("terms", lambda t: F.pmod(F.xxhash64(t), F.lit(parts)) == number))  # noqa: B023
            model = CountVectorizer(inputCol="terms", outputCol="vector", minDF=float(least), vocabSize=2**31 - 1).fit(own)
            vector = F.unwrap_udt(F.col("vector"))
            vectors = model.transform(own).select("source", vector["indices"].alias("indices"), vector["values"].alias("counts"))
            sums = words.small_batches(vectors).mapInArrow(_group_sums, "source string, place bigint, count bigint")
            sums.select(F.lit(lang).alias("lang"), "source", (F.col("place") * parts + number).alias("code"), "count").write.mode("append").parquet(f"{folder}/partial")
            names = spark.createDataFrame([(lang, t, i * parts + number) for i, t in enumerate(model.vocabulary)], "lang string, term string, code bigint")
            names.write.mode("append").parquet(f"{folder}/terms")
    if not sizes:
        return None
    partial = spark.read.parquet(f"{folder}/partial")
    return spark.read.parquet(f"{folder}/terms"), partial.groupBy("lang", "source", "code").agg(F.sum("count").alias("count"))


def _share(count: Column, total: Column, size: Column) -> Column:
    """1 + floor(SCALE * (count + ADDED) / (total + ADDED * size)), exact."""
    wide = lambda c: c.cast("decimal(20,0)")
    top = F.lit(SCALE).cast("decimal(10,0)") * (wide(count) + F.lit(ADDED))
    below = (wide(total) + F.lit(ADDED) * wide(size)).cast("decimal(38,0)")
    return F.call_function("div", top.cast("decimal(38,0)"), below).cast("bigint") + 1


def _tile_pairs(rows: pd.DataFrame, size: int) -> pd.DataFrame:
    """Sums of |p - q| over one block of terms, for the pairs of two tiles of sources.

    Only terms that occur are looked at: a source's own terms against what all
    others give a term they lack, then the others' own terms as a correction.
    """
    first = rows.iloc[0]
    width, left_tile, right_tile = int(first.width), int(first.left_tile), int(first.right_tile)
    rows = rows.sort_values(["member", "place"], kind="stable")
    member, heads = np.unique(rows.member.to_numpy(), return_index=True)
    ends = np.r_[heads[1:], len(rows)]
    lacking = rows.lacking.to_numpy()[heads]
    # a row without a term stands for a source that has none in this block
    place, p = rows.place.to_numpy(), rows.p.to_numpy()
    held = place >= 0
    tile = member // size
    out = []
    for i in np.flatnonzero(tile == left_tile):
        others = np.flatnonzero((tile == right_tile) & (member > member[i]))
        if not len(others):
            continue
        own = slice(heads[i], ends[i])
        at, mine = place[own][held[own]], p[own][held[own]]
        dense = np.full(width, lacking[i], np.int64)
        dense[at] = mine
        base = np.abs(mine[:, None] - lacking[others][None, :]).sum(axis=0) + (width - len(at)) * np.abs(lacking[i] - lacking[others])
        low, high = heads[others[0]], ends[others[-1]]
        here = dense[np.maximum(place[low:high], 0)]
        theirs = np.repeat(lacking[others], ends[others] - heads[others])
        change = np.where(held[low:high], np.abs(here - p[low:high]) - np.abs(here - theirs), 0)
        total = base + np.add.reduceat(change, heads[others] - low)
        out.append(pd.DataFrame({"lang": first.lang, "a": member[i], "b": member[others], "value": total}))
    return pd.concat(out) if out else pd.DataFrame({"lang": pd.Series(dtype=str), "a": pd.Series(dtype="int64"), "b": pd.Series(dtype="int64"), "value": pd.Series(dtype="int64")})


def audit(docs: DataFrame, least: int = LEAST, best: int = BEST, part: int = PART, block: int = BLOCK, tile: int = TILE) -> DataFrame:
    """Differences between sources of a language, and each source's own terms.

    Rows (lang, source, kind, item, value, rank). ``pair``: item is each other
    source of the language, value the sum over its kept terms of the difference of
    the two sources' shares, largest first. ``term``: item is a kept term that the
    source uses more than the language does, value the surplus, the ``best`` first
    ones. Shares are parts of a thousand million with ``ADDED`` on every count.
    Ties go by the UTF-8 of item. Null text, lang and source are ''; repeated rows
    count as rows; a source without terms is compared like any other; a language
    without kept terms has pairs of value 0; an empty table gives no rows.
    """
    spark = docs.sparkSession
    folder = f"{checkpoint_folder(spark)}/divergence-{uuid4().hex}"
    texts, langs = spaced_texts(docs, folder)
    if not langs:
        return spark.createDataFrame([], "lang string, source string, kind string, item string, value bigint, rank int")
    groups = texts.select("lang", "source").distinct()
    groups.withColumn("member", F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("bigint") - 1).write.parquet(f"{folder}/groups")
    groups = spark.read.parquet(f"{folder}/groups")
    vectors = vectorize(texts, langs, folder, least, part)
    others = groups.alias("a").join(groups.alias("b"), F.expr("a.lang = b.lang AND a.member <> b.member"))
    others = others.select("a.lang", "a.source", F.col("b.source").alias("item"), F.least("a.member", "b.member").alias("a"), F.greatest("a.member", "b.member").alias("b"))
    if vectors is None:
        return _ranked(others.select("lang", "source", F.lit("pair").alias("kind"), "item", F.lit(0).cast("bigint").alias("value")))
    vocabulary, sums = vectors
    sums.write.parquet(f"{folder}/sums")
    sums = spark.read.parquet(f"{folder}/sums")
    sizes = vocabulary.groupBy("lang").agg(F.count("*").alias("size"))
    totals = groups.join(sums.groupBy("lang", "source").agg(F.sum("count").alias("total")), ["lang", "source"], "left").na.fill({"total": 0}).join(F.broadcast(sizes), "lang")
    whole = sums.groupBy("lang", "code").agg(F.sum("count").alias("all"))
    everything = totals.groupBy("lang").agg(F.sum("total").alias("everything"), F.max("size").alias("size"))
    whole = whole.join(F.broadcast(everything), "lang").select("lang", "code", _share(F.col("all"), F.col("everything"), F.col("size")).alias("q"))
    shares = sums.join(totals, ["lang", "source"]).withColumn("p", _share(F.col("count"), F.col("total"), F.col("size")))
    shares.join(whole, ["lang", "code"]).select("lang", "source", "member", "code", "p", "q").write.parquet(f"{folder}/shares")
    shares = spark.read.parquet(f"{folder}/shares")
    pairs = _pairs(shares, totals, vocabulary, block, tile)
    valued = others.join(pairs, ["lang", "a", "b"], "left").select("lang", "source", F.lit("pair").alias("kind"), "item", F.coalesce("value", F.lit(0).cast("bigint")).alias("value"))
    own = shares.where("p > q").join(vocabulary, ["lang", "code"])
    own = own.select("lang", "source", F.lit("term").alias("kind"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    return _ranked(valued).unionByName(_ranked(own, best))


def _pairs(shares: DataFrame, totals: DataFrame, vocabulary: DataFrame, block: int, tile: int) -> DataFrame:
    """(lang, a, b, value) with a < b, by blocks of ``block`` codes and tiles of ``tile`` sources.

    Broadcast are tables with a row per language, or per language and block.
    """
    number = F.floor(F.col("code") / block)
    placed = vocabulary.select("lang", "code", number.alias("block"), (F.row_number().over(Window.partitionBy("lang", number).orderBy("code")) - 1).cast("bigint").alias("place"))
    widths = placed.groupBy("lang", "block").agg(F.count("*").alias("width"))
    empty = totals.select("lang", "member", _share(F.lit(0), F.col("total"), F.col("size")).alias("lacking"))
    nothing = F.lit(-1).cast("bigint")
    held = shares.select("lang", "member", "code", "p").join(placed, ["lang", "code"]).select("lang", "member", "block", "place", "p")
    blank = empty.join(F.broadcast(widths), "lang").select("lang", "member", "block", nothing.alias("place"), nothing.alias("p"))
    rows = held.unionByName(blank).join(empty, ["lang", "member"]).join(F.broadcast(widths), ["lang", "block"])
    tiles = totals.groupBy("lang").agg(F.floor(F.max("member") / tile).alias("last_tile"))
    own = F.floor(F.col("member") / tile)
    rows = rows.join(F.broadcast(tiles), "lang").select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("last_tile"))).alias("other"))
    keys = ["lang", "block", F.least(own, "other").alias("left_tile"), F.greatest(own, "other").alias("right_tile")]
    rows = rows.select(*keys, "member", "place", "p", "lacking", "width")
    sums = rows.groupBy("lang", "block", "left_tile", "right_tile").applyInPandas(lambda found: _tile_pairs(found, tile), "lang string, a bigint, b bigint, value bigint")
    return sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def _ranked(rows: DataFrame, best: int | None = None) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = rows.withColumn("rank", F.row_number().over(order))
    return ranked if best is None else ranked.where(F.col("rank") <= best)
