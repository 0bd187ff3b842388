"""Near-duplicate documents by SuperMinHash, banding, verification and union-find."""

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from assayer.llm import words
from assayer.llm.components import components
from assayer.session import durable

HASHES, BANDS = 252, 42
CHUNK, PIECE = 1 << 15, 1 << 20


def superminhash(items: np.ndarray, owner: np.ndarray, texts: int, hashes: int = HASHES) -> np.ndarray:
    """Signatures of ``texts`` sets, one row each, from distinct items and the set each is in.

    An item draws a random permutation of the registers; at step j it puts
    (j, random number) into register perm[j]. Step j gives only larger values
    than the steps before, so a set is done at the first step after which all its
    registers are filled: large sets stop after a few steps. All sets advance in
    step, which keeps the work in whole arrays. Registers of an empty set stay at
    the largest value.
    """
    out = np.full(texts * hashes, np.iinfo(np.uint64).max)
    for low in range(0, len(items), CHUNK):
        _draw(items[low : low + CHUNK], owner[low : low + CHUNK], out, hashes)
    return out.reshape(texts, hashes)


def _draw(items: np.ndarray, owner: np.ndarray, out: np.ndarray, hashes: int) -> None:
    first = int(owner[0])
    owner = (owner - first).astype(np.int64)
    texts = int(owner[-1]) + 1
    part = np.full(texts * hashes, np.iinfo(np.uint64).max)
    filled = np.zeros(texts * hashes, bool)
    state = words.mix(items ^ np.uint64(0x5851F42D4C957F2D))
    perm = np.tile(np.arange(hashes, dtype=np.uint8 if hashes <= 256 else np.uint16), (len(items), 1))
    for step in range(hashes):
        state = words.mix(state + np.uint64(0x9E3779B97F4A7C15))
        rows = np.arange(len(state))
        pick = step + (((state & np.uint64(0xFFFFFFFF)) * np.uint64(hashes - step)) >> np.uint64(32)).astype(np.int64)
        register = perm[rows, pick].astype(np.int64)
        perm[rows, pick] = perm[:, step]
        at = owner * hashes + register
        new = ~filled[at]
        at = at[new]
        np.minimum.at(part, at, np.uint64(step << 32) | (state[new] >> np.uint64(32)))
        filled[at] = True
        done = filled.reshape(texts, hashes).all(axis=1)
        if done.any():
            go = ~done[owner]
            if not go.any():
                break
            owner, state, perm = owner[go], state[go], perm[go]
    low = first * hashes
    np.minimum(out[low : low + len(part)], part, out=out[low : low + len(part)])


def _sets(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray, int]:
    data, offsets = words.text_bytes(column)
    starts, ends, bounds = words.find_words(data, offsets, words.NOT_SPACE)
    shingles, owner = words.shingle_hashes(words.word_hashes(data, starts, ends), bounds, size)
    return *words.distinct_per_text(shingles, owner), len(offsets) - 1


def _signed(batch: pa.RecordBatch, size: int) -> pa.RecordBatch:
    items, owner, texts = _sets(batch.column(1), size)
    rows = BANDS and HASHES // BANDS
    signature = superminhash(items, owner, texts).reshape(texts, BANDS, rows)
    keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (texts, BANDS))
    for i in range(rows):
        keys = words.mix(keys * np.uint64(0x9FB21C651E98DF25) + signature[:, :, i])
    counts = np.bincount(owner, minlength=texts)
    whole = np.zeros((texts, 2), np.uint64)
    for i, salt in enumerate((0x2545F4914F6CDD1D, 0x632BE59BD9B4E019)):
        np.add.at(whole[:, i], owner, words.mix(items ^ np.uint64(salt)))
    return pa.record_batch(
        [
            batch.column(0), pa.array(counts.astype(np.int64)), pa.array(whole[:, 0].view(np.int64)), pa.array(whole[:, 1].view(np.int64)),
            pa.ListArray.from_arrays(pa.array(np.arange(texts + 1, dtype=np.int32) * BANDS), pa.array(np.ascontiguousarray(keys).reshape(-1).view(np.int64))),
        ],
        names=["doc_id", "n_shingles", "s0", "s1", "bands"],
    )


def _shingled(batch: pa.RecordBatch, size: int) -> pa.RecordBatch:
    items, owner, texts = _sets(batch.column(1), size)
    ends = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=texts)))).astype(np.int32)
    return pa.record_batch([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(items.view(np.int64)))], names=["doc_id", "items"])


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """Groups of documents whose sets of ``size``-word shingles are alike.

    Words are runs of bytes other than white space, A-Z in lower case. Two
    documents are linked when 100 * |intersection| >= percent * |union| on their
    full sets; a group is what links reach. Returns doc_id, n_shingles,
    component_id (smallest doc_id of the group) and kept (the document with that
    id). Documents without words, null texts included, have an empty set and are
    linked with nothing. Rows with a null doc_id are not linked and kept; rows
    that share a doc_id count as one document. Other columns are ignored.

    Equal sets are merged first. Bands of six of 252 SuperMinHash registers give
    candidates: a pair at 0.8 shares no band with a probability of 3e-6, one at 0.85
    of 3e-9, while texts that share a passage only seldom meet. A bucket is never
    paired out: its most central document is the pivot, all others are compared
    with it, and what that leaves unconnected goes through ``_beside_pivots``.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    signed = durable(words.map_texts(docs, partial(_signed, size=size), "doc_id bigint, n_shingles bigint, s0 bigint, s1 bigint, bands array<bigint>", PIECE))
    named = signed.where("n_shingles > 0 and doc_id is not null")
    equal = durable(named.groupBy("s0", "s1").agg(F.min("doc_id").alias("node")))
    first = equal.select(F.col("node").alias("doc_id"), "s0", "s1")
    nodes = named.join(first, ["doc_id", "s0", "s1"], "left_semi").select(F.col("doc_id").alias("node"), F.col("n_shingles").alias("n"), F.explode("bands").alias("bucket"))
    full = durable(nodes.groupBy("bucket").agg(F.count("*").alias("__rows")).where("__rows > 1"))
    members = durable(nodes.join(full, "bucket"))
    central = members.groupBy("node").agg(F.sum("__rows").alias("__met"))
    members = members.select("bucket", "node", "n").distinct()
    texts = docs.select("doc_id", "text").join(central.select(F.col("node").alias("doc_id")), "doc_id", "left_semi")
    sets = durable(words.map_texts(texts, partial(_shingled, size=size), "doc_id bigint, items array<bigint>", PIECE))
    chosen = members.join(central, "node").groupBy("bucket").agg(F.max_by(F.struct("node", "n"), F.struct("__met", -F.col("node"))).alias("p"))
    pivots = durable(chosen.select("bucket", F.col("p.node").alias("pivot"), F.col("p.n").alias("pivot_n")))
    stars = durable(members.join(pivots, "bucket").where("node != pivot").select("bucket", "node", "n", "pivot", "pivot_n"))
    fits = 100 * F.least("n", "pivot_n") >= percent * F.greatest("n", "pivot_n")
    found = components(_alike(stars.where(fits).select(F.col("node").alias("a"), F.col("pivot").alias("b")), sets, percent))
    rooted = _moved(stars.withColumn("root", F.col("node")).withColumn("pivot_root", F.col("pivot")), found)
    rooted = durable(_moved(rooted, found, "pivot_root"))
    several = rooted.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("bucket")
    around = rooted.join(several, "bucket").select("pivot", "pivot_n", "pivot_root", "node", "n", "root").distinct()
    more = _alike(_beside_pivots(around, sets, percent / 100), sets, percent)
    found = components(found.select(F.col("root").alias("a"), F.col("node").alias("b")).union(more))
    grouped = signed.select("doc_id", "n_shingles", "s0", "s1").join(equal, ["s0", "s1"], "left").join(found, "node", "left")
    group = F.when(F.col("n_shingles") > 0, F.coalesce("root", "node")).otherwise(F.col("doc_id"))
    group = F.when(F.col("doc_id").isNotNull(), group)
    return grouped.select("doc_id", "n_shingles", group.alias("component_id"), F.col("doc_id").eqNullSafe(group).alias("kept"))


def _alike(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that their full sets confirm."""
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    both = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("items").alias("x")), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("items").alias("y")), "b")
    same = F.col("same")
    return both.withColumn("same", F.size(F.array_intersect("x", "y"))).where(100 * same >= percent * (F.size("x") + F.size("y") - same)).select("a", "b")


def _beside_pivots(around: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) of documents around one pivot, in different components, that
    may be alike.

    Let d be the number of shingles in which a document differs from the pivot.
    Two sets of n and m shingles are alike when they differ in at most
    D = (1 - t) / (1 + t) * (n + m), so their differences from the pivot share
    (d + e - D) / 2 or more. A prefix filter finds such pairs without meeting the
    others: differences are ordered by how rare they are around the pivot, and two
    lists that share s elements have one in common in their first d - s + 1 and
    e - s + 1. What remains after an element's place bounds the rest. A document
    not connected with the pivot differs from it in more than D, which bounds s
    from below; lists that need share nothing meet under one extra element.
    """
    both = around.join(sets.select(F.col("doc_id").alias("node"), F.col("items").alias("x")), "node").join(sets.select(F.col("doc_id").alias("pivot"), F.col("items").alias("y")), "pivot")
    delta = F.concat(F.array_except("x", "y"), F.array_except("y", "x"))
    most, apart = F.col("n") * ((1 - least) / least), (F.col("n") * least + F.col("pivot_n")) * ((1 - least) / (1 + least))
    lists = both.withColumn("delta", delta).withColumn("d", F.size("delta"))
    share = F.when(F.col("root") == F.col("pivot_root"), F.ceil((F.col("d") + apart - most) / 2 - 1e-6)).otherwise(F.ceil(F.col("d") - most - 1e-6))
    lists = lists.withColumn("s", share).select("pivot", "node", "n", "root", "d", "s", "delta")
    rows = durable(lists.select("pivot", "node", "n", "root", "d", "s", F.explode("delta").alias("element")))
    rare = rows.groupBy("pivot", "element").agg(F.count("*").alias("__df")).where("__df > 1")
    placed = rows.join(rare, ["pivot", "element"], "left")
    place = F.row_number().over(Window.partitionBy("pivot", "node").orderBy(F.coalesce("__df", F.lit(1)), "element"))
    prefix = placed.withColumn("at", place).where((F.col("at") <= F.col("d") - F.greatest("s", F.lit(1)) + 1) & F.col("__df").isNotNull()).select("pivot", "element", "node", "n", "root", "d", "at")
    free = lists.where("s <= 0").select("pivot", F.lit(0).cast("bigint").alias("element"), "node", "n", "root", "d", F.lit(1).alias("at"))
    left = durable(prefix.union(free))
    right = left.select("pivot", "element", *[F.col(c).alias(f"{c}_") for c in ("node", "n", "root", "d", "at")])
    needed = F.col("d") + F.col("d_") - (F.col("n") + F.col("n_")) * ((1 - least) / (1 + least)) - 1e-6
    possible = 2 * (1 + F.least(F.col("d") - F.col("at"), F.col("d_") - F.col("at_"))) >= needed
    return left.join(right, ["pivot", "element"]).where((F.col("node") < F.col("node_")) & (F.col("root") != F.col("root_")) & possible).select(F.col("node").alias("a"), F.col("node_").alias("b"))


def _moved(df: DataFrame, step: DataFrame, column: str = "root") -> DataFrame:
    """Roots in a column brought up to date."""
    to = step.select(F.col("node").alias(column), F.col("root").alias("__to"))
    return df.join(to, column, "left").withColumn(column, F.coalesce("__to", column)).select(*df.columns)


def keep_first(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """Documents without the near-duplicates of a document with a smaller id.

    Rows that repeat the id of a kept document stay."""
    dropped = near_duplicates(docs, size, percent).where("not kept").select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)
