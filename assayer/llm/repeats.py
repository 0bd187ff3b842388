"""Bytes covered by long strings that occur more than once.

The suffixes that matter are those that share 200 bytes with another. They are
found the way a difference-cover suffix sort finds equal prefixes, with a cover
that the text itself defines:

1. Sample: in each 200-byte window the leftmost smallest hash of a k-byte string is
   its sample position. Equal windows have theirs at the same offset, which is what
   a difference cover gives for any two suffixes, at a fortieth of the positions.
   Consecutive windows with one sample make a run. Samples are grouped by name
   (the hash of their k bytes); one that is alone rules its whole run out.
2. Where all runs of a name are alike, all their windows repeat.
3. Recursion on names: of the other runs ("mixed"), equal ones are settled too; one
   of each kind is named at full depth, 200 bytes at each position, from the names
   of its bytes by prefix sums.
4. Merge and compare neighbours: equal names of 200 bytes meet in one group. Only
   the runs without an equal then need their windows looked up.

Names are 64-bit fingerprints instead of ranks, so no order among unequal
suffixes is made, which nothing needs. Between the steps a bitmap of fixed size
keeps rows that cannot matter from being sent; exact joins follow.
"""

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from assayer.llm import words
from assayer.llm.spans import row_key
from assayer.session import durable

LENGTH, SAMPLE = 200, 96
BITS = 25
BLOCK = 1 << 19
_LOW = np.uint64((1 << 20) - 1)


class _Block:
    """Windows that start in one part of a text's bytes, and their runs."""

    def __init__(self, data: np.ndarray, valid: np.ndarray) -> None:
        up, down = words._powers(len(data))
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(words.VALUES[data] * up[: len(data)], out=sums[1:])
        self.sums, self.down = sums, down
        grams = (sums[SAMPLE:] - sums[:-SAMPLE]) * down[: len(data) - SAMPLE + 1]
        keys = (grams & ~_LOW) | np.arange(len(grams), dtype=np.uint64)
        width, size = LENGTH - SAMPLE + 1, 1
        while 2 * size <= width:
            keys = np.minimum(keys[:-size], keys[size:])
            size *= 2
        if size < width:
            keys = np.minimum(keys[: len(keys) - (width - size)], keys[width - size :])
        self.valid = valid[: len(keys)]
        change = np.ones(len(keys) + 1, bool)
        change[1:-1] = (keys[1:] != keys[:-1]) | (self.valid[1:] != self.valid[:-1])
        self.first = np.flatnonzero(change[:-1] & self.valid)
        self.last = np.flatnonzero(change[1:] & self.valid)
        at = (keys[self.first] & _LOW).astype(np.int64)
        self.name = words.mix(grams[at])

    def content(self) -> np.ndarray:
        ends = self.last + LENGTH
        return words.mix((self.sums[ends] - self.sums[self.first]) * self.down[self.first] + (ends - self.first).astype(np.uint64))

    def names(self, at: np.ndarray) -> np.ndarray:
        return words.mix((self.sums[at + LENGTH] - self.sums[at]) * self.down[at])


def _blocks(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, _Block]]:
    for low in range(0, max(len(data) - LENGTH + 1, 0), BLOCK):
        high = min(low + BLOCK, len(data) - LENGTH + 1)
        valid = np.ones(high - low, bool)
        ends = offsets[(offsets > low) & (offsets < high + LENGTH)]
        for end in ends[ends < len(data)].tolist():
            valid[max(0, end - LENGTH + 1 - low) : max(0, end - low)] = False
        if valid.any():
            yield low, _Block(data[low : high + LENGTH - 1], valid)


def _has(bitmap: np.ndarray, names: np.ndarray) -> np.ndarray:
    x = (names >> np.uint64(64 - BITS)).astype(np.int64)
    return (bitmap[x >> 3] >> (x & 7).astype(np.uint8)) & 1 == 1


def _samples(batch: pa.RecordBatch) -> pa.RecordBatch:
    data, offsets = words.text_bytes(batch.column("text"))
    found = [(b.name, b.content()) for _, b in _blocks(data, offsets)] or [(np.zeros(0, np.uint64),) * 2]
    return pa.record_batch([pa.array(np.concatenate(c).view(np.int64)) for c in zip(*found, strict=True)], names=["name", "content"])


def _identity(k1: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Number of a run by the row it is in and its place; chance equality only
    lets more through a bitmap."""
    return words.mix(k1.view(np.uint64) ^ words.mix(at.astype(np.uint64)))


def _rows(batch: pa.RecordBatch, offsets: np.ndarray, starts: np.ndarray) -> tuple[pa.Array, pa.Array, np.ndarray]:
    row = np.searchsorted(offsets, starts, side="right") - 1
    return batch.column("k1").take(pa.array(row)), batch.column("k2").take(pa.array(row)), starts - offsets[row]


def _runs(batch: pa.RecordBatch, bitmap: np.ndarray, mixed: bool) -> pa.RecordBatch:
    """Runs whose name is in the bitmap: name, row, place of the first window,
    windows, and for mixed ones content and identity."""
    data, offsets = words.text_bytes(batch.column("text"))
    found = []
    for low, b in _blocks(data, offsets):
        use = _has(bitmap, b.name)
        found.append((b.name[use], b.first[use] + low, (b.last - b.first + 1)[use], b.content()[use] if mixed else b.name[:0]))
    names, starts, counts, content = (np.concatenate(c) for c in zip(*found, (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)), strict=True))
    k1, k2, at = _rows(batch, offsets, starts)
    columns = [pa.array(names.view(np.int64)), k1, k2, pa.array(at.astype(np.int32)), pa.array(counts.astype(np.int32))]
    if mixed:
        columns += [pa.array(content.view(np.int64)), pa.array(_identity(k1.to_numpy(zero_copy_only=False), at).view(np.int64))]
    return pa.record_batch(columns, names=["name", "k1", "k2", "at", "windows", "content", "identity"][: len(columns)])


def _depths(batch: pa.RecordBatch, mixed: np.ndarray, wanted: np.ndarray, repeated: np.ndarray | None = None) -> pa.RecordBatch:
    """Names at full depth of the windows of the wanted mixed runs; with places
    once it is known which names may repeat."""
    data, offsets = words.text_bytes(batch.column("text"))
    names, starts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for low, b in _blocks(data, offsets):
        use = np.flatnonzero(_has(mixed, b.name))
        k1, _, place = _rows(batch, offsets, b.first[use] + low)
        use = use[_has(wanted, _identity(k1.to_numpy(zero_copy_only=False), place))]
        first, counts = b.first[use], (b.last - b.first + 1)[use]
        at = np.repeat(first, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        own = b.names(at)
        if repeated is not None:
            hold = _has(repeated, own)
            own, at = own[hold], at[hold]
        names.append(own)
        starts.append(at + low)
    name = pa.array(np.concatenate(names).view(np.int64))
    if repeated is None:
        return pa.record_batch([name], names=["name"])
    k1, k2, at = _rows(batch, offsets, np.concatenate(starts))
    return pa.record_batch([name, k1, k2, pa.array(at.astype(np.int32))], names=["name", "k1", "k2", "at"])


def _bitmap(names: DataFrame) -> np.ndarray:
    """Bitmap of the leading bits of names: ``2 ** BITS`` bits whatever the input."""
    x = F.shiftrightunsigned("name", 64 - BITS) + 1
    rows = names.select(x.alias("x")).groupBy(F.bitmap_bucket_number("x").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("x")).alias("bits")).collect()
    out = np.zeros(1 << (BITS - 3), np.uint8)
    for b, bits in rows:
        part = np.frombuffer(bytes(bits), np.uint8)
        out[(b - 1) * 4096 : (b - 1) * 4096 + len(part)] = part[: len(out) - (b - 1) * 4096]
    return out


def _cut(batch: pa.RecordBatch) -> pa.RecordBatch:
    rows = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": [], "kept": []}
    starts_of, counts_of = batch.column("starts"), batch.column("counts")
    for i, text in enumerate(batch.column("text")):
        raw = (text.as_py() or "").encode()
        kept, removed, spans = raw, 0, 0
        if starts_of[i].is_valid and len(starts_of[i]):
            starts, counts = starts_of[i].values.to_numpy(zero_copy_only=False), counts_of[i].values.to_numpy(zero_copy_only=False)
            edges = np.zeros(len(raw) + 1, np.int64)
            np.add.at(edges, starts, 1)
            np.add.at(edges, starts.astype(np.int64) + counts + LENGTH - 1, -1)
            gone = np.cumsum(edges)[:-1] > 0
            kept, removed = np.frombuffer(raw, np.uint8)[~gone].tobytes(), int(gone.sum())
            spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
        for name, value in zip(rows, (len(raw), removed, spans, hashlib.sha256(kept).hexdigest(), kept), strict=True):
            rows[name].append(value)
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
    return pa.record_batch([batch.column("doc_id"), *[pa.array(v, k) for v, k in zip(rows.values(), kinds, strict=True)]], names=["doc_id", *rows])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Each text's bytes without those that a repeated 200-byte string covers.

    A string counts as repeated when it starts at another place too, in this or
    another row; all occurrences go, judged on the input. Returns doc_id, n_bytes,
    n_removed, n_spans (maximal removed runs), kept_sha256 and kept (the remaining
    bytes, which may cut characters). Null texts count as empty, texts under 200
    bytes stay whole, rows that repeat id and text count as two places; other
    columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    texts = docs.select(*row_key(), "text")
    piece = {"most": BLOCK}
    samples = words.map_texts(texts.select("text"), _samples, "name bigint, content bigint", **piece)
    shared = durable(samples.groupBy("name").agg(F.count("*").alias("__n"), F.min("content").alias("low"), F.max("content").alias("high")).where("__n > 1").select("name", (F.col("low") != F.col("high")).alias("mixed")))
    alike, mixed = shared.where("not mixed").select("name"), _bitmap(shared.where("mixed"))
    placed = "name bigint, k1 bigint, k2 bigint, at int"
    runs = words.map_texts(texts, partial(_runs, bitmap=_bitmap(alike), mixed=False), f"{placed}, windows int", **piece)
    whole = runs.join(alike, "name").select("k1", "k2", "at", "windows")
    others = durable(words.map_texts(texts, partial(_runs, bitmap=mixed, mixed=True), f"{placed}, windows int, content bigint, identity bigint", **piece).drop("name"))
    kinds = durable(others.groupBy("content").agg(F.count("*").alias("__n"), F.min("identity").alias("name")))
    twins = others.join(kinds.where("__n > 1").select("content"), "content").select("k1", "k2", "at", "windows")
    depths = words.map_texts(texts, partial(_depths, mixed=mixed, wanted=_bitmap(kinds)), "name bigint", **piece)
    repeated = durable(depths.groupBy("name").agg(F.count("*").alias("__n")).where("__n > 1").select("name"))
    lone = partial(_depths, mixed=mixed, wanted=_bitmap(kinds.where("__n = 1")), repeated=_bitmap(repeated))
    single = words.map_texts(texts, lone, placed, **piece).join(repeated, "name").select("k1", "k2", "at", F.lit(1).alias("windows"))
    hits = whole.union(twins).union(single).groupBy("k1", "k2").agg(F.collect_list(F.struct("at", "windows")).alias("hits"))
    hits = durable(hits.select("k1", "k2", F.col("hits.at").alias("starts"), F.col("hits.windows").alias("counts")))
    rows = _bitmap(hits.select(F.col("k1").alias("name")))

    @F.pandas_udf("boolean")
    def may_hit(k1):  # texts without repeats need not be shuffled to learn so
        import pandas as pd

        return pd.Series(_has(rows, k1.to_numpy().view(np.uint64)))

    keyed = docs.select(*row_key(), "doc_id", "text").withColumn("__may", may_hit("k1"))
    joined = keyed.where("__may").join(hits, ["k1", "k2"], "left").select("doc_id", "starts", "counts", "text")
    none = F.lit(None).cast("array<int>")
    free = keyed.where("not __may").select("doc_id", none.alias("starts"), none.alias("counts"), "text")
    return words.map_texts(joined.union(free), _cut, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")
