"""Document fingerprints by context-triggered piecewise hashing."""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.functions import pandas_udf

from assayer.llm import words

WINDOW, SMALLEST, LENGTH, GRAM = 7, 3, 64, 7
ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
BLOCK = 1 << 20
_FACTORS = [int(x) for x in (np.arange(1, WINDOW + 1, dtype=np.uint64) * np.uint64(0x9E3779B1)) & np.uint64(0xFFFFFFFF)]


def _rolling(data: np.ndarray) -> np.ndarray:
    """Hash of the last ``WINDOW`` bytes at each place; before the start they are 0."""
    values = (words.VALUES >> np.uint64(32)).astype(np.uint32)[data]
    out = np.zeros(len(data), np.uint32)
    for back, factor in enumerate(_FACTORS[: len(data)]):
        out[back:] += values[: len(data) - back] * np.uint32(factor)
    out ^= out >> np.uint32(15)
    out *= np.uint32(0x85EBCA6B)
    return out ^ (out >> np.uint32(13))


def _ends(data: np.ndarray, size: int) -> np.ndarray:
    """Places after which a chunk ends: the rolling hash is size - 1 modulo size."""
    parts = []
    for low in range(0, len(data), BLOCK):
        before = min(low, WINDOW - 1)
        rolled = _rolling(data[low - before : low + BLOCK])[before:]
        parts.append(np.flatnonzero(rolled % np.uint32(size) == size - 1) + low + 1)
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def _signature(data: np.ndarray, ends: np.ndarray) -> str:
    """A letter per chunk; chunks beyond the last letter are hashed as one."""
    ends = ends[: LENGTH - 1]
    if not len(ends) or ends[-1] < len(data):
        ends = np.append(ends, len(data))
    starts = np.concatenate(([0], ends[:-1]))
    if len(data) <= BLOCK:
        hashes = words.span_hashes(data, starts, ends)
    else:
        hashes = np.array([words.long_hash(data[a:b]) for a, b in zip(starts, ends, strict=True)], np.uint64)
    return ALPHABET[(hashes & np.uint64(63)).astype(np.int64)].tobytes().decode()


def fingerprint(raw: bytes) -> str:
    """``size:signature:signature at twice the size`` of a text's bytes.

    The chunk size is 3 doubled until 64 chunks can be expected to cover the text,
    halved while that gives fewer than 32.
    """
    data = np.frombuffer(raw, np.uint8)
    if not len(data):
        return f"{SMALLEST}::"
    size = SMALLEST
    while size * LENGTH < len(data):
        size *= 2
    ends, double = _ends(data, size), None
    while size > SMALLEST and len(ends) + 1 < LENGTH // 2:
        size, double = size // 2, ends
        ends = _ends(data, size)
    if double is None:
        double = _ends(data, 2 * size)
    return f"{size}:{_signature(data, ends)}:{_signature(data, double)}"


def _padded(signatures: list[str]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(s) for s in signatures], np.int64)
    table = np.frombuffer("".join(s.ljust(LENGTH + 1, " ") for s in signatures).encode(), np.uint8)
    return table.reshape(len(signatures), LENGTH + 1)[:, :LENGTH], np.minimum(lengths, LENGTH)


def _shared(a: np.ndarray, la: np.ndarray, b: np.ndarray, lb: np.ndarray) -> np.ndarray:
    """Whether two signatures have ``GRAM`` letters in a row in common; shorter ones pass."""
    def grams(x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), LENGTH - GRAM + 1), np.uint64)
        for i in range(GRAM):
            out = out * np.uint64(256) + x[:, i : i + out.shape[1]]
        return out

    ga, gb = np.sort(grams(a), axis=1), grams(b)
    ok = np.zeros(len(a), bool)
    for i in range(gb.shape[1]):
        ok |= ((ga == gb[:, i : i + 1]) & (i + GRAM <= lb)[:, None]).any(axis=1)
    return ok | (np.minimum(la, lb) < GRAM)


def signature_likeness(left: list[str], right: list[str]) -> np.ndarray:
    """1 - edit distance (insertions and deletions) / letters, pair by pair.

    The longest common subsequence of all pairs at once: one 64-bit word per pair
    holds a row of the table, one step per letter of the right side.
    """
    out = np.zeros(len(left))
    for low in range(0, len(left), 4096):
        a, la = _padded(left[low : low + 4096])
        b, lb = _padded(right[low : low + 4096])
        rows = np.arange(len(a))
        where = np.zeros((len(a), 128), np.uint64)
        for i in range(LENGTH):
            use = i < la
            where[rows[use], a[use, i]] |= np.uint64(1 << i)
        state = np.full(len(a), np.uint64(0xFFFFFFFFFFFFFFFF))
        for i in range(LENGTH):
            match = np.where(i < lb, where[rows, b[:, i]], np.uint64(0))
            hit = state & match
            state = np.where(i < lb, (state + hit) | (state - hit), state)
        common = np.bitwise_count(~state)
        total = la + lb
        same = np.array([x == y for x, y in zip(left[low : low + 4096], right[low : low + 4096], strict=True)], bool)
        near = np.where(total > 0, 2 * common / np.maximum(total, 1), 1.0)
        out[low : low + len(a)] = np.where(same, 1.0, np.where(_shared(a, la, b, lb), near, 0.0))
    return out


def likeness(left: list[str], right: list[str]) -> np.ndarray:
    """Likeness, 0 to 1, of fingerprints: the best of the signatures with equal
    chunk size; 0 where sizes are more than a doubling apart, 1 where equal."""
    cut = [(x.split(":"), y.split(":")) for x, y in zip(left, right, strict=True)]
    out = np.array([1.0 if x == y else 0.0 for x, y in zip(left, right, strict=True)], float)
    jobs = []
    for i, (x, y) in enumerate(cut):
        if out[i] == 1:
            continue
        for dx in (0, 1):
            for dy in (0, 1):
                if int(x[0]) << dx == int(y[0]) << dy:
                    jobs.append((i, x[1 + dx], y[1 + dy]))
    if jobs:
        at, a, b = zip(*jobs, strict=True)
        np.maximum.at(out, np.array(at), signature_likeness(list(a), list(b)))
    return out


FIELDS = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by bucket and id; a guest is the first document of the next bucket."""
    before = None

    def flush(pairs: list) -> pa.RecordBatch:
        prints = [fingerprint(x.encode()) for _, x, _ in pairs]
        following = [fingerprint(y.encode()) for _, _, y in pairs[-1:]]
        linked = all(pairs[i][2] is pairs[i + 1][1] for i in range(len(pairs) - 1))
        nexts = [*prints[1:], *following] if linked else [fingerprint(y.encode()) for _, _, y in pairs]
        edited = [edit(x, y).encode() for _, x, y in pairs]
        own = [fingerprint(e) for e in edited]
        columns = [
            [i for i, _, _ in pairs], [len(x) for _, x, _ in pairs], [hashlib.sha256(e).hexdigest() for e in edited], prints, own,
            likeness(prints, own), likeness(prints, nexts),
        ]
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
        return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[f.split()[0] for f in FIELDS.split(", ")])

    pairs, size = [], 0
    for batch in batches:
        columns = [batch.column(n).to_pylist() for n in ("bucket", "guest", "doc_id", "text")]
        for bucket, guest, doc_id, text in zip(*columns, strict=True):
            text = text or ""
            if before is not None and before[0] == bucket:
                pairs.append((before[1], before[2], text))
                size += len(text)
            before = None if guest else (bucket, doc_id, text)
            if size > 4 << 20 or len(pairs) >= 2000:
                yield flush(pairs)
                pairs, size = [], 0
    if pairs:
        yield flush(pairs)


def edit(text: str, following: str) -> str:
    """The last quarter of the characters replaced by the first of another text."""
    quarter = len(text) // 4
    return text[: len(text) - quarter] + following[:quarter]


def fingerprints(docs: DataFrame, rows: int = 4096) -> DataFrame:
    """Fingerprint of every text and of its edited text, compared with each other
    and with the next document by ascending doc_id (after the last, the first).

    Null texts count as empty, null ids come first, rows with one id are ordered
    by text. A single document is its own next one; an empty table gives none.
    Other columns are ignored. Fingerprints are ``fingerprint``.

    Texts are shuffled once: ids are cut into buckets of about ``rows`` rows by
    approximate quantiles, each bucket is read in order, and the first document
    of a bucket is sent to the one before as a guest.
    """
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(1 << 63))).alias("doc_id"), F.col("doc_id").isNull().alias("absent"), "text")
    ids = texts.select("doc_id")
    count = ids.count()
    if not count:
        return spark.createDataFrame([], FIELDS)
    parts = count // rows + 1
    edges = np.unique(np.array(ids.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)] or [0.5], max(1000, 4 * parts))).first()[0], np.int64))

    @pandas_udf(T.LongType())
    def bucket(ids):  # the edges number a few thousandths of the rows
        import pandas as pd

        return pd.Series(np.searchsorted(edges, ids.to_numpy(), side="right").astype(np.int64))

    heads = ids.select("doc_id", bucket("doc_id").alias("bucket")).groupBy("bucket").agg(F.min("doc_id").alias("doc_id")).orderBy("bucket").collect()
    order = np.array([r.bucket for r in heads], np.int64)
    firsts = np.array([r.doc_id for r in heads], np.int64)

    @pandas_udf(T.LongType())
    def visits(ids):
        """Bucket that also gets this document, or -1."""
        import pandas as pd

        at = np.minimum(np.searchsorted(firsts, ids.to_numpy()), len(firsts) - 1)
        return pd.Series(np.where(firsts[at] == ids.to_numpy(), order[at - 1], -1))

    placed = texts.withColumn("own", bucket("doc_id")).withColumn("other", visits("doc_id"))
    both = placed.select(
        "doc_id", "absent", "text",
        F.explode(F.filter(F.array(F.struct(F.col("own").alias("bucket"), F.lit(False).alias("guest")), F.struct(F.col("other").alias("bucket"), F.lit(True).alias("guest"))), lambda x: x["bucket"] >= 0)).alias("to"),
    ).select("to.bucket", "to.guest", "doc_id", "absent", "text")
    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = both.repartition(max(shuffles, 1), "bucket").sortWithinPartitions("bucket", "guest", "doc_id", "text")
    return words.small_batches(sorted_.select("bucket", "guest", F.when(~F.col("absent"), F.col("doc_id")).alias("doc_id"), "text")).mapInArrow(_compared, FIELDS)
