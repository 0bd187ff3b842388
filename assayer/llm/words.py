"""Words, shingles and rolling hashes of whole texts as numpy arrays.

A column of texts is looked at as one run of UTF-8 bytes with document offsets.
Hashes are polynomial prefix sums modulo 2**64 over random byte values, so the
hash of any span costs one subtraction; work goes in blocks of ``BLOCK`` bytes,
which bounds memory whatever the length of a text. Modulo a power of two, texts of
``LONG`` bytes or more can be built that agree in any such sum, so longer spans take
in a second sum modulo a prime. Null texts count as empty.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, types as T

BLOCK = 1 << 20
LONG = 512
_BASE = 0x9E3779B97F4A7C15
_PRIME, _PRIME_BASE = (1 << 31) - 1, 1_103_515_245
_cache: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (the finaliser of splitmix)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32
#: Everything but blank and the five ASCII controls of white space is part of a word.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False
#: Letters, digits and everything beyond ASCII.
ALNUM = np.arange(256) >= 128
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = True


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_cache.get("up", ())) <= n:
        size = max(n, BLOCK) + 1
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            p = np.full(size, np.uint64(base))
            p[0] = 1
            _cache[name] = np.cumprod(p)
    return _cache["up"], _cache["down"]


def _prime_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base modulo the prime and of its inverse, in doubled steps."""
    if len(_cache.get("prime_up", ())) <= n:
        size = max(n, BLOCK) + 1
        for name, base in (("prime_up", _PRIME_BASE), ("prime_down", pow(_PRIME_BASE, -1, _PRIME))):
            p = np.ones(1, np.uint64)
            while len(p) < size:
                p = np.concatenate([p, p * np.uint64(pow(base, len(p), _PRIME)) % np.uint64(_PRIME)])
            _cache[name] = p[:size]
    return _cache["prime_up"], _cache["prime_down"]


def span_sums(block: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sum of value * base**(place in the span) of each span, modulo 2**64."""
    up, down = _powers(len(block))
    sums = np.zeros(len(block) + 1, np.uint64)
    np.cumsum(VALUES[block] * up[: len(block)], out=sums[1:])
    return (sums[ends] - sums[starts]) * down[starts]


def prime_sums(block: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """As ``span_sums``, modulo a prime of 31 bits."""
    up, down = _prime_powers(len(block))
    prime = np.uint64(_PRIME)
    sums = np.zeros(len(block) + 1, np.uint64)
    np.cumsum((VALUES % prime)[block] * up[: len(block)] % prime, out=sums[1:])
    return (sums[ends] - sums[starts]) % prime * down[starts] % prime


def _finished(sums: np.ndarray, primes: np.ndarray | None, lengths: np.ndarray) -> np.ndarray:
    out = mix(sums + lengths.astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
    return out if primes is None else mix(out ^ (primes + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93))


def span_hashes(block: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each span [start, end) of a block of bytes; equal bytes, equal hash."""
    sums, lengths = span_sums(block, starts, ends), ends - starts
    out = _finished(sums, None, lengths)
    long = np.flatnonzero(lengths >= LONG)
    if len(long):
        out[long] = _finished(sums[long], prime_sums(block, starts[long], ends[long]), lengths[long])
    return out


def long_hash(data: np.ndarray) -> np.uint64:
    """The hash of all of ``data`` as one span, whatever its length, in blocks."""
    if len(data) <= BLOCK:
        return span_hashes(data, np.array([0]), np.array([len(data)]))[0]
    total, prime = 0, 0
    for low in range(0, len(data), BLOCK):
        part = data[low : low + BLOCK]
        ends = np.array([0]), np.array([len(part)])
        total += int(span_sums(part, *ends)[0]) * pow(_BASE, low, 1 << 64)
        prime += int(prime_sums(part, *ends)[0]) * pow(_PRIME_BASE, low, _PRIME)
    return _finished(np.array([total % (1 << 64)], np.uint64), np.array([prime % _PRIME], np.uint64), np.array([len(data)]))[0]


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column, and the offset of each text and of the end."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def find_words(data: np.ndarray, offsets: np.ndarray, word_byte: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each text the number of its first word."""
    inside = word_byte[data]
    before, after = np.zeros_like(inside), np.zeros_like(inside)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    before[edges], after[edges - 1] = False, False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: np.ndarray = ASCII_LOWER) -> np.ndarray:
    out, i = np.empty(len(starts), np.uint64), 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + BLOCK, side="right")))
        low = starts[i]
        folded = fold[data[low : ends[j - 1]]]
        out[i:j] = long_hash(folded) if j == i + 1 else span_hashes(folded, starts[i:j] - low, ends[i:j] - low)
        i = j
    return out


def shingle_hashes(hashes: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of ``size`` words of a text, in order, and the text it is in.

    A text with fewer words gives its whole sequence as one; one without words, none.
    """
    counts = np.diff(bounds)
    first = np.repeat(np.arange(len(counts)), counts)
    left = bounds[first + 1] - np.arange(len(hashes))

    def joined(at: np.ndarray, length: int) -> np.ndarray:
        out = np.full(len(at), np.uint64(length))
        for i in range(length):
            out = mix(out * np.uint64(0x9FB21C651E98DF25) + hashes[at + i])
        return out

    at = np.flatnonzero(left >= size)
    parts, owners = [joined(at, size)], [first[at]]
    for length in range(1, size):
        short = np.flatnonzero(counts == length)
        if len(short):
            parts.append(joined(bounds[short], length))
            owners.append(short)
    values, owner = np.concatenate(parts), np.concatenate(owners)
    if len(parts) > 1:
        order = np.argsort(owner, kind="stable")
        values, owner = values[order], owner[order]
    return values, owner


def distinct_per_text(values: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each text, sorted by text and value."""
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    fresh = np.ones(len(values), bool)
    fresh[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    return values[fresh], owner[fresh]


def in_pieces(batch: pa.RecordBatch, text: int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that the texts of a piece stay under ``most`` bytes where
    more than one row is in it."""
    _, offsets = text_bytes(batch.column(text))
    low = 0
    while low < batch.num_rows:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + most, side="right")) - 1)
        yield batch.slice(low, high - low)
        low = high


def map_texts(df: DataFrame, make: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str | T.StructType, most: int = 4 << 20) -> DataFrame:
    """Apply ``make`` to bounded pieces of ``df``, which has a column ``text``."""
    text = df.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in in_pieces(batch, text, most):
                yield make(piece)

    return small_batches(df).mapInArrow(run, schema)


BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": 2000, "spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20}


def small_batches(df: DataFrame) -> DataFrame:
    """Bound what one Arrow batch to a Python worker may hold. All operators use the
    same bounds, and lower ones of the session stay, so no order of calls matters."""
    conf = df.sparkSession.conf
    for name, most in BATCHES.items():
        held = conf.get(name) or ""
        if not (held.isdigit() and 0 < int(held) <= most):
            conf.set(name, str(most))
    return df


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")
