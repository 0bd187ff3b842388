"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming
search, shingles that a passage cannot do without, exact weighted-shingle similarity."""

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial, reduce
from itertools import combinations
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from assayer.llm import words

SHINGLE, LEAST = 5, 0.8
RADIUS, PARTS = 7, 4
ITEM_BLOCK = 4 << 20
ROWS = 1 << 12
WIDEST = 255
#: Bits of the table that spares looking up most shingles; slack of float sums.
ANCHOR_BITS, SLACK = 22, 1e-9
SCHEMA = "doc_id bigint, item_id bigint, similarity double, distance int, first_word bigint, n_words bigint"


def bit_sums(shingles: np.ndarray) -> np.ndarray:
    """Running counts of the bits of 64-bit hashes, modulo 256: one row more than hashes."""
    bits = np.unpackbits(shingles.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    sums = np.zeros((len(bits) + 1, 64), np.uint8)
    np.cumsum(bits, axis=0, dtype=np.uint8, out=sums[1:])
    return sums


def majority(sums: np.ndarray, width: int) -> np.ndarray:
    """64-bit SimHash of each run of ``width`` hashes, 255 at most: bit by bit the majority."""
    if len(sums) <= width:
        return np.zeros(0, np.uint64)
    more = (sums[width:] - sums[:-width]) > width // 2
    return np.packbits(more, axis=1, bitorder="little").view(np.uint64).reshape(-1)


def _near(values: np.ndarray, bits: int, flips: int) -> np.ndarray:
    masks = [sum(1 << b for b in c) for k in range(flips + 1) for c in combinations(range(bits), k)]
    return (values[:, None] ^ np.array(masks)[None, :]).reshape(-1)


class Weights(dict[int, float]):
    """Weight of each shingle that several items hold; any other weighs 1."""

    def __missing__(self, shingle: int) -> float:
        return 1.0


@dataclass
class Index:
    """Fingerprints of benchmark items by window size.

    A window size is the largest of a geometric series up to 0.8 of an item's
    words, and of half of that, so a passage alike by 0.8 holds such a window
    whole. Fingerprints within ``RADIUS`` of each other agree up to
    ``RADIUS // PARTS`` bits in one of ``PARTS`` blocks of their bits; a table per
    block marks all such values, so no fingerprint within the radius is missed.

    Edits in each of these windows hide a passage from them, so an item also has
    anchors: its rarest shingles, up to more than 0.2 of its weight. A passage
    without any of them has less than 0.8 of the item and cannot be alike by 0.8.
    """

    item_ids: list[int]
    lengths: list[int]
    shingles: list[dict[int, float]]
    weights: Weights
    sizes: dict[int, list[tuple[int, int, int]]] = field(default_factory=dict)  # size -> (fingerprint, item, offset)
    tables: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)
    anchors: dict[int, list[int]] = field(default_factory=dict)  # shingle -> items
    anchored: np.ndarray | None = None


def _size(most: float) -> int:
    size = 1
    while max(size + 1, int(size * 1.2)) <= min(most, WIDEST):
        size = max(size + 1, int(size * 1.2))
    return size


def build(items: list[tuple[int, str]], spread: dict[int, int] | None = None) -> Index:
    """Index of (item_id, text); items without words match nothing. ``spread`` has
    the number of items for each shingle that several items of the benchmark hold;
    without it the given items are the whole benchmark."""
    data, offsets = words.text_bytes(pa.array([t for _, t in items], pa.string()))
    starts, ends, bounds = words.find_words(data, offsets, words.ALNUM)
    hashes = words.word_hashes(data, starts, ends)
    lists = [words.shingle_hashes(hashes[a:b], np.array([0, b - a]), SHINGLE)[0].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    if spread is None:
        spread = {s: n for s, n in Counter(s for one in lists for s in set(one)).items() if n > 1}
    weights = Weights({s: 1 / (1 + log2(n)) for s, n in spread.items()})
    index = Index([i for i, _ in items], [int(n) for n in np.diff(bounds)], [{s: n * weights[s] for s, n in Counter(one).items()} for one in lists], weights)
    for item, (a, length) in enumerate(zip(bounds[:-1], index.lengths, strict=True)):
        whole = _size(max(1, length * LEAST))
        for size in {whole, _size(whole / 2) if whole >= 28 else whole} if length else ():
            wide = min(SHINGLE, size)
            marks = majority(bit_sums(runs(hashes[a : a + length], wide)), size - wide + 1)
            for offset in sorted({0, (length - size) // 2, length - size}):
                index.sizes.setdefault(size, []).append((int(marks[offset]), item, offset))
    for size, rows in index.sizes.items():
        marks = np.array([m for m, _, _ in rows], np.uint64)
        bits = 64 // PARTS
        table = np.zeros((PARTS, 1 << bits), bool)
        for part in range(PARTS):
            table[part, _near(((marks >> np.uint64(bits * part)) & np.uint64((1 << bits) - 1)).astype(np.int64), bits, RADIUS // PARTS)] = True
        index.tables[size] = (marks, table)
    for item, theirs in enumerate(index.shingles):
        left = (1 - LEAST) * sum(theirs.values()) * (1 + SLACK)
        for s in sorted(theirs, key=lambda s: (-weights[s], s)):
            index.anchors.setdefault(s, []).append(item)
            left -= theirs[s]
            if left < 0:
                break
    index.anchored = np.zeros(1 << ANCHOR_BITS, bool)
    index.anchored[np.array(list(index.anchors), np.uint64) & np.uint64((1 << ANCHOR_BITS) - 1)] = True
    return index


def runs(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` words, as in ``words.shingle_hashes``."""
    out = np.full(max(len(hashes) - size + 1, 0), np.uint64(size))
    for i in range(size):
        out = words.mix(out * np.uint64(0x9FB21C651E98DF25) + hashes[i : i + len(out)])
    return out


def _candidates(marks: np.ndarray, known: np.ndarray, table: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(window, fingerprint, distance) of all pairs within the radius."""
    halves = marks.view(np.uint16).reshape(-1, PARTS)
    near = table[0][halves[:, 0]]
    for part in range(1, PARTS):
        near |= table[part][halves[:, part]]
    at = np.flatnonzero(near)
    for low in range(0, len(at), ROWS):
        some = at[low : low + ROWS]
        distance = np.bitwise_count(marks[some][:, None] ^ known[None, :])
        row, column = np.divmod(np.flatnonzero((distance <= RADIUS).reshape(-1)), len(known))
        yield some[row], column, distance[row, column]


def similarity(index: Index, item: int, shingles: list[int]) -> float:
    """Weighted Jaccard similarity: shingles that many items share weigh less."""
    theirs = index.shingles[item]
    mine = Counter(shingles)
    both = sum(min(w, mine[s] * index.weights[s]) for s, w in theirs.items() if s in mine)
    total = sum(theirs.values()) + sum(n * index.weights[s] for s, n in mine.items())
    return both / (total - both) if total > both else 1.0


def _anchored(index: Index, shingles: dict[int, np.ndarray], owner: np.ndarray) -> dict[tuple[int, int], list[int]]:
    """Words at which an anchor begins, in order, by document and item."""
    found: dict[tuple[int, int], list[int]] = {}
    for width in {min(SHINGLE, n) for n in index.lengths if n}:
        own = shingles[width]
        at = np.flatnonzero(index.anchored[own & np.uint64((1 << ANCHOR_BITS) - 1)])
        at = at[owner[at] == owner[at + width - 1]]
        for word, shingle in zip(at.tolist(), own[at].tolist(), strict=True):
            for item in index.anchors.get(shingle, ()):
                found.setdefault((int(owner[word]), item), []).append(word)
    return found


def _windows(index: Index, item: int, own: np.ndarray, hits: list[int], low: int, high: int) -> Iterator[tuple[float, int]]:
    """Windows of a document [low, high) that hold a hit and could be alike enough:
    (bound of the similarity, first word), the largest bound first.

    A window may begin before the document or end after it; it is cut there. No
    similarity is above the share of the item's weight that the window's shingles
    have, repeats counted.
    """
    theirs, width = index.shingles[item], min(SHINGLE, index.lengths[item])
    reach, total = index.lengths[item] - width, sum(theirs.values())
    ends = [i for i in range(len(hits)) if i + 1 == len(hits) or hits[i + 1] - hits[i] > reach]
    bounds, starts = [], []
    for first, last in zip([0] + [i + 1 for i in ends[:-1]], ends, strict=True):
        start = np.arange(hits[first] - reach, hits[last] + 1)
        a, b = max(low, hits[first] - reach), min(high - width, hits[last] + reach) + 1
        sums = np.zeros(b - a + 1)
        np.cumsum([index.weights[s] if s in theirs else 0.0 for s in own[a:b].tolist()], out=sums[1:])
        bounds.append((sums[np.minimum(start + reach + 1, b) - a] - sums[np.maximum(start, a) - a]) / total)
        starts.append(start)
    bound, start = np.concatenate(bounds), np.concatenate(starts)
    at = np.flatnonzero(bound >= LEAST - SLACK)
    at = at[np.argsort(-np.minimum(bound[at], 1.0), kind="stable")]
    yield from zip(np.minimum(bound[at] + SLACK, 1.0).tolist(), start[at].tolist(), strict=True)


def _distance(index: Index, item: int, hashes: np.ndarray, start: int, low: int, high: int) -> int | None:
    """Least distance of the item's fingerprints from those at their places in a
    window; none if each place is partly outside the document."""
    found = []
    for size, rows in index.sizes.items():
        for mark, _, offset in (r for r in rows if r[1] == item):
            if start + offset >= low and start + offset + size <= high:
                wide = min(SHINGLE, size)
                own = majority(bit_sums(runs(hashes[start + offset : start + offset + size], wide)), size - wide + 1)
                found.append((int(own[0]) ^ mark).bit_count())
    return min(found, default=None)


def _matches(batch: pa.RecordBatch, index: Index) -> pa.RecordBatch:
    data, offsets = words.text_bytes(batch.column("text"))
    starts, ends, bounds = words.find_words(data, offsets, words.ALNUM)
    hashes = words.word_hashes(data, starts, ends)
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    best: dict[tuple[int, int], tuple[float, int | None, int, int]] = {}
    checked = set()
    by_width = {w: runs(hashes, w) for w in {min(SHINGLE, s) for s in [*index.sizes, *index.lengths] if s}}
    longest = max(index.sizes, default=0)
    for low in range(0, len(hashes), ROWS):
        sums = {w: bit_sums(by_width[w][low : low + ROWS + longest]) for w in {min(SHINGLE, s) for s in index.sizes}}
        for size, (known, table) in index.tables.items():
            wide = min(SHINGLE, size)
            marks = majority(sums[wide], size - wide + 1)[:ROWS]
            for window, mark, distance in _candidates(marks, known, table):
                window = window + low
                inside = owner[window] == owner[window + size - 1]
                for w, m, d in zip(window[inside].tolist(), mark[inside].tolist(), distance[inside].tolist(), strict=True):
                    _, item, offset = index.sizes[size][m]
                    doc = int(owner[w])
                    first = max(int(bounds[doc]), w - offset)
                    last = min(int(bounds[doc + 1]), w - offset + index.lengths[item])
                    if (first, last, item) in checked:
                        continue
                    checked.add((first, last, item))
                    own = words.shingle_hashes(hashes[first:last], np.array([0, last - first]), SHINGLE)[0].tolist()
                    alike = similarity(index, item, own)
                    if alike >= LEAST and alike > best.get((doc, item), (0,))[0]:
                        best[doc, item] = (alike, d, first - int(bounds[doc]), last - first)
    for (doc, item), hits in _anchored(index, by_width, owner).items():
        low, high, width = int(bounds[doc]), int(bounds[doc + 1]), min(SHINGLE, index.lengths[item])
        found = None
        for bound, start in _windows(index, item, by_width[width], hits, low, high):
            if bound <= best.get((doc, item), (0,))[0]:
                break
            first, last = max(low, start), min(high, start + index.lengths[item])
            if (first, last, item) in checked:
                continue
            checked.add((first, last, item))
            alike = similarity(index, item, by_width[width][first : last - width + 1].tolist())
            if alike >= LEAST and alike > best.get((doc, item), (0,))[0]:
                best[doc, item], found = (alike, None, first - low, last - first), start
        if found is not None:
            alike, _, *place = best[doc, item]
            best[doc, item] = (alike, _distance(index, item, hashes, found, low, high), *place)
    ids = batch.column("doc_id").to_pylist()
    rows = [(ids[doc], index.item_ids[item], *value) for (doc, item), value in best.items()]
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
    kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int64(), pa.int64())
    return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "item_id", "similarity", "distance", "first_word", "n_words"])


def _item_shingles(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The distinct shingles of each item."""
    data, offsets = words.text_bytes(batch.column("text"))
    starts, ends, bounds = words.find_words(data, offsets, words.ALNUM)
    values, _ = words.distinct_per_text(*words.shingle_hashes(words.word_hashes(data, starts, ends), bounds, SHINGLE))
    return pa.record_batch([pa.array(values.view(np.int64))], names=["shingle"])


def shingle_spread(items: DataFrame) -> dict[int, int]:
    """Number of items for each shingle that several items hold, over the whole
    benchmark: its items are the stated query set, and this is smaller."""
    found = words.map_texts(items.select("text").where("text is not null"), _item_shingles, "shingle bigint").groupBy("shingle").agg(F.count("*").alias("n"))
    return {r.shingle % (1 << 64): r.n for r in found.where("n > 1").collect()}


def _blocks(items: DataFrame, most: int) -> Iterator[list[tuple[int, str]]]:
    block, size = [], 0
    for row in items.select(F.col("item_id").cast("bigint"), "text").where("text is not null").orderBy("item_id", "text").toLocalIterator():
        if block and size + len(row[1]) > most:
            yield block
            block, size = [], 0
        block.append((row[0], row[1]))
        size += len(row[1])
    if block:
        yield block


def contaminated(docs: DataFrame, items: DataFrame, block: int = ITEM_BLOCK) -> DataFrame:
    """Which documents hold which benchmark items.

    Words are runs of letters and digits (everything beyond ASCII counts as a
    letter), A-Z in lower case. One row per document row and item whose best
    window of the item's number of words is alike by 0.8 or more in weighted
    five-word shingles: doc_id, item_id, similarity, distance (of the SimHash
    that found it, else the least of the item's at their places, null if none of
    these is inside the document), first_word and n_words of the window. Candidates
    are all windows with a fingerprint within ``RADIUS`` bits of one of the item's,
    and all with an anchor of the item, so no passage alike by 0.8 is missed.
    Windows are cut at the ends of a document. Null and empty texts on
    either side match nothing; repeated rows each give their rows; other columns
    are ignored. The items are the stated query set: they are read by item_id in
    blocks of ``block`` characters and each block meets all documents in one pass.
    Shingles weigh by the number of items of the whole benchmark that hold them,
    so results do not depend on the blocks.
    """
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("text is not null")
    spread = shingle_spread(items)
    parts = [words.map_texts(texts, partial(_matches, index=build(own, spread)), SCHEMA) for own in _blocks(items, block)]
    if not parts:
        return docs.sparkSession.createDataFrame([], SCHEMA)
    return reduce(DataFrame.union, parts)


def keep_clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Documents without a benchmark item; rows with a null doc_id are kept only
    if no such row holds one."""
    hit = contaminated(docs, items).select("doc_id").distinct()
    marked = hit.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("__id"))
    return docs.withColumn("__id", F.coalesce("doc_id", F.lit(-(1 << 63)))).join(marked, "__id", "left_anti").select(*docs.columns)
