"""Periodic runs of words, found on a Re-Pair grammar of each text.

A run is a stretch of words with smallest period q, at least ``least`` words and
``power`` periods long, that neither neighbour extends. The steps, in numpy over
bounded pieces of the corpus:

1. Re-Pair: word ids are numbered apart for each text; in a round every pair that
   is more frequent than the pairs it overlaps gives way to a new symbol, until no
   pair is left twice. The start rule of each text is then halved again and again.
2. Each symbol, that is each node of the grammar, is looked at once, at one of its
   places: the runs across the boundary of its two parts. A run of that size has
   ``GRAM`` words beside the boundary that return one period on, so equal grams
   give the periods to try; how far each goes is read from the names of all
   stretches of 1, 2, 4, 8 ... words, which are exact.
3. What was found moves to all places of the symbol, and stretches that lie in a
   longer one of the same period go. Each run lies in some smallest node and
   crosses the boundary there, so none is missed.
"""

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from assayer.llm import words

LEAST, POWER = 24, 3
GRAM = 4
TRIED_AT_ONCE = 1 << 20


def repair(symbols: np.ndarray, bounds: np.ndarray) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, np.ndarray]]:
    """Re-Pair of texts whose symbols are numbered apart.

    Gives the occurrences of all made symbols as (symbol, start, boundary, end),
    places in words, and the start rules as (start, end) of their symbols.
    """
    size = len(symbols)
    sym, start, end = symbols.astype(np.int64), np.arange(size), np.arange(1, size + 1)
    fresh = int(sym.max()) + 1 if size else 0
    made, rules = [], []
    while len(sym) > 1:
        a, b = sym[:-1], sym[1:]
        key = a * fresh + b
        same = a == b
        if same.any():  # of aaaa the pairs at even places count
            at = np.arange(len(a))
            opens = same.copy()
            opens[1:] &= ~same[:-1]
            key[same & ((at - np.maximum.accumulate(np.where(opens, at, 0))) % 2 == 1)] = -1
        ordered = np.sort(key)
        again = ordered[1:][ordered[1:] == ordered[:-1]]
        again = again[again >= 0]
        if not len(again):
            break
        pairs, often = np.unique(again, return_counts=True)
        rank = np.empty(len(pairs), np.int64)
        rank[np.lexsort((words.mix(pairs.astype(np.uint64)), often))] = np.arange(1, len(pairs) + 1)
        near = np.minimum(np.searchsorted(pairs, key), len(pairs) - 1)
        weight = np.zeros(len(key) + 2, np.int64)
        weight[1:-1] = np.where(pairs[near] == key, rank[near], 0)
        own = weight[1:-1]
        taken = np.flatnonzero((own > weight[:-2]) & (own > weight[2:]))
        uses = np.bincount(own[taken], minlength=len(pairs) + 1)
        taken = taken[uses[own[taken]] > 1]
        number = np.cumsum(uses > 1) - 1 + fresh
        fresh = int(number[-1]) + 1
        made.append((number[own[taken]], start[taken], end[taken], end[taken + 1]))
        # texts without a repeated pair are done: their start rule is known
        text = np.searchsorted(bounds, start, side="right")
        busy = np.zeros(len(bounds) + 1, bool)
        busy[text[:-1][own > 0]] = True
        sym[taken] = number[own[taken]]
        end[taken] = end[taken + 1]
        keep = np.ones(len(sym), bool)
        keep[taken + 1] = False
        done = keep & ~busy[text]
        rules.append((start[done], end[done]))
        keep &= busy[text]
        sym, start, end = sym[keep], start[keep], end[keep]
    rules.append((start, end))
    start, end = (np.concatenate(x) for x in zip(*rules, strict=True))
    order = np.argsort(start, kind="stable")
    empty = np.zeros(0, np.int64)
    found = tuple(np.concatenate(x) for x in zip(*made, strict=True)) if made else (empty, empty, empty, empty)
    return found, (start[order], end[order])


def _halved(start: np.ndarray, end: np.ndarray, bounds: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """Nodes (start, boundary, end) of start rules that are halved to single symbols."""
    text = np.searchsorted(bounds, start, side="right") - 1
    first = np.searchsorted(start, bounds[:-1])
    last = np.searchsorted(start, bounds[1:]) - 1
    own, out, half = np.arange(len(start)) - first[text], [], 1
    while half < (own.max(initial=0) + 1):
        middle = np.flatnonzero(own % (2 * half) == half)
        right = np.minimum(middle + half - 1, last[text[middle]])
        node = start[middle - half], start[middle], end[right]
        large = node[2] - node[0] >= least
        out.append(tuple(x[large] for x in node))
        half *= 2
    empty = np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (empty, empty, empty)


def _joined(names: np.ndarray, apart: int) -> np.ndarray:
    """Names of stretches made of two named ones; equal names, equal stretches."""
    left, right = names[: len(names) - apart], names[apart:]
    if not len(left):
        return np.zeros(0, np.int64)
    return np.unique(left * (int(names.max()) + 1) + right, return_inverse=True)[1].astype(np.int64)


class Stretches:
    """Names of all stretches of 1, 2, 4 ... words: how far two places agree."""

    def __init__(self, symbols: np.ndarray, longest: int) -> None:
        self.names = [symbols.astype(np.int64)]
        while 2 << (len(self.names) - 1) <= longest:
            self.names.append(_joined(self.names[-1], 1 << (len(self.names) - 1)))

    def agree(self, x: np.ndarray, y: np.ndarray, most: np.ndarray, back: bool = False) -> np.ndarray:
        """Words that agree from x and y on, or before them, ``most`` at most."""
        out = np.zeros(len(x), np.int64)
        for level in range(len(self.names) - 1, -1, -1):
            names, step = self.names[level], 1 << level
            fits = np.flatnonzero(most - out >= step)
            done = out[fits]
            i, j = (x[fits] - done - step, y[fits] - done - step) if back else (x[fits] + done, y[fits] + done)
            out[fits] += step * (names[i] == names[j])
        return out


def _tried(names: np.ndarray, left: np.ndarray, middle: np.ndarray, right: np.ndarray, power: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(node, x, y): equal grams at x < y beside the boundary of a node, in bounded blocks."""
    size = len(names)
    order = np.argsort(names, kind="stable")
    place = np.empty(size, np.int64)
    place[order] = np.arange(size)
    keys = names[order] * (size + 1) + order
    widest = (right - left) // power
    for ahead in (True, False):
        anchor = middle if ahead else middle - GRAM
        fits = np.flatnonzero((anchor >= left) & (anchor + GRAM <= right) & (anchor < size))
        at = anchor[fits]
        name = names[at] * (size + 1)
        if ahead:
            low = place[at] + 1
            high = np.searchsorted(keys, name + np.minimum(at + widest[fits], right[fits] - GRAM), side="right")
        else:
            low = np.searchsorted(keys, name + np.maximum(at - widest[fits], left[fits]))
            high = place[at]
        counts = np.maximum(high - low, 0)
        some = counts > 0
        fits, at, low, counts = fits[some], at[some], low[some], counts[some]
        total = np.cumsum(counts)
        begin = 0
        while begin < len(fits):
            stop = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + TRIED_AT_ONCE, side="right")))
            n = counts[begin:stop]
            node = np.repeat(fits[begin:stop], n)
            other = order[np.repeat(low[begin:stop] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            here = np.repeat(at[begin:stop], n)
            yield (node, here, other) if ahead else (node, other, here)
            begin = stop


def _across(symbols: np.ndarray, bounds: np.ndarray, nodes: tuple[np.ndarray, ...], least: int, power: int) -> tuple[np.ndarray, ...]:
    """Stretches (node, start, end, period) that cross the boundary of a node, in it."""
    left, middle, right = nodes
    empty = np.zeros(0, np.int64)
    if not len(left) or len(symbols) < GRAM:
        return empty, empty, empty, empty
    grams = _joined(_joined(symbols.astype(np.int64), 1), 2)
    out, stretches = [], None
    for node, x, y in _tried(grams, left, middle, right, power):
        if stretches is None:
            stretches = Stretches(symbols, int(np.diff(bounds).max()))
        begin = x - stretches.agree(x, y, x - left[node], back=True)
        stop = y + stretches.agree(x, y, right[node] - y)
        period = y - x
        large = (stop - begin >= least) & (stop - begin >= power * period)
        out.append(tuple(v[large] for v in (node, begin, stop, period)))
    if not out:
        return empty, empty, empty, empty
    node, begin, stop, period = (np.concatenate(v) for v in zip(*out, strict=True))
    order = np.lexsort((period, stop, begin, node))  # a stretch has its smallest period
    node, begin, stop, period = (v[order] for v in (node, begin, stop, period))
    new = np.ones(len(node), bool)
    new[1:] = (node[1:] != node[:-1]) | (begin[1:] != begin[:-1]) | (stop[1:] != stop[:-1])
    return node[new], begin[new], stop[new], period[new]


def runs(symbols: np.ndarray, bounds: np.ndarray, least: int = LEAST, power: int = POWER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All runs (start, end, period) of texts whose symbols are numbered apart.

    ``bounds`` holds the first word of each text and the end; the runs come by
    text, start and period. The longer side of a boundary has half a run, so that
    from 6 * GRAM words and three periods on GRAM words of it return there.
    """
    if least < 6 * GRAM or power < 3:
        raise ValueError(f"runs of under {6 * GRAM} words or 3 periods are not found")
    (symbol, start, middle, end), rule = repair(symbols, bounds)
    large = end - start >= least
    symbol, start, middle, end = symbol[large], start[large], middle[large], end[large]
    order = np.lexsort((start, symbol))
    symbol, start, middle, end = symbol[order], start[order], middle[order], end[order]
    first = np.flatnonzero(np.r_[True, symbol[1:] != symbol[:-1]]) if len(symbol) else np.zeros(0, np.int64)
    counts = np.diff(np.r_[first, len(symbol)])
    halves = _halved(*rule, bounds, least)
    nodes = tuple(np.concatenate([own[first], top]) for own, top in zip((start, middle, end), halves, strict=True))
    node, begin, stop, period = _across(symbols, bounds, nodes, least, power)
    places = np.r_[counts, np.ones(len(halves[0]), np.int64)]
    offset = np.r_[first, len(start) + np.arange(len(halves[0]))]
    starts = np.r_[start, halves[0]]
    times = places[node]
    which = np.repeat(np.arange(len(node)), times)
    at = np.repeat(offset[node] - (np.cumsum(times) - times), times) + np.arange(len(which))
    moved = starts[at] - nodes[0][node[which]]
    begin, stop, period = begin[which] + moved, stop[which] + moved, period[which]
    text = np.searchsorted(bounds, begin, side="right")
    order = np.lexsort((-stop, begin, period, text))
    begin, stop, period, text = begin[order], stop[order], period[order], text[order]
    if len(begin):  # what lies in a longer stretch of its text and period is no run
        group = np.cumsum(np.r_[False, (text[1:] != text[:-1]) | (period[1:] != period[:-1])])
        reach = np.maximum.accumulate(group * (len(symbols) + 1) + stop)
        keep = np.r_[True, (group * (len(symbols) + 1) + stop)[1:] > reach[:-1]]
        begin, stop, period, text = begin[keep], stop[keep], period[keep], text[keep]
    order = np.lexsort((period, begin))
    return begin[order], stop[order], period[order]


def numbered(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Word ids of texts, numbered apart for each, and the bounds of the texts."""
    out, above = [], 0
    for text in texts:
        known: dict[bytes, int] = {}
        out.append(np.fromiter((known.setdefault(w, len(known)) for w in text), np.int64, len(text)) + above)
        above += len(known)
    sizes = np.array([len(t) for t in texts], np.int64)
    return np.concatenate(out) if out else np.zeros(0, np.int64), np.r_[0, np.cumsum(sizes)]


def _collapsed(batch: pa.RecordBatch, least: int, power: int) -> pa.RecordBatch:
    data, offsets = words.text_bytes(batch.column("text"))
    raw = data.tobytes()
    texts = [raw[a:b].split() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
    symbols, bounds = numbered(texts)
    begin, stop, period = runs(symbols, bounds, least, power)
    gone = np.zeros(len(symbols) + 1, np.int64)
    np.add.at(gone, begin + period, 1)
    np.add.at(gone, stop, -1)
    gone = np.cumsum(gone) > 0
    first = np.searchsorted(begin, bounds)
    owner = np.searchsorted(bounds, begin, side="right") - 1
    kept = []
    for k, text in enumerate(texts):
        if first[k] < first[k + 1]:
            text = [w for w, out in zip(text, gone[bounds[k] : bounds[k + 1]].tolist(), strict=True) if not out]
        kept.append(b" ".join(text))
    found = pa.StructArray.from_arrays([pa.array(begin - bounds[owner]), pa.array(stop - begin), pa.array(period)], ["start", "length", "period"])
    made = {
        "n_words": pa.array(np.diff(bounds)), "runs": pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), found),
        "collapsed": pa.array(kept, pa.binary()).cast(pa.string()),
    }
    own = {n: batch.column(n) for n in batch.schema.names if n != "text" and n not in made}
    return pa.record_batch(list((own | made).values()), names=list(own | made))


def collapse_runs(docs: DataFrame, least: int = LEAST, power: int = POWER) -> DataFrame:
    """Find the periodic runs of every whole text and keep one period of each.

    The text is replaced by n_words, runs (start, length, period in words, by
    start and then period) and collapsed: the words, joined by one blank, without
    those that a run holds after its first period. Words are what ASCII white
    space leaves. A null text counts as empty: no words, no runs, ''. Rows are
    taken one by one, so repeated rows and null ids give rows of their own.
    Columns of these names are replaced, other columns are kept.
    """
    extra = "n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"
    kept = [f"`{n}` {t}" for n, t in docs.dtypes if n not in ("text", "n_words", "runs", "collapsed")]
    return words.map_texts(docs, partial(_collapsed, least=least, power=power), ", ".join([*kept, extra]))
