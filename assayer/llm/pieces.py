"""SentencePiece encoding and decoding as a weighted finite-state transducer.

``compile_model`` reads a model file and builds the parts: a normaliser (blank to
the piece mark, mark in front), an acceptor of the pieces over characters with
their ids as output, and byte fallback for characters that no piece spells. All
distinct words of a batch are composed with them at once, in arrays: arcs from each
place to the ends of the pieces and of the single character there. The shortest
path in the tropical semiring (add along a path, least among paths), place by place
over all words, is their encoding.

Weights: a unigram model's arcs weigh minus their score. A BPE model's arcs weigh
1, or infinity behind a piece if the merges of the model would not leave just these
two pieces of their joined text. A segmentation is the one that merging gives
exactly when all its neighbours pass that test, so each prefix of a word has one
path of finite weight, and the shortest path is the model's segmentation.
"""

import hashlib
from dataclasses import dataclass, field
from functools import partial
from itertools import pairwise
from struct import pack, unpack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from assayer.llm import words

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
BYTE, UNKNOWN, CONTROL, UNIGRAM, BPE = 6, 2, 3, 1, 2
INFINITE = float("inf")
#: Weight of an arc that no piece has; neighbours whose test a worker remembers.
FALLBACK_WEIGHT, REMEMBERED = 1e3, 1 << 19
#: Characters of words that are composed at once; a longer word is composed alone.
AT_ONCE = 1 << 17
#: Bytes of texts that are encoded at once. What a worker has taken it keeps for the
#: next stage, beside the heap of its executor.
PIECE = 1 << 20
NOTHING, FOREIGN = -2, -1


def flat_ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one range after the other."""
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))


class Numbers:
    """Numbers by keys of 0 and more, for whole arrays: a table with open addressing."""

    def __init__(self, keys: np.ndarray | None = None, values: np.ndarray | None = None) -> None:
        self.size = 0
        self._room(0 if keys is None else len(keys))
        if keys is not None:
            self.add(keys, values)

    def _room(self, entries: int) -> None:
        slots = 1 << max(10, (3 * entries).bit_length())
        self.keys, self.values = np.full(slots, -1, np.int64), np.empty(slots, np.int64)

    def _homes(self, keys: np.ndarray) -> np.ndarray:
        return (words.mix(keys.astype(np.uint64)) & np.uint64(len(self.keys) - 1)).astype(np.int64)

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Add distinct keys that are not there yet."""
        if 3 * (self.size + len(keys)) > 2 * len(self.keys):
            held = self.keys >= 0
            old = self.keys[held], self.values[held]
            self._room(2 * (self.size + len(keys)))
            self.size = 0
            self.add(*old)
        self.size += len(keys)
        at = self._homes(keys)
        while len(keys):
            free = np.flatnonzero(self.keys[at] < 0)
            slots, first = np.unique(at[free], return_index=True)
            self.keys[slots], self.values[slots] = keys[free[first]], values[free[first]]
            left = self.keys[at] != keys
            keys, values, at = keys[left], values[left], (at[left] + 1) & (len(self.keys) - 1)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Number of each key, -1 where there is none."""
        out = np.full(len(keys), -1, np.int64)
        left, at = np.arange(len(keys)), self._homes(keys)
        while len(left):
            seen = self.keys[at]
            hit = seen == keys[left]
            out[left[hit]] = self.values[at[hit]]
            on = ~hit & (seen >= 0)
            left, at = left[on], (at[on] + 1) & (len(self.keys) - 1)
        return out


def _fields(raw: bytes):
    """(number, value) of each field of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            yield key >> 3, raw[at : at + size]
            at += size


@dataclass
class Transducer:
    """Symbols are the ids of pieces, then numbers for characters that are only
    part of pieces; ``FOREIGN`` stands for any other character."""

    pieces: list[str]
    scores: list[float]
    kinds: list[int]
    model_type: int = BPE
    mark_in_front: bool = True
    known: Numbers = field(default_factory=Numbers)

    def __post_init__(self) -> None:
        ids: dict[str, int] = {}
        self.is_byte = np.array([k == BYTE for k in self.kinds])
        self.bytes_to_id: dict[int, int] = {}
        self.unknown = self.kinds.index(UNKNOWN) if UNKNOWN in self.kinds else 0
        spelled = []
        for i, (piece, kind) in enumerate(zip(self.pieces, self.kinds, strict=True)):
            if kind == BYTE:
                self.bytes_to_id[int(piece[3:5], 16)] = i
                spelled.append(bytes([int(piece[3:5], 16)]))
            elif kind in (UNKNOWN, CONTROL):
                spelled.append(b"")
            else:
                spelled.append(piece.replace(MARK, " ").encode())
                ids.setdefault(piece, i)
        self.spelled = np.frombuffer(b"".join(spelled), np.uint8)
        self.spelled_sizes = np.array([len(x) for x in spelled], np.int64)
        self.spelled_starts = np.cumsum(self.spelled_sizes) - self.spelled_sizes
        symbols = dict(ids)
        for piece in ids:
            for char in piece:
                symbols.setdefault(char, len(self.pieces) + len(symbols) - len(ids))
        self.weights = np.full(max(symbols.values(), default=0) + 1, FALLBACK_WEIGHT)
        for piece, i in ids.items():
            self.weights[i] = -self.scores[i]
        self._accept(symbols)
        self._pair(ids, symbols)

    def _accept(self, symbols: dict[str, int]) -> None:
        """The acceptor of all symbols: states by (state, character)."""
        arcs: list[dict[str, int]] = [{}]
        final = {}
        for text, number in symbols.items():
            state = 0
            for char in text:
                if char not in arcs[state]:
                    arcs[state][char] = len(arcs)
                    arcs.append({})
                state = arcs[state][char]
            final[state] = number
        steps = [(state << 21 | ord(char), to) for state, own in enumerate(arcs) for char, to in own.items()]
        self.steps = Numbers(*(np.array(x, np.int64) for x in (zip(*steps, strict=True) if steps else ([], []))))
        self.final = np.full(len(arcs), NOTHING, np.int64)
        self.final[list(final)] = list(final.values())

    def _pair(self, ids: dict[str, int], symbols: dict[str, int]) -> None:
        """The merges of a BPE model, and which symbols they make of their characters."""
        self.merges, self.whole = Numbers(), np.ones(len(self.weights) + 1, bool)
        if self.model_type != BPE:
            return
        found = {}
        for piece, i in ids.items():
            for cut in range(1, len(piece)):
                left, right = symbols.get(piece[:cut]), symbols.get(piece[cut:])
                if left is not None and right is not None:
                    found[left << 32 | right] = i
        self.merges = Numbers(np.array(list(found), np.int64), np.array(list(found.values()), np.int64))
        spelled = {number: [symbols[c] for c in text] for text, number in symbols.items()}
        sizes = np.zeros(len(self.weights), np.int64)
        sizes[list(spelled)] = [len(x) for x in spelled.values()]
        self.char_sizes, self.char_starts = sizes, np.cumsum(sizes) - sizes
        self.chars = np.array([c for i in sorted(spelled) for c in spelled[i]], np.int64)
        own = np.array(sorted(spelled), np.int64)
        first, count, _ = self._merged(self.chars.copy(), np.repeat(np.arange(len(own)), sizes[own]), len(own))
        self.whole[own] = (count == 1) & (first == own)

    def _merged(self, symbols: np.ndarray, owner: np.ndarray, inputs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Merge all inputs, best score first, leftmost first: (first symbol, number
        of symbols, second symbol) of what is left of each."""
        first, count, second = (np.full(inputs, NOTHING) for _ in range(3))
        while len(symbols):
            same = owner[1:] == owner[:-1]
            made = np.full(len(symbols), -1, np.int64)
            at = np.flatnonzero(same)
            made[at] = self.merges.get(symbols[at] << 32 | symbols[at + 1])
            cost = np.where(made >= 0, self.weights[made], INFINITE)
            starts = np.flatnonzero(np.r_[True, ~same])
            sizes = np.diff(np.r_[starts, len(owner)])
            least = np.minimum.reduceat(cost, starts)
            done = least == INFINITE
            first[owner[starts[done]]], count[owner[starts[done]]] = symbols[starts[done]], sizes[done]
            two = starts[done & (sizes == 2)]
            second[owner[two]] = symbols[two + 1]
            best = np.flatnonzero((cost == np.repeat(least, sizes)) & (made >= 0))
            best = best[np.r_[True, owner[best[1:]] != owner[best[:-1]]]] if len(best) else best
            symbols[best] = made[best]
            keep = np.repeat(~done, sizes)
            keep[best + 1] = False
            symbols, owner = symbols[keep], owner[keep]
        return first, count, second

    def _meet(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether symbols can stand side by side; foreign characters always can."""
        out = np.ones(len(left), bool)
        ask = np.flatnonzero((left >= 0) & (right >= 0))
        keys = left[ask] << 32 | right[ask]
        answers = self.known.get(keys)
        new = np.unique(keys[answers < 0])
        if len(new):
            pair = np.stack([new >> 32, new & 0xFFFFFFFF], axis=1).reshape(-1)
            sizes = self.char_sizes[pair]
            chars = self.chars[flat_ranges(self.char_starts[pair], sizes)]
            first, count, second = self._merged(chars, np.repeat(np.arange(len(pair)) // 2, sizes), len(new))
            good = (count == 2) & (first == pair[::2]) & (second == pair[1::2])
            if self.known.size + len(new) > REMEMBERED:
                self.known = Numbers()
            self.known.add(new, good.astype(np.int64))
            some = np.flatnonzero(answers < 0)
            answers[some] = good[np.searchsorted(new, keys[some])]
        out[ask] = answers == 1
        return out

    def _arcs(self, codes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, symbol) of all arcs of the composition, by length."""
        at, state, length, out = np.arange(len(codes)), np.zeros(len(codes), np.int64), 1, []
        while len(at):
            state = self.steps.get(state << 21 | codes[at + length - 1])
            if length == 1:
                foreign = at[state < 0]
                out.append((foreign, foreign + 1, np.full(len(foreign), FOREIGN)))
            live = state >= 0
            at, state = at[live], state[live]
            final = self.final[state]
            is_arc = final != NOTHING
            out.append((at[is_arc], at[is_arc] + length, final[is_arc]))
            length += 1
            inside = at + length <= ends[at]
            at, state = at[inside], state[inside]
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def paths(self, codes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Shortest paths of words, given as characters: (word, start, symbol) of
        their arcs in order."""
        count = len(bounds) - 1
        if not len(codes):
            return (np.zeros(0, np.int64),) * 3
        word = np.repeat(np.arange(count), np.diff(bounds))
        start, end, symbol = self._arcs(codes, bounds[word + 1])
        local = end - bounds[word[start]]
        order = np.lexsort((end, local))
        start, end, symbol, local = start[order], end[order], symbol[order], local[order]
        # a word has one place more than characters
        source, target = start + word[start], end + word[start]
        far = np.full(len(codes) + count, INFINITE)
        far[bounds[:-1] + np.arange(count)] = 0
        came, via = np.zeros(len(far), np.int64), np.full(len(far), NOTHING)
        steps = np.flatnonzero(np.r_[True, local[1:] != local[:-1]])
        for low, high in zip(steps.tolist(), [*steps[1:].tolist(), len(local)], strict=True):
            own, origin = symbol[low:high], source[low:high]
            weight = far[origin] + (1 if self.model_type == BPE else np.where(own < 0, FALLBACK_WEIGHT, self.weights[own]))
            if self.model_type == BPE:
                fits = np.flatnonzero(self.whole[own] & (weight < INFINITE))
                fits = fits[self._meet(via[origin[fits]], own[fits])]
                own, origin, weight, goal = own[fits], origin[fits], weight[fits], target[low:high][fits]
            else:
                goal = target[low:high]
            if not len(goal):
                continue
            heads = np.flatnonzero(np.r_[True, goal[1:] != goal[:-1]])
            least = np.minimum.reduceat(weight, heads)
            best = np.flatnonzero(weight == np.repeat(least, np.diff(np.r_[heads, len(goal)])))
            best = best[np.r_[True, goal[best[1:]] != goal[best[:-1]]]]
            far[goal[best]], came[goal[best]], via[goal[best]] = weight[best], origin[best], own[best]
        node, own, back = bounds[1:] + np.arange(count), np.arange(count), []
        own = own[node > bounds[own] + own]
        node = node[own]
        while len(own):
            back.append((own, came[node] - own, via[node]))
            node = came[node]
            more = node > bounds[own] + own
            own, node = own[more], node[more]
        word, start, symbol = (np.concatenate(x) for x in zip(*back, strict=True))
        order = np.argsort(start, kind="stable")
        return word[order], start[order], symbol[order]

    def words_to_ids(self, codes: np.ndarray, bounds: np.ndarray, most: int = AT_ONCE) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, given as characters, and the number of ids of each; words
        are taken in blocks of ``most`` characters, which bounds the arcs held."""
        edges = np.flatnonzero(np.diff(bounds[:-1] // most)) + 1
        parts = []
        for low, high in pairwise([0, *edges.tolist(), len(bounds) - 1]):
            own = bounds[low : high + 1]
            parts.append(self._block_to_ids(codes[own[0] : own[-1]], own - own[0]))
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))

    def _block_to_ids(self, codes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        word, start, symbol = self.paths(codes, bounds)
        spare = (symbol < 0) | (symbol >= len(self.pieces))
        sizes = np.ones(len(symbol), np.int64)
        chars, which = np.unique(codes[start[spare]], return_inverse=True)
        outputs = [[self.bytes_to_id[b] for b in chr(c).encode()] if self.bytes_to_id else [self.unknown] for c in chars.tolist()]
        lengths = np.array([len(x) for x in outputs], np.int64)
        sizes[spare] = lengths[which]
        ids = np.repeat(symbol, sizes)
        table = np.array([i for x in outputs for i in x], np.int64)
        ids[np.repeat(spare, sizes)] = table[flat_ranges((np.cumsum(lengths) - lengths)[which], lengths[which])]
        return ids.astype(np.int32), np.bincount(word, sizes, len(bounds) - 1).astype(np.int64)

    def encode_all(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of UTF-8 texts, and the bounds of the texts.

        No piece has the mark behind another character, so words (blanks and what
        follows them) are encoded apart, each distinct one once.
        """
        front, mark = b" " if self.mark_in_front else b"", MARK.encode()
        texts = [front + t.replace(mark, b" ") if t else t for t in texts]
        offsets = np.r_[0, np.cumsum([len(t) for t in texts])].astype(np.int64)
        joined = b"".join(texts)
        data = np.frombuffer(joined, np.uint8)
        begins = data == 32
        begins[1:] &= data[:-1] != 32
        begins[offsets[:-1][offsets[:-1] < len(data)]] = True
        starts = np.flatnonzero(begins)
        found = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.r_[starts, len(data)].astype(np.int64)), pa.py_buffer(joined)]).dictionary_encode()
        distinct = found.dictionary
        chars = b"".join(distinct.to_pylist()).decode().replace(" ", MARK)
        codes = np.frombuffer(chars.encode("utf-32-le"), np.uint32).astype(np.int64)
        sizes = np.array([len(w.decode()) for w in distinct.to_pylist()], np.int64)
        ids, counts = self.words_to_ids(codes, np.r_[0, np.cumsum(sizes)].astype(np.int64))
        which = found.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        per_word = counts[which]
        out = ids[flat_ranges((np.cumsum(counts) - counts)[which], per_word)]
        return out, np.r_[0, np.cumsum(per_word)].astype(np.int64)[np.searchsorted(starts, offsets)]

    def decode_all(self, ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        """Bytes of texts, given as ids."""
        sizes = self.spelled_sizes[ids]
        raw = self.spelled[flat_ranges(self.spelled_starts[ids], sizes)].tobytes()
        places = np.r_[0, np.cumsum(sizes)].astype(np.int64)[bounds].tolist()
        front = b" " if self.mark_in_front else b""
        return [raw[a:b].removeprefix(front) for a, b in zip(places[:-1], places[1:], strict=True)]

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text.encode()])[0]

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids; bytes that are no UTF-8 become replacement characters."""
        return self.decode_all(np.asarray(ids), np.array([0, len(ids)]))[0].decode("utf-8", "replace")

    def shortest(self, text: str) -> list[str]:
        """Pieces, and characters left to byte fallback, of one normalised word."""
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
        _, start, _ = self.paths(codes, np.array([0, len(codes)]))
        return [text[a:b] for a, b in zip(start.tolist(), [*start[1:].tolist(), len(text)], strict=True)]


def compile_model(path: str = MODEL) -> Transducer:
    """Transducer of a model file with the identity normaliser."""
    with open(path, "rb") as file:
        raw = file.read()
    pieces, scores, kinds, model_type, front = [], [], [], UNIGRAM, True
    for number, value in _fields(raw):
        if number == 1:
            piece = dict(_fields(value))
            pieces.append(piece[1].decode())
            scores.append(unpack("<f", piece.get(2, pack("<f", 0)))[0])
            kinds.append(piece.get(3, 1))
        elif number == 2:
            model_type = dict(_fields(value)).get(3, UNIGRAM)
        elif number == 3:
            spec = dict(_fields(value))
            front = bool(spec.get(3, 1))
            if spec.get(2) or spec.get(4, 1):
                raise ValueError("only the identity normaliser without blank removal is compiled")
    if any(MARK in p.lstrip(MARK) for p, k in zip(pieces, kinds, strict=True) if k not in (BYTE, UNKNOWN, CONTROL)):
        raise ValueError("pieces with the mark behind other characters are not supported")
    return Transducer(pieces, scores, kinds, model_type, front)


_compiled: dict[str, Transducer] = {}


def _encoded(batch: pa.RecordBatch, path: str, with_ids: bool) -> pa.RecordBatch:
    if path not in _compiled:
        _compiled[path] = compile_model(path)
    model = _compiled[path]
    texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
    ids, bounds = model.encode_all(texts)
    same = [a == b for a, b in zip(model.decode_all(ids, bounds), texts, strict=True)]
    fallback = np.r_[0, np.cumsum(model.is_byte[ids])][bounds]
    raw, places = ids.astype("<i4").tobytes(), (4 * bounds).tolist()
    digests = [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(places[:-1], places[1:], strict=True)]
    made = {"n_tokens": pa.array(np.diff(bounds)), "n_byte_tokens": pa.array(np.diff(fallback)), "ids_sha256": pa.array(digests, pa.string()), "round_trip": pa.array(same, pa.bool_())}
    if with_ids:
        made["ids"] = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids))
    kept = {n: batch.column(n) for n in batch.schema.names if n != "text" and n not in made}
    return pa.record_batch(list((kept | made).values()), names=list(kept | made))


def encode(docs: DataFrame, path: str = MODEL, with_ids: bool = True) -> DataFrame:
    """Encode every whole text, decode it again and compare.

    The text is replaced by n_tokens, n_byte_tokens (byte fallback), ids_sha256
    (of the ids as 32-bit little-endian numbers), round_trip (decoding gives the
    text again) and, with ``with_ids``, ids. Null texts count as empty: no ids.
    Rows are taken one by one, so repeated rows and null ids give rows of their
    own. Columns of these names are replaced, other columns are kept. A text that
    itself holds the piece mark U+2581 decodes with blanks there, as in any model
    of this kind. ``path`` must be readable on all machines.
    """
    extra = "n_tokens bigint, n_byte_tokens bigint, ids_sha256 string, round_trip boolean" + ", ids array<int>" * with_ids
    made = {x.split()[0] for x in extra.split(", ")}
    kept = [f"`{n}` {t}" for n, t in docs.dtypes if n != "text" and n not in made]
    return words.map_texts(docs, partial(_encoded, path=path, with_ids=with_ids), ", ".join([*kept, extra]), PIECE)
