"""Quality of texts by a byte-level convolutional network in numpy."""

from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from assayer.llm import words

CHUNK, STEP = 256, 192
WIDTH, DEPTH, FILTERS, STRIDE = 8, 4, 24, 2
SAMPLE, EPOCHS = 4000, 8
AT_ONCE = 256


@dataclass
class Network:
    """Byte embedding, filters over ``WIDTH`` bytes, and a logistic combination of
    the filters' largest and mean answers over the chunks of a text."""

    embedding: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    weights: np.ndarray
    offset: float

    def windows(self, chunks: np.ndarray) -> np.ndarray:
        """(chunk, position, WIDTH * DEPTH) inputs of the filters."""
        flat = self.embedding[chunks].reshape(len(chunks), -1)
        view = np.lib.stride_tricks.sliding_window_view(flat, WIDTH * DEPTH, axis=1)[:, :: STRIDE * DEPTH]
        return np.ascontiguousarray(view)

    def pooled(self, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest answer of each filter in each chunk, not below 0, and where."""
        best, at = np.empty((len(chunks), FILTERS), self.filters.dtype), np.empty((len(chunks), FILTERS), np.int64)
        for low in range(0, len(chunks), AT_ONCE):
            own = chunks[low : low + AT_ONCE]
            answers = (self.windows(own).reshape(-1, WIDTH * DEPTH) @ self.filters).reshape(len(own), -1, FILTERS)
            at[low : low + AT_ONCE] = answers.argmax(axis=1)
            best[low : low + AT_ONCE] = answers.max(axis=1)
        return np.maximum(best + self.bias, 0), at

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Probability of good quality of each text."""
        rows = [(offsets[i], offsets[i + 1]) for i in range(len(offsets) - 1)]
        starts, ends, owner = _layout(np.array(rows, np.int64).reshape(-1, 2))
        best = np.empty((len(starts), FILTERS), np.float32)
        for i in range(0, len(starts), AT_ONCE):
            best[i : i + AT_ONCE], _ = self.pooled(_cut(data, starts[i : i + AT_ONCE], ends[i : i + AT_ONCE]))
        features = _combine(best, owner, len(rows))
        return 1 / (1 + np.exp(-np.clip(features @ self.weights + self.offset, -30, 30)))


def _layout(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping chunks that cover each text [start, end): one at least."""
    counts = np.maximum(1, -(-(rows[:, 1] - rows[:, 0] - (CHUNK - STEP)) // STEP)) if len(rows) else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(rows)), counts)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    return rows[owner, 0] + number * STEP, rows[owner, 1], owner


def _cut(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    at = starts[:, None] + np.arange(CHUNK)
    inside = at < ends[:, None]
    if not len(data):
        return np.zeros(at.shape, np.uint8)
    return np.where(inside, data[np.minimum(at, len(data) - 1)], 0).astype(np.uint8)


def _combine(best: np.ndarray, owner: np.ndarray, texts: int) -> np.ndarray:
    first = np.searchsorted(owner, np.arange(texts))
    counts = np.bincount(owner, minlength=texts)[:, None]
    if not texts:
        return np.zeros((0, 2 * FILTERS), np.float32)
    return np.concatenate([np.maximum.reduceat(best, first), np.add.reduceat(best, first) / counts], axis=1)


def gradients(net: Network, chunks: np.ndarray, owner: np.ndarray, labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean logistic loss of texts, given as chunks with their text's number, and its
    gradients. Only the place at which a filter answers most passes a gradient on."""
    best, at = net.pooled(chunks)
    sizes = np.bincount(owner, minlength=len(labels))
    features = _combine(best, owner, len(labels))
    z = np.clip(features @ net.weights + net.offset, -30, 30)
    loss = float(np.mean(np.logaddexp(0, z) - labels * z))
    error = ((1 / (1 + np.exp(-z)) - labels) / len(labels)).astype(net.filters.dtype)
    back = error[:, None] * net.weights
    top = best == features[owner, :FILTERS]
    # of equal chunks the first one counts
    first = np.full(features[:, :FILTERS].shape, len(chunks))
    np.minimum.at(first, owner, np.where(top, np.arange(len(chunks))[:, None], len(chunks)))
    top = np.arange(len(chunks))[:, None] == first[owner]
    grad = (top * back[owner, :FILTERS] + back[owner, FILTERS:] / sizes[owner][:, None]) * (best > 0)
    spread = chunks[np.arange(len(chunks))[:, None, None], (at * STRIDE)[:, :, None] + np.arange(WIDTH)]
    inputs = net.embedding[spread].reshape(len(chunks), FILTERS, WIDTH * DEPTH)
    to_input = (grad[:, :, None] * net.filters.T[None]).reshape(-1, DEPTH)
    to_byte = np.stack([np.bincount(spread.reshape(-1), to_input[:, d], 256) for d in range(DEPTH)], axis=1)
    return loss, {
        "embedding": to_byte.astype(net.filters.dtype), "filters": np.einsum("cfi,cf->if", inputs, grad), "bias": grad.sum(axis=0),
        "weights": features.T @ error, "offset": float(error.sum()),
    }


def fit(chunks: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, rate: float = 0.01, seed: int = 7) -> Network:
    """Train on all chunks of each text and its label, 1 for good.

    Logistic loss, Adam steps over batches of 32 texts.
    """
    rng = np.random.default_rng(seed)
    f32 = np.float32
    net = Network(rng.normal(0, 0.5, (256, DEPTH)).astype(f32), rng.normal(0, 0.2, (WIDTH * DEPTH, FILTERS)).astype(f32), np.zeros(FILTERS, f32), rng.normal(0, 0.1, 2 * FILTERS).astype(f32), 0.0)
    share = float(np.clip(labels.mean() if len(labels) else 0.5, 0.01, 0.99))
    net.offset = float(np.log(share / (1 - share)))
    if not len(labels) or labels.min() == labels.max():
        net.weights[:] = 0
        return net
    names = ("embedding", "filters", "bias", "weights")
    moments = {n: [np.zeros_like(getattr(net, n)), np.zeros_like(getattr(net, n))] for n in names} | {"offset": [0.0, 0.0]}
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(labels))
        pace = rate * (1 - epoch / epochs)
        for low in range(0, len(order), 32):
            pick = order[low : low + 32]
            owner = np.repeat(np.arange(len(pick)), [len(chunks[i]) for i in pick])
            _, grads = gradients(net, np.concatenate([chunks[i] for i in pick]), owner, labels[pick])
            step += 1
            for name, g in grads.items():
                m, v = moments[name]
                m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
                moments[name] = [m, v]
                change = pace * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
                setattr(net, name, getattr(net, name) - (change.astype(f32) if name != "offset" else float(change)))
    return net


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def cut_text(raw: bytes) -> np.ndarray:
    """All overlapping chunks of a text, one at least."""
    data = np.frombuffer(raw, np.uint8)
    starts, ends, _ = _layout(np.array([[0, len(data)]], np.int64))
    return _cut(data, starts, ends)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Network:
    """Fit a network on the whole texts of at most ``sample`` labelled documents.

    The sample is chosen by a hash of doc_id among the labelled rows that are not
    held out; its size is a parameter, and its texts are what reaches the driver.
    Labels of one document are averaged; null ids and null labels are left out.
    Without labels of both kinds every score is the same number.
    """
    rows = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg((F.avg("quality") >= 0.5).cast("int").alias("label"))
    rows = rows.where(~F.coalesce(held_out(F.col("doc_id")), F.lit(False))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    picked = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(rows), "doc_id")
    got = picked.select("doc_id", "label", "text").orderBy("doc_id", "text").collect()
    return fit([cut_text(r.text.encode()) for r in got], np.array([r.label for r in got], np.float32))


def _scored(batch: pa.RecordBatch, network: Network, name: str) -> pa.RecordBatch:
    data, offsets = words.text_bytes(batch.column("text"))
    scores = pa.array(network.score(data, offsets).astype(np.float64))
    keep = [n for n in batch.schema.names if n != name]
    return pa.record_batch([*[batch.column(n) for n in keep], scores], names=[*keep, name])


def score(docs: DataFrame, network: Network, name: str = "score") -> DataFrame:
    """Add the probability that a text is good; only the bytes of ``text`` count.

    The network sees the whole text in overlapping chunks. Null texts count as
    empty, which is one blank chunk. Repeated rows each get their score. A column
    called ``name`` is replaced.
    """
    fields = [f for f in docs.schema.fields if f.name != name]
    schema = T.StructType([*fields, T.StructField(name, T.DoubleType())])
    return words.map_texts(docs, partial(_scored, network=network, name=name), schema)


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """Documents whose score is ``least`` or more, by a network fitted on them."""
    name = "__quality"
    return score(docs, train(docs, labels), name).where(F.col(name) >= least).select(*docs.columns)
