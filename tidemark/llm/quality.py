"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages. Each passage is encoded by a small network, gated attention weighs the
encodings (tanh and sigmoid branches, softmax over the document's passages), and a logistic unit scores their
weighted sum. Only documents have labels; encoder, attention and scorer are learned from those together.

Training reads a bounded sample of labelled rows, each with all its passages, and so runs on the driver; scoring
is a pass over all rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.arrays import LOWER, SPACE, Rolling, pieces, words
from tidemark.llm.spread import cut

#: Words of a passage.
PASSAGE_WORDS = 64
#: Labelled rows that training takes at most, and passages of all of them after which it takes no more rows.
SAMPLE_ROWS, SAMPLE_PASSAGES = 6_000, 144_000
HIDDEN, ATTENTION, EPOCHS, BATCH, SEED = 24, 12, 30, 256, 5
#: Share of passages' words that are hashed into that many slots.
SLOTS = 32

#: Classes of bytes whose share of a passage is a feature.
CLASSES = (
    b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n", b".", b",", b"!", b"?", b"|", b"#$%&*", b"@", b"<>", b"=_+",
    b"()[]{}", b"'\"`", b"-:;/\\~^", bytes(range(0x80, 0x100)), bytes([*range(0, 9), *range(11, 32), 127]),
)
CLASS_OF = np.zeros(256, np.int64)
for _i, _bytes in enumerate(CLASSES):
    CLASS_OF[list(_bytes)] = _i
N_FEATURES = len(CLASSES) + 8 + SLOTS


def encode(data: np.ndarray, ends: np.ndarray, passage: int = PASSAGE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Features of each passage of some texts, and the offsets of each text's passages; a text has one at least."""
    start, end, offsets = words(data, ends, SPACE)
    sizes = np.diff(offsets)
    n = np.maximum(1, -(-sizes // passage))
    first = np.concatenate([[0], np.cumsum(n)])
    rank = np.arange(len(start)) - np.repeat(offsets[:-1], sizes)
    of_word = np.repeat(first[:-1], sizes) + rank // passage
    total = first[-1]
    opens = np.flatnonzero(rank % passage == 0)
    change = np.zeros(len(data) + 1, np.int64)  # a byte belongs to the passage of the last word that began
    np.add.at(change, ends[:-1], 1)
    np.add.at(change, start[opens[rank[opens] > 0]], 1)
    of_byte = np.cumsum(change[: len(data)]) - 1
    counts = np.bincount(of_byte * len(CLASSES) + CLASS_OF[data], minlength=total * len(CLASSES))[: total * len(CLASSES)].reshape(total, -1)
    size, length = np.maximum(counts.sum(1), 1), (end - start).astype(float)
    n_words = np.bincount(of_word, minlength=total)
    per = lambda x: np.bincount(of_word, weights=x, minlength=total) / np.maximum(n_words, 1)
    mean = per(length)
    key = Rolling(LOWER[data]).at(start, end)
    order = np.lexsort((key, of_word))
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(key[order]) != 0) | (np.diff(of_word[order]) != 0)
    distinct = np.bincount(of_word[order][new], minlength=total) / np.maximum(n_words, 1)
    slots = np.bincount(of_word * SLOTS + (key % np.uint64(SLOTS)).astype(np.int64), minlength=total * SLOTS).reshape(total, SLOTS)
    last, head = data[end - 1] if len(end) else data[:0], data[start] if len(start) else data[:0]
    upper = (head >= 65) & (head <= 90)
    shout = upper & (length > 1) & (data[np.minimum(start + 1, max(len(data) - 1, 0))] <= 90) if len(start) else upper
    symbol = per((CLASS_OF[last] >= 7).astype(float)) if len(start) else np.zeros(total)
    stats = [mean / 8, np.sqrt(np.maximum(per(length**2) - mean**2, 0)) / 8, per((length <= 2).astype(float)), distinct, per(upper.astype(float)), per(shout.astype(float)), symbol, np.log1p(n_words) / 5]
    return np.column_stack([np.sqrt(counts / size[:, None]), *stats, np.sqrt(slots / np.maximum(n_words, 1)[:, None])]).astype(np.float32), first


def softmax_in(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    n = np.diff(first)
    e = np.exp(x - np.repeat(np.maximum.reduceat(x, first[:-1]), n))
    return e / np.repeat(np.add.reduceat(e, first[:-1]), n)


class Model:
    """Encoder, gated attention and scorer; forward and backward passes over bags that lie side by side."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, seed: int = SEED):
        rng = np.random.default_rng(seed)
        draw = lambda a, b: (rng.standard_normal((a, b)) / np.sqrt(a)).astype(np.float32)
        self.mean, self.scale = mean, scale
        self.p = {"E": draw(N_FEATURES, HIDDEN), "e": np.zeros(HIDDEN, np.float32), "V": draw(HIDDEN, ATTENTION), "U": draw(HIDDEN, ATTENTION), "w": draw(ATTENTION, 1)[:, 0], "c": np.zeros(HIDDEN, np.float32), "b": np.zeros(1, np.float32)}

    def forward(self, x: np.ndarray, first: np.ndarray) -> tuple:
        p, x = self.p, np.clip((x - self.mean) / self.scale, -6, 6)
        h = np.tanh(x @ p["E"] + p["e"])
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        a = softmax_in((t * g) @ p["w"], first)
        z = np.add.reduceat(a[:, None] * h, first[:-1], axis=0)
        return x, h, t, g, a, z, 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["b"], -30, 30)))

    def gradient(self, raw: np.ndarray, first: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        x, h, t, g, a, z, s = self.forward(raw, first)
        n, d = np.diff(first), ((s - y) * weight / weight.sum()).astype(np.float32)
        dz = d[:, None] * p["c"]
        da = np.einsum("ij,ij->i", h, np.repeat(dz, n, axis=0))
        du = a * (da - np.repeat(np.add.reduceat(a * da, first[:-1]), n))
        dt, dg = du[:, None] * p["w"] * g * (1 - t * t), du[:, None] * p["w"] * t * g * (1 - g)
        dh = (a[:, None] * np.repeat(dz, n, axis=0) + dt @ p["V"].T + dg @ p["U"].T) * (1 - h * h)
        return {"E": x.T @ dh, "e": dh.sum(0), "V": h.T @ dt, "U": h.T @ dg, "w": (t * g).T @ du, "c": z.T @ d, "b": d.sum(keepdims=True)}


def fit(bags: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> Model:
    """Adam on the cross-entropy of documents. Both labels weigh the same; with one label only, the model says just that."""
    if not bags:
        return Model(np.zeros(N_FEATURES, np.float32), np.ones(N_FEATURES, np.float32), seed)
    every = np.concatenate(bags)
    model = Model(every.mean(0), every.std(0) + np.float32(0.02), seed)
    share = np.clip(labels.mean(), 0.02, 0.98)
    weight = np.where(labels == 1, np.sqrt(0.5 / share), np.sqrt(0.5 / (1 - share))).astype(np.float32)
    rng, step = np.random.default_rng(seed), 0
    m, v = ({k: np.zeros_like(x) for k, x in model.p.items()} for _ in range(2))
    for epoch in range(epochs):
        rate = 0.01 * (1 - epoch / epochs) + 5e-4
        order = rng.permutation(len(bags))
        for at in range(0, len(order), BATCH):
            own, step = order[at : at + BATCH], step + 1
            x = np.concatenate([bags[i] for i in own])
            first = np.concatenate([[0], np.cumsum([len(bags[i]) for i in own])])
            for k, grad in model.gradient(x, first, labels[own].astype(np.float32), weight[own]).items():
                grad = grad + 1e-4 * model.p[k] * (k in "EVUc")
                m[k], v[k] = 0.9 * m[k] + 0.1 * grad, 0.999 * v[k] + 0.001 * grad**2
                model.p[k] = (model.p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return model


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_ROWS, label: str = "quality", fold: F.Column | None = None) -> Model:
    """A model from at most ``sample`` labelled documents: those whose hashed ids are least, so that any size of input is sampled evenly.

    fold: a condition on doc_id that rows must meet to be learned from. Null labels and ids are left out; of
    several labels of one document the least counts, as does the text that comes first in order. Rows are taken
    with all passages, until SAMPLE_PASSAGES are reached.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    known = known.where(fold) if fold is not None else known
    known = known.groupBy("doc_id").agg(F.min(label).cast("int").alias("y"))
    chosen = known.orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id").limit(sample)  # a bounded sample
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("y").alias("y"), F.min("text").alias("text"))
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("y", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("bag", T.BinaryType())])

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, data, ends in pieces(batch):
                x, first = encode(data, ends)
                out = [x[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
                yield pa.record_batch([piece.column("doc_id"), piece.column("y"), pa.array(np.diff(first)), pa.array(out, pa.binary())], schema.names)

    place = F.struct(F.xxhash64("doc_id", F.lit(SEED)).alias("h"), "doc_id")
    whole = cut(texts.select("doc_id", "y", "text").mapInArrow(bags, schema).withColumn("place", place))
    sizes = whole.select("place", "n").orderBy("place").collect()
    before = np.cumsum([0, *(r.n for r in sizes)])[:-1]
    if (taken := int((before < SAMPLE_PASSAGES).sum())) < len(sizes):
        h, last = sizes[taken - 1].place
        whole = whole.where((F.col("place.h") < h) | ((F.col("place.h") == h) & (F.col("place.doc_id") <= last)))
    rows = whole.orderBy("doc_id").select("y", "bag").collect()
    return fit([np.frombuffer(r.bag, np.float32).reshape(-1, N_FEATURES) for r in rows], np.array([r.y for r in rows]))


def score(docs: DataFrame, model: Model, into: str = "score") -> DataFrame:
    """docs with the model's score of each whole text added: 0 to 1, higher if label 1 is likelier.

    A null or empty text is one passage without words and gets a score, too. Rows are judged alone; repeats,
    ties and empty tables need no rule. A column that already has the name is replaced.
    """
    kept = docs.drop(into)
    columns, sent = kept.columns, docs.sparkSession.sparkContext.broadcast(model)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, data, ends in pieces(batch):
                x, first = encode(data, ends)
                s = sent.value.forward(x, first)[-1].astype(float) if len(piece) else np.zeros(0)
                yield pa.record_batch([*piece.columns, pa.array(s)], [*columns, into])

    return kept.mapInArrow(add, kept.withColumn(into, F.lit(0.0)).schema)
