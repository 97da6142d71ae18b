"""Hidden Markov language model: Baum-Welch counts added up over partitions, scaled forward recursion.

States emit word classes. The commonest words are a class each, the others share classes by hash, and the end
of a text is a class. A word's probability is that of its class times its share of the class, which comes from
its count over all training texts; each shared class keeps room for one unknown word. So the model is a
distribution over texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.arrays import LOWER, Rolling, pieces, signed, words
from tidemark.llm.spread import cut, partitions, scratch

#: Words share classes by their hash's lowest bits, so the number of shared classes is a power of two.
STATES, OWN_CLASSES, SHARED_CLASSES = 8, 255, 256
#: Rounds of Baum-Welch; tokens of texts that run side by side in it, and of a segment of time that is held at once.
ROUNDS, TOGETHER, SEGMENT, SEED = 3, 1 << 19, 1 << 17, 11
#: Different words that a task counts before it passes the counts on.
HELD_WORDS = 1 << 19
#: Counts of so many of the commonest words are sent to every task; the others are joined.
SENT_WORDS = 200_000
END = OWN_CLASSES + SHARED_CLASSES
CLASSES = END + 1
SMOOTH = 0.01
#: Hash of a text's end among those of words.
END_HASH = np.uint64(0x5EED_0000_0000_0E0D)


def word_hashes(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    data = LOWER[data]
    start, end, offsets = words(data, ends)
    return Rolling(data).at(start, end), offsets


class Classes:
    """Classes of words, and the counts of the commonest."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, end_count: int):
        """hashes and counts: of the commonest words, by falling count."""
        own = np.full(len(hashes), -1, np.int64)
        own[:OWN_CLASSES] = np.arange(min(len(own), OWN_CLASSES))
        order = np.argsort(hashes)
        self.hashes, self.counts, self.own, self.end_count = hashes[order], counts[order], own[order], end_count

    def of(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class and count of each word; the count is -1 if it isn't among the commonest."""
        if not len(self.hashes):
            return OWN_CLASSES + (key % np.uint64(SHARED_CLASSES)).astype(np.int64), np.full(len(key), -1)
        at = np.minimum(np.searchsorted(self.hashes, key), len(self.hashes) - 1)
        known = self.hashes[at] == key
        own = np.where(known, self.own[at], -1)
        return np.where(own >= 0, own, OWN_CLASSES + (key % np.uint64(SHARED_CLASSES)).astype(np.int64)), np.where(known, self.counts[at], -1)


class Model:
    """Start, transition and emission probabilities."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit

    @classmethod
    def first(cls, mass: np.ndarray, seed: int = SEED) -> Model:
        """Every state near the classes' frequencies, but not the same, and states that last."""
        rng = np.random.default_rng(seed)
        emit = mass / mass.sum() * rng.lognormal(0, 0.5, (STATES, len(mass)))
        move = np.full((STATES, STATES), 0.2 / (STATES - 1))
        np.fill_diagonal(move, 0.8)
        return cls(np.full(STATES, 1 / STATES), move, emit / emit.sum(1, keepdims=True))

    @classmethod
    def of_counts(cls, counts: np.ndarray, mass: np.ndarray) -> Model:
        """From expected counts, smoothed: emissions towards the classes' frequencies, so that none is impossible."""
        start, move, emit = np.split(counts, [STATES, STATES + STATES**2])
        start = start + SMOOTH
        move = move.reshape(STATES, STATES) + SMOOTH
        emit = emit.reshape(STATES, -1) + SMOOTH + mass / mass.sum()
        return cls(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True))

    def expected(self, tokens: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Expected counts of starts, moves and emissions, by forward and backward recursion over whole texts.

        Texts run side by side, the longest first. The forward pass keeps its state where a segment of time
        begins; going back, each segment is run forward again from there, so that memory is bounded by a segment,
        however long a text is. The backward state is carried from segment to segment.
        """
        order = np.argsort(-np.diff(ends), kind="stable")
        begin, size = ends[:-1][order], np.diff(ends)[order]
        active = np.searchsorted(-size, -np.arange(1, int(size.max(initial=0)) + 1), side="right")
        if not len(active):
            return np.zeros(STATES + STATES**2 + STATES * CLASSES)
        emit = np.ascontiguousarray(self.emit.T)
        cells = np.concatenate([[0], np.cumsum(active)])
        cuts = np.unique([*np.searchsorted(cells, np.arange(0, cells[-1], SEGMENT)), len(active)]).tolist()

        def forward(low: int, high: int, state: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            for t in range(low, high):
                seen = tokens[begin[: active[t]] + t]
                state = (state[: active[t]] @ self.move if t else np.tile(self.start, (active[t], 1))) * emit[seen]
                scale = state.sum(1, keepdims=True)
                state = state / scale
                yield state, scale, seen

        begins = [np.zeros((0, STATES))]
        for low, high in zip(cuts[:-2], cuts[1:-1], strict=True):  # not the last, from which the way back begins
            for state, _, _ in forward(low, high, begins[-1]):  # noqa: B007
                pass
            begins.append(state)
        start, move, by_class = np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((STATES, CLASSES))
        ahead = np.zeros((0, STATES))  # of the next step: backward state times emission over scale
        for low, high, state in zip(cuts[-2::-1], cuts[:0:-1], begins[::-1], strict=True):
            steps, shares = list(forward(low, high, state)), []
            for t in range(high - 1, low - 1, -1):
                now, scale, seen = steps[t - low]
                back = np.ones_like(now)
                n = len(ahead)
                if n:
                    move += now[:n].T @ ahead
                    back[:n] = ahead @ self.move.T
                shares.append(now * back)
                ahead = back * emit[seen] / scale
            share, at = np.concatenate(shares), np.concatenate([x[2] for x in steps[::-1]])
            for k in range(STATES):
                by_class[k] += np.bincount(at, weights=share[:, k], minlength=CLASSES)
            if low == 0:
                start = shares[-1].sum(0)
        return np.concatenate([start, (move * self.move).ravel(), by_class.ravel()])

    def log10(self, tokens: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The probability of each text's classes, by the scaled forward recursion over the whole text."""
        order = np.argsort(-np.diff(ends), kind="stable")
        begin, size = ends[:-1][order], np.diff(ends)[order]
        total, emit = np.zeros(len(order)), np.ascontiguousarray(self.emit.T)
        live = int((size > 0).sum())
        state = np.tile(self.start, (live, 1))
        active = np.searchsorted(-size, -np.arange(1, int(size.max(initial=0)) + 1), side="right")
        for t, n in enumerate(active):
            state = state[:n] @ self.move if t else state[:n]
            state = state * emit[tokens[begin[:n] + t]]
            scale = state.sum(1)
            state /= scale[:, None]
            total[:n] += np.log10(scale)
        out = np.empty(len(order))
        out[order] = total
        return out


def groups(ends: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of texts of about so many tokens; a longer text is one of its own."""
    at = 0
    while at < len(ends) - 1:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, side="right")) - 1)
        yield at, to
        at = to


def score_texts(docs: DataFrame, learn: Column, rounds: int = ROUNDS, sent: int = SENT_WORDS) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of every whole text, learned from the rows that meet ``learn``.

    Tokens are ASCII-lower-cased words and one end a text; null and empty texts are an end alone. base_score adds
    log10((c + 1) / (N + 1 * (V + 1))) over tokens; score is the model's log10 probability of the text. Rows
    are scored alone, repeated ids or not; null ids are kept. Very long texts are learned from and scored whole,
    like any other. Other columns are left out. An empty table gives an empty result; with nothing to learn from,
    every word is unknown.
    """
    spark = docs.sparkSession
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(learn, F.lit(False)).alias("train"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def summed() -> tuple[np.ndarray, np.ndarray]:
            key, back = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            return key, np.bincount(back, weights=np.concatenate([n for _, n in held])).astype(np.int64)

        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for batch in batches:
            for _, data, ends in pieces(batch):
                key, offsets = word_hashes(data, ends)
                held.append(np.unique(np.concatenate([key, np.full(len(offsets) - 1, END_HASH)]), return_counts=True))
                size += len(held[-1][0])
                if size > HELD_WORDS:
                    held = [summed()]
                    size = len(held[0][0])
                    if size > HELD_WORDS // 2:
                        yield pa.record_batch([signed(held[0][0]), pa.array(held[0][1])], ["h", "n"])
                        held, size = [], 0
        if held:
            key, n = summed()
            yield pa.record_batch([signed(key), pa.array(n)], ["h", "n"])

    # A task adds up its own counts, so they go to the shuffle as they are, into as many partitions as the input asks for.
    n_parts = partitions(base)
    counts = cut(base.where("train").select("text").mapInArrow(count, "h long, n long").repartition(n_parts, "h").groupBy("h").agg(F.sum("n").alias("n")))
    end = int(END_HASH.view(np.int64))
    n_all, n_words, n_end = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1)), F.coalesce(F.sum(F.when(F.col("h") == end, F.col("n"))), F.lit(0))).first()
    top = counts.where(F.col("h") != end).orderBy(F.desc("n"), "h").limit(sent).toArrow()  # bounded
    hashes, numbers = np.asarray(top.column("h")).view(np.uint64) if top.num_rows else np.zeros(0, np.uint64), np.asarray(top.column("n"))
    classes = Classes(hashes, numbers, n_end)
    least = int(numbers.min()) if len(numbers) else 0
    # The mass of each class: counts plus one for its words, and one for words unknown if words share it.
    number = F.col("h").bitwiseAND(SHARED_CLASSES - 1).cast("int")
    shared = {r["g"]: r["m"] for r in counts.where(F.col("h") != end).groupBy(number.alias("g")).agg(F.sum(F.col("n") + 1).alias("m")).collect()}
    mass = np.ones(CLASSES)
    for g, m in shared.items():
        mass[OWN_CLASSES + g] += m
    own = min(OWN_CLASSES, len(hashes))
    mass[:own] = numbers[:own] + 1
    np.subtract.at(mass, OWN_CLASSES + (hashes[:own] % np.uint64(SHARED_CLASSES)).astype(np.int64), numbers[:own] + 1)
    mass[END] = n_end + 1
    known = spark.sparkContext.broadcast((classes, np.log10(mass)))
    fields = [("doc_id", T.LongType()), ("train", T.BooleanType()), ("n_tokens", T.LongType()), ("n_known", T.LongType()), ("log_counts", T.DoubleType()), ("log_masses", T.DoubleType()), ("tokens", T.BinaryType()), ("rare", T.ArrayType(T.LongType())), ("times", T.ArrayType(T.LongType()))]
    schema = T.StructType([T.StructField(*f) for f in fields])

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, log_mass = known.value
        for batch in batches:
            for piece, data, ends in pieces(batch):
                key, offsets = word_hashes(data, ends)
                of_class, n = own.of(key)
                with_end = np.insert(of_class, offsets[1:], END).astype(np.uint16)
                bounds = offsets + np.arange(len(offsets))
                per = lambda x, at=offsets: np.diff(np.concatenate([[0], np.cumsum(x)])[at])
                rare = [np.unique(key[a:b][n[a:b] < 0].view(np.int64), return_counts=True) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                end_known = int(own.end_count > 0)
                columns = [
                    piece.column("doc_id"), piece.column("train"), pa.array(np.diff(bounds)), pa.array(per(n >= 0).astype(np.int64) + end_known),
                    pa.array(per(np.where(n >= 0, np.log10(np.maximum(n, 0) + 1.0), 0.0)) + math.log10(own.end_count + 1)), pa.array(per(log_mass[with_end], bounds)),
                    pa.array([with_end[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary()), *(pa.array([r[i].tolist() for r in rare], pa.list_(pa.int64())) for i in (0, 1)),
                ]
                yield pa.record_batch(columns, schema.names)

    texts = cut(base.mapInArrow(classify, schema).withColumn("row", F.monotonically_increasing_id()))

    def tokens_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        raw = [np.frombuffer(t.as_py(), np.uint16) for t in column]
        return np.concatenate([*raw, np.zeros(0, np.uint16)]), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)

    model = Model.first(mass)
    for _ in range(rounds if n_all else 0):
        now = spark.sparkContext.broadcast(model)

        def gather(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            total = np.zeros(STATES + STATES**2 + STATES * CLASSES)
            for batch in batches:
                column = batch.column("tokens")
                by_length = np.argsort(np.asarray(pc.binary_length(column)), kind="stable")  # so that texts side by side end together
                tokens, ends = tokens_of(column.take(pa.array(by_length)))
                for a, b in groups(ends, TOGETHER):
                    total += now.value.expected(tokens[ends[a] : ends[b]], ends[a : b + 1] - ends[a])
            yield pa.record_batch([pa.array(np.arange(len(total))), pa.array(total)], ["slot", "v"])

        rows = texts.where("train").select("tokens").mapInArrow(gather, "slot long, v double").groupBy("slot").agg(F.sum("v").alias("v")).toArrow()
        counted = np.zeros(STATES + STATES**2 + STATES * CLASSES)
        counted[np.asarray(rows.column("slot"))] = np.asarray(rows.column("v"))
        model = Model.of_counts(counted, mass)
    final = spark.sparkContext.broadcast(model)
    out = ["row", "doc_id", "n_tokens", "n_known", "log_counts", "log_masses"]

    def recur(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([*(batch.column(c) for c in out), pa.array(final.value.log10(*tokens_of(batch.column("tokens"))))], [*out, "model"])

    scored = texts.select(*out, "tokens").mapInArrow(recur, "row long, doc_id long, n_tokens long, n_known long, log_counts double, log_masses double, model double")
    rare = texts.select("row", F.explode(F.arrays_zip("rare", "times")).alias("w")).select("row", F.col("w.rare").alias("h"), F.col("w.times").alias("times")).repartition(n_parts, "h")
    found = rare.join(counts.where(F.col("n") <= least).repartition(n_parts, "h"), "h").groupBy("row").agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("extra"))
    logs = F.col("log_counts") + F.coalesce("extra", F.lit(0.0))
    return scored.join(found, "row", "left").select(
        "doc_id",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(int(n_all)).cast("long").alias("train_tokens"),
        (logs - F.col("n_tokens") * math.log10(n_all + n_words + 1)).alias("base_score"),
        (F.col("model") + logs - F.col("log_masses")).alias("score"),
    )
