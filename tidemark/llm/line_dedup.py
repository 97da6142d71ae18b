"""Line dedup over content-defined chunks of lines.

A rolling hash over the hashes of neighbouring lines chooses where a chunk ends, so that an insertion shifts
no boundary but the nearest. Chunks of two lines or more that come up again anywhere in the corpus are
removed, all but the first. Equality is that of the bytes: Spark groups chunks by their text itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.arrays import Rolling, mix, pieces
from tidemark.llm.spread import order_key, partitions

#: Lines that the rolling hash sees, mean lines of a chunk, fewest lines that are removed together.
ROLL_LINES, MEAN_LINES, LEAST_LINES = 2, 4, 2
NEWLINE = ord("\n")


def line_bounds(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each line (without its newline), and the offsets of each text's lines; an empty text has one."""
    cuts = np.flatnonzero(data == NEWLINE)
    start = np.sort(np.concatenate([ends[:-1], cuts + 1]), kind="stable")
    # a text that ends in a newline has an empty last line, which starts where the next text does
    stop = np.sort(np.concatenate([ends[1:], cuts]), kind="stable")
    offsets = np.concatenate([[0], np.cumsum(np.bincount(np.searchsorted(ends[1:], cuts, side="right"), minlength=len(ends) - 1) + 1)])
    return start, stop, offsets


def chunks(data: np.ndarray, ends: np.ndarray, roll: int, mean: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Chunks as first line, line after the last, and text; with the starts and ends of lines."""
    start, stop, offsets = line_bounds(data, ends)
    line = Rolling(data).at(start, stop)
    rolled = line.copy()
    for i in range(1, roll):
        rolled[i:] = mix(rolled[i:] + mix(line[:-i] + np.uint64(i)))
    last = rolled % np.uint64(mean) == 0
    # a boundary needs whole sight of its lines: the first lines of a text have none before them
    for i in range(roll - 1):
        last[np.minimum(offsets[:-1] + i, len(last) - 1)] = False
    last[offsets[1:] - 1] = True
    to = np.flatnonzero(last) + 1
    from_ = np.concatenate([[0], to[:-1]])
    return from_, to, np.searchsorted(offsets, from_, side="right") - 1, start, stop


def dedup_lines(docs: DataFrame, roll: int = ROLL_LINES, mean: int = MEAN_LINES, least: int = LEAST_LINES, extra: tuple[str, ...] = ("n_lines", "n_removed")) -> DataFrame:
    """docs with text without repeated chunks, and the number of lines that it had and that went.

    A chunk stays where it first comes up: in the document with the smallest id, and there at the first place.
    Chunks that have no byte but newlines are left alone, as are null texts; a text of which nothing is left
    becomes empty. Rows with one id are alike, and neither is earlier; rows without id come last, in the order
    of a hash of their text. Columns are kept, but for those named in ``extra``, which are replaced; tables may
    be empty, lines and texts of any length.
    """
    n_lines, n_removed = extra
    names = [c for c in docs.columns if c not in extra]
    others = F.struct(F.lit(0).alias("_"), *(c for c in names if c != "text"))
    base = docs.select(order_key().alias("k"), F.col("text").cast("string").alias("text"), others.alias("row")).repartition(partitions(docs), "k")

    def each(batch: pa.RecordBatch):
        for piece, data, ends in pieces(batch):
            a, b, text, start, stop = chunks(data, ends, roll, mean)
            long = (b - a >= least) & (stop[b - 1] - start[a] > b - a - 1)
            yield piece, data, ends, a, b, text, start, stop, long, Rolling(data).at(start[a], stop[b - 1]).view(np.int64)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, data, _, a, b, text, start, stop, long, key in each(batch):
                own, best = np.asarray(piece.column("k"))[text], {}
                for i in np.flatnonzero(long):
                    chunk = (key[i], data[start[a[i]] : stop[b[i] - 1]].tobytes())
                    best[chunk] = min(best.get(chunk, own[i]), own[i])
                columns = [pa.array([c[0] for c in best], pa.int64()), pa.array([c[1] for c in best], pa.binary()), pa.array(list(best.values()), pa.int64())]
                yield pa.record_batch(columns, ["h", "chunk", "k"])

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, data, ends, a, b, text, _, _, long, key in each(batch):
                firsts = [set(x or ()) for x in piece.column("firsts").to_pylist()]
                first_line = np.concatenate([[0], np.cumsum(np.bincount(text, weights=b - a, minlength=len(piece)))]).astype(np.int64)
                texts, gone = piece.column("text").to_pylist(), [[] for _ in range(len(piece))]
                for i in np.flatnonzero(long):
                    if key[i] in firsts[text[i]]:
                        firsts[text[i]].discard(key[i])  # a later copy in this document is no first
                    else:
                        gone[text[i]].append((a[i] - first_line[text[i]], b[i] - first_line[text[i]]))
                removed = np.zeros(len(piece), np.int64)
                for i, parts in enumerate(gone):
                    if parts:
                        lines = texts[i].split("\n")
                        for x, y in reversed(parts):
                            del lines[x:y]
                            removed[i] += y - x
                        texts[i] = "\n".join(lines)
                yield pa.record_batch([pa.array(texts, pa.string()), piece.column("row"), pa.array(np.diff(first_line)), pa.array(removed)], ["text", "row", "n_lines", "n_removed"])

    # Grouped by the bytes; a chunk that comes up once is its document's first, too, so the lists say what stays.
    firsts = base.mapInArrow(emit, "h long, chunk binary, k long").groupBy("h", "chunk").agg(F.min("k").alias("k"))
    firsts = firsts.groupBy("k").agg(F.collect_list("h").alias("firsts"))
    told = base.join(firsts.hint("shuffle_hash"), "k", "left").select("text", "row", "firsts")
    out = told.mapInArrow(remove, T.StructType([T.StructField("text", T.StringType()), T.StructField("row", base.schema["row"].dataType), T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.LongType())]))
    kept = [F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in names]
    return out.select(*kept, F.col("n_lines").alias(n_lines), F.col("n_removed").alias(n_removed))
