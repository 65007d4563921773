"""Best-two-fit packing of token sequences (operator 1).

Only the lengths matter for packing, and a piece has at most `size` tokens, so the whole table is described
by a histogram of at most `size` rows. Best-two-fit runs on that histogram: a bin is filled greedily with the
longest pieces that fit, then its smallest piece is replaced by two unpacked ones that fit the expanded gap
more tightly. While the counts last, the same bin would be made again, so one pattern stands for as many bins
as its rarest length allows. The patterns are rows of (length, first rank, number, first bin, offset); pieces
get a rank among those of their length and find their place by an equi-join. The corpus is packed as one, not
in separate groups, and nothing but the histogram is ever in one task.

Defined results: null and empty texts are one piece of one end token; repeated rows are packed each; an empty
table gives an empty result; the documents' other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written
from .tokens import encoder, slices

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, rank long"
#: Ranks of one length that meet in one join key.
BLOCK = 1024


def token_pieces(docs: DataFrame, path: str, end_id: int, size: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece of at most `size` tokens, with its rank among the pieces of its length in its task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, task, seen = encoder(path), TaskContext.get().partitionId(), np.zeros(size + 1, dtype=np.int64)
        for batch in batches:
            rows: list[tuple] = []
            for part in slices(batch, 1):
                for doc, ids in zip(part.column(0).to_pylist(), coder.encode(part.column(1))):
                    data = memoryview(ids.tobytes() + np.uint32(end_id).tobytes())
                    n = len(data) // 4
                    for piece, start in enumerate(range(0, n, size)):
                        body = data[4 * start : 4 * min(n, start + size)]
                        length = len(body) // 4
                        rows.append((doc, piece, start, length, zlib.crc32(body), task, int(seen[length])))
                        seen[length] += 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            names = ("doc_id", "piece", "start", "length", "ids_crc32", "task", "rank")
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * 7, kinds)], names)

    return docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, PIECES)


def best_two_fit(counts: np.ndarray) -> list[tuple[int, list[int]]]:
    """Patterns (number of bins, lengths of the pieces in a bin) for counts[length], length up to the bin size."""
    size = len(counts) - 1
    left = counts.astype(np.int64).copy()
    left[0] = 0
    grid = np.arange(size + 1)
    floor = np.maximum.accumulate(np.where(left > 0, grid, 0))  # longest unpacked length up to each
    patterns: list[tuple[int, list[int]]] = []

    def take(length: int) -> None:
        left[length] -= 1
        if not left[length]:
            below = floor[length - 1]
            stop = length + int(np.argmax(floor[length:] != length)) if floor[-1] != length else size + 1
            floor[length:stop] = below

    def put(length: int) -> None:
        left[length] += 1
        if left[length] == 1:
            stop = length + int(np.searchsorted(floor[length:], length, side="right"))
            floor[length:stop] = length

    while floor[size]:
        gap, bin_ = size, []
        while gap and floor[gap]:
            bin_.append(int(floor[gap]))
            take(bin_[-1])
            gap -= bin_[-1]
        if gap and len(bin_) > 1:
            smallest = bin_[-1]
            room = gap + smallest
            first = grid[1 : room][left[1:room] > 0]
            if len(first):
                second = floor[room - first]
                good = (second > 0) & ((second != first) | (left[first] > 1))
                total = np.where(good, first + second, 0)
                best = int(np.argmax(total))
                if total[best] > smallest:
                    put(smallest)
                    bin_[-1:] = [int(max(first[best], second[best])), int(min(first[best], second[best]))]
                    take(bin_[-2])
                    take(bin_[-1])
        lengths, need = np.unique(bin_, return_counts=True)
        more = int(min(left[lengths] // need))
        if more:
            for length, n in zip(lengths.tolist(), need.tolist()):
                left[length] -= more * n - 1  # take() below counts the last one and mends `floor`
                take(length)
        patterns.append((1 + more, bin_))
    return patterns


def _slots(size: int):
    """Rows (length, first, number, bin, offset): ranks from `first` on go to bins from `bin` on, at `offset`."""

    def run(histogram: pd.DataFrame) -> pd.DataFrame:
        counts = np.zeros(size + 1, dtype=np.int64)
        counts[histogram["length"].to_numpy()] = histogram["n"].to_numpy()
        used, bins, rows = np.zeros(size + 1, dtype=np.int64), 0, []
        for number, lengths in best_two_fit(counts):
            offset = 0
            for length in lengths:
                rows.append((length, used[length], number, bins, offset))
                used[length] += number
                offset += length
            bins += number
        return pd.DataFrame(rows, columns=["length", "first", "number", "bin", "offset"]).astype("int64")

    return run


def pack(pieces: DataFrame, size: int) -> DataFrame:
    """Give pieces (length, task, rank in the task) a sequence_id and an offset. `pieces` is read three times."""
    per_task = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shift = per_task.select(F.col("length").alias("__length"), F.col("task").alias("__task"), before.alias("__before"))
    slots = (
        per_task.groupBy("length").agg(F.sum("n").alias("n")).withColumn("all", F.lit(1)).groupBy("all")
        .applyInPandas(_slots(size), "length long, first long, number long, bin long, offset long")
    )
    last = F.col("first") + F.col("number") - 1
    slots = slots.select(
        F.col("length").alias("__slot_length"), "first", "number", "bin", "offset",
        F.explode(F.sequence(F.floor(F.col("first") / BLOCK), F.floor(last / BLOCK))).alias("__slot_block"),
    )
    ranked = pieces.join(shift, (F.col("length") == F.col("__length")) & (F.col("task") == F.col("__task"))).withColumn(
        "__rank", F.col("rank") + F.col("__before")
    ).withColumn("__block", F.floor(F.col("__rank") / BLOCK))
    placed = ranked.join(
        slots,
        (F.col("length") == F.col("__slot_length")) & (F.col("__block") == F.col("__slot_block"))
        & (F.col("__rank") >= F.col("first")) & (F.col("__rank") < F.col("first") + F.col("number")),
    )
    return placed.select(
        *[c for c in pieces.columns if c not in ("task", "rank")],
        (F.col("bin") + F.col("__rank") - F.col("first")).alias("sequence_id"), F.col("offset").cast("long").alias("offset"),
    )


def packed_documents(docs: DataFrame, path: str, end_id: int = 1, size: int = 4096) -> DataFrame:
    """Pieces of all documents with their place. The pieces are written once: ranks depend on the task."""
    return pack(written(token_pieces(docs, path, end_id, size), "pieces"), size)
