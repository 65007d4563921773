"""Hard negatives by exact integer scores from a residue number system (operator 13).

Scores are inner products of integer vectors. A task multiplies the component matrices of a block of anchors and a
tile of rows modulo several small primes in float32. Products of centred residues stay below 2^24, so each residue of
a score is exact; mixed-radix digits (Chinese remainders) then give the exact signed score. As many primes are
taken as the largest squared length in the table asks for.

1. Rows become integer vectors by SQL functions. Anchors are written once, in files of about `ANCHORS` vectors.
2. First pass: every partition of rows streams through all anchors, in tiles, and keeps the best `POSITIVES` rows
   of the same label per anchor. A window with a limit merges what the partitions kept.
3. Second pass: the same products again; for each anchor and positive the best `NEGATIVES` rows of another label
   with a score inside the window of the positive, merged in the same way.

The anchors are a stated query set, held against all rows in blocks. A task holds at most `STRIDE` anchor files; more
anchors make the rows travel once per stride. Nothing is broadcast and no row set is gathered.

Defined results: rows with a null id, label or vector, or with a null or non-finite component, take no part, and
neither do rows whose squared length is 2^62 or more, as their scores would not fit a long. Shorter vectors are
filled up with zeros. Among equal scores the smaller id wins; repeated rows are rows of their own, but a row with
the anchor's id is never its partner. Of several anchors with one id the smallest (label, vector) stays. An empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written
from .files import locate

ANCHORS, TILE, STRIDE = 512, 4096, 64
POSITIVES, NEGATIVES = 5, 3
SCALE, ANCHOR_EVERY, MOVED_EVERY, LABELS = 256, 50, 7, 10
LIMIT = 2.0**62
#: Exact integers of float32.
EXACT = 2**24


def primes_for(bound: int) -> list[int]:
    """Largest primes below 512, as many as tell apart all scores from -bound to bound."""
    found, product, p = [], 1, 511
    while product <= 2 * bound + 1:
        p -= 1
        if all(p % k for k in range(2, 23)):
            found.append(p)
            product *= p
    return found


def residues(values: np.ndarray, p: int) -> np.ndarray:
    """Centred residues as float32."""
    r = np.mod(values, p)
    return np.where(r > p // 2, r - p, r).astype(np.float32)


def _centred(x: np.ndarray, p: int) -> np.ndarray:
    x -= np.float32(p) * np.rint(x * np.float32(1 / p))
    return x


def residue_product(a: np.ndarray, b: np.ndarray, p: int) -> np.ndarray:
    """a @ b.T modulo p for centred residues; columns are taken so many at a time that float32 stays exact."""
    step = max(1, EXACT // 2 // (p // 2 + 1) ** 2)
    out = np.zeros((len(a), len(b)), dtype=np.float32)
    for at in range(0, a.shape[1], step):
        out += _centred(a[:, at : at + step] @ b[:, at : at + step].T, p)
        out = _centred(out, p)
    # An off-by-one multiple of p may be left by the rounded quotient.
    out[out > p // 2] -= p
    out[out < -(p // 2)] += p
    return out


def signed_scores(parts: list[np.ndarray], primes: list[int]) -> np.ndarray:
    """Mixed-radix reconstruction with centred digits, which reaches from -M/2 to M/2."""
    digits: list[np.ndarray] = []
    product = 1
    small = float(np.prod([float(p) for p in primes])) < 2.0**53
    total = np.zeros(parts[0].shape, dtype=np.float64 if small else np.int64)
    for k, p in enumerate(primes):
        left = parts[k].copy()
        for digit, q in zip(digits, primes):
            left = _centred((left - digit) * np.float32(pow(q, -1, p)), p)
        left[left > p // 2] -= p
        left[left < -(p // 2)] += p
        digits.append(left)
        with np.errstate(over="ignore"):  # a partial sum may wrap around; the whole one fits
            total += left.astype(total.dtype) * (float(product) if small else np.int64((product + 2**63) % 2**64 - 2**63))
        product *= p
    return total


def worst(kind: np.dtype):
    return -np.inf if kind == np.float64 else np.iinfo(np.int64).min


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """k best columns of each row; columns ascend by id, so the first of equal scores has the smallest id.
    `scores` is used up. Places without a score have the worst value."""
    low, rows = worst(scores.dtype), np.arange(len(scores))
    values, found = np.full((len(scores), k), low, dtype=scores.dtype), np.zeros((len(scores), k), dtype=np.int64)
    for j in range(k):
        at = scores.argmax(axis=1)
        values[:, j], found[:, j] = scores[rows, at], ids[at]
        scores[rows, at] = low
        if (values[:, j] == low).all():
            break
    return values, found


def merged(one: tuple[np.ndarray, np.ndarray], two: tuple[np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    """k best of two sets of best columns."""
    values, ids = np.concatenate([one[0], two[0]], axis=1), np.concatenate([one[1], two[1]], axis=1)
    by_id = np.argsort(ids, axis=1, kind="stable")
    values, ids = np.take_along_axis(values, by_id, 1), np.take_along_axis(ids, by_id, 1)
    values, at = best(values, np.arange(values.shape[1]), k)
    return values, np.take_along_axis(ids, at, 1)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Integer vectors as rows, filled up with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), dim), dtype=np.int64)
    rows = np.repeat(np.arange(len(column)), lengths)
    out[rows, np.arange(len(rows)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = column.flatten().to_numpy()
    return out


class _Anchors:
    """One file of anchors with their residues and what is best so far."""

    def __init__(self, uri: str, primes: list[int], dim: int, slots: int, k: int):
        system, path = locate(uri)
        with system.open_input_file(path) as source:
            table = pq.ParquetFile(source).read()
        self.ids, self.labels = table.column("vec_id").to_numpy(), table.column("label").to_numpy()
        vectors = _matrix(table.column("v"), dim)
        self.residues = [residues(vectors, p) for p in primes]
        if "lows" in table.column_names:
            # Bounds of each positive's window; unused slots get an empty one.
            self.lows, self.highs = (np.full((len(self.ids), slots), fill, dtype=np.int64) for fill in (1, 0))
            for name, out in (("lows", self.lows), ("highs", self.highs)):
                for i, values in enumerate(table.column(name).to_pylist()):
                    out[i, : len(values)] = values
        self.slots, self.k, self.kept = slots, k, [None] * slots

    def scores(self, tile: list[np.ndarray], primes: list[int]) -> np.ndarray:
        return signed_scores([residue_product(a, b, p) for a, b, p in zip(self.residues, tile, primes)], primes)

    def meet(self, ids: np.ndarray, labels: np.ndarray, tile: list[np.ndarray], primes: list[int], negatives: bool) -> None:
        scores = self.scores(tile, primes)
        low = worst(scores.dtype)
        same = self.labels[:, None] == labels[None, :]
        fit = (~same if negatives else same) & (self.ids[:, None] != ids[None, :])
        scores[~fit] = low
        for s in range(self.slots):
            own = scores
            if negatives:
                inside = (scores >= self.lows[:, s, None]) & (scores <= self.highs[:, s, None])
                if not inside.any():
                    continue
                own = np.where(inside, scores, low)
            found = best(own, ids, self.k)
            self.kept[s] = found if self.kept[s] is None else merged(self.kept[s], found, self.k)

    def rows(self) -> Iterator[tuple[np.ndarray, ...]]:
        for s, kept in enumerate(self.kept):
            if kept is not None:
                i, j = np.nonzero(kept[0] > worst(kept[0].dtype))
                yield self.ids[i], np.full(len(i), s, dtype=np.int32), kept[0][i, j].astype(np.int64), kept[1][i, j]


def _searched(strides: list[list[str]], primes: list[int], dim: int, negatives: bool):
    """Rows (stride, vec_id, label, v) to (anchor_id, slot, score, vec_id), the best of this partition."""
    slots, k = (POSITIVES, NEGATIVES) if negatives else (1, POSITIVES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[_Anchors]] = {}
        for batch in batches:
            stride_of = batch.column(0).to_numpy()
            for stride in np.unique(stride_of).tolist():
                if stride not in held:
                    # Partitions hold one stride each, or few rows: what earlier ones kept is handed on.
                    for anchors in held.values():
                        yield from _found(anchors)
                    held = {stride: [_Anchors(uri, primes, dim, slots, k) for uri in strides[stride]]}
                part = batch.filter(pa.array(stride_of == stride))
                for at in range(0, part.num_rows, TILE):
                    some = part.slice(at, TILE)
                    some = some.take(pa.array(np.argsort(some.column(1).to_numpy(), kind="stable")))
                    vectors = _matrix(some.column(3), dim)
                    tile = [residues(vectors, p) for p in primes]
                    for anchors in held[stride]:
                        anchors.meet(some.column(1).to_numpy(), some.column(2).to_numpy(), tile, primes, negatives)
        for anchors in held.values():
            yield from _found(anchors)

    return run


def _found(anchors: list[_Anchors]) -> Iterator[pa.RecordBatch]:
    for one in anchors:
        for columns in one.rows():
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["anchor_id", "slot", "score", "vec_id"])


def integer_vectors(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, v): eligible rows with floored integer components and moved labels."""
    v = F.col("embedding")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    label = F.col("label").cast("long")
    chosen = rows.select("vec_id", "label", "embedding").where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & finite)
    floored = F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("double"))
    square = F.aggregate(floored, F.lit(0.0), lambda a, x: a + x * x)
    return chosen.where(square < LIMIT).select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.when(F.col("vec_id") % MOVED_EVERY == 0, (label + 1) % LABELS).otherwise(label).alias("label"),
        F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("int")).alias("v"),
    )


def _first(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The k best rows of each key, numbered from 1; Spark limits the groups before they are shuffled."""
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "vec_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(rows: DataFrame) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)."""
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    vectors = written(integer_vectors(rows), "vectors")
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    is_anchor = F.col("vec_id") % ANCHOR_EVERY == 0
    bound, dim, count = vectors.agg(F.max(square), F.max(F.size("v")), F.count_if(is_anchor)).first()
    if not count:
        return rows.sparkSession.createDataFrame([], schema)
    primes = primes_for(int(bound * (1 + 1e-9)) + 1)
    anchors = vectors.where(is_anchor).groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("r")).select("vec_id", "r.label", "r.v")

    def search(anchors: DataFrame, negatives: bool) -> DataFrame:
        files = sorted(written(anchors.repartition(-(-count // ANCHORS), "vec_id"), "anchors").inputFiles())
        strides = [files[at : at + STRIDE] for at in range(0, len(files), STRIDE)]
        dealt = vectors.withColumn("stride", F.lit(0))
        if len(strides) > 1:
            dealt = vectors.withColumn("stride", F.explode(F.sequence(F.lit(0), F.lit(len(strides) - 1)))).repartition("stride", F.floor(F.monotonically_increasing_id() / (TILE * 16)))
        return dealt.select("stride", "vec_id", "label", "v").mapInArrow(
            _searched(strides, primes, dim, negatives), "anchor_id long, slot int, score long, vec_id long"
        )

    near = written(_first(search(anchors, False), ["anchor_id"], POSITIVES).select("anchor_id", F.col("rank").alias("slot"), "vec_id", "score"), "positives")
    # 50 * p <= 100 * n <= 95 * p, in whole numbers.
    p = F.col("score").cast("decimal(20,0)")
    lows, highs = F.ceil(p / 2).cast("long"), F.floor(p * 95 / 100).cast("long")
    listed = near.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("slot", lows.alias("l"), highs.alias("h")))).alias("w"))
    ready = anchors.join(listed, F.col("vec_id") == F.col("anchor_id")).select(
        "vec_id", "label", "v", F.transform("w", lambda x: x["l"]).alias("lows"), F.transform("w", lambda x: x["h"]).alias("highs")
    )
    far = _first(search(ready, True), ["anchor_id", "slot"], NEGATIVES).withColumn("slot", F.col("slot") + 1)
    pairs = near.select("anchor_id", "slot", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return far.join(pairs, ["anchor_id", "slot"]).select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
