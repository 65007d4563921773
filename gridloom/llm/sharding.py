"""Shards by balanced label propagation (operator 3, native).

Documents with equal texts are linked. Every linked document starts with a shard of its own choice (a hash).
In each round, documents move towards the shard that holds most of their neighbours. The links of a group of
equal texts are complete, so the neighbours' shards of all its documents are one tally per (group, shard), an
aggregate; the join of that tally with the documents is the propagation step, and no pair is ever made. A
shard accepts movers up to its free quota and as many as leave it in the same round: all of them, or that share
of them which fits, chosen by hash. A full shard therefore swaps documents with the others.
Documents without links are indifferent and fill what is left, so that sizes end up even.

The law is `rows`: shard sizes differ by at most one document. Only a group that is larger than a
shard is cut beforehand, into as few parts as fit. Loads and quotas are one row per shard.
Slots are ranks in a shard, from ranks in hash buckets plus counts of the buckets before, so that a shard is
never sorted as a whole. Only DataFrame functions are used, and texts stay in the first pass.

Defined results: null texts have no bytes and count as equal to empty ones; rows that repeat an id are placed
each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import partitions, written

ROUNDS = 8
OVERHEAD = 16


def hashed_rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Ids, sizes and digests; `row` tells rows apart whatever their ids are."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(key).alias("doc_id"), (F.octet_length(body) + OVERHEAD).cast("long").alias("size"),
        F.crc32(F.encode(body, "utf-8")).cast("long").alias("text_crc32"), F.unhex(F.sha2(body, 256)).alias("digest"),
        F.monotonically_increasing_id().alias("row"),
    )
    return written(rows, "rows")


def linked_rows(rows: DataFrame, capacity: int) -> DataFrame:
    """(row, digest, part): documents with an equal one; groups larger than a shard in as few parts as fit."""
    groups = rows.groupBy("digest").agg(F.count("*").alias("members")).where("members > 1")
    part = F.pmod(F.xxhash64("row", F.lit(7)), F.ceil(F.col("members") / max(1, capacity))).cast("int")
    return rows.select("row", "digest").join(groups, "digest").select("row", "digest", part.alias("part"))


def _chosen(column: Column, values: list, fallback) -> Column:
    """Value of a small list by a shard number, as a CASE."""
    out = F.when(F.lit(False), F.lit(fallback))
    for i, v in enumerate(values):
        out = out.when(column == i, F.lit(v))
    return out.otherwise(F.lit(fallback))


def _per_shard(df: DataFrame, column: str, value: Column, shards: int) -> list[int]:
    """One number per shard; as many rows as there are shards."""
    out = [0] * shards
    for r in df.groupBy(column).agg(value.alias("__v")).collect():
        if r[0] is not None and r[0] >= 0:
            out[r[0]] = int(r[1])
    return out


def _flows(wishes: DataFrame) -> dict[tuple[int, int], int]:
    """Documents that ask to go from one shard to another; at most one row per pair of shards."""
    return {(r["label"], r["target"]): int(r["n"]) for r in wishes.groupBy("label", "target").agg(F.sum("n").alias("n")).collect()}


def _shares(free: list[int], asked: list[int], flows: dict[tuple[int, int], int], shards: int) -> list[float]:
    """Share of the movers to each shard that fit into free places and those that the accepted movers leave.

    Shares begin at one and fall to a fixed point, so what a shard counts on as leaving is accepted elsewhere.
    """
    share = [1.0 if a else 0.0 for a in asked]
    for _ in range(50):
        leaving = [0.0] * shards
        for (source, target), n in flows.items():
            leaving[source] += n * share[target]
        lower = [min(x, (max(0, f + out) / a) if a else 0.0) for x, f, out, a in zip(share, free, leaving, asked)]
        if lower == share:
            break
        share = lower
    return share


def propagate(linked: DataFrame, quotas: list[int], rounds: int = ROUNDS) -> DataFrame:
    """(row, digest, part, label) after at most `rounds` rounds, or fewer when nothing moves any more."""
    shards = len(quotas)
    labels = written(linked.withColumn("label", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int")), "labels")
    for turn in range(rounds):
        loads = _per_shard(labels, "label", F.count("*"), shards)
        free = [q - n for q, n in zip(quotas, loads)]
        tally = labels.groupBy("digest", "part", "label").agg(F.count("*").alias("n"))
        rank = F.struct(F.col("n"), F.xxhash64("digest", "part", "label"))
        # Every other round prefers shards with free places, so that groups whose own shard stays full gather there.
        open_ = _chosen(F.col("label"), [turn % 2 == 0 or f > 0 for f in free], False).alias("open")
        best = tally.groupBy("digest", "part").agg(
            F.max_by("label", F.struct(open_, rank.alias("rank"))).alias("target"), F.max(F.struct(open_, rank.alias("rank"))).alias("top"),
        ).select(F.col("digest").alias("__d"), F.col("part").alias("__p"), "target")
        wishes = tally.join(best, (F.col("digest") == F.col("__d")) & (F.col("part") == F.col("__p"))).where(
            F.col("label") != F.col("target")
        ).select("digest", "part", "label", "target", "n")
        wishes = written(wishes, "wishes")
        asked = _per_shard(wishes, "target", F.sum("n"), shards)
        if not any(asked):
            break
        share = _shares(free, asked, _flows(wishes), shards)
        wishes = wishes.select(F.col("digest").alias("__d"), F.col("part").alias("__p"), F.col("label").alias("__l"), "target")
        lot = F.pmod(F.xxhash64("row", F.lit(turn)), F.lit(1 << 20)) / float(1 << 20)
        moved = labels.join(wishes, (F.col("digest") == F.col("__d")) & (F.col("part") == F.col("__p")) & (F.col("label") == F.col("__l")), "left")
        goes = F.col("target").isNotNull() & (lot < _chosen(F.col("target"), share, 0.0))
        labels = written(moved.select("row", "digest", "part", F.when(goes, F.col("target")).otherwise(F.col("label")).alias("label")), "labels")
    return labels


def balanced_shards(docs: DataFrame, shards: int = 40, key: str = "doc_id", text: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard)."""
    rows = hashed_rows(docs, key, text)
    total = rows.count()
    quotas = [total // shards + (s < total % shards) for s in range(shards)]
    labels = propagate(linked_rows(rows, quotas[-1]), quotas, rounds)
    placed = rows.select("doc_id", "size", "text_crc32", "row").join(labels.select("row", "label"), "row", "left")
    buckets = 4 * partitions(docs.sparkSession)
    placed = written(placed.withColumn("label", F.coalesce("label", F.lit(-1))).withColumn("bucket", F.pmod(F.xxhash64("row", F.lit(3)), F.lit(buckets)).cast("int")), "placed")
    counts = placed.groupBy("label", "bucket").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("label").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(F.col("label").alias("__label"), F.col("bucket").alias("__bucket"), before.alias("__before"))
    ranked = placed.withColumn("__i", F.row_number().over(Window.partitionBy("label", "bucket").orderBy("row")) - 1).join(
        offsets, (F.col("label") == F.col("__label")) & (F.col("bucket") == F.col("__bucket"))
    ).withColumn("rank", (F.col("__i") + F.col("__before")).cast("long"))
    # Who has no label, or a rank beyond the quota, takes an open place; these are numbered through.
    loads = _per_shard(placed, "label", F.count("*"), shards)
    single = total - sum(loads)
    first_free, at = [], single
    for load, quota in zip(loads, quotas):
        first_free.append(at)
        at += max(0, load - quota)
    label, rank = F.col("label"), F.col("rank")
    stays = (label >= 0) & (rank < _chosen(label, quotas, 0))
    free = F.when(label < 0, rank).otherwise(rank - _chosen(label, quotas, 0) + _chosen(label, first_free, 0))
    shard, slot, at = F.when(F.lit(False), F.lit(0)), F.when(F.lit(False), F.lit(0).cast("long")), 0
    for s, (load, quota) in enumerate(zip(loads, quotas)):
        kept = min(load, quota)
        inside = F.col("free") < at + quota - kept
        shard, slot = shard.when(inside, F.lit(s)), slot.when(inside, F.col("free") - at + kept)
        at += quota - kept
    out = ranked.withColumn("stays", stays).withColumn("free", free)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.when(F.col("stays"), label).otherwise(shard).cast("int").alias("shard"),
        F.when(F.col("stays"), rank).otherwise(slot).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
