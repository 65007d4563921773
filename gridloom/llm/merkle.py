"""Merkle manifest of a document table with octopus multiproofs (operator 11).

Every document is a leaf; each language has a tree of fan-out 8 over its leaves by document id, and the
roots of the languages have a tree of their own.

1. Leaf digests are computed by SQL functions; texts are not kept. A range partition by (language, id, leaf)
   and one count per partition and language give every leaf its place, without a window over a language.
2. A leaf partition is an aligned block of 8^BLOCK_LEVELS leaves. It climbs to its top node, and names the
   minimal union of node coordinates that proofs of its leaves need and that it can't derive by itself.
3. The few levels above the blocks are group-bys of at most 8 children.
4. One equi-join fetches the named nodes, each once per block. Nodes near the root are named by many blocks;
   they are copied for every `ASKERS` blocks at most, so that no key is hot.
5. The block meets its fetched nodes in one cogroup, derives the shared interior nodes, and expands the proof
   of each leaf from shared tails.

Memory of a task is bounded by one block and about 8 fetched nodes a level. Languages may be of any size and number.

Defined results: a null column counts as `-`; null languages are a tree of their own, ahead of the others;
null ids come first, as do equal ids with the smaller leaf; repeated rows are leaves of their own next to each
other; a null id is never tampered with; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import partitions, written
from .neardup import LOWER, UPPER

FAN = 8
BLOCK_LEVELS = 4
#: Blocks that read one copy of a node.
ASKERS = FAN**5
#: Group of the tree over the roots of the languages. Keys of languages are '' for null or begin with '+'.
TOP = "-"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
RESULT = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, position long, n_fetched int"


def encoded(value: Column) -> Column:
    """`-` for null, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(**changed: Column) -> Column:
    return F.sha2(F.concat(*[encoded(changed.get(c, F.col(c))) for c in FIELDS]), 256)


def tree_height(n: Column) -> Column:
    """Levels above the leaves of a tree of n leaves."""
    return F.size(F.filter(F.array(*[F.lit(FAN**k) for k in range(20)]), lambda size: size < n))


def placed(rows: DataFrame, group: str, order: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows with their place (`pos`, from 0) in the order of their group, and (group, n).

    Groups may hold any share of the rows: partitions are ranges of (group, order), and only one count per
    partition and group is added up in order.
    """
    ranges = rows.repartitionByRange(partitions(rows.sparkSession), group, *order).sortWithinPartitions(group, *order)
    numbered = written(
        ranges.withColumns({"__part": F.spark_partition_id(), "__k": F.monotonically_increasing_id().bitwiseAND(F.lit(2**33 - 1))}), "ranges"
    )
    runs = written(numbered.groupBy(group, "__part").agg(F.min("__k").alias("__first"), F.count("*").alias("__rows")), "runs")
    before = Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.withColumn("__before", F.coalesce(F.sum("__rows").over(before), F.lit(0)) - F.col("__first")).select(group, "__part", "__before")
    where = numbered.join(starts, [group, "__part"]).withColumn("pos", F.col("__k") + F.col("__before")).drop("__part", "__k", "__before")
    return where, runs.groupBy(group).agg(F.sum("__rows").alias("n"))


def missing_coordinates(positions: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Octopus: coordinates (level, index) of the smallest set of nodes that, together with the leaves at
    these positions, gives the root of n leaves."""
    known, size, level, out = np.unique(positions), n, 0, []
    while size > 1:
        runs = np.unique(known // FAN)
        members = (runs[:, None] * FAN + np.arange(FAN)[None, :]).ravel()
        needed = np.setdiff1d(members[members < size], known)
        out += [(level, int(i)) for i in needed]
        known, size, level = runs, -(-size // FAN), level + 1
    return out


def _digest(parts: Sequence[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _climbed(nodes: dict[int, str], size: int) -> dict[int, str]:
    """Parents that are complete: all members of the run are known."""
    runs: dict[int, list[str]] = {}
    for i in sorted(nodes):
        runs.setdefault(i // FAN, []).append(nodes[i])
    return {r: _digest(found) for r, found in runs.items() if len(found) == min(FAN, size - r * FAN)}


def _surveyed(levels: int):
    """A block's leaves to its top node (`hash` set) and the coordinates that it misses (`hash` null)."""

    def run(key, rows):
        group, block = key[0].as_py(), key[1].as_py()
        n, height, at, langs = (rows.column(c)[0].as_py() for c in ("n", "height", "at", "langs"))
        positions = rows.column("pos").to_numpy()
        nodes = {p: leaf.hex() for p, leaf in zip(positions.tolist(), rows.column("leaf").to_pylist())}
        size = n
        for _ in range(min(levels, height)):
            nodes, size = _climbed(nodes, size), -(-size // FAN)
        wanted = [(group, *c, None) for c in missing_coordinates(positions, n)]
        wanted += [(TOP, *c, None) for c in missing_coordinates(np.array([at]), langs)]
        wanted += [(group, min(levels, height), i, bytes.fromhex(h)) for i, h in nodes.items()]
        tree, level, index, found = zip(*wanted)
        return pa.table({
            "tree": pa.array(tree, pa.string()), "level": pa.array(level, pa.int32()), "idx": pa.array(index, pa.int64()), "hash": pa.array(found, pa.binary()),
            "grp": pa.array([group] * len(wanted), pa.string()), "block": pa.array([block] * len(wanted), pa.int64()),
        })

    return run


def _grown(nodes: DataFrame, levels: range) -> DataFrame:
    """All nodes (tree, height, level, idx, hash) above given ones; a parent gathers at most 8 children."""
    found = [nodes]
    for level in levels:
        children = found[-1].where((F.col("level") == level) & (F.col("level") < F.col("height")))
        parents = children.groupBy("tree", "height", F.floor(F.col("idx") / FAN).alias("idx")).agg(
            F.unhex(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "hash"))), lambda x: F.lower(F.hex(x["hash"]))), ""), 256)).alias("hash")
        )
        found.append(written(parents.select("tree", "height", F.lit(level + 1).alias("level"), "idx", "hash"), "level"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


class _Proofs:
    """Known nodes of one tree; siblings and shared tails by coordinate."""

    def __init__(self, n: int, leaves: dict[int, str], fetched: dict[tuple[int, int], str]):
        self.levels, size, level = [], n, 0
        nodes = leaves
        while True:
            nodes = nodes | {i: h for (at, i), h in fetched.items() if at == level}
            self.levels.append((nodes, size))
            if size == 1:
                break
            nodes, size, level = _climbed(nodes, size), -(-size // FAN), level + 1
        self.tails: dict[tuple[int, int], str] = {}

    @property
    def root(self) -> str:
        return self.levels[-1][0][0]

    def around(self, level: int, i: int) -> tuple[str, str]:
        """Siblings of a node, joined: those on its left and those on its right."""
        nodes, size = self.levels[level]
        first = i // FAN * FAN
        return "".join([nodes[k] for k in range(first, i)]), "".join([nodes[k] for k in range(i + 1, min(first + FAN, size))])

    def proof(self, level: int, i: int) -> str:
        """Siblings from a node to the root; the part above its run is shared with the rest of the run."""
        if level == len(self.levels) - 1:
            return ""
        above = (level + 1, i // FAN)
        if above not in self.tails:
            self.tails[above] = self.proof(*above)
        return "".join(self.around(level, i)) + self.tails[above]

    def fold(self, i: int, digest: str) -> str:
        """Root from a leaf digest and the siblings of its place."""
        for level in range(len(self.levels) - 1):
            left, right = self.around(level, i)
            digest, i = _digest((left, digest, right)), i // FAN
        return digest


def _proven(key, rows, fetched):
    """Cogroup of a block's leaves and its fetched nodes to one row per leaf."""
    if not rows.num_rows:
        return pa.table({name: pa.array([], kind) for name, kind in _RESULT})
    group = key[0].as_py()
    n, at, langs = (rows.column(c)[0].as_py() for c in ("n", "at", "langs"))
    own: dict[tuple[int, int], str] = {}
    top: dict[tuple[int, int], str] = {}
    for tree, level, i, h in zip(*[fetched.column(c).to_pylist() for c in ("tree", "level", "idx", "hash")]):
        (top if tree == TOP else own)[level, i] = h.hex()
    positions = rows.column("pos").to_pylist()
    leaves = [x.hex() for x in rows.column("leaf").to_pylist()]
    tree = _Proofs(n, dict(zip(positions, leaves)), own)
    above = _Proofs(langs, {at: tree.root}, top)
    tail, root = above.proof(0, at), above.root
    proofs, folded = [], []
    for i, leaf, forged in zip(positions, leaves, rows.column("forged").to_pylist()):
        proofs.append(hashlib.sha256((tree.proof(0, i) + tail).encode()).hexdigest())
        folded.append(above.fold(at, tree.fold(i, leaf if forged is None else forged.hex())))
    same = len(leaves)
    values = [rows.column("doc_id"), leaves, [tree.root] * same, [root] * same, proofs, folded, [f == root for f in folded], positions, [len(own) + len(top)] * same]
    return pa.table({name: v.cast(kind) if isinstance(v, pa.ChunkedArray) else pa.array(v, kind) for (name, kind), v in zip(_RESULT, values)})


_RESULT = [
    ("doc_id", pa.int64()), ("leaf", pa.string()), ("subroot", pa.string()), ("root", pa.string()), ("proof_sha256", pa.string()),
    ("folded_root", pa.string()), ("verified", pa.bool_()), ("position", pa.int64()), ("n_fetched", pa.int32()),
]


def tampered_text() -> tuple[Column, Column]:
    """Which rows are tampered with, and the text that they get: A-Z in lower case."""
    chosen = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.lit(False))
    return chosen, F.translate("text", UPPER, LOWER)


def merkle_manifest(docs: DataFrame, block_levels: int = BLOCK_LEVELS, askers: int = ASKERS) -> DataFrame:
    """One row per document: leaf, roots, digest of its proof, and the root that its (tampered) leaf folds to."""
    chosen, text = tampered_text()
    size = FAN**block_levels
    leaves = docs.select(*FIELDS).select(
        "doc_id", F.coalesce(F.concat(F.lit("+"), F.col("lang")), F.lit("")).alias("grp"),
        F.unhex(leaf_digest()).alias("leaf"), F.when(chosen, F.unhex(leaf_digest(text=text))).alias("forged"),
    )
    leaves = written(leaves, "leaves")
    at_place, totals = placed(leaves.withColumn("__row", F.monotonically_increasing_id()), "grp", ["doc_id", "leaf", "__row"])
    langs, _ = placed(totals.withColumn("__t", F.lit(TOP)), "__t", ["grp"])
    langs = written(langs.select("grp", "n", tree_height(F.col("n")).alias("height"), F.col("pos").alias("at")), "trees")
    known = langs.agg(F.count("*"), F.max("height"), F.sum(F.ceil(F.col("n") / size))).first()
    if not known[0]:
        return docs.sparkSession.createDataFrame([], RESULT)
    n_langs, highest, blocks = known[0], known[1], known[2]
    top_height = next(k for k in range(64) if FAN**k >= n_langs)
    ready = at_place.join(langs, "grp").withColumns({"langs": F.lit(n_langs).cast("long"), "block": F.floor(F.col("pos") / size)})
    ready = written(ready.select("grp", "block", "doc_id", "leaf", "forged", "pos", "n", "height", "at", "langs"), "blocks")
    survey = written(
        ready.select("grp", "block", "pos", "leaf", "n", "height", "at", "langs").groupBy("grp", "block").applyInArrow(
            _surveyed(block_levels), "tree string, level int, idx long, hash binary, grp string, block long"
        ),
        "survey",
    )
    tops = survey.where("hash is not null").join(langs.select("grp", "height"), "grp").select("tree", "height", "level", "idx", "hash")
    nodes = _grown(written(tops, "tops"), range(min(block_levels, highest), highest))
    roots = nodes.where("level = height").select(F.col("tree").alias("grp"), "hash").join(langs.select("grp", "at"), "grp")
    roots = roots.select(F.lit(TOP).alias("tree"), F.lit(top_height).alias("height"), F.lit(0).alias("level"), F.col("at").alias("idx"), "hash")
    nodes = nodes.unionByName(_grown(written(roots, "roots"), range(top_height))).select("tree", "level", "idx", "hash")
    # Blocks that may ask for a node: those below its parent, or all of them in the tree of languages.
    below = F.when(F.col("tree") == TOP, F.lit(float(blocks))).otherwise(F.pow(F.lit(float(FAN)), F.greatest(F.col("level") + 1 - block_levels, F.lit(0))))
    copies = F.ceil(F.least(below, F.lit(float(blocks))) / askers).cast("int")
    offered = nodes.withColumn("copy", F.explode(F.sequence(F.lit(0), copies - 1)))
    wanted = survey.where("hash is null").drop("hash").withColumn("copy", F.pmod(F.col("block"), copies).cast("int"))
    fetched = wanted.join(offered, ["tree", "level", "idx", "copy"]).select("grp", "block", "tree", "level", "idx", "hash")
    return ready.groupBy("grp", "block").cogroup(fetched.groupBy("grp", "block")).applyInArrow(_proven, RESULT)
