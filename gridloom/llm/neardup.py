"""Near-duplicate groups by MinHash with sequential Bayesian verification (operator 8).

1. Documents with the same word sequence are one class; its smallest id speaks for it.
2. Each class gets a MinHash signature of its distinct word shingles. `BANDS` bands of `ROWS` values are its
   band keys; classes with a common band key are candidates.
3. In a first pass every member of a band is compared with one member of it, drawn by hash. A group of n
   near copies makes n candidates a band, not n * n. A second pass finds the links between members of a band
   that are not yet in one component; a pair inside one component can't change a component.
   Its members are described by their differences from a reference, the member of the band with most links.
   Two sets are linked exactly if their symmetric difference is small against their sizes. With differences
   that have nothing in common it is the sum of both, so a linked pair of that kind is linked through the
   reference, and one star decides all of them. The other pairs share a difference, and as many as they lack
   to the threshold: they meet on the rarest of their differences (prefix and position filter), one of the two
   being a member that is not linked to the reference. This is exact for any reference; a near one makes it
   short. A class with a fifth of its own shingles is in no pair.
4. A candidate is judged sequentially: after each batch of signature values, the posterior probability that
   its similarity reaches the threshold, given the matches so far and a uniform prior, is compared with the
   chosen miss probability. Survivors are verified on their full shingle sets. So every link is exact.

With 48 bands of 6 values, a pair at similarity 0.8 shares no band with probability 4e-7; pruning misses it
with a probability of at most 1e-6. At 0.15 (documents with a common passage) one pair in 1800 is compared.

A hot band (many near copies) costs partial minima and a join that Spark may split; no group is gathered.
Texts travel only with surviving pairs.

Defined results: null, empty or blank texts have no shingles and are linked with nothing; texts of fewer
words than a shingle are one shingle of the whole sequence; repeated rows are each returned and count as
one document for links; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from .common import SPACE_RUN, written, written_few, written_fewest

BANDS, ROWS = 48, 6
BATCH = 24
MISS = 1e-6
SEED = 20240229
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def folded(text: Column) -> Column:
    """A-Z in lower case, words joined by single spaces."""
    return F.trim(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), SPACE_RUN, " "))


def shingle_set(words: list[str], width: int) -> set:
    if not words:
        return set()
    if len(words) < width:
        return {" ".join(words)}
    if width == 1:
        return set(words)
    columns = [words[i : len(words) - width + 1 + i] for i in range(width)]
    return set(map(" ".join, zip(*columns)))


def _mixed(values: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash, so that shifts and products of it are well spread."""
    with np.errstate(over="ignore"):
        x = values ^ (values >> np.uint64(33))
        x *= np.uint64(0xFF51AFD7ED558CCD)
        x ^= x >> np.uint64(33)
        x *= np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


@lru_cache
def _multipliers(n: int) -> np.ndarray:
    return np.random.default_rng(SEED).integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signature(hashes: np.ndarray, n: int) -> np.ndarray:
    """Smallest value of each of n multiply-shift hashes; 32 bits of each are kept."""
    least = np.full(n, np.iinfo(np.uint64).max, dtype=np.uint64)
    factors = _multipliers(n)
    with np.errstate(over="ignore"):
        for at in range(0, len(hashes), 512):
            np.minimum(least, (hashes[at : at + 512, None] * factors[None, :]).min(axis=0), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def _hash_words(words: list[str], width: int) -> np.ndarray:
    """64-bit hashes of the distinct shingles: word hashes are combined by place."""
    import xxhash

    seen: dict[str, int] = {}
    of = xxhash.xxh3_64_intdigest
    ids = np.fromiter((seen[w] if w in seen else seen.setdefault(w, of(w)) for w in words), dtype=np.uint64, count=len(words))
    n = max(1, len(words) - width + 1)
    out = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(min(width, len(words))):
            out = _mixed(out * np.uint64(0x9E3779B97F4A7C15) + ids[k : k + n])
    return np.unique(out)


def _signed(width: int, n: int):
    """Rows (doc_id, folded text) to a digest of the word sequence, the shingle count and the signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, counts, signatures = [], [], []
            for t in batch.column(1).to_pylist():
                words = t.split(" ") if t else []
                counts.append(len(shingle_set(words, width)))
                digests.append(hashlib.sha256(t.encode()).digest() if t else None)
                signatures.append((signature(_hash_words(words, width), n) & np.uint32(0xFFFF)).astype("<u2").tobytes() if t else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(digests, pa.binary()), pa.array(counts, pa.int64()), pa.array(signatures, pa.binary())],
                ["doc_id", "digest", "n_shingles", "signature"],
            )

    return run


def band_keys(signature: Column) -> Column:
    """One key per band: a hash of its place and its values."""
    size = 2 * ROWS
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda k: F.xxhash64(k, F.substring(signature, k * size + 1, F.lit(size))))


@lru_cache
def pruning_table(n: int, batch: int, similarity: float, miss: float) -> np.ndarray:
    """Fewest matches after each batch with which a pair lives on: with fewer, the posterior probability
    (uniform prior) of a similarity of at least the threshold is below the chosen miss probability, and so
    is the chance that a pair at the threshold has so few matches, shared out over the batches."""
    batches = list(range(batch, n + 1, batch))
    least = []
    grid = (np.arange(4000) + 0.5) / 4000
    for m in batches:
        matches = np.arange(m + 1)
        tail = np.cumsum([math.comb(m, k) * similarity**k * (1 - similarity) ** (m - k) for k in matches])
        logs = matches[:, None] * np.log(grid)[None, :] + (m - matches)[:, None] * np.log1p(-grid)[None, :]
        weight = np.exp(logs - logs.max(axis=1, keepdims=True))
        posterior = weight[:, grid >= similarity].sum(axis=1) / weight.sum(axis=1)
        dead = (posterior < miss) & (tail < miss / len(batches))
        least.append(int(dead.sum()))
    return np.asarray(least)


def _pruned(similarity: float, miss: float):
    """Drop candidates batch by batch; a pair that is dropped is not compared further."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a = np.stack([np.frombuffer(x, "<u2") for x in batch.column(2).to_pylist()])
            b = np.stack([np.frombuffer(x, "<u2") for x in batch.column(3).to_pylist()])
            least = pruning_table(a.shape[1], BATCH, similarity, miss)
            alive, matches = np.arange(len(a)), np.zeros(len(a), dtype=np.int64)
            for k, need in enumerate(least):
                part = slice(k * BATCH, (k + 1) * BATCH)
                matches = matches + (a[alive, part] == b[alive, part]).sum(axis=1)
                keep = matches >= need
                alive, matches = alive[keep], matches[keep]
            yield batch.take(pa.array(alive)).select([0, 1])

    return run


def _verified(width: int, percent: int):
    """Pairs with their folded texts to links with 100 * common >= percent * union, on full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            last, left = None, set()
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if x is not last:
                    last, left = x, shingle_set(x.split(" "), width)
                right = shingle_set(y.split(" "), width)
                common = len(left & right)
                keep.append(100 * common >= percent * (len(left) + len(right) - common))
            yield batch.filter(pa.array(keep, pa.bool_())).select([0, 1])

    return run


def _links(pairs: DataFrame, signatures: DataFrame, texts: DataFrame, width: int, percent: int, miss: float) -> DataFrame:
    """Distinct candidate pairs to exact links."""
    one = signatures.select("id", "signature")
    with_both = pairs.join(one.toDF("a", "sa"), "a").join(one.toDF("b", "sb"), "b").select("a", "b", "sa", "sb")
    alive = written_few(with_both.mapInArrow(_pruned(percent / 100, miss), "a long, b long"), "survivors")
    whole = alive.join(texts.toDF("a", "ta"), "a").join(texts.toDF("b", "tb"), "b").select("a", "b", "ta", "tb")
    return whole.mapInArrow(_verified(width, percent), "a long, b long")


def _shared_counts(ids: DataFrame, sizes: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """(id, n, shared): shingles of a class, and how many of them some other class of `ids` has too. Two classes
    have at most the smaller `shared` in common, which bounds their similarity exactly. Hashes may only
    join different shingles, which makes `shared` larger and the bound weaker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_hash_words(t.split(" "), width) for t in batch.column(1).to_pylist()]
            owner = np.repeat(np.array(batch.column(0).to_pylist(), dtype=np.int64), [len(f) for f in found])
            yield pa.RecordBatch.from_arrays([pa.array(owner), pa.array(np.concatenate(found).view(np.int64) if found else owner)], ["id", "h"])

    rows = texts.join(ids, "id", "left_semi").select("id", "text").mapInArrow(run, "id long, h long")
    own = rows.groupBy("h").agg(F.count("*").alias("c"), F.min("id").alias("id")).where("c = 1").groupBy("id").agg(F.count("*").alias("own"))
    return ids.join(sizes, "id").join(own, "id", "left").select("id", F.col("n_shingles").alias("n"), (F.col("n_shingles") - F.coalesce("own", F.lit(0))).alias("shared"))


def _differing(width: int, percent: int):
    """Members with their text and that of their reference to the differences of the two sets of shingles.

    n and d are the sizes of the set and of the symmetric difference. A pair is linked if and only if the sum
    of both excesses is at most `2 * (100 + percent)` for each difference that they share. `far` members are not
    linked to the reference. A shingle that is missing has the complement of its hash.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("ref", pa.int64()), ("id", pa.int64()), ("component", pa.int64()), ("n", pa.int64()), ("d", pa.int64()),
                            ("excess", pa.int64()), ("least", pa.int64()), ("differences", pa.list_(pa.int64()))])
        for batch in batches:
            last, base, rows = None, np.zeros(0, np.uint64), []
            for ref, id_, component, text, other in zip(*(c.to_pylist() for c in batch.columns)):
                if ref != last:
                    last, base = ref, _hash_words(other.split(" "), width)
                own = _hash_words(text.split(" "), width)
                d = np.concatenate((np.setdiff1d(own, base, True), ~np.setdiff1d(base, own, True))).view(np.int64)
                rows.append((ref, id_, component, len(own), len(d), (100 + percent) * len(d) - (100 - percent) * len(own), (percent - 100) * len(base), d))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)] if rows else [pa.array([], f.type) for f in schema], schema=schema)

    return run


def _second_pairs(rest: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Candidate pairs (a, b) among the members (ref, id, component) of each reference: every linked pair of
    different components is among them, or both of it are paired with the reference.

    A pair shares at least (excess + excess of the other) / gain differences. In order of rarity its first common
    one stands so early in both lists that this many can follow. One side is always a far member, the one with the
    larger excess; what it needs at least follows from the sizes that the threshold allows for its partner.
    """
    gain, step = 2 * (100 + percent), 100 + percent
    both = rest.join(texts.toDF("id", "ti"), "id").join(texts.toDF("ref", "tr"), "ref").select("ref", "id", "component", "ti", "tr")
    schema = "ref long, id long, component long, n long, d long, excess long, least long, differences array<long>"
    told = written_few(both.mapInArrow(_differing(width, percent), schema), "differences")
    star = told.where("excess + least <= 0").select(F.least("ref", "id").alias("a"), F.greatest("ref", "id").alias("b"))
    rows = told.select("ref", "id", F.explode("differences").alias("h"))
    counts = rows.groupBy("ref", "h").agg(F.count("*").alias("c"))
    ordered = rows.join(counts, ["ref", "h"]).groupBy("ref", "id").agg(F.sort_array(F.collect_list(F.struct("c", "h"))).alias("list"))
    listed = written_few(told.drop("differences").join(ordered, ["ref", "id"]), "ordered")

    def needed(value: Column) -> Column:
        return F.greatest(F.lit(1), F.ceil(value))

    def prefixes(df: DataFrame, need: Column, *names: str) -> DataFrame:
        """The first d - need + 1 differences with their places; those of one member only meet nobody."""
        size = (F.greatest(F.lit(0), F.col("d") - need + 1)).cast("int")
        out = df.select("ref", "id", "component", "n", "d", "excess", F.posexplode(F.slice("list", F.lit(1), size)).alias("at", "item"))
        return out.where("item.c > 1").select("ref", F.col("item.h").alias("h"), *(
            F.col(c).alias(n) for c, n in zip(("id", "component", "n", "excess"), names)
        ), (F.col("d") - F.col("at")).alias(names[-1]))

    # `left`, `right`: this difference and those that follow it.
    far = prefixes(listed.where("excess + least > 0"), needed((percent * F.col("excess") - 100 * (100 - percent) * F.col("n")) / (percent * step)), "x", "cx", "nx", "ex", "left")
    near = prefixes(listed, needed((F.col("excess") + F.greatest("excess", 1 - F.col("least"))) / gain), "y", "cy", "ny", "ey", "right")
    pairs = far.join(near, ["ref", "h"]).where(
        (F.struct("ey", "y") < F.struct("ex", "x")) & (F.col("cx") != F.col("cy")) & (100 * F.least("nx", "ny") >= percent * F.greatest("nx", "ny"))
        & (gain * F.least("left", "right") >= F.col("ex") + F.col("ey"))
    )
    return star.union(pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))).distinct()


def near_duplicate_links(signatures: DataFrame, body: DataFrame, width: int = 5, percent: int = 80, miss: float = MISS) -> DataFrame:
    """Links (a, b) that give the components of the classes (id, signature); body has (id, folded text)."""
    bands = signatures.select("id", F.explode(band_keys(F.col("signature"))).alias("band"))
    centres = bands.groupBy("band").agg(F.min_by("id", F.xxhash64("id", "band")).alias("centre"), F.count("*").alias("members")).where("members > 1")
    crowded = written_fewest(bands.join(centres, "band").select("band", "id", "centre", "members"), "bands")
    # Only texts of classes with a candidate are kept for the verification.
    texts = written_few(body.join(crowded.select("id").distinct(), "id", "left_semi"), "texts")
    first = crowded.where("id != centre").select(F.least("centre", "id").alias("a"), F.greatest("centre", "id").alias("b")).distinct()
    links = written_few(_links(first, signatures, texts, width, percent, miss), "links")
    # Second pass: pairs of different components in a band, but for those with the centre, which are done.
    of = connected_components(links, "a", "b").select(F.col("node").alias("id"), "component")
    degrees = links.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    rest = crowded.where("members > 2").join(of, "id", "left").join(degrees, "id", "left").select(
        "band", "id", (F.col("id") == F.col("centre")).alias("done"),
        F.coalesce("component", "id").alias("component"), F.coalesce("degree", F.lit(0)).alias("degree"),
    )
    other = F.when(~F.col("done"), F.col("component"))
    mixed = rest.groupBy("band").agg(
        F.min(other).alias("lo"), F.max(other).alias("hi"), F.max_by("id", F.struct("degree", -F.col("id"))).alias("ref")
    ).where("lo < hi").select("band", "ref")
    rest = written_fewest(rest.where("not done").join(mixed, "band").select("ref", "id", "component").distinct(), "mixed")
    shared = _shared_counts(rest.select("id").distinct(), signatures.select("id", "n_shingles"), texts, width)
    # A class too many of whose shingles are its own can't reach the threshold with any other.
    able = shared.where(100 * F.col("shared") >= percent * F.col("n")).select("id")
    second = _second_pairs(rest.where("id != ref").join(able, "id", "left_semi"), texts, width, percent).join(first, ["a", "b"], "left_anti")
    more = _links(second, signatures, texts, width, percent, miss)
    return written_few(links.union(more), "links")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, miss: float = MISS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): kept is the smallest id of a group."""
    body = docs.select(F.col(key).cast("long").alias("doc_id"), folded(F.col(text)).alias("text"))
    signed = written(
        body.mapInArrow(_signed(width, BANDS * ROWS), "doc_id long, digest binary, n_shingles long, signature binary"), "signed"
    )
    spokes = signed.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("id"))
    # Equal word sequences are one class; its smallest id speaks for it.
    of = written_fewest(signed.select("doc_id", "n_shingles", "digest").join(spokes, "digest", "left").select("doc_id", "n_shingles", F.coalesce("id", "doc_id").alias("id")), "classes")
    speaks = of.where("doc_id = id and n_shingles > 0").select("doc_id").distinct()
    signatures = written_few(
        signed.where("digest is not null").join(speaks, "doc_id", "left_semi").select(F.col("doc_id").alias("id"), "n_shingles", "signature").dropDuplicates(["id"]), "signatures"
    )
    links = near_duplicate_links(signatures, body.where("text != ''").withColumnRenamed("doc_id", "id"), width, percent, miss)
    groups = connected_components(links, "a", "b").select(F.col("node").alias("id"), "component")
    component = F.coalesce("component", "id")
    return of.join(groups, "id", "left").select(
        "doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id") == component).alias("kept")
    )


def word_shingles(text: str | None, width: int) -> set:
    """Shingles of one raw text, for tests and checks."""
    words = (text or "").translate(str.maketrans(UPPER, LOWER))
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    return shingle_set([w for w in words.split(" ") if w], width)
