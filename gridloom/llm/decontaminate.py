"""Benchmark decontamination by spaced seeds (operator 10, native).

Texts become tokens: lower case, runs of letters and digits. Each mask in MASKS selects some of the token
places in a window and ignores the rest. The hash of the selected tokens is equal in two texts although
tokens on ignored places differ, so hits survive substitutions. Hashes of all windows of the benchmark join
those of all windows of the documents. A hit fixes a diagonal (document place minus item place); on it the
tokens themselves are compared, and a document is contaminated when some `WINDOW` consecutive places, or the
whole of a shorter item, agree on 80 % of the tokens or more.

Only DataFrame functions are used. Seeds of the benchmark are broadcast when their counted number is at most
BROADCAST_SEEDS (16 bytes each and a little more); a larger benchmark joins by a shuffle. Documents make hash
rows that are dropped by the join in the same task, so nothing but hits is shuffled before the verification;
a common passage makes one candidate for each document that holds it.

Defined results: null and empty texts and items with fewer tokens than the shortest mask match nothing;
repeated rows give repeated pairs once; an empty table on either side gives an empty result; other columns are
not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fenced, written, written_fewest

#: Masks of weight 6. By simulation they hit 20 tokens with a probability of 0.998 if one token in ten is
#: substituted, and of 0.96 if it is one in five.
MASKS = ("1111011", "10100011011", "1100100001101")
WINDOW = 13
PERCENT = 80
BROADCAST_SEEDS = 2_000_000


def tokens_of(text: Column) -> Column:
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " ")
    return F.filter(F.split(plain, " "), lambda w: w != "")


def _seed_hashes(hashed: Column) -> Column:
    """Hashes of all windows of all masks, mask after mask."""

    def selected(k: int, mask: str):
        places = [i for i, c in enumerate(mask) if c == "1"]
        return lambda i: F.xxhash64(F.lit(k), *[F.get(hashed, i + p) for p in places])

    parts = []
    for k, mask in enumerate(MASKS):
        last = F.size(hashed) - len(mask)
        one = F.transform(F.sequence(F.lit(0), last), selected(k, mask))
        parts.append(F.when(last >= 0, one).otherwise(F.array().cast("array<bigint>")))
    return F.concat(*parts)


def _place(at: Column, n: Column) -> Column:
    """Place of a window in its text, from its number in the list of all masks' windows."""
    sizes = [F.greatest(n - len(m) + 1, F.lit(0)) for m in MASKS]
    out, before = None, F.lit(0)
    for size in sizes:
        here = at - before
        out = F.when(at < before + size, here) if out is None else out.when(at < before + size, here)
        before = before + size
    return out


def seeds(texts: DataFrame, key: str, text: str, name: str) -> DataFrame:
    """(name, place, seed) for each window of each mask."""
    hashed = texts.select(F.col(key).alias(name), F.transform(tokens_of(F.col(text)), lambda w: F.xxhash64(w)).alias("h"))
    listed = hashed.select(name, F.size("h").alias("n"), F.posexplode(_seed_hashes(F.col("h"))).alias("at", "seed"))
    return listed.select(name, _place(F.col("at"), F.col("n")).alias("place"), "seed")


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast hint behind a count; a larger table is joined by a shuffle."""
    return F.broadcast(df) if df.count() <= rows else df


def _best_window(flags: Column) -> tuple[Column, Column]:
    """Most agreeing places in a window, and the window's length."""
    width = F.least(F.size(flags), F.lit(WINDOW))
    counts = F.transform(
        F.sequence(F.lit(1), F.size(flags) - width + 1),
        lambda i: F.aggregate(F.slice(flags, i, width), F.lit(0), lambda a, x: a + x),
    )
    return F.array_max(counts), width


def contaminated_pairs(docs: DataFrame, benchmark: DataFrame, doc_key: str = "doc_id", item_key: str = "item_id", text: str = "text") -> DataFrame:
    """(doc_id, item_id, matched, compared): pairs with a verified overlap, with the best window's counts."""
    wanted = written(seeds(benchmark, item_key, text, "item_id").withColumnRenamed("place", "item_place"), "seeds")
    found = seeds(docs, doc_key, text, "doc_id").join(bounded(wanted, BROADCAST_SEEDS), "seed")
    lines = written_fewest(
        found.groupBy("doc_id", "item_id", (F.col("place") - F.col("item_place")).alias("shift")).agg(F.count("*").alias("hits")), "hits"
    )
    items = benchmark.select(F.col(item_key).alias("item_id"), tokens_of(F.col(text)).alias("it"))
    items = written(items.where(F.size("it") >= min(map(len, MASKS))), "items")
    near = lines.join(bounded(items, BROADCAST_SEEDS // 100), "item_id")
    body = docs.select(F.col(doc_key).alias("doc_id"), F.col(text).alias("body"))
    both = fenced(body.join(near, "doc_id").withColumn("dt", tokens_of(F.col("body"))).drop("body"))
    low = F.greatest(F.lit(0), -F.col("shift"))
    high = F.least(F.size("it"), F.size("dt") - F.col("shift")) - 1
    flags = F.when(low <= high, F.transform(F.sequence(low, high), lambda j: (F.get("it", j) == F.get("dt", j + F.col("shift"))).cast("int")))
    judged = fenced(both.withColumn("flags", flags).withColumn("whole", F.least(F.size("it"), F.lit(WINDOW))).drop("it", "dt")).where("flags is not null")
    matched, compared = _best_window(F.col("flags"))
    judged = fenced(judged.select("doc_id", "item_id", matched.alias("matched"), compared.alias("compared"), "whole"))
    kept = judged.where((F.col("compared") == F.col("whole")) & (100 * F.col("matched") >= PERCENT * F.col("compared")))
    return kept.groupBy("doc_id", "item_id").agg(F.max("matched").cast("long").alias("matched"), F.max("compared").cast("long").alias("compared"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id") -> DataFrame:
    """Documents without a verified overlap, columns unchanged; rows without an id are kept."""
    name = "__bad"
    while name in docs.columns:
        name += "_"
    bad = contaminated_pairs(docs, benchmark, key).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(bad, F.col(key) == F.col(name), "left_anti")
