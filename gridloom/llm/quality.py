"""Quality rules whose thresholds adapt to each language and source (operator 9, native).

Every document gets a few whole-text measures. For each (language, source) the values go into KLL
sketches, which merge: tasks merge into a source, sources into a language, languages into the corpus.
A group with too few documents takes the thresholds of its language, or else of the corpus. The
thresholds are joined back to the documents, which fail when a measure lies outside them.

Only DataFrame functions are used. No document text is shuffled: thresholds are as many rows as there are
groups. Tasks sketch their own rows first, so a hot source costs one sketch per task.

Defined results: null or blank text has no words and fails; null language or source are groups of their
own; repeated rows are judged one by one; an empty table gives an empty result; columns that are not asked
for are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fenced, words_of, written

SYMBOLS = "[#*$%&|<>]"
WINDOW = 5
#: (measure, rank of the middle, rank of the outer mark, spreads allowed, least distance from the middle).
#: A threshold lies `spreads` times (outer - middle) beyond the middle, and at least the least distance.
RULES = (
    ("word_length", 0.5, 0.75, 8.0, 4.0, "both"),
    ("symbol_ratio", 0.5, 0.75, 4.0, 0.75, "high"),
    ("dup_line_ratio", 0.5, 0.75, 4.0, 0.6, "high"),
    ("repeat_ratio", 0.5, 0.75, 4.0, 0.2, "high"),
)
LEAST_DOCS = 200
SKETCH_K = 400


def _windows(words: Column, make) -> Column:
    n = F.size(words) - WINDOW
    return F.when(n >= 0, F.transform(F.sequence(F.lit(0), n), make)).otherwise(F.array())


def _window_text(words: Column):
    return lambda i: F.concat_ws(" ", *[F.get(words, i + k) for k in range(WINDOW)])


def _window_hash(words: Column):
    return lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)])


def _marked(pairs: Column) -> Column:
    """Elements (v, i) of a sorted array whose v equals a neighbour's, null for the others."""
    last = F.size(pairs) - 1
    return F.transform(
        F.sequence(F.lit(0), last),
        lambda k: F.when(
            ((k > 0) & (F.get(pairs, k - 1)["v"] == F.get(pairs, k)["v"])) | ((k < last) & (F.get(pairs, k + 1)["v"] == F.get(pairs, k)["v"])),
            F.get(pairs, k),
        ),
    )


def _covered(places: Column) -> Column:
    """Words in windows at sorted places, each once."""
    counted = F.aggregate(
        places,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last")),
        lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["last"])).cast("long").alias("n"), i.alias("last")),
    )
    return counted["n"]


def with_repeated_words(rows: DataFrame, words: str, name: str) -> DataFrame:
    """Words covered by 5-word windows that the text holds twice or more.

    Equal windows have equal hashes, so texts whose hashes all differ are done. For others, windows whose hash
    occurs again are compared by their words. Each step is fenced, as the next one reads its array in lambdas.
    """
    w = F.col(words)
    rows = fenced(rows.withColumn("__h", _windows(w, _window_hash(w))))
    again = F.size(F.array_distinct("__h")) < F.size("__h")
    rows = fenced(rows.withColumn("__p", F.when(again, F.array_sort(F.transform("__h", lambda v, i: F.struct(v.alias("v"), i.alias("i")))))).drop("__h"))
    rows = fenced(rows.withColumn("__c", F.when(F.col("__p").isNotNull(), F.filter(_marked(F.col("__p")), lambda x: x.isNotNull()))).drop("__p"))
    texts = F.array_sort(F.transform("__c", lambda x: F.struct(_window_text(w)(x["i"]).alias("v"), x["i"].alias("i"))))
    rows = fenced(rows.withColumn("__t", texts).drop("__c"))
    places = F.array_sort(F.transform(F.filter(_marked(F.col("__t")), lambda x: x.isNotNull()), lambda x: x["i"]))
    rows = fenced(rows.withColumn("__places", F.when(F.size("__t") > 0, places)).drop("__t"))
    return fenced(rows.withColumn(name, F.coalesce(_covered(F.col("__places")), F.lit(0).cast("long"))).drop("__places"))


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the base measures as columns; the text stays as it is."""
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^ \t-\r]"))
    out = fenced(docs.withColumn("__w", words_of(F.col(text))).withColumn("__l", lines))
    out = with_repeated_words(out, "__w", "n_repeat_words").withColumns({
        "n_words": F.size("__w").cast("long"),
        "word_chars": F.length(F.array_join("__w", "")).cast("long"),
        "n_symbols": F.regexp_count(body, F.lit(SYMBOLS)).cast("long"),
        "n_dup_lines": (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long"),
        "__n_lines": F.size("__l").cast("long"),
    })
    return fenced(out.drop("__w", "__l")).withColumn(
        "base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    ).drop("__fence")


def _ratios() -> dict[str, Column]:
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    return {
        "word_length": share("word_chars", "n_words"),
        "symbol_ratio": share("n_symbols", "n_words"),
        "dup_line_ratio": share("n_dup_lines", "__n_lines"),
        "repeat_ratio": share("n_repeat_words", "n_words"),
    }


def sketches(measured: DataFrame) -> DataFrame:
    """One row per (lang, source) with a sketch per measure, over documents with words."""
    ratios = _ratios()
    return measured.where("n_words > 0").groupBy("lang", "source").agg(
        F.count("*").alias("docs"), *[F.kll_sketch_agg_double(ratios[m].alias(m), F.lit(SKETCH_K)).alias(m) for m, *_ in RULES]
    )


def thresholds(groups: DataFrame) -> DataFrame:
    """Low and high mark of each measure for each (lang, source), from the smallest level with enough documents."""
    merged = [F.kll_merge_agg_double(m, F.lit(SKETCH_K)).alias(m) for m, *_ in RULES]
    own = groups.withColumnRenamed("docs", "n0").withColumnsRenamed({m: f"{m}0" for m, *_ in RULES})
    lang = groups.groupBy(F.col("lang").alias("__lang")).agg(F.sum("docs").alias("n1"), *merged)
    lang = lang.withColumnsRenamed({m: f"{m}1" for m, *_ in RULES})
    whole = groups.agg(*merged).withColumnsRenamed({m: f"{m}2" for m, *_ in RULES}).withColumn("__one", F.lit(1))
    joined = (
        own.join(lang, F.col("lang").eqNullSafe(F.col("__lang")))
        .withColumn("__one", F.lit(1)).join(whole, "__one")
    )
    level = F.when(F.col("n0") >= LEAST_DOCS, 0).when(F.col("n1") >= LEAST_DOCS, 1).otherwise(2)
    out = [F.col("lang").alias("__lang"), F.col("source").alias("__source"), level.alias("level")]
    for m, mid, outer, spreads, least, sides in RULES:
        at = lambda rank, m=m: F.when(level == 0, F.kll_sketch_get_quantile_double(f"{m}0", F.lit(rank))).when(level == 1, F.kll_sketch_get_quantile_double(f"{m}1", F.lit(rank))).otherwise(F.kll_sketch_get_quantile_double(f"{m}2", F.lit(rank)))
        middle = at(mid)
        out.append((middle + F.greatest(F.lit(least), spreads * (at(outer) - middle))).alias(f"{m}_high"))
        if sides == "both":
            out.append((middle - F.greatest(F.lit(least), spreads * (middle - at(1 - outer)))).alias(f"{m}_low"))
    return joined.select(*out)


def quality_verdicts(docs: DataFrame, keep: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """Columns to keep, measures and `kept`: false if a base rule fails or a measure lies outside the
    thresholds of its language and source."""
    wanted = list(dict.fromkeys([*keep, text, "lang", "source"]))
    # The texts are measured once; the sketches read the numbers only.
    measured = written(measures(docs.select(*wanted), text).drop(*[c for c in wanted if c not in {*keep, "lang", "source"}]), "measures")
    limits = thresholds(sketches(measured))
    joined = measured.join(limits, F.col("lang").eqNullSafe(F.col("__lang")) & F.col("source").eqNullSafe(F.col("__source")), "left")
    ratios, inside = _ratios(), []
    for m, *_, sides in RULES:
        inside.append(ratios[m] <= F.col(f"{m}_high"))
        if sides == "both":
            inside.append(ratios[m] >= F.col(f"{m}_low"))
    verdict = F.coalesce(reduce(lambda a, b: a & b, inside), F.lit(False))
    marks = [f"{m}_{s}" for m, *_, sides in RULES for s in (("high", "low") if sides == "both" else ("high",))]
    return joined.withColumn("kept", ~F.col("base_failed") & verdict).drop(*[c for c in wanted if c not in keep], "__lang", "__source", "__n_lines", "level", *marks)
