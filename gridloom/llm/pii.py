"""Personal data by candidate gradient boosting (operator 2, native).

One pass over the texts finds the base spans (e-mail, IP, card, phone by fixed formats and checks) and the
candidates of high-recall generators, which overlap each other and the base spans. Boosted trees judge the
candidates by format and context features. They learn from the corpus itself: a candidate that meets a base
span, which passed its format check, or the evidence of its own generator is an example of personal data, any
other is a counterexample. Evidence is an e-mail address once the disguise is taken off, a number of 7 to 15
digits behind a contact word, the IBAN check, and the shape of a MAC or IPv6 address. Half of the documents, by
hash, are held out. The trees are fitted on at most SAMPLE_ROWS candidates of the others, the same number of each
generator at most; all candidates of the held-out half calibrate a threshold per generator, the lowest one whose
precision is at least PRECISION. A generator with fewer than LEAST_CALIBRATED of them takes the threshold of all
generators together. Candidates above it that don't overlap a base span are added spans, the likelier one of two
that overlap each other. Base spans are never changed.

Only DataFrame functions and Spark's own trees are used. The texts are never shuffled; candidates are a small
table. Patterns are possessive, so that they take linear time on long runs of one kind of character.

Places are code points, ends are exclusive. Defined results: null and empty texts have no spans; repeated rows
are judged each; a table whose sample has examples of one kind only adds no spans; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

KINDS = ("email", "ip", "card", "phone")
#: Base formats. A search begins where the last match ended (\G) or at the start of a run of local-part
#: characters, which finds the same leftmost matches without trying every character of a run.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Generators: addresses in disguise, grouped numbers, codes of letters and digits, groups with colons.
GENERATORS = (
    ("x_address", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:@|\x20?[\[(](?:at|@)[\])]\x20?|\x20at\x20)[A-Za-z0-9-]++(?:(?:\.|\x20?[\[(](?:dot|\.)[\])]\x20?|\x20dot\x20)[A-Za-z0-9-]++)++"),
    ("x_number", r"[+(]?[0-9](?:[\x20().\-/]{0,2}[0-9]){6,24}+"),
    ("x_code", r"(?<![A-Za-z0-9])[A-Z]{1,3}[0-9]{2}(?:\x20?[A-Z0-9]{3,4}){2,8}+(?:[A-Z0-9]{1,2}|\x20[0-9]{1,2}(?![A-Za-z0-9]))?+(?![A-Za-z0-9])"),
    ("x_colons", r"(?<![0-9A-Za-z:])[0-9A-Fa-f]{1,4}(?::{1,2}[0-9A-Fa-f]{1,4}){3,7}+(?![0-9A-Za-z:])"),
)
CONTEXT = 30
FEATURES = (
    "generator", "length", "digits", "letters", "capitals", "separators", "groups", "longest_group", "dots", "at_sign", "distinct",
    "plus", "contact_word", "money_word", "id_word", "assigned", "after_number", "before_number", "symbols_near",
)
SAMPLE_ROWS = 20_000
PRECISION = 0.98
LEAST_CALIBRATED = 30
SPAN = "array<struct<s:int,e:int,m:string>>"
SEED = 11


def located(text: Column, pattern: str) -> Column:
    """All leftmost matches with their places. Pieces between matches give the places."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    pairs = F.zip_with(matches, F.slice(gaps, 1, F.size(matches)), lambda m, g: F.struct(F.length(g).alias("g"), m.alias("m")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

    def step(a, x):
        s = (a["at"] + x["g"]).cast("int")
        e = (s + F.length(x["m"])).cast("int")
        return F.struct(e.alias("at"), F.concat(a["out"], F.array(F.struct(s.alias("s"), e.alias("e"), x["m"].alias("m")))).alias("out"))

    return F.when(F.size(matches) > 0, F.aggregate(pairs, start, step)["out"]).otherwise(F.array().cast(SPAN))


def _only(text: Column, test: Column, spans: Column) -> Column:
    """Skip texts that a cheap test rules out."""
    return F.when(test, spans).otherwise(F.array().cast(SPAN))


def _part_ok() -> str:
    return r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"


def luhn(digits: Column) -> Column:
    n = F.length(digits)

    def value(i):
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = F.pmod(n - i, F.lit(2)) == 1
        return F.when(twice, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)

    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda a, i: a + value(i))
    return F.pmod(total, F.lit(10)) == 0


def base_spans(text: Column) -> dict[str, Column]:
    """Array of (s, e, m) per base kind, checks applied."""
    ip_ok = "^" + r"\.".join([_part_ok()] * 4) + "$"

    def card_ok(x):
        digits = F.translate(x["m"], " -", "")
        return F.when(F.length(digits).between(16, 19), luhn(digits)).otherwise(F.lit(False))

    return {
        "email": _only(text, F.contains(text, F.lit("@")), located(text, EMAIL)),
        "ip": F.filter(located(text, IP), lambda x: x["m"].rlike(ip_ok)),
        "card": F.filter(located(text, CARD), card_ok),
        "phone": F.filter(
            _only(text, F.contains(text, F.lit("+")), located(text, PHONE)),
            lambda x: F.length(F.regexp_replace(x["m"], "[^0-9]", "")).between(8, 15),
        ),
    }


CONTACT_WORD = r"(?i)(mail|e-mail|phone|tel|call|fax|mobile|contact)"


def iban_ok(code: Column) -> Column:
    """Remainder 1 of 97, with the first four characters last and letters as 10 to 35."""
    plain = F.translate(code, " ", "")
    turned = F.concat(F.substr(plain, F.lit(5)), F.substring(plain, 1, 4))
    left = F.aggregate(
        F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0),
        lambda a, c: F.when(c.rlike("[0-9]"), F.pmod(a * 10 + F.coalesce(c.try_cast("int"), F.lit(0)), F.lit(97))).otherwise(F.pmod(a * 100 + F.ascii(c) - 55, F.lit(97))).cast("int"),
    )
    return F.when(plain.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$"), left == 1).otherwise(F.lit(False))


def evidence(generator: int, m: Column, before: Column) -> Column:
    """Whether a candidate passes the check of its own generator."""
    name = GENERATORS[generator][0]
    if name == "x_address":
        at = F.regexp_replace(m, r"\x20?[\[(](?:at|@)[\])]\x20?|\x20at\x20", "@")
        plain = F.regexp_replace(at, r"\x20?[\[(](?:dot|\.)[\])]\x20?|\x20dot\x20", ".")
        return plain.rlike(r"^[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++$") & plain.rlike(r"\.[A-Za-z]{2,24}$")
    if name == "x_number":
        return before.rlike(CONTACT_WORD) & F.length(F.regexp_replace(m, "[^0-9]", "")).between(7, 15)
    if name == "x_code":
        return iban_ok(m)
    mac = m.rlike("^[0-9A-Fa-f]{2}(?::[0-9A-Fa-f]{2}){5}$")
    full = m.rlike("^[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}$")
    short = m.rlike("^[0-9A-Fa-f:]+$") & (F.length(m) - F.length(F.replace(m, F.lit("::"), F.lit(":"))) == 1)
    return mac | full | short


def _features(text: Column, generator: int):
    def make(x):
        m = x["m"]
        before = F.substring(text, F.greatest(x["s"] - CONTEXT, F.lit(0)) + 1, F.least(x["s"], F.lit(CONTEXT)))
        after = F.substring(text, x["e"] + 1, F.lit(CONTEXT))
        count = lambda pattern: (F.length(m) - F.length(F.regexp_replace(m, pattern, ""))).cast("double")
        flag = lambda c: c.cast("double")
        groups = F.filter(F.split(m, "[^A-Za-z0-9]+"), lambda g: g != "")
        near = F.concat(before, after)
        return F.struct(
            F.lit(generator).alias("g"), x["s"].alias("s"), x["e"].alias("e"),
            F.array(
                F.lit(float(generator)), F.length(m).cast("double"), count("[0-9]"), count("[A-Za-z]"), count("[A-Z]"), count("[^A-Za-z0-9]"),
                F.size(groups).cast("double"), F.coalesce(F.array_max(F.transform(groups, lambda g: F.length(g))), F.lit(0)).cast("double"), count("[.]"),
                flag(F.contains(m, F.lit("@"))), F.size(F.array_distinct(F.split(m, ""))).cast("double"), flag(m.startswith("+")),
                flag(before.rlike(CONTACT_WORD)), flag(before.rlike(r"(?i)(card|visa|iban|account|bank|pay)")),
                flag(before.rlike(r"(?i)\b(ssn|id|passport|license|user|name|ip|host|address|born)\b")), flag(before.rlike(r"[:=#]\s*[\"']?$")),
                flag(before.rlike(r"[0-9][^A-Za-z]{0,3}$")), flag(after.rlike(r"^[^A-Za-z]{0,3}[0-9]")),
                (F.length(near) - F.length(F.translate(near, "#*$%&|<>{}", ""))).cast("double"),
            ).alias("f"),
            evidence(generator, m, before).alias("ok"),
        )

    return make


def scanned(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: base spans per kind and candidates with features. No text."""
    body = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.monotonically_increasing_id().alias("row"))
    found = body.withColumns({**base_spans(F.col("text")), **{name: located(F.col("text"), p) for name, p in GENERATORS}})
    candidates = F.concat(*[F.transform(F.col(name), _features(F.col("text"), k)) for k, (name, _) in enumerate(GENERATORS)])
    slim = [F.transform(F.col(k), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"))).alias(k) for k in KINDS]
    return found.select("doc_id", "row", *slim, candidates.alias("candidates"))


def _meets(spans: Column, s: Column, e: Column) -> Column:
    return F.exists(spans, lambda b: (b["s"] < e) & (s < b["e"]))


def candidates_of(scan: DataFrame) -> DataFrame:
    """One row per candidate, whether it meets a base span, and its weak label."""
    base = F.concat(*[F.col(k) for k in KINDS])
    rows = scan.where(F.size("candidates") > 0).select("row", base.alias("base"), F.explode("candidates").alias("c"))
    flat = rows.select("row", "c.g", "c.s", "c.e", "c.f", "c.ok", _meets(F.col("base"), F.col("c.s"), F.col("c.e")).alias("known"))
    label = (F.col("known") | F.coalesce("ok", F.lit(False))).cast("double")
    return flat.select("row", "g", "s", "e", "known", label.alias("label"), *[F.col("f")[i].alias(n) for i, n in enumerate(FEATURES)])


def _mark(bins: list[tuple[int, float, int]], least: int = LEAST_CALIBRATED) -> float | None:
    """Lowest score from which precision is high enough."""
    good, n, out = 0.0, 0, None
    for b, x, k in sorted(bins, reverse=True):
        good, n = good + x, n + k
        if n >= least and good >= PRECISION * n:
            out = b / 100
    return out


def calibrated(held: DataFrame) -> dict[int, float]:
    """Threshold per generator from all held-out candidates. At most 101 rows per generator reach the driver."""
    bins = held.groupBy("g", F.floor(F.col("score") * 100).alias("bin")).agg(F.sum("label").alias("good"), F.count("*").alias("n"))
    per: dict[int, list] = {g: [] for g in range(len(GENERATORS))}
    together: dict[int, list] = {}
    for r in bins.collect():
        per[r["g"]].append((r["bin"], r["good"], r["n"]))
        good, n = together.get(r["bin"], (0.0, 0))
        together[r["bin"]] = (good + r["good"], n + r["n"])
    common = _mark([(b, *x) for b, x in together.items()])
    marks = {g: _mark(rows) if sum(n for *_, n in rows) >= LEAST_CALIBRATED else common for g, rows in per.items()}
    return {g: t for g, t in marks.items() if t is not None}


def judged(candidates: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame | None:
    """Candidates outside base spans that the calibrated trees select, or None where nothing can be learnt."""
    candidates = written(candidates.withColumn("held", F.pmod(F.xxhash64("row", F.lit(SEED)), F.lit(2)) == 1), "candidates")
    draw = F.xxhash64("row", "s", "e", "g", F.lit(SEED))
    drawn = [
        candidates.where((F.col("g") == g) & ~F.col("held")).orderBy(draw, "row", "s", "e").limit(sample_rows // len(GENERATORS)) for g in range(len(GENERATORS))
    ]
    sample = written(reduce(DataFrame.unionByName, drawn), "sample")
    if sample.agg((F.min("label") < F.max("label")).alias("both")).first()["both"] is not True:
        return None
    assembler = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    trees = GBTClassifier(labelCol="label", featuresCol="features", maxIter=8, maxDepth=4, seed=SEED, stepSize=0.3)
    model = trees.fit(assembler.transform(sample))
    scored = model.transform(assembler.transform(candidates)).select("row", "g", "s", "e", "known", "held", "label", vector_to_array("probability")[1].alias("score"))
    scored = written(scored, "scored")
    marks = calibrated(scored.where("held"))
    if not marks:
        return None
    chosen = reduce(lambda a, b: a | b, [(F.col("g") == g) & (F.col("score") >= t) for g, t in marks.items()])
    return scored.where(~F.col("known") & chosen).select("row", "g", "s", "e", "score")


def _best_of_overlaps(spans: Column) -> Column:
    """Greedy choice by score; the added spans of one text."""
    order = F.array_sort(spans, lambda a, b: F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1).otherwise(a["s"] - b["s"]))
    return F.aggregate(order, F.slice(spans, 1, 0), lambda kept, x: F.when(_meets(kept, x["s"], x["e"]), kept).otherwise(F.concat(kept, F.array(x))))


def personal_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, n_added, base_sha256, spans)."""
    scan = written(scanned(docs, key, text), "scan")
    named = lambda kind, spans: F.transform(spans, lambda x: F.concat(F.lit(f"{kind}:"), x["s"].cast("string"), F.lit(":"), x["e"].cast("string")))
    base = F.concat(*[named(k, F.col(k)) for k in KINDS])
    added = judged(candidates_of(scan), sample_rows)
    out = scan.drop("candidates")
    if added is None:
        more = F.array().cast("array<string>")
    else:
        per_text = added.groupBy("row").agg(F.collect_list(F.struct("g", "s", "e", "score")).alias("__more"))
        out = out.join(per_text, "row", "left")
        spans = _best_of_overlaps(F.coalesce("__more", F.array().cast("array<struct<g:int,s:int,e:int,score:double>>")))
        names = F.lit([name for name, _ in GENERATORS])
        more = F.transform(
            F.array_sort(F.transform(spans, lambda x: F.struct(x["g"].alias("g"), x["s"].alias("s"), x["e"].alias("e")))),
            lambda x: F.concat_ws(":", F.get(names, x["g"]), x["s"].cast("string"), x["e"].cast("string")),
        )
    out = out.withColumn("__base", base).withColumn("__added", more)
    return out.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS], F.size("__added").cast("long").alias("n_added"),
        F.sha2(F.array_join("__base", ","), 256).alias("base_sha256"), F.array_join(F.concat("__base", "__added"), ",").alias("spans"),
    )
