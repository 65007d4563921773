"""Toxicity scores from a lexicon matched by Levenshtein automata (operator 12).

1. A lexicon of words and stems is learned from a bounded sample of labelled documents: candidates whose log-odds
   of toxic against clean documents are high even at their lower bound, picked greedily by what they newly explain.
2. The trie of the lexicon is intersected with the Levenshtein automata of its terms, and the product is made
   deterministic: a state is a set of (trie node, edits so far). Its table runs over the distinct words of a batch,
   one column of characters at a time. Short terms allow no edit, longer ones one or two; stems match the
   beginning of a word that goes on.
3. Each hit is judged by its context window: quotation marks around it or a reporting word ahead of it speak for
   quotation, a second person near it for abuse.
4. A logistic regression over sums of hit weights by these signs gives the score. Class weights restore the shares
   of all labelled training rows.

Scoring is one pass without a shuffle; tasks get the automaton and the weights, whose size `LEXICON` bounds.
Labels, language, source and id are no inputs of a score; rows whose crc32(id) modulo 3 is 1 teach nothing.

Defined results: null or empty texts have no hits and get the score of a text without hits; a null id is not held
out; a document with several labels is toxic if any says so; null labels are ignored; without toxic or clean
training rows every score is the share of toxic ones (0 without any); repeated rows are scored each; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Labelled documents that the classifier is fitted on, about, by label.
SAMPLE = {1: 6000, 0: 12000}
#: Terms in the lexicon at most.
LEXICON = 64
STEMS = range(3, 10)
LEAST_TOXIC, LEAST_LIFT = 4, 1.5
#: What a clean document costs against a toxic one when terms are chosen, by shares.
CLEAN_COST = 10
THRESHOLD = 0.7
#: Characters on each side of a hit that make its context.
CONTEXT = 80
QUOTES = {'"': '"', "“": "”", "„": "“", "«": "»", "‘": "’", "‹": "›"}
#: Words that report what others say, and words that address somebody. Fixed lists.
REPORTING = frozenset(
    "said says say wrote writes quoted quote quotes called calls word words term terms phrase means mean reported insult insults slur "
    "sagte sagt schrieb schreibt zitat nannte wort dit disait écrit mot citation dijo dice escribió palabra cita".split()
)
ADDRESS = frozenset("you your youre yours yourself u du dich dir dein deine ihr euch tu te toi ton ta vous votre tú ti tus usted ustedes vosotros".split())
WORD = re.compile(r"[^\W_]+")
FEATURES = 7


def allowed_edits(term: str) -> int:
    """Edits that a term allows; stems end in '+'."""
    if term.endswith("+"):
        return 1 if len(term) > 8 else 0
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


def candidates(words: Iterable[str]) -> set[str]:
    """Words of three letters or more, and their proper beginnings as stems."""
    words = {w for w in words if len(w) >= STEMS.start}
    return words | {w[:k] + "+" for w in words for k in range(STEMS.start, min(len(w), STEMS.stop))}


class Automaton:
    """Product of the lexicon's trie and its Levenshtein automata, as a table over character classes."""

    def __init__(self, terms: list[str]):
        self.terms = terms
        self.width = max((len(t) for t in terms), default=0) + 3
        letters = sorted({c for t in terms for c in t.rstrip("+")})
        # Class 0 ends a word, class 1 is any character that no term has.
        self.codes = np.array([ord(c) for c in letters], dtype=np.uint32)
        self._build(terms, {c: k + 2 for k, c in enumerate(letters)})

    def _build(self, terms: list[str], class_of: dict[str, int]) -> None:
        children: list[dict[int, int]] = [{}]
        ends: list[list[int]] = [[]]
        reach = [0]
        for t, term in enumerate(terms):
            node, edits = 0, allowed_edits(term)
            reach[0] = max(reach[0], edits)
            for c in term.rstrip("+"):
                if class_of[c] not in children[node]:
                    children[node][class_of[c]] = len(children)
                    children.append({})
                    ends.append([])
                    reach.append(0)
                node = children[node][class_of[c]]
                reach[node] = max(reach[node], edits)
            ends[node].append(t)

        def closed(found: dict) -> frozenset:
            """Add what skipped letters of a term reach; keep the fewest edits of a node, and finished stems."""
            work = list(found)
            while work:
                at = work.pop()
                if isinstance(at, tuple):
                    continue
                e = found[at] + 1
                for child in children[at].values():
                    if e <= reach[child] and e < found.get(child, 99):
                        found[child] = e
                        work.append(child)
            return frozenset(found.items())

        def step(state: frozenset, c: int) -> frozenset:
            after: dict = {}

            def put(at, e):
                if e < after.get(at, 99):
                    after[at] = e

            for at, e in state:
                if isinstance(at, tuple):
                    put(at, e)
                    continue
                # A finished stem needs one more character, which is this one.
                for t in ends[at]:
                    if terms[t].endswith("+") and e <= allowed_edits(terms[t]):
                        put((t,), e)
                if e < reach[at]:
                    put(at, e + 1)
                for label, child in children[at].items():
                    cost = e + (label != c)
                    if cost <= reach[child]:
                        put(child, cost)
            return closed(after)

        classes = len(class_of) + 2
        start = closed({0: 0})
        index, order, table = {start: 0}, [start], []
        for state in order:
            row = [index[state]] + [0] * (classes - 1)
            for c in range(1, classes):
                after = step(state, c)
                if after not in index:
                    index[after] = len(order)
                    order.append(after)
                row[c] = index[after]
            table.append(row)
        self.table = np.array(table, dtype=np.int32)
        self.term, self.edits = np.full(len(order), -1, dtype=np.int32), np.zeros(len(order), dtype=np.int32)
        for s, state in enumerate(order):
            found = [(e, t) for at, e in state if isinstance(at, tuple) for t in at]
            found += [(e, t) for at, e in state if not isinstance(at, tuple) for t in ends[at] if not terms[t].endswith("+") and e <= allowed_edits(terms[t])]
            if found:
                self.edits[s], self.term[s] = min(found)

    def match(self, words: list[str]) -> dict[str, tuple[int, int]]:
        """(term, edits) of each word that some term accepts: fewest edits, then the earlier term."""
        if not words or not self.terms:
            return {}
        chars = np.array(words, dtype=f"U{self.width}").view(np.uint32).reshape(len(words), self.width)
        at = np.searchsorted(self.codes, chars).clip(max=len(self.codes) - 1)
        classes = np.where(chars == 0, 0, np.where(self.codes[at] == chars, at + 2, 1))
        state = np.zeros(len(words), dtype=np.int32)
        for k in range(self.width):
            state = self.table[state, classes[:, k]]
        hit = np.flatnonzero(self.term[state] >= 0)
        return {words[i]: (int(self.term[state[i]]), int(self.edits[state[i]])) for i in hit.tolist()}


def quotation(text: str, start: int, end: int) -> float:
    """How much the context window says that a hit is quoted: 1 inside quotation marks, 0.5 after a reporting word."""
    left, right = text[max(0, start - CONTEXT) : start], text[end : end + CONTEXT]
    left, right = left.rpartition("\n")[2], right.partition("\n")[0]
    for opening, closing in QUOTES.items():
        if closing not in right:
            continue
        if opening == closing:
            if left.count(opening) % 2:
                return 1.0
        elif left.rfind(opening) > left.rfind(closing):
            return 1.0
    return 0.5 if REPORTING.intersection(WORD.findall(left.lower())[-6:]) else 0.0


def directed(text: str, start: int, end: int) -> bool:
    """Whether a second person is addressed within six words of a hit."""
    left, right = WORD.findall(text[max(0, start - CONTEXT) : start].lower())[-6:], WORD.findall(text[end : end + CONTEXT].lower())[:6]
    return not ADDRESS.isdisjoint(left) or not ADDRESS.isdisjoint(right)


@dataclass
class Model:
    automaton: Automaton
    weights: np.ndarray
    base_rate: float
    coefficients: np.ndarray | None = None

    def features(self, texts: list[str | None]) -> np.ndarray:
        """Sums of hit weights of whole texts: exact and misspelled, quoted and not, the largest, directed, density."""
        out = np.zeros((len(texts), FEATURES))
        lowered = [(t or "").lower() for t in texts]
        words = [WORD.findall(t) for t in lowered]
        distinct = [set(w) for w in words]
        known = self.automaton.match(list(set().union(*distinct)) if distinct else [])
        for row, (text, found) in enumerate(zip(lowered, distinct)):
            if known.keys().isdisjoint(found):
                continue
            sums, largest, toward, hits = np.zeros(4), 0.0, 0, 0
            for m in WORD.finditer(text):
                match = known.get(m.group())
                if match is None:
                    continue
                weight, misspelled = self.weights[match[0]], match[1] > 0
                quoted = quotation(text, *m.span())
                sums[2 * misspelled] += weight * (1 - quoted)
                sums[2 * misspelled + 1] += weight * quoted
                largest = max(largest, weight * (1 - quoted))
                toward += quoted < 1 and directed(text, *m.span())
                hits += 1
            out[row] = [*np.log1p(sums), largest, math.log1p(toward), math.log1p(100 * hits / len(words[row]))]
        return out

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.coefficients is None:
            return np.full(len(texts), self.base_rate)
        x = self.features(texts)
        return 1 / (1 + np.exp(-np.clip(x @ self.coefficients[1:] + self.coefficients[0], -30, 30)))


def fitted_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1.0) -> np.ndarray:
    """Weighted logistic regression by Newton steps; the intercept is not penalised."""
    x = np.column_stack([np.ones(len(x)), x])
    beta, shrink = np.zeros(x.shape[1]), np.diag([0.0] + [penalty] * (x.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (weight * (y - p)) - shrink @ beta
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + shrink + 1e-9 * np.eye(len(beta)), gradient)
        beta += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return beta


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, dict[int, int]]:
    """About `SAMPLE` labelled training documents (doc_id, toxic, text), and how many there are of each label.

    Rows are drawn by a hash of their id. Of texts with the same least hash over three-word shingles, which near
    copies mostly share, one stays.
    """
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    known = written(known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "labels")
    counts = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    draw = F.pmod(F.xxhash64(F.lit("toxicity"), "doc_id"), F.lit(1_000_000)) / 1_000_000
    chance = F.create_map(*[F.lit(v) for k, n in counts.items() for v in (k, min(1.0, SAMPLE[k] / n))]) if counts else None
    chosen = known.where(draw < chance[F.col("toxic")]) if counts else known

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            keys = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                w = WORD.findall((text or "").lower())
                keys.append(min((xxhash.xxh3_64_intdigest(" ".join(t)) >> 1 for t in zip(w, w[1:], w[2:])), default=i))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.int64())], ["doc_id", "toxic", "text", "key"])

    rows = docs.select("doc_id", "text").join(chosen, "doc_id").select("doc_id", "toxic", "text")
    rows = written(rows.mapInArrow(keyed, "doc_id long, toxic int, text string, key long"), "sample")
    least = F.min(F.struct("doc_id", F.xxhash64("text").alias("h"), "text"))
    return rows.groupBy("toxic", "key").agg(least.alias("one")).select("one.doc_id", "toxic", "one.text"), counts


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with each candidate, by label, of this batch."""
    for batch in batches:
        counts: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for toxic, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            counts[toxic].update(candidates(WORD.findall((text or "").lower())))
        # A candidate that no toxic document of any batch has is dropped by the aggregate.
        terms = list(counts[0].keys() | counts[1].keys())
        yield pa.RecordBatch.from_arrays(
            [pa.array(terms, pa.string()), pa.array([counts[1][t] for t in terms], pa.int64()), pa.array([counts[0][t] for t in terms], pa.int64())], ["term", "toxic", "clean"]
        )


def log_odds(toxic: float, clean: float, n_toxic: int, n_clean: int) -> tuple[float, float]:
    """Log-odds ratio of a term, smoothed, and its lower bound at two standard errors."""
    a, b, c, d = toxic + 0.5, n_toxic - toxic + 0.5, clean + 0.5, n_clean - clean + 0.5
    value = math.log(a / b) - math.log(c / d)
    return value, value - 2 * math.sqrt(1 / a + 1 / b + 1 / c + 1 / d)


def learned_lexicon(sample: DataFrame, n_toxic: int, n_clean: int) -> dict[str, float]:
    """Terms with their log-odds. The sample is bounded, and so is what comes to the driver from it."""
    counted = sample.mapInArrow(_counted, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    # What is certainly too weak stays with the executors.
    enough = counted.where((F.col("toxic") >= LEAST_TOXIC) & (F.col("toxic") * n_clean >= 3 * F.col("clean") * n_toxic))
    odds = {r.term: log_odds(r.toxic, r.clean, n_toxic, n_clean) for r in enough.collect()}
    strong = frozenset(t for t, (_, low) in odds.items() if low >= LEAST_LIFT)

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = [sorted(strong & candidates(WORD.findall((t or "").lower()))) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(terms, pa.list_(pa.string()))], ["toxic", "terms"])

    rows = sample.mapInArrow(held, "toxic int, terms array<string>").where(F.size("terms") > 0).collect() if strong else []
    of: dict[int, dict[str, set[int]]] = {0: {}, 1: {}}
    for i, r in enumerate(rows):
        for t in r.terms:
            of[r.toxic].setdefault(t, set()).add(i)
    chosen: dict[str, float] = {}
    covered: dict[int, Counter] = {0: Counter(), 1: Counter()}
    left = set(strong)
    while left and len(chosen) < LEXICON:
        # A document that k chosen terms have met counts 1 / 2^k. Ties: whole words, then longer terms.
        def gain(t: str) -> tuple:
            right, wrong = (sum(0.5 ** covered[k][i] for i in of[k].get(t, ())) for k in (1, 0))
            return right - CLEAN_COST * wrong * n_toxic / n_clean, not t.endswith("+"), len(t), t

        t = max(left, key=gain)
        if gain(t)[0] < max(LEAST_TOXIC, n_toxic / 500):
            break
        chosen[t] = odds[t][0]
        for k in (0, 1):
            covered[k].update(of[k].get(t, ()))
        # A term says nothing new beside one that begins it.
        stem = t.rstrip("+")
        left = {u for u in left if not (u.startswith(stem) or (u.endswith("+") and stem.startswith(u[:-1])))}
    return chosen


def fit_toxicity(docs: DataFrame, labels: DataFrame) -> Model:
    sample, counts = training_sample(docs, labels)
    total = counts.get(0, 0) + counts.get(1, 0)
    base = counts.get(1, 0) / total if total else 0.0
    if not counts.get(0) or not counts.get(1):
        return Model(Automaton([]), np.zeros(0), base)
    sample = written(sample, "distinct-sample")
    size = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not size.get(0) or not size.get(1):
        return Model(Automaton([]), np.zeros(0), base)
    lexicon = learned_lexicon(sample, size[1], size[0])
    model = Model(Automaton(list(lexicon)), np.array(list(lexicon.values())), base)
    if not lexicon:
        return model

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(model.features(batch.column(2).to_pylist()).tolist(), pa.list_(pa.float64()))], ["toxic", "x"])

    rows = sample.mapInArrow(measured, "toxic int, x array<double>").groupBy("toxic", "x").agg(F.count("*").alias("n")).collect()
    rows = sorted(rows, key=lambda r: (r.toxic, r.x))
    y = np.array([r.toxic for r in rows], dtype=float)
    weight = np.array([r.n * counts[r.toxic] / size[r.toxic] for r in rows])
    model.coefficients = fitted_logistic(np.array([r.x for r in rows]), y, weight)
    return model


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                scores = model.scores(part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(scores, pa.float64())], ["doc_id", "held_out", "score"])

    scored = docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score_toxicity(docs, fit_toxicity(docs, labels))
