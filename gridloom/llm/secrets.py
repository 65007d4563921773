"""Secret scan with password guess costs (operator 4).

Three fixed formats are found in every whole text. Values that stand behind a credential word, in forms that
the fixed formats do not know (other words, quotes, symbols, "is"), are judged by how many guesses they would
cost: dynamic programming finds the cheapest split of a value into words, dates, repeats, keyboard walks and
brute-force spans. Values that cost at least `least_log10` decimal digits of guesses are spans of the kind
`guess`; placeholders such as `changeme123` are not. A value is taken to its end, whatever its length; one that
a fixed format covers in part is a span as a whole, without a cost.

Words are ranked by their counts over all documents, outside of values behind credential words: an aggregate
that gives the driver at most `VOCABULARY` words. Judging is one pass of mapInArrow without a shuffle. Patterns
are linear in the text, and so is the cost of a value: repeats and walks keep only starts that may still win, and
splitting ends where no split can fall below the threshold any more.

Defined results: null and empty texts have no spans; repeated rows are judged each; an empty table gives an
empty result; other columns are kept by `redact_secrets` and not read by `secret_spans`.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written_fewest

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
#: A credential word, something that assigns, perhaps a scheme word, and a value up to white space or a quote.
CONTEXT = re.compile(
    r"""(?:pass(?:word|wd|phrase|code)?|pwd|pin|secret|token|credentials?|login|auth(?:orization)?|api[_-]?key|access[_-]?key|private[_-]?key)["']?\x20*(?::=|=>|[:=]|(\bis\b))\x20*["']?(?:(?:bearer|basic|digest|negotiate|token|apikey)\x20+)?([^\s"'`,;<>]{6,})""",
    re.I | re.A,
)
#: Characters before the end of a value in which a further credential word may begin that assigns after it.
TAIL = 24
KINDS = ("assign", "access", "hex", "guess")
#: Decimal digits of guesses from which a value counts as a secret.
LEAST_LOG10 = 11.0
#: The most frequent words of the documents get ranks; a word has 3 to `LONGEST_WORD` letters.
VOCABULARY = 30_000
LONGEST_WORD = 24
#: Words that a task counts before it hands its counts on.
COUNTED = 200_000

# Common password words in order of rank, and rows of a keyboard.
COMMON = (
    "password pass admin user login welcome qwerty abc letmein secret root test guest master dragon monkey shadow "
    "sunshine princess football baseball hello freedom whatever trust love change changeme default example sample "
    "demo temp temporary access system server manager service public private key token api data base database "
    "home work office summer winter spring autumn monday friday january march april june july august october "
    "your my the and for not new old none null true false value string name account security placeholder here "
    "insert enter redacted hidden xxxx super star blue red green black white silver gold tiger lion eagle"
).split()
KEYBOARD = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm", "abcdefghijklmnopqrstuvwxyz")
LEET = str.maketrans("@4310$57!", "aaeiossti")

_RANK = {w: i + 1 for i, w in enumerate(COMMON)}
_WORD = re.compile(r"[^\W\d_]{3,}")
_NEXT = {(a, b) for row in KEYBOARD for r in (row, row[::-1]) for a, b in zip(r, r[1:])}
_DATE = re.compile(r"(?:(?:19|20)\d\d[-./]?\d{1,2}[-./]?\d{1,2}|\d{1,2}[-./]?\d{1,2}[-./]?(?:19|20)\d\d|(?:19|20)\d\d)")


def _classes(text: str) -> int:
    size = 0
    for wanted, n in ((str.islower, 26), (str.isupper, 26), (str.isdigit, 10)):
        size += n if any(map(wanted, text)) else 0
    return size + (33 if any(not c.isalnum() for c in text) else 0) or 1


class _Starts:
    """Starts of one unbroken run from which a segment may reach the present place, for a cost of log10(count).

    The logarithm is concave: an older start that is no dearer than a newer one stays so, and the newer one goes.
    """

    def __init__(self) -> None:
        self.held: list[tuple[int, float]] = []

    def cheapest(self, j: int, unit: int, start: int, cost: float) -> float:
        held = self.held
        at = lambda x: x[1] + math.log10((j - x[0]) // unit)
        while len(held) > 1 and at(held[-2]) <= at(held[-1]):
            held.pop()
        if not held or cost + math.log10((j - start) // unit) < at(held[-1]) - 1e-12:
            held.append((start, cost))
        return at(held[-1])


def guess_log10(value: str, enough: float = math.inf, ranks: dict[str, int] | None = None) -> float:
    """Decimal logarithm of the guesses that the cheapest segmentation of a value needs.

    Where every segmentation needs `enough`, some number of at least `enough`.
    """
    ranks = _RANK if ranks is None else ranks
    # Some letters have a lower case of two characters; places must be those of the value.
    n, low = len(value), "".join(c.lower() if len(c.lower()) == 1 else c for c in value)
    plain = low.translate(LEET)
    per_char = math.log10(_classes(value))
    best = [0.0] + [math.inf] * n
    dates: dict[int, list[int]] = {}
    for i in range(n):
        m = _DATE.match(value, i) if value[i].isdigit() else None
        if m:
            dates.setdefault(m.end(), []).append(i)
    walk, walked, walk_cost = _Starts(), 1, 0.3 + math.log10(len(KEYBOARD) * 20)
    # The repeated part is guessed once, then its number of repeats.
    part_cost = [min(p * per_char, 1.5 + p * per_char * 0.9) for p in range(9)]
    repeats = [[_Starts() for _ in range(p)] for p in range(9)]
    equal = [0] * 9
    for j in range(1, n + 1):
        cost = best[j - 1] + per_char
        for i in range(max(0, j - LONGEST_WORD), j - 2):
            rank = ranks.get(plain[i:j]) or ranks.get(low[i:j])
            if rank:
                odd = (value[i:j] != low[i:j]) + (plain[i:j] != low[i:j])
                cost = min(cost, best[i] + math.log10(rank) + 0.6 + 0.5 * odd)
        for i in dates.get(j, ()):
            cost = min(cost, best[i] + 0.3 + math.log10(365 * 120))
        if j > 1 and (low[j - 2], low[j - 1]) in _NEXT:
            walked += 1
            if walked >= 3:
                cost = min(cost, walk_cost + walk.cheapest(j, 1, j - 3, best[j - 3]))
        elif walked > 1:
            walk, walked = _Starts(), 1
        for p in range(1, min(8, j - 1) + 1):
            if value[j - 1] != value[j - 1 - p]:
                if equal[p] >= p:
                    repeats[p] = [_Starts() for _ in range(p)]
                equal[p] = 0
                continue
            equal[p] += 1
            if equal[p] >= p:
                cost = min(cost, part_cost[p] + repeats[p][j % p].cheapest(j, p, j - 2 * p, best[j - 2 * p]))
        best[j] = cost
        # A segment beyond j begins within a word's length, or goes on with a run that is held.
        if cost >= enough and j % 8 == 0:
            least = min(best[max(0, j - LONGEST_WORD) :][: LONGEST_WORD + 1])
            runs = [walk, *[x for group in repeats for x in group]]
            if least >= enough and all(c >= enough for x in runs for _, c in x.held):
                return least
    return best[n]


def _values(text: str) -> Iterator[tuple[int, int, bool]]:
    """(start, end, assigned by `is`) of values behind credential words."""
    m = CONTEXT.search(text)
    while m:
        start, stop = m.span(2)
        end = stop
        if text[stop : stop + 1] not in ('"', "'", "`"):
            while end > start and text[end - 1] in ".)]}!?:":
                end -= 1
        yield start, end, m[1] is not None
        # `login: password: x`: the value itself assigns, so its last credential word is looked at again.
        m = CONTEXT.search(text, max(start, stop - TAIL) if text[stop - 1] in ":=" else stop)


def _base(text: str) -> list[tuple[int, int, int]]:
    spans = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        spans += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text)]
    return spans + [(m.start(), m.end(), 2) for m in HEX.finditer(text)]


def find_secrets(text: str | None, least_log10: float = LEAST_LOG10, ranks: dict[str, int] | None = None) -> list[tuple[int, int, int]]:
    """(start, end, kind number) in code points, by start, then kind. Base formats are never changed."""
    if not text:
        return []
    base = sorted(_base(text))
    guessed, at, reach = [], 0, 0
    for start, end, prose in _values(text):
        if end - start < 6:
            continue
        # Base spans that begin before the value's end, and how far those before its start reach.
        while at < len(base) and base[at][0] <= start:
            reach = max(reach, base[at][1])
            at += 1
        if reach >= end:
            continue
        if not (reach > start or (at < len(base) and base[at][0] < end)):
            value = text[start:end]
            # A plain word of prose after "is" is no credential: it needs two kinds of characters at least.
            if prose and value.isalpha() and (value.islower() or value.istitle()):
                continue
            if guess_log10(value, least_log10, ranks) < least_log10:
                continue
        guessed.append((start, end, 3))
    return sorted(base + guessed)


def word_ranks(docs: DataFrame, text: str = "text", size: int = VOCABULARY) -> dict[str, int]:
    """Ranks of the fixed words, then of the documents' most frequent words outside of values: `size` at most.

    Counts are put into narrow classes; the highest classes that hold at most `size` words together are taken whole,
    so that no partition hands the driver a list of its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def handed_on() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])
            counts.clear()
            return out

        counts: Counter[str] = Counter()
        for batch in batches:
            for t in batch.column(0):
                body, at, parts = t.as_py() or "", 0, []
                for start, end, _ in _values(body):
                    parts.append(body[at:start])
                    at = max(at, end)
                parts.append(body[at:])
                counts.update(w for w in _WORD.findall(" ".join(parts).lower()) if len(w) <= LONGEST_WORD)
                if len(counts) >= COUNTED:
                    yield handed_on()
        yield handed_on()

    counted = docs.select(F.col(text).cast("string")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counted = written_fewest(counted.withColumn("class", F.floor(F.log2("n") * 64)), "words")
    least, held = math.inf, 0
    for r in sorted(counted.groupBy("class").agg(F.count("*").alias("words")).collect(), reverse=True):
        held += r["words"]
        if held > size:
            break
        least = r["class"]
    top = [] if least == math.inf else counted.where(F.col("class") >= least).collect()
    ordered = sorted(top, key=lambda r: (-r["n"], r["word"]))
    return {**{r["word"]: len(COMMON) + i + 1 for i, r in enumerate(ordered)}, **_RANK}


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in spans)


def secret_spans(docs: DataFrame, least_log10: float = LEAST_LOG10, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: counts of the base kinds, digest of the base spans, and all spans."""
    ranks = word_ranks(docs, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in range(6)]
            for t in batch.column(1):
                spans = find_secrets(t.as_py(), least_log10, ranks)
                base = [s for s in spans if s[2] < 3]
                for k in range(4):
                    cols[k].append(sum(s[2] == k for s in spans))
                cols[4].append(hashlib.sha256(_joined(base).encode()).hexdigest())
                cols[5].append(_joined(spans))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds)]],
                ["doc_id", "n_assign", "n_access", "n_hex", "n_guess", "base_sha256", "spans"],
            )

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(
        run, "doc_id long, n_assign long, n_access long, n_hex long, n_guess long, base_sha256 string, spans string"
    )


def redact_text(text: str | None, least_log10: float = LEAST_LOG10, ranks: dict[str, int] | None = None) -> str | None:
    """Replace each span, or each union of overlapping spans, by `[SECRET]`."""
    spans = find_secrets(text, least_log10, ranks)
    if not spans:
        return text
    out, at, merged = [], 0, []
    for s, e, _ in spans:
        if merged and s < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e])
    for s, e in merged:
        out += [text[at:s], "[SECRET]"]
        at = e
    return "".join(out) + text[at:]


def redact_secrets(docs: DataFrame, text: str = "text", least_log10: float = LEAST_LOG10) -> DataFrame:
    """The same rows and columns with secrets replaced in the text; `n_chars` follows where it is a column."""
    ranks = word_ranks(docs, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text)
            cols = list(batch.columns)
            cols[at] = pa.array([redact_text(t, least_log10, ranks) for t in batch.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays(cols, schema=pa.schema([f if i != at else pa.field(text, pa.string()) for i, f in enumerate(batch.schema)]))

    out = docs.mapInArrow(run, docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length(text)).cast(docs.schema["n_chars"].dataType))
    return out
