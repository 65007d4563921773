"""Removal of repeated 20-word passages by super-k-mer partitioning (operator 7).

A window is `WIDTH` consecutive words. Its minimiser is its `GRAM`-word run with the smallest hash. Consecutive
windows with the same minimiser form a super-k-mer, about nine windows that travel as one packed string, its
words joined by single spaces, to the bucket of the minimiser. Equal windows have equal minimisers, so all
copies of a window meet in one bucket, where sorting by window hash, document and place finds the first one;
equal hashes are confirmed on the words themselves.

A task writes one compressed blob per bucket and batch of texts. Equal super-k-mers of a blob are packed once,
with their places, so a passage that a third of all documents share costs its places only. Buckets are many
more than tasks and are processed one by one. What comes back is one row per run of repeated windows; these
are joined to the documents.

Defined results: null and empty texts have no words; rows without an id are returned unchanged and take no
part in the comparison; rows that repeat an id and its text count as the same place; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions

WIDTH, GRAM = 20, 4
#: Bytes of text that are hashed at once and that make one set of blobs; buckets per shuffle partition.
SLICE_BYTES = 2 << 20
FLUSH_BYTES = 12 << 20
HASH_BYTES = 1 << 19
#: Rows of an Arrow batch that become Python objects at once.
ROWS = 256
BUCKETS_PER_PARTITION = 8
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(32))
        x = x * np.uint64(0xD6E8FEB86659FD93)
        x = x ^ (x >> np.uint64(32))
        x = x * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


@lru_cache(maxsize=4)
def _powers(base: int, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        out = np.full(size, base, dtype=np.uint64)
        out[0] = 1
        return np.cumprod(out, dtype=np.uint64)


def _table(base: int, size: int) -> np.ndarray:
    """Powers of a base modulo 2**64, in tables that grow by doubling."""
    return _powers(base, 1 << max(16, int(size).bit_length()))


def _rolled(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hashes of values[starts:ends], by prefix sums modulo 2**64."""
    with np.errstate(over="ignore"):
        sums = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum(values * _table(_BASE, len(values))[: len(values)], out=sums[1:])
        return (sums[ends] - sums[starts]) * _table(_INVERSE, len(values) + 1)[starts]


def clean_words(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes with one space behind each word, and the words' starts and ends in them."""
    space = _IS_SPACE[raw]
    after_word = np.zeros(len(raw), dtype=bool)
    after_word[1:] = space[1:] & ~space[:-1]
    kept = raw[~space | after_word]
    kept = np.where(_IS_SPACE[kept], np.uint8(32), kept)
    if len(kept) and kept[-1] != 32:
        kept = np.append(kept, np.uint8(32))
    ends = np.flatnonzero(kept == 32)
    starts = np.concatenate(([0], ends[:-1] + 1)) if len(ends) else ends
    return kept, starts, ends


def _word_hashes(clean: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of words, some HASH_BYTES of text at a time; they don't depend on where a word stands."""
    out = np.zeros(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + HASH_BYTES, side="right")))
        low = starts[i]
        part = clean[low : ends[j - 1]].astype(np.uint64) + np.uint64(1)
        with np.errstate(over="ignore"):
            out[i:j] = _mixed(_rolled(part, starts[i:j] - low, ends[i:j] - low) + (ends[i:j] - starts[i:j]).astype(np.uint64))
        i = j
    return out


def super_kmers(words: np.ndarray, first_of_doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start word, number of windows and minimiser hash of each super-k-mer. `words` are hashes of the words
    of several documents in a row, `first_of_doc[i]` the first word of the document of word i."""
    n = len(words)
    if n < WIDTH:
        empty = np.zeros(0, dtype=np.int64)
        return empty, empty, np.zeros(0, dtype=np.uint64)
    grams = n - GRAM + 1
    at = np.arange(grams)
    gram = _mixed(_rolled(words, at, at + GRAM))
    bits = np.uint64(int(n).bit_length())
    # Hash above, place below: the smallest is the leftmost gram with the smallest hash.
    packed = ((gram >> bits) << bits) | at.astype(np.uint64)
    span = WIDTH - GRAM + 1
    least, length = packed, 1
    while 2 * length <= span:
        least = np.minimum(least[:-length], least[length:])
        length *= 2
    windows = n - WIDTH + 1
    least = np.minimum(least[:windows], least[span - length : span - length + windows])
    inside = first_of_doc[:windows] == first_of_doc[WIDTH - 1 :]
    place = least & ((np.uint64(1) << bits) - np.uint64(1))
    new = np.ones(windows, dtype=bool)
    new[1:] = (place[1:] != place[:-1]) | (first_of_doc[1:windows] != first_of_doc[: windows - 1]) | ~inside[:-1]
    starts = np.flatnonzero(new & inside)
    stops = np.append(np.flatnonzero(new), windows)
    # A run ends at the next mark or at the first window that leaves its document.
    outside = np.append(np.flatnonzero(~inside), windows)
    end = np.minimum(stops[np.searchsorted(stops, starts, side="right")], outside[np.searchsorted(outside, starts)])
    return starts, end - starts, gram[place[starts].astype(np.int64)]


def _slices(batch: pa.RecordBatch) -> Iterator[list[tuple[int, bytes]]]:
    some, size = [], 0
    for at in range(0, batch.num_rows, ROWS):
        part = batch.slice(at, ROWS)
        for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
            body = (text or "").encode()
            if len(body) >= 2 * WIDTH - 1:
                some.append((doc, body))
                size += len(body)
            if size >= SLICE_BYTES:
                yield some
                some, size = [], 0
    if some:
        yield some


class _Blobs:
    """Super-k-mers by bucket; equal strings are kept once."""

    def __init__(self) -> None:
        self.buckets: dict[int, tuple[list[int], list[int], list[int], dict[bytes, int]]] = {}
        self.size = 0

    def add(self, docs: list[tuple[int, bytes]], buckets: int) -> None:
        raw = np.frombuffer(b"\n".join(b for _, b in docs), dtype=np.uint8)
        clean, starts, ends = clean_words(raw)
        # Words before each document: words that start before its first byte.
        space = _IS_SPACE[raw]
        begins = ~space
        begins[1:] &= space[:-1]
        before = np.concatenate(([0], np.cumsum(begins)))
        first = before[np.concatenate(([0], np.cumsum([len(b) + 1 for _, b in docs])[:-1]))]
        counts = np.diff(np.append(first, len(starts)))
        first_of = np.repeat(first, counts)
        ids = np.repeat(np.array([d for d, _ in docs], dtype=np.int64), counts)
        s, n, gram = super_kmers(_word_hashes(clean, starts, ends), first_of)
        bucket = (_mixed(gram) % np.uint64(buckets)).tolist()
        body = clean.tobytes()
        for k, lo, hi, doc, place in zip(bucket, starts[s].tolist(), ends[s + n + WIDTH - 2].tolist(), ids[s].tolist(), (s - first_of[s]).tolist()):
            held = self.buckets.get(k)
            if held is None:
                held = self.buckets[k] = ([], [], [], {})
            held[0].append(doc)
            held[1].append(place)
            held[2].append(held[3].setdefault(body[lo:hi], len(held[3])))
        self.size += len(raw)

    def flush(self, press) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(self.buckets), 64):
            some = sorted(self.buckets)[at : at + 64]
            blobs = []
            for k in some:
                doc, place, number, seen = self.buckets[k]
                text = b"\n".join(seen)
                head = struct.pack("<qq", len(doc), len(text)) + np.array([doc, place, number], dtype="<i8").tobytes()
                blobs.append(press.compress(head + text))
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(blobs, pa.binary())], ["bucket", "blob"])
        self.__init__()


def _packer(buckets: int):
    import zstandard

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press, blobs = zstandard.ZstdCompressor(level=6), _Blobs()
        for batch in batches:
            for docs in _slices(batch):
                blobs.add(docs, buckets)
                if blobs.size >= FLUSH_BYTES:
                    yield from blobs.flush(press)
        yield from blobs.flush(press)

    return run


def _count_bucket(table: pa.Table) -> pa.Table:
    """Runs of windows of one bucket that also start earlier: (doc_id, start, windows)."""
    import zstandard

    press = zstandard.ZstdDecompressor()
    doc, place, number, texts, known = [], [], [], [], 0
    for blob in table.column("blob").to_pylist():
        data = press.decompress(blob)
        n, size = struct.unpack_from("<qq", data)
        cols = np.frombuffer(data, "<i8", 3 * n, 16).reshape(3, n)
        doc.append(cols[0])
        place.append(cols[1])
        number.append(cols[2] + known)
        found = data[16 + 24 * n :].split(b"\n")
        texts += found
        known += len(found)
    doc, place, number = np.concatenate(doc), np.concatenate(place), np.concatenate(number)
    # Equal strings of different blobs are one.
    seen: dict[bytes, int] = {}
    number = np.array([seen.setdefault(t, len(seen)) for t in texts], dtype=np.int64)[number]
    texts = list(seen)
    clean = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    ends = np.flatnonzero(clean == 32)
    starts = np.concatenate(([0], ends[:-1] + 1))
    words = _word_hashes(clean, starts, ends)
    sizes = np.array([t.count(b" ") + 1 for t in texts])
    first = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    windows = sizes - WIDTH + 1
    # The earliest place of each string; its other places repeat all of its windows.
    order = np.lexsort((place, doc, number))
    head = np.append(True, number[order][1:] != number[order][:-1])
    lead = order[head]
    lead_of = lead[np.cumsum(head) - 1]
    again = order[(doc[order] != doc[lead_of]) | (place[order] != place[lead_of])]
    out = [(doc[again], place[again], windows[number[again]])]
    # Windows of the earliest places, as numbers of words in `clean`.
    of = np.repeat(np.arange(len(texts)), windows)
    inner = np.arange(len(of)) - np.repeat(np.concatenate(([0], np.cumsum(windows)[:-1])), windows)
    at = first[of] + inner
    key = _mixed(_rolled(words, at, at + WIDTH))
    w_doc, w_place = doc[lead][of], place[lead][of] + inner
    order = np.lexsort((w_place, w_doc, key))
    sorted_key = key[order]
    head = np.append(True, sorted_key[1:] != sorted_key[:-1])
    lead_of = order[np.flatnonzero(head)][np.cumsum(head) - 1]
    later = ~head
    body = clean.tobytes()
    left, right = starts[at], ends[at + WIDTH - 1]
    flagged = np.zeros(len(of), dtype=bool)
    mine, theirs = order[later], lead_of[later]
    same = np.fromiter(
        (body[a:b] == body[c:d] for a, b, c, d in zip(left[mine].tolist(), right[mine].tolist(), left[theirs].tolist(), right[theirs].tolist())),
        dtype=bool, count=len(mine),
    )
    earlier = (w_doc[theirs] != w_doc[mine]) | (w_place[theirs] != w_place[mine])
    flagged[mine[same & earlier]] = True
    if not same.all():
        # Equal hashes of different words: such groups are counted by the words themselves.
        firsts: dict[bytes, tuple[int, int]] = {}
        clash = np.isin(key, key[mine[~same]])
        for i in order[clash[order]].tolist():
            window, here = body[left[i] : right[i]], (int(w_doc[i]), int(w_place[i]))
            flagged[i] = firsts.setdefault(window, here) != here
    marked = np.flatnonzero(flagged)
    if len(marked):
        new = np.append(True, (np.diff(marked) != 1) | (of[marked][1:] != of[marked][:-1]))
        begin = marked[new]
        out.append((w_doc[begin], w_place[begin], np.diff(np.append(np.flatnonzero(new), len(marked)))))
    return pa.table({k: pa.array(np.concatenate([o[i] for o in out]), pa.int64()) for i, k in enumerate(("doc_id", "start", "windows"))})


def repeated_runs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, start, windows): runs of consecutive windows whose words also start earlier. Runs may overlap."""
    buckets = BUCKETS_PER_PARTITION * partitions(docs.sparkSession)
    body = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    packed = body.mapInArrow(_packer(buckets), "bucket long, blob binary")
    return packed.groupBy("bucket").applyInArrow(_count_bucket, "doc_id long, start long, windows long")


def _pressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed, each by itself, for the way to their runs."""
    import zstandard

    press = zstandard.ZstdCompressor(level=6)
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            texts = [press.compress((t or "").encode()) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.binary())], ["doc_id", "body"])


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    press = zstandard.ZstdDecompressor()
    for whole in batches:
        for at in range(0, whole.num_rows, ROWS):
            batch = whole.slice(at, ROWS)
            n_words, n_removed, kept_texts, digests = [], [], [], []
            for body, runs in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                words = press.decompress(body).split()
                drop = np.zeros(len(words) + 1, dtype=np.int64)
                for r in runs or ():
                    drop[r["start"]] += 1
                    drop[min(len(words), r["start"] + r["windows"] + WIDTH - 1)] -= 1
                gone = np.cumsum(drop)[:-1] > 0
                kept = b" ".join([w for w, g in zip(words, gone.tolist()) if not g] if runs else words)
                n_words.append(len(words))
                n_removed.append(int(gone.sum()))
                kept_texts.append(kept.decode())
                digests.append(hashlib.sha256(kept).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept_texts, pa.string()), pa.array(digests, pa.string())],
                ["doc_id", "n_words", "n_removed", "kept_text", "kept_sha256"],
            )


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text, kept_sha256) for each document."""
    # The runs of a document are at most as many as its words.
    runs = repeated_runs(docs, key, text).groupBy("doc_id").agg(F.collect_list(F.struct("start", "windows")).alias("runs"))
    body = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(_pressed, "doc_id long, body binary")
    return body.join(runs, "doc_id", "left").mapInArrow(
        _without, "doc_id long, n_words long, n_removed long, kept_text string, kept_sha256 string"
    )
