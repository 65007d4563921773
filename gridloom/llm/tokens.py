"""Token ids of whole texts by a tokenizers file, with a cache of pieces between spaces.

Both vocabularies split a text before their merges and never join across a single space or line break that
stands between two characters that are no space. So texts are cut there, Arrow finds the distinct pieces of
many texts, each distinct piece is encoded once by the tokenizers library, and the ids of a text are the
joined ids of its pieces.
"""

from __future__ import annotations

import os
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces in one generation of a worker's cache. A full generation becomes the old one, from which pieces
#: that are met again move to the new one; the cache changes no result.
CACHE = 400_000
CHUNK = 2048
#: Texts that are cut into pieces together: rows, and bytes unless one text has more.
ROWS, BYTES = 4096, 8 << 20
#: Words whose ids are joined at once.
JOIN = 1 << 18
#: Closing marks that are set apart from letters, up to so many; a run of them is one pre-token.
MARKS, RUN = ",.!#$%&*", 4
_ODD = re.compile(r"\s[ ]|[ ]\s")
#: White space but for space and line break; Python's is the wider class, so both libraries' are in it.
_OTHER_SPACE = "[" + "".join(f"\\x{{{c:x}}}" for c in range(0x10000) if chr(c).isspace() and chr(c) not in " \n") + "\\x{180e}]"
_LOADED: dict[str, "Encoder"] = {}


def _letter(c: str) -> bool:
    """A letter since Unicode 3.2, so to every library."""
    return unicodedata.category(c)[0] == "L" == unicodedata.ucd_3_2_0.category(c)[0]


def word_pattern() -> str:
    """Words of letters that are still letters when they are composed and lower-cased."""
    known = [i for i in range(0x10000) if _letter(chr(i)) and all(map(_letter, unicodedata.normalize("NFC", chr(i)).lower()))]
    first = [i for i, before in zip(known, [-2, *known]) if i != before + 1]
    last = [i for i, after in zip(known, [*known[1:], -2]) if i != after - 1]
    return r"^\n?[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in zip(first, last)) + "]+$"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts are encoded together."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        full = int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + BYTES, side="right"))
        stop = min(max(full, at + 1), at + ROWS)
        yield batch.slice(at, stop - at)
        at = stop


def _joined(pool: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """pool[start : start + size] of all starts, one after the other."""
    out = np.empty(int(sizes.sum()), dtype=pool.dtype)
    done = 0
    for at in range(0, len(starts), JOIN):
        some = sizes[at : at + JOIN]
        ends = np.cumsum(some)
        n = int(ends[-1])
        np.take(pool, np.arange(n) + np.repeat(starts[at : at + JOIN] - ends + some, some), out=out[done : done + n])
        done += n
    return out


def _pool(values: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of all values, first place and number of each."""
    sizes = np.fromiter(map(len, values), dtype=np.int64, count=len(values)) // 4
    return np.frombuffer(b"".join(values), dtype="<u4"), np.cumsum(sizes) - sizes, sizes


class Encoder:
    """Ids of whole texts, equal to encode(text, add_special_tokens=False).ids."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # Word vocabularies drop white space and case; byte vocabularies keep the space at the front of a piece.
        self.joint = self._ids(["a b"])[0] != self._ids(["a"])[0] + self._ids(["b"])[0]
        self.lower = self._ids(["A"]) == self._ids(["a"])
        self.cache: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {"": b""}
        self.line = self._ids(["\n"])[0]
        self.word = word_pattern()
        # Tokens that open a piece of letters (a space in front) or close it (an end-of-word mark).
        vocabulary = self.tokenizer.get_vocab()
        self.edge = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        opens, closes = "Ġ", "</w>"
        self.edge[[i for t, i in vocabulary.items() if (t.startswith(opens) if self.joint else t.endswith(closes))]] = True

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _fill(self, words: list[str], other: list[str]) -> None:
        """Encode pieces: words of letters alone, many in one text and told apart by marked tokens, and others.
        A line break in front stands for a piece that follows one; the rest of it opens a text."""
        first = [w for w in words if w[0] == "\n"] if self.joint else []
        for some in self._chunks([w for w in words if w[0] != "\n"] if first else words):
            ids = np.asarray(self._ids([" " + " ".join(some)])[0], dtype="<u4")
            found = np.flatnonzero(self.edge[ids])
            if len(found) != len(some):  # a letter that is none to the tokenizer
                other += some
                continue
            self._keep(some, ids, np.append(found, len(ids)) if self.joint else np.concatenate(([0], found + 1)))
        for some in self._chunks(first):
            ids = np.asarray(self._ids(["".join(some)])[0], dtype="<u4")
            self._keep(some, ids, np.append(np.flatnonzero(ids == self.line[0]), len(ids)))
        for some in self._chunks([p for p in other if p[:1] == "\n"]):
            self.cache.update(zip(some, [np.asarray(self.line + i, dtype="<u4").tobytes() for i in self._ids([p[1:] for p in some])]))
        for some in self._chunks([p for p in other if p[:1] != "\n"]):
            found = self.tokenizer.encode(" " + " ".join(some), add_special_tokens=False)
            starts = np.fromiter((o[0] for o in found.offsets), dtype=np.int64, count=len(found.offsets))
            lengths = np.fromiter((len(p) + 1 for p in some), dtype=np.int64, count=len(some))
            self._keep(some, np.asarray(found.ids, dtype="<u4"), np.searchsorted(starts, np.concatenate(([0], np.cumsum(lengths)))))

    @staticmethod
    def _chunks(pieces: list[str]) -> Iterator[list[str]]:
        for at in range(0, len(pieces), CHUNK):
            yield pieces[at : at + CHUNK]

    def _keep(self, pieces: list[str], ids: np.ndarray, marks: np.ndarray) -> None:
        body, marks = ids.tobytes(), (marks * 4).tolist()
        self.cache.update(zip(pieces, [body[i:j] for i, j in zip(marks, marks[1:])]))

    def _values(self, pieces: pa.Array, plain: pa.Array) -> list[bytes]:
        """Ids of distinct pieces; `plain` ones are letters alone."""
        keys, cache, old = pieces.to_numpy(zero_copy_only=False).tolist(), self.cache, self.old
        words, other = [], []
        for key, is_word in zip(keys, plain.to_numpy(zero_copy_only=False).tolist()):
            if key not in cache:
                if key in old:
                    cache[key] = old[key]
                else:
                    (words if is_word else other).append(key)
        self._fill(words, other)
        values = [cache[k] for k in keys]
        if len(cache) > CACHE:
            self.old, self.cache = cache, {}
        return values

    def _separable(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Texts that may be cut at spaces, and those that may be cut at line breaks too."""
        def has(part: str) -> np.ndarray:
            return pc.match_substring_regex(texts, part).to_numpy(zero_copy_only=False)

        known = ~(has(r"<\|") | (pc.binary_length(texts).to_numpy(zero_copy_only=False) == 0))  # no special token
        spaced = has(_OTHER_SPACE)
        spaces, lines = known.copy(), known & ~spaced
        for i in np.flatnonzero(known & spaced).tolist():
            text = texts[i].as_py()
            spaces[i] = not (text[0] == " " or text[-1] == " " or _ODD.search(text))
        if self.joint:
            spaces &= ~has(r" [ \n]|\n |\A | \z")
            lines &= spaces & ~has(r"\n\n|\A\n|\n\z")
        return spaces, lines

    def _cut(self, texts: pa.Array, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Joined ids of texts that may be cut, and the end of each."""
        # The first piece of a text is like one behind a line break, whose id is taken off again.
        broken = pc.replace_substring(texts, "\n", " \n" if self.joint else " ")
        texts = pc.if_else(pa.array(lines), broken, texts)
        if self.joint:
            texts = pc.binary_join_element_wise("\n", texts, "")
        parts = pc.split_pattern(texts, " ")
        coded = pc.dictionary_encode(parts.flatten())
        pieces, index = coded.dictionary, coded.indices.to_numpy()
        cores = pc.ascii_rtrim(pieces, characters=MARKS)
        extra = pc.subtract(pc.binary_length(pieces), pc.binary_length(cores))
        plain = pc.and_(pc.match_substring_regex(cores, self.word), pc.less_equal(extra, RUN))
        cores = pc.if_else(plain, pc.ascii_lower(cores) if self.lower else cores, pieces)
        coded = pc.dictionary_encode(cores)
        place = coded.indices.to_numpy()
        _, one = np.unique(place, return_index=True)
        values = self._values(coded.dictionary, plain.take(pa.array(one)))
        # Closing marks of plain pieces.
        known, number = {"": len(values)}, np.full(len(pieces), len(values))
        values.append(b"")
        extra = np.where(plain.to_numpy(zero_copy_only=False), extra.to_numpy(), 0)
        for n in range(1, RUN + 1):
            rows = np.flatnonzero(extra == n)
            if not len(rows):
                continue
            tails = pc.dictionary_encode(pc.utf8_slice_codeunits(pieces.take(pa.array(rows)), -n))
            for tail in tails.dictionary.to_pylist():
                if tail not in self.tails:
                    self.tails[tail] = np.asarray(self._ids([tail])[0], dtype="<u4").tobytes()
                known[tail] = len(values)
                values.append(self.tails[tail])
            number[rows] = np.array([known[t] for t in tails.dictionary.to_pylist()])[tails.indices.to_numpy()]
        pool, starts, sizes = _pool(values)
        both = np.stack((place, number), axis=1).reshape(-1)
        pool, sizes = _joined(pool, starts[both], sizes[both]), sizes[place] + sizes[number]
        starts, ends = np.cumsum(sizes) - sizes, np.cumsum(np.concatenate(([0], sizes[index])))
        return _joined(pool, starts[index], sizes[index]), ends[parts.offsets.to_numpy()]

    def encode(self, texts: list[str | None] | pa.Array) -> list[np.ndarray]:
        """One array of unsigned 32-bit ids per text; none for null."""
        texts = pc.fill_null(texts.cast(pa.string()) if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        out = [np.zeros(0, dtype="<u4")] * len(texts)
        spaces, lines = self._separable(texts)
        some = np.flatnonzero(spaces)
        if len(some):
            ids, ends = self._cut(texts.take(pa.array(some)), lines[some])
            skip = len(self.line) if self.joint else 0
            for i, start, stop in zip(some.tolist(), ends.tolist(), ends[1:].tolist()):
                out[i] = ids[start + skip : stop]
        for i in np.flatnonzero(~spaces).tolist():
            text = texts[i].as_py()
            if text:
                out[i] = np.asarray(self._ids([text])[0], dtype="<u4")
        return out


def encoder(path: str) -> Encoder:
    """One encoder per worker process and file."""
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
    return _LOADED[path]
