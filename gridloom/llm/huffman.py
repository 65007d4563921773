"""Token ids in files of canonical, length-limited Huffman code (operator 6).

All texts are tokenized once. Global id counts (as many rows as the vocabulary at most) give code lengths of
at most MAX_BITS by package-merge; codes are canonical, so a file stores lengths only. Documents are range
partitioned by id, and each partition becomes one file or, beyond FILE_TOKENS, several:

    header   magic, version, tokens, documents, blocks, length of the code table, payload bytes
    codes    one byte of code length per id, zlib
    docs     id and number of tokens of each document
    offsets  bit offset of every block of BLOCK tokens
    payload  codes, most significant bit first

Blocks are independent: the decoder starts at the offsets of all blocks at once and takes one token of each
block per step from a table of 2**MAX_BITS entries. A reader may take any block alone.

Defined results: null and empty texts are one end token; rows that repeat an id are stored each, in any order
among themselves; rows without an id come first; an empty table writes no file and gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import partitions, shared_folder, written
from .files import RangeReader, write_file
from .tokens import encoder, slices

MAGIC, VERSION = b"HUFIDS", 1
HEADER = struct.Struct("<6sHqqqqq")
MAX_BITS = 20
BLOCK = 512
CHUNK = 512 * BLOCK
#: Tokens after which a task begins another file.
FILE_TOKENS = 8_000_000
SLICE = 256
MISSING = -(2**63)


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Code length of each symbol (0: does not occur) by package-merge; minimal for the limit."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), dtype=np.uint8)
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} symbols do not fit codes of {limit} bits")
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    order = used[np.argsort(counts[used], kind="stable")]
    leaf = counts[order].astype(np.int64)
    levels, merged = [], leaf
    is_leaf = np.ones(len(leaf), dtype=bool)
    levels.append(is_leaf)
    for _ in range(limit - 1):
        pairs = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate((leaf, pairs))
        rank = np.argsort(both, kind="stable")
        merged, is_leaf = both[rank], rank < len(leaf)
        levels.append(is_leaf)
    take, out = 2 * len(leaf) - 2, np.zeros(len(leaf), dtype=np.uint8)
    for is_leaf in reversed(levels):
        leaves = int(is_leaf[:take].sum())
        out[:leaves] += 1
        take = 2 * (take - leaves)
    lengths[order] = out
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of length, then symbol."""
    codes = np.zeros(len(lengths), dtype=np.uint64)
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    sizes = lengths[order].astype(np.int64)
    # A code is the sum of the shares 2**-length of all codes before it.
    top = int(sizes[-1]) if len(sizes) else 0
    before = np.concatenate(([0], np.cumsum(np.int64(1) << (top - sizes))[:-1])) if len(sizes) else sizes
    codes[order] = (before >> (top - sizes)).astype(np.uint64)
    return codes


def encode_bits(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray, int]:
    """Payload of whole 64-bit words, bit offset of every block, number of bits."""
    size = lengths[ids].astype(np.int64)
    ends = np.cumsum(size)
    at = ends - size
    word, room = at >> 6, 64 - (at & 63) - size
    value = codes[ids]
    inside = np.where(room >= 0, value << np.maximum(room, 0).astype(np.uint64), value >> np.maximum(-room, 0).astype(np.uint64))
    total = int(ends[-1]) if len(ids) else 0
    out = np.zeros((total + 63) // 64, dtype=np.uint64)
    if total:
        # A code has fewer bits than a word, so codes start in each word but perhaps the last.
        heads = np.flatnonzero(np.diff(word, prepend=-1))
        out[word[heads]] = np.bitwise_or.reduceat(inside, heads)
        over = np.flatnonzero(room < 0)
        out[word[over] + 1] |= value[over] << (64 + room[over]).astype(np.uint64)
    return out.astype(">u8").tobytes(), at[::BLOCK].copy(), total


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbol and length for every value of the next MAX_BITS bits."""
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    spans = np.int64(1) << (MAX_BITS - lengths[order].astype(np.int64))
    symbols, sizes = np.zeros(1 << MAX_BITS, dtype=np.uint32), np.ones(1 << MAX_BITS, dtype=np.uint8)
    n = int(spans.sum())
    symbols[:n], sizes[:n] = np.repeat(order, spans), np.repeat(lengths[order], spans)
    return symbols, sizes


def decode_blocks(payload: bytes, offsets: np.ndarray, tokens: int, lengths: np.ndarray) -> np.ndarray:
    """All tokens of consecutive blocks; one step takes one token of each block."""
    symbols, sizes = decode_table(lengths)
    raw = np.frombuffer(payload + b"\0\0\0\0\0\0\0\0", dtype=np.uint8).astype(np.uint32)
    view = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]
    blocks = len(offsets)
    out = np.zeros((BLOCK, blocks), dtype=np.uint32)
    at = offsets.astype(np.int64).copy()
    last = tokens - (blocks - 1) * BLOCK
    for step in range(BLOCK if blocks > 1 else last):
        if step == last:
            at = at[:-1]
        peek = (view[at >> 3] >> (32 - MAX_BITS - (at & 7)).astype(np.uint32)) & ((1 << MAX_BITS) - 1)
        out[step, : len(at)] = symbols[peek]
        at += sizes[peek]
    return out.T.reshape(-1)[:tokens]


def _kind(path: str) -> str:
    return "<u2" if encoder(path).tokenizer.get_vocab_size() <= 1 << 16 else "<u4"


def tokenized(docs: DataFrame, path: str, end_id: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids): ids in two bytes each where the vocabulary allows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, kind = encoder(path), _kind(path)
        end = np.array([end_id], dtype=kind).tobytes()
        for batch in batches:
            for part in slices(batch, 1):
                found = coder.encode(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([i.astype(kind).tobytes() + end for i in found], pa.binary())], ["doc_id", "ids"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, ids binary")


def id_counts(ids: DataFrame, kind: str) -> DataFrame:
    """(id, n) over the corpus: each task adds up its own ids first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, dtype=np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                one = np.bincount(np.frombuffer(b"".join(batch.column(0).slice(at, SLICE).to_pylist()), dtype=kind), minlength=len(total))
                one[: len(total)] += total
                total = one
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["id", "n"])

    return ids.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def file_bytes(doc_ids: list, arrays: list[np.ndarray], lengths: np.ndarray, codes: np.ndarray) -> Iterator[bytes]:
    """Parts of one file. Chunks of whole blocks begin on a 64-bit word."""
    ids = np.concatenate(arrays)
    payload, offsets, bits = [], [], 0
    for at in range(0, len(ids), CHUNK):
        data, starts, _ = encode_bits(ids[at : at + CHUNK], lengths, codes)
        payload.append(data)
        offsets.append(starts + bits)
        bits += 8 * len(data)
    blocks = np.concatenate(offsets).astype("<u8")
    table = zlib.compress(lengths.tobytes())
    yield HEADER.pack(MAGIC, VERSION, len(ids), len(doc_ids), len(blocks), len(table), sum(map(len, payload)))
    yield table
    yield np.array([MISSING if d is None else d for d in doc_ids], dtype="<i8").tobytes()
    yield np.array([len(a) for a in arrays], dtype="<i8").tobytes()
    yield blocks.tobytes()
    yield from payload


def read_ids(uri: str) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """(doc_id, start in the file, ids) of each document of a file, chunk by chunk of blocks."""
    file = RangeReader(uri)
    magic, version, tokens, documents, blocks, table, size = HEADER.unpack(file.read(0, HEADER.size))
    if magic != MAGIC or version != VERSION:
        raise ValueError(f"{uri} is no file of this format")
    at = HEADER.size
    lengths = np.frombuffer(zlib.decompress(file.read(at, table)), dtype=np.uint8)
    at += table
    ids = np.frombuffer(file.read(at, 8 * documents), "<i8").tolist()
    counts = np.frombuffer(file.read(at + 8 * documents, 8 * documents), "<i8")
    offsets = np.frombuffer(file.read(at + 16 * documents, 8 * blocks), "<u8").astype(np.int64)
    base = at + 16 * documents + 8 * blocks
    starts = np.concatenate(([0], np.cumsum(counts)))
    held, first, per = np.zeros(0, dtype=np.uint32), 0, CHUNK // BLOCK * 4
    doc = 0
    for b in range(0, blocks, per):
        lo = int(offsets[b]) // 8
        hi = int(offsets[b + per]) // 8 if b + per < blocks else size
        n = min(tokens - b * BLOCK, per * BLOCK)
        found = decode_blocks(file.read(base + lo, hi - lo), offsets[b : b + per] - 8 * lo, n, lengths)
        held = np.concatenate((held, found))
        while doc < documents and starts[doc + 1] <= first + len(held):
            yield None if ids[doc] == MISSING else ids[doc], int(starts[doc]), held[starts[doc] - first : starts[doc + 1] - first]
            doc += 1
        done = int(starts[doc]) - first
        held, first = held[done:], first + done
    file.close()


def write_corpus(docs: DataFrame, folder: str, path: str, end_id: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write all documents to files in ascending doc_id order. Returns the manifest: (file, uri, documents, tokens, bytes)."""
    kind = _kind(path)
    ids = written(tokenized(docs, path, end_id, key, text), "ids")
    # As many rows as the vocabulary has ids, at most.
    found = id_counts(ids, kind).toPandas()
    counts = np.zeros(int(found["id"].max()) + 1 if len(found) else 1, dtype=np.int64)
    counts[found["id"].to_numpy(dtype=np.int64)] = found["n"]
    lengths = code_lengths(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, part, codes = TaskContext.get().partitionId(), 0, canonical_codes(lengths)
        docs_: list[int | None] = []
        arrays: list[np.ndarray] = []
        held = 0

        def close() -> pa.RecordBatch:
            uri = f"{folder}/part-{number:06d}-{part:06d}.huf"
            size = write_file(uri, file_bytes(docs_, arrays, lengths, codes))
            return pa.RecordBatch.from_pylist([{"file": (number << 32) + part, "uri": uri, "documents": len(docs_), "tokens": held, "bytes": size}])

        for batch in batches:
            for doc, ids_ in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                docs_.append(doc)
                arrays.append(np.frombuffer(ids_, dtype=kind))
                held += len(arrays[-1])
                if held >= FILE_TOKENS:
                    yield close()
                    part, docs_, arrays, held = part + 1, [], [], 0
        if docs_:
            yield close()

    ordered = ids.repartitionByRange(partitions(docs.sparkSession), F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first())
    return written(ordered.mapInArrow(run, "file long, uri string, documents long, tokens long, bytes long"), "manifest")


def read_corpus(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decoded from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                found = [(d, row["before"] + s, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for d, s, ids in read_ids(row["uri"])]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    # One row per file: the running total of the tokens before it.
    before = F.coalesce(F.sum("tokens").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = manifest.select("uri", before.alias("before")).repartition(partitions(manifest.sparkSession))
    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def huffman_round_trip(docs: DataFrame, path: str, end_id: int = 2) -> DataFrame:
    folder = shared_folder(docs.sparkSession, "huffman")
    return read_corpus(write_corpus(docs, folder, path, end_id))
