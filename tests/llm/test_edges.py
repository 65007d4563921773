"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns for every operator and stage."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from gridloom.llm import decontaminate, huffman, neardup, packing, pii, quality, secrets, sharding, substrings, warc
from gridloom.llm.common import TEXT_COLUMNS
from gridloom.llm.tokens import tokenizer_path
from gridloom.session import ensure_checkpoint_dir

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, words string, label long, bucket string"
LONG = "alpha beta gamma delta " * 6000 + "x" * 60000
TEXTS = [None, "", " \n\t ", "one", "two words", LONG, "same text here " * 30, "same text here " * 30, "a@b.co and 1.2.3.4", "  lead and trail  "]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, None if i % 4 == 0 else "en", None if i % 3 == 0 else "s", None if t is None else len(t), None, "w", None, "b") for i, t in enumerate(TEXTS)]
    rows += [rows[6], (None, "no id", "en", "s", 5, None, "w", 1, "b"), (None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, None, "x"), (2, "", "x"), (None, "same text here same text here same text here same text here", "x"), (3, "short", None)], "item_id long, text string, hits string")


WORD, BYTE = tokenizer_path("word_bpe_49k.json"), tokenizer_path("byte_bpe_50k.json")
OPERATORS = {
    "packing": lambda d, b: packing.packed_documents(d, WORD),
    "pii": lambda d, b: pii.personal_spans(d),
    "sharding": lambda d, b: sharding.balanced_shards(d, 3),
    "secrets": lambda d, b: secrets.secret_spans(d),
    "redaction": lambda d, b: secrets.redact_secrets(d),
    "huffman": lambda d, b: huffman.huffman_round_trip(d, BYTE),
    "substrings": lambda d, b: substrings.without_repeats(d),
    "neardup": lambda d, b: neardup.near_duplicates(d),
    "quality": lambda d, b: quality.quality_verdicts(d, keep=d.columns[:5]),
    "decontaminate": lambda d, b: decontaminate.decontaminated(d, b),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows_keep_their_number(odd, bench, name):
    got = OPERATORS[name](odd, bench).collect()
    if name == "packing":
        assert {(r.doc_id, r.piece) for r in got} >= {(0, 0), (1, 0)} and sum(r.start == 0 for r in got) == odd.count()
    elif name == "decontaminate":
        assert {r.doc_id for r in got} == {r.doc_id for r in odd.collect()}  # the item without an id names no pair
    else:
        assert len(got) == odd.count()


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(nothing, bench, name):
    assert OPERATORS[name](nothing, bench).count() == 0


@pytest.mark.parametrize("name,stage", P.STAGES)
def test_stages(spark, odd, nothing, bench, tmp_path, name, stage):
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    for docs in (odd, nothing):
        out = stage(spark, docs, str(tmp_path))
        out.count()
        if name != P.STAGES[-1][0]:
            assert tuple(out.columns) == TEXT_COLUMNS


def test_empty_benchmark(odd, bench):
    assert decontaminate.contaminated_pairs(odd, bench.limit(0)).count() == 0


def test_warc_edges(spark):
    page = "<p>" + "x" * 1200 + "</p>"
    rows = [(1, "u", page, 1), (2, None, page, 1), (3, "u v", "short", 1), (4, "u", "short", 1), (5, "u", None, 1), (None, "u", page, 1), (2, None, page, 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest long")
    got = sorted((r.page_id, r.record_type, r.refers_to or 0, r.payload_bytes) for r in warc.warc_round_trip(pages).collect())
    assert got == [
        (-1, "response", 0, 1207), (1, "revisit", 2, 1207), (2, "response", 0, 1207), (2, "response", 0, 1207),
        (3, "response", 0, 5), (4, "response", 0, 5), (5, "response", 0, 0),
    ]
    assert warc.warc_round_trip(pages.limit(0)).count() == 0


def test_null_results(odd, spark):
    by_id = {r.doc_id: r for r in quality.quality_verdicts(odd).where("doc_id is not null").collect()}
    assert by_id[0].n_words == 0 and by_id[0].base_failed and not by_id[0].kept
    near = {r.doc_id: r for r in neardup.near_duplicates(odd.where("doc_id is not null"), width=2).collect()}
    assert near[0].n_shingles == near[1].n_shingles == near[2].n_shingles == 0 and near[1].component_id == 1
    assert near[3].n_shingles == 1 and near[7].component_id == 6 and not near[7].kept
    gone = {r.doc_id: r.n_removed for r in substrings.without_repeats(odd.where("doc_id is not null")).collect()}
    assert gone[6] > 0 and gone[7] == 90 and gone[0] == 0
    assert odd.where(F.col("doc_id") == 6).count() == 2


def test_dedup_stage_keeps_clean_rows(spark, tmp_path):
    """Rows without an id and different texts of one id stay; of equal or near texts one does."""
    long = lambda seed: " ".join(f"{seed}{i}" for i in range(60))
    rows = [(1, long("a")), (1, long("b")), (None, long("c")), (None, long("d")), (7, long("c")), (3, long("e")), (2, long("e") + " more"), (2, long("e") + " more"), (9, "short"), (8, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = sorted(((r.doc_id or 0, (r.text or "")[:3]) for r in P.dedup_stage(spark, docs, str(tmp_path)).collect()))
    assert got == [(0, "d0 "), (1, "a0 "), (1, "b0 "), (2, "e0 "), (7, "c0 "), (8, ""), (9, "sho")]


def test_many_partitions_make_few_files(spark, tmp_path):
    """Each file costs an executor a process: a small table that isn't coalesced by Spark is not one file a partition."""
    held = {"spark.sql.shuffle.partitions": "100", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in held}
    rows = [(i, " ".join(f"w{i // 3}x{j}" for j in range(60)) + " more" * (i % 3), "en", "s", 1) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    ensure_checkpoint_dir(spark)
    top = Path(spark.sparkContext.getCheckpointDir().removeprefix("file:"))
    old = set(top.iterdir())
    for k, v in held.items():
        spark.conf.set(k, v)
    try:
        P.dedup_stage(spark, docs, "").write.parquet(f"{tmp_path}/kept")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted(r.doc_id for r in spark.read.parquet(f"{tmp_path}/kept").collect()) == list(range(0, 300, 3))
    files = [len(list(d.glob("part-*"))) for d in [*set(top.iterdir()) - old, tmp_path / "kept"]]
    assert len(files) > 10 and max(files) <= 32
