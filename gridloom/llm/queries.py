"""Registered queries of the training-data operators, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, huffman, merkle, neardup, negatives, packing, pii, quality, secrets, sharding, substrings, toxicity, warc
from .common import table
from .tokens import tokenizer_path


def op1_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packed_documents(table(spark, folder, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=1, size=4096)


def op2_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    return pii.personal_spans(table(spark, folder, "documents"))


def op3_label_propagation(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.balanced_shards(table(spark, folder, "documents"), shards=40)


def op4_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.secret_spans(table(spark, folder, "documents"))


def op5_warc_zip(spark: SparkSession, folder: str) -> DataFrame:
    return warc.warc_round_trip(table(spark, folder, "pages"))


def op6_huffman_ids(spark: SparkSession, folder: str) -> DataFrame:
    return huffman.huffman_round_trip(table(spark, folder, "documents"), tokenizer_path("byte_bpe_50k.json"), end_id=2)


def op7_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substrings.without_repeats(table(spark, folder, "documents")).drop("kept_text")


def op8_minhash_neardup(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, folder, "documents"), width=2, percent=80)


def op9_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    judged = quality.quality_verdicts(table(spark, folder, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contaminated_pairs(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op11_merkle_multiproof(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.merkle_manifest(table(spark, folder, "documents")).drop("position", "n_fetched")


def op12_toxicity_automata(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity_scores(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op13_residue_negatives(spark: SparkSession, folder: str) -> DataFrame:
    return negatives.hard_negatives(table(spark, folder, "embeddings"))


def _crc32_sql(text: str) -> str:
    """Unsigned crc32 of ASCII text: the bits of each character in turn."""
    step = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    chars = f"list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT)"
    bits = f"list_reduce(list_concat([xor(a, b)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda c, k: {step})"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {chars}), lambda a, b: {bits}), 4294967295)"


def _merkle_sql(levels: int = 8) -> str:
    """Levels of the trees one by one; a tree that has its root stays as it is. Enough for 8^levels leaves."""
    part = lambda c: f"coalesce(concat(strlen(CAST({c} AS VARCHAR)), ':', CAST({c} AS VARCHAR)), '-')"
    leaf = lambda text: "sha256(concat(" + ", ".join([part("doc_id"), part("source"), part("lang"), part("n_chars"), part(text)]) + "))"
    forged = f"CASE WHEN {_crc32_sql('CAST(doc_id AS VARCHAR)')} % 3 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END"
    ctes = [
        f"d AS (SELECT doc_id, coalesce(concat('+', lang), '') AS g, {leaf('text')} AS leaf, {leaf('forged')} AS bad FROM (SELECT *, {forged} AS forged FROM documents))",
        "l AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS m FROM d)",
    ]

    def tree(name: str, base: str) -> None:
        """Nodes of each level, and the siblings of each node on its left and right."""
        ctes.append(f"{name}0 AS ({base})")
        for k in range(levels):
            ctes.append(
                f"{name}s{k} AS (SELECT x.g, x.i, coalesce(string_agg(y.h, '' ORDER BY y.i) FILTER (y.i < x.i), '') AS a, coalesce(string_agg(y.h, '' ORDER BY y.i) FILTER (y.i > x.i), '') AS z "
                f"FROM {name}{k} x JOIN {name}{k} y ON x.g = y.g AND x.i // 8 = y.i // 8 WHERE x.m > 1 GROUP BY 1, 2)"
            )
            ctes.append(f"{name}{k + 1} AS (SELECT g, i // 8 AS i, CASE WHEN min(m) = 1 THEN min(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h, (min(m) + 7) // 8 AS m FROM {name}{k} GROUP BY 1, 2)")

    tree("t", "SELECT g, i, leaf AS h, m FROM l")
    tree("u", f"SELECT '' AS g, row_number() OVER (ORDER BY g) - 1 AS i, h, count(*) OVER () AS m FROM t{levels}")
    ctes.append("f0 AS (SELECT l.*, bad AS f, '' AS p, i AS j FROM l)")
    for k in range(levels):
        ctes.append(f"f{k + 1} AS (SELECT x.* REPLACE (CASE WHEN s.i IS NULL THEN f ELSE sha256(concat(s.a, f, s.z)) END AS f, concat(p, s.a, s.z) AS p, j // 8 AS j) FROM f{k} x LEFT JOIN ts{k} s ON s.g = x.g AND s.i = x.j)")
    ctes.append(f"v0 AS (SELECT x.* REPLACE (r.i AS j), r.h AS subroot FROM f{levels} x JOIN (SELECT g, h, row_number() OVER (ORDER BY g) - 1 AS i FROM t{levels}) r ON r.g = x.g)")
    for k in range(levels):
        ctes.append(f"v{k + 1} AS (SELECT x.* REPLACE (CASE WHEN s.i IS NULL THEN f ELSE sha256(concat(s.a, f, s.z)) END AS f, concat(p, s.a, s.z) AS p, j // 8 AS j) FROM v{k} x LEFT JOIN us{k} s ON s.i = x.j)")
    return "WITH " + ", ".join(ctes) + (
        f" SELECT doc_id, leaf, subroot, r.h AS root, sha256(p) AS proof_sha256, f AS folded_root, f = r.h AS verified FROM v{levels} CROSS JOIN (SELECT h FROM u{levels}) r"
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_best_fit_packing, op2_personal_data, op3_label_propagation, op4_secret_scan, op5_warc_zip, op6_huffman_ids, op7_substring_dedup, op8_minhash_neardup, op9_quality_rules, op10_decontamination, op11_merkle_multiproof, op12_toxicity_automata, op13_residue_negatives)
}
SQL: dict[str, str] = {
    "op5_warc_zip": """
        WITH p AS (SELECT page_id, coalesce(url, '') AS url, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
             g AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) ELSE page_id END AS first FROM p)
        SELECT page_id, url, payload_bytes, payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN first = page_id THEN NULL ELSE first END AS refers_to FROM g""",
    "op7_substring_dedup": r"""
        WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
             win AS (SELECT doc_id, i AS s, array_to_string(w[i:i + 19], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d)),
             f AS (SELECT doc_id, s, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) > 1 AS again FROM win),
             gone AS (SELECT DISTINCT doc_id, s + j AS p FROM f, range(0, 20) t(j) WHERE again),
             words AS (SELECT doc_id, w[i] AS word, i AS p FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
             kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n FROM words x WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = x.doc_id AND g.p = x.p) GROUP BY 1)
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)""",
    "op8_minhash_neardup": r"""
        WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
             s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE concat(w[i], ' ', w[i + 1]) END AS k FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w), 2))) AS i FROM d WHERE len(w) > 0)),
             n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
             c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY 1, 2),
             e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
             r AS (SELECT doc_id AS id, doc_id AS c FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.id),
             m AS (SELECT id, min(c) AS c FROM r GROUP BY 1)
        SELECT id AS doc_id, coalesce(n, 0) AS n_shingles, c AS component_id, id = c AS kept FROM m LEFT JOIN n ON n.doc_id = m.id""",
    "op11_merkle_multiproof": _merkle_sql(),
    "op13_residue_negatives": """
        WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
                   WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
             s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM e a JOIN e b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
             p AS (SELECT a, b, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5)
        SELECT p.a AS anchor_id, p.b AS positive_id, CAST(row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) AS INTEGER) AS rank, s.b AS negative_id, p.score AS positive_score, s.score AS negative_score
        FROM p JOIN s ON s.a = p.a AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score QUALIFY rank <= 3""",
}
