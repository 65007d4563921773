"""Merkle proofs, toxicity and hard negatives against brute force, with odd rows and planted cases."""

import hashlib
import itertools
import math
import random
import zlib

import numpy as np
import pytest

from gridloom.llm import merkle, negatives, toxicity
from gridloom.llm.merkle import missing_coordinates

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, n long, level int, grp string, block long"
FOLDER = "/root/testdata/sf0.001"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row):
    parts = [row[c] for c in ("doc_id", "source", "lang", "n_chars", "text")]
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in parts))


def levels_of(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 8])) for i in range(0, len(levels[-1]), 8)])
    return levels


def manifest(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append(r)
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    for rs in groups.values():
        rs.sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r)))
    trees = {x: levels_of([leaf_of(r) for r in groups[x]]) for x in langs}
    top = levels_of([trees[x][-1][0] for x in langs])
    out = []
    for j, x in enumerate(langs):
        for i, r in enumerate(groups[x]):
            text = r["text"]
            if text is not None and r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            folded, siblings = leaf_of({**r, "text": text}), ""
            for tree, k in ((trees[x], i), (top, j)):
                for nodes in tree[:-1]:
                    run = nodes[k // 8 * 8 : k // 8 * 8 + 8]
                    siblings += "".join(h for q, h in enumerate(run) if q != k % 8)
                    run = [folded if q == k % 8 else h for q, h in enumerate(run)]
                    folded, k = sha("".join(run)), k // 8
            out.append((r["doc_id"], leaf_of(r), trees[x][-1][0], top[-1][0], sha(siblings), folded, folded == top[-1][0]))
    return sorted(out, key=str)


@pytest.mark.parametrize("block_levels,askers", [(1, 2), (2, 32768), (4, 32768)])
def test_merkle_equals_brute_force(spark, block_levels, askers):
    rng = random.Random(block_levels)
    rows = []
    for lang, n in (("en", 600), ("é", 65), ("fr", 64), ("de", 9), ("es", 8), ("xx", 1), (None, 3), *((f"l{k}", 1) for k in range(6))):
        rows += [(rng.randrange(10**6), rng.choice(["Some Text", "", None, "ÄB c", "x" * 3000]), lang, rng.choice(["s", None]), rng.choice([None, 5]), "leaf", 1, 2, "g", 3) for _ in range(n)]
    rows += [rows[0], rows[0], (None, "No id", "en", None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = merkle.merkle_manifest(docs, block_levels, askers).collect()
    assert sorted((tuple(r)[:7] for r in got), key=str) == manifest([r.asDict() for r in docs.collect()])
    assert sum(not r.verified for r in got) > 50


def test_merkle_of_nothing_and_of_one_row(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert merkle.merkle_manifest(none).count() == 0
    one = spark.createDataFrame([(1, "a", "en", "s", 1, None, None, None, None, None)], SCHEMA)
    r = merkle.merkle_manifest(one).first()
    assert r.leaf == r.subroot == r.root == r.folded_root and r.verified and r.proof_sha256 == sha("")


def test_missing_coordinates_are_minimal():
    """With the named nodes the root can be derived; without any one of them it can't."""

    def derives(leaves, given, n):
        known, size, level = set(leaves), n, 0
        while size > 1:
            known |= {i for at, i in given if at == level}
            known = {r for r in range(-(-size // 8)) if all(i in known for i in range(8 * r, min(8 * r + 8, size)))}
            size, level = -(-size // 8), level + 1
        return 0 in known

    rng = random.Random(3)
    for n in (1, 7, 8, 9, 64, 65, 130, 600):
        leaves = sorted(rng.sample(range(n), min(n, 5)))
        given = missing_coordinates(np.array(leaves), n)
        assert derives(leaves, given, n)
        assert not any(derives(leaves, given[:k] + given[k + 1 :], n) for k in range(len(given)))


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = list(itertools.accumulate(range(1, len(b) + 1), lambda left, j: min(left + 1, row[j] + 1, row[j - 1] + (x != b[j - 1])), initial=i))
    return row[-1]


def test_automaton_equals_edit_distance():
    terms = ["idiot", "scum", "worthless", "moron", "mor", "disgusting", "lowei+", "abcdefghi+", "îlot"]
    rng = random.Random(5)
    words = ["", "a", "idiotidiot", "loweix", "lowei", "x" * 500]
    for term in terms:
        for _ in range(300):
            w = list(term.rstrip("+")) + (list("xyz")[: rng.randrange(4)] if term.endswith("+") else [])
            for _ in range(rng.randrange(4)):
                k = rng.randrange(len(w) + 1)
                w[k : k + rng.randrange(2)] = rng.choice(["", "q", "i", "e", "é"])
            words.append("".join(w))
    words = sorted(set(words) - {""})
    got = toxicity.Automaton(terms).match(words)
    for w in words:
        best = []
        for t, term in enumerate(terms):
            if term.endswith("+"):
                near = min((edit_distance(w[:k], term[:-1]) for k in range(len(w))), default=99)
            else:
                near = edit_distance(w, term)
            if near <= toxicity.allowed_edits(term):
                best.append((near, t))
        assert got.get(w) == (min(best)[::-1] if best else None), w


@pytest.fixture(scope="module")
def planted(spark):
    """Abuse is toxic, also misspelled; the same terms quoted are not."""
    rng = random.Random(11)
    terms = ["idiot", "moron", "worthless", "disgusting"]
    filler = lambda n: " ".join("".join(rng.choices("abcdefgh", k=rng.randrange(3, 9))) for _ in range(n))
    docs, labels, kinds = [], [], {}
    for i in range(1800):
        t = rng.choice(terms)
        kind = "clean" if i % 3 == 0 else rng.choice(["abuse", "typo", "quote"])
        if kind == "typo":
            k = rng.randrange(1, len(t) - 1)
            t = t[:k] + rng.choice(["", "z"]) + t[k + 1 :]
        middle = {"clean": "", "abuse": f"you are such a {t} really", "typo": f"you {t} go away", "quote": f'the witness said "he is a {t}" in court'}[kind]
        docs.append((i, f"{filler(20)} {middle} {filler(20)}"))
        labels.append((i, int(kind in ("abuse", "typo"))))
        kinds[i] = kind
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), kinds


def test_misspelled_terms_and_quotations(planted):
    docs, labels, kinds = planted
    got = {r.doc_id: r for r in toxicity.toxicity_scores(docs, labels).collect()}
    share = {}
    for i, kind in kinds.items():
        if got[i].held_out:
            share.setdefault(kind, []).append(got[i].predicted)
    assert all(zlib.crc32(str(i).encode()) % 3 == 1 for i in got if got[i].held_out)
    mean = {k: sum(v) / len(v) for k, v in share.items()}
    assert mean["abuse"] > 0.95 and mean["typo"] > 0.9 and mean["quote"] < 0.05 and mean["clean"] == 0


def test_held_out_labels_teach_nothing(spark, planted):
    docs, labels, _ = planted
    turned = labels.withColumn("toxic", toxicity.F.when(toxicity.held_out(), 1 - toxicity.F.col("toxic")).otherwise(toxicity.F.col("toxic")))
    one, two = (sorted((r.doc_id, r.score) for r in toxicity.toxicity_scores(docs, some).collect()) for some in (labels, turned))
    assert one == two


def test_toxicity_edges(spark, planted):
    _, labels, _ = planted
    text = "alpha beta " * 20000
    rows = [(1, None, 1), (2, "", 1), (3, text, 1), (3, text, 1), (None, "you idiot", 1), (4, "x" * 100000, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    for some in (labels, labels.limit(0), spark.createDataFrame([(1, None), (None, 1), (2, 0)], "doc_id long, toxic int")):
        got = toxicity.toxicity_scores(docs, some).collect()
        assert len(got) == 6 and all(0 <= r.score <= 1 and r.held_out is not None and r.predicted in (0, 1) for r in got)
        assert toxicity.toxicity_scores(docs.limit(0), some).count() == 0


def test_toxicity_on_given_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.toxicity_scores(docs, labels).join(labels, "doc_id").where("held_out").groupBy("toxic", "predicted").count().collect()
    n = {(r.toxic, r.predicted): r["count"] for r in got}
    assert n[1, 1] / (n[1, 1] + n[1, 0]) > 0.8 and n.get((0, 1), 0) < 0.01 * n[0, 0]


def mined(rows):
    """Brute force over eligible (id, label, integer vector)."""
    anchors = {}
    for r in rows:
        if r[0] % 50 == 0:
            anchors[r[0]] = min(anchors.get(r[0], r), r, key=lambda x: (x[1], x[2]))
    out = []
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    for a, (_, label, v) in anchors.items():
        scored = sorted((-dot(v, r[2]), r[0], r[1]) for r in rows if r[0] != a)
        for p in [s for s in scored if s[2] == label][:5]:
            fit = [s for s in scored if s[2] != label and 50 * -p[0] <= 100 * -s[0] <= 95 * -p[0]][:3]
            out += [(a, p[1], k, s[1], -p[0], -s[0]) for k, s in enumerate(fit, 1)]
    return sorted(out)


@pytest.mark.parametrize("scale", [1.0, 900.0, 2.0**20])
def test_negatives_equal_brute_force(spark, scale):
    rng = random.Random(int(scale))
    rows = []
    for i in range(700):
        kind = rng.randrange(8)
        v = [rng.choice([0.25, 0.5, -0.125, 0.75]) * scale for _ in range(6)] if kind else [0.5 * scale] * rng.choice([6, 4])
        rows.append((rng.randrange(450), v, rng.randrange(3), "x"))
    bad = [(50, None, 1, "x"), (None, [1.0], 1, "x"), (100, [1.0, None], 1, "x"), (150, [float("nan")], 1, "x"), (151, [float("inf")], 1, "x"), (152, [1.0], None, "x"), (153, [1e300], 1, "x")]
    docs = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>, label int, score string").repartition(4)
    flat = [(i, (k + 1) % 10 if i % 7 == 0 else k, [math.floor(256 * x) for x in v] + [0] * (6 - len(v))) for i, v, k, _ in rows]
    got = sorted(tuple(r) for r in negatives.hard_negatives(docs).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())
    want = mined(flat)
    assert len(want) > 20 and got == want
    assert negatives.hard_negatives(docs.limit(0)).count() == 0
    assert negatives.hard_negatives(docs.where("vec_id = 1")).count() == 0


def test_residues_give_exact_scores():
    rng = np.random.default_rng(7)
    for size, dim in ((100, 3), (2**12, 900), (2**28, 40)):
        a, b = rng.integers(-size, size + 1, (9, dim)), rng.integers(-size, size + 1, (11, dim))
        a[0], b[0] = size, -size
        bound = int((a.astype(object) ** 2).sum(axis=1).max())
        primes = negatives.primes_for(bound)
        got = negatives.signed_scores([negatives.residue_product(negatives.residues(a, p), negatives.residues(b, p), p) for p in primes], primes)
        assert (got.astype(np.int64).astype(object) == a.astype(object) @ b.astype(object).T).all()


def test_anchors_in_strides(spark, monkeypatch):
    docs = spark.read.parquet(f"{FOLDER}/embeddings.parquet")
    whole = sorted(map(tuple, negatives.hard_negatives(docs).collect()))
    monkeypatch.setattr(negatives, "ANCHORS", 3)
    monkeypatch.setattr(negatives, "STRIDE", 2)
    assert whole and sorted(map(tuple, negatives.hard_negatives(docs).collect())) == whole
