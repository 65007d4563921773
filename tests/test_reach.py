"""Propagation over lines: against a queue, on long chains, circles and stars."""

import random
from collections import deque

import pytest

from gridloom.operators import graph


def queue_order(seeds, incidence):
    lines, nodes = {}, {}
    for uid, node in incidence:
        lines.setdefault(uid, set()).add(node)
        nodes.setdefault(node, set()).add(uid)
    best = {s: (0, s) for s in seeds}
    todo = deque(sorted(seeds))
    while todo:
        uid = todo.popleft()
        hop, seed = best[uid]
        for other in {v for n in lines.get(uid, ()) for v in nodes[n]}:
            if other not in best or (hop + 1, seed) < best[other]:
                best[other] = (hop + 1, seed)
                todo.append(other)
    return best


def reach(spark, seeds, incidence):
    out = graph.first_reach(spark.createDataFrame([(s,) for s in seeds], "uid string"), spark.createDataFrame(incidence, "uid string, node long"))
    return {r.uid: (r.hop, r.seed) for r in out.collect()}


@pytest.mark.parametrize("kind", ["sparse", "dense", "mixed"])
def test_reach_equals_a_queue(spark, kind):
    rng = random.Random(kind)
    incidence = []
    for i in range(150):
        a = rng.randrange(220 if kind == "sparse" else 90)
        incidence += [(f"l{i}", a), (f"l{i}", rng.choice([a + 1, a + 1, rng.randrange(220)]))]
        if kind == "mixed" and i % 5 == 0:
            incidence.append((f"l{i}", rng.randrange(90)))
    # chains between junctions, a circle without a seed, a circle with one, two lines with two common nodes
    for c in range(4):
        ends = [rng.randrange(90) for _ in range(2)]
        places = [ends[0], *range(1000 * (c + 1), 1000 * (c + 1) + 12), ends[1]]
        incidence += [(f"c{c}-{k:02d}", n) for k, pair in enumerate(zip(places, places[1:])) for n in pair]
    incidence += [(f"o{k}", 9000 + k) for k in range(7)] + [(f"o{k}", 9000 + (k + 1) % 7) for k in range(7)]
    incidence += [(f"s{k}", 9100 + k) for k in range(9)] + [(f"s{k}", 9100 + (k + 1) % 9) for k in range(9)]
    incidence += [("d1", 9300), ("d1", 9301), ("d2", 9300), ("d2", 9301), ("e1", 9400), ("e1", 9401), ("e2", 9400), ("e2", 9401)]
    seeds = [f"l{i}" for i in rng.sample(range(150), 6)] + ["s3", "d1", "c0-05"]
    assert reach(spark, seeds, incidence) == queue_order(seeds, incidence)
    assert reach(spark, [], incidence) == {}


def test_long_chain_takes_few_rounds(spark, monkeypatch):
    """100,000 lines in a row: rounds follow the binary digits of the length, not the length."""
    n, rounds = 100_000, []
    cut = graph.cut_lineage
    monkeypatch.setattr(graph, "cut_lineage", lambda df: rounds.append(1) or cut(df))
    lines = spark.range(n).selectExpr("concat('l', lpad(id, 6, '0')) AS uid", "explode(array(id, id + 1)) AS node")
    out = graph.first_reach(spark.createDataFrame([("l000000",), ("l099999",)], "uid string"), lines)
    got = out.selectExpr("count(*)", "max(hop)", "count_if(seed = 'l000000')").first()
    assert tuple(got) == (n, n // 2 - 1, n // 2) and len(rounds) < 40
