"""Graph operators on edge DataFrames. Iterations cut lineage with a reliable checkpoint."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, in_fewest_files, stored
from .skew import beside, require_none


def usable_edges(edges: DataFrame, nodes: DataFrame, src: str = "from_bus_uid", dst: str = "to_bus_uid") -> DataFrame:
    """Edges whose two different endpoints are known nodes (two semi joins)."""
    known = nodes.select("uid")
    return (
        edges.where(F.col(src) != F.col(dst))
        .join(known.withColumnRenamed("uid", src), src, "left_semi")
        .join(known.withColumnRenamed("uid", dst), dst, "left_semi")
        .select(edges.columns)
    )


def endpoints(edges: DataFrame, src: str = "from_bus_uid", dst: str = "to_bus_uid", *keep: str) -> DataFrame:
    """Both ends of every edge as rows."""
    return edges.select(F.explode(F.array(src, dst)).alias("uid"), *keep)


def connected_components(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """Nodes with the smallest node of their component (alternating large-star and small-star).

    Each half step is one aggregate with map-side combine and one join; the neighbours of a hub are
    never gathered in one place. The number of rounds grows with the logarithm of the graph.
    """
    a, b = F.col(src), F.col(dst)
    links = (
        edges.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    )
    links = cut_lineage(in_fewest_files(links))
    nodes = links.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    mark = _fingerprint(links)
    while True:
        links = cut_lineage(in_fewest_files(_small_star(_large_star(links))))
        after = _fingerprint(links)
        if after == mark:
            break
        mark = after
    return nodes.join(links.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").select(
        "node", F.coalesce("component", "node").alias("component")
    )


def _fingerprint(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def _large_star(links: DataFrame) -> DataFrame:
    """Link every larger neighbour to the smallest neighbour (or the node itself)."""
    both = links.union(links.select("v", "u"))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return (
        links.select(F.col("v").alias("u"), F.col("u").alias("w"))  # w > u
        .join(low, "u")
        .where(F.col("w") != F.col("m"))
        .select(F.col("w").alias("u"), F.col("m").alias("v"))
        .distinct()
    )


def _small_star(links: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them."""
    low = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(low, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    kept = low.select("u", F.col("m").alias("v"))
    flat = moved.union(kept).where("u != v")
    return flat.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def component_sizes(components: DataFrame) -> DataFrame:
    return components.groupBy("component").agg(F.count("*").alias("nodes"))


def largest_component(components: DataFrame) -> DataFrame:
    """Nodes of the component with most nodes; the smallest label wins a tie."""
    top = component_sizes(components).agg(
        F.min_by("component", F.struct(-F.col("nodes"), F.col("component"))).alias("component")
    )
    return components.join(top, "component", "left_semi").select("node")


def largest_connected_network(
    bus: DataFrame, branch: DataFrame, transformer: DataFrame, converter: DataFrame
) -> dict[str, DataFrame]:
    """Largest subgraph connected by branches, transformers and converters together."""
    tables = {"branch": branch, "transformer": transformer, "converter": converter}
    valid = {k: usable_edges(t, bus) for k, t in tables.items()}
    links = None
    for t in valid.values():
        pair = t.select("from_bus_uid", "to_bus_uid")
        links = pair if links is None else links.union(pair)
    components = connected_components(links, "from_bus_uid", "to_bus_uid")
    keep = cut_lineage(largest_component(components))
    if keep.isEmpty():
        raise ValueError("The network has no valid electrical connection.")
    flag = F.lit(True).alias("in_largest_connected_graph")
    out = {"bus": bus.join(keep.withColumnRenamed("node", "uid"), "uid", "left_semi").select(*bus.columns, flag)}
    for name, t in valid.items():  # both ends of a valid edge share a component
        kept = t.join(keep.withColumnRenamed("node", "from_bus_uid"), "from_bus_uid", "left_semi")
        out[name] = kept.select(*t.columns, flag)
    return out


def connectivity(nodes: DataFrame, edges: DataFrame, src: str = "from_bus_uid", dst: str = "to_bus_uid") -> DataFrame:
    """One row: nodes, distinct connections and components, isolated nodes included."""
    components = connected_components(edges, src, dst)
    labels = nodes.select(F.col("uid").alias("node")).join(components, "node", "left").select(
        F.coalesce("component", "node").alias("component")
    )
    pairs = edges.select(F.least(src, dst).alias("a"), F.greatest(src, dst).alias("b")).distinct()
    return (
        beside(
            labels.agg(F.count("*").alias("buses"), F.countDistinct("component").alias("components")),
            pairs.agg(F.count("*").alias("connections")),
        )
        .withColumn("status", F.when(F.col("components") == 1, F.lit("pass")).otherwise(F.lit("fail")))
    )


def degrees(nodes: DataFrame, edges: DataFrame, src: str = "from_bus_uid", dst: str = "to_bus_uid") -> DataFrame:
    count = endpoints(edges, src, dst).groupBy("uid").agg(F.count("*").alias("degree"))
    return nodes.join(count, "uid", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))


def component_classes(nodes: DataFrame, edges: DataFrame, src: str, dst: str) -> DataFrame:
    """How many components are isolated nodes, a single edge, or have several edges."""
    components = connected_components(edges, src, dst)
    labels = nodes.select(F.col("uid").alias("node")).join(components, "node", "left").select(
        "node", F.coalesce("component", "node").alias("component")
    )
    per_edge = (
        edges.select(F.col(src).alias("node")).join(labels, "node").groupBy("component").agg(F.count("*").alias("edges"))
    )
    sized = labels.groupBy("component").agg(F.count("*").alias("nodes")).join(per_edge, "component", "left").select(
        "component", "nodes", F.coalesce("edges", F.lit(0)).alias("edges")
    )
    kind = (
        F.when(F.col("edges") == 0, "isolated_node")
        .when((F.col("edges") == 1) & (F.col("nodes") == 2), "single_edge")
        .otherwise("multi_edge")
    )
    return sized.groupBy(kind.alias("component_class")).agg(
        F.count("*").alias("components"), F.sum("nodes").alias("nodes"), F.sum("edges").alias("edges")
    )


def first_reach(seeds: DataFrame, incidence: DataFrame) -> DataFrame:
    """Breadth-first propagation over shared nodes: (uid, seed, hop) of every reached line.

    seeds: uid of lines that start with a value. incidence: (uid, node) of all lines. The fewest hops decide,
    then the smallest seed, which is the order of a queue. Lines meet through their nodes in two joins, so a
    node shared by many lines never produces all its line pairs.

    Runs of lines that meet one line on each side are contracted by pointer doubling, so a chain of n lines takes
    log(n) rounds. The rounds that remain count junctions, and each of them adds only the lines it improves.
    """
    seeds = seeds.select("uid").distinct()
    open_lines = cut_lineage(_open_incidence(seeds, incidence))
    darts = _darts(open_lines)
    runs = not darts.isEmpty()
    ends = _run_ends(darts)
    edges = ends.groupBy("uid").agg(F.count("*").alias("n"), F.min(F.struct("end", "steps")).alias("a"), F.max(F.struct("end", "steps")).alias("b"))
    edges = edges.where("n = 2").select(F.col("a.end").alias("a"), F.col("b.end").alias("b"), (F.col("a.steps") + F.col("b.steps")).alias("steps")).distinct()
    edges = cut_lineage(edges.union(edges.select("b", "a", "steps")).distinct().join(seeds.withColumnRenamed("uid", "b"), "b", "left_anti"))
    further = lambda steps: F.struct((F.col("r.hop") + steps).alias("hop"), F.col("r.seed").alias("seed")).alias("r")
    start = seeds.select("uid", F.struct(F.lit(0).cast("long").alias("hop"), F.col("uid").alias("seed")).alias("r"))
    along = lambda frontier: frontier.join(edges, F.col("uid") == F.col("a")).select(F.col("b").alias("uid"), further(F.col("steps")))
    if runs:
        open_lines = open_lines.join(darts.select("uid").distinct(), "uid", "left_anti")
    # A seed keeps its own value, so only the other lines are asked; their nodes know their smallest seed.
    near = open_lines.where("seed IS NOT NULL").groupBy("uid").agg(F.min("seed").alias("seed"))
    frontier = near.select("uid", F.struct(F.lit(1).cast("long").alias("hop"), "seed").alias("r"))
    if runs:
        frontier = frontier.union(along(start)).groupBy("uid").agg(F.min("r").alias("r"))
    frontier = cut_lineage(frontier)
    open_lines = open_lines.where("others > 1").select("uid", "node")
    tables = [frontier]
    while not frontier.isEmpty():
        at_node = frontier.join(open_lines, "uid").groupBy("node").agg(F.min("r").alias("r"))
        step = open_lines.join(at_node, "node").select("uid", further(1)).union(along(frontier)).groupBy("uid").agg(F.min("r").alias("r"))
        known = reduce(DataFrame.unionByName, tables).groupBy("uid").agg(F.min("r").alias("old"))
        frontier = cut_lineage(step.join(known, "uid", "left").where(F.col("old").isNull() | (F.col("r") < F.col("old"))).select("uid", "r"))
        tables.append(frontier)
        if len(tables) == 8:
            tables = [cut_lineage(reduce(DataFrame.unionByName, tables).groupBy("uid").agg(F.min("r").alias("r")))]
    # Seeds are no line of the tables, as no step leads to one.
    reached = (tables[0] if len(tables) < 3 else reduce(DataFrame.unionByName, tables).groupBy("uid").agg(F.min("r").alias("r"))).unionByName(start)
    if runs:
        inner = ends.join(reached.withColumnRenamed("uid", "end"), "end").groupBy("uid").agg(
            F.min(F.struct((F.col("r.hop") + F.col("steps")).alias("hop"), F.col("r.seed").alias("seed"))).alias("r")
        )
        reached = reached.unionByName(inner)
    return reached.select("uid", "r.seed", "r.hop")


def _open_incidence(seeds: DataFrame, incidence: DataFrame) -> DataFrame:
    """Places of lines that are no seed: (uid, node, lines, a, b, others, seed) with the node's number of lines, its
    smallest and largest line, its lines that are no seed, and its smallest seed.

    Lines of seeds are counted per node and go no further. One shuffle by line tells both kinds apart.
    """
    rows = incidence.select("uid", "node").join(seeds.withColumn("__seed", F.lit(True)), "uid", "left")
    rows = stored(rows.select("uid", "node", F.coalesce("__seed", F.lit(False)).alias("is_seed")).distinct(), "incidence")
    nodes = rows.where("node IS NOT NULL").groupBy("node").agg(
        F.count("*").alias("lines"), F.min("uid").alias("a"), F.max("uid").alias("b"),
        F.count_if(~F.col("is_seed")).alias("others"), F.min(F.when(F.col("is_seed"), F.col("uid"))).alias("seed"),
    )
    return rows.where("NOT is_seed").select("uid", "node").join(nodes, "node").select("uid", "node", "lines", "a", "b", "others", "seed")


def _darts(open_lines: DataFrame) -> DataFrame:
    """Lines inside a run, once per node that they can be left through: (uid, exit, entry, to).

    Such a line is no seed, and exactly two of its nodes hold one other line each, the rest none.
    """
    met = open_lines.where("lines > 1")
    # A line that is met often has many nodes; only the two of a run are kept.
    other = F.when(F.col("a") == F.col("uid"), F.col("b")).otherwise(F.col("a"))
    side = F.struct("node", other.alias("to"))
    per_line = met.groupBy("uid").agg(F.count("*").alias("meets"), F.max("lines").alias("most"), F.min(side).alias("p"), F.max(side).alias("q"))
    inner = per_line.where("meets = 2 AND most = 2")
    both = F.explode(F.array(*[
        F.struct(F.col(f"{i}.node").alias("exit"), F.col(f"{o}.node").alias("entry"), F.col(f"{i}.to").alias("to")) for i, o in ("pq", "qp")
    ]))
    return cut_lineage(inner.select("uid", both.alias("s")).select("uid", "s.exit", "s.entry", "s.to"))


def _run_ends(darts: DataFrame) -> DataFrame:
    """(uid, end, steps): for each side of a line inside a run, the line at the run's end and the hops to it.

    Runs that close to a circle have no end and drop out.
    """
    onward = darts.select(F.col("uid").alias("to"), F.col("entry").alias("exit"), F.col("exit").alias("after"))
    state = darts.join(onward, ["to", "exit"], "left").select("uid", "exit", "to", "after", F.lit(1).cast("long").alias("steps"))
    state = cut_lineage(state)
    if darts.isEmpty():
        return state.select("uid", F.col("to").alias("end"), "steps")
    done = []
    for _ in range(max(1, state.count()).bit_length() + 1):
        done.append(state.where("after IS NULL").select("uid", F.col("to").alias("end"), "steps", "exit"))
        going = state.where("after IS NOT NULL")
        if going.isEmpty():
            break
        ahead = state.select(F.col("uid").alias("to"), F.col("exit").alias("after"), F.col("to").alias("far"), F.col("after").alias("then"), F.col("steps").alias("more"))
        state = cut_lineage(going.join(ahead, ["to", "after"]).select("uid", "exit", F.col("far").alias("to"), F.col("then").alias("after"), (F.col("steps") + F.col("more")).alias("steps")).unionByName(state.where("after IS NULL")))
    # The finished sides travel along, so the last table holds all of them.
    return done[-1].select("uid", "end", "steps")


def spread_from_seeds(seeds: DataFrame, incidence: DataFrame) -> DataFrame:
    """Every reached line with its path from the seed (`path[0]` is the reference).

    A line's parent is the smallest line of the hop before it and of the same seed. Paths are rebuilt from
    these pointers by doubling, in as many joins as the longest path has binary digits.
    """
    incidence = cut_lineage(incidence.distinct())
    reached = cut_lineage(first_reach(seeds, incidence))
    at_node = reached.join(incidence, "uid").groupBy("node", "seed", (F.col("hop") + 1).alias("hop")).agg(F.min("uid").alias("parent"))
    parents = reached.where("hop > 0").join(incidence, "uid").join(at_node, ["node", "seed", "hop"]).groupBy("uid").agg(F.min("parent").alias("at"))
    # `path` holds the lines from behind `at` to the line itself.
    state = cut_lineage(reached.select("uid").join(parents, "uid", "left").select("uid", "at", F.array("uid").alias("path")))
    while not state.where("at IS NOT NULL").isEmpty():
        ahead = state.select(F.col("uid").alias("at"), F.col("at").alias("next"), F.col("path").alias("before"))
        state = cut_lineage(state.join(ahead, "at", "left").select(
            "uid", F.col("next").alias("at"), F.when(F.col("before").isNotNull(), F.concat("before", "path")).otherwise(F.col("path")).alias("path")
        ))
    return state.select("uid", "path")


def path_lengths(edges: DataFrame, start: str, max_hops: int | None = None) -> DataFrame:
    """Shortest path from one node to every reachable node: node, total, nodes, uids.

    edges: uid, a, b, length (undirected, parallel edges allowed). Bellman-Ford rounds: each keeps
    the best path per node with map-side combine and stops when nothing improves.
    """
    best_parallel = edges.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(
        F.min(F.struct("length", "uid")).alias("e")
    )
    hop = best_parallel.select("a", "b", "e.length", "e.uid")
    hop = cut_lineage(hop.union(hop.select("b", "a", "length", "uid")))
    best = edges.sparkSession.createDataFrame(
        [(start, 0.0, [start], [])], "node string, total double, nodes array<string>, uids array<string>"
    )
    frontier, rounds = best, 0
    while not frontier.isEmpty() and (max_hops is None or rounds < max_hops):
        rounds += 1
        step = (
            frontier.join(hop, frontier["node"] == hop["a"])
            .select(
                F.col("b").alias("node"), (F.col("total") + F.col("length")).alias("total"),
                F.concat("nodes", F.array("b")).alias("nodes"), F.concat("uids", F.array("uid")).alias("uids"),
            )
            .groupBy("node").agg(F.min(F.struct("total", "nodes", "uids")).alias("p"))
            .select("node", "p.*")
        )
        old = best.select("node", F.col("total").alias("__old"))
        frontier = cut_lineage(
            step.join(old, "node", "left").where(F.col("__old").isNull() | (F.col("total") < F.col("__old"))).drop("__old")
        )
        best = cut_lineage(
            best.union(frontier).groupBy("node").agg(F.min(F.struct("total", "nodes", "uids")).alias("p")).select("node", "p.*")
        )
    return best


def shortest_path(edges: DataFrame, start: str, goal: str, max_hops: int | None = None) -> DataFrame:
    """Shortest path between two nodes: one row (length, nodes, uids), or none."""
    best = path_lengths(edges, start, max_hops)
    return best.where(F.col("node") == goal).select(F.col("total").alias("length"), "nodes", "uids")


def station_connection(
    nodes: DataFrame, edges: DataFrame, station_a: str, station_b: str, direct_only: bool = True
) -> DataFrame:
    """Shortest line path between two stations; `direct_only` forbids passing through other stations."""
    if direct_only:
        others = nodes.where((F.col("node_type") == "station") & ~F.col("uid").isin(station_a, station_b)).select("uid")
        for end in ("a", "b"):
            edges = edges.join(others.withColumnRenamed("uid", end), end, "left_anti")
    return shortest_path(edges, station_a, station_b)


def require_connected(nodes: DataFrame, edges: DataFrame) -> None:
    require_none(connectivity(nodes, edges).where("status <> 'pass'"), "The retained network is not connected")
