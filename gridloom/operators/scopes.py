"""Index of scope patterns: applicability scopes meet targets by exactly the columns they fill.

A scope fills some of the columns uid, class, subclass, status, location, voltage and capacity. Which ones is its
pattern, a bit mask of which a table has at most a few dozen. A target asks each pattern of a name with its own
values in that pattern's columns, so scope and target meet in one equi-join and no pair shares a name alone.

- Voltages are sets: both sides send one row per element, and the smallest common element keeps the pair.
- Capacity intervals are bands on a fixed monotone grid. An interval is covered by O(log) dyadic nodes, a
  capacity asks its node of every level, and exactly one of them is in the cover. Intervals are compared
  exactly after the join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut_lineage
from .skew import dealt

EQUAL = ("applies_to_uid", "class", "subclass", "status")
TARGET = {"applies_to_uid": "t_uid", "class": "t_class", "subclass": "t_subclass", "status": "t_status"}
LOCATION, VOLTAGE, CAPACITY = 4, 5, 6
#: Grid steps per doubling of 1 + |capacity|, levels of its dyadic tree, and the room of a level.
STEPS, LEVELS, ROOM = 1024, 18, 2**18
MIDDLE = 2**16
#: Rows of a table of scopes or keys up to which it is broadcast, after it was counted.
SMALL = 50_000


def slot(capacity: Column) -> Column:
    """Monotone place of a capacity on the grid, 0 to 2 * MIDDLE - 1; values that are no number come last."""
    size = F.least(F.floor(STEPS * F.log2(1 + F.abs(capacity))), F.lit(MIDDLE - 1))
    return F.when(F.isnan(capacity), F.lit(2 * MIDDLE - 1)).otherwise(MIDDLE + F.signum(capacity) * size).cast("long")


def covering_nodes(low: Column, high: Column) -> Column:
    """Dyadic nodes that cover the slots from low to high, both included; none where low > high."""
    none = F.array().cast("array<bigint>")
    start = F.struct(low.cast("long").alias("a"), (high + 1).cast("long").alias("b"), none.alias("nodes"))

    def step(s: Column, level: Column) -> Column:
        a, b = s["a"], s["b"]
        opened = a < b
        left, right = opened & (a % 2 == 1), opened & (b % 2 == 1)
        more = F.concat(F.when(left, F.array(level * ROOM + a)).otherwise(none), F.when(right, F.array(level * ROOM + b - 1)).otherwise(none))
        return F.struct(F.floor((a + left.cast("int")) / 2).alias("a"), F.floor((b - right.cast("int")) / 2).alias("b"), F.concat(s["nodes"], more).alias("nodes"))

    return F.aggregate(F.sequence(F.lit(0).cast("long"), F.lit(LEVELS - 1).cast("long")), start, step)["nodes"]


def nodes_above(place: Column) -> Column:
    """The node of a slot on every level."""
    return F.transform(F.sequence(F.lit(0).cast("long"), F.lit(LEVELS - 1).cast("long")), lambda k: k * ROOM + F.floor(place / F.pow(F.lit(2.0), k)))


def interval_nodes() -> Column:
    low = F.coalesce(slot(F.col("s_capacity_min_mw")), F.lit(0))
    high = F.coalesce(slot(F.col("s_capacity_max_mw")), F.lit(2 * MIDDLE - 1))
    return covering_nodes(low, high)


def inside_interval() -> Column:
    lo, hi, cap = F.col("s_capacity_min_mw"), F.col("s_capacity_max_mw"), F.col("t_capacity")
    return cap.isNotNull() & (lo.isNull() | (cap >= lo)) & (hi.isNull() | (cap < hi))


def has_voltage() -> Column:
    return F.coalesce(F.size("s_voltage_kv") > 0, F.lit(False))


def has_capacity() -> Column:
    return F.col("s_capacity_min_mw").isNotNull() | F.col("s_capacity_max_mw").isNotNull()


def pattern() -> Column:
    """Bit mask of the columns that a scope fills."""
    filled = [F.col("s_" + c).isNotNull() for c in EQUAL] + [F.col("s_location").isNotNull(), has_voltage(), has_capacity()]
    return reduce(lambda a, b: a + b, [F.when(present, 1 << k).otherwise(0) for k, present in enumerate(filled)])


def _bit(k: int) -> Column:
    return F.col("__pattern").bitwiseAND(F.lit(1 << k)) != 0


def _exploded(df: DataFrame, k: int, values: Column, kind: str, name: str) -> DataFrame:
    """One row per element where the pattern has bit k, else the row as it is with a null element."""
    none = F.array(F.lit(None).cast(kind))
    return df.withColumn(name, F.explode(F.when(_bit(k), values.cast(f"array<{kind}>")).otherwise(none)))


def _keyed(df: DataFrame, equal: list[Column]) -> DataFrame:
    """Add the hash of the values in the pattern's columns but for the capacity. Equal hashes of other values are
    told apart later."""
    own = [F.when(_bit(k), c.cast("string")) for k, c in enumerate(equal)]
    return df.withColumn("__key", F.xxhash64("name", "__pattern", *own, "__place", "__level")).drop("__place")


def _small(df: DataFrame) -> DataFrame:
    """Broadcast hint for a table of few rows, by its count; larger ones are shuffled."""
    return F.broadcast(df) if df.count() <= SMALL else df


def fitting_pairs(targets: DataFrame, scopes: DataFrame) -> DataFrame:
    """Pairs of targets and scopes of one name that agree in all of the scope's columns.

    targets: name, patterns (array of the name's patterns) and t_<target> columns; scopes: tier, name and s_<scope>.
    Targets first meet the distinct keys that scopes have, and only those that do ask for capacity nodes, on the
    levels that occur under their key.
    """
    offered = scopes.withColumn("__pattern", pattern())
    offered = _exploded(offered, LOCATION, F.array("s_location"), "string", "__place")
    offered = _exploded(offered, VOLTAGE, F.array_distinct("s_voltage_kv"), "double", "__level")
    offered = _keyed(offered, [F.col("s_" + c) for c in EQUAL])
    offered = _exploded(offered, CAPACITY, interval_nodes(), "bigint", "__node")
    offered = cut_lineage(offered.select("tier", "__key", F.col("__level").alias("__also"), F.coalesce("__node", F.lit(-1).cast("long")).alias("__node")))
    depth = F.when(F.col("__node") < 0, -1).otherwise(F.floor(F.col("__node") / ROOM)).cast("int")
    keys = cut_lineage(offered.groupBy("__key").agg(F.collect_set(depth).alias("__depths")))
    # A few small targets make most of the work below, so they are dealt to all tasks.
    asked = dealt(targets).withColumn("__pattern", F.explode("patterns")).drop("patterns")
    for k, c in enumerate(EQUAL):
        asked = asked.where(~_bit(k) | F.col(TARGET[c]).isNotNull())
    asked = asked.where(~_bit(CAPACITY) | F.col("t_capacity").isNotNull())
    asked = _exploded(asked, LOCATION, F.array_distinct("t_locations"), "string", "__place")
    asked = _exploded(asked, VOLTAGE, F.array_distinct("t_voltage"), "double", "__level")
    asked = _keyed(asked, [F.col(TARGET[c]) for c in EQUAL]).drop("__pattern", "__level").join(_small(keys), "__key")
    place = slot(F.col("t_capacity"))
    node = lambda d: F.when(d < 0, F.lit(-1)).otherwise(d.cast("long") * ROOM + F.floor(place / F.pow(F.lit(2.0), d))).cast("long")
    asked = asked.withColumn("__node", F.explode(F.transform("__depths", node))).drop("__depths")
    pairs = asked.join(_small(offered), ["__key", "__node"]).drop("__key", "__node").join(_small(scopes.drop("name")), "tier")
    common = F.array_min(F.array_intersect("s_voltage_kv", "t_voltage"))
    return pairs.where(F.col("__also").isNull() | (F.col("__also") == common)).drop("__also")


def capacity_bands(targets: DataFrame, bounds: DataFrame) -> DataFrame:
    """Add `band`, the largest bound (`b`) that a target's capacity reaches: equal for capacities that no bound
    tells apart.

    Bounds are looked up by grid slot. A slot without a bound at or below a capacity takes the largest bound
    of the slots before it, carried along the grid, which has a fixed size.
    """
    known = bounds.groupBy(slot(F.col("b")).alias("__slot")).agg(F.array_sort(F.collect_set("b")).alias("__bs"))
    asked = targets.where("t_capacity IS NOT NULL").select(slot(F.col("t_capacity")).alias("__slot")).distinct()
    before = Window.orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = asked.join(known, "__slot", "full").withColumn("__before", F.max(F.array_max("__bs")).over(before))
    out = targets.withColumn("__slot", slot(F.col("t_capacity"))).join(slots, "__slot", "left")
    reached = F.array_max(F.filter("__bs", lambda b: b <= F.col("t_capacity")))
    return out.withColumn("band", F.when(F.col("t_capacity").isNotNull(), F.coalesce(reached, "__before", F.lit(float("-inf"))))).drop("__slot", "__bs", "__before")
