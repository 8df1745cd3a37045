"""Connected components of a link table, by alternating star contraction.

Each round rewires every link to the smallest neighbour, first for larger and
then for smaller ends, until only stars are left. Rounds use joins and partial
minima alone: no neighbour list is gathered, so a hub with a third of all links
is split like any skewed join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def _lowest(links: DataFrame) -> DataFrame:
    return links.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    m = _lowest(both).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(m, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    m = _lowest(links)
    rewired = links.join(m, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rewired.union(m.select("u", F.col("m").alias("v"))).distinct()


def connected_components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """``(node, component)`` for each node of ``links(u, v)``; the smallest node names a component.

    Nodes are of any ordered type. Null ends and loops link nothing; repeated
    links count once. The number of rounds grows with the logarithm of the
    longest path; reaching ``rounds`` raises an error rather than a wrong result.
    """
    u, v = (F.col(c) for c in links.columns[:2])
    links = links.where(u != v).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct()
    links = checkpointed(links)

    def state(x: DataFrame) -> tuple:
        return tuple(x.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())

    before = state(links)
    for _ in range(rounds):
        if not before[0]:
            break
        links = checkpointed(_small_star(_large_star(links)))
        now = state(links)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components not settled after {rounds} rounds")
    roots = links.select("v").distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select(F.col("v").alias("node"), F.col("v").alias("component")))


#: Tasks over which one component's nodes are spread where they learn its least id.
SALTS = 16


def with_component_least(nodes: DataFrame, of: DataFrame) -> DataFrame:
    """``nodes(node, least, ...)`` with ``component_id``, the smallest ``least`` of each node's component.

    ``of`` is the result of :func:`connected_components`; a node that is not in it
    is a component of its own. Nodes of one component meet its least in ``SALTS``
    tasks, so one that holds a third of all nodes is no single task's.
    """
    own = nodes.join(of, "node", "left").withColumn("__c", F.coalesce("component", "node"))
    named = own.where("component is not null").groupBy("__c").agg(F.min("least").alias("__least"), F.lit(True).alias("__named"))
    spread = named.withColumn("__salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    met = own.withColumn("__salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")).join(spread, ["__c", "__salt"], "left")
    return met.withColumn("component_id", F.when(F.col("__named"), F.col("__least")).otherwise(F.col("least"))).select(*nodes.columns, "component_id")
