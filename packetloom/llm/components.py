"""Connected components of a link table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.llm.common import drop_written, written


def _state(edges: DataFrame) -> tuple:
    check = F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))
    return tuple(edges.agg(F.count("*"), check).first())


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every linked node; the root is the smallest node reachable.

    Each round turns the links of a node towards the smallest node around it,
    first seen from below (large star), then from above (small star), and writes
    the links down.  Smallest nodes come from grouped minima, so a node with
    very many links is combined before the shuffle.  Links of a node with itself
    and repeated links change nothing; an empty table has no nodes.
    """
    u, v = F.col("u"), F.col("v")
    edges = written(
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where(u != v)
        .distinct(),
        "links",
    )
    state = _state(edges)
    while state[0]:
        both = edges.unionAll(edges.select(v.alias("u"), u.alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        low = low.select("u", F.least("u", "m").alias("m"))
        large = both.where(v > u).join(low, "u").select(v.alias("u"), F.col("m").alias("v"))
        large = written(large.distinct(), "large-star")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .where(v != F.col("m"))
            .select(v.alias("u"), F.col("m").alias("v"))
            .unionAll(low.select("u", F.col("m").alias("v")))
        )
        following = written(small.distinct(), "small-star")
        drop_written(large)
        drop_written(edges)
        edges, before = following, state
        state = _state(edges)
        if state == before:
            break
    return edges.select(u.alias("node"), v.alias("root"))
