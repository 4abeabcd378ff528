"""Connected components by alternating large-star and small-star steps, in tables.

Each step sends every edge to the smaller end's neighbourhood; after a few rounds every node points at the smallest node
of its component. Edges stay in Spark; a round is written to the shared folder, so a lost executor replays one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basecov.session import stored

MAX_ROUNDS = 200


def _minimum(edges: DataFrame) -> DataFrame:
    """Per node the smallest neighbour; partial sums make this safe for nodes with any number of neighbours."""
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _minimum(both).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _minimum(down)
    joined = down.join(least, "u")
    return joined.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """``node`` and ``component`` (its smallest reachable node) for all nodes that a link between two of them names.

    Links may repeat and go either way; links of a node with itself and with missing ends are ignored.
    """
    edges = links.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u != v").distinct()
    edges = stored(edges, "edges")
    seen = _signature(edges)
    for _ in range(MAX_ROUNDS):
        if not seen[0]:
            break
        edges = stored(_small_star(_large_star(edges)).where("u != v").distinct(), "edges")
        now = _signature(edges)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
