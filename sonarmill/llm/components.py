"""Connected components of an edge table by alternating large-star and small-star steps.

Each step is a grouped minimum (combined before the shuffle) joined back to the
edges; adaptive execution splits that join where one node has very many edges.
Nothing is collected but one checksum row a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonarmill.session import cut, free

MAX_ROUNDS = 60


def _both(edges: DataFrame, *rows: tuple[str, str]) -> DataFrame:
    """(u, v) for each named pair of columns of every row, from one reading of ``edges``."""
    pairs = F.array(*[F.struct(F.col(u).alias("u"), F.col(v).alias("v")) for u, v in rows])
    return edges.select(F.explode(pairs).alias("e")).select("e.u", "e.v")


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Edges are (u, v) with u > v; every node's chosen neighbours move to its least one.

    The joins are merged, never broadcast: a broadcast goes through the driver, at every size.
    """
    if large:
        sym = _both(edges, ("u", "v"), ("v", "u"))
        least = sym.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        moved = sym.where("v > u").join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        moved = _both(edges.join(least.hint("merge"), "u"), ("v", "m"), ("u", "m"))
    return moved.where("u > v").distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) for every id on a link; component is the least id reachable.

    Empty links give no rows; self-links and repeated links are harmless; links
    with a null end are no links.
    """
    u, v = F.col(a), F.col(b)
    edges = cut(links.where(u.isNotNull() & v.isNotNull() & (u != v)).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct(), "edges")
    seen = None
    for _ in range(MAX_ROUNDS):
        before, edges = edges, cut(_star(_star(edges, True), False), "edges")
        free(before)
        total = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if total == seen:
            break
        seen = total
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    roots = edges.select(F.col("v").alias("id")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots.select("id", F.col("id").alias("component")))
