"""Connected components of an edge table by alternating large and small stars.

Each round is a grouped minimum (combined before the shuffle) and a join back
on the node. No node's neighbours are ever gathered, so a hub with very many
links costs no more memory than any other; the sort-merge join may be split
where one node is hot. Rounds are stored in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowgauge.llm.common import stored


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("u").alias("n"), F.col("v").alias("o")).union(edges.select(F.col("v").alias("n"), F.col("u").alias("o")))
    least = both.groupBy("n").agg(F.min("o").alias("m")).select("n", F.least("m", "n").alias("m"))
    return both.filter("o > n").join(least, "n").select(F.col("o").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """edges: u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v")
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]


def components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(node, root) for every node that has an edge; root is the least node of its component.

    ``edges`` has LONG columns ``u`` and ``v``. Loops and repeated edges are
    allowed, rows with a null end are left out; an empty table gives none.
    """
    links = edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    links = stored(links, "links")
    state = _state(links)
    for _ in range(max_rounds):
        if not state[0]:
            break
        links = stored(_small_star(_large_star(links)), "links")
        now = _state(links)
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
