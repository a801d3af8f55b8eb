"""Connected components of a graph whose edges are rows."""

from pyspark.sql import DataFrame, functions as F

from trailspark.llm.shared import stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node's larger neighbours are tied to the least of its surroundings."""
    both = edges.select("a", "b").union(edges.select("b", "a"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.filter(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours are tied to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").filter(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def component_roots(edges: DataFrame) -> DataFrame:
    """(node, root) for every node with an edge, from edges (a, b) of longs; root is the least
    node of the component.

    Alternating star steps; each halves the depth of what is left, so the number of rounds
    is logarithmic. Rounds are written to the shared folder; only a count and a checksum
    reach the driver. Loops (a, a) are ignored; no edges give no rows.
    """
    state = stored(edges.filter(F.col("a") != F.col("b")).distinct(), "edges")
    seen = None
    while True:
        mark = state.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if mark == seen:
            break
        seen = mark
        state = stored(_small_star(_large_star(state)), "edges")
    roots = state.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return state.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
