"""Connected components of an edge list by alternating large and small stars.

Every round is two grouped minima and two joins on the grouping key.  The minima
are pre-aggregated and stored: a join then knows their size, broadcasts few of them,
and splits the edges of a hub where there are many.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import forget, stored


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a") % 1_000_003)).first())


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Edges (a, b) to (node, root): root is the least node of each component.

    Loops are ignored; nodes without another edge than loops don't appear.
    """
    e = stored(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    state = _state(e)
    while state[0]:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stored(both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m")), name)
        large = stored(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct(), name)
        below = stored(large.groupBy("a").agg(F.min("b").alias("m")), name)
        small = large.join(below, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        new = stored(small.where("a != b").distinct(), name)
        forget(e, least, large, below)
        e, was = new, state
        state = _state(e)
        if state == was:
            break
    roots = e.select(F.col("b").alias("node")).distinct()
    found = stored(e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots.withColumn("root", F.col("node"))), name)
    forget(e)
    return found
