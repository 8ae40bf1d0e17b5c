"""Connected components of an edge table by alternating stars, on Spark alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(v, comp) for every vertex of ``edges(a, b)``; comp is the smallest vertex of its component.

    Each round sends every larger neighbour of a vertex, then every smaller one, to the vertex's smallest neighbour
    (large star, small star).  Rounds are logarithmic in the component's diameter; each is written to the shared
    folder.  Minima are aggregated before the shuffle, and the joins on a busy vertex are plain equi-joins, which
    adaptive execution may split.  Loops and repeated edges do no harm; an empty table gives no rows.
    """
    e = written(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
        "edges",
    )
    for _ in range(max_rounds):
        ends = e.select(F.col("u").alias("x"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(e.select("v", F.lit(0), F.lit(1)))
        if ends.groupBy("x").agg(F.sum("o").alias("o"), F.max("i").alias("i")).where("o > 1 or (o = 1 and i = 1)").isEmpty():
            break  # every vertex points at one root
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        e = written(small.union(down.select("u", F.col("m").alias("v"))).distinct(), "edges")
    else:
        raise RuntimeError("components did not settle")
    found = e.groupBy("u").agg(F.min("v").alias("comp")).select(F.col("u").alias("v"), "comp")
    roots = found.select(F.col("comp").alias("v"), "comp").distinct()
    loops = edges.where("a = b").select(F.col("a").alias("v")).distinct().join(found, "v", "left_anti").join(roots, "v", "left_anti")
    return found.union(roots).union(loops.select("v", F.col("v").alias("comp")))
