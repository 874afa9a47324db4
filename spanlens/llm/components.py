"""Connected components of a graph that no machine holds."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import stored


def _pointed(edges: DataFrame, keep) -> DataFrame:
    """Each (node, other) for which ``keep`` holds, with the smallest node around ``node`` as ``least``.

    The minimum is aggregated before the shuffle, stored and joined back, so a hub with very many neighbours is a
    skewed join, which Spark splits, and not one group in one task.
    """
    least = edges.groupBy("node").agg(F.min("other").alias("least"))
    least = stored(least.select("node", F.least("node", "least").alias("least")), "least")
    return edges.filter(keep).join(least, "node")


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 100) -> DataFrame:
    """(node, component) for every node of an edge list; ``component`` is the smallest node reachable.

    Large-star and small-star steps in turn: the first ties every larger neighbour of a node to the smallest node
    around it, the second does so for the smaller ones.  They end in stars, after about log(nodes) rounds.  Each
    round is written to the shared folder, so lost executors cost one round at most.  Self-links and repeated
    edges do no harm; an edge with a null end is no edge.
    """
    now = stored(
        edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
        .filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("a") != F.col("b"))).distinct(), "edges",
    )
    mark = lambda df: df.agg(F.count(F.lit(1)), F.sum(F.hash("a", "b").cast("long"))).first()
    seen = mark(now)
    for _ in range(rounds):
        if not seen[0]:
            break
        both = now.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(
            now.select(F.col("b").alias("node"), F.col("a").alias("other"))
        )
        large = _pointed(both, F.col("other") > F.col("node")).select(
            F.col("other").alias("node"), F.col("least").alias("other")
        ).filter(F.col("node") != F.col("other")).distinct()
        small = _pointed(large, F.lit(True))
        star = (
            small.select(F.col("other").alias("a"), F.col("least").alias("b"))
            .unionByName(small.select(F.col("node").alias("a"), F.col("least").alias("b")))
            .filter(F.col("a") != F.col("b")).distinct()
        )
        now = stored(star, "edges")
        last, seen = seen, mark(now)
        if seen == last:
            break
    else:
        raise RuntimeError(f"no end after {rounds} rounds")
    tops = now.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(tops)
