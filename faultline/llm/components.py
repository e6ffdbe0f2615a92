"""Connected components of a graph given as DataFrames, without bringing links to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm._store import dropped, stored


def connected_components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(id, component) for each distinct node, component being the smallest id reachable.

    ``nodes`` has id, ``links`` has a and b (any direction, repeats allowed; both ends should be nodes). Large-star
    and small-star steps alternate until a round changes nothing, which they do after a logarithmic number of rounds;
    each round is written to the shared folder. Null ids and null ends are dropped. An empty table of links gives every
    node itself.
    """
    links = stored(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "components", small=True)
    before = None
    while True:
        state = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        before, old = state, links
        # Large star: a node's larger neighbours move to its smallest one (or itself).
        both = links.select("u", "v").union(links.select("v", "u")).toDF("n", "m")
        least = both.groupBy("n").agg(F.min("m").alias("least")).select("n", F.least("n", "least").alias("least"))
        links = both.filter("m > n").join(least, "n").select(F.col("m").alias("u"), F.col("least").alias("v"))
        # Small star: a node's smaller neighbours move to the smallest of them.
        links = links.distinct()
        least = links.groupBy("u").agg(F.min("v").alias("least"))
        links = links.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("least").alias("v")), F.struct(F.col("v").alias("u"), F.col("least").alias("v")))).alias("x")).select("x.u", "x.v").filter("u <> v").distinct()
        links = stored(links, "components", small=True)
        dropped(old)
    return nodes.select("id").filter("id is not null").distinct().join(links.withColumnRenamed("u", "id"), "id", "left").select("id", F.coalesce("v", "id").alias("component"))
