"""The relationship graph: neighbours, bounded traversal, causal paths with mitigations, upserts.

Rules of ours, where there is nothing to match: a strength equal to the threshold counts, a bidirectional edge is
followed both ways, a traversal visits a node once at its smallest depth, a path visits no node twice, and a path's
strength is the product of its edges'.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from faultline.sources.scratch import dropped, stored, stored_in_buckets

DEPTH, STRENGTH = 3, 0.3
#: Edges of one source that are kept together; more are dealt over several buckets.
HOT_EDGES = 100_000
#: Sources with so many edges that are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 500_000


def usable(edges: DataFrame, min_strength: float = STRENGTH, relation_types: str | list[str] | None = None) -> DataFrame:
    """Directed edges (src, dst, ...) that are strong enough and of the given types (a list, or names with commas)."""
    df = edges.filter(F.col("strength") >= min_strength)
    if relation_types:
        names = [t.strip() for t in relation_types.split(",")] if isinstance(relation_types, str) else relation_types
        df = df.filter(F.col("relation_type").isin(names))
    columns = [F.col("relation_type"), F.col("strength").cast("double").alias("strength")]
    out = df.select(F.col("source_id").alias("src"), F.col("target_id").alias("dst"), F.col("target_type").alias("dst_type"), *columns)
    if "direction" in edges.columns:
        back = df.filter(F.col("direction") == "bidirectional").select(F.col("target_id").alias("src"), F.col("source_id").alias("dst"), F.col("source_type").alias("dst_type"), *columns)
        out = out.unionByName(back)
    return out


def relationships(edges: DataFrame, entity_id: str) -> DataFrame:
    """Edges at either end of which the entity stands."""
    return edges.filter((F.col("source_id") == entity_id) | (F.col("target_id") == entity_id))


def _adjacency(links: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """``links`` stored in buckets of src, and (src, parts) of the sources that have very many edges, None if there are none.

    If there are, the edges are stored again, those of such a source over as many buckets as parts, so that none holds them all.
    """
    buckets = stored_in_buckets(links, "graph-edges", ["src"])
    hot = stored(buckets.groupBy("src").count().filter(F.col("count") > HOT_EDGES).select("src", F.ceil(F.col("count") / HOT_EDGES).cast("int").alias("parts")), "graph-hot")
    n = hot.count()
    if not n:
        dropped(hot)
        return buckets, None
    few = F.broadcast(hot) if n <= BROADCAST_ROWS else hot
    part = F.pmod(F.xxhash64("dst"), F.coalesce("parts", F.lit(1))).cast("int")
    again = stored_in_buckets(buckets.join(few, "src", "left").withColumn("part", part).drop("parts"), "graph-edges", ["src", "part"])
    dropped(buckets)
    return again, few


def _followed(links: DataFrame, hot: DataFrame | None, frontier: DataFrame) -> DataFrame:
    """The frontier (src, ...) joined to its edges, which stay where they are."""
    # Neither side is broadcast: edges are too many, and a frontier may be.
    if hot is None:
        return frontier.hint("merge").join(links, "src")
    frontier = frontier.join(hot, "src", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    return frontier.hint("merge").join(links, ["src", "part"]).drop("part")


def expand(edges: DataFrame, seeds: DataFrame, max_depth: int = 1, min_strength: float = STRENGTH, relation_types=None) -> DataFrame:
    """(seed, entity_id, entity_type, depth, strength, path): what each seed (entity_id) reaches within ``max_depth``, each node at its smallest depth.

    strength is that of the strongest edge that reaches the node there, path the nodes of one way to it: of those over a
    strongest last edge the first in order of its nodes. The edges are written once, in buckets, so a level moves its
    frontier to them and no edge; each level is written too. The search ends with the first level that finds nothing.
    """
    links, hot = _adjacency(usable(edges, min_strength, relation_types))
    seeds = seeds.select(F.col("entity_id").cast("string").alias("entity_id")).distinct()
    frontier = seen = stored(seeds.select(F.col("entity_id").alias("seed"), "entity_id", F.array("entity_id").alias("path")), "graph-seeds")
    levels = [frontier.select("seed", "entity_id", F.lit("").alias("entity_type"), F.lit(0).alias("depth"), F.lit(0.0).alias("strength"), "path").limit(0)]
    for depth in range(1, max_depth + 1):
        step = _followed(links, hot, frontier.withColumnRenamed("entity_id", "src")).groupBy("seed", F.col("dst").alias("entity_id")).agg(
            F.max("strength").alias("strength"), F.min("dst_type").alias("entity_type"), F.min_by("path", F.struct(-F.col("strength"), F.col("path"))).alias("path")
        )
        step = step.join(seen.select("seed", "entity_id"), ["seed", "entity_id"], "left_anti")
        step = stored(step.select("seed", "entity_id", "entity_type", F.lit(depth).alias("depth"), "strength", F.array_append("path", F.col("entity_id")).alias("path")), "graph-level")
        levels.append(step)
        if step.isEmpty():
            break
        frontier = step.select("seed", "entity_id", "path")
        seen = seen.select("seed", "entity_id").unionByName(step.select("seed", "entity_id"))
    dropped(links)
    return reduce(DataFrame.unionByName, levels)


def traverse(edges: DataFrame, start: str, max_depth: int = DEPTH, min_strength: float = STRENGTH, relation_types=None) -> DataFrame:
    """(entity_id, entity_type, depth, strength): nodes within ``max_depth`` at their smallest depth; strength of the strongest edge that reaches them there."""
    seeds = edges.sparkSession.createDataFrame([(start,)], "entity_id string")
    return expand(edges, seeds, max_depth, min_strength, relation_types).select("entity_id", "entity_type", "depth", "strength")


def by_depth(nodes: DataFrame) -> DataFrame:
    """A traversal's nodes from the nearest on; nodes nearer than one step are not listed."""
    return nodes.filter("depth >= 1").orderBy("depth", F.desc("strength"), "entity_id")


def depth_counts(nodes: DataFrame) -> DataFrame:
    """Nodes by depth, with the largest depth there is."""
    return nodes.filter("depth >= 1").groupBy("depth").agg(F.count(F.lit(1)).alias("n"), F.max("strength").alias("max_strength"))


def foresight(edges: DataFrame, start: str, depth: int = DEPTH, min_strength: float = STRENGTH, relation_types=None) -> DataFrame:
    """(path, depth, total_strength): all simple paths of up to ``depth`` edges from the entity.

    Their number grows as the degree to the power of ``depth``; :func:`strongest_paths` gives the first k alone.
    """
    links, hot = _adjacency(usable(edges, min_strength, relation_types).select("src", "dst", "strength"))
    paths = edges.sparkSession.createDataFrame([([start], start, 1.0)], "path array<string>, src string, total_strength double")
    levels = []
    for n in range(1, depth + 1):
        # A level is written once, so longer paths start from it and not from the edges again.
        step = _followed(links, hot, paths).filter(~F.array_contains("path", F.col("dst"))).select(F.array_append("path", F.col("dst")).alias("path"), F.lit(n).alias("depth"), (F.col("total_strength") * F.col("strength")).alias("total_strength"))
        step = stored(step, "graph-paths")
        levels.append(step)
        if n < depth and step.isEmpty():
            break
        paths = step.select("path", F.element_at("path", -1).alias("src"), "total_strength")
    dropped(links)
    return reduce(DataFrame.unionByName, levels)


def _strongest_links(links: DataFrame, k: int, depth: int) -> DataFrame:
    """The edges that one of the ``k`` strongest paths can use.

    A path goes on over one of the ``k`` strongest of the ways that it may take; at most ``depth`` of the nodes there are
    on it already. So of each source the ``k + depth`` targets with the strongest edges are enough, and of parallel edges k.
    """
    parallel = Window.partitionBy("src", "dst").orderBy(F.desc("strength"))
    links = links.withColumns({"_n": F.row_number().over(parallel), "_best": F.max("strength").over(parallel)}).filter(F.col("_n") <= k)
    place = F.dense_rank().over(Window.partitionBy("src").orderBy(F.desc("_best"), "dst"))
    return links.withColumn("_n", place).filter(F.col("_n") <= k + depth).drop("_n", "_best")


def _ways_on(links: DataFrame, frontier: DataFrame, k: int, depth: int) -> DataFrame:
    """The edges of the frontier's nodes (src) that one of the ``k`` strongest paths can use; no other edge is moved."""
    sources = frontier.select("src").distinct()
    n = sources.count()
    return _strongest_links(links.join(F.broadcast(sources) if n <= BROADCAST_ROWS else sources, "src", "left_semi"), k, depth)


def strongest_paths(edges: DataFrame, seeds: DataFrame, k: int, depth: int = DEPTH, min_strength: float = STRENGTH, relation_types=None) -> DataFrame:
    """(seed, rank, path, depth, total_strength): the first ``k`` simple paths of each seed (entity_id), of up to ``depth`` edges.

    The strongest come first, of equal ones the shorter, then by their nodes. Strengths are from 0 to 1, so a path comes
    after each of its beginnings: no path among the first ``k`` begins with one that is not. A level therefore goes on from
    those of its paths alone that are among the first ``k`` so far, at most ``k`` a seed, and nothing weaker than the last
    of them is made. Seeds that nothing leads on from have no rows; parallel edges make paths of their own.

    The edges are written once. A level reads them where they lie and moves those of its frontier's nodes alone. The order
    is the same for every ``k``, so the first ones of a large ``k`` are those of a smaller one.
    """
    if min_strength < 0:
        raise ValueError("strengths are to be from 0 to 1")
    links = stored(usable(edges, min_strength, relation_types).select("src", "dst", "strength"), "graph-edges")
    if not links.filter((F.col("strength") > 1) | F.isnan("strength")).isEmpty():
        dropped(links)
        raise ValueError("strengths are to be from 0 to 1")
    order = Window.partitionBy("seed").orderBy(F.desc("total_strength"), "depth", "path")
    seeds = stored(seeds.select(F.col("entity_id").cast("string").alias("seed")).filter("seed is not null").distinct(), "graph-seeds")
    best, frontier = None, seeds.select("seed", F.array("seed").alias("path"), F.col("seed").alias("src"), F.lit(1.0).alias("total_strength"), F.lit(0.0).alias("least"))
    for n in range(1, depth + 1):
        step = frontier.join(_ways_on(links, frontier, k, depth), "src").withColumn("total_strength", F.col("total_strength") * F.col("strength")).filter((F.col("total_strength") >= F.col("least")) & ~F.array_contains("path", F.col("dst")))
        step = step.select("seed", F.array_append("path", F.col("dst")).alias("path"), F.lit(n).alias("depth"), "total_strength")
        known = step if best is None else best.select(*step.columns).unionByName(step)
        ranked = stored(known.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k), "graph-strongest")
        if best is not None:
            dropped(best)
        best = ranked
        last = best.filter(F.col("rank") == k).select("seed", F.col("total_strength").alias("least"))
        frontier = best.filter(F.col("depth") == n)
        if n < depth and frontier.isEmpty():
            break
        frontier = frontier.join(last, "seed", "left").select("seed", "path", F.element_at("path", -1).alias("src"), "total_strength", F.coalesce("least", F.lit(0.0)).alias("least"))
    dropped(links, seeds)
    return best.select("seed", "rank", "path", "depth", "total_strength")


def with_mitigations(paths: DataFrame, mitigations: DataFrame) -> DataFrame:
    """Paths with the mitigations (for_node_id, label) of any of their nodes, sorted."""
    keyed = paths.withColumn("_path", F.array_join("path", "\0"))
    nodes = keyed.select("_path", F.explode("path").alias("for_node_id"))
    own = nodes.join(mitigations, "for_node_id").groupBy("_path").agg(F.array_sort(F.collect_set(F.struct("for_node_id", "label"))).alias("mitigations"))
    return keyed.join(own, "_path", "left").drop("_path")


def impact_metadata(edges: DataFrame, paths: DataFrame, depth: int) -> DataFrame:
    return edges.agg(F.count(F.lit(1)).alias("edges_examined")).join(F.broadcast(paths.agg(F.count(F.lit(1)).alias("n_paths"), F.max("depth").alias("max_depth")))).withColumn("traversal_depth", F.lit(depth))


def upsert(table: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``table`` with the rows of ``new`` in place of those of equal keys; of equal keys in ``new`` the last one stays.

    Rows are in the order in which ``new`` gives them: by partition, then by place in it.
    """
    columns = new.columns
    last = new.withColumn("_at", F.monotonically_increasing_id()).groupBy(*[F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(keys)])
    new = last.agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in columns]), "_at").alias("_row")).select("_row.*")
    return table.join(new.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def delete(table: DataFrame, column: str, value: str) -> DataFrame:
    return table.filter(~F.col(column).eqNullSafe(value))
