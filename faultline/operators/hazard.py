"""Hazard analysis: losses, unsafe control actions, loss scenarios, control structure."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from faultline.functions import scalars as S
from faultline.operators.graph import upsert
from faultline.sources.scratch import dropped, stored

# The order of scenario levels; an unknown level sorts as top.
LEVELS = {"top": 0, "intermediate": 1, "immediate": 2}
UCA_LIMIT = 50


def level_rank(level):
    column = F.col(level) if isinstance(level, str) else level
    out = F.lit(0)
    for name, rank in LEVELS.items():
        out = F.when(column == name, rank).otherwise(out)
    return out


def new_losses(losses: DataFrame, existing: DataFrame, distinct: bool = False) -> DataFrame:
    """Losses whose title, whatever its case, is not there yet; duplicates within the batch stay unless ``distinct``."""
    key = F.lower("title")
    out = losses.withColumn("_key", key).join(existing.select(key.alias("_key")).distinct(), "_key", "left_anti")
    return (out.dropDuplicates(["_key"]) if distinct else out).drop("_key")


def resolve_uca_refs(scenarios: DataFrame, ucas: DataFrame) -> DataFrame:
    """(scenario_id, ref, uca_id): 0-based places in the document's list, uca_id null where the place has none."""
    refs = scenarios.select("scenario_id", F.explode("uca_refs").alias("ref"))
    return refs.join(ucas.select(F.col("pos").alias("ref"), "uca_id"), "ref", "left").select("scenario_id", "ref", "uca_id")


def resolve_parents(scenarios: DataFrame) -> DataFrame:
    """(scenario_id, parent_id): parents by exact title among those created before, in order of level, then place.

    Of equal titles created before, the last wins; a missing parent leaves null. Needs scenario_id, pos, title, level
    and parent_title; with document_id, a parent is looked for in the scenario's own document.
    """
    document = F.col("document_id") if "document_id" in scenarios.columns else F.lit(0)
    order = F.struct(level_rank("level").alias("rank"), F.col("pos"))
    # By title, in order: a scenario asks before those of its own place, so it finds the last one before it.
    asks = scenarios.select(document.alias("document"), F.col("parent_title").alias("key"), order.alias("at"), F.lit(0).alias("kind"), "scenario_id", F.lit(None).alias("named"))
    titles = scenarios.filter("title is not null").select(document.alias("document"), F.col("title").alias("key"), order.alias("at"), F.lit(1).alias("kind"), "scenario_id", F.col("scenario_id").alias("named"))
    before = Window.partitionBy("document", "key").orderBy("at", "kind", "scenario_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = asks.filter("key is not null").unionByName(titles).withColumn("parent_id", F.last("named", ignorenulls=True).over(before))
    return rows.filter("kind = 0").select("scenario_id", "parent_id").unionByName(asks.filter("key is null").select("scenario_id", F.col("named").alias("parent_id")))


def resolve_control_links(scenarios: DataFrame, controls: DataFrame) -> DataFrame:
    """(scenario_id, control_id, relationship); links with unknown codes are left out."""
    links = scenarios.select("scenario_id", F.explode("control_links").alias("l")).select("scenario_id", "l.control_code", "l.relationship")
    return links.join(controls.select(F.col("id").alias("control_id"), "control_code"), "control_code").select("scenario_id", "control_id", "relationship")


def detection_counts(findings: DataFrame) -> DataFrame:
    """Findings by canonical form, with how often each was made and its first content."""
    form = F.coalesce(F.nullif(F.col("canonical_form"), F.lit("")), F.lower(S.trim_space("content")))
    return findings.groupBy(form.alias("canonical_form")).agg(F.count(F.lit(1)).alias("detection_count"), F.min("content").alias("content"), F.max("confidence").alias("confidence"))


def uca_page(ucas: DataFrame, limit: int = UCA_LIMIT, **filters) -> DataFrame:
    """The first ``limit`` of :func:`list_ucas`, as lists show them by default."""
    return list_ucas(ucas, limit=limit, **filters)


def list_ucas(ucas: DataFrame, source=None, type=None, control_code=None, limit: int | None = None) -> DataFrame:
    """Actions by source and type, and by control code whatever its case; the most often detected first."""
    df = ucas
    if source is not None:
        df = df.filter(F.col("source") == source)
    if type is not None:
        df = df.filter(F.col("uca_type") == type)
    if control_code is not None:
        df = df.filter(S.same_text("control_code", F.lit(control_code)))
    df = df.orderBy(F.desc("detection_count"), "id")
    return df.limit(limit) if limit else df


def submit(document: DataFrame, existing_losses: DataFrame, controls: DataFrame, nodes: DataFrame | None = None, edges: DataFrame | None = None, repo_url: str = "") -> dict[str, DataFrame]:
    """The tables that a hazard document makes: losses, ucas, scenarios with parents, links, structure.

    The control structure is left out without ``repo_url``. The document is one row of the hazard schema.
    """
    losses = new_losses(document.select(F.inline("losses")), existing_losses)
    ucas = document.select(F.posexplode("findings").alias("pos", "f")).select("pos", F.concat(F.lit("uca-"), F.col("pos").cast("string")).alias("uca_id"), "f.*").withColumn("source", F.lit("design_review"))
    scenarios = document.select(F.posexplode("loss_scenarios").alias("pos", "s")).select("pos", F.concat(F.lit("scenario-"), F.col("pos").cast("string")).alias("scenario_id"), "s.*")
    out = {
        "losses": losses,
        "ucas": ucas.withColumn("control_code", F.nullif(F.col("control_code"), F.lit(""))),
        "scenarios": scenarios.select("scenario_id", "pos", "title", "level").join(resolve_parents(scenarios), "scenario_id"),
        "uca_links": resolve_uca_refs(scenarios, ucas).filter("uca_id is not null"),
        "missing_refs": resolve_uca_refs(scenarios, ucas).filter("uca_id is null").select("scenario_id", "ref"),
        "control_links": resolve_control_links(scenarios, controls),
    }
    if repo_url:
        new_nodes, new_edges = document.select(F.inline("control_structure.nodes")), document.select(F.inline("control_structure.edges"))
        out["nodes"] = upsert(nodes, new_nodes, ["node_key"]) if nodes is not None else new_nodes
        out["edges"] = upsert(edges, new_edges, ["from_key", "to_key"]) if edges is not None else new_edges
    return out


def hierarchy(parents: DataFrame) -> DataFrame:
    """(scenario_id, root_id, depth) of a parent table (scenario_id, parent_id), however deep its trees.

    Each round doubles the steps that a scenario has gone up, and is written, so the plan does not grow with the depth.
    Depths have no gaps along a way up: once a round brings no scenario to its root, those that are left lead into a cycle,
    and their root_id and depth are null. A parent that is not there counts as none; of several rows of a scenario the
    smallest parent counts; a null scenario_id is left out.
    """
    rows = parents.filter("scenario_id is not null").groupBy("scenario_id").agg(F.min("parent_id").alias("parent_id"))
    known = rows.select(F.col("scenario_id").alias("parent_id"), F.lit(True).alias("known"))
    rows = rows.join(known, "parent_id", "left")
    root = F.col("known").isNull()
    up = stored(rows.select("scenario_id", F.when(root, F.col("scenario_id")).otherwise(F.col("parent_id")).alias("above"), F.when(root, 0).otherwise(1).alias("depth"), root.alias("done")), "hierarchy")
    left = up.filter("not done").count()
    while left:
        further = up.select(F.col("scenario_id").alias("above"), F.col("above").alias("_above"), F.col("depth").alias("_depth"), F.col("done").alias("_done"))
        moved = up.filter("not done").join(further, "above").select("scenario_id", F.col("_above").alias("above"), (F.col("depth") + F.col("_depth")).alias("depth"), F.col("_done").alias("done"))
        step = stored(up.filter("done").unionByName(moved), "hierarchy")
        dropped(up)
        before, up = left, step
        left = up.filter("not done").count()
        if left == before:
            break
    return up.select("scenario_id", F.when(F.col("done"), F.col("above")).alias("root_id"), F.when(F.col("done"), F.col("depth")).alias("depth"))


def ranked_scenarios(scenarios: DataFrame) -> DataFrame:
    """Scenarios numbered in order of level, then place, within each document."""
    order = Window.partitionBy("document_id").orderBy(level_rank("level"), "pos")
    return scenarios.withColumn("rank", F.row_number().over(order))
