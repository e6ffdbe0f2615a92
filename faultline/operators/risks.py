"""The risk register: filtered lists, ranking, detail and context, roll-ups, lifecycle.

Filters come before limits, and no lookup is capped. ``legacy_order`` keeps the other order, in which a limit on the
rows fetched can leave out matching ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from faultline.functions import scalars as S
from faultline.operators.controls import EXPECTED, incident_history
from faultline.sources.scratch import dealt, partitions_of

RISK_LIMIT, READY_LIMIT = 1000, 10


def filtered(df: DataFrame, *, member: dict[str, str] | None = None, **equal: str | None) -> DataFrame:
    """Rows equal in every given column; an absent value (None) is no predicate. ``member``: array columns that hold a value."""
    for column, value in equal.items():
        if value is not None:
            df = df.filter(F.col(column) == value)
    for column, value in (member or {}).items():
        if value is not None:
            df = df.filter(F.array_contains(column, value))
    return df


def list_risks(risks: DataFrame, status=None, category=None, service=None, limit: int | None = None) -> DataFrame:
    df = filtered(risks, member={"linked_services": service}, status=status, category=category)
    df = df.select("risk_code", "status", "score", "category", S.cut("title", 47, 47).alias("title"))
    return df.orderBy(F.desc("score"), "risk_code").limit(limit) if limit else df


#: Columns of the list's table, with their widths.
TABLE = {"CODE": 10, "STATUS": 12, "SCORE": 8, "CATEGORY": 20, "TITLE": 50}


def table_lines(risks: DataFrame, status=None, category=None, service=None, limit: int = RISK_LIMIT) -> DataFrame:
    """(place, line): the list as a table of fixed widths with its total, header and rule; at most ``limit`` risks."""
    matching = filtered(risks, member={"linked_services": service}, status=status, category=category)
    head = matching.agg(F.array(F.concat(F.lit("Total Risks: "), F.count(F.lit(1)).cast("string")), F.lit(""), F.lit(" ".join(k.ljust(n) for k, n in TABLE.items())), F.lit("-" * 110)).alias("lines")).select(F.posexplode("lines").alias("place", "line"))
    by = [F.desc("score"), F.col("risk_code")]
    top = matching.orderBy(*by).limit(limit).withColumn("place", F.row_number().over(Window.orderBy(*by)) + 3)
    cells = zip([F.col("risk_code"), S.badge("status"), F.col("score").cast("string"), F.col("category"), S.cut("title", 47, 47)], TABLE.values())
    line = F.concat_ws(" ", *[F.when(F.length(v) < n, F.rpad(v, n, " ")).otherwise(F.coalesce(v, F.lit(" " * n))) for v, n in cells])
    return head.unionByName(top.select("place", line.alias("line")))


def open_risks(risks: DataFrame) -> DataFrame:
    return risks.filter(F.col("status") == "detected")


def ready(risks: DataFrame, category=None, limit: int = READY_LIMIT, legacy_order: bool = False) -> DataFrame:
    """The top open risks, ranked by score, then id. A limit below 1 is ignored."""
    limit = limit if limit > 0 else READY_LIMIT
    by = [F.desc("score"), F.col("id")]
    df = filtered(risks, category=category)
    if legacy_order:
        df = df.orderBy(*by).limit(RISK_LIMIT)
    top = open_risks(df).orderBy(*by).limit(limit)
    # At most ``limit`` rows reach the rank's one partition.
    rank = F.row_number().over(Window.orderBy(*by))
    return top.select(rank.alias("rank"), "risk_code", "score", S.priority("score").alias("priority"), F.substring(S.title_case("category"), 1, 18).alias("category"), S.cut("title", 42, 42).alias("title"))


def remaining(risks: DataFrame, limit: int = READY_LIMIT) -> DataFrame:
    """Open risks and those beyond the first ``limit``."""
    n = F.count(F.lit(1))
    return open_risks(risks).agg(n.alias("total_open"), F.greatest(n - limit, F.lit(0)).alias("remaining"))


def stale(risks: DataFrame) -> DataFrame:
    """Risks with a stale_since (our rule); a missing date shows as N/A."""
    since = F.coalesce(F.nullif(F.col("stale_since"), F.lit("")), F.lit("N/A"))
    return risks.filter(F.coalesce(F.col("stale_since"), F.lit("")) != "").select("risk_code", "title", "score", since.alias("stale_since"))


def lookup(risks: DataFrame, codes: DataFrame) -> DataFrame:
    """(risk_code, id) for ``codes`` (risk_code); id null for unknown codes. Of equal codes the smallest id counts."""
    ids = risks.groupBy("risk_code").agg(F.min("id").alias("id"))
    return codes.join(ids, "risk_code", "left")


def mapped_controls(risks: DataFrame, bridge: DataFrame, controls: DataFrame) -> DataFrame:
    """Controls of each risk in long form."""
    return (
        risks.select(F.col("id").alias("risk_id"), "risk_code")
        .join(bridge, "risk_id")
        .join(controls.select(F.col("id").alias("control_id"), "control_code", "name", "category", "type"), "control_id")
        .select("risk_code", "control_code", "name", "category", "type")
    )


def detail(risks: DataFrame, bridge: DataFrame, controls: DataFrame) -> DataFrame:
    """Each risk with its controls as an array, sorted by code. Risks are told apart by id, so equal codes keep their own."""
    n = partitions_of(risks, bridge)
    own = dealt(bridge, n, "control_id").join(controls.select(F.col("id").alias("control_id"), "control_code", "name", "category", "type"), "control_id")
    own = dealt(own, n, "risk_id").groupBy(F.col("risk_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("control_code", "name", "category", "type"))).alias("mapped_controls"))
    return dealt(risks, n, "id").join(own, "id", "left")


def _section(rows: DataFrame, name: str, partitions: int) -> DataFrame:
    """(id, ``name``): the rows of each risk_id as an array of structs, the highest score first, then by id."""
    rest = [c for c in rows.columns if c not in ("risk_id", "score", "id")]
    entries = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("_by"), "id", "score", *rest)))
    return dealt(rows, partitions, "risk_id").groupBy(F.col("risk_id").alias("id")).agg(F.transform(entries, lambda e: F.struct(e["id"].alias("id"), e["score"].alias("score"), *[e[c].alias(c) for c in rest])).alias(name))


def context(risks: DataFrame, bridge: DataFrame, controls: DataFrame, evidence: DataFrame, incidents: DataFrame | None = None, as_of: str | None = None, factors: DataFrame | None = None, **knowledge: DataFrame) -> DataFrame:
    """Each risk with nested controls, their evidence and gaps, and the history of its service.

    ``factors`` (risk_id, description, source, points) is its score breakdown. ``knowledge`` has a table of each further
    section, as patterns, procedures or facts: (risk_id, id, score, ...), nested from the most relevant on. Sections are
    joined by id, each gathered once; a risk without entries has an empty array. There are as many partitions as the
    largest table needs, so what a task holds does not grow with the input.
    """
    n = partitions_of(risks, bridge, evidence)
    types = dealt(evidence.select("risk_id", "control_id", "type"), n, "risk_id", "control_id").groupBy("risk_id", "control_id").agg(F.array_sort(F.collect_set("type")).alias("evidence_types"))
    # Evidence is joined first: the bridge comes by the same keys, so it stays where it is.
    own = dealt(bridge, n, "risk_id", "control_id").join(types, ["risk_id", "control_id"], "left")
    own = dealt(own, n, "control_id").join(dealt(controls.select(F.col("id").alias("control_id"), "control_code", "name", "type"), n, "control_id"), "control_id")
    own = (
        dealt(own, n, "risk_id").groupBy("risk_id")
        .agg(F.array_sort(F.collect_list(F.struct("control_code", "name", "type", F.coalesce("evidence_types", F.array().cast("array<string>")).alias("evidence_types"), F.array_except(F.array(*map(F.lit, EXPECTED)), F.coalesce("evidence_types", F.array().cast("array<string>"))).alias("evidence_gaps")))).alias("controls"))
    )
    out = dealt(risks, n, "id").join(own.withColumnRenamed("risk_id", "id"), "id", "left")
    if factors is not None:
        own = dealt(factors, n, "risk_id").groupBy(F.col("risk_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("source", "description", "points"))).alias("score_breakdown"))
        out = out.join(own, "id", "left").withColumn("score_breakdown", F.coalesce("score_breakdown", F.array().cast(own.schema["score_breakdown"].dataType)))
    for name, rows in knowledge.items():
        own = _section(rows, name, n)
        out = out.join(own, "id", "left").withColumn(name, F.coalesce(name, F.array().cast(own.schema[name].dataType)))
    if incidents is not None:
        out = out.join(incident_history(incidents, as_of), "service_id", "left")
    return out


def stpa_view(risks: DataFrame, parse: bool) -> DataFrame:
    """Structured columns where any is set; else, with ``parse``, what the narrative says."""
    structured = (F.coalesce("uca_type", F.lit("")) != "") | (F.coalesce("loss_scenario", F.lit("")) != "") | (F.coalesce(F.size("causal_factors"), F.lit(0)) > 0)
    own = F.struct("uca_type", "loss_scenario", "causal_factors", F.col("narrative").alias("clean_narrative"))
    other = S.parse_narrative("narrative") if parse else F.lit(None)
    return risks.withColumn("stpa", F.when(structured, own).otherwise(other))


def priority_summary(risks: DataFrame) -> DataFrame:
    """Risks by status and priority, and the review's summary columns."""
    p = S.priority("score")
    return risks.groupBy("status").agg(F.count(F.lit(1)).alias("total"), *(F.count_if(p == name).alias(name.lower()) for name in ("CRITICAL", "HIGH", "MEDIUM", "LOW")))


def scan_summary(findings: DataFrame) -> DataFrame:
    """Totals of a scan by action and by priority; needs action and score."""
    p = S.priority("score")
    return findings.agg(
        F.count(F.lit(1)).alias("total"),
        *(F.count_if(F.col("action") == a).alias(a) for a in ("created", "updated", "unchanged")),
        *(F.count_if(p == name).alias(name.lower()) for name in ("CRITICAL", "HIGH", "MEDIUM", "LOW")),
    )


def score_breakdown(factors: DataFrame) -> DataFrame:
    """Signed points by risk and source."""
    return factors.groupBy("risk_id", "source").agg(F.sum("points").alias("points"), F.count(F.lit(1)).alias("factors"))


def with_status(risks: DataFrame, codes: DataFrame, status: str, reason: str = "") -> DataFrame:
    """The register after the risks in ``codes`` got ``status``; resolving has a default reason. Other risks keep theirs."""
    reason = reason or ("Resolved" if status == "resolved" else "")
    hit = risks.join(codes.select("risk_code").distinct().withColumn("_hit", F.lit(True)), "risk_code", "left")
    changed = F.coalesce("_hit", F.lit(False))
    old = F.col("status_reason") if "status_reason" in risks.columns else F.lit(None)
    return hit.withColumn("status_reason", F.when(changed, F.lit(reason)).otherwise(old)).withColumn("status", F.when(changed, status).otherwise(F.col("status"))).drop("_hit")


def status_requests(risks: DataFrame, codes: DataFrame, status: str, reason: str = "") -> DataFrame:
    """(id, status, reason) of the risks in ``codes``, each once, as :func:`faultline.sources.rest.send` takes them.

    Accepting is a PATCH of the status, resolving a POST whose body is the reason alone, so status is null there.
    """
    reason = reason or ("Resolved" if status == "resolved" else "")
    sent = F.lit(None).cast("string") if status == "resolved" else F.lit(status)
    ids = risks.join(codes.select("risk_code").distinct(), "risk_code", "left_semi").groupBy("risk_code").agg(F.min("id").alias("id"))
    return ids.select("id", sent.alias("status"), F.lit(reason).alias("reason"))
