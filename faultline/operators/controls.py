"""Controls and evidence: lists, code guards, gaps, submissions; incident history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.functions import scalars as S

CONTROL_LIMIT, EVIDENCE_LIMIT = 50, 20
#: Evidence types a control is expected to have where it names none.
EXPECTED = ["code", "document", "test"]


def list_controls(controls: DataFrame, category=None, limit: int | None = None) -> DataFrame:
    df = controls if category is None else controls.filter(F.col("category") == category)
    df = df.select("control_code", S.badge("type").alias("type"), F.concat(F.col("weight").cast("string"), F.lit("/10")).alias("weight"), S.weight_tier("weight").alias("tier"), "category", "name")
    return df.orderBy("control_code").limit(limit) if limit else df


def control_page(controls: DataFrame, category=None, limit: int = CONTROL_LIMIT) -> DataFrame:
    """The first ``limit`` controls by code, as lists show them by default."""
    return list_controls(controls, category, limit)


def code_kind(code: Column | str) -> Column:
    """risk, control or unknown, by prefix; a risk's code is refused where a control's is wanted."""
    c = F.col(code) if isinstance(code, str) else code
    return F.when(c.startswith("RC-"), "control").when(c.startswith("R-"), "risk").otherwise("unknown")


def by_code(controls: DataFrame, code: str) -> DataFrame:
    if code.startswith("R-") and not code.startswith("RC-"):
        raise ValueError(f"{code} is the code of a risk, not of a control")
    return controls.filter(F.col("control_code") == code)


def control_risks(controls: DataFrame, bridge: DataFrame, risks: DataFrame) -> DataFrame:
    """Risks of each control: how many, how many open, and the highest score."""
    return (
        controls.select(F.col("id").alias("control_id"), "control_code")
        .join(bridge, "control_id")
        .join(risks.select(F.col("id").alias("risk_id"), "status", "score"), "risk_id")
        .groupBy("control_code")
        .agg(F.count(F.lit(1)).alias("n_risks"), F.count_if(F.col("status") == "detected").alias("n_open"), F.max("score").alias("max_score"))
    )


def list_evidence(evidence: DataFrame, controls: DataFrame, type=None, status=None, control_code=None) -> DataFrame:
    """Evidence with its control's code; the code is resolved by a join, so an unknown one gives no rows."""
    df = evidence
    if type is not None:
        df = df.filter(F.col("type") == type)
    if status is not None:
        df = df.filter(F.col("status") == status)
    known = controls.select(F.col("id").alias("control_id"), "control_code")
    if control_code is not None:
        known = known.filter(F.col("control_code") == control_code)
    return df.join(known, "control_id").withColumn("badge", S.evidence_badge("status"))


def evidence_page(evidence: DataFrame, controls: DataFrame, limit: int = EVIDENCE_LIMIT, **filters) -> DataFrame:
    """(short_id, control_code, type, badge, name, commit): the first ``limit`` pieces of evidence by id, ids and commits cut to 8 characters."""
    rows = list_evidence(evidence, controls, **filters).orderBy("id").limit(limit)
    return rows.select(S.short_id("id").alias("short_id"), "control_code", "type", "badge", "name", S.short_id(F.coalesce("git_hash", F.lit(""))).alias("commit"))


def evidence_gaps(controls: DataFrame, evidence: DataFrame) -> DataFrame:
    """(control_code, gap): expected types of evidence that a control lacks, in long form."""
    expected = F.col("expected_evidence_types") if "expected_evidence_types" in controls.columns else F.array(*map(F.lit, EXPECTED))
    have = evidence.groupBy("control_id").agg(F.collect_set("type").alias("have"))
    gaps = controls.select(F.col("id").alias("control_id"), "control_code", expected.alias("expected")).join(have, "control_id", "left")
    return gaps.select("control_code", F.explode(F.array_except("expected", F.coalesce("have", F.array().cast("array<string>")))).alias("gap"))


def expected_type(controls: DataFrame, submissions: DataFrame) -> DataFrame:
    """Submissions (control_code, type) with whether the control expects the type; only a warning."""
    return submissions.join(controls.select("control_code", "expected_evidence_types"), "control_code", "left").withColumn("expected", F.coalesce(F.array_contains("expected_evidence_types", F.col("type")), F.lit(False))).drop("expected_evidence_types")


def submit_evidence(evidence: DataFrame, new: DataFrame, commit: str = "") -> DataFrame:
    """The evidence with new rows, which must have control_id, type and name; a missing git_hash is the commit's."""
    for column in ("control_id", "type", "name"):
        new = new.filter(F.coalesce(F.col(column).cast("string"), F.lit("")) != "")
    if "git_hash" not in new.columns:
        new = new.withColumn("git_hash", F.lit(None).cast("string"))
    new = new.withColumn("git_hash", F.coalesce(F.nullif(F.col("git_hash"), F.lit("")), F.nullif(F.lit(commit), F.lit("")))).withColumn("status", F.lit("configured"))
    return evidence.unionByName(new, allowMissingColumns=True)


def verify_evidence(evidence: DataFrame, ids: DataFrame, at: str) -> DataFrame:
    hit = evidence.join(ids.select("id").distinct().withColumn("_hit", F.lit(True)), "id", "left")
    return hit.withColumn("verified_at", F.when(F.col("_hit"), F.lit(at)).otherwise(F.col("verified_at") if "verified_at" in evidence.columns else F.lit(None))).withColumn("status", F.when(F.col("_hit"), "verified").otherwise(F.col("status"))).drop("_hit")


def incident_history(incidents: DataFrame, as_of: str | None = None) -> DataFrame:
    """By service: totals, of the last 30 and 90 days before ``as_of`` (default: the last incident), by severity, the latest, mean value.

    The latest is given by id and, where incidents have a title, by title.
    """
    title = [F.max_by("title", F.struct("ts", "id")).alias("most_recent_title")] if "title" in incidents.columns else []
    now = F.lit(as_of).cast("timestamp_ntz") if as_of else None
    if now is None:
        incidents = incidents.join(F.broadcast(incidents.agg(F.max("ts").alias("_now"))))
        now = F.col("_now")
    days = lambda n: F.count_if(F.col("ts") >= now - F.make_dt_interval(F.lit(n)))
    return incidents.groupBy("service_id").agg(
        F.count(F.lit(1)).alias("total_incidents"),
        days(30).alias("last_30_days"),
        days(90).alias("last_90_days"),
        F.count_if(F.col("severity") == "critical").alias("critical_count"),
        F.count_if(F.col("severity") == "high").alias("high_count"),
        F.max_by("id", F.struct("ts", "id")).alias("most_recent_id"),
        *title,
        F.avg("value").alias("average_value"),
    )
