"""Scan submissions: findings of either JSON root, attribution to components, modes, gates, references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.functions import scalars as S


def findings(documents: DataFrame, column: str = "value") -> DataFrame:
    """One row a finding (document columns, pos, finding as variant) of JSON texts whose root is an object or a bare array.

    Text that is not JSON, or has no list of findings, gives no rows.
    """
    root = F.try_parse_json(F.col(column))
    listed = F.coalesce(F.try_variant_get(root, "$.findings", "variant"), root)
    return documents.select(*[c for c in documents.columns if c != column], F.posexplode(F.try_variant_get(listed, "$", "array<variant>")).alias("pos", "finding"))


def submission_fields(documents: DataFrame, column: str = "value", service: str | None = None) -> DataFrame:
    """service, scan_type (full where missing), scan_mode and business_criticality (null where 0) of each document."""
    v = F.try_parse_json(F.col(column))
    text = lambda path: F.nullif(F.coalesce(F.try_variant_get(v, path, "string"), F.lit("")), F.lit(""))
    return documents.select(
        *[c for c in documents.columns if c != column],
        F.coalesce(text("$.service"), F.lit(service).cast("string")).alias("service"),
        F.coalesce(text("$.scan_type"), F.lit("full")).alias("scan_type"),
        text("$.scan_mode").alias("scan_mode"),
        F.nullif(F.try_variant_get(v, "$.business_criticality", "double"), F.lit(0.0)).alias("business_criticality"),
    )


#: Lengths that take no more rows a path all together than a search among more of them.
FEW_LENGTHS = 4


def _search_order(lengths: list[int]) -> dict[int, list[int]]:
    """For each of the sorted lengths, the smaller ones that a binary search for it looks at."""
    out = {}
    for length in lengths:
        low, high, out[length] = 0, len(lengths) - 1, []
        while True:
            middle = (low + high) // 2
            if lengths[middle] == length:
                break
            if lengths[middle] < length:
                out[length].append(lengths[middle])
                low = middle + 1
            else:
                high = middle - 1
    return out


def prefix_markers(names: DataFrame, lengths: list[int]) -> DataFrame:
    """(prefix, component): each of ``names`` (prefix, component), and the cuts of it that a binary search for its length looks at.

    A cut leads the search on to longer prefixes; its component is the longest name that it begins with, if there is one.
    """
    order = _search_order(lengths)
    looked_at = F.element_at(F.create_map(*[x for n in lengths for x in (F.lit(n), F.array(*map(F.lit, order[n])).cast("array<int>"))]), F.length("prefix"))
    # The names that a name begins with, by length.
    shorter = names.select(F.col("prefix").alias("whole"), F.explode(F.filter(F.array(*map(F.lit, lengths)), lambda n: n < F.length("prefix"))).alias("n"))
    within = shorter.select("whole", F.substr("whole", F.lit(1), "n").alias("prefix"), "n").join(names, "prefix").groupBy("whole").agg(F.collect_list(F.struct("n", "component")).alias("within"))
    cuts = names.select(F.col("prefix").alias("whole"), F.explode(looked_at).alias("n")).join(within, "whole", "left")
    best = F.array_max(F.filter("within", lambda x: x["n"] <= F.col("n")))
    cuts = cuts.select(F.substr("whole", F.lit(1), "n").alias("prefix"), best["component"].alias("component"))
    # A cut that is a name itself has the name's component from either side.
    return names.unionByName(cuts).groupBy("prefix").agg(F.max("component").alias("component"))


def longest_prefix(paths: DataFrame, components: DataFrame, path: str = "path") -> DataFrame:
    """``paths`` with the name of the component whose path is the longest prefix (raw text, so services/a is one of services/ab).

    A binary search over the lengths that component paths have: each round cuts a path at one length and looks the cut up
    by an equi-join; found, it goes on with longer cuts, else with shorter ones. So a path is one row a round, and there are
    log2(lengths) + 1 rounds at most, however many components there are. Up to ``FEW_LENGTHS`` of them are all looked up
    in one join. The lengths come to the driver; there are no more
    of them than characters in the longest component path. Of equal prefixes the name first in order wins; a path without
    one has null.
    """
    names = components.filter(F.length("path") > 0).groupBy(F.col("path").alias("prefix")).agg(F.min("name").alias("component"))
    lengths = sorted(r[0] for r in names.select(F.length("prefix")).distinct().collect())
    if not lengths:
        return paths.withColumn("component", F.lit(None).cast(components.schema["name"].dataType))
    if len(lengths) <= FEW_LENGTHS:
        cuts = F.transform(F.filter(F.array(*map(F.lit, lengths)), lambda n: n <= F.length(path)), lambda n: F.substr(F.col(path), F.lit(1), n))
        found = paths.select(path).distinct().select(path, F.explode(cuts).alias("prefix")).join(names, "prefix")
        return paths.join(found.groupBy(path).agg(F.max_by("component", F.length("prefix")).alias("component")), path, "left")
    markers = prefix_markers(names, lengths).select(F.col("prefix").alias("_key"), F.col("component").alias("_found"), F.lit(True).alias("_hit"))
    rows = paths.select(path).distinct().select(path, F.lit(None).cast(components.schema["name"].dataType).alias("component"), F.lit(0).alias("_low"), F.lit(len(lengths) - 1).alias("_high"))
    known = F.array(*map(F.lit, lengths))
    for _ in range(len(lengths).bit_length()):
        middle = F.floor((F.col("_low") + F.col("_high")) / 2).cast("int")
        rows = rows.withColumn("_middle", middle).withColumn("_at", F.get(known, F.col("_middle")))
        # Keys that are in no table keep rows whose search is over, or that are shorter, apart from each other.
        looks = (F.col("_low") <= F.col("_high")) & (F.col("_at") <= F.length(path))
        rows = rows.withColumn("_key", F.when(looks, F.substr(F.col(path), F.lit(1), F.col("_at"))).otherwise(F.concat(F.lit("\0"), F.col(path)))).join(markers, "_key", "left")
        hit = F.col("_hit").isNotNull()
        rows = rows.select(path, F.when(hit, F.coalesce("_found", "component")).otherwise(F.col("component")).alias("component"), F.when(hit, F.col("_middle") + 1).otherwise(F.col("_low")).alias("_low"), F.when(hit | (F.col("_low") > F.col("_high")), F.col("_high")).otherwise(F.col("_middle") - 1).alias("_high"))
    return paths.join(rows.select(path, "component"), path, "left")


def linked_services(rows: DataFrame, components: DataFrame, project: str) -> DataFrame:
    """Findings with linked_services set: what they have, else their component, else the components of their evidence, else nothing.

    Needs finding_id, linked_services, component and evidence_paths (arrays may be null). Services are project/component, sorted.
    """
    paths = rows.select("finding_id", F.explode("evidence_paths").alias("path"))
    matched = longest_prefix(paths, components).filter("component is not null").groupBy("finding_id").agg(F.array_sort(F.collect_set(F.concat(F.lit(project + "/"), F.col("component")))).alias("_matched"))
    own = F.when(F.size("linked_services") > 0, F.col("linked_services"))
    named = F.when(F.coalesce("component", F.lit("")) != "", F.array(F.concat(F.lit(project + "/"), F.col("component"))))
    return rows.join(matched, "finding_id", "left").withColumn("linked_services", F.coalesce(own, named, F.col("_matched"), F.col("linked_services"))).drop("_matched")


def scan_mode(ci: Column, auto: Column, review: Column, tty: Column, stdin: Column) -> Column:
    """ci, else auto, else review, else auto where there is no terminal, else review; a review on stdin is auto."""
    mode = F.when(ci, "ci").when(auto, "auto").when(review, "review").when(~tty, "auto").otherwise("review")
    return F.when((mode == "review") & stdin, "auto").otherwise(mode)


def service_name(project: Column, flag: Column) -> Column:
    """The project file's name over the flag."""
    return F.coalesce(F.nullif(project, F.lit("")), F.nullif(flag, F.lit("")))


def ci_status(critical: Column, high: Column, failed: Column | None = None) -> Column:
    """Exit status of a CI scan: 2 after an error, 1 if anything is critical or high, else 0."""
    gate = F.when(critical + high > 0, 1).otherwise(0)
    return gate if failed is None else F.when(failed, 2).otherwise(gate)


def review_status(decision: Column, enforce: Column, reachable: Column, parsed: Column, fail_closed: Column) -> Column:
    """Exit status of a review: 1 for a hold that is enforced, an unreadable answer, or no answer where that fails closed."""
    return F.when(~reachable, F.when(fail_closed, 1).otherwise(0)).when(~parsed, 1).when(enforce & (decision == "hold"), 1).otherwise(0)


def review_label(decision: Column) -> Column:
    """What a review shows: anything but a pass is a hold, though only hold fails it."""
    return F.when(decision == "pass", "PASS").otherwise("HOLD")


def base_ref(github: Column, circle: Column, gitlab: Column) -> Column:
    """The first of the CI variables that is set; branch names get origin/, a commit does not."""
    branch = lambda c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit("origin/"), c))
    return F.coalesce(branch(github), branch(circle), F.nullif(gitlab, F.lit("")), F.lit("origin/main"))


def changed_files(lines: DataFrame, column: str = "value") -> DataFrame:
    return lines.filter(F.length(S.trim_space(column)) > 0)


def without_flag(arguments: Column, flag: str) -> Column:
    """Struct of the arguments without a flag, and whether it was there."""
    return F.struct(F.array_remove(arguments, flag).alias("arguments"), F.array_contains(arguments, flag).alias("present"))


def organisation_id(names: DataFrame, organisations: DataFrame) -> DataFrame:
    """``names`` (name) with the id of the organisation of that name, whatever the case of either; the smallest id of several, null for none."""
    ids = organisations.groupBy(F.lower("name").alias("_key")).agg(F.min("id").alias("organisation_id"))
    return names.withColumn("_key", F.lower("name")).join(ids, "_key", "left").drop("_key")


def accepted(submissions: DataFrame, required: list[str]) -> DataFrame:
    """Submissions with an outcome: accepted, or the first of the required columns that is missing."""
    outcome = F.lit("accepted")
    for column in reversed(required):
        outcome = F.when(F.coalesce(F.col(column).cast("string"), F.lit("")) == "", f"missing {column}").otherwise(outcome)
    return submissions.withColumn("outcome", outcome)
