import pytest
from pyspark.sql import functions as F

from faultline.functions import scalars as S

TEXT = "Intro\n**Unsafe Control Action:** not_provided\n**Loss Scenario:**  data is lost \n**Causal Factors:**\n- one\n  - two\nplain"


def values(spark, column, rows, *more):
    """The column over rows of (x, y)."""
    df = spark.createDataFrame([(i, *(r if isinstance(r, tuple) else (r,))) for i, r in enumerate(rows)], "i int, x string" + (", y string" if rows and isinstance(rows[0], tuple) else ""))
    return [r[0] for r in df.orderBy("i").select(column).collect()]


@pytest.mark.parametrize(
    "column, cases",
    [
        (lambda: S.priority(F.col("x").cast("int")), {"80": "CRITICAL", "79": "HIGH", "60": "HIGH", "59": "MEDIUM", "40": "MEDIUM", "39": "LOW", "0": "LOW", None: "LOW"}),
        (lambda: S.priority_25(F.col("x").cast("int")), {"20": "CRITICAL", "15": "HIGH", "10": "MEDIUM", "9": "LOW"}),
        (lambda: S.weight_tier(F.col("x").cast("int")), {"9": "Critical", "7": "Required", "5": "Important", "3": "Recommended", "2": "Advisory"}),
        (lambda: S.badge("x"), {"detected": "[DETECTED]", "odd": "[ODD]"}),
        (lambda: S.validation_badge("x"), {"analyst_validated": "[VALIDATED]", "auto_extracted": "[AUTO]", "contradicted": "[CONTRADICTED]"}),
        (lambda: S.evidence_badge("x"), {"not_configured": "[NOT CONFIGURED]", "verified": "[VERIFIED]"}),
        (lambda: S.discovery_badge("x"), {"both": "[SEM+GRAPH]", "graph": "[GRAPH]", "semantic": "[SEM]", "none": ""}),
        (lambda: S.title_case("x"), {"not_specified": "Not Specified", "a__bC": "A  BC", "": ""}),
        (lambda: S.uca_title_case("x"), {"not_provided": "Not Provided", "wrong_timing": "Wrong Timing", "wrong duration": "Wrong Duration"}),
        (lambda: S.truncate("x", 8), {"short": "short", "a\nb": "a b", "123456789": "12345...", "12345678": "12345678"}),
        (lambda: S.truncate("x", 2), {"abc": "ab"}),
        (lambda: S.cut("x", 5, 3), {"12345": "12345", "123456": "123..."}),
        (lambda: S.short_id("x", "..."), {"123456789": "12345678...", "1234": "1234"}),
        (lambda: S.delay(F.col("x").cast("int")), {"59": "59s", "60": "1m", "3599": "59m", "3600": "1h", "7300": "2h"}),
        (lambda: S.percent(F.col("x").cast("double")), {"0.5": "50%", "0.994": "99%", "0.125": "12%", "0.375": "38%", "0.005": "0%"}),
        (lambda: S.digits_int("x"), {"12": 12, "12a": 0, "": 0, "-1": 0, "9000000000": 9000000000}),
        (lambda: S.prefix_int("x", 20), {"12abc": 12, "-3": -3, "x": 20, "": 20}),
        (lambda: S.emergency_note("x"), {"fix [emergency:  db down ] x": "db down", "[Emergency: no]": None, "none": None}),
        (lambda: S.repository_name("x", F.lit("/home/me/dir")), {"git@h:user/repo.git": "repo", "https://h/user/repo": "repo", "h:repo": "repo", "": "dir"}),
        (lambda: S.last_ref_segment("x"), {"refs/heads/x": "x", "main": "main", "a/b": "a/b"}),
        (lambda: S.semver_base("x"), {"7.11.4+nightly.3": "7.11.4", "7.11.4": "7.11.4", "edge": "edge", "edge-9+x+y": "edge-9", "": "", "+z": ""}),
        (lambda: S.masked("x"), {"1234567890": "1234...7890", "short": "****"}),
        (lambda: S.criticality("x"), {"hobby": 0.0, "internal": 0.25, "customer-facing": 0.6, "critical": 1.0, "": 0.0, "other": 0.0}),
        (lambda: S.first_prose_line("x"), {"# Head\n\n  text here\nmore": "text here", "#": ""}),
        (lambda: S.front_matter_description("x"), {"---\nname: a\ndescription: \"does it\"\n---\nbody": "does it", "# T\nbody": "body"}),
        (lambda: S.finding_tag("x"), {"created": "NEW", "updated": "UPD", "same": "---"}),
        (lambda: S.inside("x", "/a"), {"/a/b": True, "/ab": False, "/a/../b": False}),
        (lambda: S.wrap("x", 10, "  "), {"aa bb cc dd": "aa bb cc\n  dd", "averylongwordhere b": "averylongwordhere\n  b", "": "", "  a \n b ": "a b"}),
    ],
)
def test_scalar(spark, column, cases):
    assert dict(zip(cases, values(spark, column(), [*cases]))) == cases


def test_uca_questions(spark):
    found = values(spark, S.uca_question("x"), ["not_provided", "Providing Incorrectly", "wrong_timing", "wrong_duration", "other"])
    assert found == ["What control is missing?", "What assumption is wrong?", "What feedback is delayed?", "What enforcement is bypassed?", ""]


@pytest.mark.parametrize(
    "installed, available, newer",
    [("3.1.4", "3.2.0", True), ("5.0.0", "4.99.99", False), ("2.7.1", "2.7.1", False), ("2.7.1+x", "2.7.1+y", False), ("1.9.9", "1.10.0", True), ("4.0.7", "4.0.12", True), ("edge", "1.2.3", True), ("edge", "edge", False), ("8.1", "8.1.0", True), ("8.1.0.2", "8.1.0", True), ("6.x.1", "6.x.1+k", False)],
)
def test_semver_newer(spark, installed, available, newer):
    assert values(spark, S.semver_newer("x", "y"), [(installed, available)]) == [newer]


def test_narrative(spark):
    (found, none, empty, tail) = values(spark, S.parse_narrative("x"), [TEXT, "no markers", "", "**Causal Factors:**\n- a\n**Loss Scenario:** b"])
    assert found.uca_type == "not_provided" and found.loss_scenario == "data is lost" and found.causal_factors == ["one", "two"] and found.clean_narrative == "Intro"
    assert none is None and empty is None
    # A marker behind the header: the tail is kept, without the marker's line.
    assert tail.loss_scenario == "b" and tail.causal_factors == ["a"] and "- a" in tail.clean_narrative


def test_labels(spark):
    assert values(spark, S.label_or_content("x", "y", 10), [("", "a long content"), ("title", "z")]) == ["a long ...", "title"]
    assert values(spark, S.occurrence_suffix(F.lit(3), "x", "y"), [("wide", ""), ("", "")]) == [" (seen 3x, blast: wide)", " (seen 3x)"]
    assert values(spark, S.occurrence_suffix(F.lit(3), "x", "y"), [("wide", "2h")]) == [" (seen 3x, blast: wide, MTTR: 2h)"] and values(spark, S.occurrence_suffix(F.lit(0), "x", F.lit("")), ["wide"]) == [""]
    assert values(spark, S.effectiveness_suffix(F.col("x").cast("int"), F.lit(0.8)), ["4", "0"]) == [" (effectiveness: 80%, applied: 4)", ""]
    assert values(spark, S.mitigation_label("x", F.lit("n"), "y", F.lit("e")), [("RC-1", "p"), ("", "p"), ("", "")]) == ["RC-1: n", "p", "e"]
