"""Column functions: ladders, badges, text shaping, parsers. All run in the JVM; none is a Python UDF.

Lengths are in characters. Patterns start with (?d), so a dot stops only at a line feed.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, then) -> Column:
    """``then`` of a value that is computed once a row."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _ladder(x: Column, steps: list[tuple[int, str]], last: str) -> Column:
    out = F.lit(last)
    for least, name in reversed(steps):
        out = F.when(x >= least, name).otherwise(out)
    return out


def priority(score: Column | str) -> Column:
    """Priority of a score on the 0-100 scale; a null score is LOW."""
    return _ladder(_c(score), [(80, "CRITICAL"), (60, "HIGH"), (40, "MEDIUM")], "LOW")


def priority_25(score: Column | str) -> Column:
    """Priority on the 0-25 scale, which no list uses."""
    return _ladder(_c(score), [(20, "CRITICAL"), (15, "HIGH"), (10, "MEDIUM")], "LOW")


def weight_tier(weight: Column | str) -> Column:
    return _ladder(_c(weight), [(9, "Critical"), (7, "Required"), (5, "Important"), (3, "Recommended")], "Advisory")


def badge(value: Column | str) -> Column:
    """Status, control type or entity type in brackets and capitals."""
    return F.concat(F.lit("["), F.upper(_c(value)), F.lit("]"))


def validation_badge(value: Column | str) -> Column:
    v = _c(value)
    return F.concat(F.lit("["), F.when(v == "analyst_validated", "VALIDATED").when(v == "auto_extracted", "AUTO").otherwise(F.upper(v)), F.lit("]"))


def evidence_badge(value: Column | str) -> Column:
    v = _c(value)
    return F.concat(F.lit("["), F.when(v == "not_configured", "NOT CONFIGURED").otherwise(F.upper(v)), F.lit("]"))


def discovery_badge(value: Column | str) -> Column:
    v = _c(value)
    return F.when(v == "semantic", "[SEM]").when(v == "graph", "[GRAPH]").when(v == "both", "[SEM+GRAPH]").otherwise("")


def direction_arrow(value: Column | str) -> Column:
    return F.when(_c(value) == "bidirectional", "<->").otherwise("->")


def _capitalised(words: Column) -> Column:
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))), " ")


def title_case(value: Column | str) -> Column:
    """Words between underscores with a capital first letter, the rest as it is; a doubled underscore leaves two spaces."""
    return _capitalised(F.split(_c(value), "_"))


def uca_title_case(value: Column | str) -> Column:
    return _capitalised(F.split(F.replace(_c(value), F.lit("_"), F.lit(" ")), " "))


# The guide question of each kind of unsafe control action.
UCA_QUESTIONS = {
    "not_provided": "What control is missing?",
    "providing_incorrectly": "What assumption is wrong?",
    "wrong_timing": "What feedback is delayed?",
    "wrong_duration": "What enforcement is bypassed?",
}


def uca_question(value: Column | str) -> Column:
    key, out = F.replace(F.lower(_c(value)), F.lit(" "), F.lit("_")), F.lit("")
    for k, q in UCA_QUESTIONS.items():
        out = F.when(key == k, q).otherwise(out)
    return out


def truncate(value: Column | str, limit: int) -> Column:
    """One line of at most ``limit`` characters, three of them dots where it is cut."""
    v = F.replace(_c(value), F.lit("\n"), F.lit(" "))
    cut = F.substring(v, 1, limit) if limit < 3 else F.concat(F.substring(v, 1, limit - 3), F.lit("..."))
    return F.when(F.length(v) <= limit, v).otherwise(cut)


def cut(value: Column | str, threshold: int, keep: int, dots: str = "...") -> Column:
    """Texts longer than ``threshold`` cut to ``keep`` characters and dots."""
    v = _c(value)
    return F.when(F.length(v) > threshold, F.concat(F.substring(v, 1, keep), F.lit(dots))).otherwise(v)


def short_id(value: Column | str, dots: str = "") -> Column:
    v = _c(value).cast("string")
    return F.when(F.length(v) > 8, F.concat(F.substring(v, 1, 8), F.lit(dots))).otherwise(v)


def trim_space(value: Column | str) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(_c(value), r"^\s+|\s+$", "")


def wrap(value: Column | str, width: int, indent: str = "") -> Column:
    """Greedy word wrap; long words are not split, white space is collapsed."""
    room = width - len(indent)
    words = F.filter(F.split(_c(value), r"\s+"), lambda w: w != "")
    start = F.struct(F.lit("").alias("done"), F.lit("").alias("line"))

    def add(a, w):
        fits = F.length(a["line"]) + 1 + F.length(w) <= room
        first = a["line"] == ""
        return F.struct(
            F.when(first | fits, a["done"]).otherwise(F.concat(a["done"], a["line"], F.lit("\n" + indent))).alias("done"),
            F.when(first, w).when(fits, F.concat(a["line"], F.lit(" "), w)).otherwise(w).alias("line"),
        )

    return F.aggregate(words, start, add, lambda a: F.concat(a["done"], a["line"]))


def _without_first(text: Column, part: Column) -> Column:
    at = F.position(part, text)
    return F.when((part == "") | (at == 0), text).otherwise(F.concat(F.substr(text, F.lit(1), at - 1), F.substr(text, at + F.length(part))))


UCA_MARK, LOSS_MARK, FACTORS_MARK = "**Unsafe Control Action:**", "**Loss Scenario:**", "**Causal Factors:**"


def parse_narrative(value: Column | str) -> Column:
    """Struct of uca_type, loss_scenario, causal_factors and clean_narrative; null if no marker says anything.

    Factors are the lines that start with a dash after the header, to the end of the text. The clean narrative lacks the
    markers' lines and all from the header on, unless another marker stands behind the header; then that tail stays.
    """
    n = _c(value)

    def marker(mark: str) -> str:
        return r"(?d)\*\*" + mark.strip("*") + r"\*\*\s*(.+)"

    uca_all, loss_all = (F.regexp_extract(n, marker(m), 0) for m in (UCA_MARK, LOSS_MARK))
    uca, loss = (trim_space(F.regexp_extract(n, marker(m), 1)) for m in (UCA_MARK, LOSS_MARK))
    at = F.position(F.lit(FACTORS_MARK), n)
    tail = F.when(at > 0, F.substr(n, at)).otherwise("")
    block = F.when(at > 0, F.substr(n, at + len(FACTORS_MARK))).otherwise("")
    factors = F.transform(F.filter(F.transform(F.split(block, "\n"), trim_space), lambda x: x.startswith("- ")), lambda x: F.substr(x, F.lit(3)))
    clean = let(_without_first(n, uca_all), lambda a: let(_without_first(a, loss_all), lambda b: trim_space(_without_first(b, tail))))
    found = (uca != "") | (loss != "") | (F.size(factors) > 0)
    return F.when(found, F.struct(uca.alias("uca_type"), loss.alias("loss_scenario"), factors.alias("causal_factors"), clean.alias("clean_narrative")))


def emergency_note(value: Column | str) -> Column:
    """Text of the first [emergency: ...] tag, case-sensitive; null without one."""
    note = F.regexp_extract(_c(value), r"\[emergency:\s*([^\]]+)\]", 1)
    return F.when(_c(value).rlike(r"\[emergency:\s*[^\]]+\]"), trim_space(note))


def delay(seconds: Column | str) -> Column:
    """Seconds as whole seconds, minutes or hours."""
    s = _c(seconds).cast("long")
    return F.when(s < 60, F.concat(s.cast("string"), F.lit("s"))).when(s < 3600, F.concat(F.floor(s / 60).cast("string"), F.lit("m"))).otherwise(F.concat(F.floor(s / 3600).cast("string"), F.lit("h")))


def percent(fraction: Column | str) -> Column:
    """Whole per cents, halves to the even one."""
    return F.format_string("%.0f%%", F.rint(_c(fraction).cast("double") * 100))


def digits_int(value: Column | str) -> Column:
    """Digits alone as a number of 64 bits; anything else, and nothing, as 0."""
    v = _c(value)
    return F.coalesce(F.when(v.rlike("^[0-9]+$"), v.try_cast("long")), F.lit(0).cast("long"))


def prefix_int(value: Column | str, default: int) -> Column:
    """A leading number, whatever follows it; else ``default``."""
    return F.coalesce(F.regexp_extract(_c(value), r"^\s*([+-]?\d+)", 1).try_cast("int"), F.lit(default))


def same_text(a: Column | str, b: Column | str) -> Column:
    return F.lower(_c(a)) == F.lower(_c(b))


def repository_name(remote: Column | str, directory: Column | str) -> Column:
    """Name of a remote URL, of either style; the directory's name where there is none."""
    path = F.regexp_replace(trim_space(F.coalesce(_c(remote), F.lit(""))), r"\.git$", "")
    name = F.element_at(F.split(F.element_at(F.split(path, "/"), -1), ":"), -1)
    return F.when(name != "", name).otherwise(F.element_at(F.split(_c(directory), "/"), -1))


def last_ref_segment(ref: Column | str) -> Column:
    parts = F.split(_c(ref), "/", 3)
    return F.when(F.size(parts) > 2, F.element_at(F.split(_c(ref), "/"), -1)).otherwise(_c(ref))


def semver_base(version: Column | str) -> Column:
    return F.substring_index(_c(version), "+", 1)


def _semver(version: Column) -> Column:
    parts = F.split(version, r"\.", 3)
    numbers = F.transform(parts, lambda p: p.try_cast("long"))
    return F.when((F.size(parts) == 3) & ~F.exists(F.zip_with(parts, numbers, lambda p, x: x.isNull() | ~p.rlike("^[+-]?[0-9]+$")), lambda bad: bad), numbers)


def semver_newer(installed: Column | str, available: Column | str) -> Column:
    """Whether ``available`` is the newer version; of versions that are not numbers, whether the bases differ."""
    a, b = semver_base(installed), semver_base(available)
    x, y = _semver(a), _semver(b)
    return F.when(x.isNull() | y.isNull(), a != b).otherwise(y > x)


def masked(secret: Column | str, longer_than: int = 8, head: int = 4) -> Column:
    """First and last characters of a key; short keys are hidden whole."""
    s = _c(secret)
    return F.when(F.length(s) > longer_than, F.concat(F.substring(s, 1, head), F.lit("..."), F.right(s, F.lit(4)))).otherwise("****")


# Fixed values.
CRITICALITY = {"hobby": 0.0, "internal": 0.25, "customer-facing": 0.6, "critical": 1.0}


def criticality(label: Column | str) -> Column:
    out = F.lit(0.0)
    for name, value in CRITICALITY.items():
        out = F.when(_c(label) == name, F.lit(value)).otherwise(out)
    return out


def content_hash(value: Column | str) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(_c(value), 256))


def label_or_content(title: Column | str, content: Column | str, limit: int = 80) -> Column:
    return F.when(F.coalesce(_c(title), F.lit("")) != "", _c(title)).otherwise(truncate(content, limit))


def occurrence_suffix(count: Column | str, blast_radius: Column | str, mttr: Column | str) -> Column:
    """Count, blast radius and repair time of a pattern, each only where there is one."""

    def part(prefix, x):
        x = _c(x).cast("string")
        return F.when(F.coalesce(x, F.lit("")) != "", F.concat(F.lit(prefix), x))

    n = _c(count)
    return F.when(n > 0, F.concat(F.lit(" ("), F.concat_ws(", ", F.concat(F.lit("seen "), n.cast("string"), F.lit("x")), part("blast: ", blast_radius), part("MTTR: ", mttr)), F.lit(")"))).otherwise("")


def effectiveness_suffix(applied: Column | str, score: Column | str) -> Column:
    n = _c(applied)
    return F.when(n > 0, F.concat(F.lit(" (effectiveness: "), percent(score), F.lit(", applied: "), n.cast("string"), F.lit(")"))).otherwise("")


def mitigation_label(control_code, control_name, procedure_title, entity_label) -> Column:
    """Control with its name, else the procedure, else the entity."""
    code, procedure = F.coalesce(_c(control_code), F.lit("")), F.coalesce(_c(procedure_title), F.lit(""))
    return F.when(code != "", F.concat(code, F.lit(": "), F.coalesce(_c(control_name), F.lit("")))).when(procedure != "", procedure).otherwise(_c(entity_label))


def first_prose_line(content: Column | str, limit: int = 80) -> Column:
    """First line that is neither blank nor a heading."""
    lines = F.filter(F.transform(F.split(_c(content), "\n"), trim_space), lambda x: (x != "") & ~x.startswith("#"))
    return F.coalesce(truncate(F.get(lines, F.lit(0)), limit), F.lit(""))


def front_matter_description(content: Column | str, limit: int = 80) -> Column:
    """The description key of a front matter, else the first line of prose."""
    v = _c(content)
    key = trim_space(F.regexp_extract(v, r"(?dm)\A---\n(?:(?!---$).*\n)*?description:[ \t]*(.*)$", 1))
    key = F.regexp_replace(key, r"^[\"']|[\"']$", "")
    return F.when(key != "", truncate(key, limit)).otherwise(first_prose_line(v, limit))


def finding_tag(action: Column | str) -> Column:
    return F.when(_c(action) == "created", "NEW").when(_c(action) == "updated", "UPD").otherwise("---")


def inside(path: Column | str, root: str) -> Column:
    """Whether a path stays under ``root`` (a guard for archive members)."""
    return _c(path).startswith(root.rstrip("/") + "/") & ~_c(path).rlike(r"(^|/)\.\.(/|$)")
