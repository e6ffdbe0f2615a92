"""Editors and plugin installs: static registry, installs by key, what can be updated."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.functions import scalars as S
from faultline.operators.graph import delete, upsert


# Name, display name, binary and tier of each supported editor.
EDITORS = [
    ("claude", "Claude Code", "claude", 1),
    ("codex", "OpenAI Codex", "codex", 2),
    ("gemini", "Google Gemini CLI", "gemini", 2),
    ("cursor", "Cursor", "cursor", 2),
    ("windsurf", "Windsurf", "windsurf", 2),
    ("copilot", "GitHub Copilot", "copilot", 2),
    ("augment", "Augment Code", "auggie", 2),
    ("cline", "Cline", "cline", 3),
    ("roo", "Roo Code", "roo", 3),
    ("openhands", "OpenHands", "openhands", 3),
    ("goose", "Goose", "goose", 3),
    ("warp", "Warp", "warp", 3),
    ("continue", "Continue", "continue", 3),
    ("amp", "Amp", "amp", 3),
    ("kilo", "Kilo Code", "kilo", 3),
    ("opencode", "OpenCode", "opencode", 3),
    ("trae", "Trae", "trae", 3),
    ("junie", "Junie", "junie", 3),
    ("qwen-code", "Qwen Code", "qwen", 3),
    ("antigravity", "Antigravity", "antigravity", 3),
    ("firebender", "Firebender", "firebender", 3),
    ("kiro", "Kiro", "kiro", 3),
]


def registry(spark: SparkSession, editors: list[tuple[str, str, str, int]] = EDITORS) -> DataFrame:
    """A table of (name, display_name, binary, tier)."""
    return spark.createDataFrame(editors, "name string, display_name string, binary string, tier int")


def by_tier(editors: DataFrame) -> DataFrame:
    """Names joined in order: tiers 1 and 2 together, tier 3."""
    return editors.groupBy((F.col("tier") <= 2).alias("full_support")).agg(F.array_join(F.array_sort(F.collect_list("name")), ", ").alias("names"), F.count(F.lit(1)).alias("n"))


def record_install(installs: DataFrame, new: DataFrame) -> DataFrame:
    """Installs by editor: updated in place, else added."""
    return upsert(installs, new, ["editor"])


def remove_install(installs: DataFrame, editor: str) -> DataFrame:
    return delete(installs, "editor", editor)


def install_state(detected: DataFrame, installs: DataFrame, available: str) -> DataFrame:
    """Detected editors with the version installed and whether ``available`` is newer."""
    state = detected.select("editor").join(installs.select("editor", "version"), "editor", "left")
    outcome = F.when(F.col("version").isNull(), "new").when(S.semver_newer("version", F.lit(available)), "update").otherwise("current")
    return state.withColumn("outcome", outcome)
