"""Which files agents write, and where."""

from __future__ import annotations

import os
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

#: Source type, variable that overrides the folder, folder below home.
PROVIDERS = [("claude_code", "CLAUDE_CONFIG_DIR", ".claude"), ("codex", "CODEX_HOME", ".codex")]
#: Source type, subfolder, glob, mode, status, recursive.
ARTIFACTS = [
    ("claude_code", "projects", "**/*.jsonl", "append_log", "stable", True),
    ("claude_code", "sessions", "**/*.jsonl", "append_log", "stable", True),
    ("claude_code", "projects", "**/memory/*.md", "snapshot_file", "experimental", True),
    ("codex", "sessions", "**/*.jsonl", "append_log", "stable", True),
    ("codex", "archived_sessions", "**/*.jsonl", "append_log", "experimental", True),
    ("codex", "memories", "*.md", "snapshot_file", "experimental", False),
    ("codex", "memories/rollout_summaries", "*.md", "snapshot_file", "experimental", False),
    ("codex", "memories/extensions/ad_hoc/notes", "*.md", "snapshot_file", "experimental", False),
    ("codex", "rules", "*.rules", "snapshot_file", "experimental", False),
]
#: Snapshots below a project root.
PROJECT_FILES = [("claude_code", "CLAUDE.md"), ("claude_code", ".claude/CLAUDE.md"), ("codex", "AGENTS.md")]


def config_dirs(environ: Mapping[str, str] | None = None, home: str | None = None) -> dict[str, str]:
    """Each provider's folder; a blank override is none."""
    env = os.environ if environ is None else environ
    base = home if home is not None else env.get("HOME", "")
    return {kind: (env.get(var) or "").strip() or f"{base}/{below}" for kind, var, below in PROVIDERS}


def catalog(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ARTIFACTS, "source_type string, subdir string, glob string, source_mode string, status string, recursive boolean")
