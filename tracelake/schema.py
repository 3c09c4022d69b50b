"""The event's fixed schema and the stored tables."""

from __future__ import annotations

from pyspark.sql import types as T

SCHEMA_VERSION, EVENT_KEY_VERSION, PARSER_REVISION = 2, 1, 5
SOURCE = ["source_type", "source_location", "source_path"]
REVISIONS = ["source_revision", "projection_revision"]
#: What shares a data key; without a root the root is empty.
GROUP = [*SOURCE, "project_root"]

#: The names under which kinds are stored.
SOURCE_TYPES = ("claude_code", "codex", "cursor", "gemini", "jsonl")
EVENT_TYPES = ("message", "thinking", "tool_use", "tool_result", "usage", "config_snapshot")

_KINDS = {"int": T.IntegerType, "long": T.LongType, "string": T.StringType}


def _parse(text: str) -> T.StructType:
    """A struct from ``name kind, ...``; kinds may be struct<name:kind,...>. Needs no session."""
    fields, inner = [], None
    for part in text.replace("<", "<,").replace(">", ",>").replace(":", " ").split(","):
        words = part.split()
        if not words:
            continue
        if words[-1] == "struct<":
            inner = (words[0], [])
        elif words[0] == ">":
            fields.append(T.StructField(inner[0], T.StructType(inner[1])))
            inner = None
        else:
            (fields if inner is None else inner[1]).append(T.StructField(words[0], _KINDS[words[1]]()))
    return T.StructType(fields)


EVENT = _parse(
    "schema_version int, source_type string, source_location string, source_path string, source_session_id string, seq long, "
    "event_key struct<version:int,record_fingerprint:string,slot_ordinal:int>, source_mode string, cwd string, project_root string, "
    "project_root_source string, workspace_location string, event_type string, actor string, occurred_at string, time_confidence string, "
    "model string, effort string, usage struct<input:long,output:long,cache_creation:long,cache_read:long>, content string, parent_ref string, "
    "content_hash string, artifact_kind string, observed_at string, message_id string, request_id string"
)
LINE = _parse("source_type string, source_location string, source_path string, byte_start long, line string")
#: What a parser needs to go on in a file at end_byte.
STATE = _parse("source_type string, source_location string, source_path string, end_byte long, next_seq long, session string, model string, effort string, cwd string, total_input long, total_cached long, total_output long")
TABLES = {
    "raw_events": T.StructType([T.StructField("offset", T.LongType()), *EVENT, *_parse("source_revision long, projection_revision long, occurred_at_unix_ms long, ingested_at long, key_id string")]),
    "projections": _parse("source_type string, source_location string, source_path string, source_revision long, projection_revision long, origin string, token string, created_at long, events long"),
    "applied_projections": _parse("token string, source_type string, source_location string, source_path string, source_revision long, projection_revision long, applied_at long"),
    "current_head": _parse("source_type string, source_location string, source_path string, source_revision long, projection_revision long"),
    "projection_log": _parse("seq long, source_type string, source_location string, source_path string, old_source_revision long, old_projection_revision long, new_source_revision long, new_projection_revision long, reason string, changed_at long"),
    "tombstones": _parse("scope string, key string, tombstoned_at long"),
    "project_root_registry": _parse("root_key string, root_path string, root_source string, first_seen_ms long, last_seen_ms long"),
    "project_root_probe": _parse("path string, outcome string, last_probe_ms long"),
    "project_identity": _parse("id long, project_root string, canonical_id string, first_seen_ms long, last_seen_ms long"),
    "project_identity_probe": _parse("project_root string, outcome string, detail string, last_probe_ms long"),
    "data_keys": _parse("key_id string, source_type string, source_location string, source_path string, project_root string, wrapped_key string"),
    "parser_state": T.StructType([*STATE, *_parse("source_revision long, projection_revision long")]),
    "store_meta": _parse("k string, v string"),
}
