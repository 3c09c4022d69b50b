"""Transcript lines to events: one projection for each provider, without UDFs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracelake.functions import ids, json, paths
from tracelake.functions.time import trimmed
from tracelake.operators.attribution import attribute
from tracelake.schema import EVENT, EVENT_KEY_VERSION, SCHEMA_VERSION, SOURCE, STATE

_FIELDS = "event_type string, actor string, content string, model string, effort string, usage struct<input:long,output:long,cache_creation:long,cache_read:long>, message_id string, request_id string"


def _event(kind: Column | str, actor: Column | None = None, content: Column | None = None, model: Column | None = None, effort: Column | None = None, usage: Column | None = None, message_id: Column | None = None, request_id: Column | None = None) -> Column:
    none = F.lit(None)
    pick = lambda x, y: none if x is None else x
    fields = (F.lit(kind) if isinstance(kind, str) else kind, pick(actor, 0), pick(content, 0), pick(model, 0), pick(effort, 0), pick(usage, 0), pick(message_id, 0), pick(request_id, 0))
    names = [f.split()[0] for f in _FIELDS.replace("struct<input:long,output:long,cache_creation:long,cache_read:long>", "u").split(", ")]
    return F.struct(*(f.alias(n) for f, n in zip(fields, names, strict=True))).cast(f"struct<{_FIELDS.replace(' ', ':').replace(',:', ',')}>")


def _some(text: Column) -> Column:
    return json.let(text, lambda t: F.when(t.rlike(r"\S"), t))


def read_lines(lines: DataFrame) -> DataFrame:
    """Non-blank ``lines`` with v, the line as a variant: null where it isn't JSON."""
    json.allow_repeated_keys(lines.sparkSession)
    own = lines.withColumn("line", trimmed(F.col("line"))).where("line <> ''")
    return own.withColumn("v", json.parse(F.col("line")))  # the one judge of what is JSON


def skipped(lines: DataFrame) -> DataFrame:
    """Lines and bad lines of each source."""
    return read_lines(lines).groupBy(*SOURCE).agg(F.count("*").alias("lines"), F.count_if(F.col("v").isNull()).alias("skipped"))


def unpoisoned(lines: DataFrame) -> DataFrame:
    """Lines of sources without a bad line: a read that goes on from a cursor takes all of a source or nothing."""
    return lines.join(skipped(lines).where("skipped = 0").select(*SOURCE), SOURCE, "left_semi")


def claude(lines: DataFrame) -> DataFrame:
    """Up to three events a line: thinking, message, usage. isMeta hides the first two."""
    v = F.col("v")
    meta, blocks, thinking, said = (F.col(f"_{c}") for c in ("meta", "blocks", "thinking", "said"))
    first = {"_meta": F.coalesce(json.boolean(v, "$.isMeta"), F.lit(False)), "_blocks": json.items(v, "$.message.content"), "_said": _some(json.text(json.at(v, "$.message.content")))}
    thoughts = F.filter(F.transform(F.filter(blocks, lambda b: json.string(b, "$.type") == "thinking"), lambda b: json.string(b, "$.thinking")), lambda t: t.isNotNull() & t.rlike(r"\S"))
    second = {"_thinking": _some(F.array_join(thoughts, "\n"))}
    role = F.coalesce(json.string(v, "$.message.role"), F.lit("unknown"))
    tool = (role == "user") & (F.size(blocks) > 0) & F.forall(blocks, lambda b: F.coalesce(json.string(b, "$.type") == "tool_result", F.lit(False)))
    role = F.when(F.coalesce(tool, F.lit(False)), "tool").otherwise(role)
    model = json.string(v, "$.message.model")
    usage = F.struct(*(json.count(v, f"$.message.usage.{f}").alias(n) for f, n in (("input_tokens", "input"), ("output_tokens", "output"), ("cache_creation_input_tokens", "cache_creation"), ("cache_read_input_tokens", "cache_read"))))
    used = (json.string(v, "$.type") == "assistant") & json.at(v, "$.message.usage").isNotNull()
    effort = json.string(v, "$.effort")
    events = F.array_compact(
        F.array(
            F.when(~meta & thinking.isNotNull(), _event("thinking", F.lit("assistant"), thinking)),
            F.when(~meta & said.isNotNull(), _event("message", ids.actor(role), said, model)),
            F.when(used, _event("usage", F.lit("assistant"), None, model, F.when(effort != "", effort), usage, json.string(v, "$.message.id"), json.string(v, "$.requestId"))),
        )
    )
    session = F.coalesce(json.string(v, "$.sessionId"), json.string(v, "$.session_id"), paths.file_stem(F.col("source_path")))
    own = read_lines(lines).where("v is not null").withColumns(first).withColumns(second)
    own = own.select(*SOURCE, "byte_start", "line", session.alias("source_session_id"), json.string(v, "$.cwd").alias("cwd"), json.string(v, "$.timestamp").alias("occurred_at"), events.alias("events"))
    return own.select("*", F.posexplode("events").alias("slot", "e")).drop("events")


def carry_forward(rows: DataFrame, *, file: list[str], order: str, session: str, columns: list[str], start: Column | None = None) -> DataFrame:
    """``rows`` with a segment number and each of ``columns`` carried forward within it.

    A segment ends where a non-null ``session`` differs from the one before it in the file, the first being
    compared with ``start``.
    """
    line = W.partitionBy(*file).orderBy(order)
    before = F.last(session, True).over(line.rowsBetween(W.unboundedPreceding, -1))
    if start is not None:
        before = F.coalesce(before, start)
    change = F.coalesce(F.col(session).isNotNull() & ~F.col(session).eqNullSafe(before), F.lit(False))
    rows = rows.withColumn("_change", change.cast("int"))
    rows = rows.withColumn("segment", F.sum("_change").over(line.rowsBetween(W.unboundedPreceding, 0))).drop("_change")
    inside = W.partitionBy(*file, "segment").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumns({c: F.last(c, True).over(inside) for c in columns})


def cumulative_to_delta(rows: DataFrame, *, file: list[str], order: str, totals: list[str]) -> DataFrame:
    """``rows`` with delta_<c> for each running total c: what it grew by since the last one in the segment.

    A total below the one before gives 0, and is what the next is compared with.
    """
    before = W.partitionBy(*file, "segment").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return rows.withColumns({f"delta_{c}": F.greatest(F.col(c) - F.coalesce(F.last(c, True).over(before), F.lit(0)), F.lit(0)) for c in totals})


_TOTALS = ["total_input", "total_cached", "total_output"]
_CARRIED = ["session", "model", "effort", "cwd"]


def _codex_rows(lines: DataFrame, state: DataFrame | None) -> DataFrame:
    """Lines with what they say and what is carried to them. A state is a row before its file's lines."""
    v = F.col("v")
    p = lambda path: f"$.payload.{path}"
    kind, inner = json.string(v, "$.type"), json.string(v, p("type"))
    meta, turn = F.coalesce(kind == "session_meta", F.lit(False)), F.coalesce(kind == "turn_context", F.lit(False))
    own = read_lines(lines).where("v is not null")
    number = lambda block: [json.count(v, p(f"info.{block}.{f}")) for f in ("input_tokens", "cached_input_tokens", "output_tokens")]
    counted = F.coalesce((kind == "event_msg") & (inner == "token_count"), F.lit(False))
    total, last = json.at(v, p("info.total_token_usage")).isNotNull() & counted, json.at(v, p("info.last_token_usage")).isNotNull() & counted
    said = {
        "session": F.when(meta, json.string(v, p("id"))),
        "model": F.when(turn, F.coalesce(json.string(v, p("model")), json.string(v, p("model_slug")))),
        "effort": F.when(turn, F.coalesce(json.string(v, p("effort")), json.string(v, p("collaboration_mode.reasoning_effort")))),
        "cwd": F.when(meta | turn, json.string(v, p("cwd"))),
        "kind": kind, "inner": inner, "counted": counted, "last": last,
        **{c: F.when(total, x) for c, x in zip(_TOTALS, number("total_token_usage"), strict=True)},
        **{f"last_{n}": F.when(last, c) for n, c in zip(("input", "cached", "output"), number("last_token_usage"), strict=True)},
    }
    own = own.withColumns(said)
    if state is not None:
        known = state.join(lines.select(*SOURCE).distinct(), SOURCE, "left_semi")
        before = {"byte_start": F.lit(-1).cast("long"), "counted": F.lit(False), "last": F.lit(False)}
        own = own.unionByName(known.select(*SOURCE, *_CARRIED, *_TOTALS).withColumns(before), allowMissingColumns=True)
    own = own.withColumn("stem", paths.file_stem(F.col("source_path")))
    return carry_forward(own, file=SOURCE, order="byte_start", session="session", columns=_CARRIED, start=F.col("stem"))


def end_state(lines: DataFrame, ends: DataFrame, state: DataFrame, made: DataFrame) -> DataFrame:
    """The parsers' state (schema STATE) after ``lines``, for each source of ``ends`` (source key, end_byte).

    lines have to follow ``state`` without a gap. made: the events that :func:`events` gave for them.
    """
    rows = _codex_rows(lines.where("source_type = 'codex'"), state)
    inside = W.partitionBy(*SOURCE, "segment").orderBy("byte_start").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumns({c: F.last(c, True).over(inside) for c in _TOTALS})
    carried = rows.groupBy(*SOURCE).agg(F.max_by(F.struct(*_CARRIED, *_TOTALS), "byte_start").alias("_c"))
    seq = made.groupBy(*SOURCE).agg((F.max("seq") + 1).alias("_seq"))
    own = ends.select(*SOURCE, "end_byte").join(carried, SOURCE, "left").join(seq, SOURCE, "left").join(state.select(*SOURCE, "next_seq"), SOURCE, "left")
    own = own.withColumn("next_seq", F.coalesce("_seq", "next_seq", F.lit(0)))
    full = {c: F.col(f"_c.{c}") for c in (*_CARRIED, *_TOTALS)}
    return own.select(*((full.get(f.name, F.col(f.name))).cast(f.dataType).alias(f.name) for f in STATE))


def codex(lines: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """Events of response items and token counts; meta lines only carry state."""
    v = F.col("v")
    p = lambda path: f"$.payload.{path}"
    own = cumulative_to_delta(_codex_rows(lines, state), file=SOURCE, order="byte_start", totals=_TOTALS)
    got = lambda n: F.when(F.col("last"), F.col(f"last_{n}")).otherwise(F.col(f"delta_total_{n}"))
    cached = F.least(got("cached"), got("input"))
    usage = F.struct((got("input") - cached).alias("input"), got("output").alias("output"), F.lit(0).cast("long").alias("cache_creation"), cached.alias("cache_read"))
    grew = F.coalesce((got("input") + got("cached") + got("output")) > 0, F.lit(False))
    summary = F.transform(json.items(v, p("summary")), lambda s: json.string(s, "$.text"))
    texts = {"_thought": _some(F.array_join(F.filter(summary, lambda t: t.isNotNull() & t.rlike(r"\S")), "\n")), "_said": _some(json.text(json.at(v, p("content")))), "_out": _some(json.string(v, p("output")))}
    thought, said, out = (F.col(c) for c in texts)
    model, effort = F.col("model"), F.col("effort")
    item = F.col("kind") == "response_item"
    event = (
        F.when(item & (F.col("inner") == "reasoning"), _event("thinking", F.lit("assistant"), thought, model, effort))
        .when(item & (F.col("inner") == "message") & said.isNotNull(), _event("message", ids.actor(json.string(v, p("role"))), said, model, effort))
        .when(item & (F.col("inner") == "function_call"), _event("tool_use", F.lit("assistant"), F.concat(F.lit("[Tool: "), F.coalesce(json.string(v, p("name")), F.lit("unknown")), F.lit("]")), model, effort))
        .when(item & (F.col("inner") == "function_call_output") & out.isNotNull(), _event("tool_result", F.lit("tool"), out, model, effort))
        .when(F.col("counted") & grew, _event("usage", F.lit("assistant"), None, model, effort, usage))
    )
    own = own.withColumns(texts).withColumn("e", event).where("e is not null")
    return own.select(*SOURCE, "byte_start", "line", F.coalesce("session", "stem").alias("source_session_id"), "cwd", json.string(v, "$.timestamp").alias("occurred_at"), F.lit(0).alias("slot"), "e")


def events(lines: DataFrame, registry: DataFrame, *, profile: str = "full", host: str = "unix", default_distro: str | None = None, state: DataFrame | None = None, mounts: paths.Mounts | None = None, stage: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The fixed event schema from lines of all providers; unknown providers give none.

    state (schema STATE): where earlier lines of the same files left off. seq is dense in each file and goes on
    from it. The metadata profile drops contents only. stage: writes parsed rows down and reads them again, as
    attribution needs them twice; without it lines are parsed twice.
    """
    both = claude(lines.where("source_type = 'claude_code'")).unionByName(codex(lines.where("source_type = 'codex'"), state))
    line = W.partitionBy(*SOURCE).orderBy("byte_start", "slot")
    both = both.withColumn("seq", (F.row_number().over(line) - 1).cast("long"))
    if state is not None:
        both = both.join(state.select(*SOURCE, "next_seq"), SOURCE, "left").withColumn("seq", F.col("seq") + F.coalesce("next_seq", F.lit(0)))
    slot = F.row_number().over(W.partitionBy(*SOURCE, "byte_start", "e.event_type").orderBy("slot")) - 1
    both = both.withColumn("ordinal", slot)
    # a blank directory differs from an absent one
    both = both.withColumn("_where", F.when(F.col("cwd").isNotNull(), F.coalesce(paths.normalize_cwd(F.col("cwd"), host=host, default_distro=default_distro), F.lit(""))))
    both = attribute(both if stage is None else stage(both), registry, path_col="_where", mounts=mounts)
    full = {f.name: F.lit(None).cast(f.dataType) for f in EVENT} | {
        "schema_version": F.lit(SCHEMA_VERSION),
        **{c: F.col(c) for c in (*SOURCE, "source_session_id", "seq", "cwd", "project_root", "project_root_source", "occurred_at")},
        "event_key": F.struct(F.lit(EVENT_KEY_VERSION).alias("version"), ids.record_fingerprint(F.col("line")).alias("record_fingerprint"), F.col("ordinal").alias("slot_ordinal")),
        "source_mode": F.lit("append_log"),
        "workspace_location": paths.workspace_location(F.col("project_root"), F.col("source_location"), host=host),
        "time_confidence": F.when(F.col("occurred_at").isNotNull(), "high").otherwise("low"),
        **{c: F.col(f"e.{c}") for c in ("event_type", "actor", "model", "effort", "usage", "message_id", "request_id")},
        "content": F.col("e.content") if profile == "full" else F.lit(None).cast("string"),
    }
    return both.select(*(full[f.name].cast(f.dataType).alias(f.name) for f in EVENT))
