"""One pass over all transcripts: look, observe, plan, commit, and only then move the cursors.

Looks are file stats on the driver. What costs reading (fingerprints and bad lines) is done by tasks, a file
each. All sources that the plan lets through are committed together; cursors move only after that. A file that
only grew is parsed from where the last commit left off, with the parsers' state of then.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.functions.ids import projection_token
from tracelake.operators.parse import end_state, skipped
from tracelake.operators.parse import events as parse_events
from tracelake.operators.store import Store
from tracelake.plans.commit_plan import plan, should_record
from tracelake.schema import LINE, PARSER_REVISION, SOURCE, STATE
from tracelake.sources.growing_log import GrowingLog, load_cursors, prefix_hash, save_cursors, scan

_LOOK = "source_type string, source_location string, source_path string, quality string, failed_at string, full_reason boolean, stale boolean, rolled boolean, start long, end long, known_end long, known string"


def profile_of(asked: str | None, writing: bool) -> str:
    """full or metadata. Writing needs full: events without contents would keep the full ones out later."""
    if writing and asked == "metadata":
        raise ValueError("a store is written with full events only")
    return asked or ("full" if writing else "metadata")


def _look(source: dict, state: dict | None, attribution: int, force: bool) -> tuple[dict, dict | None]:
    stale = state is not None and (state["parser"], state["attribution"]) != (PARSER_REVISION, attribution)
    full = state is None or stale or force
    s = scan(source["source_path"], None if full else state["cursor"])
    rolled = s["change"] == "rollback" or bool(full and state and s["cursor"] and s["cursor"]["size"] < state["cursor"]["safe_offset"])
    quality = "unavailable" if s["change"] == "unavailable" else "unchanged" if s["change"] == "none" and not stale else "clean"
    row = {c: source[c] for c in SOURCE} | {"quality": quality, "failed_at": "stat" if quality == "unavailable" else None, "full_reason": state is None or force, "stale": stale, "rolled": rolled, "start": s.get("start", 0), "end": s.get("end", 0), "known_end": state["cursor"]["safe_offset"] if state else None, "known": state["fingerprint"] if state else None}
    return row, s["cursor"]


def observe(looks: DataFrame) -> DataFrame:
    """``looks`` with fingerprint, rewritten, new_lines, bad: what reading the files tells, a file a row.

    Bytes are hashed by a task a file; lines are judged by the parser that will read them.
    """
    schema = "source_path string, fingerprint string, before string, lost boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                try:
                    check = r["known"] is not None and (r["full_reason"] or r["stale"]) and not r["rolled"]
                    before = prefix_hash(r["source_path"], r["known_end"]) if check else r["known"]
                    out.append((r["source_path"], prefix_hash(r["source_path"], r["end"]), before, False))
                except OSError:
                    out.append((r["source_path"], None, None, True))
            cols = list(zip(*out, strict=True)) if out else [()] * 4
            kinds = (pa.string(), pa.string(), pa.string(), pa.bool_())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["source_path", "fingerprint", "before", "lost"])

    found = looks.repartition("source_path").mapInArrow(run, schema)
    hashed = found.sparkSession.createDataFrame(found.collect(), schema)  # a row a file; files aren't hashed twice
    there = looks.join(hashed.where("not lost"), "source_path", "left_semi")
    read = skipped(_lines(looks.sparkSession, there)).select(*SOURCE, F.col("lines").alias("new_lines"), F.col("skipped").alias("bad"))
    own = looks.join(hashed, "source_path").join(read, SOURCE, "left").fillna(0, ["new_lines", "bad"])
    changed = F.col("known").isNotNull() & ~F.col("before").eqNullSafe(F.col("known")) & ~F.col("lost")
    fully = F.col("full_reason") | F.col("stale") | F.col("rolled")
    bad = F.when(F.col("lost"), "unavailable").when((F.col("bad") > 0) & fully, "degraded").when(F.col("bad") > 0, "poison_line").otherwise(F.col("quality"))
    failed = F.when(F.col("lost"), "read").otherwise(F.col("failed_at"))
    return own.withColumns({"rewritten": F.col("rolled") | changed, "quality": bad, "failed_at": F.when(bad == "unavailable", failed)})


def _lines(spark: SparkSession, sources: DataFrame) -> DataFrame:
    """Whole lines of files in [start, end), as seen by the look."""
    import json

    spark.dataSource.register(GrowingLog)
    wanted = sources.select("source_path", "start").distinct().collect()  # a name a changed file
    cursors = {r["source_path"]: {"safe_offset": r["start"], "size": 0, "mtime": 0} for r in wanted if r["start"]}
    read = spark.read.format("growing_log").option("paths", json.dumps([r["source_path"] for r in wanted])).option("cursors", json.dumps(cursors)).load()
    return read.join(sources.select(*SOURCE, "end"), "source_path").where("control is null and byte_start < end").select(*LINE.names)


def _counters(decided: list[dict], cursors: dict) -> dict[str, dict[str, int]]:
    """What was looked at, by provider: sources, errors, lines and bad ones, bytes, bytes of half lines, rollbacks."""
    out: dict[str, dict[str, int]] = {}
    for d in decided:
        cursor = cursors[d["source_path"]] or {"size": d["end"], "safe_offset": d["end"]}
        seen = {"sources": 1, "errors": int(d["plan_quality"] != "clean"), "items_examined": d["new_lines"], "items_skipped": d["bad"], "bytes_read": d["end"] - d["start"], "pending_tail_bytes": cursor["size"] - cursor["safe_offset"], "rollbacks": int(d["rolled"])}
        own = out.setdefault(d["source_type"], dict.fromkeys(seen, 0))
        for k, v in seen.items():
            own[k] += v
    return out


def _commit(store: Store, go: DataFrame, registry: DataFrame, now_ms: int | None, options: dict) -> list:
    """Commit planned sources; statistics, a row each. One that goes on without a fitting state is read from its start."""
    with store.staging() as stage:
        held = store.parser_state().select(*STATE.names).join(go.where("plan_index = 'append_facts' and start > 0").select(*SOURCE, "start"), SOURCE)
        state = stage(held.where("end_byte = start").select(*STATE.names))
        own = go.drop("start").join(state.select(*SOURCE, F.col("end_byte").alias("_from")), SOURCE, "left").withColumn("start", F.coalesce("_from", F.lit(0)))
        lines = stage(_lines(store.spark, own))
        made = parse_events(lines, registry, state=state, stage=stage, **options)
        ends = go.select(*SOURCE, F.col("end").alias("end_byte"))
        return store.apply_projection(go.select(*SOURCE, "reason", "token"), made, state=lambda done: end_state(lines, ends, state, done), now_ms=now_ms).collect()


def scan_all(spark: SparkSession, store: Store, sources: DataFrame, state_path: str | None, *, now_ms: int | None = None, force: bool = False, **options) -> tuple[list[dict], dict, int]:
    """Scan ``sources`` (a listing) and commit; report rows, summary, exit code.

    Exit codes: 0, 2 if the cursors weren't saved, 3 if a commit failed. A held source (unreadable, poison
    line, nothing good left) is no failure: it is looked at again from the same offset. Snapshots are counted
    only; sources of a mode that nothing reads are fine, with a warning. An empty listing commits nothing.
    """
    state, warning = load_cursors(state_path) if state_path else ({}, None)
    registry, revision = store.table("project_root_registry"), store.attribution_revision()
    listed = [r.asDict() for r in sources.collect()]  # a row a file
    logs = [r for r in listed if r["source_mode"] == "append_log"]
    other = [r for r in listed if r["source_mode"] not in ("append_log", "snapshot_file")]
    looks, cursors = [], {}
    for r in logs:
        row, cursors[r["source_path"]] = _look(r, state.get(r["source_path"]), revision, force)
        looks.append(row)
    for row in looks:  # nothing new: only size and time are noted
        if row["quality"] == "unchanged" and row["source_path"] in state:
            state[row["source_path"]]["cursor"] = cursors[row["source_path"]]
    todo = [r for r in looks if r["quality"] != "unchanged" or r["full_reason"]]
    rows = [{"kind": "source_report", "source_path": r["source_path"], "status": "ok", "warnings": [f"source_mode {r['source_mode']} not implemented"]} for r in other]
    summary = {"kind": "summary", "sources": len(listed), "written_events": 0, "write_failures": 0, "held_sources": 0, "snapshot_sources": len(listed) - len(logs) - len(other), "roots_empty": registry.isEmpty(), "providers": {}, "state_warning": warning, "state_saved": None}
    code = 0
    if todo:
        base = spark.createDataFrame([tuple(r.values()) for r in todo], _LOOK)
        seen = observe(base.withColumn("quality", F.when(F.col("quality") == "unchanged", "clean").otherwise(F.col("quality"))))
        seen = spark.createDataFrame(seen.collect(), seen.schema)  # a row a file; files aren't read twice
        worst = seen.where("quality = 'degraded'")
        if worst.isEmpty():
            counted = seen.withColumn("events", F.col("new_lines"))
        else:  # only for these it matters whether anything good is left
            made = parse_events(_lines(spark, worst.withColumn("start", F.lit(0).cast("long"))), registry, **options).groupBy(*SOURCE).agg(F.count("*").alias("_n"))
            counted = seen.join(made, SOURCE, "left").withColumn("events", F.when(F.col("quality") == "degraded", F.coalesce("_n", F.lit(0))).otherwise(F.col("new_lines"))).drop("_n")
        head = store.table("current_head").select(*SOURCE, F.lit(True).alias("_h"))
        planned = plan(counted.join(head, SOURCE, "left").withColumn("prior", F.coalesce("_h", F.lit(False))).drop("_h"))
        token = projection_token(*(F.col(c) for c in (*SOURCE, "fingerprint")), F.lit(PARSER_REVISION), F.lit(revision), F.lit(0), F.col("end"))
        planned = planned.withColumn("recorded", should_record(F.col("quality"), F.col("failed_at")))
        planned = planned.withColumns({"reason": F.col("plan_store"), "token": F.when(F.col("plan_store") != "append", token)})
        decided = [r.asDict() for r in planned.collect()]  # a row a file
        planned = spark.createDataFrame([tuple(d.values()) for d in decided], planned.schema)
        go = planned.where("plan_store <> 'preserve'")
        held = [d for d in decided if d["plan_store"] == "preserve"]
        summary["providers"] = _counters(decided, cursors)
        rows += [{"kind": "store_held", "source_path": d["source_path"], "quality": d["plan_quality"], "recorded": d["recorded"]} for d in held]
        summary["held_sources"] = len(held)
        if len(held) < len(decided):
            try:
                stats = _commit(store, go, registry, now_ms, options)
                quality = {d["source_path"]: d["plan_quality"] for d in decided}
                for s in stats:
                    rows.append({"kind": "store_write", "source_path": s.source_path, "mode": s.reason, "quality": quality[s.source_path], "appended": s.appended, "skipped_dup": s.skipped_dup, "skipped_erased": s.skipped_erased, "head_moved": s.head_moved, "superseded_removed": s.removed} | ({"loses_events": [s.before, s.appended]} if s.loses_events else {}))
                    summary["written_events"] += s.appended
                for d in decided:
                    if d["plan_cursor"] == "advance":
                        state[d["source_path"]] = {"cursor": cursors[d["source_path"]], "fingerprint": d["fingerprint"], "parser": PARSER_REVISION, "attribution": revision}
            except Exception as e:  # the pass goes on to report; cursors stay where they were
                rows += [{"kind": "store_write_failed", "source_path": d["source_path"], "reason": f"{type(e).__name__}: {e}"[:500]} for d in decided if d not in held]
                summary["write_failures"], code = len(decided) - len(held), 3
    if state_path:
        try:
            save_cursors(state_path, state)
            summary["state_saved"] = True
        except OSError:
            summary["state_saved"], code = False, 2
    return rows, summary, code
