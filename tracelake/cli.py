"""Commands over a store: ``python -m tracelake COMMAND``. Rows go to stdout, one JSON object a line."""

from __future__ import annotations

import argparse
import base64
import json
import os
import sys
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.functions.paths import openable
from tracelake.operators import parity, views
from tracelake.operators.parse import events as parse_events
from tracelake.operators.store import Store
from tracelake.plans.deadline import Deadline
from tracelake.plans.scan_all import profile_of, scan_all
from tracelake.schema import EVENT, LINE, SOURCE
from tracelake.sources import discovery, identities, parity_inputs, snapshots
from tracelake.sources.growing_log import GrowingLog

Emit = Callable[[dict], None]


def _session() -> SparkSession:
    return SparkSession.builder.appName("tracelake").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def _each(df: DataFrame, emit: Emit, kind: str, wrap: str | None = None) -> int:
    """Emit ``df``'s rows in its order, a partition at a time."""
    n = 0
    body = F.to_json(F.struct(*df.columns))
    for n, r in enumerate(df.select(body.alias("j")).toLocalIterator(), 1):  # noqa: B007
        own = json.loads(r["j"])
        emit({"kind": kind} | ({wrap: own} if wrap else own))
    return n


def default_store() -> str:
    return os.path.join(os.environ.get("XDG_DATA_HOME") or os.path.expanduser("~/.local/share"), "tracelake", "store")


def _store(a: argparse.Namespace, spark: SparkSession) -> Store:
    """The store, its contents sealed if TRACELAKE_KEY holds 32 bytes in base64."""
    path, key = a.store or default_store(), os.environ.get("TRACELAKE_KEY")
    return Store(spark, path if "://" in path else f"file://{os.path.abspath(path)}", master_key=base64.b64decode(key) if key else None)


def discover(a, spark, emit) -> int:
    df, bad = discovery.discover(spark)
    _each(df.select(*SOURCE, "source_mode"), emit, "source")
    for b in bad:
        emit({"kind": "unreachable", "path": b})
    return 0


def scan(a, spark, emit) -> int:
    profile = profile_of(a.profile, a.write_store)
    listing, bad = discovery.discover(spark)
    if a.write_store:
        rows, summary, code = scan_all(spark, _store(a, spark), listing, None if a.stateless else a.state, force=a.force)
        for r in (*rows, summary | {"unreachable": len(bad)}):
            emit(r)
        return code
    spark.dataSource.register(GrowingLog)
    logs = listing.where("source_mode = 'append_log'").select(*SOURCE)
    paths = [r["source_path"] for r in logs.collect()]  # a name a file
    lines = spark.read.format("growing_log").option("paths", json.dumps(paths)).load().where("line is not null").join(logs, "source_path").select(*LINE.names)
    registry = _store(a, spark).table("project_root_registry")
    n = _each(parse_events(lines, registry, profile=profile).orderBy("source_path", "seq"), emit, "event", "event")
    emit({"kind": "summary", "sources": len(paths), "events": n, "wrote_store": False, "unreachable": len(bad)})
    return 0


def pull(a, spark, emit) -> int:
    """Pages of at most 1000 rows; the summary tells the last offset and whether the end was reached."""
    store = _store(a, spark)
    seen = store.visible(current=a.projection == "current")
    top = store.manifest().get("top", 0)
    at, n, done = a.since, 0, False
    while not done and (a.limit is None or n < a.limit):
        size = 1000 if a.limit is None else min(1000, a.limit - n)
        page = views.pull(seen, at, size).select("offset", "broken", F.to_json(F.struct("offset", F.struct(*EVENT.names).alias("event"))).alias("j")).collect()  # a page
        for r in page:
            if not r["broken"]:
                emit({"kind": "pulled"} | json.loads(r["j"]))
                n += 1
        at = page[-1]["offset"] if page else at  # past broken rows too
        done = len(page) < size
    emit({"kind": "pull_summary", "since": a.since, "last_offset": at, "events": n, "store_max_offset": top, "caught_up": done})
    return 0


def sessions_recent(a, spark, emit) -> int:
    df = views.recent_sessions(_store(a, spark).visible(), a.limit, a.since_ms)
    n = _each(df.select(*SOURCE, F.col("source_session_id").alias("session_id"), F.col("last_ms").alias("last_occurred_at_unix_ms"), F.col("first_ms").alias("first_occurred_at_unix_ms"), F.col("event_count").alias("events")), emit, "recent_session")
    emit({"kind": "recent_sessions_summary", "sessions": n})
    return 0


def session_spec(text: str) -> tuple[str, str, str, str]:
    """type/location/path/session; only the path may hold slashes."""
    parts = text.split("/", 2)
    path, slash, session = parts[2].rpartition("/") if len(parts) == 3 else ("", "", "")
    if not slash or not path or not session:
        raise ValueError(f"{text!r} isn't type/location/path/session")
    return parts[0], parts[1], path, session


def sessions_read(a, spark, emit) -> int:
    rows = [(*session_spec(s), k) for k, s in enumerate(a.session)]
    specs = spark.createDataFrame(rows, "source_type string, source_location string, source_path string, source_session_id string, list_pos int")
    df = views.read_sessions(views.whole(_store(a, spark).visible()), specs, a.max_events + 1).select(*EVENT.names)
    n = 0
    for r in df.select(F.to_json(F.struct(*EVENT.names)).alias("j")).toLocalIterator():
        if n == a.max_events:
            break
        emit({"kind": "event", "event": json.loads(r["j"])})
        n += 1
    emit({"kind": "sessions_read_summary", "sessions": len(rows), "events": n, "truncated": df.count() > a.max_events})
    return 0


def session_whole(a, spark, emit) -> int:
    """One session of the head, tombstones ignored, and how many of its rows couldn't be opened."""
    df = _store(a, spark).session(*session_spec(a.session))
    n = _each(views.whole(df).select(*EVENT.names), emit, "event", "event")
    emit({"kind": "session_summary", "events": n, "skipped": views.skipped(df)})
    return 0


def show_snapshots(a, spark, emit) -> int:
    store = _store(a, spark)
    latest = views.whole(views.latest_snapshots(store.events(), store.table("tombstones")))
    paths = [r["source_path"] for r in latest.select("source_path").distinct().collect()]  # a name a source
    asked = spark.createDataFrame([(p, discovery.probe(p)[0]) for p in paths], "source_path string, status string")
    n = _each(views.active_snapshots(latest, asked).select(*EVENT.names), emit, "snapshot", "event")
    emit({"kind": "snapshot_summary", "snapshots": n})
    return 0


def sync_snapshots(a, spark, emit) -> int:
    store = _store(a, spark)
    listing, bad = discovery.discover(spark, mode="snapshot_file")
    found, lost = discovery.project_identities()
    bad = sorted({*bad, *lost})
    known = spark.createDataFrame(found, discovery.IDENTITY)
    tops = store.table("project_root_registry").select("root_path").union(known.select("project_root")).distinct()
    for r in tops.collect():  # a registered root each
        status, why = discovery.probe(r.root_path)
        if status == "unknown":
            emit({"kind": "sync_unreachable", "reason": f"{r.root_path} (project root): {why}"})
    own = discovery.enumerate_snapshots(listing, discovery.project_snapshots(tops), known)
    asked = [(r.source_path, discovery.probe(r.source_path)) for r in own.select("source_path").distinct().collect()]  # a name a file
    there = [p for p, (status, _) in asked if status == "file"]
    unknown = [(p, why) for p, (status, why) in asked if status == "unknown"]
    out = {"sources": 0, "changed": 0, "unchanged": 0, "appended": 0, "failed": 0}
    if there:
        keep = spark.createDataFrame([(p,) for p in there], "source_path string")
        observed = a.now or time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime())
        out = snapshots.sync(store, snapshots.read(spark, own.join(keep, "source_path", "left_semi").select(*own.columns), there), observed)
    for p, why in [*unknown, *((b, "unreadable") for b in bad)]:
        emit({"kind": "sync_unreachable", "reason": f"{p}: {why}"})
    emit({"kind": "sync_snapshots_summary"} | out | {"unreachable": len(unknown) + len(bad)})
    return 2 if out["failed"] else 0


def roots(a, spark, emit) -> int:
    store = _store(a, spark)
    for path in a.register or ():
        found = discovery.project_root(path)
        if found:
            store.register_roots(spark.createDataFrame([found], "root_path string, root_source string"), now_ms=int(time.time() * 1000))
        else:
            emit({"kind": "without_root", "path": path})
    if a.discover:
        _discover_roots(store, emit)
    if a.identities:
        emit({"kind": "identity_sweep"} | identities.sweep(store, seconds=a.identities))
    report = views.root_report(store.table("project_root_registry"), store.table("project_identity"), store.table("project_identity_probe"))
    n = _each(report.withColumn("host_path", openable(F.col("root_path"), F.col("aliases"))).orderBy("root_key"), emit, "root")
    emit({"kind": "roots_summary", "roots": n, "attribution_revision": store.attribution_revision()})
    return 0


def _discover_roots(store: Store, emit: Emit, *, again_ms: int = 7 * 24 * 3600 * 1000, seconds: float = 60) -> None:
    """Register the roots above the directories that events name; those looked for in vain within a week are passed over."""
    now = int(time.time() * 1000)
    fresh = store.table("project_root_probe").where((F.col("outcome") == "none") & (F.col("last_probe_ms") > now - again_ms)).select(F.col("path").alias("project_root"))
    asked = [r["project_root"] for r in views.distinct_roots(store.table("raw_events")).join(fresh, "project_root", "left_anti").collect()]  # a row a project
    found = discovery.discover_roots(asked, deadline=Deadline.after(seconds))
    if found["roots"]:
        store.register_roots(store.spark.createDataFrame(found["roots"], "root_path string, root_source string"), now_ms=now)
    misses = [(p, "none", now) for p in found["without_root"]] + [(p, "unreachable", now) for p in found["failed"]]
    if misses:
        store.record_misses(store.spark.createDataFrame(misses, "path string, outcome string, last_probe_ms long"))
    emit({"kind": "root_discovery", "asked": len(asked), "roots": len(found["roots"]), "without_root": len(found["without_root"]), "failed": len(found["failed"]), "first_failure": found["first_failure"]})


def memory_roots(a, spark, emit) -> int:
    found = discovery.memory_roots()
    for kind, path, status in found:
        emit({"kind": "memory_root_unreachable" if status == "unknown" else "memory_root", "source_type": kind, "path": path, "status": status})
    bad = sum(s == "unknown" for *_, s in found)
    emit({"kind": "memory_roots_summary", "roots": len(found) - bad, "unreachable": bad})
    return 0


def store_path(a, spark, emit) -> int:
    emit({"kind": "store_path", "path": a.store or default_store()})
    return 0


def changes(a, spark, emit) -> int:
    page = views.changes(_store(a, spark).table("projection_log"), a.since_seq, a.limit)
    n = _each(page, emit, "change")
    last = page.agg(F.max("seq")).first()[0]
    emit({"kind": "changes_summary", "changes": n, "last_seq": a.since_seq if last is None else last, "caught_up": n < a.limit})
    return 0


def gc(a, spark, emit) -> int:
    emit({"kind": "gc_summary", "dry_run": a.dry_run} | _store(a, spark).gc(dry_run=a.dry_run, strict_reference=a.strict))
    return 0


def erase(a, spark, emit) -> int:
    emit({"kind": "erase_summary", "scope": a.scope, "key": a.key} | _store(a, spark).erase(a.scope, a.key, confirm=a.confirm, now_ms=int(time.time() * 1000)))
    return 0


def repair(a, spark, emit) -> int:
    emit({"kind": "repair_summary"} | _store(a, spark).repair())
    return 0


def fixture_append(a, spark, emit) -> int:
    """Append synthetic events, a JSON object a line, to a store that has to be named."""
    if not a.store:
        raise ValueError("fixture-append needs --store")
    rows = spark.read.schema(EVENT).option("mode", "FAILFAST").json(a.event_file)
    stats = _store(a, spark).append_events(rows)
    emit({"kind": "fixture_append_summary", "appended": stats.agg(F.sum("appended")).first()[0] if stats else 0})
    return 0


def compare(a, spark, emit) -> int:
    """1 if facts differ, are missing or unexplained ones are there; 2 if the report couldn't be written."""
    files = parity_inputs.sizes(spark, a.files) if a.files else None
    aligned = parity.align(parity_inputs.baseline(spark, a.baseline), parity_inputs.emitted(spark, a.events), files)
    report = parity.report(aligned)
    rows: list[dict] = []
    both = lambda row: (emit(row), rows.append(row))[0]
    _each(report.orderBy("combo"), both, "parity")
    for field in ("must", "advisory"):
        _each(aligned.where(F.size(field) > 0).orderBy(*parity.BUCKET, "ordinal").limit(a.max_show).select(*parity.BUCKET, "ordinal", F.col(field).alias("fields")), both, f"{field}_example")
    lost = False
    if a.report:
        try:
            with open(a.report, "w", encoding="utf-8") as f:
                json.dump(rows, f, ensure_ascii=False, indent=1)
        except OSError as e:
            print(f"{a.report}: {e}", file=sys.stderr)
            lost = True
    code = parity.exit_code(report, report_lost=lost)
    wrong = report.agg(F.coalesce(F.sum("must_mismatch"), F.lit(0))).first()[0]
    emit({"kind": "parity_summary", "verdict": "FAIL" if wrong else "PASS", "exit_code": code})
    return code


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tracelake")
    subs = top.add_subparsers(dest="command", required=True)

    def add(name: str, run: Callable, *options: tuple[str, dict]) -> None:
        p = subs.add_parser(name)
        p.add_argument("--store")
        for flag, how in options:
            p.add_argument(flag, **how)
        p.set_defaults(run=run)

    flag, number = {"action": "store_true"}, lambda n: {"type": int, "default": n}
    add("discover", discover)
    add("scan-all", scan, ("--profile", {"choices": ["full", "metadata"]}), ("--state", {"default": "cursors.json"}), ("--stateless", flag), ("--write-store", flag), ("--force", flag))
    add("pull", pull, ("--since", number(0)), ("--projection", {"choices": ["all", "current"], "default": "all"}), ("--limit", number(None)))
    add("sessions-recent", sessions_recent, ("--limit", number(20)), ("--since-ms", number(None)))
    add("sessions-read", sessions_read, ("session", {"nargs": "+"}), ("--max-events", number(50_000)))
    add("session", session_whole, ("session", {}))
    add("snapshots", show_snapshots)
    add("sync-snapshots", sync_snapshots, ("--now", {}))
    add("roots", roots, ("--register", {"nargs": "*"}), ("--discover", flag), ("--identities", {"type": float, "metavar": "SECONDS"}))
    add("memory-roots", memory_roots)
    add("store-path", store_path)
    add("changes", changes, ("--since-seq", number(0)), ("--limit", number(1000)))
    add("gc", gc, ("--dry-run", flag), ("--strict", flag))
    add("erase", erase, ("scope", {"choices": sorted(views.SCOPES)}), ("key", {}), ("--confirm", {"required": True}))
    add("parity", compare, ("--baseline", {"required": True}), ("--events", {"required": True}), ("--files", {}), ("--report", {}), ("--max-show", number(20)))
    add("repair", repair)
    add("fixture-append", fixture_append, ("--event-file", {"required": True}))
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None, emit: Emit | None = None) -> int:
    a = parser().parse_args(argv)
    try:
        return a.run(a, spark or _session(), emit or (lambda row: print(json.dumps(row, ensure_ascii=False))))
    except ValueError as e:
        print(e, file=sys.stderr)
        return 1
