import json
import os

import pytest
from pyspark.sql import functions as F

from tracelake import cli
from tracelake.operators.store import Store
from tracelake.plans.scan_all import profile_of, scan_all
from tracelake.sources import discovery, identities


def line(text, session="s"):
    return json.dumps({"sessionId": session, "timestamp": "2026-01-01T00:00:00Z", "message": {"role": "user", "content": text}}) + "\n"


@pytest.fixture
def home(tmp_path, monkeypatch):
    monkeypatch.setenv("CLAUDE_CONFIG_DIR", str(tmp_path / "claude"))
    monkeypatch.setenv("CODEX_HOME", str(tmp_path / "codex"))
    folder = tmp_path / "claude/projects/-w"
    (folder / "memory").mkdir(parents=True)
    (folder / "memory/m.md").write_text("remember")
    (folder / "s.jsonl").write_text(line("one") + line("two"))
    return tmp_path


def run(spark, home, *argv):
    rows = []
    code = cli.main([argv[0], "--store", str(home / "store"), *argv[1:]], spark, rows.append)
    return code, rows


def later(path, by=1):
    st = os.stat(path)
    os.utime(path, ns=(st.st_atime_ns, st.st_mtime_ns + by * 10**9))


def test_scan_all_passes(spark, home):
    store, state, log = Store(spark, f"file://{home}/store"), str(home / "cursors.json"), home / "claude/projects/-w/s.jsonl"

    def go():
        listing, _ = discovery.discover(spark)
        rows, summary, code = scan_all(spark, store, listing, state, now_ms=1)
        assert code == 0 and summary["state_saved"] and summary["snapshot_sources"] == 1 and summary["roots_empty"] is (store.attribution_revision() == 0)
        return rows, summary

    texts = lambda: [r.content for r in store.visible().orderBy("offset").collect()]
    rows, summary = go()
    assert [(r["kind"], r["mode"], r["appended"]) for r in rows] == [("store_write", "append", 2)] and texts() == ["one", "two"]
    size = log.stat().st_size
    assert summary["providers"] == {"claude_code": {"sources": 1, "errors": 0, "items_examined": 2, "items_skipped": 0, "bytes_read": size, "pending_tail_bytes": 0, "rollbacks": 0}}
    assert go()[0] == []
    with log.open("a") as f:
        f.write(line("three") + '{"half')
    later(log)
    assert [(r["mode"], r["appended"], r["skipped_dup"]) for r in go()[0]] == [("append", 1, 0)] and texts()[-1] == "three"
    with log.open("a") as f:
        f.write(" broken\n" + line("four"))
    later(log, 2)
    rows, summary = go()  # a poison line holds the batch
    assert [(r["kind"], r["quality"]) for r in rows] == [("store_held", "poison_line")] and summary["held_sources"] == 1 and len(texts()) == 3
    log.write_text(line("new"))
    later(log, 3)
    assert [(r["mode"], r["head_moved"]) for r in go()[0]] == [("rollback", True)] and texts() == ["new"]
    store.register_roots(spark.createDataFrame([("/w", "git")], "root_path string, root_source string"))
    assert [(r["mode"], r["head_moved"], r["superseded_removed"]) for r in go()[0]] == [("reparse", True, 1)] and texts() == ["new"] and go()[0] == []


def test_modes_that_nothing_reads_are_warned_of(spark, home):
    listing = spark.createDataFrame([("codex", "local", "/db.sqlite", "sqlite", None, None)], discovery.LISTING)
    rows, summary, code = scan_all(spark, Store(spark, f"file://{home}/store"), listing, None)
    assert code == 0 and rows == [{"kind": "source_report", "source_path": "/db.sqlite", "status": "ok", "warnings": ["source_mode sqlite not implemented"]}] and summary["sources"] == 1


def test_roots_of_events_are_found_once(spark, home):
    (home / "repo/.git").mkdir(parents=True)
    (home / "repo/src").mkdir()
    said = json.loads(line("one"))
    (home / "claude/projects/-w/s.jsonl").write_text("".join(json.dumps(said | {"cwd": c}) + "\n" for c in (str(home / "repo/src"), "/nowhere/at/all")))
    assert run(spark, home, "scan-all", "--write-store", "--stateless")[0] == 0
    first = run(spark, home, "roots", "--discover")[1][0]
    assert {k: first[k] for k in ("asked", "roots", "without_root", "failed")} == {"asked": 2, "roots": 1, "without_root": 1, "failed": 0}
    assert run(spark, home, "roots", "--discover")[1][0]["asked"] == 1


def test_writing_needs_full_events():
    assert (profile_of(None, True), profile_of(None, False), profile_of("full", False)) == ("full", "metadata", "full")
    with pytest.raises(ValueError):
        profile_of("metadata", True)


def test_commands(spark, home):
    log = str(home / "claude/projects/-w/s.jsonl")
    code, rows = run(spark, home, "discover")
    assert code == 0 and [r["source_mode"] for r in rows] == ["snapshot_file", "append_log"]
    code, rows = run(spark, home, "scan-all")
    assert [r["kind"] for r in rows] == ["event", "event", "summary"] and "content" not in rows[0]["event"]
    assert run(spark, home, "scan-all", "--write-store", "--profile", "metadata")[0] == 1
    assert run(spark, home, "scan-all", "--write-store", "--stateless")[1][-1]["written_events"] == 2
    code, rows = run(spark, home, "pull", "--limit", "1")
    assert rows[0]["event"]["content"] == "one" and rows[-1]["caught_up"] is False
    code, rows = run(spark, home, "pull", "--since", str(rows[-1]["last_offset"]), "--projection", "current")
    assert rows[0]["event"]["content"] == "two" and rows[-1]["caught_up"] and rows[-1]["store_max_offset"] == rows[-1]["last_offset"]
    assert run(spark, home, "sessions-recent")[1][0]["events"] == 2
    code, rows = run(spark, home, "sessions-read", f"claude_code/local/{log}/s", "--max-events", "1")
    assert rows[0]["event"]["content"] == "one" and rows[-1]["truncated"]
    assert run(spark, home, "sessions-read", "nonsense")[0] == 1
    assert run(spark, home, "sync-snapshots")[1][-1]["appended"] == 1 and run(spark, home, "sync-snapshots")[1][-1]["unchanged"] == 1
    assert [r["event"]["content"] for r in run(spark, home, "snapshots")[1][:-1]] == ["remember"]
    code, rows = run(spark, home, "session", f"claude_code/local/{log}/s")
    assert [r["event"]["content"] for r in rows[:-1]] == ["one", "two"] and rows[-1] == {"kind": "session_summary", "events": 2, "skipped": 0}
    assert run(spark, home, "changes")[1][-1] == {"kind": "changes_summary", "changes": 0, "last_seq": 0, "caught_up": True}
    assert run(spark, home, "gc", "--dry-run")[1][0]["projections"] == 0
    assert run(spark, home, "erase", "session", "s", "--confirm", "t")[0] == 1
    assert run(spark, home, "erase", "session", "s", "--confirm", "s")[1][0]["events"] == 2
    (home / "f.ndjson").write_text(json.dumps({"source_type": "codex", "source_location": "local", "source_path": "/f", "source_session_id": "f", "seq": 0, "event_type": "message", "content": "made up"}) + "\n")
    assert run(spark, home, "fixture-append", "--event-file", str(home / "f.ndjson"))[1][0]["appended"] == 1
    assert run(spark, home, "repair")[1][0] == {"kind": "repair_summary", "projections": 0, "heads": 0}
    assert run(spark, home, "store-path")[1] == [{"kind": "store_path", "path": str(home / "store")}]
    assert run(spark, home, "memory-roots")[1][-1]["kind"] == "memory_roots_summary"


def test_snapshots_of_a_project_have_its_root(spark, home):
    project = home / "my-app"
    project.mkdir()
    (project / "CLAUDE.md").write_text("rules")
    folder = home / "claude/projects" / str(project).replace("/", "-")
    for sub in ("memory", "other/memory"):
        (folder / sub).mkdir(parents=True)
        (folder / sub / "p.md").write_text("of the project")
    paths = lambda: {r["event"]["source_path"]: (r["event"].get("project_root"), r["event"].get("project_root_source")) for r in run(spark, home, "snapshots")[1][:-1]}
    rest = {str(home / "claude/projects/-w/memory/m.md"): (None, None), str(folder / "other/memory/p.md"): (None, None)}
    own = {str(folder / "memory/p.md"): (str(project), "host_identity"), str(project / "CLAUDE.md"): (str(project), "host_identity")}
    assert run(spark, home, "sync-snapshots")[1] == [{"kind": "sync_snapshots_summary", "sources": 4, "changed": 4, "unchanged": 0, "appended": 4, "failed": 0, "unreachable": 0}]
    assert paths() == rest | own and run(spark, home, "sync-snapshots")[1][-1]["unchanged"] == 4
    assert run(spark, home, "erase", "project_root", str(project), "--confirm", str(project))[1][0]["events"] == 2
    assert paths() == rest and run(spark, home, "sync-snapshots")[1][-1]["appended"] == 0 and paths() == rest


def test_project_folders_that_cannot_be_asked(spark, home, monkeypatch):
    probe = discovery.probe
    monkeypatch.setattr(discovery, "probe", lambda p, *a: ("unknown", "PermissionError") if p == "/w" else probe(p, *a))
    rows = run(spark, home, "sync-snapshots")[1]
    assert rows[0] == {"kind": "sync_unreachable", "reason": f"{home}/claude/projects/-w: unreadable"} and rows[-1]["unreachable"] == 1 and rows[-1]["appended"] == 1
    assert discovery.project_identities({"claude_code": str(home / "none")}) == ([], []) and discovery.decode_project_dir("-") is None


def test_roots_and_identities(spark, home):
    for name, config in (("a", '[remote "origin"]\n\turl = git@H:o/r.git\n'), ("b", "")):
        (home / f"{name}/.git").mkdir(parents=True)
        (home / f"{name}/.git/config").write_text(config)
    code, rows = run(spark, home, "roots", "--register", str(home / "a"), str(home / "b"), "--identities", "60")
    assert {k: rows[0][k] for k in ("registered", "recorded", "no_remote", "unresolved")} == {"registered": 2, "recorded": 1, "no_remote": 1, "unresolved": 0}
    assert [(r.get("canonical_id"), r["verdict"]) for r in rows[1:3]] == [("git:h/o/r", "resolved"), (None, "none")] and rows[-1]["roots"] == 2
    store, asked = Store(spark, f"file://{home}/store"), set()
    assert identities.sweep(store, asked=asked, now_ms=10**15)["recorded"] == 1 and identities.sweep(store, asked=asked)["already_probed"] == 2
    assert identities.sweep(store, seconds=0)["skipped_out_of_budget"] == 2
    got = identities.latest(store).collect()
    assert [(r.canonical_id, r.last_seen_ms) for r in got] == [("git:h/o/r", 10**15)]
    assert [r.id for r in identities.history(store, got[0].project_root).collect()] == [1]


def test_parity_command(spark, home):
    usage = {"sessionId": "s", "type": "assistant", "timestamp": "2026-01-01T00:00:00Z", "message": {"id": "m", "usage": {"input_tokens": 5, "output_tokens": 2}}}
    log = home / "claude/projects/-w/s.jsonl"
    log.write_text(json.dumps(usage) + "\n")
    events = [r for r in run(spark, home, "scan-all")[1] if r["kind"] == "event"]
    (home / "e.ndjson").write_text("\ufeff" + "".join(json.dumps(r) + "\n" for r in [*events, {"kind": "summary"}]) + "{broken\n\n")
    fact = {"provider": "claude_code", "location": "local", "source_path": str(log), "seq": 3, "session_id": "s", "message_id": "m", "input_tokens": 5, "output_tokens": 2, "cache_creation_tokens": 0, "cache_read_tokens": 0}
    compare = lambda f: ((home / "b.ndjson").write_text("\ufeff" + json.dumps(f) + "\n"), run(spark, home, "parity", "--baseline", str(home / "b.ndjson"), "--events", str(home / "e.ndjson")))[1]
    code, rows = compare(fact)
    assert code == 0 and rows[0]["matched"] == 1 and rows[-1]["verdict"] == "PASS"
    code, rows = compare(fact | {"input_tokens": 6})
    assert code == 1 and rows[-1]["verdict"] == "FAIL" and [r["fields"] for r in rows if r["kind"] == "must_example"] == [["input_tokens"]]
    assert run(spark, home, "parity", "--baseline", str(home / "b.ndjson"), "--events", str(home / "e.ndjson"), "--report", str(home / "r.json"))[0] == 1 and json.loads((home / "r.json").read_text())[0]["kind"] == "parity"
    (home / "b.ndjson").write_text(json.dumps(fact) + "\n")
    assert run(spark, home, "parity", "--baseline", str(home / "b.ndjson"), "--events", str(home / "e.ndjson"), "--report", str(home / "no/r.json"))[0] == 2
    (home / "b.ndjson").write_text("nonsense\n")
    from tracelake.sources import parity_inputs

    with pytest.raises(Exception, match="MALFORMED|FAILFAST|malformed"):
        parity_inputs.baseline(spark, str(home / "b.ndjson")).select(F.col("seq")).collect()
