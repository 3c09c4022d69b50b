import functools
import json
import os

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tests.conftest import SMALL
from tracelake.functions import crypto, ids, paths
from tracelake.functions import json as js
from tracelake.functions.time import unix_ms
from tracelake.operators import parity, parse, views
from tracelake.operators.attribution import attribute
from tracelake.operators.store import Conflict, Store
from tracelake.plans.commit_plan import plan
from tracelake.plans.deadline import Deadline
from tracelake.schema import EVENT, LINE, SOURCE, STATE, TABLES
from tracelake.sources import catalog, discovery, growing_log, snapshots, wsl
from tracelake.streaming import feed, ingest


def one(spark, column, *values):
    names = [chr(97 + k) for k in range(len(values))]
    schema = ", ".join(f"{n} {'binary' if isinstance(v, bytes) else 'long' if isinstance(v, int) else 'string'}" for n, v in zip(names, values, strict=True))
    return spark.createDataFrame([values], schema).select(column(*(F.col(n) for n in names)).alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("2026-08-05T01:00:00Z", 1785891600000), ("2026-08-05T09:00:00+08:00", 1785891600000), ("2026-08-05T01:00:00.123456789Z", 1785891600123), ("1969-12-31T23:59:59Z", -1000),
        ("2026-08-05T01:00Z", 1785891600000), (" 2026-08-05 09:00:00,5+0800\n", 1785891600500), ("2026-08-05t01:00:60z", 1785891660000), ("2026-02-31T00:00:00Z", 1772496000000),
        ("2026-13-05T01:00:00Z", None), ("2026-08-32T01:00:00Z", None), ("2026-08-05T25:00:00Z", None), ("2026-08-05T01:61:00Z", None), ("2026-08-05", None), ("2026-08-05T01:00:00+9", None), ("2026/08/05T01:00:00Z", None), (None, None),
    ],
)
def test_times(spark, text, want):
    assert spark.createDataFrame([(text,)], "a string").select(unix_ms(F.col("a")).alias("x")).first()["x"] == want


def test_paths(spark):
    f = lambda fn, *v: one(spark, fn, *v)
    assert f(paths.canonical_wsl_unc, "\\\\wsl.localhost\\Ubuntu\\home\\u") == "wsl:Ubuntu:/home/u"
    assert f(paths.canonical_wsl_unc, "\\\\wsl$\\Ubuntu\\") is None and f(paths.distro_of_unc, "\\\\wsl$\\Ubuntu") == "Ubuntu"
    assert f(paths.canonical_to_unc, "wsl:U:/home/u") == "\\\\wsl.localhost\\U\\home\\u"
    assert f(paths.is_drive_mount, "/mnt/c") and not f(paths.is_drive_mount, "/mnt/data")
    assert f(lambda a: paths.mount_to_windows(a, [("/mnt/c/", "C:\\")]), "/mnt/c/x/y") == "C:\\x\\y"
    assert f(lambda a: paths.mount_to_windows(a, []), "/mnt/c/x") is None
    assert f(lambda a: paths.normalize_cwd(a, host="windows", default_distro="D"), " /home/u ") == "wsl:D:/home/u"
    assert f(paths.normalize_cwd, "  ") is None
    assert f(paths.registry_key, "C:\\Work\\X\\") == "c:/work/x" and f(paths.registry_key, "/Srv/X//") == "/Srv/X" and f(paths.registry_key, "/") == "/"
    assert f(lambda a: paths.registry_key(a, [("/mnt/c", "C:\\")]), "/mnt/c/Work") == "c:/work"
    assert f(paths.encode_project_dir, "C:\\a/b") == "C--a-b"
    assert tuple(f(lambda a: paths.reach(a, host="windows"), "/home/u")) == ("unknown", None, "/home/u")
    assert f(lambda a: paths.openable(a, paths.aliases(a), host="windows"), "wsl:U:/home/u") == "\\\\wsl.localhost\\U\\home\\u"
    assert f(paths.file_stem, "/a/b.c.jsonl") == "b.c" and f(paths.artifact_kind, "x.rules") == "rules"


def test_names_and_tokens(spark):
    f = lambda fn, *v: one(spark, fn, *v)
    assert f(ids.normalize_remote, "git@github.com:O/R.git") == f(ids.normalize_remote, "https://u@github.com/o/r/") == "github.com/o/r"
    assert f(ids.normalize_remote, " ") is None
    assert f(ids.origin_url, '[core]\n\tbare = false\n[remote "origin"]\n\tfetch = x\n\turl = git@h:o/r.git\n') == "git@h:o/r.git"
    token = lambda p: f(lambda a: ids.projection_token(F.lit("codex"), F.lit("local"), a, F.lit(None).cast("string"), F.lit(4), F.lit(0), F.lit(0), F.lit(9)), p)
    assert token("é") == "v1|codex|local|2:é|4:nofp|4|0|0-9"


def test_envelopes(spark):
    key = b"0123456789abcdef"
    aad = lambda s: crypto.event_aad(*(F.lit(x) for x in ("codex", "local", "/p", "s")), F.lit(s), F.lit(0), F.lit(0))
    row = spark.createDataFrame([("text", key)], "t string, k binary").select(crypto.seal(F.col("t"), F.col("k"), aad(1), key_id=F.lit("g1"), iv=F.lit(b"abcdefghijkl")).alias("e"), "k")
    got = row.select("e", crypto.open_sealed(F.col("e"), F.col("k"), aad(1)).alias("a"), crypto.open_sealed(F.col("e"), F.col("k"), aad(2)).alias("b"), crypto.envelope(F.col("e")).alias("v")).first()
    assert (got.a, got.b, tuple(got.v)) == ("text", None, ("sv2", "g1"))


def lines(spark, kind, path, records):
    return spark.createDataFrame([(kind, "local", path, k, r if isinstance(r, str) else json.dumps(r)) for k, r in enumerate(records)], LINE)


def registry(spark, *roots):
    return spark.createDataFrame([(r, r, "git") for r in roots], "root_key string, root_path string, root_source string")


def test_claude_lines(spark):
    body = [{"type": "thinking", "thinking": "hm"}, {"type": "text", "text": "hi"}, {"type": "tool_use", "name": "ls"}]
    use = {"input_tokens": 5, "output_tokens": 2.9, "cache_read_input_tokens": -1}
    got = parse.events(
        lines(spark, "claude_code", "/t/sess.jsonl", [
            {"type": "assistant", "sessionId": "s1", "cwd": "/w/p/x", "timestamp": "2026-01-01T00:00:00Z", "effort": "", "requestId": "r", "message": {"id": "m", "role": "assistant", "model": "M", "content": body, "usage": use}},
            "", "{bad", {"isMeta": True, "type": "assistant", "message": {"content": "hidden", "usage": {}}},
            {"message": {"role": "user", "content": [{"type": "tool_result", "content": [{"type": "text", "text": "out"}]}]}, "cwd": " "},
            {"message": {"role": "alien", "content": "x"}},
        ]),
        registry(spark, "/w/p"),
    ).orderBy("seq").collect()
    assert [(e.seq, e.event_type, e.actor, e.content) for e in got] == [(0, "thinking", "assistant", "hm"), (1, "message", "assistant", "hi\n[Tool: ls]"), (2, "usage", "assistant", None), (3, "usage", "assistant", None), (4, "message", "tool", "out"), (5, "message", None, "x")]
    assert tuple(got[2].usage) == (5, 2, 0, 0) and got[2].effort is None and got[2].message_id == "m" and got[1].model == "M"
    assert (got[0].project_root, got[0].project_root_source, got[0].source_session_id) == ("/w/p", "git", "s1")
    assert (got[4].project_root_source, got[5].project_root_source, got[5].source_session_id, got[5].time_confidence) == ("missing_cwd", None, "sess", "low")
    assert [f.name for f in EVENT] == list(got[0].asDict())
    bare = parse.events(lines(spark, "claude_code", "/t/s.jsonl", [{"message": {"role": "user", "content": "x"}}]), registry(spark), profile="metadata").first()
    assert bare.content is None and bare.seq == 0


def count(i, c, o, **more):
    return {"type": "event_msg", "payload": {"type": "token_count", "info": {"total_token_usage": {"input_tokens": i, "cached_input_tokens": c, "output_tokens": o}, **more}}}


def test_codex_state_and_deltas(spark):
    meta = lambda i: {"type": "session_meta", "payload": {"id": i, "cwd": "/w"}}
    item = lambda **p: {"type": "response_item", "payload": p}
    rows = [
        meta("s1"), {"type": "turn_context", "payload": {"model_slug": "M", "collaboration_mode": {"reasoning_effort": "high"}}}, count(100, 20, 50), count(150, 30, 80), count(150, 30, 80),
        item(type="reasoning", encrypted_content="z"), item(type="message", role="user", content=[{"type": "input_text", "text": "q"}]), item(type="function_call", name="sh"), item(type="function_call_output", output=" "),
        meta("s2"), count(30, 5, 10), count(31, 5, 10, last_token_usage=None), {"type": "event_msg", "payload": {"type": "agent_message", "message": "mirror"}},
    ]
    got = parse.events(lines(spark, "codex", "/t/r.jsonl", rows), registry(spark)).orderBy("seq").collect()
    assert [(e.source_session_id, e.event_type, e.model, e.effort, tuple(e.usage) if e.usage else None) for e in got] == [
        ("s1", "usage", "M", "high", (80, 50, 0, 20)), ("s1", "usage", "M", "high", (40, 30, 0, 10)), ("s1", "thinking", "M", "high", None), ("s1", "message", "M", "high", None), ("s1", "tool_use", "M", "high", None), ("s2", "usage", None, None, (25, 10, 0, 5)),
    ]
    assert got[2].content is None and got[4].content == "[Tool: sh]"


def test_text_of_nested_blocks(spark):
    v = json.dumps([{"type": "tool_result", "content": {"text": "a"}}, {"content": [{"text": "b"}, {"text": " "}]}, {"text": 7}, "s"])
    assert one(spark, lambda a: js.text(js.parse(a)), v) == "a\nb"


def test_text_of_blocks_at_any_depth(spark):
    def deep(block, levels):
        for k in range(levels):
            block = {"type": ("tool_result", "search_result", "x")[k % 3], "content": [block, {"type": "text", "text": f"after {k}"}]}
        return block

    levels = (0, 1, 2, 3, 4, 60, 400)
    for n in levels:
        v = json.dumps([{"text": "before"}, deep({"type": "text", "text": "said"}, n), {"type": "tool_use", "name": "sh", "content": [{"text": "unseen"}]}])
        assert one(spark, lambda a: js.text(js.parse(a)), v) == "\n".join(["before", "said", *(f"after {k}" for k in range(n)), "[Tool: sh]"])
    odd = [{"type": "tool_result", "text": "unseen", "content": [{"content": [{"content": "a"}, {"content": {"text": "b"}}, [{"text": "unseen"}], None, {"text": "", "content": [{"text": "unseen"}]}, {"content": []}]}]}, {"text": 7, "content": [{"content": [{"output_text": "c"}]}]}]
    assert one(spark, lambda a: js.text(js.parse(a)), json.dumps(odd)) == "a\nb\nc"


def test_messages_of_deep_blocks_keep_their_places(spark):
    found = {"type": "tool_result", "content": [{"type": "search_result", "content": [{"type": "text", "text": "found"}]}]}
    said = lines(spark, "claude_code", "/t.jsonl", [{"sessionId": "s", "message": {"role": "user", "content": c}} for c in ("a", [found], "b")])
    assert [(r.seq, r.actor, r.content) for r in parse.events(said, registry(spark)).orderBy("seq").collect()] == [(0, "user", "a"), (1, "tool", "found"), (2, "user", "b")]


def test_attribution_by_segments(spark):
    df = spark.createDataFrame([(1, "/a/bc"), (2, "/a/b/c/d"), (3, None), (4, " "), (5, "/a/b")], "i long, cwd string")
    got = {r.i: (r.project_root, r.project_root_source) for r in attribute(df, registry(spark, "/a/b", "/a/b/c")).collect()}
    assert got == {1: ("/a/bc", "unattributed"), 2: ("/a/b/c", "git"), 3: (None, None), 4: (None, "missing_cwd"), 5: ("/a/b", "git")}


def test_plan_never_disagrees(spark):
    cases = [(q, n, *(bool(b >> k & 1) for k in range(4))) for q in ("clean", "degraded", "poison_line", "unavailable") for n in (0, 3) for b in range(16)]
    got = plan(spark.createDataFrame(cases, "quality string, events long, rewritten boolean, stale boolean, full_reason boolean, prior boolean")).collect()
    for r in got:
        assert (r.plan_index == "preserve") == (r.plan_store == "preserve") == (r.plan_cursor == "freeze") == (r.plan_sync == "hold")
        assert (r.plan_store == "rollback") <= (r.rewritten and r.prior) and (r.plan_index == "append_facts") <= (r.quality == "clean")


def batch(spark, path, records, session="s"):
    blank = dict.fromkeys(f.name for f in EVENT)
    rows = [blank | {"schema_version": 2, "source_type": "claude_code", "source_location": "local", "source_path": path, "source_session_id": session, "seq": k, "event_type": "message", "content": t} for k, t in enumerate(records)]
    return spark.createDataFrame([tuple(r.values()) for r in rows], EVENT)


def sources(spark, path, reason, token=None):
    return spark.createDataFrame([("claude_code", "local", path, reason, token)], "source_type string, source_location string, source_path string, reason string, token string")


def test_store_life(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    put = lambda reason, texts, token=None: store.apply_projection(sources(spark, "/p", reason, token), batch(spark, "/p", texts)).first()
    s = put("append", ["a", "b"])
    assert (s.appended, s.skipped_dup, s.head_moved) == (2, 0, False)
    assert put("append", ["a", "b", "c"]).appended == 1 and store.table("projection_log").count() == 0
    s = put("reparse", ["A", "B", "C"], "t1")
    assert (s.removed, s.loses_events, s.projection_revision) == (3, False, 1)
    assert [r.content for r in views.pull(store.visible()).collect()] == ["A", "B", "C"]
    s = put("reparse", ["A"], "t1")
    assert s.replayed and not s.head_moved and s.projection_revision == 1 and s.appended == 0
    s = put("reparse", ["x"], "t2")
    assert s.loses_events and store.visible().count() == 1 and store.visible(current=False).count() == 4
    s = put("rollback", ["n1", "n2"], "t3")
    assert (s.source_revision, s.projection_revision, s.head_moved) == (1, 0, True)
    assert [r.reason for r in views.changes(store.table("projection_log")).collect()] == ["reparse", "reparse", "rollback"]
    offsets = [r["offset"] for r in store.table("raw_events").orderBy("offset").collect()]
    assert len(set(offsets)) == len(offsets)
    assert store.gc(dry_run=True)["projections"] == 0 and store.gc(strict_reference=True)["events"] == 4
    with pytest.raises(ValueError):
        store.apply_projection(sources(spark, "/other", "append"), batch(spark, "/p", ["z"]))
    with pytest.raises(ValueError):
        store.erase("session", "s", confirm="t")
    assert store.erase("session", "s", confirm="s")["events"] == 2 and store.visible().count() == 0
    assert put("append", ["n1", "n2", "n3"]).skipped_erased == 3
    put("reparse", [], "t4")
    assert store.table("current_head").count() == 1
    base = store.manifest()
    store._publish(base, {})
    with pytest.raises(Conflict):
        store._publish(base, {})
    assert store.register_roots(spark.createDataFrame([("/w", "git")], "root_path string, root_source string")) == 1
    assert store.register_roots(spark.createDataFrame([("/w", "git")], "root_path string, root_source string"), now_ms=5) == 1


def test_snapshots(spark, tmp_path):
    store, f = Store(spark, f"file://{tmp_path}/store"), tmp_path / "m.md"
    f.write_text("one")
    listing = spark.createDataFrame([("codex", "local", str(f), "snapshot_file", None, "memory")] * 2, discovery.LISTING)
    sync = lambda: snapshots.sync(store, snapshots.read(spark, listing, [str(f)]), "2026-01-01T00:00:00Z")
    assert sync() == {"sources": 1, "changed": 1, "unchanged": 0, "appended": 1, "failed": 0} and sync()["changed"] == 0
    f.write_text("two")
    assert sync()["appended"] == 1
    latest = views.latest_snapshots(store.table("raw_events"))
    assert [r.content for r in latest.collect()] == ["two"]
    probes = spark.createDataFrame([(str(f), "absent")], "source_path string, status string")
    assert views.active_snapshots(latest, probes).count() == 0 and views.active_snapshots(latest, probes.limit(0)).count() == 1


def test_discovery_and_roots(spark, tmp_path):
    for p in ("claude/projects/-w-p/memory/a.md", "claude/projects/-w-p/s.jsonl", "claude/projects/-w-p/b.md", "codex/rules/r.rules", "w/.git/config", "w/sub/package.json", "home/.git/x"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text('[remote "origin"]\n\turl = git@H:o/r.git\n' if p.endswith("config") else "")
    df, bad = discovery.discover(spark, {"claude_code": str(tmp_path / "claude"), "codex": str(tmp_path / "codex")})
    assert [(os.path.basename(r.source_path), r.source_mode, r.artifact_kind) for r in df.collect()] == [("a.md", "snapshot_file", "memory"), ("s.jsonl", "append_log", None), ("r.rules", "snapshot_file", "rules")] and not bad
    assert discovery.project_root(str(tmp_path / "w/sub"), str(tmp_path / "home")) == (str(tmp_path / "w"), "git")
    assert discovery.git_identity(str(tmp_path / "w")) == ("resolved", "git:h/o/r")
    assert catalog.config_dirs({"CODEX_HOME": " ", "CLAUDE_CONFIG_DIR": "/c"}, "/h") == {"claude_code": "/c", "codex": "/h/.codex"}
    assert catalog.catalog(spark).count() == 9
    assert discovery.decode_project_dir("-" + str(tmp_path / "w/sub").strip("/").replace("/", "-")) == str(tmp_path / "w/sub")


def test_growing_files(spark, tmp_path):
    f = tmp_path / "a.jsonl"
    f.write_bytes('{"a":"é"}\n{"b"'.encode())
    s = growing_log.scan(str(f), None)
    assert (s["change"], s["end"]) == ("grown", 11) and growing_log.complete_lines(b"x\ny") == ([b"x"], 2)
    cursor = s["cursor"]
    assert growing_log.scan(str(f), cursor)["change"] == "none"
    with f.open("ab") as h:
        h.write(b":1}\n{bad\n")
    os.utime(f, ns=(cursor["mtime"] + 10**9,) * 2)
    spark.dataSource.register(growing_log.GrowingLog)
    read = lambda c, **o: [tuple(r) for r in spark.read.format("growing_log").options(**o).option("path", str(tmp_path)).option("cursors", json.dumps(c)).load().select("byte_start", "byte_end", "line", "control").orderBy("byte_start").collect()]
    whole = [(0, 11, '{"a":"é"}', None), (11, 19, '{"b":1}', None), (19, 24, "{bad", None)]
    assert read({}) == whole and read({str(f): cursor}) == whole[1:]
    assert all(read({}, split=n) == whole for n in range(1, 26))  # a line belongs to the range that it begins in
    new = lines(spark, "codex", str(f), ['{"b":1}', "{bad"]).unionByName(lines(spark, "codex", "/good", ["{}", " "]))
    assert [r.source_path for r in parse.unpoisoned(new).collect()] == ["/good"] * 2
    f.write_bytes(b"{}\n")
    os.utime(f, ns=(cursor["mtime"] + 2 * 10**9,) * 2)
    s = growing_log.scan(str(f), cursor)
    assert (s["change"], s["cursor"]["safe_offset"]) == ("rollback", 3) and growing_log.scan(str(f), s["cursor"])["change"] == "none"
    assert read({str(f): cursor})[0][2:] == (growing_log.prefix_hash(str(f), 3), "rollback")
    growing_log.save_cursors(str(tmp_path / "c.json"), {"k": 1})
    assert growing_log.load_cursors(str(tmp_path / "c.json")) == ({"k": 1}, None) and growing_log.load_cursors(str(tmp_path / "none")) == ({}, None)


def test_streaming_ingest(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    f = logs / "s.jsonl"
    line = lambda t: json.dumps({"sessionId": "s", "message": {"role": "user", "content": t}}) + "\n"
    f.write_text(line("one") + line("two") + "{")
    store = Store(spark, f"file://{tmp_path}/store")

    def run():
        q = ingest.start(spark, store, str(logs), str(tmp_path / "ckpt"), source_type="claude_code", registry=registry(spark), once=True)
        q.awaitTermination(120)
        assert q.exception() is None
        return [r.content for r in views.pull(store.visible()).collect()]

    heads = lambda: [tuple(r)[3:] for r in store.table("current_head").collect()]
    assert run() == ["one", "two"]
    f.write_text(line("one") + line("two") + line("three"))
    assert run() == ["one", "two", "three"] and run() == ["one", "two", "three"]
    # two rewrites that end at the same byte are two, and a half line after one is none
    f.write_text(line("AAA"))
    assert run() == ["AAA"] and heads() == [(1, 0)]
    with f.open("a") as h:
        h.write('{"half')
    assert run() == ["AAA"] and heads() == [(1, 0)]
    f.write_text(line("AAA") + line("bbb"))
    assert run() == ["AAA", "bbb"]
    f.write_text(line("CCC"))
    assert run() == ["CCC"] and heads() == [(2, 0)] and [r.events for r in store.table("projections").orderBy("source_revision").collect()] == [3, 2, 1]
    # without its state a file is read from its start, and nothing is stored twice
    store._publish(store.manifest(), {"parser_state": []})
    f.write_text(line("CCC") + line("ddd"))
    assert run() == ["CCC", "ddd"] and store.parser_state().first().next_seq == 2


def test_batches_parse_as_the_whole_does(spark):
    meta = lambda i: {"type": "session_meta", "payload": {"id": i, "cwd": f"/{i}"}}
    turn = {"type": "turn_context", "payload": {"model": "M", "effort": "low"}}
    rows = [count(5, 1, 2), meta("a"), turn, count(9, 3, 2), count(20, 3, 4), {"type": "response_item", "payload": {"type": "message", "role": "user", "content": "q"}}, meta("a"), count(25, 3, 4), meta("b"), count(7, 0, 1), count(8, 0, 1)]
    said = [{"sessionId": "s", "message": {"role": "user", "content": f"t{k}"}} for k in range(len(rows))]
    both = lines(spark, "codex", "/c.jsonl", rows).unionByName(lines(spark, "claude_code", "/d.jsonl", said))
    order = ["source_path", "seq"]
    whole = [tuple(r) for r in parse.events(both, registry(spark)).orderBy(*order).collect()]
    for cut in (3, 4, 8):
        first, then = both.where(f"byte_start < {cut}"), both.where(f"byte_start >= {cut}")
        none = spark.createDataFrame([], STATE)
        ends = both.groupBy(*SOURCE).agg(F.lit(cut).alias("end_byte"))
        one_ = parse.events(first, registry(spark), state=none)
        state = spark.createDataFrame(parse.end_state(first, ends, none, one_).collect(), STATE)
        two = parse.events(then, registry(spark), state=state)
        assert [tuple(r) for r in one_.unionByName(two).orderBy(*order).collect()] == whole


def test_lines_with_repeated_keys(spark):
    twice = '{"sessionId":"x","sessionId":"s","message":{"role":"user","content":"old","content":"new"}}'
    own = lines(spark, "claude_code", "/t.jsonl", [twice, '{"a":NaN}'])
    assert [(r.source_session_id, r.content) for r in parse.events(own, registry(spark)).collect()] == [("s", "new")]
    assert tuple(parse.skipped(own).first())[3:] == (2, 1)


def files_below(path):
    return [p for p in path.rglob("*") if p.is_file()]


def test_erased_rows_leave_no_file(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store", buckets=4)
    for path in ("/p", "/q"):
        store.apply_projection(sources(spark, path, "append"), batch(spark, path, [f"secret {path}", "other"]))
    store.apply_projection(sources(spark, "/p", "reparse", "t"), batch(spark, "/p", ["secret /p again", "b"]))
    assert not list((tmp_path / "store/.staged").glob("*"))
    holds = lambda text: any(text.encode() in p.read_bytes() for p in files_below(tmp_path / "store"))
    assert holds("secret /p again") and holds("secret /q")
    assert store.erase("source_path", "/p", confirm="/p") == {"events": 2, "keys_destroyed": 0}
    assert not holds("secret /p") and holds("secret /q") and store._versions() == [store.version()]
    assert [r.source_path for r in views.distinct_roots(store.table("raw_events").withColumn("project_root", F.col("source_path"))).select(F.col("project_root").alias("source_path")).collect()] == ["/q"]


def test_a_commit_reads_the_buckets_of_its_sources(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store", buckets=8, most_folders=3)
    store.append_events(functools.reduce(DataFrame.unionByName, (batch(spark, f"/p{k}", ["x"]) for k in range(12))))
    one = store._buckets_of(sources(spark, "/p3", "append"))
    assert len(one) == 1 and 1 <= len(store.table("raw_events", buckets=one).inputFiles()) < len(store.table("raw_events").inputFiles())
    before = set(store.manifest()["tables"]["raw_events"])
    for k in range(3):  # small folders of a bucket are put together now and then
        store.apply_projection(sources(spark, "/p3", "append"), batch(spark, "/p3", ["x"] * (k + 2)))
    after = set(store.manifest()["tables"]["raw_events"])
    assert {f for f in before ^ after if int(f[-1]) not in one} == set() and sum(int(f[-1]) in one for f in after) == 2
    assert store.visible().where("source_path = '/p3'").count() == 4 and store.manifest()["top"] == store.table("raw_events").agg(F.max("offset")).first()[0]


def test_two_writers_of_one_version(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    base = store.manifest()
    store._publish(base, {})
    with pytest.raises(Conflict):
        store._publish(base, {})
    assert not list((tmp_path / "store/manifests").glob(".draft*")) and store.version() == 1


def test_the_first_of_a_batch_wins_and_replacing_needs_a_token(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    two = batch(spark, "/p", ["z first"]).unionByName(batch(spark, "/p", ["a second"])).coalesce(1)
    s = store.apply_projection(sources(spark, "/p", "append"), two).first()
    assert (s.appended, s.skipped_dup) == (1, 1) and store.visible().first().content == "z first"
    with pytest.raises(ValueError, match="token"):
        store.apply_projection(sources(spark, "/p", "rollback"), batch(spark, "/p", ["tail"]))


def test_contents_are_sealed_under_group_keys(spark, tmp_path):
    path, key = f"file://{tmp_path}/store", bytes(range(32))
    store = Store(spark, path, master_key=key)
    for p in ("/p", "/q"):
        store.apply_projection(sources(spark, p, "append"), batch(spark, p, ["open sesame", None]))
    assert [(r.content, r.broken) for r in store.visible().orderBy("offset").collect()] == [("open sesame", False), (None, False)] * 2
    assert not any(b"open sesame" in p.read_bytes() for p in files_below(tmp_path / "store"))
    assert store.table("data_keys").count() == 2 and "000102" not in store.visible()._jdf.queryExecution().toString().lower()
    # another key opens nothing, and a page over broken rows still ends somewhere
    other = Store(spark, path, master_key=bytes(32))
    page = views.pull(other.visible())
    assert views.whole(page).count() == 2 and views.page_end(page).first()[0] == store.manifest()["top"]
    got = other.session("claude_code", "local", "/p", "s")
    assert got.count() == 2 and views.skipped(got) == 1 and views.skipped(store.session("claude_code", "local", "/p", "s")) == 0
    assert Store(spark, path).visible().where("broken").count() == 2
    assert store.erase("source_path", "/p", confirm="/p") == {"events": 2, "keys_destroyed": 1} and store.table("data_keys").first().source_path == "/q"
    store.apply_projection(sources(spark, "/q", "append"), batch(spark, "/q", ["open sesame", None, "more"]))
    assert store.table("data_keys").count() == 1 and [r.content for r in store.visible().orderBy("offset").collect()] == ["open sesame", None, "more"]


def test_a_session_is_named_by_its_whole_key(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    own = batch(spark, "/p", ["a"])
    both = own.unionByName(own.withColumns({"source_type": F.lit("codex"), "content": F.lit("b")})).unionByName(own.withColumns({"source_location": F.lit("wsl:U"), "content": F.lit("c")}))
    store.append_events(both)
    read = lambda *k: [r.content for r in store.session(*k, "/p", "s").collect()]
    assert read("claude_code", "local") == ["a"] and read("codex", "local") == ["b"] and read("claude_code", "wsl:U") == ["c"]


def test_repair_fills_what_is_missing(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    store.apply_projection(sources(spark, "/p", "append"), batch(spark, "/p", ["a", "b"]))
    store.apply_projection(sources(spark, "/p", "rollback", "t"), batch(spark, "/p", ["c"]))
    store._publish(store.manifest(), {"projections": [], "current_head": []})
    assert store.repair() == {"projections": 2, "heads": 1} and store.repair() == {"projections": 0, "heads": 0}
    assert [r.content for r in store.visible().collect()] == ["c"] and {(r.origin, r.events) for r in store.table("projections").collect()} == {("unknown", 2), ("unknown", 1)}


def test_a_copy_follows_the_feed(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    put = lambda path, reason, texts, token=None: store.apply_projection(sources(spark, path, reason, token), batch(spark, path, texts))
    copy, seq, offset = spark.createDataFrame([], TABLES["raw_events"]), 0, 0

    def go():
        nonlocal copy, seq, offset
        new, seq, offset = feed.follow(store, copy, after_seq=seq, after_offset=offset)
        copy = spark.createDataFrame(new.collect(), TABLES["raw_events"])
        assert sorted(r.content for r in copy.collect()) == sorted(r.content for r in store.visible().collect())
        return sorted(r.content for r in copy.collect())

    put("/p", "append", ["a", "b"])
    put("/q", "append", ["x"])
    assert go() == ["a", "b", "x"]
    put("/p", "reparse", ["A"], "t1")
    put("/q", "append", ["x", "y"])
    assert go() == ["A", "x", "y"] and go() == ["A", "x", "y"]
    store.erase("source_path", "/q", confirm="/q")
    assert go() == ["A"]


def test_marks_and_misses(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    assert not store.is_backfilled() and store.set_backfilled(True) and store.is_backfilled()
    miss = lambda path, how, at: store.record_misses(spark.createDataFrame([(path, how, at)], TABLES["project_root_probe"]))
    miss("/a", "unreachable", 1), miss("/a", "none", 2), miss("/b", "none", 3)
    assert {tuple(r) for r in store.table("project_root_probe").collect()} == {("/a", "none", 2), ("/b", "none", 3)}


def test_what_cannot_be_asked_is_not_absent(tmp_path, monkeypatch):
    assert discovery.probe(str(tmp_path / "no")) == ("absent", None) and discovery.probe(str(tmp_path / "no"), str(tmp_path / "none")) == ("absent", None)
    ask = os.stat

    def deaf(path, *a, **k):
        if str(path) == "/anchor":
            raise PermissionError(path)
        return ask(path, *a, **k)

    monkeypatch.setattr(discovery.os, "stat", deaf)
    assert discovery.probe("/anchor/x", "/anchor") == ("unknown", "/anchor: PermissionError") and discovery.probe("/anchor/x") == ("absent", None)
    got = discovery.discover_roots([" ", "/anchor", str(tmp_path)], home=str(tmp_path))
    assert got["failed"] == ["/anchor"] and got["first_failure"] == "/anchor: PermissionError"


def test_what_the_tools_of_wsl_print():
    both = "Ubuntu-22.04\r\nDebian\r\n\r\nUbuntu-22.04\r\n"
    for raw in (both.encode("utf-16-le"), b"\xff\xfe" + both.encode("utf-16-le"), b"Ubuntu-22.04\nDeb\0ian\n."[:-1]):
        assert wsl.distros(raw) == ["Ubuntu-22.04", "Debian"]
    assert wsl.decoded(b"\0\0\0") is None and wsl.decoded(b"\x00\xd8") is None
    assert wsl.default_distro(["docker-desktop", "Ubuntu"]) == "Ubuntu" and wsl.default_distro(["Ubuntu", "Debian"]) is None and wsl.default_distro([]) is None
    assert wsl.nul_paths(b"/a/b\0\0 /c \0") == ["/a/b", "/c"]
    assert [d for d in ("C:", "d:\\", "e:/", "C", "CC:", "/dev/sda", "C:\\x") if wsl.is_drive_device(d)] == ["C:", "d:\\", "e:/"]
    assert wsl.drive_mounts("C:\\ /mnt/c 9p rw\n/dev/sdb / ext4\nD: /mnt/c/deep 9p\n") == [("/mnt/c/deep", "D:\\"), ("/mnt/c", "C:\\")]
    assert wsl.escaped('a"b$c`d\\e') == 'a\\"b\\$c\\`d\\\\e'


def test_snapshots_of_places_that_answer_no_question_stay(spark):
    schema = "source_location string, source_path string"
    latest = spark.createDataFrame([("wsl:A", "/1"), ("wsl:A", "/2"), ("wsl:B", "/1"), ("local", "/1")], schema)
    asked = spark.createDataFrame([("wsl:A", True), ("wsl:B", False)], "source_location string, answered boolean")
    got = views.present_snapshots(latest, asked, spark.createDataFrame([("wsl:A", "/2"), ("wsl:B", "/9")], schema))
    assert {tuple(r) for r in got.collect()} == {("wsl:A", "/2"), ("wsl:B", "/1"), ("local", "/1")}


def test_a_deadline_leaves_nothing_to_begin():
    d = Deadline(10.0)
    assert d.remaining(4.0) == 6.0 and d.budget(2.0, 4.0) == 2.0 and d.budget(9.0, 4.0) == 6.0
    assert d.remaining(10.0) is None and d.budget(1.0, 11.0) is None and d.expired() and not Deadline.unbounded().expired()
    assert discovery.discover_roots(["/a", "/b"], deadline=Deadline.after(0)) == {"roots": [], "without_root": [], "failed": ["/a", "/b"], "first_failure": "/a: out of time"}


@pytest.mark.parametrize("mark", [".hg", "CLAUDE.md", "AGENTS.md", "go.mod"])
def test_markers_of_roots(tmp_path, mark):
    (tmp_path / "p/sub").mkdir(parents=True)
    (tmp_path / "p" / mark).write_text("")
    (tmp_path / "p/sub/Makefile").write_text("")
    assert discovery.project_root(str(tmp_path / "p/sub"), str(tmp_path)) == (str(tmp_path / "p"), "marker")


def test_parity(spark):
    names = ["provider", "location", "source_path", "seq", *parity.MUST, *parity.ADVISORY]
    row = lambda path, seq, tokens=1, cwd="/a": tuple({"provider": "codex", "location": "local", "source_path": path, "seq": seq, "input_tokens": tokens, "cwd": cwd}.get(n) for n in names)
    schema = ", ".join(f"{n} {'long' if n == 'seq' or n.endswith('tokens') else 'string'}" for n in names)
    old = spark.createDataFrame([row("/p", 1), row("/p", 5), row("/q", 1), row("/r", 1)], schema)
    new = spark.createDataFrame([row("/p", 2, 9), row("/p", 3, cwd="/b"), row("/q", 1), row("/q", 2)], schema)
    files = spark.createDataFrame([("/q", 1, 2)], "source_path string, old_size long, new_size long")
    got = parity.report(parity.align(old, new, files))
    assert {c: got.first()[c] for c in parity.COUNTS} == {"facts": 4, "matched": 2, "must_mismatch": 1, "advisory": 1, "missing": 1, "growth": 1, "unknown_extra": 0, "extra": 1}
    assert parity.exit_code(got) == 1 and parity.exit_code(got.limit(0)) == 0 and parity.exit_code(got.limit(0), report_lost=True) == 2
    extra = parity.report(parity.align(old.limit(0), new))
    assert extra.first()["unknown_extra"] == 4 and parity.exit_code(extra) == parity.exit_code(extra, report_lost=True) == 1


def test_tombstones_are_equi_joins(spark):
    from tracelake.queries import tombstone_visibility

    assert "NestedLoop" not in tombstone_visibility(spark, SMALL)._jdf.queryExecution().toString()


def test_engine_stands_without_training_operators():
    import pathlib

    root = pathlib.Path(__file__).parents[1] / "tracelake"
    assert not [p for p in root.rglob("*.py") if "llm" not in p.parts and "tracelake.llm" in p.read_text()]
    assert SOURCE == ["source_type", "source_location", "source_path"]
