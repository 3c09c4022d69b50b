"""The engine's operators over the test tables, one query each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracelake.functions import crypto, ids, json, paths
from tracelake.functions.time import unix_ms
from tracelake.operators import parity, parse, views
from tracelake.operators.attribution import attribute, summary
from tracelake.operators.parse import carry_forward, cumulative_to_delta
from tracelake.operators.store import Store, new_events, outcome
from tracelake.plans.commit_plan import events_are_usable, plan, should_record
from tracelake.schema import EVENT, REVISIONS, SOURCE, STATE, TABLES
from tracelake.sources import identities, snapshots
from tracelake.sources.shared import scratch
from tracelake.streaming import feed

#: The head and the tombstones that the adapters use.
HEAD = [("jsonl", "local", "/c/1.jsonl", 1, 0)]
STONES = [("session", "3", 0), ("session", "17", 0), ("source_path", "/c/2.jsonl", 0), ("project_root", "/r/4", 0), ("session", "/c/3.jsonl", 0)]
ROOTS = ["https://example.com/en", "http://example.com", "https://example.net/fr/", "/srv/a", "/srv/a/b"]


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def messages(spark: SparkSession, sf: str) -> DataFrame:
    """Message events of conversations."""
    c = F.col("conv_id")
    return _t(spark, sf, "conversations").select(
        (c * 1000 + F.col("turn")).alias("offset"), F.lit("jsonl").alias("source_type"), F.lit("local").alias("source_location"), F.concat(F.lit("/c/"), (c % 7).cast("string"), F.lit(".jsonl")).alias("source_path"),
        c.cast("string").alias("source_session_id"), F.col("turn").alias("seq"), F.when((c % 7 == 1) & (F.col("turn") % 2 == 0), 1).otherwise(0).cast("long").alias("source_revision"), F.lit(0).cast("long").alias("projection_revision"),
        F.concat(F.lit("/r/"), (c % 5).cast("string")).alias("project_root"), ids.actor(F.col("role")).alias("actor"), F.col("text").alias("content"), F.lit("message").alias("event_type"),
        F.when(c % 10 != 0, c * 60000 + F.col("turn") * 1000).alias("occurred_at_unix_ms"), c.alias("ingested_at"),
    )


def _seen(spark: SparkSession, sf: str) -> DataFrame:
    return views.visible(messages(spark, sf), spark.createDataFrame(HEAD, TABLES["current_head"]), spark.createDataFrame(STONES, TABLES["tombstones"]))


def usage(spark: SparkSession, sf: str) -> DataFrame:
    """Events as lines of a file a user: counters in props, a session at each signup, a model at each click."""
    k = F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(0))
    e = _t(spark, sf, "events").withColumn("k", k)
    line = W.partitionBy("user_id").orderBy("event_id")
    return e.select("event_id", F.col("user_id").cast("string").alias("file"), F.when(F.col("event_id") % 17 == 0, F.col("event_id").cast("string")).alias("session"), F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("m"), (F.col("event_id") % 3).cast("string"))).alias("model"), F.when(F.col("event_id") % 4 != 0, F.sum("k").over(line)).alias("total"), "ts")


def recent_sessions(spark, sf):
    return views.recent_sessions(_seen(spark, sf), 20)


def recent_sessions_since(spark, sf):
    t = F.col("event_id")
    raw = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("Z"))
    own = _t(spark, sf, "events").select(*(F.lit(v).alias(c) for c, v in zip(SOURCE, ("jsonl", "local", "/e.jsonl"), strict=True)), F.col("user_id").cast("string").alias("source_session_id"), unix_ms(F.when(t % 9 != 0, raw)).alias("occurred_at_unix_ms"))
    return views.recent_sessions(own, 50, 1704067200000)


def _page(df):
    return df.select("offset", *SOURCE, "source_session_id", "seq", ids.content_hash(F.col("content")).alias("content_hash"))


def pull_all(spark, sf):
    return _page(views.pull(messages(spark, sf), 5000, 200))


def pull_current(spark, sf):
    return _page(views.pull(_seen(spark, sf), 5000, 200))


def read_sessions_capped(spark, sf):
    specs = spark.createDataFrame([("jsonl", "local", f"/c/{s % 7}.jsonl", str(s), k) for k, s in enumerate((40, 8, 25, 3))], "source_type string, source_location string, source_path string, source_session_id string, list_pos long")
    return views.read_sessions(_seen(spark, sf), specs, 10).select("list_pos", "source_session_id", "seq", "content")


def read_session(spark, sf):
    own = messages(spark, sf)
    # the same path and session of another type and at another place
    both = own.unionByName(own.withColumns({"source_type": F.lit("codex"), "content": F.lit("of another type")})).unionByName(own.withColumns({"source_location": F.lit("wsl:U"), "content": F.lit("elsewhere")}))
    return views.read_session(both, spark.createDataFrame(HEAD, TABLES["current_head"]), "jsonl", "local", "/c/1.jsonl", "8").select("seq", "actor", "content")


def _versions(spark, sf):
    kind = F.when(F.col("lang") == "fr", "message").otherwise("config_snapshot")
    return _t(spark, sf, "documents").select(F.lit("jsonl").alias("source_type"), F.lit("local").alias("source_location"), F.col("source").alias("source_path"), F.col("doc_id").alias("offset"), ids.content_hash(F.col("text")).alias("hash"), kind.alias("event_type"), "lang", "n_chars")


def latest_snapshots(spark, sf):
    return views.latest_snapshots(_versions(spark, sf)).select("source_path", F.col("offset").alias("version"), "hash")


def active_snapshots(spark, sf):
    latest = views.latest_snapshots(_versions(spark, sf))
    probes = _t(spark, sf, "documents").groupBy(F.col("source").alias("source_path")).agg(F.max("n_chars").alias("n")).select("source_path", F.when(F.col("n") > 15000, "absent").when(F.col("n") > 10000, "unknown").when(F.col("n") > 8000, "dir").otherwise("file").alias("status"))
    return views.active_snapshots(latest, probes).select("source_path", F.col("offset").alias("version"))


def present_snapshots(spark, sf):
    """Snapshots of places named by language: one was not asked, one's question failed, others list their long files."""
    own = _versions(spark, sf).withColumns({"source_location": F.concat(F.lit("wsl:"), "lang"), "event_type": F.lit("config_snapshot")})
    asked = own.where("lang <> 'de'").select("source_location", (F.col("lang") != "fr").alias("answered")).distinct()
    found = own.groupBy("source_location", "source_path").agg(F.max("n_chars").alias("n")).where("n > 5000")
    return views.present_snapshots(views.latest_snapshots(own), asked, found).select("source_location", "source_path", F.col("offset").alias("version"))


def snapshot_changes(spark, sf):
    """Files of a source and language: what the last version changes against the last short one, that is stored."""
    own = _versions(spark, sf).withColumns({"source_path": F.concat_ws("/", "source_path", "lang"), "event_type": F.lit("config_snapshot"), "content_hash": F.col("hash"), "project_root": F.lit(None).cast("string"), "artifact_kind": F.lit("memory")})
    found = views.latest_snapshots(own)
    return snapshots.changed(found, views.latest_snapshots(own.where("n_chars < 1500"))).select("source_path", F.col("offset").alias("version"), "hash")


def _heads(spark, sf):
    """Head moves of sources: orders by customer, a rollback where urgent, a reparse where high."""
    o = _t(spark, sf, "orders")
    reason = F.when(F.col("o_orderpriority") == "1-URGENT", "rollback").when(F.col("o_orderpriority") == "2-HIGH", "reparse")
    line = W.partitionBy("o_custkey").orderBy("o_orderkey")
    o = o.select("o_custkey", "o_orderkey", reason.alias("reason")).where("reason is not null")
    o = o.withColumn("srev", F.count_if(F.col("reason") == "rollback").over(line.rowsBetween(W.unboundedPreceding, 0)))
    inside = W.partitionBy("o_custkey", "srev").orderBy("o_orderkey")
    return o.withColumn("prev", F.count_if(F.col("reason") == "reparse").over(inside.rowsBetween(W.unboundedPreceding, 0)))


def change_feed(spark, sf):
    h = _heads(spark, sf)
    line = W.partitionBy("o_custkey").orderBy("o_orderkey")
    log = h.select(F.col("o_orderkey").alias("seq"), F.col("o_custkey").alias("source_key"), F.coalesce(F.lag("srev").over(line), F.lit(0)).alias("old_source_revision"), F.coalesce(F.lag("prev").over(line), F.lit(0)).alias("old_projection_revision"), F.col("srev").alias("new_source_revision"), F.col("prev").alias("new_projection_revision"), "reason")
    return views.changes(log, 100, 300)


def usage_delta(spark, sf):
    own = carry_forward(usage(spark, sf), file=["file"], order="event_id", session="session", columns=["session"], start=F.col("file"))
    own = cumulative_to_delta(own, file=["file"], order="event_id", totals=["total"])
    return own.select("event_id", "segment", F.coalesce("session", "file").alias("session"), F.col("delta_total").alias("delta"))


def carried(spark, sf):
    own = carry_forward(usage(spark, sf), file=["file"], order="event_id", session="session", columns=["session", "model"], start=F.col("file"))
    return own.select("event_id", "model")


def _registry_of_r(spark):
    return spark.createDataFrame([("/r/1", "/r/1", "git"), ("/r/2", "/r/2", "marker")], "root_key string, root_path string, root_source string")


def claude_lines(spark, sf):
    """Conversations as lines: contents as text, with thinking, in a tool's result, with a tool's name; each fifth turn is meta."""
    c, t, role, text = F.col("conv_id"), F.col("turn"), F.col("role"), F.coalesce("text", F.lit(""))
    said, quoted = F.to_json(F.struct(F.lit("text").alias("type"), text.alias("text"))), F.regexp_replace(F.to_json(F.array(text)), r"^\[|\]$", "")
    cat = lambda *x: F.concat(*(F.lit(v) if isinstance(v, str) else v.cast("string") for v in x))
    kind = F.pmod(t, F.lit(4))
    content = F.when(kind == 0, quoted).when(kind == 1, cat('[{"type":"thinking","thinking":"hm ', role, '"},', said, "]")).when(kind == 2, cat('[{"type":"tool_result","content":[', said, "]}]")).otherwise(cat("[", said, ',{"type":"tool_use","name":"', role, '"}]'))
    use = F.when(role == "assistant", cat(',"usage":{"input_tokens":', t * 10, '.9,"output_tokens":-1,"cache_read_input_tokens":"7","cache_creation_input_tokens":', c, "}")).otherwise("")
    line = cat(
        '{"type":"', role, '","isMeta":', F.when(t % 5 == 4, "true").otherwise("false"), ',"timestamp":"2026-01-01T00:00:00Z"', F.when(c % 3 != 0, cat(',"sessionId":"', c, '"')).otherwise(""), ',"cwd":"/r/', c % 5, '/x","effort":"', F.when(t % 2 == 0, "high").otherwise(""),
        '","requestId":"r', c, '","message":{"id":"m', t, '","role":"', role, '","model":"M', c % 3, '","content":', content, use, "}}",
    )
    return _t(spark, sf, "conversations").select(F.lit("claude_code").alias("source_type"), F.lit("local").alias("source_location"), cat("/c/", c % 7, ".jsonl").alias("source_path"), (c * 1000 + t).alias("byte_start"), line.alias("line"))


def _parsed(events):
    return events.select("source_path", "seq", "source_session_id", "event_type", "actor", F.sha2("content", 256).alias("content_sha256"), "model", "effort", *(F.col(f"usage.{c}").alias(c) for c in ("input", "output", "cache_creation", "cache_read")), "message_id", "request_id", F.col("event_key.slot_ordinal").alias("slot"), "project_root", "project_root_source", "time_confidence")


def claude_events(spark, sf):
    return _parsed(parse.events(claude_lines(spark, sf), _registry_of_r(spark)))


def codex_lines(spark, sf):
    """Events as lines of a file a user: sessions, contexts, running totals, last usages and items."""
    k, kind = F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(0)), F.col("event_type")
    cat = lambda *x: F.concat(*(F.lit(v) if isinstance(v, str) else v.cast("string") for v in x))
    total = F.sum(k).over(W.partitionBy("user_id").orderBy("event_id"))
    count = lambda block, i, c, o: cat('{"type":"event_msg","payload":{"type":"token_count","info":{"', block, '":{"input_tokens":', i, ',"cached_input_tokens":', c, ',"output_tokens":', o, "}}}}")
    item = lambda *x: cat('{"type":"response_item","payload":{', *x, "}}")
    part = F.pmod(k, F.lit(4))
    line = (
        F.when(kind == "signup", cat('{"type":"session_meta","payload":{"id":"', F.col("event_id"), '","cwd":"/r/', k % 5, '"}}'))
        .when(kind == "click", cat('{"type":"turn_context","payload":{"', F.when(k % 2 == 0, "model").otherwise("model_slug"), '":"m', k % 3, '","collaboration_mode":{"reasoning_effort":"e', k % 2, '"}}}'))
        .when(kind == "purchase", count("total_token_usage", total * 3, total, total * 2))
        .when(kind == "view", count("last_token_usage", k, k + 5, F.lit(1)))
        .when(part == 0, item('"type":"message","role":"user","content":[{"type":"input_text","text":"e', k, '"}]'))
        .when(part == 1, item('"type":"function_call","name":"f', k, '"'))
        .when(part == 2, item('"type":"function_call_output","output":"', F.when(k % 8 == 2, " ").otherwise("out"), '"'))
        .otherwise(item('"type":"reasoning","encrypted_content":"z"'))
    )
    own = _t(spark, sf, "events").withColumn("line", line)
    return own.select(F.lit("codex").alias("source_type"), F.lit("local").alias("source_location"), cat("/u/", F.col("user_id"), ".jsonl").alias("source_path"), F.col("event_id").alias("byte_start"), "line")


def codex_events(spark, sf):
    return _parsed(parse.events(codex_lines(spark, sf), _registry_of_r(spark)))


def codex_batches(spark, sf):
    """The same in two batches, the second from the state that the first leaves."""
    own = codex_lines(spark, sf)
    middle = own.agg(F.expr("max(byte_start) div 2")).first()[0] or 0
    first, then, none = own.where(F.col("byte_start") <= middle), own.where(F.col("byte_start") > middle), spark.createDataFrame([], STATE)
    a = parse.events(first, _registry_of_r(spark), state=none)
    state = parse.end_state(first, first.groupBy(*SOURCE).agg(F.lit(middle).alias("end_byte")), none, a)
    path = scratch(spark, "state")
    state.write.parquet(path)
    return _parsed(a.unionByName(parse.events(then, _registry_of_r(spark), state=spark.read.schema(STATE).parquet(path))))


def event_key(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", ids.record_fingerprint(F.col("text")).alias("fingerprint"))


def _as_events(spark, sf):
    """Documents as events: a source's sessions are languages, and the length in hundreds is the seq."""
    return _versions(spark, sf).select(*SOURCE, F.col("lang").alias("source_session_id"), F.expr("n_chars div 100").alias("seq"), *(F.lit(0).cast("long").alias(c) for c in REVISIONS), F.col("offset").alias("_at"), F.col("offset").alias("doc_id"), "n_chars")


def dedup_insert(spark, sf):
    own = _as_events(spark, sf)
    return new_events(own, own.where("n_chars < 1000")).select("source_path", "source_session_id", "seq", F.col("doc_id").alias("first_doc"))


def tombstone_visibility(spark, sf):
    left = views.without_erased(messages(spark, sf), spark.createDataFrame(STONES, TABLES["tombstones"]))
    return left.groupBy("source_session_id").agg(F.count("*").alias("events"))


def head_filter(spark, sf):
    rows = _t(spark, sf, "lineitem").select(F.lit("t").alias("source_type"), F.lit("l").alias("source_location"), F.col("l_orderkey").cast("string").alias("source_path"), (F.col("l_linenumber") % 2).cast("long").alias("source_revision"), F.lit(0).cast("long").alias("projection_revision"))
    head = _t(spark, sf, "orders").where("o_orderstatus <> 'O'").select(F.lit("t").alias("source_type"), F.lit("l").alias("source_location"), F.col("o_orderkey").cast("string").alias("source_path"), F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).cast("long").alias("source_revision"), F.lit(0).cast("long").alias("projection_revision"))
    return views.current(rows, head).groupBy("source_path").agg(F.count("*").alias("events"))


def _projections(spark, sf):
    li = _t(spark, sf, "lineitem").select(F.lit("t").alias("source_type"), F.lit("l").alias("source_location"), F.col("l_orderkey").cast("string").alias("source_path"), (F.col("l_linenumber") % 2).cast("long").alias("source_revision"), (F.col("l_suppkey") % 2).cast("long").alias("projection_revision"))
    head = _t(spark, sf, "orders").select(F.lit("t").alias("source_type"), F.lit("l").alias("source_location"), F.col("o_orderkey").cast("string").alias("source_path"), (F.col("o_custkey") % 2).cast("long").alias("source_revision"), F.lit(1).cast("long").alias("projection_revision"))
    return li, head


def gc_candidates(spark, sf):
    li, head = _projections(spark, sf)
    ledger = li.distinct().withColumn("origin", F.when(F.col("projection_revision") == 0, "reparse").otherwise("append"))
    return views.gc_candidates(ledger, head, li).select("source_path", "source_revision", "projection_revision", "events")


def reparse_outcome(spark, sf):
    """A store that takes all conversations, then reparses of some files without their system turns and of others with one turn more."""
    store = Store(spark, scratch(spark, "store"), buckets=4)
    full = {f.name: F.lit(None).cast(f.dataType) for f in EVENT} | {"seq": F.col("offset")}
    own = messages(spark, sf).withColumn("more", F.lit(False))
    grown = own.unionByName(own.groupBy(*SOURCE, "source_session_id").agg((F.max("offset") + 500).alias("offset")).withColumn("more", F.lit(True)), allowMissingColumns=True)
    events = lambda df: df.select(*(full[f.name].alias(f.name) if f.name not in df.columns or f.name == "seq" else F.col(f.name) for f in EVENT))
    short = F.col("source_path") < "/c/4"
    reason = F.when(F.col("source_path") == "/c/6.jsonl", "rollback").when(F.col("source_path") == "/c/5.jsonl", "append").otherwise("reparse")
    store.append_events(events(own))
    batch = grown.where(F.when(short, (~F.col("more")) & ~F.col("actor").eqNullSafe("system")).otherwise(True))
    sources = own.select(*SOURCE).distinct().withColumn("reason", reason).withColumn("token", F.when(F.col("reason") != "append", F.col("source_path")))
    stats = store.apply_projection(sources, events(batch))
    seen = store.visible().groupBy(*SOURCE).agg(F.count("*").alias("visible"))
    return stats.join(seen, SOURCE, "left").select("source_path", "reason", "source_revision", "projection_revision", "before", "appended", "skipped_dup", "removed", "loses_events", "head_moved", "visible")


def apply_stats(spark, sf):
    """Line items as a batch of their orders' sources, returned ones erased, finished ones stored before."""
    key = lambda c: [F.lit("t").alias("source_type"), F.lit("l").alias("source_location"), F.col(c).cast("string").alias("source_path")]
    zero = F.lit(0).cast("long")
    how = F.when(F.col("o_orderpriority") == "1-URGENT", "rollback").when(F.col("o_orderpriority") == "2-HIGH", "reparse").otherwise("append")
    sources = _t(spark, sf, "orders").select(*key("o_orderkey"), how.alias("reason"), (F.col("o_orderstatus") == "P").alias("replayed"), zero.alias("old_source_revision"), zero.alias("old_projection_revision"))
    sources = sources.withColumns({"source_revision": F.when(F.col("reason") == "rollback", 1).otherwise(0).cast("long"), "projection_revision": F.when(F.col("reason") == "reparse", 1).otherwise(0).cast("long")})
    rows = _t(spark, sf, "lineitem").select(*key("l_orderkey"), F.col("l_returnflag").alias("source_session_id"), F.expr("l_linenumber % 3").cast("long").alias("seq"), F.col("l_linenumber").alias("_at"), "l_linestatus", F.lit("/r").alias("project_root"))
    batch = rows.join(sources.where("not replayed").select(*SOURCE, *REVISIONS), SOURCE)
    kept = views.without_erased(batch, spark.createDataFrame([("session", "R", 0)], TABLES["tombstones"]))
    old = rows.where("l_linestatus = 'F'").withColumns(dict.fromkeys(REVISIONS, zero))
    ledger = views.ledger_of(old.withColumn("ingested_at", zero))
    out = outcome(sources, batch, kept, new_events(kept, old), ledger)
    return out.select("source_path", "reason", "in_batch", "appended", "skipped_dup", "skipped_erased", "before", "head_moved", "loses_events", "removed")


def ledger_backfill(spark, sf):
    li, _ = _projections(spark, sf)
    ledger = views.ledger_of(li.withColumn("ingested_at", F.lit(None).cast("long")))
    head = views.heads_of(ledger).withColumn("is_head", F.lit(True))
    return ledger.join(head, [*SOURCE, *REVISIONS], "left").select("source_path", *REVISIONS, "origin", "created_at", "events", F.coalesce("is_head", F.lit(False)).alias("is_head"))


def distinct_roots(spark, sf):
    return views.distinct_roots(messages(spark, sf).withColumn("project_root", F.when(F.col("source_path") != "/c/3.jsonl", F.when(F.col("actor") == "system", "").otherwise(F.col("project_root")))))


def pull_broken(spark, sf):
    """Pages of events of which system turns don't open: where each page ends, and what it gives."""
    own = messages(spark, sf).withColumn("broken", F.coalesce(F.col("actor") == "system", F.lit(False)))
    out = None
    for since in (0, 5000, 10**9):
        page = views.pull(own, since, 100)
        row = views.page_end(page).crossJoin(views.whole(page).agg(F.count("*").alias("events"))).select(F.lit(since).cast("long").alias("since"), "*")  # a row each
        out = row if out is None else out.union(row)
    return out


def feed_replace(spark, sf):
    """A copy whose short sources are replaced whole by what is visible now."""
    copy = messages(spark, sf).withColumn("content", F.lit("old"))
    now = _seen(spark, sf)
    moved = now.groupBy(*SOURCE).agg(F.count("*").alias("n")).where("source_path < '/c/4'")
    return feed.replaced(copy, moved, now).groupBy("source_path").agg(F.count("*").alias("events"), F.count_if(F.col("content") == "old").alias("old"))


def path_forms(spark, sf):
    raw, mounts = F.col("raw"), [("/mnt/c", "C:\\"), ("/Srv", "S:\\data")]
    trimmed = paths.normalize_cwd(raw)
    spot = paths.reach(raw, host="windows", mounts=mounts)
    return _forms(spark, sf).select(
        "page_id", paths.mount_to_windows(raw, mounts).alias("windows"), paths.is_bare_linux(raw).alias("bare"), paths.distro_of_unc(raw).alias("distro"), paths.file_stem(raw).alias("stem"),
        spot["kind"].alias("reach_kind"), spot["distro"].alias("reach_distro"), spot["path"].alias("reach_path"), paths.openable(trimmed, paths.aliases(trimmed), host="windows").alias("host_form"),
    )


def unsigned_counts(spark, sf):
    """Numbers as transcripts may give them: whole, fractional, negative, as text, huge, missing."""
    k = F.get_json_object("props", "$.k")
    form = F.when(F.col("event_type") == "view", k).when(F.col("event_type") == "click", F.concat(k, F.lit(".75"))).when(F.col("event_type") == "error", F.concat(F.lit("-1"), k)).when(F.col("event_type") == "signup", F.concat(F.lit('"'), k, F.lit('"'))).otherwise(F.lit("null"))
    return _t(spark, sf, "events").select("event_id", json.count(json.parse(F.concat(F.lit('{"n":'), form, F.lit("}"))), "$.n").alias("n"))


def event_names(spark, sf):
    """Keys, tokens, associated data and readings of stored names."""
    e, c = _t(spark, sf, "events"), F.col
    path, seq = F.concat(F.lit("/é/"), c("user_id").cast("string")), c("event_id")
    known = F.when(c("event_type") != "view", F.concat(F.lit("fp"), seq.cast("string")))
    none = F.lit(0).cast("long")
    return e.select(
        "event_id", ids.dedup_key(F.lit("codex"), F.lit("local"), path, c("event_type"), seq).alias("dedup_key"),
        ids.projection_token(F.lit("codex"), F.lit("wsl:U"), path, known, F.lit(5), none, none, seq).alias("token"),
        F.hex(crypto.event_aad(F.lit("codex"), F.lit("local"), path, c("event_type"), seq, none, F.lit(1).cast("long"))).alias("aad"),
        F.hex(crypto.data_key_aad(F.lit("k1"), F.lit("codex"), F.lit("local"), path, F.lit(""))).alias("key_aad"),
        ids.root_source(c("event_type")).alias("root_source"), ids.legacy_status(F.when(c("event_type") == "view", "clean").when(c("event_type") == "click", "degraded").otherwise("poison_line")).alias("status"),
        ids.origin_url(F.concat(F.lit('[core]\n\tbare = false\n[remote "up"]\n\turl = no\n[remote "origin"]\n\tfetch = x\n\turl = git@h:o/'), seq.cast("string"), F.lit(".git \n"))).alias("origin"),
    )


def sealed_contents(spark, sf):
    """Contents sealed under a group's key: opened with it, with other associated data, and what the envelope says."""
    own = messages(spark, sf).withColumn("_key", F.unhex(F.sha2("source_path", 256)))
    aad = lambda seq: crypto.event_aad(*(F.col(c) for c in (*SOURCE, "source_session_id")), seq, *(F.col(c) for c in REVISIONS))
    own = own.withColumn("sealed", crypto.seal(F.col("content"), F.col("_key"), aad(F.col("seq")), key_id=F.col("source_path")))
    told = crypto.envelope(F.col("sealed"))
    return own.select("offset", F.sha2(crypto.open_sealed(F.col("sealed"), F.col("_key"), aad(F.col("seq"))), 256).alias("opened_sha256"), crypto.open_sealed(F.col("sealed"), F.col("_key"), aad(F.col("seq") + 1)).isNull().alias("other_fails"), told["version"].alias("version"), told["key_id"].alias("key_id"))


def commit_plan(spark, sf):
    i = F.col("event_id")
    quality = F.element_at(F.array(*map(F.lit, ("clean", "degraded", "poison_line", "unavailable"))), (i % 4 + 1).cast("int"))
    failed = F.when(quality == "unavailable", F.when(F.col("event_type") == "view", "stat").otherwise("read"))
    own = _t(spark, sf, "events").select("event_id", quality.alias("quality"), failed.alias("failed_at"), (i % 3).alias("events"), (i % 5 == 0).alias("rewritten"), (i % 7 == 0).alias("stale"), (i % 11 == 0).alias("full_reason"), (i % 2 == 0).alias("prior"))
    own = own.withColumns({"usable": events_are_usable(F.col("quality")), "recorded": should_record(F.col("quality"), F.col("failed_at"))})
    return plan(own).select("event_id", "usable", "recorded", "plan_index", "plan_store", "plan_cursor", "plan_sync", "plan_quality")


def _registry(spark, sf):
    own = _t(spark, sf, "pages").where(F.col("url").startswith("https://")).select(F.regexp_extract("url", "^(https?://[^/]+/[^/]+)", 1).alias("root_path")).where("root_path <> ''")
    host = _t(spark, sf, "pages").where(F.col("url").startswith("https://blog.")).select(F.regexp_extract("url", "^(https?://[^/]+)", 1).alias("root_path")).where("root_path <> ''")
    both = own.union(host).distinct()
    return both.select(paths.registry_key(F.col("root_path")).alias("root_key"), "root_path", F.when(F.length("root_path") % 2 == 0, "git").otherwise("marker").alias("root_source"))


def attribute_prefix(spark, sf):
    p = _t(spark, sf, "pages").select("page_id", F.regexp_replace("url", "[?].*$", "").alias("cwd"))
    return attribute(p, _registry(spark, sf)).select("page_id", "project_root", "project_root_source")


def attribution_summary(spark, sf):
    return summary(attribute_prefix(spark, sf).withColumn("project_root", F.when(F.col("project_root_source") != "unattributed", F.col("project_root"))))


def root_report(spark, sf):
    c = _t(spark, sf, "customer").join(_t(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    root = F.concat(F.lit("wsl:"), F.col("n_name"), F.lit(":/home/p"))
    reg = _t(spark, sf, "nation").select(root.alias("root_key"), root.alias("root_path"), F.lit("git").alias("root_source"))
    idn = c.where("c_acctbal >= 0").select(F.col("c_custkey").alias("id"), root.alias("project_root"), F.concat(F.lit("git:"), F.col("c_mktsegment")).alias("canonical_id"), F.lit(0).alias("first_seen_ms"), (F.col("c_custkey") % 97).alias("last_seen_ms"))
    probes = c.where("n_regionkey <> 1").select(root.alias("project_root"), F.element_at(F.array(*map(F.lit, ("resolved", "none", "odd"))), (F.col("c_custkey") % 3 + 1).cast("int")).alias("outcome"), F.col("c_custkey").alias("last_probe_ms"))
    return views.root_report(reg, idn, probes).select("root_key", "canonical_id", "verdict", F.array_join("aliases", "|").alias("aliases"), F.array_join("project_dirs", "|").alias("project_dirs"))


def identity_merge(spark, sf):
    c = _t(spark, sf, "customer").select((F.col("c_nationkey")).cast("string").alias("project_root"), F.col("c_mktsegment").alias("canonical_id"), F.col("c_custkey").alias("first_seen_ms"), (F.col("c_custkey") * 2).alias("last_seen_ms"))
    return views.merge_identities(c)


def identity_latest(spark, sf):
    c = _t(spark, sf, "customer")
    return identities.latest_of(c.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("string").alias("project_root"), F.col("c_mktsegment").alias("canonical_id"), F.lit(0).cast("long").alias("first_seen_ms"), (F.col("c_custkey") % 97).alias("last_seen_ms")))


def normalize_time(spark, sf):
    i = F.col("event_id")
    ahead = F.col("ts") + F.expr("interval 8 hours")
    z = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("Z"))
    zoned = F.concat(F.date_format(ahead, "yyyy-MM-dd HH:mm:ss,SSS"), F.lit("+0800"))
    raw = F.when(i % 4 == 0, z).when(i % 4 == 1, zoned).when(i % 4 == 2, F.date_format("ts", "yyyy-MM-dd't'HH:mm")).otherwise(F.date_format("ts", "yyyy-MM-dd"))
    return _t(spark, sf, "events").select("event_id", unix_ms(raw).alias("ms"))


def _forms(spark, sf):
    i = F.col("page_id")
    tail = F.regexp_extract("url", "^https?://[^/]+/([^?]*)", 1)
    raw = F.when(i % 5 == 0, F.concat(F.lit("C:\\Work\\"), F.replace(tail, F.lit("/"), F.lit("\\")), F.lit("\\"))).when(i % 5 == 1, F.concat(F.lit("\\\\wsl$\\Ubuntu\\home\\"), tail)).when(i % 5 == 2, F.concat(F.lit("  wsl:Deb:/home/"), tail)).when(i % 5 == 3, F.concat(F.lit("/mnt/c/Work/"), tail, F.lit("//"))).otherwise(F.concat(F.lit("/Srv/"), tail))
    return _t(spark, sf, "pages").select("page_id", raw.alias("raw"))


def normalize_path(spark, sf):
    cwd = paths.normalize_cwd(F.col("raw"))
    return _forms(spark, sf).select("page_id", cwd.alias("cwd"), paths.registry_key(F.col("raw")).alias("root_key"), paths.workspace_location(cwd, F.lit("local")).alias("location"), paths.encode_project_dir(cwd).alias("encoded"))


def remote_url(spark, sf):
    i = F.col("page_id")
    host = F.regexp_extract("url", "^https?://([^/]+)/([^?]*)", 1)
    name = F.regexp_extract("url", "^https?://([^/]+)/([^?]*)", 2)
    raw = F.when(i % 3 == 0, F.concat(F.lit("git@"), host, F.lit(":O/"), name, F.lit(".git"))).when(i % 3 == 1, F.concat(F.lit("https://u:p@"), host, F.lit("/O/"), name, F.lit(".git/"))).otherwise(F.concat(F.lit("ssh://"), host, F.lit("/O/"), name))
    return _t(spark, sf, "pages").select("page_id", ids.normalize_remote(raw).alias("remote"))


def extract_text(spark, sf):
    said = F.to_json(F.struct(F.lit("text").alias("type"), F.col("text")))
    body = F.concat(said, F.lit(","), F.to_json(F.struct(F.lit("tool_use").alias("type"), F.col("role").alias("text"))))
    inside = F.concat(F.lit('{"type":"search_result","content":['), body, F.lit("]}"))
    outside = F.concat(F.lit('{"type":"tool_result","content":['), inside, F.lit("]}"))
    deepest = F.concat(F.lit('{"content":[' * 5), outside, F.lit("]}" * 5))
    level = F.pmod("turn", F.lit(4))
    blocks = F.when(level == 1, inside).when(level == 2, outside).when(level == 3, deepest).otherwise(body)
    content = F.concat(F.lit("["), blocks, F.lit(',{"type":"input_text","text":"tail"}]'))
    json.allow_repeated_keys(spark)
    return _t(spark, sf, "conversations").select("conv_id", "turn", json.text(json.parse(content)).alias("text"))


def store_status(spark, sf):
    return views.status(messages(spark, sf))


def parity_by_combo(spark, sf):
    o = _t(spark, sf, "orders")
    k = F.col("o_orderkey")
    none = F.lit(None).cast("string")
    fact = lambda shift, cwd: [F.col("o_orderpriority").alias("provider"), F.lit("local").alias("location"), F.col("o_custkey").cast("string").alias("source_path"), k.alias("seq"), F.lit("s").alias("session_id"), F.col("o_orderstatus").alias("model"), none.alias("effort"), cwd.alias("cwd"), none.alias("project_root"), (k + shift).alias("input_tokens"), *(F.lit(0).cast("long").alias(c) for c in ("output_tokens", "cache_creation_tokens", "cache_read_tokens")), none.alias("message_id"), none.alias("request_id")]
    old = o.where("o_totalprice < 300000").select(*fact(F.lit(0), F.lit("/a")))
    new = o.where("o_totalprice > 50000").select(*fact(F.when(k % 29 == 0, 1).otherwise(0), F.when(k % 31 == 0, "/b").otherwise("/a")))
    files = o.select(F.col("o_custkey").cast("string").alias("source_path")).distinct().select("source_path", F.lit(1).alias("old_size"), F.when(F.col("source_path").cast("long") % 2 == 0, 2).otherwise(1).alias("new_size"))
    return parity.report(parity.align(old, new, files))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        recent_sessions, recent_sessions_since, pull_all, pull_current, pull_broken, read_sessions_capped, read_session, latest_snapshots, active_snapshots, present_snapshots, snapshot_changes, change_feed, feed_replace, usage_delta,
        claude_events, codex_events, codex_batches, event_key, event_names, dedup_insert, tombstone_visibility, head_filter, gc_candidates, reparse_outcome, apply_stats, ledger_backfill, distinct_roots, commit_plan,
        attribute_prefix, attribution_summary, root_report, identity_merge, identity_latest, normalize_time, normalize_path, path_forms, remote_url, extract_text, unsigned_counts, sealed_contents, store_status, parity_by_combo,
    )
    return {f.__name__: f for f in own} | {"carry_forward": carried}
