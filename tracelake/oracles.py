"""DuckDB SQL that each query of :mod:`tracelake.queries` must agree with, written apart from it."""

_CE = r"""ce AS (SELECT conv_id*1000+turn AS "offset", 'jsonl' AS source_type, 'local' AS source_location, '/c/'||(conv_id%7)||'.jsonl' AS source_path,
  conv_id::VARCHAR AS source_session_id, turn AS seq, CASE WHEN conv_id%7=1 AND turn%2=0 THEN 1 ELSE 0 END AS srev, '/r/'||(conv_id%5) AS project_root,
  CASE WHEN role IN ('user','assistant','tool','system') THEN role END AS actor, text AS content,
  CASE WHEN conv_id%10<>0 THEN conv_id*60000+turn*1000 END AS ms, conv_id AS ingested_at FROM conversations),
 stones(scope,k) AS (VALUES ('session','3'),('session','17'),('source_path','/c/2.jsonl'),('project_root','/r/4'),('session','/c/3.jsonl')),
 alive AS (SELECT * FROM ce WHERE NOT EXISTS (SELECT 1 FROM stones WHERE (scope='session' AND k=source_session_id) OR (scope='source_path' AND k=source_path) OR (scope='project_root' AND k=project_root))),
 seen AS (SELECT * FROM alive WHERE srev = CASE WHEN source_path='/c/1.jsonl' THEN 1 ELSE 0 END)"""
_SRC = "source_type, source_location, source_path"
_US = r"""us AS (SELECT event_id, user_id::VARCHAR AS file, CASE WHEN event_id%17=0 THEN event_id::VARCHAR END AS session, CASE WHEN event_id%5=0 THEN 'm'||(event_id%3) END AS model,
  CASE WHEN event_id%4<>0 THEN sum(coalesce(json_extract_string(props,'$.k')::BIGINT,0)) OVER (PARTITION BY user_id ORDER BY event_id)::BIGINT END AS total FROM events),
 c1 AS (SELECT *, coalesce(last_value(session IGNORE NULLS) OVER (PARTITION BY file ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), file) AS before FROM us),
 c2 AS (SELECT *, sum(CASE WHEN session IS NOT NULL AND session IS DISTINCT FROM before THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY event_id)::BIGINT AS segment FROM c1)"""
_VE = "ve AS (SELECT source AS source_path, doc_id, lang, n_chars, 'sha256:'||sha256(text) AS hash FROM documents)"
_HM = "CASE WHEN regexp_matches({0}, '[^ \\t\\n\\x0B\\f\\r]') THEN {0} END"
_ATT = "CASE WHEN {0} IN (1,2) THEN '/r/'||{0} ELSE {1} END AS project_root, CASE {0} WHEN 1 THEN 'git' WHEN 2 THEN 'marker' ELSE 'unattributed' END AS project_root_source"
_CL = f"""cl AS (SELECT *, turn%4 AS kind, turn%5=4 AS meta, {_HM.format("coalesce(text,'')")} AS said FROM conversations),
 l0 AS (SELECT *, '[Tool: '||role||']' AS tool FROM cl),
 l1 AS (SELECT conv_id, turn, role, 0 AS slot, 'thinking' AS event_type, 'assistant' AS actor, 'hm '||role AS content, NULL AS model FROM l0 WHERE NOT meta AND kind=1
  UNION ALL SELECT conv_id, turn, role, 1, 'message', CASE WHEN kind=2 AND role='user' THEN 'tool' WHEN role IN ('user','assistant','tool','system') THEN role END, CASE WHEN kind=3 THEN coalesce(said||chr(10),'')||tool ELSE said END, 'M'||(conv_id%3) FROM l0 WHERE NOT meta AND (kind=3 OR said IS NOT NULL)
  UNION ALL SELECT conv_id, turn, role, 2, 'usage', 'assistant', NULL, 'M'||(conv_id%3) FROM l0 WHERE role='assistant')
 SELECT '/c/'||(conv_id%7)||'.jsonl' AS source_path, row_number() OVER (PARTITION BY conv_id%7 ORDER BY conv_id, turn, slot)-1 AS seq, CASE WHEN conv_id%3<>0 THEN conv_id ELSE conv_id%7 END::VARCHAR AS source_session_id, event_type, actor, sha256(content) AS content_sha256, model,
  CASE WHEN slot=2 AND turn%2=0 THEN 'high' END AS effort, CASE WHEN slot=2 THEN turn*10 END AS input, CASE WHEN slot=2 THEN 0 END AS output, CASE WHEN slot=2 THEN conv_id END AS cache_creation, CASE WHEN slot=2 THEN 0 END AS cache_read,
  CASE WHEN slot=2 THEN 'm'||turn END AS message_id, CASE WHEN slot=2 THEN 'r'||conv_id END AS request_id, 0 AS slot, {_ATT.format("(conv_id%5)", "'/r/'||(conv_id%5)||'/x'")}, 'high' AS time_confidence FROM l1"""
_CX = f"""cx AS (SELECT event_id, user_id, event_type AS t, coalesce(json_extract_string(props,'$.k')::BIGINT,0) AS k FROM events),
 x0 AS (SELECT *, sum(k) OVER (PARTITION BY user_id ORDER BY event_id)::BIGINT AS s, count(*) FILTER (t='signup') OVER (PARTITION BY user_id ORDER BY event_id) AS seg FROM cx),
 x1 AS (SELECT *, last_value(CASE WHEN t='click' THEN 'm'||(k%3) END IGNORE NULLS) OVER w AS model, last_value(CASE WHEN t='click' THEN 'e'||(k%2) END IGNORE NULLS) OVER w AS effort, last_value(CASE WHEN t='signup' THEN event_id END IGNORE NULLS) OVER w AS session, last_value(CASE WHEN t='signup' THEN k%5 END IGNORE NULLS) OVER w AS r,
  greatest(s-coalesce(last_value(CASE WHEN t='purchase' THEN s END IGNORE NULLS) OVER (PARTITION BY user_id, seg ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0),0) AS d FROM x0 WINDOW w AS (PARTITION BY user_id, seg ORDER BY event_id)),
 x2 AS (SELECT *, CASE WHEN t IN ('purchase','view') THEN 'usage' WHEN k%4=0 THEN 'message' WHEN k%4=1 THEN 'tool_use' WHEN k%4=2 THEN 'tool_result' ELSE 'thinking' END AS event_type FROM x1 WHERE t='view' OR (t='purchase' AND d>0) OR (t='error' AND NOT (k%4=2 AND k%8=2)))
 SELECT '/u/'||user_id||'.jsonl' AS source_path, row_number() OVER (PARTITION BY user_id ORDER BY event_id)-1 AS seq, coalesce(session, user_id)::VARCHAR AS source_session_id, event_type, CASE event_type WHEN 'message' THEN 'user' WHEN 'tool_result' THEN 'tool' ELSE 'assistant' END AS actor,
  CASE event_type WHEN 'message' THEN sha256('e'||k) WHEN 'tool_use' THEN sha256('[Tool: f'||k||']') WHEN 'tool_result' THEN sha256('out') END AS content_sha256, model, effort, CASE t WHEN 'purchase' THEN 2*d WHEN 'view' THEN 0 END AS input, CASE t WHEN 'purchase' THEN 2*d WHEN 'view' THEN 1 END AS output,
  CASE WHEN t IN ('purchase','view') THEN 0 END AS cache_creation, CASE t WHEN 'purchase' THEN d WHEN 'view' THEN k END AS cache_read, NULL AS message_id, NULL AS request_id, 0 AS slot, CASE WHEN r IN (1,2) THEN '/r/'||r ELSE '/r/'||r END AS project_root, CASE WHEN r=1 THEN 'git' WHEN r=2 THEN 'marker' WHEN r IS NOT NULL THEN 'unattributed' END AS project_root_source, 'low' AS time_confidence FROM x2"""
_AE = "ae AS (SELECT source AS source_path, lang AS source_session_id, n_chars//100 AS seq, doc_id, n_chars FROM documents)"
_HE = r"""h0 AS (SELECT o_custkey, o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'rollback' WHEN '2-HIGH' THEN 'reparse' END AS reason FROM orders WHERE o_orderpriority IN ('1-URGENT','2-HIGH')),
 h1 AS (SELECT *, count(*) FILTER (reason='rollback') OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS srev FROM h0),
 h2 AS (SELECT *, count(*) FILTER (reason='reparse') OVER (PARTITION BY o_custkey, srev ORDER BY o_orderkey) AS prev FROM h1)"""
_RG = r"""rg AS (SELECT root, lower_key AS k, CASE WHEN length(root)%2=0 THEN 'git' ELSE 'marker' END AS src FROM (
  SELECT DISTINCT root, regexp_replace(root,'/+$','') AS lower_key FROM (SELECT regexp_extract(url,'^(https?://[^/]+/[^/]+)',1) AS root FROM pages WHERE starts_with(url,'https://') UNION ALL SELECT regexp_extract(url,'^(https?://[^/]+)',1) FROM pages WHERE starts_with(url,'https://blog.')) WHERE root<>'')),
 pg AS (SELECT page_id, regexp_replace(url,'[?].*$','') AS p FROM pages),
 hit AS (SELECT page_id, max_by(root, length(k)) AS root, max_by(src, length(k)) AS src FROM pg JOIN rg ON regexp_replace(p,'/+$','')=k OR starts_with(p, k||'/') GROUP BY page_id),
 att AS (SELECT pg.page_id, coalesce(root, p) AS project_root, coalesce(src,'unattributed') AS project_root_source FROM pg LEFT JOIN hit USING (page_id))"""
_FO = r"""f0 AS (SELECT page_id, regexp_extract(url,'^https?://[^/]+/([^?]*)',1) AS tail FROM pages),
 f1 AS (SELECT page_id, CASE page_id%5 WHEN 0 THEN 'C:\Work\'||replace(tail,'/','\')||'\' WHEN 1 THEN '\\wsl$\Ubuntu\home\'||tail WHEN 2 THEN 'wsl:Deb:/home/'||tail WHEN 3 THEN '/mnt/c/Work/'||tail||'//' ELSE '/Srv/'||tail END AS raw, tail FROM f0)"""


def oracle_sql() -> dict[str, str]:
    recent = f"""SELECT {_SRC}, source_session_id, max(ms) AS last_ms, min(ms) AS first_ms, count(*) AS event_count FROM {{}} GROUP BY ALL ORDER BY last_ms DESC NULLS LAST, source_path DESC, source_session_id DESC LIMIT {{}}"""
    page = f"""SELECT "offset", {_SRC}, source_session_id, seq, 'sha256:'||sha256(content) AS content_hash FROM {{}} WHERE "offset">5000 ORDER BY "offset" LIMIT 200"""
    return {
        "recent_sessions": f"WITH {_CE} " + recent.format("seen", 20),
        "recent_sessions_since": "WITH e AS (SELECT 'jsonl' AS source_type, 'local' AS source_location, '/e.jsonl' AS source_path, user_id::VARCHAR AS source_session_id, CASE WHEN event_id%9<>0 THEN epoch_us(ts)//1000 END AS ms FROM events) " + recent.format("(SELECT * FROM e WHERE ms>=1704067200000)", 50),
        "pull_all": f"WITH {_CE} " + page.format("ce"),
        "pull_current": f"WITH {_CE} " + page.format("seen"),
        "read_sessions_capped": f"WITH {_CE}, specs(source_session_id,list_pos) AS (VALUES ('40',0),('8',1),('25',2),('3',3)) SELECT list_pos::BIGINT AS list_pos, source_session_id, seq, content FROM seen JOIN specs USING (source_session_id) ORDER BY list_pos, seq, \"offset\" LIMIT 10",
        "read_session": f"WITH {_CE} SELECT seq, actor, content FROM ce WHERE source_session_id='8' AND srev=1",
        "active_snapshots": f"WITH {_VE}, n AS (SELECT source_path, max(n_chars) AS n FROM ve GROUP BY ALL), l AS (SELECT source_path, max(doc_id) AS version FROM ve WHERE lang<>'fr' GROUP BY ALL) SELECT l.* FROM l JOIN n USING (source_path) WHERE n<=8000 OR (n>10000 AND n<=15000)",
        "present_snapshots": f"WITH {_VE}, l AS (SELECT 'wsl:'||lang AS source_location, source_path, max(doc_id) AS version, max(n_chars) AS n, lang FROM ve GROUP BY ALL) SELECT source_location, source_path, version FROM l WHERE lang IN ('de','fr') OR n>5000",
        "identity_latest": "SELECT c_nationkey::VARCHAR AS project_root, arg_max(c_mktsegment, c_custkey%97*1000000000+c_custkey) AS canonical_id, 0::BIGINT AS first_seen_ms, max(c_custkey%97) AS last_seen_ms FROM customer GROUP BY ALL",
        "claude_events": f"WITH {_CL}",
        "codex_events": f"WITH {_CX}",
        "codex_batches": f"WITH {_CX}",
        "ledger_backfill": "WITH p AS (SELECT l_orderkey::VARCHAR AS source_path, (l_linenumber%2)::BIGINT AS source_revision, (l_suppkey%2)::BIGINT AS projection_revision, count(*) AS events FROM lineitem GROUP BY ALL) SELECT *, 'unknown' AS origin, 0::BIGINT AS created_at, row_number() OVER (PARTITION BY source_path ORDER BY source_revision DESC, projection_revision DESC)=1 AS is_head FROM p",
        "distinct_roots": f"WITH {_CE} SELECT DISTINCT project_root FROM ce WHERE source_path<>'/c/3.jsonl' AND actor IS DISTINCT FROM 'system'",
        "pull_broken": f"WITH {_CE}, s(since) AS (VALUES (0::BIGINT),(5000),(1000000000)), p AS (SELECT since, \"offset\", actor FROM s JOIN ce ON \"offset\">since QUALIFY row_number() OVER (PARTITION BY since ORDER BY \"offset\")<=100) SELECT since, max(\"offset\") AS max_scanned_offset, count(*) FILTER (\"offset\" IS NOT NULL AND actor IS DISTINCT FROM 'system') AS events FROM s LEFT JOIN p USING (since) GROUP BY since",
        "feed_replace": f"WITH {_CE}, m AS (SELECT DISTINCT source_path FROM seen WHERE source_path<'/c/4'), b AS (SELECT source_path, 0 AS old FROM seen SEMI JOIN m USING (source_path) UNION ALL SELECT source_path, 1 FROM ce ANTI JOIN m USING (source_path)) SELECT source_path, count(*) AS events, sum(old)::BIGINT AS old FROM b GROUP BY ALL",
        "path_forms": rf"""WITH {_FO} SELECT page_id, CASE page_id%5 WHEN 3 THEN 'C:\Work\'||replace(tail,'/','\')||'\\' WHEN 4 THEN 'S:\data\'||replace(tail,'/','\') END AS windows, page_id%5=4 AS bare, CASE WHEN page_id%5=1 THEN 'Ubuntu' END AS distro,
          (SELECT CASE WHEN m='' THEN CASE page_id%5 WHEN 2 THEN '  ' ELSE '' END||raw ELSE m END FROM (SELECT regexp_replace(regexp_extract(raw,'([^/\\]*)$',1),'(.)\.[^.]*$','\1') AS m)) AS stem, CASE page_id%5 WHEN 1 THEN 'wsl' WHEN 2 THEN 'wsl' WHEN 4 THEN 'unknown' ELSE 'local' END AS reach_kind, CASE page_id%5 WHEN 1 THEN 'Ubuntu' WHEN 2 THEN 'Deb' END AS reach_distro,
          CASE page_id%5 WHEN 1 THEN '/home/'||tail WHEN 2 THEN '/home/'||tail WHEN 3 THEN 'C:\Work\'||replace(tail,'/','\')||'\\' ELSE raw END AS reach_path, CASE page_id%5 WHEN 0 THEN raw WHEN 1 THEN '\\wsl.localhost\Ubuntu\home\'||replace(tail,'/','\') WHEN 2 THEN '\\wsl.localhost\Deb\home\'||replace(tail,'/','\') END AS host_form FROM f1""",
        "unsigned_counts": "SELECT event_id, CASE WHEN event_type IN ('view','click') THEN coalesce(json_extract_string(props,'$.k')::BIGINT,0) ELSE 0 END AS n FROM events",
        "event_names": r"""WITH e AS (SELECT event_id, event_type, '/é/'||user_id AS p, CASE WHEN event_type<>'view' THEN 'fp'||event_id END AS fp FROM events), z AS (SELECT *, 'codex' AS ty, 'local' AS lo FROM e)
          SELECT event_id, 'codex|local|'||p||'|'||event_type||'|'||event_id AS dedup_key, 'v1|codex|wsl:U|'||octet_length(encode(p))||':'||p||'|'||octet_length(encode(coalesce(fp,'nofp')))||':'||coalesce(fp,'nofp')||'|5|0|0-'||event_id AS token,
          hex('tracelake:event:v2')||'0000000000000005'||hex(ty)||'0000000000000005'||hex(lo)||printf('%016X',octet_length(encode(p)))||hex(p)||printf('%016X',octet_length(encode(event_type)))||hex(event_type)||'0000000000000008'||printf('%016X',event_id)||'00000000000000080000000000000000'||'00000000000000080000000000000001' AS aad,
          hex('tracelake:data-key:v1')||'0000000000000002'||hex('k1')||'0000000000000005'||hex(ty)||'0000000000000005'||hex(lo)||printf('%016X',octet_length(encode(p)))||hex(p)||'0000000000000000' AS key_aad,
          'scan' AS root_source, CASE event_type WHEN 'view' THEN 'ok' WHEN 'click' THEN 'partial' ELSE 'error' END AS status, 'git@h:o/'||event_id||'.git' AS origin FROM z""",
        "sealed_contents": f"WITH {_CE} SELECT \"offset\", sha256(content) AS opened_sha256, true AS other_fails, 'sv2' AS version, source_path AS key_id FROM ce",
        "latest_snapshots": f"WITH {_VE} SELECT source_path, doc_id AS version, hash FROM ve WHERE lang<>'fr' QUALIFY row_number() OVER (PARTITION BY source_path ORDER BY doc_id DESC)=1",
        "snapshot_changes": f"WITH {_VE}, a AS (SELECT source_path||'/'||lang AS source_path, max(doc_id) AS version, arg_max(hash, doc_id) AS hash, arg_max(hash, doc_id) FILTER (n_chars<1500) AS old FROM ve GROUP BY source_path, lang) SELECT source_path, version, hash FROM a WHERE hash IS DISTINCT FROM old",
        "change_feed": f"WITH {_HE} SELECT * FROM (SELECT o_orderkey AS seq, o_custkey AS source_key, coalesce(lag(srev) OVER w,0) AS old_source_revision, coalesce(lag(prev) OVER w,0) AS old_projection_revision, srev AS new_source_revision, prev AS new_projection_revision, reason FROM h2 WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)) WHERE seq>100 ORDER BY seq LIMIT 300",
        "usage_delta": f"WITH {_US} SELECT event_id, segment, coalesce(last_value(session IGNORE NULLS) OVER (PARTITION BY file, segment ORDER BY event_id), file) AS session, greatest(CASE WHEN total IS NULL THEN 0 ELSE total - coalesce(last_value(total IGNORE NULLS) OVER (PARTITION BY file, segment ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) END, 0)::BIGINT AS delta FROM c2",
        "carry_forward": f"WITH {_US} SELECT event_id, last_value(model IGNORE NULLS) OVER (PARTITION BY file, segment ORDER BY event_id) AS model FROM c2",
        "event_key": r"SELECT doc_id, substr(sha256(regexp_replace(text,'^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$','','g')),1,16) AS fingerprint FROM documents",
        "dedup_insert": f"WITH {_AE} SELECT source_path, source_session_id, seq, min(doc_id) AS first_doc FROM ae a WHERE NOT EXISTS (SELECT 1 FROM ae b WHERE b.n_chars<1000 AND b.source_path=a.source_path AND b.source_session_id=a.source_session_id AND b.seq=a.seq) GROUP BY source_path, source_session_id, seq",
        "tombstone_visibility": f"WITH {_CE} SELECT source_session_id, count(*) AS events FROM alive GROUP BY ALL",
        "head_filter": "SELECT l_orderkey::VARCHAR AS source_path, count(*) AS events FROM lineitem LEFT JOIN (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 ELSE 0 END AS r FROM orders WHERE o_orderstatus<>'O') ON o_orderkey=l_orderkey WHERE l_linenumber%2=coalesce(r,0) GROUP BY l_orderkey",
        "gc_candidates": "WITH p AS (SELECT l_orderkey, l_linenumber%2 AS s, l_suppkey%2 AS q FROM lineitem) SELECT l_orderkey::VARCHAR AS source_path, s::BIGINT AS source_revision, q::BIGINT AS projection_revision, count(*) AS events FROM p JOIN orders ON o_orderkey=l_orderkey WHERE q=0 AND (s, q) IS DISTINCT FROM (o_custkey%2, 1) AND s=o_custkey%2 GROUP BY ALL",
        "reparse_outcome": f"""WITH {_CE}, s AS (SELECT source_path, count(*) AS n, count(*) FILTER (actor IS DISTINCT FROM 'system') AS m, count(DISTINCT source_session_id) AS c FROM ce GROUP BY ALL), r AS (SELECT *, CASE source_path WHEN '/c/6.jsonl' THEN 'rollback' WHEN '/c/5.jsonl' THEN 'append' ELSE 'reparse' END AS reason, CASE WHEN source_path<'/c/4' THEN m ELSE n+c END AS k FROM s)
          SELECT source_path, reason, CASE reason WHEN 'rollback' THEN 1 ELSE 0 END::BIGINT AS source_revision, CASE reason WHEN 'reparse' THEN 1 ELSE 0 END::BIGINT AS projection_revision, n AS before, CASE reason WHEN 'append' THEN c ELSE k END AS appended, CASE reason WHEN 'append' THEN n ELSE 0 END AS skipped_dup, CASE WHEN reason='reparse' AND k>=n THEN n ELSE 0 END AS removed, reason='reparse' AND k<n AS loses_events, reason<>'append' AS head_moved, k AS visible FROM r""",
        "apply_stats": """WITH o AS (SELECT o_orderkey AS k, CASE o_orderpriority WHEN '1-URGENT' THEN 'rollback' WHEN '2-HIGH' THEN 'reparse' ELSE 'append' END AS reason, o_orderstatus='P' AS rp FROM orders),
          b AS (SELECT l_orderkey AS k, l_returnflag AS f, l_linenumber%3 AS s, l_linestatus='F' AS old FROM lineitem), q AS (SELECT k, count(*) FILTER (old) AS before FROM b GROUP BY k),
          n AS (SELECT k, count(*) AS appended FROM (SELECT DISTINCT b.k, f, s FROM b JOIN o USING (k) WHERE NOT rp AND f<>'R' AND (reason<>'append' OR NOT EXISTS (SELECT 1 FROM b c WHERE c.old AND c.k=b.k AND c.f=b.f AND c.s=b.s))) GROUP BY k),
          i AS (SELECT k, count(*) AS in_batch, count(*) FILTER (f='R') AS er FROM b JOIN o USING (k) WHERE NOT rp GROUP BY k),
          z AS (SELECT o.*, coalesce(in_batch,0) AS in_batch, coalesce(er,0) AS er, coalesce(appended,0) AS appended, coalesce(before,0) AS before, NOT rp AND reason<>'append' AS hm FROM o LEFT JOIN i USING (k) LEFT JOIN n USING (k) LEFT JOIN q USING (k))
          SELECT k::VARCHAR AS source_path, reason, in_batch, appended, in_batch-er-appended AS skipped_dup, er AS skipped_erased, before, hm AS head_moved, hm AND reason='reparse' AND appended<before AS loses_events, CASE WHEN hm AND reason='reparse' AND appended>=before THEN before ELSE 0 END AS removed FROM z""",
        "commit_plan": """WITH o AS (SELECT event_id, ['clean','degraded','poison_line','unavailable'][event_id%4+1] AS q, event_id%3 AS n, event_id%5=0 AS rw, event_id%7=0 AS st, event_id%11=0 AS fu, event_id%2=0 AS pr, event_type AS t FROM events),
          d AS (SELECT *, CASE WHEN q='degraded' AND n=0 THEN 1 WHEN q='unavailable' THEN 2 WHEN q='poison_line' THEN 3 WHEN rw AND pr THEN 4 WHEN st AND pr THEN 5 WHEN rw OR st OR fu OR q='degraded' THEN 6 ELSE 7 END AS c FROM o)
          SELECT event_id, q IN ('clean','degraded') AS usable, NOT (q='unavailable' AND t='view') AS recorded, CASE WHEN c<=3 THEN 'preserve' WHEN c=7 THEN 'append_facts' ELSE 'replace_file' END AS plan_index, ['preserve','preserve','preserve','rollback','reparse','append','append'][c] AS plan_store,
          CASE WHEN c<=3 THEN 'freeze' ELSE 'advance' END AS plan_cursor, CASE WHEN c<=3 THEN 'hold' ELSE 'advance' END AS plan_sync, CASE c WHEN 2 THEN 'unknown' ELSE q END AS plan_quality FROM d""",
        "attribute_prefix": f"WITH {_RG} SELECT * FROM att",
        "attribution_summary": f"WITH {_RG} SELECT CASE WHEN project_root_source<>'unattributed' THEN project_root END AS project_root, project_root_source, count(*) AS events FROM att GROUP BY ALL",
        "root_report": r"""WITH c AS (SELECT c_custkey AS id, 'wsl:'||n_name||':/home/p' AS root, 'git:'||c_mktsegment AS cid, n_regionkey AS n, c_acctbal AS bal FROM customer JOIN nation ON c_nationkey=n_nationkey),
          i AS (SELECT root, arg_max(cid, id%97*1000000000+id) AS canonical_id FROM c WHERE bal>=0 GROUP BY root), p AS (SELECT root, arg_max(['resolved','none','odd'][id%3+1], id) AS o FROM c WHERE n<>1 GROUP BY root)
          SELECT 'wsl:'||n_name||':/home/p' AS root_key, canonical_id, CASE WHEN o IN ('resolved','none','failed') THEN o WHEN o IS NOT NULL THEN 'unresolved' ELSE 'not_probed' END AS verdict, '\\wsl.localhost\'||n_name||'\home\p' AS aliases, '-home-p|--wsl.localhost-'||n_name||'-home-p' AS project_dirs
          FROM nation LEFT JOIN i ON i.root='wsl:'||n_name||':/home/p' LEFT JOIN p ON p.root='wsl:'||n_name||':/home/p'""",
        "identity_merge": "SELECT c_nationkey::VARCHAR AS project_root, c_mktsegment AS canonical_id, min(c_custkey) AS first_seen_ms, max(c_custkey*2) AS last_seen_ms FROM customer GROUP BY ALL",
        "normalize_time": "SELECT event_id, CASE event_id%4 WHEN 3 THEN NULL WHEN 2 THEN epoch_us(date_trunc('minute', ts))//1000 ELSE epoch_us(ts)//1000 END AS ms FROM events",
        "normalize_path": _PATHS,
        "remote_url": r"SELECT page_id, lower(regexp_extract(url,'^https?://([^/]+)/([^?]*)',1)||'/O/'||regexp_replace(regexp_replace(regexp_extract(url,'^https?://([^/]+)/([^?]*)',2),CASE WHEN page_id%3=2 THEN '/+$' ELSE '^$' END,''),'(\.git)+$','')) AS remote FROM pages",
        "extract_text": r"SELECT conv_id, turn, CASE WHEN regexp_matches(text,'[^ \t\n\x0B\f\r]') THEN text||chr(10) ELSE '' END||'[Tool: unknown]'||chr(10)||'tail' AS text FROM conversations",
        "store_status": f"WITH {_CE} SELECT count(*) AS events, coalesce(max(\"offset\"),0) AS max_offset, max(ingested_at) AS last_ingested FROM ce",
        "parity_by_combo": """WITH o AS (SELECT o_orderpriority AS pv, o_custkey AS sp, o_orderkey AS k, row_number() OVER (PARTITION BY o_orderpriority, o_custkey ORDER BY o_orderkey) AS r, o_orderstatus AS m, o_orderkey AS i, '/a' AS cwd FROM orders WHERE o_totalprice<300000),
          n AS (SELECT o_orderpriority AS pv, o_custkey AS sp, o_orderkey AS k, row_number() OVER (PARTITION BY o_orderpriority, o_custkey ORDER BY o_orderkey) AS r, o_orderstatus AS m, o_orderkey+CASE WHEN o_orderkey%29=0 THEN 1 ELSE 0 END AS i, CASE WHEN o_orderkey%31=0 THEN '/b' ELSE '/a' END AS cwd FROM orders WHERE o_totalprice>50000),
          z AS (SELECT coalesce(o.pv,n.pv) AS pv, coalesce(o.sp,n.sp) AS sp, o.k IS NOT NULL AS a, n.k IS NOT NULL AS b, o.m IS DISTINCT FROM n.m OR o.i IS DISTINCT FROM n.i AS x, o.cwd IS DISTINCT FROM n.cwd AS y FROM o FULL JOIN n ON o.pv=n.pv AND o.sp=n.sp AND o.r=n.r)
          SELECT pv||'|local' AS combo, count(*) FILTER (a) AS facts, count(*) FILTER (a AND b AND NOT x) AS matched, count(*) FILTER (a AND b AND x) AS must_mismatch, count(*) FILTER (a AND b AND y) AS advisory, count(*) FILTER (NOT b) AS missing, count(*) FILTER (NOT a AND sp%2=0) AS growth, count(*) FILTER (NOT a AND sp%2<>0) AS unknown_extra, count(*) FILTER (NOT a) AS extra FROM z GROUP BY ALL""",
    }


_PATHS = rf"""WITH {_FO}, g AS (SELECT page_id, CASE page_id%5 WHEN 1 THEN 'wsl:Ubuntu:/home/'||tail ELSE raw END AS cwd,
   CASE page_id%5 WHEN 0 THEN lower(regexp_replace(replace(raw,'\','/'),'/+$','')) WHEN 1 THEN regexp_replace('//wsl$/Ubuntu/home/'||tail,'/+$','') WHEN 3 THEN lower(regexp_replace(raw,'/+$','')) ELSE regexp_replace(raw,'/+$','') END AS root_key,
   CASE page_id%5 WHEN 1 THEN 'wsl:Ubuntu' WHEN 2 THEN 'wsl:Deb' ELSE 'local' END AS location FROM f1)
 SELECT page_id, cwd, root_key, location, translate(cwd,'/\:','---') AS encoded FROM g"""
