"""DuckDB SQL for the queries that SQL can express.

SQL has no XXH64 (op1), no training (op3, op8) and no Viterbi search (op6); those, and the pipeline, are
tested against brute-force versions, held-out labels or an exact round trip.
"""

_WORDS = r"list_filter(string_split_regex({}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_PLAIN = r"list_filter(string_split_regex(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '')"


def _op2() -> str:
    bits = "list_aggregate(list_transform(string_split(sha1(p), ''), lambda h: substr('0000000100100011010001010110011110001001101010111100110111101111', strpos('0123456789abcdef', h) * 4 - 3, 4)), 'string_agg', '')"
    digit = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (list_sum(list_transform(range(5), lambda j: substr(b, (k * 5 + j + 1)::INT, 1)::INT * (16 >> j)))::INT + 1), 1)"
    return f"""WITH x AS (SELECT page_id, coalesce(html, '') AS p FROM pages), y AS (SELECT *, {bits} AS b, min(page_id) OVER (PARTITION BY p) AS f FROM x)
      SELECT page_id, octet_length(encode(p)) AS payload_bytes, list_aggregate(list_transform(range(32), lambda k: {digit}), 'string_agg', '') AS payload_digest,
      CASE WHEN f < page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN f < page_id THEN f END AS refers_to FROM y"""


def _op4() -> str:
    return f"""WITH d AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
      g AS (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13),
      h AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY array_to_string(w[i:i+12], ' ')) AS f FROM g),
      r AS (SELECT DISTINCT doc_id, i + j AS i FROM h, (SELECT unnest(range(13)) AS j) WHERE f < doc_id),
      k AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
      m AS (SELECT k.doc_id, count(*) AS n_words, count(r.i) AS n_removed, coalesce(string_agg(w[k.i], ' ' ORDER BY k.i) FILTER (r.i IS NULL), '') AS kept FROM k LEFT JOIN r ON k.doc_id = r.doc_id AND k.i = r.i GROUP BY k.doc_id)
      SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN m USING (doc_id)"""


def _op5() -> str:
    return r"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
      e AS (SELECT *, length(regexp_replace(text, '(<\|(start|text|next|end|im_start|im_end|endoftext|user|assistant|system)\|>|</?s>|\[/?INST\]|<</?SYS>>)', '\0\\', 'g')) AS n, coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) = role, false) AS same FROM t)
      SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256, coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
      sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(n + CASE WHEN same THEN 8 ELSE 9 + length(role) + 8 + 7 END)::BIGINT AS formatted_chars FROM e GROUP BY conv_id"""


def _op7() -> str:
    grams = "list_distinct(list_transform(range(1, greatest(len({0}) - 3, 2)), lambda i: array_to_string({0}[i:i+4], ' ')))"
    return f"""WITH b AS (SELECT item_id, {_PLAIN.format('text')} AS w FROM benchmark WHERE text IS NOT NULL),
      c AS (SELECT item_id, w, CASE WHEN len(w) >= 10 THEN w[:len(w) - greatest(5, len(w) // 4)] ELSE w END AS q, CASE WHEN len(w) >= 10 THEN w[len(w) - greatest(5, len(w) // 4) + 1:] ELSE w END AS a FROM b WHERE len(w) >= 5),
      s AS (SELECT item_id, 'q' AS side, len({grams.format('q')}) AS n, unnest({grams.format('q')}) AS g FROM c UNION ALL SELECT item_id, 'a', len({grams.format('a')}), unnest({grams.format('a')}) FROM c UNION ALL SELECT item_id, 'w', len({grams.format('w')}), unnest({grams.format('w')}) FROM c),
      d AS (SELECT doc_id, {_PLAIN.format('text')} AS w FROM documents WHERE text IS NOT NULL), p AS (SELECT DISTINCT doc_id, unnest({grams.format('w')}) AS g FROM d),
      k AS (SELECT doc_id, item_id, side, count(*) / max(n) AS o FROM p JOIN s USING (g) GROUP BY ALL),
      o AS (SELECT doc_id, item_id, coalesce(max(o) FILTER (side = 'q'), 0) AS question_overlap, coalesce(max(o) FILTER (side = 'a'), 0) AS answer_overlap, max(o) FILTER (side = 'w') AS whole FROM k GROUP BY ALL)
      SELECT doc_id, item_id, question_overlap, answer_overlap FROM o WHERE least(question_overlap, answer_overlap) >= 0.8 OR whole >= 0.8
      UNION ALL SELECT DISTINCT doc_id, item_id, 1.0, 1.0 FROM d JOIN (SELECT item_id, w AS v FROM b WHERE len(w) BETWEEN 1 AND 4) ON contains(' ' || array_to_string(w, ' ') || ' ', ' ' || array_to_string(v, ' ') || ' ')"""


def _op9() -> str:
    return """WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
      g AS (SELECT *, sqrt(list_inner_product(e, e)) AS n FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
      l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM g a JOIN g b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.n > 0 AND b.n > 0 AND list_inner_product(a.e, b.e) / (a.n * b.n) >= 0.98),
      r AS (SELECT vec_id AS x, vec_id AS c FROM v UNION SELECT l.y, r.c FROM r JOIN l ON l.x = r.x),
      m AS (SELECT x, min(c) AS c FROM r GROUP BY x), n AS (SELECT x, count(*) AS n FROM l GROUP BY x)
      SELECT vec_id, coalesce(n.n, 0) AS n_links, m.c AS component_id, vec_id = m.c AS kept FROM v JOIN m ON m.x = vec_id LEFT JOIN n ON n.x = vec_id"""


def _op10() -> str:
    from tracelake.llm.licenses import TEMPLATES

    values = ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in TEMPLATES.items())
    words = r"list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+'), lambda x: x <> '')"
    grams = "list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))"
    return f"""WITH t(license, text) AS (VALUES {values}), tw AS (SELECT license, {words} AS w FROM t),
      ts AS (SELECT license, (8 * pow(2, greatest(0, ceil(log2(len(w) / 8.0)))))::INT AS span, len(list_distinct({grams})) AS n, unnest(list_distinct({grams})) AS g FROM tw),
      d AS (SELECT doc_id, {words} AS w FROM documents WHERE text IS NOT NULL), ds AS (SELECT doc_id, unnest({grams}) AS g, unnest(range(len(w) - 4)) AS i FROM d WHERE len(w) >= 5),
      h AS (SELECT doc_id, license, span, n, g, i FROM ds JOIN ts USING (g)),
      f AS (SELECT DISTINCT a.doc_id, a.license FROM h a JOIN h b ON a.doc_id = b.doc_id AND a.license = b.license AND b.i BETWEEN a.i AND a.i + a.span - 5 GROUP BY a.doc_id, a.license, a.n, a.i HAVING count(DISTINCT b.g) / a.n >= 0.8)
      SELECT documents.doc_id, count(license) AS n_licenses, coalesce(string_agg(license, ' | ' ORDER BY license), '') AS licenses FROM documents LEFT JOIN f USING (doc_id) GROUP BY documents.doc_id"""


def oracle_sql() -> dict[str, str]:
    return {"op2_warc": _op2(), "op4_substring": _op4(), "op5_chat": _op5(), "op7_decontaminate": _op7(), "op9_embeddings": _op9(), "op10_licenses": _op10()}
