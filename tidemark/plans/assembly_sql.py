"""DuckDB SQL for the queries of tidemark.plans.assembly."""

_LINES = "u AS (SELECT l_orderkey AS k, l_linenumber AS n, max(l_quantity) AS q, min(l_returnflag) AS f, min(l_linestatus) AS st FROM lineitem GROUP BY 1, 2)"
_SAMPLES = f"""
WITH {_LINES},
x AS (SELECT u.*, o.*, 'user:Q' || n || f || ':' || CASE WHEN n % 3 = 0 THEN 4 ELSE n % 3 END || ':' || CASE WHEN n % 2 = 0 THEN 'audio' ELSE 'visual' END || ':0|assistant:A' || CAST(trunc(q) AS INTEGER) || '::' || CASE WHEN st = 'O' THEN 2 ELSE 1 END AS turns,
    'user:Q:0|assistant:A:' || CASE WHEN st = 'O' THEN 2 ELSE 1 END AS bare, CASE WHEN st = 'O' THEN 2 ELSE 1 END AS criteria_count, CASE WHEN st = 'O' THEN -4 ELSE 1 END AS weight, f = 'A' AND n IN (2, 5) AS ungraded
  FROM u JOIN orders o ON k = o_orderkey WHERE k % 7 <> 0 AND k % 11 <> 0),
r AS (SELECT k, o_custkey, o_orderstatus, 0 AS kind, n AS pos, turns, bare, criteria_count, weight FROM x WHERE n <= 3 AND f <> 'R' AND NOT ungraded
  UNION ALL
  SELECT k, any_value(o_custkey), any_value(o_orderstatus), 1, 0, coalesce(string_agg(turns, '|' ORDER BY n) FILTER (NOT ungraded), ''), coalesce(string_agg(bare, '|' ORDER BY n) FILTER (NOT ungraded), ''), coalesce(sum(criteria_count) FILTER (NOT ungraded), 0), coalesce(sum(weight) FILTER (NOT ungraded), 0)
  FROM x WHERE n > 3 AND k % 5 <> 0 GROUP BY k),
s AS (SELECT *, row_number() OVER (ORDER BY k, kind, pos) - 1 AS number, CASE kind WHEN 0 THEN 'single_turn' ELSE 'multi_turn' END AS sample_type FROM r)
"""
_LISTING = """
WITH f AS (SELECT '/media/' || c_nationkey || '/' || c_custkey || ['.mp4', '.webm', '.MOV', '.txt', '.mkv'][c_nationkey % 5 + 1] AS path, CAST(c_custkey AS VARCHAR) AS id, lower(['.mp4', '.webm', '.MOV', '.txt', '.mkv'][c_nationkey % 5 + 1]) AS ext, c_custkey * 10 AS length FROM customer
  UNION ALL SELECT '/other/' || s_suppkey || '.avi', CAST(s_suppkey AS VARCHAR), '.avi', 5 FROM supplier)
"""

SQL: dict[str, str] = {
    "fused_segments": """
WITH s AS (SELECT l_suppkey % 40 AS video_id, l_orderkey * 8 + l_linenumber AS idx, CAST(min(l_orderkey % 5000) AS DOUBLE) AS a, max(l_orderkey % 5000 + l_quantity) AS b, min(l_returnflag) AS f FROM lineitem GROUP BY 1, 2),
c AS (SELECT v.video_id, v.idx, trim(string_agg(CASE WHEN o.f = 'N' THEN '' ELSE o.f || o.idx END, ' ' ORDER BY o.idx)) AS t FROM s v JOIN s o ON v.video_id = o.video_id AND v.a < o.b AND v.b > o.a WHERE v.idx % 3 = 0 AND o.idx % 3 = 1 GROUP BY 1, 2),
d AS (SELECT v.video_id, v.idx, string_agg(o.f || o.idx, ' ' ORDER BY o.idx) AS t FROM s v JOIN s o ON v.video_id = o.video_id AND v.a < o.b AND v.b > o.a WHERE v.idx % 3 = 0 AND o.idx % 3 = 2 AND o.f <> 'A' GROUP BY 1, 2)
SELECT video_id, idx, coalesce(c.t, '') AS speech_content, coalesce(d.t, '') AS audio_environment FROM s LEFT JOIN c USING (video_id, idx) LEFT JOIN d USING (video_id, idx) WHERE idx % 3 = 0""",
    "key_event_segments": """
WITH u AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS p, 'user' || turn || '|x' AS e FROM conversations WHERE role = 'user')
SELECT c.conv_id AS video_id, c.turn AS idx, coalesce(e, '') AS key_events FROM conversations c LEFT JOIN u ON u.conv_id = c.conv_id AND u.p = c.turn""",
    "merged_positions": """
WITH d AS (SELECT conv_id AS video_id, turn AS idx, coalesce(md5(text), '') AS t FROM conversations),
m AS (SELECT * FROM d WHERE video_id % 3 = 0 AND idx < 2), w AS (SELECT * FROM d WHERE video_id % 3 <> 2), a AS (SELECT * FROM d WHERE idx > 0),
e AS (SELECT 0 AS r, video_id, idx FROM m UNION ALL SELECT 1, video_id, idx FROM w UNION ALL SELECT 2, video_id, idx FROM a),
b AS (SELECT video_id, min(r) AS r FROM e GROUP BY 1)
SELECT video_id, idx, coalesce(m.t, '') AS multimodal_description, coalesce(w.t, '') AS visual_description, coalesce(a.t, '') AS audio_description
FROM e JOIN b USING (video_id, r) LEFT JOIN m USING (video_id, idx) LEFT JOIN w USING (video_id, idx) LEFT JOIN a USING (video_id, idx) WHERE coalesce(m.t, '') || coalesce(w.t, '') || coalesce(a.t, '') <> ''""",
    "fused_documents": """
WITH g AS (SELECT conv_id AS video_id, count(*) AS total_segments, count(*) FILTER (role = 'user') AS segments_with_speech, CAST(0 AS BIGINT) AS segments_with_visual, count(*) FILTER (turn % 3 = 0) AS segments_with_audio,
    count(*) FILTER (turn % 2 = 0 AND role <> '') AS segments_with_multimodal, count(*) FILTER (turn % 3 > 0) AS segments_with_key_events, CAST(sum(turn % 3) AS BIGINT) AS total_key_events, round(count(*) FILTER (role = 'user') / count(*), 9) AS speech_share,
    count(*) * 4.0::DOUBLE AS seconds, max(turn) AS last_index FROM conversations GROUP BY 1)
SELECT g.*, CASE WHEN c_custkey IS NOT NULL THEN c_name END AS title, CASE WHEN c_custkey IS NOT NULL THEN '' END AS channel, c_acctbal AS duration, CASE WHEN c_custkey IS NOT NULL THEN 0.0::DOUBLE END AS view_count FROM g LEFT JOIN customer ON c_custkey = video_id""",
    "benchmark_samples": _SAMPLES
    + """SELECT 'sample_' || number AS sample_id, s.o_custkey AS video_id, 'k' || k AS task_id, sample_type, coalesce(c_name, '') AS title, coalesce(c_acctbal, 0.0) AS duration, coalesce(c_mktsegment, '') AS categories, turns, CAST(criteria_count AS BIGINT) AS criteria_count, CAST(weight AS BIGINT) AS weight
FROM s LEFT JOIN customer c ON c.c_custkey = s.o_custkey AND c_custkey % 9 <> 0""",
    "clean_samples": _SAMPLES + "SELECT o_orderstatus AS task, sample_type, bare AS turns, count(*) AS n FROM s GROUP BY ALL",
    "caption_totals": r"""
SELECT conv_id, count(*) AS segments, sum(CASE WHEN turn % 4 <> 3 THEN 1.5::DOUBLE ELSE 0 END) AS seconds, CAST(sum(len(list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda w: w <> ''))) AS BIGINT) AS words FROM conversations GROUP BY 1""",
    "description_totals": """
SELECT conv_id, count(*) AS segments, CAST(coalesce(sum(turn) FILTER (turn % 3 > 0), 0) AS BIGINT) AS frames, round(coalesce(sum(turn) FILTER (turn % 3 > 0), 0) / count(*), 9) AS frames_per_segment FROM conversations GROUP BY 1""",
    "valid_words": r"""
SELECT round(coalesce(avg(len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> ''))), 0), 6) AS mean_words, count(*) AS n FROM conversations
WHERE turn % 4 NOT IN (1, 2) AND text <> '' AND text NOT IN ('No audio description available', 'No description available', 'No frames could be extracted from this video segment', 'No multimodal understanding available')""",
    "question_totals": f"WITH {_LINES} SELECT k, count(*) AS questions FROM u GROUP BY 1",
    "success_counts": "SELECT l_returnflag, count(*) AS rows, count(*) FILTER (l_linestatus = 'O') AS good FROM lineitem GROUP BY 1",
    "store_counts": "SELECT user_id AS video_id, count(*) AS points, count(DISTINCT event_type) AS types FROM events GROUP BY 1",
    "cache_stats": "SELECT count(*) AS entries, CAST(coalesce(sum(n_chars), 0) AS BIGINT) AS bytes, round(coalesce(sum(n_chars), 0) / 1048576, 9) AS mb, min(doc_id) AS oldest, max(doc_id) AS newest FROM documents",
    "hit_rates": "SELECT user_id, CAST(printf('%.3f', count(*) FILTER (event_id % 3 = 0) / count(*)) AS DOUBLE) AS hit_rate FROM events GROUP BY 1",
    "ordered_values": "SELECT user_id, min(event_id) AS first, md5(string_agg(event_type, ',' ORDER BY event_id)) AS \"values\" FROM events GROUP BY 1",
    "nested_ids": """
WITH c AS (SELECT DISTINCT n_regionkey, n_name, c_mktsegment FROM customer JOIN nation ON c_nationkey = n_nationkey),
s AS (SELECT *, dense_rank() OVER (PARTITION BY n_regionkey ORDER BY n_name) AS i, row_number() OVER (PARTITION BY n_regionkey, n_name ORDER BY c_mktsegment) AS j FROM c)
SELECT 'v' || n_regionkey AS video_id, 'v' || n_regionkey || '_s' || i AS scenario_id, n_name AS scenario, 'v' || n_regionkey || '_s' || i || '_t' || j AS task_id, c_mktsegment AS task FROM s""",
    "request_ids": f"""
WITH {_LINES}
SELECT 'sample_' || k || '__t' || n || CASE WHEN n % 2 = 0 THEN '__c' || CAST(trunc(q) AS BIGINT) ELSE '' END AS id, 'sample_' || k AS sample_id, CAST(n AS BIGINT) AS turn, CASE WHEN n % 2 = 0 THEN CAST(trunc(q) AS BIGINT) END AS criterion FROM u""",
    "frame_matches": """
WITH o AS (SELECT o_custkey AS video_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS DOUBLE) AS target, o_orderkey FROM orders),
p AS (SELECT video_id, target, target + o_orderkey % 13 / 20 - 0.11::DOUBLE AS frame FROM o),
q AS (SELECT *, count(*) FILTER (abs(frame - target) > 0.2) OVER (PARTITION BY video_id ORDER BY target) AS missed FROM p)
SELECT video_id, target, round(frame, 6) AS frame FROM q WHERE missed = 0""",
    "video_spans": """
WITH x AS (SELECT l_orderkey, l_linenumber, l_quantity AS a, l_quantity + l_tax * 100 AS b, l_quantity / 10 AS speed FROM lineitem),
y AS (SELECT *, greatest(ceil(abs(log2(speed))), 1) AS steps FROM x)
SELECT l_orderkey, l_linenumber, round(greatest(a - (b - a) / 2, 0.0), 6) AS wide_start, round(least(b + (b - a) / 2, 45.0), 6) AS wide_end,
  round(CASE WHEN a * 2 > 0 AND a * 2 <= 60 THEN 0.0 ELSE a END, 6) AS short_start, round(CASE WHEN a * 2 > 0 AND a * 2 <= 60 THEN a * 2 ELSE a + 1 END, 6) AS short_end,
  round(speed / power(CASE WHEN speed > 1 THEN 2.0 ELSE 0.5 END, steps - 1), 6) AS last_step, CAST(steps AS BIGINT) AS steps FROM y""",
    "chunk_subtitles": """
WITH e AS (SELECT user_id, epoch_us(ts) / 1e6 - 1704067200 AS t, event_type FROM events),
l AS (SELECT user_id, CAST(floor(t / 86400) AS BIGINT) AS chunk, string_agg(event_type, ' ' ORDER BY t, event_type) AS text FROM e GROUP BY 1, 2),
d AS (SELECT user_id, unnest(generate_series(0, max(chunk))) AS chunk FROM l GROUP BY 1)
SELECT user_id, chunk, coalesce(text, '') AS text FROM d LEFT JOIN l USING (user_id, chunk)""",
    "unit_vectors": """
SELECT vec_id, round(embedding[1]::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS first, round(embedding[2]::DOUBLE / 127.5 - 1, 6) AS pixel FROM embeddings""",
    "truncated_texts": """
SELECT doc_id, md5(CASE WHEN length(text) > 200 THEN substring(text, 1, 200) || '...' ELSE text END) AS text,
  CASE WHEN n_chars < 60 THEN n_chars || 's' WHEN n_chars >= 3600 THEN printf('%dh%02dm', n_chars // 3600, n_chars % 3600 // 60) ELSE printf('%dm%02ds', n_chars // 60, n_chars % 60) END AS duration FROM documents""",
    "position_rules": """
SELECT conv_id, turn, coalesce(list_aggregate(CASE turn % 3 WHEN 0 THEN list_slice(generate_series(0, turn - 1), 1, 3) WHEN 1 THEN generate_series(greatest(turn - 3, 0), turn - 1) ELSE [] END, 'string_agg', ','), '') AS chunks
FROM conversations""",
    "verified_candidates": "SELECT n_nationkey AS pos, n_nationkey * 7 % 5 / 5 AS probability, n_name FROM nation WHERE n_nationkey < 5",
    "filled_templates": """
SELECT c_custkey, c_name || ': {"s": ' || CASE WHEN c_custkey % 4 > 0 THEN c_mktsegment ELSE '' END || '} of ' || c_nationkey || ', ' || c_name || ' {unknown}' AS prompt FROM customer""",
    "key_event_texts": "SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'a b|' || role WHEN 1 THEN 'first ' || role || '|second thing' ELSE 'Key events extraction failed' END AS events FROM conversations",
    "json_or_text": """
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k, CASE event_id % 3 WHEN 1 THEN 'so: ' || props || '.' WHEN 2 THEN 'none' END AS raw, CASE WHEN event_id % 3 < 2 THEN props END AS braces FROM events""",
    "aligned_or_raw": """
SELECT conv_id AS video_id, turn, md5(text) AS text, aligned FROM (SELECT *, conv_id % 3 = 0 AND max(turn) OVER (PARTITION BY conv_id) > 0 AS aligned FROM conversations) WHERE NOT aligned OR turn > 0""",
    "resolved_paths": _LISTING
    + """, g AS (SELECT id, arg_min(path, (list_position(['.mp4', '.mkv', '.webm', '.avi', '.mov'], ext), path)) AS path FROM f WHERE ext <> '.txt' GROUP BY 1)
SELECT CAST(c_custkey AS VARCHAR) AS id, CASE WHEN c_custkey % 2 = 0 AND s_suppkey IS NOT NULL THEN '/other/' || c_custkey || '.avi' ELSE g.path END AS path FROM customer LEFT JOIN g ON g.id = CAST(c_custkey AS VARCHAR) LEFT JOIN supplier ON s_suppkey = c_custkey""",
    "path_map": _LISTING + "SELECT id, max(path) AS path FROM f GROUP BY 1",
    "file_totals": _LISTING + "SELECT ltrim(ext, '.') AS extension, count(*) AS files, CAST(sum(length) AS BIGINT) AS bytes FROM f GROUP BY 1",
    "frame_lists": "SELECT '/f/' || user_id AS folder, count(*) AS n, md5(string_agg('/f/' || user_id || '/' || lpad(CAST(event_id AS VARCHAR), 8, '0') || '.jpg', ',' ORDER BY event_id)) AS frames FROM events GROUP BY user_id",
    "json_resumed": "SELECT conv_id, turn, role, md5(text) AS text FROM conversations",
    "csv_round_trip": "SELECT doc_id, CASE WHEN doc_id % 3 > 0 THEN n_chars ELSE 0 END::DOUBLE AS duration, md5(' \"' || text || chr(10) || '\", ') AS text FROM documents",
    "complete_parts": """
SELECT conv_id, string_agg(turn || role, ',' ORDER BY turn) AS parts FROM conversations GROUP BY 1 HAVING bool_and(turn <> 1 OR conv_id % 3 > 0)""",
    "points_upserted": "SELECT vec_id AS raw_id, 't' || label AS type, CASE WHEN vec_id % 3 = 0 THEN 2 ELSE 1 END AS seq, CASE WHEN vec_id % 3 = 0 THEN 'v' || vec_id END AS video_id FROM embeddings",
}
