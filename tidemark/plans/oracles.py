"""DuckDB SQL for the queries of tidemark.plans.queries."""

_TASKS = """['entity_recognition','event_understanding','temporal_reasoning','audio_understanding','causal_reasoning','quantitative_reasoning','compositional_reasoning','comparative_analysis',
  'information_retrieval','summarization','instruction_extraction','sentiment_analysis','multimodal_synthesis','cross_modal_verification','audio_visual_alignment','motion_analysis',
  'ocr_text_extraction','question_answering','unlisted_task',NULL]"""
_RUBRIC = f"""
WITH r AS (SELECT d.doc_id, lang, source, n_chars, quality, toxic,
    CASE WHEN quality = 1 THEN 5 ELSE 0 END + CASE WHEN toxic = 0 THEN 3 ELSE 0 END + CASE WHEN n_chars > 500 THEN 1 ELSE 0 END AS obtained, 9 AS total,
    ({_TASKS})[CAST(regexp_extract(source, '(\\d+)$', 1) AS INTEGER) % 20 + 1] AS raw_task
  FROM documents d JOIN labels USING (doc_id)),
s AS (SELECT *, CASE coalesce(raw_task, 'unknown') WHEN 'ocr_text_extraction' THEN 'entity_recognition' WHEN 'question_answering' THEN 'summarization' ELSE coalesce(raw_task, 'unknown') END AS task FROM r),
t AS (SELECT task, CAST(sum(obtained) AS BIGINT) AS obtained, CAST(sum(total) AS BIGINT) AS total, CASE WHEN sum(total) > 0 THEN sum(obtained)::DOUBLE / sum(total) ELSE 0.0 END AS accuracy, count(*) AS samples FROM s GROUP BY task),
c AS (SELECT CASE WHEN i < 5 THEN 'Core Perception Tasks' WHEN i < 9 THEN 'Reasoning Tasks' WHEN i < 13 THEN 'Information Tasks' ELSE 'Multimodal Tasks' END AS category, avg(accuracy) AS accuracy, CAST(sum(samples) AS BIGINT) AS samples
  FROM (SELECT *, list_position({_TASKS}, task) AS i FROM t) WHERE i <= 16 GROUP BY 1)
"""
_GROUPED = "SELECT {by}, CAST(sum(obtained) AS BIGINT) AS obtained, CAST(sum(total) AS BIGINT) AS total, CASE WHEN sum(total) > 0 THEN sum(obtained)::DOUBLE / sum(total) ELSE 0.0 END AS accuracy, count(*) AS samples FROM {rows} GROUP BY {by}"
_EVENTS = "WITH e AS (SELECT user_id, event_id, event_type, epoch_us(ts) / 1e6 AS s FROM events)"

SQL: dict[str, str] = {
    "rubric_sample_score": _RUBRIC + "SELECT doc_id, CAST(obtained AS BIGINT) AS obtained, CAST(total AS BIGINT) AS total, obtained::DOUBLE / total AS score FROM s",
    "rubric_task_accuracy": _RUBRIC + "SELECT * FROM t",
    "rubric_category_accuracy": _RUBRIC + "SELECT category, round(accuracy, 9) AS accuracy, samples FROM c",
    "rubric_overall": _RUBRIC + "SELECT round(avg(accuracy), 9) AS overall, round(avg(round_even(accuracy * 100, 2)) / 100, 9) AS overall_of_rounded, CAST(sum(samples) AS BIGINT) AS samples FROM c",
    "rubric_dropped_tasks": _RUBRIC + f"SELECT task, samples FROM t WHERE coalesce(list_position({_TASKS}, task), 99) > 16",
    "modality_breakdown": _RUBRIC
    + ", m AS (SELECT DISTINCT doc_id, obtained, total, modality FROM (SELECT *, unnest(list_filter([CASE WHEN lang IN ('en', 'de') THEN 'speech' END, CASE WHEN toxic = 1 THEN 'audio' END, CASE WHEN n_chars > 1000 OR quality = 0 THEN 'visual' END], lambda x: x IS NOT NULL)) AS modality FROM s)) "
    + _GROUPED.format(by="modality", rows="m"),
    "duration_buckets": _RUBRIC + ", b AS (SELECT *, CASE WHEN coalesce(n_chars, 0) BETWEEN 0 AND 1799 THEN 'short' WHEN n_chars BETWEEN 1800 AND 2699 THEN 'medium' ELSE 'long' END AS bucket FROM s) " + _GROUPED.format(by="bucket", rows="b"),
    "judge_mean": _RUBRIC + "SELECT lang AS model, round(avg(o), 9) AS overall, count(*) AS judges FROM (SELECT lang, doc_id % 3 AS judge, sum(obtained)::DOUBLE / sum(total) AS o FROM s GROUP BY ALL) GROUP BY lang",
    "resume_pending": "SELECT doc_id, lang, source FROM documents ANTI JOIN labels USING (doc_id)",
    "work_list": "SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM labels WHERE quality = 0",
    "coverage_flags": "SELECT doc_id, doc_id IN (SELECT doc_id FROM labels) AS labelled, doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS good, doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS toxic FROM documents",
    "last_wins_join": "SELECT o_orderkey, o_custkey, l_linenumber, l_partkey, l_shipdate FROM orders JOIN (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linenumber DESC, l_partkey DESC) AS r FROM lineitem) ON l_orderkey = o_orderkey WHERE r = 1",
    "first_match_theta": """
SELECT p_brand, p_type, n_nationkey, n_name FROM (SELECT p_brand, p_type, n_nationkey, n_name, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY n_nationkey) AS r
  FROM (SELECT DISTINCT p_brand, p_type FROM part) p LEFT JOIN nation ON n_name = p_type OR contains(lower(n_name), lower(p_type)) OR contains(lower(p_type), lower(n_name[1]))) WHERE r = 1""",
    "zip_join": """
WITH n AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn, text) - 1 AS pos FROM conversations)
SELECT q.conv_id, q.pos, md5(q.text) AS question, md5(a.text) AS answer FROM n q JOIN n a ON q.conv_id = a.conv_id AND q.pos = a.pos AND q.role = 'user' AND a.role = 'assistant'""",
    "prefix_context": """
SELECT conv_id, turn, earlier, CAST(chars AS BIGINT) AS chars FROM (SELECT conv_id, turn, role, count(*) OVER w AS earlier, coalesce(sum(length(text)) OVER w, 0) AS chars FROM conversations
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE role = 'assistant'""",
    "prev3_context": """
WITH c AS (SELECT conv_id, turn, list_filter(list(CASE WHEN length(text) > 40 THEN text END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), lambda x: x IS NOT NULL) AS l FROM conversations)
SELECT conv_id, turn, len(l) AS n, md5(array_to_string(l, '|')) AS context FROM c WHERE len(l) > 0""",
    "aligned_pairs": "SELECT conv_id, turn, md5(before) AS before FROM (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations) WHERE length(text) > 40 AND length(before) > 40",
    "completeness": """
SELECT conv_id, count(*) AS parts FROM (SELECT *, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next FROM conversations) WHERE role = 'user'
GROUP BY conv_id HAVING count(*) = count(*) FILTER (WHERE next = 'assistant')""",
    "gap_fill": _EVENTS
    + """, g AS (SELECT *, s + 60 AS e, lag(s + 60) OVER (PARTITION BY user_id ORDER BY s, event_id) AS b FROM e)
SELECT user_id, event_id, 'audio' AS kind, round(CASE WHEN s - b > 0 AND s - b < 3600 THEN b ELSE s END, 3) AS start, round(e, 3) AS "end" FROM g
UNION ALL SELECT user_id, NULL, 'silent', round(b, 3), round(s, 3) FROM g WHERE s - b >= 3600""",
    "silences": """
WITH s AS (SELECT doc_id % 50 AS video, CAST(doc_id * 7 % 600 AS DOUBLE) AS a, CAST(doc_id * 7 % 600 + n_chars % 20 AS DOUBLE) AS b FROM documents),
w AS (SELECT *, lead(a) OVER (PARTITION BY video ORDER BY a, b) AS nxt, row_number() OVER (PARTITION BY video ORDER BY a, b) AS r FROM s),
v AS (SELECT DISTINCT doc_id % 60 AS video FROM documents),
x AS (SELECT video, 0.0 AS start, a AS "end" FROM w WHERE r = 1 UNION ALL SELECT video, b, coalesce(nxt, 700.0) FROM w)
SELECT video, CAST(start AS DOUBLE) AS start, "end" FROM x JOIN v USING (video) WHERE "end" - start >= 5 UNION ALL SELECT video, 0.0, 700.0 FROM v ANTI JOIN s USING (video)""",
    "interval_fusion": _EVENTS
    + """, k AS (SELECT min(event_type) AS a FROM events),
l AS (SELECT user_id, event_id, s - 7200 AS x, s + 7200 AS y FROM e, k WHERE event_type = a), r AS (SELECT user_id, event_id AS o, s AS x2, s + 600 AS y2 FROM e, k WHERE event_type <> a),
p AS (SELECT l.user_id, event_id, o FROM l JOIN r ON l.user_id = r.user_id AND x < y2 AND y > x2)
SELECT l.user_id, l.event_id AS idx, count(o) AS n, coalesce(string_agg(CAST(o AS VARCHAR), ' ' ORDER BY o), '') AS ids FROM l LEFT JOIN p ON l.user_id = p.user_id AND l.event_id = p.event_id GROUP BY ALL""",
    "first_overlap": """
WITH g AS (SELECT l_suppkey % 40 AS video_id, l_orderkey * 8 + l_linenumber AS idx, min(CAST(l_orderkey % 5000 AS DOUBLE)) AS a, max(l_orderkey % 5000 + l_quantity) AS b, min(l_returnflag) AS f FROM lineitem GROUP BY ALL),
s AS (SELECT *, CASE WHEN f <> 'N' THEN f || CAST(idx AS VARCHAR) END AS d FROM g),
o AS (SELECT * FROM s WHERE idx % 3 <> 0 AND d IS NOT NULL), c AS (SELECT * FROM s WHERE idx % 3 = 0),
m AS (SELECT c.video_id, c.idx, arg_min(o.d, o.idx) AS d FROM c JOIN o ON c.video_id = o.video_id AND c.a < o.b AND c.b > o.a GROUP BY ALL)
SELECT c.video_id, c.idx, coalesce(m.d, '') AS description FROM c LEFT JOIN m USING (video_id, idx)""",
    "largest_gap": _EVENTS
    + """, g AS (SELECT *, lead(s) OVER (PARTITION BY user_id ORDER BY s) - (s + 60) AS gap FROM e)
SELECT user_id, round(min(s), 3) AS first_start, round(max(s + 60), 3) AS last_end, false AS any_negative, round(greatest(coalesce(max(gap), 0), 0), 3) AS largest_gap FROM g GROUP BY user_id""",
    "first_seen": "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS r FROM events) WHERE r = 1",
    "run_boundaries": """
WITH b AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events), r AS (SELECT * FROM b WHERE p IS DISTINCT FROM event_type)
SELECT user_id, event_id, event_type, lead(event_type) OVER w AS next_1, lead(event_type, 2) OVER w AS next_2 FROM r WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""",
    "clip_windows": """
WITH d AS (SELECT doc_id, n_chars / 10.0 AS d FROM documents), n AS (SELECT doc_id, CAST(d AS DOUBLE) AS d, CAST(floor(d / 10) + CASE WHEN d % 10 > 1 THEN 1 ELSE 0 END AS BIGINT) AS n FROM d),
c AS (SELECT doc_id, d, unnest(generate_series(0, n - 1)) AS clip FROM n WHERE n > 0)
SELECT doc_id, clip, round(clip * 10.0::DOUBLE, 6) AS clip_start, round(least(clip * 10.0::DOUBLE + 10, d), 6) AS clip_end FROM c WHERE least(clip * 10.0::DOUBLE + 10, d) - clip * 10 >= 0.5""",
    "caption_split_times": """
WITH p AS (SELECT conv_id, turn, CAST(turn AS DOUBLE) AS a, turn + length(text) / 15 AS b, unnest(list_filter(string_split(text, '.'), lambda x: x <> '')) AS x, generate_subscripts(list_filter(string_split(text, '.'), lambda x: x <> ''), 1) - 1 AS pos FROM conversations),
t AS (SELECT *, greatest((b - a) / sum(length(x)) OVER (PARTITION BY conv_id, turn), 1.0::DOUBLE / count(*) OVER (PARTITION BY conv_id, turn)) AS per FROM p),
d AS (SELECT *, greatest(length(x) * per, 1.0) AS d FROM t),
s AS (SELECT *, sum(d) OVER (PARTITION BY conv_id, turn ORDER BY pos) AS upto, lead(pos) OVER (PARTITION BY conv_id, turn ORDER BY pos) AS nxt FROM d)
SELECT conv_id, turn, pos, round(least(a + (upto - d), b), 6) AS piece_start, round(CASE WHEN nxt IS NULL THEN b ELSE least(a + upto, b) END, 6) AS piece_end FROM s""",
    "merge_short": """
WITH RECURSIVE s AS (SELECT user_id, epoch_us(ts) / 1e6 AS a, epoch_us(ts) / 1e6 + event_id % 3 AS b, repeat(event_type, 4) AS x, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
p AS (SELECT s.*, lead(b) OVER w AS nb, lead(x) OVER w AS nx, b - a < 1 OR length(x) < 20 AS short FROM s WINDOW w AS (PARTITION BY user_id ORDER BY i)),
walk AS (SELECT * FROM p WHERE i = 1 UNION ALL SELECT p.* FROM walk JOIN p ON p.user_id = walk.user_id AND p.i = walk.i + CASE WHEN walk.short AND walk.nx IS NOT NULL THEN 2 ELSE 1 END)
SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY i) - 1 AS BIGINT) AS id, round(a, 3) AS start, round(CASE WHEN short AND nx IS NOT NULL THEN nb ELSE b END, 3) AS "end",
  CASE WHEN short AND nx IS NOT NULL THEN x || ' ' || nx ELSE x END AS text FROM walk""",
    "cosine_topk": """
WITH s AS (SELECT q.vec_id AS query_id, e.vec_id, list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS c FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0)
SELECT query_id, rank, vec_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, vec_id) AS rank FROM s) WHERE rank <= 5""",
    "threshold_retrieval": """
WITH m AS (SELECT i, avg(x::DOUBLE) AS x FROM (SELECT unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings WHERE vec_id % 50 = 0) GROUP BY i), c AS (SELECT list(x ORDER BY i) AS v FROM m),
s AS (SELECT vec_id, list_cosine_similarity(embedding::DOUBLE[], v) AS s FROM embeddings, c)
SELECT vec_id, round(s, 6) AS similarity FROM s WHERE s >= 0.3""",
    "mean_similarity_rank": """
SELECT vec_id, round(s, 6) AS similarity FROM (SELECT e.vec_id, avg(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[])) AS s FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0 GROUP BY 1) ORDER BY s DESC, vec_id LIMIT 20""",
    "entity_chunks": "SELECT event_type, count(DISTINCT user_id) AS n, md5(string_agg(DISTINCT CAST(user_id AS VARCHAR), ',' ORDER BY user_id)) AS chunks FROM (SELECT DISTINCT event_type, user_id FROM events) GROUP BY 1".replace("string_agg(DISTINCT ", "string_agg("),
    "cooccurrence_edges": "SELECT a.l_partkey AS src, b.l_partkey AS dst, max(a.l_orderkey) AS label FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey <> b.l_partkey GROUP BY ALL",
    "tier_cost": """
WITH u AS (SELECT *, CAST(floor(l_quantity) AS BIGINT) AS p, CAST(floor(floor(l_quantity) * l_linenumber / 4) AS BIGINT) AS c FROM lineitem),
r AS (SELECT *, CASE WHEN p <= 10 THEN 1.0 WHEN p <= 30 THEN 2.0 ELSE 4.0 END AS x FROM u)
SELECT l_orderkey, l_linenumber, round(CAST(greatest(p - c, 0) * x + c * x / 4 + l_linenumber * x * 4 AS DOUBLE), 4) AS cost FROM r""",
    "cost_totals": """
WITH r AS (SELECT *, CAST(floor(l_quantity) AS BIGINT) AS p, CASE WHEN l_quantity < 11 THEN 1.0 WHEN l_quantity < 31 THEN 2.0 ELSE 4.0 END AS x FROM lineitem)
SELECT l_returnflag, count(*) AS requests, CAST(sum(p) AS BIGINT) AS prompt, CAST(sum(l_linenumber) AS BIGINT) AS output, round(CAST(sum(greatest(p - 1, 0) * x + x / 4 + l_linenumber * x * 4) AS DOUBLE), 2) AS cost FROM r GROUP BY 1""",
    "profile_report": """
WITH c AS (SELECT conv_id, count(*) AS len, count(*) FILTER (WHERE role = 'user') AS users, sum(length(text)) AS d FROM conversations GROUP BY 1), s AS (SELECT *, conv_id % 97 AS video, conv_id % 4 AS k, CASE WHEN users > 1 THEN users END AS m FROM c)
SELECT count(*)::DOUBLE AS total_samples, count(*) FILTER (WHERE m IS NULL)::DOUBLE AS single_turn_samples, count(m)::DOUBLE AS multi_turn_samples, count(DISTINCT video)::DOUBLE AS unique_videos,
  min(d)::DOUBLE AS min_duration, max(d)::DOUBLE AS max_duration, round(avg(d), 6) AS avg_duration, sum(d)::DOUBLE AS total_duration,
  min(len)::DOUBLE AS min_length, max(len)::DOUBLE AS max_length, round(avg(len), 6) AS avg_length, min(m)::DOUBLE AS min_turns, max(m)::DOUBLE AS max_turns, round(avg(m), 6) AS avg_turns,
  sum(k)::DOUBLE AS total_criteria, min(k)::DOUBLE AS min_criteria, max(k)::DOUBLE AS max_criteria, round(avg(k), 6) AS avg_criteria, count(*) FILTER (WHERE k > 0)::DOUBLE AS samples_with_criteria,
  count(*) FILTER (WHERE k = 0)::DOUBLE AS samples_without_criteria, round(count(*) FILTER (WHERE k > 0) / count(*) * 100, 6) AS criteria_coverage FROM s""",
    "numeric_summary": """
WITH x AS (SELECT CAST(n_chars AS DOUBLE) AS x FROM documents WHERE doc_id % 7 <> 0 AND doc_id % 11 <> 0)
SELECT count(*) AS n, round(avg(x), 6) AS mean, round(median(x), 6) AS median, round(min(x), 6) AS least, round(max(x), 6) AS most, round(sum(x), 6) AS total FROM x""",
    "category_counts": "SELECT category, count(*) AS n FROM (SELECT lang AS category FROM documents UNION ALL SELECT source FROM documents) GROUP BY 1",
    "known_categories": "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'Comedy, Travel' WHEN 1 THEN 'Vlogs' ELSE 'Uncategorized' END AS categories FROM documents",
    "field_completeness": """
SELECT lang, count(*) AS rows, count(*) FILTER (WHERE doc_id % 3 > 0) AS n_speech, count(*) FILTER (WHERE doc_id % 5 > 0) AS n_visual,
  count(*) FILTER (WHERE doc_id % 3 > 0) / count(*) AS share_speech, count(*) FILTER (WHERE doc_id % 5 > 0) / count(*) AS share_visual FROM documents GROUP BY 1""",
    "words_and_sentences": r"""
SELECT lang, CAST(sum(len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> ''))) AS BIGINT) AS words, CAST(sum(length(regexp_replace(text, '[!-/:-@\[-`{-~]', '', 'g'))) AS BIGINT) AS plain_chars,
  CAST(sum(len(regexp_extract_all(text, '[.!?]'))) AS BIGINT) AS sentence_ends FROM documents GROUP BY 1""",
    "json_extract": r"""SELECT event_id, CAST(props ->> 'k' AS BIGINT) AS k, TRY_CAST(regexp_extract(props, '"k"\s*:\s*(\d+)', 1) AS BIGINT) AS k_scanned FROM events""",
    "strip_tags": r"""
SELECT conv_id, turn, md5(CASE WHEN turn % 3 = 2 THEN trim(text || ' <answer> A </answer> x <answer>B</answer>', E' \n\t') ELSE trim(text, E' \n\t') END) AS clean,
  md5(CASE turn % 3 WHEN 0 THEN trim(text || '<tool_call>{}</tool_call>', E' \n\t') WHEN 1 THEN trim(text, E' \n\t') ELSE 'B' END) AS answer FROM conversations""",
    "name_tags": r"""
SELECT p_partkey, regexp_replace(split_part(p_brand || '/' || p_name || '@v.2', '/', -1), '[^A-Za-z0-9]', '_', 'g') AS model, lower(regexp_replace(regexp_replace(p_brand || '/' || p_name || '@v.2', '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')) AS tag,
  p_name || '@v.2' AS agent FROM part""",
    "chunk_tail_merge": """
WITH n AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS place, count(*) OVER () AS n FROM documents),
k AS (SELECT *, ceil(n / 300) - CASE WHEN ceil(n / 300) > 1 AND n - (ceil(n / 300) - 1) * 300 < 110 THEN 1 ELSE 0 END AS chunks FROM n)
SELECT CAST(least(place // 300, chunks - 1) AS BIGINT) AS chunk, count(*) AS n, min(doc_id) AS first, max(doc_id) AS last FROM k GROUP BY 1""",
    "worker_split": """
SELECT part, worker, count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS ids FROM (SELECT doc_id, ntile(7) OVER (ORDER BY doc_id) - 1 AS part, (row_number() OVER (ORDER BY doc_id) - 1) % 3 AS worker FROM documents) GROUP BY ALL""",
    "update_join": """
SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 AND o_orderpriority <> '' THEN o_orderpriority ELSE coalesce(c.f, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE '' END) END AS answer
FROM orders LEFT JOIN (SELECT l_orderkey, l_returnflag AS f, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linenumber DESC, l_partkey DESC, l_returnflag DESC) AS r FROM lineitem) c ON l_orderkey = o_orderkey AND r = 1""",
    "upsert_rows": """
SELECT c_custkey, CASE WHEN c_custkey % 3 > 0 THEN c_name END AS c_name, CASE WHEN (c_custkey % 2 = 0 OR c_custkey % 3 = 0) AND c_custkey % 5 > 0 THEN upper(c_mktsegment) WHEN c_custkey % 3 > 0 THEN c_mktsegment END AS c_mktsegment,
  CASE WHEN c_custkey % 2 = 0 OR c_custkey % 3 = 0 THEN c_nationkey END AS extra FROM customer""",
    "set_algebra": """
SELECT kind, count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS ids FROM (SELECT 'both' AS kind, doc_id FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels)
  UNION ALL SELECT 'only', doc_id FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels) UNION ALL SELECT 'some', doc_id FROM (SELECT doc_id FROM labels WHERE toxic = 1 UNION SELECT doc_id FROM documents WHERE doc_id % 10 = 0)) GROUP BY kind""",
    "summed_log": "SELECT l_returnflag, CAST(sum(l_linenumber) AS BIGINT) AS samples, count(*) FILTER (WHERE l_quantity > 25) AS interrupted FROM lineitem GROUP BY 1",
    "stage_metrics": """
SELECT l_linestatus AS stage, l_returnflag AS replica, count(*) AS batches, CAST(sum(l_linenumber) AS BIGINT) AS requests, sum(l_quantity) AS seconds, max(l_quantity) AS longest, sum(l_quantity) / count(*) AS per_batch, sum(l_quantity) / sum(l_linenumber) AS per_request FROM lineitem GROUP BY ALL""",
    "status_counts": """
WITH s AS (SELECT CASE WHEN doc_id % 7 = 0 THEN 'failed' WHEN doc_id % 8 = 0 THEN 'pending' ELSE 'done' END AS a, CASE WHEN doc_id % 5 = 0 THEN 'failed' WHEN doc_id % 6 = 0 THEN 'pending' ELSE 'done' END AS b, CASE WHEN doc_id % 3 = 0 THEN 'failed' WHEN doc_id % 4 = 0 THEN 'pending' ELSE 'done' END AS c FROM documents)
SELECT 'download' AS stage, count(*) FILTER (WHERE a = 'done') AS done, count(*) FILTER (WHERE a = 'failed') AS failed, count(*) FILTER (WHERE a = 'pending') AS pending FROM s
UNION ALL SELECT 'caption', count(*) FILTER (WHERE b = 'done'), count(*) FILTER (WHERE b = 'failed'), count(*) FILTER (WHERE b = 'pending' AND a = 'done') FROM s
UNION ALL SELECT 'describe', count(*) FILTER (WHERE c = 'done'), count(*) FILTER (WHERE c = 'failed'), count(*) FILTER (WHERE c = 'pending' AND b = 'done') FROM s""",
    "frame_plan": """
WITH d AS (SELECT doc_id, CAST(n_chars % 300 / 10 AS DOUBLE) AS d FROM documents), f AS (SELECT *, CASE WHEN d <= 0.5 THEN 1 WHEN d <= 2 THEN 4 WHEN d <= 5 THEN 8 WHEN d <= 10 THEN 16 ELSE 20 END AS n FROM d)
SELECT doc_id, CAST(n AS BIGINT) AS frames, round(CASE WHEN n = 1 THEN d / 2 ELSE d END, 6) AS last, CAST(n AS BIGINT) AS n FROM f""",
    "normal_intervals": """
WITH e AS (SELECT l_orderkey, l_linenumber, l_quantity - 20 AS s, l_linenumber * 8 - l_quantity AS e FROM lineitem), o AS (SELECT *, least(s, e) AS a, greatest(s, e) AS b FROM e),
l AS (SELECT *, CASE WHEN a = b THEN greatest(a - 2.5, 0.0) ELSE a END AS lo FROM o), h AS (SELECT *, least(CASE WHEN a = b THEN lo + 5 ELSE b END, lo + 30) AS hi FROM l)
SELECT l_orderkey, l_linenumber, CASE WHEN hi > lo AND hi > 0 THEN CAST(lo AS DOUBLE) END AS start, CASE WHEN hi > lo AND hi > 0 THEN CAST(hi AS DOUBLE) END AS "end" FROM h""",
    "session_gap": """
WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 1 HOUR THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
SELECT user_id, epoch_us(min(ts)) AS session_start, epoch_us(max(ts) + INTERVAL 1 HOUR) AS session_end, count(*) AS n FROM s GROUP BY user_id, s""",
    "live_entries": "SELECT user_id, event_type, event_id AS seq, event_id * 13 % 5000 AS expires FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS r FROM events) WHERE r = 1 AND event_id * 13 % 5000 > 2500",
    "selected_videos": "SELECT doc_id, CAST(n_chars AS VARCHAR) AS duration FROM documents WHERE doc_id % 4 <> 0 AND doc_id % 11 <> 0 AND n_chars BETWEEN 60 AND 60000",
    "evaluable_samples": "SELECT role, turn % 3 <> 1 AND coalesce(trim(text), '') <> '' AS judged, count(*) AS n FROM conversations GROUP BY ALL",
    "payload_rows": """
WITH m AS (SELECT *, CAST(trunc(l_extendedprice / 7 * 1000) AS BIGINT) AS a, CAST(trunc((l_extendedprice / 7 + l_quantity / 3) * 1000) AS BIGINT) AS b FROM lineitem)
SELECT l_orderkey, l_linenumber, l_returnflag AS kind, a AS start_time_ms, b AS end_time_ms, b - a AS duration_ms FROM m""",
    "exact_text_match": """
SELECT p.p_partkey, p.p_type, f.k AS first_part, f.b AS first_brand
FROM part p LEFT JOIN (SELECT p_type, min(p_partkey) AS k, arg_min(p_brand, p_partkey) AS b FROM part WHERE p_retailprice > 1500 GROUP BY 1) f USING (p_type)""",
    "confident_texts": """
WITH e AS (SELECT user_id, event_id // 20 AS frame, event_id AS pos, event_type || CAST(event_id % 6 AS VARCHAR) AS text FROM events WHERE event_id % 10 > 5),
f AS (SELECT *, row_number() OVER (PARTITION BY user_id, text ORDER BY frame, pos) AS r FROM e)
SELECT user_id, frame, string_agg(text, ' ' ORDER BY pos) AS text FROM f WHERE r = 1 GROUP BY 1, 2""",
    "batch_order": """
WITH b AS (SELECT event_type || CAST(user_id % 5 AS VARCHAR) AS bucket, CAST(min(event_id) AS DOUBLE) AS oldest, count(*) AS requests FROM events GROUP BY 1)
SELECT bucket, oldest, requests, row_number() OVER (ORDER BY CASE WHEN 10000 - oldest > 9990 THEN 0 ELSE 1 END, CASE WHEN 10000 - oldest > 9990 THEN oldest END, requests DESC, oldest, bucket) AS place FROM b""",
    "content_ids": """
WITH h AS (SELECT *, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('order/' || CAST(o_orderkey AS VARCHAR))) AS h FROM orders)
SELECT o_orderkey, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || translate(h[17:17], '0123456789abcdef', '89ab89ab89ab89ab') || h[18:20] || '-' || h[21:32] AS uuid,
  sha256('{"modalities":["' || least(o_orderpriority, o_orderstatus) || '","' || greatest(o_orderpriority, o_orderstatus) || '"],"query":"' || o_orderpriority || '","video":' || CAST(o_custkey AS VARCHAR) || '}') AS cache_key,
  strftime(o_orderdate, '%Y-%m-%d') AS day FROM h""",
    "worker_segments": """
SELECT doc_id, worker, round(worker * (n_chars / 32), 6) AS start, round(CASE WHEN worker = 3 THEN n_chars / 8 ELSE (worker + 1) * (n_chars / 32) END, 6) AS "end", CAST(floor(worker * (n_chars / 32) * 5.0::DOUBLE) AS BIGINT) AS first_frame
FROM documents, (SELECT unnest(generate_series(0, 3)) AS worker)""",
    "labels_and_weights": """
SELECT doc_id, CASE WHEN n_chars = 0 THEN '0 B' WHEN n_chars < 1024 THEN printf('%.1f B', n_chars::DOUBLE) WHEN n_chars < 1048576 THEN printf('%.1f KB', n_chars / 1024) ELSE printf('%.1f MB', n_chars / 1048576) END AS size,
  CAST(CASE doc_id % 6 WHEN 0 THEN 5 WHEN 2 THEN 1 WHEN 3 THEN -5 ELSE 3 END AS BIGINT) AS weight FROM documents""",
    "choices": r"""
SELECT conv_id, turn, nullif(regexp_extract(translate(text, 'abcde', 'ABCDE'), '(?s)^.*(?:^|[^A-Za-z])\(?([ABCDE])(?:\)|\.|:|\s|$)', 1), '') AS choice FROM conversations""",
    "subtitles": """
WITH l AS (SELECT conv_id, turn, string_split(text, chr(10)) AS l FROM conversations),
x AS (SELECT conv_id, turn, unnest(generate_series(0, len(l) - 1)) AS i, unnest(l) AS t FROM l)
SELECT conv_id, turn, CAST(i * 5 AS DOUBLE) AS start, md5(trim(t)) AS text FROM x WHERE trim(t) <> ''""",
}
