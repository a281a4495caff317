"""DuckDB SQL for tidemark.plans.files."""

SQL: dict[str, str] = {
    "folders_by_key": "SELECT place, lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents, (SELECT unnest(['folder', 'all']) AS place) GROUP BY place, lang",
    "documents_in_files": """
WITH s AS (SELECT source, count(*) AS n, max(doc_id) AS last, row_number() OVER (ORDER BY source) AS r FROM documents GROUP BY source)
SELECT source, n, last, 'good' AS how FROM s WHERE n % 2 = 0 UNION ALL SELECT source, n, last, 'first' FROM s WHERE r <= 2 AND n % 2 = 0""",
    "listed_ids": "SELECT doc_id, printf('d%06d', doc_id) AS id FROM documents WHERE doc_id % 5 <> 0 AND doc_id % 7 <> 0 AND doc_id % 3 > 0",
    "cached_subset": "SELECT doc_id, lang FROM (SELECT *, row_number() OVER (ORDER BY n_chars, doc_id) AS r FROM documents) WHERE r <= 1000",
    "artefact_shards": "SELECT h[1:2] AS shard, count(*) AS n, CAST(sum(c) AS BIGINT) AS chars FROM (SELECT md5(text) AS h, max(n_chars) AS c FROM documents GROUP BY 1) GROUP BY 1",
    "run_log": "SELECT CAST(o_custkey % 2 AS INTEGER) AS run, count(*) AS requests, round(sum(o_totalprice), 2) AS cost FROM orders GROUP BY 1",
    "searched_modalities": """
WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id % 50 = 0 ORDER BY vec_id LIMIT 1),
s AS (SELECT vec_id, label, list_cosine_similarity(CAST(embeddings.embedding AS DOUBLE[]), CAST(q.e AS DOUBLE[])) AS s FROM embeddings, q WHERE label IN (1, 4)),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY s DESC, vec_id) AS r FROM s)
SELECT vec_id AS raw_id, 't' || label AS modality FROM r WHERE r <= 20 AND vec_id <= 400""",
    "answered_samples": "SELECT conv_id, count(*) AS turns FROM conversations GROUP BY conv_id HAVING count(*) FILTER (role = 'assistant' AND length(text) <= 200) = 0",
    "retry_plan": "SELECT user_id, count(*) FILTER (event_id % 7 NOT IN (0, 1)) AS again, round(max(value), 6) AS free, coalesce(round(max(value), 6) >= 50, false) AS available FROM events GROUP BY user_id",
    "deleted_keys": "SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')",
    "ranked_values": "SELECT p_type AS type, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, p_type) - 1 AS place FROM part GROUP BY p_type",
    "model_specs": """
WITH f AS (SELECT doc_id AS i, source || CASE WHEN doc_id % 19 = 0 THEN '' ELSE ':' || CASE WHEN doc_id % 23 = 0 THEN 'x' ELSE CAST(doc_id % 8 AS VARCHAR) END END
    || list_reduce(list_transform([(2, ':omni'), (3, ':hf'), (5, ':api'), (7, ':f64'), (11, ':mount'), (13, ':fast'), (17, ':f8')], lambda p: CASE WHEN doc_id % p[1] = 0 THEN p[2] ELSE '' END), lambda a, b: a || b) AS body,
    CASE WHEN doc_id % 4 = 0 THEN lang END AS alias FROM documents),
p AS (SELECT i, alias, string_split(body, ':') AS p FROM f),
q AS (SELECT i, alias, p[1] AS name, TRY_CAST(p[2] AS INTEGER) AS gpus, p[3:] AS flags FROM p)
SELECT i AS doc_id, name, CASE WHEN list_contains(flags, 'api') THEN 0 ELSE gpus END AS gpus, list_contains(flags, 'omni') AS omni, CASE WHEN list_contains(flags, 'api') THEN 'api' WHEN list_contains(flags, 'hf') THEN 'hf' ELSE 'vllm' END AS backend,
  CASE WHEN list_contains(flags, 'f64') THEN 64 WHEN list_contains(flags, 'f8') THEN 8 ELSE 0 END AS frames, list_contains(flags, 'audio') AS audio, alias, list_contains(flags, 'mount') AS mount
FROM q WHERE gpus IS NOT NULL""",
    "event_days": "SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, round(min(epoch_us(ts) / 1e6), 3) AS first FROM events GROUP BY ALL",
}
