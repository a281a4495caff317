"""DuckDB SQL for the queries that SQL can express."""



def _conversation_repair() -> str:
    """A recursive query over the rows of each conversation; a way is its cost in eight digits, then its edits, so that the least string is the best way."""

    def then(way: str, cost: str, edit: str) -> str:
        return f"(printf('%08d', CAST({way}[1:8] AS BIGINT) + {cost}) || {way}[9:] || '{edit}')"

    def when(test: str, way: str) -> str:
        return f"CASE WHEN {test} THEN {way} END"

    crc = "xor(list_reduce(list_concat([4294967295], list_transform(string_split(key, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda r, b: list_reduce([xor(r, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END)), 4294967295)"
    letter, white = "left(role, 1)", "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""
WITH RECURSIVE raw AS (SELECT dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS c, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
kinds AS (SELECT *, {crc} % 20 AS kind FROM raw),
rows AS (SELECT c, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE kind WHEN 3 THEN [0, 1] ELSE [0] END) AS copy FROM kinds WHERE kind <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, text, copy) AS i, rtrim(text, {white}) AS said FROM rows),
faults AS (SELECT *, CASE WHEN said = '' THEN 1 WHEN row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 THEN 2 WHEN right(said, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault, lag({letter}) OVER (PARTITION BY c ORDER BY i) AS before FROM placed),
coded AS (SELECT *, {letter} AS r, fault IN (0, 3) AS keep, CASE fault WHEN 3 THEN 3 ELSE 0 END AS extra FROM faults),
ways AS (
  SELECT DISTINCT c, CAST(0 AS BIGINT) AS i, '00000000' AS n, CAST(NULL AS VARCHAR) AS s, CAST(NULL AS VARCHAR) AS u, CAST(NULL AS VARCHAR) AS a FROM raw
  UNION ALL
  SELECT c, i, {then('n', '4', 'D')} AS n,
    least({then('s', '4', 'D')}, {when("keep AND r = 's'", then('n', 'extra', 'K'))}) AS s,
    least({then('u2', '4', 'D')}, {when("keep AND r = 'u'", then('least(n, s, a1)', 'extra', 'K'))}, {when('keep', then('least(n, s, a1)', '3 + extra', 'R'))}) AS u,
    least({then('a1', '4', 'D')}, {when("keep AND r = 'a'", then('u2', 'extra', 'K'))}, {when('keep', then('u2', '3 + extra', 'R'))}) AS a
  FROM (SELECT *, least(u1, {then('a', '3', 'I')}) AS u2, least(a, {then('u1', '3', 'I')}) AS a1
    FROM (SELECT w.c, x.i, n, s, u, a, r, keep, extra, least(u, {then('n', '3', 'I')}, {then('s', '3', 'I')}) AS u1 FROM ways w JOIN coded x ON x.c = w.c AND x.i = w.i + 1))),
ends AS (SELECT c, least(n, a, {then('u', '3', 'I')}, {then('s', '6', 'II')}) AS way FROM ways QUALIFY row_number() OVER (PARTITION BY c ORDER BY i DESC) = 1),
edits AS (SELECT c, e, p, sum(CASE WHEN e = 'I' THEN 0 ELSE 1 END) OVER w AS i, sum(CASE WHEN e = 'D' THEN 0 ELSE 1 END) OVER w AS line
  FROM (SELECT c, unnest(string_split(way[9:], '')) AS e, unnest(generate_series(1, len(way) - 8)) AS p FROM ends WHERE len(way) > 8) WINDOW w AS (PARTITION BY c ORDER BY p)),
lines AS (SELECT e.c, p, line, e, role, text, max(CASE WHEN line = 1 AND e = 'K' AND r = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY e.c) AS head FROM edits e LEFT JOIN coded x ON x.c = e.c AND x.i = e.i WHERE e <> 'D'),
texts AS (SELECT c, string_agg(CASE e WHEN 'K' THEN role ELSE CASE (line - head) % 2 WHEN 1 THEN 'user' ELSE 'assistant' END END || ':' || CASE e WHEN 'I' THEN '' ELSE text END, chr(10) ORDER BY p) AS t FROM lines GROUP BY c),
sums AS (SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (i > 1 AND before || r NOT IN ('su', 'ua', 'au')) AS illegal FROM coded GROUP BY c),
ids AS (SELECT DISTINCT c, conv_id FROM raw)
SELECT conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal,
  CAST(way[1:8] AS BIGINT) AS cost, way[9:] AS audit, sha256(coalesce(t, '')) AS repaired_sha256
FROM ids JOIN ends USING (c) LEFT JOIN sums USING (c) LEFT JOIN texts USING (c)"""


SQL: dict[str, str] = {
    "op4_substring_dedup": r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i+19], ' ') AS s FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 19)) AS i FROM d WHERE len(w) >= 20)),
late AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS r FROM win) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 19)) AS p FROM late),
words AS (SELECT doc_id, unnest(w) AS x, unnest(generate_series(1, len(w))) AS p FROM d),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(kept.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)""",
    "op6_decontamination": r"""
WITH b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, len(w) AS k, array_to_string(w, ' ') AS s FROM b WHERE len(w) BETWEEN 1 AND 9
  UNION
  SELECT DISTINCT item_id, 10, array_to_string(w[i:i+9], ' ') FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - 9)) AS i FROM b WHERE len(w) >= 10)),
d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
ks AS (SELECT DISTINCT k FROM win),
dw AS (SELECT doc_id, k, i, array_to_string(w[i:i+k-1], ' ') AS s FROM (SELECT doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM d, ks WHERE len(w) >= k)),
m AS (SELECT doc_id, i, k, item_id FROM dw JOIN win USING (k, s)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(generate_series(i, i + k - 1)) AS p FROM (SELECT DISTINCT doc_id, i, k FROM m)) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n, sha256(string_agg(s, ',' ORDER BY s)) AS h FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(hit.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(its.n, 0) AS BIGINT) AS n_items,
  coalesce(its.h, sha256('')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)""",
    "op7_top_k": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5""",
    "op12_fill_in_middle": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
k AS (SELECT *, len(u) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM k),
p AS (SELECT *, array_to_string(list_slice(u, 1, a), '') AS pre, array_to_string(list_slice(u, a + 1, b), '') AS mid, array_to_string(list_slice(u, b + 1, n), '') AS suf FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256
FROM p""",
    "op13_conversation_repair": _conversation_repair(),
}
