"""DuckDB SQL for tidemark.plans.training."""

from tidemark.functions.text import BREAK_FROM, BREAKS

_WORLD, _SIZE = 4, 32


def _grouped(name: str, test: str, seed: str) -> str:
    """Common table expressions up to {name}: doc_id, megabatch, replica, slot, place of the rows that pass the test."""
    return f"""
{name}_at AS (SELECT doc_id, n_chars AS n, row_number() OVER (ORDER BY md5('{seed}:' || doc_id), doc_id) - 1 AS place FROM documents WHERE {test}),
{name}_in AS (SELECT *, place // {_SIZE} AS m, count(*) OVER (PARTITION BY place // {_SIZE}) AS size, row_number() OVER (PARTITION BY place // {_SIZE} ORDER BY n DESC, place) AS i FROM {name}_at),
{name}_go AS (
  SELECT DISTINCT m, CAST(0 AS BIGINT) AS i, CAST(-1 AS BIGINT) AS r, [0, 0, 0, 0]::BIGINT[] AS loads, [0, 0, 0, 0]::BIGINT[] AS counts FROM {name}_in
  UNION ALL
  SELECT m, i, r, list_transform(range({_WORLD}), lambda w: CASE WHEN w = r THEN loads[w + 1] + n ELSE loads[w + 1] END), list_transform(range({_WORLD}), lambda w: CASE WHEN w = r THEN counts[w + 1] + 1 ELSE counts[w + 1] END)
  FROM (SELECT g.m, x.i, x.n, loads, counts, CASE WHEN size % {_WORLD} <> 0 THEN (x.i - 1) % {_WORLD} ELSE
      list_position(list_transform(range({_WORLD}), lambda w: CASE WHEN counts[w + 1] < size // {_WORLD} THEN loads[w + 1] ELSE 1000000000000 END), list_min(list_transform(range({_WORLD}), lambda w: CASE WHEN counts[w + 1] < size // {_WORLD} THEN loads[w + 1] ELSE 1000000000000 END))) - 1 END AS r
    FROM {name}_go g JOIN {name}_in x ON x.m = g.m AND x.i = g.i + 1)),
{name} AS (SELECT doc_id, m AS megabatch, r AS replica, row_number() OVER (PARTITION BY m, r ORDER BY g.i) - 1 AS slot, m * {_SIZE} + row_number() OVER (PARTITION BY m ORDER BY r, g.i) - 1 AS place FROM {name}_go g JOIN {name}_in x USING (m, i))"""


def _broken() -> str:
    """Where to cut the text `rest` of over 100 characters: behind the last break, by kind, that is not too early."""
    ends = []
    for mark in BREAKS:
        found = f"strpos(reverse(rest[1:100]), '{mark[::-1]}')"
        ends.append(f"CASE WHEN {found} > 0 AND 100 - {found} - {len(mark)} + 1 > len(rest) * {BREAK_FROM} THEN 100 - {found} + 1 END")
    return f"coalesce({', '.join(ends)}, 100)"


_SENTENCES = rf"""
WITH RECURSIVE bodies AS (SELECT conv_id, turn, regexp_extract_all(text, '([^.!?]*)([.!?]|$)', 1) AS b, regexp_extract_all(text, '([^.!?]*)([.!?]|$)', 2) AS e FROM conversations),
wholes AS (SELECT conv_id, turn, i, regexp_replace(b[i], '^\s+|\s+$', '', 'g') || e[i] AS s FROM (SELECT *, unnest(generate_series(1, len(b))) AS i FROM bodies)),
cuts AS (
  SELECT conv_id, turn, i, 0 AS j, s AS rest, CAST(NULL AS VARCHAR) AS part FROM wholes
  UNION ALL
  SELECT conv_id, turn, i, j + 1, regexp_replace(rest[c + 1:], '^\s+|\s+$', '', 'g'), regexp_replace(rest[1:c], '^\s+|\s+$', '', 'g') FROM (SELECT *, CASE WHEN len(rest) <= 100 THEN len(rest) ELSE {_broken()} END AS c FROM cuts WHERE rest <> '')),
sentences AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, turn ORDER BY i, j) - 1 AS pos, part FROM cuts WHERE part IS NOT NULL AND len(part) > 3)
"""

SQL: dict[str, str] = {
    "length_batches": f"WITH RECURSIVE {_grouped('x', 'true', '0')} SELECT * FROM x",
    "modality_batches": f"""
WITH RECURSIVE {_grouped("mm", "lang IN ('en', 'de')", "0:mm")}, {_grouped("tx", "lang NOT IN ('en', 'de')", "0:text")},
both_ AS (SELECT true AS multimodal, * FROM mm UNION ALL SELECT false, * FROM tx),
marked AS (SELECT *, megabatch = max(megabatch) OVER (PARTITION BY multimodal) AS rest FROM both_),
news AS (SELECT multimodal, megabatch, row_number() OVER (ORDER BY md5('0:' || multimodal || ':' || megabatch)) - 1 AS new FROM (SELECT DISTINCT multimodal, megabatch FROM marked WHERE NOT rest)),
whole AS (SELECT doc_id, multimodal, new AS megabatch, replica, new * {_SIZE} + place % {_SIZE} AS place FROM marked JOIN news USING (multimodal, megabatch) WHERE NOT rest),
n AS (SELECT count(*) AS n FROM news)
SELECT * FROM whole UNION ALL SELECT doc_id, multimodal, n AS megabatch, -1, n * {_SIZE} + row_number() OVER (ORDER BY doc_id) - 1 FROM marked, n WHERE rest""",
    "proportional_order": """
WITH RECURSIVE s AS (SELECT source, count(*) // 8 * 2 AS own FROM documents WHERE source IS NOT NULL GROUP BY source HAVING count(*) >= 8),
k AS (SELECT *, row_number() OVER (ORDER BY own DESC, source) AS k FROM s),
go AS (
  SELECT CAST(0 AS BIGINT) AS k, CAST('' AS VARCHAR) AS source, range(CAST((SELECT sum(own) FROM s) AS BIGINT)) AS free, CAST([] AS BIGINT[]) AS taken
  UNION ALL
  SELECT k, source, list_filter(free, lambda x: NOT list_contains(taken, x)), taken FROM (SELECT k.k, k.source, free, list_transform(range(own), lambda i: free[i * len(free) // own + 1]) AS taken FROM go JOIN k ON k.k = go.k + 1)),
d AS (SELECT doc_id, source, own, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS at_ FROM documents JOIN s USING (source)),
r AS (SELECT doc_id, source, at_ // own AS replica FROM d WHERE at_ < own * 4),
o AS (SELECT *, row_number() OVER (PARTITION BY source, replica ORDER BY md5('3:1:' || doc_id)) AS i FROM r)
SELECT doc_id, source, CAST(replica AS BIGINT) AS replica, taken[i] AS place FROM o JOIN go USING (source)""",
    "strided_shard": "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY lang NULLS FIRST, doc_id) - 1 AS i FROM documents) WHERE i % 8 = 1",
    "resample_plan": "SELECT doc_id, coalesce(n_chars / 200 > 10 OR n_chars / 100 > 30 OR r > 24000, false) AS resample, CASE WHEN coalesce(n_chars / 200 > 10 OR n_chars / 100 > 30 OR r > 24000, false) THEN 12000 ELSE 16000 END AS rate FROM (SELECT *, CASE WHEN doc_id % 9 <> 0 THEN 8000 + doc_id % 5 * 8000 END AS r FROM documents)",
    "text_neighbours": r"""
WITH w AS (SELECT conv_id, turn, role, md5(unnest(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> ''))) AS h FROM conversations),
c AS (SELECT conv_id, turn, role, CAST('0x' || h[15:16] AS BIGINT) % 32 AS i, sum(CASE WHEN h[1] >= '8' THEN 1 ELSE -1 END) AS x FROM w GROUP BY ALL),
v AS (SELECT conv_id, turn, role, i, CAST(x / sqrt(sum(x * x) OVER (PARTITION BY conv_id, turn)) AS FLOAT)::DOUBLE AS x FROM c WHERE x <> 0),
l AS (SELECT *, sqrt(sum(x * x) OVER (PARTITION BY conv_id, turn)) AS len FROM v),
first AS (SELECT conv_id, min(turn) AS turn FROM conversations WHERE conv_id % 50 = 0 AND role = 'user' GROUP BY conv_id),
q AS (SELECT conv_id AS query_id, i, x / len AS x FROM l JOIN first USING (conv_id, turn)),
p AS (SELECT f.conv_id AS query_id, c.conv_id, c.turn FROM first f, conversations c),
s AS (SELECT query_id, conv_id, turn, sum(q.x * l.x / len) AS score FROM q JOIN l USING (i) GROUP BY ALL),
r AS (SELECT query_id, coalesce(score, 0) AS score, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(score, 0) DESC) AS rank FROM p LEFT JOIN s USING (query_id, conv_id, turn))
SELECT query_id, rank, round(score, 6) AS score FROM r WHERE rank <= 5""",
    "sentence_rows": _SENTENCES + "SELECT conv_id, turn, CAST(pos AS INTEGER) AS pos, md5(part) AS sentence FROM sentences",
    "split_sentences": _SENTENCES + "SELECT conv_id, turn, count(*) AS sentences, max(len(part)) AS longest FROM sentences GROUP BY conv_id, turn",
    "clip_rows": """
WITH v AS (SELECT doc_id, n_chars / 10 AS d FROM documents),
c AS (SELECT doc_id, d, unnest(generate_series(0, CAST(floor(d / 10) AS BIGINT) + CASE WHEN d % 10 > 1 THEN 0 ELSE -1 END)) AS clip FROM v)
SELECT doc_id, clip, round(CAST(clip * 10 AS DOUBLE), 6) AS clip_start, round(least(clip * 10 + 10, d), 6) AS clip_end FROM c WHERE least(clip * 10 + 10, d) - clip * 10 >= 0.5""",
    "silence_rows": """
WITH e AS (SELECT user_id AS video, epoch_us(ts) / 1e6 AS s, max(epoch_us(ts) / 1e6 + 60) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM events)
SELECT video, round(b, 3) AS start, round(s, 3) AS "end" FROM e WHERE s - b >= 3600""",
    "store_scroll": "SELECT vec_id, label, len(embedding) AS width FROM embeddings WHERE label IN (1, 3, 5) AND vec_id >= 20",
    "greedy_cluster": """
WITH RECURSIVE v AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS i, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
u AS (SELECT label, vec_id, i, list_transform(e, lambda x: x / greatest(sqrt(list_dot_product(e, e)), 1e-300)) AS e FROM v),
go AS (
  SELECT DISTINCT label, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS vec_id, CAST([] AS DOUBLE[][]) AS heads, CAST([] AS BIGINT[]) AS names, CAST(NULL AS BIGINT) AS own FROM v
  UNION ALL
  SELECT label, i, vec_id, CASE WHEN best > 0.7 THEN heads ELSE list_append(heads, e) END, CASE WHEN best > 0.7 THEN names ELSE list_append(names, vec_id) END, CASE WHEN best > 0.7 THEN names[list_position(near, best)] ELSE vec_id END
  FROM (SELECT *, coalesce(list_max(near), -1) AS best FROM (SELECT g.label, u.i, u.vec_id, heads, names, e, list_transform(heads, lambda h: list_dot_product(h, e)) AS near FROM go g JOIN u ON u.label = g.label AND u.i = g.i + 1)))
SELECT label, vec_id, 'item ' || vec_id || ', more' AS item, 'item ' || own AS cluster FROM go WHERE i > 0""",
}
