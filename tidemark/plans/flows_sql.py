"""DuckDB SQL for tidemark.plans.flows."""

_E = "e AS (SELECT event_id AS id, epoch_us(ts) AS us, CAST(user_id AS VARCHAR) AS key, user_id, event_type, value FROM events)"
_PARTS = f"""
WITH {_E},
p AS (SELECT key || ':' || CAST(floor(us / 1e6 / 259200) AS BIGINT) AS key, event_type AS part, us, user_id % 3 AS priority, min(us) OVER (PARTITION BY key, floor(us / 1e6 / 259200)) + 129600000000 AS last FROM e),
f AS (SELECT key, part, min(us) AS us, min(last) AS last, min(priority) AS priority FROM p WHERE us <= last GROUP BY key, part),
n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY us) AS r FROM f),
told AS (SELECT key, CASE WHEN max(r) >= 4 THEN 'complete' ELSE 'incomplete' END AS state, least(max(r), 4) AS parts, CASE WHEN max(r) >= 4 THEN min(us) FILTER (r = 4) ELSE min(last) END AS us, min(priority) AS priority FROM n GROUP BY key)
"""

SQL: dict[str, str] = {
    "stream_dedupe": f"""
WITH RECURSIVE {_E},
k AS (SELECT key || '/' || event_type AS key, id, us, row_number() OVER (PARTITION BY key, event_type ORDER BY us, id) AS r FROM e),
kept AS (SELECT key, id, us FROM k WHERE r = 1
  UNION ALL SELECT key, id, us FROM (SELECT k.key, k.id, k.us, row_number() OVER (PARTITION BY k.key ORDER BY k.us, k.id) AS n FROM kept JOIN k ON k.key = kept.key AND k.us >= kept.us + 3600000000) WHERE n = 1)
SELECT key, id FROM kept""",
    "stream_cache": f"""
WITH {_E},
w AS (SELECT *, event_type IN ('purchase', 'signup') AS write, CASE WHEN event_type = 'purchase' OR user_id % 10 <> 0 THEN us + CAST(round(value * 3600 * 1e6) AS BIGINT) END AS expires FROM e),
b AS (SELECT *, last_value(CASE WHEN write THEN {{'id': id, 'expires': expires}} END IGNORE NULLS) OVER (PARTITION BY key ORDER BY us, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS entry FROM w),
r AS (SELECT key, id, entry, entry IS NOT NULL AND (entry.expires IS NULL OR entry.expires > us) AS hit FROM b WHERE NOT write)
SELECT key, id, hit, CASE WHEN hit THEN CAST(entry.id AS VARCHAR) END AS value FROM r""",
    "stream_completion": _PARTS + "SELECT key, state, parts, us AS told_at FROM told",
    "stream_chained": _PARTS + "SELECT row_number() OVER (ORDER BY priority, us, key) - 1 AS place, key, priority FROM told WHERE state = 'complete'",
    "stream_stuck": f"""
WITH {_E},
s AS (SELECT key, event_type AS stage, us, lead(us) OVER (PARTITION BY key ORDER BY us, id) AS nxt, CASE event_type WHEN 'click' THEN 21600000000 ELSE 86400000000 END AS span FROM e)
SELECT key, stage, 'failed' AS state, us AS since, us + span AS failed_at FROM s WHERE stage IN ('click', 'view') AND (nxt IS NULL OR nxt > us + span)""",
    "stream_reorder": f"""
WITH {_E},
f AS (SELECT key, id, row_number() OVER (PARTITION BY key ORDER BY us, id) - 1 AS number, event_type AS value FROM e)
SELECT key, row_number() OVER (PARTITION BY key ORDER BY number) - 1 AS place, number, value FROM f WHERE id % 97 <> 0""",
    "stream_windows": f"WITH {_E} SELECT CAST(floor(us / 1e6 / 21600) * 21600 AS BIGINT) AS w_start, event_type, count(*) AS n FROM e GROUP BY ALL",
    "stream_sessions": f"""
WITH {_E},
g AS (SELECT key, us, CASE WHEN us - lag(us) OVER (PARTITION BY key ORDER BY us) < 43200000000 THEN 0 ELSE 1 END AS new FROM e),
s AS (SELECT key, us, sum(new) OVER (PARTITION BY key ORDER BY us) AS i FROM g)
SELECT key, min(us) AS session_start, count(*) AS n FROM s GROUP BY key, i""",
}
