"""The same questions in plain SQL over the same tables, for checking the registered queries."""

from .catalog import COLUMNS, DAY, HOUR, NOW_MS, PX, SECOND, T0, T1
from .event_views import EPOCH_MS, ORIGIN_NS

_VIEWS = f"""
b AS (SELECT CASE WHEN user_id % 8 < 5 THEN 'cap-a' WHEN user_id % 8 < 7 THEN 'cap-b' ELSE 'cap-c' END AS capture_id,
  event_id AS seq, user_id % 8 AS thread, user_id AS gid, epoch_us(ts) * 1000 - {ORIGIN_NS} AS start, event_type,
  value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
timed AS (SELECT *, CAST(round(value * 1000000) AS BIGINT) AS dur,
  CAST(round(value * 60000000000) AS BIGINT) AS dense_dur, gid % 10 = 0 AS is_hub FROM b),
e AS (SELECT capture_id, seq, thread, gid, start, dur, start + dur AS stop,
  CASE WHEN is_hub THEN 'Hub-' ELSE 'Greenlet-' END || gid AS name,
  'app.py:' || event_type || ':' || k AS func, CASE WHEN k % 3 = 0 THEN '' ELSE 'req-' || k END AS task,
  CASE WHEN value >= 20 AND NOT is_hub THEN '/srv/app/app.py:' || event_type || ':' || k
    || ' <- /usr/lib/gevent/hub.py:switch:1 <- /srv/app/main.py:main:2' ELSE '' END AS stack, is_hub FROM timed),
dense AS (SELECT e.* REPLACE (t.dense_dur AS dur, t.start + t.dense_dur AS stop) FROM e JOIN timed t USING (seq)),
gc AS (SELECT capture_id, seq, start, CAST(round(value * 100000) AS BIGINT) AS dur, gid % 3 AS generation,
  k AS collected FROM b WHERE event_type = 'error'),
samples AS (SELECT capture_id, seq, start, value AS lag_ms_s, CAST(least(1000, k * 10) AS DOUBLE) AS cpu_ms_s
  FROM b WHERE event_type = 'view'),
counters AS (SELECT capture_id, seq, gid, start,
  CAST(sum(CAST(round(value * 1000000) AS BIGINT)) OVER w AS BIGINT) AS on_cpu_ns,
  CAST(sum(k * 1000000) OVER w AS BIGINT) AS runq_ns FROM b
  WINDOW w AS (PARTITION BY capture_id, gid ORDER BY seq ROWS UNBOUNDED PRECEDING)),
switches AS (SELECT capture_id, seq, thread, start AS ts, gid AS target, name AS label, func, task, stack FROM e),
fast AS (SELECT capture_id, seq, thread, ts // 100000 AS ts FROM switches),
probes AS (SELECT capture_id, seq AS probe_id, gid, start + (k - 50) * 1000000000 AS t,
  CAST(round(value * 1000000000) AS BIGINT) AS dur FROM b WHERE event_type = 'purchase'),
viewports AS (SELECT capture_id, seq AS probe_id, start AS t0, start + (k + 1) * 10000000000 AS t1
  FROM b WHERE event_type = 'signup')"""

ORACLES = {}


def _sql(name, body, *ctes):
    ORACLES[name] = "WITH " + ",\n".join([_VIEWS.strip(), *ctes]) + "\n" + body


def _rows(name, columns, table="e", where="", *ctes):
    _sql(name, f"SELECT capture_id, seq, {columns} FROM {table} {where}", *ctes)


IN_WINDOW = f"start < {T1} AND stop > {T0}"

_rows("read_capture", "gid, start, dur, name, func, task, stack, is_hub")
_sql("read_capture_tables", f"""SELECT capture_id, count(*) AS rows, min(seq) AS first_seq, max(largest) AS largest, name
  FROM (SELECT capture_id, seq, stop AS largest, 'executions' AS name FROM e
  UNION ALL SELECT capture_id, seq, start + dur, 'gc' FROM gc
  UNION ALL SELECT capture_id, seq, start, 'samples' FROM samples
  UNION ALL SELECT capture_id, seq, ts, 'switches' FROM switches
  UNION ALL SELECT capture_id, seq, CASE WHEN k % 2 = 1 THEN k + {EPOCH_MS} ELSE 0 END, 'meta' FROM b) GROUP BY ALL""")
META = """meta AS (SELECT capture_id, seq, CASE WHEN k % 2 = 1 THEN k + %d ELSE 0 END AS epoch_ms, gid AS tid,
  -k AS pid, event_type AS runtime, '3.' || k AS python FROM b)""".replace("%d", str(EPOCH_MS))
_sql("read_meta", """SELECT capture_id, arg_max(epoch_ms, seq) FILTER (epoch_ms > 0) AS epoch_ms,
  arg_max(tid, seq) AS tid, arg_max(pid, seq) AS pid, arg_max(runtime, seq) AS runtime,
  arg_max(python, seq) AS python FROM meta GROUP BY capture_id""", META)

# Predicates
_rows("is_hub", "is_hub AS plain, is_hub AS upper_case, false AS too_short")
_rows("overlaps", "start, dur", "dense", f"WHERE {IN_WINDOW}")
_rows("start_in", "start", "e", f"WHERE start > {T0} AND start < {T1}")
_rows("tier_filter", """NOT is_hub AND dur >= 20000000 AS in_all,
  NOT is_hub AND dur >= 20000000 AND dur < 50000000 AS in_long, NOT is_hub AND dur >= 50000000 AS in_blocked""")
_rows("slow_level", """CASE WHEN dur >= 50000000 THEN 2 ELSE 1 END AS log_level,
  CASE WHEN is_hub THEN 0 WHEN dur >= 50000000 THEN 2 WHEN dur >= 20000000 THEN 1 ELSE 0 END AS level""")
BAND = """CASE WHEN is_hub THEN 'hub' WHEN {d} >= 50000000 THEN 'blocked' WHEN {d} >= 20000000 THEN 'long'
  ELSE 'ok' END"""
_rows("duration_band", BAND.format(d="dur") + " AS band")
_rows("heat_score", """round(CASE WHEN is_hub THEN NULL WHEN dur <= 1000000 THEN 0 WHEN dur >= 50000000 THEN 2
  WHEN dur <= 20000000 THEN ln(dur / 1e6) / ln(20.0::DOUBLE) ELSE 1 + (dur / 1e6 - 20) / 30 END, 6) AS heat""")
_rows("track_label", """upper(event_type[1]) || event_type[2:] || CASE WHEN k % 7 > 0 THEN '-' || k ELSE '' END
  AS label""", "b")
_rows("track_name_fallback", """CASE WHEN gid % 3 = 0 THEN '0x' || lower(to_hex(gid * 1000003)) ELSE name END
  AS name""")
_rows("correlation_id", """coalesce(CASE WHEN k % 2 = 0 THEN event_type || ' ' || k END,
  CASE WHEN k % 3 = 0 THEN CAST(k AS VARCHAR) END, CASE WHEN k % 5 = 0 THEN event_type END, '') AS task""", "b")
_rows("stack_gate", """'' AS stack_off, CASE WHEN NOT is_hub AND dur >= 20000000 THEN func ELSE '' END
  AS stack_slow, func AS stack_all""")
_rows("missing_stack_reason", """CASE WHEN stack = '' AND gid % 3 = 0 THEN 'off'
  WHEN stack = '' AND gid % 3 = 1 THEN 'slow' END AS reason""")
KEPT = """ranked AS (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY seq DESC) AS r,
  count(*) OVER (PARTITION BY capture_id) AS n FROM e)"""
_sql("evicted_flag", """SELECT capture_id, coalesce(min(start) FILTER (n > 2000 AND r <= 2000), 0) AS retained_from,
  arg_min(start, seq) AS origin,
  coalesce(min(start) FILTER (n > 2000 AND r <= 2000), 0) > arg_min(start, seq) AS evicted
  FROM ranked GROUP BY capture_id""", KEPT)
_sql("drop_zero_tail", """SELECT capture_id, seq, thread, dur FROM z WHERE NOT (last AND dur = 0)""",
     """z AS (SELECT capture_id, seq, thread, CASE WHEN gid % 2 = 0 THEN 0 ELSE dur END AS dur,
  seq = max(seq) OVER (PARTITION BY capture_id, thread) AS last FROM e)""")
_rows("render_only", "start, dur, gid")

# Joins and lookups
WIN = """win AS (SELECT *, row_number() OVER (PARTITION BY capture_id, c ORDER BY seq) - 1 AS i,
  count(*) OVER (PARTITION BY capture_id, c) AS n FROM (
  SELECT 'whole' AS c, 2000000 AS cap, * FROM e WHERE {w} UNION ALL SELECT 'capped', 101, * FROM e WHERE {w}
  UNION ALL SELECT 'dense', 101, * FROM dense WHERE {w}))"""
SORTED = """ends AS (SELECT 'whole' AS c, * FROM e UNION ALL SELECT 'capped', * FROM e UNION ALL
  SELECT 'dense', * FROM dense),
seen AS (SELECT *, max(stop) OVER (PARTITION BY capture_id, c ORDER BY seq
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high FROM ends),
orders AS (SELECT capture_id, c, bool_and(coalesce(start >= high, true)) AS ok FROM seen GROUP BY ALL)"""
_sql("interval_window", """SELECT capture_id, seq, start, dur, gid, n > cap AS capped, c AS "case"
  FROM win JOIN orders USING (capture_id, c)
  WHERE i >= CASE WHEN ok AND n > cap THEN (n - cap) // 2 ELSE 0 END
    AND i < cap + CASE WHEN ok AND n > cap THEN (n - cap) // 2 ELSE 0 END""", WIN.format(w=IN_WINDOW), SORTED)
_sql("stored_window", """SELECT capture_id, seq, start, dur, gid, n > cap AS capped, c AS "case"
  FROM win JOIN orders USING (capture_id, c)
  WHERE c <> 'whole' AND i >= CASE WHEN ok AND n > cap THEN (n - cap) // 2 ELSE 0 END
    AND i < cap + CASE WHEN ok AND n > cap THEN (n - cap) // 2 ELSE 0 END""", WIN.format(w=IN_WINDOW), SORTED)
_sql("stored_retention", """SELECT capture_id, coalesce(min(start) FILTER (n > 1500 AND r <= 1500), 0) AS retained_from,
  least(any_value(n), 1500) AS held, c AS "case" FROM ranked, (VALUES ('before'), ('after')) t(c) GROUP BY capture_id, c""",
     KEPT)
_sql("stored_recent_activity", f"""SELECT capture_id, gid, CAST(sum(least(stop, now) - greatest(start, now - {10 * HOUR})) AS BIGINT)
  AS activity FROM dense JOIN (SELECT capture_id, arg_max(stop, seq) AS now FROM dense GROUP BY 1) USING (capture_id)
  WHERE stop >= now - {10 * HOUR} GROUP BY capture_id, gid
  HAVING sum(least(stop, now) - greatest(start, now - {10 * HOUR})) > 0""")
_sql("interval_join", """SELECT v.capture_id, probe_id, seq, start, dur FROM viewports v JOIN dense s
  ON v.capture_id = s.capture_id AND s.start < v.t1 AND s.stop > v.t0""")
_sql("interval_join_capped", """SELECT r.capture_id, probe_id, seq, start, dur, n > 20 AS capped, c AS "case"
  FROM r JOIN o USING (capture_id, c)
  WHERE i >= CASE WHEN ok AND n > 20 THEN (n - 20) // 2 ELSE 0 END AND i < 20 + CASE WHEN ok AND n > 20 THEN (n - 20) // 2 ELSE 0 END""",
     """r AS (SELECT *, row_number() OVER (PARTITION BY c, probe_id ORDER BY seq) - 1 AS i,
  count(*) OVER (PARTITION BY c, probe_id) AS n FROM (SELECT c, v.capture_id, v.probe_id, s.seq, s.start, s.dur FROM viewports v
  JOIN (SELECT 'plain' AS c, * FROM e UNION ALL SELECT 'dense', * FROM dense) s
  ON v.capture_id = s.capture_id AND s.start < v.t1 AND s.stop > v.t0))""", SORTED,
     "o AS (SELECT capture_id, CASE c WHEN 'whole' THEN 'plain' ELSE c END AS c, ok FROM orders WHERE c <> 'capped')")
_sql("samples_ranges", """SELECT v.probe_id, s.* FROM viewports v JOIN samples s USING (capture_id)
  WHERE s.start BETWEEN v.t0 AND v.t1
    OR s.seq = (SELECT arg_max(x.seq, (x.start, x.seq)) FROM samples x WHERE x.capture_id = v.capture_id AND x.start < v.t0)
    OR s.seq = (SELECT arg_min(x.seq, (x.start, x.seq)) FROM samples x WHERE x.capture_id = v.capture_id AND x.start > v.t1)""")
_rows("gc_window", "start, dur, generation, collected", "gc", f"WHERE start < {T1} AND start + dur > {T0}")
_rows("gc_tail", "start, dur, generation, collected", "gc", f"WHERE start > {T0} AND start < {T1}")
_TAIL = f"start > {T0} AND start < {T1}"
_sql("tail_follow", """SELECT capture_id, seq, start, dur, gid, n > cap AS capped,
  CASE c WHEN 'dense' THEN 'next' ELSE c END AS "case" FROM win WHERE i < cap""",
     WIN.format(w=_TAIL).replace("101", "50").replace(f"FROM dense WHERE {_TAIL}", f"FROM e WHERE {_TAIL} AND seq > 5000"))
ORACLES["stored_tail"] = ORACLES["tail_follow"] + " AND c <> 'whole'"
_sql("tail_or_window", """SELECT w.capture_id, w.seq, w.start, dur, gid, broken AS whole FROM w
  JOIN state USING (capture_id) WHERE broken OR seq > after_seq""",
     f"w AS (SELECT * FROM e WHERE {IN_WINDOW})",
     f"""front AS (SELECT capture_id, max(seq) AS after_seq, max(start) AS max_start FROM e
  WHERE {_TAIL} AND seq < 5000 AND capture_id <> 'cap-c' GROUP BY ALL)""",
     """state AS (SELECT w.capture_id, any_value(after_seq) AS after_seq, bool_or(after_seq IS NULL) OR
  coalesce(bool_or(w.seq > after_seq AND w.start <= max_start), false) AS broken
  FROM w LEFT JOIN front f ON w.capture_id = f.capture_id GROUP BY w.capture_id)""")
_sql("detail_nearest", """SELECT p.capture_id, p.probe_id, n.seq AS hit_seq, coalesce(func, '') AS func,
  coalesce(task, '') AS task, coalesce(stack, '') AS stack FROM probes p LEFT JOIN near n USING (probe_id)""",
     """near AS (SELECT p.probe_id, s.* FROM probes p JOIN e s ON p.capture_id = s.capture_id AND p.gid = s.gid
  AND abs(s.start - p.t) <= greatest(p.dur, 2000000)
  QUALIFY row_number() OVER (PARTITION BY p.probe_id ORDER BY abs(s.start - p.t), s.seq) = 1)""")
_sql("samples_range", f"""SELECT s.* FROM samples s JOIN edges g USING (capture_id)
  WHERE start BETWEEN {T0} AND {T1} OR s.seq = g.l OR s.seq = g.r""",
     f"""edges AS (SELECT capture_id, arg_max(seq, (start, seq)) FILTER (start < {T0}) AS l,
  arg_min(seq, (start, seq)) FILTER (start > {T1}) AS r FROM samples GROUP BY 1)""")
_sql("hold_asof", """SELECT p.capture_id, probe_id, t, coalesce(lag_ms_s, 0) AS lag_ms_s,
  coalesce(cpu_ms_s, 0) AS cpu_ms_s FROM probes p ASOF LEFT JOIN samples s
  ON p.capture_id = s.capture_id AND p.t >= s.start""")
STAB = """hit AS (SELECT p.probe_id, s.* FROM probes p JOIN {table} s ON {on}
  QUALIFY row_number() OVER (PARTITION BY p.probe_id ORDER BY {order}) = 1)"""
_sql("stab_lookup", """SELECT p.capture_id, p.probe_id, p.gid, p.t, h.seq AS hit_seq, h.start AS hit_start,
  h.dur AS hit_dur FROM probes p LEFT JOIN hit h USING (probe_id)""",
     STAB.format(table="dense", order="s.start DESC, s.seq DESC", on=f"""p.capture_id = s.capture_id
  AND p.gid = s.gid AND s.start <= p.t AND p.t <= s.start + greatest(s.dur, {60 * SECOND})"""))
_sql("gc_stab", """SELECT p.capture_id, p.probe_id, p.t, h.seq AS hit_seq, h.start AS hit_start, h.dur AS hit_dur,
  h.generation AS hit_generation, h.collected AS hit_collected FROM probes p LEFT JOIN hit h USING (probe_id)""",
     STAB.format(table="gc", order="s.seq DESC", on=f"""p.capture_id = s.capture_id
  AND p.t BETWEEN s.start - {200 * SECOND} AND s.start + greatest(s.dur, {200 * SECOND}) + {200 * SECOND}"""))
POOL = """firsts AS (SELECT capture_id, func AS value, min(seq) AS f FROM e WHERE true GROUP BY ALL),
pool AS (SELECT capture_id, row_number() OVER (PARTITION BY capture_id ORDER BY f) AS id, value FROM firsts
  UNION ALL SELECT DISTINCT capture_id, 0, '' FROM e)"""
_sql("intern_dictionary", """SELECT capture_id, id, value, 'func' AS "case" FROM pool
  UNION ALL SELECT capture_id, id, value, 'task' FROM tpool""", POOL, POOL.replace("func", "task")
     .replace("WHERE true", "WHERE task <> ''").replace("firsts", "tfirsts").replace("pool", "tpool"))
_sql("resolve_dictionary", """SELECT e.capture_id, seq, id AS value_id, value FROM e JOIN pool p
  ON e.capture_id = p.capture_id AND e.func = p.value""", POOL)
_sql("render_columns", f"""SELECT capture_id, seq, CAST(CAST(CAST(start - {T0} AS FLOAT) AS DOUBLE) / 1e6 AS FLOAT)
  AS start_ms, CAST(CAST(CAST(dur AS FLOAT) AS DOUBLE) / 1e6 AS FLOAT) AS dur_ms, track_idx
  FROM w JOIN places USING (capture_id, gid)""",
     f"w AS (SELECT * FROM e WHERE {IN_WINDOW})", """places AS (SELECT capture_id, gid,
  row_number() OVER (PARTITION BY capture_id ORDER BY min(seq)) - 1 AS track_idx FROM w GROUP BY capture_id, gid)""")
_sql("validate_render_columns", """SELECT h.capture_id, n, n_tracks, h.rows, bad_rows,
  CASE WHEN n <> h.rows THEN 'header says ' || n || ' rows, found ' || h.rows
  WHEN bad_rows > 0 THEN 'track place ' || n_tracks || ' with ' || n_tracks || ' tracks'
  END AS problem FROM h""",
     f"w AS (SELECT * FROM e WHERE {IN_WINDOW})", """places AS (SELECT capture_id, gid,
  row_number() OVER (PARTITION BY capture_id ORDER BY min(seq)) - 1 AS track_idx FROM w GROUP BY capture_id, gid),
g AS (SELECT capture_id, count(*) AS rows, count(DISTINCT gid) AS t FROM w GROUP BY ALL),
h AS (SELECT capture_id, rows, rows - CASE WHEN capture_id = 'cap-c' THEN 1 ELSE 0 END AS n,
  t - CASE WHEN capture_id = 'cap-b' THEN 1 ELSE 0 END AS n_tracks,
  (SELECT count(*) FROM w JOIN places p USING (capture_id, gid) WHERE w.capture_id = g.capture_id
    AND p.track_idx >= t - CASE WHEN g.capture_id = 'cap-b' THEN 1 ELSE 0 END) AS bad_rows FROM g)""")

# Aggregations
_sql("track_runs", f"""SELECT capture_id, gid, CAST(sum(dur) AS BIGINT) AS run, arg_min(name, seq) AS name,
  arg_min(is_hub, seq) AS is_hub FROM e WHERE {IN_WINDOW} GROUP BY ALL""")
_sql("track_max", "SELECT capture_id, gid, max(dur) AS max_dur, count(*) AS executions FROM e GROUP BY ALL")
_sql("window_bounds", f"""SELECT capture_id, 'window' AS "case", count(*) AS visible, min(start) AS min_start,
  max(start) AS max_start, max(stop) AS max_end, max(seq) AS max_seq FROM dense WHERE {IN_WINDOW} GROUP BY ALL
  UNION ALL SELECT DISTINCT capture_id, 'empty', 0, 0, 0, 0, -1 FROM dense""")
_sql("duration_stats", f"""SELECT capture_id, c AS "case", coalesce(round(quantile_cont(dur, 0.5) FILTER (m), 6), 0)
  AS p50, coalesce(round(quantile_cont(dur, 0.95) FILTER (m), 6), 0) AS p95,
  coalesce(round(quantile_cont(dur, 0.99) FILTER (m), 6), 0) AS p99 FROM (
  SELECT *, 'whole' AS c, NOT is_hub AS m FROM e UNION ALL
  SELECT *, 'day', NOT is_hub AND start < {T0 + DAY} AND stop > {T0} FROM e UNION ALL
  SELECT *, 'empty', false FROM e) GROUP BY ALL""")
_sql("slow_band_counts", """SELECT capture_id, long_total, blocked_total, tier, CASE tier WHEN 'long' THEN long_total
  WHEN 'blocked' THEN blocked_total ELSE long_total + blocked_total END AS total FROM (
  SELECT capture_id, count(*) FILTER (NOT is_hub AND dur >= 20000000 AND dur < 50000000) AS long_total,
  count(*) FILTER (NOT is_hub AND dur >= 50000000) AS blocked_total FROM e GROUP BY ALL),
  (VALUES ('all'), ('long'), ('blocked')) AS x(tier)""")
SUMMARY = """count(DISTINCT gid) AS {0}, CAST(coalesce(sum(dur) FILTER (is_hub), 0) AS BIGINT) AS {1},
  CAST(coalesce(sum(dur) FILTER (NOT is_hub), 0) AS BIGINT) AS {2},
  count(*) FILTER (NOT is_hub AND dur >= 20000000) AS {3},
  count(*) FILTER (NOT is_hub AND dur >= 50000000) AS {4}"""
_sql("summary_scalars", "SELECT capture_id, "
     + SUMMARY.format("tracks", "hub_run", "app_run", "long_count", "blocked_count")
     + " FROM e GROUP BY ALL")
TOPS = """tt AS (SELECT capture_id, gid, arg_min(name, seq) AS name, arg_min(is_hub, seq) AS is_hub,
  CAST(sum(dur) AS BIGINT) AS run, count(*) AS executions,
  row_number() OVER (PARTITION BY capture_id ORDER BY sum(dur) DESC, min(seq)) AS rank FROM e GROUP BY capture_id, gid),
tf AS (SELECT capture_id, func, CAST(sum(dur) AS BIGINT) AS total, count(*) AS executions, max(dur) AS longest,
  row_number() OVER (PARTITION BY capture_id ORDER BY sum(dur) DESC, func) AS rank FROM e WHERE NOT is_hub
  GROUP BY capture_id, func),
ts AS (SELECT *, CASE WHEN dur >= 50000000 THEN 2 ELSE 1 END AS level,
  row_number() OVER (PARTITION BY capture_id ORDER BY dur DESC, seq) AS rank FROM e
  WHERE NOT is_hub AND dur >= 20000000),
tg AS (SELECT capture_id, generation, count(*) AS pauses, CAST(sum(dur) AS BIGINT) AS total FROM gc GROUP BY ALL),
tp AS (SELECT capture_id, CAST(trunc(quantile_cont(dur, 0.5)) AS BIGINT) AS p50,
  CAST(trunc(quantile_cont(dur, 0.95)) AS BIGINT) AS p95, CAST(trunc(quantile_cont(dur, 0.99)) AS BIGINT) AS p99
  FROM e WHERE NOT is_hub GROUP BY ALL)"""
_sql("top_tracks", "SELECT capture_id, rank, gid, name, is_hub, run, executions FROM tt WHERE rank <= 10", TOPS)
_sql("hot_functions", "SELECT capture_id, rank, func, total, executions, longest FROM tf WHERE rank <= 10", TOPS)
_sql("gc_totals", """SELECT capture_id, 'all' AS "case", count(*) AS pauses, CAST(sum(dur) AS BIGINT) AS total FROM gc
  GROUP BY ALL UNION ALL SELECT e.capture_id, 'some', count(g.seq), CAST(coalesce(sum(g.dur), 0) AS BIGINT)
  FROM (SELECT DISTINCT capture_id FROM e) e
  LEFT JOIN gc g ON e.capture_id = g.capture_id AND g.capture_id = 'cap-a' GROUP BY ALL""")
_sql("gc_by_generation", "SELECT * FROM tg", TOPS)
COUNTS = """c AS (SELECT capture_id, count(*) AS total, CAST(sum(strlen(name) + strlen(func) + strlen(task)
  + strlen(stack) + 24) AS BIGINT) AS bytes, max(stop) AS span, arg_min(start, seq) AS origin FROM e GROUP BY ALL)"""
_sql("capture_counters", "SELECT * FROM c", COUNTS)
_sql("event_rate", "SELECT capture_id, total, span, round(total / (span / 1e9), 9) AS per_second FROM c", COUNTS)
NOW = "now AS (SELECT capture_id, arg_max(stop, seq) AS now FROM dense GROUP BY ALL)"
_sql("cpu_busy", f"""SELECT capture_id, round(least(1, greatest(0, coalesce(sum(least(stop, now)
  - greatest(start, now - {6 * HOUR})) FILTER (NOT is_hub AND stop >= now - {6 * HOUR}), 0) / {6 * HOUR}.0::DOUBLE)), 6)
  AS busy FROM dense JOIN now USING (capture_id) GROUP BY ALL""", NOW)
_sql("recent_activity", f"""SELECT capture_id, gid, c AS "case", CAST(coalesce(sum(CASE WHEN w IS NULL THEN dur
  ELSE least(stop, now) - greatest(start, now - w) END) FILTER (w IS NULL OR stop >= now - w), 0) AS BIGINT)
  AS activity FROM dense JOIN now USING (capture_id),
  (VALUES ('whole', NULL), ('1h', {HOUR}), ('10h', {10 * HOUR}), ('60h', {60 * HOUR})) AS x(c, w)
  GROUP BY ALL""", NOW)
_sql("analyze_report", """SELECT e.capture_id, any_value(m.pid) AS pid, any_value(m.epoch) AS "epochMs",
  count(*) AS "totalExecutions", max(stop) - arg_min(start, seq) AS "spanNs", """
     + SUMMARY.format("greenlets", '"hubRunNs"', '"nonHubRunNs"', '"longCount"', '"blockedCount"') + """,
  any_value(p50) AS "p50Ns", any_value(p95) AS "p95Ns", any_value(p99) AS "p99Ns",
  (SELECT sum(pauses)::BIGINT FROM tg WHERE tg.capture_id = e.capture_id) AS "gcCount",
  (SELECT sum(total)::BIGINT FROM tg WHERE tg.capture_id = e.capture_id) AS "gcTotalNs",
  20 AS "longMs", 50 AS "blockedMs",
  (SELECT string_agg(generation || ':' || pauses || ':' || total, ',' ORDER BY generation) FROM tg
    WHERE tg.capture_id = e.capture_id) AS gens,
  (SELECT string_agg(start || ':' || dur || ':' || level || ':' || gid || ':' || name || ':' || func, ',' ORDER BY rank) FROM ts
    WHERE ts.capture_id = e.capture_id AND rank <= 10) AS slowest,
  (SELECT string_agg(gid || ':' || name || ':' || run || ':' || executions, ',' ORDER BY rank) FROM tt
    WHERE tt.capture_id = e.capture_id AND rank <= 10) AS tracks,
  (SELECT string_agg(func || '=' || total || '=' || executions || '=' || longest, ',' ORDER BY rank) FROM tf
    WHERE tf.capture_id = e.capture_id AND rank <= 10) AS funcs
  FROM e JOIN tp ON tp.capture_id = e.capture_id JOIN m ON m.capture_id = e.capture_id GROUP BY e.capture_id""",
     TOPS, META, """m AS (SELECT capture_id, arg_max(pid, seq) AS pid,
  arg_max(epoch_ms, seq) FILTER (epoch_ms > 0) AS epoch FROM meta GROUP BY ALL)""")
_sql("report_json", """SELECT e.capture_id, count(*) AS total, max(stop) - arg_min(start, seq) AS span_ns,
  any_value(m.epoch) AS epoch_ms, any_value(p95) AS p95_ns,
  count(*) FILTER (NOT is_hub AND dur >= 20000000) AS long_count,
  (SELECT sum(total)::BIGINT FROM tg WHERE tg.capture_id = e.capture_id) AS gc_total_ns,
  (SELECT arg_min(total, generation) FROM tg WHERE tg.capture_id = e.capture_id) AS gen0_ns,
  (SELECT dur FROM ts WHERE ts.capture_id = e.capture_id AND rank = 3) AS third_dur,
  (SELECT name FROM tt WHERE tt.capture_id = e.capture_id AND rank = 1) AS top_track,
  (SELECT func FROM tf WHERE tf.capture_id = e.capture_id AND rank = 1) AS top_func
  FROM e JOIN tp ON tp.capture_id = e.capture_id JOIN m ON m.capture_id = e.capture_id GROUP BY e.capture_id""",
     TOPS, META, """m AS (SELECT capture_id, arg_max(epoch_ms, seq) FILTER (epoch_ms > 0) AS epoch
  FROM meta GROUP BY ALL)""")

_E_END = "AS stack, is_hub FROM timed),"
_sql("report_of_all_captures", """SELECT m.capture_id, CAST(to_json({
  'totalExecutions': coalesce(x.total, 0), 'spanNs': coalesce(x.span, 0), 'greenlets': coalesce(x.greenlets, 0),
  'hubRunNs': coalesce(x.hub, 0), 'nonHubRunNs': coalesce(x.app, 0), 'longCount': coalesce(x.long, 0),
  'blockedCount': coalesce(x.blocked, 0), 'p50Ns': coalesce(p50, 0), 'p95Ns': coalesce(p95, 0), 'p99Ns': coalesce(p99, 0),
  'gcCount': coalesce((SELECT CAST(sum(pauses) AS BIGINT) FROM tg WHERE tg.capture_id = m.capture_id), 0),
  'gcTotalNs': coalesce((SELECT CAST(sum(total) AS BIGINT) FROM tg WHERE tg.capture_id = m.capture_id), 0),
  'gcByGen': coalesce((SELECT list({'gen': generation, 'count': pauses, 'totalNs': total} ORDER BY generation) FROM tg
    WHERE tg.capture_id = m.capture_id), []),
  'slowest': coalesce((SELECT list({'start': start, 'dur': dur, 'gid': gid, 'name': name, 'func': func, 'level': level}
    ORDER BY rank) FROM ts WHERE ts.capture_id = m.capture_id AND rank <= 10), []),
  'topGreenlets': coalesce((SELECT list({'gid': gid, 'name': name, 'isHub': is_hub, 'runNs': run,
    'executions': executions} ORDER BY rank) FROM tt WHERE tt.capture_id = m.capture_id AND rank <= 10), []),
  'topFuncs': coalesce((SELECT list({'func': func, 'totalNs': total, 'count': executions, 'maxNs': longest} ORDER BY rank)
    FROM tf WHERE tf.capture_id = m.capture_id AND rank <= 10), []),
  'pid': m.pid, 'epochMs': m.epoch, 'longMs': 20, 'blockedMs': 50}) AS VARCHAR) AS json
  FROM m LEFT JOIN x USING (capture_id) LEFT JOIN tp USING (capture_id)""",
     TOPS, META, """m AS (SELECT capture_id, arg_max(pid, seq) AS pid,
  arg_max(epoch_ms, seq) FILTER (epoch_ms > 0) AS epoch FROM meta GROUP BY ALL)""",
     "x AS (SELECT capture_id, count(*) AS total, max(stop) - arg_min(start, seq) AS span, "
     + SUMMARY.format("greenlets", "hub", "app", "long", "blocked") + " FROM e GROUP BY ALL)")
ORACLES["report_of_all_captures"] = ORACLES["report_of_all_captures"].replace(
    _E_END, _E_END.replace("timed)", "timed WHERE capture_id <> 'cap-c')"))

# Sequences and series
FOLD = """SELECT capture_id, seq, thread, target AS gid, ts AS start, greatest(nts - ts, 0) AS dur, label AS name,
  func, task, nstack AS stack, lower(label[1:3]) = 'hub' AS is_hub FROM (
  SELECT *, lead(ts) OVER w AS nts, lead(stack) OVER w AS nstack FROM switches
  WINDOW w AS (PARTITION BY capture_id, thread ORDER BY seq)) WHERE nts IS NOT NULL"""
_sql("fold_switches", FOLD)
_sql("pair_gc", """SELECT capture_id, seq, greatest(open, 0) AS start, t - open AS dur,
  coalesce(generation, -1) AS generation, coalesce(collected, 0) AS collected FROM (
  SELECT capture_id, seq, event_type, start AS t, CASE WHEN k % 4 > 0 THEN gid % 3 END AS generation,
  CASE WHEN k % 5 > 0 THEN k END AS collected,
  last_value(CASE WHEN event_type = 'click' THEN start END IGNORE NULLS)
    OVER (PARTITION BY capture_id ORDER BY seq) AS open
  FROM b WHERE event_type IN ('click', 'error')) WHERE event_type = 'error' AND open IS NOT NULL""")
_sql("sortedness", """SELECT capture_id, CASE c WHEN 'whole' THEN 'plain' ELSE c END AS "case",
  bool_and(coalesce(start >= high, true)) AS sorted, count(*) FILTER (start < high) AS out_of_order,
  min(seq) FILTER (start < high) AS first_break FROM seen WHERE c <> 'capped' GROUP BY ALL""", SORTED)
_sql("counter_rates", """SELECT capture_id, seq,
  round(coalesce(greatest(runq_ns - lag(runq_ns) OVER w, 0) / 1e6
    / greatest((start - lag(start) OVER w) / 1e9, 1e-3), 0), 6) AS lag_ms_s,
  round(coalesce(greatest(on_cpu_ns - lag(on_cpu_ns) OVER w, 0) / 1e6
    / greatest((start - lag(start) OVER w) / 1e9, 1e-3), 0), 6) AS cpu_ms_s
  FROM counters WINDOW w AS (PARTITION BY capture_id, gid ORDER BY seq)""")
_sql("delta_encode", """SELECT capture_id, thread, seq, NOT (step BETWEEN 0 AND 16777215) AS is_reset,
  CASE WHEN NOT (step BETWEEN 0 AND 16777215) THEN ts END AS base,
  CASE WHEN step BETWEEN 0 AND 16777215 THEN step ELSE 0 END AS delta FROM (
  SELECT *, ts - coalesce(lag(ts) OVER (PARTITION BY capture_id, thread ORDER BY seq), 0) AS step FROM fast)""")
_sql("delta_decode", "SELECT capture_id, thread, seq, ts FROM fast")
BINS = """bins{n} AS (SELECT capture_id, bin, CAST(sum(least(stop, (bin + 1) * {w}) - greatest(start, bin * {w}))
  AS BIGINT) AS busy_ns FROM (SELECT *, unnest(range(start // {w}, stop // {w} + 1)) AS bin FROM dense
  WHERE NOT is_hub) GROUP BY ALL HAVING busy_ns > 0)"""
_sql("busy_bins", "SELECT * FROM bins", BINS.format(n="", w=HOUR))
QUARTER = HOUR // 4
UTIL = BINS.format(n="4", w=QUARTER) + f""",
grid AS (SELECT capture_id, x FROM (SELECT DISTINCT capture_id FROM bins4), range({COLUMNS}) AS r(x)),
util AS (SELECT g.capture_id, x, least(1, coalesce(sum(busy_ns * ((least((bin + 1) * {QUARTER}, {DAY} + (x + 1) * {PX})
  - greatest(bin * {QUARTER}, {DAY} + x * {PX})) / {QUARTER}.0::DOUBLE)), 0) / {PX}.0::DOUBLE) AS busy
  FROM grid g LEFT JOIN bins4 b ON g.capture_id = b.capture_id
  AND bin * {QUARTER} < {DAY} + (x + 1) * {PX} AND (bin + 1) * {QUARTER} > {DAY} + x * {PX} GROUP BY ALL)"""
_sql("utilization_series", f"""SELECT capture_id, x, round(busy, 6) AS busy FROM util
  UNION ALL SELECT 'cap-hub', x, 0 FROM range({COLUMNS}) AS r(x)""", UTIL)
_sql("smooth_series", """SELECT capture_id, x, round(avg(busy) OVER (PARTITION BY capture_id ORDER BY x
  ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING), 6) AS busy FROM util""", UTIL)
HELD = f"""held AS (SELECT g.capture_id, g.x, coalesce(lag_ms_s, 0) AS lag_ms_s, coalesce(cpu_ms_s, 0) AS cpu_ms_s
  FROM (SELECT capture_id, x, {DAY} + x * {PX} AS t FROM (SELECT DISTINCT capture_id FROM samples), range({COLUMNS}) AS r(x)) g
  ASOF LEFT JOIN samples s ON g.capture_id = s.capture_id AND g.t >= s.start)"""
_sql("utilization_with_tail", f"""SELECT u.capture_id, u.x, round(CASE WHEN {DAY} + u.x * {PX} > edge
  THEN least(cpu_ms_s / 1000, 1) ELSE busy END, 6) AS busy FROM util u JOIN held h USING (capture_id, x)
  JOIN (SELECT capture_id, max(stop) AS edge FROM dense GROUP BY ALL) USING (capture_id)""", UTIL, HELD)
_sql("utilization_without_rows", f"""SELECT h.capture_id, h.x, round(CASE WHEN {DAY} + h.x * {PX} > coalesce(edge, 0)
  THEN least(cpu_ms_s / 1000, 1) ELSE busy END, 6) AS busy FROM held h LEFT JOIN util u USING (capture_id, x)
  LEFT JOIN (SELECT capture_id, max(stop) AS edge FROM dense WHERE capture_id <> 'cap-c' GROUP BY ALL) USING (capture_id)""",
     UTIL, HELD)
_sql("lag_series", """SELECT capture_id, x, v AS lag_ms_s, max(v) OVER (PARTITION BY capture_id) AS peak,
  greatest(max(v) OVER (PARTITION BY capture_id), 50) AS full_scale
  FROM (SELECT capture_id, x, CASE WHEN capture_id = 'cap-c' THEN 0 ELSE lag_ms_s END AS v FROM held)""", HELD)
_sql("stall_intervals", """SELECT capture_id, i AS interval, new_rows, CAST(round(new_rows / 900.0) AS BIGINT)
  AS rows_per_s, CAST(round(size / 900.0 / 1024) AS BIGINT) AS kib_per_s, total, new_rows = 0 AS stalled,
  CASE WHEN new_rows = 0 AND was > 0 THEN 'stalled' WHEN new_rows > 0 AND was = 0 THEN 'resumed' END AS transition
  FROM flow""",
     f"""per AS (SELECT capture_id, stop // {QUARTER} AS i, count(*) AS n, sum(strlen(func)) AS size FROM e GROUP BY ALL),
every AS (SELECT capture_id, unnest(range(min(i), max(i) + 1)) AS i FROM per GROUP BY capture_id),
flow AS (SELECT capture_id, i, coalesce(n, 0) AS new_rows, coalesce(size, 0) AS size,
  CAST(sum(coalesce(n, 0)) OVER w AS BIGINT) AS total, lag(coalesce(n, 0)) OVER w AS was
  FROM every LEFT JOIN per USING (capture_id, i) WINDOW w AS (PARTITION BY capture_id ORDER BY i))""")
_sql("arrival_lag", f"""SELECT capture_id, round(ms, 6) AS lag_ms, CASE WHEN ms >= 5000 THEN 'danger'
  WHEN ms >= 1000 THEN 'warn' ELSE 'ok' END AS tier FROM (SELECT capture_id, CASE WHEN capture_id = 'cap-c' THEN 0
  ELSE greatest(0, {NOW_MS - EPOCH_MS} - span / 1e6) END AS ms FROM c)""", COUNTS)
_sql("health_status", f"""SELECT capture_id, CASE WHEN quiet THEN 'stalled' ELSE 'ok' END AS status, 0 AS pid,
  true AS live, quiet AS "tracerStalled", total AS executions, bytes, span AS "spanNs", false AS recording
  FROM (SELECT *, span < {30 * DAY - HOUR // 12} AS quiet FROM c)""", COUNTS)

# Ranking
_sql("slowlog", """SELECT capture_id, seq, start, dur, gid, name, func, rank,
  CASE WHEN dur >= 50000000 THEN 2 ELSE 1 END AS level, c AS "case" FROM (
  SELECT *, row_number() OVER (PARTITION BY capture_id, c
    ORDER BY CASE WHEN c LIKE '%dur' THEN dur ELSE start END DESC, seq) AS rank FROM e,
  (VALUES ('all-dur', 500), ('all-start', 500), ('long-start', 100), ('blocked-dur', 100)) AS x(c, lim)
  WHERE NOT is_hub AND dur >= CASE WHEN c LIKE 'blocked%' THEN 50000000 ELSE 20000000 END
    AND (c NOT LIKE 'long%' OR dur < 50000000)) WHERE rank <= lim""")
ORDER = """tracks AS (SELECT capture_id, gid, arg_min(name, seq) AS name, arg_min(is_hub, seq) AS is_hub, sum(dur) AS act,
  max(dur) AS max_dur, min(seq) AS f FROM e GROUP BY ALL),
placed AS (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY NOT is_hub,
  CASE WHEN is_hub THEN 0 ELSE act END DESC, CAST(split_part(name, '-', 2) AS BIGINT), name, gid) - 1 AS by_act,
  row_number() OVER (PARTITION BY capture_id ORDER BY NOT is_hub, CAST(split_part(name, '-', 2) AS BIGINT), name, gid)
  - 1 AS by_ident FROM tracks)"""
_sql("track_order", """SELECT capture_id, by_act AS row, gid, name, is_hub, 'activity' AS mode FROM placed
  UNION ALL SELECT capture_id, by_ident, gid, name, is_hub, 'ident' FROM placed""", ORDER)
_sql("recent_track_order", """SELECT capture_id, row_number() OVER (PARTITION BY capture_id, mode ORDER BY NOT is_hub,
  CASE WHEN is_hub THEN 0 ELSE activity END DESC, CAST(split_part(name, '-', 2) AS BIGINT), name, gid) - 1 AS row,
  gid, name, is_hub, activity, mode FROM (SELECT capture_id, gid, mode, arg_min(name, seq) AS name,
  arg_min(is_hub, seq) AS is_hub, CAST(coalesce(sum(least(stop, now) - greatest(start, now - w))
    FILTER (stop >= now - w), 0) AS BIGINT) AS activity
  FROM quick JOIN late USING (capture_id), (VALUES ('recent1', 1000000000), ('recent10', 10000000000),
  ('recent60', 60000000000)) AS x(mode, w) GROUP BY capture_id, gid, mode)""",
     """quick AS (SELECT * REPLACE (start // 86400 AS start, dur // 86400 AS dur,
  start // 86400 + dur // 86400 AS stop) FROM dense)""",
     "late AS (SELECT capture_id, arg_max(stop, seq) AS now FROM quick GROUP BY ALL)")
_sql("stable_track_order", """SELECT capture_id, gid, row FROM old UNION ALL SELECT n.capture_id, n.gid,
  coalesce((SELECT max(row) + 1 FROM old WHERE old.capture_id = n.capture_id), 0)
  + row_number() OVER (PARTITION BY n.capture_id ORDER BY f) - 1 AS row
  FROM (SELECT capture_id, gid, min(seq) AS f FROM e GROUP BY ALL) n
  WHERE NOT EXISTS (FROM old WHERE old.capture_id = n.capture_id AND old.gid = n.gid)""",
     f"""early AS (SELECT capture_id, gid, arg_min(name, seq) AS name, arg_min(is_hub, seq) AS is_hub, sum(dur) AS act
  FROM e WHERE start < {T0 // 5} GROUP BY ALL),
old AS (SELECT capture_id, gid, row_number() OVER (PARTITION BY capture_id ORDER BY NOT is_hub,
  CASE WHEN is_hub THEN 0 ELSE act END DESC, CAST(split_part(name, '-', 2) AS BIGINT), name, gid) - 1 AS row FROM early)""")
_sql("fold_overflow", """SELECT capture_id, CASE WHEN r <= 25 THEN gid END AS gid,
  CASE WHEN r <= 25 THEN name ELSE '…(other greenlets)' END AS name, r <= 25 AND is_hub AS is_hub,
  CAST(sum(act) AS BIGINT) AS run, max(max_dur) AS max_dur, CAST(sum(n) AS BIGINT) AS executions, count(*) AS tracks
  FROM (SELECT t.*, n, row_number() OVER (PARTITION BY capture_id ORDER BY f) AS r FROM tracks t
  JOIN (SELECT capture_id, gid, count(*) AS n FROM e GROUP BY ALL) USING (capture_id, gid)) GROUP BY 1, 2, 3, 4""", ORDER)
_sql("page_tracks", "SELECT capture_id, by_act AS row, gid, name, is_hub, CAST(act AS BIGINT) AS run, max_dur, "
     + BAND.format(d="max_dur") + " AS band FROM placed WHERE by_act BETWEEN 2 AND 29", ORDER)
_sql("retention_cap", """SELECT capture_id, seq, start, dur, gid, n > 2000 AS evicted FROM ranked WHERE r <= 2000""",
     KEPT)
_rows("cap_frames", "array_to_string(string_split(stack, ' <- ')[1:2], ' <- ') AS stack")
_rows("append_batches", "gid, start, dur, name")

# Scalars
_rows("split_stack", """CASE WHEN stack = '' THEN 0 ELSE len(string_split(stack, ' <- ')) END AS frames,
  coalesce(string_split(stack, ' <- ')[1], '') AS leaf, coalesce(string_split(stack, ' <- ')[3], '') AS root""")
_rows("join_stack", """stack AS same, array_to_string(list_reverse(string_split(stack, ' <- ')), ' <- ')
  AS root_first""")
_sql("parse_frame", """SELECT capture_id, seq, frame, p[1] AS path,
  CASE WHEN string_split(p[1], '/')[-1] = '' THEN p[1] ELSE string_split(p[1], '/')[-1] END AS file,
  CASE WHEN len(p) >= 3 THEN array_to_string(p[2:len(p) - 1], ':') ELSE coalesce(p[2], '') END AS qual,
  CASE WHEN len(p) >= 3 THEN p[-1] ELSE '' END AS line,
  contains(p[1], '/gevent/') OR contains(p[1], '/greenlet') AS lib
  FROM (SELECT *, string_split(frame, ':') AS p FROM f)""",
     """f AS (SELECT capture_id, seq, unnest([func, string_split(stack, ' <- ')[1], '/usr/lib/gevent/hub.py:a:b:7',
  '/srv/greenlets/' || task || ':run', name]) AS frame FROM e)""")
_sql("parse_frames", """SELECT capture_id, seq, CAST(i - 1 AS INT) AS at, p[1] AS path, string_split(p[1], '/')[-1] AS file,
  array_to_string(p[2:len(p) - 1], ':') AS qual, p[-1] AS line,
  contains(p[1], '/gevent/') OR contains(p[1], '/greenlet') AS lib
  FROM (SELECT capture_id, seq, i, string_split(f[i], ':') AS p FROM (
  SELECT capture_id, seq, f, unnest(range(1, len(f) + 1)) AS i FROM (
  SELECT capture_id, seq, string_split(stack, ' <- ') AS f FROM e WHERE stack <> '')))""")
_rows("leaf_function", "CASE WHEN stack = '' THEN '' ELSE func END AS leaf")
_rows("clean_stack", "stack")
_rows("short_stack", """CASE WHEN stack = '' THEN func ELSE string_split(stack, ' <- ')[1] END AS shown,
  CASE WHEN stack = '' THEN 0 ELSE 1 END AS hidden""")
_sql("explode_stacks", """SELECT capture_id, seq, CAST(i - 1 AS INT) AS pos, fr[i] AS frame, i = 1 AS leaf FROM (
  SELECT *, unnest(range(1, len(fr) + 1)) AS i FROM (SELECT *, CASE WHEN stack = '' THEN [func]
  ELSE string_split(stack, ' <- ') END AS fr FROM e))""")
NS = """CASE WHEN {n} >= 1000000000 THEN printf('%.2fs', {n} / 1e9) WHEN {n} >= 1000000 THEN printf('%.1fms', {n} / 1e6)
  WHEN {n} >= 1000 THEN printf('%.1fµs', {n} / 1e3) ELSE {n} || 'ns' END"""
_rows("fmt_ns", f"""{NS.format(n="dur")} AS dur, {NS.format(n="(dur // 1000)")} AS small,
  {NS.format(n="start")} AS start""")


def _up(x, places):
    """``x`` as text with ``places`` decimals, an exact tie going up.  Ties are exact only on binary fractions."""
    scaled = f"abs({x}) * {10 ** places}"
    tie = f"(abs({x}) * 1024 = floor(abs({x}) * 1024) AND ({scaled}) - floor({scaled}) = 0.5)"
    return (f"(CASE WHEN ({x}) < 0 THEN '-' ELSE '' END || printf('%.{places}f', CASE WHEN {tie} "
            f"THEN abs({x}) * (1 + 1e-12) ELSE abs({x}) END))")


def _time(ms):
    return (f"CASE WHEN abs({ms}) < 1e-3 THEN {_up(f'{ms} * 1e6', 0)} || ' ns' "
            f"WHEN abs({ms}) < 0.1 THEN {_up(f'{ms} * 1e3', 1)} || ' µs' "
            f"WHEN abs({ms}) < 1 THEN {_up(f'{ms} * 1e3', 0)} || ' µs' "
            f"WHEN abs({ms}) < 10 THEN {_up(ms, 2)} || ' ms' WHEN abs({ms}) < 1000 THEN {_up(ms, 1)} || ' ms' "
            f"ELSE {_up(f'{ms} / 1e3', 2)} || ' s' END")


_rows("format_time", f"""{_time('(dur / 1e6)')} AS dur, {_time('(start / 1e6)')} AS start,
  {_time('(-dur / 1e9)')} AS negative, {_time('(dur / 1e12)')} AS tiny""")
PRECISE = """CASE WHEN {n} < 1000 THEN {n} || ' ns' WHEN {n} < 1000000
  THEN regexp_replace(printf('%.3f', {n} / 1e3), '\\.?0+$', '') || ' µs' WHEN {n} < 1000000000
  THEN regexp_replace(printf('%.6f', {n} / 1e6), '\\.?0+$', '') || ' ms'
  ELSE regexp_replace(printf('%.9f', {n} / 1e9), '\\.?0+$', '') || ' s' END"""
_rows("format_time_precise", f"""{PRECISE.format(n="dur")} AS dur,
  {PRECISE.format(n="CAST(floor(dur / 1e9 * 1e6 + 0.5) AS BIGINT)")} AS small""")


def _human(n, units, text):
    out = f"CASE WHEN {n} < 1024 THEN {n} || ' B' "
    for i, unit in enumerate(units):
        v = f"({n} / {1024 ** (i + 1)}.0::DOUBLE)"
        out += f"WHEN {n} < {1024 ** (i + 2)} THEN {text(v, unit)} " if i + 1 < len(units) else ""
    v = f"({n} / {1024 ** len(units)}.0::DOUBLE)"
    return out + f"ELSE {text(v, units[-1])} END"


_plain = lambda v, u: f"printf('%.1f', {v}) || ' {u}'"
_short = lambda v, u: f"CASE WHEN {v} < 10 THEN {_up(v, 1)} ELSE {_up(v, 0)} END || ' {u}'"
_GB, _TB = ["KB", "MB", "GB"], ["KB", "MB", "GB", "TB"]
for _name, _units, _text in (("human_bytes", _GB, _plain), ("format_bytes", _TB, _short)):
    _rows(_name, ", ".join(f"{_human(c, _units, _text)} AS {a}"
                           for c, a in (("dur", "size"), ("start", "large"), ("gid", "small"))))


def _rate(r):
    return (f"CASE WHEN {r} >= 1000 THEN {_up(f'({r} / 1000.0)', 1)} || 'k/s' WHEN {r} < 10 "
            f"THEN {_up(r, 1)} || '/s' ELSE {_up(r, 0)} || '/s' END")


_rows("format_rate", f"{_rate('value')} AS rate, {_rate('(value * 1000.0::DOUBLE)')} AS high", "b")
_rows("pct", """CASE WHEN gid = 0 THEN '0.0%' ELSE printf('%.1f', dur::DOUBLE / (gid * 1000000)::DOUBLE * 100) || '%'
  END AS share""")
CLOCK = "strftime(make_timestamp(({e} + start // 1000000) * 1000), '%H:%M:%S.%g')"
_rows("axis_clock", f"""CASE WHEN gid % 4 = 0 THEN {_time('(start / 1e6)')} ELSE {CLOCK.format(e=EPOCH_MS)} END AS utc,
  CASE WHEN gid % 4 = 0 THEN {_time('(start / 1e6)')} ELSE {CLOCK.format(e=EPOCH_MS + 9 * 3_600_000)} END AS tokyo""")
STEP = """(CASE WHEN {r} / pow(10, floor(log10({r}))) <= 1 THEN 1 WHEN {r} / pow(10, floor(log10({r}))) <= 2 THEN 2
  WHEN {r} / pow(10, floor(log10({r}))) <= 5 THEN 5 ELSE 10 END * pow(10, floor(log10({r}))))"""
_rows("nice_step", f"round({STEP.format(r='(value + 0.0137::DOUBLE)')}, 9) AS step", "b")
_sql("axis_ticks", """SELECT capture_id, mode, kind, step, round(i * step + phase, 3) AS t_ms FROM (
  SELECT *, unnest(range(CAST(ceil((t0 - phase) / step) AS BIGINT), CAST(floor((t1 - phase) / step) AS BIGINT) + 1)) AS i
  FROM lines)""", COUNTS, f"""raw AS (SELECT capture_id, origin / 1e6 AS t0, 1000.0::DOUBLE / (span / 1e6) AS px FROM c),
views AS (SELECT *, t0 + 1000.0::DOUBLE / px AS t1, 85.0::DOUBLE / px AS want FROM raw),
stepped AS (SELECT *, {STEP.format(r="want")} AS major FROM views),
lines AS (SELECT capture_id, mode, kind, t0, t1, step,
  CASE WHEN mode = 'clock' THEN -({EPOCH_MS + 12_345}.0::DOUBLE % step) ELSE 0 END AS phase
  FROM (SELECT *, CASE WHEN kind = 'major' THEN major ELSE major / 5.0::DOUBLE END AS step FROM stepped,
  (VALUES ('major'), ('minor')) AS x(kind), (VALUES ('relative'), ('clock')) AS y(mode)))""")
_rows("cpu_tier", "CASE WHEN least(1000, k * 10) / 1000 > 0.9 THEN 'warn' ELSE 'ok' END AS tier", "b")
_rows("lag_tier", "CASE WHEN value >= 50 THEN 'bad' WHEN value >= 20 THEN 'warn' ELSE 'ok' END AS tier", "b")
_rows("parse_proc_status", """event_type AS name, 'S (sleeping)' AS state, k AS threads,
  CASE WHEN k % 4 = 0 THEN 0 ELSE k END AS rss_kb, k * 1024 AS vm_peak_kb, gid AS voluntary_ctxt,
  CASE WHEN k % 2 = 0 THEN 0 END AS involuntary_ctxt""", "b")
_rows("parse_schedstat", """CASE WHEN k % 3 > 0 THEN start END AS on_cpu_ns, CASE WHEN k % 3 > 0 THEN k END AS runq_ns""",
      "b")
_rows("parse_cpu_stat", """k AS nr_periods, CASE WHEN k % 5 = 0 THEN 0 ELSE gid END AS nr_throttled,
  CASE WHEN k % 2 = 0 THEN 123 ELSE 0 END AS throttled_usec""", "b")
_rows("parse_psi", "CASE WHEN k % 6 > 0 THEN k / 4.0::DOUBLE END AS avg10", "b")
_rows("parse_cpu_max", """CASE WHEN k % 4 = 0 THEN NULL WHEN k % 4 = 1 THEN k * 1000.0::DOUBLE / 50000
  ELSE k * 1000.0::DOUBLE / 100000 END AS cores""", "b")

# Streaming
_ALL = "gid, start, dur, name, func, task, stack, is_hub"
_rows("stream_switches", "thread, ts, target, label, func, task, stack", "switches")
_rows("parquet_append_sink", _ALL)
_rows("micro_batch_flush", _ALL)
_rows("stream_tail", _ALL, "e", f"WHERE start > {T0}")
_sql("stream_retention", """SELECT capture_id, coalesce(min(start) FILTER (n > 1500 AND r <= 1500), 0) AS retained_from,
  count(*) FILTER (r <= 1500) AS held FROM ranked GROUP BY capture_id""", KEPT)
_sql("fold_switches_stream", FOLD)
_sql("live_aggregates", """SELECT capture_id, total, bytes, span, (SELECT count(*) FROM e WHERE NOT is_hub
  AND dur >= 20000000 AND e.capture_id = c.capture_id) AS long_count, (SELECT count(*) FROM e WHERE NOT is_hub
  AND dur >= 50000000 AND e.capture_id = c.capture_id) AS blocked_count FROM c""", COUNTS)
_sql("live_head", """SELECT capture_id, total, bytes, span, long_count, blocked_count, capture_id <> 'cap-b' AS stalled,
  retained_from FROM c JOIN (SELECT capture_id, coalesce(min(start) FILTER (n > 1500 AND r <= 1500), 0) AS retained_from,
  count(*) FILTER (NOT is_hub AND dur >= 20000000) AS long_count,
  count(*) FILTER (NOT is_hub AND dur >= 50000000) AS blocked_count FROM ranked GROUP BY ALL) USING (capture_id)""",
     COUNTS, KEPT)
_sql("stall_monitor", """SELECT capture_id, count(*) AS total, count(*) AS new_rows, true AS stalled, 1 AS stalls
  FROM e GROUP BY ALL""")
_rows("late_rows", "start, dur, coalesce(start < high, false) AS late", "seen", "WHERE c = 'dense'", SORTED)


def _ns(n):
    return "(" + NS.format(n=n) + ")"


def _pct(n, total):
    return f"(CASE WHEN {total} = 0 THEN '0.0%' ELSE printf('%.1f', {n}::DOUBLE / {total}::DOUBLE * 100) || '%' END)"


def _items(table, line, order="rank", where="rank <= 10"):
    return (f"coalesce((SELECT list({line} ORDER BY {order}) FROM {table} WHERE {table}.capture_id = w.capture_id "
            f"AND {where}), [])")


_sql("report_text", f"""SELECT capture_id, CAST(i - 1 AS INT) AS line_no, l[i] AS line FROM (
  SELECT capture_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT capture_id, [
  'Capture ' || capture_id, '  process ' || pid || ', stored in 0 B, starts at ' || epoch || ' ms',
  '  ' || total || ' intervals of ' || tracks || ' tracks in ' || {_ns('span')}, '[time]',
  '  tracks: ' || {_ns('app')} || ', ' || {_pct('app', 'span')} || ' of the capture; hubs: ' || {_ns('hub')},
  '  half within ' || {_ns('p50')} || ', 95% within ' || {_ns('p95')} || ', 99% within ' || {_ns('p99')}, '[slow]',
  '  from 20 ms: ' || long_n || ', from 50 ms: ' || blocked_n]
  || {_items('ts', f"'  ' || rank || '. ' || {_ns('dur')} || CASE level WHEN 2 THEN ' !! ' ELSE ' ' END || func || ' in ' || name")}
  || ['[pauses]', '  ' || (SELECT sum(pauses)::BIGINT FROM tg WHERE tg.capture_id = w.capture_id) || ' in all, '
    || {_ns('gc_ns')} || ', ' || {_pct('gc_ns', 'span')} || ' of the capture']
  || {_items('tg', f"'  generation ' || generation || ': ' || pauses || ', ' || {_ns('total')}", 'generation', 'true')}
  || ['[tracks]']
  || {_items('tt', f"'  ' || rank || '. ' || name || CASE WHEN is_hub THEN '*' ELSE '' END || ' #' || gid || ': ' || {_ns('run')} || ' in ' || executions")}
  || ['[functions]']
  || {_items('tf', f"'  ' || rank || '. ' || func || ': ' || {_ns('total')} || ' in ' || executions || ', at most ' || {_ns('longest')}")}
  AS l FROM w))""", TOPS, META, """m AS (SELECT capture_id, arg_max(pid, seq) AS pid,
  arg_max(epoch_ms, seq) FILTER (epoch_ms > 0) AS epoch FROM meta GROUP BY ALL),
w AS (SELECT e.capture_id, count(*) AS total, max(stop) - arg_min(start, seq) AS span, any_value(pid) AS pid,
  any_value(epoch) AS epoch, any_value(p50) AS p50, any_value(p95) AS p95, any_value(p99) AS p99,
  (SELECT sum(total)::BIGINT FROM tg WHERE tg.capture_id = e.capture_id) AS gc_ns, """
     + SUMMARY.format("tracks", "hub", "app", "long_n", "blocked_n") + """
  FROM e JOIN m ON m.capture_id = e.capture_id JOIN tp ON tp.capture_id = e.capture_id GROUP BY e.capture_id)""")

_PARTED = f"""ends_ AS (SELECT min(seq) AS lo, (max(seq) - min(seq)) // 3 + 1 AS width FROM e),
parted AS (SELECT e.* REPLACE (CASE WHEN capture_id = 'cap-b' AND seq >= lo + 2 * width THEN start - {3 * DAY} ELSE start END
  AS start), (seq - lo) // width AS batch FROM e, ends_),
view AS (SELECT * FROM parted WHERE start < {28 * DAY} AND start + dur > {T0}),
sent AS (SELECT DISTINCT capture_id, batch, min(start) OVER (PARTITION BY capture_id, batch) <= max(start) OVER (
  PARTITION BY capture_id ORDER BY batch RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS back FROM view)"""
_sql("stream_follow", """SELECT v.capture_id, v.seq, v.start, v.dur, v.gid, coalesce(back, true) AS whole, s.batch FROM sent s
  JOIN view v ON v.capture_id = s.capture_id AND (v.batch = s.batch OR coalesce(back, true) AND v.batch < s.batch)""", _PARTED)
_sql("follower_view", "SELECT capture_id, seq, start, dur, gid FROM view", _PARTED)
_sql("interval_counts", f"""SELECT capture_id, start // {HOUR} AS interval, count(*) FILTER (NOT late) AS new_rows,
  count(*) FILTER (late) AS dropped, any_value((start // {HOUR} + 1) * {HOUR} <= top - {DAY}) AS closed FROM (
  SELECT *, max(start) OVER (PARTITION BY capture_id) AS top, coalesce((start // {HOUR} + 1) * {HOUR} <= max(start) OVER (
  PARTITION BY capture_id ORDER BY batch RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - {DAY}, false) AS late
  FROM parted) GROUP BY ALL""", _PARTED)
_sql("intern_stream", "SELECT capture_id, id, value FROM pool", POOL)
_sql("sketched_stats", f"""SELECT capture_id, count(*) AS rows, true AS p50_close, true AS p95_close, true AS p99_close,
  true AS tracks_close FROM e WHERE NOT is_hub AND start >= {T0} AND start < {T1} GROUP BY ALL""")
