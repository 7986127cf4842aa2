"""DuckDB SQL oracles for the registered queries (same tables, same names).

Each statement recomputes the query's result from the raw ``events`` view
with the adapter rules written out in SQL; it shares no code with the Spark
side.  Two spellings differ by engine: adding milliseconds
(``to_milliseconds``) and time literals (``TIMESTAMP '...'``).
"""

from __future__ import annotations

FINITE = "value IS NOT NULL AND NOT isnan(value) AND NOT isinf(value)"
GOOD = "event_id % 97 <> 0"
PUB = "strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ')"
ALERT_AT = "(ts + to_milliseconds(event_id % 3000))"
LAT = "CAST(event_id % 3000 AS DOUBLE)"


def uuid_of(x: str) -> str:
    h = f"md5(CAST({x} AS VARCHAR))"
    return " || '-' || ".join(f"substr({h}, {at}, {n})" for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))


def r2(x: str) -> str:
    return f"CAST(printf('%.2f', {x}) AS DOUBLE)"


def repr2(x: str) -> str:
    return f"regexp_replace(printf('%.2f', {x}), '0$', '')"


def iso(x: str) -> str:
    return (f"(CASE WHEN epoch_us({x}) % 1000000 = 0 THEN strftime({x}, '%Y-%m-%dT%H:%M:%S') "
            f"ELSE strftime({x}, '%Y-%m-%dT%H:%M:%S.%f') END || '+00:00')")


def exact_sum(x: str) -> str:
    """The sum of the values' decimal texts, as the nearest double."""
    return f"CAST(CAST(sum(CAST(CAST({x} AS VARCHAR) AS DECIMAL(38,18))) AS VARCHAR) AS DOUBLE)"


EXACT_MEAN = f"({exact_sum('value')} / CAST(count(*) AS DOUBLE))"


def a1(width: str) -> str:
    b = f"time_bucket(INTERVAL '{width}', ts)"
    return (f"SELECT {b} AS window_start, {b} + INTERVAL '{width}' AS window_end, count(*) AS \"count\", "
            f"{EXACT_MEAN} AS avg_temperature, min(value) AS min_temperature, max(value) AS max_temperature, "
            f"{EXACT_MEAN} > 50.0::DOUBLE AS alert_triggered, 50.0::DOUBLE AS threshold "
            f"FROM events WHERE {FINITE} GROUP BY ALL")


SAMPLES = (
    "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS timestamp, 'run-' || event_type || '-1' AS container, "
    "CAST(event_id % 900 AS VARCHAR) || '%' AS cpu_percent, "
    "CAST(event_id % 2000 AS VARCHAR) || (['GiB','MiB','KiB','B'])[event_id % 4 + 1] AS mem_used, "
    "CAST(event_id % 500 AS VARCHAR) || 'kB / ' || CAST(event_id % 70 AS VARCHAR) || 'MB' AS net_io FROM events")


def _num(p: str, n: int) -> str:
    return f"TRY_CAST(left({p}, length({p}) - {n}) AS DOUBLE)"


def mem_mb(x: str) -> str:
    m = f"trim(split_part(trim({x}), '/', 1))"
    return (f"(CASE WHEN ends_with({m}, 'GiB') THEN {_num(m, 3)} * 1024.0::DOUBLE "
            f"WHEN ends_with({m}, 'MiB') THEN {_num(m, 3)} * 1.0::DOUBLE "
            f"WHEN ends_with({m}, 'KiB') THEN {_num(m, 3)} / 1024.0::DOUBLE "
            f"WHEN ends_with({m}, 'B') THEN {_num(m, 1)} / 1048576.0::DOUBLE ELSE 0.0::DOUBLE END)")


def _net_part(p: str) -> str:
    return (f"(CASE WHEN ends_with({p}, 'GB') THEN {_num(p, 2)} * 1024.0::DOUBLE "
            f"WHEN ends_with({p}, 'MB') THEN {_num(p, 2)} * 1.0::DOUBLE "
            f"WHEN ends_with({p}, 'kB') THEN {_num(p, 2)} / 1024.0::DOUBLE "
            f"WHEN ends_with({p}, 'B') THEN {_num(p, 1)} / 1048576.0::DOUBLE ELSE 0.0::DOUBLE END)")


def net_mb(x: str) -> str:
    p1, p2 = f"trim(split_part({x}, '/', 1))", f"trim(split_part({x}, '/', 2))"
    return f"(0.0::DOUBLE + {_net_part(p1)} + {_net_part(p2)})"


def cpu(x: str) -> str:
    return f"TRY_CAST(replace(trim({x}), '%', '') AS DOUBLE)"


SERVICE = "(contains(container, '-click-') OR contains(container, '-view-') OR contains(container, '-error-'))"

REPORT = (
    f"SELECT container, {r2('avg(cpu)')} AS avg_cpu, {r2('max(cpu)')} AS peak_cpu, "
    f"{r2('avg(ram_mb)')} AS avg_ram_mb, {r2('max(ram_mb)')} AS peak_ram_mb, "
    f"{r2('avg(net_mb)')} AS avg_net_mb, {r2('max(net_mb)')} AS peak_net_mb FROM ("
    f"SELECT container, {cpu('cpu_percent')} AS cpu, {mem_mb('mem_used')} AS ram_mb, {net_mb('net_io')} AS net_mb "
    f"FROM ({SAMPLES}) WHERE container <> '' AND {SERVICE}) GROUP BY container")

HOURLY = ("SELECT event_type AS run, date_trunc('hour', ts) AS sample_ts, count(*) AS value, "
          f"count(*) FILTER (WHERE {GOOD}) AS stored FROM events GROUP BY ALL")

OFFSETS = (
    "SELECT partition, CASE WHEN partition <> 3 THEN committed END AS current_offset, log_end AS log_end_offset, "
    "log_end - CASE WHEN partition <> 3 THEN committed END AS lag FROM ("
    "SELECT CAST(user_id % 4 AS INTEGER) AS partition, count(*) AS log_end, "
    "count(*) FILTER (WHERE ts < TIMESTAMP '2024-01-20 00:00:00') AS committed FROM events GROUP BY ALL)")

LATENCIES = f"SELECT event_type AS run, {LAT} AS latency_ms FROM events WHERE {FINITE} AND value > 40.0::DOUBLE"

P95 = (f"SELECT run, latency_ms AS p95_ms FROM (SELECT run, latency_ms, "
       f"row_number() OVER (PARTITION BY run ORDER BY latency_ms) AS rn, count(*) OVER (PARTITION BY run) AS n "
       f"FROM ({LATENCIES})) WHERE rn = greatest(0, CAST(floor(0.95::DOUBLE * n) AS BIGINT) - 1) + 1")

LOSS = (f"SELECT run, sent, stored, CASE WHEN sent <= 0 THEN 0.0::DOUBLE "
        f"ELSE CAST(sent - stored AS DOUBLE) * 100.0::DOUBLE / CAST(sent AS DOUBLE) END AS loss_pct FROM ("
        f"SELECT event_type AS run, count(*) AS sent, count(*) FILTER (WHERE {GOOD}) AS stored FROM events GROUP BY ALL)")
LOSS_FULL = f"SELECT run, sent, stored, loss_pct, printf('%.2f', loss_pct) AS loss_text FROM ({LOSS})"

SNAP = (
    "SELECT run, db_before, db_after, received_before, received_after, "
    "(db_before // 500) * 500 AS stored_before, (db_after // 500) * 500 AS stored_after FROM ("
    f"SELECT event_type AS run, count(*) FILTER (WHERE {GOOD} AND ts < TIMESTAMP '2024-01-10 00:00:00') AS db_before, "
    f"count(*) FILTER (WHERE {GOOD} AND ts < TIMESTAMP '2024-01-20 00:00:00') AS db_after, "
    "count(*) FILTER (WHERE ts < TIMESTAMP '2024-01-10 00:00:00') AS received_before, "
    "count(*) FILTER (WHERE ts < TIMESTAMP '2024-01-20 00:00:00') AS received_after FROM events GROUP BY ALL)")

NULLS = ("NULL::VARCHAR AS location, event_type AS crop_type, NULL::VARCHAR AS season, value AS temperature, "
         "NULL::DOUBLE AS humidity, NULL::DOUBLE AS rainfall, NULL::DOUBLE AS soil_moisture, NULL::DOUBLE AS soil_ph, "
         "NULL::DOUBLE AS light_intensity, NULL::DOUBLE AS fertilizer_used, NULL::INTEGER AS irrigation_needed, "
         "NULL::VARCHAR AS crop_health, NULL::DOUBLE AS yield_estimate, NULL::VARCHAR AS pest_risk, "
         "NULL::INTEGER AS anomaly_flag")
READING17 = f"ts AS timestamp, CAST(user_id AS VARCHAR) AS device_id, {NULLS}"

INSTANT_RECORDS = (
    f"SELECT 'instant' AS kind, CAST(user_id AS VARCHAR) AS device_id, value AS temperature, 40.0::DOUBLE AS threshold, "
    f"NULL::BIGINT AS window_size_s, NULL::BIGINT AS \"count\", {PUB} AS published_at, {ALERT_AT} AS alert_at, "
    f"{LAT} AS e2e_latency_ms FROM events WHERE {FINITE} AND value > 40.0::DOUBLE")


def window_records(width: str, size_s: int) -> str:
    return (f"SELECT 'window' AS kind, NULL::VARCHAR AS device_id, avg_temperature AS temperature, threshold, "
            f"CAST({size_s} AS BIGINT) AS window_size_s, \"count\", NULL::VARCHAR AS published_at, "
            f"window_end AS alert_at, NULL::DOUBLE AS e2e_latency_ms FROM ({a1(width)}) "
            f"WHERE alert_triggered")


def streak(limit: int, needed: int) -> str:
    """First sample index at which ``value <= limit`` has held ``needed`` samples in a row."""
    return (
        "WITH i AS (SELECT run, sample_ts, value, row_number() OVER (PARTITION BY run ORDER BY sample_ts) - 1 AS idx, "
        f"sum(CASE WHEN value <= {limit} THEN 0 ELSE 1 END) OVER (PARTITION BY run ORDER BY sample_ts "
        f"ROWS UNBOUNDED PRECEDING) AS brk FROM ({HOURLY})), "
        f"j AS (SELECT *, sum(CASE WHEN value <= {limit} THEN 1 ELSE 0 END) OVER (PARTITION BY run, brk ORDER BY sample_ts "
        "ROWS UNBOUNDED PRECEDING) AS streak FROM i), "
        f"g AS (SELECT run, min(idx) FILTER (WHERE streak >= {needed}) AS recovery_index FROM j GROUP BY run) "
        "SELECT run, recovery_index, CASE WHEN recovery_index < 180 THEN CAST(recovery_index + 1 AS VARCHAR) "
        "ELSE '180+' END AS recovery_s FROM g")


def _last(where: str, expr: str) -> str:
    return f"(SELECT {expr} FROM events WHERE {where} ORDER BY ts DESC, event_id DESC LIMIT 1)"


ALERT_ROWS = f"{GOOD} AND {FINITE} AND value > 40.0::DOUBLE"

NESTED = (
    "WITH d AS (SELECT time_bucket(INTERVAL '1 day', ts) AS ws, CAST(user_id AS VARCHAR) AS device_id, "
    f"count(*) AS dc, {r2(EXACT_MEAN)} AS da, min(value) AS dmin, max(value) AS dmax "
    f"FROM events WHERE {FINITE} GROUP BY ALL) "
    "SELECT w.*, d.device_id, d.dc AS device_count, d.da AS device_avg, d.dmin AS device_min, "
    f"d.dmax AS device_max FROM d JOIN ({a1('1 day')}) w ON d.ws = w.window_start")

ORACLE: dict[str, str] = {
    # ------------------------------------------------------------ sources
    "csv_reading_scan": f"SELECT {READING17} FROM events",
    "topic_scan_analytics": "SELECT event_id AS offset, props AS value, "
                            "TRY_CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events",
    "topic_scan_storage": "SELECT event_id AS offset, event_id % 16 <= 6 AS is_error FROM events",
    "replay_batches": ("SELECT event_id, row_no, (row_no - 1) // 20 + 1 AS batch_no, ((row_no - 1) // 20) * 5 "
                       "AS release_offset_s FROM (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS row_no "
                       "FROM events)"),
    "stats_sample_scan": (f"SELECT timestamp, container, CASE WHEN event_id % 11 = 0 THEN '0' ELSE cpu_percent END "
                          f"AS cpu_percent, CASE WHEN event_id % 11 = 0 THEN '0' ELSE mem_used END AS mem_used, "
                          f"CASE WHEN event_id % 11 = 0 THEN '0 / 0' ELSE net_io END AS net_io FROM ({SAMPLES})"),
    "latency_scan": f"SELECT latency_ms FROM ({LATENCIES})",
    "offset_table_scan": f"SELECT partition, current_offset, log_end_offset, lag FROM ({OFFSETS})",
    "stored_count": f"SELECT count(*) AS stored_count FROM events WHERE {GOOD}",
    "counter_snapshot_read": ("SELECT event_id, coalesce(CAST(CASE json_type(props, '$.k') "
                              "WHEN 'UBIGINT' THEN TRY_CAST(json_extract(props, '$.k') AS BIGINT) "
                              "WHEN 'BIGINT' THEN TRY_CAST(json_extract(props, '$.k') AS BIGINT) "
                              "WHEN 'DOUBLE' THEN TRY_CAST(trunc(CAST(json_extract(props, '$.k') AS DOUBLE)) AS BIGINT) "
                              "WHEN 'BOOLEAN' THEN CASE WHEN json_extract_string(props, '$.k') = 'true' THEN 1 ELSE 0 END "
                              "WHEN 'VARCHAR' THEN CASE WHEN regexp_full_match(trim(json_extract_string(props, '$.k')), "
                              "'[+-]?[0-9]+') THEN TRY_CAST(trim(json_extract_string(props, '$.k')) AS BIGINT) END "
                              "END AS BIGINT), 0) AS k, coalesce(json_extract_string(props, '$.missing'), '') AS missing "
                              "FROM events"),
    # ------------------------------------------------------------ sinks
    "publish_json": (f"SELECT {uuid_of('event_id')} AS key, "
                     "to_json(struct_pack(timestamp := strftime(ts, '%Y-%m-%d %H:%M:%S'), "
                     "device_id := CAST(user_id AS VARCHAR), crop_type := event_type, temperature := value))::VARCHAR "
                     "AS value FROM events"),
    "append_reading": f"SELECT {READING17} FROM events WHERE {GOOD}",
    "append_batch": (f"SELECT batch_id, count(*) AS rows, count(*) = 500 AS flushed FROM ("
                     f"SELECT (row_number() OVER (ORDER BY ts, event_id) - 1) // 500 AS batch_id FROM events "
                     f"WHERE {GOOD}) GROUP BY batch_id"),
    "drain": f"SELECT count(*) % 500 AS flushed FROM events WHERE {GOOD}",
    "write_resource_report": REPORT,
    "append_summary": (f"SELECT 'A' AS scenario, 'spark' AS broker, run, sent, stored, loss_text AS lost_pct "
                       f"FROM ({LOSS_FULL})"),
    "result_pairs": (f"SELECT run, 'sent' AS key, CAST(sent AS VARCHAR) AS value FROM ({LOSS_FULL}) UNION ALL "
                     f"SELECT run, 'stored', CAST(stored AS VARCHAR) FROM ({LOSS_FULL}) UNION ALL "
                     f"SELECT run, 'loss_text', loss_text FROM ({LOSS_FULL})"),
    "alert_sink": f"{INSTANT_RECORDS} UNION ALL {window_records('1 hour', 3600)}",
    # ------------------------------------------------------------ projections / filters
    "reading_projection": f"SELECT event_id, {READING17} FROM events WHERE {GOOD}",
    "analytics_projection": (f"SELECT event_id, CAST(user_id AS VARCHAR) AS device_id, value AS temperature, "
                             f"{PUB} AS published_at FROM events WHERE {GOOD}"),
    "instant_alert_filter": (f"SELECT event_id, CAST(user_id AS VARCHAR) AS device_id, value AS temperature, "
                             f"40.0::DOUBLE AS threshold FROM events WHERE {ALERT_ROWS}"),
    "threshold_choice": ("SELECT event_id, value AS temperature, 40.0::DOUBLE AS threshold, "
                         "(value > 40.0::DOUBLE AND NOT isnan(value)) AS exceeds FROM events"),
    "window_alert_predicate": f"SELECT * FROM ({a1('1 hour')}) WHERE alert_triggered",
    "service_filter": f"SELECT event_id, container FROM ({SAMPLES}) WHERE container <> '' AND {SERVICE}",
    "valid_reading_filter": ("SELECT event_id, event_id % 97 <> 0 AS is_valid, "
                             "CASE WHEN event_id % 97 = 0 THEN 'not_json_object' END AS reject_reason FROM events"),
    "message_reject_reasons": (
        "SELECT event_id, k >= 5 AS is_json, k >= 7 AS is_object, "
        f"k = 8 OR (k >= 7 AND k <> 9 AND {FINITE}) AS temperature_ok, k = 10 OR k >= 12 AS is_valid, "
        "CASE WHEN k <= 6 THEN 'not_json_object' WHEN k IN (9, 11) THEN 'bad_value' WHEN k = 8 THEN 'null_required' "
        "WHEN k = 7 THEN 'too_long' END AS reject_reason, CASE WHEN k = 10 THEN 1 END AS irrigation_needed "
        "FROM (SELECT *, event_id % 16 AS k FROM events)"),
    "not_null_and_length_check": ("SELECT event_id, event_id % 16 <= 6 AS timestamp_missing, "
                                  "event_id % 16 <= 6 OR event_id % 16 = 8 AS device_id_missing, "
                                  "event_id % 16 = 7 AS too_long FROM events"),
    "latency_match": (
        f"WITH ls AS (SELECT run, pa AS sent_published_at FROM (SELECT event_type AS run, {PUB} AS pa, "
        f"row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1), "
        f"la AS (SELECT run, pa AS alert_published_at, lat FROM (SELECT event_type AS run, {PUB} AS pa, {LAT} AS lat, "
        f"row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events "
        f"WHERE {FINITE} AND value > 40.0::DOUBLE) WHERE rn = 1) "
        f"SELECT ls.run, sent_published_at, alert_published_at, "
        f"coalesce(alert_published_at = sent_published_at, false) AS matched, "
        f"CASE WHEN alert_published_at = sent_published_at THEN lat END AS accepted_latency_ms "
        f"FROM ls LEFT JOIN la ON ls.run = la.run"),
    "report_field_lookup": (f"SELECT c.container, coalesce({repr2('r.peak_cpu')}, 'N/A') AS peak_cpu FROM "
                            f"(SELECT DISTINCT container FROM ({SAMPLES})) c LEFT JOIN ({REPORT}) r "
                            f"ON c.container = r.container"),
    # ------------------------------------------------------------ scalar functions
    "parse_mem_mb": f"SELECT event_id, mem_used, {mem_mb('mem_used')} AS mem_mb FROM ({SAMPLES})",
    "parse_net_mb": f"SELECT event_id, net_io, {net_mb('net_io')} AS net_mb FROM ({SAMPLES})",
    "parse_cpu": f"SELECT event_id, cpu_percent, {cpu('cpu_percent')} AS cpu FROM ({SAMPLES})",
    "parse_published_at": (f"SELECT event_id, {PUB} AS published_at, "
                           f"strptime({PUB}, '%Y-%m-%dT%H:%M:%S.%fZ') AS published_ts FROM events"),
    "e2e_latency_ms": f"SELECT event_id, {LAT} AS e2e_latency_ms FROM events",
    "latency_default": f"SELECT event_id, CASE WHEN {GOOD} THEN {LAT} ELSE 0.0::DOUBLE END AS latency_ms FROM events",
    "loss_pct": LOSS_FULL,
    "round2": f"SELECT event_id, {r2('value / 3.0::DOUBLE')} AS rounded FROM events",
    "pair_format": (f"SELECT container, {repr2('avg_cpu')} || '/' || {repr2('peak_cpu')} AS cpu_pair, "
                    f"{repr2('avg_ram_mb')} || '/' || {repr2('peak_ram_mb')} AS ram_mb_pair, "
                    f"{repr2('avg_net_mb')} || '/' || {repr2('peak_net_mb')} AS net_mb_pair FROM ({REPORT})"),
    "clamped_backlog": f"SELECT run, sample_ts, value, stored, greatest(value - stored - 0, 0) AS backlog FROM ({HOURLY})",
    "iso_format": f"SELECT event_id, {iso('ts')} AS iso, strftime(ts, '%Y%m%d_%H%M%S') AS stamp FROM events",
    "stamp_second": "SELECT event_id, strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%S') || '.000Z' "
                    "AS published_at FROM events",
    # ------------------------------------------------------------ aggregations
    "window_global_stats": a1("1 day"),
    "window_device_stats": (
        "SELECT time_bucket(INTERVAL '1 day', ts) AS window_start, "
        "time_bucket(INTERVAL '1 day', ts) + INTERVAL '1 day' AS window_end, CAST(user_id AS VARCHAR) AS device_id, "
        f"count(*) AS \"count\", {r2(EXACT_MEAN)} AS \"avg\", min(value) AS \"min\", max(value) AS \"max\" "
        f"FROM events WHERE {FINITE} GROUP BY ALL"),
    "window_stats_nested": NESTED,
    "window_stats_flat": NESTED,
    "latest_window": (f"SELECT window_start, window_end, \"count\", {r2('avg_temperature')} AS avg_temperature, "
                      f"{r2('min_temperature')} AS min_temperature, {r2('max_temperature')} AS max_temperature, "
                      f"alert_triggered, threshold FROM ({a1('1 hour')}) ORDER BY window_end DESC LIMIT 1"),
    "analytics_counters": (
        f"SELECT (SELECT count(*) FROM events WHERE {GOOD}) AS received, "
        f"(SELECT count(*) FROM events WHERE {ALERT_ROWS}) AS alerts_triggered, "
        f"{_last(ALERT_ROWS, LAT)} AS last_e2e_latency_ms, {_last(ALERT_ROWS, PUB)} AS last_published_at, "
        f"{_last(ALERT_ROWS, iso(ALERT_AT))} AS last_alert_at"),
    "storage_counters": (
        "SELECT received, (ok // 500) * 500 AS stored, errors, ok % 500 AS buffered, ok // 500 AS batches_flushed "
        f"FROM (SELECT count(*) AS received, count(*) FILTER (WHERE {GOOD}) AS ok, "
        "count(*) FILTER (WHERE event_id % 97 = 0) AS errors FROM events)"),
    "resource_by_container": REPORT,
    "latency_summary": (
        f"SELECT s.run, s.n, {r2('s.a')} AS avg_ms, {r2('s.mn')} AS min_ms, {r2('s.mx')} AS max_ms, "
        f"{r2('p.p95_ms')} AS p95_ms, printf('%.2f', s.a) || ',' || printf('%.2f', s.mn) || ',' || "
        f"printf('%.2f', s.mx) || ',' || printf('%.2f', p.p95_ms) AS summary FROM "
        f"(SELECT run, count(*) AS n, {exact_sum('latency_ms')} / CAST(count(*) AS DOUBLE) AS a, min(latency_ms) AS mn, max(latency_ms) AS mx "
        f"FROM ({LATENCIES}) GROUP BY run) s LEFT JOIN ({P95}) p ON s.run = p.run"),
    "group_lag": ("SELECT CAST(coalesce(sum(current_offset), sum(log_end_offset), 0) AS BIGINT) AS \"offset\", "
                  "CAST(coalesce(sum(log_end_offset), 0) AS BIGINT) AS log_end_offset, "
                  f"CAST(coalesce(sum(lag), 0) AS BIGINT) AS lag FROM ({OFFSETS})"),
    "received_max": f"SELECT run, db_after, stored_after, greatest(db_after, stored_after) AS received FROM ({SNAP})",
    "outage_messages": ("SELECT run, db_after - db_before AS db_delta, received_after - received_before AS metrics_delta, "
                        "stored_after - stored_before AS stored_delta, greatest(received_after - received_before, "
                        "stored_after - stored_before, db_after - db_before, 0) AS messages_during "
                        f"FROM ({SNAP})"),
    "peak_backlog": ("SELECT run, CAST(coalesce(max(value) FILTER (WHERE sample_ts >= TIMESTAMP '2024-01-15 00:00:00'), 0) "
                     f"AS BIGINT) AS peak_backlog FROM ({HOURLY}) GROUP BY run"),
    # ------------------------------------------------------------ ordered computations
    "p95_floor_rank": P95,
    "sort_values": f"SELECT latency_ms, row_number() OVER (ORDER BY latency_ms) AS position FROM ({LATENCIES})",
    "drain_stable": (
        "WITH i AS (SELECT run, sample_ts, value, row_number() OVER w - 1 AS idx, "
        "CASE WHEN value = lag(value) OVER w THEN 0 ELSE 1 END AS chg "
        f"FROM ({HOURLY}) WINDOW w AS (PARTITION BY run ORDER BY sample_ts)), "
        "j AS (SELECT *, sum(chg) OVER (PARTITION BY run ORDER BY sample_ts ROWS UNBOUNDED PRECEDING) AS island FROM i), "
        "k AS (SELECT *, row_number() OVER (PARTITION BY run, island ORDER BY sample_ts) - 1 AS reps FROM j) "
        "SELECT run, min(idx) FILTER (WHERE reps >= 3) AS drained_index, "
        "arg_min(value, idx) FILTER (WHERE reps >= 3) AS drained_value, "
        "min(idx) FILTER (WHERE reps >= 3) IS NULL AS timed_out FROM k GROUP BY run"),
    "recovery_streak": streak(5, 10),
    "recovery_streak_long": streak(5, 30),
    "lag_recovery": (
        "WITH g AS (SELECT run, min(sample_ts) FILTER (WHERE sample_ts >= TIMESTAMP '2024-01-10 00:00:00' AND value <= 5) "
        f"AS f FROM ({HOURLY}) GROUP BY run), "
        "s AS (SELECT run, CAST(epoch(f) - epoch(TIMESTAMP '2024-01-10 00:00:00') AS BIGINT) AS t FROM g) "
        "SELECT run, CASE WHEN t <= 7200 THEN t END AS recovery_seconds, "
        "CASE WHEN t <= 7200 THEN CAST(t AS VARCHAR) ELSE '120+' END AS recovery_s FROM s"),
    "first_recovery": (
        "WITH g AS (SELECT run, min(sample_ts) FILTER (WHERE sample_ts >= TIMESTAMP '2024-01-10 00:00:00' AND value > 3) "
        f"AS f FROM ({HOURLY}) GROUP BY run) "
        "SELECT run, CAST(epoch(f) - epoch(TIMESTAMP '2024-01-10 00:00:00') AS BIGINT) AS recovery_seconds, "
        "coalesce(CAST(CAST(epoch(f) - epoch(TIMESTAMP '2024-01-10 00:00:00') AS BIGINT) AS VARCHAR), '120+') "
        "AS recovery_s FROM g"),
    "progress_every_n": ("SELECT event_id, received_so_far FROM (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) "
                         "AS received_so_far FROM events) WHERE received_so_far % 1000 = 0"),
    "batch_slice": ("SELECT event_id, row_no FROM (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS row_no "
                    "FROM events) WHERE row_no > 100 AND row_no <= 120"),
    # ------------------------------------------------------------ streaming
    "tumbling_arrival_window": a1("1 hour"),
    "instant_alert_stream": INSTANT_RECORDS,
    "window_alert_stream": window_records("1 hour", 3600),
    "received_vs_parsed": (f"SELECT count(*) AS storage_received, count(*) FILTER (WHERE {GOOD}) AS analytics_received, "
                           f"count(*) FILTER (WHERE {GOOD} AND {FINITE}) AS analytics_windowed FROM events"),
}
