"""SQL twins of the registered queries, for DuckDB on the same tables."""

from __future__ import annotations

KEYS = "station_id, parameter"

EVENTS = """raw AS (
  SELECT CAST(user_id % 5 AS INTEGER) AS station_id, event_type AS parameter, ts,
         CASE WHEN k % 10 <> 0 THEN value END AS value,
         CASE WHEN k % 2 = 0 THEN 'Geprueft' ELSE 'Rohdaten' END AS status, k, event_id
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)
)"""

ORDERS = """raw AS (
  SELECT CAST(o_custkey % 5 AS INTEGER) AS station_id, o_orderpriority AS parameter,
         o_orderdate AS ts, o_totalprice AS value, o_orderstatus AS status
  FROM orders
)"""

LINES = """raw AS (
  SELECT CAST(l_suppkey AS INTEGER) AS station_id, l_linestatus AS parameter,
         l_shipdate AS ts, l_extendedprice AS value, l_returnflag AS status
  FROM lineitem
)"""

GAUGE = """gauge AS (
  SELECT * REPLACE (CASE WHEN parameter IN ('click', 'view', 'purchase') THEN 'water_level_cm'
                         ELSE 'water_temperature_c' END AS parameter)
  FROM raw
)"""

MEAN = "CAST(SUM(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / COUNT(value)"

DAILY = f"""status_counts AS (
  SELECT {KEYS}, CAST(ts AS DATE) AS date, status, COUNT(*) AS n, MIN(ts) AS first_ts
  FROM raw WHERE status IS NOT NULL GROUP BY {KEYS}, CAST(ts AS DATE), status
), modes AS (
  SELECT {KEYS}, date, status AS status_mode
  FROM (SELECT *, row_number() OVER (PARTITION BY {KEYS}, date ORDER BY n DESC, first_ts, status) AS rn
        FROM status_counts)
  WHERE rn = 1
), days AS (
  SELECT {KEYS}, CAST(ts AS DATE) AS date, COUNT(value) AS "count", {MEAN} AS mean,
         MIN(value) AS "min", MAX(value) AS "max"
  FROM raw GROUP BY {KEYS}, CAST(ts AS DATE) HAVING COUNT(value) > 0
), daily AS (
  SELECT days.*, status_mode FROM days LEFT JOIN modes USING (station_id, parameter, date)
)"""

NEW = """new AS (
  SELECT station_id, parameter, CASE WHEN k % 2 = 0 THEN ts ELSE ts + INTERVAL 1 HOUR END AS ts,
         value + turn AS value, status, turn
  FROM raw, (VALUES (1), (2)) AS f(turn)
)"""


def raw_scan() -> str:
    return f"""WITH {EVENTS}
SELECT {KEYS}, CAST(ts AS VARCHAR) AS ts, value, status FROM raw WHERE value IS NOT NULL"""


def raw_range(start: str, end: str, inclusive: bool = False) -> str:
    last = f"ts < DATE '{end}' + INTERVAL 1 DAY" if inclusive else f"ts <= TIMESTAMP '{end} 00:00:00'"
    return f"""WITH {EVENTS}
SELECT {KEYS}, CAST(ts AS VARCHAR) AS x, value AS y FROM raw
WHERE ts >= TIMESTAMP '{start} 00:00:00' AND {last} AND value IS NOT NULL"""


def start_date_filter(start: str) -> str:
    return f"""WITH {EVENTS}
SELECT {KEYS}, CAST(ts AS VARCHAR) AS ts, value, status FROM raw WHERE CAST(ts AS DATE) >= DATE '{start}'"""


def _daily_points(start: str, end: str) -> str:
    return f"""SELECT {KEYS}, CAST(date AS VARCHAR) AS x, mean AS y FROM daily
WHERE date BETWEEN DATE '{start}' AND DATE '{end}' AND mean IS NOT NULL"""


def daily_range(start: str, end: str) -> str:
    return f"WITH {EVENTS}, {DAILY} {_daily_points(start, end)}"


def _hourly_points(where: str = "") -> str:
    return f"""SELECT {KEYS}, strftime(ts, '%Y-%m-%d %H:00:00') AS x, {MEAN} AS y FROM raw
WHERE value IS NOT NULL {where} GROUP BY {KEYS}, strftime(ts, '%Y-%m-%d %H:00:00')"""


def series_dispatch(start: str, end: str) -> str:
    between = f"AND ts >= TIMESTAMP '{start} 00:00:00' AND ts <= TIMESTAMP '{end} 00:00:00'"
    return f"""WITH {EVENTS}, {DAILY}, d AS ({_daily_points(start, end)}), h AS ({_hourly_points(between)}),
r AS (SELECT {KEYS}, CAST(ts AS VARCHAR) AS x, value AS y FROM raw WHERE value IS NOT NULL {between})
SELECT *, 'raw/month' AS asked FROM r WHERE parameter = 'view'
UNION ALL SELECT *, 'hourly/5y' FROM h WHERE parameter = 'view'
UNION ALL SELECT *, 'daily/' FROM d WHERE parameter = 'view'
UNION ALL SELECT *, 'raw/1y' FROM r WHERE parameter = 'view'"""


def relative_ranges() -> str:
    return f"""WITH {ORDERS}, presets(preset, lo) AS (
  VALUES ('today', DATE '1998-03-31'), ('week', DATE '1998-03-24'), ('month', DATE '1998-02-28'),
         ('1y', DATE '1997-03-31'), ('5y', DATE '1993-03-31'), ('all', DATE '1973-01-01'))
SELECT {KEYS}, preset, COUNT(*) AS n_rows, CAST(MIN(ts) AS VARCHAR) AS first_ts, CAST(MAX(ts) AS VARCHAR) AS last_ts
FROM raw JOIN presets ON ts >= lo AND ts <= TIMESTAMP '1998-03-31 00:00:00'
WHERE value IS NOT NULL GROUP BY {KEYS}, preset"""


def daily_rollup(source: str = EVENTS) -> str:
    return f"""WITH {source}, {DAILY}
SELECT * REPLACE (CAST(date AS VARCHAR) AS date) FROM daily"""


def status_mode() -> str:
    return f"WITH {EVENTS}, {DAILY} SELECT {KEYS}, CAST(date AS VARCHAR) AS date, status_mode FROM modes"


def hourly_mean() -> str:
    return f"WITH {EVENTS} {_hourly_points()}"


def latest_daily() -> str:
    return f"""WITH {EVENTS}, {DAILY}, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY {KEYS} ORDER BY date DESC) AS rn FROM daily)
SELECT {KEYS}, CAST(date AS VARCHAR) AS date, mean, "min", "max", "count", status_mode FROM ranked WHERE rn = 1"""


def _band() -> str:
    """Percentiles of the sorted list ``l`` between its two neighbours, in Spark's order of arithmetic."""
    def level(p: int) -> str:
        q = f"((len(l) - 1) * {p / 100}::DOUBLE)"
        low, high = f"l[CAST(floor({q}) AS BIGINT) + 1]", f"l[CAST(ceil({q}) AS BIGINT) + 1]"
        return (f"CASE WHEN {low} = {high} THEN {low} "
                f"ELSE (ceil({q}) - {q}) * {low} + ({q} - floor({q})) * {high} END AS p{p:02d}")

    return ", ".join(map(level, (5, 25, 50, 75, 95)))


SORTED = "list_sort(list(mean) FILTER (mean IS NOT NULL)) AS l"


def seasonal_band(as_of: str | None) -> str:
    target = (f"CAST(dayofyear(DATE '{as_of}') AS INTEGER)" if as_of
              else f"dayofyear(MAX(date) OVER (PARTITION BY {KEYS}))")
    return f"""WITH {ORDERS}, {DAILY}, near AS (
  SELECT {KEYS}, CASE WHEN abs(dayofyear(date) - {target}) <= 7 THEN mean END AS mean FROM daily)
SELECT {KEYS}, {_band()} FROM (SELECT {KEYS}, {SORTED} FROM near GROUP BY {KEYS})"""


def seasonal_band_all(wrap: bool) -> str:
    length = "dayofyear(make_date(year(date), 12, 31))"
    near = "abs(doy - target) <= 7"
    if wrap:
        near += " OR len - doy + target <= 7 OR greatest(365, target) - target + doy <= 7"
    return f"""WITH {ORDERS}, {DAILY}, d AS (
  SELECT {KEYS}, mean, dayofyear(date) AS doy, {length} AS len FROM daily WHERE mean IS NOT NULL
), targets AS (SELECT unnest(range(1, 367)) AS target)
SELECT {KEYS}, CAST(target AS INTEGER) AS target_doy, {_band()}
FROM (SELECT {KEYS}, target, {SORTED} FROM d JOIN targets ON {near} GROUP BY {KEYS}, target)"""


def _records(source: str) -> str:
    return f"""WITH {source}, lows AS (
  SELECT *, row_number() OVER (PARTITION BY {KEYS} ORDER BY value, ts, status) AS rn FROM raw WHERE value IS NOT NULL
), highs AS (
  SELECT *, row_number() OVER (PARTITION BY {KEYS} ORDER BY value DESC, ts, status) AS rn FROM raw WHERE value IS NOT NULL
)"""


def records() -> str:
    return f"""{_records(EVENTS)}
SELECT l.station_id, l.parameter, CAST(l.ts AS VARCHAR) AS min_ts, l.value AS min_value,
       COALESCE(l.status, '') AS min_status, CAST(h.ts AS VARCHAR) AS max_ts, h.value AS max_value,
       COALESCE(h.status, '') AS max_status
FROM lows l JOIN highs h ON l.station_id = h.station_id AND l.parameter = h.parameter
WHERE l.rn = 1 AND h.rn = 1"""


def record_context() -> str:
    return f"""{_records(ORDERS)}, {DAILY}, found AS (
  SELECT {KEYS}, 'min' AS kind, ts FROM lows WHERE rn = 1
  UNION ALL SELECT {KEYS}, 'max', ts FROM highs WHERE rn = 1)
SELECT d.station_id, d.parameter, kind, CAST(ts AS VARCHAR) AS record_ts, CAST(date AS VARCHAR) AS date, mean
FROM daily d JOIN found f ON d.station_id = f.station_id AND d.parameter = f.parameter
 AND date BETWEEN CAST(ts AS DATE) - 30 AND CAST(ts AS DATE) + 30"""


def completeness() -> str:
    return f"""WITH {EVENTS}, {DAILY}, r AS (
  SELECT {KEYS}, COUNT(*) AS n_rows, MIN(ts) AS lo, MAX(ts) AS hi, COUNT(DISTINCT CAST(ts AS DATE)) AS distinct_dates
  FROM raw GROUP BY {KEYS}
), d AS (
  SELECT {KEYS}, COUNT(*) AS n_days, MIN(date) AS first_date, MAX(date) AS last_date FROM daily GROUP BY {KEYS})
SELECT station_id, parameter, n_rows, CAST(lo AS VARCHAR) AS first_ts, CAST(hi AS VARCHAR) AS last_ts, distinct_dates,
       CAST((epoch_us(hi) - epoch_us(lo)) // 86400000000 + 1 AS BIGINT) AS days_covered,
       n_days, CAST(first_date AS VARCHAR) AS first_date, CAST(last_date AS VARCHAR) AS last_date
FROM r FULL JOIN d USING (station_id, parameter)"""


def since_threshold(start: str) -> str:
    return f"""WITH {EVENTS}
SELECT {KEYS}, COUNT(*) AS n_rows, CAST(MAX(ts) AS VARCHAR) AS latest_ts,
       arg_max_null(value, ts) AS latest_value
FROM raw WHERE ts >= TIMESTAMP '{start} 00:00:00' GROUP BY {KEYS}"""


def value_domain() -> str:
    return f"""WITH {EVENTS}
SELECT {KEYS}, MIN(value) * 0.95::DOUBLE AS y_low, MAX(value) * 1.05::DOUBLE AS y_high,
       CAST(MIN(ts) AS VARCHAR) AS x_min, CAST(MAX(ts) AS VARCHAR) AS x_max,
       (epoch_us(MAX(ts)) - epoch_us(MIN(ts))) / 86400000000.0::DOUBLE AS span_days
FROM raw WHERE value IS NOT NULL GROUP BY {KEYS}"""


def visible_domain(start: str, end: str) -> str:
    return f"""WITH {EVENTS}
SELECT {KEYS}, 0.0::DOUBLE AS y_low,
       COALESCE(NULLIF(MAX(CASE WHEN ts >= TIMESTAMP '{start} 00:00:00' AND ts <= TIMESTAMP '{end} 00:00:00'
                                THEN value END), 0), 1)::DOUBLE AS y_high
FROM raw GROUP BY {KEYS}"""


def visible_points(start: str, end: str) -> str:
    return f"""WITH {EVENTS}
SELECT {KEYS}, CAST(ts AS VARCHAR) AS ts, value FROM raw
WHERE ts >= TIMESTAMP '{start} 00:00:00' AND ts <= TIMESTAMP '{end} 00:00:00'"""


def merge_last_wins() -> str:
    return f"""WITH {EVENTS}, {NEW}, every_row AS (
  SELECT {KEYS}, ts, value, status, 0 AS origin, 0 AS turn FROM raw
  UNION ALL SELECT {KEYS}, ts, value, status, 1, turn FROM new
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY {KEYS}, ts ORDER BY origin DESC, turn DESC, value DESC NULLS LAST,
                               status DESC) AS rn FROM every_row)
SELECT {KEYS}, CAST(ts AS VARCHAR) AS ts, value, status FROM ranked WHERE rn = 1"""


def merge_report() -> str:
    return f"""WITH {EVENTS}, {NEW}, o AS (SELECT {KEYS}, COUNT(*) AS n_existing FROM raw GROUP BY {KEYS}),
n AS (SELECT {KEYS}, COUNT(*) AS n_new FROM new GROUP BY {KEYS}),
m AS (SELECT {KEYS}, COUNT(DISTINCT ts) AS n_merged
      FROM (SELECT {KEYS}, ts FROM raw UNION ALL SELECT {KEYS}, ts FROM new) GROUP BY {KEYS})
SELECT station_id, parameter, n_existing, n_new, n_merged, n_merged - n_existing AS net_new
FROM m LEFT JOIN o USING (station_id, parameter) LEFT JOIN n USING (station_id, parameter)"""


def new_readings() -> str:
    return f"""WITH {EVENTS}, incoming AS (
  SELECT {KEYS}, CASE WHEN k % 3 = 2 THEN ts + INTERVAL 1 HOUR ELSE ts END AS ts,
         CASE WHEN k % 3 = 1 THEN value + 1 ELSE value END AS value, status FROM raw)
SELECT station_id, parameter, CAST(ts AS VARCHAR) AS ts, value, status FROM incoming i
WHERE NOT EXISTS (SELECT 1 FROM raw s WHERE s.station_id = i.station_id AND s.parameter = i.parameter
                  AND s.ts = i.ts AND s.value IS NOT DISTINCT FROM i.value)"""


def _latest(where: str = "") -> str:
    return f"""SELECT {KEYS}, ts, value, status FROM (
  SELECT *, row_number() OVER (PARTITION BY {KEYS} ORDER BY ts DESC, value DESC, status DESC) AS rn
  FROM raw WHERE value IS NOT NULL {where}) WHERE rn = 1"""


def latest_live() -> str:
    return f"WITH {EVENTS}, l AS ({_latest()}) SELECT * REPLACE (CAST(ts AS VARCHAR) AS ts) FROM l"


def live_or_daily() -> str:
    return f"""WITH {EVENTS}, {DAILY}, l AS ({_latest("AND (parameter <> 'error' OR station_id = 4)")}), d AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {KEYS} ORDER BY date DESC) AS rn
                 FROM daily WHERE station_id <> 4) WHERE rn = 1)
SELECT station_id, parameter, COALESCE(l.value, d.mean) AS value,
       CASE WHEN l.value IS NOT NULL THEN CAST(l.ts AS VARCHAR) ELSE CAST(d.date AS VARCHAR) END AS as_of,
       l.value IS NOT NULL AS is_live
FROM d FULL JOIN l USING (station_id, parameter)"""


def newest_topn() -> str:
    return f"""WITH {EVENTS}, ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY {KEYS} ORDER BY ts DESC, event_id DESC) AS INTEGER) AS "rank" FROM raw)
SELECT {KEYS}, CAST(ts AS VARCHAR) AS ts, value, status, "rank" FROM ranked WHERE "rank" <= 10"""


def snapshot_nested() -> str:
    return """SELECT CAST(user_id AS INTEGER) AS station_id, event_type AS parameter,
       CAST(date_trunc('day', ts)::TIMESTAMP AS VARCHAR) AS window_start, COUNT(*) AS n,
       CAST(MAX(ts) AS VARCHAR) AS newest_ts, arg_max(value, ts) AS newest_value, CAST(MIN(ts) AS VARCHAR) AS oldest_ts
FROM events WHERE value IS NOT NULL GROUP BY ALL"""


def nearest_observation() -> str:
    return f"""WITH {EVENTS}, obs AS (SELECT {KEYS}, ts, MAX(value) AS value FROM raw WHERE value IS NOT NULL GROUP BY ALL),
probes AS (
  SELECT CAST((station_id + 1) % 5 AS INTEGER) AS station_id, parameter, ts + to_minutes(k - 50) AS probe_ts, event_id FROM raw
), b AS (
  SELECT p.*, o.ts AS before_ts, o.value AS before_value FROM probes p ASOF LEFT JOIN obs o
  ON p.station_id = o.station_id AND p.parameter = o.parameter AND p.probe_ts >= o.ts
), a AS (
  SELECT b.*, o.ts AS after_ts, o.value AS after_value FROM b ASOF LEFT JOIN obs o
  ON b.station_id = o.station_id AND b.parameter = o.parameter AND b.probe_ts < o.ts
), c AS (
  SELECT *, before_ts IS NULL OR epoch_us(after_ts) - epoch_us(probe_ts) < epoch_us(probe_ts) - epoch_us(before_ts) AS later FROM a)
SELECT station_id, parameter, CAST(probe_ts AS VARCHAR) AS probe_ts, event_id,
       CAST(CASE WHEN later THEN after_ts ELSE before_ts END AS VARCHAR) AS obs_ts,
       CASE WHEN later THEN after_value ELSE before_value END AS value
FROM c"""


def update_plan() -> str:
    return """WITH u AS (
  SELECT o_orderkey || '.csv' AS name, CAST(floor(o_totalprice) AS BIGINT) AS length, o_orderstatus AS s FROM orders)
SELECT folder, name, length,
       CASE WHEN s = 'P' OR folder = 'b' THEN NULL WHEN s = 'O' THEN length + 1 ELSE length END AS target_length,
       CASE WHEN s = 'P' OR folder = 'b' THEN 'copy' WHEN s = 'O' THEN 'backup' ELSE 'already_applied' END AS action,
       TRUE AS applied
FROM u, (VALUES ('a'), ('b')) AS f(folder)"""


EXPORT_PARAMETER = """CASE parameter WHEN 'click' THEN 'water_level_cm' WHEN 'view' THEN 'water_temperature_c'
     ELSE 'unknown' END"""
EXPORT_PATH = "'exports/' || station_id || '_' || parameter || '.csv'"


def csv_roundtrip() -> str:
    return f"""WITH {EVENTS}
SELECT CAST(station_id + 1 AS INTEGER) AS station_id, {EXPORT_PARAMETER} AS parameter,
       CAST(date_trunc('minute', ts) AS VARCHAR) AS ts,
       CASE WHEN k % 10 <> 1 THEN value END AS value, status, {EXPORT_PATH} AS source_file
FROM raw WHERE k % 10 <> 2"""


LINES_OF_HEAD = 8


def csv_line_balance() -> str:
    return f"""WITH {EVENTS}
SELECT {EXPORT_PATH} AS file_path, COUNT(*) + {LINES_OF_HEAD} AS n_lines, CAST(6 AS BIGINT) AS n_meta, CAST(1 AS BIGINT) AS n_header,
       COUNT(*) AS n_rows, CAST(1 AS BIGINT) AS n_blank, COUNT(*) FILTER (k % 10 <> 2) AS n_series,
       COUNT(*) FILTER (k % 10 = 2) AS n_rejects
FROM raw GROUP BY ALL"""


def _export_bytes(condition: str = "true") -> str:
    """Bytes of the rows and of the head lines, a line end each; the writer leaves the blank line out."""
    return f"""rows_ AS (
  SELECT station_id || '_' || parameter AS s, station_id AS n, parameter AS p,
         strlen('"' || substr(CAST(ts AS VARCHAR), 1, 16) || CASE WHEN k % 10 = 2 THEN ' Uhr' ELSE '' END || '";' ||
                COALESCE(replace(CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR), '.', ',') || CASE WHEN k % 10 = 1 THEN 'abc' ELSE '' END, '')
                || ';' || CASE status WHEN 'Geprueft' THEN 'Geprüft' ELSE ' ' || status END) + 1 AS b FROM raw WHERE {condition}
), heads AS (
  SELECT DISTINCT s, strlen('Quelle:;"Pegeldienst"') + strlen('Zeitbezug:;MEZ') + strlen('Messstellen-Name:;Pegel ' || n)
       + strlen('Messstellen-Nr.:;' || (n + 1)) + strlen('Gewässer:;Musterbach')
       + strlen('Ostwert:;69' || n || ';Nordwert:;53' || n || ';"UTM 32N"')
       + strlen('Datum;"' || CASE p WHEN 'click' THEN 'Wasserstand [cm]' WHEN 'view' THEN 'Wassertemperatur [°C]'
                                    ELSE 'Abfluss [m³/s]' END || '";Prüfstatus') + {LINES_OF_HEAD - 1} AS b FROM rows_)
SELECT s, CAST(SUM(b) AS BIGINT) AS n_bytes FROM (SELECT s, b FROM rows_ UNION ALL SELECT s, b FROM heads) GROUP BY s"""


def export_listing() -> str:
    return f"""WITH {EVENTS}, {_export_bytes().replace("SELECT s, CAST", "SELECT 'series=' || s AS folder, CAST")}"""


def export_files() -> str:
    return f"""SELECT * EXCLUDE (source_file), replace(source_file, 'exports/', '') AS file_name FROM ({csv_roundtrip()})"""


def update_files() -> str:
    older = _export_bytes("station_id > 1 OR (station_id = 0 AND k < 50)")
    return f"""WITH {EVENTS}, u AS (WITH {_export_bytes()}), t AS (WITH {older}), p AS (
  SELECT 'a' AS folder, u.s || '.csv' AS name, u.n_bytes AS length, t.n_bytes AS target_length FROM u LEFT JOIN t USING (s)
  UNION ALL SELECT 'b/c', s || '.csv', n_bytes, NULL FROM u)
SELECT *, CASE WHEN target_length IS NULL THEN 'copy' WHEN target_length = length THEN 'already_applied' ELSE 'backup' END AS action,
       true AS applied FROM p"""


def export_dedup() -> str:
    return f"""WITH {EVENTS}, ranked AS (
  SELECT CAST(station_id + 1 AS INTEGER) AS station_id,
         {EXPORT_PARAMETER} AS parameter, date_trunc('minute', ts) AS ts, value, status,
         row_number() OVER (PARTITION BY station_id, {EXPORT_PARAMETER}, date_trunc('minute', ts)
                            ORDER BY raw.parameter DESC, value DESC, status DESC) AS rn
  FROM raw WHERE value IS NOT NULL)
SELECT {KEYS}, CAST(ts AS VARCHAR) AS ts, value, status FROM ranked WHERE rn = 1"""


def export_stream_store() -> str:
    return f"""WITH {EVENTS}, ranked AS (
  SELECT CAST(station_id + 1 AS INTEGER) AS s, {EXPORT_PARAMETER} AS p, date_trunc('minute', ts) AS ts,
         CASE WHEN k % 10 <> 1 THEN value END AS value, status, parameter AS file
  FROM raw WHERE k % 10 <> 2
), last AS (
  SELECT *, row_number() OVER (PARTITION BY s, p, ts ORDER BY file DESC, value DESC NULLS LAST, status DESC) AS rn FROM ranked)
SELECT s AS station_id, p AS parameter, CAST(ts AS VARCHAR) AS ts, value, status FROM last WHERE rn = 1"""


def live_stream_store() -> str:
    return f"""WITH {EVENTS}, {GAUGE}
SELECT {KEYS}, CAST(date_trunc('second', ts) AS VARCHAR) AS ts, MAX(value) AS value, 'Rohdaten' AS status
FROM gauge WHERE value IS NOT NULL GROUP BY {KEYS}, date_trunc('second', ts)"""


def raw_range_ordered(start: str, end: str) -> str:
    return f"""WITH points AS ({raw_range(start, end)}), placed AS (
  SELECT {KEYS}, x, rank() OVER (ORDER BY {KEYS}, x) AS place FROM points)
SELECT {KEYS}, x, place, COUNT(*) AS n FROM placed GROUP BY ALL"""


def csv_rejects() -> str:
    return f"""WITH {EVENTS}
SELECT {EXPORT_PATH} AS file_path, CASE k % 10 WHEN 1 THEN 'bad_value' ELSE 'bad_ts' END AS reject_reason, COUNT(*) AS n
FROM raw WHERE k % 10 IN (1, 2) GROUP BY ALL"""


def station_meta() -> str:
    return f"""WITH {EVENTS}, files AS (SELECT DISTINCT station_id AS s, parameter, {EXPORT_PATH} AS file_path FROM raw)
SELECT file_path, {EXPORT_PARAMETER} AS parameter, CAST(s + 1 AS INTEGER) AS station_id, 'Pegel ' || s AS station_name,
       'Musterbach' AS river, 'MEZ' AS time_ref, CAST('69' || s AS INTEGER) AS easting,
       CAST('53' || s AS INTEGER) AS northing, 'UTM 32N' AS coord_ref, CAST(NULL AS VARCHAR) AS gauge_zero,
       CAST(6 AS BIGINT) AS n_fields, 'MEZ' AS time_zone_field
FROM files"""


def station_documents() -> str:
    def files(parameter: str) -> str:
        return f"""COALESCE(string_agg(CASE WHEN parameter = '{parameter}' THEN file_path END, ',' ORDER BY file_path), '')"""

    return f"""WITH {EVENTS}, files AS (SELECT DISTINCT station_id AS s, parameter, {EXPORT_PATH} AS file_path FROM raw)
SELECT CAST(s + 1 AS INTEGER) AS station_id, 'Pegel ' || s AS station_name, CAST('69' || s AS INTEGER) AS easting,
       {files('click')} AS water_level_files, {files('view')} AS water_temperature_files
FROM files GROUP BY s"""


def jsonl_roundtrip() -> str:
    return f"""WITH {EVENTS}, {GAUGE}, r AS (
  SELECT *, CASE WHEN k % 10 = 3 THEN 'malformed' WHEN value IS NULL THEN 'no_value' END AS reject_reason FROM gauge)
SELECT event_id, CASE WHEN k % 10 <> 3 THEN station_id END AS station_id,
       CASE WHEN k % 10 <> 3 THEN CAST(date_trunc('second', ts) AS VARCHAR) END AS ts,
       CASE WHEN k % 10 <> 3 THEN value END AS value,
       CASE WHEN reject_reason IS NULL THEN parameter END AS parameter, reject_reason
FROM r"""


def scalar_suite() -> str:
    return f"""WITH {EVENTS}, {GAUGE}
SELECT event_id,
       CASE WHEN k % 2 = 1 THEN CAST(date_trunc('minute', ts) AS VARCHAR) END AS f01,
       CASE WHEN k % 2 = 1 THEN CAST(date_trunc('minute', ts) AS VARCHAR) END AS f02,
       CASE WHEN k % 2 = 1 THEN value END AS f03,
       CASE WHEN k % 2 = 0 THEN status END AS f04,
       CASE WHEN k % 2 = 1 THEN 'Geprueft' ELSE status END AS f05,
       parameter AS f06,
       CASE WHEN k % 2 = 1 THEN k END AS f07,
       CAST(CAST(ts AS DATE) AS VARCHAR) AS f08,
       strftime(ts, '%Y-%m-%d %H:00:00') AS f09,
       CAST(dayofyear(ts) AS INTEGER) AS f10,
       CAST(abs(dayofyear(ts) - 15) AS INTEGER) AS f11,
       strftime(ts, '%Y-%m-%dT%H:%M:%S') AS f12,
       strftime(ts, '%H:%M:%S') AS f12_time,
       CAST(epoch_us(date_trunc('second', ts)) // 1000000 - 3600 AS BIGINT) AS f13,
       CAST(ts AS VARCHAR) AS f14,
       CASE WHEN k % 2 = 1 THEN status ELSE '' END AS f15,
       CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) AS f16,
       CASE parameter WHEN 'water_level_cm' THEN 'cm' ELSE '°C' END AS f19
FROM gauge"""


def mixed_ts() -> str:
    return f"""WITH {EVENTS}, w AS (
  SELECT *, CASE k % 5 WHEN 0 THEN CAST(epoch_us(ts) // 1000 AS VARCHAR) WHEN 1 THEN replace(CAST(ts AS VARCHAR), ' ', 'T')
                       WHEN 2 THEN substr(CAST(ts AS VARCHAR), 1, 16) WHEN 3 THEN substr(CAST(ts AS VARCHAR), 1, 10)
                       ELSE 'am ' || CAST(ts AS VARCHAR) END AS written FROM raw)
SELECT event_id, written,
       CAST(CASE k % 5 WHEN 0 THEN make_timestamp(epoch_us(ts) // 1000 * 1000) WHEN 1 THEN ts WHEN 2 THEN date_trunc('minute', ts)
                       WHEN 3 THEN CAST(date_trunc('day', ts) AS TIMESTAMP) END AS VARCHAR) AS ts
FROM w"""


def html_cells() -> str:
    return r"""WITH body AS (
  SELECT page_id, regexp_extract(html, '(?is)<ul(?:\s[^>]*)?>(.*?)</ul\s*>', 1) AS ul FROM pages
), items AS (
  SELECT page_id, regexp_extract_all(ul, '(?is)<li(?:\s[^>]*)?>(.*?)</li\s*>', 1) AS li FROM body
), rows_ AS (
  SELECT page_id, unnest(li) AS item, unnest(range(len(li))) AS pos FROM items
), cells AS (
  SELECT page_id, pos, regexp_extract_all(item, '(?is)<a(?:\s[^>]*)?>(.*?)</a\s*>', 1) AS a FROM rows_)
SELECT page_id, pos, len(a) AS n_cells,
       trim(regexp_replace(replace(regexp_replace(a[1], '(?s)<[^>]*>', '', 'g'), '&nbsp;', ' '), '\s+', ' ', 'g')) AS cell
FROM cells"""


def html_measurements() -> str:
    """Only whole numbers count: the first row of a page where it has one."""
    return f"""WITH {EVENTS}
SELECT event_id AS page_id, CAST(1 AS BIGINT) AS pos, CAST(date_trunc('minute', ts) AS VARCHAR) AS ts,
       CAST(floor(value) AS INTEGER) AS value
FROM raw WHERE k % 4 = 3 AND k % 8 <> 3"""


def first_valid_reading() -> str:
    return f"""WITH {EVENTS}
SELECT event_id AS page_id, CAST(CASE WHEN k % 8 = 7 THEN 1 ELSE 3 END AS BIGINT) AS pos,
       CAST(date_trunc('minute', ts) AS VARCHAR) AS ts, CASE WHEN k % 8 = 7 THEN floor(value) ELSE value END AS value
FROM raw WHERE k % 8 = 7 OR value IS NOT NULL"""


def response_class() -> str:
    return """WITH r AS (
  SELECT page_id, url, html,
         CASE WHEN page_id % 7 = 0 THEN 404 WHEN page_id % 11 = 0 THEN 403 WHEN page_id % 13 = 0 THEN 500 ELSE 200 END AS status,
         CASE page_id % 3 WHEN 0 THEN 'object' WHEN 1 THEN 'html' ELSE 'broken' END AS body,
         page_id % 5 AS kind FROM pages)
SELECT page_id,
       CASE WHEN status = 404 THEN 'not_found' WHEN status = 403 THEN 'forbidden' WHEN status <> 200 THEN 'other'
            WHEN kind = 0 THEN CASE WHEN body = 'object' THEN 'json' ELSE 'json_unparsable' END
            WHEN kind = 2 THEN 'image'
            WHEN body = 'object' THEN 'json' WHEN body = 'broken' THEN 'json_unparsable'
            ELSE 'html' END AS response_class,
       CASE WHEN status <> 200 THEN 'other' WHEN kind = 3 THEN 'feed' ELSE 'not_a_feed' END AS feed_class
FROM r"""


def feed_links() -> str:
    return """SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'Feed ' || page_id ELSE 'No title' END AS title,
       url || suffix AS href
FROM pages, (VALUES ('/rss'), ('/atom')) AS s(suffix)"""


def catalogue_values() -> str:
    return """WITH stats AS (
  SELECT l_suppkey, l_returnflag, MIN(l_extendedprice) AS lo, MAX(l_extendedprice) AS hi,
         MIN(l_quantity) AS qlo, MAX(l_quantity) AS qhi, MAX(l_discount) AS disc, MAX(l_tax) AS tax
  FROM lineitem GROUP BY l_suppkey, l_returnflag
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_returnflag) - 1 AS series_no FROM stats
), vals AS (
  SELECT l_suppkey, l_returnflag, series_no, 0 AS value_no, 'MNW' AS n, lo AS v, 'cm' AS u FROM numbered
  UNION ALL SELECT l_suppkey, l_returnflag, series_no, 1, 'MHW', hi, 'cm' FROM numbered
  UNION ALL SELECT l_suppkey, l_returnflag, series_no, 2, 'QL', qlo, 'N/A' FROM numbered
  UNION ALL SELECT l_suppkey, l_returnflag, series_no, 3, 'QH', qhi, 'N/A' FROM numbered
  UNION ALL SELECT l_suppkey, l_returnflag, series_no, 4, 'D', disc, 'N/A' FROM numbered
  UNION ALL SELECT l_suppkey, l_returnflag, series_no, 5, 'T', tax, 'N/A' FROM numbered)
SELECT CAST(s_suppkey AS VARCHAR) AS uuid, s_name AS station,
       CASE WHEN s_suppkey % 4 <> 0 THEN COALESCE(n_name, 'N/A') ELSE 'N/A' END AS water,
       CAST(series_no AS BIGINT) AS series_no,
       COALESCE('FLAG ' || l_returnflag, 'N/A') AS series, CASE WHEN series_no IS NULL THEN 'N/A' ELSE 'cm' END AS unit,
       CASE WHEN series_no IS NULL THEN 'N/A' ELSE '15' END AS interval_minutes,
       CAST(value_no AS BIGINT) AS value_no, n AS value_shortname, v AS value_number, u AS value_unit
FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN vals ON l_suppkey = s_suppkey"""


def catalogue_union() -> str:
    return """SELECT CAST(s_suppkey AS VARCHAR) AS uuid,
       CASE WHEN s_acctbal > 2000 THEN 'second ' ELSE 'first ' END || s_name AS longname
FROM supplier WHERE s_acctbal IS NOT NULL"""


def stored_raw() -> str:
    return f"""WITH {EVENTS}, {GAUGE}
SELECT {KEYS}, CAST(ts AS VARCHAR) AS ts, value, status FROM gauge"""


def stored_range(start: str, end: str) -> str:
    return f"""{stored_raw()}
WHERE parameter = 'water_level_cm' AND ts >= TIMESTAMP '{start} 00:00:00' AND ts < DATE '{end}' + INTERVAL 1 DAY"""


def stored_live() -> str:
    return f"""WITH {EVENTS}, {GAUGE}
SELECT {KEYS}, CAST(date_trunc('second', ts) AS VARCHAR) AS ts, value, 'Rohdaten' AS status,
       '2024-01-31T00:00:00' AS fetched_at
FROM gauge WHERE value IS NOT NULL"""


MERGED = f"""{EVENTS.replace("raw AS (", "events_raw AS (", 1)}, {GAUGE.replace("gauge AS (", "stored AS (", 1).replace("FROM raw", "FROM events_raw")},
{NEW.replace("FROM raw", "FROM stored")}, every_row AS (
  SELECT {KEYS}, ts, value, status, 0 AS origin, 0 AS turn FROM stored
  UNION ALL SELECT {KEYS}, ts, value, status, 1, turn FROM new
), raw AS (
  SELECT {KEYS}, ts, value, status FROM (
    SELECT *, row_number() OVER (PARTITION BY {KEYS}, ts ORDER BY origin DESC, turn DESC, value DESC NULLS LAST,
                                 status DESC) AS rn FROM every_row)
  WHERE rn = 1
)"""


def merged_store() -> str:
    return f"WITH {MERGED} SELECT {KEYS}, CAST(ts AS VARCHAR) AS ts, value, status FROM raw"


def merged_store_daily() -> str:
    return daily_rollup(MERGED)


def stream_dedup() -> str:
    return f"WITH {EVENTS} SELECT DISTINCT {KEYS}, CAST(ts AS VARCHAR) AS ts, value FROM raw"


def stream_late() -> str:
    """The first half sets the watermark, to milliseconds, for the second."""
    return f"""WITH {EVENTS}, mark AS (
  SELECT date_trunc('millisecond', MAX(ts)) - INTERVAL 7 DAYS AS w FROM raw WHERE event_id % 2 = 0
), sent AS (
  SELECT {KEYS}, ts, value, status, event_id, 1 AS run FROM raw WHERE event_id % 2 = 0
  UNION ALL SELECT {KEYS}, ts, value, status, event_id, 2 FROM raw
), placed AS (
  SELECT *, run = 2 AND date_trunc('millisecond', ts) < w AS late FROM sent, mark
)
SELECT {KEYS}, CAST(ts AS VARCHAR) AS ts, value, status,
       CASE WHEN late THEN 'late' WHEN row_number() OVER (PARTITION BY {KEYS}, ts, value, late ORDER BY run) > 1 THEN 'repeated'
            ELSE 'on_time' END AS outcome FROM placed"""


def live_stream_rejects() -> str:
    return f"""WITH {EVENTS}, {GAUGE}, lines AS (
  SELECT {KEYS}, date_trunc('second', ts) AS ts, CASE k % 10 WHEN 3 THEN 'malformed' WHEN 4 THEN 'no_station' WHEN 5 THEN 'future_ts'
         ELSE CASE WHEN value IS NULL THEN 'no_value' ELSE 'stored' END END AS outcome FROM gauge
), counted AS (
  SELECT DISTINCT outcome, {KEYS}, ts, 0 AS line FROM lines WHERE outcome = 'stored'
  UNION ALL SELECT outcome, {KEYS}, CASE WHEN outcome <> 'malformed' THEN ts END, row_number() OVER () FROM lines WHERE outcome <> 'stored'
)
SELECT outcome, parameter, CAST(ts AS VARCHAR) AS ts, COUNT(*) AS n FROM counted GROUP BY outcome, parameter, ts"""
