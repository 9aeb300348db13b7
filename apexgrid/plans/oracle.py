"""The queries of :mod:`apexgrid.plans.queries` as plain SQL over the test tables, in DuckDB's dialect."""

from __future__ import annotations

from apexgrid.plans import queries

NAN = "CAST('NaN' AS DOUBLE)"


def rounded(expression: str, name: str | None = None, bits: int = 20) -> str:
    """Nearest multiple of ``2^-bits``, without negative zero."""
    text = f"ROUND(({expression}) * {2**bits}e0) / {2**bits}e0 + 0.0e0"
    return f"{text} AS {name or expression}"


BASE = {
    "ev": "SELECT *, CAST(FLOOR(user_id / 10.0) AS BIGINT) AS session_id FROM events",
    "samples": """
        SELECT session_id, event_type AS channel,
          CASE event_type WHEN 'view' THEN 20 WHEN 'click' THEN 10 WHEN 'purchase' THEN 5 WHEN 'signup' THEN 2
            ELSE 1 END AS freq,
          CAST(ROW_NUMBER() OVER (PARTITION BY session_id, event_type ORDER BY event_id) - 1 AS BIGINT) AS sample_idx,
          value
        FROM ev""",
    "samples_nan": f"""
        SELECT session_id, channel, freq, sample_idx,
          CASE WHEN sample_idx % 97 = 41 THEN {NAN} ELSE value END AS value FROM samples""",
    "ticks": """
        SELECT session_id, value,
          CAST(ROW_NUMBER() OVER (PARTITION BY session_id ORDER BY event_id) - 1 AS BIGINT) AS sample_idx FROM ev""",
    "clock": """
        SELECT session_id, sample_idx, value, 15000 + 370 * (session_id % 7) AS lap_ms,
          sample_idx * 100 + 30 * (session_id % 3) AS ms FROM ticks""",
    "timing": """
        SELECT session_id, sample_idx, CAST(ms % lap_ms AS DOUBLE) / 1000.0e0 AS timer,
          CAST(FLOOR(ms / CAST(lap_ms AS DOUBLE)) AS BIGINT) AS lap_no,
          36.56e0 + 0.010e0 * SIN(2 * PI() * (ms % lap_ms) / lap_ms) + 1e-6 * value AS lat,
          -79.20e0 + 0.014e0 * COS(2 * PI() * (ms % lap_ms) / lap_ms) + 1e-6 * value AS lon,
          lap_ms
        FROM clock""",
    "vehicle": """
        SELECT session_id, sample_idx, 10 AS freq, value AS GPS_Speed,
          value * 1.02e0 AS WheelSpeed_FL, value * 1.01e0 AS WheelSpeed_FR,
          value + 0.5e0 * (sample_idx % 5) AS WheelSpeed_RL, value - 0.25e0 * (sample_idx % 3) AS WheelSpeed_RR,
          ((sample_idx % 21) - 10) / 10.0e0 AS G_Force_Long, ((sample_idx % 31) - 15) / 10.0e0 AS G_Force_Lat,
          ((sample_idx % 17) - 8) / 4.0e0 AS Yaw_Rate, ((sample_idx % 41) - 20) * 1.5e0 AS Steering_Angle,
          CAST(sample_idx % 101 AS DOUBLE) AS Throttle_Pos
        FROM clock""",
    "pairs": f"""
        SELECT session_id, sample_idx, CASE WHEN sample_idx % 97 = 41 THEN {NAN} ELSE value - 100.0e0 END AS a,
          CASE WHEN sample_idx % 89 = 13 THEN {NAN} ELSE ((sample_idx % 21) - 10) / 4.0e0 END AS b
        FROM clock""",
    # laps from timer resets
    "resets": """
        SELECT session_id, sample_idx, timer,
          LAG(timer) OVER (PARTITION BY session_id ORDER BY sample_idx) AS prev,
          COUNT(*) OVER (PARTITION BY session_id) AS n FROM timing""",
    "bounds": """
        SELECT session_id, n, GREATEST(sample_idx / 10.0e0 - timer, 0.0e0) AS b,
          ROW_NUMBER() OVER (PARTITION BY session_id ORDER BY sample_idx) AS k,
          COUNT(*) OVER (PARTITION BY session_id) AS nb
        FROM resets WHERE prev - timer > 1.0e0""",
    "laps": """
        SELECT session_id, 0 AS number, 'Out Lap' AS name, 0.0e0 AS start_time, b AS end_time FROM bounds WHERE k = 1
        UNION ALL
        SELECT session_id, CAST(k AS INTEGER), CASE WHEN k = nb THEN 'In Lap' ELSE 'Lap ' || k END, b,
          CASE WHEN k = nb THEN n / 10.0e0 ELSE LEAD(b) OVER (PARTITION BY session_id ORDER BY k) END FROM bounds""",
    # laps from lap-number changes
    "changes": """
        SELECT session_id, sample_idx, lap_no,
          LAG(lap_no) OVER (PARTITION BY session_id ORDER BY sample_idx) AS prev,
          COUNT(*) OVER (PARTITION BY session_id) AS n FROM timing""",
    "nbounds": """
        SELECT session_id, n, sample_idx / 10.0e0 AS b,
          ROW_NUMBER() OVER (PARTITION BY session_id ORDER BY sample_idx) AS k,
          COUNT(*) OVER (PARTITION BY session_id) AS nb
        FROM changes WHERE prev <> lap_no""",
    "nlaps": """
        SELECT session_id, 0 AS number, 'Out Lap' AS name, 0.0e0 AS start_time, b AS end_time FROM nbounds WHERE k = 1
        UNION ALL
        SELECT session_id, CAST(k AS INTEGER), CASE WHEN k = nb THEN 'In Lap' ELSE 'Lap ' || k END, b,
          CASE WHEN k = nb THEN n / 10.0e0 ELSE LEAD(b) OVER (PARTITION BY session_id ORDER BY k) END FROM nbounds
        UNION ALL
        SELECT session_id, 1, 'Lap 1', 0.0e0, COUNT(*) / 10.0e0 FROM timing
        WHERE session_id NOT IN (SELECT session_id FROM nbounds) GROUP BY session_id""",
    "lapped": """
        SELECT s.session_id, s.channel, s.sample_idx, s.value, l.number, l.name
        FROM samples s JOIN laps l ON s.session_id = l.session_id
          AND s.sample_idx >= FLOOR(l.start_time * s.freq) AND s.sample_idx < CEIL(l.end_time * s.freq)""",
    # grids
    "facts": """
        SELECT session_id, channel, MAX(freq) AS freq, COUNT(*) AS n, ARG_MAX(value, sample_idx) AS last_value
        FROM samples GROUP BY ALL""",
    "grid": """
        SELECT session_id, out_freq, duration, CAST(CEIL(duration * out_freq) AS BIGINT) AS out_len
        FROM (SELECT session_id, MAX(freq) AS out_freq, MAX(n / CAST(freq AS DOUBLE)) AS duration
              FROM facts GROUP BY 1) d""",
    "slots": """
        SELECT session_id, out_freq, UNNEST(RANGE(out_len)) AS out_idx FROM grid""",
    # GPS track
    "means": "SELECT session_id, AVG(lat) AS mlat, AVG(lon) AS mlon FROM timing GROUP BY 1",
    "track": """
        SELECT t.session_id, sample_idx, sample_idx / 10.0e0 AS time,
          (lon - mlon) * COS(RADIANS(mlat)) AS x, lat - mlat AS y
        FROM timing t JOIN means m ON t.session_id = m.session_id""",
    "ends": "SELECT session_id, COUNT(*) AS n FROM timing GROUP BY 1",
    "probes": "SELECT session_id, number AS probe_id, start_time * 1.25e0 + 0.037e0 AS t FROM laps",
    "pos_probes": """
        SELECT session_id, probe_id, SIN(session_id + probe_id * 1.6e0) * 0.012e0 AS px,
          COS(session_id + probe_id * 1.6e0) * 0.009e0 AS py
        FROM (SELECT DISTINCT session_id FROM ev) s, (VALUES (0), (1), (2), (3)) AS k(probe_id)""",
    "nearest": """
        SELECT session_id, probe_id, sample_idx, d FROM (
          SELECT p.session_id, p.probe_id, t.sample_idx, (t.x - p.px) * (t.x - p.px) + (t.y - p.py) * (t.y - p.py) AS d,
            ROW_NUMBER() OVER (PARTITION BY p.session_id, p.probe_id
              ORDER BY (t.x - p.px) * (t.x - p.px) + (t.y - p.py) * (t.y - p.py), t.sample_idx) AS rn
          FROM pos_probes p JOIN track t ON p.session_id = t.session_id) q WHERE rn = 1""",
    "sector_defs": """
        SELECT * FROM (VALUES (0, 'S1', 0, 50), (1, 'S2', 50, 100), (2, 'S3', 100, 149))
          AS v(sector_no, sector, start_index, end_index)""",
    "goals": "SELECT UNNEST([0, 50, 75, 100, 149, 1000000000]) AS p",
    "crossings": """
        SELECT session_id, number, p, time FROM (
          SELECT l.session_id, l.number, g.p, t.time,
            ROW_NUMBER() OVER (PARTITION BY l.session_id, l.number, g.p ORDER BY
              (t.x - COALESCE(o.x, 0)) * (t.x - COALESCE(o.x, 0)) + (t.y - COALESCE(o.y, 0)) * (t.y - COALESCE(o.y, 0)),
              t.sample_idx) AS rn
          FROM laps l CROSS JOIN goals g
          LEFT JOIN track o ON o.session_id = l.session_id AND o.sample_idx = g.p
          JOIN track t ON t.session_id = l.session_id
            AND t.sample_idx >= FLOOR(l.start_time * 10) AND t.sample_idx < CEIL(l.end_time * 10)) q
        WHERE rn = 1""",
    "stimes": """
        SELECT l.session_id, l.number, l.name AS lap, d.sector_no, d.sector,
          GREATEST(0.0e0, LEAST(l.end_time - l.start_time, COALESCE(
            CASE WHEN e.time > s.time THEN e.time - s.time ELSE (l.end_time - l.start_time) - (s.time - e.time) END,
            l.end_time - l.start_time))) AS time_secs
        FROM laps l CROSS JOIN sector_defs d
        LEFT JOIN crossings s ON s.session_id = l.session_id AND s.number = l.number AND s.p = d.start_index
        LEFT JOIN crossings e ON e.session_id = l.session_id AND e.number = l.number AND e.p = d.end_index""",
    # catalogue with logger names
    "chans": """
        SELECT session_id, CAST(ROW_NUMBER() OVER (PARTITION BY session_id ORDER BY first_event) - 1 AS INTEGER) AS channel_index,
          CASE event_type WHEN 'view' THEN 'GPS Speed' WHEN 'click' THEN 'Engine.RPM' WHEN 'purchase' THEN 'GPS_Latitude'
            WHEN 'signup' THEN 'GPS Long' WHEN 'error' THEN 'Lap_Number' ELSE '' END AS channel,
          CASE event_type WHEN 'view' THEN 'km/h' WHEN 'click' THEN 'rpm' WHEN 'purchase' THEN 'deg'
            WHEN 'signup' THEN 'deg' ELSE '' END AS unit
        FROM (SELECT session_id, event_type, MIN(event_id) AS first_event FROM ev GROUP BY 1, 2) f""",
    "named": "SELECT *, REPLACE(REPLACE(LOWER(channel), '.', ' '), '_', ' ') AS norm FROM chans",
    "defs": """
        SELECT CAST(n_regionkey AS BIGINT) AS session_id, c_custkey AS def_id, c_mktsegment, n_name
        FROM customer JOIN nation ON c_nationkey = n_nationkey""",
}


def _initcap(column: str) -> str:
    return f"UPPER(SUBSTRING({column}, 1, 1)) || LOWER(SUBSTRING({column}, 2))"


def _with(body: str) -> str:
    """The query with the base tables it mentions, directly or not."""
    needed: set[str] = set()
    todo = [body]
    while todo:
        words = set(_words(todo.pop()))
        for name in BASE:
            if name in words and name not in needed:
                needed.add(name)
                todo.append(BASE[name])
    ctes = ",\n".join(f"{name} AS ({BASE[name].strip()})" for name in BASE if name in needed)
    body = body.strip()
    if ctes and body.startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}" if ctes else body


def _words(text: str) -> list[str]:
    return "".join(c if c.isalnum() or c == "_" else " " for c in text).split()


STATS = ", ".join(
    rounded(f"{f}(value)", f"{name}_value")
    for f, name in [("MIN", "min"), ("MAX", "max"), ("AVG", "avg"), ("STDDEV_POP", "std")]
)


def _decimated(source: str, width: int) -> str:
    """Bucket bounds as truncated multiples of n / width, raw points up to twice the width."""
    return f"""
      SELECT session_id, channel, b AS bucket, {rounded("time")}, mn AS min, mx AS max FROM (
        SELECT session_id, channel, b, MAX((st + (s + e) // 2) / CAST(freq AS DOUBLE)) AS time,
          CASE WHEN ISNAN(ARG_MIN(value, pos)) THEN {NAN} ELSE MIN(CASE WHEN NOT ISNAN(value) THEN value END) END AS mn,
          CASE WHEN ISNAN(ARG_MIN(value, pos)) THEN {NAN} ELSE MAX(CASE WHEN NOT ISNAN(value) THEN value END) END AS mx
        FROM (
          SELECT p.session_id, p.channel, p.freq, p.value, p.pos, p.st, q.b, q.s, q.e
          FROM (SELECT *, sample_idx - st AS pos FROM (
                  SELECT *, MIN(sample_idx) OVER (PARTITION BY session_id, channel) AS st FROM {source} z) y) p
          JOIN (
            SELECT session_id, channel, b, CAST(TRUNC(b * (CAST(n AS DOUBLE) / {width})) AS BIGINT) AS s,
              LEAST(CAST(TRUNC((b + 1) * (CAST(n AS DOUBLE) / {width})) AS BIGINT), n) AS e
            FROM (SELECT session_id, channel, COUNT(*) AS n FROM {source} z GROUP BY 1, 2) c, RANGE({width}) AS w(b)
            WHERE n > 2 * {width}
            UNION ALL
            SELECT session_id, channel, b, b AS s, b + 1 AS e FROM (
              SELECT session_id, channel, UNNEST(RANGE(n)) AS b
              FROM (SELECT session_id, channel, COUNT(*) AS n FROM {source} z GROUP BY 1, 2) c WHERE n <= 2 * {width}) u
          ) q ON p.session_id = q.session_id AND p.channel = q.channel AND p.pos >= q.s AND p.pos < q.e) j
        GROUP BY session_id, channel, b) k"""


def _linear(source: str) -> str:
    return f"""
      SELECT session_id, channel, out_idx, out_freq, {rounded("v", "value")} FROM (
        SELECT f.session_id, f.channel, g.out_idx, g.out_freq,
          CASE WHEN f.freq = g.out_freq AND f.n = gr.out_len THEN a.value
            WHEN g.lo + 1 >= f.n THEN z.value
            ELSE a.value * (1.0e0 - g.frac) + b.value * g.frac END AS v
        FROM facts f JOIN grid gr ON gr.session_id = f.session_id
        JOIN (SELECT s.session_id, c.freq, s.out_freq, s.out_idx,
                CAST(FLOOR(s.out_idx * (c.freq / CAST(s.out_freq AS DOUBLE))) AS BIGINT) AS lo,
                s.out_idx * (c.freq / CAST(s.out_freq AS DOUBLE))
                  - FLOOR(s.out_idx * (c.freq / CAST(s.out_freq AS DOUBLE))) AS frac
              FROM slots s, (SELECT DISTINCT freq FROM facts) c) g
          ON g.session_id = f.session_id AND g.freq = f.freq
        LEFT JOIN {source} a ON a.session_id = f.session_id AND a.channel = f.channel AND a.sample_idx = g.lo
        LEFT JOIN {source} b ON b.session_id = f.session_id AND b.channel = f.channel AND b.sample_idx = g.lo + 1
        JOIN {source} z ON z.session_id = f.session_id AND z.channel = f.channel AND z.sample_idx = f.n - 1) q"""


def _nearest(rows: str) -> str:
    return f"""
      SELECT q.session_id, q.channel, q.out_idx, q.out_freq, {rounded("s.value", "value")} FROM (
        SELECT f.session_id, f.channel, g.out_freq, g.out_idx,
          LEAST(CASE WHEN f.freq = g.out_freq THEN g.out_idx
            ELSE CAST(ROUND(g.out_idx * (1.0e0 / g.out_freq) * f.freq) AS BIGINT) END, f.n - 1) AS k
        FROM facts f JOIN ({rows}) g ON g.session_id = f.session_id) q
      JOIN samples s ON s.session_id = q.session_id AND s.channel = q.channel AND s.sample_idx = q.k"""


def _scalars(columns: dict[str, str]) -> str:
    return "SELECT session_id, sample_idx, " + ", ".join(rounded(e, n) for n, e in columns.items()) + " FROM pairs"


def _cmp(op: str, a: str, b: str) -> str:
    return f"CASE WHEN NOT ISNAN({a}) AND NOT ISNAN({b}) AND {a} {op} {b} THEN 1.0e0 ELSE 0.0e0 END"


def _true(x: str) -> str:
    return f"({x} <> 0 AND NOT ISNAN({x}))"


def _log(x: str) -> str:
    return f"CASE WHEN ISNAN({x}) OR {x} < 0 THEN {NAN} WHEN {x} = 0 THEN CAST('-inf' AS DOUBLE) ELSE LN({x}) END"


def _domain(f: str, x: str) -> str:
    return f"CASE WHEN ISNAN({x}) OR ABS({x}) > 1 THEN {NAN} ELSE {f}({x}) END"


def _min(a: str, b: str) -> str:
    return f"CASE WHEN ISNAN({a}) THEN {b} WHEN ISNAN({b}) THEN {a} ELSE LEAST({a}, {b}) END"


def _max(a: str, b: str) -> str:
    return f"CASE WHEN ISNAN({a}) THEN {b} WHEN ISNAN({b}) THEN {a} ELSE GREATEST({a}, {b}) END"


def _clamp(v: str, lo: str, hi: str) -> str:
    return f"CASE WHEN ISNAN({v}) THEN {v} ELSE GREATEST({lo}, LEAST({v}, {hi})) END"


DIV = f"CASE WHEN b = 0 THEN {NAN} ELSE a / b END"
MOD = f"CASE WHEN b = 0 THEN {NAN} ELSE a % b END"
NEQ = "CASE WHEN ISNAN(b) OR b <> 0.5e0 THEN 1.0e0 ELSE 0.0e0 END"
AND = f"CASE WHEN {_true('a')} AND {_true('b')} THEN 1.0e0 ELSE 0.0e0 END"
GATE = f"CASE WHEN b <> 0 THEN a ELSE {NAN} END"
IF_THEN = "CASE WHEN b <> 0 THEN a ELSE -1.0e0 END"
FLOOR = "CASE WHEN ISNAN(b) THEN b ELSE FLOOR(b) END"

_RUN = "PARTITION BY session_id, channel ORDER BY sample_idx"


def _smoothed(value: str, rows: int, over: str) -> str:
    """Average of the last rows; NaN from the first gap on."""
    return (
        f"CASE WHEN MAX(CASE WHEN ISNAN({value}) THEN 1 ELSE 0 END) OVER ({over}) = 1 THEN {NAN} "
        f"ELSE AVG(CASE WHEN ISNAN({value}) THEN 0 ELSE {value} END) OVER ({over} ROWS {rows - 1} PRECEDING) END"
    )


def _slope(value: str, freq: str, over: str) -> str:
    lag, lead = f"LAG({value}) OVER ({over})", f"LEAD({value}) OVER ({over})"
    return (
        f"CASE WHEN {lag} IS NULL AND {lead} IS NULL THEN 0.0e0 WHEN {lag} IS NULL THEN ({lead} - {value}) * {freq} "
        f"WHEN {lead} IS NULL THEN ({value} - {lag}) * {freq} ELSE ({lead} - {lag}) * {freq} / 2.0e0 END"
    )


def _area(value: str, freq: str, over: str) -> str:
    return f"COALESCE((LAG({value}) OVER ({over}) + {value}) * 0.5e0 * (1.0e0 / {freq}), 0.0e0)"


def _hsv(hue: str) -> dict[str, str]:
    """Components of a fully saturated colour in single precision."""
    h = f"CAST(CAST({hue} AS DOUBLE) / 60 AS FLOAT)"
    x = f"CAST(1 - CAST(ABS(CAST(CAST({h} AS DOUBLE) % 2 AS FLOAT) - 1) AS FLOAT) AS FLOAT)"
    part = f"CAST(TRUNC(CAST({x} * 255 AS FLOAT)) AS INTEGER)"
    # values of each component in the six sextants of the colour circle
    sextants = {
        "r": ["255", part, "0", "0", part, "255"],
        "g": [part, "255", "255", part, "0", "0"],
        "b": ["0", "0", part, "255", "255", part],
    }
    return {
        name: "CASE " + " ".join(f"WHEN {h} < {k + 1} THEN {v}" for k, v in enumerate(values[:5])) + f" ELSE {values[5]} END"
        for name, values in sextants.items()
    }


def _tick(order: str = "sample_idx") -> str:
    return f"PARTITION BY session_id ORDER BY {order}"


def _template(expression: str) -> str:
    return f"SELECT session_id, sample_idx, {rounded(expression, 'value')} FROM vehicle"


def _oracles() -> dict[str, str]:
    at10 = "CAST(10 AS DOUBLE)"
    visible = (
        "(SELECT session_id, 'speed' AS channel, 10 AS freq, sample_idx, value FROM clock "
        "WHERE sample_idx BETWEEN 50 AND 600)"
    )
    overview = (
        "(SELECT s.session_id, c.channel, s.freq, s.sample_idx, s.value FROM samples s JOIN ("
        "SELECT session_id, ARG_MIN(channel, CASE WHEN norm LIKE '%speed%' OR norm LIKE '%rpm%' THEN channel_index "
        "ELSE channel_index + 100 END) AS channel FROM named GROUP BY 1) c ON c.session_id = s.session_id "
        "AND c.channel = CASE s.channel WHEN 'view' THEN 'GPS Speed' WHEN 'click' THEN 'Engine.RPM' "
        "WHEN 'purchase' THEN 'GPS_Latitude' WHEN 'signup' THEN 'GPS Long' ELSE 'Lap_Number' END)"
    )
    known = "CASE WHEN NOT ISNAN(value) THEN value END"
    seeded = "ISNAN(ARG_MIN(value, sample_idx))"
    legend = _hsv("CAST(CAST(1.0e0 - CAST(CAST(step / 59.0e0 AS FLOAT) AS DOUBLE) AS FLOAT) * CAST(240 AS DOUBLE) AS FLOAT)")
    colour = _hsv("CAST((1.0e0 - share) * 240 AS FLOAT)")
    lat = f"CASE WHEN sample_idx % 53 IN (0, 1, 7) THEN {NAN} ELSE lat END"
    lon = f"CASE WHEN sample_idx % 41 = 5 THEN {NAN} ELSE lon END"
    lap_columns = f"session_id, number, name, {rounded('start_time')}, {rounded('end_time')}"
    ref_rows = "(VALUES " + ", ".join(
        f"('{r}')"
        for r in ["GPS Speed", "gps_speed", "Engine_RPM", "Revs", "rEVS", "GPS_Long", "Velocity", "Oil_Temp", "lap number"]
    ) + ") AS r(ref)"
    alias_rows = (
        "(VALUES ('Revs', 'Engine.RPM'), ('Velocity', 'GPS Speed'), ('Oil Temp', 'Missing'), "
        "('lap number', 'Lap_Number')) AS a(alias, target)"
    )
    out = {
        "lap_report": f"""
          SELECT session_id, channel, CAST(NULL AS INTEGER) AS lap_number, 'All' AS lap, {STATS}
          FROM samples GROUP BY session_id, channel
          UNION ALL
          SELECT session_id, channel, number, name, {STATS} FROM lapped GROUP BY session_id, channel, number, name""",
        "laps_from_timer": f"SELECT {lap_columns} FROM laps",
        "laps_from_number": f"SELECT {lap_columns} FROM nlaps",
        "laps_preferred": f"""
          SELECT {lap_columns} FROM laps WHERE session_id IN (SELECT session_id FROM clock WHERE lap_ms < 16000)
          UNION ALL
          SELECT {lap_columns} FROM nlaps WHERE session_id NOT IN (
            SELECT session_id FROM laps WHERE session_id IN (SELECT session_id FROM clock WHERE lap_ms < 16000))""",
        "lap_list": f"""
          SELECT {lap_columns}, {rounded("end_time - start_time", "duration")},
            CASE WHEN end_time - start_time >= 60 THEN
              CAST(FLOOR((end_time - start_time) / 60) AS BIGINT) || ':'
              || PRINTF('%06.3f', (end_time - start_time) - FLOOR((end_time - start_time) / 60) * 60)
            ELSE PRINTF('%.3f', end_time - start_time) END AS duration_text FROM laps""",
        "lap_samples": "SELECT session_id, channel, sample_idx, number, name FROM lapped",
        "lap_selection": """
          SELECT session_id, channel, COUNT(*) AS n_samples FROM lapped WHERE number = 1 GROUP BY 1, 2""",
        "channel_summary": f"""
          SELECT session_id, channel, MAX(freq) AS freq, COUNT(*) AS n_samples,
            {rounded(f"CASE WHEN {seeded} THEN {NAN} ELSE MIN({known}) END", "min_value")},
            {rounded(f"CASE WHEN {seeded} THEN {NAN} ELSE MAX({known}) END", "max_value")},
            {rounded(f"CASE WHEN MAX(CASE WHEN ISNAN(value) THEN 1 ELSE 0 END) = 1 THEN {NAN} ELSE AVG({known}) END", "mean_value")}
          FROM samples_nan GROUP BY session_id, channel""",
        "channel_stats": f"SELECT session_id, channel, {STATS} FROM samples_nan WHERE NOT ISNAN(value) GROUP BY 1, 2",
        "rate_counts": "SELECT freq, COUNT(*) AS n_channels FROM facts GROUP BY freq",
        "session_duration": f"""
          SELECT session_id, {rounded("MAX(n / CAST(freq AS DOUBLE))", "duration")}, COUNT(*) AS n_channels
          FROM facts GROUP BY session_id""",
        "session_summary": f"""
          SELECT h.session_id, h.device_serial, 'Driver ' || h.device_serial AS driver, 'Venue ' || (h.last_event % 7) AS venue,
            {rounded("d.duration", "duration")}, d.n_channels, COALESCE(l.n_laps, 0) AS n_laps
          FROM (SELECT session_id, MIN(user_id) AS device_serial, MAX(event_id) AS last_event FROM ev GROUP BY 1) h
          JOIN (SELECT session_id, MAX(n / CAST(freq AS DOUBLE)) AS duration, COUNT(*) AS n_channels FROM facts GROUP BY 1) d
            ON d.session_id = h.session_id
          LEFT JOIN (SELECT session_id, COUNT(*) AS n_laps FROM laps GROUP BY 1) l ON l.session_id = h.session_id""",
        "value_range": """
          SELECT session_id, channel, MIN(value) AS vmin, MAX(value) AS vmax
          FROM samples_nan WHERE NOT ISNAN(value) GROUP BY 1, 2""",
        "display_range": f"""
          SELECT session_id, {rounded("lo - pad", "y_min")}, {rounded("hi + pad", "y_max")} FROM (
            SELECT session_id, lo, hi, CASE WHEN ABS(hi - lo) < 1e-10 THEN 1.0e0 ELSE (hi - lo) * 0.05e0 END AS pad
            FROM (SELECT session_id, MIN(value) AS lo, MAX(value) AS hi FROM samples_nan WHERE NOT ISNAN(value) GROUP BY 1) a) b""",
        "minmax_decimate": _decimated("samples", 17),
        "minmax_decimate_gaps": _decimated("samples_nan", 23),
        "time_window": """
          SELECT session_id, channel, freq, sample_idx, value FROM samples
          WHERE sample_idx >= CAST(TRUNC(1.05e0 * freq) AS BIGINT) AND sample_idx <= CAST(TRUNC(30.0e0 * freq) AS BIGINT)""",
        "chart_line": f"""
          SELECT session_id, channel, bucket, time, {rounded("(min + max) / 2.0e0", "value")} FROM ({_decimated(visible, 120)}) d""",
        "overview_waveform": f"""
          SELECT session_id, channel, bucket, time, {rounded("(min - lo) / (hi - lo)", "low")}, {rounded("(max - lo) / (hi - lo)", "high")}
          FROM (SELECT *, MIN(min) OVER (PARTITION BY session_id) AS lo, MAX(max) OVER (PARTITION BY session_id) AS hi
                FROM ({_decimated(overview, 40)}) d) w WHERE ABS(hi - lo) >= 1e-10""",
        "resample_linear": _linear("samples"),
        "resample_linear_gaps": _linear("samples_nan"),
        "resample_nearest": _nearest("SELECT session_id, out_freq, out_idx FROM slots"),
        "resample_nearest_window": _nearest(
            "SELECT session_id, out_freq, UNNEST(RANGE(CAST(FLOOR(1.03e0 * out_freq) AS BIGINT), "
            "CAST(CEIL(9.98e0 * out_freq) AS BIGINT))) AS out_idx FROM grid"
        ),
        "output_rates": f"SELECT session_id, out_freq, {rounded('duration')}, out_len FROM grid",
        "math_arith": _scalars(
            {
                "r_number": "42.0e0",
                "r_neg": "-a",
                "r_add": "a + b",
                "r_sub": "a - b",
                "r_mul": "a * b",
                "r_div": DIV,
                "r_mod": MOD,
            }
        ),
        "math_compare_logic": _scalars(
            {
                "r_gt": _cmp(">", "a", "b"),
                "r_lt": _cmp("<", "a", "b"),
                "r_gte": _cmp(">=", "a", "b"),
                "r_lte": _cmp("<=", "a", "b"),
                "r_eq": _cmp("=", "b", "0.5e0"),
                "r_neq": NEQ,
                "r_and": AND,
                "r_or": f"CASE WHEN {_true('a')} OR {_true('b')} THEN 1.0e0 ELSE 0.0e0 END",
                "r_not": _cmp("=", "b", "0.0e0"),
            }
        ),
        "math_functions": _scalars(
            {
                "r_abs": "ABS(a)",
                "r_sqrt": f"CASE WHEN ISNAN(a) OR a < 0 THEN {NAN} ELSE SQRT(a) END",
                "r_sin": "SIN(a)",
                "r_cos": "COS(a)",
                "r_tan": "TAN(b)",
                "r_asin": _domain("ASIN", "b"),
                "r_acos": _domain("ACOS", "b"),
                "r_atan": "ATAN(a)",
                "r_log": _log("b"),
                "r_ln": _log("a"),
                "r_exp": "EXP(b)",
                "r_floor": FLOOR,
                "r_ceil": "CASE WHEN ISNAN(b) THEN b ELSE CEIL(b) END",
                "r_round": "CASE WHEN ISNAN(b) THEN b ELSE ROUND(b) END",
                "r_atan2": "ATAN2(a, b)",
                "r_pow": "POW(ABS(a) / 100.0e0, b)",
                "r_min": _min("a", "b"),
                "r_max": _max("a", "b"),
            }
        ),
        "math_gate": _scalars(
            {
                "r_gate": GATE,
                "r_if": IF_THEN,
                "r_clamp": _clamp("a", "-50.0e0", "75.5e0"),
                "r_clamp_by": _clamp("a", f"({_min('b', '0.0e0')})", f"({_max('b', '10.0e0')})"),
            }
        ),
        "unit_conversions": _scalars(
            {
                "r_kmh_to_mph": "a * 0.621371e0",
                "r_mph_to_kmh": "a * 1.60934e0",
                "r_c_to_f": "a * 9.0e0 / 5.0e0 + 32.0e0",
                "r_f_to_c": "(a - 32.0e0) * 5.0e0 / 9.0e0",
                "r_kpa_to_psi": "a * 0.145038e0",
                "r_psi_to_kpa": "a * 6.89476e0",
                "r_bar_to_psi": "a * 14.5038e0",
                "r_psi_to_bar": "a / 14.5038e0",
                "r_deg_to_rad": "RADIANS(a)",
                "r_rad_to_deg": "DEGREES(a)",
                "r_kg_to_lb": "a * 2.20462e0",
                "r_lb_to_kg": "a * 0.453592e0",
                "r_m_to_ft": "a * 3.28084e0",
                "r_ft_to_m": "a * 0.3048e0",
                "r_nm_to_lbft": "a * 0.737562e0",
                "r_lbft_to_nm": "a * 1.35582e0",
            }
        ),
        "math_sql_functions": _scalars(
            {
                "r_div": DIV,
                "r_mod": MOD,
                "r_gt": _cmp(">", "a", "b"),
                "r_neq": NEQ,
                "r_and": AND,
                "r_not": _cmp("=", "b", "0.0e0"),
                "r_log": _log("b"),
                "r_floor": FLOOR,
                "r_min": _min("a", "b"),
                "r_max": _max("a", "b"),
                "r_gate": GATE,
                "r_if": IF_THEN,
                "r_clamp": _clamp("a", "-50.0e0", "75.5e0"),
                "r_c_to_f": "a * 9.0e0 / 5.0e0 + 32.0e0",
            }
        ),
        "display_formats": """
          SELECT session_id, sample_idx,
            CASE WHEN secs >= 60 THEN CAST(FLOOR(secs / 60) AS BIGINT) || ':' || PRINTF('%06.3f', secs - FLOOR(secs / 60) * 60)
              ELSE PRINTF('%.3f', secs) END AS duration_text,
            PRINTF('%.1f', value) AS one_decimal,
            CASE WHEN v <> 0 AND ABS(v) < 0.01e0 THEN PRINTF('%12s', REGEXP_REPLACE(PRINTF('%.4e', v), 'e([+-])0*(\\d+)$', 'e\\1\\2'))
              ELSE PRINTF('%12.4f', v) END AS value_text
          FROM (SELECT session_id, sample_idx, value, ms / 1000.0e0 + value / 1000.0e0 AS secs, value - 250.0e0 AS v FROM clock) c""",
        "series_smooth": f"""
          SELECT session_id, channel, sample_idx, {rounded(_smoothed("value", 5, _RUN), "result")} FROM samples_nan""",
        "series_derivative": f"""
          SELECT session_id, channel, sample_idx, {rounded(_slope("value", "freq", _RUN), "result")} FROM samples_nan""",
        "series_integrate": f"""
          SELECT session_id, channel, sample_idx,
            {rounded(f"CASE WHEN MAX(CASE WHEN ISNAN(area) THEN 1 ELSE 0 END) OVER ({_RUN}) = 1 THEN {NAN} "
                f"ELSE SUM(CASE WHEN ISNAN(area) THEN 0 ELSE area END) OVER ({_RUN}) END", "result")}
          FROM (SELECT *, {_area("value", "freq", _RUN)} AS area FROM samples_nan) q""",
        "series_smooth_wide": f"""
          SELECT session_id, sample_idx, {rounded(f"AVG(value) OVER ({_tick()} ROWS 99 PRECEDING)", "result")} FROM clock""",
        "series_smooth_by_channel": f"""
          SELECT session_id, sample_idx, {rounded(f"AVG(GPS_Speed) OVER ({_tick()} ROWS 6 PRECEDING)", "result")} FROM vehicle""",
        "series_nested": f"""
          SELECT session_id, sample_idx, {rounded(f"ABS({_slope('m', at10, _tick())})", "result")}
          FROM (SELECT session_id, sample_idx, AVG(GPS_Speed) OVER ({_tick()} ROWS 4 PRECEDING) AS m FROM vehicle) q""",
        "template_pitch_angle": _template("DEGREES(ATAN2(G_Force_Long, 9.81e0))"),
        "template_roll_angle": _template("DEGREES(ATAN2(G_Force_Lat, 9.81e0))"),
        "template_total_g_force": _template("SQRT(POW(G_Force_Lat, 2) + POW(G_Force_Long, 2))"),
        "template_oversteer_angle": _template(
            "DEGREES(ATAN2(Yaw_Rate * 2.5e0, GREATEST(GPS_Speed, 1.0e0))) - Steering_Angle"
        ),
        "template_steering_rate": _template(_slope("Steering_Angle", at10, _tick())),
        "template_throttle_smoothed": _template(f"AVG(Throttle_Pos) OVER ({_tick()} ROWS 9 PRECEDING)"),
        "template_speed_delta": _template(_slope("GPS_Speed", at10, _tick())),
        "template_distance": f"""
          SELECT session_id, sample_idx, {rounded(f"SUM(area) OVER ({_tick()})", "value")}
          FROM (SELECT session_id, sample_idx, {_area("(GPS_Speed / 3.6e0)", at10, _tick())} AS area FROM vehicle) q""",
        "computed_mixed_rates": f"""
          SELECT v.session_id, 'Spread' AS channel, v.out_freq AS freq, v.out_idx AS sample_idx,
            {rounded("(v.x - p.x) * 2", "value")}
          FROM two v JOIN two p ON p.session_id = v.session_id AND p.out_idx = v.out_idx
          WHERE v.channel = 'view' AND p.channel = 'purchase'""",
        "computed_chain": f"""
          SELECT session_id, 'Doubled' AS channel, freq, sample_idx, {rounded("value * 2", "value")} FROM samples WHERE channel = 'click'
          UNION ALL
          SELECT session_id, 'Slope', freq, sample_idx, {rounded(_slope("(value * 2)", "freq", _RUN), "value")}
          FROM samples WHERE channel = 'click'""",
        "computed_errors": """
          SELECT session_id, name, message FROM (SELECT DISTINCT session_id FROM samples) s, (VALUES
            ('Broken', 'no channel is named ''Oil Temp'''),
            ('Loop A', 'no channel is named ''Loop B'''),
            ('Loop B', 'no channel is named ''Loop A'''),
            ('Constant', 'none of its channels has samples')) AS e(name, message)""",
        "computed_shared": f"""
          SELECT session_id, 'Same' AS channel, freq, sample_idx, 0.0e0 AS value FROM samples WHERE channel = 'view'
          UNION ALL
          SELECT session_id, 'Plus', freq, sample_idx, {rounded("value + 1", "value")} FROM samples WHERE channel = 'signup'
          UNION ALL
          SELECT session_id, 'Mix', out_freq, out_idx, {rounded("x", "value")} FROM click_purchase
          UNION ALL
          SELECT session_id, m.name, out_freq, out_idx, {rounded("a * m.factor", "value")}
          FROM (SELECT *, AVG(x) OVER (PARTITION BY session_id ORDER BY out_idx ROWS 3 PRECEDING) AS a FROM click_purchase),
            (VALUES ('Mean', 1), ('Mean Twice', 2)) AS m(name, factor)""",
        "computed_faults": """
          SELECT session_id, name, message FROM (SELECT DISTINCT session_id FROM samples) s, (VALUES
            ('Bad', 'sin takes 1 argument(s), not 2'), ('Gone', 'no channel is named ''nothing''')) AS e(name, message)""",
        "configured_channels": f"""
          WITH v AS (SELECT * FROM samples WHERE channel = CASE session_id % 3 WHEN 0 THEN 'view' WHEN 1 THEN 'click' END),
          m AS (SELECT * FROM samples WHERE session_id % 3 = 0 AND channel = 'view' OR session_id % 6 = 5 AND channel = 'purchase')
          SELECT session_id, 'Twice' AS channel, freq, sample_idx, {rounded("value * 2", "value")} FROM v
          UNION ALL SELECT session_id, 'Slope', freq, sample_idx, {rounded("value * 6 + 1", "value")} FROM v WHERE session_id % 3 = 0
          UNION ALL SELECT session_id, 'Slope', freq, sample_idx, {rounded("value - 1", "value")} FROM samples
            WHERE channel = 'click' AND (session_id % 3 = 1 OR session_id % 6 = 5)
          UNION ALL SELECT session_id, 'Mean', freq, sample_idx,
            {rounded("AVG(value) OVER (PARTITION BY session_id ORDER BY sample_idx ROWS 3 PRECEDING)", "value")} FROM m""",
        "configured_faults": """
          SELECT session_id, name, message FROM (SELECT DISTINCT session_id FROM samples) s, (VALUES
            (1, 'Round', 'no channel is named ''Turn'''), (1, 'Turn', 'no channel is named ''Round'''), (2, 'Bad', 'sin takes 1 argument(s), not 2'),
            (2, 'Twice', 'none of its channels has samples')) AS e(kind, name, message) WHERE session_id % 3 = kind
          UNION ALL SELECT DISTINCT session_id, 'Slope', 'more than one channel is defined under this name' FROM samples WHERE session_id % 6 = 2""",
        "computed_stats": f"""
          SELECT session_id, 'Twice' AS channel, {rounded("MIN(value * 2)", "min_value")}, {rounded("MAX(value * 2)", "max_value")},
            {rounded("AVG(value * 2)", "avg_value")} FROM samples_nan WHERE channel = 'click' AND NOT ISNAN(value) GROUP BY 1""",
        "cursor_readout": f"""
          SELECT session_id, probe_id, {rounded("t")}, channel, {rounded("v", "value")} FROM (
            SELECT p.session_id, p.probe_id, p.t, f.channel,
              CASE WHEN p.t * f.freq >= f.n THEN f.last_value WHEN b.value IS NULL THEN a.value
                ELSE a.value * (1.0e0 - (p.t * f.freq - TRUNC(p.t * f.freq))) + b.value * (p.t * f.freq - TRUNC(p.t * f.freq)) END AS v
            FROM probes p JOIN facts f ON f.session_id = p.session_id
            LEFT JOIN samples a ON a.session_id = f.session_id AND a.channel = f.channel
              AND a.sample_idx = CAST(TRUNC(p.t * f.freq) AS BIGINT)
            LEFT JOIN samples b ON b.session_id = f.session_id AND b.channel = f.channel
              AND b.sample_idx = CAST(TRUNC(p.t * f.freq) AS BIGINT) + 1) q""",
        "track_position": f"""
          SELECT p.session_id, p.probe_id, {rounded("p.t", "t")}, k.sample_idx, {rounded("k.x", "x")}, {rounded("k.y", "y")}
          FROM probes p JOIN ends e ON e.session_id = p.session_id
          JOIN track k ON k.session_id = p.session_id AND k.sample_idx = LEAST(CAST(ROUND(p.t * 10) AS BIGINT), e.n - 1)""",
        "nearest_position": f"SELECT session_id, probe_id, sample_idx, {rounded('d', 'dist2', 32)} FROM nearest",
        "define_sectors": """
          SELECT session_id, 'S' || (pair + 1) AS name, start_index, end_index FROM (
            SELECT session_id, probe_id // 2 AS pair, MAX(CASE WHEN probe_id % 2 = 0 THEN sample_idx END) AS start_index,
              MAX(CASE WHEN probe_id % 2 = 1 THEN sample_idx END) AS end_index FROM nearest GROUP BY 1, 2) q
          WHERE start_index IS NOT NULL AND end_index IS NOT NULL""",
        "resolve_names": f"""
          SELECT session_id, ref, channel, rank FROM (
            SELECT c.session_id, w.ref, c.channel, w.rank,
              ROW_NUMBER() OVER (PARTITION BY c.session_id, w.ref ORDER BY w.rank, c.channel_index) AS rn
            FROM chans c JOIN (
              SELECT ref, 10 AS rank, 'e' AS kind, ref AS key FROM {ref_rows}
              UNION ALL SELECT ref, 20, 'e', REPLACE(ref, '_', ' ') FROM {ref_rows}
              UNION ALL SELECT ref, 30, 'e', REPLACE(ref, '_', '.') FROM {ref_rows}
              UNION ALL SELECT ref, 40, 'e', target FROM {ref_rows} JOIN {alias_rows} ON alias = ref
              UNION ALL SELECT ref, 41, 'e', target FROM {ref_rows} JOIN {alias_rows} ON alias = REPLACE(ref, '_', ' ')
              UNION ALL SELECT ref, 42, 'e', target FROM {ref_rows} JOIN {alias_rows} ON alias = REPLACE(ref, '_', '.')
              UNION ALL SELECT ref, 50, 'l', LOWER(ref) FROM {ref_rows}
              UNION ALL SELECT ref, 60, 'e', target FROM {ref_rows} JOIN {alias_rows} ON LOWER(alias) = LOWER(ref)
            ) w ON (w.kind = 'e' AND w.key = c.channel) OR (w.kind = 'l' AND w.key = LOWER(c.channel))) q
          WHERE rn = 1""",
        "alias_targets": f"""
          WITH refs AS (SELECT DISTINCT {_initcap("event_type")} AS ref FROM ev),
          al AS (SELECT DISTINCT LIST_EXTRACT(STRING_SPLIT(norm, ' '), -1) AS alias, channel AS target FROM named
                 UNION ALL SELECT DISTINCT event_type, 'Event ' || event_type FROM ev)
          SELECT ref, target FROM (
            SELECT ref, target, ROW_NUMBER() OVER (PARTITION BY ref ORDER BY rank, target) AS rn FROM (
              SELECT ref, target, 40 AS rank FROM refs JOIN al ON alias = ref
              UNION ALL SELECT ref, target, 60 FROM refs JOIN al ON LOWER(alias) = LOWER(ref)) u) q WHERE rn = 1""",
        "channel_picks": """
          SELECT session_id, ARG_MIN(channel, channel_index) AS channel, 'lap number' AS role FROM named
            WHERE norm = 'lap number' GROUP BY 1
          UNION ALL SELECT session_id, ARG_MIN(channel, channel_index), 'latitude' FROM named
            WHERE norm LIKE '%gps%' AND norm LIKE '%lat%' GROUP BY 1
          UNION ALL SELECT session_id, ARG_MIN(channel, channel_index), 'longitude' FROM named
            WHERE norm LIKE '%gps%' AND norm LIKE '%lon%' GROUP BY 1
          UNION ALL SELECT session_id, ARG_MIN(channel, CASE WHEN norm LIKE '%speed%' OR norm LIKE '%rpm%' THEN channel_index
            ELSE channel_index + 100 END), 'representative' FROM named GROUP BY 1""",
        "catalog_search": """
          SELECT session_id, channel, unit, 'physical' AS kind FROM chans
          WHERE LOWER(channel) LIKE '%deg%' OR LOWER(unit) LIKE '%deg%'
          UNION ALL SELECT session_id, 'Deg ' || channel, 'deg', 'math' FROM chans""",
        "name_conflicts": f"""
          WITH nd AS (SELECT session_id, def_id, CASE WHEN def_id % 3 = 0 THEN {_initcap("n_name")}
              ELSE {_initcap("c_mktsegment")} || ' ' || (def_id % 11) END AS name FROM defs)
          SELECT d.session_id, d.def_id, d.name, 'physical' AS conflicts_with FROM nd d WHERE EXISTS (
            SELECT 1 FROM nation n WHERE n.n_regionkey = d.session_id AND LOWER(n.n_name) = LOWER(d.name))
          UNION ALL
          SELECT d.session_id, d.def_id, d.name, 'math' FROM nd d WHERE EXISTS (
            SELECT 1 FROM nd o WHERE o.session_id = d.session_id AND LOWER(o.name) = LOWER(d.name) AND o.def_id <> d.def_id)""",
        "referenced_channels": "SELECT DISTINCT UNNEST([c_mktsegment, n_name]) AS ref FROM defs",
        "gps_track": f"""
          SELECT session_id, sample_idx, {rounded("time")}, {rounded("x")}, {rounded("y")} FROM track""",
        "gps_track_gaps": f"""
          WITH g AS (SELECT session_id, sample_idx, {lat} AS la, {lon} AS lo FROM timing),
          m AS (SELECT session_id, AVG(CASE WHEN NOT ISNAN(la) THEN la END) AS mla,
                  AVG(CASE WHEN NOT ISNAN(lo) THEN lo END) AS mlo FROM g GROUP BY 1),
          p AS (SELECT g.session_id, sample_idx,
                  CASE WHEN NOT ISNAN(la) AND NOT ISNAN(lo) THEN (lo - mlo) * COS(RADIANS(mla)) END AS x,
                  CASE WHEN NOT ISNAN(la) AND NOT ISNAN(lo) THEN la - mla END AS y
                FROM g JOIN m ON g.session_id = m.session_id)
          SELECT session_id, sample_idx, {rounded("sample_idx / 10.0e0", "time")},
            {rounded(f"COALESCE(LAST_VALUE(x IGNORE NULLS) OVER ({_tick()}), 0.0e0)", "x")},
            {rounded(f"COALESCE(LAST_VALUE(y IGNORE NULLS) OVER ({_tick()}), 0.0e0)", "y")} FROM p""",
        "track_color": f"""
          WITH pos AS (SELECT t.session_id, f.channel, t.sample_idx, f.n, f.last_value, (t.sample_idx / 10.0e0) * f.freq AS place
                       FROM timing t JOIN facts f ON f.session_id = t.session_id),
          val AS (SELECT p.session_id, p.channel, p.sample_idx, CASE WHEN b.value IS NULL THEN p.last_value
                    ELSE a.value * (1.0e0 - (place - FLOOR(place))) + b.value * (place - FLOOR(place)) END AS value
                  FROM pos p
                  LEFT JOIN samples a ON a.session_id = p.session_id AND a.channel = p.channel AND a.sample_idx = CAST(FLOOR(place) AS BIGINT)
                  LEFT JOIN samples b ON b.session_id = p.session_id AND b.channel = p.channel
                    AND b.sample_idx = CAST(FLOOR(place) AS BIGINT) + 1),
          ranged AS (SELECT *, MIN(value) OVER (PARTITION BY session_id, channel) AS vmin,
                       MAX(value) OVER (PARTITION BY session_id, channel) AS vmax FROM val),
          shared AS (SELECT *, GREATEST(0.0e0, LEAST(1.0e0, (value - vmin)
                       / CASE WHEN ABS(vmax - vmin) < 1e-10 THEN 1.0e0 ELSE vmax - vmin END)) AS share FROM ranged)
          SELECT session_id, channel, sample_idx, {rounded("value")}, {", ".join(f"{e} AS {n}" for n, e in colour.items())},
            {rounded("vmin")}, {rounded("vmax")} FROM shared""",
        "color_legend": f"""
          WITH v AS (SELECT session_id, channel, MIN(value) AS vmin, MAX(value) AS vmax FROM samples GROUP BY 1, 2)
          SELECT session_id, channel, vmin, vmax, CAST(step AS INTEGER) AS step, {rounded("vmin + (vmax - vmin) * step / 59.0e0", "value")},
            {", ".join(f"{e} AS {n}" for n, e in legend.items())}
          FROM v, RANGE(60) AS s(step)""",
        "sector_times": f"SELECT session_id, number, lap, sector_no, sector, {rounded('time_secs')} FROM stimes",
        "crossing_times": f"""
          SELECT session_id, number, {", ".join(rounded(f"MAX(CASE WHEN p = {p} THEN time END)", n)
            for p, n in [(0, "at_0"), (75, "at_75"), (1000000000, "at_beyond")])}
          FROM crossings GROUP BY 1, 2""",
        "sector_report": f"""
          WITH every AS (SELECT session_id, number, lap, sector_no, sector, time_secs FROM stimes UNION ALL
            SELECT session_id, number, lap, -1, 'Total', SUM(time_secs) FROM stimes GROUP BY 1, 2, 3),
          delta AS (SELECT e.*, b.time_secs AS ref_secs, CASE WHEN e.number <> 1 THEN e.time_secs - b.time_secs END AS delta
            FROM every e LEFT JOIN (SELECT * FROM every WHERE number = 1) b
              ON b.session_id = e.session_id AND b.sector_no = e.sector_no)
          SELECT session_id, number, lap, sector_no, sector, {rounded("time_secs")}, {rounded("ref_secs")}, {rounded("delta")},
            CASE WHEN delta < -0.01e0 THEN 'faster' WHEN delta > 0.01e0 THEN 'slower' WHEN delta IS NOT NULL THEN 'even' END
              AS delta_class FROM delta""",
    }
    out |= _source_oracles() | _extension_oracles()
    out["track_color_by_channel"] = f"SELECT * FROM ({out['track_color']}) c WHERE channel = 'click'"
    for corner in ("FL", "FR", "RL", "RR"):
        out[f"template_wheel_slip_{corner.lower()}"] = _template(
            f"(WheelSpeed_{corner} - GPS_Speed) / GREATEST(GPS_Speed, 1.0e0) * 100"
        )
    return out


def _printed(decimals: int | str) -> str:
    """A value as text; decimals may be an expression of the session."""
    if isinstance(decimals, int):
        return f"PRINTF('%.{decimals}f', s.value)"
    return f"CASE {decimals} " + " ".join(f"WHEN {d} THEN PRINTF('%.{d}f', s.value)" for d in range(4)) + " END"


def _csv(channels: dict[str, int | str], window: tuple[float, float] | None = None) -> str:
    """Nearest samples on the fastest of the chosen channels, as text."""
    names = ", ".join(f"'{c}'" for c in channels)
    first, last = ("0", "duration") if window is None else map(str, window)
    cells = ", ".join(
        f"MAX(CASE WHEN q.channel = '{c}' THEN {_printed(d)} END) AS {c}" for c, d in channels.items()
    )
    return f"""
      WITH rate AS (SELECT session_id, MAX(freq) AS out_freq, MAX(n / CAST(freq AS DOUBLE)) AS duration
                    FROM facts WHERE channel IN ({names}) GROUP BY 1),
      line AS (SELECT session_id, out_freq, UNNEST(RANGE(CAST(FLOOR(CAST({first} AS DOUBLE) * out_freq) AS BIGINT),
                 CAST(CEIL(CAST({last} AS DOUBLE) * out_freq) AS BIGINT))) AS out_idx FROM rate)
      SELECT q.session_id, q.out_idx, MAX(PRINTF('%.6f', q.out_idx * (1.0e0 / q.out_freq))) AS time_text, {cells} FROM (
        SELECT f.session_id, f.channel, g.out_freq, g.out_idx,
          LEAST(CASE WHEN f.freq = g.out_freq THEN g.out_idx
            ELSE CAST(ROUND(g.out_idx * (1.0e0 / g.out_freq) * f.freq) AS BIGINT) END, f.n - 1) AS k
        FROM facts f JOIN line g ON g.session_id = f.session_id WHERE f.channel IN ({names})) q
      JOIN samples s ON s.session_id = q.session_id AND s.channel = q.channel AND s.sample_idx = q.k
      GROUP BY q.session_id, q.out_idx"""


def _extension_oracles() -> dict[str, str]:
    # distance of every sample, with the sample after it
    driven = f"""
          WITH meters AS (SELECT session_id, sample_idx, sample_idx / 10.0e0 AS t, Throttle_Pos, Steering_Angle,
              SUM(area) OVER (PARTITION BY session_id ORDER BY sample_idx) AS d
            FROM (SELECT *, {_area("(GPS_Speed / 3.6e0)", "10", _tick())} AS area FROM vehicle) a),
          e AS (SELECT *, LEAD(d) OVER w AS dn, LEAD(t) OVER w AS tn, LEAD(Throttle_Pos) OVER w AS thn, LEAD(Steering_Angle) OVER w AS stn
            FROM meters WINDOW w AS (PARTITION BY session_id ORDER BY sample_idx))"""
    return {
        "series_forward_fill": """
          SELECT session_id, channel, freq, sample_idx, COALESCE(LAST_VALUE(good IGNORE NULLS) OVER (
            PARTITION BY session_id, channel ORDER BY sample_idx), 0.0e0) AS value
          FROM (SELECT *, CASE WHEN sample_idx % 3 <> 1 AND sample_idx % 40 >= 12 THEN value END AS good FROM samples) g""",
        "configured_report": f"""
          WITH drawn AS (SELECT session_id, no AS sector_no, name AS sector, a, b FROM (SELECT DISTINCT session_id FROM ev) s, LATERAL (VALUES
              (0, 'Start', 0, session_id % 7 + 40), (1, 'Back', session_id % 7 + 40, session_id % 5 + 90), (2, 'Far', session_id % 5 + 90, 100000)) AS v(no, name, a, b)),
          pts AS (SELECT DISTINCT session_id, UNNEST([a, b]) AS p FROM drawn),
          near AS (SELECT session_id, number, p, time FROM (
            SELECT l.session_id, l.number, g.p, t.time, ROW_NUMBER() OVER (PARTITION BY l.session_id, l.number, g.p ORDER BY
              (t.x - COALESCE(o.x, 0)) * (t.x - COALESCE(o.x, 0)) + (t.y - COALESCE(o.y, 0)) * (t.y - COALESCE(o.y, 0)), t.sample_idx) AS rn
            FROM laps l JOIN pts g ON g.session_id = l.session_id LEFT JOIN track o ON o.session_id = l.session_id AND o.sample_idx = g.p
            JOIN track t ON t.session_id = l.session_id AND t.sample_idx >= FLOOR(l.start_time * 10) AND t.sample_idx < CEIL(l.end_time * 10)) q WHERE rn = 1),
          spent AS (SELECT l.session_id, l.number, l.name AS lap, d.sector_no, d.sector, GREATEST(0.0e0, LEAST(l.end_time - l.start_time,
              CASE WHEN e.time > s.time THEN e.time - s.time ELSE (l.end_time - l.start_time) - (s.time - e.time) END)) AS time_secs
            FROM laps l JOIN drawn d ON d.session_id = l.session_id
            JOIN near s ON s.session_id = l.session_id AND s.number = l.number AND s.p = d.a
            JOIN near e ON e.session_id = l.session_id AND e.number = l.number AND e.p = d.b),
          every AS (SELECT * FROM spent UNION ALL SELECT session_id, number, lap, -1, 'Total', SUM(time_secs) FROM spent GROUP BY 1, 2, 3),
          delta AS (SELECT e.*, b.time_secs AS ref_secs, CASE WHEN e.number <> b.number THEN e.time_secs - b.time_secs END AS delta
            FROM every e LEFT JOIN every b ON b.session_id = e.session_id AND b.sector_no = e.sector_no
              AND b.session_id % 4 <> 3 AND b.number = b.session_id % 3 + 1)
          SELECT session_id, number, lap, sector_no, sector, {rounded("time_secs")}, {rounded("ref_secs")}, {rounded("delta")},
            CASE WHEN delta < -0.01e0 THEN 'faster' WHEN delta > 0.01e0 THEN 'slower' WHEN delta IS NOT NULL THEN 'even' END AS delta_class FROM delta""",
        "same_names": f"""
          WITH c AS (SELECT session_id, event_type, ROW_NUMBER() OVER (PARTITION BY session_id ORDER BY MIN(event_id)) - 1 AS k,
              CASE event_type WHEN 'purchase' THEN 'GPS_Latitude' WHEN 'signup' THEN 'GPS Long' ELSE 'Speed' END AS name FROM ev GROUP BY 1, 2),
          s AS (SELECT *, CASE WHEN k = MIN(k) OVER (PARTITION BY session_id, name) THEN name ELSE name || '#' || k END AS series FROM c)
          SELECT s.session_id, series AS channel, {rounded("MIN(value)", "min_value")}, {rounded("MAX(value)", "max_value")},
            {rounded("AVG(value)", "avg_value")}, {rounded("STDDEV_POP(value)", "std_value")}
          FROM samples x JOIN s ON s.session_id = x.session_id AND s.event_type = x.channel GROUP BY 1, 2""",
        "distance_axis": f"""{driven}
          SELECT session_id, slot, slot * 25.0e0 AS distance, {rounded("t + COALESCE((tn - t) * part, 0)", "time")},
            {rounded("Throttle_Pos + COALESCE((thn - Throttle_Pos) * part, 0)", "value")}
          FROM (SELECT *, (slot * 25.0e0 - d) / (dn - d) AS part FROM (
            SELECT *, UNNEST(RANGE(CAST(CEIL(d / 25.0e0) AS BIGINT),
              CASE WHEN dn IS NULL THEN CAST(FLOOR(d / 25.0e0) AS BIGINT) + 1 ELSE CAST(CEIL(dn / 25.0e0) AS BIGINT) END)) AS slot FROM e) s) p""",
        "lap_overlay": f"""{driven},
          own AS (SELECT e.*, l.number, l.name FROM e JOIN laps l ON l.session_id = e.session_id
            AND sample_idx >= FLOOR(start_time * 10) AND sample_idx < CEIL(end_time * 10)),
          extents AS (SELECT session_id, number, MIN(d) AS low, MAX(d) AS high, MAX(sample_idx) AS last, MIN(t) AS t0 FROM own GROUP BY ALL HAVING MAX(d) > MIN(d)),
          u AS (SELECT o.*, low, last, t0, (d - low) / (high - low) AS u, (dn - low) / (high - low) AS un FROM own o JOIN extents n USING (session_id, number)),
          s AS (SELECT *, UNNEST(RANGE(CAST(CEIL(u * 50) AS BIGINT),
              CASE WHEN sample_idx = last THEN CAST(FLOOR(u * 50) AS BIGINT) + 1 ELSE CAST(CEIL(un * 50) AS BIGINT) END)) AS slot FROM u),
          p AS (SELECT session_id, number, name, slot, part, t + COALESCE((tn - t) * part, 0) - t0 AS time,
              Steering_Angle + COALESCE((stn - Steering_Angle) * part, 0) AS value
            FROM (SELECT *, CASE WHEN sample_idx = last THEN 0 ELSE (slot / 50.0e0 - u) / (un - u) END AS part FROM s) q WHERE slot <= 50)
          SELECT p.session_id, p.number, p.name, p.slot, {rounded("p.time", "time")}, {rounded("p.time - r.time", "time_delta")},
            {rounded("p.value", "value")}, {rounded("r.value", "ref_value")}
          FROM p JOIN p r ON r.slot = p.slot AND r.session_id = 0 AND r.number = 1""",
        "lap_stretching": f"""
          WITH passed AS (SELECT session_id, number, MAX(CASE WHEN p = 50 THEN time END) AS a, MAX(CASE WHEN p = 100 THEN time END) AS b
            FROM crossings GROUP BY 1, 2),
          m AS (SELECT l.session_id, l.number, l.start_time AS s, l.end_time AS e, a, b FROM laps l JOIN passed USING (session_id, number)),
          c AS (SELECT m.*, r.s AS rs, r.e AS re, r.a AS ra, r.b AS rb, m.a > m.s AND r.a > r.s AND m.a < m.e AND r.a < r.e AS has_a
            FROM m JOIN m r ON r.session_id = m.session_id AND r.number = 1),
          k AS (SELECT *, b > CASE WHEN has_a THEN a ELSE s END AND rb > CASE WHEN has_a THEN ra ELSE rs END AND b < e AND rb < re AS has_b FROM c),
          g AS (SELECT k.*, t.sample_idx, t.time,
              CASE WHEN has_b AND t.time >= b THEN [b, e, rb, re] WHEN has_a AND t.time >= a THEN [a, CASE WHEN has_b THEN b ELSE e END, ra, CASE WHEN has_b THEN rb ELSE re END]
                WHEN has_a THEN [s, a, rs, ra] WHEN has_b THEN [s, b, rs, rb] ELSE [s, e, rs, re] END AS q
            FROM k JOIN track t ON t.session_id = k.session_id AND t.sample_idx >= FLOOR(s * 10) AND t.sample_idx < CEIL(e * 10)),
          w AS (SELECT *, q[3] + (time - q[1]) / (q[2] - q[1]) * (q[4] - q[3]) AS ref_time FROM g)
          SELECT session_id, number, sample_idx, {rounded("time", "time")}, {rounded("ref_time", "ref_time")},
            {rounded("(ref_time - rs) - (time - s)", "gain")} FROM w""",
        "lap_histogram": f"""
          WITH r AS (SELECT session_id, channel, MIN(value) AS lo, MAX(value) AS hi FROM samples_nan WHERE NOT ISNAN(value) GROUP BY 1, 2),
          b AS (SELECT n.session_id, n.channel, l.number, l.name AS lap, lo, hi,
              CASE WHEN hi > lo THEN LEAST(CAST(FLOOR((n.value - lo) / (hi - lo) * 12) AS INTEGER), 11) ELSE 0 END AS bin
            FROM samples_nan n JOIN lapped l USING (session_id, channel, sample_idx) JOIN r USING (session_id, channel) WHERE NOT ISNAN(n.value))
          SELECT session_id, channel, number, lap, bin, {rounded("lo + bin * ((hi - lo) / 12)", "low")},
            {rounded("lo + (bin + 1) * ((hi - lo) / 12)", "high")}, COUNT(*) AS n FROM b GROUP BY session_id, channel, number, lap, bin, lo, hi""",
        "mixture_map": f"""
          SELECT session_id, CAST(FLOOR(GPS_Speed / 25.0e0) AS BIGINT) AS x_bin, CAST(FLOOR(Throttle_Pos / 10.0e0) AS BIGINT) AS y_bin,
            {rounded("AVG(Yaw_Rate)", "z_mean")}, COUNT(*) AS n FROM vehicle GROUP BY 1, 2, 3 HAVING COUNT(*) >= 2""",
        "scatter": f"""
          WITH r AS (SELECT session_id, MIN(G_Force_Lat) AS x0, MAX(G_Force_Lat) AS x1, MIN(GPS_Speed) AS y0, MAX(GPS_Speed) AS y1 FROM vehicle GROUP BY 1),
          c AS (SELECT v.session_id, sample_idx, G_Force_Lat AS x, GPS_Speed AS y, (sample_idx * 2654435761) % 4294967296 AS h,
              LEAST(CAST(FLOOR((G_Force_Lat - x0) / (x1 - x0) * 8) AS INTEGER), 7) AS x_cell,
              LEAST(CAST(FLOOR((GPS_Speed - y0) / (y1 - y0) * 10) AS INTEGER), 9) AS y_cell FROM vehicle v JOIN r USING (session_id))
          SELECT session_id, x_cell, y_cell, ARG_MIN(sample_idx, h) AS sample_idx, {rounded("ARG_MIN(x, h)", "x")}, {rounded("ARG_MIN(y, h)", "y")},
            COUNT(*) AS n FROM c GROUP BY 1, 2, 3""",
        "power_spectrum": f"""
          WITH w AS (SELECT session_id, channel, freq, k AS win, sample_idx - k * 8 AS j, value FROM (
              SELECT *, UNNEST([sample_idx // 8, sample_idx // 8 - 1]) AS k FROM samples) q WHERE k >= 0),
          z AS (SELECT *, (value - AVG(value) OVER p) * (0.5e0 - 0.5e0 * COS(2 * PI() * j / 16)) AS x, COUNT(*) OVER p AS n
            FROM w WINDOW p AS (PARTITION BY session_id, channel, win)),
          f AS (SELECT session_id, channel, freq, win, bin, POW(SUM(x * COS(2 * PI() * bin * j / 16)), 2) + POW(SUM(x * SIN(2 * PI() * bin * j / 16)), 2) AS p
            FROM z, (SELECT UNNEST(RANGE(9)) AS bin) b WHERE n = 16 GROUP BY 1, 2, 3, 4, 5)
          SELECT session_id, channel, CAST(bin AS INTEGER) AS bin, {rounded("bin * freq / 16.0e0", "frequency")}, {rounded("AVG(p) / 6.0e0", "power")}, COUNT(*) AS windows
          FROM f GROUP BY session_id, channel, freq, bin""",
    }


def _source_oracles() -> dict[str, str]:
    part = """
          SELECT p_partkey, REPLACE(REPLACE(REPLACE(p_name || '.' || p_brand, ' ', '.'), '#', ''), '.', ' ') AS name,
            CASE p_size % 4 WHEN 0 THEN '' WHEN 1 THEN '%' ELSE SUBSTRING(p_type, 1, 1 + p_size % 3) END AS short,
            CASE WHEN p_partkey % 3 = 0 THEN LOWER(SUBSTRING(p_type, 1, 3)) ELSE '' END AS unit,
            p_partkey % 2 = 0 AS filled FROM part"""
    return {
        "scale_samples": f"""
          WITH f AS (SELECT session_id, channel, (n + session_id) % 5 AS scale, (n + session_id) % 4 - 1 AS dec_places,
                       (n + session_id) % 7 - 3 AS shift, (n + session_id) % 3 + 1 AS mul FROM facts)
          SELECT s.session_id, s.channel, s.freq, s.sample_idx, {rounded("""CASE WHEN f.scale = 0 THEN s.value
            ELSE (s.value / f.scale * POW(10.0e0, -f.dec_places) + f.shift) * f.mul END""", "value")}
          FROM samples s JOIN f ON f.session_id = s.session_id AND f.channel = s.channel""",
        "clean_names": f"""
          SELECT p_partkey, CASE WHEN joined THEN name || short ELSE name END AS name,
            CASE WHEN unit = '' OR joined THEN '' ELSE short END AS short_name,
            CASE WHEN unit <> '' THEN unit WHEN joined THEN '' ELSE short END AS unit
          FROM (SELECT *, filled AND LENGTH(short) BETWEEN 1 AND 2 AND short <> '%' AS joined FROM ({part}) p) q""",
        "csv_rows": _csv({"click": 2, "purchase": 1, "signup": 0}),
        "csv_rows_catalog": _csv(
            {"click": "GREATEST(q.session_id % 4 - 1, 0)", "signup": "CASE WHEN q.session_id % 5 > 0 THEN 2 ELSE 0 END"}
        ),
        "csv_rows_window": _csv({"purchase": 1, "error": 3}, (1.1, 7.7)),
        "sidecar_totals": """
          SELECT h.session_id || '/0' AS session_id, 'Driver ' || h.serial AS driver,
            CASE WHEN h.session_id % 3 = 0 THEN CAST(n AS INTEGER) END AS total_laps,
            CASE WHEN h.session_id % 3 = 0 THEN '1:0' || n || '.5 &amp; up' END AS fastest_time,
            CAST(NULL AS INTEGER) AS fastest_lap
          FROM (SELECT session_id, MIN(user_id) AS serial FROM ev GROUP BY 1) h
          LEFT JOIN (SELECT session_id, COUNT(*) AS n FROM laps GROUP BY 1) l ON l.session_id = h.session_id""",
        "sidecar_markers": f"""
          SELECT session_id || '/0' AS session_id, number, {rounded("start_time")},
            {rounded("end_time")}
          FROM laps WHERE session_id % 3 <> 2""",
        "sidecar_errors": """
          SELECT DISTINCT session_id || '/0.ldx' AS path, 'XML parse error' AS reason
          FROM laps l WHERE session_id % 3 = 2""",
        "config_tables": """
          SELECT c_custkey || '.json' AS path, 'definition' AS kind, c_name AS name, '"GPS Speed" * ' || c_nationkey AS detail FROM customer
          UNION ALL SELECT c_custkey || '.json', 'definition', 'Twice', 'Speed * 2' FROM customer
          UNION ALL SELECT c_custkey || '.json', 'alias', 'Seg', c_mktsegment FROM customer WHERE c_custkey % 2 = 0
          UNION ALL SELECT c_custkey || '.json', 'sector', 'S1', CAST(c_custkey AS VARCHAR) FROM customer WHERE c_custkey % 2 = 0
          UNION ALL SELECT c_custkey || '.json', 'reference', 'lap', CASE WHEN c_custkey % 2 = 0 THEN '1' ELSE 'none' END FROM customer""",
    }


def _pair(one: str, other: str) -> str:
    """Two channels interpolated on the grid they share."""
    names = f"'{one}', '{other}'"
    return f"""
        SELECT f.session_id, f.channel, g.out_idx, g.out_freq,
          CASE WHEN f.freq = g.out_freq AND f.n = g.out_len THEN a.value
            WHEN CAST(FLOOR(g.out_idx * g.ratio) AS BIGINT) + 1 >= f.n THEN f.last_value
            ELSE a.value * (1.0e0 - (g.out_idx * g.ratio - FLOOR(g.out_idx * g.ratio)))
              + b.value * (g.out_idx * g.ratio - FLOOR(g.out_idx * g.ratio)) END AS x
        FROM facts f JOIN (
          SELECT session_id, channel, out_freq, out_len, freq / CAST(out_freq AS DOUBLE) AS ratio, UNNEST(RANGE(out_len)) AS out_idx
          FROM (SELECT session_id, channel, freq, MAX(freq) OVER (PARTITION BY session_id) AS out_freq,
                  CAST(CEIL(MAX(n / CAST(freq AS DOUBLE)) OVER (PARTITION BY session_id)
                    * MAX(freq) OVER (PARTITION BY session_id)) AS BIGINT) AS out_len
                FROM facts WHERE channel IN ({names})) r) g
          ON g.session_id = f.session_id AND g.channel = f.channel
        LEFT JOIN samples a ON a.session_id = f.session_id AND a.channel = f.channel
          AND a.sample_idx = CAST(FLOOR(g.out_idx * g.ratio) AS BIGINT)
        LEFT JOIN samples b ON b.session_id = f.session_id AND b.channel = f.channel
          AND b.sample_idx = CAST(FLOOR(g.out_idx * g.ratio) AS BIGINT) + 1"""


BASE["two"] = _pair("view", "purchase")
BASE["click_purchase"] = f"""
        SELECT c.session_id, c.out_idx, c.out_freq, c.x + p.x AS x
        FROM ({_pair("click", "purchase")}) c JOIN ({_pair("click", "purchase")}) p ON p.session_id = c.session_id AND p.out_idx = c.out_idx
        WHERE c.channel = 'click' AND p.channel = 'purchase'"""


def oracle_sql() -> dict[str, str]:
    found = {name: _with(body) for name, body in _oracles().items()}
    small = queries.queries()
    return found | {name: found[name.removesuffix("_small_chunks")] for name in small if name.endswith("_small_chunks")}
