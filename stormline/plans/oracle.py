"""SQL counterparts of the registered queries, written another way than the operators.

They run on any engine with the given tables as views and serve as the check: medians
by self-join, storms and episodes by plain windows, as-of lookups by correlated joins.
"""

from __future__ import annotations


def _ts(*names: str) -> str:
    return ", ".join(f"strftime({n}, '%Y-%m-%d %H:%M:%S') AS {n.split('.')[-1]}" for n in names)


def _dbl(*names: str) -> str:
    return ", ".join(f"CAST({n} AS DOUBLE) AS {n.split('.')[-1]}" for n in names)


READINGS = """
readings AS (
  SELECT CAST(event_id AS VARCHAR) AS id, 'G' || user_id AS sensor_id, date_trunc('hour', ts) AS occurred_on,
         CAST(CAST(value AS DECIMAL(12,2)) * 0.01 AS DECIMAL(12,4)) AS precip_in
  FROM events),
hourly AS (
  SELECT sensor_id, occurred_on AS hour, precip_in AS precip FROM readings
  QUALIFY row_number() OVER (PARTITION BY sensor_id, occurred_on ORDER BY id) = 1)"""

DENSE = """
cells AS (
  SELECT 'Q' || (user_id // 10) AS sensor_id, date_trunc('hour', ts) AS hour,
         SUM(CASE WHEN user_id // 10 = 1 AND ts >= TIMESTAMP '2024-01-09' AND ts < TIMESTAMP '2024-01-16' THEN 0
                  ELSE CAST(CAST(value AS DECIMAL(12,2)) * 0.01 AS DECIMAL(12,4)) END) AS precip
  FROM events GROUP BY ALL),
panel AS (
  SELECT s.sensor_id, h.hour, COALESCE(c.precip, 0) AS precip
  FROM (SELECT DISTINCT sensor_id FROM cells) s CROSS JOIN (SELECT DISTINCT hour FROM cells) h
  LEFT JOIN cells c ON c.sensor_id = s.sensor_id AND c.hour = h.hour)"""

REPAIRED = DENSE + """,
raw_others AS (
  SELECT p.sensor_id, p.hour, p.precip, median(CAST(o.precip AS DECIMAL(18,5))) AS others
  FROM panel p LEFT JOIN panel o ON o.hour = p.hour AND o.sensor_id <> p.sensor_id GROUP BY ALL),
zeroed AS (
  SELECT sensor_id, hour, COALESCE(precip > 3.2 AND others < 0.02, FALSE) AS spike,
         CASE WHEN precip > 3.2 AND others < 0.02 THEN 0 ELSE precip END AS precip
  FROM raw_others),
repaired AS (
  SELECT p.sensor_id, p.hour, p.precip, p.spike, median(CAST(o.precip AS DECIMAL(18,5))) AS others
  FROM zeroed p LEFT JOIN zeroed o ON o.hour = p.hour AND o.sensor_id <> p.sensor_id GROUP BY ALL)"""

ROLLING = REPAIRED + """,
rolling AS (
  SELECT sensor_id, hour, precip, SUM(precip) OVER w AS own_sum,
         SUM(CAST(others AS DECIMAL(18,5))) OVER w AS others_sum
  FROM repaired
  WINDOW w AS (PARTITION BY sensor_id ORDER BY hour
               RANGE BETWEEN INTERVAL '71 hours 59 minutes 59 seconds' PRECEDING AND CURRENT ROW)),
flags AS (
  SELECT *, COALESCE(own_sum < 0.1 AND others_sum > 2.0, FALSE) AS dead FROM rolling)"""

MASKED = ROLLING + """,
controlled AS (
  SELECT f.sensor_id, f.hour, CASE WHEN m.hour IS NULL THEN f.precip END AS precip, m.hour IS NOT NULL AS masked
  FROM flags f
  LEFT JOIN (SELECT DISTINCT a.sensor_id, a.hour FROM flags a JOIN flags b
             ON b.sensor_id = a.sensor_id AND b.dead AND b.hour >= a.hour AND b.hour < a.hour + INTERVAL 72 HOURS) m
    ON m.sensor_id = f.sensor_id AND m.hour = f.hour)"""


def _storms(source: str, name: str = "storms", gap: int = 6) -> str:
    return f"""
{name}_wet AS (
  SELECT sensor_id, hour, precip,
         CASE WHEN hour - lag(hour) OVER (PARTITION BY sensor_id ORDER BY hour) <= INTERVAL {gap} HOURS THEN 0 ELSE 1 END AS fresh
  FROM {source} WHERE precip > 0),
{name}_hours AS (
  SELECT *, SUM(fresh) OVER (PARTITION BY sensor_id ORDER BY hour) AS nth FROM {name}_wet),
{name} AS (
  SELECT sensor_id, nth, MIN(hour) AS "start", MAX(hour) AS "end", SUM(precip) AS depth, MAX(precip) AS peak
  FROM {name}_hours GROUP BY sensor_id, nth)"""


RELIABLE_STORMS = _storms("controlled") + """,
kept AS (
  SELECT s.* FROM storms s WHERE NOT EXISTS (
    SELECT 1 FROM controlled c WHERE c.sensor_id = s.sensor_id AND c.precip IS NULL
      AND c.hour BETWEEN s."start" - INTERVAL 6 HOURS AND s."end" + INTERVAL 6 HOURS))"""

def _polls(threshold: str = "l_linenumber / 2.0", coefficient: str = "l_quantity / 20") -> str:
    return f"""
polls AS (
  SELECT l_shipdate + to_hours(CAST(l_linenumber AS BIGINT)) AS poll_time_utc, l_orderkey * 10 + l_linenumber AS poll_id,
         'WB' || l_suppkey AS waterbody, 'G' || l_suppkey AS sensor_id, 'Q' || (l_suppkey // 10) AS dense_id,
         round(l_extendedprice / 100000, 4) AS rain_24h_in,
         CASE WHEN l_tax > 0 THEN {threshold} END AS wq_threshold_in, {coefficient} AS wq_coeff_a,
         CASE WHEN l_discount > 0 THEN l_discount + 0.5 END AS wq_coeff_b
  FROM lineitem),
newest AS (
  SELECT * FROM polls QUALIFY row_number() OVER (PARTITION BY waterbody ORDER BY poll_time_utc DESC, poll_id DESC) = 1),
params AS (
  SELECT * FROM newest WHERE wq_threshold_in IS NOT NULL AND wq_coeff_a IS NOT NULL AND wq_coeff_b IS NOT NULL)"""


POLLS = _polls()


def _episodes(storms: str = "storms", gauge: str = "sensor_id") -> str:
    return f"""
advisories AS (
  SELECT p.waterbody, s."start", s."end", s.depth, s.peak,
         CAST(ceil(p.wq_coeff_a * pow(CAST(s.depth AS DOUBLE), p.wq_coeff_b)) AS BIGINT) AS hours
  FROM {storms} s JOIN params p ON p.{gauge} = s.sensor_id
  WHERE s.depth >= CAST(p.wq_threshold_in AS DECIMAL(18,4)) AND s.peak >= 0.05),
until AS (SELECT *, "end" + to_hours(hours) AS until FROM advisories),
marked AS (
  SELECT *, CASE WHEN "start" <= MAX(until) OVER (PARTITION BY waterbody ORDER BY "start", until
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM until),
numbered AS (
  SELECT *, SUM(fresh) OVER (PARTITION BY waterbody ORDER BY "start", until ROWS UNBOUNDED PRECEDING) AS nth FROM marked),
episodes AS (
  SELECT waterbody, MIN("start") AS "start", MAX(until) AS until,
         epoch(MAX(until) - MIN("start")) / 3600 AS dur_hr FROM numbered GROUP BY waterbody, nth)"""


EPISODES = ",".join([READINGS, _storms("hourly"), POLLS, _episodes()])
# Thresholds of a tenth per line and coefficients as they stand, under which far more storms trigger.
LOW_EPISODES = ",".join([READINGS, _storms("hourly"), _polls("l_linenumber / 10.0", "l_quantity"), _episodes()])


def _summary(reliable: str, gauge: str) -> str:
    return f"""
burden AS (
  SELECT waterbody, COUNT(*) AS n, SUM(dur_hr) AS hours, median(dur_hr) AS mid FROM episodes GROUP BY waterbody),
dry AS (SELECT sensor_id, COUNT(precip) AS reliable_hours FROM {reliable} GROUP BY sensor_id),
summary AS (
  SELECT p.waterbody, p.{gauge} AS gauge, CAST(p.wq_threshold_in AS DOUBLE) AS threshold_in,
         CAST(format('{{:.1f}}', COALESCE(b.n, 0) / (d.reliable_hours / 8766)) AS DOUBLE) AS episodes_per_yr,
         CAST(format('{{:.0f}}', COALESCE(b.hours, 0) / (d.reliable_hours / 8766)) AS BIGINT) AS adv_hours_per_yr,
         CAST(format('{{:.1f}}', 100 * COALESCE(b.hours, 0) / d.reliable_hours) AS DOUBLE) AS pct_time,
         CAST(format('{{:.0f}}', CAST(COALESCE(b.mid, 0) AS DOUBLE)) AS BIGINT) AS median_dur_hr
  FROM params p JOIN dry d ON d.sensor_id = p.{gauge} LEFT JOIN burden b ON b.waterbody = p.waterbody)"""


ADVISORY_LOG = """
advisory_log AS (
  SELECT ts AS poll_time_utc, event_id AS poll_id,
         CASE WHEN event_type IN ('view', 'click', 'purchase') THEN 'CSO' ELSE 'WQ' END AS advisory_type,
         'WB' || user_id AS waterbody, CAST(user_id AS VARCHAR) AS wb_api_id,
         ['SA', 'SB', 'SB(WW)', 'SC', 'I', 'SD', 'XX'][CAST(user_id % 7 + 1 AS INTEGER)] AS wb_class,
         'G' || user_id AS rain_gauge, date_trunc('hour', ts) AS occurred_on,
         CASE WHEN event_type = 'error' THEN 0.0 ELSE value / 4 END AS duration_hr,
         CASE WHEN event_type = 'purchase' THEN 0.0 ELSE value END AS volume
  FROM events)"""

CSO_OBS = ADVISORY_LOG + """,
obs AS (
  SELECT waterbody, occurred_on, volume FROM advisory_log WHERE advisory_type = 'CSO' AND volume > 0
  QUALIFY row_number() OVER (PARTITION BY waterbody, occurred_on ORDER BY poll_time_utc, poll_id) = 1)"""

STATES = ",".join([READINGS, POLLS, CSO_OBS, _storms("hourly", gap=4)]) + """,
placed AS (
  SELECT o.*, n.sensor_id FROM obs o JOIN newest n ON n.waterbody = o.waterbody
  WHERE n.sensor_id IN (SELECT sensor_id FROM hourly)),
states AS (
  SELECT p.waterbody, p.occurred_on, p.volume, CAST(COALESCE(SUM(h.precip), 0) AS DOUBLE) AS depth,
         CAST(COALESCE(MAX(h.precip), 0) AS DOUBLE) AS peak
  FROM placed p LEFT JOIN storms_hours h ON h.sensor_id = p.sensor_id AND h.hour <= p.occurred_on
    AND h.nth = (SELECT MAX(x.nth) FROM storms_hours x WHERE x.sensor_id = p.sensor_id AND x.hour <= p.occurred_on)
  GROUP BY p.waterbody, p.occurred_on, p.volume)"""



def _orthogonal(columns: int = 6) -> str:
    """Columns made orthogonal one after the other inside each fit; what is left of y is the residual.

    A column that depends on those before it is passed over.
    """
    steps, last = [], "points"
    for k in range(1, columns + 1):
        later = [f"x{j}" for j in range(k + 1, columns + 1)] + ["y"]
        sums = ", ".join(f"SUM(x{k} * {c}) OVER fit AS s_{c}" for c in later)
        taken = ", ".join(f"CASE WHEN size > 1e-11 * n THEN {c} - x{k} * s_{c} / size ELSE {c} END AS {c}" for c in later)
        steps.append(f"""
summed{k} AS (SELECT *, SUM(x{k} * x{k}) OVER fit AS size, {sums} FROM {last} WINDOW fit AS (PARTITION BY waterbody, shape)),
left{k} AS (SELECT waterbody, shape, n, volume, {taken} FROM summed{k})""")
        last = f"left{k}"
    return ",".join(steps) + f", residuals AS (SELECT * FROM {last})"


REFIT = STATES + """,
spread AS (
  SELECT *, COUNT(*) OVER g AS n, MIN(depth) OVER g AS d0, MAX(depth) OVER g AS d1, MIN(peak) OVER g AS k0, MAX(peak) OVER g AS k1
  FROM states WINDOW g AS (PARTITION BY waterbody)),
scaled AS (
  SELECT waterbody, n, volume, CASE WHEN d1 > d0 THEN 2 * (depth - d0) / (d1 - d0) - 1 ELSE 0 END AS d,
         CASE WHEN k1 > k0 THEN 2 * (peak - k0) / (k1 - k0) - 1 ELSE 0 END AS k FROM spread WHERE n >= 7),
points AS (
  SELECT waterbody, 'quadratic_depth_peak' AS shape, n, volume, volume AS y,
         1.0::DOUBLE AS x1, d AS x2, d * d AS x3, k AS x4, k * k AS x5, d * k AS x6 FROM scaled
  UNION ALL
  SELECT waterbody, 'poly5_depth', n, volume, volume, 1.0, d, d ** 2, d ** 3, d ** 4, d ** 5 FROM scaled),""" + _orthogonal()

CURVES = """
curves AS (
  SELECT 'WB' || s_suppkey AS waterbody, s_nationkey * 0.5 AS a, s_acctbal / 1000 AS b, s_acctbal / -5000 AS c,
         1.5 AS d, (s_nationkey % 4) * 0.25 AS e, -0.125 AS f FROM supplier WHERE s_nationkey % 6 <> 0)"""

PREDICTIONS = STATES + "," + CURVES + """,
predicted AS (
  SELECT s.*, c.a + c.b * depth + c.c * depth ** 2 + CAST(c.d AS DOUBLE) * peak + c.e * peak ** 2
           + CAST(c.f AS DOUBLE) * depth * peak AS q,
         c.a + c.b * depth + c.c * depth ** 2 + CAST(c.d AS DOUBLE) * depth ** 3 + c.e * depth ** 4
           + CAST(c.f AS DOUBLE) * depth ** 5 AS p
  FROM states s JOIN curves c ON c.waterbody = s.waterbody)"""

DRIFT = """
ends AS (
  SELECT l_suppkey AS wbid, CASE WHEN l_returnflag = 'A' THEN 1.0 ELSE 0.0 END AS a,
         CASE WHEN l_linestatus = 'O' THEN 1.0 ELSE 0.0 END AS b, CASE WHEN l_discount > 0.05 THEN 1.0 ELSE 0.0 END AS c,
         CASE WHEN l_tax > 0.04 THEN 1.0 ELSE 0.0 END AS d, CASE WHEN l_quantity <= 25 THEN 0.0 END AS e, 0.0 AS f,
         row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber) AS up,
         row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC) AS down
  FROM lineitem),
drift AS (
  SELECT o.wbid, (o.a, o.b, o.c, o.d, o.e, o.f) IS DISTINCT FROM (n.a, n.b, n.c, n.d, n.e, n.f) AS changed,
         o.a AS a_old, n.a AS a_new, o.b AS b_old, n.b AS b_new, o.c AS c_old, n.c AS c_new,
         o.d AS d_old, n.d AS d_new, o.e AS e_old, n.e AS e_new, o.f AS f_old, n.f AS f_new
  FROM ends o JOIN ends n ON n.wbid = o.wbid AND n.down = 1 WHERE o.up = 1)"""

KEYED = """
keyed AS (
  SELECT CASE WHEN event_type <> 'error' THEN CAST(event_id AS VARCHAR)
              ELSE 'G' || user_id || '-' || strftime(ts, '%Y-%m-%dT%H:%M:%S') END AS id,
         'G' || user_id AS sensor_id, ts AS occurred_on,
         CAST(CAST(value AS DECIMAL(12,2)) * 0.01 AS DECIMAL(12,4)) AS precip_in FROM events),
history AS (SELECT * FROM keyed WHERE occurred_on < TIMESTAMP '2024-01-16'),
batch AS (
  SELECT id, sensor_id, occurred_on, precip_in + 1 AS precip_in FROM keyed WHERE occurred_on >= TIMESTAMP '2024-01-10'
  UNION ALL
  SELECT id, sensor_id, occurred_on, precip_in + 2 FROM keyed WHERE occurred_on >= TIMESTAMP '2024-01-10'),
fresh AS (
  SELECT * FROM batch b WHERE NOT EXISTS (SELECT 1 FROM history h WHERE h.id = b.id)
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY occurred_on, precip_in) = 1)"""

COMPLETENESS = KEYED + """,
users AS (
  SELECT 'G' || user_id AS sensor_id, MAX(value) > 250 AS was_complete,
         COUNT(*) FILTER (event_type = 'signup') >= 14 AS ended FROM events GROUP BY user_id),
marks AS (
  SELECT h.sensor_id, bool_or(u.was_complete OR u.ended) AS complete, COUNT(*) AS records, MAX(occurred_on) AS latest
  FROM (SELECT * FROM history UNION ALL SELECT * FROM fresh) h JOIN users u ON u.sensor_id = h.sensor_id GROUP BY h.sensor_id)"""

FILINGS = """
orders_at AS (
  SELECT *, TIMESTAMP '2024-01-01' + to_days(CAST(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) % 400 AS INTEGER))
            + to_hours(o_orderkey % 24) + to_minutes(o_orderkey % 60) AS begun,
         o_orderkey % 40 + 1 AS n, CAST(floor(o_totalprice) AS BIGINT) % 7 AS kind,
         CASE WHEN o_custkey % 10 = 0 THEN 'NYCdep Plant ' ELSE 'Plant ' END || o_custkey AS plant
  FROM orders),
placed_sheets AS (
  SELECT *, CASE o_orderpriority WHEN '1-URGENT' THEN '2021-01' WHEN '2-HIGH' THEN '2022-01' WHEN '3-MEDIUM' THEN '2023-01'
                 WHEN '4-NOT SPECIFIED' THEN '2024-01' WHEN '5-LOW' THEN '2025-01' END AS sheet, plant AS facility,
         CAST(o_orderkey AS VARCHAR) AS incident_id, o_orderkey * 7919 % 100003 AS row_no FROM orders_at
  UNION ALL
  SELECT *, '2021-12 cumulative', ' ' || upper(plant) || ' ', CAST(o_orderkey AS VARCHAR), o_orderkey * 7919 % 100003
  FROM orders_at WHERE o_orderpriority = '1-URGENT'
  UNION ALL
  SELECT *, '2022-01', plant, '0' || o_orderkey, o_orderkey * 7919 % 100003 + 200000 FROM orders_at
  WHERE o_orderpriority = '2-HIGH' AND o_custkey % 3 = 0),
filings AS (
  SELECT sheet, facility, incident_id, row_no, 'Creek ' || (o_custkey % 100) AS waterbody, begun,
         CASE WHEN sheet LIKE '2021%' THEN strftime(begun, '%m/%d/%Y %H:%M:%S')
              WHEN sheet = '2022-01' THEN chr(9) || strftime(begun, '%-m/%-d/%Y %-H:%M') || chr(9) || chr(10)
              WHEN sheet = '2023-01' THEN strftime(begun, '%Y-%m-%d %H:%M:%S')
              WHEN sheet = '2024-01' THEN strftime(begun, '%B %-d, %Y')
              WHEN o_orderstatus = 'F' THEN strftime(begun, '%Y%m%d')
              WHEN o_orderstatus = 'O' THEN strftime(begun, '%-m/%-d/%Y') ELSE ' ' END AS "start",
         CASE kind WHEN 0 THEN n || ' Hours' WHEN 1 THEN n || ' Minutes' WHEN 2 THEN n || ' Days' WHEN 3 THEN CAST(n AS VARCHAR)
                   WHEN 4 THEN 'unknown' WHEN 5 THEN '2.5 hrs' ELSE n || ' Weeks' END
           || CASE WHEN sheet = '2022-01' THEN chr(160) ELSE '' END AS duration,
         round(CASE kind WHEN 0 THEN n WHEN 1 THEN n / 60 WHEN 2 THEN n * 24 WHEN 3 THEN n WHEN 5 THEN 2.5 END, 6) AS duration_hours,
         ['Rain Event', 'CSO overflow', 'Pipe Break,Pipe Break', NULL][CAST(o_orderkey % 4 + 1 AS INTEGER)] AS reason,
         ['Kings ', 'QUEENS', 'Erie', 'Albany', 'Monroe'][CAST(o_custkey % 5 + 1 AS INTEGER)]
           || CASE WHEN sheet = '2022-01' THEN chr(9) ELSE '' END AS county,
         CASE WHEN sheet NOT IN ('2024-01', '2025-01') THEN 'City' END AS city
  FROM placed_sheets),
dated AS (
  SELECT *, try_strptime(trim("start", ' ' || chr(9) || chr(10)), ['%m/%d/%Y %H:%M:%S', '%m/%d/%Y %H:%M', '%Y-%m-%d %H:%M:%S', '%B %d, %Y', '%Y%m%d', '%m/%d/%Y']) AS start_dt
  FROM filings),
cleaned AS (
  SELECT *, COALESCE(lower(trim(county, ' ' || chr(9))) IN ('kings', 'queens'), FALSE) OR lower(facility) LIKE '%nycdep%' AS city_row
  FROM dated WHERE start_dt IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY lower(trim(facility)), start_dt, lower(trim(waterbody)),
                             lower(trim(duration, ' ' || chr(160))) ORDER BY sheet DESC, row_no DESC, incident_id DESC) = 1),
wet_filings AS (
  SELECT * FROM cleaned WHERE city_row AND (lower(reason) LIKE '%rain%' OR lower(reason) LIKE '%cso%'))"""

CROSS = EPISODES + "," + FILINGS

ONSETS = CROSS + """,
onset_hours AS (SELECT DISTINCT "start" AS t FROM episodes),
onset_marked AS (
  SELECT t, CASE WHEN t - lag(t) OVER (ORDER BY t) <= INTERVAL 1 HOUR THEN 0 ELSE 1 END AS fresh FROM onset_hours),
onset_numbered AS (SELECT t, SUM(fresh) OVER (ORDER BY t) AS nth FROM onset_marked),
clusters AS (
  SELECT MIN(n.t) AS cluster_start, MAX(n.t) AS cluster_end, COUNT(*) AS onsets, COUNT(DISTINCT e.waterbody) AS waterbodies
  FROM onset_numbered n JOIN episodes e ON e."start" = n.t GROUP BY n.nth),
matched AS (
  SELECT c.*, EXISTS (SELECT 1 FROM wet_filings f WHERE f.start_dt BETWEEN c.cluster_start - INTERVAL 2 HOURS
                                                          AND c.cluster_end + INTERVAL 2 HOURS) AS has_filing
  FROM clusters c)"""

ACTIVE = 'EXISTS (SELECT 1 FROM episodes e WHERE f.start_dt BETWEEN e."start" AND e.until)'
NEAR = ("EXISTS (SELECT 1 FROM episodes e WHERE f.start_dt BETWEEN e.\"start\" - INTERVAL 24 HOURS "
        "AND e.\"start\" + INTERVAL 24 HOURS)")

STEP = "CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END"

CONFIG_CHANGES = f"""
WITH steps AS (
  SELECT 'WB' || l_suppkey AS config_key, l_shipdate + to_hours(CAST(l_linenumber AS BIGINT)) AS poll_time_utc,
         l_orderkey * 10 + l_linenumber AS poll_id, ({STEP}) * 2 + CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END AS step FROM lineitem)
SELECT config_key, strftime(poll_time_utc, '%Y-%m-%d %H:%M:%S') AS poll_time_utc, poll_id FROM (
  SELECT *, lag(step) OVER (PARTITION BY config_key ORDER BY steps.poll_time_utc, poll_id, step) AS before FROM steps)
WHERE before IS NULL OR before <> step"""

CSO_SCORES = f"""WITH {PREDICTIONS},
centred AS (SELECT *, volume - AVG(volume) OVER () AS off FROM predicted)
SELECT COUNT(*) AS n_observations, COUNT(DISTINCT waterbody) AS n_waterbodies,
       CAST(format('{{:.4f}}', 1 - SUM((volume - q) ** 2) / SUM(off ** 2)) AS DOUBLE) AS quadratic_depth_peak_r2,
       CAST(format('{{:.4f}}', sqrt(AVG((volume - q) ** 2))) AS DOUBLE) AS quadratic_depth_peak_rmse,
       CAST(format('{{:.4f}}', 1 - SUM((volume - p) ** 2) / SUM(off ** 2)) AS DOUBLE) AS poly5_depth_r2,
       CAST(format('{{:.4f}}', sqrt(AVG((volume - p) ** 2))) AS DOUBLE) AS poly5_depth_rmse FROM centred"""

PLACES = """
outfalls AS (
  SELECT c_custkey AS outfall_id, -74.3 + (c_custkey * 7919 % 100003) / 100003 * 0.6 AS lon,
         40.5 + (c_custkey * 104729 % 100019) / 100019 * 0.4 AS lat FROM customer),
bodies AS (
  SELECT s_suppkey AS waterbody_id, -74.3 + (s_suppkey * 3571 % 100003) / 100003 * 0.6 AS lon,
         40.5 + (s_suppkey * 15485863 % 100019) / 100019 * 0.4 AS lat,
         CASE WHEN s_acctbal > 0 THEN s_acctbal ELSE 0 END AS volume FROM supplier),
pairs AS (
  SELECT o.outfall_id, b.waterbody_id, b.volume,
         2 * 6371008.8 * asin(sqrt(pow(sin(radians(b.lat - o.lat) / 2), 2)
           + cos(radians(o.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - o.lon) / 2), 2))) AS distance_m
  FROM outfalls o CROSS JOIN bodies b)"""

OUTLINES = """
outfalls AS (
  SELECT c_custkey AS outfall_id, -74.3 + (c_custkey * 7919 % 100003) / 100003 * 0.6 AS lon,
         40.5 + (c_custkey * 104729 % 100019) / 100019 * 0.4 AS lat FROM customer),
corners(k, dx, dy) AS (VALUES (0, 0, 0), (1, 4, 0), (2, 4, 3), (3, 2, 1), (4, 0, 3)),
shape_corners AS (
  SELECT s_suppkey AS waterbody_id, CASE WHEN s_acctbal > 0 THEN s_acctbal ELSE 0 END AS volume, k,
         -74.3 + (s_suppkey % 40) * 0.015 + dx * 0.003 AS lon, 40.5 + (s_suppkey // 40) * 0.012 + dy * 0.003 AS lat
  FROM supplier, corners),
edges AS (
  SELECT a.waterbody_id, a.volume, a.lon AS alon, a.lat AS alat, b.lon AS blon, b.lat AS blat
  FROM shape_corners a JOIN shape_corners b ON b.waterbody_id = a.waterbody_id AND b.k = (a.k + 1) % 5),
vectors AS (
  SELECT *, [cos(radians(alat)) * cos(radians(alon)), cos(radians(alat)) * sin(radians(alon)), sin(radians(alat))]::DOUBLE[3] AS a,
         [cos(radians(blat)) * cos(radians(blon)), cos(radians(blat)) * sin(radians(blon)), sin(radians(blat))]::DOUBLE[3] AS b FROM edges),
normals AS (
  SELECT *, array_cross_product(a, b) AS n FROM vectors),
met AS (
  SELECT outfall_id, o.lon, o.lat, e.*,
         [cos(radians(o.lat)) * cos(radians(o.lon)), cos(radians(o.lat)) * sin(radians(o.lon)), sin(radians(o.lat))]::DOUBLE[3] AS p
  FROM outfalls o CROSS JOIN normals e),
measured AS (
  SELECT outfall_id, waterbody_id, volume,
         CASE WHEN array_inner_product(array_cross_product(n, a), p) > 0 AND array_inner_product(array_cross_product(b, n), p) > 0
              THEN 6371008.8 * asin(abs(array_inner_product(p, n)) / sqrt(array_inner_product(n, n)))
              ELSE 2 * 6371008.8 * asin(sqrt(least(
                pow(sin(radians(alat - lat) / 2), 2) + cos(radians(lat)) * cos(radians(alat)) * pow(sin(radians(alon - lon) / 2), 2),
                pow(sin(radians(blat - lat) / 2), 2) + cos(radians(lat)) * cos(radians(blat)) * pow(sin(radians(blon - lon) / 2), 2))))
         END AS distance_m,
         (alat > lat) <> (blat > lat) AND lon < (blon - alon) * (lat - alat) / (blat - alat) + alon AS crossed
  FROM met),
bodies_met AS (
  SELECT outfall_id, waterbody_id, volume, COUNT(*) FILTER (crossed) % 2 = 1 AS held, MIN(distance_m) AS edge_m
  FROM measured GROUP BY outfall_id, waterbody_id, volume),
ranked AS (
  SELECT outfall_id, waterbody_id, volume, CASE WHEN held THEN 0 ELSE edge_m END AS distance_m FROM bodies_met
  QUALIFY row_number() OVER (PARTITION BY outfall_id ORDER BY edge_m, waterbody_id) = 1)"""

_CLASSES = """
classes(wb_class, label, description) AS (VALUES
  ('SA', 'Class SA', 'Best usages are shellfishing for market purposes, primary and secondary contact recreation and fishing'),
  ('SB', 'Class SB', 'Best usages are primary and secondary contact recreation and fishing'),
  ('SB(WW)', 'Class SB(WW)', 'Best usages of Class SB waters with limited suspension following qualifying rain events'),
  ('SC', 'Class SC', 'Best usage is fishing. Factors other than water quality limit recreational uses.'),
  ('I', 'Class I', 'Best usages are secondary contact recreation and fishing'),
  ('SD', 'Class SD', 'Best usage is fishing. Natural or man-made conditions limit fish propagation.'))"""

ORACLE: dict[str, str] = {
    "flatten_payload": f"""
SELECT strftime(l_shipdate + to_hours(CAST(l_linenumber AS BIGINT)), '%Y-%m-%d %H:%M:%S') AS poll_time_utc,
       'WB' || l_suppkey AS waterbody, CAST(l_suppkey AS INTEGER) AS wbid, 'G' || l_suppkey AS sensor_id,
       CAST(format('{{:.4f}}', l_extendedprice / 100000) AS DOUBLE) AS rain_24h_in, CAST({STEP} * 0.25 AS DOUBLE) AS wq_threshold_in,
       CAST({STEP} * 10 AS DOUBLE) AS wq_coeff_a, CAST(0.5 AS DOUBLE) AS wq_coeff_b, CAST(0.1 AS DOUBLE) AS cso_threshold_in,
       CAST(format('{{:.4f}}', l_extendedprice / 100000) AS DOUBLE) >= {STEP} * 0.25 AS provisional_on_advisory
FROM lineitem""",
    "flatten_sensors": """
SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS poll_time_utc, 'G' || user_id AS sensor_id, 'Gauge ' || user_id AS sensor_name,
       CASE WHEN event_type = 'error' THEN 0.0 ELSE CAST(format('{:.4f}', value / 7) AS DOUBLE) END AS rain_24h_in,
       event_type = 'click' AS active FROM events""",
    "flatten_advisories": f"""WITH {ADVISORY_LOG}
SELECT {_ts('poll_time_utc', 'occurred_on')}, advisory_type, waterbody, wb_api_id, wb_class, rain_gauge, duration_hr, volume
FROM advisory_log""",
    "unwrap_records": """
SELECT CASE WHEN event_type = 'error' THEN 'G' || user_id || '-' || strftime(ts, '%Y-%m-%dT%H:%M:%SZ')
            ELSE CAST(event_id AS VARCHAR) END AS id, 'G' || user_id AS sensor_id,
       strftime(ts, '%Y-%m-%d %H:%M:%S') AS occurred_on, value AS precip_in
FROM events WHERE event_type <> 'signup'""",
    "filings_union": f"""WITH {FILINGS}
SELECT facility, "start", duration, waterbody, reason, county, city, incident_id, sheet FROM filings""",
    "config_changes": CONFIG_CHANGES,
    "stream_config": CONFIG_CHANGES,
    "record_key": f"WITH {KEYED} SELECT DISTINCT id, sensor_id FROM keyed",
    "history_merge": f"""WITH {KEYED}
SELECT id, sensor_id, {_ts('occurred_on')}, {_dbl('precip_in')} FROM (SELECT * FROM history UNION ALL SELECT * FROM fresh)""",
    "fresh_counts": f"""WITH {KEYED}
SELECT b.sensor_id, COUNT(DISTINCT f.id) AS fresh, COUNT(DISTINCT f.id) = 0 AS caught_up
FROM batch b LEFT JOIN fresh f ON f.id = b.id GROUP BY b.sensor_id""",
    "completeness": f"""WITH {COMPLETENESS}
SELECT sensor_id, complete, records, {_ts('latest')}, '2024-01-31 00:00:00' AS updated FROM marks""",
    "backfill_order": f"""WITH {COMPLETENESS}
SELECT DISTINCT 'G' || user_id AS sensor_id, COALESCE(m.complete, FALSE) AS complete
FROM events e LEFT JOIN marks m ON m.sensor_id = 'G' || e.user_id""",
    "harvest_progress": f"""WITH {COMPLETENESS}
SELECT COUNT(*) FILTER (complete) AS complete, COUNT(*) AS gauges FROM marks""",
    "continuity_gaps": f"""WITH {READINGS}
SELECT sensor_id, {_ts('from_hour', 'to_hour')}, epoch(to_hour - from_hour) / 3600 AS step_hours FROM (
  SELECT sensor_id, hour AS to_hour, lag(hour) OVER (PARTITION BY sensor_id ORDER BY hour) AS from_hour FROM hourly)
WHERE to_hour - from_hour <> INTERVAL 1 HOUR""",
    "dedup_hours": f"WITH {READINGS} SELECT sensor_id, {_ts('hour')}, {_dbl('precip')} FROM hourly",
    "parse_timestamps": """
SELECT event_id, CASE WHEN event_type <> 'error' THEN strftime(ts, '%Y-%m-%d %H:%M:%S') END AS parsed FROM events""",
    "latest_params": f"""WITH {POLLS}
SELECT waterbody, sensor_id, {_dbl('wq_threshold_in', 'wq_coeff_a', 'wq_coeff_b')} FROM params""",
    "cso_params": f"WITH {CURVES} SELECT waterbody, {_dbl('a', 'b', 'c', 'd', 'e', 'f')} FROM curves",
    "provisional_flag": f"""WITH {POLLS}
SELECT poll_id, COALESCE(rain_24h_in >= wq_threshold_in, FALSE) AS provisional_on_advisory FROM polls""",
    "param_drift": f"""WITH {DRIFT}
SELECT wbid, changed, {", ".join(_dbl(f'{c}_old', f'{c}_new') for c in 'abcdef')} FROM drift""",
    "drift_counts": f"""WITH {DRIFT}
SELECT COUNT(*) AS waterbodies, COUNT(*) FILTER (changed) AS changed,
       COUNT(*) FILTER (a_old + b_old + c_old + d_old = 0) AS all_zero_old,
       COUNT(*) FILTER (a_new + b_new + c_new + d_new = 0) AS all_zero_new FROM drift""",
    "panel_grid": f"""WITH {READINGS}
SELECT s.sensor_id, strftime(t.hour, '%Y-%m-%d %H:%M:%S') AS hour, CAST(h.precip AS DOUBLE) AS precip
FROM (SELECT DISTINCT sensor_id FROM hourly) s CROSS JOIN (SELECT DISTINCT hour FROM hourly) t
LEFT JOIN hourly h ON h.sensor_id = s.sensor_id AND h.hour = t.hour""",
    "loo_median": f"""WITH {REPAIRED}
SELECT sensor_id, {_ts('hour')}, {_dbl('precip')}, CAST(others AS DOUBLE) AS others FROM raw_others""",
    "loo_median_sparse": f"""WITH {READINGS}
SELECT p.sensor_id, strftime(p.hour, '%Y-%m-%d %H:%M:%S') AS hour, CAST(p.precip AS DOUBLE) AS precip,
       CAST(median(CAST(o.precip AS DECIMAL(18,5))) AS DOUBLE) AS others
FROM hourly p LEFT JOIN hourly o ON o.hour = p.hour AND o.sensor_id <> p.sensor_id GROUP BY p.sensor_id, p.hour, p.precip""",
    "spike_repair": f"""WITH {REPAIRED}
SELECT sensor_id, {_ts('hour')}, {_dbl('precip')}, spike, CAST(others AS DOUBLE) AS others FROM repaired""",
    "rolling_sums": f"WITH {ROLLING} SELECT sensor_id, {_ts('hour')}, {_dbl('precip', 'own_sum', 'others_sum')} FROM rolling",
    "dead_flags": f"WITH {ROLLING} SELECT sensor_id, {_ts('hour')}, dead FROM flags",
    "dead_mask": f"""WITH {MASKED}
SELECT c.sensor_id, strftime(c.hour, '%Y-%m-%d %H:%M:%S') AS hour, CAST(c.precip AS DOUBLE) AS precip, c.masked,
       EXISTS (SELECT 1 FROM controlled n WHERE n.sensor_id = c.sensor_id AND n.precip IS NULL
               AND n.hour BETWEEN c.hour - INTERVAL 6 HOURS AND c.hour + INTERVAL 6 HOURS) AS near_null
FROM controlled c""",
    "reliable_hours": f"WITH {MASKED} SELECT sensor_id, COUNT(precip) AS reliable_hours FROM controlled GROUP BY sensor_id",
    "outage_days": f"""WITH {MASKED},
lost AS (
  SELECT sensor_id, hour, CASE WHEN hour - lag(hour) OVER (PARTITION BY sensor_id ORDER BY hour) = INTERVAL 1 HOUR
         THEN 0 ELSE 1 END AS fresh FROM controlled WHERE masked),
runs AS (
  SELECT sensor_id, nth, COUNT(*) AS hours FROM (
    SELECT *, SUM(fresh) OVER (PARTITION BY sensor_id ORDER BY hour) AS nth FROM lost) GROUP BY sensor_id, nth)
SELECT sensor_id, CAST(SUM(hours) AS BIGINT) AS masked_hours, COUNT(*) AS outages, MAX(hours) AS longest_hours,
       CAST(SUM(hours) AS DOUBLE) / 24 AS outage_days FROM runs GROUP BY sensor_id""",
    "storm_ids": f"""WITH {READINGS}, {_storms("hourly")}
SELECT sensor_id, {_ts('hour')}, {_dbl('precip')},
       strftime(MIN(hour) OVER (PARTITION BY sensor_id, nth), '%Y-%m-%d %H:%M:%S') AS storm_start FROM storms_hours""",
    "storms": f"""WITH {READINGS}, {_storms("hourly")}
SELECT sensor_id, strftime("start", '%Y-%m-%d %H:%M:%S') AS "start", strftime("end", '%Y-%m-%d %H:%M:%S') AS "end",
       {_dbl('depth', 'peak')} FROM storms""",
    "storms_reliable": f"""WITH {MASKED}, {RELIABLE_STORMS}
SELECT sensor_id, strftime("start", '%Y-%m-%d %H:%M:%S') AS "start", strftime("end", '%Y-%m-%d %H:%M:%S') AS "end",
       {_dbl('depth', 'peak')} FROM kept""",
    "triggered": f"""WITH {LOW_EPISODES}
SELECT waterbody, strftime("start", '%Y-%m-%d %H:%M:%S') AS "start", strftime("end", '%Y-%m-%d %H:%M:%S') AS "end",
       {_dbl('depth', 'peak')} FROM advisories""",
    "advisory_until": f"""WITH {LOW_EPISODES}
SELECT waterbody, strftime("start", '%Y-%m-%d %H:%M:%S') AS "start", hours, {_ts('until')} FROM until""",
    "episodes": f"""WITH {EPISODES}
SELECT waterbody, strftime("start", '%Y-%m-%d %H:%M:%S') AS "start", {_ts('until')}, dur_hr FROM episodes""",
    "waterbody_summary": f"WITH {EPISODES}, {_summary('hourly', 'sensor_id')} SELECT * FROM summary",
    "waterbody_summary_qc": f"""WITH {MASKED}, {RELIABLE_STORMS}, {POLLS}, {_episodes('kept', 'dense_id')},
{_summary('controlled', 'dense_id')} SELECT * FROM summary""",
    "burden_topk": f"""WITH {EPISODES}, {_summary('hourly', 'sensor_id')}
(SELECT 'most' AS side, waterbody, gauge, pct_time FROM summary ORDER BY pct_time DESC, waterbody LIMIT 5)
UNION ALL
(SELECT 'least' AS side, waterbody, gauge, pct_time FROM summary ORDER BY pct_time, waterbody LIMIT 5)""",
    "live_check": f"""WITH {LOW_EPISODES}, {ADVISORY_LOG},
published AS (
  SELECT waterbody, occurred_on, occurred_on + to_microseconds(CAST(duration_hr * 3600000000 AS BIGINT)) AS published_until
  FROM advisory_log WHERE advisory_type = 'WQ'
  QUALIFY row_number() OVER (PARTITION BY waterbody, occurred_on ORDER BY poll_time_utc, poll_id) = 1)
SELECT p.waterbody, {_ts('p.occurred_on', 'p.published_until')}, strftime(e.until, '%Y-%m-%d %H:%M:%S') AS episode_until,
       epoch_us(e.until - p.published_until) / 3600000000 AS diff_hr
FROM published p LEFT JOIN episodes e ON e.waterbody = p.waterbody AND p.occurred_on BETWEEN e."start" AND e.until""",
    "observed_status": f"""WITH {ADVISORY_LOG},
seen AS (SELECT DISTINCT date_trunc('day', poll_time_utc) AS day, waterbody FROM advisory_log)
SELECT strftime(s.day, '%Y-%m-%d %H:%M:%S') AS poll_time_utc, s.waterbody, k.advisory_type,
       EXISTS (SELECT 1 FROM advisory_log a WHERE date_trunc('day', a.poll_time_utc) = s.day AND a.waterbody = s.waterbody
               AND a.advisory_type = k.advisory_type AND a.duration_hr > 5) AS on_advisory
FROM seen s CROSS JOIN (VALUES ('WQ'), ('CSO')) AS k(advisory_type)""",
    "cso_obs": f"WITH {CSO_OBS} SELECT waterbody, {_ts('occurred_on')}, volume FROM obs",
    "storm_so_far": f"WITH {STATES} SELECT waterbody, {_ts('occurred_on')}, depth, peak, volume FROM states",
    "cso_predictions": f"""WITH {PREDICTIONS}
SELECT waterbody, {_ts('occurred_on')}, volume, round(q, 6) AS pred_quadratic_depth_peak, round(p, 6) AS pred_poly5_depth
FROM predicted""",
    "cso_refit": f"""WITH {REFIT},
totals AS (
  SELECT waterbody, shape, COUNT(*) AS n, SUM(y * y) AS ss_res, VAR_POP(volume) * COUNT(*) AS ss_tot FROM residuals GROUP BY waterbody, shape)
SELECT waterbody, shape, n, CASE WHEN ss_tot > 0 THEN round(1 - ss_res / ss_tot, 4) END AS r2, round(sqrt(ss_res / n), 4) AS rmse
FROM totals""",
    "cso_scores": CSO_SCORES,
    "score_log": f"SELECT s.*, r.run FROM ({CSO_SCORES}) s, (VALUES ('monday'), ('tuesday')) AS r(run)",
    "filing_dates": f"""WITH {FILINGS}
SELECT sheet, incident_id, "start", {_ts('start_dt')} FROM dated""",
    "duration_hours": f"WITH {FILINGS} SELECT sheet, incident_id, duration, duration_hours FROM filings",
    "filings_dedup": f"""WITH {FILINGS}
SELECT sheet, incident_id, facility, {_ts('start_dt')}, duration_hours FROM cleaned""",
    "nyc_subset": f"WITH {FILINGS} SELECT sheet, incident_id, facility, county FROM cleaned WHERE city_row",
    "filing_coverage": f"""WITH {FILINGS}
SELECT (SELECT COUNT(*) FROM dated) AS raw_rows, (SELECT COUNT(start_dt) FROM dated) AS dated_rows,
       (SELECT COUNT(*) FROM dated WHERE trim("start") <> '' AND start_dt IS NULL) AS unparsed_dates,
       COUNT(*) AS unique_rows, COUNT(*) FILTER (city_row) AS city_rows,
       strftime(MIN(start_dt), '%Y-%m-%d %H:%M:%S') AS first_start, strftime(MAX(start_dt), '%Y-%m-%d %H:%M:%S') AS last_start,
       round(COUNT(duration_hours) / COUNT(duration), 6) AS duration_share FROM cleaned""",
    "filing_active": f"WITH {CROSS} SELECT sheet, incident_id, {_ts('start_dt')} FROM wet_filings f WHERE {ACTIVE}",
    "filing_onset": f"WITH {CROSS} SELECT sheet, incident_id, {_ts('start_dt')} FROM wet_filings f WHERE {NEAR}",
    "filing_unmatched": f"WITH {CROSS} SELECT sheet, incident_id, {_ts('start_dt')} FROM wet_filings f WHERE NOT {ACTIVE}",
    "filing_shares": f"""WITH {CROSS},
tested AS (SELECT {ACTIVE} AS is_active, {NEAR} AS is_near FROM wet_filings f)
SELECT COUNT(*) AS filings, COUNT(*) FILTER (is_active) AS active, COUNT(*) FILTER (is_near) AS near_onset,
       round(COUNT(*) FILTER (is_active) / COUNT(*), 6) AS active_share,
       round(COUNT(*) FILTER (is_near) / COUNT(*), 6) AS near_onset_share FROM tested""",
    "onset_clusters": f"""WITH {ONSETS}
SELECT {_ts('cluster_start', 'cluster_end')}, onsets, waterbodies, has_filing FROM matched""",
    "cluster_match_rates": f"""WITH {ONSETS}
SELECT CASE WHEN waterbodies >= 10 THEN '10+' WHEN waterbodies <= 2 THEN '1-2' ELSE '3-9' END AS size, COUNT(*) AS clusters,
       COUNT(*) FILTER (has_filing) AS matched, round(COUNT(*) FILTER (has_filing) / COUNT(*), 6) AS match_rate
FROM matched GROUP BY 1""",
    "yearly_compare": f"""WITH {ONSETS},
years AS (SELECT DISTINCT year(start_dt) AS y FROM wet_filings UNION SELECT DISTINCT year("start") FROM episodes)
SELECT CAST(y AS INTEGER) AS year, (SELECT COUNT(*) FROM wet_filings WHERE year(start_dt) = y) AS filings,
       (SELECT COUNT(*) FROM episodes WHERE year("start") = y) AS onsets,
       (SELECT COUNT(*) FROM clusters WHERE year(cluster_start) = y) AS clusters FROM years""",
    "stream_storms": f"""WITH {READINGS}, {_storms("hourly")}
SELECT sensor_id, strftime("start", '%Y-%m-%d %H:%M:%S') AS "start", strftime("end", '%Y-%m-%d %H:%M:%S') AS "end",
       {_dbl('depth', 'peak')} FROM storms""",
    "stream_history": f"""WITH {KEYED}
SELECT id, sensor_id, {_ts('occurred_on')}, {_dbl('precip_in')} FROM (
  SELECT * FROM history QUALIFY row_number() OVER (PARTITION BY id ORDER BY occurred_on, precip_in) = 1
  UNION ALL SELECT * FROM fresh)""",
    "stream_status": f"""WITH {ADVISORY_LOG}
SELECT waterbody, advisory_type, {_ts('poll_time_utc', 'occurred_on')}, poll_id, duration_hr FROM advisory_log
QUALIFY row_number() OVER (PARTITION BY waterbody, advisory_type ORDER BY advisory_log.poll_time_utc DESC, poll_id DESC) = 1""",
    "last_samples": f"""WITH {DENSE}
SELECT sensor_id, {_ts('hour')}, {_dbl('precip')}, CAST(sample_no AS INTEGER) AS sample_no FROM (
  SELECT *, row_number() OVER (PARTITION BY sensor_id ORDER BY hour DESC) AS sample_no FROM panel) WHERE sample_no <= 96""",
    "rain_24": f"""WITH {READINGS}
SELECT sensor_id, CAST(SUM(precip) AS DOUBLE) AS rain_in, COUNT(*) AS samples FROM (
  SELECT * FROM hourly QUALIFY row_number() OVER (PARTITION BY sensor_id ORDER BY hour DESC) <= 24) GROUP BY sensor_id""",
    "advisory_status": f"""WITH {ADVISORY_LOG}
SELECT poll_id, duration_hr > 0 AS has_advisory,
       CASE WHEN duration_hr > 0 THEN strftime(occurred_on + to_hours(CAST(floor(duration_hr) AS BIGINT)), '%Y-%m-%d %H:%M:%S') END AS until
FROM advisory_log""",
    "status_list": f"""WITH {ADVISORY_LOG}
SELECT waterbody AS name, poll_id, strftime(occurred_on + to_hours(CAST(floor(duration_hr) AS BIGINT)), '%Y-%m-%d %H:%M:%S') AS until
FROM advisory_log WHERE waterbody ILIKE '%wb1%' AND duration_hr > 0""",
    "volume_class": f"""WITH {ADVISORY_LOG}
SELECT poll_id, CASE WHEN volume > 1000 THEN '>1,000 MG' WHEN volume > 500 THEN '≤1,000 MG' WHEN volume > 200 THEN '≤500 MG'
       WHEN volume > 50 THEN '≤200 MG' WHEN volume > 20 THEN '≤50 MG' WHEN volume > 5 THEN '≤20 MG' WHEN volume > 0 THEN '≤5 MG'
       ELSE 'No discharge' END AS volume_class FROM advisory_log""",
    "status_progress": f"""WITH {ADVISORY_LOG}
SELECT poll_id, round(100 * least(duration_hr, CASE advisory_type WHEN 'CSO' THEN 6 ELSE 200 END)
       / CASE advisory_type WHEN 'CSO' THEN 6 ELSE 200 END, 8) AS progress FROM advisory_log""",
    "gauge_resolve": """
WITH g AS (SELECT DISTINCT 'G' || user_id AS sensor_id, 'Gauge ' || user_id AS sensor_name FROM events),
w AS (SELECT 'WB' || s_suppkey AS waterbody, CASE s_nationkey % 3 WHEN 0 THEN 'G' || s_suppkey
             WHEN 1 THEN 'Gauge ' || s_suppkey ELSE '' END AS gauge_ref FROM supplier)
SELECT w.*, g.sensor_id FROM w LEFT JOIN g ON g.sensor_id = w.gauge_ref OR g.sensor_name = w.gauge_ref""",
    "nearest_volume": f"""WITH {PLACES}
SELECT outfall_id, waterbody_id, round(distance_m, 2) AS distance_m, volume FROM pairs
QUALIFY row_number() OVER (PARTITION BY outfall_id ORDER BY pairs.distance_m, waterbody_id) = 1""",
    "nearest_outline": f"""WITH {OUTLINES}
SELECT outfall_id, waterbody_id, round(distance_m, 2) AS distance_m, volume FROM ranked""",
    "poll_quality": f"""
WITH polls AS (
  SELECT l_shipdate + to_hours(CAST(l_linenumber AS BIGINT)) AS poll_time_utc,
         CASE (l_orderkey * 10 + l_linenumber) % 10 WHEN 1 THEN 'missing' WHEN 2 THEN 'unparsed' WHEN 3 THEN 'not a list'
              WHEN 4 THEN 'empty' WHEN 5 THEN 'partly read' WHEN 6 THEN 'partly read' ELSE 'read' END AS state FROM lineitem)
SELECT state, COUNT(*) AS polls, strftime(MIN(poll_time_utc), '%Y-%m-%d %H:%M:%S') AS first_poll,
       strftime(MAX(poll_time_utc), '%Y-%m-%d %H:%M:%S') AS last_poll FROM polls GROUP BY state""",
    "log_replay": f"""WITH {POLLS}
SELECT {_ts('poll_time_utc')}, poll_id, waterbody, wq_coeff_a, strftime(polls.poll_time_utc, '%Y-%m') AS poll_month FROM polls""",
    "history_rewrite": f"""WITH {KEYED}
SELECT id, sensor_id, {_ts('occurred_on')}, {_dbl('precip_in')} FROM (SELECT * FROM history UNION ALL SELECT * FROM fresh)""",
    "gauge_files": f"""WITH {KEYED}
SELECT id, sensor_id, {_ts('occurred_on')}, {_dbl('precip_in')} FROM (SELECT * FROM history UNION ALL SELECT * FROM fresh)""",
    "waterbody_files": f"""WITH {POLLS}
SELECT {_ts('poll_time_utc')}, waterbody, CAST(substr(waterbody, 3) AS INTEGER) AS wbid, sensor_id,
       {_dbl('wq_threshold_in', 'wq_coeff_a', 'wq_coeff_b')}, 0.1::DOUBLE AS cso_threshold_in,
       COALESCE(rain_24h_in >= wq_threshold_in, FALSE) AS provisional_on_advisory FROM polls""",
    "advisory_files": f"""WITH {ADVISORY_LOG}
SELECT {_ts('poll_time_utc', 'occurred_on')}, advisory_type, waterbody, wb_api_id, wb_class, rain_gauge, duration_hr, volume
FROM advisory_log""",
    "config_files": f"WITH {CURVES} SELECT waterbody, {_dbl('a', 'b', 'c', 'd', 'e', 'f')} FROM curves",
    "legacy_files": """
SELECT CAST(s_suppkey AS INTEGER) AS wbid, 'WB' || s_suppkey AS waterbody, CAST(s_nationkey * 0.5 AS DOUBLE) AS a,
       CAST(s_nationkey * 0.5 + 5 AS DOUBLE) AS f, s_acctbal / 1000 AS threshold_in, s_nationkey % 2 <> 0 AS manual_override,
       CASE WHEN s_nationkey % 3 <> 0 THEN strftime(TIMESTAMP '2019-01-01' + to_days(CAST(s_suppkey % 500 AS INTEGER)), '%Y-%m-%d %H:%M:%S') END AS expires,
       strftime(TIMESTAMP '2019-01-01' + to_days(CAST(s_suppkey % 500 AS INTEGER)), '%Y-%m-%d %H:%M:%S') AS created FROM supplier""",
    "stream_log": """
WITH read AS (
  SELECT l_shipdate + to_hours(CAST(l_linenumber AS BIGINT)) AS poll_time_utc, 'WB' || l_suppkey AS waterbody
  FROM lineitem WHERE (l_orderkey * 10 + l_linenumber) % 10 NOT IN (1, 2, 3, 4))
SELECT strftime(poll_time_utc, '%Y-%m') AS poll_month, waterbody, COUNT(*) AS polls,
       strftime(MAX(poll_time_utc), '%Y-%m-%d %H:%M:%S') AS last_poll FROM read GROUP BY ALL""",
    "class_lookup": f"""WITH {ADVISORY_LOG}, {_CLASSES}
SELECT a.poll_id, a.wb_class, c.label, c.description FROM advisory_log a LEFT JOIN classes c ON c.wb_class = a.wb_class""",
}
