"""DuckDB statements equivalent to the registered queries.

They restate, in plain SQL over the driver's tables, the adapter of
``sources/testdata.py`` and every view the Spark side builds, so the driver
can run each query both ways.  Warehouse semantics are written out the
DuckDB way: ``date_diff`` counts boundaries, ``dayofweek`` is 0 for Sunday,
``strftime('%a')`` names the day, NULLs are ordered explicitly.
"""

from __future__ import annotations

import re

# Fixed values, written out here again so that the statements share nothing with what they
# check: role -> (key, description, rows of the code table).
CODE_DIMS = {
    "payment": ("payment_type", "payment_type_desc", [
        (1, "Credit card"), (2, "Cash"), (3, "No charge"), (4, "Dispute"), (5, "Unknown"), (6, "Voided")]),
    "vendor": ("vendor_id", "vendor_name", [
        (1, "Creative Mobile Technologies (CMT)"), (2, "VeriFone (VTS)")]),
    "rate": ("rate_code_id", "rate_code_desc", [
        (1, "Standard rate"), (2, "JFK"), (3, "Newark"), (4, "Nassau/Westchester"),
        (5, "Negotiated fare"), (6, "Group ride")]),
}


def _secs_after(ts: str, secs: str) -> str:
    return f"({ts} + to_seconds(CAST({secs} AS BIGINT)))"


def _d(x) -> str:
    return f"CAST({x} AS DOUBLE)"


_PRICE = "(l_extendedprice / 100)"
_PICKUP_Y = _secs_after("l_shipdate", "(l_orderkey * 7919) % 86400")
_DUR_Y = ("CAST(floor(l_quantity) AS BIGINT) * 60 + l_partkey % 997 - 600 "
          "+ CASE WHEN l_orderkey % 53 = 0 THEN 18000 ELSE 0 END")

YELLOW_RAW = f"""
SELECT
  l_suppkey % 3 AS VendorID,
  {_PICKUP_Y} AS tpep_pickup_datetime,
  {_secs_after(_PICKUP_Y, _DUR_Y)} AS tpep_dropoff_datetime,
  CAST(l_linenumber AS BIGINT) AS passenger_count,
  CASE WHEN l_partkey % 211 = 0 THEN {_d(0.0)} WHEN l_partkey % 307 = 0 THEN {_d(150.0)}
       ELSE l_quantity / 4 END AS trip_distance,
  CAST(l_linenumber AS DOUBLE) AS RatecodeID,
  CASE WHEN l_linestatus = 'O' THEN 'N' ELSE 'Y' END AS store_and_fwd_flag,
  l_suppkey % 27 AS PULocationID,
  CASE WHEN l_partkey % 3 = 0 THEN l_suppkey % 27 ELSE l_partkey % 29 END AS DOLocationID,
  CASE WHEN l_returnflag = 'A' THEN {_d(1.0)} WHEN l_returnflag = 'R' THEN {_d(2.0)}
       WHEN l_linestatus = 'O' THEN {_d(3.0)} ELSE {_d(9.0)} END AS payment_type,
  CASE WHEN l_orderkey % 97 = 0 THEN {_d(0.0)} WHEN l_orderkey % 89 = 0 THEN -{_PRICE}
       ELSE {_PRICE} END AS fare_amount,
  {_d(0.5)} AS extra,
  {_d(0.5)} AS mta_tax,
  CASE WHEN l_orderkey % 83 = 0 THEN {_PRICE} * 6 ELSE {_PRICE} * l_discount END AS tip_amount,
  CASE WHEN l_partkey % 10 = 0 THEN {_d(6.55)} ELSE {_d(0.0)} END AS tolls_amount,
  {_d(0.3)} AS improvement_surcharge,
  {_PRICE} * (1 + l_tax) AS total_amount,
  CASE WHEN l_shipdate >= TIMESTAMP '1998-01-01' THEN {_d(2.5)} END AS congestion_surcharge,
  CAST(year(l_shipdate) AS INTEGER) AS FILE_YEAR,
  CAST(month(l_shipdate) AS INTEGER) AS FILE_MONTH
FROM lineitem"""

GREEN_RAW = f"""
SELECT
  CASE WHEN event_type = 'error' THEN 'CMT' ELSE CAST(user_id % 3 AS VARCHAR) END AS vendor_id,
  ts AS lpep_pickup_datetime,
  {_secs_after("ts", "CAST(floor(value * 12) AS BIGINT) - 30")} AS lpep_dropoff_datetime,
  'N' AS store_and_fwd_flag,
  event_id % 7 + 1 AS rate_code_id,
  user_id % 26 AS PU_Location_ID,
  event_id % 27 AS DO_Location_ID,
  CAST(event_id % 4 + 1 AS INTEGER) AS passenger_count,
  value / 20 AS trip_distance,
  CASE WHEN event_type = 'error' THEN {_d(0.0)} ELSE value END AS fare_amount,
  {_d(0.5)} AS mta_tax,
  CASE WHEN event_type = 'purchase' THEN value * {_d(0.2)}
       WHEN event_type = 'click' THEN value * {_d(0.1)} ELSE {_d(0.0)} END AS tip_amount,
  {_d(0.0)} AS tolls_amount,
  value * {_d(1.1)} + {_d(0.5)} AS total_amount,
  CAST(CASE WHEN event_type = 'purchase' THEN 1 WHEN event_type = 'click' THEN 2
       WHEN event_type = 'view' THEN 3 WHEN event_type = 'signup' THEN 4 ELSE 5 END
       AS BIGINT) AS payment_type,
  CAST(1 AS BIGINT) AS trip_type,
  CAST(year(ts) AS INTEGER) AS FILE_YEAR,
  CAST(month(ts) AS INTEGER) AS FILE_MONTH
FROM events"""


def float_varchar(x: str) -> str:
    """``x::varchar`` for a double: integral values print without a fraction."""
    return (f"CASE WHEN {x} = floor({x}) THEN CAST(CAST({x} AS DECIMAL(38,0)) AS VARCHAR) "
            f"ELSE CAST({x} AS VARCHAR) END")


def harmonized(src: str, service: str) -> str:
    y = service == "yellow"
    return f"""
SELECT
  '{service}' AS service_type,
  CAST({'tpep' if y else 'lpep'}_pickup_datetime AS TIMESTAMP) AS pickup_datetime,
  CAST({'tpep' if y else 'lpep'}_dropoff_datetime AS TIMESTAMP) AS dropoff_datetime,
  CAST(passenger_count AS BIGINT) AS passenger_count,
  CAST(trip_distance AS DOUBLE) AS trip_distance,
  CAST({'PULocationID' if y else 'PU_Location_ID'} AS BIGINT) AS pu_location_id,
  CAST({'DOLocationID' if y else 'DO_Location_ID'} AS BIGINT) AS do_location_id,
  CAST(fare_amount AS DOUBLE) AS fare_amount,
  CAST(tip_amount AS DOUBLE) AS tip_amount,
  CAST(tolls_amount AS DOUBLE) AS tolls_amount,
  CAST(mta_tax AS DOUBLE) AS mta_tax,
  {'CAST(improvement_surcharge AS DOUBLE)' if y else 'CAST(NULL AS DOUBLE)'} AS improvement_surcharge,
  {'CAST(congestion_surcharge AS DOUBLE)' if y else 'CAST(NULL AS DOUBLE)'} AS congestion_surcharge,
  CAST(total_amount AS DOUBLE) AS total_amount,
  {float_varchar('payment_type') if y else 'CAST(payment_type AS VARCHAR)'} AS payment_type,
  CAST({'VendorID' if y else 'vendor_id'} AS VARCHAR) AS vendor_id,
  {float_varchar('RatecodeID') if y else 'CAST(rate_code_id AS VARCHAR)'} AS rate_code_id,
  CAST(store_and_fwd_flag AS VARCHAR) AS store_and_fwd_flag,
  CAST(FILE_YEAR AS INTEGER) AS year,
  CAST(FILE_MONTH AS INTEGER) AS month
FROM {src}"""


def obt_select(duration: str) -> str:
    return f"""
SELECT service_type, pickup_datetime, dropoff_datetime,
  date_diff('minute', pickup_datetime, dropoff_datetime) AS {duration},
  CAST(hour(pickup_datetime) AS INTEGER) AS pickup_hour,
  strftime(pickup_datetime, '%a') AS pickup_dow,
  coalesce(dayofweek(pickup_datetime) IN (0, 6), false) AS is_weekend,
  trip_distance, pu_location_id, do_location_id, fare_amount, tip_amount, tolls_amount,
  mta_tax, improvement_surcharge, congestion_surcharge, total_amount, payment_type,
  vendor_id, rate_code_id, store_and_fwd_flag, year, month,
  tip_amount / nullif(fare_amount, 0) AS tip_pct
FROM trips_all"""


CLEAN_WHERE = ("trip_minutes BETWEEN 1 AND 240 AND trip_distance > 0 AND trip_distance <= 100 "
               "AND tip_pct BETWEEN 0 AND 1")
STRICT_WHERE = ("fare_amount > 0 AND trip_distance BETWEEN 0.1 AND 100 "
                "AND trip_duration_min BETWEEN 1 AND 240")


def _values(rows, key, desc) -> str:
    body = ", ".join(f"({k}, '{v}')" for k, v in rows)
    return f"SELECT * FROM (VALUES {body}) AS t({key}, {desc})"


def code_key(c: str) -> str:
    return f"TRY_CAST(TRY_CAST({c} AS DECIMAL(38,0)) AS INTEGER)"


ZONES = """
SELECT CAST(n_nationkey AS INTEGER) AS LOCATIONID, r_name AS BOROUGH, n_name AS ZONE,
       CASE WHEN r_name = 'AMERICA' THEN 'Yellow Zone' ELSE 'Boro Zone' END AS SERVICE_ZONE
FROM nation JOIN region ON n_regionkey = r_regionkey"""

ENRICHED = f"""
SELECT t.service_type, t.pickup_datetime, t.dropoff_datetime,
  CAST(t.pickup_datetime AS DATE) AS pickup_date,
  CAST(t.dropoff_datetime AS DATE) AS dropoff_date,
  CAST(hour(t.pickup_datetime) AS INTEGER) AS pickup_hour,
  CAST(hour(t.dropoff_datetime) AS INTEGER) AS dropoff_hour,
  strftime(t.pickup_datetime, '%a') AS day_of_week,
  t.year, t.month,
  t.pu_location_id, zpu.ZONE AS pu_zone, zpu.BOROUGH AS pu_borough,
  t.do_location_id, zdo.ZONE AS do_zone, zdo.BOROUGH AS do_borough,
  t.trip_distance, t.store_and_fwd_flag, t.fare_amount, t.tip_amount, t.tolls_amount,
  t.mta_tax, t.improvement_surcharge, t.congestion_surcharge, t.total_amount,
  t.payment_type, p.payment_type_desc, t.vendor_id, v.vendor_name,
  t.rate_code_id, r.rate_code_desc,
  CAST(NULL AS INTEGER) AS trip_type,
  t.trip_duration_min, t.tip_pct,
  t.trip_distance / (CAST(nullif(date_diff('second', t.pickup_datetime, t.dropoff_datetime), 0)
                     AS DOUBLE) / CAST(3600.0 AS DOUBLE)) AS avg_speed_mph
FROM obt_strict t
LEFT JOIN zones zpu ON zpu.LOCATIONID = t.pu_location_id
LEFT JOIN zones zdo ON zdo.LOCATIONID = t.do_location_id
LEFT JOIN dim_payment p ON p.payment_type = {code_key('t.payment_type')}
LEFT JOIN dim_vendor v ON v.vendor_id = {code_key('t.vendor_id')}
LEFT JOIN dim_rate r ON r.rate_code_id = {code_key('t.rate_code_id')}"""


def _ctes() -> list[tuple[str, str]]:
    ctes = [
        ("yellow_raw", YELLOW_RAW),
        ("green_raw", GREEN_RAW),
        ("trips_all", harmonized("yellow_raw", "yellow") + "\nUNION ALL\n"
         + harmonized("green_raw", "green")),
        ("obt", obt_select("trip_minutes")),
        ("obt_clean", f"SELECT * FROM obt WHERE {CLEAN_WHERE}"),
        ("obt_strict", f"SELECT * FROM ({obt_select('trip_duration_min')}) s WHERE {STRICT_WHERE}"),
        ("zones", ZONES),
    ]
    for role, (key, desc, rows) in CODE_DIMS.items():
        ctes.append((f"dim_{role}", _values(rows, key, desc)))
    ctes.append(("enriched", ENRICHED))
    return ctes


def with_views(body: str) -> str:
    """Prefix ``body`` with every view it may read (unused ones cost nothing)."""
    parts = ",\n".join(f"{name} AS ({sql}\n)" for name, sql in _ctes())
    return f"WITH {parts}\n{body}"


def _profile_sql(src: str, keys: list[str], first_n: bool) -> str:
    m = ("ROUND(AVG(trip_minutes), 1) AS avg_min, ROUND(AVG(trip_distance), 2) AS avg_dist, "
         "ROUND(AVG(tip_pct), 3) AS avg_tip")
    n = "COUNT(*) AS n"
    k = ", ".join(keys)
    return f"SELECT {k}, {n + ', ' + m if first_n else m + ', ' + n} FROM {src} GROUP BY {k}"


def _exact_mean(found: re.Match) -> str:
    """Mean of values taken to twelve places, in whole numbers, halves rounded away from zero."""
    total = f"SUM(CAST(round({found[1]} * 1e12) AS HUGEINT))"
    n = f"(COUNT({found[1]}) * CAST({10 ** (12 - int(found[2]))} AS HUGEINT))"
    return f"CAST(sign({total}) * ((2 * abs({total}) + {n}) // (2 * {n})) AS DOUBLE) / {10 ** int(found[2])}"


def _top_zones_sql(side: str) -> str:
    b, z = f"{side}_borough", f"{side}_zone"
    return f"""
SELECT year, month, {b}, {z}, trips FROM (
  SELECT year, month, {b}, {z}, COUNT(*) AS trips,
         ROW_NUMBER() OVER (PARTITION BY year, month
                            ORDER BY COUNT(*) DESC, {b} ASC NULLS LAST, {z} ASC NULLS LAST) AS rn
  FROM enriched GROUP BY year, month, {b}, {z}) s
WHERE rn <= 10"""


def statements() -> dict[str, str]:
    q = {}
    q["trips_all"] = "SELECT * FROM trips_all"
    q["obt"] = "SELECT * FROM obt"
    q["obt_clean"] = "SELECT * FROM obt_clean"
    q["obt_strict"] = "SELECT * FROM obt_strict"
    q["obt_enriched"] = "SELECT * FROM enriched"
    q["trips_by_service_year"] = ("SELECT service_type, year, COUNT(*) AS total_viajes "
                                  "FROM trips_all GROUP BY service_type, year")
    q["quality_counts"] = """
SELECT CAST(SUM(CASE WHEN trip_minutes < 0 THEN 1 ELSE 0 END) AS BIGINT) AS trips_negativos,
       CAST(SUM(CASE WHEN tip_pct < 0 THEN 1 ELSE 0 END) AS BIGINT) AS tips_negativos,
       CAST(SUM(CASE WHEN tip_pct > 5 THEN 1 ELSE 0 END) AS BIGINT) AS tips_mayor_500pct
FROM obt"""
    q["clean_pct"] = f"""
SELECT COUNT(*) FILTER (WHERE {CLEAN_WHERE}) AS total_clean,
       ROUND(COUNT(*) FILTER (WHERE {CLEAN_WHERE}) / COUNT(*) * 100, 2) AS pct_sobre_total
FROM obt"""
    q["row_counts"] = """
SELECT a.n AS trips_all_rows, b.n AS obt_rows, a.n = b.n AS counts_match
FROM (SELECT COUNT(*) AS n FROM trips_all) a, (SELECT COUNT(*) AS n FROM obt) b"""
    q["stats_by_service"] = _profile_sql("obt_clean", ["service_type"], False)
    q["stats_by_hour_service"] = _profile_sql("obt_clean", ["pickup_hour", "service_type"], True)
    q["stats_by_dow"] = _profile_sql("obt_clean", ["pickup_dow", "is_weekend", "service_type"],
                                     True)
    q["top_pickup_zones"] = _top_zones_sql("pu")
    q["top_dropoff_zones"] = _top_zones_sql("do")
    q["revenue_by_borough_month"] = """
SELECT year, month, pu_borough,
       CAST(ROUND(SUM(CAST(total_amount AS DECIMAL(18,6))), 2) AS DOUBLE) AS total_amount_sum,
       ROUND(AVG(tip_pct), 3) AS tip_pct_avg, COUNT(*) AS n
FROM enriched GROUP BY year, month, pu_borough"""
    q["speed_by_borough"] = """
SELECT pu_borough, ROUND(AVG(avg_speed_mph), 2) AS avg_speed,
       ROUND(MIN(avg_speed_mph), 2) AS min_speed, ROUND(MAX(avg_speed_mph), 2) AS max_speed
FROM enriched WHERE avg_speed_mph IS NOT NULL GROUP BY pu_borough"""
    q["tip_by_payment"] = """
SELECT payment_type_desc, ROUND(AVG(tip_pct), 3) AS avg_tip_pct, COUNT(*) AS n
FROM enriched WHERE tip_pct IS NOT NULL GROUP BY payment_type_desc"""
    q["top_corridors_tip"] = f"""
SELECT pu_borough, pu_zone, do_borough, do_zone, ROUND(AVG(tip_pct), 3) AS avg_tip_pct,
       COUNT(*) AS n
FROM enriched WHERE tip_pct IS NOT NULL
GROUP BY pu_borough, pu_zone, do_borough, do_zone
HAVING COUNT(*) > 500
ORDER BY avg_tip_pct DESC, pu_borough ASC NULLS LAST, pu_zone ASC NULLS LAST,
         do_borough ASC NULLS LAST, do_zone ASC NULLS LAST
LIMIT 10"""
    q["stats_by_hour"] = """
SELECT pickup_hour, ROUND(AVG(trip_duration_min), 2) AS avg_duration_min,
       ROUND(AVG(trip_distance), 2) AS avg_distance_mi, ROUND(AVG(tip_pct), 3) AS avg_tip_pct,
       COUNT(*) AS n
FROM enriched GROUP BY pickup_hour"""
    q.update(_more())
    # the reports from the monthly roll-up: the same, but averages of doubles are of exact sums
    q |= {f"rollup_{k}": re.sub(r"ROUND\(AVG\((trip_distance|tip_pct|avg_speed_mph)\), (\d)\)", _exact_mean, q[k]) for k in (
        "stats_by_service", "stats_by_hour_service", "stats_by_dow", "top_pickup_zones", "top_dropoff_zones",
        "revenue_by_borough_month", "speed_by_borough", "tip_by_payment", "top_corridors_tip", "stats_by_hour")}
    return {k: with_views(v) for k, v in q.items()}


TABLE_RE = r"(?i)^trips_(yellow|green)_(\d{4})_(\d{2})$"


def _table_name(prefix="") -> str:
    return (f"'TRIPS_' || upper({prefix}service_type) || '_' || CAST({prefix}year AS VARCHAR) "
            f"|| '_' || lpad(CAST({prefix}month AS VARCHAR), 2, '0')")


def _re_int(s: str, g: int) -> str:
    return f"TRY_CAST(nullif(regexp_extract({s}, '{TABLE_RE}', {g}), '') AS INTEGER)"


# Columns of a later yellow month: in the files' order; times, doubles, others.
_MONTH_COLUMNS = ["VendorID", "tpep_pickup_datetime", "tpep_dropoff_datetime", "passenger_count", "trip_distance",
                  "RatecodeID", "store_and_fwd_flag", "PULocationID", "DOLocationID", "payment_type", "fare_amount",
                  "extra", "mta_tax", "tip_amount", "tolls_amount", "improvement_surcharge", "total_amount",
                  "congestion_surcharge"]
_MONTH_TEXT = (["tpep_pickup_datetime", "tpep_dropoff_datetime"],
               ["trip_distance", "RatecodeID", "payment_type", "fare_amount", "extra", "mta_tax", "tip_amount",
                "tolls_amount", "improvement_surcharge", "total_amount", "congestion_surcharge"],
               ["VendorID", "passenger_count", "store_and_fwd_flag", "PULocationID", "DOLocationID"])

_LOADED = "SELECT DISTINCT service_type, year, month FROM trips_all"


def _expected_full_years(loaded: str) -> str:
    return f"""
SELECT s.service_type, CAST(floor(i / 12) AS INTEGER) AS year, CAST(i % 12 + 1 AS INTEGER) AS month
FROM (SELECT s.service_type, unnest(generate_series(lo, hi)) AS i
      FROM (SELECT min(year) * 12 AS lo, max(year) * 12 + 11 AS hi FROM ({loaded}) l) span,
           (VALUES ('yellow'), ('green')) s(service_type)) s"""


def _more() -> dict[str, str]:
    q = {}
    q["normalize_ts"] = """
SELECT * EXCLUDE (FILE_YEAR, FILE_MONTH) FROM yellow_raw
UNION ALL BY NAME SELECT * EXCLUDE (FILE_YEAR, FILE_MONTH) FROM green_raw"""
    q["harmonize"] = (harmonized("yellow_raw", "yellow") + "\nUNION ALL\n"
                      + harmonized("green_raw", "green"))
    q["pick_coalesce"] = "SELECT * FROM trips_all"
    p, d = "pickup_datetime", "dropoff_datetime"
    q["scalars_time"] = f"""
SELECT service_type, {p}, {d},
  date_diff('minute', {p}, {d}) AS trip_minutes,
  date_diff('second', {p}, {d}) AS trip_seconds,
  CAST(trunc((epoch_us({d}) - epoch_us({p})) / 60000000) AS BIGINT) AS elapsed_minutes,
  CAST(hour({p}) AS INTEGER) AS pickup_hour,
  strftime({p}, '%a') AS pickup_dow,
  coalesce(dayofweek({p}) IN (0, 6), false) AS is_weekend,
  CAST({p} AS DATE) AS pickup_date
FROM trips_all"""
    q["scalars_ratio"] = f"""
SELECT service_type, fare_amount, tip_amount, trip_distance,
  tip_amount / nullif(fare_amount, 0) AS tip_pct,
  trip_distance / (CAST(nullif(date_diff('second', {p}, {d}), 0) AS DOUBLE)
                   / CAST(3600.0 AS DOUBLE)) AS avg_speed_mph,
  nullif(fare_amount, 0) IS NULL AS fare_is_zero,
  total_amount - fare_amount - tip_amount AS other_charges
FROM trips_all"""
    tname = _table_name()
    tiny = f"({tname} || '_TINY')"
    q["scalars_name"] = f"""
SELECT service_type, year, month,
  {tname} AS table_name,
  lower(service_type) || '_tripdata_' || CAST(year AS VARCHAR) || '-'
    || lpad(CAST(month AS VARCHAR), 2, '0') || '.parquet' AS file_name,
  {_re_int(tname, 2)} AS re_year,
  {_re_int(tname, 3)} AS re_month,
  {_re_int(tiny, 2)} AS tiny_re_year,
  TRY_CAST(split_part({tiny}, '_', 3) AS INTEGER) AS tiny_split_year,
  TRY_CAST(split_part({tiny}, '_', 4) AS INTEGER) AS tiny_split_month,
  lower(trim('  ' || {tname} || ' ')) AS table_lower,
  lpad(CAST(month AS VARCHAR), 2, '0') AS month2
FROM ({_LOADED}) m"""
    miles = "CAST(abs(CAST(floor(trip_distance) AS BIGINT)) AS VARCHAR)"
    _number_19 = f"CAST(CAST('93' || lpad({miles}, 17, '0') AS DECIMAL(38,0)) + 1 AS VARCHAR)"
    _number_30 = f"'-123456789012345678901234' || lpad({miles}, 6, '0')"
    q["scalars_cast"] = f"""
SELECT 'yellow' AS service_type, trip_distance,
  CAST(round(trip_distance) AS BIGINT) AS distance_number,
  CAST(round(fare_amount) AS BIGINT) AS fare_number,
  {_number_19} AS number_19, {_number_30} AS number_30,
  {float_varchar('payment_type')} AS payment_code,
  CAST(VendorID AS VARCHAR) AS vendor_code,
  {code_key('CAST(VendorID AS VARCHAR)')} AS vendor_key,
  CAST(passenger_count AS DOUBLE) AS passengers_float
FROM yellow_raw
UNION ALL
SELECT 'green', trip_distance,
  CAST(round(trip_distance) AS BIGINT), CAST(round(fare_amount) AS BIGINT),
  {_number_19}, {_number_30},
  CAST(payment_type AS VARCHAR), vendor_id, {code_key('vendor_id')},
  CAST(passenger_count AS DOUBLE)
FROM green_raw"""
    q["dim_zones"] = "SELECT * FROM zones"
    usage = " UNION ALL ".join(
        f"SELECT '{role}' AS dim, {key} AS code, COUNT(*) AS n FROM trips_all GROUP BY {key}"
        for role, (key, _d, _r) in CODE_DIMS.items())
    long_dims = " UNION ALL ".join(
        f"SELECT '{role}' AS dim, {key} AS code_key, {desc} AS description FROM dim_{role}"
        for role, (key, desc, _r) in CODE_DIMS.items())
    q["dim_codes"] = f"""
SELECT u.dim, u.code, {code_key('u.code')} AS code_key, d.description, u.n
FROM ({usage}) u
LEFT JOIN ({long_dims}) d ON d.dim = u.dim AND d.code_key = {code_key('u.code')}"""
    q["read_query"] = """
SELECT pickup_dow, service_type, COUNT(DISTINCT pickup_hour) AS hours, COUNT(*) AS trips, MAX(trip_minutes) AS longest,
       CAST(COUNT(*) FILTER (WHERE is_weekend) AS BIGINT) AS weekend_trips
FROM obt_clean GROUP BY pickup_dow, service_type HAVING COUNT(*) > 1"""
    q["load_plan_years"] = f"""
SELECT p.service_type, CAST(p.year AS INTEGER) AS year, CAST(p.month AS INTEGER) AS month
FROM (SELECT s.service_type, y.year, m.month, min(y.year) OVER () AS lo, max(y.year) OVER () AS hi
      FROM (VALUES ('yellow'), ('green')) s(service_type), (SELECT DISTINCT year FROM trips_all) y,
           (SELECT unnest(generate_series(1, 12)) AS month) m) p
WHERE CASE WHEN p.year = p.lo THEN p.month <= 6 WHEN p.year = p.hi THEN p.month IN (1, 8, 12) ELSE true END
  AND NOT EXISTS (SELECT 1 FROM ({_LOADED}) l WHERE l.service_type = p.service_type
                  AND l.year = p.year AND l.month = p.month)"""
    month = """SELECT * EXCLUDE (FILE_YEAR, FILE_MONTH) FROM yellow_raw WHERE FILE_YEAR = 1998 AND FILE_MONTH = 7"""
    times, floats, others = _MONTH_TEXT
    text = {c: f"strftime({c}, '%Y-%m-%d %H:%M:%S.%f')" for c in times}
    text |= {c: f"CAST(CAST(round({c} * 1000000) AS DECIMAL(38,0)) AS VARCHAR)" for c in floats}
    text |= {c: f"CAST({c} AS VARCHAR)" for c in others}
    digest = "md5(" + " || '|' || ".join(f"coalesce({text[c]}, '')" for c in _MONTH_COLUMNS) + ")"
    q["sample_month"] = f"""
SELECT * EXCLUDE (rn), 25::INTEGER AS sample FROM (
  SELECT *, row_number() OVER (ORDER BY {digest}) AS rn FROM ({month}) m) s WHERE rn <= 25
UNION ALL BY NAME SELECT *, NULL::INTEGER AS sample FROM ({month}) m"""
    names = f"""
SELECT {tname} AS table_name FROM ({_LOADED}) m
UNION ALL SELECT {tname} || '_TINY' FROM ({_LOADED}) m WHERE service_type = 'green'
UNION ALL SELECT 'TRIPS_ALL'"""
    q["inventory_months"] = f"""
SELECT * FROM (
  SELECT table_name,
         lower(nullif(regexp_extract(table_name, '{TABLE_RE}', 1), '')) AS service_type,
         {_re_int('table_name', 2)} AS yr, {_re_int('table_name', 3)} AS mo
  FROM ({names}) n) t
WHERE yr IS NOT NULL AND mo IS NOT NULL"""
    missing = f"""
SELECT e.* FROM ({_expected_full_years(_LOADED)}) e
WHERE NOT EXISTS (SELECT 1 FROM ({_LOADED}) l WHERE l.service_type = e.service_type
                  AND l.year = e.year AND l.month = e.month)"""
    q["missing_months"] = f"""
SELECT service_type, year,
  string_agg(lpad(CAST(month AS VARCHAR), 2, '0'), ', ' ORDER BY month) AS missing_months,
  COUNT(*) AS n_missing
FROM ({missing}) m GROUP BY service_type, year"""
    q["scan_month"] = """
SELECT * EXCLUDE (FILE_YEAR, FILE_MONTH) FROM yellow_raw
WHERE FILE_YEAR = 1998 AND FILE_MONTH = 7"""
    q["inventory_files"] = f"""
SELECT service_type, year, month, CAST(1 AS BIGINT) AS n_files FROM ({_LOADED}) m"""
    q["overwrite_month"] = """
SELECT * REPLACE (CASE WHEN service_type = 'yellow' AND year = 1998 AND month = 7
                       THEN fare_amount + 1 ELSE fare_amount END AS fare_amount)
FROM trips_all WHERE NOT (service_type = 'yellow' AND year = 1998 AND month = 6)"""
    counts = "SELECT service_type, year, month, COUNT(*) AS n FROM trips_all GROUP BY ALL"
    q["load_manifest"] = f"""
SELECT e.service_type, e.year, e.month, CAST(coalesce(c.n, 0) AS BIGINT) AS rows_loaded,
       CASE WHEN c.n IS NULL THEN 'missing' ELSE 'loaded' END AS status
FROM ({_expected_full_years(_LOADED)}) e
LEFT JOIN ({counts}) c USING (service_type, year, month)"""
    q["load_trips"] = "SELECT * FROM trips_all"
    q["load_rejects"] = """
SELECT 'green' AS service_type, 'fare_amount' AS column_name, 'n/a' AS raw, COUNT(*) AS n FROM green_raw WHERE fare_amount = 0
UNION ALL SELECT 'green', 'passenger_count', '9300000000000000000', COUNT(*) FROM green_raw WHERE passenger_count = 4"""
    q["load_changed"] = """
SELECT service_type, year, month, COUNT(*) AS rows_loaded, 'loaded' AS status,
       CAST(SUM(CAST(fare_amount + 1 AS DECIMAL(18,6))) AS DOUBLE) AS fares
FROM trips_all WHERE service_type = 'yellow' AND year = 1998 GROUP BY ALL"""
    q["load_missing"] = f"""
SELECT e.service_type, e.year, e.month, CAST(coalesce(c.n, 0) AS BIGINT) AS rows_loaded,
       CASE WHEN c.n IS NULL THEN 'missing' ELSE 'loaded' END AS status
FROM ({_expected_full_years(_LOADED)}) e
LEFT JOIN ({counts}) c USING (service_type, year, month)
WHERE (e.year < (SELECT max(year) FROM trips_all) OR e.month <= 8)
  AND NOT (e.service_type = 'yellow' AND c.n IS NOT NULL)"""
    return q
