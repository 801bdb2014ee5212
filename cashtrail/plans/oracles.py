"""For every registered query that SQL can express, the same question in ANSI SQL."""

from __future__ import annotations

from cashtrail import contract
from cashtrail.operators.lookup import CRIME_TYPES, STATES
from cashtrail.sources.demo_tables import (
    BANKS,
    BASE_LATITUDES,
    BASE_LONGITUDES,
    CHANNELS,
    CRIME_OF_EVENT,
    STATUSES,
)


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _num(value: float) -> str:
    return f"CAST({value!r} AS DOUBLE)"


def _case(key: str, values) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {k} THEN {v}" for k, v in values) + " END"


def _cycle(key: str, values) -> str:
    return _case(key, ((i, _text(v) if isinstance(v, str) else _num(v)) for i, v in enumerate(values)))


def rnd(x: str, digits: int) -> str:
    """Half-up rounding of the shortest decimal text of a double."""
    return f"CAST(round(CAST(CAST({x} AS VARCHAR) AS DECIMAL(38,18)), {digits}) AS DOUBLE)"


def _day(ts: str) -> str:
    return f"CAST(isodow({ts}) - 1 AS INTEGER)"


def _hour(ts: str) -> str:
    return f"CAST(hour({ts}) AS INTEGER)"


def _month(ts: str) -> str:
    return f"CAST(month({ts}) AS INTEGER)"


def _iso(ts: str) -> str:
    return (
        f"CASE WHEN strftime({ts}, '%f') = '000000' THEN strftime({ts}, '%Y-%m-%dT%H:%M:%S') "
        f"ELSE strftime({ts}, '%Y-%m-%dT%H:%M:%S.%f') END"
    )


def _flag(condition: str) -> str:
    return f"CAST(({condition}) AS INTEGER)"


def _hash(key: str, salt: str) -> str:
    return f"CAST(('0x' || substr(md5({key} || '{salt}'), 1, 7)) AS BIGINT)"


def _draw(salt: str, key: str = "complaint_id") -> str:
    return f"(CAST({_hash(key, salt)} AS DOUBLE) / CAST(268435456 AS DOUBLE))"


def _haversine(a_lat: str, a_lng: str, b_lat: str, b_lng: str) -> str:
    half_lat = f"sin(radians({b_lat} - {a_lat}) / 2)"
    half_lng = f"sin(radians({b_lng} - {a_lng}) / 2)"
    chord = (
        f"{half_lat} * {half_lat} + cos(radians({a_lat})) * cos(radians({b_lat})) * {half_lng} * {half_lng}"
    )
    return f"(2 * 6371.0::DOUBLE * asin(sqrt(least(1.0::DOUBLE, {chord}))))"


_STATE_ROWS = ", ".join(
    f"({i}, {_text(s)}, {_num(f)}, {_num(a)}, {_num(b)}, {_num(c)}, {_num(d)})"
    for i, (s, f, a, b, c, d) in enumerate(STATES)
)
_CRIME_ROWS = ", ".join(f"({_text(c)}, {_num(w)}, {_num(lo)}, {_num(hi)})" for c, w, lo, hi in CRIME_TYPES)
_RAW = ", ".join(contract.RAW_COLUMNS)

COMPLAINTS = f"""
states(slot, complaint_state, crime_rate_factor, south, north, west, east) AS (VALUES {_STATE_ROWS}),
crimes(crime_type, crime_weight, usual_lo, usual_hi) AS (VALUES {_CRIME_ROWS}),
reported AS (
  SELECT event_id, user_id, printf('CG2024%06d', event_id) AS complaint_id, ts AS "timestamp",
    {_case("event_type", ((_text(k), _text(v)) for k, v in CRIME_OF_EVENT.items()))} AS crime_type,
    CAST(CAST(value AS DECIMAL(12,2)) * 2000 AS DOUBLE) AS amount_lost,
    '+91-98' || lpad(CAST(event_id AS VARCHAR), 8, '0') AS victim_phone,
    {_cycle("event_id % 4", STATUSES)} AS status,
    {_cycle("(event_id // 4) % 4", CHANNELS)} AS reported_by,
    'Officer_' || CAST(1000 + event_id % 97 AS VARCHAR) AS investigation_officer,
    {_cycle("event_id % 8", BANKS)} AS bank_involved
  FROM events),
reports AS (
  SELECT *, CASE WHEN amount_lost > 200000 OR crime_type IN ('Cryptocurrency Fraud', 'Digital Payment Fraud') THEN 'High'
    WHEN amount_lost > 50000 THEN 'Medium' ELSE 'Low' END AS urgency_level,
    {_hour('"timestamp"')} AS hr, {_day('"timestamp"')} AS dow, {_month('"timestamp"')} AS mon
  FROM reported),
placed AS (
  SELECT r.*, n.n_name AS complaint_city, s.complaint_state, s.crime_rate_factor,
    {_cycle("n.n_nationkey % 7", BASE_LATITUDES)} + (r.user_id % 21 - 10) / 20.0::DOUBLE AS complaint_lat,
    {_cycle("n.n_nationkey % 7", BASE_LONGITUDES)} + (r.user_id % 13 - 6) / 20.0::DOUBLE AS complaint_lng
  FROM reports r JOIN customer c ON r.user_id = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN states s ON s.slot = n.n_nationkey),
risked AS (
  SELECT *, complaint_lat + (event_id % 41 - 20) / 100.0::DOUBLE AS predicted_withdrawal_lat,
    complaint_lng + (event_id % 37 - 18) / 100.0::DOUBLE AS predicted_withdrawal_lng,
    least(0.95::DOUBLE, (crime_rate_factor
      + CASE WHEN hr IN (22, 23, 0, 1, 2, 3) THEN 1.2::DOUBLE ELSE 0.8::DOUBLE END
      + CASE WHEN amount_lost > 100000 THEN 1.3::DOUBLE ELSE 0.9::DOUBLE END
      + CASE WHEN crime_type IN ('Digital Payment Fraud', 'UPI Fraud') THEN 1.1::DOUBLE ELSE 0.95::DOUBLE END) / 4) AS raw_risk
  FROM placed),
complaints AS (
  SELECT *, {rnd("raw_risk", 3)} AS withdrawal_probability, {rnd("raw_risk * 100", 1)} AS risk_score FROM risked),
gappy AS (
  SELECT * REPLACE (CASE WHEN event_id % 17 <> 0 THEN amount_lost END AS amount_lost) FROM complaints)
"""

_CITY = (
    "least("
    + ", ".join(
        f"abs(complaint_lat - {_num(y)}) + abs(complaint_lng - {_num(x)})"
        for y, x in ((28.6, 77.2), (19.0, 72.8), (12.9, 77.6), (13.0, 80.2), (22.5, 88.3))
    )
    + ")"
)
_BOX = " OR ".join(
    f"(abs(complaint_lat - {_num(y)}) < 0.3::DOUBLE AND abs(complaint_lng - {_num(x)}) < 0.3::DOUBLE)"
    for y, x in ((28.6, 77.2), (19.0, 72.8), (12.9, 77.6), (13.0, 80.2), (22.5, 88.3))
)


def _urgency(high: float, medium: float, low: float) -> str:
    return (
        f"CASE urgency_level WHEN 'High' THEN {_num(high)} WHEN 'Medium' THEN {_num(medium)} "
        f"WHEN 'Low' THEN {_num(low)} ELSE 0.5::DOUBLE END"
    )


def _rule(hr: str = "hr", dow: str = "dow") -> str:
    return f"""least({_urgency(0.75, 0.5, 0.25)}
      * (0.3::DOUBLE + least(amount_lost / 200000.0::DOUBLE, 1.0::DOUBLE) * 0.4::DOUBLE)
      * CASE WHEN {hr} BETWEEN 10 AND 16 THEN 1.2::DOUBLE WHEN {hr} BETWEEN 18 AND 22 THEN 1.1::DOUBLE
             WHEN {hr} BETWEEN 0 AND 6 THEN 0.8::DOUBLE ELSE 1.0::DOUBLE END
      * CASE WHEN {dow} >= 5 THEN 0.9::DOUBLE ELSE 1.0::DOUBLE END
      * CASE WHEN {_CITY} < 0.5::DOUBLE THEN 1.1::DOUBLE WHEN {_CITY} < 1.0::DOUBLE THEN 1.05::DOUBLE ELSE 1.0::DOUBLE END,
      0.95::DOUBLE)"""


def _scatter(centre: str, reach: str, salt: str) -> str:
    return f"({centre} + {reach} * (2 * {_draw(salt)} - 1))"


def _scored(rule: str, high: float, medium: float, source: str = "complaints", stamp: str = '"timestamp"') -> str:
    """CTEs ending in ``scored``: the prediction of every complaint."""
    return f"""ruled AS (SELECT * EXCLUDE (predicted_withdrawal_lat, predicted_withdrawal_lng, withdrawal_probability)
    REPLACE ({stamp} AS "timestamp"), {rule} AS p FROM {source}),
  banded AS (SELECT *, 0.05::DOUBLE + 0.15::DOUBLE * (1 - p) AS reach,
    CASE WHEN p > 0.8 THEN 2 WHEN p > 0.6 THEN 6 WHEN p > 0.4 THEN 12 ELSE 24 END AS h_lo,
    CASE WHEN p > 0.8 THEN 8 WHEN p > 0.6 THEN 18 WHEN p > 0.4 THEN 36 ELSE 72 END AS h_hi FROM ruled),
  scored AS (SELECT *, {_scatter("complaint_lat", "reach", "lat")} AS predicted_withdrawal_lat,
    {_scatter("complaint_lng", "reach", "lng")} AS predicted_withdrawal_lng,
    {rnd("p", 3)} AS withdrawal_probability,
    CAST(h_lo + floor({_draw("hours")} * (h_hi - h_lo)) AS INTEGER) AS predicted_hours_to_withdrawal,
    CASE WHEN p > {_num(high)} THEN 'HIGH' WHEN p > {_num(medium)} THEN 'MEDIUM' ELSE 'LOW' END AS risk_level,
    {rnd("least(p * 1.1::DOUBLE, 1.0::DOUBLE)", 3)} AS confidence_score,
    1.0::DOUBLE + 5.0::DOUBLE * (1 - p) AS alert_radius_km FROM banded)"""


_SCORED = _scored(_rule(), 0.5, 0.4)
_RESULT = f"""complaint_id, {rnd("predicted_withdrawal_lat", 6)} AS predicted_withdrawal_lat,
  {rnd("predicted_withdrawal_lng", 6)} AS predicted_withdrawal_lng, withdrawal_probability, predicted_hours_to_withdrawal,
  risk_level, confidence_score, {rnd("alert_radius_km", 6)} AS alert_radius_km"""
_ALERT_ID = """'alert_' || complaint_id || '_' || CAST(CAST(floor(epoch("timestamp")) AS BIGINT) AS VARCHAR)"""
_MESSAGE = (
    "'HIGH RISK: Withdrawal predicted at (' || printf('%.4f', predicted_withdrawal_lat) || ', ' || "
    "printf('%.4f', predicted_withdrawal_lng) || ') within ' || CAST(predicted_hours_to_withdrawal AS VARCHAR) || ' hours'"
)
_ROLE = f"CASE {_hash('complaint_id', '')} % 3 WHEN 0 THEN 'lea' WHEN 1 THEN 'bank' ELSE 'other' END"
_DIST = _haversine("complaint_lat", "complaint_lng", "predicted_withdrawal_lat", "predicted_withdrawal_lng")
_PRIORITY = (
    "CASE WHEN risk_score >= 80 OR amount_lost >= 100000 THEN 'High' "
    "WHEN risk_score >= 60 AND amount_lost >= 50000 THEN 'Medium' ELSE 'Low' END"
)
_PEAK = _flag("hr IN (9, 10, 11, 14, 15, 16)")
_WEEKEND = _flag("dow IN (5, 6)")
_NIGHT = _flag("hr >= 22 OR hr <= 6")
_BUSINESS = _flag("hr BETWEEN 9 AND 17")
_AMOUNT_LEVEL = (
    "CAST(CASE WHEN amount_lost <= 0 THEN NULL WHEN amount_lost <= 10000 THEN 1 WHEN amount_lost <= 50000 THEN 2 "
    "WHEN amount_lost <= 200000 THEN 3 ELSE 4 END AS INTEGER)"
)
_SUM = "CAST(sum(CAST(amount_lost AS DECIMAL(18,2))) AS DOUBLE)"


def _mean(column: str, scale: int) -> str:
    return f"(CAST(sum(CAST({column} AS DECIMAL(18,{scale}))) AS DOUBLE) / count({column}))"


_TEST = f"{_draw('split')} < 0.2::DOUBLE"
_RISK_VIOLATION = (
    "(complaint_lat BETWEEN 13.0 AND 28.0)",
    "(predicted_withdrawal_lat BETWEEN 13.0 AND 28.0)",
    "(complaint_lng BETWEEN 73.0 AND 88.0)",
    "(predicted_withdrawal_lng BETWEEN 73.0 AND 88.0)",
    "(withdrawal_probability BETWEEN 0 AND 1)",
)
_RULE_NAMES = (
    "complaint_lat_outside",
    "predicted_withdrawal_lat_outside",
    "complaint_lng_outside",
    "predicted_withdrawal_lng_outside",
    "probability_outside",
)


def _cells(digits: int) -> str:
    return (
        f"cells AS (SELECT *, {rnd('predicted_withdrawal_lat', digits)} AS lat, "
        f"{rnd('predicted_withdrawal_lng', digits)} AS lng FROM scored)"
    )


_CELL_RISK = rnd("CAST(sum(CAST(withdrawal_probability AS DECIMAL(18,3))) AS DOUBLE) / count(*)", 6)
_CELL = (
    f"SELECT lat, lng, {_CELL_RISK} AS risk_score, count(*) AS incident_count, "
    'arg_min(complaint_city, ("timestamp", complaint_city)) AS city FROM cells {where} GROUP BY lat, lng'
)


def _top(source: str, columns: str, order: str, n: int) -> str:
    return f"SELECT {columns} FROM {source} ORDER BY {order} LIMIT {n}"


def _long(columns, source: str, text: bool = True) -> str:
    """(column_name, value) rows of several columns."""
    kind = "VARCHAR" if text else "DOUBLE"
    return " UNION ALL ".join(
        f"SELECT {_text(name)} AS column_name, CAST({expr} AS {kind}) AS value FROM {source}" for name, expr in columns
    )


_PROFILE_TYPES = [(f.name, f.dataType.simpleString()) for f in contract.RAW_SCHEMA]
_NUMERIC = [
    ("amount_lost", "amount_lost"),
    ("complaint_lat", "complaint_lat"),
    ("complaint_lng", "complaint_lng"),
    ("predicted_withdrawal_lat", "predicted_withdrawal_lat"),
    ("predicted_withdrawal_lng", "predicted_withdrawal_lng"),
    ("withdrawal_probability", "withdrawal_probability"),
    ("risk_score", "risk_score"),
]
_CLEAN_NUMERIC = [
    *_NUMERIC,
    ("hour", "hr"),
    ("day_of_week", "dow"),
    ("is_weekend", _WEEKEND),
    ("is_peak_hours", _PEAK),
    ("distance_km", _DIST),
]


def _report_row(name: str, expected: str | None, actual: str | None, verdict: str) -> str:
    filled = "count(NULL)" if actual is None else f"count({'*' if name in _DERIVED_FILLED else name})"
    show = lambda x: "CAST(NULL AS VARCHAR)" if x is None else _text(x)
    return (
        f"SELECT {_text(name)} AS column_name, {show(expected)} AS expected_type, {show(actual)} AS actual_type, "
        f"{_text(verdict)} AS verdict, CAST({filled} AS BIGINT) AS filled_rows FROM complaints"
    )


_DERIVED_FILLED = {*contract.DERIVED_SCHEMA.names, "jurisdiction", "timestamp"}


def _contract_rows() -> str:
    rows = []
    for f in contract.CLEAN_SCHEMA:
        kind = f.dataType.simpleString()
        gone = f.name == "bank_involved"
        rows.append(_report_row(f.name, kind, None if gone else kind, "missing" if gone else "ok"))
    rows.append(_report_row("jurisdiction", None, "string", "extra"))
    return " UNION ALL ".join(rows)


def _corr_rows() -> str:
    rows = []
    for target in contract.TARGETS:
        for name, expr in _CLEAN_NUMERIC:
            if name != target:
                rows.append(
                    f"SELECT {_text(target)} AS target, {_text(name)} AS feature, "
                    f"corr(CAST({expr} AS DOUBLE), {target}) AS r FROM complaints"
                )
    return " UNION ALL ".join(rows)


def _roundtrip(source: str) -> str:
    listed = ", ".join(_iso('"timestamp"') + ' AS "timestamp"' if c == "timestamp" else c for c in contract.RAW_COLUMNS)
    return f"SELECT {_text(source)} AS source, {listed} FROM complaints"


def _listed(columns=contract.RAW_COLUMNS) -> str:
    return ", ".join(_iso('"timestamp"') + ' AS "timestamp"' if c == "timestamp" else c for c in columns)


_BASE_RISK = (
    f"((least(amount_lost / 200000.0::DOUBLE, 1.0::DOUBLE) + {_urgency(0.8, 0.5, 0.2)}) / 2)"
)
_ATM_LAT = _scatter("complaint_lat", "0.005::DOUBLE", "atm_lat")
_ATM_LNG = _scatter("complaint_lng", "0.005::DOUBLE", "atm_lng")


def _planar(a_lat: str, a_lng: str, b_lat: str, b_lng: str) -> str:
    return f"(sqrt(({a_lat} - {b_lat}) * ({a_lat} - {b_lat}) + ({a_lng} - {b_lng}) * ({a_lng} - {b_lng})) * 111.32::DOUBLE)"


_KS_COLUMNS = _NUMERIC

BODIES: dict[str, tuple[str, str]] = {
    # name: (further CTEs, final select)
    "clean_rows": ("", f"SELECT {_listed()} FROM gappy WHERE amount_lost IS NOT NULL"),
    "time_features": (
        "",
        f"""SELECT complaint_id, hr AS "hour", dow AS day_of_week, mon AS "month", {_WEEKEND} AS is_weekend,
        {_PEAK} AS is_peak_hours, {_flag("hr BETWEEN 10 AND 16")} AS is_peak_withdrawal, {_NIGHT} AS is_night_time,
        {_BUSINESS} AS is_business_hours, {_flag("hr BETWEEN 9 AND 17 AND dow < 5")} AS is_business_hours_serving FROM reports""",
    ),
    "distance_features": (
        "",
        f"""SELECT complaint_id, {rnd(_DIST, 4)} AS distance_km,
        {rnd(_planar("complaint_lat", "complaint_lng", "predicted_withdrawal_lat", "predicted_withdrawal_lng"), 4)} AS planar_km
        FROM complaints""",
    ),
    "alert_priority": ("", f"SELECT complaint_id, risk_score, amount_lost, {_PRIORITY} AS alert_priority FROM complaints"),
    "amount_levels": (
        "",
        f"""SELECT complaint_id, {_AMOUNT_LEVEL} AS amount_risk_level,
        CASE WHEN amount_lost > 100000 THEN 2 WHEN amount_lost > 50000 THEN 1 ELSE 0 END AS serving_amount_level FROM reports""",
    ),
    "urgency_rule": ("", "SELECT complaint_id, crime_type, amount_lost, urgency_level FROM reports"),
    "composite_risk": (
        "",
        "SELECT complaint_id, crime_rate_factor, withdrawal_probability, risk_score FROM complaints",
    ),
    "multipliers": (
        "",
        """SELECT complaint_id, CASE WHEN mon IN (11, 12, 1) THEN 1.4::DOUBLE WHEN mon IN (4, 5, 6) THEN 1.1::DOUBLE
        WHEN mon IN (7, 8, 9) THEN 0.8::DOUBLE ELSE 1.0::DOUBLE END AS season,
        CASE WHEN mon IN (11, 12, 1) THEN 1.3::DOUBLE ELSE 1.0::DOUBLE END AS dashboard_season,
        CASE WHEN complaint_state IN ('Maharashtra', 'Delhi', 'Karnataka', 'Tamil Nadu', 'Telangana') THEN 1.5::DOUBLE
        WHEN complaint_state IN ('Uttar Pradesh', 'Bihar', 'West Bengal') THEN 0.8::DOUBLE ELSE 1.0::DOUBLE END AS regional
        FROM complaints""",
    ),
    "geo_factor": (
        "",
        f"""SELECT complaint_id, {rnd(_CITY, 6)} AS degrees, CASE WHEN {_CITY} < 0.5::DOUBLE THEN 1.1::DOUBLE
        WHEN {_CITY} < 1.0::DOUBLE THEN 1.05::DOUBLE ELSE 1.0::DOUBLE END AS city_factor FROM complaints""",
    ),
    "city_box_flag": ("", f"SELECT complaint_id, {_flag(_BOX)} AS high_risk_zone FROM complaints"),
    "fallback_score": (
        _scored(_rule(), 0.7, 0.4),
        f"""SELECT complaint_id, withdrawal_probability, h_lo AS hours_from, h_hi AS hours_before, risk_level,
        confidence_score, {rnd("alert_radius_km", 6)} AS alert_radius_km FROM scored""",
    ),
    "seeded_location": (
        _SCORED,
        f"""SELECT complaint_id, {rnd("predicted_withdrawal_lat", 6)} AS predicted_withdrawal_lat,
        {rnd("predicted_withdrawal_lng", 6)} AS predicted_withdrawal_lng, predicted_hours_to_withdrawal FROM scored""",
    ),
    "serving_risk": (
        f"based AS (SELECT *, {_BASE_RISK} AS b, greatest(0.1::DOUBLE, least({_BASE_RISK}, 0.99::DOUBLE)) AS q FROM complaints)",
        f"""SELECT complaint_id, {rnd("b", 9)} AS base_risk, {_flag("amount_lost > 50000 OR urgency_level = 'High'")} AS requires_bank_alert,
        {_flag(_BOX)} AS high_risk_zone,
        CASE WHEN amount_lost > 100000 THEN 2 WHEN amount_lost > 50000 THEN 1 ELSE 0 END AS amount_risk_level,
        {rnd(_planar("complaint_lat", "complaint_lng", _ATM_LAT, _ATM_LNG), 4)} AS atm_distance_km,
        {rnd("q", 3)} AS withdrawal_probability,
        greatest(1, least(CAST(trunc(24 - b * 48) AS INTEGER), 72)) AS predicted_hours_to_withdrawal,
        CASE WHEN q > 0.7::DOUBLE THEN 'HIGH' WHEN q > 0.4::DOUBLE THEN 'MEDIUM' ELSE 'LOW' END AS risk_level,
        {rnd("least(q * 1.1::DOUBLE, 1.0::DOUBLE)", 3)} AS confidence_score,
        {rnd("1.0::DOUBLE + 4.0::DOUBLE * (1 - q)", 1)} AS alert_radius_km,
        CAST(trunc(CASE urgency_level WHEN 'High' THEN 6 WHEN 'Medium' THEN 12 ELSE 24 END * (1 - b * 0.5::DOUBLE)) AS INTEGER) AS hours_by_urgency,
        CASE WHEN b > 0.8::DOUBLE THEN 2.0::DOUBLE WHEN b > 0.5::DOUBLE THEN 5.0::DOUBLE ELSE 10.0::DOUBLE END AS radius_by_level
        FROM based""",
    ),
    "text_formats": (
        _SCORED,
        f"""SELECT complaint_id, complaint_id AS rebuilt_id, {_ALERT_ID} AS alert_id, {_MESSAGE} AS message,
        strftime("timestamp", '%b %Y') AS month_label, lpad(CAST(hr AS VARCHAR), 2, '0') || ':00' AS hour_label,
        {_iso('"timestamp"')} AS iso_time, status AS title, format('{{:,}}', CAST(amount_lost AS BIGINT)) AS amount_text FROM scored""",
    ),
    "day_part": (
        "",
        """SELECT complaint_id, CASE WHEN hr <= 6 THEN 'late_night' WHEN hr <= 11 THEN 'morning'
        WHEN hr <= 17 THEN 'afternoon' ELSE 'evening' END AS day_part FROM reports""",
    ),
    "mask_pii": ("", "SELECT complaint_id, '+91-XXXXXXXXXX' AS hidden, '+91-' || regexp_replace(substr(victim_phone, 5), '[0-9]', 'X', 'g') AS pattern FROM reports"),
    "schema_ops": (
        "",
        """SELECT complaint_id, 'Unknown' AS jurisdiction, '2024-01-31T00:00:00' AS event_time,
        coalesce(amount_lost, 0.0::DOUBLE) AS x_amount_lost, complaint_lat AS x_complaint_lat, complaint_lng AS x_complaint_lng,
        predicted_withdrawal_lat AS x_predicted_withdrawal_lat, predicted_withdrawal_lng AS x_predicted_withdrawal_lng
        FROM gappy WHERE bank_involved IN ('Harbour Bank', 'Meadow Bank', 'Summit Bank')""",
    ),
    "urgent_cases": (
        "",
        f"""SELECT complaint_id, {rnd("amount_lost / 10000000.0::DOUBLE", 4)} AS crores, risk_score / 100.0::DOUBLE AS risk
        FROM complaints WHERE urgency_level = 'High'""",
    ),
    "clean_features": (
        "",
        f"""SELECT complaint_id, {rnd(_DIST, 4)} AS distance_km, {_PRIORITY} AS alert_priority, hr AS "hour", dow AS day_of_week,
        {_WEEKEND} AS is_weekend, {_PEAK} AS is_peak_hours FROM complaints""",
    ),
    "model_features": (
        "",
        f"""SELECT complaint_id, {_flag("lower(complaint_state) IN ('mumbai', 'delhi', 'bangalore', 'hyderabad')")} AS high_risk_zone,
        {_NIGHT} AS is_night_time, {_BUSINESS} AS is_business_hours, {_AMOUNT_LEVEL} AS amount_risk_level,
        {rnd(_haversine("complaint_lat", "complaint_lng", "(complaint_lat + 0.005::DOUBLE)", "(complaint_lng - 0.005::DOUBLE)"), 4)} AS distance_to_atm
        FROM complaints""",
    ),
    "dimension_lookup": (
        "",
        """SELECT complaint_id, c.crime_rate_factor, s.south AS state_south, s.east AS state_east, k.crime_weight,
        c.amount_lost BETWEEN k.usual_lo AND k.usual_hi AS usual
        FROM complaints c LEFT JOIN states s ON c.complaint_state = s.complaint_state LEFT JOIN crimes k ON c.crime_type = k.crime_type""",
    ),
    "overview": ("", "SELECT count(*) AS records, CAST(18 AS INTEGER) AS features FROM complaints"),
    "risk_distribution": (
        "",
        """SELECT count(*) FILTER (urgency_level = 'High') AS high, count(*) FILTER (urgency_level = 'Medium') AS medium,
        count(*) FILTER (urgency_level = 'Low') AS low, count(*) AS total FROM reports""",
    ),
    "system_stats": (
        "",
        "SELECT count(*) AS total_cases, count(*) FILTER (urgency_level = 'High') AS high_risk_cases FROM reports",
    ),
    "value_counts": ("", "SELECT crime_type, count(*) AS cases FROM reports WHERE crime_type IS NOT NULL GROUP BY crime_type"),
    "frequent_values": (
        "",
        """SELECT investigation_officer, count(*) AS cases FROM reports GROUP BY investigation_officer
        ORDER BY cases DESC, investigation_officer LIMIT 5""",
    ),
    "topk_categories": (
        f"""long AS ({_long([(c, c) for c in contract.PROFILE_CATEGORIES], "complaints")}),
        counts AS (SELECT column_name, value, count(*) AS cases FROM long GROUP BY ALL),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY cases DESC, value) AS position,
          sum(cases) OVER (PARTITION BY column_name) AS total, count(value) OVER (PARTITION BY column_name) AS kinds FROM counts)""",
        f"""SELECT column_name, CAST(position AS INTEGER) AS position, value, cases, {rnd("cases * 100.0::DOUBLE / total", 1)} AS percent,
        greatest(kinds - 5, 0) AS more_categories FROM ranked WHERE position <= 5""",
    ),
    "dataset_summary": (
        "",
        f"""SELECT count(*) AS total_records, count(DISTINCT complaint_state) AS states_covered,
        count(DISTINCT complaint_city) AS cities_covered, {_SUM} AS total_amount_lost,
        {rnd(_mean("amount_lost", 2), 4)} AS average_amount_lost, count(*) FILTER (risk_score > 75) AS high_risk_cases FROM complaints""",
    ),
    "dataset_breakdown": (
        f"""long AS ({_long([("crime_type", "crime_type"), ("complaint_state", "complaint_state"),
        ("urgency_level", "urgency_level"), ("month", "mon")], "complaints")})""",
        "SELECT column_name AS section, value AS item, count(*) AS cases FROM long GROUP BY ALL",
    ),
    "distinct_counts": (
        "",
        """SELECT count(DISTINCT complaint_state) AS complaint_state_distinct, count(DISTINCT complaint_city) AS complaint_city_distinct,
        count(DISTINCT investigation_officer) AS investigation_officer_distinct FROM complaints""",
    ),
    "numeric_profile": (
        f"long AS ({_long([(c, c) for c in contract.PROFILE_NUMBERS], 'gappy', text=False)})",
        f"""SELECT column_name, min(value) AS minimum, max(value) AS maximum, {rnd("avg(value)", 4)} AS mean,
        {rnd("stddev_samp(value)", 4)} AS std, count(*) FILTER (value IS NULL) AS nulls FROM long GROUP BY column_name""",
    ),
    "column_profile": (
        f"""long AS ({_long([(c, '"timestamp"' if c == "timestamp" else c) for c in contract.RAW_COLUMNS], "gappy")}),
        kinds(column_name, data_type) AS (VALUES {", ".join(f"({_text(c)}, {_text(t)})" for c, t in _PROFILE_TYPES)})""",
        """SELECT column_name, any_value(data_type) AS data_type, count(*) FILTER (value IS NULL) AS nulls,
        count(DISTINCT value) AS unique_values FROM long JOIN kinds USING (column_name) GROUP BY column_name""",
    ),
    "date_range": (
        "",
        f"""SELECT {_iso('min("timestamp")')} AS first_seen, {_iso('max("timestamp")')} AS last_seen,
        date_sub('day', min("timestamp"), max("timestamp")) AS whole_days FROM reports""",
    ),
    "peak_times": (
        """parts AS (SELECT 'hour' AS part, hr AS value FROM reports UNION ALL SELECT 'day_of_week', dow FROM reports
          UNION ALL SELECT 'month', mon FROM reports),
        counts AS (SELECT part, value, count(*) AS cases FROM parts GROUP BY ALL),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY cases DESC, value) AS position FROM counts)""",
        "SELECT part, CAST(position AS INTEGER) AS position, value, cases FROM ranked WHERE position <= 3",
    ),
    "city_stats": (
        "",
        f"""SELECT complaint_city AS city, count(*) AS incidents, {rnd(_mean("risk_score", 1) + " / 100.0::DOUBLE", 2)} AS risk_score
        FROM complaints GROUP BY complaint_city ORDER BY incidents DESC, city LIMIT 10""",
    ),
    "city_stats_by_state": (
        "",
        f"""SELECT complaint_city AS city, complaint_state AS state, count(*) AS incidents,
        {rnd(_mean("risk_score", 1) + " / 100.0::DOUBLE", 2)} AS risk_score
        FROM complaints GROUP BY complaint_city, complaint_state ORDER BY incidents DESC, city, state LIMIT 10""",
    ),
    "state_stats": (
        "",
        f"""SELECT complaint_state AS state, count(*) AS cases, {rnd(_SUM, 2)} AS total_loss, {rnd(_mean("amount_lost", 2), 2)} AS avg_loss,
        {rnd(_mean("risk_score", 1), 2)} AS avg_risk, {rnd(_mean("withdrawal_probability", 3), 2)} AS avg_withdrawal_prob
        FROM complaints GROUP BY complaint_state ORDER BY cases DESC, state LIMIT 10""",
    ),
    "state_distribution": (
        "",
        f"""SELECT complaint_state AS state, count(*) AS incidents, {rnd(_SUM + " / 10000000.0::DOUBLE", 2)} AS amount_lost,
        {rnd(_mean("risk_score", 1) + " / 100.0::DOUBLE", 2)} AS risk_score
        FROM complaints GROUP BY complaint_state ORDER BY incidents DESC, state LIMIT 10""",
    ),
    "high_risk_zones": (
        "",
        "SELECT complaint_state AS state, count(*) AS incidents FROM complaints GROUP BY state ORDER BY incidents DESC, state LIMIT 3",
    ),
    "crime_type_analysis": (
        "",
        f"""SELECT crime_type, count(*) AS cases, {rnd("count(*) * 100.0::DOUBLE / (SELECT count(*) FROM complaints)", 1)} AS percentage,
        {rnd(_SUM + " / count(*)", 0)} AS avg_amount, count(DISTINCT complaint_state) AS states_affected
        FROM complaints GROUP BY crime_type""",
    ),
    "bank_incidents": (
        "",
        f"""SELECT bank_involved AS bank, count(*) AS incidents, {rnd(_SUM + " / 10000000.0::DOUBLE", 1)} AS amount
        FROM reports GROUP BY bank_involved ORDER BY incidents DESC, bank LIMIT 6""",
    ),
    "month_counts": ("", 'SELECT mon AS "month", count(*) AS cases FROM reports GROUP BY mon'),
    "summary_row": (
        "",
        f"""SELECT count(*) AS total_cases, {rnd(_SUM + " / 10000000.0::DOUBLE", 2)} AS total_amount_lost,
        count(DISTINCT complaint_state) AS states_covered, {rnd(_SUM + " / count(*)", 0)} AS avg_case_value FROM complaints""",
    ),
    "weekly_trend": (
        "days(day_of_week, label) AS (VALUES (0, 'Mon'), (1, 'Tue'), (2, 'Wed'), (3, 'Thu'), (4, 'Fri'), (5, 'Sat'), (6, 'Sun'))",
        """SELECT d.day_of_week, d.label, count(r.dow) AS complaints, count(r.dow) FILTER (r.urgency_level = 'High') AS high_risk
        FROM days d LEFT JOIN reports r ON r.dow = d.day_of_week GROUP BY ALL""",
    ),
    "hourly_distribution": (
        "",
        """SELECT lpad(CAST(h.range AS VARCHAR), 2, '0') || ':00' AS "hour", count(r.hr) AS cases
        FROM range(24) h LEFT JOIN reports r ON r.hr = h.range GROUP BY ALL""",
    ),
    "monthly_trend": (
        """months AS (SELECT CAST(DATE '2024-03-01' - to_months(CAST(range AS INTEGER)) AS DATE) AS m FROM range(12)),
        counts AS (SELECT CAST(date_trunc('month', "timestamp") AS DATE) AS m, count(*) AS n,
          count(*) FILTER (urgency_level = 'High') AS h, """
        + rnd(_SUM + " / 10000000.0::DOUBLE", 1)
        + """ AS a FROM reports WHERE "timestamp" < DATE '2024-04-01' GROUP BY 1)""",
        """SELECT strftime(m, '%b %Y') AS "month", coalesce(n, 0) AS total_cases, coalesce(h, 0) AS high_risk,
        coalesce(a, 0.0::DOUBLE) AS amount_lost FROM months LEFT JOIN counts USING (m)""",
    ),
    "growth": (
        """counts AS (SELECT crime_type, CAST(date_trunc('week', "timestamp") AS DATE) AS w, count(*) AS cases FROM reports GROUP BY ALL)""",
        f"""SELECT c.crime_type, strftime(c.w, '%Y-%m-%d') AS period_start, c.cases, b.cases AS previous_cases,
        {rnd("(c.cases - b.cases) * 100.0::DOUBLE / b.cases", 1)} AS growth_percent
        FROM counts c LEFT JOIN counts b ON b.crime_type = c.crime_type AND b.w = c.w - 7""",
    ),
    "correlations": (
        f"pairs AS ({_corr_rows()})",
        f"SELECT target, feature, {rnd('r', 6)} AS r FROM pairs WHERE r IS NOT NULL AND NOT isnan(r) AND abs(r) > 0.1",
    ),
    "geo_error": (
        f"measured AS (SELECT {rnd(_DIST, 4)} AS km, {_DIST} AS d FROM complaints)",
        f"""SELECT {rnd("avg(km)", 4)} AS mean_km, {rnd("median(km)", 4)} AS median_km,
        {rnd("avg(CAST(d <= 0.5 AS DOUBLE)) * 100", 4)} AS within_0_5_km_pct, {rnd("avg(CAST(d <= 1 AS DOUBLE)) * 100", 4)} AS within_1_km_pct,
        {rnd("avg(CAST(d <= 5 AS DOUBLE)) * 100", 4)} AS within_5_km_pct, {rnd("avg(CAST(d <= 25 AS DOUBLE)) * 100", 4)} AS within_25_km_pct
        FROM measured""",
    ),
    "regression_metrics": (
        f"guessed AS (SELECT withdrawal_probability AS y1, risk_score AS y2, {_rule()} AS p1, ({_rule()}) * 100 AS p2 FROM complaints)",
        f"""SELECT {rnd("((1 - sum((y1 - p1) ** 2) / (var_pop(y1) * count(*))) + (1 - sum((y2 - p2) ** 2) / (var_pop(y2) * count(*)))) / 2", 6)} AS r2,
        {rnd("(avg((y1 - p1) ** 2) + avg((y2 - p2) ** 2)) / 2", 6)} AS mse,
        {rnd("(avg(abs(y1 - p1)) + avg(abs(y2 - p2))) / 2", 6)} AS mae FROM guessed""",
    ),
    "classification_metrics": (
        f"""guessed AS (SELECT withdrawal_probability > 0.8::DOUBLE AS y, {_rule()} > 0.3::DOUBLE AS p FROM complaints),
        counted AS (SELECT count(*) FILTER (y AND p) AS tp, count(*) FILTER (NOT y AND p) AS fp, count(*) FILTER (y AND NOT p) AS fn FROM guessed)""",
        f"""SELECT {rnd("coalesce(2 * tp / CAST(nullif(2 * tp + fp + fn, 0) AS DOUBLE), 0)", 9)} AS f1_score,
        {rnd("coalesce(tp / CAST(nullif(tp + fp, 0) AS DOUBLE), 0)", 9)} AS precision_score,
        {rnd("coalesce(tp / CAST(nullif(tp + fn, 0) AS DOUBLE), 0)", 9)} AS recall_score FROM counted""",
    ),
    "contract": ("", _contract_rows()),
    "content_checks": (
        "",
        "SELECT count(*) AS checked_rows, "
        + ", ".join(f"count(*) FILTER (NOT {c}) AS {n}" for n, c in zip(_RULE_NAMES, _RISK_VIOLATION))
        + ", count(*) FILTER (amount_lost <= 0) AS amount_not_positive, "
        + "count(*) FILTER (NOT ("
        + " AND ".join(_RISK_VIOLATION)
        + ") OR amount_lost <= 0) = 0 AS ok FROM complaints",
    ),
    "quarantine": (
        "",
        "SELECT complaint_id, concat_ws(',', "
        + ", ".join(f"CASE WHEN NOT {c} THEN '{n}' END" for n, c in zip(_RULE_NAMES, _RISK_VIOLATION))
        + ", CASE WHEN amount_lost <= 0 THEN 'amount_not_positive' END) AS violations FROM complaints WHERE NOT ("
        + " AND ".join(_RISK_VIOLATION)
        + ") OR amount_lost <= 0",
    ),
    "valid_rows": (
        "",
        "SELECT complaint_id, amount_lost FROM complaints WHERE " + " AND ".join(_RISK_VIOLATION) + " AND amount_lost > 0",
    ),
    "mean_drift": (
        f"""long AS (SELECT column_name, value, test FROM ({" UNION ALL ".join(
            f"SELECT {_text(c)} AS column_name, {c} AS value, {_TEST} AS test FROM complaints" for c in contract.DRIFT_COLUMNS
            if c in contract.RAW_COLUMNS)})),
        means AS (SELECT column_name, avg(value) FILTER (NOT test) AS b, avg(value) FILTER (test) AS c FROM long GROUP BY column_name)""",
        f"""SELECT column_name, {rnd("b", 6)} AS base_mean, {rnd("c", 6)} AS current_mean, {rnd("abs(c - b) / abs(b)", 9)} AS drift_ratio,
        abs(c - b) / abs(b) > 0.001::DOUBLE AS drift_detected FROM means WHERE b <> 0""",
    ),
    "ks_drift": (
        f"""long AS (SELECT column_name, value, test FROM ({" UNION ALL ".join(
            f"SELECT {_text(c)} AS column_name, CAST({e} AS DOUBLE) AS value, {_TEST} AS test FROM complaints" for c, e in _KS_COLUMNS)})),
        counts AS (SELECT column_name, value, count(*) FILTER (NOT test) AS b, count(*) FILTER (test) AS c FROM long GROUP BY ALL),
        running AS (SELECT column_name, sum(b) OVER w AS b_upto, sum(c) OVER w AS c_upto,
          sum(b) OVER (PARTITION BY column_name) AS nb, sum(c) OVER (PARTITION BY column_name) AS nc FROM counts
          WINDOW w AS (PARTITION BY column_name ORDER BY value)),
        ks AS (SELECT column_name, CAST(max(nb) AS BIGINT) AS nb, CAST(max(nc) AS BIGINT) AS nc,
          max(abs(b_upto / CAST(nb AS DOUBLE) - c_upto / CAST(nc AS DOUBLE))) AS d FROM running GROUP BY column_name),
        tails AS (SELECT column_name, nb, nc, d, sum(CASE WHEN k.range % 2 = 1 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END
          * exp(-2.0::DOUBLE * k.range * k.range * d * d * (CAST(nb AS DOUBLE) * nc / (nb + nc)))) AS tail,
          d * d * (CAST(nb AS DOUBLE) * nc / (nb + nc)) AS x2 FROM ks, range(1, 102) k GROUP BY ALL),
        p AS (SELECT *, CASE WHEN x2 < 0.04 THEN 1.0::DOUBLE ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, 2 * tail)) END AS pv FROM tails)""",
        f"""SELECT column_name, nb AS base_rows, nc AS current_rows, {rnd("d", 9)} AS ks_statistic, {rnd("pv", 6)} AS p_value,
        pv < 0.05::DOUBLE AS drift_detected FROM p""",
    ),
    "split": ("", f"SELECT complaint_id, CASE WHEN {_TEST} THEN 'test' ELSE 'train' END AS split FROM reports"),
    "bulk_score": (_scored(_rule(), 0.6, 0.3), f"SELECT {_RESULT} FROM scored"),
    "bulk_high_risk": (
        _scored(_rule(), 0.6, 0.5),
        "SELECT count(*) AS processed, count(*) FILTER (risk_level = 'HIGH') AS high_risk_count FROM scored",
    ),
    "result_page": (
        _SCORED,
        f"""SELECT complaint_id, {rnd("predicted_withdrawal_lat", 6)} AS predicted_withdrawal_lat,
        {rnd("predicted_withdrawal_lng", 6)} AS predicted_withdrawal_lng, withdrawal_probability, risk_level
        FROM scored ORDER BY complaint_id LIMIT 10""",
    ),
    "single_score": (
        _scored(_rule("0", "2"), 0.7, 0.4, stamp="TIMESTAMP '2024-01-31 00:00:00'"),
        f"SELECT {_RESULT} FROM scored",
    ),
    "heatmap": (
        f"{_SCORED}, {_cells(2)}",
        _CELL.format(where="WHERE \"timestamp\" BETWEEN TIMESTAMP '2024-01-17 00:00:00' AND TIMESTAMP '2024-01-31 00:00:00'"),
    ),
    "heatmap_city": (f"{_SCORED}, {_cells(1)}", _CELL.format(where="WHERE complaint_city = 'NATION_2'")),
    "recent_counts": (
        _SCORED,
        """SELECT count(*) AS predictions, count(*) FILTER (risk_level = 'HIGH') AS high_risk FROM scored
        WHERE "timestamp" BETWEEN TIMESTAMP '2024-01-24 00:00:00' AND TIMESTAMP '2024-01-31 00:00:00'""",
    ),
    "rolling_heatmap": (
        f"{_SCORED}, {_cells(2)}",
        f"""SELECT strftime(CAST("timestamp" AS DATE) - CAST(b.range AS INTEGER), '%Y-%m-%d') AS window_start, lat, lng,
        {_CELL_RISK} AS risk_score, count(*) AS incident_count FROM cells, range(30) b GROUP BY 1, lat, lng""",
    ),
    "rolling_counts": (
        _SCORED,
        """SELECT strftime(CAST("timestamp" AS DATE) - CAST(b.range AS INTEGER), '%Y-%m-%d') AS window_start, count(*) AS predictions,
        count(*) FILTER (risk_level = 'HIGH') AS high_risk FROM scored, range(7) b GROUP BY 1""",
    ),
    "alerts": (
        _SCORED,
        f"""SELECT {_ALERT_ID} AS alert_id, complaint_id, 'high_risk' AS alert_type, {_MESSAGE} AS message,
        {rnd("predicted_withdrawal_lat", 6)} AS lat, {rnd("predicted_withdrawal_lng", 6)} AS lng, {_iso('"timestamp"')} AS "timestamp",
        'HIGH' AS severity FROM scored WHERE risk_level = 'HIGH'""",
    ),
    "alert_routing": (
        f"{_SCORED}, raised AS (SELECT {_ALERT_ID} AS alert_id, {_ROLE} AS role FROM scored WHERE risk_level = 'HIGH')",
        "SELECT alert_id, r.recipient FROM raised JOIN (VALUES ('lea'), ('bank')) r(recipient) ON role = recipient OR role = 'other'",
    ),
    "notifications": (
        _SCORED,
        f"""SELECT {_ALERT_ID} AS alert_id, complaint_id, 'high_risk' AS alert_type, {_MESSAGE} AS message, 'HIGH' AS severity,
        {_ROLE} AS recipient_role, {_iso('scored."timestamp"')} AS "timestamp", 'pending' AS status
        FROM scored WHERE risk_level = 'HIGH' ORDER BY scored."timestamp" DESC, alert_id LIMIT 50""",
    ),
    "json_records": (
        "",
        "SELECT CAST(to_json({'complaint_id': complaint_id, 'crime_type': crime_type, 'amount_lost': amount_lost, 'status': status}) AS VARCHAR) AS record FROM reports",
    ),
    "csv_json_roundtrip": ("", f"{_roundtrip('json')} UNION ALL {_roundtrip('csv')}"),
    "ingest_roundtrip": (
        "",
        f"""SELECT complaint_id, {_iso('"timestamp"')} AS "timestamp", amount_lost, {_PRIORITY} AS alert_priority, hr AS "hour", dow AS day_of_week
        FROM gappy WHERE amount_lost IS NOT NULL""",
    ),
    "sink_roundtrip": (
        "",
        f"""SELECT count(*) FILTER (urgency_level = 'High') AS high, count(*) FILTER (urgency_level = 'Medium') AS medium,
        count(*) FILTER (urgency_level = 'Low') AS low, count(*) AS total, count(*) FILTER (NOT ({_TEST})) AS appended FROM complaints""",
    ),
    "prediction_log": (
        _SCORED,
        f"""SELECT complaint_id, {_iso('"timestamp"')} AS "timestamp", amount_lost, withdrawal_probability,
        strftime("timestamp", '%Y-%m-%d') AS log_date, 'rules-1' AS model_version FROM scored
        WHERE "timestamp" BETWEEN TIMESTAMP '2024-01-21 00:00:00' AND TIMESTAMP '2024-01-31 00:00:00'
        AND complaint_city = 'NATION_2' AND risk_level = 'HIGH'""",
    ),
    "bulk_output": (_scored(_rule(), 0.6, 0.3), "SELECT complaint_id, withdrawal_probability, risk_level FROM scored"),
}

_PLAIN = ("complaint_lat", "complaint_lng", "predicted_withdrawal_lat", "predicted_withdrawal_lng", "hr", "dow")


def _gap(columns) -> str:
    return " + ".join(f"(q.{c} - d.{c}) * (q.{c} - d.{c})" for c in columns)


_OLS = "regr_slope(risk_score, amount_lost) AS slope, regr_intercept(risk_score, amount_lost) AS intercept"
_MATRIX = (
    "amount_lost + complaint_lat + complaint_lng + predicted_withdrawal_lat + predicted_withdrawal_lng + "
    f"{_DIST} + hr + dow + {_WEEKEND} + {_PEAK} + 0 + {_NIGHT} + {_BUSINESS} + coalesce(CAST({_AMOUNT_LEVEL} AS DOUBLE), avg({_AMOUNT_LEVEL}) OVER ())"
)

BODIES |= {
    "knn_impute": (
        f"""near AS (SELECT q.complaint_id, d.amount_lost, row_number() OVER (PARTITION BY q.complaint_id
          ORDER BY {_gap(_PLAIN)}, d.complaint_id) AS i
          FROM gappy q, gappy d WHERE q.amount_lost IS NULL AND d.amount_lost IS NOT NULL AND NOT ({_draw("split", "d.complaint_id")} < 0.2::DOUBLE)),
        fills AS (SELECT complaint_id, avg(amount_lost) AS fill FROM near WHERE i <= 5 GROUP BY complaint_id)""",
        f"SELECT complaint_id, {rnd('coalesce(amount_lost, fill)', 4)} AS amount_lost FROM gappy LEFT JOIN fills USING (complaint_id)",
    ),
    "knn_regress": (
        f"""near AS (SELECT q.complaint_id, d.withdrawal_probability AS p, d.risk_score AS s, row_number() OVER (PARTITION BY q.complaint_id
          ORDER BY {_gap(("amount_lost", *_PLAIN))}, d.complaint_id) AS i
          FROM complaints q, complaints d WHERE {_draw("split", "q.complaint_id")} < 0.2::DOUBLE AND NOT ({_draw("split", "d.complaint_id")} < 0.2::DOUBLE)
          QUALIFY i <= 5)""",
        f"""SELECT complaint_id, {rnd("avg(p)", 6)} AS withdrawal_probability_hat, {rnd("avg(s)", 6)} AS risk_score_hat
        FROM near GROUP BY complaint_id""",
    ),
    "feature_frame": (
        "",
        f"SELECT complaint_id, CAST(14 AS INTEGER) AS width, {rnd(_MATRIX, 3)} AS feature_sum, withdrawal_probability, risk_score FROM complaints",
    ),
    "ols_single": (
        f"line AS (SELECT {_OLS} FROM complaints)",
        f"SELECT {rnd('slope', 10)} AS slope, {rnd('intercept', 6)} AS intercept FROM line",
    ),
    "model_roundtrip": (
        f"line AS (SELECT {_OLS} FROM complaints)",
        f"SELECT complaint_id, {rnd('intercept + slope * amount_lost', 4)} AS prediction FROM complaints, line",
    ),
}

# what bulk scoring makes of a model's probability
_BY_MODEL = f"""SELECT complaint_id, {rnd("p", 3)} AS withdrawal_probability,
        CAST(greatest(1, least(trunc(24 - raw * 48), 72)) AS INTEGER) AS predicted_hours_to_withdrawal,
        CASE WHEN p > 0.7 THEN 'HIGH' WHEN p > 0.4 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level,
        {rnd("least(p * 1.1::DOUBLE, 1.0::DOUBLE)", 3)} AS confidence_score, {rnd("1.0::DOUBLE + 4.0::DOUBLE * (1 - p)", 1)} AS alert_radius_km
        FROM (SELECT complaint_id, raw, greatest(0.1::DOUBLE, least(raw, 0.99::DOUBLE)) AS p FROM guessed)"""

BODIES |= {
    "alerts_stream": (
        _SCORED,
        f"""SELECT {_ALERT_ID} AS alert_id, complaint_id, {_MESSAGE} AS message, {_iso('"timestamp"')} AS "timestamp",
        'HIGH' AS severity FROM scored WHERE risk_level = 'HIGH'""",
    ),
    "alert_routing_stream": (
        _SCORED,
        f"SELECT {_ALERT_ID} AS alert_id, complaint_id FROM scored WHERE risk_level = 'HIGH' AND {_ROLE} IN ('bank', 'other')",
    ),
    "alert_log": BODIES["notifications"],
    "notification_log": BODIES["notifications"],
    "rolling_heatmap_stream": BODIES["rolling_heatmap"],
    "rolling_counts_stream": BODIES["rolling_counts"],
}

# What is no number counts as missing, and what depends on a missing input is missing.
_DAMAGED = """damaged AS (SELECT * REPLACE (
    CASE WHEN event_id % 17 > 1 THEN amount_lost END AS amount_lost, CASE WHEN event_id % 13 > 1 THEN complaint_lat END AS complaint_lat,
    CASE WHEN event_id % 11 > 1 THEN predicted_withdrawal_lng END AS predicted_withdrawal_lng,
    CASE WHEN event_id % 7 <> 0 THEN "timestamp" END AS "timestamp") FROM complaints)"""
_DAMAGED_P = f"""{_DAMAGED}, ruled AS (SELECT *,
    CASE WHEN amount_lost IS NOT NULL AND complaint_lat IS NOT NULL AND "timestamp" IS NOT NULL THEN {_rule()} END AS p,
    CASE WHEN amount_lost IS NOT NULL THEN (least(amount_lost / 200000.0::DOUBLE, 1.0::DOUBLE) + {_urgency(0.8, 0.5, 0.2)}) / 2 END AS base
    FROM damaged)"""

BODIES |= {
    "json_array_roundtrip": ("", f"""SELECT complaint_id, {_iso('"timestamp"')} AS "timestamp", crime_type, amount_lost, status FROM complaints"""),
    "score_gappy": (
        _DAMAGED_P,
        f"""SELECT complaint_id, {rnd("p", 3)} AS withdrawal_probability,
        CASE WHEN p > 0.8 THEN 2 WHEN p > 0.6 THEN 6 WHEN p > 0.4 THEN 12 WHEN p IS NOT NULL THEN 24 END AS hours_from,
        CASE WHEN p > 0.8 THEN 8 WHEN p > 0.6 THEN 18 WHEN p > 0.4 THEN 36 WHEN p IS NOT NULL THEN 72 END AS hours_before,
        CASE WHEN p > 0.7 THEN 'HIGH' WHEN p > 0.4 THEN 'MEDIUM' WHEN p IS NOT NULL THEN 'LOW' END AS risk_level,
        CASE WHEN p IS NOT NULL THEN {rnd("least(p * 1.1::DOUBLE, 1.0::DOUBLE)", 3)} END AS confidence_score,
        {rnd("base", 9)} AS base_risk,
        CASE WHEN base IS NOT NULL THEN CAST(greatest(1, least(trunc(24 - base * 48), 72)) AS INTEGER) END AS model_hours,
        CASE WHEN amount_lost > 100000 THEN 2 WHEN amount_lost > 50000 THEN 1 ELSE 0 END AS serving_level,
        CASE WHEN amount_lost IS NOT NULL THEN {_AMOUNT_LEVEL} END AS amount_level,
        {_flag("coalesce(amount_lost > 50000, false) OR urgency_level = 'High'")} AS bank_alert,
        CASE WHEN amount_lost >= 100000 THEN 'High' ELSE 'Low' END AS priority FROM ruled""",
    ),
    "distance_gappy": (
        _DAMAGED,
        f"""SELECT complaint_id,
        CASE WHEN complaint_lat IS NOT NULL AND predicted_withdrawal_lng IS NOT NULL THEN {rnd(_DIST, 4)} END AS distance_km,
        CASE WHEN complaint_lat IS NULL THEN NULL WHEN {_CITY} < 0.5::DOUBLE THEN 1.1::DOUBLE
             WHEN {_CITY} < 1.0::DOUBLE THEN 1.05::DOUBLE ELSE 1.0::DOUBLE END AS city_factor FROM damaged""",
    ),
    "alerts_gappy": (_DAMAGED_P, f"SELECT {_ALERT_ID} AS alert_id, complaint_id, 'HIGH' AS severity FROM ruled WHERE p > 0.5::DOUBLE"),
}


def _by_day(digits: int) -> tuple[str, str]:
    return (
        "",
        f"""SELECT complaint_id, {rnd("avg(withdrawal_probability) OVER d", digits)} AS withdrawal_probability_hat,
        {rnd("avg(risk_score) OVER d", digits)} AS risk_score_hat FROM complaints WINDOW d AS (PARTITION BY dow)""",
    )


def _ridge_line(target: str, alpha: float) -> str:
    slope = f"regr_sxy({target}, amount_lost) / (regr_sxx({target}, amount_lost) + {_num(alpha)})"
    return f"{slope} AS slope_{target}, avg({target}) - {slope} * avg(amount_lost) AS base_{target}"


def _fold_score(target: str) -> str:
    error = f"sum(({target} - base_{target} - slope_{target} * amount_lost) ** 2)"
    return f"1 - {error} / (var_pop({target}) * count(*))"


BODIES |= {
    "ridge_single": (
        f"line AS (SELECT {', '.join(_ridge_line(t, 10.0) for t in contract.TARGETS)} FROM complaints)",
        "SELECT complaint_id, " + ", ".join(f"{rnd(f'base_{t} + slope_{t} * amount_lost', 6)} AS {t}_hat" for t in contract.TARGETS) + " FROM complaints, line",
    ),
    "tree_by_day": _by_day(6),
    "forest_by_day": _by_day(6),
    "boosting_by_day": _by_day(4),
    "cross_validation": (
        f"""folded AS (SELECT *, {_hash("complaint_id", "fold")} % 3 AS fold FROM complaints),
        lines AS (SELECT k.fold, {', '.join(_ridge_line(t, 0.0) for t in contract.TARGETS)}
          FROM (VALUES (0), (1), (2)) k(fold) JOIN folded f ON f.fold <> k.fold GROUP BY k.fold),
        scores AS (SELECT fold, ({_fold_score("withdrawal_probability")} + {_fold_score("risk_score")}) / 2 AS r2 FROM folded JOIN lines USING (fold) GROUP BY fold)""",
        f"SELECT {rnd('avg(r2)', 6)} AS cv_r2 FROM scores",
    ),
    "model_bulk_score": (
        f"""line AS (SELECT regr_slope(withdrawal_probability, amount_lost) AS slope, regr_intercept(withdrawal_probability, amount_lost) AS base
          FROM complaints WHERE NOT ({_TEST})),
        guessed AS (SELECT complaint_id, base + slope * amount_lost AS raw FROM complaints, line)""",
        _BY_MODEL,
    ),
    # gaps of the amount: the mean of the first five training rows by distance of the hour
    "model_bulk_score_gaps": (
        f"""hours AS (SELECT DISTINCT hr AS h FROM gappy),
        near AS (SELECT h, amount_lost, row_number() OVER (PARTITION BY h ORDER BY abs(h - hr), complaint_id) AS i
          FROM hours, gappy WHERE amount_lost IS NOT NULL AND NOT ({_TEST})),
        fills AS (SELECT h AS hr, avg(amount_lost) AS fill FROM near WHERE i <= 5 GROUP BY h),
        filled AS (SELECT complaint_id, coalesce(amount_lost, fill)::DOUBLE AS a, hr::DOUBLE AS b, withdrawal_probability AS y FROM gappy JOIN fills USING (hr)),
        sums AS (SELECT avg(a) AS ma, avg(b) AS mb, avg(y) AS my, var_pop(a) AS aa, var_pop(b) AS bb, covar_pop(a, b) AS ab, covar_pop(a, y) AS ay, covar_pop(b, y) AS byy
          FROM filled WHERE NOT ({_TEST})),
        plane AS (SELECT ma, mb, my, (ay * bb - byy * ab) / (aa * bb - ab * ab) AS ka, (byy * aa - ay * ab) / (aa * bb - ab * ab) AS kb FROM sums),
        guessed AS (SELECT complaint_id, my + ka * (a - ma) + kb * (b - mb) AS raw FROM filled, plane)""",
        _BY_MODEL,
    ),
}


_POISSON = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999897508033253, 0.999998874797402]


def _search(learners: tuple[str, ...], rounds: int = 100) -> str:
    """CTEs: what every candidate guesses for each level, its cross-validated R2, and the scores of the chosen."""
    draw = "CAST(('0x' || substr(md5(complaint_id || 'bag' || CAST(j // 4 AS VARCHAR)), 1 + 7 * (j % 4), 7)) AS BIGINT) / 268435456.0::DOUBLE"
    bag = "CASE " + " ".join(f"WHEN u < {_num(p)} THEN {i}" for i, p in enumerate(_POISSON)) + f" ELSE {len(_POISSON)} END"
    guesses = {
        "Random Forest": """SELECT 'Random Forest' AS model, 2 * c + d AS position, printf('{"max_depth": %d, "n_estimators": %d}', 10 + 10 * d, 50 + 50 * c) AS params, h, t, x,
          avg(m) FILTER (j < 50 + 50 * c) AS p FROM bagged, range(2) a(c), range(2) b(d) GROUP BY ALL""",
        "Gradient Boosting": """SELECT 'Gradient Boosting', 2 * c + d, printf('{"learning_rate": %.1f, "n_estimators": %d}', 0.1 + 0.1 * d, 50 + 50 * c), h, t, x,
          mean + (1 - (1 - (0.1::DOUBLE + 0.1::DOUBLE * d)) ** (50 + 50 * c)) * (m - mean) FROM levels JOIN lines USING (h, t), range(2) a(c), range(2) b(d)""",
        "Linear Regression": "SELECT 'Linear Regression', 0, '{}', h, t, x, mean + sxy / sxx * (x - mean_x) FROM levels JOIN lines USING (h, t)",
        "Ridge Regression": """SELECT 'Ridge Regression', i, printf('{"alpha": %.1f}', alpha), h, t, x, mean + sxy / (sxx + alpha) * (x - mean_x)
          FROM levels JOIN lines USING (h, t), (VALUES (0, 1.0::DOUBLE), (1, 10.0::DOUBLE)) a(i, alpha)""",
        "Decision Tree": """SELECT 'Decision Tree', d, printf('{"max_depth": %d}', 10 + 10 * d), h, t, x, m FROM levels, range(2) b(d)""",
        "KNN": """SELECT 'KNN', d, printf('{"n_neighbors": %d}', 5 + 2 * d), h, t, x, avg(y) FILTER (near <= 5 + 2 * d)
          FROM (SELECT *, row_number() OVER (PARTITION BY h, t, x ORDER BY complaint_id) AS near FROM learnt), range(2) b(d) GROUP BY ALL""",
        "AdaBoost": """SELECT 'AdaBoost', c, printf('{"n_estimators": %d}', 50 + 50 * c), h, t, x, min(p) FILTER (upto >= 0.5 * total)
          FROM (SELECT *, sum(vote) OVER (PARTITION BY c, h, t, x ORDER BY p, round) AS upto, sum(vote) OVER (PARTITION BY c, h, t, x) AS total
            FROM members, range(2) a(c) WHERE round <= 50 + 50 * c) GROUP BY ALL""",
    }
    boosting = f""", weighted AS (
      SELECT h, t, x, y, count(*)::DOUBLE AS n, 1.0::DOUBLE AS w, 0 AS round, NULL::DOUBLE AS p, NULL::DOUBLE AS vote, true AS going FROM learnt GROUP BY h, t, x, y
      UNION ALL
      SELECT h, t, x, y, n, CASE WHEN fine THEN w * (loss / (1 - loss)) ** (1 - miss / worst) ELSE w END, round + 1, p,
        CASE WHEN fine THEN ln((1 - loss) / loss) WHEN round = 0 OR loss <= 0 THEN 1.0::DOUBLE END, fine
      FROM (SELECT *, loss > 0 AND loss < 0.5 AS fine FROM (
        SELECT *, sum(n * w * miss) OVER (PARTITION BY h, t) / worst / sum(n * w) OVER (PARTITION BY h, t) AS loss FROM (
          SELECT *, max(miss) OVER (PARTITION BY h, t) AS worst FROM (
            SELECT *, abs(p - y) AS miss FROM (
              SELECT h, t, x, y, n, w, round, sum(n * w * y) OVER (PARTITION BY h, t, x) / sum(n * w) OVER (PARTITION BY h, t, x) AS p
              FROM weighted WHERE going AND round < {rounds})))))),
    members AS (SELECT h, t, x, round, any_value(p) AS p, any_value(vote) AS vote FROM weighted WHERE round > 0 AND vote IS NOT NULL GROUP BY ALL)"""
    bagging = f""", bags AS (SELECT complaint_id, j, {bag} AS b FROM (SELECT complaint_id, j, {draw} AS u FROM folded, range(100) r(j) WHERE NOT test)),
    bagged AS (SELECT h, t, x, j, sum(b * y) / sum(b) AS m FROM learnt JOIN bags USING (complaint_id) GROUP BY ALL)"""
    scored = "1 - sum((y - p) ** 2) / (var_pop(y) * count(*))"
    return f"""folded AS (
      SELECT complaint_id, CAST({_AMOUNT_LEVEL} AS DOUBLE) AS x, {_TEST} AS test, {_hash("complaint_id", "fold")} % 3 AS fold,
        withdrawal_probability AS y1, risk_score AS y2 FROM complaints WHERE {_AMOUNT_LEVEL} IS NOT NULL),
    sides AS (SELECT complaint_id, x, test, fold, 1 AS t, y1 AS y FROM folded UNION ALL SELECT complaint_id, x, test, fold, 2, y2 FROM folded),
    learnt AS (SELECT h, sides.* FROM sides JOIN range(4) r(h) ON NOT test AND fold <> h),
    levels AS (SELECT h, t, x, avg(y) AS m FROM learnt GROUP BY ALL),
    lines AS (SELECT h, t, avg(y) AS mean, avg(x) AS mean_x, regr_sxy(y, x) AS sxy, regr_sxx(y, x) AS sxx FROM learnt GROUP BY ALL)
    {boosting if "AdaBoost" in learners else ""}{bagging if "Random Forest" in learners else ""},
    guessed(model, position, params, h, t, x, p) AS ({" UNION ALL ".join(guesses[m] for m in learners)}),
    validated AS (SELECT model, position, params, avg(r2) AS cv_r2 FROM (
      SELECT model, position, params, h, t, {scored} AS r2 FROM guessed JOIN sides USING (t, x) WHERE NOT test AND fold = h GROUP BY ALL) GROUP BY ALL),
    chosen AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY round(cv_r2, 9) DESC, position) = 1 AS chosen FROM validated),
    figures AS (
      SELECT model, params, test, avg(r2) AS r2, avg(mse) AS mse, avg(mae) AS mae FROM (
        SELECT model, params, test, t, {scored} AS r2, avg((y - p) ** 2) AS mse, avg(abs(y - p)) AS mae
        FROM chosen JOIN guessed USING (model, position, params) JOIN sides USING (t, x) WHERE chosen AND h = 3 GROUP BY ALL) GROUP BY ALL),
    judged AS (
      SELECT a.model, a.params, a.r2 AS train_r2, a.mse AS train_mse, a.mae AS train_mae, b.r2 AS test_r2, b.mse AS test_mse, b.mae AS test_mae,
        b.r2 < 0.9 AS below_expected, a.r2 - b.r2 > 0.05 AS overfit, row_number() OVER (ORDER BY round(b.r2, 6) DESC, a.model) = 1 AS best
      FROM figures a JOIN figures b USING (model) WHERE NOT a.test AND b.test)"""


_LEARNERS = ("Random Forest", "Gradient Boosting", "Linear Regression", "Ridge Regression", "Decision Tree", "KNN", "AdaBoost")
_FIGURES = ("cv_r2", "train_r2", "train_mse", "train_mae", "test_r2", "test_mse", "test_mae")
BODIES |= {
    "model_search": (
        _search(_LEARNERS),
        f"""SELECT c.model, c.params, c.chosen, {', '.join(f'{rnd(f, 6)} AS {f}' for f in _FIGURES)}, below_expected, overfit, best
        FROM chosen c LEFT JOIN judged j ON c.model = j.model AND c.chosen""",
    ),
    "run_history": (
        _search(("Decision Tree", "Ridge Regression", "Linear Regression")[::-1]),
        f"""SELECT run_ts, count(*) AS models, {', '.join(f"arg_max({c}, {{'a': round(test_r2, 6), 'b': model}}) AS {c}" for c in ("model", "params"))},
        {rnd("max(test_r2)", 6)} AS test_r2, {', '.join(f"arg_max({c}, {{'a': round(test_r2, 6), 'b': model}}) AS {c}" for c in ("below_expected", "overfit"))}
        FROM judged, (VALUES ('2024-01-30'), ('2024-01-31')) r(run_ts) WHERE run_ts = '2024-01-31' OR model <> 'Decision Tree' GROUP BY run_ts""",
    ),
}


def oracle_sql() -> dict[str, str]:
    found = {}
    for name, (extra, select) in BODIES.items():
        ctes = COMPLAINTS + (", " + extra if extra else "")
        found[name] = f"WITH RECURSIVE {ctes} {select}"
    return found
