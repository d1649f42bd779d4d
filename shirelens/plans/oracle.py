"""ANSI SQL twins of the registered queries, for DuckDB over the same tables."""

from __future__ import annotations

import re

from ..functions.scores import DEFAULT_LINK_COLOR, FEATURE_LABELS, LINK_COLORS
from .shapes import MEASURES, PRIORITIES

SQL: dict[str, str] = {}


def rnd(expr: str, digits: int | str) -> str:
    """Half-up rounding of a double's decimal text; rounding the scaled double would move some ties."""
    return f"CAST(round(CAST(CAST({expr} AS VARCHAR) AS DECIMAL(38, 18)), {digits}) AS DOUBLE)"


def half_up(sql: str) -> str:
    """Write every ``round(x, n)`` of a query as :func:`rnd`."""
    out, i = "", 0
    while (j := sql.find("round(", i)) >= 0:
        depth, k = 1, j + 6
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[k], 0)
            k += 1
        body = half_up(sql[j + 6:k - 1])
        if re.search(r", \d+$", body) and (j == 0 or not sql[j - 1].isalnum()):
            expr, digits = body.rsplit(", ", 1)
            out += sql[i:j] + rnd(expr, digits)
        else:
            out += sql[i:j] + f"round({body})"
        i = k
    return out + sql[i:]

# --- shared shapes ---------------------------------------------------------------------------------------------

CUST = """cust AS (SELECT *, pop - male AS female, pop - workers AS non_workers, workers // 2 AS main_workers FROM (
  SELECT *, pop * (45 + c_custkey % 10) // 100 AS male, pop * (40 + c_custkey % 50) // 100 AS literate,
    pop // 5 + 1 AS households, pop * (30 + c_custkey % 30) // 100 AS workers
  FROM (SELECT *, CAST(floor(abs(c_acctbal)) AS BIGINT) + 100 AS pop FROM customer)))"""

RATIOS = """CASE WHEN total_population > 0 THEN round(literate_population / total_population * 100.0, 2) ELSE 0.0 END AS literacy_rate,
  CASE WHEN male_population > 0 THEN round(female_population / male_population * 1000.0, 2) ELSE 0.0 END AS sex_ratio,
  CASE WHEN total_population > 0 THEN round(female_population / total_population * 1.0, 4) ELSE 0.0 END AS female_ratio,
  CASE WHEN total_population > 0 THEN round(urban_population / total_population * 100.0, 2) ELSE 0.0 END AS urban_pct,
  CASE WHEN total_population > 0 THEN round(total_workers / total_population * 100.0, 2) ELSE 0.0 END AS work_participation_rate"""

CUST_PROFILE = CUST + f""", cprof AS (SELECT *, {RATIOS} FROM (SELECT c_custkey AS region, pop AS total_population, male AS male_population,
  female AS female_population, literate AS literate_population, households, workers AS total_workers, main_workers, non_workers,
  pop * (c_custkey % 100) // 100 AS urban_population, pop - pop * (c_custkey % 100) // 100 AS rural_population FROM cust))"""

_SUMS = {"total_population": "pop", "male_population": "male", "female_population": "female", "literate_population": "literate",
         "households": "households", "total_workers": "workers", "main_workers": "main_workers", "non_workers": "non_workers"}


def _slice(area: str, src: str, out: str) -> str:
    return f"CAST(coalesce(sum(CASE WHEN area = '{area}' AND (blk OR NOT has_block) THEN {src} END), 0) AS BIGINT) AS {out}"


NATION_PROFILE = CUST + f""", census AS (SELECT *, c_nationkey AS region, NOT (c_nationkey % 6 = 0 OR c_acctbal < 0) AS blk,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'Urban' WHEN 'FURNITURE' THEN 'Rural' ELSE 'Total' END AS area FROM cust),
flagged AS (SELECT *, max(CASE WHEN blk AND area = 'Total' THEN 1 ELSE 0 END) OVER (PARTITION BY region) = 1 AS has_block FROM census),
nprof AS (SELECT *, {RATIOS} FROM (SELECT region, {', '.join(_slice('Total', s, o) for o, s in _SUMS.items())},
  {_slice('Urban', 'pop', 'urban_population')}, {_slice('Rural', 'pop', 'rural_population')} FROM flagged GROUP BY region)
  WHERE total_population > 0)"""

_FLAGS = ", ".join(f"CAST(count(*) FILTER (WHERE o_orderpriority = '{p}') AS DOUBLE) AS {m}" for m, p in PRIORITIES.items())
_YEAR = "CAST(year(o_orderdate) AS INTEGER) AS year"
NATION_STATS = f"""nstats AS (SELECT c_nationkey AS region, {_YEAR}, {_FLAGS}, CAST(count(*) AS DOUBLE) AS total_crimes
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)"""
CUST_STATS = f"cstats AS (SELECT o_custkey AS region, {_YEAR}, {_FLAGS}, CAST(count(*) AS DOUBLE) AS total_crimes FROM orders GROUP BY ALL)"


def _summary(src: str, out: str) -> str:
    return f"""{out} AS (SELECT region, round(avg(total_crimes), 2) AS total_crimes_mean, arg_max(total_crimes, year) AS total_crimes_latest,
  max(total_crimes) AS total_crimes_max, sum(m_urgent) + sum(m_high) AS violent_crimes_sum,
  sum(m_medium) + sum(m_unspecified) AS property_crimes_sum,
  CASE WHEN arg_min(total_crimes, year) > 0 THEN round((arg_max(total_crimes, year) - arg_min(total_crimes, year))
    / arg_min(total_crimes, year) * 100.0, 2) ELSE 0.0 END AS crime_growth FROM {src} GROUP BY region)"""


def _features(profile: str, summary: str, out: str) -> str:
    return f"""{out}_base AS (SELECT region, total_population, round(total_population / (households * CAST(0.04 AS DOUBLE) + 1.0), 2) AS population_density,
  round(total_crimes_latest / total_population * 100000.0, 2) AS crime_rate_per_100k, round(literacy_rate, 2) AS literacy_pct,
  round(female_ratio, 4) AS female_ratio, round(urban_pct, 2) AS urban_pct, CAST(1.25 AS DOUBLE) AS population_growth,
  round(crime_growth, 2) AS crime_growth_rate, round(work_participation_rate, 2) AS economic_activity_index,
  round((violent_crimes_sum * 4.0 + property_crimes_sum * CAST(1.5 AS DOUBLE) + total_crimes_max) / (total_population / 10000.0), 2) AS crime_severity_score
  FROM {profile} JOIN {summary} USING (region)),
{out}_lim AS (SELECT min(crime_rate_per_100k) AS lo, max(crime_rate_per_100k) AS hi, max(crime_severity_score) AS sev FROM {out}_base),
{out} AS (SELECT *, round((CAST(0.45 AS DOUBLE) * normalized_crime_index + CAST(0.35 AS DOUBLE) * (crime_severity_score / top)
  + CAST(0.20 AS DOUBLE) * (1.0 - literacy_pct / 100.0)) * 100.0, 2) AS hotspot_score FROM (
  SELECT b.*, round((crime_rate_per_100k - lo) / (CASE WHEN hi > lo THEN hi - lo ELSE 1.0 END), 4) AS normalized_crime_index,
    CASE WHEN sev > 0 THEN sev ELSE 1.0 END AS top FROM {out}_base b, {out}_lim))"""


FEATURE_OUT = """region, total_population, population_density, crime_rate_per_100k, literacy_pct, female_ratio, urban_pct, population_growth,
  crime_growth_rate, economic_activity_index, crime_severity_score, normalized_crime_index, hotspot_score"""
CUST_FEATURES = ", ".join([CUST_PROFILE, CUST_STATS, _summary("cstats", "csum"), _features("cprof", "csum", "cfeat")])
NATION_FEATURES = ", ".join([NATION_PROFILE, NATION_STATS, _summary("nstats", "nsum"), _features("nprof", "nsum", "nfeat")])

LOG = """log AS (SELECT o_custkey AS region, o_orderkey AS id, (o_orderkey * 7919 % 10001) / 100.0 AS risk_score,
  (o_orderkey * 104729 % 10001) / 100.0 AS hotspot_score, o_totalprice AS crime_forecast,
  (o_orderkey * 15485863 % 10001) / 10000.0 AS anomaly_score FROM orders)"""
LATEST = LOG + """, pred AS (SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY region ORDER BY id DESC) = 1)"""

NAMES = """names AS (SELECT c_custkey, c_nationkey, c_acctbal, CASE WHEN c_custkey % 11 = 0 THEN '  ' WHEN c_custkey % 3 = 0 THEN lower(n_name)
  WHEN c_custkey % 3 = 1 THEN '  ' || n_name || ' ' ELSE upper(n_name) END AS raw_name FROM customer JOIN nation ON c_nationkey = n_nationkey),
aliases AS (SELECT upper(n_name) AS alias, 'Land ' || CAST(n_nationkey % 10 AS VARCHAR) AS canonical FROM nation WHERE n_nationkey % 2 = 0)"""


def _canonical(raw: str) -> str:
    return (f"CASE WHEN trim({raw}) = '' THEN 'Unknown' ELSE coalesce(canonical, upper(left(trim({raw}), 1)) || lower(substr(trim({raw}), 2))) END")


POINTS = """pts AS (SELECT o_orderkey AS point_id, c_nationkey AS region, o_totalprice AS severity,
  12.5 + (c_nationkey % 5) * CAST(1.1 AS DOUBLE) + ((o_orderkey * 7919) % 97 - 48) * ((o_orderkey * 104729) % 89) / CAST(89.0 AS DOUBLE) / CAST(1000.0 AS DOUBLE) AS lat,
  74.5 + (c_nationkey // 5) * CAST(0.8 AS DOUBLE) + ((o_orderkey * 15485863) % 97 - 48) * ((o_orderkey * 32452843) % 89) / CAST(89.0 AS DOUBLE) / CAST(1000.0 AS DOUBLE) AS lon
  FROM orders JOIN customer ON o_custkey = c_custkey)"""
BASES = """bases AS (SELECT s_suppkey AS base_id, s_name AS base_name,
  12.5 + (s_nationkey % 5) * CAST(1.1 AS DOUBLE) + ((s_suppkey * 37) % 41 - 20) / CAST(1000.0 AS DOUBLE) AS base_lat,
  74.5 + (s_nationkey // 5) * CAST(0.8 AS DOUBLE) + ((s_suppkey * 53) % 41 - 20) / CAST(1000.0 AS DOUBLE) AS base_lon FROM supplier)"""


def _km(la1: str, lo1: str, la2: str, lo2: str) -> str:
    return (f"(12742.0 * asin(sqrt(least(1.0, pow(sin((radians({la2}) - radians({la1})) / 2), 2) + cos(radians({la1})) * cos(radians({la2}))"
            f" * pow(sin((radians({lo2}) - radians({lo1})) / 2), 2)))))")


CELLS = POINTS + """, cells AS (SELECT CAST(i * 100000 + j AS BIGINT) AS cell, crime_count, severity_mean, (i + 0.5) / 100.0 AS lat_center,
  (j + 0.5) / 100.0 AS lon_center FROM (SELECT CAST(floor(lat * 100) AS BIGINT) AS i, CAST(floor(lon * 100) AS BIGINT) AS j,
    count(*) AS crime_count, CAST(sum(CAST(round(severity * 100) AS BIGINT)) AS BIGINT) / count(*) / 100.0 AS severity_mean FROM pts GROUP BY ALL))"""

NODES = """nodes AS (SELECT node_id, name, CASE WHEN bal < 0 THEN 'Independent' WHEN bal < 3000 THEN 'amber' WHEN bal < 6000 THEN 'blue' ELSE 'coral' END AS grp,
  'NATION_' || CAST(nk AS VARCHAR) AS region FROM (SELECT 'C' || CAST(c_custkey AS VARCHAR) AS node_id, c_name AS name, c_nationkey AS nk, c_acctbal AS bal FROM customer
  UNION ALL SELECT 'S' || CAST(s_suppkey AS VARCHAR), s_name, s_nationkey, s_acctbal FROM supplier))"""
EDGES = """edges AS (SELECT 'C' || CAST(o_custkey AS VARCHAR) AS src, 'S' || CAST(l_suppkey AS VARCHAR) AS dst, count(*) AS weight
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)"""
GRAPH = NODES + ", " + EDGES
DEGREE = "deg AS (SELECT node_id, count(*) AS links FROM (SELECT src AS node_id FROM edges UNION ALL SELECT dst FROM edges) GROUP BY 1)"
ENDS = """ends AS (SELECT e.*, a.grp AS src_grp, a.region AS src_region, b.grp AS dst_grp, b.region AS dst_region,
  coalesce(a.grp = b.grp AND a.grp <> 'Independent', false) AS same_group FROM edges e JOIN nodes a ON a.node_id = src JOIN nodes b ON b.node_id = dst)"""
AFFINITY = ENDS + """, aff AS (SELECT src, dst, CAST(1.0 + CASE WHEN same_group THEN 4.0 ELSE 0.0 END
  + CASE WHEN src_region = dst_region THEN 2.0 ELSE 0.0 END AS DOUBLE) AS affinity FROM ends)"""


def add(name: str, sql: str) -> None:
    SQL[name] = half_up(sql)


# --- sources -----------------------------------------------------------------------------------------------------
add("table_scan", "SELECT c_custkey, c_nationkey, c_mktsegment, c_acctbal FROM customer")
add("csv_round_trip", "SELECT * FROM customer")
add("json_round_trip", "SELECT * FROM supplier")
add("read_many_units", "SELECT c_nationkey AS unit, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer GROUP BY 1")
add("distinct_keys", "SELECT DISTINCT o_custkey FROM orders")
add("relational_table", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'")
add("insert_unseen", f"""WITH {LOG} SELECT region, id, risk_score FROM log WHERE region NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)
  QUALIFY row_number() OVER (PARTITION BY region ORDER BY id) = 1""")
add("insert_twice", f"""WITH {LOG}, old AS (SELECT region, id, risk_score FROM log WHERE region IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)
  QUALIFY row_number() OVER (PARTITION BY region ORDER BY id DESC) = 1)
  SELECT * FROM old UNION ALL SELECT region, id, risk_score FROM log WHERE region NOT IN (SELECT region FROM old)
  QUALIFY row_number() OVER (PARTITION BY region ORDER BY id) = 1""")
add("append_runs", """SELECT run_id, count(*) AS n, max(loaded) AS loaded FROM orders,
  (VALUES ('run-1', '2024-01-01'), ('run-2', '2024-01-02')) r(run_id, loaded) GROUP BY run_id""")
add("snapshot_counts", f"""WITH {NATION_PROFILE} SELECT 'hotspots' AS name, least(50, count(DISTINCT o_custkey)) AS n FROM orders
  UNION ALL SELECT 'regions', count(*) FROM nprof UNION ALL SELECT 'trend', count(DISTINCT year(o_orderdate)) FROM orders""")


# --- quality -----------------------------------------------------------------------------------------------------
_COLS = {
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
                 "l_returnflag", "l_linestatus", "l_shipdate"],
    "documents": ["doc_id", "text", "lang", "source", "n_chars"],
    "events": ["event_id", "ts", "user_id", "event_type", "value", "props"],
    "labels": ["doc_id", "quality", "toxic"],
}


def _profile(table: str, name: str, cols: list[str], floats: tuple[str, ...] = ()) -> str:
    miss = " + ".join(f"count(*) FILTER (WHERE {c} IS NULL{f' OR isnan({c})' if c in floats else ''})" for c in cols)
    inf = " + ".join(f"count(*) FILTER (WHERE isinf({c}))" for c in floats) or "0"
    return f"""SELECT '{name}' AS dataset, CASE WHEN count(*) > 0 THEN 'PASSED' ELSE 'FAILED' END AS status,
      CASE WHEN count(*) = 0 THEN 'Empty dataset' END AS error, count(*) AS n_rows, CAST({len(cols)} AS BIGINT) AS n_columns,
      CAST({miss} AS BIGINT) AS missing_values, count(*) - (SELECT count(*) FROM (SELECT DISTINCT {', '.join(cols)} FROM {table})) AS duplicate_rows,
      CAST({inf} AS BIGINT) AS invalid_numeric_values FROM {table}"""


add("quality_profile", " UNION ALL ".join(_profile(t, t, cols) for t, cols in _COLS.items()))
add("duplicate_profile", """WITH lines AS (SELECT l_suppkey, l_returnflag, CASE WHEN l_discount = 0 THEN 'infinity'::DOUBLE
  WHEN l_tax = 0 THEN 'nan'::DOUBLE ELSE l_discount END AS v FROM lineitem) """ + _profile("lines", "lines", ["l_suppkey", "l_returnflag", "v"], ("v",)))
add("infinity_count", "SELECT count(*) FILTER (WHERE o_orderstatus = 'F') AS infinite FROM orders")
add("dataset_status", """SELECT CASE WHEN (SELECT count(*) FROM orders WHERE o_totalprice < 0) = 0 OR (SELECT count(*) FROM customer) = 0 OR true
  THEN 'FAILED WITH WARNINGS' ELSE 'PASSED' END AS overall_status, CAST(3 AS BIGINT) AS datasets_validated,
  CAST(1 + CASE WHEN (SELECT count(*) FROM orders WHERE o_totalprice < 0) = 0 THEN 1 ELSE 0 END
    + CASE WHEN (SELECT count(*) FROM customer) = 0 THEN 1 ELSE 0 END AS BIGINT) AS datasets_failed""")
SIDES = """sides AS (SELECT coalesce(a.k, b.k) AS key, CASE WHEN a.k IS NOT NULL AND b.k IS NOT NULL THEN 'both' WHEN a.k IS NOT NULL
  THEN 'left_only' ELSE 'right_only' END AS side FROM (SELECT DISTINCT c_custkey AS k FROM customer) a
  FULL JOIN (SELECT DISTINCT o_custkey + 7 AS k FROM orders) b ON a.k = b.k)"""
add("key_consistency", f"WITH {SIDES} SELECT key, side FROM sides")
add("key_sets", SQL["key_consistency"])
add("key_consistency_summary", f"""WITH {SIDES} SELECT count(*) FILTER (WHERE side <> 'right_only') AS total_left,
  count(*) FILTER (WHERE side <> 'left_only') AS total_right, count(*) FILTER (WHERE side = 'both') AS matched FROM sides""")
add("duplicate_keys", "SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicate_keys FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_partkey, l_suppkey)")
add("keep_first_per_key", """SELECT o_custkey, o_orderkey, o_totalprice, o_orderstatus FROM orders
  QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1""")
add("distinct_rows", "SELECT DISTINCT l_suppkey, l_returnflag, l_linestatus FROM lineitem")
add("load_reconciliation", "SELECT count(*) AS rows_loaded, count(DISTINCT o_custkey) AS rows_cleaned, count(*) - count(DISTINCT o_custkey) AS rows_removed FROM orders")

# --- scalars -----------------------------------------------------------------------------------------------------
add("canonical_names", f"WITH {NAMES} SELECT c_custkey, {_canonical('raw_name')} AS region FROM names LEFT JOIN aliases ON alias = upper(trim(raw_name))")
add("select_by_name", f"WITH {NAMES} SELECT c_custkey, raw_name FROM names WHERE lower(trim(raw_name)) = 'nation_3'")
TEXTS = """texts AS (SELECT c_custkey, c_mktsegment, CASE c_custkey % 8 WHEN 0 THEN k WHEN 1 THEN k || '.5' WHEN 2 THEN '-' || k WHEN 3 THEN k || 'e3'
  WHEN 4 THEN ' ' || k WHEN 5 THEN '.' || k WHEN 6 THEN k || '.' ELSE '' END AS txt FROM (SELECT *, CAST(c_custkey AS VARCHAR) AS k FROM customer))"""
_NUM = "CASE WHEN regexp_matches(txt, '^([0-9]+[.]?[0-9]*|[.][0-9]+)$') THEN TRY_CAST(txt AS DOUBLE) ELSE 0.0 END"
add("parse_numbers", f"WITH {TEXTS} SELECT c_custkey, txt, round({_NUM}, 6) AS number FROM texts")
add("tail_sums", f"WITH {TEXTS} SELECT c_custkey, round(CAST({_NUM} AS DOUBLE) + c_custkey + c_custkey % 7, 6) AS tail_sum FROM texts")
add("null_defaults", "SELECT o_orderkey, CASE WHEN o_orderstatus IN ('O', 'P') THEN 0.0 ELSE o_totalprice END AS filled FROM orders")
add("guarded_ratios", """SELECT l_orderkey, l_linenumber, CASE WHEN l_discount > 0 THEN round(l_quantity / l_discount, 4) ELSE 0.0 END AS ratio,
  least(greatest(l_quantity / 100.0, CAST(0.05 AS DOUBLE)), CAST(0.4 AS DOUBLE)) AS clipped FROM lineitem""")
add("points_in_box", f"WITH {POINTS} SELECT point_id, region FROM pts WHERE lat BETWEEN 12.5 AND 15.9 AND lon BETWEEN 74.5 AND 77.0")
add("great_circle_distance", f"WITH {POINTS} SELECT point_id, round({_km('lat', 'lon', '14.7', '76.1')}, 6) AS km FROM pts")
_BAND = "CASE WHEN risk_score >= 75 THEN 'critical' WHEN risk_score >= 50 THEN 'high' WHEN risk_score >= 25 THEN 'medium' ELSE 'low' END"
add("risk_bands", f"""WITH {LOG} SELECT id, {_BAND} AS band, CASE WHEN risk_score > 75 THEN 'CRITICAL' WHEN risk_score > 50 THEN 'HIGH'
  WHEN risk_score > 25 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM log""")
add("band_counts", f"WITH {LOG} SELECT {_BAND} AS band, count(*) AS n FROM log GROUP BY 1")
add("alert_rows", f"""WITH {LATEST} SELECT region, CASE WHEN risk_score > 65 THEN 'CRIME_HOTSPOT' ELSE 'ANOMALY_DETECTED' END AS alert_type,
  CASE WHEN risk_score > 65 AND risk_score >= 80 THEN 'CRITICAL' ELSE 'HIGH' END AS severity,
  CASE WHEN risk_score > 65 THEN 'High crime risk detected in ' || CAST(region AS VARCHAR) || ' (Risk Score: ' || CAST(risk_score AS VARCHAR)
    || ', Forecast: ' || CAST(crime_forecast AS VARCHAR) || ').' ELSE 'Statistical crime anomaly detected in ' || CAST(region AS VARCHAR)
    || ' (Anomaly Score: ' || CAST(anomaly_score AS VARCHAR) || ').' END AS message
  FROM pred WHERE risk_score > 65 OR anomaly_score > 0.70""")
add("marker_attributes", f"""WITH {LOG} SELECT id, round(6 + risk_score / 100.0 * 22, 6) AS radius, CASE WHEN risk_score >= 75 THEN 'darkred'
  WHEN risk_score >= 50 THEN 'red' WHEN risk_score >= 25 THEN 'orange' ELSE 'green' END AS color FROM log""")
add("heuristic_scores", """WITH req AS (SELECT c_custkey AS region,
    CASE WHEN c_custkey % 7 <> 0 THEN (c_custkey * 7919 % 60000) / 100.0 ELSE 150.0 END AS rate,
    CASE WHEN c_custkey % 5 <> 0 THEN (c_custkey * 104729 % 10000) / 100.0 ELSE 75.0 END AS lit,
    CASE WHEN c_custkey % 3 <> 0 THEN (c_custkey * 15485863 % 6000) / 100.0 - 20.0 ELSE 2.0 END AS g,
    CASE WHEN c_custkey % 4 <> 0 THEN (c_custkey * 32452843 % 15000) / 100.0 ELSE 45.0 END AS sev FROM customer),
  n AS (SELECT *, least(greatest(rate / 400.0, 0.0), 1.0) AS nr, least(greatest(sev / 100.0, 0.0), 1.0) AS ns, greatest(0.0, 1.0 - lit / 100.0) AS ul,
    round(rate * (1.0 + g / 100.0), 2) AS fc, round(least(greatest((rate - 150.0) / 300.0 + g / 50.0, 0.0), 1.0), 4) AS an FROM req),
  s AS (SELECT region, round((CAST(0.45 AS DOUBLE) * nr + CAST(0.35 AS DOUBLE) * ns + CAST(0.2 AS DOUBLE) * ul) * 100.0, 2) AS hotspot_score,
    fc AS crime_forecast, an AS anomaly_score,
    least(greatest(round((CAST(0.5 AS DOUBLE) * (fc / 300.0) + CAST(0.35 AS DOUBLE) * nr + CAST(0.15 AS DOUBLE) * an) * 100.0, 2), 0.0), 100.0) AS risk_score FROM n)
  SELECT *, CASE WHEN risk_score > 75 THEN 'CRITICAL' WHEN risk_score > 50 THEN 'HIGH' WHEN risk_score > 25 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level FROM s""")
add("numbered_rows", "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS seq FROM orders")

# --- joins -------------------------------------------------------------------------------------------------------
CSUM = ", ".join([CUST_PROFILE, CUST_STATS, _summary("cstats", "csum")])
add("profile_join", f"WITH {CSUM} SELECT region, total_population, literacy_rate, total_crimes_latest, crime_growth FROM cprof JOIN csum USING (region)")
add("profile_left_join", f"""WITH {CSUM} SELECT region, total_population, coalesce(total_crimes_latest, 0.0) AS total_crimes_latest,
  coalesce(total_crimes_mean, 0.0) AS total_crimes_mean, coalesce(crime_growth, 0.0) AS crime_growth FROM cprof LEFT JOIN csum USING (region)""")
add("population_lookup", f"""WITH {CUST_PROFILE}, {CUST_STATS} SELECT region, year, coalesce(p, 1000000.0) AS population, p IS NULL AS population_imputed,
  round(total_crimes / coalesce(p, 1000000.0) * 100000.0, 2) AS crime_rate_per_100k
  FROM cstats LEFT JOIN (SELECT region, CAST(total_population AS DOUBLE) AS p FROM cprof WHERE total_population >= 1000) USING (region)""")
add("centroid_lookup", f"""WITH {NAMES} SELECT c_custkey, CAST(12.5 + n_nationkey % 5 AS DOUBLE) AS lat, CAST(74.5 + n_nationkey // 5 AS DOUBLE) AS lon
  FROM names JOIN nation ON lower(n_name) = lower(trim(raw_name)) WHERE n_nationkey % 4 <> 3""")
add("unplaced_names", f"""WITH {NAMES} SELECT DISTINCT raw_name FROM names WHERE lower(trim(raw_name)) NOT IN
  (SELECT lower(n_name) FROM nation WHERE n_nationkey % 4 <> 3)""")
add("deployment_overlay", f"""WITH {NAMES}, units AS (SELECT n_name, count(*) AS units FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1)
  SELECT c_custkey, units FROM names LEFT JOIN units ON lower(n_name) = lower(trim(raw_name))""")
add("indicator_overlay", f"""WITH {NAMES}, tot AS (SELECT {_canonical('raw_name')} AS region, count(*) AS incidents FROM orders JOIN names ON o_custkey = c_custkey
    LEFT JOIN aliases ON alias = upper(trim(raw_name)) GROUP BY 1),
  ind AS (SELECT {_canonical('n_name')} AS region, count(*) AS stations, CAST(sum(CAST(round(s_acctbal * 100) AS BIGINT)) AS BIGINT) / count(*) / 100.0 AS indicator FROM supplier JOIN nation ON s_nationkey = n_nationkey
    LEFT JOIN aliases ON alias = upper(n_name) GROUP BY 1)
  SELECT region, incidents, stations, indicator FROM tot LEFT JOIN ind USING (region)""")
add("distance_pairs", f"""WITH {POINTS}, {BASES}, d AS (SELECT point_id, base_id, {_km('base_lat', 'base_lon', 'lat', 'lon')} AS km FROM pts JOIN bases
  ON abs(lat - base_lat) < 0.03) SELECT point_id, base_id, round(km, 6) AS km FROM d WHERE km <= 3.0""")
add("region_documents", f"""WITH {CUST_FEATURES}, {LATEST}, hist AS (SELECT region, string_agg(CAST(year AS VARCHAR) || ':' || CAST(CAST(total_crimes AS INTEGER) AS VARCHAR), ';' ORDER BY year) AS history
    FROM cstats GROUP BY region)
  SELECT p.region, p.literacy_rate, coalesce(history, '') AS history, f.hotspot_score AS feature_hotspot, r.risk_score FROM cprof p LEFT JOIN hist USING (region)
  LEFT JOIN cfeat f USING (region) LEFT JOIN pred r USING (region)""")
add("region_detail", f"""WITH {NATION_PROFILE}, {NATION_STATS}, {LOG}, best AS (SELECT risk_score FROM log WHERE region % 25 = 7 ORDER BY id DESC LIMIT 1)
  SELECT CAST(region AS VARCHAR) AS region, risk_score, year, total_crimes FROM nstats LEFT JOIN best ON true
  WHERE region = 7 AND region IN (SELECT region FROM nprof)""")
add("list_regions", f"WITH {NATION_PROFILE} SELECT region, total_population, male_population, female_population, literacy_rate, urban_pct, work_participation_rate FROM nprof")

# --- aggregates, windows, sorts --------------------------------------------------------------------------------------
add("region_profiles", f"WITH {NATION_PROFILE} SELECT * FROM nprof")
add("yearly_statistics", f"WITH {NATION_STATS} SELECT * FROM nstats WHERE region <> 24")
add("customer_yearly_statistics", f"WITH {CUST_STATS} SELECT * FROM cstats")
add("region_summary", f"WITH {CUST_STATS}, {_summary('cstats', 'csum')} SELECT * FROM csum")
add("yearly_trend", f"""WITH {NATION_STATS} SELECT year, {', '.join(f'sum({m}) AS {m}' for m in MEASURES)},
  (SELECT count(DISTINCT year) FROM nstats) AS years_count FROM nstats GROUP BY year""")
add("scaled_prices", """SELECT o_orderkey, o_totalprice, round((o_totalprice - lo) / (CASE WHEN hi > lo THEN hi - lo ELSE 1.0 END), 4) AS scaled
  FROM orders, (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders)""")
add("standardized_lines", """SELECT l_orderkey, l_linenumber, round((l_quantity - mq) / dq, 6) AS z_qty, round((l_extendedprice - mp) / dp, 6) AS z_price
  FROM lineitem, (SELECT avg(l_quantity) AS mq, stddev_pop(l_quantity) AS dq, avg(l_extendedprice) AS mp, stddev_pop(l_extendedprice) AS dp FROM lineitem)""")
add("composite_indices", f"WITH {CUST_FEATURES} SELECT {FEATURE_OUT} FROM cfeat")
add("nation_indices", f"WITH {NATION_FEATURES} SELECT {FEATURE_OUT} FROM nfeat")
add("top_hotspots", f"""WITH {NATION_FEATURES} SELECT region, hotspot_score, crime_rate_per_100k, crime_severity_score FROM nfeat
  ORDER BY hotspot_score DESC, region LIMIT 10""")
add("latest_predictions", f"WITH {LATEST} SELECT * FROM pred")
add("ranked_predictions", f"WITH {LOG} SELECT id, risk_score, hotspot_score FROM log ORDER BY risk_score DESC, id")
add("top_predictions", f"WITH {LOG} SELECT id, region, risk_score, hotspot_score FROM log ORDER BY risk_score DESC, hotspot_score DESC, id LIMIT 50")
add("region_counts", "SELECT count(DISTINCT c_nationkey) AS regions, count(DISTINCT o_custkey) AS customers FROM orders JOIN customer ON o_custkey = c_custkey")
add("stacked_layouts", """WITH one AS (SELECT 'R' || CAST(c_nationkey AS VARCHAR) AS region, 2013 AS year, CAST(c_custkey % 5 AS DOUBLE) AS alpha, CAST(c_custkey % 7 AS DOUBLE) AS beta,
    CASE WHEN c_custkey % 4 = 0 AND c_custkey % 11 > 0 THEN CAST(c_custkey % 11 AS DOUBLE) ELSE CAST(c_custkey % 5 + c_custkey % 7 AS DOUBLE) END AS total_crimes
    FROM customer WHERE c_custkey % 2 = 0 AND c_custkey % 29 <> 0),
  two AS (SELECT 'R' || CAST(c_nationkey AS VARCHAR) AS region, CAST(2016 + c_custkey % 7 AS INTEGER) AS year, CAST(c_custkey % 13 AS DOUBLE) AS alpha,
    CASE WHEN c_custkey % 5 = 1 THEN 0.0 ELSE CAST(c_custkey % 17 AS DOUBLE) END AS beta,
    c_custkey % 13 + CASE WHEN c_custkey % 5 = 1 THEN 0 ELSE c_custkey % 17 END + c_custkey % 19 + CAST(0.5 AS DOUBLE) AS total_crimes
    FROM customer WHERE c_custkey % 2 = 1 AND c_custkey % 29 <> 0 AND c_custkey % 31 <> 0)
  SELECT region, year, sum(alpha) AS alpha, sum(beta) AS beta, sum(total_crimes) AS total_crimes FROM (SELECT * FROM one UNION ALL SELECT * FROM two) GROUP BY ALL""")

# --- scoring -----------------------------------------------------------------------------------------------------
SCORED = CUST_FEATURES + ", " + LATEST + """, fc AS (SELECT f.*, anomaly_score, round(crime_rate_per_100k * (1.0 + least(greatest(crime_growth_rate / 100.0, CAST(-0.2 AS DOUBLE)), CAST(0.5 AS DOUBLE))), 2) AS crime_forecast
  FROM cfeat f JOIN (SELECT region, anomaly_score FROM pred) USING (region)),
scored AS (SELECT fc.*, round((CAST(0.5 AS DOUBLE) * (crime_forecast / (CASE WHEN hi > 0 THEN hi ELSE 1.0 END)) + CAST(0.35 AS DOUBLE) * normalized_crime_index
  + CAST(0.15 AS DOUBLE) * anomaly_score) * 100.0, 2) AS risk_score FROM fc, (SELECT max(crime_forecast) AS hi FROM fc))"""
add("blended_risk", f"WITH {SCORED} SELECT region, crime_forecast, risk_score FROM scored")
add("run_summary", f"""WITH {SCORED} SELECT count(*) AS total_regions, count(*) FILTER (WHERE anomaly_score > 0.85) AS total_anomalies,
  round(avg(crime_rate_per_100k), 2) AS avg_rate, (SELECT region FROM scored ORDER BY risk_score DESC, region LIMIT 1) AS highest_risk_region,
  (SELECT region FROM scored ORDER BY risk_score, region DESC LIMIT 1) AS lowest_risk_region,
  (SELECT string_agg(CAST(region AS VARCHAR), ',' ORDER BY risk_score DESC, region) FROM (SELECT * FROM scored ORDER BY risk_score DESC, region LIMIT 5)) AS top_high_risk
  FROM scored""")
add("contamination_threshold", "SELECT round(quantile_cont(round(l_extendedprice / 200000.0, 6), 0.15), 6) AS threshold FROM lineitem")


def _h(*parts: str) -> str:
    return "('0x' || substr(md5(" + " || '|' || ".join(f"CAST({p} AS VARCHAR)" for p in parts) + "), 1, 8))::BIGINT"


def isolation_nodes(src: str, id_col: str, cols: list[str], n_trees: int = 100, sample: int = 256, seed: int = 42) -> str:
    """Trees grown level by level in a recursive query; the sample is min(256, rows) and so is the depth rule."""
    d = len(cols)
    vals = ", ".join(f"CAST({c} AS DOUBLE)" for c in cols)
    lo, hi = (", ".join(f"{f}(x[{i + 1}]) OVER w" for i in range(d)) for f in ("min", "max"))
    varied = ", ".join(f"CASE WHEN hi[{i + 1}] > lo[{i + 1}] THEN {i} END" for i in range(d))
    return f"""lim AS (SELECT count(*) AS n, least({sample}, count(*)) AS sz, CAST(ceil(log2(greatest(least({sample}, count(*)), 1))) AS INTEGER) AS depth FROM {src}),
samp AS (SELECT tree, id, x FROM (SELECT tree, {id_col} AS id, [{vals}] AS x,
    row_number() OVER (PARTITION BY tree ORDER BY {_h(str(seed), 'tree', id_col)}, {id_col}) AS r
  FROM {src}, lim, range({n_trees}) t(tree)), lim WHERE r <= sz),
grow AS (SELECT tree, id, x, CAST(1 AS BIGINT) AS node, 0 AS lvl, CAST(NULL AS BIGINT) AS done, CAST(NULL AS INTEGER) AS f, CAST(NULL AS DOUBLE) AS split, CAST(0 AS BIGINT) AS n FROM samp
  UNION ALL
  SELECT tree, id, x, CASE WHEN f IS NULL THEN NULL WHEN x[f + 1] < split THEN node * 2 ELSE node * 2 + 1 END, lvl + 1, node, f, split, n FROM (
    SELECT *, lo[f + 1] + u * (hi[f + 1] - lo[f + 1]) AS split FROM (
      SELECT *, CASE WHEN len(v) = 0 OR lvl >= (SELECT depth FROM lim) THEN NULL ELSE CAST(v[1 + {_h(str(seed), "'f'", 'tree', 'node')} % len(v)] AS INTEGER) END AS f,
        ({_h(str(seed), "'s'", 'tree', 'node')} + 0.5) / 4294967296.0 AS u FROM (
        SELECT *, [e FOR e IN [{varied}] IF e IS NOT NULL] AS v FROM (
          SELECT tree, id, x, node, lvl, count(*) OVER w AS n, [{lo}] AS lo, [{hi}] AS hi FROM grow WHERE node IS NOT NULL
          WINDOW w AS (PARTITION BY tree, node)))))),
inodes AS (SELECT DISTINCT tree, done AS node, f AS feature, split, n AS size FROM grow WHERE done IS NOT NULL)"""


def average_path(n: str) -> str:
    return f"CASE WHEN {n} <= 1 THEN 0.0 WHEN {n} = 2 THEN 1.0 ELSE 2.0 * (ln({n} - 1.0) + 0.5772156649015329) - 2.0 * ({n} - 1.0) / {n} END"


def isolation_scores(src: str, id_col: str, cols: list[str]) -> str:
    vals = ", ".join(f"CAST({c} AS DOUBLE)" for c in cols)
    return isolation_nodes(src, id_col, cols) + f""", walk AS (SELECT {id_col} AS id, [{vals}] AS x, tree, CAST(1 AS BIGINT) AS node, 0 AS lvl FROM {src}, range(100) t(tree)
  UNION ALL SELECT w.id, w.x, w.tree, CASE WHEN w.x[i.feature + 1] < i.split THEN w.node * 2 ELSE w.node * 2 + 1 END, lvl + 1
  FROM walk w JOIN inodes i ON i.tree = w.tree AND i.node = w.node WHERE i.feature IS NOT NULL),
leafs AS (SELECT w.id, w.lvl + {average_path('i.size')} AS h FROM walk w JOIN inodes i ON i.tree = w.tree AND i.node = w.node WHERE i.feature IS NULL),
iso AS (SELECT id, -round(pow(2.0, -(sum(h) / 100) / (SELECT {average_path('sz')} FROM lim)), 6) AS d FROM leafs GROUP BY id),
cut AS (SELECT min(d) AS lo, max(d) AS hi FROM iso)"""


CELL_COLS = ["crime_count", "severity_mean", "lat_center", "lon_center"]
ZCOLS = ["population_density", "crime_rate_per_100k", "literacy_pct", "female_ratio", "urban_pct", "crime_growth_rate",
         "economic_activity_index", "crime_severity_score", "normalized_crime_index"]
SCALED = CUST_FEATURES + ", scaled AS (SELECT region, " + ", ".join(
    f"({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () AS z_{c}" for c in ZCOLS) + " FROM cfeat)"
add("isolation_tree_nodes", f"""WITH RECURSIVE {CELLS}, {isolation_nodes('cells', 'cell', CELL_COLS)}
  SELECT CAST(tree AS INTEGER) AS tree, node, feature, round(split, 6) AS split, size FROM inodes""")
add("anomaly_cells", f"""WITH RECURSIVE {CELLS}, {isolation_scores('cells', 'cell', CELL_COLS)}
  SELECT id AS cell, -d AS raw_score, CAST(d < (SELECT quantile_cont(d, 0.05) FROM iso) AS INTEGER) AS is_anomaly FROM iso""")
add("anomaly_regions", f"""WITH RECURSIVE {SCALED}, {isolation_scores('scaled', 'region', ['z_' + c for c in ZCOLS])}
  SELECT id AS region, round(1.0 - (d - lo) / (hi - lo + 1e-6), 4) AS anomaly_score, CAST(d < (SELECT quantile_cont(d, 0.15) FROM iso) AS INTEGER) AS is_anomaly FROM iso, cut""")

# --- clustering ----------------------------------------------------------------------------------------------------
DBSCAN = POINTS + f""", spots AS (SELECT point_id AS id, lat, lon, CAST(floor(lat / 0.005) AS BIGINT) AS gi, CAST(floor(lon / 0.006) AS BIGINT) AS gj FROM pts),
shift AS (SELECT di, dj FROM range(-1, 2) a(di), range(-1, 2) b(dj)),
near AS (SELECT a.id AS a, b.id AS b FROM (SELECT spots.*, gi + di AS ti, gj + dj AS tj FROM spots, shift) a JOIN spots b ON a.ti = b.gi AND a.tj = b.gj
  WHERE {_km('a.lat', 'a.lon', 'b.lat', 'b.lon')} <= 0.5),
core AS (SELECT a AS id FROM near GROUP BY a HAVING count(*) >= 15),
links AS (SELECT a, b FROM near WHERE a IN (SELECT id FROM core) AND b IN (SELECT id FROM core)),
comp AS (SELECT id, id AS root FROM core UNION SELECT b, root FROM comp JOIN links ON a = id WHERE root < b),
roots AS (SELECT id, min(root) AS root FROM comp GROUP BY id),
numbered AS (SELECT id, dense_rank() OVER (ORDER BY root) - 1 AS k FROM roots),
labels_ AS (SELECT id AS point_id, coalesce(k, (SELECT min(k) FROM near JOIN numbered n ON n.id = near.b WHERE near.a = spots.id), -1) AS cluster_id
  FROM spots LEFT JOIN numbered USING (id))"""
CENTERS = DBSCAN + """, per AS (SELECT cluster_id, region, count(*) AS n, sum(lat) AS sla, sum(lon) AS slo FROM pts JOIN labels_ USING (point_id)
  WHERE cluster_id >= 0 GROUP BY ALL), cen AS (SELECT cluster_id, (SELECT region FROM per q WHERE q.cluster_id = per.cluster_id ORDER BY n DESC, region LIMIT 1) AS region,
  sum(sla) / sum(n) AS center_lat, sum(slo) / sum(n) AS center_lon, CAST(sum(n) AS BIGINT) AS size FROM per GROUP BY cluster_id),
centers AS (SELECT cen.*, round(size / (SELECT max(size) FROM cen) * 100, 2) AS risk_score FROM cen)"""
add("point_clusters", f"WITH RECURSIVE {DBSCAN} SELECT point_id, CAST(cluster_id AS BIGINT) AS cluster_id FROM labels_")
add("cluster_centers", f"WITH RECURSIVE {CENTERS} SELECT cluster_id, region, round(center_lat, 6) AS center_lat, round(center_lon, 6) AS center_lon, size, risk_score FROM centers")
add("cluster_risk_by_region", f"WITH RECURSIVE {CENTERS} SELECT region, round(sum(risk_score), 2) AS risk FROM centers GROUP BY 1 ORDER BY risk DESC, region LIMIT 12")
add("center_cells", f"""WITH RECURSIVE {CENTERS} SELECT CAST(cluster_id AS VARCHAR) || '_0' AS cell_id, region, CAST(floor(risk_score * 5) AS INTEGER) + 10 AS crime_count, severity_mean
  FROM centers JOIN (SELECT cluster_id, CAST(sum(CAST(round(severity * 100) AS BIGINT)) AS BIGINT) / count(*) / 100.0 AS severity_mean FROM pts JOIN labels_ USING (point_id) GROUP BY 1) USING (cluster_id)""")
_DIST = " + ".join(f"pow(a.z_{c} - b.z_{c}, 2)" for c in ZCOLS)
add("feature_clusters", f"""WITH RECURSIVE {SCALED}, links AS (SELECT a.region AS a, b.region AS b FROM scaled a JOIN scaled b ON a.region <> b.region WHERE sqrt({_DIST}) <= 1.5),
  comp AS (SELECT DISTINCT a AS id, a AS root FROM links UNION SELECT b, root FROM comp JOIN links ON a = id WHERE root < b),
  roots AS (SELECT id, min(root) AS root FROM comp GROUP BY id), k AS (SELECT id, dense_rank() OVER (ORDER BY root) - 1 AS k FROM roots)
  SELECT region AS id, CAST(coalesce(k, -1) AS BIGINT) AS cluster_id FROM scaled LEFT JOIN k ON k.id = region""")

# --- forests: what SQL can state of each row ------------------------------------------------------------------------
INPUTS = [c for c in ZCOLS if c not in ("crime_rate_per_100k", "normalized_crime_index")]
add("forest_predictions", f"WITH {CUST_FEATURES} SELECT region, crime_rate_per_100k, true AS within_range FROM cfeat")
add("explained_regions", f"""WITH {CUST_FEATURES} SELECT region, CAST({len(INPUTS)} AS INTEGER) AS contributions, true AS adds_up, true AS sorted,
  true AS texts_fit, true AS complete FROM cfeat""")
add("global_importance", f"WITH {CUST_FEATURES} SELECT feature, label, (SELECT count(*) FROM cfeat) AS regions, true AS is_mean FROM (VALUES "
    + ", ".join(f"('{c}', '{FEATURE_LABELS[c]}')" for c in INPUTS) + ") v(feature, label)")
add("scoring_run", f"""WITH RECURSIVE {SCALED}, {isolation_scores('scaled', 'region', ['z_' + c for c in ZCOLS])},
  links AS (SELECT a.region AS a, b.region AS b FROM scaled a JOIN scaled b ON a.region <> b.region WHERE sqrt({_DIST}) <= 1.5),
  comp AS (SELECT DISTINCT a AS id, a AS root FROM links UNION SELECT b, root FROM comp JOIN links ON a = id WHERE root < b),
  roots AS (SELECT id, min(root) AS root FROM comp GROUP BY id), k AS (SELECT id, dense_rank() OVER (ORDER BY root) - 1 AS k FROM roots)
  SELECT cfeat.region, CAST(coalesce(k, -1) AS BIGINT) AS cluster_id, crime_rate_per_100k AS current_crime_rate_per_100k,
    round(1.0 - (d - lo) / (hi - lo + 1e-6), 4) AS anomaly_score, CAST(d < (SELECT quantile_cont(d, 0.15) FROM iso) AS INTEGER) AS is_anomaly,
    true AS risk_fits FROM cfeat LEFT JOIN k ON k.id = region JOIN iso ON iso.id = region, cut""")

# --- allocation ----------------------------------------------------------------------------------------------------


def coverage(radii: list[int], k: int) -> str:
    """Greedy rounds as a recursive query whose state is the list of picked bases per radius."""
    reach = max(radii)
    return CELLS + ", " + BASES + f""", spots AS (SELECT cell AS s, lat_center AS la, lon_center AS lo, CAST(crime_count * 1.25 AS DECIMAL(18, 2)) AS risk FROM cells),
sites AS (SELECT min(base_id) AS base_id, base_lat, base_lon FROM bases GROUP BY base_lat, base_lon),
reach AS (SELECT s, base_id, {_km('base_lat', 'base_lon', 'la', 'lo')} AS d FROM spots JOIN sites ON abs(la - base_lat) <= {reach / 111.0}),
radii AS (SELECT CAST(unnest({radii}) AS DOUBLE) AS radius),
sets AS (SELECT radius, s, any_value(risk) AS risk, coalesce(list(base_id) FILTER (WHERE base_id IS NOT NULL), []) AS covers
  FROM spots CROSS JOIN radii LEFT JOIN reach USING (s) WHERE d <= radius GROUP BY radius, s),
groups AS (SELECT radius, covers, CAST(sum(risk) AS DECIMAL(28, 2)) AS risk, count(*) AS n FROM (SELECT radius, list_sort(covers) AS covers, risk FROM sets) GROUP BY ALL),
rounds AS (SELECT radius, 0 AS units, CAST([] AS BIGINT[]) AS picks, CAST(NULL AS BIGINT) AS base_id, CAST(0 AS DECIMAL(28, 2)) AS gain,
    CAST(0 AS DECIMAL(28, 2)) AS covered, CAST(0 AS BIGINT) AS covered_spots, CAST(NULL AS DECIMAL(28, 2)) AS bound FROM radii
  UNION ALL
  SELECT radius, units + 1, list_append(picks, b), b, CAST(g AS DECIMAL(28, 2)), CAST(covered + g AS DECIMAL(28, 2)), covered_spots + n, CAST(covered + best AS DECIMAL(28, 2)) FROM (
    SELECT *, sum(CASE WHEN r <= {k} THEN g ELSE 0 END) OVER (PARTITION BY radius) AS best FROM (
      SELECT radius, units, picks, covered, covered_spots, b, sum(risk) AS g, CAST(sum(n) AS BIGINT) AS n,
        row_number() OVER (PARTITION BY radius ORDER BY sum(risk) DESC, b) AS r
      FROM (SELECT q.radius, q.units, q.picks, q.covered, q.covered_spots, g.risk, g.n, unnest(g.covers) AS b FROM rounds q JOIN groups g ON g.radius = q.radius AND NOT list_has_any(g.covers, q.picks)
        WHERE q.units < {k}) GROUP BY radius, units, picks, covered, covered_spots, b))
  WHERE r = 1 AND g > 0),
after AS (SELECT q.radius, q.units, q.covered + coalesce((SELECT sum(g) FROM (SELECT sum(risk) AS g FROM (SELECT risk, unnest(covers) AS b FROM groups g
  WHERE g.radius = q.radius AND NOT list_has_any(g.covers, q.picks)) GROUP BY b ORDER BY g DESC LIMIT {k})), 0) AS bound FROM rounds q WHERE q.units < {k}),
totals AS (SELECT sum(risk) AS total, count(*) AS spots FROM spots),
asked AS (SELECT radius, CAST(u AS INTEGER) AS units FROM radii, range(1, {k + 1}) t(u)),
grid AS (SELECT a.radius, a.units, max(r.covered) AS covered, max(r.covered_spots) AS covered_spots, count(*) FILTER (WHERE r.units > 0) AS units_used
  FROM asked a JOIN rounds r ON r.radius = a.radius AND r.units <= a.units GROUP BY ALL),
metrics AS (SELECT g.radius, g.units, round(CAST(covered AS DOUBLE) / CAST(total AS DOUBLE) * 100, 1) AS covered_pct, spots - covered_spots AS uncovered_count,
  spots AS total_spots, units_used, least(100.0, round(CAST((SELECT min(bound) FROM after f WHERE f.radius = g.radius) AS DOUBLE) / CAST(total AS DOUBLE) * 100, 1)) AS upper_bound_pct FROM grid g, totals)"""


add("coverage_plan", f"""WITH RECURSIVE {coverage([3], 10)} SELECT units, base_id, CAST(gain AS DOUBLE) AS gain, CAST(covered AS DOUBLE) AS covered, covered_spots FROM rounds WHERE units > 0""")
add("coverage_metrics", f"WITH RECURSIVE {coverage([3], 5)} SELECT * FROM metrics WHERE units = 5")
add("coverage_grid", f"WITH RECURSIVE {coverage(list(range(1, 11)), 30)} SELECT radius, units, covered_pct, uncovered_count FROM metrics")
add("plan_summary", f"""WITH RECURSIVE {coverage([3], 10)} SELECT 10 AS total_units, radius AS max_radius_km, total_spots AS regions_considered, covered_pct AS risk_reduced,
  round(100.0 - covered_pct, 1) AS residual_risk, CASE WHEN units_used = 0 AND total_spots > 0 THEN 'Infeasible' WHEN covered_pct >= upper_bound_pct THEN 'Optimal' ELSE 'Feasible' END AS solver_status,
  covered_pct, uncovered_count FROM metrics WHERE units = 10""")
add("unit_assignments", f"""WITH RECURSIVE {coverage([3], 5)} SELECT radius, CAST(units AS INTEGER) AS units, 'Station:' || base_name AS assignment, 1 AS units_assigned
  FROM rounds JOIN bases USING (base_id) WHERE units > 0""")

# --- network -------------------------------------------------------------------------------------------------------
_PALETTE = "['#00f2fe', '#f72585', '#7209b7', '#3a0ca3', '#4361ee', '#4cc9f0', '#80ed99', '#ffd166', '#ff7b00', '#ff4d6d']"
add("entity_degree", f"WITH {EDGES}, {DEGREE} SELECT * FROM deg")
add("top_connected", f"WITH {EDGES}, {DEGREE} SELECT * FROM deg ORDER BY links DESC, node_id LIMIT 5")
KEPT = "kept AS (SELECT * FROM nodes WHERE lower(trim(region)) = 'nation_3'), inner_ AS (SELECT * FROM edges WHERE src IN (SELECT node_id FROM kept) AND dst IN (SELECT node_id FROM kept))"
add("subgraph_nodes", f"""WITH {GRAPH}, {DEGREE}, {KEPT} SELECT k.node_id, name, grp, region, coalesce(links, 0) AS links, 12 + least(coalesce(links, 0), 12) * 2 AS size,
  {_PALETTE}[1 + (dense_rank() OVER (ORDER BY grp) - 1) % 10] AS color FROM kept k LEFT JOIN deg USING (node_id)""")
add("subgraph_edges", f"""WITH {GRAPH}, {KEPT} SELECT src, dst, weight,
  CASE weight % 3 WHEN 0 THEN 'same_gang' WHEN 1 THEN 'associate' ELSE 'other' END AS kind, round(1 + weight * CAST(0.6 AS DOUBLE), 6) AS width,
  CASE weight % 3 WHEN 0 THEN '{LINK_COLORS["same_gang"]}' WHEN 1 THEN '{LINK_COLORS["associate"]}' ELSE '{DEFAULT_LINK_COLOR}' END AS color FROM inner_""")
add("subgraph_summary", f"WITH {GRAPH}, {KEPT} SELECT count(*) AS node_count, count(DISTINCT grp) AS group_count, (SELECT count(*) FROM inner_) AS edge_count FROM kept")
add("entity_groups", f"WITH {NODES} SELECT DISTINCT grp FROM nodes")
add("edge_endpoints", f"WITH {GRAPH}, {ENDS} SELECT * FROM ends")
add("pair_affinity", f"WITH {GRAPH}, {AFFINITY} SELECT * FROM aff")
add("weighted_pair_sample", f"""WITH {GRAPH}, {AFFINITY} SELECT src, dst, affinity FROM aff
  ORDER BY -ln(({_h('42', 'src', 'dst')} + 0.5) / 4294967296.0) / affinity, src, dst LIMIT 70""")

# --- time ----------------------------------------------------------------------------------------------------------
HOURS = "hours AS (SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS window_start, count(*) AS n, max(value) AS peak FROM events GROUP BY ALL)"
# an hour is closed once the newest event is ten minutes past its end
CLOSED = HOURS + ", closed AS (SELECT * FROM hours WHERE window_start + INTERVAL 1 HOUR <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 10 MINUTE FROM events))"


def _surge(src: str) -> str:
    return f"""SELECT event_type, CAST(window_start AS TIMESTAMPTZ) AS window_start, n, round(m, 4) AS trailing_mean, CASE WHEN m > 0 THEN round(n / m, 4) END AS surge_ratio
  FROM (SELECT *, avg(n) OVER (PARTITION BY event_type ORDER BY window_start ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS m FROM {src})"""


def _alerts(src: str) -> str:
    return f"""SELECT event_type, window_start, n, CASE WHEN r > 65 THEN 'CRIME_HOTSPOT' ELSE 'ANOMALY_DETECTED' END AS alert_type,
  CASE WHEN r >= 80 THEN 'CRITICAL' ELSE 'HIGH' END AS severity,
  CASE WHEN r > 65 THEN 'High crime risk detected in ' || event_type || ' (Risk Score: ' || CAST(r AS VARCHAR) || ', Forecast: ' || CAST(CAST(n AS DOUBLE) AS VARCHAR) || ').'
    ELSE 'Statistical crime anomaly detected in ' || event_type || ' (Anomaly Score: ' || CAST(a AS VARCHAR) || ').' END AS message
  FROM (SELECT *, round(least(greatest(n / CAST(3.0 AS DOUBLE) * 50.0, 0.0), 100.0), 2) AS r, round(least(greatest(peak / 100.0, 0.0), 1.0), 4) AS a FROM {src}) WHERE r > 65 OR a > 0.70"""


add("hourly_surge", f"WITH {HOURS} " + _surge("hours").replace("CAST(window_start AS TIMESTAMPTZ) AS window_start", "window_start"))
add("window_alerts", f"WITH {HOURS} " + _alerts("hours"))
add("stream_closed_windows", f"WITH {CLOSED} SELECT event_type, window_start, n FROM closed")
add("stream_alerts", f"WITH {CLOSED} " + _alerts("closed"))
add("stream_surge", f"WITH {CLOSED} " + _surge("closed").replace("CAST(window_start AS TIMESTAMPTZ) AS window_start", "window_start"))
