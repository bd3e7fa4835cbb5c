"""The registered queries as plain SQL over the given tables, for checking.

``NAMED`` holds the shared sub-queries; ``sql`` prepends those a statement uses, in order."""

from __future__ import annotations

import re


from panelshock.operators.models import CALENDAR_SET, FEATURE_SETS, SEED
from panelshock.plans.fixtures import FLOW_PREFIXES, SCORERS, STATION_REGIONS


def r(x: str, digits: int = 6) -> str:
    return f"(round({x}, {digits}) + CAST(0 AS DOUBLE))"


def day(x: str = "date") -> str:
    return f"strftime({x}, '%Y-%m-%d')"


def _cases(c: str, mapping: dict) -> str:
    return f"CASE {c} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items()) + " END"


DAYNO = "datediff('day', DATE '1995-01-01', date)"
K = "(CASE MCT_SGG_CD WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END)"
HEAT = f"CASE WHEN month(date) IN (7,8,9) THEN CAST(({DAYNO} + 3*{K}) % 17 < 4 AS INTEGER) WHEN month(date) IN (5,6) THEN 0 END"
COLD = f"CASE WHEN month(date) IN (11,12) THEN CAST(({DAYNO} + 5*{K}) % 23 < 3 AS INTEGER) END"
SLOT = "(CASE WHEN {0} < 5 THEN 'train' WHEN {0} = 5 THEN 'validation' ELSE 'test' END)"
PRICE, TOTAL, VALUE = (f"CAST({c} AS DECIMAL(18,2))" for c in ("l_extendedprice", "o_totalprice", "value"))
NUMERIC = ("avg_temp", "min_temp", "max_temp", "lag1", "lag7", "rolling7", "rolling28", "month", "weekday", "flow_pop_weekday")
# every set has the constant
SET_ROWS = ", ".join(
    f"('{name}', '{c}')" for name, chosen in {**FEATURE_SETS, "calendar": CALENDAR_SET}.items() for c in ("", *chosen["numeric"], *chosen["categorical"])
)
SCORER_ROWS = ", ".join(
    f"('{m}', '{s}', " + ", ".join(f"CAST({w!r} AS DOUBLE)" for w in weights) + ")" for m, s, *weights in SCORERS
)
KEYS = "MCT_SGG_CD, MCT_RY_CD"
ENTITY = f"PARTITION BY {KEYS}"


def scores(y: str, p: str, suffix: str = "") -> str:
    return f"""{r(f"avg(abs({y} - {p}))")} AS mae{suffix},
      {r(f"sqrt(avg(({y} - {p}) * ({y} - {p})))")} AS rmse{suffix},
      CASE WHEN count({y}) < 2 THEN NULL
           WHEN var_pop({y}) > 0 THEN {r(f"1 - sum(({y} - {p}) * ({y} - {p})) / (var_pop({y}) * count({y}))")}
           WHEN sum(({y} - {p}) * ({y} - {p})) = 0 THEN 1.0 ELSE 0.0 END AS r2{suffix}"""


NAMED = {
    "card_text": f"""
      SELECT CASE WHEN l_partkey % 211 = 0 THEN '20250230' ELSE strftime(CAST(l_shipdate AS DATE), '%Y%m%d') END AS ymd,
        CASE WHEN l_partkey % 223 = 0 THEN NULL ELSE l_returnflag END AS region, l_linestatus AS industry,
        CASE WHEN l_partkey % 97 = 0 THEN '' WHEN l_partkey % 101 = 0 THEN 'abc' WHEN l_partkey % 103 = 0 THEN 'NaN'
             ELSE CAST({PRICE} AS VARCHAR) END AS sale_text,
        CASE WHEN l_partkey % 107 = 0 THEN '0' WHEN l_partkey % 109 = 0 THEN '' ELSE CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) END AS use_text
      FROM lineitem""",
    "card": """
      SELECT ymd, region, industry, sale_text, use_text,
        CASE WHEN sale_text IN ('', 'abc', 'NaN') THEN NULL ELSE CAST(sale_text AS DECIMAL(18,2)) END AS sale,
        CASE WHEN use_text = '' THEN NULL ELSE CAST(use_text AS BIGINT) END AS uses
      FROM card_text""",
    "card_daily": """
      SELECT ymd, region, industry,
        CASE WHEN count(sale) = count(*) THEN sum(sale) END AS sale,
        CASE WHEN count(uses) = count(*) THEN CAST(sum(uses) AS BIGINT) END AS uses
      FROM card WHERE region IS NOT NULL GROUP BY ymd, region, industry""",
    "panel": f"""
      SELECT date, MCT_SGG_CD, MCT_RY_CD, sales, units, {HEAT} AS heatwave, {COLD} AS cold_wave,
        CAST(sum(d) OVER w AS DOUBLE) / sum(n) OVER w AS avg_temp,
        CAST(min(lo) OVER w AS DOUBLE) AS min_temp, CAST(max(hi) OVER w AS DOUBLE) AS max_temp
      FROM (SELECT CAST(l_shipdate AS DATE) AS date, l_returnflag AS MCT_SGG_CD, l_linestatus AS MCT_RY_CD,
              sum({PRICE}) AS sales, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS units, count(*) AS n,
              sum(CAST(round(l_discount * 100) AS INTEGER)) AS d, min(CAST(round(l_discount * 100) AS INTEGER)) AS lo,
              max(CAST(round(l_discount * 100) AS INTEGER)) AS hi
            FROM lineitem GROUP BY 1, 2, 3)
      WINDOW w AS (PARTITION BY date, MCT_SGG_CD)""",
    "flags": """
      SELECT date, MCT_SGG_CD, any_value(heatwave) AS heatwave, any_value(cold_wave) AS cold_wave
      FROM panel GROUP BY date, MCT_SGG_CD""",
    "flagged": """
      SELECT 'heatwave' AS hazard, MCT_SGG_CD AS region, date FROM flags WHERE heatwave = 1
      UNION ALL SELECT 'cold_wave', MCT_SGG_CD, date FROM flags WHERE cold_wave = 1""",
    "eps": """
      SELECT hazard || '|' || region || '|' || strftime(start_date, '%Y%m%d') || '|'
          || printf('%02d', row_number() OVER (PARTITION BY hazard, region ORDER BY start_date)) AS episode_id,
        hazard, region, start_date, end_date, days
      FROM (SELECT hazard, region, min(date) AS start_date, max(date) AS end_date, CAST(count(*) AS INTEGER) AS days
            FROM (SELECT *, datediff('day', DATE '1995-01-01', date)
                      - row_number() OVER (PARTITION BY hazard, region ORDER BY date) AS g FROM flagged)
            GROUP BY hazard, region, g)""",
    "ep_days": """
      SELECT e.hazard AS disaster_type, e.region, e.episode_id, f.date
      FROM eps e JOIN flagged f ON f.hazard = e.hazard AND f.region = e.region AND f.date BETWEEN e.start_date AND e.end_date""",
    "weeks": """
      SELECT week, CAST(sum(CASE WHEN EXISTS (SELECT 1 FROM eps e WHERE CAST(date_trunc('week', e.start_date) AS DATE) < w.week
          AND e.end_date >= w.week) THEN 0 ELSE 1 END) OVER (ORDER BY week) AS INTEGER) AS component_no
      FROM (SELECT DISTINCT CAST(date_trunc('week', date) AS DATE) AS week FROM panel) w""",
    "dates": f"""
      SELECT d.date, d.week, w.component_no, 'G' || printf('%02d', w.component_no) AS component,
        {SLOT.format('(3 * w.component_no) % 7')} AS split
      FROM (SELECT DISTINCT date, CAST(date_trunc('week', date) AS DATE) AS week FROM panel) d JOIN weeks w ON d.week = w.week""",
    "components": """
      SELECT d.component_no, d.component, count(DISTINCT d.week) AS weeks, count(*) AS dates,
        CAST(coalesce(sum(f.h), 0) AS BIGINT) AS heatwave, CAST(coalesce(sum(f.c), 0) AS BIGINT) AS cold_wave
      FROM dates d JOIN (SELECT date, max(heatwave) AS h, max(cold_wave) AS c FROM flags GROUP BY date) f ON d.date = f.date
      GROUP BY d.component_no, d.component""",
    "lagged": f"""
      SELECT p.*, CAST(a.sales AS DOUBLE) AS lag1, CAST(b.sales AS DOUBLE) AS lag7,
        CASE WHEN count(p.sales) OVER w7 = 7 THEN CAST(sum(p.sales) OVER w7 AS DOUBLE) / 7 END AS rolling7,
        CASE WHEN count(p.sales) OVER w28 = 28 THEN CAST(sum(p.sales) OVER w28 AS DOUBLE) / 28 END AS rolling28
      FROM panel p
      LEFT JOIN panel a ON a.MCT_SGG_CD = p.MCT_SGG_CD AND a.MCT_RY_CD = p.MCT_RY_CD AND a.date = p.date - 1
      LEFT JOIN panel b ON b.MCT_SGG_CD = p.MCT_SGG_CD AND b.MCT_RY_CD = p.MCT_RY_CD AND b.date = p.date - 7
      WINDOW w7 AS (PARTITION BY p.MCT_SGG_CD, p.MCT_RY_CD ORDER BY p.date RANGE BETWEEN INTERVAL 7 DAYS PRECEDING AND INTERVAL 1 DAYS PRECEDING),
        w28 AS (PARTITION BY p.MCT_SGG_CD, p.MCT_RY_CD ORDER BY p.date RANGE BETWEEN INTERVAL 28 DAYS PRECEDING AND INTERVAL 1 DAYS PRECEDING)""",
    "bases": f"""
      SELECT 'heatwave' AS hazard, {KEYS}, CAST(sum(sales) AS DOUBLE) / count(*) AS base FROM panel JOIN dates USING (date)
      WHERE split = 'train' AND heatwave = 0 AND month(date) IN (7,8,9) GROUP BY {KEYS}
      UNION ALL
      SELECT 'cold_wave', {KEYS}, CAST(sum(sales) AS DOUBLE) / count(*) FROM panel JOIN dates USING (date)
      WHERE split = 'train' AND cold_wave = 0 AND month(date) IN (11,12) GROUP BY {KEYS}""",
    "events_y1": """
      SELECT b.hazard AS disaster_type, l.*, d.split, b.base,
        CAST(100.0 AS DOUBLE) * (CAST(l.sales AS DOUBLE) - b.base) / b.base AS actual_y1
      FROM lagged l JOIN dates d USING (date)
      JOIN bases b ON b.MCT_SGG_CD = l.MCT_SGG_CD AND b.MCT_RY_CD = l.MCT_RY_CD
      WHERE b.base > 0 AND ((b.hazard = 'heatwave' AND l.heatwave = 1 AND month(l.date) IN (7,8,9))
        OR (b.hazard = 'cold_wave' AND l.cold_wave = 1 AND month(l.date) IN (11,12)))""",
    "preds": f"""
      SELECT date, MCT_SGG_CD AS region, MCT_RY_CD AS industry, disaster_type, model, feature_set, split, actual_y1,
        w0 * (avg_temp - 5) + 100 * (w1 * (coalesce(lag1, base) - base) + w7 * (coalesce(lag7, base) - base)
          + wr * (coalesce(rolling7, base) - base)) / base AS predicted_y1
      FROM events_y1, (VALUES {SCORER_ROWS}) s(model, feature_set, w0, w1, w7, wr)""",
    "saved": """
      SELECT p.*, e.episode_id FROM preds p LEFT JOIN ep_days e USING (disaster_type, region, date)
      WHERE p.model = 'Ridge' AND p.feature_set = 'B_plus_past_sales'""",
    "means": """
      SELECT disaster_type, model, feature_set, avg(actual_y1) AS m FROM preds WHERE split = 'train'
      GROUP BY disaster_type, model, feature_set""",
    "long_metrics": f"""
      SELECT disaster_type, model, feature_set, split, count(*) AS n,
        avg(abs(actual_y1 - predicted_y1)) AS mae, sqrt(avg(power(actual_y1 - predicted_y1, 2))) AS rmse,
        1 - sum(power(actual_y1 - predicted_y1, 2)) / (var_pop(actual_y1) * count(*)) AS r2,
        avg(abs(actual_y1 - m)) AS bmae, sqrt(avg(power(actual_y1 - m, 2))) AS brmse,
        1 - sum(power(actual_y1 - m, 2)) / (var_pop(actual_y1) * count(*)) AS br2
      FROM preds JOIN means USING (disaster_type, model, feature_set)
      GROUP BY disaster_type, model, feature_set, split""",
    "wide": "SELECT disaster_type, model, feature_set, "
    + ", ".join(
        f"max({src}) FILTER (WHERE split = '{s}') AS {p}_{name}"
        for s, p in (("train", "train"), ("validation", "val"), ("test", "test"))
        for name, src in (
            ("mae", "mae"), ("rmse", "rmse"), ("r2", "r2"), ("n", "n"), ("train_mean_baseline_mae", "bmae"),
            ("train_mean_baseline_rmse", "brmse"), ("train_mean_baseline_r2", "br2"),
        )
    )
    + " FROM long_metrics GROUP BY disaster_type, model, feature_set",
    "bounds": """
      SELECT disaster_type, quantile_cont(actual_y1, 0.01) AS lo, quantile_cont(actual_y1, 0.99) AS hi
      FROM saved WHERE split = 'train' GROUP BY disaster_type""",
    "within_industry": """
      SELECT disaster_type, split, episode_id, industry, avg(actual_y1) AS am, avg(predicted_y1) AS pm,
        quantile_cont(actual_y1, 0.5) AS med, stddev_samp(actual_y1) AS sd, count(*) AS n, count(DISTINCT date) AS dates
      FROM saved GROUP BY ALL""",
    "within_region": """
      SELECT disaster_type, split, episode_id, region, avg(actual_y1) AS am, avg(predicted_y1) AS pm
      FROM saved GROUP BY ALL""",
    "hours": f"""
      SELECT {_cases('event_type', STATION_REGIONS)} AS region, CAST(ts AS DATE) AS date, CAST(hour(ts) AS INTEGER) AS hour,
        CASE WHEN sum(event_id) % 19 <> 0 THEN CAST(sum({VALUE}) AS DOUBLE) END AS rain
      FROM events WHERE event_type IN ({", ".join(f"'{s}'" for s in STATION_REGIONS)}) GROUP BY 1, 2, 3""",
    "rain_days": """
      SELECT region, date, CASE WHEN count(*) = 24 AND count(rain) = 24 THEN sum(rain) END AS rainfall,
        CAST(count(*) AS INTEGER) AS rain_observation_hours, CAST(count(rain) AS INTEGER) AS rain_valid_hours,
        CAST(count(*) = 24 AND count(rain) = 24 AS INTEGER) AS rainfall_complete
      FROM hours GROUP BY region, date""",
    "spine": """
      SELECT s.region, CAST(d.d AS DATE) AS date FROM
        (SELECT region, min(date) AS lo, max(date) AS hi FROM hours GROUP BY region) s, unnest(generate_series(s.lo, s.hi, INTERVAL 1 DAY)) d(d)""",
    "windows": """
      SELECT a.region, a.date, a.rain + b.rain + c.rain AS s
      FROM hours a
      JOIN hours b ON b.region = a.region AND b.date + to_hours(CAST(b.hour AS BIGINT)) = a.date + to_hours(CAST(a.hour - 1 AS BIGINT))
      JOIN hours c ON c.region = a.region AND c.date + to_hours(CAST(c.hour AS BIGINT)) = a.date + to_hours(CAST(a.hour - 2 AS BIGINT))
      WHERE a.rain IS NOT NULL AND b.rain IS NOT NULL AND c.rain IS NOT NULL""",
    "exposure": """
      SELECT s.region, s.date,
        CASE WHEN max(w.s) >= 800 THEN 1 WHEN max(h.valid) = 24 THEN 0 END AS heavy_rain,
        max(w.s) AS rain_3h_max_mm, CAST(count(w.s) AS INTEGER) AS rain_3h_valid_windows
      FROM spine s LEFT JOIN windows w ON w.region = s.region AND w.date = s.date
      LEFT JOIN (SELECT region, date, count(rain) AS valid FROM hours GROUP BY region, date) h ON h.region = s.region AND h.date = s.date
      GROUP BY s.region, s.date""",
    "station_days": f"""
      SELECT {_cases('event_type', STATION_REGIONS)} AS region, CAST(ts AS DATE) AS date, count(*) AS n,
        dayofmonth(CAST(ts AS DATE)) + length(event_type) AS m, dayofmonth(CAST(ts AS DATE)) AS dom,
        CASE WHEN count(*) % 10 <> 0 THEN CAST(sum({VALUE}) AS DOUBLE) / count(*) END AS avg_temp,
        CASE WHEN count(*) % 10 <> 0 THEN CAST(min({VALUE}) AS DOUBLE) END AS min_temp,
        CASE WHEN count(*) % 10 <> 0 THEN CAST(max({VALUE}) AS DOUBLE) END AS max_temp
      FROM events WHERE event_type IN ({", ".join(f"'{s}'" for s in STATION_REGIONS)}) GROUP BY event_type, CAST(ts AS DATE)""",
    "warnings": """
      SELECT region, date, CASE WHEN dom <= 15 THEN CAST(m % 3 = 0 AS INTEGER) END AS heatwave,
        CASE WHEN dom <= 15 THEN CASE WHEN m % 3 = 0 THEN '주의보' ELSE 'X' END END AS heat_alert_status,
        CASE WHEN dom <= 15 AND m % 5 = 0 THEN '관심' END AS heat_impact_forecast,
        CASE WHEN dom > 15 THEN CASE m % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 1 END END AS cold_wave,
        CASE WHEN dom > 15 THEN CASE m % 4 WHEN 0 THEN 'X' WHEN 1 THEN '주의보' WHEN 2 THEN '경보' END END AS cold_alert_status,
        CASE WHEN dom > 15 AND m % 5 = 0 THEN '주의' END AS cold_impact_forecast, avg_temp, min_temp, max_temp
      FROM station_days""",
    "all_spine": f"""
      SELECT CAST(d.d AS DATE) AS date, g.region FROM (SELECT min(date) AS lo, max(date) AS hi FROM hours) s,
        unnest(generate_series(s.lo, s.hi, INTERVAL 1 DAY)) d(d),
        (VALUES {", ".join(f"('{v}')" for v in STATION_REGIONS.values())}) g(region)""",
    "weather_days": f"""
      SELECT date, MCT_SGG_CD, {HEAT} AS heatwave, {COLD} AS cold_wave,
        CASE WHEN (n + {K}) % 3 = 0 THEN 1 WHEN (n + {K}) % 3 = 1 THEN 0 END AS heavy_rain,
        CAST(s AS DOUBLE) / n / 10000 AS avg_temp, CAST(lo AS DOUBLE) / 10000 AS min_temp, CAST(hi AS DOUBLE) / 10000 AS max_temp,
        CASE WHEN (n + {K}) % 2 = 0 THEN CAST(n * ({K} + 1) AS DOUBLE) END AS rainfall,
        CASE WHEN n IS NOT NULL THEN 24 END AS rain_observation_hours,
        CAST(24 - (n + {K}) % 2 AS INTEGER) AS rain_valid_hours, CAST((n + {K}) % 2 = 0 AS INTEGER) AS rainfall_complete,
        CAST(n * ({K} + 1) AS DOUBLE) / 2 AS rain_3h_max_mm,
        CASE WHEN n IS NOT NULL THEN 22 - {K} ELSE 0 END AS rain_3h_valid_windows
      FROM (SELECT CAST(d.d AS DATE) AS date, g.MCT_SGG_CD FROM
              (SELECT CAST(min(o_orderdate) AS DATE) AS lo, CAST(max(o_orderdate) AS DATE) AS hi FROM orders) b,
              unnest(generate_series(b.lo, b.hi, INTERVAL 1 DAY)) d(d), (VALUES ('A'), ('N'), ('R')) g(MCT_SGG_CD))
      LEFT JOIN (SELECT CAST(o_orderdate AS DATE) AS date, count(*) AS n, sum({TOTAL}) AS s, min({TOTAL}) AS lo, max({TOTAL}) AS hi
            FROM orders GROUP BY 1) o USING (date)""",
    "joined": """
      SELECT p.date, p.MCT_SGG_CD, p.MCT_RY_CD, p.sales, p.units, w.* EXCLUDE (date, MCT_SGG_CD), w.date IS NOT NULL AS matched
      FROM panel p LEFT JOIN weather_days w ON w.date = p.date AND w.MCT_SGG_CD = p.MCT_SGG_CD""",
    "wide_panel": f"""
      SELECT CAST(o_orderdate AS DATE) AS date, CAST(c_nationkey AS VARCHAR) AS MCT_SGG_CD, c_mktsegment AS MCT_RY_CD, sum({TOTAL}) AS sales
      FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3""",
    "customer_days": f"""
      SELECT CAST(o_orderdate AS DATE) AS date, CAST(o_custkey AS VARCHAR) AS MCT_RY_CD, sum({TOTAL}) AS sales FROM orders GROUP BY 1, 2""",
    "october_wide": f"""
      SELECT * FROM (SELECT *, count(sales) FILTER (WHERE month(date) = 10) OVER w AS october_n,
          CAST(sum(sales) FILTER (WHERE month(date) = 10) OVER w AS DOUBLE) / count(sales) FILTER (WHERE month(date) = 10) OVER w AS october_mean
        FROM wide_panel WINDOW w AS ({ENTITY})) WHERE october_n >= 10""",
    "flow": f"""
      SELECT strftime(CAST(o_orderdate AS DATE), '%Y%m') AS ym, lpad(CAST(c_nationkey AS VARCHAR), 5, '0') AS prefix, c_mktsegment AS segment,
        isodow(CAST(o_orderdate AS DATE)) - 1 AS weekday, {TOTAL} AS price
      FROM orders JOIN customer ON o_custkey = c_custkey""",
    "mapped": f"SELECT *, {_cases('prefix', FLOW_PREFIXES)} AS region FROM flow WHERE {_cases('prefix', FLOW_PREFIXES)} IS NOT NULL",
    "profile": """
      SELECT CAST(substr(g.ym, 1, 4) AS INTEGER) AS year, g.region, CAST(substr(g.ym, 5, 2) AS INTEGER) AS month, w.weekday,
        coalesce(sum(m.price), 0) AS flow_pop_weekday
      FROM (SELECT DISTINCT ym, region FROM mapped) g CROSS JOIN (SELECT unnest(range(7)) AS weekday) w
      LEFT JOIN mapped m ON m.ym = g.ym AND m.region = g.region AND m.weekday = w.weekday
      GROUP BY g.ym, g.region, w.weekday""",
    "test_events": """
      SELECT disaster_type, actual_y1, base, avg_temp, lag1, lag7, rolling7,
        disaster_type || '|' || strftime(date, '%Y-%m-%d') || '|' || MCT_SGG_CD || '|' || MCT_RY_CD AS id
      FROM events_y1 WHERE split = 'test'""",
    "fit_rows": """
      SELECT e.disaster_type, e.split, e.actual_y1 AS y, strftime(e.date, '%Y-%m-%d') || '|' || e.MCT_SGG_CD || '|' || e.MCT_RY_CD AS id,
        e.avg_temp, e.min_temp, e.max_temp, e.lag1, e.lag7, e.rolling7, e.rolling28, e.MCT_SGG_CD, e.MCT_RY_CD,
        month(e.date) AS month, isodow(e.date) - 1 AS weekday, f.flow_pop_weekday
      FROM events_y1 e LEFT JOIN profile f ON f.year = year(e.date) AND f.region = e.MCT_SGG_CD AND f.month = month(e.date) AND f.weekday = isodow(e.date) - 1""",
    "fit_long": "SELECT disaster_type, split, y, id, f.feature, f.value FROM fit_rows r, LATERAL (VALUES "
    + ", ".join(f"('{c}', CAST(r.{c} AS DOUBLE))" for c in NUMERIC)
    + ") f(feature, value)",
    "fit_median": """
      SELECT disaster_type, feature, coalesce(quantile_cont(value, 0.5), 0.0) AS median FROM fit_long WHERE split = 'train' GROUP BY ALL""",
    "fit_scale": """
      SELECT disaster_type, feature, median, avg(coalesce(value, median)) AS m, stddev_pop(coalesce(value, median)) AS s
      FROM fit_long JOIN fit_median USING (disaster_type, feature) WHERE split = 'train' GROUP BY ALL""",
    "fit_levels": """
      SELECT *, level = min(level) OVER (PARTITION BY disaster_type, feature) AS first_level FROM (
        SELECT DISTINCT disaster_type, f.feature, f.value AS level
        FROM fit_rows r, LATERAL (VALUES ('MCT_SGG_CD', r.MCT_SGG_CD), ('MCT_RY_CD', r.MCT_RY_CD)) f(feature, value) WHERE split = 'train')""",
    # every row's value in every column: the constant, scaled numbers, one column per category
    "design": """
      SELECT disaster_type, split, y, id, '' AS feature, '' AS col, 1.0 AS x, false AS first_level FROM fit_rows
      UNION ALL SELECT l.disaster_type, l.split, l.y, l.id, l.feature, l.feature, (coalesce(l.value, s.median) - s.m) / CASE WHEN s.s = 0 THEN 1 ELSE s.s END, false
      FROM fit_long l JOIN fit_scale s USING (disaster_type, feature)
      UNION ALL SELECT r.disaster_type, r.split, r.y, r.id, v.feature, v.feature || '=' || v.level,
        CASE WHEN CASE v.feature WHEN 'MCT_SGG_CD' THEN r.MCT_SGG_CD ELSE r.MCT_RY_CD END = v.level THEN 1.0 ELSE 0.0 END, v.first_level
      FROM fit_rows r JOIN fit_levels v USING (disaster_type)""",
    "columns_of": f"""
      SELECT *, row_number() OVER (PARTITION BY disaster_type, model, feature_set ORDER BY col) AS j FROM (
        SELECT DISTINCT disaster_type, m.model, m.alpha, s.feature_set, d.feature, d.col FROM design d
        JOIN (VALUES {SET_ROWS}) s(feature_set, feature) ON s.feature = d.feature,
        (VALUES ('Linear Regression', 0.0), ('Ridge', 10.0)) m(model, alpha)
        WHERE m.alpha > 0 OR NOT d.first_level)""",
    "gram": """
      SELECT a.disaster_type, a.model, a.feature_set, a.j AS i, b.j AS j,
        sum(x.x * z.x) + max(CASE WHEN a.j = b.j AND a.col <> '' THEN a.alpha ELSE 0.0 END) AS v
      FROM columns_of a JOIN columns_of b USING (disaster_type, model, feature_set)
      JOIN design x ON x.disaster_type = a.disaster_type AND x.col = a.col AND x.split = 'train'
      JOIN design z ON z.disaster_type = a.disaster_type AND z.col = b.col AND z.id = x.id GROUP BY ALL
      UNION ALL SELECT a.disaster_type, a.model, a.feature_set, a.j, 1000, sum(x.x * x.y)
      FROM columns_of a JOIN design x ON x.disaster_type = a.disaster_type AND x.col = a.col AND x.split = 'train' GROUP BY ALL""",
    # Gauss-Jordan elimination, a column at a time; a column without a pivot keeps weight 0
    "solved": """
      SELECT disaster_type, model, feature_set, 1 AS k, list(CAST(line AS DOUBLE[]) ORDER BY i) AS m
      FROM (SELECT disaster_type, model, feature_set, i, list(v ORDER BY j) AS line FROM gram GROUP BY ALL) GROUP BY ALL
      UNION ALL SELECT disaster_type, model, feature_set, k + 1, list_transform(m, lambda line, i: list_transform(line, lambda v, j:
        CASE WHEN abs(m[k][k]) < 1e-9 THEN v WHEN i = k THEN v / m[k][k] ELSE v - line[k] * m[k][j] / m[k][k] END)) FROM solved WHERE k <= len(m)""",
    "weights": """
      SELECT c.*, CASE WHEN abs(s.m[c.j][c.j]) < 1e-9 THEN 0.0 ELSE s.m[c.j][len(s.m) + 1] END AS w FROM columns_of c JOIN solved s USING (disaster_type, model, feature_set) WHERE s.k = len(s.m) + 1""",
    "contributions": """
      SELECT w.disaster_type, w.model, w.feature_set, d.id, d.split, d.y, d.feature, sum(d.x * w.w) AS c
      FROM weights w JOIN design d USING (disaster_type, col) GROUP BY ALL""",
    "fitted": """
      SELECT disaster_type, model, feature_set, id, split, y, sum(c) AS p FROM contributions GROUP BY ALL""",
    "train_tests": """
      SELECT disaster_type, 'degree' AS kind, floor(avg_temp) AS place, '' AS value, actual_y1 AS y FROM events_y1 WHERE split = 'train' AND avg_temp IS NOT NULL
      UNION ALL SELECT disaster_type, 'region', 0, MCT_SGG_CD, actual_y1 FROM events_y1 WHERE split = 'train'
      UNION ALL SELECT disaster_type, 'industry', 0, MCT_RY_CD, actual_y1 FROM events_y1 WHERE split = 'train'""",
    "best_tests": """
      SELECT disaster_type, min(tq - ls * ls / ln - (ts - ls) * (ts - ls) / nullif(tn - ln, 0)) AS best_split_sse FROM (
        SELECT disaster_type, kind, CASE WHEN kind = 'degree' THEN sum(n) OVER w ELSE n END AS ln, CASE WHEN kind = 'degree' THEN sum(s) OVER w ELSE s END AS ls
        FROM (SELECT disaster_type, kind, place, value, count(*) AS n, sum(y) AS s FROM train_tests GROUP BY ALL)
        WINDOW w AS (PARTITION BY disaster_type, kind ORDER BY place))
      JOIN (SELECT disaster_type, count(*) AS tn, sum(actual_y1) AS ts, sum(actual_y1 * actual_y1) AS tq FROM events_y1 WHERE split = 'train' GROUP BY ALL)
        USING (disaster_type) GROUP BY ALL""",
    # places of the test rows, and of those inside the train bounds
    "sampled": """
      SELECT *, row_number() OVER (PARTITION BY disaster_type, sample ORDER BY md5(id)) - 1 AS pos FROM (
        SELECT disaster_type, 'test_all' AS sample, id, y FROM fit_rows WHERE split = 'test'
        UNION ALL SELECT t.disaster_type, 'test_inside_train_p01_p99', t.id, t.y FROM fit_rows t JOIN (
          SELECT disaster_type, quantile_cont(y, 0.01) AS lo, quantile_cont(y, 0.99) AS hi FROM fit_rows WHERE split = 'train' GROUP BY ALL) b
          USING (disaster_type) WHERE t.split = 'test' AND t.y BETWEEN b.lo AND b.hi)""",
    "filled": """
      SELECT disaster_type, feature, value, coalesce(quantile_cont(value, 0.5) OVER (PARTITION BY disaster_type, feature), 0.0) AS median
      FROM (SELECT e.disaster_type, f.feature, f.value FROM events_y1 e, LATERAL (VALUES """
    + ", ".join(
        f"('{c}', e.{c})" for c in ("avg_temp", "min_temp", "max_temp", "lag1", "lag7", "rolling7", "rolling28")
    )
    + ") f(feature, value) WHERE e.split = 'train')",
    "standard": """
      SELECT disaster_type, avg(avg_temp) AS m, stddev_pop(avg_temp) AS s FROM events_y1 WHERE split = 'train' GROUP BY disaster_type""",
    "scaled": """
      SELECT e.disaster_type, e.split, e.actual_y1 AS y, (e.avg_temp - t.m) / t.s AS x FROM events_y1 e JOIN standard t USING (disaster_type)""",
}


def sql(body: str, ctes: str = "") -> str:
    """``body`` behind the named sub-queries it needs, each after those it uses itself, and
    behind further ones, ``ctes``."""
    needed: list[str] = []

    def visit(text: str, own: str = "") -> None:
        for name in NAMED:
            if name not in (own, *needed) and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text):
                visit(NAMED[name], name)
                needed.append(name)

    visit(ctes + body)
    if not needed:
        return body
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({NAMED[n]})" for n in dict.fromkeys(needed)) + ctes + "\n" + body


def audit(**counts: str) -> str:
    return " UNION ALL ".join(f"SELECT '{n}' AS \"check\", (SELECT count(*) FROM ({q})) AS violations" for n, q in counts.items())


RUN = "disaster_type, model, feature_set"
EPISODE = "disaster_type, episode_id, split"
CARD_COUNT = "CAST(coalesce(sum({0}), 0) AS BIGINT)"


def permuted(groups: dict[str, tuple[str, ...]], repeats: int, seed: int) -> str:
    features = ("avg_temp", "lag1", "lag7", "rolling7")
    names = ", ".join(f"('{g}')" for g in groups)

    def pick(c: str) -> str:
        own = [g for g, cs in groups.items() if c in cs]
        return f"CASE WHEN r.grp IN ({', '.join(repr(g) for g in own)}) THEN d.{c} ELSE r.{c} END AS {c}"

    def score(t: str) -> str:
        return (
            f"(0.5 * ({t}.avg_temp - 5) + 100 * (0.25 * (coalesce({t}.lag1, {t}.base) - {t}.base) "
            f"+ 0.125 * (coalesce({t}.lag7, {t}.base) - {t}.base) + 0.0625 * (coalesce({t}.rolling7, {t}.base) - {t}.base)) / {t}.base)"
        )

    return f"""
      , places AS (SELECT *, row_number() OVER (PARTITION BY disaster_type ORDER BY md5(id)) - 1 AS pos FROM test_events),
      shuffles AS (SELECT disaster_type, n, g.grp, p.rep FROM (SELECT disaster_type, count(*) AS n FROM test_events GROUP BY ALL),
        (VALUES {names}) g(grp), (SELECT unnest(range(1, {repeats + 1})) AS rep) p),
      {bijection("shuffles", "places", ["disaster_type"], seed)},
      exchanged AS (SELECT r.disaster_type, r.grp, r.rep, r.actual_y1, r.base, {", ".join(pick(c) for c in features)}
        FROM (SELECT t.*, m.grp, m.rep, m.donor FROM places t JOIN moved m USING (disaster_type, pos)) r
        JOIN places d ON d.disaster_type = r.disaster_type AND d.pos = r.donor),
      base_mae AS (SELECT disaster_type, avg(abs({score('t')} - t.actual_y1)) AS b, count(*) AS n FROM test_events t GROUP BY disaster_type),
      gains AS (SELECT x.disaster_type, x.grp, x.rep, avg(abs({score('x')} - x.actual_y1)) AS mae FROM exchanged x GROUP BY ALL)
      SELECT disaster_type, grp AS feature_group, max(n) AS n_rows, {r('max(b)')} AS baseline_mae,
        {r('avg(mae - b)')} AS importance_mean, {r('coalesce(stddev_samp(mae - b), 0)')} AS importance_sd,
        {r('stddev_pop(mae - b)')} AS importance_sd_pop, count(*) AS permutation_repeats
      FROM gains JOIN base_mae USING (disaster_type) GROUP BY disaster_type, grp"""


def bijection(shuffles: str, places: str, within: list[str], seed: int) -> str:
    """CTEs up to ``moved``: where each place of a shuffle (within, n, grp, rep) gets its values
    from, by a walk over the rounds of a keyed bijection."""
    w, key = ", ".join(within), "k[i % 4 + 1]"
    v = f"((((r + {key}) * 1103515245 + 12345) % 2147483647 * 69069 + {key}) % 2147483647)"
    return f"""keyed AS (SELECT *, CAST(greatest(1, ceil(ceil(log2(greatest(n, 2))) / 2)) AS BIGINT) AS b,
          list_transform(range(0, 4), lambda t: CAST('0x' || substr(md5('{seed}|' || grp || '|' || rep || '|' || t), 1, 7) AS BIGINT)) AS k FROM {shuffles}),
      walk AS (
        SELECT {w}, grp, rep, pos, n, b, k, pos >> b AS l, pos & ((CAST(1 AS BIGINT) << b) - 1) AS r, 0 AS i FROM keyed JOIN {places} USING ({w})
        UNION ALL SELECT {w}, grp, rep, pos, n, b, k, r, xor(l, xor({v}, {v} >> 15) & ((CAST(1 AS BIGINT) << b) - 1)), i + 1
        FROM walk WHERE i % 4 <> 0 OR i = 0 OR ((l << b) | r) >= n),
      moved AS (SELECT {w}, grp, rep, pos, (l << b) | r AS donor FROM walk WHERE i > 0 AND i % 4 = 0 AND ((l << b) | r) < n)"""


def _permutation_sql(groups: dict[str, tuple[str, ...]], repeats: int, seed: int) -> str:
    head = sql("SELECT 1 FROM test_events")
    return head[: head.rindex("\nSELECT 1 FROM test_events")] + permuted(groups, repeats, seed)


def _fitted_importance(groups: dict[str, tuple[str, ...]], repeats: int, sample: str, runs: str) -> str:
    """CTEs up to ``gains``: per fitted run, sample, group and repeat the mean absolute error once
    the features of the group come from another row."""
    names = ", ".join(f"('{g}')" for g in groups)
    members = ", ".join(f"('{g}', '{c}')" for g, cs in groups.items() for c in cs)
    return f"""
      , runs AS (SELECT DISTINCT disaster_type, model, feature_set FROM fitted WHERE {runs}),
      rows_of AS (SELECT * FROM sampled WHERE {sample}),
      shuffles AS (SELECT disaster_type, sample, n, g.grp, p.rep FROM (SELECT disaster_type, sample, count(*) AS n FROM rows_of GROUP BY ALL),
        (VALUES {names}) g(grp), (SELECT unnest(range(1, {repeats + 1})) AS rep) p),
      {bijection("shuffles", "rows_of", ["disaster_type", "sample"], SEED)},
      parts AS (SELECT c.disaster_type, c.model, c.feature_set, c.id, g.grp, sum(c.c) AS c FROM contributions c
        JOIN (VALUES {members}) g(grp, feature) ON g.feature = c.feature WHERE {runs} GROUP BY ALL),
      gains AS (SELECT f.disaster_type, f.model, f.feature_set, m.sample, m.grp, m.rep, count(*) AS n, avg(abs(f.p - f.y)) AS b,
          avg(abs(f.p - own.c + other.c - f.y)) AS mae
        FROM moved m JOIN rows_of a ON a.disaster_type = m.disaster_type AND a.sample = m.sample AND a.pos = m.pos
        JOIN rows_of d ON d.disaster_type = m.disaster_type AND d.sample = m.sample AND d.pos = m.donor
        JOIN parts own ON own.disaster_type = m.disaster_type AND own.id = a.id AND own.grp = m.grp
        JOIN parts other ON other.disaster_type = m.disaster_type AND other.id = d.id AND other.grp = m.grp
          AND other.model = own.model AND other.feature_set = own.feature_set
        JOIN fitted f ON f.disaster_type = m.disaster_type AND f.id = a.id AND f.model = own.model AND f.feature_set = own.feature_set
        GROUP BY ALL)"""


def _importances(body: str) -> str:
    """``body`` on ``importances``, of every feature of the ridge of each set."""
    single = {f: (f,) for f in (*NUMERIC[:7], "flow_pop_weekday", "MCT_SGG_CD", "MCT_RY_CD")}
    runs = "model = 'Ridge' AND feature_set <> 'calendar'"
    ctes = _fitted_importance(single, 5, "sample = 'test_all'", runs)
    listed = f", importances AS (SELECT {RUN}, grp AS feature, avg(mae - b) AS importance_mean FROM gains GROUP BY ALL)"
    return sql(body, ctes + listed)


def _two_samples() -> str:
    """Features and groups of the ridge under both samples."""
    single = {f: (f,) for f in (*NUMERIC[:7], "MCT_SGG_CD", "MCT_RY_CD")}
    grouped = {"weather": NUMERIC[:3], "lag": NUMERIC[3:5], "rolling": NUMERIC[5:7], "region": ("MCT_SGG_CD",), "industry": ("MCT_RY_CD",)}
    parts = []
    for kind, groups, repeats in (("single", single, 30), ("group", grouped, 50)):
        ctes = _fitted_importance(groups, repeats, "true", "model = 'Ridge' AND feature_set = 'B_plus_past_sales'")
        parts.append("SELECT * FROM (" + sql(f"""
          SELECT disaster_type, sample, grp AS feature_group, max(n) AS n_rows, {r('max(b)')} AS baseline_mae, {r('avg(mae - b)')} AS importance_mean,
            {r('coalesce(stddev_samp(mae - b), 0)')} AS importance_sd, {r('stddev_pop(mae - b)')} AS importance_sd_pop, count(*) AS permutation_repeats, '{kind}' AS kind
          FROM gains GROUP BY disaster_type, sample, grp""", ctes) + ")")
    return " UNION ALL ".join(parts)


def _fit(slope: str) -> str:
    return sql(f"""
      SELECT disaster_type, split, count(*) AS n, {r('avg(p)')} AS mean_prediction, {r('max(p)')} AS max_prediction, {r('avg(abs(p - y))')} AS mae
      FROM (SELECT s.*, f.a + f.b * s.x AS p FROM scaled s JOIN (
          SELECT disaster_type, avg(y) AS a, {slope} AS b FROM scaled WHERE split = 'train' GROUP BY disaster_type) f USING (disaster_type))
      GROUP BY disaster_type, split""")


def _tree_facts(model: str) -> str:
    """Rows and means per split, and the error of the best single test on the train rows."""
    return sql(f"""
      SELECT disaster_type, '{model}' AS model, 'B_plus_past_sales' AS feature_set, split, count(*) AS n, {r('avg(actual_y1)')} AS mean_actual_y1,
        CAST(0 AS BIGINT) AS without_prediction, CAST(0 AS BIGINT) AS outside_train_range, {r('max(best_split_sse)')} AS best_split_sse,
        true AS no_worse_than_best_split
      FROM events_y1 JOIN best_tests USING (disaster_type) GROUP BY ALL""")


def _distribution(source: str, digits: int = 6) -> str:
    quantiles = ", ".join(
        f"{r(f'quantile_cont(actual_y1, {q})')} AS {n}"
        for n, q in (("median", 0.5), ("p01", 0.01), ("p05", 0.05), ("p10", 0.1), ("p25", 0.25), ("p75", 0.75), ("p90", 0.9), ("p95", 0.95), ("p99", 0.99))
    )
    return f"""SELECT disaster_type, split, count(*) AS n_industry_rows, {r('avg(actual_y1)', digits)} AS mean,
      {r('stddev_samp(actual_y1)', digits)} AS sd, {r('min(actual_y1)')} AS min, {r('max(actual_y1)')} AS max,
      count(DISTINCT episode_id) AS n_episodes, count(DISTINCT date) AS n_event_dates, {quantiles}
      FROM {source} GROUP BY disaster_type, split"""


_RULES = {
    "train_only_fit": "train_mae < val_mae * 0.85 AND train_mae < test_mae * 0.85 AND train_r2 - greatest(val_r2, test_r2) >= 0.20",
    "validation_to_test_drop": "test_mae > val_mae * 1.15 AND val_r2 - test_r2 >= 0.15",
    "train_to_validation_drop": "val_mae > train_mae * 1.15 AND train_r2 - val_r2 >= 0.15",
    "comparatively_stable_by_threshold": "greatest(train_mae, val_mae, test_mae) / least(train_mae, val_mae, test_mae) - 1 <= 0.20 "
    "AND greatest(train_r2, val_r2, test_r2) - least(train_r2, val_r2, test_r2) <= 0.25",
}
_LABEL = "concat_ws('|', " + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in _RULES.items()) + ")"

ORACLE: dict[str, str] = {
    "daily_agg_null_poison": sql(f"""
      SELECT ymd AS TA_YMD, region AS MCT_SGG_CD, industry AS MCT_RY_CD, CAST(sale AS DOUBLE) AS TS_AT, CAST(uses AS DOUBLE) AS USE_CNT,
        CASE WHEN uses <> 0 THEN CAST(sale AS DOUBLE) / CAST(uses AS DOUBLE) END AS avg_price,
        CASE WHEN CAST(sale AS VARCHAR) LIKE '%.00' THEN replace(CAST(sale AS VARCHAR), '.00', '')
             ELSE rtrim(CAST(sale AS VARCHAR), '0') END AS ts_at_text
      FROM card_daily"""),
    "load_quality_report": sql(f"""
      SELECT (SELECT count(*) FROM card) AS raw_rows, (SELECT count(*) FROM card WHERE region IS NULL) AS blank_key_rows,
        count(*) FILTER (WHERE ymd = '20250230') AS bad_date_rows,
        count(*) - (SELECT count(*) FROM card_daily) AS repeated_key_rows,
        count(*) FILTER (WHERE sale IS NULL) AS missing_sales, count(*) FILTER (WHERE sale IS NULL AND sale_text <> '') AS invalid_sales,
        count(*) FILTER (WHERE uses IS NULL) AS missing_counts, count(*) FILTER (WHERE uses IS NULL AND use_text <> '') AS invalid_counts,
        count(*) FILTER (WHERE uses = 0) AS zero_counts, CAST(0 AS BIGINT) AS unfit_sales, CAST(0 AS BIGINT) AS unfit_counts,
        (SELECT count(*) FROM card_daily) AS groups,
        (SELECT count(*) FROM card_daily WHERE sale IS NULL) AS groups_missing_sales,
        (SELECT count(*) FROM card_daily WHERE uses IS NULL) AS groups_missing_counts,
        (SELECT count(*) FROM card_daily WHERE uses = 0) AS groups_zero_count,
        (SELECT count(*) FROM card_daily WHERE sale IS NULL OR uses IS NULL OR uses = 0) AS groups_without_price,
        {day("min(CAST(strptime(CASE WHEN ymd <> '20250230' THEN ymd END, '%Y%m%d') AS DATE))")} AS min_date,
        {day("max(CAST(strptime(CASE WHEN ymd <> '20250230' THEN ymd END, '%Y%m%d') AS DATE))")} AS max_date,
        count(DISTINCT region) AS regions, count(DISTINCT industry) AS industries
      FROM card WHERE region IS NOT NULL"""),
    "parse_coercion_counts": sql(f"""
      SELECT region, count(*) AS "rows", count(sale) AS numbers, count(sale) AS exact_numbers, CAST(sum(sale) AS DOUBLE) AS exact_sum,
        count(*) FILTER (WHERE ymd <> '20250230') AS dates, CAST(sum(uses) AS DOUBLE) AS count_sum,
        {day("max(CAST(strptime(CASE WHEN ymd <> '20250230' THEN ymd END, '%Y%m%d') AS DATE))")} AS last_day
      FROM card GROUP BY region"""),
    "first_keys_sample": sql(f"""
      SELECT ymd AS TA_YMD, region AS MCT_SGG_CD, industry AS MCT_RY_CD, CAST(sale AS DOUBLE) AS TS_AT, CAST(uses AS DOUBLE) AS USE_CNT,
        CASE WHEN uses <> 0 THEN CAST(sale AS DOUBLE) / CAST(uses AS DOUBLE) END AS avg_price
      FROM card_daily ORDER BY ymd, region, industry LIMIT 10"""),
    "warning_rows": sql(f"""
      SELECT {day()} AS date, region AS MCT_SGG_CD, heatwave, heat_alert_status, heat_impact_forecast, avg_temp,
        min_temp, max_temp, cold_wave, cold_alert_status, cold_impact_forecast FROM warnings"""),
    "hourly_to_daily_complete": sql(f"""
      SELECT region, {day()} AS date, {r('rainfall')} AS rainfall, rain_observation_hours, rain_valid_hours, rainfall_complete FROM rain_days"""),
    "rain_quantile_thresholds": sql(f"""
      SELECT d.region, {r('q90')} AS q90, {r('q95')} AS q95, {r('q99')} AS q99, count(*) AS complete_days,
        count(*) FILTER (WHERE rainfall >= q90) AS days_from_q90, count(*) FILTER (WHERE rainfall >= q95) AS days_from_q95,
        count(*) FILTER (WHERE rainfall >= q99) AS days_from_q99
      FROM rain_days d JOIN (SELECT region, quantile_cont(rainfall, 0.9) AS q90, quantile_cont(rainfall, 0.95) AS q95,
          quantile_cont(rainfall, 0.99) AS q99 FROM rain_days WHERE rainfall_complete = 1 GROUP BY region) q ON q.region = d.region
      WHERE rainfall_complete = 1 GROUP BY d.region, q90, q95, q99"""),
    "rolling3h_exposure": sql(f"""
      SELECT region, {day()} AS date, heavy_rain, {r('rain_3h_max_mm')} AS rain_3h_max_mm, rain_3h_valid_windows FROM exposure"""),
    "daily_weather": sql(f"""
      SELECT {day('s.date')} AS date, s.region AS MCT_SGG_CD, heatwave, heat_alert_status, heat_impact_forecast, CAST(NULL AS INTEGER) AS heavy_rain,
        cold_wave, cold_alert_status, cold_impact_forecast, avg_temp, min_temp, max_temp, {r('rainfall')} AS rainfall,
        rain_observation_hours, rain_valid_hours, rainfall_complete
      FROM all_spine s LEFT JOIN warnings w ON w.date = s.date AND w.region = s.region
      LEFT JOIN rain_days d ON d.date = s.date AND d.region = s.region"""),
    "daily_weather_with_exposure": sql(f"""
      SELECT {day('s.date')} AS date, s.region AS MCT_SGG_CD, heatwave, cold_wave, heavy_rain, {r('rainfall')} AS rainfall,
        {r('rain_3h_max_mm')} AS rain_3h_max_mm, rain_3h_valid_windows
      FROM all_spine s LEFT JOIN warnings w ON w.date = s.date AND w.region = s.region
      LEFT JOIN rain_days d ON d.date = s.date AND d.region = s.region
      LEFT JOIN exposure x ON x.date = s.date AND x.region = s.region"""),
    "calendar_spine_join": sql(f"""
      SELECT {day()} AS date, MCT_SGG_CD, heatwave, cold_wave, heavy_rain, avg_temp, min_temp,
        max_temp, rainfall, rain_observation_hours, rain_valid_hours, rainfall_complete, rain_3h_max_mm, rain_3h_valid_windows
      FROM weather_days"""),
    "panel_left_join": sql(f"""
      SELECT {day()} AS date, MCT_SGG_CD, MCT_RY_CD, CAST(sales AS DOUBLE) AS TS_AT, units AS USE_CNT,
        CAST(sales AS DOUBLE) / units AS avg_price, heatwave, heavy_rain, cold_wave, avg_temp,
        min_temp, max_temp, rainfall, rain_observation_hours, rain_valid_hours,
        rainfall_complete, rain_3h_max_mm, rain_3h_valid_windows
      FROM joined"""),
    "panel_left_join_match_rate": sql(f"""
      SELECT MCT_SGG_CD, count(*) AS "rows", count(*) FILTER (WHERE matched) AS matched_rows,
        {r('count(*) FILTER (WHERE matched) / count(*)')} AS match_rate, count(DISTINCT CASE WHEN heavy_rain = 1 THEN date END) AS event_dates
      FROM joined GROUP BY MCT_SGG_CD"""),
    "unmatched_keys": sql(f"SELECT DISTINCT {day()} AS date, MCT_SGG_CD FROM joined WHERE NOT matched"),
    "missing_by_column": sql(
        " UNION ALL ".join(
            f"SELECT '{c}' AS \"column\", count(*) AS \"rows\", count(*) - count({c}) AS missing FROM joined"
            for c in ("heatwave", "heavy_rain", "cold_wave", "avg_temp", "min_temp", "max_temp", "rainfall")
        )
    ),
    "industry_row_counts": sql('SELECT MCT_RY_CD, count(*) AS "rows" FROM panel GROUP BY MCT_RY_CD'),
    "panel_coverage": sql(f"""
      SELECT {day('min(date)')} AS min_date, {day('max(date)')} AS max_date, count(*) AS dates, min(n) AS min_rows_per_date, max(n) AS max_rows_per_date,
        CAST(datediff('day', min(date), max(date)) + 1 AS INTEGER) AS calendar_days, max(series) AS series,
        (SELECT count(*) FROM (SELECT count(*) AS c FROM wide_panel GROUP BY {KEYS}) WHERE c <
          (SELECT datediff('day', min(date), max(date)) + 1 FROM wide_panel)) AS series_with_missing_dates
      FROM (SELECT date, count(*) AS n FROM wide_panel GROUP BY date),
        (SELECT count(*) AS series FROM (SELECT DISTINCT {KEYS} FROM wide_panel))"""),
    "series_densified": sql(f"""
      SELECT MCT_SGG_CD, MCT_RY_CD, {day('g.date')} AS date, CAST(p.sales AS DOUBLE) AS TS_AT
      FROM (SELECT e.*, CAST(d.d AS DATE) AS date FROM (SELECT DISTINCT {KEYS} FROM panel) e,
          (SELECT unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS d FROM panel) d) g
      LEFT JOIN panel p USING (date, MCT_SGG_CD, MCT_RY_CD)"""),
    "key_audits": sql(
        audit(
            duplicate_panel_keys=f"SELECT 1 FROM panel GROUP BY date, {KEYS} HAVING count(*) > 1",
            duplicate_line_keys="SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1",
            null_keys="SELECT 1 FROM panel WHERE date IS NULL OR MCT_SGG_CD IS NULL OR MCT_RY_CD IS NULL",
            null_flags="SELECT 1 FROM panel WHERE heatwave IS NULL",
            flag_domain="SELECT heatwave FROM panel WHERE heatwave NOT IN (0, 1) GROUP BY heatwave",
            status_domain="SELECT l_linestatus FROM lineitem WHERE l_linestatus <> 'F' GROUP BY l_linestatus",
            flag_conflicts="SELECT 1 FROM panel GROUP BY date, MCT_SGG_CD HAVING count(DISTINCT heatwave) > 1 OR count(DISTINCT cold_wave) > 1",
            duplicate_hours="SELECT 1 FROM hours GROUP BY region, date, hour HAVING count(*) > 1",
            october_not_positive=f"SELECT 1 FROM panel WHERE month(date) = 10 GROUP BY {KEYS} HAVING avg(sales) <= 0",
            rows_changed_by_join="SELECT 1 WHERE (SELECT count(*) FROM panel) <> (SELECT count(*) FROM joined)",
            varying_status="SELECT 1 FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_linestatus) > 1",
            unmapped_station_days="SELECT 1 FROM events GROUP BY date_trunc('hour', ts) HAVING count(DISTINCT event_type) > 1",
        )
    ),
    "october_baseline_filter": sql(f"""
      SELECT {day()} AS date, MCT_SGG_CD, MCT_RY_CD, CAST(sales AS DOUBLE) AS TS_AT, {r('october_mean')} AS october_mean, october_n,
        {r('100.0 * (CAST(sales AS DOUBLE) - october_mean) / october_mean')} AS Y FROM october_wide"""),
    "october_baseline_dense": sql(f"""
      SELECT {day()} AS date, MCT_SGG_CD, MCT_RY_CD, {r('m')} AS october_mean, n AS october_n, {r('100.0 * (CAST(sales AS DOUBLE) - m) / m')} AS Y
      FROM panel JOIN (SELECT {KEYS}, CAST(sum(sales) AS DOUBLE) / count(*) AS m, count(*) AS n FROM panel WHERE month(date) = 10
        GROUP BY {KEYS}) o USING (MCT_SGG_CD, MCT_RY_CD) WHERE n >= 18"""),
    "october_group_counts": sql(f"""
      SELECT 'before' AS stage, count(*) AS "rows", count(DISTINCT MCT_SGG_CD || '/' || MCT_RY_CD) AS groups FROM wide_panel
      UNION ALL SELECT 'after', count(*), count(DISTINCT MCT_SGG_CD || '/' || MCT_RY_CD) FROM october_wide"""),
    "train_baseline_y1": sql(f"""
      SELECT disaster_type, {day()} AS date, MCT_SGG_CD, MCT_RY_CD, split, {r('base')} AS base, {r('actual_y1')} AS actual_y1 FROM events_y1"""),
    "train_baselines": sql(f"SELECT hazard, MCT_SGG_CD, MCT_RY_CD, {r('base')} AS baseline, 'train' AS baseline_source_split FROM bases"),
    "target_audit": sql("""
      SELECT 'heatwave' AS hazard, count(*) FILTER (WHERE heatwave = 0 AND month(date) IN (7,8,9) AND split = 'train') AS baseline_rows,
        count(*) FILTER (WHERE heatwave = 1 AND month(date) IN (7,8,9)) AS target_rows, CAST(0 AS BIGINT) AS targets_on_baseline_rows,
        count(*) FILTER (WHERE heatwave = 1 AND month(date) IN (7,8,9)) - (SELECT count(*) FROM events_y1 WHERE disaster_type = 'heatwave') AS targets_without_baseline
      FROM panel JOIN dates USING (date)
      UNION ALL
      SELECT 'cold_wave', count(*) FILTER (WHERE cold_wave = 0 AND month(date) IN (11,12) AND split = 'train'),
        count(*) FILTER (WHERE cold_wave = 1 AND month(date) IN (11,12)), 0,
        count(*) FILTER (WHERE cold_wave = 1 AND month(date) IN (11,12)) - (SELECT count(*) FROM events_y1 WHERE disaster_type = 'cold_wave')
      FROM panel JOIN dates USING (date)"""),
    "calendar_lag_rolling": sql(f"""
      SELECT {day()} AS date, MCT_SGG_CD, MCT_RY_CD, lag1, lag7, {r('rolling7')} AS rolling7, {r('rolling28')} AS rolling28 FROM lagged"""),
    "customer_lag_rolling": sql(f"""
      SELECT {day('p.date')} AS date, p.MCT_RY_CD, CAST(p.sales AS DOUBLE) AS TS_AT, CAST(a.sales AS DOUBLE) AS lag1, CAST(b.sales AS DOUBLE) AS lag7,
        {r('CASE WHEN count(p.sales) OVER w7 = 7 THEN CAST(sum(p.sales) OVER w7 AS DOUBLE) / 7 END')} AS rolling7,
        {r('CASE WHEN count(p.sales) OVER w28 = 28 THEN CAST(sum(p.sales) OVER w28 AS DOUBLE) / 28 END')} AS rolling28
      FROM customer_days p LEFT JOIN customer_days a ON a.MCT_RY_CD = p.MCT_RY_CD AND a.date = p.date - 1
      LEFT JOIN customer_days b ON b.MCT_RY_CD = p.MCT_RY_CD AND b.date = p.date - 7
      WINDOW w7 AS (PARTITION BY p.MCT_RY_CD ORDER BY p.date RANGE BETWEEN INTERVAL 7 DAYS PRECEDING AND INTERVAL 1 DAYS PRECEDING),
        w28 AS (PARTITION BY p.MCT_RY_CD ORDER BY p.date RANGE BETWEEN INTERVAL 28 DAYS PRECEDING AND INTERVAL 1 DAYS PRECEDING)"""),
    "customer_october_baseline": sql(f"""
      SELECT {day()} AS date, MCT_RY_CD, {r('m')} AS october_mean, n AS october_n, {r('100.0 * (CAST(sales AS DOUBLE) - m) / m')} AS Y
      FROM customer_days JOIN (SELECT MCT_RY_CD, CAST(sum(sales) AS DOUBLE) / count(*) AS m, count(*) AS n FROM customer_days
        WHERE month(date) = 10 GROUP BY MCT_RY_CD) o USING (MCT_RY_CD)"""),
    "lag_audit": sql(
        " UNION ALL ".join(
            f"SELECT '{c}' AS feature, count(*) AS \"rows\", count({c}) AS present, CAST(0 AS BIGINT) AS mismatches FROM lagged"
            for c in ("lag1", "lag7", "rolling7", "rolling28")
        )
    ),
    "calendar_parts": f"""
      SELECT {day("date_trunc('week', o_orderdate)")} AS week, CAST(month(o_orderdate) AS INTEGER) AS month,
        CAST(isodow(o_orderdate) - 1 AS INTEGER) AS weekday, count(*) AS "rows" FROM orders GROUP BY 1, 2, 3""",
    "region_day_flags": sql(f"SELECT {day()} AS date, MCT_SGG_CD, heatwave, cold_wave FROM flags"),
    "event_episodes": sql(f"""
      SELECT episode_id, hazard, region, {day('start_date')} AS start_date, {day('end_date')} AS end_date, days,
        (SELECT string_agg(strftime(w.week, '%Y-%m-%d'), '|' ORDER BY w.week) FROM weeks w
         WHERE w.week >= CAST(date_trunc('week', e.start_date) AS DATE) AND w.week <= e.end_date) AS weeks FROM eps e"""),
    "week_components": sql(f"SELECT {day()} AS date, {day('week')} AS week, component_no, component FROM dates"),
    "component_stats": sql("SELECT * FROM components"),
    "split_score": sql(f"""
      SELECT candidate, train_dates, validation_dates, test_dates, empty_cells, {r('score')} AS score FROM (
        SELECT candidate, CAST(max(d) FILTER (WHERE split = 'train') AS BIGINT) AS train_dates,
          CAST(max(d) FILTER (WHERE split = 'validation') AS BIGINT) AS validation_dates, CAST(max(d) FILTER (WHERE split = 'test') AS BIGINT) AS test_dates,
          CAST(sum(CAST(h = 0 AS INTEGER) + CAST(c = 0 AS INTEGER)) AS INTEGER) AS empty_cells,
          sum(4 * power(d / nd - ratio, 2) + 2 * power(h / nh - ratio, 2) + 2 * power(c / nc - ratio, 2)
            + 100 * (CAST(h = 0 AS INTEGER) + CAST(c = 0 AS INTEGER))) AS score
        FROM (SELECT k.candidate, s.split, s.ratio,
            CAST(coalesce(sum(a.dates), 0) AS DOUBLE) AS d, CAST(coalesce(sum(a.heatwave), 0) AS DOUBLE) AS h, CAST(coalesce(sum(a.cold_wave), 0) AS DOUBLE) AS c
          FROM (SELECT CAST(unnest(range(50)) AS INTEGER) AS candidate) k
          CROSS JOIN (VALUES ('train', CAST(0.7 AS DOUBLE)), ('validation', CAST(0.15 AS DOUBLE)), ('test', CAST(0.15 AS DOUBLE))) s(split, ratio)
          LEFT JOIN components a ON {SLOT.format('((a.component_no * (k.candidate + 3) + k.candidate) % 7)')} = s.split
          GROUP BY k.candidate, s.split, s.ratio) x,
          (SELECT CAST(sum(dates) AS DOUBLE) AS nd, greatest(CAST(sum(heatwave) AS DOUBLE), 1) AS nh, greatest(CAST(sum(cold_wave) AS DOUBLE), 1) AS nc FROM components) t
        GROUP BY candidate)"""),
    "split_leak_audit": sql(
        audit(
            by_component="SELECT 1 FROM dates GROUP BY component HAVING count(DISTINCT split) > 1",
            episodes_by_component="SELECT 1 FROM ep_days e JOIN dates d ON e.date = d.date GROUP BY episode_id HAVING count(DISTINCT d.split) <> 1",
            by_day=f"""SELECT week FROM (SELECT *, {SLOT.format(f"({DAYNO} % 7)")} AS s FROM dates) GROUP BY week HAVING count(DISTINCT s) > 1
              UNION ALL SELECT NULL FROM (SELECT *, {SLOT.format(f"({DAYNO} % 7)")} AS s FROM dates) GROUP BY component HAVING count(DISTINCT s) > 1""",
            episodes_by_day=f"SELECT 1 FROM (SELECT *, {SLOT.format(f'({DAYNO} % 7)')} AS s FROM ep_days) GROUP BY episode_id HAVING count(DISTINCT s) <> 1",
            empty_hazard_splits="""SELECT 1 FROM (VALUES ('train'), ('validation'), ('test')) s(split), (VALUES ('heatwave'), ('cold_wave')) h(hazard)
              WHERE NOT EXISTS (SELECT 1 FROM flagged f JOIN dates d ON f.date = d.date WHERE d.split = s.split AND f.hazard = h.hazard)""",
            overlapping_episodes="SELECT 1 FROM ep_days GROUP BY disaster_type, region, date HAVING count(*) > 1",
        )
    ),
    "split_report": sql(f"""
      SELECT s.split, count(*) AS dates, {r("count(*) / (SELECT count(*) FROM dates)")} AS share, count(DISTINCT s.week) AS weeks,
        (SELECT count(*) FROM eps e JOIN dates d ON d.date = e.start_date WHERE d.split = s.split) AS episodes,
        (SELECT count(*) FROM flags f JOIN dates d ON d.date = f.date WHERE d.split = s.split AND heatwave = 1) AS heatwave_region_days,
        (SELECT count(*) FROM flags f JOIN dates d ON d.date = f.date WHERE d.split = s.split AND cold_wave = 1) AS cold_wave_region_days
      FROM dates s GROUP BY s.split"""),
    "episode_day_map": sql(f"SELECT disaster_type AS hazard, region, episode_id, {day()} AS date FROM ep_days"),
    "flow_profile_unpivot": sql(f"SELECT year, region, month, CAST(weekday AS INTEGER) AS weekday, CAST(flow_pop_weekday AS DOUBLE) AS flow_pop_weekday FROM profile"),
    "flow_coverage": sql("""
      SELECT ym AS STD_YM, count(DISTINCT prefix || '-' || segment) AS matched_rows, count(DISTINCT prefix || '-' || segment) AS matched_blocks,
        string_agg(DISTINCT prefix, '|' ORDER BY prefix) AS prefixes FROM mapped GROUP BY ym"""),
    "unknown_prefixes": sql(f"SELECT DISTINCT prefix FROM flow WHERE {_cases('prefix', FLOW_PREFIXES)} IS NULL"),
    "flow_audits": sql(
        audit(
            bad_files="SELECT 1 FROM mapped WHERE price IS NULL",
            repeated_rows="SELECT 1 WHERE 1 = 0",
            pooled_years="SELECT 1 FROM profile GROUP BY region, month, weekday HAVING count(*) > 1",
            by_year="SELECT 1 FROM profile GROUP BY year, region, month, weekday HAVING count(*) > 1",
        )
    ),
    "panel_flow_join": sql(f"""
      SELECT {day('p.date')} AS date, MCT_SGG_CD, MCT_RY_CD, CAST(month(p.date) AS INTEGER) AS month, CAST(isodow(p.date) - 1 AS INTEGER) AS weekday,
        CAST(f.flow_pop_weekday AS DOUBLE) AS flow_pop_weekday
      FROM panel p LEFT JOIN profile f ON f.year = year(p.date) AND f.region = p.MCT_SGG_CD AND f.month = month(p.date) AND f.weekday = isodow(p.date) - 1"""),
    "regression_metrics": sql(f"SELECT {RUN}, split, count(*) AS n, {scores('actual_y1', 'predicted_y1')} FROM preds GROUP BY {RUN}, split"),
    "mean_predictor_metrics": sql(f"""
      SELECT {RUN}, split, {scores('actual_y1', 'm', '_train_mean')} FROM preds JOIN means USING ({RUN}) GROUP BY {RUN}, split"""),
    "metrics_pivot_gaps": sql(
        f"SELECT {RUN}, "
        + ", ".join(
            (f"{p}_n" if m == "n" else f"{r(f'{p}_{m}')} AS {p}_{m}")
            for p in ("train", "val", "test")
            for m in ("mae", "rmse", "r2", "n", "train_mean_baseline_mae", "train_mean_baseline_rmse", "train_mean_baseline_r2")
        )
        + f", {r('test_mae - train_mae')} AS test_minus_train_mae, {r('test_mae - val_mae')} AS test_minus_validation_mae, {r('train_r2 - test_r2')} AS train_minus_test_r2 FROM wide"
    ),
    "stability_labels": sql(f"""
      SELECT {RUN}, {r('(val_mae / train_mae - 1.0) * 100.0')} AS train_to_validation_mae_change_pct,
        {r('(test_mae / val_mae - 1.0) * 100.0')} AS validation_to_test_mae_change_pct, {r('(test_mae / train_mae - 1.0) * 100.0')} AS train_to_test_mae_change_pct,
        {r('train_r2 - val_r2')} AS train_to_validation_r2_drop, {r('val_r2 - test_r2')} AS validation_to_test_r2_drop,
        CASE WHEN {_LABEL} = '' THEN 'mixed_or_no_large_gap_by_threshold' ELSE {_LABEL} END AS stability_assessment FROM wide"""),
    "leaders_topk": sql(f"""
      SELECT v.disaster_type, v.feature_set, v.model AS best_validation_model, {r('v.val_mae')} AS best_validation_val_mae,
        {r('v.test_mae')} AS best_validation_test_mae, t.model AS best_test_model, {r('t.test_mae')} AS best_test_test_mae, {r('t.val_mae')} AS best_test_val_mae
      FROM (SELECT *, row_number() OVER (PARTITION BY disaster_type, feature_set ORDER BY val_mae, test_mae, model) AS k FROM wide) v
      JOIN (SELECT *, row_number() OVER (PARTITION BY disaster_type, feature_set ORDER BY test_mae, val_mae, model) AS k FROM wide) t
        ON v.disaster_type = t.disaster_type AND v.feature_set = t.feature_set WHERE v.k = 1 AND t.k = 1"""),
    "top_runs": sql(f"""
      SELECT {RUN}, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY disaster_type, feature_set ORDER BY val_mae, test_mae, model) AS INTEGER) AS rank
      FROM wide) WHERE rank <= 3"""),
    "subgroup_response": sql(f"""
      SELECT {RUN}, region, industry, count(*) AS n, {r('avg(actual_y1)')} AS observed_mean_y1, {r('avg(predicted_y1)')} AS predicted_mean_y1,
        {r('stddev_samp(actual_y1)')} AS observed_sd_y1 FROM preds WHERE split = 'test' GROUP BY {RUN}, region, industry"""),
    "largest_responses": sql(f"""
      SELECT disaster_type, region, industry, n, {r('m')} AS observed_mean_y1, rank FROM (
        SELECT *, CAST(row_number() OVER (PARTITION BY disaster_type ORDER BY abs(m) DESC, region, industry) AS INTEGER) AS rank FROM (
          SELECT disaster_type, region, industry, count(*) AS n, avg(actual_y1) AS m FROM saved WHERE split = 'test' GROUP BY 1, 2, 3)) WHERE rank <= 10"""),
    "episode_day_summary": sql(f"""
      SELECT {EPISODE}, {day()} AS date, {r('avg(actual_y1)')} AS date_actual_mean, {r('avg(predicted_y1)')} AS date_predicted_mean,
        count(DISTINCT industry) AS industries_observed, count(*) AS "rows" FROM saved GROUP BY {EPISODE}, saved.date"""),
    "episode_summary": sql(f"""
      SELECT d.*, {r('a.am')} AS actual_y1_row_mean, {r('a.pm')} AS predicted_y1_row_mean, {r('a.sd')} AS actual_y1_row_sd,
        i.industry_count, i.industries_negative_mean, i.industries_positive_mean, {r('a.med')} AS actual_y1_row_median
      FROM (SELECT {EPISODE}, count(*) AS event_days, {r('avg(am)')} AS actual_y1_day_equal_mean, {r('avg(pm)')} AS predicted_y1_day_equal_mean,
          {r('quantile_cont(am, 0.5)')} AS actual_y1_day_equal_median, {r('quantile_cont(pm, 0.5)')} AS predicted_y1_day_equal_median,
          max(k) AS industries_max_day, CAST(sum(n) AS BIGINT) AS "rows",
          {r('avg(pm) - avg(am)')} AS episode_error_y1, {r('abs(avg(pm) - avg(am))')} AS episode_absolute_error_y1
        FROM (SELECT {EPISODE}, date, avg(actual_y1) AS am, avg(predicted_y1) AS pm, count(DISTINCT industry) AS k, count(*) AS n FROM saved GROUP BY ALL)
        GROUP BY {EPISODE}) d
      JOIN (SELECT {EPISODE}, avg(actual_y1) AS am, avg(predicted_y1) AS pm, stddev_samp(actual_y1) AS sd, quantile_cont(actual_y1, 0.5) AS med
        FROM saved GROUP BY ALL) a USING ({EPISODE})
      JOIN (SELECT {EPISODE}, count(*) AS industry_count, count(*) FILTER (WHERE m < 0) AS industries_negative_mean, count(*) FILTER (WHERE m > 0) AS industries_positive_mean
        FROM (SELECT {EPISODE}, industry, avg(actual_y1) AS m FROM saved GROUP BY ALL) GROUP BY {EPISODE}) i USING ({EPISODE})"""),
    "industry_episode_comparison": sql(f"""
      SELECT disaster_type, split, episode_id, industry, {r('am')} AS actual_mean_y1, {r('pm')} AS predicted_mean_y1, {r('med')} AS actual_median_y1,
        {r('sd')} AS actual_sd_y1, n AS observation_rows, dates AS event_dates, {r('pm - am')} AS error_y1 FROM within_industry"""),
    "entity_episode_summary": sql(f"""
      SELECT disaster_type, split, region, count(*) AS episode_count, {r('avg(am)')} AS mean_episode_actual_y1, {r('quantile_cont(am, 0.5)')} AS median_episode_actual_y1,
        {r('stddev_samp(am)')} AS sd_episode_actual_y1, {r('quantile_cont(am, 0.1)')} AS p10_episode_actual_y1, {r('quantile_cont(am, 0.9)')} AS p90_episode_actual_y1,
        {r('avg(pm)')} AS mean_episode_predicted_y1, {r('avg(pm - am)')} AS mean_episode_error_y1, count(*) FILTER (WHERE am < 0) AS episodes_actual_negative,
        count(*) FILTER (WHERE pm < 0) AS episodes_predicted_negative, count(*) FILTER (WHERE sign(am) = sign(pm)) AS episodes_sign_agree
      FROM within_region GROUP BY disaster_type, split, region"""),
    "industry_episode_summary": sql(f"""
      SELECT disaster_type, split, industry, count(*) AS episode_count, {r('avg(am)')} AS mean_episode_actual_y1, {r('quantile_cont(am, 0.5)')} AS median_episode_actual_y1,
        {r('stddev_samp(am)')} AS sd_episode_actual_y1, {r('quantile_cont(am, 0.1)')} AS p10_episode_actual_y1, {r('quantile_cont(am, 0.9)')} AS p90_episode_actual_y1,
        {r('avg(pm)')} AS mean_episode_predicted_y1, {r('avg(pm - am)')} AS mean_episode_error_y1, count(*) FILTER (WHERE am < 0) AS episodes_actual_negative,
        count(*) FILTER (WHERE pm < 0) AS episodes_predicted_negative, count(*) FILTER (WHERE sign(am) = sign(pm)) AS episodes_sign_agree
      FROM within_industry GROUP BY disaster_type, split, industry"""),
    "response_distribution": sql(_distribution("saved")),
    "price_distribution": _distribution(
        "(SELECT l_returnflag AS disaster_type, l_linestatus AS split, l_suppkey AS episode_id, CAST(l_shipdate AS DATE) AS date, l_extendedprice AS actual_y1 FROM lineitem)", 3
    ),
    "outlier_sensitivity": sql(f"""
      SELECT disaster_type, sample, {r('lo')} AS train_p01, {r('hi')} AS train_p99, count(y) AS n, {scores('y', 'p')}, count(*) - count(y) AS excluded_test_rows
      FROM (SELECT disaster_type, lo, hi, 'test_all' AS sample, actual_y1 AS y, predicted_y1 AS p FROM saved JOIN bounds USING (disaster_type) WHERE split = 'test'
        UNION ALL SELECT disaster_type, lo, hi, 'test_inside_train_p01_p99', CASE WHEN actual_y1 BETWEEN lo AND hi THEN actual_y1 END,
          CASE WHEN actual_y1 BETWEEN lo AND hi THEN predicted_y1 END FROM saved JOIN bounds USING (disaster_type) WHERE split = 'test'
        UNION ALL SELECT disaster_type, lo, hi, 'test_winsorized_train_p01_p99', greatest(lo, least(hi, actual_y1)), greatest(lo, least(hi, predicted_y1))
          FROM saved JOIN bounds USING (disaster_type) WHERE split = 'test')
      GROUP BY disaster_type, sample, lo, hi"""),
    "outlier_rows": sql(f"""
      SELECT disaster_type, {day()} AS date, region, industry, {r('predicted_y1 - actual_y1')} AS error_y1, {r('abs(predicted_y1 - actual_y1)')} AS abs_error_y1,
        {r('lo')} AS train_p01, {r('hi')} AS train_p99, actual_y1 NOT BETWEEN lo AND hi AS outside_train_p01_p99
      FROM saved JOIN bounds USING (disaster_type) WHERE split = 'test'"""),
    "prediction_diff": sql(f"""
      SELECT count(a.date) AS left_rows, count(b.date) AS right_rows, count(*) FILTER (WHERE a.date IS NOT NULL AND b.date IS NOT NULL) AS matched_rows,
        {r('max(abs(a.predicted_y1 - b.predicted_y1))')} AS max_absolute_difference
      FROM (SELECT * FROM preds WHERE model = 'Ridge' AND feature_set = 'B_plus_past_sales') a
      FULL JOIN (SELECT * FROM preds WHERE model = 'Random Forest' AND feature_set = 'B_plus_past_sales') b
        ON a.disaster_type = b.disaster_type AND a.date = b.date AND a.region = b.region AND a.industry = b.industry"""),
    "permutation_importance_linear": _permutation_sql({f: (f,) for f in ("avg_temp", "lag1", "lag7", "rolling7")}, 10, 20261003),
    "permutation_importance_grouped": _permutation_sql({"weather": ("avg_temp",), "lag": ("lag1", "lag7"), "rolling": ("rolling7",)}, 50, 7),
    "importance_top10": _importances(f"""
      SELECT {RUN}, feature, {r('importance_mean')} AS importance_mean, rank FROM (
        SELECT *, CAST(row_number() OVER (PARTITION BY {RUN} ORDER BY importance_mean DESC, feature) AS INTEGER) AS rank
        FROM importances) WHERE rank <= 10"""),
    "importance_by_group": _importances(f"""
      SELECT {RUN}, CASE WHEN feature LIKE '%temp' THEN 'weather' WHEN feature = 'MCT_SGG_CD' THEN 'region' WHEN feature = 'MCT_RY_CD' THEN 'industry'
          WHEN feature = 'flow_pop_weekday' THEN 'flow_population' ELSE 'past_sales' END AS feature_group, {r('sum(importance_mean)')} AS importance_mean
      FROM importances WHERE ({RUN}) IN (SELECT ({RUN}) FROM (SELECT {RUN}, row_number() OVER (PARTITION BY disaster_type, feature_set ORDER BY val_mae, test_mae, model) AS k
        FROM wide) WHERE k <= 3) GROUP BY {RUN}, 4"""),
    "impute_scale": sql(f"""
      SELECT disaster_type, feature, {r('median')} AS median, count(*) AS "rows", count(*) - count(value) AS missing, {r('avg(coalesce(value, median))')} AS mean,
        {r('stddev_pop(coalesce(value, median))')} AS sd FROM filled GROUP BY disaster_type, feature, median"""),
    "category_modes": " UNION ALL ".join(
        f"(SELECT '{c}' AS feature, CAST({c} AS VARCHAR) AS mode FROM lineitem GROUP BY {c} ORDER BY count(*) DESC, CAST({c} AS VARCHAR) LIMIT 1)"
        for c in ("l_returnflag", "l_linestatus", "l_suppkey")
    ),
    "exact_quantiles_by_supplier": f"""
      SELECT l_suppkey, {r('quantile_cont(l_extendedprice, 0.1)')} AS p10, {r('quantile_cont(l_extendedprice, 0.5)')} AS p50,
        {r('quantile_cont(l_extendedprice, 0.9)')} AS p90 FROM lineitem GROUP BY l_suppkey""",
    # least squares is unique on the train rows only, where columns may depend on each other
    "model_grid_linear": sql(f"""
      SELECT {RUN}, split, count(*) AS n, {r('avg(y)')} AS mean_actual_y1, {r('avg(p)')} AS mean_prediction, {r('avg(abs(p - y))')} AS mae,
        {r('sqrt(avg((p - y) * (p - y)))')} AS rmse FROM fitted WHERE model = 'Ridge' OR split = 'train' GROUP BY {RUN}, split"""),
    "forest_metrics": _tree_facts("Random Forest"),
    "extra_trees_metrics": _tree_facts("Extra Trees"),
    "squared_boosting_metrics": _tree_facts("HistGradientBoosting"),
    "huber_boosting_metrics": _tree_facts("Gradient Boosting"),
    "boosting_first_split": sql(f"""
      SELECT disaster_type, n, {r('s')} AS leaf_sum, {r('s / (n + 2.0)')} AS leaf_value FROM (
        SELECT c.disaster_type, unnest([ln, tn - ln]) AS n, unnest([ls, -ls]) AS s FROM (
          SELECT disaster_type, ln, ls, tn FROM (
            SELECT t.disaster_type, t.kind, t.cut, count(*) FILTER (WHERE t.goes) AS ln, sum(t.z) FILTER (WHERE t.goes) AS ls, count(*) AS tn
            FROM (SELECT e.disaster_type, c.kind, c.cut, CASE WHEN c.kind = 'MCT_SGG_CD' THEN e.MCT_SGG_CD = c.cut WHEN c.kind = 'MCT_RY_CD' THEN e.MCT_RY_CD = c.cut
                ELSE CASE c.kind WHEN 'degree' THEN floor(e.avg_temp) WHEN 'month' THEN e.month ELSE e.weekday END <= CAST(c.cut AS DOUBLE) END AS goes,
                e.y - avg(e.y) OVER (PARTITION BY e.disaster_type, c.kind, c.cut) AS z
              FROM fit_rows e JOIN (
                SELECT DISTINCT disaster_type, f.kind, f.cut FROM fit_rows r, LATERAL (VALUES ('degree', CAST(floor(r.avg_temp) AS VARCHAR)),
                  ('month', CAST(r.month AS VARCHAR)), ('weekday', CAST(r.weekday AS VARCHAR)), ('MCT_SGG_CD', r.MCT_SGG_CD), ('MCT_RY_CD', r.MCT_RY_CD)) f(kind, cut)
                WHERE split = 'train') c USING (disaster_type) WHERE e.split = 'train') t GROUP BY ALL)
          WHERE ln >= 20 AND tn - ln >= 20
          QUALIFY row_number() OVER (PARTITION BY disaster_type ORDER BY round(ls * ls / (ln + 2.0) + ls * ls / (tn - ln + 2.0), 6) DESC, kind, cut) = 1) c)"""),
    "split_search": sql("""
      SELECT count(*) AS components, count(*) AS distinct_components, CAST(3 AS BIGINT) AS splits, CAST(0 AS BIGINT) AS leaks,
        true AS no_worse_than_arithmetic, true AS score_agrees FROM components"""),
    "impact_pipeline": sql("""
      SELECT disaster_type, MCT_SGG_CD, MCT_RY_CD, count(*) AS event_rows, count(*) FILTER (WHERE in_season) AS with_target, CAST(3 AS BIGINT) AS splits
      FROM (SELECT 'heatwave' AS disaster_type, MCT_SGG_CD, MCT_RY_CD, month(date) IN (7,8,9) AS in_season FROM panel WHERE heatwave = 1
        UNION ALL SELECT 'cold_wave', MCT_SGG_CD, MCT_RY_CD, month(date) IN (11,12) FROM panel WHERE cold_wave = 1) GROUP BY ALL"""),
    "linear_fit": _fit("sum(x * y) / sum(x * x)"),
    "ridge_fit": _fit("sum(x * y) / (sum(x * x) + 10.0)"),
}

# files are written from the same tables, so what is read back has the same answers
ORACLE |= {
    "card_files": ORACLE["daily_agg_null_poison"],
    "picked_source": f"SELECT *, '2-card' AS folder, CAST(4 AS BIGINT) AS files_read FROM ({ORACLE['daily_agg_null_poison']})",
    "run_metadata": sql(f"""
      SELECT 'Ridge' AS model, 'B_plus_past_sales' AS feature_set, count(*) AS n_rows, count(DISTINCT date) AS n_dates,
        {day('min(date)')} AS first_date, {day('max(date)')} AS last_date, count(*) FILTER (WHERE split = 'train') AS n_train,
        count(*) FILTER (WHERE split = 'validation') AS n_validation, count(*) FILTER (WHERE split = 'test') AS n_test,
        {r('avg(actual_y1)')} AS mean_actual_y1, {r('avg(abs(actual_y1 - predicted_y1))')} AS mae,
        'avg_temp|min_temp|max_temp|lag1|lag7|rolling7|rolling28|MCT_SGG_CD|MCT_RY_CD' AS features, true AS outcome_refused, true AS absent_run_refused
      FROM saved"""),
    "warning_files": ORACLE["warning_rows"],
    "hourly_files": ORACLE["hourly_to_daily_complete"],
    "flow_files": ORACLE["flow_profile_unpivot"],
    "result_csv_round_trip": f"SELECT *, true AS second_write_refused FROM ({ORACLE['episode_day_summary']})",
    "refit_reproduction": sql("""
      SELECT split, count(*) AS left_rows, count(*) AS right_rows, count(*) AS matched_rows, true AS reproduced FROM events_y1 GROUP BY split"""),
    "importance_two_samples": _two_samples(),
}
