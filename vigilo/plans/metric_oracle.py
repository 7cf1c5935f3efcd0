"""DuckDB oracle SQL for the metric queries (series keyed by pod, namespace)."""

LABELS = """'pod-' || CAST(user_id AS VARCHAR) AS pod, event_type AS namespace,
    CASE event_type WHEN 'view' THEN 'Running' WHEN 'click' THEN 'Pending' WHEN 'error' THEN 'Failed'
      WHEN 'purchase' THEN 'Succeeded' ELSE 'Unknown' END AS phase,
    CASE WHEN user_id % 5 = 0 THEN 'POD' ELSE 'app' END AS container, ts"""

V_METRIC = f"""
v_metric AS (
  SELECT {LABELS},
    sum(value) OVER (PARTITION BY user_id, event_type, CAST(ts AS DATE) ORDER BY ts, event_id
                     ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value
  FROM events),
v_gauge AS (SELECT {LABELS}, value FROM events)"""

RATE_W_US = 6 * 86400 * 1_000_000

LAST = """
last AS (
  SELECT pod, namespace, phase, arg_max(value, ts) AS value, max(ts) AS ts
  FROM v_gauge WHERE value IS NOT NULL AND NOT isnan(value) GROUP BY pod, namespace, phase)"""

def _rates(scale: int) -> str:
    return f"""WITH {V_METRIC},
      scaled AS (SELECT * REPLACE (value * {scale} AS value) FROM v_metric WHERE container <> 'POD'),
      prev AS (SELECT *, lag(value) OVER (PARTITION BY pod, namespace ORDER BY ts) AS p,
                      epoch_us(ts) AS t_us FROM scaled),
      steps AS (SELECT *, CASE WHEN p IS NULL THEN NULL WHEN value < p THEN value
                               ELSE value - p END AS step FROM prev),
      win AS (
        SELECT pod, namespace, ts, t_us,
          count(*) OVER w AS n, sum(step) OVER w AS steps,
          first_value(step) OVER w AS first_step, min(t_us) OVER w AS first_us
        FROM steps
        WINDOW w AS (PARTITION BY pod, namespace ORDER BY t_us
                     RANGE BETWEEN {RATE_W_US - 1} PRECEDING AND CURRENT ROW)),
      rates AS (SELECT pod, namespace, ts,
        round((steps - coalesce(first_step, 0.0)) / ((t_us - first_us) / 1000000.0::DOUBLE), 6) AS rate
        FROM win WHERE n >= 2)"""


def _rate(legend: str, scale: int = 1) -> str:
    return f"{_rates(scale)} SELECT pod, namespace, ts, pod || ' - {legend}' AS name, rate FROM rates"


STEP_US, LOOKBACK_US = 43_200_000_000, 86_400_000_000
V_GRID = f"""
grid AS (SELECT make_timestamp(unnest(range((min(epoch_us(ts)) // {STEP_US}) * {STEP_US},
    (max(epoch_us(ts)) + {STEP_US} - 1) // {STEP_US} * {STEP_US} + 1, {STEP_US}))) AS t FROM events)"""
# An as-of join: each grid time with each series' last sample before it.
V_INSTANT = f"""
series AS (SELECT DISTINCT pod, namespace, phase FROM v_gauge),
current AS (SELECT s.pod, s.namespace, s.phase, s.t, g.value FROM (SELECT * FROM series, grid) s
  ASOF JOIN (SELECT pod, namespace, ts, max(value) AS value FROM v_gauge GROUP BY pod, namespace, ts) g
    ON s.pod = g.pod AND s.namespace = g.namespace AND s.t >= g.ts
  WHERE epoch_us(g.ts) > epoch_us(s.t) - {LOOKBACK_US})"""

ORACLE = {
    "metric_instant_grid": f"""WITH {V_METRIC}, {V_GRID}, {V_INSTANT}
      SELECT pod, namespace, t AS ts, round(value, 6) AS value FROM current WHERE pod LIKE 'pod-1%'""",
    "metric_sum_by_step": f"""WITH {V_METRIC}, {V_GRID}, {V_INSTANT}
      SELECT t AS ts, phase, round(sum(value), 6) AS value FROM current GROUP BY t, phase""",
    "metric_rate_grid": f"""WITH {V_METRIC}, {V_GRID},
      samples AS (SELECT pod, namespace, epoch_us(ts) AS at_us, value,
          coalesce(CASE WHEN value < lag(value) OVER w THEN lag(value) OVER w END, 0.0) AS lost
        FROM v_metric WHERE container <> 'POD' WINDOW w AS (PARTITION BY pod, namespace ORDER BY ts, value)),
      wins AS (SELECT pod, namespace, t, epoch_us(t) AS t_us, count(*) AS n, min(at_us) AS a, max(at_us) AS z,
          arg_min(value, {'{'}'t': at_us, 'v': value{'}'}) AS first_v, arg_max(value, {'{'}'t': at_us, 'v': value{'}'}) AS last_v,
          sum(lost) - arg_min(lost, {'{'}'t': at_us, 'v': value{'}'}) AS lost
        FROM grid JOIN samples ON at_us <= epoch_us(t) AND at_us > epoch_us(t) - {RATE_W_US} GROUP BY pod, namespace, t HAVING count(*) >= 2),
      parts AS (SELECT *, last_v - first_v + lost AS inc, (z - a) / 1000000.0::DOUBLE AS sampled, (z - a) / 1000000.0::DOUBLE / (n - 1) AS mean,
          (a - (t_us - {RATE_W_US})) / 1000000.0::DOUBLE AS s, (t_us - z) / 1000000.0::DOUBLE AS e FROM wins WHERE z > a),
      edges AS (SELECT *, CASE WHEN s >= 1.1 * mean THEN mean / 2 ELSE s END AS s2, CASE WHEN e >= 1.1 * mean THEN mean / 2 ELSE e END AS e2,
          CASE WHEN inc > 0 AND first_v >= 0 THEN sampled * (first_v / inc) END AS zero FROM parts)
      SELECT pod, namespace, t AS ts, pod || ' - RX' AS name,
        round(inc * ((sampled + least(s2, coalesce(zero, s2)) + e2) / sampled) / {RATE_W_US / 1_000_000}, 12) AS rate FROM edges""",
    "metric_select": f"""WITH {V_METRIC}
      SELECT pod, namespace, ts, round(value, 6) AS value FROM v_gauge
      WHERE namespace = 'view' AND regexp_full_match(pod, 'pod-1.*') AND container <> 'POD'""",
    "metric_range": f"""WITH {V_METRIC}
      SELECT pod, namespace, ts, round(value, 6) AS value FROM v_gauge
      WHERE ts > (SELECT max(ts) FROM v_gauge) - INTERVAL 1 DAY
        AND ts <= (SELECT max(ts) FROM v_gauge)""",
    "metric_sum_by": f"""WITH {V_METRIC},
      vec AS (
        SELECT pod, namespace, phase, arg_max(value, ts) AS value FROM v_gauge
        WHERE ts > (SELECT max(ts) FROM v_gauge) - INTERVAL 1 DAY
          AND ts <= (SELECT max(ts) FROM v_gauge)
        GROUP BY pod, namespace, phase)
      SELECT phase, round(sum(value), 6) AS value FROM vec GROUP BY phase""",
    "metric_rate": _rate("RX"),
    "metric_tx": _rate("TX", 2),
    "metric_cpu": f"""{_rates(500)}, r AS (SELECT pod, namespace, ts, rate AS value FROM rates),
      both_ AS (SELECT pod, namespace, ts, value, 'sample' AS series FROM r UNION ALL
        SELECT NULL, NULL, ts, 0.1::DOUBLE, 'CPU Target' FROM (SELECT DISTINCT ts FROM r))
      SELECT *, CASE WHEN value >= 0.1 THEN 'red' ELSE 'green' END AS color FROM both_""",
    "metric_memory": f"""WITH {V_METRIC},
      g AS (SELECT pod, namespace, ts, round(value * 10000000, 3) AS value FROM v_gauge WHERE container <> 'POD'),
      both_ AS (SELECT pod, namespace, ts, value, 'sample' AS series FROM g UNION ALL
        SELECT NULL, NULL, ts, 358400000.0::DOUBLE, 'Memory Target' FROM (SELECT DISTINCT ts FROM g))
      SELECT *, CASE WHEN value >= 358400000 THEN 'red' ELSE 'green' END AS color FROM both_""",
    "metric_last": f"""WITH {V_METRIC}, {LAST}
      SELECT pod, namespace, ts, round(value, 6) AS value FROM last""",
    "metric_thresholds": f"""WITH {V_METRIC}, {LAST}
      SELECT pod, namespace, value,
        CASE WHEN value >= 8 THEN 'red' WHEN value >= 5 THEN 'yellow' ELSE 'green' END AS color,
        CASE phase WHEN 'Running' THEN 'Running' WHEN 'Pending' THEN 'Pending' WHEN 'Failed' THEN 'Failed'
             WHEN 'Succeeded' THEN 'Succeeded' ELSE phase END AS phase_text,
        5.0::DOUBLE AS target, value > 5.0 AS above_target
      FROM last""",
    "metric_overlay": f"""WITH {V_METRIC}
      SELECT pod, namespace, ts, round(value, 6) AS value, 'Current Replicas' AS series
      FROM v_gauge WHERE namespace = 'view'
      UNION ALL
      SELECT pod, namespace, ts, round(value, 6) AS value, 'Desired Replicas' AS series
      FROM v_gauge WHERE namespace = 'click'
      UNION ALL
      SELECT pod, namespace, ts, round(value, 6) AS value, 'Max Replicas' AS series
      FROM v_gauge WHERE namespace = 'signup'""",
}
