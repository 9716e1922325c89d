"""Shared tables of the oracle SQL, written independently of the Spark plans."""

from __future__ import annotations

import re

from tidepanel.plans.registry import grid_sql
from tidepanel.sources import schemas as S

RETAIL = """
SELECT CAST(l_shipdate AS DATE) AS date, CAST(l_partkey AS VARCHAR) AS entity_id,
  p_brand AS brand, p_name AS product_name, p_type AS category,
  sum(l_quantity) AS demand_index, avg(l_extendedprice / l_quantity) AS price_index,
  avg(l_discount) AS discount_pct, 100 * avg(l_tax) AS ad_index,
  CAST(count(*) AS DOUBLE) AS search_index,
  avg(CASE WHEN l_returnflag = 'R' THEN 0.0 ELSE 1.0 END) AS sentiment_index,
  CASE WHEN max(l_discount) >= 0.09 THEN 'promotion' ELSE 'organic' END AS event_type
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3, 4, 5"""

ACTIVITY = """
SELECT CAST(ts AS DATE) AS date, CAST(user_id AS VARCHAR) AS entity_id,
  'g' || CAST(user_id % 25 AS VARCHAR) AS brand, 'c' || CAST(user_id % 6 AS VARCHAR) AS category,
  CAST(count(*) AS DOUBLE) AS demand_index, avg(value) AS price_index,
  CAST(count(*) FILTER (event_type = 'view') AS DOUBLE) AS search_index,
  CAST(count(*) FILTER (event_type = 'click') AS DOUBLE) AS ad_index,
  avg(CASE event_type WHEN 'purchase' THEN 1.0 WHEN 'error' THEN 0.0 ELSE 0.5 END) AS sentiment_index,
  CAST(count(*) FILTER (event_type = 'signup') AS DOUBLE) AS new_reviews
FROM events GROUP BY 1, 2, 3, 4"""

INTERVENTIONS = """
SELECT CAST(event_id AS VARCHAR) AS event_id, event_id AS seq, CAST(ts AS DATE) AS date,
  CASE WHEN event_id % 50 = 0 THEN 'ALL' ELSE CAST(user_id AS VARCHAR) END AS entity_id, event_type,
  'g' || CAST(user_id % 25 AS VARCHAR) AS brand, 'c' || CAST(user_id % 6 AS VARCHAR) AS category,
  event_type || ' #' || CAST(event_id AS VARCHAR) AS event_title,
  CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'story of ' || event_type END AS signal_story,
  'event ' || CAST(event_id AS VARCHAR) AS event_description,
  CASE WHEN event_id % 2 = 0 THEN 'demand_index' ELSE 'price_index' END AS signal_target,
  value / 500 AS event_strength
FROM events WHERE event_type IN ('error', 'signup') AND value > 100"""

# One row per (entity, date, type): the last by sequence.
EVENTS_BY_TYPE = """
SELECT entity_id, date, event_type, event_strength AS event_intensity_score FROM (
  SELECT *, row_number() OVER (PARTITION BY entity_id, date, event_type ORDER BY seq DESC) AS n
  FROM interventions) AS x WHERE n = 1"""

EVENT_CODES = """
SELECT event_type, row_number() OVER (ORDER BY event_type) AS code
FROM (SELECT DISTINCT event_type FROM interventions) AS x"""

REGIMES = """
SELECT a.entity_id, a.date, 1.0 AS change_point, a.demand_index / m.mean_demand AS shift_strength,
  CASE WHEN a.demand_index >= 3 * m.mean_demand THEN 'spike' END AS regime_type
FROM activity AS a JOIN (
  SELECT entity_id, avg(demand_index) AS mean_demand FROM activity GROUP BY entity_id) AS m
  ON a.entity_id = m.entity_id
WHERE a.demand_index >= 2 * m.mean_demand"""

FORECASTS = """
SELECT entity_id, date AS target_date, 'naive_lag1' AS model_version,
  lag(demand_index) OVER w AS pred_demand, lag(price_index) OVER w AS pred_price
FROM activity WINDOW w AS (PARTITION BY entity_id ORDER BY date)
UNION ALL
SELECT entity_id, date, 'mean_7',
  avg(demand_index) OVER (PARTITION BY entity_id ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING),
  lag(price_index) OVER (PARTITION BY entity_id ORDER BY date)
FROM activity"""

ERRORS = """
SELECT a.date, a.entity_id, f.pred_demand, a.demand_index AS actual_demand,
  a.demand_index - f.pred_demand AS demand_error, abs(a.demand_index - f.pred_demand) AS abs_demand_error,
  f.pred_price, a.price_index AS actual_price, a.price_index - f.pred_price AS price_error,
  abs(a.price_index - f.pred_price) AS abs_price_error, f.model_version
FROM activity AS a JOIN forecasts AS f ON a.date = f.target_date AND a.entity_id = f.entity_id
WHERE f.pred_demand IS NOT NULL AND f.pred_price IS NOT NULL"""

NEWEST_ERRORS = """
SELECT * FROM errors ORDER BY date DESC, entity_id DESC, model_version DESC LIMIT 200"""


def base_sql(panel: str) -> str:
    """A panel with every feature input, defaults where the panel has no such column."""
    own = {
        "retail": {"discount_pct": "discount_pct"}, "activity": {"new_reviews": "new_reviews"}, "corrected": {"new_reviews": "new_reviews"},
        "fed": {},  # a feed brings no other signals
    }[panel]
    shown = {
        "sentiment_mean": "sentiment_index", "search_interest": "search_index", "price_new": "price_index",
        "ad_index": "ad_index", "search_index": "search_index", "sentiment_index": "sentiment_index", **own,
    }
    measures = ", ".join(
        f"CAST({shown.get(n, d)} AS DOUBLE) AS {n}" for n, d in S.PANEL_MEASURE_DEFAULTS.items()
    )
    return f"SELECT entity_id, date, demand_index, {measures} FROM {panel}"


SIX = ["new_reviews", "search_interest", "sentiment_mean", "price_new", "avg_rating", "buzz_score"]


def row_features() -> dict[str, str]:
    """SQL of every row-frame, calendar and interaction feature over a base table."""
    week = "OVER (PARTITION BY entity_id ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)"
    past = "OVER (PARTITION BY entity_id ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)"
    past3 = "OVER (PARTITION BY entity_id ORDER BY date ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)"
    order = "OVER (PARTITION BY entity_id ORDER BY date)"

    def lag(c: str, k: int) -> str:
        return f"lag({c}, {k}) {order}"

    d = "demand_index"
    out = {f"demand_lag_{k}": lag(d, k) for k in (1, 2, 3, 7)}
    out |= {
        "demand_3d_mean": f"avg({d}) {past3}", "demand_7d_mean": f"avg({d}) {past}",
        "demand_7d_std": f"stddev_samp({d}) {past}", "demand_volatility_7d": f"stddev_samp({d}) {past}",
        "demand_range_7d": f"CASE WHEN count({d}) {past} >= 2 THEN max({d}) {past} - min({d}) {past} END",
        "demand_change_1": f"{lag(d, 1)} - {lag(d, 2)}", "demand_change_3": f"{lag(d, 1)} - {lag(d, 3)}",
        "demand_momentum_7": f"{lag(d, 1)} - {lag(d, 7)}",
        "trend_strength_7d": f"{lag(d, 1)} - avg({d}) {past}",
        "reviews_7d_sum": f"sum(new_reviews) {week}", "search_7d_avg": f"avg(search_interest) {week}",
        "sentiment_7d_avg": f"avg(sentiment_mean) {week}", "price_7d_avg": f"avg(price_new) {week}",
        "new_reviews_7d_sum": f"sum(new_reviews) {week}",
        "price_new_7d_std": f"stddev_samp(price_new) {week}",
    }
    for c in SIX:
        out |= {
            f"{c}_7d_mean": f"avg({c}) {week}",
            f"{c}_lag_1": lag(c, 1), f"{c}_lag_7": lag(c, 7),
            f"{c}_change": f"{c} - {lag(c, 1)}", f"{c}_momentum": f"{c} - {lag(c, 3)}",
        }
    out |= {
        "price_x_search": "price_new * search_interest", "search_x_sentiment": "search_interest * sentiment_mean",
        "ad_x_search": "ad_index * search_interest",
        "discount_x_demand_lag_1": f"discount_pct * coalesce({lag(d, 1)}, 0.0)",
        "buzz_x_search": "buzz_score * search_interest", "rating_x_reviews": "avg_rating * new_reviews",
        "day_of_week_num": "isodow(date) - 1", "month_num": "month(date)",
        "is_weekend": "CASE WHEN isodow(date) >= 6 THEN 1.0 ELSE 0.0 END",
        "day_of_week_sin": "sin(2 * pi() * (isodow(date) - 1) / 7.0)",
        "day_of_week_cos": "cos(2 * pi() * (isodow(date) - 1) / 7.0)",
        "month_sin": "sin(2 * pi() * month(date) / 12.0)", "month_cos": "cos(2 * pi() * month(date) / 12.0)",
        "health_index": "CASE WHEN health_index IS NULL OR health_index = 0 THEN 0.30 * sentiment_index"
        " + 0.25 * search_index + 0.20 * ad_index + 0.15 * avg_rating + 0.10 * (1.0 - discount_pct)"
        " ELSE health_index END",
    }
    return out


def proximity_sql(base: str) -> str:
    """Brute force: every event of the entity against every panel row."""
    return f"""
SELECT b.entity_id, b.date,
  CASE WHEN count(*) FILTER (e.gap = 0) > 0 THEN 1.0 ELSE 0.0 END AS event_flag_today,
  CASE WHEN count(*) FILTER (e.gap BETWEEN -3 AND 0) > 0 THEN 1.0 ELSE 0.0 END AS event_flag_recent_3d,
  CASE WHEN count(*) FILTER (e.gap BETWEEN 0 AND 3) > 0 THEN 1.0 ELSE 0.0 END AS event_flag_next_3d,
  coalesce(-max(e.gap) FILTER (e.gap <= 0), 999) AS days_since_last_event,
  coalesce(min(e.gap) FILTER (e.gap >= 0), 999) AS days_to_next_event,
  coalesce(max(e.score) FILTER (e.gap BETWEEN -3 AND 3), 0.0) AS event_intensity_score,
  coalesce(max(e.code) FILTER (e.gap BETWEEN -3 AND 3), 0) AS event_type_encoded
FROM {base} AS b LEFT JOIN (
  SELECT p.entity_id, p.date, t.date - p.date AS gap, t.event_intensity_score AS score, c.code
  FROM {base} AS p JOIN events_by_type AS t ON t.entity_id = p.entity_id
  JOIN event_codes AS c ON c.event_type = t.event_type) AS e
  ON e.entity_id = b.entity_id AND e.date = b.date
GROUP BY b.entity_id, b.date"""


def regime_sql(base: str) -> str:
    return f"""
SELECT entity_id, date, flag AS recent_change_point_flag, strength AS regime_shift_strength,
  coalesce(max(flag) OVER (PARTITION BY entity_id ORDER BY date
    ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING), 0.0) AS regime_flag_recent
FROM (SELECT b.entity_id, b.date, coalesce(r.change_point, 0.0) AS flag,
        coalesce(r.shift_strength, 0.0) AS strength
      FROM {base} AS b LEFT JOIN regimes AS r ON r.entity_id = b.entity_id AND r.date = b.date) AS x"""


def feature_sql(base: str, proximity: str, regime: str, events: bool = True) -> str:
    """Every contract feature of a base table."""
    computed = row_features()
    linked = [
        "event_flag_today", "event_flag_recent_3d", "event_flag_next_3d", "days_since_last_event",
        "days_to_next_event", "event_intensity_score", "event_type_encoded", "recent_change_point_flag",
        "regime_shift_strength", "regime_flag_recent",
    ]
    rows = ", ".join(f"{e} AS f_{n}" for n, e in computed.items())
    shown = ", ".join(
        f"CAST({'f_' + n if n in computed else n} AS DOUBLE) AS {n}" for n in S.FEATURE_CONTRACT
    )
    return f"""
SELECT w.entity_id, w.date, w.demand_index, {shown}
FROM (SELECT *, {rows} FROM {base}) AS w
JOIN {proximity} AS p ON p.entity_id = w.entity_id AND p.date = w.date
JOIN {regime} AS r ON r.entity_id = w.entity_id AND r.date = w.date"""


def finalized_sql(source: str, extra: str = "") -> str:
    shown = ", ".join(f"{grid_sql(f'coalesce({n}, 0.0)')} AS {n}" for n in S.FEATURE_CONTRACT)
    return f"SELECT entity_id, date{extra}, {shown} FROM {source}"


LIVE_START = "(SELECT max(date) - 9 FROM activity)"

PROFILE = f"""
SELECT feature, min(value) AS min, {grid_sql('quantile_cont(value, 0.1)')} AS q10,
  {grid_sql('quantile_cont(value, 0.5)')} AS q50, {grid_sql('quantile_cont(value, 0.9)')} AS q90,
  max(value) AS max, {grid_sql('avg(value)')} AS mean, {grid_sql('stddev_samp(value)')} AS std
FROM (UNPIVOT (SELECT COLUMNS(* EXCLUDE (entity_id, date)) FROM gridded WHERE date < {LIVE_START})
  ON COLUMNS(*) INTO NAME feature VALUE value) AS u GROUP BY feature"""


def psi_sql(edges: str, shares: str) -> str:
    return f"""
WITH edged AS (SELECT feature, {edges} AS e FROM profile),
live AS (UNPIVOT (SELECT COLUMNS(* EXCLUDE (entity_id, date)) FROM gridded WHERE date >= {LIVE_START})
  ON COLUMNS(*) INTO NAME feature VALUE value),
placed AS (SELECT l.feature, CASE WHEN value < e[1] OR value > e[len(e)] THEN NULL
    WHEN value = e[len(e)] THEN len(e) - 1
    ELSE len(list_filter(e, lambda x: x <= value)) END AS bin
  FROM live AS l JOIN edged AS d ON l.feature = d.feature),
hits AS (SELECT feature, bin, count(*) AS n FROM placed WHERE bin IS NOT NULL GROUP BY 1, 2),
bins AS (SELECT feature, len(e) AS size, unnest(range(1, greatest(len(e), 2))) AS bin FROM edged),
joined AS (SELECT b.feature, b.size, b.bin, coalesce(h.n, 0) AS n,
    greatest(sum(coalesce(h.n, 0)) OVER (PARTITION BY b.feature), 1) AS total
  FROM bins AS b LEFT JOIN hits AS h ON h.feature = b.feature AND h.bin = b.bin),
shares AS (SELECT feature, size, greatest(n / total, 1e-6) AS a, {shares}[bin] AS x FROM joined)
SELECT feature, CASE WHEN max(size) < 3 THEN 0.0 ELSE sum((a - x) * ln(a / x)) END AS psi
FROM shares GROUP BY feature"""


PSI = psi_sql("list_sort(list_distinct([min, q10, q50, q90, max]))", "[0.1, 0.4, 0.4, 0.1]")
PSI_MEAN_STD = psi_sql(
    "list_sort(list_distinct([min, mean - greatest(std, 1e-6), mean, mean + greatest(std, 1e-6), max]))",
    "[0.16, 0.34, 0.34, 0.16]",
)

CATEGORY_ERRORS = """
SELECT a.category, e.* FROM errors AS e JOIN activity AS a ON a.entity_id = e.entity_id AND a.date = e.date"""

# One training run per category, week and model, in that order.
CANDIDATES = """
SELECT category, version, mae, row_number() OVER (PARTITION BY category ORDER BY version) AS run_no FROM (
  SELECT category, strftime(date_trunc('week', date), '%Y-%m-%d') || ' ' || model_version AS version,
    avg(abs_demand_error) AS mae FROM category_errors GROUP BY 1, 2) AS x"""

REPLAY = """
SELECT category, run_no, version, mae, 'accepted' AS status, version AS active_version, mae AS active_mae,
  version AS last_stable_version FROM candidates WHERE run_no = 1
UNION ALL
SELECT c.category, c.run_no, c.version, c.mae,
  CASE WHEN c.mae <= r.active_mae * 0.98 THEN 'accepted' ELSE 'rejected' END,
  CASE WHEN c.mae <= r.active_mae * 0.98 THEN c.version ELSE r.active_version END,
  CASE WHEN c.mae <= r.active_mae * 0.98 THEN c.mae ELSE r.active_mae END,
  CASE WHEN c.mae <= r.active_mae * 0.98 THEN r.active_version ELSE r.last_stable_version END
FROM replay AS r JOIN candidates AS c ON c.category = r.category AND c.run_no = r.run_no + 1"""

# The panel after a batch that brings the last date again.
CORRECTED = """
SELECT * REPLACE (CASE WHEN latest THEN demand_index + 1 ELSE demand_index END AS demand_index,
    CASE WHEN latest THEN price_index * 1.5 + 1 ELSE price_index END AS price_index,
    CASE WHEN latest THEN search_index + 2 ELSE search_index END AS search_index)
FROM (SELECT *, date = (SELECT max(date) FROM activity) AS latest FROM activity) AS x"""

TABLES: dict[str, str] = {
    "retail": RETAIL,
    "activity": ACTIVITY,
    "interventions": INTERVENTIONS,
    "events_by_type": EVENTS_BY_TYPE,
    "event_codes": EVENT_CODES,
    "regimes": REGIMES,
    "forecasts": FORECASTS,
    "errors": ERRORS,
    "newest_errors": NEWEST_ERRORS,
    "base": base_sql("activity"),
    "retail_base": base_sql("retail"),
    "proximity": proximity_sql("base"),
    "regime_marks": regime_sql("base"),
    "feature_rows": feature_sql("base", "proximity", "regime_marks"),
    "gridded": finalized_sql("feature_rows"),
    "corrected": CORRECTED,
    "live_base": base_sql("corrected"),
    "live_proximity": proximity_sql("live_base"),
    "live_regimes": regime_sql("live_base"),
    "live_rows": feature_sql("live_base", "live_proximity", "live_regimes"),
    "profile": PROFILE,
    "psi": PSI,
    "psi_mean_std": PSI_MEAN_STD,
    "category_errors": CATEGORY_ERRORS,
    "candidates": CANDIDATES,
    "replay": REPLAY,
}


def steady_rounds(sql: str) -> str:
    """``round(x, n)`` with the nudge that the reports round with."""
    out, rest = "", sql
    while (at := rest.find("round(")) >= 0:
        depth, comma = 0, None
        for k in range(at + 6, len(rest)):
            if rest[k] == "(":
                depth += 1
            elif rest[k] == ")":
                if depth == 0:
                    break
                depth -= 1
            elif rest[k] == "," and depth == 0:
                comma = k
        inner, digits = rest[at + 6:comma], rest[comma:k]
        out += rest[:at] + f"round(({steady_rounds(inner)}) + 1e-9{digits})"
        rest = rest[k + 1:]
    return out + rest


def with_tables(body: str, extra: dict[str, str] | None = None) -> str:
    """Prefix ``body`` with the shared tables it needs, in dependency order."""
    known = {**TABLES, **(extra or {})}
    ordered: list[str] = []

    def need(text: str, seen: tuple[str, ...] = ()) -> None:
        for name in known:
            if name in ordered or name in seen:
                continue
            if re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text):
                need(known[name], (*seen, name))
                ordered.append(name)

    need(body)
    if not ordered:
        return body
    ctes = ",\n".join(f"{n} AS ({known[n].strip()})" for n in ordered)
    return f"WITH RECURSIVE {ctes}\n{body}"
