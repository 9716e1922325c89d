"""Registered queries: joins, errors, drift, series and the dashboard."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidepanel.functions.columns import scale_100
from tidepanel.operators import attribution as A, dashboard as D, dedup, drift, series, features as X
from tidepanel.operators.normalize import finalize_features
from tidepanel.plans.model import split_by_date
from tidepanel.plans.registry import Inputs, on_grid, query
from tidepanel.sources import schemas as S, state

_FVA_SPEC = (
    "date d, entity_id s, pred_demand f, actual_demand f, demand_error f, abs_demand_error f, pred_price f, "
    "actual_price f, price_error f, abs_price_error f, model_version s"
)


# ---- D. joins ------------------------------------------------------------------------------------------


@query("d1_forecast_vs_actual", _FVA_SPEC, "SELECT * FROM errors")
def d1_forecast_vs_actual(i: Inputs) -> DataFrame:
    return drift.align_forecasts(i.activity, i.forecasts)


_LABELS = """SELECT entity_id, brand, product_name, category FROM (SELECT *, row_number() OVER (
  PARTITION BY entity_id ORDER BY date DESC) AS n FROM {panel}) AS x WHERE n = 1"""


@query(
    "d2_latest_dim_join", "date d, entity_id s, model_version s, abs_demand_error f, brand s, category s",
    "SELECT e.date, e.entity_id, e.model_version, e.abs_demand_error, l.brand, l.category FROM errors AS e LEFT JOIN ("
    + _LABELS.format(panel="activity").replace("product_name, ", "") + ") AS l ON l.entity_id = e.entity_id",
)
def d2_latest_dim_join(i: Inputs) -> DataFrame:
    return D.with_category(i.errors, i.activity)


def _reason_sql(search: str, sentiment: str, ads: str, event: str, price: str) -> str:
    parts = f"""concat_ws(' | ',
      CASE WHEN {search} > 45 THEN 'High search interest (' || printf('%.1f', {search}) || ')' END,
      CASE WHEN {sentiment} > 0.6 THEN 'Positive sentiment trend' WHEN {sentiment} < 0.5 THEN
        'Weak sentiment affecting demand' END,
      CASE WHEN {ads} > 5 THEN 'Strong ad campaign influence' END,
      CASE WHEN {event} <> 'organic' THEN 'Event impact: ' || {event} END,
      CASE WHEN {price} < 80 THEN 'Competitive pricing boosting demand' END)"""
    return f"CASE WHEN {parts} = '' THEN 'Stable organic demand' ELSE {parts} END"


@query(
    "d4_context_join", "entity_id s, target_date d, pred_demand f, pred_price f, search_index f, brand s, category s, event_type s",
    """SELECT f.entity_id, f.date + 1 AS target_date, coalesce(f.mean_7, 0.0) AS pred_demand,
      coalesce(c.price_index, 0.0) AS pred_price, c.search_index, c.brand, c.category, c.event_type
    FROM (SELECT entity_id, date, avg(demand_index) OVER (PARTITION BY entity_id ORDER BY date
        ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS mean_7 FROM retail) AS f
    LEFT JOIN (SELECT * FROM retail WHERE date > (SELECT max(date) - 30 FROM retail)
      QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY date) = 1) AS c ON c.entity_id = f.entity_id""",
)
def d4_context_join(i: Inputs) -> DataFrame:
    """Every row's mean forecast beside the first row of its entity in the last 30 days."""
    made = X.add_demand_rolling(i.retail).select(
        "entity_id", F.date_add("date", 1).alias("target_date"), F.col("demand_7d_mean").alias("pred_demand")
    )
    recent = i.retail.filter(F.col("date") > F.date_sub(series.latest_date(i.retail), 30))
    return A.attach_context(made, recent)


_BEST_EVENT = """SELECT p.entity_id, p.date AS target_date, v.event_id, v.date AS event_date, v.event_type,
  v.event_title, v.event_strength FROM {rows} AS p LEFT JOIN (
    SELECT q.entity_id AS pid, q.date AS pdate, e.*, row_number() OVER (PARTITION BY q.entity_id, q.date
      ORDER BY CASE WHEN e.signal_target = 'demand_index' THEN 1 ELSE 0 END DESC, e.event_strength DESC,
      e.date DESC, e.event_id DESC) AS n
    FROM {rows} AS q JOIN interventions AS e ON (e.entity_id = q.entity_id OR e.entity_id = 'ALL')
      AND e.date BETWEEN q.date - 5 AND q.date) AS v
  ON v.pid = p.entity_id AND v.pdate = p.date AND v.n = 1"""
_EVENT_SPEC = "entity_id s, target_date d, event_id s, event_date d, event_type s, event_title s, event_strength f"


@query("d5_event_attribution", _EVENT_SPEC, _BEST_EVENT.format(rows="activity"))
def d5_event_attribution(i: Inputs) -> DataFrame:
    asked = i.activity.select("entity_id", F.col("date").alias("target_date"))
    return A.attribute_events(asked, i.events, "demand_index").select("entity_id", "target_date", "likely_event.*")


@query(
    "d6_explain", "model_version s, pred_demand f, pred_price f, " + _EVENT_SPEC,
    "SELECT f.model_version, f.pred_demand, f.pred_price, b.* FROM forecasts AS f JOIN ("
    + _BEST_EVENT.format(rows="activity") + ") AS b ON b.entity_id = f.entity_id AND b.target_date = f.target_date "
    "WHERE f.target_date = (SELECT max(target_date) FROM forecasts)",
)
def d6_explain(i: Inputs) -> DataFrame:
    rows = A.explain_forecasts(i.forecasts, i.events)
    return rows.select("model_version", "pred_demand", "pred_price", "entity_id", "target_date", "likely_event.*")


@query(
    "d7_semi_dates", "entity_id s, date d, demand_index f",
    "SELECT entity_id, date, demand_index FROM activity WHERE date IN (SELECT date FROM regimes WHERE shift_strength >= 2.5)",
)
def d7_semi_dates(i: Inputs) -> DataFrame:
    wanted = i.regimes.filter("shift_strength >= 2.5").select("date").distinct()
    return i.activity.join(wanted, "date", "left_semi")


@query(
    "d8_union_keep_last", "entity_id s, date d, demand_index f, price_index f, category s",
    "SELECT entity_id, date, CASE WHEN date >= DATE '1999-01-01' THEN demand_index * 2 ELSE demand_index END AS "
    "demand_index, price_index, CASE WHEN date >= DATE '1999-01-01' THEN NULL ELSE category END AS category FROM retail",
)
def d8_union_keep_last(i: Inputs) -> DataFrame:
    """History under newer actuals that carry no labels."""
    newer = i.retail.filter(F.col("date") >= F.lit("1999-01-01").cast("date")).select(
        "entity_id", "date", (F.col("demand_index") * 2).alias("demand_index"), "price_index"
    )
    return dedup.union_keep_last([i.retail, newer])


# ---- E. errors and drift ----------------------------------------------------------------------------------


@query(
    "e1_daily_summary", "date d, " + ", ".join(f"avg_{m} f" for m in S.FEED_MEASURES) + ", product_count i, event_count i",
    "SELECT date, " + ", ".join(f"avg({m}) AS avg_{m}" for m in S.FEED_MEASURES)
    + ", count(DISTINCT entity_id) AS product_count, count(*) FILTER (event_type <> 'organic') AS event_count "
    "FROM retail GROUP BY date",
)
def e1_daily_summary(i: Inputs) -> DataFrame:
    return D.daily_summary(i.retail)


_METRICS = """avg(abs(actual_demand - pred_demand)) AS mae,
  avg(abs(actual_demand - pred_demand) / greatest(abs(actual_demand), 1e-6)) AS mape,
  sqrt(avg((actual_demand - pred_demand) * (actual_demand - pred_demand))) AS rmse"""


@query(
    "e2_error_metrics", "mae f, mape f, rmse f, n_rows i",
    f"SELECT {_METRICS}, count(*) AS n_rows FROM newest_errors",
)
def e2_error_metrics(i: Inputs) -> DataFrame:
    return drift.error_metrics(i.errors)


@query(
    "e3_naive_baseline", "mae f, rmse f, r2 f, n_rows i",
    """WITH days AS (SELECT date, row_number() OVER (ORDER BY date) AS n, count(*) OVER () AS total
        FROM (SELECT DISTINCT date FROM retail) AS d),
      scored AS (SELECT r.date, r.demand_index AS y, lag(r.demand_index) OVER (PARTITION BY r.entity_id
        ORDER BY r.date) AS p FROM retail AS r),
      valid AS (SELECT s.y, s.p FROM scored AS s JOIN days AS d ON d.date = s.date
        WHERE d.n > floor(d.total * 0.8) AND s.p IS NOT NULL)
    SELECT avg(abs(y - p)) AS mae, sqrt(avg((y - p) * (y - p))) AS rmse,
      1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)) AS r2, count(*) AS n_rows FROM valid""",
)
def e3_naive_baseline(i: Inputs) -> DataFrame:
    """Yesterday as forecast over the validation dates of the retail panel."""
    lagged = X.add_demand_lags(i.retail)
    valid = split_by_date(lagged).filter("NOT is_train")
    return drift.regression_scores(
        valid.select(F.col("demand_index").alias("actual"), F.col("demand_lag_1").alias("pred"))
    )


_FEATURES = S.FEATURE_CONTRACT


def _gridded(i: Inputs) -> DataFrame:
    """All model inputs, on the grid of the comparison so that bin edges meet the same values.

    The frame is read several times below, so it is stored once.
    """
    ready = finalize_features(i.feature_rows, _FEATURES).select("entity_id", "date", *_FEATURES)
    return i.stored(on_grid(ready, _FEATURES), "features")


def _profile(i: Inputs, frame: DataFrame) -> DataFrame:
    profile = drift.baseline_profile(frame.filter(F.col("date") < i.first_live_date), _FEATURES)
    return on_grid(profile, ["q10", "q50", "q90", "mean", "std"])


def _psi(i: Inputs, method: str) -> DataFrame:
    frame = _gridded(i)
    profile = i.stored(_profile(i, frame), "profile")
    return drift.feature_psi(frame.filter(F.col("date") >= i.first_live_date), profile, _FEATURES, method)


@query(
    "e4_baseline_profile", "feature s, min f, q10 f, q50 f, q90 f, max f, mean f, std f", "SELECT * FROM profile",
)
def e4_baseline_profile(i: Inputs) -> DataFrame:
    return _profile(i, _gridded(i))


@query("e6_psi_quantile", "feature s, psi f", "SELECT * FROM psi")
def e6_psi_quantile(i: Inputs) -> DataFrame:
    return _psi(i, "quantile")


@query("e7_psi_meanstd", "feature s, psi f", "SELECT * FROM psi_mean_std")
def e7_psi_meanstd(i: Inputs) -> DataFrame:
    return _psi(i, "mean_std")


@query(
    "e8_drift_status", "mae f, mape f, rmse f, max_feature_psi f, drift_status s",
    f"""SELECT m.*, p.worst AS max_feature_psi, CASE WHEN p.worst > 0.3 THEN 'severe_feature_drift'
      WHEN p.worst > 0.2 THEN 'feature_drift' WHEN m.mae > 1.5 * 1.25 THEN 'performance_drift' ELSE 'stable' END
      AS drift_status
    FROM (SELECT {_METRICS} FROM newest_errors) AS m, (SELECT max(psi) AS worst FROM psi) AS p""",
)
def e8_drift_status(i: Inputs) -> DataFrame:
    return drift.drift_snapshot(i.errors, _psi(i, "quantile"), 1.5)


# ---- E. series and dashboard ----------------------------------------------------------------------------------


@query(
    "e9_weekly_series", "period d, value f",
    "SELECT CAST(date_trunc('week', date) AS DATE) AS period, round(avg(demand_index), 2) AS value FROM retail "
    "GROUP BY 1 ORDER BY 1 DESC LIMIT 12",
)
def e9_weekly_series(i: Inputs) -> DataFrame:
    return series.weekly_series(i.retail, "demand_index", 12)


_TOP3 = """SELECT category FROM {panel} WHERE date = (SELECT max(date) FROM {panel}) GROUP BY category
  ORDER BY avg({value}) DESC, category LIMIT 3"""
_RETAIL_TOP = _TOP3.format(panel="retail", value="demand_index")


def _weekly_by_category(panel: str, value: str, top: str) -> str:
    return f"""SELECT category AS grp, period, value FROM (
      SELECT category, CAST(date_trunc('week', date) AS DATE) AS period, round(avg({value}), 2) AS value,
        row_number() OVER (PARTITION BY category ORDER BY CAST(date_trunc('week', date) AS DATE) DESC) AS n
      FROM {panel} WHERE category IN ({top}) GROUP BY 1, 2) AS x WHERE n <= 12"""


@query(
    "e10_weekly_by_category", "grp s, period d, value f",
    _weekly_by_category("retail", "demand_index", _RETAIL_TOP),
)
def e10_weekly_by_category(i: Inputs) -> DataFrame:
    return series.weekly_series_by_category(i.retail_table, "demand_index", 12)


_LABELLED = "SELECT e.*, a.category FROM errors AS e JOIN activity AS a ON a.entity_id = e.entity_id AND a.date = e.date"


@query(
    "e10_weekly_predicted", "grp s, period d, value f",
    f"WITH labelled AS ({_LABELLED}) "
    + _weekly_by_category("labelled", "pred_demand", _TOP3.format(panel="labelled", value="actual_demand")),
)
def e10_weekly_predicted(i: Inputs) -> DataFrame:
    labelled = D.with_category(i.errors, i.activity)
    return series.weekly_series_by_category(labelled, "pred_demand", 12, rank_by="actual_demand")


@query(
    "e11_daily_series", "period d, value f",
    "SELECT date AS period, round(avg(price_index), 2) AS value FROM retail GROUP BY 1 ORDER BY 1 DESC LIMIT 30",
)
def e11_daily_series(i: Inputs) -> DataFrame:
    return series.daily_series(i.retail, "price_index", 30)


@query(
    "e12_top_categories", "category s, mean_value f",
    "SELECT category, avg(demand_index) AS mean_value FROM retail WHERE date = (SELECT max(date) FROM retail) "
    "GROUP BY category ORDER BY 2 DESC, 1 LIMIT 3",
)
def e12_top_categories(i: Inputs) -> DataFrame:
    return series.top_categories(i.retail, 3)


_CHANGE = "CASE WHEN {p} IS NULL OR abs({p}) < 1e-9 THEN 0.0 ELSE round(({c} - {p}) / {p} * 100.0, 1) END"


@query(
    "e13_kpis",
    "demand f, demand_chg f, price f, price_chg f, sentiment f, sent_chg f, active_brands i, active_entities i, "
    "total_rows i, total_alerts i",
    f"""WITH days AS (SELECT max(date) AS latest, (SELECT max(date) FROM retail WHERE date < (SELECT max(date) FROM
        retail)) AS previous FROM retail),
      m AS (SELECT round(avg(CASE WHEN date = latest THEN demand_index END), 1) AS d,
        round(avg(CASE WHEN date = latest THEN price_index END), 2) AS p,
        round(avg(CASE WHEN date = latest THEN sentiment_index END) * 100.0, 1) AS s,
        avg(CASE WHEN date = previous THEN demand_index END) AS pd,
        avg(CASE WHEN date = previous THEN price_index END) AS pp,
        avg(CASE WHEN date = previous THEN sentiment_index END) * 100.0 AS ps
        FROM retail JOIN days ON date IN (latest, previous))
    SELECT d AS demand, {_CHANGE.format(c='d', p='pd')} AS demand_chg, p AS price,
      {_CHANGE.format(c='p', p='pp')} AS price_chg, s AS sentiment, round(s - coalesce(ps, s), 1) AS sent_chg,
      (SELECT count(DISTINCT brand) FROM retail) AS active_brands,
      (SELECT count(DISTINCT entity_id) FROM retail) AS active_entities,
      (SELECT count(*) FROM retail) AS total_rows,
      (SELECT count(*) FROM retail WHERE event_type = 'promotion') AS total_alerts FROM m""",
)
def e13_kpis(i: Inputs) -> DataFrame:
    return D.kpis(i.retail_table, i.retail_table.filter("event_type = 'promotion'"))


@query(
    "e14_kpis_by_category", "category s, demand f, price f, sentiment f, count i",
    "SELECT category, round(avg(demand_index), 1) AS demand, round(avg(price_index), 1) AS price, "
    "round(avg(sentiment_index) * 100.0, 1) AS sentiment, count(DISTINCT entity_id) AS count FROM retail "
    "WHERE date = (SELECT max(date) FROM retail) GROUP BY category",
)
def e14_kpis_by_category(i: Inputs) -> DataFrame:
    return D.kpis_by_category(i.retail)


@query(
    "e15_scatter", "grp s, pos i, label s, x f, y f",
    f"""WITH latest AS (SELECT * FROM retail WHERE date = (SELECT max(date) FROM retail)),
      means AS (SELECT 'all' AS grp, brand, avg(price_index) AS x, avg(demand_index) AS y FROM latest GROUP BY brand
        UNION ALL SELECT category, brand, avg(price_index), avg(demand_index) FROM latest
        WHERE category IN ({_RETAIL_TOP}) GROUP BY category, brand)
    SELECT grp, pos, brand AS label, round(x, 1) AS x, round(y, 1) AS y FROM (SELECT *, row_number() OVER (
      PARTITION BY grp ORDER BY y DESC, brand) AS pos FROM means) AS q WHERE pos <= 14""",
)
def e15_scatter(i: Inputs) -> DataFrame:
    return D.scatter(i.retail_table)


def _scale(c: str, over: str) -> str:
    lo, hi = f"min({c}) OVER {over}", f"max({c}) OVER {over}"
    return f"CASE WHEN abs({hi} - ({lo})) < 1e-9 THEN 50.0 ELSE ({c} - ({lo})) / ({hi} - ({lo})) * 100.0 END"


@query(
    "e16_norm100", "entity_id s, date d, demand_n f",
    f"SELECT entity_id, date, {_scale('demand_index', '()')} AS demand_n FROM activity",
)
def e16_norm100(i: Inputs) -> DataFrame:
    span = i.activity.agg(
        F.struct(F.min("demand_index").alias("lo"), F.max("demand_index").alias("hi")).alias("s")
    ).scalar()
    return i.activity.withColumn("demand_n", scale_100(F.col("demand_index"), span["lo"], span["hi"]))


def _radar_sql(rows: str) -> str:
    over = "(PARTITION BY grp)"
    scaled = ", ".join(f"{_scale(c, over)} AS {c}_n" for c in ("demand", "sentiment", "search", "ad"))
    return f"""SELECT grp, pos, brand, round(demand_n, 1) AS demand_n, round(sentiment_n, 1) AS sentiment_n,
      round(search_n, 1) AS search_n, round(ad_n, 1) AS ad_n, round(price_n, 1) AS price_n FROM (
        SELECT *, row_number() OVER (PARTITION BY grp ORDER BY 0.35 * demand_n + 0.25 * sentiment_n + 0.2 * search_n
          + 0.1 * ad_n + 0.1 * price_n DESC, brand) AS pos FROM (
          SELECT grp, brand, {scaled}, 100.0 - ({_scale('price', over)}) AS price_n FROM (
            SELECT grp, brand, avg(demand_index) AS demand, avg(sentiment_index) AS sentiment,
              avg(search_index) AS search, avg(ad_index) AS ad, avg(price_index) AS price
            FROM ({rows}) AS r GROUP BY grp, brand) AS m) AS s) AS t WHERE pos <= 3"""


_RADAR_SPEC = "grp s, pos i, brand s, demand_n f, sentiment_n f, search_n f, ad_n f, price_n f"
_OWN_LATEST = f"""SELECT r.*, r.category AS grp FROM retail AS r JOIN (SELECT category, max(date) AS date FROM retail
  WHERE category IN ({_RETAIL_TOP}) GROUP BY category) AS l ON l.category = r.category AND l.date = r.date"""


@query(
    "e17_radar", _RADAR_SPEC,
    _radar_sql("SELECT *, 'all' AS grp FROM retail WHERE date = (SELECT max(date) FROM retail)"),
)
def e17_radar(i: Inputs) -> DataFrame:
    return D.radar(i.retail_table)


@query("e17_radar_by_category", _RADAR_SPEC, _radar_sql(_OWN_LATEST))
def e17_radar_by_category(i: Inputs) -> DataFrame:
    return D.radar_by_category(i.retail_table)


@query(
    "e18_trends", "grp s, pos i, brand s, period d, value f",
    f"""WITH lead AS (SELECT * FROM (SELECT grp, brand, row_number() OVER (PARTITION BY grp ORDER BY
        avg(demand_index) DESC, brand) AS pos FROM ({_OWN_LATEST}) AS o GROUP BY grp, brand) AS x WHERE pos <= 3),
      daily AS (SELECT l.grp, l.pos, l.brand, r.date AS period, avg(r.demand_index) AS v FROM lead AS l
        JOIN retail AS r ON r.category = l.grp AND r.brand = l.brand GROUP BY 1, 2, 3, 4)
    SELECT grp, pos, brand, period, round(v, 2) AS value FROM (SELECT *, row_number() OVER (PARTITION BY grp, brand
      ORDER BY period DESC) AS n FROM daily) AS y WHERE n <= 13""",
)
def e18_trends(i: Inputs) -> DataFrame:
    return D.trends(i.retail_table)


def _competitor_score() -> str:
    scaled = {c: _scale(c, "()") for c in ("demand", "sent", "search", "ad", "price")}
    return (
        f"round(0.35 * ({scaled['demand']}) + 0.25 * ({scaled['sent']}) + 0.20 * ({scaled['search']}) "
        f"+ 0.10 * ({scaled['ad']}) + 0.10 * (100.0 - ({scaled['price']})), 1)"
    )


@query(
    "e19_competitors",
    "entity_id s, name s, product s, cat s, score f, price f, sent f, demand f, pos i, past_price f, past_sent f",
    f"""WITH means AS (SELECT entity_id, brand, product_name, category, avg(demand_index) AS demand,
        avg(price_index) AS price, avg(sentiment_index) AS sent, avg(search_index) AS search, avg(ad_index) AS ad
        FROM retail WHERE date = (SELECT max(date) FROM retail) GROUP BY 1, 2, 3, 4),
      top AS (SELECT *, {_competitor_score()} AS score FROM means ORDER BY score DESC, entity_id LIMIT 12),
      past AS (SELECT entity_id, p, s, n, max(n) OVER (PARTITION BY entity_id) - n AS pos FROM (
        SELECT r.entity_id, avg(r.price_index) AS p, avg(r.sentiment_index) AS s,
          row_number() OVER (PARTITION BY r.entity_id ORDER BY r.date DESC) AS n
        FROM retail AS r JOIN top AS t ON t.entity_id = r.entity_id GROUP BY r.entity_id, r.date) AS q WHERE n <= 12)
    SELECT t.entity_id, t.brand AS name, t.product_name AS product,
      upper(t.category[1]) || lower(t.category[2:]) AS cat, t.score, round(t.price, 1) AS price,
      round(t.sent * 100.0, 1) AS sent, round(t.demand, 1) AS demand, p.pos, round(p.p, 2) AS past_price,
      round(p.s * 100.0, 1) AS past_sent FROM top AS t JOIN past AS p ON p.entity_id = t.entity_id""",
)
def e19_competitors(i: Inputs) -> DataFrame:
    rows = D.competitors(i.retail_table)
    points = F.posexplode(F.arrays_zip("price_history", "sent_history")).alias("pos", "past")
    return rows.select("*", points).select(
        "*", F.col("past.price_history").alias("past_price"), F.col("past.sent_history").alias("past_sent")
    )


@query(
    "e20_next_days", "date d, label s, actual f, predicted f",
    "SELECT date, strftime(date, '%b %-d') AS label, round(avg(actual_demand), 2) AS actual, "
    "round(avg(pred_demand), 2) AS predicted FROM errors GROUP BY date ORDER BY date DESC LIMIT 7",
)
def e20_next_days(i: Inputs) -> DataFrame:
    return D.next_days(i.errors, i.forecasts, 7)


@query(
    "e21_report",
    "top_cat s, top_cat_demand f, top_cat_sent f, best_brand s, best_brand_health f, price_30d_chg f, "
    "spotlight_sent f, total_brands i, total_entities i, total_alerts i",
    f"""WITH radar AS ({_radar_sql("SELECT *, 'all' AS grp FROM retail WHERE date = (SELECT max(date) FROM retail)")}),
      cats AS (SELECT category, avg(demand_index) AS d, avg(sentiment_index) AS s FROM retail
        WHERE date = (SELECT max(date) FROM retail) GROUP BY category ORDER BY d DESC, category LIMIT 1),
      daily AS (SELECT date, avg(price_index) AS p FROM retail WHERE date >= (SELECT max(date) - 29 FROM retail)
        GROUP BY date),
      ends AS (SELECT arg_min(p, date) AS f, arg_max(p, date) AS l FROM daily),
      spot AS (SELECT * FROM retail WHERE lower(category) = 'large')
    SELECT upper(category[1]) || lower(category[2:]) AS top_cat, round(d, 1) AS top_cat_demand,
      round(s * 100.0, 1) AS top_cat_sent, (SELECT brand FROM radar WHERE pos = 1) AS best_brand,
      (SELECT round(max(demand_n), 1) FROM radar) AS best_brand_health,
      (SELECT {_CHANGE.format(c='l', p='f')} FROM ends) AS price_30d_chg,
      (SELECT round(avg(sentiment_index) * 100.0, 1) FROM spot WHERE date = (SELECT max(date) FROM spot)) AS spotlight_sent,
      (SELECT count(DISTINCT brand) FROM retail) AS total_brands,
      (SELECT count(DISTINCT entity_id) FROM retail) AS total_entities, 0 AS total_alerts FROM cats""",
)
def e21_report(i: Inputs) -> DataFrame:
    return D.report(i.retail_table, spotlight="large")


@query(
    "e22_buzz", "period d, value f",
    f"""SELECT date AS period, round(avg(scaled), 2) AS value FROM (SELECT date, {_scale('buzz', '()')} AS scaled
      FROM (SELECT date, search_index + 8.0 * ad_index AS buzz FROM retail) AS x) AS y
      GROUP BY date ORDER BY date DESC LIMIT 56""",
)
def e22_buzz(i: Inputs) -> DataFrame:
    return D.buzz(i.retail)


@query(
    "e23_sparkline", "period d, value f",
    "SELECT date AS period, round(avg(demand_index), 2) AS value FROM retail WHERE lower(category) = 'promo' "
    "GROUP BY 1 ORDER BY 1 DESC LIMIT 24",
)
def e23_sparkline(i: Inputs) -> DataFrame:
    return D.category_sparkline(i.retail, "promo")


@query(
    "e24_filters", "field s, value s",
    """SELECT 'entity_id' AS field, entity_id AS value FROM retail GROUP BY 2
      UNION ALL SELECT 'category', category FROM retail GROUP BY 2
      UNION ALL SELECT 'event_type', event_type FROM interventions GROUP BY 2
      UNION ALL SELECT 'date_min', strftime(min(date), '%Y-%m-%d') FROM retail
      UNION ALL SELECT 'date_max', strftime(max(date), '%Y-%m-%d') FROM retail""",
)
def e24_filters(i: Inputs) -> DataFrame:
    return D.filter_values(i.retail, i.events)


@query(
    "e25_latest_events", "date s, brand s, cat s, explanation s",
    "SELECT strftime(date, '%Y-%m-%d') AS date, brand, lower(category) AS cat, "
    "coalesce(signal_story, event_description) AS explanation FROM interventions ORDER BY interventions.date DESC, seq DESC LIMIT 6",
)
def e25_latest_events(i: Inputs) -> DataFrame:
    return D.latest_events(i.events)


@query(
    "e26_latest_regimes", "date s, entity_id s, regime_type s",
    "SELECT strftime(date, '%Y-%m-%d') AS date, entity_id, coalesce(regime_type, 'neutral') AS regime_type "
    "FROM regimes ORDER BY regimes.date DESC, entity_id DESC LIMIT 12",
)
def e26_latest_regimes(i: Inputs) -> DataFrame:
    return D.latest_regimes(i.regimes)


@query("e27_dashboard_bundle", "bundle s")
def e27_dashboard_bundle(i: Inputs) -> DataFrame:
    """Every block over the activity panel, as one JSON document."""
    panel = i.stored(i.activity.withColumn("product_name", F.col("brand")), "panel")
    whole = D.bundle(
        panel, i.stored(i.errors, "errors"), i.stored(i.events, "events"), i.stored(i.regimes, "regimes"),
        forecast=i.forecasts, sparklines=("c0", "c1"), spotlight="c2",
    )
    return whole.select(F.to_json(F.struct(*whole.columns)).alias("bundle"))


# ---- F. sorts, limits, status -----------------------------------------------------------------------------------


@query(
    "f1_latest_forecast", "target_date d, entity_id s, model_version s, pred_demand f, pred_price f",
    "SELECT target_date, entity_id, model_version, pred_demand, pred_price FROM forecasts WHERE target_date = "
    "(SELECT max(target_date) FROM forecasts) ORDER BY entity_id, model_version LIMIT 500",
)
def f1_latest_forecast(i: Inputs) -> DataFrame:
    return state.latest_forecast(i.forecasts, 500)


def _daily_metrics(errors: DataFrame, by: list[str]) -> DataFrame:
    measures = drift.error_aggregates(F.col("actual_demand"), F.col("pred_demand"))
    return errors.groupBy(*by).agg(*[c.alias(n) for n, c in measures.items()], F.count("*").alias("n_rows"))


@query(
    "f2_latest_drift", "date d, model_version s, mae f, mape f, rmse f, n_rows i",
    f"SELECT date, model_version, {_METRICS}, count(*) AS n_rows FROM errors GROUP BY date, model_version "
    "ORDER BY date DESC, model_version DESC LIMIT 1",
)
def f2_latest_drift(i: Inputs) -> DataFrame:
    return state.latest_row(_daily_metrics(i.errors, ["date", "model_version"]), ["date", "model_version"])


@query(
    "f3_fva_history", _FVA_SPEC,
    "SELECT * FROM errors ORDER BY date DESC, entity_id DESC, model_version DESC LIMIT 500",
)
def f3_fva_history(i: Inputs) -> DataFrame:
    return drift.newest(i.errors, 500)


@query(
    "f5_sorted_tail", "date d, entity_id s, demand_index f, price_index f",
    "SELECT date, entity_id, demand_index, price_index FROM retail ORDER BY date DESC, entity_id DESC LIMIT 5000",
)
def f5_sorted_tail(i: Inputs) -> DataFrame:
    return state.sorted_tail(i.retail, ["date", "entity_id"], 5000)


@query(
    "f6_seq_tail", "event_id s, date d, entity_id s, event_type s",
    "SELECT event_id, date, entity_id, event_type FROM interventions ORDER BY seq DESC LIMIT 500",
)
def f6_seq_tail(i: Inputs) -> DataFrame:
    return state.newest_rows(i.events, ["_seq"], 500)


@query(
    "f7_actuals_for_date", "date d, entity_id s, demand_index f, price_index f",
    "SELECT date, entity_id, demand_index, price_index FROM activity WHERE date = (SELECT max(date) FROM activity)",
)
def f7_actuals_for_date(i: Inputs) -> DataFrame:
    return state.actuals_for_date(i.activity)
