"""Route pattern and summary queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from farelens.constants import BOOKING_WINDOW_BANDS
from farelens.operators import analytics as A
from farelens.operators.enrich import first_per_date
from farelens.plans import base
from farelens.plans.oracle import band_case, mean_cents, with_ctes
from farelens.plans.registry import query
from farelens.sources.tables import FARE_COLUMNS

FUEL = "fuel_price_usd_per_barrel"
PRICE_STATS = f"{mean_cents()} AS mean_price, round(stddev_samp(price), 2) AS std_price, count(price) AS n"


# ---------------------------------------------------------------- A2
@query("seasonal_variation", with_ctes("""
SELECT route, round((max(mean_price) - min(mean_price)) / avg(mean_price), 6) AS seasonal_variation
FROM m GROUP BY route""", "enriched", extra={"m": f"""
  SELECT route, month(date) AS month, {mean_cents()} AS mean_price FROM enriched GROUP BY route, month(date)"""}))
def seasonal_variation(spark, d):
    return A.seasonal_variation(A.monthly_stats(base.enriched(spark, d)))


# ---------------------------------------------------------------- A3, K2
WEEKLY_SQL = f"""
  SELECT route, CAST(isodow(date) - 1 AS INTEGER) AS weekday, dayname(date) AS day_of_week, {PRICE_STATS}
  FROM enriched GROUP BY route, isodow(date), dayname(date)"""


@query("weekday_stats", with_ctes("SELECT * FROM w", "enriched", extra={"w": WEEKLY_SQL}))
def weekday_stats(spark, d):
    return A.weekday_stats(base.enriched(spark, d))


@query("cheap_days", with_ctes("""
SELECT route, kind, CAST(rank AS INTEGER) AS rank, day_of_week, mean_price FROM (
  SELECT route, 'most_expensive' AS kind,
         row_number() OVER (PARTITION BY route ORDER BY mean_price DESC, weekday) AS rank, day_of_week, mean_price
  FROM w
  UNION ALL
  SELECT route, 'cheapest', row_number() OVER (PARTITION BY route ORDER BY mean_price ASC, weekday), day_of_week,
         mean_price FROM w) WHERE rank <= 2""", "enriched", extra={"w": WEEKLY_SQL}))
def cheap_days(spark, d):
    return A.cheap_days(A.weekday_stats(base.enriched(spark, d)))


# ---------------------------------------------------------------- A4, K3
_BAND_VALUES = ", ".join(f"({i}, '{b[2]}')" for i, b in enumerate(BOOKING_WINDOW_BANDS))
_BAND_IDX = band_case("days_left", [(lo, hi, str(i)) for i, (lo, hi, _) in enumerate(BOOKING_WINDOW_BANDS)])
WINDOW_SQL = f"""
  SELECT r.route, CAST(b.band AS INTEGER) AS band,
         CASE WHEN count(e.price) > 0 THEN {mean_cents('e.price')} END AS mean_price,
         round(stddev_samp(e.price), 2) AS std_price, count(e.price) AS n, b.label AS booking_window
  FROM (SELECT DISTINCT route FROM enriched) r
  CROSS JOIN (VALUES {_BAND_VALUES}) b(band, label)
  LEFT JOIN (SELECT route, CAST({_BAND_IDX} AS INTEGER) AS bi, price FROM enriched) e
    ON e.route = r.route AND e.bi = b.band
  GROUP BY r.route, b.band, b.label"""


@query("booking_window_stats", with_ctes("SELECT * FROM bw", "enriched", extra={"bw": WINDOW_SQL}))
def booking_window_stats(spark, d):
    return A.booking_window_stats(base.enriched(spark, d))


@query("best_window", with_ctes("""
SELECT route, arg_min(booking_window, (mean_price, band)) AS optimal_booking_window,
       min(mean_price) AS optimal_mean_price
FROM bw WHERE mean_price IS NOT NULL GROUP BY route""", "enriched", extra={"bw": WINDOW_SQL}))
def best_window(spark, d):
    return A.best_window(A.booking_window_stats(base.enriched(spark, d)))


# ---------------------------------------------------------------- A5
def _cond_mean(cond: str, n: str) -> str:
    return (f"CASE WHEN {n} > 0 THEN CAST(sum(CASE WHEN {cond} THEN CAST(round(price * 100) AS BIGINT) END) AS DOUBLE)"
            f" / CAST({n} * 100 AS DOUBLE) END")


HOLIDAY_SQL = with_ctes(f"""
SELECT route, mean_holiday, mean_normal, n_holiday, n_normal,
       CASE WHEN mean_holiday IS NOT NULL AND mean_normal IS NOT NULL
            THEN round((mean_holiday - mean_normal) / mean_normal * 100, 6) ELSE 0.0 END
         AS holiday_price_increase_pct,
       mean_season, mean_off_season, round(sh, 2) AS std_holiday, round(sn, 2) AS std_normal,
       round(ss, 2) AS std_season, round(so, 2) AS std_off_season
FROM (SELECT route, stddev_samp(CASE WHEN is_holiday THEN price END) AS sh,
        stddev_samp(CASE WHEN NOT is_holiday THEN price END) AS sn,
        stddev_samp(CASE WHEN is_holiday_season THEN price END) AS ss,
        stddev_samp(CASE WHEN NOT is_holiday_season THEN price END) AS so,
        {_cond_mean('is_holiday', 'count(CASE WHEN is_holiday THEN price END)')} AS mean_holiday,
        {_cond_mean('NOT is_holiday', 'count(CASE WHEN NOT is_holiday THEN price END)')} AS mean_normal,
        count(CASE WHEN is_holiday THEN price END) AS n_holiday,
        count(CASE WHEN NOT is_holiday THEN price END) AS n_normal,
        {_cond_mean('is_holiday_season', 'count(CASE WHEN is_holiday_season THEN price END)')} AS mean_season,
        {_cond_mean('NOT is_holiday_season', 'count(CASE WHEN NOT is_holiday_season THEN price END)')}
          AS mean_off_season
      FROM enriched GROUP BY route)""", "enriched")


@query("holiday_stats", HOLIDAY_SQL)
def holiday_stats(spark, d):
    return A.holiday_stats(base.enriched(spark, d))


# ---------------------------------------------------------------- A6-A8
@query("fuel_correlation", with_ctes(f"""
SELECT route, round(corr(price, {FUEL}), 6) AS fuel_price_correlation FROM enriched GROUP BY route""", "enriched"))
def fuel_correlation(spark, d):
    return A.fuel_correlation(base.enriched(spark, d))


FUEL_RANGE_SQL = f"SELECT route, min({FUEL}) AS lo, max({FUEL}) AS hi FROM enriched GROUP BY route HAVING min({FUEL}) IS NOT NULL"
FUEL_BIN_CELLS_SQL = f"""
SELECT r.route, CAST(b.k + 1 AS INTEGER) AS fuel_bin,
       CASE WHEN count(e.price) > 0 THEN {mean_cents('e.price')} END AS mean_price, count(e.price) AS n
FROM rng r CROSS JOIN range(0, 5) b(k)
LEFT JOIN (
  SELECT x.route, x.price,
         CAST(CASE WHEN g.hi = g.lo THEN 3
                   ELSE coalesce(greatest(1, least(5, ceil(({FUEL} - g.lo) / ((g.hi - g.lo) / 5.0)))), 1) END - 1
              AS INTEGER) AS bi
  FROM enriched x JOIN rng g ON x.route = g.route WHERE x.{FUEL} IS NOT NULL) e
  ON e.route = r.route AND e.bi = b.k
GROUP BY r.route, b.k"""
FUEL_BINS_SQL = with_ctes(FUEL_BIN_CELLS_SQL, "enriched", extra={"rng": FUEL_RANGE_SQL})


@query("fuel_bins", FUEL_BINS_SQL)
def fuel_bins(spark, d):
    return A.fuel_bins(base.enriched(spark, d))


ELASTICITY_SQL = with_ctes(f"""
SELECT route, CASE WHEN n_rows < 10 THEN 0.0
                   WHEN fc IS NULL OR fc = 0 THEN 0.0
                   ELSE round(pc / fc, 6) END AS elasticity
FROM (SELECT route, count(*) AS n_rows,
             (max(price) - min(price)) / ({mean_cents()}) AS pc,
             (max({FUEL}) - min({FUEL})) / avg({FUEL}) AS fc
      FROM enriched GROUP BY route)""", "enriched")


@query("range_elasticity", ELASTICITY_SQL)
def range_elasticity(spark, d):
    return A.range_elasticity(base.enriched(spark, d))


# ---------------------------------------------------------------- A9
ROUTE_PATTERNS_SQL = with_ctes(f"""
SELECT s.route, s.seasonal_variation, pk.peak_months, op.off_peak_months, ch.cheapest_days,
       ex.most_expensive_days, bwin.optimal_booking_window, h.holiday_price_increase_pct,
       c.fuel_price_correlation, el.elasticity
FROM (SELECT route, round((max(mean_price) - min(mean_price)) / avg(mean_price), 6) AS seasonal_variation
      FROM m GROUP BY route) s
LEFT JOIN (SELECT route, list(month ORDER BY rk) AS peak_months FROM (
    SELECT route, month, row_number() OVER (PARTITION BY route ORDER BY mean_price DESC, month) AS rk FROM m)
    WHERE rk <= 3 GROUP BY route) pk ON pk.route = s.route
LEFT JOIN (SELECT route, list(month ORDER BY rk) AS off_peak_months FROM (
    SELECT route, month, row_number() OVER (PARTITION BY route ORDER BY mean_price ASC, month) AS rk FROM m)
    WHERE rk <= 3 GROUP BY route) op ON op.route = s.route
LEFT JOIN (SELECT route, list(day_of_week ORDER BY rk) AS cheapest_days FROM (
    SELECT route, day_of_week, row_number() OVER (PARTITION BY route ORDER BY mean_price ASC, weekday) AS rk FROM w)
    WHERE rk <= 2 GROUP BY route) ch ON ch.route = s.route
LEFT JOIN (SELECT route, list(day_of_week ORDER BY rk) AS most_expensive_days FROM (
    SELECT route, day_of_week, row_number() OVER (PARTITION BY route ORDER BY mean_price DESC, weekday) AS rk FROM w)
    WHERE rk <= 2 GROUP BY route) ex ON ex.route = s.route
LEFT JOIN (SELECT route, arg_min(booking_window, (mean_price, band)) AS optimal_booking_window
           FROM bw WHERE mean_price IS NOT NULL GROUP BY route) bwin ON bwin.route = s.route
LEFT JOIN ({HOLIDAY_SQL[HOLIDAY_SQL.index('SELECT route, mean_holiday'):]}) h ON h.route = s.route
LEFT JOIN (SELECT route, round(corr(price, {FUEL}), 6) AS fuel_price_correlation FROM enriched GROUP BY route) c
  ON c.route = s.route
LEFT JOIN ({ELASTICITY_SQL[ELASTICITY_SQL.index('SELECT route, CASE WHEN n_rows'):]}) el ON el.route = s.route
""", "enriched", extra={
    "m": f"SELECT route, month(date) AS month, {mean_cents()} AS mean_price FROM enriched GROUP BY route, month(date)",
    "w": WEEKLY_SQL, "bw": WINDOW_SQL})


@query("route_patterns", ROUTE_PATTERNS_SQL)
def route_patterns(spark, d):
    return A.route_patterns(base.enriched(spark, d))


def _lists(cells: str, order: str, **fields: str) -> str:
    """One list per field, in the order of the cells; missing numbers as -1."""
    cols = ", ".join(f"list({v} ORDER BY {order}) AS {k}" for k, v in fields.items())
    return f"(SELECT route, {cols} FROM {cells} GROUP BY route)"


_STATS = {"mean": "coalesce(mean_price, -1.0)", "std": "coalesce(std_price, -1.0)", "n": "n"}


def _named(prefix: str, **more: str) -> dict[str, str]:
    return {f"{prefix}_{k}": v for k, v in {**more, **_STATS}.items()}


ROUTE_REPORT_SQL = with_ctes(f"""
SELECT * FROM {_lists("mm", "month", **_named("month", key="month"))} a
JOIN {_lists("w", "weekday", **_named("weekday", key="day_of_week"))} b USING (route)
JOIN {_lists("bw", "band", **_named("window", key="booking_window"))} c USING (route)
JOIN {_lists("hh", "is_holiday", **_named("holiday", key="is_holiday"))} d USING (route)
JOIN {_lists("ss", "is_holiday_season", season_key="is_holiday_season", season_mean="coalesce(mean_price, -1.0)")} e USING (route)
LEFT JOIN {_lists("fb", "fuel_bin", fuel_mean="coalesce(mean_price, -1.0)", fuel_n="n")} f USING (route)
""", "enriched", extra={
    "mm": f"SELECT route, CAST(month(date) AS INTEGER) AS month, {PRICE_STATS} FROM enriched GROUP BY route, month(date)",
    "w": WEEKLY_SQL, "bw": WINDOW_SQL, "hh": f"SELECT route, is_holiday, {PRICE_STATS} FROM enriched GROUP BY route, is_holiday",
    "ss": f"SELECT route, is_holiday_season, {mean_cents()} AS mean_price FROM enriched GROUP BY route, is_holiday_season",
    "rng": FUEL_RANGE_SQL, "fb": FUEL_BIN_CELLS_SQL})


@query("route_report", ROUTE_REPORT_SQL)
def route_report(spark, d):
    """The nested lists of every route, one column per list and field."""
    r = A.route_report(base.enriched(spark, d))

    def field(cells: str, prefix: str, f: str):
        missing = F.lit(-1.0) if f != "n" else F.lit(0)
        return F.transform(cells, lambda c: F.coalesce(c[f], missing)).alias(f"{prefix}_{f.removesuffix('_price')}")

    def fields(cells: str, prefix: str, key: str | None, stats=("mean_price", "std_price", "n")):
        keys = [] if key is None else [F.transform(cells, lambda c: c[key]).alias(f"{prefix}_key")]
        return keys + [field(cells, prefix, f) for f in stats]

    return r.select("route", *fields("monthly", "month", "month"), *fields("weekly", "weekday", "day_of_week"),
                    *fields("windows", "window", "booking_window"), *fields("holidays", "holiday", "is_holiday"),
                    *fields("seasons", "season", "is_holiday_season", ("mean_price",)), *fields("fuel_bins", "fuel", None, ("mean_price", "n")))


# ---------------------------------------------------------------- A10-A14
N_ENRICHED_COLUMNS = len(FARE_COLUMNS) + 6


@query("overview", with_ctes(f"""
SELECT count(*) AS total_records, CAST({N_ENRICHED_COLUMNS} AS INTEGER) AS n_columns,
       count(DISTINCT airline) AS airlines,
       (SELECT count(*) FROM (SELECT DISTINCT "from", "to" FROM enriched)) AS routes
FROM enriched""", "enriched"))
def overview(spark, d):
    return A.overview(base.enriched(spark, d))


@query("price_histogram", with_ctes("""
SELECT bin, count(*) AS n, round(lo + bin * w, 4) AS bin_start FROM (
  SELECT CAST(CASE WHEN w = 0 THEN 0 ELSE least(floor((price - lo) / w), 49) END AS INTEGER) AS bin, lo, w
  FROM fares, (SELECT min(price) AS lo, (max(price) - min(price)) / 50 AS w FROM fares) r
  WHERE price IS NOT NULL)
GROUP BY bin, lo, w""", "fares"))
def price_histogram(spark, d):
    return A.price_histogram(base.fares(spark, d))


@query("price_quartiles", with_ctes("""
SELECT airline, min(price) AS min_price, round(quantile_cont(price, 0.25), 4) AS q1,
       round(quantile_cont(price, 0.5), 4) AS median, round(quantile_cont(price, 0.75), 4) AS q3,
       max(price) AS max_price
FROM fares WHERE airline IS NOT NULL GROUP BY airline""", "fares"))
def price_quartiles(spark, d):
    return A.price_quartiles(base.fares(spark, d))


CORR_COLUMNS = ["year", "month", "quarter", "day", "day_of_week", "day_of_year", "week_of_year",
                "is_weekend", "is_month_end", "route_popularity"]
_PAIRS = [(a, b) for i, a in enumerate(CORR_COLUMNS) for b in CORR_COLUMNS[i:]]


@query("correlation_matrix", with_ctes(" UNION ALL ".join(
    f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, round(c{i}, 6) AS correlation FROM cm"
    for i, (a, b) in enumerate(_PAIRS)), "feat", extra={"cm": "SELECT " + ", ".join(
        f"corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)) AS c{i}" for i, (a, b) in enumerate(_PAIRS)) + " FROM feat"}))
def correlation_matrix(spark, d):
    from farelens.plans.q_features import feature_table
    return A.correlation_matrix(feature_table(spark, d), CORR_COLUMNS)


_DIRTY_COLUMNS = ["fare_key", "price", "airline", "flight", "from", "to", "dep_time", "arr_time", "class", "stop",
                  "duration", "days_left", "date", "price_text"]


@query("null_counts", with_ctes("SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", CAST(count_if(\"{c}\" IS NULL) AS BIGINT) AS nulls FROM fares_dirty" for c in _DIRTY_COLUMNS)
    + ") WHERE nulls > 0", "fares_dirty"))
def null_counts(spark, d):
    return A.null_counts(base.fares_dirty(spark, d))


# ---------------------------------------------------------------- K10, U3, W3, W4
@query("head_sample", with_ctes("SELECT * FROM fares ORDER BY md5(fare_key), fare_key LIMIT 1000", "fares"))
def head_sample(spark, d):
    return A.head_sample(base.fares(spark, d), 1000)


@query("distinct_routes", with_ctes('SELECT DISTINCT "from", "to" FROM fares', "fares"))
def distinct_routes(spark, d):
    return A.distinct_routes(base.fares(spark, d))


@query("first_match", with_ctes("""
SELECT hd AS date, seq, holiday_name, score AS holiday_impact_score FROM hol_day
WHERE hd IN (SELECT date FROM fares)""", "fares", "hol_day"))
def first_match(spark, d):
    days = base.fares(spark, d).select("date").distinct()
    return first_per_date(base.calendar(spark)).join(days, "date", "left_semi")


SEQ_FEATURES = ["price", "duration", "days_left"]


@query("sequence_windows", with_ctes("""
SELECT fare_key, route, price AS label, CAST(30 AS INTEGER) AS seq_len, first_price AS seq_first_price,
       last_price AS seq_last_price, cents AS seq_price_cents
FROM (SELECT fare_key, route, price,
        count(*) OVER w AS n, first_value(price) OVER w AS first_price, last_value(price) OVER w AS last_price,
        CAST(sum(CAST(round(price * 100) AS BIGINT)) OVER w AS BIGINT) AS cents
      FROM enriched
      WINDOW w AS (PARTITION BY route ORDER BY date, fare_key ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING))
WHERE n = 30""", "enriched"))
def sequence_windows(spark, d):
    # only the columns the windows use reach the operator (it writes its input once)
    rows = base.enriched(spark, d).select(*dict.fromkeys(["fare_key", "route", "date", "price", *SEQ_FEATURES]))
    seq = A.sequence_windows(rows, ["route"], ["date", "fare_key"], SEQ_FEATURES, "price")
    s = F.col("sequence")
    return seq.select(
        "fare_key", "route", F.col("price").alias("label"), F.size(s).alias("seq_len"),
        s[0][0].alias("seq_first_price"), s[29][0].alias("seq_last_price"),
        F.aggregate(s, F.lit(0).cast("bigint"),
                    lambda acc, x: acc + F.round(x[0] * 100).cast("bigint")).alias("seq_price_cents"))
