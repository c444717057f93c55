"""DuckDB SQL twins of the registered queries (the correctness oracle).

The driver registers the raw tables as views; every oracle query rebuilds the
fare views it needs as CTEs. The calendar is a fixed parameter table and is
inlined as VALUES from the same definitions the Spark side uses.
"""

from __future__ import annotations

from farelens.constants import HOLIDAY_IMPACT_DEFAULT, HOLIDAY_IMPACT_SCORES
from farelens.sources.calendar import DEFAULT_YEARS, calendar_rows
from farelens.sources.tables import ARR_SLOT_OF_SEGMENT, DEP_SLOT_OF_PRIORITY


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _case(col: str, mapping: dict) -> str:
    whens = " ".join(f"WHEN {_q(k)} THEN {_q(v)}" for k, v in mapping.items())
    return f"CASE {col} {whens} END"


def _calendar_values() -> str:
    rows = ", ".join(f"({seq}, {_q(text)}, {_q(name)}, {'TRUE' if nat else 'FALSE'}, {_q(kind)}, {year})"
                     for seq, text, name, nat, kind, year in calendar_rows(DEFAULT_YEARS))
    return f"(VALUES {rows}) AS t(seq, date_text, holiday_name, is_national_holiday, holiday_type, year)"


def _score_values() -> str:
    rows = ", ".join(f"({_q(k)}, {float(v)})" for k, v in HOLIDAY_IMPACT_SCORES.items())
    return f"(VALUES {rows}) AS s(holiday_name, score)"


FARE_SELECT = f"""
  SELECT concat_ws('|', CAST(l.l_orderkey AS VARCHAR), CAST(l.l_linenumber AS VARCHAR), CAST(l.l_partkey AS VARCHAR),
                   CAST(l.l_suppkey AS VARCHAR), CAST(CAST(l.l_shipdate AS DATE) AS VARCHAR)) AS fare_key,
         l.l_extendedprice AS price,
         p.p_brand AS airline,
         concat(p.p_brand, '-', CAST(p.p_size AS VARCHAR)) AS flight,
         ns.n_name AS "from",
         nc.n_name AS "to",
         {_case('o.o_orderpriority', DEP_SLOT_OF_PRIORITY)} AS dep_time,
         {_case('c.c_mktsegment', ARR_SLOT_OF_SEGMENT)} AS arr_time,
         CASE WHEN l.l_returnflag = 'R' THEN 'Business' ELSE 'Economy' END AS class,
         CASE WHEN l.l_linestatus = 'F' THEN 'zero' ELSE 'one' END AS stop,
         l.l_quantity / 4.0 AS duration,
         CAST(abs(date_diff('day', CAST(o.o_orderdate AS DATE), CAST(l.l_shipdate AS DATE))) % 100 AS INTEGER) AS days_left,
         CAST(l.l_shipdate AS DATE) AS date
         {{extra}}
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN supplier s ON l.l_suppkey = s.s_suppkey
  JOIN nation ns ON s.s_nationkey = ns.n_nationkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation nc ON c.c_nationkey = nc.n_nationkey
  JOIN part p ON l.l_partkey = p.p_partkey"""

CTES: dict[str, str] = {
    "fares": FARE_SELECT.replace("{extra}", ""),
    "fares_dirty": f"""
  SELECT fare_key, price,
         CASE WHEN _ln = 7 THEN NULL ELSE airline END AS airline, flight, "from", "to",
         CASE WHEN _ln = 5 THEN NULL ELSE dep_time END AS dep_time, arr_time, class, stop,
         CASE WHEN _ln = 6 THEN NULL ELSE duration END AS duration, days_left, date, price_text
  FROM ({FARE_SELECT.replace("{extra}", ", l.l_linenumber AS _ln, concat('\"', format('{:,.2f}', l.l_extendedprice), '\"') AS price_text")}) b
  CROSS JOIN LATERAL (SELECT unnest(CASE WHEN b._ln = 1 THEN [0, 1] ELSE [0] END) AS _copy) c""",
    "clean_file": """
  SELECT fare_key, airline, flight, "from" AS source_city, "to" AS destination_city, dep_time AS departure_time,
         arr_time AS arrival_time, stop AS stops, class, duration, days_left, price FROM fares""",
    "file_base": FARE_SELECT.replace("{extra}", """, l.l_linenumber AS _ln, l.l_returnflag AS _rf,
         substring(p.p_brand, 1, 2) AS ch_code, CAST(p.p_size AS VARCHAR) AS num_code,
         printf('%dh %02dm', CAST(floor(l.l_quantity / 4.0) AS BIGINT),
                CAST(floor((l.l_quantity / 4.0 - floor(l.l_quantity / 4.0)) * 60) AS BIGINT)) AS time_taken,
         CASE WHEN l.l_linenumber = 3 THEN '31-02-' || CAST(year(l.l_shipdate) AS VARCHAR)
              ELSE strftime(CAST(l.l_shipdate AS DATE), '%d-%m-%Y') END AS dmy,
         format('{:,.2f}', l.l_extendedprice) AS price_commas"""),
    "business_file": """
  SELECT fare_key, airline, ch_code, num_code, "from", "to", stop, dep_time, arr_time, time_taken,
         dmy AS ggldate, '"' || price_commas || '"' AS price FROM file_base WHERE _rf = 'R'""",
    "economy_file": """
  SELECT fare_key, airline, ch_code, num_code, "from", "to", stop, dep_time, arr_time, time_taken,
         dmy AS date, price_commas AS price FROM file_base WHERE _rf <> 'R'""",
    "fuel": """
  SELECT CAST(o_orderdate AS DATE) AS date,
         max(o_totalprice) / 1000.0 AS fuel_price_usd_per_barrel,
         max(o_totalprice) / 1000.0 * 0.53 AS fuel_price_inr_per_liter
  FROM orders GROUP BY 1""",
    "cal": f"""
  SELECT t.seq, CAST(CAST(t.date_text AS TIMESTAMP) AS DATE) AS date, t.holiday_name, t.is_national_holiday,
         t.holiday_type, CAST(t.year AS INTEGER) AS year,
         coalesce(s.score, {float(HOLIDAY_IMPACT_DEFAULT)}) AS holiday_impact_score
  FROM {_calendar_values()} LEFT JOIN {_score_values()} ON t.holiday_name = s.holiday_name""",
    "hol_day": """
  SELECT date AS hd, arg_min(holiday_name, seq) AS holiday_name, arg_min(holiday_impact_score, seq) AS score,
         min(seq) AS seq
  FROM cal GROUP BY date""",
    "hol_win": """
  SELECT day, arg_min(days_to_holiday, seq) AS days_to_holiday, arg_min(holiday_name, seq) AS season_holiday_name,
         arg_min(holiday_impact_score, seq) AS holiday_impact
  FROM (SELECT c.seq, CAST(c.date + CAST(r.k AS INTEGER) AS DATE) AS day, CAST(-r.k AS INTEGER) AS days_to_holiday, c.holiday_name,
               c.holiday_impact_score
        FROM cal c, range(-7, 8) r(k)) x
  GROUP BY day""",
    "enriched": """
  SELECT f.*, fu.fuel_price_usd_per_barrel, fu.fuel_price_inr_per_liter,
         hd.hd IS NOT NULL AS is_holiday, coalesce(hd.score, 0.0) AS holiday_impact_score,
         hw.day IS NOT NULL AS is_holiday_season,
         f."from" || '-' || f."to" AS route
  FROM fares f
  LEFT JOIN fuel fu ON f.date = fu.date
  LEFT JOIN hol_day hd ON f.date = hd.hd
  LEFT JOIN hol_win hw ON f.date = hw.day""",
}

DEPENDS = {
    "fares_dirty": [],
    "clean_file": ["fares"],
    "business_file": ["file_base"],
    "economy_file": ["file_base"],
    "hol_day": ["cal"],
    "hol_win": ["cal"],
    "enriched": ["fares", "fuel", "cal", "hol_day", "hol_win"],
}


def _closure(names) -> list[str]:
    out: list[str] = []

    def visit(n):
        for d in DEPENDS.get(n, []):
            visit(d)
        if n not in out:
            out.append(n)
    for n in names:
        visit(n)
    return out


def with_ctes(body: str, *names: str, extra: dict[str, str] | None = None) -> str:
    """``WITH <needed views> <body>``; ``extra`` adds query-local CTEs after the shared ones."""
    parts = [f"{n} AS ({CTES[n]})" for n in _closure(names)]
    parts += [f"{k} AS ({v})" for k, v in (extra or {}).items()]
    return "WITH " + ",\n".join(parts) + "\n" + body


# SQL macro for an exact money mean (integer cents, one division).
def mean_cents(col: str = "price") -> str:
    return f"CAST(sum(CAST(round({col} * 100) AS BIGINT)) AS DOUBLE) / CAST(count({col}) * 100 AS DOUBLE)"


# ---------------------------------------------------------------- feature views
def _in(col: str, values) -> str:
    return f"{col} IN ({', '.join(_q(v) for v in values)})"


def _map_case(col: str, mapping: dict, default=None) -> str:
    whens = " ".join(f"WHEN {_q(k) if isinstance(k, str) else k} THEN {_q(v) if isinstance(v, str) else v}"
                     for k, v in mapping.items())
    expr = f"CASE {col} {whens} END"
    return expr if default is None else f"coalesce({expr}, {default})"


def band_case(col: str, bands) -> str:
    parts = []
    for lo, hi, label in bands:
        cond = f"{col} > {lo}" + (f" AND {col} <= {hi}" if hi is not None else "")
        parts.append(f"WHEN {cond} THEN {_q(label)}")
    return "CASE " + " ".join(parts) + " END"


def _feature_sql() -> dict[str, str]:
    from farelens.constants import (BUDGET_AIRLINES, DURATION_MINUTE_BANDS, MAJOR_CITIES, PEAK_TIMES,
                                    PREMIUM_AIRLINES, SEASONS, TIME_LABEL_FIXES, TIME_SLOTS)
    relabel = lambda c: f"coalesce({_map_case(c, TIME_LABEL_FIXES)}, {c})"
    pat = "'(\\d+)h\\s*(\\d+)m'"
    std = f"""
  SELECT * REPLACE ({relabel('dep_time')} AS dep_time, {relabel('arr_time')} AS arr_time),
         coalesce(printf('%dh %02dm', CAST(floor(duration) AS BIGINT),
                         CAST(floor((duration - floor(duration)) * 60) AS BIGINT)), '2h 00m') AS time_taken
  FROM fares"""
    temporal = f"""
  SELECT *, {_map_case('month', SEASONS)} AS season, CAST(day_of_week >= 5 AS INTEGER) AS is_weekend,
         CAST(day >= 25 AS INTEGER) AS is_month_end
  FROM (SELECT *, CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month,
               CAST(quarter(date) AS INTEGER) AS quarter, CAST(day(date) AS INTEGER) AS day,
               CAST(isodow(date) - 1 AS INTEGER) AS day_of_week, CAST(dayofyear(date) AS INTEGER) AS day_of_year,
               CAST(weekofyear(date) AS INTEGER) AS week_of_year FROM std)"""
    hours = f"coalesce(TRY_CAST(nullif(regexp_extract(time_taken, {pat}, 1), '') AS DOUBLE), 2.0)"
    mins = f"coalesce(TRY_CAST(nullif(regexp_extract(time_taken, {pat}, 2), '') AS DOUBLE), 0.0)"
    rest = f"""
  SELECT *, {band_case('total_flight_minutes', DURATION_MINUTE_BANDS)} AS duration_category FROM (
  SELECT *, flight_hours * 60 + flight_minutes AS total_flight_minutes FROM (
  SELECT *,
         count(*) OVER (PARTITION BY "from", "to") AS route_popularity,
         CAST(coalesce({_in('"from"', MAJOR_CITIES)}, FALSE) AS INTEGER) AS from_major_city,
         CAST(coalesce({_in('"to"', MAJOR_CITIES)}, FALSE) AS INTEGER) AS to_major_city,
         CAST(coalesce({_in('"from"', MAJOR_CITIES)}, FALSE) AND coalesce({_in('"to"', MAJOR_CITIES)}, FALSE)
              AS INTEGER) AS major_to_major,
         'Domestic' AS route_type,
         {_map_case('dep_time', TIME_SLOTS, 3)} AS dep_time_slot,
         {_map_case('arr_time', TIME_SLOTS, 3)} AS arr_time_slot,
         CAST(coalesce({_in('dep_time', PEAK_TIMES)}, FALSE) AS INTEGER) AS is_peak_departure,
         {hours} AS flight_hours, {mins} AS flight_minutes,
         CASE WHEN {_in('airline', PREMIUM_AIRLINES)} THEN 'Premium' WHEN {_in('airline', BUDGET_AIRLINES)}
              THEN 'Budget' ELSE 'Other' END AS airline_type,
         CASE WHEN airline IS NULL THEN NULL ELSE count(*) OVER (PARTITION BY airline) END AS airline_market_share
  FROM temporal))"""
    feat = """
  SELECT r.*, fu.fuel_price_usd_per_barrel, fu.fuel_price_inr_per_liter,
         hd.hd IS NOT NULL AS is_holiday, coalesce(hd.score, 0.0) AS holiday_impact_score,
         hw.day IS NOT NULL AS is_holiday_season
  FROM rest r
  LEFT JOIN fuel fu ON r.date = fu.date
  LEFT JOIN hol_day hd ON r.date = hd.hd
  LEFT JOIN hol_win hw ON r.date = hw.day"""
    return {"std": std, "temporal": temporal, "rest": rest, "feat": feat}


CTES.update(_feature_sql())
DEPENDS.update({"std": ["fares"], "temporal": ["std"], "rest": ["temporal"],
                "feat": ["rest", "fuel", "hol_day", "hol_win"]})


CTES["quotes"] = FARE_SELECT.replace("{extra}", """, p.p_retailprice * l.l_quantity AS y,
         l.l_extendedprice AS pred_linear, l.l_extendedprice * (1 - l.l_discount) AS pred_forest,
         l.l_extendedprice * (1 + l.l_discount) AS pred_boosted""")
CTES["qlong"] = """
  SELECT fare_key, CASE WHEN b < 60 THEN 'train' WHEN b < 80 THEN 'val' ELSE 'test' END AS split, model, y, prediction
  FROM (SELECT fare_key, CAST(('0x' || substr(md5(fare_key), 1, 8)) AS BIGINT) % 100 AS b, y,
               unnest([{'model': 'linear_regression', 'prediction': pred_linear},
                       {'model': 'random_forest', 'prediction': pred_forest},
                       {'model': 'boosted_trees', 'prediction': pred_boosted}], recursive := true)
        FROM quotes)"""
CTES["metrics"] = """
  SELECT model, split, avg(abs(y - prediction)) AS mae, avg((y - prediction) * (y - prediction)) AS mse,
         sqrt(avg((y - prediction) * (y - prediction))) AS rmse,
         1.0 - sum((y - prediction) * (y - prediction)) / (var_pop(y) * count(*)) AS r2,
         avg(abs((y - prediction) / y)) * 100 AS mape
  FROM qlong GROUP BY model, split"""
DEPENDS.update({"qlong": ["quotes"], "metrics": ["qlong"]})
