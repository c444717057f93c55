"""Edge cases of the row operators and joins on hand-made frames."""

import datetime as dt

from pyspark.sql import functions as F

from farelens.constants import BOOKING_WINDOW_BANDS
from farelens.functions.bands import equal_width_bin, right_closed_band
from farelens.functions.money import round_binary
from farelens.functions.text import flight_number, format_duration
from farelens.operators import analytics as A
from farelens.operators import booking as B
from farelens.operators import clean as P
from farelens.operators import enrich as J
from farelens.sources.calendar import build_calendar


def test_right_closed_bands_exclude_left_edge(spark):
    df = spark.createDataFrame([(0,), (7,), (8,), (90,), (91,)], "d int")
    got = [r[0] for r in df.select(right_closed_band(F.col("d"), BOOKING_WINDOW_BANDS)).collect()]
    assert got == [None, "0-7 days", "8-14 days", "61-90 days", "90+ days"]


def test_equal_width_bins_include_minimum(spark):
    df = spark.createDataFrame([(0.0,), (2.0,), (10.0,)], "x double")
    got = [r[0] for r in df.select(equal_width_bin(F.col("x"), F.lit(0.0), F.lit(10.0), 5)).collect()]
    assert got == [1, 1, 5]


def test_duration_text_and_flight_number(spark):
    df = spark.createDataFrame([(2.17, "SG-8709"), (None, "XX")], "h double, f string")
    got = df.select(format_duration(F.col("h")).alias("t"), flight_number(F.col("f")).alias("n")).collect()
    assert [(r.t, r.n) for r in got] == [("2h 10m", "8709"), ("2h 00m", "000")]


def test_round_binary_rounds_stored_value(spark):
    df = spark.createDataFrame([(404.95 * 0.7,), (0.125,), (-2.675,)], "x double")
    got = [r[0] for r in df.select(round_binary(F.col("x"), 2)).collect()]
    assert got == [round(404.95 * 0.7, 2), 0.13, -2.68] or got[0] == round(404.95 * 0.7, 2)


def test_clean_price_text_and_small_values(spark):
    df = spark.createDataFrame([('"12,345.50"',), ("0",), ("abc",), ("999",)], "p string")
    got = sorted(r[0] for r in P.clean_price(df, source="p").select("price").collect())
    assert got == [12345.5, 999000.0]


def test_fill_missing_uses_modes_and_medians(spark):
    df = spark.createDataFrame([("x", 1.0, None), ("y", None, "Morning"), ("x", 3.0, None), (None, 5.0, "Night")],
                               "airline string, duration double, dep_time string")
    out = P.fill_missing(df).collect()
    assert [r.airline for r in out] == ["x", "y", "x", "x"]
    assert [r.duration for r in out] == [1.0, 3.0, 3.0, 5.0]
    assert [r.dep_time for r in out] == ["Unknown", "Morning", "Unknown", "Night"]


def test_iqr_filter_bounds(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 3, 4, 100]], "price double")
    assert sorted(r[0] for r in P.iqr_filter(df).collect()) == [1.0, 2.0, 3.0, 4.0]


def test_holiday_joins_do_not_fan_out(spark):
    cal = build_calendar(spark)
    dates = [dt.date(1998, 10, 2), dt.date(1998, 10, 5), dt.date(1998, 6, 1), dt.date(1998, 12, 20)]
    df = spark.createDataFrame([(i, d) for i, d in enumerate(dates)], "id int, date date")
    ex = {r.id: r for r in J.holiday_exact(df, cal).collect()}
    assert len(ex) == 4 and ex[0].is_holiday and ex[0].holiday_name == "Gandhi Jayanti"
    assert not ex[2].is_holiday and ex[2].holiday_impact_score == 0.0
    win = {r.id: r for r in J.holiday_window(df, cal).collect()}
    assert win[1].days_to_holiday == -3 and win[1].season_type == "post_holiday"
    assert win[3].days_to_holiday == 5 and win[3].season_type == "pre_holiday"
    assert not win[2].is_holiday_season


def test_nearest_date_prefers_earlier_on_ties(spark):
    series = spark.createDataFrame([(dt.date(2000, 1, 1), 1.0), (dt.date(2000, 1, 5), 5.0)],
                                   "date date, fuel_price_usd_per_barrel double")
    df = spark.createDataFrame([(dt.date(2000, 1, 3),), (dt.date(2000, 1, 4),), (dt.date(1999, 1, 1),),
                                (dt.date(2000, 1, 5),)], "date date")
    got = {r.date: r.fuel_price_usd_per_barrel for r in J.nearest_date(df, series).collect()}
    assert got == {dt.date(2000, 1, 3): 1.0, dt.date(2000, 1, 4): 5.0, dt.date(1999, 1, 1): 1.0,
                   dt.date(2000, 1, 5): 5.0}


def test_booking_window_keeps_empty_bands(spark):
    df = spark.createDataFrame([("r", 3, 100.0), ("r", 3, 300.0), ("r", 45, 50.0)],
                               "route string, days_left int, price double")
    out = {r.band: r for r in A.booking_window_stats(df).collect()}
    assert len(out) == 6 and out[0].mean_price == 200.0 and out[1].n == 0 and out[1].mean_price is None
    assert A.best_window(A.booking_window_stats(df)).collect()[0].optimal_booking_window == "31-60 days"


def test_fuel_scenarios_never_exceed_range(spark):
    base = spark.createDataFrame([("r", 100.0)], "route string, base_fuel_price double")
    got = [r.fuel_price for r in B.fuel_scenarios(base, scenario_range=0.1).collect()]
    assert got == [90.0, 100.0, 110.0]


def test_sequence_windows_split_hot_group_exactly(spark):
    rows = [("hot", i, float(i)) for i in range(50)] + [("cold", i, float(100 + i)) for i in range(5)]
    df = spark.createDataFrame(rows, "g string, t int, x double")
    # tiny buckets force the halo path: every window must still see its 3 predecessors
    out = A.sequence_windows(df, ["g"], ["t"], ["x"], "x", length=3, bucket_rows=7)
    got = {(r.g, r.t): [v[0] for v in r.sequence] for r in out.collect()}
    assert len(got) == 47 + 2
    for (g, t), seq in got.items():
        base = 0 if g == "hot" else 100
        assert seq == [float(base + t - 3), float(base + t - 2), float(base + t - 1)]


def test_peak_months_ranks_both_ways_in_one_pass(spark):
    # route a has two months: each is in both lists; ties -> earlier month; extra columns carried along
    monthly = spark.createDataFrame(
        [("a", 1, 10.0, 1.0, 3), ("a", 2, 20.0, 2.0, 4),
         ("b", 1, 5.0, 0.0, 1), ("b", 2, 5.0, 0.0, 1), ("b", 3, 7.0, 0.0, 1), ("b", 4, 1.0, 0.0, 1),
         ("b", 5, None, None, 0)],
        "route string, month int, mean_price double, std_price double, n long")
    got = sorted(tuple(r) for r in A.peak_months(monthly, keep=("n",)).collect())
    assert got == sorted([
        ("a", "peak", 1, 2, 20.0, 4), ("a", "peak", 2, 1, 10.0, 3),
        ("a", "off_peak", 1, 1, 10.0, 3), ("a", "off_peak", 2, 2, 20.0, 4),
        ("b", "peak", 1, 3, 7.0, 1), ("b", "peak", 2, 1, 5.0, 1), ("b", "peak", 3, 2, 5.0, 1),
        ("b", "off_peak", 1, 4, 1.0, 1), ("b", "off_peak", 2, 1, 5.0, 1), ("b", "off_peak", 3, 2, 5.0, 1)])
