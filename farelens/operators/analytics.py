"""Route pattern reports and table summaries.

Every report is computed for all routes at once with ``groupBy(route, ...)``:
aggregates combine map-side, so a route that holds a third of the rows costs
one partial row per map task. Windows only run over aggregated tables (at
most a dozen rows per route), never over fare rows, except the sequence
window (W4), which first splits each route into bounded row buckets.

Money means are computed from integer cents (``functions.money``) so they are
exact and engine-independent; standard deviations are rounded to cents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from farelens.constants import BOOKING_WINDOW_BANDS, WEEKDAY_NAMES
from farelens.functions.bands import equal_width_bin, right_closed_band
from farelens.functions.money import cents, mean_from_cents, mean_price
from farelens.operators.stats import exact_quantiles, materialize, shuffle_partitions


def with_route(df: DataFrame, sep: str = "-") -> DataFrame:
    """Route key ``from-to`` (the pattern reports always group by it)."""
    if "route" in df.columns:
        return df
    return df.withColumn("route", F.concat_ws(sep, F.col("from"), F.col("to")))


def _price_stats(price: str = "price") -> list[Column]:
    return [mean_price(F.col(price)).alias("mean_price"),
            F.round(F.stddev_samp(price), 2).alias("std_price"),
            F.count(price).alias("n")]


# ---------------------------------------------------------------- A1, A2, K1
def monthly_stats(df: DataFrame, by=("route",), date_col: str = "date") -> DataFrame:
    """A1: mean, sample std and count of price by month (per route)."""
    return (df.groupBy(*by, F.month(F.col(date_col)).alias("month")).agg(*_price_stats()))


def seasonal_variation(monthly: DataFrame, by=("route",)) -> DataFrame:
    """A2: (max - min) / mean of the monthly means."""
    return monthly.groupBy(*by).agg(
        F.round((F.max("mean_price") - F.min("mean_price")) / F.avg("mean_price"), 6).alias("seasonal_variation"))


def top_k(stats: DataFrame, by, key: str, k: int, order_col: str = "mean_price", tiebreak: str | None = None,
          kinds=(("high", True), ("low", False)), keep=()) -> DataFrame:
    """K1/K2: the ``k`` highest and lowest rows by ``order_col`` per group, ties -> ``tiebreak`` order.

    Runs over an aggregated table (a few rows per group). Both orders are
    ranked in one pass (one shuffle by group, one sort per order), and a row
    that is in both lists comes out once per list. ``keep`` carries further
    columns of ``stats`` along, so callers need no join back to the table.
    """
    tiebreak = tiebreak or key
    ranked = stats.where(F.col(order_col).isNotNull())
    for i, (_, desc) in enumerate(kinds):
        o = F.col(order_col).desc() if desc else F.col(order_col).asc()
        ranked = ranked.withColumn(f"_r{i}", F.row_number().over(
            Window.partitionBy(*by).orderBy(o, F.col(tiebreak).asc())))
    picks = F.filter(F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(f"_r{i}").alias("rank"))
                               for i, (kind, _) in enumerate(kinds)]), lambda p: p["rank"] <= k)
    near_top = [F.col(f"_r{i}") <= k for i in range(len(kinds))]
    return (ranked.where(near_top[0] | near_top[1] if len(near_top) > 1 else near_top[0])
            .select(*by, F.explode(picks).alias("_p"), key, order_col, *keep)
            .select(*by, "_p.kind", "_p.rank", key, order_col, *keep))


def peak_months(monthly: DataFrame, by=("route",), k: int = 3, keep=()) -> DataFrame:
    """K1: three highest (``peak``) and lowest (``off_peak``) months; ties -> earlier month."""
    return top_k(monthly, by, "month", k, kinds=(("peak", True), ("off_peak", False)), keep=keep)


# ---------------------------------------------------------------- A3, K2
def weekday_stats(df: DataFrame, by=("route",), date_col: str = "date") -> DataFrame:
    """A3: price stats by weekday name (``weekday`` 0 = Monday for ordering)."""
    d = F.col(date_col)
    return df.groupBy(*by, F.weekday(d).alias("weekday"), F.date_format(d, "EEEE").alias("day_of_week")) \
        .agg(*_price_stats())


def cheap_days(weekly: DataFrame, by=("route",), k: int = 2) -> DataFrame:
    """K2: two cheapest and two most expensive weekdays; ties -> earlier weekday."""
    return top_k(weekly, by, "day_of_week", k, tiebreak="weekday",
                 kinds=(("most_expensive", True), ("cheapest", False)))


# ---------------------------------------------------------------- A4, K3
def _per_band(df: DataFrame, by, band_idx: Column, n_bands: int, price: str = "price") -> DataFrame:
    """Stats for every band of every group, empty bands kept (count 0, mean null).

    One grouped aggregate with a conditional column set per band, then one
    ``explode`` per group: no join against a band table, no cross product.
    """
    tagged = df.withColumn("_b", band_idx)
    aggs = []
    for i in range(n_bands):
        hit = F.col("_b") == i
        aggs += [F.sum(F.when(hit, cents(F.col(price)))).alias(f"s{i}"),
                 F.count(F.when(hit, F.col(price))).alias(f"n{i}"),
                 F.stddev_samp(F.when(hit, F.col(price))).alias(f"d{i}")]
    g = tagged.groupBy(*by).agg(*aggs)
    rows = F.array(*[F.struct(F.lit(i).alias("band"), F.col(f"s{i}").alias("s"), F.col(f"n{i}").alias("n"),
                              F.col(f"d{i}").alias("d")) for i in range(n_bands)])
    ex = g.select(*by, F.explode(rows).alias("r"))
    return ex.select(*by, F.col("r.band").alias("band"),
                     F.when(F.col("r.n") > 0, mean_from_cents(F.col("r.s"), F.col("r.n"))).alias("mean_price"),
                     F.round(F.col("r.d"), 2).alias("std_price"), F.col("r.n").alias("n"))


def booking_window_stats(df: DataFrame, by=("route",), days: str = "days_left", bands=None) -> DataFrame:
    """A4: price stats by booking window (0,7], (7,14], ... (90,inf); empty windows kept."""
    bands = bands or BOOKING_WINDOW_BANDS
    out = _per_band(df, by, right_closed_band(F.col(days), bands, as_index=True), len(bands))
    labels = F.array(*[F.lit(b[2]) for b in bands])
    return out.withColumn("booking_window", F.element_at(labels, F.col("band") + 1))


def best_window(window_stats: DataFrame, by=("route",)) -> DataFrame:
    """K3: booking window with the lowest mean (empty windows skipped; ties -> earlier window)."""
    best = window_stats.where(F.col("mean_price").isNotNull()).groupBy(*by).agg(
        F.min(F.struct("mean_price", "band", "booking_window")).alias("b"))
    return best.select(*by, F.col("b.booking_window").alias("optimal_booking_window"),
                       F.col("b.mean_price").alias("optimal_mean_price"))


# ---------------------------------------------------------------- A5
def holiday_stats(df: DataFrame, by=("route",)) -> DataFrame:
    """A5: mean and deviation of the price on holidays and other days, in and off season, and the
    % increase on holidays (0 unless both kinds of day exist)."""
    hol, sea = F.col("is_holiday"), F.col("is_holiday_season")
    p = F.col("price")
    g = df.groupBy(*by).agg(
        F.sum(F.when(hol, cents(p))).alias("sh"), F.count(F.when(hol, p)).alias("n_holiday"),
        F.sum(F.when(~hol, cents(p))).alias("sn"), F.count(F.when(~hol, p)).alias("n_normal"),
        F.sum(F.when(sea, cents(p))).alias("ss"), F.count(F.when(sea, p)).alias("n_season"),
        F.sum(F.when(~sea, cents(p))).alias("so"), F.count(F.when(~sea, p)).alias("n_off_season"),
        *[F.round(F.stddev_samp(F.when(c, p)), 2).alias(f"std_{k}") for k, c in (
            ("holiday", hol), ("normal", ~hol), ("season", sea), ("off_season", ~sea))],
    )
    mh = F.when(F.col("n_holiday") > 0, mean_from_cents(F.col("sh"), F.col("n_holiday")))
    mn = F.when(F.col("n_normal") > 0, mean_from_cents(F.col("sn"), F.col("n_normal")))
    return g.select(
        *by, mh.alias("mean_holiday"), mn.alias("mean_normal"), "n_holiday", "n_normal",
        F.when(mh.isNotNull() & mn.isNotNull(), F.round((mh - mn) / mn * 100, 6)).otherwise(F.lit(0.0))
        .alias("holiday_price_increase_pct"),
        F.when(F.col("n_season") > 0, mean_from_cents(F.col("ss"), F.col("n_season"))).alias("mean_season"),
        F.when(F.col("n_off_season") > 0, mean_from_cents(F.col("so"), F.col("n_off_season"))).alias("mean_off_season"),
        "std_holiday", "std_normal", "std_season", "std_off_season",
    )


# ---------------------------------------------------------------- A6-A8
FUEL = "fuel_price_usd_per_barrel"


def fuel_correlation(df: DataFrame, by=("route",), fuel: str = FUEL) -> DataFrame:
    """Pearson correlation of price and the daily index."""
    return df.groupBy(*by).agg(F.round(F.corr("price", fuel), 6).alias("fuel_price_correlation"))


def fuel_bins(df: DataFrame, by=("route",), fuel: str = FUEL, n_bins: int = 5) -> DataFrame:
    """Mean price in ``n_bins`` equal-width bins of the index (per route); empty bins kept.

    The fares are read once: cent sums and counts per (route, index value), of which a route has one
    per day at most. Range and bins come from that table by a window over a route's few values.
    """
    p = F.col("price")
    cells = df.where(F.col(fuel).isNotNull()).groupBy(*by, F.col(fuel).alias("_f")).agg(F.sum(cents(p)).alias("_s"), F.count(p).alias("_n"))
    w = Window.partitionBy(*by)
    cells = cells.withColumns({"_lo": F.min("_f").over(w), "_hi": F.max("_f").over(w)})
    b = F.when(F.col("_hi") == F.col("_lo"), F.lit((n_bins + 1) // 2)).otherwise(
        equal_width_bin(F.col("_f"), F.col("_lo"), F.col("_hi"), n_bins))
    tagged = cells.withColumn("_b", b)
    sums = tagged.groupBy(*by).agg(*[F.sum(F.when(F.col("_b") == i + 1, F.col("_s"))).alias(f"s{i}") for i in range(n_bins)],
                                   *[F.sum(F.when(F.col("_b") == i + 1, F.col("_n")).otherwise(F.lit(0))).alias(f"n{i}") for i in range(n_bins)])
    bins = F.array(*[F.struct(F.lit(i + 1).alias("fuel_bin"), F.when(F.col(f"n{i}") > 0, mean_from_cents(F.col(f"s{i}"), F.col(f"n{i}")))
                              .alias("mean_price"), F.col(f"n{i}").alias("n")) for i in range(n_bins)])
    return sums.select(*by, F.explode(bins).alias("r")).select(*by, "r.*")


def range_elasticity(df: DataFrame, by=("route",), fuel: str = FUEL, min_rows: int = 10) -> DataFrame:
    """Relative price range over relative index range; 0 with < ``min_rows`` rows or a flat index."""
    g = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_rows"),
        F.max("price").alias("_pmax"), F.min("price").alias("_pmin"), mean_price(F.col("price")).alias("_pmean"),
        F.max(fuel).alias("_fmax"), F.min(fuel).alias("_fmin"), F.avg(fuel).alias("_fmean"))
    fuel_change = (F.col("_fmax") - F.col("_fmin")) / F.col("_fmean")
    price_change = (F.col("_pmax") - F.col("_pmin")) / F.col("_pmean")
    e = (F.when(F.col("_rows") < min_rows, F.lit(0.0))
         .when(fuel_change.isNull() | (fuel_change == 0), F.lit(0.0))
         .otherwise(F.round(price_change / fuel_change, 6)))
    return g.select(*by, e.alias("elasticity"))


# ---------------------------------------------------------------- A9
def route_report(df: DataFrame, fuel: str = FUEL, bands=None, fuel_bins: int = 5, min_rows: int = 10) -> DataFrame:
    """One row per route with every pattern list and its summary, from one pass over the fares.

    The fares are aggregated once over grouping sets: (route, month), (route, weekday), (route, booking
    window), (route, holiday), (route, holiday season), (route, index value) and (route). Each set
    combines map-side, so what is shuffled is bounded by routes times days, not by fares. The second
    step folds a route's cells into ordered arrays of structs: ``monthly``, ``weekly``, ``windows`` (empty
    ones kept), ``holidays``, ``seasons`` and ``fuel_bins`` (``fuel_bins`` equal-width bins over the route's own
    range); everything else is computed from those arrays. A route has at most one cell per
    month, weekday, window and day, so the arrays are small.
    """
    bands = bands or BOOKING_WINDOW_BANDS
    days = F.col("date")
    rows = with_route(df).select(
        "route", "price", F.col(fuel).alias("fuel"), F.month(days).alias("_month"), F.weekday(days).alias("_weekday"),
        right_closed_band(F.col("days_left"), bands, as_index=True).alias("_band"), F.col("is_holiday").alias("_holiday"),
        F.col("is_holiday_season").alias("_season"), F.col(fuel).alias("_fuel"))
    keys = ["_month", "_weekday", "_band", "_holiday", "_season", "_fuel"]
    p = F.col("price")
    both = p.isNotNull() & F.col("fuel").isNotNull()
    cells = rows.groupingSets([*[["route", k] for k in keys], ["route"]], "route", *keys).agg(
        F.grouping_id().alias("_set"), F.sum(cents(p)).alias("s"), F.count(p).alias("n"), F.stddev_samp(p).alias("sd"),
        F.count(F.lit(1)).alias("rows"), F.covar_pop("price", "fuel").alias("cov"), F.stddev_pop(F.when(both, p)).alias("p_sd"),
        F.stddev_pop(F.when(both, F.col("fuel"))).alias("f_sd"), F.min(p).alias("p_min"), F.max(p).alias("p_max"),
        F.min("fuel").alias("f_min"), F.max("fuel").alias("f_max"), F.avg("fuel").alias("f_mean"))
    mean = F.when(F.col("n") > 0, mean_from_cents(F.col("s"), F.col("n"))).alias("mean_price")
    std, n = F.round(F.col("sd"), 2).alias("std_price"), F.col("n")
    whole = (1 << len(keys)) - 1                          # a key's bit is set where it is folded away

    def cell(key: str, *fields: Column) -> Column:
        inside = (F.col("_set") == (whole ^ (1 << (len(keys) - 1 - keys.index(key))))) & F.col(key).isNotNull()
        return F.array_sort(F.collect_list(F.when(inside, F.struct(*fields))))

    def total(col: str) -> Column:
        return F.max(F.when(F.col("_set") == whole, F.col(col))).alias(col)

    names = F.array(*[F.lit(d) for d in WEEKDAY_NAMES])
    labels = F.array(*[F.lit(b[2]) for b in bands])
    g = cells.groupBy("route").agg(
        cell("_month", F.col("_month").alias("month"), mean, std, n).alias("monthly"),
        cell("_weekday", F.col("_weekday").alias("weekday"), F.element_at(names, F.col("_weekday") + 1).alias("day_of_week"), mean, std, n).alias("weekly"),
        cell("_band", F.col("_band").alias("band"), F.element_at(labels, F.col("_band") + 1).alias("booking_window"), mean, std, n).alias("_windows"),
        cell("_holiday", F.col("_holiday").alias("is_holiday"), mean, std, n).alias("holidays"),
        cell("_season", F.col("_season").alias("is_holiday_season"), mean).alias("seasons"),
        cell("_fuel", F.col("_fuel").alias("fuel"), F.col("s"), n).alias("_fuels"),
        *[total(c) for c in ("s", "n", "rows", "cov", "p_sd", "f_sd", "p_min", "p_max", "f_min", "f_max", "f_mean")])
    empty = [F.struct(F.lit(i).alias("band"), F.lit(b[2]).alias("booking_window"), F.lit(None).cast("double").alias("mean_price"),
                      F.lit(None).cast("double").alias("std_price"), F.lit(0).cast("bigint").alias("n")) for i, b in enumerate(bands)]

    def band_of(i: int) -> Column:
        return F.coalesce(F.get(F.filter("_windows", lambda w: w["band"] == i), F.lit(0)), empty[i])

    windows = F.array(*[band_of(i) for i in range(len(bands))])
    bin_of = lambda v: F.when(F.col("f_max") == F.col("f_min"), F.lit((fuel_bins + 1) // 2)).otherwise(
        equal_width_bin(v, F.col("f_min"), F.col("f_max"), fuel_bins))

    def fuel_bin(i: int) -> Column:
        mine = F.filter("_fuels", lambda c: bin_of(c["fuel"]) == i)
        held = F.aggregate(mine, F.lit(0).cast("bigint"), lambda a, c: a + F.coalesce(c["s"], F.lit(0)))
        count = F.aggregate(mine, F.lit(0).cast("bigint"), lambda a, c: a + c["n"])
        return F.struct(F.lit(i).alias("fuel_bin"), F.when(count > 0, mean_from_cents(held, count)).alias("mean_price"), count.alias("n"))

    g = g.withColumns({"windows": windows, "fuel_bins": F.when(F.col("f_min").isNotNull(), F.array(*[fuel_bin(i + 1) for i in range(fuel_bins)]))})

    def known(cells: str) -> Column:
        return F.filter(cells, lambda c: c["mean_price"].isNotNull())

    def best(cells: str, order: str, out: str, k: int, falling: bool) -> Column:
        ranked = F.array_sort(F.transform(known(cells), lambda c: F.struct((-c["mean_price"] if falling else c["mean_price"]).alias("m"),
                                                                          c[order].alias("o"), c[out].alias("x"))))
        return F.when(F.size(ranked) > 0, F.transform(F.slice(ranked, 1, k), lambda c: c["x"]))

    def mean_where(holiday: bool) -> Column:
        return F.get(F.filter("holidays", lambda c: c["is_holiday"] == F.lit(holiday)), F.lit(0))["mean_price"]

    means = F.transform(known("monthly"), lambda c: c["mean_price"])
    mh, mn = mean_where(True), mean_where(False)
    fuel_change = F.try_divide(F.col("f_max") - F.col("f_min"), F.col("f_mean"))
    price_change = F.try_divide(F.col("p_max") - F.col("p_min"), F.when(F.col("n") > 0, mean_from_cents(F.col("s"), F.col("n"))))
    return g.select(
        "route", "monthly", "weekly", "windows", "holidays", "seasons", "fuel_bins",
        F.round((F.array_max(means) - F.array_min(means)) / (F.aggregate(means, F.lit(0.0), lambda a, m: a + m) / F.size(means)), 6)
        .alias("seasonal_variation"),
        best("monthly", "month", "month", 3, True).alias("peak_months"), best("monthly", "month", "month", 3, False).alias("off_peak_months"),
        best("weekly", "weekday", "day_of_week", 2, False).alias("cheapest_days"),
        best("weekly", "weekday", "day_of_week", 2, True).alias("most_expensive_days"),
        F.get(best("windows", "band", "booking_window", 1, False), F.lit(0)).alias("optimal_booking_window"),
        F.when(mh.isNotNull() & mn.isNotNull(), F.round((mh - mn) / mn * 100, 6)).otherwise(F.lit(0.0)).alias("holiday_price_increase_pct"),
        F.round(F.try_divide("cov", F.col("p_sd") * F.col("f_sd")), 6).alias("fuel_price_correlation"),
        F.when(F.col("rows") < min_rows, F.lit(0.0)).when(fuel_change.isNull() | (fuel_change == 0), F.lit(0.0))
        .otherwise(F.round(F.try_divide(price_change, fuel_change), 6)).alias("elasticity"))


def route_patterns(df: DataFrame) -> DataFrame:
    """The summaries of ``route_report``, one row per route."""
    return route_report(df).select("route", "seasonal_variation", "peak_months", "off_peak_months", "cheapest_days", "most_expensive_days",
                                   "optimal_booking_window", "holiday_price_increase_pct", "fuel_price_correlation", "elasticity")


# ---------------------------------------------------------------- A10-A14
def overview(df: DataFrame) -> DataFrame:
    """A10: rows, columns, distinct carriers, distinct (from, to) routes."""
    return df.agg(F.count(F.lit(1)).alias("total_records"), F.lit(len(df.columns)).alias("n_columns"),
                  F.countDistinct("airline").alias("airlines"),
                  F.countDistinct("from", "to").alias("routes"))


def price_histogram(df: DataFrame, n_bins: int = 50, price: str = "price") -> DataFrame:
    """Counts in ``n_bins`` equal-width bins (the maximum falls in the last bin).

    The distinct prices are counted and written once; the range (two scalars) and the bins are
    both read from that table.
    """
    df = materialize(df.where(F.col(price).isNotNull()).groupBy(price).agg(F.count(F.lit(1)).alias("cnt")), "price-counts")
    r = df.agg(F.min(price).alias("lo"), F.max(price).alias("hi")).first()
    if r is None or r["lo"] is None:
        return df.sparkSession.createDataFrame([], "bin int, n long, bin_start double")
    lo, hi = float(r["lo"]), float(r["hi"])
    w = (hi - lo) / n_bins
    idx = F.lit(0) if w == 0 else F.least(F.floor((F.col(price) - F.lit(lo)) / F.lit(w)), F.lit(n_bins - 1))
    return (df.groupBy(idx.cast("int").alias("bin")).agg(F.sum("cnt").alias("n"))
            .withColumn("bin_start", F.round(F.lit(lo) + F.col("bin") * F.lit(w), 4)))


def price_quartiles(df: DataFrame, by=("airline",), price: str = "price") -> DataFrame:
    """Box summary per group: min, quartiles (exact), max, all from one value histogram."""
    q = exact_quantiles(df, price, {"min_price": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "max_price": 1.0}, by=list(by))
    return q.select(*by, "min_price", F.round("q1", 4).alias("q1"), F.round("median", 4).alias("median"),
                    F.round("q3", 4).alias("q3"), "max_price")


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pairwise Pearson correlations of ``columns`` in one aggregate, as long rows."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    agg = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"c{i}")
                   for i, (a, b) in enumerate(pairs)])
    rows = F.array(*[F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"), F.col(f"c{i}").alias("c"))
                     for i, (a, b) in enumerate(pairs)])
    ex = agg.select(F.explode(rows).alias("r"))
    return ex.select("r.feature_a", "r.feature_b", F.round(F.col("r.c"), 6).alias("correlation"))


def null_counts(df: DataFrame) -> DataFrame:
    """Nulls per column, only columns with at least one."""
    agg = df.agg(*[F.count_if(F.col(c).isNull()).alias(f"n{i}") for i, c in enumerate(df.columns)])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("nulls"))
                     for i, c in enumerate(df.columns)])
    return agg.select(F.explode(rows).alias("r")).select("r.column", "r.nulls").where(F.col("nulls") > 0)


# ---------------------------------------------------------------- A16-A18, W5
def trend_line(df: DataFrame, x: str, y: str, by=()) -> DataFrame:
    """Least-squares slope, intercept, r^2 and the line ends at min/max x."""
    g = df.groupBy(*by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"),
                            F.regr_r2(y, x).alias("r2"), F.min(x).alias("x_min"), F.max(x).alias("x_max"))
    return g.select(*by, F.round("slope", 6).alias("slope"), F.round("intercept", 4).alias("intercept"),
                    F.round("r2", 6).alias("r2"), "x_min", "x_max",
                    F.round(F.col("slope") * F.col("x_min") + F.col("intercept"), 4).alias("y_at_min"),
                    F.round(F.col("slope") * F.col("x_max") + F.col("intercept"), 4).alias("y_at_max"))


def ensemble_summary(df: DataFrame, pred_cols: list[str]) -> DataFrame:
    """Mean, min, max and half range of the model predictions of each row."""
    cols = [F.col(c) for c in pred_cols]
    mean = sum(cols[1:], cols[0]) / F.lit(float(len(cols)))
    lo, hi = F.least(*cols), F.greatest(*cols)
    return df.withColumns({"ensemble_mean": mean, "ensemble_min": lo, "ensemble_max": hi,
                           "uncertainty": (hi - lo) / F.lit(2.0)})


def first_last_trend(df: DataFrame, by, order_col: str, value: str) -> DataFrame:
    """Last value vs first value in order: increasing / decreasing; one row -> stable."""
    g = df.groupBy(*by).agg(F.min_by(value, order_col).alias("_first"), F.max_by(value, order_col).alias("_last"),
                            F.count(F.lit(1)).alias("_n"))
    return g.select(*by, F.when(F.col("_n") <= 1, "stable").when(F.col("_last") > F.col("_first"), "increasing")
                    .otherwise("decreasing").alias("trend"))


# ---------------------------------------------------------------- W4
def sequence_windows(df: DataFrame, by: list[str], order: list[str], feature_cols: list[str], label: str,
                     length: int = 30, bucket_rows: int = 100_000, persist: bool = True) -> DataFrame:
    """The previous ``length`` rows' features as one example; the label is the current row.

    Rows get their exact position inside the group from range partitions, written with
    their number (no single-task gather). Positions are cut into buckets
    of ``bucket_rows``; the last ``length`` rows of each bucket are copied into
    the next bucket as a halo, so the sliding window runs per (group, bucket)
    and a hot group is spread over many tasks. Rows with fewer than
    ``length`` predecessors are dropped. With ``persist`` the input is written
    once to the shared checkpoint folder, because the range
    sample and the partitioning both read it and must not re-run its plan.
    """
    if not 0 < length <= bucket_rows:
        raise ValueError("length must lie between 1 and bucket_rows: the halo reaches one bucket back")
    key = "_okey"
    # the order columns travel inside the key only
    inside = [c for c in order if c not in by]
    base = df.select(*[c for c in df.columns if c not in inside], F.struct(*[F.col(c) for c in order]).alias(key))

    def col(c: str) -> Column:
        return F.col(key)[c] if c in inside else F.col(c)

    # a null group has no position
    for c in by:
        base = base.where(F.col(c).isNotNull())
    if persist:
        base = materialize(base, "sequence-input")
    keys = [*by, key]
    ranged = materialize(base.repartitionByRange(shuffle_partitions(df), *keys).withColumn("_pid", F.spark_partition_id()), "ranged-sequence")
    # position = rows of the group in earlier ranges + place inside the range
    placed = ranged.withColumn("_at", F.rank().over(Window.partitionBy("_pid", *by).orderBy(key)))
    earlier = Window.partitionBy(*by).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("_pid", *by).agg(F.count(F.lit(1)).alias("_tot")).select(
        "_pid", *by, F.coalesce(F.sum("_tot").over(earlier), F.lit(0)).alias("_off"))
    pos = placed.join(offsets, ["_pid", *by]).withColumn("_pos", F.col("_off") + F.col("_at") - F.lit(1)).drop("_pid", "_at", "_off")
    b = F.floor(F.col("_pos") / F.lit(bucket_rows)).cast("long")
    halo = (F.col("_pos") % F.lit(bucket_rows)) >= F.lit(bucket_rows - length)
    copies = F.when(halo, F.array(F.struct(b.alias("bucket"), F.lit(False).alias("is_halo")),
                                  F.struct((b + 1).alias("bucket"), F.lit(True).alias("is_halo")))) \
        .otherwise(F.array(F.struct(b.alias("bucket"), F.lit(False).alias("is_halo"))))
    spread = pos.withColumn("_c", F.explode(copies)).select("*", "_c.bucket", "_c.is_halo").drop("_c")
    feat = F.array(*[col(c).cast("double") for c in feature_cols])
    w = Window.partitionBy(*by, "bucket").orderBy("_pos").rowsBetween(-length, -1)
    out = spread.withColumn("sequence", F.collect_list(feat).over(w)).where(~F.col("is_halo"))
    rest = [c for c in df.columns if c not in by]
    return out.where(F.size("sequence") == length).select(*by, *[col(c).alias(c) for c in rest], "_pos", "sequence")


# ---------------------------------------------------------------- K9, K10, U3
def sort_scenarios(df: DataFrame, col: str = "fuel_price") -> DataFrame:
    """K9: scenarios in ascending order."""
    return df.orderBy(col)


def head_sample(df: DataFrame, n: int, key: str = "fare_key") -> DataFrame:
    """A stable sample of ``n`` rows (smallest key hashes); per-partition top-n then merge."""
    return df.orderBy(F.md5(F.col(key).cast("string")), F.col(key)).limit(n)


def distinct_routes(df: DataFrame) -> DataFrame:
    """Distinct (from, to) pairs."""
    return df.select("from", "to").distinct()
