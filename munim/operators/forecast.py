"""Next-month spend per category.

Every model is an aggregate over the monthly series of a (statement, category):
no Python workers, no per-category fitting loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from munim.functions import money
from munim.functions.dates import month_start
from munim.operators.aggregates import KEY, fill_months, monthly_totals, only
from munim.operators.rollup import month_rollup, rupees

#: Fewer months than this and the mean charge is used instead of a trend.
MIN_MONTHS = 3
#: Least months of the model with a moving-average term.
ARMA_MONTHS = 8
#: Half-widths of an 80 % and a 95 % interval, in deviations.
Z80, Z95 = 1.2816, 1.96

FORECAST_COLUMNS = [
    "predicted_amount", "lower_bound", "upper_bound", "trend", "historical_avg", "method",
]


def category_series(df: DataFrame) -> DataFrame:
    """(statement, category, ds, y) without missing months."""
    return category_series_of(month_rollup(df))


def category_series_of(rollup: DataFrame) -> DataFrame:
    """(statement, category, ds, y, charges, n_amount): spend of each month, and its charges' sizes."""
    sums = only(rollup, "debit").select(
        KEY, "category", F.col("month").alias("ds"), F.abs(rupees(F.col("amount"))).alias("y"),
        "charges", "n_amount")
    return fill_months(sums, [KEY, "category"], ("y", "charges", "n_amount"))


def trend_label(change: Column, average: Column) -> Column:
    """Direction of a change, stable within 1 % of the average."""
    return (
        F.when(change > 0.01 * average, "increasing")
        .when(change < -0.01 * average, "decreasing")
        .otherwise("stable")
    )


def _record(predicted: Column, lower: Column, upper: Column, trend, average: Column, method: str):
    bounded = lambda c: money.round_even(F.greatest(c, F.lit(0.0)), 2)
    return [
        bounded(predicted).alias("predicted_amount"), bounded(lower).alias("lower_bound"),
        bounded(upper).alias("upper_bound"),
        (trend if isinstance(trend, Column) else F.lit(trend)).alias("trend"),
        money.round_even(average, 2).alias("historical_avg"), F.lit(method).alias("method"),
    ]


def simple_forecast(df: DataFrame) -> DataFrame:
    """Mean charge plus 5 %, bounds 15 % either side; for short histories."""
    stats = category_series(df).groupBy(KEY, "category").agg(
        F.count(F.lit(1)).alias("_months"), _mean_charge().alias("_mean"))
    return stats.where(F.col("_months") < MIN_MONTHS).select(KEY, "category", *_simple(F.col("_mean")))


def _mean_charge() -> Column:
    return money.ratio(rupees(F.sum("charges")), F.sum("n_amount"))


def _simple(mean: Column) -> list[Column]:
    guess = mean * 1.05
    return _record(guess, guess * 0.85, guess * 1.15, "stable", mean, "simple_average")


def _by_length(months: Column, short: list[Column], long: list[Column]) -> list[Column]:
    """``short`` for histories under ``MIN_MONTHS``, else ``long``: both from one aggregate."""
    return [F.when(months < MIN_MONTHS, a).otherwise(b).alias(name)
            for a, b, name in zip(short, long, FORECAST_COLUMNS)]


def _month_index(day: Column) -> Column:
    """Months since 2000."""
    return ((F.year(day) - 2000) * 12 + F.month(day)).cast("bigint")


def _wide(value: Column) -> Column:
    """Integer wide enough that products of two are summed exactly."""
    return value.cast("decimal(19,0)")


def trend_forecast(series: DataFrame, periods: int = 1) -> DataFrame:
    """Least-squares line through the monthly series with an 80 % prediction interval.

    The sums are taken over whole paise and whole months, so they are exact and the
    result does not depend on how the rows were partitioned.
    """
    return _trend(series, periods).where(F.col("_n") >= MIN_MONTHS).drop("_n")


def _trend(series: DataFrame, periods: int) -> DataFrame:
    """Forecast of every history, and its months (_n); short ones by the mean charge if known."""
    known = "charges" in series.columns
    x, y = _month_index(F.col("ds")), money.paise(F.col("y"))
    sums = series.groupBy(KEY, "category").agg(
        F.count(F.lit(1)).cast("double").alias("_n"), F.max(x).cast("double").alias("_last"),
        F.sum(x).cast("double").alias("_x"), F.sum(x * x).cast("double").alias("_xx"),
        F.sum(y).cast("double").alias("_y"), F.sum(x * y).cast("double").alias("_xy"),
        F.sum(_wide(y) * _wide(y)).cast("double").alias("_yy"),
        (_mean_charge() if known else F.lit(None).cast("double")).alias("_mean"),
    )
    n, sx, sy = F.col("_n"), F.col("_x"), F.col("_y")
    fit = sums.select(
        KEY, "category", n.alias("n"), "_mean", (sy / n / 100).alias("avg"),
        (n * F.col("_xx") - sx * sx).alias("dxx"), (n * F.col("_xy") - sx * sy).alias("dxy"),
        (n * F.col("_yy") - sy * sy).alias("dyy"), (n * (F.col("_last") + periods) - sx).alias("ahead"),
    )
    n, avg, dxx, dxy = F.col("n"), F.col("avg"), F.col("dxx"), F.col("dxy")
    ahead = F.col("ahead")
    dxx, free = F.nullif(dxx, F.lit(0.0)), F.nullif(n - 2, F.lit(0.0))
    predicted = avg + dxy * ahead / (n * dxx) / 100
    residual = F.greatest(F.col("dyy") - dxy * dxy / dxx, F.lit(0.0)) / n / 10000
    half = Z80 * F.sqrt(residual / free) * F.sqrt(1 + 1 / n + ahead * ahead / (n * dxx))
    long = _record(predicted, predicted - half, predicted + half,
                   trend_label(dxy / dxx / 100, avg), avg, "linear_trend")
    return fit.select(KEY, "category", *_by_length(n, _simple(F.col("_mean")), long), n.alias("_n"))


def ar1_forecast(series: DataFrame) -> DataFrame:
    """ARIMA(1,1,0) by conditional least squares with a 95 % interval."""
    return _ar1(series).where(F.col("_n") >= MIN_MONTHS).drop("_n")


def _ar1(series: DataFrame) -> DataFrame:
    """Forecast of every history, and its months (_n); short ones by the mean charge if known."""
    known = "charges" in series.columns
    w = W.partitionBy(KEY, "category").orderBy("ds")
    steps = series.withColumn("_y", money.paise(F.col("y")))
    steps = steps.withColumn("_d", F.col("_y") - F.lag("_y").over(w))
    steps = steps.withColumn("_p", F.lag("_d").over(w))
    at_last = lambda c: F.max_by(c, "ds").cast("double")
    product = lambda a, b: F.sum(_wide(F.col(a)) * _wide(F.col(b))).cast("double")
    fit = steps.groupBy(KEY, "category").agg(
        F.count(F.lit(1)).alias("_n"), F.sum("_y").cast("double").alias("_sum"),
        at_last("_y").alias("_y"), at_last("_d").alias("_d"), product("_d", "_p").alias("_dp"),
        product("_p", "_p").alias("_pp"),
        F.sum(F.when(F.col("_p").isNotNull(), _wide(F.col("_d")) * _wide(F.col("_d"))))
        .cast("double").alias("_dd"),
        F.count("_p").alias("_k"),
        (_mean_charge() if known else F.lit(None).cast("double")).alias("_mean"),
    )
    avg = F.col("_sum") / F.col("_n") / 100
    phi = money.ratio(F.col("_dp"), F.col("_pp"), 0.0)
    predicted = (F.col("_y") + phi * F.col("_d")) / 100
    sse = F.greatest(F.col("_dd") - phi * F.col("_dp"), F.lit(0.0))
    half = Z95 * F.sqrt(sse / F.nullif("_k", F.lit(0))) / 100
    long = _record(predicted, predicted - half, predicted + half,
                   trend_label(F.col("_d") / 100, avg), avg, "ar1")
    return fit.select(KEY, "category", *_by_length(F.col("_n"), _simple(F.col("_mean")), long), "_n")


def _solve2(aa: Column, ab: Column, bb: Column, ay: Column, by: Column) -> tuple[Column, Column]:
    """Least-squares weights of two regressors; of the first alone where both are dependent."""
    det = aa * bb - ab * ab
    sound = det > 1e-9 * aa * bb
    return (F.when(sound, (ay * bb - by * ab) / det).otherwise(money.ratio(ay, aa, 0.0)),
            F.when(sound, (by * aa - ay * ab) / det).otherwise(F.lit(0.0)))


def arma_forecast(series: DataFrame) -> DataFrame:
    """ARIMA(1,1,1) by two regressions (Hannan and Rissanen) with a 95 % interval.

    A regression of the monthly differences on the two before gives their shocks, in whole paise;
    one on the difference and the shock before gives the weights, each kept within 0.99.  Sums are
    over integers, hence exact.  Histories of at least ``ARMA_MONTHS`` months only.
    """
    w = W.partitionBy(KEY, "category").orderBy("ds")
    every = W.partitionBy(KEY, "category")
    steps = series.withColumn("_y", money.paise(F.col("y")))
    steps = steps.withColumn("_d", F.col("_y") - F.lag("_y").over(w))
    steps = steps.withColumns({"_p": F.lag("_d").over(w), "_q": F.lag("_d", 2).over(w)})
    pair = lambda a, b: _wide(F.col(a)) * _wide(F.col(b))
    known = F.col("_q").isNotNull()
    over = lambda a, b: F.sum(F.when(known, pair(a, b))).over(every).cast("double")
    steps = steps.withColumns({f"_{a}{b}": over(f"_{a}", f"_{b}") for a, b in ("pp", "pq", "qq", "dp", "dq")})
    first, second = _solve2(*[F.col(c) for c in ("_pp", "_pq", "_qq", "_dp", "_dq")])
    shock = F.floor(F.col("_d") - first * F.col("_p") - second * F.col("_q") + 0.5).cast("bigint")
    steps = steps.withColumn("_e", shock).withColumn("_f", F.lag("_e").over(w))
    usable = F.col("_f").isNotNull()
    product = lambda a, b: F.coalesce(F.sum(F.when(usable, pair(a, b))).cast("double"), F.lit(0.0))
    at_last = lambda c: F.max_by(c, "ds").cast("double")
    fit = steps.groupBy(KEY, "category").agg(
        F.count(F.lit(1)).alias("_n"), F.sum("_y").cast("double").alias("_sum"),
        at_last("_y").alias("_y"), at_last("_d").alias("_d"), at_last("_e").alias("_e"),
        F.count("_f").alias("_k"), product("_p", "_p").alias("_pp"), product("_p", "_f").alias("_pf"),
        product("_f", "_f").alias("_ff"), product("_d", "_p").alias("_dp"),
        product("_d", "_f").alias("_df"), product("_d", "_d").alias("_dd"),
    ).where(F.col("_n") >= ARMA_MONTHS)
    phi, theta = _solve2(*[F.col(c) for c in ("_pp", "_pf", "_ff", "_dp", "_df")])
    inside = lambda c: F.greatest(F.lit(-0.99), F.least(F.lit(0.99), c))
    fit = fit.withColumns({"_phi": inside(phi), "_theta": inside(theta)})
    a, b = F.col("_phi"), F.col("_theta")
    avg = F.col("_sum") / F.col("_n") / 100
    predicted = (F.col("_y") + a * F.col("_d") + b * F.col("_e")) / 100
    sse = F.greatest(
        F.col("_dd") - 2 * a * F.col("_dp") - 2 * b * F.col("_df") + a * a * F.col("_pp")
        + 2 * a * b * F.col("_pf") + b * b * F.col("_ff"), F.lit(0.0))
    half = Z95 * F.sqrt(sse / F.col("_k")) / 100
    return fit.select(
        KEY, "category",
        *_record(predicted, predicted - half, predicted + half,
                 trend_label(F.col("_d") / 100, avg), avg, "arma"))


def forecast(df: DataFrame, periods: int = 1, method: str = "trend") -> DataFrame:
    """Forecast of every (statement, category), from one read of the transactions."""
    return forecast_of(month_rollup(df), periods, method)


def forecast_of(rollup: DataFrame, periods: int = 1, method: str = "trend") -> DataFrame:
    """Forecasts from a roll-up: ``trend``, ``ar1`` or ``arma``, simple mean for short histories.

    ``arma`` leaves histories under ``ARMA_MONTHS`` months to ``ar1``.
    """
    series = category_series_of(rollup)
    if method == "trend":
        return _trend(series, periods).drop("_n")
    short = _ar1(series)
    if method == "ar1":
        return short.drop("_n")
    return arma_forecast(series).unionByName(short.where(F.col("_n") < ARMA_MONTHS).drop("_n"))


def forecast_summary(forecasts: DataFrame) -> DataFrame:
    """Forecasts beside their change against the historical mean."""
    change = (F.col("predicted_amount") - F.col("historical_avg")) / F.col("historical_avg") * 100
    return forecasts.select(
        KEY, "category", F.col("predicted_amount").alias("next_month_forecast"), "lower_bound",
        "upper_bound",
        F.when(F.col("historical_avg") != 0, money.round_even(change, 2)).otherwise(F.lit(0.0))
        .alias("vs_last_month_pct_change"),
        F.col("trend").alias("trend_direction"),
    )


def forecast_total(forecasts: DataFrame) -> DataFrame:
    """Forecast, lower and upper bound of a whole statement."""
    return forecasts.groupBy(KEY).agg(
        money.total(F.col("predicted_amount")).alias("total_forecast"),
        money.total(F.col("lower_bound")).alias("total_lower"),
        money.total(F.col("upper_bound")).alias("total_upper"),
    )


def forecast_cards(df: DataFrame, totals: DataFrame) -> DataFrame:
    """Total forecast against the last month's actual spend, with a confidence of 60 to 98."""
    last = monthly_totals(df).groupBy(KEY).agg(
        F.max_by("total", "month").alias("last_actual"), F.max("month").alias("_month")
    )
    gap = F.col("total_forecast") - F.col("last_actual")
    confidence = (100 - F.abs(gap) / F.greatest("last_actual", F.lit(1.0)) * 50).cast("int")
    return totals.join(last, KEY).select(
        KEY, "total_forecast", "total_lower", "total_upper", "last_actual",
        money.ratio(gap * 100, F.col("last_actual"), 0.0).alias("vs_last_pct"),
        F.greatest(F.lit(60), F.least(F.lit(98), confidence)).alias("confidence_pct"),
        F.date_format(F.add_months("_month", 1), "MMM yyyy").alias("next_month"),
    )


def forecast_vs_actual(df: DataFrame, summary: DataFrame) -> DataFrame:
    """Forecast table with the category's spend in the statement's last month."""
    per_month = only(df, "debit").groupBy(
        KEY, "category", month_start(F.col("date")).alias("_m")
    ).agg(money.total(F.col("debit")).alias("_spent"))
    last = per_month.groupBy(KEY).agg(F.max("_m").alias("_m"))
    actual = per_month.join(last, [KEY, "_m"]).select(KEY, "category", F.col("_spent").alias("last_actual"))
    return summary.join(actual, [KEY, "category"], "left").withColumn(
        "last_actual", F.coalesce("last_actual", F.lit(0.0)))
