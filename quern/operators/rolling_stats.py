"""Rolling and whole-series statistics: windows, drawdowns, streaks, performance."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Trading days of a year, and the one-sided normal quantiles of 95 and 99 %.  Fixed values.
YEAR = 252
Z95, Z99 = -1.6448536269514722, -2.3263478740408408


def over(keys: Sequence[str], order: Sequence[str]) -> Window:
    return Window.partitionBy(*keys).orderBy(*order)


def moving_average(value: str, n: int, w: Window) -> Column:
    """Mean of the last n values, this one included; null until there are n."""
    frame = w.rowsBetween(-(n - 1), 0)
    return F.when(F.count(value).over(frame) >= n, F.avg(value).over(frame))


def percent_change(value: str, w: Window) -> Column:
    return F.try_divide(F.col(value).cast("double"), F.nullif(F.lag(value).over(w).cast("double"), F.lit(0.0))) - 1


def rolling_volatility(ret: str, n: int, w: Window) -> Column:
    """Sample deviation of the last n returns, by the year; 0 while there are fewer than two."""
    frame = w.rowsBetween(-(n - 1), 0)
    return F.when(F.count(ret).over(frame) < 2, 0.0).otherwise(F.stddev_samp(ret).over(frame) * math.sqrt(YEAR))


def relative_deviation(value: str, n: int, w: Window) -> Column:
    frame = w.rowsBetween(-(n - 1), 0)
    return F.try_divide(F.stddev_samp(value).over(frame), F.nullif(F.avg(value).over(frame), F.lit(0.0)))


def history(fields: Sequence[str], n: int, w: Window) -> Column:
    """The n rows before this one as an array of structs, oldest first."""
    return F.collect_list(F.struct(*fields)).over(w.rowsBetween(-n, -1))


def drawdowns(curve: DataFrame, value: str, keys: Sequence[str], order: str) -> DataFrame:
    """curve with peak, drawdown (share below the peak) and peak_at (when the peak was last held)."""
    w = over(keys, [order]).rowsBetween(Window.unboundedPreceding, 0)
    out = curve.withColumn("peak", F.max(value).over(w))
    out = out.withColumn("drawdown", F.try_divide((F.col("peak") - F.col(value)).cast("double"), F.col("peak").cast("double")))
    return out.withColumn("peak_at", F.last(F.when(F.col(value) == F.col("peak"), F.col(order)), True).over(w))


def drawdown_metrics(curve: DataFrame, value: str, keys: Sequence[str], order: str, places: int = 2) -> DataFrame:
    """keys, max_drawdown (a share, rounded halves to even) and max_recovery_days: the longest time from a peak, left for less, until it is reached again.

    ``order`` is a date.  A curve of one point has neither; a drawdown that has not
    recovered has no time.
    """
    w = over(keys, [order])
    rows = drawdowns(curve, value, keys, order)
    was = {c: F.lag(c).over(w) for c in ("drawdown", "peak", "peak_at")}
    back = (was["drawdown"] > 0) & (F.col(value) >= was["peak"])
    rows = rows.withColumn("recovery", F.when(back, F.date_diff(F.col(order), was["peak_at"])))
    return rows.groupBy(*keys).agg(F.coalesce(F.bround(F.max("drawdown"), places), F.lit(0.0)).alias("max_drawdown"), F.coalesce(F.max("recovery"), F.lit(0)).alias("max_recovery_days"))


def compound_annual(start: Column, final: Column, years: Column) -> Column:
    """Yearly growth from a starting to a final amount; 0 without years or a start."""
    growth = F.pow(F.try_divide(final.cast("double"), F.nullif(start.cast("double"), F.lit(0.0))), F.try_divide(F.lit(1.0), F.nullif(years.cast("double"), F.lit(0.0)))) - 1
    return F.when(F.isnan(growth), 0.0).otherwise(F.coalesce(growth, F.lit(0.0)))


def aligned_returns(own: DataFrame, benchmark: DataFrame, keys: Sequence[str], order: str, ret: str, bench: str, skip: int = 1) -> DataFrame:
    """Returns of the dates that both have, without the first ``skip``, which only start the series."""
    both = own.select(*keys, order, ret).join(benchmark.select(*keys, order, bench), [*keys, order])
    return both.withColumn("_n", F.row_number().over(over(keys, [order]))).where(F.col("_n") > skip).drop("_n")


def streaks(rows: DataFrame, flag: Column, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Runs of rows with the same flag: keys, island, flag, length (gaps and islands)."""
    w = over(keys, order)
    marked = rows.withColumn("flag", flag)
    change = F.coalesce((F.col("flag") != F.lag("flag").over(w)).cast("int"), F.lit(1))
    return marked.withColumn("c", change).withColumn("island", F.sum("c").over(w)).groupBy(*keys, "island").agg(F.first("flag").alias("flag"), F.count("*").alias("length"), F.min(order[0]).alias("first"), F.max(order[0]).alias("last"))


def upper_median(value: str) -> Column:
    """The middle value, of two the greater."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {value} DESC)")


def performance(ret: str, rate: float = 0.0) -> list[Column]:
    """Yearly performance, variance, deviation, downside deviation, Sharpe and Sortino of daily returns."""
    mean, var = F.avg(ret), F.coalesce(F.var_samp(ret), F.lit(0.0)) * YEAR
    down = F.sqrt(F.coalesce(F.var_samp(F.when(F.col(ret) < 0, F.col(ret))), F.lit(0.0)) * YEAR)
    annual = F.pow(mean + 1, F.lit(YEAR)) - 1
    safe = lambda a, b: F.coalesce(F.try_divide(a, F.nullif(b, F.lit(0.0))), F.lit(0.0))
    return [annual.alias("annual_return"), var.alias("annual_variance"), F.sqrt(var).alias("annual_deviation"), down.alias("downside_deviation"), safe(annual - rate, F.sqrt(var)).alias("sharpe"), safe(annual - rate, down).alias("sortino")]


def value_at_risk(ret: str, z: float) -> Column:
    """Parametric: mean plus z deviations."""
    return F.avg(ret) + F.lit(z) * F.coalesce(F.stddev_samp(ret), F.lit(0.0))


def against_benchmark(ret: str, bench: str, rate: float = 0.0) -> list[Column]:
    """beta, alpha, tracking error, information and Treynor ratio of daily returns."""
    beta = F.coalesce(F.try_divide(F.covar_samp(ret, bench), F.nullif(F.var_samp(bench), F.lit(0.0))), F.lit(0.0))
    annual, market = F.pow(F.avg(ret) + 1, F.lit(YEAR)) - 1, F.pow(F.avg(bench) + 1, F.lit(YEAR)) - 1
    error = F.sqrt(F.coalesce(F.var_samp(F.col(ret) - F.col(bench)), F.lit(0.0)) * YEAR)
    safe = lambda a, b: F.coalesce(F.try_divide(a, F.nullif(b, F.lit(0.0))), F.lit(0.0))
    return [beta.alias("beta"), (annual - (rate + beta * (market - rate))).alias("alpha"), error.alias("tracking_error"), safe(annual - market, error).alias("information_ratio"), safe(annual - rate, beta).alias("treynor")]


def normal_cdf(x: Column) -> Column:
    """Standard normal distribution function by a rational approximation of erf (error below 1.5e-7)."""
    z = F.abs(x) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * z)
    # Coefficients of the approximation.  Fixed values.
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    erf = 1 - poly * F.exp(-z * z)
    return F.when(x >= 0, (1 + erf) / 2).otherwise((1 - erf) / 2)


def probabilistic_sharpe(rows: DataFrame, ret: str, keys: Sequence[str], benchmark: float = 0.0) -> DataFrame:
    """Likelihood that the true Sharpe ratio (a day) exceeds the benchmark, with sample skewness and kurtosis."""
    g = rows.groupBy(*keys).agg(F.count(ret).alias("n"), F.avg(ret).alias("m"), F.stddev_samp(ret).alias("s"), F.skewness(ret).alias("g1"), F.kurtosis(ret).alias("g2"))
    n = F.col("n").cast("double")
    sharpe = F.try_divide(F.col("m"), F.nullif(F.col("s"), F.lit(0.0)))
    skew = F.col("g1") * F.sqrt(n * (n - 1)) / (n - 2)
    kurt = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("g2") + 6)
    under = 1 - skew * sharpe + (kurt + 2) / 4 * sharpe * sharpe
    z = (sharpe - benchmark) * F.sqrt(n - 1) / F.sqrt(under)
    return g.where((F.col("n") > 3) & (F.col("s") > 0)).select(*keys, "n", sharpe.alias("sharpe"), F.when(under > 0, normal_cdf(z)).alias("probability"))


def trade_statistics(trades: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Measures of closed trades (pnl, us_held): counts, totals, means, medians, streaks and ratios."""
    win, loss = F.col("pnl") > 0, F.col("pnl") < 0
    amount = lambda c: F.coalesce(F.sum(F.when(c, F.col("pnl"))), F.lit(0)).cast("double")
    safe = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), F.nullif(b.cast("double"), F.lit(0.0))), F.lit(0.0))
    base = trades.groupBy(*keys).agg(
        F.count("*").alias("n_trades"), F.count_if(win).alias("n_wins"), F.count_if(loss).alias("n_losses"), F.sum("pnl").cast("double").alias("total"), amount(win).alias("profit"), amount(loss).alias("loss"),
        F.coalesce(F.max(F.when(win, F.col("pnl"))), F.lit(0)).cast("double").alias("largest_profit"), F.coalesce(F.min(F.when(loss, F.col("pnl"))), F.lit(0)).cast("double").alias("largest_loss"), upper_median("us_held").alias("median_held"),
        F.stddev_samp("pnl").alias("deviation"), safe(F.count_if(win), F.count("*")).alias("win_rate"), safe(F.count_if(loss), F.count("*")).alias("loss_rate"),
        safe(amount(win), -amount(loss)).alias("profit_factor"),
    )
    runs = streaks(trades.where(win | loss), win, keys, order).groupBy(*keys).agg(F.coalesce(F.max(F.when(F.col("flag"), F.col("length"))), F.lit(0)).alias("longest_wins"), F.coalesce(F.max(F.when(~F.col("flag"), F.col("length"))), F.lit(0)).alias("longest_losses"))
    return base.join(runs, list(keys), "left").fillna(0, ["longest_wins", "longest_losses"])


def trade_report(trades: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """All measures of closed trades, one row for each key.

    ``trades``: entry_us, exit_us, pnl and, where they are known, mae, mfe (in money),
    end_drawdown, fees and is_win (a loss that counts as won, such as an option in the
    money); ``order``: the order of closing, without ties.  A trade without gain is lost.
    Ratios against nothing lost are 10, against nothing at all 0.
    """
    k = list(keys)
    have = lambda c, kind="double": F.coalesce(F.col(c).cast(kind), F.lit(0).cast(kind)) if c in trades.columns else F.lit(0).cast(kind)
    won = (F.col("pnl") > 0) | (F.coalesce(F.col("is_win"), F.lit(False)) if "is_win" in trades.columns else F.lit(False))
    rows = trades.select(*k, *[c for c in order if c not in k], "entry_us", "exit_us", F.col("pnl").cast("decimal(28,8)").alias("pnl"), have("mae").alias("mae"), have("mfe").alias("mfe"), have("end_drawdown").alias("end_drawdown"), have("fees").alias("fees"), won.alias("won"), (F.col("pnl") > 0).alias("gain"), (F.col("exit_us") - F.col("entry_us")).alias("held"))
    w = over(k, order)
    upto, past = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("after", F.sum("pnl").over(upto).cast("double")).withColumn("before", F.col("after") - F.col("pnl").cast("double"))
    rows = rows.withColumns({"top": F.greatest(F.lit(0.0), F.max("after").over(upto)), "past_top": F.greatest(F.lit(0.0), F.coalesce(F.max("after").over(past), F.lit(0.0))), "open_top": F.greatest(F.lit(0.0), F.max(F.col("before") + F.col("mfe")).over(upto)), "lost": F.sum(F.when(F.col("gain"), 0).otherwise(1)).over(upto), "first_us": F.first("entry_us").over(upto)})
    rows = rows.withColumn("high", F.col("gain") & (F.col("after") > F.col("past_top")))
    since = {c: F.last(F.when(F.col("high"), F.col(c)), True).over(past) for c in ("exit_us", "lost")}
    rows = rows.withColumn("under", F.when(F.col("high") & (F.col("lost") > F.coalesce(since["lost"], F.lit(0))), F.col("exit_us") - F.coalesce(since["exit_us"], F.col("first_us"))))
    safe = lambda a, b: F.coalesce(F.try_divide(a, F.nullif(b, F.lit(0.0))), F.lit(0.0))
    gain, loss = F.col("gain"), ~F.col("gain")
    money = lambda c: F.coalesce(F.sum(F.when(c, F.col("pnl"))).cast("double"), F.lit(0.0))
    mean = lambda c, x="pnl": F.coalesce(F.avg(F.when(c, F.col(x).cast("double"))), F.lit(0.0))
    middle = lambda c: F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY held DESC) FILTER (WHERE {c})")
    deviation = lambda c: F.coalesce(F.stddev_samp(F.when(c, F.col("pnl").cast("double"))), F.lit(0.0))
    g = rows.groupBy(*k).agg(
        F.min("entry_us").alias("start_us"), F.max("exit_us").alias("end_us"), F.count("*").alias("n_trades"), F.count_if("won").alias("n_wins"), F.sum("pnl").cast("double").alias("total"), money(gain).alias("profit"), money(loss).alias("loss"),
        F.coalesce(F.max(F.when(gain, F.col("pnl"))).cast("double"), F.lit(0.0)).alias("largest_profit"), F.least(F.lit(0.0), F.min("pnl").cast("double")).alias("largest_loss"),
        F.avg(F.col("pnl").cast("double")).alias("mean_pnl"), mean(gain).alias("mean_profit"), mean(loss).alias("mean_loss"), F.avg("held").alias("mean_held"), mean(gain, "held").alias("mean_win_held"), mean(loss, "held").alias("mean_loss_held"),
        middle("true").alias("median_held"), middle("gain").alias("median_win_held"), middle("NOT gain").alias("median_loss_held"),
        F.avg("mae").alias("mean_mae"), F.avg("mfe").alias("mean_mfe"), F.least(F.lit(0.0), F.min("mae")).alias("largest_mae"), F.greatest(F.lit(0.0), F.max("mfe")).alias("largest_mfe"),
        F.least(F.lit(0.0), F.min(F.when(loss, F.col("after") - F.col("top")))).alias("max_closed_drawdown"), F.least(F.lit(0.0), F.min(F.col("before") + F.col("mae") - F.col("open_top"))).alias("max_intra_drawdown"),
        deviation(F.lit(True)).alias("deviation"), deviation(loss).alias("downside_deviation"), F.greatest(F.lit(0.0), F.max("end_drawdown")).alias("max_end_drawdown"), F.coalesce(F.max("under"), F.lit(0)).alias("max_drawdown_us"), F.sum("fees").alias("fees"),
    )
    runs = streaks(rows, F.col("won"), k, order).groupBy(*k).agg(F.coalesce(F.max(F.when(F.col("flag"), F.col("length"))), F.lit(0)).alias("longest_wins"), F.coalesce(F.max(F.when(~F.col("flag"), F.col("length"))), F.lit(0)).alias("longest_losses"))
    g = g.withColumn("n_losses", F.col("n_trades") - F.col("n_wins")).join(runs, k)
    over_loss = lambda a, b: F.when(a == 0, 0.0).when(b < 0, a / F.abs(b)).otherwise(10.0)
    return g.withColumns({
        "profit_loss_ratio": safe(F.col("mean_profit"), F.abs("mean_loss")), "win_loss_ratio": F.when(F.col("n_losses") > 0, F.col("n_wins") / F.col("n_losses")).otherwise(10.0), "win_rate": F.col("n_wins") / F.col("n_trades"), "loss_rate": 1 - F.col("n_wins") / F.col("n_trades"),
        "profit_factor": over_loss(F.col("profit"), F.col("loss")), "sharpe": safe(F.col("mean_pnl"), F.col("deviation")), "sortino": safe(F.col("mean_pnl"), F.col("downside_deviation")), "profit_to_drawdown": over_loss(F.col("total"), F.col("max_closed_drawdown")), "mean_end_drawdown": F.col("mean_pnl") - F.col("mean_mfe"),
    })


def expectancy(trades: DataFrame, keys: Sequence[str], order: Sequence[str], capital: float) -> DataFrame:
    """Mean win and loss rates against the capital of the moment, and what a trade yields on average."""
    w = over(keys, order).rowsBetween(Window.unboundedPreceding, -1)
    rows = trades.withColumn("rate", F.col("pnl").cast("double") / (capital + F.coalesce(F.sum("pnl").over(w).cast("double"), F.lit(0.0))))
    win, loss = F.col("pnl") > 0, F.col("pnl") < 0
    out = rows.groupBy(*keys).agg(F.coalesce(F.avg(F.when(win, F.col("rate"))), F.lit(0.0)).alias("mean_win"), F.coalesce(F.avg(F.when(loss, F.col("rate"))), F.lit(0.0)).alias("mean_loss"), F.avg(win.cast("double")).alias("win_rate"), F.avg(loss.cast("double")).alias("loss_rate"))
    ratio = F.coalesce(F.try_divide(F.col("mean_win"), F.nullif(F.abs("mean_loss"), F.lit(0.0))), F.lit(0.0))
    return out.withColumn("expectancy", F.col("win_rate") * ratio - F.col("loss_rate"))


def drawdown_percent(value: Column, high: Column) -> Column:
    """How far below the high, in percent with two places (halves to even); 0 without a high."""
    return F.coalesce(F.bround((1 - F.try_divide(value.cast("double"), F.nullif(high.cast("double"), F.lit(0.0)))) * 100, 2), F.lit(0.0))


def parameter_grid(spark, steps: Mapping[str, tuple[float, float, float]]) -> DataFrame:
    """All combinations of parameters, each from (first, last, step)."""
    out = None
    for name, (first, last, step) in steps.items():
        one = spark.range(int((last - first) / step + 1e-9) + 1).select((F.lit(first) + F.col("id") * step).alias(name))
        out = one if out is None else out.join(one)
    return out


def best_result(results: DataFrame, target: str, constraints: Mapping[str, tuple[str, float]], largest: bool = True, column: str = "result") -> DataFrame:
    """The row whose JSON result has the best target and meets all constraints (path: (operator, bound))."""
    value = lambda path: F.get_json_object(column, path).cast("double")
    rows = results.withColumn("_t", value(target)).where(F.col("_t").isNotNull())
    for path, (op, bound) in constraints.items():
        x = value(path)
        rows = rows.where({"<": x < bound, "<=": x <= bound, ">": x > bound, ">=": x >= bound, "==": x == bound, "!=": x != bound}[op])
    return rows.orderBy(F.col("_t").desc() if largest else F.col("_t")).limit(1).drop("_t")
