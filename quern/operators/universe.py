"""Choosing instruments: filters, ranks and legs over contracts and daily snapshots."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def expiry_rank(contracts: DataFrame, keys: Sequence[str], expiry: str = "expiry") -> DataFrame:
    """contracts with month_rank: 1 for all of the nearest expiry (front month), 2 for the next, ..."""
    return contracts.withColumn("month_rank", F.dense_rank().over(Window.partitionBy(*keys).orderBy(expiry)))


def front_month(contracts: DataFrame, keys: Sequence[str]) -> DataFrame:
    return expiry_rank(contracts, keys).where("month_rank = 1").drop("month_rank")


def back_months(contracts: DataFrame, keys: Sequence[str], only_next: bool = False) -> DataFrame:
    return expiry_rank(contracts, keys).where("month_rank = 2" if only_next else "month_rank > 1").drop("month_rank")


def expiring_within(contracts: DataFrame, today: str, least: int, most: int, expiry: str = "expiry") -> DataFrame:
    """Contracts that expire from ``least`` to ``most`` days after today, both included."""
    d = F.to_date(F.lit(today))
    return contracts.where(F.col(expiry).between(F.date_add(d, least), F.date_add(d, most)))


def strike_window(contracts: DataFrame, keys: Sequence[str], spot: str, low: int, high: int, strike: str = "strike") -> DataFrame:
    """Contracts whose strike lies within ranks [low, high] of the strike at the money.

    At the money is the first strike at or above spot; if it isn't exactly spot, ranks
    above count one less where the window spans it, and both do where it lies above.
    """
    w = Window.partitionBy(*keys).orderBy(strike)
    ranked = contracts.withColumn("rank", F.dense_rank().over(w) - 1)
    atm = ranked.where(F.col(strike) >= F.col(spot)).groupBy(*keys).agg(F.min("rank").alias("atm"), F.bool_or(F.col(strike) == F.col(spot)).alias("exact"))
    rows = ranked.join(atm, list(keys))
    a, b = F.col("atm") + low, F.col("atm") + high
    if low < 0 < high:
        b = F.when(F.col("exact"), b).otherwise(b - 1)
    elif low > 0:
        a, b = F.when(F.col("exact"), a).otherwise(a - 1), F.when(F.col("exact"), b).otherwise(b - 1)
    return rows.where((F.col("rank") >= a) & (F.col("rank") <= b)).drop("rank", "atm", "exact")


def nearest_strike(contracts: DataFrame, keys: Sequence[str], target: Column, strike: str = "strike", id: str = "id") -> DataFrame:
    """One contract a key: that of the strike nearest to the target; of equals the lowest id."""
    best = contracts.withColumn("_d", F.abs(F.col(strike).cast("double") - target)).withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("_d", id)))
    return best.where("_n = 1").drop("_d", "_n")


def vertical_spread(contracts: DataFrame, keys: Sequence[str], spot: str, lower: float, higher: float, id: str = "id") -> DataFrame:
    """keys, low_strike, high_strike: the lower leg nearest to spot + lower, the higher nearest to spot + higher above it."""
    low = nearest_strike(contracts, keys, F.col(spot).cast("double") + lower, id=id).select(*keys, F.col("strike").alias("low_strike"))
    above = contracts.join(low, list(keys)).where(F.col("strike") > F.col("low_strike"))
    return nearest_strike(above, keys, F.col(spot).cast("double") + higher, id=id).select(*keys, "low_strike", F.col("strike").alias("high_strike"))


def calendar_spread(contracts: DataFrame, keys: Sequence[str], near_days: int, far_days: int, today: str, expiry: str = "expiry") -> DataFrame:
    """keys, near_expiry, far_expiry: the first expiry at least so far off, and the first after it at least so far off."""
    d = F.to_date(F.lit(today))
    near = contracts.where(F.col(expiry) >= F.date_add(d, near_days)).groupBy(*keys).agg(F.min(expiry).alias("near_expiry"))
    far = contracts.join(near, list(keys)).where((F.col(expiry) > F.col("near_expiry")) & (F.col(expiry) >= F.date_add(d, far_days)))
    return far.groupBy(*keys).agg(F.first("near_expiry").alias("near_expiry"), F.min(expiry).alias("far_expiry"))


def top_by(rows: DataFrame, keys: Sequence[str], by: str, n: int, id: str) -> DataFrame:
    """The n rows of each key with the greatest ``by``; of equals the lowest id."""
    w = Window.partitionBy(*keys).orderBy(F.col(by).desc(), id)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def members_diff(members: DataFrame, date: str, member: str) -> DataFrame:
    """date, member, change: who came and who left, against the date before; the first date adds all."""
    dates = members.select(date).distinct()
    w = Window.partitionBy(F.lit(0)).orderBy(date)
    pairs = dates.select(date, F.lag(date).over(w).alias("before"))
    now = members.select(date, member).distinct().join(pairs, date)
    was = members.select(F.col(date).alias("before"), member).distinct()
    came = now.join(was, ["before", member], "left_anti").select(date, member, F.lit("added").alias("change"))
    then = was.join(pairs.where("before IS NOT NULL"), "before")
    left = then.join(members.select(date, member).distinct(), [date, member], "left_anti").select(date, member, F.lit("removed").alias("change"))
    return came.unionByName(left)


def members_only(rows: DataFrame, members: DataFrame, on: Sequence[str]) -> DataFrame:
    return rows.join(members.select(*on), list(on), "left_semi")


def on_dates(members: DataFrame, dates: DataFrame, start: str, end: str) -> DataFrame:
    """Members as of each date of a schedule: rows whose span [start, end) holds it, null ends open."""
    return members.join(dates, (F.col("date") >= F.col(start)) & (F.col("date") < F.coalesce(F.col(end), F.lit("9999-12-31").cast("date"))))


def calendar(dates: DataFrame, rule: str, offset: int = 0) -> DataFrame:
    """Of trading days (date), those that a rule names: every_day, week_start, week_end, month_start, month_end, year_start, year_end.

    ``offset``: so many trading days after the start, or before the end.
    """
    if rule == "every_day":
        return dates
    unit, side = rule.split("_")
    order = F.col("date") if side == "start" else F.col("date").desc()
    w = Window.partitionBy(F.date_trunc(unit, "date")).orderBy(order)
    return dates.withColumn("_n", F.row_number().over(w)).where(F.col("_n") == offset + 1).drop("_n")


def is_standard_expiry(expiry: str) -> Column:
    """Monthly contracts expire on the third Friday; all others are weeklies."""
    return (F.dayofweek(expiry) == 6) & F.dayofmonth(expiry).between(15, 21)


def strategy_legs(contracts: DataFrame, keys: Sequence[str], spot: str, today: str, min_days: int, legs: Sequence[tuple[str, float]], id: str = "id") -> DataFrame:
    """keys, leg, right, expiry, strike, id: for each leg (right, distance from spot) the contract of the nearest strike.

    All legs are of the first expiry at least ``min_days`` off; of equally near strikes
    the lowest id; a key that lacks a leg has none.
    """
    late = contracts.where(F.col("expiry") >= F.date_add(F.to_date(F.lit(today)), min_days))
    first = late.groupBy(*keys).agg(F.min("expiry").alias("expiry"))
    rows = late.join(first, [*keys, "expiry"])
    wanted = F.array(*[F.struct(F.lit(i).alias("leg"), F.lit(r).alias("wanted"), F.lit(float(x)).alias("off")) for i, (r, x) in enumerate(legs)])
    rows = rows.withColumn("l", F.explode(wanted)).where(F.col("right") == F.col("l.wanted"))
    rows = rows.withColumn("leg", F.col("l.leg")).withColumn("target", F.col(spot).cast("double") + F.col("l.off"))
    got = nearest_strike(rows, [*keys, "leg"], F.col("target"), id=id)
    whole = F.count("*").over(Window.partitionBy(*keys)) == len(legs)
    return got.withColumn("whole", whole).where("whole").select(*keys, "leg", "right", "expiry", "strike", id)


def within_ranges(contracts: DataFrame, ranges: Mapping[str, tuple[float | None, float | None]]) -> DataFrame:
    """Contracts whose columns (delta, gamma, vega, theta, rho, implied volatility, open interest and the like) lie in their ranges, ends included.

    None is no bound; a contract without the value is none of the range.
    """
    for c, (low, high) in ranges.items():
        x = F.col(c).cast("double")
        contracts = contracts.where(x.isNotNull() & (F.lit(True) if low is None else x >= low) & (F.lit(True) if high is None else x <= high))
    return contracts


def expiration_cycle(contracts: DataFrame, months: Sequence[int]) -> DataFrame:
    """Contracts that expire in one of these months."""
    return contracts.where(F.month("expiry").isin(*months))


def constituent_weights(members: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """Members with weight: their share of their group's value; null where the group has none.

    The sums are combined before the shuffle and joined back, so a large group is no one task.
    """
    sums = members.groupBy(*group).agg(F.sum(F.col(value).cast("double")).alias("_all"))
    return members.join(sums, list(group), "left").withColumn("weight", F.try_divide(F.col(value).cast("double"), F.nullif(F.col("_all"), F.lit(0.0)))).drop("_all")
