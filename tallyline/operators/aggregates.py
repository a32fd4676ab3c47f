"""Grouped results: segments, calibration, profiles, sweeps and ledger totals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyline.operators.quantiles import quantiles


def measures() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("n"),
        F.sum("won").alias("wins"),
        F.round(F.avg("won"), 6).alias("win_rate"),
        F.round(F.sum("stake"), 4).alias("staked"),
        F.round(F.sum("profit"), 4).alias("profit"),
        F.round(F.try_divide(F.sum("profit"), F.sum("stake")), 6).alias("roi"),
    ]


def segments(bets: DataFrame, columns: list[str]) -> DataFrame:
    """The measures of each value of each column, in one pass over grouping sets."""
    sets = bets.groupingSets([[F.col(c)] for c in columns], *(F.col(c) for c in columns)).agg(*measures(), F.grouping_id().alias("_g"))
    name = reduce(lambda out, i: F.when(F.col("_g").bitwiseAND(1 << (len(columns) - 1 - i)) == 0, columns[i]).otherwise(out), range(len(columns)), F.lit(None))
    value = reduce(lambda out, c: F.when(F.col("segment") == c, F.col(c).cast("string")).otherwise(out), columns, F.lit(None).cast("string"))
    return sets.withColumn("segment", name).withColumn("value", value).drop("_g", *columns)


def by_period(bets: DataFrame, unit: str) -> DataFrame:
    return bets.groupBy(F.date_trunc(unit, "date").cast("date").alias("period")).agg(*measures())


def profitable_periods(bets: DataFrame, unit: str) -> DataFrame:
    """Periods, and those of them with a profit."""
    return by_period(bets, unit).agg(F.count(F.lit(1)).alias("periods"), F.sum((F.col("profit") > 0).cast("int")).alias("profitable"))


def cumulated(periods: DataFrame) -> DataFrame:
    """Periods with the mean profit of a bet and the profit so far."""
    w = Window.orderBy("period").rowsBetween(Window.unboundedPreceding, 0)  # a row a period
    return periods.withColumns({"mean_profit": F.round(F.col("profit") / F.col("n"), 6), "cum_profit": F.round(F.sum("profit").over(w), 4)})


def value_counts(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))


def percentiles(rows: DataFrame, keys: list[str], value: str, ps: dict[str, float]) -> DataFrame:
    """Exact percentiles with linear interpolation, a row a group, by refined histograms."""
    found = quantiles(rows, keys, [value], list(ps.values()))
    at = lambda p: F.max(F.when(F.col("share") == F.lit(float(p)), F.col("value")))
    return found.groupBy(*keys).agg(*(at(p).alias(n) for n, p in ps.items()))


def described(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Count, mean, deviation, least, quartiles and largest of each numeric column, a row a column."""
    long = rows.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in columns))).alias("e")).select("e.*")
    basic = long.groupBy("column").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd"), F.min("x").alias("least"), F.max("x").alias("largest"))
    quarters = quantiles(rows, [], columns, [0.25, 0.5, 0.75]).groupBy("column")
    at = lambda p: F.max(F.when(F.col("share") == p, F.col("value")))
    return basic.join(quarters.agg(at(0.25).alias("q1"), at(0.5).alias("median"), at(0.75).alias("q3")), "column", "left")


def edge_bins(rows: DataFrame, value: str, y: str, bins: int = 8) -> DataFrame:
    """Outcome by equal-width right-closed bins between the least and the largest value; the least counts to the first bin."""
    ends = rows.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    place = F.ceil((F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins) - 1
    b = F.greatest(F.lit(0), F.least(place, F.lit(bins - 1))).cast("int")
    kept = rows.where(F.col(value).isNotNull()).crossJoin(F.broadcast(ends))
    return kept.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(y).alias("rate"), F.avg(value).alias("mean"))


def open_totals(bets: DataFrame, keys: list[str]) -> DataFrame:
    """Open bets, their stakes and what they would win."""
    o = bets.where(F.col("status") == "open")
    return o.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_open"), F.sum("stake").alias("staked"), F.sum((F.col("odds") - 1) * F.col("stake")).alias("to_win"))


def event_counts(bets: DataFrame) -> DataFrame:
    """Open and resolved bets of each event."""
    return bets.groupBy("event_id").agg(F.sum((F.col("status") == "open").cast("int")).alias("n_open"), F.sum((F.col("status") == "resolved").cast("int")).alias("n_resolved"))


def niches(bets: DataFrame, keys: list[str], least: int) -> DataFrame:
    """Groups of all keys together that have enough bets."""
    return bets.groupBy(*keys).agg(*measures()).where(F.col("n") >= least)


def sweep(bets: DataFrame, score: str, thresholds: list[float]) -> DataFrame:
    """The measures of the bets above each threshold: each bet goes to those it passes, not to a cross join."""
    passed = F.filter(F.lit(thresholds), lambda t: F.col(score) > t)
    return bets.withColumn("threshold", F.explode(passed)).groupBy("threshold").agg(*measures())


def predicates(bets: DataFrame, rules: dict[str, Column], least: int = 20) -> DataFrame:
    """The measures of named predicates that enough bets satisfy; a bet may satisfy several."""
    held = F.filter(F.array(*(F.when(c, F.lit(n)) for n, c in rules.items())), lambda x: x.isNotNull())
    return bets.withColumn("strategy", F.explode(held)).groupBy("strategy").agg(*measures()).where(F.col("n") >= least)


def calibration(rows: DataFrame, p: str, y: str, bins: int = 10) -> DataFrame:
    """Mean prediction and outcome of equal-width bins of the prediction."""
    b = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int")
    out = rows.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(p), 6).alias("mean_p"), F.round(F.avg(y), 6).alias("rate"))
    return out.withColumn("error", F.round(F.col("rate") - F.col("mean_p"), 6))


def histogram(rows: DataFrame, value: str, bins: int) -> DataFrame:
    """Counts of equal-width bins between the least and the largest value, in two aggregations."""
    ends = rows.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    b = F.least(F.floor((F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins), F.lit(bins - 1)).cast("int")
    return rows.where(F.col(value).isNotNull()).crossJoin(F.broadcast(ends)).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


#: Rows that a task counts values of at most, about.
PROFILED = 250_000


def value_totals(rows: DataFrame, parts: int) -> DataFrame:
    """v and n: how often each value of the column v stands in the rows, null too.

    Values are counted in so many even shares of the rows first, then by value, so that a task's table of values
    stays as small however many rows a file has, and a value that most rows have sends a row a share.
    """
    if parts > 1:
        spread = rows.withColumn("_s", F.pmod(F.monotonically_increasing_id(), F.lit(16 * parts))).repartition(parts, "_s")
        each = spread.groupBy("_s", "v").agg(F.count(F.lit(1)).alias("n")).repartition(parts, "v")
        return each.groupBy("v").agg(F.sum("n").alias("n"))
    return rows.groupBy("v").agg(F.count(F.lit(1)).alias("n"))


def profile(df: DataFrame, at_once: int = PROFILED) -> DataFrame:
    """Type, filled rows, share of nulls, distinct values and an example of each column, by totals of its values."""
    rows, each = df.count(), []
    for c, kind in df.dtypes:
        values = value_totals(df.select(F.col(c).alias("v")), max(1, -(-rows // at_once)))
        filled = F.coalesce(F.sum(F.when(F.col("v").isNotNull(), F.col("n"))), F.lit(0))
        each.append(
            values.agg(filled.alias("filled"), F.round(1 - F.try_divide(filled, F.sum("n")), 6).alias("null_share"), F.count("v").alias("distinct"), F.min("v").cast("string").alias("example"))
            .select(F.lit(c).alias("column"), F.lit(kind).alias("type"), "filled", "null_share", "distinct", "example")
        )
    return reduce(DataFrame.unionByName, each)


def last_values(df: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """Each key's last value that isn't null, column by column."""
    at = F.struct(*order)
    return df.groupBy(key).agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(c) for c in columns))


def user_stats(bets: DataFrame, void_policy: str = "exclude") -> DataFrame:
    """Per user: open and resolved bets, win rate and ROI in percent, 0 without any.

    void_policy: exclude voids from both, include them in both, or count them in the rate alone.
    """
    resolved, void = F.col("status") == "resolved", F.col("result") == "void"
    in_rate = resolved if void_policy in ("include", "rate") else resolved & ~void
    in_stake = resolved if void_policy == "include" else resolved & ~void
    won = F.sum(F.when(resolved & (F.col("result") == "win"), 1).otherwise(0))
    return bets.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n_bets"),
        F.sum(F.when(F.col("status") == "open", 1).otherwise(0)).alias("n_open"),
        F.sum(resolved.cast("int")).alias("n_resolved"),
        won.alias("wins"),
        F.round(F.coalesce(100 * F.try_divide(won, F.sum(in_rate.cast("int"))), F.lit(0.0)), 4).alias("win_rate"),
        F.round(F.coalesce(100 * F.try_divide(F.sum(F.when(resolved, F.col("profit"))), F.sum(F.when(in_stake, F.col("stake")))), F.lit(0.0)), 4).alias("roi"),
    )


def bankrolls(users: DataFrame, bets: DataFrame) -> DataFrame:
    """Initial amount and profits of resolved bets less the stakes of open ones, to two places."""
    moved = F.sum(F.when(F.col("status") == "resolved", F.coalesce("profit", F.lit(0.0))).when(F.col("status") == "open", -F.col("stake")).otherwise(0.0))
    per = bets.groupBy("user_id").agg(moved.alias("_m"))
    return users.join(per, "user_id", "left").select("user_id", "initial", F.round(F.col("initial") + F.coalesce("_m", F.lit(0.0)), 2).alias("bankroll"))


def event_status(bets: DataFrame) -> DataFrame:
    """Each event's status and winner from its bets: open ones keep it upcoming, only voids void it, two winners tell nothing."""
    winner = F.when(F.col("result") == "win", F.col("pick")).when(F.col("result") == "loss", F.when(F.col("pick") == "a", "b").otherwise("a"))
    out = bets.groupBy("event_id").agg(
        F.bool_or(F.col("status") == "open").alias("any_open"),
        F.bool_and(F.coalesce(F.col("result") == "void", F.lit(False))).alias("only_void"),
        F.array_sort(F.collect_set(winner)).alias("winners"),
    )
    side = F.when(F.col("any_open"), F.lit(None)).when(F.col("only_void"), "void").when(F.size("winners") == 1, F.get("winners", 0))
    return out.select("event_id", F.when(F.col("any_open"), "upcoming").otherwise("completed").alias("status"), side.alias("winner_side"))


def freshness(df: DataFrame, date: str, as_of: str, players: list[str], fresh: int = 7, stale: int = 30) -> DataFrame:
    """Rows, last date, age in days with its class, and distinct players of both sides."""
    sides = df.select(date, F.explode(F.array(*players)).alias("_p"))
    out = sides.agg((F.count(F.lit(1)) / len(players)).cast("long").alias("n"), F.max(date).alias("last_date"), F.countDistinct("_p").alias("players"))
    out = out.withColumn("age_days", F.datediff(F.lit(as_of).cast("date"), "last_date"))
    return out.withColumn("freshness", F.when(F.col("age_days") <= fresh, "fresh").when(F.col("age_days") <= stale, "aging").otherwise("stale"))
