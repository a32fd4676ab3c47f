"""Simulations and their metrics: running bankrolls, walk-forward folds, risk figures, bootstrap."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyline.functions import scalars as S
from tallyline.operators import asof, boosting, models
from tallyline.operators.quantiles import quantiles
from tallyline.operators.ratings import fold
from tallyline.operators.running import month, running
from tallyline.session import written

ORDER = ["date", "contest_id"]


def flat_log(bets: DataFrame, keys: list[str], initial: float = 1000.0, share: Column | float = 0.02) -> DataFrame:
    """Bets of a fixed part of the initial bankroll and the bankroll after each."""
    amount = initial * (share if isinstance(share, Column) else F.lit(share))
    out = bets.withColumns({"stake": amount, "profit": F.when(F.col("won") == 1, amount * (F.col("odds") - 1)).otherwise(-amount)})
    return running(out, keys, month(), ORDER, {"bankroll": ("sum", F.col("profit"))}).withColumn("bankroll", initial + F.col("bankroll"))


def merged_logs(logs: list[DataFrame], keys: list[str], initial: float = 1000.0) -> DataFrame:
    """Bet logs of several strategies in one order, with the profit so far over all of them."""
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [x.withColumn("log", F.lit(i)) for i, x in enumerate(logs)])
    out = running(both, keys, month(), ["date", "contest_id", "log"], {"cum_profit": ("sum", F.col("profit"))})
    return out.withColumn("bankroll", initial + F.col("cum_profit"))


def compounding(bets: DataFrame, keys: list[str], initial: float = 1000.0, stop_share: float | None = None) -> DataFrame:
    """Bets of column share of the bankroll at the time, as one running product.

    With a stop, a bet after the bankroll fell below (1 - stop_share) of its peak isn't made. The
    bankroll moves by bets alone, so the stop holds from the first breach on: the product until then
    tells it.
    """
    out = asof.compounded(bets, keys, ORDER, "share", initial)
    if stop_share is None:
        return out
    out = running(out, keys, month(), ORDER, {"_peak": ("max", F.col("bankroll"))})
    out = out.withColumn("_broke", (F.col("bankroll") < (1 - stop_share) * F.greatest(F.lit(initial), "_peak")).cast("int"))
    out = running(out, keys, month(), ORDER, {"_earlier": ("max", F.col("_broke"))}, current=False)
    return out.where(F.coalesce("_earlier", F.lit(0)) == 0).drop("_peak", "_broke", "_earlier")


def both_sides(c: DataFrame, rule: dict, p: str = "p1_prob") -> DataFrame:
    """Of both sides' gated Kelly shares the larger bets, the first on ties; contests where neither passes go.

    Shares don't depend on the bankroll, so the larger share is the larger stake at any bankroll.
    """
    one = S.gated_kelly(p, "odd1", S.implied("odd1"), rule)
    two = S.gated_kelly(1 - F.col(p), "odd2", S.implied("odd2"), rule)
    out = c.withColumns({"_a": F.coalesce(one, F.lit(0.0)), "_b": F.coalesce(two, F.lit(0.0))}).where("_a > 0 OR _b > 0")
    first = (F.col("_a") > 0) & (F.col("_a") >= F.col("_b"))
    pick = lambda x, y: F.when(first, x).otherwise(y)
    out = out.withColumns(
        {
            "side": pick(F.lit(1), F.lit(2)), "share": pick(F.col("_a"), F.col("_b")), "odds": pick(F.col("odd1"), F.col("odd2")),
            "prob": pick(F.col(p), 1 - F.col(p)), "won": pick(F.col("win1"), 1 - F.col("win1")),
        }
    ).drop("_a", "_b")
    return out.withColumns({"edge": S.edge("prob", "odds"), "ev": S.expected_value("prob", "odds")})


def historical(c: DataFrame, rule: dict, keys: list[str], initial: float = 1000.0, p: str = "p1_prob") -> DataFrame:
    """Compounding bets on the better side at the contests' own odds, with stake and profit of each.

    A bankroll of nothing would end it, but shares below one never reach that.
    """
    out = asof.compounded(both_sides(c, rule, p), keys, ORDER, "share", initial, exact=False)
    gain = F.when(F.col("won") == 1, F.col("odds") - 1).otherwise(-1.0)
    stake = F.col("bankroll") / (1 + F.col("share") * gain) * F.col("share")
    return out.withColumn("stake", stake).withColumn("profit", F.col("stake") * gain)


def pairs_of(app: DataFrame, key: str = "contest_id") -> DataFrame:
    """Contests that have exactly two rows, one of which won, as rows of both sides; others are left out."""
    side = F.array_sort(F.collect_list(F.struct("side", "player", "won", "odds")))
    both = app.groupBy(key, "date").agg(F.count(F.lit(1)).alias("_n"), F.sum("won").alias("_won"), side.alias("_s"))
    pick = lambda i, c: F.get("_s", i)[c]
    return both.where("_n = 2 AND _won = 1").select(key, "date", pick(0, "player").alias("p1"), pick(1, "player").alias("p2"), pick(0, "won").alias("win1"))


def simulated_prices(c: DataFrame, rated: DataFrame, p: Column, rule: dict, keys: list[str], margin: float = 0.05) -> DataFrame:
    """The same at prices that the ratings before each contest give, with the margin in them."""
    e = rated.select("contest_id", S.expected_score("elo_1", "elo_2").alias("_e"))
    priced = c.drop("odd1", "odd2").join(e, "contest_id")
    priced = priced.withColumns({"odd1": S.synthetic_odds(F.col("_e"), margin), "odd2": S.synthetic_odds(1 - F.col("_e"), margin)}).withColumn("p1_prob", p).drop("_e")
    return historical(priced, rule, keys)


def simulated(bets: DataFrame, league: str, initial: float = 1000.0, stop_share: float = 0.7, least: float = 0.5) -> DataFrame:
    """The same with a least stake that skips bets: the bankroll then depends on itself, so it is an ordered fold."""

    def step(state: dict, row: tuple) -> tuple:
        share, odds, won = row
        bank, peak = state.setdefault("bank", initial), state.setdefault("peak", initial)
        stake = bank * share
        if bank < peak * (1 - stop_share) or stake < least:
            return 0.0, 0.0, bank
        profit = stake * (odds - 1) if won else -stake
        state["bank"] = bank + profit
        state["peak"] = max(peak, bank + profit)
        return stake, profit, bank + profit

    return fold(bets, league, ORDER, step, ["share", "odds", "won"], {"stake": "double", "profit": "double", "bankroll": "double"})


def sharpe(mean: Column, deviation: Column, times: float | Column) -> Column:
    return F.when(deviation > 0, mean / deviation * F.sqrt(times if isinstance(times, Column) else F.lit(times))).otherwise(0.0)


def metrics(bets: DataFrame, keys: list[str], initial: float = 1000.0) -> DataFrame:
    """Bets, hits, stakes, profit, ROI, drawdown, Sharpe by bet, by day and by month, Calmar, profit factor of each group."""
    run = asof.equity(bets, keys, ORDER, initial)
    each = run.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("won").alias("wins"),
        F.avg("won").alias("hit_rate"),
        F.sum("stake").alias("staked"),
        F.sum("profit").alias("profit"),
        F.max("drawdown_share").alias("max_drawdown"),
        F.sum(F.when(F.col("profit") > 0, F.col("profit")).otherwise(0.0)).alias("_gain"),
        F.sum(F.when(F.col("profit") < 0, -F.col("profit")).otherwise(0.0)).alias("_loss"),
        F.avg(F.when(F.col("profit") > 0, F.col("profit"))).alias("mean_win"),
        F.avg(F.when(F.col("profit") < 0, F.col("profit"))).alias("mean_loss"),
        F.avg("profit").alias("_m"),
        F.stddev_samp("profit").alias("_s"),
    )
    days = bets.groupBy(*keys, "date").agg(F.sum("profit").alias("p")).groupBy(*keys).agg(F.avg("p").alias("_dm"), F.stddev_pop("p").alias("_ds"))
    months = bets.groupBy(*keys, F.trunc("date", "month").alias("m")).agg(F.sum("profit").alias("p")).groupBy(*keys).agg(F.avg("p").alias("_mm"), F.stddev_samp("p").alias("_ms"))
    out = each.join(days, keys).join(months, keys).withColumn("roi", F.try_divide("profit", "staked"))
    return out.withColumns(
        {
            "sharpe_bet": sharpe(F.col("_m"), F.col("_s"), F.col("n")),
            "sharpe_daily": sharpe(F.col("_dm"), F.col("_ds"), 252),
            "sharpe_monthly": sharpe(F.col("_mm"), F.coalesce("_ms", F.lit(0.0)), 12),
            "calmar": F.coalesce(F.try_divide("roi", "max_drawdown"), F.lit(0.0)),
            "profit_factor": F.try_divide("_gain", "_loss"),
        }
    ).drop("_gain", "_loss", "_m", "_s", "_dm", "_ds", "_mm", "_ms")


def t_test(bets: DataFrame, keys: list[str]) -> DataFrame:
    """One-sample t of the profits against 0 and its one-sided p by Student's law, half of the two-sided one."""
    out = bets.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("profit").alias("mean"), F.stddev_samp("profit").alias("sd"))
    out = out.withColumn("t", F.try_divide(F.col("mean"), F.col("sd") / F.sqrt("n")))
    return out.withColumn("p_one_sided", F.when(F.col("n") > 1, S.t_tail("t", F.col("n") - 1)))


#: A prime below 2 to the 31, so that products of two remainders fit into 63 bits.
PRIME = (1 << 31) - 1


def drawn(key: Column, draw: Column) -> Column:
    """A number in [0, 1) from a key and a draw, alike in every engine: two squarings modulo a prime."""
    x = (key % PRIME * 48271 + draw * 69621 + 7) % PRIME
    x = (x * x + draw) % PRIME
    return (x * x + key % PRIME) % PRIME / float(PRIME)


def poisson_weight(u: Column) -> Column:
    """How often a resample takes a bet, from a number in [0, 1): Poisson's law of mean 1."""
    out, cumulative, steps = F.lit(7), 0.0, []
    for k in range(7):
        cumulative += math.exp(-1) / math.factorial(k)
        steps.append((round(cumulative, 12), k))
    for c, k in reversed(steps):
        out = F.when(u < c, k).otherwise(out)
    return out


def bootstrap(bets: DataFrame, keys: list[str], draws: int = 1000, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """ROI intervals from resampling with Poisson weights that follow from (bet, draw).

    A bet is repeated for every draw within its task and summed there at once; one row a group and draw moves.
    """
    draw = F.explode(F.sequence(F.lit(1).cast("long"), F.lit(draws).cast("long"))).alias("_d")
    each = bets.select(*keys, F.col("contest_id").cast("long").alias("_id"), "profit", "stake", draw)
    each = each.withColumn("_u", drawn(F.col("_id"), F.col("_d"))).withColumn("_w", poisson_weight(F.col("_u")))
    rois = each.groupBy(*keys, "_d").agg(F.try_divide(F.sum(F.col("_w") * F.col("profit")), F.sum(F.col("_w") * F.col("stake"))).alias("roi"))
    return rois.groupBy(*keys).agg(
        F.avg("roi").alias("roi_mean"), F.stddev_pop("roi").alias("roi_sd"), F.percentile("roi", low).alias("roi_low"),
        F.percentile("roi", high).alias("roi_high"), F.avg((F.col("roi") > 0).cast("double")).alias("p_positive"),
    )


def yearly_folds(rows: DataFrame, train_years: int = 4, least_train: int = 1000, least_test: int = 50) -> DataFrame:
    """Test years with the sizes of their training spans; years with too few rows, or too few years before them, are left out."""
    years = rows.groupBy(F.year("date").alias("year")).agg(F.count(F.lit(1)).alias("n"))
    before = years.select(F.col("year").alias("_y"), F.col("n").alias("_n"))
    joined = years.join(before, (F.col("_y") < F.col("year")) & (F.col("_y") >= F.col("year") - train_years), "left")
    sized = joined.groupBy("year", "n").agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n_train"), F.min("_y").alias("first_year"), F.count("_y").alias("_years")).withColumnRenamed("n", "n_test")
    whole = (F.col("_years") == train_years) & (F.col("n_train") >= least_train) & (F.col("n_test") >= least_test)
    return sized.where(whole).drop("_years").withColumn("calibration_year", F.col("year") - 1)


def step_folds(first: str, last: str, months: int = 6) -> list[tuple[str, str]]:
    """Half-open test spans of so many months from first until after last."""
    import datetime as dt

    start, end, out = dt.date.fromisoformat(first), dt.date.fromisoformat(last), []
    while start <= end:
        m = start.month - 1 + months
        after = start.replace(year=start.year + m // 12, month=m % 12 + 1)
        out.append((start.isoformat(), after.isoformat()))
        start = after
    return out


def best(rows: DataFrame, by: Column, columns: list[str]) -> DataFrame:
    """The row with the largest value."""
    return rows.agg(F.max_by(F.struct(*columns), by).alias("b")).select("b.*")


def drawdown_gate(bets: DataFrame, keys: list[str], limit: float = 0.25, initial: float = 1000.0) -> DataFrame:
    """Bets until the drawdown first reaches the limit; it holds from then on, for only bets move the bankroll."""
    run = asof.equity(bets, keys, ORDER, initial).withColumn("_broke", (F.col("drawdown_share") >= limit).cast("int"))
    out = running(run, keys, month(), ORDER, {"blocked": ("max", F.col("_broke"))}, current=False)
    return out.withColumn("blocked", F.coalesce("blocked", F.lit(0))).drop("_broke")


def caps(bets: DataFrame, daily: float = 0.10, tournament: float = 0.08, concurrent: int = 8) -> DataFrame:
    """Whether a bet fits the day's, the tournament's and the open bets' caps, counting all asked for earlier on its day; bets close with their day."""
    day = Window.partitionBy("date").orderBy("contest_id", "side").rowsBetween(Window.unboundedPreceding, 0)
    group = Window.partitionBy("date", "tournament").orderBy("contest_id", "side").rowsBetween(Window.unboundedPreceding, 0)
    out = bets.withColumns({"day_share": F.sum("share").over(day), "tournament_share": F.sum("share").over(group), "open_bets": F.count(F.lit(1)).over(day) - 1})
    refused = F.when(F.col("day_share") > daily, "day").when(F.col("open_bets") >= concurrent, "open bets").when(F.col("tournament_share") > tournament, "tournament")
    return out.withColumn("refused", refused)


def folded(rows: DataFrame, columns: list[str], folds: list[dict[str, Column]], kind: str, gaps: list[list[float]] | None = None, **settings) -> DataFrame:
    """Calibrated predictions p_cal of the test rows of every fold, by its number _fold, without the columns: a fold says which rows train, calibrate and test.

    All folds' models learn over one table, one pass scores the rows that calibrate or test, each by its folds' models, and the
    folds' curves are fitted side by side. Rows are read several times and not copied: give a written table.
    """
    n = len(folds)
    if n > boosting.MOST_MODELS:
        raise ValueError(f"{boosting.MOST_MODELS} folds fit side by side")
    masks = {f"_{part}": models.masked([f[part] for f in folds]) for part in ("train", "calibrate", "test")}
    tagged = models.vectors(rows.withColumns(masks), columns).drop(*(c for c in columns if c != "label"))
    fitted = models.fit(kind, tagged.select("x", "label", F.col("_train").alias("train")), n, gaps, **settings)
    part = F.expr(f"filter(sequence(0, {n - 1}), k -> shiftright(_calibrate | _test, k) % 2 = 1)")
    asked = tagged.drop("_train").where(F.col("_calibrate").bitwiseOR(F.col("_test")) != 0).withColumn("_fold", F.explode(part))
    scored = written(fitted.scored(asked, "p", "_fold").drop("x"), "scored")
    own = lambda k, what: scored.where((F.col("_fold") == k) & F.expr(f"shiftright(_{what}, {k}) % 2 = 1"))
    out = models.side_by_side(lambda k: models.calibrated(own(k, "calibrate"), own(k, "test"), "p"), n)
    return reduce(DataFrame.unionByName, out).drop("_calibrate", "_test")


def walk_forward(rows: DataFrame, columns: list[str], folds: DataFrame, kind: str = "logistic", **settings) -> DataFrame:
    """Calibrated predictions of every fold's test year: fitted on the train years but the last, calibrated on that one.

    rows: contest_id, date, label and the columns; folds are those of yearly_folds, a row a year.
    """
    years = [r.asDict() for r in folds.orderBy("year").collect()]  # a fold is a model to train, so there are as many as years
    if not years:
        return rows.drop(*columns).withColumns({"p": F.lit(None).cast("double"), "p_cal": F.lit(None).cast("double"), "test_year": F.lit(None).cast("int")}).where("false")
    y = F.year("date")
    parts = [{"train": y.between(f["first_year"], f["calibration_year"] - 1), "calibrate": y == f["calibration_year"], "test": y == f["year"]} for f in years]
    out = [folded(rows, columns, parts[k : k + boosting.MOST_MODELS], kind, **settings).withColumn("test_year", F.get(F.lit([f["year"] for f in years[k : k + boosting.MOST_MODELS]]), "_fold")) for k in range(0, len(parts), boosting.MOST_MODELS)]
    return reduce(DataFrame.unionByName, out).drop("_fold")


def stepped(rows: DataFrame, columns: list[str], first: str, months: int = 6, least_train: int = 200, least_test: int = 20, kind: str = "level", **settings) -> DataFrame:
    """Predictions of steps of some months, fitted on all before but the last fifth by date, which calibrates; test_from names the step.

    A logistic's gaps become the medians of the rows that each step trains on; trees know gaps as such. Steps with too
    few rows are left out; without any step, and for an empty table, there are no rows.
    """
    days = {r["date"]: r["n"] for r in rows.where(F.col("date").isNotNull()).groupBy("date").agg(F.count(F.lit(1)).alias("n")).orderBy("date").collect()}  # as many as days
    steps = []
    for a, b in step_folds(first, max(days).isoformat()) if days else []:
        before = [(d.isoformat(), n) for d, n in days.items() if d.isoformat() < a]
        total = sum(n for _, n in before)
        if total < least_train or sum(n for d, n in days.items() if a <= d.isoformat() < b) < least_test:
            continue
        at, seen, cut = min(int(total * 0.8), total - 50), 0, a
        for d, n in before:
            seen += n
            if seen > at:
                cut = d
                break
        steps.append((a, b, cut))
    if not steps:
        return rows.drop(*columns).withColumns({"p": F.lit(None).cast("double"), "p_cal": F.lit(None).cast("double"), "test_from": F.lit(None).cast("string")}).where("false")
    date, out = F.col("date"), []
    for low in range(0, len(steps), boosting.MOST_MODELS):
        some = steps[low : low + boosting.MOST_MODELS]
        parts = [{"train": date < cut, "calibrate": (date >= cut) & (date < a), "test": (date >= a) & (date < b)} for a, b, cut in some]
        gaps = None
        if kind == "logistic":
            spread = rows.where(date < max(cut for *_, cut in some)).withColumn("_step", F.explode(F.filter(F.array(*(F.when(p["train"], F.lit(k)) for k, p in enumerate(parts))), lambda k: k.isNotNull())))
            found = {(r["_step"], r["column"]): r["value"] for r in quantiles(spread, ["_step"], columns, [0.5]).collect()}
            gaps = [[found.get((k, c), float("nan")) for c in columns] for k in range(len(some))]
        out.append(folded(rows, columns, parts, kind, gaps, **settings).withColumn("test_from", F.get(F.lit([a for a, *_ in some]), "_fold")))
    return reduce(DataFrame.unionByName, out).drop("_fold")


def split_by_year(rows: DataFrame, test_year: int | None = None, train_years: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(train, calibrate, test): the test year, the last one if none is named, the year before it, and those before, or so many of them."""
    if test_year is None:
        test_year = rows.agg(F.max(F.year("date"))).first()[0] or 0
    year = F.year("date")
    train = (year < test_year - 1) if train_years is None else year.between(test_year - 1 - train_years, test_year - 2)
    return rows.where(train), rows.where(year == test_year - 1), rows.where(year == test_year)


def split_by_date(rows: DataFrame, share: float = 0.8, least_held: int = 0) -> tuple[DataFrame, DataFrame]:
    """(train, held): rows before and from the day that the row at this share of all has, in order of date; at least so many are held.

    The day is found from counts by day, so nothing is sorted whole.
    """
    days = rows.groupBy("date").agg(F.count(F.lit(1)).alias("n"))
    total = days.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    at = min(int(total * share), total - least_held) if least_held else int(total * share)
    w = Window.partitionBy(F.trunc("date", "year")).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    years = days.groupBy(F.trunc("date", "year").alias("_y")).agg(F.sum("n").alias("_t"))
    before = years.withColumn("_before", F.coalesce(F.sum("_t").over(Window.orderBy("_y").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranked = days.withColumn("_r", F.sum("n").over(w)).join(before, F.trunc("date", "year") == F.col("_y"))
    cut = ranked.where(F.col("_r") + F.col("_before") > at).agg(F.min("date").alias("d")).first()["d"]
    if cut is None:
        return rows, rows.where("false")
    return rows.where(F.col("date") < F.lit(cut)), rows.where(F.col("date") >= F.lit(cut))


def fold_metrics(bets: DataFrame, keys: list[str], n_folds: int, initial: float = 1000.0) -> DataFrame:
    """Metrics of each strategy over all folds: Calmar takes the return of one fold times the folds."""
    m = metrics(bets, keys, initial)
    more = bets.groupBy(*keys).agg(F.avg("odds").alias("mean_odds"), F.avg("edge").alias("mean_edge"))
    out = m.join(more, keys).withColumn("bets_per_year", F.col("n") / F.lit(max(n_folds, 1)))
    return out.withColumn("calmar", F.when(F.col("max_drawdown") > 0, F.col("roi") * n_folds / F.col("max_drawdown")).otherwise(0.0))


def compared(m: DataFrame, name: str) -> DataFrame:
    """A table of strategies' metrics, marked with the best return and the best return beside its drawdown; the first name wins ties."""
    risk = F.try_divide("roi", "max_drawdown")
    rows = m.withColumn("risk_ratio", F.coalesce(risk, F.lit(0.0)))
    ends = rows.agg(F.min_by(name, F.struct(-F.col("roi"), name)).alias("_r"), F.min_by(name, F.struct(-F.col("risk_ratio"), name)).alias("_k"))
    return rows.crossJoin(F.broadcast(ends)).withColumns({"best_return": F.col(name) == F.col("_r"), "best_ratio": F.col(name) == F.col("_k")}).drop("_r", "_k")


def tracked(bets: DataFrame, keys: list[str]) -> DataFrame:
    """Running record of each strategy: bets, wins (profit above 0), sums, largest drawdown of the running profit, mean closing value."""
    run = asof.equity(bets, keys, ORDER, 0.0)
    out = run.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_bets"), F.sum((F.col("profit") > 0).cast("int")).alias("n_wins"), F.sum("stake").alias("staked"),
        F.sum("profit").alias("profit"), F.max("drawdown").alias("drawdown"), F.avg("clv").alias("mean_clv"),
    )
    text = F.format_string("%d bets, %.1f%% won, ROI %.2f%%", F.col("n_bets"), 100 * F.col("n_wins") / F.col("n_bets"), 100 * F.col("profit") / F.col("staked"))
    return out.withColumn("summary", text)
