"""As-of features: what was known of a participant before each contest, by window functions.

All windows of a participant share one partitioning and order, so Spark sorts the appearances once
for them; those by surface, opponent or both need sorts of their own. Rows of one day count in
order of their contests.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyline.operators.running import month, running, running_product

ORDER = ("date", "contest_id", "side")


def by(*keys: str):
    return Window.partitionBy(*keys).orderBy(*ORDER)


def form(n: int, least: int = 1) -> Column:
    """Share won of the last n contests; one half with fewer than least."""
    w = by("player").rowsBetween(-n, -1)
    return F.when(F.count("won").over(w) >= least, F.avg("won").over(w)).otherwise(0.5)


def rate(past: str, since: Column | None = None, default: Column | float | None = 0.5, least: int = 1) -> Column:
    """Share won in an array of (date, won), of those from a date on."""
    rows = F.filter(past, lambda x: x["date"] >= since) if since is not None else F.col(past)
    won = F.aggregate(rows, F.lit(0), lambda a, x: a + x["won"])
    out = F.when(F.size(rows) >= least, won / F.size(rows))
    return out if default is None else F.coalesce(out, default if isinstance(default, Column) else F.lit(default))


def player_features(app: DataFrame, windows: tuple[int, ...] = (3, 5, 10, 20), slam: str = "Grand Slam", asked: str | None = None) -> DataFrame:
    """Form, surface rates, rest, fatigue, head-to-head and experience of each appearance before its contest.

    asked names a boolean column of rows that only ask: they see the rows of earlier days and count for no row. Histories of some
    rows become figures before the next window sorts, so that no sort carries them.
    """
    before, real = Window.unboundedPreceding, F.lit(True)
    frame = lambda keys, n=None: by(*keys).rowsBetween(-n if n else before, -1)
    out = app.repartition("player")
    if asked is not None:
        # Rows that ask take no number, so a span of numbers holds so many rows that count, whatever asks between them.
        real = ~F.col(asked)
        first = lambda keys: Window.partitionBy(*keys).orderBy("date", F.desc(asked), "contest_id", "side")
        number = lambda keys: F.sum(real.cast("int")).over(first(keys).rowsBetween(before, 0))
        out = out.withColumn("_at_player", number(("player",))).withColumn("_at_surface", number(("player", "surface")))
        frame = lambda keys, n=None: first(keys).rowsBetween(before, -1) if n is None else Window.partitionBy(*keys).orderBy(f"_at_{keys[-1]}").rangeBetween(1 - n, 0)
    past = lambda keys, n: F.collect_list(F.when(real, F.struct("date", "won"))).over(frame(keys, n))
    since = lambda d: F.date_sub("date", d)
    own, mine = ("player",), F.when(real, F.col("won"))
    share = lambda n: F.when(F.count(mine).over(frame(own, n)) >= 1, F.avg(mine).over(frame(own, n))).otherwise(0.5)
    out = out.withColumns(
        {f"form_{n}": share(n) for n in windows}
        | {
            "_last20": past(own, 20),
            "_last30": past(own, 30),
            "matches": F.count(mine).over(frame(own)),
            "wins": F.coalesce(F.sum(mine).over(frame(own)), F.lit(0)),
            "slam_experience": F.coalesce(F.sum((real & (F.col("series") == slam)).cast("int")).over(frame(own)), F.lit(0)),
            "days_since": F.datediff("date", F.last(F.when(real, F.col("date")), ignorenulls=True).over(frame(own))),
        }
    )
    earlier = F.array_max(F.transform(F.filter("_last30", lambda x: x["date"] < F.col("date")), lambda x: x["date"]))
    out = out.withColumns(
        {
            "_overall": rate("_last20", since(365), None),
            "fatigue_14": F.size(F.filter("_last30", lambda x: x["date"] >= since(14))),
            "days_rest": F.coalesce(F.datediff("date", earlier), F.lit(30)),
            "momentum": F.col("form_5") - F.col("form_20") if {5, 20} <= set(windows) else F.lit(None).cast("double"),
        }
    ).drop("_last20", "_last30")
    on_surface = F.col("surface_rate_365")
    special = F.when(F.coalesce("_overall", F.lit(0.0)) > 0, F.least(F.lit(3.0), on_surface / F.col("_overall"))).otherwise(1.0)
    out = out.withColumn("_surface50", past(("player", "surface"), 50))
    out = out.withColumns({f"surface_rate_{d}": rate("_surface50", since(d)) for d in (90, 180, 365)}).drop("_surface50")
    out = out.withColumn("surface_specialist", special).drop("_overall")
    h2h, h2h_surface = frame(("player", "opponent")), frame(("player", "opponent", "surface"))
    out = out.withColumns({"h2h_total": F.count(mine).over(h2h), "h2h_rate": F.coalesce(F.avg(mine).over(h2h), F.lit(0.5))})
    out = out.withColumns({"h2h_surface_rate": F.coalesce(F.avg(mine).over(h2h_surface), F.lit(0.5))})
    return out.drop("_at_player", "_at_surface")


def sided(app: DataFrame, columns: list[str]) -> DataFrame:
    """One row a contest again: the columns of both sides as p1_* and p2_*, by one grouping on contest_id.

    Sides are dealt by contest before they are grouped: grouped where they lie, each would be sent with the other's columns, all null.
    """
    app = app.select("contest_id", "side", *columns).repartition("contest_id")
    pick = lambda n, c: F.max(F.when(F.col("side") == n, F.col(c))).alias(f"p{n}_{c}")
    return app.groupBy("contest_id").agg(*(pick(n, c) for c in columns for n in (1, 2)))


def trailing(app: DataFrame, columns: list[str], n: int = 5, current: bool = False) -> DataFrame:
    """Means of the last n rows of a player, without the row itself or with it; nulls don't count."""
    w = by("player").rowsBetween(-(n - 1) if current else -n, 0 if current else -1)
    return app.withColumns({f"{c}_l{n}": F.avg(c).over(w) for c in columns})


def monthly_surface_rate(app: DataFrame, months: int, least: int = 3) -> DataFrame:
    """Surface rate since a calendar month's offset, without a cap on rows; one half below least contests.

    Running counts and wins by player and surface are sampled where the span begins: the earlier rows
    from a day on are those up to now less those before that day, found by the last row before it. Both
    lie in one order, so a second pass over (day, row or question) gives them without any row's history.
    """
    name, keys = f"surface_rate_{months}m", ("player", "surface")
    # On one day questions come before rows, so that they count the days before alone.
    sides = F.array(F.struct(F.add_months("date", -months).alias("_d"), F.lit(0).alias("_kind")), F.struct(F.col("date").alias("_d"), F.lit(1).alias("_kind")))
    both = app.select(*keys, "won", F.col("contest_id").alias("_c"), F.col("side").alias("_s"), F.explode(sides).alias("_e")).select("*", "_e.*").drop("_e")
    w = Window.partitionBy(*keys).orderBy("_d", "_kind", "_c", "_s").rowsBetween(Window.unboundedPreceding, -1)
    both = both.withColumns({"_n": F.coalesce(F.sum("_kind").over(w), F.lit(0)), "_won": F.coalesce(F.sum(F.col("won") * F.col("_kind")).over(w), F.lit(0))})
    sign = F.when(F.col("_kind") == 1, 1).otherwise(-1)
    n, won = (F.sum(sign * F.col(c)) for c in ("_n", "_won"))
    found = both.groupBy(F.col("_c").alias("contest_id"), F.col("_s").alias("side")).agg(n.alias("_n"), won.alias("_won"))
    return app.join(found, ["contest_id", "side"]).withColumn(name, F.when(F.col("_n") >= least, F.col("_won") / F.col("_n")).otherwise(0.5)).drop("_n", "_won")


def unbounded_fatigue(app: DataFrame, days: int = 14) -> DataFrame:
    """Earlier contests of a player within so many days, however many: a range frame over days, less what of the day itself comes later."""
    day = F.datediff("date", F.lit("1970-01-01").cast("date"))
    at = Window.partitionBy("player").orderBy(day)
    upto = F.count(F.lit(1)).over(at.rangeBetween(-days, 0))
    # The day's own rows are counted whole; those not earlier are the row and those after it.
    today = Window.partitionBy("player", "date").orderBy(*ORDER).rowsBetween(0, Window.unboundedFollowing)
    return app.withColumn(f"fatigue_{days}_all", (upto - F.count(F.lit(1)).over(today)).cast("int"))


def pair_history(c: DataFrame) -> DataFrame:
    """Head-to-head by the unordered pair: earlier contests and the first side's share of them."""
    low, high = F.least("p1", "p2"), F.greatest("p1", "p2")
    w = Window.partitionBy("_a", "_b").orderBy("date", "contest_id").rowsBetween(Window.unboundedPreceding, -1)
    won_low = F.when(F.col("p1") == F.col("_a"), F.col("win1")).otherwise(1 - F.col("win1"))
    out = c.withColumns({"_a": low, "_b": high}).withColumn("_w", won_low)
    out = out.withColumns({"pair_total": F.count("_w").over(w), "_low": F.avg("_w").over(w)})
    mine = F.when(F.col("p1") == F.col("_a"), F.col("_low")).otherwise(1 - F.col("_low"))
    return out.withColumn("pair_rate", F.coalesce(mine, F.lit(0.5))).drop("_a", "_b", "_w", "_low")


def snapshot(app: DataFrame, as_of: str, form_n: int = 5, months: int = 12, days: int = 14) -> DataFrame:
    """Every player's figures as of a date: last-n form, rate since some months, recent contests, last date."""
    day = F.lit(as_of).cast("date")
    past = app.where(F.col("date") < day).withColumn("_r", F.row_number().over(Window.partitionBy("player").orderBy(F.desc("date"), F.desc("contest_id"))))
    return past.groupBy("player").agg(
        F.avg(F.when(F.col("_r") <= form_n, F.col("won"))).alias("form"),
        F.avg(F.when(F.col("date") >= F.add_months(day, -months), F.col("won"))).alias("recent_rate"),
        F.count(F.when(F.col("date") >= F.date_sub(day, days), 1)).alias("fatigue"),
        F.max("date").alias("last_date"),
    )


def latest(app: DataFrame, n: int) -> DataFrame:
    """A player's last n rows, newest first."""
    w = Window.partitionBy("player").orderBy(F.desc("date"), F.desc("contest_id"), F.desc("side"))
    return app.withColumn("recency", F.row_number().over(w)).where(F.col("recency") <= n)


def editions(rows: DataFrame, key: str, date: str, gap_days: int = 60) -> DataFrame:
    """Number of the run of rows of a key without a gap of more than gap_days, from 1."""
    w = Window.partitionBy(key).orderBy(date)
    new = F.coalesce((F.datediff(date, F.lag(date).over(w)) > gap_days).cast("int"), F.lit(0))
    return rows.withColumn("_new", new).withColumn("edition", 1 + F.sum("_new").over(w.rangeBetween(Window.unboundedPreceding, 0))).drop("_new")


def losing_streak(bets: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Longest run of losses of each group: runs within each month by two row numbers, then the months put together in order.

    Of a month it is enough to know its bets, its losses at either end and its longest run.
    """
    parts = bets.withColumn("_part", month())
    w = Window.partitionBy(*keys, "_part").orderBy(*order)
    same = Window.partitionBy(*keys, "_part", "won").orderBy(*order)
    rows = parts.withColumns({"_r": F.row_number().over(w), "_g": F.row_number().over(w) - F.row_number().over(same)})
    runs = rows.groupBy(*keys, "_part", "won", "_g").agg(F.count(F.lit(1)).cast("int").alias("n"), F.min("_r").alias("a"), F.max("_r").alias("z"))
    lost, one = F.col("won") == 0, F.struct(F.col("z").alias("z"), F.col("n").alias("n"))
    months = runs.groupBy(*keys, "_part").agg(
        F.max("z").alias("rows"),
        F.coalesce(F.max(F.when(lost, F.col("n"))), F.lit(0)).alias("longest"),
        F.coalesce(F.max(F.when(lost & (F.col("a") == 1), F.col("n"))), F.lit(0)).alias("head"),
        F.max(F.when(lost, one)).alias("last"),
    )
    tail = F.when(F.col("last.z") == F.col("rows"), F.col("last.n")).otherwise(0)
    each = F.array_sort(F.collect_list(F.struct("_part", "rows", "longest", "head", tail.alias("tail"))))

    def step(a: Column, m: Column) -> Column:
        run = a["run"] + m["head"]
        return F.struct(F.greatest(a["best"], run, m["longest"]).alias("best"), F.when(m["head"] == m["rows"], run).otherwise(m["tail"]).alias("run"))

    best = F.aggregate(each, F.struct(F.lit(0).alias("best"), F.lit(0).alias("run")), step, lambda a: a["best"].cast("long"))
    return months.groupBy(*keys).agg(best.alias("longest_losing_streak")).where("longest_losing_streak > 0")


def equity(bets: DataFrame, keys: list[str], order: list[str], initial: float = 1000.0) -> DataFrame:
    """Running profit, its peak and the drawdown, absolute and as a share of the peak."""
    out = running(bets, keys, month(), order, {"cum_profit": ("sum", F.col("profit"))})
    out = running(out, keys, month(), order, {"peak": ("max", initial + F.col("cum_profit"))})
    out = out.withColumn("peak", F.greatest(F.lit(initial), "peak"))
    fall = F.col("peak") - initial - F.col("cum_profit")
    return out.withColumns({"drawdown": fall, "drawdown_share": fall / F.col("peak"), "drawdown_soft": fall / (F.col("peak") + 1e-10), "drawdown_percent": 100 * fall / F.col("peak")})


def compounded(bets: DataFrame, keys: list[str], order: list[str], share: str, initial: float = 1000.0, exact: bool = True) -> DataFrame:
    """Bankroll after each bet of a share of it: the initial one times a running product, no loop.

    growth is the logarithm of that product, which stays finite where the bankroll is too large for a number. The product
    is a tree's, to the last bit that of DuckDB's windows; not exact, it goes day by day, all in built-in functions, and
    where only growth is asked for Spark leaves it out.
    """
    gain = F.when(F.col("won") == 1, F.col("odds") - 1).otherwise(-1.0)
    factor = 1 + F.col(share) * gain
    log = F.when(factor > 0, F.ln(factor)).otherwise(F.when(factor <= 0, float("-inf")))
    day, growth = F.col(order[0]), {"growth": ("sum", log)}
    if exact:
        out = running_product(bets, keys, day, order, "bankroll", factor, growth)
    else:
        out = running(bets, keys, day, order, {"bankroll": ("product", factor), **growth})
    return out.withColumn("bankroll", initial * F.col("bankroll"))
