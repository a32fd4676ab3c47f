"""Registered queries of the library with their SQL for DuckDB, by operator ids of the survey."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.functions import scalars as S
from tallyline.operators import aggregates as A
from tallyline.operators import asof, backtest, decision, joins, ledger, models
from tallyline.operators import features as features_
from tallyline.operators.contests import SQL as C0
from tallyline.operators.contests import appearances, contests
from tallyline.plans.registry import query
from tallyline.session import table
from tallyline.sources import tables as sources

def dated(df: DataFrame, *columns: str) -> DataFrame:
    """Dates as text, which every engine prints alike."""
    return df.withColumns({c: F.col(c).cast("string") for c in columns})


def rounded(column, digits: int = 9):
    """Rounded, and never minus zero."""
    return F.round(column, digits) + F.lit(0.0)


def rounded_by_product(column, digits: int) -> Column:
    """Rounded as DuckDB rounds doubles, by a product and a quotient; Spark's own goes by the shortest decimals, which differs for large values."""
    c, times = F.col(column), F.lit(10.0**digits)
    out = F.round(c * times) / times
    return F.when(F.abs(out) < float("inf"), out).otherwise(c) + F.lit(0.0)


#: A probability of the first side that both engines compute alike: the market's fair one, moved by the contest's number.
P1 = "greatest(0.05, least(0.95, (1 / odd1) / (1 / odd1 + 1 / odd2) + (contest_id % 41 - 20) / 100.0))"


def priced(spark: SparkSession, sf_dir: str) -> DataFrame:
    fair = S.devig("odd1", "odd2")
    p = F.greatest(F.lit(0.05), F.least(F.lit(0.95), fair + (F.col("contest_id") % 41 - 20) / 100.0))
    return contests(spark, sf_dir).withColumn("p1_prob", p)


def bets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A flat bet on the side of value of each contest: stake 10."""
    v = decision.value_side(priced(spark, sf_dir))
    v = v.withColumn("stake", F.lit(10.0)).withColumn("profit", F.when(F.col("won") == 1, 10.0 * (F.col("odds") - 1)).otherwise(-10.0))
    return v.select("contest_id", "date", "surface", "series", "status", "side", "odds", "prob", "edge", "won", "stake", "profit")


PRICED = f"{C0}, priced AS (SELECT *, {P1} AS p1_prob FROM c0)"
BETS = f"""{PRICED}, sided AS (SELECT *, p1_prob - 1 / odd1 AS e1, 1 - p1_prob - 1 / odd2 AS e2 FROM priced),
bets AS (SELECT contest_id, date, surface, series, status, CASE WHEN e1 >= e2 THEN 1 ELSE 2 END AS side, CASE WHEN e1 >= e2 THEN odd1 ELSE odd2 END AS odds,
  CASE WHEN e1 >= e2 THEN p1_prob ELSE 1 - p1_prob END AS prob, greatest(e1, e2) AS edge, CASE WHEN e1 >= e2 THEN win1 ELSE 1 - win1 END AS won, 10.0::DOUBLE AS stake,
  CASE WHEN (CASE WHEN e1 >= e2 THEN win1 ELSE 1 - win1 END) = 1 THEN 10.0 * ((CASE WHEN e1 >= e2 THEN odd1 ELSE odd2 END) - 1) ELSE -10.0 END AS profit FROM sided)"""
MEASURES = """count(*) AS n, CAST(sum(won) AS BIGINT) AS wins, round(avg(won), 6) AS win_rate, round(sum(stake), 4) AS staked, round(sum(profit), 4) AS profit, round(sum(profit) / sum(stake), 6) AS roi"""


@query("a07_segments", f"WITH {BETS} SELECT 'surface' AS segment, surface AS value, {MEASURES} FROM bets GROUP BY surface UNION ALL SELECT 'series', series, {MEASURES} FROM bets GROUP BY series UNION ALL SELECT 'status', status, {MEASURES} FROM bets GROUP BY status")
def a07_segments(spark, sf_dir):
    return A.segments(bets(spark, sf_dir), ["surface", "series", "status"])


@query("a06_monthly", f"WITH {BETS} SELECT CAST(CAST(date_trunc('month', date) AS DATE) AS VARCHAR) AS period, {MEASURES} FROM bets GROUP BY 1")
def a06_monthly(spark, sf_dir):
    return dated(A.by_period(bets(spark, sf_dir), "month"), "period")


@query("a04_annual", f"WITH {BETS} SELECT CAST(CAST(date_trunc('year', date) AS DATE) AS VARCHAR) AS period, {MEASURES} FROM bets GROUP BY 1")
def a04_annual(spark, sf_dir):
    return dated(A.by_period(bets(spark, sf_dir), "year"), "period")


_BAND = "CASE WHEN odds > 1 AND odds <= 1.3 THEN '(1, 1.3]' WHEN odds > 1.3 AND odds <= 1.6 THEN '(1.3, 1.6]' WHEN odds > 1.6 AND odds <= 2 THEN '(1.6, 2]' WHEN odds > 2 AND odds <= 3 THEN '(2, 3]' WHEN odds > 3 AND odds <= 5 THEN '(3, 5]' WHEN odds > 5 AND odds <= 50 THEN '(5, 50]' END"


@query("a14_niches", f"WITH {BETS} SELECT surface, {_BAND} AS odds_band, status, {MEASURES} FROM bets GROUP BY 1, 2, 3 HAVING count(*) >= 30")
def a14_niches(spark, sf_dir):
    b = bets(spark, sf_dir).withColumn("odds_band", S.bucket("odds", S.ODDS_EDGES, S.ODDS_LABELS))
    return A.niches(b, ["surface", "odds_band", "status"], 30)


@query("a16_threshold_sweep", f"WITH {BETS} SELECT threshold, {MEASURES} FROM bets, (SELECT unnest([-0.1, -0.05, 0.0, 0.02, 0.05, 0.1]::DOUBLE[]) AS threshold) WHERE edge > threshold GROUP BY threshold")
def a16_threshold_sweep(spark, sf_dir):
    return A.sweep(bets(spark, sf_dir), "edge", [-0.1, -0.05, 0.0, 0.02, 0.05, 0.1])


@query("a15_strategies", f"""WITH {BETS}, named AS (SELECT 'favourite' AS strategy, * FROM bets WHERE odds < 2 UNION ALL SELECT 'outsider', * FROM bets WHERE odds >= 3
UNION ALL SELECT 'late', * FROM bets WHERE status = 'F' UNION ALL SELECT 'contrarian', * FROM bets WHERE prob < 0.5 AND edge > 0.05) SELECT strategy, {MEASURES} FROM named GROUP BY 1 HAVING count(*) >= 20""")
def a15_strategies(spark, sf_dir):
    c = F.col
    return A.predicates(bets(spark, sf_dir), {"favourite": c("odds") < 2, "outsider": c("odds") >= 3, "late": c("status") == "F", "contrarian": (c("prob") < 0.5) & (c("edge") > 0.05)})


@query("a12_calibration", f"WITH {BETS} SELECT bin, n, mean_p, rate, round(rate - mean_p, 6) AS error FROM (SELECT CAST(least(floor(prob * 10), 9) AS INTEGER) AS bin, count(*) AS n, round(avg(prob), 6) AS mean_p, round(avg(won), 6) AS rate FROM bets GROUP BY 1)")
def a12_calibration(spark, sf_dir):
    return A.calibration(bets(spark, sf_dir), "prob", "won")


@query("a30_histogram", "SELECT CAST(least(floor((o_totalprice - lo) / (hi - lo) * 50), 49) AS INTEGER) AS bin, count(*) AS n FROM orders, (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders) GROUP BY 1")
def a30_histogram(spark, sf_dir):
    return A.histogram(table(spark, sf_dir, "orders"), "o_totalprice", 50)


@query("a11_profile", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", '{t}' AS type, count({c}) AS filled, round(1 - count({c}) / count(*), 6) AS null_share, count(DISTINCT {c}) AS \"distinct\", CAST(min({c}) AS VARCHAR) AS example FROM part"
    for c, t in (("p_partkey", "bigint"), ("p_name", "string"), ("p_brand", "string"), ("p_type", "string"), ("p_size", "int"))))
def a11_profile(spark, sf_dir):
    return A.profile(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size"))


@query("a08_value_counts", f"WITH {C0} SELECT surface, series, count(*) AS n FROM c0 GROUP BY 1, 2")
def a08_value_counts(spark, sf_dir):
    return A.value_counts(contests(spark, sf_dir), ["surface", "series"])


@query("a22_percentiles", f"WITH {BETS} SELECT surface, round(quantile_cont(odds, 0.05), 6) AS p05, round(quantile_cont(odds, 0.5), 6) AS p50, round(quantile_cont(odds, 0.95), 6) AS p95, round(stddev_pop(profit), 6) AS sd_pop, round(stddev_samp(profit), 6) AS sd_samp FROM bets GROUP BY 1")
def a22_percentiles(spark, sf_dir):
    b = bets(spark, sf_dir)
    spread = b.groupBy("surface").agg(F.round(F.stddev_pop("profit"), 6).alias("sd_pop"), F.round(F.stddev_samp("profit"), 6).alias("sd_samp"))
    p = A.percentiles(b, ["surface"], "odds", {"p05": 0.05, "p50": 0.5, "p95": 0.95})
    return p.join(spread, "surface").select("surface", *(F.round(c, 6).alias(c) for c in ("p05", "p50", "p95")), "sd_pop", "sd_samp")


# Ledger: orders are bets, their customers users.
def ledger_bets(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    odds = F.round(1.2 + F.col("o_orderkey") % 30 / 10, 2)
    status = F.when(F.col("o_orderstatus") == "O", "open").otherwise("resolved")
    result = F.when(F.col("o_orderstatus") != "O", F.when(F.col("o_orderkey") % 10 == 0, "void").when(F.col("o_orderkey") % 2 == 0, "win").otherwise("loss"))
    b = o.select(F.col("o_orderkey").alias("bet_id"), F.col("o_custkey").alias("user_id"), (F.col("o_orderkey") % 997).alias("event_id"), F.when(F.col("o_orderkey") % 3 == 0, "a").otherwise("b").alias("pick"), F.col("o_totalprice").alias("stake"), odds.alias("odds"), status.alias("status"), result.alias("result"))
    return b.withColumn("profit", F.when(F.col("result").isNotNull(), S.settled_profit("stake", "odds", "result")))


LEDGER = """lb AS (SELECT o_orderkey AS bet_id, o_custkey AS user_id, o_orderkey % 997 AS event_id, CASE WHEN o_orderkey % 3 = 0 THEN 'a' ELSE 'b' END AS pick, o_totalprice AS stake,
  round(1.2::DOUBLE + (o_orderkey % 30) / 10.0::DOUBLE, 2) AS odds, CASE WHEN o_orderstatus = 'O' THEN 'open' ELSE 'resolved' END AS status,
  CASE WHEN o_orderstatus <> 'O' THEN CASE WHEN o_orderkey % 10 = 0 THEN 'void' WHEN o_orderkey % 2 = 0 THEN 'win' ELSE 'loss' END END AS result FROM orders),
lbets AS (SELECT *, CASE WHEN result = 'win' THEN stake * (odds - 1) WHEN result = 'loss' THEN -stake WHEN result = 'void' THEN 0.0 END AS profit FROM lb)"""


@query("a01_user_stats", f"""WITH {LEDGER} SELECT user_id, count(*) AS n_bets, count(*) FILTER (status = 'open') AS n_open, count(*) FILTER (status = 'resolved') AS n_resolved, count(*) FILTER (result = 'win') AS wins,
round(coalesce(100.0 * count(*) FILTER (result = 'win') / nullif(count(*) FILTER (status = 'resolved' AND result <> 'void'), 0), 0), 4) AS win_rate,
round(coalesce(100.0 * sum(profit) / nullif(sum(stake) FILTER (status = 'resolved' AND result <> 'void'), 0), 0), 4) AS roi FROM lbets GROUP BY user_id""")
def a01_user_stats(spark, sf_dir):
    return A.user_stats(ledger_bets(spark, sf_dir))


@query("a02_bankroll", f"""WITH {LEDGER} SELECT c_custkey AS user_id, c_acctbal AS initial, round(c_acctbal + coalesce(m, 0), 2) AS bankroll FROM customer
LEFT JOIN (SELECT user_id, sum(CASE WHEN status = 'resolved' THEN coalesce(profit, 0) ELSE -stake END) AS m FROM lbets GROUP BY 1) ON user_id = c_custkey""")
def a02_bankroll(spark, sf_dir):
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_acctbal").alias("initial"))
    return A.bankrolls(users, ledger_bets(spark, sf_dir))


@query("a21_event_status", f"""WITH {LEDGER}, w AS (SELECT event_id, bool_or(status = 'open') AS any_open, bool_and(coalesce(result = 'void', false)) AS only_void,
  list_sort(list_distinct(list(CASE WHEN result = 'win' THEN pick WHEN result = 'loss' THEN CASE WHEN pick = 'a' THEN 'b' ELSE 'a' END END) FILTER (result IN ('win', 'loss')))) AS winners FROM lbets GROUP BY 1)
SELECT event_id, CASE WHEN any_open THEN 'upcoming' ELSE 'completed' END AS status, CASE WHEN any_open THEN NULL WHEN only_void THEN 'void' WHEN len(winners) = 1 THEN winners[1] END AS winner_side FROM w""")
def a21_event_status(spark, sf_dir):
    return A.event_status(ledger_bets(spark, sf_dir))


@query("l04_settlement", f"""WITH {LEDGER}, res AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'a' WHEN 1 THEN 'b' WHEN 2 THEN 'void' END AS winner_side FROM (SELECT DISTINCT event_id FROM lbets)),
s AS (SELECT bet_id, stake, odds, lbets.status AS old_status, CASE WHEN winner_side = 'void' THEN 'void' WHEN winner_side = pick THEN 'win' WHEN winner_side IS NOT NULL THEN 'loss' END AS result FROM lbets LEFT JOIN res USING (event_id))
SELECT bet_id, result, CASE WHEN result IS NOT NULL THEN 'resolved' ELSE old_status END AS status, round(CASE WHEN result = 'win' THEN stake * (odds - 1) WHEN result = 'loss' THEN -stake WHEN result = 'void' THEN 0.0 END, 4) AS profit FROM s""")
def l04_settlement(spark, sf_dir):
    b = ledger_bets(spark, sf_dir)
    e = F.col("event_id") % 4
    res = b.select("event_id").distinct().withColumn("winner_side", F.when(e == 0, "a").when(e == 1, "b").when(e == 2, "void"))
    return ledger.settled(b, res).select("bet_id", "result", "status", F.round("profit", 4).alias("profit"))


@query("l03_place_bet", """WITH ev AS (SELECT p_partkey AS event_id, round(1.1::DOUBLE + p_size / 20.0::DOUBLE, 2) AS odds_a, round(2.9::DOUBLE - p_size / 50.0::DOUBLE, 2) AS odds_b, 0.5::DOUBLE AS prob_a, CASE WHEN p_partkey % 5 = 0 THEN 'completed' ELSE 'upcoming' END AS status FROM part),
rq AS (SELECT o_custkey AS user_id, o_orderkey % 2500 AS event_id, CASE WHEN o_orderkey % 2 = 0 THEN 'a' ELSE 'b' END AS pick, CAST(floor(o_totalprice / 100) AS DOUBLE) AS stake FROM orders),
j AS (SELECT user_id, event_id, pick, stake, CASE WHEN pick = 'a' THEN odds_a ELSE odds_b END AS odds, CASE WHEN pick = 'a' THEN prob_a ELSE 1 - prob_a END AS prob, status, c_acctbal AS bankroll FROM rq LEFT JOIN ev USING (event_id) LEFT JOIN customer ON c_custkey = user_id)
SELECT user_id, event_id, pick, stake, odds, round(CASE WHEN odds > 1 THEN prob - 1 / odds END, 6) AS edge, round(prob * odds - 1, 6) AS ev,
CASE WHEN status IS NULL THEN 'no event' WHEN status <> 'upcoming' THEN 'closed' WHEN NOT coalesce(odds > 1, false) THEN 'odds' WHEN NOT stake > 0 THEN 'stake' WHEN stake > coalesce(bankroll, 0) THEN 'balance' END AS refused FROM j""")
def l03_place_bet(spark, sf_dir):
    c = F.col
    ev = table(spark, sf_dir, "part").select(c("p_partkey").alias("event_id"), F.round(1.1 + c("p_size") / 20.0, 2).alias("odds_a"), F.round(2.9 - c("p_size") / 50.0, 2).alias("odds_b"), F.lit(0.5).alias("prob_a"), F.when(c("p_partkey") % 5 == 0, "completed").otherwise("upcoming").alias("status"))
    rq = table(spark, sf_dir, "orders").select(c("o_custkey").alias("user_id"), (c("o_orderkey") % 2500).alias("event_id"), F.when(c("o_orderkey") % 2 == 0, "a").otherwise("b").alias("pick"), F.floor(c("o_totalprice") / 100).cast("double").alias("stake"))
    users = table(spark, sf_dir, "customer").select(c("c_custkey").alias("user_id"), c("c_acctbal").alias("bankroll"))
    return ledger.placed(ev, rq, users).withColumns({"edge": F.round("edge", 6), "ev": F.round("ev", 6)})


# As-of windows.
_H = "FROM app WINDOW pl AS (PARTITION BY player ORDER BY date, contest_id, side), su AS (PARTITION BY player, surface ORDER BY date, contest_id, side), op AS (PARTITION BY player, opponent ORDER BY date, contest_id, side), os AS (PARTITION BY player, opponent, surface ORDER BY date, contest_id, side)"
_F = lambda n: f"round(coalesce(avg(won) OVER (PARTITION BY player ORDER BY date, contest_id, side ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING), 0.5), 6)"
_RATE = lambda h, d: f"list_filter({h}, lambda x: x.d >= date - {d})"
_W = "PARTITION BY player ORDER BY date, contest_id, side"


@query("w01_w10_player_features", f"""WITH {C0}, h AS (SELECT contest_id, side, player, date,
  {_F(3)} AS form_3, {_F(5)} AS form_5, {_F(10)} AS form_10, {_F(20)} AS form_20,
  list({{'d': date, 'w': won}}) OVER ({_W} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS l20,
  list(date) OVER ({_W} ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING) AS l30,
  list({{'d': date, 'w': won}}) OVER (PARTITION BY player, surface ORDER BY date, contest_id, side ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING) AS s50,
  count(won) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS matches,
  CAST(coalesce(sum(won) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS wins,
  CAST(coalesce(sum(CAST(series = 'Grand Slam' AS INTEGER)) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS slam_experience,
  CAST(coalesce(date - lag(date) OVER ({_W}), -1) AS INTEGER) AS days_since,
  count(won) OVER (PARTITION BY player, opponent ORDER BY date, contest_id, side ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS h2h_total,
  round(coalesce(avg(won) OVER (PARTITION BY player, opponent ORDER BY date, contest_id, side ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.5), 6) AS h2h_rate,
  round(coalesce(avg(won) OVER (PARTITION BY player, opponent, surface ORDER BY date, contest_id, side ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.5), 6) AS h2h_surface_rate FROM app),
r AS (SELECT *, list_avg(list_transform({_RATE('l20', 365)}, lambda x: x.w)) AS g365,
  list_avg(list_transform({_RATE('s50', 90)}, lambda x: x.w)) AS s90, list_avg(list_transform({_RATE('s50', 180)}, lambda x: x.w)) AS s180, list_avg(list_transform({_RATE('s50', 365)}, lambda x: x.w)) AS s365 FROM h)
SELECT contest_id, side, player, form_3, form_5, form_10, form_20, matches, wins, slam_experience, days_since, h2h_total, h2h_rate, h2h_surface_rate,
  round(coalesce(s90, 0.5), 6) AS surface_rate_90, round(coalesce(s180, 0.5), 6) AS surface_rate_180, round(coalesce(s365, 0.5), 6) AS surface_rate_365,
  round(CASE WHEN coalesce(g365, 0) > 0 THEN least(3.0, coalesce(s365, 0.5) / g365) ELSE 1.0 END, 6) AS surface_specialist,
  CAST(coalesce(len(list_filter(l30, lambda x: x >= date - 14)), 0) AS INTEGER) AS fatigue_14,
  CAST(coalesce(date - list_max(list_filter(l30, lambda x: x < date)), 30) AS INTEGER) AS days_rest, round(form_5 - form_20, 4) AS momentum FROM r""")
def w01_w10_player_features(spark, sf_dir):
    out = asof.player_features(appearances(contests(spark, sf_dir)))
    names = ["form_3", "form_5", "form_10", "form_20", "h2h_rate", "h2h_surface_rate", "surface_rate_90", "surface_rate_180", "surface_rate_365", "surface_specialist"]
    out = out.withColumns({n: F.round(n, 6) for n in names}).withColumns({"momentum": F.round(F.col("form_5") - F.col("form_20"), 4), "days_since": F.coalesce("days_since", F.lit(-1))})
    return out.select("contest_id", "side", "player", *names[:4], "matches", "wins", "slam_experience", "days_since", "h2h_total", *names[4:], "fatigue_14", "days_rest", "momentum")


@query("w11_w12_monthly_rates", f"""WITH {C0}, h AS (SELECT contest_id, side, date, list({{'d': date, 'w': won}}) OVER (PARTITION BY player, surface ORDER BY date, contest_id, side ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l,
  count(won) OVER ({_W} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS c, avg(won) OVER ({_W} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS a FROM app),
f AS (SELECT *, list_filter(l, lambda x: x.d >= date - INTERVAL 6 MONTH) AS k FROM h)
SELECT contest_id, side, round(CASE WHEN len(k) >= 3 THEN list_avg(list_transform(k, lambda x: x.w)) ELSE 0.5 END, 6) AS surface_rate_6m, round(CASE WHEN c >= 10 THEN a ELSE 0.5 END, 6) AS form_10_full FROM f""")
def w11_w12_monthly_rates(spark, sf_dir):
    app = appearances(contests(spark, sf_dir)).withColumn("form_10_full", F.round(asof.form(10, 10), 6))
    return asof.monthly_surface_rate(app, 6).select("contest_id", "side", F.round("surface_rate_6m", 6).alias("surface_rate_6m"), "form_10_full")


@query("w13_pair_history", f"""WITH {C0}, k AS (SELECT contest_id, date, p1, p2, win1, least(p1, p2) AS a, greatest(p1, p2) AS b, CASE WHEN p1 < p2 THEN win1 ELSE 1 - win1 END AS w FROM c0),
h AS (SELECT *, count(w) OVER (PARTITION BY a, b ORDER BY date, contest_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pair_total, avg(w) OVER (PARTITION BY a, b ORDER BY date, contest_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM k)
SELECT contest_id, pair_total, round(coalesce(CASE WHEN p1 = a THEN r ELSE 1 - r END, 0.5), 6) AS pair_rate FROM h""")
def w13_pair_history(spark, sf_dir):
    return asof.pair_history(contests(spark, sf_dir)).select("contest_id", "pair_total", F.round("pair_rate", 6).alias("pair_rate"))


@query("w15_w18_trailing", f"""WITH {C0} SELECT contest_id, side, round(avg(odds) OVER ({_W} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 6) AS odds_l5, round(avg(won) OVER ({_W} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 6) AS won_l5,
round(avg(odds) OVER ({_W} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS odds_live, CAST(row_number() OVER ({_W}) - 1 AS INTEGER) AS prior FROM app""")
def w15_w18_trailing(spark, sf_dir):
    app = appearances(contests(spark, sf_dir))
    live = asof.trailing(app.withColumn("odds_", F.col("odds")), ["odds_"], current=True).withColumnRenamed("odds__l5", "odds_live")
    out = asof.trailing(live, ["odds", "won"]).withColumn("prior", F.row_number().over(asof.by("player")) - 1)
    return out.select("contest_id", "side", *(F.round(c, 6).alias(c) for c in ("odds_l5", "won_l5", "odds_live")), "prior")


@query("w19_w20_equity", f"""WITH {BETS}, e AS (SELECT surface, contest_id, date, 1000 + sum(profit) OVER w AS bank FROM bets WINDOW w AS (PARTITION BY surface ORDER BY date, contest_id ROWS UNBOUNDED PRECEDING)),
p AS (SELECT *, greatest(1000.0::DOUBLE, max(bank) OVER (PARTITION BY surface ORDER BY date, contest_id ROWS UNBOUNDED PRECEDING)) AS peak FROM e)
SELECT surface, contest_id, round(bank - 1000, 4) AS cum_profit, round(peak, 4) AS peak, round(peak - bank, 4) AS drawdown FROM p""")
def w19_w20_equity(spark, sf_dir):
    out = asof.equity(bets(spark, sf_dir), ["surface"], ["date", "contest_id"])
    return out.select("surface", "contest_id", *(F.round(c, 4).alias(c) for c in ("cum_profit", "peak", "drawdown")))


@query("w21_losing_streak", f"""WITH {BETS}, g AS (SELECT surface, won, row_number() OVER (PARTITION BY surface ORDER BY date, contest_id) - row_number() OVER (PARTITION BY surface, won ORDER BY date, contest_id) AS g FROM bets)
SELECT surface, max(c) AS longest_losing_streak FROM (SELECT surface, count(*) AS c FROM g WHERE won = 0 GROUP BY surface, g) GROUP BY surface""")
def w21_losing_streak(spark, sf_dir):
    return asof.losing_streak(bets(spark, sf_dir), ["surface"], ["date", "contest_id"])


@query("w22_sessions", """WITH g AS (SELECT user_id, ts, CASE WHEN date_diff('day', CAST(lag(ts) OVER w AS DATE), CAST(ts AS DATE)) > 1 THEN 1 ELSE 0 END AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, 1 + sum(n) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS edition FROM g) SELECT user_id, CAST(edition AS BIGINT) AS edition, count(*) AS n FROM s GROUP BY 1, 2""")
def w22_sessions(spark, sf_dir):
    return asof.editions(table(spark, sf_dir, "events"), "user_id", "ts", 1).groupBy("user_id", "edition").agg(F.count(F.lit(1)).alias("n"))


@query("w24_latest", f"WITH {C0} SELECT player, contest_id, side, CAST(r AS INTEGER) AS recency FROM (SELECT *, row_number() OVER (PARTITION BY player ORDER BY date DESC, contest_id DESC, side DESC) AS r FROM app) WHERE r <= 5")
def w24_latest(spark, sf_dir):
    return asof.latest(appearances(contests(spark, sf_dir)), 5).select("player", "contest_id", "side", "recency")


@query("w28_snapshot", f"""WITH {C0}, r AS (SELECT *, row_number() OVER (PARTITION BY player ORDER BY date DESC, contest_id DESC) AS k FROM app WHERE date < DATE '2000-01-01')
SELECT player, round(avg(won) FILTER (k <= 5), 6) AS form, round(avg(won) FILTER (date >= DATE '1999-01-01'), 6) AS recent_rate, count(*) FILTER (date >= DATE '1999-12-18') AS fatigue, CAST(max(date) AS VARCHAR) AS last_date FROM r GROUP BY player""")
def w28_snapshot(spark, sf_dir):
    return dated(asof.snapshot(appearances(contests(spark, sf_dir)), "2000-01-01"), "last_date").withColumns({"form": F.round("form", 6), "recent_rate": F.round("recent_rate", 6)})


@query("w27_compounding", f"""WITH {BETS}, s AS (SELECT surface, contest_id, date, 1 + 0.01::DOUBLE * (CASE WHEN won = 1 THEN odds - 1 ELSE -1 END) AS f FROM bets WHERE edge > 0)
SELECT surface, contest_id, round(1000 * product(f) OVER (PARTITION BY surface ORDER BY date, contest_id ROWS UNBOUNDED PRECEDING), 3) AS bankroll FROM s""")
def w27_compounding(spark, sf_dir):
    b = bets(spark, sf_dir).where("edge > 0").select("surface", "contest_id", "date", "odds", "won", F.lit(0.01).alias("share"))
    return backtest.compounding(b, ["surface"]).select("surface", "contest_id", rounded_by_product("bankroll", 3).alias("bankroll"))


# Decisions and back-tests.
@query("b01_refusals", f"""WITH {PRICED}, rules AS (SELECT * FROM (VALUES ('confident', 0.72, 0.05, 0.03, [], []), ('standard', 0.62, 0.03, 0.02, ['Grand Slam', 'Masters 1000', 'ATP500'], []), ('volume', 0.57, 0.02, 0.01, [], []), ('specialist', 0.60, 0.03, 0.02, [], ['Clay'])) r(strategy, th, me, mv, se, su)),
s AS (SELECT series, surface, p1_prob AS p, odd1 AS o FROM priced UNION ALL SELECT series, surface, 1 - p1_prob, odd2 FROM priced)
SELECT strategy, CASE WHEN p < th::DOUBLE THEN 'probability' WHEN p - 1 / o < me::DOUBLE THEN 'edge' WHEN p * o - 1 < mv::DOUBLE THEN 'value' WHEN o < 1.2::DOUBLE THEN 'odds too low' WHEN o > 6.2::DOUBLE THEN 'odds too high'
  WHEN len(se) > 0 AND NOT list_contains(se, series) THEN 'series' WHEN len(su) > 0 AND NOT list_contains(su, surface) THEN 'surface' ELSE 'eligible' END AS reason, count(*) AS n FROM s, rules GROUP BY 1, 2""")
def b01_refusals(spark, sf_dir):
    return decision.refusals(priced(spark, sf_dir), decision.STRATEGIES)


@query("b20_value_side", f"WITH {BETS} SELECT contest_id, side, odds, round(prob, 9) AS prob, round(edge, 9) + 0.0 AS edge, won FROM bets")
def b20_value_side(spark, sf_dir):
    return bets(spark, sf_dir).select("contest_id", "side", "odds", F.round("prob", 9).alias("prob"), rounded("edge").alias("edge"), "won")


@query("b24_explained", f"""WITH {PRICED}, f AS (SELECT *, (1 / odd1) / (1 / odd1 + 1 / odd2) AS fair FROM priced) SELECT contest_id, round(1 / odd1, 9) + 0.0 AS implied_1, round(1 / odd2, 9) + 0.0 AS implied_2, round(1 / odd1 + 1 / odd2 - 1, 9) + 0.0 AS margin, round(fair, 9) + 0.0 AS fair_1,
round(ln(greatest(0.01, least(0.99, fair)) / (1 - greatest(0.01, least(0.99, fair)))), 9) + 0.0 AS market_logit, round(p1_prob * odd1 - 1, 9) + 0.0 AS ev_1, round((1 - p1_prob) * odd2 - 1, 9) + 0.0 AS ev_2,
CASE WHEN p1_prob - fair >= 0.0451 THEN 'bet 1' WHEN fair - p1_prob >= 0.0451 THEN 'bet 2' ELSE 'pass' END AS decision FROM f""")
def b24_explained(spark, sf_dir):
    out = decision.explained(priced(spark, sf_dir), min_edge=0.0451)
    return out.select("contest_id", *(rounded(c).alias(c) for c in ("implied_1", "implied_2", "margin", "fair_1", "market_logit", "ev_1", "ev_2")), "decision")


@query("b06_metrics", f"""WITH {BETS}, e AS (SELECT *, 1000 + sum(profit) OVER w AS bank FROM bets WINDOW w AS (PARTITION BY surface ORDER BY date, contest_id ROWS UNBOUNDED PRECEDING)),
p AS (SELECT *, greatest(1000.0::DOUBLE, max(bank) OVER (PARTITION BY surface ORDER BY date, contest_id ROWS UNBOUNDED PRECEDING)) AS peak FROM e),
d AS (SELECT surface, avg(x) AS m, stddev_pop(x) AS s FROM (SELECT surface, date, sum(profit) AS x FROM bets GROUP BY 1, 2) GROUP BY 1),
mo AS (SELECT surface, avg(x) AS m, stddev_samp(x) AS s FROM (SELECT surface, date_trunc('month', date) AS t, sum(profit) AS x FROM bets GROUP BY 1, 2) GROUP BY 1),
g AS (SELECT surface, count(*) AS n, CAST(sum(won) AS BIGINT) AS wins, avg(won) AS hr, sum(stake) AS st, sum(profit) AS pr, max((peak - bank) / peak) AS mdd, avg(profit) AS m, stddev_samp(profit) AS s,
  sum(CASE WHEN profit > 0 THEN profit ELSE 0 END) / sum(CASE WHEN profit < 0 THEN -profit ELSE 0 END) AS pf FROM p GROUP BY 1)
SELECT surface, n, wins, round(hr, 6) AS hit_rate, round(pr, 3) AS profit, round(pr / st, 6) AS roi, round(mdd, 6) AS max_drawdown, round(g.m / g.s * sqrt(n), 4) AS sharpe_bet, round(d.m / d.s * sqrt(252), 4) AS sharpe_daily, round(mo.m / mo.s * sqrt(12), 4) AS sharpe_monthly, round(pr / st / mdd, 4) AS calmar, round(pf, 6) AS profit_factor
FROM g JOIN d USING (surface) JOIN mo USING (surface)""")
def b06_metrics(spark, sf_dir):
    m = backtest.metrics(bets(spark, sf_dir), ["surface"])
    digits = {"hit_rate": 6, "profit": 3, "roi": 6, "max_drawdown": 6, "sharpe_bet": 4, "sharpe_daily": 4, "sharpe_monthly": 4, "calmar": 4, "profit_factor": 6}
    return m.select("surface", "n", "wins", *(F.round(c, d).alias(c) for c, d in digits.items()))


@query("b02_drawdown_gate", f"""WITH {BETS}, e AS (SELECT *, 1000 + sum(profit) OVER w AS bank FROM bets WINDOW w AS (PARTITION BY surface ORDER BY date, contest_id ROWS UNBOUNDED PRECEDING)),
p AS (SELECT *, greatest(1000.0::DOUBLE, max(bank) OVER (PARTITION BY surface ORDER BY date, contest_id ROWS UNBOUNDED PRECEDING)) AS peak FROM e)
SELECT surface, contest_id, coalesce(max(CAST((peak - bank) / peak >= 0.25 AS INTEGER)) OVER (PARTITION BY surface ORDER BY date, contest_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS blocked FROM p""")
def b02_drawdown_gate(spark, sf_dir):
    return backtest.drawdown_gate(bets(spark, sf_dir), ["surface"]).select("surface", "contest_id", "blocked")


@query("f04_kelly", f"""WITH {PRICED} SELECT contest_id, round(CASE WHEN k <= 0 THEN 0.0 ELSE greatest(0.01, least(k / 4, 0.05)) END, 9) AS share, round(k, 9) + 0.0 AS kelly, round(greatest(0.0, k) / 2.75 * 1000, 2) AS uncapped
FROM (SELECT contest_id, (p1_prob * (odd1 - 1) - (1 - p1_prob)) / (odd1 - 1) AS k FROM priced)""")
def f04_kelly(spark, sf_dir):
    c = priced(spark, sf_dir)
    return c.select("contest_id", rounded(S.kelly_share("p1_prob", "odd1")).alias("share"), rounded(S.raw_kelly("p1_prob", "odd1")).alias("kelly"), S.capped_kelly("p1_prob", "odd1", F.lit(1000.0), 2.75, 1.0).alias("uncapped"))


@query("f01_f03_rating_scalars", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(1 / (1 + pow(10.0, (l_quantity * 10 - l_partkey % 400) / 400.0)), 6) AS expected,
round(32.0 * CASE WHEN l_suppkey % 150 < 30 THEN 1.0 WHEN l_suppkey % 150 < 100 THEN 0.85 ELSE 0.7 END * (0.85 + 0.3 * l_discount * 10), 6) AS k,
round(CASE WHEN l_partkey % 500 > 30 THEN 1500 * (1 - greatest(pow(0.5, (l_partkey % 500) / 180.0), 0.85)) + (1400 + l_quantity) * greatest(pow(0.5, (l_partkey % 500) / 180.0), 0.85) ELSE 1400 + l_quantity END, 6) AS decayed FROM lineitem""")
def f01_f03_rating_scalars(spark, sf_dir):
    c = F.col
    k = S.dynamic_k(32.0, c("l_suppkey") % 150, c("l_discount") * 10)
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(S.expected_score(c("l_partkey") % 400, c("l_quantity") * 10), 6).alias("expected"),
        F.round(k, 6).alias("k"), F.round(S.decayed(1400 + c("l_quantity"), c("l_partkey") % 500), 6).alias("decayed"),
    )


@query("f10_f14_prices", f"""WITH {PRICED} SELECT contest_id, round(p1_prob - 1 / odd1, 9) + 0.0 AS edge, round(p1_prob * odd1 - 1, 9) + 0.0 AS ev, round((1 / odd1) / (1 / odd1 + 1 / odd2), 9) + 0.0 AS fair, round(odd1 / odd2 - 1, 9) + 0.0 AS clv,
round(1 / (greatest(0.02, least(0.98, p1_prob)) * 1.05), 9) + 0.0 AS synthetic, CASE WHEN p1_prob * odd1 - 1 > 0.08 THEN 'high' WHEN p1_prob * odd1 - 1 > 0.03 THEN 'medium' ELSE 'low' END AS confidence FROM priced""")
def f10_f14_prices(spark, sf_dir):
    r = lambda x, n: rounded(x).alias(n)
    return priced(spark, sf_dir).select(
        "contest_id", r(S.edge("p1_prob", "odd1"), "edge"), r(S.expected_value("p1_prob", "odd1"), "ev"), r(S.devig("odd1", "odd2"), "fair"), r(S.closing_value("odd1", "odd2"), "clv"),
        r(S.synthetic_odds("p1_prob"), "synthetic"), S.confidence(S.expected_value("p1_prob", "odd1")).alias("confidence"),
    )


#: First names with accents of several languages, put before the customers' own names.
ACCENTED = ("Novak Đoković", "Marin Čilić", "Gaël O'Müller-Ångström", "Iga Świątek", "Łukasz  Kubot", "Štěpánková ĀB", "Nguyễn Văn", "Jean-Zoë")


@query("f19_names", rf"WITH n AS (SELECT c_custkey, {list(ACCENTED)!r}[c_custkey % {len(ACCENTED)} + 1] || ' ' || c_name AS name FROM customer) SELECT c_custkey, trim(regexp_replace(regexp_replace(lower(strip_accents(name)), '[^a-z\s]', '', 'g'), '\s+', ' ', 'g')) AS plain, array_to_string(list_filter(regexp_split_to_array(lower(strip_accents(name)), '[^a-z0-9'']+'), lambda x: x <> ''), ' ') AS tokens FROM n".replace('"Gaël O\'Müller-Ångström"', "'Gaël O''Müller-Ångström'"))
def f19_names(spark, sf_dir):
    n = table(spark, sf_dir, "customer").select("c_custkey", F.concat_ws(" ", F.get(F.lit(list(ACCENTED)), (F.col("c_custkey") % len(ACCENTED)).cast("int")), "c_name").alias("name"))
    return n.select("c_custkey", S.plain_name("name").alias("plain"), F.array_join(S.name_tokens("name"), " ").alias("tokens"))


@query("f38_json", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, event_type FROM events")
def f38_json(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", S.json_field("props", "k").cast("long").alias("k"), "event_type")


# Joins, sets, order.
@query("j02_opponents", f"WITH {C0} SELECT a.contest_id, a.player, b.player AS opp_player, b.odds AS opp_odds FROM app a JOIN app b ON a.contest_id = b.contest_id AND a.player <> b.player")
def j02_opponents(spark, sf_dir):
    return joins.opponent_rows(appearances(contests(spark, sf_dir)), ["player", "odds"]).select("contest_id", "player", "opp_player", "opp_odds")


@query("j09_names", """WITH b AS (SELECT chr(CAST(65 + n_nationkey AS INTEGER)) || 'ab ' || chr(CAST(97 + n_nationkey % 10 AS INTEGER)) || 'last' AS known_name, n_nationkey AS known_seq FROM nation),
a AS (SELECT DISTINCT CASE c_custkey % 4 WHEN 0 THEN known_name WHEN 1 THEN substr(known_name, 1, 1) || 'zz ' || substr(known_name, 5) WHEN 2 THEN 'Zz ' || substr(known_name, 5) ELSE 'Nobody Here' END AS name FROM customer JOIN b ON c_custkey % 25 = known_seq),
p AS (SELECT name, known_name, known_seq, CASE WHEN lower(name) = lower(known_name) THEN 1 WHEN lower(substr(name, 1, 1)) = lower(substr(known_name, 1, 1)) THEN 2 ELSE 3 END AS tier FROM a JOIN b ON substr(name, 5) = substr(known_name, 5) OR substr(name, 4) = substr(known_name, 5)),
m AS (SELECT name, arg_min(known_name, tier * 1000 + known_seq) AS known_name, min(tier) AS tier FROM p GROUP BY name) SELECT a.name, m.known_name, coalesce(m.tier, 0) AS tier FROM a LEFT JOIN m USING (name)""")
def j09_names(spark, sf_dir):
    """Customers under names that equal, share initial and last name, or share the last name of one of 25 known ones."""
    c = F.col
    n = table(spark, sf_dir, "nation").select(c("n_nationkey").alias("known_seq"))
    last = F.concat(F.char(97 + c("known_seq") % 10), F.lit("last"))
    known = n.withColumn("known_name", F.concat(F.char(65 + c("known_seq")), F.lit("ab "), last))
    k = table(spark, sf_dir, "customer").select("c_custkey", (c("c_custkey") % 25).cast("int").alias("known_seq")).join(known, "known_seq")
    kind, tail = c("c_custkey") % 4, F.substring("known_name", 5, 99)
    name = F.when(kind == 0, c("known_name")).when(kind == 1, F.concat(F.left("known_name", F.lit(1)), F.lit("zz "), tail)).when(kind == 2, F.concat(F.lit("Zz "), tail)).otherwise("Nobody Here")
    return joins.match_names(k.select(name.alias("name")), known).withColumn("tier", F.coalesce("tier", F.lit(0)))


@query("j17_latest_by_side", f"""WITH {C0}, one AS (SELECT p1 AS player, arg_max(odd1, (date, contest_id)) AS v FROM c0 GROUP BY 1), two AS (SELECT p2 AS player, arg_max(odd2, (date, contest_id)) AS v FROM c0 GROUP BY 1)
SELECT s_suppkey AS player, coalesce(one.v, two.v, 100.0) AS value FROM supplier LEFT JOIN one ON one.player = s_suppkey LEFT JOIN two ON two.player = s_suppkey""")
def j17_latest_by_side(spark, sf_dir):
    return joins.latest_by_side(contests(spark, sf_dir), table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("player")), "odd1", "odd2", 100.0)


@query("s13_best_prices", """WITH b AS (SELECT l_orderkey AS event_id, 'book' || (l_suppkey % 7) AS name, round(1.1::DOUBLE + l_quantity / 20.0::DOUBLE, 2) AS p1, round(0.9::DOUBLE + l_partkey % 30 / 10.0::DOUBLE, 2) AS p2 FROM lineitem),
v AS (SELECT *, CASE name WHEN 'book3' THEN 1 WHEN 'book1' THEN 2 ELSE 999 END AS r FROM b WHERE p1 > 1 AND p2 > 1)
SELECT event_id, max(p1) AS best_1, max(p2) AS best_2, round(avg(1 / p1) / (avg(1 / p1) + avg(1 / p2)), 6) AS fair_1, CAST(count(*) AS INTEGER) AS n_books, arg_min(name, (r, name, p1, p2)) AS bookmaker, arg_min(p1, (r, name, p1, p2)) AS odds_1, arg_min(p2, (r, name, p1, p2)) AS odds_2 FROM v GROUP BY 1""")
def s13_best_prices(spark, sf_dir):
    c = F.col
    book = F.struct(F.concat(F.lit("book"), (c("l_suppkey") % 7).cast("string")).alias("name"), F.round(1.1 + c("l_quantity") / 20.0, 2).alias("price_1"), F.round(0.9 + c("l_partkey") % 30 / 10.0, 2).alias("price_2"))
    feed = table(spark, sf_dir, "lineitem").groupBy(c("l_orderkey").alias("event_id")).agg(F.collect_list(book).alias("books"))
    # Books of one name can occur twice in this feed, which a map of prices doesn't allow.
    return _best(feed).select("event_id", "best_1", "best_2", F.round("fair_1", 6).alias("fair_1"), "n_books", "bookmaker", "odds_1", "odds_2")


def _best(feed: DataFrame) -> DataFrame:
    return joins.best_prices(feed, ["book3", "book1"]).drop("prices")


@query("u04_u05_keep", "WITH k AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS f, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS l FROM events) SELECT user_id, event_type, max(CASE WHEN f = 1 THEN event_id END) AS first_id, max(CASE WHEN l = 1 THEN event_id END) AS last_id FROM k GROUP BY 1, 2")
def u04_u05_keep(spark, sf_dir):
    e, keys, order = table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id"), ["user_id", "event_type"], ["ts", "event_id"]
    ends = [ledger.keep(e, keys, order, last).select(*keys, F.col("event_id").alias(n)) for last, n in ((False, "first_id"), (True, "last_id"))]
    return ends[0].join(ends[1], keys)


@query("s19_s21_incremental", """WITH old AS (SELECT * FROM events WHERE event_id % 3 > 0 AND ts < TIMESTAMP '2024-01-20'), inc AS (SELECT event_id, ts, user_id, event_type, value + 1 AS value, props FROM events), m AS (SELECT max(ts) AS m FROM old),
fresh AS (SELECT inc.* FROM inc, m WHERE m IS NULL OR ts > m) SELECT event_id, user_id, round(value, 6) AS value FROM old UNION ALL SELECT event_id, user_id, round(value, 6) FROM fresh""")
def s19_s21_incremental(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    old = e.where((F.col("event_id") % 3 > 0) & (F.col("ts") < F.lit("2024-01-20").cast("timestamp_ntz")))
    fresh = ledger.newer(old, e.withColumn("value", F.col("value") + 1), "ts", ["event_id"])
    return ledger.merged(old, fresh, ["event_id"], ["ts"]).select("event_id", "user_id", F.round("value", 6).alias("value"))


@query("u08_upsert", "SELECT c_custkey, c_mktsegment, CASE WHEN c_custkey % 4 = 0 THEN c_acctbal * 2 ELSE c_acctbal END AS c_acctbal FROM customer")
def u08_upsert(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    return ledger.upserted(c, c.where("c_custkey % 4 = 0").withColumn("c_acctbal", F.col("c_acctbal") * 2), ["c_custkey"])


@query("l10_calendar", f"""WITH {C0}, g AS (SELECT surface || series AS tournament, date, CASE WHEN date - lag(date) OVER (PARTITION BY surface || series ORDER BY date) > 20 THEN 1 ELSE 0 END AS n FROM c0),
e AS (SELECT *, 1 + sum(n) OVER (PARTITION BY tournament ORDER BY date RANGE UNBOUNDED PRECEDING) AS edition FROM g)
SELECT tournament, CAST(edition AS BIGINT) AS edition, CAST(min(date) AS VARCHAR) AS start, CAST(max(date) AS VARCHAR) AS "end", count(*) AS n, CASE WHEN max(date) < DATE '1998-06-01' THEN 'past' WHEN min(date) > DATE '1998-06-01' THEN 'coming' ELSE 'running' END AS state FROM e GROUP BY 1, 2""")
def l10_calendar(spark, sf_dir):
    return dated(ledger.calendar(contests(spark, sf_dir).withColumn("tournament", F.concat("surface", "series")), "tournament", "1998-06-01", 20), "start", "end")


@query("s28_freshness", f"WITH {C0} SELECT count(*) AS n, CAST(max(date) AS VARCHAR) AS last_date, (SELECT count(DISTINCT player) FROM app) AS players, CAST(DATE '2001-08-20' - max(date) AS INTEGER) AS age_days, CASE WHEN DATE '2001-08-20' - max(date) <= 7 THEN 'fresh' WHEN DATE '2001-08-20' - max(date) <= 30 THEN 'aging' ELSE 'stale' END AS freshness FROM c0")
def s28_freshness(spark, sf_dir):
    return dated(A.freshness(contests(spark, sf_dir), "date", "2001-08-20", ["p1", "p2"]), "last_date")


@query("s15_links", """SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages""")
def s15_links(spark, sf_dir):
    return sources.links(table(spark, sf_dir, "pages")).select("page_id", "href")


@query("s17_page_facts", """SELECT page_id, regexp_extract(html, '<html lang="([a-z]*)"', 1) AS lang, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, CAST(len(regexp_extract_all(html, '<a href="')) AS INTEGER) AS n_links, CAST(len(regexp_extract_all(html, '<p>')) AS INTEGER) AS n_paragraphs FROM pages""")
def s17_page_facts(spark, sf_dir):
    return sources.page_facts(table(spark, sf_dir, "pages")).drop("id")


@query("e13_differentials", f"""WITH {C0}, t AS (SELECT contest_id, player, avg(odds) OVER ({_W} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS o, avg(won) OVER ({_W} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS w FROM app)
SELECT c0.contest_id, round(a.o - b.o, 6) + 0.0 AS diff_odds_l5, round(a.w - b.w, 6) + 0.0 AS diff_won_l5 FROM c0 LEFT JOIN t a ON a.contest_id = c0.contest_id AND a.player = p1 LEFT JOIN t b ON b.contest_id = c0.contest_id AND b.player = p2""")
def e13_differentials(spark, sf_dir):
    c = contests(spark, sf_dir)
    t = asof.trailing(appearances(c), ["odds", "won"])
    out = features_.differentials(c, t, ["odds_l5", "won_l5"])
    return out.select("contest_id", rounded("diff_odds_l5", 6).alias("diff_odds_l5"), rounded("diff_won_l5", 6).alias("diff_won_l5"))


@query("m09_scores", f"""WITH {BETS}, r AS (SELECT *, rank() OVER (PARTITION BY surface ORDER BY prob) + (count(*) OVER (PARTITION BY surface, prob) - 1) / 2.0 AS k FROM bets)
SELECT surface, count(*) AS n, round(avg((prob - won) * (prob - won)), 6) AS brier, round(-avg(won * ln(prob) + (1 - won) * ln(1 - prob)), 6) AS log_loss, round(avg(CAST(CAST(prob >= 0.5 AS INTEGER) = won AS INTEGER)), 6) AS accuracy,
round((sum(k * won) - sum(won) * (sum(won) + 1) / 2.0) / (sum(won) * (count(*) - sum(won))), 5) AS auc FROM r GROUP BY 1""")
def m09_scores(spark, sf_dir):
    m = models.scores(bets(spark, sf_dir), "prob", "won", ["surface"])
    return m.select("surface", "n", *(F.round(c, 6).alias(c) for c in ("brier", "log_loss", "accuracy")), F.round("auc", 5).alias("auc"))


@query("m01_scaled", f"WITH {C0} SELECT contest_id, round((odd1 - avg(odd1) OVER ()) / stddev_pop(odd1) OVER (), 6) AS odd1, round((odd2 - avg(odd2) OVER ()) / stddev_pop(odd2) OVER (), 6) AS odd2 FROM c0")
def m01_scaled(spark, sf_dir):
    c = contests(spark, sf_dir).select("contest_id", "odd1", "odd2")
    return models.scaled(c, c, ["odd1", "odd2"]).select("contest_id", F.round("odd1", 6).alias("odd1"), F.round("odd2", 6).alias("odd2"))


@query("st1_stream_ingest", "SELECT event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1")
def st1_stream_ingest(spark, sf_dir):
    """All files of the events as a stream, without repeated ids, drained to a table and then summed."""
    from tallyline.session import scratch
    from tallyline.streaming import ingest

    schema = table(spark, sf_dir, "events").schema
    stream = ingest.deduplicated(ingest.events(spark, sf_dir, schema, files="events.parquet"), late="36500 days")
    rows = ingest.drained(stream, scratch(spark, "stream"), scratch(spark, "stream-state"))
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("value"))
