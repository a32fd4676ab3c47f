"""Edge cases of the time semantics and the ordered folds, against plain Python."""

import datetime as dt
import math

from pyspark.sql import functions as F

from tallyline.functions import scalars as S
from tallyline.operators import aggregates, asof, backtest, joins, ledger, ratings
from tallyline.operators.contests import appearances, contests

COLUMNS = "contest_id long, date date, p1 long, p2 long, win1 int, surface string, series string, status string, odd1 double, odd2 double, stake double"
D0 = dt.date(2020, 1, 1)


def made(spark, rows):
    """rows of (day, p1, p2, win1, surface)."""
    return spark.createDataFrame([(i, D0 + dt.timedelta(days=d), a, b, w, s, "x", "F", 2.0, 2.0, 10.0) for i, (d, a, b, w, s) in enumerate(rows)], COLUMNS)


def features(spark, rows):
    out = asof.player_features(appearances(made(spark, rows)))
    return {(r["contest_id"], r["side"]): r for r in out.collect()}


def test_no_history_has_defaults(spark):
    r = features(spark, [(0, 1, 2, 1, "Hard")])[0, 1]
    assert (r["form_5"], r["surface_rate_90"], r["h2h_rate"], r["days_rest"], r["fatigue_14"], r["matches"], r["surface_specialist"]) == (0.5, 0.5, 0.5, 30, 0, 0, 1.0)


def test_same_day_rows_count_for_rates_but_not_for_rest(spark):
    f = features(spark, [(0, 1, 2, 1, "Hard"), (0, 1, 3, 0, "Hard"), (0, 1, 4, 1, "Hard")])
    assert f[2, 1]["surface_rate_90"] == 0.5 and f[2, 1]["fatigue_14"] == 2 and f[2, 1]["days_rest"] == 30


def test_window_edges_are_inclusive(spark):
    f = features(spark, [(0, 1, 2, 1, "Hard"), (90, 1, 3, 0, "Hard"), (104, 1, 4, 0, "Hard")])
    assert f[1, 1]["surface_rate_90"] == 1.0 and f[2, 1]["fatigue_14"] == 1


def test_caps_on_history(spark):
    f = features(spark, [(i, 1, 100 + i, int(i < 9), "Hard") for i in range(60)])
    # the last fifty surface rows before the sixtieth contest are 9 to 58: all lost
    assert f[59, 1]["surface_rate_365"] == 0.0 and f[59, 1]["form_20"] == 0.0 and f[59, 1]["fatigue_14"] == 14


def test_later_contests_never_change_earlier_features(spark):
    rows = [(i // 2, i % 4, 4 + i % 3, i % 2, "Hard" if i % 3 else "Clay") for i in range(30)]
    a, b = features(spark, rows), features(spark, rows[:20])
    assert all(a[k] == b[k] for k in b)


def test_trailing_means_skip_nulls(spark):
    c = appearances(made(spark, [(i, 1, 2 + i, 1, "Hard") for i in range(4)])).withColumn("x", F.when(F.col("contest_id") != 1, F.col("contest_id").cast("double")))
    got = {r["contest_id"]: r["x_l5"] for r in asof.trailing(c, ["x"]).where("side = 1").collect()}
    assert got == {0: None, 1: 0.0, 2: 0.0, 3: 1.0}


def plain_elo(rows, k=32.0):
    state, out = {}, []
    for p1, p2, w in rows:
        a, b = state.get(p1, 1500.0), state.get(p2, 1500.0)
        move = k * (w - 1 / (1 + 10 ** ((b - a) / 400)))
        out.append((a, b))
        state[p1], state[p2] = a + move, b - move
    return out, state


def test_elo_equals_a_plain_loop_and_sums_to_zero(spark, sf):
    c = contests(spark, sf).persist()
    got = ratings.elo(c).orderBy("date", "contest_id").collect()
    want, state = plain_elo([(r["p1"], r["p2"], r["win1"]) for r in c.orderBy("date", "contest_id").collect()])
    assert all(abs(g["elo_1"] - a) < 1e-9 and abs(g["elo_2"] - b) < 1e-9 for g, (a, b) in zip(got, want, strict=True))
    assert abs(sum(state.values()) / len(state) - 1500) < 1e-6


def test_resumed_ratings_go_on_where_the_old_ended(spark, sf):
    c = contests(spark, sf).persist()
    cut = dt.date(1998, 1, 1)
    whole = {r["contest_id"]: r["elo_1"] for r in ratings.elo(c).collect()}
    old = ratings.elo(c.where(F.col("date") < cut))
    side = F.explode(F.array(*(F.struct(F.col(f"p{n}").alias("player"), F.col(f"elo_{n}_post").alias("elo")) for n in (1, 2))))
    snap = old.select("date", "contest_id", side.alias("s")).groupBy("s.player").agg(F.max_by("s.elo", F.struct("date", "contest_id")).alias("elo"))
    got = ratings.resumed(c.where(F.col("date") >= cut), snap).collect()
    assert got and all(abs(r["elo_1"] - whole[r["contest_id"]]) < 1e-9 for r in got)


def test_batched_ratings_read_the_day_start(spark):
    got = ratings.batched_elo(made(spark, [(0, 1, 2, 1, "Hard"), (0, 1, 3, 1, "Hard"), (1, 1, 2, 1, "Hard")])).orderBy("contest_id").collect()
    assert [r["elo_1_pre"] for r in got] == [1500.0, 1500.0, 1512.0]


def test_decay_waits_thirty_days_and_has_a_floor(spark):
    rows = spark.createDataFrame([(1700.0, d) for d in (30, 31, 400)], "r double, d int").select(S.decayed("r", "d").alias("x")).collect()
    assert rows[0]["x"] == 1700.0 and 1670 < rows[1]["x"] < 1700 and abs(rows[2]["x"] - 1670) < 1e-9


def test_kelly_bounds(spark):
    df = spark.createDataFrame([(0.5, 1.0), (1.0, 2.0), (0.4, 2.0), (0.9, 2.0), (0.51, 2.0)], "p double, o double")
    assert [r[0] for r in df.select(S.kelly_share("p", "o")).collect()] == [0.01, 0.01, 0.0, 0.05, 0.01]


def test_fold_with_a_least_stake_equals_the_product_without_one(spark, sf):
    c = contests(spark, sf).select("contest_id", "date", "surface", F.col("win1").alias("won"), F.col("odd1").alias("odds"), F.lit(0.01).alias("share"))
    a = {r["contest_id"]: r["bankroll"] for r in backtest.simulated(c, "surface", stop_share=1.0, least=0.0).collect()}
    b = {r["contest_id"]: r["bankroll"] for r in backtest.compounding(c, ["surface"]).collect()}
    assert all(abs(a[k] / b[k] - 1) < 1e-9 for k in b)


def test_void_policies(spark):
    rows = [(1, "resolved", "win", 10.0, 5.0), (1, "resolved", "loss", 10.0, -10.0), (1, "resolved", "void", 10.0, 0.0), (1, "open", None, 10.0, None)]
    b = spark.createDataFrame(rows, "user_id int, status string, result string, stake double, profit double")
    got = [tuple(aggregates.user_stats(b, p).select("win_rate", "roi").first()) for p in ("exclude", "include", "rate")]
    assert got == [(50.0, -25.0), (33.3333, -16.6667), (33.3333, -25.0)]


def test_names_by_tier(spark):
    names = spark.createDataFrame([("José Álvarez",), ("J. Smith",), ("Pat Smith",), ("Nobody",)], "name string")
    known = spark.createDataFrame([("jose alvarez", 1), ("John Smith", 2), ("Kim Smith", 3)], "known_name string, known_seq int")
    got = {r["name"]: (r["known_name"], r["tier"]) for r in joins.match_names(names, known).collect()}
    assert got == {"José Álvarez": ("jose alvarez", 1), "J. Smith": ("John Smith", 2), "Pat Smith": ("John Smith", 3), "Nobody": (None, None)}


def test_merge_keeps_the_incoming_row(spark):
    a = spark.createDataFrame([(1, "old"), (2, "old")], "k int, v string")
    b = spark.createDataFrame([(2, "new"), (3, "new")], "k int, v string")
    assert sorted(map(tuple, ledger.merged(a, b, ["k"], ["v"]).collect())) == [(1, "old"), (2, "new"), (3, "new")]


def test_streams_equal_batches(spark, sf, tmp_path):
    from tallyline.streaming import ingest

    src = tmp_path / "in"
    e = spark.read.parquet(f"{sf}/events.parquet")
    e.union(e.limit(50)).coalesce(1).write.parquet(str(src))
    last = F.lit("2100-01-01").cast("timestamp_ntz")
    e.limit(1).withColumns({"ts": last, "event_id": F.lit(-1).cast("long"), "event_type": F.lit("end")}).coalesce(1).write.mode("append").parquet(str(src))
    stream = ingest.deduplicated(ingest.events(spark, str(src), e.schema))
    got = ingest.drained(stream, str(tmp_path / "a"), str(tmp_path / "ca"))
    assert got.where("event_id >= 0").count() == e.count() == got.where("event_id >= 0").select("event_id").distinct().count()
    volumes = ingest.drained(ingest.volumes(ingest.events(spark, str(src), e.schema)), str(tmp_path / "b"), str(tmp_path / "cb"))
    batch = e.union(e.limit(50)).groupBy(F.to_date("ts").alias("d"), "event_type").count()
    want = {(r["d"], r["event_type"]): r["count"] for r in batch.collect()}
    assert {(r["start"].date(), r["event_type"]): r["n"] for r in volumes.collect() if r["event_type"] != "end"} == want


def test_stop_loss_is_absorbing(spark):
    rows = [(i, D0 + dt.timedelta(days=i), "x", w, 3.0, 0.5) for i, w in enumerate([0, 0, 1, 1, 1])]
    b = spark.createDataFrame(rows, "contest_id long, date date, surface string, won int, odds double, share double")
    made_ = backtest.compounding(b, ["surface"], stop_share=0.7).orderBy("contest_id").collect()
    fold_ = [r for r in backtest.simulated(b, "surface", stop_share=0.7, least=0.0).orderBy("contest_id").collect() if r["stake"] > 0]
    assert [r["bankroll"] for r in made_] == [500.0, 250.0] == [r["bankroll"] for r in fold_]


def test_sources_conform_and_results(spark):
    from tallyline.sources import tables

    raw = spark.createDataFrame([("2020-01-02", " A ", "B", -1, 2.5, 0.9), (None, "A", "B", 3, 2.0, 2.0), ("03/01/2020", "C", "D", 4, -1.0, 1.5)], "date string, Player_1 string, Player_2 string, Rank_1 int, Odd_1 double, Odd_2 double")
    got = {r["Player_1"]: r for r in tables.matches(raw).collect()}
    assert set(got) == {"A", "C"} and got["A"]["Rank_1"] is None and got["A"]["Odd_2"] is None and got["A"]["Winner"] == "A"
    assert got["C"]["Date"] == dt.date(2020, 1, 3) and got["C"]["Odd_1"] is None and got["C"]["Surface"] == "Hard"
    r = spark.createDataFrame([("k1", "W", "L", None, 1.5, None, 2.5, 6, 4, 7, None, "Completed"), ("k2", "W", "L", 1.4, 1.5, 3.0, 2.5, 6, 4, 7, 5, "Retired")], "id string, Winner string, Loser string, PSW double, B365W double, PSL double, B365L double, W1 int, L1 int, W2 int, L2 int, Comment string")
    got = tables.results(r, ["id"]).collect()
    assert len(got) == 1 and {got[0]["Odd_1"], got[0]["Odd_2"]} == {1.5, 2.5} and got[0]["Score"] in ("6-4", "4-6")


def test_scalars_of_texts(spark):
    df = spark.createDataFrame([("4:05", "12 of 30", "http://x/fighter/0123456789abcdef01", " Gagné ")], "a string, b string, c string, d string")
    r = df.select(S.clock_seconds("a"), *S.x_of_y("b"), S.url_id("c"), S.normal_result("d"), S.first_number("b"), S.bucket(F.lit(2.0), S.ODDS_EDGES, S.ODDS_LABELS)).first()
    assert tuple(r) == (245, 12, 30, "0123456789abcdef01", "win", 12.0, "(1.6, 2]")


def test_ledger_rules(spark):
    e = spark.createDataFrame([(1, "A", "A", 2.0, 2.0, 0.5), (2, "A", "B", 1.0, 2.0, 0.5), (3, "A", "B", 2.0, 2.0, 1.5), (4, "A", "B", 2.0, 2.0, None)], "event_id int, participant_a string, participant_b string, odds_a double, odds_b double, prob_a double")
    assert {r["event_id"]: r["problem"] for r in ledger.event_violations(e).collect()} == {1: "participants", 2: "odds", 3: "probability"}
    old = spark.createDataFrame([("t", None, None)], "title string, moment string, odds double")
    new = spark.createDataFrame([("t", "", 2.0), ("u", None, 3.0)], "title string, moment string, odds double")
    got = sorted((r["title"], r["odds"]) for r in ledger.get_or_create(old, new, ["title", "moment"], ["odds"]).collect())
    assert got == [("t", 2.0), ("u", 3.0)]


def test_entry_imports_without_a_session():
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert e.queries() and set(e.oracle_sql()) <= set(e.queries())"], cwd=root, check=True)


def test_price_feed(spark):
    from tallyline.sources import tables

    market = lambda a, b: [{"key": "h2h", "outcomes": [{"name": "A", "price": a}, {"name": "B", "price": b}]}]
    feed = [{"id": "e", "home_team": "A", "away_team": "B", "commence_time": "2024-01-02T10:00:00Z", "bookmakers": [
        {"key": "x", "title": "X", "last_update": "", "markets": market(2.0, 1.8)}, {"key": "y", "title": "Y", "last_update": "", "markets": market(2.2, None)}, {"key": "z", "title": "Z", "last_update": "", "markets": []}]}]
    r = joins.best_prices(tables.prices(spark.createDataFrame(feed, tables.FEED)), ["Y", "X"]).collect()
    assert len(r) == 1 and (r[0]["n_books"], r[0]["bookmaker"], r[0]["best_1"], r[0]["prices"]) == (1, "X", 2.0, {"X": 2.0})


def test_temporary_tables_go_and_others_stay(spark):
    import os

    from tallyline import session

    before = session.written(spark.range(3), "stays")
    with session.temporary_tables(spark):
        inner = session.written(before, "goes")
        path = inner.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
        assert os.path.exists(path) and inner.count() == 3
    assert not os.path.exists(path) and before.count() == 3


def test_growth_stays_finite_where_the_bankroll_does_not(spark):
    rows = [(i, D0 + dt.timedelta(days=i // 50), "x", 1, 3.0, 0.5) for i in range(2000)]
    b = spark.createDataFrame(rows, "contest_id long, date date, surface string, won int, odds double, share double")
    got = backtest.compounding(b, ["surface"]).orderBy("contest_id").collect()
    assert got[-1]["bankroll"] == float("inf") and abs(got[-1]["growth"] - 2000 * math.log(2)) < 1e-9


def test_growth_of_a_lost_bankroll(spark):
    rows = [(0, D0, "x", 1, 3.0, 0.5), (1, D0, "x", 0, 3.0, 1.0), (2, D0 + dt.timedelta(days=1), "x", 1, 3.0, 0.5)]
    b = spark.createDataFrame(rows, "contest_id long, date date, surface string, won int, odds double, share double")
    got = backtest.compounding(b, ["surface"]).orderBy("contest_id").collect()
    assert [r["growth"] for r in got][1:] == [float("-inf")] * 2 and [r["bankroll"] for r in got][1:] == [0.0, 0.0]


def test_profile_counts_values_in_even_shares(spark):
    from tallyline.operators import aggregates

    nan, rows = float("nan"), []
    for i in range(900):
        rows.append((i, None if i % 9 == 0 else f"n{i % 400}", "same", [0.0, -0.0, nan, -nan, 1.5, None][i % 6]))
    df = spark.createDataFrame(rows, "k long, name string, hot string, v double")
    for at_once in (50, 10_000):
        got = {r["column"]: tuple(r)[1:] for r in aggregates.profile(df, at_once).collect()}
        assert got["k"] == ("bigint", 900, 0.0, 900, "0") and got["hot"] == ("string", 900, 0.0, 1, "same")
        assert got["name"] == ("string", 800, round(1 / 9, 6), len({r[1] for r in rows} - {None}), min(r[1] for r in rows if r[1]))
        assert got["v"][:4] == ("double", 750, round(1 / 6, 6), 3)
    none = {r["column"]: tuple(r)[1:] for r in aggregates.profile(df.where("false"), 50).collect()}
    assert none["name"] == ("string", 0, None, 0, None)
    held = aggregates.value_totals(df.select(F.col("k").alias("v")), 18).select(F.spark_partition_id().alias("p")).groupBy("p").count()
    assert max(r["count"] for r in held.collect()) < 150  # of 900 values that one task would have held
