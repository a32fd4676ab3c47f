"""Folds, windows and models against plain Python on small rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyline.functions import scalars as S
from tallyline.operators import asof, backtest, features, joins, models, ratings
from tallyline.operators.contests import appearances, contests
from tallyline.operators.running import running


@pytest.fixture(scope="module")
def bets(spark):
    rng = np.random.default_rng(3)
    rows = [(i, f"k{i % 3}" if i % 7 else None, f"2020-{1 + i * 12 // 400:02d}-{1 + i % 27:02d}", float(rng.normal()), int(rng.random() < 0.4)) for i in range(400)]
    return spark.createDataFrame(rows, "contest_id long, k string, date string, profit double, won int").withColumn("date", F.col("date").cast("date"))


@pytest.mark.parametrize("current", [True, False])
def test_running_totals_equal_one_window(bets, current):
    kinds = {"s": ("sum", F.col("profit")), "m": ("max", F.col("profit")), "p": ("product", 1 + F.col("profit") / 10), "c": ("count", F.col("profit"))}
    got = running(bets, ["k"], F.trunc("date", "month"), ["date", "contest_id"], kinds, current).collect()
    groups = {}
    for r in sorted(got, key=lambda r: (str(r["k"]), r["date"], r["contest_id"])):
        seen = groups.setdefault(r["k"], [])
        upto = [*seen, r["profit"]] if current else list(seen)
        want = (sum(upto), max(upto), math.prod(1 + x / 10 for x in upto), len(upto)) if upto else (None, None, None, 0)
        mine = tuple(r[n] for n in "smpc")
        assert mine == want if not upto else np.allclose(mine, want)
        seen.append(r["profit"])


def test_long_products_equal_the_sql_to_the_last_bit(spark, tmp_path):
    import duckdb

    rng = np.random.default_rng(5)
    rows = [(i, "ab"[i % 9 // 8] if i % 5 else None, f"{2000 + i // 1200}-{1 + i // 100 % 12:02d}-{1 + i % 27:02d}", 1.2 + float(rng.integers(1, 400)) / 100, int(rng.random() < 0.35)) for i in range(24_000)]
    b = spark.createDataFrame(rows, "contest_id long, surface string, date string, odds double, won int").withColumns({"date": F.col("date").cast("date"), "share": F.lit(0.01)})
    got = {r["contest_id"]: r["bankroll"] for r in backtest.compounding(b, ["surface"]).collect()}
    b.write.parquet(f"{tmp_path}/b")
    # A group at a time: groups that share one of DuckDB's partitions are multiplied from where they begin in it.
    sql = "SELECT contest_id, 1000 * product(1 + 0.01::DOUBLE * (CASE WHEN won = 1 THEN odds - 1 ELSE -1 END)) OVER (PARTITION BY surface ORDER BY date, contest_id ROWS UNBOUNDED PRECEDING)"
    want = [r for g in ("= 'a'", "= 'b'", "IS NULL") for r in duckdb.sql(f"{sql} FROM '{tmp_path}/b/*.parquet' WHERE surface {g}").fetchall()]
    assert len(got) == len(want) == 24_000 and got == dict(want)


def test_losing_streaks_go_over_months(bets):
    got = {r["k"]: r["longest_losing_streak"] for r in asof.losing_streak(bets, ["k"], ["date", "contest_id"]).collect()}
    runs = {}
    for r in sorted(bets.collect(), key=lambda r: (r["date"], r["contest_id"])):
        best, now = runs.get(r["k"], (0, 0))
        now = 0 if r["won"] else now + 1
        runs[r["k"]] = (max(best, now), now)
    assert got == {k: v[0] for k, v in runs.items()}


def test_spans_without_a_row_stay(spark):
    spans = spark.createDataFrame([("x", 1, 5), ("x", 10, 12), ("y", 1, 3)], "key string, a int, z int")
    rows = spark.createDataFrame([("x", 5, "b"), ("x", 3, "a"), ("x", 7, "c")], "key string, at int, v string")
    got = {(r["key"], r["a"]): r["hit"] and r["hit"]["v"] for r in joins.in_range(spans, rows, "key", "a", "z", "at", F.struct("at", "v")).collect()}
    assert got == {("x", 1): "a", ("x", 10): None, ("y", 1): None}


def test_names_lose_their_accents(spark):
    names = ["Novak Đoković", "Marin Čilić", "Jean-Zoë  O'Neill", "Ştefănescu Ål", "éclair"]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").select(S.plain_name("n")).collect()]
    assert got == ["novak okovic", "marin cilic", "jeanzoe oneill", "stefanescu al", "eclair"]


def test_leagues_are_groups_of_players_who_meet(spark):
    rows = [(1, 2), (2, 3), (5, 4), (9, 8), (8, 7), (7, 6), (6, 5)]
    got = {r["player"]: r["league"] for r in ratings.leagues(spark.createDataFrame(rows, "p1 long, p2 long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, **dict.fromkeys(range(4, 10), 4)}


def test_single_vectors_equal_the_training_rows(spark, sf):
    """Of contests after a day, those that are the first for both players since look the same asked singly."""
    c = contests(spark, sf).persist()
    cut = "1999-06-01"
    full = {r["contest_id"]: r for r in features.dataset(ratings.multi_elo(c), c).collect()}
    seen, asked = set(), []
    for r in sorted(c.where(F.col("date") >= cut).collect(), key=lambda r: (r["date"], r["contest_id"])):
        if not {r["p1"], r["p2"]} & seen:
            asked.append(r["contest_id"])
        seen |= {r["p1"], r["p2"]}
    assert len(asked) > 1
    history = c.where(F.col("date") < cut)
    one = features.single(c.where(F.col("contest_id").isin(asked)).drop("win1"), history, ratings.multi_elo(history))
    got = {r["contest_id"]: r for r in one.collect()}
    assert sorted(got) == sorted(asked)
    for i, r in got.items():
        assert {f: round(float(r[f]), 6) for f in features.FEATURES} == {f: round(float(full[i][f]), 6) for f in features.FEATURES}


def test_matrix_fills_gaps(spark):
    rows = spark.createDataFrame([(1, 1.0, None, None), (2, None, 4.0, 2.0), (3, 3.0, 1.0, 0.5)], "contest_id long, elo_p1 double, rank_diff double, rank_ratio double")
    got = [tuple(r) for r in features.matrix(rows, ["elo_p1", "rank_diff", "rank_ratio"], ["contest_id"]).orderBy("contest_id").collect()]
    assert got == [(1, 1.0, 0.0, 1.0), (2, 2.0, 4.0, 2.0), (3, 3.0, 1.0, 0.5)]


def pool(p, y):
    """Adjacent violators over the sorted predictions; ties are put together first."""
    blocks = []
    for x in sorted(set(p)):
        these = [b for a, b in zip(p, y, strict=True) if a == x]
        blocks.append([sum(these) / len(these), len(these), [x]])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            b, a = blocks.pop(), blocks.pop()
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]])
    return {x: m for m, _, xs in blocks for x in xs}


def test_calibration_is_isotonic_and_clipped(spark):
    rng = np.random.default_rng(5)
    p = [float(round(x, 2)) for x in rng.random(120)]
    y = [int(rng.random() < x**2) for x in p]
    held = spark.createDataFrame(list(zip(p, map(float, y), strict=True)), "p double, label double")
    want = pool(p, y)
    for r in models.calibrated(held, held, "p").collect():
        assert abs(r["p_cal"] - min(0.99, max(0.01, want[r["p"]]))) < 1e-9


def test_stack_by_plain_numpy(spark):
    """Folds hold each label evenly, no row is predicted by a model that saw it, and the meta model weighs the learners' predictions."""
    rng = np.random.default_rng(6)
    rows = [(i, float(x), float(z), float(rng.random() < 1 / (1 + math.exp(-2 * x)))) for i, (x, z) in enumerate(rng.normal(size=(600, 2)))]
    df = spark.createDataFrame(rows, "contest_id long, a double, b double, label double")
    folds = df.withColumn("_part", F.pmod(F.xxhash64("contest_id", F.lit("part")), F.lit(4))).withColumn("f", models.fold_of("contest_id", 5))
    n = {(r["label"], r["f"]): r["count"] for r in folds.groupBy("label", "f").count().collect()}
    for label in (0.0, 1.0):
        sizes = [n[label, f] for f in range(5)]
        assert max(sizes) - min(sizes) <= 4
    stack = models.stacked(df, ["a", "b"], ["logistic", "forest"], "contest_id", settings={"forest": {"numTrees": 10, "maxDepth": 3}})
    meta = stack.meta.members[0]
    for r in models.stack_predict(stack, df).limit(50).collect():
        z = meta.intercept + float(np.dot(meta.coefficients, [r["p_logistic"], r["p_forest"]]))
        assert abs(r["p"] - 1 / (1 + math.exp(-z))) < 1e-9
    oof, _ = models.out_of_fold(models.vectors(df, ["a", "b"]), ["logistic"], "contest_id")
    loss = oof.agg(F.avg(F.pow(F.col("p_logistic") - F.col("label"), 2))).first()[0]
    assert 0.1 < loss < 0.24 and oof.count() == 600
    assert abs(sum(models.meta_weights(stack).values()) - 1) < 1e-9


def test_walk_forward_trains_on_earlier_years_only(spark):
    rng = np.random.default_rng(7)
    rows = []
    for i in range(900):
        year, x = 2010 + i % 6, float(rng.normal())
        sign = 1 if year < 2015 else -1  # the last year turns over, which no model may know
        rows.append((i, f"{year}-{1 + i % 12:02d}-05", x, float(rng.random() < 1 / (1 + math.exp(-4 * sign * x)))))
    df = spark.createDataFrame(rows, "contest_id long, date string, x1 double, label double").withColumn("date", F.col("date").cast("date"))
    folds = backtest.yearly_folds(df, least_train=500, least_test=50)
    out = backtest.walk_forward(df, ["x1"], folds)
    years = {r["test_year"]: r["auc"] for r in models.scores(out, "p_cal", "label", ["test_year"]).collect()}
    assert sorted(years) == [2014, 2015] and years[2014] > 0.85 and years[2015] < 0.2
    train, held = backtest.split_by_date(df, 0.8)
    assert train.agg(F.max("date")).first()[0] < held.agg(F.min("date")).first()[0] and 180 <= held.count() <= 240


def test_tail_of_students_law(spark):
    # Known values: t of 2.0 with 10, 1.6448536 with very many, and 1 with 1 degree of freedom.
    rows = [(2.0, 10, 0.036694), (1.6448536, 10**7, 0.05), (1.0, 1, 0.25), (-2.0, 10, 0.963306)]
    for r in spark.createDataFrame(rows, "t double, df long, p double").withColumn("q", S.t_tail("t", "df")).collect():
        assert abs(r["q"] - r["p"]) < 2e-6


def test_pairs_need_two_rows_and_one_winner(spark):
    rows = [(1, 1, "a", 1), (1, 2, "b", 0), (2, 1, "a", 1), (3, 1, "a", 0), (3, 2, "b", 0), (4, 1, "a", 0), (4, 2, "b", 1), (4, 3, "c", 0)]
    app = spark.createDataFrame(rows, "contest_id long, side int, player string, won int").withColumns({"date": F.lit("2020-01-01").cast("date"), "odds": F.lit(2.0)})
    assert [(r["contest_id"], r["p1"], r["win1"]) for r in backtest.pairs_of(app).collect()] == [(1, "a", 1)]


def test_prices_with_noise_follow_from_their_keys(spark):
    df = spark.range(4000).withColumn("q", 1 / S.noisy_odds(F.lit(0.5), "id", margin=0.0))
    one, two = df.agg(F.avg("q"), F.stddev("q")).first(), df.agg(F.avg("q"), F.stddev("q")).first()
    assert one == two and abs(one[0] - 0.5) < 0.01 and abs(one[1] - 0.15) < 0.01
    assert df.agg(F.min("q"), F.max("q")).first()[0] >= 0.05


def test_strategies_from_a_file(spark, tmp_path):
    import json

    from tallyline.operators import decision

    entries = {"sure": {"model_threshold": 0.72, "series_filter": ["Grand Slam"], "stake_type": "flat", "max_stake_pct": 0.03}, "off": {"model_threshold": 0.5, "enabled": False}, "note": "text", "none": {"min_ev": 1}}
    (tmp_path / "a.json").write_text(json.dumps({"strategies": entries}))
    (tmp_path / "empty.json").write_text("")
    want = [decision.Strategy("sure", threshold=0.72, series=["Grand Slam"], stake="flat", high=0.03)]
    assert decision.configured(spark, f"{tmp_path}/a.json") == want and decision.configured(spark, f"{tmp_path}/empty.json") == []
    yaml = pytest.importorskip("yaml")
    (tmp_path / "a.yaml").write_text(yaml.safe_dump(entries))
    assert decision.configured(spark, f"{tmp_path}/a.yaml") == want


def test_years_are_split_in_order(spark):
    df = spark.sql("SELECT id, make_date(CAST(2010 + id % 7 AS INT), 1 + CAST(id % 12 AS INT), 3) AS date FROM range(100)")
    years = lambda t: sorted(r[0] for r in t.select(F.year("date")).distinct().collect())
    assert [years(t) for t in backtest.split_by_year(df)] == [[2010, 2011, 2012, 2013, 2014], [2015], [2016]]
    assert [years(t) for t in backtest.split_by_year(df, 2014, 2)] == [[2011, 2012], [2013], [2014]]
    assert [t.count() for t in backtest.split_by_year(df.where("false"))] == [0, 0, 0]


def test_strategies_from_entries():
    from tallyline.operators import decision

    made = decision.strategies([{"name": "a", "threshold": 0.7}, {"name": "not one"}, {"name": "b", "threshold": 0.6, "series": ["Grand Slam"]}])
    assert [(s.name, s.threshold, s.series, s.stake) for s in made] == [("a", 0.7, [], "kelly"), ("b", 0.6, ["Grand Slam"], "kelly")]


def test_sessions_and_rates_of_streams(spark, tmp_path):
    from tallyline.streaming import ingest

    rows = [(1, "2024-01-01 10:00:00", 7), (2, "2024-01-01 10:20:00", 7), (3, "2024-01-01 12:00:00", 7), (4, "2024-01-01 10:05:00", 8), (5, "2024-03-01 00:00:00", 9)]
    e = spark.createDataFrame(rows, "event_id long, ts string, user_id long").withColumn("ts", F.col("ts").cast("timestamp"))
    (tmp_path / "in").mkdir()
    for i in range(2):
        e.where("event_id < 5" if i == 0 else "event_id = 5").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{i}")
    stream = ingest.events(spark, f"{tmp_path}/in/*", e.schema)
    out = ingest.drained(ingest.sessions(stream, "30 minutes", "1 hour"), f"{tmp_path}/out", f"{tmp_path}/state")
    assert sorted((r["user_id"], r["n"]) for r in out.where("user_id < 9").collect()) == [(7, 1), (7, 2), (8, 1)]
    won = stream.select(F.col("user_id").alias("player"), (F.col("event_id") % 2).alias("won"))
    query = ingest.rolling_rates(won).writeStream.outputMode("update").format("memory").queryName("rates").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {r["player"]: (r["matches"], r["wins"]) for r in spark.table("rates").groupBy("player").agg(F.max("matches").alias("matches"), F.max("wins").alias("wins")).collect()} == {7: (3, 2), 8: (1, 0), 9: (1, 1)}


def test_histories_do_not_pass_through_later_sorts(spark, sf):
    """No sort of the windows carries the lists of a player's last rows, and one shuffle serves them all."""
    out = asof.player_features(appearances(contests(spark, sf).persist()))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    inner = plan.splitlines()
    at = [i for i, line in enumerate(inner) if "Window [" in line]
    listed = [i for i in at if "collect_list" in inner[i]]
    assert listed and all("_last20" not in inner[i] or "collect_list" in inner[i] for i in at if i < min(listed))


def test_questions_see_the_history_alone(spark, sf):
    """Several questions of one player, on one day and later ones, each as if it were asked alone."""
    c = contests(spark, sf).persist()
    cut = "1999-06-01"
    history, later = c.where(F.col("date") < cut), c.where(F.col("date") >= cut)
    player = later.groupBy("p1").count().orderBy(F.desc("count"), "p1").first()["p1"]
    asked = later.where((F.col("p1") == player) | (F.col("p2") == player)).drop("win1").orderBy("date", "contest_id").limit(6).persist()
    rated = ratings.multi_elo(history).persist()
    together = {r["contest_id"]: r for r in features.single(asked, history, rated).collect()}
    assert len(together) == 6
    for i in list(together)[::3]:
        alone = features.single(asked.where(F.col("contest_id") == i), history, rated).first()
        assert alone == together[i]


def test_spans_hand_their_states_on(spark, sf, monkeypatch):
    """Ratings in many small jobs equal the plain fold over all contests, of all kinds of ratings and for leagues of their own."""
    monkeypatch.setattr(ratings, "SPAN", 100)
    c = contests(spark, sf).persist()
    plain = lambda rule, league: ratings.fold(ratings.with_league(c, league), "_league", ["date", "contest_id"], rule.step, rule.inputs, rule.outputs)
    for rule, league in ((ratings.elo_rule(), None), (ratings.elo_rule(40.0), "surface"), (ratings.multi_rule(), None), (ratings.multi_rule(), "series")):
        want = {r["contest_id"]: r for r in plain(rule, league).collect()}
        got = rule.over(c, league).collect()
        assert len(got) == len(want) > 1000
        for r in got:
            assert all(abs(r[o] - want[r["contest_id"]][o]) < 1e-8 for o in rule.outputs)
    cut = {r["contest_id"]: tuple(r[f"elo_{x}_pre"] for x in ("1", "2", "div_1", "div_2")) for r in ratings.batched_elo(c).collect()}
    monkeypatch.setattr(ratings, "SPAN", 10_000_000)
    assert cut == {r["contest_id"]: tuple(r[f"elo_{x}_pre"] for x in ("1", "2", "div_1", "div_2")) for r in ratings.batched_elo(c).collect()}


def test_layers_keep_each_players_order():
    a, b = [1, 3, 2, 1, 5], [2, 4, 3, 3, 6]
    assert [x.tolist() for x in ratings.layers(a, b)] == [[0, 1, 4], [2], [3]]
    assert ratings.layers([], []) == []


def test_large_bankrolls_are_rounded_as_in_sql(spark):
    import duckdb

    from tallyline.plans.catalog import rounded_by_product

    values = [s * (a * 10.0**e + k / 7) for s in (1, -1) for a in (1.2345678901234, 5.635326790224775) for e in range(0, 13) for k in range(40)]
    values += [0.0, -0.0, 0.00005, 1e304, 1.7e308, float("inf"), float("-inf"), float("nan")]
    want = [duckdb.execute("SELECT round(?::DOUBLE, 4) + 0.0", [v]).fetchone()[0] for v in values]
    got = [r["r"] for r in spark.createDataFrame(list(enumerate(values)), "i int, v double").select("i", rounded_by_product("v", 4).alias("r")).orderBy("i").collect()]
    assert list(map(repr, got)) == list(map(repr, want))
