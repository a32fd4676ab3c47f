"""Ratings of streams: equal to the batch folds, over a stop, with late rows, and as starts of other runs."""

import pytest
from pyspark.sql import functions as F

from tallyline.operators import ratings
from tallyline.operators.contests import contests
from tallyline.session import written
from tallyline.streaming import ingest
from tallyline.streaming import ratings as streamed


@pytest.fixture(scope="module")
def league(spark, sf):
    return written(contests(spark, sf).withColumn("league", F.col("surface")).limit(400), "league")


def closing(c):
    return c.orderBy(F.desc("date")).limit(1).withColumns({"date": F.date_add("date", 3650), "league": F.lit("end")})


def run(spark, folder, schema, state, rule, late="40 days", start=None):
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")
    with streamed.rocksdb(spark):
        return ingest.drained(streamed.rated(stream, rule, late=late, start=start), f"{state}/out", f"{state}/checkpoint")


def close(a, b, columns):
    """Both have the same contests, with the same values."""
    both = a.select("contest_id", *columns).join(b.select("contest_id", *(F.col(c).alias(f"_{c}") for c in columns)), "contest_id", "full")
    assert a.count() == b.count() == both.count()
    assert all(x is not None and x < 1e-9 for x in both.agg(*(F.max(F.abs(F.coalesce(F.col(c) - F.col(f"_{c}"), F.lit(9.0)))) for c in columns)).first())


def test_stream_equals_the_fold_over_a_stop_in_disorder(spark, league, tmp_path):
    rule = ratings.multi_rule()
    moved = F.datediff("date", F.lit("1970-01-01")) + F.pmod(F.xxhash64("contest_id"), F.lit(30))
    edges = league.agg(*(F.percentile(moved, q) for q in (0.0, 0.3, 0.6, 1.0))).first()
    block = lambda k: league.where((moved >= int(edges[k])) & (moved < int(edges[k + 1]) + (k == 2)))
    for k in (0, 1):
        block(k).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    first = run(spark, f"{tmp_path}/in", league.schema, tmp_path, rule)
    n = first.count()
    assert 0 < n < league.count()
    block(2).coalesce(1).write.parquet(f"{tmp_path}/in/2")
    closing(league).write.parquet(f"{tmp_path}/in/9")
    out = run(spark, f"{tmp_path}/in", league.schema, tmp_path, rule).where("league <> 'end'")
    batch = rule.over(league, "league")
    assert out.where("late").isEmpty()
    close(out, batch, list(rule.outputs))
    now = streamed.ratings_now(spark, f"{tmp_path}/checkpoint")
    assert now.where("league <> 'end'").count() == league.select("league", F.explode(F.array("p1", "p2"))).distinct().count()


def test_runs_go_on_from_a_streams_ratings(spark, league, tmp_path):
    rule = ratings.multi_rule()
    day = league.agg(F.percentile(F.unix_date("date"), 0.6)).first()[0]
    early, rest = league.where(F.unix_date("date") <= int(day)), league.where(F.unix_date("date") > int(day))
    early.coalesce(1).write.parquet(f"{tmp_path}/in/0")
    closing(early).write.parquet(f"{tmp_path}/in/9")
    run(spark, f"{tmp_path}/in", league.schema, tmp_path, rule)
    now = written(streamed.ratings_now(spark, f"{tmp_path}/checkpoint"), "now")
    want = written(rule.over(league, "league").join(rest.select("contest_id"), "contest_id", "left_semi"), "want")
    close(rule.resumed(rest, now, "league"), want, list(rule.outputs))
    rest.coalesce(1).write.parquet(f"{tmp_path}/in2/0")
    closing(rest).write.parquet(f"{tmp_path}/in2/9")
    other = run(spark, f"{tmp_path}/in2", league.schema, f"{tmp_path}/other", rule, start=now)
    close(other.where("league <> 'end'"), want, list(rule.outputs))


def test_late_contests_change_nothing(spark, league, tmp_path):
    rule = ratings.elo_rule()
    days = league.select("date").distinct().orderBy("date").limit(3).collect()
    old, rest = league.where(F.col("date") == days[0][0]), league.where(F.col("date") > days[2][0])
    rest.coalesce(1).write.parquet(f"{tmp_path}/in/0")
    run(spark, f"{tmp_path}/in", league.schema, tmp_path, rule, late="0 days")
    old.coalesce(1).write.parquet(f"{tmp_path}/in/1")
    closing(league).write.parquet(f"{tmp_path}/in/9")
    out = run(spark, f"{tmp_path}/in", league.schema, tmp_path, rule, late="0 days").where("league <> 'end' and not late")
    close(out, rule.over(rest, "league"), list(rule.outputs))


def test_a_null_league_and_an_empty_stream(spark, league, tmp_path):
    rule = ratings.elo_rule()
    some = league.limit(20).withColumn("league", F.lit(None).cast("string"))
    some.coalesce(1).write.parquet(f"{tmp_path}/in/0")
    closing(league).write.parquet(f"{tmp_path}/in/9")
    out = run(spark, f"{tmp_path}/in", league.schema, tmp_path, rule)
    close(out.where("league = ''"), rule.over(some, F.lit("")), list(rule.outputs))
    league.where("false").write.parquet(f"{tmp_path}/none/0")
    assert run(spark, f"{tmp_path}/none", league.schema, f"{tmp_path}/state", rule).isEmpty()


class Held(dict):
    """A map or value state in memory, which counts the calls."""

    calls = 0

    def getValue(self, key):
        Held.calls += 1
        return self.get(key)

    def updateValue(self, key, value):
        Held.calls += 1
        self[key] = value

    def keys(self):
        return list(super().keys())

    removeKey = dict.pop
    containsKey = dict.__contains__

    def exists(self):
        return "value" in self

    def get(self, *key):
        return dict.get(self, *key or ("value",))

    def update(self, value):
        self["value"] = value


def test_state_is_asked_by_buckets_and_days(monkeypatch):
    import datetime as dt
    from types import SimpleNamespace

    import numpy as np
    import pandas as pd

    rng, rule = np.random.default_rng(5), ratings.elo_rule()
    day = [dt.date(2020, 1, 1) + dt.timedelta(int(k)) for k in rng.integers(0, 20, 30_000)]
    p1 = rng.integers(0, 20_000, 30_000)
    rows = pd.DataFrame({"contest_id": np.arange(30_000), "date": day, "p1": p1, "p2": (p1 + rng.integers(1, 20_000, 30_000)) % 20_000, "win1": rng.integers(0, 2, 30_000)})
    monkeypatch.setattr(streamed, "AT_ONCE", 7_000, raising=False)
    league = streamed.League(rule, "bigint", "bigint")
    league.init(SimpleNamespace(getMapState=lambda *a: Held(), getValueState=lambda *a: Held(), registerTimer=lambda at: None))
    Held.calls = 0
    batches = (rows[low : low + 1000] for low in range(0, len(rows), 1000))
    assert not list(league.handleInputRows(("all",), batches, None))
    at = lambda d: (d - dt.date(1970, 1, 1)).days * 86_400_000
    out = pd.concat(league.handleExpiredTimer(("all",), SimpleNamespace(getCurrentWatermarkInMs=lambda: at(dt.date(2021, 1, 1))), SimpleNamespace(getExpiryTimeInMs=lambda: at(min(day)))))
    assert Held.calls < 2 * 1024 + 20 * 2 * 5 + 10  # of 20,000 players
    state, want = {}, {}
    for r in rows.sort_values(["date", "contest_id"]).itertuples():
        want[r.contest_id] = rule.step(state, (r.p1, r.p2, r.win1))
    got = out.set_index("contest_id")[list(rule.outputs)]
    assert len(got) == 30_000 and np.allclose(got.loc[list(want)].to_numpy(), np.array(list(want.values())), atol=1e-9)
