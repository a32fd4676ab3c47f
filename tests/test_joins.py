"""Joins by holding, ranges and neighbours, held against the all-pairs rules, and with one hot key."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyline.operators import joins


def best_known(name, known):
    """The reference rule over all known names."""
    t = name.lower().split()
    if len(t) < 2:
        return None
    best, top = None, 0
    for seq, other in known:
        u = "".join(c for c in other.lower() if c.isalpha() or c == " ").split()
        if not u:
            continue
        full = " ".join(u[:-1] if len(u) > 1 else u)
        if t[-1] == u[0]:
            score = 3.0
        elif t[-1] in u[0] or u[0] in t[-1]:
            score = 2.0
        elif " ".join(t[1:]) == full:
            score = 3.0
        elif t[-1] in full:
            score = 1.5
        else:
            continue
        if len(u) > 1 and t[0][0] == u[-1][0]:
            score += 1
        if score > top:
            best, top = (other, score), score
    return best if top >= 2 else None


def test_names_of_every_length_by_all_pairs(spark):
    rng = np.random.default_rng(3)
    word = lambda n: "".join(rng.choice(list("abcd"), n))
    names = {f"{word(2)} " + " ".join(word(int(rng.integers(1, 13))) for _ in range(int(rng.integers(1, 3)))) for _ in range(250)} | {"Na Li", "Yibing Wu", "Single", "A De Minaur"}
    known = [(i, " ".join([*(word(int(rng.integers(1, 16))) for _ in range(int(rng.integers(1, 3)))), word(1).upper() + "."])) for i in range(200)]
    known += [(200, "Collins D."), (201, "Wuxi Y."), (202, "De Minaur A."), (203, "abcd"), (204, "...")]
    out = joins.score_names(spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame(known, "known_seq long, known_name string"))
    got = {r["name"]: (r["known_name"], r["score"]) for r in out.collect()}
    want = {n: b for n in names if (b := best_known(n, known))}
    assert got == want and got["Na Li"] == ("Collins D.", 2.0) and got["Yibing Wu"][0] == "Wuxi Y."


DAY = dt.date(1999, 12, 1)


def day(n):
    return DAY + dt.timedelta(int(n))


@pytest.mark.parametrize("length", [1, 12, 900, 60_000])
def test_spans_by_all_pairs(spark, length):
    rng = np.random.default_rng(length)
    spans = {(k, int(a), int(a + rng.integers(-1, length))) for k, a in zip(rng.choice(["x", "y", "z"], 80), rng.integers(-8000, 8000, 80), strict=True)}
    points = [(str(rng.choice(["x", "y"])), int(d), i) for i, d in enumerate(rng.integers(-9000, 9000, 400))]
    s = spark.createDataFrame([(k, day(a), day(z)) for k, a, z in spans] + [(None, DAY, DAY), ("x", None, DAY)], "key string, a date, z date")
    p = spark.createDataFrame([(k, day(d), i) for k, d, i in points] + [(None, DAY, 0), ("x", None, 1)], "key string, at date, id long")
    got = {(r["key"], r["a"], r["z"]): r["hit"] for r in joins.in_range(s, p, "key", "a", "z", "at", F.struct("at", "id")).collect()}
    assert len(got) == len(spans) + 2
    for k, a, z in spans:
        inside = min(((d, i) for q, d, i in points if q == k and a <= d <= z), default=None)
        r = got[k, day(a), day(z)]
        assert (None if r is None else (r["at"], r["id"])) == (None if inside is None else (day(inside[0]), inside[1]))


@pytest.mark.parametrize("same_day", [True, False])
def test_neighbours_by_all_pairs(spark, same_day):
    rng = np.random.default_rng(1)
    rows = [(str(rng.choice(["x", "y", "z"])), day(d)) for d in rng.integers(0, 2500, 150)] + [(None, DAY), ("x", None)]
    others = [(str(rng.choice(["x", "y"])), day(d)) for d in rng.integers(0, 2500, 60)] + rows[:20] + [(None, DAY), ("x", None)]
    frame = lambda t: spark.createDataFrame(t, "key string, at date")
    for days in (1, 30, 400):
        got = sorted(map(str, joins.without_neighbours(frame(rows), frame(others), "key", "at", days, same_day).collect()))
        near = lambda r, o: None not in (*r, *o) and r[0] == o[0] and r[1].year == o[1].year and abs((r[1] - o[1]).days) < days and (same_day or r[1] != o[1])
        want = [r for r in rows if not any(near(r, o) for o in others)]
        assert got == sorted(f"Row(key={k!r}, at={d!r})" for k, d in want)


def test_one_hot_key_stays_linear(spark):
    n = 100_000
    rows = spark.range(n).select(F.lit("hot").alias("key"), F.expr("date_add(date'1990-01-01', cast(id % 9000 as int))").alias("at"), "id")
    spans = rows.select("key", F.col("at").alias("a"), F.date_add("at", 13).alias("z")).distinct()
    out = joins.in_range(spans, rows, "key", "a", "z", "at", F.struct("at", "id"))
    r = out.agg(F.count("hit").alias("n"), F.sum((F.col("hit.at") == F.col("a")).cast("int")).alias("own")).first()
    assert r["n"] == r["own"] == 9000
    assert joins.without_neighbours(rows, rows, "key", "at", 30).isEmpty()
    alone = joins.without_neighbours(rows.where("id % 9000 = 77"), rows.where("id % 9000 > 200"), "key", "at", 30)
    assert alone.count() == rows.where("id % 9000 = 77").count()
