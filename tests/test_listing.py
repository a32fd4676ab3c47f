"""Incremental listing: the Bloom filter never misses a known id, and reading stops at the first page that is known whole."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallyline.sources import listing


def test_filter_has_every_known_id_and_few_others(spark):
    known = spark.range(0, 40_000, 2).withColumn("id", F.concat(F.lit("k"), "id"))
    filter_ = listing.bloom(known, "id", bits=1 << 20)
    rows = spark.range(40_000).select(F.concat(F.lit("k"), "id").alias("id"), (F.col("id") % 2 == 0).alias("is_known"))
    out = listing.maybe_known(rows.union(spark.createDataFrame([(None, False)], "id string, is_known boolean")), "id", filter_, bits=1 << 20)
    n = {(r["is_known"], r["maybe_known"]): r["count"] for r in out.groupBy("is_known", "maybe_known").count().collect()}
    assert (True, False) not in n and n[True, True] == 20_000 and n.get((False, True), 0) < 200
    assert not listing.maybe_known(rows, "id", listing.bloom(known.where("false"), "id")).where("maybe_known").count()


@pytest.fixture
def pages(spark, tmp_path):
    day = dt.date(2024, 6, 30)
    rows = [(p, f"f{100 * p + k}", day - dt.timedelta(p)) for p in range(40) for k in range(p % 4)]
    spark.createDataFrame(rows, "page int, id string, date date").write.partitionBy("page").parquet(f"{tmp_path}/pages")
    table = spark.read.schema("id string, date date, page int").parquet(f"{tmp_path}/pages")
    asked = []

    def read(a, b):
        asked.append((a, b))
        return table.where((F.col("page") >= a) & (F.col("page") < b))

    return rows, read, asked


@pytest.mark.parametrize("stop", [1, 6, 21, 39])
def test_listing_stops_and_equals_the_anti_join(spark, pages, stop):
    rows, read, asked = pages
    stop += stop % 4 == 0
    known_ids = [i for p, i, _ in rows if p >= stop or i.endswith("01")]
    known = spark.createDataFrame([(i,) for i in known_ids] + [(None,)], "id string")
    out, n_read, stopped = listing.new_entries(read, 40, known, "id", first=2)
    whole = next(p for p in range(40) if (own := [i for q, i, _ in rows if q == p]) and set(own) <= set(known_ids))
    assert stopped == whole and sorted(r["id"] for r in out.collect()) == sorted(i for p, i, _ in rows if p < whole and i not in set(known_ids))
    assert asked == [(0, 2), (2, 6), (6, 14), (14, 30), (30, 40)][: len(asked)] and n_read == asked[-1][1] and asked[-1][0] <= whole < n_read


def test_days_to_come_and_nothing_known(spark, pages):
    rows, read, _ = pages
    none = spark.createDataFrame([], "id string")
    out, n_read, stopped = listing.new_entries(read, 40, none, "id")
    assert out.count() == len(rows) and (n_read, stopped) == (40, -1)
    known = spark.createDataFrame([("f200",), ("f201",)], "id string")
    out, _, stopped = listing.new_entries(read, 40, known, "id", date="date", today="2024-06-27")
    assert stopped == -1 and {r["page"] for r in out.select("page").distinct().collect()} == {p for p, _, d in rows if d <= dt.date(2024, 6, 27)}


def test_listing_query_derives_its_contests_once(spark, sf, monkeypatch):
    from tallyline.plans import queries

    read = []
    whole = listing.new_entries
    monkeypatch.setattr(listing, "new_entries", lambda r, n, known, *a, **k: read.extend(known.inputFiles()) or whole(r, n, known, *a, **k))
    assert queries.QUERIES["s20_listing_stop"](spark, sf).count() > 0
    assert read and not [f for f in read if "lineitem" in f]
