"""Ratings of a stream of contests, equal to the batch folds for all contests within the watermark.

State is kept by league: each player's rating, and the contests that wait by day. A day is rated when the
watermark passes it, days in order and a day's contests in order of their id, so contests may come in any
order that the watermark allows. Contests wait as Arrow streams, a part for each day and some hundred thousand
rows that come; days are rated on arrays, as in batch, so many contests at once. A flush reads and writes only the
buckets, of a thousand, that hold the players who appear in it. State is RocksDB's and lives in the
checkpoint: a stopped stream goes on where it was.

A contest that comes after its day was rated changes nothing and counts as late: Spark drops rows behind
the watermark before the state sees them (the progress counts them), and one that slips in with the
watermark's own day is given out with late set and no ratings. Ratings as they stand are read from the
checkpoint as a table, from which batch folds (Rule.resumed) and other streams (start) go on.
"""

from __future__ import annotations

import contextlib
import datetime
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from tallyline.operators.ratings import EPOCH, Rule, States
from tallyline.session import let_workers_import

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Milliseconds of a day.
DAY = 86_400_000


#: Rows that wait for their place in the state, or are rated, at once; buckets that a league's players are dealt over.
AT_ONCE, BUCKETS = 500_000, 1024


def bucket(player: str) -> int:
    return zlib.crc32(player.encode()) % BUCKETS


def stored(rows: pa.Table) -> bytes:
    """Contests as an Arrow stream."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as out:
        out.write_table(rows)
    return sink.getvalue().to_pybytes()


def restored(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(bytes(data)).read_all()


class League(StatefulProcessor):
    """One league's players and waiting days."""

    def __init__(self, rule: Rule, player: str, contest: str):
        self.rule = rule
        self.columns = ["contest_id", "date", *rule.outputs, "late"]
        self.schema = f"league string, contest_id {contest}, date date, {', '.join(f'{n} {t}' for n, t in rule.outputs.items())}, late boolean"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.players = handle.getMapState("players", "bucket int", "ratings string")
        self.days = handle.getMapState("days", "at long, part long", "contests binary")
        self.parts = handle.getValueState("parts", "n long")
        self.rated = handle.getValueState("rated", "at long")

    def close(self) -> None:
        pass

    def bucket_of(self, b: int) -> dict[str, str]:
        held = self.players.getValue((b,))
        return json.loads(held[0]) if held is not None else {}

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues: TimerValues) -> None:
        come: dict[int, dict] = {}
        for player, rating in zip(map(str, initialState["player"].tolist()), initialState["rating"].tolist(), strict=True):
            come.setdefault(bucket(player), {})[player] = rating
        for b, ratings in come.items():
            self.players.updateValue((b,), (json.dumps(self.bucket_of(b) | ratings),))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        done = self.rated.get()[0] if self.rated.exists() else None
        waiting = {at for at, _ in self.days.keys()}
        columns = list(dict.fromkeys(["contest_id", "date", *self.rule.inputs]))
        held, n = [], 0
        for batch in rows:
            table = pa.Table.from_pandas(batch[columns], preserve_index=False)
            if done is not None:
                late = pc.less_equal(table["date"], pa.scalar(EPOCH + datetime.timedelta(milliseconds=done), pa.date32()))
                if pc.any(late).as_py():
                    gone = table.filter(late)
                    yield self.made(key, gone, [np.full(len(gone), np.nan)] * len(self.rule.outputs), True)
                    table = table.filter(pc.invert(late))
            held.append(table)
            n += len(table)
            if n >= AT_ONCE:
                self.wait(pa.concat_tables(held, promote_options="permissive"), waiting)
                held, n = [], 0
        if n:
            self.wait(pa.concat_tables(held, promote_options="permissive"), waiting)

    def wait(self, rows: pa.Table, waiting: set[int]) -> None:
        """Put the contests of each day into the state as a part of their own."""
        part = self.parts.get()[0] + 1 if self.parts.exists() else 0
        self.parts.update((part,))
        rows = rows.sort_by("date")
        days = rows["date"].cast(pa.int32()).to_numpy()
        first = np.flatnonzero(np.r_[True, days[1:] != days[:-1]])
        for low, high in zip(first.tolist(), [*first[1:].tolist(), len(days)], strict=True):
            at = int(days[low]) * DAY
            if at not in waiting:
                self.handle.registerTimer(at)
                waiting.add(at)
            self.days.updateValue((at, part), (stored(rows.slice(low, high - low).combine_chunks()),))

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.rated.exists() and self.rated.get()[0] >= expiredTimerInfo.getExpiryTimeInMs():
            return  # an earlier timer of this batch rated its day as well
        upto = timerValues.getCurrentWatermarkInMs()
        due = sorted((at, part) for at, part in self.days.keys() if at <= upto)
        if not due:
            return
        states, buckets, held, n = States(self.rule.new), {}, [], 0
        for i, (at, part) in enumerate(due):
            held.append(restored(self.days.getValue((at, part))[0]))
            self.days.removeKey((at, part))
            n += len(held[-1])
            if i + 1 == len(due) or n >= AT_ONCE and due[i + 1][0] != at:
                rows = pa.concat_tables(held, promote_options="permissive").sort_by([("date", "ascending"), ("contest_id", "ascending")])
                yield self.made(key, rows, self.outputs_of(rows, states, buckets), False)
                held, n = [], 0
        for p, at in states.at.items():
            buckets[bucket(p)][p] = " ".join(map(repr, states.values[at].tolist()))
        for b, ratings in buckets.items():
            self.players.updateValue((b,), (json.dumps(ratings),))
        self.rated.update((due[-1][0],))

    def outputs_of(self, rows: pa.Table, states: States, buckets: dict[int, dict]) -> list[np.ndarray]:
        """The rule's outputs for contests in order; players whom the states lack are read with their buckets."""
        codes = pa.concat_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in (rows["p1"], rows["p2"])]).dictionary_encode()
        names = [str(p) for p in codes.dictionary.to_pylist()]
        new = [p for p in names if p not in states.at]
        for b in {bucket(p) for p in new} - buckets.keys():
            buckets[b] = self.bucket_of(b)
        at = states.rows(names)
        for p in new:
            if (r := buckets[bucket(p)].get(p)) is not None:
                states.values[states.at[p]] = np.array(r.split(), float)
        at = at[codes.indices.to_numpy()]
        return self.rule.of(states, at[: len(rows)], at[len(rows) :], {c: rows[c].to_pylist() for c in self.rule.inputs if c not in ("p1", "p2")})

    def made(self, key: tuple, rows: pa.Table, outputs: list[np.ndarray], late: bool) -> pd.DataFrame:
        out = rows.select(["contest_id", "date"]).to_pandas()
        for name, values in zip(self.rule.outputs, outputs, strict=True):
            out[name] = values if not late else None
        out["late"] = late
        out.insert(0, "league", key[0])
        return out


def rated(contests: DataFrame, rule: Rule, league: str = "league", late: str = "30 days", start: DataFrame | None = None) -> DataFrame:
    """A stream of contests (contest_id, date, p1, p2 and the rule's inputs) with ratings, given out in append mode when their day is closed.

    late: how far behind the newest day a contest may come. start: (league, player, rating) from ratings_now, to go on from.
    A null league is a league of its own, named by the empty string. The stream is started within rocksdb().
    """
    let_workers_import(contests.sparkSession)
    kinds = {f.name: f.dataType.simpleString() for f in contests.schema.fields}
    processor = League(rule, kinds["p1"], kinds["contest_id"])
    columns = list(dict.fromkeys(["contest_id", "date", *rule.inputs]))
    rows = contests.select(F.coalesce(F.col(league).cast("string"), F.lit("")).alias("league"), F.col("date").cast("timestamp").alias("at"), *columns)
    first = start.select("league", "player", "rating").groupBy("league") if start is not None else None
    return rows.withWatermark("at", late).groupBy("league").transformWithStateInPandas(
        processor, outputStructType=T.StructType.fromDDL(processor.schema), outputMode="Append", timeMode="EventTime", initialState=first
    )


@contextlib.contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Within it, streams are started with RocksDB as their state store."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


def ratings_now(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(league, player, rating) as a stopped or running stream last committed them, players as text; rating: the rule's numbers for a player with spaces between."""
    state = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "players").load()
    ratings = F.from_json("user_map_value.ratings", "map<string, string>")
    return state.select(F.col("key.league").alias("league"), F.explode(ratings).alias("player", "rating"))
