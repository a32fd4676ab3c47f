"""A bet ledger on immutable tables: each change is a new table from the old one and the request."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyline.functions import scalars as S


def keep(df: DataFrame, keys: list[str], order: list[Column | str], last: bool = False) -> DataFrame:
    """One row per key, the first or the last in the order."""
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    w = Window.partitionBy(*keys).orderBy(*([c.desc() for c in cols] if last else cols))
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new replace those of old with the same key; no MERGE is needed on plain files."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def newer(existing: DataFrame, incoming: DataFrame, date: str, keys: list[str]) -> DataFrame:
    """Incoming rows after the existing ones' last date, one per key."""
    mark = existing.agg(F.max(date).alias("_m"))
    return keep(incoming.crossJoin(F.broadcast(mark)).where(F.col("_m").isNull() | (F.col(date) > F.col("_m"))).drop("_m"), keys, [date])


def unknown(incoming: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    return incoming.join(existing.select(key).distinct(), key, "left_anti")


def merged(existing: DataFrame, incoming: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Both, one row per key, the incoming one where both have it."""
    both = existing.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    return keep(both, keys, ["_new", *order], last=True).drop("_new")


def event_violations(events: DataFrame) -> DataFrame:
    """Rows that break the ledger's rules, with the first rule that each breaks."""
    problem = (
        F.when(F.coalesce(F.col("participant_a") == F.col("participant_b"), F.lit(True)), "participants")
        .when(~F.coalesce(F.col("odds_a") > 1, F.lit(False)) | ~F.coalesce(F.col("odds_b") > 1, F.lit(False)), "odds")
        .when(~F.coalesce(F.col("prob_a").between(0, 1), F.lit(True)), "probability")
    )
    return events.withColumn("problem", problem).where(F.col("problem").isNotNull())


def get_or_create(events: DataFrame, wanted: DataFrame, keys: list[str], fill: list[str]) -> DataFrame:
    """Events with those wanted that are new; values that an event lacks are filled from the request. Null and empty keys are equal."""
    k = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"_{c}") for c in keys]
    w = keep(wanted.select("*", *k), [f"_{c}" for c in keys], [F.col(f"_{keys[0]}")]).select(*(f"_{c}" for c in keys), *(F.col(c).alias(f"_new_{c}") for c in wanted.columns))
    joined = events.select("*", *k).join(w, [f"_{c}" for c in keys], "full")
    cols = [F.coalesce(F.col(c), F.col(f"_new_{c}")).alias(c) if c in fill or c in keys else F.col(c) for c in events.columns]
    return joined.select(*cols)


def placed(events: DataFrame, requests: DataFrame, bankrolls: DataFrame) -> DataFrame:
    """Requested bets with price, edge and value from their event, and the reason why one isn't accepted."""
    out = requests.join(events, "event_id", "left").join(bankrolls, "user_id", "left")
    first = F.col("pick") == "a"
    out = out.withColumns({"odds": F.when(first, F.col("odds_a")).otherwise(F.col("odds_b")), "prob": F.when(first, F.col("prob_a")).otherwise(1 - F.col("prob_a"))})
    refused = (
        F.when(F.col("status").isNull(), "no event")
        .when(F.col("status") != "upcoming", "closed")
        .when(~F.coalesce(F.col("odds") > 1, F.lit(False)), "odds")
        .when(~(F.col("stake") > 0), "stake")
        .when(F.col("stake") > F.coalesce("bankroll", F.lit(0.0)), "balance")
    )
    return out.select("user_id", "event_id", "pick", "stake", "odds", S.edge("prob", "odds").alias("edge"), S.expected_value("prob", "odds").alias("ev"), refused.alias("refused"))


def settled(bets: DataFrame, results: DataFrame) -> DataFrame:
    """Bets with the result and profit of their event's winner; void winners void them, events without a result leave them."""
    out = bets.drop("result", "profit").join(results.select("event_id", "winner_side"), "event_id", "left")
    result = F.when(F.col("winner_side") == "void", "void").when(F.col("winner_side") == F.col("pick"), "win").when(F.col("winner_side").isNotNull(), "loss")
    out = out.withColumn("result", result).withColumn("status", F.when(result.isNotNull(), "resolved").otherwise(F.col("status")))
    return out.withColumn("profit", F.when(F.col("result").isNotNull(), S.settled_profit("stake", "odds", "result"))).drop("winner_side")


def reopened(bets: DataFrame, events: DataFrame) -> DataFrame:
    """Bets of these events as open ones again, without result, profit and time of resolution."""
    hit = bets.join(events.select("event_id").distinct().withColumn("_hit", F.lit(True)), "event_id", "left")
    open_ = {"status": F.lit("open"), "result": F.lit(None).cast("string"), "profit": F.lit(None).cast("double"), "resolved_at": F.lit(None).cast("timestamp_ntz")}
    return hit.withColumns({c: F.when(F.col("_hit"), v).otherwise(F.col(c)) for c, v in open_.items() if c in bets.columns}).drop("_hit").select(*bets.columns)


def settled_events(events: DataFrame, results: DataFrame) -> DataFrame:
    """Events with the winner that results give; a result without a winner opens an event again."""
    r = results.select("event_id", F.col("winner_side").alias("_w"), F.lit(True).alias("_hit"))
    out = events.join(r, "event_id", "left")
    status = F.when(F.col("_hit"), F.when(F.col("_w").isNull(), "upcoming").otherwise("completed")).otherwise(F.col("status"))
    return out.withColumns({"status": status, "winner_side": F.when(F.col("_hit"), F.col("_w")).otherwise(F.col("winner_side"))}).drop("_w", "_hit").select(*events.columns)


def applied(bets: DataFrame, results: DataFrame, users: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(bets, bankrolls) after results: winners settle bets, a null winner opens them, and each user's bankroll follows."""
    from tallyline.operators.aggregates import bankrolls

    told = results.where(F.col("winner_side").isNotNull())
    of = told.select("event_id").distinct()
    done = settled(bets.join(of, "event_id", "left_semi"), told)
    rest = reopened(bets.join(of, "event_id", "left_anti"), results.where(F.col("winner_side").isNull()))
    now = rest.unionByName(done.select(*bets.columns))
    return now, bankrolls(users, now)


def updated(rows: DataFrame, changes: DataFrame, key: str, allowed: Column) -> DataFrame:
    """Rows with the values of changes where the row allows it; a null in a change leaves the value."""
    new = changes.select(F.col(key), *(F.col(c).alias(f"_n_{c}") for c in changes.columns if c != key))
    out = rows.withColumn("_ok", allowed).join(new, key, "left")
    return out.select(*(F.when(F.col("_ok"), F.coalesce(f"_n_{c}", c)).otherwise(F.col(c)).alias(c) if f"_n_{c}" in out.columns else F.col(c) for c in rows.columns))


def added(bets: DataFrame, new: DataFrame, columns: list[str]) -> DataFrame:
    """Bets with new ones, which are open, without result and profit; the next numbers go by the new ones' order."""
    top = bets.agg(F.coalesce(F.max("bet_id"), F.lit(0)).alias("_m"))
    # A part's rows are numbered by themselves and parts after each other, so that no task sees all new ones.
    parts = new.withColumn("_p", F.pmod(F.xxhash64(*columns), F.lit(64)))
    before = parts.groupBy("_p").agg(F.count(F.lit(1)).alias("_c")).withColumn("_before", F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    numbered = parts.join(F.broadcast(before), "_p").withColumn("_r", F.row_number().over(Window.partitionBy("_p").orderBy(*columns)) + F.col("_before"))
    rows = numbered.crossJoin(F.broadcast(top)).withColumn("bet_id", F.col("_m") + F.col("_r")).drop("_p", "_c", "_before", "_r", "_m")
    return bets.unionByName(rows.withColumns({"status": F.lit("open"), "result": F.lit(None).cast("string"), "profit": F.lit(None).cast("double")}), allowMissingColumns=True)


def closed(bets: DataFrame, results: DataFrame) -> DataFrame:
    """Bets with the results given for them by bet_id and their profits; others, and unknown ids, change nothing."""
    r = results.select("bet_id", F.col("result").alias("_r"))
    out = bets.join(r, "bet_id", "left")
    hit = F.col("_r").isNotNull()
    return out.withColumns(
        {
            "profit": F.when(hit, S.settled_profit("stake", "odds", "_r")).otherwise(F.col("profit")), "status": F.when(hit, "resolved").otherwise(F.col("status")),
            "result": F.when(hit, F.col("_r")).otherwise(F.col("result")),
        }
    ).drop("_r").select(*bets.columns)


def open_bets(bets: DataFrame) -> DataFrame:
    return bets.where(F.col("status") == "open")


def journalled(journal_: DataFrame, moves: DataFrame) -> DataFrame:
    """A bankroll journal with deposits and withdrawals: each row's amount is the user's last one and all moves since.

    journal_: user_id, moment, seq, amount, action; moves: user_id, moment, seq, change (a withdrawal is negative). One of more than there is isn't made.
    """
    last = journal(journal_).select("user_id", "bankroll")
    w = Window.partitionBy("user_id").orderBy("moment", "seq").rowsBetween(Window.unboundedPreceding, 0)
    out = moves.join(last, "user_id", "left").withColumn("amount", F.coalesce("bankroll", F.lit(0.0)) + F.sum("change").over(w))
    done = out.where("amount >= 0").select("user_id", "moment", "seq", "amount", F.when(F.col("change") >= 0, "deposit").otherwise("withdraw").alias("action"))
    return journal_.select("user_id", "moment", "seq", "amount", "action").unionByName(done)


def combined_initial(rows: DataFrame, default: float = 1000.0) -> DataFrame:
    """A user's initial bankroll from several old journals: of each the first row called initial, else the first row, summed; the default without any."""
    at = F.struct("moment", "seq")
    each = rows.groupBy("user_id", "source").agg(F.coalesce(F.min_by("amount", F.when(F.col("action") == "initial", at)), F.min_by("amount", at)).alias("a"))
    return each.groupBy("user_id").agg(F.coalesce(F.sum("a"), F.lit(default)).alias("initial"))


def initialised(files: DataFrame, users: DataFrame, default: float = 1000.0) -> DataFrame:
    """(user_id, initial, bankroll) of all users: a file's initial amount, without one its bankroll; users without a file start with the default."""
    start = F.coalesce("initial", "bankroll", F.lit(default))
    have = files.select("user_id", start.alias("initial"), F.coalesce("bankroll", start).alias("bankroll"))
    return have.unionByName(unknown(users.select("user_id").distinct(), files, "user_id").withColumns({"initial": F.lit(default), "bankroll": F.lit(default)}))


def saved(files: DataFrame, amounts: DataFrame) -> DataFrame:
    """Files with the bankrolls of (user_id, bankroll): the initial amount stays, a new file's is its first bankroll."""
    new = amounts.select(F.col("user_id").alias("_u"), F.col("bankroll").alias("_b"))
    both = files.join(new, F.col("user_id") == F.col("_u"), "full")
    return both.select(F.coalesce("user_id", "_u").alias("user_id"), F.coalesce("initial", "_b").alias("initial"), F.coalesce("_b", "bankroll").alias("bankroll"))


def listed(events: DataFrame, sport: str | None = None, with_completed: bool = True) -> DataFrame:
    """Events of a sport, or of all, upcoming ones first, by time (those without one before others), the newest of one time first."""
    rows = events if sport is None else events.where(F.col("sport") == sport)
    rows = rows if with_completed else rows.where(F.col("status") == "upcoming")
    return rows.orderBy(F.when(F.col("status") == "upcoming", 0).otherwise(1), F.coalesce(F.col("event_datetime").cast("string"), F.lit("")), F.desc("event_id"))


def deletable(events: DataFrame, bets: DataFrame) -> DataFrame:
    """Events without a bet, which alone may be deleted."""
    return events.join(bets.select("event_id").distinct(), "event_id", "left_anti")


def imported(raw: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Legacy rows (pick, player_1, player_2, odds, stake, status, result, date) as ledger rows, with columns to keep; stakes of 0 or less go."""
    stake, result = S.first_number("stake"), S.normal_result("result")
    odds = F.coalesce(S.valid_odds(S.first_number("odds")), F.lit(1.01))
    out = raw.select(
        *(keep or []),
        S.pick_side("pick", "player_1", "player_2").alias("pick"),
        odds.alias("odds"),
        stake.alias("stake"),
        F.when(F.lower("status").isin("closed", "resolved") | result.isNotNull(), "resolved").otherwise("open").alias("status"),
        result.alias("result"),
        S.parse_moment("date").alias("moment"),
    ).where(F.col("stake") > 0)
    return out.withColumn("profit", F.when(F.col("status") == "resolved", S.settled_profit("stake", "odds", "result")))


def next_id(df: DataFrame, column: str) -> DataFrame:
    return df.agg((F.coalesce(F.max(column), F.lit(0)) + 1).alias("next_id"))


def journal(rows: DataFrame) -> DataFrame:
    """A user's last journal amount that isn't null, and the first as the initial one."""
    at = F.struct("moment", "seq")
    known = F.col("amount").isNotNull()
    return rows.groupBy("user_id").agg(F.max_by("amount", F.when(known, at)).alias("bankroll"), F.min_by("amount", F.when(known, at)).alias("initial"))


def calendar(contests: DataFrame, key: str, as_of: str, gap_days: int = 60) -> DataFrame:
    """Editions of each tournament with their span, size and state on a day."""
    from tallyline.operators.asof import editions

    day = F.lit(as_of).cast("date")
    out = editions(contests, key, "date", gap_days).groupBy(key, "edition").agg(F.min("date").alias("start"), F.max("date").alias("end"), F.count(F.lit(1)).alias("n"))
    return out.withColumn("state", F.when(F.col("end") < day, "past").when(F.col("start") > day, "coming").otherwise("running"))


def projected(cal: DataFrame, key: str, days: int = 30) -> DataFrame:
    """Last editions moved a year on, unless one is already near that time."""
    from tallyline.operators.joins import without_neighbours

    last = cal.groupBy(key).agg(F.max_by(F.struct("start", "end", "n"), "edition").alias("l"))
    moved = last.select(key, F.add_months("l.start", 12).alias("start"), F.add_months("l.end", 12).alias("end"), F.col("l.n").alias("n"))
    return without_neighbours(moved, cal, key, "start", days).withColumn("state", F.lit("projected"))
