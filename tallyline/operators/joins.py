"""Joins of the domain: names, prices, ranges and fallbacks, each with an equality to shuffle by."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyline.functions.scalars import name_tokens, plain_name


def first_per_key(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key in the order given; ties must be settled by it."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def opponent_rows(app: DataFrame, columns: list[str]) -> DataFrame:
    """Each appearance with its opponent's columns as opp_*: a self equi-join on the contest, without itself."""
    other = app.select("contest_id", F.col("player").alias("_other"), *(F.col(c).alias(f"opp_{c}") for c in columns))
    return app.join(other, "contest_id").where(F.col("player") != F.col("_other")).drop("_other")


def both_sides(c: DataFrame, dim: DataFrame, key: str, columns: dict[str, str]) -> DataFrame:
    """Contests with columns of one dimension for both sides, as name_1 and name_2; unknown keys give null."""
    out = c
    for n in (1, 2):
        out = out.join(dim.select(F.col(key).alias(f"p{n}"), *(F.col(x).alias(f"{new}_{n}") for x, new in columns.items())), f"p{n}", "left")
    return out


def match_names(names: DataFrame, known: DataFrame, name: str = "name", other: str = "known_name", seq: str = "known_seq") -> DataFrame:
    """Best known name of each name: equal, else last name and initial, else last name; the earliest known wins.

    Candidates share the last token, which is the join key; every tier implies it.
    """
    tokens = lambda c: F.split(plain_name(c), " ")
    left = names.select(name).distinct().withColumns({"_p": plain_name(name), "_t": tokens(name)}).withColumn("_last", F.try_element_at("_t", F.lit(-1)))
    right = known.select(other, seq).withColumns({"_q": plain_name(other), "_u": tokens(other)}).withColumn("_last", F.try_element_at("_u", F.lit(-1)))
    initial = (F.size("_t") > 1) & (F.size("_u") > 1) & (F.left(F.get("_t", 0), F.lit(1)) == F.left(F.get("_u", 0), F.lit(1)))
    tier = F.when(F.col("_p") == F.col("_q"), 1).when(initial, 2).otherwise(3)
    best = left.where("_last <> ''").join(right, "_last").groupBy(name).agg(F.min(F.struct(tier.alias("tier"), F.col(seq), F.col(other))).alias("m"))
    return names.select(name).distinct().join(best, name, "left").select(name, F.col(f"m.{other}").alias(other), F.col("m.tier").alias("tier"))


#: Letters of the keys by which words meet that hold one another.
KEY = 8


def stretches(word: Column) -> Column:
    """All stretches of 1 to KEY letters of a word, each once."""
    of = lambda n: F.transform(F.sequence(F.lit(1), F.length(word) - n + 1), lambda i: F.substring(word, i, F.lit(n)))
    return F.array_distinct(F.flatten(F.array(*(F.when(F.length(word) >= n, of(n)).otherwise(F.array().cast("array<string>")) for n in range(1, KEY + 1)))))


def held_words(small: DataFrame, large: DataFrame, word: str, holder: str) -> DataFrame:
    """Pairs of words (word, holder) where the holder has the word in it, of any length.

    A word goes by its first KEY letters whole, a holder by all its stretches: what meets is held, but for
    words longer than a key, which are looked at. So there are about as many rows as hits, and each side
    comes in with each of its words once.
    """
    a = small.select(word).distinct().withColumn("_k", F.left(word, F.lit(KEY)))
    b = large.select(holder).distinct().withColumn("_k", F.explode(stretches(F.col(holder))))
    return a.join(b, "_k").where(F.contains(F.col(holder), F.col(word))).select(word, holder)


def score_names(names: DataFrame, known: DataFrame, name: str = "name", other: str = "known_name", seq: str = "known_seq", accept: float = 2.0) -> DataFrame:
    """Names as 'First Last' matched to known ones as 'Last F.' by score; the best of at least accept, the earliest on ties.

    3 for the last name as the first word known or as all words but the last, 2 where one holds the
    other, 1.5 where any word known holds it, and 1 more for the initial. Names of one or two letters
    are held by longer ones like any other.
    """
    a = names.select(name).distinct().withColumn("_t", F.filter(F.split(plain_name(name), " "), lambda w: w != "")).where(F.size("_t") >= 2)
    b = known.select(other, seq).withColumn("_u", F.filter(F.split(plain_name(other), " "), lambda w: w != "")).where(F.size("_u") > 0)
    all_but = F.when(F.size("_u") > 1, F.slice("_u", 1, F.size("_u") - 1)).otherwise(F.col("_u"))
    left = a.select(name, F.try_element_at("_t", F.lit(-1)).alias("_last"), F.left(F.get("_t", 0), F.lit(1)).alias("_i"), F.array_join(F.slice("_t", 2, F.size("_t")), " ").alias("_own"))
    right = b.select(other, seq, F.get("_u", 0).alias("_first"), F.array_join(all_but, " ").alias("_full"), all_but.alias("_w"), F.when(F.size("_u") > 1, F.left(F.try_element_at("_u", F.lit(-1)), F.lit(1))).alias("_j"))
    words = right.select(other, seq, "_first", "_full", "_j", F.explode(F.array_distinct("_w")).alias("_word"))
    rest = right.drop("_w")
    # Three ways to meet: a known word holds the last name, the last name holds the first known word, or all is equal.
    by_word = left.join(held_words(left, words, "_last", "_word"), "_last").join(words, "_word").drop("_word")
    by_first = left.join(held_words(rest, left, "_first", "_last"), "_last").join(rest, "_first")
    columns = [name, "_last", "_i", "_own", other, seq, "_first", "_full", "_j"]
    pairs = by_word.select(columns).unionByName(by_first.select(columns)).unionByName(left.join(rest, F.col("_own") == F.col("_full")).select(columns))
    base = (
        F.when(F.col("_last") == F.col("_first"), 3.0).when(F.contains("_first", "_last") | F.contains("_last", "_first"), 2.0)
        .when(F.col("_own") == F.col("_full"), 3.0).when(F.contains("_full", "_last"), 1.5)
    )
    score = base + F.when(F.col("_j") == F.col("_i"), 1.0).otherwise(0.0)
    best = pairs.select(name, score.alias("score"), other, seq).where(F.col("score") >= accept)
    top = best.groupBy(name).agg(F.min(F.struct((-F.col("score")).alias("s"), F.col(seq).alias("q"), F.col(other).alias("o"))).alias("m"))
    return top.select(name, F.col("m.o").alias(other), (-F.col("m.s")).alias("score"))


def first_available(df: DataFrame, dims: list[tuple[DataFrame, str, str]], value: str, default: object = None) -> DataFrame:
    """Look value up in several dimensions (table, left key, right key) in turn; is_new where none has it."""
    out = df
    for i, (dim, left, right) in enumerate(dims):
        unique = dim.select(F.col(right).alias(f"_k{i}"), F.col(value).alias(f"_v{i}")).dropDuplicates([f"_k{i}"])
        out = out.join(unique, F.col(left) == F.col(f"_k{i}"), "left").drop(f"_k{i}")
    found = F.coalesce(*(F.col(f"_v{i}") for i in range(len(dims))))
    return out.withColumns({value: F.coalesce(found, F.lit(default)), "is_new": found.isNull().cast("int")}).drop(*(f"_v{i}" for i in range(len(dims))))


#: Days of a block at each level, by which spans and days meet.
LEVELS = tuple(8**k for k in range(6))


def blocks_of(start: Column, end: Column) -> Column:
    """Blocks (level, block) that make up the days start to end, ends included: the largest that fit, so a few at each level."""

    def run(level: int, a: Column, z: Column) -> Column:
        blocks = F.transform(F.sequence(a.cast("long"), z.cast("long")), lambda b: F.struct(F.lit(level).alias("level"), b.alias("block")))
        return F.when(a <= z, blocks).otherwise(F.array().cast("array<struct<level:int,block:long>>"))

    out = []
    low = [F.ceil(start / size) for size in LEVELS]
    high = [F.floor((end + 1) / size) - 1 for size in LEVELS]
    ratio = LEVELS[1]
    for k in range(len(LEVELS)):
        parts = [(low[k], high[k])]
        if k + 1 < len(LEVELS):
            larger = low[k + 1] <= high[k + 1]
            parts = [(low[k], F.when(larger, low[k + 1] * ratio - 1).otherwise(high[k])), (F.when(larger, (high[k + 1] + 1) * ratio).otherwise(high[k] + 1), high[k])]
        out += [run(k, a, z) for a, z in parts]
    return F.flatten(F.array(*out))


def in_range(spans: DataFrame, rows: DataFrame, key: str, start: str, end: str, at: str, best: Column) -> DataFrame:
    """The best (least) row of the same key within each span, ends included, null without one.

    The best of every block of days is found first, at each level, and a span reads the few blocks that
    make it up: rows grow with the rows and spans, however many of one key fall into a span. Places are days, or whole numbers.
    """
    whole = isinstance(rows.schema[at].dataType, T.IntegralType)
    day = lambda c: F.col(c).cast("long") if whole else F.unix_date(F.col(c).cast("date"))
    held = F.explode(F.array(*(F.struct(F.lit(k).alias("level"), F.floor(day(at) / size).cast("long").alias("block")) for k, size in enumerate(LEVELS))))
    points = rows.where(F.col(key).isNotNull() & F.col(at).isNotNull()).select(F.col(key).alias("_key"), best.alias("_b"), held.alias("_h"))
    tops = points.groupBy("_key", F.col("_h.level").alias("_level"), F.col("_h.block").alias("_block")).agg(F.min("_b").alias("_b"))
    own = spans.select(key, start, end).distinct()
    asked = own.withColumn("_n", F.explode_outer(F.when(F.col(start) <= F.col(end), blocks_of(day(start), day(end)))))
    met = (F.col(key) == F.col("_key")) & (F.col("_n.level") == F.col("_level")) & (F.col("_n.block") == F.col("_block"))
    return asked.join(tops, met, "left").groupBy(key, start, end).agg(F.min("_b").alias("hit"))


def without_neighbours(rows: DataFrame, others: DataFrame, key: str, date: str, days: int = 30, same_day: bool = True) -> DataFrame:
    """Rows without another of the same key and year less than so many days away; same_day: one of the very day counts.

    Days are cut into buckets as wide as the distance: whatever is in a row's own bucket is near, of the
    buckets beside it the last and the first day decide. Each bucket is one row, so a hot key stays linear.
    """
    day, year = F.unix_date(F.col(date).cast("date")), F.year(date)
    bucket = lambda d: F.floor(d / days).cast("long")
    ends = others.where(F.col(date).isNotNull()).groupBy(F.col(key).alias("_k"), year.alias("_y"), bucket(day).alias("_b")).agg(F.min(day).alias("_min"), F.max(day).alias("_max"))
    at = lambda shift, c: F.max(F.when(F.col("_t") == F.col("_b") + shift, F.col(c)))
    spread = ends.withColumn("_t", F.explode(F.array(*(F.col("_b") + k for k in (-1, 0, 1)))))
    beside = spread.groupBy("_k", "_y", "_t").agg(at(1, "_max").alias("_before"), at(0, "_min").alias("_low"), at(0, "_max").alias("_high"), at(-1, "_min").alias("_after"))
    near = (day - F.col("_before") < days) | (F.col("_after") - day < days)
    inside = F.col("_low").isNotNull() if same_day else (F.col("_low") != day) | (F.col("_high") != day)
    out = rows.join(beside, (F.col(key) == F.col("_k")) & (year == F.col("_y")) & (bucket(day) == F.col("_t")), "left")
    return out.where(~F.coalesce(near | inside, near, inside, F.lit(False))).select(*rows.columns)


def latest_by_side(c: DataFrame, players: DataFrame, value_1: str, value_2: str, default: object) -> DataFrame:
    """Latest value of each player, from first-side rows if there are any, else from second-side ones."""
    one = c.groupBy(F.col("p1").alias("player")).agg(F.max_by(value_1, F.struct("date", "contest_id")).alias("_a"))
    two = c.groupBy(F.col("p2").alias("player")).agg(F.max_by(value_2, F.struct("date", "contest_id")).alias("_b"))
    out = players.join(one, "player", "left").join(two, "player", "left")
    return out.withColumn("value", F.coalesce("_a", "_b", F.lit(default))).drop("_a", "_b")


def best_prices(feed: DataFrame, priority: list[str]) -> DataFrame:
    """Prices of an event from nested books: the best, the mean market's fair chance, the books, the preferred book's.

    feed: event_id and books array<struct<name, price_1, price_2>>; books without both prices don't count.
    """
    books = F.filter("books", lambda b: (b["price_1"] > 1) & (b["price_2"] > 1))
    out = feed.withColumn("_b", books).where(F.size("_b") > 0)
    rank = lambda b: F.when(F.array_position(F.lit(priority), b["name"]) > 0, F.array_position(F.lit(priority), b["name"])).otherwise(999)
    order = F.array_min(F.transform("_b", lambda b: F.struct(rank(b).alias("r"), b["name"].alias("name"), b["price_1"].alias("a"), b["price_2"].alias("b"))))
    mean = lambda f: F.aggregate("_b", F.lit(0.0), lambda s, b: s + 1 / b[f]) / F.size("_b")
    return out.select(
        "event_id",
        F.array_max(F.transform("_b", lambda b: b["price_1"])).alias("best_1"),
        F.array_max(F.transform("_b", lambda b: b["price_2"])).alias("best_2"),
        (mean("price_1") / (mean("price_1") + mean("price_2"))).alias("fair_1"),
        F.size("_b").alias("n_books"),
        order["name"].alias("bookmaker"),
        order["a"].alias("odds_1"),
        order["b"].alias("odds_2"),
        F.map_from_entries(F.transform("_b", lambda b: F.struct(b["name"], b["price_1"]))).alias("prices"),
    )
