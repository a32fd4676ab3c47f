"""Scans, conforming and sinks of the domain's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.functions import scalars as S

# Columns of the input files and of the price feed, and the statistics of a page with their labels.
MATCHES = (
    "Tournament string, Date string, Series string, Court string, Surface string, Round string, `Best of` int, Player_1 string, Player_2 string, "
    "Winner string, Rank_1 int, Rank_2 int, Pts_1 int, Pts_2 int, Odd_1 double, Odd_2 double, Score string"
)
FEED = (
    "id string, home_team string, away_team string, commence_time string, "
    "bookmakers array<struct<key:string,title:string,last_update:string,markets:array<struct<key:string,outcomes:array<struct<name:string,price:double>>>>>>"
)


def read_csv(spark: SparkSession, path: str, schema: str = MATCHES) -> DataFrame:
    """A declared schema, so nothing is read twice to infer one; cells that don't fit become null."""
    return spark.read.csv(path, header=True, schema=schema, mode="PERMISSIVE")


def conform(df: DataFrame, aliases: dict[str, str], defaults: dict[str, object]) -> DataFrame:
    """Rename what has another name, add what is absent."""
    df = df.withColumnsRenamed({a: b for a, b in aliases.items() if a in df.columns and b not in df.columns})
    return df.withColumns({c: F.lit(v) for c, v in defaults.items() if c not in df.columns})


def matches(df: DataFrame, source: str = "ATP") -> DataFrame:
    """Clean matches: parsed dates, no sentinels, rows without date or players gone, the first player as winner where none is given."""
    out = conform(df, {"Best_of": "Best of", "date": "Date"}, {"Surface": "Hard", "Series": "ATP250", "Round": "1st Round", "Best of": 3, "Rank_1": None, "Rank_2": None})
    out = out.withColumns({"Date": S.parse_moment("Date").cast("date")} | {c: F.trim(c) for c in ("Player_1", "Player_2")})
    out = out.dropna(subset=["Date", "Player_1", "Player_2"]).withColumn("Winner", F.coalesce(F.col("Winner") if "Winner" in out.columns else F.lit(None), "Player_1"))
    clean = {c: S.valid_odds(c) for c in ("Odd_1", "Odd_2") if c in out.columns} | {c: S.sentinel_to_null(c) for c in ("Rank_1", "Rank_2", "Pts_1", "Pts_2") if c in out.columns}
    return out.withColumns(clean | {"Source": F.lit(source)})


#: Marks in a score that tell an unfinished match.
UNFINISHED = ("W/O", "RET", "DEF", "w/o", "ret", "def", "Walkover")


def completed(score: str) -> Column:
    """Matches whose score doesn't tell of an early end; without a score nothing tells of one."""
    return ~F.coalesce(F.col(score).rlike("|".join(UNFINISHED)), F.lit(False))


def results(raw: DataFrame, key: list[str]) -> DataFrame:
    """Raw winner / loser rows as two-sided matches: completed ones, sides swapped by a hash, the first price that is there, score text."""
    swap = S.swap_side(*key)
    pick = lambda a, b: F.when(swap, F.col(b)).otherwise(F.col(a))
    price = lambda s: F.coalesce(*(S.valid_odds(c + s) for c in ("PS", "B365", "Avg") if c + s in raw.columns), F.lit(-1.0))
    sets = [(f"W{i}", f"L{i}") for i in range(1, 6) if f"W{i}" in raw.columns]
    done = raw.where(F.coalesce(F.col("Comment") == "Completed", F.lit(False)))
    return done.select(
        *key,
        pick("Winner", "Loser").alias("Player_1"),
        pick("Loser", "Winner").alias("Player_2"),
        F.col("Winner"),
        F.when(swap, price("L")).otherwise(price("W")).alias("Odd_1"),
        F.when(swap, price("W")).otherwise(price("L")).alias("Odd_2"),
        S.set_scores(sets, swap).alias("Score"),
    )


def prices(feed: DataFrame, market: str = "h2h") -> DataFrame:
    """Nested price feed as events with books of two prices; sides or markets that lack a price are left out."""
    def book(b: Column) -> Column:
        m = F.get(F.filter(b["markets"], lambda x: x["key"] == market), 0)
        price = lambda name: F.get(F.filter(m["outcomes"], lambda o: o["name"] == F.col(name)), 0)["price"]
        return F.struct(b["title"].alias("name"), price("home_team").alias("price_1"), price("away_team").alias("price_2"))

    return feed.select(F.col("id").alias("event_id"), "home_team", "away_team", S.parse_moment(F.left("commence_time", F.lit(19))).alias("start"), F.transform("bookmakers", book).alias("books"))


def preferred(events: DataFrame, prefixes: list[str]) -> DataFrame:
    """An event's book of the first prefix that any book's name starts with, in lower case; else its first book; books without both prices don't count.

    events are those of prices(); adds bookmaker, odds_home and odds_away, and all books as maps of their prices.
    """
    whole = F.filter("books", lambda b: b["price_1"].isNotNull() & b["price_2"].isNotNull())

    def rank(name: Column) -> Column:
        out = F.lit(len(prefixes))
        for i, p in reversed(list(enumerate(prefixes))):
            out = F.when(F.startswith(F.lower(name), F.lit(p)), i).otherwise(out)
        return out

    order = F.array_min(F.transform(whole, lambda b, i: F.struct(rank(b["name"]).alias("r"), i.alias("i"), b.alias("b"))))["b"]
    maps = F.transform(whole, lambda b: F.struct(b["name"].alias("name"), F.create_map(F.col("home_team"), b["price_1"], F.col("away_team"), b["price_2"]).alias("odds")))
    return events.withColumns({"bookmaker": order["name"], "odds_home": order["price_1"], "odds_away": order["price_2"], "all_bookmakers": maps})


def rows_of_page(pages: DataFrame, html: str = "html") -> DataFrame:
    """Rows of a page's tables that carry a link, with the names and links in their second cell: (page_id, row_url, names, urls)."""
    rows = F.regexp_extract_all(html, F.lit(r'(?s)<tr[^>]*data-link="[^"]*".*?</tr>'), F.lit(0))
    each = pages.select("page_id", F.posexplode(rows).alias("seq", "r"))
    cell = F.get(F.regexp_extract_all("r", F.lit(r"(?s)<td[^>]*>(.*?)</td>"), F.lit(1)), 1)
    names = F.transform(F.regexp_extract_all(cell, F.lit(r"(?s)<a[^>]*>(.*?)</a>"), F.lit(1)), lambda x: F.trim(x))
    out = each.select(
        "page_id", "seq", F.regexp_extract("r", 'data-link="([^"]*)"', 1).alias("row_url"), names.alias("names"),
        F.regexp_extract_all(cell, F.lit('<a[^>]*href="([^"]*)"'), F.lit(1)).alias("urls"),
    )
    return out.where((F.size("names") >= 2) & (F.col("row_url") != ""))


#: Words in a label that tell its statistic, in the order in which they are tried, and how its text is read.
STATISTICS = (("kd", "kd", "number"), ("sig. str", "sig", "of"), ("total str", "tot", "of"), ("sub", "sub_att", "number"), ("td", "td", "of"), ("ctrl", "ctrl_secs", "clock"))


def person_facts(pages: DataFrame, html: str = "html") -> DataFrame:
    """The two persons of a page: name, link, statistics by their labels, and whether they won, told by the class of their mark.

    Sections begin at an element of class person; a label is in one of class person-title, its text in the next of class person-text.
    """
    parts = F.slice(F.split(html, r'(?=<div[^>]*class="[^"]*person")'), 2, 2)
    each = pages.select("page_id", F.posexplode(parts).alias("side", "s"))
    name = F.regexp_extract("s", r'(?s)person-name[^>]*>\s*<a[^>]*href="([^"]*)"[^>]*>\s*(.*?)\s*</a>', 2)
    labels = F.transform(F.regexp_extract_all("s", F.lit(r'(?s)person-title[^>]*>\s*(.*?)\s*<'), F.lit(1)), lambda x: F.lower(x))
    values = F.regexp_extract_all("s", F.lit(r'(?s)person-text[^>]*>\s*(.*?)\s*<'), F.lit(1))
    each = each.withColumns({"fighter_name": name, "fighter_url": F.regexp_extract("s", r'(?s)person-name[^>]*>\s*<a[^>]*href="([^"]*)"', 1), "_l": labels, "_v": values})
    known = lambda word: F.transform("_l", lambda x: x.contains(word))
    columns = {}
    for word, stat, kind in STATISTICS:
        found = F.get("_v", F.nullif(F.array_position(known(word), True), F.lit(0)).cast("int") - 1)
        if kind == "of":
            landed, tried = S.x_of_y(found)
            columns |= {f"{stat}_lnd": landed, f"{stat}_att": tried}
        else:
            columns[stat] = S.first_number(found) if kind == "number" else S.clock_seconds(found)
    mark = F.regexp_extract("s", 'class="([^"]*person-status[^"]*)"', 1)
    won = F.when(mark.contains("green"), 1).when(mark != "", 0)
    return each.withColumns(columns | {"result_win": won}).where("fighter_name <> ''").drop("s", "_l", "_v")


def snapshot(spark: SparkSession, folder: str, names: list[str]) -> DataFrame:
    """The first of these Parquet tables in a folder that is there, newest version first; an absent one is passed over."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for name in names:
        at = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.parquet")
        if at.getFileSystem(conf).exists(at):
            return spark.read.parquet(f"{folder}/{name}.parquet").withColumn("version", F.lit(name))
    raise FileNotFoundError(f"none of {names} in {folder}")


def fighters(app: DataFrame, bio: DataFrame, ratings: DataFrame, as_of: str) -> DataFrame:
    """A person's last values, biography with age on a day, and latest rating; without one the initial one."""
    from tallyline.operators.aggregates import last_values

    stats = [c for c in app.columns if c not in ("player", "date", "contest_id", "side")]
    last = last_values(app, "player", ["date", "contest_id", "side"], stats)
    out = last.join(bio, "player", "left").join(ratings.select("player", "elo"), "player", "left")
    return out.withColumns({"age": S.age_years("born", F.lit(as_of).cast("date")), "elo": F.coalesce("elo", F.lit(1500.0))})


def searched(rows: DataFrame, column: str, text: str | None) -> DataFrame:
    """Rows whose column holds the text in either case; all without a text."""
    return rows if not text else rows.where(F.contains(F.lower(column), F.lit(text.lower())))


def links(pages: DataFrame, html: str = "html") -> DataFrame:
    """Links of each page with their ids."""
    found = F.regexp_extract_all(html, F.lit('<a href="([^"]*)"'), F.lit(1))
    return pages.select("page_id", F.explode(found).alias("href")).withColumn("id", S.url_id("href"))


def page_facts(pages: DataFrame, html: str = "html") -> DataFrame:
    """Title, language, links and paragraphs of each page."""
    n = lambda p: F.size(F.regexp_extract_all(html, F.lit(p), F.lit(0)))
    return pages.select(
        "page_id", F.regexp_extract(html, '<html lang="([a-z]*)"', 1).alias("lang"), F.regexp_extract(html, "<title>([^<]*)</title>", 1).alias("title"),
        n('<a href="').alias("n_links"), n("<p>").alias("n_paragraphs"), S.url_id("url").alias("id"),
    )


def recent(df: DataFrame, date: str, months: int, columns: list[str]) -> DataFrame:
    """Rows of the last months before the table's end, some columns."""
    end = df.agg(F.max(date).alias("_e"))
    return df.crossJoin(F.broadcast(end)).where(F.col(date) >= F.add_months("_e", -months)).select(*columns)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.csv(path, header=True, mode="overwrite")


def write_parquet(df: DataFrame, path: str, by: str | None = None) -> None:
    (df.write.partitionBy(by) if by else df.write).parquet(path, mode="overwrite")


def active(sports: DataFrame, prefix: str) -> DataFrame:
    return sports.where(F.col("key").startswith(prefix) & F.col("active"))


def cached_day(cache: DataFrame, day: str) -> DataFrame:
    """A day's part of a cache that is partitioned by date; other partitions aren't read."""
    return cache.where(F.col("date") == day)
