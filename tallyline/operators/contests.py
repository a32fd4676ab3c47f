"""Two-sided contests and their one-sided appearances.

The driver's star schema is seen as contests: an order whose first and last lines come from two
suppliers is a contest of these, its lines' quantities give the prices of the two sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.functions.scalars import lookup
from tallyline.session import table


#: What the driver's values stand for: priorities are surfaces, segments are series.
SURFACES = {"1-URGENT": "Hard", "2-HIGH": "Clay", "3-MEDIUM": "Grass", "4-NOT SPECIFIED": "Carpet", "5-LOW": "Hard"}
SERIES = {"AUTOMOBILE": "ATP250", "BUILDING": "Grand Slam", "FURNITURE": "Masters 1000", "HOUSEHOLD": "ATP500", "MACHINERY": "International"}
ROUNDS = ("1st Round", "2nd Round", "3rd Round", "4th Round", "Quarterfinals", "Semifinals", "The Final")
TOWNS = ("Paris", "Vienna", "Rome", "Madrid", "Halle", "Miami", "Dubai", "Metz", "Lyon", "Basel")


def contests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contests in a total order by (date, contest_id).

    contest_id, date, p1, p2, win1, surface, series, status, round, tournament, best_of, odds, ranks
    and points of both sides (-1 where the source has none), stake.
    """
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    ends = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min(line).alias("a"), F.max(line).alias("z"))
    ends = ends.where(F.col("a.l_suppkey") != F.col("z.l_suppkey"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority", "o_orderstatus", "o_totalprice")
    segments = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    odds = lambda end: F.round(1.1 + F.col(f"{end}.l_quantity") / 10, 2)
    pick = lambda names, k: F.get(F.lit(list(names)), (k % len(names)).cast("int"))
    rank = lambda end: (F.col(f"{end}.l_partkey") % 211 - 1).cast("int")
    points = lambda end: (F.col(f"{end}.l_partkey") % 997 * 7 - 1).cast("int")
    return (
        ends.join(orders, ends.l_orderkey == orders.o_orderkey)
        .join(segments, F.col("o_custkey") == F.col("c_custkey"))
        .select(
            F.col("o_orderkey").alias("contest_id"),
            F.to_date("o_orderdate").alias("date"),
            F.col("a.l_suppkey").alias("p1"),
            F.col("z.l_suppkey").alias("p2"),
            (F.col("a.l_extendedprice") >= F.col("z.l_extendedprice")).cast("int").alias("win1"),
            lookup("o_orderpriority", SURFACES, "Hard").alias("surface"),
            lookup("c_mktsegment", SERIES, "ATP250").alias("series"),
            F.col("o_orderstatus").alias("status"),
            pick(ROUNDS, F.col("o_orderkey")).alias("round"),
            pick(TOWNS, F.col("o_custkey")).alias("tournament"),
            F.when(F.col("c_mktsegment") == "BUILDING", 5).otherwise(3).alias("best_of"),
            odds("a").alias("odd1"),
            odds("z").alias("odd2"),
            rank("a").alias("rank_1"),
            rank("z").alias("rank_2"),
            points("a").alias("pts_1"),
            points("z").alias("pts_2"),
            F.col("o_totalprice").alias("stake"),
        )
    )


def appearances(c: DataFrame) -> DataFrame:
    """Two rows a contest, one per side, by one scan: player, opponent, won, odds and the contest's own columns."""
    side = lambda n, m, won: F.struct(
        F.lit(n).alias("side"), F.col(f"p{n}").alias("player"), F.col(f"p{m}").alias("opponent"), won.alias("won"), F.col(f"odd{n}").alias("odds")
    )
    sides = F.explode(F.array(side(1, 2, F.col("win1")), side(2, 1, 1 - F.col("win1"))))
    rest = [x for x in c.columns if x not in ("p1", "p2", "win1", "odd1", "odd2", "rank_1", "rank_2", "pts_1", "pts_2")]
    return c.withColumn("_s", sides).select(*rest, "_s.*")


def _case(column: str, table: dict[str, str]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + " END"


#: The same view for DuckDB; every oracle that needs it begins with it.
SQL = f"""
ends AS (SELECT l_orderkey, min({{'n': l_linenumber, 'p': l_partkey, 's': l_suppkey, 'e': l_extendedprice, 'q': l_quantity}}) AS a,
  max({{'n': l_linenumber, 'p': l_partkey, 's': l_suppkey, 'e': l_extendedprice, 'q': l_quantity}}) AS z FROM lineitem GROUP BY l_orderkey),
c0 AS (SELECT o_orderkey AS contest_id, CAST(o_orderdate AS DATE) AS date, a.s AS p1, z.s AS p2, CAST(a.e >= z.e AS INTEGER) AS win1,
  {_case("o_orderpriority", SURFACES)} AS surface, {_case("c_mktsegment", SERIES)} AS series, o_orderstatus AS status,
  {list(ROUNDS)}[o_orderkey % {len(ROUNDS)} + 1] AS round, {list(TOWNS)}[o_custkey % {len(TOWNS)} + 1] AS tournament, CASE WHEN c_mktsegment = 'BUILDING' THEN 5 ELSE 3 END AS best_of,
  round(1.1::DOUBLE + a.q / 10.0::DOUBLE, 2) AS odd1, round(1.1::DOUBLE + z.q / 10.0::DOUBLE, 2) AS odd2,
  CAST(a.p % 211 - 1 AS INTEGER) AS rank_1, CAST(z.p % 211 - 1 AS INTEGER) AS rank_2, CAST(a.p % 997 * 7 - 1 AS INTEGER) AS pts_1, CAST(z.p % 997 * 7 - 1 AS INTEGER) AS pts_2,
  o_totalprice AS stake FROM ends JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE a.s <> z.s),
app AS (SELECT contest_id, date, surface, series, status, round, tournament, best_of, stake, 1 AS side, p1 AS player, p2 AS opponent, win1 AS won, odd1 AS odds FROM c0
  UNION ALL SELECT contest_id, date, surface, series, status, round, tournament, best_of, stake, 2, p2, p1, 1 - win1, odd2 FROM c0)
"""
