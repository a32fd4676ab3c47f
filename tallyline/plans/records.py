"""Queries of scalars, predicates, joins, ledgers, sources and sorts, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyline.functions import scalars as S
from tallyline.operators import aggregates as A
from tallyline.operators import asof, decision, features, joins, ledger
from tallyline.operators.contests import SQL as C0
from tallyline.operators.contests import appearances, contests
from tallyline.plans.catalog import BETS, LEDGER, MEASURES, PRICED, bets, dated, ledger_bets, priced, rounded
from tallyline.plans.registry import query
from tallyline.session import scratch, table, written
from tallyline.sources import tables as sources


# Scalars.
@query("f05_f09_stakes", f"""WITH {PRICED}, k AS (SELECT *, (p1_prob * (odd1 - 1) - (1 - p1_prob)) / (odd1 - 1) AS k, p1_prob * odd1 - 1 AS ev FROM priced)
SELECT contest_id, round(CASE WHEN p1_prob - 1 / odd1 >= 0.035::DOUBLE AND ev > 0 AND ev <= 0.5 AND odd1 >= 1.2::DOUBLE AND odd1 <= 5 AND k > 0 THEN greatest(0.01::DOUBLE, least(k / 2.75::DOUBLE, 0.1::DOUBLE)) ELSE 0 END, 9) AS gated,
round(1000 * greatest(0.0::DOUBLE, least(ev / (odd1 - 1) * 0.25, 0.1::DOUBLE)), 6) AS quarter, round(1000 * greatest(0.0::DOUBLE, least((0.83::DOUBLE * odd1 - 1) / (odd1 - 1) * 0.15::DOUBLE, 0.1::DOUBLE)), 6) AS fixed_p, round(1000 * greatest(0.01::DOUBLE, least(k / 6, 0.08::DOUBLE)), 6) AS ui_kelly, ev > 0 AS ui_bets,
30.0::DOUBLE AS ui_flat, CASE WHEN p1_prob - 1 / odd1 >= 0.0201 THEN greatest(0, least(25.0, stake)) ELSE 0.0 END AS flat FROM k""")
def f05_f09_stakes(spark, sf_dir):
    rule = {"min_edge": 0.035, "max_ev": 0.5, "min_odds": 1.2, "max_odds": 5.0, "divisor": 2.75, "low": 0.01, "high": 0.1}
    c, bank = priced(spark, sf_dir), F.lit(1000.0)
    kelly, does = S.table_stake("p1_prob", "odd1", bank, {"type": "kelly", "kelly_fraction": 6.0, "max_bet_fraction": 0.08, "min_bet_pct": 0.01})
    flat, _ = S.table_stake("p1_prob", "odd1", bank, {"type": "flat", "stake_pct": 0.03})
    return c.select(
        "contest_id", F.round(S.gated_kelly("p1_prob", "odd1", S.implied("odd1"), rule), 9).alias("gated"), F.round(S.quarter_kelly("p1_prob", "odd1", bank), 6).alias("quarter"),
        F.round(S.quarter_kelly(F.lit(0.83), "odd1", bank, 0.15), 6).alias("fixed_p"), F.round(kelly, 6).alias("ui_kelly"), does.alias("ui_bets"), flat.alias("ui_flat"),
        S.gated_flat(25.0, "p1_prob", S.implied("odd1"), "stake", 0.0201).alias("flat"),
    )


@query("f15_f27_scalars", f"""WITH {C0}, x AS (SELECT *, CASE WHEN rank_1 > 0 THEN rank_1::DOUBLE ELSE 100.0::DOUBLE END AS r1, CASE WHEN rank_2 > 0 THEN rank_2::DOUBLE ELSE 100.0::DOUBLE END AS r2 FROM c0)
SELECT contest_id, r1 - r2 AS rank_diff, round(r1 / r2, 6) AS rank_ratio, round(ln(r1 + 1) - ln(r2 + 1), 6) + 0.0 AS log_rank_diff, round(sin(month(date) * (2 * pi() / 12)), 6) + 0.0 AS month_sin, round(cos(month(date) * (2 * pi() / 12)), 6) + 0.0 AS month_cos,
CASE WHEN surface = 'Carpet' OR regexp_matches(lower(tournament), 'indoor|{'|'.join(S.INDOOR_TOWNS[1:])}') THEN 1 ELSE 0 END AS indoor, CAST(surface = 'Hard' AS INTEGER) AS is_hard, CAST(surface = 'Clay' AS INTEGER) AS is_clay, CAST(surface = 'Grass' AS INTEGER) AS is_grass,
round((date - DATE '1980-05-05') / 365.25, 6) AS age, CASE WHEN (rank_1 % 2 = 0) <> (rank_2 % 2 = 0) THEN 1 ELSE 0 END AS mismatch, round(pts_1 / greatest(pts_2, 1)::DOUBLE, 6) AS accuracy, round(CASE WHEN rank_2 <> 0 THEN rank_1 / rank_2::DOUBLE END, 6) AS ratio,
nullif(rank_1, -1) AS rank_or_null, odd1 > 1 AND odd2 > 1 AS has_odds, rank_1 > 0 AND rank_2 > 0 AS has_ranks, greatest(abs(rank_1), abs(pts_1), abs(rank_2)) AS widest, printf('%.2f', odd1) AS price_text, strftime(date, '%d/%m') AS day_text,
CASE series WHEN 'Grand Slam' THEN 5 WHEN 'Masters 1000' THEN 4 WHEN 'ATP500' THEN 3 WHEN 'ATP250' THEN 2 WHEN 'International' THEN 2 ELSE 1 END AS series_code FROM x""")
def f15_f27_scalars(spark, sf_dir):
    sin, cos = S.month_cycle("date")
    stance = lambda n: F.when(F.col(f"rank_{n}") % 2 == 0, "Southpaw").otherwise("Orthodox")
    return contests(spark, sf_dir).select(
        "contest_id", (S.safe_rank("rank_1") - S.safe_rank("rank_2")).alias("rank_diff"), F.round(S.safe_rank("rank_1") / S.safe_rank("rank_2"), 6).alias("rank_ratio"),
        rounded(S.log_rank_diff("rank_1", "rank_2"), 6).alias("log_rank_diff"), rounded(sin, 6).alias("month_sin"), rounded(cos, 6).alias("month_cos"), S.indoor("surface", "tournament").alias("indoor"),
        *(c.alias(n) for n, c in S.one_hot("surface", ["Hard", "Clay", "Grass"]).items()), F.round(S.age_years(F.lit("1980-05-05").cast("date"), "date"), 6).alias("age"),
        S.stance_mismatch(stance(1), stance(2)).alias("mismatch"), F.round(S.accuracy("pts_1", "pts_2"), 6).alias("accuracy"), F.round(S.safe_ratio("rank_1", "rank_2"), 6).alias("ratio"),
        S.sentinel_to_null("rank_1").alias("rank_or_null"), (S.valid_odds("odd1").isNotNull() & S.valid_odds("odd2").isNotNull()).alias("has_odds"), ((F.col("rank_1") > 0) & (F.col("rank_2") > 0)).alias("has_ranks"),
        S.widest("rank_1", "pts_1", "rank_2").alias("widest"), S.money_text("odd1").alias("price_text"), S.day_text("date").alias("day_text"), S.lookup("series", *S.SERIES_RANK["notebook"]).alias("series_code"),
    )


@query("f16_f33_texts", r"""WITH t AS (SELECT o_orderkey, o_custkey, printf('%02d:%02d', o_orderkey % 90, o_custkey % 60) AS clock, (o_orderkey % 40) || ' of ' || (o_custkey % 90) AS xy, 'about ' || (o_orderkey % 500 / 10.0::DOUBLE) || ' units' AS num,
 ['Win', ' won ', 'GAGNE', 'lost', 'perdu', 'void', 'push', 'what'][o_orderkey % 8 + 1] AS res, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%d/%m/%Y') WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d %H:%M') ELSE 'soon' END AS moment,
 'http://x.org/fight/' || CASE WHEN o_orderkey % 2 = 0 THEN md5(o_orderkey::VARCHAR) ELSE 'no-' || o_orderkey END AS url, 'Us er.' || o_custkey AS username, 'Nom' || (o_custkey % 7) || ' Fam' || (o_custkey % 11) AS a, 'Nom' || (o_custkey % 5) || ' Lig' || (o_custkey % 3) AS b, CASE o_orderkey % 3 WHEN 0 THEN 'Fam' || (o_custkey % 11) WHEN 1 THEN 'X. Lig' || (o_custkey % 3) ELSE 'Nobody' END AS pick FROM orders)
SELECT o_orderkey, CAST(split_part(clock, ':', 1) AS INTEGER) * 60 + CAST(split_part(clock, ':', 2) AS INTEGER) AS seconds, CAST(split_part(xy, ' of ', 1) AS INTEGER) AS x, CAST(split_part(xy, ' of ', 2) AS INTEGER) AS y, CAST(regexp_extract(num, '(-?\d+(?:\.\d+)?)', 1) AS DOUBLE) AS number,
 CASE WHEN lower(trim(res)) IN ('win', 'won', 'gagne') THEN 'win' WHEN lower(trim(res)) IN ('lost', 'perdu') THEN 'loss' WHEN lower(trim(res)) IN ('void', 'push') THEN 'void' END AS result,
 CAST(CASE o_orderkey % 4 WHEN 0 THEN strptime(moment, '%Y-%m-%d') WHEN 1 THEN strptime(moment, '%d/%m/%Y') WHEN 2 THEN strptime(moment, '%Y-%m-%d %H:%M') ELSE TIMESTAMP '2020-01-01' END AS VARCHAR) AS moment, CASE WHEN o_orderkey % 2 = 0 THEN md5(o_orderkey::VARCHAR) ELSE 'no-' || o_orderkey END AS id,
 regexp_replace(lower(trim(username)), '[^a-z0-9_.-]', '_', 'g') AS username, regexp_matches(username, '^[A-Za-z0-9_.-]{3,32}$') AS valid, CASE o_orderkey % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' END AS side, CASE WHEN o_orderkey % 5 = 0 THEN '4-6' ELSE '6-4' END || CASE WHEN o_custkey % 2 = 0 THEN '' WHEN o_orderkey % 5 = 0 THEN ' 5-7' ELSE ' 7-5' END AS score,
 printf('%.1f', o_orderkey % 100 / 3.0::DOUBLE) || '%' AS share FROM t""")
def f16_f33_texts(spark, sf_dir):
    c, k, u = F.col, F.col("o_orderkey"), F.col("o_custkey")
    s = lambda x: x.cast("string")
    t = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", F.format_string("%02d:%02d", k % 90, u % 60).alias("clock"), F.concat(s(k % 40), F.lit(" of "), s(u % 90)).alias("xy"), F.concat(F.lit("about "), s(k % 500 / 10), F.lit(" units")).alias("num"),
        F.get(F.lit(["Win", " won ", "GAGNE", "lost", "perdu", "void", "push", "what"]), (k % 8).cast("int")).alias("res"),
        F.when(k % 4 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(k % 4 == 1, F.date_format("o_orderdate", "dd/MM/yyyy")).when(k % 4 == 2, F.date_format("o_orderdate", "yyyy-MM-dd HH:mm")).otherwise("soon").alias("moment"),
        F.concat(F.lit("http://x.org/fight/"), F.when(k % 2 == 0, F.md5(s(k))).otherwise(F.concat(F.lit("no-"), s(k)))).alias("url"), F.concat(F.lit("Us er."), s(u)).alias("username"),
        F.concat(F.lit("Nom"), s(u % 7), F.lit(" Fam"), s(u % 11)).alias("a"), F.concat(F.lit("Nom"), s(u % 5), F.lit(" Lig"), s(u % 3)).alias("b"),
        F.when(k % 3 == 0, F.concat(F.lit("Fam"), s(u % 11))).when(k % 3 == 1, F.concat(F.lit("X. Lig"), s(u % 3))).otherwise("Nobody").alias("pick"),
        F.lit(6).alias("w1"), F.lit(4).alias("l1"), F.when(u % 2 == 1, 7).alias("w2"), F.when(u % 2 == 1, 5).alias("l2"),
    )
    x, y = S.x_of_y("xy")
    return t.select(
        "o_orderkey", S.clock_seconds("clock").alias("seconds"), x.alias("x"), y.alias("y"), S.first_number("num").alias("number"), S.normal_result("res").alias("result"),
        F.coalesce(S.parse_moment("moment"), F.lit("2020-01-01").cast("timestamp_ntz")).cast("string").alias("moment"), S.url_id("url").alias("id"), S.safe_username("username").alias("username"), S.valid_username("username").alias("valid"),
        S.pick_side("pick", "a", "b").alias("side"), S.set_scores([("w1", "l1"), ("w2", "l2")], c("o_orderkey") % 5 == 0).alias("score"), S.percent_text(k % 100 / 300.0).alias("share"),
    )


_CLAY, _GRASS, _SLAM = ("|".join(x) for x in (S.CLAY_WORDS, S.GRASS_WORDS, S.SLAM_KEYS))


@query("f29_tournaments", rf"""WITH t AS (SELECT c_custkey, 'tennis_atp_' || ['french_open', 'monte_carlo_masters', 'halle', 'us_open', 'dubai', 'queens_club', 'paris_masters', 'lyon'][c_custkey % 8 + 1] AS key, CASE WHEN c_custkey % 3 = 0 THEN '' WHEN c_custkey % 3 = 1 THEN 'ATP ' || ['French Open', 'Monte Carlo Masters', 'Halle', 'US Open', 'Dubai', 'Queens Club', 'Paris Masters', 'Lyon'][c_custkey % 8 + 1] ELSE 'WTA Grand Slam Cup' END AS title FROM customer),
l AS (SELECT *, lower(CASE WHEN title = '' THEN key ELSE title END) AS told, lower(key) AS k FROM t)
SELECT c_custkey, CASE WHEN title = '' THEN array_to_string(list_transform(string_split(replace(key, 'tennis_atp_', ''), '_'), lambda x: upper(x[1]) || lower(x[2:])), ' ') ELSE replace(replace(title, 'ATP ', ''), 'WTA ', '') END AS name,
CASE WHEN contains(told, 'grand slam') OR regexp_matches(k, '{_SLAM}') THEN 'Grand Slam' WHEN contains(told, 'masters') OR contains(k, 'masters') THEN 'Masters 1000' ELSE 'ATP' END AS series,
CASE WHEN regexp_matches(k, '{_CLAY}') OR regexp_matches(told, '{_CLAY}') THEN 'Clay' WHEN regexp_matches(k, '{_GRASS}') OR regexp_matches(told, '{_GRASS}') THEN 'Grass' ELSE 'Hard' END AS surface, CASE WHEN contains(told, 'grand slam') OR regexp_matches(k, '{_SLAM}') THEN 5 ELSE 3 END AS best_of FROM l""")
def f29_tournaments(spark, sf_dir):
    k = F.col("c_custkey")
    keys = ["french_open", "monte_carlo_masters", "halle", "us_open", "dubai", "queens_club", "paris_masters", "lyon"]
    titles = ["French Open", "Monte Carlo Masters", "Halle", "US Open", "Dubai", "Queens Club", "Paris Masters", "Lyon"]
    t = table(spark, sf_dir, "customer").select(
        "c_custkey", F.concat(F.lit("tennis_atp_"), F.get(F.lit(keys), (k % 8).cast("int"))).alias("key"),
        F.when(k % 3 == 0, "").when(k % 3 == 1, F.concat(F.lit("ATP "), F.get(F.lit(titles), (k % 8).cast("int")))).otherwise("WTA Grand Slam Cup").alias("title"),
    )
    name, series, surface, best_of = S.tournament_facts("key", "title")
    return t.select("c_custkey", name.alias("name"), series.alias("series"), surface.alias("surface"), best_of.alias("best_of"))


@query("p02_p17_predicates", f"""WITH {C0}, x AS (SELECT *, CASE contest_id % 5 WHEN 0 THEN '6-4 RET' WHEN 1 THEN NULL WHEN 2 THEN 'Walkover' ELSE '6-4 6-3' END AS score, CASE WHEN contest_id % 3 = 0 THEN NULL ELSE status END AS st, CASE WHEN contest_id % 4 = 0 THEN odd1 END AS first_price FROM c0)
SELECT contest_id, NOT coalesce(regexp_matches(score, 'W/O|RET|DEF|w/o|ret|def|Walkover'), false) AS completed, coalesce(st, '') = '' AS stateless, coalesce(first_price, odd2) AS price FROM x WHERE (p1 = 7 OR p2 = 7 OR p1 % 3 = 0) AND contains(lower(tournament), 'i') AND series IN ('Grand Slam', 'ATP250', 'ATP500') AND date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31'""")
def p02_p17_predicates(spark, sf_dir):
    k = F.col("contest_id")
    x = contests(spark, sf_dir).withColumns(
        {"score": F.when(k % 5 == 0, "6-4 RET").when(k % 5 == 1, F.lit(None)).when(k % 5 == 2, "Walkover").otherwise("6-4 6-3"), "st": F.when(k % 3 != 0, F.col("status")), "first_price": F.when(k % 4 == 0, F.col("odd1"))}
    )
    x = sources.searched(x, "tournament", "I").where(F.col("series").isin("Grand Slam", "ATP250", "ATP500") & F.col("date").between("1996-01-01", "1999-12-31"))
    x = x.where((F.col("p1") == 7) | (F.col("p2") == 7) | (F.col("p1") % 3 == 0))
    return x.select("contest_id", sources.completed("score").alias("completed"), S.same_or_empty("st", "").alias("stateless"), F.coalesce("first_price", "odd2").alias("price"))


# Joins.
@query("j01_j08_lookups", f"""WITH {C0}, s AS (SELECT s_suppkey, s_nationkey FROM supplier), a AS (SELECT c0.contest_id, c0.p1, n1.s_nationkey AS nation_1, n2.s_nationkey AS nation_2, l.l_suppkey AS extra FROM c0 LEFT JOIN s n1 ON n1.s_suppkey = p1 LEFT JOIN s n2 ON n2.s_suppkey = p2
  LEFT JOIN lineitem l ON l.l_orderkey = c0.contest_id AND l.l_suppkey = c0.p1)
SELECT contest_id, nation_1, nation_2, r_name AS region, count(extra) AS fanned FROM a LEFT JOIN nation ON n_nationkey = nation_1 LEFT JOIN region ON r_regionkey = n_regionkey GROUP BY 1, 2, 3, 4""")
def j01_j08_lookups(spark, sf_dir):
    """Equi-joins: both sides by one dimension, a chain of two more, and one that fans out on duplicate keys."""
    c, s = contests(spark, sf_dir), table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    out = joins.both_sides(c, s, "s_suppkey", {"s_nationkey": "nation"})
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    out = out.join(n.select(F.col("n_nationkey").alias("nation_1"), "n_regionkey"), "nation_1", "left").join(r.select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("region")), "n_regionkey", "left")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("contest_id"), F.col("l_suppkey").alias("p1"), F.lit(1).alias("extra"))
    return out.join(lines, ["contest_id", "p1"], "left").groupBy("contest_id", "nation_1", "nation_2", "region").agg(F.count("extra").alias("fanned"))


@query("j10_scored_names", """WITH known AS (SELECT n_nationkey AS known_seq, CASE WHEN n_nationkey % 7 = 0 THEN '' ELSE 'Fam' END || chr(CAST(97 + n_nationkey % 20 AS INTEGER)) || CASE WHEN n_nationkey % 7 = 0 THEN '' ELSE 'ou' END || CASE WHEN n_nationkey % 3 = 0 THEN ' Deux' ELSE '' END || ' ' || chr(CAST(65 + n_nationkey % 4 AS INTEGER)) || '.' AS known_name FROM nation),
names AS (SELECT DISTINCT chr(CAST(65 + c_custkey % 4 AS INTEGER)) || 'nn ' || CASE c_custkey % 6 WHEN 0 THEN 'Fam' || chr(CAST(97 + c_custkey % 25 AS INTEGER)) || 'ou' WHEN 1 THEN 'Fam' || chr(CAST(97 + c_custkey % 25 AS INTEGER)) || 'oux' WHEN 2 THEN 'Fam' || chr(CAST(97 + c_custkey % 25 AS INTEGER)) || 'ou Deux' WHEN 3 THEN 'Deux'
  WHEN 4 THEN chr(CAST(97 + c_custkey % 25 AS INTEGER)) || 'o' ELSE chr(CAST(97 + c_custkey % 25 AS INTEGER)) END AS name FROM customer),
p AS (SELECT name, known_name, known_seq, string_split(lower(name), ' ') AS t, string_split(regexp_replace(lower(known_name), '[^a-z ]', '', 'g'), ' ') AS u FROM names, known),
s AS (SELECT name, known_name, known_seq, CASE WHEN t[-1] = u[1] THEN 3.0 WHEN contains(u[1], t[-1]) OR contains(t[-1], u[1]) THEN 2.0 WHEN array_to_string(t[2:], ' ') = array_to_string(u[:-2], ' ') THEN 3.0 WHEN contains(array_to_string(u[:-2], ' '), t[-1]) THEN 1.5 END + CASE WHEN t[1][1] = u[-1][1] THEN 1.0 ELSE 0.0 END AS score FROM p)
SELECT name, arg_min(known_name, (-score, known_seq)) AS known_name, CAST(max(score) AS DOUBLE) AS score FROM s WHERE score >= 2 GROUP BY 1""")
def j10_scored_names(spark, sf_dir):
    k, s = F.col("n_nationkey"), lambda c, n, base: F.char(base + F.col(c) % n)
    long = lambda part: F.when(k % 7 == 0, "").otherwise(part)
    last = F.concat(long("Fam"), s("n_nationkey", 20, 97), long("ou"), F.when(k % 3 == 0, " Deux").otherwise(""))
    known = table(spark, sf_dir, "nation").select(k.alias("known_seq"), F.concat(last, F.lit(" "), s("n_nationkey", 4, 65), F.lit(".")).alias("known_name"))
    c, fam = F.col("c_custkey"), F.concat(F.lit("Fam"), s("c_custkey", 25, 97), F.lit("ou"))
    letter, kind = s("c_custkey", 25, 97), c % 6
    own = F.when(kind == 0, fam).when(kind == 1, F.concat(fam, F.lit("x"))).when(kind == 2, F.concat(fam, F.lit(" Deux"))).when(kind == 3, "Deux").when(kind == 4, F.concat(letter, F.lit("o"))).otherwise(letter)
    names = table(spark, sf_dir, "customer").select(F.concat(s("c_custkey", 4, 65), F.lit("nn "), own).alias("name"))
    return joins.score_names(names, known)


@query("j12_fallbacks", """WITH d AS (SELECT s_suppkey, s_name, s_acctbal FROM supplier) SELECT c_custkey, round(coalesce(a.s_acctbal, b.s_acctbal, -1.0), 4) AS value, CASE WHEN a.s_acctbal IS NULL AND b.s_acctbal IS NULL THEN 1 ELSE 0 END AS is_new
FROM customer LEFT JOIN d a ON a.s_suppkey = c_custkey * 3 AND a.s_suppkey % 2 = 0 LEFT JOIN d b ON b.s_name = replace(c_name, 'Customer', 'Supplier')""")
def j12_fallbacks(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", F.col("s_acctbal").alias("value"))
    c = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") * 3).alias("id"), F.replace("c_name", F.lit("Customer"), F.lit("Supplier")).alias("name"))
    out = joins.first_available(c, [(s.where("s_suppkey % 2 = 0"), "id", "s_suppkey"), (s, "name", "s_name")], "value", -1.0)
    return out.select("c_custkey", F.round("value", 4).alias("value"), "is_new")


@query("j14_j15_spans", f"""WITH {C0}, g AS (SELECT tournament, date, CASE WHEN date - lag(date) OVER (PARTITION BY tournament ORDER BY date) > 3 THEN 1 ELSE 0 END AS n FROM c0), e AS (SELECT *, 1 + sum(n) OVER (PARTITION BY tournament ORDER BY date RANGE UNBOUNDED PRECEDING) AS edition FROM g),
sp AS (SELECT tournament, min(date) AS s, max(date) AS e FROM e GROUP BY tournament, edition), f AS (SELECT tournament, date, contest_id, CASE WHEN win1 = 1 THEN p1 ELSE p2 END AS winner FROM c0 WHERE round = 'The Final'),
alone AS (SELECT sp.* FROM sp WHERE NOT EXISTS (SELECT 1 FROM sp o WHERE o.tournament = sp.tournament AND o.s <> sp.s AND year(o.s) = year(sp.s) AND abs(sp.s - o.s) < 12 AND o.e > o.s))
SELECT sp.tournament, CAST(sp.s AS VARCHAR) AS start, CAST(sp.e AS VARCHAR) AS "end", arg_min(winner, (f.date, f.contest_id)) AS winner, max(CASE WHEN alone.s IS NULL THEN 0 ELSE 1 END) AS alone FROM sp LEFT JOIN f ON f.tournament = sp.tournament AND f.date BETWEEN sp.s AND sp.e LEFT JOIN alone ON alone.tournament = sp.tournament AND alone.s = sp.s GROUP BY 1, 2, 3""")
def j14_j15_spans(spark, sf_dir):
    """Winners of the finals within each edition, and whether another longer edition of the year is near; editions without a final have none."""
    c = contests(spark, sf_dir)
    cal = written(ledger.calendar(c, "tournament", "1998-06-01", 3).select("tournament", "start", "end"), "calendar")
    finals = c.where("round = 'The Final'").withColumn("winner", F.when(F.col("win1") == 1, F.col("p1")).otherwise(F.col("p2")))
    hit = joins.in_range(cal, finals, "tournament", "start", "end", "date", F.struct("date", "contest_id", "winner"))
    longer = cal.where(F.col("end") > F.col("start"))
    alone = joins.without_neighbours(cal, longer, "tournament", "start", 12, same_day=False).select("tournament", "start", F.lit(1).alias("alone"))
    out = hit.join(alone, ["tournament", "start"], "left").select("tournament", "start", "end", F.col("hit.winner").alias("winner"), F.coalesce("alone", F.lit(0)).alias("alone"))
    return dated(out, "start", "end")


@query("l10_projected", f"""WITH {C0}, m AS (SELECT tournament, max(date) AS d FROM c0 GROUP BY 1), p AS (SELECT tournament, CAST(d + INTERVAL 12 MONTH AS DATE) AS start FROM m) SELECT tournament, CAST(start AS VARCHAR) AS start, 'projected' AS state FROM p""")
def l10_projected(spark, sf_dir):
    """Last days of each tournament moved a year on; none is near another of its year."""
    c = contests(spark, sf_dir).groupBy("tournament").agg(F.max("date").alias("date"))
    cal = ledger.calendar(c, "tournament", "2002-01-01")
    return dated(ledger.projected(cal, "tournament").select("tournament", "start", "state"), "start")


# Aggregates.
@query("a10_a13_described", f"""WITH {BETS}, x AS (SELECT 'odds' AS "column", odds AS x FROM bets UNION ALL SELECT 'edge', edge FROM bets UNION ALL SELECT 'profit', profit FROM bets) SELECT "column", count(*) AS n, round(avg(x), 6) + 0.0 AS mean, round(stddev_samp(x), 6) AS sd, round(min(x), 6) AS least, round(quantile_cont(x, 0.25), 6) AS q1, round(quantile_cont(x, 0.5), 6) AS median, round(quantile_cont(x, 0.75), 6) AS q3, round(max(x), 6) AS largest FROM x GROUP BY 1""")
def a10_a13_described(spark, sf_dir):
    out = A.described(bets(spark, sf_dir), ["odds", "edge", "profit"])
    return out.select("column", "n", rounded("mean", 6).alias("mean"), *(F.round(c, 6).alias(c) for c in ("sd", "least", "q1", "median", "q3", "largest")))


@query("a13_edge_bins", f"WITH {BETS}, e AS (SELECT min(edge) AS lo, max(edge) AS hi FROM bets) SELECT CAST(greatest(0, least(7, ceil((edge - lo) / (hi - lo) * 8) - 1)) AS INTEGER) AS bin, count(*) AS n, round(avg(won), 6) AS rate, round(avg(edge), 6) + 0.0 AS mean FROM bets, e GROUP BY 1")
def a13_edge_bins(spark, sf_dir):
    return A.edge_bins(bets(spark, sf_dir), "edge", "won").select("bin", "n", F.round("rate", 6).alias("rate"), rounded("mean", 6).alias("mean"))


@query("a04_a06_periods", f"""WITH {BETS}, p AS (SELECT CAST(date_trunc('month', date) AS DATE) AS period, count(*) AS n, CAST(sum(won) AS BIGINT) AS wins, round(sum(profit), 4) AS profit FROM bets GROUP BY 1),
y AS (SELECT count(*) AS years, CAST(sum(CAST(p > 0 AS INTEGER)) AS BIGINT) AS good FROM (SELECT year(date), sum(profit) AS p FROM bets GROUP BY 1)) SELECT CAST(period AS VARCHAR) AS period, n, wins, profit, round(profit / n, 6) AS mean_profit, round(sum(profit) OVER (ORDER BY period), 4) AS cum_profit, years, good FROM p, y""")
def a04_a06_periods(spark, sf_dir):
    b = bets(spark, sf_dir)
    years = A.profitable_periods(b, "year").select(F.col("periods").alias("years"), F.col("profitable").alias("good"))
    out = A.cumulated(A.by_period(b, "month")).crossJoin(F.broadcast(years))
    return dated(out.select("period", "n", "wins", "profit", "mean_profit", "cum_profit", "years", "good"), "period")


@query("a17_last_values", "SELECT user_id, arg_max(value, (ts, event_id)) FILTER (value > 50) AS value, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY 1")
def a17_last_values(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("value", F.when(F.col("value") > 50, F.col("value")))
    return A.last_values(e, "user_id", ["ts", "event_id"], ["value", "event_type"])


@query("a20_pairs", f"WITH {C0}, x AS (SELECT contest_id, count(*) AS n, sum(won) AS w FROM app WHERE NOT (contest_id % 6 = 0 AND side = 2) GROUP BY 1) SELECT contest_id, CASE WHEN win1 = 1 THEN p1 ELSE p2 END AS winner FROM x JOIN c0 USING (contest_id) WHERE n = 2 AND w = 1")
def a20_pairs(spark, sf_dir):
    from tallyline.operators import backtest

    app = appearances(contests(spark, sf_dir)).where("NOT (contest_id % 6 = 0 AND side = 2)")
    return backtest.pairs_of(app).select("contest_id", F.when(F.col("win1") == 1, F.col("p1")).otherwise(F.col("p2")).alias("winner"))


@query("a24_a27_extremes", f"""WITH {BETS}, s AS (SELECT surface, {MEASURES} FROM bets GROUP BY 1) SELECT (SELECT arg_max(surface, roi) FROM s) AS best, (SELECT arg_min(surface, roi) FROM s) AS worst, (SELECT round(median(odds), 6) FROM bets) AS median_odds""")
def a24_a27_extremes(spark, sf_dir):
    b = bets(spark, sf_dir)
    ends = b.groupBy("surface").agg(*A.measures()).agg(F.max_by("surface", "roi").alias("best"), F.min_by("surface", "roi").alias("worst"))
    middle = A.percentiles(b.withColumn("all", F.lit(0)), ["all"], "odds", {"m": 0.5}).select(F.round("m", 6).alias("median_odds"))
    return ends.crossJoin(F.broadcast(middle))


@query("b14_b27_robustness", f"""WITH {BETS}, k AS (SELECT b.*, c0.tournament, c0.round FROM bets b JOIN c0 USING (contest_id) WHERE b.odds < 3 AND b.edge > 0)
SELECT 'tournament' AS segment, tournament AS value, {MEASURES} FROM k GROUP BY 2 UNION ALL SELECT 'round', round, {MEASURES} FROM k GROUP BY 2 UNION ALL SELECT 'year', CAST(year(date) AS VARCHAR), {MEASURES} FROM k GROUP BY 2""")
def b14_b27_robustness(spark, sf_dir):
    b = bets(spark, sf_dir).join(contests(spark, sf_dir).select("contest_id", "tournament", "round"), "contest_id")
    return A.segments(b.where("odds < 3 AND edge > 0").withColumn("year", F.year("date").cast("string")), ["tournament", "round", "year"])


@query("p19_all_reasons", f"""WITH {PRICED} SELECT contest_id, concat_ws(', ', CASE WHEN p1_prob - 1 / odd1 < 0.0351 THEN 'edge' END, CASE WHEN p1_prob * odd1 - 1 <= 0 THEN 'value' END, CASE WHEN p1_prob * odd1 - 1 > 0.5001 THEN 'too good' END, CASE WHEN odd1 < 1.45 OR odd1 > 4.05 THEN 'odds' END) AS reasons FROM priced""")
def p19_all_reasons(spark, sf_dir):
    rule = {"min_edge": 0.0351, "max_ev": 0.5001, "min_odds": 1.45, "max_odds": 4.05}
    return priced(spark, sf_dir).select("contest_id", decision.all_reasons("p1_prob", "odd1", rule).alias("reasons"))


@query("w14_fatigue", f"WITH {C0} SELECT a.contest_id, a.side, CAST(count(b.contest_id) AS INTEGER) AS fatigue_14_all FROM app a LEFT JOIN app b ON b.player = a.player AND b.date >= a.date - 14 AND (b.date, b.contest_id, b.side) < (a.date, a.contest_id, a.side) GROUP BY 1, 2")
def w14_fatigue(spark, sf_dir):
    return asof.unbounded_fatigue(appearances(contests(spark, sf_dir))).select("contest_id", "side", "fatigue_14_all")


@query("f36_flipped", f"WITH {PRICED} SELECT contest_id, round(abs(odd1 - odd2), 6) AS gap, round(odd1 + odd2, 6) AS both_, odd1 = odd2 OR (odd1 - odd2 > 0) = (odd1 - odd2 > 0) AS kept FROM priced")
def f36_flipped(spark, sf_dir):
    """Half of the rows seen from the other side: what doesn't depend on the side must stay as it was."""
    c = priced(spark, sf_dir).select("contest_id", "odd1", "odd2", (F.col("odd1") - F.col("odd2")).alias("odd_diff"), F.col("win1").alias("label"))
    out = features.flipped(c, "contest_id", ["odd_diff"], [("odd1", "odd2")], "label")
    same = F.round(F.col("odd1") - F.col("odd2") - F.col("odd_diff"), 9) == 0
    return out.select("contest_id", F.round(F.abs("odd_diff"), 6).alias("gap"), F.round(F.col("odd1") + F.col("odd2"), 6).alias("both_"), same.alias("kept"))


# Ledger.
@query("a28_a31_open", f"WITH {LEDGER} SELECT event_id, count(*) FILTER (status = 'open') AS n_open, count(*) FILTER (status = 'resolved') AS n_resolved, coalesce(round(sum(stake) FILTER (status = 'open'), 4), 0) AS staked, coalesce(round(sum((odds - 1) * stake) FILTER (status = 'open'), 4), 0) AS to_win FROM lbets GROUP BY 1")
def a28_a31_open(spark, sf_dir):
    b = ledger_bets(spark, sf_dir)
    out = A.event_counts(b).join(A.open_totals(b, ["event_id"]).drop("n_open"), "event_id", "left")
    return out.select("event_id", "n_open", "n_resolved", F.coalesce(F.round("staked", 4), F.lit(0.0)).alias("staked"), F.coalesce(F.round("to_win", 4), F.lit(0.0)).alias("to_win"))


@query("l04_applied", f"""WITH {LEDGER}, res AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'a' WHEN 1 THEN 'b' WHEN 2 THEN 'void' END AS w FROM (SELECT DISTINCT event_id FROM lbets) WHERE event_id % 5 > 0),
s AS (SELECT b.user_id, round(b.stake) AS stake, b.odds, b.pick, b.status, CASE WHEN result = 'win' THEN round(b.stake) * (b.odds - 1) WHEN result = 'loss' THEN -round(b.stake) WHEN result = 'void' THEN 0.0 END AS profit, res.event_id AS hit, w FROM lbets b LEFT JOIN res ON res.event_id = b.event_id), n AS (SELECT user_id, CASE WHEN hit IS NULL THEN status WHEN w IS NULL THEN 'open' ELSE 'resolved' END AS status, stake,
  CASE WHEN hit IS NULL THEN profit WHEN w IS NULL THEN NULL WHEN w = 'void' THEN 0.0 WHEN w = pick THEN stake * (odds - 1) ELSE -stake END AS profit FROM s)
SELECT c_custkey AS user_id, c_acctbal AS initial, round(c_acctbal + coalesce(m, 0), 2) AS bankroll FROM customer LEFT JOIN (SELECT user_id, sum(CASE WHEN status = 'resolved' THEN coalesce(profit, 0) ELSE -stake END) AS m FROM n GROUP BY 1) ON user_id = c_custkey""")
def l04_applied(spark, sf_dir):
    """Results that settle, void and open events again, and the bankrolls after them; stakes are whole, so that cents add up exactly."""
    b = ledger_bets(spark, sf_dir).withColumn("stake", F.round("stake"))
    b = b.withColumn("profit", F.when(F.col("result").isNotNull(), S.settled_profit("stake", "odds", "result")))
    e = F.col("event_id") % 4
    res = b.select("event_id").distinct().where("event_id % 5 > 0").withColumn("winner_side", F.when(e == 0, "a").when(e == 1, "b").when(e == 2, "void"))
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_acctbal").alias("initial"))
    return ledger.applied(b, res, users)[1]


@query("l02_l05_events", """WITH ev AS (SELECT p_partkey AS event_id, p_type AS title, CASE WHEN p_partkey % 3 > 0 THEN p_size END AS odds_a, CASE WHEN p_partkey % 4 = 0 THEN 'completed' ELSE 'upcoming' END AS status FROM part WHERE p_partkey % 2 = 0),
w AS (SELECT p_partkey AS event_id, p_type AS title, p_size + 100 AS odds_a FROM part WHERE p_partkey % 5 < 3), j AS (SELECT coalesce(ev.event_id, w.event_id) AS event_id, coalesce(ev.odds_a, w.odds_a) AS odds_a, ev.status FROM ev FULL JOIN w ON ev.event_id = w.event_id AND ev.title = w.title)
SELECT event_id, CASE WHEN status = 'upcoming' AND event_id % 7 = 0 AND event_id % 14 <> 0 THEN 1 WHEN coalesce(status, '') = 'upcoming' AND event_id % 7 = 0 THEN 1 ELSE odds_a END AS odds_a, status FROM j WHERE event_id NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 40 AND l_partkey % 4 = 1)""")
def l02_l05_events(spark, sf_dir):
    """Events got or created with gaps filled, upcoming ones changed, and those without bets that may be deleted."""
    p = table(spark, sf_dir, "part")
    events = p.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("event_id"), F.col("p_type").alias("title"), F.when(F.col("p_partkey") % 3 > 0, F.col("p_size")).alias("odds_a"), F.when(F.col("p_partkey") % 4 == 0, "completed").otherwise("upcoming").alias("status"))
    wanted = p.where("p_partkey % 5 < 3").select(F.col("p_partkey").alias("event_id"), F.col("p_type").alias("title"), (F.col("p_size") + 100).alias("odds_a"))
    both = ledger.get_or_create(events, wanted, ["event_id", "title"], ["odds_a"])
    changes = both.where("event_id % 7 = 0").select("event_id", F.lit(1).alias("odds_a"))
    now = ledger.updated(both, changes, "event_id", F.coalesce(F.col("status") == "upcoming", F.lit(False)))
    bets_ = table(spark, sf_dir, "lineitem").where("l_quantity > 40 AND l_partkey % 4 = 1").select(F.col("l_partkey").alias("event_id"))
    return ledger.deletable(now, bets_).select("event_id", "odds_a", "status")


@query("l06_csv_ledger", f"""WITH {LEDGER}, fresh AS (SELECT c_custkey AS user_id, 100.0::DOUBLE + c_custkey AS stake FROM customer), done AS (SELECT bet_id, CASE bet_id % 3 WHEN 0 THEN 'win' WHEN 1 THEN 'loss' ELSE 'void' END AS r FROM lbets WHERE status = 'open' AND bet_id % 4 = 0),
c AS (SELECT b.user_id, CASE WHEN r IS NULL THEN b.status ELSE 'resolved' END AS status, CASE WHEN r IS NULL THEN b.profit WHEN r = 'win' THEN stake * (odds - 1) WHEN r = 'loss' THEN -stake ELSE 0 END AS profit FROM lbets b LEFT JOIN done USING (bet_id) UNION ALL SELECT user_id, 'open', NULL FROM fresh)
SELECT user_id, count(*) AS n, count(*) FILTER (status = 'open') AS n_open, round(coalesce(sum(profit), 0), 2) + 0.0 AS profit FROM c GROUP BY 1""")
def l06_csv_ledger(spark, sf_dir):
    """New bets numbered and added, some open ones closed, and what stays open, by user."""
    b = written(ledger_bets(spark, sf_dir), "bets")
    new = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), (100.0 + F.col("c_custkey")).alias("stake"), F.lit(2.0).alias("odds"))
    done = ledger.open_bets(b).where("bet_id % 4 = 0").select("bet_id", F.when(F.col("bet_id") % 3 == 0, "win").when(F.col("bet_id") % 3 == 1, "loss").otherwise("void").alias("result"))
    out = ledger.added(ledger.closed(b, done), new, ["user_id"])
    numbers = out.groupBy("bet_id").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    out = out.join(numbers, "bet_id", "left_anti")  # no number is given twice, or its bets would be missing here
    return out.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("status") == "open").cast("int")).alias("n_open"), rounded(F.coalesce(F.sum("profit"), F.lit(0.0)), 2).alias("profit"))


@query("l07_l09_journal", """WITH j AS (SELECT o_custkey AS user_id, o_orderdate AS moment, o_orderkey AS seq, CASE WHEN o_orderkey % 7 > 0 THEN o_totalprice END AS amount FROM orders WHERE o_orderkey % 2 = 0), l AS (SELECT user_id, arg_max(amount, (moment, seq)) FILTER (amount IS NOT NULL) AS bank, arg_min(amount, (moment, seq)) FILTER (amount IS NOT NULL) AS initial FROM j GROUP BY 1),
m AS (SELECT o_custkey AS user_id, o_orderdate AS moment, o_orderkey AS seq, CASE WHEN o_orderkey % 3 = 0 THEN -o_totalprice / 2 ELSE o_totalprice / 4 END AS change FROM orders WHERE o_orderkey % 2 = 1),
r AS (SELECT m.user_id, m.moment, m.seq, coalesce(bank, 0) + sum(change) OVER (PARTITION BY m.user_id ORDER BY m.moment, m.seq) AS amount FROM m LEFT JOIN l USING (user_id)), a AS (SELECT user_id, moment, seq, amount FROM j UNION ALL SELECT * FROM r WHERE amount >= 0)
SELECT user_id, round(arg_max(amount, (moment, seq)) FILTER (amount IS NOT NULL), 4) AS bankroll, count(*) AS n FROM a GROUP BY 1""")
def l07_l09_journal(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("moment"), F.col("o_orderkey").alias("seq"), "o_totalprice")
    rows = o.where("seq % 2 = 0").select("user_id", "moment", "seq", F.when(F.col("seq") % 7 > 0, F.col("o_totalprice")).alias("amount"), F.lit("set").alias("action"))
    moves = o.where("seq % 2 = 1").select("user_id", "moment", "seq", F.when(F.col("seq") % 3 == 0, -F.col("o_totalprice") / 2).otherwise(F.col("o_totalprice") / 4).alias("change"))
    out = written(ledger.journalled(rows, moves), "journal")
    return ledger.journal(out).select("user_id", F.round("bankroll", 4).alias("bankroll")).join(out.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")), "user_id")


@query("a03_a23_a32_bankrolls", """WITH j AS (SELECT o_custkey AS user_id, o_orderpriority AS source, o_orderdate AS moment, o_orderkey AS seq, o_totalprice AS amount, CASE WHEN o_orderkey % 5 = 0 THEN 'initial' ELSE 'bet' END AS action FROM orders),
e AS (SELECT user_id, source, coalesce(arg_min(amount, (moment, seq)) FILTER (action = 'initial'), arg_min(amount, (moment, seq))) AS a FROM j GROUP BY 1, 2) SELECT user_id, round(sum(a), 2) AS initial, (SELECT max(o_orderkey) + 1 FROM orders) AS next_id FROM e GROUP BY 1""")
def a03_a23_a32_bankrolls(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    rows = o.select(F.col("o_custkey").alias("user_id"), F.col("o_orderpriority").alias("source"), F.col("o_orderdate").alias("moment"), F.col("o_orderkey").alias("seq"), F.col("o_totalprice").alias("amount"), F.when(F.col("o_orderkey") % 5 == 0, "initial").otherwise("bet").alias("action"))
    return ledger.combined_initial(rows).select("user_id", F.round("initial", 2).alias("initial")).crossJoin(F.broadcast(ledger.next_id(o, "o_orderkey")))


@query("l08_imported", """SELECT o_orderkey % 100 AS grp, count(*) AS n, count(*) FILTER (o_orderkey % 3 < 2) AS resolved, round(sum(CASE o_orderkey % 3 WHEN 0 THEN round(o_totalprice, 2) * (CASE WHEN o_orderkey % 4 = 0 THEN 1.01::DOUBLE ELSE 2.5 END - 1) WHEN 1 THEN -round(o_totalprice, 2) ELSE 0 END), 4) + 0.0 AS profit, count(*) FILTER (o_orderkey % 2 = 0) AS side_a
FROM orders WHERE o_orderkey % 10 > 0 GROUP BY 1""")
def l08_imported(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col
    raw = table(spark, sf_dir, "orders").select(
        k.alias("row"), F.when(k % 2 == 0, "Anna Alpha").otherwise("Bert Beta").alias("pick"), F.lit("Anna Alpha").alias("player_1"), F.lit("Bert Beta").alias("player_2"), F.when(k % 4 == 0, "0.5").otherwise("2.5").alias("odds"),
        F.when(k % 10 == 0, "0").otherwise(F.format_string("%.2f", c("o_totalprice"))).alias("stake"), F.when(k % 3 < 2, "closed").otherwise("open").alias("status"), F.when(k % 3 == 0, "won").when(k % 3 == 1, "lost").otherwise("").alias("result"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"),
    )
    out = ledger.imported(raw, keep=["row"])
    return out.groupBy((c("row") % 100).alias("grp")).agg(F.count(F.lit(1)).alias("n"), F.sum((c("status") == "resolved").cast("int")).alias("resolved"), rounded(F.sum("profit"), 4).alias("profit"), F.sum((c("pick") == "a").cast("int")).alias("side_a"))


@query("p20_l01_violations", """SELECT p_partkey AS event_id, CASE WHEN p_size % 10 = 0 THEN 'participants' WHEN p_partkey % 6 = 0 THEN 'odds' WHEN p_partkey % 5 = 0 THEN 'probability' END AS problem FROM part WHERE p_size % 10 = 0 OR p_partkey % 6 = 0 OR p_partkey % 5 = 0""")
def p20_l01_violations(spark, sf_dir):
    k = F.col("p_partkey")
    events = table(spark, sf_dir, "part").select(
        k.alias("event_id"), F.lit("A").alias("participant_a"), F.when(F.col("p_size") % 10 == 0, "A").otherwise("B").alias("participant_b"),
        F.when(k % 6 == 0, 1.0).otherwise(1.5).alias("odds_a"), F.lit(2.5).alias("odds_b"), F.when(k % 5 == 0, 1.5).otherwise(0.5).alias("prob_a"),
    )
    return ledger.event_violations(events).select("event_id", "problem")


@query("s20_p15_listing", f"WITH {LEDGER} SELECT event_id, CAST(row_number() OVER (ORDER BY CASE WHEN st = 'upcoming' THEN 0 ELSE 1 END, moment, event_id DESC) AS INTEGER) AS place FROM (SELECT event_id, CASE WHEN bool_or(status = 'open') THEN 'upcoming' ELSE 'completed' END AS st, CAST(min(bet_id % 50) AS VARCHAR) AS moment FROM lbets WHERE event_id % 2 = 0 GROUP BY 1) WHERE event_id % 3 > 0")
def s20_p15_listing(spark, sf_dir):
    """Events of one kind, not yet known ones alone, in the order in which they are listed."""
    b = ledger_bets(spark, sf_dir)
    at = b.groupBy("event_id").agg(F.min(F.col("bet_id") % 50).cast("string").alias("event_datetime"))
    events = A.event_status(b).join(at, "event_id").withColumn("sport", F.when(F.col("event_id") % 2 == 0, "tennis").otherwise("mma"))
    known = events.where("event_id % 3 = 0").select("event_id")
    # Few rows: a number each for their place in the list.
    place = Window.orderBy(F.when(F.col("status") == "upcoming", 0).otherwise(1), "event_datetime", F.desc("event_id"))
    return ledger.listed(ledger.unknown(events, known, "event_id"), "tennis").select("event_id", F.row_number().over(place).alias("place"))


@query("s20_listing_stop", f"""WITH {C0}, m AS (SELECT *, CAST(datediff('month', date, (SELECT max(date) FROM c0)) AS INTEGER) AS page, date < DATE '2001-03-01' OR contest_id % 3 = 0 AS known FROM c0),
w AS (SELECT min(page) AS stop FROM (SELECT page, bool_and(known) AS whole FROM m GROUP BY 1) WHERE whole) SELECT contest_id, page FROM m, w WHERE NOT known AND page < stop""")
def s20_listing_stop(spark, sf_dir):
    """Contests listed by month, the newest first, that aren't among the known ones, up to the first month that is known whole."""
    from tallyline.session import scratch
    from tallyline.sources import listing

    folder = scratch(spark, "pages")
    c = contests(spark, sf_dir).select("contest_id", "date").withColumn("month", F.year("date") * 12 + F.month("date"))
    c.write.partitionBy("month").parquet(folder)  # once; the known ones, which every group of pages asks for, are read from it
    listed = spark.read.parquet(folder)
    oldest, last = listed.agg(F.min("month"), F.max("month")).first()
    read = lambda a, b: listed.where((F.col("month") <= last - a) & (F.col("month") > last - b)).withColumn("page", F.lit(last) - F.col("month"))
    known = listed.where("date < '2001-03-01' or contest_id % 3 = 0")
    out, _, _ = listing.new_entries(read, last - oldest + 1, known, "contest_id", first=2)
    return out.select("contest_id", "page")


@query("l13_bankroll_files", f"""WITH {LEDGER}, f AS (SELECT c_custkey AS user_id, CASE WHEN c_custkey % 5 > 0 THEN c_acctbal END AS initial, CASE WHEN c_custkey % 7 > 0 THEN c_acctbal * 2 END AS bankroll FROM customer WHERE c_custkey % 3 = 0),
i AS (SELECT c.c_custkey AS user_id, coalesce(f.initial, f.bankroll, 1000.0) AS initial FROM customer c LEFT JOIN f ON f.user_id = c.c_custkey),
m AS (SELECT user_id, sum(CASE WHEN status = 'resolved' THEN coalesce(profit, 0) ELSE -stake END) AS m FROM lbets GROUP BY 1)
SELECT i.user_id, i.initial, CASE WHEN m IS NOT NULL OR i.user_id % 3 = 0 THEN round(i.initial + coalesce(m, 0), 2) ELSE i.initial END AS bankroll FROM i LEFT JOIN m USING (user_id)""")
def l13_bankroll_files(spark, sf_dir):
    """Every user's bankroll, started where there is none and worked out anew from the bets, then saved."""
    c = F.col("c_custkey")
    customers = table(spark, sf_dir, "customer").select(c.alias("user_id"), F.when(c % 5 > 0, F.col("c_acctbal")).alias("initial"), F.when(c % 7 > 0, F.col("c_acctbal") * 2).alias("bankroll"))
    started = ledger.initialised(customers.where("user_id % 3 = 0"), customers.select("user_id"))
    return ledger.saved(started, A.bankrolls(started, ledger_bets(spark, sf_dir)))


@query("o01_o08_sorts", f"""WITH {BETS}, r AS (SELECT contest_id, row_number() OVER (ORDER BY date DESC, contest_id DESC) AS late, row_number() OVER (ORDER BY abs(edge) DESC, contest_id) AS far, row_number() OVER (PARTITION BY date_trunc('month', date) ORDER BY date, contest_id) AS in_month FROM bets)
SELECT contest_id, CAST(CASE WHEN late <= 10 THEN late END AS INTEGER) AS late, CAST(CASE WHEN far <= 10 THEN far END AS INTEGER) AS far, CAST(in_month AS INTEGER) AS in_month FROM r WHERE late <= 10 OR far <= 10 OR in_month <= 3""")
def o01_o08_sorts(spark, sf_dir):
    """The ten latest, the ten with the largest edge either way, and the first three of each month."""
    b = bets(spark, sf_dir)
    few = lambda order, n, name: b.orderBy(*order).limit(n).select("contest_id", *order_columns).withColumn(name, F.row_number().over(Window.orderBy(*order))).select("contest_id", name)
    order_columns = ["date", "edge"]
    late, far = few([F.desc("date"), F.desc("contest_id")], 10, "late"), few([F.desc(F.abs("edge")), F.asc("contest_id")], 10, "far")
    month = b.withColumn("in_month", F.row_number().over(Window.partitionBy(F.trunc("date", "month")).orderBy("date", "contest_id"))).select("contest_id", "in_month")
    picked = month.where("in_month <= 3").select("contest_id").union(late.select("contest_id")).union(far.select("contest_id")).distinct()
    return month.join(picked, "contest_id").join(late, "contest_id", "left").join(far, "contest_id", "left").select("contest_id", "late", "far", "in_month")


# Sources.
@query("s01_s08_files", f"WITH {C0} SELECT contest_id, CAST(date AS VARCHAR) AS date, 'P' || p1 AS player_1, surface, CASE WHEN rank_1 = -1 THEN NULL ELSE rank_1 END AS rank_1, CASE WHEN odd1 > 1.5 THEN odd1 END AS odd_1 FROM c0 WHERE contest_id % 11 > 0")
def s01_s08_files(spark, sf_dir):
    """Contests written as CSV, read with a declared schema, cleaned, written and read as Parquet."""
    c = contests(spark, sf_dir)
    raw = c.select(
        F.col("contest_id").cast("string").alias("Tournament"), F.when(F.col("contest_id") % 11 > 0, F.date_format("date", "yyyy-MM-dd")).alias("Date"), F.col("series").alias("Series"), F.lit(None).cast("string").alias("Court"), F.col("surface").alias("Surface"),
        F.col("round").alias("Round"), F.col("best_of").alias("Best of"), F.concat(F.lit("P"), F.col("p1").cast("string")).alias("Player_1"), F.concat(F.lit("P"), F.col("p2").cast("string")).alias("Player_2"), F.lit(None).cast("string").alias("Winner"),
        F.col("rank_1").alias("Rank_1"), F.col("rank_2").alias("Rank_2"), F.col("pts_1").alias("Pts_1"), F.col("pts_2").alias("Pts_2"), F.when(F.col("odd1") > 1.5, F.col("odd1")).otherwise(-1.0).alias("Odd_1"), F.col("odd2").alias("Odd_2"), F.lit("6-4").alias("Score"),
    )
    csv, parquet = scratch(spark, "csv"), scratch(spark, "parquet")
    sources.write_csv(raw, csv)
    sources.write_parquet(sources.matches(sources.read_csv(spark, csv)), parquet, "Surface")
    out = spark.read.parquet(parquet)
    return out.select(F.col("Tournament").cast("long").alias("contest_id"), F.col("Date").cast("string").alias("date"), F.col("Player_1").alias("player_1"), F.col("Surface").alias("surface"), F.col("Rank_1").alias("rank_1"), F.col("Odd_1").alias("odd_1"))


@query("s10_s14_feed", """WITH b AS (SELECT l_orderkey, l_linenumber AS n, ['pinnacle_x', 'betfair_ex_eu', 'Unibet', 'other', 'winamax_fr'][l_suppkey % 5 + 1] AS name, round(1.1::DOUBLE + l_quantity / 20.0::DOUBLE, 2) AS p1, CASE WHEN l_partkey % 4 > 0 THEN round(1.2::DOUBLE + l_partkey % 30 / 10.0::DOUBLE, 2) END AS p2, l_extendedprice AS e, l_partkey AS k, l_suppkey AS s FROM lineitem),
d AS (SELECT DISTINCT l_orderkey, n, name, p1, p2, e, k, s FROM b), v AS (SELECT *, CASE WHEN name LIKE 'pinnacle%' THEN 0 WHEN name LIKE 'betfair%' THEN 1 WHEN name = 'Unibet' THEN 2 WHEN name LIKE 'winamax%' THEN 3 ELSE 4 END AS r FROM d WHERE p2 IS NOT NULL)
SELECT o_orderkey AS event_id, arg_min(name, (r, n, k, s, e)) AS bookmaker, arg_min(p1, (r, n, k, s, e)) AS odds_home, arg_min(p2, (r, n, k, s, e)) AS odds_away, CAST(count(name) AS INTEGER) AS n_books FROM orders LEFT JOIN v ON l_orderkey = o_orderkey WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem) AND o_orderstatus = 'F' GROUP BY 1""")
def s10_s14_feed(spark, sf_dir):
    """A nested feed of the active sport from lines as books, read for one part of its cache, with the preferred book's prices."""
    c = F.col
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity").distinct()
    name = F.get(F.lit(["pinnacle_x", "betfair_ex_eu", "Unibet", "other", "winamax_fr"]), (c("l_suppkey") % 5).cast("int"))
    side = lambda n, p: F.when(p.isNotNull(), F.struct(F.lit(n).alias("name"), p.alias("price")))
    prices = F.filter(F.array(side("H", F.round(1.1 + c("l_quantity") / 20.0, 2)), side("A", F.when(c("l_partkey") % 4 > 0, F.round(1.2 + c("l_partkey") % 30 / 10.0, 2)))), lambda x: x.isNotNull())
    book = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", name.alias("title"), F.array(F.struct(F.lit("h2h").alias("key"), prices.alias("outcomes"))).alias("markets"))
    feed = line.groupBy(c("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(book)).alias("bookmakers"))
    feed = feed.withColumns({"home_team": F.lit("H"), "away_team": F.lit("A"), "commence_time": F.lit("2024-05-01T10:00:00Z")})
    sports = table(spark, sf_dir, "orders").select(c("o_orderkey").alias("id"), F.concat(F.lit("tennis_"), "o_orderstatus").alias("key"), F.lit(True).alias("active"), F.lit("2024-05-01").alias("date"))
    today = sources.cached_day(sources.active(sports, "tennis_F"), "2024-05-01").select("id")
    out = sources.preferred(sources.prices(feed.join(today, "id")), ["pinnacle", "betfair_ex_eu", "unibet", "winamax", "1xbet"])
    return out.select("event_id", "bookmaker", "odds_home", "odds_away", F.size("all_bookmakers").alias("n_books"))


@query("s16_s17_pages", """WITH p AS (SELECT page_id FROM pages) SELECT page_id, 'http://e/f' || page_id AS row_url, 'Red ' || page_id || ' / Blue ' || page_id AS names, page_id % 7 AS red_kd, page_id % 50 AS red_sig, page_id % 50 + 9 AS red_sig_att, (page_id % 5) * 60 + page_id % 60 AS red_ctrl, CASE WHEN page_id % 2 = 0 THEN 1 ELSE 0 END AS red_won FROM p""")
def s16_s17_pages(spark, sf_dir):
    """Rows and persons of event pages that are laid out from the pages' ids, as such sites write them."""
    i, s = F.col("page_id"), lambda x: x.cast("string")
    stat = lambda label, value: F.concat(F.lit(f'<p class="person-title"> {label} </p><p class="person-text"> '), value, F.lit(" </p>"))
    person = lambda who, green: F.concat(
        F.lit('<div class="details person"><i class="person-status'), F.when(green, F.lit("_green")).otherwise(F.lit("_gray")), F.lit(f'">W</i><h3 class="person-name"><a href="http://e/{who}">{who} '), s(i), F.lit("</a></h3>"),
        stat("KD", s(i % 7)), stat("Sig. str.", F.concat(s(i % 50), F.lit(" of "), s(i % 50 + 9))), stat("Ctrl", F.format_string("%d:%02d", i % 5, i % 60)), F.lit("</div>"),
    )
    row = F.concat(F.lit('<table><tr class="r" data-link="http://e/f'), s(i), F.lit('"><td>x</td><td><a class="l" href="/a">Red '), s(i), F.lit('</a><a class="l" href="/b">Blue '), s(i), F.lit("</a></td></tr></table>"))
    pages = table(spark, sf_dir, "pages").select("page_id", F.concat(row, person("Red", i % 2 == 0), person("Blue", i % 2 == 1)).alias("html"))
    rows = sources.rows_of_page(pages).select("page_id", "row_url", F.array_join("names", " / ").alias("names"))
    red = sources.person_facts(pages).where("side = 0").select("page_id", F.col("kd").cast("long").alias("red_kd"), F.col("sig_lnd").cast("long").alias("red_sig"), F.col("sig_att").cast("long").alias("red_sig_att"), F.col("ctrl_secs").cast("long").alias("red_ctrl"), F.col("result_win").alias("red_won"))
    return rows.join(red, "page_id")


@query("s22_s25_results", f"""WITH {C0} SELECT CAST(date AS VARCHAR) AS date, count(*) AS n, round(sum(odd1 + odd2), 4) AS odds FROM c0 WHERE contest_id % 4 > 0 AND date >= (SELECT max(date) - INTERVAL 12 MONTH FROM c0 WHERE contest_id % 4 > 0) GROUP BY 1""")
def s22_s25_results(spark, sf_dir):
    """Winner and loser rows as two-sided matches with swapped sides, and the last twelve months of them."""
    c = contests(spark, sf_dir)
    raw = c.select("contest_id", "date", F.lit("w").alias("Winner"), F.lit("l").alias("Loser"), F.when(F.col("contest_id") % 4 > 0, "Completed").otherwise("Retired").alias("Comment"), F.col("odd1").alias("PSW"), F.col("odd2").alias("PSL"), F.lit(6).alias("W1"), F.lit(4).alias("L1"))
    out = sources.recent(sources.results(raw, ["contest_id", "date"]), "date", 12, ["date", "Odd_1", "Odd_2"])
    return dated(out.groupBy("date").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("Odd_1") + F.col("Odd_2")), 4).alias("odds")), "date")


@query("s29_s30_snapshots", f"""WITH {C0}, l AS (SELECT player, arg_max(odds, (date, contest_id, side)) AS odds, arg_max(won, (date, contest_id, side)) AS won FROM app GROUP BY 1) SELECT player, odds, won, round((DATE '2002-01-01' - (DATE '1970-01-01' + CAST(player AS INTEGER))) / 365.25, 6) AS age, CASE WHEN player % 3 = 0 THEN 1500.0::DOUBLE + player ELSE 1500.0::DOUBLE END AS elo, 'ratings_v2' AS version FROM l""")
def s29_s30_snapshots(spark, sf_dir):
    """A rating snapshot with an older version where the newer isn't there, joined to last values and biographies."""
    folder = scratch(spark, "snapshots")
    players = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("player"))
    sources.write_parquet(players.where("player % 3 = 0").withColumn("elo", 1500.0 + F.col("player")), f"{folder}/ratings_v2.parquet")
    snap = sources.snapshot(spark, folder, ["ratings_v3", "ratings_v2"])
    bio = players.withColumn("born", F.date_add(F.lit("1970-01-01").cast("date"), F.col("player").cast("int")))
    app = appearances(contests(spark, sf_dir)).select("player", "date", "contest_id", "side", "odds", "won")
    version = snap.agg(F.first("version").alias("version"))
    out = sources.fighters(app, bio, snap, "2002-01-01").crossJoin(F.broadcast(version))
    return out.select("player", "odds", "won", F.round("age", 6).alias("age"), "elo", "version")


@query("e14_live_row", f"""WITH {C0}, t AS (SELECT player, contest_id, side, date, avg(odds) OVER w AS o5, avg(won) OVER w AS w5, row_number() OVER (PARTITION BY player ORDER BY date, contest_id, side) AS fights, row_number() OVER (PARTITION BY player ORDER BY date DESC, contest_id DESC, side DESC) AS r FROM app WINDOW w AS (PARTITION BY player ORDER BY date, contest_id, side ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)),
l AS (SELECT * FROM t WHERE r = 1), q AS (SELECT n_nationkey AS p1, n_nationkey * 3 + 1 AS p2 FROM nation) SELECT p1, p2, round(a.o5 - b.o5, 6) + 0.0 AS diff_odds_l5, round(a.w5 - b.w5, 6) + 0.0 AS diff_won_l5, CAST(a.fights - b.fights AS INTEGER) AS diff_fights FROM q LEFT JOIN l a ON a.player = p1 LEFT JOIN l b ON b.player = p2""")
def e14_live_row(spark, sf_dir):
    """Each player's latest trailing values, the last contest among them, and the differences of pairs that are yet to meet."""
    app = appearances(contests(spark, sf_dir))
    live = asof.trailing(app, ["odds", "won"], current=True).withColumn("fights", F.row_number().over(asof.by("player")))
    last = asof.latest(live, 1).select("player", "odds_l5", "won_l5", "fights")
    pairs = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("p1"), (F.col("n_nationkey") * 3 + 1).cast("long").alias("p2"))
    out = features.live_differences(pairs, last, ["odds_l5", "won_l5", "fights"])
    return out.select("p1", "p2", rounded("diff_odds_l5", 6).alias("diff_odds_l5"), rounded("diff_won_l5", 6).alias("diff_won_l5"), F.col("diff_fights").cast("int").alias("diff_fights"))


@query("e15_medians", f"WITH {C0}, m AS (SELECT median(odd1) AS m1, median(pts_1) AS m2 FROM c0 WHERE date < DATE '2000-01-01') SELECT contest_id, coalesce(CASE WHEN contest_id % 4 > 0 THEN odd1 END, m1) AS odd1, coalesce(CASE WHEN contest_id % 5 > 0 THEN pts_1::DOUBLE END, m2) AS pts_1 FROM c0, m WHERE date >= DATE '2000-01-01'")
def e15_medians(spark, sf_dir):
    c = contests(spark, sf_dir).select("contest_id", "date", "odd1", F.col("pts_1").cast("double").alias("pts_1"))
    live = c.where("date >= '2000-01-01'").withColumns({"odd1": F.when(F.col("contest_id") % 4 > 0, F.col("odd1")), "pts_1": F.when(F.col("contest_id") % 5 > 0, F.col("pts_1"))})
    return features.with_medians(live, c.where("date < '2000-01-01'"), ["odd1", "pts_1"]).select("contest_id", "odd1", "pts_1")


@query("st2_st3_windows", "SELECT CAST(date_trunc('day', ts) AS VARCHAR) AS start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1, 2")
def st2_st3_windows(spark, sf_dir):
    """Daily volumes of the events as a stream, drained in append mode behind a last row that closes all windows, which is then left out."""
    from tallyline.streaming import ingest

    e = table(spark, sf_dir, "events")
    folder = scratch(spark, "stream-in")
    last = e.orderBy(F.desc("ts")).limit(1).withColumn("ts", F.col("ts") + F.expr("INTERVAL 3660 DAYS")).withColumn("event_type", F.lit("end"))
    e.write.parquet(f"{folder}/a-events.parquet")
    last.write.parquet(f"{folder}/b-end.parquet")
    stream = ingest.events(spark, f"{folder}/*", e.schema, files_per_trigger=1000)
    out = ingest.drained(ingest.volumes(stream, late="3650 days"), scratch(spark, "stream"), scratch(spark, "stream-state"))
    rows = out.where("event_type <> 'end'")
    return rows.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", F.round("value", 4).alias("value"))
