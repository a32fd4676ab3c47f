"""From probabilities and prices to bets: eligibility with reasons, stakes, one bet a tournament."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.functions import scalars as S


@dataclass(frozen=True)
class Strategy:
    """A rule of betting; empty lists allow all."""

    name: str
    threshold: float = 0.6
    min_edge: float = 0.03
    min_ev: float = 0.02
    min_odds: float = 1.3
    max_odds: float = 5.0
    series: list[str] = field(default_factory=list)
    surfaces: list[str] = field(default_factory=list)
    stake: str = "kelly"
    flat_pct: float = 0.02
    fraction: float = 4.0
    low: float = 0.01
    high: float = 0.05


STRATEGIES = [
    Strategy("confident", 0.72, 0.05, 0.03, 1.2, 6.2),
    Strategy("standard", 0.62, 0.03, 0.02, 1.2, 6.2, series=["Grand Slam", "Masters 1000", "ATP500"], fraction=6.0, high=0.04),
    Strategy("volume", 0.57, 0.02, 0.01, 1.2, 6.2, stake="flat", flat_pct=0.015),
    Strategy("specialist", 0.60, 0.03, 0.02, 1.2, 6.2, surfaces=["Clay"], fraction=4.0),
]


def strategies(configs: list[dict]) -> list[Strategy]:
    """Strategies from configuration entries; an entry without a threshold is none."""
    return [Strategy(**c) for c in configs if "threshold" in c]


#: Names of a strategy's settings in a configuration file.
SETTINGS = {
    "model_threshold": "threshold", "min_edge": "min_edge", "min_ev": "min_ev", "min_odds": "min_odds", "max_odds": "max_odds", "series_filter": "series", "surface_filter": "surfaces",
    "stake_type": "stake", "flat_pct": "flat_pct", "kelly_fraction": "fraction", "min_stake_pct": "low", "max_stake_pct": "high",
}


def configured(spark: SparkSession, path: str) -> list[Strategy]:
    """Strategies of a configuration file in any store that Spark reads: JSON, or YAML where a reader of it is installed.

    The file's entry strategies, or all of it, has a record a strategy by name. A record without a threshold, or that isn't
    enabled, is none; what it lacks has the default; a file without content has none.
    """
    text = spark.read.text(path, wholetext=True).first()
    text = text["value"] if text else ""
    try:
        content = json.loads(text) if text.strip() else {}
    except json.JSONDecodeError:
        import yaml

        content = yaml.safe_load(text) or {}
    entries = content.get("strategies", content)
    records = [(name, r) for name, r in entries.items() if isinstance(r, dict) and "model_threshold" in r and r.get("enabled", True)]
    return [Strategy(name=name, **{new: r[old] for old, new in SETTINGS.items() if r.get(old) is not None}) for name, r in records]


def judged(c: DataFrame, rules: list[Strategy], p: str = "p1_prob") -> DataFrame:
    """Each side of each contest under each strategy, with edge, value, the first reason against and the share to stake.

    The strategies are an array of constants in the plan, so nothing is joined.
    """
    side = lambda n, q: F.struct(F.lit(n).alias("side"), F.col(f"p{n}").alias("pick"), q.alias("prob"), F.col(f"odd{n}").alias("odds"))
    rule = lambda i, s: F.struct(
        F.lit(i).alias("rule"), F.lit(s.name).alias("strategy"), F.lit(s.threshold).alias("threshold"), F.lit(s.min_edge).alias("min_edge"),
        F.lit(s.min_ev).alias("min_ev"), F.lit(s.min_odds).alias("min_odds"), F.lit(s.max_odds).alias("max_odds"),
        F.lit(s.series).cast("array<string>").alias("series_list"), F.lit(s.surfaces).cast("array<string>").alias("surface_list"), F.lit(s.stake).alias("stake_kind"),
        F.lit(s.flat_pct).alias("flat_pct"), F.lit(s.fraction).alias("fraction"), F.lit(s.low).alias("low"), F.lit(s.high).alias("high"),
    )
    out = c.withColumn("_s", F.explode(F.array(side(1, F.col(p)), side(2, 1 - F.col(p))))).withColumn("_r", F.explode(F.array(*(rule(i, s) for i, s in enumerate(rules)))))
    out = out.select(*c.columns, "_s.*", "_r.*").withColumns({"edge": S.edge("prob", "odds"), "ev": S.expected_value("prob", "odds")})
    reason = (
        F.when(F.col("prob") < F.col("threshold"), "probability")
        .when(F.col("edge") < F.col("min_edge"), "edge")
        .when(F.col("ev") < F.col("min_ev"), "value")
        .when(F.col("odds") < F.col("min_odds"), "odds too low")
        .when(F.col("odds") > F.col("max_odds"), "odds too high")
        .when((F.size("series_list") > 0) & ~F.array_contains("series_list", F.col("series")), "series")
        .when((F.size("surface_list") > 0) & ~F.array_contains("surface_list", F.col("surface")), "surface")
    )
    k = S.raw_kelly("prob", "odds")
    kelly = F.when(k <= 0, 0.0).otherwise(F.greatest(F.col("low"), F.least(k / F.col("fraction"), F.col("high"))))
    share = F.when(F.col("stake_kind") == "flat", F.col("flat_pct")).otherwise(kelly)
    return out.withColumns({"reason": reason, "share": F.when(reason.isNull(), share).otherwise(0.0), "confidence": S.confidence("ev")})


def recommended(c: DataFrame, rules: list[Strategy], p: str = "p1_prob", tournament: str = "series") -> DataFrame:
    """Eligible bets, the one of the largest stake for each pick, tournament and day; the first strategy wins ties."""
    ok = judged(c, rules, p).where(F.col("share") > 0).drop("series_list", "surface_list")  # a refused side has no share
    rest = [x for x in ok.columns if x not in ("pick", tournament, "date")]
    order = F.struct(-F.col("share"), "contest_id", "side", "rule")
    best = ok.groupBy("pick", tournament, "date").agg(F.min_by(F.struct(*rest), order).alias("_b"))
    return best.select("pick", tournament, "date", "_b.*")


def refusals(c: DataFrame, rules: list[Strategy], p: str = "p1_prob") -> DataFrame:
    return judged(c, rules, p).groupBy("strategy", F.coalesce("reason", F.lit("eligible")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def all_reasons(prob: str, odds: str, rule: dict) -> Column:
    """Every failing gate of a rule, joined by commas; empty for a bet that passes."""
    ev, e = S.expected_value(prob, odds), S.edge(prob, odds)
    gates = (("edge", e < rule["min_edge"]), ("value", ev <= 0), ("too good", ev > rule["max_ev"]), ("odds", (F.col(odds) < rule["min_odds"]) | (F.col(odds) > rule["max_odds"])))
    return F.concat_ws(", ", *(F.when(g, F.lit(n)) for n, g in gates))


def value_side(c: DataFrame, p: str = "p1_prob") -> DataFrame:
    """The side with the larger edge over its raw implied probability, the first on ties; null odds have none."""
    e1, e2 = S.edge(p, "odd1"), S.edge(1 - F.col(p), "odd2")
    first = e1 >= e2
    return c.withColumns(
        {
            "side": F.when(first, 1).otherwise(2),
            "edge": F.greatest(e1, e2),
            "odds": F.when(first, F.col("odd1")).otherwise(F.col("odd2")),
            "prob": F.when(first, F.col(p)).otherwise(1 - F.col(p)),
            "won": F.when(first, F.col("win1")).otherwise(1 - F.col("win1")),
        }
    )


def explained(c: DataFrame, p: str = "p1_prob", min_edge: float = 0.035) -> DataFrame:
    """One contest's way from prices to decision, column by column."""
    fair = S.devig("odd1", "odd2")
    out = c.withColumns({"implied_1": S.implied("odd1"), "implied_2": S.implied("odd2"), "margin": S.overround("odd1", "odd2"), "fair_1": fair, "market_logit": S.logit(fair)})
    out = out.withColumns({"edge_fair": F.col(p) - F.col("fair_1"), "ev_1": S.expected_value(p, "odd1"), "ev_2": S.expected_value(1 - F.col(p), "odd2")})
    return out.withColumn("decision", F.when(F.col("edge_fair") >= min_edge, "bet 1").when(-F.col("edge_fair") >= min_edge, "bet 2").otherwise("pass"))


def qualified(c: DataFrame, rule: dict, p: str = "p1_prob") -> DataFrame:
    """Live choice of a side: the first if it passes its gates; the second replaces it only with a strictly larger edge."""
    out = c.withColumns({"_e1": S.edge(p, "odd1"), "_e2": S.edge(1 - F.col(p), "odd2")})
    ok = lambda q, n: S.gated_kelly(q, f"odd{n}", S.implied(f"odd{n}"), rule) > 0
    a, b = F.coalesce(ok(p, 1), F.lit(False)), F.coalesce(ok(1 - F.col(p), 2), F.lit(False))
    side = F.when(b & (~a | (F.col("_e2") > F.col("_e1"))), 2).when(a, 1)
    return out.withColumn("bet_side", side).withColumn("edge", F.when(side == 1, F.col("_e1")).when(side == 2, F.col("_e2"))).drop("_e1", "_e2")


def live_picks(c: DataFrame, min_edge: float, low: float, high: float, bankroll: float, divisor: float = 2.75, cap: float = 0.1, p: str = "p1_prob") -> DataFrame:
    """Picks by edge over the fair market: the first side if its edge is enough, not below the other's, and its price in range, else the second likewise."""
    fair = S.devig("odd1", "odd2")
    out = c.withColumns({"edge_1": F.col(p) - fair, "edge_2": fair - F.col(p)})
    inside = lambda n: F.col(f"odd{n}").between(low, high)
    first = (F.col("edge_1") >= min_edge) & (F.col("edge_1") >= F.col("edge_2")) & inside(1)
    side = F.when(first, 1).when((F.col("edge_2") >= min_edge) & inside(2), 2)
    out = out.withColumn("bet_side", side)
    q, odds = F.when(side == 1, F.col(p)).when(side == 2, 1 - F.col(p)), F.when(side == 1, F.col("odd1")).when(side == 2, F.col("odd2"))
    stake = F.when(side.isNotNull(), S.capped_kelly(q, odds, F.lit(bankroll), divisor, cap)).otherwise(0.0)
    return out.withColumns({"odds": odds, "stake": stake, "ev": F.round(S.expected_value(q, odds), 4)})


def board(events: DataFrame, names: DataFrame, ranks: DataFrame, priced: DataFrame, rule: dict, bankroll: float) -> DataFrame:
    """Coming events with the model's names, last ranks, pick, stake and tournament; an event without both names or prices has no pick.

    events: event_id, home, away, odd1, odd2, key, title; names: (name, player); ranks: (player, rank); priced: (event_id, p1_prob).
    """
    out = events
    for side in ("home", "away"):
        known = names.select(F.col("name").alias(side), F.col("player").alias(f"player_{side}"))
        out = out.join(known, side, "left").join(ranks.select(F.col("player").alias(f"player_{side}"), F.col("rank").alias(f"rank_{side}")), f"player_{side}", "left")
    name, series, surface, best_of = S.tournament_facts("key", "title")
    out = out.withColumns({"tournament": name, "series": series, "surface": surface, "best_of": best_of}).join(priced, "event_id", "left")
    whole = F.col("player_home").isNotNull() & F.col("player_away").isNotNull() & (F.col("odd1") > 1) & (F.col("odd2") > 1)
    v = value_side(out.withColumns({"win1": F.lit(0), "_whole": F.coalesce(whole, F.lit(False))})).drop("win1", "won")
    stake, bet = S.table_stake("prob", "odds", F.lit(bankroll), rule)
    has = F.col("_whole") & F.coalesce(bet & (F.col("edge") > 0), F.lit(False))
    out = v.withColumns({"ev": S.expected_value("prob", "odds"), "bet": has}).withColumn("stake", F.when(F.col("bet"), stake).otherwise(0.0))
    return out.drop("_whole")


def totals(picks: DataFrame, keys: list[str]) -> DataFrame:
    """Recommended bets, their stakes and the value they promise."""
    b = F.col("bet")
    return picks.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum(b.cast("int")).alias("bets"), F.sum(F.when(b, F.col("stake")).otherwise(0.0)).alias("staked"),
        F.sum(F.when(b, F.col("stake") * F.col("ev")).otherwise(0.0)).alias("promised"),
    )
