"""Scalar rules as plain Column expressions: ratings, prices, stakes, names, texts."""

from __future__ import annotations

import math
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the domain.
TOURNAMENT_WEIGHT = {
    "Grand Slam": 1.5, "Masters Cup": 1.4, "Masters 1000": 1.2, "ATP500": 1.1, "ATP250": 1.0, "International Gold": 1.0,
    "International": 0.9, "WTA Premier Mandatory": 1.3, "WTA Premier 5": 1.2, "WTA Premier": 1.1, "WTA International": 0.9,
}
SERIES_RANK = {
    "v3": ({"Grand Slam": 7, "Masters Cup": 6, "Masters 1000": 5, "ATP500": 4, "ATP250": 3, "International Gold": 2, "International": 2}, 3),
    "notebook": ({"Grand Slam": 5, "Masters 1000": 4, "Masters": 4, "ATP500": 3, "ATP250": 2, "International": 2, "International Gold": 3}, 1),
}
ROUND_RANK = {
    "v3": ({"1st Round": 1, "2nd Round": 2, "3rd Round": 3, "4th Round": 4, "Quarterfinals": 5, "Semifinals": 6, "The Final": 7, "Round Robin": 4, "Bronze Match": 5}, 3),
    "notebook": ({"1st Round": 1, "2nd Round": 2, "3rd Round": 3, "4th Round": 4, "Quarterfinals": 5, "Semifinals": 6, "The Final": 7, "Round Robin": 3}, 1),
    "app": ({"1st Round": 1, "2nd Round": 2, "3rd Round": 3, "4th Round": 4, "Quarterfinals": 5, "Semifinals": 6, "The Final": 7, "Round Robin": 5}, 3),
}
WORDS_FOR_RESULTS = {
    "win": ("win", "won", "w", "gagne", "gagné"),
    "loss": ("loss", "lost", "lose", "l", "perdu"),
    "void": ("void", "push", "cancelled", "annule", "annulé"),
}
INDOOR_TOWNS = ("indoor", "paris", "rotterdam", "vienna", "basel", "marseille", "metz", "stockholm")
ODDS_EDGES = [1, 1.3, 1.6, 2, 3, 5, 50]
ODDS_LABELS = ["(1, 1.3]", "(1.3, 1.6]", "(1.6, 2]", "(2, 3]", "(3, 5]", "(5, 50]"]


def _accents() -> tuple[str, str]:
    """Letters of the Latin blocks with the ASCII letter that compatibility decomposition leaves of each."""
    pairs = {}
    for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]):
        plain = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if len(plain) == 1 and plain.isascii() and plain != c:
            pairs[c] = plain
    return "".join(pairs), "".join(pairs.values())


ACCENTS = _accents()
#: Marks that stand alone after their letter.
MARKS = r"[\u0300-\u036f]"


# Keys and words by which a tournament's series and surface are told.
SLAM_KEYS = ("aus_open", "french_open", "wimbledon", "us_open")
CLAY_WORDS = (
    "french", "roland", "rome", "italian", "madrid", "monte_carlo", "monte carlo", "barcelona", "hamburg", "buenos_aires", "rio", "chile",
    "santiago", "cordoba", "bastad", "gstaad", "kitzbuhel", "umag", "bucharest", "lyon", "geneva", "parma", "marrakech",
)
GRASS_WORDS = ("wimbledon", "halle", "queens", "queen", "eastbourne", "stuttgart_grass", "s_hertogenbosch", "mallorca", "newport")


def _c(x: Column | str | float) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def lookup(column: Column | str, table: dict, default: object) -> Column:
    """Enumeration map with a default for what it doesn't have."""
    pairs = F.create_map(*(F.lit(x) for kv in table.items() for x in kv))
    return F.coalesce(F.try_element_at(pairs, _c(column)), F.lit(default))


def one_hot(column: str, values: list[str]) -> dict[str, Column]:
    return {f"is_{v.lower()}": F.coalesce((F.col(column) == v).cast("int"), F.lit(0)) for v in values}


def expected_score(a: Column | str, b: Column | str) -> Column:
    """Chance of the first rating against the second."""
    return 1 / (1 + F.pow(F.lit(10.0), (_c(b) - _c(a)) / 400))


def dynamic_k(base: float, played: Column | str, form: Column | str, weight: Column | float = 1.0) -> Column:
    """Step of a rating: smaller with experience, larger with form and the event's weight."""
    experience = F.when(_c(played) < 30, 1.0).when(_c(played) < 100, 0.85).otherwise(0.70)
    return F.lit(base) * experience * (0.85 + 0.30 * _c(form)) * _c(weight)


def decayed(rating: Column | str, days: Column | str, initial: float = 1500.0, half_life: int = 180, floor: float = 0.85) -> Column:
    """Rating drawn back to the initial one after more than thirty days without a contest."""
    factor = F.greatest(F.pow(F.lit(0.5), _c(days) / half_life), F.lit(floor))
    return F.when(_c(days) > 30, initial * (1 - factor) + _c(rating) * factor).otherwise(_c(rating))


def implied(odds: Column | str) -> Column:
    return F.when(_c(odds) > 1, 1 / _c(odds))


def devig(odds_1: Column | str, odds_2: Column | str) -> Column:
    """First side's probability without the margin; null unless both prices are valid."""
    a, b = implied(odds_1), implied(odds_2)
    return F.try_divide(a, a + b)


def overround(odds_1: Column | str, odds_2: Column | str) -> Column:
    return implied(odds_1) + implied(odds_2) - 1


def edge(p: Column | str, odds: Column | str) -> Column:
    return _c(p) - implied(odds)


def expected_value(p: Column | str, odds: Column | str) -> Column:
    return _c(p) * _c(odds) - 1


def logit(p: Column | str, low: float = 0.01, high: float = 0.99) -> Column:
    q = F.greatest(F.lit(low), F.least(F.lit(high), _c(p)))
    return F.ln(q / (1 - q))


def raw_kelly(p: Column | str, odds: Column | str) -> Column:
    b = _c(odds) - 1
    return F.when(b > 0, (_c(p) * b - (1 - _c(p))) / b)


def kelly_share(p: Column | str, odds: Column | str, fraction: float = 4.0, low: float = 0.01, high: float = 0.05) -> Column:
    """Share of the bankroll: the lower bound for invalid input, nothing without value, else a clipped fraction of Kelly."""
    k, p, odds = raw_kelly(p, odds), _c(p), _c(odds)
    return F.when((odds <= 1) | (p <= 0) | (p >= 1), F.lit(low)).when(k <= 0, F.lit(0.0)).otherwise(F.greatest(F.lit(low), F.least(k / fraction, F.lit(high))))


def gated_kelly(p: Column | str, odds: Column | str, market: Column | str, rule: dict) -> Column:
    """Share of the bankroll if edge, value and price pass the rule's gates, else 0."""
    p_, odds_, ev, k = _c(p), _c(odds), expected_value(p, odds), raw_kelly(p, odds)
    passed = (
        (p_ - _c(market) >= rule["min_edge"]) & (ev > 0) & (ev <= rule.get("max_ev", 1e9))
        & (odds_ >= rule.get("min_odds", 1.0)) & (odds_ <= rule.get("max_odds", 1e9)) & (k > 0)
    )
    share = F.greatest(F.lit(rule.get("low", 0.0)), F.least(k / rule["divisor"], F.lit(rule.get("high", 1.0))))
    return F.when(passed, share).otherwise(0.0)


def capped_kelly(p: Column | str, odds: Column | str, bankroll: Column | float, divisor: float, cap: float) -> Column:
    """Amount: a part of Kelly, never negative, capped, to two places."""
    k = F.greatest(F.lit(0.0), F.coalesce(raw_kelly(p, odds), F.lit(0.0))) / divisor
    return F.round(F.least(k, F.lit(cap)) * _c(bankroll), 2)


def quarter_kelly(p: Column | str, odds: Column | str, bankroll: Column | float, part: float = 0.25, cap: float = 0.10) -> Column:
    """Amount by a part of (p odds - 1) / (odds - 1), never negative, at most a share of the bankroll."""
    k = F.try_divide(_c(p) * _c(odds) - 1, _c(odds) - 1)
    return _c(bankroll) * F.greatest(F.lit(0.0), F.least(k * part, F.lit(cap)))


def table_stake(p: Column | str, odds: Column | str, bankroll: Column | float, rule: dict) -> tuple[Column, Column]:
    """(amount, whether to bet) by a stake rule: flat ones always bet their share, Kelly ones a clipped part where there is value."""
    if rule["type"] == "flat":
        return _c(bankroll) * rule["stake_pct"], F.lit(True)
    b, k = _c(odds) - 1, raw_kelly(p, odds)
    share = F.greatest(F.lit(rule["min_bet_pct"]), F.least(k / rule["kelly_fraction"], F.lit(rule["max_bet_fraction"])))
    return F.when(b > 0, _c(bankroll) * share).otherwise(0.0), F.when(b > 0, expected_value(p, odds) > 0).otherwise(False)


def gated_flat(amount: float, p: Column | str, market: Column | str, bankroll: Column | str, min_edge: float) -> Column:
    """A fixed amount within the bankroll where the model is far enough above the market, else 0."""
    return F.when(_c(p) - _c(market) >= min_edge, flat_amount(amount, bankroll)).otherwise(0.0)


def flat_amount(amount: float, bankroll: Column | str) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(amount), _c(bankroll)))


def settled_profit(stake: Column | str, odds: Column | str, result: Column | str) -> Column:
    return F.when(_c(result) == "win", _c(stake) * (_c(odds) - 1)).when(_c(result) == "loss", -_c(stake)).otherwise(0.0)


def closing_value(entry: Column | str, closing: Column | str) -> Column:
    """(closing probability - entry probability) / entry probability; 0 for invalid prices."""
    return F.when((_c(entry) > 0) & (_c(closing) > 0), _c(entry) / _c(closing) - 1).otherwise(0.0)


def synthetic_odds(p: Column | str, margin: float = 0.05, apply_margin: bool = True) -> Column:
    """Price of a clipped probability, with the margin in it or fair."""
    q = F.greatest(F.lit(0.02), F.least(F.lit(0.98), _c(p)))
    return 1 / (q * (1 + margin)) if apply_margin else 1 / q


def hash_uniform(*keys: Column | str) -> Column:
    """A number in [0, 1) that follows from the keys, in place of an unseeded random one."""
    return F.pmod(F.xxhash64(*keys), F.lit(1 << 30)) / float(1 << 30)


def noisy_odds(p: Column | str, *keys: Column | str, sigma: float = 0.15, margin: float = 0.05) -> Column:
    """Synthetic price with a normal error drawn from the keys (Box and Muller)."""
    u, v = F.greatest(hash_uniform(*keys), F.lit(1e-9)), hash_uniform(F.lit("second"), *keys)
    z = F.sqrt(-2 * F.ln(u)) * F.cos(2 * math.pi * v)
    q = F.greatest(F.lit(0.05), F.least(F.lit(0.95), _c(p) + sigma * z))
    return 1 / (q * (1 + margin))


def safe_ratio(a: Column | str, b: Column | str) -> Column:
    """Null where the divisor is null or 0."""
    return F.try_divide(_c(a).cast("double"), _c(b).cast("double"))


def safe_rank(rank: Column | str, default: float = 100.0) -> Column:
    return F.when(_c(rank) > 0, _c(rank).cast("double")).otherwise(default)


def log_rank_diff(a: Column | str, b: Column | str) -> Column:
    return F.log1p(safe_rank(a)) - F.log1p(safe_rank(b))


def sentinel_to_null(column: Column | str, sentinel: float = -1) -> Column:
    return F.nullif(_c(column), F.lit(sentinel))


def valid_odds(odds: Column | str) -> Column:
    return F.when(_c(odds) > 1, _c(odds))


def month_cycle(date: Column | str) -> tuple[Column, Column]:
    angle = F.month(_c(date)) * (2 * math.pi / 12)
    return F.sin(angle), F.cos(angle)


def indoor(surface: Column | str, tournament: Column | str) -> Column:
    words = _c(tournament).rlike("(?i)" + "|".join(INDOOR_TOWNS))
    return F.when((_c(surface) == "Carpet") | F.coalesce(words, F.lit(False)), 1).otherwise(0)


def tournament_facts(key: Column | str, title: Column | str) -> tuple[Column, Column, Column, Column]:
    """(name, series, surface, best of) by words in a tournament's key and title; a listed tournament's own facts go before these."""
    key, title = F.lower(_c(key)), F.nullif(_c(title), F.lit(""))
    told = F.coalesce(F.lower(title), key)
    has = lambda words: key.rlike("|".join(words)) | told.rlike("|".join(words))
    slam = told.contains("grand slam") | key.rlike("|".join(SLAM_KEYS))
    series = F.when(slam, "Grand Slam").when(has(["masters"]), "Masters 1000").otherwise("ATP")
    surface = F.when(has(CLAY_WORDS), "Clay").when(has(GRASS_WORDS), "Grass").otherwise("Hard")
    own = F.regexp_replace(F.regexp_replace(title, "ATP ", ""), "WTA ", "")
    from_key = F.initcap(F.regexp_replace(F.regexp_replace(_c(key), "tennis_atp_", ""), "_", " "))
    return F.coalesce(own, from_key), series, surface, F.when(slam, 5).otherwise(3)


def age_years(born: Column | str, at: Column | str) -> Column:
    return F.datediff(_c(at), _c(born)) / 365.25


def stance_mismatch(a: Column | str, b: Column | str) -> Column:
    return F.coalesce(((_c(a) == "Southpaw") != (_c(b) == "Southpaw")).cast("int"), F.lit(0))


def accuracy(landed: Column | str, tried: Column | str) -> Column:
    return _c(landed) / F.greatest(_c(tried), F.lit(1))


def confidence(ev: Column | str) -> Column:
    return F.when(_c(ev) > 0.08, "high").when(_c(ev) > 0.03, "medium").otherwise("low")


def bucket(value: Column | str, edges: list[float], labels: list[str]) -> Column:
    """Right-closed intervals (a, b]; null outside of them."""
    out = F.lit(None).cast("string")
    for a, b, name in reversed(list(zip(edges[:-1], edges[1:], labels, strict=True))):
        out = F.when((_c(value) > a) & (_c(value) <= b), name).otherwise(out)
    return out


def url_id(url: Column | str) -> Column:
    """The long hexadecimal part of a URL, else its last segment, else the URL."""
    hexa, last = F.regexp_extract(_c(url), "([0-9a-f]{16,})", 1), F.regexp_extract(_c(url), "/([^/?#]+)/?(?:[?#].*)?$", 1)
    return F.when(hexa != "", hexa).when(last != "", last).otherwise(_c(url))


def clock_seconds(text: Column | str) -> Column:
    """MM:SS as seconds; null for anything else."""
    t = _c(text)
    return F.when(t.rlike(r"^\s*\d+:\d{1,2}\s*$"), F.regexp_extract(t, r"(\d+):", 1).try_cast("int") * 60 + F.regexp_extract(t, r":(\d+)", 1).try_cast("int"))


def first_number(text: Column | str) -> Column:
    return F.nullif(F.regexp_extract(_c(text), r"(-?\d+(?:\.\d+)?)", 1), F.lit("")).try_cast("double")


def x_of_y(text: Column | str) -> tuple[Column, Column]:
    parts = F.split(_c(text), " of ")
    ok = F.size(parts) == 2
    return tuple(F.when(ok, F.get(parts, i).try_cast("int")) for i in (0, 1))


def unaccented(text: Column | str) -> Column:
    """Letters without their accents: composed ones by a table, marks that follow a letter dropped; letters that don't decompose stay."""
    return F.regexp_replace(F.translate(_c(text), *ACCENTS), MARKS, "")


def plain_name(name: Column | str) -> Column:
    """Lower case without accents, letters and single spaces alone; everything else goes without leaving a space."""
    letters = F.regexp_replace(F.lower(unaccented(name)), r"[^a-z\s]", "")
    return F.trim(F.regexp_replace(letters, r"\s+", " "))


def name_tokens(name: Column | str, pattern: str = "[^a-z0-9']+") -> Column:
    return F.filter(F.split(F.lower(unaccented(name)), pattern), lambda w: w != "")


def pick_side(pick: Column | str, a: Column | str, b: Column | str) -> Column:
    """'a' or 'b' by the larger overlap of tokens, then by the last token; null if neither tells."""
    p, x, y = name_tokens(pick), name_tokens(a), name_tokens(b)
    n, m = F.size(F.array_intersect(p, x)), F.size(F.array_intersect(p, y))
    last = F.try_element_at(p, F.lit(-1))
    by_last = F.when(last == F.try_element_at(x, F.lit(-1)), "a").when(last == F.try_element_at(y, F.lit(-1)), "b")
    return F.when(n > m, "a").when(m > n, "b").otherwise(by_last)


def normal_result(text: Column | str) -> Column:
    t = F.lower(F.trim(_c(text)))
    out = F.lit(None).cast("string")
    for name, words in WORDS_FOR_RESULTS.items():
        out = F.when(t.isin(*words), name).otherwise(out)
    return out


def parse_moment(text: Column | str) -> Column:
    """A timestamp without zone from any of the formats in use."""
    t = _c(text).cast("string")
    formats = ("yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd", "dd/MM/yyyy HH:mm", "dd/MM/yyyy")
    return F.coalesce(*(F.try_to_timestamp(t, F.lit(f)) for f in formats)).cast("timestamp_ntz")


def set_scores(pairs: list[tuple[str, str]], swapped: Column) -> Column:
    """'6-4 7-5' from pairs of columns, seen from the first side."""
    each = [F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), F.when(swapped, F.concat_ws("-", b, a)).otherwise(F.concat_ws("-", a, b))) for a, b in pairs]
    return F.concat_ws(" ", *each)


def swap_side(*keys: Column | str) -> Column:
    """True for half of the keys; the same key always gets the same answer."""
    return F.pmod(F.xxhash64(*keys), F.lit(2)) == 1


def safe_username(name: Column | str) -> Column:
    return F.regexp_replace(F.lower(F.trim(_c(name))), "[^a-z0-9_.-]", "_")


def valid_username(name: Column | str) -> Column:
    return F.coalesce(_c(name).rlike("^[A-Za-z0-9_.-]{3,32}$"), F.lit(False))


def widest(*columns: str) -> Column:
    """The largest of several columns, whatever their signs."""
    return F.greatest(*(F.abs(c) for c in columns))


def same_or_empty(column: str, value: str) -> Column:
    """Equality in which null and the empty text are the same."""
    return F.coalesce(F.col(column), F.lit("")) == value


def json_field(text: Column | str, name: str) -> Column:
    """A field of a JSON text, as text; null where it isn't JSON or has none."""
    return F.get_json_object(_c(text), f"$.{name}")


def t_tail(t: Column | str, df: Column | str, steps: int = 400) -> Column:
    """Chance of more than t by Student's law: one half less Simpson's sum of the density from 0 to t.

    The density's constant comes from the series of a ratio of gamma functions, which holds for many
    degrees of freedom, and steps down from twenty more.
    """
    t, v = _c(t), _c(df).cast("double")
    w = v + 20
    ratio = F.sqrt(w / 2) * (1 - 1 / (4 * w) + 1 / (32 * w * w) + 5 / (128 * F.pow(w, 3)) - 21 / (2048 * F.pow(w, 4)))
    for k in range(10):
        ratio = ratio * (v + 2 * k) / (v + 2 * k + 1)
    h = t / steps
    density = lambda x: F.pow(1 + x * x / v, -(v + 1) / 2)
    weight = lambda i: F.when((i == 0) | (i == steps), 1.0).when(i % 2 == 1, 4.0).otherwise(2.0)
    area = F.aggregate(F.sequence(F.lit(0), F.lit(steps)), F.lit(0.0), lambda a, i: a + weight(i) * density(i * h)) * h / 3
    return 0.5 - area * ratio / F.sqrt(v * math.pi)


def money_text(x: Column | str) -> Column:
    return F.format_string("%.2f", _c(x).cast("double"))


def day_text(x: Column | str) -> Column:
    return F.date_format(_c(x), "dd/MM")


def percent_text(x: Column | str, digits: int = 1) -> Column:
    return F.concat(F.format_number(_c(x) * 100, digits), F.lit("%"))
