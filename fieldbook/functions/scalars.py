"""Column functions: stats, odds, probabilities, grades, names. All are built of Spark's own functions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Break-even rate of one of two legs that pay three times the stake.
BREAKEVEN = 0.577


def ratio(a: Column, b: Column, empty: float | None = 0.0) -> Column:
    """a / b, and `empty` where b is zero, negative or null or a is null."""
    out = F.when(b > 0, a / b)
    return out if empty is None else F.coalesce(out, F.lit(empty))


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(x, F.lit(high)), F.lit(low))


# --- stats -----------------------------------------------------------------------------------------


def stat(stats: Column, name: str, *aliases: str) -> Column:
    """A number of a JSON object's field, else of the first alias that it has; bad or missing ones are 0."""
    fields = F.from_json(stats, "map<string,string>")
    return F.coalesce(*[F.try_element_at(fields, F.lit(n)).try_cast("double") for n in (name, *aliases)], F.lit(0.0))


def combo(parts: Sequence[Column], strict: bool = True) -> Column:
    """Sum of parts; null if any is null when strict (settlement), else nulls count as 0 (display)."""
    total = F.lit(0.0)
    for p in parts:
        total = total + (p if strict else F.coalesce(p, F.lit(0.0)))
    return total


def numeric_text(x: Column) -> Column:
    """The number of an unsigned numeric text, else null."""
    return F.when(x.rlike(r"^[0-9.]+$"), x.try_cast("double"))


def made_attempted(x: Column) -> Column:
    """'5-12' as a struct (made, attempted); zeros where it isn't that."""
    part = lambda i: F.coalesce(F.regexp_extract(x, r"^(\d+)-(\d+)$", i).try_cast("int"), F.lit(0))
    return F.struct(part(1).alias("made"), part(2).alias("attempted"))


def minutes(x: Column) -> Column:
    """'31:30' as 31.5, '31' as 31, anything else as 0."""
    m, s = F.regexp_extract(x, r"^(\d+)(?::(\d+))?$", 1).try_cast("double"), F.regexp_extract(x, r"^(\d+):(\d+)$", 2).try_cast("double")
    return F.coalesce(m, F.lit(0.0)) + F.coalesce(s, F.lit(0.0)) / 60


def possessions(fga: Column, fta: Column, turnovers: Column, offensive_rebounds: Column) -> Column:
    return fga + 0.4 * fta + turnovers - offensive_rebounds


# --- odds and probabilities ------------------------------------------------------------------------


def american_implied(odds: Column) -> Column:
    return F.when(odds > 0, 100.0 / (odds + 100.0)).when(odds < 0, -odds / (-odds + 100.0))


def american_decimal(odds: Column) -> Column:
    return F.when(odds > 0, 1 + odds / 100.0).when(odds < 0, 1 + 100.0 / -odds)


def no_vig(over: Column, under: Column) -> Column:
    a, b = american_implied(over), american_implied(under)
    return F.when(a + b > 0, a / (a + b))


def implied_totals(total: Column, spread: Column) -> tuple[Column, Column]:
    """Implied points of the home and the away team; the home team gives the spread's points."""
    return (total + spread) / 2, (total - spread) / 2


def wilson(wins: Column, n: Column, z: float = 1.0) -> tuple[Column, Column]:
    """Lower and upper Wilson bound of a win rate; 0 and 1 without any trial."""
    size = F.when(n > 0, n.cast("double"))
    p = wins / size
    middle, scale = p + z * z / (2 * size), 1 + z * z / size
    margin = z * F.sqrt(p * (1 - p) / size + z * z / (4 * size * size))
    return F.coalesce((middle - margin) / scale, F.lit(0.0)), F.coalesce((middle + margin) / scale, F.lit(1.0))


def platt(p: Column, slope: Column, intercept: Column, fitted: Column | None = None, eps: float = 1e-6) -> Column:
    """sigmoid(slope * logit(p) + intercept); p itself where no map is fitted."""
    q = clip(p, eps, 1 - eps)
    mapped = 1 / (1 + F.exp(-(slope * F.log(q / (1 - q)) + intercept)))
    ok = slope.isNotNull() & intercept.isNotNull() if fitted is None else fitted
    return F.when(ok, mapped).otherwise(p)


def blend(model: Column, market: Column, weight: Column) -> Column:
    """weight * model + (1 - weight) * market; the model alone without a market. No weight counts as 1."""
    w = F.coalesce(weight, F.lit(1.0))
    return F.coalesce(w * model + (1 - w) * market, model)


def pick_ev(p: Column, payout: Column) -> Column:
    return p * payout - 1


def roi_two_legs(p: Column) -> Column:
    return 3 * p * p - 1


def half_kelly(p: Column) -> Column:
    """Half the Kelly stake of one of two legs at three times the stake."""
    return F.greatest(F.lit(0.0), (3 * p - 1) / 4)


# --- grades ----------------------------------------------------------------------------------------


def grade(actual: Column, line: Column, direction: Column) -> Column:
    over = actual > line
    return F.when(actual == line, "push").when(over == (direction == "over"), "win").when(over.isNotNull() & direction.isNotNull(), "loss")


def clv_points(opened: Column, closed: Column, direction: Column) -> Column:
    """Points that the line moved our way."""
    return F.when(direction == "over", closed - opened).when(direction == "under", opened - closed)


def side_adjusted(over_prob: Column, direction: Column) -> Column:
    return F.when(direction == "under", 1 - over_prob).otherwise(over_prob)


# --- context ---------------------------------------------------------------------------------------


def wind_out(speed: Column, from_degrees: Column, bearing: Column) -> Column:
    """The wind's part toward center field; it blows from `from_degrees`, the field looks to `bearing`."""
    return speed * F.cos(F.radians(F.pmod(from_degrees + 180, F.lit(360.0)) - bearing))


def first_match(name: Column, factors: Sequence[tuple[str, float]], default: float) -> Column:
    """The factor of the first listed part that the name holds, in any case of letters."""
    out = None
    for part, value in factors:
        test = F.lower(name).contains(part.lower())
        out = F.when(test, F.lit(value)) if out is None else out.when(test, F.lit(value))
    return F.lit(default) if out is None else out.otherwise(F.lit(default))


def platoon(batter: Column, pitcher: Column) -> Column:
    """1 for opposite hands, -1 for the same, 0.5 for a switch hitter, 0 if unknown."""
    known = batter.isin("L", "R") & pitcher.isin("L", "R")
    return F.when(batter == "S", 0.5).when(known & (batter != pitcher), 1.0).when(known, -1.0).otherwise(0.0)


def position_group(position: Column, groups: Mapping[str, str], default: str = "forward") -> Column:
    table = F.create_map(*[F.lit(x) for kv in groups.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.upper(position)), F.lit(default))


#: Parts of status texts of players who play all the same, and of players who don't.
PLAYS_ANYWAY = ("day-to-day", "day to day", "questionable", "probable", "gtd", "game-time", "available")
WONT_PLAY = ("out", "doubtful", "il", "suspens", "developmental", "bereavement", "paternity")


def is_out(status: Column, plays: Sequence[str] = PLAYS_ANYWAY, out: Sequence[str] = WONT_PLAY) -> Column:
    """Whether the status says that the player won't play; words for playing anyway go first, no status counts as playing."""
    s = F.lower(F.coalesce(status, F.lit("")))
    return ~s.rlike("|".join(plays)) & s.rlike("|".join(out))


def inside_band(line: Column, low: Column, high: Column) -> Column:
    """Whether the line is in its stat's band; an open end, or no band, lets it pass."""
    return F.coalesce(line >= low, F.lit(True)) & F.coalesce(line <= high, F.lit(True))


ACCENTED = "áàâäãåāéèêëēíìîïīóòôöõøōúùûüūñńçćčšśžźżýÿłđğ"
PLAIN = "aaaaaaaeeeeeiiiiiooooooouuuuunncccsszzzyyldg"


def name_key(name: Column) -> Column:
    """Lower case without Latin accents; runs of anything but letters and digits are one space."""
    plain = F.translate(F.lower(name), ACCENTED, PLAIN)
    return F.trim(F.regexp_replace(plain, r"[^\p{L}\p{N}]+", " "))


def model_sport(model: Column, registry: Mapping[str, str], prefixes: Sequence[tuple[str, str]], default: str) -> Column:
    """The sport of a model: by the registry, else by the first prefix that fits, else the default."""
    out = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in registry.items() for x in kv]), model), F.lit(None).cast("string")) if registry else F.lit(None).cast("string")
    by = None
    for p, sport in prefixes:
        by = F.when(model.startswith(p), sport) if by is None else by.when(model.startswith(p), sport)
    return F.coalesce(out, by if by is not None else F.lit(None).cast("string"), F.lit(default))


def recency_weight(date: Column, newest: Column, half_life: float = 365.0) -> Column:
    return F.pow(F.lit(0.5), F.datediff(newest, date) / half_life)


def local_day(ts: Column, zone: str = "America/Los_Angeles") -> Column:
    return F.to_date(F.from_utc_timestamp(ts, zone))


# --- availability ----------------------------------------------------------------------------------

#: The weights of the recent averages and the limits, in minutes.
RECENT_WEIGHTS = (0.5, 0.3, 0.2)
LEAST_MINUTES, BENCH_MINUTES, LOST_MINUTES, ROTATION_MINUTES = 12.0, 8.0, 15.0, 5.0


def projected_minutes(last5: Column, last10: Column, last20: Column, season: Column, bump: Column | None = None) -> Column:
    """The averages of the last 5, 10 and 20 games that are present, by their weights, else the season's (none: 0); at least the bump.

    An average of zero is present: it tells that the player hasn't played.
    """
    parts = tuple(zip((last5, last10, last20), RECENT_WEIGHTS, strict=True))
    total = sum((F.when(c.isNotNull(), F.lit(w)).otherwise(0.0) for c, w in parts), F.lit(0.0))
    value = sum((F.when(c.isNotNull(), c * w).otherwise(0.0) for c, w in parts), F.lit(0.0))
    base = F.coalesce(F.when(total > 0, value / total), season, F.lit(0.0))
    return base if bump is None else F.greatest(base, F.coalesce(bump, F.lit(0.0)))


def teammate_bump(last5: Column, season: Column, minutes_out: Column) -> Column:
    """Minutes that a rotation player may count on when teammates who play LOST_MINUTES or more are out; 0 for others."""
    floor = F.coalesce(last5, season, F.lit(0.0))
    return F.when((F.coalesce(minutes_out, F.lit(0.0)) >= LOST_MINUTES) & (floor >= ROTATION_MINUTES), LEAST_MINUTES + 2).otherwise(0.0)


def availability(last5: Column, last10: Column, last20: Column, season: Column, bump: Column) -> Column:
    """projected (one decimal), dnp_risk, suppressed and reason ("minutes", "bench", "collapse", or null) as a struct.

    Risky: a recent average below BENCH_MINUTES without a bump that clears the floor, or one of less than 55 % of the
    last 20 games' and below 18. Suppressed: projected below LEAST_MINUTES, or risky.
    """
    base = projected_minutes(last5, last10, last20, season)
    projected = F.round(projected_minutes(last5, last10, last20, season, bump), 1)
    bench = (F.coalesce(last5, base) < BENCH_MINUTES) & (F.coalesce(bump, F.lit(0.0)) < LEAST_MINUTES)
    collapse = F.coalesce((last20 > 0) & (last5 < 0.55 * last20) & (last5 < 18), F.lit(False))
    short = projected < LEAST_MINUTES
    return F.struct(projected.alias("projected"), (bench | collapse).alias("dnp_risk"), (short | bench | collapse).alias("suppressed"), F.when(short, "minutes").when(bench, "bench").when(collapse, "collapse").alias("reason"))


# --- joint probabilities ---------------------------------------------------------------------------


def joint_legs(probs: Sequence[Column], rho: Mapping[tuple[int, int], Column]) -> Column:
    """First-order joint probability of correlated legs, within 0.01 and 0.99."""
    product = probs[0]
    for p in probs[1:]:
        product = product * p
    sd = [F.sqrt(p * (1 - p)) for p in probs]
    out = product
    for (i, j), r in rho.items():
        rest = F.lit(1.0)
        for k, p in enumerate(probs):
            rest = rest if k in (i, j) else rest * p
        out = out + r * sd[i] * sd[j] * rest
    return clip(out, 0.01, 0.99)
