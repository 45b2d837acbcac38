"""Match contexts, chat-format text built from them, and parsing of model outputs, all as columns."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from decimal import Decimal
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchgrid.functions.scalars import fixed_places, fmt_or_dash, half_even, half_even_of_sum, result_from_score
from matchgrid.operators.aggregates import PROFILE_MEANS, PROFILE_SUMS, has_form, position_of, team_profile
from matchgrid.operators.joins import attach_sides, with_head_to_head

# Fixed texts of the samples.
SYSTEM_PROMPT = "You are a football match prediction model. Given team stats, predict the result, score, and brief reasoning."
CLOSING = "Predict result, score, and reasoning."
POSITIONS = ("Goalkeeper", "Defender", "Midfielder", "Attacker", "Forward")


def plainly(value: Column, of: Callable[[Column], Column]) -> Column:
    """``of(value)`` evaluated expression by expression, and the projection it is part of in methods of their own.
    What is made of a long text in one piece of generated code is longer than what the JVM compiles, and runs many times slower."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


#: Positions that are counted in columns, in the order shown; others follow the named order below.
COUNTED = (*POSITIONS, "Unknown", "Winger")


def team_parts(starters: DataFrame) -> DataFrame:
    """(fixture_id, parts): sums and counts over a match's starters, from which ``team_block`` makes both teams' blocks.

    ``starters`` are lineup rows with their form, or nulls where a player has none. All that is added
    up has a fixed size: a team is one part, and one more for each further pair of coach and formation
    and for each position that isn't in ``COUNTED``. Rows are dealt by match once.
    """
    pos = position_of()
    other = F.when(has_form() & ~pos.isin(*COUNTED), pos)
    sums, means = ([c for c in names if c in starters.columns] for names in (PROFILE_SUMS, PROFILE_MEANS))
    counts = [F.count_if(has_form() & (pos == name)).alias(f"c_{i}") for i, name in enumerate(COUNTED)]
    values = [*[F.sum(c).alias(f"s_{c}") for c in dict.fromkeys(sums + means)], *[F.count(c).alias(f"n_{c}") for c in means]]
    dealt = starters.repartition("fixture_id").groupBy("fixture_id", "team_id", "coach", "formation", other.alias("other"))
    parts = dealt.agg(F.count("seasons_with_data").alias("n"), F.max(half_even(F.col("goals"), 2)).alias("top"), *_leads(), *counts, *values)
    return parts.groupBy("fixture_id").agg(F.collect_list(F.struct(*[c for c in parts.columns if c != "fixture_id"])).alias("parts"))


def _leads() -> list[Column]:
    """The lowest number and player in one value each: as a whole number where both are small, else as a decimal."""
    number, player = F.col("number").cast("bigint"), F.col("player_id").cast("bigint")
    small = F.coalesce(number.between(-(2**22), 2**22) & player.between(0, 2**40 - 1), F.lit(False))
    lowest = F.lit(Decimal(-(2**62)))
    of = lambda c: F.coalesce(c.cast("decimal(19,0)"), lowest)
    return [F.min(F.when(small, F.shiftleft(number, 40) + player)).alias("lead"), F.min(F.when(~small, _in_order(of(number), of(player)))).alias("wide_lead")]


def _in_order(number: Column, player: Column) -> Column:
    return number * F.lit(Decimal(2**64)) + player


def _lead(part: Column) -> Column:
    """A part's lowest number and player, of either size."""
    small = _in_order(F.shiftright(part["lead"], 40).cast("decimal(19,0)"), part["lead"].bitwiseAND(F.lit(2**40 - 1)).cast("decimal(19,0)"))
    return F.least(small, part["wide_lead"])


def team_sums(parts: Column, team_id: Column, columns: Sequence[str]) -> Column:
    """The parts of one team of a ``team_parts`` row (``own``) and what they add up to (``t``), as a struct."""
    sums, means = ([c for c in names if c in columns] for names in (PROFILE_SUMS, PROFILE_MEANS))
    added = ["n", *[f"c_{i}" for i in range(len(COUNTED))], *[f"s_{c}" for c in dict.fromkeys(sums + means)], *[f"n_{c}" for c in means]]

    def add(t: Column, x: Column) -> Column:
        first = _lead(x) < t["first"]
        staff = [F.when(first, x[c]).otherwise(t[c]).alias(c) for c in ("coach", "formation")]
        total = [F.coalesce(t[c] + x[c], t[c], x[c]).alias(c) for c in added]
        return F.struct(*staff, F.greatest(t["top"], x["top"]).alias("top"), *total, F.least(t["first"], _lead(x)).alias("first"))

    def start(x: Column) -> Column:
        return F.struct(*[x[c].alias(c) for c in ("coach", "formation", "top", *added)], _lead(x).alias("first"))

    def alone(x: Column) -> Column:
        return F.struct(*[x[c].alias(c) for c in ("coach", "formation", "top", *added)])

    def total(own: Column) -> Column:
        one = F.get(own, F.lit(0))
        merged = plainly(F.aggregate(F.slice(own, 2, F.size(own)), start(one), add), alone)
        return F.struct(F.when(F.size(own) > 1, merged).when(F.size(own) == 1, alone(one)).alias("t"), F.filter(own, lambda x: x["other"].isNotNull()).alias("odd"))

    return plainly(F.filter(parts, lambda x: x["team_id"] == team_id), total)


def profile_of(team: Column, columns: Sequence[str]) -> list[Column]:
    """Profile, coach, formation, position text and top scorer out of ``team_sums``, for a team whose starters have form."""
    sums, means = ([c for c in names if c in columns] for names in (PROFILE_SUMS, PROFILE_MEANS))
    t, odd = team["t"], team["odd"]

    def positions() -> Column:
        shown = lambda n, name: F.concat(n.cast("string"), F.lit(" "), F.upper(F.left(name, F.lit(3))))
        named = [F.when(t[f"c_{i}"] > 0, F.concat(t[f"c_{i}"].cast("string"), F.lit(" " + name[:3].upper()))) for i, name in enumerate(COUNTED)]
        k = len(POSITIONS)
        others = F.array_distinct(F.transform(odd, lambda x: x["other"]))
        counted = lambda name: F.aggregate(F.filter(odd, lambda x: x["other"] == name), F.lit(0).cast("long"), lambda m, x: m + x["n"])
        rest = F.concat(F.transform(others, lambda name: F.struct(name.alias("name"), counted(name).alias("n"))), F.array(*[F.struct(F.lit(name).alias("name"), t[f"c_{i}"].alias("n")) for i, name in enumerate(COUNTED) if i >= k]))
        sorted_rest = F.transform(F.array_sort(F.filter(rest, lambda x: x["n"] > 0)), lambda x: shown(x["n"], x["name"]))
        return F.when(F.size(odd) > 0, F.concat_ws(", ", *named[:k], sorted_rest)).otherwise(F.concat_ws(", ", *named))

    return [
        t["n"].alias("num_starters_with_data"),
        *[half_even_of_sum(t[f"s_{c}"], 1).alias(f"team_total_{c}") for c in sums],
        *[half_even_of_sum(F.try_divide(t[f"s_{c}"], t[f"n_{c}"].cast("double")), 2).alias(f"team_avg_{c}") for c in means],
        positions().alias("positions"),
        F.coalesce(t["top"], F.lit(0.0)).alias("top_scorer"),
        t["coach"].alias("coach"),
        t["formation"].alias("formation"),
    ]


def team_block(parts: Column, team_id: Column, columns: Sequence[str]) -> Column:
    """Profile, coach, formation, position text and top scorer of one team of a ``team_parts`` row, as a struct.

    The profile is that of ``aggregates.team_profile``; the struct is null for a team none of whose
    starters has form. ``columns``: those of the starters.
    """
    return plainly(team_sums(parts, team_id, columns), lambda team: F.when(team["t"]["n"] > 0, F.struct(*profile_of(team, columns))))


def form_before(team_match: DataFrame, n: int = 3) -> DataFrame:
    """(team_name, season, form): a team's last n results before each season, oldest first.

    Of each season only its last n matches are kept, so a season looks back on n rows a season.
    """
    w = Window.partitionBy("team_name", "season").orderBy(F.desc("fixture_id"))
    letter = F.when(F.col("scored") > F.col("conceded"), "W").when(F.col("scored") < F.col("conceded"), "L").otherwise("D")
    shown = F.concat(letter, F.lit(" "), F.col("scored").cast("string"), F.lit("-"), F.col("conceded").cast("string"))
    last = team_match.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= n)
    last = last.groupBy("team_name", "season").agg(F.array_sort(F.collect_list(F.struct("fixture_id", shown.alias("t")))).alias("l"))
    before = Window.partitionBy("team_name").orderBy("season").rowsBetween(Window.unboundedPreceding, -1)
    past = F.flatten(F.collect_list("l").over(before))
    # a slice from the end is empty on arrays shorter than n, so its start is kept above 0
    kept = F.slice(past, F.greatest(F.size(past) - (n - 1), F.lit(1)), n)
    return last.select("team_name", "season", F.array_join(F.transform(kept, lambda x: x["t"]), ", ").alias("form"))


def match_context(matches: DataFrame, starters: DataFrame, form: DataFrame) -> DataFrame:
    """One nested row for each fixture: both teams' profiles and form, meetings and outcome.

    What is joined by team comes first, while rows are narrow; ``starters`` as for ``team_parts``.
    A profile has the sums and means that ``starters`` has columns for.
    ``blocks`` are the lines on the home and the away team without their labels, if these columns are there.
    """
    out = with_head_to_head(matches)
    for side in ("home", "away"):
        past = form.select(F.col("team_name").alias(f"{side}_team_name"), "season", F.col("form").alias(f"{side}_form"))
        out = out.join(past, [f"{side}_team_name", "season"], "left")
    out = out.join(team_parts(starters), "fixture_id", "left")
    out = out.withColumns({f"{side}_sums": team_sums(F.col("parts"), F.col(f"{side}_team_id"), starters.columns) for side in ("home", "away")}).drop("parts")
    profile = lambda team: F.when(team["t"]["n"] > 0, F.struct(*profile_of(team, starters.columns)))
    out = out.withColumns({f"{side}_profile": profile(F.col(f"{side}_sums")) for side in ("home", "away")}).drop("home_sums", "away_sums")
    if all(c in starters.columns for c in BLOCK_COLUMNS):
        out = out.withColumn("blocks", F.array(*[block_lines(F.col(f"{side}_profile")) for side in ("home", "away")]))
    return out.withColumn("result", result_from_score(F.col("home_goals"), F.col("away_goals")))


#: Columns of the starters that ``block_lines`` needs, and those that ``render_reasoning`` needs.
BLOCK_COLUMNS = ("goals", "assists", "cards_yellow", "cards_red", "rating", "passes_accuracy", "goals_per_90", "tackles_per_90", "duel_win_pct")
REASONING_COLUMNS = ("goals", "rating", "passes_accuracy")


def block_lines(profile: Column) -> Column:
    """Five or six lines on a team, the first one without its label; the rest of one line if there is no profile.

    All is evaluated in any case, so that Spark makes a value once for all its uses.
    """
    p = lambda name: profile[name]
    f = lambda name, digits: fmt_or_dash(p(name), digits)
    known = lambda name: F.coalesce(F.nullif(p(name), F.lit("")), F.lit("?"))
    top = F.when(p("top_scorer") > 0, p("top_scorer").cast("bigint").cast("string")).otherwise("-")
    lines = F.concat(
        F.lit(" | Coach: "), known("coach"), F.lit(" | Formation: "), known("formation"),
        F.lit("\nSquad: "), p("num_starters_with_data").cast("string"), F.lit(" starters | Avg Rating: "), f("team_avg_rating", 1),
        F.lit("\nAttack: "), f("team_total_goals", 0), F.lit(" goals ("), f("team_avg_goals_per_90", 2), F.lit("/90) | "), f("team_total_assists", 0), F.lit(" assists | Top scorer: "), top, F.lit(" goals"),
        F.lit("\nDefense: "), f("team_total_cards_yellow", 0), F.lit(" yellows, "), f("team_total_cards_red", 0), F.lit(" reds | Tackles/90: "), f("team_avg_tackles_per_90", 2), F.lit(" | Duels: "), f("team_avg_duel_win_pct", 0), F.lit("%"),
        F.lit("\nPassing: "), f("team_avg_passes_accuracy", 0), F.lit("% accuracy"),
        plainly(p("positions"), lambda x: F.when(x != "", F.concat(F.lit("\nPositions: "), x)).otherwise("")),
    )
    return F.coalesce(lines, F.lit(": No data"))


#: What ``block_lines`` and ``render_reasoning`` show of a team, by the whole number that holds it: (name, units of one, bits).
PACKED = (
    (("num_starters_with_data", 1, 5), ("top_scorer", 100, 22), ("team_total_goals", 10, 20), ("team_avg_goals_per_90", 100, 16)),
    (("team_total_assists", 10, 20), ("team_total_cards_yellow", 10, 20), ("team_total_cards_red", 10, 20)),
    (("team_avg_rating", 100, 14), ("team_avg_passes_accuracy", 100, 14), ("team_avg_tackles_per_90", 100, 16), ("team_avg_duel_win_pct", 100, 16)),
)
PACKED_TEXTS = ("coach", "formation", "positions")


def packed_profile(profile: Column) -> Column:
    """A profile for a shuffle: its rounded values as units side by side in three whole numbers, 0 for null.

    ``wide`` holds the values themselves of a profile with one that its bits don't give back exactly.
    The profile is named twice, lest Spark merge its making into the expression-by-expression part.
    """

    def pack(x: Column) -> Column:
        units = lambda name, per: F.rint(x[name].cast("double") * F.lit(float(per)))
        fits = [x[name].isNull() | (units(name, per).between(0.0, 2.0**bits - 2) & (units(name, per) / F.lit(float(per)) == x[name])) for word in PACKED for name, per, bits in word]
        words = []
        for word in PACKED:
            total = F.lit(0).cast("bigint")
            for name, per, bits in word:
                total = total * F.lit(1 << bits) + F.coalesce(units(name, per).cast("bigint") + F.lit(1), F.lit(0))
            words.append(total)
        known = F.struct(*[x[name].alias(name) for word in PACKED for name, _, _ in word])
        texts = [x[name].alias(name) for name in PACKED_TEXTS]
        return plainly(reduce(and_, fits), lambda fit: F.struct(*[F.when(fit, w).alias(f"w{i}") for i, w in enumerate(words)], F.when(~fit, known).alias("wide"), *texts))

    return F.when(profile.isNotNull(), plainly(profile, pack))


def unpacked_profile(packed: Column) -> Column:
    """The profile of ``packed_profile``."""

    def unpack(x: Column) -> Column:
        values = {}
        for i, word in enumerate(PACKED):
            at = 0
            for name, per, bits in reversed(word):
                units = F.shiftright(x[f"w{i}"], at).bitwiseAND(F.lit((1 << bits) - 1))
                at += bits
                value = F.when(units > 0, units - F.lit(1))
                values[name] = value if per == 1 else value.cast("double") / F.lit(float(per))
        own = [F.when(x["wide"].isNotNull(), x["wide"][name]).otherwise(values[name]).alias(name) for word in PACKED for name, _, _ in word]
        return F.when(x.isNotNull(), F.struct(*own, *[x[name].alias(name) for name in PACKED_TEXTS]))

    return plainly(packed, unpack)


def render_team_block(profile: Column, label: Column) -> Column:
    """The lines on a team after its label."""
    return F.concat(label, block_lines(profile))


def render_form(form: Column) -> Column:
    return F.when(F.coalesce(form, F.lit("")) == "", F.lit("No prior WC data")).otherwise(F.concat(F.lit("WC Form: "), form))


def render_h2h(h2h: Column, home: Column, away: Column) -> Column:
    t = lambda name: h2h[name].cast("string")
    met = F.concat(F.lit("H2H ("), t("matches"), F.lit(" games): "), home, F.lit(" "), t("team1_wins"), F.lit("W, "), away, F.lit(" "), t("team2_wins"), F.lit("W, "), t("draws"), F.lit("D"))
    return F.when(F.coalesce(h2h["matches"], F.lit(0)) == 0, F.lit("H2H: No prior meetings")).otherwise(met)


def team_names(anonymized: Column) -> tuple[Column, Column]:
    return F.when(anonymized, F.lit("Team A")).otherwise(F.col("home_team_name")), F.when(anonymized, F.lit("Team B")).otherwise(F.col("away_team_name"))


def render_user_message(anonymized: Column) -> Column:
    """The eleven sections of a prompt; meetings are hidden when anonymised."""
    home, away = team_names(anonymized)
    venue = F.coalesce(F.nullif(F.col("venue"), F.lit("")), F.lit("Unknown"))
    header = F.concat(F.lit("World Cup "), F.col("season").cast("string"), F.lit(" | "), F.coalesce("round", F.lit("None")), F.lit(" | "), venue)
    h2h = F.when(anonymized, F.lit("H2H: Hidden (anonymized)")).otherwise(render_h2h(F.col("h2h"), F.col("home_team_name"), F.col("away_team_name")))
    blank = F.lit("")
    return F.concat_ws(
        "\n",
        header, blank, F.concat(home, F.lit(" (Home)"), F.get("blocks", F.lit(0))), render_form(F.col("home_form")),
        blank, F.concat(away, F.lit(" (Away)"), F.get("blocks", F.lit(1))), render_form(F.col("away_form")), blank, h2h, blank, F.lit(CLOSING),
    )


def render_reasoning(anonymized: Column) -> Column:
    """Up to three of four differentials: goals by 15 %, rating by .15, top scorer by 5, passing by 3."""
    home, away = team_names(anonymized)
    z = lambda side, name: F.coalesce(F.col(f"{side}_profile")[name], F.lit(0.0))
    whole = lambda x: x.cast("bigint").cast("string")

    def pair(name: str) -> tuple[Column, Column, Column, Column]:
        h, a = z("home", name), z("away", name)
        return h, a, (h > 0) & (a > 0), F.when(h > a, home).otherwise(away)

    hg, ag, both_g, _ = pair("team_total_goals")
    more = lambda who, x, y: F.concat(who, F.lit("'s squad has higher goal output ("), whole(x), F.lit(" vs "), whole(y), F.lit(")"))
    goals = F.when(both_g & (hg > ag * F.lit(1.15)), more(home, hg, ag)).when(both_g & (ag > hg * F.lit(1.15)), more(away, ag, hg))
    hr, ar, both_r, who_r = pair("team_avg_rating")
    one = lambda x: fixed_places(x, 1)
    rating = F.when(both_r & (F.abs(hr - ar) > 0.15), F.concat(who_r, F.lit(" has a higher average rating ("), one(F.greatest(hr, ar)), F.lit(" vs "), one(F.least(hr, ar)), F.lit(")")))
    ht, at, both_t, who_t = pair("top_scorer")
    top = F.when(both_t & (F.abs(ht - at) > 5), F.concat(who_t, F.lit("'s top scorer is more prolific ("), whole(F.greatest(ht, at)), F.lit(" vs "), whole(F.least(ht, at)), F.lit(" goals)")))
    hp, ap, both_p, who_p = pair("team_avg_passes_accuracy")
    none = lambda x: whole(half_even(x))
    passing = F.when(both_p & (F.abs(hp - ap) > 3), F.concat(who_p, F.lit(" has better passing ("), none(F.greatest(hp, ap)), F.lit("% vs "), none(F.least(hp, ap)), F.lit("%)")))

    def default(result: Column) -> Column:
        winner = F.when(result == "home_win", home).otherwise(away)
        return F.when(result == "draw", F.lit("Both teams have closely matched statistical profiles suggesting an even contest")).otherwise(F.concat(winner, F.lit("'s overall squad quality and form give them the edge")))

    full = goals.isNotNull() & rating.isNotNull() & top.isNotNull()
    said = F.concat_ws(". ", goals, rating, top, F.when(~full, passing))
    return F.concat(F.coalesce(F.nullif(said, F.lit("")), plainly(F.col("result"), default)), F.lit("."))


def chat_samples(context: DataFrame, seed: int = 42) -> DataFrame:
    """Each match named and anonymised: messages and metadata, in an order that a seeded hash gives.

    Rows are put in order before they are rendered: profiles, packed, are shorter than their blocks, and these
    than their messages. A hash is even over all its range, so equal ranges of it are dealt without the sample that
    a sort by range would take, for which all contexts would be made twice; it is made again where rows arrive.
    """
    sides = ("home", "away")
    whole = {name for word in PACKED for name, _, _ in word} | set(PACKED_TEXTS) <= set(context.select("home_profile.*").columns)
    if whole:
        context = context.withColumns({f"{side}_profile": packed_profile(F.col(f"{side}_profile")) for side in sides}).drop("blocks")
    rows = context.withColumn("anonymized", F.explode(F.array(F.lit(False), F.lit(True))))
    key = F.xxhash64("fixture_id", "anonymized", F.lit(seed))
    tasks = int(context.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = F.floor((key.cast("double") / F.lit(2.0**64) + F.lit(0.5)) * F.lit(float(tasks))).cast("int")
    rows = rows.repartitionById(tasks, F.least(share, F.lit(tasks - 1))).withColumn("shuffle_key", key).sortWithinPartitions("shuffle_key")
    if whole:
        rows = rows.withColumns({f"{side}_profile": unpacked_profile(F.col(f"{side}_profile")) for side in sides})
        rows = rows.withColumn("blocks", F.array(*[block_lines(F.col(f"{side}_profile")) for side in sides]))
    hidden = F.col("anonymized")
    score = F.concat(F.col("home_goals").cast("string"), F.lit("-"), F.col("away_goals").cast("string"))
    answer = F.concat(F.lit("Prediction: "), F.col("result"), F.lit("\nScore: "), score, F.lit("\nReasoning: "), render_reasoning(hidden))
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    return rows.select(
        F.array(message("system", F.lit(SYSTEM_PROMPT)), message("user", render_user_message(hidden)), message("assistant", answer)).alias("messages"),
        F.struct("fixture_id", "season", "home_team_name", "away_team_name", "result", score.alias("score"), "anonymized").alias("metadata"),
        "shuffle_key",
    )


def halftime_prompt(user: Column, home: Column, away: Column, ht_home: Column, ht_away: Column, blank_line: bool = True) -> Column:
    """The prompt with its closing line replaced by the halftime score and a new instruction."""
    body = F.rtrim(F.replace(user, F.lit(CLOSING), F.lit("")), F.lit(" \t\n\x0b\f\r"))
    gap = "\n\n" if blank_line else "\n"
    return F.concat(
        body, F.lit("\n\nHalftime Score: "), home, F.lit(" "), ht_home.cast("string"), F.lit(" - "), ht_away.cast("string"), F.lit(" "), away,
        F.lit(f"{gap}Given the halftime state, predict the FINAL result, FINAL score, and brief reasoning."),
    )


def events_text(events: DataFrame) -> DataFrame:
    """(fixture_id, events): first-half goals and cards in order of time, joined by '; '."""
    shown = F.concat(F.col("time_elapsed").cast("string"), F.lit("' "), F.col("event_type"), F.lit(" "), F.col("player_name"))
    return events.groupBy("fixture_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("time_elapsed", "event_id", shown.alias("t")))), lambda x: x["t"]), "; ").alias("events"))


# A score wins over a label; dashes may be hyphens, en or em dashes.
SCORE = r"Score:\s*(\d+)\s*[-–—]\s*(\d+)"
LABEL = r"(?i)Prediction:\s*(.*?)(?:\n|$)"
REASON = r"(?is)Reasoning:\s*(.*)"
LOOSE_SCORES = (r"score[:\s]+.*?(\d+)\s*[-–]\s*(\d+)", r"(\d+)\s*[-–]\s*(\d+)")
LOOSE_LABEL = r"prediction[:\s]+(.*?)(?:\n|$)"


def _group(text: Column, pattern: str, index: int) -> Column:
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, index))


def parse_outputs(df: DataFrame, text: str = "output") -> DataFrame:
    """prediction, pred_home, pred_away and reasoning; nulls where the text doesn't say."""
    t = F.col(text)
    home, away = (_group(t, SCORE, i).try_cast("bigint") for i in (1, 2))
    label = F.lower(F.trim(_group(t, LABEL, 1)))
    said = F.when(label.contains("draw"), "draw").when(label.contains("home"), "home_win").when(label.contains("away"), "away_win")
    reasoning = F.regexp_replace(_group(t, REASON, 1), r"^\s+|\s+$", "")
    return df.withColumns({"parsed_home": home, "parsed_away": away, "prediction": F.coalesce(result_from_score(home, away), said), "reasoning": reasoning})


def parse_outputs_lenient(df: DataFrame, text: str = "output") -> DataFrame:
    """As above, also with bare scores, team letters and unnamed winners; ``parsed`` tells success."""
    t = F.col(text)
    home, away = (F.coalesce(*[_group(t, p, i).try_cast("bigint") for p in LOOSE_SCORES]) for i in (1, 2))
    label = F.trim(_group(F.lower(t), LOOSE_LABEL, 1))
    has = lambda *words: F.greatest(*[label.contains(w) for w in words]) if len(words) > 1 else label.contains(words[0])
    said = F.when(has("draw"), "draw").when(has("home", "team a"), "home_win").when(has("away", "team b"), "away_win").when(has("win"), "has_winner")
    result = F.coalesce(result_from_score(home, away), said)
    return df.withColumns({"parsed_home": home, "parsed_away": away, "prediction": result, "parsed": result.isNotNull()})


def split_variant(text: Column) -> Column:
    return F.when(text.contains("Team A") & text.contains("Team B"), "anonymized").otherwise("named")


#: Scalars of a team's profile that the model reads, by feature name.
TEAM_FEATURES = {
    "total_goals": "team_total_goals",
    "total_assists": "team_total_assists",
    "total_appearances": "team_total_appearances",
    "total_minutes": "team_total_minutes",
    "avg_goals_per_90": "team_avg_goals_per_90",
    "total_shots": "team_total_shots_total",
    "total_shots_on_target": "team_total_shots_on_target",
    "yellows": "team_total_cards_yellow",
    "reds": "team_total_cards_red",
    "num_starters": "num_starters_with_data",
}
FEATURE_POSITIONS = ("Attacker", "Midfielder", "Defender", "Goalkeeper")


def team_features(form: DataFrame, keys: Sequence[str] = ("fixture_id", "team_id")) -> DataFrame:
    """Ten scalars and four position counts of a team's starters with form, as doubles; missing ones are 0."""
    counts = [F.count_if(has_form() & (position_of() == p)).cast("double").alias(f"pos_{p.lower()}") for p in FEATURE_POSITIONS]
    profile = team_profile(form, keys, extra=counts)
    scalars = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(n) for n, c in TEAM_FEATURES.items()]
    return profile.select(*keys, *scalars, *[f"pos_{p.lower()}" for p in FEATURE_POSITIONS])


def match_features(matches: DataFrame, features: DataFrame, regime: str = "pregame") -> DataFrame:
    """home_, away_ and diff_ features of each match, with the halftime state in its regime."""
    names = [c for c in features.columns if c not in ("fixture_id", "team_id")]
    of = lambda side, n: F.coalesce(F.col(f"{side}_profile")[n], F.lit(0.0))
    made = {f"{side}_{n}": of(side, n) for side in ("home", "away") for n in names}
    made |= {f"diff_{n}": of("home", n) - of("away", n) for n in names}
    if regime == "halftime":
        hh, ha = (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in ("halftime_home", "halftime_away"))
        made |= {"ht_home": hh, "ht_away": ha, "ht_total": hh + ha, "ht_diff": hh - ha}
    return attach_sides(matches, features).select(*matches.columns, *[c.alias(n) for n, c in made.items()])


def decode_predictions(df: DataFrame, scores: str, home: str, away: str, labels: Sequence[str] = ("home_win", "draw", "away_win")) -> DataFrame:
    """The label of the greatest score (ties to the first), and goals clipped at 0, rounded half to even."""
    names = F.array(*[F.lit(x) for x in labels])
    best = F.array_position(F.col(scores), F.array_max(scores)).cast("int")
    goals = lambda c: half_even(F.greatest(F.col(c), F.lit(0.0))).cast("bigint")
    return df.withColumns({"pred_result": F.element_at(names, best), "pred_home": goals(home), "pred_away": goals(away)})
