"""Domain relations derived from the given tables, in SQL that both engines read alike.

Placeholders in braces name the tables and views that a view reads.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: Counts that are summed over a player's season, and rates that are averaged.
SUMS = [
    "appearances", "lineups", "minutes", "goals", "assists", "shots_total", "shots_on_target", "passes_total", "passes_key", "tackles_total", "tackles_blocks",
    "tackles_interceptions", "duels_total", "duels_won", "dribbles_attempts", "dribbles_success", "fouls_drawn", "fouls_committed", "cards_yellow", "cards_red", "goals_conceded",
    "saves", "penalty_saved",
]
MEANS = ["rating", "passes_accuracy"]

_STATS = ",\n".join(
    f"CAST(CASE WHEN (l_partkey + l_linenumber + {i}) % 9 = 0 THEN NULL ELSE (l_partkey * {i + 3} + l_orderkey) % {5 + 3 * i} END AS DOUBLE) AS {c}"
    for i, c in enumerate(SUMS)
    if c not in ("goals", "minutes")
)

VIEWS = {
    "matches": """
SELECT o.o_orderkey AS fixture_id, o.o_orderdate AS ts, CAST(year(o.o_orderdate) AS INT) AS season,
  o.o_custkey % 25 AS home_team_id, (o.o_custkey % 25 + 1 + o.o_orderkey % 24) % 25 AS away_team_id,
  h.n_name AS home_team_name, a.n_name AS away_team_name,
  CAST(floor(o.o_orderkey / 7) AS BIGINT) % 5 AS home_goals, CAST(floor(o.o_custkey / 5) AS BIGINT) % 4 AS away_goals,
  CASE WHEN o.o_orderkey % 17 = 0 THEN NULL ELSE CAST(floor(o.o_orderkey / 14) AS BIGINT) % 3 END AS halftime_home,
  CASE WHEN o.o_orderkey % 17 = 0 THEN NULL ELSE CAST(floor(o.o_custkey / 10) AS BIGINT) % 2 END AS halftime_away,
  CASE WHEN o.o_orderkey % 4 = 0 THEN 'Knockout' WHEN o.o_orderkey % 41 = 0 THEN NULL ELSE concat('Group Stage - ', CAST(o.o_orderkey % 3 + 1 AS STRING)) END AS round,
  CASE WHEN o.o_orderkey % 13 = 0 THEN NULL ELSE o.o_orderkey % 11 = 0 END AS went_to_extra_time,
  CASE WHEN o.o_orderkey % 13 = 1 THEN NULL ELSE o.o_orderkey % 22 = 0 END AS went_to_penalties,
  CASE WHEN o.o_orderkey % 19 = 0 THEN NULL ELSE o.o_orderpriority END AS venue
FROM {orders} o JOIN {nation} h ON o.o_custkey % 25 = h.n_nationkey JOIN {nation} a ON (o.o_custkey % 25 + 1 + o.o_orderkey % 24) % 25 = a.n_nationkey
""",
    "lineups": """
SELECT g.fixture_id, g.player_id, g.number, m.season,
  CASE WHEN g.number % 2 = 1 THEN m.home_team_id ELSE m.away_team_id END AS team_id,
  CASE WHEN g.number % 2 = 1 THEN m.home_team_name ELSE m.away_team_name END AS team_name,
  g.number <= 5 AS is_starter, g.number > 5 AS is_substitute,
  CASE WHEN (g.fixture_id + g.player_id) % 3 = 0 THEN NULL
       WHEN g.player_id % 5 = 0 THEN 'Goalkeeper' WHEN g.player_id % 5 = 1 THEN 'Defender' WHEN g.player_id % 5 = 2 THEN 'Midfielder' WHEN g.player_id % 5 = 3 THEN 'Attacker' ELSE 'Winger' END AS position,
  concat('Coach ', CAST(g.fixture_id % 7 AS STRING)) AS coach, CASE WHEN g.fixture_id % 5 = 0 THEN NULL ELSE '4-3-3' END AS formation
FROM (SELECT l_orderkey AS fixture_id, l_suppkey AS player_id, CAST(min(l_linenumber) AS BIGINT) AS number FROM {lineitem} GROUP BY l_orderkey, l_suppkey) g
JOIN {matches} m ON g.fixture_id = m.fixture_id
""",
    "player_season_raw": f"""
SELECT l_suppkey AS player_id, concat('Player ', CAST(l_suppkey AS STRING)) AS player_name, CAST(year(l_shipdate) AS INT) AS season, l_partkey % 25 AS team_id,
  CASE WHEN l_linenumber = 7 THEN NULL ELSE CAST(l_linenumber AS BIGINT) END AS league_id,
  CASE WHEN l_returnflag = 'N' THEN 'career' ELSE 'current' END AS source, l_orderkey AS batch_id, l_partkey AS row_no,
  CASE WHEN l_suppkey % 6 = 0 THEN NULL ELSE concat('Country ', CAST(l_suppkey % 11 AS STRING)) END AS nationality,
  CASE WHEN l_partkey % 4 = 0 THEN NULL WHEN l_suppkey % 4 = 0 THEN 'Goalkeeper' WHEN l_suppkey % 4 = 1 THEN 'Defender' WHEN l_suppkey % 4 = 2 THEN 'Midfielder' ELSE 'Attacker' END AS position,
  CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE CAST(150 + l_suppkey % 60 AS DOUBLE) END AS height_cm,
  CAST(l_quantity AS DOUBLE) AS goals, CAST(floor(l_extendedprice / 100) AS DOUBLE) AS minutes,
  CASE WHEN l_linenumber = 6 THEN NULL ELSE CAST(floor(l_discount * 100 + 0.5) AS DOUBLE) END AS rating,
  CASE WHEN l_linenumber = 5 THEN NULL ELSE CAST(l_partkey % 50 + 50 AS DOUBLE) END AS passes_accuracy,
{_STATS}
FROM {{lineitem}}
""",
    "player_season": "SELECT player_id, season, max(player_name) AS player_name, max(nationality) AS nationality, max(position) AS position, "
    + ", ".join(f"sum({c}) AS {c}" for c in SUMS)
    + ", "
    + ", ".join(f"avg({c}) AS {c}" for c in MEANS)
    + " FROM {player_season_raw} GROUP BY player_id, season",
    "match_events": """
SELECT event_id, user_id AS fixture_id, event_id % 125 - 2 AS time_elapsed, CASE WHEN event_id % 4 = 0 THEN event_id % 5 ELSE NULL END AS time_extra,
  concat('Player ', CAST(event_id % 97 AS STRING)) AS player_name, concat('Team ', CAST(event_id % 2 AS STRING)) AS team_name,
  CASE event_type WHEN 'purchase' THEN 'Goal' WHEN 'error' THEN 'Card' WHEN 'view' THEN 'Substitution' ELSE 'Other' END AS event_type
FROM {events}
""",
    "predictions": """
SELECT m.fixture_id, m.home_team_name, m.away_team_name, r.regime, v.anonymized, m.home_goals AS gt_home, m.away_goals AS gt_away,
  CASE WHEN m.home_goals > m.away_goals THEN 'home_win' WHEN m.home_goals < m.away_goals THEN 'away_win' ELSE 'draw' END AS gt_result,
  CASE WHEN (m.fixture_id + r.k) % 29 = 0 THEN 'draw' WHEN (m.fixture_id + o.o_custkey * r.k + v.a) % 4 > (o.o_custkey + m.fixture_id * r.k) % 3 THEN 'home_win'
       WHEN (m.fixture_id + o.o_custkey * r.k + v.a) % 4 < (o.o_custkey + m.fixture_id * r.k) % 3 THEN 'away_win' ELSE 'draw' END AS pred_result,
  (m.fixture_id + o.o_custkey * r.k + v.a) % 4 AS pred_home, (o.o_custkey + m.fixture_id * r.k) % 3 AS pred_away
FROM {matches} m JOIN {orders} o ON m.fixture_id = o.o_orderkey
CROSS JOIN (SELECT 'pregame' AS regime, 1 AS k UNION ALL SELECT 'halftime' AS regime, 2 AS k) r
CROSS JOIN (SELECT false AS anonymized, 0 AS a UNION ALL SELECT true AS anonymized, 1 AS a) v
""",
    "outputs": """
SELECT fixture_id, regime, anonymized, gt_home, gt_away, gt_result, pred_home, pred_away,
  CASE WHEN (fixture_id + CAST(anonymized AS INT)) % 7 = 0 THEN concat('I think team a will win, maybe ', CAST(pred_home AS STRING), ' goals')
       WHEN fixture_id % 5 = 0 THEN concat('prediction: Home Win\nscore: ', CAST(pred_home AS STRING), '–', CAST(pred_away AS STRING), '\nReasoning: form.\nMore form.')
       WHEN fixture_id % 11 = 0 THEN concat('Result: ', pred_result, '\n', CAST(pred_home AS STRING), '-', CAST(pred_away AS STRING))
       ELSE concat('Prediction: ', pred_result, '\nScore: ', CAST(pred_home AS STRING), '-', CAST(pred_away AS STRING), '\nReasoning: squad quality.') END AS output
FROM {predictions}
""",
    "fills": """
SELECT event_id, user_id % 5 AS symbol, CASE WHEN event_type = 'error' THEN 'SELL' ELSE 'BUY' END AS taker_side,
  CAST(floor(value * 100) AS DOUBLE) / 100 AS price, event_id % 50 + 10 AS quantity, ts, event_id * 1000000 AS time_ns
FROM {events} WHERE event_type IN ('purchase', 'click', 'error')
""",
    "order_events": """
SELECT event_id, concat('o', CAST(CASE WHEN event_type = 'error' THEN event_id - 7 ELSE event_id END AS STRING)) AS order_id,
  CASE event_type WHEN 'error' THEN 'CANCEL' WHEN 'click' THEN 'AMEND' ELSE 'NEW' END AS action,
  CASE WHEN event_type = 'signup' THEN CASE WHEN event_id % 3 = 0 THEN 'bid' ELSE 'BUY' END WHEN event_type = 'view' THEN 'SELL' WHEN event_id % 23 = 0 THEN 'HOLD' ELSE 'BUY' END AS side,
  CASE WHEN event_id % 37 = 0 THEN 0.0 ELSE CAST(floor(value) AS DOUBLE) + 1 END AS price,
  CASE WHEN event_id % 41 = 0 THEN 0 ELSE event_id % 50 + 10 END AS quantity, event_id % 5 AS symbol, event_id * 1000000 AS time_ns
FROM {events}
""",
    "squads": "SELECT s_suppkey AS player_id, s_name AS player_name, CAST(s_nationkey AS BIGINT) AS team_id, 18 + s_suppkey % 20 AS age, CASE WHEN s_suppkey % 9 = 0 THEN NULL ELSE s_suppkey % 23 + 1 END AS number FROM {supplier}",
    "teams": "SELECT CAST(n_nationkey AS BIGINT) AS team_id, n_name AS team_name, CAST(n_regionkey AS BIGINT) AS region_id, n_regionkey = 1 AS is_host FROM {nation}",
}


def _pick(of: str, *names: str | None) -> str:
    """A CASE that takes the names in turn by a number."""
    return f"CASE ({of}) % {len(names)} " + " ".join(f"WHEN {i} THEN " + ("NULL" if n is None else f"'{n}'") for i, n in enumerate(names)) + " END"


_SEVENTH, _OTHER = "CAST(floor(event_id / 7) AS BIGINT)", "CAST(floor(event_id / 5) AS BIGINT)"
VIEWS["plays"] = f"""
SELECT event_id, user_id AS match_id, concat('T', CAST(event_id % 2 AS STRING)) AS team, CASE WHEN event_id % 10 = 0 THEN NULL ELSE concat('T', CAST({_OTHER} % 2 AS STRING)) END AS possession_team,
  {_SEVENTH} AS possession, {_pick('event_id', 'Shot', 'Pass', 'Pass', 'Duel', 'Goal Keeper', 'Foul Committed', 'Bad Behaviour', 'Foul Won', 'Clearance', 'Interception', 'Block', 'Ball Recovery', 'Pressure', 'Dribble', 'Dispossessed', 'Miscontrol', 'Substitution', '50/50', 'Pass', 'Shot', 'Duel')} AS type,
  {_pick(_SEVENTH, 'Goal', 'Saved', 'Off T', 'Blocked', 'Won', 'Complete', 'Pass Offside', 'Success In Play', None, None, 'Post')} AS outcome,
  {_pick(_OTHER, 'Open Play', 'Free Kick', 'Penalty', 'Corner', 'Goal Kick', 'Throw-in', 'Kick Off', 'Tackle', 'Aerial Lost', 'Shot Saved', 'Punch', 'Collected', 'Keeper Sweeper', 'Handball', None)} AS subtype,
  {_pick(_SEVENTH, 'Right Foot', 'Left Foot', 'Head', None)} AS body_part, {_pick(_OTHER, 'Ground Pass', 'Low Pass', 'High Pass', None)} AS height, {_pick(_SEVENTH, 'Through Ball', None, None)} AS technique,
  CASE WHEN event_id % 8 = 0 THEN NULL ELSE CAST(event_id % 60 AS DOUBLE) END AS length, event_id % 9 = 1 AS is_cross, {_pick(_SEVENTH, 'Yellow Card', 'Red Card', 'Second Yellow', None)} AS card,
  CAST(event_id % 64 AS DOUBLE) / 64 AS xg
FROM {{events}}
"""


def parents(text: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", text)))


class Views:
    """Tables and views of one folder as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._made: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in TABLES and name not in VIEWS:
            raise AttributeError(name)
        if name not in self._made:
            if name in TABLES:
                self._made[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            else:
                text = VIEWS[name]
                self._made[name] = self.spark.sql(text, **{p: getattr(self, p) for p in parents(text)})
        return self._made[name]


def with_views(body: str) -> str:
    """The SQL with the views that it names put before it."""
    order: list[str] = []

    def need(name: str) -> None:
        if name in VIEWS and name not in order:
            for p in parents(VIEWS[name]):
                need(p)
            order.append(name)

    for word in dict.fromkeys(re.findall(r"\w+", body)):
        need(word)
    if not order:
        return body
    ctes = ",\n".join(f"{n} AS ({re.sub(r'\{(\w+)\}', r'\1', VIEWS[n]).strip()})" for n in order)
    rest = body.strip()
    return f"WITH {ctes}\n" + (f", {rest[5:]}" if rest[:5].upper() == "WITH " else rest)
