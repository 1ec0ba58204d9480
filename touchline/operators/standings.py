"""League tables with competition-specific tie-breaks, for all seasons at once.

Results are folded once into head-to-head sums per ordered pair of teams (at
most teams^2 rows a season).  Overall figures and every mini-table are sums over
those pairs, so no tie-break rule reads the results again.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.session import cut

# Points, and each competition's order of rules with the sentence
# that explains it.  h2h_* rules look only at matches among the tied teams.
WIN, DRAW = 3, 1


@dataclass(frozen=True)
class TieBreak:
    rules: tuple[str, ...]
    explanation: str


TIE_BREAKS = {
    "PL": TieBreak(("goal_difference", "goals_for", "h2h_points"),
                   "The Premier League separates level teams on goal difference, then goals scored, then head-to-head record."),
    "LIGA": TieBreak(("h2h_points", "h2h_goal_difference", "goal_difference", "goals_for"),
                     "La Liga separates level teams on head-to-head record first, before overall goal difference."),
    "SERIE_A": TieBreak(("h2h_points", "goal_difference", "goals_for"),
                        "Serie A separates level teams on head-to-head record, then goal difference, then goals scored."),
    "BUNDESLIGA": TieBreak(("goal_difference", "goals_for", "h2h_points"),
                           "The Bundesliga separates level teams on goal difference, then goals scored, then head-to-head record."),
    "LIGUE_1": TieBreak(("goal_difference", "goals_for"),
                        "Ligue 1 separates level teams on goal difference, then goals scored."),
    "UCL_GROUP": TieBreak(("h2h_points", "h2h_goal_difference", "h2h_away_goals", "goal_difference", "goals_for", "away_goals"),
                          "Champions League groups separate level teams on head-to-head points, head-to-head goal difference "
                          "and head-to-head away goals before overall figures."),
    "FIFA_GROUP": TieBreak(("goal_difference", "goals_for", "h2h_points", "h2h_goal_difference", "h2h_goals_for"),
                           "World Cup groups separate level teams on goal difference and goals scored across all "
                           "group games first, and only then on head-to-head results."),
    "UEFA_EURO_GROUP": TieBreak(("h2h_points", "h2h_goal_difference", "h2h_goals_for", "goal_difference", "goals_for"),
                                "European Championship groups separate level teams on their head-to-head results first, "
                                "before overall goal difference."),
}
DEFAULT_RULE = "PL"
# Competition id -> rule set.
LEAGUE_RULES = {2: "PL", 11: "LIGA", 12: "SERIE_A", 9: "BUNDESLIGA", 7: "LIGUE_1", 37: "PL", 49: "PL", 44: "PL", 81: "PL",
                1238: "PL", 116: "PL", 182: "LIGA", 135: "BUNDESLIGA", 131: "SERIE_A"}
GROUP_RULES = {55: "UEFA_EURO_GROUP", 53: "UEFA_EURO_GROUP"}
DEFAULT_GROUP_RULE = "FIFA_GROUP"
MIN_LEAGUE_COVERAGE = 0.9

SUMS = ("played", "won", "drawn", "lost", "goals_for", "goals_against", "away_goals")


def by_team(results: DataFrame) -> DataFrame:
    """Two rows per result, one from each side, in a single pass."""
    h, a = F.col("home_goals"), F.col("away_goals")

    def side(team: str, opp: str, gf: Column, ga: Column, away: bool) -> Column:
        return F.struct(F.col(team).alias("team_id"), F.col(opp).alias("opponent_id"), gf.alias("goals_for"), ga.alias("goals_against"),
                        (gf if away else F.lit(0)).alias("away_goals"), F.lit("away" if away else "home").alias("side"))

    rest = [c for c in results.columns if c not in ("home_id", "away_id", "home_goals", "away_goals")]
    return results.select(*rest, F.inline(F.array(side("home_id", "away_id", h, a, False), side("away_id", "home_id", a, h, True))))


def head_to_head(results: DataFrame, by: Sequence[str]) -> DataFrame:
    """Record of every team against every opponent within `by`."""
    gf, ga = F.col("goals_for"), F.col("goals_against")
    one = lambda cond: F.sum(F.when(cond, 1).otherwise(0))
    return by_team(results.select(*by, "home_id", "away_id", "home_goals", "away_goals")).groupBy(*by, "team_id", "opponent_id").agg(
        F.count(F.lit(1)).alias("played"), one(gf > ga).alias("won"), one(gf == ga).alias("drawn"), one(gf < ga).alias("lost"),
        F.sum(gf).alias("goals_for"), F.sum(ga).alias("goals_against"), F.sum("away_goals").alias("away_goals"))


def league_rows(h2h: DataFrame, by: Sequence[str]) -> DataFrame:
    """Played, won, drawn, lost, goals, difference and points per team."""
    rows = h2h.groupBy(*by, "team_id").agg(*[F.sum(c).alias(c) for c in SUMS])
    return rows.withColumns({"goal_difference": F.col("goals_for") - F.col("goals_against"),
                             "points": F.col("won") * WIN + F.col("drawn") * DRAW})


#: mini-table rule -> what is summed over matches among the tied teams
_MINI = {
    "h2h_points": lambda: F.col("won") * WIN + F.col("drawn") * DRAW,
    "h2h_goal_difference": lambda: F.col("goals_for") - F.col("goals_against"),
    "h2h_away_goals": lambda: F.col("away_goals"),
    "h2h_goals_for": lambda: F.col("goals_for"),
}


def _by_rule(step: dict[str, str], expr) -> Column:
    """A column picked by each row's rule set; 0 where the set has no such step."""
    out = F.lit(0).cast("long")
    for rule_set, rule in step.items():
        out = F.when(F.col("rule_set") == rule_set, expr(rule).cast("long")).otherwise(out)
    return out


def _mini_scores(h2h: DataFrame, state: DataFrame, by: list[str], scores: list[str], step: dict[str, str]) -> DataFrame:
    """Scores within each group of teams level on everything so far."""
    level = state.select(*by, "team_id", "rule_set", F.struct(*scores).alias("level"))
    mine = h2h.join(level, [*by, "team_id"]).select(*by, "team_id", "opponent_id", "level", _by_rule(step, lambda r: _MINI[r]()).alias("v"))
    theirs = level.drop("rule_set").withColumnRenamed("team_id", "opponent_id")
    return mine.join(theirs, [*by, "opponent_id", "level"]).groupBy(*by, "team_id").agg(F.sum("v").alias("v"))


def rank(h2h: DataFrame, by: Sequence[str], rule_set: Column, rule_ids: Sequence[str]) -> DataFrame:
    """Order every group of `by` under the rule set named by its row.

    Step i scores the i-th rule of every set at once, among the teams still
    level after the steps before, so a mini-table shrinks with its group.  Teams
    level after the last step are ordered by id and marked unresolved.
    """
    by = list(by)
    state, scores = league_rows(h2h, by).withColumn("rule_set", rule_set), ["points"]
    lists = {r: TIE_BREAKS[r].rules for r in rule_ids}
    for i in range(max(len(v) for v in lists.values())):
        step = {r: v[i] for r, v in lists.items() if len(v) > i}
        mini = {r: x for r, x in step.items() if x in _MINI}
        plain = {r: x for r, x in step.items() if x not in _MINI}
        score = _by_rule(plain, F.col)
        if mini:
            m = _mini_scores(h2h, state, by, scores, mini).withColumnRenamed("v", "__mini")
            state = state.join(m, [*by, "team_id"], "left")
            score = score + F.coalesce("__mini", F.lit(0))
        state = state.withColumn(f"__s{i}", score).drop("__mini")
        scores.append(f"__s{i}")
        if mini and any(x in _MINI for v in lists.values() for x in v[i + 1:]):
            state = cut(state, "table")  # each mini-table reads it three times
    order = Window.partitionBy(*by).orderBy(*[F.col(s).desc() for s in scores], F.col("team_id"))
    level = Window.partitionBy(*by, *scores)
    return state.select(
        *by, F.row_number().over(order).alias("position"), "team_id", *SUMS[:6], "goal_difference", "points",
        (F.count(F.lit(1)).over(level) > 1).alias("unresolved"), F.col("rule_set").alias("rule_id"))


def standings(results: DataFrame, by: Sequence[str], rule_id: str = DEFAULT_RULE) -> DataFrame:
    """Final order in every group of `by` under one rule set; an unknown set
    falls back to the default."""
    used = rule_id if rule_id in TIE_BREAKS else DEFAULT_RULE
    return rank(cut(head_to_head(results, by), "head-to-head"), by, F.lit(used), [used])


def explanations(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([(k, v.explanation) for k, v in TIE_BREAKS.items()], "rule_id string, explanation string")


def components(results: DataFrame, by: Sequence[str]) -> DataFrame:
    """Connected components of the fixture graph: label = least team id reached.

    Labels spread to neighbours and then to the label's own label, so the rounds
    grow with the logarithm of the longest chain.  Each round is written to the
    shared folder; only one count comes back to decide when to stop.
    """
    by = list(by)
    pair = F.explode(F.array(F.struct(F.col("home_id").alias("team_id"), F.col("away_id").alias("n")),
                             F.struct(F.col("away_id").alias("team_id"), F.col("home_id").alias("n"))))
    edges = cut(results.select(*by, pair.alias("e")).select(*by, "e.*").distinct(), "edges")
    labels = cut(edges.groupBy(*by, "team_id").agg(F.least(F.min("n"), F.min("team_id")).alias("label")), "labels")
    while True:
        near = edges.join(labels.withColumnRenamed("team_id", "n"), [*by, "n"]).groupBy(*by, "team_id").agg(F.min("label").alias("near"))
        own = labels.join(near, [*by, "team_id"], "left").select(*by, "team_id", F.col("label").alias("old"),
                                                                F.least("label", "near").alias("label"))
        jump = labels.select(*by, F.col("team_id").alias("label"), F.col("label").alias("far"))
        new = cut(own.join(jump, [*by, "label"], "left").select(*by, "team_id", "old", F.least("label", "far").alias("label")), "labels")
        changed = new.filter(F.col("old") != F.col("label")).count()
        labels = new.drop("old")
        if not changed:
            return labels


def groups(results: DataFrame, by: Sequence[str]) -> DataFrame:
    """Group of each team, numbered by first kick-off, then least team id."""
    by = list(by)
    labels = components(results, by)
    first = results.select(*by, F.col("home_id").alias("team_id"), "kickoff").groupBy(*by, "team_id").agg(F.min("kickoff").alias("kickoff"))
    start = labels.join(first, [*by, "team_id"], "left").groupBy(*by, "label").agg(F.min("kickoff").alias("kickoff"))
    num = start.select(*by, "label", F.row_number().over(Window.partitionBy(*by).orderBy("kickoff", "label")).alias("group_no"))
    return labels.join(num, [*by, "label"]).select(*by, "team_id", "group_no")


def _rule_column(mapping: dict[int, str], default: str | None) -> Column:
    out = F.lit(default)
    for k, v in mapping.items():
        out = F.when(F.col("competition_id") == k, F.lit(v)).otherwise(out)
    return out


SEASON = ["competition_id", "season_id"]
# The sentences shown with, or instead of, a table.
NOTE_GROUPS = ("StatsBomb does not record group letters, so groups are recovered from who played "
               "whom and numbered in the order they kicked off.")
NOTE_KNOCKOUT = "This is a knockout competition, so there is no table - every match here is a tie."


def season_facts(cards: DataFrame) -> DataFrame:
    """Per season: matches held, different pairings, matches of a full league, groups, rule set.

    `cards`: competition_id, season_id, international, stage, kickoff, home_id,
    away_id, home_goals, away_goals.
    """
    grp = F.col("stage") == "Group Stage"
    pairs = cards.dropna(subset=SEASON).groupBy(*SEASON, "home_id", "away_id").agg(
        F.count(F.lit(1)).alias("n"), F.bool_or(grp).alias("has_groups"), F.bool_or("international").alias("international"))
    # one pass: a season's pairings, then its teams, those at home with the figures
    side = F.explode(F.array(F.struct(F.col("home_id").alias("team_id"), F.col("n"), F.lit(1).alias("one")),
                             F.struct(F.col("away_id").alias("team_id"), F.lit(0).cast("long").alias("n"), F.lit(0).alias("one"))))
    teams = pairs.select(*SEASON, "has_groups", "international", side.alias("s")).groupBy(*SEASON, "s.team_id").agg(
        F.sum("s.n").alias("n"), F.sum("s.one").alias("pairings"), F.bool_or("has_groups").alias("has_groups"), F.bool_or("international").alias("international"))
    facts = teams.groupBy(*SEASON).agg(F.sum("n").alias("matches"), F.bool_or("has_groups").alias("has_groups"), F.bool_or("international").alias("international"),
                                       F.count(F.lit(1)).alias("teams"), F.sum("pairings").alias("pairings"))
    rule = F.when(F.col("has_groups"), _rule_column(GROUP_RULES, DEFAULT_GROUP_RULE)).when(
        ~F.col("international"), _rule_column(LEAGUE_RULES, None))
    expected = F.col("teams") * (F.col("teams") - 1)
    covered = F.coalesce(F.try_divide(F.col("matches"), expected), F.lit(0.0)) >= MIN_LEAGUE_COVERAGE
    return facts.withColumns({"expected": expected, "rule_set": rule, "covered": covered})


def season_notes(facts: DataFrame) -> DataFrame:
    """What is said about each season's table, or about its absence."""
    partial = F.concat(F.lit("The open data holds "), F.col("matches").cast("string"), F.lit(" of this season's "), F.col("expected").cast("string"),
                       F.lit(" league matches - mostly one club's fixtures. A table built from them would be wrong, so none is shown."))
    note = (F.when(F.col("has_groups"), NOTE_GROUPS).when(F.col("rule_set").isNull(), NOTE_KNOCKOUT)
            .when(~F.col("covered"), partial).otherwise(""))
    return facts.select(*SEASON, "matches", note.alias("note"))


def season_tables(cards: DataFrame, facts: DataFrame) -> DataFrame:
    """Tables only where they are honest: groups, or a (nearly) full league.

    A pairing held many times does not stand for those that are missing.
    """
    facts = cut(facts, "seasons")
    full = F.col("covered") & (F.col("pairings") >= F.col("expected") * MIN_LEAGUE_COVERAGE)
    shown = facts.filter(F.col("has_groups") | (F.col("rule_set").isNotNull() & full)).select(*SEASON, "rule_set", "has_groups")
    used = cards.join(shown, SEASON).filter(~F.col("has_groups") | (F.col("stage") == "Group Stage"))
    team_group = groups(used.filter("has_groups"), SEASON).withColumnRenamed("team_id", "home_id")
    used = used.join(team_group, [*SEASON, "home_id"], "left").withColumn("group_no", F.coalesce("group_no", F.lit(0)))
    by = [*SEASON, "group_no"]
    h2h = cut(head_to_head(used, by), "head-to-head")
    rule = F.when(F.col("group_no") > 0, _rule_column(GROUP_RULES, DEFAULT_GROUP_RULE)).otherwise(_rule_column(LEAGUE_RULES, DEFAULT_RULE))
    tables = rank(h2h, by, rule, sorted({*LEAGUE_RULES.values(), *GROUP_RULES.values(), DEFAULT_GROUP_RULE}))
    teams = F.count(F.lit(1))
    want = (teams * (teams - 1) / 2).cast("long")
    held = (F.sum("played") / 2).cast("long")
    short = F.concat(held.cast("string"), F.lit(" of "), want.cast("string"), F.lit(" group matches are in the archive."))
    notes = h2h.groupBy(*by, "team_id").agg(F.sum("played").alias("played")).groupBy(*by).agg(
        F.when((F.col("group_no") > 0) & (held < want), short).otherwise("").alias("note"))
    label = F.when(F.col("group_no") > 0, F.concat(F.lit("Group "), F.col("group_no").cast("string"))).otherwise("League")
    return tables.join(notes, by).withColumn("table", label).drop("group_no")
