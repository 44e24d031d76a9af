"""Independent DuckDB SQL for the correctness gate.

Each registered Spark query has a SQL twin here, written directly with SQL
window functions and joins over the pre-registered test tables. The CTE
prefix rebuilds the ``games`` view (orders x customer) and the long
team-game rows. Integer results are cast to the Spark types (INT/BIGINT).
"""

from __future__ import annotations

from tandem.functions.names import ROLLING_STATS, VOLATILITY_STATS

GAMES_CTES = """
n AS (SELECT count(*) AS nc FROM customer),
b AS (SELECT o_orderkey AS game_id, CAST(o_orderdate AS date) AS date, o_custkey AS h,
             (o_custkey + 1 + o_orderkey % 29) % nc AS a,
             CAST(floor(o_totalprice) AS bigint) AS p, o_orderkey AS k
      FROM orders CROSS JOIN n),
q AS (SELECT *,
  15 + p % 20 AS q1_home, 15 + CAST(floor(p/7) AS bigint) % 20 AS q2_home,
  15 + CAST(floor(p/11) AS bigint) % 20 AS q3_home, 15 + CAST(floor(p/13) AS bigint) % 20 AS q4_home,
  15 + CAST(floor(p/17) AS bigint) % 20 AS q1_away, 15 + CAST(floor(p/19) AS bigint) % 20 AS q2_away,
  15 + CAST(floor(p/23) AS bigint) % 20 AS q3_away, 15 + CAST(floor(p/29) AS bigint) % 20 AS q4_away,
  CASE WHEN k % 17 = 0 THEN 5 + k % 11 ELSE 0 END AS ot_home,
  CASE WHEN k % 17 = 0 THEN 5 + k % 7 ELSE 0 END AS ot_away
  FROM b),
games AS (
SELECT game_id, CAST(CASE WHEN month(date) >= 10 THEN year(date) + 1 ELSE year(date) END AS INTEGER) AS season, date,
  concat('t', CAST(a AS varchar(20))) AS away, concat('t', CAST(h AS varchar(20))) AS home,
  CASE WHEN k % 97 = 0 THEN NULL ELSE q1_away+q2_away+q3_away+q4_away+ot_away END AS score_away,
  CASE WHEN k % 97 = 0 THEN NULL ELSE q1_home+q2_home+q3_home+q4_home+ot_home END AS score_home,
  q1_away,q2_away,q3_away,q4_away,ot_away,q1_home,q2_home,q3_home,q4_home,ot_home,
  CASE WHEN k % 23 = 0 THEN NULL ELSE 175 + CAST(p % 81 AS double) / 2 END AS total
FROM q)"""


def _side_sql(is_home: int) -> str:
    me, ot = ("home", "away") if is_home else ("away", "home")
    cols = [f"{me} AS team", f"{ot} AS opponent", f"{is_home} AS is_home",
            f"score_{me} AS points_scored", f"score_{ot} AS points_allowed"]
    for m in ("q1", "q2", "q3", "q4", "ot"):
        cols += [f"{m}_{me} AS {m}_scored", f"{m}_{ot} AS {m}_allowed"]
    return "SELECT game_id, season, date, total, " + ", ".join(cols) + " FROM games"


LONG_CTES = f"""
long0 AS ({_side_sql(1)} UNION ALL {_side_sql(0)}),
long AS (SELECT *, points_scored + points_allowed AS total_points,
  points_scored - points_allowed AS point_diff,
  CAST(coalesce(points_scored - points_allowed > 0, false) AS INTEGER) AS win,
  CAST(coalesce(ot_scored > 0, false) AS INTEGER) AS went_to_ot,
  q1_scored + q2_scored + q3_scored + q4_scored AS reg_points_scored,
  q1_allowed + q2_allowed + q3_allowed + q4_allowed AS reg_points_allowed,
  q1_scored + q2_scored + q3_scored + q4_scored + q1_allowed + q2_allowed + q3_allowed + q4_allowed AS reg_total,
  q1_scored + q2_scored AS first_half_scored, q3_scored + q4_scored AS second_half_scored,
  q1_allowed + q2_allowed AS first_half_allowed, q3_allowed + q4_allowed AS second_half_allowed
  FROM long0)"""

TEAM_ORDER = "ORDER BY date, is_home DESC, game_id"


INCLUSIVE = {"on": False}   # frame style used by trailing()/season_before() (serving variant)


def trailing(fn: str, col: str, w: int, part: str = "team") -> str:
    frame = f"{w - 1} PRECEDING AND CURRENT ROW" if INCLUSIVE["on"] else f"{w} PRECEDING AND 1 PRECEDING"
    return f"{fn}({col}) OVER (PARTITION BY {part} {TEAM_ORDER} ROWS BETWEEN {frame})"


def season_before(fn: str, col: str) -> str:
    end = "CURRENT ROW" if INCLUSIVE["on"] else "1 PRECEDING"
    return (f"{fn}({col}) OVER (PARTITION BY team, season {TEAM_ORDER} "
            f"ROWS BETWEEN UNBOUNDED PRECEDING AND {end})")


def feature_select(windows=(3, 5, 10, 15), stats=ROLLING_STATS, std_stats=VOLATILITY_STATS,
                   rest=True, season=True, pace=True, trend=True) -> str:
    """SELECT list of the per-team features over ``long``."""
    cols = []
    for w in windows:
        for s in stats:
            cols.append(f"{trailing('avg', s, w)} AS {s}_roll_{w}")
        for s in std_stats:
            cols.append(f"{trailing('stddev_samp', s, w)} AS {s}_std_{w}")
    if pace:
        for w in windows:
            cols += [f"{trailing('avg', 'points_scored', w)} AS off_pace_{w}",
                     f"{trailing('avg', 'points_allowed', w)} AS def_pace_{w}",
                     f"{trailing('avg', 'total_points', w)} AS pace_{w}",
                     f"{trailing('avg', 'points_scored', w)} - {trailing('avg', 'points_allowed', w)} AS pace_diff_{w}"]
    if trend and 3 in windows and 10 in windows:
        for name, s in (("scoring_trend", "points_scored"), ("defense_trend", "points_allowed"),
                        ("total_trend", "total_points"), ("win_trend", "win")):
            cols.append(f"{trailing('avg', s, 3)} - {trailing('avg', s, 10)} AS {name}")
    if rest:
        rest_expr = f"coalesce(CAST(date_diff('day', lag(date) OVER (PARTITION BY team {TEAM_ORDER}), date) AS INTEGER), 3)"
        cols += [f"{rest_expr} AS days_rest",
                 f"CAST(coalesce({rest_expr} = 1, false) AS INTEGER) AS is_b2b",
                 f"CAST(coalesce({rest_expr} >= 4, false) AS INTEGER) AS long_rest"]
    if season:
        gn = f"CAST(row_number() OVER (PARTITION BY team, season {TEAM_ORDER}) AS INTEGER)"
        cols += [f"{gn} AS game_num",
                 f"{season_before('avg', 'points_scored')} AS season_ppg",
                 f"{season_before('avg', 'points_allowed')} AS season_papg",
                 f"{season_before('avg', 'total_points')} AS season_total_avg",
                 f"{season_before('avg', 'win')} AS season_win_pct",
                 f"CASE WHEN {gn} > 0 AND {gn} <= 25 THEN 'early' WHEN {gn} > 25 AND {gn} <= 55 THEN 'mid' "
                 f"WHEN {gn} > 55 AND {gn} <= 100 THEN 'late' END AS season_phase"]
    return ", ".join(cols)


def with_ctes(*extra: str) -> str:
    parts = [GAMES_CTES.strip(), LONG_CTES.strip(), *[e.strip() for e in extra]]
    return "WITH " + ",\n".join(parts) + "\n"


def side_columns(windows=(3, 5, 10, 15)) -> list[str]:
    from tandem.functions.names import side_feature_columns
    return side_feature_columns(list(windows))


FEAT_CTE = ("feat AS (SELECT game_id, is_home, team, date, season, total, points_scored, points_allowed, "
            + feature_select() + " FROM long)")


def pair_cte(cols: list[str], name: str = "pair", how: str = "event") -> str:
    """games LEFT JOIN home-side and away-side feature rows."""
    sel = ", ".join([f"h.{c} AS home_{c}" for c in cols] + [f"a.{c} AS away_{c}" for c in cols])
    if how == "event":
        on_h, on_a = "h.game_id = g.game_id AND h.is_home = 1", "a.game_id = g.game_id AND a.is_home = 0"
    else:
        on_h, on_a = "h.team = g.home AND h.date = g.date", "a.team = g.away AND a.date = g.date"
    return (f"{name} AS (SELECT g.*, {sel} FROM games g LEFT JOIN feat h ON {on_h} "
            f"LEFT JOIN feat a ON {on_a})")


def matchup_select(windows=(3, 5, 10, 15), line: str = "total", target: bool = True) -> str:
    """M1-M12 over the paired columns (``line`` may be a NULL literal)."""
    e = []
    if target:
        e += ["score_home + score_away AS actual_total",
              f"CAST(coalesce(score_home + score_away > {line}, false) AS INTEGER) AS went_over"]
    for w in windows:
        e += [f"home_points_scored_roll_{w} + away_points_scored_roll_{w} AS combined_scoring_{w}",
              f"home_points_allowed_roll_{w} + away_points_allowed_roll_{w} AS combined_defense_{w}",
              f"(home_points_scored_roll_{w} + away_points_allowed_roll_{w}) / 2 + "
              f"(away_points_scored_roll_{w} + home_points_allowed_roll_{w}) / 2 AS expected_total_{w}",
              f"(home_pace_{w} + away_pace_{w}) / 2 AS pace_matchup_{w}",
              f"(home_total_points_std_{w} + away_total_points_std_{w}) / 2 AS combined_volatility_{w}"]
    for w in windows:
        e += [f"{line} - ((home_points_scored_roll_{w} + away_points_allowed_roll_{w}) / 2 + "
              f"(away_points_scored_roll_{w} + home_points_allowed_roll_{w}) / 2) AS line_vs_expected_{w}",
              f"home_total_points_roll_{w} - {line} AS home_over_tendency_{w}",
              f"away_total_points_roll_{w} - {line} AS away_over_tendency_{w}"]
    e += ["home_days_rest + away_days_rest AS total_rest",
          "home_days_rest - away_days_rest AS rest_diff",
          "CAST(coalesce(home_days_rest >= 2 AND away_days_rest >= 2, false) AS INTEGER) AS both_rested",
          "CAST(coalesce(home_is_b2b + away_is_b2b = 2, false) AS INTEGER) AS both_b2b",
          "home_scoring_trend + away_scoring_trend AS combined_scoring_trend",
          "home_total_trend + away_total_trend AS combined_total_trend",
          "CAST(coalesce(home_game_num <= 25, false) AS INTEGER) AS home_early_season",
          "CAST(coalesce(away_game_num <= 25, false) AS INTEGER) AS away_early_season"]
    return ", ".join(e)


GAME_COLUMNS = ["game_id", "season", "date", "away", "home", "score_away", "score_home",
                "q1_away", "q2_away", "q3_away", "q4_away", "ot_away",
                "q1_home", "q2_home", "q3_home", "q4_home", "ot_home", "total"]


def processed_ctes(how: str = "event", sparse: bool = True) -> list[str]:
    """CTEs ending in ``processed``: D6 over the games view (with P7)."""
    cols = side_columns()
    wide = GAME_COLUMNS + [f"home_{c}" for c in cols] + [f"away_{c}" for c in cols]
    from tandem.functions.names import matchup_feature_columns
    wide += ["actual_total", "went_over"] + matchup_feature_columns()
    thresh = -(-len(wide) // 2)
    nn = " + ".join(f"CASE WHEN {c} IS NULL THEN 0 ELSE 1 END" for c in wide)
    ctes = [FEAT_CTE, pair_cte(cols, how=how),
            f"mu AS (SELECT *, {matchup_select()} FROM pair)"]
    if sparse:
        ctes.append(f"processed AS (SELECT * FROM mu WHERE ({nn}) >= {thresh})")
    else:
        ctes.append("processed AS (SELECT * FROM mu)")
    return ctes


def is_noisy(col: str) -> bool:
    """Columns derived from a standard deviation: engines differ in the last
    bits, so both sides round them to 6 decimals in query output."""
    return "_std_" in col or "volatility" in col


def project(cols: list[str], src: str) -> str:
    sel = ", ".join(f"round({c}, 6) AS {c}" if is_noisy(c) else c for c in cols)
    return f"SELECT {sel} FROM {src}"
