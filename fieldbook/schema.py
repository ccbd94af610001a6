"""Column types of the domain tables; readers never infer a schema."""

from __future__ import annotations

from pyspark.sql.types import StructType

_TABLES = {
    "teams": "team_id long, sport_code string, external_id string, abbreviation string, name string, city string",
    "players": "player_id long, sport_code string, external_id string, full_name string, position string, handedness string, current_team_id long, active boolean",
    "games": "game_id long, sport_code string, external_id string, game_date date, game_datetime timestamp, season string, season_type string, home_team_id long, away_team_id long, home_score int, away_score int, status string, context string",
    "player_games": "player_game_id long, player_id long, game_id long, team_id long, opponent_id long, is_home boolean, started boolean, did_play boolean, minutes_played double, stats string, derived string",
    "prop_lines": "line_id long, sportsbook string, sport_code string, player_id long, game_id long, stat_type string, line_value double, over_payout double, under_payout double, line_variant string, snapshot_at timestamp",
    "market_odds": "game_id long, player_id long, stat_type string, line_value double, over_price int, under_price int, market_over_prob double, bookmaker string, snapshot_time timestamp",
    "predictions": "prediction_id long, player_id long, game_id long, stat_type string, predicted_mean double, predicted_at timestamp",
    "picks": "pick_id long, sport_code string, player_id long, game_id long, stat_type string, line_id long, direction string, model_prob double, model_prob_raw double, market_prob double, market_prob_close double, edge double, line_open double, line_close double, actual_value double, leg_result string, picked_at timestamp, settled_at timestamp",
    "player_injuries": "player_name string, team_name string, sport_code string, status string, fetched_at timestamp",
    "game_weather": "game_id long, temp_f double, wind_mph double, wind_dir double, wind_out_mph double, is_dome boolean",
}
TABLES = tuple(_TABLES)


def schema(table: str) -> StructType:
    return StructType.fromDDL(_TABLES[table])
