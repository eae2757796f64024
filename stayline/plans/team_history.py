"""Co-driver history of a period, from legs to the table others read."""

from datetime import date

from pyspark.sql import DataFrame

from stayline.operators import teaming
from stayline.sources import tables


def legs_on_one_clock(legs: DataFrame, city: DataFrame, first_day: date, last_day: date) -> DataFrame:
    return teaming.shift_legs(teaming.clean_legs(legs, first_day, last_day), city)


def history(
    legs: DataFrame, city: DataFrame, first_day: date, last_day: date, mode: str = "as_written"
) -> DataFrame:
    on_clock = legs_on_one_clock(legs, city, first_day, last_day)
    return teaming.team_history(teaming.pair_legs(on_clock, mode))


def save(teams: DataFrame, table: str, append: bool = False) -> None:
    """Store the history as a table; new unless append is asked for."""
    (tables.append_table if append else tables.create_table)(teams, table)
