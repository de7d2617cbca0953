"""Public holidays by rule, as data: fixed dates and days from Easter for each region."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession

from ..errors import UtilError

#: (month, day), or days after Easter Sunday.
_WEST = [(1, 1), (12, 25)]
_GERMANY = [*_WEST, (5, 1), (10, 3), (12, 26), -2, 1, 39, 50]
RULES: dict[tuple[str, str], list] = {
    ("europe", "Germany"): _GERMANY,
    ("europe", "BadenWurttemberg"): [*_GERMANY, (1, 6), (11, 1), 60],
    ("europe", "Bavaria"): [*_GERMANY, (1, 6), (8, 15), (11, 1), 60],
    ("europe", "Austria"): [*_WEST, (1, 6), (5, 1), (8, 15), (10, 26), (11, 1), (12, 8), (12, 26), 1, 39, 50, 60],
    ("europe", "France"): [*_WEST, (5, 1), (5, 8), (7, 14), (8, 15), (11, 1), (11, 11), 1, 39, 50],
    ("europe", "Spain"): [*_WEST, (1, 6), (5, 1), (8, 15), (10, 12), (11, 1), (12, 6), (12, 8), -2],
    ("europe", "Italy"): [*_WEST, (1, 6), (4, 25), (5, 1), (6, 2), (8, 15), (11, 1), (12, 8), (12, 26), 0, 1],
    ("usa", "UnitedStates"): [*_WEST, (7, 4), (11, 11), "MLK", "Presidents", "Memorial", "Labor", "Columbus", "Thanksgiving"],
    ("usa", "Alabama"): [*_WEST, (7, 4), (11, 11), "MLK", "Presidents", "Memorial", "Labor", "Columbus", "Thanksgiving"],
}
#: (month, weekday with Monday 0, which one; -1 the last)
_NTH = {"MLK": (1, 0, 3), "Presidents": (2, 0, 3), "Memorial": (5, 0, -1), "Labor": (9, 0, 1), "Columbus": (10, 0, 2), "Thanksgiving": (11, 3, 4)}


def easter(year: int) -> date:
    """Easter Sunday by the anonymous Gregorian computus."""
    a, b, c = year % 19, year // 100, year % 100
    d, e = b // 4, b % 4
    g = (8 * b + 13) // 25
    h = (19 * a + b - d - g + 15) % 30
    i, k = c // 4, c % 4
    m = (32 + 2 * e + 2 * i - h - k) % 7
    n = (a + 11 * h + 22 * m) // 451
    month, day = divmod(h + m - 7 * n + 114, 31)
    return date(year, month, day + 1)


def _nth(year: int, month: int, weekday: int, which: int) -> date:
    if which > 0:
        first = date(year, month, 1)
        return first + timedelta((weekday - first.weekday()) % 7 + 7 * (which - 1))
    last = date(year + month // 12, month % 12 + 1, 1) - timedelta(1)
    return last - timedelta((last.weekday() - weekday) % 7)


def rules(continent: str, country: str) -> list:
    found = RULES.get((continent.lower(), country))
    if found is None:
        raise UtilError(f"No calendar for {country} in {continent}.", f"Known: {sorted(RULES)}.")
    return found


def holidays(continent: str, country: str, first: int = 1970, last: int = 2100) -> list[date]:
    out = set()
    for year in range(first, last + 1):
        for r in rules(continent, country):
            out.add(date(year, *r) if isinstance(r, tuple) else _nth(year, *_NTH[r]) if isinstance(r, str) else easter(year) + timedelta(r))
    return sorted(out)


def holiday_table(spark: SparkSession, continent: str, country: str, first: int = 1970, last: int = 2100) -> DataFrame:
    """A dimension table (holiday_date): a few thousand rows, hence broadcast by its users."""
    return spark.createDataFrame([(d,) for d in holidays(continent, country, first, last)], "holiday_date date")
