"""Log level codes and the class labels shown for levels, hosts and counts."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, functions as F

# Level name -> code.
LEVEL_CODES = {
    "DEBUG": 100,
    "INFO": 200,
    "NOTICE": 250,
    "WARNING": 300,
    "ERROR": 400,
    "CRITICAL": 500,
    "ALERT": 550,
    "EMERGENCY": 600,
}

# Thresholds of the host classes.
LOAD_LIMITS = (2.0, 5.0)
PERCENT_LIMITS = (75.0, 90.0)
AGE_LIMITS_S = (90, 600)


def level_code(name: Column | str) -> Column:
    """Code of a level name; 0 for names outside the closed set."""
    codes = F.create_map(*[F.lit(x) for x in chain.from_iterable(LEVEL_CODES.items())])
    return F.coalesce(F.element_at(codes, _col(name)), F.lit(0)).cast("int")


def code_of(name: str) -> int:
    return LEVEL_CODES.get(name.upper(), 0)


def _banded(value: Column, limits: tuple, labels: tuple[str, str, str]) -> Column:
    low, high = limits
    return F.when(value >= high, labels[2]).when(value >= low, labels[1]).otherwise(labels[0])


def load_class(load: Column | str) -> Column:
    return _banded(_col(load), LOAD_LIMITS, ("ok", "warn", "crit"))


def percent_class(percent: Column | str) -> Column:
    """Class of a memory, disk or cpu percentage."""
    return _banded(_col(percent), PERCENT_LIMITS, ("ok", "warn", "crit"))


def age_class(age_s: Column | str) -> Column:
    return _banded(_col(age_s), AGE_LIMITS_S, ("live", "stale", "offline"))


def repeat_class(count: Column | str) -> Column:
    """Class of a repeated-line count: 10 and more high, 3 and more mid."""
    c = _col(count)
    return F.when(c >= 10, "high").when(c >= 3, "mid").otherwise("low")


def occurrence_class(count: Column | str) -> Column:
    """Class of a grouped row's occurrences: above 100, 10 and 1."""
    c = _col(count)
    return F.when(c > 100, "high").when(c > 10, "mid").when(c > 1, "low").otherwise("single")


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value
