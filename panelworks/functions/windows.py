"""Windows over an entity x date panel."""

from __future__ import annotations

from pyspark.sql import Window, WindowSpec
from pyspark.sql import functions as F


def by_entity(entity: str | list[str] = "ticker", time: str = "date") -> WindowSpec:
    """An entity's rows in time order."""
    return Window.partitionBy(*([entity] if isinstance(entity, str) else entity)).orderBy(time)


def trailing(n: int, lag: int = 0, entity: str | list[str] = "ticker", time: str = "date") -> WindowSpec:
    """The ``n`` rows of an entity that end ``lag`` rows before the current one."""
    return by_entity(entity, time).rowsBetween(-(n - 1) - lag, -lag)


def by_date(time: str | list[str] = "date") -> WindowSpec:
    """All entities of a date."""
    return Window.partitionBy(*([time] if isinstance(time, str) else time))


def ranked(x: str, time: str | list[str] = "date") -> WindowSpec:
    """All entities of a date by ascending ``x``, missing ones last."""
    return by_date(time).orderBy(F.col(x).asc_nulls_last())
