"""Dates and keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the global pool number is the pool type (7, 9, 12) times this plus the pool number.
PREFIX_STEP = 1_000_000


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def parse_league_date(text) -> Column:
    """``dd/MM/yyyy`` first, then ``dd/MM/yy``."""
    t = F.trim(_col(text))
    return (F.when(t.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), F.try_to_date(t, "d/M/yyyy"))
            .when(t.rlike(r"^\d{1,2}/\d{1,2}/\d{2}$"), F.try_to_date(t, "d/M/yy")))


def parse_cup_date(text) -> Column:
    """Date part of ``dd-MM-yy HH:mm``."""
    t = F.trim(_col(text))
    whole = t.rlike(r"^\d{1,2}-\d{1,2}-\d{2} ([01]?\d|2[0-3]):[0-5]?\d$")
    return F.when(whole, F.try_to_date(F.split(t, " ")[0], "d-M-yy"))


def iso_day(text) -> Column:
    return F.try_to_date(F.substring(_col(text), 1, 10), "yyyy-MM-dd")


def epoch_timestamp(seconds) -> Column:
    """Epoch seconds to timestamp; zero counts as missing."""
    return F.timestamp_seconds(F.nullif(_col(seconds).cast("long"), F.lit(0).cast("long")))


def pool_key(pool_type, pool_id) -> Column:
    """Global pool number: type prefix times a million plus the pool number."""
    return _col(pool_type).cast("long") * PREFIX_STEP + _col(pool_id)


def pool_id_of(key, pool_type) -> Column:
    """Pool number where the global number belongs to the type, null elsewhere."""
    base = _col(pool_type).cast("long") * PREFIX_STEP
    inside = (_col(key) >= base) & (_col(key) < base + PREFIX_STEP)
    return F.when(inside, _col(key) - base)
