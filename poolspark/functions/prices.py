"""Market prices: plausibility, implied probabilities, margins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bounds of a market quoted before the match, per single price.
PRICE_FLOOR = 1.06
PRICE_CEILING = 100.0
# Signature of a three-way market in an unknown payload.
SIGNATURE_PRICE = (1.01, 100.0)
SIGNATURE_MARGIN = (1.00, 1.40)
SIGNATURE_MAX_NUMBERS = 12
# Rounding allowance of paid sums, per winner and flat.
HALF_CENT = 0.005
FLOAT_SLACK = 0.02
# Price sources in order of preference and the last day the first house is trusted.
PREFERENCE = ["pinnacle_cloture", "pinnacle", "bet365_cloture", "bet365"]
TRUSTED_PREFIX = "pinnacle"
TRUSTED_UNTIL = "2025-06-30"
# One letter per published price source.
SOURCE_LETTERS = {"winamax": "w", "pinnacle_cloture": "p", "pinnacle": "p",
                  "bet365_cloture": "b", "bet365": "b", "fdj": "d"}


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def parse_price(text) -> Column:
    value = _col(text).try_cast("double")
    return F.when((value > 1.0) & ~F.isnan(value), value)


def plausible_market(p1, px, p2) -> Column:
    """Three prices inside the bounds of an open market; never null."""
    trio = [_col(p1), _col(px), _col(p2)]
    inside = F.least(*trio).between(PRICE_FLOOR, PRICE_CEILING) & (F.greatest(*trio) <= PRICE_CEILING)
    known = trio[0].isNotNull() & trio[1].isNotNull() & trio[2].isNotNull()
    return known & F.coalesce(inside, F.lit(False))


def overround(p1, px, p2) -> Column:
    return 1 / _col(p1) + 1 / _col(px) + 1 / _col(p2)


def has_market_signature(p1, px, p2) -> Column:
    trio = [_col(p1), _col(px), _col(p2)]
    inside = (F.least(*trio) >= SIGNATURE_PRICE[0]) & (F.greatest(*trio) <= SIGNATURE_PRICE[1])
    return inside & overround(*trio).between(*SIGNATURE_MARGIN)


def implied_probs(p1, px, p2) -> Column:
    """Three probabilities, margin removed proportionally."""
    total = overround(p1, px, p2)
    return F.array(*[(1 / _col(p)) / total for p in (p1, px, p2)])


def combo_retention(matches: Column) -> Column:
    """Share of the stake a combined bet gives back over ``array<struct<p1,px,p2>>``."""
    return F.aggregate(matches, F.lit(1.0), lambda acc, m: acc / overround(m["p1"], m["px"], m["p2"]))


def favourite(prices: Column) -> Column:
    """Index of the lowest price, first on ties."""
    return (F.array_position(prices, F.array_min(prices)) - 1).cast("int")


def kth_outcome(probs: Column, k: int) -> Column:
    """Index of the k-th most probable outcome; equal probabilities keep their order."""
    ranked = F.sort_array(F.transform(probs, lambda p, i: F.struct((-p).alias("p"), i.alias("i"))))
    return ranked[k]["i"].cast("int")


def rounding_tolerance(winners) -> Column:
    return _col(winners) * HALF_CENT + FLOAT_SLACK


def round_exact(x: Column, scale: int) -> Column:
    """Nearest multiple of ``1 / scale``, decided on the exact binary value of ``x``.

    The product with ``scale`` is inexact, so a halfway product is settled by its rounding error
    (two-product with a Veltkamp split); exact halves go to the even neighbour.
    """
    p = x * float(scale)
    c = x * 134217729.0
    high = c - (c - x)
    error = (high * float(scale) - p) + (x - high) * float(scale)
    halfway = (p - F.floor(p)) == 0.5
    whole = F.when(halfway & (error > 0), F.ceil(p)).when(halfway & (error < 0), F.floor(p)).otherwise(F.rint(p))
    return whole.cast("double") / float(scale)


def payout_ratio(distributed, slips) -> Column:
    """Distributed per played slip to four decimals; unknown or zero on either side gives null."""
    d, s = _col(distributed), _col(slips)
    return F.when((d != 0) & (s != 0), round_exact(d / s, 10_000))


def source_letter(source) -> Column:
    """Published letter of a price source; sources outside the list give null."""
    table = F.create_map(*[F.lit(x) for pair in SOURCE_LETTERS.items() for x in pair])
    return F.try_element_at(table, _col(source))


def preferred_price(prices, day) -> Column:
    """Best available source as ``struct<trio,source>`` from ``map<source,trio>``, null when none.

    Sources of the trusted house are skipped after its last reliable day.
    """
    trusted = _col(day) <= F.lit(TRUSTED_UNTIL).cast("date")
    options = []
    for source in PREFERENCE:
        trio = F.try_element_at(_col(prices), F.lit(source))
        usable = trio.isNotNull()
        if source.startswith(TRUSTED_PREFIX):
            usable = usable & trusted
        options.append(F.when(usable, F.struct(trio.alias("trio"), F.lit(source).alias("source"))))
    return F.coalesce(*options)
