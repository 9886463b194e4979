"""Match outcomes, result codes and payouts held in nested columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OUTCOMES = ["1", "N", "2"]


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def outcome(home, away) -> Column:
    h, a = _col(home), _col(away)
    return F.when(h > a, "1").when(h < a, "2").when(h == a, "N")


def decode_result(code, n) -> Column:
    """Winning outcomes per match, match order, from a code written last match first.

    Three characters per match; ``000`` gives null, ``111`` all outcomes, a bad length null
    everywhere.
    """
    code, n = _col(code), _col(n)
    valid = code.isNotNull() & (code != "") & (F.length(code) == n * 3)
    table = F.create_map(*[x for k in range(1, 8) for x in (
        F.lit(format(k, "03b")), F.array(*[F.lit(o) for o, c in zip(OUTCOMES, format(k, "03b")) if c == "1"]))])
    signs = F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: F.when(
        valid, F.try_element_at(table, F.substring(code, (n - 1 - i) * 3 + 1, F.lit(3)))))
    return F.when(n > 0, signs).otherwise(F.array().cast("array<array<string>>"))


def single_outcome(signs: Column) -> Column:
    """Index 0/1/2 of the only winning outcome; null when unknown, cancelled or doubtful."""
    index = F.array_position(F.array(*[F.lit(o) for o in OUTCOMES]), signs[0]) - 1
    return F.when(F.size(signs) == 1, index.cast("int"))


def is_cancelled(signs: Column) -> Column:
    return F.coalesce(F.size(signs) == 3, F.lit(False)) & signs.isNotNull()


def payout_maps(payouts) -> tuple[Column, Column]:
    """``rank -> amount`` and ``rank -> winners``; the last entry of a repeated rank counts."""
    p = _col(payouts)
    last = F.filter(p, lambda r, i: ~F.exists(
        F.slice(p, i + 2, F.greatest(F.size(p) - i - 1, F.lit(0))), lambda o: o["rank"] == r["rank"])
        & r["rank"].isNotNull())
    zero, none = F.lit(0.0), F.lit(0).cast("long")
    amounts = F.map_from_entries(F.transform(last, lambda r: F.struct(r["rank"], F.coalesce(r["amount"], zero))))
    winners = F.map_from_entries(F.transform(last, lambda r: F.struct(r["rank"], F.coalesce(r["winners"], none))))
    return amounts, winners


def at_rank(ranks: Column, rank: Column) -> Column:
    """Amount of a rank, zero where the rank is not paid."""
    return F.coalesce(F.try_element_at(ranks, rank.cast("int")), F.lit(0.0))


def histogram_mean(histogram, n) -> Column:
    """Share of matches found by the crowd: sum of k times slips with k hits, per slip and match."""
    h = _col(histogram)
    hits = F.aggregate(F.transform(h, lambda x, k: x * k), F.lit(0).cast("long"), lambda a, x: a + x)
    return hits / slips_played(h) / _col(n)


def slips_played(histogram) -> Column:
    return F.aggregate(_col(histogram), F.lit(0).cast("long"), lambda a, x: a + x)
