"""Ticking strategies as declarative specs, paid without enumerating their slips.

A strategy gives every match of a pool a role: favourite, second, double (both) or triple. The slips
it stands for are the product of the roles, so the number of slips with k hits is the coefficient of
x^k in a product of small polynomials: one row-level expression per pool and strategy.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from poolspark.functions import results as R
from poolspark.operators.crowd import settled_singly, with_signs
from poolspark.operators.market import fully_priced
from poolspark.operators.resample import BACKTEST_REPLICATES, bootstrap_interval, split_half
from poolspark.scale import order_statistics
from poolspark.session import cut_lineage

MATCHES = 7
# Placements, clear-favourite threshold, rows trimmed, dearest configuration shown.
CLEAR, TIGHT = "nets", "serres"
RANKS = ["clear", "tight"]
THRESHOLD = 0.55
HEAD = 3
MAX_STAKE = 400


@dataclass(frozen=True)
class Strategy:
    """``role`` is SQL over a lambda variable ``m`` with clear, tight, pmax: S, D, T or F (favourite)."""

    name: str
    role: str
    cost: int
    doubles: int = 0
    triples: int = 0
    order: str = CLEAR
    triples_on: str | None = None


def all_favourite(name: str = "tout favori") -> Strategy:
    return Strategy(name, "'F'", 1)


def break_favourites(k: int, name: str) -> Strategy:
    """Second favourite on the k clearest matches."""
    return Strategy(name, f"if(m.clear < {k}, 'S', 'F')", 1)


def double_clearest(k: int, name: str) -> Strategy:
    return Strategy(name, f"if(m.clear < {k}, 'D', 'F')", 2 ** k, doubles=k)


def double_tightest(name: str) -> Strategy:
    return Strategy(name, "if(m.tight = 0, 'D', 'F')", 2, doubles=1, order=TIGHT)


def system(doubles: int, triples: int, order: str = CLEAR, triples_on: str | None = None, name: str | None = None) -> Strategy:
    """Triples first, doubles on the best remaining matches; triples may sit at the other end."""
    rank = "m.clear" if order == CLEAR else "m.tight"
    same = triples_on is None or triples_on == order
    triple = f"{rank} < {triples}" if same else f"{MATCHES - 1} - {rank} < {triples}"
    double = f"{rank} < {doubles + triples}" if same else f"{rank} < {doubles}"
    role = f"case when {triple} then 'T' when {double} then 'D' else 'F' end"
    return Strategy(name or f"{triples}T{doubles}D-{order}-{triples_on or order}", role, 2 ** doubles * 3 ** triples,
                    doubles, triples, order, triples_on)


def adaptive(threshold: float = THRESHOLD, triples: int = 0, name: str = "adaptive", cost: int = 8) -> Strategy:
    """Double every match whose favourite reaches the threshold, after the tightest triples."""
    role = f"case when m.tight < {triples} then 'T' when m.pmax >= {threshold}D then 'D' else 'F' end"
    return Strategy(name, role, cost, triples=triples)


# The published strategies, their labels and indicative costs.
SCOREBOARD = [
    all_favourite(),
    break_favourites(1, "casser le favori le plus net"),
    break_favourites(2, "casser les 2 favoris les plus nets"),
    double_clearest(1, "doubler le favori le plus net"),
    double_clearest(2, "doubler les 2 favoris les plus nets"),
    double_clearest(3, "doubler les 3 favoris les plus nets"),
    double_tightest("doubler le match le plus serré"),
    adaptive(0.55, 0, "adaptative : favori ≥ 55 %", 8),
    adaptive(0.60, 0, "adaptative : favori ≥ 60 %", 5),
    system(0, 1, CLEAR, None, "1 triple sur le plus net"),
    system(2, 1, CLEAR, None, "1 triple + 2 doubles sur les plus nets"),
]
# Fixed values: (triples, doubles) compared at equal budget, and the doubles of the size curve.
PLACEMENTS = [(0, 0), (0, 1), (0, 2), (1, 0), (0, 3), (1, 1), (0, 4), (1, 2), (2, 0), (1, 3)]
SIZE_CURVE = list(range(8))


def configurations(max_stake: int = MAX_STAKE) -> list[Strategy]:
    """Every split into up to three triples and doubles within the stake cap, triples at either end."""
    found = []
    for triples in range(4):
        for doubles in range(MATCHES + 1 - triples):
            if 2 ** doubles * 3 ** triples <= max_stake:
                for on in ([CLEAR] if triples == 0 else [TIGHT, CLEAR]):
                    found.append(system(doubles, triples, CLEAR, on))
    return found


def playable(pools: DataFrame, matches: int = MATCHES) -> DataFrame:
    """Pools of ``matches`` matches, all priced and settled on one outcome, with ranked matches.

    ``ranked``: winner, favourite, second, pmax, position among the clearest (``clear``) and among the
    tightest (``tight``), equal probabilities in match order both times.
    """
    kept = with_signs(pools.where((F.size("matches") == matches) & fully_priced(F.col("matches")))).where(
        settled_singly(F.col("winners")))
    amounts, winners = R.payout_maps("payouts")
    trio = "array(1 / m.p1, 1 / m.px, 1 / m.p2)"
    probs = (f"transform(matches, m -> transform({trio}, q -> q / aggregate({trio}, 0D, (a, x) -> a + x)))")
    ranked = """zip_with(probs, winners, (p, w) -> named_struct('w', w, 'pmax', array_max(p),
      'favourite', cast(array_position(p, array_max(p)) - 1 as int),
      'second', sort_array(transform(p, (x, i) -> named_struct('p', -x, 'i', i)))[1].i))"""
    placed = """transform(ranked, (m, j) -> named_struct('w', m.w, 'pmax', m.pmax, 'favourite', m.favourite, 'second', m.second,
      'clear', size(filter(ranked, (o, k) -> o.pmax > m.pmax or (o.pmax = m.pmax and k < j))),
      'tight', size(filter(ranked, (o, k) -> o.pmax < m.pmax or (o.pmax = m.pmax and k < j)))))"""
    return (kept.withColumn("probs", F.expr(probs)).withColumn("ranked", F.expr(ranked))
            .select("pool_id", "closed_on", F.expr(placed).alias("ranked"), amounts.alias("amounts"),
                    winners.alias("winners_at")))


def roles(strategy: Strategy) -> str:
    return f"transform(ranked, m -> {strategy.role})"


def choice_sets(strategy: Strategy) -> Column:
    """The multi-slip a strategy stands for, ready to be enumerated."""
    return F.expr(f"""zip_with(ranked, {roles(strategy)}, (m, r) -> case r when 'T' then array(0, 1, 2)
      when 'D' then array(m.favourite, m.second) when 'S' then array(m.second) else array(m.favourite) end)""")


def slips_played(strategy: Strategy) -> Column:
    return F.expr(f"aggregate({roles(strategy)}, 1L, (n, r) -> n * case r when 'T' then 3 when 'D' then 2 else 1 end)")


def mean_payout(strategy: Strategy) -> Column:
    """Payout per unit staked: slips with k hits times the amount of rank k, over the slips played."""
    size = f"(case {strategy.role} when 'T' then 3 when 'D' then 2 else 1 end)"
    return F.expr(f"""aggregate(transform({_hits(strategy)}, (n, k) -> n * coalesce(try_element_at(amounts, k), 0D)), 0D,
      (a, x) -> a + x) / aggregate(ranked, 1L, (n, m) -> n * {size})""")


def _hits(strategy: Strategy) -> str:
    """Slips by number of hits, none first."""
    hit = f"""(case {strategy.role} when 'T' then true when 'D' then m.w = m.favourite or m.w = m.second
      when 'S' then m.w = m.second else m.w = m.favourite end)"""
    size = f"(case {strategy.role} when 'T' then 3 when 'D' then 2 else 1 end)"
    # acc[k]: slips with k hits among the matches read so far.
    return f"""aggregate(ranked, array(1L), (acc, m) -> zip_with(concat(acc, array(0L)), concat(array(0L), acc),
      (stay, up) -> stay * ({size} - if({hit}, 1, 0)) + if({hit}, up, 0L)))"""


def returns(played: DataFrame, strategies: Sequence[Strategy], matches: int = MATCHES) -> DataFrame:
    """One row per pool of ``matches`` matches, one column ``s<i>`` of payout per unit for every strategy.

    A strategy that places its roles by one rank alone is paid by what won at each place: the favourite, the second or the
    third. There are ``3 ** matches`` such outcomes, so the slips by number of hits are counted once for each of them.
    """
    ranks = {}
    for i, s in enumerate(strategies):
        read = [r for r in RANKS if f"m.{r}" in s.role]
        if "m.pmax" not in s.role and len(read) < 2:
            ranks.setdefault((read or [RANKS[0]])[0], []).append(i)
    paid = F.transform(F.sequence(F.lit(0), F.lit(matches)), lambda k: F.coalesce(F.try_element_at("amounts", k), F.lit(0.0)))
    rows = played.withColumn("__paid", paid)
    payout = {i: mean_payout(s) for i, s in enumerate(strategies)}
    for rank, own in ranks.items():
        table = hit_counts([strategies[i] for i in own], rank, matches, spark=played.sparkSession)
        won = f"""aggregate(ranked, 0L, (a, m) -> a + cast(power(3, m.{rank}) as bigint)
          * (case when m.w = m.favourite then 0 when m.w = m.second then 1 else 2 end))"""
        # Every outcome is in the table; an inner join would work the ranks out once more, to drop missing ones before it.
        table = F.broadcast(table.withColumnsRenamed({"won": f"__{rank}", "hits": f"__{rank}_hits"}))
        rows = rows.withColumn(f"__{rank}", F.expr(won)).join(table, f"__{rank}", "left")
        rows = rows.withColumn(f"__{rank}_paid", F.expr(f"""transform(__{rank}_hits, h -> aggregate(
          zip_with(h.n, __paid, (n, a) -> n * a), 0D, (a, x) -> a + x) / h.slips)"""))
        payout |= {i: F.col(f"__{rank}_paid")[at] for at, i in enumerate(own)}
    return rows.select("pool_id", "closed_on", *[payout[i].alias(f"s{i}") for i in range(len(strategies))])


def hit_counts(strategies: Sequence[Strategy], rank: str, matches: int, *, spark) -> DataFrame:
    """``won, hits``: of every outcome by place (a number of base 3) the slips by number of hits, and all, of each strategy."""
    ranked = f"""transform(sequence(0, {matches - 1}), r -> named_struct('{rank}', r, 'favourite', 0, 'second', 1,
      'w', cast(won div cast(power(3, r) as bigint) % 3 as int)))"""
    outcomes = spark.range(3 ** matches).select(F.col("id").alias("won")).withColumn("ranked", F.expr(ranked))
    counts = [F.struct(F.expr(_hits(s)).alias("n"), slips_played(s).alias("slips")) for s in strategies]
    return outcomes.select("won", F.array(*counts).alias("hits"))


def _stacked(strategies: Sequence[Strategy]) -> Column:
    return F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"s{i}").alias("value"))
                               for i in range(len(strategies))]))


def scores(returned: DataFrame, strategies: Sequence[Strategy], head: int = HEAD) -> DataFrame:
    """Mean, both halves by close date and the return without the ``head`` best pools, per strategy."""
    from poolspark.operators.resample import head_trimmed

    halves = split_half(returned, "closed_on", "pool_id")
    long = halves.select("half", _stacked(strategies).alias("x")).select("half", "x.*")
    means = long.groupBy("i").agg(
        F.count("*").alias("pools"), F.avg("value").alias("mean_return"),
        F.avg(F.when(F.col("half") == "A", F.col("value"))).alias("period_a"),
        F.avg(F.when(F.col("half") == "B", F.col("value"))).alias("period_b"))
    trimmed = head_trimmed(long, "value", ["i"], head).select("i", F.col("trimmed").alias("without_head"))
    return means.join(trimmed, "i")


def _labels(strategies: Sequence[Strategy], *fields: str) -> list[Column]:
    return [F.element_at(F.array(*[F.lit(getattr(s, f)) for s in strategies]), F.col("i") + 1).alias(f) for f in fields]


def scoreboard(pools: DataFrame, strategies: Sequence[Strategy] = tuple(SCOREBOARD), *,
               replicates: int = BACKTEST_REPLICATES, method: str = "poisson") -> DataFrame:
    """Every strategy with its cost, mean, halves, bootstrap interval and trimmed return."""
    returned = cut_lineage(returns(playable(pools), strategies))
    names = [f"s{i}" for i in range(len(strategies))]
    ci = bootstrap_interval(returned, names, "pool_id", replicates, method=method).select(
        F.substring("name", 2, 3).cast("int").alias("i"), "low", "high")
    return scores(returned, strategies).join(ci, "i").select(
        *_labels(strategies, "name", "cost"), "pools", "mean_return", "period_a", "period_b", "low", "high", "without_head")


def placement_comparison(pools: DataFrame) -> DataFrame:
    """Same budget, clear against tight matches: mean return of both and the gap in points."""
    pairs = [(system(d, t, CLEAR), system(d, t, TIGHT)) for t, d in PLACEMENTS]
    flat = [s for pair in pairs for s in pair]
    means = returns(playable(pools), flat).agg(
        *[F.avg(f"s{i}").alias(f"s{i}") for i in range(len(flat))])
    rows = F.array(*[F.struct(
        F.lit(c.triples).alias("triples"), F.lit(c.doubles).alias("doubles"), F.lit(c.cost).alias("slips"),
        F.col(f"s{2 * i}").alias("clear_return"), F.col(f"s{2 * i + 1}").alias("tight_return"),
        ((F.col(f"s{2 * i}") - F.col(f"s{2 * i + 1}")) * 100).alias("gap")) for i, (c, _) in enumerate(pairs)])
    return means.select(F.explode(rows).alias("r")).select("r.*")


def size_curve(pools: DataFrame) -> DataFrame:
    """Expected gain in units and what the added units bring, by number of doubles."""
    from pyspark.sql import Window

    strategies = [system(d, 0) for d in SIZE_CURVE]
    table = scores(cut_lineage(returns(playable(pools), strategies)), strategies).select(
        "i", *_labels(strategies, "doubles", "cost"), "mean_return", "period_a", "period_b", "without_head")
    gain = (F.col("mean_return") - 1) * F.col("cost")
    # Eight rows, one per size.
    before = Window.orderBy("i")
    return (table.withColumn("expected_gain", gain)
            .withColumn("marginal", 1 + (F.col("expected_gain") - F.lag("expected_gain").over(before))
                        / (F.col("cost") - F.lag("cost").over(before))).drop("i"))


def config_sweep(pools: DataFrame, max_stake: int = MAX_STAKE) -> DataFrame:
    """Every configuration within the stake cap, best expected gain first."""
    strategies = configurations(max_stake)
    table = scores(cut_lineage(returns(playable(pools), strategies)), strategies)
    placed = F.when(F.col("triples") == 0, F.lit("—")).otherwise(F.col("triples_on"))
    return (table.select(*_labels(strategies, "doubles", "triples", "cost", "triples_on"), "mean_return", "period_a",
                         "period_b", "without_head")
            .select((MATCHES - F.col("doubles") - F.col("triples")).alias("bases"), "doubles", "triples",
                    placed.alias("triples_on"), "cost", "mean_return",
                    ((F.col("mean_return") - 1) * F.col("cost")).alias("expected_gain"), "period_a", "period_b",
                    "without_head")
            .orderBy(F.desc("expected_gain")))


def mechanism(pools: DataFrame, rank: int = MATCHES) -> DataFrame:
    """Pools whose top rank was paid, split by whether the clearest favourite won."""
    clearest = F.expr("filter(ranked, m -> m.clear = 0)[0]")
    amount = F.try_element_at("amounts", F.lit(rank))
    return (playable(pools).withColumn("c", clearest).where(amount.isNotNull())
            .select((F.col("c.w") == F.col("c.favourite")).alias("favourite_won"), amount.alias("amount"),
                    F.coalesce(F.try_element_at("winners_at", F.lit(rank)), F.lit(0).cast("long")).alias("winners")))


def mechanism_split(pools: DataFrame, rank: int = MATCHES) -> DataFrame:
    """Count, mean and median payout and winners on both sides of the split."""
    rows = cut_lineage(mechanism(pools, rank))
    sides = []
    for won in (True, False):
        side = rows.where(F.col("favourite_won") == won)
        sides.append(side.agg(F.count("*").alias("pools"), F.avg("amount").alias("mean_amount")).select(
            F.lit(won).alias("favourite_won"), "pools", "mean_amount",
            median(side, "amount").alias("median_amount"), median(side, "winners").alias("median_winners")))
    return sides[0].unionByName(sides[1]).where("pools > 0")


def median(df: DataFrame, value: str) -> Column:
    """Exact median as a scalar: mean of the two middle elements, no sort of the whole column."""
    n = F.col("n")
    middle = order_statistics(df, value, {"a": (0.5, F.floor((n - 1) / 2)), "b": (0.5, F.floor(n / 2))}, materialise=False)
    return middle.select((F.col("a") + F.col("b")) / 2).scalar()


def mechanism_summary(pools: DataFrame, rank: int = MATCHES) -> DataFrame:
    """How often the clearest favourite falls, the payout factor then, and the relative expectation."""
    won = F.col("favourite_won")
    agg = mechanism(pools, rank).agg(
        F.avg((~won).cast("double")).alias("drop_rate"),
        (F.avg(F.when(~won, F.col("amount"))) / F.avg(F.when(won, F.col("amount")))).alias("factor"))
    odds = F.col("drop_rate") / (1 - F.col("drop_rate"))
    return agg.select("drop_rate", "factor", (1 / odds).alias("chance_cost"),
                      (F.col("factor") * odds).alias("relative_expectation"))
