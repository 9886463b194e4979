"""Strict matching of pool matches with external fixtures, and the other exact joins."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from poolspark.functions import prices as P
from poolspark.functions import results as R
from poolspark.functions import text as T

# Reasons of refusal, in the order in which they are tested, and the day margin.
NO_DATE = "match sans date"
ABSENT = "affiche absente de football-data"
SEVERAL = "plusieurs candidates"
SCORES_DIFFER = "scores différents"
SHIFTED = "sans score, et date décalée"
UNPRICED = "rencontre trouvée mais sans cote"
DAY_MARGIN = 1
# What a fixture hands on beside its day and score, and the days of a span that is looked up at once.
CARRIED = ("prices", "competition")
SPAN = 32
# Status of an archive pool after enrichment and the least share of agreeing rows.
ENRICHED = "ok"
LENGTH_DIFFERS = "désaccord de longueur"
NO_LINES = "absente"
LINES_DIFFER = "affiches différentes"
OUTCOMES_DIFFER = "scores en désaccord avec les issues"
AGREEMENT_SHARE = 0.4
RETRY_STATUS = [NO_LINES, LENGTH_DIFFERS]


def with_team_keys(df: DataFrame, aliases: DataFrame | None = None, home: str = "home", away: str = "away") -> DataFrame:
    """Adds ``home_key`` and ``away_key``: folded names, translated by one source's alias table."""
    keyed = df.withColumn("home_key", T.fold(home)).withColumn("away_key", T.fold(away))
    if aliases is None:
        return keyed
    for side in ("home_key", "away_key"):
        table = aliases.select(F.col("folded").alias(side), F.col("target").alias("__target"))
        keyed = keyed.join(table, side, "left").withColumn(side, T.resolve(F.col(side), F.col("__target"))).drop("__target")
    return keyed


def _span(day: Column) -> Column:
    return F.floor(F.unix_date(day) / F.lit(SPAN)).cast("int")


def fixture_lookup(fixtures: DataFrame, margin: int = DAY_MARGIN, carry: Sequence[str] = CARRIED) -> DataFrame:
    """One row per (pair, span of days): ``near``, for every day of the span and ``margin`` around it how many
    fixtures there are (``n``) and the content of one of them.

    Fixtures are counted per day first, so the key is unique, a row holds at most a day's count for each of its
    days and a pair met very often can neither multiply the matches nor fill one task. Only days at the edge of
    a span are held twice. Of several fixtures of a day the fields may be of different ones.
    """
    content = ["goals_home", "goals_away", *carry]
    daily = fixtures.where(F.col("match_date").isNotNull()).groupBy("home_key", "away_key", "match_date").agg(
        F.count("*").alias("n"), *[F.any_value(c).alias(c) for c in content])
    day = F.col("match_date")
    spans = F.explode(F.sequence(_span(F.date_sub(day, margin)), _span(F.date_add(day, margin)))).alias("span")
    return (daily.select("home_key", "away_key", spans, F.struct("n", "match_date", *content).alias("day"))
            .groupBy("home_key", "away_key", "span").agg(F.collect_list("day").alias("near")))


def strict_match(matches: DataFrame, fixtures: DataFrame, *, day: str = "day", margin: int = DAY_MARGIN,
                 carry: Sequence[str] = CARRIED) -> DataFrame:
    """Adds ``found`` (the fixture with the ``carry`` columns, or null) and ``reason`` (or null) to every match."""
    lookup = fixture_lookup(fixtures, margin, carry).withColumnsRenamed({"span": "__span", "near": "__near"})
    joined = (matches.withColumn("__span", _span(F.col(day))).join(lookup, ["home_key", "away_key", "__span"], "left")
              .withColumn("__near", F.filter("__near", lambda f: F.abs(F.date_diff(f["match_date"], F.col(day))) <= margin))
              .withColumn("candidates", F.aggregate("__near", F.lit(0).cast("long"), lambda total, f: total + f["n"]))
              .withColumn("found", F.get("__near", F.lit(0)).dropFields("n")))
    goals_known = F.col("found.goals_home").isNotNull() & F.col("found.goals_away").isNotNull()
    both = F.col("score_home").isNotNull() & F.col("score_away").isNotNull() & goals_known
    differ = (F.col("score_home") != F.col("found.goals_home")) | (F.col("score_away") != F.col("found.goals_away"))
    reason = (F.when(F.col(day).isNull(), NO_DATE)
              .when(F.coalesce("candidates", F.lit(0)) == 0, ABSENT)
              .when(F.col("candidates") > 1, SEVERAL)
              .when(both & differ, SCORES_DIFFER)
              .when(~both & (F.col("found.match_date") != F.col(day)), SHIFTED))
    return (joined.withColumn("reason", reason)
            .withColumn("found", F.when(F.col("reason").isNull(), F.col("found"))).drop("candidates", "__near", "__span"))


def fallback_chain(matches: DataFrame, sources: Sequence[tuple[DataFrame, DataFrame | None]], day: str = "day") -> DataFrame:
    """Strict match against each (fixtures, aliases) in turn; a refusal falls through to the next."""
    result = matches
    found = []
    for i, (fixtures, aliases) in enumerate(sources):
        step = strict_match(with_team_keys(result, aliases), fixtures, day=day).drop("reason", "home_key", "away_key")
        result = step.withColumnRenamed("found", f"__found{i}")
        found.append(F.col(f"__found{i}"))
    return result.withColumn("found", F.coalesce(*found)).drop(*[f"__found{i}" for i in range(len(found))])


def first_occurrence(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """First row of every key by ``order``, as an aggregate with map-side reduction."""
    rest = [c for c in df.columns if c != key]
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.min_by(F.struct(*rest), F.struct(*order)).alias("r")).select(key, "r.*")


def attach_prices(matches: DataFrame, fixtures: DataFrame, order: Sequence[str], *, own_source: str,
                  aliases: DataFrame | None = None) -> DataFrame:
    """One row per distinct match: a price with its source, or the reason why there is none.

    The match's own prices come first when plausible; otherwise the strict match and the preferred
    source of the fixture. ``own_rejected`` marks own prices that failed the bounds.
    """
    own = F.expr("coalesce(p1, 0) != 0 and coalesce(px, 0) != 0 and coalesce(p2, 0) != 0")
    plausible = own & P.plausible_market("p1", "px", "p2")
    used = ["match_id", *order, "home", "away", "day", "score_home", "score_away", "p1", "px", "p2"]
    rows = first_occurrence(matches.select(*dict.fromkeys(used)), "match_id", order).withColumn("own_rejected", own & ~plausible)
    priced = rows.where(plausible)
    # Only what has no price of its own is looked up.
    matched = strict_match(with_team_keys(rows.where(~plausible), aliases), fixtures)
    picked = matched.withColumn("pick", P.preferred_price(F.col("found.prices"), F.col("day")))
    trio = ["p1", "px", "p2"]
    nothing = F.lit(None).cast("string")
    return priced.select(
        "match_id", *order, *trio, F.lit(own_source).alias("source"), nothing.alias("division"), nothing.alias("reason"),
        "own_rejected").union(picked.select(
            "match_id", *order, *[F.col(f"pick.trio.{c}").alias(c) for c in trio], F.col("pick.source").alias("source"),
            F.when(F.col("pick").isNotNull(), F.col("found.competition")).alias("division"),
            F.coalesce("reason", F.when(F.col("pick").isNull(), UNPRICED)).alias("reason"), "own_rejected"))


def coverage(priced: DataFrame) -> DataFrame:
    """Matches per source or reason, with rejected own prices and how many were priced again."""
    return priced.groupBy(F.coalesce("source", "reason").alias("label"), F.col("source").isNotNull().alias("priced")).agg(
        F.count("*").alias("matches"), F.count_if("own_rejected").alias("own_rejected"))


def all_or_nothing(pools: DataFrame, prices: DataFrame, key: Sequence[str], source: str | None = None) -> DataFrame:
    """Pools whose every match has a price (of one source when given), with the prices in match order."""
    key = list(key)
    wanted = prices if source is None else prices.where(F.col("source") == source)
    rows = pools.select(*key, F.posexplode("matches").alias("ord", "m")).select(*key, "ord", "m.match_id")
    joined = rows.join(wanted.select("match_id", F.struct("p1", "px", "p2", "source").alias("price")), "match_id", "left")
    return (joined.groupBy(*key).agg(
        F.bool_and(F.col("price").isNotNull()).alias("complete"),
        F.sort_array(F.collect_list(F.struct("ord", "match_id", "price"))).alias("priced"))
        .where("complete").drop("complete"))


def category_lookup(pools: DataFrame, categories: DataFrame, key: Sequence[str], default: str) -> DataFrame:
    known = categories.select(*key, F.col("family").alias("__family"))
    return (pools.join(known, list(key), "left")
            .withColumn("family", F.coalesce("__family", F.lit(default))).drop("__family"))


def price_fallback(matches: DataFrame, published: DataFrame) -> DataFrame:
    """Published price by match id, else the match's own plausible trio with source ``?``, else none."""
    table = published.select("match_id", F.struct("p1", "px", "p2", "source").alias("pub"))
    joined = matches.join(table, "match_id", "left")
    own = F.when(P.plausible_market("p1", "px", "p2"), F.struct("p1", "px", "p2", F.lit("?").alias("source")))
    rest = [c for c in matches.columns if c not in ("p1", "px", "p2", "source")]
    return joined.select(*rest, F.coalesce("pub", own).alias("price")).select(*rest, "price.*")


def _same_lines(a, b) -> Column:
    return T.same_team(a["home"], b["home"]) & T.same_team(a["away"], b["away"])


def enrich_archive(pools: DataFrame, lines: str = "lines", matches: str = "matches") -> DataFrame:
    """Glue prices, scores and kickoffs on an archive pool, row by row, behind three gates.

    ``matches array<struct<home,away,issue>>`` and ``lines array<struct<home,away,cotes,score,debut>>``
    in the same order. Adds ``status`` and ``priced``; matches are only filled when the status is ok.
    """
    m, l = F.col(matches), F.col(lines)
    n = F.size(m)
    empty = l.isNull() | (F.size(l) == 0)
    agreeing = F.size(F.filter(F.arrays_zip(m.alias("m"), l.alias("l")), lambda z: _same_lines(z["m"], z["l"])))
    contradicts = F.exists(F.arrays_zip(m.alias("m"), l.alias("l")), lambda z: F.coalesce(
        (F.size(z["l"]["score"]) == 2) & z["m"]["issue"].isNotNull()
        & (R.outcome(z["l"]["score"][0], z["l"]["score"][1]) != z["m"]["issue"]), F.lit(False)))
    counted = pools.withColumn("agreeing", F.when(~empty & (F.size(l) == n), agreeing))
    status = (F.when(empty, NO_LINES).when(F.size(l) != n, LENGTH_DIFFERS)
              .when(F.col("agreeing") < n * AGREEMENT_SHARE, F.concat(
                  F.lit(LINES_DIFFER + " ("), F.col("agreeing").cast("string"), F.lit("/"), n.cast("string"), F.lit(")")))
              .when(contradicts, OUTCOMES_DIFFER).otherwise(ENRICHED))
    ok = F.col("status") == ENRICHED
    glued = F.zip_with(m, l, lambda a, b: F.struct(
        a["home"].alias("home"), a["away"].alias("away"), a["issue"].alias("issue"), b["cotes"].alias("cotes"),
        b["score"].alias("score"), b["debut"].alias("debut")))
    bare = F.transform(m, lambda a: F.struct(
        a["home"].alias("home"), a["away"].alias("away"), a["issue"].alias("issue"),
        F.lit(None).cast("array<double>").alias("cotes"), F.lit(None).cast("array<int>").alias("score"),
        F.lit(None).cast("string").alias("debut")))
    return (counted.withColumn("status", status).withColumn(matches, F.when(ok, glued).otherwise(bare))
            .withColumn("priced", F.when(ok, F.size(F.filter(matches, lambda x: x["cotes"].isNotNull()))))
            .drop("agreeing"))


def _with_words(lines: Column) -> Column:
    """Every line with the long words of its two names, read once however often it is compared."""
    return F.transform(lines, lambda x: F.struct(
        x.alias("line"), T.long_tokens(x["home"]).alias("home"), T.long_tokens(x["away"]).alias("away")))


def _twins(a, b) -> Column:
    return T.same_words(a["home"], b["home"]) & T.same_words(a["away"], b["away"])


def complete_lines(table: Column, listing: Column) -> Column:
    """Fuzzy completion of a price table by the fixture list of the same page, in list order.

    List rows without a twin are appended; nothing changes when the list is not longer. Both are
    ``array<struct<home,away,...>>`` of one page.
    """
    empty = F.slice(table, 1, 0)

    def completed(known):
        own, listed = known["own"], known["listed"]
        extended = F.aggregate(listed, own, lambda acc, e: F.when(
            F.exists(acc, lambda x: _twins(x, e)), acc).otherwise(F.concat(acc, F.array(e))))
        # A pair listed twice counts at its last place.
        last = F.transform(listed, lambda e: F.array_max(F.filter(F.transform(listed, lambda o, i: F.when(
            (o["line"]["home"] == e["line"]["home"]) & (o["line"]["away"] == e["line"]["away"]), i)), lambda i: i.isNotNull())))
        return T.held(F.struct(extended.alias("lines"), last.alias("last")), lambda k: ordered(k["lines"], k["last"], listed))

    def ordered(lines, last, listed):
        def rank(x):
            first = F.array_position(F.transform(listed, lambda e: _twins(x, e)), True)
            return T.held(first, lambda at: F.when(at == 0, F.size(listed)).otherwise(F.get(last, (at - 1).cast("int"))))

        order = F.transform(lines, lambda x, i: F.struct(rank(x).alias("rank"), i.alias("i")))
        return F.transform(F.sort_array(order), lambda s: lines[s["i"]]["line"])

    known = F.struct(_with_words(F.coalesce(table, empty)).alias("own"), _with_words(listing).alias("listed"))
    return F.when(F.size(listing) <= F.size(table), table).otherwise(T.held(known, completed))


def missing_only(wanted: DataFrame, stored: DataFrame, key: Sequence[str], status: str | None = None) -> DataFrame:
    """Rows to ingest: not stored yet, or stored with a status worth another try."""
    done = stored
    if status is not None:
        done = stored.where(F.col(status).isNotNull() & ~F.col(status).isin(RETRY_STATUS))
    return wanted.join(done.select(*key), list(key), "left_anti")


def compose_pool(pools: DataFrame, matches: DataFrame, key: Sequence[str], ids: str = "match_ids") -> DataFrame:
    """Pool with its matches in the pool's own order; a match not received leaves a marker row."""
    rest = [c for c in matches.columns if c != "match_id"]
    rows = pools.select(*key, F.posexplode(ids).alias("ord", "match_id"))
    joined = rows.join(matches.withColumn("__seen", F.lit(True)), "match_id", "left")
    line = F.struct("ord", "match_id", *rest, F.col("__seen").isNull().alias("missing_in_frame"))
    return joined.groupBy(*key).agg(F.sort_array(F.collect_list(line)).alias("matches"))


def keep_last_plausible(snapshots: DataFrame, key: Sequence[str], order: Sequence[str],
                        stamp: str = "collected_at") -> DataFrame:
    """Latest plausible trio per match; ``observed_at`` when a later snapshot had none.

    Without any plausible trio the latest snapshot stands as it is. Two aggregates, so a match seen
    in a third of the snapshots is reduced map-side.
    """
    ok = P.plausible_market("p1", "px", "p2")
    trio, moment = F.struct("p1", "px", "p2", stamp), F.struct(*order)
    rows = snapshots.groupBy(*key).agg(
        F.max_by(trio, F.when(ok, moment)).alias("good"), F.max_by(trio, moment).alias("latest"),
        F.max(F.when(ok, moment)).alias("good_at"), F.max(moment).alias("latest_at"))
    kept = F.coalesce("good", "latest")
    return rows.select(
        *key, *[kept[c].alias(c) for c in ("p1", "px", "p2")],
        F.when(F.col("good").isNotNull() & (F.col("good_at") != F.col("latest_at")), F.col(f"good.{stamp}"))
        .alias("observed_at"), F.col(f"latest.{stamp}").alias(stamp))


def restore_earliest(current: DataFrame, history: DataFrame, key: Sequence[str], order: Sequence[str],
                     origin: str = "seq") -> DataFrame:
    """Fill currently implausible trios with the earliest plausible one ever seen; ``restored_from`` says where."""
    ok = P.plausible_market("p1", "px", "p2")
    first = history.where(ok).groupBy(*key).agg(
        F.min_by(F.struct("p1", "px", "p2", origin), F.struct(*order)).alias("old"))
    joined = current.join(first, list(key), "left")
    take = ~P.plausible_market("p1", "px", "p2") & F.col("old").isNotNull()
    rest = [c for c in current.columns if c not in ("p1", "px", "p2")]
    return joined.select(*rest, *[F.when(take, F.col(f"old.{c}")).otherwise(F.col(c)).alias(c) for c in ("p1", "px", "p2")],
                         F.when(take, F.col(f"old.{origin}")).alias("restored_from"))


def reconcile(left: DataFrame, right: DataFrame, key: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Counts per field of rows that agree, differ or exist on one side only."""
    a = left.select(*key, F.struct(*fields).alias("a"))
    b = right.select(*key, F.struct(*fields).alias("b"))
    joined = a.join(b, list(key), "full_outer")
    cases = F.array(*[F.struct(
        F.lit(f).alias("field"),
        F.when(F.col("a").isNull(), "right only").when(F.col("b").isNull(), "left only")
        .when(F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")), "equal").otherwise("different").alias("verdict"))
        for f in fields])
    return (joined.select(F.explode(cases).alias("c")).groupBy("c.field", "c.verdict").agg(F.count("*").alias("rows"))
            .select("field", "verdict", "rows"))


def merge_by_id(tables: Mapping[str, DataFrame], key: str, seq: str) -> DataFrame:
    """Column-wise merge of tables sharing ``key``; a later row (by ``seq``) overwrites an earlier one."""
    merged = None
    for table in tables.values():
        cols = [c for c in table.columns if c not in (key, seq)]
        last = table.groupBy(key).agg(F.max_by(F.struct(*cols), F.col(seq)).alias("r")).select(key, "r.*")
        merged = last if merged is None else merged.join(last, key, "full_outer")
    return merged
