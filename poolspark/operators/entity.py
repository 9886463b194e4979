"""Team-name resolution: candidates by resemblance, confirmation by dates, inference by exact day."""

from __future__ import annotations

from bisect import insort
from collections import Counter
from collections.abc import Sequence
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from poolspark.functions import text as T
from poolspark.session import cut_lineage

# Resemblance floor, bonus of a shared word, candidates kept, confirmations, window days.
SIMILARITY = 0.55
WORD_BONUS = 0.3
TOP = 12
CONFIRMATIONS = 2
WINDOW_DAYS = 3
LEAD = 3
BY_EXACT_DAY = "date_exacte"

CHUNK = 10_000
WORD_BITS = 64


def distinct_names(fixtures: DataFrame, order: Sequence[str], columns: Sequence[str] = ("home_name", "away_name")) -> DataFrame:
    """External names by folded key, first spelling kept, with a rank of first appearance."""
    sides = F.explode(F.array(*[F.struct(F.lit(i).alias("side"), F.col(c).alias("name")) for i, c in enumerate(columns)])).alias("s")
    rows = fixtures.select(*order, sides).select(*order, "s.side", F.trim("s.name").alias("display")).where("display != ''")
    first = F.struct(*order, "side")
    return rows.groupBy(T.fold("display").alias("folded")).agg(
        F.min_by("display", first).alias("display"), F.min(first).alias("first"))


def _places(plain: list[str], alphabet: dict[str, int]) -> np.ndarray:
    """Per letter and text the places of the letter among the first 64, as the bits of a word."""
    codes = np.array(plain, dtype=f"U{WORD_BITS}").view(np.uint32).reshape(len(plain), WORD_BITS)
    letters = np.array([ord(c) for c in alphabet], dtype=np.uint32)  # ascending, as the alphabet is
    bits = np.zeros((len(alphabet), len(plain)), dtype=np.uint64)
    for place in range(WORD_BITS):
        held = np.flatnonzero(codes[:, place])
        bits[np.searchsorted(letters, codes[held, place]), held] |= np.uint64(1) << np.uint64(place)
    return bits


def _common_subsequences(places: np.ndarray, target: list[int]) -> np.ndarray:
    """Length of the longest common subsequence of the target with every text at once, one letter per step.

    A cleared bit marks a place where the subsequence grows by one.
    """
    state = np.full(places.shape[1], ~np.uint64(0), dtype=np.uint64)
    met, rest = np.empty_like(state), np.empty_like(state)
    for letter in target:
        np.bitwise_and(state, places[letter], out=met)
        np.subtract(state, met, out=rest)
        np.add(state, met, out=state)
        np.bitwise_or(state, rest, out=state)
    return np.bitwise_count(~state).astype(np.int64)


def _best(names: pd.DataFrame, known: pd.DataFrame, order: Sequence[str]) -> list[tuple]:
    """Top candidates of every name within one block of the dictionary.

    The blocks a ratio counts are a common subsequence, so it is bounded by the letters in common and, closer, by
    the longest common subsequence. Candidates are scored by falling bound until the bound drops below the
    twelfth score: the pruning loses nothing.
    """
    plain = known["plain"].tolist()
    alphabet = {c: i for i, c in enumerate(sorted(set("".join(plain))))}
    counts = np.zeros((len(plain), len(alphabet)), dtype=np.int32)
    for row, text in enumerate(plain):
        for char, n in Counter(text).items():
            counts[row, alphabet[char]] = n
    lengths = np.array([len(p) for p in plain])
    folded, display = known["folded"].tolist(), known["display"].tolist()
    values = list(zip(*[[None if pd.isna(v) else v for v in known[c]] for c in order]))
    first = [tuple((v is not None, v if v is not None else 0) for v in row) for row in values]  # nulls first
    matchers: dict[int, SequenceMatcher] = {}
    places = _places(plain, alphabet)
    # A longer text, or one with the character that pads the others, keeps the bound by letters.
    short = np.array([len(p) <= WORD_BITS and "\0" not in p for p in plain], dtype=bool)
    holders: dict[str, list[int]] = {}
    for row, listed in enumerate(known["words"]):
        for word in listed:
            holders.setdefault(word, []).append(row)
    out = []
    for name, target, target_words in zip(names["name"], names["plain"], names["words"]):
        own = np.zeros(len(alphabet), dtype=np.int32)
        for char, n in Counter(target).items():
            if char in alphabet:
                own[alphabet[char]] = n
        total = lengths + len(target)
        common = np.minimum(counts, own).sum(axis=1)
        bound = np.where(total > 0, 2.0 * common / np.maximum(total, 1), 1.0)
        shared = np.zeros(len(plain), dtype=bool)
        for word in target_words:
            shared[holders.get(word, [])] = True
        closer = np.flatnonzero((shared | (bound >= SIMILARITY)) & short & (total > 0))
        longest = _common_subsequences(places[:, closer], [alphabet[c] for c in target if c in alphabet])
        bound[closer] = 2.0 * np.minimum(common[closer], longest) / total[closer]
        ceiling = bound + WORD_BONUS * shared
        possible = np.flatnonzero(shared | (bound >= SIMILARITY))
        found: list[tuple[float, tuple, int]] = []  # (-score, first, row), best first
        for j in possible[np.argsort(-ceiling[possible], kind="stable")].tolist():
            if len(found) == TOP and ceiling[j] < -found[-1][0] - 1e-12:
                break
            if j not in matchers:
                matchers[j] = SequenceMatcher(None, "", plain[j])
            matchers[j].set_seq1(target)
            ratio = matchers[j].ratio()
            if shared[j] or ratio >= SIMILARITY:
                insort(found, (-(ratio + (WORD_BONUS if shared[j] else 0)), first[j], j))
                del found[TOP:]
        out += [(name, folded[j], display[j], -score, *values[j]) for score, _, j in found]
    return out


def name_candidates(names: DataFrame, dictionary: DataFrame, *, chunk: int = CHUNK) -> DataFrame:
    """Best external names per unknown name: shared word or resemblance, ``rank`` from 1 to 12.

    ``names``: name; ``dictionary``: folded, display, first (sortable). Distinct names only are
    compared, block against block: every task holds one slice of the names and one chunk of the
    dictionary and returns at most twelve rows per name. Equal scores keep the dictionary order.
    """
    fields = dictionary.schema["first"].dataType.fields
    order = [F.col("first")[f.name].alias(f"__o{i}") for i, f in enumerate(fields)]
    prepared = names.select("name").distinct().select("name", T.strip_accents("name").alias("plain"), T.tokens("name").alias("words"))
    known = dictionary.select("folded", "display", *order,
                              T.strip_accents("display").alias("plain"), T.tokens("display").alias("words"))
    known = cut_lineage(known)
    prepared = cut_lineage(prepared)
    chunks = max(1, -(-known.count() // chunk))
    slices = max(1, -(-prepared.count() // chunk), min(64, names.sparkSession.sparkContext.defaultParallelism))
    left = prepared.withColumn("slice", F.pmod(F.xxhash64("name"), F.lit(slices))).withColumn(
        "chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))))
    right = known.withColumn("chunk", F.pmod(F.xxhash64("folded"), F.lit(chunks))).withColumn(
        "slice", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slices - 1).cast("long"))))
    # The order of first appearance travels as typed columns.
    places = [f"__o{i}" for i in range(len(fields))]
    typed = ", ".join(f"{p} {f.dataType.simpleString()}" for p, f in zip(places, fields))

    def one_block(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        rows = _best(a, b.reset_index(drop=True), places) if len(a) and len(b) else []
        return pd.DataFrame(rows, columns=["name", "folded", "display", "score", *places])

    blocks = (left.repartition(slices * chunks, "slice", "chunk").groupBy("slice", "chunk")
              .cogroup(right.groupBy("slice", "chunk"))
              .applyInPandas(one_block, f"name string, folded string, display string, score double, {typed}"))
    rank = F.row_number().over(Window.partitionBy("name").orderBy(F.desc("score"), *places))
    return blocks.withColumn("rank", rank).where(F.col("rank") <= TOP).drop(*places)


def contexts(matches: DataFrame, known: DataFrame, dated: DataFrame, key: Sequence[str], margin: int = WINDOW_DAYS) -> DataFrame:
    """Where unknown names appear: ``name, home_key, away_key, role, lo, hi, times``.

    ``known`` lists the folded external names, ``dated`` gives date_min and date_max per pool; only
    windows with both bounds count. Equal contexts are merged into one weighted row.
    """
    windows = dated.where("date_min IS NOT NULL AND date_max IS NOT NULL").select(
        *key, F.date_sub("date_min", margin).alias("lo"), F.date_add("date_max", margin).alias("hi"))
    rows = (matches.select(*key, "home", "away", T.fold("home").alias("home_key"), T.fold("away").alias("away_key"))
            .join(windows, list(key)).groupBy("home", "away", "home_key", "away_key", "lo", "hi").agg(F.count("*").alias("times")))
    flags = known.select("folded", F.lit(True).alias("known"))
    for side in ("home", "away"):
        rows = rows.join(flags.select(F.col("folded").alias(f"{side}_key"), F.col("known").alias(f"{side}_known")), f"{side}_key", "left")
    unknown = F.array_compact(F.array(
        F.when(F.col("home_known").isNull(), F.struct(F.col("home").alias("name"), F.lit("home").alias("role"))),
        F.when(F.col("away_known").isNull(), F.struct(F.col("away").alias("name"), F.lit("away").alias("role")))))
    return rows.select(F.explode(unknown).alias("u"), "home_key", "away_key", "lo", "hi", "times").select(
        "u.*", "home_key", "away_key", "lo", "hi", "times")


def window_votes(context: DataFrame, candidates: DataFrame, fixtures: DataFrame) -> DataFrame:
    """One vote per appearance whose substituted fixture falls in its window: ``name, folded, display, rank, votes``.

    The days of a pair are collected as a set, bounded by the calendar; a pair is looked up by equality.
    """
    days = fixtures.select("home_key", "away_key", "match_date").groupBy("home_key", "away_key").agg(
        F.collect_set("match_date").alias("days"))
    tried = context.join(candidates.select("name", "folded", "display", "rank"), "name")
    swapped = (tried.withColumn("home_key", F.when(F.col("role") == "home", F.col("folded")).otherwise(F.col("home_key")))
               .withColumn("away_key", F.when(F.col("role") == "away", F.col("folded")).otherwise(F.col("away_key"))))
    met = swapped.join(days, ["home_key", "away_key"]).where(F.expr("exists(days, d -> d between lo and hi)"))
    return met.groupBy("name", "folded", "display", "rank").agg(F.sum("times").alias("votes"))


def elect_by_window(context: DataFrame, votes: DataFrame, minimum: int = CONFIRMATIONS) -> DataFrame:
    """Best candidate per name: most votes, first candidate on ties; ``accepted`` from two votes on."""
    seen = context.groupBy("name").agg(F.sum("times").alias("appearances"))
    best = votes.groupBy("name").agg(F.max_by(F.struct("folded", "display", "votes"), F.struct("votes", -F.col("rank"))).alias("b"))
    votes_won = F.coalesce("b.votes", F.lit(0).cast("long"))
    return seen.join(best, "name", "left").select(
        "name", T.fold("name").alias("folded"), F.col("b.folded").alias("target"), F.col("b.display").alias("display"),
        votes_won.alias("confirmations"), "appearances", (votes_won >= minimum).alias("accepted"))


def day_index(fixtures: DataFrame) -> DataFrame:
    """``team, day, role`` -> number of fixtures and the only opponent with its score."""
    score = F.struct(F.col("goals_home").alias("home"), F.col("goals_away").alias("away"))
    sides = F.explode(F.array(
        F.struct(F.col("home_key").alias("team"), F.lit("home").alias("role"), F.col("away_key").alias("opponent")),
        F.struct(F.col("away_key").alias("team"), F.lit("away").alias("role"), F.col("home_key").alias("opponent")))).alias("s")
    return fixtures.select("match_date", score.alias("score"), sides).select(
        "s.*", F.col("match_date").alias("day"), "score").groupBy("team", "day", "role").agg(
        F.count("*").alias("n"), F.any_value(F.struct("opponent", "score")).alias("only"))


def exact_day_votes(matches: DataFrame, fixtures: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """Votes for unknown names from their opponent's only fixture that day, same role, same score.

    ``matches``: home, away, day, score_home, score_away. Gives ``name, appearances, target, votes``;
    target is null on the row of a name nobody voted for.
    """
    from poolspark.operators.matching import with_team_keys

    usable = matches.where("day IS NOT NULL AND score_home IS NOT NULL AND score_away IS NOT NULL")
    merged = usable.groupBy("home", "away", "day", "score_home", "score_away").agg(F.count("*").alias("times"))
    keyed = with_team_keys(merged, aliases)
    pairs = fixtures.select("home_key", "away_key").distinct()
    open_rows = keyed.join(pairs, ["home_key", "away_key"], "left_anti")
    known = (fixtures.select(F.explode(F.array("home_key", "away_key")).alias("team")).distinct().withColumn("k", F.lit(True)))
    for side in ("home", "away"):
        open_rows = open_rows.join(known.select(F.col("team").alias(f"{side}_key"), F.col("k").alias(f"{side}_known")), f"{side}_key", "left")
    side = (F.when(F.col("home_known") & F.col("away_known").isNull(), F.struct(
        F.col("home_key").alias("team"), F.lit("home").alias("role"), F.col("away").alias("name")))
        .when(F.col("away_known") & F.col("home_known").isNull(), F.struct(
            F.col("away_key").alias("team"), F.lit("away").alias("role"), F.col("home").alias("name"))))
    asked = open_rows.withColumn("s", side).where("s IS NOT NULL").select("s.*", "day", "score_home", "score_away", "times")
    met = asked.join(day_index(fixtures), ["team", "day", "role"], "left")
    agrees = ((F.col("n") == 1) & (F.col("only.score.home") == F.col("score_home"))
              & (F.col("only.score.away") == F.col("score_away")))
    counted = met.groupBy("name", F.when(agrees, F.col("only.opponent")).alias("target")).agg(F.sum("times").alias("votes"))
    seen = counted.groupBy("name").agg(F.sum("votes").alias("appearances"))
    return counted.join(seen, "name").select("name", "appearances", "target", "votes")


def elect_by_day(votes: DataFrame, minimum: int = CONFIRMATIONS, lead: int = LEAD) -> DataFrame:
    """Winner per name: at least two votes and three times the runner-up; refusals keep their best guess."""
    cast = votes.where("target IS NOT NULL")
    order = Window.partitionBy("name").orderBy(F.desc("votes"), "target")
    top = (cast.withColumn("r", F.row_number().over(order)).where("r <= 2").groupBy("name").agg(
        F.max("appearances").alias("appearances"), F.max(F.when(F.col("r") == 1, F.col("target"))).alias("target"),
        F.max(F.when(F.col("r") == 1, F.col("votes"))).alias("confirmations"),
        F.coalesce(F.max(F.when(F.col("r") == 2, F.col("votes"))), F.lit(0).cast("long")).alias("runner_up")))
    accepted = (F.col("confirmations") >= minimum) & (F.col("confirmations") >= F.col("runner_up") * lead)
    return top.select("name", T.fold("name").alias("folded"), "target", F.col("target").alias("display"), "confirmations",
                      "appearances", accepted.alias("accepted"))


def alias_rows(elected: DataFrame, via: str | None = None) -> DataFrame:
    """Accepted aliases, one per folded name (the best confirmed spelling)."""
    won = elected.where("accepted").groupBy("folded").agg(F.max_by(
        F.struct("target", "display", "confirmations", "appearances"), F.struct("confirmations", "name")).alias("b"))
    return won.select("folded", "b.*", F.lit(via).cast("string").alias("via"))


def alias_closure(matches: DataFrame, fixtures: DataFrame, seed: DataFrame | None = None) -> DataFrame:
    """Repeat the exact-day pass with the growing table until a round learns nothing; first value kept.

    One small checkpointed table per round bounds the plan. Every round but the last learns a name, so it ends.
    """
    matches, fixtures = cut_lineage(matches), cut_lineage(fixtures)
    learnt, table, turn = None, seed, 0
    while True:
        turn += 1
        found = alias_rows(elect_by_day(exact_day_votes(matches, fixtures, table)), BY_EXACT_DAY)
        fresh = found if learnt is None else found.join(learnt.select("folded"), "folded", "left_anti")
        fresh = cut_lineage(fresh.withColumn("round", F.lit(turn)))
        if fresh.isEmpty():
            break
        learnt = fresh if learnt is None else learnt.unionByName(fresh)
        # A later round overrides the seed, as a dictionary update does.
        pairs = learnt.select("folded", "target")
        table = pairs if seed is None else pairs.unionByName(seed.select("folded", "target").join(pairs, "folded", "left_anti"))
    empty = "folded string, target string, display string, confirmations bigint, appearances bigint, via string, round int"
    return learnt if learnt is not None else matches.sparkSession.createDataFrame([], empty)


def merge_passes(first: DataFrame, second: DataFrame) -> DataFrame:
    """First pass wins; ``conflict`` marks names on which the second one disagrees."""
    a = first.select("folded", F.struct("target", "display", "confirmations", "appearances", "via").alias("a"))
    b = second.select("folded", F.struct("target", "display", "confirmations", "appearances", "via").alias("b"))
    joined = a.join(b, "folded", "full_outer")
    conflict = F.coalesce(F.col("a.target") != F.col("b.target"), F.lit(False))
    return joined.select("folded", F.coalesce("a", "b").alias("x"), conflict.alias("conflict")).select("folded", "x.*", "conflict")


def remaining_refusals(refused: DataFrame, aliases: DataFrame) -> DataFrame:
    return refused.where(~F.col("accepted")).join(aliases.select("folded"), "folded", "left_anti")


def alias_coverage(aliases: DataFrame, refused: DataFrame) -> DataFrame:
    a = aliases.agg(F.count("*").alias("aliases"), F.coalesce(F.sum("appearances"), F.lit(0)).alias("recovered"))
    return a.select("*", refused.agg(F.count("*")).scalar().alias("refused"),
                    refused.agg(F.coalesce(F.sum("appearances"), F.lit(0))).scalar().alias("lost"))


def most_useful(aliases: DataFrame, top: int = TOP) -> DataFrame:
    return aliases.orderBy(F.desc("appearances"), "folded").limit(top)

