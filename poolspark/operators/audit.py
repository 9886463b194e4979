"""Audit of page-form pools, duplicate contents, missing numbers, worklists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from poolspark.functions.prices import FLOAT_SLACK, HALF_CENT
from poolspark.scale import LEVELS, WIDTH, neighbours

# Longest run of missing numbers that counts as a hole; lines shown on screen.
HOLE_LIMIT = 20
SCREEN_ANOMALIES = 40
SCREEN_HOLES = 20
# Mandatory fields in the order they are tested, statuses, reasons of re-collection.
MANDATORY = ["grille_id", "grille_type", "statut", "matches", "rapports"]
CANCELLED_POOL, CANCELLED_MATCH = "annulee", "annule"
DISCARDED, MENTIONED, HOLES = "lignes écartées", "mention d'annulation", "trous"

_MATCH_RULES = [
    ("match sans nom d'équipe", "trim(coalesce(m.home, '')) = '' or trim(coalesce(m.away, '')) = ''", None),
    ("match annulé mais avec un score", "m.resultat = 'annule' and (m.score_home is not null or m.score_away is not null)", "cancelled"),
    ("match annulé sans tous_gagnants", "m.resultat = 'annule' and not coalesce(m.tous_gagnants, false)", "cancelled"),
    ("match sans score et non annulé", "m.score_home is null or m.score_away is null", "played"),
    ("résultat contraire au score", """not coalesce(m.resultat = case when m.score_home > m.score_away then '1'
       when m.score_away > m.score_home then '2' else 'N' end, false)""", "scored"),
]


def _anomaly(what: str, ord_: str = "cast(null as int)", detail: str = "cast(null as string)") -> str:
    quoted = what.replace("'", "\\'")
    return f"named_struct('what', '{quoted}', 'ord', {ord_}, 'detail', {detail})"


def _match_anomalies() -> str:
    """Anomalies of every match; a nameless match is not checked further."""
    named = "trim(coalesce(m.home, '')) != '' and trim(coalesce(m.away, '')) != ''"
    cancelled = "coalesce(m.resultat, '') = 'annule'"
    guards = {None: "true", "cancelled": f"{named} and {cancelled}", "played": f"{named} and not {cancelled}",
              "scored": f"{named} and not {cancelled} and m.score_home is not null and m.score_away is not null"}
    rows = ", ".join(f"if({guards[g]} and ({test}), {_anomaly(what, 'i')}, null)" for what, test, g in _MATCH_RULES)
    return f"flatten(transform(matches, (m, i) -> array({rows})))"


def _payout_anomalies() -> str:
    whole = "filter(rapports, r -> r.nombre_gagnants is not null and r.montant is not null)"
    total = f"aggregate({whole}, 0D, (a, r) -> a + r.nombre_gagnants * r.montant)"
    winners = f"aggregate({whole}, 0L, (a, r) -> a + r.nombre_gagnants)"
    allowed = f"({HALF_CENT}D * {winners} + {FLOAT_SLACK}D)"
    partial = f"""transform(rapports, r -> if(r.nombre_gagnants is null or r.montant is null,
      {_anomaly('rapport incomplet', detail='r.rang')}, null))"""
    gap = f"abs({total} - montant_distribue)"
    detail = f"""format_string('%.2f contre %.2f, écart %.2f pour un plafond de %.2f (%d gagnants)',
      {total}, montant_distribue, {gap}, {allowed}, {winners})"""
    wrong = _anomaly("somme des rapports ≠ montant distribué", detail=detail)
    return f"concat({partial}, array(if({gap} > {allowed}, {wrong}, null)))"


def anomalies(pools: DataFrame) -> DataFrame:
    """One row per violated rule: ``grille_type, grille_id, what, ord, detail``.

    All rules are expressions on the nested pool, so the audit is a single narrow pass. A missing
    mandatory field stops the checks of a pool, a settled pool without payouts stops before the sum.
    """
    missing = F.lit(None).cast("string")
    for field in reversed(MANDATORY):
        missing = F.when(F.col(field).isNull(), F.lit(f"champ « {field} » absent")).otherwise(missing)
    cancelled = f"""if(size(matches) > 0 or size(rapports) > 0,
      array({_anomaly('annulée mais listes non vides')}), slice(array({_anomaly('')}), 1, 0))"""
    unpaid = _anomaly("terminée mais sans rapports ni montant", detail="concat(size(rapports), ' rapport(s)')")
    money = f"if(size(rapports) = 0 or montant_distribue is null, array({unpaid}), {_payout_anomalies()})"
    full = F.expr(f"""case when missing is not null then array({_anomaly('').replace("'what', ''", "'what', missing")})
      when statut = '{CANCELLED_POOL}' then {cancelled}
      else concat({_match_anomalies()}, {money}) end""")
    return (pools.withColumn("missing", missing).withColumn("found", F.array_compact(full))
            .select("grille_type", "grille_id", F.explode("found").alias("a")).select("grille_type", "grille_id", "a.*"))


def summary(pools: DataFrame) -> DataFrame:
    """One line per type: number range, statuses, matches, cancelled, discarded lines, mentions."""
    return pools.groupBy("grille_type").agg(
        F.count("*").alias("pools"), F.min("grille_id").alias("first_id"), F.max("grille_id").alias("last_id"),
        F.count_if(F.col("statut") == "terminee").alias("settled"),
        F.count_if(F.col("statut") == CANCELLED_POOL).alias("cancelled_pools"),
        F.sum(F.greatest(F.coalesce(F.size("matches"), F.lit(0)), F.lit(0))).alias("matches"),
        F.sum(F.expr(f"coalesce(size(filter(matches, m -> m.resultat = '{CANCELLED_MATCH}')), 0)")).alias("cancelled"),
        F.sum(F.greatest(F.coalesce(F.size("lignes_ignorees"), F.lit(0)), F.lit(0))).alias("discarded"),
        F.count_if(F.col("mention_annulation").isNotNull()).alias("mentions"))


def duplicate_contents(pools: DataFrame) -> DataFrame:
    """Pools whose non-empty matches equal those of an earlier pool of the type, pointing at the first."""
    signed = pools.where(F.size("matches") > 0).select(
        "grille_type", "grille_id", F.sha2(F.to_json("matches"), 256).alias("signature"))
    firsts = signed.groupBy("grille_type", "signature").agg(
        F.min("grille_id").alias("first_id"), F.count("*").alias("copies")).where("copies > 1")
    return (signed.join(firsts, ["grille_type", "signature"]).where("grille_id != first_id")
            .select("grille_type", "grille_id", "first_id"))


def gaps(df: DataFrame, group: Sequence[str], key: str, limit: int = HOLE_LIMIT, *, width: int = WIDTH,
         levels: int = LEVELS) -> DataFrame:
    """Runs of missing numbers: ``first_missing, last_missing, length, hole`` (short runs are holes)."""
    ids = df.select(*group, key).distinct()
    near = neighbours(ids, group, key, {"id": F.col(key)}, width=width, levels=levels)
    length = F.col("next_id") - F.col(key) - 1
    return near.where(length > 0).select(
        *group, (F.col(key) + 1).alias("first_missing"), (F.col("next_id") - 1).alias("last_missing"),
        length.alias("length"), (length <= limit).alias("hole"))


def gap_summary(runs: DataFrame, group: Sequence[str]) -> DataFrame:
    return runs.groupBy(*group, "hole").agg(F.count("*").alias("runs"), F.sum("length").alias("missing"))


def missing_ids(runs: DataFrame, group: Sequence[str]) -> DataFrame:
    """Every missing number inside a hole; long runs stay ranges."""
    return runs.where("hole").select(*group, F.explode(F.sequence("first_missing", "last_missing")).alias("missing_id"))


def worklist(pools: DataFrame, holes: DataFrame) -> DataFrame:
    """``grille_type, reason, grille_id`` to collect again."""
    marks = F.array_compact(F.array(
        F.when(F.size("lignes_ignorees") > 0, F.lit(DISCARDED)), F.when(F.col("mention_annulation").isNotNull(), F.lit(MENTIONED))))
    seen = pools.select("grille_type", "grille_id", F.explode(marks).alias("reason"))
    return seen.unionByName(holes.select("grille_type", F.col("missing_id").alias("grille_id"), F.lit(HOLES).alias("reason")))


def screen(rows: DataFrame, lines: int, *order: str) -> DataFrame:
    """Shown part of a report; the full report is the unlimited frame."""
    return rows.orderBy(*order).limit(lines)


def is_clean(rows: DataFrame) -> bool:
    return rows.isEmpty()


def availability(pools: DataFrame, filled: Column, group: Sequence[str], key: str, year: Column) -> DataFrame:
    """Share of pools where a field is filled and the number range it covers, per group and year."""
    return pools.withColumn("year", year).withColumn("__f", filled).groupBy(*group, "year").agg(
        F.count("*").alias("pools"), (F.count_if("__f") / F.count("*")).alias("filled_share"),
        F.min(F.when(F.col("__f"), F.col(key))).alias("first_filled"), F.max(F.when(F.col("__f"), F.col(key))).alias("last_filled"))
