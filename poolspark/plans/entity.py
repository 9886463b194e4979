from pyspark.sql import functions as F

from poolspark.functions import text as T
from poolspark.operators import entity as E
from poolspark.operators import matching as J
from poolspark.plans.registry import query
from poolspark.session import cut_lineage
from poolspark.sources import views as V

# The external source renames a quarter of the away clubs and a fifth of the home teams.
RENAMED_SQL = V.POOLS_SQL + "," + V.EXT_SQL + """,
src AS (SELECT *, lower(replace(strip_accents(home), ' ', '')) AS hk, lower(replace(away, ' ', '')) AS ak FROM legs),
fx AS (
  SELECT CASE WHEN CAST(replace(home_name, 'Équipe ', '') AS INT) % 5 = 0 THEN 'team' || replace(home_name, 'Équipe ', '')
    ELSE 'equipe' || replace(home_name, 'Équipe ', '') END AS hk,
    CASE WHEN CAST(replace(away_name, 'Club ', '') AS INT) % 4 = 0 THEN 'klub' || replace(away_name, 'Club ', '')
    ELSE 'club' || replace(away_name, 'Club ', '') END AS ak, match_date, goals_home AS gh, goals_away AS ga FROM ext),
teams AS (SELECT hk AS t FROM fx UNION SELECT ak FROM fx)"""


def renamed_fixtures(spark, sf):
    number = lambda c: F.regexp_extract(c, r"(\d+)$", 1)
    rows = V.ext_fixtures(spark, sf).select(
        F.when(number("home_name").cast("int") % 5 == 0, F.concat(F.lit("Team "), number("home_name")))
        .otherwise(F.col("home_name")).alias("home_name"),
        F.when(number("away_name").cast("int") % 4 == 0, F.concat(F.lit("Klub "), number("away_name")))
        .otherwise(F.col("away_name")).alias("away_name"),
        "match_date", "goals_home", "goals_away")
    return J.with_team_keys(rows, home="home_name", away="away_name")


def day_matches(spark, sf):
    return V.legs(spark, sf).select("home", "away", F.col("kickoff").alias("day"), "score_home", "score_away")


DAY_SQL = RENAMED_SQL + """,
side AS (SELECT hk AS team, match_date AS day, 'home' AS role, ak AS opponent, gh, ga FROM fx
  UNION ALL SELECT ak, match_date, 'away', hk, gh, ga FROM fx),
sole AS (SELECT team, day, role, count(*) AS n, any_value(opponent) AS opponent, any_value(gh) AS gh, any_value(ga) AS ga
  FROM side GROUP BY 1, 2, 3),
asked AS (
  SELECT *, CASE WHEN hk IN (SELECT t FROM teams) AND ak NOT IN (SELECT t FROM teams) THEN 'home'
    WHEN ak IN (SELECT t FROM teams) AND hk NOT IN (SELECT t FROM teams) THEN 'away' END AS role
  FROM src WHERE score_home IS NOT NULL AND (hk, ak) NOT IN (SELECT (hk, ak) FROM fx)),
cast_votes AS (
  SELECT CASE a.role WHEN 'home' THEN away ELSE home END AS name, CASE WHEN o.n = 1 AND o.gh = a.score_home AND o.ga = a.score_away
    THEN o.opponent END AS target
  FROM asked a LEFT JOIN sole o ON o.team = CASE a.role WHEN 'home' THEN a.hk ELSE a.ak END AND o.day = a.kickoff AND o.role = a.role
  WHERE a.role IS NOT NULL),
tally AS (SELECT name, target, count(*) AS votes, CAST(sum(count(*)) OVER (PARTITION BY name) AS BIGINT) AS appearances
  FROM cast_votes GROUP BY 1, 2)"""


@query("exact_day_votes", ctes=DAY_SQL, sql="SELECT name, appearances, target, votes FROM tally")
def exact_day_votes(spark, sf):
    return E.exact_day_votes(day_matches(spark, sf), renamed_fixtures(spark, sf))


@query("alias_votes", ctes=DAY_SQL + """,
placed AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY votes DESC, target) AS r FROM tally WHERE target IS NOT NULL)""",
       sql="""
SELECT name, max(target) FILTER (r = 1) AS target, max(votes) FILTER (r = 1) AS confirmations, max(appearances) AS appearances,
  max(votes) FILTER (r = 1) >= 2 AND max(votes) FILTER (r = 1) >= 3 * coalesce(max(votes) FILTER (r = 2), 0) AS accepted
FROM placed WHERE r <= 2 GROUP BY 1""")
def alias_votes(spark, sf):
    votes = E.exact_day_votes(day_matches(spark, sf), renamed_fixtures(spark, sf))
    return E.elect_by_day(votes).select("name", "target", "confirmations", "appearances", "accepted")


ELECTED_SQL = DAY_SQL + """,
placed AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY votes DESC, target) AS r FROM tally WHERE target IS NOT NULL),
elected AS (
  SELECT lower(replace(strip_accents(name), ' ', '')) AS folded, max(target) FILTER (r = 1) AS target, max(appearances) AS appearances,
    max(votes) FILTER (r = 1) AS confirmations,
    max(votes) FILTER (r = 1) >= 2 AND max(votes) FILTER (r = 1) >= 3 * coalesce(max(votes) FILTER (r = 2), 0) AS accepted
  FROM placed WHERE r <= 2 GROUP BY name)"""


def elected(spark, sf):
    return E.elect_by_day(E.exact_day_votes(day_matches(spark, sf), renamed_fixtures(spark, sf)))


@query("alias_coverage", ctes=ELECTED_SQL, sql="""
SELECT count(*) FILTER (accepted) AS aliases, CAST(coalesce(sum(appearances) FILTER (accepted), 0) AS BIGINT) AS recovered,
  count(*) FILTER (NOT accepted) AS refused, CAST(coalesce(sum(appearances) FILTER (NOT accepted), 0) AS BIGINT) AS lost FROM elected""")
def alias_coverage(spark, sf):
    rows = elected(spark, sf)
    aliases = E.alias_rows(rows, E.BY_EXACT_DAY)
    return E.alias_coverage(aliases, E.remaining_refusals(rows, aliases))


@query("most_useful_aliases", ctes=ELECTED_SQL, sql="""
SELECT folded, target, confirmations, appearances FROM elected WHERE accepted ORDER BY appearances DESC, folded LIMIT 12""")
def most_useful_aliases(spark, sf):
    return E.most_useful(E.alias_rows(elected(spark, sf))).select("folded", "target", "confirmations", "appearances")


@query("alias_fixpoint")
def alias_fixpoint(spark, sf):
    return E.alias_closure(day_matches(spark, sf), renamed_fixtures(spark, sf))


# Windows of a week around the kickoff month; two spellings are tried per unknown name.
WINDOW_SQL = RENAMED_SQL + """,
ctx AS (
  SELECT unnest([CASE WHEN hk NOT IN (SELECT t FROM teams) THEN 'home' END, CASE WHEN ak NOT IN (SELECT t FROM teams) THEN 'away' END])
    AS role, home, away, hk, ak, kickoff FROM src),
named AS (SELECT *, CASE role WHEN 'home' THEN home ELSE away END AS name FROM ctx WHERE role IS NOT NULL),
tried AS (
  SELECT n.*, c.k AS rank, CASE role WHEN 'home' THEN 'team' ELSE 'klub' END || CASE c.k WHEN 0 THEN
    CAST(regexp_extract(name, '[0-9]+') AS INT) + 5 ELSE CAST(regexp_extract(name, '[0-9]+') AS INT) END AS cand
  FROM named n, range(0, 2) c(k)),
won AS (
  SELECT name, cand, rank, count(*) AS votes FROM tried t WHERE EXISTS (SELECT 1 FROM fx f
    WHERE f.hk = CASE role WHEN 'home' THEN cand ELSE t.hk END AND f.ak = CASE role WHEN 'away' THEN cand ELSE t.ak END
      AND f.match_date BETWEEN t.kickoff - INTERVAL 4 DAY AND t.kickoff + INTERVAL 5 DAY) GROUP BY 1, 2, 3),
top AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY votes DESC, rank) AS r FROM won),
seen AS (SELECT name, count(*) AS appearances FROM named GROUP BY 1)"""


def window_contexts(spark, sf, fixtures=None):
    matches = V.legs(spark, sf).select("pool_id", "line", "home", "away", "kickoff")
    dated = matches.select("pool_id", "line", F.date_sub("kickoff", 1).alias("date_min"), F.date_add("kickoff", 2).alias("date_max"))
    known = E.distinct_names(renamed_fixtures(spark, sf) if fixtures is None else fixtures, ["match_date"])
    return E.contexts(matches, known, dated, ["pool_id", "line"])


@query("window_votes", ctes=WINDOW_SQL, sql="""
SELECT s.name, t.cand AS target, coalesce(t.votes, 0) AS confirmations, s.appearances, coalesce(t.votes, 0) >= 2 AS accepted
FROM seen s LEFT JOIN top t ON t.name = s.name AND t.r = 1""")
def window_votes(spark, sf):
    context = window_contexts(spark, sf)
    number = F.regexp_extract("name", r"(\d+)$", 1).cast("int")
    stem = F.when(F.col("role") == "home", "team").otherwise("klub")
    spellings = F.posexplode(F.array((number + 5).cast("string"), number.cast("string"))).alias("rank", "n")
    candidates = context.select("name", "role").distinct().select("name", stem.alias("stem"), spellings).select(
        "name", F.concat("stem", "n").alias("folded"), F.concat("stem", "n").alias("display"), "rank")
    votes = E.window_votes(context, candidates, renamed_fixtures(spark, sf))
    return E.elect_by_window(context, votes).select("name", "target", "confirmations", "appearances", "accepted")


@query("alias_merge", ctes=DAY_SQL.replace("tally AS", "day_tally AS") + "," + WINDOW_SQL.split(RENAMED_SQL + ",")[1] + """,
p1 AS (SELECT lower(replace(strip_accents(s.name), ' ', '')) AS folded, t.cand AS target, s.appearances, t.votes
  FROM seen s JOIN top t ON t.name = s.name AND t.r = 1 WHERE t.votes >= 2),
placed AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY votes DESC, target) AS r FROM day_tally WHERE target IS NOT NULL),
p2 AS (SELECT lower(replace(strip_accents(name), ' ', '')) AS folded, max(target) FILTER (r = 1) AS target,
    max(appearances) AS appearances, max(votes) FILTER (r = 1) AS votes FROM placed WHERE r <= 2 GROUP BY name
  HAVING max(votes) FILTER (r = 1) >= 2 AND max(votes) FILTER (r = 1) >= 3 * coalesce(max(votes) FILTER (r = 2), 0))""", sql="""
SELECT coalesce(p1.folded, p2.folded) AS folded, coalesce(p1.target, p2.target) AS target,
  CASE WHEN p1.folded IS NOT NULL THEN p1.votes ELSE p2.votes END AS confirmations,
  CASE WHEN p1.folded IS NOT NULL THEN p1.appearances ELSE p2.appearances END AS appearances,
  CASE WHEN p1.folded IS NULL THEN 'date_exacte' END AS via, coalesce(p1.target <> p2.target, FALSE) AS conflict
FROM p1 FULL JOIN p2 ON p1.folded = p2.folded""")
def alias_merge(spark, sf):
    # Both passes read fixtures and contexts several times: stored once, they are derived once.
    fixtures = cut_lineage(renamed_fixtures(spark, sf))
    context = cut_lineage(window_contexts(spark, sf, fixtures))
    number = F.regexp_extract("name", r"(\d+)$", 1).cast("int")
    stem = F.when(F.col("role") == "home", "team").otherwise("klub")
    spellings = F.posexplode(F.array((number + 5).cast("string"), number.cast("string"))).alias("rank", "n")
    candidates = context.select("name", "role").distinct().select("name", stem.alias("stem"), spellings).select(
        "name", F.concat("stem", "n").alias("folded"), F.concat("stem", "n").alias("display"), "rank")
    first = E.alias_rows(E.elect_by_window(context, E.window_votes(context, candidates, fixtures)))
    second = E.alias_rows(E.elect_by_day(E.exact_day_votes(day_matches(spark, sf), fixtures)), E.BY_EXACT_DAY)
    return E.merge_passes(first, second).drop("display")


def _dictionary(spark, sf):
    parts = V.table(spark, sf, "part").select(
        "p_partkey", F.concat_ws(" ", F.initcap("p_name"), "p_type", F.col("p_size").cast("string")).alias("display"))
    return parts.groupBy(T.fold("display").alias("folded")).agg(
        F.min_by("display", "p_partkey").alias("display"), F.struct(F.min("p_partkey").alias("part")).alias("first"))


@query("name_candidates")
def name_candidates(spark, sf):
    """Corrupted spellings of all names against the names themselves."""
    typed = F.concat_ws(" ", F.lit("FC"), "p_name", "p_type", (F.col("p_size") + 1).cast("string"))
    odd = V.table(spark, sf, "part").select(F.translate(typed, "eo", "éô").alias("name"))
    return E.name_candidates(odd, _dictionary(spark, sf))
