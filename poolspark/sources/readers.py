"""Scans. Every reader gives a frame of a fixed schema; a missing table is an empty frame."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.utils import AnalysisException

from poolspark import schemas
from poolspark.functions import categories as C
from poolspark.functions import dates as D
from poolspark.functions import prices as P
from poolspark.functions import text as T

CORRUPT = "_corrupt_record"
# Price columns of the league files per source; the mojibake byte-order mark.
PRICE_COLUMNS = {"pinnacle_cloture": ("PSCH", "PSCD", "PSCA"), "pinnacle": ("PSH", "PSD", "PSA"),
                 "bet365_cloture": ("B365CH", "B365CD", "B365CA"), "bet365": ("B365H", "B365D", "B365A")}
CELLS = ["HomeTeam", "Home", "AwayTeam", "Away", "Date", "FTHG", "HG", "FTAG", "AG", "Div", "Country", "League",
         *[c for trio in PRICE_COLUMNS.values() for c in trio]]
BYTE_ORDER_MARKS = ["\u00ef\u00bb\u00bf", "\ufeff"]
CUP_SOURCE = "cups"


def lookup(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """A parquet lookup table, or an empty frame of its schema where it does not exist yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def feed_pools(spark: SparkSession, path: str) -> DataFrame:
    """Feed-form pool documents, one JSON object per line."""
    return spark.read.schema(schemas.POOL).json(path)


def page_pools(spark: SparkSession, path: str, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """Page-form pools and, beside them, the files (or ``lines``, one object each) that could not be read."""
    raw = (spark.read.schema(schemas.PAGE_POOL + f", {CORRUPT} string").option("multiLine", not lines)
           .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).json(path)
           .withColumn("file", F.input_file_name()))
    # Spark refuses a scan that reads nothing but the corrupt column: the number is read beside it.
    told = F.concat(F.coalesce(F.col("grille_id").cast("string"), F.lit("")), F.col(CORRUPT))
    bad = raw.where(F.length(told) > 0).select("file", F.lit("fichier illisible").alias("what"), F.col(CORRUPT).alias("detail"))
    return raw.where(F.col(CORRUPT).isNull()).drop(CORRUPT, "file"), bad


def archive_pools(spark: SparkSession, path: str) -> DataFrame:
    """Archive-form pool documents, one JSON object per line."""
    return spark.read.schema(schemas.ARCHIVE_POOL).json(path)


def frames(spark: SparkSession, path: str) -> DataFrame:
    """Captured socket frames, one per line, with ``seq``: file by age and name, then the place within the file.

    The place is the start of the split and the row within it, so it does not depend on how files are packed into tasks.
    """
    seq = F.struct(F.col("_metadata.file_modification_time").alias("written"), F.col("_metadata.file_path").alias("file"),
                   F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("row"))
    return spark.read.text(path).select(seq.alias("seq"), F.col("value").alias("body"))


def raw_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("page_id", "url", "html")


def frame_stream(spark: SparkSession, path: str) -> DataFrame:
    """The same as a stream: files are read whole as they appear, ``seq`` is the file by age and name and the line in it."""
    files = spark.readStream.option("wholetext", True).text(path).select(
        F.col("_metadata.file_modification_time").alias("written"), F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\n")).alias("line", "body"))
    return files.where("body != ''").select(F.struct("written", "file", "line").alias("seq"), "body")


def snapshots(spark: SparkSession, path: str) -> DataFrame:
    """Every past version of the price table ``writers.price_table`` keeps at ``path``, with its ``version``; sort by it for oldest first."""
    return lookup(spark, f"{path}/log", schemas.SNAPSHOT + ", version int, bucket int").drop("bucket")


def league_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of the league files with their file and the place of their split: ``path, at, line``.

    Files are read whole lines at a time in Latin-1, large ones in splits.
    """
    text = spark.read.option("encoding", "ISO-8859-1").option("header", False).option("sep", "\u0001").option("quote", "").schema("line string").csv(path)
    return text.select(F.input_file_name().alias("path"), F.col("_metadata.file_block_start").alias("at"), "line").where("line IS NOT NULL")


def file_headers(lines: DataFrame) -> DataFrame:
    """One row per file with lines: ``path, header``; null where no line of its first split names the teams and the date.

    Only first splits are read for it, reduced map-side, so the largest file costs one split.
    """
    named = F.col("line").contains("Date,") & F.col("line").rlike("(^|,)(HomeTeam|Home)(,|$)")
    return lines.where("at = 0").groupBy("path").agg(F.first(F.when(named, F.col("line")), ignorenulls=True).alias("header"))


def unrecognised_files(lines: DataFrame) -> DataFrame:
    """Report of the files no line of which can be read: ``file, what, detail`` (the first line)."""
    heads = file_headers(lines).where("header IS NULL").select("path")
    first = lines.where("at = 0").groupBy("path").agg(F.first("line").alias("detail"))
    return first.join(heads, "path").select(F.col("path").alias("file"), F.lit("en-tête non reconnu").alias("what"), "detail")


def fixture_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of the league files with the header of their own file: ``path, header, line``.

    Empty files give nothing, files whose header is not recognised are rows of ``unrecognised_files``. The headers are one
    short row per file, a table Spark sends to every task as long as it is small; beyond that a large file is split in the join.
    """
    lines = league_lines(spark, path)
    headers = file_headers(lines).where("header IS NOT NULL")
    return lines.join(headers, "path").where(F.col("line") != F.col("header")).select("path", "header", "line")


def parse_fixture_lines(lines: DataFrame) -> DataFrame:
    """Fixtures from ``path, header, line``: each line is read by the header of its own file.

    Columns are found by name through the position in the header, so files of different dialects
    mix freely; rows without teams or a date are left out. One narrow pass.
    """
    header = F.col("header")
    for mark in BYTE_ORDER_MARKS:
        header = F.replace(header, F.lit(mark), F.lit(""))
    # Quoted cells are rare; only lines with a quote pay for the lookahead.
    quoted = F.transform(F.split("line", ',(?=(?:[^"]*"[^"]*")*[^"]*$)', -1), lambda c: F.replace(
        F.regexp_replace(c, '^"|"$', ""), F.lit('""'), F.lit('"')))
    plain = F.when(F.contains("line", F.lit('"')), quoted).otherwise(F.split("line", ",", -1))
    names = F.transform(F.split(F.regexp_replace(header, "[\r\n]", ""), ",", -1), F.trim)
    wanted = F.array(*[F.lit(n) for n in CELLS])
    # Header and line are split once and every cell is looked up once, in lambda variables. The row is a generated one, so
    # conditions on its cells are not moved below it, where each would split header and line again.
    found = F.transform(F.array(F.struct(names.alias("h"), plain.alias("c"))), lambda x: F.transform(
        wanted, lambda n: F.nullif(F.get(x["c"], F.array_position(x["h"], n).cast("int") - 1), F.lit(""))))
    rows = lines.select("path", F.explode(found).alias("__c"))

    def cell(*names):
        return F.coalesce(*[F.get("__c", F.lit(CELLS.index(n))) for n in names])

    named = rows.select(
        "path", cell("HomeTeam", "Home").alias("home_name"), cell("AwayTeam", "Away").alias("away_name"),
        D.parse_league_date(cell("Date")).alias("match_date"), cell("FTHG", "HG").try_cast("int").alias("gh"),
        cell("FTAG", "AG").try_cast("int").alias("ga"), C.competition(cell("Div"), cell("Country"), cell("League")).alias("competition"),
        *[P.parse_price(cell(c)).alias(c) for trio in PRICE_COLUMNS.values() for c in trio])
    return _fixture_rows(named, "path").where("home_name IS NOT NULL AND away_name IS NOT NULL AND match_date IS NOT NULL")


def _fixture_rows(named: DataFrame, *keep: str) -> DataFrame:
    options = []
    for source, trio in PRICE_COLUMNS.items():
        value = F.struct(*[F.col(c).alias(n) for c, n in zip(trio, ("p1", "px", "p2"))])
        options.append(F.when(P.plausible_market(*trio), F.struct(F.lit(source).alias("key"), value.alias("value"))))
    scored = F.col("gh").isNotNull() & F.col("ga").isNotNull()
    return named.select(
        *keep, "home_name", "away_name", T.fold("home_name").alias("home_key"), T.fold("away_name").alias("away_key"), "match_date",
        F.when(scored, F.col("gh")).alias("goals_home"), F.when(scored, F.col("ga")).alias("goals_away"),
        F.map_from_entries(F.array_compact(F.array(*options))).alias("prices"), "competition")


def league_fixtures(spark: SparkSession, path: str) -> DataFrame:
    return parse_fixture_lines(fixture_lines(spark, path)).drop("path")


def fixture_days(fixtures: DataFrame) -> DataFrame:
    """Light form: pair and day only; the scan behind it reads no other column."""
    return fixtures.select("home_key", "away_key", "match_date")


def cup_fixtures(rows: DataFrame) -> DataFrame:
    """Cup rows to the fixture shape; the trio is kept when all three prices exceed one."""
    trio = [P.parse_price(c) for c in ("H", "D", "A")]
    price = F.struct(*[t.alias(n) for t, n in zip(trio, ("p1", "px", "p2"))])
    whole = trio[0].isNotNull() & trio[1].isNotNull() & trio[2].isNotNull()
    home, away = F.col("FTHG").try_cast("int"), F.col("FTAG").try_cast("int")
    scored = home.isNotNull() & away.isNotNull()
    return rows.select(
        F.col("homeTeam").alias("home_name"), F.col("awayTeam").alias("away_name"), T.fold("homeTeam").alias("home_key"),
        T.fold("awayTeam").alias("away_key"), D.parse_cup_date("matchDate").alias("match_date"),
        F.when(scored, home).alias("goals_home"), F.when(scored, away).alias("goals_away"),
        F.map_from_entries(F.array_compact(F.array(F.when(whole, F.struct(F.lit(CUP_SOURCE), price))))).alias("prices"),
        F.col("League").alias("competition")).where("match_date IS NOT NULL")


def cup_files(spark: SparkSession, path: str) -> DataFrame:
    fields: Sequence[str] = ("id", "matchDate", "homeTeam", "awayTeam", "FTHG", "FTAG", "H", "D", "A", "League")
    raw = spark.read.schema(", ".join(f"{f} string" for f in fields)).option("multiLine", True).json(path)
    return cup_fixtures(raw)
