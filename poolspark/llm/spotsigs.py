"""Document fingerprints by SpotSigs, in DataFrame functions only (operator 3).

A signature is an anchor (a very common word) with the chain of up to two content words that follow it
before the next anchor. Where no anchor comes for long, every ``RUN`` further content words make a signature of
their own, so that lists and tables have some. A text without any signature falls back to its words. A fingerprint holds how many different signatures the text has and
all of their hashes in ascending order, so equal texts have equal fingerprints and different sets different ones.

Likeness is the Jaccard similarity of the whole signature sets. It is pruned by length first: sets of sizes a <= b reach
a / b at most, so where that is below ``least`` nothing is intersected and the bound itself is returned.

``alike`` is the join: sets are partitioned by length, so that a set meets only partitions whose lengths can reach
``least``, and are compared where their rarest signatures (as many as a pair that is alike must share one of) meet.

``with_next`` pairs every row with the next one in descending order of id without a window over the whole
table: rows are dealt by id range, and the largest id of each range is sent to the range above as well.

Defined results: a null text counts as empty; an empty text has no signatures, two empty sets are alike (1),
an empty and a non-empty one are not (0); a null id is below all others; rows of equal id follow each other in
order of text; a single row is its own next; an empty table gives no rows; other columns do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from poolspark.llm.store import shared_folder

# Frequent function words of English, German, French and Spanish.
ANCHORS = ("the of and to in is that for it as was with on be by at this from or an are which "
           "der die und den von zu das mit sich des auf für ist im dem nicht ein eine als auch "
           "le la les et des en un une du dans que est pour qui par sur pas au avec "
           "el los las y que de una por con para su se del lo como").split()
CHAIN = 2
RUN = 4


def _pattern() -> str:
    anchor = "(?:" + "|".join(sorted(set(ANCHORS), key=lambda w: (-len(w), w))) + ")"
    content = f"(?!{anchor}(?: |$))[^ ]+"
    chain = f"{anchor} {content}" + f"(?: {content})?" * (CHAIN - 1)
    return f"(?:^| )({chain}|{content}" + f"(?: {content})" * (RUN - 1) + ")"


def signatures(text: Column) -> Column:
    """All signatures of a text, or its words where there is none."""
    plain = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))
    found = F.regexp_extract_all(plain, F.lit(_pattern()), F.lit(1))
    words = F.regexp_extract_all(plain, F.lit("[^ ]+"), F.lit(0))
    return F.when(F.size(found) > 0, found).otherwise(words)


def fingerprint(sigs: Column) -> Column:
    """(n, kept): number of different signatures, and their hashes in ascending order."""
    hashes = F.array_sort(F.array_distinct(F.transform(sigs, lambda s: F.xxhash64(s))))
    return F.struct(F.size(hashes).alias("n"), hashes.alias("kept"))


def as_text(print_: Column) -> Column:
    """Number of signatures and their hashes in hexadecimal."""
    return F.concat_ws(":", print_["n"].cast("string"), F.array_join(F.transform(print_["kept"], lambda h: F.lpad(F.hex(h), 16, "0")), ""))


def likeness(a: Column, b: Column, least: float = 0.0) -> Column:
    """Jaccard similarity of two fingerprints (0 to 1), pruned where their lengths rule out ``least``."""
    bound = F.least(a["n"], b["n"]) / F.greatest(a["n"], b["n"])
    common = F.size(F.array_intersect(a["kept"], b["kept"]))
    return (F.when((a["n"] == 0) & (b["n"] == 0), F.lit(1.0)).when((a["n"] == 0) | (b["n"] == 0), F.lit(0.0))
            .when(bound < least, bound).otherwise(common / (a["n"] + b["n"] - common)))


def alike(docs: DataFrame, least: float = 0.5, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(a, b, likeness) of all pairs of different sets that reach ``least`` (between 0 and 1, both excluded).

    Rows of equal sets stand under the smallest id among them, so copies make no pairs; rows without id are left out.
    """
    if not 0 < least < 1:
        raise ValueError("least must lie between 0 and 1")
    spark, folder = docs.sparkSession, shared_folder(docs.sparkSession, "alike")

    def keep(df, name):
        df.write.parquet(f"file://{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"file://{folder}/{name}")

    rows = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), fingerprint(signatures(F.coalesce(F.col(text).cast("string"), F.lit("")))).alias("print"))
    sets = keep(rows.groupBy("print").agg(F.min("id").alias("id")).where("print.n > 0").select("id", "print"), "sets")
    part = lambda n: F.floor(F.log(n) / F.log(F.lit(1 / least))).cast("int")
    single = sets.select("id", F.col("print.n").alias("n"), F.explode("print.kept").alias("sig"))
    often = single.groupBy("sig").agg(F.count("*").alias("often"))
    # Rarest first; two sets that are alike share one of their first n - least * n + 1 signatures.
    ranked = single.join(often, "sig").groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("often", "sig"))).alias("s"))
    first = (F.col("n") - F.ceil(F.col("n") * least - 1e-9) + 1).cast("int")
    heads = keep(ranked.select("id", "n", F.explode(F.slice("s", F.lit(1), first)).alias("s")).select("id", "n", "s.sig"), "heads")
    short = heads.select(F.col("id").alias("a"), F.col("n").alias("na"), "sig", F.explode(F.sequence(part(F.col("n")), part(F.floor(F.col("n") / least + 1e-9)))).alias("part"))
    long = heads.select(F.col("id").alias("b"), F.col("n").alias("nb"), "sig", part(F.col("n")).alias("part"))
    later = (F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))
    pairs = short.join(long, ["sig", "part"]).where(later & (F.col("na") >= F.col("nb") * least - 1e-9)).select("a", "b").distinct()
    sides = [sets.select(F.col("id").alias(c), F.col("print").alias(f"print_{c}")) for c in "ab"]
    both = pairs.join(sides[0], "a").join(sides[1], "b")
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), likeness(F.col("print_a"), F.col("print_b"), least).alias("likeness")).where(
        F.col("likeness") >= least - 1e-9)


def with_next(docs: DataFrame, columns: list[str], key: str = "doc_id", order: str = "text") -> DataFrame:
    """Ranges hold 1,024 ids. Adds ``next_<column>``: the values of the next row in descending order of ``key``; after the last: the first."""
    spark = docs.sparkSession
    place = F.coalesce(F.col(key).cast("long"), F.lit(-2**63).cast("long"))
    ranged = docs.withColumn("__k", place).withColumn("__r", F.shiftright("__k", 10))
    # For every range: the largest id of the range below, and for the lowest one the largest of all.
    tops = ranged.groupBy("__r").agg(F.max("__k").alias("top"))
    folder = shared_folder(spark, "ranges")
    tops.write.parquet(f"file://{folder}/tops")
    tops = spark.read.parquet(f"file://{folder}/tops")
    upper = _above(tops)
    upper.write.parquet(f"file://{folder}/upper")
    # Its size is that of its files, so Spark broadcasts it only where it is small.
    upper = spark.read.parquet(f"file://{folder}/upper")
    # A top row goes to its own range and to those that need it; all other rows have no entry and stay.
    extra = F.when(F.col("needed").isNull(), F.array(F.struct(F.col("__r").alias("r"), F.lit(False).alias("x")))).otherwise(
        F.array(F.struct(F.col("__r").alias("r"), F.lit(False).alias("x")), F.struct(F.col("needed").alias("r"), F.lit(True).alias("x"))))
    dealt = (ranged.join(upper, ranged["__k"] == upper["top"], "left").withColumn("__e", F.explode(extra))
             .withColumn("__r", F.col("__e.r")).withColumn("__x", F.col("__e.x")).drop("__e", "needed", "top"))
    follow = Window.partitionBy("__r").orderBy(F.asc("__x"), F.desc("__k"), F.asc(order))
    out = dealt.select("*", *[F.lead(c).over(follow).alias(f"next_{c}") for c in columns])
    return out.where(~F.col("__x")).drop("__k", "__r", "__x")


def _above(tops: DataFrame) -> DataFrame:
    """(top, needed): the largest id of a range and the range that needs it."""
    from poolspark.scale import neighbours

    below = neighbours(tops, [], "__r", {"top": F.col("top")}, width=4096, levels=2).select("__r", "prev_top")
    most = tops.agg(F.max("top")).scalar()
    return below.select(F.coalesce(F.col("prev_top"), most).alias("top"), F.col("__r").alias("needed"))


def compare_edited(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Fingerprint of every text and of the text whose second half is replaced by the start of the next one's."""
    source = docs.select(F.col(key), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    source = source.withColumn("print", fingerprint(signatures(F.col("text"))))
    out = with_next(source, ["text", "print"], key)
    half = F.floor(F.length("text") / 2).cast("int")
    out = out.withColumn("n_chars", F.length("text").cast("long")).withColumn(
        "edited", F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next_text", F.lit(1), half)))
    return out.withColumn("edited_print", fingerprint(signatures(F.col("edited")))).drop("text", "next_text")
