"""Semi-structured payloads: walking, market signatures, key inventory, governed fields."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from poolspark.functions.prices import SIGNATURE_MARGIN, SIGNATURE_MAX_NUMBERS, SIGNATURE_PRICE

# Levels opened: loops inside loops, so few turns are left over once all is open. More levels than parse_json accepts (1,000).
LOOPS = (16, 8, 8)

_NO_NODES = "cast(array() as array<struct<path:string,value:variant>>)"


def _opened(df: DataFrame, key: Sequence[str], payload: str, kept: str, kind: str, where: str = "true") -> DataFrame:
    """``key, path, kept``: an expression over every object ``c`` of a payload (``c.value``, ``c.members``), where ``n.kept`` is wanted."""
    level = _LEVEL.format(kept=f"filter(transform({_OBJECTS}, c -> named_struct('path', c.path, 'kept', {kept})), n -> {where})")
    for turns in reversed(LOOPS[1:]):
        level = f"aggregate(sequence(1, {turns}), s, (s, i) -> if(size(s.open) = 0, s, {level}))"
    start = f"""named_struct('done', cast(array() as array<struct<path:string,kept:{kind}>>),
      'open', array(named_struct('path', '', 'value', __payload)))"""
    nodes = f"""aggregate(sequence(1, {LOOPS[0]}), {start}, (s, i) -> if(size(s.open) = 0, s, {level}),
      s -> if(size(s.open) = 0, s.done, raise_error('payload nested too deep')))"""
    rows = df.select(*key, F.col(payload).alias("__payload")).select(*key, F.explode(F.expr(nodes)).alias("__node"))
    return rows.select(*key, "__node.path", "__node.kept")


def walk(df: DataFrame, key: Sequence[str], payload: str) -> DataFrame:
    """Every object of a variant payload with its path: ``key, path, object``.

    A payload is opened inside its own row, level by level, by one expression: values stay variants, nothing is
    shuffled or stored. Empty objects count, null, scalars and lists do not. A payload nested deeper than the
    product of ``LOOPS`` levels fails rather than losing objects.
    """
    return _opened(df, key, payload, "c.value", "variant").withColumnRenamed("kept", "object")


# One level: the objects among the open values are done, the members of objects and lists are open next.
_CELLS = """transform(s.open, x -> named_struct('path', x.path, 'value', x.value,
  'members', map_entries(try_variant_get(x.value, '$', 'map<string,variant>')),
  'items', try_variant_get(x.value, '$', 'array<variant>')))"""
_MEMBERS = """transform(c.members, e ->
  named_struct('path', if(c.path = '', e.key, concat(c.path, '.', e.key)), 'value', e.value))"""
_ITEMS = "transform(c.items, (v, i) -> named_struct('path', concat(c.path, '[', i, ']'), 'value', v))"
_OBJECTS = "filter(cells, c -> c.members is not null)"
# The cells are bound as the start of an empty sum, which is not copied as an element of an array would be.
_LEVEL = f"""aggregate(cast(array() as array<int>), {_CELLS}, (cells, i) -> cells, cells -> named_struct(
  'done', concat(s.done, {{kept}}), 'open', flatten(transform(cells, c -> coalesce({_MEMBERS}, {_ITEMS}, {_NO_NODES})))))"""


def _entries(obj: str) -> str:
    return f"map_entries(try_variant_get({obj}, '$', 'map<string,variant>'))"


def entries(obj: str) -> Column:
    """``array<struct<key,value variant>>`` of an object column."""
    return F.expr(_entries(obj))


def _triples(cells: str) -> str:
    """Every three numbers among the entries of an object. Objects with more than twelve candidates are not searched."""
    low, high = SIGNATURE_PRICE
    # The text of a number begins with a digit, nothing else's does; values are read only where there are three of them.
    digits = f"filter({cells}, e -> to_json(e.value) rlike '^[0-9]')"
    numbers = f"""filter(transform(filter(digits, e -> size(digits) >= 3), e -> named_struct(
      'k', e.key, 'v', try_variant_get(e.value, '$', 'double'))), e -> e.v between {low}D and {high}D)"""
    span = lambda a: f"if({a} > size(nums), slice(array(0), 1, 0), sequence({a}, size(nums)))"
    triples = f"""flatten(flatten(transform({span('1')}, i -> transform({span('i + 1')}, j -> transform({span('j + 1')}, k ->
      named_struct('a', nums[i - 1], 'b', nums[j - 1], 'c', nums[k - 1]))))))"""
    # The numbers are bound once; objects with too many or too few give no triple.
    return f"""flatten(transform(filter(transform(array({digits}), digits -> {numbers}),
      nums -> size(nums) between 3 and {SIGNATURE_MAX_NUMBERS}), nums -> {triples}))"""


def _markets(found: DataFrame, key: Sequence[str]) -> DataFrame:
    margin = 1 / F.col("t.a.v") + 1 / F.col("t.b.v") + 1 / F.col("t.c.v")
    return found.withColumn("m", margin).where(F.col("m").between(*SIGNATURE_MARGIN)).select(
        *key, *[F.col(f"t.{s}.k").alias(f"k{i}") for i, s in enumerate("abc", 1)],
        *[F.col(f"t.{s}.v").alias(f"v{i}") for i, s in enumerate("abc", 1)], F.round("m", 4).alias("margin"))


def market_triples(objects: DataFrame, key: Sequence[str], obj: str = "object") -> DataFrame:
    """Every three numbers of an object whose inverse prices look like a market.

    Objects with more than twelve candidate numbers are not searched, so an object yields at most
    220 combinations. ``k1, k2, k3, v1, v2, v3, margin``.
    """
    return _markets(objects.select(*key, F.explode(F.expr(_triples(_entries(obj)))).alias("t")), key)


def payload_markets(df: DataFrame, key: Sequence[str], payload: str) -> DataFrame:
    """``market_triples`` of every object of a payload, with its ``path``: objects are searched where they are opened."""
    number = "struct<k:string,v:double>"
    found = _opened(df, key, payload, _triples("c.members"), f"array<struct<a:{number},b:{number},c:{number}>>", "size(n.kept) > 0")
    return _markets(found.select(*key, "path", F.explode("kept").alias("t")), [*key, "path"])


def key_inventory(objects: DataFrame, obj: str = "object", by: Sequence[str] = ()) -> DataFrame:
    """Objects carrying each key and those where it is filled; null, empty text, list and object are empty."""
    rows = objects.select(*by, F.explode(entries(obj)).alias("e"))
    filled = ~F.to_json("e.value").isin("null", '""', "[]", "{}")
    return rows.groupBy(*by, F.col("e.key").alias("key")).agg(F.count("*").alias("present"), F.count_if(filled).alias("filled"))


def split_population(objects: DataFrame, members: DataFrame, key: Sequence[str]) -> DataFrame:
    """Adds ``member``: whether the object belongs to the pool asked for, before any counting."""
    marks = members.select(*key).distinct().withColumn("__m", F.lit(True))
    return objects.join(marks, list(key), "left").withColumn("member", F.col("__m").isNotNull()).drop("__m")


def residual(matches: str = "matchs", pool_field: str = "public_connu", match_field: str = "public") -> Column:
    """Governed fields still carried by an archive pool."""
    return F.expr(f"int({pool_field} is not null) + coalesce(size(filter({matches}, m -> m.{match_field} is not null)), 0)")


def drop_restricted(df: DataFrame, matches: str = "matchs", pool_field: str = "public_connu",
                    match_field: str = "public") -> DataFrame:
    """Remove the governed fields; ``removed`` counts them. A second run changes nothing."""
    match_fields = df.schema[matches].dataType.elementType.names
    if pool_field not in df.columns and match_field not in match_fields:
        return df.withColumn("removed", F.lit(0)) if "removed" not in df.columns else df.withColumn("removed", F.lit(0))
    return (df.withColumn("removed", residual(matches, pool_field, match_field))
            .withColumn(matches, F.transform(matches, lambda m: m.dropFields(match_field))).drop(pool_field))


def publishable(df: DataFrame, residuals: Column) -> bool:
    """Gate: no pool carries a governed field any more."""
    return df.where(residuals > 0).isEmpty()


def payloads_naming(payloads: DataFrame, body: str, names: Sequence[str], minimum: int = 2) -> DataFrame:
    """Payloads mentioning at least ``minimum`` of the names, with the names found, longest first."""
    listed = F.array(*[F.lit(n) for n in names])
    found = F.filter(listed, lambda n: F.contains(F.col(body), n))
    return (payloads.withColumn("found", found).where(F.size("found") >= minimum)
            .withColumn("length", F.length(body)).orderBy(F.desc("length")))


def largest_payloads(payloads: DataFrame, body: str, key: str, n: int = 15) -> DataFrame:
    """The ``n`` longest payloads; equal lengths by key."""
    return payloads.withColumn("length", F.length(body)).orderBy(F.desc("length"), key).limit(n)
