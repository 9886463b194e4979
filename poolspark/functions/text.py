"""String functions as Column builders; everything stays inside the JVM."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Club prefixes ignored when comparing team names word by word.
CLUB_WORDS = ["fc", "ac", "as", "sc", "cf", "sv", "afc", "cd", "ca", "rc", "us",
              "ss", "ssc", "aj", "og", "fk", "sk", "bk", "if", "de", "la", "le"]
# The spaces met in amounts (plain, no-break, narrow no-break, thin, figure).
AMOUNT_SPACES = "\u0020\u00a0\u202f\u2009\u2007"
# Upper bounds of a score, in free text and in its own cell.
MAX_GOALS_TEXT = 20
MAX_GOALS_CELL = 99

NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
SCORE = r"(?<!\d)(\d{1,2})[\s\p{Z}]*[-–][\s\p{Z}]*(\d{1,2})(?!\d)"


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def held(value: Column, of) -> Column:
    """``of`` a value worked out once: a lambda variable is not copied to where it is used."""
    return F.transform(F.array(value), of)[0]


@lru_cache(maxsize=1)
def _accent_map() -> tuple[str, str]:
    """Every character whose canonical decomposition is one base letter plus combining marks."""
    source, target = [], []
    for code in range(0xC0, 0x3000):
        char = chr(code)
        base = [c for c in unicodedata.normalize("NFD", char) if unicodedata.category(c) != "Mn"]
        if len(base) == 1 and base[0] != char:
            source.append(char)
            target.append(base[0])
    return "".join(source), "".join(target)


@lru_cache(maxsize=1)
def _compositions() -> dict[str, str]:
    """Every character that is a base and one combining mark, by those two: from the Unicode tables, exclusions left out."""
    out = {}
    for code in range(0xC0, 0x2000):
        char = chr(code)
        parts = unicodedata.normalize("NFD", char)
        for cut in range(1, len(parts)):
            base = unicodedata.normalize("NFC", parts[:cut])
            if len(base) == 1 and unicodedata.normalize("NFC", base + parts[cut:]) == char and len(parts) - cut == 1:
                out[base + parts[cut:]] = char
    return out


@lru_cache(maxsize=1)
def _marks() -> str:
    """The marks that can be joined, as ranges of a character class."""
    codes = sorted({ord(pair[1]) for pair in _compositions()})
    starts = [c for c in codes if c - 1 not in codes]
    ends = [c for c in codes if c + 1 not in codes]
    return "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in zip(starts, ends))


def _as_map(pairs: dict[str, str]) -> Column:
    return F.map_from_arrays(F.split(F.lit("\u0001".join(pairs)), "\u0001"), F.split(F.lit("\u0001".join(pairs.values())), "\u0001"))


def compose(text) -> Column:
    """Marks joined to the letter before them (canonical composition). Texts without marks cost one search.

    The different pairs of a text are replaced one after the other, as often as a letter can carry marks (three).
    """
    t = _col(text)
    table = _as_map(_compositions())
    mark = _marks()

    def once(whole: Column) -> Column:
        pairs = F.array_distinct(F.regexp_extract_all(whole, F.lit(f"([^{mark}][{mark}])"), F.lit(1)))
        return F.aggregate(pairs, whole, lambda done, pair: F.replace(done, pair, F.coalesce(F.try_element_at(table, pair), pair)))

    # Most texts are plain ASCII, which their length tells.
    return held(t, lambda t: F.when((F.octet_length(t) != F.length(t)) & t.rlike(f"[{mark}]"), held(held(once(t), once), once)).otherwise(t))


def decompose(text) -> Column:
    """Letters with one mark as letter and mark."""
    table = _as_map({v: k for k, v in _compositions().items()})
    return F.array_join(F.transform(F.split(_col(text), ""), lambda c: F.when(F.octet_length(c) == 1, c).otherwise(
        F.coalesce(F.try_element_at(table, c), c))), "")


def _without_accents(text: Column) -> Column:
    source, target = _accent_map()
    # Plain ASCII, which the length tells, has none.
    return F.when(F.octet_length(text) == F.length(text), text).otherwise(
        F.regexp_replace(F.translate(text, source, target), r"\p{Mn}+", ""))


def strip_accents(text) -> Column:
    """Lower case without accents; spaces and punctuation stay, null gives the empty string."""
    return F.lower(_without_accents(F.coalesce(_col(text), F.lit(""))))


def fold(name) -> Column:
    """Join key of a name: letters a-z and digits only; null gives the empty string.

    Letters without a canonical decomposition (ø, ł, ß) are dropped, not transliterated.
    """
    lowered = F.lower(F.trim(F.coalesce(_col(name), F.lit(""))))
    return F.regexp_replace(_without_accents(lowered), "[^a-z0-9]", "")


def tokens(name) -> Column:
    """Distinct words of a name without club prefixes."""
    words = F.split(F.replace(strip_accents(name), F.lit("-"), F.lit(" ")), r"[\s\p{Z}]+")
    stop = F.array(*[F.lit(w) for w in [*CLUB_WORDS, ""]])
    return F.array_except(words, stop)


def long_tokens(name, minimum: int = 4) -> Column:
    """Distinct alphanumeric runs of at least ``minimum`` characters."""
    words = F.split(strip_accents(name), "[^a-z0-9]+")
    return F.array_distinct(F.filter(words, lambda w: F.length(w) >= minimum))


def same_team(a, b) -> Column:
    """A long token in common, or one side without any long token."""
    return same_words(long_tokens(a), long_tokens(b))


def same_words(left: Column, right: Column) -> Column:
    """``same_team`` on the long tokens of both names."""
    return F.arrays_overlap(left, right) | (F.size(left) == 0) | (F.size(right) == 0)


def to_number(text: Column) -> Column:
    """Plain decimal text to double; anything else gives null."""
    return held(text, lambda t: F.when(t.rlike(NUMBER), t.try_cast("double")))


def parse_amount(text) -> Column:
    """Amount in either decimal convention; the last of ``.`` and ``,`` is the decimal mark."""
    bare = F.translate(_col(text), AMOUNT_SPACES, "")
    bare = F.trim(F.replace(F.replace(bare, F.lit("€"), F.lit("")), F.lit("EUR"), F.lit("")))
    # Distance from the end; a missing mark counts as infinitely far.
    from_end = F.reverse(bare)
    dot = F.nullif(F.instr(from_end, "."), F.lit(0))
    comma = F.nullif(F.instr(from_end, ","), F.lit(0))
    far = F.lit(1 << 30)
    dot, comma = F.coalesce(dot, far), F.coalesce(comma, far)
    plain = (F.when(dot < comma, F.replace(bare, F.lit(","), F.lit("")))
             .when(comma < dot, F.replace(F.replace(bare, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
             .otherwise(bare))
    return to_number(plain)


def clean_html_text(html) -> Column:
    """Text of a cell: tags dropped, three entities decoded, trimmed. Pages are composed (``compose``) before they are cut into cells."""
    text = F.regexp_replace(_col(html), r"<[^>]+>", "")
    for entity, char in (("&nbsp;", " "), ("&euro;", "€"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return F.regexp_replace(text, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def parse_amount_simple(html) -> Column:
    """Amount of an archive cell: tags, euro sign and spaces dropped, comma as decimal mark."""
    text = F.translate(clean_html_text(html), "€" + AMOUNT_SPACES, "")
    return to_number(F.replace(text, F.lit(","), F.lit(".")))


def score_candidates(text, maximum: int = MAX_GOALS_TEXT) -> Column:
    home = F.regexp_extract_all(F.coalesce(_col(text), F.lit("")), F.lit(SCORE), F.lit(1))
    away = F.regexp_extract_all(F.coalesce(_col(text), F.lit("")), F.lit(SCORE), F.lit(2))
    pairs = F.zip_with(home, away, lambda h, a: F.struct(h.cast("int").alias("home"), a.cast("int").alias("away")))
    return F.filter(pairs, lambda p: (p["home"] <= maximum) & (p["away"] <= maximum))


def extract_score(text, maximum: int = MAX_GOALS_TEXT) -> Column:
    """The only plausible score of a text as ``struct<home,away>``; null when none or several."""
    found = score_candidates(text, maximum)
    return F.when(F.size(found) == 1, found[0])


def season(url) -> Column:
    return F.regexp_extract(_col(url), r"/(\d{4}-\d{4})/", 1)


def too_old(url, floor) -> Column:
    """Season strictly before ``floor``; a missing season or floor never stops."""
    s, f = season(url), F.coalesce(_col(floor), F.lit(""))
    return (s != "") & (f != "") & (s < f)


def archive_key(url) -> Column:
    """``yyyy-nnnn`` key of an archive address, ``0000`` where the year is missing."""
    year = F.regexp_extract(_col(url), r"/(\d{4})-grille-", 1)
    number = F.regexp_extract(_col(url), r"grille-(\d+)", 1)
    width = F.greatest(F.lit(4), F.length(number))
    return F.concat(F.when(year == "", F.lit("0000")).otherwise(year), F.lit("-"), F.lpad(number, width, F.lit("0")))


def resolve(folded: Column, alias_target: Column) -> Column:
    """Alias where one is known, the folded name otherwise."""
    return F.coalesce(alias_target, folded)


def fixture_list(matches) -> Column:
    """``home-away · home-away``, ``?`` for a missing name."""
    unknown = F.lit("?")
    return F.array_join(
        F.transform(_col(matches), lambda m: F.concat(
            F.coalesce(m["home"], unknown), F.lit("-"), F.coalesce(m["away"], unknown))), " · ")


def display_date(day) -> Column:
    return F.date_format(_col(day), "dd/MM/yy")


def display_number(value, decimals: int = 0) -> Column:
    """French thousands: narrow spaces between groups and a comma as decimal mark."""
    return F.translate(F.format_number(_col(value), decimals), ",.", " ,")


def display_euro(value, decimals: int = 2) -> Column:
    return F.concat(display_number(value, decimals), F.lit(" €"))
