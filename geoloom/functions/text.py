"""Text functions: accent folding, tokens, overlays, names, sizes, dates and digests.

Column functions throughout but for fuzzy_ratio, an Arrow UDF: Spark has no matching-blocks similarity.
"""

from __future__ import annotations

import json
import unicodedata
from difflib import SequenceMatcher
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from .geo import col

#: Words that say nothing about a place.
STOP_WORDS = (
    "street", "st", "road", "rd", "avenue", "ave", "lane", "way", "drive", "rue", "strasse", "strase", "platz", "via", "calle", "plaza",
    "the", "de", "la", "le", "el", "du", "des", "and", "of", "station", "park", "school", "church", "hotel", "bar", "cafe", "restaurant", "shop",
)
#: Letters that optical readers take for digits, and those digits.
MISREAD, READ = "oOlISB", "001158"
#: A hemisphere letter, degrees and a decimal part.
OVERLAY = r"(?i)([NSEW])\s*([0-9oOlIB]{1,3})[.,\s]{1,3}([0-9oOlIB]{3,8})"


@lru_cache(maxsize=1)
def _folding() -> tuple[str, str, dict[str, str]]:
    """Every character whose compatibility form has letters or digits under its accents: those with one and that letter, and those with several."""
    source, target, several = [], [], {}
    for i in range(0x80, 0x20000):
        if 0xD800 <= i < 0xE000:
            continue
        plain = "".join(c for c in unicodedata.normalize("NFKD", chr(i)) if not unicodedata.combining(c))
        if plain != chr(i) and any(c.isascii() and c.isalnum() for c in plain):
            if len(plain) == 1:
                source.append(chr(i))
                target.append(plain)
            else:
                several[chr(i)] = plain
    return "".join(source), "".join(target), several


def fold(s: Column | str) -> Column:
    """Lower case without accents, compatibility forms as their letters (ligatures, full width, fractions), runs of anything but letters and digits as one space."""
    source, target, several = _folding()
    table = _map(several)
    # Combining marks vanish; what has no plain letter becomes a space with the rest. ASCII needs none of this.
    spelled = let_text(col(s), lambda t: F.when(t.rlike(_ranges(several)), F.array_join(F.transform(F.split(t, ""), lambda c: F.coalesce(F.try_element_at(table, c), c)), "")).otherwise(t))
    plain = let_text(spelled, lambda t: F.when(t.rlike("[^\\x00-\\x7F]"), F.translate(F.regexp_replace(t, r"\p{M}", ""), source, target)).otherwise(t))
    return F.trim(F.regexp_replace(F.lower(plain), "[^a-z0-9]+", " "))


def _ranges(chars: dict[str, str], gap: int = 64) -> str:
    """A short pattern for characters that may be among these: stretches of code points, with the gaps between near ones."""
    out: list[list[str]] = []
    for c in sorted(chars):
        if out and ord(c) - ord(out[-1][1]) <= gap:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "[" + "".join(f"{a}-{b}" for a, b in out) + "]"


def let_text(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _map(pairs: dict[str, str]) -> Column:
    """A literal map: a constant that the optimiser parses once."""
    return F.from_json(F.lit(json.dumps(pairs)), "map<string,string>")


def tokens(s: Column | str, least: int = 3, stop: tuple[str, ...] = STOP_WORDS) -> Column:
    """Folded words of at least `least` characters that say something."""
    return F.filter(F.split(fold(s), " "), lambda w: (F.length(w) >= least) & ~w.isin(*stop))


def exploded(df: DataFrame, s: str, *keep: str, distinct: bool = False, name: str = "token", least: int = 3, stop: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    """keep and a row for each of tokens(s), once for each text if distinct. Words are told apart as rows, in generated code; the outer explode keeps the folding from being computed once more for a filter."""
    words = F.split(fold(s), " ")
    rows = df.select(*keep, F.explode_outer(F.array_distinct(words) if distinct else words).alias(name))
    return rows.where((F.length(name) >= least) & ~F.col(name).isin(*stop))


@pandas_udf(DoubleType())
def fuzzy_ratio(a, b):
    """Twice the matched characters over both lengths, by longest matching blocks."""
    import pandas as pd

    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)])


def overlay(s: Column | str) -> Column:
    """struct(lat, lon) of coordinates written into a text; null unless both are there. The first of each counts."""
    hits = F.arrays_zip(*(F.regexp_extract_all(col(s), F.lit(OVERLAY), F.lit(i)).alias(n) for i, n in ((1, "hemisphere"), (2, "whole"), (3, "part"))))
    read = F.transform(
        hits,
        lambda h: F.struct(
            F.upper(h["hemisphere"]).alias("side"),
            (F.translate(h["whole"], MISREAD, READ).try_cast("double") + F.concat(F.lit("0."), F.translate(h["part"], MISREAD, READ)).try_cast("double")).alias("v"),
        ),
    )

    def first(plus: str, minus: str) -> Column:
        hit = F.get(F.filter(read, lambda r: r["side"].isin(plus, minus) & r["v"].isNotNull()), F.lit(0))
        return hit["v"] * F.when(hit["side"] == plus, 1).otherwise(-1)

    lat, lon = first("N", "S"), first("E", "W")
    return F.when(lat.isNotNull() & lon.isNotNull(), F.struct(lat.alias("lat"), lon.alias("lon")))


def shot_seconds(s: Column | str) -> Column:
    """Epoch seconds of "YYYY-MM-DD HH:MM:SS...", or null."""
    return F.unix_timestamp(F.try_to_timestamp(F.substring(col(s), 1, 19), F.lit("yyyy-MM-dd HH:mm:ss")))


def size_bytes(s: Column | str) -> Column:
    """"20GB" and the like as bytes; null if it isn't a size."""
    number = F.regexp_extract(F.upper(F.trim(col(s))), r"^([0-9]+(?:\.[0-9]+)?)\s*([KMGT]?)I?B?$", 1)
    unit = F.regexp_extract(F.upper(F.trim(col(s))), r"^([0-9]+(?:\.[0-9]+)?)\s*([KMGT]?)I?B?$", 2)
    power = F.when(unit == "K", 1).when(unit == "M", 2).when(unit == "G", 3).when(unit == "T", 4).otherwise(0)
    return (number.try_cast("double") * F.pow(F.lit(1024.0), power)).cast("long")


def human_size(n: Column | str) -> Column:
    n = col(n)
    out = F.concat(n.cast("long").cast("string"), F.lit(" B"))
    for k, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        out = F.when(n >= 1024**k, F.concat(F.format_string("%.1f", n / float(1024**k)), F.lit(f" {unit}"))).otherwise(out)
    return out


def run_name(tag: Column | str) -> Column:
    """struct(width, bank, epochs, extra) of a name like d768-b350-e6-cell8; null parts where it says nothing."""
    t = col(tag)

    def part(letter: str) -> Column:
        return F.nullif(F.regexp_extract(t, rf"(?:^|-){letter}([0-9]+)(?:-|$)", 1), F.lit("")).cast("int")

    extra = F.nullif(F.regexp_extract(t, r"-e[0-9]+-(.+)$", 1), F.lit(""))
    return F.struct(part("d").alias("width"), part("b").alias("bank"), part("e").alias("epochs"), extra.alias("extra"))


def member(path: Column | str) -> Column:
    """struct(shard, name, id) of an archive member's path."""
    p = col(path)
    name = F.element_at(F.split(p, "/"), -1)
    return F.struct(F.split_part(p, F.lit("/"), F.lit(1)).alias("shard"), name.alias("name"), F.split_part(name, F.lit("."), F.lit(1)).alias("id"))


def pack_name(n: Column | str) -> Column:
    return F.lpad(col(n).cast("string"), 4, "0")


def digest(parts: Column, length: int = 12) -> Column:
    """The first hex digits of SHA-256 over an array's texts, told apart by NUL."""
    return F.substring(F.sha2(F.array_join(parts, "\0"), 256), 1, length)


def next_clock(now: Column, clock: str) -> Column:
    """The next moment behind now at which a clock shows hh:mm, on the same day or the day after."""
    hours, minutes = (int(x) for x in clock.split(":"))
    today = F.date_trunc("day", now) + F.make_dt_interval(F.lit(0), F.lit(hours), F.lit(minutes), F.lit(0))
    return F.when(today > now, today).otherwise(today + F.make_dt_interval(F.lit(1)))


def cache_name(*parts: Column, suffix: str = "") -> Column:
    """A file name from what an artefact was made with; null parts are left out."""
    return F.concat(F.concat_ws("_", *parts), F.lit(suffix))
