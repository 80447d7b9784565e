"""Cleaning and classification of race, place and competitor fields, as Column expressions."""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType

# Tokens, aliases and patterns that classification must share with its inputs.
MISSING = ["", "nan", "NaN", "NA", "N/A", "NULL", "null", "None", "none", "n/a", "<NA>"]
DUMMY_KEYS = ["", "unknown", "xx", "x", "na", "n/a", "none", "null", "?", "need winners name", "need winner name", "winner unknown"]
COUNTRIES = {
    "JAPAN": ["JPN", "JAPAN", "日本", "NIPPON"],
    "UNITED STATES": ["USA", "US", "UNITED STATES", "UNITED STATES OF AMERICA"],
    "GREAT BRITAIN": ["GB", "UK", "GREAT BRITAIN", "UNITED KINGDOM", "ENGLAND"],
    "IRELAND": ["IRE", "IRELAND"],
    "FRANCE": ["FR", "FRANCE"],
}
TRACKS = {"TOKYO, FUCHU": "TOKYO", "TOKYO FUCHU": "TOKYO", "FUCHU": "TOKYO", "MIZASAWA": "MIZUSAWA", "SHA TIN, HK": "SHA TIN", "SHA TIN HK": "SHA TIN", "MEYDAN, DUBAI": "MEYDAN"}
SURFACE_UNKNOWN = ["", "UNKNOWN", "UNK", "N A", "NA", "?", "NONE"]
SYNTHETIC = ["SYNTHETIC", "SYNTH", "ALL WEATHER", "ALLWEATHER", "POLYTRACK", "TAPETA", "CUSHION TRACK", "CUSHION", "FIBRESAND", "FIBERSAND", "PRO RIDE", "PRORIDE", "VISCO RIDE", "ARTIFICIAL"]
FAMILIES = ("TURF", "DIRT", "SYNTHETIC", "OTHER", "UNKNOWN")
JUMP = (
    r"(?i)\bHURDLES?\b|\bJUMPS?\b|\bSTEEPLE(?:CHASE)?S?\b|\bNOVICES?\s+CHASE\b|\bHANDICAP\s+CHASE\b|\bCHAMPION\s+CHASE\b|\bCELEBRATION\s+CHASE\b|\bCHASE\b"
    r"|\bNATIONAL\s+HUNT\b|\bNH\s+FLAT\b|\bPOINT\s+TO\s+POINT\b|\bCROSS\s+COUNTRY\b|障害|ハードル|スティープルチェイス"
)
FOLDS = 5


@F.pandas_udf(StringType())
def _nfkc(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in parts:
        yield part.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


@F.pandas_udf(IntegerType())
def _blake_fold(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in parts:
        yield part.map(lambda x: int.from_bytes(hashlib.blake2b((x or "").strip().encode(), digest_size=8).digest(), "big") % FOLDS).astype("int32")


def nfkc(x: Column) -> Column:
    """Compatibility-composed form. ASCII is its own, so only other strings go to Python: to the
    worker an ASCII string is a null."""
    other = x.rlike(r"[^\x00-\x7F]")
    return F.coalesce(_nfkc(F.when(other, x)), x)


def missing_to_null(x: Column) -> Column:
    """Null for the blank and NA-like strings that a CSV reader treats as missing."""
    return F.when(~F.trim(x).isin(MISSING), x)


def clean(x: Column) -> Column:
    """Trimmed of any white space; null becomes empty."""
    return F.regexp_replace(F.coalesce(x.cast("string"), F.lit("")), r"(?U)^\s+|\s+$", "")


def normal(x: Column) -> Column:
    """NFKC, upper case, single spaces."""
    return F.trim(F.regexp_replace(F.upper(nfkc(clean(x))), r"(?U)\s+", " "))


def key(x: Column) -> Column:
    return F.lower(clean(x))


def valid_key(x: Column) -> Column:
    """False for placeholders of an unnamed competitor."""
    pk = key(x)
    compact = F.trim(F.regexp_replace(pk, r"[\s_+\-]+", " "))
    return ~(pk.isin(DUMMY_KEYS) | compact.isin(DUMMY_KEYS) | (compact.startswith("need ") & compact.contains("name")))


def country(x: Column) -> Column:
    text = normal(x)
    out = F.when(text == "", "UNKNOWN")
    for name, aliases in COUNTRIES.items():
        out = out.when(text.isin(aliases), name)
    return out.otherwise(text)


def track(x: Column) -> Column:
    text = F.trim(F.regexp_replace(F.regexp_replace(normal(x), r"\s*,\s*", ", "), r"\s+", " "))
    plain = F.trim(F.regexp_replace(F.regexp_replace(text, ",", ""), r"\s+", " "))
    out = F.when(text == "", "UNKNOWN")
    for alias, name in TRACKS.items():
        out = out.when(text == alias, name)
    for alias, name in TRACKS.items():
        out = out.when(plain == alias, name)
    return out.otherwise(text)


def surface_family(x: Column) -> Column:
    """Hard family of a surface label; synthetic words win over dirt, blanks are never guessed."""
    raw = normal(x)
    compact = F.trim(F.regexp_replace(raw, r"[^A-Z0-9一-龠ぁ-んァ-ヶ]+", " "))
    synthetic = F.lit(False)
    for word in SYNTHETIC:
        synthetic = synthetic | compact.contains(word)
    return (
        F.when(compact.isin(SURFACE_UNKNOWN), "UNKNOWN")
        .when(synthetic | F.regexp_replace(compact, " ", "").isin("AW", "AWT"), "SYNTHETIC")
        .when(compact.contains("TURF") | compact.contains("GRASS") | raw.contains("芝"), "TURF")
        .when(compact.contains("DIRT") | compact.contains("SAND") | raw.contains("ダート"), "DIRT")
        .otherwise("OTHER")
    )


def race_type(*fields: Column) -> Column:
    text = F.concat_ws(" ", *(F.coalesce(f.cast("string"), F.lit("")) for f in fields))
    return F.when(text.rlike(JUMP), "JUMP").otherwise("FLAT")


def domain(country_col: Column, track_col: Column) -> Column:
    return F.concat_ws("::", country_col, track_col)


def stable_fold(race_id: Column) -> Column:
    """A held-out fold from a keyed-free BLAKE2b hash of the id, the same on every machine."""
    return _blake_fold(race_id.cast("string"))


def search_key(x: Column) -> Column:
    """Lower-case search form that keeps digits, Latin letters, kana and CJK ideographs."""
    text = F.regexp_replace(F.lower(nfkc(clean(x))), r"\+", " ")
    return F.regexp_replace(text, r"[^0-9a-zぁ-んァ-ヶー一-龠々]+", "")


def whole_year(x: Column) -> Column:
    """'2001.0' and '2001.7' are 2001; words, blanks and infinities are null."""
    number = x.cast("string").try_cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) < 1e9), number.cast("int"))


def percent_text(x: Column, digits: int = 1) -> Column:
    """A share as a percentage text; values over 1 are taken as percentages already."""
    return F.when(x.isNull(), "-").otherwise(F.format_string(f"%.{digits}f%%", F.when(F.abs(x) <= 1.000001, x * 100).otherwise(x)))


def to_float(x: Column) -> Column:
    """A finite number, else null: words, blanks and infinities are null."""
    number = F.trim(x.cast("string")).try_cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) < float("inf")), number)


def to_int(x: Column) -> Column:
    """The same cut toward zero."""
    return to_float(x).cast("long")


def number_text(x: Column, digits: int = 2) -> Column:
    return F.when(x.isNull(), "-").otherwise(F.format_string(f"%.{digits}f", x.cast("double")))


def count_text(x: Column) -> Column:
    """With thousands separators."""
    return F.when(x.isNull(), "-").otherwise(F.format_number(x.cast("long"), 0))


def plain_text(x: Column, kind: str) -> Column:
    """As a cell of an exported table: fractions with six digits, null empty."""
    return F.when(x.isNull(), "").otherwise(F.format_string("%.6f", x) if kind in ("double", "float") else x.cast("string"))


def padded(x: Column, width: int, right: bool = False) -> Column:
    """Cut and padded with spaces to a fixed width."""
    own = F.substring(F.coalesce(x, F.lit("-")), 1, width)
    return F.lpad(own, width, " ") if right else F.rpad(own, width, " ")


def step_label(n: Column) -> Column:
    return F.concat(F.lit("Step "), n.cast("string"))


def parse_years(text: str | None) -> list[int]:
    """A comma list of years, sorted and distinct; blanks between commas don't count."""
    return sorted({int(part) for part in (text or "").split(",") if part.strip()})


def in_years(year: Column, years: list[int] | None = None, first: int | None = None, last: int | None = None) -> Column:
    """An exact list of years, or inclusive bounds; the list wins."""
    if years:
        return year.isin(years)
    keep = year.isNotNull()
    if first is not None:
        keep = keep & (year >= first)
    return keep if last is None else keep & (year <= last)
