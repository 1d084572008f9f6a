"""Ids of nodes as text: base 30 without vowels, at least three symbols, and their directories."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The digits of base 30 as `conv` writes them, and the alphabet of ids.
CONV_DIGITS = "ABCDEFGHIJKLMNOPQRST"
ID_DIGITS = "BCDFGHJKMNPQRSTVWXYZ"
SLUG = r"^[-a-zA-Z0-9_]+$"
#: Names that documents can't have.
RESERVED = ("static", "static_collect", "static_root", "static_local", "media", "all", "search", "http", "https", "html", "www", "usr", "var", "lib", "etc", "src", "tmp", "pdf", "doc", "jpeg", "jpg", "tiff", "tif", "gif", "svg")


def int_to_id(c: Column) -> Column:
    """The id of a non-negative number; null for null."""
    s = F.translate(F.conv(c.cast("string"), 10, 30), CONV_DIGITS, ID_DIGITS)
    return F.when(F.length(s) < 3, F.lpad(s, 3, "0")).otherwise(s)


def normalize_id(c: Column) -> Column:
    """Upper case, with I and L read as 1 and O as 0, padded to three symbols; null if a symbol isn't of the alphabet."""
    s = F.translate(F.upper(c), "ILO", "110")
    s = F.when(F.length(s) < 3, F.lpad(s, 3, "0")).otherwise(s)
    return F.when(s.rlike(f"^[0-9{ID_DIGITS}]+$"), s)


def id_to_int(c: Column) -> Column:
    """The number of an id, null if it isn't one."""
    return F.conv(F.translate(normalize_id(c), ID_DIGITS, CONV_DIGITS), 30, 10).cast("long")


def id_to_path(c: Column) -> Column:
    """UUID/first/second/rest of an id."""
    return F.concat_ws("/", F.lit("UUID"), F.substring(c, 1, 1), F.substring(c, 2, 1), F.substr(c, F.lit(3)))


def path_to_id(c: Column) -> Column:
    """The id whose directory a path lies in; null if there is none."""
    hit = F.regexp_replace(F.regexp_extract(c, r"(?:^|/)UUID/(.)/(.)/([^/]+)(?:/|$)", 0), "(^/?UUID/)|/", "")
    return F.when(hit != "", normalize_id(hit))


def _ascii(s: pd.Series) -> pd.Series:
    return s.map(lambda x: x if x is None else unicodedata.normalize("NFKD", x).encode("ascii", "ignore").decode())


def slugify(c: Column) -> Column:
    """ASCII letters, digits, hyphens: decomposed (Spark has no NFKD), other characters dropped, spaces to hyphens."""
    s = F.lower(F.regexp_replace(F.pandas_udf(_ascii, "string")(c), r"[^\w\s-]", ""))
    return F.regexp_replace(F.trim(F.regexp_replace(s, r"^\s+|\s+$", "")), r"[-\s]+", "-")


def valid_language(c: Column) -> Column:
    return c.rlike("^[a-z]{3}$")


#: ISO 639 two-letter and three-letter codes and names.
LANGUAGES = [
    ("ar", "ara", "Arabic"), ("bg", "bul", "Bulgarian"), ("ca", "cat", "Catalan"), ("cs", "ces", "Czech"), ("cy", "cym", "Welsh"), ("da", "dan", "Danish"),
    ("de", "deu", "German"), ("el", "ell", "Greek"), ("en", "eng", "English"), ("eo", "epo", "Esperanto"), ("es", "spa", "Spanish"), ("et", "est", "Estonian"),
    ("eu", "eus", "Basque"), ("fa", "fas", "Persian"), ("fi", "fin", "Finnish"), ("fr", "fra", "French"), ("ga", "gle", "Irish"), ("gl", "glg", "Galician"),
    ("he", "heb", "Hebrew"), ("hi", "hin", "Hindi"), ("hr", "hrv", "Croatian"), ("hu", "hun", "Hungarian"), ("hy", "hye", "Armenian"), ("id", "ind", "Indonesian"),
    ("is", "isl", "Icelandic"), ("it", "ita", "Italian"), ("ja", "jpn", "Japanese"), ("ka", "kat", "Georgian"), ("ko", "kor", "Korean"), ("la", "lat", "Latin"),
    ("lt", "lit", "Lithuanian"), ("lv", "lav", "Latvian"), ("mk", "mkd", "Macedonian"), ("ms", "msa", "Malay"), ("mt", "mlt", "Maltese"), ("nl", "nld", "Dutch"),
    ("no", "nor", "Norwegian"), ("pl", "pol", "Polish"), ("pt", "por", "Portuguese"), ("ro", "ron", "Romanian"), ("ru", "rus", "Russian"), ("sk", "slk", "Slovak"),
    ("sl", "slv", "Slovenian"), ("sq", "sqi", "Albanian"), ("sr", "srp", "Serbian"), ("sv", "swe", "Swedish"), ("sw", "swa", "Swahili"), ("ta", "tam", "Tamil"),
    ("th", "tha", "Thai"), ("tr", "tur", "Turkish"), ("uk", "ukr", "Ukrainian"), ("ur", "urd", "Urdu"), ("vi", "vie", "Vietnamese"), ("zh", "zho", "Chinese"),
]


def _lookup(c: Column, pairs: list[tuple[str, str]]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in pairs for x in pair]), c)


def normalize_lang(c: Column) -> Column:
    """`ll`, `ll-LL` or `lll` to the three-letter code; unknown codes of three letters stay, others are null."""
    low = F.lower(F.regexp_extract(c, "^([A-Za-z]{2,3})(?:[-_].*)?$", 1))
    return F.coalesce(_lookup(low, [(two, three) for two, three, _ in LANGUAGES]), F.when(F.length(low) == 3, low))


def two_letter_lang(c: Column) -> Column:
    """The two-letter code of a three-letter one; null where there is none."""
    return _lookup(c, [(three, two) for two, three, _ in LANGUAGES])


def name_of_lang(c: Column) -> Column:
    """A language's English name by its three-letter code; null where it isn't known."""
    return _lookup(c, [(three, name) for _, three, name in LANGUAGES])


def strip_delims(c: Column, left: str = "{", right: str = "}") -> Column:
    """The value without one pair of delimiters around it."""
    inside = F.substring(c, 1 + len(left), 2147483647)
    return F.when(c.startswith(left) & c.endswith(right) & (F.length(c) >= len(left) + len(right)), F.substr(inside, F.lit(1), F.length(c) - len(left) - len(right))).otherwise(c)


def parenthesize(c: Column, left: str = "{", right: str = "}") -> Column:
    """The value with delimiters around it, unless it has them."""
    return F.when(c.startswith(left) & c.endswith(right), c).otherwise(F.concat(F.lit(left), c, F.lit(right)))
