"""Text expressions: file names, scores, folder segments, devices."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

GENERIC_NAMES = ("dcim", "camera", "photos", "temp", "downloads", "desktop", "backup", "misc")
_GENERIC = "|".join(
    (
        r"^\.?(?:cache|sync|thumbnails|trashed.*)\z",
        r"^new folder(?:\s*\(\d+\))?\z",
        r"^(?:old\s+)?backup[\s_-]*\d*\z",
        r"^(?:tmp|temp|misc|dcim|downloads?)[\s_-]*\d*\z",
        r"^(?:signal|telegram|whatsapp)[\s_-]*(?:media|images?|videos?)\z",
    )
)
DATE_NAME = r"^(\d{8}_|\d{4}-\d{2}-\d{2}_|\d{4}_\d{2}_\d{2}_)"
CAMERA_STEM = r"^(_?[A-Z]{1,5}_?)\d+(_\d+)*\z"
COPY_STEM = r"(?i)([ _-]*\(\d+\)|[ _-]copy(\s*\(?\d*\)?)?)\z"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def extension(name: Column) -> Column:
    """From the last dot on; a dotfile is all extension, a name without a dot has none."""
    return F.regexp_extract(name, r"(\.[^./]*)\z", 1)


def stem(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^./]*\z", "")


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)\z", 1)


def dir_name(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*\z", "")


def is_generic_dir(segment: Column) -> Column:
    low = F.lower(segment)
    return low.isin(*GENERIC_NAMES) | low.rlike(_GENERIC)


def has_meaningful_name(stem_: Column) -> Column:
    return ~stem_.rlike(CAMERA_STEM) & stem_.rlike("[a-zA-Z]")


def file_score(dir_: Column, name: Column) -> Column:
    """4 for a spoken name, 3 for a date in front, 2 for a folder that says something, 3 off for a copy."""
    s = stem(name)
    one = lambda cond, points: F.when(cond, points).otherwise(0)
    return one(has_meaningful_name(s), 4) + one(name.rlike(DATE_NAME), 3) + one(~is_generic_dir(base_name(dir_)), 2) - one(s.rlike(COPY_STEM), 3)


def path_bytes(dir_: Column, name: Column) -> Column:
    return F.octet_length(dir_) + F.octet_length(name)


def capture_stem(name: Column) -> Column:
    """The stem that edited and original versions of one shot share."""
    return F.regexp_replace(stem(name), r"^IMG_[EO]", "IMG_")


def sanitize(segment: Column) -> Column:
    """One safe folder name: separators and blanks become dashes, which don't repeat or lie at an end; nothing left is a dash."""
    dashed = F.translate(segment, "/\\:\0 ,\t\n", "--------")
    trimmed = F.btrim(F.regexp_replace(dashed, "-+", "-"), F.lit(" ._-"))
    return F.when(trimmed == "", "-").otherwise(trimmed)


def ascii_lower(x: Column) -> Column:
    """Lower case of A-Z alone, as a case-blind comparison in a byte collation sees it."""
    return F.translate(x, _UPPER, _LOWER)


def device_name(make: Column, model: Column) -> Column:
    make, model = F.coalesce(make, F.lit("")), F.coalesce(model, F.lit(""))
    return F.when(model == "", make).when((make == "") | F.contains(F.lower(model), F.lower(make)), model).otherwise(F.concat(make, F.lit(" "), model))


def case_name(name: Column) -> Column:
    """Every word (between spaces, underscores and dashes) with one capital in front; words with a fixed spelling keep it."""
    words = F.split(name, r"(?<=[ _-])|(?=[ _-])")

    def title(w: Column) -> Column:
        return F.when(F.lower(w) == "iphone", "iPhone").otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 30))))

    return F.array_join(F.transform(words, title), "")


def _strip(s: pd.Series) -> pd.Series:
    def one(v: str) -> str:
        return v if v.isascii() else unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", v) if unicodedata.category(c) != "Mn"))

    return s.map(one, na_action="ignore")


def strip_accents(x: Column) -> Column:
    """Without combining marks: decomposed, marks dropped, composed again.  Spark has no such function; this one works on Arrow batches."""
    return F.pandas_udf(_strip, "string")(x)


def trigrams(x: Column) -> Column:
    """Three-character windows of the lower-cased text between two spaces."""
    padded = F.concat(F.lit(" "), F.lower(x), F.lit(" "))
    n = F.char_length(padded)
    return F.when(n < 3, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda i: F.substring(padded, i, F.lit(3))))


def human_bytes(n: Column) -> Column:
    """Bytes below 1024, else one decimal of the largest unit of 1024 that leaves at least one."""
    out = F.concat(n.cast("string"), F.lit(" B"))
    for k, unit in enumerate("KMGTPE", 1):
        size = F.format_string("%.1f", F.bround(n.cast("double") / float(1024**k), 1))
        out = F.when(n >= F.lit(1024**k), F.concat(size, F.lit(f" {unit}iB"))).otherwise(out)
    return out


def null_if_empty(x: Column) -> Column:
    return F.nullif(x, F.lit(""))
