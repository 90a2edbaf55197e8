"""What files and their metadata documents say of themselves."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import IMAGE, RAW, SIDECAR, UNKNOWN, VIDEO
from .text import base_name, extension

EXTENSIONS = {IMAGE: ("bmp", "heic", "jpeg", "jpg", "png", "webp"), VIDEO: ("mov", "mp4"), RAW: ("cr2", "dng"), SIDECAR: ("aae",)}
IGNORED_FILES = (".DS_Store", ".nomedia", ".picasa.ini", "Thumbs.db", "desktop.ini")
IGNORED_DIRS = (
    "$RECYCLE.BIN", ".DocumentRevisions-V100", ".Spotlight-V100", ".TemporaryItems", ".Trash", ".Trashes", ".fseventsd", ".git", ".svn",
    "System Volume Information", "node_modules",
)
#: Tags and the values by which a screen capture is known.
SCREEN_MARKS = {"Description": ("Screenshot",), "SamsungCaptureInfo": ("Screen recording", "Screenshot"), "UserComment": ("Screenshot",)}
TAGS = (
    "ImageWidth", "ImageHeight", "Orientation", "GPSLatitude", "GPSLongitude", "Make", "Model", "DateTimeOriginal", "CreateDate", "CreationDate", "MediaCreateDate",
)


def media_type(name: Column, extensions: dict = EXTENSIONS) -> Column:
    ext = F.lower(F.substring(extension(name), 2, 1 << 20))
    out = F.lit(UNKNOWN)
    for kind, some in extensions.items():
        out = F.when(ext.isin(*some), kind).otherwise(out)
    return F.when(is_ignored(name), UNKNOWN).otherwise(out)


def is_ignored(name: Column) -> Column:
    base = base_name(name)
    return base.isin(*IGNORED_FILES) | base.startswith("._")


def in_ignored_dir(dir_: Column) -> Column:
    return F.exists(F.split(dir_, "/"), lambda x: x.isin(*IGNORED_DIRS))


def tag(document: Column, name: str) -> Column:
    """A tag of a JSON document as text, whatever scalar it is; missing, null or malformed is empty."""
    return F.coalesce(F.try_variant_get(F.try_parse_json(document), f"$.{name}", "string"), F.lit(""))


def is_screen_capture(document: Column) -> Column:
    out = F.lit(False)
    for name, values in SCREEN_MARKS.items():
        out = out | tag(document, name).isin(*values)
    return out


def upright_size(width: Column, height: Column, orientation: Column) -> tuple[Column, Column]:
    """Width and height as seen: orientations 5 to 8 lie on their side."""
    turned = F.coalesce(orientation.between(5, 8), F.lit(False))
    return F.when(turned, height).otherwise(width), F.when(turned, width).otherwise(height)


def orientation_name(width: Column, height: Column) -> Column:
    w, h = F.coalesce(width, F.lit(0)), F.coalesce(height, F.lit(0))
    return F.when((w == 0) | (h == 0), "").when(h > w, "Vertical").otherwise("Horizontal")
