"""Sources: folder walks, content hashes, metadata documents, settings."""

from __future__ import annotations

import base64
import hashlib
import json
import os
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import media
from ..functions.text import base_name, dir_name, extension
from ..schema import PlanConfig


def reduce_roots(roots: list[str]) -> list[str]:
    """Existing folders, links resolved, without repeats and without folders inside others, in order."""
    found = []
    for r in roots:
        p = Path(os.path.expanduser(r)).resolve()
        if not p.is_dir():
            raise NotADirectoryError(r)
        found.append(str(p))
    kept: list[str] = []
    for p in sorted(set(found)):
        if not kept or not overlaps(kept[-1], p):
            kept.append(p)
    return kept


def overlaps(a: str, b: str) -> bool:
    """Whether one folder is the other or lies in it."""
    a, b = a.rstrip("/") + "/", b.rstrip("/") + "/"
    return a.startswith(b) or b.startswith(a)


def readable(roots: list[str]) -> tuple[list[str], list[str]]:
    """Roots that can be listed, and those that can't: one that fails doesn't keep the others from being scanned."""
    good, bad = [], []
    for r in roots:
        try:
            with os.scandir(os.path.expanduser(r)):
                good.append(r)
        except OSError:
            bad.append(r)
    return good, bad


def relative_to_home(path: str, home: str | None = None) -> str:
    """A path below the home folder with ``~`` in its place."""
    home = (home or os.path.expanduser("~")).rstrip("/")
    return "~" if path == home else "~" + path[len(home) :] if home and path.startswith(home + "/") else path


def walk(spark: SparkSession, roots: list[str], depth: int = 2) -> DataFrame:
    """Every file below the roots with its size and time of change in nanoseconds; ignored folders are never entered.

    The driver lists the first ``depth`` levels; the folders found there are walked in parallel.  A root that can't be read
    fails, a folder below is passed over.
    """
    todo, heads = [(r, 0) for r in roots], []
    while todo:
        at, level = todo.pop()
        heads.append((at, level < depth))
        if level < depth:
            try:
                with os.scandir(at) as it:
                    todo += [(e.path, level + 1) for e in it if e.is_dir(follow_symlinks=False) and e.name not in media.IGNORED_DIRS]
            except OSError:
                if level == 0:
                    raise
    listed = spark.createDataFrame(heads, "dir string, shallow boolean").repartition(max(1, min(len(heads), 1024)))

    def files(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            for top, shallow in zip(pdf["dir"], pdf["shallow"], strict=True):
                rows, stack = [], [top]
                while stack:
                    at = stack.pop()
                    try:
                        with os.scandir(at) as it:
                            for e in it:
                                if e.is_dir(follow_symlinks=False):
                                    if not shallow and e.name not in media.IGNORED_DIRS:
                                        stack.append(e.path)
                                elif e.is_file(follow_symlinks=False):
                                    st = e.stat(follow_symlinks=False)
                                    rows.append((at, e.name, st.st_size, st.st_mtime_ns))
                    except OSError:
                        continue
                    if len(rows) > 10_000:
                        yield pd.DataFrame(rows, columns=["file_dir", "file_name", "file_size", "mtime_ns"])
                        rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=["file_dir", "file_name", "file_size", "mtime_ns"])

    found = listed.mapInPandas(files, "file_dir string, file_name string, file_size long, mtime_ns long")
    seconds = F.timestamp_seconds((F.col("mtime_ns") / 1_000_000_000).cast("long"))
    nanos = F.lpad(F.pmod("mtime_ns", F.lit(1_000_000_000)).cast("string"), 9, "0")
    at = F.concat(F.date_format(seconds, "yyyy-MM-dd'T'HH:mm:ss."), nanos, F.lit("Z"))
    kind = media.media_type(F.col("file_name"))
    out = found.select("file_dir", "file_name", "file_size", at.alias("file_modified_at"), kind.alias("media_type"), F.lower(extension(F.col("file_name"))).alias("file_extension"))
    return out.filter(~media.is_ignored(F.col("file_name")) & (F.col("media_type") != "UNKNOWN"))


def read_binary(spark: SparkSession, path: str) -> DataFrame:
    """Files by Spark's own source, for stores that aren't mounted: folder, name, size and time; content is never read unless asked for."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return raw.select(dir_name(F.col("path")).alias("file_dir"), base_name(F.col("path")).alias("file_name"), F.col("length").alias("file_size"), F.col("modificationTime").alias("modified"), "content")


def hash_files(df: DataFrame, chunk: int = 1 << 20) -> DataFrame:
    """Adds ``content_hash`` (null where a file can't be read), reading each file in pieces so that its size doesn't matter."""
    from pyspark.sql.types import StringType, StructField, StructType

    schema = StructType([*df.schema.fields, StructField("content_hash", StringType())])

    def run(batches: Iterator) -> Iterator:
        for pdf in batches:
            got = []
            for d, n in zip(pdf["file_dir"], pdf["file_name"], strict=True):
                h = hashlib.blake2b(digest_size=32)
                try:
                    with open(os.path.join(d, n), "rb", buffering=0) as f:
                        while part := f.read(chunk):
                            h.update(part)
                    got.append(h.hexdigest())
                except OSError:
                    got.append(None)
            pdf["content_hash"] = got
            yield pdf

    return df.mapInPandas(run, schema)


def read_metadata(documents: DataFrame, column: str = "document") -> DataFrame:
    """Columns of metadata documents (JSON text, tolerant of any scalar type), empty values as nulls."""
    c = F.col(column)
    text = lambda n: F.nullif(media.tag(c, n), F.lit(""))
    return documents.select(
        *[x for x in documents.columns if x != column],
        text("ImageWidth").try_cast("int").alias("exif_image_width"),
        text("ImageHeight").try_cast("int").alias("exif_image_height"),
        text("Orientation").try_cast("int").alias("exif_image_orientation"),
        text("GPSLatitude").try_cast("double").alias("exif_gps_latitude"),
        text("GPSLongitude").try_cast("double").alias("exif_gps_longitude"),
        text("Make").alias("exif_make"),
        text("Model").alias("exif_model"),
        text("DateTimeOriginal").alias("exif_date_time_original"),
        text("CreateDate").alias("exif_create_date"),
        text("CreationDate").alias("exif_creation_date"),
        text("MediaCreateDate").alias("exif_media_create_date"),
        media.is_screen_capture(c).alias("is_screenshot"),
    )


_FIELDS = {"rules": tuple, "fallback": str, "gap_seconds": int, "collapse_levels": bool, "saved_places_date_only": bool, "merge_days": bool, "saved_places": tuple}


def load_config(path: str | None = None, flags: dict | None = None, env: dict | None = None, prefix: str = "FOLDLINE_") -> tuple[PlanConfig, list[str]]:
    """Settings by precedence: flags, environment, file (JSON), defaults; what can't be read is a warning, not an error."""
    warnings, given = [], {}
    if path and os.path.exists(path):
        try:
            with open(path, encoding="utf-8") as f:
                given = {k: v for k, v in json.load(f).items() if k in _FIELDS}
        except (ValueError, AttributeError) as e:
            warnings.append(f"{path}: {e}; defaults are used")
    for k in _FIELDS:
        raw = (env if env is not None else os.environ).get(prefix + k.upper())
        if raw is not None:
            given[k] = raw
    given |= {k: v for k, v in (flags or {}).items() if v is not None and k in _FIELDS}
    out = {}
    for k, v in given.items():
        kind = _FIELDS[k]
        try:
            if kind is bool and isinstance(v, str):
                out[k] = {"true": True, "1": True, "yes": True, "false": False, "0": False, "no": False}[v.lower()]
            elif kind is tuple:
                out[k] = tuple(x.strip() for x in v.split(";")) if isinstance(v, str) else tuple(v)
            else:
                out[k] = kind(v)
        except (KeyError, TypeError, ValueError):
            warnings.append(f"{k}: {v!r} can't be used")
    return PlanConfig(**out), warnings


def save_config(cfg: PlanConfig, path: str) -> None:
    tmp = path + ".new"
    with open(tmp, "w", encoding="utf-8") as f:
        json.dump({k: getattr(cfg, k) for k in _FIELDS}, f, indent=1)
    os.replace(tmp, path)


def config_stamp(cfg: PlanConfig) -> str:
    """A fingerprint of the settings that decide paths; how many workers there are isn't one."""
    parts = [["levels", list(cfg.rules)], ["collapse", cfg.collapse_levels], ["quiet places", cfg.saved_places_date_only], ["ranges", cfg.merge_days], ["places", list(cfg.saved_places)]]
    return base64.b64encode(hashlib.sha256(json.dumps(parts, separators=(",", ":"), ensure_ascii=False).encode()).digest()).decode().rstrip("=")


def free_bytes(path: str) -> int:
    st = os.statvfs(path)
    return st.f_bavail * st.f_frsize


def volume_id(path: str) -> str | None:
    """What names the volume a path is on: the file system's UUID where the system links it, else its device; null where unknown."""
    try:
        device = os.stat(path).st_dev
    except OSError:
        return None
    by_uuid = "/dev/disk/by-uuid"
    try:
        for name in sorted(os.listdir(by_uuid)):
            if os.stat(f"{by_uuid}/{name}").st_rdev == device:
                return name
    except OSError:
        pass
    return f"dev-{os.major(device)}-{os.minor(device)}"


def volumes(roots: list[str]) -> dict[str, str | None]:
    return {r: volume_id(r) for r in roots}


def volume_column(file_dir, of: dict[str, str | None]):
    """The volume of the longest root that a folder lies in.  Roots are settings, few by nature."""
    out = F.lit(None).cast("string")
    for root, name in sorted(of.items()):
        at = root.rstrip("/")
        out = F.when((file_dir == at) | file_dir.startswith(at + "/"), F.lit(name)).otherwise(out)
    return out


def read_places(spark: SparkSession, path: str, *, sha256: str | None = None, counts: dict[str, int] | None = None) -> DataFrame:
    """The places table of a Parquet or CSV file or folder, checked before use.

    ``sha256`` is that of the files' bytes in order of their names (read in parallel, one digest a file, and these digested again
    where there are several); ``counts`` has the rows expected of the whole ("rows") and of countries by code.  Anything else raises ``ValueError``.
    """
    from ..schema import PLACES

    if sha256:
        raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
        each = raw.select("path", F.sha2("content", 256).alias("h")).orderBy("path").collect()  # one row a file
        found = each[0]["h"] if len(each) == 1 else hashlib.sha256("".join(r["h"] for r in each).encode()).hexdigest()
        if found != sha256.lower():
            raise ValueError(f"{path}: its checksum is {found}")
    csv = path.rstrip("/").endswith((".csv", ".csv.gz"))
    df = (spark.read.option("header", True).schema(PLACES).csv(path) if csv else spark.read.parquet(path)).select(*(F.col(f.name).cast(f.dataType) for f in PLACES.fields))
    if counts:
        per = {r["country_code"] or "": r["count"] for r in df.groupBy("country_code").count().collect()}  # one row a country
        per["rows"] = sum(per.values())
        wrong = {k: (per.get(k, 0), n) for k, n in counts.items() if per.get(k, 0) != n}
        if wrong:
            raise ValueError(f"{path}: rows found and expected: {wrong}")
    return df


def tool_documents(df: DataFrame, argv: list[str], *, batch: int = 200, timeout: float = 600.0) -> DataFrame:
    """``df`` (file_dir, file_name, …) with a ``document`` for each file, as an external metadata tool prints it.

    The tool is started once for ``batch`` files of a partition, their paths following ``argv``, and prints a JSON array of
    objects that name their file as ``SourceFile``.  A file that it says nothing of, or a start that fails or lasts beyond
    ``timeout`` seconds, has a null document; no shell is involved.
    """
    import subprocess

    from pyspark.sql.types import StringType, StructField, StructType

    schema = StructType([*df.schema.fields, StructField("document", StringType())])

    def ask(paths: list[str]) -> dict[str, str]:
        try:
            out = subprocess.run([*argv, *paths], capture_output=True, timeout=timeout, check=False).stdout
            found = json.loads(out or b"[]")
            return {x["SourceFile"]: json.dumps(x) for x in found if isinstance(x, dict) and "SourceFile" in x}
        except (OSError, ValueError, subprocess.TimeoutExpired):
            return {}

    def run(batches: Iterator) -> Iterator:
        for pdf in batches:
            paths = [f"{d}/{n}" for d, n in zip(pdf["file_dir"], pdf["file_name"], strict=True)]
            said: dict[str, str] = {}
            for i in range(0, len(paths), batch):
                said |= ask(paths[i : i + batch])
            yield pdf.assign(document=[said.get(p) for p in paths])

    return df.mapInPandas(run, schema)
