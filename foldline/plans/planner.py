"""From masters to target folders: the whole proposal as one DataFrame plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import times
from ..functions.media import orientation_name, upright_size
from ..functions.text import capture_stem, case_name, device_name, sanitize, stem
from ..operators.groups import agreeing_groups, leaders, parent_flag, uninformative
from ..operators.islands import merged_days
from ..operators.naming import unique_targets
from ..operators.nearest import fold_anchors
from ..operators.sessions import gap_sessions, name_unlocated, session_starts
from ..schema import SIDECAR, VIDEO, PlanConfig
from ..sources.shared import cut
from . import places as P

UNKNOWN_PLACE = "Unknown"


def derive(masters: DataFrame) -> DataFrame:
    """Taken time (instant and wall clock), upright size, device, and whether any capture date is given."""
    dates = [F.col("exif_date_time_original"), times.strip_offset(F.col("exif_creation_date")), F.col("exif_create_date"), F.col("exif_media_create_date")]
    all_dates = [*dates, F.col("file_modified_at")]
    width, height = upright_size(F.col("exif_image_width"), F.col("exif_image_height"), F.col("exif_image_orientation"))
    given = F.lit(False)
    for c in ("exif_date_time_original", "exif_creation_date", "exif_create_date", "exif_media_create_date"):
        given = given | (F.coalesce(c, F.lit("")) != "")
    return (
        masters.withColumn("taken_at", times.first_time(*all_dates))
        .withColumn("taken_wall", times.first_time(*all_dates, parse=times.parse_wall))
        .withColumn("has_exif_time", given)
        .withColumn("width", width)
        .withColumn("height", height)
        .withColumn("device", device_name(F.col("exif_make"), F.col("exif_model")))
    )


def geocode(df: DataFrame, enriched: DataFrame | None, anchors: list[P.Anchor] = ()) -> DataFrame:
    """Location of rows with coordinates, and whether a saved place gave it."""
    if enriched is None:
        return df.withColumn("location", F.lit("")).withColumn("at_saved_place", F.lit(False))
    found = P.lookup(df, enriched, key="file_id", lat="exif_gps_latitude", lon="exif_gps_longitude", order=["file_dir", "file_name"])
    named = df.join(found, "file_id", "left").withColumn("location", F.coalesce("place", F.lit(""))).drop("place")
    return fold_anchors(named, [(a.folder, a.lat, a.lon) for a in anchors], lat="exif_gps_latitude", lon="exif_gps_longitude", place="location")


def _folder_time() -> Column:
    return F.coalesce("folder_date", "taken_wall")


def level_value(level: str, cfg: PlanConfig) -> Column:
    """The folder name that one level gives a row; empty where it gives none."""
    if level == "location":
        hidden = F.col("at_saved_place") & F.lit(cfg.saved_places_date_only) & ~F.col("keep_place")
        event = F.coalesce("event_segment", F.lit("")) if "date" not in cfg.levels else F.lit("")
        return F.when(hidden, "").when(F.col("location") != "", F.col("location")).otherwise(event)
    if level == "date":
        return F.coalesce("day_range", times.day_label(F.col("taken_wall"), _folder_time()))
    if level == "device":
        return F.col("device")
    if level == "orientation":
        return orientation_name(F.col("width"), F.col("height"))
    return F.when(F.col("media_type") == VIDEO, "Videos").otherwise("Photos")


def _path(levels: list[str], cfg: PlanConfig) -> Column:
    parts = [times.month_folder(_folder_time())]
    for level in levels:
        value = level_value(level, cfg)
        parts.append(F.when(F.coalesce(value, F.lit("")) != "", sanitize(value)))
    return F.concat_ws("/", *parts)


def plan(df: DataFrame, cfg: PlanConfig = PlanConfig()) -> DataFrame:
    """Adds target_path, directory, location_dir, cluster_id and folder_taken_at to derived, geocoded masters.

    Needed columns: file_id, file_dir, file_name, media_type, is_screenshot, taken_at, taken_wall, has_exif_time, width,
    height, device, location, at_saved_place.  Every pass is a join or aggregation on days, folders or groups; only the
    fixpoint of merged days (distinct days of a month) and clashing names pass through Python.
    """
    levels = list(cfg.levels)
    dated = F.col("taken_at").isNotNull()
    plain_row = dated & ~F.col("is_screenshot")
    df = df.withColumn("location", F.coalesce("location", F.lit(""))).withColumn("device", F.coalesce("device", F.lit("")))
    df = gap_sessions(df, ts="taken_at", gap_seconds=cfg.gap)
    df = session_starts(df, ts="taken_at", session="session")
    wall_start = F.min("taken_wall").over(_window("session"))
    df = df.withColumn("folder_date", F.when(F.col("folder_date").isNotNull(), wall_start))
    df = name_unlocated(df, ts="taken_at", session="session", located=F.col("location") != "", wall="taken_wall")
    df = df.withColumn("location", case_name(F.col("location"))).withColumn("device", case_name(F.col("device")))
    df = df.withColumn("keep_place", F.lit(False)).withColumn("day_range", F.lit(None).cast("string"))

    df = cut(df, "sessions")
    collapsing = {n: level_value(n, cfg) for n in levels if n in ("device", "orientation", "media")}
    skip = uninformative(df, collapsing) if cfg.collapse_levels else set()
    shown = [n for n in levels if n not in skip]
    if "location" in levels:
        above = shown[: shown.index("location")] if "location" in shown else shown
        df = df.withColumn("_parent", F.when(plain_row, _path(above, cfg)))
        if cfg.saved_places_date_only:
            df = parent_flag(df, parent="_parent", when=plain_row & ~F.col("at_saved_place"), out="_mixed")
            df = df.withColumn("keep_place", F.col("at_saved_place") & plain_row & F.col("_mixed")).drop("_mixed")
        value = level_value("location", cfg)
        df = parent_flag(df, parent="_parent", when=plain_row & (value != ""), out="_located")
        unknown = plain_row & ~F.col("at_saved_place") & (value == "") & F.col("_located")
        df = df.withColumn("location", F.when(unknown, UNKNOWN_PLACE).otherwise(F.col("location"))).drop("_located", "_parent")
        df = cut(df, "located")
    if cfg.merge_days and "date" in levels and ("location" not in levels or levels.index("date") < levels.index("location")):
        votes = dated & ~times.crosses_month(F.col("taken_wall"), _folder_time())
        df = df.withColumn("_m", F.when(votes, F.date_format(_folder_time(), "yyyy-MM"))).withColumn("_d", F.dayofmonth("taken_wall"))
        found = merged_days(df.filter(votes), month="_m", place="location", day="_d", out="_range")
        df = df.join(found, ["_m", "location", "_d"], "left").withColumn("day_range", F.col("_range")).drop("_m", "_d", "_range")

    folder = F.when(~dated, sanitize(F.lit(cfg.fallback))).when(F.col("is_screenshot"), F.concat(times.month_folder(_folder_time()), F.lit("/Screenshots"))).otherwise(_path(shown, cfg))
    df = df.withColumn("directory", folder)
    if "location" in shown:
        upto = shown[: shown.index("location") + 1]
        df = df.withColumn("location_dir", F.when(plain_row & (level_value("location", cfg) != ""), _path(upto, cfg)))
    else:
        df = df.withColumn("location_dir", F.lit(None).cast("string"))
    df = df.withColumn("folder_taken_at", F.when(dated, _folder_time()))
    df = cut(share_captures(cut(df, "folders")), "captures")
    named = unique_targets(df, directory="directory", name="file_name", order=["taken_at", "file_dir", "file_name", "file_id"])
    return named


def _window(*keys: str):
    from pyspark.sql.window import Window

    return Window.partitionBy(*keys)


def share_captures(df: DataFrame) -> DataFrame:
    """Files of one shot (not videos) whose capture dates and device agree share their leader's folder and time."""
    df = df.withColumn("_stem", F.when(F.col("media_type") != VIDEO, capture_stem(F.col("file_name"))))
    keys = ["file_dir", "_stem"]
    still = df.filter(F.col("_stem").isNotNull())
    agreed = agreeing_groups(still, keys=keys, ts="taken_at", voter=F.col("has_exif_time"), device="device")
    members = still.join(agreed, keys)
    one = lambda c, n: F.when(c, n).otherwise(0)
    score = one(F.col("is_screenshot"), 8) + one(F.col("media_type") != SIDECAR, 4) + one(F.col("location") != "", 2) + one(F.col("_stem") == stem(F.col("file_name")), 1)
    w = _window(*keys).orderBy(F.col("taken_at").asc_nulls_first(), "file_name", "file_id")
    ranked = members.withColumn("_pos", F.row_number().over(w))
    lead = leaders(ranked, keys=keys, score=score, order="_pos", take=["directory", "location_dir", "folder_taken_at"])
    led = F.col("leader_directory").isNotNull()
    out = df.join(lead, keys, "left")
    for c in ("location_dir", "folder_taken_at"):
        out = out.withColumn(c, F.when(led, F.col(f"leader_{c}")).otherwise(F.col(c)))
    out = out.withColumn("folder_taken_at", F.when(F.col("taken_at").isNotNull(), F.coalesce("folder_taken_at", "taken_wall")))
    return out.withColumn("directory", F.coalesce("leader_directory", "directory")).drop("_stem", "leader_directory", "leader_location_dir", "leader_folder_taken_at")


def propose(masters: DataFrame, cfg: PlanConfig = PlanConfig(), places: DataFrame | None = None) -> DataFrame:
    """Entries for live masters: derive, geocode, plan."""
    enriched, anchors = None, []
    if places is not None:
        enriched = P.enrich(places)
        anchors = P.build_anchors(enriched, list(cfg.saved_places))
        if anchors:
            enriched = P.enrich(places, [a.name.split(",")[0] for a in anchors])
    planned = plan(geocode(derive(masters), enriched, anchors), cfg)
    return planned.select(
        "file_id",
        F.concat_ws("/", "file_dir", "file_name").alias("source_path"),
        "target_path",
        "cluster_id",
        F.lit("PROPOSED").alias("status"),
        "location_dir",
        times.fixed_width(F.col("folder_taken_at")).alias("taken_at"),
    )


def preview_paths(spark, cfg: PlanConfig, samples: list[dict]) -> list[str]:
    """Target paths that the rules give made-up rows, in their order; coordinates aren't needed, locations are given."""
    rows = [
        (i, "/preview", s.get("name", f"{i}.jpg"), s.get("media", "IMAGE"), bool(s.get("screenshot")), s.get("taken"), s.get("make", ""), s.get("model", ""), s.get("width", 0), s.get("height", 0), s.get("location", ""), bool(s.get("saved")))
        for i, s in enumerate(samples)
    ]
    df = spark.createDataFrame(rows, "file_id long, file_dir string, file_name string, media_type string, is_screenshot boolean, t string, make string, model string, width int, height int, location string, at_saved_place boolean")
    df = df.withColumn("taken_at", times.parse_time(F.col("t"))).withColumn("taken_wall", F.col("taken_at")).withColumn("has_exif_time", F.col("t").isNotNull())
    df = df.withColumn("device", device_name(F.col("make"), F.col("model"))).drop("t", "make", "model")
    return [r[0] for r in plan(df, cfg).orderBy("file_id").select("target_path").collect()]
