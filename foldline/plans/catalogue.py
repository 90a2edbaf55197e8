"""The whole run: scan folders, read what is new, elect masters, propose folders; each phase commits its tables at once."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.dedup import settle_masters, unique_keys
from ..operators.summary import distinct_values
from ..schema import APPROVED, DISCOVERED, PROPOSED, SIDECAR, USER_LABELS, PlanConfig
from ..sources import files
from ..sources import store as S
from .planner import propose
from .review import Node, build_tree, confirm, folder_table, given_names

RETENTION_DAYS = 30


def stamp(now: dt.datetime) -> str:
    return now.strftime("%Y-%m-%dT%H:%M:%S.%f") + "000Z"


def scan(store: S.Store, roots: list[str], now: dt.datetime, force: bool = False) -> int:
    """Files seen are put in the registry, unseen ones under the roots are deleted, and those long deleted are purged.

    A root that can't be read is passed over, and its files stay as they were; an error where none can be.
    """
    at = stamp(now)
    good, bad = files.readable(roots)
    if bad and not good:
        raise NotADirectoryError(", ".join(bad))
    roots = files.reduce_roots(good)
    seen = files.walk(store.spark, roots)
    seen = seen.withColumn("volume_uuid", files.volume_column(F.col("file_dir"), files.volumes(roots)))
    registry = S.sweep(S.upsert(store.read("file_registry"), seen, at, force), roots, at)
    kept = S.purge(registry, store.read("file_metadata"), store.read("entries"), stamp(now - dt.timedelta(days=RETENTION_DAYS)))
    return store.commit(**dict(zip(("file_registry", "file_metadata", "entries"), kept, strict=True)))["file_registry"]


def read_new(store: S.Store, documents: DataFrame, now: dt.datetime) -> None:
    """Identity and metadata of files that are DISCOVERED.  A file whose size no other live file has is never opened.

    ``documents`` has file_dir, file_name and a metadata document in JSON; sidecars carry none of their own.
    """
    registry = S.requeue_shared_sizes(store.read("file_registry"), store.read("file_metadata"))
    alive = S.live(registry)
    todo = alive.filter(F.col("scan_status") == DISCOVERED)
    alone = unique_keys(alive, "file_size")
    by_size = todo.join(alone, "file_size", "left_semi").select("id", "file_dir", "file_name", "media_type", F.concat(F.lit("size:"), F.col("id").cast("string")).alias("file_hash"), F.lit("size").alias("hash_kind"))
    opened = files.hash_files(todo.join(alone, "file_size", "left_anti").select("id", "file_dir", "file_name", "media_type"))
    by_content = opened.select("id", "file_dir", "file_name", "media_type", F.col("content_hash").alias("file_hash"), F.lit("content").alias("hash_kind"))
    both = by_size.unionByName(by_content)
    told = files.read_metadata(documents).join(both.select("file_dir", "file_name", "media_type"), ["file_dir", "file_name"]).filter(F.col("media_type") != SIDECAR).drop("media_type")
    fresh = both.join(told, ["file_dir", "file_name"], "left").withColumnRenamed("id", "file_id").withColumn("is_screenshot", F.coalesce("is_screenshot", F.lit(False))).withColumn("is_master", F.lit(True)).withColumn("created_at", F.lit(stamp(now)))
    failed = fresh.filter("file_hash IS NULL").select("file_id")
    fresh = fresh.filter("file_hash IS NOT NULL").drop("file_dir", "file_name", "media_type")
    store.commit(file_registry=S.mark_read(registry, fresh.select("file_id"), failed), file_metadata=S.replace_metadata(store.read("file_metadata"), fresh, failed))


def score(store: S.Store) -> int:
    """Elects a master of every group of identical live files; how many groups there are."""
    place = store.read("file_registry").select(F.col("id").alias("file_id"), "file_dir", "file_name", F.col("deleted_at").isNull().alias("is_live"))
    settled = settle_masters(store.read("file_metadata").join(place, "file_id"))
    store.commit(file_metadata=settled)
    members = store.read("file_metadata").join(place.filter("is_live"), "file_id")
    return members.groupBy("file_hash").count().filter("count > 1").count()


def masters(registry: DataFrame, metadata: DataFrame) -> DataFrame:
    """Live files that are masters, with what is known of them."""
    alive = S.live(registry).select(F.col("id").alias("file_id"), "file_dir", "file_name", "file_modified_at", "media_type")
    return alive.join(metadata.filter("is_master").drop("created_at"), "file_id")


def live_masters(store: S.Store) -> DataFrame:
    return masters(store.read("file_registry"), store.read("file_metadata"))


def plan(store: S.Store, cfg: PlanConfig, places: DataFrame | None, now: dt.datetime) -> int:
    """A proposal for all live masters; rows that were decided stay.  The settings' fingerprint is kept with it."""
    found = live_masters(store)
    proposal = propose(found, cfg, places).withColumn("created_at", F.lit(stamp(now)))
    return store.commit(files.config_stamp(cfg), entries=S.replace_proposals(store.read("entries"), proposal, found))["entries"]


def is_stale(store: S.Store, cfg: PlanConfig) -> bool:
    """Whether there is a proposal and it was made with other settings."""
    return store.stamp is not None and store.stamp != files.config_stamp(cfg)


def run(store: S.Store, roots: list[str], documents: DataFrame, cfg: PlanConfig = PlanConfig(), places: DataFrame | None = None, force: bool = False, now: dt.datetime | None = None) -> dict[str, int]:
    now = now or dt.datetime.now(dt.timezone.utc)
    found = scan(store, roots, now, force)
    read_new(store, documents, now)
    return {"files": found, "groups": score(store), "entries": plan(store, cfg, places, now)}


def review(store: S.Store) -> list[Node]:
    return build_tree(folder_table(store.read("entries"), store.read("file_metadata")))


def labels(store: S.Store) -> list[str]:
    """Names that users gave before, in order."""
    return [r["label"] for r in distinct_values(store.read("user_labels"), column="label", out="label").collect()]


def approve(store: S.Store, tree: list[Node], inside=None, now: dt.datetime | None = None) -> list[str]:
    """Confirm the edited tree: rows of the slice are approved, and names that were given by hand are learned and returned."""
    entries = store.read("entries")
    confirmed, learned = confirm(entries, tree, inside), given_names(tree)
    at = stamp(now or dt.datetime.now(dt.timezone.utc))
    known = store.read("user_labels")
    new = store.spark.createDataFrame([(n, "EVENT", at) for n in learned], USER_LABELS)
    store.commit(entries=confirmed, user_labels=known.unionByName(new.join(known.select("label"), "label", "left_anti")))
    return learned


def set_slice(store: S.Store, inside, approved: bool) -> int:
    """Approve a slice as it is proposed, or open an approved one again; how many rows changed."""
    entries = store.read("entries")
    frm = PROPOSED if approved else APPROVED
    n = entries.filter(inside & (F.col("status") == frm)).count()
    store.commit(entries=S.set_status(entries, inside, approved))
    return n
