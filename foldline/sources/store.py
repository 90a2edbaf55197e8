"""The catalogue's state as versioned Parquet snapshots, and the changes made to it.

A phase reads the current version of its tables and commits new ones under new paths.  Each commit writes a manifest of the
next number, moved to its name in one rename; readers take the highest, so they see all of a commit or nothing, whatever
breaks off in between, and no path is overwritten while it is read.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import under
from ..schema import ANALYZED, ANALYZING, APPROVED, DISCOVERED, ENTRIES, FAILED, FILE_METADATA, FILE_REGISTRY, PROPOSED, USER_LABELS

TABLES = {"file_registry": FILE_REGISTRY, "file_metadata": FILE_METADATA, "entries": ENTRIES, "user_labels": USER_LABELS}
VERSION = 3
_MANIFEST = re.compile(r"manifest-(\d{12})\.json")


class Conflict(RuntimeError):
    """Another commit came first."""


class Store:
    """Tables under one URI of any Hadoop file system.  A store of an older schema is brought to the current one when opened."""

    def __init__(self, spark: SparkSession, uri: str):
        self.spark, self.uri = spark, uri.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.uri).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        found = self.manifest()["schema"]
        if found > VERSION:
            raise ValueError(f"the store's schema {found} is newer than this library's {VERSION}")
        for step in range(found, VERSION):
            self._commit(MIGRATIONS[step](self), step + 1)

    def _number(self) -> int:
        """Of the newest manifest, 0 where there is none."""
        at = self._path(self.uri)
        if not self._fs.exists(at):
            return 0
        names = [x.getPath().getName() for x in self._fs.listStatus(at)]
        return max((int(m[1]) for n in names if (m := _MANIFEST.fullmatch(n))), default=0)

    def _file(self, n: int) -> str:
        return f"{self.uri}/manifest-{n:012d}.json"

    def manifest(self) -> dict:
        n = self._number()
        if not n:
            return {"schema": VERSION, "tables": {}, "stamp": None}
        stream = self._fs.open(self._path(self._file(n)))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def read(self, table: str) -> DataFrame:
        path = self.manifest()["tables"].get(table)
        if path is None:
            return self.spark.createDataFrame([], TABLES[table])
        return self.spark.read.schema(TABLES[table]).parquet(f"{self.uri}/{path}")

    @property
    def stamp(self) -> str | None:
        """The fingerprint of the settings that the proposal was made with."""
        return self.manifest().get("stamp")

    def commit(self, stamp: str | None = None, **tables: DataFrame) -> dict[str, int]:
        """Write new versions of the tables, then name them in the next manifest; the row counts are returned.

        Raises ``Conflict`` where another commit was made meanwhile; what was written then is in no manifest.
        """
        return self._commit(tables, VERSION, stamp)

    def _commit(self, tables: dict[str, DataFrame], schema: int, stamp: str | None = None) -> dict[str, int]:
        number, old = self._number(), self.manifest()
        paths, counts = dict(old["tables"]), {}
        for name, df in tables.items():
            path = f"{name}/v={number + 1}-{uuid.uuid4().hex[:12]}"
            shaped = df.select(*(F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in TABLES[name].fields))
            shaped.write.parquet(f"{self.uri}/{path}")
            paths[name] = path
            counts[name] = self.spark.read.parquet(f"{self.uri}/{path}").count()
        self._publish(number + 1, {"schema": schema, "tables": paths, "stamp": stamp or old.get("stamp")})
        return counts

    def _publish(self, number: int, manifest: dict) -> None:
        fresh, at = self._path(f"{self.uri}/new-{uuid.uuid4().hex}.json"), self._path(self._file(number))
        out = self._fs.create(fresh, False)
        out.write(json.dumps(manifest).encode())
        out.close()
        if self._fs.exists(at) or not self._fs.rename(fresh, at):
            self._fs.delete(fresh, False)
            raise Conflict(f"manifest {number} is there already")

    def vacuum(self) -> int:
        """Delete what the newest manifest doesn't name; how many paths went.  No reader may still hold older versions."""
        named, gone = {self._file(self._number()), *(f"{self.uri}/{p}" for p in self.manifest()["tables"].values())}, 0
        top = self._path(self.uri)
        for x in self._fs.listStatus(top):
            inner = [y.getPath() for y in self._fs.listStatus(x.getPath())] if x.isDirectory() else [x.getPath()]
            for p in inner:
                if not any(str(p).endswith(n.rsplit("://", 1)[-1]) for n in named):
                    self._fs.delete(p, True)
                    gone += 1
        return gone

    def reset(self) -> dict[str, int]:
        """Empty all tables; how many rows each had."""
        had = {n: self.read(n).count() for n in TABLES}
        self.commit(**{n: self.spark.createDataFrame([], s) for n, s in TABLES.items()})
        return had


def _with_kinds(store: Store) -> dict[str, DataFrame]:
    """Schema 2 tells what an identity is of: before it, all were of contents."""
    return {"file_metadata": store.read("file_metadata").withColumn("hash_kind", F.coalesce("hash_kind", F.lit("content")))}


def _with_locations(store: Store) -> dict[str, DataFrame]:
    """Schema 3 keeps the location's folder of an entry: before it, where unknown, the entry's own folder."""
    return {"entries": store.read("entries").withColumn("location_dir", F.coalesce("location_dir", F.regexp_replace("target_path", r"/?[^/]*\z", "")))}


#: What brings a store of that schema to the next; each may run again where it broke off.
MIGRATIONS: dict[int, Callable[[Store], dict[str, DataFrame]]] = {1: _with_kinds, 2: _with_locations}


def live(registry: DataFrame) -> DataFrame:
    return registry.filter("deleted_at IS NULL")


def settle_ids(rows: DataFrame, had, id: str = "id") -> DataFrame:
    """Rows whose new id another row has get one hashed anew (``had``: the condition of rows that keep theirs).

    64-bit hashes of 1e9 paths collide with a chance of 3 %; two collisions of one path don't happen.
    """
    twice = rows.groupBy(id).agg(F.count("*").alias("_n")).filter("_n > 1").select(id, F.lit(True).alias("_twice"))
    again = F.col("_twice").isNotNull() & ~had
    return rows.join(twice, id, "left").withColumn(id, F.when(again, F.xxhash64("file_dir", "file_name", F.lit("again"))).otherwise(F.col(id))).drop("_twice")


def upsert(old: DataFrame, seen: DataFrame, now: str, force: bool = False) -> DataFrame:
    """The registry after a scan: new files and changed ones (by size or time, or left unfinished) are DISCOVERED again,
    files seen again are no longer deleted, a known volume outlives an unknown one, all others stay."""
    keys = ["file_dir", "file_name"]
    new = seen.select(*keys, *(F.col(c).alias(f"n_{c}") for c in ("file_size", "file_modified_at", "volume_uuid", "media_type", "file_extension")), F.lit(True).alias("_seen"))
    j = old.withColumn("_had", F.lit(True)).join(new, keys, "full_outer")
    hit, had = F.coalesce("_seen", F.lit(False)), F.coalesce("_had", F.lit(False))
    changed = ~F.col("file_size").eqNullSafe(F.col("n_file_size")) | ~F.col("file_modified_at").eqNullSafe(F.col("n_file_modified_at")) | F.col("scan_status").isin(ANALYZING, FAILED) | F.lit(force)
    put = lambda c, x: F.when(hit, x).otherwise(F.col(c)).alias(c)
    got = j.select(
        F.coalesce("id", F.xxhash64(*keys)).alias("id"),
        had.alias("_old"),
        *keys,
        put("file_size", F.col("n_file_size")),
        put("file_modified_at", F.col("n_file_modified_at")),
        put("volume_uuid", F.coalesce("n_volume_uuid", "volume_uuid")),
        F.coalesce("discovered_at", F.lit(now)).alias("discovered_at"),
        put("last_seen_at", F.lit(now)),
        put("deleted_at", F.lit(None).cast("string")),
        put("media_type", F.col("n_media_type")),
        put("file_extension", F.col("n_file_extension")),
        F.when(~had, DISCOVERED).when(hit & changed, DISCOVERED).otherwise(F.col("scan_status")).alias("scan_status"),
        F.coalesce("file_origin", F.lit("SOURCE")).alias("file_origin"),
    )
    return settle_ids(got, F.col("_old")).drop("_old")


def sweep(registry: DataFrame, roots: list[str], now: str) -> DataFrame:
    """Live files under the roots that this run (at ``now``) hasn't seen are deleted from now on."""
    inside = F.lit(False)
    for r in roots:
        inside = inside | under(F.col("file_dir"), r)
    gone = inside & F.col("deleted_at").isNull() & (F.col("last_seen_at") < now)
    return registry.withColumn("deleted_at", F.when(gone, now).otherwise(F.col("deleted_at")))


def purge(registry: DataFrame, metadata: DataFrame, entries: DataFrame, before: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All three tables without files deleted before that time."""
    dead = registry.filter(F.col("deleted_at") < before).select(F.col("id").alias("file_id"))
    return registry.filter(F.coalesce(F.col("deleted_at") >= before, F.lit(True))), metadata.join(dead, "file_id", "left_anti"), entries.join(dead, "file_id", "left_anti")


def requeue_shared_sizes(registry: DataFrame, metadata: DataFrame) -> DataFrame:
    """Files whose identity was their size alone are DISCOVERED again once another live file has that size."""
    shared = live(registry).groupBy("file_size").agg(F.count("*").alias("n")).filter("n > 1").select("file_size")
    by_size = metadata.filter("hash_kind = 'size'").select(F.col("file_id").alias("id"))
    again = live(registry).join(shared, "file_size", "left_semi").join(by_size, "id", "left_semi").select("id", F.lit(True).alias("_again"))
    return registry.join(again, "id", "left").withColumn("scan_status", F.when(F.col("_again"), DISCOVERED).otherwise(F.col("scan_status"))).drop("_again")


def replace_metadata(metadata: DataFrame, fresh: DataFrame, failed: DataFrame) -> DataFrame:
    """Metadata with the rows of read files replaced and those of failed ones (``file_id``) gone."""
    touched = fresh.select("file_id").unionByName(failed.select("file_id"))
    return metadata.join(touched, "file_id", "left_anti").unionByName(fresh, allowMissingColumns=True)


def mark_read(registry: DataFrame, done: DataFrame, failed: DataFrame) -> DataFrame:
    """New scan states of the files (``file_id``) that were read or failed."""
    state = done.select(F.col("file_id").alias("id"), F.lit(ANALYZED).alias("_s")).unionByName(failed.select(F.col("file_id").alias("id"), F.lit(FAILED).alias("_s")))
    return registry.join(state, "id", "left").withColumn("scan_status", F.coalesce("_s", "scan_status")).drop("_s")


def replace_proposals(entries: DataFrame, proposal: DataFrame, masters: DataFrame) -> DataFrame:
    """Decided rows of files that still are live masters stay; all other rows give way to the proposal's rows of undecided files."""
    kept = entries.filter(F.col("status") != PROPOSED).join(masters.select("file_id"), "file_id", "left_semi")
    return kept.unionByName(proposal.join(kept.select("file_id"), "file_id", "left_anti"), allowMissingColumns=True)


def set_status(entries: DataFrame, inside, approve: bool) -> DataFrame:
    """Approve, or open again, the reviewable rows that meet the condition."""
    frm, to = (PROPOSED, APPROVED) if approve else (APPROVED, PROPOSED)
    return entries.withColumn("status", F.when(inside & (F.col("status") == frm), to).otherwise(F.col("status")))
