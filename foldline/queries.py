"""The registered queries over the driver's tables: each applies one operator to whole tables, beside its DuckDB equivalent."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import geo, media, names, paths, text, times
from .operators import dedup, fuzzy, groups, islands, naming, nearest, sessions, summary, tree
from .plans import catalogue, places, review
from .schema import APPROVED, PROPOSED
from .sources import store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# -- identical content -------------------------------------------------------------------------------------------------


@query("SELECT n_chars FROM documents WHERE n_chars IS NOT NULL GROUP BY n_chars HAVING count(*) = 1")
def unique_sizes(s, d):
    return dedup.unique_keys(t(s, d, "documents"), "n_chars")


@query("SELECT doc_id, n_chars FROM documents WHERE n_chars IN (SELECT n_chars FROM documents GROUP BY n_chars HAVING count(*) > 1)")
def resized_retraction(s, d):
    docs = t(s, d, "documents").select("doc_id", "n_chars")
    return docs.join(dedup.repeated_keys(docs, "n_chars"), "n_chars", "left_semi").select("doc_id", "n_chars")


@query(
    "SELECT doc_id, CASE WHEN count(*) OVER (PARTITION BY n_chars) = 1 THEN 'size' ELSE 'content' END AS hash_kind, "
    "CASE WHEN count(*) OVER (PARTITION BY n_chars) = 1 THEN 'size:' || doc_id ELSE sha256(text) END AS file_hash FROM documents"
)
def content_identity(s, d):
    docs = t(s, d, "documents")
    return dedup.content_identity(docs, id="doc_id", size="n_chars", content=F.col("text")).select("doc_id", "hash_kind", "file_hash")


@query("SELECT sha256(text) AS file_hash, count(*) AS members FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_groups(s, d):
    docs = t(s, d, "documents").select(F.sha2(F.col("text").cast("binary"), 256).alias("file_hash"))
    return dedup.repeated_keys(docs, "file_hash").withColumnRenamed("n", "members")


_FILES = "SELECT doc_id, source || '/' || lang AS file_dir, 'IMG_' || (doc_id % 97) || (CASE WHEN doc_id % 3 = 0 THEN ' (1)' WHEN doc_id % 5 = 0 THEN '_walk' ELSE '' END) || '.txt' AS file_name, text FROM documents"
_SCORE = r"""(CASE WHEN NOT regexp_matches(stem, '^(_?[A-Z]{1,5}_?)\d+(_\d+)*$') AND regexp_matches(stem, '[a-zA-Z]') THEN 4 ELSE 0 END
 + CASE WHEN regexp_matches(file_name, '^(\d{8}_|\d{4}-\d{2}-\d{2}_|\d{4}_\d{2}_\d{2}_)') THEN 3 ELSE 0 END
 + CASE WHEN lower(regexp_extract(file_dir, '([^/]*)$', 1)) IN ('dcim','camera','photos','temp','downloads','desktop','backup','misc') THEN 0 ELSE 2 END
 - CASE WHEN regexp_matches(stem, '(?i)([ _-]*\(\d+\)|[ _-]copy(\s*\(?\d*\)?)?)$') THEN 3 ELSE 0 END)"""


def _files(s, d):
    i = F.col("doc_id")
    tail = F.when(i % 3 == 0, " (1)").when(i % 5 == 0, "_walk").otherwise("")
    return t(s, d, "documents").select("doc_id", F.concat_ws("/", "source", "lang").alias("file_dir"), F.concat(F.lit("IMG_"), (i % 97).cast("string"), tail, F.lit(".txt")).alias("file_name"), "text")


@query(
    f"WITH f AS ({_FILES}), g AS (SELECT *, regexp_replace(file_name, '\\.[^.]*$', '') AS stem, sha256(text) AS h FROM f), "
    f"r AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY {_SCORE} DESC, octet_length(encode(file_dir)) + octet_length(encode(file_name)), file_dir, file_name, doc_id) AS rn FROM g) "
    "SELECT doc_id, h AS file_hash, rn = 1 AS is_master FROM r"
)
def elect_master(s, d):
    f = _files(s, d).withColumn("file_hash", F.sha2(F.col("text").cast("binary"), 256)).drop("text")
    return dedup.elect_masters(f, id="doc_id").select("doc_id", "file_hash", "is_master")


@query(
    f"WITH f AS ({_FILES}), g AS (SELECT *, regexp_replace(file_name, '\\.[^.]*$', '') AS stem, sha256(text) AS h, file_dir NOT LIKE '%/de' AS live, doc_id % 2 = 0 AS was FROM f), "
    f"c AS (SELECT *, count(*) FILTER (live) OVER (PARTITION BY h) AS alive, row_number() OVER (PARTITION BY h ORDER BY live DESC, {_SCORE} DESC, octet_length(encode(file_dir)) + octet_length(encode(file_name)), file_dir, file_name, doc_id) AS rn FROM g) "
    "SELECT doc_id, CASE WHEN alive > 1 THEN live AND rn = 1 WHEN alive = 1 AND live THEN TRUE ELSE was END AS is_master FROM c"
)
def lone_survivor(s, d):
    f = _files(s, d).withColumn("file_hash", F.sha2(F.col("text").cast("binary"), 256)).drop("text")
    f = f.withColumn("is_live", ~F.col("file_dir").endswith("/de")).withColumn("is_master", F.col("doc_id") % 2 == 0)
    return dedup.settle_masters(f, id="doc_id").select("doc_id", "is_master")


@query(f"WITH f AS ({_FILES}), g AS (SELECT *, regexp_replace(file_name, '\\.[^.]*$', '') AS stem FROM f) SELECT doc_id, CAST({_SCORE} AS BIGINT) AS score, CAST(octet_length(encode(file_dir)) + octet_length(encode(file_name)) AS BIGINT) AS path_bytes FROM g")
def name_scores(s, d):
    f = _files(s, d)
    return f.select("doc_id", text.file_score(F.col("file_dir"), F.col("file_name")).cast("long").alias("score"), text.path_bytes(F.col("file_dir"), F.col("file_name")).cast("long").alias("path_bytes"))


@query(
    "WITH p AS (SELECT page_id, regexp_extract(url, '([^/]*)$', 1) AS name FROM pages), e AS (SELECT page_id, name, lower(regexp_extract(name, '(\\.[^./]*)$', 1)) AS ext FROM p) "
    "SELECT page_id, ext, CASE WHEN name LIKE '.\\_%' ESCAPE '\\' THEN 'UNKNOWN' WHEN ext IN ('.jpg','.jpeg','.png','.bmp','.heic','.webp') THEN 'IMAGE' WHEN ext IN ('.mp4','.mov') THEN 'VIDEO' "
    "WHEN ext IN ('.cr2','.dng') THEN 'RAW' WHEN ext = '.aae' THEN 'SIDECAR' ELSE 'UNKNOWN' END AS media_type FROM e"
)
def classify_ext(s, d):
    name = text.base_name(F.col("url"))
    return t(s, d, "pages").select("page_id", F.lower(text.extension(name)).alias("ext"), media.media_type(name).alias("media_type"))


_PATH = "regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '')"


def _page_path():
    return F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), r"[?#].*\z", "")


@query(
    f"WITH p AS (SELECT page_id, {_PATH} AS path FROM pages), h AS (SELECT split_part(path, '/', 1) AS host FROM p GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) "
    "SELECT page_id, path FROM p, h WHERE path = host OR (path >= host || '/' AND path < host || '0')"
)
def subtree_range(s, d):
    p = t(s, d, "pages").select("page_id", _page_path().alias("path"))
    host = p.groupBy(F.split("path", "/")[0].alias("host")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "host").first()
    return p.filter(paths.under(F.col("path"), f"{host['host']}/")) if host else p


@query("SELECT coalesce(source, '') AS volume, min(lang) AS first_lang, count(*) AS n FROM documents GROUP BY 1")
def volume_groups(s, d):
    return summary.volume_groups(t(s, d, "documents"), volume="source", first="lang", out="first_lang")


@query("SELECT CAST(coalesce(sum(n_chars), 0) AS BIGINT) AS library_bytes, count(*) AS files FROM documents")
def library_size(s, d):
    return summary.library_size(t(s, d, "documents"), size="n_chars")


# -- state -------------------------------------------------------------------------------------------------------------


# Orders stand for files: those that aren't of low priority were known, those that aren't urgent are seen by a scan of January.
_OLD, _NOW = "2023-12-01T00:00:00.000000000Z", "2024-01-01T00:00:00.000000000Z"
_REGISTRY = f"""WITH old AS (SELECT o_orderkey AS id, 'c' || (o_custkey % 50) AS file_dir, 'f' || o_orderkey AS file_name, o_custkey AS file_size, CASE WHEN o_orderkey % 11 = 0 THEN 'v1' END AS volume_uuid,
  CASE WHEN o_orderkey % 13 = 0 THEN '{_OLD}' END AS deleted_at, CASE WHEN o_orderstatus = 'P' THEN 'ANALYZING' ELSE 'ANALYZED' END AS st FROM orders WHERE o_orderpriority <> '5-LOW'),
seen AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN o_custkey + 1 ELSE o_custkey END AS file_size FROM orders WHERE o_orderpriority <> '1-URGENT')"""


def _registry(s, d):
    o, k = t(s, d, "orders").filter("o_orderpriority <> '5-LOW'"), F.col("o_orderkey")
    return o.select(
        k.alias("id"),
        F.concat(F.lit("c"), (F.col("o_custkey") % 50).cast("string")).alias("file_dir"),
        F.concat(F.lit("f"), k.cast("string")).alias("file_name"),
        F.col("o_custkey").alias("file_size"),
        F.lit("t").alias("file_modified_at"),
        F.when(k % 11 == 0, "v1").alias("volume_uuid"),
        F.lit(_OLD).alias("discovered_at"),
        F.lit(_OLD).alias("last_seen_at"),
        F.when(k % 13 == 0, _OLD).alias("deleted_at"),
        F.lit("IMAGE").alias("media_type"),
        F.lit(".jpg").alias("file_extension"),
        F.when(F.col("o_orderstatus") == "P", "ANALYZING").otherwise("ANALYZED").alias("scan_status"),
        F.lit("SOURCE").alias("file_origin"),
    )


def _seen(s, d):
    o, k = t(s, d, "orders").filter("o_orderpriority <> '1-URGENT'"), F.col("o_orderkey")
    return o.select(
        F.concat(F.lit("c"), (F.col("o_custkey") % 50).cast("string")).alias("file_dir"),
        F.concat(F.lit("f"), k.cast("string")).alias("file_name"),
        F.when(k % 5 == 0, F.col("o_custkey") + 1).otherwise(F.col("o_custkey")).alias("file_size"),
        F.lit("t").alias("file_modified_at"),
        F.lit(None).cast("string").alias("volume_uuid"),
        F.lit("IMAGE").alias("media_type"),
        F.lit(".jpg").alias("file_extension"),
    )


def _key(out="k"):
    return F.substring("file_name", 2, 30).cast("long").alias(out)


@query(
    _REGISTRY + " SELECT coalesce(seen.id, old.id) AS k, coalesce(seen.file_size, old.file_size) AS file_size, volume_uuid, CASE WHEN seen.id IS NULL THEN deleted_at END AS deleted_at, "
    "CASE WHEN old.id IS NULL THEN 'DISCOVERED' WHEN seen.id IS NULL THEN st WHEN seen.file_size <> old.file_size OR st = 'ANALYZING' THEN 'DISCOVERED' ELSE st END AS scan_status, old.id IS NOT NULL AS kept_id FROM old FULL JOIN seen ON old.id = seen.id"
)
def upsert_status(s, d):
    return store.upsert(_registry(s, d), _seen(s, d), _NOW).select(_key(), "file_size", "volume_uuid", "deleted_at", "scan_status", F.col("id").eqNullSafe(_key("x")).alias("kept_id"))


@query(_REGISTRY + f" SELECT old.id AS k, CASE WHEN deleted_at IS NULL AND seen.id IS NULL AND (file_dir = 'c1' OR starts_with(file_dir, 'c2')) THEN '{_NOW}' WHEN seen.id IS NULL THEN deleted_at END AS deleted_at FROM old LEFT JOIN seen ON old.id = seen.id WHERE file_dir = 'c1' OR file_dir = 'c2' OR NOT starts_with(file_dir, 'c2')")
def sweep_gone(s, d):
    after = store.sweep(store.upsert(_registry(s, d), _seen(s, d), _NOW), ["c1", "c2"], _NOW)
    known = after.filter(F.col("discovered_at") == _OLD)
    return known.filter((F.col("file_dir") == "c2") | ~F.col("file_dir").startswith("c2")).select(_key(), "deleted_at")


@query(
    f"WITH r AS (SELECT o_orderkey AS id, CASE WHEN o_orderdate < TIMESTAMP '1996-01-01' THEN '{_OLD}' END AS deleted_at FROM orders), dead AS (SELECT id FROM r WHERE deleted_at IS NOT NULL) "
    "SELECT 'registry' AS what, count(*) AS n FROM r WHERE deleted_at IS NULL UNION ALL SELECT 'metadata', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT id FROM dead) "
    "UNION ALL SELECT 'entries', count(*) FROM lineitem WHERE l_returnflag = 'R' AND l_orderkey NOT IN (SELECT id FROM dead)"
)
def purge_cascade(s, d):
    registry = t(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderdate") < "1996-01-01", _OLD).alias("deleted_at"))
    items = t(s, d, "lineitem").select(F.col("l_orderkey").alias("file_id"), "l_returnflag")
    kept = store.purge(registry, items, items.filter("l_returnflag = 'R'"), _NOW)
    count = lambda df, what: df.agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "n")
    return count(kept[0], "registry").unionByName(count(kept[1], "metadata")).unionByName(count(kept[2], "entries"))


@query(
    _REGISTRY + ", alive AS (SELECT * FROM old WHERE deleted_at IS NULL), shared AS (SELECT file_size FROM alive GROUP BY 1 HAVING count(*) > 1) "
    "SELECT id, CASE WHEN deleted_at IS NULL AND id % 3 = 0 AND file_size IN (SELECT file_size FROM shared) THEN 'DISCOVERED' ELSE st END AS scan_status FROM old"
)
def requeue_sizes(s, d):
    r = _registry(s, d)
    meta = r.select(F.col("id").alias("file_id"), F.when(F.col("id") % 3 == 0, "size").otherwise("content").alias("hash_kind"))
    return store.requeue_shared_sizes(r, meta).select("id", "scan_status")


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN 'ERROR' WHEN o_orderkey % 7 < 4 THEN 'ANALYZED' ELSE CASE WHEN o_orderstatus = 'P' THEN 'ANALYZING' ELSE 'ANALYZED' END END AS scan_status FROM orders WHERE o_orderpriority <> '5-LOW'")
def mark_read(s, d):
    r = _registry(s, d)
    ids = r.select(F.col("id").alias("file_id"))
    return store.mark_read(r, ids.filter("file_id % 7 BETWEEN 1 AND 3"), ids.filter("file_id % 7 = 0")).select("id", "scan_status")


@query("SELECT l_orderkey AS file_id, 'old' AS file_hash, count(*) AS n FROM lineitem WHERE l_orderkey % 5 > 1 GROUP BY 1 UNION ALL SELECT o_orderkey, 'new', 1 FROM orders WHERE o_orderkey % 5 = 0")
def replace_metadata(s, d):
    old = t(s, d, "lineitem").select(F.col("l_orderkey").alias("file_id"), F.lit("old").alias("file_hash"))
    fresh = t(s, d, "orders").filter("o_orderkey % 5 = 0").select(F.col("o_orderkey").alias("file_id"), F.lit("new").alias("file_hash"))
    failed = t(s, d, "orders").filter("o_orderkey % 5 = 1").select(F.col("o_orderkey").alias("file_id"))
    return store.replace_metadata(old, fresh, failed).groupBy("file_id", "file_hash").agg(F.count("*").alias("n"))


@query(_REGISTRY + " SELECT id AS file_id, file_dir, file_name, c_name AS exif_make FROM old JOIN customer ON c_custkey = file_size WHERE deleted_at IS NULL AND c_acctbal > 0")
def load_masters(s, d):
    r = _registry(s, d)
    who = t(s, d, "customer").select(F.col("c_custkey").alias("file_size"), F.col("c_name").alias("exif_make"), (F.col("c_acctbal") > 0).alias("is_master"), F.lit("x").alias("created_at"))
    meta = r.select(F.col("id").alias("file_id"), "file_size").join(who, "file_size").drop("file_size")
    return catalogue.masters(r, meta).select("file_id", "file_dir", "file_name", "exif_make")


_ENTRY = """WITH e AS (SELECT o_orderkey AS file_id, o_custkey % 20 || '/' || strftime(o_orderdate, '%Y/%m') || '/' || o_orderkey || '.jpg' AS target_path,
  CASE o_orderstatus WHEN 'F' THEN 'APPROVED' WHEN 'O' THEN 'PROPOSED' ELSE 'DONE' END AS status, o_orderdate AS taken_at, o_custkey AS who FROM orders)"""


def _entries(s, d):
    o, k = t(s, d, "orders"), F.col("o_orderkey").cast("string")
    target = F.concat((F.col("o_custkey") % 20).cast("string"), F.lit("/"), F.date_format("o_orderdate", "yyyy/MM"), F.lit("/"), k, F.lit(".jpg"))
    status = F.when(F.col("o_orderstatus") == "F", APPROVED).when(F.col("o_orderstatus") == "O", PROPOSED).otherwise("DONE")
    return o.select(F.col("o_orderkey").alias("file_id"), F.concat(F.lit("/s/"), k).alias("source_path"), target.alias("target_path"), status.alias("status"), F.col("o_orderdate").alias("taken_at"), "o_custkey")


@query(
    _ENTRY + ", m AS (SELECT file_id, dir, lat FROM (SELECT file_id, regexp_replace(target_path, '/[^/]*$', '') AS dir, who FROM e WHERE status <> 'DONE') LEFT JOIN (SELECT c_custkey, c_acctbal AS lat FROM customer WHERE c_acctbal > 0) ON who = c_custkey), "
    "x AS (SELECT file_id, lat, array_to_string(p[1:i], '/') AS node_id FROM (SELECT file_id, lat, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT file_id, lat, string_split(dir, '/') AS p FROM m))) "
    "SELECT node_id, count(*) AS file_count, arg_min(lat, file_id) FILTER (lat IS NOT NULL) AS lat FROM x GROUP BY 1"
)
def tree_left_join(s, d):
    e = _entries(s, d)
    where = t(s, d, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), F.col("c_acctbal").alias("exif_gps_latitude"), F.lit(1.0).alias("exif_gps_longitude"))
    meta = e.select("file_id", "o_custkey").join(where, "o_custkey").drop("o_custkey")
    return review.folder_table(e.drop("o_custkey"), meta).select("node_id", "file_count", "lat")


@query(
    _ENTRY + ", live AS (SELECT file_id FROM e WHERE who IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)), kept AS (SELECT file_id, status, target_path FROM e WHERE status <> 'PROPOSED' AND file_id IN (SELECT file_id FROM live)) "
    "SELECT * FROM kept UNION ALL SELECT file_id, 'PROPOSED', 'new/' || file_id FROM e WHERE file_id % 2 = 0 AND file_id NOT IN (SELECT file_id FROM kept)"
)
def keep_decided(s, d):
    e = _entries(s, d)
    good = t(s, d, "customer").filter("c_acctbal >= 0").select(F.col("c_custkey").alias("o_custkey"))
    masters = e.join(good, "o_custkey", "left_semi").select("file_id")
    proposal = e.filter("file_id % 2 = 0").withColumn("status", F.lit(PROPOSED)).withColumn("target_path", F.concat(F.lit("new/"), F.col("file_id").cast("string")))
    return store.replace_proposals(e, proposal, masters).select("file_id", "status", "target_path")


# -- scalar functions --------------------------------------------------------------------------------------------------


@query("SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE CASE WHEN event_id % 5 = 0 THEN date_trunc('day', ts) ELSE date_trunc('second', ts) END END AS taken_at FROM events")
def exif_time(s, d):
    e, i = t(s, d, "events").select("event_id", "ts"), F.col("event_id")
    shown = (
        F.when(i % 7 == 0, "not a time")
        .when(i % 5 == 0, F.date_format("ts", "yyyy-MM-dd"))
        .when(i % 3 == 0, F.concat(F.date_format("ts", "yyyy:MM:dd HH:mm:ss"), F.lit("+00:00")))
        .when(i % 2 == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .otherwise(F.date_format("ts", "yyyy:MM:dd HH:mm:ss"))
    )
    return e.select("event_id", times.first_time(F.lit("0000:00:00 00:00:00"), F.lit("1969:12:31 23:00:00"), F.lit(""), shown).alias("taken_at"))


@query("SELECT event_id, coalesce(json_extract_string(props, '$.k'), '') AS k, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k_number, coalesce(json_extract_string(props, '$.missing'), '') AS missing FROM events")
def tolerant_json(s, d):
    k = media.tag(F.col("props"), "k")
    return t(s, d, "events").select("event_id", k.alias("k"), text.null_if_empty(k).try_cast("bigint").alias("k_number"), media.tag(F.col("props"), "missing").alias("missing"))


@query("SELECT p_partkey, CASE WHEN x = '' THEN '-' ELSE x END AS segment FROM (SELECT p_partkey, trim(regexp_replace(translate(p_name || ', ' || p_type || '/' || p_brand, '/\\: ,', '-----'), '-+', '-', 'g'), ' ._-') AS x FROM part)")
def sanitize(s, d):
    return t(s, d, "part").select("p_partkey", text.sanitize(F.concat(F.col("p_name"), F.lit(", "), F.col("p_type"), F.lit("/"), F.col("p_brand"))).alias("segment"))


@query(
    "SELECT p_partkey, array_to_string(list_transform(regexp_extract_all(lower(p_type) || '_IPHONE-' || upper(p_brand), '[^ _-]*[ _-]|[^ _-]+$'), "
    "lambda w: CASE WHEN lower(regexp_replace(w, '[ _-]$', '')) = 'iphone' THEN 'iPhone' || regexp_extract(w, '[ _-]$') ELSE upper(w[1]) || lower(w[2:]) END), '') AS title FROM part"
)
def title_case(s, d):
    return t(s, d, "part").select("p_partkey", text.case_name(F.concat(F.lower("p_type"), F.lit("_IPHONE-"), F.upper("p_brand"))).alias("title"))


@query("SELECT p_partkey, CASE WHEN m = '' THEN b WHEN b = '' OR contains(lower(m), lower(b)) THEN m ELSE b || ' ' || m END AS device FROM (SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN '' ELSE p_brand END AS b, CASE WHEN p_size % 5 = 0 THEN '' WHEN p_size % 3 = 0 THEN upper(p_brand) || ' ' || p_name ELSE p_name END AS m FROM part)")
def device_name(s, d):
    p = t(s, d, "part")
    make = F.when(F.col("p_size") % 4 == 0, "").otherwise(F.col("p_brand"))
    model = F.when(F.col("p_size") % 5 == 0, "").when(F.col("p_size") % 3 == 0, F.concat(F.upper("p_brand"), F.lit(" "), F.col("p_name"))).otherwise(F.col("p_name"))
    return p.select("p_partkey", text.device_name(make, model).alias("device"))


@query("SELECT p_partkey, w, h, CASE WHEN w = 0 OR h = 0 THEN '' WHEN h > w THEN 'Vertical' ELSE 'Horizontal' END AS orientation FROM (SELECT p_partkey, CASE WHEN p_size % 9 BETWEEN 5 AND 8 THEN p_partkey % 11 ELSE p_size END AS w, CASE WHEN p_size % 9 BETWEEN 5 AND 8 THEN p_size ELSE p_partkey % 11 END AS h FROM part)")
def orientation(s, d):
    w, h = media.upright_size(F.col("p_size").cast("long"), F.col("p_partkey") % 11, F.col("p_size") % 9)
    return t(s, d, "part").select("p_partkey", w.alias("w"), h.alias("h"), media.orientation_name(w, h).alias("orientation"))


@query("SELECT doc_id, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN format('{:.1f} KiB', n / 1024.0) WHEN n < 1073741824 THEN format('{:.1f} MiB', n / 1048576.0) ELSE format('{:.1f} GiB', n / 1073741824.0) END AS size FROM (SELECT doc_id, n_chars * (1 + (doc_id % 4) * 1500) AS n FROM documents)")
def human_bytes(s, d):
    n = F.col("n_chars") * (1 + (F.col("doc_id") % 4) * 1500)
    return t(s, d, "documents").select("doc_id", text.human_bytes(n).alias("size"))


@query("SELECT vec_id, CASE WHEN bad THEN NULL ELSE round(sgn * (deg + mi / 60.0 + se / 3600.0), 6) END AS degrees FROM (SELECT vec_id, vec_id % 10 = 0 AS bad, CASE WHEN vec_id % 2 = 0 THEN 1 ELSE -1 END AS sgn, vec_id % 90 AS deg, vec_id % 60 AS mi, (vec_id * 7) % 60 AS se FROM embeddings)")
def dms_parse(s, d):
    i = F.col("vec_id")
    shown = F.format_string("%d deg %d' %d.00\" %s", i % 90, i % 60, (i * 7) % 60, F.when(i % 2 == 0, "N").otherwise("S"))
    return t(s, d, "embeddings").select("vec_id", F.round(geo.parse_dms(F.when(i % 10 == 0, "nowhere").otherwise(shown)), 6).alias("degrees"))


@query(
    "WITH h AS (SELECT source, CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT) AS h FROM documents) "
    "SELECT source, sha256(count(*) || ':' || CAST(sum(h) AS VARCHAR) || ':' || bit_xor(h)) AS fingerprint, count(*) AS members FROM h GROUP BY source"
)
def set_fingerprint(s, d):
    return summary.set_fingerprint(t(s, d, "documents"), keys=["source"], member="doc_id")


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '000Z' AS at FROM events")
def format_time(s, d):
    return t(s, d, "events").select("event_id", times.fixed_width(F.col("ts")).alias("at"))


# -- sessions, days ----------------------------------------------------------------------------------------------------

_GAPS = """WITH a AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) > 43200000000 THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
b AS (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM a)"""


def _sessions(s, d):
    return sessions.gap_sessions(t(s, d, "events").select("event_id", "ts", "user_id", "event_type"), ts="ts", gap_seconds=12 * 3600, keys=["user_id"], order=["event_id"])


@query(_GAPS + " SELECT user_id, session, count(*) AS events, min(ts) AS first_ts, max(ts) AS last_ts FROM b GROUP BY ALL")
def gap_clusters(s, d):
    return _sessions(s, d).groupBy("user_id", "session").agg(F.count("*").alias("events"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query(_GAPS + " SELECT event_id, session, CASE WHEN epoch_us(max(ts) OVER x) - epoch_us(min(ts) OVER x) <= 86400000000 THEN min(ts) OVER x END AS folder_date FROM b WINDOW x AS (PARTITION BY user_id, session)")
def session_start(s, d):
    return sessions.session_starts(_sessions(s, d), ts="ts", session="session", keys=["user_id"]).select("event_id", "session", "folder_date")


@query(
    "WITH a AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) > 120000000 THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (ORDER BY ts)), b AS (SELECT event_id, CAST(sum(new) OVER (ORDER BY ts RANGE UNBOUNDED PRECEDING) AS BIGINT) AS session FROM a) SELECT * FROM b"
)
def global_clusters(s, d):
    return sessions.gap_sessions(t(s, d, "events").select("event_id", "ts"), ts="ts", gap_seconds=120).select("event_id", "session")


@query(
    _GAPS + ", c AS (SELECT user_id, session, min(ts) AS lo, max(ts) AS hi FROM b GROUP BY ALL HAVING max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) = 0), "
    "n AS (SELECT user_id, session, 'c' || row_number() OVER (PARTITION BY user_id ORDER BY session) AS cluster_id, CASE WHEN CAST(lo AS DATE) = CAST(hi AS DATE) THEN strftime(lo, '%d') WHEN date_trunc('month', lo) = date_trunc('month', hi) THEN strftime(lo, '%d') || '-' || strftime(hi, '%d') ELSE strftime(lo, '%b_%d') || '-' || strftime(hi, '%b_%d') END AS event_segment FROM c) "
    "SELECT event_id, cluster_id, event_segment FROM b LEFT JOIN n USING (user_id, session)"
)
def cluster_labels(s, d):
    named = sessions.name_unlocated(_sessions(s, d), ts="ts", session="session", located=F.col("event_type") == "purchase", keys=["user_id"])
    return named.select("event_id", "cluster_id", "event_segment")


@query("WITH d AS (SELECT DISTINCT user_id, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS day FROM events), a AS (SELECT *, day - row_number() OVER (PARTITION BY user_id ORDER BY day) AS g FROM d) SELECT user_id, day, min(day) OVER (PARTITION BY user_id, g) AS first_day, max(day) OVER (PARTITION BY user_id, g) AS last_day FROM a")
def day_islands(s, d):
    e = t(s, d, "events").select("user_id", F.datediff("ts", F.lit("2024-01-01")).cast("long").alias("day"))
    return islands.day_runs(e, keys=["user_id"], day="day")


@query()
def day_merge_fixpoint(s, d):
    e = t(s, d, "events").select(F.date_format("ts", "yyyy-MM").alias("month"), "user_id", F.when(F.col("event_type") != "click", F.floor(F.dayofmonth("ts") / 10).cast("string")).alias("place"), F.dayofmonth("ts").alias("day"))
    return islands.merged_days(e.withColumn("month", F.concat_ws("/", "month", F.col("user_id").cast("string"))), month="month", place="place", day="day")


@query("SELECT event_id, max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, CAST(ts AS DATE)) = 1 AS mixed FROM events")
def mixed_parent(s, d):
    e = t(s, d, "events").select("event_id", "user_id", F.to_date("ts").alias("day"), "event_type")
    return groups.parent_flag(e, parent=["user_id", "day"], when=F.col("event_type") == "purchase", out="mixed").select("event_id", "mixed")


@query("SELECT count(DISTINCT nullif(p_brand, '')) <= 1 AS brand, count(DISTINCT nullif(p_type, '')) <= 1 AS type, count(DISTINCT CASE WHEN p_size >= 0 THEN 'Photos' END) <= 1 AS media FROM part")
def collapse_levels(s, d):
    skip = groups.uninformative(t(s, d, "part"), {"brand": F.col("p_brand"), "type": F.col("p_type"), "media": F.when(F.col("p_size") >= 0, "Photos")})
    return s.createDataFrame([tuple(n in skip for n in ("brand", "type", "media"))], "brand boolean, type boolean, media boolean")


_CAP = """WITH e AS (SELECT event_id, user_id, ts, CAST(user_id AS VARCHAR) || '/' || strftime(ts, '%Y-%m-%d %H') AS stem, CASE WHEN event_id % 3 = 0 THEN '' ELSE event_type END AS device, event_id % 5 <> 0 AS voter, value FROM events),
g AS (SELECT stem, count(*) AS members FROM e GROUP BY stem HAVING count(*) >= 2 AND epoch_us(max(CASE WHEN voter THEN ts END)) - epoch_us(min(CASE WHEN voter THEN ts END)) <= 1200000000 AND count(DISTINCT CASE WHEN voter THEN nullif(device, '') END) <= 1)"""


@query(_CAP + " SELECT stem, members, leader FROM (SELECT e.stem, members, event_id AS leader, row_number() OVER (PARTITION BY e.stem ORDER BY (CASE WHEN voter THEN 4 ELSE 0 END) + (CASE WHEN device <> '' THEN 2 ELSE 0 END) DESC, event_id) AS r FROM e JOIN g ON e.stem = g.stem) WHERE r = 1")
def capture_groups(s, d):
    e = t(s, d, "events").select("event_id", "ts", F.concat(F.col("user_id").cast("string"), F.lit("/"), F.date_format("ts", "yyyy-MM-dd HH")).alias("stem"), F.when(F.col("event_id") % 3 == 0, "").otherwise(F.col("event_type")).alias("device"), (F.col("event_id") % 5 != 0).alias("voter"))
    agreed = groups.agreeing_groups(e, keys=["stem"], ts="ts", voter=F.col("voter"), device="device", window_seconds=1200)
    score = F.when(F.col("voter"), 4).otherwise(0) + F.when(F.col("device") != "", 2).otherwise(0)
    lead = groups.leaders(e.join(agreed, "stem"), keys=["stem"], score=score, order="event_id", take=["event_id"])
    return agreed.join(lead, "stem").select("stem", "members", F.col("leader_event_id").alias("leader"))


# -- names, places -----------------------------------------------------------------------------------------------------


@query("SELECT p_partkey, p_brand || '/' || p_type || (CASE WHEN r = 1 THEN '' ELSE '_' || r END) AS target FROM (SELECT *, row_number() OVER (PARTITION BY lower(p_brand || '/' || p_type) ORDER BY p_partkey) AS r FROM part)")
def unique_names(s, d):
    return naming.unique_targets(t(s, d, "part").select("p_partkey", "p_brand", "p_type"), directory="p_brand", name="p_type", order=["p_partkey"], out="target").select("p_partkey", "target")


_POINTS = "WITH p AS (SELECT vec_id, label, round(embedding[1] * 2, 4) AS lat, round(embedding[2] * 2, 4) AS lon FROM embeddings), q AS (SELECT * FROM p), c AS (SELECT * FROM p)"


def _points(s, d):
    e = t(s, d, "embeddings")
    p = e.select("vec_id", "label", F.round(F.col("embedding")[0].cast("double") * 2, 4).alias("lat"), F.round(F.col("embedding")[1].cast("double") * 2, 4).alias("lon"))
    return p, p.select(F.col("vec_id").alias("place_id"), F.concat(F.lit("P"), F.col("label").cast("string")).alias("place"), F.col("lat").alias("latitude"), F.col("lon").alias("longitude"), (F.col("label") % 2 == 1).alias("marks"))


@query(
    _POINTS.replace("embedding[1] * 2", "CAST(embedding[1] AS DOUBLE) * 2").replace("embedding[2] * 2", "CAST(embedding[2] AS DOUBLE) * 2")
    + ", j AS (SELECT q.vec_id, c.vec_id AS place_id, 'P' || c.label AS place, c.label % 2 = 1 AS marks, (c.lat - q.lat) * (c.lat - q.lat) + (c.lon - q.lon) * (c.lon - q.lon) AS sq FROM q JOIN c ON c.lat BETWEEN q.lat - 0.45 AND q.lat + 0.45 AND c.lon BETWEEN q.lon - 0.45 AND q.lon + 0.45), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sq, place_id) AS r FROM j), z AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY marks, sq, r) AS rank FROM r WHERE r <= 32 AND sq <= 0.2025) SELECT vec_id, place_id, place, CAST(rank AS BIGINT) AS rank, round(sqrt(sq) * 111, 4) AS km FROM z WHERE rank <= 3"
)
def nearest_place(s, d):
    q, c = _points(s, d)
    pairs = nearest.near_pairs(q.select("vec_id", "lat", "lon"), c, key="vec_id", lat="lat", lon="lon", ties=["place_id"])
    got = nearest.candidates(pairs, key="vec_id", limit=3, marks="marks", ties=["place_id"])
    return got.select("vec_id", "place_id", "place", F.col("rank").cast("long").alias("rank"), F.round("dist_km", 4).alias("km"))


@query(
    "WITH p AS (SELECT vec_id, round(CAST(embedding[1] AS DOUBLE) * 2, 4) AS lat, round(CAST(embedding[2] AS DOUBLE) * 2, 4) AS lon FROM embeddings) SELECT vec_id, CASE WHEN (lat - 0.1) * (lat - 0.1) + (lon - 0.1) * (lon - 0.1) <= 0.2025 THEN 'Home' WHEN (lat - 0.3) * (lat - 0.3) + (lon + 0.2) * (lon + 0.2) <= 0.2025 THEN 'Work' ELSE 'Far' END AS place, ((lat - 0.1) * (lat - 0.1) + (lon - 0.1) * (lon - 0.1) <= 0.2025) OR ((lat - 0.3) * (lat - 0.3) + (lon + 0.2) * (lon + 0.2) <= 0.2025) AS at_saved_place FROM p"
)
def anchor_fold(s, d):
    p = t(s, d, "embeddings").select("vec_id", F.round(F.col("embedding")[0].cast("double") * 2, 4).alias("lat"), F.round(F.col("embedding")[1].cast("double") * 2, 4).alias("lon"), F.lit("Far").alias("place"))
    return nearest.fold_anchors(p, [("Home", 0.1, 0.1), ("Work", 0.3, -0.2)], lat="lat", lon="lon", place="place").select("vec_id", "place", "at_saved_place")


_PLACES = "SELECT p_partkey AS rowid, split_part(p_name, ' ', 1) AS city, p_type AS state, CASE WHEN p_size % 6 = 0 THEN '' ELSE p_brand END AS country FROM part"
_COUNTED = f"WITH p AS ({_PLACES}), a AS (SELECT lower(city) AS k, country, count(*) AS here FROM p GROUP BY ALL), b AS (SELECT k, CAST(sum(here) AS BIGINT) AS total, count(*) FILTER (country <> '') AS countries FROM a GROUP BY k)"


def _place_rows(s, d):
    return t(s, d, "part").select(F.col("p_partkey").alias("rowid"), F.split("p_name", " ")[0].alias("city"), F.col("p_type").alias("state"), F.when(F.col("p_size") % 6 == 0, "").otherwise(F.col("p_brand")).alias("country"))


def _counted(s, d):
    return places.name_counts(_place_rows(s, d), code="country")


@query(_COUNTED + " SELECT a.k AS city_key, country AS code, here AS in_country, total, countries FROM a JOIN b ON a.k = b.k")
def name_stats(s, d):
    return _counted(s, d).select("city_key", "code", "in_country", "total", "countries")


@query(
    _COUNTED + " SELECT rowid, CASE WHEN total <= 1 THEN city WHEN here > 1 AND state <> '' THEN city || ', ' || state WHEN countries > 1 AND p.country <> '' THEN city || ', ' || p.country WHEN state <> '' THEN city || ', ' || state ELSE city END AS display_name, "
    "concat_ws(', ', city, CASE WHEN state <> '' AND state <> city THEN state END, CASE WHEN p.country <> '' AND p.country <> (CASE WHEN state <> '' THEN state ELSE city END) THEN p.country END) AS full_name FROM p JOIN a ON lower(p.city) = a.k AND p.country = a.country JOIN b ON a.k = b.k"
)
def disambiguate(s, d):
    j = _place_rows(s, d).withColumn("city_key", text.ascii_lower(F.col("city"))).join(_counted(s, d).withColumnRenamed("code", "country"), ["city_key", "country"])
    c = F.col
    return j.select("rowid", names.disambiguate(c("city"), c("state"), c("country"), c("total"), c("countries"), c("in_country"), F.lit(False)).alias("display_name"), names.full_name(c("city"), c("state"), c("country")).alias("full_name"))


@query(
    _COUNTED + ", s AS (SELECT rowid, city, concat_ws(', ', city, CASE WHEN state <> '' AND state <> city THEN state END, CASE WHEN p.country <> '' AND p.country <> (CASE WHEN state <> '' THEN state ELSE city END) THEN p.country END) AS full_name FROM p "
    "WHERE starts_with(lower(city), (SELECT lower(substr(min(p_name), 1, 3)) FROM part))), r AS (SELECT *, row_number() OVER (PARTITION BY full_name ORDER BY city, rowid) AS r FROM s) SELECT rowid, city, full_name FROM r WHERE r = 1 ORDER BY city, rowid LIMIT 8"
)
def prefix_search(s, d):
    p = t(s, d, "part")
    typed = (p.agg(F.min("p_name")).first()[0] or "")[:3]
    rows = _place_rows(s, d).withColumn("country_code", F.col("country")).withColumn("latitude", F.lit(0.0)).withColumn("longitude", F.lit(0.0))
    return places.search(places.enrich(rows), typed).select("rowid", "city", "full_name")


@query(
    "WITH n AS (SELECT min(p_partkey) AS id, p_name AS name FROM part GROUP BY p_name), q AS (SELECT id AS qid, substr(name, 1, 2) || substr(name, 4) AS w FROM n), "
    "g AS (SELECT DISTINCT id, name, (' ' || lower(name) || ' ')[i:i + 2] AS g FROM (SELECT id, name, unnest(range(1, length(name) + 1)) AS i FROM n)), h AS (SELECT DISTINCT qid, w, (' ' || lower(w) || ' ')[i:i + 2] AS g FROM (SELECT qid, w, unnest(range(1, length(w) + 1)) AS i FROM q)), "
    "m AS (SELECT qid, w, id, name, count(*) AS overlap FROM h JOIN g USING (g) GROUP BY ALL) SELECT qid, w, id, name, overlap, CAST(levenshtein(lower(w), lower(name)) AS BIGINT) AS edits FROM m WHERE levenshtein(lower(w), lower(name)) <= 2"
)
def fuzzy_search(s, d):
    n = t(s, d, "part").groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("id"))
    q = n.select(F.col("id").alias("qid"), F.concat(F.substring("name", 1, 2), F.substring("name", 4, 1 << 20)).alias("w"))
    return fuzzy.match_all(n, q, id="id", name="name", query_id="qid", query="w").select("qid", "w", "id", "name", "overlap", F.col("edits").cast("long").alias("edits"))


@query(
    "WITH a AS (SELECT n_name AS value, 0 AS src, n_nationkey AS pos FROM nation WHERE n_regionkey = 1 UNION ALL SELECT p_brand, 1, min(p_partkey) FROM part GROUP BY p_brand UNION ALL SELECT n_name, 2, n_nationkey FROM nation), b AS (SELECT *, row_number() OVER (PARTITION BY value ORDER BY src, pos) AS r FROM a) SELECT value, CAST(src AS BIGINT) AS src, CAST(pos AS BIGINT) AS pos FROM b WHERE r = 1 ORDER BY src, pos LIMIT 8"
)
def suggest_union(s, d):
    n = t(s, d, "nation").select(F.col("n_name").alias("value"), F.col("n_nationkey").cast("long").alias("pos"), "n_regionkey")
    a = n.filter("n_regionkey = 1").select("value", F.lit(0).cast("long").alias("src"), "pos")
    b = t(s, d, "part").groupBy(F.col("p_brand").alias("value")).agg(F.min("p_partkey").alias("pos")).select("value", F.lit(1).cast("long").alias("src"), "pos")
    return places.keep_first(a.unionByName(b).unionByName(n.select("value", F.lit(2).cast("long").alias("src"), "pos")), "value", ["src", "pos"], 8)


# -- trees -------------------------------------------------------------------------------------------------------------


@query(
    "WITH e AS (SELECT o_orderdate AS t, CASE WHEN o_orderstatus = 'F' THEN 'APPROVED' ELSE 'PROPOSED' END AS status, strftime(o_orderdate, '%Y/%m') AS dir FROM orders), b AS (SELECT *, make_date(year(t), CAST((month(t) - 1) - (month(t) - 1) % 12 + 1 AS BIGINT), 1) AS start FROM e), "
    "f AS (SELECT start, count(DISTINCT p) AS folders FROM (SELECT start, dir AS p FROM b UNION ALL SELECT start, split_part(dir, '/', 1) FROM b) GROUP BY start) "
    "SELECT strftime(b.start, '%Y') AS label, strftime(b.start, '%Y-%m-%d') AS start, count(*) FILTER (status = 'PROPOSED') AS proposed, count(*) FILTER (status = 'APPROVED') AS approved, any_value(folders) AS folders FROM b JOIN f ON b.start = f.start GROUP BY b.start"
)
def segments(s, d):
    o = t(s, d, "orders")
    e = o.select(F.col("o_orderdate").alias("taken_at"), F.when(F.col("o_orderstatus") == "F", APPROVED).otherwise(PROPOSED).alias("status"), F.concat(F.date_format("o_orderdate", "yyyy/MM"), F.lit("/x.jpg")).alias("target_path"))
    return tree.segments(e).select("label", F.col("start").cast("string").alias("start"), "proposed", "approved", "folders")


_TREE = f"WITH p AS (SELECT page_id, {_PATH} AS path FROM pages), d AS (SELECT page_id, regexp_replace(path, '/?[^/]*$', '') AS dir FROM p), x AS (SELECT page_id, string_split(dir, '/') AS parts FROM d WHERE dir <> ''), y AS (SELECT page_id, array_to_string(parts[1:i], '/') AS node_id, i AS depth FROM (SELECT page_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM x))"


@query(_TREE + " SELECT node_id, CAST(max(depth) AS BIGINT) AS depth, count(*) AS file_count, array_to_string(list_sort(list(page_id))[1:3], ',') AS samples FROM y GROUP BY node_id")
def tree_rollup(s, d):
    p = t(s, d, "pages").select("page_id", _page_path().alias("path"))
    got = tree.roll_up(p, path="path", id="page_id", sample="page_id")
    return got.select("node_id", F.col("depth").cast("long").alias("depth"), "file_count", F.array_join(F.transform("samples", lambda x: x.cast("string")), ",").alias("samples"))


@query(
    _TREE + ", m AS (SELECT node_id AS old, 'moved/' || md5(node_id) AS new FROM y GROUP BY node_id HAVING count(*) % 2 = 1), b AS (SELECT page_id, new, old, row_number() OVER (PARTITION BY page_id ORDER BY length(old) DESC) AS r FROM y JOIN m ON y.node_id = m.old) "
    "SELECT p.page_id, CASE WHEN old IS NOT NULL THEN new || substr(path, length(old) + 1) END AS new_path FROM p LEFT JOIN b ON p.page_id = b.page_id AND r = 1"
)
def prefix_rewrite(s, d):
    p = t(s, d, "pages").select("page_id", _page_path().alias("path"))
    dirs = p.select(text.dir_name(F.col("path")).alias("dir")).filter("dir <> ''").withColumn("old", F.explode(paths.prefixes(F.col("dir"))))
    remap = dirs.groupBy("old").agg(F.count("*").alias("n")).filter("n % 2 = 1").select("old", F.concat(F.lit("moved/"), F.md5(F.col("old").cast("binary"))).alias("new"))
    return tree.rewrite_prefix(p, remap, path="path").select("page_id", "new_path")


@query(_ENTRY + " SELECT file_id, target_path, status FROM e WHERE status <> 'DONE' AND starts_with(target_path, '7/1995/')")
def files_under(s, d):
    return review.files_under(_entries(s, d), "7/1995").select("file_id", "target_path", "status")


@query("SELECT DISTINCT p_brand AS label FROM part WHERE p_brand <> '' ORDER BY 1")
def labels_distinct(s, d):
    return summary.distinct_values(t(s, d, "part"), column="p_brand", out="label")


@query("SELECT min(o_orderdate) AS first_ts, max(o_orderdate) AS last_ts, count(*) AS n FROM orders")
def date_extent(s, d):
    return summary.extent(t(s, d, "orders"), ts="o_orderdate")


@query("SELECT source, doc_id, running FROM (SELECT source, doc_id, CAST(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM documents) WHERE running <= 250000")
def budget_prefix(s, d):
    docs = t(s, d, "documents").select("source", "doc_id", "n_chars")
    return summary.within_budget(docs, keys=["source"], order="doc_id", size="n_chars", budget=250_000).select("source", "doc_id", "running")


@query(
    _ENTRY + " SELECT file_id, CASE WHEN taken_at >= TIMESTAMP '1997-01-01' AND taken_at < TIMESTAMP '1997-07-01' AND status = 'PROPOSED' THEN 'APPROVED' WHEN taken_at >= TIMESTAMP '1995-01-01' AND taken_at < TIMESTAMP '1995-07-01' AND status = 'APPROVED' THEN 'PROPOSED' ELSE status END AS status FROM e"
)
def approve_segment(s, d):
    import datetime as dt

    half = lambda year: tree.in_segment("taken_at", dt.datetime(year, 1, 1), dt.datetime(year, 7, 1))
    return store.set_status(store.set_status(_entries(s, d), half(1997), True), half(1995), False).select("file_id", "status")


@query(
    _ENTRY + ", m AS (SELECT file_id, status, target_path, who % 20 AS w, CASE WHEN status = 'DONE' THEN NULL WHEN who % 20 = 3 THEN regexp_replace(target_path, '^3/', '4/') WHEN starts_with(target_path, '5/1996/') THEN 'old' || substr(target_path, 7) END AS new FROM e) "
    "SELECT file_id, coalesce(new, target_path) AS target_path, CASE WHEN status = 'PROPOSED' AND file_id % 3 = 0 THEN 'APPROVED' ELSE status END AS status FROM m"
)
def confirm_moves(s, d):
    change = s.createDataFrame([("3", "4"), ("5/1996", "old")], "old string, new string")
    return review.moved_entries(_entries(s, d).drop("o_custkey"), change, F.col("file_id") % 3 == 0).select("file_id", "target_path", "status")


@query(
    "WITH p AS (SELECT p_partkey, p_brand AS d, p_partkey % 4 = 0 AS moved FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY lower(d) ORDER BY moved, p_partkey) AS r FROM p) "
    "SELECT p_partkey, d || '/x' || (CASE WHEN r = 1 THEN '' ELSE '_' || r END) || '.jpg' AS target FROM r"
)
def reclaim_names(s, d):
    p = t(s, d, "part").select("p_partkey", F.concat("p_brand", F.lit("/x.jpg")).alias("path"), (F.col("p_partkey") % 4 == 0).cast("int").alias("moved"))
    return naming.reclaim(p, path="path", moved="moved", order=["p_partkey"], out="target").select("p_partkey", "target")


# -- more expressions ---------------------------------------------------------------------------------------------------


@query("SELECT doc_id, sha256(strip_accents(text)) AS plain FROM documents")
def plain_spelling(s, d):
    return t(s, d, "documents").select("doc_id", F.sha2(text.strip_accents(F.col("text")).cast("binary"), 256).alias("plain"))


_SHOTS = "SELECT p_partkey, (CASE p_partkey % 4 WHEN 0 THEN 'IMG_E' WHEN 1 THEN 'IMG_O' WHEN 2 THEN 'IMG_' ELSE 'MG_E' END) || p_size || '.' || p_brand || '.jpg' AS name FROM part"


@query(f"WITH n AS ({_SHOTS}) SELECT p_partkey, regexp_replace(regexp_replace(name, '\\.[^.]*$', ''), '^IMG_[EO]', 'IMG_') AS stem FROM n")
def capture_stem(s, d):
    i = F.col("p_partkey") % 4
    head = F.when(i == 0, "IMG_E").when(i == 1, "IMG_O").when(i == 2, "IMG_").otherwise("MG_E")
    return t(s, d, "part").select("p_partkey", text.capture_stem(F.concat(head, F.col("p_size").cast("string"), F.lit("."), F.col("p_brand"), F.lit(".jpg"))).alias("stem"))


@query("SELECT event_id, CASE WHEN event_id % 6 = 0 THEN NULL ELSE date_trunc('second', ts) END AS wall, CASE WHEN event_id % 6 = 0 THEN 'soon' ELSE strftime(ts, '%Y:%m:%d %H:%M:%S') END AS bare FROM events")
def wall_time(s, d):
    e, i = t(s, d, "events").select("event_id", "ts"), F.col("event_id")
    shown = F.concat(F.date_format("ts", "yyyy:MM:dd HH:mm:ss"), F.when(i % 3 == 1, "+05:30").when(i % 3 == 2, "-07:00").otherwise(""))
    shown = F.when(i % 6 == 0, "soon").otherwise(shown)
    return e.select("event_id", times.parse_wall(shown).alias("wall"), times.strip_offset(shown).alias("bare"))


@query("SELECT vec_id, CAST(sign(y) * floor(abs(y) + 0.5) AS BIGINT) AS cell FROM (SELECT vec_id, CAST(embedding[1] AS DOUBLE) * 200 AS y FROM embeddings)")
def coordinate_cell(s, d):
    return t(s, d, "embeddings").select("vec_id", geo.cell_key(F.col("embedding")[0].cast("double") * 2).alias("cell"))


@query(
    "WITH o AS (SELECT o_orderkey, o_orderdate AS t, o_orderdate - INTERVAL 12 DAY AS f FROM orders) SELECT o_orderkey, strftime(f, '%Y/%m_%B') AS folder, "
    "CASE WHEN date_trunc('month', t) <> date_trunc('month', f) THEN strftime(t, '%b_%d') ELSE strftime(t, '%d') END AS day, date_trunc('month', t) <> date_trunc('month', f) AS crosses FROM o"
)
def day_folders(s, d):
    at = F.col("o_orderdate")
    folder = at - F.expr("INTERVAL 12 DAYS")
    return t(s, d, "orders").select("o_orderkey", times.month_folder(folder).alias("folder"), times.day_label(at, folder).alias("day"), times.crosses_month(at, folder).alias("crosses"))


@query(
    "WITH p AS (SELECT p_partkey, ' ' || p_name || ' , ' || p_brand || ',,' || p_type || ' ' AS name, lower(p_brand) AS b, lower(p_type) AS y, p_size FROM part), q AS (SELECT *, list_transform(string_split(trim(name), ','), lambda x: trim(x)) AS parts FROM p) "
    "SELECT p_partkey, parts[1] AS city, array_to_string(list_filter(parts[2:], lambda x: x <> ''), '|') AS qualifiers, (CASE WHEN p_size % 2 = 0 THEN TRUE ELSE b = y END) AS fits FROM q"
)
def place_qualifiers(s, d):
    p = t(s, d, "part")
    q = names.split_qualified(F.concat(F.lit(" "), "p_name", F.lit(" , "), "p_brand", F.lit(",,"), "p_type", F.lit(" ")))
    low = F.transform(q["qualifiers"], F.lower)
    state = F.when(F.col("p_size") % 2 == 0, F.lower("p_brand")).otherwise("x")
    return p.select("p_partkey", q["city"].alias("city"), F.array_join(q["qualifiers"], "|").alias("qualifiers"), names.matches_qualifiers(state, F.lower("p_type"), low).alias("fits"))


_DIRS = f"SELECT page_id, (CASE page_id % 5 WHEN 0 THEN 'a/.git/' WHEN 1 THEN 'node_modules/' WHEN 2 THEN 'x.git/' ELSE '' END) || {_PATH} AS path FROM pages"


@query(f"WITH p AS ({_DIRS}) SELECT page_id, len(list_intersect(string_split(path, '/'), ['.git', 'node_modules', '.Trash', '.svn'])) > 0 AS passed_over FROM p")
def ignored_dirs(s, d):
    i = F.col("page_id") % 5
    head = F.when(i == 0, "a/.git/").when(i == 1, "node_modules/").when(i == 2, "x.git/").otherwise("")
    return t(s, d, "pages").select("page_id", media.in_ignored_dir(F.concat(head, _page_path())).alias("passed_over"))


@query("SELECT event_id, event_id % 4 IN (0, 1) AS is_screenshot FROM events")
def screen_captures(s, d):
    i = F.col("event_id") % 4
    doc = F.when(i == 0, '{"UserComment":"Screenshot"}').when(i == 1, '{"SamsungCaptureInfo":"Screen recording","Make":7}').when(i == 2, '{"Description":"a Screenshot"}').otherwise(F.col("props"))
    return t(s, d, "events").select("event_id", media.is_screen_capture(doc).alias("is_screenshot"))


@query(
    "WITH g AS (SELECT DISTINCT p_partkey, (' ' || lower(p_name) || ' ')[i:i + 2] AS trigram FROM (SELECT p_partkey, p_name, unnest(range(1, length(p_name) + 1)) AS i FROM part)) SELECT trigram, count(*) AS n, min(p_partkey) AS first, max(p_partkey) AS last FROM g GROUP BY 1"
)
def trigram_index(s, d):
    g = fuzzy.trigram_index(t(s, d, "part"), id="p_partkey", name="p_name")
    return g.groupBy("trigram").agg(F.count("*").alias("n"), F.min("p_partkey").alias("first"), F.max("p_partkey").alias("last"))


_NEAR = """WITH p AS (SELECT vec_id, label, round(CAST(embedding[1] AS DOUBLE) * 2, 4) AS lat, round(CAST(embedding[2] AS DOUBLE) * 2, 4) AS lon FROM embeddings),
k AS (SELECT *, CAST(sign(lat) * floor(abs(lat * 100) + 0.5) AS BIGINT) || ':' || CAST(sign(lon) * floor(abs(lon * 100) + 0.5) AS BIGINT) AS cell FROM p),
f AS (SELECT cell, arg_min(lat, vec_id) AS lat, arg_min(lon, vec_id) AS lon FROM k GROUP BY cell),
c AS (SELECT 'C' || lpad(CAST(vec_id AS VARCHAR), 9, '0') AS city, lat AS y, lon AS x, label % 2 = 1 AS marks FROM p WHERE vec_id % 3 = 0),
j AS (SELECT cell, city, marks, (y - lat) * (y - lat) + (x - lon) * (x - lon) AS sq, abs(y - lat) <= 0.09 AND abs(x - lon) <= 0.09 AS near FROM f JOIN c ON y BETWEEN lat - 0.45 AND lat + 0.45 AND x BETWEEN lon - 0.45 AND lon + 0.45),
w AS (SELECT cell, max(near) AS any_near FROM j GROUP BY cell),
r AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY sq, city) AS r FROM j JOIN w USING (cell) WHERE near OR NOT any_near),
z AS (SELECT cell, city, row_number() OVER (PARTITION BY cell ORDER BY marks, sq, r) AS n FROM r WHERE r <= 32 AND sq <= 0.2025)"""


@query(_NEAR + " SELECT vec_id, city AS place FROM k JOIN z USING (cell) WHERE n = 1")
def place_lookup(s, d):
    p, c = _points(s, d)
    city = F.concat(F.lit("C"), F.lpad(F.col("place_id").cast("string"), 9, "0"))
    none = F.lit("")
    rich = c.filter("place_id % 3 = 0").select(city.alias("city"), none.alias("state"), none.alias("country"), "latitude", "longitude", F.col("marks").alias("has_marks"), city.alias("display_name"), city.alias("full_name"), city.alias("folder_name"))
    return places.lookup(p, rich, key="vec_id", lat="lat", lon="lon", order=["vec_id"])


@query(
    f"WITH p AS ({_PLACES}), q AS (SELECT min(city) AS typed FROM p) SELECT typed, CAST(rowid AS DOUBLE) AS latitude, -CAST(rowid AS DOUBLE) AS longitude FROM p, q WHERE lower(city) = lower(typed) ORDER BY rowid LIMIT 1"
)
def resolve_name(s, d):
    rows = _place_rows(s, d).withColumn("country_code", F.col("country")).withColumn("latitude", F.col("rowid").cast("double")).withColumn("longitude", -F.col("rowid").cast("double"))
    typed = rows.agg(F.min("city")).first()[0]
    found = places.resolve(places.enrich(rows), typed.upper()) if typed else None
    return s.createDataFrame([(typed, *found)] if found else [], "typed string, latitude double, longitude double")
