"""Place names over a places table: lookup by coordinates, resolution and search by name, saved places."""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.geo import cell_key
from ..functions.names import disambiguate, full_name, matches_qualifiers
from ..functions.text import ascii_lower, sanitize, strip_accents
from ..operators import fuzzy
from ..operators.groups import first_per_group
from ..operators.nearest import candidates, near_pairs
from ..schema import FAR_DEGREES, NEAR_DEGREES


def plain(x: str) -> str:
    return unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", x) if unicodedata.category(c) != "Mn"))


def split_name(name: str) -> tuple[str, list[str]]:
    parts = [p.strip() for p in name.strip().split(",")]
    return parts[0], [p for p in parts[1:] if p]


def name_counts(places: DataFrame, *, city: str = "city", code: str = "country_code") -> DataFrame:
    """Of each city name (A-Z case aside): rows, countries, and of each country's rows; two partial aggregations."""
    per = places.groupBy(ascii_lower(F.col(city)).alias("city_key"), F.coalesce(code, F.lit("")).alias("code")).agg(F.count("*").alias("in_country"))
    whole = per.groupBy("city_key").agg(F.sum("in_country").alias("total"), F.count_if(F.col("code") != "").alias("countries"))
    return per.join(whole, "city_key")


def enrich(places: DataFrame, claimed: list[str] | None = None) -> DataFrame:
    """Places with plain spelling, marks, display, full and folder names: worked out once, used by every query."""
    text = places.select("rowid", "city", "latitude", "longitude", *(F.coalesce(c, F.lit("")).alias(c) for c in ("state", "country", "country_code")))
    text = text.withColumn("plain", strip_accents(F.col("city"))).withColumn("state_plain", strip_accents(F.col("state"))).withColumn("country_plain", strip_accents(F.col("country")))
    text = text.withColumn("has_marks", F.col("plain") != F.col("city")).withColumn("city_key", ascii_lower(F.col("city")))
    counted = text.join(name_counts(text).withColumnRenamed("code", "country_code"), ["city_key", "country_code"])
    taken = F.lower("plain").isin(*[c.lower() for c in claimed]) if claimed else F.lit(False)
    shown = disambiguate(F.col("plain"), F.col("state_plain"), F.col("country_plain"), F.col("total"), F.col("countries"), F.col("in_country"), taken)
    return counted.withColumn("display_name", shown).withColumn("full_name", full_name(F.col("plain"), F.col("state_plain"), F.col("country_plain"))).withColumn("folder_name", sanitize(F.col("display_name")))


def nearest(points: DataFrame, enriched: DataFrame, *, key: str, lat: str, lon: str, limit: int = 1) -> DataFrame:
    """The best places of each point, by the near box where it has any, else by the far one."""
    ties = ["city", "state", "country"]
    pairs = near_pairs(points.select(key, F.col(lat).alias("_lat"), F.col(lon).alias("_lon")), enriched.select("city", "state", "country", "latitude", "longitude", "has_marks", "display_name", "full_name", "folder_name"), key=key, lat="_lat", lon="_lon", delta=FAR_DEGREES, ties=ties)
    near = pairs.filter((F.abs(F.col("latitude") - F.col("_lat")) <= NEAR_DEGREES) & (F.abs(F.col("longitude") - F.col("_lon")) <= NEAR_DEGREES))
    by_near = candidates(near, key=key, limit=limit, marks="has_marks", ties=ties).withColumn("_far", F.lit(0))
    by_far = candidates(pairs, key=key, limit=limit, marks="has_marks", ties=ties).withColumn("_far", F.lit(1))
    both = by_near.unionByName(by_far)
    usable = F.max(F.when((F.col("_far") == 0) & (F.col("rank") == 1) & (F.col("display_name") != ""), 1).otherwise(0)).over(Window.partitionBy(key))
    return both.withColumn("_n", usable).filter(F.col("_far") == 1 - F.col("_n")).drop("_far", "_n", "_lat", "_lon")


def lookup(points: DataFrame, enriched: DataFrame, *, key: str, lat: str, lon: str, order: list[str], exact: bool = False) -> DataFrame:
    """(key, place): each hundredth-degree cell is resolved once, by the coordinates of its first row in ``order``."""
    rows = points.filter(F.col(lat).isNotNull() & F.col(lon).isNotNull())
    if exact:
        return nearest(rows, enriched, key=key, lat=lat, lon=lon).select(key, F.col("display_name").alias("place"))
    celled = rows.withColumn("_cell", F.concat_ws(":", cell_key(F.col(lat)), cell_key(F.col(lon))))
    first = celled.groupBy("_cell").agg(F.min_by(F.struct(F.col(lat).alias("lat"), F.col(lon).alias("lon")), F.struct(*order)).alias("p")).select("_cell", "p.lat", "p.lon")
    found = nearest(first, enriched, key="_cell", lat="lat", lon="lon").select("_cell", F.col("display_name").alias("place"))
    return celled.select(key, "_cell").join(found, "_cell").select(key, "place")


def _qualified(enriched: DataFrame, qualifiers: list[str]) -> DataFrame:
    if not qualifiers:
        return enriched
    wanted = F.array(*(F.lit(plain(q).lower()) for q in qualifiers))
    return enriched.filter(matches_qualifiers(F.lower("state_plain"), F.lower("country_plain"), wanted))


def resolve(enriched: DataFrame, name: str) -> tuple[float, float] | None:
    """Coordinates of a name with its qualifiers: exact spelling (A-Z case aside) first, then without accents."""
    city, qualifiers = split_name(name)
    rows = _qualified(enriched, qualifiers)
    exact = ascii_lower(F.col("city")) == "".join(c.lower() if c.isascii() else c for c in city)
    loose = F.lower("plain") == plain(city).lower()
    got = rows.filter(exact | loose).withColumn("_t", F.when(exact, 0).otherwise(1)).orderBy("_t", "rowid").select("latitude", "longitude").limit(1).collect()
    return (got[0][0], got[0][1]) if got else None


def search(enriched: DataFrame, typed: str, limit: int = 8) -> DataFrame:
    """Places whose name begins as typed, one a full name; if there are none, those within two typing errors."""
    city, qualifiers = split_name(typed)
    rows = _qualified(enriched, qualifiers)
    low = "".join(c.lower() if c.isascii() else c for c in city)
    hits = rows.filter(F.col("city_key").startswith(low))
    found = first_per_group(hits, ["full_name"], [F.col("city"), F.col("rowid")]).orderBy("city", "rowid").limit(limit)
    if len(city) < 2 or found.limit(1).count():
        return found
    once = first_per_group(rows, ["full_name"], [F.col("city"), F.col("rowid")])
    return fuzzy.search(once, plain(city), id="rowid", name="plain", limit=limit).drop("overlap", "edits")


def canonical(enriched: DataFrame, typed: str) -> str:
    """The spelling to save: the place's full name on an exact match, as typed where nothing is like it, else an error."""
    typed = typed.strip()
    if not typed:
        raise ValueError("a place needs a name")
    rows = search(enriched, typed).collect()
    for fields in (("full_name",), ("display_name", "plain")):
        for r in rows:
            if any(r[f].lower() == typed.lower() for f in fields):
                return r["full_name"] or r["display_name"] or r["plain"]
    if not rows:
        return typed
    raise ValueError(f"{typed!r} isn't known; {rows[0]['full_name']} is the closest")


@dataclass(frozen=True)
class Anchor:
    name: str
    folder: str
    lat: float
    lon: float


def build_anchors(enriched: DataFrame, saved: list[str]) -> list[Anchor]:
    """Saved places with coordinates; unknown ones are left out; namesakes get a qualifier in their folder."""
    found = [(n, at) for n in saved if (at := resolve(enriched, n))]
    parts = []
    for n, _ in found:
        city, q = split_name(n)
        parts.append((city, q[0] if q else "", q[1] if len(q) > 1 else ""))
    out = []
    for (n, at), (city, state, country) in zip(found, parts, strict=True):
        same = [p for p in parts if p[0] == city]
        countries = {p[2] for p in same}
        here = sum(p[2] == country for p in same)
        folder = city
        if len(same) > 1:
            if here > 1 and state:
                folder = f"{city} - {plain(state)}"
            elif len(countries) > 1 and country:
                folder = f"{city} - {plain(country)}"
            elif state:
                folder = f"{city} - {plain(state)}"
        out.append(Anchor(n, folder, *at))
    return out


def suggest(enriched: DataFrame, typed: str, prior: DataFrame, at: tuple[float, float] | None = None, limit: int = 8) -> list[Row]:
    """Folder names to offer: near a point, then labels used before, then by prefix; each value once, in that order."""
    spark = enriched.sparkSession
    parts = []
    like = F.lower("value").startswith(typed.lower()) if typed else F.lit(True)
    if at:
        p = spark.createDataFrame([(1, at[0], at[1])], "k int, lat double, lon double")
        near = nearest(p, enriched, key="k", lat="lat", lon="lon", limit=limit)
        parts.append(near.select(F.col("folder_name").alias("value"), F.lit(0).alias("src"), F.col("rank").cast("long").alias("pos")).filter(like))
    parts.append(prior.select(sanitize(F.col("label")).alias("value"), F.lit(1).alias("src"), F.row_number().over(Window.orderBy("label")).cast("long").alias("pos")).filter(like))
    if typed:
        hits = search(enriched, typed, limit)
        parts.append(hits.select(F.col("folder_name").alias("value"), F.lit(2).alias("src"), F.row_number().over(Window.orderBy("city", "rowid")).cast("long").alias("pos")))
    all_ = parts[0]
    for x in parts[1:]:
        all_ = all_.unionByName(x)
    return keep_first(all_, "value", ["src", "pos"], limit).collect()


def keep_first(df: DataFrame, key: str, rank: list[str], limit: int) -> DataFrame:
    """Each key once, at its best rank, the best ``limit`` of them."""
    return df.groupBy(key).agg(F.min(F.struct(*rank)).alias("_o")).select(key, *(F.col(f"_o.{r}").alias(r) for r in rank)).orderBy(*rank).limit(limit)
